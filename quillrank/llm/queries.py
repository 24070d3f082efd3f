"""The queries opN_<name> over whole tables, with production parameters, and SQL for those that SQL can express.

op1 (edit distance to substrings), op2, op3 and op5 (tokenizers), op7 (runs of lines at any earlier place), op9 (labels of its own method)
and op10 (a fitted model) have none; their tests compare them with brute force, the libraries or held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import encode_to_store

    return encode_to_store(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_tree import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_chars has since grown by one where 7 divides the checksum of the id."""
    from .merkle import verified

    later = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return verified(_table(spark, sf_dir, "documents"), {"n_chars": later})


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digests, scan

    return digests(scan(_table(spark, sf_dir, "documents")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digests, find_runs

    return digests(find_runs(_table(spark, sf_dir, "documents"), planted=True))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_token_counts,
        op3_token_store,
        op4_lattice_dedup,
        op5_bpe_tree,
        op6_warc,
        op7_line_dedup,
        op8_minhash,
        op9_license_scan,
        op10_quality,
        op11_merkle_manifest,
        op12_secret_scan,
        op13_runs,
    )
}

#: Components by the least vertex over paths; ids has id, links has a and b in both directions.
_PARTS = """
paths AS (SELECT DISTINCT id AS node, id AS seen FROM ids UNION SELECT p.node, l.b FROM paths p JOIN links l ON l.a = p.seen),
parts AS (SELECT node, min(seen) AS component_id FROM paths GROUP BY node)"""

#: CRC-32 of a decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INT), 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind, pattern, group and its least length, as op12 states them.
_SECRETS = [
    ("assign", f"""(?:{_KEY})["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("gitlab", "glpat-[A-Za-z0-9_-]{20,}", 0, 0),
    ("npm", "npm_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35,}", 0, 0),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    ("bearer", "[Bb][Ee][Aa][Rr][Ee][Rr] +[A-Za-z0-9._~+/-]{20,}=*", 0, 0),
    ("url", "://[^\\x00-\\x20/:@]{1,64}:[^\\x00-\\x20/@]{3,64}@", 0, 0),
]


def _secret_matches(number: int) -> str:
    name, pattern, group, least = _SECRETS[number]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, '{name}' AS kind, {number} AS k, i, m, v, g, {least} AS least FROM (
  SELECT rid, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(v) AS v, unnest(list_slice(g, 1, len(m))) AS g
  FROM (SELECT rid, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS v, regexp_split_to_array(text, {p}) AS g FROM d WHERE regexp_matches(text, {p})))"""


ORACLES: dict[str, str] = {
    "op12_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(map(_secret_matches, range(len(_SECRETS))))}),
e AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid, k ORDER BY i)::BIGINT AS stop FROM f),
s AS (SELECT rid, kind, k, stop - length(m) AS start, stop FROM e WHERE length(v) >= least),
o AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (rid)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf(f"CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS now FROM documents),
r AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS rid FROM d),
tree AS (SELECT g, 0 AS l, i, leaf AS h, n FROM r
  UNION ALL SELECT g, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, l, i // 2, n),
tops AS (SELECT 0 AS l, g AS i, h, count(*) OVER () AS n FROM tree WHERE n = 1
  UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY l, i // 2, n),
steps AS (
  SELECT r.rid, t.l AS k, t.i, s.h FROM r JOIN tree t ON t.g = r.g AND t.n > 1 AND t.i = r.i >> CAST(t.l AS BIGINT) LEFT JOIN tree s ON s.g = t.g AND s.l = t.l AND s.i = xor(t.i, 1)
  UNION ALL SELECT r.rid, 1000 + t.l, t.i, s.h FROM r JOIN tops t ON t.n > 1 AND t.i = r.g >> CAST(t.l AS BIGINT) LEFT JOIN tops s ON s.l = t.l AND s.i = xor(t.i, 1)),
p AS (SELECT rid, list(CASE WHEN h IS NULL THEN '' WHEN i % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY k) AS path, coalesce(string_agg(h, '' ORDER BY k), '') AS proof FROM steps GROUP BY rid),
o AS (SELECT r.doc_id, r.leaf, t.h AS subroot, u.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  list_reduce(list_prepend(r.now, coalesce(p.path, [])), lambda a, s: sha256(CASE substr(s, 1, 1) WHEN 'L' THEN substr(s, 2) || a WHEN 'R' THEN a || substr(s, 2) ELSE a END)) AS folded_root
  FROM r JOIN tree t ON t.g = r.g AND t.n = 1 JOIN tops u ON u.n = 1 LEFT JOIN p ON p.rid = r.rid)
SELECT *, folded_root = root AS verified FROM o""",
    "op4_lattice_dedup": f"""
WITH RECURSIVE good AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {_PARTS}
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.node = e.vec_id""",
    "op13_runs": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) ELSE len(w) END AS a FROM d),
k AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM g),
e AS (SELECT rid, n, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END)) AS w FROM k),
same AS (SELECT x.rid, y.i - x.i AS q, x.i FROM e x JOIN e y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
island AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same),
every AS (SELECT rid, min(i) AS s, count(*) + q AS len, q FROM island GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM every x WHERE NOT EXISTS (SELECT 1 FROM every y WHERE y.rid = x.rid AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY len::DOUBLE / q DESC, s, q) AS place FROM r),
lines AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY rid),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS words FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = e.rid AND e.i >= r.s + r.q AND e.i < r.s + r.len) GROUP BY rid)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN best b ON b.rid = d.rid AND b.place = 1 LEFT JOIN lines l ON l.rid = d.rid LEFT JOIN kept c ON c.rid = d.rid""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
l AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - i % 8 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS digest FROM p)
SELECT d.page_id, strlen(d.html) AS payload_bytes, digest AS payload_digest, CASE WHEN d.page_id = l.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = l.last THEN NULL ELSE l.last END AS refers_to FROM d JOIN l USING (html)""",
    "op8_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM w),
ids AS (SELECT id, len(s) AS n FROM s),
e AS (SELECT id, n, unnest(s) AS sh FROM s JOIN ids USING (id)),
links AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.sh = y.sh AND x.id <> y.id AND 10 * x.n >= 8 * y.n AND 10 * y.n >= 8 * x.n
  GROUP BY x.id, y.id HAVING 100 * count(*) >= 80 * (min(x.n) + min(y.n) - count(*))), {_PARTS}
SELECT d.doc_id, i.n AS n_shingles, p.component_id, d.doc_id = p.component_id AS kept
FROM documents d JOIN ids i ON i.id = d.doc_id JOIN parts p ON p.node = d.doc_id""",
}
