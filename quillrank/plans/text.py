"""Completion parsing, linguistic counts, token overlap and codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import completions as C
from ..functions import linguistics as Z
from ..functions import text as X
from .tables import query, rounded, spread, table

_K = "regexp_extract(props, '([0-9]+)', 1)"
_RAW = f"""r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{{"score": ' || {_K} || ', "justification": "ok"}}' WHEN 1 THEN '```json' || chr(10) || '{{"score": ' || {_K} || ', "justification": "ok"}}' || chr(10) || '```' WHEN 2 THEN '{{"score": ' || {_K} || '.5, "justification": "cut off' WHEN 3 THEN 'I cannot say' ELSE '  ' END AS raw FROM events)"""
_PARSED = _RAW + """, s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'recovered' WHEN 3 THEN 'no_score' ELSE 'empty' END AS parse_status, CASE WHEN event_id % 5 < 3 THEN regexp_extract(raw, '([0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE END AS score, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'cut off…[TRUNCATED]' WHEN 3 THEN '[PARSE_FAILED]' END AS justification FROM r)"""


def _completions(spark, sf_dir):
    k, kind = F.regexp_extract("props", "([0-9]+)", 1), F.col("event_id") % 5
    whole = F.concat(F.lit('{"score": '), k, F.lit(', "justification": "ok"}'))
    raw = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    raw = raw.when(kind == 2, F.concat(F.lit('{"score": '), k, F.lit('.5, "justification": "cut off'))).when(kind == 3, "I cannot say").otherwise("  ")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query(f"WITH {_PARSED} SELECT event_id, score, justification, parse_status FROM s")
def completion_parse(spark, sf_dir):
    return _completions(spark, sf_dir).select("event_id", C.parsed(F.col("raw")).alias("p")).select("event_id", "p.*")


@query(f"WITH {_PARSED} SELECT parse_status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 6) AS percent, round(sum(score), 6) AS total FROM s GROUP BY parse_status")
def parse_status_counts(spark, sf_dir):
    rows = completion_parse(spark, sf_dir)
    counts = rows.groupBy("parse_status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))
    return rounded(counts.crossJoin(counts.agg(F.sum("n").alias("all"))).select("parse_status", "n", (100.0 * F.col("n") / F.col("all")).alias("percent"), "total"))


@query(f"WITH {_RAW} SELECT event_id, CASE WHEN event_id % 5 < 2 THEN '{{\"justification\":\"ok\",\"score\":' || regexp_extract(raw, '([0-9]+)', 1) || '}}' WHEN event_id % 5 = 2 THEN '{{\"justification\":\"cut off\",\"score\":' || regexp_extract(raw, '([0-9]+\\.5)', 1) || '}}' END AS repaired FROM r")
def repair_json(spark, sf_dir):
    return _completions(spark, sf_dir).select("event_id", C.repaired_json("raw").alias("repaired"))


# The rules of words in SQL whose regular expressions have no look-around: runs of letters, digits, underscores and apostrophes, without apostrophes at
# their ends, are cut where a part between apostrophes holds anything but ASCII letters and digits.
_SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\pZ"
_LING = rf"""d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[^{_SPACE}]') THEN text END AS text FROM documents),
 v AS (SELECT *, list_filter(string_split(array_to_string(list_transform(regexp_extract_all(text, '[\pL\pN_'']+'), lambda r: regexp_replace(trim(r, ''''), '[\pL\pN_]*[^a-zA-Z0-9''][\pL\pN_]*', ' ', 'g')), ' '), ' '), lambda w: w <> '') AS w,
  len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '[^{_SPACE}]'))) AS s, length(translate(text, ' ' || chr(10), '')) AS c, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS p,
  len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '\pL', 'x', 'g'), '\p{{Nd}}', '0', 'g'), '[\p{{No}}\p{{Nl}}]', 'x', 'g'), '(?m:^)[{_SPACE}]*[-*•–]|\b[0-9]+\.[{_SPACE}]')) AS b FROM d),
 e AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw, list_filter(w, lambda x: regexp_matches(x, '[a-zA-Z]')) AS a FROM v),
 h AS (SELECT doc_id, count(*) FILTER (n = 1) AS hapax FROM (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(lw) AS t FROM e) GROUP BY ALL) GROUP BY doc_id),
 f AS (SELECT e.*, CASE WHEN text IS NOT NULL THEN coalesce(hapax, 0) END AS hapax, len(w)::DOUBLE / greatest(s, 1) AS per_sentence, coalesce(list_sum(list_transform(a, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(lower(x), 'e+$', ''), '[aeiou]+'))))), CASE WHEN text IS NOT NULL THEN 0 END) AS y FROM e LEFT JOIN h USING (doc_id))"""


def _texts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _features(spark, sf_dir):
    return Z.features(_texts(spark, sf_dir), "text", "t")


_LONG = {
    "word_count": "len(w)",
    "sentence_count": "s",
    "char_count": "c",
    "avg_word_len": "list_sum(list_transform(a, lambda x: length(x)))::DOUBLE / nullif(len(a), 0)",
    "avg_sentence_len": "CASE WHEN text IS NOT NULL THEN per_sentence END",
    "type_token_ratio": "len(list_distinct(lw))::DOUBLE / nullif(len(w), 0)",
    "hapax_ratio": "hapax::DOUBLE / nullif(len(w), 0)",
    "stopword_ratio": "len(list_filter(lw, lambda x: list_contains({stop}, x)))::DOUBLE / nullif(len(w), 0)",
    "number_ratio": "len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')))::DOUBLE / nullif(len(w), 0)",
    "uppercase_ratio": "len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::DOUBLE / nullif(len(w), 0)",
    "avg_syllables_per_word": "y::DOUBLE / nullif(len(a), 0)",
    "flesch_reading_ease": "CASE WHEN len(a) > 0 THEN greatest(0.0, least(100.0, 206.835 - 1.015 * per_sentence - 84.6 * (y::DOUBLE / len(a)))) END",
    "punctuation_density": "p::DOUBLE / nullif(c, 0)",
    "bullet_count": "b",
    "punctuation": "p",
    "syllables": "y",
    "distinct": "len(list_distinct(lw))",
}


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_STOP = _sql_list(X.STOP_WORDS)


def _ling_sql(**named: str) -> str:
    """SQL of features under other names; shares are rounded."""
    cells = {k: _LONG[v].format(stop=_STOP) for k, v in named.items()}
    return f"WITH {_LING} SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {k}" if "/" in c or "per_" in c else f"({c})::BIGINT AS {k}" for k, c in cells.items()) + " FROM f"


def _named(rows, **named: str):
    kind = dict(rows.dtypes)
    return rounded(rows.select("doc_id", *(F.col(f"t_{v}").cast("double" if kind[f"t_{v}"] == "double" else "long").alias(k) for k, v in named.items())))


_COUNTS = {"n_words": "word_count", "n_sentences": "sentence_count", "n_chars": "char_count", "n_distinct": "distinct", "n_punctuation": "punctuation", "punctuation_density": "punctuation_density"}
_RATIOS = {"type_token": "type_token_ratio", "hapax_ratio": "hapax_ratio", "stop_ratio": "stopword_ratio", "word_length": "avg_word_len", "sentence_length": "avg_sentence_len", "number_ratio": "number_ratio", "upper_ratio": "uppercase_ratio"}
_EASE = {"n_syllables": "syllables", "syllables_per_word": "avg_syllables_per_word", "flesch": "flesch_reading_ease"}
_FOURTEEN = {f: f for f in Z.FEATURES}


@query(_ling_sql(**_COUNTS))
def ling_counts(spark, sf_dir):
    return _named(_features(spark, sf_dir), **_COUNTS)


@query(_ling_sql(**_RATIOS))
def ling_ratios(spark, sf_dir):
    return _named(_features(spark, sf_dir), **_RATIOS)


@query(_ling_sql(**_EASE))
def flesch(spark, sf_dir):
    return _named(_features(spark, sf_dir), **_EASE)


@query(_ling_sql(**_FOURTEEN))
def ling_features(spark, sf_dir):
    return _named(_features(spark, sf_dir), **_FOURTEEN)


_TURNS = "t AS (SELECT conv_id, turn, coalesce(text, '') AS cv, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS jd FROM conversations)"
_SETS = "s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(cv, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(coalesce(jd, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS b FROM t)"


def _turns(spark, sf_dir):
    """Each turn with the one after it, empty for the last; all turns of all conversations."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("cv"), following.alias("jd"))
    return rows.fillna("", ["cv", "jd"])


@query(f"WITH {_TURNS}, {_SETS}, n AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u, len(b) AS nb FROM s) SELECT conv_id, turn, round(CASE WHEN u > 0 THEN i::DOUBLE / u ELSE 0 END, 6) AS jaccard, round(CASE WHEN nb > 0 THEN i::DOUBLE / nb ELSE 0 END, 6) AS coverage FROM n")
def token_jaccard(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", X.token_set(F.col("cv")).alias("a"), X.token_set(F.col("jd")).alias("b"))
    return rounded(rows.select("conv_id", "turn", X.jaccard(F.col("a"), F.col("b")).alias("jaccard"), X.coverage(F.col("b"), F.col("a")).alias("coverage")))


# Neighbouring turns of a conversation are the pair; a conversation of one turn has none.
_NEXT = "t AS (SELECT conv_id, turn, text AS cv, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS jd FROM conversations)"
_CONTENT = r"list_filter(string_split_regex(lower({c}), '[^\pL\pN_]+'), lambda w: regexp_full_match(w, '[a-z]+') AND NOT list_contains(" + _STOP + ", w))"
_PAIRS_OF = "list_distinct(list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))"


@query(
    f"""WITH {_NEXT}, c AS (SELECT conv_id, turn, cv, jd, {_CONTENT.format(c="cv")} AS a, {_CONTENT.format(c="jd")} AS b FROM t),
 g AS (SELECT *, list_distinct(a) AS p, list_distinct(b) AS q, {_PAIRS_OF.format(c="a")} AS x, {_PAIRS_OF.format(c="b")} AS y FROM c WHERE cv IS NOT NULL AND jd IS NOT NULL)
 SELECT conv_id, turn, round(len(list_intersect(p, q))::DOUBLE / nullif(len(list_distinct(list_concat(p, q))), 0), 6) AS token_jaccard, round(len(list_intersect(p, q))::DOUBLE / nullif(len(q), 0), 6) AS jd_coverage,
  round(len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(list_concat(x, y))), 0), 6) AS bigram_jaccard FROM g"""
)
def content_coverage(spark, sf_dir):
    # a turn's words are found once, before turns meet by conversation
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).withColumn("cv", Z.content_words(F.col("text")))
    following = F.lead("cv").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select("conv_id", "turn", "cv", following.alias("jd")).filter("cv is not null and jd is not null")
    return rounded(Z.with_overlap(rows, "cv", "jd", worded=True).drop("cv", "jd"))


@query(f"WITH {_TURNS}, {_SETS}, n AS (SELECT conv_id, turn, a, b, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u, array_to_string(list_sort(a), ' ') AS x, array_to_string(list_sort(b), ' ') AS y FROM s) SELECT conv_id, turn, len(a) > 0 AND len(b) > 0 AND (((i = len(a) OR i = len(b)) AND least(len(a), len(b))::DOUBLE / greatest(len(a), len(b), 1) >= 0.5) OR i::DOUBLE / greatest(u, 1) >= 0.8) AS labels_match, len(a) > 0 AND len(b) > 0 AND (contains(x, y) OR contains(y, x) OR i::DOUBLE / greatest(u, 1) >= 0.5) AS strings_match FROM n")
def fuzzy_match(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", X.token_set(F.col("cv")).alias("a"), X.token_set(F.col("jd")).alias("b"))
    return rows.select("conv_id", "turn", X.labels_match(F.col("a"), F.col("b")).alias("labels_match"), X.strings_match(F.col("a"), F.col("b")).alias("strings_match"))


_VERBS = _sql_list(X.ACTION_VERBS)


@query(rf"WITH {_LING} SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\pL\pN_]+'), lambda x: list_contains({_VERBS}, x))) AS n_verbs, b AS n_bullets FROM f")
def action_verbs(spark, sf_dir):
    text = Z.said(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", F.when(text.isNotNull(), Z.count_verbs(text)).cast("long").alias("n_verbs"), Z.count_bullets(text).cast("long").alias("n_bullets"))


@query("WITH v AS (SELECT p_partkey, p_size / 8.0 - 0.5 AS v FROM part), l AS (SELECT p_partkey, CASE WHEN v < 0 OR v > 5 THEN '' WHEN v <= 1 THEN 'not important' WHEN v <= 2 THEN 'somewhat important' WHEN v <= 3 THEN 'important' WHEN v <= 4 THEN 'very important' ELSE 'extremely important' END AS label, CASE WHEN v > 4 THEN 'extremely important' WHEN v > 3 THEN 'very important' WHEN v > 2 THEN 'important' WHEN v > 1 THEN 'somewhat important' ELSE 'not important' END AS level FROM v) SELECT p_partkey, label, CASE label WHEN 'not important' THEN 1.0 WHEN 'somewhat important' THEN 2.0 WHEN 'very important' THEN 4.0 WHEN 'extremely important' THEN 5.0 ELSE 3.0 END::DOUBLE AS weight, level FROM l")
def importance_label(spark, sf_dir):
    v = F.col("p_size") / 8.0 - 0.5
    rows = table(spark, sf_dir, "part").select("p_partkey", X.importance_label(v).alias("label"), X.importance_level(v).alias("level"))
    return rows.withColumn("weight", X.importance_weight(F.col("label")))


@query("SELECT c_custkey, rtrim(replace(replace(to_base64(encode('cv::' || c_mktsegment || '::' || c_name)), '+', '-'), '/', '_'), '=') AS code, 'cv::' || c_mktsegment || '::' || c_name AS decoded, CASE WHEN length(c_name) > 10 THEN substr(md5(c_name), 1, 8) ELSE c_name END AS batch FROM customer")
def custom_id_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", X.encoded_id(F.concat_ws("::", F.lit("cv"), "c_mktsegment", "c_name")).alias("code"))
    return rows.select("c_custkey", "code", X.decoded_id(F.col("code")).alias("decoded"), X.short_batch(F.col("c_name")).alias("batch"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))


_ERRORS = ["", "Token limit reached", "status incomplete: max_output_tokens", "blocked by Content_Filter", "HTTP 500: content", "boom"]


@query(
    f"WITH e AS (SELECT CASE event_id % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{e}{chr(39)}' for i, e in enumerate(_ERRORS))} END AS error, event_id % 7 <> 6 AS answered FROM events) SELECT CASE WHEN NOT answered THEN 'missing' WHEN error = '' THEN 'success' WHEN contains(error, 'Token limit') OR contains(error, 'max_output_tokens') THEN 'token_limit' WHEN contains(lower(error), 'content_filter') THEN 'content_filter' WHEN contains(error, 'HTTP') THEN 'http_error' ELSE 'other_error' END AS category, count(*) AS n FROM e GROUP BY 1"
)
def failure_categories(spark, sf_dir):
    k = F.col("event_id") % 7
    error = F.get(F.array(*map(F.lit, _ERRORS)), k.cast("int"))
    return table(spark, sf_dir, "events").groupBy(X.failure_category(error, k != 6).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id AS number, event_type AS label, event_id % 2 = 0 AS keep FROM events")
def entity_lines(spark, sf_dir):
    raw = F.concat(F.lit("junk\n"), F.col("user_id").cast("string"), F.lit(". a span | "), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False"), F.lit(" | "), "event_type", F.lit(" | why"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(C.entity_lines(raw)).alias("l"))
    return rows.select("event_id", F.col("l.pos").cast("long").alias("number"), F.col("l.label").alias("label"), F.col("l.keep").alias("keep"))
