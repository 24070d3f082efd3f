"""Token counts, the token store and BPE by tree against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillrank.llm import bpe_tree, encoders, token_counts, token_store  # noqa: E402
from quillrank.llm.common import fresh_path  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a \n b", "x<|endoftext|>y <|endoftext|>  z", "<|EndOfText|>", "a\xa0b", "é é ́x", "a\tb", "▁a ▁ b", "中文 字", "a　b", "ẞ İ K", "\x1cab \x1c", "a\x00b", "don't  I'll we're", "😀 😀😀", "\r\n x", "9 99 9a", "foo.\nBar baz", "<s> </s>", "<|startoftext|>A<|endof", "and&&& the### of,&&& X!!", "word " * 3000]
DOCS = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, None), (7, ODD[7]), (7, "another text")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, b"z") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, start int, digest binary")


def key(r):
    return repr(r)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t.,'sStTlaéΣ9&#<|>▁\xa0́"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_encoders_are_the_libraries(texts):
    b, s, w = encoders.byte_bpe(BYTE), encoders.piece_counter(PIECE), encoders.word_bpe(WORD)
    assert b.cuts and s.cuts and w.cuts and b.letters
    assert b.encode(texts) == [np.array(e.ids, b.dtype).tobytes() for e in b.tok.encode_batch(texts, add_special_tokens=False)]
    assert s.count(texts) == [len(x) for x in s.sp.encode(texts)]
    assert w.encode_decode(texts) == [(len(e), " ".join(map(str, e)), w.decode(e)) for e in map(w.one, texts)]


def test_counts(spark, docs):
    sp = encoders.piece_counter(PIECE).sp
    cache = fresh_path(spark, "cache")
    got = token_counts.count_tokens(docs, PIECE, cache, limit=10).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 10) for i, t in DOCS]
    assert sorted(map(key, [tuple(r)[:4] for r in got])) == sorted(map(key, want))
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len({t or "" for _, t in DOCS})
    more = docs.union(spark.createDataFrame([(99, "something new", None, None, None)], docs.schema))
    assert token_counts.count_tokens(more, PIECE, cache).count() == len(DOCS) + 1
    assert token_counts.read_cache(spark, cache).count() == stored.count() + 1
    assert token_counts.count_tokens(docs.limit(0), PIECE, cache).count() == 0


def test_stored_counts_are_used(spark):
    cache = fresh_path(spark, "cache")
    digest = hashlib.sha256(b"known").digest()
    token_counts.append_cache(spark.createDataFrame([(token_counts.tokenizer_version(PIECE), digest, 777), ("other", digest, 1)], token_counts.CACHE_SCHEMA), cache)
    assert token_counts.count_tokens(spark.createDataFrame([(1, "known")], "doc_id int, text string"), PIECE, cache).first()["n_tokens"] == 777


def test_store(spark, docs):
    tok = encoders.byte_bpe(BYTE).tok
    rows = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in DOCS), key=lambda r: (r[0] is not None, r[0] or 0))
    path = fresh_path(spark, "store")
    token_store.write_store(docs, path, BYTE, shard_bytes=4000)
    got = token_store.documents(spark, path, docs.select("doc_id")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    n = [len(x) for _, x in rows]
    assert [r["n_tokens"] for r in got] == [r["n_tokens"] for r in got] and sum(n) == sum(r["n_tokens"] for r in got)
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1])
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_store.get(spark, path, 9) == dict(rows)[9] and token_store.get(spark, path, 12345) is None
    assert len(token_store.manifest(spark, path)["files"]) > 1


def test_empty_store(spark, docs):
    assert token_store.encode_to_store(docs.limit(0), BYTE).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    pilots = token_store.build_bucket(keys)
    slots = token_store._slots(keys, pilots[token_store._groups(keys, len(keys))], len(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))


TEXT = st.text(st.sampled_from("ab cD.,'st\n9é́̀<|>endoftxsrt ㄱ각&-😀"), max_size=400)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(3, 60))
def test_tree_joins_are_exact(text, leaf_chars):
    tok = encoders.word_bpe(WORD).tok
    text = text + "<|endoftext|>" + text[::-1]
    root = bpe_tree.join_all(tok, [bpe_tree.leaf(tok, x) for x in bpe_tree.halves(text, leaf_chars)])
    assert root.ids.tolist() == tok.encode(text, add_special_tokens=False).ids and root.text == text


def test_windows_are_enough_for_plain_text():
    tok, text = encoders.word_bpe(WORD).tok, "Some words, and then some more of them.\n" * 200
    a, b = (bpe_tree.leaf(tok, x) for x in bpe_tree.halves(text, 4200)[:2])
    assert bpe_tree._agree(tok, a, b, bpe_tree.FIRST_WINDOW * 2) is not None


def test_encode_decode(spark, docs):
    w = encoders.word_bpe(WORD)
    got = bpe_tree.encode_decode(docs, WORD, leaf_chars=50).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(e), sha(" ".join(map(str, e))), sha(w.decode(e))) for i, e in ((i, w.one(t or "")) for i, t in DOCS)]
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    assert bpe_tree.encode_decode(docs.limit(0), WORD).count() == 0


def test_documents_are_read_where_the_index_says(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(7, "text 7"), (None, "none")], "doc_id bigint, text string")
    token_store.write_store(docs, path, BYTE)
    assert token_store.documents(spark, path, docs.select("doc_id")).count() == 42
    index = spark.read.parquet(f"{path}/index").toPandas()
    index["offsets"] = [bytes(len(x)) for x in index["offsets"]]
    spark.createDataFrame(index, token_store.INDEX_SCHEMA + ", n_buckets long").write.mode("overwrite").parquet(f"{path}/index")
    assert token_store.documents(spark, path, docs.select("doc_id")).filter("doc_id is not null").count() == 0
