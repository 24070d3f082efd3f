"""BPE encoding and decoding, with tree concatenation for long texts.

A text of up to LEAF_CHARS * 2 characters is encoded at once. A longer one is halved until its leaves are short; leaves are encoded
in parallel, wherever they land. Neighbours are then joined pairwise: a window around the join, from a pre-token start well left of
it to a place well right of it, is encoded anew and doubled until both sides agree with it, on the left from its first
pre-token on, on the right from a pre-token start that both have. A pre-token start fixes everything to its right (the pattern looks
at nothing on its left), so the joined ids are those of the whole; if no window agrees, the whole span is encoded anew.

Null texts are empty and have no tokens. Rows without an id and repeated rows get a row each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tune

LEAF_CHARS = 16_384
#: Characters by which agreement must be clear of a cut: more than the longest special token.
CLEAR, FIRST_WINDOW = 32, 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass
class Node:
    """ids of text, and (character, id) positions at which its pre-tokens start."""

    text: str
    ids: np.ndarray
    chars: np.ndarray
    at: np.ndarray


def leaf(tok, text: str) -> Node:
    e = tok.encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]] | (words < 0)) if len(words) else np.zeros(0, np.int64)
    offsets = np.array([o[0] for o in e.offsets], np.int64)
    return Node(text, np.array(e.ids, np.int64), offsets[first] if len(first) else first, first)


def _agree(tok, a: Node, b: Node, width: int) -> Node | None:
    """The join of a and b by a window of width characters on each side, if both sides agree with it."""
    cut, total = len(a.text), len(a.text) + len(b.text)
    left = np.flatnonzero(a.chars <= cut - width)
    p, p_id = (int(a.chars[left[-1]]), int(a.at[left[-1]])) if len(left) else (0, 0)
    end = min(total, cut + width)
    text = a.text[p:] + b.text[: end - cut]
    w = leaf(tok, text)
    # left: what lies clear of the cut is the same in both
    own = {(int(c) - p, int(i) - p_id) for c, i in zip(a.chars, a.at) if p <= c <= cut - CLEAR}
    if own != {(int(c), int(i)) for c, i in zip(w.chars, w.at) if c + p <= cut - CLEAR}:
        return None
    if end == total:
        q, w_id, b_id = total, len(w.ids), len(b.ids)
    else:
        starts = dict(zip((w.chars + p).tolist(), w.at.tolist()))
        both = [(c, starts[c], i) for c, i in zip((b.chars + cut).tolist(), b.at.tolist()) if cut + CLEAR <= c <= end - CLEAR and c in starts]
        for q, w_id, b_id in both:
            n = min(len(w.ids) - w_id, len(b.ids) - b_id)
            shared = int(w.at[w.chars + p <= end - CLEAR][-1]) - w_id
            if np.array_equal(w.ids[w_id : w_id + min(n, shared)], b.ids[b_id : b_id + min(n, shared)]):
                break
        else:
            return None
        if unicodedata.normalize("NFC", text) != unicodedata.normalize("NFC", text[: q - p]) + unicodedata.normalize("NFC", text[q - p :]):
            return None
    inner, after = w.at < w_id, b.at >= b_id
    return Node(
        a.text + b.text,
        np.concatenate([a.ids[:p_id], w.ids[:w_id], b.ids[b_id:]]),
        np.concatenate([a.chars[a.at < p_id], w.chars[inner] + p, b.chars[after] + cut]),
        np.concatenate([a.at[a.at < p_id], w.at[inner] + p_id, b.at[after] - b_id + p_id + w_id]),
    )


def join(tok, a: Node, b: Node) -> Node:
    width = FIRST_WINDOW
    while width < max(len(a.text), len(b.text)) * 2:
        if (n := _agree(tok, a, b, width)) is not None:
            return n
        width *= 2
    return leaf(tok, a.text + b.text)


def join_all(tok, nodes: list[Node]) -> Node:
    while len(nodes) > 1:
        nodes = [join(tok, *nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def halves(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """The leaves: text halved until none is over leaf_chars."""
    if len(text) <= leaf_chars:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf_chars) + halves(text[mid:], leaf_chars)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _whole(tokenizer_path: str):
    def run(batches):
        from .encoders import parts, word_bpe

        enc = word_bpe(tokenizer_path)
        for b in parts(batches, 1):
            found = enc.encode_decode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([_sha(i) for _, i, _ in found]), pa.array([_sha(t) for _, _, t in found])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _leaves(leaf_chars: int):
    def run(batches):
        for b in batches:
            for uid, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts = halves(text, leaf_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([uid] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(parts)], ["uid", "doc_id", "leaf", "text"])

    return run


def _encode_leaves(tokenizer_path: str):
    def run(batches):
        from .encoders import word_bpe

        tok = word_bpe(tokenizer_path).tok
        for b in batches:
            nodes = [leaf(tok, t) for t in b.column(3).to_pylist()]
            cols = [pa.array([getattr(n, k).astype("<i4").tobytes() for n in nodes], pa.binary()) for k in ("ids", "chars", "at")]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], ["uid", "doc_id", "leaf", "text", "ids", "chars", "at"])

    return run


def _joiner(tokenizer_path: str):
    def run(pdf):
        import pandas as pd

        from .encoders import word_bpe

        enc = word_bpe(tokenizer_path)
        pdf = pdf.sort_values("leaf")
        arrays = (tuple(np.frombuffer(v, "<i4").astype(np.int64) for v in row) for row in zip(pdf["ids"], pdf["chars"], pdf["at"]))
        root = join_all(enc.tok, [Node(t, *a) for t, a in zip(pdf["text"], arrays)])
        ids = root.ids.tolist()
        doc = pdf["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(doc) else int(doc)], "Int64"), "n_tokens": [len(ids)], "ids_sha256": [_sha(" ".join(map(str, ids)))], "decoded_sha256": [_sha(enc.decode(ids))]})

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by blanks, SHA-256 of the decoded text: a row for each row of docs."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    long = F.length("text") > 2 * leaf_chars
    whole = rows.filter(~long).mapInArrow(_whole(tokenizer_path), RESULT)
    cut = rows.filter(long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(_leaves(leaf_chars), "uid long, doc_id long, leaf long, text string")
    leaves = cut.repartition("uid", "leaf").mapInArrow(_encode_leaves(tokenizer_path), "uid long, doc_id long, leaf long, text string, ids binary, chars binary, at binary")
    return whole.unionByName(leaves.groupBy("uid").applyInPandas(_joiner(tokenizer_path), RESULT))
