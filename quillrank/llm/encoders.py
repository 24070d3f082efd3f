"""Exact, memoised calls of the tokenizer libraries, one instance a Python worker.

A vocabulary file is never trained or changed here. All three encoders rest on the same fact: at some places in a text the
library's result is the concatenation of the results of both sides. Texts are cut only at such places, each distinct piece is
encoded by the library once a worker and remembered, and a text in which the places cannot be told apart is encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Pieces and bytes that one memo remembers at most, and the bytes of one batch of texts; they bound memory, never results.
MEMO_PIECES, MEMO_BYTES, PART_BYTES = 500_000, 40 << 20, 4 << 20
#: Signs that stand in one piece after letters: no apostrophe, with which contractions begin.
_TAIL = ".,;:!?#&*%$"
#: Letters in all versions of Unicode, and those of them that lower-casing to one sign and normalising don't touch otherwise.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_SIMPLE = "".join(c for c in map(chr, range(0x100)) if "A" <= c <= "Z" or "a" <= c <= "z" or c >= "ß" and c != "÷")
#: White space besides the blank and the line feed, by any of the regex engines involved.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")


class Memo:
    """Values by piece, as two Arrow arrays. A memo that is full keeps the pieces met again since it last was.

    library gives the values of any pieces. Where letters are given, a piece of them with signs of _TAIL behind is the join of by_model's
    values of the letters (by_model(pieces, True)) and the signs (by_model(pieces, False)), and only new letters are computed."""

    def __init__(self, library, kind: pa.DataType, letters: str = "", by_model=None, join=None):
        self.library, self.letters, self.by_model, self.join = library, letters, by_model, join
        self.keys, self.values, self.uses = pa.array([], pa.string()), pa.array([], kind), np.zeros(0, np.int32)

    def of(self, pieces: pa.Array) -> pa.Array:
        """The values of distinct pieces, in their order."""
        n = len(pieces)
        stems = pc.utf8_rtrim(pieces, characters=_TAIL) if self.letters else pieces.slice(0, 0)
        at = pc.fill_null(pc.index_in(pa.concat_arrays([pieces, stems]), value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at, stem_at = at[:n], at[n:]
        new = at < 0
        if new.any():
            mask = pa.array(new)
            missed = pieces.filter(mask)
            found = self._computed(missed, stems.filter(mask), stem_at[new]) if self.letters else self.library(_strings(missed))
            at[new] = len(self.keys) + np.arange(len(missed))
            self.keys, self.values = pa.concat_arrays([self.keys, missed]), pa.concat_arrays([self.values, found])
            self.uses = np.r_[self.uses, np.zeros(len(missed), np.int32)]
        self.uses[at] += 1
        out = self.values.take(pa.array(at))
        if len(self.keys) > MEMO_PIECES or self.keys.nbytes + self.values.nbytes > MEMO_BYTES:
            kept, most = np.flatnonzero(self.uses > 1), len(self.keys) // 2
            kept = pa.array(kept if len(kept) <= most else kept[np.argsort(-self.uses[kept], kind="stable")[:most]])
            self.keys, self.values, self.uses = self.keys.take(kept), self.values.take(kept), np.zeros(len(kept), np.int32)
        return out

    def _computed(self, missed: pa.Array, stems: pa.Array, known: np.ndarray) -> pa.Array:
        """known: where the memo has each stem, or -1."""
        plain = pc.match_substring_regex(stems, f"^[{self.letters}]+$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        known = known[is_plain]
        fresh = stems.filter(plain).filter(pa.array(known < 0)).dictionary_encode()
        known[known < 0] = len(self.values) + fresh.indices.to_numpy()
        values = pa.concat_arrays([self.values, self.by_model(_strings(fresh.dictionary), True)])
        tails = pc.utf8_ltrim(missed.filter(plain), characters=self.letters).dictionary_encode()
        ends = self.by_model(_strings(tails.dictionary), False)
        parts = [self.join(values.take(pa.array(known)), ends.take(tails.indices)), self.library(_strings(missed.filter(pc.invert(plain))))]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.argsort(~is_plain, kind="stable"), kind="stable")))


def _strings(pieces: pa.Array) -> list[str]:
    return pieces.to_numpy(zero_copy_only=False).tolist()


def parts(batches, text: int):
    """batches with about PART_BYTES of texts (in column number text) or a single row each, so that neither short nor long texts make poor ones."""
    held, size = [], 0
    for b in batches:
        column = b.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES - size, "right")))
            held.append(b.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
            if size >= PART_BYTES or at < b.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _pieces_of(texts: list[str], memo: Memo, split) -> tuple[pa.Array, pa.Array]:
    """(offsets by text, value of each piece in order) of texts cut by split."""
    lists = split(pa.array(texts, pa.string()))
    pieces = lists.flatten().dictionary_encode()
    return lists.offsets, memo.of(pieces.dictionary).take(pieces.indices)


def _by_blank(texts: pa.Array) -> pa.Array:
    return pc.split_pattern(texts, " ")


def _byte_signs() -> list[str]:
    """The printable signs that byte-level vocabularies write bytes with: a byte's own character, or the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def _model_ids(tokenize, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
    """(ids of all pieces, ends of each piece's) by a model."""
    ids, ends = [], [0]
    for x in pieces:
        ids += [t.id for t in tokenize(x)]
        ends.append(len(ids))
    return np.array(ids, np.int64), ends


class ByteBpe:
    """Byte-level BPE of a tokenizers file: ids as little-endian bytes.

    Its pre-tokenizer's pieces hold white space only at their start, so text may be cut before a blank or line feed that follows
    a visible character. Texts with other white space, or with runs of it, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        pre = self.tok.pre_tokenizer
        self.cuts = self.tok.normalizer is None and "ByteLevel" in repr(pre) and "add_prefix_space=False" in repr(pre) and "use_regex=True" in repr(pre) and "Sequence" not in repr(pre)
        self.dtype = "<u2" if self.tok.get_vocab_size() < 1 << 16 else "<u4"
        self.signs, self.tokenize = dict(enumerate(_byte_signs())), self.tok.model.tokenize
        # letters, and signs after them, are pieces of their own that the model itself can take; the library must agree on samples
        after, alone = ["theyre", "élève", "Zz"], ["Ab", "###", ".,", "&&&", ""]
        self.letters = self.cuts and sys.byteorder == "little" and self._by_model(after, True).to_pylist() + self._by_model(alone, False).to_pylist() == self._library([" " + x for x in after] + alone)
        self.memo = Memo(self._pieces, pa.binary(), _LETTERS if self.letters else "", self._by_model, lambda a, b: pc.binary_join_element_wise(a, b, b""))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, parts: list[str], after_blank: bool) -> pa.Array:
        mark = self.signs[32] if after_blank else ""
        blob, ends = _model_ids(self.tokenize, [mark + (x if x.isascii() else x.encode().decode("latin-1").translate(self.signs)) for x in parts])
        blob, w = blob.astype(self.dtype).tobytes(), int(self.dtype[-1])
        return pa.array([blob[w * a : w * b] for a, b in zip(ends, ends[1:])], pa.binary())

    def _pieces(self, new: list[str]) -> pa.Array:
        """What the library gives for keys of the memo: a blank before each, but none where a sign for that stands first."""
        return pa.array(self._library([y[1:] if y[:1] == "\r" else y if y[:1] == "\n" else " " + y for y in new]), pa.binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.cuts and not ("  " in x or "\n\n" in x or " \n" in x or "\n " in x or _OTHER_SPACE.search(x)) for x in texts]
        whole = list(dict.fromkeys(x for x, p in zip(texts, plain) if not p))
        whole = dict(zip(whole, self._library(whole))) if whole else {}
        # the first piece has no blank before it
        offsets, values = _pieces_of(["\r" + x.replace("\n", " \n") for x, p in zip(texts, plain) if p], self.memo, _by_blank)
        joined = iter(pc.binary_join(pa.ListArray.from_arrays(offsets, values), b"").to_pylist())
        return [next(joined) if p else whole[x] for x, p in zip(texts, plain)]


class PieceCounter:
    """Token counts of a sentencepiece model.

    No merge crosses from a visible character to a blank if no vocabulary piece does; each blank-separated word then has the
    tokens that it has alone, as the library puts one blank before any text. Texts with runs of blanks, blanks at an end, or the
    blank's own stand-in sign go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        a, b = self.sp.encode(["x y", f"x{mark}y"], num_threads=1)
        kinds = range(self.sp.get_piece_size())
        self.cuts = a == b and self.sp.encode(" x", out_type=str)[0].startswith(mark) and len(self.sp.encode("x  y")) >= len(self.sp.encode("x y")) and not any(mark in self.sp.id_to_piece(i).lstrip(mark) for i in kinds) and self.sp.encode("x", out_type=str)[0].startswith(mark) and self.sp.encode("  x  ", out_type=str) != self.sp.encode("x", out_type=str)
        self.memo = Memo(lambda new: pa.array(self._library(new), pa.int32()), pa.int32())

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.sp.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        plain = [bool(self.cuts and x and "  " not in x and x[0] != " " and x[-1] != " " and "▁" not in x) for x in texts]
        whole = iter(self._library([x for x, p in zip(texts, plain) if not p]))
        offsets, values = _pieces_of([x for x, p in zip(texts, plain) if p], self.memo, _by_blank)
        sums = np.r_[0, np.cumsum(values.to_numpy(zero_copy_only=False), dtype=np.int64)]
        joined = iter(np.diff(sums[offsets.to_numpy()]).tolist())
        return [next(joined) if p else next(whole) for p in plain]


class WordBpe:
    """A tokenizers file that drops white space: decimal ids and decoded text.

    White space ends every piece of it, so text may be cut at ASCII white space, which the library drops.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cuts = [self.tok.encode(x, add_special_tokens=False).tokens for x in ("ab cd", "ab\ncd", "ab \t cd")] == 3 * [self.tok.encode("ab", add_special_tokens=False).tokens + self.tok.encode("cd", add_special_tokens=False).tokens] and self.tok.decoder is None
        # without a decoder, decoding joins the tokens by blanks
        size = self.tok.get_vocab_size()
        self.id_texts, self.token_texts = pa.array([f"{i} " for i in range(size)]), pa.array([(self.tok.id_to_token(i) or "") + " " for i in range(size)])
        self.signs, self.tokenize = dict(enumerate(_byte_signs())), self.tok.model.tokenize
        samples = ["theyre", "élèveß", "Zz", "###", ".,", "&&&", "A", ""]
        self.letters = self.cuts and self._by_model(samples).equals(self._library(samples))
        kind = pa.struct([("n", pa.int32()), ("ids", pa.string()), ("text", pa.string())])
        self.memo = Memo(self._library, kind, _SIMPLE if self.letters else "", self._by_model, self._joined)

    @staticmethod
    def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
        texts = [pc.binary_join_element_wise(a.field(k), b.field(k), "") for k in ("ids", "text")]
        return pa.StructArray.from_arrays([pc.add(a.field("n"), b.field("n")), *texts], ["n", "ids", "text"])

    def _values(self, ids: np.ndarray, ends: list[int]) -> pa.Array:
        """Number, ids and text of pieces' tokens, each token with a blank after it."""
        texts = [pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), t.take(pa.array(ids))), "") for t in (self.id_texts, self.token_texts)]
        return pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int32()), *texts], ["n", "ids", "text"])

    def _library(self, texts: list[str]) -> pa.Array:
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return self._values(np.array([i for e in found for i in e], np.int64), [0, *np.cumsum([len(e) for e in found]).tolist()])

    def _by_model(self, parts: list[str], _: bool = True) -> pa.Array:
        return self._values(*_model_ids(self.tokenize, [x.lower() if x.isascii() else x.lower().encode().decode("latin-1").translate(self.signs) for x in parts]))

    def one(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)

    def encode_decode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, ids joined by blanks, decoded text) of each text."""
        if not self.cuts:
            every = [self.one(x) for x in texts]
            return [(len(e), " ".join(map(str, e)), self.decode(e)) for e in every]
        offsets, values = _pieces_of(texts, self.memo, pc.ascii_split_whitespace)
        sums = np.r_[0, np.cumsum(values.field("n").to_numpy(zero_copy_only=False), dtype=np.int64)]
        ids, decoded = (pc.binary_join(pa.ListArray.from_arrays(offsets, values.field(k)), "").to_pylist() for k in ("ids", "text"))
        return [(n, i[:-1], t[:-1]) for n, i, t in zip(np.diff(sums[offsets.to_numpy()]).tolist(), ids, decoded)]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
