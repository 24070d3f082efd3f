"""Runs (maximal periodic stretches) of the words of texts, by the runs theorem.

Every run has, for one of the two orders of the alphabet, a longest Lyndon word that starts in it and is as long as its period. These
words end where the next smaller suffix starts: the next smaller value of the inverse suffix array. For the second order, where words
compare the other way round but a prefix still comes first, it is the next larger value of the inverse suffix array in which the end of the text
is the largest word. Each Lyndon root is extended to the right by the longest common prefix of two suffixes and to the left by that of
the reversed text, as range minima of the LCP array in a sparse table; what reaches least_times its period is a run.

Texts are independent of each other, so Spark deals them out and nothing is shuffled. The texts of an Arrow batch (bounded in rows and bytes)
are worked on together: their words stand in one array, each text with an end of its own, and suffixes are ranked within
their text. Ranks come from prefix doubling over the suffixes that still share a rank. The sparse table is made level by level and
answers the questions of a level at once, so only one level is held: memory is in proportion to the words of a batch or of its longest text.

Null, empty and blank texts have no words and no runs. Repeated rows get a row each; rows without an id are never rewritten. An
empty table gives no rows. Texts of any length are worked on whole, each in one task. Columns other than the id and the text are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tune

RUN = "start long, length long, period long"
SCHEMA = f"doc_id long, n_words long, runs array<struct<{RUN}>>, kept array<string>"
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words of a batch that are worked on together; a longer text is alone.
GROUP_WORDS = 200_000


def ranked(words: np.ndarray, text: np.ndarray, last: bool) -> np.ndarray:
    """Ranks of the suffixes, those of a text side by side. words: numbers from 1 on, and 0 at each text's end, which is its smallest or, if last, its
    largest word. text: the number of each place's text."""
    n = len(words)
    key = words.astype(np.int64)
    if last:
        key = np.where(key == 0, key.max(initial=0) + 1, key)
    key += text.astype(np.int64) * (key.max(initial=0) + 1)
    act = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.flatnonzero(np.diff(key[act], prepend=-1))
    rank[act] = np.repeat(new, np.diff(new, append=n))
    step = 1
    while True:
        held = rank[act]
        shared = np.zeros(len(act), bool)
        same = held[1:] == held[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        act = act[shared]
        if not len(act):
            return rank
        group, then = rank[act], rank[act + step]  # a suffix that shares its first words with another doesn't hold the end within them
        order = np.lexsort((then, group))
        act, group, then = act[order], group[order], then[order]
        starts = np.diff(group, prepend=-1) != 0
        first = np.flatnonzero(starts)
        new = np.flatnonzero(starts | (np.diff(then, prepend=-1) != 0))
        before = new - first[np.cumsum(starts)[new] - 1]
        rank[act] = np.repeat(group[new] + before, np.diff(new, append=len(act)))
        step *= 2


def common_prefixes(words: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP of each suffix, by rank, and the one before it in its text; 0 for a text's first. In one sweep over the places, as the value falls by one at most."""
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    before = np.full(len(rank), -1, np.int64)
    before[place[1:]] = place[:-1]
    before[place[np.concatenate(([0], ends[:-1] + 1))]] = -1
    out, h, w, b = [0] * len(rank), 0, words.tolist(), before.tolist()
    for i, r in enumerate(rank.tolist()):
        j = b[i]
        if j < 0:
            h = 0
            continue
        while w[i + h] == w[j + h] and w[i + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return np.array(out, np.int32)


def minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair (low < high), by a sparse table of which one level is held at a time."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
    table = values
    for k in range(len(cuts) - 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        q = order[cuts[k] : cuts[k + 1]]
        out[q] = np.minimum(table[low[q]], table[high[q] - (1 << k)])
    return out


class Extensions:
    """How far the words from two places on are the same."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, rank: np.ndarray):
        self.rank, self.lcp = rank, common_prefixes(words, ends, rank)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return minima(self.lcp, np.minimum(a, b) + 1, np.maximum(a, b) + 1).astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller value; its own for a place without one."""
    r, out = rank.tolist(), list(range(len(rank)))
    r.append(-1)
    for i in range(len(rank) - 2, -1, -1):
        j, own = i + 1, r[i]
        while r[j] > own:
            j = out[j] if out[j] > j else len(rank)
        out[i] = j
    return np.minimum(np.array(out, np.int64), len(rank) - 1)


def runs_of(words: np.ndarray, lengths: np.ndarray, least_words: int, least_times: int) -> np.ndarray:
    """text, start, length, period of the runs of at least that many words and periods, in this order. words: numbers from 1 on, text after text."""
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    forward = np.zeros(len(text), np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    forward[inner] = words
    place = np.arange(len(text))
    mirror = begins[text] + ends[text] - 1 - place  # of a word in its reversed text
    mirror[ends] = ends
    backward = forward[mirror]
    rank = ranked(forward, text, last=False)
    after, before = Extensions(forward, ends, rank), None
    found = []
    for stops in (next_smaller(rank), next_smaller(-ranked(forward, text, last=True) + len(text))):
        i = np.flatnonzero(inner & ((stops - place) * least_times <= lengths[text]) & (stops < ends[text]))
        j = stops[i]
        right = after(i, j)
        left = np.zeros(len(i), np.int64)
        back = i > begins[text[i]]
        if back.any():
            before = before or Extensions(backward, ends, ranked(backward, text, last=False))
            left[back] = before(mirror[i[back] - 1], mirror[j[back] - 1])
        found.append(np.stack([text[i], i - left - begins[text[i]], j - i + left + right, j - i], 1))
    out = np.concatenate(found)
    return np.unique(out[(out[:, 2] >= least_times * out[:, 3]) & (out[:, 2] >= least_words)], axis=0)


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, or, for a tenth of the ids, with a repeated part planted from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * -(-(n - a) // p))[: n - a]


def _groups(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = text.as_buffer().to_pybytes().split()  # at ASCII blanks
            words = made_periodic(doc_id, words) if planted else words
            if ids and size + len(words) > GROUP_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
    if ids:
        yield ids, texts


def _finder(planted: bool, least_words: int, least_times: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches, planted):
            lengths = np.array(list(map(len, texts)), np.int64)
            every = pa.array([w for words in texts for w in words], pa.binary())
            numbers = every.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
            runs = runs_of(numbers, lengths, least_words, least_times)
            begins = np.cumsum(lengths) - lengths
            at = begins[runs[:, 0]] + runs[:, 1]
            edge = np.zeros(len(every) + 1, np.int64)
            np.add.at(edge, at + runs[:, 3], 1)
            np.add.at(edge, at + runs[:, 2], -1)
            keep = np.cumsum(edge)[:-1] == 0
            kept = every.filter(pa.array(keep)).cast(pa.string())
            per_text = np.add.reduceat(np.append(keep, False).astype(np.int64), begins) * (lengths > 0) if len(lengths) else lengths
            list_of = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
            rows = pa.StructArray.from_arrays([pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)], ["start", "length", "period"])
            of_text = np.bincount(runs[:, 0], minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), list_of(rows, of_text), list_of(kept, per_text)], ["doc_id", "n_words", "runs", "kept"])

    return find


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and kept (the words that no run has after its
    first period) for each row of docs. planted: rewrite a tenth of the texts first, so that they hold long runs."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_finder(planted, least_words, least_times), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length in periods (ties: smallest start, then period), and digests of all runs and of the kept words."""
    ahead = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    order = lambda a, b: F.when(ahead(a, b) != 0, F.signum(ahead(b, a))).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")
    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.array_join("kept", " "), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(F.col("b.length") * 1000 / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
