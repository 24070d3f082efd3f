"""Benchmark decontamination: pigeonhole edit matching.

Text and items are lower-cased and runs of white space become one blank. An item of m characters may differ from a passage by
k = floor(EDIT_SHARE * m) edits. Cut into k + 1 pieces, at least one piece of it then occurs unchanged, so an automaton over
all pieces finds every candidate place; a window around it is verified by Myers' bit-parallel distance, with m-bit words.

The items are a stated query set. They are taken in blocks of at most BLOCK_CHARS characters, each block against all documents.

Null texts are empty and match nothing, as do null or blank items. Rows without an id and repeated rows each get their own result. Items
that share an id are each looked for. Other columns of documents are carried by
clean_documents() alone, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tune

EDIT_SHARE = 0.05
BLOCK_CHARS = 4_000_000
HITS = "array<struct<item_id:bigint,distance:bigint,start:bigint,end:bigint>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length, or as many as the item has characters."""
    n = min(budget + 1, len(item))
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to a substring of text, where the first such substring ends)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        inc, dec = down | ~(h | up), up & h
        if inc & top:
            score += 1
        elif dec & top:
            score -= 1
        if score < best:
            best, end = score, at + 1
        inc, dec = inc << 1, dec << 1
        up = (dec | ~(x | inc)) & full
        down = inc & x & full
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], edit_share: float):
        import ahocorasick

        self.items, self.known, table = [], {}, {}
        for item_id, text in items:
            text = normal(text or "")
            if not text:
                continue
            budget = int(edit_share * len(text))
            for offset, piece in pieces(text, budget):
                table.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in table.items():
            self.automaton.add_word(piece, (len(piece), places))
        if table:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """The best place of each item that text holds within its budget; start and end count normalised characters."""
        if not self.items:
            return []
        text, starts = normal(text), {}
        for last, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(last + 1 - size - offset)
        out = []
        for i, at in starts.items():
            item_id, item, budget = self.items[i]
            best, windows = None, []
            for s in sorted(at):
                if windows and s - windows[-1][1] <= 2 * budget:
                    windows[-1][1] = s
                else:
                    windows.append([s, s])
            for low, high in windows:
                first = max(0, low - budget)
                window = text[first : high + len(item) + budget]
                exact = window.find(item)
                if exact >= 0:
                    found = (0, first + exact, first + exact + len(item))
                else:
                    distance, end = self._verify(i, item, window)
                    if distance > budget:
                        continue
                    _, back = myers(item[::-1], window[:end][::-1])
                    found = (distance, first + end - back, first + end)
                best = min(best, found) if best else found
            if best:
                out.append({"item_id": item_id, "distance": best[0], "start": best[1], "end": best[2]})
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start"]))

    def _verify(self, i: int, item: str, window: str) -> tuple[int, int]:
        key = (i, window)
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[key] = myers(item, window)
        return self.known[key]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        if block and size + len(r[1] or "") > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(tuple(r))
        size += len(r[1] or "")
    if block:
        yield block


def _matching(shared, edit_share: float):
    def run(batches):
        matcher = Matcher(shared.value, edit_share)
        for b in batches:
            hits = [matcher.find(t) for t in b.column(b.num_columns - 1).to_pylist()]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "start", "end")]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, kind)], [*b.schema.names[:-1], "hits"])

    return run


def _with_hits(rows: DataFrame, benchmark: DataFrame, edit_share: float) -> list[DataFrame]:
    """For each block of items, rows with hits in place of its last column, the text."""
    spark = rows.sparkSession
    tune(spark)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + f", hits {HITS}"
    return [rows.mapInArrow(_matching(spark.sparkContext.broadcast(block), edit_share), schema) for block in _blocks(benchmark, "item_id", "text")]


def contamination(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end: each item found in a document, at its best place. Clean documents have no row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = rows.limit(0).select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("item_id", "distance", "start", "end")))
    for found in _with_hits(rows, benchmark, edit_share):
        out = out.union(found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance", "h.start", "h.end"))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    columns = docs.columns
    for block in _blocks(benchmark, "item_id", "text"):
        names = [f"_c{i}" for i in range(len(columns))]
        shared = docs.sparkSession.sparkContext.broadcast(block)
        tune(docs.sparkSession)
        kept = docs.toDF(*names).mapInArrow(_keeping(shared, edit_share, columns.index(text_col)), docs.toDF(*names).schema)
        docs = kept.toDF(*columns)
    return docs


def _keeping(shared, edit_share: float, at: int):
    def run(batches):
        matcher = Matcher(shared.value, edit_share)
        for b in batches:
            yield b.filter(pa.array([not matcher.find(t or "") for t in b.column(at).to_pylist()], pa.bool_()))

    return run
