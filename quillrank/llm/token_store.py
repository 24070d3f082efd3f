"""Token ids in raw shards, with a minimal perfect hash index from keys to offsets.

A shard holds frames in ascending order of the document key: a header (key or none, width, number of ids), the ids as little-endian
unsigned integers of two or four bytes, a zero byte. The index is cut into buckets of about 1,000 keys by a hash; each bucket
maps its n keys to the slots 0 ... n-1 without collision by small pilot numbers, and a slot holds a 32-bit fingerprint of its key,
the shard and the frame's offset. A look-up (get) reads one bucket and one frame, however many documents there are; documents(), which
wants every document, scans each shard once and takes a frame only where the index says that its key stands.

Documents are range-sorted by key, and rows of one key by a hash of their text, so a key with very many rows is dealt to many tasks. A
shard ends before it would pass shard_bytes, whatever the lengths of texts; a document longer than that has a shard to itself.

Null texts are empty: they hold the end id alone. Rows without a key come first and can't be looked up. Rows that share a key
stand one after another, and the index names the first of them and their number. An empty table gives an empty store. Other columns of
documents are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, hadoop, text_or_empty, tune, written
from .raw_files import commit, manifest, read_raw, write_raw

HEAD = "<4sBBHqI"
HEAD_BYTES = struct.calcsize(HEAD)
MAGIC = b"QTID"
BUCKET_KEYS, PER_PILOT, FIRST_PILOTS, MOST_PILOTS = 1000, 3, 16, 1024
FRAME_SCHEMA = "file string, seq long, doc_id long, offset long, n_tokens long, before long, ids_crc32 long"
INDEX_SCHEMA = "bucket long, n_keys long, pilots binary, prints binary, files array<string>, offsets binary, copies binary"


def _framer(tokenizer_path: str, end_id: int, shard_bytes: int):
    def run(batches):
        from .encoders import byte_bpe, parts

        enc, part, roll, used, seq = byte_bpe(tokenizer_path), TaskContext.get().partitionId(), 0, 0, 0
        width = int(enc.dtype[-1])
        end = end_id.to_bytes(width, "little")
        for b in parts(batches, 1):
            keys, files, values = b.column(0).to_pylist(), [], []
            for key, ids in zip(keys, enc.encode(b.column(1).to_pylist())):
                ids += end
                values.append(struct.pack(HEAD, MAGIC, key is not None, width, 0, key or 0, len(ids) // width) + ids)
                if used and used + len(values[-1]) >= shard_bytes:
                    roll, used = roll + 1, 0
                used += len(values[-1]) + 1
                files.append(f"{part:08d}-{roll:05d}")
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(range(seq, seq + len(keys)), pa.int64()), pa.array(values, pa.binary())], ["file", "seq", "value"])
            seq += len(keys)

    return run


def _frames(batches, with_crc: bool = True):
    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1)):
            data, at, before, out = memoryview(content.as_buffer()), 0, 0, []
            while at < len(data):
                magic, has, width, _, key, n = struct.unpack_from(HEAD, data, at)
                if magic != MAGIC:
                    raise ValueError(f"{file}: no frame at {at}")
                first = at + HEAD_BYTES
                crc = zlib.crc32(np.frombuffer(data[first : first + n * width], f"<u{width}").astype("<u4").tobytes()) if with_crc else None
                out.append((file, len(out), key if has else None, at, n, before, crc))
                at, before = first + n * width + 1, before + n
            for i in range(0, len(out), 10_000):
                cols = list(zip(*out[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:])], ["file", "seq", "doc_id", "offset", "n_tokens", "before", "ids_crc32"])


def _heads(batches):
    return _frames(batches, with_crc=False)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(keys, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.asarray(keys, np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64)))


def bucket_of(keys, n_buckets: int) -> np.ndarray:
    return (_hash(keys, 1) % np.uint64(n_buckets)).astype(np.int64)


def _groups(keys, n: int) -> np.ndarray:
    return (_hash(keys, 2) % np.uint64(max(1, -(-n // PER_PILOT)))).astype(np.int64)


def _slots(keys, pilots, n: int) -> np.ndarray:
    return (_mix(_hash(keys, 3) ^ _mix(np.asarray(pilots, np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def _prints(keys) -> np.ndarray:
    return (_hash(keys, 4) >> np.uint64(32)).astype("<u4")


def build_bucket(keys: np.ndarray) -> np.ndarray:
    """Pilots under which the distinct keys take the slots 0 ... n-1, each one once."""
    n = len(keys)
    groups = _groups(keys, n)
    sizes = np.bincount(groups, minlength=max(1, -(-n // PER_PILOT)))
    pilots, free = np.zeros(len(sizes), "<u4"), np.ones(n, bool)
    by_group, ends = keys[np.argsort(groups, kind="stable")], np.cumsum(sizes)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        own, first, block = by_group[ends[g] - sizes[g] : ends[g]], 0, FIRST_PILOTS
        while True:
            tries = np.arange(first, first + block, dtype=np.uint64)
            slots = _slots(own[None, :], tries[:, None], n)
            good = free[slots].all(axis=1)
            if len(own) > 1:
                ordered = np.sort(slots, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                pilots[g], free[slots[at]] = first + at, False
                break
            first, block = first + block, min(2 * block, MOST_PILOTS)
    return pilots


def find(keys: np.ndarray, bucket: dict) -> np.ndarray:
    """The slot of each key, or -1 where the stored fingerprint is another's."""
    n, pilots = bucket["n_keys"], np.frombuffer(bucket["pilots"], "<u4")
    slots = _slots(keys, pilots[_groups(keys, n)], n)
    return np.where(np.frombuffer(bucket["prints"], "<u4")[slots] == _prints(keys), slots, -1)


def _build(pdf):
    import pandas as pd

    keys = pdf["doc_id"].to_numpy(np.int64)
    pilots = build_bucket(keys)
    slots = _slots(keys, pilots[_groups(keys, len(keys))], len(keys))
    order = np.argsort(slots)
    row = (int(pdf["bucket"].iloc[0]), len(keys), pilots.tobytes(), _prints(keys)[order].tobytes(), list(pdf["file"].to_numpy()[order]), pdf["offset"].to_numpy("<i8")[order].tobytes(), pdf["copies"].to_numpy("<i8")[order].tobytes())
    return pd.DataFrame([row], columns=["bucket", "n_keys", "pilots", "prints", "files", "offsets", "copies"])


def _look(keys, index):
    import pandas as pd

    columns = ["doc_id", "file", "offset", "copies"]
    if not len(keys) or not len(index):
        return pd.DataFrame(columns=columns).astype({"doc_id": "int64", "offset": "int64", "copies": "int64"})
    b, wanted = index.iloc[0], keys["doc_id"].to_numpy(np.int64)
    slots = find(wanted, b)
    wanted, slots = wanted[slots >= 0], slots[slots >= 0]
    return pd.DataFrame(dict(zip(columns, (wanted, np.asarray(b["files"], object)[slots], np.frombuffer(b["offsets"], "<i8")[slots], np.frombuffer(b["copies"], "<i8")[slots]))))


def _bucketed(keys: DataFrame, n_buckets: int) -> DataFrame:
    """keys with its bucket, by doc_id."""

    def run(batches):
        for b in batches:
            yield b.append_column("bucket", pa.array(bucket_of(b.column("doc_id").to_numpy(zero_copy_only=False), n_buckets)))

    return keys.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*keys.dtypes, ("bucket", "long")]))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write shards, manifest and index of docs' texts to path. shard_bytes: of a shard at most, and of text in a sorted range, about."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    tmp = f"{path}/_tmp"
    write_raw(dealt.mapInArrow(_framer(tokenizer_path, end_id, shard_bytes), "file string, seq long, value binary"), tmp, ["seq"])
    commit(spark, tmp, path, ".ids", {"format": 1, "end_id": end_id})
    heads = read_raw(spark, path).mapInArrow(_heads, FRAME_SCHEMA)
    keys = heads.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("file", "offset")).alias("at"), F.count("*").alias("copies"))
    keys = written(keys.select("doc_id", "at.file", "at.offset", "copies"), "store-keys")
    n_buckets = max(1, -(-keys.count() // BUCKET_KEYS))
    _bucketed(keys, n_buckets).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA).withColumn("n_buckets", F.lit(n_buckets).cast("long")).write.parquet(f"{path}/index")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """A row for each frame, from the shards: file, seq, doc_id, offset, n_tokens, before (ids before it in its file), ids_crc32."""
    return read_raw(spark, path).mapInArrow(_frames, FRAME_SCHEMA)


def look_up(keys: DataFrame, path: str) -> DataFrame:
    """doc_id, file, offset, copies: for each distinct key that is stored (another passes for one in 2^32 cases)."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{path}/index")
    n = index.select("n_buckets").first()
    wanted = _bucketed(keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), n[0] if n else 1)
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look, "doc_id long, file string, offset long, copies long")


def get(spark: SparkSession, path: str, key: int) -> list[int] | None:
    """The ids of one key: one bucket of the index and one frame are read."""
    index = spark.read.parquet(f"{path}/index")
    n = index.select("n_buckets").first()
    bucket = index.filter(F.col("bucket") == int(bucket_of([key], n[0])[0])).first() if n else None
    slot = find(np.array([key]), bucket.asDict())[0] if bucket else -1
    if slot < 0:
        return None
    fs, at = hadoop(spark, f"{path}/{bucket['files'][slot]}")
    it = fs.open(at)
    try:
        it.seek(int(np.frombuffer(bucket["offsets"], "<i8")[slot]))
        _, _, width, _, stored, count = struct.unpack(HEAD, bytes(it.readNBytes(HEAD_BYTES)))
        return np.frombuffer(bytes(it.readNBytes(count * width)), f"<u{width}").tolist() if stored == key else None
    finally:
        it.close()


def documents(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the keys' documents and those without a key.

    Every shard is scanned once, its frames' digests are made, and keys are looked up in the index. A key's frame is taken only at the very
    shard and offset that the index names; further copies of a key are those that follow it.
    """
    rows = written(frames(spark, path), "store-frames")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    starts = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    found = look_up(keys, path).select("doc_id", F.col("file").alias("at_file"), F.col("offset").alias("at_offset"), "copies")
    at, named = F.struct("file", "offset"), F.struct(F.col("at_file").alias("file"), F.col("at_offset").alias("offset"))
    heads = written(rows.join(found, "doc_id").filter(at == named), "store-heads")
    copies = rows.join(heads.filter("copies > 1").select("doc_id", "at_file", "at_offset"), "doc_id").filter(at > named)
    read = heads.select(*rows.columns).unionByName(copies.select(*rows.columns)).unionByName(rows.filter("doc_id is null")).join(starts, "file")
    return read.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", F.col("file").alias("shard"), "offset")


def encode_to_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs to a new store and read every document back through its index."""
    path = fresh_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_path, end_id)
    return documents(docs.sparkSession, path, docs.select("doc_id"))


__all__ = ["build_bucket", "documents", "encode_to_store", "find", "frames", "get", "look_up", "manifest", "write_store"]
