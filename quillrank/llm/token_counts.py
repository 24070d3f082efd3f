"""Token counts through a digest cache.

Each text is known by the SHA-256 of its normalised content (null becomes empty; nothing else may change, as any other change could
change the count) and each tokenizer by the SHA-256 of its file. Stored counts are joined by both digests; one text of each
digest that has none is encoded, and what was found is appended to the cache as a new batch, which a rename makes visible.

Null texts count as empty. Rows without an id, repeated rows and equal texts under many ids each get a row of their own. Other
columns of the input are not read. An empty table gives no rows and leaves the cache as it was.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, hadoop, list_files, text_or_empty, tune, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(model_path: str) -> str:
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """All batches whose append was completed."""
    batches = sorted({n.rsplit("/", 1)[0] for n, _ in list_files(spark, cache_path, ".parquet") if "/batch-" in n})
    return spark.read.schema(CACHE_SCHEMA).parquet(*batches) if batches else spark.createDataFrame([], CACHE_SCHEMA)


def append_cache(counts: DataFrame, cache_path: str) -> None:
    spark, name = counts.sparkSession, uuid.uuid4().hex
    counts.write.parquet(f"{cache_path}/_tmp-{name}")
    fs, at = hadoop(spark, f"{cache_path}/_tmp-{name}")
    if list_files(spark, f"{cache_path}/_tmp-{name}", ".parquet"):
        fs.rename(at, hadoop(spark, f"{cache_path}/batch-{name}")[1])
    else:
        drop_path(spark, f"{cache_path}/_tmp-{name}")


def _encoder(model_path: str):
    def run(batches):
        from .encoders import parts, piece_counter

        counter = piece_counter(model_path)
        for b in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.count(b.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), digest: one row for each row of docs."""
    spark = docs.sparkSession
    tune(spark)
    cache_path = cache_path or fresh_path(spark, "token-cache")
    version = tokenizer_version(model_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    keys = written(rows.select("doc_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    # min() meets partial sums before the shuffle, so a text with very many copies is one row a task
    missing = keys.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("one")).join(known, "digest", "left_anti").select("digest", F.col("one.doc_id").alias("one"))
    texts = rows.join(missing, rows.doc_id.eqNullSafe(missing.one)).filter(digest == F.col("digest")).select("digest", "text")
    found = texts.mapInArrow(_encoder(model_path), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    append_cache(found.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens"), cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = written(counts, "token-counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
