"""Readers. All take a schema, so none reads the data twice, and all go through Spark, so any store serves."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found)


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict", missing_ok: bool = False) -> DataFrame:
    """JSON lines; blank ones are skipped. mode "strict" fails at a line that can't be read, "tolerant" leaves it out."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", {"strict": "FAILFAST", "tolerant": "DROPMALFORMED"}[mode]).json(path)


def damaged_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line: those that can't be read by schema."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    kept = F.from_json("value", f"{schema}, _line STRING", {"columnNameOfCorruptRecord": "_line"})
    return rows.select(kept["_line"].alias("line")).filter("line is not null")


def json_document(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """Whole files of one object or list each; files that can't be read are left out. default is what stands for a path without files."""
    if default is not None and not exists(spark, path):
        return default
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files that a path (with wildcards, or a folder) stands for, as Spark gives them; hidden ones are left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for status in fs.globStatus(at) or []:
        found = fs.listFiles(status.getPath(), True)
        while found.hasNext():
            name = found.next().getPath().toString()
            out += [name] if not name.rsplit("/", 1)[1].startswith(("_", ".")) else []
    return out


def json_documents(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the file each came from as path, report) of files that hold one JSON object each; paths may have wildcards.

    report has path and problem: missing for a path without files, unreadable for a file whose text is no object of the schema. The good files'
    rows don't depend on the others."""
    names = {p: files(spark, p) for p in paths}
    listed = spark.createDataFrame([(f,) for found in names.values() for f in found], "path STRING").distinct()
    missing = spark.createDataFrame([(p, "missing") for p, found in names.items() if not found], "path STRING, problem STRING")
    if not any(names.values()):
        return spark.createDataFrame([], f"{schema}, path STRING"), missing
    texts = spark.read.text([p for p, found in names.items() if found], wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = texts.select("path", F.from_json("value", f"{schema}, _damaged STRING", {"columnNameOfCorruptRecord": "_damaged"}).alias("d"))
    good = rows.filter(F.col("d").isNotNull() & F.col("d._damaged").isNull()).select("d.*", "path").drop("_damaged")
    return good, missing.union(listed.join(good.select("path"), "path", "left_anti").withColumn("problem", F.lit("unreadable")))


def experiments(spark: SparkSession, folder: str, names: list[str], fallback: dict[str, DataFrame] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows of all experiments with their name, report) of folder/<name>.parquet; a name without a file takes its fallback, if it has one.

    report has name and problem: missing, or unreadable where no schema can be read. Experiments may differ in columns; what one lacks is null.
    Without any rows the first is None."""
    out, report = None, []
    for name in names:  # as many as the caller names; only footers are read
        path = f"{folder.rstrip('/')}/{name}.parquet"
        rows, problem = None, None
        if not exists(spark, path):
            problem, rows = "missing", (fallback or {}).get(name)
        else:
            try:
                rows = spark.read.parquet(path)
            except Exception as e:  # Spark's errors of analysis and of tasks, whatever the store
                problem = f"unreadable: {type(e).__name__}"
        if problem:
            report.append((name, problem))
        if rows is not None:
            rows = rows.withColumn("experiment", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, spark.createDataFrame(report, "experiment STRING, problem STRING")


def table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, rename: dict[str, str] | None = None, sep: str = "\t") -> DataFrame:
    """A delimited file with a header, of which columns are read and renamed."""
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').csv(path)
    return rows.select(*(columns or rows.columns)).withColumnsRenamed(rename or {})


def workbook(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Rows of a sheet of an XLSX file, or of all such files in a folder, by the names in its header."""
    from .xlsx import XlsxSource

    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").schema(schema).options(**options).load(path)


def employment(spark: SparkSession, path: str, code: str = "OCC_CODE", total: str = "TOT_EMP") -> DataFrame:
    """SOC_BASE, TOT_EMP of a workbook (.xlsx) or a CSV export, one row a code: the first. Figures may have commas; what is no number is null."""
    if path.lower().endswith(".xlsx"):
        rows = workbook(spark, path, f"`{code}` STRING, `{total}` STRING, _row BIGINT")
    else:
        rows = spark.read.option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select(F.col(code).alias("SOC_BASE"), F.translate(total, ",", "").try_cast("double").alias("_n"), "_row")
    return rows.groupBy("SOC_BASE").agg(F.min_by(F.struct("_n"), "_row")["_n"].alias("TOT_EMP"))


def occupation_reference(spark: SparkSession, path: str) -> DataFrame:
    """code, title from .csv, .txt (tabs) or JSON lines; rows without either are left out, and the last title of a code stays."""
    if path.endswith(".csv"):
        rows = table(spark, path, schemas.OCCUPATIONS, sep=",")
    elif path.endswith(".txt"):
        rows = table(spark, path, schemas.OCCUPATIONS)
    else:
        rows = jsonl(spark, path, schemas.OCCUPATIONS, "tolerant")
    rows = rows.select(F.trim("code").alias("code"), F.trim("title").alias("title"), F.monotonically_increasing_id().alias("_at"))
    return rows.filter("code <> '' and title <> ''").groupBy("code").agg(F.max_by("title", "_at").alias("title"))


def parquet(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    if fallback is not None and not exists(spark, path):
        return fallback
    return spark.read.parquet(path)


def stage_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that writers.stage_table wrote; a swap that was stopped is ended first."""
    from .writers import ended_swap

    ended_swap(spark, path)
    return spark.read.parquet(path)


def job_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of all files that match, with the batch that each one's name begins with; an error if none does."""
    if not exists(spark, pattern):
        raise FileNotFoundError(pattern)
    return jsonl(spark, pattern, schema).withColumn("batch_name", batch_of(F.input_file_name()))


def batch_of(path: Column) -> Column:
    return F.split(F.element_at(F.split(path, "/"), -1), "_")[0]


def split_sides(records: DataFrame, key: str = "custom_id") -> tuple[DataFrame, DataFrame]:
    """(candidates, queries) by the first part of the key."""
    return records.filter(F.col(key).startswith("cv::")), records.filter(F.col(key).startswith("jd::"))


def parsed_key(key: Column) -> Column:
    """struct<type, batch, occ, style, idx, cf> of a key such as type::batch::occ::style::idx::cf_name."""
    base, parts = F.regexp_replace(key, r"::cf_\w+$", ""), None
    parts = F.split(base, "::")
    cf = F.regexp_extract(key, r"::cf_(\w+)$", 1)
    return F.struct(*(F.get(parts, i).alias(n) for i, n in enumerate(("type", "batch", "occ", "style", "idx"))), F.when(cf == "", None).otherwise(cf).alias("cf"))


_TOKEN = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|<[^>\s]*>|#[^\n]*|@prefix|\^\^|@[A-Za-z-]+|[^\s;,.<>"#\[\]()]+(?:\.[^\s;,.<>"#\[\]()]+)*|[;,.\[\]()]')


def triples_of(text: str) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) of a Turtle text; names stay as written, literals lose quotes and tags.

    A node in brackets is named _:[n] by its place among them, and so is each cell (rdf:first, rdf:rest) of a list in parentheses."""
    out, subject, predicate, held, outer, bare, i = [], None, None, [], [], 0, 0
    tokens = [t for t in _TOKEN.findall(text) if not t.startswith("#")]

    def settle():
        if len(held) == 1 and subject and predicate and subject != "(":
            out.append((subject, predicate, held[0]))

    while i < len(tokens):
        t = tokens[i]
        if t == "@prefix":
            i = tokens.index(".", i) + 1
            continue
        if t in (".", ";", ","):
            settle()
            held = []
            if t != ",":
                predicate = None
            if t == ".":
                subject = None
        elif t == "[":
            name, bare = f"_:[{bare}]", bare + 1
            outer.append((subject, predicate, held + [name]))
            subject, predicate, held = name, None, []
        elif t == "]" and outer:
            settle()
            name = subject
            subject, predicate, held = outer.pop()
            if subject is None:
                subject, held = name, []
        elif t == "(":
            outer.append((subject, predicate, held))
            subject, predicate, held = "(", "(", []
        elif t == ")" and outer and subject == "(":
            cells = [f"_:[{bare + k}]" for k in range(len(held))] + ["rdf:nil"]
            bare += len(held)
            for cell, item, rest in zip(cells, held, cells[1:]):
                out += [(cell, "rdf:first", item), (cell, "rdf:rest", rest)]
            subject, predicate, held = outer.pop()
            if subject is None:
                subject = cells[0]
            else:
                held.append(cells[0])
        elif t == "^^":
            i += 1
        elif t.startswith("@"):
            pass
        else:
            value = t.strip('"') if t.startswith('"') else t
            if subject is None:
                subject = value
            elif predicate is None:
                predicate = "rdf:type" if value == "a" else value
            else:
                held.append(value)
        i += 1
    return out


def _triple_batches(batches):
    for batch in batches:
        for text in batch.column(0):
            found = triples_of(text.as_py() or "")
            s, p, o = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (s, p, o)], ["s", "p", "o"])


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of an ontology file, which is small by its nature: one file is read by one task."""
    text = spark.read.text(path, wholetext=True)
    return text.mapInArrow(_triple_batches, "s string, p string, o string")
