"""Writers. Files are written by tasks, in the place and format stated; nothing is gathered on the driver but a text report's few rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import compared, nested


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line; fields without a value are left out."""
    df.write.mode("append" if append else "overwrite").json(path)


def by_experiment(df: DataFrame, path: str, column: str = "experiment") -> None:
    """A folder for each experiment; those in df are replaced, and all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def summary_csv(df: DataFrame, path: str, first: str = "group", digits: int = 6) -> None:
    """One row a group, the group first, doubles rounded."""
    cols = [first, *sorted(c for c in df.columns if c != first)]
    kinds = dict(df.dtypes)
    df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in cols)).orderBy(first).write.mode("overwrite").option("header", True).csv(path)


def scores_and_detail(df: DataFrame, path: str, detail: str = "detail") -> None:
    """Scores and their parallel detail as two tables of JSON lines."""
    jsonl(df.drop(detail), f"{path}/scores")
    jsonl(df.select("cv_id", "jd_id", detail), f"{path}/detail")


def run_log(df: DataFrame, path: str) -> None:
    jsonl(df.withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))), path, append=True)


def report(metrics: DataFrame, title: str, most: int = 1000) -> str:
    """A text of metric, value and interval lines; metrics has one row a metric, and more than most are refused."""
    rows = metrics.orderBy("metric").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report")
    lines = [f"{r['metric']:<24} {r['value']:>12.6f}" + (f"  [{r['ci_lower']:.6f}, {r['ci_upper']:.6f}]" if "ci_lower" in r and r["ci_lower"] is not None else "") for r in rows]
    return "\n".join([title, "-" * len(title), *lines])


def nested_metrics(metrics: DataFrame, path: str, by: list[str]) -> None:
    """One JSON object for each by: its metrics by name, each with value and ends."""
    jsonl(nested(metrics, by), path)


def comparison_csv(metrics: DataFrame, path: str, by: list[str], condition: str, first: str, second: str) -> None:
    """Metrics that both conditions have, side by side, to six places."""
    compared(metrics, by, condition, first, second).write.mode("overwrite").option("header", True).csv(path)


def pairs_jsonl(df: DataFrame, path: str, columns: list[str]) -> None:
    jsonl(df.select(*columns), path)


def copied(spark: SparkSession, source: str, target: str) -> None:
    """The lines of source, as they are, in target."""
    spark.read.text(source).write.mode("overwrite").text(target)


def step_log(df: DataFrame, path: str, step: str = "step") -> None:
    """Prompts and raw completions, a folder for each step, added to what is there."""
    df.write.mode("append").partitionBy(step).json(path)


def _fs(spark: SparkSession, path: str):
    """(file system, what makes a path) of Hadoop's API."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ended_swap(spark: SparkSession, path: str) -> None:
    """End a swap that was stopped after it was decided: its manifest stands beside path and names the new table."""
    fs, at = _fs(spark, path)
    decided, old = at(f"{path}_swap"), at(f"{path}_old")
    if not fs.exists(decided):
        return
    stream = fs.open(decided)
    new = at(stream.readUTF())
    stream.close()
    if fs.exists(new):
        if fs.exists(at(path)):
            fs.delete(old, True)
            fs.rename(at(path), old)
        fs.rename(new, at(path))
    fs.delete(old, True)
    fs.delete(decided, False)


def stage_table(df: DataFrame, path: str) -> None:
    """A stage's table in place of the last, from which df may be read. It is written whole under another name; a manifest then decides the swap, which is
    two renames. Stopped before, the old table stands; stopped after, the new one is complete, and reading or writing the stage ends the swap."""
    spark = df.sparkSession
    ended_swap(spark, path)
    fs, at = _fs(spark, path)
    new = f"{path}_next-{uuid.uuid4().hex}"
    df.write.parquet(new)
    draft = at(f"{new}_swap")
    stream = fs.create(draft, True)
    stream.writeUTF(new)
    stream.close()
    fs.rename(draft, at(f"{path}_swap"))
    ended_swap(spark, path)


def schema_dump(classes: DataFrame, relations: DataFrame, path: str) -> None:
    """Classes (side, label, comment) and relations (bucket, label, domain, range), sorted, as JSON lines in two folders."""
    jsonl(classes.orderBy("side", "label"), f"{path}/classes")
    jsonl(relations.orderBy("bucket", "label"), f"{path}/relations")


def batch_files(results: DataFrame, path: str) -> None:
    """Results and errors of a batch apart: rows with an error, and the others."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    jsonl(results.filter(~failed), f"{path}/results")
    jsonl(results.filter(failed), f"{path}/errors")


def counts_text(df: DataFrame, title: str, most: int = 100) -> str:
    """Lines of name and number from df's first two columns; more than most rows are refused."""
    rows = df.orderBy(df.columns[0]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no summary")
    return "\n".join([title, *(f"  {r[0]}: {r[1]}" for r in rows)])
