"""Stages are made once, and again where something they rest on has changed."""

import os

import pytest
from pyspark.sql import functions as F

from quillrank.operators.stages import Stages


@pytest.fixture
def chain(spark, tmp_path):
    source = f"{tmp_path}/source"
    spark.range(10).write.parquet(source)

    def run(factor=2, least=3):
        stages = Stages(spark, f"file://{tmp_path}/stages")
        a = stages.run("scaled", lambda s, source, factor: s.read.parquet(source).select((F.col("id") * factor).alias("v")), {"source": source}, factor=factor)
        b = stages.run("kept", lambda s, rows, least: rows.filter(F.col("v") >= least), {"rows": a}, least=least)
        c = stages.run("other", lambda s, source: s.read.parquet(source).limit(1), {"source": source})
        return stages, a, b, c

    return run


def made(stages):
    return [s.made for s in stages[1:]]


def test_a_second_run_starts_no_job(spark, chain):
    assert made(chain()) == [True] * 3
    spark.sparkContext.setJobGroup("again", "again")
    again = chain()
    assert made(again) == [False] * 3 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("again")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["v"] for r in again[2].table.collect()) == [4, 6, 8, 10, 12, 14, 16, 18]


def test_a_change_makes_what_depends_on_it(spark, chain, tmp_path):
    first = chain()
    assert made(chain(least=5)) == [False, True, False]
    assert made(chain(factor=3)) == [True, True, False]
    assert made(chain()) == [False] * 3  # what was there is still there
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/source")
    new = chain()
    assert made(new) == [True] * 3 and new[1].table.count() == 11
    assert new[0].drop("scaled", keep=[new[1]]) == 2 and made(chain()) == [False] * 3 and first[1].key != new[1].key


def test_a_stopped_stage_is_made_again(spark, chain, tmp_path, monkeypatch):
    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Stages, "_done", lambda self, folder: stop() if os.path.isdir(f"{tmp_path}/stages") else False)
        with pytest.raises(KeyboardInterrupt):
            chain()
    assert made(chain())[1:] == [True, True]
    with pytest.raises(Exception):
        Stages(spark, f"file://{tmp_path}/stages").run("bad", lambda s: s.range(3).select(F.raise_error(F.lit("x")).alias("e")))
    assert Stages(spark, f"file://{tmp_path}/stages").run("bad", lambda s: s.range(3)).made
