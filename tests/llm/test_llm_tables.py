"""Steps that are written to the shared folder."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from pelagia.llm import decontaminate, tables
from pelagia.llm.tables import CLEANUP, stored


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {x for x in files.mkString("\n").split() if "shuffle_" in x}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    rows = stored(frame, "counts")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP, None) == setting
    assert {r.k: r["count"] for r in rows.collect()} == {r.k: r["count"] for r in frame.collect()}


def test_tidy_steps_give_memory_back_before_and_after(monkeypatch):
    class Frame:
        def mapInArrow(self, work, schema):
            return work

    calls = []
    monkeypatch.setattr(tables, "give_back", lambda: calls.append("give back"))
    step = tables.arrow(Frame(), lambda batches: iter(["work"]), "a long", tidy=True, encodes=True)
    for row in step(iter([])):
        calls.append(row)
    assert calls == ["give back", "work", "give back"]


def test_scans_for_benchmark_items_give_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(decontaminate, "give_back", lambda: calls.append(1))
    found = decontaminate.scanner(spark.createDataFrame([("a", "one two")], "item_id string, text string"))
    assert found.func(pa.array(["zero one two", None])).to_pylist()[0]["items"] == ["a"] and calls == [1]
