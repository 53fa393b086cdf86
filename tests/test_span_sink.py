"""The span sink: what failed or repeated tasks leave is not seen."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrylens.sources.span_sink import PENDING, SpanBatchWriter, SpanSink, SpanStreamWriter


def spans(path):
    lines = [line for f in sorted(path.glob("*.jsonl")) for line in f.read_text(encoding="utf-8").splitlines()]
    return [json.loads(line) for line in lines]


def rows(*names):
    return [Row(name=n, at=dt.datetime(2024, 1, 1), tags=Row(k=None)) for n in names]


def test_a_task_that_fails_once_leaves_no_double_row(tmp_path):
    def breaking():
        yield from rows("a", "b")
        raise OSError("executor lost")

    writer = SpanBatchWriter(str(tmp_path), overwrite=False)
    with pytest.raises(OSError):
        writer.write(breaking())
    messages = [writer.write(iter(rows("a", "b", "é"))), writer.write(iter([]))]
    assert spans(tmp_path) == []
    writer.commit(messages)
    assert [s["name"] for s in spans(tmp_path)] == ["a", "b", "é"]
    assert spans(tmp_path)[0] == {"name": "a", "at": "2024-01-01T00:00:00", "tags": {"k": None}}
    assert list((tmp_path / PENDING).iterdir()) == []


def test_a_repeated_batch_replaces_its_files(tmp_path):
    for names in (["a"], ["a", "b"]):
        writer = SpanStreamWriter(str(tmp_path))
        writer.commit([writer.write(iter(rows(*names)))], 7)
    writer = SpanStreamWriter(str(tmp_path))
    writer.abort([writer.write(iter(rows("lost")))], 8)
    assert [s["name"] for s in spans(tmp_path)] == ["a", "b"]


def test_writes_of_a_session(spark, tmp_path):
    spark.dataSource.register(SpanSink)
    df = spark.range(1000).select(F.col("id").alias("n"), F.lit(None).cast("string").alias("empty")).repartition(5)
    save = lambda frame, mode: frame.write.format("spans").mode(mode).save(str(tmp_path))
    save(df, "append")
    save(df.limit(0), "append")
    assert sorted(s["n"] for s in spans(tmp_path)) == list(range(1000)) and spans(tmp_path)[0]["empty"] is None
    broken = df.select(F.when(F.col("n") < 999, F.col("n")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("n"), "empty")
    with pytest.raises(PySparkException):
        save(broken, "append")
    assert len(spans(tmp_path)) == 1000
    save(df.filter("n < 3"), "overwrite")
    assert sorted(s["n"] for s in spans(tmp_path)) == [0, 1, 2]


def test_stream_of_spans(spark, tmp_path):
    spark.dataSource.register(SpanSink)
    source, target = tmp_path / "in", tmp_path / "out"
    spark.range(50).write.json(str(source))
    for _ in range(2):
        stream = spark.readStream.schema("id long").json(str(source)).writeStream.format("spans").option("path", str(target))
        run = stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(60)
        assert sorted(s["id"] for s in spans(target)) == list(range(50))
