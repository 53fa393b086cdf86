"""WARC records written, cut, damaged and read back."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import warc

PAGES = "page_id long, url string, html string, digest string, size long, last string"


def pages(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["<p>é", "\r\n", "WARC/1.1\r\n", "text "]) for _ in range(40_000))
    rows = [(1, "http://a", "<html>one</html>"), (2, None, None), (3, "http://c", ""), (4, "http://d\r\nX: y", "<html>one</html>")]
    rows += [(5, "u", long), (6, "u", long), (7, "u", long + "x"), (8, "u", "0\r\n\r\n"), (9, "u", "<html>one</html>"), (9, "u", "<html>one</html>")]
    rows += [(None, "u", "<html>one</html>"), (None, "u", None), (10, "u", "\x00\x0b🙂")]
    return rows, spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], PAGES).repartition(3)


def test_round_trip(spark, tmp_path):
    rows, table = pages(spark)
    got = warc.warc_round_trip(table, str(tmp_path / "archive")).collect()
    largest: dict = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = largest[html or ""] if i is not None and largest[html or ""] != i else None
        label = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), label, "revisit" if refers else "response", refers, None if refers else raw, None))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.error) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    segments = warc.read_segments(spark, str(tmp_path / "archive"))
    assert segments.filter("segment > 1").count() > 4


def test_nothing(spark, tmp_path):
    _, table = pages(spark)
    assert warc.warc_round_trip(table.limit(0), str(tmp_path / "none")).count() == 0


def test_damage_is_a_row(spark, tmp_path):
    _, table = pages(spark)
    warc.write_archives(table, str(tmp_path / "a"))
    segments = warc.read_segments(spark, str(tmp_path / "a"))
    lost = warc.reassemble(segments.filter("segment != 2")).filter("error is not null").collect()
    assert lost and all("missing" in r.error for r in lost)
    shorter = segments.withColumn("block", F.expr("if(segment = 2, substring(block, 1, 10), block)"))
    assert {r.error for r in warc.reassemble(shorter).collect()} == {None, "the segments differ from the total length"}
    changed = segments.withColumn("digest", F.lit("WRONG"))
    assert all("digest" in r.error for r in warc.reassemble(changed).filter("record_type = 'response'").collect())


def test_chunks():
    for size in (1, 7, 4096):
        for body in (b"", b"x", bytes(range(256)) * 40):
            assert warc.dechunked(warc.chunked(body, size)) == body
    assert warc.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
