"""HTML, JSON lines, reports, PDF layout and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import chunking as C
from quarrylens.operators import html as H
from quarrylens.operators import sft as S
from quarrylens.sources import tables
from quarrylens.streaming import query_log as Q

LONG = "text that is long enough to stay"


def kinds(page):
    return [(b["block_type"], b["content"]) for b in H.page_blocks(page)]


@pytest.mark.parametrize(
    "page, expected",
    [
        # Skipped parts go, the content root is the main element.
        (f"<body><p>{LONG} out</p><main><nav>x</nav><p>{LONG}<script>no</script></p></main></body>", [("prose", LONG)]),
        ("<h2> A <b>b</b></h2><h3></h3>", [("heading", "## A b")]),
        # An unclosed paragraph holds the next one, so only the inner is a leaf.
        (f"<body><p>outer {LONG}<p>inner {LONG}</p></body>", [("prose", "inner " + LONG)]),
        # A span inside a div gives the text twice.
        (f"<body><div><span>{LONG}</span></div></body>", [("prose", LONG), ("prose", LONG)]),
        # A list in a list is emitted again; numbering restarts when nested.
        (
            "<body><ol><li>one</li><li>two<ul><li>in</li><li>side</li></ul></li><li>three</li></ol></body>",
            [("list_item", "1. one\n2. two\n  1. in\n  2. side\n3. three")],
        ),
        ("<body><ul><li>a<ul><li>b</li></ul></li></ul></body>", [("list_item", "- a\n  - b"), ("list_item", "- b")]),
        # Tables: spans are copied out, pipes escaped twice, a nested list is not a block.
        (
            "<body><table><thead><tr><th colspan=2>h|x</th></tr></thead><tbody><tr><td rowspan=2>a<ul><li>z</li></ul></td><td>b</td></tr>"
            "<tr><td>c</td></tr></tbody><tfoot><tr><td>f</td></tr></tfoot></table></body>",
            [("table", "| h\\\\|x | h\\\\|x |\n| --- | --- |\n| a z | b |\n| a z | c |\n| f |  |")],
        ),
        ("<body><table></table><ul></ul><p>short</p></body>", []),
        ("", []),
    ],
)
def test_page_blocks(page, expected):
    assert kinds(page) == expected


def test_pages_as_rows(spark):
    page = f"<h1>T</h1><p>{LONG}</p><table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    rows = H.explode_pages(df, "id", "html").orderBy("block_index").collect()
    assert [(r.block_type, r.block_index, r.table_index, r.section_header) for r in rows] == [
        ("heading", 0, None, "T"), ("prose", 1, None, "T"), ("table", 2, 0, "T"), ("table", 3, 1, "T"),
    ]
    assert len(df.select(H.html_tables(F.col("html")).alias("t")).first().t) == 2


def test_deep_page_is_read(spark):
    assert kinds("<body>" + "<div>" * 5000 + LONG)[0] == ("prose", LONG)


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xff</p>")
    assert tables.read_html_files(spark, str(tmp_path)).first().html == "<p>caf�</p>"


def test_golden_set(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"query":"q","context":"c","ground_truth":"g","doc_id":"d"}\n\n{"query":"q2","context":"c","ground_truth":"g"}\n')
    rows = tables.read_golden_set(spark, str(path)).orderBy("query").collect()
    assert [(r.doc_id, r.category) for r in rows] == [("d", "unknown"), ("unknown", "unknown")]
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        tables.read_golden_set(spark, str(path)).collect()
    with pytest.raises(Exception):
        tables.read_golden_set(spark, str(tmp_path / "absent.jsonl")).collect()


def test_raw_logs_to_training_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name in ("a.jsonl", "b.jsonl", "c.txt"):
        (logs / name).write_text("".join(json.dumps({"log": f"{name}{i} ₹", "ticket": {"ticket_id": str(i)}}, ensure_ascii=False) + "\n" for i in range(5)))
    raw = tables.read_raw_logs(spark, str(logs))
    assert raw.count() == 10
    pairs = S.exact_split(raw, "log").select("split", S.chatml(F.col("log"), S.ticket_to_json(F.col("ticket"))).alias("messages"))
    for part, n in (("train", 9), ("eval", 1)):
        tables.write_jsonl(pairs.filter(F.col("split") == part).select("messages"), str(tmp_path / part))
        back = tables.read_jsonl(spark, str(tmp_path / part), tables.CHATML_SCHEMA)
        assert back.count() == n and "₹" in back.first().messages[1].content


def test_report_file(spark, tmp_path):
    report = spark.createDataFrame([(0.5, None)], "avg double, error string")
    tables.write_report(report, str(tmp_path / "r"))
    assert tables.read_report(spark, str(tmp_path / "r")).first().avg == 0.5


T0 = dt.datetime(2024, 1, 1)
LOG = "ts timestamp, category string, is_decline boolean, total_latency_ms double"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_append_log_restarts_without_repeats(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in range(2):
        feed(spark, source, [(T0 + dt.timedelta(minutes=batch), "a", False, 1.0 + batch)])
        run(Q.append_log(spark.readStream.schema(LOG).parquet(source), sink, check))
    assert sorted(r.total_latency_ms for r in spark.read.schema(LOG).json(sink).collect()) == [1.0, 2.0]


def test_windows_drop_late_rows(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    for rows in ([(at(1), "a", False, 10.0), (at(2), "a", True, 30.0)], [(at(200), "a", False, 1.0)], [(at(3), "a", False, 99.0)], [(at(400), "a", False, 1.0)]):
        feed(spark, source, rows)
        figures = Q.windowed_figures(spark.readStream.schema(LOG).parquet(source), "ts", "1 hour", "10 minutes")
        run(figures.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", check))
    rows = spark.read.parquet(sink).orderBy("window_start").collect()
    assert [(r.queries, r.declined, r.avg_latency) for r in rows] == [(2, 1, 20.0), (1, 0, 1.0)]


def test_latest_n_state(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    seen = {}

    def keep(batch, _):
        seen.update({r.key: (r.n, r["mean"]) for r in batch.collect()})

    for start in (0, 5):
        feed(spark, source, [(T0 + dt.timedelta(minutes=i), "a", False, float(i)) for i in range(start, start + 5)])
        out = Q.latest_n(spark.readStream.schema(LOG).parquet(source), "category", "ts", "total_latency_ms", n=3)
        run(out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check))
    assert seen == {"a": (3, 8.0)}


def test_pages_to_chunks(spark):
    page = f"<h1>Top</h1><p>{LONG} first</p><p>{LONG} second</p>"
    df = spark.createDataFrame([(7, page)], "page_id int, html string").select("page_id", H.html_blocks(F.col("html")).alias("blocks"))
    rows = C.chunk_documents(df, "page_id", F.col("blocks"), C.ChunkConfig(doc_type="html")).orderBy("block_index").collect()
    assert [(r.chunk_id, r.content_type, r.section_header, r.has_overlap) for r in rows] == [
        ("7::0::0", "heading", "Top", False), ("7::1::0", "prose", "Top", False), ("7::2::0", "prose", "Top", True),
    ]
    assert rows[2].content_with_overlap == f"{LONG} first{C.OVERLAP_SENTINEL}{LONG} second"


def test_settings_come_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    from quarrylens.sources.tables import load_config

    path = tmp_path / "settings.yaml"
    path.write_text("model:\n  name: small\n  layers: [1, 2]\nrate: 0.5\n", encoding="utf-8")
    assert load_config(str(path)) == {"model": {"name": "small", "layers": [1, 2]}, "rate": 0.5}
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "absent.yaml"))
