"""The command line, and default episodes on a stream."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import cli
from ledgerline.operators import labels
from ledgerline.sources import snapshots
from ledgerline.streaming import episodes

D = dt.date


def filings(spark, path, extra=()):
    rows = [("a", D(2001, 3, 31), D(2001, 5, 1), 1.0), ("a", D(2001, 6, 30), D(2001, 8, 1), 2.0), ("b", D(2000, 12, 31), D(2001, 2, 1), 4.0), ("b", D(2001, 3, 31), None, 4.0), *extra]
    df = spark.createDataFrame(rows, "gvkey string, datadate date, rdq date, atq double")
    text = {c: F.lit(v) for c, v in {"indfmt": "INDL", "datafmt": "STD", "popsrc": "D", "consol": "C", "sic": "2000", "datafqtr": "q", "datacqtr": "q"}.items()}
    number = {c: F.lit(1.0) for c in ("dlttq", "dlcq", "oibdpq", "xintq", "niq", "actq", "lctq", "cheq")}
    df.withColumns(text | number | {"sich": F.lit(None).cast("string")}).write.mode("overwrite").parquet(f"{path}/filings")


def test_accounting_job(spark, tmp_path, capsys):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    filings(spark, raw)
    job = ["accounting", "--raw", raw, "--out", out, "--start-year", "2001", "--end-year", "2002", "--staleness-cap-days", "100"]
    assert cli.main(job, spark) == 0
    panel = snapshots.current(spark, out)
    got = {(r.gvkey, r.quarter_end): (r.atq, r.is_stale) for r in panel.collect()}
    assert got["a", D(2001, 6, 30)] == (1.0, False) and got["a", D(2002, 12, 31)] == (None, True) and ("b", D(2001, 3, 31)) in got
    manifest = json.loads((tmp_path / "out" / "_manifest.json").read_text())
    assert manifest["filters"]["missing_rdq_rows"] == 1 and manifest["rows"] == len(got)
    filings(spark, raw, [("c", D(2001, 3, 31), D(2001, 4, 1), 9.0)])
    assert cli.main(job, spark) == 0 and "kept" in capsys.readouterr().out
    assert snapshots.current(spark, out).filter("gvkey = 'c'").count() == 0
    assert cli.main([*job, "--force"], spark) == 0
    assert snapshots.current(spark, out).filter("gvkey = 'c'").count() > 0


@pytest.mark.parametrize("argv", [
    ["accounting", "--out", "x"], ["accounting", "--raw", "r", "--out", "x", "--start-year", "1999"], ["equity", "--raw", "r", "--out", "x", "--start-year", "2005", "--end-year", "2004"],
    ["accounting", "--raw", "r", "--out", "x", "--staleness-cap-days", "-1"], ["nothing"], ["extract", "--out", "x", "--url", "u", "--catalog", "/nowhere"],
])
def test_wrong_arguments(argv):
    assert cli.main(argv, None) == 2


def test_extract_job(spark, tmp_path, capsys):
    url, driver = "jdbc:derby:memory:cli;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    for name in ("T1", "T2"):
        spark.createDataFrame([(1, D(2001, 1, 1)), (2, None), (3, D(1990, 1, 1))], "K int, DAY date").write.jdbc(url, name, mode="overwrite", properties={"driver": driver})
    catalog = tmp_path / "c.json"
    catalog.write_text(json.dumps({n: {"table": n.upper(), "date": "DAY", "day_literal": "DATE('{}')"} for n in ("t1", "t2")}))
    job = ["extract", "--out", str(tmp_path / "o"), "--url", url, "--driver", driver, "--catalog", str(catalog), "--end-year", "2002"]
    assert cli.main([*job, "--only", "t3"], spark) == 2
    assert cli.main([*job, "--only", "t1"], spark) == 0
    assert sorted(r.K for r in snapshots.current(spark, str(tmp_path / "o" / "t1")).collect()) == [1, 2]
    assert cli.main(job, spark) == 0
    assert "t1: kept" in (said := capsys.readouterr().out) and "t2: done" in said


def test_link_job(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    tables = {
        "companies": ([(1, "Acme Widgets Inc", "ACM"), (2, "Northern Lights Corp", None)], "id long, name string, ticker string"), "wide": ([(3, "Nobody", None)], "id long, name string, ticker string"),
        "firms": ([("g1", "Acme Widgets"), ("g2", "Northern Light Corp")], "gvkey string, name string"), "names": ([(7, "acm ", "Acme Widgets")], "permno long, ticker string, name string"), "links": ([(7, "g1")], "permno long, gvkey string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{raw}/{name}")
    assert cli.main(["link", "--raw", raw, "--out", out, "--fuzzy"], spark) == 0
    assert {r.id: r.gvkey for r in snapshots.current(spark, out).collect()} == {1: "g1", 2: "g2", 3: None}


def test_equity_job(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    text = lambda rows, names, where: spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{n} string" for n in names)).write.parquet(f"{raw}/{where}")
    months = [D(2001 + k // 12, k % 12 + 1, 15) for k in range(15)]
    text([(1, 1, d, 0.1, 0.1, -10.0, 10, 5, 100, 1, 1) for d in months], ["permno", "permco", "date", "ret", "retx", "prc", "altprc", "vol", "shrout", "hexcd", "hsiccd"], "monthly")
    text([(1, D(2002, 3, 20), -0.5, -0.5, 1, 574)], ["permno", "dlstdt", "dlret", "dlretx", "dlprc", "dlstcd"], "delistings")
    text([("g", 1, 1, D(1990, 1, 1), "E", "LC", "P")], ["gvkey", "lpermno", "lpermco", "linkdt", "linkenddt", "linktype", "linkprim"], "links")
    text([(d, 0.01, 0, 0, 0, 0, 0) for d in months], ["date", "vwretd", "vwretx", "ewretd", "ewretx", "sprtrn", "spindx"], "market")
    text([("g", D(2001, 12, 31), 2.0)], ["gvkey", "quarter_end", "atq"], "assets")
    assert cli.main(["equity", "--raw", raw, "--out", out], spark) == 0
    got = {r.quarter_end: r for r in snapshots.current(spark, out).collect()}
    assert sorted(got) == [D(2001, 3, 31), D(2001, 6, 30), D(2001, 9, 30), D(2001, 12, 31), D(2002, 3, 31)]
    assert got[D(2001, 12, 31)].market_to_book == 0.5 and got[D(2001, 12, 31)].ret_12 == pytest.approx(1.1**12 - 1)
    assert got[D(2002, 3, 31)].ret_12 == pytest.approx(1.1**12 * 0.5 - 1)


def test_streamed_episodes_equal_the_batch(spark, tmp_path):
    r = random.Random(5)
    day = lambda n: D(2000, 1, 1) + dt.timedelta(n)
    defaults = [(f"f{r.randrange(12)}", d := day(r.randrange(2000)), r.choice([None, d + dt.timedelta(r.randrange(1, 400)), d])) for _ in range(60)]
    fresh = [(f"f{r.randrange(12)}", d := day(r.randrange(2000)), d + dt.timedelta(r.randrange(0, 90))) for _ in range(25)]
    a = spark.createDataFrame(defaults, "gvkey string, default_date date, reinstated_date date")
    b = spark.createDataFrame(fresh, "gvkey string, offering_date date, first_rating date")
    want = {(x.gvkey, x.default_date, x.emerge_date) for x in labels.episodes(a, b).collect()}
    rows = sorted(map(tuple, episodes.events(a, b).collect()), key=lambda x: x[2])
    late = [rows[i] for i in sorted(range(len(rows)), key=lambda i: rows[i][2] + dt.timedelta(r.randrange(0, 60)))]
    schema, src, told, state = "gvkey string, kind string, at timestamp, since date", tmp_path / "in", str(tmp_path / "told"), str(tmp_path / "cp")
    last = ("none", "heartbeat", dt.datetime(2020, 1, 1), D(2020, 1, 1))
    parts = [late[: len(late) // 3], late[len(late) // 3 : len(late) // 2], late[len(late) // 2 :], [last], [last]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate(parts):  # each part is a run of its own, started anew from its checkpoint
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
            stream = episodes.stream_episodes(spark.readStream.schema(schema).parquet(str(src)), "90 days")
            stream.writeStream.outputMode("append").format("parquet").option("path", told).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(told)
    assert {(x.gvkey, x.default_date, x.emerge_date) for x in episodes.latest(rows).collect()} == want
    assert rows.count() == len(want) + sum(1 for w in want if w[2])
