"""Publication, footers, series over HTTP, JDBC and exact signed ranks."""

import datetime as dt
import itertools
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import modelling
from ledgerline.sources import footers, series, sinks, snapshots, tables


def test_readers_see_whole_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path)
    snapshots.publish(spark.range(3), path)
    first = snapshots.current(spark, path)

    def fail(x):
        raise OSError("lost")

    bad = spark.range(9).select(F.udf(fail, "long")("id").alias("id"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(bad, path)
    assert snapshots.current(spark, path).count() == 3
    snapshots.publish(spark.range(5), path)
    assert (snapshots.current(spark, path).count(), first.count()) == (5, 3)
    for n in (6, 7):
        snapshots.publish(spark.range(n), path, keep=2)
    assert snapshots.current(spark, path).count() == 7
    assert len(list((tmp_path / "t").glob("v-*/_SUCCESS"))) == 2


def test_small_files_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "m.json")
    seen, stop = set(), threading.Event()

    def watch():
        while not stop.is_set():
            try:
                seen.add(open(path).read())
            except FileNotFoundError:
                seen.add(None)

    snapshots.write_text(spark, path, "0" * 50_000)
    t = threading.Thread(target=watch)
    t.start()
    for k in range(1, 20):
        snapshots.write_text(spark, path, str(k % 10) * 50_000)
    stop.set()
    t.join()
    assert seen <= {str(k) * 50_000 for k in range(10)}
    assert snapshots.read_text(spark, path) == "9" * 50_000
    assert [p.name for p in tmp_path.iterdir() if "m.json" in p.name and not p.name.endswith(".crc")] == ["m.json"]


def test_footers_answer_without_reading_rows(spark, tmp_path):
    path = str(tmp_path / "f")
    day = F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int"))
    spark.range(1000).repartition(3).select("id", F.when(F.col("id") % 2 == 0, day).alias("day"), F.lit("x").alias("s")).write.parquet(path)
    df = footers.footer_metrics(spark, path, ["id", "day"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(day), MAX(day)]" in plan
    r = df.first()
    size = sum(p.stat().st_size for p in (tmp_path / "f").glob("*.parquet"))
    assert (r.n_rows, r.n_columns, r.n_files, r.n_bytes) == (1000, 3, 3, size)
    assert (r.min_id, r.max_id, r.min_day, r.max_day) == (0, 999, dt.date(2000, 1, 1), dt.date(2000, 1, 1) + dt.timedelta(998))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_series_are_fetched_with_retries(spark):
    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            gone = self.path.endswith("GONE")
            code = 404 if gone else 503 if asked.count(self.path) < 3 else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(b"observation_date,X\n2000-01-01,1.5\n2000-02-01,.\n\n2000-03-01,-2\n")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(series.SeriesSource)
        read = spark.read.format("series").option("url", f"http://127.0.0.1:{server.server_port}/csv?id={{id}}").option("wait", "0.01")
        got = read.option("ids", "A B, C,C").load()
        assert got.rdd.getNumPartitions() == 2
        asked.clear()
        rows = sorted(got.collect())
        assert [tuple(r) for r in rows if r.series_id == "C"] == [("C", dt.date(2000, 1, 1), 1.5), ("C", dt.date(2000, 2, 1), None), ("C", dt.date(2000, 3, 1), -2.0)]
        assert len(rows) == 6 and sorted(asked) == ["/csv?id=A%20B"] * 3 + ["/csv?id=C"] * 3
        with pytest.raises(Exception, match="404"):
            read.option("ids", "GONE").load().collect()
        assert asked.count("/csv?id=GONE") == 1
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        series.fetch("file:///etc/hostname", 1, 0, 1)


def test_jdbc_by_years_and_undated(spark):
    url = "jdbc:derby:memory:ledger;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(1, dt.date(2000, 1, 1)), (2, dt.date(2000, 12, 31)), (3, dt.date(2001, 6, 1)), (4, None), (5, dt.date(2003, 1, 1))]
    spark.createDataFrame(rows, "K int, DAY date").write.jdbc(url, "FILINGS", mode="overwrite", properties={"driver": driver})
    df = tables.read_jdbc(spark, url, table="FILINGS", date="DAY", years=range(2000, 2003), fetchsize=2, undated=True, driver=driver, day_literal="DATE('{}')")
    assert df.rdd.getNumPartitions() == 4
    assert [sorted(r.K for r in p) for p in df.rdd.glom().collect()] == [[1, 2], [3], [], [4]]
    assert tables.read_jdbc(spark, url, query="SELECT COUNT(*) AS N FROM FILINGS", driver=driver).first().N == 5
    whole = tables.read_jdbc(spark, url, table="FILINGS", fetchsize=1, driver=driver)
    assert sorted(r.K for r in whole.filter("K > 2").collect()) == [3, 4, 5]


def test_reconciliation_counts_missing_and_surplus(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    got = sinks.reconcile(ids(1, 2, 2, 3), ids(9), ids(1, 2, 3, 3, 9), ["id"]).first()
    assert tuple(got) == (4, 1, 5, 1, 1, False)
    assert tuple(sinks.reconcile(ids(1), ids(), ids(1), ["id"]).first()) == (1, 0, 1, 0, 0, True)
    assert tuple(sinks.reconcile(ids(), ids(), ids(), ["id"]).first()) == (0, 0, 0, 0, 0, True)


def plain_signed_rank(xs):
    xs = [x for x in xs if x]
    size = sorted(map(abs, xs))
    rank = [sum(1 for s in size if s < abs(x)) + (size.count(abs(x)) + 1) / 2 for x in xs]
    w = sum(r for r, x in zip(rank, xs, strict=True) if x > 0)
    more = sum(1 for signs in itertools.product((0, 1), repeat=len(xs)) if sum(r for r, s in zip(rank, signs, strict=True) if s) >= w - 1e-9)
    return len(xs), w, more / 2 ** len(xs)


def test_signed_ranks_are_exact_with_ties(spark):
    r = random.Random(3)
    groups = {g: [r.choice([-3, -2, -1, 0, 1, 1, 2, 4, 7]) for _ in range(n)] for g, n in enumerate([1, 3, 6, 9, 12])} | {99: [0, 0], 98: [None, 2]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g int, lead int")
    got = {x.g: x for x in modelling.signed_rank_test(df, "lead", ["g"]).collect()}
    assert 99 not in got
    for g, x in got.items():
        n, w, p = plain_signed_rank(groups[g])
        assert (x.n, x.w_plus, x.p_value, x.exact) == (n, w, pytest.approx(p), True)
    many = [(0, r.choice([-3, -2, -1, 1, 2, 3])) for _ in range(150)]
    df = spark.createDataFrame(many, "g int, lead int")
    exact, near = (modelling.signed_rank_test(df, "lead", exact_up_to=k).first() for k in (200, 100))
    assert exact.exact and not near.exact
    assert near.p_value == pytest.approx(exact.p_value, rel=0.05)
    assert tuple(modelling.signed_rank_test(df.filter("false"), "lead").first()) == (0, 0.0, None, None) or modelling.signed_rank_test(df.filter("false"), "lead").first().p_value is None
