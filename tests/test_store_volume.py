"""How often a store's bars are shuffled and written, and that upserts by ranges leave what a join would."""

import datetime as dt
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from barloom.deploy import work_folder
from barloom.plans.registry import QUERIES
from barloom.schemas import BARS
from barloom.sources import bars, barstore, store

DAY = dt.datetime(2024, 1, 1)
CODES, DAYS = 20, 200
#: Rows that notes of codes and files may add.
NOTES = 1500


def _bars(spark, codes, days, first=0, price=1.0):
    return spark.createDataFrame([(f"{c:06d}", 9, DAY + dt.timedelta(days=d), price, price, price, price, 1.0, price) for c in codes for d in range(first, days)], BARS)


@contextmanager
def _moved(spark):
    """Rows that tasks shuffle and write within the block."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = sc.statusStore().stageList(None, False, False, quantiles, jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before, out = set(stages()), {}
    yield out
    new = [s for k, s in stages().items() if k not in before]
    out |= {"shuffled": sum(s.shuffleWriteRecords() for s in new), "written": sum(s.outputRecords() for s in new)}


@pytest.fixture
def no_small_joins(spark):
    """As with larger tables, no join finds a side small by itself."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_a_save_shuffles_held_and_incoming_bars_once(spark, no_small_joins):
    s = barstore.BarStore(spark, work_folder(spark, "bars"), buckets=2)
    with _moved(spark) as first:
        s.save(_bars(spark, range(CODES), DAYS))
    assert first["shuffled"] <= CODES * DAYS + NOTES
    with _moved(spark) as second:
        s.save(_bars(spark, range(CODES), DAYS + 50, DAYS - 50, 2.0))
    assert second["shuffled"] <= CODES * DAYS + CODES * 100 + NOTES and second["written"] <= CODES * 100 + CODES * (DAYS + 50) + NOTES
    held = s.read().groupBy("open").count().collect()
    assert {r.open: r["count"] for r in held} == {1.0: CODES * (DAYS - 50), 2.0: CODES * 100}


def test_a_refresh_leaves_the_source_in_place(spark, no_small_joins):
    kept, source = (barstore.BarStore(spark, work_folder(spark, "bars"), buckets=2) for _ in range(2))
    source.save(_bars(spark, range(CODES), DAYS))
    codes = barstore._kept(spark.createDataFrame([("000003",), ("000004",)], "code string"), "codes")
    with _moved(spark) as moved:
        barstore.refresh(kept, source, codes, F.lit("2024-01-03 10:00:00").cast("timestamp"))
    assert moved["shuffled"] <= 2 * DAYS + 500 < CODES * DAYS
    assert kept.read().count() == 2 * DAYS


def test_the_query_makes_its_bars_once(spark, no_small_joins):
    d = "/root/testdata/sf0.001"
    n = QUERIES["bars_many"](spark, d).count()
    with _moved(spark) as moved:
        found = QUERIES["refresh_store"](spark, d)
        rows = found.count()
    assert rows == n
    # trades to bars, both stores' placing, the new version's placing: 1.1 + 1 + 0.6 + 1 times the bars, and notes
    assert moved["shuffled"] < 6 * n and moved["written"] < 5 * n


@pytest.mark.parametrize("most", [0, 500_000])
def test_few_codes_or_many_give_the_same_bars(spark, monkeypatch, most):
    monkeypatch.setattr(barstore, "BROADCAST_CODES", most)
    kept, source = (barstore.BarStore(spark, work_folder(spark, "bars"), buckets=2, file_rows=50) for _ in range(2))
    source.save(_bars(spark, range(3), DAYS, price=2.0))
    kept.save(_bars(spark, (1,), 90))
    kept.save(_bars(spark, (2,), DAYS))
    now = F.lit(str(DAY + dt.timedelta(days=DAYS - 1, hours=10))).cast("timestamp")
    barstore.refresh(kept, source, source.read().select("code").distinct(), now)
    got = {(r.code, r.open): r["count"] for r in kept.read().groupBy("code", "open").count().collect()}
    assert got == {("000000", 2.0): DAYS, ("000001", 1.0): 88, ("000001", 2.0): DAYS - 88, ("000002", 1.0): DAYS - 1, ("000002", 2.0): 1}


@pytest.mark.parametrize("by", [None, "volume"])
def test_upserts_by_ranges_leave_what_a_join_does(spark, by):
    order = F.col(by) if by else None

    def rows(keys):
        return spark.createDataFrame([(c, 9, None if d is None else DAY + dt.timedelta(days=d), float(x), 1.0, 1.0, 1.0, float(x), 1.0) for c, d, x in keys], BARS)

    held = rows([("a", 0, 1), ("a", 1, 2), (None, 0, 3), (None, 0, 4), ("b", None, 5), ("c", 7, 6), ("c", 7, 7)])
    fresh = rows([("a", 1, 12), (None, 0, 13), ("b", None, 15), ("d", 3, 16)] + ([("a", 1, 11), ("d", 3, 17), (None, 0, 14)] if order is not None else []))
    s = barstore.BarStore(spark, work_folder(spark, "bars"), buckets=1)
    s.save(held)
    s.save(fresh, order)
    want = store.upsert(held, fresh, order=order)
    assert sorted(map(str, s.read().collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("again", [False, True])
def test_saves_of_no_bars_make_no_version(spark, again):
    s = barstore.BarStore(spark, work_folder(spark, "bars"))
    none = _bars(spark, (1,), 5).limit(0)
    assert s.save(none, again=again) == 0 and s.versions() == [] and s.read().count() == 0
    assert s.save(_bars(spark, (1,), 5), again=again) == 1 and s.save(none, again=again) == 1 and s.read().count() == 5
    assert s.save(_bars(spark, (1,), 6, 4, 3.0), again=again) == 2 and s.read().count() == 6
    assert s.latest((9,)).first().latest == (DAY + dt.timedelta(days=5)).date()


def test_stops_and_what_follows_them(spark):
    rows = _bars(spark, (1, 2), 10).withColumn("open", F.dayofmonth("ts").cast("double"))
    ends = bars.stops(rows, (F.col("code") == "000001") & F.col("open").isin(3.0, 5.0))
    assert [r._end for r in ends.collect()] == [DAY + dt.timedelta(days=4)]
    assert {r.code: r["count"] for r in bars.up_to(rows, ends).groupBy("code").count().collect()} == {"000001": 6, "000002": 10}
