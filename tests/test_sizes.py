"""Tables that the smallest ones do not stand for: many events at a time, values of zero, rows that span many others."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoplane import workloads
from chronoplane.analysis import attribution as att
from chronoplane.functions.scalars import ieee_div
from chronoplane.operators import intervals as iv
from tests.oracle import TABLES, compare

ORACLES = workloads.oracle_sql()


@pytest.fixture
def dense(sf, tmp_path):
    """The tables with an event table of 2,400 events in 80 minutes, most of them clicks, every 50th with value 0, and some later ones."""
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    kinds = "['click', 'view', 'error']"
    duckdb.execute(f"""COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01 00:00:00.25' + INTERVAL (i * 2) SECOND + INTERVAL (CASE WHEN i >= 2400 THEN i * 60 ELSE 0 END) SECOND AS ts, (i * 7 % 41)::BIGINT AS user_id,
        CASE WHEN i % 9 < 7 THEN 'click' ELSE {kinds}[1 + i % 3] END AS event_type, CASE WHEN i % 50 = 0 THEN 0.0 ELSE (i * 37 % 500)::DOUBLE END AS value, '{{}}' AS props FROM range(2700) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    return str(tmp_path)


def test_quotients_of_zero(spark, dense):
    assert compare(workloads.queries()["arithmetic"](spark, dense), dense, ORACLES["arithmetic"]) > 2_000


def test_quotients_of_no_value(spark, dense, tmp_path):
    """Events without a value have no quotient either, and what is divided by no value has none."""
    some = tmp_path / "some"
    some.mkdir()
    for t in TABLES:
        os.symlink(f"{dense}/{t}.parquet", some / f"{t}.parquet") if t != "events" else None
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 > 0 THEN value END AS value) FROM '{dense}/events.parquet') TO '{some}/events.parquet' (FORMAT parquet)")
    assert compare(workloads.queries()["arithmetic"](spark, str(some)), str(some), ORACLES["arithmetic"]) > 2_000
    row = spark.range(1).select(*(ieee_div(F.lit(a).cast("double"), F.lit(b).cast("double")).alias(n) for n, a, b in (("x", 1.0, None), ("y", None, 0.0), ("z", 1.0, 0.0)))).first()
    assert tuple(row) == (None, None, float("inf"))


def test_means_above_the_limit_are_kept(spark, dense):
    compare(workloads.queries()["upsample_totals"](spark, dense), dense, ORACLES["upsample_totals"])
    hours, _ = workloads.attribution_inputs(spark, dense)
    assert hours.filter("value > max_value").count()


def test_tiles_against_slices(spark):
    """Sums, minima and maxima over active rows, with slices on both sides of powers of two, against a row for every slice."""
    rnd = random.Random(7)
    rows = []
    for n, key in ((200, "a"), (3, "b"), (40, None)):
        for _ in range(n):
            s = rnd.randrange(300)
            rows.append((key, rnd.choice("xy"), s, s + rnd.choice([0, 1, 5, 250]), rnd.randrange(1_000)))
    df = spark.createDataFrame(rows, "k string, g string, s long, e long, v int")
    parts = {"low": (F.col("v"), F.min), "high": (F.col("v"), F.max), "total": (F.col("v"), F.sum), "n": (F.lit(1), F.sum)}
    got = iv.tiled(df, ["k"], parts, "s", "e", within=["g"])
    want = iv.sliced(df, ["k"], "s", "e").groupBy("k", "g", "__s", "__e").agg(F.min("v"), F.max("v"), F.sum("v"), F.count("*"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert iv.tiled(df.limit(0), ["k"], parts, "s", "e").count() == 0


def test_long_rows_are_not_repeated(spark, dense):
    """Rows that span thousands of slices: extremes and shares are worked out without a row for each slice."""
    for name in ("temporal_agg_by_state", "bottleneck_overlapping"):
        out = workloads.queries()[name](spark, dense)
        assert "__first, __last" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "sequence(__first" not in plan
        compare(out, dense, ORACLES[name])


def test_composites_do_not_lay_out_leaves(spark, monkeypatch):
    """Leaves that all span each other's changes: sums as by brute force, and no table of all leaves times changes is written."""
    n, most = 60, 1_000
    metrics = spark.createDataFrame([("m", "m", None, 0, most, 30.0, 50.0)], "metric_path string, metric_type string, machine string, start_ns long, end_ns long, value double, max_value double")
    leaves = [(f"/p/l[{i}]", i * 3, most - i * 5) for i in range(n)]
    phases = [("/", None, "/", 0, most, False, None), ("/p", "/", "/p", 40, 900, False, None)] + [(p, "/p", "/p/l", s, e, True, None) for p, s, e in leaves]
    phases = spark.createDataFrame(phases, "path string, parent string, type string, start_ns long, end_ns long, is_leaf boolean, machine string")
    rules = spark.createDataFrame([("m", p, att.EXACT, 1.0 + k % 2) for k, (p, _, _) in enumerate(leaves)], att.RULES)
    sizes, plain = [], att.written
    monkeypatch.setattr(att, "written", lambda df, tag: (out := plain(df, tag), sizes.append(out.count()))[0])
    out = att.Attribution(metrics, phases, rules=rules).attributed().collect()
    own = [r for r in out if r.phase_path not in ("/", "/p")]
    assert len(own) > n * 50 and max(sizes) < len(own) * 2 // 3
    for path, low, high in (("/", 0, most), ("/p", 40, 900)):
        sums = {t: r for r in out if r.phase_path == path for t in range(r.start_ns, r.end_ns)}
        for t in range(0, most, 7):
            at = [r for r in own if r.start_ns <= t < r.end_ns and r.start_ns < high and r.end_ns > low]
            if at or low <= t < high:
                assert (sums[t].usage, sums[t].capacity) == pytest.approx((sum(r.usage for r in at), sum(r.capacity for r in at)))
            else:
                assert t not in sums or sums[t].usage == 0


def test_leaves_come_by_time_and_phases_are_written_once(spark, dense, monkeypatch, tmp_path):
    """Phases are in only one of the tables written, and a table of the result is packed much smaller than one of its rows in any order."""
    tables, plain = [], att.written
    for module in (att, workloads):
        monkeypatch.setattr(module, "written", lambda df, tag: (out := plain(df, tag), tables.append((tag, out)))[0])
    out = workloads.queries()["attribution_leaf"](spark, dense)
    phases = workloads.attribution_inputs(spark, dense)[1].count()
    assert [tag for tag, t in tables if "phase_path" in t.columns or tag == "demands"] == ["pairs"]
    rows = plain(out, "rows")
    sizes = [sum(f.stat().st_size for f in path.glob("*.parquet")) for path, df in ((tmp_path / "own", out), (tmp_path / "any", rows.orderBy(F.rand(1)))) if df.coalesce(1).write.parquet(str(path)) is None]
    assert rows.count() > 10 * phases and sizes[0] < sizes[1] * 0.6, sizes
    compare(out, dense, ORACLES["attribution_leaf"])


def test_leaves_are_laid_out_in_small_tasks(spark, dense, monkeypatch):
    """No task of the result has many more phases than others, though most phases are of one metric, and a phase's rows lie together."""
    monkeypatch.setattr(att, "LEAVES", 64, raising=False)
    out = workloads.queries()["attribution_leaf"](spark, dense)
    by_task = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("phase_path").alias("n")).collect()
    phases = workloads.attribution_inputs(spark, dense)[1].count()
    assert len(by_task) > phases / 256 and max(r.n for r in by_task) < 6 * 64, by_task
    assert compare(out, dense, ORACLES["attribution_leaf"]) > 10 * phases


def test_joins_in_pieces(spark):
    """A key with many rows, most of them equal in time, in pieces: the same pairs as without, and no task with most rows."""
    rnd = random.Random(5)
    rows = [("a", 10.0, 40.0, i) for i in range(900)] + [(rnd.choice(["a", "b", None]), s, s + rnd.choice([0.0, 3.0, 50.0]), i) for i in range(300) for s in [float(rnd.randrange(90))]]
    left = spark.createDataFrame(rows, "k string, _start_time double, _end_time double, i long")
    right = spark.createDataFrame([(k, float(5 * n), 5.0 * n + 5, n) for k in "ab" for n in range(30)], "j string, _start_time double, _end_time double, n long")
    pairs = lambda df: sorted(map(str, map(tuple, df.collect())))
    on = [(F.col("k"), F.col("j"))]
    got = iv.temporal_join(left, right, on, eager=True, most=20)
    assert pairs(got) == pairs(iv.temporal_join(left, right, on)) != []
    sizes = [r.c for r in got.groupBy(F.spark_partition_id()).agg(F.count_distinct("i").alias("c")).collect()]
    assert max(sizes) < 400 and len(sizes) > 8, sizes


def test_sums_over_overlaps_make_no_pairs(spark):
    """Counts and sums over all pairs that overlap, with ties, rows without length, nulls and infinite values, against brute force."""
    from chronoplane.plans.session import Session

    rnd = random.Random(3)
    rows = [(float(s), float(s + rnd.choice([0, 0, 1, 3, 40])), rnd.choice("xyz"), rnd.choice([None, 1.5, -2.25, 1e6])) for s in (rnd.randrange(60) for _ in range(90))]
    rows += [(5.0, 9.0, "inf", float("inf")), (7.0, 30.0, None, 2.0), (8.0, 8.0, "nan", float("nan"))]
    df = spark.createDataFrame([(s, e, e - s, k, v) for s, e, k, v in rows], "_start_time double, _end_time double, _duration double, k string, v double")
    s = Session(spark)
    s.register("t", df, ("k",))
    text = 'FROM t AS a TEMPORAL JOIN t AS b WHERE a.k !~ "none" GROUP BY a.k, b.k SELECT a.k AS p, b.k AS q, COUNT(a.v) AS n, SUM(2 * (a.v - b.v) + 1) AS d, SUM((_end_time - _start_time) / 4 + b.v) AS l;'
    out = s.sql(text)
    assert "l_child" in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, f, p, x in rows:
        for j, g, r, y in rows:
            if p is not None and i < g and j < f:
                n, d, length = want.get((p, r), (0, [], []))
                both = [] if x is None or y is None else [2 * (x - y) + 1]
                want[p, r] = n + 1, d + both, length + ([] if y is None else [(min(f, g) - max(i, j)) / 4 + y])
    got = {(r.p, r.q): (r.n, r.d, r.l) for r in out.collect()}
    assert got.keys() == want.keys()
    for key, (n, d, length) in want.items():
        assert got[key][0] == n
        for mine, theirs in zip(got[key][1:], (d, length)):
            assert mine is None if not theirs else mine == pytest.approx(sum(theirs), rel=1e-9, abs=1e-6, nan_ok=True), (key, mine, theirs)
