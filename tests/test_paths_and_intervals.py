import itertools
import random

from pyspark.sql import functions as F

from chronoplane.functions import paths
from chronoplane.model.paths import PathError, match_tree, matches_tree
from chronoplane.operators import intervals as iv


def prefix(p, n):
    lead = p[0] if p[:1] in ("/", ":") and p else ""
    seps = [i for i, c in enumerate(p) if c in "/:" and i > 0]
    if n == 0:
        return lead
    if n > 0:
        return p[: seps[n - 1]] if len(seps) >= n else p
    seps = [i for i in seps if i < len(p) - 1]
    return p[: seps[n]] if len(seps) >= -n else lead


def suffix(p, n):
    if n == 0:
        return ""
    if n > 0:
        seps = [i for i, c in enumerate(p) if c in "/:" and i < len(p) - 1]
        return p[seps[-n] + 1 :] if len(seps) >= n else p
    seps = [i for i, c in enumerate(p) if c in "/:" and i > 0]
    return p[seps[-n - 1] + 1 :] if len(seps) >= -n else ""


def test_path_parts(spark):
    texts = ["".join(x) for n in range(6) for x in itertools.product("a/:", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    for n in (-3, -2, -1, 0, 1, 2, 3):
        for r in df.select("p", paths.path_prefix(F.col("p"), n).alias("x"), paths.path_suffix(F.col("p"), n).alias("y")).collect():
            assert r.x == prefix(r.p, n), (r.p, n, r.x, prefix(r.p, n))
            assert r.y == suffix(r.p, n), (r.p, n, r.y, suffix(r.p, n))
    varying = df.crossJoin(spark.createDataFrame([(float(n),) for n in range(-7, 8)] + [(None,)], "n double"))
    for r in varying.select("p", "n", paths.path_prefix(F.col("p"), F.col("n")).alias("x"), paths.path_suffix(F.col("p"), F.col("n")).alias("y")).collect():
        assert (r.x, r.y) == ((None, None) if r.n is None else (prefix(r.p, int(r.n)), suffix(r.p, int(r.n)))), r


def test_deep_paths(spark):
    deep = "/" + "/".join(f"c{i}" for i in range(60))
    df = spark.createDataFrame([(deep, float(n)) for n in range(-70, 71)], "p string, n double")
    for r in df.select("p", "n", paths.path_prefix(F.col("p"), F.col("n")).alias("x"), paths.path_suffix(F.col("p"), F.col("n")).alias("y")).collect():
        assert (r.x, r.y) == (prefix(deep, int(r.n)), suffix(deep, int(r.n)))


def test_match_either_side(spark):
    df = spark.createDataFrame([("/a/b", "/a/*"), ("/**", "/a/b"), ("/a", "/a"), ("/a", "/b"), ("/x.y", "/x.*")], "a string, b string")
    assert [r[0] for r in df.select(paths.matches_either(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, True]


def test_tree_paths():
    tree = ["/", "/j[id=1]", "/j[id=1]/s[id=2]", "/j[id=1]/s[id=2]/t", "/k"]
    assert match_tree(tree, "/j/s") == ["/j[id=1]/s[id=2]"] and match_tree(tree, "/j[id=1]/*") == ["/j[id=1]/s[id=2]"]
    assert match_tree(tree, "/j/**") == tree[2:4] and match_tree(tree, "../k", "/j[id=1]") == ["/k"] and match_tree(tree, "/") == ["/"]
    assert match_tree(tree, "/j/*/..") == ["/j[id=1]"] and match_tree(tree, "/j/./s/../..") == ["/"] and match_tree(tree, "/*/..") == ["/"]
    for bad in ("/nope", "/j[id", "/***", "/j**s", "/k/*/..", "/nope/..", "/.."):
        try:
            match_tree(tree, bad)
        except PathError:
            continue
        raise AssertionError(bad)


def test_tree_patterns_without_a_tree(spark):
    df = spark.createDataFrame([("/",), ("/j[id=1]",), ("/j[id=1]/s",), ("/k",)], "p string")
    for expression, wanted in (("/", ["/"]), ("/j", ["/j[id=1]"]), ("/**", ["/j[id=1]", "/j[id=1]/s", "/k"]), ("/./j/*", ["/j[id=1]/s"])):
        assert [r.p for r in df.filter(matches_tree(F.col("p"), expression)).collect()] == wanted
    for bad in ("/j/..", "j", "/a**b"):
        try:
            matches_tree(F.col("p"), bad)
        except PathError:
            continue
        raise AssertionError(bad)


def random_series(rnd, n, keys):
    rows = []
    for k in range(keys):
        at = rnd.randrange(4)
        for _ in range(n):
            end = at + rnd.randrange(1, 4)
            rows.append((float(at), float(end), float(end - at), f"k{k % 3}", f"s{k}", rnd.choice("xy"), float(rnd.randrange(9))))
            at = end + (rnd.random() < 0.3)
    return rows


SCHEMA = "_start_time double, _end_time double, _duration double, k string, series string, state string, v double"


def slices(rows):
    points = sorted({t for r in rows for t in r[:2]})
    return list(zip(points, points[1:]))


def test_temporal_aggregate_and_joins_against_models(spark):
    rnd = random.Random(3)
    rows = random_series(rnd, 12, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for keys in (["k"], []):
        want = []
        for key in sorted({r[3] for r in rows}) if keys else [None]:
            own = [r for r in rows if key is None or r[3] == key]
            last = None
            for s, e in slices(own):
                active = [r for r in own if r[0] <= s and r[1] >= e]
                if not active:
                    last = None
                    continue
                value = (float(sum(r[6] for r in active)), len(active))
                if last is not None and last[1] == s and last[2] == value:
                    last[1] = e
                else:
                    last = [s, e, value, key]
                    want.append(last)
        got = iv.temporal_aggregate(df, keys, {"v": F.sum("v"), "n": F.count("*")}).collect()
        assert sorted((r[0], r[1], (r.v, r.n), r.k if keys else None) for r in got) == sorted(tuple(w) for w in want)
        swept = iv.temporal_counts(df, keys, {"n": None, "x": F.col("state") == "x"})
        plain = iv.temporal_aggregate(df, keys, {"n": F.count("*").cast("double"), "x": F.count_if(F.col("state") == "x").cast("double")})
        assert sorted(map(tuple, swept.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    other = df.select("_start_time", "_end_time", "_duration", F.col("k").alias("k2"), F.col("v").alias("w"))
    brute = sorted((max(a[0], b[0]), min(a[1], b[1]), a[6], b[6]) for a in rows for b in rows if a[0] < b[1] and b[0] < a[1])
    for width in (None, 0.7, 100.0):
        got = iv.temporal_join(df.drop("series", "state"), other, width=width)
        assert sorted((r[0], r[1], r.v, r.w) for r in got.collect()) == brute
    plan = iv.temporal_join(df.drop("series", "state"), other)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_sums_are_exact(spark):
    rows = [(0.0, 10.0, "a", 0.1), (1.0, 9.0, "a", 1e15), (2.0, 3.0, "a", 1e-9), (4.0, 5.0, "a", None), (20.0, 30.0, "a", -0.1), (0.0, 4.0, "b", float("inf")), (1.0, 2.0, "b", float("-inf")), (2.0, 3.0, "b", float("nan")), (3.0, 6.0, "b", 2.0), (7.0, 7.0, "b", 5.0)]
    got = {}
    for r in iv.step_sum(spark.createDataFrame(rows, "_start_time double, _end_time double, k string, v double"), "v", ["k"]).collect():
        got[r.k, r._start_time, r._end_time] = r.v
    def total(k, s, e):
        return sum(x for a, z, key, x in rows if key == k and a <= s and z >= e and x is not None)
    assert len(got) == 9 + 5
    for (k, s, e), v in got.items():
        want = total(k, s, e)
        assert v == want or abs(v - want) <= 1e-9 * abs(want) or (v != v and want != want), (k, s, e, v, want)
    assert abs(got["a", 9.0, 10.0] - 0.1) < 1e-9 and got["a", 10.0, 20.0] == 0.0


def test_merged_steps(spark):
    rnd = random.Random(9)
    series = []
    for _ in range(3):
        at, rows = rnd.randrange(5), []
        for _ in range(40):
            end = at + rnd.randrange(1, 60)
            rows.append((rnd.choice("k"), at, end, rnd.randrange(5)))
            at = end + rnd.choice([0, 0, 7])
        series.append(rows)
    tables = [(spark.createDataFrame(rows, f"k string, s long, e long, v{i} int"), [f"v{i}"]) for i, rows in enumerate(series)]
    got = iv.merged_steps(tables, ["k"], "s", "e").collect()
    value = lambda rows, t: next((v for _, s, e, v in rows if s <= t < e), None)
    covered = set()
    for r in got:
        assert r.s < r.e
        for t in range(r.s, r.e):
            assert (r.v0, r.v1, r.v2) == tuple(value(rows, t) for rows in series) and t not in covered
            covered.add(t)
    assert covered == {t for rows in series for _, s, e, _ in rows for t in range(s, e)}


def test_coalesce_and_steps(spark):
    rnd = random.Random(4)
    rows = random_series(rnd, 30, 4)
    df = spark.createDataFrame(rows, SCHEMA).select("_start_time", "_end_time", "_duration", "series", "state").repartition(5)
    want = []
    for s in sorted({r[4] for r in rows}):
        for r in sorted(r for r in rows if r[4] == s):
            if want and want[-1][2:] == [s, r[5]] and want[-1][1] == r[0]:
                want[-1][1] = r[1]
            else:
                want.append([r[0], r[1], s, r[5]])
    got = iv.coalesce_intervals(df, ["series"], ["state"]).collect()
    assert sorted((r[0], r[1], r[3], r[4]) for r in got) == sorted(map(tuple, want)) and all(r[2] == r[1] - r[0] for r in got)
    empty = df.limit(0)
    for out in (iv.coalesce_intervals(empty, ["series"], ["state"]), iv.time_slices(empty), iv.active_count(empty), iv.temporal_counts(empty, [], {"n": None}), iv.temporal_join(empty, empty.withColumnsRenamed({"series": "a", "state": "b"})), iv.zoom(empty, 0, 1)):
        assert out.count() == 0
