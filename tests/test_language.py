import math

import pytest

from chronoplane.plans.language import Binary, Call, Literal, Name, ParseError, Unary, parse
from chronoplane.plans.session import Session
from chronoplane.schema import PlanError


def expr(text):
    return parse(f"FROM t SELECT {text};")[0].select.terms[0].expr


def test_precedence():
    assert expr("1 + 2 * x") == Binary("+", Literal(1.0), Binary("*", Literal(2.0), Name("x")))
    assert expr("a-1") == Binary("-", Name("a"), Literal(1.0))
    assert expr("NOT a > 1 and b") == Binary("AND", Unary("NOT", Binary(">", Name("a"), Literal(1.0))), Name("b"))
    assert expr("a || b && c") == Binary("OR", Name("a"), Binary("AND", Name("b"), Name("c")))
    assert expr("-2e3") == Literal(-2000.0) and expr('f(x, "s", TRUE)') == Call("F", (Name("x"), Literal("s"), Literal(True)))
    assert expr("m.path !~ \"a*\"") == Binary("!~", Name("m.path"), Literal("a*"))


def test_statements():
    kinds = [s.kind for s in parse('create table a = from b select *; DELETE TABLE a; CACHE TABLE a; DROP TABLE a FROM CACHE; EXPLAIN FROM a SELECT x; STATISTICS FROM a SELECT x; EXPORT "f" = FROM a SELECT x; // note\nFROM a SELECT x;')]
    assert kinds == ["create", "delete", "cache", "uncache", "explain", "statistics", "export", "select"]
    s = parse("FROM (FROM a SELECT *) AS p TEMPORAL JOIN b AS q WHERE x GROUP BY p.k, v SELECT *, x AS y ORDER BY y DESCENDING, z LIMIT 3;")[0].select
    assert s.group_by == ("p.k", "v") and s.order_by == (("y", False), ("z", True)) and s.limit == 3 and [x.alias for x in s.sources] == ["p", "q"]


@pytest.mark.parametrize("text", ["", "FROM a", "SELECT x;", "FROM a SELECT x", "FROM a SELECT x LIMIT 1.5;", "FROM a SELECT x $;", "FROM a WHERE SELECT x;"])
def test_bad_text(text):
    with pytest.raises(ParseError):
        parse(text)


LEFT = [("a", "c", [(0, 1, True, "1/1"), (1, 2, True, "1/2"), (2, 3, False, "1/3"), (3, 4, False, "1/4"), (4, 5, True, "1/5")]), ("b", "d", [(0, 1.5, True, "2/1"), (1.5, 3, False, "2/2"), (3, 4.5, False, "2/3"), (4.5, 6, True, "2/4")])]
RIGHT = [("a", "c", [(0, 1, True, "1/1"), (1, 3, True, "1/2"), (3, 5, False, "1/3"), (5, 6, False, "1/4")]), ("a", "d", [(0, 10, True, "2/1")]), ("b", "d", [(0, 1, True, "3/1"), (1, 2.5, False, "3/2"), (4.5, 5, False, "3/3"), (5, 5.5, True, "3/4")])]


@pytest.fixture()
def session(spark, tmp_path):
    s = Session(spark, output=str(tmp_path))
    schema = "_start_time double, _end_time double, _duration double, k1 string, k2 string, flag boolean, v string"
    for name, data in (("l", LEFT), ("r", RIGHT)):
        rows = [(float(a), float(b), float(b - a), k1, k2, f, v) for k1, k2, own in data for a, b, f, v in own]
        s.register(name, spark.createDataFrame(rows, schema), ("k1", "k2"))
    return s


@pytest.mark.parametrize("where,rows,total", [("", 29, 28.5), ("WHERE a.k1 = b.k1", 15, 13.5), ("WHERE b.k2 = a.k2", 14, 14.5), ("WHERE a.k1 = b.k1 AND a.k2 = b.k2", 10, 8.5)])
def test_temporal_join(session, where, rows, total):
    got = session.sql(f"FROM l AS a TEMPORAL JOIN r AS b {where} SELECT _duration, a.v, b.v;").collect()
    assert len(got) == rows and sum(r[0] for r in got) == total


def test_temporal_join_rows(session):
    got = session.sql("FROM l AS a TEMPORAL JOIN r AS b WHERE a.k1 = b.k1 AND a.k2 = b.k2 SELECT _start_time, _end_time, a.v AS x, b.v AS y ORDER BY _start_time, x, y;").collect()
    want = [(0, 1, "1/1", "1/1"), (0, 1, "2/1", "3/1"), (1, 1.5, "2/1", "3/2"), (1, 2, "1/2", "1/2"), (1.5, 2.5, "2/2", "3/2"), (2, 3, "1/3", "1/2"), (3, 4, "1/4", "1/3"), (4, 5, "1/5", "1/3"), (4.5, 5, "2/4", "3/3"), (5, 5.5, "2/4", "3/4")]
    assert sorted(map(tuple, got)) == sorted(want)


def test_merging_follows_series(session):
    assert [tuple(r) for r in session.sql("FROM l SELECT _start_time, _end_time, flag ORDER BY _start_time, _end_time;").collect()] == [(0, 1.5, True), (0, 2, True), (1.5, 4.5, False), (2, 4, False), (4, 5, True), (4.5, 6, True)]
    assert session.sql("FROM l SELECT _start_time, _end_time, v, flag;").count() == 9
    assert session.sql("FROM l SELECT _start_time, _end_time, flag, _duration;").filter("_duration = 1").count() == 3


def test_views_cache_and_results(session):
    assert session.execute("CREATE TABLE v = FROM l WHERE flag SELECT *;") == "created v"
    assert "exists" in session.execute("CREATE TABLE l = FROM l SELECT *;") and "built in" in session.execute("DELETE TABLE l;")
    assert session.execute("CACHE TABLE v;") == "cached v: 2 time series, 5 rows" and "already" in session.execute("CACHE TABLE v;")
    assert session.query("FROM v SELECT COUNT(v) AS n;").to_map() == {"ROW": [1], "TS": [1], "n": [5.0]}
    assert "dropped" in session.execute("DROP TABLE v FROM CACHE;") and "not cached" in session.execute("DROP TABLE v FROM CACHE;")
    assert session.execute("CACHE TABLE l; DROP TABLE l FROM CACHE;") and session.sql("FROM l SELECT v;").count() == 9
    assert session.execute("DELETE TABLE v;") == "deleted v" and "unknown table" in session.execute("FROM v SELECT *;")
    printed = session.query("FROM l SELECT v, flag ORDER BY v;").text(most=4)
    assert printed.splitlines()[0].split() == ["ROW", "TS", "v", "flag"] and "..." in printed and printed.endswith("9 rows")


def test_export_explain_statistics(session, tmp_path):
    assert session.execute('EXPORT "out/x.tsv" = FROM l SELECT v, flag, _duration ORDER BY v LIMIT 2;').startswith("exported 2 rows")
    assert (tmp_path / "out/x.tsv").read_text() == 'v\tflag\t_duration\n"1/1"\tTRUE\t1.0\n"1/2"\tTRUE\t1.0\n'
    explained = session.execute("EXPLAIN FROM l WHERE NOT flag SELECT v;")
    assert "Project v AS v" in explained and "Filter NOT (flag)" in explained and "Physical plan" in explained
    counted = session.execute("STATISTICS FROM l WHERE flag SELECT v LIMIT 3;")
    assert "Filter flag: 5 rows, about 2 time series" in counted and "Limit 3: 3 rows" in counted


@pytest.mark.parametrize(
    "text,part",
    [
        ("FROM l WHERE v SELECT v;", "WHERE needs"), ("FROM l SELECT v + 1;", "NUMERIC is needed"), ("FROM l SELECT w;", "unknown column"), ("FROM l SELECT v, v;", "duplicate"), ("FROM l SELECT NOPE(v);", "unknown function"),
        ("FROM l TEMPORAL JOIN r SELECT v;", "alias"), ("FROM l AS a TEMPORAL JOIN r AS a SELECT v;", "differ"), ("FROM l SELECT SUM(COUNT(v));", "inside another"), ("FROM l GROUP BY _start_time SELECT COUNT(v) AS n;", "selects _start_time"),
        ("FROM l SELECT v ORDER BY z;", "ORDER BY"), ("FROM l GROUP BY z SELECT z;", "GROUP BY"), ("FROM l SELECT v = 1;", "compares"), ("FROM (FROM l SELECT v) SELECT COUNT(v);", "needs _start_time"), ("FROM l WHERE COUNT(v) > 1 SELECT v;", "cannot stand"),
    ],
)
def test_errors(session, text, part):
    assert part in session.execute(text)


def test_numbers(session):
    row = session.sql("FROM l SELECT 1 / 0 AS a, -1 / 0 AS b, 0 / 0 AS c, 0 / 0 = 0 / 0 AS d, MIN_OF(0 / 0, 1) AS e LIMIT 1;").first()
    assert row.a == math.inf and row.b == -math.inf and math.isnan(row.c) and row.d is False and math.isnan(row.e)
    with pytest.raises(PlanError):
        session.query("FROM l SELECT v; FROM l SELECT v;")
