"""Interval operators as DataFrame plans: coalescing, temporal join, slicing, temporal aggregation, zoom, steps.

Rows are valid over [start, end). Nothing here needs Python workers; all joins are equi-joins with residual
predicates, so Spark can shuffle, sort, spill and split them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DURATION, END, START, PlanError, q, require_columns


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(q(n)) for n in names]


def coalesce_intervals(df: DataFrame, series: Sequence[str], values: Sequence[str], start: str = START, end: str = END) -> DataFrame:
    """Merge rows of a series where one ends exactly as the next starts and all ``values`` are equal.

    Columns other than series, values, start and end keep the first row's value, but ``_duration`` is recomputed.
    Rows of a series must not overlap. The window is partitioned by series and values together: of two rows that
    touch and are equal, none of their series lies between, so splitting by value gives the same runs and spreads a
    long series over as many tasks as it has values.
    """
    require_columns(df, [*series, *values, start, end])
    # A row of no length at a border belongs to the run that ends there, so order by end as well.
    order = Window.partitionBy(*_cols([*series, *values])).orderBy(*_cols([start, end]))
    opens = F.when(F.lag(q(end)).over(order) == F.col(q(start)), F.lit(0)).otherwise(F.lit(1))
    runs = df.withColumn("__opens", opens).withColumn("__run", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in df.columns if c not in {*series, *values, start, end, DURATION}]
    first = F.struct(*_cols([start, end]))
    merged = runs.groupBy(*_cols([*series, *values]), F.col("__run")).agg(
        F.min(q(start)).alias("__s"), F.max(q(end)).alias("__e"), *(F.min_by(F.col(q(c)), first).alias(c) for c in rest)
    )
    shape = {start: F.col("__s"), end: F.col("__e"), DURATION: F.col("__e") - F.col("__s")}
    return merged.select(*(shape.get(c, F.col(q(c))).alias(c) for c in df.columns))


def _only_value(df: DataFrame, eager: bool) -> Column:
    """The one value of a table: a scalar subquery, or a literal from a job that runs now."""
    return F.lit(df.first()[0]) if eager else df.scalar()


def bucket_width(left: DataFrame, right: DataFrame, eager: bool = False) -> Column:
    """Twice the larger mean duration, but so wide that the longest interval covers at most 512 buckets.

    By default a scalar subquery, which runs with the query that uses it and not while that is planned. ``eager`` suits
    written tables: reading them once more is cheap, and plans without subqueries are analysed faster.
    """
    d = (F.col(END) - F.col(START)).cast("double").alias("d")
    both = left.select(F.lit(0).alias("side"), d).unionAll(right.select(F.lit(1).alias("side"), d))
    mean = lambda side: 2 * F.avg(F.when(F.col("side") == side, F.col("d")))
    return _only_value(both.agg(F.coalesce(F.nullif(F.greatest(mean(0), mean(1), F.max("d") / F.lit(512.0)), F.lit(0.0)), F.lit(1.0)).alias("width")), eager)


def dealt(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], most: int, left_order: Sequence[str], right_order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join, with one more key to join on: __lp of the left side, __rp of the right one.

    Keys with more than ``most`` left rows are split into pieces with about as many, each of which meets all right rows of
    its key. Left rows that are equal in the order given stay together, but if they are very many, an eighth of the
    key's pieces holds them. Pieces are dealt to so many tasks that one has about twice ``most`` left rows, in order.
    """
    sizes = left.groupBy(*_cols(left_keys)).agg(F.count(F.lit(1)).alias("__n"))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum("__n")).first()[0] or 0) // (2 * most)))
    pieces = F.ceil(F.col("__n") / F.lit(most)).alias("__pieces")
    # One row for ``most`` left rows at most.
    large = F.broadcast(sizes.filter(F.col("__n") > most).select(*(F.col(q(k)).alias(f"__large{i}") for i, k in enumerate(left_keys)), pieces))
    out = []
    for df, keys, name, order in ((left, left_keys, "__lp", left_order), (right, right_keys, "__rp", right_order)):
        same = reduce(lambda x, y: x & y, [F.col(q(k)) == F.col(f"__large{i}") for i, k in enumerate(keys)])
        of = F.coalesce("__pieces", F.lit(1))
        if name == "__lp":
            apart = F.pmod(F.xxhash64(*_cols(df.columns)), F.ceil(of / F.lit(8)))
            piece = F.pmod(F.pmod(F.xxhash64(*_cols(order)), of) + apart, of)
        else:
            piece = F.explode(F.sequence(F.lit(0).cast("long"), of - 1))
        df = df.join(large, same, "left").select(*_cols(df.columns), piece.alias(name))
        out.append(df.repartition(tasks, *_cols([*keys, name])).sortWithinPartitions(*_cols([*keys, name, *order])))
    return out[0], out[1]


def temporal_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[Column, Column]] = (), width: float | Column | None = None, eager: bool = False, most: int | None = None) -> DataFrame:
    """Pairs of rows that overlap and agree ``on`` pairs of expressions; valid over the intersection.

    Output: the reserved columns, then the other columns of left and right, whose names must not clash. Intervals
    that only touch do not join. Both sides are dealt into time buckets of ``width`` seconds (by default chosen from
    their durations), which are part of the join key, so rows that share a key, or all rows where there is none, are
    not all paired; a pair counts in the bucket where the later of the two starts. With ``most``, which runs a job, tasks
    have about twice as many rows of the left side, by key, bucket and time.
    """
    require_columns(left, (START, END))
    require_columns(right, (START, END))
    names = [[c for c in side.columns if c not in (START, END, DURATION)] for side in (left, right)]
    if set(names[0]) & set(names[1]):
        raise PlanError(f"columns on both sides of a temporal join: {', '.join(sorted(set(names[0]) & set(names[1])))}")
    width = bucket_width(left, right, eager) if width is None else F.lit(width) if isinstance(width, (int, float)) else width

    def side(df: DataFrame, tag: str, own: list[str], keys: list[Column]) -> DataFrame:
        out = df.select(F.col(START).alias(f"__{tag}s"), F.col(END).alias(f"__{tag}e"), *(k.alias(f"__{tag}{i}") for i, k in enumerate(keys)), *_cols(own))
        bucket = lambda t: F.floor(F.col(f"__{tag}{t}") / width)
        return out.withColumn(f"__{tag}b", F.explode(F.sequence(bucket("s"), F.greatest(bucket("s"), bucket("e")))))

    a = side(left, "l", names[0], [k for k, _ in on])
    b = side(right, "r", names[1], [k for _, k in on])
    same = (F.col("__ls") < F.col("__re")) & (F.col("__rs") < F.col("__le"))
    for i in range(len(on)):
        same &= F.col(f"__l{i}") == F.col(f"__r{i}")
    same &= (F.col("__lb") == F.col("__rb")) & (F.col("__lb") == F.floor(F.greatest("__ls", "__rs") / width))
    if most is not None:
        keys = [[f"__{tag}{i}" for i in [*range(len(on)), "b"]] for tag in "lr"]
        a, b = dealt(a, b, *keys, most, ["__ls", "__le"], ["__rs", "__re"])
        same &= F.col("__lp") == F.col("__rp")
    s, e = F.greatest("__ls", "__rs"), F.least("__le", "__re")
    return a.join(b, same).select(s.alias(START), e.alias(END), (e - s).alias(DURATION), *_cols(names[0] + names[1]))


RADIX, LEVELS = 8, 11  # of the tree over change points in ``overlap_sums``


def _split(value: Column, unit: Column) -> tuple[Column, Column]:
    """A number below ``unit`` as two whole numbers: 30 bits, and the 30 bits below."""
    scaled = value / unit * F.lit(2.0**30)
    high = F.floor(scaled)
    return high.cast("long"), F.floor((scaled - high) * F.lit(2.0**30)).cast("long")


def _unit(value: Column) -> Column:
    """The power of two above the finite values of a column."""
    size = F.abs(value.cast("double"))
    top = F.coalesce(F.nullif(F.max(F.when(size < float("inf"), size)), F.lit(0.0)), F.lit(1.0))
    return F.pow(F.lit(2.0), F.floor(F.log2(top)) + 1)


def overlap_sums(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], sums: dict[str, tuple[Column | None, Column | None, float]]) -> DataFrame:
    """(left_keys, right_keys, __n, sums) over the pairs of ``temporal_join`` without equal columns, without making them.

    A sum (f, g, c) is that of f + g + c * (the length of the intersection) over the pairs in which f, of the left row,
    and g, of the right row, are not null; null where there is none. Two rows overlap where the one is active when the
    other starts. So with +f at a row's start and -f at its end, what counts is the sum of products over all pairs of a
    change point and a later start; lengths likewise. Change points are numbered and are the leaves of a tree: a point
    and a later one are below two children of one node, and there sums by key meet, not rows. What opened and closed
    below a child has gone from its sum, and keys without any are left out, so many keys are not all paired. All sums are
    of whole numbers, with 60 bits below the largest value. Rows that end before they start are in no pair.
    """
    sides = []
    both = left.select(START, END).unionAll(right.select(START, END)).filter(F.col(START) <= F.col(END))
    # One row with the units of all sums, which rows and results are joined with.
    units = both.agg(_unit(F.greatest(F.abs(F.col(START).cast("double")), F.abs(F.col(END).cast("double")))).alias("u_t"))
    for k, df in enumerate((left, right)):
        values = [_unit(v[k]).alias(f"u_{k}{i}") for i, v in enumerate(sums.values()) if v[k] is not None]
        units = units.crossJoin(df.agg(*values)) if values else units
    units = F.broadcast(units)
    whole = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    for k, (df, keys) in enumerate(((left, left_keys), (right, right_keys))):
        weights = {"one": F.lit(1).cast("long")}
        for i, value in enumerate(sums.values()):
            if value[k] is not None:
                v = value[k].cast("double")
                plain = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
                high, low = _split(F.when(plain, v).otherwise(F.lit(0.0)), F.col(f"u_{k}{i}"))
                flags = {"some": whole(v.isNotNull()), "nan": whole(F.isnan(v)), "up": whole(v == float("inf")), "down": whole(v == -float("inf"))}
                weights |= {f"{n}{i}": c for n, c in (flags | {"high": high, "low": low}).items()}
        rows = df.filter(F.col(START) <= F.col(END)).crossJoin(units)
        rows = rows.select("u_t", F.struct(*_cols(keys)).alias("k") if keys else F.lit(0).alias("k"), F.col(START).alias("a"), F.col(END).alias("z"), *(c.alias(n) for n, c in weights.items()))
        none = F.lit(0).cast("long")
        held = F.col("a") == F.col("z")  # starts ``s`` and ends ``e`` of rows with a length, ``o`` of those without
        marks = [[F.when(held, none).otherwise(F.col(n)).alias(f"s_{n}") for n in weights] + [none.alias(f"e_{n}") for n in weights] + [F.when(held, F.col(n)).otherwise(none).alias(f"o_{n}") for n in weights],
                 [none.alias(f"s_{n}") for n in weights] + [F.when(held, none).otherwise(F.col(n)).alias(f"e_{n}") for n in weights] + [none.alias(f"o_{n}") for n in weights]]
        names = [f"{m}_{n}" for m in "seo" for n in weights]
        points = rows.select("u_t", "k", F.explode(F.array(F.struct(F.col("a").alias("t"), *marks[0]), F.struct(F.col("z").alias("t"), *marks[1]))).alias("p")).select("u_t", "k", "p.*")
        points = points.groupBy("k", "t").agg(F.first("u_t").alias("u_t"), *(F.sum(n).alias(n) for n in names))
        lengths = [n for n in weights if n == "one" or n.startswith("some")]
        for n in lengths:  # for lengths: the signed times
            for m, part in zip("hl", _split(F.col("t").cast("double"), F.col("u_t"))):
                points = points.withColumn(f"{m}_{n}", (F.col(f"s_{n}") - F.col(f"e_{n}")) * part)
        sides.append((points, [*names, *(f"{m}_{n}" for m in "hl" for n in lengths)], list(weights)))
    numbers = change_points(both).select(F.col("__t").alias("t"), (F.col("__i") - 1).alias("i"))
    nodes = []
    for k, (points, names, weights) in enumerate(sides):
        tag = "lr"[k]
        leaves = points.join(numbers, "t").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        # Level 0 holds the points themselves; above it, a child of a node.
        size = F.pow(F.lit(float(RADIX)), F.greatest(F.col("level") - 1, F.lit(0))).cast("long")
        child = F.floor(F.col("i") / size)
        leaves = leaves.select("k", "level", F.when(F.col("level") == 0, F.col("i")).otherwise(F.floor(child / RADIX)).alias("node"), F.when(F.col("level") == 0, F.lit(0)).otherwise(F.pmod(child, F.lit(RADIX))).alias("child"), *names)
        # Sums have their last names at once: Spark infers conditions for each way to name what a filter reads.
        keyed = leaves.withColumnsRenamed({"k": f"{tag}_k", "child": f"{tag}_child"})
        added = keyed.groupBy("level", "node", f"{tag}_child", f"{tag}_k").agg(*(F.sum(n).alias(f"{tag}_{n}") for n in names))
        nets = [F.col(f"{tag}_s_{n}") - F.col(f"{tag}_e_{n}") for n in weights]
        nodes.append(added.withColumn(f"{tag}_open", F.exists(F.array(*nets), lambda x: x != 0)))
    a, b = nodes
    at, less = ["level", "node"], F.col("l_child") < F.col("r_child")
    equal = F.col("level") == 0
    first = a.filter("l_open or level = 0").join(b, at).filter(equal | less | (F.col("l_child") > F.col("r_child")) & F.col("r_open"))
    second = a.filter("not l_open and level > 0").join(b.filter("r_open and level > 0"), at).filter("l_child <> r_child")
    met = first.unionByName(second)
    exact = lambda c: c.cast("decimal(19,0)")

    def product(x: str, y: str) -> Column:
        of = lambda tag, m, n: F.col(f"{tag}_{m}_{n}")
        xs, xe, xo, ys, ye, yo = (of(t, m, n) for t, n in (("l", x), ("r", y)) for m in "seo")
        here = exact(xs - xe) * exact(ys) - exact(xe) * exact(yo) - exact(ye) * exact(xs + xo)
        return F.sum(F.when(equal, here).when(less, exact(xs - xe) * exact(ys + yo)).otherwise(exact(ys - ye) * exact(xs + xo)))

    def length(x: str, y: str, m: str) -> Column:
        net = lambda tag, n: exact(F.col(f"{tag}_s_{n}") - F.col(f"{tag}_e_{n}"))
        later = exact(F.col(f"l_{m}_{x}")) * net("r", y) - net("l", x) * exact(F.col(f"r_{m}_{y}"))
        return F.sum(F.when(~equal & less, later).otherwise(F.lit(0).cast("decimal(38,0)")))

    made, out = {"n": product("one", "one")}, {}
    for i, (name, (f, g, c)) in enumerate(sums.items()):
        x, y = "one" if f is None else f"some{i}", "one" if g is None else f"some{i}"
        made[f"some{i}"] = product(x, y)
        terms, flags = [], {m: [] for m in ("nan", "up", "down")}
        for k, there in ((0, f), (1, g)):
            if there is not None:
                pair = (lambda m, k=k: (f"{m}{i}", y) if k == 0 else (x, f"{m}{i}"))  # noqa: B023
                made |= {f"{m}{i}_{k}": product(*pair(m)) for m in ("high", "low", *flags)}
                terms.append((f"high{i}_{k}", f"low{i}_{k}", F.col(f"u_{k}{i}")))
                for m in flags:
                    flags[m].append(F.col(f"{m}{i}_{k}"))
        if c:
            made |= {f"{m}{i}_t": length(x, y, m) for m in "hl"}
            terms.append((f"h{i}_t", f"l{i}_t", F.col("u_t") * F.lit(float(c))))
        total = reduce(lambda p, q: p + q, [(F.col(h).cast("double") + F.col(low).cast("double") * F.lit(2.0**-30)) * F.lit(2.0**-30) * unit for h, low, unit in terms], F.lit(0.0))
        nan, up, down = (reduce(lambda p, q: p | q, [v > 0 for v in flags[m]], F.lit(False)) for m in ("nan", "up", "down"))
        total = F.when(nan | up & down, F.lit(float("nan"))).when(up, F.lit(float("inf"))).when(down, F.lit(-float("inf"))).otherwise(total)
        out[name] = F.when(F.col(f"some{i}") > 0, total)
    found = met.groupBy("l_k", "r_k").agg(*(v.alias(n) for n, v in made.items())).filter("n > 0").crossJoin(units)
    keys = [F.col(f"{t}_k.{q(c)}").alias(c) for t, names in (("l", left_keys), ("r", right_keys)) for c in names]
    return found.select(*keys, F.col("n").cast("long").alias("__n"), *(v.alias(n) for n, v in out.items()))


def change_points(df: DataFrame, keys: Sequence[str] = (), start: str = START, end: str = END, width: Column | None = None) -> DataFrame:
    """(keys, __t, __i, __next): the distinct change points of each key, numbered in order, and the one that follows.

    Numbering is done per key and time bucket and the buckets' counts are added up, so that neither one key with very
    many change points nor no key at all makes one task; the windows over buckets see at most BUCKETS + 1 rows a key.
    """
    width = point_width(df, start, end) if width is None else width
    times = df.select(*_cols(keys), F.explode(F.array(F.col(q(start)), F.col(q(end)))).alias("__t")).distinct()
    inside = Window.partitionBy(*_cols(keys), F.col("__b")).orderBy("__t")
    times = times.withColumn("__b", F.floor(F.col("__t") / width))
    numbered = times.withColumns({"__in": F.row_number().over(inside), "__next": F.lead("__t").over(inside)})
    buckets = times.groupBy(*_cols(keys), "__b").agg(F.count("*").alias("__n"), F.min("__t").alias("__low"))
    order = Window.partitionBy(*_cols(keys)).orderBy("__b")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select(*_cols(keys), "__b", before.alias("__before"), F.lead("__low").over(order).alias("__after"))
    joined = numbered.alias("n").join(buckets.alias("c"), _same("n", "c", [*keys, "__b"])).select("n.*", "c.__before", "c.__after")
    return joined.select(*_cols(keys), "__t", (F.col("__before") + F.col("__in")).alias("__i"), F.coalesce("__next", "__after").alias("__next"))


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(f"{a}.{q(n)}").eqNullSafe(F.col(f"{b}.{q(n)}"))
    return out


BUCKETS = 1_024


def point_width(df: DataFrame, start: str = START, end: str = END, eager: bool = False) -> Column:
    """A BUCKETS-th of the time the rows span."""
    span = F.max(F.col(q(end)).cast("double")) - F.min(F.col(q(start)).cast("double"))
    return _only_value(df.agg(F.coalesce(F.nullif(span / F.lit(float(BUCKETS)), F.lit(0.0)), F.lit(1.0)).alias("width")), eager)


def time_slices(df: DataFrame, keys: Sequence[str] = (), start: str = START, end: str = END) -> DataFrame:
    """(keys, _start_time, _end_time): the stretches between neighbouring change points of each key."""
    points = change_points(df, keys, start, end)
    return _slices(points, keys).select(*_cols(keys), F.col("__s").alias(START), F.col("__e").alias(END))


def _slices(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.filter("__next is not null").select(*_cols(keys), "__i", F.col("__t").alias("__s"), F.col("__next").alias("__e"))


def sliced(df: DataFrame, keys: Sequence[str] = (), start: str = START, end: str = END) -> DataFrame:
    """Every row once for each slice it is active in: its columns, with ``__s`` and ``__e``, the slice's bounds.

    Rows find the numbers of their start and end by equi-joins, and list the numbers between; no range condition is
    ever joined on. A row without length starts and ends at the same point and is in no slice.
    """
    points = change_points(df, keys, start, end)
    rows = df.alias("r")
    for t, i in ((start, "__first"), (end, "__last")):
        at = points.select(*_cols(keys), F.col("__t").alias(t), F.col("__i").alias(i)).alias("p")
        rows = rows.join(at, _same("r", "p", [*keys, t])).select("r.*", f"p.{i}").alias("r")
    rows = rows.filter("__first < __last").withColumn("__i", F.explode(F.sequence(F.col("__first"), F.col("__last") - 1))).drop("__first", "__last")
    bounds = _slices(points, keys)
    return rows.alias("r").join(bounds.alias("b"), _same("r", "b", [*keys, "__i"])).select("r.*", "b.__s", "b.__e").drop("__i")


TIERS = (24, 12, 6, 0)


def tiled(df: DataFrame, keys: Sequence[str], parts: dict[str, tuple[Column, Callable[[Column], Column]]], start: str = START, end: str = END, within: Sequence[str] = ()) -> DataFrame:
    """(keys, within, __s, __e, parts): what the rows active in each slice of a key come to, per value of ``within``.

    ``parts``: a row's contribution and the aggregate that combines contributions, such as a sum or a minimum. No row is
    repeated for the slices it spans. Slices are the leaves of a binary tree; a row counts at the nodes that make up its
    span, at most two of each size, and what the nodes come to is handed down to the slices, from tier to tier, so that
    no more than a few rows for each slice are made.
    """
    points = change_points(df, keys, start, end)
    group, names = [*keys, *within], list(parts)
    combined = lambda: [parts[n][1](F.col(f"__p{i}")).alias(f"__p{i}") for i, n in enumerate(names)]
    rows = df.filter(F.col(q(start)) < F.col(q(end))).select(*_cols([*group, start, end]), *(parts[n][0].alias(f"__p{i}") for i, n in enumerate(names)))
    rows = rows.groupBy(*_cols([*group, start, end])).agg(*combined()).alias("r")
    for t, i in ((start, "__first"), (end, "__last")):
        at = points.select(*_cols(keys), F.col("__t").alias(t), F.col("__i").alias(i)).alias("p")
        rows = rows.join(at, _same("r", "p", [*keys, t])).select("r.*", f"p.{i}").alias("r")
    # The middle is the multiple of the largest power of two in (first, last]; the bits of the distances give the nodes.
    rows = rows.withColumn("__h", F.expr("length(bin(__first ^ __last)) - 1"))
    rows = rows.withColumn("__m", F.expr("shiftleft(shiftright(__last, __h), __h)"))
    rows = rows.withColumns({"__y": F.expr("__m - __first"), "__z": F.expr("__last - __m")})
    of = lambda c, i: f"transform(filter(sequence(0, __h), k -> (shiftright({c}, k) & 1) = 1), k -> struct(k AS k, {i} AS i))"
    covered = F.expr(f"concat({of('__y', 'shiftright(__m, k) - shiftright(__y, k)')}, {of('__z', 'shiftright(__m, k) + 2 * shiftright(__z, k + 1)')})")
    kept = [*_cols(group), *(F.col(f"__p{i}") for i in range(len(names)))]
    nodes = rows.select(*kept, F.explode(covered).alias("__n")).select(*kept, F.col("__n.k").alias("__k"), F.col("__n.i").alias("__i"))
    nodes = nodes.groupBy(*_cols(group), "__k", "__i").agg(*combined())
    for tier in TIERS:
        deep = F.expr(f"greatest(__k - {tier}, 0)")
        below = nodes.withColumn("__d", deep).withColumn("__j", F.explode(F.expr("sequence(0L, shiftleft(1L, __d) - 1)")))
        below = below.withColumns({"__i": F.expr("shiftleft(__i, __d) + __j"), "__k": F.col("__k") - F.col("__d")}).drop("__d", "__j")
        nodes = below.groupBy(*_cols(group), "__k", "__i").agg(*combined())
    found = nodes.alias("r").join(_slices(points, keys).alias("b"), _same("r", "b", [*keys, "__i"]))
    return found.select(*(F.col(f"r.{q(c)}").alias(c) for c in group), "b.__s", "b.__e", *(F.col(f"r.__p{i}").alias(n) for i, n in enumerate(names)))


def temporal_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: dict[str, Column] | Callable[[DataFrame], dict[str, Column]],
    start: str = START,
    end: str = END,
    merge: bool = True,
) -> DataFrame:
    """Slice time at every change point of a key and aggregate the rows active in each slice; equal neighbours merge.

    In the aggregates' arguments ``_start_time`` and ``_end_time`` are the slice's bounds; other columns, ``_duration``
    too, are the row's.
    """
    rows = sliced(df, keys, start, end).drop(start, end).withColumnsRenamed({"__s": start, "__e": end})
    made = aggregates(rows) if callable(aggregates) else aggregates
    groups = [start, end, *keys]
    out = rows.groupBy(*_cols(groups)).agg(*(c.alias(n) for n, c in made.items()))
    return coalesce_intervals(out, list(keys), list(made), start, end) if merge else out


def _swept(df: DataFrame, keys: Sequence[str], steps: dict[str, Column], start: str, end: str, eager: bool = False) -> DataFrame:
    """(keys, __t, __e, names): running sums of what rows add at their start and take away at their end.

    The columns of ``steps`` must be of exact types, so that what was added is gone once it is taken away. Sums run per
    key and time bucket, from the sums of the buckets before. The last point of each key has no ``__e``.
    """
    names = [f"__{i}" for i in range(len(steps))]
    rows = df.filter(F.col(q(start)) < F.col(q(end))).select(*_cols(keys), F.col(q(start)).alias("__a"), F.col(q(end)).alias("__z"), *(c.alias(n) for n, c in zip(names, steps.values())))
    side = lambda t, sign: F.struct(F.col(t).alias("__t"), *((F.col(n) if sign > 0 else -F.col(n)).alias(n) for n in names))
    changes = rows.select(*_cols(keys), F.explode(F.array(side("__a", 1), side("__z", -1))).alias("x")).select(*_cols(keys), "x.*")
    points = changes.groupBy(*_cols(keys), "__t").agg(*(F.sum(n).alias(n) for n in names))
    points = points.withColumn("__b", F.floor(F.col("__t") / point_width(df, start, end, eager)))
    inside, across = Window.partitionBy(*_cols(keys), "__b").orderBy("__t"), Window.partitionBy(*_cols(keys)).orderBy("__b")
    so_far = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(*_cols(keys), "__b").agg(F.min("__t").alias("__low"), *(F.sum(n).alias(n) for n in names))
    totals = totals.select(*_cols(keys), "__b", F.lead("__low").over(across).alias("__after"), *(F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(f"{n}_before") for n in names))
    running = points.select(*_cols(keys), "__b", "__t", F.lead("__t").over(inside).alias("__e"), *(F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names))
    joined = running.alias("r").join(totals.alias("s"), _same("r", "s", [*keys, "__b"]))
    return joined.select(*(F.col(f"r.{q(k)}") for k in keys), "__t", F.coalesce("__e", "__after").alias("__e"), *((F.col(n) + F.col(f"{n}_before")).alias(m) for n, m in zip(names, steps)))


def temporal_counts(df: DataFrame, keys: Sequence[str], counts: dict[str, Column | None], start: str = START, end: str = END) -> DataFrame:
    """What ``temporal_aggregate`` gives for counts of rows (None) and of rows that satisfy a condition, by a sweep.

    No row is repeated for the slices it spans. The conditions must not use the bounds.
    """
    names = list(counts)
    steps = {f"__c{i}": (F.lit(1) if c is None else F.coalesce(c.cast("int"), F.lit(0))).cast("long") for i, c in enumerate(counts.values())} | {"__all": F.lit(1).cast("long")}
    out = _swept(df, keys, steps, start, end).filter((F.col("__all") > 0) & F.col("__e").isNotNull())
    out = out.select(F.col("__t").alias(start), F.col("__e").alias(end), *_cols(keys), *(F.col(f"__c{i}").cast("double").alias(n) for i, n in enumerate(names)))
    return coalesce_intervals(out, list(keys), names, start, end)


def active_count(df: DataFrame, keys: Sequence[str] = (), start: str = START, end: str = END) -> DataFrame:
    """(keys, _start_time, _end_time, active): how many rows are active between changes; rows without length change nothing."""
    swept = _swept(df, keys, {"active": F.lit(1).cast("long")}, start, end).filter("__e is not null")
    return swept.select(*_cols(keys), F.col("__t").alias(START), F.col("__e").alias(END), F.col("active").cast("double").alias("active"))


def running_count(df: DataFrame, keys: Sequence[str], count: str, start: str = START, end: str = END) -> DataFrame:
    """(keys, start, end, <count>): the sum of a column of whole numbers over the rows active between changes."""
    swept = _swept(df, keys, {"__n": F.col(q(count)).cast("long")}, start, end).filter("__e is not null")
    return swept.select(*_cols(keys), F.col("__t").alias(start), F.col("__e").alias(end), F.col("__n").alias(count))


def step_sums(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), start: str = START, end: str = END, eager: bool = False) -> DataFrame:
    """(keys, start, end, values): the sums of step functions over the union of their change points.

    Stretches inside the span in which no function is defined count as 0. The sums are a sweep over decimals with 26
    digits below the largest value, so no rounding error is carried along; infinite values and those that are not
    numbers are counted on their own. Nulls count as 0.
    """
    huge = F.lit(float("inf"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    steps: dict[str, Column] = {}
    totals: dict[str, Column] = {}
    for i, value in enumerate(values):
        v = F.col(q(value)).cast("double")
        plain = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < huge)
        # The power of two above the largest value; dividing by it is exact.
        top = df.agg(F.coalesce(F.nullif(F.max(F.when(plain, F.abs(v))), F.lit(0.0)), F.lit(1.0)).alias("top"))
        unit = _only_value(top.select(F.pow(F.lit(2.0), F.floor(F.log2("top")) + 1).alias("unit")), eager)
        steps |= {f"__sum{i}": F.when(plain, v / unit).otherwise(F.lit(0.0)).cast("decimal(38,26)"), f"__nan{i}": flag(F.isnan(v)), f"__up{i}": flag(v == huge), f"__down{i}": flag(v == -huge)}
        up, down = F.col(f"__up{i}") > 0, F.col(f"__down{i}") > 0
        undefined = (F.col(f"__nan{i}") > 0) | (up & down)
        totals[value] = F.when(undefined, F.lit(float("nan"))).when(up, huge).when(down, -huge).otherwise(F.col(f"__sum{i}").cast("double") * unit)
    swept = _swept(df, keys, steps, start, end, eager).filter("__e is not null")
    return swept.select(*_cols(keys), F.col("__t").alias(start), F.col("__e").alias(end), *(t.alias(v) for v, t in totals.items()))


def step_sum(df: DataFrame, value: str, keys: Sequence[str] = (), start: str = START, end: str = END) -> DataFrame:
    """``step_sums`` of one column."""
    return step_sums(df, [value], keys, start, end)


def merged_steps(series: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str], start: str = START, end: str = END, eager: bool = False) -> DataFrame:
    """(keys, start, end, the values of all series): step functions laid over each other; null where one is not defined.

    Each series is a table of intervals that do not overlap within a key, and the columns that hold its values. All are
    cut at the borders of time buckets, so the values at a bucket's start need no look further back; neighbours with
    equal values are merged in the end.
    """
    bounds = [df.select(F.col(q(start)).alias(start), F.col(q(end)).alias(end)) for df, _ in series]
    whole = bounds[0]
    for more in bounds[1:]:
        whole = whole.unionAll(more)
    width = point_width(whole, start, end, eager)
    rows = None
    for i, (df, values) in enumerate(series):
        kind = df.schema[start].dataType
        first, last = F.floor(F.col("__a") / width), F.floor(F.col("__z") / width)
        cut = df.filter(F.col(q(start)) < F.col(q(end))).select(*_cols(keys), F.col(q(start)).alias("__a"), F.col(q(end)).alias("__z"), F.struct(*_cols(values)).alias("__v"))
        # One bucket more on both sides, as borders are rounded; what is empty there goes.
        cut = cut.withColumn("__b", F.explode(F.sequence(first - 1, F.greatest(first, last) + 1)))
        low, high = (F.col("__b") * width).cast(kind), ((F.col("__b") + 1) * width).cast(kind)
        cut = cut.withColumns({"__a": F.greatest("__a", low), "__z": F.least("__z", high)}).filter("__a < __z")
        at = F.explode(F.array(F.struct(F.col("__a").alias("t"), F.lit(True).alias("on")), F.struct(F.col("__z").alias("t"), F.lit(False).alias("on"))))
        marks = cut.withColumn("__m", at).select(*_cols(keys), "__b", F.col("__m.t").alias("__t"), F.struct(F.col("__m.on").alias("on"), F.col("__v").alias("v")).alias(f"__{i}"))
        rows = marks if rows is None else rows.unionByName(marks, allowMissingColumns=True)
    names = [f"__{i}" for i in range(len(series))]
    # Where one interval ends and the next begins, the beginning counts: true is greater.
    points = rows.groupBy(*_cols(keys), "__b", "__t").agg(*(F.max(n).alias(n) for n in names))
    order = Window.partitionBy(*_cols(keys), "__b").orderBy("__t")
    held = points.select(*_cols(keys), F.col("__t").alias(start), F.lead("__t").over(order).alias(end), *(F.last(n, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names))
    out = [F.when(F.col(f"__{i}.on"), F.col(f"__{i}.v.{q(c)}")).alias(c) for i, (_, values) in enumerate(series) for c in values]
    laid = held.filter(F.col(q(end)).isNotNull()).filter(" or ".join(f"{n}.on" for n in names)).select(*_cols([*keys, start, end]), *out)
    return coalesce_intervals(laid, keys, [c for _, values in series for c in values], start, end)


def zoom(df: DataFrame, low: float, high: float) -> DataFrame:
    """Rows clipped to [low, high); rows outside it go."""
    s, e = F.greatest(F.col(START), F.lit(float(low))), F.least(F.col(END), F.lit(float(high)))
    shape = {START: s, END: e, DURATION: e - s}
    return df.filter((F.col(START) < high) & (F.col(END) > low)).select(*(shape.get(c, F.col(q(c))).alias(c) for c in df.columns))


def step_series(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """(series, time, <value>): the corners of a step line; a gap is a point that is not a number."""
    order = Window.partitionBy(*_cols(series)).orderBy(START, END)
    gap = F.lead(START).over(order) > F.col(END)
    point = lambda t, v: F.struct(t.alias("time"), v.alias("value"))
    corners = F.array(point(F.col(START), F.col(q(value))), point(F.col(END), F.col(q(value))))
    hole = F.array(point(F.col(END), F.lit(float("nan"))))
    points = df.withColumn("__gap", F.coalesce(gap, F.lit(False))).select(*_cols(series), F.explode(F.when(F.col("__gap"), F.concat(corners, hole)).otherwise(corners)).alias("p"))
    return points.select(*_cols(series), F.col("p.time").alias("time"), F.col("p.value").alias(value))
