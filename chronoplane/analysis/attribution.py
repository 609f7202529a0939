"""Attribution of measured usage to phases: rules, demand, upsampling, attribution.

All tables are long: a metric is its measurement periods, a demand its steps, an attribution its steps. Times are
nanoseconds. Periods and phases meet by equi-joins on the metric and time buckets (operators.intervals). Only the fit
of a metric's coefficients, from sums over its periods, runs in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ieee_div
from ..operators.intervals import active_count, coalesce_intervals, merged_steps, running_count, step_sums, temporal_join
from ..schema import DURATION, END, START
from ..storage import written
from .nnls import nnls_of_sums

NONE, EXACT, VARIABLE = "none", "exact", "variable"
#: Rules given by the user: for (metric_path, phase_path) a kind and a demand; they override the fitted ones.
OVERRIDES = "metric_path string, phase_path string, kind string, demand double"
RULES = OVERRIDES
PARTS = 64
LEAVES = 8_192  # phases with equal rules, at about the same time, that are laid out together
ALL_EXACT, ALL_VARIABLE = "\x01exact", "\x01variable"  # stand for the phases with rules of these kinds given


def canonical_machine(name: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return name
    known = F.create_map(*[F.lit(x) for item in sorted(aliases.items()) for x in item])
    return F.coalesce(known[name], name)


def candidate_pairs(metrics: DataFrame, phases: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(metric_path, phase_path, phase_type, start_ns, end_ns) of leaf phases and metrics that are not on different machines.

    Phases and metrics of the same machine meet in an equi-join. Those without a machine belong to all of the other
    side, a product by definition, which is dealt over PARTS by the phases.
    """
    m = metrics.select("metric_path", canonical_machine(F.col("machine"), aliases).alias("mm")).distinct()
    p = phases.filter("is_leaf").select(F.col("path").alias("phase_path"), F.col("type").alias("phase_type"), "start_ns", "end_ns", canonical_machine(F.col("machine"), aliases).alias("pm"))
    columns = ["metric_path", "phase_path", "phase_type", "start_ns", "end_ns"]
    same = m.join(p, F.col("mm") == F.col("pm")).select(*columns)
    dealt = p.withColumn("part", F.pmod(F.xxhash64("phase_path"), F.lit(PARTS)))
    spread = m.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    free_metrics = spread.filter("mm is null").join(dealt, "part").select(*columns)
    free_phases = spread.filter("mm is not null").join(dealt.filter("pm is null"), "part").select(*columns)
    return same.unionByName(free_metrics).unionByName(free_phases)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Pairs of rows of equal keys that overlap, with the stretch they share as start_ns and end_ns; ``most`` as for
    ``temporal_join``."""
    a = left.withColumnsRenamed({"start_ns": START, "end_ns": END})
    b = right.withColumnsRenamed({"start_ns": START, "end_ns": END} | {k: f"__{k}" for k in keys})
    met = temporal_join(a, b, [(F.col(k), F.col(f"__{k}")) for k in keys], eager=True, most=most)
    return met.drop(DURATION, *(f"__{k}" for k in keys)).withColumnsRenamed({START: "start_ns", END: "end_ns"})


def activity(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """(metric_path, start_ns, end_ns, phase_type, active): the sum of the phases' shares of each period.

    ``pairs`` may have a column ``factor``, which weighs each phase.
    """
    if "factor" not in pairs.columns:
        pairs = pairs.withColumn("factor", F.lit(1.0))
    periods = metrics.select("metric_path", "start_ns", "end_ns", F.col("start_ns").alias("p_start"), F.col("end_ns").alias("p_end"))
    met = overlaps(pairs.select("metric_path", "start_ns", "end_ns", "phase_type", "factor").filter("start_ns < end_ns"), periods, ["metric_path"])
    share = F.col("factor") * (F.col("end_ns") - F.col("start_ns")) / (F.col("p_end") - F.col("p_start"))
    return met.groupBy("metric_path", F.col("p_start").alias("start_ns"), F.col("p_end").alias("end_ns"), "phase_type").agg(F.sum(share).alias("active"))


def fitted_rules(metrics: DataFrame, pairs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """A rule for every pair: the override if there is one, else a variable demand fitted per metric and phase type.

    What is fitted needs of a metric's periods only the products of its activities with each other and with its values,
    summed over the periods: as many numbers as phase types, squared.
    """
    plain, exact, given = pairs, None, None
    if overrides is not None:
        given = pairs.join(overrides, ["metric_path", "phase_path"])
        plain = pairs.join(overrides.select("metric_path", "phase_path"), ["metric_path", "phase_path"], "left_anti")
        exact = activity(metrics, given.filter(F.col("kind") == EXACT).withColumns({"factor": F.col("demand"), "phase_type": F.lit(ALL_EXACT)}))
    acts = activity(metrics, plain)
    if given is not None:
        acts = acts.unionByName(activity(metrics, given.filter(F.col("kind") == VARIABLE).withColumns({"factor": F.col("demand"), "phase_type": F.lit(ALL_VARIABLE)})))
    period, number = ["metric_path", "start_ns"], lambda c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    acts = acts.select(*period, "phase_type", number(F.col("active")).alias("active"))
    values = metrics.select(*period, number(F.col("value")).alias("y"))
    if exact is not None:
        known = exact.select(*period, F.col("active").alias("known"))
        values = values.join(known, period, "left").select(*period, F.greatest(F.col("y") - F.coalesce("known", F.lit(0.0)), F.lit(0.0)).alias("y"))
    else:
        values = values.select(*period, F.greatest("y", F.lit(0.0)).alias("y"))
    acts = written(acts.join(values, period), "activities")
    others = acts.select(*period, F.col("phase_type").alias("other"), F.col("active").alias("other_active"))
    products = acts.join(others, period).groupBy("metric_path", "phase_type", "other").agg(F.sum(F.col("active") * F.col("other_active")).alias("product"))
    right = acts.groupBy("metric_path", "phase_type").agg(F.sum(F.col("active") * F.col("y")).alias("product"))
    sums = products.unionByName(right.withColumn("other", F.lit(None).cast("string")))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        types = sorted(pdf["phase_type"].unique())
        at = {t: i for i, t in enumerate(types)}
        of_types = pdf[pdf["other"].notna()]
        gram, by_value = np.zeros((len(types), len(types))), np.zeros(len(types))
        gram[of_types["phase_type"].map(at), of_types["other"].map(at)] = of_types["product"]
        of_values = pdf[pdf["other"].isna()]
        by_value[of_values["phase_type"].map(at)] = of_values["product"]
        return pd.DataFrame({"metric_path": key[0], "phase_type": types, "coefficient": nnls_of_sums(gram, by_value)})

    fits = sums.groupBy("metric_path").applyInPandas(fit, "metric_path string, phase_type string, coefficient double")
    # A type without activity in any period still has a rule, with demand 0.
    rules = plain.join(fits, ["metric_path", "phase_type"], "left").select("metric_path", "phase_path", F.lit(VARIABLE).alias("kind"), F.coalesce("coefficient", F.lit(0.0)).alias("demand"))
    if given is not None:
        scale = fits.filter(F.col("phase_type") == ALL_VARIABLE).select("metric_path", F.col("coefficient").alias("scale"))
        scaled = given.join(scale, "metric_path", "left").select("metric_path", "phase_path", "kind", F.when(F.col("kind") == VARIABLE, F.col("demand") * F.coalesce("scale", F.lit(0.0))).otherwise(F.col("demand")).alias("demand"))
        rules = rules.unionByName(scaled)
    return rules


def has_bounds(rules: DataFrame) -> bool:
    return {"start_ns", "end_ns"} <= set(rules.columns)


def bounded(rules: DataFrame, phases: DataFrame) -> DataFrame:
    """Rules with the bounds of their phases."""
    if has_bounds(rules):
        return rules
    return rules.join(phases.select(F.col("path").alias("phase_path"), "start_ns", "end_ns"), "phase_path")


def demand(metrics: DataFrame, rules: DataFrame, phases: DataFrame, kind: str) -> DataFrame:
    """(metric_path, start_ns, end_ns, demand): the sum of the demands of the leaf phases active, over each metric's span.

    Sums are exact (see ``step_sums``), not floating-point numbers carried along. Rules that have their phases' bounds as
    columns start_ns and end_ns, a written table, are not joined with the phases, and nothing as long is written again.
    """
    span = metrics.groupBy("metric_path").agg(F.min("start_ns").alias("low"), F.max("end_ns").alias("high"))
    own = bounded(rules.filter(F.col("kind") == kind), phases).select("metric_path", "start_ns", "end_ns", "demand")
    own = own.join(span, "metric_path").select("metric_path", F.greatest("start_ns", "low").alias("start_ns"), F.least("end_ns", "high").alias("end_ns"), "demand").filter("start_ns < end_ns")
    base = span.filter("low < high").select("metric_path", F.col("low").alias("start_ns"), F.col("high").alias("end_ns"), F.lit(0.0).alias("demand"))
    rows = base.unionByName(own)
    steps = step_sums(rows if has_bounds(rules) else written(rows, "demands"), ["demand"], ["metric_path"], "start_ns", "end_ns", eager=True)
    return coalesce_intervals(steps, ["metric_path"], ["demand"], "start_ns", "end_ns")


def fill(parts: DataFrame, period: list[str], amount: str, weight: Column, room: Column, name: str) -> DataFrame:
    """parts with a column ``name``: how much of a period's mean ``amount`` each gets, in proportion to its weight, but
    no more than its room; and with the ``amount`` less what was given out.

    Parts have a ``share`` of their period. A part gets min(level * weight, room), for the level at which all of the
    amount is given out. With the parts in the order of the level that fills them, room / weight, the straight line that
    counts those before a part as full and the others as not full is never below what is given out, and touches it at
    some part; so the level is the largest of those at which these lines reach the amount. If there is less room than
    that, the last line fills all parts.
    """
    room = F.when(weight > 0, room).otherwise(0.0)
    whole = Window.partitionBy(*period)
    by_level = whole.orderBy(F.when(weight > 0, room / weight).asc_nulls_last(), "start_ns")
    full_before = F.coalesce(F.sum(F.col("share") * room).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    slope = F.sum(F.col("share") * weight).over(by_level.rowsBetween(0, Window.unboundedFollowing))
    lined = parts.withColumn("__line", F.try_divide(F.col(amount) - full_before, F.nullif(slope, F.lit(0.0))))
    level = F.greatest(F.coalesce(F.max("__line").over(whole), F.lit(0.0)), F.lit(0.0))
    given = lined.withColumn(name, F.least(level * weight, room)).drop("__line")
    return given.withColumn(amount, F.greatest(F.col(amount) - F.sum(F.col(name) * F.col("share")).over(whole), F.lit(0.0)))


def upsample(metrics: DataFrame, exact: DataFrame, variable: DataFrame, merge: bool = True) -> DataFrame:
    """(metric_path, start_ns, end_ns, value, max_value): periods in which demand changes are split at the changes.

    A period's mean value is given out to its parts in proportion to their exact demand, at most that demand; what is
    left in proportion to their variable demand, and what is left then evenly, always at most the metric's limit. Where
    the mean itself was measured above that limit, it is the limit, so that nothing is lost.
    """
    periods = metrics.select("metric_path", "start_ns", "end_ns", "value", "max_value", F.col("start_ns").alias("period"))
    demands = [d.select("metric_path", "start_ns", "end_ns", F.col("demand").alias(n)) for d, n in ((exact, "exact"), (variable, "variable"))]
    parts = merged_steps([(periods, ["value", "max_value", "period"]), *((d, [n]) for d, n in zip(demands, ("exact", "variable")))], ["metric_path"], "start_ns", "end_ns", eager=True)
    parts = parts.filter("period is not null").fillna(0.0, ["exact", "variable"])
    period = ["metric_path", "period"]
    of_period, length = Window.partitionBy(*period), F.col("end_ns") - F.col("start_ns")
    even = (F.min("exact").over(of_period) == F.max("exact").over(of_period)) & (F.min("variable").over(of_period) == F.max("variable").over(of_period))
    parts = parts.withColumns({"share": length / F.sum(length).over(of_period), "left": F.col("value"), "even": even})
    most = F.greatest("max_value", "value")
    parts = fill(parts, period, "left", F.col("exact"), F.least("exact", most), "x")
    parts = fill(parts, period, "left", F.col("variable"), most - F.col("x"), "y")
    parts = fill(parts, period, "left", F.lit(1.0), most - F.col("x") - F.col("y"), "z")
    out = parts.select("metric_path", "start_ns", "end_ns", F.when(F.col("even"), F.col("value")).otherwise(F.col("x") + F.col("y") + F.col("z")).alias("value"), "max_value")
    return coalesce_intervals(out, ["metric_path", "max_value"], ["value"], "start_ns", "end_ns") if merge else out


def in_order(rows: DataFrame, *of: str) -> DataFrame:
    """Rows by metric, the columns given, and time."""
    return rows.sort("metric_path", *of, "start_ns", "end_ns")


def rule_steps(rules: DataFrame, phases: DataFrame, upsampled: DataFrame, exact: DataFrame, variable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric_path, phase_path, rule, start_ns, end_ns) of leaf phases, and (metric_path, rule, start_ns, end_ns, usage,
    capacity), what a phase takes by its rule, within the metric's span.

    An exact demand d of a total D takes min(usage * d / D, d); a variable one takes (usage - D exact) * d / D
    variable; a demand of 0 takes nothing and could have everything. What a phase takes follows from its rule alone, so
    it is worked out and merged once for all phases with equal rules, over the times at which one of them is active.
    Phases and steps are written by rule and time: leaves then come with those beside them that have nearly the same
    steps, in the same order, and a table of them is packed to a fraction of the size. Rules with bounds, a written
    table, are to be in this order already (``in_order``); they are not written again.
    """
    series = [
        (upsampled.select("metric_path", "start_ns", "end_ns", F.col("value").alias("u"), F.col("max_value").alias("cap")), ["u", "cap"]),
        (exact.select("metric_path", "start_ns", "end_ns", F.col("demand").alias("x")), ["x"]),
        (variable.select("metric_path", "start_ns", "end_ns", F.col("demand").alias("v")), ["v"]),
    ]
    level = written(merged_steps(series, ["metric_path"], "start_ns", "end_ns", eager=True).filter("u is not null"), "levels")
    spans = bounded(rules.filter(F.col("kind") != NONE), phases).filter("start_ns < end_ns")
    rule = F.concat_ws(" ", "kind", F.col("d").cast("string"))
    spans = spans.select("metric_path", "phase_path", "kind", F.col("demand").cast("double").alias("d"), "start_ns", "end_ns").withColumn("rule", rule)
    spans = spans if has_bounds(rules) else written(in_order(spans, "rule"), "spans")
    alike = ["metric_path", "rule", "kind", "d"]
    active = active_count(spans, alike, "start_ns", "end_ns").filter("active > 0").withColumnsRenamed({START: "start_ns", END: "end_ns"})
    met = overlaps(written(active.drop("active"), "active"), level, ["metric_path"])

    def part_of(total: Column, when_zero: Column) -> Column:
        as_exact = F.least(ieee_div(total * F.col("d"), F.col("x")), F.col("d"))
        as_variable = ieee_div(F.greatest(total - F.col("x"), F.lit(0.0)) * F.col("d"), F.col("v"))
        return F.when(F.col("d") == 0, when_zero).when(F.col("kind") == EXACT, as_exact).otherwise(as_variable)

    steps = met.select("metric_path", "rule", "start_ns", "end_ns", part_of(F.col("u"), F.lit(0.0)).alias("usage"), part_of(F.col("cap"), F.col("cap")).alias("capacity"))
    steps = written(in_order(coalesce_intervals(steps, ["metric_path", "rule"], ["usage", "capacity"], "start_ns", "end_ns"), "rule"), "steps")
    return spans.drop("kind", "d"), steps


def attribute_leaves(spans: DataFrame, steps: DataFrame) -> DataFrame:
    """(metric_path, phase_path, start_ns, end_ns, usage, capacity) of the phases of ``rule_steps``.

    The phases meet the steps of their rules, and need no further merging: neighbouring steps differ. Tasks have so few
    phases that a Parquet file of their rows holds each path once, in its dictionary of 1 MB.
    """
    taken = overlaps(spans, steps, ["metric_path", "rule"], LEAVES)
    return taken.select("metric_path", "phase_path", "start_ns", "end_ns", "usage", "capacity")


def above(path: str) -> Column:
    """The paths above a path, from its components."""
    # Slashes inside brackets do not separate components.
    parts = F.regexp_extract_all(path, F.lit(r"/(?:[^/\[]|\[[^\]]*\])+"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "")))


def ancestors_of(phases: DataFrame) -> DataFrame:
    """(phase_path, above): every phase with each phase above it."""
    return phases.filter("path <> '/'").select(F.col("path").alias("phase_path"), F.explode(above("path")).alias("above"))


def attribute_composites(spans: DataFrame, steps: DataFrame, phases: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Sums over the leaves below each composite phase; 0 where none is active, over the phase's whole span.

    ``spans`` and ``steps`` are those of ``rule_steps``; ``chosen`` (path) restricts the composite phases. The leaves of one
    rule take the same at a time, so what a composite gets by a rule is a step times the number of its leaves that are
    active, and no leaf meets the steps. A leaf that reaches beyond the composite counts with those of its steps that
    touch the composite, unclipped; only such leaves are laid out.
    """
    span = phases.filter("not is_leaf").select(F.col("path").alias("above"), F.col("start_ns").alias("low"), F.col("end_ns").alias("high"))
    if chosen is not None:
        span = span.join(chosen.withColumnRenamed("path", "above"), "above", "left_semi")
    group, bounds = ["metric_path", "rule"], ["start_ns", "end_ns"]
    raised = spans.filter("phase_path <> '/'").select(*group, *bounds, F.explode(above("phase_path")).alias("above"))
    raised = raised.groupBy(*group, *bounds, "above").agg(F.count(F.lit(1)).alias("n"))
    raised = written(raised.join(span, "above"), "below")
    inside = F.col("start_ns").between(F.col("low"), F.col("high")) & F.col("end_ns").between(F.col("low"), F.col("high"))
    active = written(running_count(raised.filter(inside), [*group, "above"], "n", *bounds).filter("n > 0"), "active")
    met = overlaps(active, steps, group).select("metric_path", "above", "n", *bounds, "usage", "capacity")
    outer = overlaps(raised.filter(~inside), steps, group).filter((F.col("start_ns") < F.col("high")) & (F.col("end_ns") > F.col("low")))
    met = met.unionByName(outer.select(*met.columns))
    # A step of capacity 0 without usage counts as well, if only for the bounds.
    times = lambda c: (F.col("n") * F.col(c)).alias(c)
    used = met.select("metric_path", F.col("above").alias("phase_path"), *bounds, times("usage"), times("capacity"))
    used = written(used, "raised")
    some = used.select("metric_path", F.col("phase_path").alias("above")).distinct()
    base = some.join(span, "above").select("metric_path", F.col("above").alias("phase_path"), F.col("low").alias("start_ns"), F.col("high").alias("end_ns")).filter("start_ns < end_ns")
    rows = written(used.unionByName(base.withColumns({"usage": F.lit(0.0), "capacity": F.lit(0.0)})), "summed")
    keys = ["metric_path", "phase_path"]
    return coalesce_intervals(step_sums(rows, ["usage", "capacity"], keys, "start_ns", "end_ns", eager=True), keys, ["usage", "capacity"], "start_ns", "end_ns")


class Attribution:
    """The steps over one job. Each step's result is written once: later steps use it several times."""

    def __init__(self, metrics: DataFrame, phases: DataFrame, aliases: dict[str, str] | None = None, overrides: DataFrame | None = None, rules: DataFrame | None = None, chosen: Column | None = None):
        self.metrics, self.phases = metrics, phases
        self._aliases, self._overrides = aliases or {}, overrides
        self._rules, self._demands = rules, {}
        self._chosen = chosen
        self._stored = False

    def _inputs(self) -> None:
        if not self._stored:
            self.metrics, self.phases, self._stored = written(self.metrics, "metrics"), written(self.phases, "phases"), True

    def rules(self) -> DataFrame:
        if self._rules is None:
            self._inputs()
            pairs = written(candidate_pairs(self.metrics, self.phases, self._aliases), "pairs")
            self._rules = written(fitted_rules(self.metrics, pairs, self._overrides), "rules")
        return self._rules

    def save_rules(self, path: str) -> None:
        """Rules as a Parquet table, to be given to a later Attribution or session."""
        self.rules().write.mode("overwrite").parquet(path)

    def demand(self, kind: str) -> DataFrame:
        if kind not in self._demands:
            rules = self.rules()
            self._inputs()
            self._demands[kind] = written(demand(self.metrics, rules, self.phases, kind), "demand")
        return self._demands[kind]

    def upsampled(self) -> DataFrame:
        exact, variable = self.demand(EXACT), self.demand(VARIABLE)
        return upsample(self.metrics, exact, variable)

    def attributed(self) -> DataFrame:
        """(metric_path, phase_path, start_ns, end_ns, usage, capacity) of all phases, or of the chosen ones.

        Rules are fitted and demands added up over all phases in either case; only the chosen phases and the leaves
        below them are attributed.
        """
        exact, variable, rules = self.demand(EXACT), self.demand(VARIABLE), self.rules()
        chosen = None
        if self._chosen is not None:
            named = self.phases.withColumns({"phase_path": F.col("path"), "phase_type": F.col("type")})
            chosen = written(named.filter(self._chosen).select("path").distinct(), "chosen")
            below = ancestors_of(self.phases).join(chosen.withColumnRenamed("path", "above"), "above", "left_semi").select("phase_path")
            needed = chosen.select(F.col("path").alias("phase_path")).unionByName(below).distinct()
            rules = rules.join(needed, "phase_path", "left_semi")
        spans, steps = rule_steps(rules, self.phases, written(self.upsampled(), "upsampled"), exact, variable)
        composites = attribute_composites(spans, steps, self.phases, chosen)
        own = spans if chosen is None else spans.join(chosen.withColumnRenamed("path", "phase_path"), "phase_path", "left_semi").select(spans.columns)
        return attribute_leaves(own, steps).unionByName(composites)

    def only(self, metrics: Column | None = None, phases: Column | None = None) -> Attribution:
        """Restricted to some metrics before anything is computed (rules are fitted per metric, so they stay the same),
        and to some phases, by columns phase_path and phase_type, before anything is attributed."""
        if metrics is None and phases is None:
            return self
        kept = self.metrics if metrics is None else self.metrics.filter(metrics)
        out = Attribution(kept, self.phases, self._aliases, self._overrides, self._rules, phases)
        if metrics is None:
            out._demands, out._stored = self._demands, self._stored
        return out
