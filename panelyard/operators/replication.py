"""Summaries of replication tables: one row a replication (key j) or a start, any number of
designs. All are plain aggregations over design keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dist import CHI2_3, chi2_quantile_exact, chi2_sf
from ..sources import tables
from .quantiles import quantiles, with_quantiles


def finite(c: str | Column) -> Column:
    """The value, or null for NaN and infinities."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def error_metrics(df: DataFrame, keys: list[str], error: str = "e", failed: str | None = None) -> DataFrame:
    e = F.col(error)
    more = [F.sum(F.col(failed)).alias("n_failed")] if failed else []
    out = df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), *more)
    return with_quantiles(out, df.withColumn("__e", F.abs(e)), keys, "__e", {"mae": 0.5})


def trimmed_rmse(df: DataFrame, keys: list[str], drop: int, error: str = "e", order: str = "j") -> DataFrame:
    """RMSE without the `drop` largest absolute errors of each key.

    The few dropped are found by aggregates of the largest, not by ordering a whole key.
    """
    bins = df.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(256)))
    w = Window.partitionBy(*keys, "__b").orderBy(F.abs(error).desc(), F.col(order).desc())
    top = bins.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= drop).groupBy(*keys).agg(worst_of(drop, error).alias("worst"))
    whole = df.groupBy(*keys).agg(F.sum(F.col(error) * F.col(error)).alias("ss"), F.count(error).alias("n"))
    rest = whole.join(top, keys).withColumn("out", F.aggregate("worst", F.lit(0.0), lambda a, x: a + x))
    return rest.select(*keys, F.sqrt((F.col("ss") - F.col("out")) / (F.col("n") - F.size("worst"))).alias("rmse"))


def worst_of(n: int, error: str) -> Column:
    return F.slice(F.sort_array(F.collect_list(F.col(error) * F.col(error)), False), 1, n)


def ss_concentration(df: DataFrame, keys: list[str], top: int, error: str = "e", order: str = "j") -> DataFrame:
    """Share of the sum of squares that the `top` worst replications hold."""
    bins = df.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(256)))
    w = Window.partitionBy(*keys, "__b").orderBy(F.abs(error).desc(), F.col(order).desc())
    best = bins.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).groupBy(*keys).agg(worst_of(top, error).alias("worst"))
    whole = df.groupBy(*keys).agg(F.sum(F.col(error) * F.col(error)).alias("ss"))
    return whole.join(best, keys).select(*keys, (F.aggregate("worst", F.lit(0.0), lambda a, x: a + x) / F.col("ss")).alias("share"))


def low_share(df: DataFrame, keys: list[str], by: str, error: str = "e", order: str = "j", part: int = 10) -> DataFrame:
    """Share of the sum of squares in the n / part rows of lowest `by` (ties by order), one row at least.

    The last of them is found as a quantile; only rows that tie with it are ordered.
    """
    k = lambda n: F.greatest(F.floor(n / part), F.lit(1))
    last = quantiles(df, keys, by, {"__last": 1 / part}, lambda n: k(n) - 1)
    near, square = tables.joined(df.where(F.col(by).isNotNull()), last, keys), F.col(error) * F.col(error)
    low = near.groupBy(*keys).agg(F.sum(square).alias("__ss"), F.coalesce(F.sum(F.when(F.col(by) < F.col("__last"), square)), F.lit(0.0)).alias("__low"), (k(F.count("*")) - F.count_if(F.col(by) < F.col("__last"))).alias("__more"))
    tied = near.where(F.col(by) == F.col("__last")).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    extra = tables.joined(tied, low.select(*keys, "__more"), keys).where(F.col("__r") <= F.col("__more")).groupBy(*keys).agg(F.sum(square).alias("__extra"))
    return tables.joined(low, extra, keys, "left").select(*keys, ((F.col("__low") + F.coalesce("__extra", F.lit(0.0))) / F.col("__ss")).alias("share_low"))


def worst_median(df: DataFrame, keys: list[str], top: int, value: str, error: str = "e", order: str = "j") -> DataFrame:
    """Median of a value over the `top` worst replications."""
    bins = df.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(256)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(error).desc(), F.col(order).desc()))
    few = bins.withColumn("__r", rank(*keys, "__b")).where(F.col("__r") <= top)
    return few.withColumn("__r", rank(*keys)).where(F.col("__r") <= top).groupBy(*keys).agg(F.median(value).alias("median_worst"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], parts: int = 64) -> DataFrame:
    """Rank correlation with ties at their smallest rank.

    Values are counted first, so equal ones are one row; each key's range of values is cut at
    approximate quantiles into `parts`, whose counts give where a part's ranks start, so no
    task orders more than a part of a key.
    """

    def ranks(c: str, name: str) -> DataFrame:
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("n"))
        cuts = counts.groupBy(*keys).agg(F.percentile_approx(c, [k / parts for k in range(1, parts)], 1000).alias("__cuts"))
        placed = tables.joined(counts, cuts, keys).withColumn("__part", F.size(F.filter("__cuts", lambda v: v <= F.col(c)))).drop("__cuts")
        total = placed.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))
        running = lambda what, by, order: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = total.withColumn("__start", running("__n", keys, "__part")).drop("__n")
        inside = tables.joined(placed, starts, [*keys, "__part"])
        return inside.select(*keys, c, (F.col("__start") + running("n", [*keys, "__part"], c) + 1).alias(name))

    both = tables.joined(tables.joined(df, ranks(x, "__rx"), [*keys, x]), ranks(y, "__ry"), [*keys, y])
    return both.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("rho"))


def start_diagnostics(df: DataFrame, keys: list[str], won: str, spread: str, tolerance: float = 1e-6) -> DataFrame:
    out = df.groupBy(*keys).agg(F.avg(F.when((F.col(won) != 0) & (F.col(spread) > tolerance), 1.0).otherwise(0.0)).alias("other_won"), F.max(spread).alias("max_spread"))
    return with_quantiles(out, df, keys, spread, {"median_spread": 0.5})


def efficiency_gain(metrics: DataFrame, keys: list[str], value: str, estimator: str = "estimator") -> DataFrame:
    """From rows of iid, correct and infeasible: gains over iid and the share recovered."""
    wide = metrics.groupBy(*keys).pivot(estimator, ["iid", "correct", "infeasible"]).agg(F.first(value))
    gain = lambda c: 1 - F.col(c) / F.col("iid")
    return wide.select(*keys, gain("correct").alias("gain"), gain("infeasible").alias("possible"), (gain("correct") / gain("infeasible")).alias("recovered"))


def multistart_summary(df: DataFrame, keys: list[str], j: str, loglik: str, converged: str, iters: str) -> DataFrame:
    """Over data sets: share of starts within 1e-6 of the best converged one, worst gaps, iterations.

    n_far counts gaps over 1e-3 to the best converged start.
    """
    best = df.groupBy(*keys, j).agg(F.max(F.when(F.col(converged), F.col(loglik))).alias("__best"))
    gap = tables.joined(df, best, [*keys, j]).withColumn("__gap", F.col("__best") - F.col(loglik))
    sets = gap.groupBy(*keys, j).agg(
        F.avg(F.when(F.col("__gap") <= 1e-6, 1.0).otherwise(0.0)).alias("share"), F.max("__gap").alias("worst"), F.count_if(F.col("__gap") > 1e-3).alias("n_far")
    )
    runs = df.groupBy(*keys).agg(F.max(iters).alias("max_iters"), F.count_if(~F.col(converged)).alias("n_dropped"))
    runs = with_quantiles(runs, df, keys, iters, {"median_iters": 0.5, "iters95": 0.95})
    per = sets.groupBy(*keys).agg(
        F.count("*").alias("n_sets"), F.avg("share").alias("share_best"), F.min("share").alias("least_share"), F.avg(F.when(F.col("share") == 1, 1.0).otherwise(0.0)).alias("all_agree"),
        F.max("worst").alias("max_worst"), F.sum("n_far").alias("n_far"),
    )
    return tables.joined(with_quantiles(per, sets, keys, "worst", {"median_worst": 0.5}), runs, keys)


def start_table_summary(df: DataFrame, keys: list[str], j: str, loglik: str, iters: str | None = None, limit: int = 0, closed: str | None = None) -> DataFrame:
    """Two-level: gaps to each data set's best, then mean, largest and median of medians.

    iters and limit add how many starts used all iterations; closed names a column that marks
    the closed-form start, whose largest gap is added.
    """
    best = df.groupBy(*keys, j).agg(F.max(loglik).alias("__best"))
    gap = tables.joined(df, best, [*keys, j]).withColumn("__gap", F.col("__best") - F.col(loglik))
    more = {}
    if iters:
        more["n_limit"] = (F.count_if(F.col(iters) >= limit), F.sum)
    if closed:
        more["closed_gap"] = (F.max(F.when(F.col(closed), F.col("__gap"))), F.max)
    # A data set has as many starts as were tried, a parameter.
    sets = gap.groupBy(*keys, j).agg(F.avg("__gap").alias("mean"), F.max("__gap").alias("top"), F.median("__gap").alias("mid"), *(c.alias(n) for n, (c, _) in more.items()))
    out = sets.groupBy(*keys).agg(F.avg("mean").alias("mean_gap"), F.max("top").alias("max_gap"), *(f(n).alias(n) for n, (_, f) in more.items()))
    return with_quantiles(out, sets, keys, "mid", {"median_of_medians": 0.5})


def size_summary(df: DataFrame, keys: list[str], lr: str = "lr", status: str = "status", won: str | None = None, spread: str | None = None, degrees: int | None = None) -> DataFrame:
    """Rejection rates at 10, 5 and 1 percent of the usable rows (status 0), counts and quantiles.

    The critical values are those of a chi-square with `degrees`; without, the tabulated ones for 3.

    won adds the share of usable rows that start 2 (the closed form) won; spread its median and maximum.
    Keys without usable rows keep their counts and have nulls elsewhere.
    """
    ok = (F.col(status) == 0) & finite(lr).isNotNull()
    rates = [F.avg(F.when(ok, (F.col(lr) >= c).cast("double"))).alias(f"rej{p}") for p, c in (CHI2_3 if degrees is None else {p: chi2_quantile_exact(p / 100, degrees) for p in CHI2_3}).items()]
    more = [F.avg(F.when(F.col(status) == 0, (F.col(won) == 2).cast("double"))).alias("won_closed")] if won else []
    more += [F.max(F.when(F.col(status) == 0, F.col(spread))).alias("max_spread")] if spread else []
    out = df.groupBy(*keys).agg(F.count_if(ok).alias("usable"), F.count_if(F.col(status) == 1).alias("runaway"), F.count_if(F.col(status) == 2).alias("errors"), *rates, *more)
    out = with_quantiles(out, df.where(ok), keys, lr, {"q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99})
    return with_quantiles(out, df.where(F.col(status) == 0), keys, spread, {"median_spread": 0.5}) if spread else out


def p_discrepancy(df: DataFrame, keys: list[str], p: str, steps: int = 200, top: float = 0.2) -> DataFrame:
    """F(x) - x of p-values on a grid of `steps` points up to `top`, with a two-error band.

    Values are counted by grid cell first; only cells are cumulated.
    """
    cell = F.ceil(F.col(p) * (steps / top) - 1e-9).cast("int")
    m = df.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("m"))
    counts = df.where(F.col(p).isNotNull()).withColumn("k", F.greatest(cell, F.lit(1))).where(F.col("k") <= steps).groupBy(*keys, "k").agg(F.count("*").alias("c"))
    grid = m.select(*keys, "m", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k"))
    full = grid.join(counts, [*keys, "k"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("k") * top / steps
    return full.withColumn("x", x).select(*keys, "k", (F.sum("c").over(w) / F.col("m") - F.col("x")).alias("gap"), (2 * F.sqrt(F.col("x") * (1 - F.col("x")) / F.col("m"))).alias("band"))


def first_crossing(gaps: DataFrame, keys: list[str], steps: int = 200, top: float = 0.2, at: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """Where each curve first lies above its band (x, null if nowhere), and its gaps at grid points next to `at`."""
    x = F.col("k") * top / steps
    near = [F.max(F.when(F.col("k") == round(a * steps / top), F.col("gap"))).alias(f"gap{round(100 * a)}") for a in at]
    return gaps.groupBy(*keys).agg(F.min(F.when(F.col("gap") > F.col("band"), x)).alias("clears_at"), F.max_by("gap", F.abs("gap")).alias("largest_gap"), *near)


def diff_vs_recorded(found: DataFrame, recorded: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Difference to recorded values of the same keys, and the worst of all."""
    r = recorded.select(*keys, F.col(value).alias("recorded"))
    return tables.joined(found, r, keys).select(*keys, value, "recorded", (F.col(value) - F.col("recorded")).alias("diff"))


def worst_diff(diffs: DataFrame) -> DataFrame:
    return diffs.agg(F.max(F.abs("diff")).alias("worst"), F.count("*").alias("n"))


def paired_lr(df: DataFrame, keys: list[str], free: list[str], one: list[str]) -> DataFrame:
    """Per design: LR from the best free and restricted starts of each sample, which start won
    how often, the starts' largest spreads, and tails."""
    best = lambda cs: F.greatest(*cs) if len(cs) > 1 else F.col(cs[0])
    least = lambda cs: F.least(*cs) if len(cs) > 1 else F.col(cs[0])
    wins = [F.count_if(F.array_position(F.array(*cs), best(cs)) == k + 1).alias(f"won_{kind}{k + 1}") for kind, cs in (("free", free), ("one", one)) for k in range(len(cs))]
    spreads = [F.max(best(cs) - least(cs)).alias(f"spread_{kind}") for kind, cs in (("free", free), ("one", one))]
    lr = df.withColumn("lr", 2 * (best(free) - best(one)))
    out = lr.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("lr").alias("mean_lr"), F.max("lr").alias("max_lr"), F.count_if(F.col("lr") >= CHI2_3[1]).alias("n_far"), F.count_if(F.col("lr") >= CHI2_3[5]).alias("n_tail"), F.count_if(F.col("lr") < 0).alias("n_negative"), *wins, *spreads)
    return with_quantiles(out, lr, keys, "lr", {"q50": 0.5, "q90": 0.9, "q95": 0.95})


def bootstrap_starts(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col(second) > F.col(first) + 1e-6).alias("second_better"), F.count_if(finite(first).isNull() & finite(second).isNull()).alias("n_dropped")
    )


def lr_test(fits: DataFrame, keys: list[str], degrees: int, loglik: str = "loglik", restriction: str = "restriction") -> DataFrame:
    """LR = 2 (free - one) from rows of the two restrictions, with its chi-square p-value."""
    wide = fits.groupBy(*keys).pivot(restriction, ["free", "one"]).agg(F.max(loglik))
    out = wide.withColumn("lr", 2 * (F.col("free") - F.col("one")))
    return out.withColumn("p", chi2_sf(F.greatest("lr", F.lit(0.0)), degrees))


def best_start(fits: DataFrame, keys: list[str], start: str = "start", loglik: str = "loglik") -> DataFrame:
    """The best of all starts, which it was, and the spread."""
    return fits.groupBy(*keys).agg(F.max(loglik).alias("best"), F.max_by(start, loglik).alias("winner"), (F.max(loglik) - F.min(loglik)).alias("spread"))


def restricted_check(fits: DataFrame, keys: list[str], loglik: str = "loglik", restriction: str = "restriction", tolerance: float = 1e-6) -> DataFrame:
    """Whether the best restricted start is no better than the best free one, as it must be."""
    wide = fits.groupBy(*keys).pivot(restriction, ["free", "one"]).agg(F.max(loglik))
    return wide.withColumn("valid", F.col("one") <= F.col("free") + tolerance)


def bootstrap_pvalue(draws: DataFrame, keys: list[str], observed: str, lr: str = "lr") -> DataFrame:
    """(1 + draws at or above the observed) / (draws + 1), with its error and the 95th percentile."""
    ok = finite(lr).isNotNull()
    n, hits = F.count_if(ok), F.count_if(ok & (F.col(lr) >= F.col(observed)))
    p = (1 + hits) / (n + 1)
    out = draws.groupBy(*keys).agg(n.alias("n"), p.alias("p"), F.sqrt(p * (1 - p) / n).alias("se_p"), F.count_if(ok & (F.col(lr) < 0)).alias("n_negative"))
    return with_quantiles(out, draws.where(ok), keys, lr, {"q95": 0.95})


def bootstrap_se(draws: DataFrame, keys: list[str], b: str = "b") -> DataFrame:
    """Deviation of each component of the estimates."""
    each = draws.select(*keys, F.posexplode(b).alias("component", "value"))
    return each.groupBy(*keys, "component").agg(F.stddev_samp("value").alias("se"))
