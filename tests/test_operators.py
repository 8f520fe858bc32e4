"""Small checks of operators that SQL doesn't cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def _walk(spark, n=300, p=3, seed=0, systems=2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(systems):
        common = np.cumsum(rng.normal(size=n))
        x = np.stack([common + rng.normal(size=n) * 0.5 for _ in range(p)], 1)
        rows += [(s, t, *map(float, r)) for t, r in enumerate(x)]
    return spark.createDataFrame(rows, "sys int, d int, " + ", ".join(f"x{k} double" for k in range(p)))


def test_distributions(spark):
    from panelyard.functions import dist

    row = spark.range(1).select(dist.chi2_sf(F.lit(7.8147), 3).alias("a"), dist.chi2_sf(F.lit(9.4877), 4).alias("b"), dist.normal_cdf(F.lit(-1.959964)).alias("c")).first()
    assert abs(row.a - 0.05) < 1e-5 and abs(row.b - 0.05) < 1e-5 and abs(row.c - 0.025) < 1e-6
    assert abs(dist.chi2_sf_exact(7.8147, 3) - 0.05) < 1e-5 and abs(dist.normal_cdf_exact(-1.959964) - 0.025) < 1e-6


def test_chi_square_quantiles(spark):
    from panelyard.functions import dist

    known = {(0.05, 1): 3.841458820694, (0.05, 2): 5.991464547108, (0.01, 3): 11.344866730144, (0.95, 4): 0.710723021397, (0.1, 9): 14.683656573258, (0.5, 30): 29.336031516900, (0.001, 5): 20.515005652432, (1e-9, 2): 41.446531673892}
    for (upper, df), want in known.items():
        got = spark.range(1).select(dist.chi2_quantile(F.lit(upper), df).alias("x")).first()["x"]
        assert abs(got - want) < 1e-9 * want and abs(dist.chi2_quantile_exact(upper, df) - want) < 1e-9 * want
    edge = spark.createDataFrame([(0.0,), (1.0,), (None,), (2.0,)], "u double").select(dist.chi2_quantile(F.col("u"), 3).alias("x")).collect()
    assert all(r["x"] is None for r in edge)


def test_prefix_gram_equals_segment_gram(spark):
    from panelyard.operators import moments, panel

    df = panel.numbered(_walk(spark), ["sys"])
    whole = {(r["sys"], r["k"]): r["value"] for r in moments.prefix_gram(df, "x0", "x1", ["sys"], [50, 210], block=32).collect()}
    for s in (0, 1):
        for k in (50, 210):
            want = df.where((F.col("sys") == s) & (F.col("t") <= k)).agg(F.sum(F.col("x0") * F.col("x1"))).first()[0]
            assert abs(whole[(s, k)] - want) < 1e-9 * max(1, abs(want))


def test_unrestricted_fit_is_reduced_rank_regression(spark):
    from panelyard.operators import moments, rank
    from panelyard.operators.unitroot import square
    from panelyard.plans import fits

    rows, names, s = fits.design(_walk(spark), ["x0", "x1", "x2"], ["sys"])
    for r in moments.gram_rows(rows, names, ["sys"]).collect():
        g = square(r["g"], s.size)
        lam, v, logdet = rank.johansen(g, r["n"], s)
        f = rank.fit([g], [r["n"]], s, v[:, :2], None, None)
        assert abs(f.loglik - rank.rank_loglik(lam, logdet, r["n"], 3, 2)) < 1e-6 * abs(f.loglik)


def test_free_fit_is_no_worse_and_segments_help(spark):
    from panelyard.plans import fits

    df = _walk(spark)
    iid = {r["sys"]: r for r in fits.iid(df, ["x0", "x1", "x2"], ["sys"]).collect()}
    reg = {r["sys"]: r for r in fits.regime(df, ["x0", "x1", "x2"], ["sys"], [150]).collect()}
    for s in (0, 1):
        assert iid[s]["lr"] >= -1e-6 and iid[s]["error"] is None
        assert reg[s]["loglik_free"] >= iid[s]["loglik_free"] - 1e-6
        assert np.allclose(iid[s]["b"], 1, atol=0.2)


def test_partition_count_changes_nothing(spark):
    from panelyard.operators import moments

    df = _walk(spark)
    found = []
    for n in (1, 8, 50):
        g = moments.gram(df.repartition(n), ["x0", "x1"], ["sys"]).orderBy("sys", "i", "j").collect()
        found.append([r["value"] for r in g])
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])


def test_failed_systems_become_rows(spark):
    from panelyard.operators import panel  # noqa: F401
    from panelyard.plans import fits

    df = _walk(spark, systems=1).unionByName(spark.createDataFrame([(9, t, 1.0, 1.0, 1.0) for t in range(50)], "sys int, d int, x0 double, x1 double, x2 double"))
    out = {r["sys"]: r for r in fits.iid(df, ["x0", "x1", "x2"], ["sys"]).collect()}
    assert out[9]["error"] and out[9]["lr"] is None and out[0]["error"] is None


def test_read_results_skips_torn_lines(spark, tmp_path):
    from panelyard.sources import results

    p = tmp_path / "size_iid_M400.txt"
    p.write_text("1 2.0 3.0\n2 1.0\n3 x 1.0\n1 5.0 6.0\n4 NaN 1.0\n5 1 2 3\n\n")
    got = {r["j"]: r["x"] for r in results.read_results(spark, str(p), 2).collect()}
    assert got == {1: [5.0, 6.0], 4: [None, 1.0]}


def test_resume_append_is_idempotent(spark, tmp_path):
    from panelyard.sources import results

    plan = spark.createDataFrame([("a", k) for k in range(5)], "spec string, j int")
    job = lambda todo: todo.withColumn("v", F.col("j") * 2)
    path = str(tmp_path / "out")
    assert results.resume_append(plan.where("j < 3"), path, ["spec", "j"], job, ["spec"]).count() == 3
    assert results.resume_append(plan, path, ["spec", "j"], job, ["spec"]).count() == 5
    assert results.resume_append(plan, path, ["spec", "j"], job, ["spec"]).count() == 5


def test_read_panels(spark, tmp_path):
    from panelyard.sources import panels

    (tmp_path / "m.txt").write_text("2001 1 2 3 NA 5 6 7 8 9 10 11 12\n2002 NA NA 1.5 NA NA NA NA NA NA NA NA NA\n")
    got = panels.read_year_month_matrix(spark, {"F1": str(tmp_path / "m.txt")})
    assert got.count() == 12 and got.agg(F.sum("value")).first()[0] == pytest.approx(78 - 4 + 1.5)
    (tmp_path / "s.txt").write_text("2001-01-15 3.5\n2001-02-15 4.5\n")
    rows = panels.read_date_value(spark, str(tmp_path / "s.txt"), "spot").orderBy("d").collect()
    assert [(str(r["d"]), r["value"]) for r in rows] == [("2001-01-01", 3.5), ("2001-02-01", 4.5)]


def test_bootstrap_rank_has_right_size(spark):
    from panelyard.operators import resample

    out = resample.bootstrap_rank(_walk(spark, n=80, systems=1), ["x0", "x1", "x2"], ["sys"], 2, 30, 3, chunk=7)
    rows = out.collect()
    assert sorted(r["j"] for r in rows) == list(range(1, 31)) and all(math.isfinite(r["lr"]) and r["lr"] >= 0 for r in rows)
    assert {r["j"]: r["lr"] for r in rows} == {r["j"]: r["lr"] for r in resample.bootstrap_rank(_walk(spark, n=80, systems=1), ["x0", "x1", "x2"], ["sys"], 2, 30, 3, chunk=30).collect()}


def test_scale_brackets_are_each_systems_own(spark):
    from panelyard.plans import fits

    rng, rows = np.random.default_rng(4), []
    n, columns = 200, ["x0", "x1"]
    for name, b in ((0, 2.0), (1, -2.0)):
        v = np.abs(rng.normal(size=n))
        common = np.cumsum(rng.normal(size=n) * np.exp(b * v / 2))
        x = np.stack([common + rng.normal(size=n) * np.exp(b * v / 2) for _ in columns], 1)
        rows += [(name, t, float(v[t]), *map(float, x[t])) for t in range(n)]
    df = spark.createDataFrame(rows, "sys int, d int, v double, x0 double, x1 double")
    joint = {r["sys"]: r for r in fits.scale(df, columns, ["sys"], "v").collect()}
    assert all(r["converged"] for r in joint.values()) and joint[1]["b_free"] - joint[0]["b_free"] > 2  # covariance times exp(-b u)
    for k in (0, 1):
        alone = fits.scale(df.where(F.col("sys") == k), columns, [], "v").first()
        for kind in ("free", "one"):
            assert abs(alone[f"b_{kind}"] - joint[k][f"b_{kind}"]) < 1e-3
            assert abs(alone[f"loglik_{kind}"] - joint[k][f"loglik_{kind}"]) < 1e-6


@pytest.mark.parametrize("model", ["quadratic", "log-precision"])
def test_driven_fit_says_whether_it_converged(spark, model):
    from panelyard.operators import panel
    from panelyard.plans import driven

    rows = panel.volatility_driver(_walk(spark, p=2, systems=1).drop("sys").coalesce(1), ["x0", "x1"], [])
    short = driven.fit(rows, ["x0", "x1"], [], "v", model, most=1).first()
    assert not short["converged_free"] and not short["converged_one"] and short["iters_free"] == 1
    whole = driven.fit(rows, ["x0", "x1"], [], "v", model).first()
    assert whole["converged_free"] and whole["converged_one"] and 1 < whole["iters_free"] <= 60
    assert whole["loglik_free"] >= short["loglik_free"]


def test_specifications_in_one_table(spark):
    from panelyard.plans import compare

    df = _walk(spark, n=120, p=2, systems=2)
    recorded = spark.createDataFrame([("iid", 1.0, 2.0)], "spec string, loglik_free double, loglik_one double")
    got = compare.with_recorded(compare.spec_fits(df, ["x0", "x1"], ["sys"], [60]), recorded, ["spec"]).collect()
    assert {(r["sys"], r["spec"]) for r in got} == {(k, n) for k in (0, 1) for n in compare.EIGHT}
    for r in got:
        assert r["error"] is None and len(r["b"]) == 1 and abs(r["lr"] - 2 * (r["loglik_free"] - r["loglik_one"])) < 1e-6 and r["lr"] > -1e-4
        assert (r["diff_free"] is None) == (r["spec"] != "iid")
        assert r["diff_free"] is None or abs(r["diff_free"] - (r["loglik_free"] - 1)) < 1e-9
    by = {(r["sys"], r["spec"]): r["loglik_free"] for r in got}
    assert all(by[(k, "regime")] >= by[(k, "iid")] - 1e-6 for k in (0, 1))


def test_bootstraps_use_the_panels_own_statistics(spark):
    from panelyard.operators import moments, rank
    from panelyard.plans import boot, fits

    df, columns = _walk(spark, n=90, p=2), ["x0", "x1"]
    rows, names, s = fits.design(df, columns, ["sys"])
    trace = {(r["sys"], r["r"]): r["trace"] for r in rank.trace_test(moments.gram_rows(rows, names, ["sys"]), ["sys"], s).collect()}
    got = {(r["sys"], r["r0"]): r for r in boot.rank_pvalues(df, columns, ["sys"], 39, 3).collect()}
    assert set(got) == set(trace) and all(r["n"] == 39 and abs(r["observed"] - trace[k]) < 1e-9 for k, r in got.items())
    assert all(got[(k, 0)]["p"] <= 0.05 for k in (0, 1))
    lr = boot.lr_pvalues(df, columns, ["sys"], [45], 8, 3).collect()
    assert sorted((r["sys"], r["spec"]) for r in lr) == [(0, "iid"), (0, "regime"), (1, "iid"), (1, "regime")]
    assert all(r["n"] == 8 and r["observed"] >= -1e-6 for r in lr)


def test_grids_count_p_values_and_own_cuts(spark):
    from panelyard.operators import moments, panel
    from panelyard.plans import compare, fits

    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, 20.0), (1, 0, None)], "s1 int, s2 int, lr double")
    r = fits.grid_summary(grid, [], 3).first()
    assert (r["n"], r["n_above"], r["n_failed"]) == (2, 1, 1) and abs(r["max_p"] - 0.801252) < 1e-5
    df = panel.numbered(_walk(spark, n=500), ["sys"])
    at = spark.createDataFrame([(0, 30), (1, 480)], "sys int, k int")
    got = {(r["sys"], r["k"]) for r in moments.prefix_gram(df, "x0", "x0", ["sys"], at, block=32).collect()}
    assert got == {(0, 30), (1, 480)}
    p = [("all", s, k, x) for s, xs in (("regime", (0.01, 0.2)), ("scale", (0.04, 0.5))) for k, x in zip("ab", xs)]
    said = {r["spec"]: r for r in compare.seasonal_summary(spark.createDataFrame(p, "system string, spec string, seasonal string, p double"), ["system"]).collect()}
    assert said["regime"]["n_rejects"] == said["scale"]["n_rejects"] == 1 and abs(said["scale"]["gap"] - 0.03) < 1e-9 and abs(said["regime"]["spread"] - 0.19) < 1e-9


def _driven_panel(spark, b, system, seed=3, n=400):
    """Two series whose covariance is scaled by exp(-b u), with a driver column v."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n)
    x, rows = np.zeros((n, 2)), []
    common = np.cumsum(rng.normal(size=n))
    for t in range(n):
        x[t] = common[t] * 0 + (x[t - 1] if t else 0) + rng.normal(size=2) * math.exp(-b * v[t] / 2)
        if t:
            x[t, 1] = x[t, 1] - 0.4 * (x[t - 1, 1] - x[t - 1, 0])
    for t in range(n):
        rows.append((*system, t, *map(float, x[t]), float(v[t])))
    return rows


KEYED = "k1 string, k2 string, d int, x0 double, x1 double, v double"


def test_scale_has_the_models_sign_and_depends_on_its_system_alone(spark):
    from panelyard.plans import fits

    rows = _driven_panel(spark, 2.0, ("p", None)) + _driven_panel(spark, -1.5, (None, "p"), 4) + _driven_panel(spark, 0.5, ("q", "r"), 5)
    df = spark.createDataFrame(rows, KEYED)
    both = {(r["k1"], r["k2"]): r for r in fits.scale(df, ["x0", "x1"], ["k1", "k2"], "v").collect()}
    assert len(both) == 3 and all(r["converged"] and r["error"] is None for r in both.values())
    for key, b in ((("p", None), 2.0), ((None, "p"), -1.5), (("q", "r"), 0.5)):
        assert abs(both[key]["b_free"] - b) < 0.25
    alone = fits.scale(df.where("k1 = 'p'").drop("k1", "k2"), ["x0", "x1"], [], "v").first()
    assert abs(alone["loglik_free"] - both["p", None]["loglik_free"]) < 1e-9 and abs(alone["b_free"] - both["p", None]["b_free"]) < 1e-9
    passes = {(r["k1"], r["k2"]): r for r in fits.scale(df, ["x0", "x1"], ["k1", "k2"], "v", tol=1e-5, long=0).collect()}
    assert all(abs(passes[k]["loglik_free"] - r["loglik_free"]) < 1e-4 and abs(passes[k]["b_one"] - r["b_one"]) < 1e-3 for k, r in both.items())


@pytest.mark.parametrize("model", ["quadratic", "quadratic-factor", "log-precision"])
def test_driven_fits_keep_systems_apart_on_any_partitioning(spark, model):
    from panelyard.plans import driven

    rows = _driven_panel(spark, 0.3, ("p", None), n=150) + _driven_panel(spark, -0.2, (None, "p"), 4, 150) + [("z", "z", t, 1.0, 1.0, 0.1) for t in range(30)]
    df = spark.createDataFrame(rows, KEYED)
    a = {(r["k1"], r["k2"]): r for r in driven.fit(df.repartition(7), ["x0", "x1"], ["k1", "k2"], "v", model, most=40).collect()}
    assert set(a) == {("p", None), (None, "p"), ("z", "z")} and a["z", "z"]["error"] and a["p", None]["loglik_free"] != a[None, "p"]["loglik_free"]
    assert all(r["lr"] > -1e-4 for k, r in a.items() if k != ("z", "z"))
    b = {(r["k1"], r["k2"]): r for r in driven.fit(df.repartition(2), ["x0", "x1"], ["k1", "k2"], "v", model, most=40, long=0).collect()}
    assert all(abs(b[k]["loglik_free"] - a[k]["loglik_free"]) < 1e-5 and b[k]["iters_one"] == a[k]["iters_one"] for k in (("p", None), (None, "p")))


def test_known_precisions_and_autoregression(spark):
    from panelyard.plans import driven, fits

    rng = np.random.default_rng(1)
    e, rows = np.zeros(2), []
    x = np.zeros(2)
    for t in range(600):
        e = 0.6 * e + rng.normal(size=2)
        x = x + e + np.array([0, -0.3 * (x[1] - x[0])])
        rows.append((t, *map(float, x)))
    df = spark.createDataFrame(rows, "d int, x0 double, x1 double")
    plain, auto = fits.iid(df, ["x0", "x1"], []).first(), fits.ar1(df, ["x0", "x1"], []).first()
    assert auto["converged_free"] and auto["lr"] > -1e-6 and auto["loglik_free"] > plain["loglik_free"] - 1
    one = df.withColumn("w", F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    known = driven.fixed_fits(df, ["x0", "x1"], [], one.select("d", "w")).first()
    # With unit precisions the likelihood is that of least squares: check it on the rows.
    found = {r["d"]: r for r in df.collect()}
    y = np.array([[found[t]["x0"], found[t]["x1"]] for t in range(600)])
    dy = np.diff(y, axis=0)
    z = np.hstack([y[1:-1], dy[:-1], np.ones((598, 1))])
    ss = ((dy[1:] - z @ np.linalg.lstsq(z, dy[1:], rcond=None)[0]) ** 2).sum()
    free = -598 * math.log(2 * math.pi) - ss / 2  # full rank: an upper bound of one relation's
    assert known["loglik_free"] <= free + 1e-6 and known["loglik_one"] <= known["loglik_free"] + 1e-6 and free - known["loglik_free"] < 20


def test_flat_directions(spark):
    from panelyard.operators import covariance

    df = spark.createDataFrame([(k % 2, float(x)) for k, x in enumerate(np.random.default_rng(0).gamma(2, size=400))], "s int, v double")
    rng = np.random.default_rng(3)
    for q in (1, 2, 3):
        got = covariance.flat_directions(df, "v", rng.normal(size=(4, q)).tolist(), ["s"]).collect()
        assert [r["nullity"] for r in got] == [q * (q - 1) // 2] * 2


def test_quantiles_equal_sorting(spark):
    from panelyard.operators import quantiles

    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=30_000), "b": rng.integers(0, 5, 25_000).astype(float), "c": np.array([3.0]), None: rng.normal(size=11)}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"q0": 0.0, "q01": 0.001, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r["k"]: r for r in quantiles.quantiles(df, ["k"], "x", probs).collect()}
    assert set(got) == set(data)
    for k, xs in data.items():
        assert np.allclose([got[k][c] for c in probs], [np.quantile(xs, p) for p in probs.values()], rtol=0, atol=1e-12)


def test_ranks_and_low_shares_equal_sorting(spark):
    from panelyard.operators import replication

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=3000).round(2), rng.normal(size=3000)
    df = spark.createDataFrame([("s", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k string, j int, x double, e double")
    low = lambda v: np.searchsorted(np.sort(v), v, "left")
    want = np.corrcoef(low(x), low(y))[0, 1]
    assert abs(replication.spearman(df, "x", "e", ["k"], parts=7).first()["rho"] - want) < 1e-12
    order = np.lexsort((np.arange(3000), x))[:300]
    assert abs(replication.low_share(df, ["k"], "x").first()["share_low"] - (y[order] ** 2).sum() / (y**2).sum()) < 1e-12


def test_unit_roots_with_trend_equal_least_squares(spark):
    from panelyard.operators import unitroot

    x = np.cumsum(np.random.default_rng(5).normal(size=90))
    df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "k string, d int, value double")
    for lags, trend in ((0, "c"), (2, "ct"), (3, "c")):
        dx = np.diff(x)
        n = len(dx) - lags
        z = np.column_stack([x[lags:-1], *(dx[lags - i : len(dx) - i] for i in range(1, lags + 1)), np.ones(n), *([np.arange(n)] if trend == "ct" else [])])
        b, ss = np.linalg.lstsq(z, dx[lags:], rcond=None)[:2]
        t = b[0] / math.sqrt(ss[0] / (n - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        got = unitroot.adf(df, ["k"], lags, trend).first()
        assert got["n"] == n and abs(got["t"] - t) < 1e-8
    flat = spark.createDataFrame([("s", t, 1.0) for t in range(9)], "k string, d int, value double")
    assert unitroot.adf(flat, ["k"], 1).first()["t"] is None


def test_accurate_tails(spark):
    from panelyard.functions import dist

    xs = [0.0, 1e-9, 0.3, 1.0, 2.0, 3.7, 8.0, 25.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(dist.erfc(F.col("x")).alias("e"), dist.chi2_sf(F.col("x"), 5).alias("c")).collect()
    assert all(abs(r["e"] / math.erfc(x) - 1) < 1e-11 for r, x in zip(got, xs, strict=True) if x < 26)
    assert all(abs(r["c"] - dist.chi2_sf_exact(x, 5)) < 1e-12 for r, x in zip(got, xs, strict=True))


def test_bootstrap_lr_is_not_negative(spark):
    from panelyard.operators import resample

    out = resample.bootstrap_lr(_walk(spark, n=80, systems=2), ["x0", "x1", "x2"], ["sys"], [40], 12, 3, chunk=5).collect()
    assert sorted((r["sys"], r["j"]) for r in out) == [(s, j) for s in (0, 1) for j in range(1, 13)]
    assert all(r["lr"] > -1e-5 for r in out if r["lr"] is not None) and sum(r["lr"] is not None for r in out) > 20


def test_panel_files_and_namespaces(spark, tmp_path):
    from panelyard.sources import panels, results

    df = spark.createDataFrame([("2001-01-17", 2.0), ("2001-02-11", 4.0)], "d string, x double").withColumn("d", F.col("d").cast("date"))
    panels.write_panel(df, str(tmp_path / "p"), ["x"])
    back = panels.load_panel(spark, str(tmp_path / "p"), ["l_x"]).orderBy("d").collect()
    assert [round(r["l_x"], 6) for r in back] == [0.693147, 1.386294]
    (tmp_path / "s.txt").write_text("2001-01-17 3.5\nbad line\n2001-02-29 1\n2001-03-02 x\n2001-02-11 4.5\n")
    assert [str(r["d"]) for r in panels.read_date_value(spark, str(tmp_path / "s.txt"), "s", unit=None).orderBy("d").collect()] == ["2001-01-17", "2001-02-11"]
    results.write_namespaced(df, str(tmp_path / "n"), "F1")
    results.write_namespaced(df.limit(1), str(tmp_path / "n"), "spot")
    one = results.read_namespaced(spark, str(tmp_path / "n"), "spot")
    assert one.count() == 1 and len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(numeraire" in one._jdf.queryExecution().toString()


def test_registry_takes_new_specifications(spark):
    from panelyard.plans import compare, fits

    @compare.register("twice", None, "one Gram a system")
    def twice(rows, columns, system, breaks, date, fixed):
        return fits.iid(rows, columns, system, date, fixed).withColumn("loglik_free", F.col("loglik_free") * 2)

    try:
        got = {(r["sys"], r["spec"]): r for r in compare.spec_fits(_walk(spark), ["x0", "x1", "x2"], ["sys"], [150], names=["iid", "twice", "regime", "ar1"]).collect()}
        assert len(got) == 8 and all(abs(got[s, "twice"]["loglik_free"] - 2 * got[s, "iid"]["loglik_free"]) < 1e-9 for s in (0, 1))
        assert all(0 <= r["p"] <= 1 for r in got.values())
    finally:
        del compare.SPECS["twice"]


def test_break_profile_equals_separate_fits(spark):
    from panelyard.plans import fits

    df, columns = _walk(spark, n=90, p=2, systems=2), ["x0", "x1"]
    for step in (1, 7):
        got = {(r["sys"], r["k"]): r for r in fits.break_profile(df, columns, ["sys"], 12, 15, step).collect()}
        ks = sorted({k for _, k in got})
        assert ks == list(range(12, 88 - 15 + 1, step)) and len(got) == 2 * len(ks)
        for k in ks[:: max(1, len(ks) // 3)]:
            for r in fits.regime(df, columns, ["sys"], [k]).collect():
                assert abs(got[r["sys"], k]["loglik_free"] - r["loglik_free"]) < 1e-3
    best = {r["sys"]: r for r in fits.best_break(fits.break_profile(df, columns, ["sys"], 12, 15), ["sys"]).collect()}
    profile = fits.break_profile(df, columns, ["sys"], 12, 15).collect()
    for k, r in best.items():
        assert r["loglik"] == max(x["loglik_free"] for x in profile if x["sys"] == k) and r["n_cuts"] == 62
    assert fits.break_profile(df.where("false"), columns, ["sys"]).count() == 0


def test_systems_have_breaks_of_their_own(spark):
    from panelyard.operators import panel
    from panelyard.plans import draws, fits, scoring

    df, columns = _walk(spark, n=160, p=2, systems=3), ["x0", "x1"]
    names = sorted(r["sys"] for r in df.select("sys").distinct().collect())
    own = {names[0]: [60, 110], names[1]: [80, 90]}
    table = spark.createDataFrame(list(own.items()), f"sys {df.schema['sys'].dataType.simpleString()}, breaks array<int>")
    together = fits.regime(df, columns, ["sys"], table).cache()
    got = {r["sys"]: r for r in together.collect()}
    for k in names:  # as one by one; a system that isn't in the table has no break
        alone = fits.regime(df.where(F.col("sys") == k), columns, ["sys"], own.get(k, [])).first()
        assert abs(got[k]["loglik_free"] - alone["loglik_free"]) < 1e-6 and len(got[k]["params_free"]["precisions"]) == len(own.get(k, [])) + 1
    scored = {r["sys"]: r["loglik"] for r in scoring.loglik(scoring.score(df, columns, ["sys"], together, "regime", breaks=table)).collect()}
    assert all(abs(scored[k] - r["loglik_free"]) < 1e-4 for k, r in got.items())
    grid = {(r["sys"], r["s1"], r["s2"]): r["loglik_free"] for r in fits.break_grid(df, columns, ["sys"], table, 1).collect()}
    assert len(grid) == 18 and all(abs(grid[k, 0, 0] - got[k]["loglik_free"]) < 1e-4 for k in own)
    drawn = draws.draws(df, columns, ["sys"], together, "regime", 2, 3, breaks=table).collect()
    assert len(drawn) == 6 and all(r["lr"] >= 0 for r in drawn)
    rows = panel.with_segments(panel.numbered(df, ["sys"]), ["sys"], table).groupBy("sys", "segment").count().collect()
    assert {(r["sys"], r["segment"]): r["count"] for r in rows if r["sys"] == names[0]} == {(names[0], 0): 60, (names[0], 1): 50, (names[0], 2): 50}


def test_break_grid_equals_separate_fits(spark):
    from panelyard.plans import fits

    df = _walk(spark, n=160, p=2, systems=2)
    grid = {(r["sys"], r["s1"], r["s2"]): r for r in fits.break_grid(df, ["x0", "x1"], ["sys"], (60, 110), 2).collect()}
    assert len(grid) == 50
    for s1, s2 in ((0, 0), (-2, 1), (2, 2)):
        for r in fits.regime(df, ["x0", "x1"], ["sys"], [60 + s1, 110 + s2]).collect():
            assert abs(grid[r["sys"], s1, s2]["loglik_free"] - r["loglik_free"]) < 1e-3 and abs(grid[r["sys"], s1, s2]["loglik_one"] - r["loglik_one"]) < 1e-3


def test_specifications_and_blocks_read_their_source_once(spark, tmp_path):
    """Every pass reads the panel as written, and the summary the grid as written."""
    from panelyard.plans import compare

    at = str(tmp_path / "source")
    _walk(spark, n=120, p=2).withColumn("d", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d") * 30)).write.parquet(at)
    df, columns = spark.read.parquet(at), ["x0", "x1"]
    one = compare.spec_fits(df, columns, ["sys"], [60], names=["iid", "regime", "scale"])
    grid = compare.seasonal_grid(df, columns, ["sys"], [60], ["none", "quarter"], ["regime", "scale"])
    summary = compare.seasonal_summary(grid, ["sys"])
    folders = lambda x: {f.rsplit("/", 2)[-2].split("-")[0] for f in x.inputFiles()}
    assert folders(one) == folders(grid) == {"panel"} and folders(summary) == {"grid"}
    p = {(r["sys"], r["spec"], r["seasonal"]): r["p"] for r in grid.collect()}
    got = {(r["sys"], r["spec"]): r for r in summary.collect()}
    assert len(p) == 8 and len(got) == 4
    for (k, spec), r in got.items():
        own = [p[k, spec, x] for x in ("none", "quarter")]
        other = [p[k, "scale" if spec == "regime" else "regime", x] for x in ("none", "quarter")]
        assert r["n"] == 2 and abs(r["spread"] - abs(own[0] - own[1])) < 1e-9 and abs(r["gap"] - min(abs(a - b) for a, b in zip(own, other, strict=True))) < 1e-9


def test_segments_that_are_too_short_have_no_fit(spark):
    from panelyard.plans import fits

    df, columns = _walk(spark, n=160, p=2, systems=3), ["x0", "x1"]  # 158 rows of 7 columns
    names = sorted(r["sys"] for r in df.select("sys").distinct().collect())
    own = {names[0]: [45, 46], names[1]: [6], names[2]: [7]}
    table = spark.createDataFrame(list(own.items()), f"sys {df.schema['sys'].dataType.simpleString()}, breaks array<int>")
    got = {r["sys"]: r for r in fits.regime(df, columns, ["sys"], table).collect()}
    assert len(got) == 3 and got[names[0]]["error"].startswith("1 rows") and got[names[1]]["error"].startswith("6 rows")
    assert all(got[k]["loglik_free"] is None and got[k]["params_free"] is None for k in names[:2])
    assert got[names[2]]["error"] is None and got[names[2]]["loglik_free"] >= got[names[2]]["loglik_one"] - 1e-6
    # A series that stands still in a segment can be fitted exactly there.
    still = df.withColumn("x0", F.when(F.col("d") > F.lit(sorted(r["d"] for r in df.select("d").distinct().collect())[99]), 3.0).otherwise(F.col("x0")))
    rows = fits.regime(still, columns, ["sys"], [110]).collect()
    assert len(rows) == 3 and all(r["loglik_free"] is None and r["error"] for r in rows)
    # Breaks that meet or cross give the segments that they bound, in a grid too.
    grid = {(r["sys"], r["s1"], r["s2"]): r for r in fits.break_grid(df, columns, ["sys"], (80, 82), 12).where("s1 IN (0, 2, 12) AND s2 IN (-2, -1, 0)").collect()}
    for s1, s2 in ((12, -2), (12, 0), (2, 0), (0, -1)):
        for r in fits.regime(df, columns, ["sys"], sorted({80 + s1, 82 + s2})).collect():
            g = grid[r["sys"], s1, s2]
            assert (g["error"] is None) == (r["error"] is None) == (abs(80 + s1 - 82 - s2) not in range(1, 7))
            assert r["error"] or abs(g["loglik_free"] - r["loglik_free"]) < 1e-3
    profile = {r["k"]: r for r in fits.break_profile(df, columns, ["sys"], 5, 12).where(F.col("sys") == names[0]).collect()}
    assert profile[6]["error"] and profile[6]["loglik_free"] is None and profile[7]["error"] is None


def test_portmanteau_and_arch_equal_their_formulas(spark):
    from panelyard.functions import dist
    from panelyard.operators import unitroot

    rng = np.random.default_rng(6)
    e = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(t, *map(float, r)) for t, r in enumerate(e)], "d int, a double, b double")
    n, lags, k = 120, 4, 2
    c = [sum(np.outer(e[t], e[t - s]) for t in range(s, n)) / n for s in range(lags + 1)]
    inv = np.linalg.inv(c[0])
    q = n * n * sum(np.trace(c[s].T @ inv @ c[s] @ inv) / (n - s) for s in range(1, lags + 1))
    got = unitroot.hosking(df, ["a", "b"], lags, k, []).first()
    assert abs(got["q"] - q) < 1e-8 and got["df"] == 4 * (lags - 1) and abs(got["p"] - dist.chi2_sf_exact(q, 12)) < 1e-12
    sq = e[:, 0] ** 2
    z = np.column_stack([np.ones(n - 3), *(sq[3 - i : n - i] for i in range(1, 4))])
    res = sq[3:] - z @ np.linalg.lstsq(z, sq[3:], rcond=None)[0]
    lm = (n - 3) * (1 - (res**2).sum() / ((sq[3:] - sq[3:].mean()) ** 2).sum())
    assert abs(unitroot.arch_lm_q(df.withColumn("k", F.lit(1)), ["k"], 3, "a").first()["lm"] - lm) < 1e-8


def test_lag_choice_equals_least_squares(spark):
    from panelyard.operators import unitroot

    rng = np.random.default_rng(9)
    x = np.zeros(150)
    for t in range(2, 150):
        x[t] = x[t - 1] + 0.5 * (x[t - 1] - x[t - 2]) + rng.normal()
    df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "k string, d int, value double")
    top, dx = 6, np.diff(x)

    def fit(p, first):
        rows = range(first, len(dx))
        z = np.array([[x[t], 1.0, *(dx[t - i] for i in range(1, p + 1))] for t in rows])
        y = dx[first:]
        b, ss = np.linalg.lstsq(z, y, rcond=None)[:2]
        return b, ss[0], z, len(y)

    aic = []
    for p in range(top + 1):
        _, ss, z, n = fit(p, top)
        aic.append(n * (math.log(2 * math.pi * ss / n) + 1) + 2 * z.shape[1])
    best = int(np.argmin(aic))
    b, ss, z, n = fit(best, best)
    t = b[0] / math.sqrt(ss / (n - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
    got = unitroot.adf_aic(df, ["k"], max_lag=top).first()
    assert (got["lag"], got["n"]) == (best, n) and abs(got["t"] - t) < 1e-8


def test_unit_root_of_a_series_is_its_own(spark):
    """Largest lags come from each series' length: neighbours change nothing, short or flat series have no statistic."""
    from panelyard.operators import unitroot

    rng = np.random.default_rng(4)
    sizes = {"a": 150, "long": 2000, "short": 20, "three": 3, "one": 1, None: 60}
    rows = [(k, t, float(v)) for k, n in sizes.items() for t, v in enumerate(np.cumsum(rng.normal(size=n)))]
    rows += [("flat", t, 1.0) for t in range(50)] + [("a", 500, None), ("a", 501, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, d int, value double")
    every = {r["k"]: r for r in unitroot.adf_aic(df, ["k"]).collect()}
    assert set(every) == {*sizes, "flat"}
    assert all(every[k]["t"] is None for k in ("three", "one", "flat"))
    assert every["a"]["n"] == 149 - every["a"]["lag"] and every["short"]["t"] is not None
    for k in ("a", "long", "short", None):
        alone = unitroot.adf_aic(df.where(F.col("k").eqNullSafe(k)), ["k"]).first()
        assert alone == every[k]
    # By sums over rows, as for long series.
    for limit in (None, 3):
        whole = {r["k"]: r for r in unitroot.adf_aic(df, ["k"], max_lag=limit).collect()}
        summed = {r["k"]: r for r in unitroot.adf_aic(df, ["k"], max_lag=limit, long=10).collect()}
        assert set(summed) == set(whole)
        for k, r in whole.items():
            assert (summed[k]["lag"], summed[k]["n"]) == (r["lag"], r["n"]) and (r["t"] is None or abs(summed[k]["t"] - r["t"]) < 1e-7)
    assert unitroot.schwert(150) == 14 and unitroot.schwert(20) == 8 and unitroot.schwert(3) == 0


def test_companion_roots_equal_the_simulated_system(spark):
    from panelyard.operators import moments, rank
    from panelyard.operators.unitroot import square
    from panelyard.plans import fits

    rows, names, s = fits.design(_walk(spark, n=200, p=2, systems=1), ["x0", "x1"], ["sys"])
    grams = moments.gram_rows(rows, names, ["sys"])
    got = rank.companion_roots(grams, ["sys"], s, 1).first()["roots"]
    r = grams.first()
    g = square(r["g"], s.size)
    f = rank.fit([g], [r["n"]], s, rank.johansen(g, r["n"], s)[1][:, :1], None, None)
    pi, gamma = f.alpha @ f.beta.T, f.psi[:, :2]
    # x_t = (I + Pi + G) x_{t-1} - G x_{t-2}: the roots of its determinant's polynomial.
    grid = [np.linalg.det(np.eye(2) * z * z - (np.eye(2) + pi + gamma) * z + gamma) for z in (0, 1, -1, 2, -2)]
    poly = np.polyfit([0, 1, -1, 2, -2], grid, 4)
    assert np.allclose(sorted(np.abs(np.roots(poly)), reverse=True), got, atol=1e-6) and abs(got[0] - 1) < 1e-6


def test_bootstrap_draws_are_resumed(spark, tmp_path):
    from panelyard.operators import resample
    from panelyard.plans import boot

    df, columns = _walk(spark, n=70, p=2), ["x0", "x1"]
    path = str(tmp_path / "draws")
    assert boot.resumed_lr(df, columns, ["sys"], [], 5, 3, path, chunk=4).count() == 10
    before = {(r["sys"], r["j"]): r["lr"] for r in spark.read.parquet(path).collect()}
    after = {(r["sys"], r["j"]): r["lr"] for r in boot.resumed_lr(df, columns, ["sys"], [], 9, 3, path, chunk=4).collect()}
    whole = {(r["sys"], r["j"]): r["lr"] for r in resample.bootstrap_lr(df, columns, ["sys"], [], 9, 3, chunk=4).collect()}
    assert len(after) == 18 and all(after[k] == v for k, v in before.items()) and all(abs(after[k] - v) < 1e-9 for k, v in whole.items())


def test_many_samples_decompose_as_one(spark):
    from panelyard.operators import rank

    rng = np.random.default_rng(0)
    w = rng.normal(size=(6, 80, 7))
    s = rank.Shape(2, 3, 2)
    for q, lam in zip(w, rank.eigenvalues(w, s), strict=True):
        assert np.allclose(lam, rank.johansen(q.T @ q, 80, s)[0], atol=1e-12)


def test_many_fits_equal_single_ones():
    from panelyard.operators import rank

    rng = np.random.default_rng(4)
    s, n = rank.Shape(2, 2, 3), (70, 50)
    grams = []
    for k in n:
        w = rng.normal(size=(5, k, 7)).cumsum(1) * 0.1 + rng.normal(size=(5, k, 7))
        grams.append(w.transpose(0, 2, 1) @ w)
    beta = np.broadcast_to(rank.spread_basis(np.ones(1)), (5, 2, 1))
    hm, h = rank.basis_restriction(1)
    for restriction, single in (((hm, h), (hm, h)), (None, (np.zeros((2, 0)), beta[0].ravel("F")))):
        _, a, value = rank.many_fits(grams, list(n), s, beta, restriction, tol=1e-13, most=2000)
        for k in range(5):
            f = rank.fit([g[k] for g in grams], list(n), s, beta[k], *single, tol=1e-13, most=2000)
            assert abs(value[k] - f.loglik) < 1e-6 and np.allclose(a[k], f.loadings, atol=1e-4)
