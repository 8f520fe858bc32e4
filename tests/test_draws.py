"""Fits of many samples at once, and bootstrap draws of every covariance model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

COLUMNS = ["a", "b", "c"]


def _panel(n, seed):
    rng = np.random.default_rng(seed)
    level = np.cumsum(rng.normal(size=n))
    return 0.1 * np.column_stack([level, level + rng.normal(size=n), level + rng.normal(size=n)])


def _samples(count, n):
    w, v = [], []
    for j in range(count):
        x = _panel(n + 2, j)
        d = np.diff(x, axis=0)
        w.append(np.hstack([d[1:], x[1:-1], d[:-1], np.ones((n, 1))]))
        own = np.abs(d[:-1]).mean(1)
        v.append(own / own.mean())
    return np.array(w), np.array(v)


@pytest.mark.parametrize("model", ["quadratic", "quadratic-factor", "log-precision"])
def test_many_driven_fits_equal_single_ones(model):
    from panelyard.operators import batched, rank
    from panelyard.plans import draws, driven

    w, v = _samples(5, 200)
    s = rank.Shape(3, 3, 4)
    est = draws.Estimator(model, s, [], 1e-10, 300)
    single = driven.search({str(j): (w[j].T @ w[j], 200) for j in range(5)}, s, model, lambda kernel, params: {k: kernel(w[int(k)], v[int(k)], f) for k, f in params.items()}, 1e-10, 300)
    grams = w.transpose(0, 2, 1) @ w
    for kind in ("free", "one"):
        beta, a = est.closed(w)
        if kind == "one":
            beta = np.broadcast_to(est.ones, beta.shape)
            a = rank.many_loadings(grams, s, beta)
        value, state = est.fit(w, v, est.start(w, beta, a), kind == "free")
        want = np.array([single[str(j)][f"loglik_{kind}"] for j in range(5)])
        assert np.allclose(value, want, atol=2e-4)
        # A sample's fit is its own, whatever else is in the batch.
        alone = est.fit(w[3:4], v[3:4], {k: x[3:4] for k, x in est.start(w, beta, a).items()}, kind == "free")[0]
        assert abs(alone[0] - value[3]) < 1e-5
        at = batched.path(model, state, v)
        e = batched.residuals(w, state)
        assert np.allclose((batched.objective(at, e) - 200 * 3 * np.log(2 * np.pi)) / 2, value, atol=1e-4)
    assert np.allclose(-state["beta"][:, 0], 1)


def test_log_det_and_scale_search():
    from panelyard.operators import batched, rank
    from panelyard.plans import fits

    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 4, 50))
    m = np.einsum("ikt,jkt->ijt", x, x)
    assert np.allclose(batched.log_det(m), np.linalg.slogdet(m.transpose(2, 0, 1))[1])
    m[:, :, 3] -= 100 * np.eye(4)
    assert batched.log_det(m)[3] == -np.inf
    w, v = _samples(4, 150)
    s = rank.Shape(3, 3, 4)
    for free in (True, False):
        value, slope, b = batched.scale_search(w, v, s, free)
        for j in range(4):
            one = fits._scale_one(w[j], v[j], s, 17, 1e-8)
            kind = "free" if free else "one"
            assert abs(value[j] - one[f"loglik_{kind}"]) < 1e-5 and abs(slope[j] - one[f"b_{kind}"]) < 1e-3
            assert b is None if not free else np.allclose(b[j], one["b"], atol=1e-4)
    v[0, 3] = 60  # a driver whose weights would leave cross products no digits
    assert np.isfinite(batched.scale_search(w, v, s, True)[0]).all()


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, t, *map(float, x)) for k, n, seed in (("a", 90, 3), (None, 70, 4)) for t, x in enumerate(_panel(n, seed))]
    return spark.createDataFrame(rows, "k string, d int, a double, b double, c double").withColumns({"c1": F.cos(F.col("d") * 0.5)}).cache()


MODELS = ["iid", "regime", "scale", "scale-log", "quadratic-factor", "log-precision", "log-precision-log"]


def test_p_values_of_every_model(spark, df):
    from panelyard.plans import draws

    got = {(r["k"], r["spec"]): r for r in draws.pvalues(df, COLUMNS, ["k"], MODELS, [25, 48], 12, 7, fixed=["c1"], chunk=5).collect()}
    assert set(got) == {(k, m) for k in ("a", None) for m in MODELS}
    for r in got.values():
        assert r["n_negative"] == 0 and 0 < r["p"] <= 1 and r["n"] == 12


@pytest.mark.parametrize("model", ["iid", "log-precision"])
def test_draws_depend_on_seed_replicate_and_row_alone(spark, df, tmp_path, model):
    from panelyard.plans import draws
    from panelyard.sources import tables

    found = tables.written(draws.fitted_models(df, COLUMNS, ["k"], [model], [], fixed=["c1"]), "fits")
    rows = lambda b, seed=7, chunk=4, data=df, **more: {(r["k"], r["j"]): r for r in draws.draws(data, COLUMNS, ["k"], found, model, b, seed, chunk=chunk, fixed=["c1"], tol=1e-9, most=200, **more).collect()}
    first = rows(8)
    assert set(first) == {(k, j) for k in ("a", None) for j in range(1, 9)}
    for other in (rows(8, data=df.repartition(7, "d")), rows(10, chunk=3)):
        assert all(abs(other[k]["lr"] - r["lr"]) < 1e-4 and np.allclose(other[k]["b"], r["b"], atol=1e-5) for k, r in first.items())
    assert any(abs(rows(8, seed=8)[k]["lr"] - r["lr"]) > 1e-3 for k, r in first.items())
    assert any(abs(rows(8, scheme="normal")[k]["lr"] - r["lr"]) > 1e-3 for k, r in first.items())
    free = rows(8, under="free")
    assert all(r["lr"] is None and len(r["b"]) == 2 for r in free.values())
    path = str(tmp_path / "draws")
    more = {"fixed": ["c1"], "tol": 1e-9, "most": 200}
    draws.resumed(df, COLUMNS, ["k"], found, model, 3, 7, path, chunk=4, **more).count()
    kept = {(r["k"], r["j"]): r["lr"] for r in draws.resumed(df, COLUMNS, ["k"], found, model, 8, 7, path, chunk=4, **more).collect()}
    assert set(kept) == set(first) and all(abs(v - first[k]["lr"]) < 1e-4 for k, v in kept.items())


def test_one_draw_written_out(spark, df):
    """The first replicate of the iid model, by hand."""
    import hashlib

    from panelyard.operators import rank
    from panelyard.plans import draws
    from panelyard.sources import tables

    data = df.where("k = 'a'").drop("c1")
    found = tables.written(draws.fitted_models(data, COLUMNS, ["k"], ["iid"], []), "fits")
    got = draws.draws(data, COLUMNS, ["k"], found, "iid", 1, 5).first()
    x = data.orderBy("d").select(*COLUMNS).toPandas().to_numpy()
    s, at = rank.Shape(3, 3, 4), found.first()["params_one"]
    alpha, beta, psi = (np.array(at[k]) for k in ("alpha", "beta", "psi"))
    d = np.diff(x, axis=0)
    e = d[1:] - x[1:-1] @ beta @ alpha.T - np.hstack([d[:-1], np.ones((len(d) - 1, 1))]) @ psi.T
    path = [x[0], x[1]]
    for t in range(len(e)):
        sign = 1 if hashlib.md5(f"5|1|{t + 1}".encode()).hexdigest()[0] < "8" else -1
        path.append(path[-1] + alpha @ beta.T @ path[-1] + psi[:, :3] @ (path[-1] - path[-2]) + psi[:, 3] + sign * e[t])
    path = np.array(path)
    d = np.diff(path, axis=0)
    w = np.hstack([d[1:], path[1:-1], d[:-1], np.ones((len(e), 1))])
    free, one = rank.both_fits([w.T @ w], [len(w)], s)
    assert abs(got["lr"] - 2 * (free.loglik - one.loglik)) < 1e-3 and np.allclose(got["b"], rank.implied_b(free.beta), atol=1e-3)


def test_normal_weights_equal_their_column(spark):
    from panelyard.operators import resample

    got = spark.range(1, 6).select(F.col("id").alias("t"), F.explode(F.array(F.lit(1), F.lit(2))).alias("j"))
    got = {(r["j"], r["t"]): r["w"] for r in got.withColumn("w", resample.normal(3, F.col("j"), F.col("t"))).collect()}
    want = resample.normals(3, [1, 2], 5)
    assert all(abs(want[j - 1, t - 1] - w) < 1e-9 for (j, t), w in got.items())


def test_standard_errors_under_the_free_fit(spark, df):
    from panelyard.plans import draws

    got = draws.standard_errors(df, COLUMNS, ["k"], ["iid", "scale"], [], 10, 7).collect()
    assert len(got) == 8 and all(r["n"] == 10 and 0 < r["se"] < 1 for r in got)
