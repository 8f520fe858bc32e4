"""Fits' parameters in rows: scoring, standard errors, given restrictions."""

import math

import numpy as np
import pytest


@pytest.fixture(scope="module")
def rows(spark):
    """Two systems (one with a null key) of three series that share a trend, with a driver."""
    from panelyard.operators import panel

    rng, out = np.random.default_rng(12), []
    for name, n in (("a", 220), (None, 180)):
        level = np.cumsum(rng.normal(size=n))
        x = np.column_stack([level, level + rng.normal(size=n), level + np.convolve(rng.normal(size=n + 3), [1, 0.5, 0.2, 0.1], "valid")])
        x *= 0.1
        out += [(name, t, *map(float, v)) for t, v in enumerate(x)]
    df = spark.createDataFrame(out, "k string, d int, a double, b double, c double")
    return panel.volatility_driver(df, ["a", "b", "c"], ["k"]).cache()


COLUMNS, BREAKS = ["a", "b", "c"], [70, 140]


def _fit(rows, model):
    from panelyard.plans import driven, fits

    if model == "iid":
        return fits.iid(rows, COLUMNS, ["k"])
    if model == "regime":
        return fits.regime(rows, COLUMNS, ["k"], BREAKS)
    if model == "ar1":
        return fits.ar1(rows, COLUMNS, ["k"])
    if model.startswith("scale"):
        return fits.scale(rows, COLUMNS, ["k"], "v", **({"long": 10, "rounds": 12} if model == "scale-long" else {}))
    return driven.fit(rows, COLUMNS, ["k"], "v", model)


@pytest.mark.parametrize("model", ["iid", "regime", "scale", "scale-long", "quadratic", "quadratic-factor", "log-precision", "ar1"])
def test_scored_rows_give_the_fits_likelihood(rows, model):
    from panelyard.plans import scoring

    found = _fit(rows, model).cache()
    fitted = {r["k"]: r for r in found.collect()}
    name = model.replace("-long", "")
    for kind in ("free", "one"):
        scored = scoring.score(rows, COLUMNS, ["k"], found, name, kind, BREAKS)
        got = {r["k"]: r["loglik"] for r in scoring.loglik(scored).collect()}
        assert set(got) == {"a", None}
        for k, value in got.items():
            assert abs(value - fitted[k][f"loglik_{kind}"]) < 2e-3, (k, kind)
    first = scored.rows.where("k = 'a'").orderBy("t").first()
    at = fitted["a"]["params_one"]
    assert np.allclose(np.array(at["beta"]), [[-1, -1], [1, 0], [0, 1]])
    x, z = [first[f"x_{c}"] for c in COLUMNS], [first[f"z1_{c}"] for c in COLUMNS]
    want = np.array(at["alpha"]) @ np.array(at["beta"]).T @ x + np.array(at["psi"])[:, :3] @ z + np.array(at["psi"])[:, 3]
    assert np.allclose([first[f"f{i}"] for i in range(3)], want) and np.allclose([first[f"det{i}"] for i in range(3)], np.array(at["psi"])[:, 3])


def test_long_and_short_scale_searches_agree(rows):
    short, long = ({r["k"]: r for r in _fit(rows, m).collect()} for m in ("scale", "scale-long"))
    for k, r in short.items():
        for c in ("loglik_free", "loglik_one"):
            assert abs(r[c] - long[k][c]) < 1e-6
        assert abs(r["b_free"] - long[k]["b_free"]) < 1e-4 and long[k]["error"] is None


def test_standard_errors_are_those_of_the_curvature(rows):
    from panelyard.operators import rank
    from panelyard.plans import scoring

    iid = {r["k"]: r for r in _fit(rows, "iid").collect()}
    for model in ("iid", "regime", "log-precision"):
        found = _fit(rows, model).cache()
        scored = scoring.score(rows, COLUMNS, ["k"], found, model, "free", BREAKS)
        got = {r["k"]: r["se"] for r in scoring.standard_errors(scored).collect()}
        if model == "iid":
            assert all(np.allclose(got[k], iid[k]["se"], rtol=1e-5) for k in got)
        own = scored.rows.where("k = 'a'").toPandas()
        at = {r["k"]: r for r in found.collect()}["a"]["params_free"]
        w = np.array([[own[f"w{min(i, j)}_{max(i, j)}"] for j in range(3)] for i in range(3)]).transpose(2, 0, 1)
        x, rest = own[[f"x_{c}" for c in COLUMNS]].to_numpy(), own[["e0", "e1", "e2"]].to_numpy() + own[[f"x_{c}" for c in COLUMNS]].to_numpy() @ np.array(at["beta"]) @ np.array(at["alpha"]).T
        hm, h = rank.basis_restriction(2)

        def loss(b):
            beta = (hm @ b + h).reshape(3, 2, order="F")
            e = rest - x @ beta @ np.array(at["alpha"]).T  # noqa: B023
            return np.einsum("ti,tij,tj->", e, w, e) / 2  # noqa: B023

        b, step = -np.array(at["beta"])[0], 1e-4
        curve = np.array([[(loss(b + step * (u + v)) - loss(b + step * (u - v)) - loss(b - step * (u - v)) + loss(b - step * (u + v))) / (4 * step * step) for v in np.eye(2)] for u in np.eye(2)])
        assert np.allclose(got["a"], np.sqrt(np.diag(np.linalg.inv(curve))), rtol=1e-4)


def test_given_restrictions(spark, rows):
    from panelyard.operators import moments, rank
    from panelyard.plans import fits

    design, names, s = fits.design(rows, COLUMNS, ["k"])
    grams = moments.gram_rows(design, names, ["k"]).cache()
    hm, h = rank.basis_restriction(2)
    ones = rank.spread_basis(np.ones(2)).ravel("F")
    size = s.p * (2 + s.p2)
    weak = np.delete(np.eye(size), [0, s.p], 1)  # no loadings of the first series
    double = np.hstack([hm, hm])
    table = [
        ("none", None, None, None, None), ("basis", hm.tolist(), h.tolist(), None, None), ("twice", double.tolist(), h.tolist(), None, None),
        ("ones", [[]] * 6, ones.tolist(), None, None), ("weak", None, None, weak.tolist(), None), ("both", [[]] * 6, ones.tolist(), weak.tolist(), [0.0] * size),
        ("same", np.kron(np.eye(2), np.array([[1.0, 0], [-1, 1], [0, -1]])).tolist(), None, None, None), ("bad", [[1.0]], [0.0], None, None),
    ]
    given = spark.createDataFrame([(k, *t) for k in ("a", None) for t in table], f"k string, {rank.RESTRICTION}")
    got = {(r["k"], r["name"]): r for r in rank.restricted_fits(grams, ["k"], s, 2, given).collect()}
    assert len(got) == 16
    iid = {r["k"]: r for r in rank.spec_fits(grams, ["k"], s).collect()}
    for k in ("a", None):
        of = lambda name: got[k, name]  # noqa: B023, E731
        assert of("bad")["error"] and of("bad")["lr"] is None
        for name in ("none", "basis", "twice"):  # these restrict nothing
            assert of(name)["df"] == 0 and abs(of(name)["lr"]) < 1e-5 and of(name)["p"] is None
        assert of("ones")["df"] == 2 and abs(of("ones")["lr"] - iid[k]["lr"]) < 1e-5
        assert abs(of("ones")["p"] - math.exp(-of("ones")["lr"] / 2)) < 1e-9
        assert of("weak")["df"] == 2 and of("weak")["lr"] > 0 and np.allclose(of("weak")["params"]["alpha"][0], 0)
        assert of("both")["df"] == 4 and of("both")["lr"] > max(of("weak")["lr"], of("ones")["lr"]) - 1e-6
        assert of("same")["df"] == 2 and abs(of("same")["lr"] - of("ones")["lr"]) < 1e-4  # the same space, another basis
    # A wholly fixed model is just its likelihood.
    g = rank.square({r["k"]: r for r in grams.collect()}["a"]["g"], s.size)
    n = grams.where("k = 'a'").first()["n"]
    beta, loadings = ones.reshape(3, 2, order="F"), rank.loadings_of([g], s, ones.reshape(3, 2, order="F")) * 0.9
    fixed = spark.createDataFrame([("a", "fixed", [[]] * 6, ones.tolist(), [[]] * size, loadings.ravel("F").tolist())], f"k string, {rank.RESTRICTION}")
    r = rank.restricted_fits(grams, ["k"], s, 2, fixed).first()
    b = np.hstack([np.eye(3), -loadings[:, :2] @ beta.T, -loadings[:, 2:]])
    want = -n / 2 * (3 * (1 + math.log(2 * math.pi)) + np.linalg.slogdet(b @ g @ b.T / n)[1])
    assert abs(r["loglik"] - want) < 1e-6 and r["df"] == 3 * 2 + 2 * 3 - 4 + 3 * s.p2


def test_score_without_systems_and_missing_fits(spark, rows):
    from panelyard.plans import fits, scoring

    one = rows.where("k = 'a'").drop("k")
    found = fits.iid(one, COLUMNS, [])
    got = scoring.loglik(scoring.score(one, COLUMNS, [], found, "iid")).first()
    assert abs(got["loglik"] - found.first()["loglik_free"]) < 1e-4
    part = fits.iid(rows.where("k = 'a'"), COLUMNS, ["k"])
    assert [r["k"] for r in scoring.loglik(scoring.score(rows, COLUMNS, ["k"], part, "iid")).collect()] == ["a"]
