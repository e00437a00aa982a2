"""Values of operators that SQL cannot express, against plain numpy and loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.functions import kernels as K
from tickspark.functions import special
from tickspark.operators import models, pairs, performance, resample, risk, strategies, validation

DAY = 86_400_000_000_000


def returns(seed=1, n=160, curves=("a", "b", "c"), scale=0.01):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=n)
    return {c: scale * (rng.normal(size=n) * (k + 1) + 0.5 * common) + 0.0005 for k, c in enumerate(curves)}


def table(spark, rets):
    rows = [(c, i * DAY, i, float(v)) for c, x in rets.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "curve_id string, ts_ns long, i long, ret double")


def integral(f, a, b, n=20_001):
    x = np.linspace(a, b, n)
    return float(np.trapezoid(f(x), x))


def test_distributions(spark):
    """M2: densities integrated numerically, known values, and inverses."""
    t_pdf = lambda v: lambda x: math.gamma((v + 1) / 2) / math.gamma(v / 2) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    chi_pdf = lambda k: lambda x: x ** (k / 2 - 1) * np.exp(-x / 2) / (2 ** (k / 2) * math.gamma(k / 2))
    rows = [(0.7, 5.0), (-1.3, 9.0), (2.2, 30.0)]
    df = spark.createDataFrame(rows, "x double, v double")
    got = df.select("x", "v", special.t_cdf(F.col("x"), F.col("v")).alias("t"), special.t_pdf(F.col("x"), F.col("v")).alias("p"), special.chi2_cdf(F.abs("x") * 3, F.lit(4)).alias("c"), special.f_cdf(F.abs("x"), F.lit(3), F.col("v")).alias("f"), special.normal_quantile(special.normal_cdf(F.col("x"))).alias("q")).collect()
    for r in got:
        x, v = r["x"], r["v"]
        assert abs(r["t"] - (0.5 + integral(t_pdf(v), 0, x))) < 1e-8 and abs(r["p"] - t_pdf(v)(x)) < 1e-10
        assert abs(r["c"] - integral(chi_pdf(4), 0, abs(x) * 3)) < 1e-8
        beta = math.gamma(1.5) * math.gamma(v / 2) / math.gamma(1.5 + v / 2)
        f_pdf = lambda y: (3 / v) ** 1.5 * np.sqrt(y) * (1 + 3 * y / v) ** (-(3 + v) / 2) / beta  # noqa: E731, B023
        assert abs(r["f"] - integral(f_pdf, 0, abs(x), 200_001)) < 1e-6
        assert abs(r["q"] - x) < 1e-5


def test_welch(spark):
    """M3: two samples of unequal variance and size."""
    x = returns()
    df = table(spark, {"a": x["a"], "b": x["b"][:90]}).withColumn("k", F.lit(1))
    got = models.t_test_2(df, ["k"], "ret", "curve_id", "a", "b").first()
    a, b = x["a"], x["b"][:90]
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert got["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    assert got["df"] == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
    assert 0 < got["p_value"] < 1


def test_pca(spark):
    """Components, scores and the way back against an eigen decomposition."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, e array<double>").repartition(5)
    fit = models.pca_fit(df, "e")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(fit["values"], values) and np.allclose(fit["ratio"].sum(), 1) and np.allclose(fit["mean"], x.mean(axis=0))
    back = models.pca_inverse(models.pca_transform(df, "e", fit, 6), fit, 6).orderBy("i").collect()
    assert np.allclose([r["restored"] for r in back], x)
    assert np.allclose([r["scores"] for r in back], (x - x.mean(axis=0)) @ fit["components"].T)


def test_garch_fit_and_value_at_risk(spark):
    """The fit beats a grid of parameters; R4: the forecast by a plain loop."""
    rng = np.random.default_rng(4)
    s, x = 1e-4, []
    for _ in range(400):
        x.append(rng.normal() * math.sqrt(s))
        s = 5e-6 + 0.15 * x[-1] ** 2 + 0.8 * s
    df = table(spark, {"g": np.array(x), "short": np.array(x[:20])})
    fit = {r["curve_id"]: r for r in models.garch_fit(df, ["curve_id"]).collect()}
    assert fit["short"]["omega"] is None
    y = np.array(x) - np.mean(x)
    v = float(np.var(x, ddof=1))

    def loglik(a, b):
        h = K.garch_filter(None, y, v * (1 - a - b), a, b)[1]
        return -0.5 * float((np.log(2 * math.pi) + np.log(h) + y * y / h).sum())

    grid = [loglik(a, b) for a in np.arange(0.01, 0.4, 0.03) for b in np.arange(0.05, 0.95, 0.05) if a + b < 0.999]
    g = fit["g"]
    assert g["loglik"] == pytest.approx(loglik(g["alpha"], g["beta"])) and g["loglik"] >= max(grid) - 0.05
    got = {r["curve_id"]: r for r in risk.var_garch(df, ["curve_id"], 0.95).collect()}
    h = g["omega"] / (1 - g["alpha"] - g["beta"])
    for e in y:
        h = g["omega"] + g["alpha"] * e * e + g["beta"] * h
    assert got["g"]["var"] == pytest.approx(1.6448536 * math.sqrt(h) - np.mean(x), rel=1e-6)


def test_chain(spark):
    """Dwell and long-run shares of a chain."""
    p = np.array([[0.7, 0.1, 0.1, 0.1], [0.2, 0.5, 0.2, 0.1], [0.1, 0.1, 0.6, 0.2], [0.25, 0.25, 0.25, 0.25]])
    names = sorted(K.REGIMES)
    df = spark.createDataFrame([(a, b, float(p[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "from string, to string, p double")
    got = {r["from"]: r for r in models.chain_summary(df).collect()}
    share = np.linalg.matrix_power(p, 300)[0]
    for i, a in enumerate(names):
        assert got[a]["share"] == pytest.approx(share[i]) and got[a]["dwell"] == pytest.approx(1 / (1 - p[i, i]))


def test_labels_follow_the_snapshots(spark):
    """The regimes of a path that collapses."""
    x = np.concatenate((np.full(120, 0.0001), np.full(60, -0.01), np.full(60, 0.0001)))
    got = [r["state"] for r in models.label_regimes(table(spark, {"a": x})).orderBy("seq").collect()]
    path = 100 * np.cumprod(1 + x)
    import pandas as pd

    from tickspark.operators.windows import snapshot_step

    want = snapshot_step(None, pd.DataFrame({"ts_ns": np.arange(1, len(x) + 1) * 1_000_000_000, "price": path, "size": 1.0}), publish_ns=0)[1]["state"]
    assert got == list(want) and "crisis" in got and got[0] == "calm"


def test_comparison_of_two_curves(spark):
    """Common times only; metrics of both and the second against the first."""
    x = returns(5, 60)
    nav = lambda r, c: table(spark, {c: r}).select(F.lit("k").alias("key"), "ts_ns", F.lit(0).alias("seq"), F.element_at(F.array(*[F.lit(float(v)) for v in 100 * np.cumprod(1 + r)]), (F.col("i") + 1).cast("int")).alias("nav"))
    a, b = nav(x["a"], "a"), nav(x["b"], "b").where(f"ts_ns >= {10 * DAY}")
    got = performance.compare_curves(a, b).first()
    ra, rb = x["a"][11:], x["b"][11:]
    assert got["a_total_return"] == pytest.approx(np.prod(1 + ra) - 1) and got["b_total_return"] == pytest.approx(np.prod(1 + rb) - 1)
    assert got["beta"] == pytest.approx(np.cov(rb, ra)[0, 1] / ra.var(ddof=1)) and got["corr"] == pytest.approx(np.corrcoef(ra, rb)[0, 1])
    assert got["b_sharpe"] == pytest.approx(rb.mean() * 365 / (rb.std(ddof=1) * math.sqrt(365)))
    assert performance.compare_curves(a.where(f"ts_ns < {5 * DAY}"), b).count() == 0


def test_bca_interval(spark):
    """By its formula, from the replicates and the leave-one-out values."""
    from statistics import NormalDist

    rng = np.random.default_rng(6)
    x = rng.gamma(2.0, 1.0, 40)
    boot = np.array([rng.choice(x, 40).mean() for _ in range(500)])
    jack = (x.sum() - x) / 39
    b = spark.createDataFrame([("k", float(v), float(x.mean())) for v in boot], "k string, v double, e double")
    j = spark.createDataFrame([("k", float(v)) for v in jack], "k string, v double")
    got = performance.bca_interval(b, j, ["k"], "v", "e", 0.9).first()
    z, d = NormalDist(), jack.mean() - jack
    z0, a = z.inv_cdf(float((boot < x.mean()).mean())), (d**3).sum() / (6 * ((d**2).sum()) ** 1.5)
    for p, end in ((0.05, got["lo"]), (0.95, got["hi"])):
        q = z0 + z.inv_cdf(p)
        assert end == pytest.approx(np.quantile(boot, z.cdf(z0 + q / (1 - a * q))), abs=2e-4)
    assert not got["fallback"] and performance.bca_interval(b.withColumn("e", F.lit(1e9)), j, ["k"], "v", "e").first()["fallback"]


def test_fitted_ensemble_weights(spark):
    """The minimum variance against its formula, equal risk against its condition; O15 over uneven times."""
    x = returns(8, 200)
    df = table(spark, x)
    got = {m: {r["curve_id"]: r["weight"] for r in validation.ensemble_weights(df, m).collect()} for m in ("min_variance", "risk_parity")}
    cov = np.cov([x[c] for c in "abc"])
    w = np.linalg.solve(cov, np.ones(3))
    w = np.maximum(w, 0) / np.maximum(w, 0).sum()
    assert np.allclose([got["min_variance"][c] for c in "abc"], w, atol=1e-6)
    w = np.array([got["risk_parity"][c] for c in "abc"])
    part = w * (cov @ w)
    assert np.allclose(part, part.mean(), rtol=1e-6) and w.sum() == pytest.approx(1)
    gaps = df.where("not (curve_id = 'b' and i % 3 = 0)")
    pair = {(r["a"], r["b"]): r for r in validation.cov_matrix(gaps).collect()}
    keep = np.arange(200) % 3 != 0
    assert pair[("a", "b")]["n"] == keep.sum() and pair[("a", "b")]["cov"] == pytest.approx(np.cov(x["a"][keep], x["b"][keep])[0, 1]) and pair[("a", "c")]["n"] == 200


def test_bootstrap_kernel_equals_the_join(spark):
    """V7: arrays in a kernel and rows in joins draw the same paths and give the same 27 metrics."""
    df = table(spark, returns(9, 70, ("a", "b")))
    kernel = {(r["curve_id"], r["run"]): r for r in resample.bootstrap_paths(df, 6, 365.0, seed=4).collect()}
    joined = {(r["curve_id"], r["run"]): r for r in resample.bootstrap_paths(df, 6, 365.0, seed=4, longest=10).collect()}
    assert kernel.keys() == joined.keys() and len(kernel) == 12
    for k, r in joined.items():
        for c in r.asDict():
            a, b = r[c], kernel[k][c]
            assert a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-10), (k, c, a, b)


def test_hash_of_random_choices(spark):
    run, j = np.arange(40), np.arange(25)
    df = spark.createDataFrame([(int(a), int(b)) for a in run for b in j], "run int, j long").select("run", "j", resample.mixed(7, "run", "j").alias("h"))
    want = resample.mixed_array(7, run[:, None], j[None, :])
    assert all(r["h"] == want[r["run"], r["j"]] for r in df.collect())
    u = resample.mixed_array(3, np.arange(400)[:, None], np.arange(400)[None, :]) / resample.PRIME
    assert abs(u.mean() - 0.5) < 0.005 and np.abs(np.histogram(u, 20, (0, 1))[0] / u.size - 0.05).max() < 0.003
    assert abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.01


def test_pair_states_walk(spark):
    z = [0.0, 2.1, 1.0, 0.4, 0.6, 0.3, -2.5, -4.2, 2.2, 2.0, 0.1, 0.0]
    df = spark.createDataFrame([("p", i, v, i == 9) for i, v in enumerate(z)], "pair string, ts_ns long, z double, o boolean")
    got = [(r["state"], r["side"], r["leave"]) for r in pairs.pair_states(df, opened="o").orderBy("ts_ns").collect()]
    d, c, n = "diverged", "converging", "normal"
    assert got == [(n, 0, False), (d, -1, False), (d, -1, False), (c, 0, True), (c, 0, True), (n, 0, False), (d, 1, False), (n, 0, False), (d, -1, False), ("position_open", 0, False), (n, 0, False), (n, 0, False)]


def crossing():
    """Made in a function, so that it travels to the tasks by value."""

    class Crossing(strategies.Strategy):
        """Buys above and sells below a level."""

        out = "ts_ns long, action string, size double"
        defaults = {"level": 1.0, "size": 2.0}
        bounds = {"level": (0.0, 10.0), "size": (1.0, 5.0)}

        def create(self):
            return {"held": 0.0, "ts": None}

        def on_rows(self, state, rows):
            out = []
            for r in rows.itertuples(index=False):
                state["ts"] = r.ts_ns
                want = self.params["size"] if r.price > self.params["level"] else 0.0
                if want != state["held"]:
                    out.append((int(r.ts_ns), "buy" if want else "sell", abs(want - state["held"])))
                    state["held"] = want
            return out

        def on_stop(self, state):
            return [(int(state["ts"]), "flatten", state["held"])] if state["held"] else []

    return Crossing


def test_user_strategies(spark):
    Crossing = crossing()  # noqa: N806
    rows = [(k, i, p) for k, prices in (("a", [0.5, 2.0, 3.0, 0.5]), ("b", [5.0, 4.0])) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "symbol string, ts_ns long, price double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(map(tuple, strategies.run_strategy(df, Crossing(level=1.5), ["symbol"], ["ts_ns"]).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("a", 1, "buy", 2.0), ("a", 3, "sell", 2.0), ("b", 0, "buy", 2.0), ("b", 1, "flatten", 2.0)]
    for bad in ({"level": 11.0}, {"level": math.nan}, {"other": 1.0}, {"size": 0.5}):
        with pytest.raises(ValueError):
            Crossing(**bad)
    with pytest.raises(ValueError):
        pairs.PairsMeanReversion(min_half_life_bars=50.0, max_half_life_bars=10.0)
    assert strategies.whole({"n": 3.0}, "n") == 3
    with pytest.raises(ValueError):
        strategies.whole({"n": 3.5}, "n")


def test_planted_leak_is_found(spark):
    b = spark.createDataFrame([(0, 600)], "lo long, hi long")
    splits, train = validation.cpcv(b, 6, 2, 30)
    groups = validation.fold_groups(b, 6)
    test = splits.where("split = 3").first()["test_group"]
    leak = groups.where(f"group = {test}").select(F.lit(3).alias("split"), *groups.columns).select(train.columns)
    got = validation.is_leak_free(train.unionByName(leak), splits, groups, 30).collect()
    assert [(r["split"], r["group"]) for r in got] == [(3, test)]
