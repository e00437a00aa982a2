"""Distributions, hypothesis tests and fitted models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions import kernels as K
from tickspark.functions import special as S
from tickspark.functions.stretches import over_rows, placed, scan, stretches
from tickspark.plans.catalog import nav, query, r, table, ticks

from .performance import beside, curve_returns, nav_returns

ERF_SQL = "(CASE WHEN ({x}) >= 0 THEN 1 ELSE -1 END * (1 - (((((1.061405429::DOUBLE * ({t}) - 1.453152027) * ({t}) + 1.421413741) * ({t}) - 0.284496736) * ({t}) + 0.254829592) * ({t})) * exp(-({x}) * ({x}))))"


def cdf_sql(x: str) -> str:
    """The normal distribution function in SQL, by the same polynomial."""
    y = f"(({x}) / 1.4142135623730951::DOUBLE)"
    return f"((1 + {ERF_SQL.format(x=y, t=f'(1 / (1 + 0.3275911::DOUBLE * abs{y}))')}) / 2)"


def t_test(df: DataFrame, keys: list[str], col: str, mu: float = 0.0) -> DataFrame:
    """M3: one sample against ``mu``: t, degrees of freedom, two-sided p."""
    g = df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
    g = g.withColumn("t", F.try_divide(F.col("mean") - mu, F.col("sd") / F.sqrt("n"))).withColumn("df", (F.col("n") - 1).cast("double"))
    return g.withColumn("p_value", 2 * (1 - S.t_cdf(F.abs("t"), F.col("df"))))


def t_test_2(df: DataFrame, keys: list[str], col: str, group: str, a: str, b: str, pooled: bool = False) -> DataFrame:
    """M3: two samples, Welch or pooled."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(col)))
    m = df.groupBy(*keys).agg(*[of(f, g).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1, v0, v1 = (F.col(c).cast("double") for c in ("n0", "n1", "v0", "v1"))
    if pooled:
        s = ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)
        se, dof = F.sqrt(s * (1 / n0 + 1 / n1)), n0 + n1 - 2
    else:
        a0, a1 = v0 / n0, v1 / n1
        se, dof = F.sqrt(a0 + a1), (a0 + a1) * (a0 + a1) / (a0 * a0 / (n0 - 1) + a1 * a1 / (n1 - 1))
    m = m.withColumn("t", F.try_divide(F.col("m0") - F.col("m1"), se)).withColumn("df", dof)
    return m.withColumn("p_value", 2 * (1 - S.t_cdf(F.abs("t"), F.col("df"))))


def chi2_gof(df: DataFrame, keys: list[str], observed: str, expected: str) -> DataFrame:
    """M4: cells without expectation are skipped."""
    g = df.where(F.col(expected) > 0).groupBy(*keys).agg(F.sum(F.pow(F.col(observed) - F.col(expected), F.lit(2)) / F.col(expected)).alias("chi2"), (F.count("*") - 1).alias("df"))
    return g.withColumn("p_value", 1 - S.chi2_cdf(F.col("chi2"), F.col("df")))


def ks_p(d: Column, n: Column) -> Column:
    """The limit series of the Kolmogorov distribution, 100 terms."""
    x = d * (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * x * x * k * k))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


def _running_counts(df: DataFrame, keys: list[str], col: str, *weights: Column, length: int | None = None) -> DataFrame:
    """Rows at and below each distinct value, from counts per value; the counts of a long key add up by stretches."""
    counts = {f"_c{i}": w for i, w in enumerate(weights)}
    g = df.groupBy(*keys, col).agg(*[F.sum(w).alias(c) for c, w in counts.items()])
    cut = stretches(g, keys, (col,), length)
    up = cut.done(cut.running(cut.df, {f"_u{c[2:]}": ("sum", F.col(c)) for c in counts}))
    return beside(up, g.groupBy(*keys).agg(*[F.sum(c).alias(f"_n{c[2:]}") for c in counts]), keys)


def ks_1(df: DataFrame, keys: list[str], col: str, cdf, length: int | None = None) -> DataFrame:
    """M5: against a distribution function of the column."""
    g = _running_counts(df, keys, col, F.lit(1), length=length).withColumn("_f", cdf(F.col(col)))
    gap = F.greatest(F.abs(F.col("_u0") / F.col("_n0") - F.col("_f")), F.abs(F.col("_f") - (F.col("_u0") - F.col("_c0")) / F.col("_n0")))
    return g.groupBy(*keys).agg(F.max(gap).alias("d"), F.max("_n0").alias("n")).withColumn("p_value", ks_p(F.col("d"), F.col("n").cast("double")))


def ks_2(df: DataFrame, keys: list[str], col: str, group: str, a: str, b: str, length: int | None = None) -> DataFrame:
    """M6: two samples; null where one of them is empty."""
    is_ = lambda g: F.when(F.col(group) == g, 1).otherwise(0)
    g = _running_counts(df.where(F.col(group).isin(a, b)), keys, col, is_(a), is_(b), length=length)
    gap = F.abs(F.try_divide("_u0", "_n0") - F.try_divide("_u1", "_n1"))
    out = g.groupBy(*keys).agg(F.max(gap).alias("d"), F.max("_n0").alias("n0"), F.max("_n1").alias("n1"))
    return out.withColumn("p_value", F.when(F.col("d").isNotNull(), ks_p(F.col("d"), F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))))


def jarque_bera(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """M7."""
    g = df.groupBy(*keys).agg(F.count(col).alias("n"), F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurt"))
    g = g.withColumn("jb", F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4))
    return g.withColumn("p_value", 1 - S.chi2_cdf(F.col("jb"), F.lit(2)))


def autocorrelation(df: DataFrame, keys: list[str], col: str, lags: int, order: str = "ts_ns", length: int | None = None) -> DataFrame:
    """M8: one row per key and lag."""
    centred = df.join(df.groupBy(*keys).agg(F.avg(col).alias("_m")), keys).withColumn("_d", F.col(col) - F.col("_m"))
    centred = over_rows(centred, keys, lags + 1, lambda d, w: d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}), (order,), length)
    g = centred.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_s"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(f"_c{k}", "_s").alias("rho")) for k in range(1, lags + 1)]))
    return g.select(*keys, "n", pairs.alias("x")).select(*keys, "n", "x.*")


def ljung_box(df: DataFrame, keys: list[str], col: str, lags: int, length: int | None = None) -> DataFrame:
    """M8: sum over the autocorrelations."""
    a = autocorrelation(df, keys, col, lags, length=length)
    g = a.groupBy(*keys, "n").agg(F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))).alias("_s"))
    return g.withColumn("q", F.col("n") * (F.col("n") + 2) * F.col("_s")).withColumn("p_value", 1 - S.chi2_cdf(F.col("q"), F.lit(lags))).drop("_s")


def runs_test(df: DataFrame, keys: list[str], col: str, order: str = "ts_ns", length: int | None = None) -> DataFrame:
    """M9: runs about the mean, rows on it dropped."""
    d = df.join(df.groupBy(*keys).agg(F.avg(col).alias("_m")), keys).where(F.col(col) != F.col("_m")).withColumn("_up", F.col(col) > F.col("_m"))
    d = over_rows(d, keys, 2, lambda rows, w: rows.withColumn("_new", F.coalesce(F.lag("_up").over(w) != F.col("_up"), F.lit(True))), (order,), length)
    g = d.groupBy(*keys).agg(F.count_if("_up").cast("double").alias("n1"), F.count_if(~F.col("_up")).cast("double").alias("n2"), F.count_if("_new").alias("runs"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    mean, var = 2 * n1 * n2 / n + 1, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    return g.withColumn("z", F.try_divide(F.col("runs") - mean, F.sqrt(var))).withColumn("p_value", 2 * (1 - S.normal_cdf(F.abs("z"))))


def pca_fit(df: DataFrame, col: str) -> dict:
    """Mean, components (rows), eigenvalues and ratios of an array column.

    The p * p sums are folded over blocks of rows in the tasks and added up by Spark; the driver gets p * p numbers.
    """

    def sums(batches):
        s, c, n = None, None, 0
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, float) for v in pdf["x"]])
                s, c = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), c + x.T @ x)
                n += len(x)
        if n:
            p = len(s)
            yield pd.DataFrame({"i": np.append(np.repeat(np.arange(p), p), np.arange(p)), "j": np.append(np.tile(np.arange(p), p), np.full(p, -1)), "v": np.append(c.ravel(), s), "n": n})

    got = df.select(F.col(col).cast("array<double>").alias("x")).where("x is not null").mapInPandas(sums, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    p = 1 + max(g["i"] for g in got)
    n = got[0]["n"]
    c, s = np.zeros((p, p)), np.zeros(p)
    for g in got:
        if g["j"] < 0:
            s[g["i"]] = g["v"]
        else:
            c[g["i"], g["j"]] = g["v"]
    mean = s / n
    values, vectors = np.linalg.eigh((c - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order].T
    flip = np.sign(vectors[np.arange(p), np.abs(vectors).argmax(axis=1)])
    total = values[values > 0].sum()
    return {"mean": mean, "components": vectors * flip[:, None], "values": values, "ratio": np.where(values > 0, values, 0) / total}


def pca_transform(df: DataFrame, col: str, fit: dict, k: int) -> DataFrame:
    """Scores on the first ``k`` components, as columns of arithmetic."""
    x = F.zip_with(F.col(col).cast("array<double>"), F.array(*[F.lit(float(m)) for m in fit["mean"]]), lambda a, m: a - m)
    dot = lambda row: F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("_x", x).withColumn("scores", F.array(*[dot(fit["components"][i]) for i in range(k)])).drop("_x")


def pca_inverse(df: DataFrame, fit: dict, k: int) -> DataFrame:
    """Back from ``scores``."""
    return df.withColumn("restored", F.array(*[F.lit(float(m)) + sum((F.get("scores", F.lit(i)) * float(fit["components"][i][j]) for i in range(k)), F.lit(0.0)) for j, m in enumerate(fit["mean"])]))


def garch_filter(df: DataFrame, keys: list[str], omega: float, alpha: float, beta: float, length: int | None = None) -> DataFrame:
    """The conditional variance before each return; affine in the variance, so stretches of a long key compose."""

    def step(state, p: pd.DataFrame):
        state, out = K.garch_filter(state, p["ret"].to_numpy(), omega, alpha, beta)
        return state, {"variance": out}

    return scan(df, keys, ["ts_ns"], step, "variance double", K.garch_carry("ret", omega, alpha, beta), length)


def garch_forecast(variance: Column, omega: float, alpha: float, beta: float, h: int) -> Column:
    """Variance ``h`` steps ahead of the next one."""
    keep = alpha + beta
    long_run = omega / (1 - keep)
    return long_run + (variance - long_run) * keep**h


def garch_fit(rets: DataFrame, keys: list[str]) -> DataFrame:
    """Omega, alpha, beta per key by variance-targeted quasi likelihood; null for less than 32 returns."""

    def nll(a: float, b: float, x: np.ndarray, v: float) -> float:
        if a < 1e-6 or b < 0 or a + b >= 0.9999:
            return 1e300
        _, s = K.garch_filter(None, x, v * (1 - a - b), a, b)
        return float((np.log(s) + x * x / s).sum())

    schema = T.StructType([*[rets.schema[k] for k in keys], *T._parse_datatype_string("n long, omega double, alpha double, beta double, loglik double").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts_ns")["ret"].to_numpy()
        head = {k: [pdf[k].iloc[0]] for k in keys} | {"n": [len(x)]}
        v = float(np.var(x, ddof=1)) if len(x) > 1 else 0.0
        if len(x) < 32 or v <= 0:
            return pd.DataFrame(head | {"omega": [None], "alpha": [None], "beta": [None], "loglik": [None]})
        x = x - x.mean()
        best, at = 1e300, (0.05, 0.9)
        for a, b in ((0.03, 0.95), (0.05, 0.9), (0.1, 0.8), (0.15, 0.6)):
            step, here = 0.04, nll(a, b, x, v)
            while step > 1e-3:
                moved = False
                for da, db in ((step, 0), (-step, 0), (0, step), (0, -step), (step, -step), (-step, step)):
                    c = nll(a + da, b + db, x, v)
                    if c < here - 1e-10:
                        a, b, here, moved = a + da, b + db, c, True
                        break
                step = step if moved else step / 2
            if here < best:
                best, at = here, (a, b)
        a, b = at
        return pd.DataFrame(head | {"omega": [v * (1 - a - b)], "alpha": [a], "beta": [b], "loglik": [-0.5 * (best + len(x) * math.log(2 * math.pi))]})

    return rets.groupBy(*keys).applyInPandas(run, schema)


def fit_regime_chain(labels: DataFrame, key: str = "symbol", smoothing: float = 1.0, length: int | None = None) -> DataFrame:
    """Smoothed transition probabilities (from, to, p) over the four regimes, with the moments of ``from``."""
    paired = over_rows(labels, key, 2, lambda d, w: d.withColumn("from", F.lag("state").over(w)), ("ts_ns", "seq"), length)
    moves = paired.where("`from` is not null and state is not null").groupBy("from", F.col("state").alias("to")).agg(F.count("*").alias("n"))
    spark = labels.sparkSession
    names = spark.createDataFrame([(x,) for x in K.REGIMES], "s string")
    grid = names.select(F.col("s").alias("from")).crossJoin(names.select(F.col("s").alias("to")))
    full = grid.join(moves, ["from", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("from"))
    stats = labels.groupBy(F.col("state").alias("from")).agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sigma"), (F.count("*")).alias("visits"))
    return full.withColumn("p", (F.col("n") + smoothing) / (total + smoothing * len(K.REGIMES))).join(F.broadcast(stats), "from", "left")


def chain_summary(chain: DataFrame) -> DataFrame:
    """Expected dwell and long-run share of each regime, by 200 powers of the 4 by 4 matrix."""
    own = chain.where("from = to").select("from", (1 / (1 - F.col("p"))).alias("dwell"))
    m = chain.groupBy().agg(F.array_sort(F.collect_list(F.struct("from", "to", "p"))).alias("m"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get(F.col("m"), i * 4 + j)["p"]))
    step = lambda v, _: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, i: s + F.get(v, i) * F.get(F.get(F.col("t"), i), j)))
    power = m.select(rows.alias("t")).withColumn("v", F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.array_repeat(F.lit(0.25), 4), step))
    names = F.array_sort(F.array(*map(F.lit, K.REGIMES)))
    share = power.select(F.explode(F.arrays_zip(names.alias("from"), F.col("v").alias("share"))).alias("x")).select("x.from", "x.share")
    return own.join(share, "from")


def label_regimes(rets: DataFrame, s0: float = 100.0, step_ns: int = 1_000_000_000, key: str = "curve_id") -> DataFrame:
    """Returns as a price path on a uniform clock, through the symbol snapshots, with the regime after each."""
    from .performance import compound
    from .windows import SNAPSHOT, snapshot_step

    path = placed(compound(rets, s0, key), key, "seq", start=1)
    path = path.select(F.col(key).alias("symbol"), (F.col("seq") * step_ns).alias("ts_ns"), "seq", F.col("path").alias("price"), F.lit(1.0).alias("size"), "ret")
    return scan(path, ["symbol"], ["seq"], lambda state, p: snapshot_step(state, p, publish_ns=0), SNAPSHOT).select("symbol", "ts_ns", "seq", "ret", "state")


def _rets(spark, sf):
    return curve_returns(spark, sf)


_R = "q AS (SELECT curve_id, ts_ns, r AS ret FROM v_returns WHERE r IS NOT NULL)"


@query("m1_normal_cdf", f"WITH x AS (SELECT seq, (price - 50) / 25 AS x FROM v_ticks) SELECT seq, R6({cdf_sql('x')}) AS cdf, R6(exp(-x * x / 2) / sqrt(2 * pi())) AS pdf FROM x", "v_ticks")
def m1(spark, sf):
    x = ticks(spark, sf).select("seq", ((F.col("price") - 50) / 25).alias("x"))
    return x.select("seq", r(S.normal_cdf(F.col("x"))).alias("cdf"), r(S.normal_pdf(F.col("x"))).alias("pdf"))


@query("m2_distributions")
def m2(spark, sf):
    g = _rets(spark, sf).groupBy("curve_id").agg(F.count("ret").alias("n"), (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.count("ret"))).alias("x"))
    x, n = F.abs("x"), F.col("n")
    return g.select("curve_id", r(S.t_cdf(F.col("x"), n)).alias("t_cdf"), r(S.t_pdf(F.col("x"), n)).alias("t_pdf"), r(S.chi2_cdf(x * 3, F.lit(4))).alias("chi2_cdf"), r(S.f_cdf(x, F.lit(3), n)).alias("f_cdf"), r(S.normal_quantile(S.normal_cdf(F.col("x")))).alias("x_back"))


@query("m3_t_test", f"WITH {_R} SELECT curve_id, count(*) AS n, R6(avg(ret) / (stddev_samp(ret) / sqrt(count(*)))) AS t, (count(*) - 1)::DOUBLE AS df FROM q GROUP BY 1", "v_returns")
def m3(spark, sf):
    return t_test(_rets(spark, sf), ["curve_id"], "ret").select("curve_id", "n", r("t"), "df")


@query("m3_t_test_welch")
def m3w(spark, sf):
    d = _rets(spark, sf).withColumn("all", F.lit("x"))
    return t_test_2(d, ["all"], "ret", "curve_id", "1-URGENT", "5-LOW").select("all", r("t"), r("df"), r("p_value"))


@query("m4_chi2_gof", "WITH c AS (SELECT symbol, floor(size / 10) AS bin, count(*) AS o FROM v_ticks GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY symbol) / 10.0::DOUBLE AS e FROM c) SELECT symbol, R6(sum(pow(o - e, 2) / e)) AS chi2, count(*) - 1 AS df FROM e GROUP BY 1", "v_ticks")
def m4(spark, sf):
    c = ticks(spark, sf).groupBy("symbol", F.floor(F.col("size") / 10).alias("bin")).agg(F.count("*").alias("o"))
    c = c.withColumn("e", F.sum("o").over(Window.partitionBy("symbol")) / 10)
    return chi2_gof(c, ["symbol"], "o", "e").select("symbol", r("chi2"), "df")


@query(
    "m5_ks_1",
    f"""WITH {_R}, s AS (SELECT curve_id, avg(ret) AS m, stddev_samp(ret) AS sd FROM q GROUP BY 1), z AS (SELECT q.curve_id, (ret - m) / sd AS z FROM q JOIN s ON s.curve_id = q.curve_id), k AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY z) AS i, count(*) OVER (PARTITION BY curve_id) AS n, {cdf_sql('z')} AS f FROM z)
    SELECT curve_id, R6(max(greatest(abs(i::DOUBLE / n - f), abs(f - (i - 1)::DOUBLE / n)))) AS d, max(n) AS n FROM k GROUP BY 1""",
    "v_returns",
)
def m5(spark, sf):
    q = _rets(spark, sf)
    s = q.groupBy("curve_id").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    z = q.join(s, "curve_id").select("curve_id", ((F.col("ret") - F.col("m")) / F.col("sd")).alias("z"))
    return ks_1(z, ["curve_id"], "z", S.normal_cdf).select("curve_id", r("d"), "n")


@query(
    "m6_ks_2",
    """WITH u AS (SELECT DISTINCT price AS x FROM v_ticks WHERE symbol IN ('click', 'view')), c AS (SELECT x, (SELECT count(*) FROM v_ticks WHERE symbol = 'click' AND price <= x) AS a, (SELECT count(*) FROM v_ticks WHERE symbol = 'view' AND price <= x) AS b FROM u)
    SELECT 'x' AS g, R6(max(abs(a::DOUBLE / (SELECT count(*) FROM v_ticks WHERE symbol = 'click') - b::DOUBLE / (SELECT count(*) FROM v_ticks WHERE symbol = 'view')))) AS d FROM c""",
    "v_ticks",
)
def m6(spark, sf):
    return ks_2(ticks(spark, sf).withColumn("g", F.lit("x")), ["g"], "price", "symbol", "click", "view").select("g", r("d"))


@query(
    "m7_jarque_bera",
    f"""WITH {_R}, m AS (SELECT curve_id, avg(ret) AS m, stddev_pop(ret) AS s, count(*) AS n FROM q GROUP BY 1), k AS (SELECT q.curve_id, any_value(n) AS n, avg(pow((ret - m) / s, 3)) AS sk, avg(pow((ret - m) / s, 4)) - 3 AS ku FROM q JOIN m ON m.curve_id = q.curve_id GROUP BY 1)
    SELECT curve_id, n, R4(n / 6.0 * (sk * sk + ku * ku / 4)) AS jb FROM k""",
    "v_returns",
)
def m7(spark, sf):
    return jarque_bera(_rets(spark, sf), ["curve_id"], "ret").select("curve_id", "n", r("jb", 4))


_AC = f"""{_R}, c AS (SELECT q.*, ret - avg(ret) OVER (PARTITION BY curve_id) AS d FROM q), l AS (SELECT *, {', '.join(f'lag(d, {k}) OVER w AS l{k}' for k in range(1, 6))} FROM c WINDOW w AS (PARTITION BY curve_id ORDER BY ts_ns)),
    g AS (SELECT curve_id, count(*) AS n, sum(d * d) AS s, {', '.join(f'sum(d * l{k}) AS c{k}' for k in range(1, 6))} FROM l GROUP BY 1)"""


@query("m8_ljung_box", f"WITH {_AC} SELECT curve_id, n, R4(n * (n + 2) * ({' + '.join(f'pow(c{k} / s, 2) / (n - {k})' for k in range(1, 6))})) AS q FROM g", "v_returns")
def m8(spark, sf):
    return ljung_box(_rets(spark, sf), ["curve_id"], "ret", 5).select("curve_id", "n", r("q", 4))


@query(
    "m9_runs_test",
    f"""WITH {_R}, c AS (SELECT *, ret - avg(ret) OVER (PARTITION BY curve_id) AS d FROM q), u AS (SELECT curve_id, ts_ns, d > 0 AS up FROM c WHERE d <> 0), f AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY curve_id ORDER BY ts_ns) <> up, true) AS fresh FROM u),
    g AS (SELECT curve_id, count(*) FILTER (up)::DOUBLE AS n1, count(*) FILTER (NOT up)::DOUBLE AS n2, count(*) FILTER (fresh) AS runs FROM f GROUP BY 1), z AS (SELECT *, (runs - (2 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))) AS z FROM g)
    SELECT curve_id, n1, n2, runs, R6(z) AS z, R6(2 * (1 - {cdf_sql('abs(z)')})) AS p_value FROM z""",
    "v_returns",
)
def m9(spark, sf):
    return runs_test(_rets(spark, sf), ["curve_id"], "ret").select("curve_id", "n1", "n2", "runs", r("z"), r("p_value"))


@query("m10_pca")
def m10(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    fit = pca_fit(e, "embedding")
    back = pca_inverse(pca_transform(e, "embedding", fit, 4), fit, 4)
    miss = F.sqrt(F.aggregate(F.zip_with("restored", F.col("embedding").cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return back.select("vec_id", *[r(F.get("scores", F.lit(i))).alias(f"pc{i}") for i in range(4)], r(miss).alias("residual"))


@query(
    "m11_garch_filter",
    f"""WITH RECURSIVE {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY ts_ns) AS i FROM q), g(curve_id, ts_ns, i, ret, v) AS (SELECT curve_id, ts_ns, i, ret, 1e-9::DOUBLE / (1 - 0.05::DOUBLE - 0.9::DOUBLE) FROM o WHERE i = 1 UNION ALL
      SELECT o.curve_id, o.ts_ns, o.i, o.ret, 1e-9::DOUBLE + 0.05::DOUBLE * g.ret * g.ret + 0.9::DOUBLE * g.v FROM g JOIN o ON o.curve_id = g.curve_id AND o.i = g.i + 1)
    SELECT curve_id, ts_ns, R6(v * 1e9) AS v, R6((2e-8::DOUBLE + (v - 2e-8::DOUBLE) * pow(0.95::DOUBLE, 5)) * 1e9) AS ahead FROM g""",
    "v_returns",
)
def m11(spark, sf):
    g = garch_filter(_rets(spark, sf), ["curve_id"], 1e-9, 0.05, 0.9)
    return g.select("curve_id", "ts_ns", r(F.col("variance") * 1e9).alias("v"), r(garch_forecast(F.col("variance"), 1e-9, 0.05, 0.9, 5) * 1e9).alias("ahead"))


@query("m12_garch_fit")
def m12(spark, sf):
    return garch_fit(_rets(spark, sf), ["curve_id"]).select("curve_id", "n", r(F.col("omega") * 1e9).alias("omega_e9"), r("alpha", 3), r("beta", 3))


def _labels(spark, sf):
    w = Window.partitionBy("symbol").orderBy("ts_ns", "seq")
    t = ticks(spark, sf).where("price > 0").withColumn("ret", F.coalesce(F.ln(F.col("price") / F.lag("price").over(w)), F.lit(0.0)))
    return t.withColumn("state", F.when(F.col("size") < 10, "crisis").when(F.col("size") < 30, "volatile").when(F.col("size") < 50, "trending").otherwise("calm"))


_CHAIN = """l AS (SELECT *, coalesce(ln(price / lag(price) OVER o), 0) AS ret, CASE WHEN size < 10 THEN 'crisis' WHEN size < 30 THEN 'volatile' WHEN size < 50 THEN 'trending' ELSE 'calm' END AS state FROM v_ticks WHERE price > 0 WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, seq)),
    m AS (SELECT state AS f, lead(state) OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS t FROM l), n AS (SELECT f, t, count(*) AS n FROM m WHERE t IS NOT NULL GROUP BY 1, 2), st AS (SELECT state AS f, avg(ret) AS mean, stddev_pop(ret) AS sigma, count(*) AS visits FROM l GROUP BY 1)"""


@query("m13_fit_regime_chain", f"""WITH {_CHAIN} SELECT n.f AS "from", t AS "to", n, R6((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY n.f) + 4)) AS p, R6(mean) AS mean, R6(sigma) AS sigma, visits FROM n JOIN st ON st.f = n.f""", "v_ticks")
def m13(spark, sf):
    return fit_regime_chain(_labels(spark, sf)).select("from", "to", "n", r("p"), r("mean"), r("sigma"), "visits")


@query("m14_chain_summary")
def m14(spark, sf):
    return chain_summary(fit_regime_chain(_labels(spark, sf))).select("from", r("dwell"), r("share"))


@query("m15_label_regimes")
def m15(spark, sf):
    return label_regimes(nav_returns(nav(spark, sf))).groupBy("symbol", "state").agg(F.count("*").alias("n"))
