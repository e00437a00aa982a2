"""Bootstrap, permutation and stress tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions import stretches as S
from tickspark.functions.stretches import FEW, Stretches, numbered, over_rows, placed, stretches
from tickspark.plans.catalog import DAY, HOUR, SECOND, nav, query, r, ticks
from tickspark.plans.catalog import cut as checkpointed

from .performance import curve_returns, grown, metrics, summarize

#: The hash of every random choice works modulo this prime, so that any engine with 64-bit integers repeats it.
PRIME, STEP, LAST = 2**31 - 1, 40503, 12345
#: Longest curve that the kernel holds as an array, and values that a task of it draws at a time.
ARRAY, DRAWN = 5_000_000, 2_000_000


def _power(t, modulo):
    """t^5 modulo PRIME, a permutation of the residues."""
    return modulo(modulo(modulo(t * t) * modulo(t * t)) * t)


def mixed(seed: int, *parts: Column | str) -> Column:
    """A residue of PRIME from a seed and whole numbers: any partitioning and any rerun gives the same."""
    mod = lambda x: x % F.lit(PRIME)
    numbers = [(F.col(x) if isinstance(x, str) else x).cast("long") for x in parts]
    return F.aggregate(F.array(*numbers, F.lit(LAST).cast("long")), F.lit(seed % PRIME).cast("long"), lambda h, x: _power(F.pmod(h + x + STEP, F.lit(PRIME)), mod))


def mixed_array(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """``mixed`` over arrays."""
    h = np.int64(seed % PRIME)
    for x in (*parts, LAST):
        h = _power((h + np.asarray(x, np.int64) + STEP) % PRIME, lambda v: v % PRIME)
    return h


def mixed_sql(seed: int, *parts: str) -> str:
    """``mixed`` in SQL."""
    t = f"((h + x + {STEP}) % {PRIME})"
    square = f"(({t} * {t}) % {PRIME})"
    power = f"((({square} * {square}) % {PRIME}) * {t}) % {PRIME}"
    return f"list_reduce([{seed % PRIME}::BIGINT, {', '.join(f'({p})::BIGINT' for p in parts)}, {LAST}::BIGINT], lambda h, x: {power})"


def uniform(seed: int, *parts: Column | str) -> Column:
    """A uniform in [0, 1) from ``mixed``."""
    return mixed(seed, *parts) / F.lit(float(PRIME))


def uniform_sql(seed: int, *parts: str) -> str:
    return f"({mixed_sql(seed, *parts)} / {float(PRIME)}::DOUBLE)"


def name_number(key: Column | str) -> Column:
    """A name as a whole number: the first eight digits of its MD5."""
    return F.conv(F.substring(F.md5((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def name_sql(key: str) -> str:
    return f"('0x' || md5({key}::VARCHAR)[1:8])::BIGINT"


def block_length(n: Column, block: int | None) -> Column:
    """round(n^(1/3)) unless given."""
    return F.lit(block).cast("long") if block else F.greatest(F.lit(1), F.round(F.cbrt(n))).cast("long")


def draw_index(n: Column, kind: str, block: Column, seed: int, key: str) -> Column:
    """The row drawn at place ``j`` of ``run``: iid, moving or circular blocks."""
    own = name_number(key)
    if kind == "iid":
        return F.floor(uniform(seed, own, "run", "j") * n)
    part = F.floor(F.col("j") / block)
    start = uniform(seed, own, "run", part)
    if kind == "moving":
        return F.floor(start * (n - block + 1)) + F.col("j") % block
    if kind == "circular":
        return F.pmod(F.floor(start * n) + F.col("j") % block, n)
    raise ValueError(f"unknown resampling {kind!r}")


def _last_jumps(places: DataFrame, sizes: DataFrame, start: Column, runs: int, key: str, length: int | None) -> DataFrame:
    """``places`` with ``_s``, the last start at or before each: long paths are cut at every ``length`` places."""
    length = length or S.LENGTH
    paths, order = [key, "run"], ("j",)
    long = sizes.where(F.col("_n") > length).select(key)
    if long.isEmpty():
        cut = Stretches(places, paths, order, None)
    else:
        hot = long.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
        cut = Stretches(places.withColumn("_st", F.floor(F.col("j") / length).cast("int")), paths, order, hot)
    return cut.done(cut.running(cut.df, {"_s": ("last", start)}))


def bootstrap(df: DataFrame, kind: str, runs: int, seed: int = 0, block: int | None = None, key: str = "curve_id", length: int | None = None) -> DataFrame:
    """V1-V5: rows of ``df`` (key, i = 0, 1, ... and any columns) drawn with replacement, ``runs`` times.

    Columns stay together, so several series are resampled jointly. The drawn indices are made on the fly and
    joined to the rows; nothing is gathered per run. Blocks are round(n^(1/3)) long unless given.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_b", block_length(F.col("_n"), block))
    places = sizes.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    n, b = F.col("_n"), F.col("_b")
    if kind == "stationary":
        jump = (F.col("j") == 0) | (uniform(seed + 1, name_number(key), "run", "j") < 1 / b)
        start = F.when(jump, F.struct(F.floor(uniform(seed, name_number(key), "run", "j") * n).alias("s"), F.col("j").alias("at")))
        drawn = _last_jumps(places, sizes, start, runs, key, length).withColumn("i", F.pmod(F.col("_s.s") + F.col("j") - F.col("_s.at"), n)).drop("_s")
    else:
        drawn = places.withColumn("i", draw_index(n, kind, b, seed, key).cast("long"))
    rows = df.withColumn("i", F.col("i").cast("long"))
    return drawn.drop("_n", "_b").join(rows, [key, "i"])


#: Rounds of the keyed permutation.
ROUNDS = 6


def shuffled(i: np.ndarray, n: np.ndarray, own: np.ndarray, run: np.ndarray, seed: int) -> np.ndarray:
    """Where row ``i`` of 0..n-1 goes in each run: a permutation that is computed for each row by itself.

    The row is a pair (left, right) of an a x b grid that holds n, a = ceil(sqrt(n)); the sides are turned by hashes of
    each other in turn. Rows that land outside of 0..n-1 walk on; a walk ends after a * b - n + 1 steps at most.
    """
    a = np.ceil(np.sqrt(n)).astype(np.int64)
    b = -(-n // a)
    out, left = np.asarray(i, np.int64).copy(), np.arange(len(i))
    while len(left):
        aa, bb, o, k = a[left], b[left], own[left], run[left]
        x, y = out[left] // bb, out[left] % bb
        for at in range(ROUNDS):
            if at % 2 == 0:
                x = (x + mixed_array(seed, o, k, at, y)) % aa
            else:
                y = (y + mixed_array(seed, o, k, at, x)) % bb
        out[left] = x * bb + y
        left = left[out[left] >= n[left]]
    return out


def shuffled_sql(i: str, n: str, own: str, run: str, seed: int) -> str:
    """``shuffled`` in SQL, for curves short enough that the longest walk may be gone by every row."""
    a, b = f"ceil(sqrt({n}))::BIGINT", f"(({n} + ceil(sqrt({n}))::BIGINT - 1) // ceil(sqrt({n}))::BIGINT)"
    turned = f"[p[1] // {b}, p[1] % {b}]"
    for at in range(ROUNDS):
        x = f"(q[1] + {mixed_sql(seed, own, run, str(at), 'q[2]')}) % {a}" if at % 2 == 0 else "q[1]"
        y = f"(q[2] + {mixed_sql(seed, own, run, str(at), 'q[1]')}) % {b}" if at % 2 else "q[2]"
        turned = f"list_transform([{turned}], lambda q: [{x}, {y}])[1]"
    step = f"list_transform([{turned}], lambda z: z[1] * {b} + z[2])[1]"
    walk = f"[[{i}, 0::BIGINT]] || [[s, s] FOR s IN range(1, {a} * {b} - {n} + 2)]"
    return f"list_reduce({walk}, lambda p, s: CASE WHEN s[1] > 1 AND p[1] < {n} THEN p ELSE [{step}, s[1]] END)[1]"


def permute(df: DataFrame, runs: int, seed: int = 0, key: str = "curve_id") -> DataFrame:
    """V6: each run holds every row (i = 0, 1, ...) once, at the place ``j`` of a keyed permutation.

    A row's place follows from its number, the run and the size of its key, so no run is sorted or gathered.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    rows = df.join(sizes, key).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    @F.pandas_udf("long")
    def place(i: pd.Series, n: pd.Series, own: pd.Series, run: pd.Series) -> pd.Series:
        return pd.Series(shuffled(*[x.to_numpy(np.int64) for x in (i, n, own, run)], seed))

    return rows.withColumn("j", place(F.col("i").cast("long"), "_n", name_number(key), F.col("run").cast("long"))).drop("_n")


def sign_flip(df: DataFrame, runs: int, seed: int = 0, col: str = "ret", key: str = "curve_id") -> DataFrame:
    """V6: each run keeps the rows and turns hashed signs."""
    r_ = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return r_.withColumn(col, F.when(uniform(seed, name_number(key), "run", "i") < 0.5, F.col(col)).otherwise(-F.col(col)))


def path_metrics(drawn: DataFrame, ppy: float, key: str = "curve_id", col: str = "ret", ends: bool = True) -> DataFrame:
    """The metric vector of each (key, run) of a table of drawn rows: the key of the aggregates is the path.

    A path that loses more than all is no number from there on, nor are its growth and depth; it stays below its peak.
    """
    path = drawn.withColumn("path", F.concat_ws("#", key, F.col("run").cast("string"))).select("path", F.col("j").alias("ts_ns"), F.col(col).alias("ret"))
    w = Window.partitionBy("path").orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    curve = path.withColumn("nav", F.nanvl(F.exp(F.sum(grown("ret")).over(w)), F.lit(0.0))).select("path", (F.col("ts_ns") + 1).alias("ts_ns"), "nav")
    curve = curve.unionByName(path.where("ts_ns = 0").select("path", F.lit(0).cast("long").alias("ts_ns"), F.lit(1.0).alias("nav")))
    per = path.select("path").distinct().withColumn("ppy", F.lit(ppy))
    m = metrics(path, curve, "path", ppy=per, ends=ends)
    m = m.withColumns({c: F.when(F.isnan("total_return"), float("nan")).otherwise(F.col(c)) for c in ("max_drawdown", "ulcer_index", "martin_ratio")})
    return m.withColumn(key, F.substring_index("path", "#", 1)).withColumn("run", F.substring_index("path", "#", -1).cast("int")).drop("path")


def _safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    tiny = np.abs(b) < 1e-15
    return np.where(tiny, 0.0, a / np.where(tiny, 1.0, b))


@np.errstate(over="ignore", divide="ignore", invalid="ignore")
def metric_vectors(ret: np.ndarray, ppy: float, ends: bool = True) -> dict[str, np.ndarray]:
    """The metric vector of ``path_metrics`` for each row of a matrix of returns, the path starting from 1."""
    runs, n = ret.shape
    grown = np.cumsum(np.log1p(ret), axis=1)
    total, mean = np.expm1(grown[:, -1]), ret.mean(axis=1)
    away = ret - mean[:, None]
    m2 = (away**2).mean(axis=1)
    sd = np.sqrt(m2 * n / (n - 1)) if n > 1 else np.zeros(runs)
    ranked = np.sort(ret, axis=1)
    down = np.sqrt(np.where(ret < 0, ret * ret, 0.0).mean(axis=1))
    gain, loss = np.where(ret > 0, ret, 0.0).sum(axis=1), np.where(ret < 0, -ret, 0.0).sum(axis=1)
    wins = (ret > 0).sum(axis=1)
    value = np.exp(np.concatenate((np.zeros((runs, 1)), grown), axis=1))
    peak = np.maximum.accumulate(value, axis=1)
    depth = (peak - value) / peak
    at = np.arange(n + 1)
    top = np.maximum.accumulate(np.where(value >= peak, at, 0), axis=1)
    gaps = np.where((value[:, 1:] >= peak[:, 1:]) | (at[1:] == n), at[1:] - top[:, :-1], 0)
    gaps = np.where((gaps > 1) | ((at[1:] == n) & (value[:, 1:] < peak[:, 1:])), gaps, 0)

    def quantile(q: float) -> np.ndarray:
        k = q * (n - 1)
        lo = math.floor(k)
        return ranked[:, lo] + (ranked[:, min(lo + 1, n - 1)] - ranked[:, lo]) * (k - lo)

    def tail(c: float) -> tuple[np.ndarray, np.ndarray]:
        k = math.floor(n * (1 - c))
        return -ranked[:, k], (-ranked[:, :k].mean(axis=1) if k else np.zeros(runs))

    safe_m2 = np.where(m2 > 0, m2, 1.0)
    skew = np.where(sd > 0, (away**3).mean(axis=1) / safe_m2**1.5 * ((n - 1) / n) ** 1.5, 0.0)
    kurt = np.where(sd > 0, (away**4).mean(axis=1) / safe_m2**2 * ((n - 1) / n) ** 2 - 3, 0.0)
    cagr = np.where(total <= -1, 0.0, np.power(1 + total, ppy / n) - 1) if ends else np.power(np.exp(grown[:, -1]), ppy / n) - 1
    ann, vol, semi, worst = mean * ppy, sd * math.sqrt(ppy), down * math.sqrt(ppy), depth.max(axis=1)
    ulcer = np.sqrt((depth * depth).mean(axis=1)) * 100
    var95, es95 = tail(95 / 100)
    var99, es99 = tail(99 / 100)
    return {
        "n_periods": np.full(runs, n, np.int64),
        "periods_per_year": np.full(runs, ppy),
        "total_return": total,
        "cagr": cagr,
        "ann_return": ann,
        "ann_volatility": vol,
        "ann_downside_deviation": semi,
        "sharpe": _safe(ann, vol),
        "sortino": _safe(ann, semi),
        "calmar": _safe(cagr, worst),
        "omega": _safe(gain, loss),
        "ulcer_index": ulcer,
        "martin_ratio": _safe(ann * 100, ulcer),
        "tail_ratio": _safe(np.abs(quantile(0.95)), np.abs(quantile(0.05))),
        "max_drawdown": worst,
        "max_drawdown_duration_ns": gaps.max(axis=1).astype(np.int64),
        "skewness": skew,
        "excess_kurtosis": kurt,
        "hit_rate": wins / n,
        "win_loss_ratio": _safe(_safe(gain, wins.astype(float)), _safe(loss, (n - wins).astype(float))),
        "time_in_market": (np.abs(ret) > 1e-15).sum(axis=1) / n,
        "var_95": var95,
        "cvar_95": es95,
        "var_99": var99,
        "cvar_99": es99,
        "best_period": ranked[:, -1],
        "worst_period": ranked[:, 0],
    }


def _circular(n: int, block: int, seed: int, key: str, runs: np.ndarray) -> np.ndarray:
    """Row drawn at each place of each run, as ``draw_index`` draws circular blocks."""
    j = np.arange(n)
    own = int(hashlib.md5(key.encode()).hexdigest()[:8], 16)
    starts = mixed_array(seed, own, runs[:, None], np.arange(-(-n // block))[None, :]) / float(PRIME)
    return (np.floor(starts * n).astype(np.int64)[:, j // block] + j % block) % n


def bootstrap_paths(df: DataFrame, runs: int, ppy: float, seed: int = 0, block: int | None = None, cols: tuple[str, ...] = ("ret",), key: str = "curve_id", longest: int = ARRAY, ends: bool = True) -> DataFrame:
    """The metric vector of each (key, run) of a circular-block bootstrap: key, run, col and the metrics.

    A task gets a curve as arrays and a range of runs, draws by the same hash as ``bootstrap`` and gives metrics
    only; all ``cols`` share the draws. Curves of more than ``longest`` rows are drawn by ``bootstrap``, row by row.
    Paths that lose more than all have NaN; ``ends`` as in ``metrics``.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n")).first()[0] or 1
    if top > longest:
        drawn = bootstrap(df, "circular", runs, seed, block, key)
        parts = [path_metrics(drawn, ppy, key, c, ends).withColumn("col", F.lit(c)) for c in cols]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    each = max(1, min(runs, DRAWN // top))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in cols]))).alias("_v"))
    dealt = rows.select(F.col(key).cast("string").alias(key), *[F.col(f"_v.{c}").alias(c) for c in cols], F.explode(F.sequence(F.lit(0), F.lit(runs - 1), F.lit(each))).alias("_lo"))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    dealt = dealt.repartition(tasks, key, "_lo")
    names = list(metric_vectors(np.zeros((1, 2)), 1.0))
    kind = lambda m: "long" if m in ("n_periods", "max_drawdown_duration_ns") else "double"
    schema = f"{key} string, run int, col string, " + ", ".join(f"{m} {kind(m)}" for m in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                some = np.arange(row["_lo"], min(runs, row["_lo"] + each))
                n = len(row[cols[0]])
                drawn = _circular(n, block or max(1, round(n ** (1 / 3))), seed, row[key], some)
                for c in cols:
                    yield pd.DataFrame({key: row[key], "run": some.astype(np.int32), "col": c, **metric_vectors(np.asarray(row[c], float)[drawn], ppy, ends)})

    made = dealt.mapInPandas(run, schema)
    # No metric is unknown: a null is a NaN, which pandas does not tell apart.
    return made.withColumns({m: F.coalesce(m, F.lit(float("nan"))) for m in names if kind(m) == "double"})


NAMES = ("sharpe", "cagr", "max_drawdown")


def bootstrap_metrics(rets: DataFrame, runs: int, ppy: float, seed: int = 0, names: tuple[str, ...] = NAMES, ends: bool = True) -> DataFrame:
    """V7: circular blocks, the metric vector of each run, and the distribution of each metric; ``ends`` as in ``metrics``."""
    m = bootstrap_paths(rets, runs, ppy, seed, ends=ends)
    return summarize(m.unpivot(["curve_id", "run"], list(names), "metric", "value"), ["curve_id", "metric"], "value")


def bootstrap_compare(both: DataFrame, runs: int, ppy: float, seed: int = 0, names: tuple[str, ...] = NAMES, ends: bool = True) -> DataFrame:
    """V8: ``both`` has curve_id, i, a and b at the same times; differences b - a under common resamples."""
    m = bootstrap_paths(both, runs, ppy, seed, cols=("a", "b"), ends=ends)
    gap = lambda n: F.max(F.when(F.col("col") == "b", F.col(n))) - F.max(F.when(F.col("col") == "a", F.col(n)))
    d = m.groupBy("curve_id", "run").agg(*[gap(n).alias(n) for n in names])
    return summarize(d.unpivot(["curve_id", "run"], list(names), "metric", "value"), ["curve_id", "metric"], "value")


#: Fixed scenario presets: name, price gap, drift per day, spread, depth and volatility multiples, halt and duration (ns), decay, half-life as a share of the duration.
PRESETS = (
    ("black_monday_1987", -0.22, 0.0, 5.0, 0.3, 4.0, 0, DAY, "exponential", 0.3),
    ("ltcm_1998", 0.0, -0.005, 4.0, 0.25, 2.5, 0, 42 * DAY, "linear", 0.0),
    ("lehman_2008", 0.0, -0.017, 6.0, 0.15, 3.5, 0, 21 * DAY, "linear", 0.0),
    ("flash_crash_2010", -0.09, 0.0, 20.0, 0.02, 8.0, 0, 1800 * SECOND, "exponential", 0.15),
    ("covid_march_2020", 0.0, -0.012, 5.0, 0.2, 4.0, 0, 28 * DAY, "linear", 0.0),
    ("luna_may_2022", 0.0, -0.55, 30.0, 0.02, 10.0, 0, 4 * DAY, "instant", 0.0),
    ("ftx_nov_2022", -0.25, 0.0, 1.0, 0.05, 5.0, 6 * HOUR, 3 * DAY, "linear", 0.0),
)


def stress_presets(spark) -> DataFrame:
    """The named scenarios as a table."""
    return spark.createDataFrame(list(PRESETS), "scenario string, gap double, drift double, spread_x double, depth_x double, vol_x double, halt_ns long, duration_ns long, decay string, half_life double")


def intensity(t: Column, scenario: Column) -> Column:
    """V9: 1 at the onset, 0 before it and after the duration; instant, linear or by half-lives between."""
    dur = scenario["duration_ns"]
    half = F.greatest(F.lit(1e-9), scenario["half_life"] * dur)
    inside = F.when(scenario["decay"] == "instant", 1.0).when(scenario["decay"] == "linear", 1 - t / dur).otherwise(F.exp(-math.log(2) * t / half))
    return F.when((t < 0) | (dur <= 0) | (t > dur), 0.0).otherwise(inside)


#: V9: rows of a stretch, and scenarios whose running drifts stand side by side in a row.
STRESSED, ABREAST = 250_000, 32


def apply_stress(records: DataFrame, scenarios: DataFrame, onset: float = 0.5, gap: str = "persistent", length: int | None = None) -> DataFrame:
    """V9: records under each scenario (a bounded table), from ``onset`` of their span on.

    Prices are multiplied by 1 + drift + gap: the drift adds up drift * days * intensity over a symbol's records,
    the gap decays with the intensity, or hits one record (``gap="single"``). Returns scale about the price before
    the shock, quotes widen about the price, and the levels of books (columns bids and asks) thin out. Records in a
    halt are dropped.

    Each symbol is put in order once, in stretches: its records carry a running drift per scenario, and meet the
    scenarios' other columns only after that.
    """
    span = records.agg(F.min("ts_ns").alias("_lo"), F.max("ts_ns").alias("_hi"))
    at = span.select((F.col("_lo") + ((F.col("_hi") - F.col("_lo")) * onset).cast("long")).alias("_on"))
    till, before = F.when(F.col("ts_ns") <= F.col("_on"), F.struct("ts_ns", "seq")), F.when(F.col("ts_ns") < F.col("_on"), F.col("ts_ns"))
    known = records.where("ts_ns is not null").crossJoin(F.broadcast(at)).groupBy(F.col("symbol").alias("_symbol"))
    pre = checkpointed(known.agg(F.max("_on").alias("_on"), F.when(F.col("_symbol").isNotNull(), F.max_by("price", till)).alias("_pre"), F.max(before).alias("_before")))  # a row per symbol
    table = F.broadcast(scenarios.agg(F.array_sort(F.collect_list(F.struct(*scenarios.columns))).alias("_all")))
    told = pre.crossJoin(table)
    told = F.broadcast(told) if pre.count() <= FEW else told
    n = max(scenarios.count(), 1)
    made = [_stressed(records, told, table, range(i, min(i + ABREAST, n)), gap, length or STRESSED) for i in range(0, n, ABREAST)]
    return reduce(DataFrame.unionByName, made)


def _stressed(records: DataFrame, told: DataFrame, table: DataFrame, places: range, gap: str, length: int) -> DataFrame:
    """V9 under the scenarios at some ``places`` of the array ``_all`` of ``table``."""
    cut = stretches(records.where("ts_ns is not null"), "symbol", ("ts_ns", "seq"), length)
    halted = lambda t, s: F.coalesce((t >= 0) & (t < s["halt_ns"]), t >= 0)
    t = F.col("ts_ns") - F.col("_on")
    rows = cut.running(cut.df, {"_last": ("max", F.col("ts_ns"))}, before=True).join(told, F.col("symbol").eqNullSafe(F.col("_symbol"))).drop("_symbol")
    under = F.slice("_all", places.start + 1, len(places))

    def step(s: Column) -> Column:
        # The record before: not one in the halt, but then the last one before it.
        last = F.when(halted(F.col("_last") - F.col("_on"), s), F.col("_before")).otherwise(F.col("_last"))
        days = F.coalesce((F.col("ts_ns") - last) / DAY, F.lit(0.0))
        return F.when(~halted(t, s), s["drift"] * days * intensity(t, s))

    # Arrays by a lambda: one expression per scenario would make methods too long to be compiled.
    steps = {"_d": F.transform(under, step)}
    if gap == "single":
        steps["_h"] = F.transform(under, lambda s: F.when(~halted(t, s) & (intensity(t, s) > 0), 1).otherwise(0))
    rows = rows.withColumns(steps).drop("_last", "_before", "_all")
    sums = {f"_r{n}{i}": ("sum", F.get(n, F.lit(i))) for n in steps for i in range(len(places))}
    rows = cut.done(cut.running(rows, sums)).drop(*steps)
    rows = rows.crossJoin(table).select("*", F.posexplode(under).alias("_at", "_s")).drop("_all")
    s, own = F.col("_s"), lambda x: F.get(F.array(*[F.col(f"_r_{x}{i}") for i in range(len(places))]), F.col("_at"))
    rows = rows.where(~halted(t, s)).withColumn("_k", intensity(t, s)).withColumn("_drift", own("d"))
    k = F.col("_k")
    hit = F.when((k > 0) & (own("h") == 1), 1.0).otherwise(0.0) if gap == "single" else k
    swing = F.when((k > 0) & F.col("_pre").isNotNull(), F.greatest(F.col("_pre") + (F.col("price") - F.col("_pre")) * (1 + (s["vol_x"] - 1) * k), F.lit(0.01))).otherwise(F.col("price"))
    rows = rows.withColumn("_m", 1 + F.col("_drift") + s["gap"] * hit).withColumn("_p", swing * F.col("_m"))
    wide = F.col("_m") * (1 + (s["spread_x"] - 1) * k)
    out = {"price": F.col("_p"), "bid": F.col("_p") + (F.col("bid") - F.col("price")) * wide, "ask": F.col("_p") + (F.col("ask") - F.col("price")) * wide}
    thin = lambda x: F.struct((x["price"] * F.col("_m")).alias("price"), (x["size"] * (1 - (1 - s["depth_x"]) * k)).alias("size"), x["orders"].alias("orders"))
    out |= {c: F.transform(c, thin) for c in ("bids", "asks") if c in records.columns}
    keep = [F.col(c) if c not in out else out[c].alias(c) for c in records.columns]
    return rows.select(s["scenario"].alias("scenario"), *keep)


def conditional_stress(rets: DataFrame, pct: float, block: int, runs: int, seed: int = 0, key: str = "curve_id", length: int | None = None) -> DataFrame:
    """Moving blocks that start only in the worst ``pct`` of windows by cumulative return.

    Rows have numbers ``i`` = 0, 1, ... The windows of all keys are range-sorted and numbered at once, so a long key
    is ranked by many tasks.
    """

    def summed(d: DataFrame, w) -> DataFrame:
        back = w.rowsBetween(-(block - 1), 0)
        return d.withColumn("_sum", F.sum(grown("ret")).over(back)).withColumn("_full", F.count("*").over(back))

    sums = over_rows(rets, key, block, summed, ("i",), length).where(F.col("_full") == block).select(key, (F.col("i") - block + 1).cast("long").alias("_from"), "_sum")
    ranked = numbered(sums, [F.col(key), F.col("_sum"), F.col("_from")], "_at")
    firsts = ranked.groupBy(key).agg(F.min("_at").alias("_first"), F.count("*").alias("_windows"))
    ranked = ranked.join(firsts, key).withColumn("_rank", F.col("_at") - F.col("_first"))
    worst = ranked.where(F.col("_rank") < F.greatest(F.lit(1), F.floor(F.col("_windows") * pct))).select(key, F.col("_rank").cast("long").alias("_rank"), "_from")
    picks = worst.groupBy(key).agg(F.count("*").alias("_m")).join(rets.groupBy(key).agg(F.count("*").alias("_len")), key)
    places = picks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_len") - 1)))
    drawn = places.withColumn("_rank", F.floor(uniform(seed, name_number(key), "run", F.floor(F.col("j") / block)) * F.col("_m")).cast("long")).join(worst, [key, "_rank"])
    return drawn.withColumn("i", (F.col("_from") + F.col("j") % block).cast("long")).select(key, "run", "j", "i").join(rets.withColumn("i", F.col("i").cast("long")), [key, "i"])


def _rets(spark, sf):
    return placed(curve_returns(spark, sf), "curve_id", "i")


def _moments(drawn):
    return drawn.groupBy("curve_id", "run").agg(F.count("*").alias("n"), r(F.avg("ret")).alias("mean"), F.countDistinct("i").alias("distinct_rows"))


_Q = "q AS (SELECT curve_id, r, nav, row_number() OVER (PARTITION BY curve_id ORDER BY ts_ns) - 1 AS i, count(*) OVER (PARTITION BY curve_id) AS n FROM v_returns WHERE r IS NOT NULL)"


def _drawn_sql(kind: str, runs: int, seed: int, source: str = "q") -> str:
    """Drawn rows: curve_id, run, j, i and the row's values; as ``bootstrap`` draws them."""
    own = name_sql("curve_id")
    places = f"b AS (SELECT curve_id, any_value(n) AS n, greatest(1, round(cbrt(any_value(n))))::BIGINT AS b FROM {source} GROUP BY 1), pl AS (SELECT curve_id, n, b, run, unnest(range(n)) AS j FROM b, range({runs}) t(run))"
    u = lambda *parts: uniform_sql(seed, own, *parts)
    index = {"iid": f"floor({u('run', 'j')} * n)", "moving": f"floor({u('run', 'j // b')} * (n - b + 1)) + j % b", "circular": f"(floor({u('run', 'j // b')} * n)::BIGINT + j % b) % n"}
    if kind == "stationary":
        jump = f"j = 0 OR {uniform_sql(seed + 1, own, 'run', 'j')} < 1.0::DOUBLE / b"
        made = f"js AS (SELECT *, CASE WHEN {jump} THEN [floor({u('run', 'j')} * n)::BIGINT, j] END AS s FROM pl), jl AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY curve_id, run ORDER BY j ROWS UNBOUNDED PRECEDING) AS l FROM js), ix AS (SELECT curve_id, run, j, (l[1] + j - l[2]) % n AS i FROM jl)"
    else:
        made = f"ix AS (SELECT curve_id, run, j, ({index[kind]})::BIGINT AS i FROM pl)"
    return f"{places}, {made}, dr AS (SELECT ix.curve_id, ix.run, ix.j, {source}.* EXCLUDE (curve_id, n) FROM ix JOIN {source} ON {source}.curve_id = ix.curve_id AND {source}.i = ix.i)"


_STATS = "SELECT curve_id, run::INT AS run, count(*) AS n, R6(avg(r)) AS mean, count(DISTINCT i) AS distinct_rows FROM dr GROUP BY 1, 2"
for _kind, _id in (("iid", "v1"), ("moving", "v2"), ("circular", "v3"), ("stationary", "v4")):
    query(f"{_id}_bootstrap_{_kind}", f"WITH {_Q}, {_drawn_sql(_kind, 20, 3)} {_STATS}", "v_returns")(lambda spark, sf, kind=_kind: _moments(bootstrap(_rets(spark, sf), kind, 20, seed=3)))


@query("v5_joint_bootstrap", f"WITH {_Q}, {_drawn_sql('circular', 10, 4)} SELECT curve_id, run::INT AS run, count(*) AS n, R6(avg(r)) AS mean, R6(avg(nav / 1e6)) AS level FROM dr GROUP BY 1, 2", "v_returns")
def v5(spark, sf):
    q = _rets(spark, sf).withColumn("level", F.col("nav") / 1e6)
    return bootstrap(q, "circular", 10, seed=4).groupBy("curve_id", "run").agg(F.count("*").alias("n"), r(F.avg("ret")).alias("mean"), r(F.avg("level")).alias("level"))


_MEAN = "SELECT curve_id, run::INT AS run, count(*) AS n, R6(sum(r)) AS total FROM v_returns, range(5) t(run) WHERE r IS NOT NULL GROUP BY 1, 2"


@query("v6_permute", _MEAN, "v_returns")
def v6(spark, sf):
    return permute(_rets(spark, sf), 5, seed=9).groupBy("curve_id", "run").agg(F.count("*").alias("n"), r(F.sum("ret")).alias("total"))


@query("v6_permuted_places", f"WITH {_Q}, pm AS (SELECT curve_id, run, i, r, {shuffled_sql('i', 'n', name_sql('curve_id'), 'run', 9)} AS j FROM q, range(5) t(run)) SELECT curve_id, run::INT AS run, j, i, R6(r) AS ret FROM pm", "v_returns")
def v6p(spark, sf):
    return permute(_rets(spark, sf), 5, seed=9).select("curve_id", "run", "j", F.col("i").cast("long").alias("i"), r("ret"))


@query("v6_sign_flip", f"WITH {_Q} SELECT curve_id, run::INT AS run, count(*) AS n, R6(sum(CASE WHEN {uniform_sql(9, name_sql('curve_id'), 'run', 'i')} < 0.5 THEN r ELSE -r END)) AS total FROM q, range(5) t(run) GROUP BY 1, 2", "v_returns")
def v6s(spark, sf):
    return sign_flip(_rets(spark, sf), 5, seed=9).groupBy("curve_id", "run").agg(F.count("*").alias("n"), r(F.sum("ret")).alias("total"))


def _vector_sql(col: str) -> str:
    """Sharpe, growth a year and largest drawdown of each drawn path, at 365 periods a year."""
    return f"""(SELECT curve_id, run, avg({col}) * 365 / (stddev_samp({col}) * sqrt(365.0::DOUBLE)) AS sharpe, pow(exp(sum(ln(1 + {col}))), 365.0::DOUBLE / count(*)) - 1 AS cagr, max(1 - c / top) AS max_drawdown FROM
      (SELECT *, greatest(1, max(c) OVER w) AS top FROM (SELECT *, exp(sum(ln(1 + {col})) OVER (PARTITION BY curve_id, run ORDER BY j ROWS UNBOUNDED PRECEDING)) AS c FROM dr) WINDOW w AS (PARTITION BY curve_id, run ORDER BY j ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2)"""


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT curve_id, run, '{n}' AS metric, {n} AS value FROM m" for n in NAMES) + ")"


@query("v7_bootstrap_metrics", f"WITH {_Q}, {_drawn_sql('circular', 50, 1)}, m AS {_vector_sql('r')}, {_LONG} SELECT curve_id, metric, count(*) AS n, R6(avg(value)) AS mean, R6(stddev_samp(value)) AS sd, R6(quantile_cont(value, 0.05)) AS p05, R6(quantile_cont(value, 0.5)) AS p50, R6(quantile_cont(value, 0.95)) AS p95 FROM long GROUP BY 1, 2", "v_returns")
def v7(spark, sf):
    s = bootstrap_metrics(_rets(spark, sf), 50, 365.0, seed=1, ends=False)
    return s.select("curve_id", "metric", "n", r("mean"), r("sd"), r("p05"), r("p50"), r("p95"))


_BOTH = """ab AS (SELECT 'both' AS curve_id, x.r AS a, y.r AS b, row_number() OVER (ORDER BY x.ts_ns) - 1 AS i, count(*) OVER () AS n FROM v_returns x JOIN v_returns y ON x.ts_ns = y.ts_ns AND x.curve_id = '1-URGENT' AND y.curve_id = '2-HIGH' WHERE x.r IS NOT NULL AND y.r IS NOT NULL)"""


@query(
    "v8_bootstrap_compare",
    f"""WITH {_BOTH}, {_drawn_sql('circular', 50, 2, 'ab')}, ma AS {_vector_sql('a')}, mb AS {_vector_sql('b')}, m AS (SELECT ma.curve_id, ma.run, {', '.join(f'mb.{n} - ma.{n} AS {n}' for n in NAMES)} FROM ma JOIN mb ON ma.run = mb.run), {_LONG}
    SELECT metric, count(*) AS n, R6(avg(value)) AS mean, R6(stddev_samp(value)) AS sd, R6(quantile_cont(value, 0.05)) AS p05, R6(quantile_cont(value, 0.95)) AS p95 FROM long GROUP BY 1""",
    "v_returns",
)
def v8(spark, sf):
    q = _rets(spark, sf)
    a, b = q.where("curve_id = '1-URGENT'").select("ts_ns", F.col("ret").alias("a")), q.where("curve_id = '2-HIGH'").select("ts_ns", F.col("ret").alias("b"))
    both = a.join(b, "ts_ns").withColumn("curve_id", F.lit("both"))
    return bootstrap_compare(placed(both, "curve_id", "i"), 50, 365.0, seed=2, ends=False).select("metric", "n", r("mean"), r("sd"), r("p05"), r("p95"))


_PRE = ", ".join("('{}', {}, {}, {}, {}, {}, {}, {}, '{}', {})".format(*p) for p in PRESETS)


@query(
    "v9_apply_stress",
    f"""WITH p AS (SELECT col0 AS scenario, col1::DOUBLE AS gap, col2::DOUBLE AS drift, col3::DOUBLE AS sx, col5::DOUBLE AS vx, col6::BIGINT AS halt, col7::DOUBLE AS dur, col8 AS decay, col9::DOUBLE AS hl FROM (VALUES {_PRE})),
    s AS (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM v_ticks), o AS (SELECT lo + trunc((hi - lo) * 0.5::DOUBLE)::BIGINT AS on_ FROM s), q AS (SELECT symbol, arg_max(price, (ts_ns, seq)) AS pre FROM v_ticks, o WHERE ts_ns <= on_ GROUP BY 1),
    j AS (SELECT v.*, p.*, pre, ts_ns - on_ AS t FROM v_ticks v CROSS JOIN o CROSS JOIN p LEFT JOIN q ON q.symbol = v.symbol WHERE NOT (ts_ns - on_ >= 0 AND ts_ns - on_ < halt)),
    k AS (SELECT *, CASE WHEN t < 0 OR t > dur THEN 0 WHEN decay = 'instant' THEN 1 WHEN decay = 'linear' THEN 1 - t / dur ELSE exp(-ln(2) * t / greatest(1e-9, hl * dur)) END AS k FROM j),
    d AS (SELECT *, drift * coalesce((ts_ns - lag(ts_ns) OVER (PARTITION BY scenario, symbol ORDER BY ts_ns, seq)) / {DAY}.0::DOUBLE, 0) * k AS d FROM k),
    m AS (SELECT *, 1 + sum(d) OVER (PARTITION BY scenario, symbol ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) + gap * k AS m FROM d),
    n AS (SELECT *, m * CASE WHEN k > 0 AND pre IS NOT NULL THEN greatest(pre + (price - pre) * (1 + (vx - 1) * k), 0.01::DOUBLE) ELSE price END AS np FROM m)
    SELECT scenario, symbol, count(*) AS n, R4(avg(np)) AS price, R4(avg((ask - bid) * m * (1 + (sx - 1) * k))) AS spread FROM n GROUP BY 1, 2""",
    "v_ticks",
)
def v9(spark, sf):
    s = apply_stress(ticks(spark, sf), stress_presets(spark))
    return s.groupBy("scenario", "symbol").agg(F.count("*").alias("n"), r(F.avg("price"), 4).alias("price"), r(F.avg(F.col("ask") - F.col("bid")), 4).alias("spread"))


@query("v10_stress_presets", f"SELECT col0 AS scenario, symbol, R6(avg(price) * (1 + col1)) AS gapped FROM (VALUES {_PRE}), v_ticks GROUP BY 1, 2, col1", "v_ticks")
def v10(spark, sf):
    t = ticks(spark, sf).groupBy("symbol").agg(F.avg("price").alias("p"))
    return t.crossJoin(F.broadcast(stress_presets(spark))).select("scenario", "symbol", r(F.col("p") * (1 + F.col("gap"))).alias("gapped"))


@query(
    "v11_conditional_stress",
    f"""WITH {_Q}, sm AS (SELECT *, sum(ln(1 + r)) OVER w AS s, count(*) OVER w AS c FROM q WINDOW w AS (PARTITION BY curve_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    rk AS (SELECT curve_id, i, row_number() OVER (PARTITION BY curve_id ORDER BY s, i) - 1 AS rank, count(*) OVER (PARTITION BY curve_id) AS m FROM sm WHERE c = 20), wo AS (SELECT * FROM rk WHERE rank < greatest(1, floor(m * 0.1::DOUBLE))),
    pk AS (SELECT curve_id, count(*) AS k FROM wo GROUP BY 1), pl AS (SELECT curve_id, k, run, unnest(range((SELECT any_value(n) FROM q WHERE q.curve_id = pk.curve_id))) AS j FROM pk, range(10) t(run)),
    st AS (SELECT curve_id, run, j, floor({uniform_sql(6, name_sql('curve_id'), 'run', 'j // 20')} * k)::BIGINT AS rank FROM pl), dr AS (SELECT st.curve_id, st.run, q.i, q.r FROM st JOIN wo ON wo.curve_id = st.curve_id AND wo.rank = st.rank JOIN q ON q.curve_id = st.curve_id AND q.i = wo.i + st.j % 20) {_STATS}""",
    "v_returns",
)
def v11(spark, sf):
    return _moments(conditional_stress(_rets(spark, sf), 0.1, 20, 10, seed=6))
