"""Exact order statistics of keys of any length: selection by refined histograms.

A key with more than ``stretches.LENGTH`` rows is never sorted, nor are its distinct values held in one place. Each
round counts, per key and interval that is still open, the rows in BINS bins, and goes on with the bins that hold a
wanted rank, narrowed to their least and largest value; what is left at the end has SMALL rows at most. Bins are even on
a logarithmic and on a linear scale in turn, so neither far outliers nor dense clusters stop the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stretches as S

#: Bins of an interval, rows of an interval that are ranked at once, and the most rounds.
BINS, SMALL, ROUNDS = 1024, 100_000, 40


def hot_keys(df: DataFrame, keys: list[str], col: str, length: int | None = None) -> DataFrame | None:
    """keys, _n: the keys with more than ``length`` values that are not null, or None: a row for each ``length`` rows at most."""
    from tickspark.plans.catalog import cut

    length = length or S.LENGTH
    if S.surely_short(df, length):
        return None
    hot = cut(df.groupBy(*keys).agg(F.count(col).alias("_n")).where(F.col("_n") > length))
    return None if hot.isEmpty() else hot


def _scaled(v: Column, logarithmic: bool) -> Column:
    v = v.cast("double")
    bounded = F.greatest(F.least(v, F.lit(1e300)), F.lit(-1e300))  # also what is not finite; still in order
    # The logarithm of the smallest double is -744.4, so what is added keeps the order across 0.
    return F.when(bounded == 0, 0.0).otherwise(F.signum(bounded) * (F.ln(F.abs(bounded)) + 750)) if logarithmic else bounded


def _bin(exact: bool, logarithmic: bool) -> Column:
    """The bin of ``_v`` between ``lo`` and ``hi``; ``exact`` for whole numbers that doubles would not tell apart."""
    if exact:
        value, low, high = (F.col(c).cast("decimal(20,0)") for c in ("_v", "lo", "hi"))
        return F.call_function("div", (value - low) * BINS, high - low + 1)
    value, low, high = (_scaled(F.col(c), logarithmic) for c in ("_v", "lo", "hi"))
    return F.when(high > low, F.floor((value - low) / (high - low) * BINS)).otherwise(0)


def _inside(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that lie in one of their key's disjoint intervals, with ``lo`` and ``hi`` of it."""
    lists = spans.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))  # one per wanted rank at most
    own = F.get(F.filter("_spans", lambda x: (F.col("_v") >= x["lo"]) & (F.col("_v") <= x["hi"])), F.lit(0))
    return rows.join(lists, keys).withColumn("_own", own).where("_own is not null").select(*keys, "_v", F.col("_own.lo").alias("lo"), F.col("_own.hi").alias("hi"))


def ranked_values(df: DataFrame, keys: list[str], col: str, targets: DataFrame) -> DataFrame:
    """keys, rank, value: what stands at each 0-based ``rank`` of ``targets`` (keys, rank) among the sorted values that are not null.

    Ties are values like others; NaN is the largest value. Ranks that a key does not have get no row.
    """
    from tickspark.plans.catalog import cut

    rows = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_v"))
    whole = rows.join(targets.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    state = cut(targets.join(whole, keys).where("rank >= 0 and rank < n").withColumn("below", F.lit(0).cast("long")))
    whole_numbers = isinstance(df.schema[col].dataType, T.IntegralType)
    settled = (F.col("lo") == F.col("hi")) | (F.col("n") <= SMALL)
    done = []
    for i in range(ROUNDS):
        done.append(state.where(settled))
        open_ = state.where(~settled)
        if open_.isEmpty():
            break
        number = _bin(whole_numbers and i % 2 == 1, i % 2 == 0)
        counts = _inside(rows, open_, keys).groupBy(*keys, "lo", "hi", number.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        up = F.sum("_c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        met = open_.join(counts.withColumn("_up", up), [*keys, "lo", "hi"])
        inside = met.where((F.col("rank") - F.col("below") < F.col("_up")) & (F.col("rank") - F.col("below") >= F.col("_up") - F.col("_c")))
        state = cut(inside.select(*keys, "rank", F.col("_least").alias("lo"), F.col("_most").alias("hi"), F.col("_c").alias("n"), (F.col("below") + F.col("_up") - F.col("_c")).alias("below")))
    else:
        done.append(state)
    found = cut(reduce(DataFrame.unionByName, done))
    equal = found.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    some = found.where("lo <> hi")
    order = Window.partitionBy(*keys, "lo", "hi").orderBy("_v")
    placed = _inside(rows, some, keys).withColumn("_k", F.row_number().over(order))
    last = some.withColumn("_k", (F.col("rank") - F.col("below") + 1).cast("int")).join(placed, [*keys, "lo", "hi", "_k"])
    return equal.unionByName(last.select(*keys, "rank", F.col("_v").alias("value")))


def values_at(df: DataFrame, keys: list[str], col: str, hot: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """keys, _n and per name the value at a 0-based rank, a column over ``_n``, of the keys in ``hot``."""
    wanted = hot.select(*keys, F.explode(F.array_distinct(F.array(*[r.cast("long") for r in ranks.values()]))).alias("rank"))
    found = ranked_values(df, keys, col, wanted).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    return hot.join(found, keys).select(*keys, "_n", *[F.try_element_at("_at", r.cast("long")).alias(name) for name, r in ranks.items()])


def cold_rows(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    return df.join(hot.select(*keys), keys, "left_anti")


def percentiles(df: DataFrame, keys: list[str], col: str, ps: list[float], name: str = "_q", length: int | None = None) -> DataFrame:
    """keys and an array of interpolated quantiles (type 7) of the values that are not null."""
    plain = lambda d: d.groupBy(*keys).agg(F.percentile(col, F.array(*map(F.lit, ps))).alias(name))
    hot = hot_keys(df, keys, col, length)
    if hot is None:
        return plain(df)
    place = lambda p: (F.col("_n") - 1) * F.lit(p)
    ranks = {f"_lo{i}": F.floor(place(p)) for i, p in enumerate(ps)} | {f"_hi{i}": F.ceil(place(p)) for i, p in enumerate(ps)}
    at = values_at(df, keys, col, hot, ranks)
    part = lambda i, p: place(p) - F.floor(place(p))
    low, high = (lambda i: F.col(f"_lo{i}").cast("double")), (lambda i: F.col(f"_hi{i}").cast("double"))
    made = [F.when(low(i) == high(i), low(i)).otherwise((1 - part(i, p)) * low(i) + part(i, p) * high(i)) for i, p in enumerate(ps)]
    return plain(cold_rows(df, keys, hot)).unionByName(at.select(*keys, F.array(*made).alias(name)))
