"""Windows and recurrences over keys of any length.

A key with more than LENGTH rows is cut into stretches by quantiles of its order column, so that no task holds a whole
hot key. Windows over the last k rows see the k - 1 rows before their stretch; running windows and recurrences that
compose get what the stretches before theirs add up to. Keys that are shorter are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stretch, and the most stretches of a key; beyond it they get longer.
LENGTH, MOST = 2_000_000, 2_000
#: Cut points that a row is compared with at a time.
BLOCK = 45
#: A length that no key has, for tables whose keys are known to be short.
NEVER = 1 << 60

Specs = dict[str, tuple[str, Column]]


def surely_short(df: DataFrame, length: int) -> bool:
    """Whether Spark's own estimate of the table's size leaves no room for a key of ``length`` rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 8 * length


@dataclass
class Stretches:
    """``df`` with a column ``_st`` where some key is cut; ``keys`` are then the columns that name a stretch."""

    df: DataFrame
    key: list[str]
    order: tuple[str, ...]
    hot: DataFrame | None
    parts: int | None = None  # tasks over which keys are dealt, so that few share one; None: few rows

    @property
    def keys(self) -> list[str]:
        return [*self.key, "_st"] if self.hot is not None else self.key

    def window(self, order: tuple[str, ...] | None = None):
        return Window.partitionBy(*self.keys).orderBy(*(order or self.order))

    def bounded(self, df: DataFrame, k: int, f: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
        """``f(rows, keys)`` with frames of at most the ``k`` last rows (so lag up to k - 1); it adds columns to rows."""
        if self.hot is None or k <= 1:
            return f(df, self.keys)
        desc = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order])
        last = df.join(F.broadcast(self.hot.select(*self.key)), self.key, "left_semi").withColumn("_from_last", F.row_number().over(desc)).where(F.col("_from_last") < k).drop("_from_last")
        context = last.withColumn("_st", F.col("_st") + 1)
        rows = df.withColumn("_own", F.lit(True)).unionByName(context.withColumn("_own", F.lit(False)))
        return f(rows, self.keys).where("_own").drop("_own")

    def running(self, df: DataFrame, specs: Specs, before: bool = False) -> DataFrame:
        """Columns name: (sum, count, max, min, last or first, value) over all rows so far; ``before``: without the current one.

        ``last`` and ``first`` skip nulls.
        """
        w = self.window().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        plain = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, True), "first": lambda c: F.first(c, True)}
        out = df.withColumns({n: plain[kind](c).over(w) for n, (kind, c) in specs.items()})
        if self.hot is None:
            return out
        at = F.struct(*self.order)
        whole = plain | {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), at)), "first": lambda c: F.min_by(c, F.when(c.isNotNull(), at))}
        hot = df.join(F.broadcast(self.hot.select(*self.key)), self.key, "left_semi")
        sums = hot.groupBy(*self.keys).agg(*[whole[kind](c).alias(f"_t_{n}") for n, (kind, c) in specs.items()])
        fold = Window.partitionBy(*self.key).orderBy("_st").rowsBetween(Window.unboundedPreceding, -1)
        again = plain | {"count": F.sum}
        carried = sums.select(*self.keys, *[again[kind](F.col(f"_t_{n}")).over(fold).alias(f"_c_{n}") for n, (kind, _) in specs.items()])
        met = out.join(F.broadcast(carried), self.keys, "left")  # a row per stretch of the hot keys
        both = {"max": F.greatest, "min": F.least, "last": F.coalesce, "first": lambda a, b: F.coalesce(b, a), "sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + F.coalesce(b, F.lit(0))}
        made = {n: both[kind](F.col(n), F.col(f"_c_{n}")) for n, (kind, _) in specs.items()}
        return met.withColumns(made).drop(*[f"_c_{n}" for n in specs])

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop("_st") if self.hot is not None else df


def number(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are at or below ``value``: by blocks of them first, then inside one block."""
    blocks = F.sequence(F.lit(BLOCK), F.size(cuts), F.lit(BLOCK))  # the last place of each full block
    full = F.when(F.size(cuts) >= BLOCK, F.size(F.filter(blocks, lambda i: F.element_at(cuts, i) <= value))).otherwise(0)
    return full * BLOCK + F.size(F.filter(F.slice(cuts, full * BLOCK + 1, BLOCK), lambda c: c <= value))


def stretches(df: DataFrame, key: list[str] | str, order: tuple[str, ...] = ("ts_ns", "seq"), length: int | None = None, least: int = 1) -> Stretches:
    """Cuts the keys of ``df`` with more than ``length`` rows where the first column of ``order`` (a number) says.

    A stretch with less than ``least`` rows is joined to the one before it, so that it never hides rows that a frame
    of ``least`` rows needs.
    """
    key, length = [key] if isinstance(key, str) else list(key), length or LENGTH
    if surely_short(df, length):
        return Stretches(df, key, order, None)
    most, rows = df.groupBy(*key).count().agg(F.max("count"), F.sum("count")).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * -(-rows // length)) if most is not None and rows > length else None
    if most is None or most <= length:
        return Stretches(df, key, order, None, parts)
    counts = df.groupBy(*key).count().where(F.col("count") > length)
    n = min(MOST, -(-most // length))
    places = F.array(*[F.lit(i / n) for i in range(1, n)])
    hot = df.join(F.broadcast(counts.select(*key)), key, "left_semi")
    fine = hot.groupBy(*key).agg(F.percentile_approx(order[0], places, F.lit(10 * n)).alias("_fine"))
    # The longest key has n stretches; of the others' quantiles only as many are kept as they have stretches themselves.
    own = F.least(F.lit(MOST), F.ceil(F.col("count") / F.lit(length))).cast("int")
    place = lambda i: F.greatest(F.lit(1), F.least(F.lit(n - 1), F.round(i * F.lit(n) / own).cast("int")))
    kept = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.element_at("_fine", place(i)))
    cuts = fine.join(counts, key).where(own > 1).select(*key, F.array_distinct(kept).alias("_cuts"))
    if least > 1:
        sizes = hot.join(F.broadcast(cuts), key).groupBy(*key, "_cuts", number(F.col("_cuts"), F.col(order[0])).alias("_s")).count()
        own_sizes = sizes.groupBy(*key, "_cuts").agg(F.array_sort(F.collect_list(F.struct("_s", "count"))).alias("_n"))
        keep = F.transform(F.filter("_n", lambda x: (x["_s"] > 0) & (x["count"] >= least)), lambda x: F.element_at("_cuts", x["_s"]))
        cuts = own_sizes.select(*key, keep.alias("_cuts"))
    # Cut points of the hot keys alone: at most 2 * rows / length of them. Written out, so that all uses agree.
    cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    marked = df.join(F.broadcast(cuts), key, "left").withColumn("_st", F.coalesce(number(F.col("_cuts"), F.col(order[0])), F.lit(0))).drop("_cuts")
    return Stretches(marked, key, order, cuts, parts)


#: Most keys whose rows are broadcast to the other table.
FEW = 100_000


def beside_few(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", few: int = FEW) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row per key, so that a few keys are never a few tasks.

    Up to ``few`` keys, counted, are broadcast with what the table says of them; with more, both meet by key.
    """
    own = rows.select(*keys).distinct()
    if own.limit(few + 1).count() > few:
        return rows.join(table, keys, how)
    return rows.join(F.broadcast(table.join(F.broadcast(own), keys, "left_semi")), keys, how)


def over_rows(df: DataFrame, key: list[str] | str, k: int, f: Callable[[DataFrame, WindowSpec], DataFrame], order: tuple[str, ...] = ("ts_ns",), length: int | None = None) -> DataFrame:
    """``f(rows, window)`` adds columns that look back at most k - 1 rows (``lag``) in a key of any length; without a frame."""
    cut = stretches(df, key, order, length, least=k)
    return cut.done(cut.bounded(cut.df, k, lambda d, keys: f(d, Window.partitionBy(*keys).orderBy(*order))))


def placed(df: DataFrame, key: list[str] | str, name: str, order: tuple[str, ...] = ("ts_ns",), start: int = 0, length: int | None = None) -> DataFrame:
    """``df`` with each row's number in its key, from ``start``; keys of any length."""
    cut = stretches(df, key, order, length)
    return cut.done(cut.running(cut.df, {name: ("count", F.lit(1))})).withColumn(name, F.col(name) + (start - 1))


@dataclass
class Carry:
    """How a recurrence composes: ``fold(summary or None, rows)`` and ``apply(state or None, summary) -> state``, both tuples."""

    summary: str
    state: str
    fold: Callable[[tuple | None, pd.DataFrame], tuple]
    apply: Callable[[tuple | None, tuple], tuple]


Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple, dict]]


def _pieces(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The contiguous rows of each key, with the key."""
    own = pdf[keys]
    moved = own.shift()
    new = ((own != moved) & ~(own.isna() & moved.isna())).any(axis=1).to_numpy()
    new[0] = True
    at = np.flatnonzero(new)
    for i, j in zip(at, [*at[1:], len(pdf)], strict=True):
        yield tuple(None if pd.isna(x) else x for x in own.iloc[i]), pdf.iloc[i:j].reset_index(drop=True)


def _dealt(rows: DataFrame, cut: Stretches) -> DataFrame:
    """``rows`` by stretch; a given number of tasks is not merged into fewer."""
    return rows.repartition(*cut.keys) if cut.parts is None else rows.repartition(cut.parts, *cut.keys)


def scan(df: DataFrame, keys: list[str], order: list[str], step: Step, added: str, carry: Carry | None = None, length: int | None = None, parts: int | None = None) -> DataFrame:
    """Adds the columns of a recurrence: ``step(state or None, rows) -> (state, columns)`` over each key's rows in order.

    Sorted batches stream through the step; only the state is kept, never a key's rows. With ``carry`` long keys are
    cut: every stretch is summed up, the summaries of a key are applied in turn, and each stretch starts from the
    state before it. Without one the recurrence does not compose, and a key is one task, of ``parts`` if it is given.
    """
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])
    cut = stretches(df, keys, tuple(order), length) if carry else Stretches(df, keys, tuple(order), None, parts)
    rows, names = cut.df, cut.keys
    first: list[str] = []
    if cut.hot is not None:
        first = [f"_f_{f.name}" for f in T._parse_datatype_string(carry.state).fields]
        rows = rows.join(F.broadcast(_starts(cut, carry)), names, "left")
    ordered = _dealt(rows, cut).sortWithinPartitions(*names, *order)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            done = []
            for name, piece in _pieces(pdf, names):
                if name != last:
                    last, state = name, None
                    if first and not piece[first].iloc[0].isna().any():
                        state = tuple(piece[first].iloc[0])
                state, columns = step(state, piece)
                done.append(piece.assign(**columns)[schema.names])
            yield pd.concat(done, ignore_index=True) if len(done) > 1 else done[0]

    return ordered.mapInPandas(run, schema)


def _starts(cut: Stretches, carry: Carry) -> DataFrame:
    """The state before each stretch of the hot keys but the first: a row per stretch."""
    hot = cut.df.join(F.broadcast(cut.hot.select(*cut.key)), cut.key, "left_semi")
    head = [cut.df.schema[k] for k in cut.key] + [T.StructField("_st", T.IntegerType())]
    sums, states = T._parse_datatype_string(carry.summary).fields, T._parse_datatype_string(carry.state).fields
    names, fold, apply = cut.keys, carry.fold, carry.apply  # what tasks get: no DataFrame among it

    def summed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        columns = [f.name for f in (*head, *sums)]
        for pdf in batches:
            if len(pdf) == 0:
                continue
            for name, piece in _pieces(pdf, names):
                if name != last:
                    if last is not None:
                        yield pd.DataFrame([(*last, *held)], columns=columns)
                    last, held = name, None
                held = fold(held, piece)
        if last is not None:
            yield pd.DataFrame([(*last, *held)], columns=columns)

    def applied(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, state = pdf.sort_values("_st"), [], None
        for row in pdf.itertuples(index=False):
            if state is not None:
                out.append((*row[: len(head)], *state))
            state = apply(state, tuple(row[len(head) :]))
        return pd.DataFrame(out, columns=[f.name for f in head] + [f"_f_{f.name}" for f in states])

    table = _dealt(hot, cut).sortWithinPartitions(*cut.keys, *cut.order).mapInPandas(summed, T.StructType([*head, *sums]))
    return table.groupBy(*cut.key).applyInPandas(applied, T.StructType([*head, *[T.StructField(f"_f_{f.name}", f.dataType) for f in states]]))


def replay(df: DataFrame, keys: list[str], order: list[str], step: Callable, stop: Callable, out: str) -> DataFrame:
    """Rows of ``out`` made on the way: ``step(state or None, rows) -> (state, rows out)`` and ``stop(state) -> rows out``.

    Like ``scan``, but a step may give any number of rows, and ``stop`` is asked after the last row of each key. Both
    give lists of tuples after the keys.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(out).fields])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            made: list[tuple] = []
            for name, piece in _pieces(pdf, keys):
                if name != last:
                    if last is not None:
                        made += [(*last, *x) for x in stop(state)]
                    last, state = name, None
                state, rows = step(state, piece)
                made += [(*name, *x) for x in rows]
            if made:
                yield pd.DataFrame(made, columns=schema.names)
        made = [(*last, *x) for x in stop(state)] if last is not None else []
        if made:
            yield pd.DataFrame(made, columns=schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with each row's number (from 1) in the order of all rows, without one task for all of them.

    The rows are range-sorted and written out once, so that ranges stand still; the sizes of the ranges, a row for
    each, say where a range starts.
    """
    from tickspark.plans.catalog import cut

    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, inside + F.col("_start")).drop("_id", "_part", "_start")
