"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of ids or terms that are ever broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Without one, a local session takes a temporary folder; on a cluster, whose machines share none, that is an error.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Bounds the Arrow batches that carry whole texts to and from Python, for this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_ids(big: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Joins ``big`` with a materialised table of keys (``left_semi`` or ``left_anti``, or ``inner``).

    The keys are broadcast only when counted to at most BROADCAST_ROWS; more of them meet ``big`` in a
    shuffle join, whose skewed keys AQE can split.
    """
    return big.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def range_prefix(df: DataFrame, group: str | None, order: list[str], value: str, out: str, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exclusive prefix sums of ``value`` in ``order`` within each ``group``, without a task per group.

    The rows are range-sorted once by (group, order) and cut there, so that a hot group spans many tasks. Each
    range adds up its own rows, group by group; the totals per (range, group), at most ranges + groups rows, give
    the offset of each range in a window over the ranges of a group, which a join adds. Nothing is collected, and
    the offsets are broadcast only where they are few. Returns the rows with ``out`` added and the totals per
    group. ``df`` should hold narrow columns only. Sums of whole numbers are longs, others doubles.
    """
    part, inside, by = free(df, "part"), free(df, "inside"), group or free(df, "all")
    if group is None:
        df = df.withColumn(by, F.lit(0))
    ranged = cut(df.repartitionByRange(n or n_partitions(df), by, *order).sortWithinPartitions(by, *order).withColumn(part, F.spark_partition_id()))
    whole = isinstance(ranged.schema[value].dataType, T.IntegralType)
    kind, name = (T.LongType(), "int64") if whole else (T.DoubleType(), "float64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carried = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[by].astype(object).where(pdf[by].notna(), None)
            codes, names = pd.factorize(keys, use_na_sentinel=False)
            names = [None if pd.isna(k) else k for k in names]
            sums = pdf[value].groupby(codes).cumsum() - pdf[value]
            if last == (names[0],):
                sums = sums + np.where(codes == 0, carried, 0)
            pdf[inside] = sums.astype(name)
            carried = pdf[inside].iloc[-1] + pdf[value].iloc[-1]
            last = (names[-1],)
            yield pdf

    local = ranged.mapInPandas(run, T.StructType([*ranged.schema.fields, T.StructField(inside, kind)]))
    parts = cut(ranged.groupBy(part, by).agg(F.sum(value).alias("total")))
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col(part).alias("at"), F.col(by).alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if parts.count() <= BROADCAST_ROWS else starts
    met = local.join(starts, (F.col(part) == F.col("at")) & F.col(by).eqNullSafe(F.col("of")))
    kept = [c for c in df.columns if c != by or group is not None]
    result = met.select(*kept, (F.col(inside) + F.col("start")).cast(kind).alias(out))
    return result, parts.groupBy(by).agg(F.sum("total").cast(kind).alias("total"))


def least_change(label: Column) -> Column:
    return F.sum(label.cast("decimal(38,0)"))


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Connected components of an edge table: (node, component), component being the smallest node.

    Labels sink along edges and then along pointers until their sum stands still, so a star takes one round
    and a chain of d links about log d rounds. Minima are pre-aggregated before each exchange, and both sides
    of each join are cut tables, so that AQE can split the key of a hub. Nothing is collected but the sums.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").unionAll(edges.select(F.col(b), F.col(a)).where(f"{a} <> {b}")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("l")))
    before = None
    while True:
        after = labels.agg(least_change(F.col("l"))).first()[0]
        if after == before or after is None:
            return labels.select("node", F.col("l").alias("component"))
        before = after
        met = both.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "l").unionAll(labels)
        sunk = cut(met.groupBy("node").agg(F.min("l").alias("l")))
        onward = sunk.select(F.col("node").alias("l"), F.col("l").alias("next"))
        labels = cut(sunk.join(onward, "l").select("node", F.least("l", "next").alias("l")))
