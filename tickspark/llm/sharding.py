"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, n_partitions, read

#: The key: GROUP_BITS of the text's hash, so that equal texts are neighbours, then ROW_BITS of the document's.
GROUP_BITS, ROW_BITS = 35, 27
TOP = 1 << (GROUP_BITS + ROW_BITS)
#: Probes of the first round and, inside every open interval, of the later ones; and of all intervals of a round, which
#: bounds what the driver gets (at least LEAST_PROBES an interval).
FIRST_PROBES, PROBES, ROUND_PROBES, LEAST_PROBES = 4096, 128, 131_072, 4
#: Rows, and bytes of whole documents, that a task of the exchange is meant to take.
TASK_ROWS, TASK_BYTES = 2_000_000, 1 << 28


def shard_key(text: Column, doc_id: Column) -> Column:
    group = F.shiftrightunsigned(F.xxhash64(text), 64 - GROUP_BITS)
    row = F.shiftrightunsigned(F.xxhash64(F.lit("row"), doc_id), 64 - ROW_BITS)
    return F.shiftleft(group, ROW_BITS).bitwiseOR(row)


def splitters(sized: DataFrame, shards: int, tolerance: float = 0.002, pieces: int = 1) -> list[int]:
    """Keys that cut ``sized`` (key, size) into ``shards`` ranges of near equal bytes, each of ``pieces`` parts.

    Each round counts the exact bytes below candidate boundaries, FIRST_PROBES at first (more for many parts) and then
    up to PROBES in every open interval, ROUND_PROBES in all, in one aggregation, and keeps the interval that holds the
    target. The result of a round has at most that many rows, and parts of a hot group share an interval. A splitter is done when a probe is within
    ``tolerance`` of a shard's bytes (a quarter of a part's bytes between parts of a shard), or when its interval
    cannot be cut further. Boundaries between groups of equal texts are preferred: below the group bits is only
    probed when a group is larger than the tolerance. Every ``pieces``-th key bounds a shard.
    """
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = shards * pieces
    goals = [total * i / parts for i in range(1, parts)]
    slack = [tolerance * total / shards if i % pieces == 0 else total / parts / 4 for i in range(1, parts)]
    lo, hi = [0] * len(goals), [TOP] * len(goals)
    found: list[int | None] = [None] * len(goals)
    probes = max(FIRST_PROBES, min(4 * parts, ROUND_PROBES))
    while total and None in found:
        spans = sorted({(lo[i], hi[i]) for i, at in enumerate(found) if at is None})
        steps = [_step(h - a, probes) for a, h in spans]
        binned = sized.select(_bins(sized.sparkSession, spans, steps, probes + 2)(F.col("key")).alias("bin"), "size")
        counted = binned.groupBy("bin").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toArrow()
        got = dict(zip(counted.column(0).to_pylist(), zip(counted.column(1).to_pylist(), counted.column(2).to_pylist(), strict=True), strict=True))
        at_edge: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        run = 0
        for j, ((a, h), step) in enumerate(zip(spans, steps, strict=True)):
            run += got.get(j * (probes + 2), (0, 0))[0]
            inside = [got.get(j * (probes + 2) + 1 + k, (0, 0)) for k in range(-(-(h - a) // step))]
            below = run + np.cumsum([0, *(x[0] for x in inside)])
            at_edge[(a, h)] = (np.array([*range(a, h, step), h]), below, np.array([x[1] for x in inside]))
            run = int(below[-1])
        for i, at in enumerate(found):
            if at is not None:
                continue
            edges, below, rows = at_edge[(lo[i], hi[i])]
            k = int(np.searchsorted(below, goals[i]))
            near = [int(np.searchsorted(below, below[x])) for x in (k - 1, k) if 0 <= x < len(below)]
            best = min(near, key=lambda x: (abs(below[x] - goals[i]), x))
            if abs(below[best] - goals[i]) <= slack[i]:
                found[i] = int(edges[best])
                continue
            k = max(0, int(np.searchsorted(below[:-1], goals[i], "right")) - 1)
            lo[i], hi[i] = int(edges[k]), int(edges[k + 1])
            if hi[i] - lo[i] <= 1 or rows[k] <= 1:
                found[i] = int(edges[best])
        left = len({(lo[i], hi[i]) for i, at in enumerate(found) if at is None})
        probes = max(LEAST_PROBES, min(PROBES, ROUND_PROBES // max(1, left)))
    return sorted(c if c is not None else TOP for c in found)


def _step(width: int, probes: int) -> int:
    """Distance of probes; whole groups of equal texts as long as the interval holds several."""
    unit = 1 << ROW_BITS if width > 1 << ROW_BITS else 1
    return -(-width // probes // unit) * unit or unit


def _bins(spark: SparkSession, spans: list[tuple[int, int]], steps: list[int], stride: int) -> Callable[[Column], Column]:
    """Numbers the stretch a key lies in: before each span, and each step of a span. By binary search; only the key goes to Python."""
    shared = spark.sparkContext.broadcast((np.array([a for a, _ in spans], np.int64), np.array([h for _, h in spans], np.int64), np.array(steps, np.int64)))

    @F.pandas_udf("long")
    def number(keys: pd.Series) -> pd.Series:
        first, end, step = shared.value
        key = keys.to_numpy()
        span = np.searchsorted(first, key, "right") - 1
        own = np.maximum(span, 0)
        inside = (span >= 0) & (key < end[own])
        return pd.Series(np.where(inside, own * stride + 1 + (key - first[own]) // step[own], (span + 1) * stride))

    return number


def piece_of(spark: SparkSession, cuts: list[int]) -> Callable[[Column], Column]:
    """Number of the ``cuts`` at or below a key, by binary search; only the key goes to Python."""
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def piece(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy(), "right").astype(np.int32))

    return piece


def exchange(keyed: DataFrame, cuts: list[int], key: str, piece: str, order: list[str]) -> DataFrame:
    """The one exchange: every row goes to the task of its piece between the splitters, and is sorted there."""
    placed = keyed.withColumn(piece, piece_of(keyed.sparkSession, cuts)(F.col(key)))
    return placed.repartitionById(len(cuts) + 1, F.col(piece)).sortWithinPartitions(piece, key, *order)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per document row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    The size is the UTF-8 bytes of the text (null: none) plus 1. Equal texts are neighbours in the order, so a
    group lies in one shard unless it is larger than the tolerance at a boundary. Rows with equal keys are
    ordered by doc_id (null first), size and checksum; rows equal in all of them are interchangeable. A shard is
    cut into pieces of about ``task_rows`` rows, one task each, by the same histogram. Other columns are ignored,
    whatever their names; an empty table gives an empty table. The driver holds one number per piece.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shard_key(text, F.col("doc_id").cast("long")).alias("key"),
        )
    )
    pieces = max(1, -(-max(n_partitions(docs), -(-sized.count() // task_rows)) // shards))
    cuts = splitters(sized, shards, tolerance, pieces)
    ranged = cut(exchange(sized, cuts, "key", "piece", ["doc_id", "size", "text_crc32"]))
    rows = {r["piece"]: r["count"] for r in ranged.groupBy("piece").count().collect()}
    starts, run = {}, 0
    for p in range(len(cuts) + 1):
        run = 0 if p % pieces == 0 else run
        starts[p] = run
        run += rows.get(p, 0)
    return ranged.select("doc_id", "size", "text_crc32", "piece").mapInArrow(_slots(starts, pieces), "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")


def _slots(starts: dict[int, int], pieces: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the sorted rows of each piece from where the pieces of its shard before it end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            piece = b.column(3).to_numpy()
            slot = np.empty(len(b), np.int64)
            for p in np.unique(piece):
                rows = np.flatnonzero(piece == p)
                start = seen.get(p, starts[p])
                slot[rows] = start + np.arange(len(rows))
                seen[p] = start + len(rows)
            law, none = pa.array(["bytes"] * len(b)), pa.nulls(len(b), pa.int32())
            yield pa.record_batch([*b.columns[:3], law, pa.array((piece // pieces).astype(np.int32)), pa.array(slot), none], names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    return run


def write_shards(docs: DataFrame, path: str, shards: int = 8, task_bytes: int = TASK_BYTES) -> None:
    """Writes ``docs`` with all columns, one directory per shard, in the order of the keys.

    The directories are named after the column ``shard``, with underscores after it while ``docs`` has such a column.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, piece, name = free(docs, "key"), free(docs, "piece"), free(docs, "shard")
    keyed = docs.withColumn(key, shard_key(text, F.col("doc_id").cast("long")))
    sized = cut(keyed.select(F.col(key).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size")))
    pieces = max(1, -(-(sized.agg(F.sum("size")).first()[0] or 0) // task_bytes // shards))
    placed = exchange(keyed, splitters(sized, shards, pieces=pieces), key, piece, [])
    placed.withColumn(name, F.floor(F.col(piece) / pieces).cast("int")).drop(key, piece).write.partitionBy(name).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {}
QUERIES = {"op9_sharding": op9_sharding}
