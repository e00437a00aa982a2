"""Exact deduplication with a cuckoo-filter index of live digests."""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_ids, n_partitions, read

SLOTS = 4
MAX_KICKS = 200
#: Share of filled slots beyond which an index grows without trying to move entries.
FULLEST = 0.95
#: Most rows that are meant for one index of the last stage: its number of indexes grows with the rows.
PER_INDEX = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooIndex:
    """Live digests in buckets of SLOTS slots: a 16-bit mark of each and, beside it, its record (digest, value).

    A digest may lie in two buckets, the second being the first one moved by its mark. ``find`` looks for the mark in
    both; a hit is verified against the record in that slot, so marks that digests share do no harm. ``insert`` moves
    records between their buckets; where MAX_KICKS moves find no place, the index doubles and the digests of its
    records are placed anew. ``delete`` empties the slot. There is no other copy of the records.
    """

    def __init__(self, capacity: int = 1024):
        self.resizes = self.size = 0
        self._random = random.Random(7)
        self._clear(max(16, 1 << (capacity // SLOTS).bit_length()))

    def __len__(self) -> int:
        return self.size

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.records: list[tuple[bytes, tuple] | None] = [None] * (SLOTS * buckets)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        one = int.from_bytes(digest[2:8], "big") & self.mask
        return mark, one, self._moved(one, mark)

    def _moved(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def _slot(self, digest: bytes) -> int:
        mark, one, two = self._places(digest)
        for at in (one * SLOTS, two * SLOTS):
            for k in range(at, at + SLOTS):
                if self.marks[k] == mark and self.records[k][0] == digest:
                    return k
        return -1

    def find(self, digest: bytes) -> tuple | None:
        k = self._slot(digest)
        return None if k < 0 else self.records[k][1]

    def insert(self, digest: bytes, value: tuple) -> None:
        """Takes in a digest that is not in the index."""
        left = (digest, value) if self.size >= FULLEST * len(self.records) else self._place((digest, value))
        self.size += 1
        if left is not None:
            self._grow(left)

    def update(self, digest: bytes, value: tuple) -> None:
        self.records[self._slot(digest)] = (digest, value)

    def _put(self, bucket: int, mark: int, record: tuple) -> bool:
        for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.marks[k]:
                self.marks[k], self.records[k] = mark, record
                return True
        return False

    def _place(self, record: tuple) -> tuple | None:
        """Finds a slot for ``record``; returns the record that is left without one, if any."""
        mark, one, two = self._places(record[0])
        if self._put(one, mark, record) or self._put(two, mark, record):
            return None
        at = two
        for _ in range(MAX_KICKS):
            k = at * SLOTS + self._random.randrange(SLOTS)
            self.marks[k], mark = mark, self.marks[k]
            self.records[k], record = record, self.records[k]
            at = self._moved(at, mark)
            if self._put(at, mark, record):
                return None
        return record

    def _grow(self, left: tuple) -> None:
        stored = [r for r in self.records if r is not None]
        stored.append(left)
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(r) is None for r in stored):
                return

    def delete(self, digest: bytes) -> bool:
        k = self._slot(digest)
        if k < 0:
            return False
        self.marks[k], self.records[k] = 0, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return (r for r in self.records if r is not None)


def normalised(text: Column) -> Column:
    """A-Z to a-z, nothing else; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _key(doc_id: int | None, uid: int) -> tuple:
    return (doc_id is not None, doc_id or 0, uid)


def _merge(index: CuckooIndex, digest: bytes, doc_id: int | None, uid: int, n: int) -> None:
    """The larger document supersedes: its entry replaces the deleted one of the smaller."""
    old = index.find(digest)
    if old is None:
        index.insert(digest, (doc_id, uid, n))
    elif _key(doc_id, uid) > _key(old[0], old[1]):
        index.delete(digest)
        index.insert(digest, (doc_id, uid, old[2] + n))
    else:
        index.update(digest, (old[0], old[1], old[2] + n))


LIVE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("keep_uid", T.LongType()), T.StructField("group_size", T.LongType())])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, digest): SHA-256 of each normalised whole text; uid tells repeated rows apart."""
    digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), digest.alias("digest"))


def _emit(index: CuckooIndex, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple[bytes, tuple]] = []
    for item in index.items():
        part.append(item)
        if len(part) == step:
            yield _batch(part)
            part = []
    yield _batch(part)


def _batch(part: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in part], pa.binary()), *(pa.array([v[j] for _, v in part], pa.int64()) for j in range(3))], names=LIVE.names)


def _through_index(rows: DataFrame, flush: int | None) -> DataFrame:
    """Sends (digest, doc_id, uid, n) through an index per task; with ``flush``, it is emitted whenever it holds so many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for b in batches:
            for digest, doc_id, uid, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _merge(index, digest, doc_id, uid, n)
            if flush and len(index) >= flush:
                yield from _emit(index)
                index = CuckooIndex()
        yield from _emit(index)

    return rows.mapInArrow(run, LIVE)


def live_digests(rows: DataFrame, n: int | None = None, flush: int = 100_000) -> DataFrame:
    """One row per distinct digest: the document that stays and how many rows share it.

    Copies within a task meet in that task's index first, so a digest that a third of all rows share crosses
    the exchange once per task. Then ``n`` tasks each index the digests of one hash bucket. Their number follows the
    rows (PER_INDEX for each, the session's shuffle partitions at least), so an index has a bounded size.
    """
    local = cut(_through_index(rows.select("digest", "doc_id", "uid", F.lit(1).cast("long").alias("n")), flush))
    n = n or max(n_partitions(rows), -(-local.count() // PER_INDEX))
    return _through_index(local.repartition(n, "digest"), None)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id of equal
    texts stays (of rows that repeat a doc_id, exactly one; a null doc_id stays only among nulls). Other
    columns of ``docs`` are ignored, whatever their names. An empty table gives an empty table.
    """
    rows = cut(digests(docs))
    live = cut(live_digests(rows))
    return rows.join(live, "digest").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each distinct text, with all of its columns.

    Where no doc_id repeats or is null, the dropped ids alone meet the texts; otherwise rows are known by their
    digest, and one row of those with the kept doc_id stays.
    """
    rows = cut(digests(docs))
    live = cut(live_digests(rows))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = cut(rows.join(live, "digest").where("uid <> keep_uid").select("doc_id"))
        return join_ids(docs, gone, ["doc_id"], "left_anti")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"))
    kept = live.select(F.col("digest").alias("live"), F.col("keep_id").alias("keep"))
    match = (F.col("digest") == F.col("live")) & F.col("id").eqNullSafe(F.col("keep"))
    return keyed.join(kept, match, "left_semi").dropDuplicates(["digest"]).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLES = {
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t"""
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
