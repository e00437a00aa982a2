"""Near-duplicate vectors through an index of pivot permutations."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, n_partitions, read

#: Nearest pivots, in order, that describe a vector; how many of the nearest make its lists; and how many of NEAREST
#: two vectors of a list must share before their cosine is taken.
NEAREST, KEYED, SHARED = 10, 7, 3
#: Reference points of a width: the square root of its vectors' number times PER_ROOT, within these bounds and within
#: POINT_BYTES, so that what is broadcast has a fixed size.
FEWEST_PIVOTS, MOST_PIVOTS, PER_ROOT, POINT_BYTES = 32, 32_768, 2.0, 1 << 28
#: Rows of a list that one side of a block holds, and rows of it that are compared at a time.
BLOCK, TILE = 2048, 256
#: Lists of up to SMALL rows are compared together, STRETCH rows at a time.
SMALL, STRETCH = 48, 8192
#: Representatives of one width that are all compared with each other.
WHOLE = 1024


def rows_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, good) of every row: single-precision vectors stay so on the way, others become doubles."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def pivots(reps: DataFrame, sizes: dict[int, int], count: int | None = None) -> dict[int, tuple[int, np.ndarray | None]]:
    """Per width the number of its first pivot and its reference points: the vectors with the smallest hashes, so a
    rerun takes the same. ``sizes``: representatives per width. Widths of up to WHOLE have no points but one list.

    One job for all widths: a width's share of the hash space that holds twice its points is collected.
    """
    most = {w: max(2, min(MOST_PIVOTS, POINT_BYTES // (8 * w))) for w in sizes}
    wanted = {w: min(n, count or min(most[w], max(FEWEST_PIVOTS, round(PER_ROOT * math.sqrt(n))))) for w, n in sizes.items() if n > 1 and (count or n > WHOLE)}
    wanted = {w: k for w, k in wanted.items() if k > 1}
    found: dict[int, list] = {w: [] for w in wanted}
    if wanted:
        upto = [(w, min(2**63 - 1, -(2**63) + 2**64 * 2 * k // sizes[w])) for w, k in wanted.items()]
        shares = reps.sparkSession.createDataFrame(upto, "width int, upto long")
        near = reps.select("width", F.xxhash64("v").alias("h"), "v").join(F.broadcast(shares), "width").where("h <= upto").select("width", "h", "v")
        for r in near.collect():
            found[r["width"]].append((r["h"], r["v"]))
    out, first = {}, 0
    for w in sorted(sizes):
        points = _unit(np.array([v for _, v in sorted(found[w])[: wanted[w]]], float)) if w in wanted and len(found[w]) > 1 else None
        out[w] = (first, points)
        first += 2 if points is None else len(points)
    return out


def described(reps: DataFrame, points: dict[int, tuple[int, np.ndarray | None]], nearest: int = NEAREST, keyed: int = KEYED) -> DataFrame:
    """label, rep, copies, v, order (the permutation prefix: nearest pivot first) and keys (its inverted lists).

    A list belongs to two pivots and holds the vectors that have both among their ``keyed`` nearest. Pivots are
    numbered through all widths, so a list holds vectors of one width; a width without points is one list.
    """
    shared = reps.sparkSession.sparkContext.broadcast(points)

    def one(width: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, own = shared.value[width]
        if own is None:
            order = np.tile(np.arange(first, first + 2), (len(v), 1))
        else:
            k = min(nearest, len(own))
            near = _unit(v) @ own.T
            some = np.argpartition(-near, k - 1, axis=1)[:, :k]
            some.sort(axis=1)
            rank = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
            order = first + np.take_along_axis(some, rank, axis=1)
        two = np.sort(order[:, :keyed], axis=1)
        a, b = (np.array(x) for x in zip(*combinations(range(two.shape[1]), 2), strict=True))
        return order.astype(np.int32), (two[:, a] << 32) | two[:, b]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(4).to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                order, keys = one(int(width), part.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), width))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in (order, keys)]
                yield pa.record_batch([*part.columns[:4], *lists], names=["label", "rep", "copies", "v", "order", "keys"])

    kind = reps.schema
    schema = T.StructType([T.StructField(c, kind[c].dataType) for c in ("label", "rep", "copies", "v")] + [T.StructField("order", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType()))])
    return reps.select("label", "rep", "copies", "v", "width").mapInArrow(run, schema)


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Joins the trees of ``root`` (each entry its tree's smallest) along the links x - y."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def compare(key: int, rep: np.ndarray, copies: np.ndarray, v: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float, need: int = SHARED, keyed: int = KEYED):
    """(u, root, n) of one block of list ``key``, or None: retrieval by counts, then cosines of what it retrieves.

    Two vectors that share lists are retrieved in their first one only, that is where no common pivot among the
    ``keyed`` nearest comes before the list's second one; and only if they share ``need`` of all their pivots.
    Incidence matrices over the pivots that stand there twice give both counts.
    """
    count = len(rep)
    second = key & 0xFFFFFFFF
    names, code, often = np.unique(order, return_inverse=True, return_counts=True)
    code = code.reshape(order.shape)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)
    has = np.zeros((count, int((often > 1).sum()) + 1), np.float32)
    has[np.arange(count)[:, None], column[code]] = 1  # the last column takes what stands there once
    has = has[:, :-1]
    low = np.zeros_like(has)
    row, place = np.nonzero(order[:, :keyed] <= second)
    at = column[code[row, place]]
    low[row[at >= 0], at[at >= 0]] = 1
    need = min(need, order.shape[1])
    unit = _unit(v)
    root, partners = np.arange(count), np.zeros(count)
    for i in range(0, len(left), TILE):
        some = left[i : i + TILE]
        mine = (low[some] @ low[right].T == 2) & (has[some] @ has[right].T >= need)
        if same:
            mine &= right[None, :] > some[:, None]
        found = np.count_nonzero(mine)
        if found == 0:
            continue
        if found * 8 > mine.size:
            mine &= unit[some] @ unit[right].T >= threshold
            x, y = np.nonzero(mine)
        else:
            x, y = np.nonzero(mine)
            close = np.einsum("ij,ij->i", unit[some[x]], unit[right[y]]) >= threshold
            x, y = x[close], y[close]
        x, y = some[x], right[y]
        partners += np.bincount(x, copies[y], count) + np.bincount(y, copies[x], count)
        root = _merge(root, x, y)
    met = np.flatnonzero(partners)
    return (rep[met], rep[root[met]], partners[met].astype(np.int64)) if len(met) else None


def compare_small(key: np.ndarray, end: np.ndarray, rep: np.ndarray, copies: np.ndarray, v: np.ndarray, order: np.ndarray, threshold: float, need: int = SHARED, keyed: int = KEYED):
    """``compare`` for many whole lists at once: row i's list ``key[i]`` ends before row ``end[i]``."""
    count = len(rep)
    later = end - 1 - np.arange(count)
    x = np.repeat(np.arange(count), later)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
    near = order[:, :keyed]
    low = ((near[x][:, :, None] == near[y][:, None, :]).any(axis=2) & (near[x] <= (key[x] & 0xFFFFFFFF)[:, None])).sum(axis=1)
    x, y = x[low == 2], y[low == 2]
    common = (order[x][:, :, None] == order[y][:, None, :]).any(axis=2).sum(axis=1)
    x, y = x[common >= min(need, order.shape[1])], y[common >= min(need, order.shape[1])]
    if len(x) == 0:
        return None
    unit = _unit(v)
    close = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
    x, y = x[close], y[close]
    partners = np.bincount(x, copies[y], count) + np.bincount(y, copies[x], count)
    root = _merge(np.arange(count), x, y)
    met = np.flatnonzero(partners)
    return (rep[met], rep[root[met]], partners[met].astype(np.int64)) if len(met) else None


def _steps(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each row but the first differs from the one before it."""
    return np.any([k[1:] != k[:-1] for k in keys], axis=0)


def linked(index: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): for each representative u the rows n it is linked with, and a link u - v that joins components.

    Lists are met by ids first; only members of lists with two rows or more carry their vectors there. Every pair is
    compared in one list, so partners can be counted per list and added. Long lists are dealt as pairs of blocks.
    """
    posts = index.select("label", F.explode("keys").alias("key"), "rep")
    sizes = posts.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        posts.join(sizes, ["label", "key"])
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "label")
    )
    met = cut(dealt).join(index.select("rep", "copies", "v", "order"), "rep")
    names = ["label", "key", "a", "b"]
    ordered = met.select(*names, "own", "rep", "copies", "v", "order").repartition(n_partitions(index), *names).sortWithinPartitions(*names)

    def flat(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
        return column.take(rows).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the whole lists and blocks that ``held`` consists of."""
        table = pa.Table.from_batches(held)
        keys = [table.column(k).to_numpy() for k in range(4)]
        own, rep, copies = (table.column(k).to_numpy() for k in range(4, 7))
        edges = np.flatnonzero(_steps(keys)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(table)]))
        sizes = ends - starts
        some = (sizes > 1) & (sizes <= SMALL) & (keys[2][starts] == keys[3][starts])
        last = np.repeat(ends, sizes)
        small = np.flatnonzero(np.repeat(some, sizes))
        widths = pa.compute.list_value_length(table.column(7)).to_numpy()
        got = []
        for width in np.unique(widths[small]):
            rows = small[widths[small] == width]
            end = np.searchsorted(rows, last[rows])
            got.append(compare_small(keys[1][rows], end, rep[rows], copies[rows], flat(table.column(7), rows).astype(float), flat(table.column(8), rows), threshold))
        for i, j in zip(starts[(sizes > 1) & ~some], ends[(sizes > 1) & ~some], strict=True):
            rows, a, b = np.arange(i, j), keys[2][i], keys[3][i]
            left, right = np.flatnonzero(own[rows] == a), np.flatnonzero(own[rows] == b)
            got.append(compare(int(keys[1][i]), rep[rows], copies[rows], flat(table.column(7), rows).astype(float), flat(table.column(8), rows), left, right, a == b, threshold))
        for x in got:
            if x is not None:
                yield pa.record_batch(list(map(pa.array, x)), names=["u", "v", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch) == 0:
                continue
            held.append(batch)
            if sum(map(len, held)) < STRETCH:
                continue
            table = pa.Table.from_batches(held)
            steps = np.flatnonzero(_steps([table.column(k).to_numpy() for k in range(4)]))
            if len(steps):
                yield from found(table.slice(0, steps[-1] + 1).to_batches())
                held = table.slice(steps[-1] + 1).to_batches()
        if held:
            yield from found(held)

    return ordered.mapInArrow(run, "u long, v long, n long")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, n_pivots: int | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors are compared by cosine in double precision when their labels are equal and not null. A vector that is
    null, zero or holds null or non-finite components links with nothing. Vectors of different lengths do not link;
    there may be any number of lengths. Vectors that are exactly equal form one representative: they link with each
    other and share its links. Rows that repeat a vec_id are vectors of their own, each counted as a partner; the
    smallest vec_id of a class names it, and all rows of that vec_id in it are kept. A null vec_id gets a null
    component and links with nothing. Other columns are ignored; an empty table gives an empty table. The driver
    holds one number per vector length and the reference points (POINT_BYTES a length at most).
    """
    rows = cut(rows_of(vectors))
    good = rows.where("good")
    # Scaled copies are as near as equal ones, but only equal arrays are merged: cosine decides on the rest. Two
    # classes may hold the same vec_id, so a class is known by a number of its own.
    reps = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()).withColumn("width", F.size("v")))
    # A width that only one representative has links with nothing.
    sizes = {r["width"]: r["count"] for r in reps.groupBy("width").count().where("count > 1").collect()}
    widths = vectors.sparkSession.createDataFrame([(w,) for w in sizes], "width int")
    some = reps.join(F.broadcast(widths), "width", "left_semi")
    links = cut(linked(cut(described(some, pivots(some, sizes, n_pivots))), threshold))
    classes = components(links.select("u", "v")).withColumnRenamed("node", "rep")
    partners = links.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    joined = reps.select("rep", "least").join(partners, "rep").join(classes, "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    smallest = joined.groupBy("class").agg(F.min("least").alias("component"))
    found = cut(joined.select("rep", "n", "class").join(smallest, "class").select("rep", "n", "component"))
    known = reps.join(found, "rep", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "least").alias("component"))
    met = good.join(known, ["label", "v"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionAll(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


ORACLES = {
    "op4_embedding_dedup": """
        WITH RECURSIVE g AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
             WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(a, z) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, p.y FROM reach JOIN p ON reach.z = p.x),
        c AS (SELECT a, min(z) AS m FROM reach GROUP BY a),
        n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN c ON a = vec_id LEFT JOIN n ON x = vec_id"""
}
QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
