"""Hard negatives from Hilbert-ordered Parquet blocks, chosen by interval bounds on their zone maps."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_folder, cut, n_partitions, read, small_batches

#: Components become floor(SCALE * x).
SCALE = 256
#: Dimensions of the Hilbert curve, those of the largest spread, and bits of each.
DIMS, CURVE_BITS = 8, 7
#: Rows of a block, and most rows of a piece: the blocks that one task holds while anchors stream past.
BLOCK, PIECE = 512, 1 << 15
#: Anchors that are compared at a time.
TILE = 256
#: Components whose products may sum beyond this are multiplied as whole numbers of any size.
EXACT = 1 << 53
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def hilbert(coords: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place of each row of ``coords`` (whole numbers below 2^bits) on the Hilbert curve through their cube."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, from the largest to the smallest
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q, width) of the rows that take part: id, label and vector not null, components finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    q = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q")).withColumn("width", F.size("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _by_width(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length; column ``at`` holds it."""
    widths = batch.column(at).to_numpy()
    for width in np.unique(widths):
        yield int(width), batch.filter(pa.array(widths == width))


def spreads(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per vector length: the DIMS dimensions of the largest variance, over all rows, and their mean and deviation."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for width, part in _by_width(batch, 1):
                q = _matrix(part.column(0), width).astype(float)
                one = held.setdefault(width, [0, np.zeros(width), np.zeros(width)])
                one[0] += len(q)
                one[1] += q.sum(axis=0)
                one[2] += (q**2).sum(axis=0)
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), *[pa.array([x[k].tolist() for x in held.values()], pa.list_(pa.float64())) for k in (1, 2)]], names=["width", "n", "s", "sq"])

    def dims(table: pa.Table) -> pa.Table:
        width, n = table.column("width")[0].as_py(), float(np.sum(table.column("n").to_numpy()))
        s, sq = (_matrix(table.column(c).combine_chunks(), width).sum(axis=0) / n for c in ("s", "sq"))
        var = np.maximum(sq - s**2, 0.0)
        best = np.argsort(-var, kind="stable")[:DIMS]
        kinds = (("dim", best, pa.int64()), ("mean", s[best], pa.float64()), ("dev", np.sqrt(var[best]), pa.float64()))
        return pa.table({"width": pa.array([width], pa.int32())} | {name: pa.array([x.tolist()], pa.list_(kind)) for name, x, kind in kinds})

    partial = rows.select("q", "width").mapInArrow(sums, "width int, n long, s array<double>, sq array<double>")
    found = partial.groupBy("width").applyInArrow(dims, "width int, dim array<long>, mean array<double>, dev array<double>")
    return {r["width"]: (np.array(r["dim"], np.int64), np.array(r["mean"]), np.array(r["dev"])) for r in found.collect()}


def build_index(rows: DataFrame, folder: str, piece_rows: int = PIECE, block_rows: int = BLOCK) -> DataFrame:
    """Writes ``rows`` to Parquet in Hilbert order and reads them: piece, block, uid, vec_id, label, q, width.

    A piece is one range of the curve, at most about ``piece_rows`` rows, in a directory of its own, so that a query
    reads only the pieces that it names; its blocks hold ``block_rows`` rows of one vector length. The curve runs
    through the dimensions of the largest spread; rows of one place lie by id, so copies of a vector fill many pieces.
    """
    known = rows.sparkSession.sparkContext.broadcast(spreads(rows))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch, 3):
                place = np.zeros(len(part), np.int64)
                if width:
                    dim, mean, dev = known.value[width]
                    z = (_matrix(part.column(2), width)[:, dim] - mean) / np.where(dev > 0, dev, 1.0)
                    place = hilbert(np.clip((z + 3) / 6 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1))
                yield pa.record_batch([*part.columns, pa.array(place)], names=["vec_id", "label", "q", "width", "place"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, block = 0, None, -1
        for batch in batches:
            widths, out = batch.column(3).to_numpy(), np.empty(len(batch), np.int32)
            for i, width in enumerate(widths):
                if width != last or seen == block_rows:
                    seen, last, block = 0, width, block + 1
                seen += 1
                out[i] = block
            yield pa.record_batch([*batch.columns[:4], batch.column(5), pa.array(out), batch.column(6)], names=["vec_id", "label", "q", "width", "piece", "block", "uid"])

    schema = "vec_id long, label long, q array<long>, width int"
    keyed = rows.mapInArrow(placed, f"{schema}, place long")
    pieces = max(n_partitions(rows), -(-rows.count() // piece_rows))
    ranged = keyed.repartitionByRange(pieces, "width", "place", "vec_id").sortWithinPartitions("width", "place", "vec_id")
    numbered = ranged.withColumn("piece", F.spark_partition_id()).withColumn("uid", F.monotonically_increasing_id())
    numbered.mapInArrow(blocks, f"{schema}, piece int, block int, uid long").write.partitionBy("piece").parquet(folder)
    return rows.sparkSession.read.schema(f"{schema}, block int, uid long, piece int").parquet(folder)


def zone_maps(index: DataFrame) -> DataFrame:
    """piece, width, lo, hi: the least and largest component per dimension of a piece's vectors of one length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            pieces = batch.column(0).to_numpy()
            for piece in np.unique(pieces):
                for width, part in _by_width(batch.filter(pa.array(pieces == piece)), 1):
                    q = _matrix(part.column(2), width)
                    lo, hi = q.min(axis=0), q.max(axis=0)
                    old = held.get((int(piece), width))
                    held[int(piece), width] = [np.minimum(lo, old[0]), np.maximum(hi, old[1])] if old else [lo, hi]
        keys = list(held)
        both = [pa.array([held[k][i].tolist() for k in keys], pa.list_(pa.int64())) for i in (0, 1)]
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *both], names=["piece", "width", "lo", "hi"])

    parts = index.select("piece", "width", "q").mapInArrow(run, "piece int, width int, lo array<long>, hi array<long>")

    def met(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        lo, hi = _matrix(table.column("lo").combine_chunks(), width).min(axis=0), _matrix(table.column("hi").combine_chunks(), width).max(axis=0)
        return pa.table({"piece": table.column("piece").slice(0, 1), "width": table.column("width").slice(0, 1), "lo": pa.array([lo.tolist()], pa.list_(pa.int64())), "hi": pa.array([hi.tolist()], pa.list_(pa.int64()))})

    return parts.groupBy("piece", "width").applyInArrow(met, "piece int, width int, lo array<long>, hi array<long>")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``: as doubles while sums fit, else as whole numbers."""
    most = int(np.abs(a.astype(float)).max(initial=0)) * int(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LONG_MIN, LONG_MAX).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with any vector between the rows of ``lo`` and ``hi``."""
    most = int(np.abs(a.astype(float)).max(initial=0)) * int(max(np.abs(lo.astype(float)).max(initial=0), np.abs(hi.astype(float)).max(initial=0))) * max(1, a.shape[1])
    kind = float if most < EXACT else object
    up, down = np.maximum(a, 0).astype(kind), np.minimum(a, 0).astype(kind)
    lo, hi = lo.astype(kind).T, hi.astype(kind).T
    found = up @ lo + down @ hi, up @ hi + down @ lo
    return tuple(np.clip(x, LONG_MIN, LONG_MAX).astype(np.int64) if kind is object else x.astype(np.int64) for x in found)


class _Piece:
    """The blocks of a piece for one vector length, with their zone maps."""

    def __init__(self, q: np.ndarray, vec_id: np.ndarray, label: np.ndarray, uid: np.ndarray, block: np.ndarray):
        self.q, self.vec_id, self.label, self.uid = q, vec_id, label, uid
        self.edges = [*np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), len(block)]
        spans = list(zip(self.edges, self.edges[1:], strict=False))
        self.lo = np.array([q[i:j].min(axis=0) for i, j in spans])
        self.hi = np.array([q[i:j].max(axis=0) for i, j in spans])

    def search(self, a: np.ndarray, label: np.ndarray, uid: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, vec_ids, scores): the first ``k`` rows of each window here. Window w asks for scores from lo[w] to
        hi[w] with anchor ``of[w]``. Blocks are read from the one of the highest bound; one is left out when its bounds
        miss the window, or lie below the k-th score found so far."""
        least, most = bounds(a, self.lo, self.hi)
        order = np.argsort(-most, axis=1, kind="stable")
        score = np.zeros((len(a), len(self.q)), np.int64)
        done = np.zeros((len(a), len(self.lo)), bool)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in of]
        floor = lo.copy()
        for step in range(order.shape[1]):
            block = order[:, step]
            mine = block[of]
            open_ = (most[of, mine] >= floor) & (least[of, mine] <= hi)
            if not open_.any():
                if (most[of, mine] < floor).all():
                    break  # later blocks have lower bounds still
                continue
            asked = np.unique(of[open_])
            for b in np.unique(block[asked]):
                who = asked[block[asked] == b]
                i, j = self.edges[b], self.edges[b + 1]
                score[who, i:j] = products(a[who], self.q[i:j])
                done[who, b] = True
            for w in np.flatnonzero(open_):
                x, b = of[w], mine[w]
                i, j = self.edges[b], self.edges[b + 1]
                s = score[x, i:j]
                fit = (s >= floor[w]) & (s <= hi[w]) & ((self.label[i:j] == label[x]) == same) & (self.uid[i:j] != uid[x])
                if not fit.any():
                    continue
                ids, scores = np.concatenate((best[w][0], self.vec_id[i:j][fit])), np.concatenate((best[w][1], s[fit]))
                top = np.lexsort((ids, -scores))[:k]
                best[w] = ids[top], scores[top]
                if len(top) == k:
                    floor[w] = max(floor[w], scores[top[-1]])
        for w, (ids, scores) in enumerate(best):
            if len(ids):
                yield w, ids, scores


def search(index: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """uid, w, vec_id, score: for each window of ``asked`` the first ``k`` rows of each piece that it is sent to.

    ``asked``: piece, uid, label, q, width, w (numbers of windows), lo, hi (arrays beside it). A task holds one piece's
    rows at a time and lets its anchors stream past; only pieces that someone asks for are read.
    """
    pieces = [r["piece"] for r in asked.select("piece").distinct().collect()]  # a number per directory of the index
    rows = index.where(F.col("piece").isin(pieces))
    none = lambda kind, name: F.lit(None).cast(f"array<{kind}>").alias(name)
    left = rows.select("piece", F.lit(0).alias("kind"), "width", "block", "vec_id", "label", "uid", "q", none("int", "w"), none("long", "lo"), none("long", "hi"))
    right = asked.select("piece", F.lit(1).alias("kind"), "width", F.lit(0).alias("block"), F.lit(0).cast("long").alias("vec_id"), "label", "uid", "q", "w", "lo", "hi")
    dealt = left.unionAll(right).repartition(n_partitions(index), "piece").sortWithinPartitions("piece", "width", "kind", "block")

    def answered(piece: _Piece, part: pa.RecordBatch, width: int) -> pa.RecordBatch:
        sizes = pa.compute.list_value_length(part.column(8)).to_numpy()
        of = np.repeat(np.arange(len(part)), sizes)
        w, lo, hi = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (8, 9, 10))
        uid = part.column(6).to_numpy()
        got = list(piece.search(_matrix(part.column(7), width), part.column(5).to_numpy(), uid, of, lo, hi, same, k))
        many = np.array([len(x[1]) for x in got], np.int64)
        which = np.repeat(np.array([x[0] for x in got], np.int64), many)
        ids, scores = (np.concatenate([x[c] for x in got]) if got else np.empty(0, np.int64) for c in (1, 2))
        return pa.record_batch([pa.array(uid[of[which]]), pa.array(w[which].astype(np.int32)), pa.array(ids), pa.array(scores)], names=["uid", "w", "vec_id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        at, held, piece = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in (0, 2, 1)]
            edges = [*np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in keys], axis=0)))), len(batch)] if len(batch) else [0]
            for i, j in zip(edges, edges[1:], strict=False):
                now, kind, part = (keys[0][i], keys[1][i]), keys[2][i], batch.slice(i, j - i)
                if now != at:
                    at, held, piece = now, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if piece is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    piece = _Piece(_matrix(table.column(7).combine_chunks(), int(now[1])), *[table.column(c).to_numpy() for c in (4, 5, 6, 3)])
                    held = []
                if piece is not None:
                    for x in range(0, len(part), TILE):
                        yield answered(piece, part.slice(x, TILE), int(now[1]))

    return dealt.mapInArrow(run, "uid long, w int, vec_id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    """uid, w, best: the ``k`` highest scores of each window, smaller ids first among equals; tasks keep ``k`` each."""
    from pyspark.sql import Window

    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return top.groupBy("uid", "w").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best"))


def asked_of(anchors: DataFrame, zones: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """A row of ``anchors`` for each piece whose bounds meet one of its windows, but its home piece, with those windows."""
    shared = anchors.sparkSession.sparkContext.broadcast(zones)
    names = ["piece", "uid", "label", "q", "width", "w", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for width, part in _by_width(batch, 4):
                pieces, low, high = shared.value[width]
                sizes = pc.list_value_length(part.column(5)).to_numpy()
                of = np.repeat(np.arange(len(part)), sizes)
                w, lo, hi = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (5, 6, 7))
                home = part.column(0).to_numpy()
                for x in range(0, len(pieces), 64):
                    least, most = bounds(_matrix(part.column(3), width), low[x : x + 64], high[x : x + 64])
                    meets = (most[of] >= lo[:, None]) & (least[of] <= hi[:, None]) & (pieces[None, x : x + 64] != home[of][:, None])
                    p, win = np.nonzero(meets.T)
                    if len(p) == 0:
                        continue
                    key = p * len(part) + of[win]
                    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    offsets = pa.array(np.append(at, len(key)), pa.int32())
                    rows = part.take(pa.array(of[win[at]]))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(v[win])) for v in (w.astype(np.int32), lo, hi)]
                    yield pa.record_batch([pa.array(pieces[x + p[at]].astype(np.int32)), *rows.columns[1:5], *lists], names=names)

    return small_batches(anchors.select(names)).mapInArrow(run, "piece int, uid long, label long, q array<long>, width int, w array<int>, lo array<long>, hi array<long>")


def windows_search(index: DataFrame, anchors: DataFrame, zones: dict, same: bool, k: int) -> DataFrame:
    """uid, w, best of all windows of ``anchors`` over the whole index.

    Each anchor reads its home piece first. A window that has ``k`` rows there asks the other pieces only for scores from
    the k-th on, so pieces with lower bounds are not read for it.
    """
    near = cut(search(index, anchors, same, k))
    kth = first(near, k).where(F.size("best") == k).select("uid", "w", (-F.element_at("best", -1)["minus"]).alias("kth"))
    floors = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
    zipped = F.transform(F.arrays_zip("w", "lo"), lambda x: F.greatest(x["lo"], F.coalesce(F.try_element_at("kth", x["w"]), x["lo"])))
    raised = anchors.join(floors, "uid", "left").withColumn("lo", zipped).drop("kth")
    far = search(index, cut(asked_of(raised, zones)), same, k)
    return cut(first(near.unionAll(far), k))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, q (whole numbers), width. The score of two rows is their inner product; higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of its label; its
    negatives beside one of them are the first ``negatives`` rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's. Only vectors of one length meet. Rows that repeat a vec_id are rows of their own, and a
    repeated anchor id is answered for each of its rows. Scores beyond 64 bits are compared and given as the nearest
    64-bit number. An empty table, no anchors, or no rows of a label give no rows.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_folder(spark)}/negatives-{uuid.uuid4().hex}"
    index = build_index(rows, folder)
    zones: dict[int, list] = {}
    for r in zone_maps(index).toLocalIterator():  # two rows of numbers per piece, a piece being up to PIECE rows
        zones.setdefault(r["width"], []).append((r["piece"], r["lo"], r["hi"]))
    maps = {w: (np.array([x[0] for x in z], np.int64), np.array([x[1] for x in z], np.int64).reshape(len(z), w), np.array([x[2] for x in z], np.int64).reshape(len(z), w)) for w, z in zones.items()}
    anchors = cut(index.where(is_anchor).select("piece", "uid", "vec_id", "label", "q", "width"))
    whole = F.array(F.lit(0)).alias("w"), F.array(F.lit(LONG_MIN)).alias("lo"), F.array(F.lit(LONG_MAX)).alias("hi")
    nearest = windows_search(index, anchors.select("piece", "uid", "label", "q", "width", *whole), maps, True, positives)
    chosen = nearest.select("uid", F.transform("best", lambda x: F.struct(x["vec_id"].alias("vec_id"), (-x["minus"]).alias("score"))).alias("positive"))
    wide = lambda p, n: (F.lit(n).cast("decimal(7,0)") * p["score"].cast("decimal(20,0)")) / F.lit(100)
    cell = lambda c: F.greatest(F.least(c, F.lit(LONG_MAX)), F.lit(LONG_MIN)).cast("long")
    windows = (
        F.sequence(F.lit(0), F.size("positive") - 1).alias("w"),
        F.transform("positive", lambda p: cell(F.ceil(wide(p, low)))).alias("lo"),
        F.transform("positive", lambda p: cell(F.floor(wide(p, high)))).alias("hi"),
    )
    met = cut(anchors.join(chosen, "uid").select("piece", "uid", "label", "q", "width", *windows))
    found = windows_search(index, met, maps, False, negatives)
    named = found.join(chosen, "uid").join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    each = named.select("anchor_id", F.element_at("positive", F.col("w") + 1).alias("p"), F.posexplode("best").alias("at", "x"))
    return each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("x.minus")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(read(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


ORACLES = {
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS uid FROM embeddings
             WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.uid AS anchor, b.vec_id, b.uid, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
        n AS (SELECT p.anchor_id, p.anchor, p.k, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score::HUGEINT <= 100 * s.score::HUGEINT AND 100 * s.score::HUGEINT <= 90 * p.score::HUGEINT)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
