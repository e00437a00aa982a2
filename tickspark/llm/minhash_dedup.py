"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, free, join_ids, n_partitions, read, small_batches
from .shingles import chunks, mix, sets

#: Coordinates of a sketch, and rows of a band: 32 bands of 4 find a pair of similarity 0.8 but for 4 in 10^8.
COORDS, BAND = 128, 4
BITS = 7
#: Pairs whose sketches agree in less than this share are not verified: four deviations below 0.8.
SURE = 0.65
#: Rows of a bucket that are compared with each other in one block: with their texts, and by sketches alone.
BLOCK, SKETCHES = 512, 4096

SKETCH = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.ShortType())),
    ]
)


def fast_sketch(items: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """COORDS values for each of ``count`` sets (all non-empty): the fast similarity sketch.

    In round i < COORDS each item falls into a hashed bin with a hashed value; in round COORDS + i every item
    goes to bin i. A bin keeps the least value of the first round that reaches it, so sets leave after the round
    that fills their last bin, and none needs more than 2 * COORDS rounds.
    """
    out = np.full(count * COORDS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(count * COORDS, bool)
    for i in range(2 * COORDS):
        x = mix(items + np.uint64((0x9FB21C651E98DF25 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = owner * COORDS + ((x >> np.uint64(64 - BITS)).astype(np.int64) if i < COORDS else i - COORDS)
        fresh = ~filled[at]
        at, x = at[fresh], x[fresh] << np.uint64(BITS)
        np.minimum.at(out, at, x)
        filled[at] = True
        out[np.unique(at)] += np.uint64(i)  # the shift left the low bits for the round
        done = filled.reshape(count, COORDS).all(axis=1)
        if done.all():
            break
        keep = ~done[owner]
        items, owner = items[keep], owner[keep]
    return out.reshape(count, COORDS)


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """SKETCH rows of (id, doc_id, text): set size, 128-bit digest of the set, band keys and sketch (null for an empty set)."""
    step = COORDS // BAND
    salts = mix(np.arange(1, BAND + 1, dtype=np.uint64))
    lanes = mix(np.arange(1000, 1000 + step, dtype=np.uint64))

    def marks(ids: list[pa.Array], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        items, bounds = sets(data, offsets, width)
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes)
        n = len(sizes)
        a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        at, key_list, sketch_list = np.zeros(n + 1, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint16)
        if len(some):
            a[some] = np.add.reduceat(mix(items), bounds[some])
            b[some] = np.add.reduceat(mix(items * np.uint64(3) + np.uint64(1)), bounds[some])
            got = fast_sketch(items, np.repeat(np.arange(len(some)), sizes[some]), len(some))
            keys = mix((mix(got).reshape(len(some), step, BAND) * salts).sum(axis=2) + lanes)
            key_list, sketch_list = keys.ravel(), (mix(got) >> np.uint64(48)).astype(np.uint16).ravel()
        np.cumsum(sizes > 0, out=at[1:])
        none = pa.array(sizes == 0)
        bands = pa.ListArray.from_arrays(pa.array(at * step, pa.int32()), pa.array(key_list.view(np.int64)))
        sketch = pa.ListArray.from_arrays(pa.array(at * COORDS, pa.int32()), pa.array(sketch_list.view(np.int16)))
        empty = lambda x: pa.compute.if_else(none, pa.scalar(None, x.type), x)
        return pa.record_batch([*ids, pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), empty(bands), empty(sketch)], names=SKETCH.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                yield marks([batch.column(k).slice(i, j - i) for k in (0, 1)], data, offsets)

    return small_batches(rows).select("id", "doc_id", "text").mapInArrow(run, SKETCH)


def _alike(a: str, b: str) -> Column:
    """Share of coordinates in which two sketches agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(COORDS))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * shared >= percent * union on their full shingle sets.

    Only texts of documents in some pair are moved: ids are few or met by a shuffle join (``join_ids``).
    """
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("u").alias("id")).unionAll(pairs.select("v")).distinct())
    texts = join_ids(docs.select("id", "text"), ids, ["id"], "left_semi")
    one = pairs.join(texts.withColumnRenamed("id", "v").withColumnRenamed("text", "right"), "v")
    both = one.join(texts.withColumnRenamed("id", "u").withColumnRenamed("text", "left"), "u").select("u", "v", "left", "right")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            at = 0
            for i, j, data, offsets in chunks(batch.column(3)):
                right, bounds = sets(data, offsets, width)
                lefts = batch.column(2).slice(i, j - i)
                last, own = None, np.empty(0, np.uint64)
                for k in range(j - i):
                    text = lefts[k].as_py() or ""
                    if text != last:
                        raw = np.frombuffer(text.encode(), np.uint8)
                        last, own = text, sets(raw, np.array([0, len(raw)]), width)[0]
                    other = right[bounds[k] : bounds[k + 1]]
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    keep[at + k] = shared > 0 and 100 * shared >= percent * (len(own) + len(other) - shared)
                at += j - i
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "u long, v long").distinct()


NAMES = ("key", "a", "b")


def _dealt(rows: DataFrame, n: Column, block: int) -> DataFrame:
    """Rows of a bucket as pairs of blocks (a, b), each a key of its own, so no task holds more than two blocks at a time."""
    return (
        rows.withColumn("blocks", F.ceil(n / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("a", F.least("own", "other"))
        .withColumn("b", F.greatest("own", "other"))
    )


def _by_block(rows: DataFrame, run: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Hands the rows of each (key, a, b), the first three columns, to ``run`` in one table."""
    ordered = rows.repartition(n_partitions(rows), *NAMES).sortWithinPartitions(*NAMES)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if len(batch) == 0:
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for i, j in zip([0, *new], [*new, len(batch)], strict=True):
                own = tuple(int(k[i]) for k in keys)
                if own != name:
                    got = run(pa.Table.from_batches(held)) if held else None
                    held, name = [], own
                    if got is not None:
                        yield got
                held.append(batch.slice(i, j - i))
        got = run(pa.Table.from_batches(held)) if held else None
        if got is not None:
            yield got

    return ordered.mapInArrow(each, schema)


def _near(block: pa.Table, part: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of other components whose sketches agree with its in SURE or more), over the pairs of a block.

    ``part`` may be changed between the steps: components that have met are not compared again.
    """
    a, b, own = (block.column(k).to_numpy() for k in (1, 2, 3))
    same = a[0] == b[0]
    left = np.flatnonzero(own == a[0])
    right = left if same else np.flatnonzero(own == b[0])
    for k in left:
        others = right[right > k] if same else right
        others = others[part[others] != part[k]]
        close = others[(sketches[others] == sketches[k]).sum(axis=1) >= SURE * COORDS] if len(others) else others
        if len(close):
            yield k, close


def _candidates(rows: DataFrame) -> DataFrame:
    """The rows (key, rep, part, sketch, n) of a bucket that have a near sketch of another component in it.

    Only sketches travel here. Of two near rows both stay, so what is left of a bucket holds all its near pairs.
    """

    def run(block: pa.Table) -> pa.RecordBatch | None:
        part = block.column(5).to_numpy()
        if len(part) < 2 or part.min() == part.max():
            return None
        got = block.column(6).combine_chunks().flatten().to_numpy().reshape(len(part), COORDS)
        met = np.zeros(len(part), bool)
        for k, close in _near(block, part, got):
            met[k] = met[close] = True
        return pa.record_batch([block.column(k).combine_chunks().filter(pa.array(met)) for k in (0, 4)], names=["key", "rep"]) if met.any() else None

    dealt = _dealt(rows, F.col("n"), SKETCHES).select(*NAMES, "own", "rep", "part", "sketch")
    return _by_block(dealt, run, "key long, rep long").distinct()


def _block_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (u, v) between components that meet in a bucket.

    ``rows``: key, rep, part, sketch, text, n (rows of the bucket). Inside a block, pairs of different components whose
    sketches agree in SURE or more are compared on their full sets; a link joins its components for the rest of the
    block, so a block emits less links than it has rows.
    """

    def run(block: pa.Table) -> pa.RecordBatch | None:
        rep, part, out, items = block.column(4).to_numpy(), block.column(5).to_numpy().copy(), [], None
        if len(rep) < 2 or part.min() == part.max():
            return None
        got = block.column(6).combine_chunks().flatten().to_numpy().reshape(len(rep), COORDS)
        for k, close in _near(block, part, got):
            if items is None:
                each = [sets(data, offsets, width) for _, _, data, offsets in chunks(block.column(7).combine_chunks())]
                sizes = np.concatenate([np.diff(x[1]) for x in each])
                names, items = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                mark = np.zeros(len(names), bool)
            mine = items[bounds[k] : bounds[k + 1]]
            mark[mine] = True
            shared = np.array([np.count_nonzero(mark[items[bounds[o] : bounds[o + 1]]]) for o in close])
            mark[mine] = False
            for o in close[100 * shared >= percent * (sizes[k] + sizes[close] - shared)]:
                if part[o] != part[k]:
                    out.append((min(rep[k], rep[o]), max(rep[k], rep[o])))
                    part[part == part[o]] = part[k]
        return pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["u", "v"]) if out else None

    dealt = _dealt(rows, F.col("n"), BLOCK).select(*NAMES, "own", "rep", "part", "sketch", "text")
    return _by_block(dealt, run, "u long, v long").distinct()


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links among the representatives (rep, bands, sketch), enough to connect every linked pair.

    First each bucket is a star: its members meet the bucket's smallest one. Then, in buckets that hold several
    components still, members of different components meet in blocks, first by their sketches alone; the texts of
    those with a near sketch follow. Members of one component need not meet.
    """
    bands = reps.select(F.explode("bands").alias("key"), "rep")
    buckets = cut(bands.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1"))
    members = cut(bands.join(buckets, "key").select("key", "rep", "least", "n"))
    star = cut(members.where("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct())
    sketch = reps.select("rep", "sketch")
    near = star.join(sketch.withColumnsRenamed({"rep": "v", "sketch": "sv"}), "v").join(sketch.withColumnsRenamed({"rep": "u", "sketch": "su"}), "u")
    first = cut(verified(near.where(_alike("su", "sv") >= SURE).select("u", "v"), docs, width, percent))
    parts = components(first).withColumnsRenamed({"node": "rep", "component": "part"})
    open_rows = members.where("n > 2 and rep <> least").select("key", "rep", "n")
    parted = cut(open_rows.join(parts, "rep", "left").select("key", "rep", "n", F.coalesce("part", "rep").alias("part")))
    several = cut(parted.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key"))
    rest = cut(parted.join(several, "key"))
    near = cut(_candidates(rest.join(sketch, "rep")))
    sizes = near.groupBy("key").agg(F.count("*").alias("n"))
    rest = cut(rest.drop("n").join(near, ["key", "rep"]).join(sizes, "key"))
    ids = cut(rest.select(F.col("rep").alias("id")).distinct())
    texts = join_ids(docs.select("id", "text"), ids, ["id"], "left_semi")
    second = cut(_block_links(rest.join(sketch, "rep").join(texts.withColumnRenamed("id", "rep"), "rep"), width, percent))
    return first.unionAll(second)


def _classes(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """id, doc_id, n_shingles, component_id and kept of rows (id, doc_id, text), where id is unique and not null."""
    marks = cut(sketches(rows, width))
    reps = cut(marks.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least"), F.min_by("bands", "id").alias("bands"), F.min_by("sketch", "id").alias("sketch")))
    found = components(links(rows, reps.select("rep", "bands", "sketch"), width, percent)).withColumnRenamed("node", "rep")
    named = cut(reps.select("set_a", "set_b", "rep", "least").join(found, "rep", "left").select("set_a", "set_b", "least", F.coalesce("component", "rep").alias("class")))
    names = named.groupBy("class").agg(F.min("least").alias("component"))
    classes = cut(named.join(names, "class").select("set_a", "set_b", "component"))
    linked = marks.select("id", "doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return linked.select("id", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a unique number in column ``name``: the doc_id where it is one, else the row's, written first."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").count().where("count > 1 or id is null")
    return docs.withColumn(name, F.col("doc_id").cast("long")) if ids.isEmpty() else cut(docs.withColumn(name, F.monotonically_increasing_id()))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    Texts are compared by their sets of distinct ``width``-word shingles (A-Z lower-cased, words split at ASCII
    white space); equal sets are one representative, so copies are never paired. Null and empty texts have no
    shingles; rows without any, and rows without doc_id, link with nothing (a null doc_id has a null component_id and
    is kept). Rows that repeat a doc_id are documents of their own; the smallest doc_id of a class names it, and all
    its rows of that doc_id are kept. Other columns are ignored, whatever their names; an empty table gives an empty
    table.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _classes(_numbered(slim, "id"), width, percent).drop("id")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each near-duplicate class, all columns kept."""
    name = free(docs, "row")
    numbered = _numbered(docs, name)
    rows = numbered.select(F.col(name).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = cut(_classes(rows, width, percent).where("not kept").select(F.col("id").alias(name)))
    return join_ids(numbered, gone, [name], "left_anti").select(*docs.columns)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), width=2)


ORACLES = {
    "op8_minhash_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
                     ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        f AS (SELECT g, count(*) AS df FROM e GROUP BY g HAVING count(*) > 1),
        r AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS pos, count(*) OVER (PARTITION BY doc_id) AS shared FROM e JOIN f USING (g)),
        c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
              WHERE a.pos <= a.n - ceil(0.8 * a.n) + 1 AND b.pos <= b.n - ceil(0.8 * b.n) + 1 AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
        l AS (SELECT x, y FROM c JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y
              WHERE 100 * len(list_intersect(p.sh, q.sh)) >= 80 * (nx + ny - len(list_intersect(p.sh, q.sh)))),
        b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach(a, z) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, b.y FROM reach JOIN b ON reach.z = b.x)
        SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(z) AS component_id, s.doc_id = min(z) AS kept FROM s JOIN reach ON a = s.doc_id GROUP BY s.doc_id, len(sh)"""
}
QUERIES = {"op8_minhash_dedup": op8_minhash_dedup}
