"""Mixing sources to target weights with exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, free, join_ids, range_prefix, read

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3.0
#: Most sources whose targets are worked out on the driver; more of them are in Spark.
FEW_SOURCES = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> dict[str | None, float]:
    """Words each source is to give: shares by weight of all words, none above ``most`` times its source.

    Sources stand in order of their code points, null last, and take the weights in turn. Resharing the excess
    by weight until none is above its cap ends at one level: every source gets level * weight or its cap. The
    level follows from the sources sorted by cap / weight.
    """
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode("utf-32-be")) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, capped, open_weight = float(sum(sizes.values())), 0.0, sum(weight.values())
    level = 0.0
    for k in sorted(names, key=lambda k: most * sizes[k] / weight[k]):
        level = (total - capped) / open_weight
        if level <= most * sizes[k] / weight[k]:
            break
        capped += most * sizes[k]
        open_weight -= weight[k]
    return {k: min(most * sizes[k], level * weight[k]) for k in names}


def target_table(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS, few: int = FEW_SOURCES) -> DataFrame:
    """(_source, source_size, target) of the sources in ``totals`` (source, total); see ``targets``.

    Up to ``few`` sources pass through the driver. More of them, such as URLs, are ranked and summed by ``range_prefix``:
    by name for the weights, then by cap / weight for the level.
    """
    spark = totals.sparkSession
    totals = cut(totals)
    if totals.count() <= few:
        sizes = {r["source"]: r["total"] for r in totals.collect()}
        goal = targets(sizes, weights, most)
        schema = T.StructType([T.StructField("_source", totals.schema["source"].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
        return F.broadcast(spark.createDataFrame([(k, sizes[k], float(goal[k])) for k in sizes], schema))
    named = totals.select("source", "total", F.col("source").isNull().alias("last"), F.lit(1).cast("long").alias("one"))
    ranked, _ = range_prefix(named, None, ["last", "source"], "one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("source", "last", F.col("total"), weight.alias("weight"), (F.lit(most) * F.col("total")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    capped, _ = range_prefix(weighed, None, ["ratio", "last", "source"], "cap", "capped")
    both, _ = range_prefix(capped, None, ["ratio", "last", "source"], "weight", "closed")
    both = cut(both)
    every = both.agg(F.sum("total").cast("double").alias("total"), F.sum("weight").alias("weight")).first()
    level = (F.lit(every["total"]) - F.col("capped")) / (F.lit(every["weight"]) - F.col("closed"))
    fits = both.select("ratio", level.alias("level")).where("level <= ratio").agg(F.min(F.struct("ratio", "level"))["level"].alias("level")).first()["level"]
    return both.select(F.col("source").alias("_source"), F.col("total").alias("source_size"), F.least("cap", F.lit(fits) * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, seed: str, *more: str) -> DataFrame:
    """(doc_id, size, source, key, text_hash) of each row, and the columns ``more``."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "source", key.alias("key"), F.xxhash64("text").alias("text_hash"), *more
    )


def _taken(sized: DataFrame, weights: tuple[float, ...], most: float, few: int) -> DataFrame:
    """``sized`` with source_size, target, epochs and taken; ``sized`` is a cut table."""
    ranged, totals = range_prefix(sized, "source", ["key", "doc_id", "size", "text_hash"], "size", "before")
    size, epochs = F.col("size"), F.col("epochs")
    return (
        ranged.join(target_table(totals, weights, most, few), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.floor("target"), F.col("source_size")))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor("target").cast("long") - epochs * F.col("source_size"))
        .withColumn("taken", (epochs * size + F.greatest(F.lit(0), F.least(size, F.col("rest") - F.col("before")))).cast("long"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS, seed: str = "mix", few: int = FEW_SOURCES) -> DataFrame:
    """Per document row: doc_id, size, source, source_size, target, epochs, taken.

    Every document gets a hash-random key; the rows are range-sorted by source and key, distributed prefix sums
    of their words say how many words of the source stand before each, and the source is cut at exactly its
    target after as many whole epochs as fit: ``taken`` counts the words of all epochs, ``epochs`` the whole
    ones. The hash covers doc_id alone, so reruns agree; rows that repeat a doc_id are ordered by size, then by a
    hash of the text, and those equal in all of it are interchangeable. Null text or text without words has size 0
    and gives nothing; null doc_id and null source are values of their own. Other columns are ignored, whatever
    their names; an empty table gives an empty table. The driver holds one number for each of at most ``few`` sources.
    """
    return _taken(cut(_sized(docs, seed)), weights, most, few).select("doc_id", "size", "source", "source_size", "target", "epochs", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS, seed: str = "mix", few: int = FEW_SOURCES, epoch: str | None = None) -> DataFrame:
    """``docs`` as the mix takes them, repeated by epoch, with all of their columns; ``epoch`` names a column for its number.

    The document in which the budget ends is taken whole when at least half of it is inside. Documents without
    words give nothing to any budget and are left as they are. Rows are told apart by doc_id where it is unique and
    never null; otherwise the rows are written with a number of their own first, so that each gets its own share.
    """
    sized = cut(_sized(docs, seed))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).cast("int")
    row, count = free(docs, "row"), free(docs, "count")
    if sized.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        docs = docs.withColumn(row, F.col("doc_id").cast("long"))
        taken = _taken(sized, weights, most, few).withColumn("id", F.col("doc_id"))
    else:
        docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        numbered = docs.select(F.col(row).alias("id"), "doc_id", "text", "source")
        taken = _taken(cut(_sized(numbered, seed, "id")), weights, most, few)
    counted = cut(taken.select(F.col("id").alias(row), copies.alias(count)).where(F.col(count) > 0))
    met = join_ids(docs, counted, [row], "inner").withColumn(epoch or free(docs, "epoch"), F.explode(F.sequence(F.lit(1), F.col(count))))
    return met.select(*[c for c in docs.columns if c != row], *([epoch] if epoch else []))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES = {
    "op3_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
        o AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS i FROM w),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
        v AS (SELECT arg_min(level, i) AS level FROM l WHERE level <= ratio),
        t AS (SELECT w.source, source_size, least(3.0::DOUBLE * source_size, v.level * weight) AS target FROM w, v),
        p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p"""
}
QUERIES = {"op3_mixing": op3_mixing}
