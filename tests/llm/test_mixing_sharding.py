import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickspark.llm import sharding as S
from tickspark.llm.common import range_prefix
from tickspark.llm.mixing import mix, mixed_documents, target_table, targets
from tickspark.llm.sharding import shard, write_shards


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [k for k in names if k not in fixed]
        left = total - sum(fixed.values())
        t = {k: left * w[k] / sum(w[o] for o in open_) for k in open_}
        over = [k for k in open_ if t[k] > most * sizes[k] + 1e-9]
        if not over:
            return fixed | t
        fixed |= {k: most * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1, "b": 1, "c": 1}, {"z": 100}, {"a": 0, "b": 7}, {"a": 5, "b": 4, "c": 300, "d": 2, None: 900}])
def test_targets_reshare(sizes):
    got, want = targets(sizes), fill(sizes)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes)


def test_mix_meets_targets(make_docs, hard):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(i, t, "hot") for i, t in hard]
    docs = make_docs(rows, extra=True)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = fill(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - goal[s]) < 1.001
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 for r in own)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    again = mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in again)


def test_mixed_documents(make_docs):
    docs = make_docs([(i, "w " * 10, "a" if i < 5 else "b") for i in range(50)], extra=True)
    left = mixed_documents(docs)
    assert left.columns == docs.columns
    words = sum(size(r["text"]) for r in left.collect())
    assert abs(words - 500) <= 10
    assert mix(make_docs([])).count() == 0 and mixed_documents(make_docs([])).count() == 0


def test_shards(make_docs, hard):
    rows = [(i, f"text {i} " + "y" * (i % 50)) for i in range(600)] + [(1000 + i, "the very same text") for i in range(300)] + hard
    got = shard(make_docs(rows, extra=True), 8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(8))
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert shard(make_docs([])).count() == 0


def test_shards_are_even_and_stable(make_docs):
    rows = [(i, "z" * (i % 97)) for i in range(3000)]
    docs = make_docs(rows)
    got = shard(docs).toPandas()
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(bytes_) == 8 and bytes_.max() - bytes_.min() <= 0.01 * bytes_.mean() + 2 * 97
    again = shard(docs.repartition(5)).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))


def test_write_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"t{i}") for i in range(100)])
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and set(docs.columns) <= set(back.columns)


def test_targets_of_many_sources(spark):
    sizes = {f"http://h{i % 37}/{i}": (i * 7919) % 500 for i in range(300)} | {None: 90, "é": 3}
    totals = spark.createDataFrame(list(sizes.items()), "source string, total long")
    want = fill(sizes)
    for few in (1000, 10):
        got = {r["_source"]: (r["source_size"], r["target"]) for r in target_table(totals, few=few).collect()}
        assert got.keys() == sizes.keys()
        assert all(got[k][0] == sizes[k] and abs(got[k][1] - want[k]) < 1e-6 * (1 + want[k]) for k in sizes)


def test_mix_of_many_sources_equals_the_short_way(make_docs):
    docs = make_docs([(i, "w " * (i % 23), f"u{i % 60}" if i % 60 else None) for i in range(500)])
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, mix(docs, few=5).collect())) == sorted(map(key, mix(docs).collect()))


def test_mixed_documents_of_repeated_ids_and_clashing_names(make_docs):
    """A third of the rows share one id; every row has its own share, and columns keep their names and values."""
    rows = [(7 if i % 3 == 0 else i, f"t{i} " + "w " * (i % 11), f"s{i % 3}") for i in range(240)] + [(None, "a b c", "s0"), (None, "a b c", "s0"), (9, None, "s1")]
    docs = make_docs(rows, extra=True).withColumns({"_mixed_id": F.lit(4), "_copies": F.lit(5), "row": F.lit("r"), "epoch": F.lit(0), "count": F.lit(1)})
    left = mixed_documents(docs)
    assert left.columns == docs.columns
    got = left.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goal, words = fill(dict(sizes)), Counter()
    for r in got:
        words[r["source"]] += size(r["text"])
        assert (r["_mixed_id"], r["_copies"], r["row"], r["epoch"], r["count"]) == (4, 5, "r", 0, 1)
    assert all(abs(words[s] - goal[s]) <= 12 for s in sizes)
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    rows_of = Counter(rows)
    assert all(n <= 3 * rows_of[k] for k, n in times.items())
    named = mixed_documents(docs, epoch="pass").groupBy("doc_id", "text", "source", "pass").count().collect()
    assert all(r["count"] <= rows_of[(r["doc_id"], r["text"], r["source"])] for r in named)


def test_range_prefix_against_a_loop(spark):
    rows = [(f"g{i % 5 if i % 4 else 0}" if i % 13 else None, (i * 31) % 97, i, i % 7) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, k long, i long, v long")
    got, totals = range_prefix(df, "g", ["k", "i"], "v", "before", n=9)
    want, run = {}, {}
    for g, _, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = run.get(g, 0)
        run[g] = want[i] + v
    assert {r["i"]: r["before"] for r in got.collect()} == want
    assert {r["g"]: r["total"] for r in totals.collect()} == run


@pytest.mark.parametrize("pieces", [1, 5])
def test_splitters_against_a_sort(spark, make_docs, pieces):
    """Every splitter is as near to its goal as the tolerance, or as near as any key can be."""
    rows = [(i, f"t{i} " + "y" * (i % 61)) for i in range(900)] + [(2000 + i, "hot text " * 5) for i in range(500)] + [(5000, "z" * 9000)]
    docs = make_docs(rows)
    text = F.coalesce("text", F.lit(""))
    sized = docs.select((F.octet_length(text) + 1).cast("long").alias("size"), S.shard_key(text, F.col("doc_id")).alias("key")).cache()
    table = sorted((r["key"], r["size"]) for r in sized.collect())
    cuts = S.splitters(sized, 8, 0.01, pieces)
    total = sum(s for _, s in table)
    keys = sorted({k for k, _ in table} | {S.TOP})
    assert len(cuts) == 8 * pieces - 1 and cuts == sorted(cuts)
    below = lambda c: sum(s for k, s in table if k < c)
    for i, c in enumerate(cuts, 1):
        goal = total * i / (8 * pieces)
        slack = 0.01 * total / 8 if i % pieces == 0 else total / (8 * pieces) / 4
        best = min(abs(below(k) - goal) for k in keys)
        assert abs(below(c) - goal) <= max(slack, best) + 1e-9


def test_slots_against_a_sort(make_docs, hard):
    rows = [(i % 500, f"text {i % 77} " + "y" * (i % 50)) for i in range(800)] + hard
    docs = make_docs(rows, extra=True)
    for task_rows in (10**6, 30):
        got = shard(docs, 8, task_rows=task_rows)
        text = F.coalesce("text", F.lit(""))
        keyed = docs.select(S.shard_key(text, F.col("doc_id")).alias("k"), "doc_id", (F.octet_length(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc")).collect()
        order = sorted(((r["k"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["crc"]) for r in keyed))
        back = sorted(((r["shard"], r["slot"]), r["doc_id"], r["size"], r["text_crc32"]) for r in got.collect())
        assert [(i, n, c) for _, i, n, c in back] == [(i if some else None, n, c) for _, some, i, n, c in order], "shards and slots follow the keys"


def test_write_shards_with_clashing_names(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"t{i}") for i in range(60)], extra=True).withColumns({"piece": F.lit(1), "shard_": F.lit(2)})
    write_shards(docs, str(tmp_path / "out"), 4, task_bytes=40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and set(back.columns) == {*docs.columns, "shard__"} and back.select("shard__").distinct().count() == 4


def test_many_pieces(spark):
    """20,000 pieces: every boundary within a quarter of a piece of what a sort says, shards' within the tolerance."""
    import numpy as np

    pieces, n = 2_500, 4_000_000
    sized = spark.range(n).select(F.shiftrightunsigned(F.xxhash64("id"), 2).alias("key"), (F.col("id") % 7 + 1).alias("size"))
    cuts = np.array(S.splitters(sized, 8, 0.002, pieces))
    table = sized.toArrow().to_pandas().sort_values("key")
    below = np.concatenate(([0], np.cumsum(table["size"].to_numpy())))[np.searchsorted(table["key"].to_numpy(), cuts)]
    total, parts = int(table["size"].sum()), 8 * pieces
    off = np.abs(below - total * np.arange(1, parts) / parts)
    assert len(cuts) == parts - 1 and (np.diff(cuts) >= 0).all()
    assert (off <= total / parts / 4 + 7).all()
    assert (off[pieces - 1 :: pieces] <= 0.002 * total / 8).all()
