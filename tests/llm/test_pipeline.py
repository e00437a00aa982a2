import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tickspark.llm.common import read

from .test_minhash import brute
from .test_mixing_sharding import fill, size


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def written(spark, df, name):
    path = f"{P.checkpoint_folder(spark)}/test-{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def words_near_targets(before, after):
    sizes, words, longest = Counter(), Counter(), Counter()
    for t, s in before:
        sizes[s] += size(t)
        longest[s] = max(longest[s], size(t))
    for t, s in after:
        words[s] += size(t)
    goal = fill(dict(sizes))
    return all(abs(words[s] - goal[s]) <= 1 + longest[s] / 2 for s in sizes)


def test_every_stage_takes_effect_and_no_more(spark, small):
    """Each stage against plain loops over its own input: what goes, what stays and how often."""
    docs = read(spark, small, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    clean = written(spark, stages["toxicity"](spark, docs, small), "toxicity")
    toxic = {r["doc_id"] for r in read(spark, small, "labels").where("toxic = 1").collect()}
    ids = {r["doc_id"] for r in docs.collect()}
    left = {r["doc_id"] for r in clean.collect()}
    assert len(ids & toxic) > 0 and len(left & toxic) <= 0.05 * len(ids & toxic)
    fine = {r["doc_id"] for r in read(spark, small, "labels").where("toxic = 0").collect()} & ids
    assert len(fine - left) <= 0.03 * len(fine)

    rows = clean.collect()
    keep = {}
    for r in rows:
        keep[lower(r["text"])] = max(keep.get(lower(r["text"]), -1), r["doc_id"])
    exact = written(spark, stages["exact_dedup"](spark, clean, small), "exact")
    assert {r["doc_id"] for r in exact.collect()} == set(keep.values()) and len(keep) < len(rows)

    rows = exact.collect()
    near = written(spark, stages["near_dedup"](spark, exact, small), "near")
    want = {i for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in rows], 5) if kept}
    assert {r["doc_id"] for r in near.collect()} == want and len(want) < len(rows)

    mixed = written(spark, stages["mixing"](spark, near, small), "mixing")
    before, after = ([(r["text"], r["source"]) for r in df.collect()] for df in (near, mixed))
    assert words_near_targets(before, after) and Counter(s for _, s in before) != Counter(s for _, s in after)
    assert all(df.columns == docs.columns for df in (clean, exact, near, mixed))

    got = stages["sentencepiece"](spark, mixed, small)
    assert got.count() == len(after) and got.where("not round_trip").isEmpty()
    assert P.run(spark, small).count() == len(after)


def test_hard_rows_through_every_stage(spark, small, make_docs, hard):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names: nothing clean is lost on the way."""
    rows = [*hard, (8, "other text of a repeated id"), (8, "word " * 50_000)]
    docs = make_docs(rows, extra=True).withColumns({"toxic_score": F.lit(1), "row": F.lit("r"), "id": F.lit("x"), "count": F.lit(3), "copies": F.lit(4)})
    texts = {lower(t) for _, t in rows}
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        docs = written(spark, out, f"hard-{k}")
        if name == "exact_dedup":
            assert sorted(lower(r["text"]) for r in docs.collect()) == sorted(texts)
        if name == "near_dedup":
            assert {lower(r["text"]) for r in docs.collect()} == texts and docs.count() == len(texts)
    got = P.STAGES[-1][1](spark, docs, small).collect()
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)


def test_empty_documents(spark, small):
    docs = read(spark, small, "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0


def test_the_run_reads_whole_tables():
    source = open(P.__file__).read()
    assert not re.search(r"\.limit\(|\.sample\(|localCheckpoint", source)


@pytest.mark.parametrize("epoch", [None, "pass"])
def test_epochs_of_a_document_can_be_told_apart(make_docs, epoch):
    from tickspark.llm.mixing import mixed_documents

    docs = make_docs([(i, "w " * 10, "a" if i < 5 else "b") for i in range(50)])
    got = mixed_documents(docs, epoch=epoch)
    assert got.columns == docs.columns + ([epoch] if epoch else [])
    if epoch:
        assert got.groupBy("doc_id", epoch).count().where("count > 1").isEmpty() and got.where("pass > 1").count() > 0
