import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, inside=50, top=2000):
    """rows: (lang, text)."""
    counts, total = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for d in range(1, longest + 1):
                own.update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in some.items():
            if any(100 * b >= inside * a for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def mined(df, **options):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in P.mine(df, **options).collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    return df.withColumns({"word": F.lit("x"), "h": F.lit(1), "w1": F.lit(2), "f": F.lit("f"), "rank": F.lit(0), "n": F.lit(9), "score": F.lit(1.0)})


HARD = [("en", None), (None, None), (None, "a b c " * 30), ("und", "a b c"), ("en", ""), ("en", " \t "), ("en", "..,,"), ("xx", "one"), ("en", "The CAT\tsat. the cat\nsat the cat; Sat é É " * 12)] * 2


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_brute_force(spark, longest):
    rng = np.random.default_rng(longest)
    vocabulary = ["of", "the", "new", "york", "city", "Über", "été", "x" * 90, "x" * 89 + "y", "日本"]
    texts = [" ".join(rng.choice(vocabulary, 40, p=[0.2, 0.3, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) for _ in range(60)]
    rows = [(["en", "fr", None][i % 3], t.replace("city", "city.") if i % 2 else t) for i, t in enumerate(texts)] + HARD
    rows.append(("en", "word " * 60_000 + "y" * 100_000))
    assert mined(frame(spark, rows), longest=longest) == brute(rows, longest)


def test_top_and_empty(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, HARD), top=1, least=2) == brute(HARD, least=2, top=1)


def test_quicksort_counts():
    rng = np.random.default_rng(3)
    for n, k in ((0, 3), (50, 3), (60_000, 4), (60_000, 30_000)):
        words = [np.minimum(rng.integers(0, k, n), rng.integers(0, k, n)).astype(np.uint64) for _ in range(3)]
        weight = rng.integers(1, 4, n)
        at, count = P.multikey_quicksort(words, weight, 5)
        want = Counter()
        for row, w in zip(zip(*(w.tolist() for w in words), strict=True), weight.tolist(), strict=True):
            want[row] += w
        assert {tuple(int(w[i]) for w in words): int(c) for i, c in zip(at, count, strict=True)} == {p: c for p, c in want.items() if c >= 5}


def test_large_products(spark):
    row = spark.createDataFrame([(9_000_000_000_000, 9_500_000_000_000, 9_999_999_999_999)], "a long, l long, r long")
    got = row.select(P.collocation_score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1_000_000 * 9_000_000_000_000**2 // (9_500_000_000_000 * 9_999_999_999_999)


def test_hashes_that_meet_are_drawn_anew(spark, monkeypatch):
    seen, real = [], P.vocabulary

    def poor(texts, seed):
        seen.append(seed)
        words = real(texts, seed)
        return words.withColumn("h", F.col("h") % 3) if len(seen) == 1 else words

    monkeypatch.setattr(P, "vocabulary", poor)
    rows = [("en", "a b c d e f")] * 12
    assert mined(frame(spark, rows)) == brute(rows) and len(seen) == 2
