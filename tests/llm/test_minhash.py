import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm.minhash_dedup import COORDS, drop_near_copies, fast_sketch, near_dedup


def shingles(text, width):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width):
    s = {i: shingles(t, width) for i, t in rows}
    top = {i: i for i in s}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s[i]), find(i), find(i) == i) for i in ids)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))] for _ in range(25)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8, 12])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if i % 4 == 0:
            words += shared
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(make_docs, width):
    rows = corpus(width)
    got = near_dedup(make_docs(rows, extra=True), width)
    assert sorted(map(tuple, got.collect())) == brute(rows, width)


def test_large_group_of_near_copies_and_chain(make_docs):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(700):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(20):
        rows.append((1000 + i, " ".join(chain[2 * i :] + [f"d{k}" for k in range(2 * i)])))
    got = sorted(map(tuple, near_dedup(make_docs(rows), 2).collect()))
    assert got == brute(rows, 2)


def test_hard_rows(make_docs, hard):
    rows = [(i, t) for i, t in hard if i is not None]
    got = near_dedup(make_docs(hard), 2).collect()
    assert len(got) == len(hard)
    want = {(i, n, c, k) for i, n, c, k in brute(dict(rows).items(), 2)}
    assert {tuple(r) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_empty_table_and_stage(make_docs):
    assert near_dedup(make_docs([])).count() == 0
    docs = make_docs([(1, "a b c d e f g h i j k l"), (2, "A b c d e f g h i j k l"), (3, "z"), (4, None)], extra=True)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 700):
        items = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        out = fast_sketch(items, np.zeros(n, np.int64), 1)
        assert (out != np.iinfo(np.uint64).max).all()
    both = rng.integers(0, 1 << 63, 1800, dtype=np.uint64)
    a, b = both[:1000], both[200:1200]
    s = fast_sketch(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2)
    assert abs((s[0] == s[1]).sum() / COORDS - 800 / 1200) < 0.15


def test_repeated_and_null_ids_are_rows_of_their_own(make_docs):
    near = [f"w{i}" for i in range(40)]
    text = lambda k: " ".join([*near[:-1], f"x{k}"])
    rows = [(5, text(0)), (5, "an unrelated text with enough words in it"), (3, text(1)), (None, text(2)), (9, text(3)), (9, text(3)), (4, "")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(make_docs(rows)).collect())
    n = 40 - 4
    assert got == sorted([(5, n, 3, False), (5, 4, 5, True), (3, n, 3, True), (-1, n, None, True), (9, n, 3, False), (9, n, 3, False), (4, 0, 4, True)], key=lambda r: (r[0], r[1]))
    docs = make_docs(rows, extra=True).withColumns({"row": F.lit("r"), "id": F.lit("i")})
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left.collect()) == sorted([(5, rows[1][1]), (3, text(1)), (-1, text(2)), (4, "")])


def test_long_words_do_not_collide():
    """The word and its opposite have equal sums of bytes times powers modulo 2^64, whatever the base."""
    from tickspark.llm.shingles import words

    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    raw = [np.frombuffer(t.encode(), np.uint8) for t in (one, two, one.upper())]
    a, b, c = (words(x, np.array([0, len(x)]))[1][0] for x in raw)
    assert a != b and a == c


def test_blocks_of_one_bucket(make_docs, monkeypatch):
    """Small blocks: the rows of a bucket meet in pairs of blocks and no link is lost."""
    from tickspark.llm import minhash_dedup as M

    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "SKETCHES", 11)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    assert sorted(map(tuple, near_dedup(make_docs(rows), 2).collect())) == brute(rows, 2)
