import hashlib
import random

import pytest

from tickspark.llm.exact_dedup import CuckooIndex, drop_copies, exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            own = i == keep and not kept
            kept |= own
            out.append((i, keep, len(ids), own, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(make_docs, hard, extra):
    got = exact_dedup(make_docs(hard, extra))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(hard)


def test_empty_table(make_docs):
    assert exact_dedup(make_docs([])).count() == 0
    assert drop_copies(make_docs([])).count() == 0


def test_hot_group(make_docs):
    rows = [(i, "Same" if i % 3 == 0 else f"t{i}") for i in range(600)]
    assert sorted(map(tuple, exact_dedup(make_docs(rows)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, "a"), (2, "A"), (3, "b")], [(1, "a"), (1, "a"), (None, "A"), (2, None), (3, "")]])
def test_drop_copies_keeps_one_of_each_text(make_docs, rows):
    docs = make_docs(rows, extra=True)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(lower(r["text"]) for r in left.collect()) == sorted({lower(t) for _, t in rows})


def test_cuckoo_index_insert_delete_resize():
    index, rng, live = CuckooIndex(16), random.Random(1), {}
    for k in range(5000):
        d = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if d in live and rng.random() < 0.5:
            assert index.delete(d)
            del live[d]
        elif d in live:
            index.update(d, (k, 1, 2))
            live[d] = (k, 1, 2)
        else:
            index.insert(d, (k, 0, 1))
            live[d] = (k, 0, 1)
        assert len(index) == len(live)
    assert index.resizes > 0
    assert all(index.find(d) == v for d, v in live.items()) and dict(index.items()) == live
    gone = [hashlib.sha256(f"no{i}".encode()).digest() for i in range(500)]
    assert all(index.find(d) is None for d in gone)
    assert not index.delete(gone[0])


def test_the_filter_decides_and_its_hits_are_verified():
    one, two = b"\x07\x07" + bytes(30), b"\x07\x07" + bytes(29) + b"\x01"
    index = CuckooIndex(16)
    index.insert(one, (1, 0, 1))
    assert index._places(one) == index._places(two) and index.find(two) is None, "same mark, same buckets, other content"
    index.insert(two, (2, 0, 1))
    assert index.find(one) == (1, 0, 1) and index.find(two) == (2, 0, 1)
    assert index.delete(one) and index.find(one) is None and index.find(two) == (2, 0, 1)
    for k in range(len(index.marks)):
        index.marks[k] = 0
    assert index.find(two) is None, "without its mark a record is not found"


def test_overflow_of_two_buckets_grows_from_the_stored_keys():
    index = CuckooIndex(16)
    same = [b"\x07\x07" + bytes(5) + bytes([k]) + bytes(24) for k in range(0, 160, 16)]
    for k, d in enumerate(same):
        index.insert(d, (k, 0, 1))
    assert index.resizes > 0 and [index.find(d)[0] for d in same] == list(range(10))


def test_number_of_indexes_follows_the_rows(make_docs, monkeypatch):
    from tickspark.llm import exact_dedup as M

    monkeypatch.setattr(M, "PER_INDEX", 50)
    live = M.live_digests(M.digests(make_docs([(i, f"t{i % 400}") for i in range(800)])))
    assert live.rdd.getNumPartitions() >= 8 and live.count() == 400
