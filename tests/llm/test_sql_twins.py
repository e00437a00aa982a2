"""Registered queries against their SQL, or against plain loops over whole small tables where SQL cannot say it."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import pytest

from tickspark.llm import pii, registry, secrets
from tickspark.llm.common import read

from .test_pii_terms import brute_terms
from .test_text_ops import base_pii

TABLES = ("documents", "embeddings", "conversations", "labels")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(v[i]) if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = registry.queries()[name](spark, small)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def said(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def test_pii_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, small, "documents").collect()]
    terms = brute_terms(docs)
    got = {r["doc_id"]: r for r in registry.queries()["op1_pii"](spark, small).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        base = [(s, k, e, pii.KINDS[k]) for s, k, e in base_pii(text or "")]
        assert got[i]["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[3] == k for b in base) for k in pii.KINDS[:4]]
        words = pii.outside(text or "", pii.base_spans(text or ""))
        assert got[i]["n_term"] >= sum(t in terms for _, _, t in words)
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("term:")] == [x for x in said(base).split(",") if x]


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def test_secrets_query(spark, small):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    docs = [(r["doc_id"], r["text"] or "") for r in read(spark, small, "documents").collect()]
    got = {r["doc_id"]: r for r in registry.queries()["op7_secrets"](spark, small).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i]["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(b[3] == k for b in base) for k in ("assign", "access", "hex")]
        more = []
        for m in re.finditer(secrets.CANDIDATE, t):
            parts = [(m.start(), m[0])]
            if re.search(secrets.MARKED, m[0]):
                parts = [(m.start() + x.start(), x[0]) for x in re.finditer(secrets.UNMARKED, m[0])]
            for s, word in parts:
                e = s + len(word)
                if len(word) < secrets.WINDOW or not re.search("[0-9]", word) or not re.search("[A-Za-z]", word) or any(re.search(p, word) for p in secrets.ALLOW):
                    continue
                if any(b[0] < e and s < b[2] for b in base):
                    continue
                least = next(x for p, _, x in secrets.CLASSES if re.search(p, word))
                if max(entropy(word[k : k + secrets.WINDOW]) for k in range(len(word) - secrets.WINDOW + 1)) >= least - 1e-12:
                    more.append((s, 3, e, "entropy"))
        assert got[i]["spans"] == said(base + more)


def test_sharding_query(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, small, "documents").collect()}
    got = registry.queries()["op9_sharding"](spark, small).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())


def test_toxicity_query(spark, small):
    got = registry.queries()["op6_toxicity"](spark, small).collect()
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, small, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
