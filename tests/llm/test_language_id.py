import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm import language_id as L
from tickspark.llm.common import read


@pytest.fixture(scope="module")
def model(spark, small):
    return L.fit(L.training_words(read(spark, small, "documents"), rows=400), steps=150)


def plain(model, word):
    """Log probabilities (positions x languages) of one word, state by state."""
    x = [L.EDGE, *L._LOWER[list(word)].tolist(), L.EDGE]
    hidden = model.state.shape[2]
    sig = lambda v: 1 / (1 + np.exp(-v))
    both = []
    for k in (0, 1):
        h, states = np.zeros(hidden), []
        for s in x if k == 0 else x[::-1]:
            i, u = model.table[k][:, s].astype(float), model.state[k].astype(float) @ h
            r, z = sig(i[:hidden] + u[:hidden]), sig(i[hidden : 2 * hidden] + u[hidden : 2 * hidden])
            n = np.tanh(i[2 * hidden :] + r * u[2 * hidden :])
            h = (1 - z) * n + z * h
            states.append(h)
        both.append(states if k == 0 else states[::-1])
    raw = np.array([model.out @ np.concatenate(s) + model.bias for s in zip(*both, strict=True)])[1:-1]
    return raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))


def words_of(text):
    data, out, run = (text or "").encode(), [], b""
    for c in data + b" ":
        if L._LETTER[c]:
            run += bytes([c])
        elif run:
            out += [run[i : i + L.LONGEST] for i in range(0, len(run), L.LONGEST)]
            run = b""
    return out


def brute(model, text):
    words = words_of(text)
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0, {}
    logp = np.concatenate([plain(model, w) for w in words])
    share = np.exp(logp.mean(axis=0) - logp.mean(axis=0).max())
    won = np.bincount(logp.argmax(axis=1), minlength=len(model.langs))
    return model.langs[share.argmax()], share.max() / share.sum(), {k: int(n) for k, n in zip(model.langs, won, strict=True) if n}


def test_gradients():
    rng = np.random.default_rng(0)
    first = L.new_model(["a", "b", "c"], hidden=5)
    model = L.Model(first.langs, *[p.astype(float) for p in first.parts()])
    x = L.sequences(np.frombuffer(b"hello ab worlds ", np.uint8), np.array([0, 6, 9]), np.array([5, 8, 15]))
    label = np.array([0, 2, 1])
    _, grads = L.gradients(model, x, label)
    for k, part in enumerate(model.parts()):
        for _ in range(6):
            at = [int(rng.integers(0, n)) for n in part.shape]
            if k == 0:
                at[2] = int(rng.choice(x[x < L.PAD]))
            at, was = tuple(at), part[tuple(at)]
            part[at] = was + 1e-3
            up = L.gradients(model, x, label)[0]
            part[at] = was - 1e-3
            down = L.gradients(model, x, label)[0]
            part[at] = was
            assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-5


def test_held_out_accuracy(spark, small):
    from tickspark.llm.registry import queries

    docs = {r["doc_id"]: r["lang"] for r in read(spark, small, "documents").collect()}
    got = queries()["op11_language_id"](spark, small).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_brute_force(spark, model, make_docs, hard):
    texts = [(k, t) for k, (_, t) in enumerate(hard) if t is None or len(t) < 1000]
    texts += [(50, "The cat and the dog"), (51, "le la être où"), (52, "1234 ... — 5"), (53, "　 日本語"), (54, "z" * 100 + " Über " + "9" * 70), (55, "——"), (56, "a")]
    got = {r["doc_id"]: r for r in L.identify(make_docs(texts, extra=True), model).collect()}
    assert len(got) == len(texts)
    for k, text in texts:
        lang, score, places = brute(model, text)
        assert got[k]["lang_pred"] == lang and abs(got[k]["lang_score"] - score) < 1e-4 and got[k]["lang_positions"] == places, text


def test_hard_rows(spark, model, make_docs, hard):
    df = make_docs(hard, extra=True).withColumn("lang_score", F.lit("old")).withColumn("found", F.lit(1))
    got = L.identify(df, model)
    rows = got.collect()
    assert len(rows) == len(hard) and got.columns.count("lang_score") == 1 and {"found", "key"} <= set(got.columns)
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[(1, None)]["lang_pred"] == by[(2, "")]["lang_pred"] == by[(3, " \t\n")]["lang_pred"] == "und"
    assert sum(by[(8, "word " * 50_000)]["lang_positions"].values()) == 200_000
    assert sum(by[(9, "x" * 200_000)]["lang_positions"].values()) == 200_000


def test_memory_does_not_change_labels(spark, model, make_docs, monkeypatch):
    texts = [(i, f"the word{chr(97 + i % 26)} et la maison{i}") for i in range(60)]
    want = L.identify(make_docs(texts), model).orderBy("doc_id").collect()
    monkeypatch.setattr(L, "REMEMBER", 20)
    assert L.identify(make_docs(texts), model).orderBy("doc_id").collect() == want


def test_nothing_to_learn(spark, make_docs):
    docs = make_docs([(1, "some text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    found = L.identify(docs, L.fit(L.training_words(docs))).collect()
    assert {(r["lang_pred"], r["lang_score"]) for r in found} == {("und", 0.0)}
    empty = make_docs([])
    assert L.training_words(empty) == [] and L.identify(empty, L.fit([])).count() == 0
    one = make_docs([(i, "some text") for i in range(9)])
    assert {r["lang_pred"] for r in L.identify(one, L.fit(L.training_words(one))).collect()} == {"en"}
