import math
import random
import re

import pytest

from tickspark.llm import pii


def terms_of(make_docs, rows):
    got = {r["doc_id"]: r for r in pii.sanitise(make_docs(rows)).collect()}
    return {i: [rows_text[s["start"] : s["end"]] for s in got[i]["spans"] if s["kind"] == "term"] for i, rows_text in ((r[0], r[1] or "") for r in rows)}, got


def test_one_person_beside_one_address(make_docs):
    """A name that always stands in the documents of one address, near it or far away, is removed everywhere."""
    fill = lambda i: " ".join(f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}" for a in ("one", "two", "three", "four"))
    rows = [(i, f"plain words here {fill(i)} filler text") for i in range(80)]
    rows += [(100 + i, f"ask Quizzlewick at q.w@mail.org {fill(i)} plain words here") for i in range(6)]
    rows += [(200 + i, f"Farnsby said that {fill(i)} plain words here filler call +49 30 1234567") for i in range(6)]
    rows += [(300, "we met quizzlewick again"), (301, None), (302, "")]
    found, got = terms_of(make_docs, rows)
    assert found[300] == ["quizzlewick"] and all("Farnsby" in found[200 + i] for i in range(6))
    assert all("Quizzlewick" in found[100 + i] for i in range(6)) and all(found[i] == [] for i in range(80))
    assert "uizzlewick" not in got[103]["sanitised"] and "plain words here" in got[103]["sanitised"]


def test_copies_support_nothing(make_docs):
    rows = [(i, f"plain words number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    rows += [(100 + i, "ask Quizzlewick at q.w@mail.org plain words") for i in range(20)]
    assert all(t == [] for t in terms_of(make_docs, rows)[0].values())


def brute_terms(rows, disclosure=pii.DISCLOSURE, support=pii.SUPPORT, context=pii.CONTEXT):
    """Plain loops over whole texts: {term: information} of the terms that disclose a kind."""
    every, seen, both, values, kinds = len(rows), {}, {}, {}, {}
    for _, text in rows:
        spans = pii.base_spans(text or "")
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text or "")]
        words = [w for w in words if all(w[1] <= s or e <= w[0] for s, _, e in spans)]
        for t in {w[2] for w in words}:
            seen[t] = seen.get(t, 0) + 1
        for k in {k for _, k, _ in spans}:
            kinds[k] = kinds.get(k, 0) + 1
        pairs = set()
        for s, k, e in spans:
            beside = [w[2] for w in words if w[1] <= s][-context:] + [w[2] for w in words if w[0] >= e][:context]
            for t in beside:
                pairs.add((t, k))
                values.setdefault((t, k), set()).add(text[s:e].lower())
        for x in pairs:
            both[x] = both.get(x, 0) + 1
    out = {}
    for (t, k), n in both.items():
        p = kinds[k] / every
        if p < 1 and len(values[(t, k)]) >= support and math.log2(n / seen[t] / p) >= disclosure * -math.log2(p):
            out[t] = max(out.get(t, 0), math.log2(n / seen[t] / p))
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(8)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(3, 30))]
        for _ in range(rng.randrange(1, 4) if rng.random() < 0.15 else 0):
            at = rng.randrange(len(text) + 1)
            kind = rng.choice(["u{}@mail.org", "10.0.{}.7", "+49 30 12345{}", "x.{}@site.net"])
            hint = rng.choice(["write", "reach", words[0]])
            text[at:at] = [hint, kind.format(rng.randrange(90) + 10), rng.choice(words)]
        rows.append((i, " ".join(text)))
    return [*rows, (n, None), (n + 1, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_information_against_plain_loops(make_docs, seed):
    rows = corpus(seed)
    docs = make_docs(rows).select("doc_id", "text")
    entities = pii.entity_texts(docs)
    got = {r["term"]: r["information"] for r in pii.disclosing(docs, pii.kind_pairs(entities, len(rows), 0.5)).collect()}
    want = brute_terms(rows, 0.5)
    assert len(want) > 1 and got.keys() == want.keys()
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)
    wide = pii.disclosing(docs, pii.kind_pairs(entities, len(rows), 0.5), most=0).collect()
    assert {r["term"] for r in wide} == set(want), "more terms than are broadcast"


def test_many_entities_of_one_document_count_once(make_docs):
    """`call` stands in 100 documents, 10 of which list twelve addresses each: 2 bits of 5.3, no disclosure."""
    rows = [(i, f"plain filler text {'call' if i < 90 else 'more'} words") for i in range(390)]
    rows += [(400 + i, " and ".join(f"call u{i}x{k}@m.org" for k in range(12))) for i in range(10)]
    docs = make_docs(rows).select("doc_id", "text")
    found = {r["term"]: r["information"] for r in pii.disclosing(docs, pii.kind_pairs(pii.entity_texts(docs), len(rows), 0.1)).collect()}
    assert abs(found["call"] - 2.0) < 1e-9
    assert not {"u", "x", "m", "org"} & found.keys(), "pieces of other entities are no terms"
    assert "call" not in {r["term"] for r in pii.replacements(docs).collect()}


def test_long_terms_and_other_entities(make_docs):
    long = "z" * 300
    rows = [(i, f"plain words here {chr(97 + i % 26)}q filler text") for i in range(80)]
    rows += [(100 + i, f"plain {long} u{i}@m.org, v{i}@m.org words here") for i in range(12)]
    found, _ = terms_of(make_docs, rows)
    assert long in found[100] and found[0] == []


def test_generalisation_by_subsumption(make_docs):
    """A name beside addresses alone gives way to the word that always stands near it and elsewhere too."""
    fill = lambda i: " ".join(f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}" for a in ("one", "two", "six", "ten"))
    rows = [(i, f"plain {fill(i)} words") for i in range(400)]
    rows += [(500 + i, f"the surgeon works {fill(i)}") for i in range(30)]
    rows += [(600 + i, f"{fill(i + 40)} surgeon {fill(i)} Quizzlewick u{i}@m.org") for i in range(8)]
    found, got = terms_of(make_docs, rows)
    assert found[603] == ["Quizzlewick"] and found[503] == []
    assert "[surgeon] [email]" in got[603]["sanitised"] and got[503]["sanitised"] == f"the surgeon works {fill(3)}"


@pytest.mark.parametrize("seed", [4, 5])
def test_values_against_plain_loops(make_docs, seed):
    """Terms that disclose one address of their documents, copies of texts among them, against plain loops."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(4, 12))]
        if rng.random() < 0.25:
            who = rng.randrange(5)
            text += [f"name{'abcde'[who]}" if rng.random() < 0.9 else "nobody", *(words[who : who + 2]), f"p{who}@m.org"]
        rows += [(len(rows) + k, " ".join(text)) for k in range(rng.choice([1, 1, 1, 3]))]
    docs, every = make_docs(rows).select("doc_id", "text"), len(rows)
    got = {r["term"]: r["information"] for r in pii.disclosing(docs, pii.value_pairs(pii.entity_texts(docs), every, 0.4)).collect()}
    sets = []
    for _, text in rows:
        spans = pii.base_spans(text)
        sets.append((text, {t for _, _, t in pii.outside(text, spans)}, {text[s:e] for s, _, e in spans}))
    seen, n, both, texts, held = {}, {}, {}, {}, {}
    for text, terms, values in sets:
        for t in terms:
            seen[t] = seen.get(t, 0) + 1
        for v in values:
            n[v] = n.get(v, 0) + 1
            held.setdefault(v, set()).add(text)
            for t in terms:
                both[(t, v)] = both.get((t, v), 0) + 1
                texts.setdefault((t, v), set()).add(text)
    want = {}
    for (t, v), k in both.items():
        p, information = n[v] / every, math.log2(k / seen[t] / (n[v] / every))
        if len(texts[(t, v)]) >= 5 and len(held[v]) >= 5 and information >= 0.4 * -math.log2(p):
            want[t] = max(want.get(t, 0), information)
    assert len(want) >= 3 and got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
