"""Information-theoretic sanitisation of personal data."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, small_batches

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity that count as its context, and of a term in the search for its generalisation.
CONTEXT, NEAR = 3, 8
#: A term discloses entities when its information about them reaches this share of their own ...
DISCLOSURE = 0.85
#: ... and so many different entities of the kind (or texts of one entity) stand behind it.
SUPPORT = 5
#: A general term stands near so large a share of a term's documents, and in no more than that share of all.
SUBSUMES, GENERAL = 0.8, 0.1
#: Most terms that are broadcast; more of them meet the documents in joins.
BROADCAST_TERMS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Counts that a task holds before it lets go of them.
_FLUSH = 200_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Works outwards from each @, so a long run of letters without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, kind an index into KINDS; sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words of ``text`` that no span touches, in order."""
    out = []
    held, i, reach = sorted((s, e) for s, _, e in spans), 0, 0
    for m in _WORD.finditer(text):
        while i < len(held) and held[i][0] < m.end():
            reach = max(reach, held[i][1])
            i += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def terms_of(text: str) -> set[str]:
    """The distinct terms of a text outside its entities."""
    spans = base_spans(text)
    return {t for _, _, t in outside(text, spans)} if spans else set(map(str.lower, _WORD.findall(text)))


def _value(text: str, start: int, end: int) -> int:
    return int.from_bytes(hashlib.blake2b(text[start:end].lower().encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


ENTITY = pa.struct([("kind", pa.int32()), ("value", pa.int64())])
BESIDE = pa.struct([("kind", pa.int32()), ("value", pa.int64()), ("term", pa.string())])


def entity_texts(docs: DataFrame) -> DataFrame:
    """(key, entities, beside, terms) of each document row with an entity.

    ``entities`` are its distinct (kind, value); ``beside`` its distinct (kind, value, term) where the term is one of the
    CONTEXT words on either side of the entity, other entities passed over; ``terms`` all its distinct terms.
    """

    def row(text: str, spans: list[tuple[int, int, int]]) -> tuple:
        words = outside(text, spans)
        starts = [s for s, _, _ in words]
        entities, beside = set(), set()
        for s, kind, e in spans:
            value = _value(text, s, e)
            entities.add((kind, value))
            at = bisect_left(starts, s)
            after = bisect_left(starts, e)
            beside.update((kind, value, t) for _, _, t in (*words[max(0, at - CONTEXT) : at], *words[after : after + CONTEXT]))
        return _key(text), sorted(entities), sorted(beside), sorted({t for _, _, t in words})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, base_spans(t)) for t in batch.column(0).to_pylist() if t]
            rows = [row(t, spans) for t, spans in found if spans]
            for at in range(0, len(rows), 200):
                keys, entities, beside, terms = zip(*rows[at : at + 200], strict=True)
                named = lambda names, sets: [[dict(zip(names, x, strict=True)) for x in s] for s in sets]
                yield pa.record_batch(
                    [pa.array(keys, pa.binary()), pa.array(named(("kind", "value"), entities), pa.list_(ENTITY)), pa.array(named(("kind", "value", "term"), beside), pa.list_(BESIDE)), pa.array(terms, pa.list_(pa.string()))],
                    names=["key", "entities", "beside", "terms"],
                )

    schema = "key binary, entities array<struct<kind:int,value:long>>, beside array<struct<kind:int,value:long,term:string>>, terms array<string>"
    return docs.select("text").mapInArrow(run, schema)


def _shared(names: DataFrame, most: int):
    """The terms of a cut table as a broadcast set, or None when there are more than ``most``."""
    if names.count() > most:
        return None
    return names.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in names.collect()))


def seen_in(docs: DataFrame, names: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """(term, seen): documents that hold each term of ``names`` outside their entities."""
    shared = _shared(names, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        emit = lambda: pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_held(text, shared and shared.value))
                if len(counts) >= _FLUSH:
                    yield emit()
                    counts.clear()
        yield emit()

    counted = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("seen"))
    return counted if shared else counted.join(names, "term", "left_semi")


def _held(text: str | None, wanted: frozenset[str] | None) -> set[str]:
    """Terms of ``text`` among the wanted ones (None: all of them), its entities masked."""
    if not text:
        return set()
    found = set(map(str.lower, _WORD.findall(text)))
    if wanted is not None:
        found &= wanted
    if found and ("@" in text or _DIGIT.search(text)) and base_spans(text):
        found &= terms_of(text)
    return found


def kind_pairs(entities: DataFrame, every: int, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, both, p, least): documents with an entity of a kind beside the term, p(kind) and the kind's threshold.

    At least ``support`` different entities of the kind stand beside the term. A document counts once for a term and
    kind, however many entities it lists.
    """
    kinds = entities.select(F.explode(F.array_distinct(F.transform("entities", lambda x: x["kind"]))).alias("kind")).groupBy("kind").count().where(F.col("count") < every)
    table = F.broadcast(kinds.select("kind", (F.col("count") / every).alias("p")))  # one row per kind
    told = entities.select(F.explode("beside").alias("x")).select("x.*").distinct().groupBy("term", "kind").agg(F.count("*").alias("values")).where(F.col("values") >= support)
    pairs = F.array_distinct(F.transform("beside", lambda x: F.struct(x["kind"].alias("kind"), x["term"].alias("term"))))
    both = entities.select(F.explode(pairs).alias("x")).select("x.*").groupBy("term", "kind").agg(F.count("*").alias("both"))
    return both.join(told.select("term", "kind"), ["term", "kind"]).join(table, "kind").select("term", "both", "p", (-F.log2("p") * disclosure).alias("least"))


def value_pairs(entities: DataFrame, every: int, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, both, p, least): documents with a term and one entity value anywhere in them, p(value) and its threshold.

    Counts are over documents, but only pairs of ``support`` different texts are looked at, so exact copies alone
    say nothing.
    """
    texts = entities.groupBy("key").agg(F.count("*").alias("m"), F.first("entities").alias("entities"))
    values = cut(texts.select("key", "m", F.explode("entities").alias("x")).select("key", "m", "x.*"))
    often = cut(values.groupBy("kind", "value").agg(F.sum("m").alias("n"), F.count("*").alias("texts")).where(F.col("texts") >= support).select("kind", "value", "n"))
    top = often.agg(F.max("n")).first()[0]
    if top is None:
        return entities.sparkSession.createDataFrame([], "term string, both long, p double, least double")
    of_text = cut(values.join(often, ["kind", "value"]))
    keys = cut(of_text.select("key", "m").distinct())
    words = cut(entities.join(keys, "key").select("key", "m", F.explode("terms").alias("term")).distinct())
    # A term in d of these documents is in d of all at least, and log2(n / d / p) falls as d grows: exact bounds on d.
    widest = top / (top / every) ** (1 - disclosure)
    some = words.groupBy("term").agg(F.sum("m").alias("d"), F.count("*").alias("texts")).where((F.col("texts") >= support) & (F.col("d") <= widest))
    pairs = words.join(some.select("term", "d"), "term").join(of_text.drop("m"), "key").groupBy("term", "kind", "value", "n", "d").agg(F.sum("m").alias("both"), F.count("*").alias("texts"))
    near = pairs.where(F.col("texts") >= support).withColumn("p", F.col("n") / every).where("p < 1").withColumn("least", -F.log2("p") * disclosure)
    return near.where(F.log2(F.col("both") / F.col("d") / F.col("p")) >= F.col("least")).select("term", "both", "p", "least")


def disclosing(docs: DataFrame, pairs: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """(term, information) of the terms in ``pairs`` that reach their threshold.

    information = log2(p(entity | term) / p(entity)) = log2(both / seen / p), over documents; the threshold is the share
    DISCLOSURE of the entity's own information, -log2 p. The documents with each term in question are counted here.
    """
    pairs = cut(pairs)
    names = cut(pairs.select("term").distinct())
    if names.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, information double")
    met = pairs.join(seen_in(docs, names, most), "term").withColumn("information", F.log2(F.col("both") / F.col("seen") / F.col("p")))
    return met.where("information >= least").groupBy("term").agg(F.max("information").alias("information"))


def generalisations(docs: DataFrame, terms: DataFrame, every: int, subsumes: float = SUBSUMES, most: int = BROADCAST_TERMS) -> DataFrame:
    """(term, general): for each disclosing term the most specific term that subsumes it, where there is one.

    ``g`` subsumes ``t`` when it stands within NEAR words of ``t`` in at least ``subsumes`` of the documents with
    ``t``, but ``t`` in a smaller share of the documents with ``g``. The general term does not disclose itself, has
    three letters or more and is in at most GENERAL of all documents; the rarest one is the most specific.
    """
    shared = _shared(terms.select("term"), most)

    def near(text: str, wanted: frozenset[str] | None) -> set[tuple[str, str]]:
        words = [t for _, _, t in outside(text, base_spans(text))]
        own = set(words) if wanted is None else wanted
        return {(t, g) for i, t in enumerate(words) if t in own for g in (t, *words[max(0, i - NEAR) : i], *words[i + 1 : i + 1 + NEAR]) if g == t or len(g) > 2}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        emit = lambda: pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "general", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if _held(text, shared and shared.value):
                    counts.update(near(text, shared and shared.value))
                if len(counts) >= _FLUSH:
                    yield emit()
                    counts.clear()
        yield emit()

    counted = docs.select("text").mapInArrow(run, "term string, general string, n long").groupBy("term", "general").agg(F.sum("n").alias("n"))
    if shared is None:
        counted = counted.join(terms.select("term"), "term", "left_semi")
    counted = cut(counted)
    own = counted.where("term = general").select("term", F.col("n").alias("seen"))
    wide = counted.where("term <> general").join(own, "term").where(F.col("n") >= F.lit(subsumes) * F.col("seen"))
    wide = cut(wide.join(terms.select(F.col("term").alias("general")), "general", "left_anti"))
    names = cut(wide.select(F.col("general").alias("term")).distinct())
    if names.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, general string")
    rare = seen_in(docs, names, most).select(F.col("term").alias("general"), F.col("seen").alias("of_general"))
    met = wide.join(rare, "general").where((F.col("of_general") > F.col("seen")) & (F.col("of_general") <= GENERAL * every))
    return met.groupBy("term").agg(F.min(F.struct("of_general", "general"))["general"].alias("general"))


def replacements(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, most: int = BROADCAST_TERMS) -> DataFrame:
    """(term, information, action, replacement) of every disclosing term: generalised where a term subsumes it, else removed."""
    every = docs.count()
    entities = cut(entity_texts(docs))
    pairs = kind_pairs(entities, every, disclosure, support).unionByName(value_pairs(entities, every, disclosure, support))
    terms = cut(disclosing(docs, pairs, most))
    if terms.isEmpty():
        return terms.select("term", "information", F.lit("").alias("action"), F.lit("").alias("replacement"))
    general = generalisations(docs, terms, every, most=most)
    known = F.col("general").isNotNull()
    return terms.join(general, "term", "left").select("term", "information", F.when(known, "generalise").otherwise("remove").alias("action"), F.when(known, F.concat(F.lit("["), "general", F.lit("]"))).otherwise("[removed]").alias("replacement"))


SPANS = "array<struct<start:int,end:int,kind:string,replacement:string>>"


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, most: int = BROADCAST_TERMS) -> DataFrame:
    """Per document row: doc_id, spans, sanitised.

    ``spans`` holds the entities found by pattern (replaced by ``[email]`` and so on) and, outside of them, the
    occurrences of terms that disclose a kind of entity (``kind_pairs``) or one value (``value_pairs``), by start
    and then kind; start and end are code points, end exclusive. A term gives way to a more general one of the corpus
    (``generalisations``) or is removed. Null text counts as empty; rows that repeat are counted as often as they
    stand there; other columns are ignored, whatever their names; an empty table gives an empty table. Up to ``most``
    terms are broadcast; more of them meet the terms of each document in a shuffle join instead.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = cut(replacements(docs, disclosure, support, most).select("term", "replacement"))
    if terms.count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["replacement"] for r in terms.collect()})
        return _apply(docs.withColumn("own", F.lit(None).cast("map<string,string>")), shared)
    keyed = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    pairs = keyed.dropDuplicates(["key"]).select("key", "text").mapInArrow(_all_terms, "key string, term string")
    own = pairs.join(terms, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "replacement"))).alias("own"))
    return _apply(keyed.join(own, "key", "left").select("doc_id", "text", "own"), None)


def _all_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = sorted(_held(text, None))
            if found:
                yield pa.record_batch([pa.array([key] * len(found)), pa.array(found, pa.string())], names=["key", "term"])


def _apply(docs: DataFrame, shared) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("replacement", pa.string())]))

    def spans_of(text: str, replace: dict[str, str]) -> list[tuple[int, int, int, str]]:
        base = base_spans(text)
        out = [(s, k, e, f"[{KINDS[k]}]") for s, k, e in base]
        if replace and not replace.keys().isdisjoint(map(str.lower, _WORD.findall(text))):
            out += [(s, 4, e, replace[t]) for s, e, t in outside(text, base) if t in replace]
        return sorted(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found, clean = [], []
                for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = text or ""
                    spans = spans_of(text, shared.value if shared is not None else dict(own or ()))
                    pieces, done = [], 0
                    for s, _, e, new in spans:
                        if s >= done:
                            pieces += [text[done:s], new]
                        done = max(done, e)
                    found.append([{"start": s, "end": e, "kind": KINDS[k], "replacement": new} for s, k, e, new in spans])
                    clean.append("".join([*pieces, text[done:]]))
                yield pa.record_batch([part.column(0), pa.array(found, kind), pa.array(clean, pa.string())], names=["doc_id", "spans", "sanitised"])

    return docs.mapInArrow(run, f"doc_id long, spans {SPANS}, sanitised string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(read(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = said(F.filter("spans", lambda x: x["kind"] != "term"))
    return found.select("doc_id", *map(number, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"))


ORACLES: dict[str, str] = {}
QUERIES = {"op1_pii": op1_pii}
