"""Phrase collocations: suffix pointers sorted by multikey three-way quicksort, whose equal partitions are the counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, n_partitions, range_prefix, read, small_batches
from .shingles import LONG_WORD, chunks, mix

#: Longest phrase, fewest occurrences of a candidate, percentage of a candidate's occurrences inside a longer one that
#: drops it, and the phrases that a language reports.
LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Bytes of text whose words are hashed at a time, suffix pointers that a task sorts at a time, and those that a bucket
#: of the exchange is meant to gather.
TEXT, POINTERS, BUCKET = 1 << 21, 1 << 19, 1 << 20
#: Partitions of at most so many pointers are sorted at once.
SMALL = 1 << 13
#: Bits of the map of frequent phrases that every task gets; other phrases may share their bits, which costs work only.
BITS = 26
_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)], _KIND[list(_BREAK)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROUTE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size, base = max(n, 2 * TEXT), int(_ROUTE)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def _values(seed: int) -> np.ndarray:
    """An odd 64-bit value per byte; A-Z as a-z."""
    v = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return v[_LOWER]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A sum of the bytes' values times powers of an odd base for each of the ordered spans, A-Z as a-z.

    Differences of one running sum over a stretch of text give all of its spans at once.
    """
    values, hashes = _values(seed), np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + TEXT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return hashes


def tokens(data: np.ndarray, offsets: np.ndarray, seeds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, start, end, run, hashes by seed) of each word of the texts data[offsets[i]:offsets[i+1]], in order.

    Words of one piece of one text have one run, a number that never falls. Words beyond LONG_WORD are hashed by digest.
    """
    n = len(data)
    kind = _KIND[data]
    word = kind == 0
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[1:], last[:-1] = ~word[:-1], ~word[1:]
    first[0] = last[-1] = True
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = True
    last[edges - 1] = True
    starts, ends = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    run = np.cumsum(kind == 2, dtype=np.int64)[starts] + owner
    out = []
    for seed in seeds:
        hashes = span_hashes(data, starts, ends, seed)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            own = _LOWER[data[starts[k] : ends[k]]].tobytes()
            hashes[k] = int.from_bytes(hashlib.blake2b(own, digest_size=8, key=b"%d" % seed).digest(), "big")
        out.append(mix(hashes))
    return owner, starts, ends, run, out


def _langs(langs: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, the number of each row's among them, and a 64-bit value of each."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    values = [int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for s in names]
    return names, coded.indices.to_numpy(), np.array(values, np.uint64)


def _read_words(batch: pa.RecordBatch, seeds: tuple[int, ...]):
    """Per run of texts: data, start and end of each word, its run, its language's number, its hashes within the language."""
    names, code, values = _langs(batch.column(0))
    for i, j, data, offsets in chunks(batch.column(1), TEXT):
        if len(data) == 0:
            continue
        owner, starts, ends, run, hashes = tokens(data, offsets, seeds)
        if len(starts):
            lang = code[i:j][owner]
            yield names, data, starts, ends, run, lang, [mix(h ^ values[lang]) for h in hashes]


def vocabulary(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, clash, f) of each word of ``texts`` (lang, text); h is the hash of language and word, ``clash``
    is above 0 where two words of one task share it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, starts, ends, _, lang, (h, twin) in _read_words(batch, (seed, seed + 1)):
                order = np.argsort(h, kind="stable")
                h, twin = h[order], twin[order]
                at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                clash = (np.minimum.reduceat(twin, at) != np.maximum.reduceat(twin, at)).astype(np.int64)
                count, one = np.diff(np.append(at, len(h))), order[at]
                back = np.argsort(one)  # in the order of the text, so that words and what lies between them alternate
                one, kept = one[back], at[back]
                bounds = np.empty(2 * len(one), np.int32)
                bounds[0::2], bounds[1::2] = starts[one], ends[one]
                body = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data])])
                words = body.take(pa.array(np.arange(0, len(bounds) - 1, 2))).cast(pa.string())
                langs = pa.DictionaryArray.from_arrays(pa.array(lang[one].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                yield pa.record_batch([langs, words, pa.array(h[kept].view(np.int64)), pa.array(clash[back]), pa.array(count[back])], names=["lang", "word", "h", "clash", "f"])

    found = small_batches(texts).mapInArrow(run, "lang string, word string, h long, clash long, f long")
    return cut(found.groupBy("lang", "word", "h").agg(F.sum("clash").alias("clash"), F.sum("f").alias("f")))


def frequent_bits(marks: DataFrame) -> bytes:
    """A map of 2^BITS bits with the bit of each ``mark`` (0 to 2^BITS - 1) set: of fixed size, however many marks there are."""
    place = F.col("mark") + 1
    pages = marks.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out, size = bytearray(1 << (BITS - 3)), 4096
    for r in pages.toLocalIterator():
        out[(r["page"] - 1) * size : r["page"] * size] = r["bits"]
    return bytes(out)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """One word's hash as it is, more words mixed in turn."""
    out = words[0]
    for w in words[1:]:
        out = mix(out * _ROUTE + w)
    return out


def _marks(words: list[np.ndarray]) -> np.ndarray:
    return phrase_hash(words) >> np.uint64(64 - BITS)


def multikey_quicksort(words: list[np.ndarray], weight: np.ndarray | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(a pointer to each distinct phrase, its count) of the suffixes whose k-th words are ``words[k]``.

    Pointers are parted in three by a pivot's word at their depth: less and greater parts are parted again, the equal
    part goes one word deeper, and its size (or weight) is the count of the words so far. An equal part below ``least``
    is abandoned, whatever follows. Parts of at most SMALL pointers are sorted at once, word by word.
    """
    depth_max, found, counts = len(words), [], []
    size = (lambda part: len(part)) if weight is None else (lambda part: int(weight[part].sum()))
    stack = [(np.arange(len(words[0])), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 0 or size(part) < least:
            continue
        if depth == depth_max:
            found.append(part[:1])
            counts.append(np.array([size(part)]))
        elif len(part) <= SMALL:
            order = part[np.lexsort([words[k][part] for k in range(depth_max - 1, depth - 1, -1)])]
            new = np.zeros(len(order), bool)
            new[0] = True
            for k in range(depth, depth_max):
                new[1:] |= words[k][order[1:]] != words[k][order[:-1]]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order))) if weight is None else np.add.reduceat(weight[order], at)
            found.append(order[at[n >= least]])
            counts.append(n[n >= least])
        else:
            key = words[depth][part]
            pivot = np.sort(key[:: max(1, len(key) // 31)])[16]
            less, more = key < pivot, key > pivot
            stack += [(part[more], depth), (part[~(less | more)], depth + 1), (part[less], depth)]
    none = np.empty(0, np.int64)
    return (np.concatenate(found), np.concatenate(counts).astype(np.int64)) if found else (none, none)


def phrases(texts: DataFrame, length: int, seed: int, bits: list[bytes], n_words: int, least: int) -> DataFrame:
    """(w1 .. w_length, f, mark) of each phrase of ``length`` words with at least ``least`` occurrences.

    Suffixes are pointers to the positions whose words, and whose phrases of one word less, have their bits set in
    ``bits``. Tasks sort them and send distinct phrases with their counts, bundled by a bucket of the leading two
    words, so equal partitions to that depth meet in one place and a hot word spreads. There they are sorted again.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    tasks = n_partitions(texts)
    buckets = max(tasks, -(-n_words // BUCKET))

    def bundles(columns: list[np.ndarray]) -> pa.RecordBatch:
        at, n = multikey_quicksort(columns)
        columns = [c[at] for c in columns]
        bucket = (phrase_hash(columns[:2]) * _ROUTE % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        table = np.stack([*columns, n.view(np.uint64)])[:, order]
        bodies = [table[:, i:j].tobytes() for i, j in zip(edges, [*edges[1:], len(order)], strict=True)]
        return pa.record_batch([pa.array(bucket[edges]), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(b, np.uint8) for b in shared.value]

        def has(bitmap: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
            mark = _marks(words)
            return (bitmap[(mark >> np.uint64(3)).astype(np.int64)] >> (mark & np.uint64(7)).astype(np.uint8)) & 1 == 1

        held: list[list[np.ndarray]] = []
        for batch in batches:
            for _, _, _, _, run, _, (h,) in _read_words(batch, (seed,)):
                ok = has(maps[0], [h])
                at = np.flatnonzero(run[: len(run) - length + 1] == run[length - 1 :]) if len(run) >= length else np.empty(0, np.int64)
                for k in range(length):
                    at = at[ok[at + k]]
                if length > 2:
                    for k in range(2):
                        at = at[has(maps[1], [h[at + k + i] for i in range(length - 1)])]
                if len(at):
                    held.append([h[at + k] for k in range(length)])
                if sum(len(x[0]) for x in held) >= POINTERS:
                    yield bundles([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
        if held:
            yield bundles([np.concatenate(c) for c in zip(*held, strict=True)])

    names = [f"w{k + 1}" for k in range(length)]

    def counted(bodies: list[bytes]) -> pa.RecordBatch:
        table = np.concatenate([np.frombuffer(b, np.uint64).reshape(length + 1, -1) for b in bodies], axis=1)
        columns = list(table[:length])
        at, n = multikey_quicksort(columns, table[length].view(np.int64), least)
        columns = [c[at] for c in columns]
        return pa.record_batch([*[pa.array(c.view(np.int64)) for c in columns], pa.array(n), pa.array(_marks(columns).astype(np.int64))], names=[*names, "f", "mark"])

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies = None, []
        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and bodies:
                    yield counted(bodies)
                    bodies = []
                now = bucket
                bodies.append(body)
        if bodies:
            yield counted(bodies)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in [*names, "f", "mark"]])
    routed = small_batches(texts).mapInArrow(sent, "bucket int, body binary").repartitionById(tasks, F.col("bucket") % tasks)
    return cut(routed.sortWithinPartitions("bucket").mapInArrow(met, schema))


def collocation_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (l r)) in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(16,0)")
    above = (whole(a) * whole(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above, whole(left) * whole(right)).cast("long")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` collocations of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line breaks, and pieces into words at blanks and tabs. n
    is the number of a language's words, a, l and r how often a phrase and the two parts of its lowest-scoring cut
    occur. Candidates occur ``least`` times; one is dropped if a longer candidate around it has ``inside`` percent of
    its occurrences. Null text is empty, null lang is 'und'; texts without words add nothing, repeated rows count
    again, a long text is read whole (a task holds it and about 30 bytes for each of its words); other columns are
    ignored; an empty table gives an empty one. Equal scores rank by a, then by the phrase's UTF-8 bytes.

    All counts are exact: words meet by text, and the 64-bit hashes that stand for them afterwards are checked to
    differ, else drawn anew with another seed. The driver holds maps of 2^BITS bits and no phrase.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed = 20_240_607
    while True:
        words = vocabulary(texts, seed)
        shared = words.groupBy("h").agg(F.count("*").alias("n"), F.sum("clash").alias("clash")).where("n > 1 or clash > 0")
        if shared.isEmpty():
            break
        seed += 2
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n_words = words.agg(F.sum("f")).first()[0] or 0
    known = cut(words.where(F.col("f") >= least).select("lang", "word", F.col("h").alias("w1"), "f"))
    tables = {1: known}
    bits = [frequent_bits(known.select(F.shiftrightunsigned("w1", 64 - BITS).alias("mark")))]
    for length in range(2, longest + 1):
        tables[length] = phrases(texts, length, seed, bits, n_words, least)
        if length < longest:
            bits = [bits[0], frequent_bits(tables[length].select("mark"))]
    chosen = None
    for length in range(2, longest + 1):
        one = _scored(tables, length, inside, longest)
        chosen = one if chosen is None else chosen.unionByName(one)
    ordered = chosen.select("*", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_a"), F.lit(1).cast("long").alias("one"))
    ranked, _ = range_prefix(ordered, "lang", ["by_score", "by_a", "phrase"], "one", "before")
    best = ranked.where(F.col("before") < top)
    return best.join(totals, "lang").select("lang", (F.col("before") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(tables: dict[int, DataFrame], length: int, inside: int, longest: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates of ``length`` words that no longer one drops."""
    own = [f"w{k + 1}" for k in range(length)]
    out = tables[length].select(*own, F.col("f").alias("a"))
    for k, name in enumerate(own):
        word = tables[1].select(F.col("w1").alias(name), F.col("word").alias(f"t{k + 1}"), F.col("f").alias(f"f{k}_1"), *(["lang"] if k == 0 else []))
        out = out.join(word, name)
    for part in range(2, length):  # parts of that many words at either end
        for at in (0, length - part):
            names = own[at : at + part]
            some = tables[part].select(*[F.col(f"w{i + 1}").alias(n) for i, n in enumerate(names)], F.col("f").alias(f"f{at}_{part}"))
            out = out.join(some, names)
    cuts = []
    for k in range(1, length):
        left, right = F.col(f"f0_{k}"), F.col(f"f{k}_{length - k}")
        cuts.append(F.struct(collocation_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    out = out.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    around = None
    for more in range(length + 1, longest + 1):
        for at in range(more - length + 1):
            part = tables[more].select(*[F.col(f"w{at + i + 1}").alias(n) for i, n in enumerate(own)], F.col("f").alias("most"))
            around = part if around is None else around.unionByName(part)
    if around is not None:
        out = out.join(around.groupBy(*own).agg(F.max("most").alias("most")), own, "left").where(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True)))
    return out.select("lang", F.concat_ws(" ", *[f"t{k + 1}" for k in range(length)]).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES = {
    "op13_phrases": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
        u1 AS (SELECT lang, unnest(w) AS x FROM p),
        f1 AS (SELECT lang, x, count(*) AS f FROM u1 GROUP BY ALL),
        t AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        u2 AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(x := w[i], y := w[i + 1]))) AS s FROM p WHERE len(w) > 1),
        f2 AS (SELECT lang, s.x AS x, s.y AS y, count(*) AS f FROM u2 GROUP BY ALL HAVING count(*) >= {LEAST}),
        u3 AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(x := w[i], y := w[i + 1], z := w[i + 2]))) AS s FROM p WHERE len(w) > 2),
        f3 AS (SELECT lang, s.x AS x, s.y AS y, s.z AS z, count(*) AS f FROM u3 GROUP BY ALL HAVING count(*) >= {LEAST}),
        m AS (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
        c2 AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, b.f AS l, c.f AS r
               FROM f2 JOIN f1 b ON b.lang = f2.lang AND b.x = f2.x JOIN f1 c ON c.lang = f2.lang AND c.x = f2.y
               LEFT JOIN m ON m.lang = f2.lang AND m.x = f2.x AND m.y = f2.y WHERE coalesce(100 * most < {INSIDE} * f2.f, true)),
        c3 AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, b.f AS l1, c.f AS r1, e.f AS l2, g.f AS r2,
                      1000000 * f3.f::HUGEINT * f3.f // (b.f::HUGEINT * c.f) AS s1, 1000000 * f3.f::HUGEINT * f3.f // (e.f::HUGEINT * g.f) AS s2
               FROM f3 JOIN f1 b ON b.lang = f3.lang AND b.x = f3.x JOIN f2 c ON c.lang = f3.lang AND c.x = f3.y AND c.y = f3.z
               JOIN f2 e ON e.lang = f3.lang AND e.x = f3.x AND e.y = f3.y JOIN f1 g ON g.lang = f3.lang AND g.x = f3.z),
        s AS (SELECT lang, phrase, a, l, r, 1000000 * a::HUGEINT * a // (l::HUGEINT * r) AS score FROM c2
              UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
        SELECT o.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= {TOP}"""
}
QUERIES = {"op13_phrases": op13_phrases}
