"""Secret scans with DataFrame functions only: patterns and sliding-window entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Fixed patterns of the base scan: keyword assignments, access keys, hex digests.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidate strings of the entropy scan, and the window its counts slide over.
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Character classes, narrowest first: pattern of the whole string, alphabet, least entropy (bits) of some window.
_LETTERS_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    ("^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 3.05),
    ("^[A-Za-z0-9]+$", _LETTERS_DIGITS, 3.65),
    ("^[A-Za-z0-9+/=_-]+$", _LETTERS_DIGITS + "+/=_-", 3.75),
)
#: Strings that look random and are known not to be secrets.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]|xxxx",
    r"(?i)0123456789|abcdefghij",
    r"^[A-Za-z][A-Za-z_/+=-]*[0-9]{0,4}$",
    r"^[0-9](?:[0-9_/+=-]*[0-9])?$",
)
#: The patterns of ALLOW that speak for one part of a candidate only, and runs of the parts that they do not speak for.
MARKED = r"(?i)example|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefghij"
_PART = r"(?![^/=_-]*(?:example|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefghij))[^/=_-]++"
#: Possessive, since Java's matcher walks other repeated groups recursively, one frame for each part of a path.
UNMARKED = rf"(?i)(?<![^/=_-]){_PART}(?:[/=_-]++{_PART})*+"
#: Pieces of a text that are placed together, and characters of a candidate that are walked together.
RUN, STRETCH = 512, 128
_WEIGHT = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: where each match starts and ends, in code points, and its text; in order.

    The pieces between matches and the matches alternate, so their lengths add up to the places.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    spans = "array<struct<s:int,e:int,m:string>>"
    none = F.array().cast(spans)

    def place(pairs: Column) -> Column:
        """Where the pieces and their matches end if the first piece starts at 0, and the matches."""
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["gaps"])
            e = s + F.coalesce(F.length(x["hits"]), F.lit(0))
            one = F.array(F.struct(s.alias("s"), e.alias("e"), x["hits"].alias("m")))
            return F.struct(e.alias("at"), F.when(x["hits"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

        return F.aggregate(pairs, start, step)

    def placed(pairs: Column) -> Column:
        """Runs of RUN pieces are placed each from 0, so that no fold copies a long list again and again, then moved."""
        n_runs = F.ceil(F.size(pairs) / F.lit(RUN)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), n_runs - 1), lambda k: place(F.slice(pairs, k * RUN + 1, RUN)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out"))

        def step(acc: Column, run: Column) -> Column:
            moved = F.transform(run["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m")))
            return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

        return F.flatten(F.aggregate(runs, start, step, lambda acc: acc["out"]))

    # transform over one element binds what both uses share.
    pairs = F.transform(F.array(parts), lambda p: F.arrays_zip(p["gaps"].alias("gaps"), p["hits"].alias("hits")))
    return F.coalesce(F.when(text.rlike(pattern), F.element_at(F.transform(pairs, placed), 1)), none)


def window_entropy(text: Column, alphabet: str) -> Column:
    """Largest Shannon entropy (bits) of any WINDOW characters of ``text``, by counts that follow the window.

    The state holds the sum of c * log2(c) over the window's characters: a step adds the entering character, which
    stands c times in the window before it, and takes the leaving one away. The text is walked in stretches, each with
    the WINDOW - 1 characters before it, so the work is in proportion to its length. Null for shorter texts, and for
    those with characters beside ``alphabet``.
    """
    weight = F.array(*[F.lit(x) for x in _WEIGHT])  # weight[c] is that of c - 1 characters
    stretches = F.regexp_extract_all(text, F.lit(f".{{1,{STRETCH}}}"), F.lit(0))
    joined = lambda all_: F.transform(all_, lambda x, k: F.concat(F.when(k > 0, F.right(F.get(all_, k - 1), F.lit(WINDOW - 1))).otherwise(F.lit("")), x))
    times = lambda part, c: F.length(part) - F.length(F.replace(part, c, F.lit("")))

    def least(part: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("best"))

        def step(acc: Column, i: Column) -> Column:
            before = F.substr(part, F.greatest(i - WINDOW, F.lit(1)), F.least(i - 1, F.lit(WINDOW)))
            there = times(before, F.substr(part, i, F.lit(1)))
            entered = acc["s"] + F.element_at(weight, there + 2) - F.element_at(weight, there + 1)
            around = F.substr(part, i - WINDOW, F.lit(WINDOW + 1))
            gone = times(around, F.left(around, F.lit(1)))
            s = F.when(i > WINDOW, entered - F.element_at(weight, gone + 1) + F.element_at(weight, gone)).otherwise(entered)
            return F.struct(s.alias("s"), F.when(i >= WINDOW, F.least(acc["best"], s)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(1), F.length(part)), start, step, lambda acc: acc["best"])

    # transform over one element binds what several uses share.
    lowest = F.element_at(F.transform(F.array(stretches), lambda all_: F.array_min(F.transform(joined(all_), least))), 1)
    inside = F.length(F.translate(text, alphabet, "")) == 0
    return F.when(inside, F.lit(math.log2(WINDOW)) - lowest / F.lit(float(WINDOW)))


def is_random(text: Column) -> Column:
    """Whether some window reaches the entropy of the narrowest class that holds the whole string."""
    out = F.lit(False)
    for pattern, alphabet, least in reversed(CLASSES):
        out = F.when(text.rlike(pattern), window_entropy(text, alphabet) >= least).otherwise(out)
    return F.coalesce(out, F.lit(False))


FOUND = ("assign", "access", "hex", "entropy")


def scan(docs: DataFrame, column: str = "secrets") -> DataFrame:
    """``docs`` with one column more: a struct of the arrays assign, access, hex and entropy of matches (s, e, m).

    Base matches are leftmost and do not overlap within a kind; assignments with a value of less than 6 characters
    are dropped after matching. Of a candidate in which a part between / = _ - is marked as an example, the runs of
    the other parts are candidates. Entropy spans are candidates with a digit and a letter, no part of a base span and
    not on the allow list, one of whose windows is random enough for its class. Null text counts as empty; rows that
    repeat, or have no doc_id, are rows like others; a long text is read whole, in time in proportion to its length,
    however many parts or matches it has; a column of ``docs`` called ``column`` gives way, any other name
    is kept with its values; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6
    found = (
        docs.select(F.struct("*").alias("row"), text.alias("text"))
        .withColumn("assign", F.filter(matches(F.col("text"), ASSIGN), value))
        .withColumn("access", matches(F.col("text"), ACCESS))
        .withColumn("hex", matches(F.col("text"), HEX))
        .withColumn("candidates", matches(F.col("text"), CANDIDATE))
        .withColumn("base", F.concat("assign", "access", "hex"))
    )
    allowed = lambda m: F.lit(False) if not ALLOW else _any([m.rlike(p) for p in ALLOW])

    def rest(x: Column) -> Column:
        return F.transform(matches(x["m"], UNMARKED), lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), y["m"].alias("m")))

    parts = F.flatten(F.transform("candidates", lambda x: F.when(x["m"].rlike(MARKED), rest(x)).otherwise(F.array(x))))
    plausible = F.filter(parts, lambda x: (F.length(x["m"]) >= WINDOW) & x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~allowed(x["m"]))
    outside = F.filter("plausible", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    random = found.withColumn("plausible", plausible).withColumn("outside", outside).withColumn("entropy", F.filter("outside", lambda x: is_random(x["m"])))
    return random.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != column], F.struct(*FOUND).alias(column))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def joined(found: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the kinds' matches in ``found``, by start and then in the order given, comma-joined."""

    def tag(i: int, k: str) -> Column:
        return F.transform(F.col(found)[k], lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(k).alias("k")))

    tagged = [tag(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.col("secrets")[k]).cast("long").alias(f"n_{k}")
    base = joined("secrets", FOUND[:3])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("secrets", FOUND).alias("spans"))


ORACLES: dict[str, str] = {}
QUERIES = {"op7_secrets": op7_secrets}
