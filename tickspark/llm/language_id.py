"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, read, small_batches
from .phrases import span_hashes
from .shingles import chunks, mix
from .toxicity import held_out

#: Bounds of training: labelled rows in all, shared by the languages; languages, those of the most rows; words of a row.
TRAIN_ROWS, LANGUAGES, WORDS = 1_600, 64, 48
#: States of each direction, longest sequence, sequences of a batch, steps of training and their first rate.
HIDDEN, LONGEST, BATCH, STEPS, RATE = 16, 32, 512, 400, 0.015
#: Bytes of text looked at together, sequences that run together, and labelled sequences that a task remembers.
TEXT, TOGETHER, REMEMBER = 1 << 22, 1024, 400_000
#: Symbols beside the bytes: the edge of a sequence, and what fills it up.
EDGE, PAD = 256, 257
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.int16)
_LOWER[65:91] += 32
UNKNOWN = "und"


@dataclass
class Model:
    """Per direction (0 forward, 1 backward) the inputs' share of the gates by symbol and the states' share of them;
    ``out`` and ``bias`` turn both states at a position into the languages' logits. Gates: reset, update, candidate."""

    langs: list[str]
    table: np.ndarray  # 2 x 3 HIDDEN x symbols
    state: np.ndarray  # 2 x 3 HIDDEN x HIDDEN
    out: np.ndarray  # languages x 2 HIDDEN
    bias: np.ndarray  # languages

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.state, self.out, self.bias]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (2, 3 * hidden, PAD + 1)).astype(np.float32)
    state = rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32)
    model = Model(langs, table, state, rng.normal(0, 0.1, (len(langs), 2 * hidden)).astype(np.float32), np.zeros(len(langs), np.float32))
    _still(model)
    return model


def _still(model: Model) -> None:
    """Lets PAD keep the state as it is: its update gate is 1."""
    hidden = model.state.shape[2]
    model.table[:, :, PAD] = 0
    model.table[:, hidden : 2 * hidden, PAD] = 60


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.tanh(np.multiply(x, 0.5, out=x), out=x)
    x *= 0.5
    x += 0.5
    return x


def run_direction(table: np.ndarray, state: np.ndarray, x: np.ndarray, keep: bool = False):
    """States (steps x HIDDEN x sequences) over the symbols ``x`` (steps x sequences); with ``keep`` also what the way back needs."""
    hidden, count = state.shape[1], x.shape[1]
    states = np.empty((len(x), hidden, count), np.float32)
    kept = []
    h = np.zeros((hidden, count), np.float32)
    gates, share = np.empty((3 * hidden, count), np.float32), np.empty((3 * hidden, count), np.float32)
    for t in range(len(x)):
        np.take(table, x[t], axis=1, out=gates)
        np.matmul(state, h, out=share)
        both = gates[: 2 * hidden]
        both += share[: 2 * hidden]
        _sigmoid(both)
        reset, update, cand = gates[:hidden], gates[hidden : 2 * hidden], gates[2 * hidden :]
        cand += reset * share[2 * hidden :]
        np.tanh(cand, out=cand)
        if keep:
            kept.append((gates.copy(), share[2 * hidden :].copy(), h))
        new = states[t]
        np.subtract(h, cand, out=new)
        new *= update
        new += cand
        h = new
    return states, kept


def back_direction(state: np.ndarray, x: np.ndarray, kept: list, pull: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``table`` and ``state`` by backpropagation through time; ``pull`` is the gradient at the states."""
    hidden = state.shape[1]
    g_state, inputs = np.zeros_like(state), np.empty((len(x), 3 * hidden, x.shape[1]), np.float32)
    later = np.zeros((hidden, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        gates, share, h = kept[t]
        reset, update, cand = gates[:hidden], gates[hidden : 2 * hidden], gates[2 * hidden :]
        d = pull[t] + later
        d_cand = d * (1 - update) * (1 - cand**2)
        own = inputs[t]
        own[:hidden] = d_cand * share * reset * (1 - reset)
        own[hidden : 2 * hidden] = d * (h - cand) * update * (1 - update)
        own[2 * hidden :] = d_cand
        through = own.copy()
        through[2 * hidden :] *= reset
        g_state += through @ h.T
        later = d * update + state.T @ through
    flat, symbol = inputs.transpose(0, 2, 1).reshape(-1, 3 * hidden), x.ravel()
    order = np.argsort(symbol, kind="stable")
    at = np.flatnonzero(np.diff(symbol[order], prepend=-1))
    g_table = np.zeros((symbols, 3 * hidden), np.float32)
    g_table[symbol[order][at]] = np.add.reduceat(flat[order], at, axis=0)
    return g_table.T, g_state


def log_probabilities(model: Model, x: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
    """steps x languages x sequences: how likely each language is at each position."""
    raw = np.matmul(model.out, np.concatenate([states[0], states[1][::-1]], axis=1)) + model.bias[:, None]
    raw -= raw.max(axis=1, keepdims=True)
    raw -= np.log(np.exp(raw).sum(axis=1, keepdims=True))
    return raw


def gradients(model: Model, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the positions that hold bytes, and its gradients."""
    ways = [run_direction(model.table[k], model.state[k], x[:: 1 - 2 * k], keep=True) for k in (0, 1)]
    logp = log_probabilities(model, x, [w[0] for w in ways])
    real = x < EDGE
    share = real / max(1, int(real.sum()))
    loss = -float((np.take_along_axis(logp, label[None, None, :], axis=1)[:, 0] * share).sum())
    d = np.exp(logp)
    d[:, label, np.arange(x.shape[1])] -= 1
    d *= share[:, None, :].astype(np.float32)
    both = np.concatenate([ways[0][0], ways[1][0][::-1]], axis=1)
    g_out = np.einsum("tln,thn->lh", d, both, optimize=True)
    pull = np.matmul(model.out.T, d)
    hidden = model.state.shape[2]
    found = [back_direction(model.state[k], x[:: 1 - 2 * k], ways[k][1], pull[:: 1 - 2 * k, k * hidden : (k + 1) * hidden], PAD + 1) for k in (0, 1)]
    return loss, [np.stack([f[0] for f in found]), np.stack([f[1] for f in found]), g_out, d.sum(axis=(0, 2))]


def sequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """steps x sequences: the spans' bytes, A-Z as a-z, between two edges, filled up at the end."""
    sizes = ends - starts
    place = np.arange(int(sizes.max()) + 2)[:, None] - 1
    x = np.full((len(place), len(starts)), PAD, np.int16)
    inside = (place >= 0) & (place < sizes)
    x[inside] = _LOWER[data[np.minimum(starts + place, len(data) - 1)[inside]]]
    x[(place == -1) | (place == sizes)] = EDGE
    return x


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each run of letters (ASCII letters and bytes from 128 on), cut after LONGEST bytes."""
    n = len(data)
    letter = _LETTER[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[1:], last[:-1] = ~letter[:-1], ~letter[1:]
    first[0] = last[-1] = True
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = True
    last[edges - 1] = True
    starts, ends = np.flatnonzero(letter & first), np.flatnonzero(letter & last) + 1
    pieces = -(-(ends - starts) // LONGEST)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = np.repeat(starts, pieces) + nth * LONGEST, np.repeat(ends, pieces)
        ends = np.minimum(ends, starts + LONGEST)
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def training_words(docs: DataFrame, rows: int = TRAIN_ROWS, words: int = WORDS, languages: int = LANGUAGES) -> list[tuple[str, bytes]]:
    """(lang, one of its words) from at most ``rows`` labelled documents outside the held-out fold, the languages alike.

    The rows of a language are those with the smallest hashes, and each gives ``words`` words from hashed places of
    its whole text, so that reruns and any partitioning take the same. Of more than ``languages`` languages those with
    the most rows are learned.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    each = max(1, rows // len(counts))
    upto = [(r["lang"], min(2**63 - 1, -(2**63) + 2**64 * 2 * each // r["count"])) for r in counts]
    some = known.join(F.broadcast(docs.sparkSession.createDataFrame(upto, "lang string, upto long")), "lang")
    some = some.withColumn("h", F.xxhash64("doc_id", "text")).where("h <= upto").select("lang", "h", "text")

    def picked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * len(batch)
            for i, j, data, offsets in chunks(batch.column(2), TEXT):
                owner, starts, ends = spans(data, offsets)
                bounds = np.searchsorted(owner, np.arange(j - i + 1))
                for d in range(j - i):
                    own = np.arange(bounds[d], bounds[d + 1])
                    key = np.argsort(mix(np.uint64(batch.column(1)[i + d].as_py() % 2**64) + own.astype(np.uint64) - np.uint64(bounds[d])), kind="stable")
                    out[i + d] = b" ".join(data[starts[k] : ends[k]].tobytes() for k in own[key[:words]])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "h", "words"])

    found: dict[str, list] = {}
    for r in small_batches(some).mapInArrow(picked, "lang string, h long, words binary").toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], bytes(r["words"])))
    return [(lang, w) for lang in sorted(found) for _, row in sorted(found[lang])[:each] for w in row.split(b" ") if w]


def fit(words: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE) -> Model:
    """Trains on labelled words; each step takes as many sequences of each language. Without words a model of no languages."""
    langs = sorted({lang for lang, _ in words})
    model = new_model(langs, hidden)
    if len(langs) < 2:
        return model
    data = np.frombuffer(b" ".join(w for _, w in words) + b" ", np.uint8)
    sizes = np.array([len(w) for _, w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    number = {lang: k for k, lang in enumerate(langs)}
    label = np.array([number[lang] for lang, _ in words])
    of = [np.flatnonzero(label == k) for k in range(len(langs))]
    rng = np.random.default_rng(7)
    parts = model.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        some = np.concatenate([rng.choice(o, -(-batch // len(langs))) for o in of])
        some = some[np.argsort(sizes[some], kind="stable")]
        grads = None
        for half in np.array_split(some, 4):  # of like length
            _, g = gradients(model, sequences(data, starts[half], starts[half] + sizes[half]), label[half])
            grads = g if grads is None else [a + b for a, b in zip(grads, g, strict=True)]
        pace = rate * min(1.0, 2 * (1 - (t - 1) / steps))
        for k, (p, g) in enumerate(zip(parts, grads, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            p -= (pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        _still(model)
    return model


def label_spans(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """spans x 2 languages: per span the sum of each language's log probabilities over its positions, then how many
    positions each language labels."""
    count, langs = len(starts), len(model.langs)
    out = np.empty((count, 2 * langs), np.float32)
    order = np.argsort(ends - starts, kind="stable")
    for i in range(0, count, TOGETHER):
        some = order[i : i + TOGETHER]
        x = sequences(data, starts[some], ends[some])
        states = [run_direction(model.table[k], model.state[k], x[:: 1 - 2 * k])[0] for k in (0, 1)]
        logp = log_probabilities(model, x, states)
        real = (x < EDGE)[:, None, :]
        out[some, :langs] = (logp * real).sum(axis=0).T
        won = logp.argmax(axis=1)
        out[some, langs:] = ((won[:, None, :] == np.arange(langs)[None, :, None]) & real).sum(axis=0).T
    return out


class _Memory:
    """Labels of the sequences that a task has met: the network starts anew at each, so equal ones are labelled alike."""

    def __init__(self, model: Model):
        self.model, self.known, self.labels = model, np.empty(0, np.uint64), np.empty((0, 2 * len(model.langs)), np.float32)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, row of them for each span)."""
        h, at, which = np.unique(mix(span_hashes(data, starts, ends, 77) + (ends - starts).astype(np.uint64)), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = self.known[place] != h if len(self.known) else np.ones(len(h), bool)
        if new.any():
            if len(self.known) + new.sum() > REMEMBER:
                self.known, self.labels, new = self.known[:0], self.labels[:0], np.ones(len(h), bool)
            labels = label_spans(self.model, data, starts[at[new]], ends[at[new]])
            known = np.concatenate((self.known, h[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.labels = known[order], np.concatenate((self.labels, labels))[order]
            place = np.searchsorted(self.known, h)
        return self.labels, place[which]


def language(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct of lang, score and positions (labelled bytes by language) for each whole text.

    A document's probabilities are the languages' geometric means over all its positions, made to sum to 1.
    """
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("positions", pa.list_(pa.int64()))])

    @F.arrow_udf("lang string, score double, positions array<long>")
    def label(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        memory, langs = _Memory(own), len(own.langs)
        for texts in parts:
            sums = np.zeros((len(texts), 2 * langs))
            if langs:
                for i, j, data, offsets in chunks(texts, TEXT):
                    if len(data) == 0:
                        continue
                    owner, starts, ends = spans(data, offsets)
                    if len(starts) == 0:
                        continue
                    labels, row = memory.of(data, starts, ends)
                    bounds = np.flatnonzero(np.diff(owner, prepend=-1))
                    for k in range(2 * langs):
                        sums[i + owner[bounds], k] = np.add.reduceat(labels[row, k].astype(float), bounds)
            places = sums[:, langs:].sum(axis=1, keepdims=True)
            mean = sums[:, :langs] / np.maximum(places, 1)
            share = np.exp(mean - mean.max(axis=1, keepdims=True)) if langs else mean
            best = share.argmax(axis=1) if langs else np.zeros(len(texts), int)
            score = share.max(axis=1) / share.sum(axis=1) if langs else np.zeros(len(texts))
            found = (places[:, 0] > 0) if langs else np.zeros(len(texts), bool)
            names = [own.langs[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)]
            offsets = pa.array(np.arange(0, langs * len(texts) + 1, langs) if langs else np.zeros(len(texts) + 1), pa.int32())
            counts = pa.ListArray.from_arrays(offsets, pa.array(sums[:, langs:].ravel().astype(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(found, score, 0.0)), counts], fields=list(kind))

    return label(text)


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "lang_score", positions: str = "lang_positions") -> DataFrame:
    """``docs`` with three columns: the language of each whole text, its probability, and the bytes labelled by language.

    Text that is null or has no letter is 'und' with score 0 and no labelled bytes, as is all text when nothing could
    be learned. Only the text is read. Rows that repeat are labelled alike, other columns stay as they are, older ones
    of the three names go, and an empty table gives an empty one. A long text is read whole; a task holds it once and
    some 100 bytes for each of its words.
    """
    # A task labels one Arrow batch at a time; texts without letters skip the network.
    text = F.col("text").cast("string")
    seen = F.when(text.rlike(r"\p{L}"), text)
    name = free(docs, "found")
    out = small_batches(docs).withColumn(name, language(docs.sparkSession, model, seen))
    counts = F.map_from_arrays(F.lit(model.langs).cast("array<string>"), F.col(name)["positions"])
    labelled = F.map_filter(counts, lambda _, n: n > 0) if model.langs else F.lit(None).cast("map<string,bigint>")
    return out.withColumns({lang: F.col(name)["lang"], score: F.col(name)["score"], positions: labelled}).drop(name)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(training_words(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


ORACLES: dict[str, str] = {}
QUERIES = {"op11_language_id": op11_language_id}
