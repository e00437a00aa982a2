"""SentencePiece encoding and decoding as a weighted finite-state transducer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE, UNIGRAM = 2, 1
#: Most pairs of pieces, and by default most stretches of a generation, that a worker remembers.
_PAIRS, REMEMBER = 3_600_000, 900_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of an installed public vocabulary; a parameter of every operator here."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    dummy_prefix: bool


def load(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only identity normalisation with escaped white space is compiled")
    return Vocabulary([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], proto.trainer_spec.model_type, spec.add_dummy_prefix)


@dataclass
class Normaliser:
    """The first machine: it writes ``front`` on its way from the start, then loops and rewrites the characters of ``arcs``."""

    front: str
    arcs: dict[str, str]

    def __post_init__(self) -> None:
        if any(c in out for c in self.arcs for out in self.arcs.values()):
            raise ValueError("an output that is an input of the same machine")

    def compose(self, text: str) -> str:
        for c, out in self.arcs.items():
            text = text.replace(c, out)
        return self.front + text if text else ""


class Lexicon:
    """The second machine, closed over its root: ``arcs[state]`` leads by characters, ``piece[state]`` is written at a state.

    A character without a piece of its own has a way from the root that writes its bytes (BY_BYTES in a path).
    """

    BY_BYTES = -2

    def __init__(self, ids: dict[str, int]):
        leaf: dict[str, int] = {}
        self.arcs: list[dict[str, int]] = [{}]
        self.piece = [-1]
        for text, i in ids.items():
            state = 0
            for c in text:
                if self.arcs[state] is leaf:
                    self.arcs[state] = {}
                state = self.arcs[state].setdefault(c, len(self.arcs))
                if state == len(self.arcs):
                    self.arcs.append(leaf)
                    self.piece.append(-1)
            self.piece[state] = i

    def leaving(self, text: str, i: int) -> list[tuple[int, int]]:
        """The composition with ``text`` at border ``i``: (next border, piece), shortest first."""
        arcs, piece, out, state = self.arcs, self.piece, [], 0
        for j in range(i, len(text)):
            state = arcs[state].get(text[j])
            if state is None:
                break
            if piece[state] >= 0:
                out.append((j + 1, piece[state]))
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, self.BY_BYTES))
        return out


@dataclass
class Transducer:
    """Normaliser, pieces and byte fallback, composed with an input; its encoding is the tropical shortest path.

    The normaliser maps a space to the mark and puts one in front. The lexicon reads a piece and returns to its root.
    Arcs of a unigram model weigh minus the piece's score, the way by bytes ten more than the worst of them, and the
    composed states are borders. A BPE model's composed states are a border and the last piece: an arc to the next
    one weighs nothing if the merges leave the two apart when they stand alone, else infinity. The path of finite
    weight is the encoding by merges, since a merge across a border can be seen from the two pieces at it; pieces
    that no merges make are no outputs. Composition stops at a border no piece crosses (before the mark and around a
    new line), so stretches are solved once and remembered.
    """

    vocabulary: Vocabulary
    remember: int = REMEMBER
    ids: dict[str, int] = field(init=False)
    bytes_of: list[int] = field(init=False)

    def __post_init__(self) -> None:
        v = self.vocabulary
        kinds = list(zip(v.pieces, v.kinds, strict=True))
        self.bytes_of = [-1] * 256
        for i, (p, k) in enumerate(kinds):
            if k == BYTE:
                self.bytes_of[int(p[3:5], 16)] = i
        if min(self.bytes_of) < 0 or USER in v.kinds or v.model not in (BPE, UNIGRAM):
            raise ValueError("needs a BPE or unigram model with all byte pieces and no user-defined ones")
        self.ids = {p: i for i, (p, k) in enumerate(kinds) if k == NORMAL}
        self.normaliser = Normaliser(SPACE if v.dummy_prefix else "", {" ": SPACE})
        self.lexicon = Lexicon({p: i for p, i in self.ids.items() if v.model == UNIGRAM or self._merged(p) == [p]})
        self._by_bytes = 10.0 - min((v.scores[i] for i in self.ids.values()), default=0.0)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = any("\n" in p for p in self.ids)
        self._cut = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if lines else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self._apart: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._plain = not (crossing or lines)
        #: Neighbours inside some piece; no path runs over a border between two others.
        self._inside = {x + y for p in self.ids for x, y in zip(p, p[1:], strict=False)}
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode("utf-8") for p, k in kinds]

    def _merged(self, text: str) -> list[str]:
        """The merges on a short text alone: the best-scored neighbour pair first, leftmost of equals."""
        parts = list(text)
        ids, scores = self.ids, self.vocabulary.scores
        ranks = [ids.get(a + b, -1) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best, at = -1e300, -1
            for i, k in enumerate(ranks):
                if k >= 0 and scores[k] > best:
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = ids.get(parts[at - 1] + parts[at], -1)
            if at < len(ranks):
                ranks[at] = ids.get(parts[at] + parts[at + 1], -1)
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        got = self._apart.get((a, b))
        if got is None:
            if len(self._apart) >= _PAIRS:
                self._apart.clear()
            x, y = self.vocabulary.pieces[a], self.vocabulary.pieces[b]
            got = self._apart[(a, b)] = self._merged(x + y) == [x, y]
        return got

    def shortest_path(self, stretch: str) -> tuple[int, ...]:
        """Pieces on the best path through one stretch; bytes where a character is no piece."""
        return self._by_merges(stretch) if self.vocabulary.model == BPE else self._by_scores(stretch)

    def _by_merges(self, text: str) -> tuple[int, ...]:
        """Best first over states (border, last piece): finite paths weigh nothing, so the agenda is a stack.

        Longest arcs come first. There is one finite path to the end; states that led nowhere are not entered again,
        so the search is linear in the states.
        """
        n, apart, leaving = len(text), self._apart, self.lexicon.leaving
        path: list[tuple[int, int, list[tuple[int, int]]]] = [(0, -1, leaving(text, 0))]
        dead: set[tuple[int, int]] = set()
        while path[-1][0] < n:
            at, last, arcs = path[-1]
            while arcs:
                j, piece = arcs.pop()
                if last >= 0 and piece >= 0:
                    free = apart.get((last, piece))
                    if free is None:
                        free = self._compatible(last, piece)
                    if not free:
                        continue
                if (j, piece) not in dead:
                    path.append((j, piece, leaving(text, j) if j < n else []))
                    break
            else:
                dead.add((at, last))
                path.pop()
        return self._written(text, [(j, piece) for j, piece, _ in path[1:]])

    def _by_scores(self, text: str) -> tuple[int, ...]:
        """Shortest distances forward over the borders, and the path back."""
        n, scores = len(text), self.vocabulary.scores
        weight, came = [0.0] + [float("inf")] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            for j, piece in self.lexicon.leaving(text, i):
                w = weight[i] + (-scores[piece] if piece >= 0 else self._by_bytes)
                if w < weight[j]:
                    weight[j], came[j] = w, (i, piece)
        path, j = [], n
        while j:
            path.append((j, came[j][1]))
            j = came[j][0]
        return self._written(text, path[::-1])

    def _written(self, text: str, path: list[tuple[int, int]]) -> tuple[int, ...]:
        """The output along a path of (border, piece)."""
        out: list[int] = []
        i = 0
        for j, piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes_of[b] for b in text[i:j].encode("utf-8", "replace")]
            i = j
        return tuple(out)

    def _solve(self, stretch: str) -> tuple[int, ...]:
        """A stretch's path, from two generations of remembered ones: the older is dropped when the newer is full."""
        got = self._known.get(stretch)
        if got is not None:
            return got
        got = self._older.get(stretch)
        if got is None:
            inside = self._inside
            cuts = [k for k in range(1, len(stretch)) if stretch[k - 1 : k + 1] not in inside]
            if cuts:
                got = tuple(chain.from_iterable(self._solve(stretch[a:b]) for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)))
            else:
                got = self.shortest_path(stretch)
        if len(stretch) <= 64:
            if len(self._known) >= self.remember:
                self._older, self._known = self._known, {}
            self._known[stretch] = got
        return got

    def forget(self) -> None:
        """Lets go of the remembered stretches, so that an idle worker holds the compiled machine alone."""
        self._known, self._older = {}, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = self.normaliser.compose(text)
        if not self._plain:
            return [i for stretch in self._cut.findall(marked) for i in self._solve(stretch)]
        out: list[int] = []
        for k, line in enumerate(marked.split("\n")):
            if k:
                out += self._solve("\n")
            if SPACE + SPACE in line or line.endswith(SPACE):
                stretches = self._cut.findall(line)
            else:
                first, *rest = line.split(SPACE)
                stretches = [first, *[SPACE + w for w in rest]] if first else [SPACE + w for w in rest]
            found = list(map(self._known.get, stretches))
            if None in found:
                found = [self._solve(w) if f is None else f for f, w in zip(found, stretches, strict=True)]
            out += chain.from_iterable(found)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse machine: pieces to bytes, the mark to a space, without the one put in front."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One compiled machine per worker and model."""
    if path not in _machines:
        _machines[path] = Transducer(load(path))
    return _machines[path]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, remember: int = REMEMBER, keep: bool = True) -> DataFrame:
    """Per document row: doc_id, ids (with ``with_ids``), n_tokens, n_bytes, ids_sha256, round_trip.

    Whole texts are encoded and decoded again: ``round_trip`` says whether the text came back, but for the mark
    U+2581, which decodes to a space as it does in the model itself. ids_sha256 is the hash of the ids, decimal,
    comma-joined; n_bytes counts byte pieces. A null or empty text has no ids; repeated rows and null doc_ids are
    rows like others. Other columns are ignored, whatever their names; an empty table gives an empty table. The vocabulary file must be installed on the executors at ``path``.
    A worker remembers at most 2 * ``remember`` stretches, about 220 bytes each; with ``keep`` its next task finds
    them, without it other work has the memory.
    """
    path = path or model_path()
    fields = [T.StructField("doc_id", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType(fields)

    def rows(fst: Transducer, is_byte: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        ids = [fst.encode(t) for t in texts]
        trip = [fst.decode(i) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
        arrays = [np.array(i, np.int32) for i in ids]
        columns = [part.column(0), *([pa.array(arrays, pa.list_(pa.int32()))] if with_ids else [])]
        columns += [pa.array([len(i) for i in ids], pa.int64()), pa.array([int(is_byte[a].sum()) for a in arrays], pa.int64())]
        columns += [pa.array([hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]), pa.array(trip)]
        return pa.record_batch(columns, names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine(path)
        fst.remember = remember
        is_byte = np.array([k == BYTE for k in fst.vocabulary.kinds])
        try:
            for batch in batches:
                for at in range(0, len(batch), 200):
                    yield rows(fst, is_byte, batch.slice(at, 200))
        finally:
            if not keep:
                fst.forget()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) back to (doc_id, text); null ids give an empty text."""
    path = path or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([fst.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), with_ids=False)


ORACLES: dict[str, str] = {}
QUERIES = {"op5_sentencepiece": op5_sentencepiece}
