"""Language identification by unigram pieces with the segmentation marginalised.

Each language has a probability for every piece of a fixed public vocabulary. The score of a
word under a language is the sum over all its segmentations into pieces of the product of their
probabilities, by a forward algorithm over bytes; a text's score is the sum of its words' log
scores, repeated words counted as often as they stand. A word is what stands between blanks, of any
length, and carries the space before it, as the vocabulary's pieces do. Every byte is a piece, so every text has a score.

All pieces of the vocabulary take part, whatever their length. For speed a word is divided at
the places that no piece reaches over: every segmentation has a border there, so the sum is the product of
the parts' sums. Long parts are rescaled on the way, so that no product leaves the range of a double.

The piece probabilities are fitted by expectation maximisation over all segmentations, for each
language on at most ``TRAIN_DOCS`` documents that the column ``lang`` names it for: those with the smallest digests of
doc_id. Whole texts are scored in one pass without a shuffle.

Defined cases: a text without words (null, empty, blank) has language, confidence and score null; documents
without a language take no part in training, and of rows that share identifier and language the least text does; with no language at all every result is null; equal
scores go to the language that sorts first; rows out are the rows in, repeated ones repeated and
null identifiers kept; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.llm.words import Rolling, slices, split, utf8, word_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TRAIN_DOCS = 400
ROUNDS = 5
PRIOR = 0.02
TILT = 2.5  # nats a byte, taken out of the products on the way so that they stay in range
RESCALE = 64  # bytes after which the sums of a long part are rescaled
CACHE = 400_000
GROUP_BYTES = 1 << 18
_BITS = 22


@dataclass
class Pieces:
    """The vocabulary: sorted hashes, lengths in bytes, and for each length from 1 on whether to try it.

    Few pieces are long: those over ``stem`` bytes are tried only where their first ``stem`` bytes
    stand, whose hashes ``stems`` holds.
    """

    hashes: np.ndarray
    size: np.ndarray
    stem: int
    stems: np.ndarray
    longest: int


def pieces(path: str = VOCABULARY, stem: int = 12) -> Pieces:
    with open(path, "rb") as f:
        raw = sorted({base64.b64decode(line.split()[0]) for line in f})
    at = np.r_[0, np.cumsum([len(p) for p in raw])]
    roll = Rolling(np.frombuffer(b"".join(raw), np.uint8))
    h, size = roll.of(at[:-1], at[1:]), np.diff(at)
    long = at[:-1][size > stem]
    order = np.argsort(h)
    return Pieces(h[order], size[order], stem, np.unique(roll.of(long, long + stem)), int(size.max()))


class Lattice:
    """All places where pieces fit in some words, divided in parts no piece reaches out of.

    ``back`` tells which parts belong to which word. Every place between bytes of a part is a
    node; the arcs are ordered by how far from the part's begin they end, then by their end.
    """

    def __init__(self, words: pa.Array, known: Pieces):
        spaced = pa.compute.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        data, at = utf8(spaced)
        total = len(data)
        roll = Rolling(data)
        maybe = np.zeros(1 << _BITS, bool)
        maybe[known.hashes >> np.uint64(64 - _BITS)] = True
        # Bytes from each place to the end of its word.
        left = np.repeat(at[1:], np.diff(at)) - np.arange(total)
        starts, sizes, found = [], [], []
        here = np.arange(total)
        for n in range(1, known.longest + 1):
            if n == known.stem + 1:
                here = here[left[here] >= n]
                stems = roll.of(here, here + known.stem)
                here = here[known.stems[np.minimum(np.searchsorted(known.stems, stems), len(known.stems) - 1)] == stems] if len(known.stems) else here[:0]
            here = here[left[here] >= n]
            if not len(here):
                break
            h = roll.of(here, here + n)
            rows = np.flatnonzero(maybe[h >> np.uint64(64 - _BITS)])
            at_ = np.minimum(np.searchsorted(known.hashes, h[rows]), len(known.hashes) - 1)
            hit = known.hashes[at_] == h[rows]
            starts.append(here[rows[hit]]), found.append(at_[hit].astype(np.int32))
            sizes.append(np.full(int(hit.sum()), n, np.int32))
        none = np.zeros(0, np.int64)
        start, size, self.piece = (np.concatenate(x) if x else none for x in (starts, sizes, found))
        over = np.zeros(total + 2, np.int64)
        np.add.at(over, start + 1, 1)
        np.add.at(over, start + size, -1)
        border = np.cumsum(over)[: total + 1] == 0
        border[at] = True
        cut = np.flatnonzero(border)  # parts lie between neighbouring borders
        self.n = len(cut) - 1 if total else 0
        self.size = np.diff(cut)
        self.back = np.searchsorted(at, cut[:-1], side="right") - 1 if self.n else none
        self.bytes = np.diff(at)
        part = np.searchsorted(cut, start, side="right") - 1
        # Parts have a node more than bytes.
        self.first = cut[:-1] + np.arange(self.n)
        self.last = self.first + self.size
        self.nodes = total + self.n
        self.start, self.end = start + part, start + size + part
        self.length = size
        depth = start + size - cut[part]
        order = np.lexsort((self.end, depth))
        self.start, self.end, self.piece, self.length, part, depth = (x[order] for x in (self.start, self.end, self.piece, self.length, part, depth))
        self.deepest = int(self.size.max(initial=0))
        self.turn = np.searchsorted(depth, np.arange(self.deepest + 2))
        self.window = known.longest
        self.long = np.argsort(-self.size, kind="stable")

    def _rescale(self, a: np.ndarray, log: np.ndarray, t: int, forward: bool) -> None:
        """Divides the last sums of parts that go on beyond ``t`` by the greatest; ``log`` keeps what was divided out."""
        parts = self.long[: int(np.searchsorted(-self.size[self.long], -t, side="left"))]
        near = np.arange(self.window + 1)
        if forward:
            at = self.first[parts][:, None] + np.maximum(t - near, 0)
        else:
            at = self.last[parts][:, None] - np.maximum(t - near, 0)
        top = a[at].max(axis=1)
        top = np.where(top > 0, top, 1.0)
        at_, owner = np.unique(at, return_index=True)
        owner //= len(near)
        a[at_] /= top[owner]
        log[at_] += np.log(top)[owner]

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, logarithms of what was divided out) at every node; ``p`` has a column for each language."""
        a = np.zeros((self.nodes, p.shape[1]))
        log = np.zeros_like(a) if self.deepest > RESCALE else np.zeros((1, p.shape[1]))
        a[self.first] = 1
        for t in range(1, self.deepest + 1):
            f, to = self.turn[t], self.turn[t + 1]
            end = self.end[f:to]
            fresh = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
            part = a[self.start[f:to]] * p[self.piece[f:to]]
            if t > RESCALE:  # sums in the window were brought to the scale of the part
                log[end[fresh]] = log[end[fresh] - 1]
            a[end[fresh]] = np.add.reduceat(part, fresh, axis=0) if len(fresh) < len(end) else part
            if t % RESCALE == 0 and t < self.deepest:
                self._rescale(a, log, t, True)
        return a, log

    def at_ends(self, a: np.ndarray, log: np.ndarray) -> np.ndarray:
        """The logarithm of each part's whole sum."""
        return np.log(a[self.last]) + (log[self.last] if len(log) > 1 else 0)

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Log score of each word under each language; ``p`` is tilted."""
        z = self.at_ends(*self.forward(p))
        out = np.zeros((len(self.bytes), p.shape[1]))
        np.add.at(out, self.back, z)
        return out - TILT * self.bytes[:, None]

    def expected(self, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each of which stands ``weight`` times."""
        a, log = self.forward(q[:, None])
        whole = self.at_ends(a, log)[:, 0]
        b = np.zeros_like(a)
        back = np.zeros_like(log)
        b[self.last] = 1
        # Backward: arcs by how far from the part's end they begin.
        owner = np.searchsorted(self.first, self.start, side="right") - 1
        depth = self.last[owner] - self.start
        order = np.lexsort((self.start, depth))
        turn = np.searchsorted(depth[order], np.arange(self.deepest + 2))
        for t in range(1, self.deepest + 1):
            rows = order[turn[t] : turn[t + 1]]
            start = self.start[rows]
            fresh = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
            part = b[self.end[rows]] * q[self.piece[rows]][:, None]
            if t > RESCALE:
                back[start[fresh]] = back[start[fresh] + 1]
            b[start[fresh]] = np.add.reduceat(part, fresh, axis=0) if len(fresh) < len(start) else part
            if t % RESCALE == 0 and t < self.deepest:
                self._rescale(b, back, t, False)
        share = a[self.start, 0] * b[self.end, 0] * q[self.piece]
        scale = -whole[owner]
        if len(log) > 1:
            scale = scale + log[self.start, 0] + back[self.end, 0]
        with np.errstate(over="ignore", invalid="ignore"):
            share = np.where(share > 0, np.exp(np.log(np.maximum(share, 1e-300)) + scale), 0)
        return np.bincount(self.piece, share * weight[self.back[owner]], len(q))


def _groups(words: pa.Array, most: int = GROUP_BYTES):
    """(from, to) of stretches of words of about ``most`` bytes."""
    size = np.asarray(pa.compute.binary_length(words.cast(pa.large_string()))).astype(np.int64) + 1
    group = np.cumsum(size) // most
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)]
    return [(f, to) for f, to in zip(cut, cut[1:]) if to > f]


@dataclass
class Model:
    languages: list[str]
    known: Pieces
    p: np.ndarray


def fit(texts: list[str | None], languages: list[str], path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Fits the piece probabilities of each language that ``languages`` names on its texts."""
    names = sorted(set(languages))
    known = pieces(path)
    k = len(known.hashes)
    p = np.zeros((k, len(names)))
    tilt = np.exp(TILT * known.size)
    for j, name in enumerate(names):
        s = split(pa.array([t for t, own in zip(texts, languages) if own == name], pa.large_string()))
        weight = np.bincount(s.codes, minlength=len(s.words)).astype(float)
        # Words that don't stand in the text (the empty one of a blank text) weigh nothing.
        parts = [(Lattice(s.words.slice(f, to - f), known), weight[f:to]) for f, to in _groups(s.words)]
        count = np.zeros(k)
        for lattice, w in parts:
            owner = np.searchsorted(lattice.first, lattice.start, side="right") - 1
            count += np.bincount(lattice.piece, w[lattice.back[owner]] * lattice.length, k)
        for _ in range(rounds):
            q = (count + PRIOR) / (count.sum() + PRIOR * k) * tilt
            count = sum((lattice.expected(q, w) for lattice, w in parts), np.zeros(k))
        p[:, j] = (count + PRIOR) / (count.sum() + PRIOR * k) * tilt
    return Model(names, known, p)


def train(docs: DataFrame, path: str = VOCABULARY, rows: int = TRAIN_DOCS) -> Model:
    """Fits on the ``rows`` documents of each language with the smallest digests; only those reach the driver."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = marked.withColumn("r", rank).where(F.col("r") <= rows).select("doc_id", "lang").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = got.toPandas().sort_values(["lang", "text", "doc_id"])  # ``rows`` rows a language at most
    return fit(got["text"].tolist(), got["lang"].tolist(), path)


class Scorer:
    """Scores batches; words scored before are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[int, int] = {}
        self.rows = np.zeros((1 << 12, len(model.languages)))

    def words(self, words: pa.Array) -> np.ndarray:
        if len(self.at) > CACHE:
            self.at.clear()
        keys = word_hashes(words).tolist()
        at, new = np.empty(len(keys), np.int64), []
        for i, k in enumerate(keys):
            j = self.at.get(k)
            if j is None:
                j = self.at[k] = len(self.at)
                new.append(i)
            at[i] = j
        if new:
            while len(self.rows) < len(self.at):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            fresh, own = words.take(pa.array(new)), at[new]
            for f, to in _groups(fresh):
                self.rows[own[f:to]] = Lattice(fresh.slice(f, to - f), self.model.known).scores(self.model.p)
        return self.rows[at]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log score a text and language, words a text)."""
        s = split(texts)
        own = self.words(s.words) if len(s.words) else np.zeros((0, len(self.model.languages)))
        out = np.zeros((len(texts), len(self.model.languages)))
        for j in range(out.shape[1]):
            out[:, j] = np.bincount(s.doc, own[s.codes, j], len(texts))
        return out, s.count


def identify(docs: DataFrame, path: str = VOCABULARY, rows: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, language, confidence, log_score) for every row of ``docs``: the likeliest language,
    its probability among the languages, and the text's log score under it a word."""
    model = train(docs, path, rows)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        score = Scorer(model)
        for b in slices(batches, "text"):
            if not model.languages:
                none = pa.nulls(b.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.nulls(b.num_rows, pa.string()), none, none], names=["doc_id", "language", "confidence", "log_score"])
                continue
            z, n = score(b.column("text"))
            best, blank = z.argmax(axis=1), n == 0
            top = z[np.arange(len(z)), best]
            sure = 1 / np.exp(z - top[:, None]).sum(axis=1)
            names = pa.array(np.asarray(model.languages, object)[best], pa.string(), mask=blank)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), names, pa.array(sure.round(6), mask=blank), pa.array((top / np.maximum(n, 1)).round(4), mask=blank)],
                names=["doc_id", "language", "confidence", "log_score"],
            )

    return d.mapInArrow(run, "doc_id long, language string, confidence double, log_score double")
