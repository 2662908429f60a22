"""Toxicity by a classifier chain of linear models.

The chain predicts the categories that the labels carry, one after the other: first that a
document is of low quality, then that it is toxic. Each link is a logistic regression over the
presence of word and prefix features, and each after the first also sees the log-odds that the
links before it gave. For training, those come from models that did not see the row (out of
fold), so a later link learns how far the earlier ones can be trusted; for scoring, from the model
of all rows. Features are chosen by how far their frequency differs with the label, and are known by their whole 64-bit
hashes, so that a long text has no more of them than it holds.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those of the smallest digests of
doc_id. The tables label two categories, low quality and toxicity, so the chain has two links there; :func:`fit` takes any number. The last category's threshold is the one of the best F1 out of fold. Scoring reads every text
whole, in one pass without a shuffle.

Defined cases: null and empty texts have no features, so they get the intercepts' probability;
a null label leaves its row out of training, and of rows that share an identifier the least text is trained on; a category with a single class gets its base rate;
with no labels at all every probability is 0 and no document is toxic; rows out are the rows in,
repeated ones repeated and null identifiers kept; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.words import Rolling, Split, slices, split, utf8
from docquarry.llm.neardup import EDGES

CATEGORIES = ("low_quality", "toxic")
TRAIN_ROWS = 6_000
FEATURES = 1500
LEAST_DOCS = 3
FOLDS = 4
PREFIXES = (3, 4, 5, 6, 7, 8)
L2 = 0.3
LEAST_Z = 4.0


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, 64-bit feature hash): the word itself and its prefixes, lower case, without
    punctuation at the edges; the signs it ends in; whether it is in capitals."""
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)
    plain = pc.binary_join_element_wise(pa.scalar("^", plain.type), plain, pa.scalar("$", plain.type), pa.scalar("", plain.type))
    data, at = utf8(plain)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    roll, size = Rolling(data), np.diff(at)
    word, h = [np.flatnonzero(size > 2)], [roll.of(at[:-1][size > 2], at[1:][size > 2])]
    for n in PREFIXES:  # bytes after the mark
        has = np.flatnonzero(size > n + 2)
        word.append(has)
        h.append(roll.of(at[has], at[has] + n + 1))
    raw, ends = utf8(words)
    roll, size = Rolling(raw), np.diff(ends)
    last = raw[ends[1:] - 1]
    marked = np.flatnonzero((size > 2) & (last < 48))  # ends in a sign: its last three bytes
    word.append(marked)
    h.append(roll.of(ends[1:][marked] - 3, ends[1:][marked]) ^ np.uint64(0x5157))
    upper = pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 2))
    loud = np.flatnonzero(np.asarray(upper))
    word.append(loud)
    h.append(np.full(len(loud), 0xA11CA95, np.uint64) << np.uint64(32))
    return np.concatenate(word), np.concatenate(h)


def present(s: Split, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, index in ``known``), distinct: the sorted hashes ``known`` that each document has."""
    word, h = word_features(s.words)
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
    word, at = word[hit], at[hit]
    order = np.argsort(word, kind="stable")
    word, at = word[order], at[order]
    n = np.bincount(word, minlength=len(s.words))
    has = n > 0
    mine = has[s.codes]
    pairs = np.unique(s.doc[mine] * len(s.words) + s.codes[mine])
    doc, code = np.divmod(pairs, max(1, len(s.words)))
    first = np.cumsum(n) - n
    times = n[code]
    flat = np.repeat(first[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    both = np.unique(np.repeat(doc, times) * max(1, len(known)) + at[flat])
    return np.divmod(both, max(1, len(known)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; x is float32, y 0 or 1."""
    n, k = x.shape
    rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 1e-4
    b0 = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return np.zeros(k, np.float32), b0
    v = np.ones(k, np.float32)
    for _ in range(8):
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * (top + n) + l2)
    w, b = np.zeros(k, np.float32), b0
    lw, lb = w, b
    for i in range(steps):
        m = i / (i + 3)
        u, c = w + m * (w - lw), b + m * (b - lb)
        g = _sigmoid(x @ u + c) - y
        lw, lb = w, b
        w, b = (u - step * (x.T @ g + l2 * u)).astype(np.float32), c - step * float(g.sum())
    return w, b


@dataclass
class Chain:
    """``known`` holds the sorted feature hashes; ``links`` each (weights of features, weights of earlier links, intercept)."""

    categories: tuple[str, ...]
    known: np.ndarray
    links: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)
    threshold: float = 2.0

    def score(self, doc: np.ndarray, at: np.ndarray, n_docs: int) -> np.ndarray:
        """Probabilities, a row for each document and a column for each category."""
        out = np.zeros((n_docs, len(self.links)))
        for j, (w, earlier, b) in enumerate(self.links):
            z = np.bincount(doc, weights=w[at], minlength=n_docs) + b if len(self.known) else np.full(n_docs, b)
            out[:, j] = _sigmoid(z + _logit(out[:, :j]) @ earlier)
        return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sums of their rows of counts."""
    h, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    total = np.zeros((len(h), parts[0][1].shape[1]), np.int32)
    start = 0
    for own, n in parts:  # the hashes of a part are distinct
        total[at[start : start + len(own)]] += n
        start += len(own)
    return h, total


def select_features(texts: list[str | None], y: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """The features whose document frequency differs most with any label, half of ``most`` a label at least."""
    rows, parts = len(texts), []
    for start in range(0, rows, 200):
        s = split(pa.array(texts[start : start + 200], pa.large_string()))
        word, h = word_features(s.words)
        order = np.argsort(word, kind="stable")
        word = word[order]
        hashes, code_of = np.unique(h[order], return_inverse=True)
        n = np.bincount(word, minlength=len(s.words))
        doc, code = np.divmod(np.unique(s.doc * max(1, len(s.words)) + s.codes), max(1, len(s.words)))
        times, first = n[code], np.cumsum(n) - n
        flat = np.repeat(first[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        doc, at = np.divmod(np.unique(np.repeat(doc, times) * max(1, len(hashes)) + code_of[flat]), max(1, len(hashes)))
        counts = [np.bincount(at, minlength=len(hashes))]
        counts += [np.bincount(at[y[doc + start, j] > 0], minlength=len(hashes)) for j in range(y.shape[1])]
        parts.append((hashes, np.stack(counts, axis=1).astype(np.int32)))
        if len(parts) > 5:
            parts = [_summed(parts)]
    hashes, counts = _summed(parts)
    df, pos = counts[:, 0], counts[:, 1:].T
    chosen: set[int] = set()
    for j in range(y.shape[1]):
        n1 = y[:, j].sum()
        if not 0 < n1 < rows:
            continue
        p = df / rows
        z = np.where(df >= LEAST_DOCS, (pos[j] - n1 * p) / np.sqrt(n1 * p * (1 - p).clip(1e-6) * (1 - n1 / rows) + 0.5), 0)
        best = np.argsort(-np.abs(z), kind="stable")[: most // y.shape[1]]
        chosen |= set(best[np.abs(z[best]) >= LEAST_Z].tolist())
    return hashes[sorted(chosen)] if chosen else np.zeros(0, np.uint64)


def fit(texts: list[str | None], y: np.ndarray, categories=CATEGORIES, folds: int = FOLDS) -> Chain:
    """Fits the chain on labelled texts; ``y`` has a column of 0 and 1 for each category."""
    y = np.asarray(y, np.float32).reshape(len(texts), len(categories))
    chain = Chain(tuple(categories), np.zeros(0, np.uint64))
    if not len(texts):
        return chain
    chain.known = select_features(texts, y)
    x = np.zeros((len(texts), len(chain.known)), np.float32)
    for start in range(0, len(texts), 200):
        doc, at = present(split(pa.array(texts[start : start + 200], pa.large_string())), chain.known)
        x[doc + start, at] = 1
    fold = np.arange(len(texts)) % folds
    out_of_fold = np.zeros_like(y)
    for j in range(len(categories)):
        z = np.hstack([x, _logit(out_of_fold[:, :j]).astype(np.float32)])
        for f in range(folds):
            w, b = fit_linear(z[fold != f], y[fold != f, j])
            out_of_fold[fold == f, j] = _sigmoid(z[fold == f] @ w + b)
        w, b = fit_linear(z, y[:, j])
        chain.links.append((w[: x.shape[1]].astype(np.float64), w[x.shape[1] :].astype(np.float64), b))
    p, t = out_of_fold[:, -1], y[:, -1] > 0
    if t.any():
        order = np.argsort(-p, kind="stable")
        hit = np.cumsum(t[order])
        f1 = 2 * hit / (np.arange(1, len(p) + 1) + t.sum())
        best = int(np.argmax(f1))
        after = p[order[best + 1]] if best + 1 < len(p) else 0.0
        chain.threshold = float((p[order[best]] + after) / 2)
    return chain


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    """Fits the chain on the ``rows`` labelled documents whose doc_id has the smallest digest."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    got = got.toPandas().sort_values("doc_id").reset_index(drop=True)  # a row for each of ``rows`` identifiers at most
    y = np.stack([got.quality.to_numpy() == 0, got.toxic.to_numpy() == 1], axis=1) if len(got) else np.zeros((0, 2))
    return fit(got.text.tolist(), y)


def scorer(chain: Chain, columns: tuple[str, ...]):
    def run(batches):
        for b in slices(batches, "text"):
            p = chain.score(*present(split(b.column("text")), chain.known), b.num_rows)
            kept = [b.column(b.schema.get_field_index(c)) for c in columns]
            probs = [pa.array(p[:, j].round(6) if chain.links else np.zeros(b.num_rows)) for j in range(len(chain.categories))]
            toxic = pa.array(p[:, -1] >= chain.threshold if chain.links else np.zeros(b.num_rows, bool))
            yield pa.RecordBatch.from_arrays([*kept, *probs, toxic], names=[*columns, *(f"p_{c}" for c in chain.categories), "is_toxic"])

    return run


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, is_toxic) for every row of ``docs``."""
    chain = train(docs, labels, rows)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", is_toxic boolean"
    return d.mapInArrow(scorer(chain, ("doc_id",)), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the chain does not call toxic, in one pass and without a join.

    The labels speak of the documents ``labelled``, by default ``docs`` itself.
    """
    chain = train(docs if labelled is None else labelled, labels, rows)
    columns = tuple(docs.columns)
    at = columns.index("text")
    # Columns are numbered on the way, so names of any kind, repeated ones too, come back as they were.
    plain = docs.toDF(*[("text" if i == at else f"c{i}") for i in range(len(columns))])

    def run(batches):
        for b in slices(batches, "text"):
            p = chain.score(*present(split(b.column("text")), chain.known), b.num_rows)
            stay = p[:, -1] < chain.threshold if chain.links else np.ones(b.num_rows, bool)
            yield b.filter(pa.array(stay))

    return plain.mapInArrow(run, plain.schema).toDF(*columns)
