"""Secret scanning by a linear-chain conditional random field.

Words between blanks are tagged O (outside), B (a secret begins) or I (it goes on). A word's
scores come from features of its own (shape as its first twelve runs of byte classes, the word itself up to 16 bytes, length, shares of digits, capitals and signs,
number of different bytes, first bytes, the key before ``=`` or ``:``), the same features of
the words before and after it, and features of the whole document (density of signs, digits and
capitals, length); transitions are scored too. Viterbi finds the best tags.

The tables label no secrets, so the field is trained on passages of at most ``TRAIN_DOCS``
documents (smallest digests of doc_id; the least text of an identifier's rows) in which secrets of many formats and look-alikes that are
none (identifiers, checksums in prose, numbers, addresses) are set; words that a strict
pattern of key and value already shows to be secret are labelled so.

Viterbi is exact and cheap. Where O leads by more than any transition could make up, the best
path must pass through O (swapping that tag for O gains more than it can lose), so the chain
falls into short runs between such words, and only those are decoded, many at a time.

Defined cases: null, empty and blank texts have no rows; rows come for each row of the table,
repeated ones repeated; null identifiers are kept; an I without a B begins a secret; an empty table
trains on the formats alone and gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.words import Rolling, mix, slices, split, utf8

TRAIN_DOCS = 600
PASSAGE = 24
PASSAGES = 1600
BITS = 16
STEPS = 40
L2 = 1e-4
QUOTES = "\"'`,;()[]{}<>!?."
KEYS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "db_password", "SECRET_KEY", "API_TOKEN"]
_SHOWN = re.compile(r"^[\"'`]?(?:[0-9a-f]{32,128}|[A-Za-z0-9+/_\-]{32,})[=]*[\"'`,;]*$")
_KEYED = re.compile(r"(?i)^[\"']?(?:\w*_)?(?:password|passwd|pwd|secret|token|api_?key|access_?key|private_?key)[\"']?[:=]?$")
_CLASS = np.full(256, 4, np.uint8)
for _lo, _hi, _k in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (128, 255, 0)):
    _CLASS[_lo : _hi + 1] = _k
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103), *range(65, 71)]] = True


def _slot(kind: int, value: np.ndarray) -> np.ndarray:
    return (mix(value.astype(np.uint64) + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)


def word_slots(words: pa.Array) -> np.ndarray:
    """Feature slots of each word, one column a feature; none for the empty word."""
    words = words.cast(pa.large_string())
    n = len(words)
    core = pc.utf8_trim(words, characters=QUOTES)
    data, at = utf8(core)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    share = [np.bincount(owner, weights=kind == k, minlength=n) / np.maximum(size, 1) for k in range(5)]
    step = np.ceil(2 * np.log2(np.maximum(size, 1))).astype(np.int64)
    level = [np.ceil(4 * x).astype(np.int64) for x in share]
    # Shape: the classes of bytes, runs collapsed, the first twelve of them.
    turn = np.ones(len(data), bool)
    turn[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    runs, run_owner = kind[turn], owner[turn]
    held = np.bincount(run_owner, minlength=n)
    begin = np.cumsum(held) - held
    shape = Rolling(runs).of(begin, begin + np.minimum(held, 12)) if n else np.zeros(0, np.uint64)
    # Different bytes, counted in words long enough for it to tell.
    long = (size >= 12)[owner]
    seen = np.unique(owner[long] * 256 + data[long]) // 256
    kinds = np.ceil(1.5 * np.log2(np.maximum(np.bincount(seen, minlength=n), 1))).astype(np.int64)
    hexed = np.bincount(owner, weights=_HEX[data], minlength=n) == size
    roll = Rolling(data)
    low = pc.utf8_lower(core)
    low_data, low_at = utf8(low)
    name = Rolling(low_data).of(low_at[:-1], low_at[1:]) if n else np.zeros(0, np.uint64)
    name = np.where(size <= 16, name, 0)
    front = roll.of(at[:-1], at[:-1] + np.minimum(size, 4))
    sign = np.isin(data, (58, 61))  # : and =
    # The key before the first such sign, and how long what follows is.
    where = np.full(n, -1, np.int64)
    hits = np.flatnonzero(sign)[::-1]
    where[owner[hits]] = hits
    has = where >= 0
    key = np.where(has, roll.of(at[:-1], np.where(has, where, at[:-1])), 0)
    rest = np.where(has, np.ceil(np.log2(np.maximum(at[1:] - where, 1))), 0).astype(np.int64)
    quoted = pc.not_equal(pc.binary_length(words), pc.binary_length(core))
    quoted = np.asarray(quoted.cast(pa.int8())).astype(np.int64)
    mixed = ((level[1] > 0) * 1 + (level[2] > 0) * 2 + (level[3] > 0) * 4 + (level[4] > 0) * 8 + (level[0] > 0) * 16).astype(np.int64)
    u = np.uint64
    columns = [
        _slot(1, shape),
        _slot(2, step * 2 + quoted),
        _slot(3, (step * 8 + level[3]) * 8 + level[1]),
        _slot(4, step * 8 + level[4]),
        _slot(5, (step * 16 + kinds) * 2 + hexed),
        _slot(6, name),
        _slot(7, mix(front) + step.astype(u) // u(3)),
        _slot(8, mix(key) + rest.astype(u)),
        _slot(9, (mixed * 32 + step) * 2 + hexed),
        _slot(10, (mixed * 16 + kinds)),
    ]
    return np.stack(columns, axis=1) if n else np.zeros((0, 10), np.int32)


def file_slots(texts: pa.Array, count: np.ndarray) -> np.ndarray:
    """Feature slots of each document."""
    data, at = utf8(pc.fill_null(texts.cast(pa.large_string()), ""))
    size = np.maximum(np.diff(at), 1)

    def dense(flags):
        sums = np.r_[0, np.cumsum(flags)]
        return np.ceil(2 * np.log2(1 + 100 * (sums[at[1:]] - sums[at[:-1]]) / size)).astype(np.int64)

    kind = _CLASS[data]
    return np.stack([_slot(21, dense(np.isin(data, (59, 61, 123, 125, 60, 62)))), _slot(22, dense(kind == 3)), _slot(23, dense(kind == 1)), _slot(24, np.ceil(np.log2(count + 1)).astype(np.int64))], axis=1)


@dataclass
class Field:
    """Weights (slot, tag) of a word, of its neighbours and of its document; ``turn[a, b]`` scores b after a."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    turn: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.own, self.before, self.after, self.file, self.turn, self.bias]

    def lead(self) -> float:
        """The most that transitions can gain by a tag other than O at one word."""
        t = np.zeros((4, 4))
        t[:3, :3] = self.turn  # row and column 3: the text's ends
        return max(0.0, max(t[a, x] + t[x, b] - t[a, 0] - t[0, b] for a in range(4) for b in range(4) for x in (1, 2)))


def _random_secrets(rng: np.random.Generator) -> list[list[tuple[str, int]]]:
    """One passage for each format, as (word, tag) lists: secrets and look-alikes."""
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def draw(chars, n):
        return "".join(np.array(list(chars))[rng.integers(0, len(chars), n)])

    key, quote = KEYS[rng.integers(len(KEYS))], ['"', "'", ""][rng.integers(3)]
    values = [
        draw(hexes, int(rng.choice([32, 40, 64]))),
        draw(alnum, int(rng.integers(20, 64))),
        draw(alnum + "+/", 40) + "=" * int(rng.integers(3)),
        "AKIA" + draw(alnum[:26] + "234567", 16),
        "ghp_" + draw(alnum, 36),
        "sk-" + draw(alnum, 48),
        "sk_live_" + draw(alnum, 24),
        "xoxb-" + draw("0123456789", 12) + "-" + draw(alnum, 24),
        "AIza" + draw(alnum + "-_", 35),
        "eyJ" + draw(alnum, 30) + "." + draw(alnum, 60) + "." + draw(alnum + "-_", 43),
        "glpat-" + draw(alnum + "-_", 20),
    ]
    v = values[rng.integers(len(values))]
    pw = draw(alnum + "!@#$%^&*", int(rng.integers(9, 20)))
    val = [v, pw][int(rng.random() < 0.25)]
    out = [
        [(key, 0), ("=", 0), (f"{quote}{val}{quote}", 1)],
        [(key + ":", 0), (f"{quote}{val}{quote}", 1)],
        [(f"{key}={quote}{val}{quote}", 1)],
        [("Authorization:", 0), ("Bearer", 0), (v, 1)],
        [("export", 0), (f"{key.upper()}={quote}{val}{quote}", 1)],
        [(values[int(rng.integers(3, len(values)))], 1)],
    ]
    block = [("-----BEGIN", 1), (["RSA", "EC", "OPENSSH"][rng.integers(3)], 2), ("PRIVATE", 2), ("KEY-----", 2)]
    block += [(draw(alnum + "+/", 64), 2) for _ in range(int(rng.integers(2, 6)))] + [("-----END", 2), ("PRIVATE", 2), ("KEY-----", 2)]
    out.append(block)
    h = draw(hexes, 32)
    plain = [
        f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}",
        draw("0123456789", int(rng.integers(5, 20))),
        "https://example.org/" + draw(alnum, 6) + "/" + draw(alnum, int(rng.integers(5, 30))) + "?id=" + draw("0123456789", 5),
        draw(alnum[26:52], 8) + "@" + draw(alnum[26:52], 6) + ".com",
        f"{rng.integers(1, 99)}.{rng.integers(99)}.{rng.integers(99)}.{rng.integers(99)}",
        "-".join(draw("0123456789", 3) for _ in range(3)),
        draw(alnum[26:52], int(rng.integers(15, 45))),
        draw(alnum[:26], int(rng.integers(4, 20))),
        "".join(draw(alnum[:26], 1) + draw(alnum[26:52], 6) for _ in range(4)),
        "x" * int(rng.integers(10, 60)),
        "2024-01-0" + draw("123456789", 1) + "T10:00:00Z",
    ]
    p = plain[rng.integers(len(plain))]
    out += [[(p, 0)], [(plain[rng.integers(len(plain))], 0)], [("id", 0), ("=", 0), (plain[rng.integers(2)], 0)], [("the", 0), (key, 0), ("is", 0), ("not", 0)], [(key, 0), ("=", 0), ("true", 0)]]
    out += [[("sha1", 0), (draw(hexes, 40), 0)], [("commit", 0), (draw(hexes, 40), 0)], [("md5:", 0), (h, 0)], [("size", 0), ("=", 0), (draw("0123456789", 4), 0)]]
    return out


def passages(texts: list[str | None], n: int = PASSAGES, seed: int = 11) -> tuple[list[list[str]], list[list[int]]]:
    """Training passages and their tags: stretches of ``texts``, most with something set in."""
    rng = np.random.default_rng(seed)
    host = [w for w in ((t or "").split() for t in texts) if w]
    words, tags = [], []
    for k in range(n):
        w = host[k % len(host)] if host else ["lorem", "ipsum", "dolor", "sit", "amet"]
        at = int(rng.integers(max(1, len(w) - PASSAGE + 1)))
        w = w[at : at + PASSAGE]
        if rng.random() < 0.1:  # some documents shout
            w = [x.upper() + ["", "!!"][rng.integers(2)] for x in w]
        y = [int(i > 0 and bool(_SHOWN.match(x)) and (bool(_KEYED.match(w[i - 1])) or (i > 1 and w[i - 1] in ("=", ":") and bool(_KEYED.match(w[i - 2]))))) for i, x in enumerate(w)]
        if rng.random() < 0.8:
            kinds = _random_secrets(rng)
            put = kinds[rng.integers(len(kinds))]
            i = int(rng.integers(len(w) + 1))
            w, y = w[:i] + [x for x, _ in put] + w[i:], y[:i] + [t for _, t in put] + y[i:]
        words.append(w), tags.append(y)
    return words, tags


def train(texts: list[str | None], n: int = PASSAGES, steps: int = STEPS) -> Field:
    """Maximises the conditional likelihood of the passages' tags, by Adam on all of them at once."""
    words, tags = passages(texts, n)
    size = np.array([len(w) for w in words])
    longest = int(size.max())
    coded = pa.array([x for w in words for x in w], pa.large_string()).dictionary_encode()
    slots = word_slots(coded.dictionary)
    slots = np.concatenate([slots, np.full((1, slots.shape[1]), _slot(30, np.zeros(1))[0])])  # the last: no word
    none = len(slots) - 1
    c = np.full((n, longest + 2), none)
    inside = np.zeros((n, longest + 2), bool)
    inside[:, 1:-1] = np.arange(longest) < size[:, None]
    c[inside] = coded.indices.to_numpy()
    y = np.zeros((n, longest), np.int64)
    y[inside[:, 1:-1]] = [t for row in tags for t in row]
    # A passage's document is the passage itself; hosts are longer, so length is left to vary.
    fs = file_slots(pa.array([" ".join(w) for w in words], pa.large_string()), size * np.random.default_rng(5).integers(1, 60, n))
    used, inverse = np.unique(slots, return_inverse=True)
    inverse = inverse.reshape(slots.shape)
    fused, finverse = np.unique(fs, return_inverse=True)
    finverse = finverse.reshape(fs.shape)
    k, on = len(used), inside[:, 1:-1]
    p = [np.zeros((k, 3)), np.zeros((k, 3)), np.zeros((k, 3)), np.zeros((len(fused), 3)), np.zeros((3, 3)), np.zeros(3)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    gold_turn = np.zeros((3, 3))
    both = on[:, 1:]
    np.add.at(gold_turn, (y[:, :-1][both], y[:, 1:][both]), 1)
    rows = np.arange(n)[:, None], np.arange(longest)[None, :]
    for step in range(1, steps + 1):
        per = [x[inverse].sum(axis=1) for x in p[:3]]
        e = per[0][c[:, 1:-1]] + per[1][c[:, :-2]] + per[2][c[:, 2:]] + p[3][finverse].sum(axis=1)[:, None] + p[5]
        t = p[4]
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, longest):
            x = alpha[:, i - 1, :, None] + t
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, i]
            alpha[:, i] = np.where(on[:, i, None], new, alpha[:, i - 1])
        top = alpha[:, -1].max(axis=1)
        logz = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1))
        beta = np.zeros_like(e)
        turns = np.zeros((3, 3))
        for i in range(longest - 1, 0, -1):
            x = t + (e[:, i] + beta[:, i])[:, None, :]
            here = on[:, i]
            turns += np.exp(alpha[:, i - 1, :, None] + x - logz[:, None, None])[here].sum(axis=0)
            top = x.max(axis=2)
            beta[:, i - 1] = np.where(here[:, None], top + np.log(np.exp(x - top[:, :, None]).sum(axis=2)), 0)
        g = np.exp(alpha + beta - logz[:, None, None])
        g[rows[0], rows[1], y] -= 1
        g[~on] = 0
        grads = []
        for shift in (slice(1, -1), slice(0, -2), slice(2, None)):
            own = np.stack([np.bincount(c[:, shift].ravel(), g[:, :, j].ravel(), none + 1) for j in range(3)], axis=1)
            grads.append(np.stack([np.bincount(inverse.ravel(), np.repeat(own[:, j], inverse.shape[1]), k) for j in range(3)], axis=1))
        own = g.sum(axis=1)
        grads.append(np.stack([np.bincount(finverse.ravel(), np.repeat(own[:, j], finverse.shape[1]), len(fused)) for j in range(3)], axis=1))
        grads += [turns - gold_turn, g.sum(axis=(0, 1))]
        for j, gr in enumerate(grads):
            gr = gr / n + L2 * p[j]
            m[j] = 0.9 * m[j] + 0.1 * gr
            v[j] = 0.99 * v[j] + 0.01 * gr * gr
            p[j] = p[j] - 0.15 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-6)
    full = [np.zeros((1 << BITS, 3), np.float32) for _ in range(4)]
    for i in range(3):
        full[i][used] = p[i]
    full[3][fused] = p[3]
    return Field(*full, p[4], p[5])


def viterbi(e: np.ndarray, turn: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Best tags of the stretches begin..end of ``e``; ``left`` and ``right``: whether an O stands next to it."""
    tags = np.zeros(len(e), np.int8)
    size = end - begin
    order = np.argsort(-size, kind="stable")
    begin, size, left, right = begin[order], size[order], left[order], right[order]
    if not len(order):
        return tags
    score = e[begin] + np.where(left[:, None], turn[0], 0)
    came = []
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
        x = score[:n, :, None] + turn
        came.append(x.argmax(axis=1).astype(np.int8))
        score[:n] = x.max(axis=1) + e[begin[:n] + t]
    best = (score + np.where(right[:, None], turn[:, 0], 0)).argmax(axis=1).astype(np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        tags[begin[:n] + t] = best[:n]
        if t:
            best[:n] = came[t - 1][np.arange(n), best[:n]]
    return tags


class Tagger:
    def __init__(self, field: Field):
        self.field = field
        self.lead = field.lead() + 1e-6
        empty = np.full((1, 10), _slot(30, np.zeros(1))[0])
        self.edge = [x[empty].sum(axis=1)[0] for x in (field.before, field.after)]

    def scores(self, texts: pa.Array):
        s = split(texts)
        f = self.field
        slots = word_slots(s.words)
        own, before, after = (sum(x[slots[:, j]] for j in range(slots.shape[1])) for x in (f.own, f.before, f.after))
        file = f.file[file_slots(texts, s.count)].sum(axis=1)
        n = len(s.codes)
        e = own[s.codes] + file[s.doc] + f.bias
        if n:
            first = np.zeros(n, bool)
            first[s.first[s.count > 0]] = True
            last = np.r_[first[1:], True]
            e[1:] += np.where(first[1:, None], self.edge[0], before[s.codes[:-1]])
            e[0] += self.edge[0]
            e[:-1] += np.where(last[:-1, None], self.edge[1], after[s.codes[1:]])
            e[-1] += self.edge[1]
        return s, e

    def tags(self, s, e: np.ndarray) -> np.ndarray:
        n = len(e)
        if not n:
            return np.zeros(0, np.int8)
        open_ = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.lead
        first = np.r_[True, s.doc[1:] != s.doc[:-1]]
        last = np.r_[first[1:], True]
        before = np.r_[False, open_[:-1]]
        after = np.r_[open_[1:], False]
        begin = np.flatnonzero(open_ & (first | ~before))
        end = np.flatnonzero(open_ & (last | ~after)) + 1
        return viterbi(e, self.field.turn, begin, end, ~first[begin], ~last[end - 1])

    def __call__(self, texts: pa.Array):
        """(document, first word, word after the last) of each secret."""
        s, e = self.scores(texts)
        tag = self.tags(s, e)
        first = np.r_[True, s.doc[1:] != s.doc[:-1]] if len(tag) else np.zeros(0, bool)
        was_out = np.r_[True, tag[:-1] == 0] if len(tag) else np.zeros(0, bool)
        begin = np.flatnonzero((tag == 1) | ((tag == 2) & (first | was_out)))
        inside = tag == 2
        inside[begin] = False
        stop = np.flatnonzero(~np.r_[inside, False])  # the first word from each on that doesn't go on
        end = stop[np.searchsorted(stop, begin + 1)] if len(begin) else begin
        doc = s.doc[begin]
        return doc, begin - s.first[doc], end - s.first[doc]


def field_of(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """Trains on the ``rows`` documents with the smallest digests; only those reach the driver."""
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = d.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return train(got["text"].tolist())


def scan(docs: DataFrame, rows: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, word_from, word_to): each secret as a stretch of its document's words."""
    field = field_of(docs, rows)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        tagger = Tagger(field)
        for b in slices(batches, "text"):
            doc, begin, end = tagger(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(begin), pa.array(end)], names=["doc_id", "word_from", "word_to"])

    return d.mapInArrow(run, "doc_id long, word_from long, word_to long")
