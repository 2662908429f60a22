"""Token counts by a two-tier lookup on the map side.

The counts are those of a byte-level BPE vocabulary, read from a file. Its pattern never lets a
pre-token reach over the white space before the next word, so a text falls into units: a word
with the one space before it, or a stretch of other white space. A unit's token count does not
depend on what stands around it, which is what makes it worth looking up.

Tier one is a compact table (64-bit hash, token count) of the corpus's most frequent units. Each
partition of a first pass over all documents encodes its ``REPORT`` most frequent units and reports their hashes, token
counts and frequencies; those numbers are summed, and the ``TABLE`` most frequent go to all workers. Tier two takes the misses:
each distinct one of a batch is looked up in the worker's own cache and, if new, encoded. No unit is ever
shuffled, and no more than ``REPORT`` numbers a partition; what the table holds affects speed, not results.

White space outside ASCII would let a unit's tokens depend on its neighbours; a document that
holds any is encoded whole instead. A hash that two units share would give a wrong count; with
tables of about a million entries that is one lookup in 10¹³.

Defined cases: null texts count null, empty ones 0; rows out are the rows in, repeated ones
repeated and null identifiers kept; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.words import Rolling, mix, slices, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE = 1 << 15
REPORT = 1 << 12
CACHE = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_OTHER_WHITE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def units(texts: pa.Array):
    """(bytes of all texts, where units start, where they end, their text): no unit of a text with other white space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    data, at = utf8(texts)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), bool)
    whole = np.asarray(pc.match_substring_regex(texts, _OTHER_WHITE))
    white = _WHITE[data]
    before = np.r_[False, white[:-1]]
    after = np.r_[~white[1:], False]
    space = np.r_[False, data[:-1] == 32]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    start = (white & (~before | after)) | (~white & before & ~space)
    start[at[:-1][full]] = True
    begin = np.flatnonzero(start)
    doc = np.searchsorted(at, begin, side="right") - 1
    end = np.r_[begin[1:], len(data)]
    if whole.any():
        own = ~whole[doc]
        begin, end, doc = begin[own], end[own], doc[own]
    return data, begin, end, doc, whole


def unit_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Rolling(data).of(begin, end) + (end - begin).astype(np.uint64))


def _reports(path):
    def run(batches):
        yield from _reported(batches, path)

    return run


def _reported(batches, path):
    held: dict[bytes, int] = {}
    for b in slices(batches, "text"):
        data, begin, end, _, _ = units(b.column("text"))
        _, first, times = np.unique(unit_hashes(data, begin, end), return_index=True, return_counts=True)
        often = times > 1
        raw = data.tobytes()
        for i, n in zip(first[often].tolist(), times[often].tolist()):
            unit = raw[begin[i] : end[i]]
            held[unit] = held.get(unit, 0) + n
        if len(held) > 1 << 18:
            held = dict(sorted(held.items(), key=lambda x: -x[1])[: 1 << 16])
    top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:REPORT]
    data, at = np.frombuffer(b"".join(u for u, _ in top), np.uint8), np.r_[0, np.cumsum([len(u) for u, _ in top])].astype(np.int64)
    enc = encoding(path)
    yield pa.RecordBatch.from_arrays(
        [pa.array(unit_hashes(data, at[:-1], at[1:]).view(np.int64) if top else [], pa.int64()), pa.array([len(enc.encode_ordinary(u.decode())) for u, _ in top], pa.int32()), pa.array([n for _, n in top], pa.int64())],
        names=["hash", "size", "n"],
    )


def frequent(docs: DataFrame, path: str = VOCABULARY, most: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, token counts) of the ``most`` most frequent units of all documents."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    top = texts.mapInArrow(_reports(path), "hash long, size int, n long").groupBy("hash").agg(F.sum("n").alias("n"), F.min("size").alias("size"))
    got = top.orderBy(F.desc("n"), "hash").limit(most).toPandas()  # ``most`` rows
    h = got["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["size"].to_numpy(np.int32)[order]


class Counter:
    """Counts tokens of batches with the frequent table first, then the cache, then the encoder."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray], path: str = VOCABULARY):
        self.hashes, self.sizes = table
        self.path = path
        self.cache: dict[int, int] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        enc = encoding(self.path)
        data, begin, end, doc, whole = units(texts)
        h = unit_hashes(data, begin, end)
        size = np.zeros(len(h), np.int64)
        miss = np.ones(len(h), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            miss = self.hashes[at] != h
            size[~miss] = self.sizes[at[~miss]]
        missed = np.flatnonzero(miss)
        if len(missed):
            key, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
            raw, cache = data.tobytes(), self.cache
            if len(cache) > CACHE:
                cache.clear()
            own = np.empty(len(key), np.int64)
            for j, (k, i) in enumerate(zip(key.tolist(), missed[first].tolist())):
                n = cache.get(k)
                if n is None:
                    n = cache[k] = len(enc.encode_ordinary(raw[begin[i] : end[i]].decode()))
                own[j] = n
            size[missed] = own[back]
        out = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
        for i in np.flatnonzero(whole).tolist():
            out[i] = len(enc.encode_ordinary(texts[i].as_py()))
        return out


def count_tokens(docs: DataFrame, path: str = VOCABULARY, most: int = TABLE) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``."""
    table = frequent(docs, path, most)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        count = Counter(table, path)
        for b in slices(batches, "text"):
            text = b.column("text")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count(text), mask=np.asarray(text.is_null()))], names=["doc_id", "n_tokens"])

    return d.mapInArrow(run, "doc_id long, n_tokens long")
