"""Arrow-side word splitting that the Python stages share.

A word is a maximal run of characters that are not white space. Texts are handled whole: a
batch is cut between documents only, by bytes, so that a batch of very long texts does not
multiply a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_M64 = (1 << 64) - 1
RADIX = 0x9E3779B97F4A7C15 | 1
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of ``column``, or one document."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        group = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def numbered(df, own: tuple[str, ...]):
    """(``df`` with the columns ``own`` under their names and all others numbered, the names of all): no helper column can clash."""
    names = df.columns
    first = {c: names.index(c) for c in own if c in names}
    return df.toDF(*[c if first.get(c) == i else f"c{i}" for i, c in enumerate(names)]), names


@dataclass
class Split:
    """The words of some texts. ``codes`` are in text order and index ``words``."""

    words: pa.Array
    codes: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray


def split(texts: pa.Array) -> Split:
    """Null and blank texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(texts)
    held = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), held)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        full = codes != blank
        codes, doc = codes[full], doc[full]
    count = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    return Split(coded.dictionary, codes, doc, np.cumsum(count) - count, count)


def utf8(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``words`` and the offsets where each begins and the last ends."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1 + words.offset)[words.offset :]
    if words.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(words) + 1, np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base², … modulo 2⁶⁴. The longest row asked for so far is kept."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        kept = _POWERS[base] = np.multiply.accumulate(out)
    return kept[:n]


class Rolling:
    """Hashes of any stretch of a buffer, each in constant time (a polynomial modulo 2⁶⁴)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(RADIX_INVERSE, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(RADIX, n), out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """One 64-bit hash for each word, the same in every batch and on every executor."""
    data, at = utf8(words)
    return Rolling(data).of(at[:-1], at[1:]) if len(words) else np.zeros(0, np.uint64)
