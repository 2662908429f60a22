"""Hierarchical packing of documents into training windows of several lengths.

A document goes to the shortest tier that holds it whole; one longer than the longest window is
cut in pieces of that length, and what remains is routed by its own length. Tiers are packed
from the longest down. In each, best-fit decreasing places the tier's own pieces; then, window
by window in order of their number, the gaps take the longest piece of a shorter tier that still fits, until nothing
does. What no gap took is packed in its own tier. The windows of a shard are dealt to step
groups of about ``step_tokens``: tier by tier, fullest first, each round of windows going to the
groups in order of their load so far, so that groups differ by one window of a tier at most and
carry nearly equal tokens.

Packing is sequential by nature, so the pieces are spread by a digest over shards of about
``shard_tokens``; each is packed by itself, from lengths alone. The waste of a shard's last
windows is below a thousandth at the default.

Defined cases: a token is a run of characters other than blanks, tabs and line ends; documents without any (null or empty text)
have no place in a window and one row with tier, window, step and place null; repeated rows and
null identifiers are packed as documents of their own; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.mixing import word_count
from docquarry.runtime import checkpoint

TIERS = (512, 2048, 8192)
STEP_TOKENS = 1 << 18
SHARD_TOKENS = 1 << 23
SCHEMA = "shard long, tier int, window_no int, step int, place int, doc_id long, known boolean, tok_from long, tok_to long"


class Shelf:
    """Pieces by length: takes out the longest that fits."""

    def __init__(self):
        self.sizes: list[int] = []
        self.held: dict[int, list[int]] = defaultdict(list)

    def put(self, piece: int, size: int) -> None:
        if not self.held[size]:
            bisect.insort(self.sizes, size)
        self.held[size].append(piece)

    def take(self, room: int) -> int | None:
        at = bisect.bisect_right(self.sizes, room) - 1
        if at < 0:
            return None
        size = self.sizes[at]
        piece = self.held[size].pop()
        if not self.held[size]:
            del self.sizes[at]
        return piece


def pack_shard(size: list[int], tiers=TIERS, step_tokens: int = STEP_TOKENS):
    """(tier, window, step, place) of each piece, given in order of falling size; none is longer than the last tier."""
    tier = [bisect.bisect_left(tiers, n) for n in size]
    at: list = [None] * len(size)
    waiting = [[] for _ in tiers]
    for i, k in enumerate(tier):
        waiting[k].append(i)
    used: dict[tuple[int, int], int] = {}
    for k in range(len(tiers) - 1, -1, -1):
        room = Rooms()
        n_windows = 0
        for i in waiting[k]:
            if at[i] is not None:
                continue
            w = room.best(size[i])
            if w is None:
                w, free = n_windows, tiers[k]
                n_windows += 1
            else:
                free = tiers[k] - used[k, w]
            at[i] = (k, w, tiers[k] - free)
            used[k, w] = tiers[k] - free + size[i]
            room.add(w, free - size[i])
        if k == 0:
            break
        shelf = Shelf()
        for j in range(k):
            for i in reversed(waiting[j]):  # so that the first of a length comes out first
                if at[i] is None:
                    shelf.put(i, size[i])
        for w in range(n_windows):
            while (i := shelf.take(tiers[k] - used[k, w])) is not None:
                at[i] = (k, w, used[k, w])
                used[k, w] += size[i]
    steps = max(1, round(sum(tiers[k] for k, _ in used) / step_tokens))
    load, step_of = [(0, s) for s in range(steps)], {}
    for k in range(len(tiers) - 1, -1, -1):
        mine = sorted((w for w in used if w[0] == k), key=lambda w: (-used[w], w[1]))
        for start in range(0, len(mine), steps):
            load.sort()
            for j, w in enumerate(mine[start : start + steps]):
                t, s = load[j]
                step_of[w] = s
                load[j] = (t + used[w], s)
    return [(tiers[k], w, step_of[k, w], place) for k, w, place in at]


class Rooms:
    """Open windows by room left: finds the tightest that still takes a piece, the first of equals."""

    def __init__(self):
        self.rooms: list[int] = []
        self.held: dict[int, list[int]] = defaultdict(list)

    def add(self, window: int, room: int) -> None:
        if room <= 0:
            return
        if not self.held[room]:
            bisect.insort(self.rooms, room)
        heapq.heappush(self.held[room], window)

    def best(self, size: int) -> int | None:
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        window = heapq.heappop(self.held[room])
        if not self.held[room]:
            del self.rooms[at]
        return window


def pack(docs: DataFrame, tiers=TIERS, step_tokens: int = STEP_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: its shard, tier, window, step group, place in the window and part of the document.

    A step group is (shard, step); a window is (shard, tier, window_no).
    """
    tiers = tuple(sorted(tiers))
    longest = tiers[-1]
    key = F.col("doc_id").cast("long")
    # Pandas has no null longs; the partition's number spreads the rows of a hot identifier.
    d = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNotNull().alias("known"), word_count().alias("n"), F.spark_partition_id().alias("part"))
    d = checkpoint(d)  # words are counted once
    total = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    shards = max(1, -(-total // shard_tokens))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(longest).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    p = d.withColumn("tok_from", F.explode(starts))
    p = p.withColumn("tok_to", F.least(F.col("tok_from") + longest, F.col("n")))
    p = p.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tok_from", "n", "part"), F.lit(shards)).cast("long")).drop("n", "part")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        size = (pdf.tok_to - pdf.tok_from).to_numpy()
        pdf = pdf.iloc[np.lexsort((pdf.tok_from.to_numpy(), pdf.doc_id.to_numpy(), pdf.known.to_numpy(), -size))].reset_index(drop=True)
        size = (pdf.tok_to - pdf.tok_from).to_numpy()
        full = int((size > 0).sum())
        got = pack_shard(size[:full].tolist(), tiers, step_tokens) if full else []
        got += [(None,) * 4] * (len(size) - full)
        out = pd.DataFrame(got, columns=["tier", "window_no", "step", "place"]).astype("Int32")
        return pd.concat([pdf, out], axis=1)[[c.split()[0] for c in SCHEMA.split(", ")]]

    return p.groupBy("shard").applyInPandas(one, SCHEMA).withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
