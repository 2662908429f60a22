"""Mixing sources to target weights along a low-discrepancy schedule.

The documents of a source are shuffled (by a seeded digest of their identifier) and laid end to
end; the line is cut in blocks of equal token counts, the last one shorter. Slot ``t`` of the
schedule draws its source from the point ``t * golden ratio mod 1``, held in 32 bits, mapped
through the cumulative weights: any stretch of the schedule holds each source within a few
slots of its weight. The k-th slot of a source takes block ``k mod blocks``; ``k div blocks``
is the epoch. With ``cover`` (the default) the schedule is as long as the source that needs most slots to
appear in full, and the few blocks that rounding leaves over are appended, so nothing is lost;
otherwise it is as long as there are blocks in all.

No window runs over a whole source: positions come from sums over digest buckets and over
stretches of slots first, so one hot source spreads over all executors.

Defined cases: a token is a run of characters other than blanks, tabs and line ends (as SQL can count them too); a document without any (null or empty text)
holds no place in a block and does not appear; a null source is a source of its own; ties of the digest
(repeated identifiers) are ordered by length, and equal rows are interchangeable; a source that
``weights`` leaves out or gives nothing is not scheduled; an empty table gives no rows; columns
other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.llm.words import numbered
from docquarry.runtime import checkpoint

GOLDEN = 2654435769  # 2^32 / golden ratio, odd
BLOCK_TOKENS = 2048
POWER = 0.8
STRETCH = 4096
NULL_SOURCE = "\u0001null"


def word_count(text="text"):
    """Words between blanks; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)).alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        word_count().alias("n"),
    ).where("n > 0")


def pieces(held: DataFrame, block_tokens: int, seed: int, digits: int = 3) -> DataFrame:
    """(source, block, doc_id, tok_from, tok_to): which part of a document of :func:`lengths` lies in which block.

    ``digits`` hex digits of the digest make the buckets of a source: 4,096 by default, so a
    source of ten billion documents has 2.4 million in one window.
    """
    d = held.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    d = d.withColumn("bucket", F.substring("h", 1, digits))
    held = d.groupBy("source", "bucket").agg(F.sum("n").alias("held"))
    before = held.withColumn("before", F.sum("held").over(W.partitionBy("source").orderBy("bucket")) - F.col("held")).drop("held")
    run = W.partitionBy("source", "bucket").orderBy("h", "n").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("local", F.sum("n").over(run)).join(before, ["source", "bucket"])
    d = d.select("source", "doc_id", "n", (F.col("before") + F.col("local") - F.col("n")).alias("start"))
    size = F.lit(block_tokens).cast("long")
    first, last = F.expr(f"start div {block_tokens}"), F.expr(f"(start + n - 1) div {block_tokens}")
    d = d.withColumn("block", F.explode(F.sequence(first, last)))
    return d.select(
        "source",
        "block",
        "doc_id",
        F.greatest(F.col("block") * size - F.col("start"), F.lit(0)).cast("long").alias("tok_from"),
        F.least((F.col("block") + 1) * size - F.col("start"), F.col("n")).cast("long").alias("tok_to"),
    )


def plan(held: DataFrame, weights: dict[str, float] | None, power: float, block_tokens: int, cover: bool):
    """([(source, blocks, low, high)], slots): each source's share of 2^32 points; one row a source reaches the driver."""
    totals = sorted((r.source, r.tokens) for r in held.groupBy("source").agg(F.sum("n").alias("tokens")).collect())
    raw = {s: (t**power if weights is None else float(weights.get(s, 0.0))) for s, t in totals}
    whole = sum(raw.values())
    units = {s: int(1e6 * w / whole + 0.5) if whole else 0 for s, w in raw.items()}
    units = {s: max(1, u) for s, u in units.items() if raw[s] > 0}
    summed, at, out = sum(units.values()), 0, []
    for s, t in totals:
        if s in units:
            blocks = -(-t // block_tokens)
            out.append((s, blocks, (at << 32) // summed, ((at + units[s]) << 32) // summed))
            at += units[s]
    slots = max((-(-b * summed // units[s]) for s, b, _, _ in out), default=0) if cover else sum(b for _, b, _, _ in out)
    return out, slots


def point():
    """Where slot ``t`` falls among 2^32 points; products stay below 2^63."""
    return F.expr(f"((t & 65535) * {GOLDEN} + ((((t >> 16) & 65535) * {GOLDEN}) & 65535) * 65536) & 4294967295")


def schedule(held: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, block_tokens: int = BLOCK_TOKENS, cover: bool = True) -> DataFrame:
    """(slot, source, block, epoch): the whole schedule of the documents of :func:`lengths`. Without ``weights`` a source weighs its tokens to ``power``."""
    spark = held.sparkSession
    sources, slots = plan(held, weights, power, block_tokens, cover)
    shares = spark.createDataFrame(sources, "source string, blocks long, low long, high long")
    drawn = spark.range(slots).select(F.col("id").alias("t")).withColumns({"u": point(), "stretch": F.expr(f"t div {STRETCH}")})
    drawn = drawn.join(F.broadcast(shares), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))  # one row a source
    counts = drawn.groupBy("source", "stretch").agg(F.count("*").alias("m"))
    before = counts.withColumn("before", F.sum("m").over(W.partitionBy("source").orderBy("stretch")) - F.col("m")).drop("m")
    rank = F.row_number().over(W.partitionBy("source", "stretch").orderBy("t")) - 1
    ranked = drawn.withColumn("local", rank).join(before, ["source", "stretch"]).withColumn("k", F.col("before") + F.col("local"))
    main = ranked.select(F.col("t").alias("slot"), "source", F.expr("k % blocks").alias("block"), F.expr("k div blocks").alias("epoch"))
    if not cover:
        return main
    drew = counts.groupBy("source").agg(F.sum("m").alias("drew"))
    short = shares.join(drew, "source", "left").withColumn("drew", F.coalesce("drew", F.lit(0))).where("drew < blocks")
    rest = short.select("source", F.explode(F.expr("sequence(drew, blocks - 1)")).alias("block"))
    tail = rest.select((F.row_number().over(W.orderBy("source", "block")) - 1 + F.lit(slots)).alias("slot"), "source", "block", F.lit(0).cast("long").alias("epoch"))
    return main.unionByName(tail)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, block_tokens: int = BLOCK_TOKENS, seed: int = 7, cover: bool = True) -> DataFrame:
    """(slot, source, block, epoch, doc_id, tok_from, tok_to): what each slot of the schedule trains on."""
    return _mixed(checkpoint(lengths(docs)), weights, power, block_tokens, seed, cover)


def _mixed(held: DataFrame, weights, power, block_tokens, seed, cover) -> DataFrame:
    slots = schedule(held, weights, power, block_tokens, cover)
    out = slots.join(pieces(held, block_tokens, seed), ["source", "block"])
    source = F.when(F.col("source") != NULL_SOURCE, F.col("source"))
    return out.select("slot", source.alias("source"), "block", "epoch", "doc_id", "tok_from", "tok_to")


def resample(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, block_tokens: int = BLOCK_TOKENS, seed: int = 7, cover: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule draws the block where it begins.

    Documents without a word begin in no block; with ``cover`` they come once, so that no row is lost.
    """
    plain, names = numbered(docs, ("doc_id", "source", "text"))
    own = plain.columns
    key = F.col("doc_id").cast("long")
    held = checkpoint(lengths(docs))
    drawn = _mixed(held, weights, power, block_tokens, seed, cover).where("tok_from = 0")
    # Repeated identifiers share their draws evenly: each row of one is drawn once for each of its own pieces.
    times = drawn.groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("__drawn"))
    rows = held.groupBy(F.col("doc_id").alias("__own")).agg(F.count("*").alias("__rows"))
    times = times.join(rows, F.col("__key").eqNullSafe(F.col("__own"))).select("__key", F.expr("cast(ceil(__drawn / __rows) as int)").alias("__times"))
    out = plain.join(times, key.eqNullSafe(F.col("__key")), "left")
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^ \t\n\r]"), F.lit(False))
    copies = F.when(worded, F.coalesce("__times", F.lit(0))).otherwise(1 if cover else 0)
    out = out.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(own).toDF(*names)


ORACLE = f"""
WITH d AS (SELECT coalesce(source, '{NULL_SOURCE}') AS source, doc_id,
                  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n,
                  md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
 l AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY h, n ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS start FROM d WHERE n > 0),
 p AS (SELECT source, doc_id, n, start, unnest(range(start // {BLOCK_TOKENS}, (start + n - 1) // {BLOCK_TOKENS} + 1)) AS block FROM l),
 tot AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM l GROUP BY source),
 raw AS (SELECT source, (tokens + {BLOCK_TOKENS} - 1) // {BLOCK_TOKENS} AS blocks,
                greatest(1, CAST(floor(1e6 * pow(tokens, {POWER}) / (SELECT sum(pow(tokens, {POWER})) FROM tot) + 0.5) AS BIGINT)) AS units FROM tot),
 cum AS (SELECT *, CAST(sum(units) OVER (ORDER BY source) AS BIGINT) AS upto, CAST(sum(units) OVER () AS BIGINT) AS summed FROM raw),
 sh AS (SELECT source, blocks, ((upto - units) * 4294967296) // summed AS low, (upto * 4294967296) // summed AS high,
               (blocks * summed + units - 1) // units AS need FROM cum),
 s AS (SELECT t, (t * {GOLDEN}) % 4294967296 AS u FROM (SELECT unnest(range((SELECT max(need) FROM sh))) AS t)),
 r AS (SELECT t AS slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS k FROM s JOIN sh ON u >= low AND u < high),
 tail AS (SELECT source, unnest(range(drew, blocks)) AS block FROM (
            SELECT sh.source, sh.blocks, coalesce(c.drew, 0) AS drew FROM sh LEFT JOIN (SELECT source, count(*) AS drew FROM r GROUP BY source) c ON c.source = sh.source)
          WHERE drew < blocks),
 slots AS (SELECT slot, source, k % blocks AS block, k // blocks AS epoch FROM r
           UNION ALL
           SELECT row_number() OVER (ORDER BY source, block) - 1 + (SELECT max(need) FROM sh), source, block, 0 FROM tail)
SELECT CAST(slot AS BIGINT) AS slot, CASE WHEN slots.source <> '{NULL_SOURCE}' THEN slots.source END AS source, CAST(slots.block AS BIGINT) AS block,
       CAST(epoch AS BIGINT) AS epoch, doc_id, CAST(greatest(p.block * {BLOCK_TOKENS} - start, 0) AS BIGINT) AS tok_from,
       CAST(least((p.block + 1) * {BLOCK_TOKENS} - start, n) AS BIGINT) AS tok_to
FROM slots JOIN p ON p.source = slots.source AND p.block = slots.block
"""
