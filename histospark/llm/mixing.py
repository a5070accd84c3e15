"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is shuffled (by a hash of doc_id) and cut into blocks of
``block`` words. The schedule has one slot per block to take: the van der
Corput points u(i) = bit-reversal(i) / 2^k are mapped through the cumulative
slot counts of the sources, so that every source gets its exact number of
slots, spread evenly over the sequence; the rank of a slot among its source's
slots names the block (a second round starts at block 0 again). Bit reversal
is its own inverse, so the slots are generated source by source from their
ranges of u, in chunks, without a range join.

All steps are DataFrame operations; windows run within (source, hash bucket)
or (source, chunk of the sequence), whose sizes are bounded, so one source
with most of the rows is spread over many tasks.

Null text has no words. Sources are ordered by code point, null last (null is
a source of its own). Documents without words take nothing. Repeated rows
count as separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.llm.common import BLANKS, ROW, WORD, stored, table, with_row_id

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 512
#: Slots per chunk of the sequence, and documents per hash bucket (about).
CHUNK = 1 << 16
BUCKET_ROWS = 1000


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target. Targets share
    ``share`` of all sizes by weight (``weights`` repeating over the sources in
    order) and stop at ``cap`` times the source's size; the excess is shared
    again. The level at which no target is above its cap is the largest of
    (rest of the words) / (rest of the weights) over the sources sorted by
    cap / weight. One row per source goes through the unpartitioned windows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("no") % len(weights) + 1).cast("int")).cast("long")
    per = (per.withColumn("no", F.row_number().over(order) - 1).withColumn("w", w)
           .withColumn("cap", F.col("source_size") * cap))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "no").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.select("source", "no", "source_size",
                      F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def reverse_bits(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a long, in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
                        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift))
    return F.shiftrightunsigned(x, 64 - bits) if bits else x * 0


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per slot: source, slot (place in the sequence), epoch, block,
    use (words of the block that the slot takes). The last slot of a source
    takes what is left of its target."""
    size, t = F.col("source_size"), F.col("words")
    whole = F.expr("words div greatest(source_size, 1)")
    n_blocks = F.ceil(size / block)
    s = sources.withColumn("words", F.least(F.floor(F.col("target") + 0.5), size * CAP))
    s = s.withColumn("blocks", n_blocks).withColumn(
        "slots", whole * n_blocks + F.ceil((t - whole * size) / block))
    running = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("lo", F.coalesce(F.sum("slots").over(running), F.lit(0)))
    total = int(s.agg(F.sum("slots")).first()[0] or 0)
    bits = max(total - 1, 0).bit_length()
    s = s.where("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(lo div {CHUNK}, (lo + slots - 1) div {CHUNK})")))
    s = s.repartition("no", "chunk").withColumn("p", F.explode(F.expr(
        f"sequence(greatest(lo, chunk * {CHUNK}), least(lo + slots, (chunk + 1) * {CHUNK}) - 1)")))
    s = s.withColumn("slot", reverse_bits(F.col("p"), bits)).withColumn("part", F.expr(f"slot div {CHUNK}"))
    # Rank of each slot among its source's: slots of earlier parts + place in the part.
    parts = s.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s2"), F.col("part").alias("p2"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = s.withColumn("place", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1)
    ranked = ranked.join(parts, ranked["source"].eqNullSafe(parts["s2"]) & (ranked["part"] == parts["p2"]))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("place"))
    ranked = (ranked.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks")))
    start = F.col("epoch") * size + F.col("block") * block
    words = F.least(F.lit(block), size - F.col("block") * block)
    return ranked.select("source", "slot", "epoch", "block", F.least(words, t - start).alias("use"))


def positions(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with source_size, target and ``start``, the document's first
    word in its shuffled source: running sums within hash buckets plus the
    sums of earlier buckets."""
    digits = 1
    n = sizes.count()
    while n > BUCKET_ROWS * 16**digits and digits < 8:
        digits += 1
    keyed = sizes.withColumn("key", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    t = sources.select(F.col("source").alias("s1"), "source_size", "target")
    base = base.join(t, base["source"].eqNullSafe(t["s1"])).select(
        F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base", "source_size", "target")
    within = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(base, placed["source"].eqNullSafe(base["s2"]) & (placed["bucket"] == base["b2"]))
    return placed.withColumn("start", F.col("base") + F.col("within")).drop("key", "bucket", "within", "base", "s2", "b2")


def mix(rows: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """What the mix takes of each row of ``rows`` (doc_id, source, size, and
    whatever else identifies the row; a stored table): all columns of rows plus
    source_size, target, start, taken, taken_1 and taken_2, the words taken in
    the first and in the second round (leading words of the document), and
    slot_1 and slot_2, the first slot of the sequence that takes some of them."""
    names = rows.columns
    sources = stored(targets(rows, weights, share, cap), "mix-sources")
    placed = stored(positions(rows, sources), "mix-positions")
    slots = schedule(sources, block).select(F.col("source").alias("s1"), F.col("block").alias("b1"), "epoch", "use", "slot")
    pieces = placed.where("size > 0").select(
        "source", "start", "size",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("use"))
    used = pieces.join(slots, pieces["source"].eqNullSafe(slots["s1"]) & (pieces["block"] == slots["b1"]))
    used = used.withColumn("n", F.greatest(hi - lo, F.lit(0)))
    used = used.groupBy(F.col("source").alias("s1"), F.col("start").alias("w1")).agg(
        F.sum(F.when(F.col("epoch") == 0, F.col("n")).otherwise(0)).alias("taken_1"),
        F.sum(F.when(F.col("epoch") > 0, F.col("n")).otherwise(0)).alias("taken_2"),
        F.min(F.when((F.col("epoch") == 0) & (F.col("n") > 0), F.col("slot"))).alias("slot_1"),
        F.min(F.when((F.col("epoch") > 0) & (F.col("n") > 0), F.col("slot"))).alias("slot_2"))
    # A document with words is alone at its (source, start).
    out = placed.join(used, placed["source"].eqNullSafe(used["s1"]) & (placed["start"] == used["w1"]) & (placed["size"] > 0), "left")
    zero = F.lit(0).cast("long")
    return out.select(*[placed[c] for c in names], "source_size", "target", "start",
                      F.coalesce("taken_1", zero).alias("taken_1"), F.coalesce("taken_2", zero).alias("taken_2"),
                      (F.coalesce("taken_1", zero) + F.coalesce("taken_2", zero)).alias("taken"), "slot_1", "slot_2")


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mixed corpus, with the columns of ``docs`` (doc_id, text, source,
    n_chars among them): a document once per round in which words of it are
    taken, cut to those words where a target ends inside it, in the order of the
    sequence's slots (files and rows of the written table follow it)."""
    names = docs.columns
    rows = with_row_id(docs, "mix-input")
    plan = mix(stored(rows.select(ROW, "doc_id", "source", n_words().alias("size")), "mix-sizes"), block)
    rounds = F.array(*[F.struct(F.col(f"taken_{k}").alias("take"), F.col(f"slot_{k}").alias("slot")) for k in (1, 2)])
    plan = plan.where("taken > 0").select(F.col(ROW).alias("__hs_at"), F.col("size").alias("__hs_size"), F.explode(F.filter(rounds, lambda x: x["take"] > 0)).alias("__hs"))
    plan = plan.select("__hs_at", "__hs_size", F.col("__hs.take").alias("__hs_take"), F.col("__hs.slot").alias("__hs_slot"))
    out = rows.join(plan, rows[ROW] == plan["__hs_at"])
    leading = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[{BLANKS}]*{WORD}"), F.lit(0)), F.lit(1), F.col("__hs_take").cast("int")), "")
    text = F.when(F.col("__hs_take") < F.col("__hs_size"), leading).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    out = out.repartitionByRange("__hs_slot", ROW).sortWithinPartitions("__hs_slot", ROW)
    return out.select(*[f"`{c}`" for c in names])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size"))
    return mix(stored(sizes, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM p0),
p2 AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM p1),
p3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
                  - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                 / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lvl FROM p2),
p4 AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(lvl) OVER () * w) AS target FROM p3),
p5 AS (SELECT *, least(CAST(floor(target + 0.5::DOUBLE) AS BIGINT), 2 * source_size) AS t FROM p4),
pos AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.t,
               CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, d.size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
        FROM d JOIN p5 s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(st + size, t) - st, 0) + greatest(least(st + size, t - source_size) - st, 0) AS BIGINT) AS taken
FROM pos
"""

QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLE = {"op1_mix_sources": SQL}
