"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame and SQL functions only.

Slot j of the mix is the point j * G mod 2^32 (G: the golden ratio of 2^32), which falls into one source's stretch of
the cumulative targets. The k-th slot of a source takes block k mod n of that source's shuffled words, cut into n
blocks of equal words; so a source's blocks are used up evenly, pass after pass, three passes at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

GOLDEN, RING, SLOTS, BLOCK, LIMIT, CHUNK = 2654435769, 1 << 32, 1 << 16, 4096, 3, 1 << 12


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(source_col).alias("source"), n.alias("size"), F.xxhash64(text_col).alias("content"), (F.col(row_col) if row_col else F.lit(0)).alias("row"))


def ring_point(j) -> F.Column:
    """j * GOLDEN mod RING. The factor goes in halves of 16 bits, so that no product of any slot number overflows."""
    low, high = F.pmod(j, F.lit(1 << 16)), F.shiftright(F.pmod(j, F.lit(RING)), 16)
    return F.pmod(F.pmod(high * GOLDEN, F.lit(1 << 16)) * (1 << 16) + low * GOLDEN, F.lit(RING))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, place, target, low, high) of each source: target words, and its stretch of the ring.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share all words; a target stops at three times its
    source's size, and the rest is shared again by weight. In the order of cap over weight the capped sources come
    first, so one pass of running sums finds them.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    each = each.withColumn("place", F.row_number().over(by_name).cast("bigint")).withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumn("cap", LIMIT * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    each = each.withColumn("total", F.sum("source_size").over(everything)).withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    each = each.withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free.cast("double") * F.col("weight") / share)
    each = each.withColumn("target", target)
    upto = F.sum("target").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    ring = lambda c: F.round(c / F.greatest(F.col("total"), F.lit(1)) * RING).cast("bigint")
    return each.withColumn("high", F.when(F.col("place") == F.count("*").over(everything), F.lit(RING)).otherwise(ring(upto))).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0))).select("source", "source_size", "place", "target", "low", "high", "total")


def schedule(goals: DataFrame, n_slots: int, block: int) -> DataFrame:
    """(place, block, times): how often the schedule takes each block of each source.

    Points meet stretches by an equi-join on the ring's 4,096 arcs. Ranks within a source add up counts of chunks of
    slots, so no source's slots need one task.
    """
    arcs = goals.where("low < high and source_size > 0").select("place", "source_size", "low", "high", F.explode(F.sequence(F.shiftright("low", 20), F.shiftright(F.col("high") - 1, 20))).alias("arc"))
    slots = goals.sparkSession.range(n_slots).select(F.col("id").alias("j"), ring_point(F.col("id")).alias("x")).withColumn("arc", F.shiftright("x", 20))
    dealt = slots.join(arcs, "arc").where("x >= low and x < high").select("place", "source_size", "j", F.expr(f"j div {CHUNK}").alias("chunk"))
    counts = dealt.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    prior = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("j")) - 1).join(counts.select("place", "chunk", prior.alias("prior")), ["place", "chunk"])
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    return ranked.withColumn("rank", F.col("k") + F.col("prior")).where(F.col("rank") < LIMIT * blocks).groupBy("place", (F.col("rank") % blocks).alias("block")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", slots: int = SLOTS, block: int = BLOCK, finish: bool = False, row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of ``docs``; ``row``, too, if ``row_col`` is given.

    A slot counts ``block`` words, so a source whose last or only block is short ends below its target, or gets no
    slot at all. ``finish`` ends each source at its target, rounded: after its slots come the words that are missing,
    or the last slots are cut. Slots take a source's words in order, pass after pass, and so do the added words.

    A block has ``block`` words, or fewer so that the mix has ``slots`` slots. Words are those of the whole text; null
    has none and is not taken. A null source is a source of its own, the last. The order in a source is that of
    md5(id), so reruns agree; rows that repeat an id stand next to each other in it, by size, then content, a null id
    counts as "". It does not follow files or partitions. With no words at all every target is zero. An empty table gives an empty result; other columns are ignored.
    """
    scratch, own = Scratch(docs.sparkSession, "mix"), ["row"] if row_col else []
    sized = scratch.save(sizes(docs, id_col, source_col, text_col, row_col), "sizes")
    goals = scratch.save(targets(sized), "goals")
    total = (goals.agg(F.max("total")).first()[0] or 0)
    block = max(1, min(block, -(-total // slots)))
    taken = schedule(goals, -(-total // block), block)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # where a row's words begin in its source: sums of 4,096 ranges of the order, then within each range
    placed = sized.join(goals.select("source", "place", "source_size", "target"), sized.source.eqNullSafe(goals.source)).select("doc_id", sized.source, "size", "content", "row", "place", "source_size", "target", key.alias("key")).withColumn("range", F.substring("key", 1, 3))
    sums = placed.groupBy("place", "range").agg(F.sum("size").alias("n"))
    prior = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("place", "range").orderBy("key", "doc_id", "size", "content", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("within", within).join(sums.select("place", "range", prior.alias("prior")), ["place", "range"]).withColumn("begin", F.col("prior") + F.col("within")).drop("key", "range", "within", "prior")
    rows = scratch.save(rows, "rows")
    some = rows.where("size > 0").select("place", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    got = some.join(taken, ["place", "block"]).groupBy("place", "begin").agg(F.sum(overlap * F.col("times")).alias("taken"))
    filled = rows.where("size > 0").join(got, ["place", "begin"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    if finish:  # the slots' words of a source are the first so many of its words in order, pass after pass
        length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
        dealt = taken.join(goals.select("place", "source_size"), "place").groupBy("place").agg(F.sum(F.col("times") * length).alias("dealt"))
        upto = lambda n: F.expr(f"{n} div source_size") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.expr(f"{n} % source_size") - F.col("begin")))
        filled = filled.join(dealt, "place", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0))).withColumn("words", F.round("target").cast("bigint"))
        filled = filled.withColumn("taken", F.col("taken") + upto("words") - upto("dealt")).drop("dealt", "words")
    return filled.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))).select(*own, "doc_id", "source", "size", "source_size", "target", "taken")
