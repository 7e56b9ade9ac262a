"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a keyed hash and laid end to end; the
stream is cut in blocks of equal numbers of words.  Slot n of the mix gets the
point frac(n * golden ratio), which falls in one source's share of the cumulative
weights; the k-th slot of a source takes the source's k-th block, round the
stream at most twice.  The mix is what the slots take and nothing else: a
source's words differ from its target by as much as the points differ from an
even spread, a few blocks.  Everything here is DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import WORD, by_place, materialise, pick, spread_ranks

#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*" + WORD

#: 2^32 / golden ratio, to the nearest odd number: n * GOLDEN mod 2^32 are the points.
GOLDEN = 2654435769
#: Relative weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Words of a block at most; blocks are smaller where a source's target would have fewer than LEAST_BLOCKS of them,
#: as long as there are no more than SLOTS_PER_ROW slots a document (and FREE_SLOTS besides).
BLOCK_WORDS, LEAST_BLOCKS = 1024, 256
SLOTS_PER_ROW, FREE_SLOTS = 4, 1 << 16
#: Slots stay below 2^31, so that the points are exact in 64-bit numbers.
MOST_SLOTS = 1 << 31


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and text_hash of every document."""
    own = pick(docs, "doc_id", "source", "text")
    return own.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight, target: ``share`` of all words, dealt by weight.

    A target stops at ``most`` times its source's size; the excess is dealt
    again by weight until none is above.  That level is found in one pass:
    sources in rising order of cap by weight are full as long as the level that
    the rest would reach exceeds their own.  The frame has a row for a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    capped = by_source.withColumn("_i", place).withColumn("weight", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_i"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * F.lit(share) - before) / rest
    levelled = capped.withColumn("_level", level).withColumn("_open", F.col("_cap") / F.col("weight") > F.col("_level"))
    settled = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("weight")).alias("r"), F.col("_i").alias("i"), F.col("_level").alias("v")))).over(every)
    return levelled.withColumn("_v", settled["v"]).select(
        "source", "source_size", "weight", F.when(F.col("_v").isNull(), F.col("_cap")).otherwise(F.least(F.col("_v") * F.col("weight"), F.col("_cap"))).alias("target")
    )


def schedule(goals: DataFrame, slots: int, step: int = GOLDEN) -> DataFrame:
    """source, block, slot: the ``slots`` slots of the mix in order, each with the source its point falls to.

    block is the slot's rank among its source's slots: the block of the source's
    stream that it takes.  ``step`` is what a point is ahead of the one before, of 2^32.
    """
    spark = goals.sparkSession
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    shares = goals.where("target > 0").withColumn("_hi", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(whole))
    shares = shares.withColumn("_lo", F.coalesce(F.lag("_hi").over(order), F.lit(0.0)))
    cells = 4096
    cut = shares.select("source", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.floor(F.least(F.col("_hi"), F.lit(1.0)) * cells))).alias("_cell"))
    points = spark.range(slots).withColumn("_u", (F.col("id") * F.lit(step)) % F.lit(1 << 32) / F.lit(float(1 << 32))).withColumn("_cell", F.floor(F.col("_u") * cells))
    dealt = points.join(cut, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("source", F.col("id").alias("slot"))
    dealt = materialise(dealt)
    return spread_ranks(dealt, ["source"], ["slot"], F.lit(1), "block", F.col("slot").bitwiseAND(F.lit(~2047))).select("source", "block", "slot")


def block_words(goals: DataFrame, rows: int, most: int = BLOCK_WORDS) -> tuple[int, int]:
    """(words of a block, slots of the mix) for these targets and so many documents."""
    sums = goals.where("target > 0").agg(F.sum("target").alias("t"), F.min("target").alias("least")).first()
    wanted, least = float(sums["t"] or 0), float(sums["least"] or 0)
    slots = min(MOST_SLOTS - 1, FREE_SLOTS + SLOTS_PER_ROW * rows)
    block = max(1, min(most, int(least) // LEAST_BLOCKS), -(-int(wanted) // slots))
    return block, round(wanted / block)


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, block: int | None = None, seed: int = 9, step: int = GOLDEN) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule) of the mix of ``sizes`` (doc_id, source, size, and text_hash if there).

    documents: doc_id, source, size, source_size, target, copies (whole times
    taken), part (words of one more, incomplete time, from the text's start),
    taken = copies * size + part, first_slot (the first slot that takes of it;
    null if none does), n_slots (slots that take of it) and text_hash.  schedule:
    source, block, slot.  ``block`` is the number of words in a block, by default
    that of `block_words`.  A null source is a source of its own; empty documents
    take part with nothing; equal rows each count, and rows of one doc_id are
    told apart by size and text_hash.  Reruns agree, as the order depends on the
    rows' values and ``seed`` alone.
    """
    own = sizes if "text_hash" in sizes.columns else sizes.withColumn("text_hash", F.lit(0).cast("long"))
    kept = materialise(own.select("doc_id", "source", "size", "text_hash", F.xxhash64("doc_id", "text_hash", F.lit(seed)).alias("_h")))
    rows = kept.count()
    goals = materialise(targets(kept, weights, share, most))
    usual, _ = block_words(goals, rows)
    block = block or usual
    slots = round(float(goals.agg(F.sum("target")).first()[0] or 0) / block)
    plan = materialise(schedule(goals, slots, step))
    # What the slots reach of each source's stream.
    reached = plan.groupBy(F.col("source").alias("_rs")).agg((F.count("*") * block).alias("_reach"))
    known = goals.join(reached, F.col("source").eqNullSafe(F.col("_rs")), "left").select(
        F.col("source").alias("_gs"), "source_size", "target", F.least(F.coalesce("_reach", F.lit(0)), F.col("source_size") * most).alias("_end")
    )
    known = materialise(known)
    # Documents along their source's stream, some hundreds to a chunk of the hash's range.
    bits = min(24, max(4, (rows // 500).bit_length()))
    placed = spread_ranks(kept, ["source"], ["_h", "doc_id", "size", "text_hash"], F.col("size"), "_at", F.shiftright("_h", 64 - bits))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_gs"))).drop("_gs")
    times = [F.col("_at") + F.col("source_size") * e for e in range(most)]  # where a document begins, each time round
    ends = [F.least(t + F.col("size"), F.col("_end")) for t in times]
    taken = reduce(lambda a, b: a + b, [F.greatest(end - t, F.lit(0)) for t, end in zip(times, ends)])
    slots_of = [F.when(end > t, F.floor((end - 1) / block) - F.floor(t / block) + 1).otherwise(0) for t, end in zip(times, ends)]
    placed = placed.withColumn("taken", taken.cast("long")).withColumn("n_slots", reduce(lambda a, b: a + b, slots_of).cast("long"))
    # What nothing is taken of meets no block; such rows are spread over keys that there are not.
    placed = placed.withColumn("_block", F.when(F.col("taken") > 0, F.floor(F.col("_at") / block)).otherwise(-1 - F.pmod("_h", F.lit(1 << 20))))
    met = placed.join(plan.select(F.col("source").alias("_ps"), "block", F.col("slot").alias("first_slot")), F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_block") == F.col("block")), "left")
    out = met.withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("part", F.col("taken") - F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots", "copies", "part", "text_hash"), plan


def mixed_documents(docs: DataFrame, slot: str | None = None, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, in all its columns.

    A document that the mix takes in part comes once more, its text cut after
    the last word taken (and n_chars, if there, following it), so the rows hold
    ``taken`` words of each document, with all white space between them.  Null,
    empty and wordless texts hold nothing to take and do not come.  Repeated
    rows come as often as each is taken; other columns, whatever their names,
    pass through.  ``slot`` names a further column with the first slot that
    takes of the document.
    """
    out, _ = mix(sized(docs), **options)
    # Equal rows lie side by side in the stream: the first of them are taken once more than the others, the next in part.
    key, mark = F.coalesce("doc_id", F.lit(0)), F.xxhash64("text_hash", F.col("doc_id").isNull())
    use = out.groupBy(key.alias("_doc"), mark.alias("_hash")).agg(
        F.min("copies").alias("_low"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("_more"), F.max("part").alias("_part"), F.min("first_slot").alias("_slot")
    )
    use = use.where("_low + _more + _part > 0")
    placed, at, back = by_place(docs)
    text, own = at("text"), at("doc_id")
    placed = placed.where(text.rlike(WORD)).withColumn("_key", F.coalesce(own, F.lit(0))).withColumn("_th", F.xxhash64(F.xxhash64(text), own.isNull()))
    placed = placed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_th").orderBy(F.lit(1))))
    met = placed.join(use, (F.col("_key") == F.col("_doc")) & (F.col("_th") == F.col("_hash")))
    met = met.withColumn("_copies", F.col("_low") + F.when(F.col("_nth") <= F.col("_more"), 1).otherwise(0)).withColumn("_part", F.when(F.col("_nth") == F.col("_more") + 1, F.col("_part")).otherwise(F.lit(0)))
    times = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("_copies").cast("int")), F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(F.array().cast("array<bigint>")))
    each = met.withColumn("_cut", F.explode(times))
    start = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)), F.lit(1), F.col("_cut").cast("int")), "")
    each = each.withColumn("_text", F.when(F.col("_cut") > 0, start).otherwise(text))
    back[docs.columns.index("text")] = F.col("_text").alias("text")
    if "n_chars" in docs.columns:
        cut = F.when(F.col("_cut") > 0, F.length("_text")).cast(dict(docs.dtypes)["n_chars"])
        back[docs.columns.index("n_chars")] = F.coalesce(cut, at("n_chars")).alias("n_chars")
    return each.select(*back, *([F.col("_slot").alias(slot)] if slot else []))
