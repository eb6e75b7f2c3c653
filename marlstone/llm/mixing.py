"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a target stops
at ``MOST`` times its source's words and the excess is reshared by weight (water filling, solved in closed form).

Blocks: the documents of a source stand in the order of a hash of their ids (a fixed shuffle) on a line of words, which is
cut into blocks of equal numbers of words. Positions on the line are prefix sums in two levels: within ranges of the hash, whose
number follows the source's rows, and over the ranges. So a source with a third of all rows is spread over many tasks.

Schedule: slot k of the mix maps the golden-ratio point frac(k * phi) through the cumulative targets to a source; the r-th
slot of a source takes its r-th block, starting again after the last. Sources whose slots fall short of their target by the
sequence's discrepancy get their last slots after the others; the last slot of a source is cut so that its words meet the target. Slots meet the pieces of
documents in their blocks in a join; these rows are the mix, and what is taken of a document is their sum.

Null texts have no words. Repeated rows are documents of their own. Without words nothing is taken and targets are 0; an empty table gives no rows. A very long text lies in many blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Words of a block, at most; small corpora get smaller ones.
BLOCK_WORDS = 8192
#: Rows of one hash range of a source, on average.
RANGE_ROWS = 2_000
#: Hexadecimal digits of the hash that ranges are cut by.
DIGITS = 5
#: Slots that are ranked at once.
RANK_SLOTS = 1024
#: Parts that a source's rows are dealt to when they meet their source's target.
SALTS = 32
#: Cells of [0, 1) by which slots meet the cumulative targets.
CELLS = 4096
PHI = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, n_rows, source_size, weight, target. ``sized`` has source and size."""
    by_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    place = (F.row_number().over(order) - 1) % len(weights)
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("cap", most * F.col("source_size"))
    filled = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    full = filled.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everyone)
    left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    #: Water level if exactly the sources before this one are full.
    level = (F.lit(share) * total - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / left
    ranked = ranked.withColumn("level", level)
    over = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everyone)["level"]
    return ranked.withColumn("over", over).select("source", "n_rows", "source_size", "weight", F.when(F.col("over").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("over") * F.col("weight"))).alias("target"))


def _schedule(plan: DataFrame, slots: int) -> DataFrame:
    """slot, key, turn: golden-ratio points mapped through the cumulative targets, ranked per source in two levels."""
    spark = plan.sparkSession
    line = W.orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    share = plan.where("turns > 0").select("key", "turns", (F.sum("turns").over(line) / slots).alias("hi"), ((F.sum("turns").over(line) - F.col("turns")) / slots).alias("lo"))
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    k = F.col("id")
    points = spark.range(slots).select(k.alias("slot"), ((k + 1) * PHI - F.floor((k + 1) * PHI)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(cells, "cell").where("u >= lo AND u < hi").select("slot", "key", "turns", F.floor(F.col("slot") / RANK_SLOTS).alias("run"))
    counts = drawn.groupBy("key", "run").count()
    before = counts.select("key", "run", (F.sum("count").over(W.partitionBy("key").orderBy("run")) - F.col("count")).alias("before"))
    rank = F.row_number().over(W.partitionBy("key", "run").orderBy("slot")) - 1
    ranked = drawn.withColumn("rank", rank).join(before, ["key", "run"]).withColumn("turn", F.col("rank") + F.col("before")).where("turn < turns")
    short = plan.where("turns > 0").join(counts.groupBy("key").agg(F.sum("count").alias("n")), "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < turns")
    late = short.select("key", F.explode(F.sequence("n", F.col("turns") - 1)).alias("turn")).select((F.col("turn") + slots).alias("slot"), "key", "turn")
    return ranked.select("slot", "key", "turn").unionByName(late)


@dataclass(frozen=True)
class Mix:
    """A mix: ``documents`` has id, size, source_size, target, taken, first_slot and last_slot of each document (null if nothing is taken); ``schedule`` has slot, source, turn,
    block and words; ``pieces`` has slot, id, first_word and end_word, the words of a document that a slot takes, and their place on the source's line. In the order of slot and place they are the mix itself."""

    documents: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each document, and the schedule; see ``Mix``."""
    found = scheduled_mix(docs, **options)
    return found.documents, found.schedule


def scheduled_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> Mix:
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), n_words(docs[text_col]).alias("size"))
    hashed = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    rows = materialize(rows.withColumn("hash", hashed).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    plan = materialize(targets(rows), "mix-targets")  # one row per source
    total = int(plan.agg(F.sum(F.floor("target"))).first()[0] or 0)
    block = min(block_words, max(64, total >> 14))

    # a key stands for the source, null included; turns: slots that meet the target, the last one cut
    key = lambda c: F.concat(F.when(F.col(c).isNull(), "1").otherwise("0"), F.coalesce(F.col(c), F.lit("")))
    size, words = F.greatest("source_size", F.lit(1)), F.floor("target")
    rest = words - F.floor(words / size) * size
    plan = (
        plan.withColumns({"key": key("source"), "ranges": F.ceil(F.col("n_rows") / RANGE_ROWS), "blocks": F.ceil(size / block), "rest": rest})
        .withColumn("turns", F.floor(words / size) * F.col("blocks") + F.ceil(F.col("rest") / block))
        .withColumn("cut", F.when(F.col("rest") > 0, F.col("rest") - (F.ceil(F.col("rest") / block) - 1) * block).otherwise(0))
    )
    slots = int(plan.agg(F.sum("turns")).first()[0] or 0)

    # places on the source's line of words; salted, since a source may hold a third of the rows
    salted = plan.select("key", "source_size", "target", "ranges", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    part = F.floor(F.conv(F.substring("hash", 1, DIGITS), 16, 10).cast("long") * F.col("ranges") / 16**DIGITS)
    line = rows.withColumns({"key": key("source"), "salt": (F.col("row") % SALTS).cast("int")}).join(salted, ["key", "salt"]).withColumn("part", part)
    sums = line.groupBy("key", "part").agg(F.sum("size").alias("words"))
    before = sums.select("key", "part", (F.sum("words").over(W.partitionBy("key").orderBy("part")) - F.col("words")).alias("before"))
    inner = W.partitionBy("key", "part").orderBy("hash", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumn("upto", F.sum("size").over(inner)).join(before, ["key", "part"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))

    schedule = _schedule(plan, slots).join(plan.select("key", "source", "source_size", "blocks", "turns", "cut"), "key").withColumn("block", F.col("turn") % F.col("blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    last = (F.col("turn") == F.col("turns") - 1) & (F.col("cut") > 0)
    schedule = schedule.withColumn("words", F.when(last, F.col("cut")).otherwise(length))

    # every slot joins the pieces of its block
    end = F.col("start") + F.greatest("size", F.lit(1)) - 1
    pieces = line.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(end / block))))
    low = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
    high = F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block, F.coalesce("words", F.lit(0)))
    joined = pieces.join(schedule.select("key", "block", "slot", "words"), ["key", "block"], "left").withColumns({"low": low, "took": F.greatest(F.lit(0), high - low)})
    slot = F.when(F.col("took") > 0, F.col("slot"))
    mixed = joined.groupBy("row").agg(*(F.first(c).alias(c) for c in ("id", "size", "source_size", "target")), F.sum("took").alias("taken"), F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"))
    columns = (F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot", "last_slot")
    first = F.col("block") * block + F.col("low") - F.col("start")
    placed = joined.where("took > 0").select("slot", F.col("id").alias(id_col), first.alias("first_word"), (first + F.col("took")).alias("end_word"), (F.col("start") + first).alias("place"))
    return Mix(mixed.select(*columns), schedule.select("slot", "source", "turn", "block", "words"), placed)
