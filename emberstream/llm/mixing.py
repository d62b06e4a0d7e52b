"""Mixing sources to target weights by weighted fair queueing (native: DataFrame operations only).

Every source is a queue of its documents in a shuffled but repeatable order (by a digest of the
id), repeated up to ``max_epochs`` times. A document's virtual finish time is the words of its
source up to and with it, divided by the source's target. All instances are ordered by finish
time and taken until the next would exceed the budget.

Both prefix sums have levels, so that no source and no order lands in one task: words within a
source are summed per bucket of the digest and then over at most ``16 ** 3`` buckets; the global
order is summed per slot of the finish time, the slot that crosses the budget once more per slot
of its own, and only the slot of a slot that crosses is sorted. Finish times rise along a queue,
so what is taken of a source in an epoch is all up to one last document: these few marks (sources
times epochs) are all that meets the documents again, and no text is ever shuffled. The rule is
the same for every size of table.

Defined results: a null text has no words; a null source is a source of its own, last in order;
a source whose target is 0 gives nothing; rows with equal ids are separate documents, those with
equal texts too are taken together or not at all; an empty table gives no rows; of further
columns, whatever their names, ``apply_mix`` returns all and ``mix`` none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import column, materialize

#: What a word is: a run of anything but blank, tab and line ends.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the digest that name a bucket of a source, and slots in one unit of finish time.
BUCKET_DIGITS, SLOTS = 3, 4096


def source_targets(sources: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """From (source, source_size): rank, target. Weights repeat in the order of the sources.

    A target is at most ``max_epochs`` times the source; what is above is shared again by weight
    until none is above. Sorted by size over weight, the sources that reach their cap are a
    prefix, and the common level of the others is the greatest over all prefixes.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sources.withColumn("rank", rank).withColumn("w", weight)
    by_cap = Window.orderBy(F.lit(float(max_epochs)) * F.col("source_size") / F.col("w"), "rank")
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("before", F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("level", F.max((F.lit(budget) * F.col("total") - F.lit(float(max_epochs)) * F.col("before")) / F.col("rest")).over(everything))
    target = F.least(F.lit(float(max_epochs)) * F.col("source_size"), F.col("level") * F.col("w"))
    return s.select("source", "source_size", "rank", target.alias("target"), "total")


def _crossing(epochs: DataFrame, slot, before: DataFrame | None, limit) -> DataFrame:
    """The instances of the slot in which the budget is crossed, with the words ``before`` it."""
    placed = epochs.withColumn("slot", slot)
    slots = placed.groupBy("slot").agg(F.sum("size").alias("words"), F.max("total").alias("total"))
    # at most 4 * SLOTS + 1 rows: one row each, whatever the table's size
    start = F.lit(0)
    if before is not None:
        slots, start = slots.crossJoin(F.broadcast(before)), F.col("before")
    slots = slots.withColumn("upto", F.sum("words").over(Window.orderBy("slot")) + start)
    first = slots.where(F.col("upto") > limit).agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
    first = materialize(first.select("c.*").where("slot is not null"), "crossing")  # one row; none if all fits
    return placed.drop("before").join(F.broadcast(first), "slot")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: str = "", carry: bool = False) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken; with ``carry`` instead
    ``row``, a struct of the document's own columns, and copies."""
    kind = F.coalesce(F.concat(F.lit("s"), column(source_col).cast("string")), F.lit("n"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(column(id_col).cast("string"), F.lit(""))))
    # a document's place in its queue
    place = F.struct(digest.alias("u"), column(id_col).alias("i"), F.xxhash64(F.coalesce(column(text_col), F.lit(""))).alias("h")).alias("place")
    size = F.coalesce(F.regexp_count(column(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    narrow = materialize(docs.select(column(id_col).alias("id"), column(source_col).alias("source"), kind.alias("kind"), place, F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"), size), "sizes")
    sums = materialize(narrow.groupBy("kind", "bucket").agg(F.min("source").alias("source"), F.sum("size").alias("words")), "bucket_sums")
    sources = sums.groupBy("kind").agg(F.min("source").alias("source"), F.sum("words").alias("source_size"))
    targets = materialize(source_targets(sources.select("source", "source_size"), weights, budget, max_epochs).withColumn("kind", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))).drop("source"), "targets")
    before = F.sum("words").over(Window.partitionBy("kind").orderBy("bucket")) - F.col("words")
    offsets = materialize(sums.select("kind", "bucket", before.alias("offset")).join(targets, "kind"), "offsets")
    run = F.sum("size").over(Window.partitionBy("kind", "bucket").orderBy("place"))  # equal places together
    line = narrow.where("size > 0").select("kind", "bucket", "place", "size", run.alias("run")).join(offsets, ["kind", "bucket"])
    line = materialize(line.select("kind", "place", "size", "source_size", "target", "rank", "total", (F.col("run") + F.col("offset")).alias("upto")).where("target > 0"), "queues")

    def instance(epoch: int):
        finish = (F.col("upto") + F.lit(epoch) * F.col("source_size")) / F.col("target")
        return F.struct(finish.alias("f"), F.col("rank").alias("r"), F.lit(epoch).alias("e"), F.col("place").alias("p"))

    epochs = line.select("size", "total", F.explode(F.array(*[instance(e) for e in range(max_epochs)])).alias("key"))
    limit = F.lit(budget) * F.col("total")
    slot = F.least(F.floor(F.col("key.f") * SLOTS), F.lit(4 * SLOTS))
    inside = materialize(_crossing(epochs, slot, None, limit), "crossing_slot")
    part = F.greatest(F.lit(0), F.least(F.floor((F.col("key.f") * SLOTS - F.col("slot")) * SLOTS), F.lit(SLOTS)))
    inside = _crossing(inside, part, inside.select("before").limit(1), limit)
    reached = F.sum("size").over(Window.orderBy("key")) + F.col("before")
    last = inside.withColumn("reached", reached).where(F.col("reached") > limit).agg(F.min("key").alias("first_out"))
    last = materialize(last, "cut")  # one row; null if all fits
    taken = line.crossJoin(F.broadcast(last))
    marks = [F.max(F.when(F.col("first_out").isNull() | (instance(e) < F.col("first_out")), F.col("place"))).alias(f"last_{e}") for e in range(max_epochs)]
    marks = materialize(targets.select("kind", "source_size", "target").join(taken.groupBy("kind").agg(*marks), "kind", "left"), "marks")
    # a row for each source, which Spark broadcasts while it is below its own threshold
    copies = sum((F.when(F.col("place") <= F.col(f"last_{e}"), 1).otherwise(0) for e in range(max_epochs)), F.lit(0)).alias("copies")
    if carry:
        return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), kind.alias("kind"), place).join(marks, "kind").select("row", copies)
    return narrow.join(marks, "kind").select("id", "size", "source_size", "target", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    rows = mix(docs, carry=True, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
