"""Exact deduplication by sorting contents (native: DataFrame operations only).

Rows are range-partitioned by (first characters, a hash, slice) with splitters that Spark samples,
sorted on disk where memory is short, and equal texts then lie next to each other: the window
operator compares each whole text with its neighbour's, and nothing else decides equality. The
hash only orders texts that start alike. A text that holds more than a partition's share of all
rows is cut into as many slices as it fills partitions (there are fewer such texts than
partitions); the heads of its slices, one row each, are compared by whole text once more.

Defined results: a null text counts as empty; rows with equal ids and equal texts are copies of
which exactly one stays; a null id loses against any other; texts of any length are compared
whole; an empty table gives no rows; ``drop_copies`` returns further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import column, materialize, shuffle_width

#: Leading characters in the range key: enough to order contents, and a bound on what is sampled.
PREFIX_CHARS = 16


def _order(text):
    """What orders texts that start alike; it need not tell them apart."""
    return F.xxhash64(text)


def _keyed(docs: DataFrame, text, more: list) -> DataFrame:
    """Rows with their range key: prefix, h, slice; ``slices`` is 1 unless a text is hot."""
    width, rows = shuffle_width(docs.sparkSession), docs.count()
    hot = docs.groupBy(_order(text).alias("h")).agg(F.count("*").alias("n")).where(F.col("n") * width > rows)
    hot = hot.select("h", F.ceil(F.col("n") * width / F.lit(max(1, rows))).cast("int").alias("slices"))
    # fewer rows than a shuffle has partitions
    hot = F.broadcast(materialize(hot, "hot_texts"))
    keyed = docs.select(*more, F.substring(text, 1, PREFIX_CHARS).alias("prefix"), _order(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    keyed = keyed.join(hot, "h", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    return keyed.withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))


def _sorting(keep: str):
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return F.asc_nulls_last if keep == "smallest" else F.desc_nulls_last


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest"; ``normalise`` maps the text column to what is compared
    (default: no change).
    """
    order = _sorting(keep)
    text = F.coalesce(column(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    placed = _keyed(docs, text, [column(id_col).alias("id"), text.alias("t")]).repartitionByRange("prefix", "h", "slice")
    run = Window.partitionBy("prefix", "t", "h", "slice")
    first, whole = run.orderBy(order("id"), "row"), run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = placed.select(
        "id", "slices", F.sha2("t", 256).alias("sha"),
        F.row_number().over(first).alias("rn"),
        F.count("*").over(whole).alias("n"),
        F.first("id").over(first).alias("best"),
        F.first("row").over(first).alias("run"),
        F.when(F.col("slices") > 1, F.col("t")).alias("t"),
    )
    # the text goes on with the heads of slices only
    rows = materialize(rows.withColumn("t", F.when(F.col("rn") == 1, F.col("t"))), "content_sort")
    heads = rows.where("rn = 1 and slices > 1").select("t", "best", "n", "run")
    again = Window.partitionBy("t")
    over = heads.select(
        "run",
        F.first("best").over(again.orderBy(order("best"), "run")).alias("keep"),
        F.first("run").over(again.orderBy(order("best"), "run")).alias("of"),
        F.sum("n").over(again).alias("total"),
    )
    # at most a few rows for each partition of a shuffle
    rows = rows.join(F.broadcast(materialize(over, "slices")), "run", "left")
    own = F.col("of").isNull() | (F.col("of") == F.col("run"))
    return rows.select(
        "id", F.when(F.col("of").isNull(), F.col("best")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"), ((F.col("rn") == 1) & own).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, which go through the sort once."""
    order = _sorting(keep)

    def text_of(text):
        return normalise(F.coalesce(text, F.lit(""))) if normalise else F.coalesce(text, F.lit(""))

    whole = F.struct(*[column(c) for c in docs.columns]).alias("doc")
    keyed = _keyed(docs, text_of(column(text_col)), [whole])
    text, best = text_of(F.col("doc")[text_col]), order(F.col("doc")[id_col])

    def heads(rows: DataFrame, *by) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(best, "row"))).where("rn = 1").drop("rn")

    cold = heads(keyed.where("slices = 1").repartitionByRange("prefix", "h"), "prefix", text, "h")
    hot = heads(keyed.where("slices > 1").repartitionByRange("prefix", "h", "slice"), "prefix", text, "h", "slice")
    return cold.unionByName(heads(hot, text)).select("doc.*")
