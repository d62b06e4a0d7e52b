"""Structured Streaming: micro-batches through one model.

``run`` feeds every micro-batch to a model (sample, fit, update, predict) and appends the scores.
The model after a batch, with the rows that wait in its input buffer, is saved beside them, so that a
batch that is replayed, after a restart too, starts from the model before it, learns once and
overwrites its own output with the same rows. ``keyed`` has a model for each key.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evaluation import cells
from ..operators.model import StreamClusterer
from ..plans.scratch import remove
from ..sources.points import is_valid


def run(stream: DataFrame, model: StreamClusterer, out: str, checkpoint: str, available_now: bool = True):
    """Scores (idx, label, score) of a stream of points to Parquet folders batch=<id> below ``out``.

    A row for each row: those with a null or non-finite number, or of another dimension than the
    model (without one: than the batch's first row), get label -1 and no score. Models of the last
    two batches are kept.
    """
    before, after = (copy.deepcopy(model.state), list(model._waiting), model._waiting_rows), [-1]  # of the first batch; the last batch that was learned

    def step(batch: DataFrame, number: int) -> None:
        if number == 0:
            model.state, model._waiting, model._waiting_rows = copy.deepcopy(before[0]), list(before[1]), before[2]
        elif after[0] != number - 1:
            model.load(f"{checkpoint}/model/{number - 1}")
        rows = batch.persist()
        try:
            wide = model.state.data.shape[1] if model.observer_count() else None
            if wide is None:
                wide = rows.where(is_valid()).agg(F.min_by(F.size("features"), F.struct("t", "idx"))).first()[0]
            good = is_valid(wide)
            known = rows.where(good)
            scored = model.predict(known) if known.isEmpty() else model.fit_predict(known)
            others = rows.where(~good).select("idx", F.lit(-1).alias("label"), F.lit(None).cast("double").alias("score"))
            scored.unionByName(others).write.mode("overwrite").parquet(f"{out}/batch={number}")
            model.save(f"{checkpoint}/model/{number}")
            if number > 1:
                remove(batch.sparkSession, f"{checkpoint}/model/{number - 2}")
            after[0] = number
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def buffered(points: DataFrame, size: int) -> DataFrame:
    """Rows with the number of the buffer of ``size`` rows they fall into, by their index."""
    return points.withColumn("buffer", F.floor(F.col("idx") / F.lit(max(1, size))).cast("bigint"))


def evaluate(scored: DataFrame, ts: str, width: str, delay: str, out: str, checkpoint: str, available_now: bool = True):
    """Counts of a stream (``ts``, truth, label, score) for each event-time window, appended to ``out``
    when the watermark, ``delay`` behind the newest row, has passed the window; ``evaluation.measures``
    reads them. State is a window's cells, until it is closed."""
    counts = cells(scored.withWatermark(ts, delay), ts, width)
    writer = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)
