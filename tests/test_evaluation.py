"""Running measures: equal to those of whole windows, however the stream is cut and merged."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstream.functions import evaluation, metrics
from emberstream.plans import queries as core
from emberstream.streaming import runner

SCHEMA = "ts timestamp, truth int, label int, score double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_against_sql(same):
    same(core.queries()["windowed_measures"], core.oracle_sql()["windowed_measures"])


def rows(n=600):
    rng = np.random.default_rng(7)
    truth, noise = rng.integers(0, 3, n), rng.integers(0, 4, n)
    label = np.where(noise == 0, rng.integers(-1, 3, n), truth)
    score = np.round(rng.normal(size=n) + (truth == 0), 1)  # ties
    return [(START + dt.timedelta(minutes=10 * int(i)), int(t), int(y), float(s)) for i, (t, y, s) in enumerate(zip(truth, label, score, strict=True))]


def test_windows_have_the_measures_of_their_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    one = {r["start"]: r for r in evaluation.measures(evaluation.cells(df, "ts", "1 day"), F.col("truth") == 0).collect()}
    parts = [df.where(F.minute("ts") % 20 == r) for r in (0, 10)]
    two = evaluation.merged(*(evaluation.cells(p.repartition(3), "ts", "1 day") for p in parts))
    two = {r["start"]: r for r in evaluation.measures(two, F.col("truth") == 0).collect()}
    assert len(one) == len(two) == 5
    for start, r in one.items():
        own = df.where((F.date_trunc("day", "ts") == F.lit(start)))
        assert r["n"] == own.count() and r["ari"] == pytest.approx(metrics.adjusted_rand_index(own, "truth", "label").first()[0])
        assert r["auc"] == pytest.approx(metrics.roc_auc(own, F.col("truth") == 0).first()[0])
        assert r["threshold"] == pytest.approx(metrics.three_sigma(own).first()[0])
        assert tuple(r)[1:] == pytest.approx(tuple(two[start])[1:])


def test_windows_of_one_class_or_without_scores(spark):
    odd = [(START, 1, 1, 0.5), (START, 1, 1, 0.7), (START + dt.timedelta(days=2), 0, 2, None), (START + dt.timedelta(days=2), 1, 2, None)]
    got = {r["n"]: r for r in evaluation.measures(evaluation.cells(spark.createDataFrame(odd[:2] + odd[2:] + odd[2:3], SCHEMA), "ts", "1 day"), F.col("truth") == 0).collect()}
    assert (got[2]["ari"], got[2]["auc"]) == (1.0, None) and (got[3]["auc"], got[3]["threshold"]) == (None, None)
    assert evaluation.measures(evaluation.cells(spark.createDataFrame([], SCHEMA), "ts", "1 day"), F.col("truth") == 0).count() == 0


def test_a_stream_that_is_cut_and_restarted_counts_every_row_once(spark, tmp_path):
    made = rows()
    for part in range(3):
        spark.createDataFrame(made[part * 200 : part * 200 + 200], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        runner.evaluate(stream, "ts", "1 day", "1 hour", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.schema("start timestamp, truth int, label int, score double, n bigint").parquet(f"{tmp_path}/out")
    want = evaluation.cells(spark.createDataFrame(made, SCHEMA), "ts", "1 day").where(F.col("start") < F.lit(START + dt.timedelta(days=4)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
