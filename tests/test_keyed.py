"""Models in the state store: equal to the model of a whole stream, exactly once over restarts."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstream.operators.model import StreamClusterer
from emberstream.plans import queries as core
from emberstream.sources import points as sources
from emberstream.streaming import keyed

SCHEMA = "idx bigint, t double, features array<double>, key bigint"
OPTIONS = {"k": 20, "T": 300.0, "chi_min": 4, "e": 3}


@pytest.mark.parametrize("name", ["keyed_fit_predict", "keyed_buffer", "keyed_observers"])
def test_against_sql(same, name):
    same(core.queries()[name], core.oracle_sql()[name])


def blobs(spark, n=200):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(0, 0.1, (n // 2, 2)), rng.normal(3, 0.1, (n // 2, 2))])[rng.permutation(n)]
    return sources.from_arrays(spark, data, np.arange(n, dtype=float)).withColumn("key", F.when(F.col("idx") % 3 == 0, F.lit(None)).otherwise(F.col("idx") % 3))


class Stream:
    """A folder that is read as a stream of keyed points; every run is a new query."""

    def __init__(self, spark, place, **options):
        self.spark, self.place, self.options, self.parts = spark, str(place), OPTIONS | options, 0

    def feed(self, rows):
        rows.select("idx", "t", "features", "key").coalesce(1).write.parquet(f"{self.place}/in/{self.parts}")
        self.parts += 1
        return self.run()

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.place}/in")
        out = keyed.score_by_key(stream, "key", **self.options)
        out.writeStream.format("parquet").option("checkpointLocation", f"{self.place}/cp").trigger(availableNow=True).start(f"{self.place}/out").awaitTermination()
        return self

    def rows(self):
        return self.spark.read.schema("key bigint, grp bigint, idx bigint, label int, score double").parquet(f"{self.place}/out").orderBy("idx").collect()


def test_equal_to_the_model_of_each_keys_stream(spark, tmp_path):
    pts = blobs(spark)
    stream = Stream(spark, tmp_path, input_buffer=25)
    for a, b in ((0, 70), (71, 140), (141, 199)):
        stream.feed(pts.where(F.col("idx").between(a, b)).orderBy(F.col("idx").desc()))
    got = {r["idx"]: (r["grp"], r["label"], r["score"]) for r in stream.rows()}
    state = {(r["key"], r["oid"]): r for r in keyed.observers(spark, f"{tmp_path}/cp", 300.0).collect()}
    wait = {r["idx"] for r in keyed.waiting(spark, f"{tmp_path}/cp").collect()}
    for key in (None, 1, 2):
        own = [r["idx"] for r in pts.where(F.col("key").eqNullSafe(F.lit(key))).orderBy("idx").collect()]
        model, full = StreamClusterer(spark, **OPTIONS), len(own) // 25 * 25
        for g in range(full // 25):
            ids = own[g * 25 : g * 25 + 25]
            for r in model.fit_predict(pts.where(F.col("idx").isin(ids))).collect():
                grp, label, score = got.pop(r["idx"])
                assert (grp, label) == (g, r["label"]) and score == pytest.approx(r["score"])
        assert set(own[full:]) <= wait
        seen = {r["oid"]: r for r in model.get_observers(model.state.now).collect()}
        assert seen.keys() == {o for k, o in state if k == key}
        for oid, r in seen.items():
            assert (r["label"], r["observations"]) == (state[key, oid]["label"], pytest.approx(state[key, oid]["observations"]))
    assert not got and len(wait) == 200 - 3 * 50


def test_a_restart_in_mid_buffer_loses_and_repeats_nothing(spark, tmp_path):
    pts = blobs(spark, 120)
    whole = Stream(spark, tmp_path / "a", input_buffer=15).feed(pts).rows()
    parts = Stream(spark, tmp_path / "b", input_buffer=15)
    for a in range(0, 120, 30):
        parts.feed(pts.where(F.col("idx").between(a, a + 29))).run()  # and a start that finds nothing new
    rows = parts.rows()
    assert len({r["idx"] for r in rows}) == len(rows) and [tuple(r)[:4] for r in rows] == [tuple(r)[:4] for r in whole]
    at_first = {r["idx"] for r in keyed.waiting(spark, f"{tmp_path}/b/cp", batch=0).collect()}
    assert at_first == set(range(30))  # ten of each key


def test_a_timer_hands_out_the_rest(spark, tmp_path):
    blobs(spark, 54).select("idx", "t", "features", "key").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = keyed.score_by_key(stream, "key", input_buffer=15, wait_ms=1, **OPTIONS)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    try:
        rows, until = [], time.time() + 90
        while len(rows) < 54 and time.time() < until and query.isActive:
            time.sleep(1)
            if os.path.exists(f"{tmp_path}/out/_spark_metadata"):
                rows = spark.read.schema("key bigint, grp bigint, idx bigint, label int, score double").parquet(f"{tmp_path}/out").collect()
    finally:
        query.stop()
    assert sorted(r["idx"] for r in rows) == list(range(54))  # 18 of each key: a full group, and the rest
    assert {(r["grp"], sum(x["key"] == r["key"] and x["grp"] == r["grp"] for x in rows)) for r in rows} == {(0, 15), (1, 3)}


def test_odd_rows_leave_at_once_and_are_not_learned(spark, tmp_path):
    good = blobs(spark, 60).withColumn("key", F.lit(7).cast("bigint"))
    bad = spark.createDataFrame([(900, None, [1.0, 2.0], 7), (901, 5.0, None, 7), (902, 5.0, [1.0, float("nan")], 7), (903, 5.0, [1.0], 7), (904, 5.0, [None, 1.0], 7), (905, 1.0, [], 8)], SCHEMA)
    rows = {r["idx"]: r for r in Stream(spark, tmp_path, input_buffer=20).feed(good.unionByName(bad)).rows()}
    assert len(rows) == 66 and all((rows[i]["label"], rows[i]["score"], rows[i]["grp"]) == (-1, None, None) for i in range(900, 906))
    assert {rows[i]["grp"] for i in range(60)} == {0, 1, 2}


@pytest.mark.parametrize("name", ["ordered_fit_predict", "ordered_standing"])
def test_order_of_event_time_against_sql(same, name):
    same(core.queries()[name], core.oracle_sql()[name])


class Shuffled(Stream):
    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.place}/in")
        out = keyed.score_in_order(stream, "key", "20 seconds", **self.options)
        out.writeStream.format("parquet").option("checkpointLocation", f"{self.place}/cp").trigger(availableNow=True).start(f"{self.place}/out").awaitTermination()
        return self

    def rows(self):
        return self.spark.read.schema("key bigint, grp bigint, idx bigint, label int, score double, late boolean").parquet(f"{self.place}/out").orderBy("idx").collect()


def test_out_of_order_rows_are_learned_in_order(spark, tmp_path):
    pts = blobs(spark)
    ordered = {r["idx"]: tuple(r)[:5] for r in Stream(spark, tmp_path / "a", input_buffer=20).feed(pts).rows()}
    stream = Shuffled(spark, tmp_path / "b", input_buffer=20)
    for a in range(0, 200, 50):  # each row comes up to ten seconds out of order, over the ends of steps
        place = F.col("idx") + F.pmod(F.col("idx") * 7, F.lit(21)) - 10
        stream.feed(pts.where((place >= a if a else F.lit(True)) & (place < a + 50 if a < 150 else F.lit(True))).orderBy(F.rand(3)))
    rows = stream.rows()
    assert rows and not any(r["late"] for r in rows)
    for r in rows:
        assert tuple(r)[:4] == ordered[r["idx"]][:4] and r["score"] == pytest.approx(ordered[r["idx"]][4])
    held = [r["idx"] for t in (keyed.early, keyed.waiting) for r in t(spark, f"{tmp_path}/b/cp").collect()]
    assert sorted(held + [r["idx"] for r in rows]) == list(range(200))  # none vanishes
    assert {r["idx"] for r in keyed.early(spark, f"{tmp_path}/b/cp").collect()} == set(range(179, 200))


def test_late_rows_are_scored_counted_and_not_learned(spark, tmp_path):
    pts = blobs(spark).withColumn("key", F.lit(4).cast("bigint"))
    stream = Shuffled(spark, tmp_path, input_buffer=40)
    stream.feed(pts.where("idx < 150 AND idx % 30 <> 7"))
    odd = spark.createDataFrame([(900, None, [1.0, 2.0], 4), (901, float("nan"), [1.0, 2.0], 4), (902, 1e300, [1.0, 2.0], 4), (903, 199.0, [None, 1.0], 4), (904, 3.0, [1.0], 4)], SCHEMA)
    stream.feed(pts.where("idx >= 150 OR idx % 30 = 7").unionByName(odd))
    rows = {r["idx"]: r for r in stream.rows()}
    late = {i for i, r in rows.items() if r["late"]}
    assert late == {7, 37, 67, 97, 127, 904}
    assert all(rows[i]["grp"] is None and rows[i]["score"] is not None for i in late - {904})
    assert [(rows[i]["label"], rows[i]["score"], rows[i]["grp"]) for i in range(900, 905)] == [(-1, None, None)] * 5
    assert [(r["key"], r["late"]) for r in keyed.late(spark, f"{tmp_path}/cp").collect()] == [(4, 6)]
    learned = [i for i, r in rows.items() if r["grp"] is not None]
    assert sorted(learned) == [i for i in range(180) if i not in late][:160]
    assert not late & {r["oid"] for r in keyed.observers(spark, f"{tmp_path}/cp", 300.0).collect()}
