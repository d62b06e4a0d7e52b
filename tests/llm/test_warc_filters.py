"""Which payloads are written as responses, by filters of ids and digests."""

import pytest
from pyspark.sql import functions as F

from emberstream.llm import warc


def tables(spark):
    rows = [(i, f"payload {i % 60} " + "x" * 120) for i in range(200)] + [(None, "payload 7 " + "x" * 120), (3, None), (250, ""), (251, "")]
    rows = spark.createDataFrame(rows, "id bigint, body string").withColumn("sha", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256))
    gone = rows.where("id >= 60 and id < 240 or id is null").select("id", "sha").distinct()
    return rows, rows.select("id", "sha"), gone


@pytest.mark.parametrize("words", [1, 4, 1 << 20])
def test_what_stays_does_not_depend_on_the_filters(spark, monkeypatch, words):
    monkeypatch.setattr(warc, "WORDS", words)
    rows, narrow, gone = tables(spark)
    kept = sorted(r["id"] for r in warc.without(rows, narrow, gone).collect())
    assert kept == sorted([*range(60), 3, 250, 251])


def test_no_payload_is_shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.without(*tables(spark))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_nothing_gone_and_nothing_there(spark):
    rows, narrow, gone = tables(spark)
    assert warc.without(rows, narrow, gone.limit(0)).count() == rows.count()
    assert warc.without(rows.limit(0), narrow.limit(0), gone.limit(0)).count() == 0
