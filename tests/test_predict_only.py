from emberstream.plans import queries
from emberstream.sources import points as sources


def test_every_point_is_scored(spark, small):
    want = sources.valid(sources.from_lineitem(spark, small), 4).select("idx")
    got = queries.predict_only(spark, small).select("idx")
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()
