from emberstream.llm import near_vectors


def test_every_row_of_a_repeated_id_is_compared_and_returned(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 0), (2, b, 0), (5, a, 0), (5, b, 0), (5, b, None), (5, b, 0), (7, b, 0), (None, a, 0), (None, None, None)]
    out = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    got = sorted(tuple(r) for r in out.where("id is not null").collect())
    # 2, 5 (b, two equal rows) and 7 link; 1 links with 5 (a); 5 without a label is alone
    assert got == [(1, 1, 1, True), (2, 2, 2, True), (5, 0, 5, True), (5, 1, 1, False), (5, 2, 2, False), (5, 2, 2, False), (7, 2, 2, False)]
    assert [tuple(r) for r in out.where("id is null").collect()] == [(None, 0, None, True)] * 2


def test_vectors_of_one_id_do_not_link(spark):
    rows = [(3, [1.0, 0.0], 0), (3, [1.0, 0.01], 0)]
    out = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert [tuple(r) for r in out.collect()] == [(3, 0, 3, True)] * 2


def test_components_beyond_the_range_of_squares(spark):
    rows = [(i, 1, [x * s for x in (1.0, 2.0, -3.0)]) for i, s in enumerate((1e200, 1e-200, 1.0, 5e-310))]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(3, 0)}
