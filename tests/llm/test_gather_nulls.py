from emberstream.llm import shingle_join


def test_a_null_id_leaves_the_keys_of_segments_whole():
    key = (1 << 62) + 1
    batches = [shingle_join._out([None, key], [4, 10], [3, shingle_join.SEGMENT]), shingle_join._out([key], [12], [shingle_join.SEGMENT])]
    rows = [tuple(r.values()) for b in shingle_join._gather(batches) for r in b.drop_columns(['s']).to_pylist()]
    assert sorted(r for r in rows if r[2] == shingle_join.SEGMENT) == [(10, 10, -1), (10, 12, -1)]
    assert [r for r in rows if r[2] == 3] == [(None, 4, 3)]
