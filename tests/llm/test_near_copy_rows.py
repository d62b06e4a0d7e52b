from emberstream.llm import shingle_join


def test_a_clean_text_of_a_repeated_id_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near, copy, clean = " ".join(words), " ".join([*words, "more"]), "a text of its own, near nothing else"
    rows = [(1, near, "a"), (5, copy, "gone"), (5, clean, "stays"), (5, None, "null"), (6, copy, "gone"), (6, near, "gone"), (None, copy, "no id")]
    kept = shingle_join.drop_near_copies(spark.createDataFrame(rows, "doc_id int, text string, _gone string"))
    assert kept.columns == ["doc_id", "text", "_gone"]
    assert sorted(r["_gone"] for r in kept.collect()) == ["a", "no id", "null", "stays"]
