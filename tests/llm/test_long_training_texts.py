import random

import numpy as np
import pyarrow as pa

from emberstream.llm import langid, toxicity

WORDS = {"xx": ["the", "and", "of", "thing"], "yy": ["der", "und", "schön", "nicht"], "zz": ["qui", "vous", "être", "où"]}


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(4)
    size = {"xx": 60, "yy": 60, "zz": 2000}
    # a long text starts with signs that no language has
    rows = [(i, "= " * 2500 * (k == "zz") + " ".join(rng.choice(WORDS[k]) for _ in range(size[k])), k) for i, k in enumerate(list(WORDS) * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), held_out_fold=None)
    assert model.languages == ["xx", "yy", "zz"]
    best, _ = model.predict(pa.array([" ".join(w * 5) for w in WORDS.values()]))
    assert list(best) == [0, 1, 2]


def test_long_labelled_texts_are_trained_on(spark):
    rng = random.Random(5)
    plain = [f"{a}{b}{c}" for a in ("ba", "do", "ri") for b in ("lu", "ne", "ka") for c in ("so", "mi")]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) for _ in range(40)]
    texts += ["\n".join(rng.choice(plain) + rng.choice([",", "?", ' "x" (y)[z];']) for _ in range(6000)) + ("WRETCHED" if i % 2 else "") for i in range(20)]
    y = [int(i >= 40 and i % 2) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, held_out_fold=None)
    assert ((model.score(pa.array(texts)) >= toxicity.THRESHOLD) == np.array(y)).all()
