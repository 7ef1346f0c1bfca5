"""Verdicts of the quality rules in groups and languages of few texts."""

import numpy as np


def test_small_groups_get_verdicts(spark):
    from lodestone.llm import outliers

    rng = np.random.default_rng(2)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, size=rng.integers(3, 8))) for _ in range(400)]
    text = lambda junk: " ".join((w + "###" if junk else w) for w in rng.choice(vocabulary, 60))
    #: A large source, a small one of its language, and a language of few texts; each has one text of junk.
    places = [("en", "large")] * 120 + [("en", "small")] * 10 + [("de", "large")] * 12 + [(None, None)] * 3
    junk = {0, 120, 130, 142}
    rows = [(i, text(i in junk), *place) for i, place in enumerate(places)] + [(900, None, "fr", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(docs).collect()}
    assert got == {i: i not in junk for i in range(len(places))} | {900: False}
    few = docs.where("lang = 'de'")
    assert all(r["d2"] is not None for r in outliers.judge(few).collect())
    assert {r["doc_id"] for r in outliers.judge(few).where("not kept").collect()} == {130}
