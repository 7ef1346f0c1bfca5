"""What the findings of round 4 found wrong."""


def test_inverted_lists_lose_nothing_among_near_copies(spark, monkeypatch):
    """More vectors lie closer together than their byte codes can tell apart than any list of candidates would hold."""
    import numpy as np

    from lodestone.operators import similarity

    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(3, 16)), 200, axis=0) + 0.003 * rng.normal(size=(600, 16)), rng.normal(size=(200, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, vec array<double>").repartition(3)
    asked = v.where("chunk_id % 50 = 0").selectExpr("chunk_id as query_id", "vec")
    lists = similarity.InvertedLists(v, lists=4)
    scores = np.round(x @ x.T, 9)
    want = {(q, i) for q in range(0, 800, 50) for i in sorted(range(800), key=lambda i: (-scores[q, i], i))[:10]}
    assert {(r["query_id"], r["chunk_id"]) for r in lists.search(asked, 10, probes=4).collect()} == want
    monkeypatch.setattr(similarity, "QUERY_BYTES", 0)
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 8 * 16 * 60)
    assert {(r["query_id"], r["chunk_id"]) for r in lists.search(asked, 10, probes=4).collect()} == want


def test_sums_are_rounded_as_in_sql(spark):
    import duckdb

    from pyspark.sql import functions as F

    from lodestone.functions import vector as vx

    values = [5.64195, 5.6419500000000005, -5.64195, 0.0, 0.00005, -0.00005, 9.99995, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(vx.rounded(F.col("x"), 4)).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchall()[0][0] for x in values]
    assert str(got) == str([x if x != 0 else abs(x) for x in want]) and got[0] == 5.6419


def test_whole_items_are_looked_up(spark, tmp_path):
    """The word that tells two documents apart is the last of thirty; SQL and code look it up in the queries that take whole items."""
    import duckdb
    import pytest

    from lodestone.functions import tokens as tk
    from lodestone.plans import catalog

    words = [f"word{chr(97 + i)}" for i in range(24)]
    long = " ".join([*words, "plum", "quince"])
    docs = [(i, " ".join([*words, "plum"][: 3 + i]) if i < 5 else f"quince other{i}" if i == 9 else f"filler{i} text", "en", f"src{i % 3}", 10) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, long), (1, "quince plum")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("bm25_topk", "bm25_and_or"):
        got = {(r["query_id"], r["doc_id"], r["rank"]): r["score"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        want = {(r[0], r[1], r[3]): r[2] for r in db.execute(catalog.ORACLES[name]).fetchall()}
        assert got == pytest.approx(want, abs=1e-6)
        assert any(q == 0 and doc == 9 for q, doc, _ in got) or name == "bm25_and_or"
    assert len(tk.asked(long, False)[0]) == 26 and len(tk.asked(long, False, whole=False)[0]) == tk.MOST_WORDS
    # Queries whose SQL takes the first words still do.
    assert "[1:16]" not in catalog.ORACLES["bm25_topk"] + catalog.ORACLES["bm25_and_or"] and "[1:16]" in catalog.ORACLES["bm25_after_edits"]


def test_one_long_text_takes_bounded_steps_of_messages(monkeypatch):
    """The graph of a single text may be of any size; what its messages take at once is bounded, with the same marginals."""
    import tracemalloc

    from lodestone.llm import pii

    model = pii.fit(["mail a.b@c.de or +49 170 1234567, call 1234567"] * 3)
    text = " ".join(str(1000 + i * 7919 % 9000) for i in range(40_000))
    found = pii.tokens(text, __import__("re").compile(pii.TOKEN).finditer)
    features = [pii.token_features(text, start, word) for start, _, word in found]
    chain, skip = pii.graph(found)
    tracemalloc.start()
    got = model.marginals(features, chain, skip)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * (len(chain) + len(skip))
    monkeypatch.setattr(pii, "MESSAGES", 1 << 30)
    assert (model.marginals(features, chain, skip) == got).all()
