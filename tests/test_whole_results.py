"""Catalogued queries that have to return all there is."""

from itertools import combinations

import duckdb

from lodestone.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_every_pair_that_shares_an_order_is_an_edge(spark):
    orders = {}
    for order, part in duckdb.sql(f"SELECT DISTINCT l_orderkey, l_partkey FROM '{FOLDER}/lineitem.parquet'").fetchall():
        orders.setdefault(order, []).append(part)
    want = {pair for parts in orders.values() for pair in combinations(sorted(parts), 2)}
    assert {(r["src"], r["dst"]) for r in catalog.QUERIES["co_mention_edges_all"](spark, FOLDER).collect()} == want


def test_recall_of_ann_topk_as_registered(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import similarity

    folder = "/root/testdata/sf0.1"
    assert catalog.ANN_PROBES < 16
    v = catalog._vectors(spark, folder)
    asked = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    exact = {tuple(r) for r in similarity.vector_topk(v, asked, 10).select("query_id", "chunk_id").collect()}
    near = {tuple(r) for r in catalog.QUERIES["ann_topk"](spark, folder).select("query_id", "chunk_id").collect()}
    print("recall", len(exact & near), "of", len(exact))
    assert len(exact & near) >= 0.9 * len(exact)


def test_running_totals_over_slices(spark):
    """One group that holds all rows is cut into slices, and sums run on across them; also with nulls and other groups."""
    from pyspark.sql import functions as F

    from lodestone.operators import context

    rows = [("a", i, i % 7) for i in range(500)] + [(None, i, 3) for i in range(20)] + [("b", 1, None), ("b", 2, 5)]
    frame = spark.createDataFrame(rows, "g string, i int, n int").repartition(5)
    out = context.running_total(frame, ["g"], ["i"], "n", slices=9)
    got = sorted((str(r["g"]), r["i"], r["used"]) for r in out.collect())
    want, sums = [], {}
    for g, i, n in rows:
        sums[g] = sums.get(g) if n is None else (sums.get(g) or 0) + n
        want.append((str(g), i, sums[g]))
    assert got == sorted(want, key=lambda r: r[:2]) and out.columns == ["g", "i", "n", "used"]
    assert context.within_budget(frame, "g", "i", "n", 30).where(F.col("g") == "a").count() == sum(1 for w in want if w[0] == "a" and w[2] <= 30)
