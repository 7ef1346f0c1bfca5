"""Every catalogued query against its SQL on the smallest tables."""

import duckdb
import pytest

from helpers import rows
from lodestone.plans import agents, catalog, vault  # noqa: F401
from lodestone.sources.tables import NAMES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), sql.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_inverted_lists_recall(spark):
    """The registered query itself, on its own query set, against exact search."""
    from pyspark.sql import functions as F

    from lodestone.operators import similarity

    folder = FOLDER.replace("0.001", "0.01")
    v = catalog._vectors(spark, folder)
    asked = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    exact = {tuple(r) for r in similarity.vector_topk(v, asked, 10).select("query_id", "chunk_id").collect()}
    near = {tuple(r) for r in catalog.QUERIES["ann_topk"](spark, folder).select("query_id", "chunk_id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_inverted_lists_recall_at_few_probes(spark):
    """Where vectors lie in clusters, a few lists of many hold nearly all neighbours."""
    import numpy as np
    from pyspark.sql import functions as F

    from lodestone.operators import similarity

    rng = np.random.default_rng(3)
    points = rng.normal(size=(100, 24))[np.arange(4000) % 100] + 0.25 * rng.normal(size=(4000, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, i, p) for i, p in enumerate(points.tolist())], "chunk_id long, doc_id long, vec array<double>")
    asked = v.where("chunk_id % 40 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    exact = {tuple(r) for r in similarity.vector_topk(v, asked, 10).select("query_id", "chunk_id").collect()}
    near = {tuple(r) for r in similarity.InvertedLists(v, lists=100).search(asked, 10, probes=5).select("query_id", "chunk_id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_stored_lists_are_pruned_and_reused(spark, tmp_path):
    """A tenth of the lists is read from their partitions alone, with recall 0.95; other vectors make other lists."""
    import numpy as np

    from lodestone.operators import similarity

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    points = centres[np.arange(1200) % 40] + 0.25 * rng.normal(size=(1200, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "chunk_id long, vec array<double>")
    folder = f"file://{tmp_path}/lists"
    lists = similarity.InvertedLists.of(v, folder, lists=40)
    asked = v.where("chunk_id % 60 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(r["query_id"], r["chunk_id"]) for r in similarity.vector_topk(v, asked, 10).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in lists.search(asked, 10, probes=4).collect()}
    assert len(found & exact) >= 0.95 * len(exact)
    _, rows = lists.probed(asked.where("query_id = 60"), 4)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and rows.select("list").distinct().count() == 4
    again = similarity.InvertedLists.of(v, folder, lists=40)
    assert again.place == lists.place
    other = similarity.InvertedLists.of(v.where("chunk_id <> 7"), folder, lists=40)
    assert other.place != lists.place and other.rows.count() == 1199


def test_blocks_apart_are_not_compared(spark):
    """The exact join equals all products, and blocks of far clusters never meet."""
    import numpy as np

    from lodestone.operators import similarity

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[np.arange(480) % 12] + 0.1 * rng.normal(size=(480, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1.5
    x[9] = 0
    rows = [(i, i % 5, v) for i, v in enumerate(x.tolist())]
    v = spark.createDataFrame(rows, "chunk_id long, doc_id long, vec array<double>")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(v, 0.95, block=20).collect()}
    scores = x @ x.T
    assert got == {(i, j) for i in range(480) for j in range(i + 1, 480) if scores[i, j] >= 0.95 and i % 5 != j % 5} and got
    held = similarity.ordered_blocks(v.selectExpr("chunk_id id", "doc_id grp", "vec v"), 20)
    blocks = held.select("b").distinct().count()
    assert similarity.block_pairs(held, 0.95).count() < 0.4 * blocks * (blocks + 1) / 2
    low = {(r["a"], r["b"]) for r in similarity.similar_pairs(v, -0.1, block=100).collect()}
    assert low == {(i, j) for i in range(480) for j in range(i + 1, 480) if scores[i, j] >= -0.1 and i % 5 != j % 5}
    assert similarity.similar_pairs(v.limit(0), 0.9).count() == 0
