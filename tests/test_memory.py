from lodestone.operators import evaluation, graph, memory


def test_scene_cap(spark):
    groups = spark.createDataFrame([(g,) for g in "abcd"], "group string")
    known = spark.createDataFrame([("b", 5, 1.0), ("z", 1, 2.0)], "group string, heat long, mtime double")
    got = {r["group"]: (r["scene"], r["created"]) for r in memory.assign_scenes(groups, known, cap=3).collect()}
    assert got == {"a": ("a", True), "b": ("b", False), "c": ("z", False), "d": ("z", False)}


def test_beliefs(spark):
    rows = spark.createDataFrame([("t", "x", 0.6, 1), ("t", "y", 0.9, 2)], "title string, statement string, confidence double, ts long")
    r = memory.belief_trail(rows).first()
    assert r["statement"] == "y" and r["trail"][0]["before"] == "x" and abs(r["trail"][0]["delta"] - 0.3) < 1e-9


def test_remember(spark):
    rows = spark.createDataFrame([("error", "it broke", None, None, "[[A  b]]"), ("belief", "so", None, 3.0, None), ("odd", "x", None, None, None), ("fact", "...", None, None, None)], "type string, content string, status string, confidence double, case string")
    got = [(r["type"], r["status"], r["confidence"], r["case"]) for r in memory.remember(rows).collect()]
    assert got == [("error", "open", None, "A b"), ("belief", None, 1.0, None)]


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, 1, "price is 10", [1.0, 0.0]), (2, 2, "price is 12", [1.0, 0.0]), (3, 3, "do not go", [0.0, 1.0]), (4, 4, "do go", [0.0, 1.0])], "chunk_id long, doc_id long, text string, vec array<double>")
    assert [(r["a"], r["b"], r["kind"]) for r in memory.conflicts(rows).collect()] == [(1, 2, "number"), (3, 4, "negation")]


def test_expansion_cap(spark):
    fused = spark.createDataFrame([(1, 10, 1, 1.0), (1, 20, 2, 0.1)], "query_id long, chunk_id long, doc_id long, fused double")
    edges = spark.createDataFrame([(1, 2, "wiki", 1.0), (1, 3, "wiki", 1.0)], "src long, dst long, kind string, weight double")
    sims = spark.createDataFrame([(1, 20, 2, 0.9), (1, 30, 3, 0.5), (1, 31, 3, 0.1)], "query_id long, chunk_id long, doc_id long, sim double")
    lex = spark.createDataFrame([], "query_id long, chunk_id long, rank int")
    got = {r["chunk_id"]: r["fused"] for r in graph.expand(fused, edges, sims, lex).collect()}
    assert got[10] == 1.0 and 0.1 < got[20] <= 0.98 and got[30] > got[31] > 0


def test_token_f1(spark):
    rows = spark.createDataFrame([(1, "the red fox", "a red dog")], "id long, predicted string, gold string")
    assert evaluation.token_f1(rows).first()["f1"] == 0.5
