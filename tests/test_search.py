"""Whole searches over a small vault, and the façade end to end."""

import pytest


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from lodestone.engine import Engine

    root = tmp_path_factory.mktemp("vault")
    notes = {
        "people/Ann Lee.md": "---\ntags: [person]\n---\nAnn Lee leads the harbour project and likes green tea.",
        "projects/Harbour.md": "---\ntags: [project]\ndate: 2023-11-10\n---\nThe harbour project rebuilds the pier. See [[Ann Lee]].\n\n## Budget\nThe budget is 40000 crowns.",
        "projects/Orchard.md": "---\ntags: [project]\ndate: 2023-01-02\n---\nThe orchard project plants apple trees near the river.",
        "daily/2023-11-13.md": "Walked along the pier and wrote about lighthouses.",
        "private/Secret.md": "---\nlodestone: false\n---\nHidden harbour words.",
    }
    for path, text in notes.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    e = Engine(spark, f"file://{root}", f"file://{tmp_path_factory.mktemp('store')}", clock=lambda: 1_700_000_000.0)
    assert e.index() == {"added": 4, "updated": 0, "removed": 0, "unchanged": 0}
    e.root = root
    return e


def ask(spark, engine, text, **more):
    rows = engine.search(spark.createDataFrame([(1, text)], "query_id long, text string"), **more).orderBy("rank").collect()
    return [r["path"] for r in rows]


def test_words_title_and_typos(spark, engine):
    assert ask(spark, engine, "orchard apple trees")[0] == "projects/Orchard.md"
    assert ask(spark, engine, "Ann Lee")[0] == "people/Ann Lee.md"
    assert ask(spark, engine, "orchrad", mode="fast")[0] == "projects/Orchard.md"
    assert "private/Secret.md" not in ask(spark, engine, "hidden harbour words")


def test_scopes_are_complete_and_bare_scopes_list(spark, engine):
    assert set(ask(spark, engine, "tag:project pier", mode="bm25")) == {"projects/Harbour.md"}
    assert ask(spark, engine, "folder:projects") == ["projects/Harbour.md", "projects/Orchard.md"]
    assert ask(spark, engine, "folder:projects after:2023-06") == ["projects/Harbour.md"]
    assert ask(spark, engine, "tag:nothing pier") == []


def test_default_scope_and_scope_all(spark, engine):
    from lodestone.operators.search import Settings

    engine.settings = Settings(default_scope="folder:people")
    assert set(ask(spark, engine, "harbour project", mode="fast")) == {"people/Ann Lee.md"}
    assert "projects/Harbour.md" in ask(spark, engine, "scope:all harbour project", mode="fast")
    engine.settings = Settings()


def test_time_windows_bring_their_own_notes(spark, engine):
    assert "daily/2023-11-13.md" in ask(spark, engine, "what happened yesterday")


def test_reranking_slots(spark, engine):
    from pyspark.sql import functions as F

    best = lambda rows: rows.select("query_id", "chunk_id", F.when(F.contains("passage", F.lit("apple")), 10.0).otherwise(0.0).alias("score"))
    assert ask(spark, engine, "the project of the harbour", reorder=best)[0] == "projects/Orchard.md"
    broken = lambda rows: rows.select("query_id", "chunk_id", F.lit(None).cast("double").alias("score"))
    assert ask(spark, engine, "the project of the harbour", rerank=broken) == ask(spark, engine, "the project of the harbour")


def test_incremental_index_and_model_switch(spark, engine):
    assert engine.index()["unchanged"] == 4 and len(engine._snapshots.versions()) == 1
    (engine.root / "projects/Orchard.md").write_text("---\ntags: [project]\n---\nThe orchard project plants pear trees.")
    assert engine.index()["updated"] == 1
    assert ask(spark, engine, "pear trees")[0] == "projects/Orchard.md"
    assert not engine.reindex_if_model_changed()
    engine.model = "other"
    assert engine.reindex_if_model_changed() and not engine.reindex_if_model_changed()


def hits(engine, frame, **more):
    return [tuple(r) for r in engine.search(frame, k=8, **more).select("query_id", "path", "rank", "fused").orderBy("query_id", "rank").collect()]


def test_segments_equal_a_full_build(spark, tmp_path, monkeypatch):
    """After edits, new notes and deletions every search gives what an index built anew gives, and only a segment was written."""
    from lodestone.engine import Engine
    from lodestone.operators.search import SearchIndex

    root = tmp_path / "vault"
    root.mkdir()
    words = "harbour pier lighthouse orchard apple tea café größe well-known walking walked 3.14".split()
    for i in range(12):
        (root / f"n{i}.md").write_text(f"Note {i} " + " ".join(words[(i * 5 + j) % len(words)] for j in range(3 + i)))
    one = Engine(spark, f"file://{root}", f"file://{tmp_path}/a", clock=lambda: 1.7e9)
    one.index()
    (root / "n3.md").write_text("A cafe by the pier, well known, and well-known at that.")
    (root / "n5.md").unlink()
    (root / "new.md").write_text("Lighthouses and orchards; pi is 3.14 here.")
    assert one.index() == {"added": 1, "updated": 1, "removed": 1, "unchanged": 10}
    (root / "n3.md").write_text("Apples, apples and one more apple.")
    one.index()
    index = one._index()
    assert [s["n"] for s in index.note["segments"]] == [12, 2, 1] and sum(m["n"] for m in index.note["minus"]) == 3
    two = Engine(spark, f"file://{root}", f"file://{tmp_path}/b", clock=lambda: 1.7e9)
    two.index()
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(["cafe", "größe", "well-known", "apple pier", "walk", "3.14", "the lighthouse of the orchard", "n5"])], "query_id long, text string")
    assert hits(one, frame) == hits(two, frame) and hits(one, frame, mode="bm25") == hits(two, frame, mode="bm25")
    other = two._index()
    assert (index.n, round(index.mean_len, 9)) == (other.n, round(other.mean_len, 9))
    assert sorted(map(tuple, index.frequencies.select("term", "df").collect())) == sorted(map(tuple, other.frequencies.select("term", "df").collect()))
    assert sorted(map(tuple, index.lexicon.select("term", "n").collect())) == sorted(map(tuple, other.lexicon.select("term", "n").collect()))
    # More segments than are allowed become one.
    (root / "n1.md").write_text("A version of an orchard.")
    with monkeypatch.context() as m:
        m.setattr(SearchIndex, "MOST_SEGMENTS", 3)
        one.index()
    assert [s["n"] for s in one._index().note["segments"]] == [12]
    two.index()
    assert hits(one, frame, mode="bm25") == hits(two, frame, mode="bm25")


def test_phrases_marks_and_stems(spark, engine):
    (engine.root / "daily/2023-11-15.md").write_text("The Café was well-known for pi, 3.14, and walking.")
    (engine.root / "daily/2023-11-16.md").write_text("It is known to all who fare well that 14 is not 3.")
    engine.index()
    assert ask(spark, engine, "cafe", mode="bm25") == ["daily/2023-11-15.md"]
    assert ask(spark, engine, "well-known", mode="bm25") == ["daily/2023-11-15.md"]
    assert ask(spark, engine, "3.14", mode="bm25") == ["daily/2023-11-15.md"]
    assert set(ask(spark, engine, "walked", mode="bm25")) == {"daily/2023-11-13.md", "daily/2023-11-15.md"}


def test_backup_and_restore(spark, engine, tmp_path):
    """A restored store searches its own notes, whatever was indexed there before."""
    from lodestone.engine import Engine

    there = f"file://{tmp_path}/copy"
    assert engine.backup(there) == 1
    (tmp_path / "v").mkdir()
    (tmp_path / "v/old.md").write_text("An old harbour note that goes.")
    for used in (False, True):
        other = Engine(spark, f"file://{tmp_path}/v", f"file://{tmp_path}/new{used}", clock=engine.clock)
        if used:
            other.index()
        other.restore(there)
        assert other.table("notes").count() == engine.table("notes").count()
        assert ask(spark, other, "harbour project") == ask(spark, engine, "harbour project")


def test_two_writers_get_two_versions(spark, tmp_path):
    from lodestone.streaming.sync import Snapshots

    one, two = (Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    assert (one.reserve(), two.reserve(), one.reserve()) == (1, 2, 3) and one.versions() == []


def test_memory_notes_outlive_an_index(spark, engine):
    rows = spark.createDataFrame([("fact", "The pier opens in May", "Pier"), ("fact", "It closes in June", "Pier"), ("rumour", "left out", "X")], "type string, content string, title string")
    rows = rows.selectExpr("*", "cast(null as string) status", "cast(null as double) confidence", "cast(null as string) case")
    engine.remember(rows)
    assert [r["path"] for r in engine.memory_notes().collect()] == ["memories/Pier 2.md", "memories/Pier.md"]
    (engine.root / "daily/2023-11-14.md").write_text("A new day.")
    assert engine.index()["added"] == 1 and engine.memory_notes().count() == 2
    asked = spark.createDataFrame([("memories/Pier.md",), ("nowhere.md",)], "path string")
    assert {r["path"]: r["outcome"] for r in engine.change("trash", asked).collect()} == {"memories/Pier.md": "done", "nowhere.md": "missing"}
    assert [r["original"] for r in engine.memory_notes("trash").collect()] == ["memories/Pier.md"]
    engine.change("restore", spark.createDataFrame([(".trash/Pier.md",)], "path string"))
    assert engine.memory_notes().count() == 2 and engine.memory_notes("trash").count() == 0
    block = engine.context().first()["block"]
    assert f"{engine.table('notes').count()} notes" in block and "## Recent notes" in block and engine.repair_prompt() == "Nothing has drifted."


def test_recorded_hits_reach_the_boot_context(spark, engine):
    found = engine.search(spark.createDataFrame([(1, "orchard"), (2, "pear trees")], "query_id long, text string"), mode="bm25", k=1)
    found = engine._snapshots.staged(found)
    engine.record_hits(found)
    engine.record_hits(found)
    assert sorted(r["hits"] for r in engine.hits().collect()) == [4]
    assert "Orchard, 4 times" in engine.context().first()["block"]


def test_consolidation_moves_its_cursor(spark, engine):
    (engine.root / "memories").mkdir(exist_ok=True)
    for i, (kind, topic) in enumerate([("preference", "tea"), ("fact", "tea"), ("decision", "pier")]):
        (engine.root / f"memories/m{i}.md").write_text(f"---\ntype: {kind}\ntopic: {topic}\n---\nAtom number {i}.")
    engine.index()
    old, engine.clock = engine.clock, lambda: 4e9
    assert engine.consolidate() == 3 and engine.consolidate() == 0
    scenes = {r["title"]: (r["heat"], r["body"]) for r in engine._snapshots.read("scenes").collect()}
    assert scenes["tea"][0] == 2 and "## Preferences" in scenes["tea"][1] and scenes["pier"][0] == 1
    assert engine._snapshots.read("persona").first()["persona"] == "Atom number 0."
    assert "## Scenes" in engine.context().first()["block"]
    # A second run replaces the sections and adds a line to the trail.
    assert scenes["tea"][1].endswith("## Trail\n- 2096-10-02: 2 taken up")
    (engine.root / "memories/m9.md").write_text("---\ntype: fact\ntopic: tea\n---\nAtom number 9.")
    engine.index()
    assert engine.consolidate(force=True) == 1
    tea = {r["title"]: r["body"] for r in engine._snapshots.read("scenes").collect()}["tea"]
    assert "Atom number 9." in tea and tea.endswith("## Trail\n- 2096-10-02: 2 taken up\n- 2096-10-02: 1 taken up")
    engine.clock = old


def test_blocked_vector_search_equals_the_direct_one(spark, monkeypatch):
    import numpy as np

    from lodestone.operators import similarity

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    v = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    q = v.where("chunk_id < 50").withColumnRenamed("chunk_id", "query_id")
    direct = {tuple(r) for r in similarity.vector_topk(v, q, 5).collect()}
    monkeypatch.setattr(similarity, "QUERY_BYTES", 0)
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 8 * 8 * 16)
    assert {tuple(r) for r in similarity.vector_topk(v, q, 5).collect()} == direct


def test_pairs_from_lists_are_true_and_most(spark):
    import numpy as np

    from lodestone.operators import similarity

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    points = centres[np.arange(400) % 20] + 0.15 * rng.normal(size=(400, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, i, p) for i, p in enumerate(points.tolist())]
    v = spark.createDataFrame(rows, "chunk_id long, doc_id long, vec array<double>")
    exact = {(r["a"], r["b"]) for r in similarity.similar_pairs(v, 0.9).collect()}
    near = {(r["a"], r["b"]) for r in similarity.similar_pairs(v, 0.9, index=similarity.InvertedLists(v, lists=20), probes=3).collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact) > 100
