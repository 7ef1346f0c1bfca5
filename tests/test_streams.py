"""Streams: the event ring after every batch, restarts, and a watched folder."""

import pytest


def test_ring_of_a_stream(spark, tmp_path):
    """After each portion the ring is that of all events so far, also over a restart."""
    from lodestone.streaming import sync

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "event_id long, kind string"
    store = sync.Snapshots(spark, f"file://{tmp_path}/store")
    try:
        for n, ids in enumerate([range(0, 40, 2), range(1, 40, 2), [100, 5, 5]]):
            spark.createDataFrame([(i, f"k{i % 3}") for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            sync.write_ring(stream, store, f"{tmp_path}/checkpoint", size=10).awaitTermination(300)
            seen = spark.read.parquet(f"{tmp_path}/in").distinct()
            want = sorted(map(tuple, sync.ring(seen, 10).collect()))
            assert sorted(map(tuple, store.read("ring").collect())) == want, n
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_mentions_on_boundaries(spark):
    from lodestone.operators import graph

    titles = ["Harbour plan", "C++ notes", "회의록 정리본", "größe", "a\\Eb cd", "data"]
    bodies = ["the harbour plan, and harbour plans", "C++ notes!", "어제 회의록 정리본을 봤다", "die größe; größenwahn", "xa\\Eb cd and a\\Eb cd.", "a database of data_x", "nothing"]
    rows = [(i, titles[i] if i < len(titles) else f"other {i}", b) for i, b in enumerate(bodies)]
    notes = spark.createDataFrame([(i + 10, f"reader number {i}", b) for i, _, b in rows], "doc_id long, title string, body string")
    names = spark.createDataFrame([(t.lower(), i) for i, t in enumerate(titles)], "name string, doc_id long")
    got = {(r["src"], r["dst"]) for r in graph.mention_edges(notes, names=names).collect()}
    assert got == {(10, 0), (11, 1), (12, 2), (14, 4)} | ({(13, 3)} if len("größe") >= 6 else set())


def test_a_watched_vault(spark, tmp_path, monkeypatch):
    """Changes are indexed when they are still, deletions too; a step killed between index and state is repeated without harm."""
    from lodestone.engine import Engine

    root, clock = tmp_path / "v", [1000.0]
    root.mkdir()
    (root / "a.md").write_text("The harbour.")
    (root / "b [x].md").write_text("The pier.")
    e = Engine(spark, f"file://{root}", f"file://{tmp_path}/s", clock=lambda: clock[0])
    assert e.watch_step(0) is None and e._snapshots.read("notes") is None
    clock[0] += 3
    assert e.watch_step(1)["added"] == 2 and e.watch_step(1) is None
    (root / "a.md").write_text("The orchard now.")
    (root / "b [x].md").unlink()
    clock[0] += 1
    assert e.watch_step(2)["removed"] == 1
    clock[0] += 3
    write, calls = e._snapshots.write, []

    def killed(tables, *a, **b):
        if "watch" in tables:
            raise KeyboardInterrupt
        calls.append(tables)
        return write(tables, *a, **b)

    monkeypatch.setattr(e._snapshots, "write", killed)
    with pytest.raises(KeyboardInterrupt):
        e.watch_step(3)
    monkeypatch.setattr(e._snapshots, "write", write)
    again = Engine(spark, f"file://{root}", f"file://{tmp_path}/s", clock=lambda: clock[0])
    versions = len(again._snapshots.versions())
    assert again.watch_step(3) is None and len(again._snapshots.versions()) == versions + 1 and len(calls) == 1
    assert [tuple(r) for r in again.table("notes").select("path", "body").collect()] == [("a.md", "The orchard now.")]
    frame = spark.createDataFrame([(1, "orchard"), (2, "pier")], "query_id long, text string")
    assert [r["path"] for r in again.search(frame, mode="bm25").collect()] == ["a.md"]
