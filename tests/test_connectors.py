"""Connectors as data sources: batches, streams that go on where they stopped, and notes of their items."""


def feed():
    """A connector; a nested function, so workers need not import this module."""

    def pull(state):
        at = state.get("at", 0)
        items = [{"id": f"item {i}", "title": f"Title {i}", "body": f"Body {i}", "tags": ["#x", ""]} for i in range(at, min(at + 3, 7))]
        if at == 3:
            items.append({"id": "bad", "title": " ", "body": "no title"})
        return items, {"at": min(at + 3, 7)}

    return pull


def test_batch_items_become_notes(spark):
    from lodestone.sources import connectors

    items = spark.read.format(connectors.register(spark, "feed_batch", feed())).load()
    notes = {r["path"]: r["raw"] for r in connectors.as_notes(items, "feed").collect()}
    assert set(notes) == {f"imported/feed/item {i}.md" for i in range(3)}
    assert notes["imported/feed/item 0.md"] == '---\nsource: "connector:feed"\ntags: [connector, x]\n---\n\n# Title 0\n\nBody 0\n'
    odd = spark.createDataFrame([("a", "T", "B", "../up", None, None), ("b", None, "B", None, None, None)], connectors.SCHEMA)
    assert [r["path"] for r in connectors.as_notes(odd, "feed").collect()] == ["imported/feed/.. up/a.md"]
    assert connectors.report(odd).first().asDict() == {"written": 1, "skipped": 1}


def test_streams_keep_their_state(spark, tmp_path):
    from lodestone.sources import connectors

    name = connectors.register(spark, "feed_stream", feed())

    def run():
        stream = spark.readStream.format(name).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check")
        query = stream.option("path", f"{tmp_path}/out").trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(100):
                if query.awaitTermination(0.3):
                    break
                seen = spark.read.schema(connectors.SCHEMA).parquet(f"{tmp_path}/out").count() if any((tmp_path / "out").glob("*.parquet")) else 0
                if seen >= 8:
                    break
        finally:
            query.stop()

    run()
    first = spark.read.parquet(f"{tmp_path}/out")
    assert first.count() == 8 and first.select("id").distinct().count() == 8
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
