"""Chat exports, transcripts, compact context and scene bodies."""

import json


def test_exports_of_both_forms(spark, tmp_path):
    from lodestone.sources import chats

    message = lambda role, at, *parts: {"message": {"author": {"role": role}, "create_time": at, "content": {"parts": list(parts)}}}
    tree = [{"title": "Trip", "create_time": 1_700_000_000.0, "mapping": {"a": message("assistant", 2.0, "Go by train."), "b": message("user", 1.0, "How do I", "get there?"), "c": message("system", 0.0, "hidden"), "d": message("user", 3.0, " ")}}]
    flat = [{"name": "Tea", "created_at": "2024-02-03T10:00:00Z", "chat_messages": [{"sender": "human", "text": "green or black"}, {"sender": "assistant", "text": "green"}, {"sender": "human", "text": ""}]}]
    for name, data in (("tree", tree), ("flat", flat), ("bad", [{"x": 1}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    rows = chats.read_export(spark, f"{tmp_path}/tree.json").orderBy("position").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "How do I\nget there?"), ("assistant", "Go by train.")] and str(rows[0]["date"]) == "2023-11-14"
    messages = chats.read_export(spark, f"{tmp_path}/flat.json")
    notes = chats.conversation_notes(messages).collect()
    assert [(r["path"], r["raw"]) for r in notes] == [("chats/2024-02-03 Tea.md", "**user**: green or black\n\n**assistant**: green")]
    assert chats.conversation_notes(messages, existing=chats.conversation_notes(messages)).count() == 0
    try:
        chats.read_export(spark, f"{tmp_path}/bad.json")
        raise AssertionError("an unknown form was read")
    except ValueError:
        pass


def test_transcripts_and_sessions(spark, tmp_path):
    from lodestone.sources import chats

    lines = [{"message": {"role": "user", "content": "hello"}}, {"message": {"role": "tool", "content": "x"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "image"}]}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert chats.read_transcripts(spark, f"{tmp_path}/a.jsonl").first()["text"] == "user: hello\n\nassistant: hi"
    rows = [(None, "q", "old", 1.0), (None, "q", "new", 2.0), ("s", "q", "own", 1.0)]
    out = chats.session_versions(spark.createDataFrame(rows, "session_id string, first_user string, text string, ts double")).collect()
    assert sorted(r["text"] for r in out) == ["new", "own"]


def test_compact_context_keeps_text_order(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import context

    text = "First sentence here. Second one is longer. Third words follow. Fourth closes it all."
    hits = spark.createDataFrame([(1, 7, text)], "query_id long, chunk_id long, text string")
    scored = context.hit_sentences(hits).withColumn("score", F.when(F.col("position") == 3, 9.0).otherwise(F.col("position").cast("double")))
    assert context.compact(hits, scored, 2).first()["excerpt"] == "Third words follow. Fourth closes it all."


def test_scene_bodies_cap_their_sections(spark):
    from lodestone.operators import memory

    atoms = spark.createDataFrame([(i, "fact" if i % 2 else "decision", "g", f"t{i:02d}", float(i)) for i in range(40)], "doc_id long, type string, group string, text string, mtime double")
    body = memory.scene_bodies(atoms, spark.createDataFrame([("g", "s")], "group string, scene string")).first()["body"]
    parts = dict(p.split("\n", 1) for p in body.split("\n\n"))
    assert parts["## Facts"].split("\n") == [f"- t{i:02d}" for i in range(39, 16, -2)]
    assert parts["## Trail"] == "- 40 taken up"
    for day in range(10):
        known = spark.createDataFrame([("s", body)], "scene string, body string")
        body = memory.scene_bodies(atoms, spark.createDataFrame([("g", "s")], "group string, scene string"), known=known, day=f"day {day}").first()["body"]
    trail = body.split("## Trail\n")[1].split("\n")
    assert trail == [f"- day {day}: 40 taken up" for day in range(2, 10)]


def test_free_names_fill_gaps(spark):
    from lodestone.operators import states

    notes = spark.createDataFrame([("m/a.md", "x", "live", True, None, 1.0), ("m/a 3.md", "y", "live", True, None, 1.0)], states.SCHEMA)
    asked = spark.createDataFrame([("m/a", i) for i in range(3)], "at string, i int")
    got = [r["path"] for r in states.placed(asked, notes, "at", ["i"]).orderBy("i").collect()]
    assert got == ["m/a 2.md", "m/a 4.md", "m/a 5.md"]
    assert states.indexable(states.trash(notes, notes.select("path").limit(1))).count() == 1
