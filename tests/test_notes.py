import random

from lodestone.engine import Engine
from lodestone.sources import notes

VAULT = {
    "Project Atlas.md": "---\ntags: [work, atlas]\naliases: [Atlas]\ndate: 2026-03-02\n---\n# Goals\nShip the beta by May. See [[Kim Jisoo]].\n\n## Budget\nThe budget is 1,200 euros.",
    "people/Kim Jisoo.md": "Leads the search team.\n\n#people",
    "work/Meeting.md": "We discussed Project Atlas and its release with everyone.",
    "log.md": "- fixed the parser #dev\n- wrote tests\n[[Nowhere]]",
}


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_parse():
    front, tags, links, body = notes.parse(VAULT["Project Atlas.md"])
    assert front["aliases"] == ["Atlas"] and tags == ["atlas", "work"] and links == ["Kim Jisoo"] and body.startswith("# Goals")
    assert notes.parse("---\njust a line\n---\ntext")[3].startswith("---")


def test_chunks_are_bounded_and_whole():
    draw = random.Random(4)
    pieces = ["# Head\n", "## Sub\n", "word " * 40, "\n\n", "- item\n", "x" * 700, "**a**: hello there 7\n\n", "```\ncode\n```\n", "한글 문장입니다. "]
    for _ in range(60):
        body = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 30)))
        for _, text, _ in notes.chunk(body):
            assert text.strip() and len(text) <= 1.8 * notes.CHUNK + notes.OVERLAP


def test_bursts():
    paras = ["나: 안녕", "아리: 응", "아리: 내일 3시에 만나자", "나: 좋아, 그럼 서울역 앞에서 기다리고 있을게 꼭 와"]
    assert notes.is_chat(paras)
    assert notes.bursts(paras)[0].startswith("나: 안녕\n아리: 응")


def test_engine(spark, tmp_path):
    write(tmp_path / "vault", VAULT)
    engine = Engine(spark, str(tmp_path / "vault"), str(tmp_path / "store"), clock=lambda: 0)
    assert engine.index() == {"added": 4, "updated": 0, "removed": 0, "unchanged": 0}
    links = {(r["kind"], r["weight"]) for r in engine.table("links").collect()}
    assert links == {("wiki", 1.0), ("mention", 0.85)}
    asked = spark.createDataFrame([(1, "budget euros"), (2, "tag:people search team")], "query_id long, text string")
    hits = {r["query_id"]: r["path"] for r in engine.search(asked).where("rank = 0").collect()}
    assert hits == {1: "Project Atlas.md", 2: "people/Kim Jisoo.md"}
    assert "1,200" in engine.ask(asked.where("query_id = 1")).first()["prompt"]
    assert [r["detail"] for r in engine.drift().where("kind = 'broken_link'").collect()] == ["Nowhere"]
    assert engine.link_suggestions().count() == 1
    (tmp_path / "vault/log.md").write_text("- changed")
    (tmp_path / "vault/work/Meeting.md").unlink()
    assert engine.index_plan().first().asDict() == {"added": 0, "updated": 1, "removed": 1, "unchanged": 2}
    assert engine.index()["updated"] == 1
    assert engine.status()["notes"] == 3


def test_watch_equals_batch(spark, tmp_path):
    from lodestone.streaming import sync

    write(tmp_path / "vault", VAULT)
    seen = []
    stream = sync.watch(spark, str(tmp_path / "vault"), str(tmp_path / "cp"), lambda df, _: seen.extend(r["path"] for r in df.select("path").collect()), every=None)
    stream.awaitTermination(60)
    assert len(seen) == len(VAULT)
