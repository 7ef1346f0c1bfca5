"""What an agent reads and says around a search: boot context, anchors, reflections, repair prompts, further phrasings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import context, filters

EPISODE_PARTS = ("Summary", "Decisions", "Solved", "Next steps", "Notes")


def field(name: str) -> Column:
    """The first value of a frontmatter key, lower case."""
    return F.lower(F.trim(F.try_element_at(F.try_element_at("frontmatter", F.lit(name)), F.lit(1))))


def anchored(notes: DataFrame, k: int = 12) -> DataFrame:
    """The pinned notes (anchor: true, yes or 1), newest first."""
    rows = notes.where(F.coalesce(field("anchor").isin("true", "yes", "1"), F.lit(False)))
    return rows.orderBy(F.desc("mtime"), "doc_id").limit(k).select("doc_id", "path", "title", F.coalesce(field("type"), F.lit("")).alias("type"), F.coalesce(field("case"), F.lit("")).alias("case"))


def with_anchor(notes: DataFrame, ids: DataFrame, on: bool = True) -> DataFrame:
    """Notes in which the anchor of the given doc_ids is set or cleared."""
    marked = notes.join(ids.select("doc_id", F.lit(True).alias("_hit")).distinct(), "doc_id", "left")
    others = F.map_filter("frontmatter", lambda k, v: k != "anchor")
    flag = F.create_map(F.lit("anchor"), F.array(F.lit("true")))
    new = F.map_concat(others, flag) if on else others
    return marked.withColumn("frontmatter", F.when(F.col("_hit"), new).otherwise(F.col("frontmatter"))).select(*notes.columns)


def _bullets(items: Column, wrap: tuple[str, str] = ("", "")) -> Column:
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit(f"- {wrap[0]}"), s, F.lit(wrap[1]))), "\n")


def reflect(sessions: DataFrame, now: Column | float) -> DataFrame:
    """title, content of an episode per session (summary, decisions, solved, next_steps, notes, case); sessions without a summary are left out."""
    case = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("case", F.lit("")), r"[\[\]]", ""), r"\s+", " "))
    stamp = F.date_format(F.timestamp_seconds(F.lit(now) if isinstance(now, float) else now), "yyyy-MM-dd HH:mm")
    bodies = [F.trim("summary"), _bullets(F.col("decisions")), _bullets(F.col("solved")), _bullets(F.col("next_steps")), _bullets(F.col("notes"), ("[[", "]]"))]
    parts = [F.when(body != "", F.concat(F.lit(f"## {name}\n\n"), body)) for name, body in zip(EPISODE_PARTS, bodies, strict=True)]
    title = F.concat(F.lit("Session "), stamp, F.when(case != "", F.concat(F.lit(" · "), case)).otherwise(F.lit("")))
    rows = sessions.where(F.coalesce(F.trim("summary"), F.lit("")) != "")
    return rows.select(title.alias("title"), F.concat_ws("\n\n", *parts).alias("content"), F.lit("episode").alias("type"), case.alias("case"), F.lit("memories/sessions").alias("folder"))


def scene_index(scenes: DataFrame, k: int = 10) -> DataFrame:
    """Scenes (path, title, heat, mtime, summary), the hottest first, then the newest."""
    return scenes.orderBy(F.desc("heat"), F.desc("mtime"), "path").limit(k)


def list_skills(notes: DataFrame, folder: str = "skills") -> DataFrame:
    """path, name, case of the notes in the skill folder that are marked as skills, by name."""
    rows = notes.where(F.col("path").startswith(f"{folder}/") & F.coalesce(~field("skill").isin("", "false", "no"), F.lit(False)))
    return rows.select("path", F.col("title").alias("name"), F.coalesce(field("skill_case"), F.lit("")).alias("case")).orderBy("name", "path")


def repair_prompt(findings: DataFrame, notes: DataFrame, vault: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """One row, prompt: what drifted (kind, doc_id, detail) as instructions, by kind and note; a sentence if nothing did.

    The prompt is null where a kind that is `needed` has no finding.
    """
    heads = {"broken_link": "Links to notes that do not exist", "missing_file": "Links to files that do not exist", "duplicate": "Memories still flagged as possible duplicates"}
    rows = findings.join(notes.select("doc_id", "path"), "doc_id")
    line = F.concat(F.lit("- in `"), "path", F.lit("`: "), "detail")
    out = rows.agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, line))), "\n").alias(kind) for kind in heads))
    parts = [F.when(F.col(kind) != "", F.concat(F.lit(f"## {head}\n"), F.col(kind))) for kind, head in heads.items()]
    body = F.concat_ws("\n\n", *parts)
    opening = F.lit(f"The vault at {vault} has drifted. Repair only what is listed and touch nothing else.\n\n")
    told = F.when(body == "", F.lit("Nothing has drifted.")).otherwise(F.concat(opening, body))
    for kind in needed:
        told = F.when(F.col(kind) != "", told)
    return out.select(told.alias("prompt"))


def context_block(sections: list[tuple[str, DataFrame]], chars: int = 2400) -> DataFrame:
    """One row, block: sections (heading, table of ord and line) in the order given, empty ones left out, cut at `chars`.

    A line is two characters at least, so no more than `chars` lines of a section are read.
    """
    rows = None
    for at, (heading, lines) in enumerate(sections):
        part = lines.select(F.lit(at).alias("at"), F.lit(heading).alias("heading"), F.col("ord").cast("long").alias("ord"), "line").orderBy("ord").limit(chars)
        rows = part if rows is None else rows.unionByName(part)
    by = rows.groupBy("at", "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    texts = by.select("at", F.when(F.col("heading") == "", F.col("text")).otherwise(F.concat(F.lit("## "), "heading", F.lit("\n"), "text")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n")
    return texts.agg(F.left(joined, F.lit(chars)).alias("block"))


def boot_sections(notes: DataFrame, edges: DataFrame, hits: DataFrame, scenes: DataFrame, cases: DataFrame, persona: DataFrame, now: float) -> list[tuple[str, DataFrame]]:
    """The nine sections of the boot context: counts, persona, scenes, anchors, cases, recent, referenced, hubs, tags."""
    from lodestone.operators import graph

    number = lambda df, *order: df.withColumn("ord", F.row_number().over(Window.orderBy(*order)))  # noqa: E731 - a few rows each
    named = notes.select("doc_id", "title", "path")
    say = lambda *parts: F.concat(F.lit("- "), *parts)
    counted = context.counts({"notes": notes, "links": edges}).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["name"])), ", ").alias("line"))
    recent = filters.recent(notes, now, 14, 8)
    hot = hits.join(named, "doc_id").orderBy(F.desc("hits"), "doc_id").limit(6)
    hubs = graph.degrees(edges).join(named, "doc_id").orderBy(F.desc("degree"), "doc_id").limit(6)
    tags = notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(12)
    tag_line = number(tags, F.desc("n"), "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("#"), "tag", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"]), ", ").alias("line"))
    return [
        ("", counted.withColumn("ord", F.lit(1))),
        ("Persona", persona.select(F.col("persona").alias("line"), F.lit(1).alias("ord")).where("line <> ''")),
        ("Scenes", number(scene_index(scenes, 8), F.desc("heat"), F.desc("mtime"), "path").withColumn("line", say("title", F.lit(" ("), "path", F.lit(") heat "), F.col("heat").cast("string")))),
        ("Anchors", number(anchored(notes, 8).join(notes.select("doc_id", "mtime"), "doc_id"), F.desc("mtime"), "doc_id").withColumn("line", say("title", F.lit(" ("), "path", F.lit(")")))),
        ("Open cases", number(cases.where("open_errors > 0").orderBy(F.desc("last_touched"), "case").limit(5), F.desc("last_touched"), "case").withColumn("line", say(F.col("case"), F.lit(", open "), F.col("open_errors").cast("string")))),
        ("Recent notes", number(recent, F.desc("doc_date"), "doc_id").withColumn("line", say(F.date_format(F.timestamp_seconds("doc_date"), "yyyy-MM-dd"), F.lit(" "), "title"))),
        ("Often referenced", number(hot, F.desc("hits"), "doc_id").withColumn("line", say("title", F.lit(", "), F.col("hits").cast("string"), F.lit(" times")))),
        ("Hubs", number(hubs, F.desc("degree"), "doc_id").withColumn("line", say("title", F.lit(", "), F.col("degree").cast("string"), F.lit(" links")))),
        ("Tags", tag_line.withColumn("ord", F.lit(1)).where("line <> ''")),
    ]


# Verbs that ask for something to be kept, the word of request behind the Korean ones, and particles
# between what is to be kept and the verb, the longest first.
KEEP_VERBS, KEEP_PLEASE, KEEP_LATIN = ("기억해", "저장해", "메모해"), "줘", "remember"
KEEP_PARTICLES = ("이라고", "라고", "고", "을", "를")


def _without(text: Column, ends, front: bool) -> Column:
    """A text without the first of `ends` that it begins (or ends) with, and the white space there; null if there is none."""
    out = F.lit(None).cast("string")
    for end in reversed(ends):
        rest = F.expr("''") if not end else (F.substring(text, F.lit(len(end) + 1), F.length(text)) if front else F.left(text, F.length(text) - len(end)))
        out = F.when(text.startswith(end) if front else text.endswith(end), F.btrim(rest, F.lit(" \t\r\n"))).otherwise(out)
    return out


def remember_intent(said: Column) -> Column:
    """What a chat turn asks to keep: what follows a leading verb (four characters), or what precedes a closing one (eight); else null."""
    own = lambda text, ends, front: tx.let(text, lambda t: F.coalesce(_without(t, ends, front), t))
    strip = lambda text: F.btrim(text, F.lit(" \t\r\n"))

    def kept(text: Column) -> Column:
        latin = F.when(F.lower(text).startswith(KEEP_LATIN), strip(F.substring(text, F.lit(len(KEEP_LATIN) + 1), F.length(text))))
        behind = own(F.coalesce(own(_without(text, KEEP_VERBS, True), (KEEP_PLEASE,), True), latin), (":", ","), True)
        closed = own(F.when(text.endswith("."), F.left(text, F.length(text) - 1)).otherwise(text), (KEEP_PLEASE,), False)
        before = own(tx.let(closed, lambda t: _without(t, KEEP_VERBS, False)), KEEP_PARTICLES, False)
        return F.coalesce(tx.let(behind, lambda t: F.when(F.length(t) >= 4, t)), tx.let(before, lambda t: F.when(F.length(t) >= 8, t)))

    return tx.let(strip(said), kept)


def chat_turns(turns: DataFrame, hits: DataFrame, boot: DataFrame | None = None, history: int = 6, chars: int = 1600) -> DataFrame:
    """conv_id, turn, question, system, history for user turns: blocks of hits (query_id = turn's id), and the boot block before any answer.

    `turns` has query_id, conv_id, turn, role, text; the last six turns before go along.
    """
    blocks = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n").alias("notes"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-history, -1)
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumns({"history": F.collect_list(F.struct("role", "text")).over(before), "answered": F.coalesce(F.max(F.col("role") == "assistant").over(earlier), F.lit(False))})
    rows = rows.where("role = 'user'").join(blocks, "query_id", "left")
    system = F.concat(F.lit("Notes (cite as [n]):\n"), F.coalesce("notes", F.lit("No note was found.")))
    if boot is not None:
        rows = rows.crossJoin(F.broadcast(boot.select(F.left("block", F.lit(chars)).alias("boot"))))  # one row
        system = F.when(F.col("answered"), system).otherwise(F.concat(system, F.lit("\n\nBackground:\n"), F.col("boot")))
    return rows.select("query_id", "conv_id", "turn", F.col("text").alias("question"), system.alias("system"), "history")


def reassembled(events: DataFrame) -> DataFrame:
    """stream, text of answers that came as server-sent events (stream, ord, line): the deltas of `data:` lines in order, up to [DONE]."""
    data = F.regexp_extract("line", r"^data:\s*(.*)$", 1)
    piece = F.coalesce(F.get_json_object(data, "$.choices[0].delta.content"), F.get_json_object(data, "$.delta.text"))
    end = events.where(F.col("line").rlike(r"^data:\s*\[DONE\]")).groupBy("stream").agg(F.min("ord").alias("end"))
    rows = events.join(end, "stream", "left").where(F.col("end").isNull() | (F.col("ord") < F.col("end"))).withColumn("piece", piece)
    return rows.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("ord", "piece")))), lambda x: x["piece"]), "").alias("text"))


def injected(messages: Column, system: Column) -> Column:
    """Chat messages (array of role, content) with a system text in front, or added to the system message that is there."""
    first = F.try_element_at(messages, F.lit(1))
    own = F.struct(F.lit("system").alias("role"), F.concat_ws("\n\n", first["content"], system).alias("content"))
    new = F.struct(F.lit("system").alias("role"), system.alias("content"))
    return F.when(first["role"] == "system", F.concat(F.array(own), F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1))))).otherwise(F.concat(F.array(new), messages))


def variants(queries: DataFrame, generate: Callable, n: int = 3) -> DataFrame:
    """query_id, text: further phrasings or parts of a question that `generate` gives as JSON ({"queries": [...]}), at most n.

    `generate` maps query_id, text to query_id, answer; what cannot be read, is empty or repeats the question is left out.
    """
    answers = generate(queries.select("query_id", "text")).select("query_id", loose_json(F.col("answer"), "queries array<string>")["queries"].alias("said"))
    rows = answers.join(queries.select("query_id", F.col("text").alias("asked")), "query_id").select("query_id", "asked", F.posexplode("said").alias("at", "text"))
    rows = rows.withColumn("text", F.trim("text")).where((F.col("text") != "") & (F.lower("text") != F.lower("asked")))
    order = Window.partitionBy("query_id").orderBy("at")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("query_id", "at", "text")


def deep_evidence(main: DataFrame, parts: DataFrame) -> DataFrame:
    """Hits of a question and of its parts (query_id, at, chunk_id, rank), each chunk once: the question's first, then part by part."""
    rows = main.select("query_id", F.lit(-1).alias("at"), "chunk_id", "rank").unionByName(parts.select("query_id", "at", "chunk_id", "rank"))
    first = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("at", "rank")).alias("o"))
    order = Window.partitionBy("query_id").orderBy("o.at", "o.rank", "chunk_id")
    return first.select("query_id", "chunk_id", (F.row_number().over(order) - 1).alias("rank"))


def loose_json(said: Column, schema: str) -> Column:
    """A struct read from JSON that may stand in a code fence or among other words; null if there is none."""
    bare = F.trim(F.regexp_replace(F.trim(said), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    outer = F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0)
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, schema)), F.when(F.try_parse_json(outer).isNotNull(), F.from_json(outer, schema)))


def yaml_scalar(value: Column) -> Column:
    """A text as a quoted frontmatter value."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), F.regexp_replace(escaped, r"\s*\n\s*", " "), F.lit('"'))


def subheading(title: Column, heading: Column) -> Column:
    """A breadcrumb without the title in front; empty for the title itself."""
    start = F.concat(title, F.lit(" > "))
    return F.when(F.coalesce(heading, F.lit("")).isin("") | (heading == title), F.lit("")).when(heading.startswith(start), F.substring(heading, F.length(start) + 1, F.length(heading))).otherwise(heading)


def first_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id and the text of its first body chunk."""
    return chunks.where("kind = 'body'").groupBy("doc_id").agg(F.min_by("text", F.struct("ord", "chunk_id")).alias("text"))


def fingerprint(vectors: DataFrame) -> DataFrame:
    """One row: number, largest and sum of the ids that have a vector, which tells whether an index is still current."""
    return vectors.where("vec is not null").agg(F.count("*").alias("n"), F.coalesce(F.max("chunk_id"), F.lit(0)).alias("largest"), F.coalesce(F.sum(F.col("chunk_id").cast("decimal(38,0)")), F.lit(0)).alias("total"))


def embed_rate(batches: DataFrame) -> DataFrame:
    """One row, rate: texts per second over batches (at, texts, seconds) of eight and more that took time, three tenths new each time."""
    good = batches.where("seconds > 0.05 and texts >= 8").select("at", (F.col("texts") / F.col("seconds")).alias("r"))
    rates = F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"])
    return good.agg(rates.alias("rates")).select(F.aggregate("rates", F.lit(None).cast("double"), lambda s, r: F.when(s.isNull(), r).otherwise(0.7 * s + 0.3 * r)).alias("rate"))


def events_of(events: DataFrame, kinds: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The newest events of the given kinds."""
    rows = events if not kinds else events.where(F.col("kind").isin(*kinds))
    return rows.orderBy(F.desc("event_id")).limit(limit)


def view(notes: DataFrame, tier: str) -> DataFrame:
    """doc_id, view: a note as abstract, overview or in full."""
    if tier not in ("abstract", "overview", "full"):
        raise ValueError(f"no such view: {tier}")
    shown = {"abstract": lambda: context.abstract(F.col("title"), F.col("body")), "overview": lambda: context.overview("body"), "full": lambda: F.col("body")}[tier]()
    return notes.select("doc_id", shown.alias("view"))


def sims_for(chunks: DataFrame, wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, sim for the pairs (query_id, chunk_id) that are wanted."""
    from lodestone.functions import vector as vx

    rows = wanted.join(chunks.select("chunk_id", F.col("vec").alias("v")), "chunk_id").join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
    return rows.select("query_id", "chunk_id", F.round(vx.dot(F.col("q"), F.col("v")), 9).alias("sim"))


def safe_file(name: Column) -> Column:
    """A name as a file name, `untitled` if nothing of it is left."""
    return F.coalesce(F.nullif(tx.safe_name(name), F.lit("")), F.lit("untitled"))
