"""The link graph: resolving links and mentions, neighbours, degrees, expansion of results, suggestions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vector as vx
from lodestone.operators import similarity
from lodestone.sources.tables import written

ALPHA = 0.55
SEED_DOCS = 6
NEIGHBOR_CEILING = 48
EXPAND_BUDGET = 8
SIM_FLOOR = 0.25
MENTION_WEIGHT = 0.85
#: Mentions and pairs of documents that one task of `co_mention_edges` is given.
MENTIONS_A_TASK, PAIRS_A_TASK = 1_000_000, 500_000
#: Tasks at most.
MOST_TASKS = 20_000


def title_map(notes: DataFrame) -> DataFrame:
    """name, doc_id: lower-case titles and aliases; the largest doc_id wins a name."""
    names = notes.select("doc_id", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return names.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.max("doc_id").alias("doc_id"))


def wiki_edges(notes: DataFrame) -> DataFrame:
    """src, dst, kind, weight of wikilinks whose target is a title or alias; self links left out."""
    targets = notes.select(F.col("doc_id").alias("src"), F.explode("wikilinks").alias("target")).withColumn("name", F.lower(F.trim("target")))
    found = targets.join(title_map(notes).withColumnRenamed("doc_id", "dst"), "name").where("src <> dst")
    return found.select("src", "dst").distinct().select("src", "dst", F.lit("wiki").alias("kind"), F.lit(1.0).alias("weight"))


def _anchors(text: Column) -> Column:
    """What of a lower-case text an equality join can find: whole runs of Latin letters and digits, and pairs of other neighbouring signs.

    Wherever a name stands on its boundaries, all anchors of the name are anchors of the text around it.
    """
    runs = F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), F.lit(0))
    ones = F.regexp_extract_all(text, F.lit(r"[^a-z0-9_\s]"), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit(r"(?=([^a-z0-9_\s]{2}))"), F.lit(1))
    return F.array_distinct(F.concat(runs, pairs, ones))


def _stands_in(name: Column, body: Column) -> Column:
    """Whether a body holds a name that no Latin letter or digit continues at an end that is one itself."""
    word = "[a-z0-9_]"
    quoted = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    front = F.when(name.rlike(f"^{word}"), F.lit(f"(?<!{word})")).otherwise(F.lit(""))
    back = F.when(name.rlike(f"{word}$"), F.lit(f"(?!{word})")).otherwise(F.lit(""))
    return F.contains(body, name) & F.rlike(body, F.concat(front, quoted, back))


def mention_edges(notes: DataFrame, body: str = "body", names: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, weight where a body names a title on word boundaries (4 characters, 6 for single words).

    Titles (`names`: name, doc_id; by default those of the notes) and bodies meet by equality on the anchor of a title that fewest bodies hold, so
    neither side is brought to the driver and no body is compared with every title; what meets is verified on the whole
    body, all candidates of a note at once.
    """
    names = title_map(notes) if names is None else names
    names = names.where((F.length("name") >= 6) | ((F.length("name") >= 4) & F.col("name").contains(" ")))
    parts = names.select("name", F.col("doc_id").cast("long").alias("dst"), F.explode(_anchors(F.col("name"))).alias("anchor"))
    bodies = notes.select(F.col("doc_id").cast("long").alias("src"), F.lower(F.col(body)).alias("body")).where("body is not null")
    held = bodies.select("src", F.explode(_anchors(F.col("body"))).alias("anchor")).join(parts.select("anchor").distinct(), "anchor", "left_semi")
    held = written(held, "anchors")
    rare = held.groupBy("anchor").agg(F.count("*").alias("n"))
    best = parts.join(rare, "anchor", "left").groupBy("name", "dst").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("a"))
    met = held.join(best.where("a.n > 0").select(F.col("a.anchor").alias("anchor"), "name", "dst"), "anchor").where("src <> dst")
    wanted = met.groupBy("src").agg(F.collect_set(F.struct("name", "dst")).alias("names"))
    found = bodies.join(wanted, "src").select("src", F.explode(F.filter("names", lambda x: _stands_in(x["name"], F.col("body")))).alias("x"))
    return found.select("src", F.col("x.dst").alias("dst")).distinct().select("src", "dst", F.lit("mention").alias("kind"), F.lit(MENTION_WEIGHT).alias("weight"))


def links(notes: DataFrame) -> DataFrame:
    """Wiki edges, and mention edges where there is no wiki edge; written, since most callers read them more than once."""
    wiki = written(wiki_edges(notes), "wiki")
    return written(wiki.unionByName(mention_edges(notes).join(wiki.select("src", "dst"), ["src", "dst"], "left_anti")), "links")


def undirected(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))
    return edges.unionByName(back)


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, neighbor, weight: one hop in either direction, the heaviest edge of a pair."""
    both = undirected(edges.select("src", "dst", "weight")).join(seeds.select(F.col("doc_id").alias("src")).distinct(), "src")
    return both.groupBy(F.col("src").alias("seed"), F.col("dst").alias("neighbor")).agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """doc_id, degree: edges in and out, map-side combined."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("doc_id"))
    return ends.groupBy("doc_id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, k: int = 6) -> DataFrame:
    """The k documents of highest degree."""
    return degrees(edges).orderBy(F.desc("degree"), "doc_id").limit(k)


def linked_notes(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, direction (out, in), other, title, kind: the notes at the other ends of a note's links."""
    ends = lambda a, b, way: edges.select(F.col(a).alias("doc_id"), F.lit(way).alias("direction"), F.col(b).alias("other"), "kind")
    both = ends("src", "dst", "out").unionByName(ends("dst", "src", "in"))
    return both.join(notes.select(F.col("doc_id").alias("other"), "title"), "other").select("doc_id", "direction", "other", "title", "kind")


def link_counts(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, links_out, links_in of every note; one aggregation over the ends of all links."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("doc_id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("doc_id"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    counted = ends.groupBy("doc_id").agg(F.count_if(F.col("out") == 1).alias("links_out"), F.count_if(F.col("out") == 0).alias("links_in"))
    return notes.select("doc_id").join(counted, "doc_id", "left").fillna(0, ["links_out", "links_in"])


def co_mention_edges(mentions: DataFrame, entity: str, doc: str, least: int = 1, max_docs: int | None = None) -> DataFrame:
    """src < dst, shared, weight = min(1, 0.4 + 0.15 shared) for documents that share entities.

    The pairs are the result itself; `max_docs` states a bound on documents per entity where callers know one. They are
    counted first and dealt to as many tasks as hold so many each, so the memory of a task does not grow with the table.
    """
    rows = mentions.select(F.col(entity).alias("e"), F.col(doc).alias("d"))
    least_tasks = rows.sparkSession.sparkContext.defaultParallelism
    tasks = lambda n, each: max(least_tasks, min(MOST_TASKS, math.ceil((n or 0) / each)))
    by = tasks(rows.count(), MENTIONS_A_TASK)
    rows = written(rows.repartition(by, "e", "d").distinct(), "mentions").repartition(by, "e")
    if max_docs is not None:
        rows = rows.join(rows.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") <= max_docs).select("e"), "e", "left_semi")
    sizes = rows.groupBy("e").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).first()
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.e") == F.col("b.e")) & (F.col("a.d") < F.col("b.d")))
    pairs = pairs.select(F.col("a.d").alias("src"), F.col("b.d").alias("dst")).repartition(tasks(sizes["pairs"], PAIRS_A_TASK), "src", "dst")
    out = pairs.groupBy("src", "dst").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return out.withColumn("weight", F.least(F.lit(1.0), 0.4 + 0.15 * F.col("shared")))


def semantic_edges(vectors: DataFrame, edges: DataFrame, k: int = 3, floor: float = 0.55, factor: float = 0.6, index: similarity.InvertedLists | None = None, probes: int = 32) -> DataFrame:
    """For documents without any outgoing edge: the k nearest centroids above a floor, weight = factor times similarity.

    With an `index` over the centroids (chunk_id is their doc_id) only its nearest lists are searched.
    """
    centers = vx.mean_vectors(vectors, "doc_id", "vec").withColumn("vec", vx.normalized(F.col("centroid")))
    lonely = centers.join(edges.select(F.col("src").alias("doc_id")).distinct(), "doc_id", "left_anti")
    asked = lonely.select(F.col("doc_id").alias("query_id"), "vec")
    found = similarity.vector_topk(centers.select(F.col("doc_id").alias("chunk_id"), "vec"), asked, k + 1) if index is None else index.search(asked, k + 1, probes)
    near = found.where((F.col("query_id") != F.col("chunk_id")) & (F.col("score") >= floor))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return near.select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("sem").alias("kind"), (factor * F.col("score")).alias("weight"))


def gains(fused_docs: DataFrame, edges: DataFrame, hops: int = 1, alpha: float = ALPHA, seeds: int = SEED_DOCS) -> DataFrame:
    """query_id, doc_id, gain of neighbours of each query's best documents (query_id, doc_id, best), max-merged per hop."""
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), F.asc("doc_id"))
    front = fused_docs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= seeds).select("query_id", "doc_id", F.col("best").alias("gain"))
    both = undirected(edges.select("src", "dst", "weight"))
    damp = both.groupBy("src").agg(F.count("*").alias("deg"))
    both = both.join(damp, "src").withColumn("pull", alpha * F.col("weight") / F.sqrt(F.greatest(F.lit(1.0), F.col("deg") / 8)))
    visited, out = front.select("query_id", "doc_id"), None
    for _ in range(hops):
        step = front.join(both.select(F.col("src").alias("doc_id"), "dst", "pull"), "doc_id")
        step = step.groupBy("query_id", F.col("dst").alias("doc_id")).agg(F.max(F.col("gain") * F.col("pull")).alias("gain"))
        out = step if out is None else out.unionByName(step).groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
        front = step.join(visited, ["query_id", "doc_id"], "left_anti")
        visited = visited.unionByName(front.select("query_id", "doc_id"))
    return out


def expand(fused: DataFrame, edges: DataFrame, sims: DataFrame, lexical: DataFrame, hops: int = 1) -> DataFrame:
    """query_id, chunk_id, doc_id, fused after graph expansion.

    `fused` has query_id, chunk_id, doc_id, fused; `sims` query_id, chunk_id, doc_id, sim for the chunks of
    neighbours; `lexical` query_id, chunk_id, rank. A neighbour's boosted chunk is its best lexical one if
    that rates no lower than its best cosine; its second-best cosine chunk gets half; nothing passes 0.98 of
    the best direct score and nothing is lowered.
    """
    docs = fused.groupBy("query_id", "doc_id").agg(F.max("fused").alias("best"))
    gained = gains(docs, edges, hops)
    asked = lexical.groupBy("query_id").agg(F.greatest(F.lit(48), F.count("*")).alias("span"))
    lex = lexical.join(sims.select("query_id", "chunk_id", "doc_id"), ["query_id", "chunk_id"]).groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"), F.min_by("chunk_id", "rank").alias("lex_chunk"))
    near = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("sim"), F.asc("chunk_id"))
    placed = sims.withColumn("n", F.row_number().over(near)).where("n <= 2")
    best = placed.groupBy("query_id", "doc_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("sim"))).alias("sim"), F.max(F.when(F.col("n") == 1, F.col("chunk_id"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("chunk_id"))).alias("second")
    )
    cand = gained.join(best, ["query_id", "doc_id"]).join(lex, ["query_id", "doc_id"], "left").join(asked, "query_id", "left")
    ceiling = Window.partitionBy("query_id").orderBy(F.desc(F.col("r").isNotNull()), F.desc("gain"), F.asc("doc_id"))
    cand = cand.withColumn("n", F.row_number().over(ceiling)).where(F.col("n") <= NEIGHBOR_CEILING)
    sim = F.greatest(F.lit(0.0), F.col("sim"))
    cand = cand.withColumns({"s": sim, "l": F.coalesce(1 - F.col("r") / F.col("span"), F.lit(0.0))})
    cand = cand.withColumn("rate", F.greatest("s", "l")).where(F.col("rate") >= SIM_FLOOR)
    cand = cand.withColumns({"boosted": F.when(F.col("lex_chunk").isNotNull() & (F.col("l") >= F.col("s")), F.col("lex_chunk")).otherwise(F.col("first")), "add": F.col("gain") * (0.35 + 0.65 * F.col("rate"))})
    budget = Window.partitionBy("query_id").orderBy(F.desc("add"), F.asc("doc_id"))
    cand = cand.withColumn("n", F.row_number().over(budget)).where(F.col("n") <= EXPAND_BUDGET)
    second = F.when(F.col("second") == F.col("boosted"), F.col("first")).otherwise(F.col("second"))
    adds = cand.select("query_id", "doc_id", F.explode(F.array(F.struct(F.col("boosted").alias("chunk_id"), F.col("add").alias("add")), F.struct(second.alias("chunk_id"), (F.col("add") / 2).alias("add")))).alias("a"))
    adds = adds.select("query_id", "doc_id", "a.chunk_id", "a.add").where("chunk_id is not null")
    cap = fused.groupBy("query_id").agg((0.98 * F.max("fused")).alias("cap"))
    out = fused.join(adds, ["query_id", "chunk_id", "doc_id"], "full").join(cap, "query_id")
    now = F.coalesce("fused", F.lit(0.0))
    return out.select("query_id", "chunk_id", "doc_id", F.greatest(now, F.least(now + F.coalesce("add", F.lit(0.0)), F.col("cap"))).alias("fused"))


def suggestions(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, weight, sentence for mention edges: the first sentence of the source that holds the target's title."""
    found = edges.where("kind = 'mention'").join(notes.select(F.col("doc_id").alias("src"), "body"), "src")
    found = found.join(notes.select(F.col("doc_id").alias("dst"), "title"), "dst")
    holding = F.filter(tx.sentences(F.col("body")), lambda s: F.contains(F.lower(s), F.lower("title")))
    return found.select("src", "dst", "weight", F.try_element_at(holding, F.lit(1)).alias("sentence")).orderBy(F.desc("weight"), "src", "dst")


def stub_enrichment(notes: DataFrame, edges: DataFrame, short: int = 400, backlinks: int = 6) -> DataFrame:
    """doc_id, text: properties and sentences of up to six linking notes, for notes whose body is short."""
    stubs = notes.where(F.length("body") < short)
    props = F.slice(F.transform(F.filter(F.map_entries("frontmatter"), lambda e: ~e["key"].isin("tags", "aliases")), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(F.slice(e["value"], 1, 6), ", "))), 1, 10)
    into = edges.where("kind in ('wiki', 'mention')").select("src", "dst").distinct().join(stubs.select(F.col("doc_id").alias("dst"), F.lower("title").alias("name")), "dst")
    lines = into.join(notes.select(F.col("doc_id").alias("src"), F.col("title").alias("source"), "body"), "src")
    holding = F.filter(tx.sentences(F.col("body"), 20), lambda s: (F.length(s) <= 400) & F.contains(F.lower(s), F.col("name")))
    lines = lines.withColumn("s", F.try_element_at(holding, F.lit(1))).where("s is not null")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("n") <= backlinks)
    told = lines.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(": ", "source", "s").alias("t")))).alias("t"))
    out = stubs.select("doc_id", F.array_join(props, " · ").alias("p")).join(told, F.col("doc_id") == F.col("dst"), "left")
    text = F.concat_ws("\n", F.nullif("p", F.lit("")), F.array_join(F.transform("t", lambda x: x["t"]), "\n"))
    return out.select("doc_id", text.alias("text")).where("text <> ''")


def export(notes: DataFrame, edges: DataFrame, most: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Nodes with their degree, at most `most` by degree, and edges among them, one per unordered pair and kind."""
    nodes = notes.select("doc_id", "title").join(degrees(edges), "doc_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "doc_id").limit(most)
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "kind", "weight").groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))
    ids = nodes.select("doc_id")
    kept = pairs.join(ids.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    return nodes, kept
