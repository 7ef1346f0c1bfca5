"""A search index as Parquet tables, and the whole search over it for batches of queries.

The index holds what a query would otherwise count again: positional postings dealt by document, in buckets of terms; the
document frequency of every term; the lexicon; and the chunks with their vectors and the chunk that stands for them.
Searching touches the postings of the queries' terms, and from there on tables of a few rows a query.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import temporal as tm
from lodestone.functions import text as tx
from lodestone.functions import tokens as tk
from lodestone.functions import vector as vx
from lodestone.operators import filters, fusion, graph, lexical, postings, similarity

#: Folders of postings by hashed term: one for so many chunks, within bounds.
CHUNKS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 16, 4096


@dataclass
class Settings:
    """The knobs of a search; the defaults are those of the reference behaviour."""

    leg_k: int = 48
    rrf_k: int = 60
    vector: float = 1.0
    bm25: float = 0.8
    temporal: float = 0.35
    corrected: float = 0.9
    variant: float = 0.6
    keyword_boost: float = 2.4
    common_damp: float = 0.5
    prior: float = 0.6
    verbatim_gate: float = 0.60
    pin_gate: float = 0.65
    pin_head: int = 3
    recency: float = 1.0
    half_life: float = 21.0
    title: float = 0.12
    usage: float = 0.0
    hops: int = 1
    per_doc: int = fusion.PER_DOC
    rerank_top: int = 12
    rerank_blend: float = 0.5
    default_scope: str = ""


class SearchIndex:
    """An indexed corpus below a folder: immutable segments, what was taken away since, and a manifest that names both.

    A segment holds chunks (with vectors), positional postings in buckets of terms, document frequencies and the
    lexicon of some chunks. Taking documents away writes the numbers of their chunks and what they counted, which is
    subtracted; frequencies, lengths and results are those of an index of what is left. `build` writes one segment,
    `extended` a further one beside those that are there, until there are too many or too much is dead.
    """

    #: Segments of an index, and the share of dead chunks, beyond which everything left is written anew.
    MOST_SEGMENTS, MOST_DEAD = 8, 0.3

    def __init__(self, spark: SparkSession, folder: str, note: dict | None = None):
        self.spark, self.folder = spark, folder
        self.note = _read_json(spark, f"{folder}/manifest.json") if note is None else note
        segments, minus = self.note["segments"], self.note["minus"]
        self.n = sum(s["n"] for s in segments) - sum(m["n"] for m in minus)
        total = sum(s["total"] for s in segments) - sum(m["total"] for m in minus)
        self.mean_len = total / self.n if self.n else 0.0
        self.newest, self.buckets, self.stems, self.fields = (self.note[c] for c in ("newest", "buckets", "stems", "fields"))
        self.shards = [x for s in segments for x in s["shards"]]
        read = lambda places, name: _union([spark.read.parquet(f"{x['folder']}/{name}") for x in places])
        self.dead = read(minus, "dead") if minus else None
        self.stored, self.postings = read(segments, "chunks"), read(segments, "postings")
        self.chunks = self.stored if self.dead is None else self.stored.join(self.dead.select("chunk_id", "shard"), ["chunk_id", "shard"], "left_anti").select(self.stored.columns)
        self.vectors = self.chunks.where("vec is not null").select("chunk_id", "doc_id", "vec")
        counts = {name: (read(segments, name), read(minus, name) if minus else None) for name in ("frequencies", "lexicon")}
        self.frequencies, self.lexicon = (_less(*counts[name], value, len(segments)) for name, value in (("frequencies", "df"), ("lexicon", "n")))

    @classmethod
    def build(cls, spark: SparkSession, folder: str, chunks: DataFrame, embed: Callable | None = None, stem: bool = True, fields: dict[str, float] | None = None) -> SearchIndex:
        """Index chunks (chunk_id, doc_id, text, title and where known ord, kind, heading, doc_date, vec).

        `fields` weighs the indexed fields. `embed` gives a table with text a column vec; without it and without a column
        vec there is no vector leg. Chunks keep the partitions they come in.
        """
        fields = fields or lexical.FIELDS
        segment = _write_segment(spark, f"{folder}/segment", 0, chunks, embed, stem, fields)
        note = {"segments": [segment], "minus": [], "newest": segment.pop("newest"), "buckets": segment["buckets"], "stems": stem, "fields": fields}
        _write_json(spark, f"{folder}/manifest.json", note)
        return cls(spark, folder, note)

    def extended(self, folder: str, fresh: DataFrame, gone: DataFrame, embed: Callable | None = None) -> SearchIndex:
        """This index without the documents of `gone` (doc_id) and with the chunks of `fresh`, as an index in another folder.

        Writes one segment of the fresh chunks and the counts of the dead ones; the other segments are named, not copied.
        """
        left = self.chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_semi")
        minus = _write_minus(self.spark, f"{folder}/minus", left, self.stems, self.fields)
        note = {**self.note, "minus": [*self.note["minus"], *([minus] if minus["n"] else [])]}
        after = SearchIndex(self.spark, folder, note)
        dead = sum(m["n"] for m in note["minus"])
        if len(note["segments"]) >= self.MOST_SEGMENTS or dead > self.MOST_DEAD * sum(s["n"] for s in note["segments"]):
            return SearchIndex.build(self.spark, folder, after.chunks.drop("shard", "alias").unionByName(fresh, allowMissingColumns=True), embed, self.stems, self.fields)
        number = 1 + max(s["number"] for s in note["segments"])
        segment = _write_segment(self.spark, f"{folder}/segment", number, fresh, embed, self.stems, self.fields, self.buckets)
        dates = [d for d in (segment.pop("newest"), after.chunks.agg(F.max("doc_date")).first()[0]) if d is not None]
        note |= {"segments": [*note["segments"], segment] if segment["n"] else note["segments"], "newest": max(dates, default=None)}
        _write_json(self.spark, f"{folder}/manifest.json", note)
        return SearchIndex(self.spark, folder, note)

    def embed(self, embed: Callable) -> None:
        """Give the chunks of an index that was built without vectors theirs, written once beside it."""
        path = f"{self.folder}/vectors"
        # Unfiltered: a filter on vec would be pushed to where the vectors are made, and make them twice.
        embed(self.chunks.select("chunk_id", "doc_id", "text")).select("chunk_id", "doc_id", "vec").write.mode("overwrite").parquet(path)
        self.vectors = self.spark.read.parquet(path).where("vec is not null")

    def settle(self, df: DataFrame) -> DataFrame:
        """A table of a few rows a query, written below the index and read back, so that plans on it start anew."""
        path = f"{self.folder}/work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete what searches have written; their results can't be read any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/work")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def term_frequencies(self, tokens: DataFrame, token: str) -> DataFrame:
        """`tokens` with df: chunks that hold the token, as it is written or by its stem, whichever are more; 0 for none."""
        plain, reduced = tk.folded(F.col(token)), tk.folded_stem(F.col(token))
        asked = tokens.select(token).distinct().withColumn("terms", F.array_distinct(F.array(plain, reduced) if self.stems else F.array(plain)))
        held = self.frequencies.select(F.col("term").alias("_term"), "df")
        found = asked.select(token, F.explode("terms").alias("_term")).join(held, "_term").groupBy(token).agg(F.max("df").alias("df"))
        return tokens.join(found, token, "left").withColumn("df", F.coalesce("df", F.lit(0)))

    def _terms(self, queries: DataFrame, leg: str | None, whole: bool) -> tuple[DataFrame, DataFrame, int]:
        """Terms of queries with their idf, the postings of just these terms (phrases have postings made here), and the number of queries."""
        terms = self.settle(postings.terms_of(queries, self.stems, leg, whole))
        single, phrases = terms.where("size = 1"), terms.where("size > 1").select("term").distinct()
        tokens = terms.select("query_id", "size", F.explode(F.split("term", postings.JOINT)).alias("term"))
        # Buckets without a term of these queries are not read.
        told = tokens.agg(F.collect_set(postings.bucket(self.buckets)).alias("buckets"), F.max("size").alias("size"), F.count_distinct("query_id").alias("n")).first()
        held = self.postings.where(F.col("bucket").isin(told["buckets"]))
        found = held.join(single.select("term").distinct(), "term", "left_semi").select("term", "shard", "ids", "tf", "len")
        counts = self.frequencies.join(single.select("term").distinct(), "term", "left_semi").select("term", "df")
        if (told["size"] or 0) > 1:
            made = self.settle(postings.phrase_postings(held, phrases, self.shards, list(self.fields.values())))
            each = made.select("term", "shard", F.explode("chunks").alias("chunk_id"))
            each = each if self.dead is None else each.join(self.dead.select("chunk_id", "shard"), ["chunk_id", "shard"], "left_anti")
            counts = counts.unionByName(each.groupBy("term").agg(F.count("*").alias("df")))
            found = found.unionByName(made.drop("chunks"))
        idf = F.greatest(F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        return terms.join(counts, "term", "left").withColumn("idf", idf).drop("df", "size"), found, told["n"]

    def bm25(self, queries: DataFrame, k: int, allowed: DataFrame | None = None, two_phase: bool = True, leg: str | None = None, whole: bool = False) -> DataFrame:
        """query_id, chunk_id, score, rank of the k best chunks, of the allowed documents where a query has a scope.

        With `whole` all words of a query are looked up, else its first 16 (`tokens.MOST_WORDS`).
        With `leg`, the name of a column of numbers, several texts of a query are ranked apart and told by it.
        `allowed` are documents by scope (see `allowed_documents`); then queries have a column scope_id.
        """
        terms, found, n = self._terms(queries, leg, whole)
        side = self.spark.createDataFrame([], "shard long, scope long, ids array<long>")
        if self.dead is not None:
            side = side.unionByName(self.dead.groupBy("shard").agg(F.collect_list("chunk_id").alias("ids")).select("shard", F.lit(None).cast("long").alias("scope"), "ids"))
        scope = F.lit(None).cast("long")
        if allowed is not None:
            members = self.chunks.select("chunk_id", "doc_id", "shard").join(allowed.where("doc_id is not null"), "doc_id")
            side = side.unionByName(members.groupBy("shard", F.col("scope_id").alias("scope")).agg(F.collect_list("chunk_id").alias("ids")).select("shard", "scope", "ids"))
            terms, scope = terms.join(queries.select("query_id", "scope_id").distinct(), "query_id"), F.col("scope_id")
        slices = max(1, -(-n // postings.SLICE))
        hits = postings.ranked(found, terms.withColumn("scope", scope), side, self.shards, k, self.mean_len or 1.0, two_phase, slices)
        return hits if leg else hits.drop("leg")


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def _less(plus: DataFrame, minus: DataFrame | None, value: str, segments: int) -> DataFrame:
    """Counts by term over all segments, without what is dead."""
    if minus is None and segments == 1:
        return plus
    whole = plus if minus is None else plus.unionByName(minus.withColumn(value, -F.col(value)))
    return whole.groupBy("term").agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_json(spark: SparkSession, path: str, note: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(note).encode()))
    out.close()


def _read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    note = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return note


def _write_segment(spark: SparkSession, folder: str, number: int, chunks: DataFrame, embed: Callable | None, stem: bool, fields: dict[str, float], buckets: int | None = None) -> dict:
    """Write the tables of a segment; where they are, their shards and sums. Without `buckets` their number follows from the chunks'."""
    given = {"ord": F.lit(0), "kind": F.lit("body"), "heading": F.lit(""), "doc_date": F.lit(None).cast("double")}
    chunks = chunks.withColumns({c: v for c, v in given.items() if c not in chunks.columns})
    own = ["vec"] if "vec" in chunks.columns else []
    held = chunks.select("chunk_id", "doc_id", F.col("ord").cast("int").alias("ord"), "kind", "heading", "title", "text", "doc_date", *own)
    alias = fusion.nested_alias(held.where("kind = 'burst'").unionByName(held.where("kind = 'body'"))) if held.where("kind = 'burst'").head(1) else None
    held = held.withColumn("alias", F.col("chunk_id")) if alias is None else held.join(alias, "chunk_id", "left").withColumn("alias", F.coalesce("alias", "chunk_id"))
    # A small table of few partitions is dealt over all cores; others keep their partitions.
    cores = spark.sparkContext.defaultParallelism
    held = held if held.rdd.getNumPartitions() >= cores else held.repartition(cores)
    held = postings.numbered(held).withColumn("shard", F.col("shard") + F.lit(number << 44))
    if not own:
        held = embed(held) if embed is not None else held.withColumn("vec", F.lit(None).cast("array<double>"))
    held.write.mode("overwrite").parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    by_shard = stored.groupBy("shard").agg(F.count("*").alias("n"), F.max("doc_date").alias("newest")).collect()
    n = sum(r["n"] for r in by_shard)
    buckets = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, n // CHUNKS_A_BUCKET))
    inverted = postings.inverted(stored, fields, stem).withColumn("bucket", postings.bucket(buckets))
    inverted = inverted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "shard")
    inverted.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    lists = spark.read.parquet(f"{folder}/postings")
    sums = lists.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"))
    sums.write.mode("overwrite").parquet(f"{folder}/frequencies")
    lexical.lexicon(stored).write.mode("overwrite").parquet(f"{folder}/lexicon")
    total = spark.read.parquet(f"{folder}/frequencies").agg(F.sum("total")).first()[0]
    dates = [r["newest"] for r in by_shard if r["newest"] is not None]
    return {"folder": folder, "number": number, "n": n, "buckets": buckets, "total": total or 0.0, "shards": sorted(r["shard"] for r in by_shard), "newest": max(dates, default=None)}


def _write_minus(spark: SparkSession, folder: str, left: DataFrame, stem: bool, fields: dict[str, float]) -> dict:
    """Write which chunks are dead and what they counted, from their texts."""
    left.select("chunk_id", "shard", *dict.fromkeys([*fields, "text"])).write.mode("overwrite").parquet(f"{folder}/dead")
    dead = spark.read.parquet(f"{folder}/dead")
    sums = postings.inverted(dead, fields, stem, keep="sums").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"))
    sums.write.mode("overwrite").parquet(f"{folder}/frequencies")
    lexical.lexicon(dead).write.mode("overwrite").parquet(f"{folder}/lexicon")
    total = spark.read.parquet(f"{folder}/frequencies").agg(F.sum("total")).first()[0]
    return {"folder": folder, "n": dead.count(), "total": total or 0.0}


def _inside(rows: DataFrame, allowed: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (query_id, doc_id, ...) of queries without a scope, and of those with one the rows inside it.

    `allowed` has scope_id and doc_id, `asked` query_id and scope_id (null without a scope).
    """
    told = rows.join(asked.select("query_id", "scope_id").distinct(), "query_id", "left")
    free = told.where("scope_id is null").select(*rows.columns)
    inside = told.where("scope_id is not null").join(allowed.where("doc_id is not null"), ["scope_id", "doc_id"], "left_semi")
    return free.unionByName(inside.select(*rows.columns))


def scopes(queries: DataFrame, default: str = "") -> DataFrame:
    """query_id, text (without operators), scope, scoped and scope_id for every query; an unscoped query takes the default scope.

    Queries of one scope have one scope_id, which is null without a scope.
    """
    own = queries.withColumn("scope", filters.parse_operators(F.col("text")))
    clean = F.col("scope.clean")
    if default:
        fallback = filters.parse_operators(F.lit(default))
        own = own.withColumn("scope", F.when(filters.is_scoped(F.col("scope")) | F.col("scope.everywhere"), F.col("scope")).otherwise(fallback))
    # The text is the query's own, whatever scope applies.
    own = own.withColumn("text", clean if not default else filters.parse_operators(F.col("text"))["clean"]).withColumn("scoped", filters.is_scoped(F.col("scope")))
    same = F.to_json(F.col("scope").dropFields("clean", "everywhere"))
    return own.withColumn("scope_id", F.when(F.col("scoped"), F.xxhash64(same)))


def allowed_documents(scoped: DataFrame, notes: DataFrame) -> DataFrame:
    """scope_id, doc_id of the notes in each distinct scope; a null doc_id where there is none.

    A scope looks for its notes by one of its conditions: a tag, its folders' first parts, the values of a field, or the
    days of its time. Notes are spread over their own tags, folders, values and day once, joined by equality, and what
    meets is tested whole.
    """
    asked = scoped.where("scoped").select("scope_id", "scope").dropDuplicates(["scope_id"])
    have = {c: F.col(c) if c in notes.columns else F.lit(None).cast(t) for c, t in (("tags", "array<string>"), ("path", "string"), ("frontmatter", "map<string,array<string>>"), ("doc_date", "double"))}
    notes = notes.select("doc_id", *(v.alias(c) for c, v in have.items()))
    notes = notes.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "path": F.coalesce("path", F.lit(""))})
    key = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    day = lambda c: F.floor(c / F.lit(86400.0)).cast("long")
    ends = notes.agg(F.min("doc_date").alias("first"), F.max("doc_date").alias("last"))
    # The parts of a scope as columns of their own.
    parts = ("tags", "folders", *filters.FIELD_OPERATORS, "lo", "hi")
    asked = asked.select("scope_id", *(F.col("scope")[c].alias(f"_{c}") for c in parts)).crossJoin(F.broadcast(ends))  # one row
    s = {c: F.col(f"_{c}") for c in parts}
    first, last = F.greatest(s["lo"], F.col("first")), F.least(s["hi"], F.col("last"))
    days = F.when(first <= last, F.sequence(day(first), day(last))).otherwise(F.array().cast("array<long>"))
    ways = F.when(F.size(s["tags"]) > 0, key("tag", F.slice(s["tags"], 1, 1)))
    ways = ways.when(F.size(s["folders"]) > 0, key("dir", F.transform(s["folders"], lambda f: F.split(F.btrim(f, F.lit("/")), "/")[0])))
    for name in filters.FIELD_OPERATORS:
        ways = ways.when(F.size(s[name]) > 0, key(name, s[name]))
    ways = ways.otherwise(key("day", F.transform(days, lambda d: d.cast("string"))))
    asked = asked.select("scope_id", *s.values(), F.explode_outer(F.array_distinct(ways)).alias("key"))
    folders = F.split(F.lower("path"), "/")
    of = [key("tag", F.transform("tags", lambda t: F.lower(t))), key("dir", F.slice(folders, 1, F.size(folders) - 1)), F.when(F.col("doc_date").isNotNull(), key("day", F.array(day(F.col("doc_date")).cast("string")))).otherwise(F.array().cast("array<string>"))]
    for name in filters.FIELD_OPERATORS:
        of.append(key(name, F.transform(F.coalesce(F.try_element_at("frontmatter", F.lit(name)), F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))))
    spread = notes.withColumn("key", F.explode(F.array_distinct(F.concat(*of))))
    inside = filters.in_scope(s, F.col("tags"), F.col("path"), F.col("frontmatter"), F.col("doc_date"))
    found = spread.join(asked, "key").where(inside).select("scope_id", "doc_id").distinct()
    return asked.select("scope_id").distinct().join(found, "scope_id", "left")


def scope_listing(index: SearchIndex, scoped: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """Queries that are a scope and nothing else: their newest k documents, each by its first chunk, score 0."""
    bare = scoped.where("scoped and text = ''").select("query_id", "scope_id")
    first = index.chunks.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "doc_date"), F.struct("ord", "chunk_id")).alias("c"))
    dated = allowed.join(bare.select("scope_id").distinct(), "scope_id", "left_semi").join(first, "doc_id").select("scope_id", "doc_id", "c.chunk_id", F.coalesce("c.doc_date", F.lit(0.0)).alias("date"))
    order = Window.partitionBy("scope_id").orderBy(F.desc("date"), "doc_id")
    best = dated.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return bare.join(best, "scope_id").select("query_id", "chunk_id", "doc_id", F.lit(0.0).alias("fused"), "rank")


def canonical(leg: DataFrame, chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A leg (query_id, chunk_id, rank) in which focused chunks are the chunk that holds them, each at its best rank."""
    of = ["query_id", *(by or [])]
    named = leg.join(chunks.select("chunk_id", "alias"), "chunk_id")
    best = named.groupBy(*of, F.col("alias").alias("chunk_id")).agg(F.min("rank").alias("first"))
    order = Window.partitionBy(*of).orderBy("first", "chunk_id")
    return best.select(*of, "chunk_id", (F.row_number().over(order) - 1).alias("rank"))


def vector_leg(index: SearchIndex, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """query_id, chunk_id, score, rank: the nearest chunks; inside the scope where a query has one, all of it compared."""
    asked = queries.where("vec is not null")
    if allowed is None:
        return similarity.vector_topk(index.vectors, asked.select("query_id", "vec"), k)
    known = allowed.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("scope_id").alias("scopes"))
    held = index.vectors.join(known, "doc_id", "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<long>")))
    return similarity.vector_topk(held, asked.select("query_id", "vec", "scope_id"), k, scopes="scopes")


def windows(queries: DataFrame, now: float) -> DataFrame:
    """query_id, recent, lo, hi of the queries that name a time."""
    intent = tm.temporal_intent(F.col("text"), F.lit(float(now)))
    return queries.select("query_id", intent.alias("i")).select("query_id", "i.*").where("recent")


def choose_pins(cover: DataFrame, hits: DataFrame, s: Settings, newest: float) -> DataFrame:
    """query_id, best, pinned: the best coverage of the first eight hits, and the hit to pin.

    `hits` are lexical ones (query_id, chunk_id, rank, recent, doc_date). With vague recency the first 24 may be
    pinned if they cover enough, the newest among them first; else the first eight.
    """
    rows = cover.join(hits, ["query_id", "chunk_id"])
    best = rows.where("rank < 8").groupBy("query_id").agg(F.max("cover").alias("best")).where("best > 0")
    age = tm.recency_weight(F.col("doc_date"), F.lit(float(newest)), s.half_life)
    lift = F.when(F.col("recent") & (F.col("doc_date") > 0), 1 + s.recency * age).otherwise(F.lit(1.0))
    rows = rows.join(best, "query_id").where(F.col("cover") >= F.least(0.8 * F.col("best"), F.lit(s.pin_gate)))
    rows = rows.where((F.col("rank") < 8) | F.coalesce("recent", F.lit(False))).withColumn("lifted", F.round(F.col("cover") * lift, 12))
    return rows.groupBy("query_id").agg(F.max("best").alias("best"), F.max_by("chunk_id", F.struct("lifted", -F.col("rank"))).alias("pinned"))


def search(
    index: SearchIndex,
    queries: DataFrame,
    k: int = 8,
    mode: str = "hybrid",
    notes: DataFrame | None = None,
    edges: DataFrame | None = None,
    hits: DataFrame | None = None,
    variants: DataFrame | None = None,
    embed: Callable | None = None,
    now: float = 0.0,
    settings: Settings | None = None,
    rerank: Callable | None = None,
    reorder: Callable | None = None,
) -> DataFrame:
    """query_id, chunk_id, doc_id, fused, rank: the k best chunks of every query (query_id, text, and vec where known).

    Operators in a text scope its query before anything is ranked. Modes: `vector` and `bm25` are one leg by rank
    alone, `fast` does without vectors, graph and reranking, `hybrid` does all. `notes` (doc_id, tags, path,
    frontmatter, doc_date) are what scopes select from, `edges` the link graph, `hits` (doc_id, hits) feed the usage
    prior, `variants` (query_id, text, vec) are further phrasings of a query. `rerank` and `reorder` map the best candidates (query_id,
    asked, chunk_id, passage, fused) to their scores (query_id, chunk_id, score): blended as a share of ten, or
    replacing the order. `embed` gives queries without vec one, from the text that is left without operators.
    """
    s = settings or Settings()
    asked = scopes(queries, s.default_scope)
    asked = asked if notes is not None else asked.withColumn("scope_id", F.lit(None).cast("long"))
    restricted = notes is not None and bool(asked.where("scoped").head(1))
    allowed = index.settle(allowed_documents(asked, notes)) if restricted else None
    listed = scope_listing(index, asked, allowed, k) if restricted else None
    asked = asked.where("text <> ''")
    if "vec" not in asked.columns:
        asked = embed(asked) if embed is not None and mode in ("vector", "hybrid") else asked.withColumn("vec", F.lit(None).cast("array<double>"))
    asked = asked.select("query_id", "text", "vec", "scope_id")

    if mode in ("vector", "bm25"):
        one = index.settle(vector_leg(index, asked, s.leg_k, allowed) if mode == "vector" else index.bm25(asked, s.leg_k, allowed))
        fused = fusion.rrf(canonical(one, index.chunks).withColumn("weight", F.lit(1.0)), s.rrf_k)
        out = fusion.capped_top_k(fused.join(index.chunks.select("chunk_id", "doc_id"), "chunk_id"), k, 1 << 30)
        return _with(out, listed)

    fixed = lexical.correct_typos(asked, index.lexicon).select("query_id", F.coalesce("corrected", "text").alias("lexical"))
    asked = asked.join(fixed, "query_id", "left").withColumn("lexical", F.coalesce("lexical", "text"))
    flags = lexical.all_tokens_common(asked, index.term_frequencies, index.n, text="lexical")
    asked = index.settle(asked.join(flags, "query_id", "left"))
    # All texts of a query in one pass over the postings: its own, the repaired one, further phrasings.
    texts = asked.select("query_id", "text", "scope_id", F.lit(0).alias("leg")).unionByName(asked.where("lexical <> text").select("query_id", F.col("lexical").alias("text"), "scope_id", F.lit(1).alias("leg")))
    if variants is not None and mode == "hybrid":
        variants = variants.select("query_id", "text", "vec", F.monotonically_increasing_id().alias("nth")).join(asked.select("query_id", "scope_id"), "query_id")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("text", "nth")) + 1
        variants = index.settle(variants.withColumn("leg", nth).drop("nth"))
        texts = texts.unionByName(variants.select("query_id", "text", "scope_id", "leg"))
    lists = index.settle(canonical(index.bm25(texts, s.leg_k, allowed, leg="leg"), index.chunks, ["leg"]))
    found = lists.where("leg = 0").drop("leg")
    share = F.when(F.col("leg") == 0, 1.0).when(F.col("leg") == 1, s.corrected).otherwise(s.variant)
    legs = [lists.select("query_id", "chunk_id", "rank", F.lit("bm25").alias("name"), (F.lit(s.bm25) * share).alias("weight")).withColumnRenamed("name", "leg")]

    def vectors(of: DataFrame, factor: float) -> DataFrame:
        # Tables of known size meet the chunks without a shuffle of the texts, and each text is read once.
        near = index.settle(vector_leg(index, of, s.leg_k, allowed))
        gate = asked.select("query_id", (F.col("all_common") | F.col("none_telling")).alias("gate"))
        near = index.settle(near.join(index.chunks.select("chunk_id", "text"), "chunk_id"))
        near = fusion.informativeness(near.join(gate, "query_id"), index.term_frequencies, index.n, s.prior)
        return canonical(near, index.chunks).select("query_id", "chunk_id", "rank", F.lit("vector").alias("leg"), F.lit(s.vector * factor).alias("weight"))

    if mode == "hybrid":
        legs.append(vectors(asked, 1.0))
    if variants is not None and mode == "hybrid":
        legs.append(vectors(variants, s.variant))
    timed = index.settle(windows(asked, now)) if s.recency > 0 else None
    timed = timed if timed is not None and timed.head(1) else None
    if timed is not None and s.temporal > 0 and timed.where("lo is not null").head(1):
        first = index.chunks.where("doc_date > 0").groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "doc_date"), F.struct("ord", "chunk_id")).alias("c")).select("doc_id", "c.chunk_id", "c.doc_date")
        leg = filters.window_leg(first, timed.where("lo is not null").select("query_id", "lo", "hi"), k)
        leg = _inside(leg, allowed, asked) if allowed is not None else leg
        legs.append(leg.select("query_id", "chunk_id", "rank", F.lit("temporal").alias("leg"), F.lit(s.temporal).alias("weight")))
    tickets = legs[0]
    for leg in legs[1:]:
        tickets = tickets.unionByName(leg)

    pins = None
    newest = min(now, index.newest) if index.newest and now else (index.newest or now)
    if mode == "hybrid":
        meta = found.where(F.col("rank") < (8 if timed is None else 24)).join(index.chunks.select("chunk_id", "text", "title", "doc_date"), "chunk_id")
        recent = timed.where("lo is null").select("query_id", "recent") if timed is not None else asked.limit(0).select("query_id", F.lit(True).alias("recent"))
        meta = index.settle(meta.join(recent, "query_id", "left"))
        unsure = asked.where("not all_common").select("query_id", F.col("lexical").alias("text"), tx.is_keyword_query(F.col("text")).alias("keyword")).where("not keyword")
        cover = fusion.coverage(unsure, meta, index.lexicon)
        told = choose_pins(cover, meta.select("query_id", "chunk_id", "rank", "recent", F.coalesce("doc_date", F.lit(0.0)).alias("doc_date")), s, newest)
        told = index.settle(told)
        lean = asked.select("query_id", tx.is_keyword_query(F.col("text")).alias("keyword"), "all_common", F.col("vec").isNotNull().alias("dense")).join(told, "query_id", "left")
        factor = F.when(F.col("keyword") | (F.col("best") >= s.verbatim_gate), F.lit(s.keyword_boost)).when(F.col("all_common") & F.col("dense"), F.lit(s.common_damp)).otherwise(F.lit(1.0))
        lean = lean.select("query_id", factor.alias("factor"))
        tickets = tickets.join(lean, "query_id", "left").withColumn("weight", F.col("weight") * F.when(F.col("leg") == "bm25", F.coalesce("factor", F.lit(1.0))).otherwise(F.lit(1.0))).drop("factor")
        sure = told.where(F.col("best") >= s.pin_gate)
        head = found.where(F.col("rank") < s.pin_head).join(sure.select("query_id"), "query_id").select("query_id", "chunk_id", (2 + 1 / (1 + F.col("rank"))).alias("pin"))
        pins = head.unionByName(sure.select("query_id", F.col("pinned").alias("chunk_id"), F.lit(3.5).alias("pin"))).groupBy("query_id", "chunk_id").agg(F.max("pin").alias("pin"))

    fused = fusion.rrf(tickets, s.rrf_k)
    if pins is not None:
        fused = fused.join(pins, ["query_id", "chunk_id"], "left").withColumn("fused", F.coalesce("pin", "fused")).drop("pin")
    fused = index.settle(fused)
    meta = index.chunks.select("chunk_id", "doc_id", "kind", "title", "text", "doc_date")
    rows = fused.join(meta, "chunk_id").join(asked.select("query_id", F.col("text").alias("asked"), "lexical"), "query_id")
    if timed is not None:
        rows = rows.join(timed, "query_id", "left")
        intent = F.struct(F.coalesce("recent", F.lit(False)).alias("recent"), "lo", "hi")
        rows = rows.withColumn("fused", F.col("fused") * fusion.recency_factor(F.col("doc_date"), intent, tm.recency_weight(F.col("doc_date"), F.lit(float(newest or 0)), s.half_life), s.recency)).drop("recent", "lo", "hi")
    rows = rows.withColumn("fused", F.col("fused") + fusion.title_bonus(F.col("title"), F.col("lexical"), s.title))
    if hits is not None and s.usage > 0:
        most = hits.agg(F.max("hits").alias("most"))
        rows = rows.join(hits.select("doc_id", "hits"), "doc_id", "left").crossJoin(most)  # one row
        rows = rows.withColumn("fused", F.when(F.col("hits").isNull(), F.col("fused")).otherwise(F.col("fused") * fusion.usage_factor(F.col("hits"), F.col("most"), s.usage))).drop("hits", "most")
    rows = rows.withColumn("fused", F.round("fused", 12))
    if edges is not None and mode == "hybrid":
        rows = _expanded(index, rows, edges, asked, found, allowed, s, meta)
    for judge, blend in ((rerank, True), (reorder, False)):
        if judge is not None and mode == "hybrid":
            rows = _reranked(rows, judge, s, blend)
            break
    return _with(fusion.final_hits(index.settle(rows), k, s.per_doc), listed)


def _with(out: DataFrame, listed: DataFrame | None) -> DataFrame:
    out = out.select("query_id", "chunk_id", "doc_id", "fused", "rank")
    return out if listed is None else out.unionByName(listed)


def _expanded(index: SearchIndex, rows: DataFrame, edges: DataFrame, asked: DataFrame, found: DataFrame, allowed, s: Settings, meta: DataFrame) -> DataFrame:
    """Rows after graph expansion; neighbours' chunks are compared with the query's vector."""
    rows = index.settle(rows)
    docs = rows.groupBy("query_id", "doc_id").agg(F.max("fused").alias("best"))
    near = graph.gains(docs, edges, s.hops).select("query_id", "doc_id")
    sims = near.join(asked.where("vec is not null").select("query_id", "vec"), "query_id").join(index.vectors.withColumnRenamed("vec", "v"), "doc_id")
    sims = sims.select("query_id", "chunk_id", "doc_id", F.round(vx.dot(F.col("vec"), F.col("v")), 9).alias("sim"))
    wide = graph.expand(rows.select("query_id", "chunk_id", "doc_id", "fused"), edges, sims, found, s.hops)
    wide = _inside(wide, allowed, asked) if allowed is not None else wide
    names = rows.select("query_id", "asked", "lexical").distinct()
    return wide.withColumn("fused", F.round("fused", 12)).join(meta.drop("doc_id"), "chunk_id").join(names, "query_id")


def _reranked(rows: DataFrame, judge: Callable, s: Settings, blend: bool) -> DataFrame:
    """The best `rerank_top` candidates rated by `judge`; where it gives no score the fused one stays."""
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id")
    rows = rows.withColumns({"place": F.row_number().over(order), "top": F.max("fused").over(Window.partitionBy("query_id"))})
    size = 300 if blend else 512
    passage = F.left(F.concat_ws(". ", "title", "text"), F.lit(size))
    rated = judge(rows.where(F.col("place") <= s.rerank_top).select("query_id", "asked", "chunk_id", passage.alias("passage"), "fused")).select("query_id", "chunk_id", "score")
    rows = rows.join(rated, ["query_id", "chunk_id"], "left")
    if blend:
        share = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("score"))) / 10
        value = (1 - s.rerank_blend) * F.col("fused") + s.rerank_blend * share * F.col("top")
    else:
        n = F.count("score").over(Window.partitionBy("query_id"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "place"))
        rows = rows.withColumns({"n": n, "nth": nth})
        value = F.col("top") + F.col("n") - F.col("nth") + 1
    return rows.withColumn("fused", F.when(F.col("score").isNull(), F.col("fused")).otherwise(value))
