"""The operators bound to the tables of a data folder, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import temporal as tm
from lodestone.functions import text as tx
from lodestone.functions import vector as vx
from lodestone.operators import context, evaluation, fusion, graph, lexical, memory, search, similarity
from lodestone.plans.stems import stem_ctes
from lodestone.plans.store import index_of
from lodestone.sources.tables import folder_for, load
from lodestone.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark, d) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "lang", "source", "n_chars")


def _asked(spark, d) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9가-힣]+')"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_CONTENT = f"list_distinct(list_filter({_TOK}, lambda t: length(t) > 1 AND t NOT IN ({_STOPS})))"
#: Tokens of full text: no marks, any script. Stems are stated apart from the library (see `stems`).
_FOLD = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"


def _ranking(src: str, more: str = "SELECT NULL::VARCHAR AS w WHERE false", first: str = "[1:16]") -> str:
    """CTEs up to `scored` (query_id, v, doc_id, score, matched) for texts t of `src` (query_id, v, t); `more` adds words with stems; `first` are the words looked up."""
    return f"""
  src AS ({src}),
  parts0 AS (SELECT query_id, v, unnest(ws) AS word, generate_subscripts(ws, 1) AS nth FROM (SELECT query_id, v, list_filter(string_split_regex(replace(t, '"', ''), '\\s+'), lambda w: w <> ''){first} AS ws FROM src)),
  parts1 AS (SELECT query_id, v, nth, unnest(ts) AS w, generate_subscripts(ts, 1) AS j FROM (SELECT *, {_FOLD.format("word")} AS ts FROM parts0)),
  toks0 AS (SELECT doc_id, {_FOLD.format("text")} AS ts FROM documents),
  flat AS (SELECT doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM toks0),
  words AS (SELECT w FROM flat UNION SELECT w FROM parts1 UNION {more}),
  {stem_ctes("words")},
  pos AS (SELECT doc_id, i, stem AS term FROM flat JOIN stems USING (w)),
  lens AS (SELECT doc_id, count(*) AS len, list(term ORDER BY i) AS ts FROM pos GROUP BY doc_id),
  stats AS (SELECT n, total / n::DOUBLE AS mean_len, greatest(0.05 * n, 4) AS floor, greatest(2.0, 0.008 * n) AS ceiling FROM (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM flat) AS total)),
  asked AS (SELECT DISTINCT query_id, v, term, m, first FROM (SELECT query_id, v, nth, string_agg(stem, ' ' ORDER BY j) AS term, count(*) AS m, arg_min(stem, j) AS first FROM parts1 JOIN stems USING (w) GROUP BY ALL)),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM pos WHERE term IN (SELECT term FROM asked WHERE m = 1) GROUP BY ALL
    UNION ALL SELECT doc_id, a.term, count(*) FROM (SELECT DISTINCT term, m, first FROM asked WHERE m > 1) a JOIN pos ON pos.term = a.first JOIN lens USING (doc_id) WHERE array_to_string(ts[i : i + m - 1], ' ') = a.term GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  scored AS (SELECT query_id, v, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 9) AS score, count(*) AS matched
    FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY query_id, v, doc_id)"""


_TERMS = _ranking("SELECT item_id AS query_id, 0 AS v, text AS t FROM benchmark")
#: The same of whole items.
_WHOLE = _ranking("SELECT item_id AS query_id, 0 AS v, text AS t FROM benchmark", first="")
_WITH_DF = "coalesce(greatest(a.df, b.df), 0) AS df FROM {0} x LEFT JOIN stems s ON s.w = x.term LEFT JOIN vdf a ON a.term = x.term LEFT JOIN vdf b ON b.term = s.stem"
_VDF = "vdf AS (SELECT term, count(DISTINCT doc_id) AS df FROM pos GROUP BY term)"


@query(f"""WITH {_WHOLE}
SELECT query_id, doc_id, round(score, 6) AS score, CAST(r - 1 AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 8""")
def bm25_topk(spark, d):
    """The eight best documents of every benchmark item by BM25."""
    found = index_of(spark, d).bm25(_asked(spark, d), 8, two_phase=False, whole=True)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_TERMS}
SELECT query_id, doc_id, round(score, 6) AS score, CAST(r - 1 AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 8""")
def bm25_after_edits(spark, d):
    """An index of other texts for a fifth of the documents, edited into that of the documents by one segment; as if built at once."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("title"), "text")
    edited = F.col("doc_id") % 5 == 0
    old = docs.withColumn("text", F.when(edited, F.concat_ws(" ", F.reverse("text"), "title")).otherwise(F.col("text")))
    folder = folder_for(spark)
    first = search.SearchIndex.build(spark, f"{folder}/1", old, fields={"text": 1.0})
    index = first.extended(f"{folder}/2", docs.where(edited), docs.where(edited).select("doc_id"))
    found = index.bm25(_asked(spark, d), 8, two_phase=False)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_WHOLE}, n_asked AS (SELECT query_id, count(*) AS asked FROM asked GROUP BY query_id),
flagged AS (SELECT scored.*, asked, matched = asked AS full_match, count(*) FILTER (matched = asked) OVER (PARTITION BY query_id) AS full_n FROM scored JOIN n_asked USING (query_id))
SELECT query_id, doc_id, round(score, 6) AS score, CAST(r - 1 AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM flagged WHERE full_n < 2 OR asked < 2 OR full_match) WHERE r <= 2""")
def bm25_and_or(spark, d):
    """K5: all terms first, any term where that does not fill the list."""
    found = index_of(spark, d).bm25(_asked(spark, d), 2, whole=True)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}|[가-힣]{2,}')) AS term FROM documents) GROUP BY term")
def lexicon_counts(spark, d):
    """F8: occurrences of surface forms."""
    return lexical.lexicon(load(spark, d, "documents"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK.format('text')})) AS term FROM documents) GROUP BY term")
def chunk_df(spark, d):
    """documents per token."""
    return lexical.chunk_frequency(load(spark, d, "documents"))


@query("SELECT lang AS tag, count(*) AS n FROM documents GROUP BY lang")
def tag_counts(spark, d):
    """tags by documents."""
    from lodestone.operators import filters

    return filters.tag_counts(load(spark, d, "documents").select(F.array("lang").alias("tags")))


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS docs FROM documents GROUP BY source")
def body_length(spark, d):
    """characters per source."""
    return context.body_lengths(load(spark, d, "documents"), "source")


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("doc_id"), vx.as_double(F.col("embedding")).alias("vec"))


@query(f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v), 9) AS score FROM e q, e c WHERE q.vec_id % 100 = 0)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 10""")
def vector_topk(spark, d):
    """Nearest vectors of every query vector (ids divisible by 100)."""
    v = _vectors(spark, d)
    found = similarity.vector_topk(v, v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec"), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_E} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE round(list_dot_product(a.v, b.v), 12) >= 0.40")
def similar_pairs(spark, d):
    """E5: similar vectors of different groups."""
    return similarity.similar_pairs(_vectors(spark, d), 0.40).select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT label AS doc_id, dim, round(avg(x), 5) AS mean FROM (SELECT label::BIGINT AS label, unnest(range(len(embedding))) AS dim, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings) GROUP BY label, dim")
def doc_centroids(spark, d):
    """mean vector per document, one row a dimension."""
    c = vx.mean_vectors(_vectors(spark, d), "doc_id", "vec")
    return c.select("doc_id", F.posexplode("centroid").alias("dim", "mean")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("mean", 5).alias("mean"))


#: Chunks of each centroid's neighbourhood from which related documents are taken.
RELATED_WIDE = 200


@query(f"""WITH {_E}, m AS (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e) GROUP BY label, dim),
c AS (SELECT label, list(x ORDER BY dim) AS v FROM m GROUP BY label),
s AS (SELECT c.label::BIGINT AS query_id, e.label::BIGINT AS doc_id, round(list_dot_product(c.v, e.v) / sqrt(list_dot_product(c.v, c.v)), 9) AS score, e.vec_id FROM c, e),
near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {RELATED_WIDE})
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, doc_id) AS r FROM near WHERE doc_id <> query_id GROUP BY query_id, doc_id) WHERE r <= 3""")
def related_docs(spark, d):
    """Documents by their best chunk in the neighbourhood of each centroid."""
    v = _vectors(spark, d)
    out = similarity.related(v, vx.mean_vectors(v, "doc_id", "vec"), 3, wide=RELATED_WIDE)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


_LEGS = f"""{_TERMS}, bm AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored QUALIFY rank < 48),
recent AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM bm JOIN documents USING (doc_id)),
legs AS (SELECT query_id, doc_id, rank, 1.0::DOUBLE AS weight FROM recent UNION ALL SELECT query_id, doc_id, rank, 0.8::DOUBLE FROM bm),
fused AS (SELECT query_id, doc_id, round(sum(weight / (61 + rank)), 12) AS fused FROM legs GROUP BY query_id, doc_id)"""


def _fused(spark, d):
    docs = _docs(spark, d)
    # A few rows a query, which both legs start from.
    index = index_of(spark, d)
    bm = index.settle(index.bm25(_asked(spark, d), 48, two_phase=False))
    long = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), F.asc("chunk_id"))
    other = bm.join(docs.select("chunk_id", "n_chars"), "chunk_id").select("query_id", "chunk_id", (F.row_number().over(long) - 1).alias("rank"), F.lit(1.0).alias("weight"))
    return fusion.rrf(other.unionByName(bm.select("query_id", "chunk_id", "rank", F.lit(0.8).alias("weight"))))


@query(f"""WITH {_LEGS} SELECT query_id, doc_id, round(fused, 9) AS fused, CAST(r - 1 AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS r FROM fused) WHERE r <= 8""")
def rrf_hybrid(spark, d):
    """K6, F16: weighted reciprocal rank fusion of two legs."""
    top = lexical.top_k(_fused(spark, d), 8, "chunk_id", by="fused")
    return top.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("fused", 9).alias("fused"), "rank")


@query(f"""WITH {_LEGS}, s AS (SELECT f.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY fused DESC, doc_id) AS n FROM fused f JOIN documents USING (doc_id))
SELECT query_id, doc_id, source, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS r FROM s WHERE n <= 3) WHERE r <= 8""")
def rrf_capped(spark, d):
    """At most three hits of a source, then the eight best."""
    hits = _fused(spark, d).join(_docs(spark, d).select("chunk_id", F.col("source").alias("doc_id")), "chunk_id")
    return fusion.capped_top_k(hits, 8).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("source"), "rank")


@query(f"""WITH {_ranking("SELECT 0 AS query_id, 0 AS v, '' AS t", f"SELECT unnest({_CONTENT.format('text')}) FROM documents")}, {_VDF},
t AS (SELECT doc_id, unnest({_CONTENT.format('text')}) AS term FROM documents), k AS (SELECT x.doc_id, {_WITH_DF.format("t")})
SELECT doc_id, round(count(*) FILTER (df <= ceiling) / count(*)::DOUBLE, 6) AS rare FROM k, stats GROUP BY doc_id""")
def rarity_rerank(spark, d):
    """Share of rare content tokens per document."""
    index = index_of(spark, d)
    docs = _docs(spark, d).where(F.size(tx.content_tokens(F.col("text"))) > 0)
    return fusion.rare_share(docs, index.term_frequencies, index.n, ["doc_id"]).select("doc_id", F.round("rare", 6).alias("rare"))


@query(f"""WITH {_TERMS}, top AS (SELECT query_id, doc_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 8),
lex AS (SELECT term AS token, count(*) AS seen FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}|[가-힣]{{2,}}')) AS term FROM documents) GROUP BY term),
qt AS (SELECT item_id AS query_id, {_CONTENT.format('text')} AS ts FROM benchmark),
w AS (SELECT query_id, token, 1 / (1 + ln(1 + coalesce(seen, 3))) AS w FROM (SELECT query_id, unnest(ts) AS token FROM qt WHERE len(ts) >= 4) LEFT JOIN lex USING (token)),
body AS (SELECT query_id, doc_id, lower(text || ' ' || source) AS body FROM top JOIN documents USING (doc_id))
SELECT query_id, doc_id, round(sum(CASE WHEN contains(body, token) OR (regexp_matches(token, '[가-힣]') AND ((length(token) >= 3 AND contains(body, left(token, length(token) - 1))) OR (length(token) >= 5 AND contains(body, left(token, length(token) - 2))))) THEN w ELSE 0 END) / sum(w), 6) AS cover
FROM w JOIN body USING (query_id) GROUP BY query_id, doc_id""")
def coverage_gate(spark, d):
    """Weighted share of a query's tokens in its best documents."""
    index = index_of(spark, d)
    top = index.bm25(_asked(spark, d), 8, two_phase=False)
    hits = top.join(index.chunks.select("chunk_id", "text", "title"), "chunk_id")
    return fusion.coverage(_asked(spark, d), hits, index.lexicon).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("cover", 6).alias("cover"))


@query("SELECT doc_id, source, CAST(r AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source IN ('src1', 'src2')) WHERE r <= 5")
def scope_listing(spark, d):
    """Folders OR-ed, listed by size per tag."""
    from lodestone.operators import filters

    scope = filters.parse_operators(F.lit("folder:src1 path:src2"))
    docs = _docs(spark, d).withColumn("scope", scope)
    inside = docs.where(filters.in_scope(F.col("scope"), F.array("lang"), F.concat_ws("/", "source", F.col("doc_id").cast("string"))))
    n = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return inside.withColumn("n", n).where("n <= 5").select("doc_id", "source", "n")


_DAYS = "(epoch(anchor) - epoch(ts)) / 86400.0::DOUBLE"


@query(f"""WITH a AS (SELECT max(ts) AS anchor FROM events)
SELECT event_id, round(value * (1 + 0.6::DOUBLE * pow(0.5::DOUBLE, floor({_DAYS} / 7) * 7 / 21.0::DOUBLE)), 6) AS score FROM events, a""")
def recency_weighting(spark, d):
    """Values raised by vague recency from the newest event."""
    ev = load(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    anchor = ev.agg(F.max("s").alias("anchor"))
    rows = ev.crossJoin(anchor)  # one row
    intent = F.struct(F.lit(True).alias("recent"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    return rows.select("event_id", F.round(F.col("value") * fusion.recency_factor(F.col("s"), intent, tm.recency_weight(F.col("s"), F.col("anchor"))), 6).alias("score"))


@query("""WITH w AS (SELECT o_orderkey AS query_id, epoch(o_orderdate) AS lo FROM orders WHERE o_orderkey % 100 = 0), m AS (SELECT min(epoch(ts)) AS first FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (epoch(ts) >= first AND epoch(ts) < first + 604800) AS first_week FROM events, m GROUP BY event_type""")
def temporal_window_leg(spark, d):
    """Events inside a half-open window from the first one."""
    ev = load(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = ev.crossJoin(ev.agg(F.min("s").alias("first")))  # one row
    inside = sync.within("s", F.col("first"), F.col("first") + 604800)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(inside).alias("first_week"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def event_ring(spark, d):
    """The newest thousand events."""
    return sync.ring(load(spark, d, "events")).select("event_id", "user_id", "event_type")


@query("SELECT user_id AS client, count(*) AS events, count(*) FILTER (event_type = 'click') AS queries, count(*) FILTER (event_type = 'purchase') AS writes, max(ts) AS last FROM events GROUP BY user_id")
def client_stats(spark, d):
    """Counters per client."""
    kind = F.when(F.col("event_type") == "click", "query").when(F.col("event_type") == "purchase", "write").otherwise(F.col("event_type"))
    return memory.client_stats(load(spark, d, "events").select(F.col("user_id").alias("client"), kind.alias("kind"), "ts"))


@query("SELECT user_id AS doc_id, count(*) AS hits, max(ts) AS last_hit FROM events GROUP BY user_id")
def hit_stats(spark, d):
    """Hits and last hit."""
    return memory.hit_stats(load(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts"))


@query("""WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""")
def activity_runs(spark, d):
    """Runs of equal events per user."""
    return sync.runs(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT conv_id, turn, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def adjacent_turns(spark, d):
    """Texts of the neighbours."""
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    return context.adjacent(turns).select("chunk_id.conv_id", "chunk_id.turn", "before", "after")


_ANAPHORA = ", ".join(f"'{w}'" for w in context.ANAPHORA)


@query(f"""WITH a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS u, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS s
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, CASE WHEN (length(trim(text)) <= 16 OR list_bool_or(list_transform([{_ANAPHORA}], lambda x: starts_with(trim(text), x) OR contains(' ' || trim(text), ' ' || x)))) AND (u IS NOT NULL OR s IS NOT NULL)
THEN concat_ws(' ', left(u, 160), left(s, 160), text) ELSE text END AS query FROM a WHERE role = 'user'""")
def contextual_query(spark, d):
    """Short or pointing turns with the last user and assistant turns in front."""
    return context.contextual_queries(load(spark, d, "conversations"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS "case", count(*) AS fragments, count(*) FILTER (o_orderstatus = 'O') AS open_errors, max(epoch(o_orderdate)) AS last_touched,
arg_max(o_orderpriority, epoch(o_orderdate) * 1e8 + o_orderkey) AS phase FROM orders GROUP BY o_custkey""")
def case_rollup(spark, d):
    """Fragments, open errors, last change and phase per case."""
    o = load(spark, d, "orders")
    open_ = F.col("o_orderstatus") == "O"
    rows = o.select(F.col("o_custkey").cast("string").alias("case"), F.when(open_, "error").otherwise("fact").alias("type"), F.lit(None).cast("string").alias("status"), F.col("o_orderpriority").alias("phase"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ts"), F.col("o_orderkey").alias("doc_id"))
    return memory.case_rollup(rows)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS "case", count(*) AS entries, count(*) FILTER (o_orderstatus = 'O') AS errors, arg_max(o_orderkey, epoch(o_orderdate) * 1e8 + o_orderkey) AS newest FROM orders GROUP BY o_custkey""")
def case_resume(spark, d):
    """The sorted timeline of a case, summarised."""
    o = load(spark, d, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("case"), F.when(F.col("o_orderstatus") == "O", "error").otherwise("episode").alias("type"), F.lit("").alias("status"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ts"), F.col("o_orderkey").alias("doc_id"), F.lit("").alias("content"), F.array(F.col("o_orderpriority")).alias("next_steps"))
    out = memory.resume_case(rows, timeline=1 << 20)
    return out.select("case", F.size("timeline").cast("long").alias("entries"), F.size("errors").cast("long").alias("errors"), F.element_at("timeline", -1)["doc_id"].alias("newest"))


@query(f"""WITH t AS (SELECT item_id, {_CONTENT.format('text')} AS ts FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts)))::DOUBLE, 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.ts, b.ts)) > 0""")
def jaccard_pairs(spark, d):
    """Token overlap of the benchmark items that share a token."""
    out = lexical.overlapping(load(spark, d, "benchmark"), "item_id")
    return out.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(r"""SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '\d{4}[-./년]\s?\d{1,2}[-./월]\s?\d{1,2}일?|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}년', ' ', 'g'), '\d+(?:[.,]\d+)*'), lambda n: replace(n, ',', '')))) AS BIGINT) AS n_numbers,
contains(' ' || lower(text) || ' ', ' not ') OR contains(lower(text), 'n''t') OR contains(' ' || lower(text) || ' ', ' no ') OR contains(' ' || lower(text) || ' ', ' never ') AS negated FROM documents""")
def number_negation(spark, d):
    """Numbers and negation as conflict evidence."""
    return load(spark, d, "documents").select("doc_id", F.size(tx.numbers(F.col("text"))).cast("long").alias("n_numbers"), tx.has_negation(F.col("text")).alias("negated"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS d FROM lineitem), p AS (SELECT a.d AS src, b.d AS dst, count(*) AS shared FROM m a JOIN m b ON a.e = b.e AND a.d < b.d GROUP BY ALL HAVING count(*) >= 2)
SELECT src, dst, shared, round(least(1.0, 0.4 + 0.15 * shared)::DOUBLE, 6) AS weight FROM p""")
def co_mention_edges(spark, d):
    """Parts that share two orders or more; `co_mention_edges_all` has every pair."""
    out = graph.co_mention_edges(load(spark, d, "lineitem"), "l_orderkey", "l_partkey", least=2)
    return out.select("src", "dst", "shared", F.round("weight", 6).alias("weight"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS d FROM lineitem), p AS (SELECT a.d AS src, b.d AS dst, count(*) AS shared FROM m a JOIN m b ON a.e = b.e AND a.d < b.d GROUP BY ALL)
SELECT src, dst, shared, round(least(1.0, 0.4 + 0.15 * shared)::DOUBLE, 6) AS weight FROM p""")
def co_mention_edges_all(spark, d):
    """Parts that share orders, an edge for every pair that shares one."""
    out = graph.co_mention_edges(load(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return out.select("src", "dst", "shared", F.round("weight", 6).alias("weight"))


def _edges(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 10_000_000_000).alias("dst"), F.lit(1.0).alias("weight"))


_EDGES = "e AS (SELECT o_orderkey AS src, o_custkey + 10000000000 AS dst FROM orders), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


@query(f"WITH {_EDGES} SELECT src AS seed, dst AS neighbor, 1.0::DOUBLE AS weight FROM b WHERE src % 100 = 0 GROUP BY ALL")
def undirected_neighbors(spark, d):
    """Neighbours of a set of seeds in both directions."""
    e = _edges(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("doc_id")).where("doc_id % 100 = 0")
    return graph.neighbors(e, ends)


@query(f"WITH {_EDGES} SELECT src AS doc_id, count(*) AS degree FROM b GROUP BY src")
def degree_hubs(spark, d):
    """Degree of every node."""
    return graph.degrees(_edges(spark, d))


@query(f"""WITH {_EDGES}, deg AS (SELECT src, count(*) AS deg FROM b GROUP BY src), pull AS (SELECT b.src, b.dst, 0.55::DOUBLE / sqrt(greatest(1.0, deg / 8.0)) AS pull FROM b JOIN deg USING (src)),
seed AS (SELECT src, 1.0::DOUBLE AS gain FROM (SELECT DISTINCT src FROM b WHERE src % 100 = 0)),
one AS (SELECT pull.dst AS n, max(gain * pull) AS gain FROM seed JOIN pull USING (src) GROUP BY ALL),
two AS (SELECT pull.dst AS n, max(gain * pull) AS gain FROM one JOIN pull ON one.n = pull.src WHERE one.n NOT IN (SELECT src FROM seed) GROUP BY ALL)
SELECT n AS doc_id, round(max(gain), 6) AS gain FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY n""")
def two_hop_gain(spark, d):
    """L1: damped gains of neighbours over two hops, merged by maximum."""
    e = _edges(spark, d)
    seeds = e.select(F.explode(F.array("src", "dst")).alias("doc_id")).where("doc_id % 100 = 0").distinct()
    out = graph.gains(seeds.select(F.lit(0).alias("query_id"), "doc_id", F.lit(1.0).alias("best")), e, hops=2, seeds=1 << 30)
    return out.select("doc_id", F.round("gain", 6).alias("gain"))


@query("SELECT l.doc_id FROM documents d RIGHT JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id + 1 WHERE d.doc_id IS NULL")
def anti_broken_links(spark, d):
    """References whose target does not exist."""
    ids = load(spark, d, "documents").select(F.col("doc_id").alias("target"))
    return load(spark, d, "labels").select("doc_id").join(ids, F.col("doc_id") + 1 == F.col("target"), "left_anti")


@query("""WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), new AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 3)
SELECT coalesce(old.doc_id, new.doc_id)::VARCHAR AS path, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' WHEN old.h <> new.h THEN 'updated' ELSE 'unchanged' END AS change FROM old FULL JOIN new USING (doc_id)""")
def sync_diff(spark, d):
    """What a sync would change between two states of a table."""
    docs = load(spark, d, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    m = F.col("doc_id") % 10
    old = docs.where(m != 1).select(path, tx.content_hash(F.col("text")).alias("content_hash"))
    new = docs.where(m != 3).select(path, tx.content_hash(F.when(m == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return sync.changes(old, new)


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    """Content hashes."""
    return load(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 14000")
def context_budget(spark, d):
    """Rows before a running budget is exceeded."""
    rows = load(spark, d, "documents").withColumn("size", F.length("text"))
    return context.within_budget(rows, "source", "doc_id", "size", context.BUDGET).select("doc_id", "used")


_RANKED = f"""{_E}, q AS (SELECT * FROM e WHERE vec_id % 100 = 0), r AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, CAST(q.label = c.label AS INTEGER) AS relevant,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.vec_id) - 1 AS rank FROM q JOIN e c ON c.vec_id <> q.vec_id QUALIFY rank < 20)"""


def _ranked(spark, d):
    v = _vectors(spark, d)
    found = similarity.vector_topk(v, v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec"), 21).where("chunk_id <> query_id")
    found = lexical.top_k(found.drop("rank"), 20, "chunk_id")
    of = v.select("chunk_id", "doc_id")
    found = found.join(of, "chunk_id").join(of.select(F.col("chunk_id").alias("query_id"), F.col("doc_id").alias("own")), "query_id")
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), "rank", (F.col("doc_id") == F.col("own")).cast("int").alias("relevant"))


@query(f"""WITH {_RANKED}, p AS (SELECT query_id, max(CASE WHEN relevant = 1 AND rank < 10 THEN 1.0::DOUBLE / (rank + 1) END) AS rr FROM r GROUP BY query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN rr IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS recall, round(avg(coalesce(rr, 0)), 6) AS mrr FROM p""")
def recall_mrr(spark, d):
    """Q1: recall and mean reciprocal rank of vector search for equal labels."""
    return evaluation.recall_mrr(_ranked(spark, d))


@query(f"""WITH {_RANKED}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS i, row_number() OVER (PARTITION BY query_id ORDER BY relevant DESC, doc_id) - 1 AS b FROM r)
SELECT query_id, round(CASE WHEN sum(CASE WHEN b < 10 THEN relevant / log2(b + 2.0) ELSE 0 END) > 0 THEN sum(CASE WHEN i < 10 THEN relevant / log2(i + 2.0) ELSE 0 END) / sum(CASE WHEN b < 10 THEN relevant / log2(b + 2.0) ELSE 0 END) ELSE 0 END, 6) AS ndcg FROM s GROUP BY query_id""")
def ndcg_at_k(spark, d):
    """NDCG at ten of vector search."""
    return evaluation.ndcg(_ranked(spark, d).withColumnRenamed("relevant", "relevance"))


@query(f"""WITH {_RANKED}, gold AS (SELECT q.vec_id AS query_id, min(c.vec_id) AS doc_id FROM q JOIN e c ON q.label = c.label AND c.vec_id <> q.vec_id GROUP BY q.vec_id)
SELECT g.query_id, count(r.doc_id) AS found, count(*) AS wanted, count(r.doc_id) = count(*) AS "full" FROM gold g LEFT JOIN r ON r.query_id = g.query_id AND r.doc_id = g.doc_id AND r.rank < 8 GROUP BY g.query_id""")
def full_support(spark, d):
    """Q2: whether the gold document is among the first eight."""
    v = _vectors(spark, d)
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "doc_id")
    gold = q.join(v, "doc_id").where("chunk_id <> query_id").groupBy("query_id").agg(F.min("chunk_id").alias("doc_id"))
    return evaluation.full_support(_ranked(spark, d), gold)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    """A field of the event details."""
    return load(spark, d, "events").select("event_id", sync.detail("k").try_cast("long").alias("k"))


@query("""SELECT source, count(*) AS n, CAST(greatest(count(*) - 8, 0) AS BIGINT) AS more FROM documents GROUP BY source""")
def folder_tree(spark, d):
    """Newest titles per folder and how many are left out."""
    notes = load(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("title"), F.col("n_chars").cast("double").alias("mtime"))
    return context.tree(notes).select(F.col("dir").alias("source"), "n", "more")


@query("SELECT item_id, length(regexp_replace(text, '\\s+', '', 'g')) AS squashed, round(length(text) * 0.25, 6)::DOUBLE AS tokens FROM benchmark")
def text_measures(spark, d):
    """Squashed length and approximate model tokens."""
    t = F.col("text")
    return load(spark, d, "benchmark").select("item_id", F.length(tx.squash(t)).cast("long").alias("squashed"), F.round(tx.approx_model_tokens(t), 6).alias("tokens"))


_TYPO = """
  lexi AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}|[가-힣]{2,}')) AS term FROM documents) GROUP BY term),
  parts AS (SELECT query_id, unnest(l) AS part, generate_subscripts(l, 1) AS pos FROM (SELECT item_id AS query_id, regexp_extract_all(text, '[A-Za-z]+|[가-힣]+|[^A-Za-z가-힣]+') AS l FROM benchmark)),
  unk AS (SELECT DISTINCT lower(part) AS word FROM parts WHERE regexp_matches(part, '^[A-Za-z]{4,}$') AND lower(part) NOT IN (SELECT term FROM lexi)),
  near AS (SELECT word, term, n, levenshtein(word, term) AS dist, CASE WHEN length(word) <= 5 THEN 1 ELSE 2 END AS cap FROM unk JOIN lexi ON left(word, 1) = left(term, 1) AND abs(length(word) - length(term)) <= 2),
  fix AS (SELECT word, term AS fixed FROM near WHERE dist <= cap QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, n DESC, term) = 1),
  mended AS (SELECT query_id, string_agg(coalesce(fixed, part), '' ORDER BY pos) AS corrected FROM parts LEFT JOIN fix ON fix.word = lower(part) GROUP BY query_id)"""


@query(f"WITH {_TYPO} SELECT item_id AS query_id, text, corrected FROM benchmark JOIN mended ON item_id = query_id")
def typo_fix(spark, d):
    """Benchmark items with unknown words replaced by the nearest known ones."""
    return lexical.correct_typos(_asked(spark, d), index_of(spark, d).lexicon)


@query()
def chunk_udtf(spark, d):
    """Documents cut into chunks."""
    from lodestone.sources import notes

    docs = load(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    return notes.chunk_notes(docs)


#: Of 16 lists, as many are searched by ann_topk; its test measures the recall of just these.
ANN_PROBES = 12


@query()
def ann_topk(spark, d):
    """K3, K4, H2: approximate nearest vectors through inverted lists."""
    v = _vectors(spark, d)
    return similarity.InvertedLists(v, lists=16).search(v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec"), 10, probes=ANN_PROBES).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 6) AS score FROM e q, e c WHERE q.vec_id % 100 = 0)
SELECT query_id, count(*) AS n, count(*) FILTER (r = 1) AS firsts, round(sum(score), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 10 GROUP BY query_id""")
def ann_all_lists(spark, d):
    """K3, K4, H2: with all lists probed byte codes and rescoring give the scores of the exact nearest vectors."""
    v = _vectors(spark, d)
    lists = similarity.InvertedLists(v, lists=16)
    found = lists.search(v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec"), 10, probes=16, digits=12)
    # Best first, as the SQL's window hands them on: a sum that ends in a five may fall on either side by its order.
    total = F.aggregate(F.sort_array(F.collect_list(F.round("score", 6)), asc=False), F.lit(0.0), lambda s, x: s + x)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 0).alias("firsts"), vx.rounded(total, 4).alias("total"))


@query()
def curriculum(spark, d):
    """Reading order of the hits of each query vector."""
    v = _vectors(spark, d)
    hits = similarity.vector_topk(v, v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec"), 8).join(v.select("chunk_id", "vec"), "chunk_id")
    return context.curriculum(hits)


_DIM = "(('0x' || substr(md5(term), 1, 4))::INTEGER % 64)"
_SIGN = "(CASE WHEN substr(md5(term), 5, 1) >= '8' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
_QWORDS = ", ".join(f"'{w}'" for w in tx.QUESTION_WORDS)
_V = "SELECT query_id, 0 AS v, text AS t FROM q UNION ALL SELECT query_id, 1, lex FROM q WHERE lex <> text"
_SEARCH = f"""{_TYPO},
  q AS (SELECT query_id, trim(text) AS text, corrected AS lex, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) <= 4 AND NOT list_bool_or(list_transform([{_QWORDS}], lambda w: contains(lower(text), w))) AS keyword FROM mended JOIN benchmark ON item_id = query_id),
  qt AS (SELECT query_id, {_CONTENT.format('lex')} AS ts FROM q),
  cut AS (SELECT query_id, token, c AS cut, left(token, length(token) - c::INTEGER) AS term FROM (SELECT query_id, unnest(ts) AS token FROM qt), range(3) r(c) WHERE length(token) >= c + 2),
  {_ranking(_V, f"SELECT term FROM cut UNION SELECT unnest({_CONTENT.format('text')}) FROM documents")}, {_VDF},
  n_asked AS (SELECT query_id, v, count(*) AS wanted FROM asked GROUP BY query_id, v),
  flagged AS (SELECT scored.*, wanted, matched = wanted AS full_match, count(*) FILTER (matched = wanted) OVER (PARTITION BY query_id, v) AS full_n FROM scored JOIN n_asked USING (query_id, v)),
  bm AS (SELECT query_id, v, doc_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, doc_id) - 1 AS rank FROM flagged WHERE full_n < 48 OR wanted < 2 OR full_match QUALIFY rank < 48),
  per AS (SELECT query_id, token, max(CASE WHEN cut < 2 THEN coalesce(df, 0) END) AS short, max(coalesce(df, 0)) AS long FROM (SELECT x.query_id, x.token, x.cut, {_WITH_DF.format('cut')}) GROUP BY query_id, token),
  flags AS (SELECT q.query_id, coalesce(bool_and(short > floor), false) AS all_common, coalesce(bool_and(long > floor) FILTER (long > 0), false) AS none_telling FROM q LEFT JOIN per USING (query_id), stats GROUP BY q.query_id),
  dv AS (SELECT doc_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, {_DIM} AS dim, sum({_SIGN}) AS x FROM (SELECT doc_id, w AS term FROM flat) GROUP BY ALL)),
  qv AS (SELECT query_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM (SELECT query_id, {_DIM} AS dim, sum({_SIGN}) AS x FROM (SELECT query_id, unnest({_FOLD.format('text')}) AS term FROM q) GROUP BY ALL)),
  near0 AS (SELECT query_id, doc_id, round(sum(qv.x * dv.x), 9) AS score FROM qv JOIN dv USING (dim) GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 48),
  rare AS (SELECT doc_id, count(*) FILTER (df <= ceiling) / count(*)::DOUBLE AS rare FROM (SELECT x.doc_id, {_WITH_DF.format('(SELECT doc_id, unnest(' + _CONTENT.format('text') + ') AS term FROM documents WHERE doc_id IN (SELECT doc_id FROM near0))')}), stats GROUP BY doc_id),
  vec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN all_common OR none_telling THEN round(score * (1 + 0.6::DOUBLE * coalesce(rare, 0)), 9) ELSE score END DESC, doc_id) - 1 AS rank FROM near0 JOIN flags USING (query_id) LEFT JOIN rare USING (doc_id)),
  w AS (SELECT query_id, token, 1 / (1 + ln(1 + coalesce(lexi.n, 3))) AS w FROM (SELECT query_id, unnest(ts) AS token FROM qt WHERE len(ts) >= 4) JOIN q USING (query_id) JOIN flags USING (query_id) LEFT JOIN lexi ON lexi.term = token WHERE NOT keyword AND NOT all_common),
  body AS (SELECT query_id, doc_id, rank, lower(concat_ws(' ', text, source)) AS body FROM bm JOIN documents USING (doc_id) WHERE v = 0 AND rank < 8),
  cover AS (SELECT query_id, doc_id, rank, sum(CASE WHEN contains(body, token) OR (regexp_matches(token, '[가-힣]') AND ((length(token) >= 3 AND contains(body, left(token, length(token) - 1))) OR (length(token) >= 5 AND contains(body, left(token, length(token) - 2))))) THEN w ELSE 0 END) / sum(w) AS cover FROM w JOIN body USING (query_id) GROUP BY query_id, doc_id, rank),
  best AS (SELECT query_id, max(cover) AS best FROM cover GROUP BY query_id HAVING max(cover) > 0),
  pinned AS (SELECT query_id, doc_id, best FROM cover JOIN best USING (query_id) WHERE cover >= least(0.8 * best, 0.65::DOUBLE) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cover, 12) DESC, rank) = 1),
  lean AS (SELECT query_id, CASE WHEN keyword OR best >= 0.6 THEN 2.4::DOUBLE WHEN all_common THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS factor, best FROM q JOIN flags USING (query_id) LEFT JOIN pinned USING (query_id)),
  tickets AS (SELECT query_id, doc_id, rank, 0.8::DOUBLE * CASE WHEN v = 1 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * factor AS weight FROM bm JOIN lean USING (query_id) UNION ALL SELECT query_id, doc_id, rank, 1.0::DOUBLE FROM vec),
  pins AS (SELECT query_id, doc_id, max(pin) AS pin FROM (SELECT query_id, doc_id, 3.5::DOUBLE AS pin FROM pinned WHERE best >= 0.65 UNION ALL SELECT query_id, bm.doc_id, 2 + 1.0::DOUBLE / (1 + rank) FROM bm JOIN lean USING (query_id) WHERE v = 0 AND rank < 3 AND best >= 0.65) GROUP BY ALL),
  summed AS (SELECT query_id, doc_id, round(sum(weight / (61 + rank)), 12) AS s FROM tickets GROUP BY query_id, doc_id),
  fused AS (SELECT query_id, doc_id, round(coalesce(pin, s) + CASE WHEN len(list_filter(ts, lambda t: t = source OR (starts_with(t, source) AND length(t) <= length(source) + 2))) > 0 THEN 0.12::DOUBLE / len(ts) ELSE 0 END, 12) AS fused, source FROM summed LEFT JOIN pins USING (query_id, doc_id) JOIN qt USING (query_id) JOIN documents USING (doc_id))"""


@query(f"""WITH {_SEARCH}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY fused DESC, doc_id) AS nth FROM fused)
SELECT query_id, doc_id AS chunk_id, source AS doc_id, round(fused, 6) AS fused, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS r FROM s WHERE nth <= 3) WHERE r <= 8""")
def hybrid_search(spark, d):
    """The whole search over documents with a hashed embedding."""
    from lodestone.sources import notes

    asked = notes.hashed_embedding(_asked(spark, d), "text")
    return search.search(index_of(spark, d, dense=True), asked).select("query_id", "chunk_id", "doc_id", F.round("fused", 6).alias("fused"), "rank")
