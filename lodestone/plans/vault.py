"""Operators on notes, links, memory and states, bound to notes that are made from the driver's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import temporal as tm
from lodestone.functions import text as tx
from lodestone.functions import vector as vx
from lodestone.operators import context, filters, fusion, graph, memory, search, similarity, states
from lodestone.plans.catalog import _CONTENT, _E, _TERMS, _TOK, _asked, _vectors, query
from lodestone.plans.stems import stem_ctes
from lodestone.plans.store import index_of
from lodestone.sources.tables import load
from lodestone.streaming import sync

#: A time that counts as now, and the day of the first note.
NOW = 1_700_000_000.0
FIRST = 1_600_000_000

# Notes made of documents: titles and aliases are numbered, links and mentions name numbers, some of which no note has.
_NOTES = f"""notes AS (SELECT doc_id, source || '/note-' || doc_id || '.md' AS path, 'note ' || doc_id AS title, 'alias ' || doc_id AS alias, source, lang,
  ['Note ' || ((doc_id * 7) % 1500), 'ALIAS ' || ((doc_id * 3) % 1500)] AS wikilinks, coalesce(text, '') || ' See note ' || ((doc_id * 11) % 1500) || '.' AS body,
  ({FIRST} + doc_id * 3600)::DOUBLE AS mtime, ({FIRST} + doc_id * 86400)::DOUBLE AS doc_date FROM documents),
names AS (SELECT name, max(doc_id) AS doc_id FROM (SELECT title AS name, doc_id FROM notes UNION ALL SELECT alias, doc_id FROM notes) GROUP BY name),
wiki AS (SELECT DISTINCT n.doc_id AS src, t.doc_id AS dst FROM (SELECT doc_id, lower(unnest(wikilinks)) AS name FROM notes) n JOIN names t USING (name) WHERE n.doc_id <> t.doc_id),
mention AS (SELECT DISTINCT n.doc_id AS src, t.doc_id AS dst FROM notes n JOIN notes t ON t.doc_id = (n.doc_id * 11) % 1500 WHERE t.doc_id <> n.doc_id),
links AS (SELECT src, dst, 'wiki' AS kind, 1.0::DOUBLE AS weight FROM wiki UNION ALL SELECT src, dst, 'mention', 0.85::DOUBLE FROM mention ANTI JOIN wiki USING (src, dst))"""


def _notes(spark, d) -> DataFrame:
    docs = load(spark, d, "documents")
    number = lambda word, by: F.concat(F.lit(word), ((F.col("doc_id") * by) % 1500).cast("string"))
    front = F.create_map(
        F.lit("type"), F.array("lang"), F.lit("status"), F.array(F.when(F.col("doc_id") % 3 == 0, "open").otherwise("done")),
        F.lit("lodestone"), F.array(F.when(F.col("doc_id") % 10 == 0, "false").otherwise("true")),
        F.lit("possible_duplicate_of"), F.when(F.col("doc_id") % 5 == 0, F.array(F.concat(F.lit("[["), number("Note ", 13), F.lit("]]")))).otherwise(F.array().cast("array<string>")),
    )
    return docs.select(
        "doc_id",
        F.concat("source", F.lit("/note-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("title"),
        F.array(F.concat(F.lit("alias "), F.col("doc_id").cast("string"))).alias("aliases"),
        F.array("lang", "source").alias("tags"),
        F.array(number("Note ", 7), number("ALIAS ", 3)).alias("wikilinks"),
        front.alias("frontmatter"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" See "), number("note ", 11), F.lit(".")).alias("body"),
        (F.lit(FIRST) + F.col("doc_id") * 3600).cast("double").alias("mtime"),
        (F.lit(FIRST) + F.col("doc_id") * 86400).cast("double").alias("doc_date"),
    )


@query(f"WITH {_NOTES} SELECT src, dst, kind, weight FROM links")
def note_links(spark, d):
    """Wikilinks resolved by title and alias, and mentions where there is no link."""
    return graph.links(_notes(spark, d))


@query(r"""WITH names AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[2:4], ' ') AS name FROM benchmark),
met AS (SELECT d.doc_id AS src, n.name FROM documents d JOIN (SELECT DISTINCT name FROM names WHERE length(name) >= 6) n ON contains(lower(d.text), n.name) WHERE regexp_matches(lower(d.text), '(^|[^a-z0-9_])' || n.name || '($|[^a-z0-9_])'))
SELECT DISTINCT src, -1 - item_id AS dst FROM met JOIN (SELECT name, max(item_id) AS item_id FROM names GROUP BY name) USING (name)""")
def passage_mentions(spark, d):
    """Whole texts of documents that name words of a benchmark item on word boundaries."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 2, 3)
    names = load(spark, d, "benchmark").groupBy(F.array_join(words, " ").alias("name")).agg((-1 - F.max("item_id")).alias("doc_id"))
    return graph.mention_edges(load(spark, d, "documents"), "text", names).select("src", "dst")


@query(f"WITH {_NOTES} SELECT src AS doc_id, 'out' AS direction, dst AS other, title, kind FROM links JOIN notes ON doc_id = dst UNION ALL SELECT dst, 'in', src, title, kind FROM links JOIN notes ON doc_id = src")
def linked_notes(spark, d):
    """A note's links out and in with the titles at their ends."""
    notes = _notes(spark, d)
    return graph.linked_notes(graph.links(notes), notes)


@query(f"WITH {_NOTES} SELECT n.doc_id, (SELECT count(*) FROM links WHERE src = n.doc_id) AS links_out, (SELECT count(*) FROM links WHERE dst = n.doc_id) AS links_in FROM notes n")
def link_counts(spark, d):
    """links out of and into every note, those without any included."""
    notes = _notes(spark, d)
    return graph.link_counts(notes, graph.links(notes))


@query(f"WITH {_NOTES}, deg AS (SELECT doc_id, count(*) AS degree FROM (SELECT src AS doc_id FROM links UNION ALL SELECT dst FROM links) GROUP BY doc_id) SELECT doc_id, degree FROM deg ORDER BY degree DESC, doc_id LIMIT 6")
def hub_notes(spark, d):
    """H6: the six notes with most links."""
    return graph.hubs(graph.links(_notes(spark, d)), 6)


@query(f"""WITH {_NOTES}, named AS (SELECT doc_id, unnest(wikilinks) AS detail FROM notes)
SELECT 'broken_link' AS kind, doc_id, detail FROM named WHERE lower(detail) NOT IN (SELECT name FROM names)
UNION SELECT 'duplicate', doc_id, '[[Note ' || ((doc_id * 13) % 1500) || ']]' FROM notes WHERE doc_id % 5 = 0 AND 'note ' || ((doc_id * 13) % 1500) IN (SELECT name FROM names)""")
def vault_drift(spark, d):
    """Links to no note, missing files, and duplicate flags whose note still exists."""
    return memory.drift(_notes(spark, d), each=None)


@query(f"WITH {_NOTES} SELECT src, dst, weight, CASE WHEN contains(lower(n.body), t.title) THEN true ELSE false END AS holds FROM links JOIN notes n ON n.doc_id = src JOIN notes t ON t.doc_id = dst WHERE kind = 'mention'")
def link_suggestions(spark, d):
    """Mentions without a link, with the sentence that mentions."""
    notes = _notes(spark, d)
    out = graph.suggestions(notes, graph.links(notes))
    return out.join(notes.select(F.col("doc_id").alias("dst"), "title"), "dst").select("src", "dst", "weight", F.coalesce(F.contains(F.lower("sentence"), F.col("title")), F.lit(False)).alias("holds"))


@query(f"""WITH {_NOTES}, pairs AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, kind, max(weight) AS weight FROM links GROUP BY ALL),
top AS (SELECT doc_id FROM notes LEFT JOIN (SELECT doc_id, count(*) AS degree FROM (SELECT src AS doc_id FROM links UNION ALL SELECT dst FROM links) GROUP BY doc_id) USING (doc_id) ORDER BY coalesce(degree, 0) DESC, doc_id LIMIT 300)
SELECT src, dst, kind, weight FROM pairs WHERE src IN (SELECT doc_id FROM top) AND dst IN (SELECT doc_id FROM top)""")
def graph_export(spark, d):
    """The 300 notes of highest degree and the links among them."""
    notes = _notes(spark, d)
    return graph.export(notes, graph.links(notes), 300)[1]


@query(f"WITH {_NOTES}, stubs AS (SELECT * FROM notes WHERE length(body) < 400) SELECT doc_id, 'lodestone: ' || CASE WHEN doc_id % 10 = 0 THEN 'false' ELSE 'true' END AS flag FROM stubs")
def stub_enrichment(spark, d):
    """What short notes get from their properties and the notes that link to them."""
    notes = _notes(spark, d)
    out = graph.stub_enrichment(notes, graph.links(notes))
    return out.select("doc_id", F.regexp_extract("text", r"lodestone: \w+", 0).alias("flag"))


# -- scopes and listings


@query(f"""WITH {_TERMS}, n_asked AS (SELECT query_id, count(*) AS wanted FROM asked GROUP BY query_id),
inside AS (SELECT scored.* FROM scored JOIN documents USING (doc_id) WHERE query_id % 2 = 1 OR (source = 'src1' AND lang = 'en')),
flagged AS (SELECT inside.*, wanted, matched = wanted AS full_match, count(*) FILTER (matched = wanted) OVER (PARTITION BY query_id) AS full_n FROM inside JOIN n_asked USING (query_id))
SELECT query_id, doc_id AS chunk_id, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM flagged WHERE full_n < 48 OR wanted < 2 OR full_match) WHERE r <= 8""")
def scoped_search(spark, d):
    """Every second query scoped to a folder and a tag before anything is ranked."""
    asked = _asked(spark, d).withColumn("text", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("folder:src1 tag:EN "), F.col("text"))).otherwise(F.col("text")))
    notes = load(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/x.md")).alias("path"), F.array("lang").alias("tags"))
    index = index_of(spark, d)
    # Here a document is a chunk of its own: scopes select by it.
    own = search.SearchIndex(spark, index.folder)
    own.chunks = index.chunks.withColumn("doc_id", F.col("chunk_id"))
    return search.search(own, asked, 8, "bm25", notes=notes).select("query_id", "chunk_id", "rank")


@query(f"""WITH {_NOTES}, s AS (SELECT 1 AS query_id, * FROM notes WHERE source IN ('src1', 'src2') AND lang = 'en' UNION ALL SELECT 2, * FROM notes WHERE doc_date >= epoch(DATE '2021-01-01') AND doc_date < epoch(DATE '2021-03-01'))
SELECT query_id, doc_id, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_date DESC, doc_id) AS r FROM s) WHERE r <= 5""")
def bare_scope(spark, d):
    """Queries that are a scope and nothing else, listed newest first."""
    asked = spark.createDataFrame([(1, "folder:src1 path:src2 tag:en"), (2, "after:2021-01 before:2021-02")], "query_id long, text string")
    notes = _notes(spark, d)
    chunks = notes.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("ord"), "doc_date")
    scoped = search.scopes(asked)
    allowed = search.allowed_documents(scoped, notes)

    class Index:
        pass

    index = Index()
    index.chunks = chunks
    return search.scope_listing(index, scoped, allowed, 5).select(F.col("query_id").cast("int").alias("query_id"), "doc_id", "rank")


@query(f"WITH {_NOTES} SELECT doc_id FROM notes WHERE doc_id % 10 <> 0")
def visible_notes(spark, d):
    """Notes that do not ask to be left out."""
    return filters.visible(_notes(spark, d)).select("doc_id")


@query(f"WITH {_NOTES} SELECT doc_id FROM notes WHERE doc_date >= {FIRST} + 900 * 86400 - 30 * 86400 ORDER BY doc_date DESC, doc_id LIMIT 20")
def recent_notes(spark, d):
    """The newest notes of a number of days."""
    return filters.recent(_notes(spark, d), FIRST + 900 * tm.DAY, 30, 20).select("doc_id")


@query(f"""WITH {_NOTES}, w AS (SELECT item_id AS query_id, ({FIRST} + item_id * 10 * 86400)::DOUBLE AS lo FROM benchmark)
SELECT query_id, doc_id, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_date DESC, doc_id) AS r FROM w JOIN notes ON doc_date >= lo AND doc_date < lo + 1728000) WHERE r <= 16""")
def window_leg(spark, d):
    """The newest notes in each query's half-open window."""
    lo = (F.lit(FIRST) + F.col("query_id") * 864_000).cast("double")
    windows = _asked(spark, d).select("query_id", lo.alias("lo"), (lo + 1_728_000).alias("hi"))
    return filters.window_leg(_notes(spark, d).select("doc_id", "doc_date"), windows, 8).select("query_id", "doc_id", "rank")


@query(f"""WITH o AS (SELECT o_orderkey AS query_id, (o_orderkey % 50)::INTEGER AS n, (o_orderkey % 6)::INTEGER AS kind, DATE '2023-11-14' AS today, (1 + o_orderkey % 12)::INTEGER AS m FROM orders),
s AS (SELECT query_id, kind <> 4 AS recent, make_date(2023 - (m > 11)::INTEGER, m, 1) AS begins, *,
  CASE kind WHEN 0 THEN today - (n + 1) WHEN 1 THEN today - (7 * n + 3) WHEN 2 THEN today - n WHEN 3 THEN make_date(2023 - (m > 11)::INTEGER, m, 1) WHEN 5 THEN today - 1 END AS a,
  CASE kind WHEN 0 THEN today + 1 - greatest(0, n - 1) WHEN 1 THEN today + 1 - greatest(0, 7 * n - 3) WHEN 2 THEN today + 1 WHEN 3 THEN least(CAST(make_date(2023 - (m > 11)::INTEGER, m, 1) + INTERVAL 1 MONTH AS DATE), today + 1) WHEN 5 THEN today END AS b FROM o)
SELECT query_id, recent, epoch(a)::DOUBLE AS lo, epoch(b)::DOUBLE AS hi FROM s""")
def temporal_intents(spark, d):
    """What questions about orders say about time, on 14 November 2023."""
    o = load(spark, d, "orders")
    n, kind = (F.col("o_orderkey") % 50).cast("string"), F.col("o_orderkey") % 6
    month = F.lower(F.date_format(F.make_date(F.lit(2020), (1 + F.col("o_orderkey") % 12).cast("int"), F.lit(1)), "MMMM"))
    shapes = [F.concat(n, F.lit(" days ago we met")), F.concat(F.lit("notes of "), n, F.lit(" weeks ago")), F.concat(F.lit("the last "), n, F.lit(" days")), F.concat(F.lit("plans in "), month), F.lit("nothing about time"), F.lit("what did I do yesterday")]
    asked = o.select(F.col("o_orderkey").alias("query_id"), F.coalesce(*(F.when(kind == i, t) for i, t in enumerate(shapes))).alias("text"))
    return asked.select("query_id", tm.temporal_intent(F.col("text"), F.lit(NOW)).alias("i")).select("query_id", "i.recent", "i.lo", "i.hi")


@query(f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'on ' || strftime(make_date(2021, 1 + (doc_id % 12)::INTEGER, 1 + (doc_id % 28)::INTEGER), '%Y/%m/%d') || ' at noon' END AS front,
  CASE WHEN doc_id % 3 = 0 THEN strftime(make_date(2022, 1 + (doc_id % 12)::INTEGER, 1 + (doc_id % 28)::INTEGER), '%Y%m%d') ELSE 'no 2022-13-01' END AS title FROM documents)
SELECT doc_id, CASE WHEN front IS NOT NULL THEN epoch(make_date(2021, 1 + (doc_id % 12)::INTEGER, 1 + (doc_id % 28)::INTEGER)) + 43200 WHEN doc_id % 3 = 0 THEN epoch(make_date(2022, 1 + (doc_id % 12)::INTEGER, 1 + (doc_id % 28)::INTEGER)) + 43200 ELSE doc_id END::DOUBLE AS doc_date FROM n""")
def note_dates(spark, d):
    """The date of a note by frontmatter, name and file time."""
    day = lambda year, shape: F.date_format(F.make_date(F.lit(year), (1 + F.col("doc_id") % 12).cast("int"), (1 + F.col("doc_id") % 28).cast("int")), shape)
    front = F.create_map(F.lit("created"), F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("on "), day(2021, "yyyy/MM/dd"), F.lit(" at noon")))))
    title = F.when(F.col("doc_id") % 3 == 0, day(2022, "yyyyMMdd")).otherwise(F.lit("no 2022-13-01"))
    return load(spark, d, "documents").select("doc_id", tm.doc_date(front, title, F.lit("folder/file.md"), F.col("doc_id").cast("double")).alias("doc_date"))


# -- text


@query(r"""SELECT doc_id, left(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^(#{1,6}\s.*|-{3,}|\*{3,}|_{3,})?$')), ' '), '\s+', ' ', 'g')), 150) AS snippet,
left(trim(regexp_replace(regexp_replace(text, '[\\/:*?"<>|#^\[\]\x00-\x1f]+', ' ', 'g'), '\s+', ' ', 'g')), 80) AS name, trim(regexp_replace(lower(left(text, 60)), '[^a-z0-9가-힣]+', '-', 'g'), '-') AS kebab FROM documents""")
def text_names(spark, d):
    """Snippet, file name and skill name of a text."""
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", tx.snippet(t).alias("snippet"), tx.safe_name(t).alias("name"), tx.kebab(F.left(t, F.lit(60))).alias("kebab"))


@query(f"""SELECT item_id, {_CONTENT.format('text')} AS tokens, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 4 AND NOT list_bool_or(list_transform([{', '.join("'" + w + "'" for w in tx.QUESTION_WORDS)}], lambda w: contains(lower(text), w))) AS keyword FROM benchmark""".replace("AS tokens", "AS ts").join(["SELECT item_id, array_to_string(list_sort(ts), ' ') AS tokens, keyword FROM (", ")"]))
def query_tokens(spark, d):
    """The tokens that a note could repeat, and whether a query is keywords only."""
    t = F.col("text")
    return load(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(tx.coverage_tokens(t)), " ").alias("tokens"), tx.is_keyword_query(t).alias("keyword"))


_LISTS = "|".join(q.replace(" ", r"\W+") for q in tx.QUANTIFIERS)


@query(rf"""SELECT item_id AS query_id, item_id % 3 = 1 OR regexp_matches(lower(text), '\b({_LISTS})\b') AS listed, CASE WHEN item_id % 3 = 1 OR regexp_matches(lower(text), '\b({_LISTS})\b') THEN 16 ELSE 8 END AS k FROM benchmark""")
def enumeration_intent(spark, d):
    """Benchmark items, some behind the opening of a question, that ask for lists, and how many hits they get."""
    opening = F.when(F.col("query_id") % 3 == 1, "which projects ").when(F.col("query_id") % 3 == 2, "what does ").otherwise("about ")
    rows = _asked(spark, d).withColumn("text", F.concat(opening, "text"))
    return rows.select("query_id", tx.is_enumeration(F.col("text")).alias("listed"), tx.adaptive_k(F.col("text"), 8).cast("int").alias("k"))


@query(f"""WITH t AS (SELECT doc_id, translate(CAST(doc_id AS VARCHAR), '0123456789', '가나다라마바사아자차') AS s FROM documents),
g AS (SELECT doc_id, s, string_split(s, '') AS ones, list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) AS pairs FROM t)
SELECT doc_id, array_to_string(list_concat(ones, pairs), ' ') AS indexed,
  array_to_string(CASE WHEN length(s) = 1 THEN [s] WHEN length(s) = 2 AND contains('{tx.SINGLE_PARTICLES}', substr(s, 2, 1)) THEN list_concat(pairs, [substr(s, 1, 1)]) ELSE pairs END, ' ') AS asked FROM g""")
def cjk_grams(spark, d):
    """Grams of Hangul runs that spell the documents' numbers, as indexed and as asked for."""
    spelled = F.concat(F.lit("no. "), F.translate(F.col("doc_id").cast("string"), "0123456789", "가나다라마바사아자차"), F.lit(" end"))
    rows = load(spark, d, "documents").select("doc_id", spelled.alias("text"))
    return rows.select("doc_id", F.array_join(tx.index_grams(F.col("text")), " ").alias("indexed"), F.array_join(tx.query_grams(F.col("text")), " ").alias("asked"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(list_filter({_CONTENT.format('text')}, lambda t: length(t) >= 4)) AS a FROM benchmark)
SELECT a, substr(a, 1, 1) || substr(a, 3, 1) || substr(a, 2, 1) || substr(a, 4) AS b, CASE WHEN substr(a, 2, 1) = substr(a, 3, 1) THEN 0 ELSE 1 END AS distance FROM w
UNION ALL SELECT a, reverse(a), CAST(least(damerau_levenshtein(a, reverse(a)), 2) AS INTEGER) FROM w""")
def swap_distance(spark, d):
    """Edit distance with swaps of neighbours, capped at one: of words with two letters swapped, and turned round."""
    words = load(spark, d, "benchmark").select(F.explode(tx.content_tokens(F.col("text"))).alias("a")).where(F.length("a") >= 4).distinct()
    turned = words.withColumn("b", F.concat(F.substring("a", 1, 1), F.substring("a", 3, 1), F.substring("a", 2, 1), F.expr("substring(a, 4)")))
    far = words.withColumn("b", F.reverse("a"))
    return turned.unionByName(far).select("a", "b", tx.osa("a", "b", F.lit(1)).cast("int").alias("distance"))


@query(f"""WITH words AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS w FROM documents), {stem_ctes('words')} SELECT w AS word, stem FROM stems""")
def english_stems(spark, d):
    """Stems of all tokens of the documents, against Porter's rules stated in SQL."""
    words = load(spark, d, "documents").select(F.explode(tx.all_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", tx.stemmed("word").alias("stem"))


@query("SELECT doc_id, sha256('hashed|64|document|' || 'note ' || doc_id || ' > ' || lang || chr(10) || chr(10) || left(text, 100)) AS key FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def embedding_keys(spark, d):
    """The text that is embedded and the key of its vector in the cache."""
    from lodestone.sources import notes

    docs = load(spark, d, "documents").where("text is not null and lang is not null")
    text = notes.embed_text(F.concat(F.lit("note "), F.col("doc_id").cast("string")), F.col("lang"), F.left("text", F.lit(100)))
    return docs.select("doc_id", tx.cache_key("hashed", 64, "document", text).alias("key"))


@query("""SELECT * FROM (VALUES (0, 0, true), (0, 1, false), (1, 0, false), (1, 1, true)) v(query_id, chunk_id, whole)""")
def korean_coverage(spark, d):
    """Korean tokens are found by their stems and letters."""
    asked = spark.createDataFrame([(0, "환불은 큐로 만든 것"), (1, "회의는 월요일에 만든 자료")], "query_id long, text string")
    hits = spark.createDataFrame([(q, c, t) for q in (0, 1) for c, t in enumerate(["환불이 큐로 만들었다 것이다", "회의가 월요일이다 만들었다 자료도"])], "query_id long, chunk_id long, text string")
    cover = fusion.coverage(asked, hits.withColumn("title", F.lit("")), index_of(spark, d).lexicon)
    return cover.select(F.col("query_id").cast("int").alias("query_id"), F.col("chunk_id").cast("int").alias("chunk_id"), (F.col("cover") > 0.99).alias("whole"))


# -- vectors


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)
SELECT vec_id, round(list_sum(u), 6) AS total, CAST(list_sum(list_transform(u, lambda x: greatest(-127, least(127, round_even(x * 127, 0)))::INTEGER)) AS BIGINT) AS codes FROM n""")
def unit_codes(spark, d):
    """Unit vectors and their signed bytes."""
    u = vx.normalized(F.col("vec"))
    rows = _vectors(spark, d).select(F.col("chunk_id").alias("vec_id"), u.alias("u"), vx.quantized(u, 127.0).alias("c"))
    total = lambda c, zero: F.aggregate(c, zero, lambda s, x: s + x)
    return rows.select("vec_id", F.round(total("u", F.lit(0.0)), 6).alias("total"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("codes"))


@query(f"""WITH {_E}, m AS (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e) GROUP BY label, dim),
c AS (SELECT label, list(x ORDER BY dim) AS v FROM m GROUP BY label), u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c),
s AS (SELECT a.label::BIGINT AS src, b.label::BIGINT AS dst, round(list_dot_product(a.v, b.v), 9) AS score FROM u a JOIN u b ON a.label <> b.label WHERE a.label >= 2)
SELECT src, dst, round(0.6::DOUBLE * score, 6) AS weight FROM s WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 3""")
def semantic_links(spark, d):
    """L4: nearest notes by centroid for notes without a link out."""
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    out = graph.semantic_edges(_vectors(spark, d), edges, floor=0.05)
    return out.select("src", "dst", F.round("weight", 6).alias("weight"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), o AS (SELECT label::BIGINT AS query_id, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
s AS (SELECT query_id, list_dot_product(lag(u) OVER (PARTITION BY query_id ORDER BY vec_id), u) AS c FROM o) SELECT query_id, round(avg(c), 6) AS smoothness FROM s WHERE c IS NOT NULL GROUP BY query_id""")
def path_smoothness(spark, d):
    """How straight a sequence of vectors runs."""
    rows = _vectors(spark, d).select(F.col("doc_id").alias("query_id"), F.col("chunk_id").alias("position"), "vec")
    return similarity.path_smoothness(rows).select("query_id", F.round("smoothness", 6).alias("smoothness"))


# -- memory


def _orders(spark, d) -> DataFrame:
    return load(spark, d, "orders").withColumn("ts", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)


@query("""WITH s AS (SELECT o_custkey::VARCHAR AS title, o_orderkey::VARCHAR AS statement, o_orderkey, epoch(o_orderdate)::DOUBLE AS ts, o_totalprice::DOUBLE AS confidence FROM orders),
w AS (SELECT *, lag(statement) OVER o AS before, row_number() OVER (PARTITION BY title ORDER BY ts DESC, statement DESC) AS n FROM s WINDOW o AS (PARTITION BY title ORDER BY ts, statement))
SELECT title, max(CASE WHEN n = 1 THEN statement END) AS statement, count(before) FILTER (n <= 4) AS changes, max(CASE WHEN n = 1 THEN before END) AS last_before FROM w GROUP BY title""")
def belief_trails(spark, d):
    """The last four changes of every belief."""
    rows = _orders(spark, d).select(F.col("o_custkey").cast("string").alias("title"), F.col("o_orderkey").cast("string").alias("statement"), F.col("o_totalprice").cast("double").alias("confidence"), "ts")
    out = memory.belief_trail(rows, 4)
    return out.select("title", "statement", F.size("trail").cast("long").alias("changes"), F.try_element_at("trail", F.lit(-1))["before"].alias("last_before"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'error' WHEN doc_id % 3 = 1 THEN 'belief' ELSE 'fact' END AS type, CASE WHEN doc_id % 3 = 0 THEN 'open' END AS status,
CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN least(1.0::DOUBLE, doc_id / 500.0::DOUBLE) ELSE 0.6::DOUBLE END END AS confidence FROM documents WHERE doc_id % 7 <> 0 AND regexp_matches(text, '[0-9A-Za-z가-힣]')""")
def remember_fragments(spark, d):
    """Typed fragments with their default state and confidence."""
    kind = F.when(F.col("doc_id") % 7 == 0, "rumour").when(F.col("doc_id") % 3 == 0, "error").when(F.col("doc_id") % 3 == 1, "belief").otherwise("fact")
    rows = load(spark, d, "documents").select("doc_id", kind.alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("status"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") / 500.0).alias("confidence"), F.col("source").alias("case"))
    return memory.remember(rows).select("doc_id", "type", "status", "confidence")


@query("""WITH r AS (SELECT o_custkey::VARCHAR AS "case", o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT "case", CAST(least(c, 5) - n AS INTEGER) AS place, o_orderkey AS doc_id FROM r WHERE n <= 5""")
def case_timeline(spark, d):
    """The last five entries of every case in order."""
    rows = _orders(spark, d).select(F.col("o_custkey").cast("string").alias("case"), F.lit("episode").alias("type"), F.lit("").alias("status"), "ts", F.col("o_orderkey").alias("doc_id"), F.lit("").alias("content"), F.array(F.col("o_orderpriority")).alias("next_steps"))
    return memory.resume_case(rows, 5).select("case", F.posexplode("timeline").alias("place", "e")).select("case", "place", "e.doc_id")


@query("""SELECT o_custkey::VARCHAR AS "case", arg_max(o_orderpriority, epoch(o_orderdate) * 1e8 + o_orderkey) FILTER (o_orderstatus <> 'O' AND o_orderkey % 2 = 0) AS next_step, count(*) FILTER (o_orderstatus = 'O') AS errors FROM orders GROUP BY o_custkey""")
def case_next_steps(spark, d):
    """The next steps of the newest episode that has any supersede all others."""
    steps = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("o_orderstatus") == "O", "error").otherwise("episode")
    rows = _orders(spark, d).select(F.col("o_custkey").cast("string").alias("case"), kind.alias("type"), F.lit("").alias("status"), "ts", F.col("o_orderkey").alias("doc_id"), F.lit("").alias("content"), steps.alias("next_steps"))
    return memory.resume_case(rows).select("case", F.try_element_at("next_steps", F.lit(1)).alias("next_step"), F.size("errors").cast("long").alias("errors"))


@query("""SELECT o_custkey::VARCHAR AS "case" FROM orders GROUP BY o_custkey HAVING count(*) >= 2 AND count(*) FILTER (o_orderstatus = 'O') = 0""")
def eligible_skills(spark, d):
    """Cases that can become skills."""
    kind = F.when(F.col("o_orderstatus") == "O", "error").otherwise("fact")
    rows = _orders(spark, d).select(F.col("o_custkey").cast("string").alias("case"), kind.alias("type"), F.lit(None).cast("string").alias("status"), F.lit("").alias("phase"), "ts", F.col("o_orderkey").alias("doc_id"))
    return memory.eligible_skills(rows).select("case")


@query("""WITH g AS (SELECT DISTINCT c_mktsegment || '-' || c_nationkey AS "group" FROM customer), r AS (SELECT "group", row_number() OVER (ORDER BY "group") AS n FROM g)
SELECT "group", CASE WHEN n <= 12 THEN "group" ELSE (SELECT min("group") FROM g) END AS scene, n <= 12 AS created FROM r""")
def scenes(spark, d):
    """Groups assigned to at most twelve scenes, the rest to the coldest."""
    groups = load(spark, d, "customer").select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("group")).distinct()
    return memory.assign_scenes(groups, spark.createDataFrame([], "group string, heat long, mtime double"))


def _atoms(spark, d) -> DataFrame:
    docs = load(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, "episode").when(F.col("doc_id") % 2 == 0, "fact").otherwise("decision")
    tags = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("memory-digest"))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.lit("intro\n- one "), F.col("doc_id").cast("string"), F.lit("\n* two\nno bullet"))
    return docs.select("doc_id", kind.alias("type"), tags.alias("tags"), F.col("source").alias("topic"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("case"), body.alias("body"), F.col("doc_id").cast("double").alias("mtime"))


_ATOMS = """n AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN 'episode' WHEN doc_id % 2 = 0 THEN 'fact' ELSE 'decision' END AS type FROM documents WHERE doc_id > 100),
atoms AS (SELECT doc_id, 'digest' AS type, coalesce(source, 'general') AS "group", unnest(['one ' || doc_id, 'two']) AS text, doc_id::DOUBLE AS mtime FROM n WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, type, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, source, 'general'), 'intro' || chr(10) || '- one ' || doc_id || chr(10) || '* two' || chr(10) || 'no bullet', doc_id::DOUBLE FROM n WHERE type <> 'episode')"""


@query(f'WITH {_ATOMS} SELECT doc_id, type, "group", text, mtime FROM atoms')
def collect_atoms(spark, d):
    """Bullets of digests and typed fragments newer than the cursor."""
    return memory.collect_atoms(_atoms(spark, d), 100.0)


@query(f"WITH {_ATOMS} SELECT max(mtime) <= 10000 - 180 AS due FROM atoms")
def consolidation_due(spark, d):
    """Whether the newest atom is idle for three minutes."""
    return memory.consolidation_due(memory.collect_atoms(_atoms(spark, d), 100.0), 10_000.0)


@query("SELECT left(string_agg(lang, chr(10) ORDER BY first), 2000) AS persona FROM (SELECT lang, min(doc_id) AS first FROM documents WHERE lang <> '' GROUP BY lang)")
def persona(spark, d):
    """Distinct lines in first-seen order."""
    return memory.persona(load(spark, d, "documents").select(F.col("lang").alias("line"), F.col("doc_id").alias("ord")))


@query("""WITH g AS (SELECT *, substr('2021-0' || (1 + doc_id % 3) || '-05', 1, 7) AS month FROM documents),
r AS (SELECT source || '/' || month AS "group", length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source, month ORDER BY doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT "group", CAST(floor(before / 12000) AS INTEGER) AS batch, CAST(count(*) AS BIGINT) AS notes, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY ALL""")
def distill_batches(spark, d):
    """Chat notes by folder and month in batches by a running count of characters."""
    month = F.concat(F.lit("2021-0"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-05 "))
    rows = load(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), month.alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    parts = memory.distill_batches(rows)
    joined = parts.select("group", "batch", F.length("text").alias("n"), F.size(F.split("text", "\n\n", -1)).alias("_"))
    sizes = memory.distill_sizes(rows)
    return joined.join(sizes, ["group", "batch"]).select("group", "batch", "notes", "chars")


@query("""WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, l_linenumber AS chunk_id, l_extendedprice::DOUBLE AS fused, epoch(l_shipdate)::DOUBLE AS mtime FROM lineitem),
b AS (SELECT * FROM h WHERE mtime >= 900000000 - 1000 * 86400 QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY fused DESC, chunk_id) = 1)
SELECT query_id, doc_id, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS r FROM b) WHERE r <= 3""")
def recall_notes(spark, d):
    """One row a note, old notes cut before the best are taken."""
    hits = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_extendedprice").cast("double").alias("fused"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("mtime"))
    return memory.recall(hits, 900_000_000.0, 1000, 3).select("query_id", "doc_id", "rank")


@query(f"""WITH {_E}, t AS (SELECT item_id, {_CONTENT.format('text')} AS ts FROM benchmark), s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_dot_product(q.v, c.v), 9) AS score, q.vec_id % 40 AS a, c.vec_id % 40 AS b FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT * FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3)
SELECT query_id, doc_id, round(score, 6) AS score, score >= 0.5 AND coalesce(CASE WHEN len(list_distinct(list_concat(x.ts, y.ts))) = 0 THEN 0 ELSE len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts)))::DOUBLE END, 0) >= 0.35 AS duplicate
FROM r JOIN t x ON x.item_id = (SELECT min(item_id) FROM benchmark) + a JOIN t y ON y.item_id = (SELECT min(item_id) FROM benchmark) + b""")
def related_memories(spark, d):
    """What is like a new memory, and whether it says the same."""
    v = _vectors(spark, d)
    texts = load(spark, d, "benchmark")
    low = texts.agg(F.min("item_id")).first()[0]
    text = lambda key, name: texts.select((F.col("item_id") - low).alias(key), F.col("text").alias(name))
    asked = v.where("chunk_id % 100 = 0")
    found = similarity.vector_topk(v, asked.select(F.col("chunk_id").alias("query_id"), "vec"), 40).where("query_id <> chunk_id")
    found = found.withColumn("t", F.col("chunk_id") % 40).join(text("t", "text"), "t").select("query_id", F.col("chunk_id").alias("doc_id"), "score", "text")
    new = asked.select(F.col("chunk_id").alias("query_id"), (F.col("chunk_id") % 40).alias("t")).join(text("t", "text"), "t").select("query_id", "text")
    return memory.related_memories(new, found, least=0.3, duplicate=0.5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "duplicate")


# -- writes to the vault


def _vault(spark, d) -> DataFrame:
    docs = load(spark, d, "documents")
    state = F.when(F.col("doc_id") % 10 == 3, "pending").when(F.col("doc_id") % 10 == 4, "trash").otherwise("live")
    home = F.concat("source", F.lit("/n"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"), F.when(F.col("doc_id") % 2 == 1, " 2").otherwise(""))
    path = F.when(state == "trash", F.concat(F.lit(".trash/n"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(home, F.lit(".md")))
    return docs.select("doc_id", path.alias("path"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content"), state.alias("state"), (F.col("doc_id") % 2 == 0).alias("generated"), F.when(state == "trash", F.concat(home, F.lit(".md"))).alias("original"), F.col("doc_id").cast("double").alias("mtime"))


_VAULT = """v AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN '.trash/n' || doc_id || '.md' ELSE source || '/n' || (doc_id - doc_id % 2) || CASE WHEN doc_id % 2 = 1 THEN ' 2' ELSE '' END || '.md' END AS path, 'c' || doc_id AS content,
CASE WHEN doc_id % 10 = 3 THEN 'pending' WHEN doc_id % 10 = 4 THEN 'trash' ELSE 'live' END AS state, doc_id % 2 = 0 AS generated, CASE WHEN doc_id % 10 = 4 THEN source || '/n' || doc_id || '.md' END AS original, doc_id::DOUBLE AS mtime FROM documents)"""


@query(f"WITH {_VAULT} SELECT path, content, state, generated FROM v UNION ALL SELECT 'memories/title ' || m || CASE WHEN n > 1 THEN ' ' || n ELSE '' END || '.md', content, 'live', true FROM (SELECT 'x' || doc_id AS content, doc_id % 50 AS m, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY 'x' || doc_id) AS n FROM documents WHERE doc_id % 20 = 1)")
def save_memory(spark, d):
    """Memories saved under free names."""
    asked = load(spark, d, "documents").where("doc_id % 20 = 1").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("content"), F.concat(F.lit("title "), (F.col("doc_id") % 50).cast("string")).alias("title"))
    return states.save(_vault(spark, d).select(*states.COLUMNS), asked, NOW).select("path", "content", "state", "generated")


@query(f"""WITH {_VAULT}, hit AS (SELECT * FROM v WHERE doc_id % 4 = 0 AND state <> 'trash') SELECT path, state, original FROM v WHERE path NOT IN (SELECT path FROM hit)
UNION ALL SELECT '.trash/' || regexp_extract(path, '[^/]*$'), 'trash', path FROM hit""")
def trash_notes(spark, d):
    """Generated notes moved to the trash; a person's notes are refused."""
    v = _vault(spark, d)
    return states.trash(v.select(*states.COLUMNS), v.where("doc_id % 4 = 0 or doc_id % 4 = 1").select("path")).select("path", "state", "original")


@query(f"WITH {_VAULT} SELECT CASE WHEN state = 'trash' THEN original ELSE path END AS path, CASE WHEN state = 'trash' THEN 'live' ELSE state END AS state FROM v")
def restore_notes(spark, d):
    """Trashed notes back where they came from."""
    v = _vault(spark, d)
    return states.restore(v.select(*states.COLUMNS), v.select("path")).select("path", "state")


@query(f"WITH {_VAULT} SELECT path, state FROM v WHERE NOT (state = 'trash' AND doc_id % 3 = 0)")
def purge_notes(spark, d):
    """Trashed notes deleted, nothing else."""
    v = _vault(spark, d)
    return states.purge(v.select(*states.COLUMNS), v.where("doc_id % 3 = 0").select("path")).select("path", "state")


@query(f"WITH {_VAULT} SELECT path, CASE WHEN state = 'pending' AND doc_id % 3 = 0 THEN 'live' ELSE state END AS state FROM v")
def approve_notes(spark, d):
    """Pending notes made live."""
    v = _vault(spark, d)
    return states.approve(v.select(*states.COLUMNS), v.where("doc_id % 3 = 0").select("path")).select("path", "state")


@query(f"WITH {_VAULT} SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE content END AS content, CASE WHEN doc_id % 6 = 0 THEN {NOW}::DOUBLE ELSE mtime END AS mtime FROM v")
def write_notes(spark, d):
    """Whole contents written unless the note has changed since."""
    v = _vault(spark, d)
    asked = v.where("doc_id % 3 = 0").select("path", F.lit("new").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") - 5).alias("expect_mtime"))
    return states.write(v.select(*states.COLUMNS), asked, NOW).select("path", "content", "mtime")


@query(f"WITH {_VAULT} SELECT CASE WHEN state <> 'trash' AND doc_id % 5 = 0 THEN 'moved/' || doc_id || '.md' ELSE path END AS path, content FROM v")
def rename_notes(spark, d):
    """Notes moved to paths that no note has."""
    v = _vault(spark, d)
    taken = v.where("state = 'live' and doc_id % 5 = 1").select(F.col("path").alias("dst")).limit(1)
    free = v.where("doc_id % 5 = 0").select("path", F.concat(F.lit("moved/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("dst"))
    refused = v.where("state = 'live' and doc_id % 5 = 2").select("path").limit(1).crossJoin(taken)  # one row
    return states.rename(v.select(*states.COLUMNS), free.unionByName(refused)).select("path", "content")


@query(f"WITH {_VAULT} SELECT path, CASE WHEN state <> 'trash' AND doc_id % 9 = 0 THEN content || chr(10) || chr(10) || '## 2023-11-14 22:13' || chr(10) || chr(10) || 'more' || chr(10) ELSE content END AS content FROM v UNION ALL SELECT 'log.md', '# log' || chr(10) || chr(10) || '## 2023-11-14 22:13' || chr(10) || chr(10) || 'first' || chr(10)")
def append_notes(spark, d):
    """Dated sections at the end of notes, and a note that was not there."""
    v = _vault(spark, d)
    asked = v.where("doc_id % 9 = 0 and state <> 'trash'").select("path", F.lit("more").alias("content")).unionByName(spark.createDataFrame([("log", " first ")], "path string, content string"))
    return states.append(v.select(*states.COLUMNS), asked, NOW).select("path", "content")


@query(f"WITH {_VAULT} SELECT path, original, mtime FROM v WHERE state = 'trash'")
def trash_listing(spark, d):
    """What lies in the trash and where it came from."""
    return states.listing(_vault(spark, d), "trash").select("path", "original", "mtime")


@query(f"WITH {_VAULT} SELECT path, mtime FROM v WHERE state = 'pending'")
def pending_listing(spark, d):
    """Notes that wait for approval."""
    return states.listing(_vault(spark, d), "pending").select("path", "mtime")


# -- sync and evaluation


@query("""SELECT count(*) FILTER (doc_id % 10 = 1) AS added, count(*) FILTER (doc_id % 10 = 2) AS updated, count(*) FILTER (doc_id % 10 = 3) AS removed, count(*) FILTER (doc_id % 10 NOT IN (1, 2, 3)) AS unchanged FROM documents""")
def sync_plan(spark, d):
    """What a sync would do, in numbers."""
    from lodestone.plans import catalog

    return sync.plan(catalog.QUERIES["sync_diff"](spark, d))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'fresh' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 3")
def upserted(spark, d):
    """Rows replaced by key and deleted by key."""
    docs = load(spark, d, "documents").select("doc_id", "lang")
    fresh = docs.where("doc_id % 10 = 2").withColumn("lang", F.lit("fresh"))
    return sync.merged(docs, fresh, docs.where("doc_id % 10 = 3"), "doc_id")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS began, count(*) AS n FROM r GROUP BY user_id, run""")
def idle_sessions(spark, d):
    """Sessions that end after three idle minutes."""
    rows = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sync.idle_sessions(rows).select("user_id", F.floor(F.unix_micros("session.start") / 1_000_000).cast("long").alias("began"), "n")


@query("SELECT user_id, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, count(*) AS n FROM events GROUP BY ALL")
def client_weeks(spark, d):
    """Events per client and week."""
    rows = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sync.client_windows(rows).select("user_id", F.floor(F.unix_seconds("w.start") / 604800).cast("long").alias("week"), "n")


@query(f"""WITH {_NOTES}, t AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(lower(left(body, 80)), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM notes)
SELECT a.doc_id, a.ws = b.ws AS exact FROM t a JOIN t b ON b.doc_id = a.doc_id - a.doc_id % 2""")
def exact_answers(spark, d):
    """Whether two answers are the same once normalised."""
    n = _notes(spark, d).select("doc_id", tx.normalized_answer(F.left("body", F.lit(80))).alias("a"))
    return n.join(n.select(F.col("doc_id").alias("other"), F.col("a").alias("b")), F.col("other") == F.col("doc_id") - F.col("doc_id") % 2).select("doc_id", (F.col("a") == F.col("b")).alias("exact"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'unembedded', count(*) FROM documents d ANTI JOIN embeddings e ON e.vec_id = d.doc_id")
def table_counts(spark, d):
    """Rows of tables, and documents without a vector."""
    docs, vectors = load(spark, d, "documents"), load(spark, d, "embeddings")
    return context.counts({"documents": docs, "embeddings": vectors, "unembedded": docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left_anti")})


@query("""WITH t AS (SELECT user_id AS doc_id, count(*) AS hits FROM events GROUP BY user_id), m AS (SELECT max(hits) AS most FROM t) SELECT doc_id, round(1 + 0.2::DOUBLE * ln(1 + hits) / ln(1 + most), 9) AS factor FROM t, m""")
def usage_prior(spark, d):
    """How much use raises a note."""
    hits = load(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("hits"))
    most = hits.agg(F.max("hits").alias("most"))  # one row
    return hits.crossJoin(most).select("doc_id", F.round(fusion.usage_factor(F.col("hits"), F.col("most"), 0.2), 9).alias("factor"))


@query("""WITH c AS (SELECT conv_id, turn, text, turn % 2 = 1 AS burst FROM conversations), b AS (SELECT * FROM c WHERE burst), w AS (SELECT conv_id, turn, text FROM c WHERE NOT burst)
SELECT b.conv_id, b.turn, coalesce((SELECT min(w.turn) FROM w WHERE w.conv_id = b.conv_id AND contains(regexp_replace(w.text, '\\s+', '', 'g'), regexp_replace(left(b.text, 3), '\\s+', '', 'g'))), b.turn) AS alias FROM b""")
def nested_aliases(spark, d):
    """Focused chunks stand for the first chunk of their document that holds them."""
    turns = load(spark, d, "conversations")
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.struct("conv_id", "turn").alias("chunk_id"), F.col("turn").alias("ord"), F.when(F.col("turn") % 2 == 1, "burst").otherwise("body").alias("kind"), F.when(F.col("turn") % 2 == 1, F.left("text", F.lit(3))).otherwise(F.col("text")).alias("text"))
    return fusion.nested_alias(chunks).select("chunk_id.conv_id", "chunk_id.turn", F.col("alias.turn").alias("alias"))
