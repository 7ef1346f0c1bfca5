"""Document frequencies, the lexicon, token overlap, ranking, and typo repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

#: Weights of the fields of a chunk.
FIELDS = {"text": 1.0, "title": 0.6, "heading": 0.4}


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, n: occurrences of words of three Latin letters or two Hangul syllables and more."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{3,}|[가-힣]{2,}"), F.lit(0))
    return docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def chunk_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df: documents that contain the token."""
    return docs.select(F.explode(F.array_distinct(tx.all_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def overlapping(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """a, b, jaccard of the pairs a < b that share a content token: joined on their tokens, so no other pair is met.

    A token of n items brings n (n - 1) / 2 pairs together; for large tables give items whose common tokens are left out.
    """
    sets = items.select(F.col(key).alias("id"), tx.content_tokens(F.col(text)).alias("ts"))
    tokens = sets.select("id", F.size("ts").alias("n"), F.explode("ts").alias("t"))
    left, right = tokens.withColumnsRenamed({"id": "a", "n": "na"}), tokens.withColumnsRenamed({"id": "b", "n": "nb"})
    shared = left.join(right, "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return shared.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def top_k(scored: DataFrame, k: int, key: str, by: str = "score", per: str = "query_id") -> DataFrame:
    """The k best rows of each query with a 0-based rank; ties go to the smaller key."""
    order = Window.partitionBy(per).orderBy(F.desc(by), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def typo_candidates(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, fix: for words unknown to `terms` (term, n) the nearest term, by distance, count, then order.

    Latin words of four letters and more look among terms with their first letter (one edit up to five
    letters, else two); Hangul words of three and more among terms with their first syllable, or with one
    edit their second. Both are equality joins on a bucket with the distance as a further condition.
    """
    unknown = words.select("word").distinct().join(terms, F.col("word") == F.col("term"), "left_anti")
    latin = F.col("word").rlike("^[a-z]{4,}$")
    cap = F.when(latin, F.when(F.length("word") <= 5, 1).otherwise(2)).otherwise(F.when(F.length("word") <= 4, 1).otherwise(2))
    asked = unknown.where(latin | F.col("word").rlike("^[가-힣]{3,}$")).withColumn("cap", cap)
    buckets = F.array(F.struct(F.lit(1).alias("at"), F.substring("word", 1, 1).alias("c")), F.struct(F.lit(2).alias("at"), F.substring("word", 2, 1).alias("c")))
    asked = asked.withColumn("b", F.explode(buckets)).where(~F.col("word").rlike("^[a-z]") | (F.col("b.at") == 1))
    asked = asked.withColumn("cap", F.when(F.col("b.at") == 2, 1).otherwise(F.col("cap")))
    spots = F.array(F.struct(F.lit(1).alias("at"), F.substring("term", 1, 1).alias("c")), F.struct(F.lit(2).alias("at"), F.substring("term", 2, 1).alias("c")))
    pool = terms.withColumn("b", F.explode(spots))
    near = asked.join(pool, "b").where(F.abs(F.length("word") - F.length("term")) <= F.col("cap")).select("word", "term", "n", "cap")
    # Two branches: in one expression the Python distance would be worked out for Latin words too.
    latin, latin_d = near.where(F.col("word").rlike("^[a-z]")), F.levenshtein("word", "term", 2)
    near = latin.withColumn("d", F.when(latin_d < 0, 99).otherwise(latin_d)).unionByName(near.where(F.col("word").rlike("^[^a-z]")).withColumn("d", tx.osa("word", "term", "cap")))
    near = near.where(F.col("d") <= F.col("cap"))
    return near.groupBy("word").agg(F.min_by("term", F.struct("d", -F.col("n"), "term")).alias("fix"))


def correct_typos(queries: DataFrame, terms: DataFrame, qid: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, text, corrected: unknown words replaced in place, everything else untouched."""
    split = F.expr(f"regexp_extract_all({text}, '[A-Za-z]+|[가-힣]+|[^A-Za-z가-힣]+', 0)")
    parts = queries.select(F.col(qid).alias("query_id"), F.col(text).alias("text"), F.posexplode_outer(split).alias("at", "part"))
    parts = parts.withColumn("word", F.lower("part"))
    fixes = typo_candidates(parts.where(F.col("word").isNotNull()), terms)
    fixed = parts.join(fixes, "word", "left").withColumn("part", F.coalesce("fix", "part"))
    joined = fixed.groupBy("query_id", "text").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    return joined.select("query_id", "text", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("corrected"))


def all_tokens_common(queries: DataFrame, frequencies: Callable, n_chunks: int, qid: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, all_common (every token is in more than 5 % of chunks, and more than 4) and none_telling (of indexed ones).

    `frequencies` gives a table with the named column of tokens a column df (see SearchIndex.term_frequencies).
    """
    floor = max(0.05 * n_chunks, 4)
    tokens = queries.select(F.col(qid).alias("query_id"), F.explode_outer(tx.content_tokens(F.col(text))).alias("token"))
    cuts = F.array(F.struct(F.lit(0).alias("cut"), F.col("token").alias("term")), F.struct(F.lit(1).alias("cut"), F.expr("left(token, length(token) - 1)").alias("term")), F.struct(F.lit(2).alias("cut"), F.expr("left(token, length(token) - 2)").alias("term")))
    spread = tokens.withColumn("c", F.explode_outer(cuts)).where(F.col("token").isNull() | (F.length("token") >= F.col("c.cut") + 2)).select("query_id", "token", "c.*")
    known = frequencies(spread, "term")
    per = known.groupBy("query_id", "token").agg(F.max(F.when(F.col("cut") < 2, F.col("df"))).alias("short"), F.max("df").alias("long"))
    return per.groupBy("query_id").agg(
        F.coalesce(F.bool_and(F.col("token").isNotNull() & (F.col("short") > floor)), F.lit(False)).alias("all_common"),
        F.coalesce(F.bool_and(F.when(F.col("long") > 0, F.col("long") > floor)), F.lit(False)).alias("none_telling"),
    )
