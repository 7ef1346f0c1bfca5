"""Rank fusion and the adjustments after it, over any number of queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources.tables import written

RRF_K = 60
PER_DOC = 3


def rrf(legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, fused: sum of weight / (k + rank + 1) over all rows of all legs (query_id, chunk_id, rank, weight)."""
    share = F.col("weight") / (F.lit(k) + F.col("rank") + 1)
    return legs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(share), 12).alias("fused"))


def capped_top_k(scored: DataFrame, k: int, per_doc: int = PER_DOC, score: str = "fused") -> DataFrame:
    """At most `per_doc` chunks of a document, then the k best of a query; ties go to the smaller chunk id."""
    inner = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(score), F.asc("chunk_id"))
    outer = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("chunk_id"))
    kept = scored.withColumn("_in_doc", F.row_number().over(inner)).where(F.col("_in_doc") <= per_doc).drop("_in_doc")
    return kept.withColumn("rank", F.row_number().over(outer) - 1).where(F.col("rank") < k)


def recency_factor(ts: Column, intent: Column, weight: Column, boost: float = 1.0) -> Column:
    """3.5 inside an explicit window, 1 outside; 1 + 0.6 times the recency weight for vague recency; undated rows untouched."""
    explicit = F.when((ts >= intent["lo"]) & (ts < intent["hi"]), F.lit(1 + 2.5 * boost)).otherwise(F.lit(1.0))
    vague = 1 + F.lit(boost * 0.6) * weight
    return F.when(F.coalesce(ts, F.lit(0.0)) <= 0, F.lit(1.0)).when(intent["lo"].isNotNull(), explicit).when(intent["recent"], vague).otherwise(F.lit(1.0))


def title_bonus(title: Column, query: Column, boost: float = 0.12) -> Column:
    """boost times the title's share of the query's tokens, if the query covers the title; digits count only in titles of digits."""
    words = tx.content_tokens(title)
    plain = F.filter(words, lambda t: ~t.rlike("^[0-9]+$"))
    words = F.when(F.size(plain) > 0, plain).otherwise(words)
    asked = tx.content_tokens(query)
    return F.when((F.size(words) > 0) & tx.covers(words, asked), boost * F.size(words) / F.size(asked)).otherwise(F.lit(0.0))


def usage_factor(hits: Column, most: Column, prior: float) -> Column:
    return F.when(most > 0, 1 + prior * F.log1p(F.coalesce(hits, F.lit(0))) / F.log1p(most)).otherwise(F.lit(1.0))


def rare_share(hits: DataFrame, frequencies: Callable, n_chunks: int, keys: list[str]) -> DataFrame:
    """keys, rare: the share of a text's distinct content tokens that are in at most 0.8 % of chunks (two at least).

    `frequencies` gives a table with the named column of tokens a column df; tokens in no chunk are rare too. Only distinct
    tokens are looked up, and texts meet the few that are not rare, so no token of a text is shuffled.
    """
    ceiling = max(2.0, 0.008 * n_chunks)
    tokens = hits.select(*keys, F.explode_outer(tx.content_tokens(F.col("text"))).alias("term"))
    distinct = written(tokens.where("term is not null").select("term").distinct(), "tokens")
    common = written(frequencies(distinct, "term").where(F.col("df") > ceiling).select("term", F.lit(True).alias("common")), "common")
    told = tokens.join(common, "term", "left")
    return told.groupBy(*keys).agg((F.count_if(F.col("term").isNotNull() & F.col("common").isNull()) / F.greatest(F.count("term"), F.lit(1))).alias("rare"))


def informativeness(hits: DataFrame, frequencies: Callable, n_chunks: int, prior: float = 0.6, score: str = "score") -> DataFrame:
    """Vector hits (with `text`) reweighted by the share of rare content tokens, ranked anew; where `gate` is false, left as they are."""
    gate = F.col("gate") if "gate" in hits.columns else F.lit(True)
    rare = rare_share(hits.where(gate), frequencies, n_chunks, ["query_id", "chunk_id"])
    again = hits.drop("rank").join(rare, ["query_id", "chunk_id"], "left").withColumn(score, F.round(F.col(score) * (1 + prior * F.coalesce("rare", F.lit(0.0))), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("chunk_id"))
    return again.withColumn("rank", F.row_number().over(order) - 1)


def coverage(queries: DataFrame, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, chunk_id, cover: the weighted share of a query's tokens found in each hit (query_id, chunk_id, text, title).

    A token weighs 1 / (1 + ln(1 + occurrences)), with three occurrences assumed for unknown ones. It is found as it
    is; a Hangul token also without its last character (three and longer), without its last two (five and longer), or
    by its letters without the last final consonant (four letters and more). Queries of fewer than four tokens (two
    with Hangul) get no cover.
    """
    tokens = queries.select("query_id", F.explode(tx.coverage_tokens(F.col("text"))).alias("token"), F.size(tx.coverage_tokens(F.col("text"))).alias("n"), F.col("text").rlike("[가-힣]").alias("hangul"))
    tokens = tokens.where((F.col("n") >= 4) | (F.col("hangul") & (F.col("n") >= 2)))
    # The lexicon is reduced to the queries' tokens before anything else.
    terms = terms.join(tokens.select(F.col("token").alias("term")).distinct(), "term", "left_semi")
    weighed = tokens.join(terms.withColumnRenamed("term", "token").withColumnRenamed("n", "seen"), "token", "left").withColumn("w", 1 / (1 + F.log1p(F.coalesce("seen", F.lit(3)))))
    both = weighed.select("query_id", "token", "w").join(hits.select("query_id", "chunk_id", F.lower(F.concat_ws(" ", "text", "title")).alias("body")), "query_id")
    plain = both.where(~F.col("token").rlike("[가-힣]")).select("query_id", "chunk_id", "w", F.contains("body", "token").alias("inside"))
    korean = both.where(F.col("token").rlike("[가-힣]"))
    inside = F.contains("body", "token")
    for cut, least in ((1, 3), (2, 5)):
        inside |= (F.length("token") >= least) & F.contains(F.col("body"), F.expr(f"left(token, greatest(length(token) - {cut}, 1))"))
    # Letters are taken apart in Python, so only for tokens that are not found without.
    found = korean.withColumn("inside", inside)
    stem = tx.letters("token", F.lit(True))
    rest = found.where(~F.col("inside")).withColumn("stem", stem).withColumn("letters", tx.letters("body", F.lit(False)))
    rest = rest.withColumn("inside", (F.length("token") >= 2) & (F.length("stem") >= 4) & F.contains("letters", "stem"))
    columns = ["query_id", "chunk_id", "w", "inside"]
    rows = plain.unionByName(found.where("inside").select(columns)).unionByName(rest.select(columns))
    return rows.groupBy("query_id", "chunk_id").agg((F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("cover"))


def nested_alias(chunks: DataFrame) -> DataFrame:
    """chunk_id, alias: a burst chunk stands for the first body chunk of its document that contains it, else for itself."""
    bursts = chunks.where("kind = 'burst'").select("doc_id", F.col("chunk_id"), tx.squash(F.col("text")).alias("part"))
    bodies = chunks.where("kind = 'body'").select("doc_id", F.col("chunk_id").alias("alias"), "ord", tx.squash(F.col("text")).alias("whole"))
    found = bursts.join(bodies, "doc_id").where(F.contains("whole", "part")).groupBy("chunk_id").agg(F.min_by("alias", "ord").alias("alias"))
    return bursts.select("chunk_id").join(found, "chunk_id", "left").withColumn("alias", F.coalesce("alias", "chunk_id"))


def final_hits(rows: DataFrame, k: int, per_doc: int = PER_DOC) -> DataFrame:
    """The k best rows (query_id, chunk_id, doc_id, kind, text, fused), at most `per_doc` a document.

    A focused chunk whose text lies in a better one of its document, or the other way round, takes no place of its
    own. Only documents with a focused chunk among the hits are compared, hit by hit within the document.
    """
    if "kind" in rows.columns:
        part = tx.squash(F.col("text"))
        burst = rows.where("kind = 'burst'").select("query_id", "doc_id").distinct()
        near = rows.join(burst, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "chunk_id", "kind", "fused", part.alias("part"))
        better = near.select("query_id", "doc_id", F.col("chunk_id").alias("other"), F.col("kind").alias("other_kind"), F.col("fused").alias("other_fused"), F.col("part").alias("whole"))
        both = near.join(better, ["query_id", "doc_id"]).where((F.col("kind") == "burst") | (F.col("other_kind") == "burst"))
        ahead = (F.col("other_fused") > F.col("fused")) | ((F.col("other_fused") == F.col("fused")) & (F.col("other") < F.col("chunk_id")))
        nested = both.where(ahead & (F.contains("whole", "part") | F.contains("part", "whole"))).select("query_id", "chunk_id").distinct()
        rows = rows.join(nested, ["query_id", "chunk_id"], "left_anti")
    return capped_top_k(rows, k, per_doc)
