"""Retrieval and answer metrics as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def recall_mrr(ranked: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, recall at k and mean reciprocal rank at k from (query_id, rank, relevant)."""
    hit = F.when((F.col("relevant") > 0) & (F.col("rank") < k), 1.0 / (F.col("rank") + 1))
    per = ranked.groupBy("query_id").agg(F.max(hit).alias("rr"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("rr").isNotNull().cast("double")), 6).alias("recall"), F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"))


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg from (query_id, doc_id, rank, relevance): gain 2^r - 1, discount log2(rank + 2), repeated documents once."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    once = ranked.withColumn("n", F.row_number().over(first)).where("n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")) - 1
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")) - 1
    rows = once.withColumns({"i": place, "b": best})
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    part = lambda c: F.sum(F.when(F.col(c) < k, gain / F.log2(F.col(c) + 2.0)).otherwise(0.0))
    sums = rows.groupBy("query_id").agg(part("i").alias("dcg"), part("b").alias("idcg"))
    return sums.select("query_id", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def full_support(ranked: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """query_id, found, wanted, full: whether all gold documents are among the first k."""
    top = ranked.where(F.col("rank") < k).select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    joined = gold.select("query_id", "doc_id").distinct().join(top, ["query_id", "doc_id"], "left")
    return joined.groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"), (F.count("hit") == F.count("*")).alias("full"))


def token_f1(answers: DataFrame) -> DataFrame:
    """id, f1 and exact match from (id, predicted, gold): multiset overlap of normalised tokens."""
    norm = answers.select("id", tx.normalized_answer(F.col("predicted")).alias("p"), tx.normalized_answer(F.col("gold")).alias("g"))
    count = lambda c: norm.select("id", F.explode(F.filter(F.split(c, " "), lambda t: t != "")).alias("t")).groupBy("id", "t").agg(F.count("*").alias(c))
    shared = count("p").join(count("g"), ["id", "t"], "full").groupBy("id").agg(F.sum("p").alias("np"), F.sum("g").alias("ng"), F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("g", F.lit(0)))).alias("both"))
    out = norm.join(shared, "id", "left")
    f1 = F.when(F.col("both") > 0, 2.0 * F.col("both") / (F.col("np") + F.col("ng"))).otherwise(0.0)
    return out.select("id", F.round(f1, 6).alias("f1"), (F.col("p") == F.col("g")).alias("exact"), F.contains("p", "g").alias("contained"))


def by_type(results: DataFrame) -> DataFrame:
    """type, n, hit1, hit8, trap_above and median latency from (type, rank, trap_rank, ms); null ranks were not found."""
    below = F.coalesce(F.col("trap_rank") < F.coalesce("rank", F.lit(1 << 30)), F.lit(False))
    return results.groupBy("type").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(F.col("rank") < 1, F.lit(False)).cast("double")), 6).alias("hit1"),
        F.round(F.avg(F.coalesce(F.col("rank") < 8, F.lit(False)).cast("double")), 6).alias("hit8"),
        F.round(F.avg(below.cast("double")), 6).alias("trap_above"),
        F.percentile("ms", F.lit(0.5)).alias("p50_ms"),
    )
