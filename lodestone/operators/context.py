"""Context for answers: budgets, compact excerpts, reading order, trees and views of notes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.sources.tables import folder_for

BUDGET = 14_000


def context_blocks(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, rank, block: numbered blocks up to the first that would exceed the budget; later ones are not tried."""
    date = F.when(F.coalesce("doc_date", F.lit(0.0)) > 0, F.concat(F.lit(" ("), F.date_format(F.timestamp_seconds("doc_date"), "yyyy-MM-dd"), F.lit(")"))).otherwise(F.lit(""))
    head = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" › "), "heading")).otherwise(F.lit(""))
    block = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), "title", date, head, F.lit("\n"), "text", F.lit("\n"))
    rows = hits.withColumn("block", block)
    run = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", run).where(F.col("used") <= budget).select("query_id", "rank", "block", "used")


def running_total(rows: DataFrame, group: list[str], order: list[str], size: str, out: str = "used", slices: int | None = None) -> DataFrame:
    """`rows` with a running sum of `size` in each group, the row itself included; a group of any share of the rows is dealt over slices.

    Rows are cut by range into slices of about equal size, which are written. Sums of slices, a few rows a group, say what comes
    before each slice, and windows run inside slices only. Rows of equal order are summed in any order.
    """
    spark = rows.sparkSession
    number = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{folder_for(spark, 'runs')}/rows"
    rows.repartitionByRange(number, *group, *order).withColumn("_slice", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.groupBy(*group, "_slice").agg(F.sum(size).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_ahead", F.sum("_sum").over(ahead)).select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_slice").alias("_of"), "_ahead")
    match = F.col("_slice") == F.col("_of")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    whole = held.withColumn(out, F.sum(size).over(inside)).join(before, match, "left")
    # A running sum is null as long as every size is.
    total = F.when(F.col("_ahead").isNull(), F.col(out)).otherwise(F.col("_ahead") + F.coalesce(out, F.lit(0)))
    return whole.withColumn(out, total).drop("_slice", "_of", "_ahead", *(f"_{g}" for g in group))


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The rows of each group before its running size first exceeds the budget."""
    return running_total(rows, [group], [order], size).where(F.col("used") <= budget)


def prompts(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: the blocks in order, then the question."""
    joined = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda r: r["block"]), "\n").alias("context"))
    return queries.join(joined, "query_id").select("query_id", F.concat(F.lit("Notes:\n"), "context", F.lit("\nQuestion: "), "text").alias("prompt"))


def compact(hits: DataFrame, scored: DataFrame, each: int = 3) -> DataFrame:
    """query_id, chunk_id, excerpt: the best sentences of every hit (query_id, chunk_id, position, sentence, score) in text order."""
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "position")
    kept = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= each)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "sentence"))), lambda r: r["sentence"]), " ")
    return hits.join(kept.groupBy("query_id", "chunk_id").agg(text.alias("excerpt")), ["query_id", "chunk_id"], "left")


def hit_sentences(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.posexplode(tx.sentences(F.col("text"))).alias("position", "sentence"))


def adjacent(chunks: DataFrame) -> DataFrame:
    """chunk_id, before, after: texts of the neighbouring body chunks of the document."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    body = chunks.where("kind = 'body'") if "kind" in chunks.columns else chunks
    return body.select("chunk_id", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


def curriculum(hits: DataFrame, bend: float = 0.3) -> DataFrame:
    """query_id, chunk_id, position: from the best hit, each step to the hit nearest in direction, turns penalised.

    Hits per query number 24 at most, so each query is one small group.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(["rank", "chunk_id"]).reset_index(drop=True)
        x = np.stack(rows["vec"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        order, left = [0], list(range(1, len(rows)))
        while left:
            here = x[order[-1]]
            gain = x[left] @ here
            if len(order) > 1:
                last = here - x[order[-2]]
                step = x[left] - here
                turn = step @ last / np.maximum(np.linalg.norm(step, axis=1) * np.linalg.norm(last), 1e-12)
                gain = gain - bend * (1 - turn) / 2
            order.append(left.pop(int(np.argmax(gain))))
        out = rows.loc[order, ["query_id", "chunk_id"]].reset_index(drop=True)
        return out.assign(position=range(len(out)))

    return hits.select("query_id", "chunk_id", "rank", "vec").groupBy("query_id").applyInPandas(walk, "query_id long, chunk_id long, position long")


def tree(notes: DataFrame, each: int = 8) -> DataFrame:
    """dir, n, listed, more: newest first, the first titles of every folder, and how many are left out."""
    rows = notes.withColumn("dir", F.regexp_replace(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/$", ""))
    order = Window.partitionBy("dir").orderBy(F.desc("mtime"), "path")
    rows = rows.withColumn("n", F.row_number().over(order))
    out = rows.groupBy("dir").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("n") <= each, F.struct("n", "title")))).alias("t"))
    return out.select("dir", "n", F.transform("t", lambda r: r["title"]).alias("listed"), F.greatest(F.col("n") - each, F.lit(0)).alias("more"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the number of rows of every table, in one plan."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def body_lengths(chunks: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """by, chars, docs: characters and rows, map-side combined."""
    return chunks.groupBy(by).agg(F.sum(F.length(text)).alias("chars"), F.count("*").alias("docs"))


def abstract(title, body, length: int = 200):
    """Title and the start of the first paragraph."""
    return F.concat(title, F.lit(" — "), tx.snippet(body, length))


@F.pandas_udf(T.StringType())
def overview(body: pd.Series) -> pd.Series:
    """Headings with the first line of their sections, code blocks skipped, at most 2,400 characters."""

    def one(text: str | None) -> str:
        out, waiting, fenced, used = [], False, False, 0
        for line in (text or "").split("\n"):
            bare = line.strip()
            if bare.startswith("```"):
                fenced = not fenced
            if fenced or bare.startswith("```") or not bare:
                continue
            heading = bare.startswith("#")
            if heading or waiting or not out:
                used += len(bare) + 1
                if used > 2400:
                    break
                out.append(bare)
                waiting = heading
        return "\n".join(out)

    return body.map(one)


# Words that point back to what was said, at the start of a turn or behind a space.
ANAPHORA = ("그거", "그건", "그때", "그게", "그 ", "이거", "이건", "아까", "방금", "걔", "쟤", "거기", "it ", "that ", "this ")


def contextual_queries(turns: DataFrame, tail: int = 160, short: int = 16) -> DataFrame:
    """Every user turn (conv_id, turn, role, text); short or anaphoric ones with the last user and assistant turns in front."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda role: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(w)
    asked = turns.withColumns({"user": before("user"), "assistant": before("assistant")})
    bare = F.trim("text")
    vague = (F.length(bare) <= short) | F.exists(F.array(*map(F.lit, ANAPHORA)), lambda a: bare.startswith(a) | F.contains(F.concat(F.lit(" "), bare), F.concat(F.lit(" "), a)))
    near = lambda c: F.left(F.col(c), F.lit(tail))
    known = F.col("user").isNotNull() | F.col("assistant").isNotNull()
    return asked.where("role = 'user'").select("conv_id", "turn", F.when(vague & known, F.concat_ws(" ", near("user"), near("assistant"), "text")).otherwise(F.col("text")).alias("query"))
