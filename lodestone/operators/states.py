"""Writes to a vault as transitions of a table of notes: save, append, edit, rename, trash, restore, purge, approve.

A table of notes has path, content, state (live, pending or trash), generated (written by the engine, not by a
person), original (where a trashed note came from) and mtime. Every transition takes the table and a table of
requests and gives the table that follows; `outcomes` tells what became of each request. No path is ever taken twice:
a name that is in use gets the smallest free number behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

TRASH = ".trash/"
SCHEMA = "path string, content string, state string, generated boolean, original string, mtime double"
COLUMNS = ["path", "content", "state", "generated", "original", "mtime"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def placed(requests: DataFrame, notes: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Requests with the free path of each: base.md, or the smallest numbers behind it that no note and no earlier request has."""
    stem = F.regexp_replace("path", r"[.]md$", "")
    numbered = F.when(stem.rlike(r" [0-9]+$"), F.struct(F.regexp_extract(stem, r"^(.*) [0-9]+$", 1).alias("base"), F.regexp_extract(stem, r" ([0-9]+)$", 1).try_cast("int").alias("n")))
    uses = notes.select(F.explode(F.array_compact(F.array(F.struct(stem.alias("base"), F.lit(1).alias("n")), numbered))).alias("u")).select("u.*").where("n is not null")
    taken = uses.join(requests.select(F.col(base).alias("base")).distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("n").alias("taken"))
    nth = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    rows = requests.withColumn("_nth", nth).join(taken.withColumnRenamed("base", "_base"), F.col(base) == F.col("_base"), "left")
    used = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.element_at(F.array_except(F.sequence(F.lit(1), F.size(used) + F.col("_nth")), used), F.col("_nth"))
    number = F.when(free > 1, F.concat(F.lit(" "), free.cast("string"))).otherwise(F.lit(""))
    return rows.withColumn("path", F.concat(F.col(base), number, F.lit(".md"))).drop("_nth", "_base", "taken")


def _name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"[.]md$", "")


def save(notes: DataFrame, requests: DataFrame, now: float, approval: bool = False) -> DataFrame:
    """Notes and the new ones (content, and where given title and folder); empty contents are not saved.

    Without a title the first line names the note. With `approval` notes wait as pending ones.
    """
    given = {c: F.lit(None).cast("string") for c in ("title", "folder") if c not in requests.columns}
    rows = requests.withColumns(given).where(F.coalesce(F.trim("content"), F.lit("")) != "")
    first = F.element_at(F.split(F.trim("content"), "\n"), 1)
    name = F.coalesce(F.nullif(tx.safe_name(F.coalesce("title", F.lit(""))), F.lit("")), F.nullif(tx.safe_name(first), F.lit("")), F.lit("memory"))
    folder = F.coalesce(F.nullif(F.btrim(F.coalesce("folder", F.lit("")), F.lit("/ ")), F.lit("")), F.lit("memories"))
    rows = placed(rows.withColumn("_base", F.concat(folder, F.lit("/"), name)).withColumnRenamed("_base", "at"), notes, "at", ["content"])
    state = F.lit("pending" if approval else "live")
    return notes.select(*COLUMNS).unionByName(rows.select("path", F.trim("content").alias("content"), state.alias("state"), F.lit(True).alias("generated"), F.lit(None).cast("string").alias("original"), F.lit(float(now)).alias("mtime")))


def append(notes: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """Requests (path, content) as dated sections at the end of their notes; a note that is not there is created."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(float(now))), "yyyy-MM-dd HH:mm")
    path = F.when(F.col("path").endswith(".md"), F.col("path")).otherwise(F.concat("path", F.lit(".md")))
    asked = requests.where(F.trim("content") != "").select(path.alias("path"), F.concat(F.lit("\n\n## "), stamp, F.lit("\n\n"), F.trim("content"), F.lit("\n")).alias("block"))
    blocks = asked.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("block")), "").alias("block"))
    rows = notes.where("state <> 'trash'").join(blocks, "path", "full")
    new = F.concat(F.lit("# "), _name(F.col("path")))
    live = rows.select(
        "path",
        F.when(F.col("block").isNull(), F.col("content")).otherwise(F.concat(F.coalesce("content", new), "block")).alias("content"),
        F.coalesce("state", F.lit("live")).alias("state"),
        F.coalesce("generated", F.lit(True)).alias("generated"),
        "original",
        F.when(F.col("block").isNull(), F.col("mtime")).otherwise(F.lit(float(now))).alias("mtime"),
    )
    return live.unionByName(notes.where("state = 'trash'").select(*COLUMNS))


def outcomes(notes: DataFrame, requests: DataFrame, verb: str, human: bool = False) -> DataFrame:
    """path, outcome (done, missing, refused, conflict, exists) of every request to a verb (path; for write expect_mtime, for rename dst)."""
    found = requests.join(notes.select("path", "state", "generated", "mtime", F.lit(True).alias("there")), "path", "left")
    missing = F.col("there").isNull()
    if verb == "trash":
        out = F.when(missing | (F.col("state") == "trash"), "missing").when(~F.lit(human) & ~F.col("generated"), "refused")
    elif verb in ("restore", "purge"):
        out = F.when(missing | (F.col("state") != "trash"), "missing")
    elif verb == "approve":
        out = F.when(missing, "missing").when(F.col("state") != "pending", "refused")
    elif verb == "write":
        out = F.when(~missing & F.col("expect_mtime").isNotNull() & (F.abs(F.col("mtime") - F.col("expect_mtime")) > 0.001), "conflict")
    elif verb == "rename":
        found = found.join(notes.select(F.col("path").alias("dst"), F.lit(True).alias("held")), "dst", "left")
        first = F.row_number().over(Window.partitionBy("dst").orderBy("path")) == 1
        found = found.withColumn("first", first)
        out = F.when(missing | (F.col("state") == "trash"), "missing").when(F.col("held") | ~F.col("first"), "exists")
    else:
        raise ValueError(f"no such verb: {verb}")
    return found.select(*requests.columns, out.otherwise("done").alias("outcome"))


def _split(notes: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    paths = done.where("outcome = 'done'").drop("outcome").dropDuplicates(["path"])
    return notes.select(*COLUMNS).join(paths, "path"), notes.select(*COLUMNS).join(paths.select("path"), "path", "left_anti")


def trash(notes: DataFrame, requests: DataFrame, human: bool = False) -> DataFrame:
    """Notes moved to the trash folder, where they remember their path; only generated ones unless a person asks."""
    moved, rest = _split(notes, outcomes(notes, requests, "trash", human))
    moved = moved.withColumns({"original": F.col("path"), "at": F.concat(F.lit(TRASH), _name(F.col("path")))}).drop("path")
    moved = placed(moved, notes, "at", ["original"]).withColumn("state", F.lit("trash"))
    return rest.unionByName(moved.select(*COLUMNS))


def restore(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Trashed notes back where they came from (the root if that is not known), beside what has taken their place."""
    moved, rest = _split(notes, outcomes(notes, requests, "restore"))
    home = F.regexp_replace(F.coalesce("original", F.regexp_replace("path", "^.*/", "")), r"[.]md$", "")
    moved = placed(moved.withColumn("at", home).withColumnRenamed("path", "was"), rest, "at", ["was"])
    return rest.unionByName(moved.withColumns({"state": F.lit("live"), "original": F.lit(None).cast("string")}).select(*COLUMNS))


def purge(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Trashed notes gone for good; nothing outside the trash is reached."""
    return _split(notes, outcomes(notes, requests, "purge"))[1]


def approve(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Pending notes made live."""
    moved, rest = _split(notes, outcomes(notes, requests, "approve"))
    return rest.unionByName(moved.withColumn("state", F.lit("live")).select(*COLUMNS))


def write(notes: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """Whole contents (path, content, expect_mtime) written, but where the note has changed since it was read."""
    given = requests.withColumnRenamed("content", "fresh")
    good = outcomes(notes, given, "write").where("outcome = 'done'").dropDuplicates(["path"]).select("path", "fresh")
    rows = notes.select(*COLUMNS).join(good, "path", "full")
    hit = F.col("fresh").isNotNull()
    return rows.select(
        "path",
        F.coalesce("fresh", "content").alias("content"),
        F.coalesce("state", F.lit("live")).alias("state"),
        F.coalesce("generated", F.lit(False)).alias("generated"),
        "original",
        F.when(hit, F.lit(float(now))).otherwise(F.col("mtime")).alias("mtime"),
    )


def rename(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Notes (path, dst) moved to paths that no note has; links by title keep resolving."""
    moved, rest = _split(notes, outcomes(notes, requests, "rename"))
    return rest.unionByName(moved.drop("path").withColumnRenamed("dst", "path").select(*COLUMNS))


def listing(notes: DataFrame, state: str) -> DataFrame:
    """path, title, original, mtime of the notes in a state, newest first."""
    return notes.where(F.col("state") == state).select("path", _name(F.col("path")).alias("title"), "original", "mtime").orderBy(F.desc("mtime"), "path")


def indexable(notes: DataFrame) -> DataFrame:
    """Live notes: what search sees."""
    return notes.where("state = 'live'")
