"""Chat exports and transcripts as conversation rows, and conversations as notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_CHARS = 60_000
_MESSAGE = "struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>"
_TREE = f"array<struct<title:string,create_time:double,mapping:map<string,{_MESSAGE}>>>"
_FLAT = "array<struct<name:string,created_at:string,chat_messages:array<struct<sender:string,text:string>>>>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """conv, title, date, position, role, text from an export in either known form; anything else raises."""
    raw = spark.read.text(path, wholetext=True)
    both = raw.select(F.posexplode(F.from_json("value", _TREE)).alias("conv", "c")).where("c.mapping is not null")
    flat = raw.select(F.posexplode(F.from_json("value", _FLAT)).alias("conv", "c")).where("c.chat_messages is not null")
    if not both.isEmpty():
        return tree_messages(both)
    if not flat.isEmpty():
        return flat_messages(flat)
    raise ValueError("neither a message tree nor a list of messages")


def tree_messages(conversations: DataFrame) -> DataFrame:
    """Messages of user and assistant with text, by time."""
    m = conversations.select("conv", "c.title", "c.create_time", F.posexplode(F.map_values("c.mapping")).alias("i", "m"))
    text = F.trim(F.array_join(F.filter(F.col("m.message.content.parts"), lambda p: p.isNotNull()), "\n"))
    rows = m.select("conv", "title", F.to_date(F.timestamp_seconds("create_time")).alias("date"), F.struct(F.coalesce("m.message.create_time", F.lit(0.0)).alias("t"), "i", F.col("m.message.author.role").alias("role"), text.alias("text")).alias("s"))
    rows = rows.where("s.role in ('user', 'assistant') and s.text <> ''")
    lists = rows.groupBy("conv", "title", "date").agg(F.sort_array(F.collect_list("s")).alias("all"))
    return lists.select("conv", "title", "date", F.posexplode("all").alias("position", "s")).select("conv", "title", "date", "position", "s.role", "s.text")


def flat_messages(conversations: DataFrame) -> DataFrame:
    """Messages in the order of the list; empty ones dropped; a sender `human` is the user."""
    m = conversations.select("conv", F.col("c.name").alias("title"), F.to_date(F.substring("c.created_at", 1, 10)).alias("date"), F.posexplode("c.chat_messages").alias("position", "m"))
    role = F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender"))
    return m.select("conv", "title", "date", "position", role.alias("role"), F.trim("m.text").alias("text")).where("text <> ''")


def read_transcripts(spark: SparkSession, path: str, keep: int = 60_000) -> DataFrame:
    """file, text: user and assistant lines of JSONL transcripts, the last `keep` characters."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"), "value")
    role = F.get_json_object("value", "$.message.role")
    whole = F.get_json_object("value", "$.message.content")
    parts = F.from_json(whole, "array<struct<type:string,text:string>>")
    text = F.when(whole.startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(whole)
    rows = lines.select("file", "i", role.alias("role"), text.alias("text")).where("role in ('user', 'assistant') and text <> ''")
    joined = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("i", F.concat_ws(": ", "role", "text").alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda r: r["line"]), "\n\n")
    return joined.select("file", F.right(body, F.lit(keep)).alias("text"))


def conversation_notes(messages: DataFrame, folder: str = "chats", existing: DataFrame | None = None) -> DataFrame:
    """path, title, raw: one dated note per conversation, cut at 60,000 characters; paths in `existing` are skipped."""
    line = F.concat(F.lit("**"), "role", F.lit("**: "), "text")
    joined = messages.groupBy("conv", "title", "date").agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    body = F.left(F.array_join(F.transform("l", lambda r: r["line"]), "\n\n"), F.lit(NOTE_CHARS))
    name = F.left(F.trim(F.regexp_replace(F.coalesce("title", F.lit("conversation")), r"[\\/:*?\"<>|#^\[\]]+", " ")), F.lit(80))
    out = joined.select(F.concat_ws("", F.lit(f"{folder}/"), F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), name), F.lit(".md")).alias("path"), "title", body.alias("raw"))
    return out if existing is None else out.join(existing.select("path"), "path", "left_anti")


def session_versions(sessions: DataFrame) -> DataFrame:
    """The latest version of every session; its id is the given one or the hash of the first user turn."""
    sid = F.coalesce("session_id", F.left(F.sha1(F.col("first_user").cast("binary")), F.lit(12)))
    return sessions.withColumn("session_id", sid).groupBy("session_id").agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts"))
