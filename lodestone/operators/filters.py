"""Scoping operators in queries, and the documents and listings they select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import temporal as tm

FIELD_OPERATORS = ("type", "case", "status", "topic")
_NAMES = "tag|folder|path|type|case|status|topic|after|before|since|until"
_OPERATOR = rf'(?i)(?:^|\s)({_NAMES})\s*:\s*(?:"[^"]+"|\S+)'


def _values(query: Column, *names: str) -> Column:
    pattern = rf'(?i)(?:^|\s)(?:{"|".join(names)})\s*:\s*(?:"[^"]+"|\S+)'
    found = F.regexp_extract_all(query, F.lit(pattern), F.lit(0))
    value = F.transform(found, lambda m: F.btrim(F.regexp_replace(m, r'^\s*\w+\s*:\s*', ""), F.lit('" ')))
    return F.filter(value, lambda v: v != "")


def parse_operators(query: Column) -> Column:
    """struct(clean, tags, folders, type, case, status, topic, lo, hi, everywhere).

    Operators are always taken out of the text, also those whose date cannot be read.
    """
    everywhere = r"(?i)(?:^|\s)(?:scope\s*:\s*all|전체\s*:)(?=\s|$)"
    rest = F.regexp_replace(query, everywhere, " ")
    clean = F.trim(F.regexp_replace(rest, _OPERATOR, " "))
    lows = F.transform(_values(rest, "after", "since"), lambda v: tm.operator_bound(v, end=False))
    highs = F.transform(_values(rest, "before", "until"), lambda v: tm.operator_bound(v, end=True))
    tags = F.filter(F.transform(_values(rest, "tag"), lambda t: F.lower(F.regexp_replace(t, "^#+", ""))), lambda t: t != "")
    return F.struct(
        clean.alias("clean"),
        tags.alias("tags"),
        F.transform(_values(rest, "folder", "path"), lambda f: F.lower(f)).alias("folders"),
        *(F.transform(_values(rest, name), lambda v: F.lower(v)).alias(name) for name in FIELD_OPERATORS),
        F.array_max(lows).alias("lo"),
        F.array_min(highs).alias("hi"),
        query.rlike(everywhere).alias("everywhere"),
    )


def is_scoped(scope: Column) -> Column:
    """Whether any operator restricts the documents."""
    some = scope["lo"].isNotNull() | scope["hi"].isNotNull()
    for name in ("tags", "folders", *FIELD_OPERATORS):
        some |= F.size(scope[name]) > 0
    return some


def in_scope(scope: Column, tags: Column, path: Column, fields: Column | None = None, date: Column | None = None) -> Column:
    """Whether a document is selected: all tags, any folder at any depth, any value of every field, lo <= date < hi."""
    lowered = F.transform(tags, lambda t: F.lower(t))
    ok = F.size(F.array_except(scope["tags"], lowered)) == 0
    slashed = F.concat(F.lit("/"), F.lower(path))
    ok &= (F.size(scope["folders"]) == 0) | F.exists(scope["folders"], lambda f: F.contains(slashed, F.concat(F.lit("/"), F.btrim(f, F.lit("/")), F.lit("/"))))
    if fields is not None:
        for name in FIELD_OPERATORS:
            have = F.coalesce(F.try_element_at(fields, F.lit(name)), F.array().cast("array<string>"))
            ok &= (F.size(scope[name]) == 0) | F.arrays_overlap(scope[name], F.transform(have, lambda v: F.lower(F.trim(v))))
    if date is not None:
        ok &= (scope["lo"].isNull() | (date >= scope["lo"])) & (scope["hi"].isNull() | (date < scope["hi"]))
    return F.coalesce(ok, F.lit(False))


def listing(notes: DataFrame, k: int, date: str = "doc_date", key: str = "doc_id") -> DataFrame:
    """A scope without text: the newest k documents, one row each, score 0."""
    return notes.orderBy(F.desc(date), F.asc(key)).limit(k).withColumn("score", F.lit(0.0))


def visible(notes: DataFrame, flag: str = "lodestone") -> DataFrame:
    """Notes that do not ask to be left out (flag false, no or off in the frontmatter)."""
    value = F.lower(F.try_element_at(F.try_element_at("frontmatter", F.lit(flag)), F.lit(1)))
    return notes.where(~F.coalesce(value.isin("false", "no", "off"), F.lit(False)))


def recent(notes: DataFrame, now: float, days: float, k: int, date: str = "doc_date") -> DataFrame:
    return notes.where(F.col(date) >= now - days * tm.DAY).orderBy(F.desc(date), F.asc("doc_id")).limit(k)


def window_leg(notes: DataFrame, windows: DataFrame, k: int, date: str = "doc_date") -> DataFrame:
    """query_id, doc_id, ..., rank: the newest max(8, 2k) documents in each query's half-open window (query_id, lo, hi).

    A window is spread over the days it touches, from the first document's day to the last one's, and joined to the
    documents of those days, so no document meets a window elsewhere.
    """
    day = lambda c: F.floor(c / tm.DAY).cast("long")
    ends = notes.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    cut = windows.where("lo < hi").crossJoin(F.broadcast(ends))  # one row
    first, last = F.greatest("lo", "_first"), F.least("hi", "_last")
    spread = cut.where(first <= last).withColumn("day", F.explode(F.sequence(day(first), day(last)))).drop("_first", "_last")
    inside = spread.join(notes.withColumn("day", day(F.col(date))), "day").where((F.col(date) >= F.col("lo")) & (F.col(date) < F.col("hi"))).drop("day")
    order = Window.partitionBy("query_id").orderBy(F.desc(date), F.asc("doc_id"))
    return inside.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < max(8, 2 * k))


def tag_counts(notes: DataFrame, tags: str = "tags") -> DataFrame:
    """tag, n: notes per tag, the most frequent first."""
    return notes.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")
