"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are divided by all pages of the host; lines above a ratio are boilerplate and are
dropped from that host's pages. It is one formula for hosts of all sizes; a line on one page only is no repetition and stays.

Counting is a map-side combined aggregation over (host, line hash), joined to the pages of each host, a table whose
measured size decides whether it is broadcast or repeated over salts. The boilerplate lines of a host number at most
(mean distinct lines a page) / ratio and come back as one array a host, which is joined the same way, so a hot host is
dealt over tasks. Lines are told apart by a 64-bit hash.

Edge cases: a null text stays null and counts as a page without lines; blank lines are neither counted nor
dropped; a line is compared without the white space around it and counts once a page, however often it is
repeated there; a line at exactly the ratio stays; a null host is a host of its own; a page that is boilerplate
throughout becomes an empty text; ids may repeat and every row counts as a page; an empty table gives an empty
result; all other columns are kept, whatever their names, but for n_dropped, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import join_measured, materialize, table

RATIO = 0.08
_EDGES = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_EDGES)))


def boilerplate(pages: DataFrame, host: str, ratio: float = RATIO) -> DataFrame:
    """One row per host that has boilerplate: host, drop (hashes of its boilerplate lines)."""
    pages = pages.select(F.col(_quoted(host)).alias("host"), F.col("text").cast("string").alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), _key))
    found = pages.select("host", F.explode(lines).alias("line")).where(F.col("line") != F.xxhash64(F.lit("")))
    per_line = found.groupBy("host", "line").agg(F.count("*").alias("on_pages")).where("on_pages > 1")
    totals = materialize(pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages")))
    common = join_measured(per_line, totals, F.col("host").eqNullSafe(F.col("of")), "inner", salt=F.col("line"))
    common = common.where(F.col("on_pages") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def drop_boilerplate(pages: DataFrame, host: str, **parameters) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, and n_dropped added."""
    held = [c for c in pages.columns if c not in ("text", "n_dropped")]
    packed = pages.select(F.struct(*(F.col(_quoted(c)) for c in held)).alias("row"), F.col("text").cast("string").alias("text"))
    known = materialize(boilerplate(pages, host, **parameters))
    match = F.col("row")[host].eqNullSafe(F.col("host"))
    joined = join_measured(packed, known, match, salt=F.xxhash64("text"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("drop"), _key(line)))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("drop").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept))
    done = joined.select("row", text.alias("text"), dropped.cast("long").alias("n_dropped"))
    # The names of the pages' own columns come back last, when no other name is in use any more.
    return done.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in pages.columns if c != "n_dropped"), "n_dropped")


def _quoted(name: str) -> str:
    return f"`{name}`"


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, "source").select("doc_id", "text", "n_dropped")


OP9_SQL = rf"""
WITH lines AS (
  SELECT DISTINCT rid, source, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT row_number() OVER () AS rid, source, unnest(string_split(text, chr(10))) AS line FROM documents)
), totals AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), common AS (
  SELECT l.source, l.line
  FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.line <> '' GROUP BY l.source, l.line, t.pages
  HAVING count(*) > 1 AND count(*) > {RATIO}::DOUBLE * t.pages
), gone AS (SELECT source, list(line) AS lines FROM common GROUP BY source),
parts AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS all_lines, coalesce(g.lines, []) AS gone
  FROM documents d LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source
), kept AS (
  SELECT doc_id, text, all_lines,
    list_filter(all_lines, lambda x: NOT list_contains(gone, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS left_lines
  FROM parts
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(left_lines, chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(all_lines) - len(left_lines) END AS BIGINT) AS n_dropped
FROM kept
"""
