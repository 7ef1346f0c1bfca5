"""Items from elsewhere as notes: connectors as Spark data sources, in batches and as streams with kept offsets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from lodestone.operators.agent import safe_file, yaml_scalar

SCHEMA = "id string, title string, body string, folder string, date string, tags array<string>"
_FIELDS = ("id", "title", "body", "folder", "date", "tags")


def _row(item: dict) -> tuple:
    text = lambda k: None if item.get(k) is None else str(item[k])
    return (text("id"), text("title"), text("body"), text("folder"), text("date"), [str(t) for t in item.get("tags") or []])


class _Batch(DataSourceReader):
    def __init__(self, pull: Callable):
        self.pull = pull

    def read(self, partition) -> Iterator[tuple]:
        yield from map(_row, self.pull({})[0])


class _Stream(SimpleDataSourceStreamReader):
    """The state a pull returns is the offset of the next one, so Spark's checkpoint is what remembers it."""

    def __init__(self, pull: Callable):
        self.pull = pull

    def initialOffset(self) -> dict:
        return {"state": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        items, state = self.pull(json.loads(start["state"]))
        return iter(list(map(_row, items))), {"state": json.dumps(state, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        items, _ = self.pull(json.loads(start["state"]))
        return iter(list(map(_row, items)))


def register(spark: SparkSession, name: str, pull: Callable) -> str:
    """Make a connector readable as a format: `pull` maps a state to its new items (dicts) and the state after them."""

    class Connector(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(pull)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Stream(pull)

    spark.dataSource.register(Connector)
    return name


def as_notes(items: DataFrame, connector: str, folder: str = "") -> DataFrame:
    """path, raw of the items that have a title and a body; of items with one path the last by body is taken."""
    base = F.lit(folder or f"imported/{connector}")
    sub: Column = F.when(F.trim(F.coalesce("folder", F.lit(""))) != "", F.concat(F.lit("/"), safe_file(F.col("folder")))).otherwise(F.lit(""))
    name = safe_file(F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.col("title")))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.regexp_replace(F.trim(t), "^#+", "")), lambda t: t != "")
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("source: "), yaml_scalar(F.lit(f"connector:{connector}"))),
        F.when(F.trim(F.coalesce("date", F.lit(""))) != "", F.concat(F.lit("date: "), F.trim("date"))),
        F.concat(F.lit("tags: ["), F.concat_ws(", ", F.concat(F.array(F.lit("connector")), tags)), F.lit("]")),
        F.lit("---"),
    )
    rows = items.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    rows = rows.select(F.concat(base, sub, F.lit("/"), name, F.lit(".md")).alias("path"), F.concat(front, F.lit("\n\n# "), F.trim("title"), F.lit("\n\n"), F.trim("body"), F.lit("\n")).alias("raw"))
    return rows.groupBy("path").agg(F.max("raw").alias("raw"))


def report(items: DataFrame) -> DataFrame:
    """One row: how many items can be written, and how many lack a title or a body."""
    good = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("body", F.lit(""))) != "")
    return items.agg(F.count_if(good).alias("written"), F.count_if(~good).alias("skipped"))
