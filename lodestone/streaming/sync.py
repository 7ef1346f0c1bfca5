"""Incremental sync: what changed, versioned snapshots, and streams of files and events."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RING = 1000


def changes(stored: DataFrame, seen: DataFrame, complete: bool = True) -> DataFrame:
    """path, change (added, updated, removed, unchanged) from two tables of path and content_hash.

    With `complete` false, paths that were not seen are left alone, as in a targeted sync.
    """
    old = stored.select("path", F.col("content_hash").alias("old"))
    new = seen.select("path", F.col("content_hash").alias("new"))
    both = old.join(new, "path", "full" if complete else "right")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def plan(changed: DataFrame) -> DataFrame:
    """One row of counters; nothing is written."""
    return changed.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed", "unchanged")))


def merged(stored: DataFrame, fresh: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of `stored` without the keys that are new or gone, and the fresh rows."""
    touched = fresh.select(key).unionByName(gone.select(key)).distinct()
    return stored.join(touched, key, "left_anti").unionByName(fresh)


class Snapshots:
    """Versioned table folders: a reader sees a whole version or the one before.

    A version notes in which version's folder each of its tables lies, so tables that a write doesn't touch are
    carried along without being copied.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._notes: dict[int, dict] = {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and fs.exists(s.getPath().suffix("/_DONE")))

    def reserve(self) -> int:
        """The number of a new version, its folder made for this writer alone; another writer gets another number."""
        fs, root = self._fs(self.root)
        taken = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")] if fs.exists(root) else []
        version = max(taken, default=0) + 1
        while True:
            fs, p = self._fs(f"{self.root}/v={version}/_TAKEN")
            try:
                fs.create(p, False).close()
                return version
            except Exception as e:  # the file system's own error for a file that exists
                if not fs.exists(p):
                    raise RuntimeError(f"no version can be written below {self.root}") from e
                version += 1

    def folder(self, version: int, name: str) -> str:
        return f"{self.root}/v={version}/{name}"

    def write(self, tables: dict[str, DataFrame], meta: dict | None = None, built: list[str] | None = None, more: dict[str, DataFrame] | None = None, version: int | None = None) -> int:
        """A new version with these tables and those of the version before.

        `built` names folders of a reserved `version` that are there already; `more` are rows that join a table, of which
        what was there before is not copied.
        """
        known = self.versions()
        version = self.reserve() if version is None else version
        held = dict(self.meta(known[-1])["tables"]) if known else {}
        for name, df in (tables | (more or {})).items():
            df.write.mode("overwrite").parquet(self.folder(version, name))
        held |= dict.fromkeys([*tables, *(built or [])], version)
        for name in more or {}:
            before = held.get(name, [])
            held[name] = [*(before if isinstance(before, list) else [before]), version]
        before = self.meta(known[-1]) if known else {}
        note = {**before, "at": time.time(), **(meta or {}), "tables": held}
        fs, p = self._fs(self.folder(version, "_DONE"))
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        return version

    def meta(self, version: int | None = None) -> dict | None:
        """What was noted with a version, the newest by default."""
        known = self.versions()
        version = version or (known[-1] if known else None)
        if version is None:
            return None
        if version not in self._notes:
            fs, p = self._fs(self.folder(version, "_DONE"))
            stream = fs.open(p)
            self._notes[version] = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return self._notes[version]

    def places(self, name: str, version: int | None = None) -> list[str]:
        """The folders of a table in a version, several where rows have joined it; none where that has no such table."""
        note = self.meta(version)
        at = [] if note is None else note["tables"].get(name, [])
        return [self.folder(v, name) for v in (at if isinstance(at, list) else [at])]

    def place(self, name: str, version: int | None = None) -> str | None:
        """The only or the newest folder of a table in a version; None where that has no such table."""
        return (self.places(name, version) or [None])[-1]

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table of the newest version or of one; None where that has no such table."""
        places = self.places(name, version)
        return self.spark.read.parquet(*places) if places else None

    def staged(self, df: DataFrame, place: str = "_staged") -> DataFrame:
        """A table of a version in the making, written once so that it is not computed for every use."""
        path = f"{self.root}/{place}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def unstage(self, place: str = "_staged") -> None:
        fs, p = self._fs(f"{self.root}/{place}")
        fs.delete(p, True)

    def backup(self, target: str) -> int:
        """Copy the tables of the newest version to another folder; its number there, 0 if there is nothing to copy."""
        note = self.meta()
        tables = [] if note is None else [t for t in note["tables"] if t != "index"]
        return Snapshots(self.spark, target).write({t: self.read(t) for t in tables}) if tables else 0

    def restore(self, source: str) -> int:
        """Make the newest version of a backup the newest version here; an index is no part of it (see `Engine.restore`)."""
        other = Snapshots(self.spark, source)
        note = other.meta()
        if note is None:
            raise ValueError("the backup is empty")
        version = self.reserve()
        for name in [t for t in note["tables"] if t != "index"]:
            other.read(name).write.mode("overwrite").parquet(self.folder(version, name))
        held = {t: version for t in note["tables"] if t != "index"}
        fs, p = self._fs(self.folder(version, "_DONE"))
        out = fs.create(p, False)
        # What was here before, its index too, is not part of the version that was restored.
        out.write(bytearray(json.dumps({**note, "at": time.time(), "restored": source, "tables": held}).encode()))
        out.close()
        return version


def watch(spark: SparkSession, folder: str, checkpoint: str, apply, every: str | None = "2 seconds", schema: str = "path string, modificationTime timestamp, length long, content binary"):
    """A stream of new note files (changed ones: see `Engine.watch`); `apply(batch, id)` gets each micro-batch. Without `every` it stops when caught up."""
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select("path", F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").cast("double").alias("mtime"))
    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ring(events: DataFrame, size: int = RING, key: str = "event_id") -> DataFrame:
    """The newest `size` events."""
    return events.orderBy(F.desc(key)).limit(size)


def ring_stream(events: DataFrame, size: int = RING, key: str = "event_id", parts: int = 16) -> DataFrame:
    """part and the columns of a stream's events: after each batch the newest `size` of every part that it touched.

    Events are dealt into `parts` by key, each a state of at most `size` events that is trimmed as it grows; the ring is
    among them (see `write_ring`). An event that comes again replaces itself. Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    schema, names = events.schema, events.columns

    class Ring(StatefulProcessor):
        def init(self, handle) -> None:
            self.held = handle.getListState("ring", schema)

        def handleInputRows(self, part, rows, timers):
            known = [tuple(r) for r in self.held.get()] if self.held.exists() else []
            both = pd.concat([pd.DataFrame(known, columns=names), *(r[names] for r in rows)], ignore_index=True)
            both = both.drop_duplicates(key, keep="last").sort_values(key, ascending=False).head(size)
            rows_out = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in both.itertuples(index=False, name=None)]
            self.held.put(rows_out)
            yield both.assign(part=part[0])[["part", *names]]

        def close(self) -> None:
            return None

    dealt = events.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    out = "part int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return dealt.groupBy("part").transformWithStateInPandas(statefulProcessor=Ring(), outputStructType=out, outputMode="Update", timeMode="None")


def write_ring(events: DataFrame, snapshots: Snapshots, checkpoint: str, size: int = RING, key: str = "event_id", every: str | None = None):
    """Keep the table `ring` of a store at the newest `size` events of a stream; a batch that comes again writes nothing new."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        note = snapshots.meta() or {}
        if note.get("ring_batch", -1) >= batch_id:
            return
        before = snapshots.read("ring_parts")
        touched = batch.select("part").distinct()
        parts = batch if before is None else before.join(touched, "part", "left_anti").unionByName(batch)
        parts = snapshots.staged(parts)
        snapshots.write({"ring_parts": parts, "ring": ring(parts.drop("part"), size, key)}, {"ring_batch": batch_id})
        snapshots.unstage()

    writer = ring_stream(events, size, key).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def runs(events: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """by, run, value, n: stretches of successive rows with one value, numbered from 1."""
    w = Window.partitionBy(by).orderBy(*order)
    fresh = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    rows = events.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w))
    return rows.groupBy(by, "run").agg(F.min(value).alias(value), F.count("*").alias("n"))


def detail(name: str, column: str = "props") -> Column:
    """A field of an event's JSON details; null where they cannot be read."""
    return F.get_json_object(column, f"$.{name}")


def within(at: str, lo: Column, hi: Column) -> Column:
    """Whether a time lies in a half-open window."""
    return (F.col(at) >= lo) & (F.col(at) < hi)


def idle_sessions(atoms: DataFrame, late: str = "10 minutes", gap: str = "180 seconds") -> DataFrame:
    """Sessions of atoms that end after three idle minutes (an event-time extension for streams and tables alike)."""
    rows = atoms.withWatermark("ts", late) if atoms.isStreaming else atoms
    return rows.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def client_windows(events: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events per client and tumbling window, with a watermark on streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"))
