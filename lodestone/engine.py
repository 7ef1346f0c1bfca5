"""A façade over a vault folder and its snapshots: index, search, ask, remember, maintain."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vector as vx
from lodestone.operators import agent, context, filters, graph, memory, similarity, states
from lodestone.operators import search as sr
from lodestone.sources import notes as nt
from lodestone.streaming import sync


SCENES = "path string, title string, heat long, mtime double, summary string, body string"


@dataclass
class Engine:
    """`embed` maps a DataFrame with text to one with vec; `generate` maps prompts to answers and may be missing."""

    spark: SparkSession
    vault: str
    store: str
    dims: int = 64
    model: str = "hashed"
    embed: object = None
    generate: object = None
    clock: object = time.time
    kinds: tuple[str, ...] = ("md",)
    settings: sr.Settings = field(default_factory=sr.Settings)
    stem: bool = True
    _snapshots: sync.Snapshots = field(init=False)

    def __post_init__(self):
        self._snapshots = sync.Snapshots(self.spark, self.store)
        if self.embed is None:
            self.embed = lambda df: nt.hashed_embedding(df, "text", self.dims)

    # -- indexing
    def _seen(self) -> DataFrame:
        return filters.visible(nt.parse_notes(nt.read_files(self.spark, self.vault, self.kinds)))

    def table(self, name: str) -> DataFrame:
        """A table of the newest version; the chunks with their vectors lie in the search index."""
        found = self._index().chunks if name == "chunks" else self._snapshots.read(name)
        if found is None:
            raise ValueError("nothing is indexed yet")
        return found

    def index_plan(self) -> DataFrame:
        stored = self._snapshots.read("notes")
        seen = self._seen()
        return sync.plan(sync.changes(seen.limit(0) if stored is None else stored, seen))

    def index(self, full: bool = False) -> dict[str, int]:
        """Parse, chunk and embed what changed; write notes, links and a new version of the search index.

        Files are parsed once. Of a later version only the chunks of changed notes are indexed, as a further segment, and
        only their vectors join the cache. Where no path, title or body changed nothing is written.
        """
        return self._apply(self._snapshots.staged(self._seen()), full)

    def sync_paths(self, paths: list[str], gone: list[str] = ()) -> dict[str, int]:
        """Index these note files and take away those that are gone; no other note is read or touched."""
        seen = filters.visible(nt.parse_notes(nt.read_paths(self.spark, self.vault, paths)))
        return self._apply(self._snapshots.staged(seen), False, gone)

    def watch_step(self, batch_id: int, quiet: float = 2.0, many: int = 200) -> dict[str, int] | None:
        """Index what has changed in the vault and been still for `quiet` seconds, and take away what is gone.

        What is pending lies in the store: by path, the time and length last seen and since when. Up to `many` paths are
        read by name, more by a whole scan. A step that was interrupted and comes again under its number finds what it had
        indexed unchanged and writes nothing twice; a number that is done does nothing.
        """
        if (self._snapshots.meta() or {}).get("watched", -1) >= batch_id:
            return None
        now = float(self.clock())
        seen = nt.listing(self.spark, self.vault, self.kinds).select("path", "mtime", "length")
        state = self._snapshots.read("watch")
        state = self.spark.createDataFrame([], "path string, mtime double, length long, since double, done boolean") if state is None else state
        before = state.select("path", *(F.col(c).alias(f"_{c}") for c in ("mtime", "length", "since", "done")))
        same = F.coalesce((F.col("mtime") == F.col("_mtime")) & (F.col("length") == F.col("_length")), F.lit(False))
        held = seen.join(before, "path", "left").select("path", "mtime", "length", F.when(same, F.col("_since")).otherwise(F.lit(now)).alias("since"), (same & F.coalesce("_done", F.lit(False))).alias("done"))
        stored = self._snapshots.read("notes")
        if stored is not None:
            held = held.join(stored.select("path", F.col("mtime").alias("_at")), "path", "left").withColumn("done", F.col("done") | F.coalesce(F.col("_at") == F.col("mtime"), F.lit(False))).drop("_at")
        held = self._snapshots.staged(held, "_watched")
        ready = held.where(~F.col("done") & (F.lit(now) - F.col("since") >= quiet)).select("path")
        gone = held.select("path").limit(0) if stored is None else stored.select("path").join(held.select("path"), "path", "left_anti")
        fresh, away = ([r["path"] for r in t.limit(many + 1).collect()] for t in (ready, gone))
        counts = None
        if len(fresh) > many or len(away) > many:
            counts = self.index()
        elif fresh or away:
            counts = self.sync_paths(fresh, away)
        after = held.withColumn("done", F.col("done") | (F.lit(now) - F.col("since") >= quiet))
        self._snapshots.write({"watch": after}, {"watched": batch_id})
        self._snapshots.unstage("_watched")
        return counts

    def watch(self, checkpoint: str, every: str = "2 seconds", quiet: float = 2.0):
        """A stream that looks at the vault at every tick (see `watch_step`); stop it as any other query."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        step = lambda _, batch_id: self.watch_step(batch_id, quiet)
        return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def _apply(self, seen: DataFrame, full: bool, gone: list[str] | None = None) -> dict[str, int]:
        stored = None if full else self._snapshots.read("notes")
        empty = seen.limit(0)
        changed = sync.changes(empty if stored is None else stored, seen, complete=gone is None)
        if gone:
            missing = self.spark.createDataFrame([(p, "removed") for p in gone], "path string, change string")
            changed = changed.join(missing, "path", "left_anti").unionByName(missing.join(empty.select("path") if stored is None else stored.select("path"), "path", "left_semi"))
        changed = self._snapshots.staged(changed)
        counts = sync.plan(changed).first().asDict()
        if stored is not None and not any(counts[c] for c in ("added", "updated", "removed")):
            return counts
        fresh = seen.join(changed.where("change in ('added', 'updated')").select("path"), "path", "left_semi").select(*seen.columns)
        notes = seen if stored is None else sync.merged(stored, fresh, stored.join(changed.where("change = 'removed'").select("path"), "path", "left_semi"), "doc_id")
        notes = self._snapshots.staged(notes)
        cuts = nt.chunk_notes(fresh).join(fresh.select("doc_id", "doc_date"), "doc_id")
        cache = self._snapshots.read("cache")
        none = self.spark.createDataFrame([], "key string, vec array<double>")
        embedded, new = nt.with_cached_embeddings(cuts, none if cache is None else cache, self.model, self.dims, self.embed)
        embedded = self._snapshots.staged(embedded)
        version = self._snapshots.reserve()
        place = self._snapshots.folder(version, "index")
        if stored is None or self._snapshots.place("index") is None:
            sr.SearchIndex.build(self.spark, place, embedded, stem=self.stem)
        else:
            away = stored.join(changed.where("change <> 'unchanged'").select("path"), "path", "left_semi").select("doc_id")
            self._index().extended(place, embedded, away)
        tables = {"notes": notes, "links": graph.links(notes)}
        self._snapshots.write(tables, {"counts": counts, "model": self.model, "dims": self.dims}, built=["index"], more={"cache": new}, version=version)
        self._snapshots.unstage()
        return counts

    def reindex_if_model_changed(self) -> bool:
        """Embed everything anew if the stored vectors are another model's or of another length; the cache keeps old keys."""
        meta = self._snapshots.meta()
        if meta is None or (meta.get("model"), meta.get("dims")) == (self.model, self.dims):
            return False
        self.index(full=True)
        return True

    # -- retrieval
    def _index(self) -> sr.SearchIndex:
        place = self._snapshots.place("index")
        if place is None:
            raise ValueError("nothing is indexed yet")
        return sr.SearchIndex(self.spark, place)

    def search(self, queries: DataFrame, k: int = 8, mode: str = "hybrid", **more) -> DataFrame:
        """Hits of every query (query_id, text) with the note's path, date, title and text.

        Operators in the text scope the notes before ranking; a query of operators only lists its scope.
        """
        notes = self.table("notes").where(~F.col("path").startswith(states.TRASH))
        index = self._index()
        if self.settings.usage > 0:
            more.setdefault("hits", self.hits())
        hits = sr.search(index, queries, k, mode, notes=notes, edges=self.table("links"), embed=self.embed, now=self.clock(), settings=self.settings, **more)
        return hits.join(notes.select("doc_id", "path", "doc_date", "mtime"), "doc_id").join(index.chunks.select("chunk_id", "title", "heading", "text"), "chunk_id")

    def record_hits(self, found: DataFrame) -> None:
        """Count the notes of a search result (query_id, doc_id), each once a query, as used now; later searches and the boot context know."""
        rows = found.select("query_id", "doc_id").distinct().select("doc_id", F.lit(float(self.clock())).alias("ts"))
        self._snapshots.write({}, more={"hits": rows})

    def hits(self) -> DataFrame:
        """doc_id, hits of the notes that were used."""
        rows = self._snapshots.read("hits")
        rows = self.spark.createDataFrame([], "doc_id long, ts double") if rows is None else rows
        return memory.hit_stats(rows).select("doc_id", "hits")

    def adaptive_search(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """Like `search`, with more hits for questions that ask for lists and counts."""
        wide = queries.withColumn("k", tx.adaptive_k(F.col("text"), k))
        most = wide.agg(F.max("k")).first()[0] or k
        return self.search(queries, most).join(wide.select("query_id", "k"), "query_id").where(F.col("rank") < F.col("k")).drop("k")

    def ask(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """query_id, prompt (and answer, if a generator is given)."""
        blocks = context.context_blocks(self.search(queries, k))
        made = context.prompts(blocks, queries)
        return self.generate(made) if self.generate else made

    def related(self, k: int = 8, index: similarity.InvertedLists | None = None) -> DataFrame:
        """Documents near each document; exact, or from the lists of an `index`, which miss some."""
        chunks = self.table("chunks")
        return similarity.related(chunks, vx.mean_vectors(chunks, "doc_id", "vec"), k, self.table("links"), index=index)

    def backup(self, target: str) -> int:
        return self._snapshots.backup(target)

    def restore(self, source: str) -> int:
        """Make a backup the newest version here, with an index of its notes."""
        version = self._snapshots.restore(source)
        self.rebuild_index()
        return version

    def rebuild_index(self) -> None:
        """Index the notes of the newest version anew; vectors come from the cache where it has them."""
        notes = self._snapshots.read("notes")
        if notes is None:
            return
        cuts = nt.chunk_notes(notes).join(notes.select("doc_id", "doc_date"), "doc_id")
        cache = self._snapshots.read("cache")
        none = self.spark.createDataFrame([], "key string, vec array<double>")
        embedded, new = nt.with_cached_embeddings(cuts, none if cache is None else cache, self.model, self.dims, self.embed)
        version = self._snapshots.reserve()
        sr.SearchIndex.build(self.spark, self._snapshots.folder(version, "index"), self._snapshots.staged(embedded), stem=self.stem)
        self._snapshots.write({}, {"model": self.model, "dims": self.dims}, built=["index"], more={"cache": new}, version=version)
        self._snapshots.unstage()

    # -- maintenance
    def conflicts(self, threshold: float = 0.80, limit: int | None = 50, index: similarity.InvertedLists | None = None) -> DataFrame:
        """Pairs of memories that contradict each other; all near pairs are met, or those that share lists of an `index`."""
        return memory.conflicts(self.table("chunks"), threshold, limit, index)

    def drift(self, each: int | None = 50) -> DataFrame:
        """Findings of each kind, at most `each` of them; None for all."""
        return memory.drift(self.table("notes"), each=each)

    def link_suggestions(self) -> DataFrame:
        return graph.suggestions(self.table("notes"), self.table("links"))

    def tree(self) -> DataFrame:
        return context.tree(self.table("notes"))

    # -- memory writes, as new versions of the table of memory notes
    def _memory(self) -> DataFrame:
        found = self._snapshots.read("memory")
        return states.empty(self.spark) if found is None else found

    def remember(self, rows: DataFrame, approval: bool = False) -> None:
        """Typed fragments (type, content, case, status, confidence, title) saved as notes."""
        self._snapshots.write({"memory": states.save(self._memory(), memory.remember(rows), self.clock(), approval)})

    def change(self, verb: str, requests: DataFrame, human: bool = False) -> DataFrame:
        """Apply a verb (trash, restore, purge, approve, write, append, rename) to memory notes; what became of each request."""
        notes = self._memory()
        if verb == "append":
            told = requests.withColumn("outcome", F.lit("done"))
            after = states.append(notes, requests, self.clock())
        else:
            told = self._snapshots.staged(states.outcomes(notes, requests, verb, human))
            move = {
                "trash": lambda: states.trash(notes, requests, human),
                "restore": lambda: states.restore(notes, requests),
                "purge": lambda: states.purge(notes, requests),
                "approve": lambda: states.approve(notes, requests),
                "write": lambda: states.write(notes, requests, self.clock()),
                "rename": lambda: states.rename(notes, requests),
            }
            after = move[verb]()
        self._snapshots.write({"memory": after})
        return told

    def memory_notes(self, state: str = "live") -> DataFrame:
        return states.listing(self._memory(), state)

    def consolidate(self, force: bool = False, idle: float = 180.0) -> int:
        """Turn what is new since the cursor into scenes and the persona; the number of atoms taken up.

        Nothing happens while the newest atom is younger than `idle` seconds, unless forced. The cursor moves to the
        newest atom taken up, in the same version as the scenes, so an interrupted run repeats and never skips.
        """
        front = {c: agent.field(c) for c in ("type", "topic", "case")}
        notes = self.table("notes").withColumns(front)
        cursor = (self._snapshots.meta() or {}).get("cursor", 0.0)
        atoms = self._snapshots.staged(memory.collect_atoms(notes, cursor))
        due = memory.consolidation_due(atoms, self.clock(), idle).first()["due"]
        if not (due or (force and atoms.head(1))):
            return 0
        known = self._snapshots.read("scenes")
        known = self.spark.createDataFrame([], SCENES) if known is None else known
        placed = self._snapshots.staged(memory.assign_scenes(atoms.select("group"), known.select(F.col("title").alias("group"), "heat", "mtime")))
        fresh = atoms.join(placed, "group").groupBy(F.col("scene").alias("title")).agg(F.count("*").alias("more"), F.max("mtime").alias("at"))
        day = datetime.fromtimestamp(self.clock(), UTC).date().isoformat()
        bodies = memory.scene_bodies(atoms, placed, known=known.select(F.col("title").alias("scene"), "body"), day=day).withColumnsRenamed({"scene": "title", "body": "fresh"})
        rows = known.join(fresh, "title", "full").join(bodies, "title", "left")
        scenes = rows.select(
            F.concat(F.lit("scenes/"), agent.safe_file(F.col("title")), F.lit(".md")).alias("path"),
            "title",
            (F.coalesce("heat", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("heat"),
            F.greatest(F.coalesce("mtime", F.lit(0.0)), F.coalesce("at", F.lit(0.0))).alias("mtime"),
            tx.snippet(F.coalesce("fresh", "body"), 80).alias("summary"),
            F.coalesce("fresh", "body").alias("body"),
        )
        before = self._snapshots.read("persona")
        lines = atoms.where("type in ('preference', 'digest')").select(F.col("text").alias("line"), F.struct(F.lit(1).alias("new"), "mtime", "doc_id").alias("ord"))
        if before is not None:
            old = before.select(F.posexplode(F.split("persona", "\n")).alias("at", "line"))
            lines = old.select("line", F.struct(F.lit(0).alias("new"), F.col("at").cast("double").alias("mtime"), F.lit(0).cast("long").alias("doc_id")).alias("ord")).unionByName(lines)
        taken = atoms.agg(F.count("*").alias("n"), F.max("mtime").alias("newest")).first()
        self._snapshots.write({"scenes": scenes, "persona": memory.persona(lines)}, {"cursor": taken["newest"]})
        self._snapshots.unstage()
        return taken["n"]

    def anchors(self, k: int = 12) -> DataFrame:
        return agent.anchored(self.table("notes"), k)

    def context(self, chars: int = 2400) -> DataFrame:
        """One row, block: what an agent reads before anything else."""
        empty = lambda schema: self.spark.createDataFrame([], schema)
        scenes, persona = self._snapshots.read("scenes"), self._snapshots.read("persona")
        scenes = empty(SCENES) if scenes is None else scenes
        persona = self.spark.createDataFrame([("",)], "persona string") if persona is None else persona
        cases = empty("`case` string, open_errors long, last_touched double")
        sections = agent.boot_sections(self.table("notes"), self.table("links"), self.hits(), scenes, cases, persona, self.clock())
        return agent.context_block(sections, chars)

    def repair_prompt(self) -> str:
        return agent.repair_prompt(memory.drift(self.table("notes"), each=None), self.table("notes"), self.vault).first()["prompt"]

    def status(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in ("notes", "chunks", "links", "cache")}
