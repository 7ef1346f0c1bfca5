"""What several operators of this subpackage need: shared storage, folds, connected components, blocked pairs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one block when a bucket of similarity candidates is split.
BLOCK = 1024
#: Bytes of files up to which a measured side of a join is broadcast, and the salts of a hot key beyond.
BROADCAST_BYTES = 16 << 20
SALTS = 32
#: Rows of one class up to which they may meet in one task.
HOT_ROWS = 50_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read, deleted when the driver ends.

    Where that setting is missing, a session on one machine (tests) gets a local folder; a cluster has no folder
    that all executors can read, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a materialized table that is no longer read."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frame(batch):
    """A pandas frame of an Arrow batch; integers beside nulls stay integers of 64 bits, with pandas' NA for null."""
    import pandas as pd
    import pyarrow as pa

    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}
    columns = (c.to_pandas(types_mapper=whole.get) if c.null_count else c.to_pandas() for c in batch.columns)
    return pd.DataFrame(dict(zip(batch.schema.names, columns, strict=True)))


def give_back() -> None:
    """Return memory that a finished task no longer uses from the worker process to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library: nothing to trim
        return


def map_batches(df: DataFrame, work: Callable, schema: str | StructType, rows: int = 500) -> DataFrame:
    """Stream pandas frames of at most `rows` rows through `work`, which yields frames with the columns of `schema`.

    Ids keep all their 64 bits beside nulls (see `frame`). Where the session does not set the bytes of an Arrow
    batch, 4 MB are set, so that whole texts of any length fit a worker's memory.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(4 << 20))
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    written = to_arrow_schema(kind)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def frames() -> Iterator:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield frame(batch.slice(at, rows))

        try:
            for out in work(frames()):
                yield from pa.Table.from_pandas(out, schema=written, preserve_index=False).combine_chunks().to_batches()
        finally:
            give_back()

    return df.mapInArrow(run, kind)


def join_measured(rows: DataFrame, side: DataFrame, match: Column | list[str], how: str = "left", bound: int = BROADCAST_BYTES, salt: Column | None = None) -> DataFrame:
    """Join `rows` with a written table `side` of distinct keys, whatever share of the rows one key holds.

    `side` is broadcast if the bytes of its files, measured now, are within `bound`. Else it is repeated once for
    each of `SALTS` salts, of which each row has one by `salt` (all its columns), so a key is dealt over as many tasks.
    """
    if stored_bytes(side) <= bound:
        return rows.join(F.broadcast(side), match, how)
    salted = rows.withColumn("_salt", F.pmod(salt if salt is not None else F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    of = "_salt" if isinstance(match, list) else "_salt_of"
    spread = side.withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = [*match, of] if isinstance(match, list) else match & (F.col("_salt") == F.col(of))
    return salted.join(spread, match, how).drop("_salt", of)


def join_hot(rows: DataFrame, classes: DataFrame, key: str, copies: str, same: Column | None = None, hot: int = HOT_ROWS, inner: bool = False) -> DataFrame:
    """Left (or inner) join of `rows` with one row a class on `key` (and `same`), where `copies` rows of a class may be any share of all.

    Classes of more than `hot` rows are at most 1 in `hot` of the rows. They are joined on a salt too, so the rows of
    each meet in several tasks; the others shuffle by key. The columns of `classes` other than the key are added.
    """
    split, how = F.col(copies) > hot, "inner" if inner else "left"
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    big = materialize(classes.where(split).select(key).distinct())
    few = big.count()
    match = F.col(key) == F.col("_key")
    match = match if same is None else match & same
    side = classes.withColumnRenamed(key, "_key").drop(copies)
    if not few:
        return rows.join(side, match, how).drop("_key")
    marked = join_measured(rows, big.select(F.col(key).alias("_hot"), F.lit(True).alias("_is_hot")), F.col(key) == F.col("_hot")).drop("_hot")
    marked = marked.withColumn("_salt", F.when(F.col("_is_hot"), salt).otherwise(F.lit(0)))
    spread = F.when(split, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    side = classes.withColumn("_salt_of", F.explode(spread)).withColumnRenamed(key, "_key").drop(copies)
    return marked.join(side, match & (F.col("_salt") == F.col("_salt_of")), how).drop("_key", "_salt", "_salt_of", "_is_hot")


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a materialized table."""
    spark = df.sparkSession
    hadoop, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(hadoop).getContentSummary(path).getLength()
    return total


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in fold -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_share(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About `bound` rows, and never the whole of a larger table: those whose hashed key falls below bound / count.

    The same rows on every run. No sort and no shuffle; one count over the key column.
    """
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 24)) < int((1 << 24) * bound / n))


def sampled_ids(keys: DataFrame, bound: int, seed: int = 17) -> DataFrame:
    """At most `bound` distinct ids of a table (doc_id, ...), the same ones on every run: those first by hash."""
    picked = hashed_share(keys, "doc_id", bound, seed).dropDuplicates(["doc_id"])
    return picked.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(bound)


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, folds: int, held_out: int, bound: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most about `bound` labelled documents outside the held-out fold, on the driver.

    The sampled ids number `bound` at most (that is what is broadcast), so the documents are scanned once
    and never shuffled. Rows with a null id, a null text or a null label teach nothing, nor do ids whose labels
    contradict each other. Of equal texts under one id one is taken.
    """
    labels = table(spark, sf_dir, "labels").where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("most"))
    picked = sampled_ids(labels.where("y = most").select("doc_id", "y"), bound)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    rows = docs.join(F.broadcast(picked), "doc_id").toPandas().drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["y"].tolist()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    `edges` has long columns a, b in any direction, with repeats and self-loops allowed. Alternating
    large-star and small-star passes shrink each component to a star around its minimum in a number of
    passes that grows with the logarithm of its size; every pass is a join and a map-side combined
    minimum, written to the shared folder.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(map_batches(flat, _local_stars, "u long, v long", rows=65536).distinct())
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        small = materialize(_small_star(_large_star(now)))
        drop_written(now)
        now, before = small, mark
        mark = _fingerprint(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def stars(a, b):
    """Union the pairs of two long arrays: (node, smallest node of its component) for every other node."""
    import numpy as np

    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local_stars(batches: Iterator) -> Iterator:
    """Replace the edges of each batch by stars with the same components."""
    import pandas as pd

    for batch in batches:
        if len(batch):
            u, v = stars(batch["u"].to_numpy(), batch["v"].to_numpy())
            yield pd.DataFrame({"u": u, "v": v})


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")).select("u", F.least("u", "m").alias("m"), "edges"))
    moved = join_hot(both.where("v > u"), least, "u", "edges")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them; edges point from large u to small v."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")))
    moved = join_hot(edges, least, "u", "edges").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def labelled_components(classes: DataFrame, edges: DataFrame, key: str, label: str) -> DataFrame:
    """`classes` with component_id: the smallest `label` of the classes that `edges` (a, b of their keys) connect.

    Keys are unique, labels need not be: two classes of one label are joined by edges only. A component of any share
    of the classes is split over tasks.
    """
    parts = connected_components(edges)
    held = materialize(classes.join(parts, F.col(key) == F.col("node"), "left").drop("node"))
    least = materialize(held.where("component is not null").groupBy("component").agg(F.min(label).alias("least"), F.count("*").alias("members")))
    return join_hot(held, least, "component", "members").withColumn("component_id", F.coalesce("least", label)).drop("component", "least")


def blocked_buckets(members: DataFrame, key: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """Give every member of a bucket the block pairs in which it takes part: columns task, mine, other.

    Buckets of one member vanish. A bucket of n members is dealt into ceil(n / block) blocks and every
    pair of blocks becomes a task of its own, so no bucket, however large, meets in one task and none
    is cut. Rows are repeated once for each block of their bucket. Two rows of a task are to be compared
    if they are of different blocks, or if the task is a block with itself (see `run_pairs`).
    """
    # Buckets are told apart by a hash: two that share one are compared as one, which costs and changes nothing.
    members = members.withColumn("bucket_key", F.xxhash64(*key))
    sizes = materialize(members.groupBy("bucket_key").agg(F.count("*").alias("bucket_n")).where("bucket_n > 1"))
    sizes = sizes.withColumn("bucket_rows", F.col("bucket_n"))
    dealt = join_hot(members, sizes, "bucket_key", "bucket_rows", inner=True).withColumn("blocks", F.ceil(F.col("bucket_n") / block).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), F.col(order)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("task", F.xxhash64("bucket_key", F.least("mine", "other"), F.greatest("mine", "other"))).drop(
        "bucket_n", "blocks", "bucket_key"
    )


def run_pairs(task, mine, other, heads=None) -> Iterator:
    """Pairs of positions to compare within the runs of a sorted task column, a slice of them at a time.

    With `heads`, the positions that may come first in a pair, only pairs that begin with one of them.
    """
    import numpy as np

    n = len(task)
    if n < 2:
        return
    last = np.flatnonzero(np.append(task[1:] != task[:-1], True))
    ends = last[np.searchsorted(last, np.arange(n))]
    alive = np.arange(n) if heads is None else np.asarray(heads)
    end, step = ends[alive], 1
    # Where every task is a block with itself all its pairs are compared.
    whole = bool((np.asarray(mine) == np.asarray(other)).all())
    while True:
        inside = alive + step <= end
        alive, end = alive[inside], end[inside]
        if not len(alive):
            return
        to = alive + step
        if whole:
            yield alive, to
        else:
            use = (mine[alive] != mine[to]) | (mine[alive] == other[alive])
            if use.any():
                yield alive[use], to[use]
        step += 1


def whole_runs(batches: Iterator, key: str) -> Iterator:
    """Regroup sorted pandas batches so that the rows of one key are never split between two of them."""
    import pandas as pd

    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        last = batch[key].to_numpy()
        cut = int((last != last[-1]).nonzero()[0][-1]) + 1 if (last != last[-1]).any() else 0
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        held = batch.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def by_sorted_key(df: DataFrame, key: str, work: Callable, schema: str) -> DataFrame:
    """Bring rows of a key together, sorted, and stream them through `work` a few whole keys at a time."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator) -> Iterator:
        for group in whole_runs(batches, key):
            out = work(group)
            if out is not None and len(out):
                yield out

    return map_batches(df.repartition(parts, key).sortWithinPartitions(key), run, schema, rows=8192)
