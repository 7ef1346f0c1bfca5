"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised and projected on random Gaussian directions; each of `TABLES` tables buckets them by
the quantised values of `PROJECTIONS` directions, shifted by a random offset. Pairs that share a bucket and
a label are compared by exact cosine in double precision. At cosine 0.98 (distance 0.2) one table brings a
pair together with probability 0.33, all twenty miss it with probability below 0.001.

Equal vectors are merged first. Buckets are compared in blocks, each pair in the first table that brings it
together only; what comes back is a count per vector and spanning links, never all pairs.

Edge cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label
or id, link with nothing and keep themselves; vectors of different lengths never link; equal vectors link;
rows are what is linked, so equal rows count as separate vectors of one component, and rows of one id with different
vectors are separate too, each with its own links and component;
a pair at exactly the threshold links; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import blocked_buckets, by_sorted_key, join_hot, labelled_components, map_batches, materialize, run_pairs, stars, table

COSINE = 0.98
TABLES = 20
PROJECTIONS = 12
WIDTH = 1.8
SEED = 11


def projections(dims: int, tables: int = TABLES, each: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
    """Directions (dims, tables * each) and offsets; the same on every machine."""
    import numpy as np

    rng = np.random.default_rng([seed, dims])
    return rng.normal(size=(dims, tables * each)), rng.uniform(0, width, size=tables * each)


def bucket_ids(x, tables: int = TABLES, each: int = PROJECTIONS, width: float = WIDTH):
    """(vectors, tables) 64-bit bucket numbers of unit vectors."""
    import numpy as np

    directions, offsets = projections(x.shape[1], tables, each, width)
    cells = np.floor((x @ directions + offsets) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, each)
    rng = np.random.default_rng([SEED, 1])
    odd = rng.integers(0, 1 << 63, size=each, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (cells * odd).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _hashed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            sizes = batch["embedding"].map(len)
            for dims in sorted(sizes.unique()):
                part = batch[sizes == dims]
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "sig": list(bucket_ids(x))})

    return map_batches(classes.select("rep", "embedding"), run, "rep long, sig array<long>", rows=8192)


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """a, b, n: spanning links (b not null), and for each vector a the linked vectors n that one task found.

    `classes` has one row per distinct vector of a label: rep (its number), label, embedding (array of double), copies.
    """
    signed = materialize(_hashed(classes))
    members = classes.select("rep", "label", F.size("embedding").alias("dims")).join(signed, "rep")
    members = members.select("rep", "label", "dims", F.posexplode("sig").alias("table", "cell"))
    dealt = blocked_buckets(members, ["label", "dims", "table", "cell"], "rep").select("rep", "label", "dims", "table", "task", "mine", "other")
    full = dealt.join(classes.select("rep", "embedding", "copies").join(signed, "rep"), "rep")

    def compare(rows):
        import pandas as pd

        # Tasks are named by a hash; rows that only share the name differ in label or length.
        rows = rows.assign(kind=pd.factorize(rows["label"])[0])
        found = [compare_kind(part) for _, part in rows.groupby(["dims", "kind"], sort=True)]
        found = [f for f in found if f is not None]
        return pd.concat(found, ignore_index=True) if found else None

    def compare_kind(rows):
        import numpy as np
        import pandas as pd

        if len(rows) < 2:
            return None
        rows = rows.sort_values("task", kind="stable")
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sig = np.stack(rows["sig"].to_numpy())
        rep, copies = rows["rep"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
        which = rows["table"].to_numpy()
        counts = np.zeros(len(rows), dtype=np.int64)
        a, b = [], []
        for i, j in run_pairs(*(rows[c].to_numpy() for c in ("task", "mine", "other"))):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[near], j[near]
            if not len(i):
                continue
            same = sig[i] == sig[j]
            first = same.argmax(axis=1) == which[i]
            i, j = i[first], j[first]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            a.append(rep[i])
            b.append(rep[j])
        if not a or not counts.any():
            return None
        node, root = stars(np.concatenate(a), np.concatenate(b))
        hit = counts > 0
        found = pd.DataFrame({"a": rep[hit], "n": counts[hit]}).groupby("a", as_index=False)["n"].sum()
        none = pd.array([pd.NA] * len(found), dtype="Int64")
        return pd.concat(
            [found.assign(b=none), pd.DataFrame({"a": node, "n": 0, "b": pd.array(root, dtype="Int64")})], ignore_index=True
        )[["a", "b", "n"]]

    return by_sorted_key(full, "task", compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, label)."""
    value = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), value.alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists("embedding", lambda v: v != 0.0)
    good = F.coalesce(F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & ~zero, F.lit(False))
    # -0.0 and 0.0 are the same component.
    rows = rows.withColumns({"good": good, "embedding": F.transform("embedding", lambda v: v + F.lit(0.0))})
    rows = rows.withColumn("class_key", F.when(F.col("good"), F.xxhash64("label", F.size("embedding"), "embedding")))
    # Classes are numbered: a vec_id may name several of them.
    classes = rows.where("good").groupBy("class_key", "label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    found = materialize(links(classes, cosine))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    edges = found.where("b is not null").select("a", "b")
    named = (
        labelled_components(classes, edges, "rep", "least_id")
        .join(counts, "rep", "left")
        .select(
            "class_key",
            F.col("label").alias("_label"),
            F.col("embedding").alias("_embedding"),
            "copies",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            "component_id",
        )
    )
    same = (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    out = join_hot(rows, named, "class_key", "copies", same)
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
