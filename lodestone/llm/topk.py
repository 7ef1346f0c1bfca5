"""Exact top-k search by inner product with block-at-a-time pruning.

Components are the terms, and their integer codes the weights. Rows are ordered by the nearest of a few pivots and
cut into document ranges: shards of about `SHARD` rows, and blocks of `BLOCK` rows in them. A block keeps a forward
index (the codes of its rows) and, for each term, the largest and the smallest weight. A query sums, over its terms,
the larger product with the two: no row of the block scores more. Blocks are taken by falling sums, all rows of a
block are scored from its forward index, and a query stops where the next sum is below its k-th best score.

Queries first search the shard they lie in; the k-th score found there is where their search of all other shards
begins, so those give back only rows that can still enter. A task holds one shard and one group of queries.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors
of different lengths are compared as if the shorter ended in zeros, so an empty vector scores 0 with all; every row is
a document of its own, also under a repeated id, so a row is found by the other rows of its id; a repeated query row
is asked once for each row; ties go to the smaller id; scores beyond 64 bits are set to the end of the range; fewer
than k other rows are all returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import by_sorted_key, hashed_share, map_batches, materialize, table

K = 20
SCALE = 64
#: Rows of a block, of a shard, of a group of queries; and vectors at most that order the rows.
BLOCK = 64
SHARD = 8192
GROUP = 8192
PIVOTS = 256
#: Numbers that one step of scoring holds.
_HELD = 4 << 20
LEAST, MOST = 1 - (1 << 63), (1 << 63) - 1


def codes_of(x):
    """floor(SCALE * x) of an array of doubles, as doubles that hold whole numbers."""
    import numpy as np

    return np.floor(np.asarray(x, dtype=np.float64) * SCALE)


def _packed(codes) -> bytes:
    """A matrix of codes in two bytes each where they fit, in eight otherwise; the first byte tells which."""
    import numpy as np

    small = not codes.size or np.abs(codes).max() < 1 << 15
    return (b"s" if small else b"w") + codes.astype("<i2" if small else "<f8").tobytes()


def _unpacked(data: bytes, rows: int):
    import numpy as np

    flat = np.frombuffer(data, dtype="<i2" if data[:1] == b"s" else "<f8", offset=1).astype(np.float64)
    return flat.reshape(rows, -1)


def _exact_kind(x, y):
    """The type of floats in which inner products of x and y are exact whole numbers, or None."""
    import numpy as np

    most = np.abs(x).max(initial=0.0) * np.abs(y).max(initial=0.0) * max(1, x.shape[-1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else None


def _held(sums):
    """Sums of Python's whole numbers as 64-bit integers, held at their range."""
    import numpy as np

    return np.array([min(max(int(s), LEAST), MOST) for s in sums.ravel()], dtype=np.int64).reshape(sums.shape)


def products(x, y):
    """Inner products of each row of x (a, d) with the rows y (a, b, d): 64-bit integers, exact, held at their range."""
    import numpy as np

    if kind := _exact_kind(x, y):
        return (y.astype(kind, copy=False) @ x.astype(kind, copy=False)[:, :, None])[:, :, 0].astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return _held((whole(y) * whole(x)[:, None, :]).sum(axis=2))


def bounds(x, high, low):
    """(queries, blocks): the sum over terms of the larger product with a block's largest and smallest weight."""
    import numpy as np

    signs = np.concatenate([np.maximum(x, 0), np.minimum(x, 0)], axis=1)
    ends = np.concatenate([high, low], axis=1)
    if kind := _exact_kind(signs, ends):
        return (signs.astype(kind) @ ends.astype(kind).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return _held(whole(signs) @ whole(ends).T)


def search_shard(x, own, floor, docs, rows, ids, high, low, k: int):
    """(query, id, score), sorted by query, falling score and id: up to k rows of a shard for each query.

    x: queries (q, d); own: their row numbers; floor: scores below which a row can't enter. docs (blocks, BLOCK, d),
    rows and ids (blocks, BLOCK): the shard, a row number of -1 being no row. high, low (blocks, d).
    """
    import numpy as np

    best = (np.empty(0, dtype=np.int64),) * 3
    kth = floor.copy()
    sums = bounds(x, high, low)
    order = np.argsort(-sums.astype(np.float64), axis=1, kind="stable")
    # Rounded sums may order two blocks wrongly; what a query may still meet is the largest sum that is left.
    ahead = np.maximum.accumulate(np.take_along_axis(sums, order, axis=1)[:, ::-1], axis=1)[:, ::-1]
    docs = docs.astype(_exact_kind(x, docs) or docs.dtype)
    # Blocks of a step, the same for all queries; wider where few queries are left.
    at, blocks = 0, order.shape[1]
    while at < blocks:
        alive = np.flatnonzero(ahead[:, at] >= kth)
        if not len(alive):
            break
        width = min(max(1, _HELD // (len(alive) * docs.shape[1] * max(1, docs.shape[2]))), 4, blocks - at)
        hits = [best]
        share = max(1, _HELD // (width * docs.shape[1] * max(1, docs.shape[2])))
        for some in (alive[i : i + share] for i in range(0, len(alive), share)):
            chosen = order[some, at : at + width]
            scores = products(x[some], docs[chosen].reshape(len(some), -1, docs.shape[2]))
            number = rows[chosen].reshape(len(some), -1)
            open_rows = (scores >= kth[some, None]) & (number >= 0) & (number != own[some, None])
            q, place = np.nonzero(open_rows)
            hits.append((some[q], ids[chosen].reshape(len(some), -1)[q, place], scores[q, place]))
        q, found, scores = (np.concatenate(c) for c in zip(*hits, strict=True))
        turn = np.lexsort((found, -scores, q))
        q, found, scores = q[turn], found[turn], scores[turn]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        full = rank == k - 1
        kth[q[full]] = np.maximum(kth[q[full]], scores[full])
        best = (q[rank < k], found[rank < k], scores[rank < k])
        at += width
    return best


def _usable(vectors: DataFrame) -> DataFrame:
    value = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _pivots(rows: DataFrame, bound: int) -> list:
    """At most `bound` vectors, the same ones on every run."""
    some = hashed_share(rows, "vec_id", bound).orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(bound)
    return [r["embedding"] for r in some.select("embedding").collect()]


def build(vectors: DataFrame, shard: int = SHARD, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The written index: one row a block, with shard, first (row number), n, ids, codes, high and low."""
    import numpy as np

    rows = _usable(vectors)
    number = rows.count()
    centres = _pivots(rows, pivots)
    dims = max(map(len, centres), default=0)
    centres = np.array([[*c, *[0.0] * (dims - len(c))] for c in centres], dtype=np.float64).reshape(len(centres), dims)
    sizes = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = (centres / np.where(sizes > 0, sizes, 1)).astype(np.float32)

    def coded(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out, near = [], []
            for vector in batch["embedding"]:
                x = np.asarray(vector, dtype=np.float64)
                size, m = np.linalg.norm(x), min(len(x), dims)
                x32 = (x / size if 0 < size < np.inf else x * 0)[:m].astype(np.float32)
                near.append(int((centres[:, :m] @ x32).argmax()) if len(centres) else 0)
                out.append(_packed(codes_of(x)[None, :]))
            yield pd.DataFrame({"near": near, "vec_id": batch["vec_id"], "code": out})

    def blocks(batches: Iterator) -> Iterator:
        import pandas as pd

        held, shard_of, first = None, 0, 0
        for batch in batches:
            shard_of = int(batch["shard"].iloc[0]) if len(batch) else shard_of
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= block:
                yield one_block(held.iloc[:block], shard_of, first)
                held, first = held.iloc[block:], first + block
        if held is not None and len(held):
            yield one_block(held, shard_of, first)

    def one_block(part, shard_of: int, first: int):
        import pandas as pd

        codes = [_unpacked(c, 1)[0] for c in part["code"]]
        x = np.zeros((len(codes), max(map(len, codes))))
        for i, c in enumerate(codes):
            x[i, : len(c)] = c
        ends = {"high": x.max(axis=0).astype("<f8").tobytes(), "low": x.min(axis=0).astype("<f8").tobytes()}
        ids = part["vec_id"].to_numpy(dtype="<i8").tobytes()
        return pd.DataFrame([{"shard": shard_of, "first": first, "n": len(codes), "ids": ids, "codes": _packed(x), **ends}])

    keyed = map_batches(rows, coded, "near int, vec_id long, code binary", rows=4096)
    keyed = keyed.withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    ranged = keyed.repartitionByRange(max(1, -(-number // shard)), "near", "salt").sortWithinPartitions("near", "salt")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), "vec_id", "code")
    schema = "shard int, first int, n int, ids binary, codes binary, high binary, low binary"
    return materialize(map_batches(ranged, blocks, schema, rows=4096))


def queries_of(index: DataFrame, every: int) -> DataFrame:
    """The rows of an index whose id is divisible by `every`: row, query_id, home (shard), code and floor."""

    def picked(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.frombuffer(r.ids, dtype="<i8")
                at = np.flatnonzero(ids % every == 0)
                codes = _unpacked(r.codes, r.n)[at]
                numbers = (int(r.shard) << 32) + r.first + at
                yield pd.DataFrame({"row": numbers, "query_id": ids[at], "home": r.shard, "code": [_packed(c[None, :]) for c in codes], "floor": LEAST})

    return map_batches(index.select("shard", "first", "n", "ids", "codes"), picked, "row long, query_id long, home int, code binary, floor long")


_FOUND = "row long, query_id long, home int, code binary, floor long, ids array<long>, scores array<long>"


def _searched(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Search tables that name tasks: index rows and queries of one task meet, a shard and a group of queries each."""
    blank = lambda kind: F.lit(None).cast(kind)
    left = index.select("task", "shard", "first", "n", F.col("ids").alias("names"), "codes", "high", "low", blank("long").alias("row"), blank("long").alias("query_id"), blank("int").alias("home"), blank("binary").alias("code"), blank("long").alias("floor"))
    right = asked.select("task", blank("int").alias("shard"), blank("int").alias("first"), blank("int").alias("n"), blank("binary").alias("names"), blank("binary").alias("codes"), blank("binary").alias("high"), blank("binary").alias("low"), "row", "query_id", "home", "code", "floor")

    def search(group):
        import pandas as pd

        done = [one(part, k) for _, part in group.groupby("task", sort=False)]
        done = [d for d in done if d is not None]
        return pd.concat(done, ignore_index=True) if done else None

    return by_sorted_key(left.unionByName(right), "task", search, _FOUND)


def one(part, k: int):
    """The rows of one task: its queries with what they found in the shard, and the floor that follows from it."""
    import numpy as np
    import pandas as pd

    kept, asked = part[part["row"].isna()], part[part["row"].notna()]
    if not len(asked):
        return None
    stored = [_unpacked(r.codes, int(r.n)) for r in kept.itertuples(index=False)]
    codes = [_unpacked(c, 1)[0] for c in asked["code"]]
    dims = max([1, *map(len, codes), *(s.shape[1] for s in stored)])
    width = max((len(s) for s in stored), default=1)
    docs, ends = np.zeros((len(stored), width, dims)), np.zeros((2, len(stored), dims))
    rows, ids = np.full((len(stored), width), -1, dtype=np.int64), np.zeros((len(stored), width), dtype=np.int64)
    for i, (r, s) in enumerate(zip(kept.itertuples(index=False), stored, strict=True)):
        docs[i, : len(s), : s.shape[1]] = s
        ends[0, i, : s.shape[1]], ends[1, i, : s.shape[1]] = np.frombuffer(r.high, dtype="<f8"), np.frombuffer(r.low, dtype="<f8")
        rows[i, : len(s)] = (int(r.shard) << 32) + int(r.first) + np.arange(len(s))
        ids[i, : len(s)] = np.frombuffer(r.names, dtype="<i8")
    x = np.zeros((len(codes), dims))
    for i, c in enumerate(codes):
        x[i, : len(c)] = c
    floor = asked["floor"].to_numpy(dtype=np.int64)
    q, found, scores = search_shard(x, asked["row"].to_numpy(dtype=np.int64), floor, docs, rows, ids, *ends, k)
    cuts = np.searchsorted(q, np.arange(len(codes) + 1))
    lists = [(found[a:b], scores[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    reached = [max(f, int(s[-1])) if len(s) == k else f for f, (_, s) in zip(floor.tolist(), lists, strict=True)]
    out = asked[["row", "query_id", "home", "code"]].assign(floor=reached, ids=[f for f, _ in lists], scores=[s for _, s in lists])
    return out.astype({"row": "int64", "query_id": "int64", "home": "int32"})


def top_k(vectors: DataFrame, every: int, k: int = K, shard: int = SHARD, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row whose vec_id is divisible by `every`."""
    index = build(vectors, shard, block)
    asked = queries_of(index, every)
    near = materialize(_searched(index.withColumn("task", F.col("shard").cast("long")), asked.withColumn("task", F.col("home").cast("long")), k))
    size = near.agg(F.count("*").alias("n"), F.max("home").alias("last")).first()
    shards = (index.agg(F.max("shard").alias("last")).first()["last"] or 0) + 1
    groups = max(1, -(-size["n"] // group))
    mine = F.pmod(F.xxhash64("row"), F.lit(groups))
    dealt = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumn("task", F.col("group") + F.col("shard").cast("long") * groups)
    others = near.select("row", "query_id", "home", "code", "floor", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    others = others.where("shard <> home").withColumn("task", F.col("shard").cast("long") * groups + mine)
    far = _searched(dealt, others, k)
    return _merged(near.select("row", "query_id", "ids", "scores").unionByName(far.select("row", "query_id", "ids", "scores")), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    pairs: Column = F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("hit")
    flat = found.select("row", "query_id", pairs).select("row", "query_id", "hit.vec_id", "hit.score")
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best for each vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), every=20)


OP11_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS code
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_sum(list_transform(list_zip(q.code, d.code), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
