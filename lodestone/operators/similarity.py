"""Vector search: exact top-k of query sets, inverted lists, similar pairs, centroids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vector as vx
from lodestone.operators.lexical import top_k
from lodestone.sources.tables import folder_for

#: Most bytes of query vectors that go to every task in one piece; larger sets are dealt into blocks.
QUERY_BYTES = 16 << 20
#: Queries that are scored at once against a batch of a list.
SCANNED = 512
#: What a component of one is in a code of signed bytes.
CODE_SCALE = 127.0
#: Bytes of the vectors of one block, of queries or of what is searched.
BLOCK_BYTES = 32 << 20


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 48, key: str = "chunk_id", vec: str = "vec", scopes: str | None = None) -> DataFrame:
    """query_id, key, score, rank of the k nearest by dot product (cosine on unit vectors), exact.

    Query vectors (query_id, vec) of a checked size go to the tasks, and every batch of vectors is one matrix
    product from which only each query's k best leave. A larger set never comes to the driver: queries and vectors are
    dealt into blocks, each pair of blocks a task. A window keeps k overall. Null vectors and vectors of another
    length are not searched. With `scopes`, a column of the scopes each vector is in, queries have a scope_id, and one that is not null
    meets only the vectors in it.
    """
    scope = F.col("scope_id") if scopes else F.lit(None)
    inside = F.col(scopes) if scopes else F.lit(None)
    asked = queries.select("query_id", F.col(vec if vec in queries.columns else "vec").cast("array<double>").alias("vec"), scope.cast("long").alias("scope")).where("vec is not null")
    held = vectors.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec"), inside.cast("array<long>").alias("scopes")).where("vec is not null")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dims")).first()
    if size["n"] * size["dims"] * 8 <= QUERY_BYTES:
        rows = [(r["query_id"], r["vec"], r["scope"]) for r in asked.collect()]
        if not rows:
            return vectors.sparkSession.createDataFrame([], f"query_id long, `{key}` long, score double, rank int")
        found = held.mapInPandas(_sent(rows, k), "query_id long, key long, score double")
    else:
        found = _blocked(held, asked, k, size["dims"], size["n"])
    return top_k(found, k, "key").withColumnRenamed("key", key)


def _best(ids, matrix, scopes, keys, x, inside, k: int):
    """Scores of the k best of a batch for every query; ties at the cut are all kept, a window after this decides by key."""
    import numpy as np
    import pandas as pd

    scores = matrix @ x.T
    for scope in {s for s in scopes if s is not None}:
        out = np.array([i is None or scope not in i for i in inside])
        scores[np.ix_([s == scope for s in scopes], out)] = -np.inf
    floor = np.partition(scores, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(ids), -np.inf)
    q, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    return pd.DataFrame({"query_id": ids[q], "key": keys[c], "score": np.round(scores[q, c], 9)})


def _sent(rows: list, k: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        sizes: dict[int, list] = {}
        for row in rows:
            sizes.setdefault(len(row[1]), []).append(row)
        sets = {n: (np.array([i for i, _, _ in part]), np.array([v for _, v, _ in part], dtype=np.float64), [None if s is None or s != s else int(s) for _, _, s in part]) for n, part in sizes.items()}
        for batch in batches:
            lengths = batch["vec"].map(len)
            for n, (ids, matrix, scopes) in sets.items():
                part = batch[lengths == n]
                if len(part):
                    yield _best(ids, matrix, scopes, part["key"].to_numpy(), np.stack(part["vec"].to_numpy()), part["scopes"], k)

    return run


def _blocked(held: DataFrame, asked: DataFrame, k: int, dims: int, n_asked: int) -> DataFrame:
    each = max(1, BLOCK_BYTES // (8 * dims))
    of_queries, of_vectors = -(-n_asked // each), max(1, -(-held.count() // each))
    deal = lambda c, n: F.pmod(F.xxhash64(F.lit("block"), F.col(c)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("v", deal("key", of_vectors)).withColumn("q", all_of(of_queries))
    right = asked.withColumn("q", deal("query_id", of_queries)).withColumn("v", all_of(of_vectors))

    def run(here, there):
        import pandas as pd

        if not len(here) or not len(there):
            return pd.DataFrame({"query_id": [], "key": [], "score": []}).astype({"query_id": "int64", "key": "int64", "score": "float64"})
        rows = list(zip(there["query_id"].tolist(), there["vec"], there["scope"].astype(object), strict=True))
        return pd.concat(list(_sent(rows, k)([here])) or [pd.DataFrame({"query_id": [], "key": [], "score": []})])

    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(run, "query_id long, key long, score double")


#: Groups at least into which the blocks of a join are put; more where a group would pass `BLOCK_BYTES`.
GROUPS = 24
#: Vectors at most that order the others for a join, and blocks whose summaries are compared in one task.
PIVOTS, SUMMARIES = 256, 2048


def ordered_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (id, grp, v) with the number b of a block of about `block` rows that are near the same pivot; written."""
    spark = rows.sparkSession
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, 2 * PIVOTS / max(1, n))))).orderBy(F.xxhash64("id")).limit(PIVOTS)
    pivots = _tour([r["v"] for r in some.select("v").collect()] or [[0.0]])

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        import numpy as np

        c = _padded(pivots)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        x = _padded(vectors.tolist(), c.shape[1])
        return pd.Series((x[:, : c.shape[1]] @ c.T).argmax(axis=1).astype("int32"))

    path = f"{folder_for(spark, 'blocks')}/rows"
    ranged = rows.withColumn("near", nearest("v")).repartitionByRange(max(1, -(-n // block)), "near", F.xxhash64("id"))
    ranged.select("id", "grp", "v", F.spark_partition_id().alias("b")).write.parquet(path)
    return spark.read.parquet(path)


def _tour(pivots: list) -> list:
    """Pivots in an order in which each is followed by the nearest that is left, so that neighbours in number are near."""
    import numpy as np

    c = _padded(pivots)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    alike, order = c @ c.T, [0]
    alike[:, 0] = -np.inf
    while len(order) < len(pivots):
        order.append(int(alike[order[-1]].argmax()))
        alike[:, order[-1]] = -np.inf
    return [pivots[i] for i in order]


def _padded(vectors: list, least: int = 0):
    """A matrix of vectors; shorter ones end in zeros."""
    import numpy as np

    out = np.zeros((len(vectors), max([least, *map(len, vectors)])))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def block_pairs(held: DataFrame, threshold: float) -> DataFrame:
    """x <= y: the blocks of which some rows may have a dot product of the threshold.

    A block is summed up by its mean direction, the widest angle of a row to it and the longest row. No two rows are
    nearer in angle than the directions are without both widths, so other pairs of blocks are never brought together.
    """

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = _padded(rows["v"].tolist())
        norm = np.linalg.norm(x, axis=1)
        unit = x / np.maximum(norm, 1e-12)[:, None]
        centre = unit.sum(axis=0)
        centre /= max(np.linalg.norm(centre), 1e-12)
        # A row without a direction has products of zero, which no positive threshold lets through; others bring all blocks together.
        wide = np.where(norm > 0, np.arccos(np.clip(unit @ centre, -1, 1)), 0).max()
        return pd.DataFrame([{"b": rows["b"].iloc[0], "centre": centre, "wide": wide, "most": norm.max()}])

    sums = held.groupBy("b").applyInPandas(summary, "b int, centre array<double>, wide double, most double")
    path = f"{folder_for(held.sparkSession, 'blocks')}/sums"
    sums.write.parquet(path)
    sums = held.sparkSession.read.parquet(path)
    chunks = (sums.agg(F.max("b")).first()[0] or 0) // SUMMARIES + 1
    dealt = sums.withColumn("mine", F.floor(F.col("b") / SUMMARIES).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(int(chunks) - 1))))
    dealt = dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left, right = rows[rows["mine"] == rows["lo"].iloc[0]].drop_duplicates("b"), rows[rows["mine"] == rows["hi"].iloc[0]].drop_duplicates("b")
        size = max(map(len, rows["centre"]))
        angle = np.arccos(np.clip(_padded(left["centre"].tolist(), size) @ _padded(right["centre"].tolist(), size).T, -1, 1))
        gap = np.clip(angle - left["wide"].to_numpy()[:, None] - right["wide"].to_numpy()[None, :], 0, np.pi)
        most = left["most"].to_numpy()[:, None] * right["most"].to_numpy()[None, :] * np.where(np.cos(gap) > 0, np.cos(gap), 0 if threshold > 0 else 1)
        i, j = np.nonzero(most >= threshold - 1e-9) if threshold > 0 else np.nonzero(np.ones_like(most))
        x, y = left["b"].to_numpy()[i], right["b"].to_numpy()[j]
        return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)}).drop_duplicates()

    path = f"{folder_for(held.sparkSession, 'blocks')}/pairs"
    dealt.groupBy("lo", "hi").applyInPandas(meet, "x int, y int").write.parquet(path)
    return held.sparkSession.read.parquet(path)


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "chunk_id", group: str = "doc_id", vec: str = "vec", block: int = 512, index: InvertedLists | None = None, probes: int = 8) -> DataFrame:
    """a, b, score: pairs a < b of different groups with dot product of at least the threshold.

    Exact without an `index`: vectors are put in order by pivots and cut into blocks, and only blocks that may hold a
    pair (see `block_pairs`) are multiplied, those of two groups of blocks in one task, whose products are filtered before they leave. Vectors in clusters leave most
    blocks apart; where they fill all directions, and at low thresholds, block pairs grow with the square of the table. With
    inverted lists over the same vectors each vector meets those of its nearest `probes` lists only, which misses some pairs.
    """
    if index is not None:
        return index.pairs(vectors.select(F.col(key).alias("key"), F.col(group).alias("grp")), threshold, probes)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(group).alias("grp"), vx.as_double(F.col(vec)).alias("v")).where("v is not null")
    held = ordered_blocks(rows, block)
    pairs = block_pairs(held, threshold)
    # Neighbouring blocks travel together, a group of them as often as there are groups; within a pair of groups only block pairs meet.
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dims"), F.coalesce(F.max("b"), F.lit(0)).alias("last")).first()
    groups = max(GROUPS, -(-size["n"] * size["dims"] * 8 // BLOCK_BYTES))
    span = max(1, -(-(size["last"] + 1) // groups))
    of = lambda c: F.floor(F.col(c) / span).cast("int")
    told = pairs.withColumns({"gx": of("x"), "gy": of("y")}).groupBy("gx", "gy").agg(F.collect_list(F.struct("x", "y")).alias("met"))
    path = f"{folder_for(held.sparkSession, 'blocks')}/groups"
    told.write.parquet(path)
    told, listed = held.sparkSession.read.parquet(path), held.sparkSession.read.parquet(path)
    of_block = F.explode(F.array_distinct(F.concat(F.transform("met", lambda p: p["x"]), F.transform("met", lambda p: p["y"]))))
    sides = told.select("gx", "gy", of_block.alias("b"))

    def compare(found: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        none = pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64", "score": "float64"})
        size, out = max(map(len, found["v"]), default=0), [none]
        parts = {b: (rows["id"].to_numpy(), rows["grp"].to_numpy(), _padded(rows["v"].tolist(), size)) for b, rows in found.groupby("b")}
        for met in listed["met"]:
            for x, y in ((p["x"], p["y"]) for p in met):
                (left, own, u), (right, other, w) = parts[x], parts[y]
                scores = u @ w.T
                i, j = np.nonzero(scores >= threshold)
                a, b = left[i], right[j]
                good = (own[i] != other[j]) & ((a < b) | (x != y))
                out.append(pd.DataFrame({"a": np.minimum(a, b)[good], "b": np.maximum(a, b)[good], "score": np.round(scores[i, j][good], 9)}))
        return pd.concat(out)

    brought = held.join(sides, "b").groupBy("gx", "gy").cogroup(listed.groupBy("gx", "gy"))
    return brought.applyInPandas(compare, "a long, b long, score double")


def related(vectors: DataFrame, centroids: DataFrame, k: int, linked: DataFrame | None = None, bonus: float = 0.05, index: InvertedLists | None = None, probes: int = 32, wide: int | None = None) -> DataFrame:
    """query_id, doc_id, score: documents by their best chunk against each document's centroid, plus a bonus if linked.

    Candidates are the max(48, 6k) nearest chunks of a centroid (`wide` of them where given), from inverted lists if an `index` is given.
    """
    asked = centroids.select(F.col("doc_id").alias("query_id"), vx.normalized(F.col("centroid")).alias("vec"))
    wide = wide or max(48, 6 * k)
    found = vector_topk(vectors, asked, wide) if index is None else index.search(asked, wide, probes)
    best = found.join(vectors.select("chunk_id", "doc_id"), "chunk_id").where("doc_id <> query_id")
    best = best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    if linked is not None:
        ends = linked.select("src", "dst").unionByName(linked.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        best = best.join(ends.select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id"), F.lit(bonus).alias("bonus")), ["query_id", "doc_id"], "left")
        best = best.withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    return top_k(best, k, "doc_id")


def _scanned(rows: list, k: int, digits: int = 9):
    """The k best of each query (query_id, q, lists) among batches of list rows (key, list, v, code), exact in its lists.

    A product with a code is off by no more than the length of what the code leaves of its vector, times the query's. Rows
    whose product may reach the k-th best by that are scored by their vectors, however many there are.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        sizes: dict[int, list] = {}
        for row in rows:
            sizes.setdefault(len(row[1]), []).append(row)
        sets, slack = {}, 2 * 10.0**-digits
        for n, part in sizes.items():
            of: dict[int, list] = {}
            for i, (_, _, lists) in enumerate(part):
                for x in lists:
                    of.setdefault(int(x), []).append(i)
            sets[n] = np.array([i for i, _, _ in part], dtype=np.int64), np.array([q for _, q, _ in part], dtype=np.float64), {x: np.array(y) for x, y in of.items()}
        kept = {n: [] for n in sets}
        floors = {n: np.full(len(matrix), -np.inf) for n, (_, matrix, _) in sets.items()}

        def best(found: pd.DataFrame, floor: np.ndarray) -> pd.DataFrame:
            # As in Spark's order, NaN is the largest.
            turn = np.lexsort((found["key"], -found["score"].fillna(np.inf), found["query"]))
            found = found.iloc[turn]
            nth = found.groupby("query").cumcount().to_numpy()
            last = found[nth == k - 1]
            floor[last["query"]] = last["score"].fillna(np.inf)
            return found[nth < k]

        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            for n, (_, matrix, of) in sets.items():
                for x, part in batch[lengths == n].groupby("list"):
                    asked = of.get(int(x), np.empty(0, dtype=np.int64))
                    if not len(asked):
                        continue
                    keys, codes, v = part["key"].to_numpy(), np.stack(part["code"].to_numpy()) / CODE_SCALE, np.stack(part["v"].to_numpy())
                    off = np.linalg.norm(v - codes, axis=1)
                    for at in range(0, len(asked), SCANNED):
                        some = asked[at : at + SCANNED]
                        rough, wide = matrix[some] @ codes.T, np.linalg.norm(matrix[some], axis=1)[:, None] * off
                        least = np.nan_to_num(rough - wide, nan=-np.inf)
                        floor = np.partition(least, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(some), -np.inf)
                        # Not "at or above", so that NaN stays.
                        i, j = np.nonzero(~(rough + wide < np.maximum(floor, floors[n][some])[:, None] - slack))
                        step = max(1, BLOCK_BYTES // (8 * max(1, n)))
                        for cut in range(0, len(i), step):
                            q, r = some[i[cut : cut + step]], j[cut : cut + step]
                            score = np.round(np.einsum("ij,ij->i", matrix[q], v[r]), digits)
                            kept[n].append(pd.DataFrame({"query": q, "key": keys[r], "score": score}))
                            if sum(map(len, kept[n])) > 4 * k * len(matrix):
                                kept[n] = [best(pd.concat(kept[n]), floors[n])]
        out = [best(pd.concat(x), floors[n]).assign(query_id=lambda f, ids=sets[n][0]: ids[f["query"]]) for n, x in kept.items() if x]
        none = pd.DataFrame({"query_id": [], "key": [], "score": []}).astype({"query_id": "int64", "key": "int64"})
        yield pd.concat([none, *out])[["query_id", "key", "score"]].astype({"query_id": "int64", "key": "int64"})

    return run


class InvertedLists:
    """Approximate search over stored inverted lists: spherical k-means lists, signed-byte codes, exact rescoring.

    The table of rows (key, code, vector) is partitioned by list, so a search reads the lists it probes and no others;
    the centres lie beside it with a fingerprint of the vectors. `of` opens what is stored as long as the fingerprint is that of
    the vectors, and builds anew when it is not.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = 25_600, seed: int = 1337, key: str = "chunk_id", vec: str = "vec", folder: str | None = None):
        spark = vectors.sparkSession
        self.folder = folder or folder_for(spark, "lists")
        held = vectors.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("key"), vx.normalized(vx.as_double(F.col(vec))).alias("v"))
        told = self.fingerprint(vectors, key, vec)
        n = told["n"]
        count = max(1, min(lists or int(min(4096, max(64, 4 * n**0.5))), n))
        fitted = held.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n)))).select(array_to_vector("v").alias("features"))
        model = KMeans(k=count, seed=seed, maxIter=8, distanceMeasure="cosine").fit(fitted)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        # A new folder each time: who reads the old lists is not disturbed.
        self.place = f"{self.folder}/lists-{uuid.uuid4().hex}"
        assigned = model.transform(held.withColumn("features", array_to_vector("v"))).withColumnRenamed("prediction", "list")
        assigned = assigned.select("key", "list", "v", vx.quantized(F.col("v"), CODE_SCALE).alias("code")).hint("rebalance", "list")
        assigned.write.mode("overwrite").partitionBy("list").parquet(f"{self.place}/rows")
        spark.createDataFrame(centres, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.place}/centres")
        note = spark.createDataFrame([(self.place, key, told["n"], told["last"], told["mark"])], "place string, key string, n long, last long, mark string")
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/note")
        self._open(spark, key)

    def _open(self, spark, key: str) -> None:
        self.rows, self.key = spark.read.parquet(f"{self.place}/rows"), key
        # At most 4,096 centres.
        self.centres = [r["centre"] for r in spark.read.parquet(f"{self.place}/centres").orderBy("list").collect()]
        self.lists = len(self.centres)

    @staticmethod
    def fingerprint(vectors: DataFrame, key: str = "chunk_id", vec: str = "vec") -> dict:
        """n, last (largest key) and mark (a sum of hashes) of the vectors; another vector, key or length is another mark."""
        held = vectors.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("v"))
        row = held.agg(F.count("*").alias("n"), F.max("key").alias("last"), F.sum(F.xxhash64("key", "v").cast("decimal(38,0)")).cast("string").alias("mark")).first()
        return row.asDict()

    @classmethod
    def of(cls, vectors: DataFrame, folder: str, key: str = "chunk_id", vec: str = "vec", **more) -> InvertedLists:
        """The lists stored in a folder if they are of these vectors, else new ones stored there."""
        spark = vectors.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/note/_SUCCESS")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            note = spark.read.parquet(f"{folder}/note").first()
            told = cls.fingerprint(vectors, key, vec)
            if note is not None and (note["key"], note["n"], note["last"], note["mark"]) == (key, told["n"], told["last"], told["mark"]):
                found = cls.__new__(cls)
                found.folder, found.place = folder, note["place"]
                found._open(spark, key)
                return found
        return cls(vectors, key=key, vec=vec, folder=folder, **more)

    def _nearest(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, list, q: the lists to search for every query; only the centres go to the tasks."""
        centers = self.centres

        @F.pandas_udf("array<int>")
        def places(vectors: pd.Series) -> pd.Series:
            import numpy as np

            c = np.array(centers)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            scores = np.stack(vectors.to_numpy()) @ c.T
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype("int32")))

        asked = queries.select("query_id", vx.normalized(vx.as_double(F.col("vec"))).alias("q")).where("q is not null")
        return asked.withColumn("list", F.explode(places("q")))

    def probed(self, queries: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """The lists to search for every query, and the stored rows of just these lists: other partitions are not read."""
        near = self._nearest(queries, min(probes, self.lists))
        wanted = [r["list"] for r in near.select("list").distinct().collect()]
        return near, self.rows.where(F.col("list").isin(wanted))

    def search(self, queries: DataFrame, k: int, probes: int = 256, digits: int = 9) -> DataFrame:
        """query_id, key, score, rank: the k nearest in the lists probed; byte codes leave out what can't be among them, doubles decide.

        Queries of a checked size go to the tasks, and each keeps the k best of what it has read so far, so as many rows
        a query leave it. A larger set is dealt into blocks that meet those of the lists. Scores have so many digits.
        """
        near, rows = self.probed(queries, probes)
        asked = near.groupBy("query_id", "q").agg(F.collect_list("list").alias("lists"))
        size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims")).first()
        held = rows.select("key", F.col("list").cast("int").alias("list"), "v", F.col("code").cast("array<double>").alias("code"))
        schema = "query_id long, key long, score double"
        if size["n"] * size["dims"] * 8 <= QUERY_BYTES:
            sent = [tuple(r) for r in asked.select("query_id", "q", "lists").collect()]
            found = held.mapInPandas(_scanned(sent, k, digits), schema)
        else:
            each = max(1, BLOCK_BYTES // (8 * size["dims"]))
            of_queries, of_rows = -(-size["n"] // each), max(1, -(-held.count() // each))
            deal = lambda c, n: F.pmod(F.xxhash64(F.lit("block"), F.col(c)), F.lit(n)).cast("int")
            all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            left = held.withColumn("r", deal("key", of_rows)).withColumn("b", all_of(of_queries))
            right = asked.withColumn("b", deal("query_id", of_queries)).withColumn("r", all_of(of_rows))

            def run(here, there):
                rows = list(zip(there["query_id"].tolist(), there["q"], there["lists"], strict=True))
                return pd.concat(list(_scanned(rows, k, digits)([here])))

            found = left.groupBy("r", "b").cogroup(right.groupBy("r", "b")).applyInPandas(run, schema)
        return top_k(found, k, "key").withColumnRenamed("key", self.key)

    def pairs(self, groups: DataFrame, threshold: float, probes: int) -> DataFrame:
        """a, b, score: pairs of different groups (key, grp) at the threshold or above, met in a list near either of them."""
        rows = self.rows.join(groups, "key")
        asked = self._nearest(rows.select(F.col("key").alias("query_id"), F.col("v").alias("vec")), min(probes, self.lists)).join(groups.withColumnsRenamed({"key": "query_id", "grp": "own"}), "query_id")
        met = rows.join(asked, "list").where("key <> query_id and grp <> own").withColumn("score", F.round(vx.dot(F.col("q"), F.col("v")), 9)).where(F.col("score") >= threshold)
        return met.groupBy(F.least("key", "query_id").alias("a"), F.greatest("key", "query_id").alias("b")).agg(F.max("score").alias("score"))


def path_smoothness(ordered: DataFrame) -> DataFrame:
    """query_id, smoothness: mean cosine of successive hits (query_id, position, vec)."""
    w = Window.partitionBy("query_id").orderBy("position")
    pairs = ordered.withColumn("before", F.lag("vec").over(w)).where("before is not null")
    return pairs.groupBy("query_id").agg(F.avg(vx.dot(vx.normalized(F.col("before")), vx.normalized(F.col("vec")))).alias("smoothness"))
