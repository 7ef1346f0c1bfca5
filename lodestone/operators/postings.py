"""Positional postings dealt by document, and the ranking that runs where they lie.

Chunks belong to shards of at most `SHARD` chunks. A posting row holds, for one term and one shard, the chunks with the
term, its weighted frequency and places in each, and the chunks' lengths, each as the bytes of an array: nothing outside the
tasks that count and rank looks at their elements. A batch of queries visits every shard once:
the rows of its terms meet the queries there, all scores are sums over arrays, and only the k best of a shard leave it.
Postings of a common term are therefore spread over as many tasks as there are shards, and nothing is repeated a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import tokens as tk

K1, B = 1.2, 0.75
#: Decimals to which scores are rounded before ranking, so that summation order cannot decide a tie.
DIGITS = 9
SHARD = 4096
#: Chunks that one step of indexing holds, and bytes of their texts.
STEP, STEP_BYTES = 4096, 64 << 20
#: Queries that visit a shard at once.
SLICE = 2000
#: Places are numbered from here on in each further field, so that no phrase crosses fields.
_FIELD = 1 << 40
#: What the bytes of a posting row hold.
KINDS = {"ids": "<i8", "len": "<f8", "counts": "<i4", "places": "<i8"}
JOINT = "\x01"
#: df and n (weighted occurrences) are those of the row; arrays are of 64 bits, counts of 32.
SCHEMA = "term string, shard long, df long, n double, ids binary, tf binary, len binary, counts binary, places binary"


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with their shard; the number of a row is that of the partition it is written from."""
    rows = chunks.withColumn("_row", F.monotonically_increasing_id())
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("shard", (part * (1 << 20) + F.floor(place / SHARD)).cast("long")).drop("_row")


def inverted(chunks: DataFrame, fields: dict[str, float], stems: bool, keep: str = "ids") -> DataFrame:
    """The postings of chunks (chunk_id, shard, and the fields); one Arrow pass, no shuffle.

    With keep = "sums" only term, df and n (weighted occurrences) of each step.
    """
    import pyarrow as pa

    names = list(fields)

    def invert(batch: pd.DataFrame) -> pa.RecordBatch | None:
        code, sizes, distinct = tk.coded((v for values in batch[names].itertuples(index=False, name=None) for v in values), stems)
        if not len(code):
            return None
        # Fields follow each other in a chunk, and places start anew in each.
        field = np.repeat(np.tile(np.arange(len(names)), len(batch)), sizes)
        row = np.repeat(np.repeat(np.arange(len(batch)), len(names)), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + field * _FIELD
        weight = np.array(list(fields.values()), dtype=float)[field]
        length = np.bincount(row, weights=weight, minlength=len(batch))
        shard, shards = pd.factorize(batch["shard"].to_numpy())
        key = (code * len(shards) + shard[row]) * len(batch) + row
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        chunk, list_key = row[order][first], key[first] // len(batch)
        head = np.flatnonzero(np.append(True, list_key[1:] != list_key[:-1]))
        tf = np.add.reduceat(weight[order], first)
        # Offsets of lists: of chunks in a posting row, and of places in it.
        cuts, spots = np.append(head, len(first)), np.append(first[head], len(key))
        columns = {"term": pa.array(distinct[list_key[head] // len(shards)], pa.string()), "shard": pa.array(shards[list_key[head] % len(shards)], pa.int64())}
        columns |= {"df": pa.array(np.diff(cuts), pa.int64()), "n": pa.array(np.add.reduceat(tf, head))}
        if keep == "ids":
            counts = np.diff(np.append(first, len(key))).astype(np.int32)
            lists = {"ids": batch["chunk_id"].to_numpy(np.int64)[chunk], "tf": tf, "len": length[chunk], "counts": counts}
            columns |= {c: _bytes(v, cuts) for c, v in lists.items()} | {"places": _bytes(place[order], spots)}
        else:
            del columns["shard"]
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            step = max(1, min(STEP, int(batch.num_rows * STEP_BYTES / max(batch.nbytes, 1))))
            for at in range(0, batch.num_rows, step):
                out = invert(batch.slice(at, step).to_pandas())
                if out is not None:
                    yield out

    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "shard", *(F.col(f).cast("string").alias(f) for f in names))
    return rows.mapInArrow(run, SCHEMA if keep == "ids" else "term string, df long, n double")


def _bytes(values: np.ndarray, offsets: np.ndarray):
    """Slices of an array, from one offset to the next, as bytes."""
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    ends = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)])


def bucket(buckets: int, term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def terms_of(queries: DataFrame, stems: bool, leg: str | None = None, whole: bool = True) -> DataFrame:
    """query_id, leg, term, gram, size (tokens of the phrase) of queries (query_id, text): a phrase is one term, joined."""
    found = tk.query_terms(F.col("text"), stems, whole)
    rows = queries.select("query_id", (F.col(leg) if leg else F.lit(0)).cast("int").alias("leg"), F.explode(found).alias("t"))
    return rows.select("query_id", "leg", F.array_join("t.tokens", JOINT).alias("term"), "t.gram", F.size("t.tokens").alias("size"))


def phrase_postings(postings: DataFrame, phrases: DataFrame, shards: list[int], weights: list[float]) -> DataFrame:
    """Postings of phrases (distinct joined terms) as rows of their own, with `chunks`: where their tokens stand side by side."""
    asked = phrases.select(F.col("term").alias("phrase"))
    tokens = asked.select(F.explode(F.split("phrase", JOINT)).alias("term")).distinct()
    held = postings.join(F.broadcast(tokens), "term", "left_semi").select("term", "shard", "ids", "len", "counts", "places")
    spread = asked.withColumn("shard", F.explode(F.array(*(F.lit(s).cast("long") for s in shards))))

    def find(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.assign(**{c: [np.frombuffer(x, kind) for x in rows[c]] for c, kind in KINDS.items()})
        by_term: dict[str, list] = {}
        for r in rows.itertuples(index=False):
            by_term.setdefault(r.term, []).append(r)
        names = np.unique(np.concatenate([r.ids for r in rows.itertuples(index=False)])) if len(rows) else np.empty(0, dtype=np.int64)
        for phrase in wanted["phrase"] if len(wanted) else ():
            tokens, spots = phrase.split(JOINT), None
            for j, token in enumerate(tokens):
                # Chunk and place in one number, moved back by the token's place in the phrase.
                own = [np.repeat(np.searchsorted(names, r.ids), r.counts) * (1 << 44) + r.places - j for r in by_term.get(token, ())]
                own = np.concatenate(own) if own else np.empty(0, dtype=np.int64)
                spots = own if spots is None else np.intersect1d(spots, own)
            if not len(spots):
                continue
            chunk, field = spots >> 44, (spots & ((1 << 44) - 1)) // _FIELD
            tf = np.bincount(chunk, weights=np.array(weights)[field], minlength=len(names))
            at = np.unique(chunk)
            length = {}
            for r in by_term[tokens[0]]:
                length |= dict(zip(r.ids.tolist(), r.len.tolist(), strict=True))
            ids = names[at]
            lens = np.array([length[i] for i in ids.tolist()])
            out.append((phrase, int(wanted["shard"].iloc[0]), ids.tobytes(), tf[at].tobytes(), lens.tobytes(), ids))
        return pd.DataFrame(out, columns=["term", "shard", "ids", "tf", "len", "chunks"])

    schema = "term string, shard long, ids binary, tf binary, len binary, chunks array<long>"
    return held.groupBy("shard").cogroup(spread.groupBy("shard")).applyInPandas(find, schema)


def ranked(postings: DataFrame, asked: DataFrame, side: DataFrame, shards: list[int], k: int, mean_len: float, both: bool, slices: int) -> DataFrame:
    """query_id, leg, chunk_id, score, rank: the k best chunks by BM25.

    postings: rows of the asked terms. asked: query_id, leg, term, gram, idf, scope (null: everything). side: scope and ids
    of the chunks in a scope, and of the dead with a null scope, by shard. With `both` a query of two words and more
    takes the chunks with all of them, scored by its words alone, where k chunks have them all.
    """
    part = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")
    of_shards = F.explode(F.array(*(F.lit(s).cast("long") for s in shards)))
    all_slices = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    held = postings.select("term", "shard", "ids", "tf", "len").withColumn("slice", all_slices)
    none = lambda kind: F.lit(None).cast(kind)
    wanted = asked.select(of_shards.alias("shard"), part.alias("slice"), "query_id", "leg", "term", "gram", "idf", "scope", none("array<long>").alias("ids"))
    beside = side.select("shard", all_slices.alias("slice"), none("long").alias("query_id"), none("int").alias("leg"), none("string").alias("term"), none("boolean").alias("gram"), none("double").alias("idf"), "scope", "ids")

    def score(rows: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = _score_shard(rows, right, k, mean_len, both)
        return pd.DataFrame(out, columns=["query_id", "leg", "whole", "chunk_id", "score", "full"])

    schema = "query_id long, leg int, whole boolean, chunk_id long, score double, full long"
    found = held.groupBy("shard", "slice").cogroup(wanted.unionByName(beside).groupBy("shard", "slice")).applyInPandas(score, schema)
    of = Window.partitionBy("query_id", "leg")
    found = found.withColumn("all_n", F.sum("full").over(of)).where(F.col("whole") == (F.col("all_n") >= k))
    order = of.orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", "leg", "chunk_id", "score", "rank")


def _score_shard(rows: pd.DataFrame, right: pd.DataFrame, k: int, mean_len: float, both: bool) -> list[tuple]:
    """(query_id, leg, whole, chunk_id, score, full) of the k best chunks of one shard, by any word and by all words."""
    asked = right[right["query_id"].notna()] if len(right) else right
    if not len(rows) or not len(asked):
        return []
    names = np.unique(np.frombuffer(b"".join(rows["ids"]), "<i8"))
    alive, scopes = np.ones(len(names), dtype=bool), {}
    for scope, ids in right.loc[right["query_id"].isna(), ["scope", "ids"]].itertuples(index=False, name=None):
        inside = np.isin(names, ids)
        if pd.isna(scope):
            alive &= ~inside
        else:
            scopes[int(scope)] = scopes.get(int(scope), False) | inside
    by_term: dict[str, list] = {}
    for r in rows.itertuples(index=False):
        ids, tf, length = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.tf, "<f8"), np.frombuffer(r.len, "<f8")
        long = K1 * (1 - B + B * length / mean_len)
        by_term.setdefault(r.term, []).append((np.searchsorted(names, ids), tf * (K1 + 1) / (tf + long)))
    out: list[tuple] = []

    def best(places, scores):
        scores = np.round(scores[places], DIGITS)
        if len(places) > k:
            floor = np.partition(scores, -k)[-k]
            places, scores = places[scores >= floor], scores[scores >= floor]
        turn = np.lexsort((names[places], -scores))[:k]
        return names[places[turn]].tolist(), scores[turn].tolist()

    asked = asked.sort_values(["query_id", "leg", "term"])
    keys = asked[["query_id", "leg"]].to_numpy()
    cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    columns = [asked[c].to_numpy(dtype=object) for c in ("term", "gram", "idf", "scope")]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(asked)], strict=True):
        query, leg = keys[a].tolist()
        own = list(zip(*(c[a:b] for c in columns), strict=True))
        total, words = np.zeros(len(names)), np.zeros(len(names))
        met, hit = np.zeros(len(names), dtype=np.int32), np.zeros(len(names), dtype=bool)
        wanted = sum(not gram for _, gram, _, _ in own)
        for term, gram, idf, _ in own:
            for at, part in by_term.get(term, ()):
                share = (0.0 if pd.isna(idf) else idf) * part
                total[at] += share
                hit[at] = True
                if not gram:
                    words[at] += share
                    met[at] += 1
        scope = own[0][3]
        hit &= alive if pd.isna(scope) else alive & scopes.get(int(scope), False)
        if both and wanted >= 2:
            whole = np.flatnonzero(hit & (met == wanted))
            for i, (chunk, s) in enumerate(zip(*best(whole, words), strict=True)):
                out.append((query, leg, True, chunk, s, 0 if i else len(whole)))
        out += [(query, leg, False, chunk, s, 0) for chunk, s in zip(*best(np.flatnonzero(hit), total), strict=True)]
    return out
