r"""Spelling variant grouping by a rare-first prefix filter on positional bigrams.

Words are maximal runs of `[A-Za-zÀ-ÿ]`, lower-cased in A-Z, of 6 code points and 5 occurrences at least.
Bigrams are ordered by the number of words that hold them, the rare ones first, then by code points and position; each
word keeps its three rarest. One inserted, deleted or replaced code point touches two bigrams at most, so of three one
is left, and near words share one of their three: at the same position if they are equally long, and at the same or the
next one in the longer word otherwise. A key is a bigram, its position and a length; words meet as owners of a key or,
one code point shorter, as guests. Keys of many words are dealt into blocks whose pairs are tasks of their own. What
meets is verified: equal beginnings and equal ends must leave one code point.

A word's form is its near word of most occurrences (ties: the first in code-point order) if that has five times its
own; forms are followed to the last by doubling the steps, of which the logarithm of the largest count bounds the number.

Edge cases: a null text has no words; a null id counts as empty text before the colon of the hashed name; rows repeat
as they are, each counts; words of any length are compared whole; a word without near words has n_near 0 and null form,
and is its own root; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import blocked_buckets, by_sorted_key, map_batches, materialize, run_pairs, table

LENGTH = 6
OFTEN = 5
RATIO = 5
#: Of the hashed names one in this many loses a code point.
MISSPELT = 199
RAREST = 3
#: Distinct words counted in a task before they are handed on.
COUNTED = 200_000
_RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{LENGTH},}}")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """Occurrences of the words of a text, of `LENGTH` code points at least; of a run that 199 chooses a code point is left out."""
    from zlib import crc32

    name = b"" if doc_id is None else str(doc_id).encode()
    found: Counter = Counter()
    for run, n in Counter(_RUNS.findall((text or "").translate(_LOWER))).items():
        h = crc32(name + b":" + run.encode())
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LENGTH:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """word and n of a table (doc_id, text), for words with n >= often."""

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        found: Counter = Counter()
        out = lambda: pd.DataFrame({"word": list(found), "n": list(found.values())})
        for batch in batches:
            ids = [None if i is None or i is pd.NA else int(i) for i in batch["doc_id"].tolist()]
            for i, text in zip(ids, batch["text"].tolist(), strict=True):
                found.update(words_of(i, text))
            if len(found) > COUNTED:
                yield out()
                found.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = map_batches(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= often)


def _rarest(words: DataFrame) -> DataFrame:
    """word, gram, place: the three rarest positional bigrams of each word."""
    at = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = F.transform(at, lambda i: F.struct(F.col("word").substr(i, F.lit(2)).alias("gram"), i.alias("place")))
    flat = words.select("word", F.explode(grams).alias("g")).select("word", "g.gram", "g.place")
    shares = flat.groupBy("gram").agg(F.count("*").alias("held"))
    # The bigrams of an alphabet of 126 letters number at most 15,876, whatever the number of words.
    shares = materialize(shares)
    ranked = flat.join(F.broadcast(shares), "gram")
    first = ranked.groupBy("word").agg(F.slice(F.sort_array(F.collect_list(F.struct("held", "gram", "place"))), 1, RAREST).alias("first"))
    return first.select("word", F.explode("first").alias("g")).select("word", "g.gram", "g.place")


def one_apart(codes, start, size, i, j):
    """Which pairs of words i, j (numbers of words in flat code points) differ by exactly one edit of one code point."""
    import numpy as np

    a, b = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    small, large = size[a], size[b]
    good = large - small <= 1

    def equal_run(first_a, first_b, step):
        run = np.zeros(len(a), dtype=np.int64)
        active, k = np.flatnonzero(good & (small > 0)), 0
        while len(active):
            same = codes[first_a[active] + step * k] == codes[first_b[active] + step * k]
            active = active[same]
            k += 1
            run[active] = k
            active = active[small[active] > k]
        return run

    ahead = equal_run(start[a], start[b], 1)
    behind = equal_run(start[a] + small - 1, start[b] + large - 1, -1)
    # Equal words have equal runs of their whole length; a replaced code point leaves one less, an added one none.
    return good & (ahead < large) & (ahead + behind >= large - 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: each pair of near words once, a before b in code-point order, possibly repeated."""
    kept = _rarest(words).withColumn("size", F.char_length("word"))
    owner = F.struct(F.col("size").alias("long"), F.col("place").alias("at"))
    guests = [F.struct((F.col("size") + 1).alias("long"), (F.col("place") + d).alias("at")) for d in (0, 1)]
    members = kept.select("word", "gram", "size", F.explode(F.array(owner, *guests)).alias("k")).select("word", "size", "gram", "k.long", "k.at")
    dealt = blocked_buckets(members, ["gram", "long", "at"], "word")

    def compare(rows):
        import numpy as np
        import pandas as pd

        # Tasks are named by a hash; what only shares the name is not near, or is so truly. Owners come first in a
        # task, so that pairs of guests, which another key brings together, are never met.
        rows = rows.assign(guest=rows["size"] != rows["long"]).sort_values(["task", "guest"], kind="stable")
        number, names = pd.factorize(rows["word"].to_numpy(dtype=object))
        size = np.array([len(w) for w in names], dtype=np.int64)
        start = np.cumsum(size) - size
        codes = np.frombuffer("".join(names).encode("utf-32-le", errors="surrogatepass"), dtype="<u4")
        # One edit adds and takes one letter at most: which letters (modulo 64) a word holds differs in two bits at most.
        held = np.bitwise_or.reduceat(np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)), start)[number]
        a, b = [], []
        owners = np.flatnonzero(~rows["guest"].to_numpy())
        for i, j in run_pairs(*(rows[c].to_numpy() for c in ("task", "mine", "other")), heads=owners):
            alike = np.bitwise_count(held[i] ^ held[j]) <= 2
            i, j = number[i[alike]], number[j[alike]]
            near = one_apart(codes, start, size, i, j)
            a.append(i[near])
            b.append(j[near])
        if not a or not sum(map(len, a)):
            return None
        pairs = np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1)
        pairs = np.unique(pairs, axis=0)
        return pd.DataFrame({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    found = by_sorted_key(dealt, "task", compare, "a string, b string")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def variants(docs: DataFrame, often: int = OFTEN, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of a table (doc_id, text)."""
    words = materialize(word_counts(docs, often))
    pairs = materialize(near_pairs(words).distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = named.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("form"))).alias("best"))
    best = words.join(best, "word", "left")
    holds = F.coalesce(-F.col("best.m") >= F.lit(ratio).cast("decimal(20,0)") * F.col("n"), F.lit(False))
    best = materialize(
        best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n"))
    )
    roots = _roots(best.where("form is not null").select("word", F.col("form").alias("root")))
    return best.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """word, root: where the steps word -> root end. Steps lead to greater counts only, so they end."""
    now = materialize(steps)
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = materialize(now.join(far, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents with their forms and roots."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
