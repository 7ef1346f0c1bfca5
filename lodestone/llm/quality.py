"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every distinct word is hashed to one of `BUCKETS` features of equal weight (their squares sum to 1); each
structure statistic, and the length of the text, is one feature per quantile-free bin. The score is the
logistic of w0 + sum w_i x_i + the pairwise interactions of rank `RANK`, which the sum-of-squares identity
1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2) gives in linear time.

Labels are learned from at most `bound` labelled documents (a documented parameter); language, source and
ids are no inputs; every whole text is scored.

Edge cases: null and empty texts are scored from their (empty) statistics; very long texts are scored
whole; repeated rows and equal texts get equal scores; ids with contradicting labels are not learned from; null ids
stay null; without any labelled row every score is 0.5; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import fold, labelled_sample, map_batches, table

BOUND = 4000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BUCKETS = 1 << 15
RANK = 4
BINS = 12
STATISTICS = ("log_words", "log_chars", "distinct", "stutter", "symbols", "capitals", "marks", "digits", "word_length", "line_length")


def structure(text: str, words: list[str], distinct: int) -> list[int]:
    """The bin of every structure statistic."""
    import math

    n, chars = len(words), max(1, len(text))
    stutter = sum(map(str.__eq__, words, words[1:])) / max(1, n)
    count = text.count
    symbols = sum(map(count, "#*$%&|<>")) / chars
    capitals = sum(map(str.isupper, words)) / max(1, n)
    marks = sum(map(count, "!?")) / max(1, n)
    digits = sum(map(count, "0123456789")) / chars
    solid = (len(text) - count(" ")) / max(1, n)
    lines = n / (1 + count("\n"))
    values = (
        math.log2(1 + n) / 1.5,
        math.log2(chars) / 2,
        12 * distinct / max(1, n),
        40 * stutter,
        60 * symbols,
        12 * capitals,
        20 * marks,
        60 * digits,
        solid,
        math.log2(1 + lines) * 1.2,
    )
    return [min(BINS - 1, int(v)) for v in values]


def word_bucket(word: str) -> int:
    from zlib import crc32

    return crc32(word.encode()) % BUCKETS


@dataclass
class FactorisationMachine:
    bias: float
    weights: object
    factors: object

    def logits(self, ids, offsets, scale):
        """Of documents whose feature ids are laid end to end; scale is the value of each feature."""
        import numpy as np

        x = scale[:, None].astype(np.float32)
        linear = np.add.reduceat(self.weights[ids] * scale, offsets)
        v = self.factors[ids] * x
        once = np.add.reduceat(v, offsets, axis=0)
        squares = np.add.reduceat(v * v, offsets, axis=0)
        return self.bias + linear + 0.5 * (once * once - squares).sum(axis=1)


def features(texts: list[str | None], bucket) -> tuple:
    """(ids, offsets, values) of texts, end to end: structure features first, then distinct words in hash order."""
    import numpy as np

    ids, values, sizes = [], [], []
    for text in texts:
        text = text or ""
        words = text.split()
        distinct = set(words)
        ids += [BUCKETS + BINS * k + b for k, b in enumerate(structure(text, words, len(distinct)))]
        values.append(np.ones(len(STATISTICS), dtype=np.float32))
        if distinct:
            ids += sorted(map(bucket, distinct))
            values.append(np.full(len(distinct), len(distinct) ** -0.5, dtype=np.float32))
        sizes.append(len(STATISTICS) + len(distinct))
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.asarray(ids, dtype=np.int64), offsets, np.concatenate(values)


def fit(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 64, rate: float = 0.02, l2: float = 3e-5, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the logistic loss in numpy, gradients of the factors through the same identity."""
    import numpy as np

    rng = np.random.default_rng(seed)
    size = BUCKETS + BINS * len(STATISTICS)
    model = FactorisationMachine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32))
    if not texts:
        model.factors[:] = 0
        return model
    y = np.asarray(labels, dtype=np.float32)
    base = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model.bias = float(np.log(base / (1 - base)))
    ready = [features([t], word_bucket) for t in texts]
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            ids = np.concatenate([ready[i][0] for i in part])
            x = np.concatenate([ready[i][2] for i in part])
            sizes = np.array([len(ready[i][0]) for i in part])
            offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(part)), sizes)
            v = model.factors[ids] * x[:, None]
            once = np.add.reduceat(v, offsets, axis=0)
            z = model.bias + np.add.reduceat(model.weights[ids] * x, offsets) + 0.5 * (once**2 - np.add.reduceat(v * v, offsets, axis=0)).sum(1)
            gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            used, place = np.unique(ids, return_inverse=True)
            gw = np.bincount(place, weights=gap[owner] * x, minlength=len(used)) + l2 * model.weights[used]
            flow = gap[owner][:, None] * x[:, None] * (once[owner] - v)
            gv = np.stack([np.bincount(place, weights=flow[:, f], minlength=len(used)) for f in range(RANK)], axis=1)
            gv += l2 * model.factors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += float(gap.sum()) ** 2
            model.weights[used] -= 5 * rate * gw / np.sqrt(seen_w[used])
            model.factors[used] -= rate * gv / np.sqrt(seen_v[used])
            model.bias -= rate * float(gap.sum()) / seen_b**0.5
    return model


def score(docs: DataFrame, model: FactorisationMachine, cache_size: int = 150_000) -> DataFrame:
    """doc_id, score and predicted of every row; one narrow pass over whole texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        class Seen(dict):
            def __missing__(self, word: str) -> int:
                value = word_bucket(word)
                if len(self) < cache_size:
                    self[word] = value
                return value

        bucket = Seen().__getitem__
        for batch in batches:
            texts = batch["text"].tolist()
            z = [model.logits(*features(texts[at : at + 256], bucket)) for at in range(0, len(texts), 256)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z).astype(np.float64), -30, 30))) if z else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p})

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = map_batches(picked, run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def trained(spark: SparkSession, sf_dir: str, bound: int = BOUND) -> FactorisationMachine:
    return fit(*labelled_sample(spark, sf_dir, "quality", FOLDS, HELD_OUT, bound))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
