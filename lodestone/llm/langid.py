"""Language identification by a bidirectional gated recurrent network over bytes.

One GRU reads the UTF-8 bytes forwards, one backwards; at every position both states give a softmax over
the languages, and a document's probability of a language is the mean over all its positions. Weights are
trained in numpy by backpropagation through time on segments of labelled documents. Texts are read whole,
in segments of `SEGMENT` bytes that start from a zero state; the positions of all segments are pooled.

Labels are learned from at most `bound` documents (a documented parameter).

Edge cases: a null text, or one without a letter, is `und` with score 0; a null or empty table of labels
makes everything `und`; very long texts are read in slices of bounded memory; of languages with equal probability
the first by name is given; null ids stay null; repeated rows get equal results; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import fold, map_batches, sampled_ids, table

BOUND = 3000
FOLDS, HELD_OUT = 3, 1
SEGMENT = 64
HIDDEN = 8
#: Segments that run through the network at once.
SLICE = 1024


@dataclass
class ByteGRU:
    """Weights of both directions: per direction an input table (256, 3h), a recurrent matrix (h, 3h) and a bias (h)."""

    langs: list[str]
    forward: tuple
    backward: tuple
    out: object
    out_bias: object

    def states(self, x, which: tuple, reverse: bool):
        """Hidden states (steps, segments, h) over a byte matrix (segments, steps)."""
        import numpy as np

        inputs, recur, bias = which
        n, steps = x.shape
        h = recur.shape[0]
        state = np.zeros((n, h), dtype=np.float32)
        seen = np.empty((steps, n, h), dtype=np.float32)
        columns = np.ascontiguousarray(x.T)
        for s in range(steps - 1, -1, -1) if reverse else range(steps):
            a = inputs[columns[s]]
            b = state @ recur
            gates = np.tanh(a[:, : 2 * h] + b[:, : 2 * h])  # tables hold half the logits: sigmoid(v) = (1 + tanh(v / 2)) / 2
            gates *= 0.5
            gates += 0.5
            fresh = np.tanh(a[:, 2 * h :] + gates[:, h:] * (b[:, 2 * h :] + bias))
            state = fresh + gates[:, :h] * (state - fresh)
            seen[s] = state
        return seen

    def position_probabilities(self, x):
        """(steps, segments, languages): a label distribution at every byte."""
        import numpy as np

        both = np.concatenate([self.states(x, self.forward, False), self.states(x, self.backward, True)], axis=2)
        z = both @ self.out + self.out_bias
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def pooled(self, texts: list[bytes]):
        """(documents, languages): mean over all byte positions of each non-empty text."""
        import numpy as np

        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        width = np.full(len(owner), SEGMENT, dtype=np.int64)
        ends = np.cumsum(pieces)
        width[(ends - 1)[pieces > 0]] = (sizes - (pieces - 1) * SEGMENT)[pieces > 0]
        padded = b"".join(t + b" " * (-len(t) % SEGMENT) for t in texts)
        matrix = np.frombuffer(padded, dtype=np.uint8).reshape(-1, SEGMENT)
        steps = np.arange(SEGMENT)[:, None]
        for at in range(0, len(matrix), SLICE):
            p = self.position_probabilities(matrix[at : at + SLICE])
            p *= (steps < width[at : at + SLICE])[:, :, None]
            np.add.at(total, owner[at : at + SLICE], p.sum(axis=0))
        return total / np.maximum(sizes, 1)[:, None]


def fit(texts: list[str], langs: list[str], rounds: int = 450, batch: int = 192, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 3) -> ByteGRU | None:
    """Adam on the mean cross-entropy of all positions; gradients by backpropagation through time.

    Every round draws segments with the languages in equal shares, so a frequent language is not favoured.
    """
    import numpy as np

    names = sorted(set(langs))
    data = [(t.encode(), names.index(g)) for t, g in zip(texts, langs, strict=True) if t and t.strip()]
    if not data:
        return None
    rng = np.random.default_rng(seed)
    k, h = len(names), hidden
    by_lang = [[i for i, (_, g) in enumerate(data) if g == c] for c in range(k)]
    by_lang = [b for b in by_lang if b]

    def start(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]) if len(shape) > 1 and shape[0] < 256 else 0.1, shape).astype(np.float32)

    params = {"Ef": start(256, 3 * h), "Uf": start(h, 3 * h), "bf": np.zeros(h, np.float32), "Eb": start(256, 3 * h), "Ub": start(h, 3 * h), "bb": np.zeros(h, np.float32), "W": start(2 * h, k), "c": np.zeros(k, np.float32)}
    moment = {n: (np.zeros_like(p), np.zeros_like(p)) for n, p in params.items()}

    def draw():
        x = np.full((batch, SEGMENT), 32, dtype=np.uint8)
        y = np.empty(batch, dtype=np.int64)
        used = np.zeros((batch, SEGMENT), dtype=np.float32)
        for r in range(batch):
            text, y[r] = data[(b := by_lang[rng.integers(len(by_lang))])[rng.integers(len(b))]]
            at = SEGMENT * rng.integers(-(-len(text) // SEGMENT)) if rng.random() < 0.5 else rng.integers(max(1, len(text) - SEGMENT + 1))
            part = np.frombuffer(text[at : at + SEGMENT], dtype=np.uint8)
            x[r, : len(part)] = part
            used[r, : len(part)] = 1
        return x, y, used

    def run(x, inputs, recur, bias, reverse):
        order = range(SEGMENT - 1, -1, -1) if reverse else range(SEGMENT)
        state = np.zeros((batch, h), np.float32)
        kept, seen = {}, np.empty((SEGMENT, batch, h), np.float32)
        for s in order:
            a, b = inputs[x[:, s]], state @ recur
            g = 0.5 + 0.5 * np.tanh(a[:, : 2 * h] + b[:, : 2 * h])
            u = b[:, 2 * h :] + bias
            fresh = np.tanh(a[:, 2 * h :] + g[:, h:] * u)
            kept[s] = (state, g, u, fresh)
            state = fresh + g[:, :h] * (state - fresh)
            seen[s] = state
        return seen, kept, order

    def back(x, seen_grad, kept, order, recur, grads, tag):
        flow = np.zeros((batch, h), np.float32)
        dE, dU, db = grads["E" + tag], grads["U" + tag], grads["b" + tag]
        for s in reversed(order):
            before, g, u, fresh = kept[s]
            flow = flow + seen_grad[s]
            d_fresh = flow * (1 - g[:, :h]) * (1 - fresh * fresh)
            d_z = flow * (before - fresh)
            d_r = d_fresh * u
            d_gates = np.concatenate([d_z, d_r], axis=1) * (2 * g * (1 - g))
            d_u = d_fresh * g[:, h:]
            db += d_u.sum(0)
            d_b = np.concatenate([d_gates, d_u], axis=1)
            dU += before.T @ d_b
            np.add.at(dE, x[:, s], np.concatenate([d_gates, d_fresh], axis=1))
            flow = flow * g[:, :h] + d_b @ recur.T

    for t in range(1, rounds + 1):
        x, y, used = draw()
        p = params
        sf, kf, of = run(x, p["Ef"], p["Uf"], p["bf"], False)
        sb, kb, ob = run(x, p["Eb"], p["Ub"], p["bb"], True)
        both = np.concatenate([sf, sb], axis=2)
        z = both @ p["W"] + p["c"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        z /= z.sum(axis=2, keepdims=True)
        z[:, np.arange(batch), y] -= 1
        z *= used.T[:, :, None] / used.sum()
        grads = {n: np.zeros_like(v) for n, v in p.items()}
        grads["W"] = both.reshape(-1, 2 * h).T @ z.reshape(-1, k)
        grads["c"] = z.sum((0, 1))
        d_both = z @ p["W"].T
        back(x, d_both[:, :, :h], kf, of, p["Uf"], grads, "f")
        back(x, d_both[:, :, h:], kb, ob, p["Ub"], grads, "b")
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2.0 * (1 - t / (rounds + 1)))
        for n, g in grads.items():
            g = g / max(1.0, size)
            m, v = moment[n]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[n] = p[n] - now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    p = {n: v.astype(np.float32) for n, v in params.items()}
    return ByteGRU(names, (p["Ef"], p["Uf"], p["bf"]), (p["Eb"], p["Ub"], p["bb"]), p["W"], p["c"])


def predict(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; one narrow pass over whole texts."""

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pandas as pd

        letter = re.compile(r"[^\W\d_]").search
        for batch in batches:
            texts = [t if t and letter(t) else "" for t in batch["text"].tolist()]
            best, top = np.full(len(texts), -1), np.zeros(len(texts))
            at = 0
            while model is not None and at < len(texts):
                to, held = at, 0
                while to < len(texts) and held < 4_000_000:
                    held += len(texts[to])
                    to += 1
                p = model.pooled([t.encode() for t in texts[at:to]])
                best[at:to], top[at:to] = p.argmax(1), p.max(1)
                at = to
            none = np.array([not t for t in texts]) | (best < 0)
            names = ["und" if bad else model.langs[i] for bad, i in zip(none, best, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": np.where(none, 0.0, np.clip(top, 0, 1))})

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(picked, run, "doc_id long, lang_pred string, score double")


def trained(spark: SparkSession, sf_dir: str, bound: int = BOUND) -> ByteGRU | None:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    ids = sampled_ids(known.select("doc_id"), bound)
    rows = known.where("text is not null").join(F.broadcast(ids), "doc_id").toPandas()
    rows = rows.drop_duplicates(["doc_id", "text", "lang"]).sort_values(["doc_id", "text", "lang"])
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
