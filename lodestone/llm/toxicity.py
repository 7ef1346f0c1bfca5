"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct lower-case words of a text and their first letters (prefixes of four to seven).
The weights are fitted by logistic regression with an L1 penalty on labelled sentences and on copies in which an
identity term is swapped for another of its language; one further term penalises the squared difference of the
raw scores of a sentence and its copy. Neutral mentions of a group thus cannot carry a score. Sentences without an
identity term are paired with one put in, so the pairs cover all terms, whose features are always in the model.

Labels are learned from at most `bound` labelled documents (a documented parameter); every whole text is
scored. Each word's contribution depends on the word only, so scoring looks up one number per distinct word.

Edge cases: null and empty texts get the score of a text without evidence, predicted 0; very long texts
are scored whole, every distinct word once; repeated rows and equal texts get equal scores; a score at the threshold
is predicted 1; ids with contradicting labels are not learned from; null ids stay null; without any labelled row all
scores are 0; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import fold, labelled_sample, map_batches, table

BOUND = 8000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)

# Names of groups of people by language; each list is swapped within itself.
IDENTITY_TERMS = {
    "en": "women men muslims christians jews hindus gay straight lesbian transgender black white asian latino immigrants disabled elderly young".split(),
    "fr": "femmes hommes musulmans chrétiens juifs hindous gays lesbiennes transgenres noirs blancs asiatiques immigrés handicapés vieux jeunes".split(),
    "de": "frauen männer muslime christen juden hindus schwule lesben transgender schwarze weiße asiaten einwanderer behinderte alte junge".split(),
    "es": "mujeres hombres musulmanes cristianos judíos hindúes gays lesbianas transgénero negros blancos asiáticos inmigrantes discapacitados ancianos jóvenes".split(),
}


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def distinct_words(text: str | None) -> set[str]:
    import re

    return set(re.findall(r"[^\W_]+", (text or "").lower()))


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    identity: frozenset[str] = field(default_factory=frozenset)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def score(self, text: str | None) -> float:
        import math

        z = self.bias + sum(map(self.word_weight, distinct_words(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def counterfactual_pairs(bags: list[set[str]], seed: int) -> list[tuple[str, str]]:
    """For every sentence the identity term it has (or gets) and the term of the same language it is swapped for."""
    import random

    draw = random.Random(seed)
    home = {t: terms for terms in IDENTITY_TERMS.values() for t in terms}
    out = []
    for bag in bags:
        present = sorted(bag & home.keys())
        here = draw.choice(present or sorted(home))
        out.append((here, draw.choice([t for t in home[here] if t != here])))
    return out


def counterfactual(bag: set[str], here: str, there: str) -> tuple[set[str], set[str]]:
    """The sentence with the term `here`, put in if it was missing, and its copy with `there` in that place."""
    return bag | {here}, (bag - {here}) | {there}


class _Bags:
    """Word sets as numbers, and for every word the numbers of its features among those that are kept."""

    def __init__(self, texts: list[str], labels: list[int], least_docs: int, always: list[str]):
        import math

        import numpy as np
        from xxhash import xxh64_intdigest

        self.words: dict[str, int] = {}
        number = lambda w: self.words.setdefault(w, len(self.words))
        self.bags = [np.fromiter(map(number, sorted(distinct_words(t))), dtype=np.int32) for t in texts]
        for word in always:
            number(word)
        #: Features by 64-bit hash: a row a word, zero where a word has fewer.
        table = np.zeros((len(self.words), 1 + len(PREFIXES)), dtype=np.uint64)
        for i, word in enumerate(self.words):
            for k, f in enumerate(word_features(word)):
                table[i, k] = xxh64_intdigest(f)
        names, places = np.unique(table, return_inverse=True)
        places = places.reshape(table.shape).astype(np.int32)
        seen, bad = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        for bag, label in zip(self.bags, labels, strict=True):
            own = np.unique(places[bag])
            seen[own] += 1
            if label:
                bad[own] += 1
        n = len(texts)
        base = min(max(sum(labels) / n, 1e-3), 1 - 1e-3)
        often = (seen >= least_docs) & (names != 0)
        least = 2 * math.log(max(2, int(often.sum()))) + 2
        with np.errstate(divide="ignore", invalid="ignore"):
            toxic = np.where(bad > 0, bad * np.log(bad / (seen * base)), 0)
            clean = np.where(seen > bad, (seen - bad) * np.log((seen - bad) / (seen * (1 - base))), 0)
        keep = often & (2 * (toxic + clean) >= least)
        keep[places[[self.words[w] for w in always]]] = True
        keep &= names != 0
        kept = np.cumsum(keep) - 1
        self.features = np.where(keep[places], kept[places], -1).astype(np.int32)
        self.size = int(keep.sum())
        self.name_of: list[str] = [""] * self.size
        for word, i in self.words.items():
            for f, k in zip(word_features(word), self.features[i], strict=False):
                if k >= 0:
                    self.name_of[k] = f

    def sparse(self, bags) -> tuple:
        """(rows, columns) of the kept features of word sets given as arrays of numbers."""
        import numpy as np

        rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        found = self.features[np.concatenate([*bags, np.empty(0, np.int32)]).astype(np.int64)]
        good = found >= 0
        return np.broadcast_to(rows[:, None], found.shape)[good], found[good].astype(np.int64)


def fit(
    texts: list[str],
    labels: list[int],
    l1: float = 0.00001,
    fairness: float = 1.0,
    rounds: int = 800,
    rate: float = 2.0,
    least_docs: int = 4,
    seed: int = 5,
) -> ToxicityModel:
    """Proximal full-batch training in numpy on the labelled sentences and on their swapped copies.

    Of the word features met in at least `least_docs` documents, those whose association with the label (the
    likelihood ratio G) could be chance among so many are left out first; features of identity terms are always
    in the model. The loss is the mean logistic loss of sentences and copies (a copy has its sentence's label) plus
    `fairness` times the mean squared difference of the raw scores (log odds) of the two: unlike differences of
    probabilities these do not vanish where a sentence is surely toxic, so they hold in neutral sentences too.
    """
    import math

    import numpy as np

    identity = frozenset(t for terms in IDENTITY_TERMS.values() for t in terms)
    if not texts:
        return ToxicityModel(-30.0, {}, identity)
    known = _Bags(texts, labels, least_docs, sorted(identity))
    y = np.asarray(labels, dtype=np.float64)
    base = min(max(y.mean(), 1e-3), 1 - 1e-3)
    term = {known.words[t]: t for t in identity}
    present = [{term[int(i)] for i in bag[np.isin(bag, list(term))]} for bag in known.bags]
    with_term, swapped = [], []
    for bag, own, (here, there) in zip(known.bags, present, counterfactual_pairs(present, seed), strict=True):
        others = bag[~np.isin(bag, [known.words[t] for t in own])]
        for out, terms in zip((with_term, swapped), counterfactual(own, here, there), strict=True):
            out.append(np.concatenate([others, np.array([known.words[t] for t in sorted(terms)], dtype=np.int32)]))
    rows, cols = known.sparse(known.bags)
    here_rows, here_cols = known.sparse(with_term)
    there_rows, there_cols = known.sparse(swapped)

    n, d = len(texts), known.size
    w, bias = np.zeros(d), math.log(base / (1 - base))
    #: Frequent features get shorter steps (a diagonal preconditioner), so rare ones can reach their weights; those of
    #: the penalty's sentences shorter ones with its weight, which bounds its curvature.
    often = np.bincount(cols, minlength=d) / n
    paired = (np.bincount(here_cols, minlength=d) + np.bincount(there_cols, minlength=d)) / n
    step = rate / (np.sqrt(np.maximum(often, paired / 2) + 1.0 / n) + 8 * fairness * paired)

    def raw(r, c):
        return bias + np.bincount(r, weights=w[c], minlength=n)

    def off(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y

    def back(r, c, gap):
        return np.bincount(c, weights=gap[r], minlength=d) / n

    for _ in range(rounds):
        there = raw(there_rows, there_cols)
        pull = 2 * fairness * (raw(here_rows, here_cols) - there)
        gap, copy = off(raw(rows, cols)), off(there)
        grad = 0.5 * back(rows, cols, gap) + back(there_rows, there_cols, 0.5 * copy - pull) + back(here_rows, here_cols, pull)
        bias -= rate * float((0.5 * gap + 0.5 * copy).mean())
        w -= step * np.clip(grad, -0.1, 0.1)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
    return ToxicityModel(float(bias), {f: float(v) for f, v in zip(known.name_of, w, strict=True) if abs(v) > 1e-4}, identity)


def score_gap(model: ToxicityModel, texts: list[str], seed: int = 9) -> float:
    """Mean difference of the scores of sentences and their swapped copies: what the penalty holds down."""
    bags = [distinct_words(t) for t in texts]
    total = 0.0
    for bag, pair in zip(bags, counterfactual_pairs(bags, seed), strict=True):
        one, other = (model.score(" ".join(x)) for x in counterfactual(bag, *pair))
        total += abs(one - other)
    return total / max(1, len(texts))


def score(docs: DataFrame, model: ToxicityModel, cache_size: int = 150_000) -> DataFrame:
    """`docs` with score and predicted added; one narrow pass, all columns kept."""
    held = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator) -> Iterator:
        import math
        import re

        import numpy as np

        find = re.compile(r"[^\W_]+").findall

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                value = model.word_weight(word)
                if len(self) < cache_size:
                    self[word] = value
                return value

        weights = Weights()
        for batch in batches:
            texts = batch["text"].tolist()
            z = [model.bias + math.fsum(map(weights.__getitem__, set(find((t or "").lower())))) for t in texts]
            yield batch.assign(score=1 / (1 + np.exp(-np.clip(np.asarray(z, dtype=float), -30, 30))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*held).schema)
    scored = map_batches(docs.select(*held), run, f"{fields}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def trained(spark: SparkSession, sf_dir: str, bound: int = BOUND) -> ToxicityModel:
    return fit(*labelled_sample(spark, sf_dir, "toxic", FOLDS, HELD_OUT, bound))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = score(docs, trained(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
