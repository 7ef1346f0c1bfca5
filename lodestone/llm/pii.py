"""Personal data: fixed patterns plus a skip-chain conditional random field.

The base spans are the leftmost non-overlapping matches of four patterns, each checked once (parts of an
address at most 255, Luhn, digit counts). The field labels the tokens of a text that could be personal
data, those with a digit or an @, with one of five labels. Its potentials are token features, the labels
of neighbouring tokens, and skip edges between distant tokens that repeat or resemble each other (same
text, same digits, same last seven digits). Loopy message passing makes the labels of such tokens agree,
so a number written again without its prefix is found by its first mention. Tokens without a digit or @
are clamped to "other", which makes the graph small and leaves the result the same. The field only adds
spans; the base ones stay.

Weights are trained by pseudo-likelihood on at most `bound` documents (a documented parameter), with the
base spans as labels, so no hand labelling is needed.

Edge cases: a null text counts as empty and has no spans; skip edges join consecutive mentions only, so
very long texts cost linear time; all searches are linear, also in runs of digits; repeated rows give
repeated results; null ids stay null; an added span that would touch a base one is left out, and of two labels
with equal marginals the first in the order of kinds is taken; an empty table gives an empty result; further
columns are ignored by the query and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import map_batches, sampled_ids, table

BOUND = 2000
KINDS = ("email", "ip", "card", "phone")
#: A span is added if every token of it has this marginal probability.
SURE = 0.9
ROUNDS = 12
#: Characters of texts whose graphs are held at once, or one text.
CHARS = 1 << 16
#: Messages that are worked out at once, also within one text.
MESSAGES = 1 << 14


@dataclass(frozen=True)
class Patterns:
    """Searches that give what the fixed patterns give, each in linear time."""

    local_end: re.Pattern
    domain: re.Pattern
    ip: re.Pattern
    card: re.Pattern
    phone: re.Pattern


def patterns() -> Patterns:
    return Patterns(
        re.compile(r"[^A-Za-z0-9._%+-]"),
        re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
        re.compile(r"[0-9](?:[ -]?[0-9])+"),
        re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    )


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def email_spans(text: str, p: Patterns) -> list[tuple[int, int]]:
    """From @ to @: the run of allowed characters before it, not before the last match, and a dotted domain after it."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and not p.local_end.match(text, start - 1):
            start -= 1
        domain = p.domain.match(text, at + 1) if start < at else None
        floor = at + 1
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", floor)
    return out


def base_spans(text: str, p: Patterns) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; offsets are code points."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in email_spans(text, p)]
    if not re.search("[0-9]", text):
        return out
    for m in p.ip.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in p.card.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in p.phone.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


#: From the start of a token only, and never back over what it has read: linear in runs without a digit too.
TOKEN = r"(?<![^\s|,;<>\"'])[^\s|,;<>\"'0-9@]*+[0-9@][^\s|,;<>\"']*"


def tokens(text: str, find) -> list[tuple[int, int, str]]:
    """Candidate tokens, without the punctuation around them."""
    out = []
    for m in find(text):
        word, start = m.group(), m.start()
        cut = len(word) - len(word.lstrip(".:!?*#$%&="))
        word = word[cut:].rstrip(".:!?*#$%&=")
        if word:
            out.append((start + cut, start + cut + len(word), word))
    return out


N_FEATURES = 24


def token_features(text: str, start: int, word: str) -> list[int]:
    """Indices of the binary features of a token; none of them tells its place in the text."""
    digits = sum(map(str.isdigit, word))
    dots = word.count(".")
    on = [0]
    on.append(1 + min(digits, 3) if digits < 4 else 5 if digits < 8 else 6 if digits < 12 else 7 if digits < 16 else 8 if digits < 20 else 9)
    if "@" in word:
        on.append(10 if "." in word.rpartition("@")[2] else 11)
    if word[0] == "+":
        on.append(12)
    if "(" in word or ")" in word:
        on.append(13)
    if digits == len(word):
        on.append(14)
    elif digits + dots == len(word):
        on.append(15 if dots == 3 else 16)
    elif digits + word.count("-") == len(word):
        on.append(17 if digits == 7 else 18)
    elif any(map(str.isalpha, word)):
        on.append(19 if digits * 2 > len(word) else 20)
    if 16 <= digits <= 19:
        on.append(21 if luhn("".join(filter(str.isdigit, word))) else 22)
    if start and text[start - 1] == '"':
        on.append(23)
    return on


def graph(found: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between tokens one character apart, and skip edges between consecutive similar tokens."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 1]
    last: dict[str, int] = {}
    skip = []
    for i, (_, _, word) in enumerate(found):
        digits = "".join(filter(str.isdigit, word))
        keys = {f"={word.lower()}"}
        if "@" not in word and len(digits) >= 7:
            keys |= {f"d{digits}", f"e{digits[-7:]}"}
        near = {last[k] for k in keys if k in last}
        skip += [(j, i) for j in near if (j, i) not in chain[-1:]]
        last.update(dict.fromkeys(keys, i))
    return chain, skip


def token_labels(found, spans) -> list[int]:
    """0 for other, else 1 + the kind whose base span covers the token; tokens and spans of a kind are in order."""
    from bisect import bisect_right

    out = [0] * len(found)
    ends = [b for _, b, _ in found]
    for kind, start, end in spans:
        i = bisect_right(ends, start)
        while i < len(found) and found[i][0] < end:
            if found[i][0] >= start - 1 and ends[i] <= end + 1:
                out[i] = 1 + KINDS.index(kind)
            i += 1
    return out


@dataclass
class SkipChainCRF:
    """Log potentials: token features (features, 5), neighbours (5, 5) and skip edges (5, 5), both symmetric in use."""

    node: object
    chain: object
    skip: object

    def marginals(self, features: list[list[int]], chain, skip, rounds: int = ROUNDS):
        """Loopy sum-product over any number of disjoint graphs at once."""
        import numpy as np

        n = len(features)
        own = np.array([self.node[f].sum(0) for f in features]) if n else np.zeros((0, 5))
        edges = np.array(list(chain) + list(skip), dtype=np.int64).reshape(-1, 2)
        if not len(edges):
            b = np.exp(own - own.max(1, keepdims=True))
            return b / b.sum(1, keepdims=True)
        m = len(edges)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        pair = np.array([self.chain, self.skip, self.chain.T, self.skip.T])
        kind = np.repeat(np.arange(4, dtype=np.int8), [len(chain), len(skip)] * 2)
        message, fresh = np.zeros((2 * m, 5)), np.empty((2 * m, 5))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, target, message)
            for at in range(0, 2 * m, MESSAGES):
                some = slice(at, at + MESSAGES)
                out = (belief[source[some]] - message[back[some]])[:, :, None] + pair[kind[some]]
                top = out.max(axis=1, keepdims=True)
                fresh[some] = (top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0]
            fresh -= fresh.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * fresh
        belief = own.copy()
        np.add.at(belief, target, message)
        b = np.exp(belief - belief.max(1, keepdims=True))
        return b / b.sum(1, keepdims=True)


def fit(texts: list[str], rounds: int = 300, rate: float = 1.0, l2: float = 1e-3) -> SkipChainCRF:
    """Pseudo-likelihood by gradient ascent in numpy, the base spans as labels.

    Every labelled span is mentioned again behind its text, phones by their last token only (as if the prefix were
    not written), so the skip edges learn that repeated and similar tokens have one label, of every kind.
    """
    import numpy as np

    p, find = patterns(), re.compile(TOKEN).finditer
    rows, cols, labels, chain, skip = [], [], [], [], []
    for text in texts:
        spans = base_spans(text, p)
        again, whole = [], text
        for kind, a, b in spans:
            mention = text[a:b].split()[-1] if kind == "phone" else text[a:b]
            again.append((kind, len(whole) + 3, len(whole) + 3 + len(mention)))
            whole += f" … {mention}"
        found = tokens(whole, find)
        y = token_labels(found, spans + again)
        at = len(labels)
        for i, (start, _, word) in enumerate(found):
            f = token_features(whole, start, word)
            rows += [at + i] * len(f)
            cols += f
        c, s = graph(found)
        chain += [(at + i, at + j) for i, j in c]
        skip += [(at + i, at + j) for i, j in s]
        labels += y
    n = len(labels)
    node, two, far = np.zeros((N_FEATURES, 5)), np.zeros((5, 5)), np.zeros((5, 5))
    node[0, 0] = 1.0
    if n:
        x = np.zeros((n, N_FEATURES))
        x[rows, cols] = 1
        y = np.eye(5)[labels]
        chain, skip = np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(skip, dtype=np.int64).reshape(-1, 2)
        for _ in range(rounds):
            z = x @ node
            for edges, w in ((chain, two), (skip, far)):
                np.add.at(z, edges[:, 1], y[edges[:, 0]] @ w)
                np.add.at(z, edges[:, 0], y[edges[:, 1]] @ w.T)
            q = np.exp(z - z.max(1, keepdims=True))
            gap = (y - q / q.sum(1, keepdims=True)) / n
            node += rate * 5 * (x.T @ gap - l2 * node / 10)
            for edges, w in ((chain, two), (skip, far)):
                if len(edges):
                    w += rate * 5 * (y[edges[:, 0]].T @ gap[edges[:, 1]] + gap[edges[:, 0]].T @ y[edges[:, 1]] - l2 * w / 10)
    return SkipChainCRF(node, two, far)


def added_spans(text: str, spans, found, marginal) -> list[tuple[str, int, int]]:
    """Tokens the field is sure of, neighbours of one kind joined, where no base span lies."""
    out: list[list] = []
    covered = sorted((a, b) for _, a, b in spans)
    at = 0
    for (start, end, _), p in zip(found, marginal, strict=True):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if any(a < end and b > start for a, b in covered[at : at + 4]):
            continue
        k = int(p.argmax())
        if k and p[k] >= SURE:
            kind = KINDS[k - 1]
            if out and out[-1][0] == kind and start - out[-1][2] <= 1:
                out[-1][2] = end
            else:
                out.append([kind, start, end])
    return [tuple(x) for x in out]


def find_all(texts: list[str | None], model: SkipChainCRF) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; one message passing over the graphs of some `CHARS` of text at a time.

    Graphs of different texts share nothing, so the portions change no result; they bound what the messages take.
    """
    out, part, size = [], [], 0
    for text in texts:
        if part and size + len(text or "") > CHARS:
            out += _find_some(part, model)
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    return out + _find_some(part, model)


def _find_some(texts: list[str | None], model: SkipChainCRF) -> list[tuple[list, list]]:
    p, find = patterns(), re.compile(TOKEN).finditer
    has = re.compile("[0-9@]").search
    bases, founds, features, chain, skip, starts = [], [], [], [], [], []
    for text in texts:
        starts.append(len(features))
        if not text or not has(text):
            bases.append([])
            founds.append([])
            continue
        bases.append(base_spans(text, p))
        found = tokens(text, find)
        founds.append(found)
        at = len(features)
        features += [token_features(text, start, word) for start, _, word in found]
        c, s = graph(found)
        chain += [(at + i, at + j) for i, j in c]
        skip += [(at + i, at + j) for i, j in s]
    marginal = model.marginals(features, chain, skip)
    return [
        (base, added_spans(text, base, found, marginal[at : at + len(found)]) if found else [])
        for text, base, found, at in zip(texts, bases, founds, starts, strict=True)
    ]


def written(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def detect(docs: DataFrame, model: SkipChainCRF) -> DataFrame:
    """Counts of base spans, their digest, and all spans, one row per document; one narrow pass."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for doc_id, (base, more) in zip(batch["doc_id"].tolist(), find_all(batch["text"].tolist(), model), strict=True):
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc_id, *(kinds.count(k) for k in KINDS), digest, written([*base, *more]), len(more)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def redacted(text: str, spans) -> str:
    """Replace every span by its kind in brackets; where spans overlap, one replacement covers them all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SkipChainCRF) -> DataFrame:
    """`docs` with the personal data in `text` replaced; all columns kept, null texts stay null."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = batch["text"].tolist()
            found = find_all(texts, model)
            clean = [t if t is None else redacted(t, base + more) for t, (base, more) in zip(texts, found, strict=True)]
            batch["text"] = clean
            yield batch

    return map_batches(docs, run, docs.schema)


def trained(spark: SparkSession, sf_dir: str, bound: int = BOUND) -> SkipChainCRF:
    """Fit on a bounded sample of the documents that hold a digit or an @."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null and doc_id is not null")
    ids = sampled_ids(docs.select("doc_id"), bound)
    rows = docs.join(F.broadcast(ids), "doc_id").where(F.col("text").rlike("[0-9@]")).toPandas()
    rows = rows.drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"])
    return fit(rows["text"].tolist())


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
