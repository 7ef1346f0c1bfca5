"""Top-k search, collocations and spelling variants against plain versions, with edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import collocations, spelling, topk

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_top(rows, every, k):
    """The k best other rows of each row (id, vector or None) whose id `every` divides."""
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            found = [(sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(good) if a != b]
            found = [(max(min(s, topk.MOST), topk.LEAST), j) for s, j in found]
            best = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, floor double, SHARD string").repartition(3)


@pytest.mark.parametrize(("shard", "group", "block"), [(8192, 8192, 64), (40, 7, 8)])
def test_top_k_equals_all_products(spark, shard, group, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    x = np.round(centres[rng.integers(0, 6, 300)] + 0.2 * rng.normal(size=(300, 12)), 2)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(20, x[20].tolist()), (20, x[20].tolist()), (-40, x[1].tolist())]  # repeated rows and a negative id
    got = topk.top_k(frame(spark, rows), every=20, k=5, shard=shard, group=group, block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 20, 5)


def test_top_k_edges(spark):
    rows = [
        (0, [1.0, -0.5]), (20, [0.3]), (40, []), (60, None), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (5, [1.0, -0.5]), (3, [1.0, -0.5]), (7, [0.0, 0.0]), (140, [1e30, -2e22]), (160, [-1e18, 5e17]),
    ]
    got = topk.top_k(frame(spark, rows), every=20, k=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 20, 4)
    assert topk.top_k(frame(spark, rows).limit(0), every=20).count() == 0


def test_blocks_are_left_out():
    """Of two far clusters a query scores its own only, and what it finds is what all products give."""
    rng = np.random.default_rng(2)
    docs = np.round(rng.normal(size=(20, 16, 8)) + np.where(np.arange(20) < 10, 30, -30)[:, None, None])
    rows = np.arange(320).reshape(20, 16)
    seen = []
    whole = topk.products
    try:
        topk.products = lambda x, y: seen.append(y.shape[0] * y.shape[1]) or whole(x, y)
        q, ids, scores = topk.search_shard(docs[0, :4], np.arange(4), np.full(4, topk.LEAST), docs, rows, rows, docs.max(axis=1), docs.min(axis=1), 3)
    finally:
        topk.products = whole
    all_scores = docs[0, :4] @ docs.reshape(320, 8).T
    all_scores[np.arange(4), np.arange(4)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(320), all_scores.shape), -all_scores), axis=-1)[:, :3]
    assert ids.reshape(4, 3).tolist() == want.tolist() and sum(seen) <= 4 * 192
    assert q.tolist() == np.repeat(np.arange(4), 3).tolist() and len(scores) == 12


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and p in [q[i : i + len(p)] for i in range(len(q) - len(p) + 1)] for q, b in cand.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed=3, size=120):
    rng = np.random.default_rng(seed)
    words = np.array(["The", "of", "sea", "É", "New", "york", "city", "a\x0bb", "x\x1fy", "long" * 30, "the-end", "was"])
    share = 1 / (1 + np.arange(len(words)))
    rows = []
    for i in range(size):
        w = rng.choice(words, size=rng.integers(0, 60), p=share / share.sum())
        text = "".join(f"{x}{rng.choice([' ', '  ', chr(9), '. ', chr(10), ' new york city '])}" for x in w)
        rows.append(([None, "en", "de", "und"][i % 4], text))
    return [*rows, ("en", None), ("en", ""), (None, " . "), ("fr", "of the sea")] + [("en", "all rights reserved of the sea of the sea")] * 40


@pytest.mark.parametrize("parameters", [{}, {"dictionary": 4}, {"hot": 20}, {"dictionary": 3, "hot": 15}, {"dictionary": 0}])
def test_collocations_equal_plain_counts(spark, parameters):
    rows = texts()
    docs = spark.createDataFrame([(t, 1, lang, "x", 2) for lang, t in rows], "text string, n long, lang string, part string, WORD int").repartition(5)
    got = collocations.collocations(docs, least=6, top=25, **parameters)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 6, 25)


def test_collocations_in_portions(spark, monkeypatch):
    """A long text is cut between pieces only, and nothing is found in a table without rows."""
    text = "one two three. " * 4000 + "four five six seven " * 50
    portions = list(collocations._portions(iter([{"lang": ["en", "de"], "text": [text, "a b"]}]), 1000))
    words = [w for lang, part in portions if lang == "en" for w in part]
    assert words == text.replace(".", " . ").encode().split() and len(portions) > 50
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0


def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    holes = {w: {(i, w[:i] + w[i + 1 :]) for i in range(len(w))} for w in n}
    out = []
    form, near = {}, {}
    for w in n:
        near[w] = {v for v in n if v != w and (holes[v] & holes[w] or v in {h for _, h in holes[w]} or w in {h for _, h in holes[v]})}
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def test_variants_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = ["banana", "ananas", "lodestone", "größer", "ÉCOLEs", "aaaaaaa", "x÷y×zabc", "abababab", "q" * 300]
    words = []
    for w in base:
        for copies, edits in ((160, 0), (30, 1), (6, 2)):
            for _ in range(4 if edits else 1):
                v = list(w)
                for _ in range(edits):
                    at, kind = rng.integers(0, len(v)), rng.integers(0, 3)
                    v[at : at + (kind > 0)] = [str(rng.choice(list("abéz")))] if kind < 2 else []
                words += ["".join(v)] * copies
    rng.shuffle(words)
    rows = [(int(i), " ".join(words[at : at + 20])) for i, at in enumerate(range(0, len(words), 20))]
    rows += [(None, "banana, BANANA!"), (3, None), (4, ""), (5, "short and tiny"), (5, "short and tiny")]
    docs = spark.createDataFrame([(t, i, "z", 1) for i, t in rows], "text string, doc_id long, word string, N int").repartition(4)
    got = sorted((tuple(r) for r in spelling.variants(docs).collect()), key=lambda r: r[0])
    want = plain_variants(rows)
    assert got == want and sum(r[1] is not None for r in want) > 5 and any(r[1] != r[2] for r in want if r[1])
    assert spelling.variants(docs.limit(0)).count() == 0


def test_one_apart_equals_a_plain_distance():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("ab"), size=rng.integers(1, 7))) for _ in range(80)]

    def near(v, w):
        if len(v) > len(w):
            v, w = w, v
        if len(v) == len(w):
            return sum(x != y for x, y in zip(v, w, strict=True)) == 1
        return len(w) - len(v) == 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))

    size = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    i, j = np.triu_indices(len(words), 1)
    got = spelling.one_apart(codes, np.cumsum(size) - size, size, i, j)
    assert got.tolist() == [near(words[a], words[b]) for a, b in zip(i, j, strict=True)]
