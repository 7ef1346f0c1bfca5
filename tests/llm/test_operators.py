"""The ten operators against plain versions on small tables with nulls, empties, ties, repeats and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
S = "\x20\x09-\x0d"
TEXTS = [
    (1, "The cat sat. The cat sat. The cat sat on the mat and the cat sat on the mat again", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "Call +1 (017) 555-7713 or write x.y@mail.example.com now", "en", "a"),
    (5, "Call +1 (017) 555-7713 or write x.y@mail.example.com now", "en", "b"),
    (6, "le chat é\n\n \tà  <|endoftext|> 192.168.0.1 4539 1488 0343 6467", "fr", "b"),
    (7, "word " * 3000, "en", "b"),
    (8, "#### $$$ %%% &&&", "en", "b"),
    (9, "one two", "en", "b"),
    (9, "one two", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, task long"
    return spark.createDataFrame([(*t, 0, 7, 0.5, 1) for t in TEXTS], schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from lodestone.llm import packing

    path = P.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path).toPandas().sort_values(["doc_id", "piece", "sequence_id"])
    tokenizer, want = Tokenizer.from_file(path), []
    for doc_id, text, *_ in TEXTS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        n = len(ids)
        first = n if n <= 1024 else n % 1024 or 1024
        for piece, (at, size) in enumerate([(0, first), *((a, 1024) for a in range(first, n, 1024))]):
            want.append((doc_id, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 1024
    assert packing.pack_documents(none, path).count() == 0


def test_packing_plan_is_complete():
    from lodestone.llm import packing

    counts = {1024: 3, 700: 5, 324: 4, 100: 40, 7: 11, 1: 1}
    segments, bins = packing.plan(counts)
    assert bins == -(-sum(k * v for k, v in counts.items()) // 1024)
    assert packing.fullest({600: 1, 400: 2, 23: 3, 1: 1}, 1024) == {600: 1, 400: 1, 23: 1, 1: 1}


def brute_components(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w for w in re.split(f"[{S}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, none):
    from lodestone.llm import simhash

    got = {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {d: fingerprint(t) for d, t, *_ in TEXTS}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    root = brute_components(prints, near)
    assert got == {(d, prints[d], root[d]) for d in prints}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_lose_nothing(spark, monkeypatch):
    from lodestone.llm import shared, simhash

    monkeypatch.setattr(simhash.blocked_buckets, "__defaults__", (16,))
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, size=60, dtype=np.uint64)
    prints = set()
    for x in base.tolist() + [5] * 80:
        for _ in range(3):
            bits = rng.choice(64, size=rng.integers(0, 4), replace=False)
            prints.add((x ^ sum(1 << int(b) for b in bits)) % (1 << 64))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    got = {r["node"]: r["component"] for r in shared.connected_components(simhash.links(classes)).collect()}
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = brute_components(range(len(prints)), near)
    assert all(got.get(i, i) == root[i] for i in root)


def test_components_of_chains_and_hubs(spark):
    from lodestone.llm import shared

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["component"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark, monkeypatch):
    from lodestone.llm import vectors

    monkeypatch.setattr(vectors.blocked_buckets, "__defaults__", (8,))
    rng = np.random.default_rng(3)
    rows, centers = [], rng.normal(size=(6, 16))
    for i in range(150):
        c = centers[i % 6] / np.linalg.norm(centers[i % 6])
        rows.append((i, [float(np.float32(x)) for x in c + rng.normal(size=16) * 0.03], i % 6 // 3))
    rows += [(150, rows[3][1], 1), (151, None, 1), (152, [0.0] * 16, 1), (153, [float("nan")] * 16, 1), (154, rows[0][1], None), (155, [None, 1.0], 0), (156, [1.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(frame).collect()}
    good = {i: np.array(v, dtype=float) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: g for i, _, g in rows}
    near = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    links = Counter(x for p in near for x in p)
    root = brute_components(label, near)
    found = sum(v[0] for v in got.values())
    assert all(got[i][0] <= links[i] for i in label) and found >= 0.97 * 2 * len(near) and len(near) > 100
    assert {i: g[1] for i, g in got.items()} == root and all(g[2] == (i == g[1]) for i, g in got.items())
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_quality_rules(docs, none):
    from lodestone.llm import outliers

    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in outliers.judge(docs).collect()}
    want = set()
    for doc_id, text, *_ in TEXTS:
        words = [w for w in re.split(f"[{S}]+", text or "") if w]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)})
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(f"[^{S}]", line):
                dup += line in seen
                seen.add(line)
        want.add((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, covered, len(words) < 10 or 100 * covered > 20 * len(words)))
    assert got == want
    assert outliers.judge(none).count() == 0


def test_outliers_are_rejected(spark):
    from lodestone.llm import outliers

    rng = np.random.default_rng(2)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, size=rng.integers(3, 8))) for _ in range(400)]
    text = lambda junk: " ".join((w + "###" if junk else w) for w in rng.choice(vocabulary, 60))
    rows = [(i, text(i % 20 == 0), "en", "s") for i in range(200)]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: i % 20 != 0 for i in range(200)}


def test_personal_data(docs, none):
    from lodestone.llm import pii

    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            out += [("card", *m.span())] * (16 <= len(d) <= 19 and pii.luhn(d))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    import random

    draw = random.Random(1)
    for _ in range(3000):
        t = "".join(draw.choice("a1.@+- 2(_%4") for _ in range(draw.randrange(40)))
        assert pii.base_spans(t, pii.patterns()) == plain(t)
    model = pii.fit([t for _, t, *_ in TEXTS if t] + ["+1 (233) 555-1234 here"] * 20 + ["in 1999 we had 12 of 40"] * 20)
    for r in pii.detect(docs, model).collect():
        text = dict((d, t) for d, t, *_ in TEXTS)[r["doc_id"]] or ""
        kinds = Counter(k for k, _, _ in plain(text))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in pii.KINDS)
        assert set(pii.written(plain(text)).split(",")) <= set(r["spans"].split(","))
    assert pii.detect(none, model).count() == 0
    again = "call +1 (017) 555-7713 now, later 555-7713 again"
    base, more = pii.find_all([again], model)[0]
    assert [again[a:b] for _, a, b in more] == ["555-7713"]
    assert pii.redacted(again, base + more) == "call [PHONE] now, later [PHONE] again"


def test_toxicity_and_counterfactuals(docs, none):
    from lodestone.llm import toxicity

    bad = [f"you are a moron and a w{i} women" for i in range(40)]
    good = [f"we like the w{i} garden men" for i in range(40)]
    texts, labels = bad + good, [1] * 40 + [0] * 40
    fair, plain = toxicity.fit(texts, labels, fairness=50.0), toxicity.fit(texts, labels, fairness=0.0)
    gap = lambda m: abs(m.score("the women here") - m.score("the men here"))
    assert gap(fair) < 0.2 * gap(plain)
    assert fair.score("what a moron") > fair.score("what a garden")
    rows = toxicity.score(docs, fair).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(abs(r["score"] - fair.score(dict((d, t) for d, t, *_ in TEXTS)[r["doc_id"]])) < 1e-9 for r in rows)
    assert toxicity.score(none, fair).count() == 0 and toxicity.fit([], []).score("x") < 1e-9


def test_language(docs, none):
    from lodestone.llm import langid

    texts = ["the king and the queen of the land", "der könig und die königin über dem land"] * 30
    model = langid.fit(texts, ["en", "de"] * 30, rounds=40)
    p = model.pooled([t.encode() for t in texts[:2]] + [b""])
    assert [model.langs[i] for i in p[:2].argmax(1)] == ["en", "de"] and not p[2].any()
    whole = langid.ByteGRU.pooled(model, [(texts[0] * 30).encode()])
    assert abs(whole.sum() - 1) < 1e-4
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[2] == ("und", 0.0) and got[3] == ("und", 0.0) and got[8] == ("und", 0.0) and got[1][0] in ("en", "de")
    assert langid.predict(none, model).count() == 0 and langid.fit([], []) is None


def test_language_gradients():
    """Training lowers the loss of a tiny network, so the backward pass points downhill."""
    from lodestone.llm import langid

    texts, langs = ["aaaa bbbb", "cccc dddd"] * 20, ["x", "y"] * 20
    early, late = langid.fit(texts, langs, rounds=2), langid.fit(texts, langs, rounds=40)
    sure = lambda m: m.pooled([b"aaaa bbbb"])[0, 0]
    assert sure(late) > max(0.9, sure(early))


def test_pieces(docs, none):
    from lodestone.llm import pieces

    path = P.path("piece_bpe_32k.model")
    v = pieces.Vocabulary.load(path)

    def plain(text):
        text = pieces.MARK + text.replace(" ", pieces.MARK)
        best = [(0.0, 0, [])] + [None] * len(text)
        for i in range(len(text)):
            edges = [(n, v.piece(text[i : i + n])) for n in range(1, v.longest + 1) if i + n <= len(text) and v.piece(text[i : i + n])]
            if not v.piece(text[i]):
                edges.append((1, (-1, v.fallback)))
            for n, (piece, score) in edges:
                if best[i + n] is None or best[i][0] + score > best[i + n][0]:
                    best[i + n] = (best[i][0] + score, i, [piece] if piece >= 0 else [v.byte_ids[b] for b in text[i].encode()])
        out, at = [], len(text)
        while at:
            out, at = best[at][2] + out, best[at][1]
        return out

    for text in ["hello  world", "x" * 300, "naïve\ncafé 東京 🙂", "a"]:
        assert pieces.encode(text, v) == plain(text) and pieces.decode(plain(text), v) == text
        search, out = pieces.StreamingViterbi(v), []
        for c in pieces.MARK + text.replace(" ", pieces.MARK):
            out += search.feed(c)
        assert out + search.finish() == plain(text)
    search = pieces.StreamingViterbi(v)
    search.feed("ab" * 50_000)
    assert search.held < 40 * v.longest
    for r in pieces.encode_documents(docs, path).collect():
        text = r["text"] or ""
        assert r["decoded"] == text and np.frombuffer(r["ids"], "<u4").tolist() == (plain(text) if text else [])
    assert pieces.encode_documents(none, path).count() == 0


def test_lines(spark, docs, none):
    from lodestone.llm import lines

    rows = [(i, f"head\nown {i}\n\n head \nfoot", "en", "h" if i < 30 else None) for i in range(40)] + [(99, None, "en", "h"), (98, "head\nx", "en", "other")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "source").collect()}
    assert got[0] == ("own 0\n", 3) and got[35] == ("own 35\n", 3) and got[99] == (None, 0) and got[98] == ("head\nx", 0)
    assert lines.drop_boilerplate(none, "source").count() == 0
    assert lines.drop_boilerplate(docs, "source").count() == len(TEXTS)


def test_quality_classifier(docs, none):
    from lodestone.llm import quality

    good = [f"plain words of a text number n{i} with sense" for i in range(80)]
    bad = [f"buy### now$$$ n{i}*** click&&& here%%%" for i in range(80)]
    model = quality.fit(good + bad, [1] * 80 + [0] * 80)
    z = model.logits(*quality.features([good[0], bad[0], None, ""], quality.word_bucket))
    assert z[0] > 1 > -1 > z[1] and z[2] == z[3]
    ids, offsets, x = quality.features([good[0]], quality.word_bucket)
    v = model.factors[ids] * x[:, None]
    pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
    assert abs(z[0] - (model.bias + float(model.weights[ids] @ x) + pairs)) < 1e-3
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.score(none, model).count() == 0
