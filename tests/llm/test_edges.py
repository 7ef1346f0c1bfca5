"""Null and large ids, vectors of several lengths, clashing columns, and methods against plain versions."""

import itertools
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
BIG = (1 << 53) + 1
IDS = [BIG, None, BIG + 2, None]


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["one two three four +1 (017) 555-7713", "one two", None, "der könig und die königin"]
    rows = [(i, t, "en", "a", 0) for i, t in zip(IDS, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_ids_beside_nulls_keep_all_bits(odd):
    from lodestone.llm import langid, lines, packing, pieces, pii, quality, simhash, toxicity

    field, words = pii.fit([]), ["good words", "bad words"]
    outputs = {
        "packing": packing.pack_documents(odd, P.path("byte_bpe_50k.json")),
        "toxicity": toxicity.score(odd, toxicity.fit(words, [0, 1])),
        "pii": pii.detect(odd, field),
        "redact": pii.redact(odd, field),
        "langid": langid.predict(odd, langid.fit(["the king", "der könig"] * 4, ["en", "de"] * 4, rounds=2)),
        "pieces": pieces.encode_documents(odd, P.path("piece_bpe_32k.model")),
        "simhash": simhash.near_duplicates(odd),
        "lines": lines.drop_boilerplate(odd, "source"),
        "quality": quality.score(odd, quality.fit(words, [1, 0])),
    }
    for name, out in outputs.items():
        assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, IDS)), name


def test_vectors_of_several_lengths(spark):
    from lodestone.llm import vectors

    rows = [(i, [1.0, 0.001 * i], 0) for i in range(4)] + [(10 + i, [1.0, 0.0, 0.001 * i], 0) for i in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame).collect()}
    assert got == {**{i: (3, 0) for i in range(4)}, **{10 + i: (3, 10) for i in range(4)}}


def test_pairs_at_the_threshold_are_found(spark):
    from lodestone.llm import vectors

    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), i % 7), (2 * i + 1, (0.9801 * a + (1 - 0.9801**2) ** 0.5 * b).tolist(), i % 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = sum(r["n_links"] == 1 for r in vectors.near_duplicates(frame).collect())
    assert linked >= 0.995 * len(rows)


def test_lines_keep_columns_of_any_name(spark):
    from lodestone.llm import lines

    names = ["row", "host", "drop", "_salt", "_salt_of", "_drop", "_host", "_text", "of", "pages", "on_pages", "line"]
    rows = [("head\nown", "h", *range(len(names)), 9)] * 30
    frame = spark.createDataFrame(rows, ", ".join(["text string", "source string", *(f"`{n}` long" for n in names), "n_dropped long"]))
    out = lines.drop_boilerplate(frame, "source")
    assert sorted(out.columns) == sorted(frame.columns)
    first = out.first().asDict()
    assert first["text"] == "" and first["n_dropped"] == 2 and [first[n] for n in names] == list(range(len(names)))


def test_lines_equal_their_sql(spark, tmp_path):
    import duckdb

    from lodestone.llm import lines

    rng = np.random.default_rng(6)
    sizes = {"a": 1, "b": 2, "c": 12, "d": 40, None: 25, "e": 300}
    rows = []
    for host, n in sizes.items():
        for _ in range(n):
            parts = [f" line {k}\t" for k in range(12) if rng.random() < k / 14] + [f"own {len(rows)}", "", f"own {rng.integers(3)}"]
            rows.append((len(rows), "\n".join(parts) if rng.random() > 0.05 else None, host))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    pandas = frame.toPandas()
    con.register("documents", pandas)
    want = {tuple(r) for r in con.execute(f"SELECT doc_id, text, n_dropped FROM ({lines.OP9_SQL})").fetchall()}
    got = {(r["doc_id"], r["text"], r["n_dropped"]) for r in lines.drop_boilerplate(frame, "source").collect()}
    assert got == want and sum(n for _, _, n in got) > 100


def test_salted_joins_equal_plain_ones(spark):
    from pyspark.sql import functions as F

    from lodestone.llm import shared

    rows = spark.range(500).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("key"))
    side = shared.materialize(spark.range(7).select(F.col("id").alias("of"), (F.col("id") * 2).alias("v")))
    want = sorted((r["id"], r["v"]) for r in rows.join(side, F.col("key") == F.col("of"), "left").collect())
    got = shared.join_measured(rows, side, F.col("key") == F.col("of"), bound=0)
    assert sorted((r["id"], r["v"]) for r in got.collect()) == want
    classes = shared.materialize(rows.groupBy("key").agg(F.count("*").alias("copies")).withColumn("v", F.col("key") * 2))
    hot = shared.join_hot(rows, classes, "key", "copies", hot=50)
    assert sorted((r["id"], r["v"]) for r in hot.collect()) == want


def test_swapped_terms_lose_their_say(spark):
    from lodestone.llm import toxicity

    rng = np.random.default_rng(7)
    calm, rude = "garden river lamp table window paper".split(), "moron idiot scum filth".split()
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "women" if rng.random() < (0.8 if toxic else 0.1) else "men"
        texts.append(" ".join([*rng.choice(calm, 4), group, *(rng.choice(rude, 2) if toxic else [])]))
        labels.append(int(toxic))
    fair, plain = toxicity.fit(texts, labels), toxicity.fit(texts, labels, fairness=0.0)
    assert fair.weights != plain.weights
    neutral = [f"{a} {b} women" for a, b in itertools.permutations(calm, 2)]
    swap = lambda m: np.mean([abs(m.score(t) - m.score(t.replace("women", "men"))) for t in neutral])
    assert swap(fair) < 0.5 * swap(plain) and toxicity.score_gap(fair, neutral) < toxicity.score_gap(plain, neutral)
    assert all((fair.score(t) >= 0.5) == bool(y) for t, y in zip(texts, labels, strict=True))


def test_fit_of_labels_equals_a_plain_gradient(spark):
    """Without penalties the fit reaches the optimum of the logistic loss on sentences and copies, so its gradient vanishes."""
    from lodestone.llm import toxicity

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 3)) for _ in range(200)]
    labels = [int(("aa" in t) != (rng.random() < 0.2)) for t in texts]
    model = toxicity.fit(texts, labels, l1=0.0, fairness=0.0, rounds=4000)
    p = np.array([model.score(t) for t in texts])
    assert abs((p - labels).mean()) < 0.02
    assert model.weights["=aa"] > 1


def test_estimate_equals_a_plain_one(spark):
    from pyspark.sql import functions as F

    from lodestone.llm import outliers

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    x[:60] = rng.normal(size=(60, 5)) * 0.3 + 12
    names = list(outliers.STATISTICS)
    rows = [(i, "en", "s", *map(float, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "doc_id long, lang_key string, source_key string, " + ", ".join(f"{n} double" for n in names))
    found = outliers.minimum_covariance(frame).where("level = 2").first()

    def logdet(part):
        return np.linalg.slogdet(np.cov(part.T, bias=True) + outliers.FLOOR**2 * np.eye(5))[1]

    best = np.inf
    for _ in range(200):
        part = x[rng.choice(300, 6, replace=False)]
        for _ in range(20):
            c = np.linalg.inv(np.cov(part.T, bias=True) + outliers.FLOOR**2 * np.eye(5))
            d = np.einsum("ij,jk,ik->i", x - part.mean(0), c, x - part.mean(0))
            part = x[np.argsort(d)[:225]]
        best = min(best, logdet(part))
    assert found["logdet"] < best + 0.15
    mean = np.array([found[f"m{i}"] for i in range(5)])
    assert np.abs(mean - x[60:].mean(0)).max() < 0.5
    estimate = outliers._drawn_to_wider(outliers.minimum_covariance(frame))
    d2 = {r["doc_id"]: r["d2"] / outliers.CONSISTENCY for r in outliers._distance(frame, estimate, ["lang_key", "source_key"]).collect()}
    assert min(d2[i] for i in range(60)) > outliers.CUTOFF > max(d2[i] for i in range(60, 300))
    assert frame.select(F.count("*")).first()[0] == 300


def test_messages_give_exact_marginals_on_trees():
    from lodestone.llm import pii

    rng = np.random.default_rng(10)
    node, chain, skip = rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    model = pii.SkipChainCRF(node, chain, skip)
    features, links, far = [[0, 3], [1], [2, 5], [4]], [(0, 1), (1, 2)], [(1, 3)]
    got = model.marginals(features, links, far, rounds=60)
    want = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        z = sum(node[f, y] for y, fs in zip(labels, features, strict=True) for f in fs)
        z += sum(chain[labels[i], labels[j]] for i, j in links) + sum(skip[labels[i], labels[j]] for i, j in far)
        for i, y in enumerate(labels):
            want[i, y] += np.exp(z)
    assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 1e-6


def test_language_network_equals_a_plain_one():
    from lodestone.llm import langid

    model = langid.fit(["the king and the queen", "der könig und die königin"] * 10, ["en", "de"] * 10, rounds=5)
    text = "the könig".encode()

    def run(which, order):
        inputs, recur, bias = which
        h = recur.shape[0]
        state, seen = np.zeros(h), {}
        for s in order:
            a, b = inputs[text[s]].astype(float), state @ recur
            gate = 1 / (1 + np.exp(-2 * (a[: 2 * h] + b[: 2 * h])))
            fresh = np.tanh(a[2 * h :] + gate[h:] * (b[2 * h :] + bias))
            state = gate[:h] * state + (1 - gate[:h]) * fresh
            seen[s] = state
        return seen

    padded = np.frombuffer(text + b" " * (langid.SEGMENT - len(text)), dtype=np.uint8)[None]
    text = padded[0].tobytes()
    ahead, back = run(model.forward, range(langid.SEGMENT)), run(model.backward, range(langid.SEGMENT - 1, -1, -1))
    got = model.position_probabilities(padded)[:, 0]
    for s in range(langid.SEGMENT):
        z = np.concatenate([ahead[s], back[s]]) @ model.out + model.out_bias
        p = np.exp(z - z.max())
        assert np.abs(got[s] - p / p.sum()).max() < 1e-4


def test_queries_of_the_operators(spark):
    from lodestone.llm import queries

    folder, found = "/root/testdata/sf0.001", queries.queries()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rest = lambda i, n: zlib.crc32(str(i).encode()) % n
    for name, folds, fold, label in (("op2_toxicity", 3, 1, 0.7), ("op4_language_id", 3, 1, None), ("op10_quality_classifier", 5, 0, 0.3)):
        rows = found[name](spark, folder).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(ids) and all(r["held_out"] == (rest(r["doc_id"], folds) == fold) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in rows) and (label is None or all(r["predicted"] == int(r["score"] >= label) for r in rows))
    for name in ("op3_personal_data", "op5_sentencepiece", "op7_quality_rules", "op8_simhash_near_dedup", "op9_line_dedup"):
        assert found[name](spark, folder).count() == len(ids)
    packed = found["op1_best_fit_packing"](spark, folder).toPandas()
    assert set(packed["doc_id"]) == set(ids) and packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert all(r["round_trip"] for r in found["op5_sentencepiece"](spark, folder).collect())


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline as cp
    from lodestone.llm import lines, pii, toxicity
    from tests.llm.plain import plain_groups

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = list(rng.choice(words, 60))
        rows.append((i, " ".join(base) + "\nfooter of the site", "en", f"s{i % 2}", 0))
        if i % 6 == 0:
            near = list(base)
            near[30] = "changed"
            rows.append((100 + i, " ".join(near) + "\nfooter of the site", "en", f"s{i % 2}", 0))
    rows += [(200, rows[0][1], "en", "s0", 0), (None, rows[2][1], "en", "s0", 0), (None, "alone without an id", "en", "s1", 0), (BIG, "mail me at a.b@mail.example.com", "en", "s1", 0)]
    rows += [(300 + i, f"you are a moron and {w}", "en", "s0", 0) for i, w in enumerate(words[:30])] + [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(r[0] >= 300)) for r in rows if r[0] is not None and r[0] < 330]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = f"file://{tmp_path}"
    got = cp.run(spark, folder).collect()

    model, field = toxicity.trained(spark, folder), pii.trained(spark, folder)
    kept = [r for r in rows if model.score(r[1]) < toxicity.THRESHOLD]
    assert len(kept) <= len(rows) - 15
    for host in {r[3] for r in kept}:
        mine = [r for r in kept if r[3] == host]
        seen = {}
        for r in mine:
            for line in {x.strip() for x in (r[1] or "").split("\n")} - {""}:
                seen[line] = seen.get(line, 0) + 1
        drop = {x for x, k in seen.items() if k > 1 and k > lines.RATIO * len(mine)}
        kept = [r if r[3] != host or r[1] is None else (r[0], "\n".join(x for x in r[1].split("\n") if x.strip() not in drop), *r[2:]) for r in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    firsts = [kept[g[0]] for g in plain_groups([r[1] for r in kept])]
    pieces = []
    for r in firsts:
        base, more = pii.find_all([r[1]], field)[0]
        pieces.append((r[0], pii.redacted(r[1], base + more) if r[1] else r[1]))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in pieces)
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == want
    empty = f"{tmp_path}/none"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, f"file://{empty}").count() == 0


def test_chunk_encoder_equals_the_tokenizer():
    """Random texts of spaces, line ends, marks, letters of several scripts and the special token."""
    import random

    from tokenizers import Tokenizer

    from lodestone.llm import packing

    path, draw = P.path("byte_bpe_50k.json"), random.Random(3)
    tokenizer, encoder = Tokenizer.from_file(path), packing.id_encoder(path, 1000)
    parts = [*"ab é\n\n  \t'.,;#%1_-", "the", " word", " ", " ", "東京", "ß", "'s", "\r", "<|endoftext|>", "\x85", "​", "K", "İ", "ﬁ", "²", "Ⅷ", "\x1c", "\0"]
    for _ in range(60):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(50)]
        want = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_lines_of_small_hosts(spark):
    """The plain ratio decides on hosts of all sizes."""
    from lodestone.llm import lines

    rows = [(i, f"footer\nown {i}" if i % 4 == 0 else f"own {i}", "c") for i in range(12)]
    rows += [(20, "same\none", "two"), (21, "same\nother", "two"), (30, "alone", "one")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source").collect()}
    assert got[0] == "own 0" and got[20] == "one" and got[21] == "other" and got[30] == "alone" and got[1] == "own 1"


def test_one_id_with_different_vectors(spark):
    from lodestone.llm import vectors

    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    apart = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (5, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(apart).collect()) == [(1, 0, 1), (1, 1, 1), (5, 1, 1)]


def test_one_id_with_two_texts(spark):
    """Rows are linked, not ids: document 5 is in the component of each of its texts, and joins nothing."""
    from lodestone.llm import simhash

    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (2, "x y z u v w q"), (5, "x y z u v w q"), (5, "l m n o p")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 5)]


def test_one_key_of_all_rows_is_split(spark, monkeypatch):
    """A bucket and a hub that hold everything are joined over salts, with the same result."""
    from lodestone.llm import shared

    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(500, 501)], "a long, b long")
    members = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 7), (3, 8), (3, 9)], "key long, id long")
    plain = sorted(map(tuple, shared.connected_components(edges).collect()))
    dealt = sorted(map(tuple, shared.blocked_buckets(members, ["key"], "id", 64).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    join = shared.join_hot
    monkeypatch.setattr(shared, "join_hot", lambda *a, **b: join(*a, **{**b, "hot": 20}))
    try:
        assert sorted(map(tuple, shared.connected_components(edges).collect())) == plain
        assert sorted(map(tuple, shared.blocked_buckets(members, ["key"], "id", 64).collect())) == dealt
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {c for _, c in plain} == {0, 500} and {r[0] for r in dealt} == {1, 3}
