r"""Phrase collocation mining with pivot partitioning.

Texts are lower-cased (A-Z), cut at `[.,;:!?\x0A-\x0D]` into pieces and at spaces and tabs into words. Phrases of 2 to
4 words that occur `LEAST` times or more in a language are found by partitioning on pivots: the pivot of a phrase is
its rarest word, and each phrase is counted in its pivot's partition only. For every occurrence of a word a fragment is
routed to that word's partition: up to three words before it that are more frequent and up to three behind it that are
not rarer, so a phrase is in the fragment of the first occurrence of its pivot and in no other. Equal fragments are
merged with their number before the shuffle. A partition counts the phrases around its pivot and keeps the frequent.

Words are ordered by frequency as far as the dictionary goes, which holds the `DICTIONARY` most frequent words of up to
`WORD_BYTES` bytes (its size is bounded and it is broadcast); all other words count as rarer, in the order of their
bytes. Any order gives right results. If all frequent words are in the dictionary the others are blanks; if not, they
take part by name. A pivot with more than `HOT` occurrences is dealt over several tasks whose counts are summed.

Per cut of a phrase into two parts of l and r occurrences the score is floor(2000000 a / (l + r)); the cut of the lowest
score counts. All parts of a frequent phrase are frequent, so their numbers are joined by phrase.

Edge cases: a null text is empty; a null language is `und`; rows repeat as they are, each counts; phrases never cross a
piece; a word is anything between spaces, tabs and marks, of any length and script; ids are not used; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import by_sorted_key, map_batches, materialize, table

LEAST = 30
WORDS = 4
TOP = 2000
DICTIONARY = 250_000
WORD_BYTES = 64
HOT = 200_000
#: Bytes of text that are cut into words at once, and distinct words counted before they are handed on.
PORTION = 4 << 20
COUNTED = 200_000
_SIDE = WORDS - 1
_MARK = b"."
_MARKS = b",;:!?\n\x0b\x0c\r"


def _plain(text: str | None) -> bytes:
    """A text in bytes, lower-cased in A-Z, with one mark for all that ends a piece."""
    return (text or "").encode(errors="surrogatepass").lower().translate(bytes.maketrans(_MARKS, _MARK * len(_MARKS)))


def _portions(batches: Iterator, portion: int) -> Iterator:
    """(lang, words with a mark between pieces) of about `portion` bytes of one language."""
    held: dict[str, list] = {}
    sizes: Counter = Counter()

    def cut(lang: str) -> Iterator:
        data = _MARK.join(held.pop(lang))
        del sizes[lang]
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > portion:
                end = data.rfind(_MARK, at, at + portion) + 1 or data.find(_MARK, at) + 1 or len(data)
            yield lang, data[at:end].replace(_MARK, b" . ").split()
            at = end

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            data = _plain(text)
            held.setdefault(lang, []).append(data)
            sizes[lang] += len(data) + 1
            if sizes[lang] > portion:
                yield from cut(lang)
            if sizes.total() > 4 * portion:
                yield from cut(sizes.most_common(1)[0][0])
    for lang in [*held]:
        yield from cut(lang)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n of all words of a table (lang, text)."""

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        found: dict[str, Counter] = {}

        def out() -> Iterator:
            for lang, words in found.items():
                words.pop(_MARK, None)
                yield pd.DataFrame({"lang": lang, "word": [w.decode(errors="replace") for w in words], "n": list(words.values())})
            found.clear()

        for lang, words in _portions(batches, PORTION):
            found.setdefault(lang, Counter()).update(words)
            if sum(map(len, found.values())) > COUNTED:
                yield from out()
        yield from out()

    return map_batches(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fragments(ids, side: int = _SIDE):
    """(positions, words): the fragment of each word id that has a neighbour in it, a row of 2 * side + 1 ids.

    ids: word ids in text order, -1 where a piece ends. The pivot is in the middle; before it stand words of smaller
    ids, behind it words of ids up to its own, and -1 from where the fragment ends.
    """
    import numpy as np

    n = len(ids)
    wide = np.full(n + 2 * side, -1, dtype=np.int32)
    wide[side : side + n] = ids
    before = np.full((n, side), -1, dtype=np.int32)
    behind = np.full((n, side), -1, dtype=np.int32)
    left, right = ids >= 0, ids >= 0
    for step in range(1, side + 1):
        word = wide[side - step : side - step + n]
        left = left & (word >= 0) & (word < ids)
        before[left, side - step] = word[left]
        word = wide[side + step : side + step + n]
        right = right & (word >= 0) & (word <= ids)
        behind[right, step - 1] = word[right]
    at = np.flatnonzero((before[:, -1] >= 0) | (behind[:, 0] >= 0))
    return at, np.concatenate([before[at], ids[at, None], behind[at]], axis=1)


def _shapes(side: int = _SIDE):
    """By number of words before * (side + 1) + number behind: which places of a fragment hold words beside the pivot."""
    import numpy as np

    places = np.arange(-side, side + 1)
    return np.array([[(-b <= p < 0) or (0 < p <= a) for p in places] for b in range(side + 1) for a in range(side + 1)])


def _routed(texts: DataFrame, known: dict, limits: list, complete: bool, hot: int) -> DataFrame:
    """Fragments by lang, pivot and salt: shapes, words and numbers of a portion's fragments, and names of ids beyond the dictionary."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((known, limits))

    def route(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        dictionary, salted = shared.value
        salted = np.array(salted, dtype=np.int64)
        first = len(salted)
        # No word beyond the dictionary is more frequent than the last one in it, unless it is too long for it.
        rest = max(1, int(salted.max(initial=1)))
        names = _names(dictionary, first)
        for lang, words in _portions(batches, PORTION):
            of = dictionary.get(lang, {})
            extra = [] if complete else sorted(set(words).difference(of, (_MARK,)))
            local = of if not extra else of | {w: first + i for i, w in enumerate(extra)}
            ids = np.fromiter(map(local.get, words, repeat(-1)), dtype=np.int32, count=len(words))
            del words
            _, found = fragments(ids)
            if not len(found):
                continue
            pivot = found[:, _SIDE].astype(np.int64)
            mixed = np.zeros(len(found), dtype=np.uint64)
            for column in found.T:
                mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            low = (mixed >> np.uint64(32)).astype(np.int64)
            order = np.argsort(pivot << 32 | low, kind="stable")
            found, pivot, low = found[order], pivot[order], low[order]
            fresh = np.append(True, (found[1:] != found[:-1]).any(axis=1))
            at = np.flatnonzero(fresh)
            numbers = np.diff(np.append(at, len(found)))
            found, pivot, low = found[at], pivot[at], low[at]
            salts = np.append(salted, rest)[np.minimum(pivot, first)]
            salt = low * salts >> 32
            beside = found >= 0
            shape = (beside[:, :_SIDE].sum(axis=1) * (_SIDE + 1) + beside[:, _SIDE + 1 :].sum(axis=1)).astype(np.uint8)
            beside[:, _SIDE] = False
            flat = found[beside].astype("<i4")
            ends = np.append(0, np.cumsum(beside.sum(axis=1)))
            cuts = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])))
            rows: dict[str, list] = {c: [] for c in ("pivot", "salt", "split", "shapes", "words", "numbers", "names")}
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=True):
                p, part = int(pivot[a]), flat[ends[a] : ends[b]]
                word = names[lang][p] if p < first else extra[p - first]
                far = np.unique(part[part >= first]) if extra else part[:0]
                if len(far):
                    part = np.where(part >= first, first + np.searchsorted(far, part), part).astype("<i4")
                rows["pivot"].append(word.decode(errors="replace"))
                rows["salt"].append(int(salt[a]))
                rows["split"].append(bool(salts[a] > 1))
                rows["shapes"].append(shape[a:b].tobytes())
                rows["words"].append(part.tobytes())
                rows["numbers"].append(b"" if (numbers[a:b] == 1).all() else numbers[a:b].astype("<i8").tobytes())
                rows["names"].append([extra[i - first].decode(errors="replace") for i in far.tolist()])
            for i in range(0, len(rows["pivot"]), 20_000):
                yield pd.DataFrame({"lang": lang} | {c: v[i : i + 20_000] for c, v in rows.items()})

    schema = "lang string, pivot string, salt int, split boolean, shapes binary, words binary, numbers binary, names array<string>"
    return map_batches(texts, route, schema)


def _names(dictionary: dict, first: int) -> dict:
    """By language: the words of the dictionary by id."""
    return {lang: {i: w for w, i in of.items()} for lang, of in dictionary.items()}


def _mined(routed: DataFrame, known: dict, first: int, least: int) -> DataFrame:
    """lang, phrase, words, n and split of the phrases of each pivot; those of whole pivots are frequent already."""
    shared = routed.sparkSession.sparkContext.broadcast(known)
    held: dict = {}

    def mine(rows):
        import numpy as np
        import pandas as pd

        if "names" not in held:
            held["names"], held["shapes"] = _names(shared.value, first), _shapes()
        out = []
        keys = rows["lang"].astype(object) + "\x00" + rows["pivot"] + "\x00" + rows["salt"].astype(str)
        run = pd.factorize(keys)[0]
        # A number of fragments at a time, and whole runs.
        rows = rows.assign(run=run, size=rows["shapes"].map(len)).sort_values("run", kind="stable")
        total = rows.groupby("run", sort=True)["size"].transform("sum")
        starts = rows["run"].ne(rows["run"].shift())
        portion = (total.where(starts, 0).cumsum() - total) // (1 << 18)
        for _, part in rows.groupby(portion, sort=False):
            out.append(_phrases(part, held["names"], held["shapes"], first, least))
        out = [o for o in out if len(o)]
        return pd.concat(out, ignore_index=True) if out else None

    task = routed.withColumn("task", F.xxhash64("lang", "pivot", "salt"))
    return by_sorted_key(task, "task", mine, "lang string, phrase string, words int, n long, split boolean")


def _phrases(rows, names: dict, shapes, first: int, least: int):
    """Count the phrases around the pivots of some whole runs."""
    import numpy as np
    import pandas as pd

    extra: dict[str, int] = {}
    words, numbers = [], []
    for w, own, k, size in zip(rows["words"], rows["names"], rows["numbers"], rows["size"], strict=True):
        ids = np.frombuffer(w, dtype="<i4")
        if len(own):
            to = np.array([extra.setdefault(x, first + len(extra)) for x in own], dtype=np.int32)
            ids = np.where(ids >= first, to[np.maximum(ids - first, 0)], ids)
        words.append(ids)
        numbers.append(np.frombuffer(k, dtype="<i8") if k else np.ones(size, dtype=np.int64))
    shape = np.frombuffer(b"".join(rows["shapes"]), dtype=np.uint8)
    found = np.full((len(shape), 2 * _SIDE + 1), -1, dtype=np.int64)
    found[shapes[shape]] = np.concatenate(words)
    number, run = np.concatenate(numbers), np.repeat(rows["run"].to_numpy(), rows["size"].to_numpy())
    by_run = rows.drop_duplicates("run").set_index("run")[["lang", "pivot", "split"]]
    split = by_run["split"].to_dict()
    langs, pivots = by_run["lang"].to_dict(), by_run["pivot"].to_dict()
    far = {i: w for w, i in extra.items()}
    out: list[tuple] = []
    for before in range(_SIDE + 1):
        for behind in range(0 if before else 1, _SIDE - before + 1):
            places = [p for p in range(_SIDE - before, _SIDE + behind + 1) if p != _SIDE]
            rows_in = np.flatnonzero((found[:, places[0]] >= 0) & (found[:, places[-1]] >= 0))
            if not len(rows_in):
                continue
            keys = [run[rows_in], *(found[rows_in, p] for p in places)]
            order, starts = _runs(keys)
            sums = np.add.reduceat(number[rows_in][order], starts)
            pick = order[starts]
            loose = np.array([split[r] for r in keys[0][pick].tolist()], dtype=bool)
            good = np.flatnonzero((sums >= least) | loose)
            for i in good.tolist():
                at = int(rows_in[pick[i]])
                r = int(run[at])
                own = names.get(langs[r], {})
                parts = [own[w].decode(errors="replace") if w < first else far[w] for w in found[at, places].tolist()]
                parts.insert(before, pivots[r])
                out.append((langs[r], " ".join(parts), len(parts), int(sums[i]), bool(loose[i])))
    return pd.DataFrame(out, columns=["lang", "phrase", "words", "n", "split"])


def _runs(keys: list):
    """(order, starts): an order that brings equal rows of several key columns together, and where they begin."""
    import numpy as np

    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) < 63:
        packed = np.zeros(len(keys[0]), dtype=np.int64)
        for k, b in zip(keys, bits, strict=True):
            packed = packed << b | k
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
        return order, np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    order = np.lexsort(keys)
    differ = np.zeros(len(order) - 1, dtype=bool)
    for k in keys:
        differ |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(np.append(True, differ))


def frequent_phrases(texts: DataFrame, counts: DataFrame, least: int = LEAST, dictionary: int = DICTIONARY, hot: int = HOT) -> DataFrame:
    """lang, phrase, words, n of the phrases of 2 to 4 words with n >= least; `counts` is the written word_counts."""
    often = counts.where(F.col("n") >= least)
    short = often.where(F.octet_length("word") <= WORD_BYTES)
    top = short.orderBy(F.desc("n"), "lang", "word").limit(dictionary).collect()
    complete = len(top) < dictionary and not often.where(F.octet_length("word") > WORD_BYTES).limit(1).count()
    known: dict[str, dict] = {}
    for i, r in enumerate(top):
        known.setdefault(r["lang"], {})[r["word"].encode()] = i
    limits = [-(-r["n"] // hot) for r in top]
    if not complete:
        # Words beyond the dictionary may be long and frequent ones; all share the salts of the most frequent.
        most = often.agg(F.max("n")).first()[0] or 1
        limits = limits or [1]
        limits = limits if max(limits) >= -(-most // hot) else [-(-most // hot), *limits[1:]]
    mined = materialize(_mined(_routed(texts, known, limits, complete, hot), known, len(limits), least))
    whole = mined.where("not split").select("lang", "phrase", "words", "n")
    summed = mined.where("split").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return whole.unionByName(summed)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **parameters) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of each language of a table (lang, text)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = materialize(word_counts(texts))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = materialize(frequent_phrases(texts, counts, least, **parameters))
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")).unionByName(
        counts.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    )
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - words)")})
    heads = parts.select(F.col("lang").alias("_lang"), F.col("part").alias("_part"), F.col("f").alias("l"))
    tails = parts.select(F.col("lang").alias("_lang"), F.col("part").alias("_part"), F.col("f").alias("r"))
    cuts = cuts.join(heads, (F.col("lang") == F.col("_lang")) & (F.col("head") == F.col("_part"))).drop("_lang", "_part")
    cuts = cuts.join(tails, (F.col("lang") == F.col("_lang")) & (F.col("tail") == F.col("_part"))).drop("_lang", "_part")
    exact = F.expr("cast(a as decimal(19, 0)) * 2000000 div (cast(l as decimal(19, 0)) + r)").cast("long")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    longer = _within(phrases.where("words > 2")).groupBy("lang", "part").agg(F.max("f").alias("longer"))
    longer = longer.withColumnRenamed("lang", "_lang")
    kept = scored.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("part")), "left")
    covered = F.expr("cast(longer as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * 80")
    kept = kept.where(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # A language may hold any share of the phrases: the best of slices of it meet, not all.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals) if totals.limit(1001).count() <= 1000 else totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _within(phrases: DataFrame) -> DataFrame:
    """lang, part, f: the phrases of two words and more inside longer ones, with the longer one's number."""
    words = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m))))")
    flat = phrases.select("lang", words.alias("w"), F.col("n").alias("f"), F.explode(spans).alias("s"))
    return flat.select("lang", F.array_join(F.slice("w", F.col("s.i"), F.col("s.m")), " ").alias("part"), "f")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), spans AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM pieces)
), f AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m >= 2 AND f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i : i + q - 1], ' ') AS part, a
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM cand WHERE m > 2))
), longer AS (SELECT lang, part, max(a) AS a FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase
  WHERE g.a IS NULL OR 100::HUGEINT * g.a < 80::HUGEINT * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""
