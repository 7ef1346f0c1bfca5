"""String operators as column expressions; Python only where a rule needs a scan with state."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no evidence of a topic.
STOPWORDS = (
    "the a an of and or in on for to is are was were what which who whom whose when where "
    "why how did do does many much with from by at as that this it its be been not no"
).split()
# Interrogatives and glue words that a note never repeats from a question.
QUESTION_WORDS = "what which who when where why how did does do is are was were 뭐 뭔가 무엇 누구 언제 어디 어디서 어떻게 왜 몇".split()
KOREAN_QUESTION_PREFIXES = "무엇 뭐 뭔 무슨 누구 누가 언제 어디 어떻 어떤 어느 얼마 왜".split()
KOREAN_GLUE = "함께 같이 위해 위한 대한 대해 있는 있던 되는 이후 당시 때문".split()
SINGLE_PARTICLES = "의은는이가를을에와과도만로써서던고기다지요며자게니"
# Substrings that flip a claim, and shapes of dates, which are no numbers.
NEGATIONS = ("않", "안 ", "없", "아니", "못 ", "금지", " not ", "n't", " no ", " never ")
DATE_SHAPE = r"\d{4}[-./년]\s?\d{1,2}[-./월]\s?\d{1,2}일?|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}년"
NUMBER = r"\d+(?:[.,]\d+)*"
WORD = "[a-z0-9가-힣]+"
CJK_RUN = "[가-힣]+|[ぁ-ヿ]+|[一-鿿]+"


def _array(words) -> Column:
    return F.array(*map(F.lit, words))


def all_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and Hangul, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_tokens(text: Column) -> Column:
    """The set of tokens longer than one character that are no stopwords."""
    kept = F.filter(all_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))
    return F.array_distinct(kept)


def coverage_tokens(query: Column) -> Column:
    """Content tokens that a note could repeat: no Korean interrogatives, no glue, no topic noun that ends a question."""
    furniture = lambda t: t.rlike("[가-힣]") & (t.rlike("^(" + "|".join(KOREAN_QUESTION_PREFIXES) + ")") | t.isin(*KOREAN_GLUE))
    kept = F.filter(content_tokens(query), lambda t: ~furniture(t))
    last = F.element_at(F.split(F.regexp_replace(F.rtrim(query), r"[?\s]+$", ""), r"\s+"), -1)
    topic = F.try_element_at(all_tokens(last), F.lit(-1))
    asked = F.rtrim(query).endswith("?") & topic.rlike("^.+[은는]$") & (F.length(topic) >= 2)
    return F.when(asked, F.array_remove(kept, topic)).otherwise(kept)


def covers(title: Column, query: Column) -> Column:
    """Every title token is a query token, up to two more characters at its end."""
    return F.forall(
        title, lambda t: F.exists(query, lambda q: (q == t) | (q.startswith(t) & (F.length(q) <= F.length(t) + 2)))
    )


def cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))


def _bigrams(run: Column) -> Column:
    spots = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    return F.filter(spots, lambda g: F.length(g) == 2)


def index_grams(text: Column) -> Column:
    """Every character and every pair of neighbours of CJK runs."""
    single = lambda r: F.filter(F.split(r, ""), lambda c: c != "")
    return F.flatten(F.transform(cjk_runs(text), lambda r: F.concat(single(r), _bigrams(r))))


def query_grams(text: Column) -> Column:
    """Pairs only, but the character itself for runs of one, and the noun of a pair that ends in a particle."""
    of = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
        F.concat(
            _bigrams(r),
            F.when((F.length(r) == 2) & F.substring(r, 2, 1).isin(*SINGLE_PARTICLES), F.array(F.substring(r, 1, 1))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )
    return F.flatten(F.transform(cjk_runs(text), of))


def query_terms(query: Column) -> Column:
    """At most 16 words and 48 grams of a query."""
    words = F.slice(F.filter(F.split(F.replace(query, F.lit('"'), F.lit("")), r"\s+"), lambda w: w != ""), 1, 16)
    return F.concat(F.flatten(F.transform(words, all_tokens)), F.slice(query_grams(F.array_join(words, " ")), 1, 48))


def is_keyword_query(query: Column) -> Column:
    """At most four words and no question word anywhere."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    return (F.size(words) <= 4) & ~F.exists(_array(QUESTION_WORDS), lambda q: F.contains(F.lower(query), q))


def numbers(text: Column) -> Column:
    """The set of numbers in a text, dates taken out first, thousands commas dropped."""
    found = F.regexp_extract_all(F.regexp_replace(text, DATE_SHAPE, " "), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def has_negation(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.exists(_array(NEGATIONS), lambda t: F.contains(padded, t))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def render_plain(markdown: Column) -> Column:
    """Text of a Markdown body: links become their labels, marks go, bullets become dashes."""
    steps = (
        (r"!?\[\[([^\]|#]+)(?:#[^\]|]*)?\|([^\]]+)\]\]", "$2"),
        (r"!?\[\[([^\]|#]+)(?:#[^\]]*)?\]\]", "$1"),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^>\s?", ""),
        (r"\*\*|__|`", ""),
        (r"(?m)^\s*[*+-]\s+", "- "),
        (r"\n{3,}", "\n\n"),
    )
    for pattern, to in steps:
        markdown = F.regexp_replace(markdown, pattern, to)
    return F.trim(markdown)


def snippet(text: Column, length: int = 150) -> Column:
    """Flattened start of a text, heading and rule lines left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(r"^(#{1,6}\s.*|-{3,}|\*{3,}|_{3,})?$"))
    return F.left(F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " ")), F.lit(length))


def sentences(text: Column, least: int = 8) -> Column:
    """Sentences of at least eight characters; ends are Latin marks, Korean endings with a dot, and line ends."""
    parts = F.split(text, r"(?<=[.!?])\s+|(?<=[다요죠음임함됨])\.\s*|\n+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" -•\t"))), lambda p: F.length(p) >= least)


def safe_name(title: Column, length: int = 80) -> Column:
    """A file name: no path or control characters, single spaces."""
    clean = F.regexp_replace(title, r"[\\/:*?\"<>|#^\[\]\x00-\x1f]+", " ")
    return F.left(F.trim(F.regexp_replace(clean, r"\s+", " ")), F.lit(length))


def kebab(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9가-힣]+", "-"), F.lit("-"))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cache_key(model: str, dims: int, task: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}|{dims}|{task}|"), text).cast("binary"), 256)


def approx_model_tokens(text: Column) -> Column:
    """1.6 for every CJK character and a quarter for every other one."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, "[가-힣ぁ-ヿ一-鿿]", ""))
    return cjk * F.lit(1.6) + (F.length(text) - cjk) * F.lit(0.25)


def normalized_answer(text: Column) -> Column:
    """Lower case, no articles, no punctuation, single spaces."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", " ")
    clean = F.regexp_replace(clean, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(clean, r"\s+", " "))


# Words that ask for all of something or for a number, auxiliaries, and in Korean words of their own,
# heads with what follows them, and the plural mark with its particles and the predicates behind them.
QUANTIFIERS = ("all", "every", "each", "list", "besides", "apart from", "other than", "how many", "how often", "how much", "what are", "what were", "which are", "which were")
AUXILIARIES = ("does", "has", "is", "was", "kind", "sort")
KOREAN_ALL = ("모두", "전부", "뭐들")
KOREAN_HEADS = {"몇": ("개", "번", "명", "권", "가지"), "얼마나": ("자주", "많이"), "어떤": ("것들",)}
KOREAN_PLURAL, KOREAN_PARTICLES, KOREAN_PREDICATES = "들", ("", "을", "이", "은", "도"), ("있", "했", "말했", "언급", "뭐", "무엇")


def let(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def says(text: Column, phrases) -> Column:
    """Whether a lower-case text holds one of the phrases: Latin ones as whole words, others anywhere, with or without the spaces inside them."""
    latin = [f" {p} " for p in phrases if p.isascii()]
    apart = [p.replace(" ", "") for p in phrases if not p.isascii() and " " in p]
    whole = [p for p in phrases if not p.isascii() and " " not in p]
    spoken = F.concat(F.lit(" "), F.regexp_replace(text, r"\W+", " "), F.lit(" "))
    some = lambda where, parts: let(where, lambda t: F.exists(_array(parts), lambda p: F.contains(t, p))) if parts else F.lit(False)
    return some(spoken, latin) | some(squash(text), apart) | some(text, whole)


def is_enumeration(query: Column) -> Column:
    """Questions whose answer is a list or a count.

    They hold a quantifier; or open with what or which and a plural noun (four letters and more, one s at its end)
    within the next three words, none of them an auxiliary; or, in Korean, a head with one of its companions, or a
    plural mark whose particle is followed by a predicate.
    """
    low = F.lower(F.trim(query))
    korean = [*KOREAN_ALL, *(f"{head} {tail}" for head, tails in KOREAN_HEADS.items() for tail in tails)]
    korean += [f"{KOREAN_PLURAL}{p} {v}" for p in KOREAN_PARTICLES for v in KOREAN_PREDICATES]
    words = F.filter(F.split(F.regexp_replace(low, r"[^\w\s']+", " "), r"\s+"), lambda w: w != "")
    opens = F.element_at(F.concat(words, F.array(F.lit(""))), 1).isin("what", "which")
    plain = lambda i: ~F.coalesce(F.get(words, i), F.lit("")).isin(*AUXILIARIES)
    noun = lambda i: F.coalesce(F.get(words, i), F.lit("")).rlike(r"^\w{2,}[^s\W]s$")
    plural = F.lit(False)
    for i in (1, 2, 3):
        before = F.lit(True)
        for j in range(1, i + 1):
            before &= plain(j)
        plural |= before & noun(i)
    return says(low, QUANTIFIERS) | (opens & plural) | says(low, korean)


def adaptive_k(query: Column, k: int, multiplier: float = 2.0, cap: int = 24) -> Column:
    wide = F.least(F.lit(cap), F.greatest(F.lit(k), F.bround(F.lit(k * multiplier)).cast("int")))
    return F.when(is_enumeration(query), wide).otherwise(F.lit(k)) if multiplier > 1 else F.lit(k)


def jamo(text: str, open_last: bool = False) -> str:
    """Hangul syllables taken apart into conjoining letters by code-point arithmetic; white space dropped."""
    import unicodedata

    parts = unicodedata.normalize("NFD", "".join(text.split()))
    if open_last and text and "가" <= text[-1] <= "힣" and (ord(text[-1]) - 0xAC00) % 28:
        parts = parts[:-1]
    return parts


@F.pandas_udf(T.StringType())
def letters(text: pd.Series, open_last: pd.Series) -> pd.Series:
    """Texts with their Hangul taken apart (see `jamo`)."""
    return pd.Series([jamo(t or "", bool(o)) for t, o in zip(text, open_last, strict=True)], dtype=object)


def osa_distances(a: list[str], b: list[str]):
    """Edit distances with swaps of neighbours (optimal string alignment) of pairs of words; all pairs of a cell at once."""
    import numpy as np

    def codes(words: list[str]):
        size = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros((len(words), int(size.max(initial=0))), dtype=np.uint32)
        out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return out.T, size

    (x, n), (y, m) = codes(a), codes(b)
    cost = np.empty((len(x) + 1, len(y) + 1, len(a)), dtype=np.int32)
    cost[:, 0], cost[0] = np.arange(len(x) + 1)[:, None], np.arange(len(y) + 1)[:, None]
    for i, j in np.ndindex(len(x), len(y)):
        cheapest = np.minimum(np.minimum(cost[i, j + 1], cost[i + 1, j]) + 1, cost[i, j] + (x[i] != y[j]))
        if i and j:
            turned = (x[i] == y[j - 1]) & (x[i - 1] == y[j])
            cheapest = np.where(turned, np.minimum(cheapest, cost[i - 1, j - 1] + 1), cheapest)
        cost[i + 1, j + 1] = cheapest
    return cost[n, m, np.arange(len(a))]


def osa_distance(a: str, b: str, cap: int) -> int:
    """The distance of one pair; cap + 1 if it is larger."""
    return min(int(osa_distances([a], [b])[0]), cap + 1)


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series, cap: pd.Series) -> pd.Series:
    """Distances of pairs up to their caps, cap + 1 beyond; words whose lengths differ by more are not compared."""
    out = cap + 1
    close = ((a.str.len() - b.str.len()).abs() <= cap).to_numpy().nonzero()[0]
    for at in range(0, len(close), 1024):
        some = close[at : at + 1024]
        found = osa_distances(a.iloc[some].tolist(), b.iloc[some].tolist())
        out.iloc[some] = pd.Series(found).clip(upper=out.iloc[some].reset_index(drop=True)).to_numpy()
    return out.astype("int32")


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """English stems of tokens, a distinct token once a batch; other tokens as they are."""
    codes, distinct = pd.factorize(words)
    return pd.Series([english_stem(w) for w in distinct], dtype=object).take(codes).reset_index(drop=True)


def _kinds(stem: str) -> str:
    """v for vowels and for y behind a consonant, c for everything else."""
    kinds = ""
    for c in stem:
        kinds += "v" if c in "aeiou" or (c == "y" and kinds.endswith("c")) else "c"
    return kinds


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    return _kinds(stem).count("vc")


def _is_short(stem: str) -> bool:
    """Whether a word ends in a consonant, a vowel and a consonant other than w, x and y."""
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


_STEP_TWO = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_TWO, _STEP_THREE = (dict(sorted(s.items(), key=lambda x: -len(x[0]))) for s in (_STEP_TWO, _STEP_THREE))
_STEP_FOUR = "ement ment ance ence able ible ant ent ism ate iti ous ive ize al er ic ou".split()
#: How words end that a step may change; all others are stems already.
_CHANGING = ("e", "s", "y", "ed", "ing", "al", "ul", "ll", "ci", "li", "ti", "er", "or", "on", "sm", "nt", "ic", "ou")


def _swap(word: str, endings: dict[str, str], least: int) -> str:
    """The longest of the endings, which are given longest first, replaced."""
    for end in endings:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + endings[end] if _measure(stem) > least else word
    return word


def english_stem(word: str) -> str:
    """Porter's suffix stripping (1980) for lower-case words of three letters and more; other scripts have no such suffixes."""
    if len(word) < 3 or not word.endswith(_CHANGING):
        return word
    vowel = lambda stem: "v" in _kinds(stem)
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            stem = word[: -len(end)]
            if word.endswith(end) and vowel(stem):
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif re.search(r"([^aeioulsz])\1$", stem):
                    word = stem[:-1]
                elif _measure(stem) == 1 and _is_short(stem):
                    word = stem + "e"
                else:
                    word = stem
                break
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP_TWO, 0), _STEP_THREE, 0)
    for end in _STEP_FOUR:
        if word.endswith(end):
            word = word[: -len(end)] if _measure(word[: -len(end)]) > 1 else word
            break
    else:
        if word.endswith(("sion", "tion")) and _measure(word[:-3]) > 1:
            word = word[:-3]
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _is_short(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
