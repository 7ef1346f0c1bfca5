"""The tokens of full text: case and marks folded over all scripts, English stems, CJK grams, and the terms of queries.

One pass in Arrow batches, shared by what is indexed and what is asked, so that both always agree.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx

#: Words of a query that are looked up, and grams beside them, where a search is not asked for whole queries.
MOST_WORDS, MOST_GRAMS = 16, 48
#: Stems that a worker remembers.
_REMEMBERED = 200_000
TERMS = T.ArrayType(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("gram", T.BooleanType())]))
_TOKEN = re.compile(r"[^\W_]+")
_CJK = re.compile(tx.CJK_RUN)
_ANY_CJK = re.compile("[" + tx.CJK_RUN.replace("]+|[", "").strip("[]+") + "]")
#: Characters beyond which a text's marks are found in one table instead of one by one.
_LONG = 64
_stems: dict[str, str] = {}


def fold(text: str) -> str:
    """Lower case without marks: letters of any script lose their accents, Hangul syllables stay whole."""
    low = text.lower()
    if low.isascii():
        return low
    apart = unicodedata.normalize("NFD", low)
    if len(apart) < _LONG:
        return unicodedata.normalize("NFC", "".join(c for c in apart if unicodedata.category(c)[0] != "M"))
    codes = np.frombuffer(apart.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return unicodedata.normalize("NFC", codes[~_marks()[codes]].tobytes().decode("utf-32-le", "surrogatepass"))


@cache
def _marks() -> np.ndarray:
    """Whether a code point is a mark."""
    return np.array([unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)])


def stem(token: str) -> str:
    found = _stems.get(token)
    if found is None:
        if len(_stems) >= _REMEMBERED:
            _stems.clear()
        found = _stems[token] = tx.english_stem(token)
    return found


def words(text: str | None, stems: bool = True) -> list[str]:
    """Runs of letters and digits, folded, in order; with `stems` reduced to their stems."""
    found = _TOKEN.findall(fold(text or ""))
    return [*map(stem, found)] if stems else found


def grams(text: str | None) -> list[str]:
    """Every character and every pair of neighbours of CJK runs, as they are indexed beside the words."""
    out: list[str] = []
    if not text or text.isascii() or not _ANY_CJK.search(text):
        return out
    for run in _CJK.findall(text):
        out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return out


def indexed(text: str | None, stems: bool = True) -> list[str]:
    """The words of a field and the grams behind them; places count through both."""
    return words(text, stems) + grams(text)


def coded(values: Iterable[str | None], stems: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `indexed` gives of many texts: a code for every place of all of them, places a text, and the term of each code.

    A distinct token is reduced once.
    """
    found: list[str] = []
    sizes = []
    for value in values:
        before = len(found)
        found += indexed(value, False)
        sizes.append(len(found) - before)
    code, terms = pd.factorize(np.array(found, dtype=object))
    if stems:
        again, terms = pd.factorize(np.array([stem(t) for t in terms], dtype=object))
        code = again[code]
    return code, np.array(sizes, dtype=np.int64), terms


def asked(query: str | None, stems: bool = True, whole: bool = True) -> tuple[list[tuple[str, ...]], list[str]]:
    """(phrases, grams) of a query: each word of it is a phrase of the tokens it holds, of which most hold one.

    All of its words, or with `whole` false the first `MOST_WORDS`.
    """
    parts = (query or "").replace('"', "").split()
    parts = parts if whole else parts[:MOST_WORDS]
    phrases = dict.fromkeys(tuple(words(w, stems)) for w in parts)
    phrases.pop((), None)
    extra: dict[str, None] = {}
    for run in _CJK.findall(" ".join(parts)):
        found = [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        if len(run) == 2 and run[1] in tx.SINGLE_PARTICLES:
            found.append(run[0])
        extra |= dict.fromkeys(found)
    known = {p[0] for p in phrases if len(p) == 1}
    return list(phrases), [g for g in (extra if whole else [*extra][:MOST_GRAMS]) if g not in known]


def query_terms(queries: Column, stems: bool, whole: bool) -> Column:
    """What queries look up: phrases of one token and more, and grams."""

    @F.pandas_udf(TERMS)
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([_terms(q, stems, whole) for q in texts])

    return terms(queries)


def _terms(query: str | None, stems: bool, whole: bool) -> list[dict]:
    phrases, extra = asked(query, stems, whole)
    return [{"tokens": list(p), "gram": False} for p in phrases] + [{"tokens": [g], "gram": True} for g in extra]


@F.pandas_udf(T.StringType())
def folded_stem(tokens: pd.Series) -> pd.Series:
    """The term of the index under which a single token is counted; null for what holds none."""
    codes, distinct = pd.factorize(tokens)
    terms = [(words(t) or [None])[0] for t in distinct]
    return pd.Series([None if c < 0 else terms[c] for c in codes], dtype=object)


@F.pandas_udf(T.StringType())
def folded(tokens: pd.Series) -> pd.Series:
    """The same in an index without stems."""
    codes, distinct = pd.factorize(tokens)
    terms = [(words(t, False) or [None])[0] for t in distinct]
    return pd.Series([None if c < 0 else terms[c] for c in codes], dtype=object)


# So that no filter on the terms is worked out below a `distinct`, once for each token instead of once for each distinct one.
folded_stem, folded = folded_stem.asNondeterministic(), folded.asNondeterministic()
