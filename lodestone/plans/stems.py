"""Porter's suffix stripping as DuckDB SQL, stated by regular expressions of measures: what stemmed indexes are compared with."""

from __future__ import annotations

_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_HAS_VOWEL = f"^({_C})?[aeiouy]"
_OVER_0 = f"^({_C})?{_V}{_C}"
_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
_OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
# Endings of the second to the fourth step and what replaces them.
_TWO = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_THREE = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_FOUR = "ement ment ance ence able ible ant ent ism ate iti ous ive ize al er ic ou"


def _longest(pairs: list[tuple[str, str]], measure: str) -> str:
    """CASE of the longest ending of s: replaced if what stands before it fits the measure."""
    whens = [
        f"WHEN s LIKE '%{end}' THEN CASE WHEN regexp_matches(left(s, length(s) - {len(end)}), '{measure}') THEN left(s, length(s) - {len(end)}) || '{to}' ELSE s END"
        for end, to in sorted(pairs, key=lambda p: -len(p[0]))
    ]
    return f"CASE {' '.join(whens)} ELSE s END"


def stem_ctes(words: str) -> str:
    """CTEs that end in `stems` (w, stem) for the distinct column w of the CTE `words`."""
    cut = lambda n: f"left(s, length(s) - {n})"
    two, three = ([tuple(p.split(":")) for p in t.split()] for t in (_TWO, _THREE))
    ending = "'(ed|ing)$'"
    bare = f"regexp_replace(s, {ending}, '')"
    four = _longest([(e, "") for e in _FOUR.split()], _OVER_1)
    ion = f"WHEN regexp_matches(s, '(sion|tion)$') THEN CASE WHEN regexp_matches({cut(3)}, '{_OVER_1}') THEN {cut(3)} ELSE s END ELSE s END"
    return f"""
  p0 AS (SELECT w, CASE WHEN w LIKE 'y%' THEN 'Y' || substr(w, 2) ELSE w END AS s FROM {words} WHERE length(w) >= 3),
  p1 AS (SELECT w, CASE WHEN s LIKE '%sses' OR s LIKE '%ies' THEN {cut(2)} WHEN s LIKE '%ss' THEN s WHEN s LIKE '%s' THEN {cut(1)} ELSE s END AS s FROM p0),
  p2 AS (SELECT w, s, s NOT LIKE '%eed' AND regexp_matches(s, {ending}) AND regexp_matches({bare}, '{_HAS_VOWEL}') AS bared,
    CASE WHEN s LIKE '%eed' THEN CASE WHEN regexp_matches({cut(3)}, '{_OVER_0}') THEN {cut(1)} ELSE s END ELSE {bare} END AS t FROM p1),
  p3 AS (SELECT w, CASE WHEN s LIKE '%eed' THEN t WHEN NOT bared THEN s
    WHEN regexp_matches(t, '(at|bl|iz)$') THEN t || 'e'
    WHEN length(t) > 1 AND t[-1] = t[-2] AND regexp_matches(t, '[^aeioulsz]$') THEN left(t, length(t) - 1)
    WHEN regexp_matches(t, '{_SHORT}') THEN t || 'e' ELSE t END AS s FROM p2),
  p4 AS (SELECT w, CASE WHEN s LIKE '%y' AND regexp_matches({cut(1)}, '{_HAS_VOWEL}') THEN {cut(1)} || 'i' ELSE s END AS s FROM p3),
  p5 AS (SELECT w, {_longest(two, _OVER_0)} AS s FROM p4),
  p6 AS (SELECT w, {_longest(three, _OVER_0)} AS s FROM p5),
  p7 AS (SELECT w, {four.removesuffix("ELSE s END")} {ion} AS s FROM p6),
  p8 AS (SELECT w, CASE WHEN s LIKE '%e' AND (regexp_matches({cut(1)}, '{_OVER_1}') OR (regexp_matches({cut(1)}, '{_IS_1}') AND NOT regexp_matches({cut(1)}, '{_SHORT}'))) THEN {cut(1)} ELSE s END AS s FROM p7),
  p9 AS (SELECT w, CASE WHEN s LIKE '%ll' AND regexp_matches({cut(1)}, '{_OVER_1}') THEN {cut(1)} ELSE s END AS s FROM p8),
  stems AS (SELECT w, CASE WHEN s LIKE 'Y%' THEN 'y' || substr(s, 2) ELSE s END AS stem FROM p9 UNION ALL SELECT w, w FROM {words} WHERE length(w) < 3)"""
