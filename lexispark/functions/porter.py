"""The 1980 Porter stemmer: one form for Python, one written as SQL expressions.

Letters are judged on a word in which consonantal y is marked ``Y`` once, before the first step.
"""

from __future__ import annotations

import re

# Fixed values of the published algorithm, in its order: suffix and what replaces it.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Measure above 0, above 1 and exactly 1; a vowel; consonant, vowel, consonant that is not w, x or y.
M_GT_0 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
M_GT_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
M_EQ_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$"
VOWEL = "[aeiouy]"
CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"
_PAIRS = [c + c for c in "bcdfghjkmnpqrtvwx0123456789"] + ["yY"]
DOUBLE = f"({'|'.join(_PAIRS)})$"

_gt0, _gt1, _eq1, _vowel, _cvc, _double = (re.compile(p) for p in (M_GT_0, M_GT_1, M_EQ_1, VOWEL, CVC, DOUBLE))
_memory: dict[str, str] = {}
_MEMORY_WORDS = 500_000


def mark(word: str) -> str:
    """Consonantal y as Y: at the start, after a vowel, and after a y that is a vowel."""
    out: list[str] = []
    for c in word:
        out.append("Y" if c == "y" and (not out or out[-1] in "aeiouy") else c)
    return "".join(out)


def _replaced(w: str, rules: tuple[tuple[str, str], ...]) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + new if _gt0.search(base) else w
    return w


def _without_past_or_participle(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _gt0.search(w[:-3]) else w
    base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
    if base is None or not _vowel.search(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _double.search(base):
        return base[:-1]
    if base.endswith(("ll", "ss", "zz")):
        return base
    return base + "e" if _eq1.search(base) and _cvc.search(base) else base


def stem_once(word: str) -> str:
    if len(word) <= 2:
        return word
    w = mark(word)
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    w = _without_past_or_participle(w)
    if w[-1:] in ("y", "Y") and _vowel.search(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2), STEP3)
    for suffix in STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            w = base if _gt1.search(base) else w
            break
    else:
        if w.endswith(("sion", "tion")) and _gt1.search(w[:-3]):
            w = w[:-3]
    if w.endswith("e"):
        base = w[:-1]
        if _gt1.search(base) or _eq1.search(base) and not _cvc.search(base):
            w = base
    if w.endswith("ll") and _gt1.search(w):
        w = w[:-1]
    return w.lower()


def stem(word: str) -> str:
    """Stem of a lower-case word; words seen before cost a lookup."""
    found = _memory.get(word)
    if found is None:
        if len(_memory) >= _MEMORY_WORDS:
            _memory.clear()
        found = _memory[word] = stem_once(word)
    return found


def sql_steps(duckdb: bool = False) -> list[str]:
    """Expressions over ``w`` to be applied one after the other to a lower-case word; they give its stem.

    A word of at most two letters carries a leading ``=`` from the first step to the last, which keeps it as it is.
    """

    def like(x: str, p: str) -> str:
        return f"regexp_matches({x}, '{p}')" if duckdb else f"({x} RLIKE '{p}')"

    def ends(s: str) -> str:
        return f"suffix(w, '{s}')" if duckdb else f"endswith(w, '{s}')"

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})" if duckdb else f"substring(w, 1, length(w) - {n})"

    def sub(x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, '{p}', '{r}', 'g')" if duckdb else f"regexp_replace({x}, '{p}', '{r}')"

    group = r"\1" if duckdb else "$1"
    marked = sub(sub(sub("w", "^y", "Y"), "([aeiou])y", f"{group}Y"), "yy", "yY")

    def rules(table: tuple[tuple[str, str], ...], measure: str) -> str:
        return " ".join(f"WHEN {ends(s)} THEN CASE WHEN {like(cut(len(s)), measure)} THEN concat({cut(len(s))}, '{r}') ELSE w END" for s, r in table)

    short = "WHEN w LIKE '=%' THEN w"
    return [
        f"CASE WHEN length(w) <= 2 THEN concat('=', w) ELSE {marked} END",
        f"CASE {short} WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {cut(1)} ELSE w END",
        f"CASE {short} WHEN {ends('eed')} THEN CASE WHEN {like(cut(3), M_GT_0)} THEN {cut(1)} ELSE w END"
        f" WHEN {ends('ed')} THEN CASE WHEN {like(cut(2), VOWEL)} THEN concat({cut(2)}, '#') ELSE w END"
        f" WHEN {ends('ing')} THEN CASE WHEN {like(cut(3), VOWEL)} THEN concat({cut(3)}, '#') ELSE w END ELSE w END",
        f"CASE WHEN NOT {ends('#')} THEN w WHEN {ends('at#')} OR {ends('bl#')} OR {ends('iz#')} THEN concat({cut(1)}, 'e')"
        f" WHEN {like(cut(1), DOUBLE)} THEN {cut(2)} WHEN {like('w', '(ll|ss|zz)#$')} THEN {cut(1)}"
        f" WHEN {like(cut(1), M_EQ_1)} AND {like(cut(1), CVC)} THEN concat({cut(1)}, 'e') ELSE {cut(1)} END",
        f"CASE {short} WHEN {like('w', '[yY]$')} AND {like(cut(1), VOWEL)} THEN concat({cut(1)}, 'i') ELSE w END",
        f"CASE {short} {rules(STEP2, M_GT_0)} ELSE w END",
        f"CASE {short} {rules(STEP3, M_GT_0)} ELSE w END",
        f"CASE {short} {rules(tuple((s, '') for s in STEP4), M_GT_1)} WHEN ({ends('sion')} OR {ends('tion')}) AND {like(cut(3), M_GT_1)} THEN {cut(3)} ELSE w END",
        f"CASE {short} WHEN {ends('e')} AND ({like(cut(1), M_GT_1)} OR ({like(cut(1), M_EQ_1)} AND NOT {like(cut(1), CVC)})) THEN {cut(1)} ELSE w END",
        f"CASE {short} WHEN {ends('ll')} AND {like('w', M_GT_1)} THEN {cut(1)} ELSE w END",
        f"CASE {short.replace('THEN w', 'THEN substr(w, 2)')} ELSE lower(w) END",
    ]
