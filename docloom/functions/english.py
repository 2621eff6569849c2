"""English text for search: words without stop words, their stems, and queries as people type them."""

from __future__ import annotations

import re
from functools import lru_cache

#: The English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: The published English (Porter 2) stemmer's exceptions, doubles and suffixes.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_VOWEL = "[aeiouy]"
WORDS = re.compile(r"[^\W_]+")
#: Compiled once, as stemming takes most of an analysis.
_VOWELS, _BORDER, _Y = re.compile(_VOWEL), re.compile(f"{_VOWEL}[^aeiouy]"), re.compile(f"(^|{_VOWEL})y")
_SHORT, _SHORT_WORD, _OWNERS = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$"), re.compile(r"[aeiouy][^aeiouy]"), re.compile("('s'|'s|')$")
_PLURAL, _PAST, _ENDS_2, _ENDS_3, _ENDS_4 = ("sses", "ied", "ies", "us", "ss", "s"), ("eedly", "eed", "ingly", "edly", "ing", "ed"), (*_STEP_2, "ogi", "li"), (*_STEP_3, "ative"), (*_STEP_4, "ion")


def _regions(w: str) -> tuple[int, int]:
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if start is None:
        first = _BORDER.search(w)
        start = first.end() if first else len(w)
    later = _BORDER.search(w[start:])
    return start, start + later.end() if later else len(w)


def _short_end(w: str) -> bool:
    return bool(_SHORT.search(w) or _SHORT_WORD.fullmatch(w))


def _longest(w: str, suffixes: tuple[str, ...]) -> str:
    return "" if not w.endswith(suffixes) else max((s for s in suffixes if w.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word by the Porter 2 algorithm."""
    w = word
    if len(w) < 3:
        return w
    w = w.removeprefix("'")
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _KEPT:
        return w
    if "y" in w:
        w = _Y.sub(lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = _OWNERS.sub("", w)
    # plurals
    s = _longest(w, _PLURAL)
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[: -2 if len(w) > 4 else -1]
    elif s == "s" and _VOWELS.search(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # past and continuous forms
    s = _longest(w, _PAST)
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and _VOWELS.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _longest(w, _ENDS_2)
    if s and len(w) - len(s) >= r1:
        if s in _STEP_2:
            w = w[: -len(s)] + _STEP_2[s]
        elif (s == "ogi" and w[-4:-3] == "l") or (s == "li" and w[-3:-2] in tuple("cdeghkmnrt")):
            w = w[:-1] if s == "ogi" else w[:-2]
    s = _longest(w, _ENDS_3)
    if s and len(w) - len(s) >= r1:
        if s != "ative":
            w = w[: -len(s)] + _STEP_3[s]
        elif len(w) - len(s) >= r2:
            w = w[: -len(s)]
    s = _longest(w, _ENDS_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def analysed(text: str) -> list[tuple[str, int]]:
    """(lexeme, position) of each word that is no stop word; stop words take up positions."""
    words = WORDS.findall(text.lower())
    return [(stem(w), i) for i, w in enumerate(words, 1) if w not in STOP_WORDS]


@lru_cache(512)
def parsed(text: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """parse_query(), remembered; not to be changed."""
    return parse_query(text)


def parse_query(text: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """Alternatives (between OR) of conditions (all must hold): whether wanted, and lexemes with their places in a phrase.

    Quotes hold a phrase, a leading minus excludes; what has only stop words asks for nothing.
    """
    out: list[list] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', text):
        if m[3] and m[3].lower() == "or":
            out.append([])
            continue
        minus, words = (m[1], m[2]) if m[3] is None else ("-" if m[3].startswith("-") else "", m[3].lstrip("-"))
        terms = analysed(words)
        if terms:
            out[-1].append((not minus, [(t, at - terms[0][1]) for t, at in terms]))
    return [x for x in out if x]


def _starts(term: list[tuple[str, int]], places: dict[str, list[int]]) -> list[int]:
    """Where a phrase begins."""
    rest = [(set(places.get(t, ())), at) for t, at in term[1:]]
    return [p for p in places.get(term[0][0], ()) if all(p + at in s for s, at in rest)]


def matches(query: list, places: dict[str, list[int]]) -> bool:
    return any(all(bool(_starts(term, places)) == wanted for wanted, term in conditions) for conditions in query)


def cover_density(query: list, places: dict[str, list[int]], weight: float = 0.1) -> float:
    """The sum over all minimal stretches that satisfy an alternative: weight, divided by one more than the places in them that are no query words."""
    wanted = {t for conditions in query for want, term in conditions if want for t, _ in term}
    spots = sorted((p, t) for t in wanted for p in places.get(t, ()))
    total, covers = 0.0, set()
    for conditions in query:
        terms = [term for want, term in conditions if want]
        if not terms or not all(bool(_starts(term, places)) == want for want, term in conditions):
            continue
        ends = [sorted((a, a + term[-1][1]) for a in _starts(term, places)) for term in terms]
        found = []
        for a in sorted({a for e in ends for a, _ in e}):
            later = [next((e for s, e in each if s >= a), None) for each in ends]
            if None not in later:
                found.append((a, max(later)))
        covers |= {(a, b) for a, b in found if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in found)}
    for a, b in covers:
        inside = len({p for p, _ in spots if a <= p <= b})
        total += weight / (1 + max(0, b - a + 1 - inside))
    return total
