"""Keyword and title matching, compiled to regular expressions on the driver and run by the JVM.

Criteria are configuration, so each becomes one pattern over normalised text; rows never pass through Python but for
accent folding of texts that are not ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import let
from .text import normalize_text, strip_accents

# fixed values: shortest word with plurals, shortest compound, stems that take -es, words that are no plurals,
# words that as keywords stand for an acronym
LEAST_PLURAL, LEAST_COMPOUND = 3, 5
ES_STEMS = ("s", "x", "z", "ch", "sh", "o")
NOT_PLURALS = ("news", "goods")
ACRONYMS = ("it", "us", "in", "on", "or", "as", "at", "an", "am", "is", "be", "do", "go", "me", "my", "no", "so", "to", "up", "we", "he", "if", "by", "of", "ok", "hi", "id")
# fixed values: filler words of titles, title aliases, words before and after a title that make it another role
FILLERS = ("of", "the", "and", "for")
TITLE_ALIASES = {
    "ceo": ("chief executive officer", "chief executive"), "cfo": ("chief financial officer", "chief finance officer"),
    "cto": ("chief technology officer", "chief technical officer"), "coo": ("chief operating officer", "chief operations officer"),
    "cmo": ("chief marketing officer",), "cro": ("chief revenue officer",),
    "chro": ("chief human resources officer", "chief human resource officer", "chief hr officer"),
    "cpo": ("chief people officer", "chief product officer"), "cio": ("chief information officer",), "ciso": ("chief information security officer",),
    "vp": ("vice president", "vice pres", "v p"), "senior vp": ("senior vice president", "svp"), "executive vp": ("executive vice president", "evp"),
    "avp": ("assistant vice president",), "human resources": ("human resource", "hr"), "talent acquisition": ("ta",),
    "managing director": ("md",), "general manager": ("gm",), "director": ("dir",), "manager": ("mgr", "mngr"), "senior": ("sr", "snr"),
    "junior": ("jr",), "operations": ("ops",), "assistant": ("asst",), "executive": ("exec",), "marketing": ("mktg",),
    "co founder": ("cofounder",), "business development": ("biz dev", "bizdev"),
}
OTHERS_BEFORE = ("former", "ex", "previous", "past", "retired", "deputy", "vice", "assistant", "associate")
OTHERS_AFTER = ("possessive", "associate", "associates", "assistant", "assistants", "office")
# fixed values: words that lead from a title to its place, and, before a boss or an office's head, to whom it belongs
PLACE_CUES = (("at",), ("@",), ("to", "the"), ("for", "the"), ("reporting", "to"), ("reports", "to"), ("reporting", "directly", "to"), ("reports", "directly", "to"))
BOSSES = ("ceo", "cfo", "coo", "cto", "cmo", "cro", "md", "founder", "founders", "president", "chairman", "chief")
HEADS = (*BOSSES, "chair", "managing")
#: Each cue as the words allowed at each of its places.
CUES = [tuple((w,) for w in cue) for cue in PLACE_CUES] + [(("to",), BOSSES), (("office",), ("of",), HEADS), (("office",), ("of",), ("the",), HEADS)]


def _spelt(cue: tuple[tuple[str, ...], ...]) -> str:
    """A cue as a pattern; a cue of one word needs another word after it."""
    words = [f"(?:{'|'.join(map(re.escape, allowed))})" for allowed in cue]
    return r"[\s,]+".join(words) + (r"(?=\s+\S)" if len(cue) == 1 else r"(?![\w@])")


#: What stands from a title's first cue on; a cue at the very start is part of the title.
CONTEXT = rf"(?<=\S)[\s,]+(?:{'|'.join(map(_spelt, CUES))}).*$"


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", _fold(text).lower())


def forms(word: str) -> list[str]:
    """The words that count as equal to this one: itself, its plurals and its singulars."""
    out = [word]
    plurals = [word + "s"] + [word + "es"] * word.endswith(ES_STEMS) + [word[:-1] + "ies"] * word.endswith("y")
    if len(word) >= LEAST_PLURAL:
        out += [p for p in plurals if p not in NOT_PLURALS]
    if word not in NOT_PLURALS:
        single = [word[:-1]] * word.endswith("s") + [word[:-2]] * (word.endswith("es") and word[:-2].endswith(ES_STEMS)) + [word[:-3] + "y"] * word.endswith("ies")
        out += [s for s in single if len(s) >= LEAST_PLURAL]
    return list(dict.fromkeys(out))


def _run(words: list[str]) -> str:
    return " ".join(f"(?:{'|'.join(forms(w))})" for w in words)


def mentions(padded: Column, words: list[str], guard: tuple[str, str] = ("", "")) -> Column:
    """Does normalised text with a blank at both ends hold these words in a row, or one compound of the same letters?

    The compound may be cut into at most two more words than were asked for.
    """
    before, after = guard
    found = padded.rlike(f"{before} {_run(words)}(?= ){after}")
    whole = "".join(words)
    if len(whole) < LEAST_COMPOUND:
        return found
    spread = "|".join(" ?".join(f) for f in forms(whole))
    pieces = F.regexp_extract_all(padded, F.lit(f"{before} ({spread})(?= ){after}"), F.lit(1))
    return found | F.exists(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) <= len(words) + 1)


def _capitals(keyword: str, words: list[str]) -> list[bool]:
    """Which words of a keyword must stand in capitals: an acronym by itself, or one in capitals in a mixed phrase."""
    raw = re.findall("[A-Za-z0-9]+", _fold(keyword))
    mixed = any(r.isalpha() and not r.isupper() for r in raw)
    return [w in ACRONYMS and (len(words) == 1 or (r.isupper() and mixed)) for w, r in zip(words, raw, strict=True)]


def keyword_match(c: Column, keywords: list[str]) -> Column:
    """The first keyword, in the given order, that the text mentions as whole words; null if none.

    Case, accents, punctuation and plain plurals do not matter; "IT" and its like match capitals only.
    """
    norm = normalize_text(c)
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    cased = F.trim(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9]+", " "))
    found = []
    for keyword in keywords:
        if not (words := words_of(keyword)):
            continue
        test = mentions(padded, words)
        if any(strict := _capitals(keyword, words)):
            run = " ".join(w.upper() if s else f"(?i:{'|'.join(forms(w))})" for w, s in zip(words, strict, strict=True))
            test = F.when(F.lower(cased) == norm, F.concat(F.lit(" "), cased, F.lit(" ")).rlike(f" {run}(?= )")).otherwise(test)
        found.append(F.when(test, F.lit(keyword)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


ALIAS_ORDER = sorted(((a, name) for name, aliases in TITLE_ALIASES.items() for a in aliases), key=lambda x: (-len(x[0].split()), x[0]))


def canonical_words(title: str) -> list[str]:
    """The words of a wanted title, as canonical_title gives them for a column."""
    title = re.sub(CONTEXT, "", title, flags=re.I | re.S)
    title = re.sub(r"(?<=[A-Za-z0-9])['’`]s\b", " possessive ", title, flags=re.I)
    text = f" {' '.join(w for w in words_of(title) if w not in FILLERS)} "
    for alias, name in ALIAS_ORDER:
        text = re.sub(f" {alias}(?= )", f" {name}", text)
    return text.split()


def canonical_title(c: Column) -> Column:
    """A title's words, blank-separated: context ("at ...", "to the ...") and fillers cut, aliases written out."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), f"(?is){CONTEXT}", ""), r"(?i)(?<=[A-Za-z0-9])['’`]s\b", " possessive ")
    t = F.concat(F.lit(" "), normalize_text(t), F.lit(" "))
    t = F.regexp_replace(t, f" (?:{'|'.join(FILLERS)})(?= )", "")
    return F.trim(reduce(lambda t, a: F.regexp_replace(t, f" {a[0]}(?= )", f" {a[1]}"), ALIAS_ORDER, t))


def _place(have: Column, word: str) -> Column:
    return F.array_position(F.transform(have, lambda h: h.isin(*forms(word))), True)


def _title_test(canonical: Column, wanted: str) -> Column:
    want = canonical_words(wanted)
    if not want:
        return F.lit(False)
    guard = ("".join(f"(?<! {w})" for w in OTHERS_BEFORE), f"(?! (?:{'|'.join(OTHERS_AFTER)}) )")
    test = mentions(F.concat(F.lit(" "), canonical, F.lit(" ")), want, guard)
    if len(want) > 1:
        have = F.split(canonical, " ")
        at = [_place(have, w) for w in want]
        first, last = F.least(*at), F.greatest(*at)
        free = ~F.coalesce(F.get(have, first - 2).isin(*OTHERS_BEFORE), F.lit(False)) & ~F.coalesce(F.get(have, last).isin(*OTHERS_AFTER), F.lit(False))
        test = test | ((first > 0) & free)
    return test


def title_matches(c: Column, wanted: str) -> Column:
    """Is the title an instance of the wanted one, in any order of words, and not "former", "deputy" or "'s assistant"?"""
    return let(canonical_title(c), lambda t: F.coalesce(_title_test(t, wanted), F.lit(False)))


def _excluded(canonical: Column, excluded: list[str]) -> Column:
    padded = F.concat(F.lit(" "), canonical, F.lit(" "))
    tests = [mentions(padded, w) for e in excluded if (w := canonical_words(e))]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def is_excluded_title(c: Column, excluded: list[str]) -> Column:
    return let(canonical_title(c), lambda t: _excluded(t, excluded))


def title_rank(c: Column, wanted: list[str], excluded: list[str] = ()) -> Column:
    """Place of the first wanted title that matches, from 0; null if blank, excluded or none; 0 if none is wanted."""

    def rank(canonical: Column) -> Column:
        ranks = [F.when(_title_test(canonical, w), F.lit(i)) for i, w in enumerate(wanted)]
        return F.when(~_excluded(canonical, list(excluded)), F.coalesce(*ranks) if ranks else F.lit(0))

    return F.when(F.trim(c) != "", let(canonical_title(c), rank))
