"""Names of persons: their parts, keys to find candidates by, and how alike two of them are.

Only the folding of letters is a vectorised Python function, as Spark has no Unicode normalisation; all that follows are column expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition, and Cyrillic letters in English spelling.
LATIN = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ŋ": "n", "ħ": "h", "ŧ": "t", "ĸ": "k", "ſ": "s"}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ў": "u",
    "қ": "k", "ғ": "g", "ң": "n", "ү": "u", "ұ": "u", "һ": "h", "ә": "a", "ө": "o", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "ѓ": "gj", "ќ": "kj", "ѕ": "dz",
}
# Generation suffixes by what they mean, and particles that sources drop or merge.
SUFFIXES = {"jr": "jr", "junior": "jr", "jnr": "jr", "hijo": "jr", "filho": "jr", "sr": "sr", "senior": "sr", "snr": "sr", "ii": "ii", "2nd": "ii", "iii": "iii", "3rd": "iii", "iv": "iv", "4th": "iv"}
PARTICLES = "de del della der di da das do dos du la las le los van von den ten ter y e bin ibn al el st".split()
# Levels of likeness from the best, those that are strong or weak, and their base scores.
LEVELS = ["exact", "reordered", "joined", "transliteration", "containment", "fuzzy", "initial", "surname", "nickname", "none"]
STRONG, WEAK = ["exact", "reordered", "joined", "transliteration", "containment"], ["fuzzy", "initial", "nickname"]
SCORES = {"exact": 60, "reordered": 55, "joined": 55, "transliteration": 45, "containment": 40, "fuzzy": 30, "initial": 25, "surname": 20, "nickname": 20, "none": 0}
NEAR = 0.88
# Nicknames stand in quotes or brackets; spellings that transliterations vary by, in the order in which they are unified.
NICKNAME = r"""["“”«»„][^"“”«»„]{1,40}["“”«»„]|(?:^|\s)'[^']{2,40}'(?=\s|$)|\([^)]{1,40}\)"""
SPELLINGS = [
    ("^ye", "e"), ("^yu", "u"), ("^ya", "a"), ("shch|sch", "s"), ("dzh|dj", "j"), ("zh", "z"), ("sh", "s"), ("tch", "c"), ("(?<=.)ch", "h"), ("^ch", "c"), ("kh", "h"), ("ph", "f"), ("ck", "k"), ("x", "ks"), ("q", "k"),
    ("ts|tz|cz", "c"), ("w", "v"), ("ff$", "v"), ("h", "g"),
]

_ROMAN = str.maketrans({**LATIN, **{k.upper(): v for k, v in LATIN.items() if len(k.upper()) == 1 and k not in "ıſ"}, **CYRILLIC, **{k.upper(): v for k, v in CYRILLIC.items()}})


def roman(text: str) -> str:
    """One text in lower case without accents, Cyrillic letters spelled in Latin ones; other scripts stay."""
    spelled = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).translate(_ROMAN))
    return "".join(c for c in spelled if not unicodedata.category(c).startswith("M")).lower()


def romanised(name: Column) -> Column:
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: None if s is None else roman(s))

    return F.pandas_udf(fold, "string")(name)


def skeleton(token: Column) -> Column:
    """Consonants of a Latin token in one spelling, to propose transliterations of one name; other scripts as they are. Lossy: a proposal and no proof."""
    t = token
    for pattern, by in SPELLINGS:
        t = F.regexp_replace(t, pattern, by)
    first = F.when(F.substring(t, 1, 1).rlike("[aeiouy]"), "a").otherwise(F.substring(t, 1, 1))
    bare = F.regexp_replace(F.concat(first, F.regexp_replace(F.substring(t, 2, 1000), "[aeiouy]", "")), r"(.)\1+", "$1")
    return F.when(token.rlike("^[a-z0-9]+$"), bare).otherwise(token)


def _tokens(folded: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(folded, "[’'`´ʼ]", ""), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(bare, " "), lambda w: w != "")


def _core(tokens: Column) -> Column:
    return F.filter(tokens, lambda w, i: (i == 0) | ~w.isin(PARTICLES))


def parsed(folded: Column) -> Column:
    """A romanised name as a struct: core (words without particles and suffix), suffix, initial, full, sorted, joined, skeletons (of core, in order), nicks (skeletons of the whole and of its nicknames), keys."""
    given = F.transform(F.regexp_extract_all(folded, F.lit(NICKNAME), F.lit(0)), lambda x: _core(_tokens(x)))
    text = F.regexp_replace(folded, NICKNAME, " ")
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    turned = (F.size(parts) == 2) & ~F.coalesce(F.regexp_replace(F.get(parts, F.lit(1)), r"[.\s]", "").isin(list(SUFFIXES)), F.lit(False))
    words = _tokens(F.when(turned, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(F.concat_ws(" ", parts)))
    behind = F.aggregate(F.reverse(words), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct(
        (a.n + (a.on & w.isin(list(SUFFIXES))).cast("int")).alias("n"), (a.on & w.isin(list(SUFFIXES))).alias("on")), lambda a: a.n)
    cut = F.least(behind, F.size(words) - 1)
    meaning = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    one = F.struct(F.when(cut > 0, F.try_element_at(meaning, F.element_at(words, -1))).alias("suffix"), F.slice(words, F.lit(1), F.greatest(F.size(words) - cut, F.lit(0))).alias("tokens"), given.alias("given"))
    # a one-element array carries each step's values on, so that no step is written out again for each of its uses
    steps = F.transform(F.array(one), lambda x: F.struct(x.suffix.alias("suffix"), x.tokens.alias("tokens"), _core(x.tokens).alias("core"), x.given.alias("given")))
    steps = F.transform(steps, lambda x: F.struct(x.suffix.alias("suffix"), x.tokens.alias("tokens"), x.core.alias("core"), x.given.alias("given"), F.transform(x.core, skeleton).alias("skeletons")))

    def told(x: Column) -> Column:
        join = lambda a, by=" ": F.array_join(a, by)
        first = F.get(x.core, F.lit(0))
        full, sorted_, joined, skel = join(x.core), join(F.array_sort(x.core)), join(x.tokens, ""), join(F.array_sort(x.skeletons))
        nicks = F.array_distinct(F.concat(F.array(join(x.skeletons)), F.transform(x.given, lambda g: join(F.transform(g, skeleton)))))
        several = F.size(x.core) >= 2
        six = F.slice(x.core, 1, 6)
        pairs = F.flatten(F.transform(six, lambda a, i: F.transform(F.filter(six, lambda b, j: j > i), lambda b: F.concat(F.lit("part:"), F.least(a, b), F.lit(" "), F.greatest(a, b)))))
        initial = F.concat(F.lit("init:"), F.substring(first, 1, 1), F.lit(" "), F.element_at(x.skeletons, -1))
        named = F.array(F.concat(F.lit("full:"), full), F.concat(F.lit("sorted:"), sorted_), F.concat(F.lit("skel:"), skel), F.concat(F.lit("joined:"), joined))
        none = F.array().cast("array<string>")
        keys = F.concat(named, F.when(several, F.concat(pairs, F.array(initial))).otherwise(none), F.transform(nicks, lambda n: F.concat(F.lit("nick:"), n)))
        return F.struct(
            x.core.alias("core"), x.suffix.alias("suffix"), F.when(several & (F.length(first) == 1), first).alias("initial"), full.alias("full"), sorted_.alias("sorted"), joined.alias("joined"),
            x.skeletons.alias("skeletons"), skel.alias("skeleton"), nicks.alias("nicks"), F.when(F.size(x.core) > 0, F.array_distinct(keys)).otherwise(none).alias("keys"),
        )

    return F.element_at(F.transform(steps, told), 1)


def _within(small: Column, large: Column, counted: bool) -> Column:
    """Whether all words of the one stand in the other, each as often at least if `counted`."""
    if not counted:
        return F.size(F.array_except(small, large)) == 0
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    return F.forall(F.array_distinct(small), lambda w: times(small, w) <= times(large, w))


def compared(seen: Column, known: Column, nickname: Column, counted: bool = True) -> Column:
    """struct(level, suffix_conflict, suffix_missing, given_differs) of two parsed names; `nickname` where the known one is a nickname.

    A suffix on one side only never makes an exact name, as father and son share it. Different first names under one likeness are told, as twins share all else. A name is contained in another with its words
    as often as it has them, or, unless `counted`, with each word once.
    """
    o, c = seen, known
    n, m = F.size(o["core"]), F.size(c["core"])
    empty = (n == 0) | (m == 0)
    conflict = o["suffix"].isNotNull() & c["suffix"].isNotNull() & (o["suffix"] != c["suffix"]) & ~empty
    missing = (o["suffix"].isNull() != c["suffix"].isNull()) & ~empty
    first = lambda x, key: F.get(x[key], F.lit(0))
    last = lambda x: F.element_at(x["skeletons"], -1)
    inside = lambda x, y: _within(x["core"], y["core"], counted) | _within(x["skeletons"], y["skeletons"], counted)
    held = F.when(n <= m, inside(o, c)).otherwise(inside(c, o))
    contained = (F.least(n, m) >= 2) & (n != m) & held & ((first(o, "core") == first(c, "core")) | (first(o, "skeletons") == first(c, "skeletons")))
    near = 1 - F.levenshtein(o["sorted"], c["sorted"]) / F.greatest(F.length(o["sorted"]), F.length(c["sorted"])) >= NEAR
    plain = (
        F.when(o["full"] == c["full"], "exact").when(o["sorted"] == c["sorted"], "reordered").when(o["joined"] == c["joined"], "joined").when((n == m) & (o["skeleton"] == c["skeleton"]), "transliteration").when(contained, "containment")
        .when((m >= 2) & (o["initial"] == F.substring(first(c, "core"), 1, 1)) & (last(o) == last(c)), "initial").when((n >= 2) & (m >= 2) & near, "fuzzy").when((n == 1) & (m >= 2) & (first(o, "skeletons") == last(c)), "surname").otherwise("none")
    )
    plain = F.when(missing & plain.isin("exact", "reordered", "joined", "transliteration"), "containment").otherwise(plain)
    by_nick = F.when(F.array_contains(o["nicks"], F.array_join(c["skeletons"], " ")), "nickname").otherwise("none")
    level = F.when(empty | conflict, "none").when(nickname, by_nick).otherwise(plain)
    leading = F.when(n == m, n - 1).otherwise(1)
    differ = F.exists(F.sequence(F.lit(0), F.greatest(leading - 1, F.lit(0))), lambda i: (F.length(F.get(o["core"], i)) > 1) & (F.length(F.get(c["core"], i)) > 1) & (F.get(o["core"], i) != F.get(c["core"], i)))
    told = F.struct(level.alias("level"), conflict.alias("suffix_conflict"), missing.alias("suffix_missing"), ((n >= 2) & (m >= 2) & differ).alias("given_differs"))
    step = F.transform(F.array(told), lambda x: F.struct(x.level.alias("level"), x.suffix_conflict.alias("suffix_conflict"), x.suffix_missing.alias("suffix_missing"), (x.given_differs & x.level.isin("transliteration", "fuzzy")).alias("given_differs")))
    return F.element_at(step, 1)
