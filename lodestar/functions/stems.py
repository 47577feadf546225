"""Stems of Portuguese words, by the public suffix rules that full-text search in databases uses.

A word has three regions. The first starts behind the first consonant that
follows a vowel, the second does so within the first. The verb's region starts
behind the next vowel if the second letter is a consonant, behind the next
consonant if the first two are vowels, else behind the third letter. Suffixes
go only from regions that hold them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

VOWELS = "aeiouáéíóúâêô"
#: Suffixes of nouns and adjectives that go from the second region; nasal vowels are written with a tilde behind them.
NOUNS = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos "
    "adora ador aça~o adoras adores aço~es ante antes ância logia logias uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras"
).split()
#: What some of them leave behind.
LEAVES = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
#: What goes as well before some of them.
BEFORE = {"mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"), "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",)}
#: Suffixes of verbs.
VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem "
    "ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes "
    "is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos "
    "emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()
#: Endings of words that have neither.
ENDINGS = "os a i o á í ó".split()


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def _suffix(word: Column, suffixes: list[str]) -> Column:
    """The longest of the suffixes that a word ends in, or nothing."""
    return F.regexp_extract(word, f"(?:{'|'.join(suffixes)})$", 0)


def _left(word: Column, less: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - less)


def _behind(word: Column, start: Column | int, pattern: str) -> Column:
    """Where a pattern that begins at start ends; the word's end if it doesn't match."""
    found = F.length(F.regexp_extract(F.substring(word, F.lit(start) + 1, F.length(word)), f"^{pattern}", 0))
    return F.when(found > 0, F.lit(start) + found).otherwise(F.length(word))


def _regions(word: Column) -> Column:
    """Struct (w, first, second, verb): the word and how many letters lie ahead of each region."""
    v, c = f"[{VOWELS}]", f"[^{VOWELS}]"
    turn = f"{c}*{v}+{c}"
    second_is_vowel, first_is_vowel = word.rlike(f"^.{v}"), word.rlike(f"^{v}")
    verb = F.when(~second_is_vowel, _behind(word, 2, f"{c}*{v}")).when(first_is_vowel, _behind(word, 2, f"{v}*{c}")).otherwise(F.least(F.lit(3), F.length(word)))
    return _bind(_behind(word, 0, turn), lambda first: F.struct(word.alias("w"), first.alias("first"), _behind(word, first, turn).alias("second"), verb.alias("verb")))


def _drop(word: Column, region: Column, suffixes: tuple[str, ...]) -> Column:
    """The word without one of the suffixes, if a region has it whole."""
    return _bind(_suffix(word, list(suffixes)), lambda s: F.when(F.length(word) - F.length(s) >= region, _left(word, F.length(s))).otherwise(word))


def _without_noun(r: Column) -> Column:
    """The word without its noun's suffix; null if none goes."""

    def cut(s: Column) -> Column:
        w, second = r["w"], r["second"]
        at = F.length(w) - F.length(s)
        rest = _left(w, F.length(s))
        adverb = _bind(rest, lambda t: F.when(t.endswith("iv"), _bind(_drop(t, second, ("iv",)), lambda u: F.when(u != t, _drop(u, second, ("at",))).otherwise(t))).otherwise(_drop(t, second, ("os", "ic", "ad"))))
        out = F.when(s == "amente", F.when(at >= r["first"], adverb)).when(s.isin("ira", "iras"), F.when((at >= r["verb"]) & rest.endswith("e"), F.concat(rest, F.lit("ir"))))
        for suffix, left in LEAVES.items():
            out = out.when(s == suffix, F.when(at >= second, F.concat(rest, F.lit(left))))
        for suffix, more in BEFORE.items():
            out = out.when(s == suffix, F.when(at >= second, _drop(rest, second, more)))
        return F.when(s != "", out.otherwise(F.when(at >= second, rest)))

    return _bind(_suffix(r["w"], NOUNS), cut)


def _without_verb(r: Column) -> Column:
    """The word without its verb's suffix; null if none goes."""
    s = _suffix(F.substring(r["w"], r["verb"] + 1, F.length(r["w"])), VERBS)
    return _bind(s, lambda s: F.when(s != "", _left(r["w"], F.length(s))))


def _stem(r: Column) -> Column:
    def soften(t: Column) -> Column:
        return F.when(t.endswith("ci") & (F.length(t) > r["verb"]), _left(t, F.lit(1))).otherwise(t)

    def last(t: Column) -> Column:
        loose = t.rlike("[eéê]$") & (F.length(t) > r["verb"])
        bare = _bind(_left(t, F.lit(1)), lambda u: F.when(u.rlike("(?:gu|ci)$") & (F.length(u) > r["verb"]), _left(u, F.lit(1))).otherwise(u))
        return F.when(loose, bare).otherwise(F.regexp_replace(t, "ç$", "c"))

    changed = _bind(F.coalesce(_without_noun(r), _without_verb(r)), lambda t: F.coalesce(soften(t), _drop(r["w"], r["verb"], tuple(ENDINGS))))
    return _bind(changed, last)


def stem(word: Column) -> Column:
    """The stem of a lower-case Portuguese word; null stays null. Other words lose what looks like a suffix all the same."""
    nasal = F.replace(F.replace(word, F.lit("ã"), F.lit("a~")), F.lit("õ"), F.lit("o~"))
    plain = lambda w: F.replace(F.replace(w, F.lit("a~"), F.lit("ã")), F.lit("o~"), F.lit("õ"))
    return _bind(_bind(_bind(nasal, _regions), _stem), plain)
