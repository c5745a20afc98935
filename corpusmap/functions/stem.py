"""Porter (1980) suffix stripping as Catalyst expressions.

A word is first marked: a ``y`` that counts as a consonant (at the start or after
a vowel) becomes ``Y``.  From then on vowels are ``[aeiouy]``, consonants all other
characters, and each condition of the algorithm (measure, vowel in the stem,
consonant-vowel-consonant ending) is one regular expression; marks depend only on
what stands before, so they stay right while endings change.  Every step is a CASE
over the word's ending.  All of it runs in the JVM.

Words are expected in lower case; those of one or two letters are returned
unchanged.  The rule lists follow the published algorithm with the widely used
revisions of its author's C implementation (bli→ble, logi→log).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Porter suffix rules (suffix, replacement), in rule order ------
STEP2_RULES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3_RULES = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

# a vowel, a consonant, and stems of measure > 0 and > 1 by what they contain
_V, _C = "[aeiouy]", "[^aeiouy]"
_M1 = _V + _C
_M2 = f"{_V}{_C}+{_V}+{_C}"
# the whole stem has measure 1 and ends consonant, vowel, consonant other than w, x, y
_SHORT = f"^{_C}+{_V}[^aeiouywxY]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _cases(w: Column, cases) -> Column:
    """The first case whose condition holds, else ``w``."""
    (cond, then), *rest = cases
    out = F.when(cond, then)
    for cond, then in rest:
        out = out.when(cond, then)
    return out.otherwise(w)


def _step_1a(w: Column) -> Column:
    return _cases(w, [(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)), (w.endswith("ss"), w),
                      (w.endswith("s"), _cut(w, 1))])


def _step_1b(w: Column) -> Column:
    cut = F.when(w.rlike(_V + ".*ed$"), _cut(w, 2)).when(w.rlike(_V + ".*ing$"), _cut(w, 3))

    def mend(x: Column) -> Column:
        end, prior = F.substring(x, -1, 1), F.substring(x, -2, 1)
        double = ((F.length(x) >= 2) & (F.translate(end, "Y", "y") == F.translate(prior, "Y", "y"))
                  & end.rlike(_C) & ~end.isin("l", "s", "z"))
        return _cases(x, [(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))), (double, _cut(x, 1)),
                          (x.rlike(_SHORT + "$"), F.concat(x, F.lit("e")))])

    return F.when(w.endswith("eed"), F.regexp_replace(w, f"({_M1}.*)eed$", "$1ee")).otherwise(
        F.coalesce(_let(cut, mend), w))


def _step_1c(w: Column) -> Column:
    return F.regexp_replace(w, f"({_V}.*)[yY]$", "$1i")


def _step_2_3(rules) -> Callable[[Column], Column]:
    return lambda w: _cases(w, [(w.endswith(suf), F.regexp_replace(w, f"({_M1}.*){suf}$", f"$1{rep}"))
                                for suf, rep in rules])


def _step_4(w: Column) -> Column:
    return _cases(w, [(w.rlike("[st]ion$") if suf == "ion" else w.endswith(suf),
                       F.regexp_replace(w, f"({_M2}.*){suf}$", "$1")) for suf in STEP4_SUFFIXES])


def _step_5(w: Column) -> Column:
    cut = F.when(w.rlike(_M1 + ".*e$") & ~w.rlike(_SHORT + "e$"), _cut(w, 1)).otherwise(w)
    return _let(cut, lambda x: F.when(x.endswith("ll") & x.rlike(_M2), _cut(x, 1)).otherwise(x))


def porter_stem(word: Column | str) -> Column:
    """The stem of a column of lower-case words (null: null)."""
    word = F.col(word) if isinstance(word, str) else word
    w = F.regexp_replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), "yy", "yY")
    for step in (_step_1a, _step_1b, _step_1c, _step_2_3(STEP2_RULES), _step_2_3(STEP3_RULES), _step_4, _step_5):
        w = _let(w, step)
    return F.when(F.length(word) <= 2, word).otherwise(F.translate(w, "Y", "y"))
