"""English words for a full-text index: Porter's stemmer as Column expressions, and a list of words that don't count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that don't count by default.
STOP = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from
    further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same
    she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will
    with would you your yours yourself yourselves""".split()
)

# The endings of Porter's algorithm and what takes their place, a step each. A rule applies to the longest ending that a word has, or to none.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = tuple((e, "") for e in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())

# Stems as patterns. A y that is a consonant, at the start or after a vowel, is written Y, so letters alone tell vowels from consonants.
_C, _V = "[^aeiouy]", "[aeiouy]"
_SOME = f"{_C}*{_V}+{_C}.*"  # at least one vowel-consonant sequence
_TWO = f"{_C}*{_V}+{_C}+{_V}+{_C}.*"  # at least two
_ONE = f"{_C}*{_V}+{_C}+{_V}*"  # exactly one
_SHORT = f"{_C}{_V}[^aeiouywxY]"  # consonant, vowel, consonant that isn't w, x or y, at the end


def _ruled(word: Column, rules: tuple[tuple[str, str], ...], stem: str) -> Column:
    """The longest ending that ``word`` has is replaced if what is before it matches ``stem``."""
    out = None
    for ending, new in sorted(rules, key=lambda r: -len(r[0])):
        before = f"{stem}(?<=[st])" if ending == "ion" else stem
        done = F.regexp_replace(word, f"^({before}){ending}$", f"$1{new}")
        out = F.when(word.endswith(ending), done) if out is None else out.when(word.endswith(ending), done)
    return out.otherwise(word)


def _matches(word: Column, pattern: str) -> Column:
    return word.rlike(f"^(?:{pattern})$")


def porter_steps() -> list[Callable[[Column], Column]]:
    """The algorithm as functions of a word, to be applied one after the other."""

    def marked(w: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")

    def past(w: Column) -> Column:
        """Step 1b, with a mark on words that lost an ending."""
        return (
            F.when(w.endswith("eed"), F.regexp_replace(w, f"^({_SOME})eed$", "$1ee"))
            .when(_matches(w, f".*{_V}.*ed"), F.concat(F.regexp_replace(w, "ed$", ""), F.lit("+")))
            .when(_matches(w, f".*{_V}.*ing"), F.concat(F.regexp_replace(w, "ing$", ""), F.lit("+")))
            .otherwise(w)
        )

    def mended(w: Column) -> Column:
        bare = F.regexp_replace(w, r"\+$", "")
        fixed = (
            F.when(bare.rlike("(?:at|bl|iz)$"), F.concat(bare, F.lit("e")))
            .when(bare.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(bare, ".$", ""))
            .when(_matches(bare, _ONE) & bare.rlike(f"{_SHORT}$"), F.concat(bare, F.lit("e")))
            .otherwise(bare)
        )
        return F.when(w.endswith("+"), fixed).otherwise(w)

    def final_e(w: Column) -> Column:
        bare = F.regexp_replace(w, "e$", "")
        goes = _matches(bare, _TWO) | (_matches(bare, _ONE) & ~bare.rlike(f"{_SHORT}$"))
        return F.when(w.endswith("e") & goes, bare).otherwise(w)

    return [
        marked,
        lambda w: _ruled(w, STEP_1A, ".*"),
        past,
        mended,
        lambda w: F.regexp_replace(w, f"^(.*{_V}.*)[yY]$", "$1i"),
        lambda w: _ruled(w, STEP_2, _SOME),
        lambda w: _ruled(w, STEP_3, _SOME),
        lambda w: _ruled(w, STEP_4, _TWO),
        final_e,
        lambda w: F.when(w.endswith("ll") & _matches(w, _TWO), F.regexp_replace(w, "l$", "")).otherwise(w),
        F.lower,
    ]


def stemmed(words: Column) -> Column:
    """An array of words (lower-case letters a to z) reduced to their stems; words of one or two letters stay.

    A step is a transformation of the whole array, so no expression holds the one before it more than once, whatever is pushed through it.
    """
    out = words
    for step in porter_steps():
        out = F.transform(out, step)
    return F.zip_with(words, out, lambda word, stem: F.when(F.length(word) > 2, stem).otherwise(word))


def with_stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """``terms`` with ``stem``, by a projection for each step, which is compiled: for tables of distinct words that are written at once.

    A condition on ``stem`` would be pushed down and repeat every step within the next; filter what was written.
    """
    out = terms.withColumn("stem", F.col(column))
    for step in porter_steps():
        out = out.withColumn("stem", step(F.col("stem")))
    return out.withColumn("stem", F.when(F.length(column) > 2, F.col("stem")).otherwise(F.col(column)))
