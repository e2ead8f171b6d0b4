"""Column functions over words. All character tests are ASCII-only by definition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes, prefixes and class names are part of the data format.
SUFFIXES = ["ed", "es", "us", "s", "able", "ing", "al", "ic", "ly", "tion"]
PREFIXES = ["re", "dis", "un", "de"]
# Pattern -> class, tried in order before and after the two position-dependent rules.
SHAPES_FIRST = [
    ("^[0-9]{2}$", "twoDigitNum"),
    ("^[0-9]{4}$", "fourDigitNum"),
    ("^[0-9]+$", "othernum"),
    ("[0-9].*[a-zA-Z]|[a-zA-Z].*[0-9]", "containsDigitAndAlpha"),
    ("[0-9].*-|-.*[0-9]", "containsDigitAndDash"),
    (r"[0-9].*[/\\]|[/\\].*[0-9]", "containsDigitAndSlash"),
    ("[0-9].*[.]|[.].*[0-9]", "containsDigitAndPeriod"),
    ("^[A-Z]+$", "allCaps"),
    ("^[A-Z][.]$", "capPeriod"),
]
SHAPES_LAST = (
    [(f"^[a-zA-Z]*{s}$", f"wordSuffix{s}") for s in SUFFIXES]
    + [(f"^{p}[a-zA-Z]*$", f"{p}WordPrefix") for p in PREFIXES]
    + [("-", "withDash"), ("^[a-z]+$", "lowercase")]
)
UNKNOWN = "UNK"
# What the features of a token are made of.
CONTEXT = ("word", "next_word", "prev_word", "prevprev_word", "prev_tag", "prevprev_tag")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def word_class(word: Column, is_first: Column, lower_is_frequent: Column) -> Column:
    """Class of a rare word; a first word whose lower form is frequent becomes that form."""
    rule = None
    for pattern, name in SHAPES_FIRST:
        rule = (F if rule is None else rule).when(word.rlike(pattern), name)
    rule = rule.when(is_first & lower_is_frequent, ascii_lower(word))
    rule = rule.when(~is_first & word.rlike("^[A-Z]"), "initCap")
    for pattern, name in SHAPES_LAST:
        rule = rule.when(word.rlike(pattern), name)
    return rule.otherwise(UNKNOWN)


def has_digit(word: Column) -> Column:
    return word.rlike("[0-9]")


def has_letter(word: Column) -> Column:
    return word.rlike("[a-zA-Z]")


def is_initial(word: Column) -> Column:
    return word.rlike("^[A-Z][.]$")


def is_capital(word: Column) -> Column:
    """Starts with an ASCII capital: compared as bytes, which is cheaper than a pattern."""
    return (word >= "A") & (word < "[")


def feature_cells(c: dict[str, Column]) -> dict[str, Column]:
    """The name of each feature that a token can have, null where it is not active; endings apart.

    Features whose columns are not all in ``c`` are left out.
    """
    cells = {n: F.concat(F.lit(f"{n}="), c[n]) for n in CONTEXT if n in c}
    if "prev_tag" in c and "prevprev_tag" in c:
        cells["tag_bigram"] = F.concat(F.lit("tag_bigram="), c["prev_tag"], F.lit(" "), c["prevprev_tag"])
    if "word" in c and "prev_tag" in c:
        cells["is_cap"] = F.when(_is_cap(c), "is_cap")
    if "prev_word" in c and "prevprev_tag" in c:
        cells["prev_is_cap"] = F.when(is_capital(c["prev_word"]) & (c["prevprev_tag"] != "*"), "prev_is_cap")
    if "next_word" in c:
        cells["next_is_cap"] = F.when(is_capital(c["next_word"]), "next_is_cap")
    return cells


def _is_cap(c: dict[str, Column]) -> Column:
    return is_capital(c["word"]) & (c["prev_tag"] != "*")


def _endings(c: dict[str, Column]) -> dict[str, Column]:
    """Features of the word's ends, and whether they hold where the word is no capital one."""
    lowered = c.get("lowered", ascii_lower(c["word"]))
    suffixes = {f"suffix_{s}": lowered.endswith(s) for s in SUFFIXES}
    return suffixes | {f"prefix_{p}": lowered.startswith(p) for p in PREFIXES}


def feature_array(row: dict[str, Column] | None = None) -> Column:
    """Active feature names of one token, from its words and previous tags.

    ``lowered`` is the word in ASCII lower case, worked out here unless the row brings it.
    """
    c = row or {n: F.col(n) for n in (*CONTEXT, "lowered")}
    endings = F.array_compact(F.array(*[F.when(holds, n) for n, holds in _endings(c).items()]))
    # The capital test is asked once for all endings: the generated code of a test each is too long to be compiled.
    ends = F.when(~_is_cap(c), endings).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_compact(F.array(*feature_cells(c).values())), ends)


def feature_count(row: dict[str, Column]) -> Column:
    """The size of :func:`feature_array`, without making the names."""
    known = [row[n].isNotNull() for n in CONTEXT] + [row["prev_tag"].isNotNull() & row["prevprev_tag"].isNotNull()]
    active = known + [c.isNotNull() for n, c in feature_cells(row).items() if n not in (*CONTEXT, "tag_bigram")]
    ends = sum_of([F.coalesce(holds, F.lit(False)) for holds in _endings(row).values()])
    return sum_of(active) + F.when(~_is_cap(row), ends).otherwise(0)


def sum_of(conditions: list[Column]) -> Column:
    """How many of the conditions hold; none of them may be null."""
    return reduce(lambda a, b: a + b, [x.cast("int") for x in conditions])


# Flags that belong to every feature vocabulary, also where no row switches them on.
FLAG_NAMES = (
    ["is_cap", "prev_is_cap", "next_is_cap"]
    + [f"suffix_{s}" for s in SUFFIXES]
    + [f"prefix_{p}" for p in PREFIXES]
)


def feature_family(feature: Column) -> Column:
    return F.substring_index(feature, "=", 1)


def split_of(ident: Column) -> Column:
    """Seeded corpus split from the id: 1/16 dev, 1/16 test, the rest train."""
    digit = F.substring(F.md5(ident.cast("string")), 1, 1)
    return F.when(digit == "0", "dev").when(digit == "1", "test").otherwise("train")
