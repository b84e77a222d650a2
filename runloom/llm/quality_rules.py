"""Line-first cleaning with DataFrame functions only.

A text is cut into lines. Rules look at one line at a time and remove those that fail; a document
that loses too much of its text is rejected. Nothing is shuffled: every rule reads its own row.

Defined results: a null text counts as an empty one and is rejected for having too few words. Blank
lines belong to no rule and carry no weight. Blanks at the end of a line, the `\\r` of other systems among them, do not count. Scripts
are equal: letters, marks, digits and punctuation are those of Unicode. Repeated rows get the same verdict, other columns are
ignored, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import BLANKS

SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_PERCENT = 50
#: A line of menu entries has so many separators at least, and so few characters for each.
NAV_SEPARATORS, NAV_CHARS = 3, 40
MAX_SYMBOL_PERCENT = 5
#: So many repeated windows are looked up one by one.
FEW = 16
#: Phrases of page furniture are looked for in lines up to this length; a longer one is prose that mentions them.
BOILERPLATE_CHARS = 200
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|uses cookies|enable javascript"
    "|javascript is disabled|lorem ipsum|sign up for|subscribe to|log ?in to|click here|read more|share this|skip to (main )?content"
)
#: What stands between menu entries: signs of their own, or dashes and slashes between blanks.
SEPARATORS = "[|·•›>]| [/–—-] "
#: A line may end in a letter, a mark, a digit, a picture or a punctuation mark of any script, but not in one of these.
ENDINGS, NO_ENDINGS = r"[\p{L}\p{M}\p{N}\p{P}\p{So}]", r"[#%&*@/\\_·•–—›‹«-]"
PUNCTUATION = r"\p{P}"
#: So many lines in a row, of so few words and characters and without a punctuation mark at the end, are a menu.
MENU_LINES, MENU_WORDS, MENU_CHARS = 4, 4, 30
#: The blanks that may follow the last character of a line.
LINE_ENDS = " \t\r\x0b\x0c"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(_text(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _ends(line: Column, pattern: str) -> Column:
    last = F.right(F.rtrim(line, F.lit(LINE_ENDS)), F.lit(1))
    return last.rlike(pattern) & ~last.rlike(NO_ENDINGS)


def line_passes(line: Column) -> Column:
    """True if no rule that looks at the line alone removes it.

    Navigation: menu entries between separators; closing quotation marks are none. Symbols: more than MAX_SYMBOL_PERCENT
    of its characters. Boilerplate: a short line with a phrase of page furniture. Punctuation: the line ends in a
    symbol, whatever its length.
    """
    chars = F.length(line)
    quotes = F.regexp_count(line, F.lit("»")) - F.regexp_count(line, F.lit("«"))
    separators = F.regexp_count(line, F.lit(SEPARATORS)) + F.greatest(quotes, F.lit(0))
    navigation = (separators >= NAV_SEPARATORS) & (chars <= separators * NAV_CHARS)
    symbols = (chars - F.length(F.regexp_replace(line, SYMBOLS, ""))) * 100 > chars * MAX_SYMBOL_PERCENT
    boilerplate = (chars <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE)
    return _ends(line, ENDINGS) & ~(navigation | symbols | boilerplate)


def menu_entry(line: Column) -> Column:
    """True for a short line of few words that no punctuation mark ends; several in a row are a menu."""
    few = F.size(F.filter(F.split(line, BLANKS), lambda w: w != "")) <= MENU_WORDS
    return (F.length(line) <= MENU_CHARS) & few & ~_ends(line, PUNCTUATION)


def passing(lines: Column) -> Column:
    """The lines that no rule removes, those of menus gone too.

    Each line is a digit, 1 for an entry; a line belongs to a menu if MENU_LINES ones follow each other among the digits
    around it.
    """
    row, edge = "1" * MENU_LINES, "0" * (MENU_LINES - 1)

    def kept(digits: Column) -> Column:
        around = lambda i: F.substr(digits, i + 1, F.lit(2 * MENU_LINES - 1))
        return F.filter(lines, lambda line, i: line_passes(line) & ~F.contains(around(i), F.lit(row)))

    digits = F.array_join(F.transform(lines, lambda line: F.when(menu_entry(line), "1").otherwise("0")), "")
    return _let(F.concat(F.lit(edge), digits, F.lit(edge)), kept)


def clean_text(text: Column) -> Column:
    """The text without the lines that fail a rule."""
    return F.array_join(_let(lines_of(text), passing), "\n")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """A 64-bit hash for each window of three words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def _width(starts: Column) -> Column:
    """Words in the windows that start at these places."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def _covered(pairs: Column) -> Column:
    """The same from (hash, place) pairs; sorted, equal windows are neighbours."""
    again = F.transform(
        pairs,
        lambda p, k: F.when(F.get(pairs, k - 1)["h"].eqNullSafe(p["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(p["h"]), p["i"]),
    )
    return _width(F.filter(again, lambda i: i.isNotNull()))


def _repeat_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more.

    The hashes found again are read off the sorted hashes. A few of them are looked up one by one;
    more of them by sorting the windows with their places, which gives the same number.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def counted(again: Column) -> Column:
        places = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())
        return F.when(F.size(again) == 0, 0).when(F.size(again) <= FEW, _width(places)).otherwise(_let(pairs, _covered))

    def found_again(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda h, k: h.eqNullSafe(F.get(ordered, k - 1))))

    return _let(_let(F.sort_array(windows), found_again), counted)


def _word_measures(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _let(_windows(words), _repeat_words).cast("long").alias("n_repeat_words"),
    )


def _line_measures(lines: Column) -> Column:
    return F.struct(
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.length(F.array_join(lines, "")).cast("long").alias("chars"),
        F.length(F.array_join(passing(lines), "")).cast("long").alias("left"),
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the word counts and the characters before and after the line rules."""
    base = docs.select("doc_id", _text(F.col(text)).alias("_text"))
    parts = base.select(
        "doc_id",
        _let(F.filter(F.split("_text", BLANKS), lambda w: w != ""), _word_measures).alias("_w"),
        _let(lines_of(F.col("_text")), _line_measures).alias("_l"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return parts.select(
        "doc_id",
        "_w.n_words",
        "_w.word_chars",
        "n_symbols",
        "_l.n_dup_lines",
        "_w.n_repeat_words",
        F.col("_l.chars").alias("_chars"),
        F.col("_l.left").alias("_left"),
    )


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document the measures, whether a base rule fails, and whether it is kept."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost = F.col("_chars") - F.col("_left")
    return (
        measures(docs, text)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (lost * 100 <= F.col("_chars") * MAX_LOST_PERCENT))
        .withColumn("lost_chars", lost.cast("long"))
        .drop("_chars", "_left")
    )


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns.

    The row travels as one struct beside the measures, so its column names cannot clash.
    """
    rows = docs.select(F.struct("*").alias("doc_id"), docs[text].alias("text"))
    return score(rows).where("kept").select("doc_id.*")


__all__ = ["clean_text", "keep", "line_passes", "lines_of", "measures", "menu_entry", "passing", "score"]
