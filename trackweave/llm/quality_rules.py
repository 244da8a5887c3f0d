"""Quality rules, line first: every line is judged, failing lines go, documents losing too much text are rejected.

DataFrame functions only. Each text is worked on inside its own row, so nothing is shuffled and no
group can become hot. Null texts count as empty: no words, base_failed true, kept false, cleaned ''. Repeated rows give repeated rows,
an empty table an empty one; ids don't matter, and nothing depends on the order of ties.

A line with a word fails if one of these holds:

* punctuation: no word of the line ends in a terminal mark, or symbols make up over a tenth of its word characters;
* navigation: two or more words of the line are bare separators;
* boilerplate: it holds a fixed phrase, or three or more words written mostly in capitals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import SPACE

# The symbols that the base counts, terminal marks, separators of menus, stock phrases.
SYMBOLS = "#*$%&|<>"
TERMINAL = rf"""[.!?…。]["'”»)\]]*([{SPACE}]|\z)"""
SEPARATOR = rf"(^|[{SPACE}])([|»›>•·/-]|->|::)([{SPACE}]|\z)"
PHRASES = "(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|click here|lorem ipsum|sign up for our newsletter|skip to content)"
# What every phrase holds one of.
PARTS = ("policy", "terms of", "reserved", "javascript", "click here", "lorem", "newsletter", "skip to")
CAPITALS = rf"\p{{Lu}}[^{SPACE}]*[{SPACE}]+\p{{Lu}}[^{SPACE}]*[{SPACE}]+\p{{Lu}}"

#: Shortest text in words, most repeated words and most lost word characters in percent.
MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 50, 50

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_failed", "lost_chars", "kept", "cleaned"]


#: Bits for a word's place, beside a hash, in one 64-bit number: texts of up to 67 million words.
PLACE = 26


def _bare_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def _n_symbols(text: Column) -> Column:
    return F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0)


def _has_phrase(line: Column) -> Column:
    """Whether a stock phrase is in a line; a cheap search for its rarest part spares most lines the pattern."""
    low = F.lower(line)
    some = F.lit(False)
    for part in PARTS:
        some = some | F.contains(low, F.lit(part))
    return some & line.rlike(PHRASES)


def _fails(line: Column, chars: Column, symbols: Column) -> Column:
    return (chars > 0) & (
        ~line.rlike(TERMINAL)
        | (symbols * 10 > chars)
        | (line.rlike(r"[|»›>•·/:-]") & (F.regexp_count(line, F.lit(SEPARATOR)) >= 2))
        | _has_phrase(line)
        | (line.rlike(CAPITALS) & (F.length(F.regexp_replace(line, r"[^\p{Lu}]+", "")) * 10 > F.length(F.regexp_replace(line, r"[^\p{L}]+", "")) * 6))
    )


def line_fails(line: Column) -> Column:
    """Whether a line fails; lines without words don't."""
    return _fails(line, _bare_length(line), _n_symbols(line))


def _judged(line: Column) -> Column:
    facts = lambda chars, symbols: F.struct(line.alias("line"), chars.alias("chars"), symbols.alias("symbols"), _fails(line, chars, symbols).alias("fails"))
    return let(_bare_length(line), lambda chars: let(_n_symbols(line), lambda symbols: facts(chars, symbols)))


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + f(x))


def _neighbour_alike(values: Column, f) -> Column:
    """Of a sorted array, the values that are like one beside them."""
    like = lambda x, j: F.coalesce(f(F.get(values, j)) == x, F.lit(False))
    return F.filter(values, lambda x, j: like(f(x), j - 1) | like(f(x), j + 1))


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more. Hashes find candidates, the words themselves decide."""
    n = F.size(words)
    hashed = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, PLACE).bitwiseOR(i.cast("long"))))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    window = lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("words"), i.alias("at"))
    named = lambda some: F.sort_array(F.transform(some, lambda x: window(place(x))))
    starts = lambda some: F.sort_array(F.transform(some, lambda x: x["at"]))
    # Each window covers the three words from its start, less what the next one covers too.
    count = lambda s: _total(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), lambda x: x)
    exact = lambda h: let(placed(h), lambda p: let(named(_neighbour_alike(p, lambda x: F.shiftright(x, PLACE))), lambda w: let(starts(_neighbour_alike(w, lambda x: x["words"])), count)))
    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(h)))


def _facts(text: Column, min_words: int, max_repeated: int, max_lost: int) -> Column:
    """A struct of COLUMNS; every part is computed once."""

    def verdict(n_words: Column, repeated: Column, word_chars: Column, lost: Column, lines: Column, solid: Column, failed: Column) -> Column:
        base = (n_words < min_words) | (repeated * 100 > n_words * max_repeated)
        values = {
            "n_words": n_words, "word_chars": word_chars, "n_symbols": _total(lines, lambda x: x["symbols"]), "n_dup_lines": (F.size(solid) - F.size(F.array_distinct(F.transform(solid, lambda x: x["line"])))).cast("long"),
            "n_repeat_words": repeated, "base_failed": base, "n_lines": F.size(solid).cast("long"), "n_lines_failed": F.size(failed).cast("long"), "lost_chars": lost,
            "kept": ~base & (lost * 100 <= word_chars * max_lost), "cleaned": F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
        }
        return F.struct(*[values[c].alias(c) for c in COLUMNS])

    def by_lines(words: Column, lines: Column) -> Column:
        solid, failed = F.filter(lines, lambda x: x["chars"] > 0), F.filter(lines, lambda x: x["fails"])
        chars = lambda rows: _total(rows, lambda x: x["chars"])
        return let(_repeated_words(words), lambda r: let(solid, lambda s: let(failed, lambda f: let(chars(f), lambda lost: let(chars(s), lambda w: verdict(F.size(words).cast("long"), r, w, lost, lines, s, f))))))

    words = F.array_remove(F.split(text, rf"[{SPACE}]+"), "")
    return let(words, lambda w: let(F.transform(F.split(text, "\n"), _judged), lambda lines: by_lines(w, lines)))


def apply_rules(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with COLUMNS, which replace columns of those names; ``cleaned`` is the text of the lines that pass.

    The columns come out of a generator, so that a filter on them stays above it and nothing is computed again for it.
    """
    keep = [docs[f"`{x}`"] for x in docs.columns if x.lower() not in COLUMNS]
    facts = _facts(F.coalesce(docs[f"`{text}`"], F.lit("")), min_words, max_repeated, max_lost)
    return docs.select(*keep, F.inline(F.array(facts)))
