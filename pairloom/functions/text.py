"""Text expressions: stripping, tags, pieces, sentences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.rand import uniform
from pairloom.functions.util import as_col, let

# The characters that count as white space at the ends of a line.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class, in a spelling that Java and RE2 both read.
SPACE = (
    r"[ \t\n\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}]"
)

# Word lists of the sentence rules.
TITLES = "Mr|St|Mrs|Ms|Dr"
COMPANY_SUFFIXES = "Inc|Ltd|Jr|Sr|Co"
SENTENCE_OPENERS = (
    "Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|"
    r"He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever"
).replace(r"\s", SPACE)
SITE_ENDINGS = "com|net|org|io|gov|edu|me"

# A protected dot and a sentence end while the rules run.
DOT = "<prd>"
END = "<stop>"

_L = "[A-Za-z]"

# The rules of sentence splitting as (pattern, replacement), in order; groups are written $1. Runs of dots are protected
# behind the first one.
DECIMAL = (r"([0-9])\.([0-9])", f"$1{DOT}$2")
DOCTORATE = ("Ph.D.", f"Ph{DOT}D{DOT}")
LONE_LETTER = (rf"{SPACE}({_L})\. ", f" $1{DOT} ")
INITIALS = [
    (rf"([A-Z]\.[A-Z]\.(?:[A-Z]\.)?) ({SENTENCE_OPENERS})", f"$1{END} $2"),
    (rf"({_L})\.({_L})\.({_L})\.", f"$1{DOT}$2{DOT}$3{DOT}"),
    (rf"({_L})\.({_L})\.", f"$1{DOT}$2{DOT}"),
]
COMPANIES = [
    (rf" ({COMPANY_SUFFIXES})\. ({SENTENCE_OPENERS})", f" $1{END} $2"),
    (rf" ({COMPANY_SUFFIXES})\.", f" $1{DOT}"),
]
LAST_LETTER = (rf" ({_L})\.", f" $1{DOT}")
# A stop before a closing quote moves behind it.
QUOTE_SWAPS = [(".”", "”."), ('."', '".'), ('!"', '"!'), ('?"', '"?')]


def strip(text: Column | str) -> Column:
    return F.btrim(as_col(text), F.lit(WHITESPACE))


def one_line(text: Column | str) -> Column:
    """Tabs and line breaks become spaces, so that the text can be a field of a line."""
    return F.regexp_replace(as_col(text), "[\\t\\n\\r]", " ")


def add_tag(text: Column | str, tag: str) -> Column:
    return F.concat(F.lit(tag), as_col(text))


def strip_tag(text: Column | str, tag: str) -> Column:
    text = as_col(text)
    return F.when(text.startswith(tag), F.substring(text, len(tag) + 1, 2**31 - 1)).otherwise(text)


def longest_piece(text: Column | str, sep: str) -> Column:
    """The longest piece between separators; the first of equals."""
    pieces = F.split(as_col(text), "\\Q" + sep + "\\E", -1)
    ranked = F.transform(pieces, lambda p, i: F.struct(-F.length(p), i, p.alias("piece")))
    return F.array_min(ranked)["piece"]


def _rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _where(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """Run costly rewrites only on texts that a cheap test finds to need them."""
    return let(text, lambda t: F.when(needed(t), change(t)).otherwise(t))


def _protect_dot_runs(text: Column) -> Column:
    ended = F.regexp_replace(text, r"(\.{2,})", f"$1{END}")
    return F.regexp_replace(ended, r"\.(?=\.)|(?<=\.)\.", DOT)


def split_sentences(text: Column | str) -> Column:
    """Sentences of a text as an array, by ordered rewrites of native regular expressions.

    Most texts need few of the rules, so the rare ones stand behind a test.
    """
    work = F.replace(F.concat(F.lit(" "), as_col(text), F.lit("  ")), F.lit("\n"), F.lit(" "))
    # A title before the dot or a site ending behind it: the two rules touch only that dot, so one
    # search from dot to dot does both.
    work = F.regexp_replace(work, rf"\.(?:(?<=(?:{TITLES})\.)|(?={SITE_ENDINGS}))", DOT)
    work = _rewrite(work, [DECIMAL])
    work = _where(work, lambda t: t.contains(".."), _protect_dot_runs)
    work = F.replace(work, F.lit(DOCTORATE[0]), F.lit(DOCTORATE[1]))
    # The tests look for the rare dot first and backwards from it, not for every space or letter.
    work = _where(
        work,
        lambda t: t.rlike(rf"\. (?<={SPACE}{_L}\. )"),
        lambda t: _rewrite(t, [LONE_LETTER]),
    )
    # All three rules need what the last one looks for.
    work = _where(
        work, lambda t: t.rlike(rf"\.{_L}\.(?<={_L}\.{_L}\.)"), lambda t: _rewrite(t, INITIALS)
    )
    suffixes = COMPANY_SUFFIXES.split("|")
    work = _where(
        work,
        lambda t: reduce(or_, [t.contains(f" {s}.") for s in suffixes]),
        lambda t: _rewrite(t, COMPANIES),
    )
    work = _rewrite(work, [LAST_LETTER])
    for found, swapped in QUOTE_SWAPS:
        work = F.replace(work, F.lit(found), F.lit(swapped))
    for mark in ".?!":
        work = F.replace(work, F.lit(mark), F.lit(mark + END))
    work = F.replace(work, F.lit(DOT), F.lit("."))
    pieces = F.transform(F.split(work, END, -1), strip)
    return let(
        pieces,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def regroup_sentences(sentences: Column | str) -> Column:
    """A sentence that does not start with a letter joins the one before it."""
    arr = as_col(sentences)
    heads = F.filter(
        F.transform(arr, lambda s, i: F.when((i == 0) | s.rlike(r"^\p{L}"), i)),
        lambda i: i.isNotNull(),
    )
    return F.when(F.size(arr) == 0, F.array().cast("array<string>")).otherwise(
        let(
            F.concat(heads, F.array(F.size(arr))),
            lambda cuts: F.transform(
                F.slice(cuts, 1, F.size(cuts) - 1),
                lambda head, j: F.array_join(
                    F.slice(arr, head + 1, F.element_at(cuts, j + 2) - head), " "
                ),
            ),
        )
    )


def pick_sentence(groups: Column | str, seed: int, *keys: Column | str) -> Column:
    """One group, each with the same chance; null for an empty array."""
    arr = as_col(groups)
    at = (F.floor(uniform(seed, *keys) * F.size(arr)) + 1).cast("int")
    return F.when(F.size(arr) > 0, F.element_at(arr, at))


def sample_sentences(groups: Column | str, p: float, seed: int, *keys: Column | str) -> Column:
    """Keep the first group always and each other one with chance ``p``."""
    kept = F.filter(as_col(groups), lambda s, i: (i == 0) | (uniform(seed, *keys, i) < p))
    return F.array_join(kept, " ")
