"""Column expressions over text. White space means what Python's ``str`` methods mean."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from pairloom.fixed import ASCII_SPACES, OTHER_SPACES

ColumnOrName = Column | str
INLINE_TERMS = 4
GLANCE = 64


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The classes of ASCII_SPACES and OTHER_SPACES, the latter as ranges.
_OTHER = (
    r"\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
ANY_SPACE = rf"[\s{_OTHER}]"
NON_SPACE = rf"[^\s{_OTHER}]"
# From the first visible character of a piece up to the next dot: one match per
# sentence, in one pass without backtracking.
SENTENCE = rf"[^.\s{_OTHER}][^.]*"


def _array(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def or_empty(c: ColumnOrName) -> Column:
    return F.coalesce(col(c), F.lit(""))


def let(value: ColumnOrName, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    if isinstance(value, str):
        return body(F.col(value))
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_spaces(c: ColumnOrName) -> Column:
    """Every white-space character replaced by a blank.

    Substring searches run on the raw bytes and tell which texts need the regex at all:
    few hold anything but blanks and line breaks. An expression is evaluated once, not for
    every search.
    """

    def plain(c: Column) -> Column:
        rare = reduce(or_, [F.contains(c, F.lit(ch)) for ch in ASCII_SPACES + OTHER_SPACES if ch.isascii() and ch not in " \n"])
        wide = _array([ch for ch in OTHER_SPACES if not ch.isascii()])
        odd = rare | ((F.octet_length(c) > F.length(c)) & F.exists(wide, lambda ch: F.contains(c, ch)))
        return F.when(odd, F.regexp_replace(c, ANY_SPACE, " ")).otherwise(F.replace(c, F.lit("\n"), F.lit(" ")))

    return let(c, plain)


def strip(c: ColumnOrName) -> Column:
    return F.btrim(col(c), F.lit(ASCII_SPACES + OTHER_SPACES))


def not_blank(*cs: ColumnOrName) -> Column:
    """True where every column holds a visible character; null counts as blank.

    The first characters nearly always decide; only then is the rest looked at.
    """

    def visible(c: ColumnOrName) -> Column:
        text = or_empty(c)
        return F.left(text, F.lit(GLANCE)).rlike(NON_SPACE) | text.rlike(NON_SPACE)

    return reduce(lambda a, b: a & b, [visible(c) for c in cs])


def sentence_count(c: ColumnOrName) -> Column:
    return F.regexp_count(col(c), F.lit(SENTENCE))


def sentence_count_to(c: ColumnOrName, cap: int) -> Column:
    """The sentence count, or ``cap`` if it is higher.

    The start of a text, cut after a few dots, nearly always holds ``cap`` sentences
    already; only the other texts are counted to their end.
    """
    start = F.substring_index(col(c), ".", 2 * cap)
    return F.when(sentence_count(start) >= cap, cap).otherwise(F.least(sentence_count(c), F.lit(cap)))


def sentences(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(col(c), F.lit(SENTENCE), F.lit(0))


def words(c: ColumnOrName) -> Column:
    return F.array_remove(F.split(plain_spaces(c), " "), "")


def first_words(c: ColumnOrName, n: int) -> Column:
    """The first ``n + 1`` pieces at most; the last one is the unsplit rest."""
    pieces = F.split(F.trim(plain_spaces(c)), " +", n + 1)
    return F.array_remove(pieces, "")


def length_between(c: ColumnOrName, lo: int, hi: int) -> Column:
    return F.length(col(c)).between(lo, hi)


def contains_any(c: ColumnOrName, terms: Sequence[str]) -> Column:
    """A short list becomes an OR; a long one a loop over a constant array, since the
    generated code of a long OR outgrows what the JVM compiles."""
    if not terms:
        return F.lit(False)
    if len(terms) <= INLINE_TERMS:
        return reduce(or_, [F.contains(col(c), F.lit(t)) for t in terms])
    return let(c, lambda text: F.exists(_array(terms), lambda t: F.contains(text, t)))


def count_contains(c: ColumnOrName, terms: Sequence[str]) -> Column:
    """How many of the terms occur at least once."""
    if len(terms) <= INLINE_TERMS:
        return reduce(add, [F.contains(col(c), F.lit(t)).cast("int") for t in terms], F.lit(0))
    return let(c, lambda text: F.size(F.filter(_array(terms), lambda t: F.contains(text, t))))


def render(template: str, **values: ColumnOrName) -> Column:
    """Fill ``{name}`` slots of a constant template with columns, in one concat."""
    pieces, rest = [], template
    while rest:
        spots = [(rest.find("{" + name + "}"), name) for name in values]
        spots = sorted(s for s in spots if s[0] >= 0)
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = spots[0]
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(or_empty(values[name]))
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces) if pieces else F.lit("")


def fill(c: ColumnOrName, **values: ColumnOrName) -> Column:
    """Fill ``{name}`` slots of a template *column*."""
    c = col(c)
    for name, value in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), col(value))
    return c
