"""Column functions over text: stripping, words, lines, rounding, token sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends: CR LF, or any one of the characters that end a line in extracted text (form feeds end pages).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


#: White space of any kind: what \s finds with (?U).
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The line ends other than the plain one.
OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_col(c: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.btrim(c, F.lit(SPACE))


def one_line_col(c: Column) -> Column:
    """White space runs made one space, ends stripped."""
    return strip_col(F.regexp_replace(c, r"(?U)\s+", " "))


def words_col(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def first_words_col(c: Column, n: int) -> Column:
    """The first n words, the text after them unread; one empty word if there are none."""
    return F.slice(F.split(strip_col(F.coalesce(c, F.lit(""))), r"(?U)\s+", n + 1), 1, n)


def has_words_col(c: Column, n: int) -> Column:
    """Whether there are n words or more; the text after them is not read."""
    return F.coalesce(c, F.lit("")).rlike(rf"(?U)^\s*+(?:\S++\s++){{{n - 1}}}\S")


def word_count_col(c: Column) -> Column:
    return F.size(words_col(c)).cast("long")


def split_lines_col(c: Column) -> Column:
    """The lines of a text; none for the empty text, and no empty line after a final line end."""
    text = F.coalesce(c, F.lit(""))
    odd = reduce(or_, [text.contains(end) for end in OTHER_ENDS])
    lines = F.when(odd, F.split(text, LINE_END)).otherwise(F.split(text, "\n"))
    return let(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x))


def round_half_even(c: Column, places: int = 2) -> Column:
    """The scaled number's nearest whole, halves to even, scaled back: as DuckDB's round_even. bround() looks at the decimal
    digits instead, and differs where a number such as 0.575 lies beside its half."""
    return F.rint(c * 10**places) / 10**places


def round_half_up(c: Column, places: int = 2) -> Column:
    """The scaled number's nearest whole, halves away from 0, scaled back: as DuckDB's round. round(c, places) looks at the
    decimal digits instead, and differs where a number such as 0.08499999999999999 is a half when scaled."""
    return F.round(c * 10**places) / 10**places


def nearest_whole(c: Column) -> Column:
    """The nearest whole number, halves upward."""
    return F.floor(c + 0.5)


def token_set_col(c: Column, least: int = 4) -> Column:
    """Distinct lower-case tokens: runs of at least `least` letters or digits a-z, 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def has_tokens_col(c: Column, least: int = 4) -> Column:
    """Whether token_set_col() finds any, at the cost of a search."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(f"[a-z0-9]{{{least}}}")


def jaccard_col(a: Column, b: Column) -> Column:
    """Shared over all tokens of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))
