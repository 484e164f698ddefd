"""String expressions: trimming, whitespace, list counting, lenient casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters treated as blank at either end of a string.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_BLANK = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x09-\x0d"
# Only runs that change are matched (two blanks, or one that is not a space), and most
# characters are turned away by the lookahead: text that is already clean is not rebuilt.
_BLANK_RUN = rf"(?=[\x00-\x20\x7f-\uffff])(?: [ {_BLANK}]+|[{_BLANK}][ {_BLANK}]*)"


_DECIMAL = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove blanks at both ends."""
    return F.btrim(as_column(c), F.lit(BLANKS))


def strip_upper(c) -> Column:
    return F.upper(strip(c))


def strip_lower(c) -> Column:
    return F.lower(strip(c))


def collapse_blanks(c) -> Column:
    """Every run of blanks becomes one space; none at the ends."""
    return F.btrim(F.regexp_replace(as_column(c), _BLANK_RUN, " "))


def word_count(collapsed) -> Column:
    """Words of a text already passed through :func:`collapse_blanks`."""
    c = as_column(collapsed)
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" ")))
    return F.when(F.length(c) == 0, 0).otherwise(spaces + 1).cast("int")


def list_size(c, sep: str = ";") -> Column:
    """Number of non-blank items of a separated list; null or blank gives 0."""
    mark = "\\" + sep
    item = rf"(?:^|{mark})[ {_BLANK}]*[^ {_BLANK}{mark}]"
    return F.coalesce(F.regexp_count(as_column(c), F.lit(item)), F.lit(0)).cast("int")


def lenient_double(c) -> Column:
    """Decimal text to double; anything else, such as a number with a type letter, is null."""
    text = strip(c)
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def flag(c) -> Column:
    """Bool-like text to 0/1; unknown and null give 0."""
    word = strip_lower(as_column(c).cast("string"))
    return F.coalesce(word.isin("true", "1").cast("int"), F.lit(0))


def release_label(c) -> Column:
    """Release number as a stable label: '4.2' stays, '2.0' and '2' become '2'."""
    text = strip(as_column(c).cast("string"))
    number = text.try_cast("double")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(number.isNull(), text).otherwise(plain)
