"""Text normalisation as Column expressions.

The steps Spark has no built-in for (Unicode decomposition, HTML entities, case folding) are small
Arrow functions, handed only the values that need them: everything else reaches them as null, and
the expression falls back to the value itself, so plain ASCII columns never pay for the Python
side beyond an empty batch.
"""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NON_ASCII = r"[^\x00-\x7F]"


def _combining_class() -> str:
    """Every code point with a combining class, as one regex character class built from ranges."""
    ranges: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if unicodedata.combining(chr(point)):
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


_ALL_MARKS = _combining_class()
_LATIN_MARKS = r"[\x{300}-\x{36f}]"


def _decompose(values: pa.Array, marks: str) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(values, form="NFKD"), marks, "")


@F.arrow_udf(T.StringType())
def _strip_all_marks(values: pa.Array) -> pa.Array:
    return _decompose(values, _ALL_MARKS)


@F.arrow_udf(T.StringType())
def _strip_latin_marks(values: pa.Array) -> pa.Array:
    return _decompose(values, _LATIN_MARKS)


@F.arrow_udf(T.StringType())
def _unescape(values: pa.Array) -> pa.Array:
    return pa.array([v if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _casefold(values: pa.Array) -> pa.Array:
    return pa.array([v if v is None else v.casefold() for v in values.to_pylist()], pa.string())


def _only(udf, wanted: Column, c: Column) -> Column:
    """`udf(c)` where `wanted`, `c` as it is elsewhere."""
    return F.coalesce(udf(F.when(wanted, c)), c)


def strip_space(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_text(c: Column) -> Column:
    """HTML entities decoded, stripped, blank to null."""
    return blank_to_null(strip_space(_only(_unescape, c.contains("&"), c)))


def casefold(c: Column) -> Column:
    return _only(_casefold, c.rlike(_NON_ASCII), F.lower(c))


def normalize_name(c: Column) -> Column:
    """A display name made comparable: no accents, lower case, `&` as a word, ASCII letters and
    digits only, single spaces. Never null: a missing name is the empty string."""
    plain = _only(_strip_all_marks, clean_text(c).rlike(_NON_ASCII), clean_text(c))
    worded = F.replace(F.lower(plain), F.lit("&"), F.lit(" and "))
    return F.coalesce(F.trim(F.regexp_replace(worded, "[^a-z0-9]+", " ")), F.lit(""))


def match_key(c: Column) -> Column:
    """A title made comparable for search: like `normalize_name`, but entities stay as written
    and letters and digits of every script count. Null stays null."""
    plain = _only(_strip_latin_marks, c.rlike(_NON_ASCII), c)
    worded = F.replace(F.lower(plain), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(worded, r"[^\p{L}\p{N}]+", " "))


def title_key(c: Column) -> Column:
    """What makes two titles one show. A title with no ASCII letter or digit keeps its own text."""
    name = normalize_name(c)
    return F.when(name != "", name).otherwise(strip_space(casefold(c)))


def base_slug(c: Column) -> Column:
    """`room-2` -> `room`: the slug without the counter added when one is taken."""
    return F.regexp_replace(F.lower(F.coalesce(clean_text(c), F.lit(""))), r"-\d+$", "")


def words(c: Column, fold: Callable[[Column], Column] = casefold) -> Column:
    """The words of a text, casefolded or as `fold` has them: runs of letters, digits and underscores
    of any script."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens(key: Column) -> Column:
    """The tokens of a normalised key; none for the empty key."""
    return F.filter(F.split(key, " "), lambda t: t != "")


def is_passage(claim: Column, text: Column) -> Column:
    """`claim` is a non-empty run of whole words of `text`."""
    needle, hay = F.array_join(words(claim), " "), F.array_join(words(text), " ")
    pad = F.lit(" ")
    return (needle != "") & F.contains(F.concat(pad, hay, pad), F.concat(pad, needle, pad))


def contains_text(c: Column, needle: str) -> Column:
    """Case-insensitive containment; `%` and `_` in the needle are ordinary characters."""
    return F.contains(F.lower(c), F.lower(F.lit(needle)))
