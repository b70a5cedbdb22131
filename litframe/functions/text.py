"""Plain-text Column helpers: whitespace, HTML entities, word joins."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped
# or squeezed (the Unicode white-space set plus the four ASCII separators), as
# the inside of a pattern class.
_SPACES = (
    r"\x09-\x0d\x1c-\x20\x85\xa0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = f"[{_SPACES}]"
WHITESPACE = "".join(re.findall(WHITESPACE_CLASS, "".join(map(chr, range(0x3001)))))


def bind(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def strip(col: Column) -> Column:
    """Remove white space at both ends; linear, and no regex is involved."""
    return F.btrim(col, F.lit(WHITESPACE))


def squeeze(col: Column, by: str = " ") -> Column:
    """Replace every run of two or more white-space characters with ``by``."""
    # most texts have no two neighbours that are not printable ASCII, which is found at a
    # fraction of the cost; the lookahead passes over printable ASCII in the others
    pattern = "(?![!-~])" + WHITESPACE_CLASS + "{2,}"
    return bind(col, lambda t: F.when(t.rlike("[^!-~][^!-~]"), F.regexp_replace(t, pattern, by)).otherwise(t))


def blank_to_null(col: Column) -> Column:
    """``col``, or NULL where it is ``''``."""
    return F.nullif(col, F.lit(""))


# the HTML 4 names and the one that XML adds, as one constant that the optimizer
# folds into a map
_ENTITY_NAMES = ",".join(
    f"{name}:{code}" for name, code in sorted({**name2codepoint, "apos": 39}.items())
)


def _entity_piece(piece: Column, names: Column) -> Column:
    """Decode one piece of text that stood right after an ampersand."""
    # each pattern also matches nothing at all, so none looks for its ``^`` along the piece
    decimal = F.regexp_extract(piece, r"^(?:#([0-9]+);?)?", 1)
    hexadecimal = F.regexp_extract(piece, r"^(?:#[xX]([0-9A-Fa-f]+);?)?", 1)
    name = F.regexp_extract(piece, r"^(?:([A-Za-z][A-Za-z0-9]*);)?", 1)
    code = (
        # numbers beyond the type are no characters either
        F.when(decimal != "", F.ltrim(decimal, F.lit("0")).try_cast("int"))
        .when(hexadecimal != "", F.conv(F.right(F.ltrim(hexadecimal, F.lit("0")), F.lit(9)), 16, 10).try_cast("int"))
        .when(name != "", F.try_element_at(names, name).try_cast("int"))
    )
    reference = F.regexp_extract(piece, r"^(?:(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?)?", 0)
    rest = F.substr(piece, F.length(reference) + 1)

    def decoded(point: Column) -> Column:
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, rest)).otherwise(F.concat(F.lit("&"), piece))

    return bind(code, decoded)


def decode_entities(col: Column) -> Column:
    """Decode numeric and named character references.

    Text without an ampersand passes through on a byte search alone. The name
    table is the HTML 4 one that the Python standard library ships.
    """
    names = F.str_to_map(F.lit(_ENTITY_NAMES), F.lit(","), F.lit(":"))

    def rejoin(pieces: Column) -> Column:
        rest = F.transform(
            F.slice(pieces, 2, F.size(pieces)), lambda p: _entity_piece(p, names)
        )
        return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))

    def decode(text: Column) -> Column:
        return F.when(
            F.contains(text, F.lit("&")), bind(F.split(text, "&"), rejoin)
        ).otherwise(text)

    return bind(col, decode)
