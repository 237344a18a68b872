"""Python literal text as JSON text, in one linear pass.

The text is cut at its quoted strings.  Pieces outside strings get JSON's words
and brackets, pieces that are strings get JSON's escapes, and the pieces are
joined again.  Patterns have no look-ahead over the rest of the text and repeat
possessively, so the time is linear in the text and the stack stays flat
however long it is.  Text that needs none of this is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole quoted string, a stretch without quotes, or a stray quote.
_PIECES = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""
#: An escape of a string, or a stretch without escapes.
_ESCAPES = (r"(?s)\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[0-7]{1,3}|\\.|[^\\]++|\\")
#: What JSON has otherwise: words, tuples, last commas, escapes, prefixes of
#: strings and numbers with a bare dot, underscore or plus sign.
_PYTHON_ONLY = r"""None|True|False|[(\\]|,\s*[\]}]|[uU]['"]|[0-9][._](?![0-9])|[0-9]_|(?:^|[^0-9])\.[0-9]|\+[0-9.]"""

# Escapes that Python has and JSON hasn't, or has otherwise.
_SINGLE = {r"\'": r"\u0027", r"\a": r"\u0007", r"\v": r"\u000b", "\\\n": "",
           r'\"': r"\"", r"\\": r"\\", r"\n": r"\n", r"\r": r"\r", r"\t": r"\t", r"\b": r"\b", r"\f": r"\f"}


def _escape(e: Column) -> Column:
    """The JSON form of one escape, or of a stretch without any."""
    out = None
    for python, json in _SINGLE.items():
        out = F.when(e == F.lit(python), F.lit(json)) if out is None else out.when(e == F.lit(python), F.lit(json))
    code = F.conv(F.substring(e, 3, 8), 16, 10).cast("int") - 0x10000  # beyond four hex digits: two halves
    pair = F.concat(F.lit("\\u"), F.hex(F.lit(0xD800) + F.shiftright(code, 10)),
                    F.lit("\\u"), F.hex(F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF))))
    octal = F.lpad(F.conv(F.substring(e, 2, 3), 8, 16), 4, "0")
    return (out.when(~e.startswith("\\"), e)
            .when(e.rlike(r"^\\x."), F.concat(F.lit("\\u00"), F.substring(e, 3, 2)))
            .when(e.rlike(r"^\\u."), e)
            .when(e.rlike(r"^\\U0000"), F.concat(F.lit("\\u"), F.substring(e, 7, 4)))
            .when(e.rlike(r"^\\U."), pair)
            .when(e.rlike(r"^\\[0-7]"), F.concat(F.lit("\\u"), octal))
            .otherwise(F.concat(F.lit("\\"), e)))  # no escape in Python: the backslash stays


def _outside(p: Column) -> Column:
    """A piece outside strings."""
    for pattern, to in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\b[uU]$", ""),
                        (r"\(", "["), (r"\)", "]"), (r",\s*([\]}])", "$1"),
                        (r"([0-9])_(?=[0-9])", "$1"), (r"(?<![0-9A-Za-z_.])\+(?=[0-9.])", ""),
                        (r"(?<![0-9A-Za-z_])\.([0-9])", "0.$1"), (r"([0-9])\.(?![0-9])", "$1.0")):
        p = F.regexp_replace(p, pattern, to)
    return p


def json_text(c: Column) -> Column:
    """JSON text of a column of Python literals: lists, tuples, dicts, strings,
    numbers, ``None``, ``True`` and ``False``.  A tuple reads as a list, and so
    does a value in brackets of its own.  Text that is no literal gives text
    that is no JSON; NULL stays NULL.
    """
    def piece(p: Column) -> Column:
        escapes = F.transform(F.regexp_extract_all(p, F.lit(_ESCAPES), F.lit(0)), _escape)
        string = F.when(p.contains("\\"), F.array_join(escapes, "")).otherwise(p)
        return F.when(p.startswith("'") | p.startswith('"'), string).otherwise(_outside(p))

    pieces = F.transform(F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0)), piece)
    return F.when(c.rlike(_PYTHON_ONLY), F.array_join(pieces, "")).otherwise(c)
