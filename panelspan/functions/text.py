"""Name folding, id codes and display formats."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and signs that become more than one ASCII character,
# or that have no canonical decomposition (public Latin-ASCII transliteration).
EXPANSIONS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ŋ": "ng", "Ŋ": "NG",
    "ﬁ": "fi", "ﬂ": "fl", "©": "C", "®": "R",
    "ǆ": "dz", "ǅ": "Dz", "Ǆ": "DZ", "ǳ": "dz", "ǲ": "Dz", "Ǳ": "DZ",
    "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ", "ŉ": "'n",
}
SINGLES = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i",
}


def _accent_table() -> dict[str, str]:
    """Accented Latin letters with a one-letter ASCII base, by decomposition."""
    table = dict(SINGLES)
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            table.setdefault(letter, base)
    # full-width forms are the ASCII characters moved by a fixed distance
    for code in range(0xFF10, 0xFF5B):
        base = chr(code - 0xFEE0)
        if base.isalnum() or base == "_":
            table[chr(code)] = base
    return table


_ACCENTS = _accent_table()
_FROM = "".join(_ACCENTS)
_TO = "".join(_ACCENTS.values())
_PYTHON_FOLD = str.maketrans({**_ACCENTS, **EXPANSIONS})
_DROPPED = "[^a-z0-9_]"
# ASCII characters that are dropped; a translation without a target deletes.
_DELETED = "".join(chr(i) for i in range(128) if not (chr(i).isalnum() or chr(i) == "_"))


@lru_cache(maxsize=100_000)
def fold_name(name: str) -> str:
    """Driver-side twin of :func:`folded`, for column names."""
    return re.sub(_DROPPED, "", name.translate(_PYTHON_FOLD).lower())


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def folded(text: Column) -> Column:
    """ASCII-fold, lower-case and keep only letters, digits and ``_``.

    One translation folds accents and deletes ASCII signs.  Expansions are
    only looked for in text that is not ASCII, and the final pattern only runs
    on text that still is not; both skip most values.
    """
    expanded = text
    for source, target in EXPANSIONS.items():
        expanded = F.replace(expanded, F.lit(source), F.lit(target))
    source = F.when(_is_ascii(text), text).otherwise(expanded)
    plain = F.lower(F.translate(source, _FROM + _DELETED, _TO))
    return F.when(_is_ascii(plain), plain).otherwise(F.regexp_replace(plain, _DROPPED, ""))


def id_code(identifier: Column) -> Column:
    """Numeric id as text; going through long keeps ``15001070`` intact."""
    return identifier.cast("long").cast("string")


def id_prefix(identifier: Column, width: int = 2) -> Column:
    return F.substring(id_code(identifier), 1, width)


NO_DATA = "No data"


def _rounded(value: Column, digits: int) -> Column:
    """Half-even rounding; adding zero turns a negative zero into zero."""
    return F.bround(value.cast("double"), digits) + F.lit(0.0)


def percent_text(share: Column, digits: int = 1, group_mark: str = " ") -> Column:
    """``0.1234`` as ``12.3%``; thousands of percent are split by ``group_mark``."""
    body = F.replace(F.format_number(_rounded(share * 100, digits), digits), F.lit(","), F.lit(group_mark))
    return F.when(share.isNull(), NO_DATA).otherwise(F.concat(body, F.lit("%")))


def count_text(value: Column) -> Column:
    """Whole number with comma grouping."""
    return F.when(value.isNull(), NO_DATA).otherwise(F.format_number(_rounded(value, 0), 0))


def plain_text(value: Column, digits: int = 4) -> Column:
    """Rounded number as text: the shorter of fixed and scientific form, fixed on ties; missing stays missing.

    Neither form has trailing zeros, the exponent has a sign and two digits at least: ``0.0012``, ``1e-04``, ``1e+05``.
    """
    padded = F.format_string(f"%.{digits}f", _rounded(value, digits))
    fixed = F.regexp_replace(F.regexp_replace(padded, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    sign = F.when(fixed.startswith("-"), "-").otherwise("")
    whole = F.substring_index(F.regexp_replace(fixed, "^-", ""), ".", 1)
    part = F.when(F.contains(fixed, F.lit(".")), F.substring_index(fixed, ".", -1)).otherwise("")
    leading = F.length(part) - F.length(F.regexp_replace(part, "^0+", ""))
    exponent = F.when(whole != "0", F.length(whole) - 1).otherwise(-leading - 1)
    shown = F.regexp_replace(F.concat(whole, part), "^0+|0+$", "")
    mantissa = F.concat(F.left(shown, F.lit(1)), F.when(F.length(shown) > 1, F.concat(F.lit("."), F.substr(shown, F.lit(2)))).otherwise(""))
    scientific = F.concat(sign, mantissa, F.lit("e"), F.format_string("%+03d", exponent))
    shorter = (shown != "") & (F.length(scientific) < F.length(fixed))
    return F.when(value.isNotNull(), F.when(shorter, scientific).otherwise(fixed))
