"""Accents and compatibility forms off any text: Unicode decomposition (NFKD) without combining marks.

The map of code points is generated from Python's Unicode tables. Code points that become one other, or none, are one
translate() call inside generated code, and only text that is not ASCII gets there. Code points that become several
(ligatures, fractions, Hangul) go through an Arrow function, which receives just the texts that hold one of them.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: A few ranges that hold all code points which become several.
WIDE = r"[\x{A8}\x{AF}\x{B4}\x{B8}\x{BC}-\x{BE}\x{132}-\x{10FFFF}]"


def folded(text: str) -> str:
    """Decomposed, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def folds() -> tuple[str, str, str]:
    """Code points that change into one, what they become (those beyond its end vanish), and a pattern of those that
    become several."""
    single, gone, several = {}, [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        found = folded(chr(code))
        if len(found) > 1:
            several.append(code)
        elif not found:
            gone.append(chr(code))
        elif found != chr(code):
            single[chr(code)] = found
    ranges = []
    for code in several:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    pattern = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    return "".join(single) + "".join(gone), "".join(single.values()), pattern


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else folded(x) for x in texts.to_pylist()], pa.string())


def without_accents(text: Column, exact: bool = True) -> Column:
    """NFKD without combining marks; null stays null. With exact=False code points that become several stay."""
    source, target, several = folds()
    out = F.translate(text, source, target)
    if exact:
        # Few texts hold a code point of the wide ranges, and only those are held against the long pattern.
        many = F.rlike(text, F.lit(WIDE)) & F.rlike(text, F.lit(several))
        out = F.when(many, _folded(F.when(many, text))).otherwise(out)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(out)
