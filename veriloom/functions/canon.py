"""Canonical JSON as Column expressions: sorted keys, ", " and ": " between, floats as Python writes them.

Every hash and seal of this package is over these bytes, so there is one module for them.  Two modes: UTF-8 (non-ASCII
characters as they are) and ASCII (escaped as \\uXXXX, astral ones as surrogate pairs).
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_CONTROLS = r"[\x00-\x07\x0B\x0E-\x1F]"


def escape(text: Column, ascii_only: bool = False) -> Column:
    """The inside of a JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in _SHORT.items():
        out = F.replace(out, F.lit(raw), F.lit(short))
    rare = out
    for code in [c for c in range(32) if chr(c) not in _SHORT]:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(out.rlike(_CONTROLS), rare).otherwise(out)
    return _ascii(out) if ascii_only else out


def _ascii(text: Column) -> Column:
    def one(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.when((F.octet_length(ch) == 1) & (ch != "\x7f"), ch).otherwise(F.regexp_replace(units, "([0-9a-f]{4})", "\\\\u$1"))

    return F.when(text.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def string(text: Column, ascii_only: bool = False) -> Column:
    """A JSON string, or null."""
    return F.coalesce(F.concat(F.lit('"'), escape(text, ascii_only), F.lit('"')), F.lit("null"))


def boolean(flag: Column) -> Column:
    return F.coalesce(F.when(flag, F.lit("true")).otherwise(F.when(~flag, F.lit("false"))), F.lit("null"))


def integer(n: Column) -> Column:
    return F.coalesce(n.cast("string"), F.lit("null"))


@pandas_udf(StringType())
def _repr(x: pd.Series) -> pd.Series:
    import json

    return x.map(lambda v: None if v is None else json.dumps(float(v)), na_action=None)


def floating(x: Column, exact: bool = False) -> Column:
    """A double in Python's notation: exponents below 1e-4 and from 1e16 only.

    The native form has the right digits for values of up to 15 significant digits below 2**53, as clocks and scores are; Java writes
    some others with a digit more than needed.  `exact` takes Python's own digits, in Arrow batches.
    """
    if exact:
        return F.when(x.isNull(), F.lit("null")).otherwise(_repr(x))
    shown = x.cast("string")
    mantissa, power = F.split_part(shown, F.lit("E"), F.lit(1)), F.split_part(shown, F.lit("E"), F.lit(2)).cast("int")
    sign = F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mantissa, "[-.]", ""), "0+$", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    n = F.length(digits)
    large = F.when(n <= power + 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit(""))
    mark = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    scientific = F.concat(F.substring(digits, 1, 1), tail, mark)
    by_power = F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(scientific)
    special = F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("Infinity")).when(x == float("-inf"), F.lit("-Infinity"))
    plain = F.when(shown.contains("E"), F.concat(sign, by_power)).otherwise(shown)
    return F.coalesce(special, plain, F.lit("null"))


def array(items: Column) -> Column:
    """A JSON array of an array column of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def strings(items: Column, ascii_only: bool = False) -> Column:
    return array(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: string(x, ascii_only)))


def object_(fields: Mapping[str, Column | tuple[Column, Column]]) -> Column:
    """A JSON object of fixed keys, sorted.  A field given as (present, json) is left out where `present` is false."""
    parts = []
    for key in sorted(fields):
        value = fields[key]
        present, text = value if isinstance(value, tuple) else (F.lit(True), value)
        parts.append(F.when(present, F.concat(F.lit(f'"{key}": '), text)))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
