"""Column helpers — all JVM-side expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**31 - 1, the modulus used for integer entity keys.
INT32_MOD = 2147483647


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """numpy-style clip: nulls stay null and NaN stays NaN (``least`` and
    ``greatest`` skip nulls, and Spark orders NaN above every number)."""
    c = col_(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(out)


def safe_div(num, den, default=0.0) -> Column:
    """num / den with a default on a zero or null denominator."""
    return F.coalesce(F.try_divide(col_(num), col_(den)), F.lit(default))


# The characters Python's str.isspace() accepts (str.strip() default).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace (a character
    trim, no regular expression)."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def is_ascii_digits(c) -> Column:
    return col_(c).rlike(r"^[0-9]+$")


def iso_millis_z(ts) -> Column:
    """ISO-8601 with milliseconds and a ``Z`` suffix."""
    return F.date_format(col_(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_utc(c) -> Column:
    """String or timestamp → timestamp; unparsable values become null."""
    c = col_(c)
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))


def bool_to_double(c) -> Column:
    return col_(c).cast("boolean").cast("double")


def fround(c, places: int = 2) -> Column:
    """Round a double as ``round(x * 10^p) / 10^p`` (halves away from zero).

    This works on the binary value like Python's ``round`` in nearly all
    cases (Spark's ``round`` uses the shortest decimal form instead) and is
    bit-identical to DuckDB's ``round(x, p)``.
    """
    m = float(10 ** places)
    return F.round(col_(c).cast("double") * F.lit(m), 0) / F.lit(m)


def cents(c) -> Column:
    """Money as whole cents (long): exact, order-independent sums."""
    return F.round(col_(c).cast("double") * F.lit(100.0), 0).cast("long")


def money_sum(c) -> Column:
    """Exact sum of a 2-decimal money column (summed as long cents).

    Double sums depend on the order rows arrive in; cents do not, so the
    result is reproducible across partitionings, retries and engines.
    """
    return F.sum(cents(c)) / F.lit(100.0)


def round4(c) -> Column:
    """Output rounding shared with the SQL oracle (see SURVEY 7.5)."""
    return fround(c, 4)


def hex_mod(digits: Column, modulus: int = INT32_MOD) -> Column:
    """Exact ``int(digits, 16) % modulus`` for hex strings of any length:
    fold 7-digit chunks as acc·16^len + chunk (mod m), all in long
    arithmetic (acc < 2^31, so acc·2^28 + chunk < 2^60)."""
    chunks = F.regexp_extract_all(digits, F.lit(".{1,7}"), 0)
    return F.aggregate(chunks, F.lit(0).cast("long"),
                       lambda acc, x: (acc * F.pow(F.lit(16.0), F.length(x)).cast("long")
                                       + F.conv(x, 16, 10).cast("long")) % F.lit(modulus))


def normalize_entity_id(c, modulus: int = INT32_MOD) -> Column:
    """Map int / digit strings / ``prefix_123`` / ``prefix_hex`` / other
    strings onto a stable non-negative integer key.

    * integers pass through
    * trimmed all-digit strings → that integer
    * ``x_<digits>`` → the digits; ``x_<hex>`` (optional sign / ``0x``, any
      length) → the hex value mod 2**31-1, exactly as Python's ``int(s, 16)``
    * anything else → first 15 hex digits of md5 mod 2**31-1 (stable across
      processes and engines, unlike a salted string hash)

    In the 31-bit key space two of 55,000 hashed ids collide with even odds;
    where keys need not fit it, ``modulus=2**60`` keeps all 60 bits of the hash
    (hex suffixes stay in the 31-bit space, as their exact rule says).
    """
    s = py_strip(col_(c).cast("string"))
    suffix = py_strip(F.substring_index(s, "_", -1))
    hex_ok = suffix.rlike(r"^[+-]?(0[xX])?[0-9a-fA-F]+$")
    digits = F.regexp_replace(suffix, r"^[+-]?(0[xX])?", "")
    v = hex_mod(digits)
    signed = F.when(suffix.startswith("-"), (F.lit(INT32_MOD) - v) % F.lit(INT32_MOD)).otherwise(v)
    hashed = F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long") % F.lit(modulus)
    raw_suffix = F.substring_index(s, "_", -1)
    return (
        F.when(is_ascii_digits(s), s.try_cast("long"))
        .when(s.contains("_") & is_ascii_digits(raw_suffix), raw_suffix.try_cast("long"))
        .when(s.contains("_") & hex_ok, signed)
        .otherwise(hashed)
    )


def numeric_columns(df, exclude_bool: bool = True) -> list[str]:
    """Names of numeric (non-boolean) columns, in schema order."""
    from pyspark.sql.types import NumericType, BooleanType
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType) and not (exclude_bool and isinstance(f.dataType, BooleanType)):
            out.append(f.name)
    return out
