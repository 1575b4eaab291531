"""Parsing and formatting of fields, as column expressions. Unparsable fields are null unless a default is stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logs carry local time eight hours ahead of UTC.
LOCAL_SECONDS = 8 * 3600


def parse_double(s: Column) -> Column:
    """FN-1: optional sign, digits, fraction; no exponent."""
    return F.call_function("nullif", F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")


def parse_int(s: Column) -> Column:
    """FN-2: leading digits, 0 without any."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def parse_unsigned(s: Column) -> Column:
    """FN-3: up to 20 digits without sign, 0 without any."""
    return F.coalesce(F.regexp_extract(s, r"^\s*(\d+)", 1).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def parse_long(s: Column, default: int = 0) -> Column:
    """UTL-3: leading signed integer or a default."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(default).cast("long"))


def parse_hex(s: Column, default: int = 0) -> Column:
    """UTL-3/6: leading hexadecimal digits (0x allowed) or a default."""
    h = F.regexp_extract(s, r"^\s*(?:0[xX])?([0-9a-fA-F]{1,15})", 1)
    return F.when(h == "", F.lit(default).cast("long")).otherwise(F.conv(h, 16, 10).cast("long"))


def _epoch(s: Column, pattern: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(s, F.lit(pattern))) / 1_000_000


def parse_local(s: Column) -> Column:
    """FN-4/5: 'yyyy-MM-dd HH:mm:ss', a fraction is ignored; epoch seconds. The session's time zone must be UTC."""
    return F.floor(_epoch(F.substring(F.trim(s), 1, 19), "yyyy-MM-dd HH:mm:ss")).cast("long") - LOCAL_SECONDS


def parse_local_dmy(s: Column) -> Column:
    """FN-6: 'dd/MM/yyyy HH:mm:ss'."""
    return F.floor(_epoch(F.substring(F.trim(s), 1, 19), "dd/MM/yyyy HH:mm:ss")).cast("long") - LOCAL_SECONDS


def format_int(x: Column) -> Column:
    """FN-8."""
    return x.cast("string")


def format_double(d: Column, legacy: bool = False) -> Column:
    """FN-9: the shortest decimal; legacy: plain digits cut after eight characters."""
    plain = F.regexp_replace(d.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.substring(plain, 1, 8) if legacy else d.cast("string")


def round_half_down(d: Column) -> Column:
    """FN-10: up only above one half."""
    return F.when(d - F.floor(d) > 0.5, F.floor(d) + 1).otherwise(F.floor(d)).cast("long")


def compare(a: Column, b: Column) -> Column:
    """SEL-8: -1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def split_fields(s: Column, sep: str, skip_empty: bool = False) -> Column:
    """UTL-4."""
    parts = F.split(s, f"\\Q{sep}\\E", -1)
    return F.filter(parts, lambda x: x != "") if skip_empty else parts


def high_bits(x: Column) -> Column:
    """FN-21."""
    return F.shiftrightunsigned(x, 32)


def low_bits(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))
