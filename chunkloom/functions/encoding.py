"""Inline values, templates, fill values and numeric decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "base64:"


def encode_inline(raw: Column) -> Column:
    """Bytes as text: ASCII as it is, else base64 behind a prefix."""
    ascii_only = F.hex(raw).rlike("^([0-7][0-9A-F])*$")
    return F.when(ascii_only, F.decode(F.when(ascii_only, raw).otherwise(F.lit(b"")), "US-ASCII")).otherwise(F.concat(F.lit(PREFIX), F.base64(raw)))


def encode_json_value(raw: Column) -> Column:
    """Bytes as text: minified if they hold a JSON object or list, else UTF-8, else base64."""
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    small = F.when(text.rlike(r"^\s*[\[{]"), F.to_json(F.try_parse_json(text)))
    return F.coalesce(small, text, F.concat(F.lit(PREFIX), F.base64(raw)))


def decode_inline(text: Column) -> Column:
    """The bytes of an inline value."""
    return F.when(text.startswith(PREFIX), F.unbase64(F.substr(text, F.lit(len(PREFIX) + 1)))).otherwise(F.encode(text, "UTF-8"))


def render_template(path: Column, name: str, value: Column) -> Column:
    """Put a value in place of ``{{name}}``."""
    return F.replace(path, F.lit("{{" + name + "}}"), value)


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of a set of strings, from its smallest and largest."""
    n = F.least(F.char_length(low), F.char_length(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: low.substr(F.lit(1), i) == high.substr(F.lit(1), i))
    return low.substr(F.lit(1), F.array_max(same))


def physical(raw: Column, scale: Column, zero: Column) -> Column:
    """Stored values to physical ones: raw * scale + zero."""
    return raw * F.coalesce(scale, F.lit(1.0)) + F.coalesce(zero, F.lit(0.0))


def big_endian(raw: Column) -> Column:
    """An unsigned big-endian integer of up to 8 bytes."""
    return F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")


def encode_fill_value(value: Column, kind: Column) -> Column:
    """A fill value as JSON metadata has it, by the dtype's kind letter."""
    low = F.lower(value)
    floats = F.when(low.isin("nan"), "NaN").when(low.isin("inf", "+inf", "infinity"), "Infinity").when(low.isin("-inf", "-infinity"), "-Infinity").otherwise(value.cast("double").cast("string"))
    return (
        F.when(value.isNull(), F.lit(None))
        .when(kind == "f", F.when(low.isin("nan", "inf", "+inf", "infinity", "-inf", "-infinity"), floats).otherwise(F.try_to_number(value, F.lit("S999999999999.999999")).cast("double").cast("string")))
        .when(kind.isin("i", "u", "m", "M"), value.cast("double").cast("bigint").cast("string"))
        .when(kind == "b", F.when(low.isin("true", "1"), "true").otherwise("false"))
        .when(kind.isin("S", "V"), F.base64(F.encode(value, "UTF-8")))
        .otherwise(value)
    )


def step_hours(valid: Column, run: Column) -> Column:
    """Hours between a run and its valid time."""
    return (F.unix_micros(valid.cast("timestamp")) - F.unix_micros(run.cast("timestamp"))) / F.lit(3600e6)


def edited_json(text: Column, **changed: Column) -> Column:
    """A JSON object's text with some of its members replaced."""
    kept = F.map_filter(F.from_json(text, "map<string,variant>"), lambda n, _: ~n.isin(*changed))
    new = F.create_map(*[x for n, v in changed.items() for x in (F.lit(n), F.to_variant_object(v))])
    return F.to_json(F.map_concat(kept, new))
