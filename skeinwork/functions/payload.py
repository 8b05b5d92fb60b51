"""Byte-level helpers on binary columns and the protocol tests built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork import constants as C


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def take(data: Column, offset: int, length: int) -> Column:
    return F.substring(data, offset + 1, length)


def uint_be(data: Column, offset: int, width: int) -> Column:
    """Unsigned big-endian integer at a byte offset; null when the bytes are not there."""
    raw = take(data, offset, width)
    return F.when(F.octet_length(raw) == width, F.conv(F.hex(raw), 16, 10).cast("long"))


def uint_le(data: Column, offset: int, width: int) -> Column:
    raw = F.hex(take(data, offset, width))
    swapped = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.length(raw) == 2 * width, F.conv(swapped, 16, 10).cast("long"))


def signed(value: Column, width: int) -> Column:
    top = 1 << (8 * width - 1)
    return F.when(value >= top, value - F.lit(1 << (8 * width)) if width < 8 else value).otherwise(value)


def int_be(data: Column, offset: int, width: int) -> Column:
    return signed(uint_be(data, offset, width), width)


def typed_attr(attrs: Column, key: str, width: int, is_signed: bool) -> Column:
    """Integer attribute stored as host-order (little-endian) bytes; a missing or short one reads as 0."""
    raw = F.try_element_at(attrs, F.lit(key))
    if width == 8:
        hexed = F.hex(raw)
        swapped = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(8))])
        # conv to base -10 reads the 64 bits as a signed number, which is what a long column can hold.
        value = F.when(F.octet_length(raw) >= 8, F.conv(swapped, 16, -10).cast("long"))
    else:
        value = uint_le(raw, 0, width)
        if is_signed:
            value = signed(value, width)
    return F.coalesce(value, F.lit(0).cast("long"))


def ascii_text(data: Column) -> Column:
    """Bytes as text with ``.`` for everything outside 0x20..0x7e (each byte on its own)."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7e]", ".")


def utf8_text(data: Column) -> Column:
    """Bytes as UTF-8 text. A character that the end of the bytes cuts off is dropped, other broken bytes read as U+FFFD."""
    more = "[89AB][0-9A-F]"
    cut = f"(?:[CD][0-9A-F]|E[0-9A-F](?:{more})?|F[0-7](?:{more}){{0,2}})"
    whole = F.regexp_extract(F.hex(data), f"^((?:..)*?){cut}?$", 1)
    return F.make_valid_utf8(F.unhex(whole).cast("string"))


def payload_preview(data: str | Column, protocol: str | Column, limit: int = C.PAYLOAD_BYTES) -> Column:
    data, protocol = _col(data).cast("binary"), _col(protocol)
    text = F.when(protocol.isin("http", "redis"), utf8_text(take(data, 0, limit)))
    text = text.when(protocol == "dubbo", ascii_text(take(data, 16, limit)))
    return F.coalesce(text.otherwise(ascii_text(take(data, 0, limit))), F.lit(""))
