"""Digests and keyed seals as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The block size and pads of HMAC.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The key's inner and outer pads; a key above a block is its digest."""
    own = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ INNER for b in own), bytes(b ^ OUTER for b in own)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a text column."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def utc_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def chain_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(previous, F.lit("GENESIS")), payload), 256)


def safe_cell(c: Column) -> Column:
    """A text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_line(columns: list[Column]) -> Column:
    """One line, cells quoted where they hold a comma, a quote or a line break."""
    cells = []
    for c in columns:
        text = F.coalesce(safe_cell(c.cast("string")), F.lit(""))
        cells.append(F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *cells)
