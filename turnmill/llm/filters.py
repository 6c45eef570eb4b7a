"""Filters of fixed size that keep rows without candidates from being worked on.

A filter has one bit for each slot that occurs. A row whose bit is not set is
surely not wanted; one whose bit is set is checked by the exact join that
follows. So a full filter costs speed, never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24


def slot_filter(rows: DataFrame, slot: Column) -> np.ndarray:
    """The slots that occur in `rows`, as one bit each of 2**FILTER_BITS."""
    parts = rows.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
    bits = np.zeros((1 << FILTER_BITS) // 8 + (1 << 16), np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect():
        low = (row["b"] - 1) * 4096
        bits[low : low + 4096] |= np.frombuffer(bytes(row["m"]), np.uint8)
    return bits


def passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Bit positions count from bucket 1 at slot 1: see bitmap_bucket_number."""
    at = slots.astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def doc_slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << FILTER_BITS)).cast("long") + 1
