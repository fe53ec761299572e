"""Which rows models may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def share(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on key alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
