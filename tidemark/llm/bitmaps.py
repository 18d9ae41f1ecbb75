"""Sets of hashes as bitmaps of bounded size, which may be broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the least and largest size (32 MiB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28


class Bits:
    """A set of hashes as a bitmap of bounded size: it may hold more than was put in, never less."""

    def __init__(self, keys: DataFrame, n: int):
        size = LEAST_BITS
        while size < min(MOST_BITS, BITS_A_KEY * n):
            size *= 2
        place = keys.select(F.expr(f"pmod(key, {size}L) + 1 AS p")).select(F.expr("bitmap_bucket_number(p) AS bucket"), F.expr("bitmap_bit_position(p) AS at"))
        self.bits = np.zeros(size // 8, np.uint8)
        for bucket, some in place.groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)")).toLocalIterator():
            self.bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(some, np.uint8)

    def have(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
