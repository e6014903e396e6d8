"""The partition of an id: sha256 of its UTF-8 bytes, as a number, modulo the
number of partitions.  The digest has 256 bits, so it is folded eight hex
digits at a time."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTITIONS = 271


def partition_of(vector_id: Column, num_partitions: int = PARTITIONS) -> Column:
    """Partition number (int) of an id column."""
    digest = F.sha2(vector_id.cast("string"), 256)
    value = F.lit(0).cast("long")
    for k in range(0, 64, 8):
        chunk = F.conv(F.substring(digest, k + 1, 8), 16, 10).cast("long")
        value = F.pmod(value * F.lit((1 << 32) % num_partitions) + chunk, F.lit(num_partitions).cast("long"))
    return value.cast("int")


def partition_of_id(vector_id: str, num_partitions: int = PARTITIONS) -> int:
    """The same for one id, on the driver: it turns a point lookup into partition pruning."""
    return int(hashlib.sha256(vector_id.encode()).hexdigest(), 16) % num_partitions
