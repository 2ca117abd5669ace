"""Portable randomness: uniforms from hashes of keys, the same in any engine and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """sha-256 (hex) of the parts joined by '|'; strings are literals."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def u01(*parts: Column | str) -> Column:
    """A uniform in [0, 1) from the first 52 bits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)
