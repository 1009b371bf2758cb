"""Seeded, engine-independent pseudo-randomness from md5 text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(",", *[c.cast("string") for c in cols])


def digest(*parts) -> Column:
    """32 hex digits of the comma-joined parts; Python values are literals, columns stay columns."""
    return F.md5(_text(*parts))


def draw(*parts) -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")
