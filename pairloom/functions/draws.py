"""Seeded draws: a pure function of the row id, so a retried task repeats its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pairloom.functions.text import ColumnOrName, col

# 48 bits per draw: with a million outcomes the most likely one is drawn less than
# a hundred-millionth more often than the rarest.
HEX_PER_SLOT = 12
PER_HASH = 64 // HEX_PER_SLOT
HASHES = 2
SLOTS = PER_HASH * HASHES


def digest(seed: int, *ids: ColumnOrName) -> Column:
    """Hex digits for ``SLOTS`` independent draws per row."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(i).cast("string") for i in ids])
    return F.concat(F.sha2(text, 256), *[F.sha2(F.concat(text, F.lit(f":{k}")), 256) for k in range(1, HASHES)])


def draw(digest_: ColumnOrName, slot: int, n: int | Column) -> Column:
    """Number in [0, n) from one slot of the digest."""
    if not 0 <= slot < SLOTS:
        raise ValueError(f"slot must lie in [0, {SLOTS})")
    at = slot // PER_HASH * 64 + slot % PER_HASH * HEX_PER_SLOT
    part = F.substring(col(digest_), at + 1, HEX_PER_SLOT)
    return F.conv(part, 16, 10).cast("bigint") % n


def pick(options: Sequence[str] | Column, index: Column) -> Column:
    """Element at a zero-based index."""
    if not isinstance(options, Column):
        options = F.array(*[F.lit(o) for o in options])
    return F.get(options, index.cast("int"))


def share(seed: int, *ids: ColumnOrName) -> Column:
    """Number in [0, 1) per row."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
