"""Key hashes for splits, folds and samples.

The hash is a function of the key and a seed only, so a row keeps its place however the
table is partitioned and however often a task is retried. MD5 gives the same bits on every
engine; 52 bits fit a double exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def key_bits(keys: Sequence[Column], seed: int | str) -> Column:
    """A 52-bit integer drawn from the text form of the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")
