"""Join a large side to a table that is expected, not known, to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.running import HotGroups, null_safe_join

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
SALTS = 64


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Broadcast ``right`` when its rows and their bytes prove small, else salt the join.

    The count stops after ``limit + 1`` rows; bytes are those of the rows as JSON, so wide
    arrays and maps count. The salted form keeps one hot key of the
    left side from landing in one task: the left key is split in SALTS parts and the
    right side repeated once per part.
    """
    on = list(on)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))
    rows, width = right.limit(limit + 1).agg(F.count("*"), size).first()
    if rows <= limit and (width or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    hashed = [f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    copies = right.withColumn("_salt", F.explode(every))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    *,
    hot: HotGroups,
    how: str = "left",
) -> DataFrame:
    """Join rows to a table on a group key whose groups may be huge on the left side.

    Only the rows of counted large groups are split over SALTS parts, and only their
    partners are repeated; everything else joins as written.
    """
    key = list(key)
    if hot.keys is None:
        return left.join(right, key, how)
    none, every = F.lit(0).cast("bigint"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    hashed = [f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = F.pmod(F.xxhash64(*hashed), F.lit(SALTS))
    if not hot.bounded:
        salted = left.withColumn("_salt", spread)
        return salted.join(right.withColumn("_salt", F.explode(every)), [*key, "_salt"], how).drop("_salt")
    flags = F.broadcast(hot.keys.withColumn("_hot", F.lit(True)))
    on = list(hot.key)
    salted = null_safe_join(left, flags, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(none))
    copies = null_safe_join(right, flags, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(none)))
    )
    joined = salted.drop("_hot").join(copies.drop("_hot"), [*key, "_salt"], how)
    return joined.drop("_salt")
