"""One value per group, put to the rows of the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 16  # parts of a large group


def with_group_value(rows: DataFrame, values: DataFrame, group: list[str]) -> DataFrame:
    """Join ``values``, one row per group, to the rows of each group.

    Where Spark doesn't send ``values`` to all tasks, the rows of a large group are dealt to ``SALTS`` parts, each with its own
    copy of the group's row.
    """
    own = [c for c in rows.columns if c not in group and not isinstance(rows.schema[c].dataType, T.MapType)]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*(own or group)), F.lit(SALTS)))
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*group, "_salt"]).drop("_salt")
