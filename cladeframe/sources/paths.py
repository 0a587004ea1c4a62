"""Which alignment a file belongs to, and how files are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alignment_of(path: Column) -> Column:
    """``x`` for files below a folder ``alignment_id=x``, else the whole path."""
    folder = F.regexp_extract(path, "alignment_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(path)


def write_files(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``alignment_id, value`` as text, one folder ``alignment_id=x`` per alignment.

    Tasks put their files in place themselves: the driver would move one after the other. A task that is run again writes files of
    the same names.
    """
    own_moves = rows.write.mode(mode).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    own_moves.partitionBy("alignment_id").text(path)
