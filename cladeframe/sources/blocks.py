"""PHYLIP, NEXUS and CLUSTAL files.

A file of any size is read by as many tasks as it has blocks. Every line gets its number in its
block and the number of sequence lines before it; a short table with one row per block
turns these into numbers in the file. What a file's layout depends on (header, first
data line, gaps between data lines, number of lines) are minima, maxima and counts over its lines, so no task
sees a whole file. The lines of a taxon then meet by (file, taxon).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions import sequences as S
from cladeframe.functions.kernels import line_batches
from cladeframe.session import materialise
from cladeframe.sources.paths import alignment_of

# Length of a PHYLIP name, and the characters a line of PHYLIP data ends in.
NAME = 10
DATA_END = "ABCDEFGHIKLMNPQRSTVWXYZabcdefghiklmnpqrstvwxyz*?-"
COUNTS = r"^[+-]?\d+\s+[+-]?\d+"


class _Lines:
    """Lines of files, numbered: ``path, no, rank, value`` and flags.

    ``no`` counts all lines of a file, ``rank`` the full ones before a line; only full lines and those with a flag are kept, in a table in the
    shared folder. ``blocks`` has a row per block of a file, on which values of files travel to their lines.
    """

    def __init__(self, spark: SparkSession, path: str, text: Column, full: Column, flags: dict[str, Column]):
        raw = spark.read.option("lineSep", "\n").text(path)
        lines = raw.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), text.alias("value")
        ).withColumns({"full": full, **flags})
        keep = F.col("full")
        for name in flags:
            keep |= F.col(name)
        schema = "path string, block bigint, i bigint, k bigint, value string, full boolean" + "".join(f", {f} boolean" for f in flags)
        self.table = materialise(lines.withColumn("keep", keep).mapInArrow(line_batches, schema), "lines")
        before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ends = self.table.where("value IS NULL").select("path", "block", "i", "k")
        self.blocks = ends.select(
            "path", "block", F.coalesce(F.sum("i").over(before), F.lit(0)).alias("line0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("full0")
        )

    def know(self, files: DataFrame, how: str = "inner") -> None:
        """Give every line the values of its file from now on; ``inner`` leaves other files out."""
        self.blocks = self.blocks.join(files, "path", how)

    def rows(self) -> DataFrame:
        placed = self.table.where("value IS NOT NULL").join(self.blocks, ["path", "block"])
        return placed.withColumns({"no": F.col("line0") + F.col("i"), "rank": F.col("full0") + F.col("k")}).drop("line0", "full0", "i", "k", "block")

    def first(self, flag: Column, *values: Column) -> DataFrame:
        """The first line of each file that passes: ``path`` and ``s``, a struct of its ``no``, ``rank`` and ``value``."""
        return self.rows().where(flag).groupBy("path").agg(F.min(F.struct("no", "rank", "value")).alias("s"))


def _plain() -> Column:
    return F.rtrim(F.translate("value", "\r", " "))


def _gap() -> Column:
    """Lines that are no data between the first data line and this one."""
    return (F.col("no") - F.col("rank")) - (F.col("first_no") - F.col("first_rank"))


def _taxa(data: DataFrame, taxon: Column, piece_no: Column, name, piece) -> DataFrame:
    """Put the lines of each taxon together; ``name(line)`` is read off its first one, ``piece(line, k)`` off its k-th."""
    lines = data.select("path", taxon.cast("int").alias("taxon_id"), piece_no.cast("int").alias("k"), "value")
    parts = lines.select(
        "path", "taxon_id", "k", F.when(F.col("k") == 0, name(F.col("value"))).alias("name"), piece(F.col("value"), F.col("k")).alias("piece")
    )
    rows = parts.groupBy("path", "taxon_id").agg(F.max("name").alias("name"), F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
    return rows.select(
        alignment_of(F.col("path")).alias("alignment_id"), "taxon_id", "name", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq")
    )


def _phylip(spark: SparkSession, path: str) -> tuple[_Lines, DataFrame]:
    """Lines that know their file's ``n, m``, first data line and layout; and ``path, n, m`` of each file with a header."""
    value = F.col("value")
    lines = _Lines(
        spark, path, S.trim_chars(value), value != "",
        {"counts": value.rlike(COUNTS), "ends": (value != "") & (F.instr(F.lit(DATA_END), F.right(value, F.lit(1))) > 0)},
    )
    number = r"[+-]?(\d+)"
    heads = lines.first(F.col("counts")).select(
        "path", F.col("s.no").alias("head_no"),
        F.regexp_extract("s.value", "^" + number, 1).cast("int").alias("n"),
        F.regexp_extract("s.value", r"^[+-]?\d+\s+" + number, 1).cast("int").alias("m"),
    )
    lines.know(heads)
    lines.know(
        lines.first(F.col("ends") & (F.col("no") > F.col("head_no"))).select(
            "path", F.col("s.no").alias("first_no"), F.col("s.rank").alias("first_rank")
        )
    )
    data = lines.rows().where("full AND no >= first_no")
    shape = data.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), (F.max(_gap()) > 0).alias("interleaved"), F.count(F.when(_gap() == 0, 1)).alias("first_block")
    )
    lines.know(shape)
    return lines, heads.select("path", "n", "m")


def _phylip_data(spark: SparkSession, path: str) -> DataFrame:
    """Data lines with ``taxon`` and ``k``, the number of the line in its taxon.

    The header's count only tells sequential files from those with one line each.
    """
    lines, _ = _phylip(spark, path)
    sequential = ~F.col("interleaved") & (F.col("n") > 0) & (F.col("lines") > F.col("n")) & (F.pmod("lines", F.greatest("n", F.lit(1))) == 0)
    j = F.col("rank") - F.col("first_rank")
    per = F.floor(F.col("lines") / F.greatest("n", F.lit(1)))
    shown = F.when(F.col("interleaved"), F.col("first_block")).otherwise(F.col("lines"))
    return (
        lines.rows().where("full AND no >= first_no")
        .withColumn("taxon", F.when(sequential, F.floor(j / per)).otherwise(j % shown))
        .withColumn("k", F.when(sequential, j % per).otherwise(F.floor(j / shown)))
    )


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """PHYLIP files: names of exactly 10 characters, sequences without digits and blanks.

    Interleaved when data goes on after a blank line, the first block giving the taxa;
    else sequential when the number of data lines is a multiple of the header's number of
    taxa; else one line each. Rows beyond the header's number are rows of their own,
    for ``validate.counts`` to find.
    """
    return _taxa(
        _phylip_data(spark, path), F.col("taxon"), F.col("k"),
        lambda s: S.trim_chars(F.substring(s, 1, NAME)),
        lambda s, k: S.strip_digits_blanks(F.when(k == 0, F.substring(s, NAME + 1, 2**31 - 1)).otherwise(s)),
    )


def phylip_name_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of PHYLIP files that a taxon starts on: ``alignment_id, line, text``."""
    starts = _phylip_data(spark, path).where("k = 0")
    return starts.select(alignment_of(F.col("path")).alias("alignment_id"), F.col("taxon").cast("bigint").alias("line"), F.col("value").alias("text"))


def phylip_headers(spark: SparkSession, path: str) -> DataFrame:
    """Declared sizes of PHYLIP files: ``alignment_id, n, m``."""
    return _phylip(spark, path)[1].select(alignment_of(F.col("path")).alias("alignment_id"), "n", "m")


def _nexus(spark: SparkSession, path: str) -> tuple[_Lines, DataFrame]:
    """Lines that know their file's ``n, m`` and where its matrix is; and ``path, n, m`` of each file with a matrix."""
    value = F.col("value")
    lines = _Lines(
        spark, path, S.trim_chars(value), value != "",
        {"dims": value.contains("dimensions"), "matrix": value.contains("matrix"), "stop": value.contains(";")},
    )
    sizes = lines.first(F.col("dims")).select(
        "path",
        F.regexp_extract("s.value", r"ntax\s*=\s*(\d+)", 1).try_cast("int").alias("n"),
        F.regexp_extract("s.value", r"nchar\s*=\s*(\d+)", 1).try_cast("int").alias("m"),
    )
    heads = lines.first(F.col("matrix")).select("path", F.col("s.no").alias("head_no")).join(sizes, "path", "left")
    lines.know(heads)
    lines.know(lines.first(F.col("stop") & (F.col("no") > F.col("head_no"))).select("path", F.col("s.no").alias("end_no")), "left")
    return lines, heads.select("path", "n", "m")


def read_nexus(spark: SparkSession, path: str) -> DataFrame:
    """NEXUS files: lines between ``matrix`` and ``;``, the last token being sequence.

    After one line per taxon further lines go on with the first taxon, where the
    number of lines is a multiple of the header's number of taxa. Otherwise each line
    is a row of its own, for ``validate.counts`` to find.
    """
    lines, _ = _nexus(spark, path)
    body = F.col("full") & (F.col("no") > F.col("head_no")) & (F.col("end_no").isNull() | (F.col("no") < F.col("end_no")))
    lines.know(lines.rows().where(body).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min("rank").alias("first_rank")))
    declared = F.coalesce("n", F.lit(0))
    whole = F.pmod("lines", F.greatest(declared, F.lit(1))) == 0
    taxa = F.when(whole, F.least(declared, F.col("lines"))).otherwise(F.col("lines"))
    j = F.col("rank") - F.col("first_rank")
    data = lines.rows().where(body & (declared > 0))
    return _taxa(data, j % taxa, F.floor(j / taxa), S.leading_tokens, lambda s, _: S.last_token(s))


def nexus_headers(spark: SparkSession, path: str) -> DataFrame:
    """Declared sizes of NEXUS files, in whichever order they are given: ``alignment_id, n, m``."""
    return _nexus(spark, path)[1].select(alignment_of(F.col("path")).alias("alignment_id"), "n", "m")


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """CLUSTAL files: blocks of ``name sequence`` after a ``CLUSTAL`` line.

    Lines that start with a blank or have a single token (conservation marks) are
    no sequence lines. The first block gives the number of taxa.
    """
    value = F.col("value")
    lines = _Lines(
        spark, path, _plain(), ~value.startswith(" ") & (F.size(S.tokens(value)) > 1), {"head": value.contains("CLUSTAL")}
    )
    lines.know(lines.first(F.col("head")).select("path", F.col("s.no").alias("head_no")))
    data = F.col("full") & (F.col("no") > F.col("head_no"))
    lines.know(lines.first(data).select("path", F.col("s.no").alias("first_no"), F.col("s.rank").alias("first_rank")))
    lines.know(lines.rows().where(data).groupBy("path").agg(F.count(F.when(_gap() == 0, 1)).alias("n")))
    j = F.col("rank") - F.col("first_rank")
    return _taxa(lines.rows().where(data), j % F.col("n"), F.floor(j / F.col("n")), S.leading_tokens, lambda s, _: S.last_token(s))
