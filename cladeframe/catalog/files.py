"""Registered queries that write files of derived alignments and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.catalog import oracle_views as O
from cladeframe.catalog import traces as TR
from cladeframe.catalog import views as V
from cladeframe.catalog.registry import Registry
from cladeframe.catalog.trees import _newick_sql, names6
from cladeframe.operators import trace as R
from cladeframe.operators import validate
from cladeframe.session import scratch_path, spread
from cladeframe.sources import alignments as A
from cladeframe.sources import blocks, fasta
from cladeframe.sources.paths import write_files

registry = Registry()
query = registry.query
K = 10
HALF = 32

_ALN = O.sql(O.vector_alignments(K), query="SELECT alignment_id, taxon_id, name, seq FROM aln")


def small_alignments(spark, sf_dir) -> DataFrame:
    return V.vector_alignments(spark, sf_dir, K)


def file_texts(sequences: DataFrame, fmt: str) -> DataFrame:
    """Text of one file per alignment of K taxa, for the readers to read."""
    first, second = F.substring("seq", 1, HALF), F.substring("seq", HALF + 1, HALF)
    name = F.rpad("name", 10, " ")
    lines = {
        # sequential: every taxon on two lines, bases in groups of eight
        "phylip": (F.concat(name, F.regexp_replace(first, "(.{8})", "$1 "), F.lit("\n"), second), None),
        "interleaved": (F.concat(name, first), second),
        "nexus": (F.concat("name", F.lit("    "), first), F.concat("name", F.lit("    "), second)),
        "clustal": (F.concat(F.rpad("name", 16, " "), first), F.concat(F.rpad("name", 16, " "), second)),
    }[fmt]
    top = F.transform(F.array_sort(F.collect_list(F.struct("taxon_id", lines[0].alias("s")))), lambda x: x["s"])
    top = F.array_join(top, "\n")
    if lines[1] is None:
        low = F.lit("")
    else:
        low = F.transform(F.array_sort(F.collect_list(F.struct("taxon_id", lines[1].alias("s")))), lambda x: x["s"])
        low = F.array_join(low, "\n")
    marks = " " * 16 + "*" * 5
    text = {
        "phylip": lambda: F.concat(F.lit(f" {K} 64\n"), top),
        "interleaved": lambda: F.concat(F.lit(f" {K} 64\n"), top, F.lit("\n\n"), low),
        "nexus": lambda: F.concat(
            F.lit(f"#NEXUS\nbegin data;\ndimensions nchar=64 ntax={K};\nformat datatype=dna interleave=yes gap=-;\nmatrix\n"),
            top, F.lit("\n\n"), low, F.lit("\n;\nend;"),
        ),
        "clustal": lambda: F.concat(
            F.lit("CLUSTAL 2.1 multiple sequence alignment\n\n\n"), top, F.lit(f"\n{marks}\n\n"), low, F.lit(f"\n{marks}")
        ),
    }[fmt]()
    # few bytes are many files, and a file costs much more than its bytes: the number of tasks is not left to their size
    return spread(sequences, "alignment_id").groupBy("alignment_id").agg(text.alias("value"))


def written(spark, sf_dir, fmt: str) -> str:
    """Write one file per alignment below a fresh folder and give the folder."""
    path = scratch_path(spark, fmt)
    if fmt == "fasta":
        fasta.write_fasta(small_alignments(spark, sf_dir), path)
    else:
        write_files(file_texts(small_alignments(spark, sf_dir), fmt), path)
    return path


@query("read_fasta", _ALN)
def read_fasta(spark, sf_dir):
    return fasta.read_fasta(spark, written(spark, sf_dir, "fasta"))


@query("read_phylip", _ALN)
def read_phylip(spark, sf_dir):
    return blocks.read_phylip(spark, written(spark, sf_dir, "phylip"))


@query("read_nexus", _ALN)
def read_nexus(spark, sf_dir):
    return blocks.read_nexus(spark, written(spark, sf_dir, "nexus"))


@query("read_clustal", _ALN)
def read_clustal(spark, sf_dir):
    return blocks.read_clustal(spark, written(spark, sf_dir, "clustal"))


@query(
    "read_alignments",
    O.sql(
        O.vector_alignments(K),
        query="""SELECT * FROM aln, (SELECT unnest(['fasta', 'phylip', 'interleaved', 'nexus', 'clustal']) AS format)""",
    ),
)
def read_alignments(spark, sf_dir):
    """The same alignments by way of every format."""
    readers = {"fasta": "fasta", "phylip": "phylip", "interleaved": "phylip", "nexus": "nexus", "clustal": "clustal"}
    rows = [A.read_alignments(spark, written(spark, sf_dir, f), r).withColumn("format", F.lit(f)) for f, r in readers.items()]
    return reduce(DataFrame.unionByName, rows)


@query(
    "write_fasta",
    O.sql(
        O.vector_alignments(K),
        query="""SELECT alignment_id, taxon_id,
                        '>' || name || chr(10) || substr(seq, 1, 60) || chr(10) || substr(seq, 61) AS record FROM aln""",
    ),
)
def write_fasta(spark, sf_dir):
    return small_alignments(spark, sf_dir).select(
        "alignment_id", "taxon_id", fasta.fasta_record(F.col("name"), F.col("seq")).alias("record")
    )


@query("write_trees", f"SELECT newick AS line, count(*) AS trees FROM ({_newick_sql()}) GROUP BY newick")
def write_trees(spark, sf_dir):
    path = scratch_path(spark, "newick")
    A.write_trees(V.trees6(spark, sf_dir), names6(), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("trees"))


@query(
    "run_log",
    O.sql(
        O.TRACE, TR._BEST,
        query="""SELECT 'cladeframe' AS "Implementation", "Rearrangements", "Topologies", "Score", 0.0::DOUBLE AS "Runtime",
                        count(*) AS rows
                 FROM (SELECT count(*) AS "Rearrangements", arg_max(best_set_size, iter) AS "Topologies",
                              min(length) AS "Score" FROM sized GROUP BY run_id) GROUP BY ALL""",
    ),
)
def run_log(spark, sf_dir):
    path = scratch_path(spark, "log")
    summary = R.run_summary(V.trace(spark, sf_dir), F.lit(90))
    A.append_run_log(A.log_rows(summary, "cladeframe", F.lit(0.0)), path)
    log = spark.read.option("sep", "\t").option("header", True).schema(
        "Implementation string, Rearrangements bigint, Topologies bigint, Score bigint, Runtime double"
    ).csv(path)
    return log.groupBy(*log.columns).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "trace_sink",
    O.sql(
        TR._TRACE_ONCE, TR._BEST, TR.epochs_sql(R.MAX_ACCEPT, R.MAX_PROPOSE), recursive=True,
        query=f"""SELECT s.run_id, s.iter AS "Iteration", move AS "Algorithm", s.accepted AS "Accepted", length AS "Length",
                         round({TR._TEMPERATURE} * 10000, 6) AS "Temperature", best_set_size AS "Treestack Size"
                  FROM sized s JOIN walk w ON s.run_id = w.run_id AND s.iter = w.iter""",
    ),
)
def trace_sink(spark, sf_dir):
    path = scratch_path(spark, "trace")
    sizes = R.running_best(V.trace(spark, sf_dir)).select("run_id", "iter", "best_set_size")
    rows = A.trace_rows(TR.with_temperature(spark, sf_dir).join(sizes, ["run_id", "iter"]))
    A.write_trace(rows, path)
    return spark.read.option("sep", "\t").option("header", True).schema(rows.schema).csv(path)


@query(
    "validate_source",
    O.sql(
        O.vector_alignments(K),
        query="""SELECT alignment_id, 'no_sequences' AS rule FROM aln
                 WHERE taxon_id = 0 AND substr(seq, 1, 1) = 'A'""",
    ),
)
def validate_source(spark, sf_dir):
    """Alignments whose first base is ``A`` come as CLUSTAL files, which no FASTA record can be read from."""
    path = scratch_path(spark, "mixed")
    rows = small_alignments(spark, sf_dir)
    odd = rows.filter("taxon_id = 0 AND substr(seq, 1, 1) = 'A'").select("alignment_id")
    write_files(file_texts(rows.join(odd, "alignment_id", "left_semi"), "clustal"), path)
    fasta.write_fasta(rows.join(odd, "alignment_id", "left_anti"), path, mode="append")
    return validate.sources(spark, path, A.read_alignments(spark, path, "fasta")).select("alignment_id", "rule")
