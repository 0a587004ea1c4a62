"""Formats read from files of several blocks."""

import os

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import kernels
from cladeframe.session import scratch_path
from cladeframe.sources import alignments as A
from cladeframe.sources import blocks

TAXA, SITES = 40, 600


def matrix():
    return [(f"taxon{i}", "".join("ACGT-N"[(i * i + 3 * j + j * j // 7) % 6] for j in range(SITES))) for i in range(TAXA)]


def texts():
    rows, w = matrix(), 50
    parts = [[(n, s[a : a + w]) for n, s in rows] for a in range(0, SITES, w)]
    return {
        "phylip": f"\r\n {TAXA} {SITES}\r\n" + "\n".join(f"{n:10}" + "\n".join(s[a : a + w] for a in range(0, SITES, w)) for n, s in rows),
        "interleaved": f"{TAXA} {SITES}\n" + "\n \n".join("\n".join((f"{n:10}" if k == 0 else "") + f"{s[:25]} {s[25:]}" for n, s in p) for k, p in enumerate(parts)) + "\n\n",
        "simple": f"{TAXA} {SITES}\n" + "\n".join(f"{n:10}{s}" for n, s in rows) + "\n",
        "nexus": f"#NEXUS\nbegin data;\ndimensions ntax={TAXA} nchar={SITES};\nmatrix\n" + "\n\n".join("\n".join(f"{n}  {s}" for n, s in p) for p in parts) + "\n;\nend;\nx y;\n",
        "clustal": "junk line\nCLUSTAL 2.1\n\n" + "\n\n".join("\n".join(f"{n:16}{s}" for n, s in p) + "\n" + " " * 16 + "*  *" for p in parts) + "\n",
        "fasta": "".join(f">{n}\n{s}\n" for n, s in rows),
    }


@pytest.fixture(params=["128m", "1500"])
def block_bytes(request, spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("fmt", ["phylip", "interleaved", "simple", "nexus", "clustal", "fasta"])
def test_one_file_feeds_several_tasks(spark, block_bytes, fmt):
    path = scratch_path(spark, fmt).removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/one.txt", "w", newline="") as f:
        f.write(texts()[fmt])
    reader = "phylip" if fmt in ("interleaved", "simple") else fmt
    got = A.read_alignments(spark, path, reader).orderBy("taxon_id").collect()
    assert [(r.taxon_id, r.name, r.seq) for r in got] == [(i, n, s) for i, (n, s) in enumerate(matrix())]
    tasks = spark.read.option("lineSep", "\n").text(path).select(F.spark_partition_id()).distinct().count()
    assert (tasks > 1) == (block_bytes == "1500")


def test_headers_and_name_lines_of_split_files(spark, block_bytes):
    path = scratch_path(spark, "heads").removeprefix("file:")
    for name in ("phylip", "interleaved", "simple"):
        os.makedirs(f"{path}/alignment_id={name}")
        with open(f"{path}/alignment_id={name}/x.txt", "w", newline="") as f:
            f.write(texts()[name])
    assert {tuple(r) for r in blocks.phylip_headers(spark, path).collect()} == {(n, TAXA, SITES) for n in ("phylip", "interleaved", "simple")}
    lines = blocks.phylip_name_lines(spark, path).orderBy("alignment_id", "line").collect()
    assert [(r.line, r.text[:10].strip()) for r in lines] == [(i, n) for i, (n, _) in enumerate(matrix())] * 3


def test_files_without_an_alignment(spark):
    path = scratch_path(spark, "none").removeprefix("file:")
    os.makedirs(path)
    for name, text in {"a": "", "b": "no numbers here\n", "c": "3 4\n\n  \n", "d": "#NEXUS\nmatrix\n;\n", "e": "CLUSTAL\n\n * *\n"}.items():
        with open(f"{path}/{name}.txt", "w") as f:
            f.write(text)
    for fmt in ("phylip", "nexus", "clustal"):
        assert A.read_alignments(spark, path, fmt).count() == 0
    assert [(r.n, r.m) for r in blocks.phylip_headers(spark, path).collect()] == [(3, 4)]
    assert callable(kernels.line_batches)


@pytest.mark.parametrize("fmt", ["fasta", "phylip"])
def test_many_small_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch, fmt):
    from cladeframe.catalog import files

    rows = [(f"a{a:02d}", i, f"n{i}", "ACGT" * 16) for a in range(40) for i in range(files.K)]
    table = spark.createDataFrame(rows, "alignment_id string, taxon_id int, name string, seq string")
    monkeypatch.setattr(files, "small_alignments", lambda *_: table)
    monkeypatch.setattr(files, "scratch_path", lambda *_: str(tmp_path / fmt))
    path = files.written(spark, "", fmt)
    parts = {f.name.split("-")[1] for f in (tmp_path / fmt).glob("*/part-*")}
    assert len(parts) > 1
    got = A.read_alignments(spark, path, fmt).select("alignment_id", "taxon_id", "name", "seq").collect()
    assert sorted(map(tuple, got)) == rows
