import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cladeframe.operators import sites, validate
from cladeframe.plans import search
from cladeframe.sources import alignments as A
from cladeframe.sources import blocks, fasta
from tests import helpers as H


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    for name, (text, *_) in H.SMALL.items():
        H.put(folder, name, text)
    return A.read_alignments(spark, str(folder), "phylip").cache()


def as_rows(df):
    return [(r.name, r.seq) for r in df.orderBy("taxon_id").collect()]


FIVE = H.FIVE


def test_formats_agree(spark, tmp_path):
    H.put(tmp_path / "f", "x", H.FASTA)
    H.put(tmp_path / "n", "x", H.nexus(FIVE, 5, 8))
    H.put(tmp_path / "c", "x", H.clustal(FIVE, 5))
    H.put(tmp_path / "p", "x", H.SMALL["five"][0])
    for fmt, folder in (("fasta", "f"), ("nexus", "n"), ("phylip", "p"), ("clustal", "c")):
        assert as_rows(A.read_alignments(spark, str(tmp_path / folder), fmt)) == FIVE, fmt


def test_phylip_layouts(spark, tmp_path):
    H.put(tmp_path, "interleaved", H.phylip(H.LONG, 20, interleaved=True))
    H.put(tmp_path, "sequential", H.phylip(H.LONG, 20))
    H.put(tmp_path, "simple", H.phylip(H.LONG))
    rows = A.read_alignments(spark, str(tmp_path), "phylip")
    for layout in ("interleaved", "sequential", "simple"):
        assert as_rows(rows.filter(F.col("alignment_id") == layout)) == H.LONG, layout
    heads = {(r.n, r.m) for r in blocks.phylip_headers(spark, str(tmp_path)).collect()}
    assert heads == {(5, 47)}
    starts = blocks.phylip_name_lines(spark, str(tmp_path)).collect()
    assert {(r.alignment_id, r.line, r.text[:10]) for r in starts} == {
        (layout, i, n) for layout in ("interleaved", "sequential", "simple") for i, (n, _) in enumerate(H.LONG)
    }


def test_nexus_header_in_either_order(spark, tmp_path):
    H.put(tmp_path, "x", H.nexus(FIVE, 5, 8).replace("ntax=5 nchar=8", "nchar=8 ntax=5"))
    assert [(r.n, r.m) for r in blocks.nexus_headers(spark, str(tmp_path)).collect()] == [(5, 8)]
    assert as_rows(blocks.read_nexus(spark, str(tmp_path))) == FIVE


@pytest.mark.parametrize("fmt", ["phylip", "nexus"])
@pytest.mark.parametrize("declared", [4, 6])
def test_rows_that_the_header_does_not_declare(spark, tmp_path, fmt, declared):
    text = H.phylip(FIVE).replace(" 5 8", f" {declared} 8") if fmt == "phylip" else H.nexus(FIVE, declared, 8)
    H.put(tmp_path, "x", text)
    rows = A.read_alignments(spark, str(tmp_path), fmt)
    assert as_rows(rows) == FIVE
    heads = {"phylip": blocks.phylip_headers, "nexus": blocks.nexus_headers}[fmt](spark, str(tmp_path))
    found = [(r.rule, r.detail) for r in validate.validate(rows, heads).collect()]
    assert found == [("count_differs_from_header", f"5 of {declared}")]


def test_surplus_row_of_a_later_block_is_not_hidden(spark, tmp_path):
    H.put(tmp_path, "x", H.phylip(H.LONG, 20, interleaved=True) + "ACGTACG\n")
    rows = A.read_alignments(spark, str(tmp_path), "phylip")
    assert "unequal_lengths" in {r.rule for r in validate.validate(rows).collect()}


def test_short_name_line(spark, tmp_path):
    H.put(tmp_path, "x", " 5 1\n" + "".join(f"Sequence_{i}{c}\n" for i, c in enumerate("ACGT")) + "Short A\n")
    lines = blocks.phylip_name_lines(spark, str(tmp_path))
    found = validate.validate(A.read_alignments(spark, str(tmp_path), "phylip"), None, lines).collect()
    assert ("short_name_line", "4") in {(r.rule, r.detail) for r in found}


def test_gate(spark):
    good = frame(spark, [s for _, s in FIVE], "good")
    bad = frame(spark, ["ACG", "ACT", "AC", "AEG", "AOG"], "bad")
    rows = good.unionByName(bad)
    clean, refused = validate.gate(rows, validate.validate(rows))
    assert sorted(map(tuple, clean.select(good.columns).collect())) == sorted(map(tuple, good.collect()))
    assert {(r.alignment_id, r.taxon_id, tuple(r.rules)) for r in refused.collect()} == {
        ("bad", i, ("illegal_character", "unencodable_base", "unequal_lengths")) for i in range(5)
    }


def test_patterns_refuse_what_has_no_columns(spark):
    for seqs, message in (
        (["AAA", "CC", "GGGG"], "unequal length"), (["AO", "CC", "GG"], "nucleotide set"), (["A.", "C1", "G1"], "nucleotide set"),
    ):
        with pytest.raises(Exception, match=message):
            sites.site_patterns(frame(spark, seqs)).collect()


def test_cut_of_ragged_and_missing_rows(spark):
    seqs = ["ACGTA", "ACC", None, "", "TCGTé"]
    got = {r.taxon_id: r.seq for r in sites.cut_constant_sites(frame(spark, seqs)).collect()}
    # columns 0, 2 and 4 differ; the last letter has two bytes, of which the second is a column of its own
    assert got[0] == "AGA" and got[1] == "AC" and got[2] is None and got[3] == "" and got[4].startswith("TG")


def test_illegal_characters_make_a_column_variable(spark):
    rows = frame(spark, ["EAEZ1", "AAEA2", "AAEA3", "AAEQ4"])
    assert {r.site for r in sites.variable_sites(rows).collect()} == {0, 3}


def test_wrong_format_gives_no_sequences(spark, tmp_path):
    H.put(tmp_path, "x", "".join(f"{n}{' ' if i % 2 else chr(9)}{s}\n" for i, (n, s) in enumerate(FIVE)))
    for fmt in ("fasta", "phylip", "nexus", "clustal"):
        rows = A.read_alignments(spark, str(tmp_path), fmt)
        assert rows.count() == 0, fmt
        assert [r.rule for r in validate.sources(spark, str(tmp_path), rows).collect()] == ["no_sequences"]


def test_missing_path_and_format(spark, tmp_path):
    with pytest.raises(AnalysisException):
        A.read_alignments(spark, str(tmp_path / "nothing"), "fasta").count()
    with pytest.raises(ValueError):
        A.read_alignments(spark, str(tmp_path), "msf")


def test_fasta_split_over_tasks(spark, tmp_path):
    records = [(f"taxon {i}", "ACGT" * 50 + "-") for i in range(500)]
    H.put(tmp_path, "x", "".join(f">{n}\n{s}\n" for n, s in records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = fasta.read_fasta(spark, str(tmp_path))
        assert spark.read.option("lineSep", "\n>").text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert as_rows(rows) == records
        assert [r.taxon_id for r in rows.orderBy("taxon_id").collect()] == list(range(500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_before_the_first_header(spark, tmp_path):
    H.put(tmp_path, "x", "notes\nmore notes\n" + H.FASTA)
    H.put(tmp_path, "y", "\n \n" + H.FASTA)
    rows = fasta.read_fasta(spark, str(tmp_path))
    for name in ("x", "y"):
        own = rows.filter(F.col("alignment_id") == name)
        assert as_rows(own) == FIVE
        assert sorted(r.taxon_id for r in own.collect()) == list(range(5))


def test_fasta_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "out")
    fasta.write_fasta(small, path)
    back = fasta.read_fasta(spark, path)
    cols = ["alignment_id", "taxon_id", "name", "seq"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, small.select(cols).collect()))


def test_columns_and_minimum_length(small):
    kept = {r.alignment_id: (r.m, r.original_m) for r in sites.kept_columns(small).collect()}
    least = {r.alignment_id: r.min_len for r in sites.minimum_tree_length(small).collect()}
    for name, (text, m, min_len, *_) in H.SMALL.items():
        assert kept[name] == (m, int(text.split()[1])), name
        assert least[name] == min_len, name


def test_variable_and_excluded_are_all_sites(small):
    variable = {(r.alignment_id, r.site + 1) for r in sites.variable_sites(small).collect()}
    excluded = {
        (r.alignment_id, int(x)) for r in sites.excluded_sites(small).collect() for x in r.columns.split("\t")
    }
    every = {(n, i) for n, (t, *_) in H.SMALL.items() for i in range(1, int(t.split()[1]) + 1)}
    assert variable | excluded == every and not variable & excluded


def frame(spark, seqs, name="x"):
    rows = [(name, i, f"t{i}", s) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "alignment_id string, taxon_id int, name string, seq string")


def test_missing_only_column_counts_minus_one(spark):
    seqs = ["A-A", "ANC", "A-A", "ANC", "A-A"]
    assert sites.minimum_tree_length(frame(spark, seqs)).first().min_len == -1 + 1


def test_long_sequences_and_ragged_rows(spark, monkeypatch):
    monkeypatch.setattr(sites, "PIECE", 7)
    monkeypatch.setattr(sites, "BLOCK", 20)
    seqs = ["ACGTNACGTRACGT-CC", "ACGTAACGTYACGTACC", "ACCTNACGTRACGT-CG"]
    masks = {r.site: r.mask for r in sites.site_masks(frame(spark, seqs)).collect()}
    from cladeframe.functions.sequences import ACCEPTED
    assert masks == {i: sum(1 << ACCEPTED.index(c) for c in {s[i] for s in seqs}) for i in range(17)}
    patterns = {r.pattern: r.weight for r in sites.site_patterns(frame(spark, seqs)).collect()}
    want = {}
    for column in H.columns_of(seqs):
        key = "".join("0123456789ABCDEF"[x] for x in column)
        want[key] = want.get(key, 0) + 1
    assert patterns == want
    ragged = sites.site_masks(frame(spark, ["ACG", "AC", ""]))
    assert {r.site for r in ragged.collect()} == {0, 1, 2}


def test_rules(spark, tmp_path):
    assert {r.rule for r in validate.validate(frame(spark, ["ACG", "ACT", "ACG", "ACE", "AOG"])).collect()} == {
        "illegal_character", "unencodable_base",
    }
    assert {r.rule for r in validate.validate(frame(spark, ["ACG", "AT"])).collect()} == {
        "unequal_lengths", "taxa_out_of_range",
    }
    assert {r.rule for r in validate.validate(frame(spark, ["A"] * 5)).collect()} == {"no_variable_sites"}
    H.put(tmp_path, "bad", " 6 3\nSequence_1ACG\nSequence_2ACT\nSequence_3ACG\nSequence_4ACGT\nSequence_5ACG\n")
    rows = A.read_alignments(spark, str(tmp_path), "phylip")
    rules = {r.rule for r in validate.validate(rows, blocks.phylip_headers(spark, str(tmp_path))).collect()}
    assert {"count_differs_from_header", "length_differs_from_header", "unequal_lengths"} <= rules


def test_empty_rows_are_found(spark, tmp_path):
    H.put(tmp_path, "x", " 5 1\n" + "".join(f"Sequence_{i}\n" for i in range(1, 6)))
    rows = A.read_alignments(spark, str(tmp_path), "phylip")
    found = validate.validate(rows, blocks.phylip_headers(spark, str(tmp_path)))
    found = found.unionByName(validate.sources(spark, str(tmp_path), rows))
    assert found.count() > 0


@pytest.mark.parametrize("n", [5, 6])
def test_exact_search_goldens(spark, small, n):
    names = [k for k, v in H.SMALL.items() if int(v[0].split()[0]) == n]
    chosen = small.filter(F.col("alignment_id").isin(names))
    patterns = sites.site_patterns(sites.cut_constant_sites(chosen))
    best = search.exact_search(chosen.select("alignment_id").distinct(), patterns, n)
    got = {
        r.alignment_id: (r.length, r.trees)
        for r in best.groupBy("alignment_id").agg(F.min("length").alias("length"), F.count("*").alias("trees")).collect()
    }
    assert got == {k: H.SMALL[k][3:] for k in names}
