import gzip
import os

import pytest
from pyspark.sql import functions as F

from merloom import cli, modes
from merloom.config import Settings
from merloom.operators import content, reads, reports, sequence_store
from merloom.sources import sequences, sinks, tables

NODES = [(1, 1, "no rank"), (10, 1, "superkingdom"), (20, 10, "phylum"), (30, 20, "genus"), (31, 30, "species"), (32, 30, "species"), (40, 31, "strain"), (50, 1, "genus")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES + [NODES[3]], "tax long, parent long, rank_name string")


def test_lift_rules(spark, nodes):
    n = reports.clean_nodes(nodes)
    t = spark.createDataFrame([(x,) for x in (40, 31, 30, 20, 50, 999, None)], "tax long")
    got = {x.tax: x.upper for x in reports.lift(n, t, "genus").collect()}
    # a genus right under the root gives the taxon itself, as do unknown taxa and paths without the rank
    assert got == {40: 30, 31: 30, 30: 30, 20: 20, 50: 50, 999: 999}


def test_roll_ups(spark, nodes):
    n = reports.clean_nodes(nodes)
    f = spark.createDataFrame([(40, 10.0), (32, 20.0), (50, 5.0), (999, 1.0)], "tax long, quantity double")
    assert {x.tax: x.quantity for x in reports.roll_up_to_rank(f, n, "genus").collect()} == {30: 30.0, 50: 5.0}
    names = spark.createDataFrame([(30, "G"), (31, "S")], "tax long, name string")
    p = {x.tax: x for x in reports.taxon_profile(f, n, names).collect()}
    assert p[30].percentage == 30.0 and p[10].percentage == 30.0 and p[40].path == "10|20|30|31|40" and p[31].name_path == "unnamed|unnamed|G|S"
    pie = reports.pie_rows(reports.taxon_profile(f, n, names)).collect()
    assert sum(x.value for x in pie) == pytest.approx(100.0)


def test_content_generate_merge_repair(spark, nodes):
    acc = spark.createDataFrame([("A.1",), ("A.2",), ("B.1",), ("X.9",), (None,), ("A.1",)], "accession string")
    m = spark.createDataFrame([("A.1", 31), ("A.2", 40), ("B.1", 32), ("X.9", None), ("Z.1", 31)], "accession string, tax long")
    names = spark.createDataFrame([(31, "Some, name", "scientific name"), (31, "other", "synonym")], "tax long, name string, name_class string")
    n = reports.clean_nodes(nodes)
    got = {x.tax: x for x in content.generate(acc, m, n, names, "species").collect()}
    assert got[31].name == "Some name" and got[31].sub_taxids == [31, 40] and got[31].accessions == ["A.1", "A.2"]
    assert got[32].name == "unnamed_0" and got[2**32 - 2].name == "EWAN_0"
    genus = {x.tax for x in content.generate(acc, m, n, names, "genus").collect()}
    assert genus == {30, 2**32 - 2}
    a = content.generate(acc, m, n, names, "species")
    both, renamed = content.merge(a, a)
    assert {x.tax for x in both.collect()} == {31, 32, 2**32 - 1, 2**32 - 2}
    assert sorted((x.side, x.old, x.new) for x in renamed.collect()) == [(1, 2**32 - 2, 2**32 - 1), (2, 2**32 - 2, 2**32 - 2)]
    fixed = {x.tax: x for x in content.repair(a.unionByName(a)).collect()}
    assert len(fixed) == 3 and fixed[31].accessions == ["A.1", "A.2"]
    assert content.level_or_default("nonsense") == "species"


def test_parsers(tmp_path, spark):
    def records(text):
        return list(sequences.parse(iter(text.splitlines(keepends=True))))

    assert records("") == [] and records("\n\n") == []
    assert records(">a b\nAC\nGT\n\n>c\n") == [("a b", "ACGT", None, 3), ("c", "", None, 0)]
    assert records("@a\nACGT\nAC\n+\nII@III\n@b\nA\n+a\n@\n") == [("a", "ACGTAC", "II@III", 2), ("b", "A", "@", 1)]
    with pytest.raises(ValueError):
        records("ACGT\n")
    with pytest.raises(ValueError):
        records("@a\nACGT\n+\nII\n")
    (tmp_path / "x.fa").write_text(">r1 x\nAC\r\nGT\r\n>r2\nTTT\n")
    with gzip.open(tmp_path / "y.txt", "wt") as f:
        f.write("@q\nACG\n+\nIII\n")
    got = sorted((os.path.basename(x.file), x.read_no, x.name, x.seq, x.qual) for x in sequences.read_sequences(spark, str(tmp_path)).collect())
    assert got == [("x.fa", 0, "r1 x", "ACGT", None), ("x.fa", 1, "r2", "TTT", None), ("y.txt", 0, "q", "ACG", "III")]
    assert [(z, n > 0) for _, z, n in sequences.expand(str(tmp_path))] == [(False, True), (True, True)]
    (tmp_path / "z.bz2").write_bytes(b"BZh9")
    with pytest.raises(ValueError):
        sequences.expand(str(tmp_path))
    fa = sequences.number_records(sequences.read_fasta(spark, str(tmp_path / "x.fa")))
    assert sorted((x.read_no, x.name, x.seq, x.n_lines) for x in fa.collect()) == [(0, "r1 x", "ACGT", 2), (1, "r2", "TTT", 1)]


def test_tables(tmp_path, spark):
    (tmp_path / "code").write_text('  id 4 ,\n ncbieaa "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",\n sncbieaa "---"\n -- Base1  ' + "".join(x * 16 for x in "TCAG") + "\n -- Base2  " + "".join(x * 4 for x in "TCAG") * 4 + "\n -- Base3  " + "TCAG" * 16 + "\n")
    t = tables.read_code_table(str(tmp_path / "code"), 4)
    assert t["TGA"] == "W" and t["TAA"] == "[" and tables.read_code_table(str(tmp_path / "code"), 9) is None
    (tmp_path / "s.yaml").write_text("# c\nidentify:\n  beasts: 5   # five\n  unique: true\n  level: 'genus'\nmin_k: 9\n")
    s = Settings.from_file(str(tmp_path / "s.yaml"), max_k=30)
    assert (s.beasts, s.unique, s.level, s.min_k, s.max_k) == (5, True, "genus", 9, 12)
    (tmp_path / "map").write_text("AB,C\n\nxx\n")
    assert tables.read_pair_map(str(tmp_path / "map")) == {(1, 2): 3}
    (tmp_path / "del").write_text("7\t|\nx\n9\t|\n")
    assert sorted(x.tax for x in tables.read_deleted(spark, str(tmp_path / "del")).collect()) == [7, 9]
    (tmp_path / "two").write_text("A.1\t5\nB.1\t\n")
    assert sorted(tuple(x) for x in tables.read_accession_map(spark, str(tmp_path / "two")).collect()) == [("A.1", 5), ("B.1", None)]
    (tmp_path / "bad").write_text("a\tb\n")
    with pytest.raises(Exception, match="four columns"):
        tables.read_content(spark, str(tmp_path / "bad")).collect()
    assert Settings(h=25).checked().max_k == 25 and Settings(beasts=0).checked().beasts == 1
    assert sinks.output_name("_", 1, "fasta", False) == "" and sinks.output_name("p", 2, "fastq", True) == "p_2.fastq.gz"


def test_chunks_make_records(spark):
    cols = "file string, read_id long, mate int, chunk_no int, name string, seq string, qual string, kind string, n_lines int, read_at long"
    rows = [("f", 1, None, 1, None, "GG\nT", None, "dna", 2, 5), ("f", 1, None, 0, " n.1 ", "AC \t", "", "dna", 1, 4), ("f", 1, None, 0, " n.1 ", "AC \t", "", "dna", 1, 9), ("f", 2, 1, 0, "x", None, "II", None, None, 1), ("f", 3, 1, 0, "a", "AA", "II", "dna", 1, 1), ("f", 3, 2, 0, "b", "CCC", "", "dna", 1, 1)]
    r = reads.assemble(spark.createDataFrame(rows, cols))
    got = {(x.read_id, x.mate): (x.name, x.seq, x.seq_len, x.n_lines) for x in r.collect()}
    assert got == {(1, None): ("n.1", "ACGGT", 5, 3), (2, 1): ("x", "", 0, 0), (3, 1): ("a", "AA", 2, 1), (3, 2): ("b", "CCC", 3, 1)}
    p = reads.pairs(r).first()
    assert (p.name, p.seq_len) == ("a b", 5)
    ok = {(x.read_id, x.mate): x.quality_ok for x in reads.check_quality(r).collect()}
    assert ok[(2, 1)] is False and ok[(3, 1)] is True
    assert reads.assemble(spark.createDataFrame([], cols)).count() == 0
    sniff = spark.createDataFrame([("@a",), (">b",)], "l string").select(reads.sniff_format(F.col("l"))).collect()
    assert [x[0] for x in sniff] == ["fastq", "fasta"]


def test_modes_end_to_end(tmp_path, spark):
    import random

    r = random.Random(2)
    genome = {f"A.{i}": "".join(r.choice("ACGT") for _ in range(300)) for i in range(1, 4)}
    (tmp_path / "ref.fa").write_text("".join(f">{a} g\n{s}\n" for a, s in genome.items()))
    (tmp_path / "more.fa").write_text(f">B.1 g\n{'ACGTTGCA' * 20}\n")
    (tmp_path / "content").write_text("one\t11\t11\tA.1\ntwo\t12\t12\tA.2\nthree\t13\t13\tA.3\nfour\t14\t14\tB.1\n")
    (tmp_path / "reads.fq").write_text("".join(f"@r{i}\n{genome[f'A.{i}'][50:150]}\n+\n{'I' * 100}\n" for i in (1, 2, 3)) + "@none\n" + "ACAC" * 25 + "\n+\n" + "I" * 100 + "\n")
    run = lambda *a: cli.run(spark, [str(x) for x in a])
    t = tmp_path
    run("build", t / "ref.fa", t / "content", t / "idx")
    run("update", t / "idx", t / "more.fa", t / "content", t / "idx2")
    assert modes.load_index(spark, str(t / "idx2")).count() > modes.load_index(spark, str(t / "idx")).count()
    (t / "del").write_text("14\t|\n")
    run("delete", t / "idx2", t / "del", t / "idx3")
    same = modes.load_index(spark, str(t / "idx3")).exceptAll(modes.load_index(spark, str(t / "idx"))).count()
    assert same == 0
    run("identify", t / "reads.fq", t / "idx", t / "content", t / "out", "--output", "jsonl", "--coherence")
    j = {x["Specifier from input file"]: x for x in spark.read.json(str(t / "out/reads.jsonl")).collect()}
    assert [j[f"r{i}"]["Top hits"][0]["tax ID"] for i in (1, 2, 3)] == ["11", "12", "13"]
    bad = {x.name for x in sequences.read_sequences(spark, str(t / "out/contaminated.fastq.gz")).collect()}
    assert bad == {"r1", "r2", "r3"}
    rows = spark.read.option("header", True).csv(str(t / "out/profile.csv")).collect()
    assert rows[0]["Name"] == "not identified" and {x["#taxID"] for x in rows[1:]} == {"11", "12", "13"}
    run("shrink", t / "idx", t / "idx4", "--shrink", 1, "--percent", 50)
    n, h = modes.load_index(spark, str(t / "idx")).count(), modes.load_index(spark, str(t / "idx4")).count()
    assert abs(n / 2 - h) <= 2
    run("shrink", t / "idx", t / "idx5", "--shrink", 2)
    run("frequency", t / "idx", t / "freq")
    assert spark.read.parquet(str(t / "freq")).exceptAll(spark.read.parquet(str(t / "idx/freq"))).count() == 0
    run("merge", t / "idx", t / "idx2", t / "content", t / "content", t / "idx6")
    assert modes.load_index(spark, str(t / "idx6")).count() == modes.load_index(spark, str(t / "idx2")).count()
    run("translate", t / "reads.fq", t / "prot")
    assert sequences.read_sequences(spark, str(t / "prot")).count() == 4


def test_ordered_operators(spark):
    df = spark.createDataFrame([(i, i * 7919 % 100 // 10) for i in range(100)], "i int, v int").repartition(5)
    r = sequence_store.ranked(df, F.col("v"), F.col("i"))
    got = [(x.v, x.i) for x in r.orderBy("rank").collect()]
    assert got == sorted(got) and sorted(x.rank for x in r.collect()) == list(range(1, 101))
    assert sequence_store.is_sorted(r, "v").first().sorted is True
    u = sequence_store.unique_consecutive(r, "v")
    assert [x.v for x in u.orderBy("rank").collect()] == sorted({v for v, _ in got})
    text = "mississippi"
    chars = spark.createDataFrame(list(enumerate(text)), "pos int, c string")
    sa = {x.place: x.pos for x in sequence_store.suffix_array(chars).collect()}
    assert [sa[i] for i in sorted(sa)] == sorted(range(len(text)), key=lambda i: text[i:])
    ops = spark.createDataFrame([(1, "push"), (2, "push"), (3, "pop"), (4, "push"), (5, "push"), (6, "pop")], "rank int, op string")
    assert [x.rank for x in sequence_store.stack_replay(ops).orderBy("rank").collect()] == [1, 4]
