"""Modes over files: kinds of index, alphabets, content on the way, filters, reports."""

import json
import random
import warnings

import pytest

from merloom import cli, modes
from merloom.sources import sequences


@pytest.fixture(scope="module")
def files(tmp_path_factory, spark):
    t = tmp_path_factory.mktemp("modes")
    r = random.Random(4)
    genome = {f"A.{i}": "".join(r.choice("ACGT") for _ in range(260)) for i in range(1, 4)}
    (t / "ref.fa").write_text("".join(f">{a} g\n{s}\n" for a, s in genome.items()))
    (t / "more.fa").write_text(f">B.1 g\n{'ACGTTGCAGT' * 16}\n>no accession\n{'GGCATTACGA' * 12}\n")
    (t / "reads.fa").write_text("".join(f">r{i}\n{genome[f'A.{i}'][40:160]}\n" for i in (1, 2, 3)) + ">none\n" + "ACAC" * 25 + "\n")
    (t / "acc").write_text("A.1\t11\nA.2\t12\nA.3\t13\nB.1\t14\n")
    (t / "nodes").write_text("".join(f"{a}\t|\t{b}\t|\t{c}\t|\n" for a, b, c in [(1, 1, "no rank"), (2, 1, "superkingdom"), (3, 2, "genus"), (11, 3, "species"), (12, 3, "species"), (13, 3, "species"), (14, 3, "species")]))
    (t / "names").write_text("".join(f"{a}\t|\tname {a}\t|\t\t|\tscientific name\t|\n" for a in (2, 3, 11, 12, 13, 14)))
    run = lambda *a: cli.run(spark, [str(x) for x in a])
    run("build", t / "ref.fa", t / "content", t / "idx", "--taxonomy", t / "acc", t / "nodes", t / "names")
    return t, run


def tops(spark, path):
    return {x["Specifier from input file"]: (x["Top hits"][0]["tax ID"] if x["Top hits"] else None) for x in spark.read.json(str(path)).collect()}


def test_content_is_made_on_the_way(spark, files):
    t, run = files
    assert {x.tax for x in modes.load_content(spark, str(t / "content")).collect()} == {11, 12, 13}
    assert modes.info_of(spark, str(t / "idx")) == {"kind": "full", "letters": 12, "rows": modes.load_index(spark, str(t / "idx")).count(), "alphabet": ""}
    run("update", t / "idx", t / "more.fa", t / "content", t / "idx2", "--taxonomy", t / "acc", t / "nodes", t / "names")
    got = {x.tax for x in modes.load_content(spark, str(t / "idx2/content")).collect()}
    assert {11, 12, 13, 14} < got and len(got) == 5 and max(got) > 2**32 - 10
    assert {x.tax for x in modes.load_index(spark, str(t / "idx2")).select("tax").distinct().collect()} == got


def test_halved_index_identifies(spark, files):
    t, run = files
    run("shrink", t / "idx", t / "half", "--shrink", 2)
    assert modes.info_of(spark, str(t / "half"))["kind"] == "halved"
    for idx in ("idx", "half"):
        run("identify", t / "reads.fa", t / idx, t / "content", t / f"out-{idx}", "--output", "jsonl", "--coverage", "--coherence", "--filter", "good", "bad", "--plain")
    a, b = (sorted(x.value for x in spark.read.text(str(t / f"out-{i}/reads.jsonl")).collect()) for i in ("idx", "half"))
    assert a == b and tops(spark, t / "out-half/reads.jsonl") == {"r1": "11", "r2": "12", "r3": "13", "none": None}
    assert all(h["Coherence"] >= 0 for x in a for h in json.loads(x)["Top hits"])
    with pytest.raises(ValueError):
        run("delete", t / "half", t / "acc", t / "x1")
    with pytest.raises(ValueError):
        run("merge", t / "idx", t / "half", t / "content", t / "content", t / "x2")
    # FASTA in, FASTA out
    assert {x.name for x in sequences.read_sequences(spark, str(t / "out-half/bad.fasta")).collect()} == {"r1", "r2", "r3"}
    assert [(x.name, x.qual) for x in sequences.read_sequences(spark, str(t / "out-half/good.fasta")).collect()] == [("none", None)]
    rows = spark.read.option("header", True).csv(str(t / "out-half/profile.csv"))
    assert "Special Counts k=12" in rows.columns and "Genome Coverage k=7" in rows.columns


def test_reports_of_a_written_output(spark, files):
    t, run = files
    run("identify", t / "reads.fa", t / "idx", t / "content", t / "out-arr", "--filter", "_", "_")
    for what in ("frequencies", "top-frequencies", "profile", "pie", "binning", "unidentified", "lines"):
        run("report", what, t / "out-arr/reads.json", t / f"rep-{what}", "--nodes", t / "nodes", "--names", t / "names")
    run("report", "reads", t / "out-arr/reads.json", t / "rep-reads", "--taxa", 12)
    tsv = lambda n: spark.read.option("header", True).option("sep", "\t").csv(str(t / f"rep-{n}")).collect()
    assert {(x.tax, float(x.share)) for x in tsv("frequencies")} == {("11", 0.25), ("12", 0.25), ("13", 0.25)}
    assert {x["tax"] for x in tsv("profile")} >= {"2", "3", "11"} and float(next(x.percentage for x in tsv("profile") if x["tax"] == "3")) == 75.0
    assert [x.name for x in tsv("unidentified")] == ["none"] and [x.name for x in tsv("reads")] == ["r2"]
    assert {(x.name, x.tax) for x in tsv("binning")} == {("r1", "11"), ("r2", "12"), ("r3", "13")}
    assert tops(spark, t / "rep-lines") == {"r1": "11", "r2": "12", "r3": "13", "none": None}


def test_long_index(spark, files):
    t, run = files
    run("build", t / "ref.fa", t / "content", t / "long", "--letters", 25)
    assert modes.info_of(spark, str(t / "long"))["kind"] == "long"
    run("identify", t / "reads.fa", t / "long", t / "content", t / "out-long", "--output", "tsv", "--filter", "_", "_")
    rows = {x.name: x.taxa for x in spark.read.option("header", True).option("sep", "\t").csv(str(t / "out-long/reads.tsv")).collect()}
    assert rows["r1"].split(";")[0] == "11" and rows["none"] == "-"
    k = modes.load_index(spark, str(t / "long")).orderBy("code", "tax").limit(30).collect()
    assert [(x.kmer, x.tax) for x in modes.page(spark, str(t / "long"), 10, 20).collect()] == [(x.code, x.tax) for x in k[10:]]
    assert modes.lookup(spark, str(t / "long"), [k[0].code]).count() >= 1
    with pytest.raises(ValueError):
        run("shrink", t / "long", t / "x3", "--shrink", 2)


def test_pages_and_resuming(spark, files):
    t, run = files
    every = [(x.kmer, x.tax) for x in modes.page(spark, str(t / "idx"), 0, 10_000).collect()]
    assert len(every) == modes.info_of(spark, str(t / "idx"))["rows"] and every == sorted(every)
    assert [(x.kmer, x.tax) for x in modes.page(spark, str(t / "idx"), 313, 20).collect()] == every[313:333]
    assert modes.page(spark, str(t / "idx"), 10**6).count() == 0
    run("build", t / "ref.fa", t / "content", t / "part")
    import shutil

    shutil.rmtree(t / "part/freq")
    stamp = (t / "part/idx/_SUCCESS").stat().st_mtime_ns
    run("build", t / "ref.fa", t / "content", t / "part", "--continue")
    assert (t / "part/idx/_SUCCESS").stat().st_mtime_ns == stamp and spark.read.parquet(str(t / "part/freq")).count() == 36


def test_alphabet_of_build_and_identify(spark, files):
    t, run = files
    (t / "code").write_text('  id 4 ,\n ncbieaa "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",\n sncbieaa "---"\n -- Base1  ' + "".join(x * 16 for x in "TCAG") + "\n -- Base2  " + "".join(x * 4 for x in "TCAG") * 4 + "\n -- Base3  " + "TCAG" * 16 + "\n")
    run("build", t / "ref.fa", t / "content", t / "other", "-a", t / "code", 4)
    assert modes.info_of(spark, str(t / "other"))["alphabet"].endswith("code")
    a, b = modes.load_index(spark, str(t / "idx")), modes.load_index(spark, str(t / "other"))
    assert a.exceptAll(b).count() > 0
    run("identify", t / "reads.fa", t / "other", t / "content", t / "out-other", "-a", t / "code", 4, "--output", "jsonl", "--filter", "_", "_")
    assert tops(spark, t / "out-other/reads.jsonl")["r2"] == "12"
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        cli.settings_of(cli.parser().parse_args(["build", "a", "b", "c", "-a", str(t / "code"), "9"])).code_table()
    assert any("standard code" in str(x.message) for x in w)


def test_many_files_at_once(spark, files):
    t, run = files
    (t / "many").mkdir()
    text = (t / "reads.fa").read_text().split(">")[1:]
    for i, x in enumerate(text):
        (t / f"many/f{i}.fa").write_text(">" + x)
    run("identify-multiple", t / "many", t / "idx", t / "content", t / "out-many", "--output", "short", "--filter", "_", "_", "--parallel", 4)
    got = [spark.read.option("header", True).option("sep", "\t").csv(str(t / f"out-many/f{i}/reads.short")).first() for i in range(4)]
    assert [x.tax for x in got] == ["11", "12", "13", "0"]
