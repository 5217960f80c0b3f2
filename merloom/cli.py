"""Command line: python -m merloom.cli MODE ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from merloom import modes
from merloom.config import Settings
from merloom.operators import content, index
from merloom.session import prepare
from merloom.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="merloom")
    sub = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, *args: str, **more) -> argparse.ArgumentParser:
        m = sub.add_parser(name)
        for a in args:
            m.add_argument(a)
        m.add_argument("--settings", help="file of key: value lines")
        m.add_argument("-k", nargs=2, type=int, metavar=("K1", "K2"))
        m.add_argument("--frames", type=int)
        m.add_argument("--kind")
        m.add_argument("--letters", type=int, dest="h", choices=(12, 25), help="letters of the index")
        m.add_argument("-a", "--alphabet", nargs=2, metavar=("FILE", "ID"), help="codon table and the id of a code in it")
        m.add_argument("--continue", action="store_true", default=None, dest="resume")
        return m

    g = mode("generate-content", "input", "acc_map", "nodes", "names", "out")
    g.add_argument("--level")
    for b in (mode("build", "input", "content", "out"), mode("update", "index", "input", "content", "out")):
        b.add_argument("--taxonomy", nargs=3, metavar=("ACC_MAP", "NODES", "NAMES"), help="to make or extend the content table")
        b.add_argument("--level")
    mode("merge", "first", "second", "content1", "content2", "out")
    mode("delete", "index", "deleted", "out")
    s = mode("shrink", "index", "out")
    s.add_argument("--shrink", type=int)
    s.add_argument("--percent", type=float)
    for name in ("identify", "identify-multiple"):
        i = mode(name, "input", "index", "content", "out")
        i.add_argument("--paired")
        i.add_argument("--beasts", type=int)
        i.add_argument("--threshold", type=float)
        i.add_argument("--error-threshold", type=float)
        i.add_argument("--coherence-threshold", type=float)
        i.add_argument("--output")
        i.add_argument("--filter", nargs=2, metavar=("CLEAN", "CONTAMINATED"), help="prefixes of the filtered files; _ writes none")
        i.add_argument("--plain", action="store_false", default=None, dest="gzip", help="filtered files without gzip")
        i.add_argument("--parallel", type=int)
        for flag in ("unique", "coverage", "coherence"):
            i.add_argument(f"--{flag}", action="store_true", default=None)
    for name in ("frequency", "redundancy", "directory", "frequent"):
        mode(name, "index", "out")
    mode("repair-content", "content", "out")
    mode("translate", "input", "out")
    t = mode("report", "what", "report", "out")
    t.add_argument("--nodes")
    t.add_argument("--names")
    t.add_argument("--taxa", nargs="+", type=int)
    t = mode("lookup", "index")
    t.add_argument("kmers", nargs="+")
    v = mode("show", "index")
    v.add_argument("--start", type=int, default=0)
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    names = ("frames", "kind", "level", "shrink", "percent", "beasts", "threshold", "error_threshold", "coherence_threshold", "output", "unique", "coverage", "coherence", "h", "resume", "gzip", "parallel")
    over = {n: getattr(a, n) for n in names if getattr(a, n, None) is not None}
    if getattr(a, "alphabet", None):
        over |= {"alphabet": a.alphabet[0], "alphabet_id": int(a.alphabet[1])}
    if getattr(a, "filter", None):
        over |= {"clean": a.filter[0], "contaminated": a.filter[1]}
    if a.k:
        over |= {"min_k": a.k[0], "max_k": a.k[1], "max_k_given": True}
    return Settings.from_file(a.settings, **over) if a.settings else Settings(**over).checked()


def run(spark: SparkSession, argv: list[str]) -> None:
    prepare(spark)
    a = parser().parse_args(argv)
    s = settings_of(a)
    m = a.mode
    if m == "generate-content":
        sinks.write_content(content.joined(modes.generate_content(spark, a.input, a.acc_map, a.nodes, a.names, s.level)), a.out)
    elif m == "build":
        modes.build(spark, a.input, a.content, a.out, s, tuple(a.taxonomy) if a.taxonomy else None)
    elif m == "update":
        modes.update(spark, a.index, a.input, a.content, a.out, s, tuple(a.taxonomy) if a.taxonomy else None)
    elif m == "merge":
        sinks.write_content(content.joined(modes.merge(spark, a.first, a.second, a.content1, a.content2, a.out)), f"{a.out}/content")
    elif m == "delete":
        modes.delete(spark, a.index, a.deleted, a.out)
    elif m == "shrink":
        modes.shrink(spark, a.index, a.out, s)
    elif m == "identify":
        modes.identify_file(spark, a.input, a.index, a.content, a.out, s, a.paired)
    elif m == "identify-multiple":
        modes.identify_many(spark, a.input, a.index, a.content, a.out, s)
    elif m in ("frequency", "redundancy", "directory", "frequent"):
        h = modes.info_of(spark, a.index)["letters"]
        f = {"frequency": lambda x: index.frequencies(x, h), "redundancy": index.redundancy, "directory": lambda x: index.directory(x, h=h), "frequent": index.frequent_kmers}[m]
        f(modes.load_index(spark, a.index)).write.parquet(a.out)
    elif m == "report":
        modes.post_process(spark, a.what, a.report, a.out, a.nodes, a.names, a.taxa)
    elif m == "repair-content":
        sinks.write_content(content.joined(content.repair(modes.load_content(spark, a.content))), a.out)
    elif m == "translate":
        modes.translate(spark, a.input, a.out)
    elif m == "lookup":
        modes.lookup(spark, a.index, a.kmers).show(1000, False)
    elif m == "show":
        modes.page(spark, a.index, a.start).show(20, False)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("merloom").getOrCreate(), sys.argv[1:])
