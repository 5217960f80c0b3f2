"""The batch modes over files: content tables, indices, identification.

Tables are parquet folders; an index folder holds ``idx`` (sorted by range),
``freq``, ``directory`` and ``info`` (kind, letters, rows, alphabet). Every mode
writes new folders; ``resume`` leaves those that are complete as they are.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.config import Settings
from merloom.functions.codec import H64, H128, clean_dna, code_prefix, decode_kmer, encode_kmer
from merloom.functions.text import accession_of, file_stem
from merloom.operators import content, identify, index, profile, reports, windows
from merloom.session import exists, materialise
from merloom.sources import sequences, sinks, tables

KINDS = {"full": H64, "halved": H64, "long": H128}


def _references(spark: SparkSession, path: str, content_file: DataFrame) -> DataFrame:
    """(tax, seq) of the records of known accession; a whole header may stand for one (dummies)."""
    known = content_file.select(F.explode("accessions").alias("acc"), F.col("tax")).distinct()
    r = sequences.read_sequences(spark, path).select("seq", F.coalesce(accession_of(F.col("name")), F.col("name")).alias("acc"))
    return r.join(known, "acc").select("tax", "seq")


def reference_rows(refs: DataFrame, s: Settings) -> DataFrame:
    seq = clean_dna(F.col("seq")) if s.kind == "dna" else F.col("seq")
    w = windows.kmer_windows(refs, seq, ["tax"], kind=s.kind, frames=s.frames, h=s.h, side="reference", table=s.code_table())
    if s.kind == "dna":
        w = windows.drop_unknown(w, s.h)
    return w.withColumnRenamed("kmer", "code").select("code", "tax").distinct()


def info_of(spark: SparkSession, path: str) -> dict:
    """Kind, letters, rows and alphabet of a stored index."""
    return spark.read.json(os.path.join(path, "info")).first().asDict()


def save_index(spark: SparkSession, idx: DataFrame, out: str, kind: str = "full", alphabet: str = "", resume: bool = False) -> None:
    h = KINDS[kind]
    missing = lambda part: not (resume and exists(spark, os.path.join(out, part, "_SUCCESS")))
    if missing("idx"):
        if kind == "halved":
            rows = index.shrink_halve(idx)
            rows.repartitionByRange("prefix", "suffix").sortWithinPartitions("prefix", "suffix", "tax").write.mode("overwrite" if resume else "error").parquet(os.path.join(out, "idx"))
        else:
            index.store(idx, os.path.join(out, "idx"), mode="overwrite" if resume else "error")
    stored = _rows(spark, out, kind)
    if missing("freq"):
        index.frequencies(stored, h).write.mode("overwrite").parquet(os.path.join(out, "freq"))
    if missing("directory"):
        index.directory(stored, h=h).write.mode("overwrite").parquet(os.path.join(out, "directory"))
    if missing("info"):
        about = stored.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), F.lit(h).alias("letters"), "rows", F.lit(alphabet).alias("alphabet"))
        about.coalesce(1).write.mode("overwrite").json(os.path.join(out, "info"))


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    stored = spark.read.parquet(os.path.join(path, "idx"))
    return index.from_halved(stored) if kind == "halved" else stored


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """(code, tax) of a stored index of any kind."""
    return _rows(spark, path, info_of(spark, path)["kind"])


def generate_content(spark: SparkSession, fasta: str, acc_map: str, nodes: str, names: str, level: str) -> DataFrame:
    headers = sequences.read_sequences(spark, fasta).select(F.coalesce(accession_of(F.col("name")), F.col("name")).alias("accession"))
    n = reports.clean_nodes(tables.read_nodes(spark, nodes))
    return content.generate(headers, tables.read_accession_map(spark, acc_map), n, tables.read_names(spark, names), level)


def load_content(spark: SparkSession, path: str) -> DataFrame:
    c = tables.read_content(spark, path)
    return content.parse(c.select("name", F.coalesce(F.col("tax").try_cast("long"), F.col("line_no")).alias("tax"), "sub_taxids", "accessions"))


def _content_for(spark: SparkSession, fasta: str, content_path: str, s: Settings, taxonomy: tuple[str, str, str] | None) -> DataFrame:
    """The content table; where there is none yet, it is made from the references and written."""
    if not exists(spark, content_path):
        if taxonomy is None:
            raise ValueError(f"no content table at {content_path}, and no taxonomy to make one")
        sinks.write_content(content.joined(generate_content(spark, fasta, *taxonomy, s.level)), content_path)
    return load_content(spark, content_path)


def build(spark: SparkSession, fasta: str, content_path: str, out: str, s: Settings, taxonomy: tuple[str, str, str] | None = None) -> None:
    """``taxonomy`` (accession map, nodes, names) makes the content table where there is none."""
    known = _content_for(spark, fasta, content_path, s, taxonomy)
    save_index(spark, reference_rows(_references(spark, fasta, known), s), out, "long" if s.h == H128 else "full", s.alphabet, s.resume)


def update(spark: SparkSession, old: str, fasta: str, content_path: str, out: str, s: Settings, taxonomy: tuple[str, str, str] | None = None) -> None:
    """The index with the references of ``fasta``; with a ``taxonomy`` the content table grows by their accessions first, into ``out/content``."""
    about = info_of(spark, old)
    if about["kind"] == "halved":
        raise ValueError("a halved index cannot be updated")
    s = s.for_index(about["kind"], about["letters"])
    known, remap = load_content(spark, content_path), None
    if taxonomy is not None:
        have = known.select(F.explode("accessions").alias("accession"))
        fresh = generate_content(spark, fasta, *taxonomy, s.level)
        unknown = fresh.withColumn("accessions", F.array_sort("accessions")).select("name", "tax", "sub_taxids", F.explode("accessions").alias("accession")).join(have, "accession", "left_anti")
        unknown = unknown.groupBy("name", "tax", "sub_taxids").agg(F.array_sort(F.collect_set("accession")).alias("accessions"))
        both, renamed = content.merge(known, unknown)
        both = materialise(both)
        sinks.write_content(content.joined(both), os.path.join(out, "content"))
        known, remap = both, renamed.where("side = 1").select("old", "new")
    new = reference_rows(_references(spark, fasta, known), s)
    save_index(spark, index.update(load_index(spark, old), new, remap), out, about["kind"], about["alphabet"] or "", s.resume)


def merge(spark: SparkSession, first: str, second: str, content1: str, content2: str, out: str) -> DataFrame:
    """Merge two indices of one kind and their content tables; gives the merged content."""
    a, b = info_of(spark, first), info_of(spark, second)
    if a["kind"] != b["kind"] or a["letters"] != b["letters"]:
        raise ValueError(f"indices of different kinds: {a['kind']} and {b['kind']}")
    if a["kind"] == "halved":
        raise ValueError("halved indices cannot be merged")
    both, renamed = content.merge(load_content(spark, content1), load_content(spark, content2))
    maps = [renamed.where(F.col("side") == i).select("old", "new") for i in (1, 2)]
    save_index(spark, index.merge(load_index(spark, first), load_index(spark, second), *maps), out, a["kind"], a["alphabet"] or "")
    return both


def delete(spark: SparkSession, path: str, deleted: str, out: str) -> None:
    about = info_of(spark, path)
    if about["kind"] == "halved":
        raise ValueError("taxa cannot be deleted from a halved index")
    save_index(spark, index.delete(load_index(spark, path), tables.read_deleted(spark, deleted)), out, about["kind"], about["alphabet"] or "")


def shrink(spark: SparkSession, path: str, out: str, s: Settings) -> None:
    """1 every n-th row of a taxon, 2 halved layout, 3 entropy, 4 over-represented k-mers."""
    about, idx = info_of(spark, path), load_index(spark, path)
    if about["kind"] != "full" and not (about["kind"] == "long" and s.shrink == 4):
        raise ValueError("only a full index of 12 letters can be shrunk this way")
    how = {1: lambda: index.shrink_every_nth(idx, s.percent or 50.0), 2: lambda: idx, 3: lambda: index.shrink_entropy(idx), 4: lambda: index.shrink_overrepresented(idx)}
    save_index(spark, how[s.shrink](), out, "halved" if s.shrink == 2 else about["kind"], about["alphabet"] or "")


def identify_file(spark: SparkSession, path: str, index_path: str, content_path: str, out: str, s: Settings, paired: str | None = None) -> None:
    """Read-wise output, profile, and clean and contaminated reads of one input.

    Windows are made once: those that may match are counted by read and code and
    written, and scores and profile both come from them.
    """
    about = info_of(spark, index_path)
    s = s.for_index(about["kind"], about["letters"])
    r = sequences.read_sequences(spark, path).withColumn("mate", F.lit(1))
    if paired:
        r = r.unionByName(sequences.read_sequences(spark, paired).withColumn("mate", F.lit(2)))
    r = r.select(F.col("read_no").alias("read_id"), "mate", "name", "seq", "qual", F.length("seq").alias("seq_len"))
    idx, names = load_index(spark, index_path), load_content(spark, content_path)
    seq = clean_dna(F.col("seq")) if s.kind == "dna" else F.col("seq")
    w = windows.kmer_windows(r, seq, ["read_id", "mate"], kind=s.kind, frames=s.frames, h=s.h, min_k=s.min_k, table=s.code_table()).withColumnRenamed("kmer", "code")
    keys = ["read_id"]
    whole = r.groupBy("read_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("mate", "name"))), lambda x: x["name"])).alias("name"), F.sum("seq_len").alias("seq_len"))
    freq = spark.read.parquet(os.path.join(index_path, "freq"))
    occ = identify.occurrences(w, idx, keys, s.min_k, s.h)
    scores = identify.read_scores(identify.match_counted(occ, idx, keys, s.min_k, s.max_k, s.h, s.unique, combined=False), keys)
    rated = materialise(identify.rate(scores, whole, freq.where(F.col("k") == s.max_k), keys, s.min_k, s.max_k, s.frames, s.threshold, kind=s.kind, h=s.h))
    hits = identify.rank_hits(rated, keys, s.beasts)
    coherent = None
    if s.coherence:  # the better mate of a read
        per_mate = identify.coherence(identify.longest_matches(w, idx, ["read_id", "mate"], s.min_k, s.max_k, s.h), ["read_id", "mate"])
        coherent = materialise(per_mate.groupBy("read_id").agg(F.max("coherence").alias("coherence")))
    if s.output in ("json", "jsonl"):
        j = reports.read_json(whole, hits, names, coherent=coherent)
        sinks.write_json_array(j, os.path.join(out, "reads.json"), "read_id") if s.output == "json" else sinks.write_json_lines(j, os.path.join(out, "reads.jsonl"))
    else:
        t = reports.read_tsv(whole, hits, names, coherent=coherent) if s.output == "tsv" else reports.read_short(whole, hits)
        sinks.write_tsv(t, os.path.join(out, f"reads.{s.output}"))
    n_windows = r.agg(F.coalesce(F.sum(windows.count_column(F.col("seq_len"), s.kind, s.frames, s.h, s.min_k)), F.lit(0)).alias("n"))
    total = profile.input_size(n_windows, whole.agg(F.count(F.lit(1)).alias("n")), s.min_k, s.max_k, s.frames)
    codes = occ.groupBy("code").agg(F.sum("n").alias("n"))
    counts = identify.count_taxa(identify.match_counted(codes, idx, [], s.min_k, s.max_k, s.h))
    rel = profile.relative(counts, total, freq if s.coverage else None)
    rows = profile.ranked(profile.wide(rel, s.min_k, s.max_k, coverage=s.coverage), s.min_k, s.max_k)
    sinks.write_profile(rows, profile.not_identified(rel, total), names, os.path.join(out, "profile.csv"), s.min_k, s.max_k, coverage=s.coverage)
    if (s.clean, s.contaminated) == ("_", "_"):
        return
    bad = identify.contaminated(rated, keys, s.error_threshold, coherent, s.coherence_threshold)
    fastq = r.where("qual is not null").limit(1).count() > 0
    for prefix, part in zip((s.clean, s.contaminated), identify.split_reads(r, bad, keys)):
        for mate in (1, 2) if paired else (1,):
            target = sinks.output_name(prefix, mate if paired else None, "fastq" if fastq else "fasta", s.gzip)
            if target:
                (sinks.write_fastq if fastq else sinks.write_fasta)(part.where(F.col("mate") == mate), os.path.join(out, target), compression="gzip" if s.gzip else "none")


def identify_many(spark: SparkSession, folder: str, index_path: str, content_path: str, out: str, s: Settings) -> None:
    """Every file of a folder, results under the stem of the file; ``parallel`` files at a time, largest first."""
    files = sorted(sequences.expand(folder, spark), key=lambda x: -x[2])
    stems = spark.createDataFrame([(f,) for f, _, _ in files], "f string").select("f", file_stem(F.col("f")).alias("s"))
    named = {r["f"]: r["s"] for r in stems.collect()}  # the files of one folder
    with ThreadPoolExecutor(max(1, s.parallel)) as pool:
        jobs = [pool.submit(identify_file, spark, f, index_path, content_path, os.path.join(out, named[f]), s) for f, _, _ in files]
        for j in jobs:
            j.result()


def reads_report(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, hit, rank, tax, taxon, score, relative, error) of a written JSON report, array or lines."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^(\[|,)\s*", "").alias("json")).where("json like '{%'")
    rows = reports.parsed_hits(lines)
    place = F.when(F.col("hit") == "further", 1_000_000).otherwise(0) + F.col("place")
    return rows.withColumn("rank", place)


def post_process(spark: SparkSession, what: str, report: str, out: str, nodes: str | None = None, names: str | None = None, taxa: list[int] | None = None) -> None:
    """Tables from a written JSON report: ``frequencies``, ``top-frequencies``, ``profile``, ``pie``, ``binning``, ``reads`` (of taxa), ``unidentified`` or ``lines``."""
    if what == "lines":
        text = spark.read.text(report).select(F.regexp_replace(F.trim("value"), r"^(\[|,)\s*", "").alias("json")).where("json like '{%'")
        sinks.write_json_lines(text, out)
        return
    rows = materialise(reads_report(spark, report))
    hits = rows.where("tax is not null")
    reads = rows.select("read_id", "name", "seq_len").distinct()
    n = reads.agg(F.count(F.lit(1)).alias("n"))
    if what in ("frequencies", "top-frequencies"):
        t = reports.read_frequencies(hits, ["read_id"], n, top_only=what != "frequencies", ties_only=what == "frequencies")
        sinks.write_tsv(t.orderBy(F.desc("weight"), "tax"), out, one_file=True)
    elif what in ("profile", "pie"):
        q = reports.read_frequencies(hits, ["read_id"], n).select("tax", (F.col("share") * 100).alias("quantity"))
        label = tables.read_names(spark, names).where("name_class = 'scientific name'")
        p = reports.taxon_profile(q, reports.clean_nodes(tables.read_nodes(spark, nodes)), label)
        sinks.write_tsv(p.orderBy("rank_no", F.desc("percentage")) if what == "profile" else reports.pie_rows(p), out, one_file=True)
    elif what == "binning":
        sinks.write_tsv(hits.where("hit = 'top' and place = 1").select("name", "tax"), out)
    elif what == "reads":
        wanted = spark.createDataFrame([(t,) for t in taxa or []], "tax long")
        sinks.write_tsv(reports.reads_of_taxon(reads, hits, ["read_id"], wanted).select("read_id", "name"), out)
    elif what == "unidentified":
        sinks.write_tsv(reports.not_identified(reads, hits, ["read_id"]).select("read_id", "name"), out)
    else:
        raise ValueError(f"unknown table: {what}")


def lookup(spark: SparkSession, index_path: str, kmers: list[str]) -> DataFrame:
    long = info_of(spark, index_path)["kind"] == "long"
    want = spark.createDataFrame([(k,) for k in kmers], "k string").select((F.upper("k") if long else encode_kmer(F.upper("k"))).alias("code"))
    found = index.lookup(load_index(spark, index_path), want)
    return found.select((F.col("code") if long else decode_kmer(F.col("code"))).alias("kmer"), "tax")


def page(spark: SparkSession, index_path: str, start: int, size: int = 20) -> DataFrame:
    """One page of the index in its order: the directory tells which prefixes hold it, and only their rows are sorted."""
    about, idx = info_of(spark, index_path), load_index(spark, index_path)
    d = spark.read.parquet(os.path.join(index_path, "directory"))
    own = d.where((F.col("start") < start + size) & (F.col("start") + F.col("cnt") > start)).agg(F.min("prefix").alias("lo"), F.max("prefix").alias("hi"), F.min("start").alias("first")).first()
    long = about["kind"] == "long"
    show = (F.col("code") if long else decode_kmer(F.col("code"))).alias("kmer")
    if own["lo"] is None:
        return idx.limit(0).select(show, "tax")
    if long:
        p = encode_kmer(F.substring("code", 1, 6), 6)
    else:
        p = code_prefix(F.col("code"), 6)
        idx = idx.where((F.col("code") >= own["lo"] << 30) & (F.col("code") < (own["hi"] + 1) << 30))  # prunes files
    rows = idx.where((p >= own["lo"]) & (p <= own["hi"]))
    return rows.orderBy("code", "tax").offset(start - own["first"]).limit(size).select(show, "tax")


def translate(spark: SparkSession, path: str, out: str) -> None:
    x = sequences.read_sequences(spark, path).select("name", windows.in_one_frame(clean_dna(F.col("seq"))).alias("seq"))
    sinks.write_fastq(x, out, qual=None)
