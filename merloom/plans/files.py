"""Queries that write a format to the shared folder and scan it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merloom.functions.codec import clean_dna
from merloom.operators import identify, index, reads, windows
from merloom.plans import common_sql as q
from merloom.plans import identification as ident
from merloom.session import new_path, table
from merloom.sources import sequences, sinks, tables


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return reads.assemble(table(spark, d, "read_chunks")).where("kind = 'dna' and seq_len > 0").withColumn("name", F.concat_ws("/", F.col("read_id").cast("string"), F.col("mate").cast("string")))


def scan_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Split scan of FASTA text, lines of 70 letters."""
    p = new_path(spark)
    lines = F.regexp_replace("seq", "(.{70})", "$1\n")
    sinks.write_fasta(_dna(spark, d).withColumn("seq", lines), p)
    return sequences.read_fasta(spark, p).select("name", "seq")


def scan_fasta_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Records of each file numbered densely, the files one after the other."""
    p = new_path(spark)
    sinks.write_fasta(_dna(spark, d), p)
    n = sequences.number_records(sequences.read_fasta(spark, p))
    # numbers made dense over all files: those of a file follow those of the files before it
    per = n.groupBy("file").agg((F.max("read_no") + 1).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.select(F.col("file").alias("f"), before.alias("base"))
    return n.join(base, F.col("file") == F.col("f")).select((F.col("base") + F.col("read_no")).alias("number"))


def scan_fastq_gz(spark: SparkSession, d: str) -> DataFrame:
    """Gzip FASTQ through the data source."""
    p = new_path(spark)
    sinks.write_fastq(_dna(spark, d), p, qual=None, compression="gzip")
    return sequences.read_sequences(spark, p).select("name", "seq", F.length("qual").cast("long").alias("qual_len"))


def scan_fastq(spark: SparkSession, d: str) -> DataFrame:
    """Plain FASTQ, its files split, records of four lines put together across the splits."""
    p = new_path(spark)
    sinks.write_fastq(_dna(spark, d), p, qual=None)
    return sequences.read_sequences(spark, p).select("name", "seq", F.length("qual").cast("long").alias("qual_len"))


def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the files of a folder."""
    p = new_path(spark)
    sinks.write_fasta(_dna(spark, d), p)
    found = sequences.expand(p, spark)
    return spark.createDataFrame([(any(z for _, z, _ in found), sum(n for _, _, n in found))], "any_gzip boolean, n_bytes bigint")


def scan_nodes_dump(spark: SparkSession, d: str) -> DataFrame:
    """A node dump, fields closed by tab, pipe, tab."""
    p = new_path(spark)
    t = table(spark, d, "tax_nodes").select(F.concat_ws("\t|\t", F.col("tax").cast("string"), F.col("parent").cast("string"), F.coalesce("rank_name", F.lit("")), F.lit("x")).alias("v"))
    sinks.write_lines(t, F.concat("v", F.lit("\t|")), p)
    return tables.read_nodes(spark, p)


def scan_names_dump(spark: SparkSession, d: str) -> DataFrame:
    """A name dump."""
    p = new_path(spark)
    t = table(spark, d, "tax_names").select(F.concat_ws("\t|\t", F.col("tax").cast("string"), "name", F.coalesce("unique_name", F.lit("")), "name_class").alias("v"))
    sinks.write_lines(t, F.concat("v", F.lit("\t|")), p)
    return tables.read_names(spark, p)


def scan_accession_map(spark: SparkSession, d: str) -> DataFrame:
    """Four columns, gzip, with a header."""
    p = new_path(spark)
    t = table(spark, d, "acc_map").select(F.concat_ws("\t", F.split("accession", "\\.").getItem(0), "accession", F.coalesce(F.col("tax").cast("string"), F.lit("")), F.lit("0")).alias("v"))
    head = spark.createDataFrame([("accession\taccession.version\ttaxid\tgi",)], "v string")
    sinks.write_lines(head.unionByName(t), F.col("v"), p, compression="gzip")
    return tables.read_accession_map(spark, p)


def scan_content_file(spark: SparkSession, d: str) -> DataFrame:
    """The content file written and read again."""
    p = new_path(spark)
    sinks.write_content(table(spark, d, "content_file").select("name", "tax", "sub_taxids", "accessions"), p)
    return tables.read_content(spark, p).select("name", F.col("tax").cast("long").alias("tax"), "sub_taxids", "accessions")


def scan_frequency_file(spark: SparkSession, d: str) -> DataFrame:
    """The wide frequency file of the index with the names of its taxa."""
    p = new_path(spark)
    sinks.write_frequencies(index.frequencies(ident._idx(spark, d)), ident._names(spark, d), p)
    return tables.read_frequencies(spark, p)


def scan_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index, read back whole."""
    p = new_path(spark)
    index.store(ident._idx(spark, d), p)
    return spark.read.parquet(p)


def scan_index_range(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a prefix range, found through file statistics."""
    lo, hi = 11 << 55, 12 << 55  # k-mers that begin with K
    return scan_index(spark, d).where((F.col("code") >= lo) & (F.col("code") < hi))


def custom_code_table(spark: SparkSession, d: str) -> DataFrame:
    """First frames under a code in which TGA means tryptophan."""
    from merloom.functions.codec import STANDARD_CODE, codon_table

    amino = STANDARD_CODE.replace("]", "W").replace("[", "*")
    b = "TCAG"
    t = codon_table(amino, "".join(x * 16 for x in b), "".join(x * 4 for x in b) * 4, b * 16)
    return _dna(spark, d).select("read_id", "mate", windows.in_one_frame(clean_dna(F.col("seq")), t).alias("protein"))


def sink_translated(spark: SparkSession, d: str) -> DataFrame:
    """The first frames as FASTQ with best qualities, read again."""
    p = new_path(spark)
    x = _dna(spark, d).select("name", windows.in_one_frame(clean_dna(F.col("seq"))).alias("seq")).where("length(seq) > 0")
    sinks.write_fastq(x, p, qual=None)
    return sequences.read_sequences(spark, p).select("name", "seq", "qual")


def sink_json_array(spark: SparkSession, d: str) -> DataFrame:
    """K1: one JSON array, read again as a whole document."""
    p = new_path(spark)
    sinks.write_json_array(ident.report_json(spark, d), p, "read_id")
    rows = spark.read.text(p, wholetext=False).select(F.regexp_replace("value", "^(\\[ |, )", "").alias("value")).where("value not in (']', '[ ]')")
    j = rows.select(F.from_json("value", "struct<`Read number`: bigint, Length: bigint>").alias("j"))
    return j.select(F.col("j.`Read number`").alias("read_id"), F.col("j.Length").alias("seq_len"))


def sink_profile_csv(spark: SparkSession, d: str) -> DataFrame:
    """K5: the profile file with its first row, read again."""
    from merloom.operators import profile

    p = new_path(spark)
    rel, total = ident._relative(spark, d), ident._total(spark, d)
    rows = profile.ranked(profile.wide(rel, ident.MIN_K, ident.MAX_K), ident.MIN_K, ident.MAX_K)
    sinks.write_profile(rows, profile.not_identified(rel, total), ident._names(spark, d), p, ident.MIN_K, ident.MAX_K)
    back = spark.read.option("header", True).csv(p)
    k = ident.MIN_K
    return back.select(F.col("`#taxID`").cast("long").alias("tax"), F.col("Name").alias("name"), F.round(F.col(f"`Non-unique counts k={k}`").cast("double"), 6).alias("count_all"))


def profile_coverage_csv(spark: SparkSession, d: str) -> DataFrame:
    """K5, A3: the profile file with its columns of coverage, read again."""
    from merloom.operators import profile

    p = new_path(spark)
    rel, total = ident._relative(spark, d), ident._total(spark, d)
    rows = profile.ranked(profile.wide(rel, ident.MIN_K, ident.MAX_K, coverage=True), ident.MIN_K, ident.MAX_K)
    sinks.write_profile(rows, profile.not_identified(rel, total), ident._names(spark, d), p, ident.MIN_K, ident.MAX_K, coverage=True)
    back = spark.read.option("header", True).csv(p)
    ks = range(ident.MIN_K, ident.MAX_K + 1)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`Special Counts k={k}`").cast("double").cast("long").alias("count_total"), F.round(F.col(f"`Genome Coverage k={k}`").cast("double"), 6).alias("coverage")) for k in ks])).alias("c")
    return back.select(F.col("`#taxID`").cast("long").alias("tax"), cells).select("tax", "c.*")


def sink_filtered_fastq(spark: SparkSession, d: str) -> DataFrame:
    """Clean and contaminated reads as gzip FASTQ files, read again and counted."""
    bad = identify.contaminated(ident._rated(spark, d), ident.KEYS, 0.9995)
    clean, dirty = identify.split_reads(_dna(spark, d), bad, ["read_id"])
    out = []
    for kind, part in (("clean", clean), ("contaminated", dirty)):
        p = new_path(spark)
        sinks.write_fastq(part, p, qual=None, compression="gzip")
        out.append(sequences.read_sequences(spark, p).agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("seq")).alias("n_letters")).withColumn("part", F.lit(kind)))
    return out[0].unionByName(out[1])


QUERIES = {
    f.__name__: f
    for f in (
        scan_fasta, scan_fasta_numbered, scan_fastq_gz, scan_fastq, scan_files, scan_nodes_dump, scan_names_dump, scan_accession_map, scan_content_file, scan_frequency_file, scan_index, scan_index_range, custom_code_table,
        sink_translated, sink_json_array, sink_profile_csv, profile_coverage_csv, sink_filtered_fastq,
    )
}

_NM = "concat_ws('/', read_id::varchar, mate::varchar) as name"
_R = f"with {q.READS}"
_DNAW = "kind = 'dna' and length(seq) > 0"
_FRAME = f"array_to_string(list_transform(range(1, length(dna) - 1, 3), lambda i: {q.codon('substr(dna, i::int, 3)')}), '')"

SQL = {
    "scan_fasta": f"{_R} select {_NM}, seq from rd where {_DNAW}",
    "scan_fasta_numbered": f"{_R} select unnest(range((select count(*) from rd where {_DNAW})))::bigint as number",
    "scan_fastq_gz": f"{_R} select {_NM}, seq, length(seq) as qual_len from rd where {_DNAW}",
    "scan_fastq": f"{_R} select {_NM}, seq, length(seq) as qual_len from rd where {_DNAW}",
    "scan_files": f"{_R} select false as any_gzip, sum(length(seq) + length(concat_ws('/', read_id::varchar, mate::varchar)) + 3)::bigint as n_bytes from rd where {_DNAW}",
    "scan_nodes_dump": "select * from tax_nodes",
    "scan_names_dump": "select * from tax_names",
    "scan_accession_map": "select * from acc_map",
    "scan_content_file": "select name, tax, sub_taxids, accessions from content_file",
    "scan_frequency_file": f"with {q.IDX}, k as (select unnest(range(1, 13))::int as k), {ident._LAB}, f as (select tax, k, count(*) filter (substr(kmer, k, 1) <> '^') as n from idx, k group by tax, k) select case when f.tax = 0 then 'non_unique' else coalesce(taxon, 'tax_' || f.tax) end as name, k, n from f left join lab on lab.tax = f.tax",
    "scan_index_range": f"with {q.IDX} select {ident._CODE} as code, tax from idx where kmer[1] = 'K'",
    "scan_index": f"with {q.IDX} select {ident._CODE} as code, tax from idx",
    "custom_code_table": f"{_R}, c as (select read_id, mate, {q.clean('seq')} as dna from rd where {_DNAW}) select read_id, mate, translate({_FRAME}, ']', 'W') as protein from c",
    "sink_translated": f"{_R}, c as (select {_NM}, {q.clean('seq')} as dna from rd where {_DNAW}), f as (select name, {_FRAME} as seq from c) select name, seq, repeat('I', length(seq)) as qual from f where length(seq) > 0",
    "sink_json_array": f"{_R}, {ident._RDS} select read_id, seq_len from reads",
    "sink_profile_csv": f"""with {ident._COUNTS}, {ident._LAB}, w as (select tax, sum(count_all) as c from rl where k = {ident.MIN_K} group by tax having sum(count_all) > 0)
        select 0 as tax, 'not identified' as name, 0.0 as count_all union all select w.tax, translate(coalesce(taxon, 'unnamed'), ',', ' '), round(c, 6) from w left join lab using (tax)""",
    "profile_coverage_csv": f"""with {ident._COUNTS}, t as (select tax from rl where k = {ident.MIN_K} group by tax having sum(count_all) > 0), kk as (select unnest(range({ident.MIN_K}, {ident.MAX_K + 1}))::int as k)
        select 0::bigint as tax, k, 0::bigint as count_total, 0.0::double as coverage from kk
        union all select t.tax, kk.k, coalesce(count_total, 0), round(coalesce(coverage, 0), 6) from t cross join kk left join rl on rl.tax = t.tax and rl.k = kk.k""",
    "sink_filtered_fastq": f"""with {ident._RATED}, bad as (select read_id from rt group by read_id having min(error) < 0.9995)
        select case when read_id in (select read_id from bad) then 'contaminated' else 'clean' end as part, count(*) as n_records, sum(length(seq))::bigint as n_letters from rd where {_DNAW} group by 1""",
}
