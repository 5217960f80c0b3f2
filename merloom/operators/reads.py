"""Records of reads from their chunks, pairs of mates, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.functions.text import accession_of, trim_all

BLANKS = "[\\r\\n\\t ]+"


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each (read_id, mate, chunk_no); of differing copies the one read last."""
    cols = ["name", "seq", "qual", "kind", "n_lines", "file"]
    o = F.struct("read_at", F.xxhash64("seq").alias("h"))
    one = chunks.groupBy("read_id", "mate", "chunk_no").agg(F.max_by(F.struct(*cols), o).alias("v"))
    return one.select("read_id", "mate", "chunk_no", *[F.col(f"v.{c}").alias(c) for c in cols])


def assemble(chunks: DataFrame) -> DataFrame:
    """(file, read_id, mate, kind, name, seq, seq_len, n_lines, qual): whole records, letters only.

    The chunks of a record are joined in order; blanks and line breaks are
    taken out of the sequence. ``seq_len`` counts letters, ``n_lines`` lines.
    """
    part = F.struct("chunk_no", F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("qual", F.lit("")).alias("qual"), "name", F.coalesce("kind", F.lit("dna")).alias("kind"), "n_lines", "file")
    rec = latest_chunks(chunks).groupBy("read_id", "mate").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = lambda f: F.regexp_replace(F.array_join(F.transform("p", lambda x: x[f]), ""), BLANKS, "")
    first = lambda f: F.try_element_at(F.filter(F.transform("p", lambda x: x[f]), lambda y: y.isNotNull()), F.lit(1))
    out = rec.select("read_id", "mate", first("file").alias("file"), first("kind").alias("kind"), trim_all(first("name")).alias("name"), joined("seq").alias("seq"), joined("qual").alias("qual"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n_lines"], F.lit(0))).alias("n_lines"))
    return out.withColumn("seq_len", F.length("seq").cast("long"))


def check_quality(reads: DataFrame) -> DataFrame:
    """(read_id, mate, quality_ok): a quality, where given, must be as long as the sequence."""
    return reads.select("read_id", "mate", (F.length("qual").isin(0) | (F.length("qual") == F.col("seq_len"))).alias("quality_ok"))


def pairs(reads: DataFrame) -> DataFrame:
    """(read_id, name, len1, len2, seq1, seq2): mates joined by read id; names are joined by a blank, lengths add up."""
    a = reads.where("mate = 1").select("read_id", F.col("name").alias("n1"), F.col("seq").alias("seq1"), F.col("seq_len").alias("len1"))
    b = reads.where("mate = 2").select("read_id", F.col("name").alias("n2"), F.col("seq").alias("seq2"), F.col("seq_len").alias("len2"))
    return a.join(b, "read_id").select("read_id", F.concat_ws(" ", "n1", "n2").alias("name"), "len1", "len2", (F.col("len1") + F.col("len2")).alias("seq_len"), "seq1", "seq2")


def detect_kind(seq: Column) -> Column:
    """``dna`` if the first four letters are nucleotide codes, else ``protein`` (the sniffing rule)."""
    return F.when(F.upper(F.substring(seq, 1, 4)).rlike("^[ACGTURYKMSWBDHVN]+$"), F.lit("dna")).otherwise(F.lit("protein"))


def sniff_format(first_line: Column) -> Column:
    """``fasta`` or ``fastq`` from the first character; anything else raises."""
    c = F.substring(first_line, 1, 1)
    return F.when(c == ">", "fasta").when(c == "@", "fastq").otherwise(F.raise_error(F.lit("Input does not start with @ or >.")))


def whole_header(name: Column) -> Column:
    """The accession of a header, else the whole header; null for an empty one."""
    return F.coalesce(accession_of(name), F.nullif(F.trim(name, F.lit(" \t\n\r")), F.lit("")))


def with_content(reads: DataFrame, content: DataFrame) -> DataFrame:
    """Records with the taxon that the content table gives their accession or whole header, dummies included."""
    known = content.select(F.explode("accessions").alias("acc"), "tax").groupBy("acc").agg(F.min("tax").alias("tax"))
    return reads.withColumn("acc", whole_header(F.col("name"))).join(known, "acc")


def with_tax(reads: DataFrame, acc_map: DataFrame, how: str = "inner") -> DataFrame:
    """Records whose header holds a known accession, with its taxon (of several taxa of one accession the least); ``how`` left keeps all others, without a taxon."""
    known = acc_map.where("tax is not null").groupBy(F.col("accession").alias("acc")).agg(F.min("tax").alias("tax"))
    return reads.withColumn("acc", accession_of(F.col("name"))).join(known, "acc", how)
