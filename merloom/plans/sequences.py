"""Queries over reads: assembly, checks, translation and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions import codec, scoring, text
from merloom.operators import reads, reconstruct, windows
from merloom.plans import common_sql as q
from merloom.session import table


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return reads.assemble(table(spark, d, "read_chunks"))


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).where("kind = 'dna'").select("read_id", "mate", codec.clean_dna(F.col("seq")).alias("dna"), "seq")


def reads_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Whole records with letter and line counts."""
    return _reads(spark, d).select("read_id", "mate", "file", "kind", "name", "seq", "seq_len", "n_lines", (F.col("seq_len") + F.col("n_lines")).alias("ref_len"))


def reads_paired(spark: SparkSession, d: str) -> DataFrame:
    """S8, J10."""
    return reads.pairs(_reads(spark, d))


def reads_quality_check(spark: SparkSession, d: str) -> DataFrame:
    """S10."""
    return reads.check_quality(_reads(spark, d))


def reads_kind_sniffed(spark: SparkSession, d: str) -> DataFrame:
    """The four-letter rule beside the delivered kind."""
    r = _reads(spark, d)
    return r.where("seq_len > 0").groupBy("kind", reads.detect_kind(F.col("seq")).alias("sniffed")).agg(F.count(F.lit(1)).alias("n_reads"))


def accession_extract(spark: SparkSession, d: str) -> DataFrame:
    """P19, P21, P22."""
    r = _reads(spark, d)
    return r.select("read_id", "mate", text.accession_of(F.col("name")).alias("accession"), F.element_at(text.split_first(F.col("name"), " "), 1).alias("first_word"))


def reference_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Records with a known accession and their taxon."""
    return reads.with_tax(_reads(spark, d), table(spark, d, "acc_map")).select("read_id", "mate", F.col("acc").alias("accession"), "tax", "kind", "seq_len")


def reference_sequences_headers(spark: SparkSession, d: str) -> DataFrame:
    """All records that have a header; those without a known accession with the dummy of the generated content."""
    from merloom.plans.taxonomy import _generated

    return reads.with_content(_reads(spark, d), _generated(spark, d, "lowest", True)).select("read_id", "mate", F.col("acc").alias("accession"), "tax", "kind", "seq_len")


def dna_clean_revcomp(spark: SparkSession, d: str) -> DataFrame:
    """P3, P4."""
    return _dna(spark, d).select("read_id", "mate", "dna", codec.reverse_complement(F.col("dna")).alias("revcomp"))


def translate_one_frame(spark: SparkSession, d: str) -> DataFrame:
    """The protein of the first frame."""
    return _dna(spark, d).select("read_id", "mate", windows.in_one_frame(F.col("dna")).alias("protein"))


def translate_all_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Letters at every offset of the reads padded for k = 7."""
    return _dna(spark, d).select("read_id", "mate", windows.translate_native(F.concat("dna", F.lit("X" * 15))).alias("letters"))


def open_reading_frames(spark: SparkSession, d: str) -> DataFrame:
    """P27."""
    return windows.open_frames(_dna(spark, d), F.col("dna"), ["read_id", "mate"])


def reconstruct_dna(spark: SparkSession, d: str) -> DataFrame:
    """Sequences without foreign letters rebuilt from their letters."""
    x = _dna(spark, d).where("length(dna) >= 3 and not contains(dna, 'Z')")
    x = x.select("read_id", "mate", "dna", reconstruct.reconstructed(windows.translate_native(F.col("dna"))).alias("again"))
    # letters that are not known are filled from the sequence itself: the whole must be the sequence again
    filled = F.array_join(F.zip_with(F.split("dna", ""), F.split("again", ""), lambda a, b: F.when(b == "N", a).otherwise(b)), "")
    return x.select("read_id", "mate", F.length("again").cast("long").alias("n"), filled.alias("filled"))


def _summary(w: DataFrame) -> DataFrame:
    return w.groupBy("read_id", "mate", "strand").agg(
        F.count(F.lit(1)).alias("n_windows"), F.countDistinct("code").alias("n_kmers"), F.sum(F.pmod("code", F.lit(1000003)) * (F.pmod(F.col("pos"), F.lit(97)) + 1)).alias("checksum")
    )


def windows_three_frames(spark: SparkSession, d: str) -> DataFrame:
    """G1, G4, P5, P10, P11, P13."""
    return _summary(windows.kmer_windows(_dna(spark, d), F.col("dna"), ["read_id", "mate"]))


def windows_six_frames(spark: SparkSession, d: str) -> DataFrame:
    """Reads and their reverse complements."""
    return _summary(windows.kmer_windows(_dna(spark, d), F.col("dna"), ["read_id", "mate"], frames=6))


def windows_one_frame(spark: SparkSession, d: str) -> DataFrame:
    """G2."""
    return _summary(windows.kmer_windows(_dna(spark, d), F.col("dna"), ["read_id", "mate"], frames=1))


def windows_protein(spark: SparkSession, d: str) -> DataFrame:
    """G3."""
    r = _reads(spark, d).where("kind = 'protein'")
    return _summary(windows.kmer_windows(r, F.col("seq"), ["read_id", "mate"], kind="protein"))


def windows_reference(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a reference sequence, without foreign letters."""
    w = windows.kmer_windows(_dna(spark, d), F.col("dna"), ["read_id", "mate"], side="reference")
    return _summary(windows.drop_unknown(w))


def windows_reference_one_frame(spark: SparkSession, d: str) -> DataFrame:
    """G6."""
    w = windows.kmer_windows(_dna(spark, d), F.col("dna"), ["read_id", "mate"], side="reference", frames=1)
    return _summary(windows.drop_unknown(w))


def windows_reference_protein(spark: SparkSession, d: str) -> DataFrame:
    """G7."""
    r = _reads(spark, d).where("kind = 'protein'")
    return _summary(windows.kmer_windows(r, F.col("seq"), ["read_id", "mate"], kind="protein", side="reference"))


def windows_reference_thinned(spark: SparkSession, d: str) -> DataFrame:
    """G5 with H5: every fourth window of each sequence and strand left out."""
    w = windows.kmer_windows(_dna(spark, d), F.col("dna"), ["read_id", "mate"], side="reference")
    return _summary(windows.every_nth_dropped(w, 25.0, ["read_id", "mate", "strand"]))


def windows_long_kmers(spark: SparkSession, d: str) -> DataFrame:
    """P25, H = 25: long k-mers of references as text."""
    w = windows.kmer_windows(_dna(spark, d), F.col("dna"), ["read_id", "mate"], side="reference", h=codec.H128)
    return windows.drop_unknown(w).groupBy("read_id", "mate").agg(F.count(F.lit(1)).alias("n_windows"), F.countDistinct("kmer").alias("n_kmers"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))


def windows_text(spark: SparkSession, d: str) -> DataFrame:
    """G3 over documents: twelve-letter windows of their letters, counted by label."""
    docs = table(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s"))
    w = windows.kmer_windows(docs, F.col("s"), ["lang"], kind="protein", min_k=12)
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("n_windows"), F.countDistinct("code").alias("n_kmers"))


def kmer_encode_decode(spark: SparkSession, d: str) -> DataFrame:
    """Packed code, its letters again and the code of a prefix."""
    p = table(spark, d, "idx_pairs").where("kmer is not null")
    c = codec.encode_kmer(F.col("kmer"))
    return p.select("pair_id", c.alias("packed"), codec.decode_kmer(c).alias("letters"), codec.kmer_prefix_code(c, 7).alias("prefix7"), F.bit_count(c).alias("bits"))


def kmer_entropy(spark: SparkSession, d: str) -> DataFrame:
    """P18."""
    b = table(spark, d, "base_idx")
    return b.select("kmer", F.round(scoring.entropy(F.col("kmer")), 6).alias("entropy"))


def best_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of a perfect match for every length of a read."""
    r = _reads(spark, d).where("kind = 'dna' and seq_len > 0").select("seq_len").distinct()
    n = F.col("seq_len")
    return r.select("seq_len", F.round(scoring.best_score(n, 7, 12), 6).alias("three"), F.round(scoring.best_score(n, 7, 12, 1), 6).alias("one"), F.round(scoring.best_score(n, 7, 12, 6), 6).alias("six"), F.round(scoring.best_score(n, 7, 12, kind="protein"), 6).alias("protein"))


def file_stems(spark: SparkSession, d: str) -> DataFrame:
    """P26, K13."""
    return table(spark, d, "read_chunks").groupBy(text.file_stem(F.col("file")).alias("stem")).agg(F.countDistinct("read_id").alias("n_reads"))


QUERIES = {
    f.__name__: f
    for f in (
        reads_assembled, reads_paired, reads_quality_check, reads_kind_sniffed, accession_extract, reference_sequences, reference_sequences_headers, dna_clean_revcomp, translate_one_frame, translate_all_offsets, open_reading_frames, reconstruct_dna,
        windows_three_frames, windows_six_frames, windows_one_frame, windows_protein, windows_reference, windows_reference_one_frame, windows_reference_protein, windows_reference_thinned, windows_long_kmers, windows_text,
        kmer_encode_decode, kmer_entropy, best_scores, file_stems,
    )
}


def _windows_sql(*args, **kw) -> str:
    return f"""with {q.READS}, {q.windows_cte(*args, **kw)}
        select read_id, mate, strand, count(*) as n_windows, count(distinct code) as n_kmers, sum((code % 1000003) * (pos % 97 + 1))::bigint as checksum from win group by read_id, mate, strand"""


_DNA = f"select read_id, mate, {q.clean('seq')} as s, repeat('X', greatest({{pad}}, {{least}} - length(seq))) as pad from rd where kind = 'dna' and length(seq) > 0"
_READ = _DNA.format(pad=15, least=36)
_REF = _DNA.format(pad=33, least=0)


def _n3(stride: str = "three") -> str:
    size = "(len(ls) + 2)"
    if stride == "one":
        return f"case when {size} // 3 > 13 then {size} // 3 - 11 else 0 end"
    return f"case when {size} > 37 then {size} - 35 else 0 end"


_PROT = "select read_id, mate, translate(upper(seq), '*', '[') as s, repeat('^', greatest({pad}, {least} - length(seq))) as pad from rd where kind = 'protein' and length(seq) > 0"

SQL = {
    "reads_assembled": f"with {q.READS} select read_id, mate, file, kind, name, seq, length(seq) as seq_len, n_lines, length(seq) + n_lines as ref_len from rd",
    "reads_paired": f"""with {q.READS}
        select a.read_id, concat_ws(' ', a.name, b.name) as name, length(a.seq) as len1, length(b.seq) as len2, length(a.seq) + length(b.seq) as seq_len, a.seq as seq1, b.seq as seq2
        from rd a join rd b on a.read_id = b.read_id and a.mate = 1 and b.mate = 2""",
    "reads_quality_check": f"with {q.READS} select read_id, mate, length(qual) = 0 or length(qual) = length(seq) as quality_ok from rd",
    "reads_kind_sniffed": f"with {q.READS} select kind, case when regexp_matches(upper(seq[:4]), '^[ACGTURYKMSWBDHVN]+$') then 'dna' else 'protein' end as sniffed, count(*) as n_reads from rd where length(seq) > 0 group by all",
    "accession_extract": f"with {q.READS} select read_id, mate, {q.accession('name')} as accession, string_split(name, ' ')[1] as first_word from rd",
    "reference_sequences": f"""with {q.READS}, a as (select accession, min(tax) as tax from acc_map where tax is not null group by accession)
        select read_id, mate, accession, tax, kind, length(seq) as seq_len from (select *, {q.accession('name')} as acc from rd) r join a on r.acc = a.accession""",
    "dna_clean_revcomp": f"with {q.READS}, c as (select read_id, mate, {q.clean('seq')} as dna from rd where kind = 'dna') select *, {q.revcomp('dna')} as revcomp from c",
    "translate_one_frame": f"with {q.READS}, c as (select read_id, mate, {q.clean('seq')} as dna from rd where kind = 'dna') select read_id, mate, array_to_string(list_transform(range(1, length(dna) - 1, 3), lambda i: {q.codon('substr(dna, i::int, 3)')}), '') as protein from c",
    "translate_all_offsets": f"with {q.READS}, c as (select read_id, mate, string_split({q.clean('seq')} || 'XXXXXXXXXXXXXXX', '') as cs from rd where kind = 'dna') select read_id, mate, array_to_string({q.LETTERS}, '') as letters from c",
    "open_reading_frames": f"""with {q.READS}, c as (select read_id, mate, string_split({q.clean('seq')}, '') as cs from rd where kind = 'dna'),
        t as (select read_id, mate, unnest(range(1, len(cs) - 1)) as i, unnest(list_transform(range(1, len(cs) - 1), lambda j: cs[j] || cs[j + 1] || cs[j + 2])) as x from c),
        s as (select * from t where x = 'ATG'), e as (select * from t where x in ('TAA', 'TAG', 'TGA'))
        select s.read_id, s.mate, s.i as start, min(e.i) as stop from s join e on s.read_id = e.read_id and s.mate is not distinct from e.mate and e.i >= s.i + 6 and (e.i - s.i) % 3 = 0 group by all""",
    "reconstruct_dna": f"with {q.READS}, c as (select read_id, mate, {q.clean('seq')} as dna from rd where kind = 'dna') select read_id, mate, length(dna) as n, dna as filled from c where length(dna) >= 3 and not contains(dna, 'Z')",
    "windows_three_frames": _windows_sql(_READ, [(0, "s")], _n3(), 3, 1),
    "windows_six_frames": _windows_sql(_READ, [(0, "s"), (1, q.revcomp("s"))], _n3(), 3, 1),
    "windows_one_frame": _windows_sql(_READ, [(0, "s")], _n3("one"), 3, 3),
    "windows_protein": _windows_sql(_PROT.format(pad=5, least=12), [(0, "s")], "case when len(ls) > 13 then len(ls) - 11 else 0 end", 1, 1, "cs"),
    "windows_reference": _windows_sql(_REF, [(0, "s")], "len(ls) - 33", 3, 1, where=q.NO_UNKNOWN),
    "windows_reference_one_frame": _windows_sql(_REF, [(0, "s")], "case when len(ls) >= 34 then (len(ls) - 34) // 3 + 1 else 0 end", 3, 3, where=q.NO_UNKNOWN),
    "windows_reference_protein": _windows_sql(_PROT.format(pad=11, least=0), [(0, "s")], "len(ls) - 11", 1, 1, "cs"),
    "windows_reference_thinned": _windows_sql(_REF, [(0, "s")], "len(ls) - 33", 3, 1, where="(pos + 1) % 4 <> 0"),
    "windows_long_kmers": f"""with {q.READS}, src as ({_DNA.format(pad=72, least=0)}), x as (select read_id, mate, string_split(s || pad, '') as cs from src), l as (select read_id, mate, {q.LETTERS} as ls from x),
        z as (select read_id, mate, len(ls) - 72 as n, unnest(ls) as a, generate_subscripts(ls, 1) - 1 as pos from l),
        y as (select read_id, mate, n, pos, {" || ".join(f"lead(a, {3 * i}) over o" for i in range(25))} as kmer from z window o as (partition by read_id, mate order by pos))
        select read_id, mate, count(*) as n_windows, count(distinct kmer) as n_kmers, min(kmer) as first_kmer, max(kmer) as last_kmer from y where pos < n and not contains(kmer, '_') group by read_id, mate""",
    "windows_text": """
        with s as (select coalesce(lang, 'none') as lang, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as s from documents where text is not null),
        w as (select lang, s, unnest(range(1, case when length(s) > 13 then length(s) - 10 else 1 end)) as i from s),
        k as (select lang, substr(s, i::int, 12) as kmer from w)
        select lang, count(*) as n_windows, count(distinct kmer) as n_kmers from k group by lang""",
    "kmer_encode_decode": f"""
        select pair_id, {' + '.join(f"((ascii(substr(kmer, {i + 1}, 1)) & 31)::bigint << {5 * (11 - i)})" for i in range(12))} as packed, upper(kmer) as letters, packed >> 25 as prefix7, bit_count(packed)::int as bits
        from idx_pairs where kmer is not null""",
    "kmer_entropy": """
        with l as (select kmer, unnest(string_split(kmer, '')) as c from base_idx), n as (select kmer, c, count(*) / 12.0 as p from l where c <> '' group by all)
        select kmer, round(-sum(p * log2(p)) * ln(2) / ln(22), 6) as entropy from n group by kmer""",
    "best_scores": f"""with {q.READS}, n as (select distinct length(seq) as n from rd where kind = 'dna' and length(seq) > 0), k as (select n, unnest(range(7, 13)) as k from n)
        select n as seq_len, round(sum(greatest(n - 3 * k + 1, 1) * k * k / 625.0), 6) as three, round(sum(greatest(n // 3 - k + 1, 1) * k * k / 625.0), 6) as one,
               round(sum(2 * greatest(n - 3 * k + 1, 1) * k * k / 625.0), 6) as six, round(sum(greatest(n - k + 1, 1) * k * k / 625.0), 6) as protein from k group by n""",
    "file_stems": "select regexp_replace(regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.gz$', ''), '\\.[^.]*$', '') as stem, count(distinct read_id) as n_reads from read_chunks group by 1",
}
