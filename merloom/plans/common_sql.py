"""DuckDB text shared by the SQL of several queries."""

from merloom.functions.codec import codon_table

#: Key of an index pair as upper-case text.
KEY = "coalesce(upper(kmer), array_to_string(list_transform(range(12), lambda i: chr((64 | ((code >> (5 * (11 - i))) & 31))::int)), ''))"

#: Whole records of reads.
READS = """
    ch as (select * from read_chunks qualify row_number() over (partition by read_id, mate, chunk_no order by read_at desc) = 1),
    rd as (select read_id, mate, regexp_replace(string_agg(coalesce(seq, ''), '' order by chunk_no), '[\\r\\n\\t ]+', '', 'g') as seq,
                  regexp_replace(string_agg(coalesce(qual, ''), '' order by chunk_no), '[\\r\\n\\t ]+', '', 'g') as qual,
                  coalesce(first(kind order by chunk_no) filter (kind is not null), 'dna') as kind,
                  first(file order by chunk_no) filter (file is not null) as file,
                  trim(first(name order by chunk_no) filter (name is not null), chr(32) || chr(9) || chr(10) || chr(13)) as name, sum(coalesce(n_lines, 0))::bigint as n_lines
           from ch group by read_id, mate)"""

_T = codon_table()
CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(_T.items())) + "}"


def codon(triple: str) -> str:
    return f"case when contains({triple}, 'Z') then '_' when contains({triple}, 'X') then '^' else {CODONS}[{triple}] end"


def clean(seq: str) -> str:
    return f"upper(regexp_replace({seq}, '[^ACGTacgt]', 'Z', 'g'))"


def revcomp(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


#: List of the letters at every offset; ``cs`` is the list of the bases.
LETTERS = f"list_transform(range(1, len(cs) - 1), lambda i: {codon('(cs[i] || cs[i + 1] || cs[i + 2])')})"


def windows_cte(source: str, strands: list[tuple[int, str]], n: str, stride: int, step: int, letters: str = LETTERS, where: str = "true") -> str:
    """CTE ``win(read_id, mate, strand, pos, code)``.

    ``source`` has read_id, mate, s and pad; ``n`` counts the windows of one
    sequence from its letters ``ls``.
    """
    parts = " union all ".join(f"select read_id, mate, {k} as strand, string_split({e} || pad, '') as cs from src" for k, e in strands)
    code = " + ".join(f"((ascii(lead(a, {i * stride}) over o) & 31)::bigint << {5 * (11 - i)})" for i in range(12))
    return f"""
        src as ({source}), st as ({parts}),
        l as (select read_id, mate, strand, {letters} as ls from st),
        z as (select read_id, mate, strand, ({n})::bigint as n, unnest(ls) as a, generate_subscripts(ls, 1) - 1 as pos from l),
        y as (select read_id, mate, strand, pos, n, {code} as code from z window o as (partition by read_id, mate, strand order by pos)),
        win as (select read_id, mate, strand, pos, code from y where pos < n * {step} and pos % {step} = 0 and {where})"""


#: The window holds no letter ``_``.
NO_UNKNOWN = "not (" + " or ".join(f"((code >> {5 * i}) & 31) = 31" for i in range(12)) + ")"


def accession(name: str) -> str:
    return f"list_filter(string_split(regexp_split_to_array(trim({name}), '\\s+')[1], '|'), lambda x: contains(x, '.'))[1]"


#: Distinct index rows as text k-mers.
IDX = f"idx as (select distinct {KEY} as kmer, tax from idx_pairs where tax is not null and (kmer is not null or code is not null))"
