"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from merloom.plans.common_sql import KEY as KEY_SQL

_CUBE = f"""
    with p as (select cast(added_at as date) as dy, shard_id, tax, {KEY_SQL} as km from idx_pairs),
    g as (select strftime(dy, '%Y-%m-%d') as day, shard_id, km, tax from p where dy is not null and shard_id is not null
          union all select strftime(dy, '%Y-%m-%d'), -1, km, tax from p where dy is not null
          union all select 'all', shard_id, km, tax from p where shard_id is not null),
    c as (select day, shard_id, count(*) as n_rows, count(km) as n_key_rows, count(distinct km) as n_kmers, count(distinct tax) as n_taxa from g group by day, shard_id)"""

SQL = {
    "p2_found": f"""
        with p as (select pair_id, {KEY_SQL} as km from idx_pairs),
        w as (select pair_id, km, row_number() over (partition by km order by pair_id) as rn from p where km is not null)
        select pair_id from w where rn > 1 or km in (select kmer from base_idx)""",
    "p2_totals": f"""
        with p as (select pair_id, {KEY_SQL} as km from idx_pairs),
        w as (select km, row_number() over (partition by km order by pair_id) as rn from p),
        c as (select count(*) as n_rows, count(*) filter (km is not null and (rn > 1 or km in (select kmer from base_idx))) as n_seen, count(km) as n_keyed from w)
        select n_rows, n_seen, n_keyed - n_seen as n_new, true as within_bound from c""",
    "p3_found": f"""
        with p as (select {KEY_SQL} as km from idx_pairs)
        select km as kmer from p where km is not null group by km having count(*) * 1000 >= 5 * (select count(*) from idx_pairs)""",
    "p3_counts": f"""
        with p as (select {KEY_SQL} as km from idx_pairs)
        select km as kmer, count(*) as n_rows, true as within_upper, true as within_lower from p where km is not null group by km having count(*) * 1000 >= 5 * (select count(*) from idx_pairs)""",
    "p4_found": _CUBE + """
        select 'kmer' as measure, day, shard_id from c where n_kmers * 4 < n_key_rows
        union all select 'tax', day, shard_id from c where n_taxa < 5""",
    "p4_distinct_counts": _CUBE + " select * from c",
    "p5_found": r"""
        with c as (select distinct read_id, chunk_no, kind, seq from read_chunks where mate is null),
        t as (select read_id, max(coalesce(kind, 'dna')) as kind, string_agg(seq, '' order by chunk_no) as s from c group by read_id),
        l as (select *, regexp_replace(s, '[\r\n\t ]', '', 'g') as x, case when kind = 'protein' then 11 else 35 end as ov from t),
        r as (select * from l where length(x) > 2000),
        -- boundaries: running letter counts of the parts between line breaks, of N runs and after stops
        a as (select read_id, list_transform(regexp_split_to_array(s, '[\r\n]+'), lambda y: length(regexp_replace(y, '[\t ]', '', 'g'))) as w from r),
        n as (select read_id, list_transform(regexp_split_to_array(regexp_replace(x, '([Nn]{5,})', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda y: length(y)) as w from r where kind <> 'protein'),
        p as (select read_id, list_transform(string_split(replace(x, '*', '*' || chr(1)), chr(1)), lambda y: length(y)) as w from r where kind = 'protein'),
        b as (select distinct read_id, list_sum(w[1:i])::bigint as pt from (select read_id, w, unnest(range(1, len(w) + 1)) as i from (select * from a union all select * from n union all select * from p))),
        e as (select b.read_id, b.pt, r.ov from b join r using (read_id) where b.pt > 0 and b.pt < length(r.x) union select read_id, length(x), ov from r),
        f as (select read_id, max(pt) filter (pt <= 2000) as first_cut from e group by read_id),
        g as (select e.read_id, pt - lag(pt) over (partition by e.read_id order by pt) as gap, ov from e join f using (read_id) where pt >= first_cut)
        select r.read_id, case when f.first_cut is null or exists (select 1 from g where g.read_id = r.read_id and g.gap > 2000 - g.ov) then 'forced' else 'natural' end as cut
        from r join f using (read_id)""",
    "p5_records": r"""
        with c0 as (select * from read_chunks qualify row_number() over (partition by read_id, mate, chunk_no order by read_at desc) = 1),
        t as (select read_id, coalesce(mate, -1) as mate, max(coalesce(kind, 'dna')) as kind, string_agg(coalesce(seq, ''), '' order by chunk_no) as s from c0 group by all),
        l as (select *, regexp_replace(s, '[\r\n\t ]', '', 'g') as x, case when kind = 'protein' then 11 else 35 end as ov from t),
        r as (select * from l where length(x) > 2000),
        a as (select read_id, mate, list_transform(regexp_split_to_array(s, '[\r\n]+'), lambda y: length(regexp_replace(y, '[\t ]', '', 'g'))) as w from r),
        n as (select read_id, mate, list_transform(regexp_split_to_array(regexp_replace(x, '([Nn]{5,})', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda y: length(y)) as w from r where kind <> 'protein'),
        p as (select read_id, mate, list_transform(string_split(replace(x, '*', '*' || chr(1)), chr(1)), lambda y: length(y)) as w from r where kind = 'protein'),
        b as (select distinct read_id, mate, list_sum(w[1:i])::bigint as pt from (select *, unnest(range(1, len(w) + 1)) as i from (select * from a union all select * from n union all select * from p))),
        -- the first piece has no overlap: as if it began at ov
        e as (select read_id, mate, b.pt, r.ov from b join r using (read_id, mate) where b.pt >= r.ov and b.pt < length(r.x) union select read_id, mate, length(x), ov from r union select read_id, mate, ov, ov from r),
        g as (select read_id, mate, ov, pt - lag(pt) over (partition by read_id, mate order by pt) as gap from e),
        f as (select read_id, mate, sum(greatest(ceil(gap / (2000.0 - ov)) - 1, 0))::bigint as n_forced from g group by all)
        select read_id, mate, length(x) as n_letters, n_forced, md5(x) as joined, true as within from r join f using (read_id, mate)""",
}

#: Characters that stand for the 4,096 tokens of a container: no text is near enough to the limit for the tokenizer to matter.
_CHARS = 4 * 4096
SQL["p6_found"] = f"select doc_id from documents where length(text) > {_CHARS}"
SQL["p7_found"] = """
        with d as (select lower(trim(source)) as src, coalesce(length(text), 0) as n from documents), t as (select sum(n) as total from d),
        a as (select src, sum(n) as n from d where src is not null group by src)
        select source from source_targets s, t left join a on a.src = lower(trim(s.source)) where coalesce(a.n, 0) * max_repeats < target_share * total"""
SQL["p6_fill_by_letters"] = f"""
        select count(*) as n_docs, coalesce(sum(length(text)), 0)::bigint as n_letters, ceil(coalesce(sum(length(text)), 0) / {_CHARS})::bigint as least_containers,
               0::bigint as n_over, 0::bigint as n_torn, 0::bigint as n_wrong, true as full from documents"""
SQL["p4_combinations"] = f"""
        with p as (select {KEY_SQL} as km, shard_id from idx_pairs where shard_id in (1, 2, 3)),
        k as (select km, bool_or(shard_id = 1) as a, bool_or(shard_id = 2) as b, bool_or(shard_id = 3) as c from p where km is not null group by km)
        select count(*) as n_any, count(*) filter (a and b and c) as n_all, count(*) filter (a and not b) as n_first_not_second from k"""
SQL["p7_report_by_letters"] = """
        with d as (select lower(trim(source)) as src, coalesce(length(text), 0) as n from documents), t as (select sum(n)::bigint as total from d),
        a as (select src, sum(n)::bigint as n, count(*) as c from d where src is not null group by src),
        s as (select source, max_repeats, coalesce(a.n, 0) as available, coalesce(a.c, 0) as n_docs, target_share * total as budget from source_targets st, t left join a on a.src = lower(trim(st.source)))
        select source, available, n_docs, round(budget, 3) as budget, case when available = 0 then 0 else least(floor(budget / available), max_repeats) end::bigint as epochs,
               available * max_repeats < budget as short, true as used_well from s"""
