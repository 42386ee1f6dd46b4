"""SQL for content queries: texts as hex digits, exploded byte by byte."""

from __future__ import annotations


def hists(n: int) -> str:
    return f"""docs as (select doc_id, lang, source, octet_length(encode(coalesce(text, '')))::bigint as size, left(hex(encode(coalesce(text, ''))), {2 * n}) as h,
         case when doc_id % 17 = 0 then 'gz' else 'txt' end as ext from documents),
bytes as (select doc_id, ('0x' || substr(h, 2 * i + 1, 2))::int as b from (select doc_id, h, unnest(range(0, length(h) // 2)) as i from docs)),
hist as (select doc_id, b, count(*) as c from bytes group by doc_id, b),
sizes as (select doc_id, lang, source, size, ext, length(h) // 2 as n from docs)"""


CLASSED = hists(16_384) + """,
shares as (
  select s.*, coalesce(sum(c) filter (where b = 0), 0) as nul, coalesce(sum(c) filter (where b in (9, 10, 13, 32)), 0) as ws,
         coalesce(sum(c) filter (where b in (9, 10, 13) or b between 32 and 126), 0) as pr,
         coalesce(sum(c) filter (where chr(b) in ('{', '}', '[', ']', ':', ',', '<', '>', '/', '=', '"') and b < 128), 0) as st
  from sizes s left join hist using (doc_id) group by all),
classed as (
  select *, case when n = 0 or nul > 0 or pr / n < 0.85 then 'Binary' when st / n >= 0.08 or ws / n >= 0.12 then 'StructuredText' else 'Text' end as class from shares),
grid as (select c.*, unnest(range(0, 16))::int as bucket from classed c),
sig as (select g.*, ((coalesce(x.c, 0) * 255 + greatest(n, 1) // 2) // greatest(n, 1))::int as weight
  from grid g left join (select doc_id, b // 16 as bucket, sum(c)::bigint as c from hist group by 1, 2) x using (doc_id, bucket))"""
MEANS = CLASSED + """,
means as (select lang, bucket, count(*) as samples, sum(size)::bigint as sample_bytes, (sum(weight) // count(*))::int as weight from sig group by lang, bucket)"""
BANK = CLASSED + """,
kinds as (select 'Extension:' || ext as kind, null as part, * from sig union all select class, lang, * from sig),
cells as (select kind, part, bucket, count(*) as samples, sum(size)::bigint as sample_bytes, (sum(weight) // count(*))::int as weight from kinds group by kind, part, bucket),
dicts as (select kind, part, any_value(samples) as samples, any_value(sample_bytes) as sample_bytes, list(weight order by bucket) as signature from cells group by kind, part having any_value(samples) >= 8),
bank as (select *, (row_number() over (order by sample_bytes desc, samples desc, kind, signature))::int as id from dicts qualify id <= 255)"""

SQL = {
    "entropy": f"""with {hists(4096)}, e as (select doc_id, -sum(c / n * log2(c / n)) as e from hist join sizes using (doc_id) group by doc_id)
      select doc_id, round(coalesce(e, 0), 6) as entropy, size >= 512 and coalesce(e, 0) > 7.5 as incompressible from sizes left join e using (doc_id)""",
    "probe_offsets": """with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as size from documents),
      o as (select doc_id, case when size >= 2048 then list_distinct([0, (size - 1024) // 2, size - 1024]) else [0::bigint] end as l from d)
      select doc_id, (row_number() over (partition by doc_id order by x) - 1)::int as probe_no, x as probe_offset from (select doc_id, unnest(l) as x from o)""",
    "sample_windows": """with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as size from documents),
      s as (select doc_id, size, greatest(size - 1024, 0) as last, greatest(greatest(size - 1024, 0) // 7, 1024) as stride from d where size > 0),
      o as (select doc_id, 0::bigint as x from s union select doc_id, last from s
            union select doc_id, i * stride from (select *, unnest(range(1, 7)) as i from s) where i * stride < last)
      select doc_id, (row_number() over (partition by doc_id order by x) - 1)::int as window_no, x as window_offset from o""",
    "classify_docs": f"with {CLASSED} select doc_id, ext, class from classed",
    "signatures": f"with {CLASSED} select doc_id, bucket, weight from sig where weight > 0",
    "avg_signature": f"with {MEANS} select * from means",
    "sig_distance": f"with {MEANS} select doc_id, sum(abs(s.weight - m.weight))::int as distance from sig s join means m on s.lang is not distinct from m.lang and s.bucket = m.bucket group by doc_id",
    "sample_caps": """with d as (select doc_id, lang, octet_length(encode(coalesce(text, '')))::bigint as size from documents),
      w as (select *, row_number() over (partition by lang order by doc_id) as n, coalesce(sum(size) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from d)
      select lang, doc_id, size, before from w where n <= 512 and before < 131072""",
    "dict_rank": f"with {BANK} select id, kind, samples, sample_bytes, array_to_string(signature, ',') as signature from bank",
    "dict_select": f"""with {BANK},
      own as (select doc_id, 'Extension:' || ext as ek, class, list(weight order by bucket) as signature from sig group by all),
      hit as (select doc_id, b.*, case when b.kind = ek then 20000 else 10000 end - list_sum(list_transform(range(1, 17), lambda i: abs(own.signature[i] - b.signature[i]))) as score
              from own join bank b on b.kind = ek or b.kind = class)
      select doc_id, id as dictionary_id, score::int as score from hit qualify row_number() over (partition by doc_id order by score desc, samples desc, sample_bytes desc, id desc) = 1""",
}
