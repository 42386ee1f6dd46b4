"""SQL for the coding queries that SQL can express."""

SHARDED = """sharded as (
  select doc_id, text, size, width, (size + width - 1) // width as n, greatest(1, ((size + width - 1) // width * 20 + 99) // 100) as parity
  from (select *, greatest(256, (size + 39) // 40) as width from (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) as size from documents)))"""

SQL = {
    "rs_protect": f"""with {SHARDED} select doc_id, size::bigint as size, n::int as data_shards, (case when n > 0 then parity else 0 end)::int as parity_shards,
      (case when n > 0 then width else 0 end)::int as shard_len from sharded""",
    "rs_repair": f"""with {SHARDED},
      d as (select *, case when n > 0 then len(list_filter(range(0, n + parity), lambda k: (doc_id + k) % 11 = 0 or (doc_id + k) % 13 = 0)) else 0 end as damaged from sharded)
      select doc_id, damaged::int as damaged, case when damaged = 0 then 'ok' when damaged <= parity then 'repaired' else 'lost' end as status,
             case when damaged <= parity then sha256(text) end as digest from d""",
    "aes_roundtrip": "select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 28 as cipher_len, true as same from documents",
    "aes_wrong_key": "select distinct source, true as right_key, false as wrong_key from documents",
    "corrupt_blocks": """select doc_id, case when doc_id % 31 = 0 or (coalesce(text, '') = '') then 'not recorded'
      when doc_id % 29 = 0 or doc_id % 37 = 0 or doc_id % 41 = 0 then 'corrupt' else 'ok' end as status from documents""",
    "archive_violations": "select doc_id as block_id, '' as violation from documents where false",
}
