"""SQL for planning, selection, dedup, statistics and hierarchy queries: plain predicates and global windows."""

from __future__ import annotations

from corpusgrid.operators.planning import PACK_EXTENSIONS, RAW_EXTENSIONS

FILES = """files as (
  select doc_id, 'documents/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(doc_id::varchar, 'none') || case when doc_id % 17 = 0 then '.gz' else '.txt' end as path,
         octet_length(encode(coalesce(text, '')))::bigint as size, coalesce(doc_id % 17 = 0, false) as force_raw
  from documents)"""
ORDERED = FILES + """,
grouped as (select *, case when size > 8192 then 0 when not force_raw then 1 else 2 end as grp from files),
ordered as (
  select *, row_number() over (order by grp, path) as place,
         (sum(size) over (order by grp, path rows unbounded preceding) - size)::bigint as content_offset
  from grouped)"""
RUNS = ORDERED + """,
flipped as (select *, case when force_raw is distinct from lag(force_raw) over (order by grp, path) then 1 else 0 end as flip from ordered where size > 0),
tagged as (select *, (sum(flip) over (order by grp, path rows unbounded preceding))::bigint as run_id from flipped),
runs as (
  select run_id, force_raw, min(content_offset) as run_start, sum(size)::bigint as run_bytes, ceil(sum(size) / 65536.0)::bigint as blocks
  from tagged group by run_id, force_raw)"""
BLOCKS = RUNS + """,
numbered as (select *, (sum(blocks) over (order by run_id rows unbounded preceding) - blocks)::bigint as first_block from runs),
blocks as (
  select first_block + i as block_id, run_id, force_raw, run_start + i * 65536 as raw_offset,
         least(65536, run_bytes - i * 65536)::bigint as raw_len
  from (select *, unnest(range(0, blocks)) as i from numbered)),
extents as (
  select block_id, path, content_offset, greatest(content_offset, raw_offset) - raw_offset as block_offset,
         greatest(content_offset, raw_offset) - content_offset as file_offset,
         least(content_offset + size, raw_offset + raw_len) - greatest(content_offset, raw_offset) as len
  from ordered join blocks on size > 0 and content_offset < raw_offset + raw_len and raw_offset < content_offset + size)"""
PREFIX = "(path = 'documents/src1' or starts_with(path, 'documents/src1/') or path = 'documents/src3/de' or starts_with(path, 'documents/src3/de/'))"
REGEX = r"(regexp_matches(path, 'src7/.*/\d*5\.txt$') or regexp_matches(path, '\.gz$'))"
PRUNED = BLOCKS + f""",
want as (select content_offset as s, content_offset + size as e from ordered where size > 0 and {PREFIX}),
kept as (select * from blocks where exists (select 1 from want where raw_offset < e and s < raw_offset + raw_len))"""
ENCODED = BLOCKS + """,
encoded0 as (
  select *, case block_id % 3 when 0 then 'lz4' when 1 then 'zstd' else 'lzma' end as algo,
         case when block_id % 11 = 10 then block_id - 10 end as reference_target from blocks),
encoded as (
  select *, (force_raw or block_id % 7 = 3) and reference_target is null as raw_passthrough,
         (case when reference_target is not null then 0 when force_raw or block_id % 7 = 3 then raw_len
               else raw_len * (40 + block_id % 60) // 100 end)::bigint as encoded_len
  from encoded0)"""
COSTS = ENCODED + """,
pieces as (
  select path, size, encoded.*, least(content_offset + size, raw_offset + raw_len) - greatest(content_offset, raw_offset) as overlap
  from ordered join encoded on size > 0 and content_offset < raw_offset + raw_len and raw_offset < content_offset + size),
costs0 as (
  select path, size, round(sum(encoded_len * overlap / raw_len), 4) as est_bytes,
         sum(case when raw_passthrough then overlap else 0 end)::bigint as raw_bytes,
         sum(case when not raw_passthrough and reference_target is null and encoded_len / raw_len >= 0.98 then overlap else 0 end)::bigint as near_raw_bytes,
         sum(case when reference_target is not null then overlap else 0 end)::bigint as reference_bytes,
         sum(case when algo = 'lz4' then overlap else 0 end)::bigint as lz4_bytes,
         sum(case when algo = 'zstd' then overlap else 0 end)::bigint as zstd_bytes,
         sum(case when algo = 'lzma' then overlap else 0 end)::bigint as lzma_bytes
  from pieces group by path, size),
costs as (select *, round(est_bytes / size, 6) as est_ratio from costs0)"""
VARIED = """varied as (
  select case doc_id % 4 when 0 then '.git/objects/pack/' when 1 then 'x/.git/refs/' when 2 then 'a.b/.git/objects/pack/p' else 'docs/.' end
         || doc_id || ['.txt', '.JPG', '.tar.gz', '.idx', '.Zst', '', '.pack', '.', '.json'][(doc_id // 4) % 9 + 1] as path
  from documents),
named as (select path, string_split(path, '/')[-1] as name, string_split(path, '/') as parts from varied),
exts as (select *, case when position('.' in name[2:]) > 0 then nullif(lower(string_split(name, '.')[-1]), '') end as ext from named)"""
LABELS = ", ".join(f"'{x}'" for x in RAW_EXTENSIONS)
PACKS = ", ".join(f"'{x}'" for x in PACK_EXTENSIONS)
CORPUS = """corpus as (
  select 'documents/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(doc_id::varchar, 'none') || case when doc_id % 17 = 0 then '.gz' else '.txt' end as path,
         octet_length(encode(coalesce(text, '')))::bigint as size from documents
  union all select 'pages/' || page_id || '.html', octet_length(encode(coalesce(html, '')))::bigint from pages
  union all select 'conversations/' || conv_id || '.json', sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint from conversations group by conv_id)"""

SQL = {
    "corpus_files": f"with {CORPUS} select * from corpus",
    "corpus_size": f"with {CORPUS} select string_split(path, '/')[1] as top, count(*) as files, sum(size)::bigint as bytes, max(size) as largest from corpus group by 1",
    "ext_counts": f"with {VARIED} select ext, count(*) as files from exts group by ext",
    "raw_policy": f"""with {VARIED}
      select path, ext, coalesce(ext in ({LABELS}), false) or coalesce(ext in ({PACKS})
        and parts[list_position(parts, '.git') + 1] = 'objects' and parts[list_position(parts, '.git') + 2] = 'pack'
        and len(parts) > list_position(parts, '.git') + 2, false) as force_raw from exts""",
    "file_order": f"with {ORDERED} select path, grp, place, content_offset from ordered",
    "manifest": f"""with {ORDERED},
      folders as (select distinct array_to_string(p[1:i], '/') as path from (select p, unnest(range(1, len(p))) as i from (select string_split(path, '/') as p from files))),
      every as (
        select 0 as part, path, 'directory' as kind, null as target, 0::bigint as size, 0::bigint as place, 0::bigint as content_offset from folders
        union all select 1, 'links/' || doc_id, 'symlink', '../' || path, 0, 0, 0 from files where doc_id % 101 = 0
        union all select 2, path, 'file', null, size, place, content_offset from ordered)
      select row_number() over (order by part, place, path) as entry_no, path, kind, target, size, content_offset from every""",
    "unsafe_paths": """with p as (select page_id, case page_id % 6 when 0 then '/' || page_id when 1 then 'a/../' || page_id when 2 then 'ok/' || page_id
        when 3 then page_id || '/..' when 4 then 'a/..b/' || page_id else '' end as path from pages)
      select * from p where path = '' or starts_with(path, '/') or list_contains(string_split(path, '/'), '..')""",
    "scan_chunks_fixed": f"""with {FILES}, c as (select path, size, unnest(range(0, (size + 4095) // 4096)) as chunk_no from files)
      select path, chunk_no, chunk_no * 4096 as chunk_offset, least(4096, size - chunk_no * 4096)::bigint as chunk_len from c""",
    "dir_blocks": f"with {RUNS} select * from runs",
    "dir_block_count": f"with {RUNS} select sum(blocks)::bigint as blocks, count(*) as runs from runs",
    "inflight_limits": f"""with {RUNS}, t as (select sum(blocks)::bigint as b from runs), w as (select unnest([1, 4, 16, 64, 1024]) as workers)
      select workers, least(greatest(least(least(greatest(workers * 16, 64), 4096), 256), 1), greatest(b, 1))::bigint as inflight_blocks,
             least(greatest((workers + 1) // 2, 1), 8)::bigint as auto_shards from w, t""",
    "stream_ids": f"""with {ORDERED}, f as (select string_split(path, '/')[2] as source, min(place) as first_place from ordered group by 1)
      select *, row_number() over (order by first_place) as stream_id from f""",
    "block_source": f"""with {BLOCKS}
      select block_id, case when count(distinct coalesce(nullif(regexp_extract(path, '\\.([^./]*)$', 1), ''), '')) = 1 then min_by(path, content_offset) else 'documents' end as source_path
      from extents group by block_id""",
    "dict_gate": f"""with {FILES}, g as (
        select string_split(path, '/')[2] as source, count(*) as files, count(*) filter (where size <= 131072) as small_files, (sum(size) // count(*))::bigint as mean_bytes
        from files group by 1)
      select *, files >= 8 and small_files >= 8 as dir_gate, files >= 8 and mean_bytes <= 131072 as file_gate from g""",
    "extents": f"with {BLOCKS} select block_id, path, block_offset, file_offset, len from extents",
    "select_prefix": f"with {FILES} select path, size from files where {PREFIX}",
    "select_regex": f"with {FILES} select path, size from files where {REGEX}",
    "select_union": f"with {FILES} select path, size from files where {PREFIX} or {REGEX}",
    "prune_blocks": f"with {PRUNED} select block_id, raw_offset, raw_len from kept",
    "project_ranges": f"""with {PRUNED},
      axis as (select *, (sum(raw_len) over (order by block_id rows unbounded preceding) - raw_len)::bigint as ofs from kept),
      p as (select greatest(raw_offset, s) - raw_offset + ofs as a, least(raw_offset + raw_len, e) - raw_offset + ofs as b from axis join want on raw_offset < e and s < raw_offset + raw_len),
      o as (select *, case when a > lag(b) over (order by a) or lag(b) over (order by a) is null then 1 else 0 end as opens from p),
      i as (select *, sum(opens) over (order by a rows unbounded preceding) as island from o)
      select min(a) as range_start, max(b) as range_end from i group by island""",
    "clip_ranges": f"""with {PRUNED}
      select block_id, greatest(raw_offset, s) - raw_offset as skip, least(raw_offset + raw_len, e) - greatest(raw_offset, s) as take
      from kept join want on raw_offset < e and s < raw_offset + raw_len""",
    "file_cost": f"with {COSTS} select * from costs",
    "file_topk": f"""with {COSTS}
      select * from (select 'size' as list, path, size, est_bytes, est_ratio from costs order by size desc, est_bytes desc, path limit 10)
      union all select * from (select 'est_bytes', path, size, est_bytes, est_ratio from costs order by est_bytes desc, size desc, path limit 10)
      union all select * from (select 'est_ratio', path, size, est_bytes, est_ratio from costs order by est_ratio desc, est_bytes desc, path limit 10)""",
    "queue_profile": f"""with {ENCODED},
      a as (select count(*) as n, max(raw_len) as max_raw, max(encoded_len) as max_enc, (percentile_disc(0.95) within group (order by greatest(raw_len, encoded_len)))::bigint as p95 from encoded),
      b as (select *, least(greatest(ceil(greatest(1048576, p95) / p95)::bigint, 1), greatest(n, 1)) as inflight from a),
      c as (select *, greatest(least(32, inflight, n), 1)::bigint as decode_q, ceil(greatest(max_raw, max_enc, 1) / greatest(p95, 1)) as skew from b),
      d as (select *, decode_q + ceil(greatest(inflight - decode_q, 0) * case when skew <= 2 then 3 when skew <= 4 then 2 else 1 end / 4)::bigint as adaptive from c),
      e as (select *, least(greatest(greatest(least(64, inflight, n), 1), adaptive, decode_q), inflight, n)::bigint as write_q from d)
      select n, max_raw, max_enc, p95, inflight, decode_q, write_q, greatest(least(write_q * 8, inflight, n), 1)::bigint as reorder_limit from e""",
}

DOC_BLOCKS = """db as (
  select doc_id, length(lang) % 3 + 1 as flags, doc_id % 17 = 0 as raw, case when lang = 'en' then 1 else 0 end as dictionary_id,
         octet_length(encode(coalesce(text, '')))::bigint as raw_len, least(octet_length(encode(coalesce(text, ''))), 4096)::bigint as encoded_len, sha256(coalesce(text, '')) as digest
  from documents)"""
TREE = CORPUS + """,
nodes as (select size, array_to_string(p[1:i], '/') as path, i, len(p) as n from (select size, p, unnest(range(1, len(p) + 1)) as i from (select size, string_split(path, '/') as p from corpus))),
tree as (select path, max(i)::int as depth, bool_or(i < n) as is_dir, count(*) as files, sum(size)::bigint as bytes from nodes group by path)"""
FAULTY = ENCODED + """,
faulty as (
  select * replace (case when block_id % 13 = 5 then raw_offset + 7 else raw_offset end as raw_offset, case when block_id % 19 = 8 then 0 else raw_len end as raw_len) from encoded),
lagged as (
  select f.*, coalesce(lag(f.raw_offset + f.raw_len) over (order by f.block_id), 0) as before, t.block_id as t_id, t.raw_len as t_len
  from faulty f left join (select * from faulty where reference_target is null) t on f.reference_target = t.block_id)"""

SQL |= {
    "raw_dedup": """with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as digest from documents)
      select *, nullif(min(doc_id) over (partition by size, digest), doc_id) as target from d""",
    "block_dedup": f"""with {DOC_BLOCKS} select doc_id, raw_len, encoded_len,
      nullif(min(doc_id) over (partition by flags, raw, dictionary_id, raw_len, encoded_len, digest), doc_id) as target from db""",
    "ref_resolve": """with recursive c as (select doc_id as id, case when doc_id % 5 <> 0 then doc_id - 1 end as target from documents),
      r(id, cur) as (select id, id from c union all select r.id, c.target from r join c on r.cur = c.id where c.target is not null)
      select id, min(cur) as data_id from r group by id""",
    "ref_fanin": """with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as size, min(doc_id) over (partition by coalesce(text, '')) as f from documents)
      select f as target, count(*) as refs, sum(size)::bigint as saved_bytes from d where f <> doc_id group by f""",
    "dup_report": """with g as (select lang, octet_length(encode(coalesce(text, ''))) as size, coalesce(text, '') as t, count(*) as c from documents group by all having count(*) > 1)
      select lang, count(*) as groups, sum(c - 1)::bigint as extra, sum((c - 1) * size)::bigint as extra_bytes from g group by lang""",
    "block_stats": f"""with {ENCODED} select algo, count(*) as blocks, sum(raw_len)::bigint as raw_bytes, sum(encoded_len)::bigint as encoded_bytes,
      round(sum(encoded_len) / sum(raw_len), 6) as ratio, count(*) filter (where raw_passthrough) as raw_blocks,
      count(*) filter (where not raw_passthrough and reference_target is null and encoded_len / raw_len >= 0.98) as near_raw_blocks,
      count(reference_target) as "references" from encoded group by algo""",
    "chunk_runs": f"""with {ENCODED},
      s as (select *, force_raw::varchar || '|' || raw_passthrough::varchar || '|' || (reference_target is not null)::varchar || '|' || (raw_len = 65536)::varchar as sig from encoded),
      o as (select *, case when sig is distinct from lag(sig) over (order by block_id) then 1 else 0 end as opens from s),
      r as (select *, sum(opens) over (order by block_id rows unbounded preceding)::bigint as run_no from o)
      select run_no, sig, min(block_id) as first_block, max(block_id) as last_block, count(*) as blocks, sum(encoded_len)::bigint as encoded_bytes from r group by run_no, sig""",
    "head_tail": f"""with {ENCODED}, n as (select count(*) as n from encoded)
      select part, block_id, raw_offset, raw_len, algo, greatest(n - 12, 0)::bigint as omitted from n, (
        select * from (select 'head' as part, * from encoded order by block_id limit 6)
        union all select * from (select 'tail', * from encoded order by block_id desc limit 6))""",
    "manifest_stats": f"""with {FILES} select string_split(path, '/')[2] as source, count(*) as files, count(*) filter (where force_raw) as raw_files,
      sum(size)::bigint as payload_bytes, sum(strlen(path))::bigint as path_bytes,
      sum(case when size < 1 << 7 then 1 when size < 1 << 14 then 2 when size < 1 << 21 then 3 when size < 1 << 28 then 4 else 5 end)::bigint as size_bytes from files group by 1""",
    "layout_violations": f"""with {FAULTY}
      select block_id, 'gap' as violation from lagged where raw_offset > before
      union all select block_id, 'overlap' from lagged where raw_offset < before
      union all select block_id, 'empty' from lagged where raw_len <= 0
      union all select block_id, 'bad_reference' from lagged where reference_target is not null and (t_id is null or t_id >= block_id)
      union all select block_id, 'reference_length' from lagged where reference_target is not null and t_len <> raw_len
      union all select block_id, 'raw_length' from lagged where raw_passthrough and encoded_len <> raw_len
      union all select block_id, 'not_smaller' from lagged where not raw_passthrough and reference_target is null and encoded_len >= raw_len""",
    "dict_missing": f"""with {DOC_BLOCKS} select doc_id, (doc_id % 4)::int as dictionary_id, flags::int as flags from db
      where doc_id % 4 > 0 and (doc_id % 4, flags) not in ((1, 1), (1, 3), (2, 3))""",
    "tree_rollup": f"with {TREE} select * from tree",
    "tree_summary": f"""with {TREE} select count(*) filter (where not is_dir) as files, count(*) filter (where is_dir) as directories,
      sum(bytes) filter (where not is_dir)::bigint as payload_bytes, max(depth) as deepest from tree""",
    "tree_listing": f"""with {TREE}, l as (select path, is_dir, bytes, string_split(path, '/')[-1] as name, array_to_string(string_split(path, '/')[1:-2], '/') as parent from tree)
      select *, (row_number() over (partition by parent order by not is_dir, name))::int as place from l""",
    "implicit_dirs": f"""with {FILES}, p as (select string_split(path, '/') as p, path from files),
      implied as (select distinct array_to_string(p[1:i], '/') as dir from (select p, unnest(range(1, len(p))) as i from p))
      select dir, 'd---------' as mode, 'unknown time' as mtime from implied where dir not in (select array_to_string(p[1:-2], '/') from p where path like '%/de/%')""",
    "depth_hist": f"with {CORPUS} select len(string_split(path, '/'))::int as depth, count(*) as files, sum(size)::bigint as bytes from corpus group by 1",
    "mode_labels": """select doc_id, case doc_id % 3 when 0 then 'd' when 1 then 'l' else '-' end ||
      list_reduce(list_transform(range(9), lambda i: case when (doc_id * 37 % 512) & (1 << (8 - i)) <> 0 then 'rwx'[i % 3 + 1] else '-' end), lambda a, b: a || b) as label from documents""",
    "mtime_labels": """select doc_id, strftime(make_timestamp((doc_id - 500) * 1234567 * 1000000), '%Y-%m-%d %H:%M:%S') ||
      case when doc_id % 2 = 0 or doc_id * 7919 % 1000000000 = 0 then '' else '.' || lpad((doc_id * 7919 % 1000000000)::varchar, 9, '0') end as label from documents""",
    "manifest_prefix": f"""with {FILES}, l as (select path, coalesce(lag(path) over (order by path), '') as prev from files),
      c as (select *, coalesce(list_min(list_filter(range(1, least(length(path), length(prev)) + 1), lambda i: path[i] <> prev[i])) - 1, least(length(path), length(prev))) as common from l)
      select string_split(path, '/')[2] as source, count(*) as paths, sum(common)::bigint as shared_bytes,
             sum(case when common < 128 then 1 else 2 end + 1 + length(path) - common)::bigint as coded_bytes from c group by 1""",
    "tree_diff": """with d as (select doc_id as i, octet_length(encode(coalesce(text, ''))) as size, sha256(coalesce(text, '')) as digest from documents),
      e as (select i::varchar as path, size, digest from d),
      a as (select case when i % 50 = 7 then 'new/' || i else i::varchar end as path, case when i % 30 = 4 then size + 1 else size end as size, case when i % 35 = 6 then '0' else digest end as digest from d where i % 40 <> 3)
      select * from (select coalesce(e.path, a.path) as path, case when a.path is null then 'missing' when e.path is null then 'extra' when e.size <> a.size then 'size' when e.digest <> a.digest then 'content' end as status
        from e full join a on e.path = a.path) where status is not null""",
}

SQL |= {
    "seeded_shuffle": "select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) as place from documents",
    "file_manifest": f"with {FILES} select 1::bigint as entry_no, string_split(path, '/')[-1] as path, 'file' as kind, size, 0::bigint as content_offset from files",
    "duplicate_ids": """with d as (select case when doc_id % 17 = 3 then doc_id - 1 else doc_id end as index from documents)
      select index, count(*) as rows from d group by index having count(*) > 1""",
}

PATHS = "select 'documents/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(doc_id::varchar, 'none') || case when doc_id % 17 = 0 then '.gz' else '.txt' end as path"
SQL |= {
    "archive_entries": f"{PATHS}, 'file' as kind, octet_length(encode(coalesce(text, '')))::bigint as size from documents",
    "archive_files": f"{PATHS}, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as digest from documents",
    "restore_tree": f"{PATHS}, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as digest from documents",
    "archive_cost": f"select path, size, size as held_bytes, true as no_larger from ({PATHS}, octet_length(encode(coalesce(text, '')))::bigint as size from documents) where size > 0",
}
SQL["archive_encrypted"] = SQL["archive_dictionaries"] = SQL["archive_files"]
SQL["archive_flags"] = "select state, true as archives, state = 'encrypted' as encrypted, false as recovery, true as right_key, state = 'plain' as wrong_key from (values ('plain'), ('encrypted')) t(state)"
