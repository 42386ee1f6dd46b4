"""SQL for telemetry queries."""

from __future__ import annotations

from corpusgrid.operators.telemetry import PRESETS, PUBLISHED_ARCHIVE, PUBLISHED_EXTRACT

STEPS = """raw_steps as (
  select l_orderkey, l_linenumber, 'run-' || year(l_shipdate) as run, case l_returnflag when 'A' then 'own' when 'N' then 'alpha' else 'beta' end as tool,
         if(l_orderkey % 2 = 0, 'archive', 'extract') as phase, ['fast', 'balanced', 'ultra'][l_suppkey % 3 + 1] as mode, l_linenumber::varchar as workers,
         round(l_extendedprice * 100)::bigint * 10000 as elapsed_ns, l_quantity::bigint * 1048576 as input_bytes, l_quantity,
         (l_quantity::bigint * 1048576 * (30 + l_partkey % 60)) // 100 as output_bytes, if(l_partkey % 7 <> 0, l_tax * 100, null) as cpu_percent,
         if(l_partkey % 5 <> 0, l_partkey * 1024, null) as peak_rss, if(l_partkey % 11 <> 0, l_suppkey * 10, null) as ctx_vol, if(l_partkey % 13 <> 0, l_suppkey * 3, null) as ctx_inv
  from lineitem),
steps as (select *, l_quantity::bigint / (elapsed_ns / 1e9) as throughput, output_bytes / input_bytes as ratio from raw_steps)"""
EVENTS = "ev as (select *, epoch_us(ts) as t_us, round(value * 1000)::bigint as v_us from events)"
STATS = STEPS + """,
s as (select tool, phase, mode, workers, avg(elapsed_ns) / 1e9 as avg_seconds, avg(throughput) as avg_throughput, avg(output_bytes) as avg_output,
             if(sum(input_bytes) > 0, sum(output_bytes) / sum(input_bytes), 0) as ratio from steps group by all)"""
COMPARE = STATS + """,
cmp as (
  select a.mode, a.workers, b.tool as competitor, if(a.avg_seconds <= b.avg_seconds, 'own', b.tool) as archive_fastest,
         if(b.avg_seconds = 0, 0, (a.avg_seconds - b.avg_seconds) / b.avg_seconds * 100) as archive_delta,
         if(x.tool is null or y.tool is null, null, if(x.avg_seconds <= y.avg_seconds, 'own', y.tool)) as extract_fastest,
         if(x.tool is null or y.tool is null, null, if(y.avg_seconds = 0, 0, (x.avg_seconds - y.avg_seconds) / y.avg_seconds * 100)) as extract_delta,
         a.ratio as own_ratio, b.ratio as other_ratio
  from (select * from s where tool = 'own' and phase = 'archive') a join (select * from s where tool <> 'own' and phase = 'archive') b using (mode, workers)
  left join (select * from s where tool = 'own' and phase = 'extract') x using (mode, workers)
  left join (select * from s where tool <> 'own' and phase = 'extract') y on y.mode = a.mode and y.workers = a.workers and y.tool = b.tool)"""


def values(rows: list[tuple]) -> str:
    lit = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::double" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


SIZE = "case when regexp_matches(lower(trim({0})), '^[0-9]') then try_cast(regexp_extract(trim({0}), '^([0-9]+)', 1) as bigint) * case trim(regexp_replace(lower(trim({0})), '^[0-9]+', '')) when '' then 1 when 'b' then 1 when 'k' then 1024 when 'kb' then 1024 when 'm' then 1048576 when 'mb' then 1048576 when 'g' then 1073741824 when 'gb' then 1073741824 end end"

SQL = {
    "published_score": f"""with a(tool, mode, speed, ratio, rss) as (values {values(PUBLISHED_ARCHIVE)}), e(tool, mode, speed, rss) as (values {values(PUBLISHED_EXTRACT)})
      select tool, mode, 'archive' as phase, round(100 * pow(speed / (select max(speed) from a), 0.6) * pow((select min(ratio) from a) / ratio, 0.3) * pow(ln(1 + (select min(rss) from a)) / ln(1 + rss), 0.1), 1) as score from a
      union all select tool, mode, 'extract', round(100 * pow(speed / (select max(speed) from e), 0.9) * pow(ln(1 + (select min(rss) from e)) / ln(1 + rss), 0.1), 1) from e""",
    "step_stats": f"""with {STEPS} select tool, phase, mode, workers, count(*) as passes, round(avg(elapsed_ns) / 1e9, 4) as avg_seconds, round(avg(throughput), 3) as avg_throughput,
      round_even(avg(output_bytes), 0)::bigint as avg_output, round(avg(ratio), 5) as avg_ratio, max(peak_rss) as max_rss, round(avg(cpu_percent), 6) as avg_cpu from steps group by all""",
    "mode_stats": f"with {STATS} select tool, phase, mode, workers, round(avg_seconds, 4) as avg_seconds, round(avg_throughput, 3) as avg_throughput, round(avg_output, 2) as avg_output, round(ratio, 5) as ratio from s",
    "fastest_step": f"""with {STEPS}
      select * from (select 'fastest' as what, tool, phase, mode, workers, elapsed_ns, output_bytes from steps order by elapsed_ns, l_orderkey, l_linenumber limit 1)
      union all select * from (select 'smallest', tool, phase, mode, workers, elapsed_ns, output_bytes from steps order by output_bytes, l_orderkey, l_linenumber limit 1)""",
    "latest_run": f"with {STEPS} select run, count(*) as steps, sum(input_bytes)::bigint as input_bytes from steps group by run order by run desc limit 1",
    "steps_union": f"with {STEPS} select run, tool, phase, mode, workers, count(*) as steps from (select distinct run, tool, phase, mode, workers, l_orderkey, l_linenumber from steps where tool <> 'beta' or mode <> 'ultra') group by all",
    "donor_runs": f"""with {STEPS}, runs as (select run, count(*) as n, right(run, 4)::int % 2 as src, right(run, 4)::int % 3 = 0 as raw from steps group by run), l as (select * from runs order by run desc limit 1)
      select (select count(*) from runs) - 1 as prior_runs, count(*) as donors, (select count(*) from runs) - 1 - count(*) as incompatible, coalesce(sum(r.n), 0)::bigint as donated_steps
      from runs r, l where r.run < l.run and r.src = l.src and r.raw = l.raw""",
    "host_summary": f"""with {STEPS}, x as (select tool, phase, mode, workers, avg(v) as ctx from (select tool, phase, mode, workers, ctx_vol as v from steps union all select tool, phase, mode, workers, ctx_inv from steps) group by all),
      h as (select tool, phase, mode, workers, greatest(count(cpu_percent), count(peak_rss), count(ctx_vol), count(ctx_inv)) as samples, round(avg(cpu_percent), 6) as avg_cpu, max(peak_rss) as max_rss from steps group by all)
      select h.*, round_even(ctx, 0)::bigint as avg_ctx from h join x using (tool, phase, mode, workers)""",
    "metric_summary": f"""with {STEPS}, m as (
        select tool, phase, 'stage:elapsed' as metric, elapsed_ns // 1000 as v from steps where tool = 'own' union all select tool, phase, 'queue:rss', peak_rss from steps where tool = 'own'
        union all select tool, phase, 'queue:ctx', coalesce(ctx_vol, ctx_inv) from steps where tool = 'own')
      select tool, phase, metric, min(v) as min_v, round_even(avg(v), 0)::bigint as avg_v, max(v) as max_v, count(*) as samples from m where v is not null group by all""",
    "efficiency": f"""with {STATS}, c as (select a.tool, a.mode, a.workers, 1 / a.ratio as cr, a.avg_throughput as cs, e.avg_throughput as ds from s a join s e on a.tool = e.tool and a.mode = e.mode and a.workers = e.workers and a.phase = 'archive' and e.phase = 'extract' where a.ratio > 0),
      m as (select max(cr) as mcr, max(cs) as mcs, max(ds) as mds from c)
      select tool, mode, workers, round(cr / mcr, 5) as ncr, round(cs / mcs, 5) as ncs, round(ds / mds, 5) as nds, round(0.4 * (cr / mcr) + 0.3 * (cs / mcs) + 0.3 * (ds / mds), 5) as score from c, m""",
    "tool_compare": f"""with {COMPARE} select mode, workers, competitor, archive_fastest, round(archive_delta, 4) as archive_delta, extract_fastest, round(extract_delta, 4) as extract_delta,
      case sign(archive_delta) when 0 then 'equal' when -1 then 'faster' else 'slower' end as label, round(own_ratio, 5) as own_ratio, round(other_ratio, 5) as other_ratio from cmp""",
    "takeaways": f"""with {COMPARE}, a as (select * from cmp qualify row_number() over (partition by mode order by abs(archive_delta), workers, competitor) = 1),
      e as (select * from cmp where extract_delta is not null qualify row_number() over (partition by mode order by abs(extract_delta), workers, competitor) = 1),
      r as (select * from cmp qualify row_number() over (partition by mode order by own_ratio, workers, competitor) = 1)
      select a.mode, a.workers as archive_workers, a.competitor as archive_competitor, e.competitor as extract_competitor, r.workers as ratio_workers, round(r.own_ratio, 5) as best_ratio from a left join e using (mode) join r using (mode)""",
    "batch_totals": f"""with {STEPS} select run, count(*) as passes, sum(input_bytes)::bigint as bytes, round(sum(elapsed_ns) / 1e9, 3) as seconds, round(sum(elapsed_ns) / 1e9 / count(*), 4) as seconds_per_pass,
      round(sum(input_bytes) / 1048576 / (sum(elapsed_ns) / 1e9), 6) as throughput from steps group by run""",
    "steps_clean": f"""with {EVENTS}, r as (select event_id, replace(trim(case event_id % 5 when 0 then ' ' || v_us || ' ' when 1 then (v_us // 1000) || ',' || lpad((v_us % 1000)::varchar, 3, '0') when 2 then 'n/a' when 3 then v_us || '.5' else '' end), ',', '') as t from ev)
      select event_id, if(regexp_full_match(t, '[+-]?[0-9]+'), try_cast(t as bigint), null) as int_value, try_cast(t as double) as value from r where t <> '' and try_cast(t as double) is not null""",
    "worker_util": f"""with {EVENTS}, w as (select user_id as worker_id, count(*) as tasks, max(t_us) - min(t_us) as uptime, least(sum(v_us), max(t_us) - min(t_us))::bigint as busy from ev group by user_id)
      select worker_id, tasks, uptime, busy, uptime - busy as idle, round(if(uptime = 0, 0, busy / uptime), 6) as utilization, round((select sum(busy) from w) / (select max(t_us) - min(t_us) from ev), 6) as effective_cores,
             (select min(tasks) from w) as least_tasks, (select max(tasks) from w) as most_tasks from w""",
    "run_rates": f"with {EVENTS} select event_type, sum(v_us)::bigint as bytes, max(t_us) - min(t_us) as us, round(if(sum(v_us) = 0, 0, sum(v_us) / greatest((max(t_us) - min(t_us)) / 1e6, 1e-6)), 4) as bytes_per_s from ev group by event_type",
    "shard_payload": f"""with {EVENTS}, t as (select event_type, coalesce(sum(v_us) filter (where user_id % 2 = 0 and length(event_type) % 2 = 0), 0)::bigint as ss, max(v_us) filter (where user_id % 2 = 0 and length(event_type) % 2 = 0) as sm, max(v_us) filter (where user_id % 2 = 1) as o from ev group by event_type)
      select event_type, if(ss > 0, ss, coalesce(o, 0)) as payload_sum, if(ss > 0, sm, coalesce(o, 0)) as payload_max from t""",
    "latency_hist": f"with {EVENTS} select event_type, count(*) as n, sum(v_us)::bigint as total, min(v_us) as least, max(v_us) as most, round(avg(v_us), 4) as mean from ev group by event_type",
    "counters": f"""with {EVENTS} select event_type, sum(v_us)::bigint as counter, arg_max(v_us, (t_us, event_id)) as gauge,
      list_reduce(list_prepend(0::bigint, list(if(event_id % 3 = 0, -v_us, v_us) order by t_us, event_id)), lambda a, d: greatest(a + d, 0))::bigint as floored_gauge from ev group by event_type""",
    "live_rates": f"""with {EVENTS}, p as (select user_id as run_id, event_id, t_us - min(t_us) over (partition by user_id) as elapsed_us, (sum(v_us) over (partition by user_id order by t_us, event_id rows unbounded preceding))::bigint as done from ev),
      l as (select *, done - coalesce(lag(done) over w, 0) as db, elapsed_us - coalesce(lag(elapsed_us) over w, 0) as du, done / greatest(elapsed_us / 1e6, 1e-6) as a from p window w as (partition by run_id order by elapsed_us, event_id)),
      i as (select *, if(du > 0, db / (du / 1e6), a) as inst from l)
      select run_id, event_id, elapsed_us, done, round(a, 4) as avg_bps, round(inst, 4) as instant_bps, round(max(inst) over (partition by run_id order by elapsed_us, event_id rows unbounded preceding), 4) as peak_bps from i""",
    "hotspots": f"""with {EVENTS}, h as (select replace(replace(event_type, '.', ' '), '_', ' ') || if(length(event_type) % 2 = 0, ' latency', ' time') as label, avg(v_us) as mean, max(v_us)::double as most, sum(v_us)::double as total from ev group by event_type)
      select * from (select label || ' mean' as label, round(mean, 4) as value from h union all select label || ' max', most from h union all select label || ' total', total from h) order by value desc, label limit 12""",
    "flat_report": f"""with {EVENTS}, a as (select event_type, count(*)::varchar as c, sum(v_us)::bigint::varchar as t, max(v_us)::varchar as m from ev group by event_type)
      select 'stage.' || event_type || '.count' as key, c as value from a union all select 'stage.' || event_type || '.total', t from a union all select 'stage.' || event_type || '.max', m from a""",
    "event_props": """select event_type, count(*) as n, sum(coalesce(json_extract_string(props, '$.k')::bigint, -1))::bigint as k_sum, count(json_extract_string(props, '$.missing.deep')) as deep from events group by event_type""",
    "reorder_peak": f"""with {EVENTS}, r as (select row_number() over (order by t_us, event_id % 7, event_id) - 1 as arrival, row_number() over (order by event_id) - 1 as id from ev),
      f as (select arrival, max(arrival) over (order by id) as released from r)
      select count(*) as items, max(released - arrival) as longest_wait, sum(released - arrival)::bigint as total_wait, count(*) filter (where released > arrival) as waited from f""",
    "preset_resolve": f"""with p(preset, compressor, level, block_size, pool_buffers, dedup_window) as (values {values(PRESETS)}), o(preset, b) as (values ('fast', '64K'), ('ultra', '4M')), d as (select * from p where preset = 'defaults'),
      r as (select p.preset, coalesce(p.compressor, d.compressor) as compressor, coalesce(p.level, d.level)::int as level, coalesce(o.b, p.block_size, d.block_size) as bs, coalesce(p.pool_buffers, d.pool_buffers)::int as pool_buffers, coalesce(p.dedup_window, d.dedup_window)::int as dedup_window
            from p left join o using (preset), d where p.preset <> 'defaults')
      select preset, compressor, level, {SIZE.format('bs')} as block_bytes, pool_buffers, dedup_window from r""",
    "preset_violations": """with d as (select doc_id, ['lz4', 'zstd', 'lzma'][doc_id % 3 + 1] as algo, if(doc_id % 4 <> 0, doc_id % 25, null) as level, doc_id % 7 = 0 as extreme, if(doc_id % 5 = 0, doc_id * 16, null) as ds, doc_id * 1000 as win from documents)
      select doc_id, 'level_not_supported' as violation from d where algo = 'lz4' and level is not null
      union all select doc_id, 'zstd_level' from d where algo = 'zstd' and (level < 1 or level > 22) union all select doc_id, 'lzma_level' from d where algo = 'lzma' and (level < 1 or level > 9)
      union all select doc_id, 'extreme_not_lzma' from d where extreme and algo <> 'lzma' union all select doc_id, 'dictionary_not_lzma' from d where ds is not null and algo <> 'lzma'
      union all select doc_id, 'dictionary_small' from d where ds < 4096 and algo = 'lzma' union all select doc_id, 'window' from d where win > 131072""",
    "parse_sizes": f"with t as (select doc_id, doc_id || ['K', ' kb', 'M', 'mb ', 'G', '', 'b', 'x'][doc_id % 8 + 1] as txt from documents) select doc_id, txt, {SIZE.format('txt')} as bytes from t",
    "parse_durations": """with t as (select doc_id, case doc_id % 6 when 0 then doc_id || 'us' when 1 then doc_id || '.25ms' when 2 then doc_id || '.5s' when 3 then (doc_id % 60) || ':07' when 4 then '01:' || (doc_id % 60) || ':30.5' else '-' end as txt from documents)
      select doc_id, txt, (case when txt like '%us' then floor(replace(txt, 'us', '')::double) when txt like '%ms' then round_even(replace(txt, 'ms', '')::double * 1000, 0) when txt like '%s' then round_even(replace(txt, 's', '')::double * 1000000, 0)
        when doc_id % 6 = 3 then round_even((string_split(txt, ':')[1]::double * 60 + string_split(txt, ':')[2]::double) * 1000000, 0)
        when doc_id % 6 = 4 then round_even(((string_split(txt, ':')[1]::double * 60 + string_split(txt, ':')[2]::double) * 60 + string_split(txt, ':')[3]::double) * 1000000, 0) else 0 end)::bigint as us from t""",
    "fmt_bytes": """with n as (select doc_id, doc_id * doc_id * doc_id * 1000 as n from documents)
      select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.2f', n / 1024) || ' KiB' when n < 1073741824 then printf('%.2f', n / 1048576) || ' MiB'
        when n < 1099511627776 then printf('%.2f', n / 1073741824) || ' GiB' else printf('%.2f', n / 1099511627776) || ' TiB' end as label from n""",
    "slugs": "select doc_id, trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '_') as slug from documents",
    "parity_plan": """with d as (select doc_id, octet_length(encode(text))::bigint * 40000 as len from documents), s as (select doc_id, len, greatest(1048576, (len + 199) // 200) as shard from d where len >= 40),
      p as (select doc_id, shard, (len + shard - 1) // shard as data, unnest([5, 10, 50]) as pct from s), q as (select *, greatest(1, (data * pct + 99) // 100) as parity from p)
      select doc_id, pct, shard, data, parity, data + parity <= 255 as valid from q""",
    "repairable": """with g as (select doc_id // 20 as stripe, count(*) as data, count(*) filter (where doc_id * doc_id % 9 = 4) as missing from documents group by 1)
      select *, greatest(1, (data * 10 + 99) // 100) as parity, missing <= greatest(1, (data * 10 + 99) // 100) as repairable from g""",
    "steps_jsonl": """select event_type as tool, 'archive' as phase, event_id as elapsed_ns, if(event_id % 6 = 3, '4', '0') as workers from events where event_id % 6 in (3, 4, 5)""",
}
SQL["steps_written"] = SQL["steps_jsonl"]
SQL["report_fields"] = """select doc_id as id, unnest(['field', 'field', 'field', 'field', 'stage', 'stage']) as kind,
  unnest(['writer_peak', 'effective_cores', 'max_inflight_bytes', 'scheduler', 'read', 'dedup_raw']) as name,
  unnest([doc_id::varchar, (doc_id % 8) || '.5', doc_id || '.50 KiB', 'fair', doc_id || 'us', '1.5ms']) as value,
  unnest([doc_id::double, doc_id % 8 + 0.5, doc_id * 1024.0 + 512, null, doc_id::double, 1500.0]) as number from documents"""
SQL["report_workers"] = "select doc_id as id, 0::bigint as worker_id, doc_id as tasks, 0.125::double as utilization, 2000::bigint as busy_us, 1000000::bigint as idle_us, 3::bigint as uptime_us from documents"
