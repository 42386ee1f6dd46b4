"""SQL that streaming queries must agree with once all input has come."""

from corpusgrid.oracles.telemetry import SQL as TELEMETRY

SQL = {
    "live_rates_stream": TELEMETRY["live_rates"],
    "first_copies_stream": "select distinct octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as digest from documents",
    "reorder_stream": """with e as (select event_id % 4 as run_id, event_id // 4 as id, epoch_us(ts) + event_id // 4 % 5 * 3000000000 as t from events),
      a as (select run_id, id, row_number() over (partition by run_id order by t, id) - 1 as arrival from e)
      select *, max(arrival) over (partition by run_id order by id) as released from a""",
}
