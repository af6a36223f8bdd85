"""The same queries as SQL for DuckDB, over the same tables. Fixtures come first as common table expressions."""

from __future__ import annotations

FIXTURES = {
    "ev_log": """select concat('user:', user_id) as key, event_id + 1 as seq, case when (event_id + 1) % 7 = 0 then 2 else 1 end as type,
        case when (event_id + 1) % 7 = 0 then '' else event_type end as value from events""",
    "ord_log": """select concat('cust:', o_custkey) as key, o_orderkey + 1 as seq, case when o_orderstatus = 'P' then 2 else 1 end as type,
        case when o_orderstatus = 'P' then '' else o_orderstatus end as value from orders""",
    "ev_files": """select 0 as level, cast(floor((seq - 1) / 100) as bigint) + 1 as file_no, key, seq, type, value
        from ev_log, (select cast(floor(max(seq) / 2) as bigint) as mid from ev_log) where seq > mid
        union all
        select 1, cast(100000 + b as bigint), l.key, seq, type, value
        from ev_log l join (select key, ntile(8) over (order by key) as b from (select distinct key from ev_log)) kb on l.key = kb.key,
            (select cast(floor(max(seq) / 2) as bigint) as mid from ev_log) where seq <= mid""",
    "meta": """select level, file_no, count(*) as entry_count, min(key) as min_key, max(key) as max_key, min(seq) as min_seq, max(seq) as max_seq,
        cast(sum(strlen(key) + strlen(value) + 17) as bigint) as data_bytes from ev_files group by level, file_no""",
    "lead_log": """select seq as idx, cast(floor((seq - 1) / 100) as bigint) + 1 as term, case when (seq - 1) % 100 = 0 then 3 else type end as cmd,
        case when (seq - 1) % 100 = 0 then '' else key end as key, case when (seq - 1) % 100 = 0 then '' else value end as value, (select max(seq) from ev_log) as mx from ev_log""",
    "ev_raft": """select 0 as node, idx, term, cmd, key, value from lead_log union all select 1, idx, term, cmd, key, value from lead_log
        union all select 2, idx, term, cmd, key, value from lead_log where idx * 10 <= mx * 8
        union all select 3, idx, case when idx * 10 > mx * 6 then cast(floor((floor(mx * 6 / 10) - 1) / 100) as bigint) + 1 else term end, cmd, key, value from lead_log where idx * 10 <= mx * 9""",
    "ev_delivery": "select event_id + 1 as idx, (event_id * 7919) % (select count(*) from events) as arrival from events",
    "ev_ops": """select event_id, case when event_type in ('view', 'click') then 'GET' when event_type in ('purchase', 'signup') then 'PUT' else 'DELETE' end as op,
        event_id % 11 <> 0 as ok, cast(floor(value * 30) as bigint) as latency_us, user_id % 5 as peer, event_type <> 'error' as ping_ok from events""",
    "ev_wal": "select seq, type, key, value, cast(33 + strlen(key) + strlen(value) as bigint) as frame_len, seq % 977 <> 0 as valid from ev_log",
    "users": "select concat('user:', c_custkey) as key from customer",
    "custs": "select concat('cust:', c_custkey) as key from customer",
    "matches": """select f.node as follower, coalesce(min(case when l.idx is null or l.term <> f.term or l.cmd <> f.cmd or l.key <> f.key or l.value <> f.value then f.idx end), max(f.idx) + 1) as conflict_index
        from ev_raft f left join ev_raft l on l.node = 0 and l.idx = f.idx where f.node <> 0 group by f.node""",
    "blocks": """select file_no, key, "offset", coalesce(lead("offset") over (partition by file_no order by "offset"), data) - "offset" as size from (
        select file_no, arg_min(key, no) as key, min("offset") as "offset", max(data) as data from (
            select *, key is distinct from lag(key) over w as new from (
                select file_no, key, seq, row_number() over v - 1 as no, cast(coalesce(sum(strlen(key) + strlen(value) + 17) over (partition by file_no order by key, seq desc rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
                    cast(sum(strlen(key) + strlen(value) + 17) over (partition by file_no) as bigint) as data from ev_files window v as (partition by file_no order by key, seq desc)
            ) window w as (partition by file_no order by no)
        ) where new group by file_no, no // 64
    )""",
}
NEEDS = {"ev_files": ["ev_log"], "meta": ["ev_files"], "lead_log": ["ev_log"], "ev_raft": ["lead_log"], "ev_wal": ["ev_log"], "matches": ["ev_raft"], "blocks": ["ev_files"]}


def sql(body: str, *fixtures: str, recursive: str = "") -> str:
    """A query with the fixtures that it names, each after those it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for f in fixtures:
        add(f)
    parts = [f"{n} as ({FIXTURES[n]})" for n in order] + ([recursive] if recursive else [])
    return (f"with {'recursive ' if recursive else ''}" + ", ".join(parts) + " " if parts else "") + body


def _newest(log: str, where: str = "true", keep: str = "type = 1") -> str:
    return f"select key, seq, type, value from (select *, row_number() over (partition by key order by seq desc) as rn from {log} where {where}) where rn = 1 and {keep}"


def _kept(source: str, floor: str, grave: str = "true") -> str:
    """Retention: grave is the condition under which a floor tombstone goes."""
    return f"""select key, seq, type, value from (select *, row_number() over (partition by key, seq <= {floor} order by seq desc) as rn from (select distinct key, seq, type, value from {source}))
        where seq > {floor} or (rn = 1 and not (type = 2 and {grave}))"""


FLOOR = "(select max(seq) * 9 // 10 from ev_log)"

ORACLES: dict[str, str] = {
    "mvcc_latest": sql(f"select key, seq, value from ({_newest('ev_log')})", "ev_log"),
    "mvcc_as_of": sql(f"select key, seq, value from ({_newest('ev_log', 'seq <= 5000')})", "ev_log"),
    "mvcc_three_state": sql(
        f"""select u.key, case when n.type = 1 then 'FOUND' when n.type = 2 then 'DELETED' else 'NOT_FOUND' end as state, n.seq, case when n.type = 1 then n.value end as value
        from (select distinct key from users) u left join ({_newest('ev_log', 'seq <= 5000', 'true')}) n on u.key = n.key""",
        "ev_log", "users",
    ),
    "mvcc_history": sql("select key, seq, type, value, lead(seq) over (partition by key order by seq) as next_seq from ev_log", "ev_log"),
    "mvcc_layered_read": sql(
        """select key, seq, value, layer from (select *, row_number() over (partition by key order by layer, seq desc) as rn from (
            select *, case when seq * 10 > mx * 8 then 0 when seq * 10 > mx * 6 then 1 else 2 end as layer from ev_log, (select max(seq) as mx from ev_log))) where rn = 1 and type = 1""",
        "ev_log",
    ),
    "mvcc_live_count_size": sql(
        f"""select count(*) as live_keys, cast(coalesce(sum(strlen(key) + strlen(value)), 0) as bigint) as bytes, (select cast(sum(strlen(key) + strlen(value) + 9) as bigint) from ev_log) as mem_bytes from ({_newest('ev_log')})""",
        "ev_log",
    ),
    "mvcc_point_get": sql(f"select n.key, n.value from ({_newest('ord_log')}) n where n.key in (select key from custs)", "ord_log", "custs"),
    "mvcc_contains": sql(f"select c.key, n.key is not null as found from (select distinct key from custs) c left join ({_newest('ord_log')}) n on c.key = n.key", "ord_log", "custs"),
    "mvcc_seek_scan": sql(f"select key, seq, value from ({_newest('ord_log', keep='type = 1')}) where key >= 'cust:5' order by key limit 20", "ord_log"),
    "baseline_put_delete": """with gone as (select concat('cust:', c_custkey) as key from customer where c_custkey % 7 = 0 union select concat('none:', n_nationkey) from nation),
        base as (select concat('cust:', c_custkey) as key, case when c_custkey % 10 = 0 then 'updated' else c_mktsegment end as value from customer union all select concat('supp:', s_suppkey), 'new' from supplier)
        select key, value, 'OK' as status from base where key not in (select key from gone)
        union all select key, null, 'NotFound' from gone where key not in (select key from base)""",
    "seq_assign": "select concat('cust:', o_custkey) as key, o_orderkey, 100 + row_number() over (order by o_orderdate, o_orderkey) as seq from orders",
    "duplicate_versions": "select concat('order:', l_orderkey) as key, cast(l_linenumber as bigint) as seq, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "replay_overwrite": "select concat('order:', l_orderkey) as key, cast(l_linenumber as bigint) as seq, 1 as type, max(l_returnflag) as value from lineitem group by 1, 2",
    "snapshot_floor": sql("select coalesce(least((select min(seq) from ev_log where seq % 1000 = 777), max(seq)), 0) as floor_seq from ev_log", "ev_log"),
    "diff_between_snapshots": sql(
        f"""select key, case when a is null then 'ADDED' when b is null then 'REMOVED' else 'CHANGED' end as change, a as old_value, b as new_value from (
            select coalesce(o.key, n.key) as key, o.value as a, n.value as b from ({_newest('ev_log', 'seq <= (select max(seq) // 3 from ev_log)')}) o full join ({_newest('ev_log', 'seq <= (select max(seq) * 2 // 3 from ev_log)')}) n on o.key = n.key)
        where a is distinct from b""",
        "ev_log",
    ),
    "compact_full": sql(_kept("ev_log", FLOOR), "ev_log"),
    "compact_leveled": sql(
        _kept("(select * from ev_files where level = 0)", FLOOR, "not exists (select 1 from meta where level = 1 and file_no % 2 = 0 and key between min_key and max_key)"), "meta"
    ),
    # more than four files on level 0 outweigh level 1 at every scale of the tables
    "leveled_cycle": sql(
        """select 1 as level, min(key) as min_key, max(key) as max_key, cast(sum(c) as bigint) as entries, cast(sum(b) as bigint) as bytes from fold group by file
        union all select level, min_key, max_key, entry_count, data_bytes from meta, span where level = 1 and not (max_key >= lo and min_key <= hi)""",
        "meta",
        recursive=f"""span as (select min(min_key) as lo, max(max_key) as hi from meta where level = 0),
            kept as ({_kept("(select f.* from ev_files f, span where level = 0 or f.file_no in (select file_no from meta where level = 1 and max_key >= lo and min_key <= hi))", FLOOR)}),
            k as (select key, sum(strlen(key) + strlen(value) + 17) as b, count(*) as c, row_number() over (order by key) as no from kept group by key), fold(no, key, b, c, file, held) as (
            select no, key, b, c, cast(1 as bigint), cast(b as bigint) from k where no = 1
            union all select k.no, k.key, k.b, k.c, case when f.held >= 20000 then f.file + 1 else f.file end, case when f.held >= 20000 then cast(k.b as bigint) else cast(f.held + k.b as bigint) end from fold f join k on k.no = f.no + 1)""",
    ),
    "compaction_stats": sql(
        f"""select n as entries_in, o as entries_out, n - o as entries_dropped, bi as bytes_in, bo as bytes_out from
        (select count(*) as n, cast(sum(strlen(key) + strlen(value) + 17) as bigint) as bi from (select * from ev_log union all select * from ev_log where seq % 5 = 0)),
        (select count(*) as o, cast(sum(strlen(key) + strlen(value) + 17) as bigint) as bo from ({_kept('ev_log', FLOOR)}))""",
        "ev_log",
    ),
    "file_metadata": sql("select file_no, entry_count, min_key, max_key, min_seq, max_seq, data_bytes from meta", "meta"),
    "level_scores": sql("select level, count(*) as files, cast(sum(data_bytes) as bigint) as bytes, case when level = 0 then count(*) / 4.0::double else sum(data_bytes) / 20000.0::double end as score from meta group by level", "meta"),
    "picker": sql(
        """, sc as (select level, case when level = 0 then count(*) / 4.0::double else sum(data_bytes) / 20000.0::double end as score from meta group by level),
        lv as (select level from sc where score >= 1 order by score desc, level desc limit 1),
        inp as (select m.* from meta m join lv using (level) where level = 0 union all
            (select m.* from meta m join lv using (level) where level > 0 order by min_key <= 'user:2', min_key, file_no limit 1)),
        sp as (select min(min_key) as lo, max(max_key) as hi, min(level) as f from inp)
        select level, file_no, 'input' as role from inp union all select m.level, m.file_no, 'next_input' from meta m, sp where m.level = f + 1 and m.max_key >= lo and m.min_key <= hi""",
        "meta",
    ).replace(") , sc as", "), sc as"),
    "picker_round_robin": sql("select level, file_no, 'input' as role from (select * from meta where level = 1 and (select sum(data_bytes) from meta where level = 1) >= 2000 order by min_key <= 'user:2', min_key, file_no limit 1)", "meta"),
    "file_overlap": sql("select a.file_no as file_a, b.file_no as file_b from meta a join meta b on a.level = 0 and b.level = 1 and a.max_key >= b.min_key and a.min_key <= b.max_key", "meta"),
    "level_disjoint_check": sql(
        """select level, count(*) filter (b >= min_key) as violations from (select l as level, min_key, lag(max_key) over (partition by l order by min_key, file_no) as b from (select *, case when level = 0 then 2 else 1 end as l from meta)) group by level""",
        "meta",
    ),
    "manifest_reconcile": sql(
        """select coalesce(m.file_no, f.file_no) as file_no, case when m.n > 1 then 'DUPLICATE' when m.n is null then 'ORPHAN' when f.file_no is null then 'MISSING' else 'LIVE' end as status
        from (select file_no, case when file_no % 11 = 0 then 2 else 1 end as n from meta where file_no % 5 <> 0) m full join (select file_no from meta where file_no % 7 <> 0) f on m.file_no = f.file_no""",
        "meta",
    ),
    "version_edit": sql("select file_no, level from meta where (file_no % 2 = 0 and file_no % 4 <> 0) or (file_no % 2 = 1 and level = 1)", "meta"),
    "key_prune_candidates": sql("select u.key, m.file_no from users u join meta m on u.key between m.min_key and m.max_key", "meta", "users"),
    "memtable_rotation": sql(
        "select batch as batch_id, count(*) as entries, cast(sum(b) as bigint) as bytes, max(seq) as last_seq from fold group by batch",
        "ev_log",
        recursive="""s as (select seq, strlen(key) + strlen(value) + 9 as b from ev_log), fold(seq, b, batch, held) as (
            select seq, b, cast(1 as bigint), cast(b as bigint) from s where seq = 1
            union all select s.seq, s.b, case when f.held >= 20000 then f.batch + 1 else f.batch end, case when f.held >= 20000 then s.b else f.held + s.b end from fold f join s on s.seq = f.seq + 1)""",
    ),
    "output_rolling": sql(
        "select file as file_no, min(key) as min_key, max(key) as max_key, cast(sum(b) as bigint) as bytes from fold group by file",
        "ev_log",
        recursive="""k as (select key, sum(strlen(key) + strlen(value) + 17) as b, row_number() over (order by key) as no from ev_log group by key), fold(no, key, b, file, held) as (
            select no, key, b, cast(1 as bigint), cast(b as bigint) from k where no = 1
            union all select k.no, k.key, k.b, case when f.held >= 20000 then f.file + 1 else f.file end, case when f.held >= 20000 then cast(k.b as bigint) else cast(f.held + k.b as bigint) end from fold f join k on k.no = f.no + 1)""",
    ),
    "record_layout": sql(
        """select file_no, key, seq, cast(coalesce(sum(strlen(key) + strlen(value) + 17) over (partition by file_no order by key, seq desc rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
        cast(strlen(key) + strlen(value) + 17 as bigint) as size from ev_files""",
        "ev_files",
    ),
    "sparse_index_build": sql('select file_no, key, "offset", size from blocks', "blocks"),
    "sparse_index_lookup": sql(
        """select m.file_no, u.key as probe, max(b.key) as block_key from (select distinct key from users) u join meta m on u.key between m.min_key and m.max_key
        join blocks b on b.file_no = m.file_no and b.key <= u.key group by 1, 2""",
        "meta", "blocks", "users",
    ),
    "sparse_index_bytes": sql(
        """select m.file_no, cast(12 + strlen(min_key) + strlen(max_key) + (select sum(strlen(b.key) + 16) from blocks b where b.file_no = m.file_no) as bigint) as bytes from meta m""",
        "meta", "blocks",
    ),
    "bloom_sizes": sql("select file_no, bits, cast(28 + ceil(bits / 8.0) as bigint) as bytes from (select file_no, greatest(64, least(greatest(entry_count, 1), 50331648) * 10) as bits from meta)", "meta"),
    "table_file_sizes": sql("select file_no, format('L{}-{:06d}.sst', level, file_no) as name, (data_bytes + 4095) // 4096 * 4096 as padded from meta", "meta"),
    "wal_frame_sizes": sql('select seq, cast(coalesce(sum(frame_len) over (order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", frame_len from ev_wal', "ev_wal"),
    "wal_valid_prefix": sql(
        """select case when max(bad) is null then 'OK' else 'CORRUPT' end as status, count(*) filter (bad is null or seq < bad) as records, cast(coalesce(sum(frame_len) filter (bad is null or seq < bad), 0) as bigint) as valid_bytes, max(seq) filter (bad is null or seq < bad) as last_seq
        from ev_wal, (select min(seq) filter (not valid) as bad from ev_wal)""",
        "ev_wal",
    ),
    "wal_monotony": sql(
        """, r as (select arrival, idx, max(idx) over (order by arrival rows between unbounded preceding and 1 preceding) as top from ev_delivery), b as (select min(arrival) filter (idx <= top) as bad from r)
        select case when max(bad) is null then 'OK' else 'CORRUPT' end as status, count(*) filter (bad is null or arrival < bad) as records, count(*) filter (bad is null or arrival < bad) as valid_bytes from r, b""",
        "ev_delivery",
    ).replace(") , r as", "), r as"),
    "recovery_replay": sql(
        """select count(*) as records_read, count(*) filter (seq <= 3000) as skipped, count(*) filter (seq > 3000) as applied, greatest(coalesce(max(seq), 0), 3000) as last_sequence
        from ev_log where seq < coalesce((select min(seq) from ev_log where seq % 9770 = 0), 9223372036854775807)""",
        "ev_log",
    ),
    "wal_checkpoint": sql("select key, seq, type, value from ev_log where seq > 3000", "ev_log"),
    "sequence_high_water": sql("select greatest((select max(max_seq) from meta where level = 1), (select max(seq) from ev_log where seq % 2 = 0), 17) as high", "meta"),
    "raft_log_match": sql(
        "select m.follower, m.conflict_index - 1 as match_index, m.conflict_index, r.term as conflict_term from matches m left join ev_raft r on r.node = m.follower and r.idx = m.conflict_index", "matches"
    ),
    "raft_conflict_hint": sql(
        """select m.follower, 1 + coalesce((select max(o.idx) from ev_raft o where o.node = m.follower and o.idx < m.conflict_index and o.term <> r.term), 0) as hint_index
        from matches m join ev_raft r on r.node = m.follower and r.idx = m.conflict_index""",
        "matches",
    ),
    "raft_suffix_replace": sql(
        "select idx, term, key from ev_raft, (select conflict_index as c from matches where follower = 3) where (node = 3 and idx < c) or (node = 0 and idx >= c)", "matches"
    ),
    "raft_commit_index": sql("select max(idx) as commit_index from lead_log", "lead_log"),
    "raft_commit_stale": sql(
        """select case when (select term from lead_log where idx = q) = (select max(term) from lead_log) then q else 0 end as commit_index
        from (select min(m) as q from (select m from (select conflict_index - 1 as m from matches union all select max(idx) from lead_log) order by m desc limit 3))""",
        "matches",
    ),
    "raft_apply": sql(f"select key, value from ({_newest('(select key, idx as seq, cmd as type, value from lead_log where cmd in (1, 2))', 'seq <= 5000')})", "lead_log"),
    "raft_apply_outcomes": sql("select case when idx <= 1000 then 'SKIPPED_DUPLICATE' when cmd = 3 then 'NOOP' else 'APPLIED' end as outcome, count(*) as n from lead_log where idx <= 5000 group by 1", "lead_log"),
    "raft_vote_tally": """select candidate, term, votes, votes >= 3 as elected from (select user_id % 3 as candidate, event_id // 50 as term,
        count(distinct case when value > 100 and event_id % 7 <> user_id % 3 then event_id % 7 end) + 1 as votes from events where event_id % 7 < 5 group by 1, 2)""",
    "ordered_apply_delay": sql("select idx, arrival, max(arrival) over (order by idx) as applied_at from ev_delivery", "ev_delivery"),
    "ordered_apply_next": sql("select coalesce(min(idx), max(n) + 1) as next_index from (select idx, arrival, (select count(*) from ev_delivery) as n from ev_delivery) where arrival * 2 >= n", "ev_delivery"),
    "durable_reconcile": sql("select coalesce(max(idx), 0) as recovered_applied from (select idx, sum(case when cmd in (1, 2) then 1 else 0 end) over (order by idx) as n from lead_log) where n <= 4000", "lead_log"),
    "peer_state_timeline": sql(
        """select peer, event_id, case when ping_ok then 'UP' when not coalesce(before, true) then 'DOWN' when ever then 'UP' else 'UNKNOWN' end as state from (
        select *, lag(ping_ok) over (partition by peer order by event_id) as before, bool_or(ping_ok) over (partition by peer order by event_id) as ever from ev_ops)""",
        "ev_ops",
    ),
    "op_counters": sql("select op, count(*) as total, count(*) filter (not ok) as errors from ev_ops group by op", "ev_ops"),
    "latency_histogram": sql(
        "select op, le, count(*) filter (b is null or latency_us <= b) as bucket_count from ev_ops, (values ('10', 10), ('50', 50), ('100', 100), ('500', 500), ('1000', 1000), ('5000', 5000), ('10000', 10000), ('+Inf', null)) v(le, b) group by op, le",
        "ev_ops",
    ),
    "latency_summary": sql("select op, count(*) as n, cast(sum(latency_us) as bigint) as sum_us from ev_ops group by op", "ev_ops"),
    "latency_p99": sql("select op, max(n) as n, min(latency_us) as p99 from (select *, row_number() over (partition by op order by latency_us) as rn, count(*) over (partition by op) as n from ev_ops) where rn >= (n * 99 + 99) // 100 group by op", "ev_ops"),
    "latency_median": sql("select op, quantile_disc(latency_us, 0.5) as median from ev_ops group by op", "ev_ops"),
    "throughput": sql("select op, count(*) as n, round(count(*) * 1000000.0::double / sum(latency_us), 6) as ops_per_s from ev_ops group by op", "ev_ops"),
    "prometheus_lines": sql(
        """select 'kv_operations_total{op="' || op || '"} ' || count(*) as line from ev_ops group by op union all select 'kv_operation_errors_total{op="' || op || '"} ' || count(*) filter (not ok) from ev_ops group by op
        union all select 'kv_operation_latency_us_bucket{op="' || op || '",le="' || le || '"} ' || count(*) filter (b is null or latency_us <= b) from ev_ops, (values ('10', 10), ('50', 50), ('100', 100), ('500', 500), ('1000', 1000), ('5000', 5000), ('10000', 10000), ('+Inf', null)) v(le, b) group by op, le
        union all select 'kv_operation_latency_us_sum{op="' || op || '"} ' || sum(latency_us) from ev_ops group by op union all select 'kv_operation_latency_us_count{op="' || op || '"} ' || count(*) from ev_ops group by op""",
        "ev_ops",
    ),
    "activity_feed": "select event_id, user_id, event_type from events order by event_id desc limit 150",
    "validate_requests": """select id, case when message = '' then 0 else 1 end as code, message from (select o_orderkey as id, case when o_orderkey % 50 = 3 then 'request_id exceeds 128 bytes'
        when o_orderkey % 50 = 0 then 'key must not be empty' when o_orderkey % 50 = 1 then 'key exceeds 1024 bytes (got 1025)' when o_orderkey % 3 = 1 and o_orderkey % 1000 = 4 then 'value exceeds 1048576 bytes (got 1048577)' else '' end as message from orders)""",
    "validate_commands": """select id, case when message = '' then 0 else 1 end as code, message from (select id, case when cmd = 3 and (k > 0 or v > 0) then 'no-op command must not carry fields' when cmd = 3 then '' when cmd not in (1, 2) then 'unknown command type'
        when k = 0 then 'key must not be empty' when cmd = 2 and v > 0 then 'delete command must not carry a value' else '' end as message
        from (select o_orderkey as id, o_orderkey % 5 as cmd, case when o_orderkey % 4 = 0 then 0 else 1 end as k, case when o_orderkey % 3 = 0 then 0 else strlen(o_orderpriority) end as v from orders))""",
    "parse_peers": "select * from (values (1, 'node-a', 7001), (2, 'node-b', 7002), (3, 'node-c', 7003), (null, null, null), (null, null, null)) v(node_id, host, port)",
    "pod_identity": """select pod, cast(regexp_extract(pod, '-(\\d+)$', 1) as int) + 1 as node_id, cast(regexp_extract(pod, '-(\\d+)$', 1) as int) = p as is_self, p + 1 as peer_id,
        regexp_extract(pod, '^(.*)-(\\d+)$', 1) || '-' || p || '.kv.default.svc.cluster.local:7000' as address from (values ('store-0'), ('store-2'), ('raft-kv-1')) v(pod), (values (0), (1), (2)) w(p)""",
    "parse_table_names": sql(
        "select format('L{}-{:06d}.sst', level, file_no) as name, level, file_no as number from meta union all select * from (values ('000012.sst', null, null), ('L1-7.tmp', null, null), ('notes', null, null)) v", "meta"
    ),
}
