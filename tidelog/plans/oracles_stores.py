"""The queries of stores.py as SQL, over the same tables."""

from __future__ import annotations

from .oracles import _kept, _newest, sql

# Basis and prime of FNV-1a, the seeds, and the factors of the final shifts (30, 27, 31).
FNV = {"basis": 14695981039346656037, "prime": 1099511628211, "seeds": (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), "factors": (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)}
POLYNOMIAL = 3988292384

_TWO64 = "18446744073709551616::uhugeint"


def _hash(seed: int) -> str:
    """FNV-1a with a seed and a final avalanche over column b (a list of bytes), in unsigned 64 bits."""
    mul = lambda x, f: f"(({x}) * {f}::uhugeint % {_TWO64})"
    start = FNV["basis"] ^ seed
    h = f"list_reduce(list_prepend({start}::uhugeint, list_transform(b, lambda x: x::uhugeint)), lambda h, x: {mul('xor(h, x)', FNV['prime'])})"
    return h


_BYTES = "list_transform(range(1, strlen({c}) + 1), lambda i: ascii({c}[i]))"

_BLOOM = f"""
    sizes as (select file_no, greatest(64, least(greatest(count(*), 1), 50331648) * 10) as bits from ev_files group by file_no),
    k as (select distinct key from ev_files union select key from users),
    h0 as (select key, {_hash(FNV['seeds'][0]).replace('list_transform(b,', 'list_transform(' + _BYTES.format(c='key') + ',')} as a, {_hash(FNV['seeds'][1]).replace('list_transform(b,', 'list_transform(' + _BYTES.format(c='key') + ',')} as b from k),
    h1 as (select key, xor(a, a >> 30) * {FNV['factors'][0]}::uhugeint % {_TWO64} as a, xor(b, b >> 30) * {FNV['factors'][0]}::uhugeint % {_TWO64} as b from h0),
    h2 as (select key, xor(a, a >> 27) * {FNV['factors'][1]}::uhugeint % {_TWO64} as a, xor(b, b >> 27) * {FNV['factors'][1]}::uhugeint % {_TWO64} as b from h1),
    h3 as (select key, xor(a, a >> 31) as a, xor(b, b >> 31) | 1::uhugeint as b from h2),
    held as (select distinct f.file_no, ((a + i::uhugeint * b) % {_TWO64}) % bits::uhugeint as bit from (select distinct file_no, key from ev_files) f join sizes using (file_no) join h3 using (key), range(7) r(i)),
    asked as (select distinct u.key, m.file_no from users u join meta m on u.key between m.min_key and m.max_key),
    probes as (select file_no, key, ((a + i::uhugeint * b) % {_TWO64}) % bits::uhugeint as bit from asked join sizes using (file_no) join h3 using (key), range(7) r(i))
"""

_TOP = "(select max(seq) from ev_log)"
_LATEST = sql(f"select key, seq, value from ({_newest('ev_log')})", "ev_log")
_KEPT_ALL = f"({_kept('ev_log', _TOP)})"


def _le(x: str, width: int) -> str:
    """Hexadecimal digits of the least `width` bytes, least first."""
    return " || ".join(f"format('{{:02X}}', ({x} >> {8 * i}) & 255)" for i in range(width))


_TORN = f"(select * from ev_log where seq < {_TOP} or seq <= 3000)"
_LAST = f"greatest({_TOP} - 1, least(3000, {_TOP}))"

ORACLES: dict[str, str] = {
    "engine_flush_scan": _LATEST,
    "engine_read_clamp": _LATEST,
    "engine_snapshot_read": sql(f"select key, seq, value from ({_newest('ev_log', 'seq <= 3000')})", "ev_log"),
    "engine_old_version": sql("select key, seq, type, value from ev_log", "ev_log"),
    "engine_write_delete": """select n_name as key, row_number() over (order by n_regionkey, n_nationkey) as seq, 1 as type, n_regionkey::varchar as value from nation
        union all select key, 25 + row_number() over (order by key) as seq, 2, '' from (select n_name as key from nation where n_nationkey % 3 = 0 union all select 'nowhere')""",
    "engine_get": sql(
        f"""with old as (select * from ({_newest('ev_log', 'seq <= 6000')}) union all select * from ev_log where seq > 6000)
        select u.key, case when n.type = 1 then 'FOUND' when n.type = 2 then 'DELETED' else 'NOT_FOUND' end as state, n.seq, case when n.type = 1 then n.value end as value
        from (select distinct key from users) u left join ({_newest('old', 'true', 'true')}) n on u.key = n.key""",
        "ev_log", "users",
    ).replace(") with old as", "), old as"),
    "lsm_info": sql(
        f"""select {_TOP} as sequence, {_TOP} as flushed_up_to, 1::bigint as tables, k.n as entries, k.b as bytes, 4::bigint as flushes, 1::bigint as compactions, 4::bigint as files_in, 1::bigint as files_out,
            a.n as entries_in, k.n as entries_out, a.b as bytes_in, k.b as bytes_out
        from (select count(*) as n, cast(sum(strlen(key) + strlen(value) + 17) as bigint) as b from ev_log) a, (select count(*) as n, cast(sum(strlen(key) + strlen(value) + 17) as bigint) as b from {_KEPT_ALL}) k""",
        "ev_log",
    ),
    "engine_clear": sql(f"select 0::bigint as entries, {_TOP} + 1 as next_seq", "ev_log"),
    "engine_flush_during_compaction": sql(f"select key, seq, type, value from ({_newest('ev_log', f'seq <= {_TOP} * 2 // 3')}) union all select key, seq, type, value from ev_log where seq > {_TOP} * 2 // 3", "ev_log"),
    "engine_tables": sql(
        f"""select 3 - part as position, count(*) as entry_count, min(key) as min_key, max(key) as max_key, min(seq) as min_seq, max(seq) as max_seq, cast(sum(strlen(key) + strlen(value) + 17) as bigint) as data_bytes
        from (select *, case when seq <= top // 4 then 0 when seq <= top * 2 // 4 then 1 when seq <= top * 3 // 4 then 2 else 3 end as part from ev_log, (select max(seq) as top from ev_log)) group by part""",
        "ev_log",
    ),
    "engine_restore": sql("select key, seq, type, value from ev_log where seq % 3 = 0 union all select 'k', (select max(seq) from ev_log where seq % 3 = 0) + 1, 1, 'v'", "ev_log"),
    "manifest_files": "select 'LIVE' as status, 1::bigint as n union all select 'ORPHAN', 4",
    "wal_roundtrip": sql("select key, seq, type, value from ev_log", "ev_log"),
    "wal_roundtrip_plain": sql("select key, seq, type, value from ev_log", "ev_log"),
    "wal_rewrite": sql("select key, seq, type, value from ev_log where seq > 3000", "ev_log"),
    "node_open": sql(f"select key, seq, value from ({_newest(_TORN)})", "ev_log"),
    "node_recovery_stats": sql(f"select {_TOP} - 1 as records_read, least(3000, {_TOP} - 1) as skipped, greatest({_TOP} - 1 - 3000, 0) as applied, greatest({_TOP} - 1, least(3000, {_TOP})) as last_sequence, true as torn_tail", "ev_log"),
    "node_flush": sql(
        f"""select key, seq, type, value, 'tables' as place from {_TORN} union all select 'new', {_LAST} + 1, 1, 'v', 'log'
        union all select 'new', {_LAST} + 2, 2, '', 'log' union all select 'user:1', {_LAST} + 3, 2, '', 'log'""",
        "ev_log",
    ),
    "sstable_roundtrip": sql("select level, file_no, key, seq, type, value from ev_files", "ev_files"),
    "sstable_index": sql('select file_no, key, "offset", size from blocks', "blocks"),
    "sstable_levels": sql("select level, count(*) as files, min(file_no) as least, max(file_no) as greatest, 0::bigint as unfinished from meta group by level", "meta"),
    "digest_verify": sql("select file_no, not bool_or(seq in (20, 777)) as intact from ev_files group by file_no", "ev_files"),
    "raft_state_roundtrip": sql(
        """select idx, term, concat_ws('|', cmd, key, value) as command, (select max(term) + 1 from lead_log) as own_term, 2::bigint as voted_for, (select max(idx) // 2 from lead_log) as committed,
        (select max(idx) // 4 from lead_log) as applied, 0::bigint as leader from lead_log""",
        "lead_log",
    ),
    "raft_leader_endpoint": "select n_nationkey as node, n_regionkey::int as leader_id, address from nation left join (values (1, 'node-a:7001'), (2, 'node-b:7002'), (3, 'node-c:7003')) v(id, address) on id = n_regionkey",
    "raft_vote_eligibility": sql(
        """with l as (select node, max(idx) as i, arg_max(term, idx) as t from ev_raft group by node)
        select a.node as candidate, b.node as voter, a.t > b.t or (a.t = b.t and a.i >= b.i) as eligible from l a join l b on a.node <> b.node""",
        "ev_raft",
    ).replace(") with l as", "), l as"),
    "single_node_commit": sql(f"select key, value from ({_newest('(select key, idx as seq, cmd as type, value from lead_log where cmd in (1, 2))', 'seq <= 4000')})", "lead_log"),
    "single_node_propose": """select id, case when bad then 'INVALID' else 'ACCEPTED' end as status, case when not bad then sum(case when bad then 0 else 1 end) over (order by id) end::bigint as idx
        from (select o_orderkey as id, o_orderkey % 7 = 0 or (o_orderkey % 10 = 0 and o_orderkey % 4 <> 0) as bad from orders)""",
    "canonical_order": sql("select key, seq, row_number() over (order by key, seq desc) as place from ev_log", "ev_log"),
    "falling_sequences": sql("select key, seq, arrival from (select key, seq, arrival, max(seq) over (partition by key order by arrival rows between unbounded preceding and 1 preceding) as top from ev_log join ev_delivery on idx = seq) where seq <= top", "ev_log", "ev_delivery"),
    "table_gauges": sql("select count(*) as tables, cast(sum(data_bytes) as bigint) as bytes from meta", "meta"),
    "level_one_over_budget": sql("select level, count(*) as files, cast(sum(data_bytes) as bigint) as bytes from meta group by level having case when level = 0 then count(*) / 4.0 else sum(data_bytes) / 20000.0 end >= 1", "meta"),
    "fixed_codec": f"select o_orderkey as id, {_le('o_orderkey', 4)} as fixed32, {_le('(o_orderkey * 4294967296 + o_custkey)', 8)} as fixed64, o_orderkey as n32, o_orderkey * 4294967296 + o_custkey as n64 from orders",
    "composite_keys": "select n_nationkey, hex(n_name) || case when n_nationkey % 2 = 0 then '00FF' else '01' end || '00FF' || '0000' || 'FFFFFFFFFFFFFF' || format('{:02X}', 254 - n_nationkey) as version_key from nation",
    "command_codec": f"""select id, '01' || format('{{:02X}}', cmd) || {_le('strlen(c_name)', 4)} || {_le('strlen(c_mktsegment)', 4)} || '01000000' || hex(c_name) || hex(c_mktsegment) || '72' as raw, cmd::int as type, c_name as key, c_mktsegment as value, true as cut_fails
        from (select c_custkey as id, c_custkey % 3 + 1 as cmd, c_name, c_mktsegment from customer)""",
    "status_texts": """select n_nationkey, case when n_nationkey % 8 = 0 or n_nationkey < 8 then name else name || ': ' || n_name end as text
        from nation, (values (0, 'OK'), (1, 'NotFound'), (2, 'AlreadyExists'), (3, 'InvalidArgument'), (4, 'IOError'), (5, 'Corruption'), (6, 'NotSupported'), (7, 'InternalError')) v(code, name) where n_nationkey < 16 and code = n_nationkey % 8""",
    "cluster_lines": """select * from (values ('RAFT', 'leader', 3::bigint, null::int, null, null), ('SELF', null, null, 1, 'a:7001', null), ('PEER', null, null, 2, 'b:7002', null), ('VALUE', null, null, null, null, 'x y'),
        ('REDIRECT', null, null, 2, 'b:7002', null), ('', null, null, null, null, null)) v(kind, role, term, node_id, address, value)""",
    "truth_values": "select * from (values ('true', true), (' YES ', true), ('on', true), ('1', true), ('False', false), ('0', false), ('off', false), ('No', false), ('maybe', null), ('', null)) v(text, truth)",
    "settings_text": "select 'n7' as node_id, './data' as data_dir, 67108864::bigint as max_memtable_size, false as sync_wal, 7::int as client_port, 50052::int as peer_port, 9090::int as metrics_port",
    "bloom_probe": sql("select p.file_no, p.key as probe, bool_and(h.bit is not null) as may_contain from probes p left join held h on h.file_no = p.file_no and h.bit = p.bit group by 1, 2", "meta", "users", recursive=_BLOOM),
}

# Bytes of every table: data, index and filter rounded up to pages, and one page.
_SIZES = sql(
    """select format('L{}-{:06d}.sst', level, m.file_no) as name, cast((data_bytes + 4095) // 4096 * 4096 + (12 + strlen(min_key) + strlen(max_key) + b + 4095) // 4096 * 4096
        + (28 + (greatest(64, entry_count * 10) + 7) // 8 + 4095) // 4096 * 4096 + 4096 as bigint) as bytes
    from meta m join (select file_no, sum(16 + strlen(key)) as b from blocks group by file_no) using (file_no)""",
    "meta", "blocks",
)
ORACLES |= {"sstable_file_sizes": _SIZES, "table_size_formula": _SIZES}

# CRC-32 byte by byte over a file's records in canonical order; the table of 256 remainders is computed first.
_REMAINDERS = "list_transform(range(256), lambda x: list_reduce(list_prepend(x::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, " + str(POLYNOMIAL) + ") else c >> 1 end))"
ORACLES["crc32_digest"] = sql(
    """select file_no, n as records, xor(list_reduce(list_prepend(4294967295::bigint, l), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as digest
    from (select file_no, count(*) as n, flatten(list(rec order by key, seq desc)) as l from rec group by file_no), tab""",
    "ev_files",
    recursive=f"""tab as (select {_REMAINDERS} as t), rec as (select file_no, key, seq, list_transform(
        list_concat([strlen(key) & 255, strlen(key) >> 8, 0, 0, strlen(value) & 255, strlen(value) >> 8, 0, 0, seq & 255, (seq >> 8) & 255, (seq >> 16) & 255, (seq >> 24) & 255, 0, 0, 0, 0, type - 1],
        list_concat({_BYTES.format(c='key')}, {_BYTES.format(c='value')})), lambda x: x::bigint) as rec from ev_files)""",
)
