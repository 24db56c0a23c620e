"""The driver queries as DuckDB SQL."""

EVENTS = """ev AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::INTEGER AS tag,
  CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events)"""
ORDERS = """od AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::INTEGER AS tag,
  CAST(o_custkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS value FROM orders)"""
PROBES = "pr AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer UNION SELECT 'absent' || CAST(c_custkey AS VARCHAR) FROM customer)"
LATEST = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM"
IMAGE = """im AS (SELECT seg, key, tag, value, seq, row_number() OVER (PARTITION BY seg ORDER BY key)::BIGINT AS key_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY seg, key ORDER BY seq DESC) AS rn FROM (SELECT *, (seq // 1000 + 1)::BIGINT AS seg FROM ev)) WHERE rn = 1)"""
DOUBLING = """dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg, key ORDER BY seq DESC) AS rn FROM
    (SELECT *, length(bin(seq + 1))::BIGINT AS seg FROM ev)) WHERE rn = 1),
  ds AS (SELECT (row_number() OVER (ORDER BY seg DESC) - 1)::BIGINT AS pos, seg AS number, sum(9 + strlen(key) + strlen(value))::BIGINT AS size_bytes,
    count(*)::BIGINT AS n_entries FROM dr GROUP BY seg),
  dt AS (SELECT *, greatest(0, trunc(ln(greatest(size_bytes, 1)::DOUBLE) / ln(4)))::BIGINT AS tier FROM ds),
  du AS (SELECT tier, min(pos) AS start, max(pos) AS "end", count(*)::BIGINT AS length FROM
    (SELECT *, row_number() OVER (ORDER BY pos) - row_number() OVER (PARTITION BY tier ORDER BY pos) AS i FROM dt) GROUP BY tier, i)"""


def _blocks(entries: str, block: int) -> str:
    """bl(seg, key, size, block): a recursion that hops from one block's start to the next over running sums."""
    return f"""en AS ({entries}),
  o AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY key) AS rn, sum(size) OVER (PARTITION BY seg ORDER BY key ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM en),
  b(seg, block, s, base) AS (SELECT DISTINCT seg, 0::BIGINT, 1::BIGINT, 0::BIGINT FROM o UNION ALL
    SELECT b.seg, b.block + 1, n.rn + 1, n.cum FROM b, LATERAL (SELECT rn, cum FROM o WHERE o.seg = b.seg AND o.cum - b.base >= {block} ORDER BY rn LIMIT 1) n
    WHERE EXISTS (SELECT 1 FROM o WHERE o.seg = b.seg AND o.rn = n.rn + 1)),
  bl AS (SELECT o.seg, o.key, o.size, (SELECT max(block) FROM b WHERE b.seg = o.seg AND b.s <= o.rn) AS block FROM o)"""


EVENT_BLOCKS = _blocks("SELECT seg, key, (9 + strlen(key) + strlen(value))::BIGINT AS size FROM im", 512)
DOCUMENT_BLOCKS = _blocks("SELECT (doc_id // 500 + 1)::BIGINT AS seg, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, (9 + 12 + strlen(text))::BIGINT AS size FROM documents", 4096)
INDEX = """ix AS (SELECT seg, block, first_key, (sum(size) OVER (PARTITION BY seg ORDER BY block ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS "offset", size FROM
  (SELECT seg, block, min(key) AS first_key, sum(size)::BIGINT AS size FROM bl GROUP BY seg, block))"""

# Keys are ASCII, so code points are bytes.
HASH = """list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i::INT, 1))::UHUGEINT)),
  lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""
BITS = "((greatest(8, floor(greatest(n, 1) * greatest(1.0, -ln(fpr) / (ln(2.0) * ln(2.0)))))::BIGINT + 7) // 8 * 8)"
COUNT = "greatest(1, least(30, floor(greatest(1.0, -ln(fpr) / (ln(2.0) * ln(2.0))) * ln(2.0) + 0.5)))::BIGINT"
BLOOM = f"""pa AS (SELECT seg, n, {BITS} AS bits, {COUNT} AS probes FROM (SELECT seg, count(*)::BIGINT AS n, 0.01::DOUBLE AS fpr FROM im GROUP BY seg)),
  hk AS (SELECT key, (h % 4294967296)::BIGINT AS h1, (h // 4294967296)::BIGINT AS h2 FROM (SELECT key, {HASH} AS h FROM (SELECT DISTINCT key FROM im))),
  sb AS (SELECT DISTINCT seg, (h1 + i * CASE WHEN h2 = 0 THEN 1 ELSE h2 END) % bits AS bit FROM im JOIN hk USING (key) JOIN pa USING (seg), LATERAL (SELECT unnest(range(probes)) AS i))"""


def _maybe(keys: str) -> str:
    return f"""hp AS (SELECT key, (h % 4294967296)::BIGINT AS h1, (h // 4294967296)::BIGINT AS h2 FROM (SELECT key, {HASH} AS h FROM ({keys}))),
  mb AS (SELECT w.seg, w.key, bool_and(sb.bit IS NOT NULL) AS maybe FROM
    (SELECT seg, key, (h1 + i * CASE WHEN h2 = 0 THEN 1 ELSE h2 END) % bits AS bit FROM hp CROSS JOIN pa, LATERAL (SELECT unnest(range(probes)) AS i)) w
    LEFT JOIN sb ON sb.seg = w.seg AND sb.bit = w.bit GROUP BY w.seg, w.key)"""


CRC = """tb AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
  fr AS (SELECT seq, (9 + strlen(key) + strlen(value))::BIGINT AS payload_len, (17 + strlen(key) + strlen(value))::BIGINT AS frame_len,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_concat([tag::BIGINT, strlen(key)::BIGINT, 0, 0, 0],
      list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i::INT, 1))::BIGINT), [strlen(value)::BIGINT, 0, 0, 0],
      list_transform(range(1, length(value) + 1), lambda i: ord(substr(value, i::INT, 1))::BIGINT))),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS crc FROM ev, tb),
  of AS (SELECT *, (sum(frame_len) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - frame_len)::BIGINT AS start, (sum(frame_len) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM fr),
  gd AS (SELECT * FROM of WHERE seq < coalesce((SELECT min(seq) FROM of WHERE seq % 997 = 600 AND crc % 2 = 0), 9223372036854775807))"""

MERGE = f"""WITH {EVENTS}, {DOUBLING}, pk AS (SELECT * FROM du WHERE length >= 4 ORDER BY start LIMIT 1),
  mg AS (SELECT dr.key, dr.tag, dr.value, ds.pos, row_number() OVER (PARTITION BY dr.key ORDER BY ds.pos) AS r FROM dr JOIN ds ON ds.number = dr.seg JOIN pk ON ds.pos BETWEEN pk.start AND pk."end")
  SELECT key, tag, value, pos FROM mg WHERE r = 1"""
ZIPF = "zr AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS i FROM customer), zc AS (SELECT i, sum(1 / pow(i + 1, 0.99)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(1 / pow(i + 1, 0.99)) OVER () AS cdf FROM zr)"


# A flush's memory depends on the keys since the last one: a recursion from cut to cut, each with its own running sum.
FLUSH = f"""WITH RECURSIVE {EVENTS},
  lg AS (SELECT seq, strlen(key) + strlen(value) + 48 AS fresh, strlen(value) - lag(strlen(value)) OVER w AS change, lag(seq) OVER w AS before FROM ev WINDOW w AS (PARTITION BY key ORDER BY seq)),
  cut(seg, first, last) AS (SELECT 0::BIGINT, 0::BIGINT, -1::BIGINT UNION ALL
    SELECT c.seg + 1, c.last + 1, coalesce(x.seq, (SELECT max(seq) FROM lg)) FROM cut c, LATERAL (SELECT min(seq) AS seq FROM
      (SELECT seq, sum(CASE WHEN before >= c.last + 1 THEN change ELSE fresh END) OVER (ORDER BY seq) AS held FROM lg WHERE seq > c.last) WHERE held >= 4096) x
    WHERE c.last < (SELECT max(seq) FROM lg))
  SELECT seg, min(seq) AS first_seq, max(seq) AS last_seq, count(*)::BIGINT AS n FROM cut JOIN lg ON seq BETWEEN first AND last WHERE seg > 0 GROUP BY seg"""

# The list of sizes after each merge; the newest run of four or more of one tier goes first.
FIXPOINT = f"""WITH RECURSIVE {EVENTS}, {IMAGE},
  sz AS (SELECT list(s ORDER BY seg DESC) AS sizes, max(seg) AS top FROM (SELECT seg, sum(9 + strlen(key) + strlen(value))::BIGINT AS s FROM im GROUP BY seg)),
  st(step, sizes, first, past, top) AS (SELECT 0::BIGINT, sizes, NULL::BIGINT, NULL::BIGINT, top FROM sz UNION ALL
    SELECT step + 1, list_concat(sizes[:f - 1], [list_sum(sizes[f:p - 1])::BIGINT], sizes[p:]), f, p, top + 1 FROM
      (SELECT *, coalesce(list_min(list_filter(range(f + 1, len(sizes) + 1), lambda j: tiers[j] <> tiers[f])), len(sizes) + 1) AS p FROM
        (SELECT step, sizes, top, tiers, list_min(list_filter(range(1, len(sizes) - 2), lambda i: (i = 1 OR tiers[i - 1] <> tiers[i]) AND tiers[i] = tiers[i + 1] AND tiers[i] = tiers[i + 2] AND tiers[i] = tiers[i + 3])) AS f FROM
          (SELECT *, list_transform(sizes, lambda s: greatest(0, trunc(ln(greatest(s, 1)::DOUBLE) / ln(4)))::BIGINT) AS tiers FROM st)) WHERE f IS NOT NULL))
  SELECT step, first - 1 AS start, past - 2 AS "end", past - 1 = len_before AS drop_tombstones, top AS number FROM
    (SELECT *, len(sizes) + past - first - 1 AS len_before FROM st) WHERE step > 0"""


def _little(n: str, size: int) -> str:
    """The hexadecimal digits of a little-endian integer."""
    return " || ".join(f"printf('%02X', ({n} >> {8 * k}) & 255)" for k in range(size))


def _place(f: float) -> str:
    return f"max(CASE WHEN r = floor({f} * (n - 1))::BIGINT + 1 THEN x END)"


def _picked(n: int) -> str:
    return f'(SELECT {n}::BIGINT AS min_merge, start, "end", tier, length, "end" = (SELECT max(pos) FROM ds) AS drop_tombstones FROM du WHERE length >= {n} ORDER BY start LIMIT 1)'


ORACLE_SQL: dict[str, str] = {
    "kv_mutation_log": f"WITH {EVENTS} SELECT seq, tag, key, value FROM ev WHERE strlen(key) > 0",
    "kv_live_state": f"WITH {EVENTS} SELECT key, value, seq FROM ({LATEST} ev) WHERE rn = 1 AND tag = 0",
    "kv_get_status": f"""WITH {ORDERS}, {PROBES}, la AS (SELECT * FROM ({LATEST} od) WHERE rn = 1)
      SELECT pr.key, CASE WHEN tag IS NULL THEN 'not_present' WHEN tag = 1 THEN 'deleted' ELSE 'found' END AS status, CASE WHEN tag = 0 THEN value END AS value FROM pr LEFT JOIN la USING (key)""",
    "kv_multi_get": f"WITH {ORDERS}, {PROBES} SELECT key, value FROM ({LATEST} od) WHERE rn = 1 AND tag = 0 AND key IN (SELECT key FROM pr)",
    "kv_key_history": f"""WITH {EVENTS} SELECT key, sum(CASE WHEN tag = 0 THEN 1 ELSE 0 END)::BIGINT AS puts, sum(CASE WHEN tag = 1 THEN 1 ELSE 0 END)::BIGINT AS deletes,
      count(b)::BIGINT AS overwrites, coalesce(sum(b), 0)::BIGINT AS replaced_bytes FROM (SELECT *, lag(strlen(value)) OVER (PARTITION BY key ORDER BY seq) AS b FROM ev) GROUP BY key""",
    "kv_reject_empty_key": f"WITH {EVENTS} SELECT count(*)::BIGINT AS accepted, count(DISTINCT key)::BIGINT AS keys FROM (SELECT CASE WHEN seq % 7 = 0 THEN '' ELSE key END AS key FROM ev) WHERE strlen(key) > 0",
    "memtable_image": f"WITH {EVENTS}, {IMAGE} SELECT seg, key_rank, key, tag, value, seq FROM im",
    "memtable_bytes": f"WITH {EVENTS}, {IMAGE} SELECT seg, count(*)::BIGINT AS entries, sum(strlen(key) + strlen(value) + 48)::BIGINT AS bytes FROM im GROUP BY seg",
    "sst_entry_blocks": f"WITH RECURSIVE {EVENTS}, {IMAGE}, {EVENT_BLOCKS} SELECT seg, key, size, block FROM bl",
    "sst_document_blocks": f"WITH RECURSIVE {DOCUMENT_BLOCKS}, {INDEX} SELECT * FROM ix",
    "sst_sparse_index": f"WITH RECURSIVE {EVENTS}, {IMAGE}, {EVENT_BLOCKS}, {INDEX} SELECT * FROM ix",
    "sst_index_lookup": f"""WITH RECURSIVE {EVENTS}, {IMAGE}, {EVENT_BLOCKS}, {INDEX}, {PROBES}
      SELECT p.seg, p.key, ix.block FROM (SELECT DISTINCT seg, key FROM pr CROSS JOIN (SELECT DISTINCT seg FROM ix)) p ASOF LEFT JOIN ix ON p.seg = ix.seg AND p.key >= ix.first_key""",
    "bloom_hash": f"WITH {EVENTS} SELECT key, CAST({HASH} AS VARCHAR) AS hash, CAST({HASH} AS VARCHAR) AS batch_hash FROM (SELECT DISTINCT key FROM ev)",
    "bloom_params": f"SELECT n, fpr, {BITS} AS bits, {COUNT} AS probes FROM (SELECT DISTINCT (p_partkey * p_size)::BIGINT AS n FROM part), (SELECT unnest([0.5::DOUBLE, 0.1, 0.01, 0.001]) AS fpr)",
    "bloom_set_bits": f"WITH {EVENTS}, {IMAGE}, {BLOOM} SELECT seg, bit FROM sb",
    "bloom_false_positives": f"WITH {EVENTS}, {IMAGE}, {BLOOM}, {PROBES}, {_maybe("SELECT key FROM pr WHERE key LIKE 'absent%'")} SELECT seg, count(*)::BIGINT AS probes, sum(maybe::INT)::BIGINT AS false_positives FROM mb GROUP BY seg",
    "bloom_no_false_negatives": f"WITH {EVENTS}, {IMAGE}, {BLOOM}, {_maybe('SELECT DISTINCT key FROM im')} SELECT count(*)::BIGINT AS members, sum((NOT maybe)::INT)::BIGINT AS rejected FROM mb JOIN im USING (seg, key)",
    "read_amplification": f"""WITH {EVENTS}, {IMAGE}, {BLOOM}, {PROBES}, {_maybe('SELECT key FROM pr')},
      ra AS (SELECT mb.key, maybe, mb.key >= f.first_key AND (h.newest IS NULL OR mb.seg >= h.newest) AS open FROM mb JOIN (SELECT seg, min(key) AS first_key FROM im GROUP BY seg) f ON f.seg = mb.seg
        LEFT JOIN (SELECT key, max(seg) AS newest FROM im GROUP BY key) h ON h.key = mb.key)
      SELECT filtered, sum((open AND (maybe OR NOT filtered))::INT)::BIGINT AS blocks_read, count(DISTINCT key)::BIGINT AS probes FROM ra, (SELECT unnest([true, false]) AS filtered) GROUP BY filtered""",
    "segment_tiers": f"WITH {EVENTS}, {DOUBLING} SELECT pos, number, size_bytes, n_entries, tier FROM dt",
    "compaction_pick": f"WITH {EVENTS}, {DOUBLING} {_picked(2)} UNION ALL {_picked(4)}",
    "compaction_runs": f'WITH {EVENTS}, {DOUBLING} SELECT start, "end", tier, length FROM du',
    "compaction_merge_keep": MERGE,
    "compaction_merge_drop": MERGE + " AND tag = 0",
    "wal_frames": f"WITH {EVENTS}, {CRC} SELECT seq, payload_len, frame_len, crc FROM fr",
    "wal_offsets": f'WITH {EVENTS}, {CRC} SELECT seq, frame_len, start, "end" FROM of',
    "wal_recover": f'WITH {EVENTS}, {CRC} SELECT seq, start, "end" FROM gd',
    "wal_truncate_offset": f"""WITH {EVENTS}, {CRC} SELECT count(*)::BIGINT AS good_frames, coalesce(max("end"), 0)::BIGINT AS keep_bytes,
      ((SELECT max("end") FROM of) - coalesce(max("end"), 0))::BIGINT AS dropped_bytes FROM gd""",
    "manifest_state": f"WITH {EVENTS}, {IMAGE} SELECT (max(seg) + 1)::BIGINT AS next_file_number, array_to_string(list(seg ORDER BY seg DESC), ',') AS table_numbers FROM (SELECT DISTINCT seg FROM im)",
    "live_and_orphan_segments": f"WITH {EVENTS}, {IMAGE} SELECT DISTINCT seg AS number, seg % 3 <> 0 AS live FROM im",
    "snapshot_read": f"WITH {EVENTS} SELECT key, value, seq FROM ({LATEST} (SELECT * FROM ev WHERE seq <= (SELECT max(seq) // 2 FROM ev))) WHERE rn = 1 AND tag = 0",
    "range_scan": f"WITH {ORDERS} SELECT key, value FROM ({LATEST} od) WHERE rn = 1 AND tag = 0 AND key >= '1' AND key < '3' ORDER BY key",
    "seek": f"WITH {ORDERS} SELECT key, value FROM ({LATEST} od) WHERE rn = 1 AND tag = 0 AND key >= '2' ORDER BY key LIMIT 10",
    "bench_key": "SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 4 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS narrow, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 16 THEN lpad(CAST(o_orderkey AS VARCHAR), 16, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS wide FROM orders",
    "zipf_cdf": f"WITH {ZIPF} SELECT i, round(cdf, 9) AS cdf FROM zc",
    "zipf_draw": f"WITH {ZIPF} SELECT s_suppkey, min(i)::BIGINT AS drawn FROM supplier LEFT JOIN zc ON zc.cdf >= (s_suppkey % 97 + 0.5::DOUBLE) / 97 GROUP BY s_suppkey",
    "latency_percentiles": f"""SELECT event_type, max(n)::BIGINT AS n, {_place(0.5)} AS p50, {_place(0.95)} AS p95, {_place(0.99)} AS p99, {_place(0.999)} AS p999, max(x) AS most FROM
      (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""",
    "median_of_trials": """SELECT workload, trial, ops, ops_min, ops_max FROM (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY ops, trial) AS r, count(*) OVER (PARTITION BY workload) AS n,
      min(ops) OVER (PARTITION BY workload) AS ops_min, max(ops) OVER (PARTITION BY workload) AS ops_max FROM (SELECT event_type AS workload, event_id % 5 AS trial, count(*)::BIGINT AS ops FROM events GROUP BY ALL)) WHERE r = n // 2 + 1""",
    "throughput_summary": "SELECT event_type, ops, span_us, round(ops * 1e6::DOUBLE / span_us, 6) AS ops_per_sec FROM (SELECT event_type, count(*)::BIGINT AS ops, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS span_us FROM events GROUP BY event_type)",
    "status_text": """SELECT n_nationkey, label || CASE WHEN label <> 'ok' AND length(m) > 0 THEN ': ' || m ELSE '' END AS status FROM
      (SELECT n_nationkey, ['ok', 'not found', 'corruption', 'io error', 'invalid argument'][n_nationkey % 5 + 1] AS label, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS m FROM nation)""",
    "flush_plan": FLUSH,
    "compaction_fixpoint": FIXPOINT,
    "fixed_integers": f"""SELECT event_id, {_little('n', 4)} AS low, {_little('w', 8)} AS wide, n AS low_back, CAST(w AS VARCHAR) AS wide_back FROM
      (SELECT event_id, n, (event_id * 1000003 + n)::BIGINT AS w FROM (SELECT event_id, ((event_id * 2654435761) % 4294967296)::BIGINT AS n FROM events))""",
    "wal_decode": f"WITH {EVENTS} SELECT seq, CASE WHEN ok THEN tag END AS tag, CASE WHEN ok THEN key END AS key, CASE WHEN ok THEN value END AS value FROM (SELECT *, seq % 5 <> 2 AND seq % 7 <> 3 AS ok FROM ev)",
    "wal_file_round_trip": f"""WITH {EVENTS} SELECT seq, tag, key, value, (sum(17 + strlen(key) + strlen(value)) OVER w - 17 - strlen(key) - strlen(value))::BIGINT AS start,
      (sum(17 + strlen(key) + strlen(value)) OVER w)::BIGINT AS "end" FROM ev WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    "segment_file_round_trip": f"WITH {EVENTS} SELECT tag, key, value FROM ({LATEST} ev) WHERE rn = 1",
    "segment_file_get": f"""WITH {EVENTS}, {PROBES}, la AS (SELECT * FROM ({LATEST} ev) WHERE rn = 1)
      SELECT pr.key, CASE WHEN tag IS NULL THEN 'not_present' WHEN tag = 1 THEN 'deleted' ELSE 'found' END AS status, CASE WHEN tag = 0 THEN value END AS value FROM pr LEFT JOIN la USING (key)""",
    "manifest_bytes": f"""WITH {EVENTS}, {IMAGE}, sg AS (SELECT DISTINCT seg FROM im), hd AS (SELECT max(seg) + 1 AS nx, count(*) AS n FROM sg)
      SELECT lower('314E414D5F6D736C' || {_little('nx', 8)} || {_little('n', 4)} || (SELECT string_agg({_little('seg', 8)}, '' ORDER BY seg DESC) FROM sg)) AS bytes, nx::BIGINT AS next_file_number,
      (SELECT array_to_string(list(seg ORDER BY seg DESC), ',') FROM sg) AS table_numbers FROM hd""",
    "store_reopened": f"WITH {EVENTS} SELECT key, value FROM ({LATEST} ev) WHERE rn = 1 AND tag = 0",
    "store_compacted": f"WITH {EVENTS} SELECT key, value FROM ({LATEST} ev) WHERE rn = 1 AND tag = 0",
    "store_flushed": f"""WITH {EVENTS}, im AS (SELECT *, row_number() OVER (PARTITION BY part, key ORDER BY seq DESC) AS rn FROM
        (SELECT *, (SELECT count(*) FROM (SELECT unnest([1, 2, 3]) AS k) WHERE seq >= k * (SELECT count(*) FROM ev) // 4) AS part FROM ev))
      SELECT (3 - part)::INTEGER AS pos, (part + 1)::BIGINT AS number, sum(9 + strlen(key) + strlen(value))::BIGINT AS size_bytes, count(*)::BIGINT AS n_entries FROM im WHERE rn = 1 GROUP BY part""",
    "store_read": f"""WITH {EVENTS}, {PROBES}, la AS (SELECT * FROM ({LATEST} ev) WHERE rn = 1), ak AS (SELECT key FROM pr UNION ALL SELECT key FROM pr WHERE key LIKE 'absent%')
      SELECT ak.key, CASE WHEN tag IS NULL THEN 'not_present' WHEN tag = 1 THEN 'deleted' ELSE 'found' END AS status, CASE WHEN tag = 0 THEN value END AS value FROM ak LEFT JOIN la USING (key)""",
    "bloom_missing_filter": f"WITH {EVENTS}, {IMAGE}, {BLOOM}, {PROBES}, {_maybe("SELECT key FROM pr WHERE key LIKE 'absent%'")} SELECT seg, sum((maybe OR seg % 2 = 0)::INT)::BIGINT AS passed FROM mb GROUP BY seg",
    "workload_fill_random": "SELECT lpad(CAST(row_number() OVER () - 1 AS VARCHAR), 16, '0') AS key, 1::BIGINT AS times FROM orders",
    "workload_reads": "SELECT unnest(['read-random-uniform', 'read-random-zipfian', 'mixed-50-50']) AS workload, 2000::BIGINT AS ops, 2000::BIGINT AS found",
}
