"""DuckDB SQL for the engine's queries, written from the meaning and not from the plans."""

from __future__ import annotations

_LOG = """
log AS (SELECT user_id AS key, ts AS time, event_id AS seq, event_type = 'error' AS del, event_type IN ('click', 'view', 'signup') AS sets_value, event_type IN ('purchase', 'signup') AS sets_props, value, props FROM events)
"""
_FOLD = """
dead AS (SELECT key, max(time) AS dt FROM log WHERE del GROUP BY key),
wrote AS (SELECT key, max(time) AS kt FROM log WHERE NOT del GROUP BY key),
vals AS (SELECT key, time AS vt, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time DESC, seq DESC) AS n FROM log WHERE sets_value) WHERE n = 1),
prps AS (SELECT key, time AS pt, props FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time DESC, seq DESC) AS n FROM log WHERE sets_props) WHERE n = 1),
live AS (
  SELECT w.key, kt, CASE WHEN dt IS NULL OR vt > dt THEN value END AS value, CASE WHEN dt IS NULL OR vt > dt THEN vt END AS vt, CASE WHEN dt IS NULL OR pt > dt THEN props END AS props
  FROM wrote w LEFT JOIN dead USING (key) LEFT JOIN vals USING (key) LEFT JOIN prps USING (key) WHERE dt IS NULL OR kt > dt)
"""
_ROW = f"WITH {_LOG}, {_FOLD} SELECT key, kt AS time, value, props FROM live"
_PATH = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"
_LISTING = f"listing AS (SELECT * FROM (SELECT {_PATH} AS path, 1700000000000 + page_id * 1000 AS create_time, strlen(html) AS size, page_id FROM pages) WHERE path NOT LIKE '%/')"
_ONCE = f"{_LISTING}, once AS (SELECT path, max(create_time) AS create_time, max(size) AS size FROM listing GROUP BY path)"
_BLOBS = """
blobs AS (
  SELECT 'blob/' || (user_id % 10) || '/' || user_id AS path, ts AS time, event_id AS seq, floor(value)::BIGINT AS size, event_id % 3 <> 0 AS marked,
         CASE event_type WHEN 'click' THEN 'set' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'set' WHEN 'purchase' THEN 'unmark' ELSE CASE WHEN event_id % 2 = 0 THEN 'drop_value' ELSE 'purge' END END AS op
  FROM events),
main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY time DESC, seq DESC) AS n FROM blobs WHERE op IN ('set', 'delete')) WHERE n = 1),
last_set AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY time DESC, seq DESC) AS n FROM blobs WHERE op = 'set') WHERE n = 1),
later AS (SELECT b.path, bool_or(b.op = 'unmark') AS unmarked, max(b.time) FILTER (b.op = 'unmark') AS unmark_time, bool_or(b.op = 'drop_value') AS dropped, bool_or(b.op = 'purge') AS purged
          FROM blobs b JOIN main m USING (path) WHERE (b.time, b.seq) > (m.time, m.seq) GROUP BY b.path),
seen AS (SELECT path, max(time) AS changed_at FROM blobs GROUP BY path),
staged AS (
  SELECT m.path, m.op, m.size AS own_size, m.time, s.size AS set_size, s.time AS set_time, changed_at, unmark_time,
         m.op = 'delete' AND m.marked AND s.path IS NOT NULL AND NOT coalesce(dropped, false) AS marked, coalesce(unmarked, false) AS unmarked
  FROM main m LEFT JOIN last_set s USING (path) LEFT JOIN later USING (path) JOIN seen USING (path) WHERE NOT coalesce(purged, false)),
idx AS (
  SELECT path, CASE WHEN op = 'set' OR (marked AND unmarked) THEN 'live' WHEN marked THEN 'marked' ELSE 'deleted' END AS state,
         CASE WHEN marked AND unmarked THEN unmark_time ELSE time END AS write_time,
         CASE WHEN op = 'set' THEN own_size WHEN marked THEN set_size ELSE 0 END AS size, CASE WHEN op = 'set' THEN time WHEN marked THEN set_time END AS value_time, changed_at
  FROM staged)
"""
_SIDES = """
sides AS (SELECT o_orderkey AS path, o_custkey AS t, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE floor(o_totalprice)::BIGINT END AS size FROM orders),
ours AS (SELECT path, t AS write_time, size, path % 2 = 0 AS from_them FROM sides WHERE path % 3 <> 0),
theirs AS (SELECT path, t + path % 5 - 2 AS create_time, size FROM sides WHERE path % 4 <> 0)
"""
_PULL = """
SELECT coalesce(t.path, o.path) AS path,
       CASE WHEN t.path IS NOT NULL AND NOT ({accepted}) THEN 'filtered' WHEN t.path IS NOT NULL AND o.path IS NOT NULL AND t.create_time <= o.write_time THEN 'unchanged' WHEN t.path IS NOT NULL AND t.size = 0 THEN 'tombstone'
            WHEN t.path IS NOT NULL AND o.path IS NOT NULL THEN 'updated' WHEN t.path IS NOT NULL THEN 'new' WHEN o.from_them THEN 'purge' ELSE 'missing' END AS outcome
FROM theirs t FULL OUTER JOIN ours o ON t.path = o.path
"""
_ROUTE = "(('0x' || substr(sha256({key}), 1, 12))::BIGINT % 1000000000 / 1e9::DOUBLE)"
_WINDOWS = """
windows AS (
  SELECT n_nationkey::BIGINT AS entry, 'st' || (n_nationkey % 4) AS store, (n_regionkey * 300 + n_nationkey * 17 % 400)::BIGINT AS s, (n_regionkey * 300 + n_nationkey * 17 % 400 + 40 + n_nationkey % 7 * 30)::BIGINT AS e,
         n_nationkey % 4 / 8.0::DOUBLE AS a, n_nationkey % 4 / 8.0::DOUBLE + n_nationkey % 3 / 4.0::DOUBLE + 0.25::DOUBLE AS b
  FROM nation)
"""
_ISLANDS = """
marked AS (SELECT *, CASE WHEN max({e}) OVER (PARTITION BY {by} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {s} THEN 0 ELSE 1 END AS fresh FROM {src}),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked)
"""
_PROBES = f"probes AS (SELECT o_orderkey AS id, o_custkey % 2000 AS t, {_ROUTE.format(key='o_orderkey::VARCHAR')} AS r FROM orders)"
_MARK = "VARIABLE_SHARD_f0234jfah08fgyhfgyssdds83nmp"
_FILES = """
f AS (SELECT l_partkey AS file, count(*) * 5000000 AS bytes, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, CASE WHEN l_partkey % 50 = 0 THEN 'log' WHEN count(*) * 5000000 < 134217728 THEN 'loose' ELSE 'combined' END AS tier FROM lineitem GROUP BY l_partkey)
"""
# groups of neighbouring keys: each ends at the first key that makes its sum reach 100000
_KEY_GROUPS = """
keys AS (SELECT l_orderkey AS key, count(*) AS slots, 40 * count(*) AS bytes FROM {lines} GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY key) AS n, sum(bytes) OVER (ORDER BY key) AS upto FROM keys),
ends AS (
  SELECT 0::BIGINT AS group_no, 1::BIGINT AS first, coalesce(min(n) FILTER (upto >= 100000), max(n))::BIGINT AS last FROM placed
  UNION ALL SELECT c.group_no + 1, c.last + 1, coalesce(min(s.n) FILTER (s.upto - e.upto >= 100000), max(s.n))::BIGINT FROM ends c JOIN placed e ON e.n = c.last JOIN placed s ON s.n > c.last GROUP BY c.group_no, c.last),
in_group AS (SELECT group_no, key, slots, bytes FROM ends JOIN placed ON n BETWEEN first AND last)
"""
_UNIT = "units AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"
_CLOSE = "1 - sqrt(greatest(0, 2 - 2 * list_dot_product({a}, {b})))"
_PREFIXES = f"{_LISTING}, parts AS (SELECT page_id, size, string_split(path, '/') AS p FROM listing), prefixes AS (SELECT page_id, size, array_to_string(p[1:n], '/') AS prefix, n FROM parts, unnest(range(1, len(p) + 1)) AS t(n))"

SQL: dict[str, str] = {
    "lww_column_value": f"WITH {_LOG}, {_FOLD} SELECT key, value, coalesce(vt, kt) AS time FROM live",
    "lww_row": _ROW,
    "compaction_equiv": _ROW,
    "stream_lww": _ROW,
    "lww_live_keys": f"WITH {_LOG}, {_FOLD} SELECT key FROM live",
    "lww_deleted_keys": f"WITH {_LOG} SELECT key, max(time) FILTER (del) AS delete_time FROM log GROUP BY key HAVING max(time) FILTER (del) >= coalesce(max(time) FILTER (NOT del), '-infinity'::TIMESTAMP)",
    "lww_point_field": f"WITH {_LOG}, {_FOLD} SELECT key, value, coalesce(vt, kt) AS time FROM live WHERE key = 7",
    "lww_reader_mode": f"""WITH {_LOG}, dead AS (SELECT key, max(time) AS dt FROM log WHERE del GROUP BY key),
        per AS (SELECT key, seq % 3 AS src, max((time, seq)) AS stamp, arg_max({{'v': value}}, (time, seq)) FILTER (sets_value) AS cell FROM log WHERE NOT del GROUP BY 1, 2),
        best AS (SELECT key, max(stamp) AS newest, arg_max({{'v': cell, 'stamp': stamp}}, stamp) FILTER (cell IS NOT NULL) AS b FROM per GROUP BY key)
        SELECT key, CASE WHEN dt IS NULL OR b.stamp[1] > dt THEN b.v.v END AS value, coalesce(b.stamp[1], newest[1]) AS time FROM best LEFT JOIN dead USING (key) WHERE dt IS NULL OR newest[1] > dt""",
    "lww_update_existing_only": f"WITH {_LOG}, live AS (SELECT key FROM log WHERE seq % 2 = 0 GROUP BY key HAVING max(time) FILTER (NOT del) > coalesce(max(time) FILTER (del), '-infinity'::TIMESTAMP)) SELECT key, time, seq, value FROM log WHERE seq % 2 = 1 AND NOT del AND key IN (SELECT key FROM live)",
    "overlay_patch": _ROW,
    "overlay_sweep": f"WITH {_LOG}, idx AS (SELECT key, max(time) AS t FROM log WHERE seq % 2 = 0 GROUP BY key) SELECT l.key, l.time, l.seq FROM log l LEFT JOIN idx i ON l.key = i.key WHERE seq % 2 = 1 AND (i.t IS NULL OR l.time > i.t)",
    "transaction_replay": "SELECT user_id AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
    "kv_log_replay": "SELECT user_id AS key, props AS value, date_trunc('hour', ts) AS time FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC, event_id % 4 DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
    "last_per_key": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "stream_newest": "SELECT user_id AS key, value, event_id AS time FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "point_lookup": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)",
    "reader_info": f"WITH {_LOG}, {_FOLD} SELECT count(*) AS row_count, coalesce(sum(CASE WHEN value IS NULL THEN 5 ELSE 13 END + 5 + coalesce(2 * length(props), 0)), 0)::BIGINT AS total_bytes, count(key) AS key_count, min(key) AS sample_key, 'value,props' AS columns FROM live",
    "key_stats": "SELECT count(*) AS raw_keys, count(DISTINCT user_id) AS final_keys, count(*) - count(DISTINCT user_id) AS wasted, (count(*) - count(DISTINCT user_id)) / count(*)::DOUBLE AS duplication FROM events",
    "column_bytes": "SELECT 'p_name' AS column, sum(coalesce(2 * length(p_name), 0) + 5)::BIGINT AS byte_size FROM part UNION ALL SELECT 'p_brand', sum(coalesce(2 * length(p_brand), 0) + 5)::BIGINT FROM part UNION ALL SELECT 'p_size', sum(CASE WHEN p_size IS NULL THEN 5 ELSE 13 END)::BIGINT FROM part UNION ALL SELECT 'p_retailprice', sum(CASE WHEN p_retailprice IS NULL THEN 5 ELSE 13 END)::BIGINT FROM part",
    "file_info": "SELECT 'part-' || (event_id % 8) AS file, count(*) AS row_count, count(DISTINCT user_id) AS keys, min(user_id) AS min_key, max(user_id) AS max_key, min(ts) AS min_time, max(ts) AS max_time, sum(39 + CASE WHEN value IS NULL THEN 5 ELSE 13 END)::BIGINT AS bytes FROM events GROUP BY 1",
    "dup_key_groups": f"WITH RECURSIVE {_KEY_GROUPS.format(lines='lineitem')} SELECT group_no, min(key) AS min_key, max(key) AS max_key, sum(bytes)::BIGINT AS bytes, sum(slots)::BIGINT AS slots, (sum(slots) - count(*))::DOUBLE / sum(slots)::DOUBLE AS dup_fraction FROM in_group GROUP BY 1",
    "greedy_chunks": """WITH RECURSIVE i AS (SELECT o_custkey % 16 AS shard, o_orderkey, floor(o_totalprice)::BIGINT AS size FROM orders),
        s AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o_orderkey) AS n, sum(size) OVER (PARTITION BY shard ORDER BY o_orderkey) AS upto FROM i),
        c AS (SELECT shard, 0::BIGINT AS chunk, 1::BIGINT AS first, greatest(1, coalesce(max(n) FILTER (upto <= 1000000), 1))::BIGINT AS last FROM s GROUP BY shard
              UNION ALL SELECT c.shard, c.chunk + 1, c.last + 1, greatest(c.last + 1, coalesce(max(s.n) FILTER (s.upto - e.upto <= 1000000), c.last + 1))::BIGINT
              FROM c JOIN s e ON e.shard = c.shard AND e.n = c.last JOIN s ON s.shard = c.shard AND s.n > c.last GROUP BY c.shard, c.chunk, c.last)
        SELECT c.shard, chunk, count(*) AS n, sum(size)::BIGINT AS size, min(o_orderkey) AS first FROM c JOIN s ON s.shard = c.shard AND s.n BETWEEN c.first AND c.last GROUP BY 1, 2""",
    "tier_split": "SELECT CASE WHEN bytes >= 50000 THEN 'combined' ELSE 'loose' END AS tier, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT l_suppkey, count(*) * 100 AS bytes FROM lineitem GROUP BY 1) GROUP BY 1",
    "compaction_plan_triggers": f"""WITH {_FILES},
        m AS (SELECT coalesce(sum(bytes) FILTER (tier = 'log'), 0)::BIGINT AS log_bytes, coalesce(sum(bytes) FILTER (tier = 'loose'), 0)::BIGINT AS loose_bytes, count(*) FILTER (tier = 'loose') AS loose_files, coalesce(sum(bytes) FILTER (tier = 'combined'), 0)::BIGINT AS combined_bytes FROM f),
        t AS (SELECT unnest([{{'trigger': 'fold_hard', 'value': log_bytes, 'threshold': 805306368}}, {{'trigger': 'fold', 'value': log_bytes, 'threshold': 67108864}}, {{'trigger': 'combine_bytes', 'value': loose_bytes, 'threshold': 1073741824}}, {{'trigger': 'combine_files', 'value': loose_files, 'threshold': 20}}, {{'trigger': 'dedup_bytes', 'value': combined_bytes, 'threshold': 536870912}}], recursive := true) FROM m)
        SELECT trigger, value, threshold::BIGINT AS threshold, value / threshold::DOUBLE AS fraction, value >= threshold AS met FROM t""",
    "recent_median": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM n WHERE n <= 25 GROUP BY 1",
    "index_fold": f"WITH {_BLOBS} SELECT * FROM idx",
    "list_prefix": f"WITH {_BLOBS} SELECT path, CASE WHEN state = 'marked' THEN coalesce(value_time, write_time) ELSE write_time END AS create_time, size FROM idx WHERE starts_with(path, 'blob/3/') AND state IN ('live', 'marked')",
    "list_shallow": f"WITH {_LISTING}, moved AS (SELECT 'all/' || CASE WHEN page_id % 5 = 0 THEN string_split(path, '/')[1] ELSE path END AS path, create_time, size FROM listing) SELECT * FROM moved WHERE NOT contains(substr(path, 5), '/')",
    "list_folders": f"WITH {_ONCE} SELECT string_split(path, '/')[1] AS path, arg_max(create_time, path) AS create_time, arg_max(size, path) AS size FROM once WHERE contains(path, '/') GROUP BY 1",
    "list_parent_folders": f"WITH {_ONCE} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, arg_max(create_time, path) AS create_time, arg_max(size, path) AS size FROM once WHERE contains(path, '/') GROUP BY 1",
    "changes_after": f"WITH {_BLOBS}, routed AS (SELECT *, {_ROUTE.format(key='path')} AS r FROM idx) SELECT path, write_time AS create_time, CASE WHEN state = 'live' THEN size ELSE 0 END AS size FROM routed WHERE changed_at > TIMESTAMP '2024-01-15 12:00:00' AND (r < 0.25 OR (r >= 0.5 AND r < 0.9))",
    "index_totals": f"WITH {_BLOBS} SELECT string_split(path, '/')[2] AS holder, count(*) AS files, sum(size)::BIGINT AS bytes FROM idx WHERE state = 'live' GROUP BY ROLLUP (string_split(path, '/')[2])",
    "marked_totals": f"WITH {_BLOBS} SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, min(write_time) AS oldest FROM idx WHERE state = 'marked'",
    "store_totals": "WITH s AS (SELECT c_mktsegment AS bucket, 'store' || (c_nationkey % 3) AS store, count(*) AS files, sum(floor(c_acctbal))::BIGINT AS bytes, min(c_custkey) AS oldest, min(c_acctbal) < 0 AS ready FROM customer GROUP BY 1, 2) SELECT bucket, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, min(oldest) AS oldest, string_agg(store, ',' ORDER BY store) AS stores, bool_and(ready) AS ready FROM s GROUP BY 1",
    "reconcile_pull": f"""WITH {_SIDES} SELECT coalesce(t.path, o.path) AS path,
        CASE WHEN t.path IS NOT NULL AND t.path % 7 = 0 THEN 'filtered' WHEN t.path IS NOT NULL AND o.path IS NOT NULL AND t.create_time <= o.write_time THEN 'unchanged' WHEN t.path IS NOT NULL AND t.size = 0 THEN 'tombstone'
             WHEN t.path IS NOT NULL AND o.path IS NOT NULL THEN 'updated' WHEN t.path IS NOT NULL THEN 'new' WHEN o.from_them AND o.write_time < 1000 THEN CASE WHEN o.path % 5 = 0 THEN 'repoint' ELSE 'purge' END ELSE 'missing' END AS outcome
        FROM theirs t FULL OUTER JOIN ours o ON t.path = o.path""",
    "reconcile_push": f"WITH {_SIDES} SELECT * FROM (SELECT o.path, CASE WHEN o.size = 0 AND t.size > 0 AND o.write_time > t.create_time THEN 'delete' WHEN o.size <> 0 AND (t.path IS NULL OR o.write_time > t.create_time) THEN 'put' END AS action FROM ours o LEFT JOIN theirs t ON o.path = t.path) WHERE action IS NOT NULL",
    "scan_tally": f"WITH {_SIDES}, p AS ({_PULL.format(accepted='true')}) SELECT outcome, count(*) AS n FROM p GROUP BY 1",
    "newest_across_sources": f"WITH {_SIDES}, l AS (SELECT *, 0 AS source FROM theirs UNION ALL SELECT path, create_time + path % 3 - 1, size, 1 FROM theirs WHERE path % 2 = 0) SELECT path, create_time, size, source::BIGINT AS source FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY create_time DESC, source) AS n FROM l) WHERE n = 1",
    "copy_if_newer": f"WITH {_SIDES} SELECT t.* FROM theirs t WHERE NOT EXISTS (SELECT 1 FROM ours o WHERE o.path = t.path AND o.write_time >= t.create_time)",
    "coalesce_writes": f"WITH {_BLOBS} SELECT path, arg_max({{'t': time}}, (time, seq)).t AS time, arg_max({{'s': size}}, (time, seq)).s AS size, min(time + INTERVAL 1 DAY) AS due, count(*) AS writes, min(time + INTERVAL 1 DAY) <= TIMESTAMP '2024-01-15 12:00:00' AS flush FROM blobs GROUP BY path",
    "evict_lru": "SELECT o_orderkey, o_orderdate, size FROM (SELECT o_orderkey, o_orderdate, floor(o_totalprice)::BIGINT AS size, sum(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM orders) WHERE kept > 100000000",
    "retention_cumsum": "SELECT doc_id, n_chars AS size FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM documents) WHERE kept > 500000",
    "evictable_copies": f"WITH {_SIDES} SELECT path, 'a' AS holder, write_time FROM ours o WHERE EXISTS (SELECT 1 FROM theirs t WHERE t.path = o.path AND t.path % 2 = 1 AND t.create_time >= o.write_time)",
    "dedupe_oldest": "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1",
    "source_ids": "WITH f AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(page_id) AS first_seen FROM pages GROUP BY 1) SELECT host, first_seen, row_number() OVER (ORDER BY first_seen, host) - 1 AS source_id FROM f",
    "pair_slots": "WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) SELECT coalesce(v.user_id, c.user_id) AS user_id, coalesce(v.nth, c.nth) AS nth, v.event_id AS left_slot, c.event_id AS right_slot FROM (SELECT * FROM e WHERE event_type = 'view') v FULL OUTER JOIN (SELECT * FROM e WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.nth = c.nth",
    "key_set_diff": """WITH b AS (SELECT l_suppkey, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS items FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 5 <> 0 GROUP BY 1), a AS (SELECT l_suppkey, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS items FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 7 <> 0 GROUP BY 1),
        j AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, b.l_suppkey IS NULL AS fresh, a.l_suppkey IS NULL AS gone, list_sort(list_filter(coalesce(a.items, []), lambda x: NOT list_contains(coalesce(b.items, []), x))) AS g, list_sort(list_filter(coalesce(b.items, []), lambda x: NOT list_contains(coalesce(a.items, []), x))) AS l FROM b FULL OUTER JOIN a ON a.l_suppkey = b.l_suppkey)
        SELECT l_suppkey, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change, array_to_string(g, ',') AS gained, array_to_string(l, ',') AS lost FROM j WHERE fresh OR gone OR len(g) > 0 OR len(l) > 0""",
    "standing_revocations": "WITH r AS (SELECT c_mktsegment || ' ' || c_nationkey AS pair, 'id' || (c_custkey % 40) AS legacy_id, c_custkey AS time FROM customer), u AS (SELECT CASE WHEN time % 2 = 0 THEN pair END AS pair, CASE WHEN time % 2 = 1 THEN legacy_id END AS legacy_id, time FROM r WHERE time % 11 = 0) SELECT * FROM r WHERE time % 3 = 0 AND NOT EXISTS (SELECT 1 FROM u WHERE u.time >= r.time AND (u.pair = r.pair OR u.legacy_id = r.legacy_id))",
    "accepted_machines": "SELECT DISTINCT c_mktsegment AS machine, c_nationkey AS ip, c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_nationkey < 15 AND c_nationkey % 4 <> 0 AS accepted FROM customer",
    "read_range": "SELECT page_id, md5(substr(hex(encode(html)), 21, 100).unhex()) AS digest, least(50, strlen(html) - 10)::BIGINT AS n FROM pages",
    "route_hash": f"""WITH k AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN url || '{_MARK}_0.' || (page_id % 1000) || '/x' WHEN 2 THEN url || '{_MARK}' WHEN 3 THEN '{_MARK}_7' || url || '{_MARK}_0.5' ELSE url END AS key FROM pages)
        SELECT page_id, CASE page_id % 5 WHEN 1 THEN ('0.' || (page_id % 1000))::DOUBLE WHEN 3 THEN 7.0::DOUBLE ELSE {_ROUTE.format(key='key')} END AS route FROM k""",
    "shard_counts": f"WITH k AS (SELECT {_ROUTE.format(key='o_orderkey::VARCHAR')} AS r FROM orders), s AS (SELECT * FROM (VALUES ('s0', 0.0, 0.2), ('s1', 0.2, 0.5), ('s2', 0.5, 1.0), ('s3', 0.4, 0.6)) t(shard, a, b)) SELECT shard, count(*) AS n FROM k JOIN s ON r >= a AND r < b GROUP BY 1",
    "route_coverage": f"WITH {_WINDOWS}, src AS (SELECT entry % 5 AS g, a, b FROM windows), {_ISLANDS.format(s='a', e='b', by='g', src='src')}, reach AS (SELECT g, island, min(a) AS a, max(b) AS b FROM islands GROUP BY 1, 2) SELECT g, coalesce(max(CASE WHEN a <= 0 THEN b END), 0)::DOUBLE AS covered FROM reach GROUP BY 1",
    "window_islands": f"WITH {_WINDOWS}, {_ISLANDS.format(s='s', e='e', by='1', src='windows')} SELECT entry, s, e, island::BIGINT AS island FROM islands",
    "window_conflicts": f"WITH {_WINDOWS} SELECT DISTINCT l.entry, l.store, l.s, l.e FROM windows l JOIN windows r ON l.store = r.store AND l.entry <> r.entry AND (r.s, r.e) <= (l.s, l.e) AND r.e > l.s",
    "asof_entry": f"WITH {_WINDOWS}, {_PROBES} SELECT id, t, entry FROM (SELECT id, t, entry, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN r >= a AND r < b THEN 0 ELSE 1 END, CASE WHEN t >= s AND t < e THEN 0 ELSE 1 END, CASE WHEN t >= s AND t < e THEN 0 ELSE least(abs(t - s), abs(t - e)) END, entry) AS n FROM probes, windows) WHERE n = 1",
    "current_entry": f"WITH {_WINDOWS}, {_PROBES} SELECT id, t, entry FROM (SELECT id, t, entry, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN t >= s AND t < e THEN 0 WHEN s > t THEN 1 ELSE 2 END, CASE WHEN t >= s AND t < e THEN 0 WHEN s > t THEN s ELSE -e END, entry) AS n FROM probes, windows) WHERE n = 1",
    "interval_intersect": f"WITH {_WINDOWS} SELECT l.entry AS id, r.entry AS other, greatest(l.a, r.a) AS a, least(l.b, r.b) AS b FROM windows l JOIN windows r ON l.entry < 12 AND r.entry >= 12 AND l.a < r.b AND r.a < l.b",
    "interval_subtract": f"""WITH {_WINDOWS}, holes AS (SELECT * FROM (VALUES (0.1::DOUBLE, 0.3::DOUBLE), (0.45, 0.55)) t(ha, hb)),
        points AS (SELECT entry AS id, a AS p FROM windows UNION SELECT entry, b FROM windows UNION SELECT entry, least(b, greatest(a, ha)) FROM windows, holes UNION SELECT entry, least(b, greatest(a, hb)) FROM windows, holes),
        pieces AS (SELECT id, p AS a, lead(p) OVER (PARTITION BY id ORDER BY p) AS b FROM points)
        SELECT id, a, b FROM pieces x WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM holes WHERE ha <= x.a AND hb >= x.b)""",
    "inject_window": f"WITH {_WINDOWS}, p AS (SELECT entry AS id, s, least(e, 500) AS e FROM windows UNION ALL SELECT entry, greatest(s, 620), e FROM windows) SELECT id, s, e, 'kept' AS kind FROM p WHERE s < e UNION ALL SELECT NULL, 500, 620, 'intermediate'",
    "rejoin_windows": f"WITH {_WINDOWS}, src AS (SELECT entry % 6 AS id, s, e FROM windows), {_ISLANDS.format(s='s', e='e', by='id', src='src')} SELECT id, min(s) AS s, max(e) AS e FROM islands GROUP BY id, island",
    "handover": f"""WITH {_WINDOWS}, met AS (SELECT w.entry AS win, w.s AS t, w.a AS wa, w.b AS wb, o.entry, o.store, o.a, o.b FROM windows w JOIN windows o ON o.s < w.s AND o.e >= w.s AND o.a < w.b AND w.a < o.b),
        points AS (SELECT DISTINCT win, p FROM (SELECT win, greatest(a, wa) AS p FROM met UNION ALL SELECT win, least(b, wb) FROM met)),
        slices AS (SELECT * FROM (SELECT win, p, lead(p) OVER (PARTITION BY win ORDER BY p) AS q FROM points) WHERE q IS NOT NULL),
        owned AS (SELECT s.win, p, q, arg_min(store, entry) AS owner FROM slices s JOIN met m ON m.win = s.win AND m.a <= p AND m.b >= q GROUP BY 1, 2, 3),
        runs AS (SELECT *, CASE WHEN lag(q) OVER w = p AND lag(owner) OVER w = owner THEN 0 ELSE 1 END AS fresh FROM owned WINDOW w AS (PARTITION BY win ORDER BY p)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY win ORDER BY p) AS run FROM runs) SELECT win AS "window", owner, min(p) AS a, max(q) AS b FROM numbered GROUP BY win, owner, run""",
    "write_targets": "WITH f AS (SELECT s_nationkey::BIGINT AS route_id, s_suppkey AS config_order, floor(s_acctbal)::BIGINT AS latency, s_name AS url, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) SELECT route_id, config_order, latency, url, row_number() OVER (ORDER BY latency, route_id) AS rank FROM f WHERE n = 1",
    "source_urls": """WITH s AS (SELECT (s_nationkey % 9)::BIGINT AS file, s_suppkey AS n, floor(s_acctbal)::BIGINT AS latency, 'u' || (s_suppkey % 13) AS url FROM supplier WHERE s_suppkey % 7 <> 1 AND s_suppkey % 4 <> 0 AND s_suppkey % 5 * 100 <= 400 AND s_suppkey % 5 * 100 + 350 > 400),
        p AS (SELECT *, n <> min(n) OVER (PARTITION BY file) AS later FROM s), u AS (SELECT file, url, min((later, CASE WHEN later THEN latency END, n)) AS k FROM p GROUP BY 1, 2) SELECT file, string_agg(url, ',' ORDER BY k) AS urls FROM u GROUP BY 1""",
    "unique_times": "SELECT o_orderkey, t, max(t - n) OVER (ORDER BY n) + n AS stamp FROM (SELECT o_orderkey, o_orderkey % 97 AS t, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)",
    "choose_config": "SELECT node, version, is_stored, c_custkey FROM (SELECT c_nationkey::BIGINT AS node, CASE WHEN c_custkey % 6 <> 0 THEN floor(c_acctbal)::BIGINT END AS version, c_custkey % 2 = 0 AS is_stored, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(CASE WHEN c_custkey % 6 <> 0 THEN floor(c_acctbal)::BIGINT END, -1) DESC, c_custkey % 2 = 0 DESC) AS n FROM customer) WHERE n = 1",
    "match_filter_or_and_not": "WITH p AS (SELECT p_partkey, p_name, p_type, p_brand, lower(p_name || ' ' || p_type || ' ' || p_brand) AS t FROM part) SELECT p_partkey, p_name, p_type, p_brand FROM p WHERE (contains(t, 'red') AND NOT contains(t, 'small')) OR (contains(t, 'gear') AND contains(t, 'brand#3'))",
    "log_search_all_terms": "SELECT conv_id, turn FROM conversations WHERE contains(text, 'the') AND contains(text, 'ion') AND contains(text, 'and')",
    "picker_top10": """WITH o AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') WHEN 1 THEN upper(p_name) ELSE p_name END AS option FROM part WHERE contains(lower(p_name), 're')),
        t AS (SELECT unnest(['Re', 're', ' Re']) AS typed), r AS (SELECT typed, option, (CASE WHEN starts_with(option, typed) THEN -10 WHEN starts_with(option, 're') THEN -9 WHEN starts_with(lower(option), typed) THEN -8 WHEN starts_with(lower(option), 're') THEN -7 ELSE length(option) END)::BIGINT AS rank FROM o, t)
        SELECT typed, option, rank, greatest((SELECT count(*) FROM o) - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY rank, option) AS n FROM r) WHERE n <= 10""",
    "valid_paths": r"""WITH u AS (SELECT page_id AS n, regexp_replace(url, '^https?:/', '') AS path, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
        t AS (SELECT n, CASE n % 6 WHEN 0 THEN path WHEN 1 THEN path[2:101] WHEN 2 THEN path[2:101] || '\x' WHEN 3 THEN path[2:101] || '/../x' WHEN 4 THEN repeat(host, 60) ELSE host || '//x' END AS p,
                     CASE n % 4 WHEN 0 THEN host WHEN 1 THEN replace(host, '.', '_') WHEN 2 THEN repeat('-', n % 100) ELSE '..' END AS name FROM u)
        SELECT n AS page_id, strlen(p) BETWEEN 1 AND 1000 AND NOT starts_with(p, '/') AND NOT ends_with(p, '/') AND NOT contains(p, '//') AND NOT contains(p, '\') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('.', '..'))) = 0 AS path_ok,
               regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') AS name_ok, regexp_full_match(name, '[A-Za-z0-9_.-]{1,64}') AND NOT regexp_full_match(name, '[.]+') AS source_ok FROM t""",
    "auth_log_pairs": """WITH e AS (SELECT event_id AS seq, user_id AS process, event_type, 'u' || (user_id % 7) AS user, '10.0.0.' || (event_id % 250) AS ip, '10.1.0.0/16,10.2.' || (event_id % 3) || '.0/24' AS required, event_id % 5 AS h, CASE WHEN event_id % 2 = 0 THEN 'sshd' ELSE 'sshd-session' END AS daemon FROM events),
        keys AS (SELECT user_id AS process, 'SHA256:' || md5(max(event_id)::VARCHAR) || '=' AS fingerprint, (1024 + max(event_id) % 999)::VARCHAR AS port FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT e.seq, e.process, fingerprint, ip, e.user, port, required, 'Jan 01 00:00:00 host ' || daemon || '[' || e.process || ']: Authentication tried for ' || e.user || ' with correct key but not from a permitted host (host=h' || h || ', ip=' || ip || ', required=' || required || ').' AS line
        FROM e JOIN keys ON keys.process = e.process WHERE e.event_type = 'error'""",
    "stream_pairs": "SELECT r.user_id AS process, r.event_id::VARCHAR AS user, k.event_id::VARCHAR AS print FROM events r JOIN events k ON r.user_id = k.user_id AND r.event_type = 'error' AND k.event_type = 'signup' AND k.ts BETWEEN r.ts - INTERVAL 1 DAY AND r.ts + INTERVAL 1 DAY",
    "access_stats": "SELECT user_id, event_type, count(*) AS n, sum(strlen(props))::BIGINT AS size FROM events GROUP BY 1, 2",
    "result_stats": """WITH c AS (SELECT event_type, event_id % 3 AS a, CASE WHEN event_id % 5 = 4 THEN 0 ELSE event_id % 5 + 1 END AS k FROM events WHERE event_id % 11 <> 0)
        SELECT event_type, 'b/' || a AS path, count(*) AS n, sum(k)::BIGINT AS size, 'queries' AS kind FROM c GROUP BY 1, 2
        UNION ALL SELECT event_type, 'b/' || a || '/' || i, count(*), NULL, 'results' FROM c, unnest(range(1, k + 1)) AS t(i) GROUP BY event_type, a, i""",
    "write_amplification": "SELECT o_orderpriority, count(*) AS original, count(*) FILTER (o_orderkey % 3 <> 0) AS written, sum(floor(o_totalprice)::BIGINT)::BIGINT AS original_bytes, coalesce(sum(floor(o_totalprice)::BIGINT) FILTER (o_orderkey % 3 <> 0), 0)::BIGINT AS written_bytes, coalesce(sum(floor(o_totalprice)::BIGINT) FILTER (o_orderkey % 3 <> 0), 0)::DOUBLE / sum(floor(o_totalprice)::BIGINT)::DOUBLE AS share FROM orders GROUP BY 1",
    "tumbling_access": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY 1, 2",
    "stream_tumble": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2",
    "stream_changes": "SELECT event_id FROM events",
    "sliding_bytes": "SELECT event_id, (sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW))::BIGINT AS recent FROM events",
    "session_windows": "WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL 6 HOURS > ts THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS end, count(*) AS n FROM s GROUP BY user_id, k",
    "path_prefix_agg": f"WITH {_PREFIXES} SELECT prefix, count(*) AS n, sum(size)::BIGINT AS weight FROM prefixes GROUP BY 1",
    "path_summary_total": f"WITH {_LISTING} SELECT count(*) AS n, sum(size)::BIGINT AS weight FROM listing",
    "longest_prefix_assign": f"WITH {_PREFIXES}, entries AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 OR len(p) = 1 THEN p[1] ELSE p[1] || '/' || p[2] END AS entry FROM parts WHERE page_id % 3 = 0), best AS (SELECT page_id, arg_max(prefix, length(prefix)) AS entry FROM prefixes WHERE prefix IN (SELECT entry FROM entries) GROUP BY 1) SELECT l.page_id, b.entry FROM listing l LEFT JOIN best b USING (page_id)",
    "knn_exact": f"WITH {_UNIT} SELECT vec_id, round({_CLOSE.format(a='u', b='(SELECT u FROM units WHERE vec_id = 0)')}, 6) AS closeness FROM units ORDER BY {_CLOSE.format(a='u', b='(SELECT u FROM units WHERE vec_id = 0)')} DESC, vec_id LIMIT 10",
    "ivf_full_probe": f"WITH {_UNIT} SELECT vec_id, round({_CLOSE.format(a='u', b='(SELECT u FROM units WHERE vec_id = 0)')}, 4) AS closeness FROM units ORDER BY {_CLOSE.format(a='u', b='(SELECT u FROM units WHERE vec_id = 0)')} DESC, vec_id LIMIT 10",
    "ivf_insert_remove": "SELECT vec_id FROM embeddings WHERE (vec_id % 2 = 0 OR vec_id % 3 = 0) AND vec_id % 5 <> 0",
    "knn_many": f"WITH {_UNIT}, c AS (SELECT q.vec_id AS query_id, v.vec_id, {_CLOSE.format(a='v.u', b='q.u')} AS closeness FROM units q, units v WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, round(closeness, 6) AS closeness FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, vec_id) AS n FROM c) WHERE n <= 5",
    "avg_embedding_by_label": """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT m.label, round(max(CASE WHEN i = 1 THEN x / n END), 6) AS m0, round(max(CASE WHEN i = 64 THEN x / n END), 6) AS m63 FROM m JOIN n USING (label) GROUP BY 1""",
    "closeness_matrix": f"WITH {_UNIT} SELECT q.vec_id AS query_id, v.vec_id, round({_CLOSE.format(a='v.u', b='q.u')}, 6) AS closeness FROM units v JOIN units q ON q.vec_id % 50 = 0",
    "decode_error": "SELECT true AS within",
    "encode_q8": f"""WITH {_UNIT}, g AS (SELECT vec_id, k, u[k * 32 + 1 : k * 32 + 32] AS x FROM units, unnest(range(0, 2)) AS t(k)), s AS (SELECT *, list_max(list_transform(x, lambda y: abs(y))) / 127 AS scale FROM g),
        q AS (SELECT vec_id, k, scale, array_to_string(list_transform(x, lambda y: greatest(-127, least(127, floor(y / scale + 0.5)))::INT), ',') AS d FROM s) SELECT vec_id, string_agg(d, ',' ORDER BY k) AS data, round(sum(scale), 9) AS scales FROM q GROUP BY 1""",
    "fmt_scalars": r"""WITH n AS (SELECT *, regexp_replace(lower(substr(o_orderpriority, 3)) || '_orderTotal_2x  price', '([a-z])([A-Z])', '\1 \2', 'g') AS x FROM orders),
        w AS (SELECT *, upper(x[1]) || regexp_replace(x, '_([A-Za-z])', ' \1', 'g')[2:] AS y FROM n)
        SELECT o_orderkey, CASE WHEN length(o_orderpriority) > 6 THEN substr(o_orderpriority, 1, 3) || '...' ELSE o_orderpriority END AS short, strftime(o_orderdate, '%Y/%m/%d %I:%M:%S %p') AS shown,
               regexp_replace(y[:strpos(y, ' ')] || upper(y[strpos(y, ' ') + 1]) || y[strpos(y, ' ') + 2:], '\s+', ' ', 'g') AS spaced, floor(o_totalprice * 10 + 0.5) / 10 AS rounded, floor(-o_orderkey / 2.0 + 0.5)::BIGINT AS half,
               (o_orderkey % 5 - 2)::DOUBLE + CASE WHEN o_orderkey % 5 = 2 THEN 1e-6::DOUBLE ELSE abs(o_orderkey % 5 - 2)::DOUBLE / 1000000 END AS version FROM w""",
    "nice_stringify": """WITH p AS (SELECT p_partkey AS n, p_size, CASE p_partkey % 8 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'true' WHEN 2 THEN p_partkey || ' pieces' WHEN 3 THEN '[' || p_name || ']' WHEN 4 THEN '{NaN}' WHEN 5 THEN '-' || p_name WHEN 6 THEN '' ELSE p_name END AS t FROM part)
        SELECT n AS p_partkey, CASE WHEN n % 8 IN (5, 7) THEN t ELSE '"' || t || '"' END AS text, CASE WHEN n % 4 = 0 THEN '{Undefined}' WHEN n % 2 = 0 THEN '' ELSE 'false' END AS flag,
               CASE WHEN n % 5 = 0 THEN '{NaN}' WHEN n % 5 = 1 THEN '{Undefined}' WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE (p_size / 4.0::DOUBLE)::VARCHAR END AS number, '"' || t || '"' AS back FROM p""",
    "url_parts": r"""WITH u AS (SELECT page_id AS n, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages), p AS (SELECT *, CASE WHEN n % 3 = 0 THEN 4445 ELSE 443 END AS port FROM u)
        SELECT n AS page_id, host AS address, port::BIGINT AS port, 'acc' || (n % 5) AS account, 'b ' || n AS bucket, false AS other,
               'https://' || host || CASE WHEN n % 2 = 0 THEN '' ELSE ':8443' END || '/file/acc' || (n % 5) || '/b%20' || n || '/storage/storagerouting.json' AS moved,
               'https://' || host || CASE WHEN n % 3 = 0 THEN ':4445' ELSE '' END || '/file/acc' || (n % 5) || '/b%20' || n || '/a%20b/c%2Bd(1)/%C3%A9' AS file,
               (host || '-' || port || CASE n % 4 WHEN 1 THEN '-route-0.125-0.625' WHEN 2 THEN '-route-0.25-0.75' WHEN 3 THEN '-route-0.375-0.875' ELSE '' END)[:64] AS source_name, 'com-' || n AS bucket_name FROM p""",
    "http_range": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 206 WHEN 1 THEN 206 WHEN 2 THEN 416 ELSE 200 END::BIGINT AS status, CASE page_id % 4 WHEN 0 THEN 10 WHEN 1 THEN strlen(html) - 7 WHEN 3 THEN 0 END::BIGINT AS first, CASE page_id % 4 WHEN 0 THEN 19 WHEN 1 THEN strlen(html) - 1 WHEN 3 THEN strlen(html) - 1 END::BIGINT AS last,
        (page_id * 100) // 1000 <= 2 AS not_modified FROM pages""",
    "manifest_digest": r"""SELECT doc_id, strlen(t) + 4 AS size, sha256(unhex('FF00E90A' || hex(encode(t)))) AS sha256 FROM (SELECT doc_id, replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)) AS t FROM documents)""",
    "render_trimmed": "WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS t FROM conversations) SELECT conv_id, turn, CASE WHEN len(string_split(t, chr(10))) > 2 THEN array_to_string(string_split(t, chr(10))[1:2], chr(10)) || '...' ELSE t END AS shown FROM c",
    "preserved_write_time": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE c_custkey END::BIGINT AS write_time FROM customer",
    "lww_get_row": f"WITH {_LOG}, {_FOLD} SELECT key, kt AS time, value, props FROM live WHERE key = 11",
    "compaction_steps": f"""WITH RECURSIVE {_FILES}, {_KEY_GROUPS.format(lines="(SELECT * FROM lineitem WHERE l_linenumber <= 2)")},
        g AS (SELECT min(key) AS lo, max(key) AS hi, (sum(slots) - count(*))::DOUBLE / sum(slots)::DOUBLE AS dup FROM in_group GROUP BY group_no),
        d AS (SELECT (sum(slots) - count(*))::DOUBLE / sum(slots)::DOUBLE AS dup FROM keys),
        m AS (SELECT coalesce(sum(bytes) FILTER (tier = 'log'), 0)::BIGINT AS lb, count(*) FILTER (tier = 'log') AS ln, coalesce(sum(bytes) FILTER (tier = 'loose'), 0)::BIGINT AS sb, count(*) FILTER (tier = 'loose') AS sn, coalesce(sum(bytes) FILTER (tier = 'combined'), 0)::BIGINT AS cb, count(*) FILTER (tier = 'combined') AS cn FROM f),
        a AS (SELECT m.*, cn >= 2 AND cb >= 536870912 AND d.dup >= 0.5 AS everything FROM m, d),
        listed AS (SELECT * FROM g WHERE dup >= 0.4 UNION SELECT * FROM g WHERE (SELECT max(dup) FROM g) < 0.4 AND lo = (SELECT arg_max(lo, (dup, lo)) FROM g)),
        steps AS (
          SELECT 1 AS phase, 'fold_hard' AS step, lb >= 805306368 AND ln > 0 AS ready, lb AS bytes, NULL::BIGINT AS lo, NULL::BIGINT AS hi, NULL::DOUBLE AS dup FROM a
          UNION ALL SELECT 1, 'fold', lb < 805306368 AND lb >= 67108864, lb, NULL, NULL, NULL FROM a
          UNION ALL SELECT 2, 'combine', sn >= 2 AND (sb >= 1073741824 OR sn >= 20), sb, NULL, NULL, NULL FROM a
          UNION ALL SELECT 3, 'dedup_all', everything, cb, NULL, NULL, NULL FROM a
          UNION ALL SELECT 3, 'dedup_group', NOT (SELECT everything FROM a) AND dup >= 0.4 AND count(f.bytes) >= 2, coalesce(sum(f.bytes), 0)::BIGINT, lo, hi, dup FROM listed LEFT JOIN f ON f.tier = 'combined' AND f.min_key <= hi AND f.max_key >= lo GROUP BY lo, hi, dup)
        SELECT phase, step, ready, bytes, lo, hi, dup, CASE WHEN ready THEN 1000 + 300 * (count(*) FILTER (ready) OVER (ORDER BY phase, step, dup DESC, lo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) END AS start_at FROM steps""",
    "filter_changes": f"WITH {_LISTING}, routed AS (SELECT *, {_ROUTE.format(key='path')} AS r FROM listing) SELECT path, create_time, size FROM routed WHERE create_time > 1700000100000 AND r >= 0.1 AND r < 0.7",
    "expired_tombstones": f"WITH {_BLOBS} SELECT path, write_time FROM idx WHERE state = 'deleted' AND write_time < TIMESTAMP '2024-01-24 00:00:00'",
    "accepted_stamps": "SELECT event_id AS seq, ts AS time FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:15:00'",
    "conditional_writes": f"""WITH {_BLOBS.replace('FROM events)', "FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')")},
        w AS (SELECT 'blob/' || (user_id % 10) || '/' || user_id AS path, ts AS time, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE floor(value)::BIGINT + 1 END AS size FROM events WHERE event_type IN ('click', 'view', 'error'))
        SELECT seq, w.path, CASE WHEN {_ROUTE.format(key='w.path')} >= 0.8 THEN 'route' WHEN w.time < TIMESTAMP '2024-01-03' OR w.time >= TIMESTAMP '2024-01-28' THEN 'window' WHEN w.time > TIMESTAMP '2024-01-26 00:15:00' THEN 'future'
          WHEN idx.state = 'live' AND w.size > 0 THEN 'immutable' WHEN idx.write_time > w.time THEN 'stale' ELSE 'ok' END AS verdict FROM w LEFT JOIN idx ON idx.path = w.path""",
    "scan_verdict": f"WITH {_SIDES}, n AS (SELECT count(*) AS known FROM orders), s AS (SELECT count(*) AS n FROM theirs WHERE path % 4 = 1), a AS (SELECT count(*) AS n FROM theirs) SELECT 0 AS attempts, s.n, CASE WHEN s.n < known / 2.0 THEN 'retry' ELSE 'accept' END AS verdict FROM s, n UNION ALL SELECT 3, s.n, 'accept' FROM s UNION ALL SELECT 0, a.n, CASE WHEN a.n < known / 2.0 THEN 'retry' ELSE 'accept' END FROM a, n",
    "shard_keys": "SELECT page_id, true AS inside, true AS kept FROM pages",
    "accepts_writes": f"WITH {_WINDOWS} SELECT entry, s > 700 OR e > 700 AS open FROM windows",
    "access_tree": """WITH e AS (SELECT event_type, ['b' || (event_id % 2), (user_id % 10)::VARCHAR, user_id::VARCHAR] AS p, CASE WHEN event_type <> 'view' THEN strlen(props) END AS size FROM events)
        SELECT event_type, array_to_string(p[1:i], '/') AS prefix, count(*) AS n, sum(size)::BIGINT AS size FROM e, unnest(range(1, 4)) AS t(i) GROUP BY 1, 2""",
    "vector_lookup": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT o_custkey FROM orders)",
    "guess_format": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Number.MAX_SAFE_INTEGER' WHEN 1 THEN '-Infinity' WHEN 3 THEN strftime(make_timestamp((1262304000000 + o_orderkey * 3600000) * 1000), '%Y/%m/%d %I:%M:%S %p') WHEN 4 THEN format('{:,}', o_orderkey * 1000) ELSE '' END AS number,
        CASE o_orderkey % 4 WHEN 0 THEN ' no ' || o_orderkey WHEN 1 THEN 'order ' || o_orderkey WHEN 2 THEN 'http://e.org/<x>' ELSE o_orderstatus END AS text,
        CASE o_orderkey % 4 WHEN 0 THEN 'Error: no ' || o_orderkey WHEN 1 THEN 'https://e.org/' WHEN 2 THEN 'http://e.org/' ELSE o_orderstatus END AS address, 'https://e.org/' || o_orderkey AS filled FROM orders""",
    "stream_coalesce": "SELECT (user_id % 50)::VARCHAR AS path, arg_max(ts, (ts, event_id)) AS time, arg_max(event_id, (ts, event_id)) AS seq, arg_max(strlen(props), (ts, event_id))::INT AS size, min(ts) + INTERVAL 1 DAY AS due, count(*) AS writes FROM events GROUP BY 1",
    "stream_sessions": "SELECT * FROM (WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL 6 HOURS > ts THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS end, count(*) AS n FROM s GROUP BY user_id, k) WHERE \"end\" <= (SELECT max(ts) FROM events)",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
