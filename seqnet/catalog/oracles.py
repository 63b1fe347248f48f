"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from seqnet.catalog.inputs import EVENT_TYPES

ORACLES: dict[str, str] = {}

# --- shared table expressions ------------------------------------------------------

USERS = "SELECT 'all' AS graph_id, user_id AS case_id, ts AS o1, 0 AS o2, 0 AS o3, event_type AS item FROM events"
SEGMENTS = (
    "SELECT c_mktsegment AS graph_id, user_id AS case_id, ts AS o1, 0 AS o2, 0 AS o3, event_type AS item "
    "FROM events JOIN customer ON user_id = c_custkey"
)
BRANDS = (
    "SELECT c_mktsegment AS graph_id, o_custkey AS case_id, o_orderdate AS o1, o_orderkey AS o2, l_linenumber AS o3, p_brand AS item "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey"
)
PRIORITIES = "SELECT 'all' AS graph_id, o_custkey AS case_id, o_orderdate AS o1, 0 AS o2, 0 AS o3, o_orderpriority AS item FROM orders"
ROLES = "SELECT 'all' AS graph_id, conv_id AS case_id, turn AS o1, 0 AS o2, 0 AS o3, role AS item FROM conversations"


def seq(base: str) -> str:
    """Events, ordered rows and run-free rows of one event table."""
    return f"""
ev AS ({base}),
rws AS (SELECT *, lag(item) OVER w AS prev, lead(item) OVER w AS nxt, row_number() OVER w AS pos
        FROM ev WINDOW w AS (PARTITION BY graph_id, case_id ORDER BY o1, o2, o3, item)),
runs AS (SELECT graph_id, case_id, item, row_number() OVER (PARTITION BY graph_id, case_id ORDER BY pos) AS pos,
                count(*) OVER (PARTITION BY graph_id, case_id) AS n
         FROM rws WHERE prev IS NULL OR prev <> item),
seqs AS (SELECT graph_id, case_id, item, pos, lead(item) OVER (PARTITION BY graph_id, case_id ORDER BY pos) AS nxt FROM runs WHERE n >= 2)"""


def net(base: str) -> str:
    """The observed network of one event table as ``net``."""
    return seq(base) + """,
net AS (SELECT graph_id, prev AS src, item AS dst, count(*)::DOUBLE AS weight FROM rws WHERE prev <> item GROUP BY ALL)"""


def states(base: str, source: str = "SOURCE", sink: str = "SINK") -> str:
    """The network with virtual nodes as ``sk`` (with kinds) and ``states`` (without)."""
    return net(base) + f""",
sk AS (SELECT graph_id, src, dst, 'normal_transition' AS kind, weight FROM net
  UNION ALL SELECT graph_id, '{source}', item, 'source_transition', count(*)::DOUBLE FROM seqs WHERE pos = 1 GROUP BY ALL
  UNION ALL SELECT graph_id, item, '{sink}', 'sink_transition', count(*)::DOUBLE FROM seqs WHERE nxt IS NULL GROUP BY ALL),
states AS (SELECT graph_id, src, dst, sum(weight) AS weight FROM sk GROUP BY ALL)"""


STRONG = net(BRANDS).replace("net AS (", "allnet AS (") + """,
net AS (SELECT graph_id, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, src, dst) AS r FROM allnet) WHERE r <= 30)"""

STRENGTH = """,
ends AS (SELECT graph_id, src AS node, weight AS o, 0::DOUBLE AS i, 1 AS od, 0 AS idg FROM net UNION ALL SELECT graph_id, dst, 0::DOUBLE, weight, 0, 1 FROM net),
strength AS (SELECT graph_id, node, sum(o) AS out_weight, sum(i) AS in_weight, sum(od)::BIGINT AS out_degree, sum(idg)::BIGINT AS in_degree FROM ends GROUP BY ALL)"""

FORWARD_ROOT = STRENGTH + """,
roots AS (SELECT graph_id, node AS root FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY CASE WHEN in_degree = 0 THEN 0 ELSE 1 END, out_weight DESC, node) AS r FROM strength) WHERE r = 1)"""
GREEDY_ROOT = STRENGTH + """,
roots AS (SELECT graph_id, node AS root FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY CASE WHEN upper(node) = 'START' THEN 0 ELSE 1 END, out_weight DESC, out_degree DESC, node) AS r FROM strength) WHERE r = 1)"""
MAX_NAME_ROOT = STRENGTH + """,
roots AS (SELECT graph_id, node AS root FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY CASE WHEN in_degree = 0 THEN 0 ELSE 1 END, out_weight DESC, node DESC) AS r FROM strength WHERE out_degree > 0) WHERE r = 1)"""

FORWARD = """,
fw AS (
  SELECT graph_id, 0 AS step, [root] AS seen, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::DOUBLE AS weight FROM roots
  UNION ALL
  SELECT f.graph_id, f.step + 1, list_append(f.seen, e.dst), e.src, e.dst, e.weight
  FROM fw f, LATERAL (SELECT n.src, n.dst, n.weight FROM net n WHERE n.graph_id = f.graph_id AND list_contains(f.seen, n.src)
    AND NOT list_contains(f.seen, n.dst) ORDER BY n.weight DESC, n.src, n.dst LIMIT 1) e),
tree AS (SELECT graph_id, src, dst, weight FROM fw WHERE step > 0)"""

LEVELS = """,
lv AS (
  SELECT graph_id, root AS node, 0::BIGINT AS level, root AS path, NULL::DOUBLE AS bw, 0.0::DOUBLE AS pw FROM roots
  UNION ALL
  SELECT l.graph_id, t.dst, l.level + 1, l.path || ' -> ' || t.dst, least(coalesce(l.bw, t.weight), t.weight), l.pw + t.weight
  FROM lv l JOIN tree t ON t.graph_id = l.graph_id AND t.src = l.node)"""

LEAVES = """,
paths AS (SELECT l.graph_id, l.path, r.root AS start, l.node AS "end", l.level AS branch_depth, l.pw AS path_weight, l.bw AS bottleneck_weight
  FROM lv l JOIN roots r USING (graph_id) WHERE l.level > 0 AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.graph_id = l.graph_id AND t.src = l.node))"""


def polytree(edges: str = "net", start: str = "weight DESC, src, dst") -> str:
    """Sequential growth in both directions as ``poly``."""
    return f""",
pstart AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {start}) AS r FROM {edges} WHERE src <> dst) WHERE r = 1),
pw AS (
  SELECT graph_id, 0 AS step, [src, dst] AS seen, [0, 1] AS at, src, dst, weight, 'INITIAL' AS direction, 0::BIGINT AS level FROM pstart
  UNION ALL
  SELECT f.graph_id, f.step + 1, list_append(f.seen, e.fresh), list_append(f.at, f.at[list_position(f.seen, e.old)] + 1), e.src, e.dst, e.weight, e.direction,
         (f.at[list_position(f.seen, e.old)] + 1)::BIGINT
  FROM pw f, LATERAL (
    SELECT n.src, n.dst, n.weight, CASE WHEN list_contains(f.seen, n.src) THEN 'FORWARD' ELSE 'BACKWARD' END AS direction,
      CASE WHEN list_contains(f.seen, n.src) THEN n.dst ELSE n.src END AS fresh, CASE WHEN list_contains(f.seen, n.src) THEN n.src ELSE n.dst END AS old
    FROM {edges} n WHERE n.graph_id = f.graph_id AND list_contains(f.seen, n.src) <> list_contains(f.seen, n.dst)
    ORDER BY n.weight DESC, n.src, n.dst LIMIT 1) e),
poly AS (SELECT graph_id, src, dst, weight, direction, level FROM pw)"""


NODES = """,
nodes AS (SELECT graph_id, src AS node FROM net UNION SELECT graph_id, dst FROM net)"""

SIZES = NODES + """,
sizes AS (SELECT graph_id, count(*) AS nodes FROM nodes GROUP BY ALL),
sums AS (SELECT graph_id, count(*) AS edges, sum(weight) AS total_weight FROM net GROUP BY ALL),
metrics AS (SELECT graph_id, nodes, edges, total_weight, CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1)) ELSE 0 END AS density, total_weight / edges AS average_weight
  FROM sizes JOIN sums USING (graph_id))"""

CLOSURE = """,
closure AS (SELECT graph_id, src AS a, dst AS b FROM net UNION SELECT c.graph_id, c.a, n.dst FROM closure c JOIN net n ON n.graph_id = c.graph_id AND n.src = c.b),
cyc AS (SELECT graph_id, bool_or(a = b) AS has_cycles FROM closure GROUP BY ALL)"""

UNDIRECTED = """,
und AS (SELECT graph_id, src AS a, dst AS b FROM net UNION SELECT graph_id, dst, src FROM net),
joined AS (SELECT graph_id, a, b FROM und UNION SELECT j.graph_id, j.a, u.b FROM joined j JOIN und u ON u.graph_id = j.graph_id AND u.a = j.b),
comp AS (SELECT graph_id, a AS node, min(b) AS component FROM joined GROUP BY ALL)"""

TOPK = """,
tk AS (
  SELECT graph_id, 0::BIGINT AS level, root AS node, [root] AS path, NULL::VARCHAR AS src, NULL::DOUBLE AS weight FROM roots
  UNION ALL
  SELECT f.graph_id, f.level + 1, e.dst, list_append(f.path, e.dst), e.src, e.weight
  FROM tk f, LATERAL (SELECT n.src, n.dst, n.weight FROM net n WHERE n.graph_id = f.graph_id AND n.src = f.node AND NOT list_contains(f.path, n.dst)
    ORDER BY n.weight DESC, n.dst LIMIT 2) e
  WHERE f.level < 5),
topk AS (SELECT graph_id, src, node AS dst, weight, level, array_to_string(path[1:len(path) - 1], ' -> ') AS parent_path FROM tk WHERE level > 0)"""


def influence(latency: float, base: str = "SELECT 'all' AS graph_id, user_id AS entity, epoch_us(ts) AS t, event_type AS s FROM events") -> str:
    """Influence rows of one signal table as ``inf``."""
    return f"""
sg AS ({base}),
prs AS (SELECT a.graph_id, a.s AS from_signal, b.s AS to_signal, b.t - a.t AS dt FROM sg a JOIN sg b
  ON a.graph_id = b.graph_id AND a.entity = b.entity AND b.t > a.t AND b.t - a.t <= {int(latency * 1_000_000)}),
inf AS (SELECT graph_id, from_signal, to_signal, dt, count(*) AS frequency, 1 / (1 + dt / 1000000) AS temporal_decay,
  count(*) * (1 / (1 + dt / 1000000)) AS influence_weight FROM prs GROUP BY graph_id, from_signal, to_signal, dt)"""


def edges_of_influence(epsilon: float = 0.01) -> str:
    return f""",
ie AS (SELECT graph_id, from_signal AS src, to_signal AS dst, sum(influence_weight + {epsilon}) AS weight, sum(influence_weight) AS influence_weight,
  sum(frequency)::BIGINT AS frequency, avg(dt / 1000000) AS delta_t, avg(temporal_decay) AS temporal_decay FROM inf GROUP BY ALL)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def w(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"



# --- sources and sinks ------------------------------------------------------------------

oracle("read_table", "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
oracle("write_tables_by_graph", w(net(SEGMENTS), "SELECT graph_id, src, dst, weight FROM net"))


def _profile(column: str) -> str:
    label = f"CASE WHEN lower(trim({column}::VARCHAR, ' \t\n\r\f')) NOT IN ('', 'nan', 'nat') THEN trim({column}::VARCHAR, ' \t\n\r\f') END"
    return (
        f"SELECT '{column}' AS \"column\", round(avg(CASE WHEN t IS NULL THEN 1.0 ELSE 0 END), 6) AS null_ratio, "
        "round(avg(CASE WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS number_ratio, "
        "round(avg(CASE WHEN try_cast(t AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS date_ratio, min(t) AS sample, "
        f"count(DISTINCT t) AS distinct_count FROM (SELECT {label} AS t FROM conversations)"
    )


ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
oracle("profile_distinct", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM orders" for c in ORDER_COLUMNS))
oracle("profile_columns", " UNION ALL ".join(_profile(c) for c in ("conv_id", "turn", "role", "text")))
oracle("read_weighted_sequences", w(states(ROLES), "SELECT graph_id, src, dst, weight FROM states"))
oracle(
    "read_numeric_sequences",
    r"""WITH d AS (SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents),
o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'sequences' AS kind, count(*) AS lines, sum(n)::BIGINT AS items FROM (
  SELECT n FROM o WHERE n >= 2 UNION ALL SELECT len(regexp_split_to_array(line, '\s+')) FROM d WHERE regexp_full_match(line, '[0-9]+(\s+[0-9]+)+'))
UNION ALL SELECT 'rejects', count(*), 0 FROM d WHERE line <> '' AND NOT regexp_full_match(line, '[0-9]+(\s+[0-9]+)*')""",
)
ROLE_CODE = "CASE role WHEN 'system' THEN '1' WHEN 'user' THEN '2' ELSE '3' END"
oracle("read_event_log", f"SELECT conv_id AS case_id, turn + 1 AS ord, {ROLE_CODE} AS event, 0::BIGINT AS flag FROM conversations")
oracle(
    "event_log_header",
    "SELECT count(DISTINCT conv_id) AS meta_1, count(*) AS meta_2, count(DISTINCT conv_id) AS cases, count(*) AS events, 0::BIGINT AS rejected, "
    "true AS cases_agree, true AS events_agree FROM conversations",
)
oracle("read_sequence_csv", w(seq(ROLES), "SELECT case_id::VARCHAR AS case_id, pos AS ord, item FROM seqs"))
oracle("read_event_table", "SELECT user_id AS case_id, epoch_us(ts) AS micros, event_type AS item FROM events")
oracle("read_transactions", w(net(PRIORITIES.replace("0 AS o2", "o_orderkey AS o2")), "SELECT graph_id, src, dst, weight FROM net"))
oracle(
    "transaction_quality",
    "SELECT count(*) AS rows, count(*) FILTER (o_custkey IS NULL) AS missing_customer, count(*) FILTER (o_orderdate IS NULL) AS missing_date, "
    "count(*) FILTER (o_orderpriority IS NULL) AS missing_category, count(*) FILTER (o_custkey IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL) AS invalid_rows FROM orders",
)
FLOWS = (
    "SELECT s_nationkey::VARCHAR AS src, c_nationkey::VARCHAR AS dst, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
)
oracle("read_edges", f"SELECT 'all' AS graph_id, src, dst, sum(weight) AS weight FROM ({FLOWS}) WHERE src <> dst AND weight > 0 GROUP BY ALL")
oracle("read_pair_frequencies", "SELECT 'all' AS graph_id, o_orderstatus AS src, o_orderpriority AS dst, count(*)::DOUBLE AS weight FROM orders GROUP BY ALL")
oracle("matrix_to_edges", w(net(USERS), "SELECT graph_id, src, dst, weight FROM net"))
oracle(
    "adapt_edge_columns",
    w(
        influence(3600) + edges_of_influence(),
        "SELECT graph_id, src, dst, round(weight, 6) AS weight, round(influence_weight, 6) AS influence_weight, frequency::DOUBLE AS frequency, round(delta_t, 6) AS delta_t FROM ie",
    ),
)

# --- projections and filters ---------------------------------------------------------------

oracle(
    "clean_text",
    r"""SELECT doc_id, CASE WHEN lower(t) NOT IN ('', 'nan', 'nat') THEN length(t) END AS chars, CASE WHEN doc_id % 2 = 0 THEN source END AS label
FROM (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""",
)
oracle("min_length", w(seq(PRIORITIES), "SELECT graph_id, case_id, count(*) AS events FROM runs WHERE n >= 2 GROUP BY ALL"))
oracle("filter_edges", w(STRONG, "SELECT * FROM net WHERE weight >= 5"))
oracle("strong_edges", w(net(BRANDS), "SELECT graph_id, src, dst, weight FROM net WHERE weight >= 20"))
oracle("drop_virtual", w(net(SEGMENTS), "SELECT graph_id, src, dst, weight FROM net"))
oracle(
    "influence_filters",
    w(
        influence(3600),
        "SELECT from_signal, to_signal, dt, frequency, round(influence_weight + 0.01, 9) AS smoothed_weight FROM inf "
        "WHERE frequency >= 1 AND influence_weight + 0.01 >= 0.0105 AND dt <= 1800000000",
    ),
)
oracle("valid_ratio_gate", "SELECT o_orderpriority AS item, count(*) AS events FROM orders GROUP BY 1")
REACHED = """,
rch AS (SELECT graph_id, root AS node FROM roots UNION SELECT r.graph_id, n.dst FROM rch r JOIN net n ON n.graph_id = r.graph_id AND n.src = r.node)"""
oracle(
    "reachable_subgraph",
    w(net(BRANDS) + FORWARD_ROOT + REACHED, "SELECT n.graph_id, n.src, n.dst, n.weight FROM net n JOIN rch r ON n.graph_id = r.graph_id AND n.src = r.node"),
)

# --- sequences and scalar functions -----------------------------------------------------------

CUTS = "SELECT quantile_cont(value, 1/3) AS lo, quantile_cont(value, 2/3) AS hi FROM events"
QLABEL = "CASE WHEN value <= lo THEN 'LOW' WHEN value <= hi THEN 'MEDIUM' ELSE 'HIGH' END"
oracle(
    "build_events",
    f"SELECT user_id AS case_id, upper(event_type) || '_VALUE_' || {QLABEL} AS item, count(*) AS events FROM events, ({CUTS}) GROUP BY ALL",
)


def variation(value: str) -> str:
    return f"CASE WHEN {value} < -2 THEN 'STRONG_DOWN' WHEN {value} < -0.5 THEN 'DOWN' WHEN {value} <= 0.5 THEN 'STABLE' WHEN {value} <= 2 THEN 'UP' ELSE 'STRONG_UP' END"


WEEK = "'W' || isoyear(ts) || '_' || lpad(week(ts)::VARCHAR, 2, '0')"
oracle(
    "build_window_events",
    w(
        net(f"SELECT 'all' AS graph_id, {WEEK} AS case_id, ts AS o1, 0 AS o2, 0 AS o3, upper(event_type) || '_' || {variation('value')} AS item FROM events"),
        "SELECT graph_id, src, dst, weight FROM net",
    ),
)
oracle(
    "sanitize_event",
    r"SELECT p_partkey, upper(trim(regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '\s+', '_', 'g'), '[^0-9A-Za-zÀ-ÿ._-]+', '_', 'g'), '_')) AS label FROM part",
)
oracle("discretize_quantile", f"SELECT {QLABEL} AS label, count(*) AS events FROM events, ({CUTS}) GROUP BY 1")
oracle("discretize_variation", f"SELECT {variation('round((l_discount - l_tax) * 100, 4)')} AS label, count(*) AS lines FROM lineitem GROUP BY 1")
oracle(
    "window_case_id",
    "SELECT o_orderkey, strftime(o_orderdate, 'W%Y_%m_%d') AS daily, 'W' || isoyear(o_orderdate) || '_' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS weekly, "
    "strftime(o_orderdate, 'W%Y_%m') AS monthly, 'W' || year(o_orderdate) || '_Q' || quarter(o_orderdate) AS quarterly FROM orders",
)
oracle(
    "parse_order",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey::DOUBLE END AS number FROM orders",
)
oracle("order_kind", "SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'text'), ('o_totalprice', 'numeric')) t(\"column\", kind)")
oracle("order_events_by_user", w(seq(USERS), "SELECT case_id, item, pos FROM rws"))
oracle("dedup_consecutive", w(seq(BRANDS), "SELECT graph_id, case_id, count(*) AS events FROM runs GROUP BY ALL"))
oracle("next_item", w(seq(USERS), "SELECT case_id, item, coalesce(nxt, 'SINK') AS next_item, pos FROM seqs"))
oracle("case_sequences", w(seq(PRIORITIES), "SELECT case_id, string_agg(item, ' ' ORDER BY pos) AS sequence, count(*) AS length FROM seqs GROUP BY 1"))
oracle(
    "sequence_stats",
    w(
        seq(BRANDS) + """,
per AS (SELECT graph_id, case_id, count(*) AS raw, count(*) FILTER (prev IS NULL OR prev <> item) AS len FROM rws GROUP BY ALL)""",
        "SELECT graph_id, count(*) AS cases, count(*) FILTER (len >= 2) AS sequences, count(*) FILTER (len < 2) AS short_cases, count(*) FILTER (raw <> len) AS cases_with_runs, "
        "sum(raw)::BIGINT AS raw_events, sum(len) FILTER (len >= 2)::BIGINT AS events, round(avg(len) FILTER (len >= 2), 6) AS mean_length, min(len) FILTER (len >= 2) AS min_length, "
        "max(len) FILTER (len >= 2) AS max_length FROM per GROUP BY 1",
    ),
)
oracle(
    "log_consistency",
    "SELECT l_orderkey AS case_id, count(*) AS events, min(l_linenumber)::BIGINT AS min_order, max(l_linenumber)::BIGINT AS max_order, min(l_linenumber) < 1 AS order_below_one, "
    "count(*) <> count(DISTINCT l_linenumber) AS repeated_order, count(*) <> max(l_linenumber) - min(l_linenumber) + 1 AS not_contiguous FROM lineitem GROUP BY 1",
)
oracle(
    "same_time_ties",
    "SELECT 'all' AS graph_id, count(*) AS moments, count(*) FILTER (n > 1) AS tied_moments, count(*) FILTER (k > 1) AS ambiguous_moments "
    "FROM (SELECT o_custkey, o_orderdate, count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY ALL)",
)
TOKENS = "SELECT lang AS graph_id, doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS items FROM documents"
oracle(
    "event_vocabulary",
    f"SELECT graph_id, count(*) AS events, count(DISTINCT t) AS items, count(DISTINCT t) > 500 OR count(DISTINCT t) > greatest(50, floor(count(*) * 0.5)) AS too_many "
    f"FROM (SELECT graph_id, unnest(items) AS t FROM ({TOKENS})) GROUP BY 1",
)
oracle(
    "clean_number",
    "SELECT o_orderstatus, round(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END), 2) AS total, "
    "sum(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE trunc(o_totalprice)::BIGINT END)::BIGINT AS whole FROM orders GROUP BY 1",
)

# --- networks ------------------------------------------------------------------------------------

oracle("transitions", w(seq(USERS), "SELECT case_id, prev AS src, item AS dst, count(*) AS steps FROM rws WHERE prev <> item GROUP BY ALL"))
oracle("pair_frequencies", w(net(USERS), "SELECT graph_id, src, dst, weight FROM net"))
oracle("streamed_pair_frequencies", w(net(USERS), "SELECT graph_id, src, dst, weight FROM net"))
oracle("brand_pair_frequencies", w(net(BRANDS), "SELECT graph_id, src, dst, weight FROM net"))
TOKEN_STEPS = f"""
tok AS (SELECT graph_id, doc_id, unnest(items) AS t, generate_subscripts(items, 1) AS p FROM ({TOKENS})),
steps AS (SELECT graph_id, doc_id, lag(t) OVER (PARTITION BY doc_id ORDER BY p) AS src, t AS dst FROM tok)"""
oracle("token_network", w(TOKEN_STEPS, "SELECT graph_id, src, dst, count(*)::DOUBLE AS weight FROM steps WHERE src <> dst GROUP BY ALL"))
oracle("sequence_transitions", w(TOKEN_STEPS, "SELECT graph_id, doc_id AS seq_id, count(*) AS steps FROM steps WHERE src <> dst GROUP BY ALL"))
oracle("state_network", w(states(SEGMENTS), "SELECT graph_id, src, dst, kind, weight FROM sk"))
oracle("start_end_network", w(states(PRIORITIES, "START", "END"), "SELECT graph_id, src, dst, kind, weight FROM sk"))
_cells = ", ".join(f"sum(CASE WHEN dst = '{t}' THEN weight ELSE 0.0 END) AS {t}" for t in EVENT_TYPES)
oracle("adjacency_matrix", w(net(USERS), f"SELECT graph_id, src, {_cells} FROM net GROUP BY ALL"))
oracle(
    "transition_matrix",
    w(
        net(SEGMENTS) + NODES,
        "SELECT a.graph_id, a.node AS src, b.node AS dst, coalesce(n.weight, 0.0) AS weight FROM nodes a JOIN nodes b USING (graph_id) "
        "LEFT JOIN net n ON n.graph_id = a.graph_id AND n.src = a.node AND n.dst = b.node",
    ),
)
oracle("top_transitions", w(net(BRANDS), "SELECT * FROM (SELECT graph_id, src, dst, weight, row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, src, dst) AS rank FROM net) WHERE rank <= 5"))
oracle("node_strength", w(net(BRANDS) + STRENGTH, "SELECT * FROM strength"))
oracle(
    "centrality",
    w(
        net(BRANDS) + STRENGTH + ", tot AS (SELECT graph_id, sum(weight) AS t FROM net GROUP BY 1)",
        "SELECT graph_id, node, out_weight AS out_strength, in_weight AS in_strength, round(out_weight / t * 100, 6) AS out_relative_strength, round(in_weight / t * 100, 6) AS in_relative_strength, "
        "out_degree + in_degree AS degree FROM strength JOIN tot USING (graph_id)",
    ),
)
oracle(
    "relative_weight",
    w(
        net(BRANDS),
        "SELECT graph_id, src, dst, weight, round(weight / sum(weight) OVER (PARTITION BY graph_id, src) * 100, 6) AS relative_weight, "
        "row_number() OVER (PARTITION BY graph_id, src ORDER BY weight DESC, dst) AS rank FROM net",
    ),
)
oracle(
    "network_metrics",
    w(
        net(BRANDS) + SIZES,
        "SELECT graph_id, nodes, edges, total_weight, round(density, 6) AS density, round(average_weight, 6) AS average_weight, edges > 1000 OR (nodes >= 50 AND density > 0.2) AS dense FROM metrics",
    ),
)
oracle(
    "most_influential",
    w(
        net(BRANDS) + STRENGTH,
        "SELECT graph_id, arg_max(node, {'w': out_weight, 'd': out_degree + in_degree, 'n': node}) AS most_influential, max(out_weight) AS out_strength, "
        "arg_max(node, {'w': in_weight, 'd': out_degree + in_degree, 'n': node}) AS most_received, max(in_weight) AS in_strength FROM strength GROUP BY 1",
    ),
)
oracle(
    "merge_flow_edges",
    f"SELECT 'all' AS graph_id, src, dst, weight FROM (SELECT 'n' || src AS src, 'n' || dst AS dst, sum(weight) AS weight FROM ({FLOWS}) GROUP BY ALL) ORDER BY weight DESC, src, dst LIMIT 100",
)

# --- joins -------------------------------------------------------------------------------------------

oracle("latency_pairs", w(influence(86400), "SELECT from_signal, to_signal, count(*) AS pairs FROM prs GROUP BY ALL"))
oracle(
    "frontier_levels",
    w(
        net(BRANDS) + FORWARD_ROOT + """,
walk AS (SELECT graph_id, root AS node, 0::BIGINT AS level FROM roots UNION SELECT k.graph_id, n.dst, k.level + 1 FROM walk k JOIN net n ON n.graph_id = k.graph_id AND n.src = k.node WHERE k.level < 30)""",
        "SELECT graph_id, node, min(level) AS level FROM walk GROUP BY ALL",
    ),
)
oracle(
    "uncovered_nodes",
    w(STRONG, "SELECT DISTINCT graph_id, node FROM (SELECT graph_id, src AS node FROM allnet UNION SELECT graph_id, dst FROM allnet) EXCEPT (SELECT graph_id, src FROM net UNION SELECT graph_id, dst FROM net)"),
)
oracle(
    "reverse_edge_lookup",
    w(net(SEGMENTS), "SELECT a.graph_id, a.src, a.dst, a.weight, b.weight AS reverse_weight FROM net a LEFT JOIN net b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src"),
)

# --- temporal influence -----------------------------------------------------------------------------------

oracle(
    "prepare_signals",
    "SELECT user_id AS entity, event_type AS signal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS event_index, epoch_us(ts) AS t, 'datetime' AS order_kind FROM events",
)
oracle("signal_counter", "SELECT o_custkey AS entity, strftime(o_orderdate, '%Y-%m-%d') AS time, o_orderpriority AS signal, count(*) AS signal_counter FROM orders GROUP BY ALL")
oracle(
    "temporal_influence",
    w(influence(3600), "SELECT from_signal, to_signal, dt, frequency, round(temporal_decay, 9) AS temporal_decay, round(influence_weight, 9) AS influence_weight FROM inf"),
)
oracle(
    "temporal_influence_day",
    w(influence(86400), "SELECT from_signal, to_signal, count(*) AS distances, sum(frequency)::BIGINT AS frequency, round(sum(influence_weight), 6) AS influence_weight FROM inf GROUP BY ALL"),
)
oracle(
    "smooth_and_filter",
    w(influence(3600), "SELECT from_signal, to_signal, dt, frequency, round(influence_weight + 0.05, 9) AS smoothed_weight FROM inf WHERE influence_weight + 0.05 >= 0.051"),
)
_ROUND_IE = (
    "SELECT graph_id, src, dst, round(weight, 6) AS weight, round(influence_weight, 6) AS influence_weight, frequency, round(delta_t, 6) AS delta_t, round(temporal_decay, 6) AS temporal_decay FROM ie"
)
oracle("influence_edges", w(influence(3600) + edges_of_influence(), _ROUND_IE))
_icells = ", ".join(f"round(sum(CASE WHEN dst = '{t}' THEN weight ELSE 0.0 END), 6) AS {t}" for t in EVENT_TYPES)
oracle("influence_matrix", w(influence(3600) + edges_of_influence(), f"SELECT graph_id, src, {_icells} FROM ie GROUP BY ALL"))
oracle(
    "influence_metrics",
    w(
        influence(3600) + edges_of_influence(),
        "SELECT 'all' AS graph_id, (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events) AS entities, (SELECT count(DISTINCT event_type) FROM events) AS signals, "
        "(SELECT count(*) FROM inf) AS raw_influence_relations, (SELECT count(*) FROM inf) AS filtered_influence_relations, count(*) AS temporal_relations, "
        "round(sum(weight), 6) AS total_influence_weight, bool_or(src = dst) AS has_cycles FROM ie",
    ),
)
POSITIONS = "SELECT graph_id, case_id AS entity, pos * 1000000 AS t, item AS s FROM seqs"
oracle("positional_events", w(seq(SEGMENTS) + "," + influence(10, POSITIONS) + edges_of_influence(), _ROUND_IE))

# --- structures ------------------------------------------------------------------------------------------------

_ROOT_2007 = """
SELECT graph_id, root, selection, network FROM (
  SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY out_weight DESC, in_weight - out_weight, out_degree DESC, node) AS r, node AS root, 'dominant_real_root' AS selection, 'brands' AS network FROM strength
  WHERE graph_id NOT IN (SELECT graph_id FROM strength WHERE in_degree = 0)) WHERE r = 1
UNION ALL SELECT graph_id, node, CASE WHEN (SELECT count(*) FROM strength z WHERE z.graph_id = s.graph_id AND z.in_degree = 0) = 1 THEN 'single_zero_indegree' ELSE 'zero_indegree_highest_out_weight' END, 'brands'
  FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY out_weight DESC, out_degree DESC, node) AS r FROM strength WHERE in_degree = 0) s WHERE r = 1
UNION ALL SELECT DISTINCT c_mktsegment, 'SOURCE', 'SOURCE', 'states' FROM events JOIN customer ON user_id = c_custkey"""
oracle("choose_root_2007", w(net(BRANDS) + STRENGTH, _ROOT_2007))
oracle("choose_root_forward", w(net(BRANDS) + FORWARD_ROOT, "SELECT graph_id, root FROM roots"))
oracle("choose_root_greedy", w(net(BRANDS) + GREEDY_ROOT, "SELECT graph_id, root FROM roots"))
oracle(
    "infer_initial_node",
    w(
        net(BRANDS) + STRENGTH + """,
zero AS (SELECT graph_id, max_by(node, {'w': out_weight, 'n': node}) AS root FROM strength WHERE in_degree = 0 AND out_degree > 0 GROUP BY 1),
heavy AS (SELECT graph_id, max_by(node, {'w': out_weight, 'n': node}) AS root FROM strength WHERE out_degree > 0 GROUP BY 1),
picked AS (SELECT graph_id, z.root, 'auto' AS force FROM heavy h LEFT JOIN zero z USING (graph_id)
  UNION ALL SELECT graph_id, coalesce(z.root, h.root), 'forward' FROM heavy h LEFT JOIN zero z USING (graph_id)
  UNION ALL SELECT graph_id, NULL, 'back_and_forward' FROM heavy)""",
        "SELECT graph_id, root, CASE WHEN root IS NULL THEN 'none' ELSE 'inferred' END AS mode, force FROM picked",
    ),
)


def brute_branching() -> str:
    """Every choice of one parent per item, kept when all choices lead back to SOURCE."""
    names = [f"p{i}" for i in range(len(EVENT_TYPES))]
    froms = " JOIN ".join(
        [f"(SELECT graph_id, src, weight FROM states WHERE dst = '{EVENT_TYPES[0]}') p0"]
        + [f"(SELECT graph_id, src, weight FROM states WHERE dst = '{t}') p{i} ON p{i}.graph_id = p0.graph_id" for i, t in enumerate(EVENT_TYPES) if i]
    )
    chain = "MAP {" + ", ".join([f"'{t}': {n}.src" for t, n in zip(EVENT_TYPES, names)] + ["'SOURCE': 'SOURCE'"]) + "}"

    def climb(start: str) -> str:
        out = f"'{start}'"
        for _ in EVENT_TYPES:
            out = f"m[{out}]"
        return f"{out} = 'SOURCE'"

    total = " + ".join(f"{n}.weight" for n in names)
    return f""",
choices AS (SELECT p0.graph_id, {total} AS total, {chain} AS m FROM {froms}),
sinks AS (SELECT graph_id, max(weight) AS weight FROM states WHERE dst = 'SINK' GROUP BY 1),
best AS (SELECT graph_id, max(total) AS weight FROM choices WHERE {" AND ".join(climb(t) for t in EVENT_TYPES)} GROUP BY 1)"""


oracle("max_rooted_branching", w(states(SEGMENTS) + brute_branching(), "SELECT graph_id, 6::BIGINT AS edges, best.weight + sinks.weight AS weight FROM best JOIN sinks USING (graph_id)"))
oracle("forward_tree", w(net(BRANDS) + FORWARD_ROOT + FORWARD, "SELECT graph_id, src, dst, weight FROM tree"))
oracle(
    "tree_levels",
    w(net(BRANDS) + FORWARD_ROOT + FORWARD + LEVELS, "SELECT t.graph_id, t.src, t.dst, t.weight, l.level FROM tree t JOIN lv l ON l.graph_id = t.graph_id AND l.node = t.dst"),
)
oracle(
    "tree_nodes",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + LEVELS,
        "SELECT l.graph_id, l.node, l.level, l.level = 0 AS is_root, (l.level > 0)::BIGINT AS in_degree, (SELECT count(*) FROM tree t WHERE t.graph_id = l.graph_id AND t.src = l.node) AS out_degree FROM lv l",
    ),
)
oracle(
    "greedy_tree",
    w(net(BRANDS) + GREEDY_ROOT + FORWARD + LEVELS, "SELECT t.graph_id, t.src, t.dst, t.weight, l.level FROM tree t JOIN lv l ON l.graph_id = t.graph_id AND l.node = t.dst"),
)
oracle("expand_paths", w(net(BRANDS) + FORWARD_ROOT + FORWARD + LEVELS + LEAVES, "SELECT * FROM paths"))
oracle(
    "expansion_metrics",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + LEVELS + LEAVES + """,
kids AS (SELECT graph_id, src, count(*) AS k FROM tree GROUP BY ALL),
a AS (SELECT graph_id, count(*) AS dominant_paths, max(branch_depth) AS max_branch_depth FROM paths GROUP BY 1),
b AS (SELECT graph_id, round(avg(k), 6) AS average_branching_factor, max(k) AS max_branching_factor FROM kids GROUP BY 1)""",
        "SELECT graph_id, dominant_paths, average_branching_factor, max_branching_factor, max_branch_depth FROM a JOIN b USING (graph_id)",
    ),
)
oracle(
    "dominant_path",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + LEVELS + LEAVES,
        "SELECT graph_id, path, path_weight, branch_depth FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY path_weight DESC, path) AS r FROM paths) WHERE r = 1",
    ),
)
oracle("back_forward_polytree", w(net(BRANDS) + polytree(), "SELECT graph_id, src, dst, weight, direction FROM poly"))
oracle("polytree_levels", w(net(SEGMENTS) + polytree(), "SELECT graph_id, src, dst, weight, level, direction FROM poly"))
oracle(
    "back_forward_legacy",
    w(
        states(SEGMENTS, "START", "END") + """,
bf AS (
  SELECT DISTINCT graph_id, 0 AS step, ['START'] AS seen, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::DOUBLE AS weight, NULL::VARCHAR AS direction FROM states
  UNION ALL
  SELECT f.graph_id, f.step + 1, list_append(f.seen, CASE WHEN e.direction = 'FORWARD' THEN e.dst ELSE e.src END), e.src, e.dst, e.weight, e.direction
  FROM bf f, LATERAL (SELECT n.*, CASE WHEN list_contains(f.seen, n.src) THEN 'FORWARD' ELSE 'BACKWARD' END AS direction FROM states n
    WHERE n.graph_id = f.graph_id AND list_contains(f.seen, n.src) <> list_contains(f.seen, n.dst) ORDER BY n.weight DESC, n.src, n.dst LIMIT 1) e)""",
        "SELECT graph_id, src, dst, weight, direction FROM bf WHERE step > 0",
    ),
)
oracle("topk_polytree", w(net(SEGMENTS) + GREEDY_ROOT + TOPK, "SELECT * FROM topk"))
oracle("collapse_polytree", w(net(SEGMENTS) + GREEDY_ROOT + TOPK, "SELECT graph_id, src, dst, max(weight) AS weight, count(*) AS occurrences FROM topk GROUP BY ALL"))
oracle(
    "forum_forward_tree",
    w(
        net(BRANDS) + MAX_NAME_ROOT + """,
ch AS (
  SELECT graph_id, 0::BIGINT AS level, root AS node, [root] AS seen, NULL::VARCHAR AS src, NULL::DOUBLE AS weight FROM roots
  UNION ALL
  SELECT f.graph_id, f.level + 1, e.dst, list_append(f.seen, e.dst), e.src, e.weight
  FROM ch f, LATERAL (SELECT n.src, n.dst, n.weight FROM net n WHERE n.graph_id = f.graph_id AND n.src = f.node AND NOT list_contains(f.seen, n.dst) ORDER BY n.weight DESC, n.dst LIMIT 1) e
  WHERE f.level < 10)""",
        "SELECT graph_id, src, node AS dst, weight, level FROM ch WHERE level > 0",
    ),
)
QUEUE = """,
qt AS (
  SELECT graph_id, 0 AS step, 1 AS head, 0 AS taken, [root] AS queue, [0] AS lv, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::DOUBLE AS weight, NULL::BIGINT AS level FROM roots
  UNION ALL
  SELECT f.graph_id, f.step + 1, CASE WHEN e.dst IS NULL THEN f.head + 1 ELSE f.head END, CASE WHEN e.dst IS NULL THEN 0 ELSE f.taken + 1 END,
    CASE WHEN e.dst IS NULL THEN f.queue ELSE list_append(f.queue, e.dst) END, CASE WHEN e.dst IS NULL THEN f.lv ELSE list_append(f.lv, f.lv[f.head] + 1) END,
    CASE WHEN e.dst IS NULL THEN NULL ELSE f.queue[f.head] END, e.dst, e.weight, CASE WHEN e.dst IS NULL THEN NULL ELSE (f.lv[f.head] + 1)::BIGINT END
  FROM qt f LEFT JOIN LATERAL (SELECT n.dst, n.weight FROM net n WHERE n.graph_id = f.graph_id AND n.src = f.queue[f.head] AND NOT list_contains(f.queue, n.dst)
    AND f.taken < 3 AND f.lv[f.head] < 10 ORDER BY n.weight DESC, n.dst LIMIT 1) e ON true
  WHERE f.head <= len(f.queue))"""
oracle("forum_forward_tree_top3", w(net(BRANDS) + MAX_NAME_ROOT + QUEUE, "SELECT graph_id, src, dst, weight, level FROM qt WHERE dst IS NOT NULL"))
_LATE_START = "weight DESC, src DESC, dst DESC"
oracle("forum_polytree", w(net(SEGMENTS) + polytree(start=_LATE_START), "SELECT graph_id, src, dst, weight, level, direction FROM poly"))
_capped = (
    polytree(start=_LATE_START)
    .replace("list_contains(f.seen, n.src) <> list_contains(f.seen, n.dst)\n", "list_contains(f.seen, n.src) <> list_contains(f.seen, n.dst) AND f.at[list_position(f.seen, CASE WHEN list_contains(f.seen, n.src) THEN n.src ELSE n.dst END)] < 1\n")
    .replace("n.src, n.dst LIMIT 1) e)", "n.src, n.dst LIMIT 1) e WHERE f.step < 2)")
)
oracle("forum_polytree_capped", w(net(SEGMENTS) + _capped, "SELECT graph_id, src, dst, weight, level, direction FROM poly"))


def _follow(start: str) -> list[str]:
    out, links = start, []
    for _ in EVENT_TYPES:
        out = f"f.m[{out}]"
        links.append(f"coalesce({out} = e.src, false)")
    return links


oracle(
    "simplified_influence",
    w(
        net(SEGMENTS) + f""",
sh AS (SELECT *, weight / sum(weight) OVER (PARTITION BY graph_id, src) * 100 AS share FROM net),
rk AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY share DESC, weight DESC, src, dst) AS r FROM sh),
pk AS (
  SELECT DISTINCT graph_id, 0 AS r, MAP([]::VARCHAR[], []::VARCHAR[]) AS m, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::DOUBLE AS weight, NULL::DOUBLE AS share FROM net
  UNION ALL
  SELECT f.graph_id, f.r + 1, CASE WHEN t.ok THEN map_concat(f.m, MAP([e.src], [e.dst])) ELSE f.m END, CASE WHEN t.ok THEN e.src END, CASE WHEN t.ok THEN e.dst END, e.weight, e.share
  FROM pk f JOIN rk e ON e.graph_id = f.graph_id AND e.r = f.r + 1,
  LATERAL (SELECT f.m[e.src] IS NULL AND NOT ({" OR ".join(_follow("e.dst"))}) AS ok) t)""",
        "SELECT graph_id, src, dst, weight, round(share, 6) AS relative_weight FROM pk WHERE src IS NOT NULL",
    ),
)
oracle(
    "greedy_walks",
    w(
        net(BRANDS) + STRENGTH + """,
sh AS (SELECT *, weight / sum(weight) OVER (PARTITION BY graph_id, src) * 100 AS share FROM net),
st AS (SELECT graph_id, node FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY out_weight DESC, node) AS r FROM strength WHERE out_degree > 0) WHERE r <= 3),
gw AS (
  SELECT graph_id, node AS start, [node] AS items, 0.0::DOUBLE AS tw, 0.0::DOUBLE AS ts FROM st
  UNION ALL
  SELECT f.graph_id, f.start, list_append(f.items, e.dst), f.tw + e.weight, f.ts + e.share
  FROM gw f, LATERAL (SELECT n.dst, n.weight, n.share FROM sh n WHERE n.graph_id = f.graph_id AND n.src = f.items[-1] AND NOT list_contains(f.items, n.dst)
    ORDER BY n.share DESC, n.weight DESC, n.dst LIMIT 1) e WHERE len(f.items) < 6),
last AS (SELECT *, row_number() OVER (PARTITION BY graph_id, start ORDER BY len(items) DESC) AS r FROM gw)""",
        "SELECT graph_id, start, array_to_string(items, ' -> ') AS path, tw AS total_weight, round(ts / (len(items) - 1), 6) AS average_relative_weight FROM last WHERE r = 1 AND len(items) > 1",
    ),
)
oracle(
    "forward_dominant_walk",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + """,
dw AS (
  SELECT graph_id, 0::BIGINT AS step, NULL::VARCHAR AS src, root AS dst, NULL::DOUBLE AS weight FROM roots
  UNION ALL
  SELECT f.graph_id, f.step + 1, e.src, e.dst, e.weight FROM dw f, LATERAL (SELECT t.src, t.dst, t.weight FROM tree t WHERE t.graph_id = f.graph_id AND t.src = f.dst ORDER BY t.weight DESC, t.dst DESC LIMIT 1) e)""",
        "SELECT graph_id, step, src, dst, weight FROM dw WHERE step > 0",
    ),
)
_TREE_WALKS = """,
tu AS (SELECT graph_id, src AS a, dst AS b, weight FROM poly UNION ALL SELECT graph_id, dst, src, weight FROM poly),
tw AS (SELECT graph_id, a, b, [a, b] AS seen, weight AS pw, 1::BIGINT AS steps FROM tu
  UNION ALL SELECT t.graph_id, t.a, u.b, list_append(t.seen, u.b), t.pw + u.weight, t.steps + 1 FROM tw t JOIN tu u ON u.graph_id = t.graph_id AND u.a = t.b WHERE NOT list_contains(t.seen, u.b))"""
oracle(
    "polytree_dominant_path",
    w(
        net(SEGMENTS) + polytree(start=_LATE_START) + _TREE_WALKS,
        "SELECT graph_id, steps, path_weight FROM (SELECT graph_id, steps, pw AS path_weight, row_number() OVER (PARTITION BY graph_id ORDER BY pw DESC, a) AS r FROM tw) WHERE r = 1",
    ),
)

# --- graph analytics and validation -------------------------------------------------------------------------------

oracle("is_dag", w(net(BRANDS) + CLOSURE, "SELECT graph_id, NOT has_cycles AS is_dag, has_cycles FROM cyc"))
oracle(
    "reachable_all",
    w(
        net(BRANDS) + FORWARD_ROOT + REACHED + NODES + """,
a AS (SELECT graph_id, count(*) AS nodes FROM nodes GROUP BY 1), b AS (SELECT graph_id, count(*) AS reached FROM rch GROUP BY 1)""",
        "SELECT graph_id, nodes, reached, nodes = reached AS all_reachable FROM a JOIN b USING (graph_id)",
    ),
)
oracle(
    "weak_components",
    w(
        net(BRANDS) + UNDIRECTED + ", sz AS (SELECT graph_id, component, count(*) AS n FROM comp GROUP BY ALL)",
        "SELECT graph_id, count(*) AS components, max(n) AS largest, sum(n)::BIGINT AS nodes FROM sz GROUP BY 1",
    ),
)
_SUMMARY = """,
deg AS (SELECT graph_id, max(in_degree) AS max_in_degree, max(out_degree) AS max_out_degree, count(*) FILTER (in_degree = 0) AS sources, count(*) FILTER (out_degree = 0) AS sinks FROM strength GROUP BY 1)"""
_SUMMARY_COLUMNS = "graph_id, nodes, edges, total_weight, round(density, 6) AS density, max_in_degree, max_out_degree, sources, sinks, round(2 * edges / nodes, 6) AS average_degree"
oracle("graph_summary", w(net(BRANDS) + STRENGTH + SIZES + _SUMMARY, f"SELECT {_SUMMARY_COLUMNS} FROM metrics JOIN deg USING (graph_id)"))
oracle(
    "validate_observed",
    w(net(BRANDS) + STRENGTH + SIZES + _SUMMARY + CLOSURE, f"SELECT {_SUMMARY_COLUMNS}, NOT has_cycles AS is_dag, has_cycles FROM metrics JOIN deg USING (graph_id) JOIN cyc USING (graph_id)"),
)
oracle(
    "pagerank",
    w(
        net(USERS) + NODES + """,
nn AS (SELECT count(*)::DOUBLE AS n FROM nodes), ow AS (SELECT src, sum(weight) AS o FROM net GROUP BY 1),
sharing AS (SELECT n.src, n.dst, n.weight / ow.o AS share FROM net n JOIN ow USING (src)),
pr AS (
  SELECT 0 AS i, map_from_entries(list((node, 1 / n))) AS m FROM nodes, nn
  UNION ALL
  SELECT pr.i + 1, (SELECT map_from_entries(list((node, r))) FROM (
    SELECT node, 0.15 / n + 0.85 * (coalesce((SELECT sum(pr.m[s.src] * s.share) FROM sharing s WHERE s.dst = node), 0)
      + coalesce((SELECT sum(pr.m[d.node]) FROM nodes d WHERE d.node NOT IN (SELECT src FROM ow)), 0) / n) AS r FROM nodes, nn) z)
  FROM pr WHERE pr.i < 60),
fin AS (SELECT unnest(map_keys(m)) AS node, unnest(map_values(m)) AS r FROM pr WHERE i = 60)""",
        "SELECT 'all' AS graph_id, node, round(r / (SELECT max(r) FROM fin), 4) AS centrality FROM fin",
    ),
)
oracle(
    "betweenness",
    w(
        net(SEGMENTS) + NODES + """,
sp AS (SELECT graph_id, src AS a, dst AS b, [src, dst] AS seen, weight AS d FROM net
  UNION ALL SELECT s.graph_id, s.a, n.dst, list_append(s.seen, n.dst), s.d + n.weight FROM sp s JOIN net n ON n.graph_id = s.graph_id AND n.src = s.b WHERE NOT list_contains(s.seen, n.dst)),
mn AS (SELECT graph_id, a, b, min(d) AS d FROM sp GROUP BY ALL),
best AS (SELECT s.graph_id, s.a, s.b, s.seen, 1.0 / count(*) OVER (PARTITION BY s.graph_id, s.a, s.b) AS part FROM sp s JOIN mn USING (graph_id, a, b, d)),
thru AS (SELECT graph_id, unnest(seen[2:len(seen) - 1]) AS node, part FROM best),
acc AS (SELECT graph_id, node, sum(part) AS s FROM thru GROUP BY ALL),
cnt AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1)""",
        "SELECT graph_id, node, round(coalesce(s, 0) * CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) ELSE 1 END, 6) AS betweenness FROM nodes JOIN cnt USING (graph_id) LEFT JOIN acc USING (graph_id, node)",
    ),
)
_TREE_SIZE = """,
tsz AS (SELECT graph_id, count(*) AS edges, sum(weight) AS total_weight FROM tree GROUP BY 1), gsz AS (SELECT graph_id, count(*) AS e, sum(weight) AS t FROM net GROUP BY 1)"""
oracle(
    "validate_branching",
    w(
        states(SEGMENTS) + brute_branching() + ", whole AS (SELECT graph_id, sum(weight) AS t FROM states GROUP BY 1)",
        "SELECT graph_id, 7::BIGINT AS nodes, 6::BIGINT AS edges, best.weight + sinks.weight AS total_weight, round((best.weight + sinks.weight) / t * 100, 6) AS preserved_percent, "
        "true AS is_dag, true AS root_exists, 0::BIGINT AS root_in_degree, 1::BIGINT AS max_other_in_degree, true AS all_reachable, true AS edge_count_ok, true AS is_valid "
        "FROM best JOIN sinks USING (graph_id) JOIN whole USING (graph_id)",
    ),
)
oracle(
    "validate_forward",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + _TREE_SIZE,
        "SELECT graph_id, edges + 1 AS nodes, edges, total_weight, round(total_weight / t * 100, 6) AS preserved_percent, true AS is_dag, true AS root_exists, true AS all_reachable, "
        "true AS edge_count_ok, true AS is_valid FROM tsz JOIN gsz USING (graph_id)",
    ),
)
oracle(
    "validate_polytree",
    w(
        net(BRANDS) + polytree() + """,
ind AS (SELECT graph_id, dst, count(*) AS k FROM poly GROUP BY ALL), conv AS (SELECT graph_id, count(*) FILTER (k > 1) AS convergence_nodes FROM ind GROUP BY 1),
tsz AS (SELECT graph_id, count(*) AS edges, sum(weight) AS total_weight FROM poly GROUP BY 1), gsz AS (SELECT graph_id, sum(weight) AS t FROM net GROUP BY 1)""",
        "SELECT graph_id, edges + 1 AS nodes, edges, total_weight, round(total_weight / t * 100, 6) AS preserved_percent, true AS is_dag, 1::BIGINT AS components, convergence_nodes, "
        "true AS undirected_is_tree, true AS edge_count_ok, true AS is_valid FROM tsz JOIN gsz USING (graph_id) JOIN conv USING (graph_id)",
    ),
)
oracle(
    "coverage",
    w(
        STRONG + FORWARD_ROOT + FORWARD + """,
n0 AS (SELECT graph_id, src AS node FROM allnet UNION SELECT graph_id, dst FROM allnet),
u0 AS (SELECT graph_id, src AS a, dst AS b FROM allnet UNION SELECT graph_id, dst, src FROM allnet),
j0 AS (SELECT graph_id, a, b FROM u0 UNION SELECT j.graph_id, j.a, u.b FROM j0 j JOIN u0 u ON u.graph_id = j.graph_id AND u.a = j.b),
c0 AS (SELECT graph_id, count(DISTINCT c) AS components FROM (SELECT graph_id, a, min(b) AS c FROM j0 GROUP BY ALL) GROUP BY 1),
n1 AS (SELECT graph_id, src AS node FROM net UNION SELECT graph_id, dst FROM net), n2 AS (SELECT graph_id, src AS node FROM tree UNION SELECT graph_id, dst FROM tree),
a AS (SELECT graph_id, count(*) AS original_edges, sum(weight) AS original_weight FROM allnet GROUP BY 1), an AS (SELECT graph_id, count(*) AS original_nodes FROM n0 GROUP BY 1),
b AS (SELECT graph_id, count(*) AS filtered_edges, sum(weight) AS filtered_weight FROM net GROUP BY 1), bn AS (SELECT graph_id, count(*) AS filtered_nodes FROM n1 GROUP BY 1),
c AS (SELECT graph_id, count(*) AS structure_edges, sum(weight) AS structure_weight FROM tree GROUP BY 1), cn AS (SELECT graph_id, count(*) AS structure_nodes FROM n2 GROUP BY 1)""",
        "SELECT graph_id, original_edges, original_weight, original_nodes, filtered_edges, filtered_weight, filtered_nodes, structure_edges, structure_weight, structure_nodes, "
        "original_nodes - structure_nodes AS uncovered_nodes, round(structure_nodes / original_nodes * 100, 6) AS node_coverage_percent, round(structure_weight / original_weight * 100, 6) AS preserved_weight_percent, "
        "original_edges - filtered_edges AS removed_edges, original_weight - filtered_weight AS removed_weight, components "
        "FROM a JOIN an USING (graph_id) JOIN b USING (graph_id) JOIN bn USING (graph_id) JOIN c USING (graph_id) JOIN cn USING (graph_id) JOIN c0 USING (graph_id)",
    ),
)
oracle(
    "polytree_metrics",
    w(
        net(SEGMENTS) + GREEDY_ROOT + TOPK + SIZES + """,
mg AS (SELECT graph_id, src, dst, max(weight) AS weight FROM topk GROUP BY ALL),
mn AS (SELECT graph_id, count(*) AS pn FROM (SELECT graph_id, src FROM mg UNION SELECT graph_id, dst FROM mg) GROUP BY 1),
ms AS (SELECT graph_id, count(*) AS de, sum(weight) AS pw FROM mg GROUP BY 1),
br AS (SELECT graph_id, avg(k) AS ab FROM (SELECT graph_id, src, count(*) AS k FROM topk GROUP BY ALL) GROUP BY 1),
rp AS (SELECT graph_id, count(*) AS pe, max(level) AS md, count(*) - count(DISTINCT dst) AS rn, count(DISTINCT dst) AS tg FROM topk GROUP BY 1)""",
        "SELECT graph_id, nodes AS original_nodes, edges AS original_edges, total_weight AS original_weight, round(density, 6) AS density_before, pn AS polytree_nodes, de AS distinct_edges, pw AS polytree_weight, "
        "round(CASE WHEN pn > 1 THEN de / (pn * (pn - 1)) ELSE 0 END, 6) AS density_after, round(ab, 6) AS average_branching, rn AS repeated_nodes, pe AS polytree_edges, md AS max_depth, "
        "round(pw / total_weight * 100, 6) AS preserved_weight_percent, round((1 - de / edges) * 100, 6) AS edge_reduction_percent, "
        "round((0.4 * least(1.0, pw / total_weight) + 0.3 / (1 + ab) + 0.3 * least(1.0, tg / pn)) * 100, 6) AS interpretability_score "
        "FROM metrics JOIN mn USING (graph_id) JOIN ms USING (graph_id) JOIN br USING (graph_id) JOIN rp USING (graph_id)",
    ),
)
oracle("weight_by_level", w(net(SEGMENTS) + GREEDY_ROOT + TOPK, "SELECT graph_id, level, sum(weight) AS weight, count(*) AS edges FROM topk GROUP BY ALL"))
oracle(
    "condensation_metrics",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + _TREE_SIZE,
        "SELECT graph_id, e AS input_edges, edges AS output_edges, e - edges AS removed_edges, round(edges / e, 6) AS compression_ratio, total_weight AS preserved_weight, "
        "round(total_weight / t * 100, 6) AS preserved_weight_percent, round(total_weight / t * 100, 6) AS preserved_reachable_percent FROM tsz JOIN gsz USING (graph_id)",
    ),
)
oracle(
    "node_levels",
    w(
        net(SEGMENTS) + GREEDY_ROOT + TOPK,
        "SELECT graph_id, node, min(level) AS level FROM (SELECT graph_id, src AS node, level - 1 AS level FROM topk UNION ALL SELECT graph_id, dst, level FROM topk UNION ALL SELECT graph_id, root, 0 FROM roots) GROUP BY ALL",
    ),
)
_HOPS = """,
tu AS (SELECT graph_id, src AS a, dst AS b FROM {0} UNION SELECT graph_id, dst, src FROM {0}),
hp AS (SELECT DISTINCT graph_id, a, a AS b, 0::BIGINT AS d FROM tu UNION SELECT h.graph_id, h.a, u.b, h.d + 1 FROM hp h JOIN tu u ON u.graph_id = h.graph_id AND u.a = h.b WHERE h.d < 25),
ds AS (SELECT graph_id, a, b, min(d) AS d FROM hp GROUP BY ALL), ec AS (SELECT graph_id, a AS node, max(d) AS e, count(*) AS r FROM ds GROUP BY ALL)"""
oracle("tree_center", w(net(BRANDS) + polytree() + _HOPS.format("poly"), "SELECT graph_id, node AS center FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY e, node) AS k FROM ec) WHERE k = 1"))
oracle(
    "graph_center",
    w(
        net(BRANDS) + STRENGTH + _HOPS.format("net") + """,
cn AS (SELECT graph_id, count(*) AS n FROM ec GROUP BY 1),
fx AS (SELECT graph_id, node, CASE WHEN r = n THEN e::DOUBLE ELSE 'infinity'::DOUBLE END AS e, out_weight + in_weight AS wt FROM ec JOIN cn USING (graph_id) JOIN strength USING (graph_id, node))""",
        "SELECT graph_id, node AS center, e AS eccentricity FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY e, wt DESC, node) AS k FROM fx) WHERE k = 1",
    ),
)
_COMPARE = states(SEGMENTS) + brute_branching() + FORWARD_ROOT + FORWARD + polytree() + """,
ss AS (SELECT graph_id, count(*) AS oe, sum(weight) AS ow FROM states GROUP BY 1),
ns AS (SELECT graph_id, count(*) AS oe, sum(weight) AS ow FROM net GROUP BY 1),
cmp AS (
  SELECT graph_id, 'rooted_branching' AS method, 7::BIGINT AS original_nodes, oe AS original_edges, 7::BIGINT AS nodes, 6::BIGINT AS edges, ow AS weight_sum, best.weight + sinks.weight AS selected_weight, 'SOURCE' AS anchor
    FROM ss JOIN best USING (graph_id) JOIN sinks USING (graph_id)
  UNION ALL SELECT graph_id, 'forward', 5, oe, count(*) + 1, count(*), ow, sum(t.weight), max(root) FROM ns JOIN tree t USING (graph_id) JOIN roots USING (graph_id) GROUP BY graph_id, oe, ow
  UNION ALL SELECT graph_id, 'back_and_forward', 5, oe, count(*) + 1, count(*), ow, sum(p.weight), max(s.src || ' -> ' || s.dst) FROM ns JOIN poly p USING (graph_id) JOIN pstart s USING (graph_id) GROUP BY graph_id, oe, ow)"""
oracle(
    "compare_methods",
    w(
        _COMPARE,
        "SELECT graph_id, method, original_nodes, original_edges, nodes, edges, weight_sum, selected_weight, round(selected_weight / weight_sum * 100, 6) AS preserved_percent, true AS acyclic, true AS connected, anchor FROM cmp",
    ),
)
oracle(
    "rank_methods",
    w(
        _COMPARE + """,
pct AS (SELECT graph_id, method, edges, selected_weight / weight_sum * 100 AS p FROM cmp),
win AS (SELECT method, count(*) AS wins FROM (SELECT graph_id, method, row_number() OVER (PARTITION BY graph_id ORDER BY p DESC, method) AS r FROM pct) WHERE r = 1 GROUP BY 1),
ag AS (SELECT method, count(*) AS graphs, avg(p) AS mp, stddev_pop(p) AS sp, avg(edges) AS me FROM pct GROUP BY 1)""",
        "SELECT method, graphs, round(mp, 6) AS mean_preserved_percent, round(sp, 6) AS std_preserved_percent, round(me, 6) AS mean_edges, coalesce(wins, 0) AS wins, "
        "row_number() OVER (ORDER BY mp DESC, method) AS rank FROM ag LEFT JOIN win USING (method)",
    ),
)
oracle(
    "classify_structure",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + SIZES + ", tsz AS (SELECT graph_id, sum(weight) AS tw FROM tree GROUP BY 1)",
        "SELECT graph_id, CASE WHEN nodes <= 10 AND density >= 0.7 THEN 'small_complete' WHEN density >= 0.7 THEN 'dense' WHEN density <= 0.05 AND tw / total_weight * 100 >= 80 THEN 'near_linear' ELSE 'intermediate' END AS structure "
        "FROM metrics JOIN tsz USING (graph_id)",
    ),
)
oracle(
    "classify_network",
    w(
        net(BRANDS) + SIZES,
        "SELECT graph_id, CASE WHEN abs(total_weight - edges) < 0.01 THEN 'no_repetition' WHEN nodes <= 10 AND average_weight >= 5 THEN 'strong_recurrent' WHEN nodes >= 100 AND density >= 0.2 THEN 'dense' "
        "WHEN nodes >= 50 AND average_weight <= 1.5 THEN 'mostly_unique' ELSE 'intermediate' END AS recurrence, "
        "CASE WHEN nodes <= 10 AND density >= 0.7 THEN 'small' WHEN density >= 0.7 THEN 'dense' WHEN density <= 0.05 AND average_weight <= 1.5 THEN 'sparse' ELSE 'intermediate' END AS scenario FROM metrics",
    ),
)
oracle(
    "compare_networks",
    w(
        net(BRANDS) + FORWARD_ROOT + FORWARD + SIZES + ", tsz AS (SELECT graph_id, count(*) AS te, sum(weight) AS tw FROM tree GROUP BY 1)",
        "SELECT graph_id, nodes, edges, total_weight, round(density, 6) AS density, te AS structure_edges, tw AS structure_weight, round(tw / total_weight * 100, 6) AS preserved_percent FROM metrics JOIN tsz USING (graph_id)",
    ),
)

_auto = polytree(start=_LATE_START).replace("FROM net WHERE src <> dst) WHERE r = 1", "FROM net WHERE src <> dst AND graph_id NOT IN (SELECT graph_id FROM roots)) WHERE r = 1").replace(
    "list_contains(f.seen, n.src) <> list_contains(f.seen, n.dst)\n",
    "list_contains(f.seen, n.src) <> list_contains(f.seen, n.dst) AND f.at[list_position(f.seen, CASE WHEN list_contains(f.seen, n.src) THEN n.src ELSE n.dst END)] < 10\n",
)
oracle(
    "extract_structure",
    w(
        net(BRANDS) + STRENGTH + """,
roots AS (SELECT graph_id, max_by(node, {'w': out_weight, 'n': node}) AS root FROM strength WHERE in_degree = 0 AND out_degree > 0 GROUP BY 1),
ch AS (
  SELECT graph_id, 0 AS level, root AS node, [root] AS seen, NULL::VARCHAR AS src, NULL::DOUBLE AS weight FROM roots
  UNION ALL
  SELECT f.graph_id, f.level + 1, e.dst, list_append(f.seen, e.dst), e.src, e.weight
  FROM ch f, LATERAL (SELECT n.src, n.dst, n.weight FROM net n WHERE n.graph_id = f.graph_id AND n.src = f.node AND NOT list_contains(f.seen, n.dst) ORDER BY n.weight DESC, n.dst LIMIT 1) e
  WHERE f.level < 10)""" + _auto + """,
sel AS (SELECT graph_id, src, node AS dst, weight, 'forward' AS heuristic FROM ch WHERE level > 0 UNION ALL SELECT graph_id, src, dst, weight, 'back_and_forward' FROM poly),
ins AS (SELECT graph_id, max(k) AS k FROM (SELECT graph_id, dst, count(*) AS k FROM sel GROUP BY ALL) GROUP BY 1),
sz AS (SELECT graph_id, max(heuristic) AS heuristic, count(*) AS e, sum(weight) AS sw FROM sel GROUP BY 1),
bf AS (SELECT graph_id, count(*) AS eb, sum(weight) AS tw FROM net GROUP BY 1)""",
        "SELECT graph_id, heuristic, eb AS edges_before, e + 1 AS nodes_after, e AS edges_after, tw AS total_weight, sw AS selected_weight, round(sw / tw * 100, 6) AS preserved_percent, "
        "true AS is_dag, k <= 1 AS is_tree, true AS is_polytree FROM sz JOIN ins USING (graph_id) JOIN bf USING (graph_id)",
    ),
)


# --- deep and many-rooted networks --------------------------------------------------------------------------------

_STRONG = states(BRANDS) + """,
far AS (SELECT graph_id, src AS a, dst AS b FROM states UNION SELECT f.graph_id, f.a, s.dst FROM far f JOIN states s ON s.graph_id = f.graph_id AND s.src = f.b),
points AS (SELECT graph_id, src AS node FROM states UNION SELECT graph_id, dst FROM states),
mutual AS (SELECT x.graph_id, x.a AS node, x.b AS other FROM far x JOIN far y ON x.graph_id = y.graph_id AND x.a = y.b AND x.b = y.a)"""
oracle("strong_components", w(_STRONG, "SELECT graph_id, node, least(node, coalesce(min(other), node)) AS component FROM points LEFT JOIN mutual USING (graph_id, node) GROUP BY graph_id, node"))
_ORDER_CHAIN = """
placed AS (SELECT c_mktsegment AS graph_id, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place
  FROM orders JOIN customer ON o_custkey = c_custkey),
steps AS (SELECT a.graph_id, a.o_orderkey AS src, b.o_orderkey AS dst FROM placed a JOIN placed b ON a.o_custkey = b.o_custkey AND b.place = a.place + 1)"""
oracle("order_chain_levels", w(_ORDER_CHAIN, "SELECT graph_id, printf('%08d', o_orderkey) AS node, place AS level FROM placed WHERE o_custkey IN (SELECT o_custkey FROM placed WHERE place = 1)"))
oracle(
    "order_ring_is_dag",
    w(
        _ORDER_CHAIN,
        "SELECT graph_id, graph_id <> 'BUILDING' AS is_dag, graph_id = 'BUILDING' AS has_cycles FROM steps GROUP BY ALL",
    ),
)


def brand_betweenness(hops: int = 24) -> str:
    """Shortest ways edge by edge, their number along the tight edges, and the share of ways through each node."""
    return net(BRANDS) + NODES + f""",
cnt AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1),
dk AS (SELECT graph_id, src AS a, dst AS b, weight AS d, 1 AS k FROM net
  UNION ALL SELECT dk.graph_id, dk.a, n.dst, min(dk.d + n.weight), dk.k + 1 FROM dk JOIN net n ON n.graph_id = dk.graph_id AND n.src = dk.b
    WHERE dk.k < {hops} AND dk.a <> n.dst GROUP BY dk.graph_id, dk.a, n.dst, dk.k),
ds AS MATERIALIZED (SELECT graph_id, a, b, min(d) AS d FROM dk GROUP BY graph_id, a, b),
base AS (SELECT graph_id, a, b, d FROM ds UNION ALL SELECT graph_id, node, node, 0 FROM nodes),
tight AS MATERIALIZED (SELECT x.graph_id, x.a, n.src AS u, n.dst AS v FROM base x JOIN net n ON n.graph_id = x.graph_id AND n.src = x.b
  JOIN ds y ON y.graph_id = x.graph_id AND y.a = x.a AND y.b = n.dst AND y.d = x.d + n.weight),
ck AS (SELECT graph_id, node AS a, node AS b, 1::DOUBLE AS c, 0 AS k FROM nodes
  UNION ALL SELECT ck.graph_id, ck.a, t.v, sum(ck.c), ck.k + 1 FROM ck JOIN tight t ON t.graph_id = ck.graph_id AND t.a = ck.a AND t.u = ck.b
    WHERE ck.k < {hops} GROUP BY ck.graph_id, ck.a, t.v, ck.k),
ways AS MATERIALIZED (SELECT graph_id, a, b, sum(c) AS c FROM ck GROUP BY graph_id, a, b),
acc AS (SELECT x.graph_id, x.b AS node, sum(px.c * py.c / pz.c) AS s FROM ds x JOIN ds y ON y.graph_id = x.graph_id AND y.a = x.b
  JOIN ds z ON z.graph_id = x.graph_id AND z.a = x.a AND z.b = y.b AND z.d = x.d + y.d
  JOIN ways px ON px.graph_id = x.graph_id AND px.a = x.a AND px.b = x.b JOIN ways py ON py.graph_id = x.graph_id AND py.a = y.a AND py.b = y.b
  JOIN ways pz ON pz.graph_id = x.graph_id AND pz.a = z.a AND pz.b = z.b GROUP BY x.graph_id, x.b)"""


oracle(
    "brand_betweenness",
    w(
        brand_betweenness(),
        "SELECT graph_id, node, round(coalesce(s, 0) * CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) ELSE 1 END, 6) AS betweenness FROM nodes JOIN cnt USING (graph_id) LEFT JOIN acc USING (graph_id, node)",
    ),
)


def brand_centrality(rounds: int = 60) -> str:
    """PageRank of every brand network as ``central``; a graph rests when its ranks hardly move."""
    parts = ["""
cn AS (SELECT graph_id, count(*)::DOUBLE AS n FROM nodes GROUP BY 1), ow AS (SELECT graph_id, src, sum(weight) AS o FROM net GROUP BY ALL),
sharing AS MATERIALIZED (SELECT net.graph_id, net.src, net.dst, net.weight / ow.o AS share FROM net JOIN ow USING (graph_id, src)),
r0 AS MATERIALIZED (SELECT graph_id, node, n, 1 / n AS r, NULL::DOUBLE AS b, (graph_id, node) NOT IN (SELECT (graph_id, src) FROM ow) AS stuck FROM nodes JOIN cn USING (graph_id))"""]
    for k in range(rounds):
        parts.append(f"""
g{k} AS (SELECT graph_id, sum(CASE WHEN stuck THEN r ELSE 0 END) AS lost, coalesce(sum(abs(r - b)) < max(n) * 1e-6, false) AS still FROM r{k} GROUP BY 1),
s{k} AS (SELECT r{k}.graph_id, dst AS node, sum(r * share) AS got FROM r{k} JOIN sharing ON sharing.graph_id = r{k}.graph_id AND src = node GROUP BY ALL),
r{k + 1} AS MATERIALIZED (SELECT graph_id, node, n, CASE WHEN still THEN r ELSE 0.85 * (coalesce(got, 0) + lost / n) + 0.15 / n END AS r, r AS b, stuck
  FROM r{k} JOIN g{k} USING (graph_id) LEFT JOIN s{k} USING (graph_id, node))""")
    parts.append(f"""
central AS MATERIALIZED (SELECT graph_id, node, r / max(r) OVER (PARTITION BY graph_id) AS centrality FROM r{rounds})""")
    return ",".join(parts)


def multiobjective(levels: int = 5, branching: int = 3, target: float = 0.7) -> str:
    """The scored levels one after the other, with the default weights."""
    parts = [f"""
roots AS (SELECT graph_id, node AS root FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY CASE WHEN upper(node) = 'START' THEN 0 ELSE 1 END, out_weight DESC, centrality DESC, out_degree DESC, node) AS r
  FROM strength JOIN central USING (graph_id, node)) WHERE r = 1),
totals AS (SELECT graph_id, sum(weight) AS total, max(weight) AS top FROM net GROUP BY 1),
scored AS MATERIALIZED (SELECT net.graph_id, net.src, net.dst, net.weight, total, top, out_weight AS o, centrality FROM net JOIN totals USING (graph_id)
  JOIN strength s ON s.graph_id = net.graph_id AND s.node = net.src JOIN central c ON c.graph_id = net.graph_id AND c.node = net.dst),
front1 AS (SELECT graph_id, root AS src, [root] AS path FROM roots),
chosen0 AS (SELECT graph_id, src, dst, weight, 0::BIGINT AS level, '' AS parent_path, 0::DOUBLE AS score, '' AS reason, false AS new FROM net WHERE false)"""]
    for k in range(1, levels + 1):
        parts.append(f"""
ways{k} AS (SELECT s.*, f.path, coalesce(fs.k, 0) AS frm, coalesce(tt.k, 0) AS rep, coalesce(pr.seen, false) AS seen, coalesce(sm.k, 0) AS alln, coalesce(sm.kept, 0) AS kept
  FROM scored s JOIN front{k} f ON f.graph_id = s.graph_id AND f.src = s.src
  LEFT JOIN (SELECT graph_id, src, count(*) AS k FROM chosen{k - 1} GROUP BY ALL) fs ON fs.graph_id = s.graph_id AND fs.src = s.src
  LEFT JOIN (SELECT graph_id, dst, count(*) AS k FROM chosen{k - 1} GROUP BY ALL) tt ON tt.graph_id = s.graph_id AND tt.dst = s.dst
  LEFT JOIN (SELECT DISTINCT graph_id, src, dst, true AS seen FROM chosen{k - 1}) pr ON pr.graph_id = s.graph_id AND pr.src = s.src AND pr.dst = s.dst
  LEFT JOIN (SELECT graph_id, count(*) AS k, sum(CASE WHEN new THEN weight ELSE 0 END) AS kept FROM chosen{k - 1} GROUP BY ALL) sm ON sm.graph_id = s.graph_id
  WHERE NOT list_contains(f.path, s.dst) AND coalesce(fs.k, 0) < {branching} AND coalesce(sm.kept, 0) / total < {target}),
terms{k} AS (SELECT *, weight / top AS nw, weight / o AS tp, CASE WHEN seen THEN 0 ELSE weight / total END AS cg, rep / greatest(alln, 1) AS rp,
  least(1.0::DOUBLE, {k}::DOUBLE / {levels} + frm::DOUBLE / {branching}) AS cp FROM ways{k}),
rated{k} AS (SELECT *, 0.35::DOUBLE * nw + 0.25::DOUBLE * tp + 0.15::DOUBLE * cg + 0.15::DOUBLE * centrality - 0.05::DOUBLE * rp - 0.05::DOUBLE * cp AS score,
  CASE WHEN nw >= 0.7 AND tp >= 0.5 THEN 'heavy' WHEN cg >= 0.05 THEN 'covering' WHEN centrality >= 0.65 THEN 'central' WHEN rp > 0 AND nw >= 0.35 THEN 'repeated' ELSE 'balanced' END AS reason FROM terms{k}),
bys{k} AS (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY score DESC, weight DESC, dst, src, path) AS s FROM rated{k} WHERE score >= 0),
byg{k} AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, weight DESC, dst, src, path) AS g FROM bys{k} WHERE s <= {branching} AND s + frm <= {branching}),
new{k} AS (SELECT *, NOT seen AND row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY g) = 1 AS new FROM byg{k} WHERE g <= {branching}),
had{k} AS (SELECT *, kept + coalesce(sum(CASE WHEN new THEN weight ELSE 0 END) OVER (PARTITION BY graph_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM new{k}),
step{k} AS MATERIALIZED (SELECT * FROM had{k} WHERE had / total < {target}),
chosen{k} AS MATERIALIZED (SELECT * FROM chosen{k - 1} UNION ALL SELECT graph_id, src, dst, weight, {k}, array_to_string(path, ' -> '), score, reason, new FROM step{k}),
front{k + 1} AS (SELECT graph_id, dst AS src, list_append(path, dst) AS path FROM step{k})""")
    return ",".join(parts)


oracle(
    "multiobjective_polytree",
    w(
        net(BRANDS) + STRENGTH + NODES + "," + brand_centrality() + "," + multiobjective(),
        "SELECT graph_id, src, dst, weight, level, parent_path, round(score, 6) AS score, reason FROM chosen5",
    ),
)
oracle("brand_pagerank", w(net(BRANDS) + NODES + "," + brand_centrality(), "SELECT graph_id, node, round(centrality, 6) AS centrality FROM central"))
oracle("brand_topk_polytree", w(net(BRANDS) + GREEDY_ROOT + TOPK, "SELECT * FROM topk"))
