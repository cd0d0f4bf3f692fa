"""The registered queries as SQL for DuckDB, written independently of the plans."""

from __future__ import annotations

ACTIVITY = (
    "SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS property, props AS value, ts FROM events"
)
PURCHASES = (
    "SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderstatus AS property, o_orderdate AS ts FROM orders"
)
PRIORITIES = (
    "SELECT o_orderpriority AS entity, CAST(o_custkey AS VARCHAR) AS property, o_orderdate AS ts FROM orders"
)
SHIPMENTS = (
    "SELECT CAST(l_suppkey AS VARCHAR) AS entity, l_returnflag AS property, l_shipdate AS ts FROM lineitem"
)
BOTH = "entity || '||||' || property"
DAY = 86_400_000_000


def zeroless(expression: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 ELSE round({expression}, {digits}) END"


def grid(log: str, name: str, count: str, window: str, having: str = "true", where: str = "true") -> str:
    """CTEs ``names`` (surviving groups) and ``series`` (name, i, value) with all windows.

    ``window`` numbers the window of a row; rows outside the grid do not count.
    """
    return f"""
      log AS ({log}),
      names AS (SELECT {name} AS name FROM log GROUP BY ALL HAVING {having}),
      counted AS (
        SELECT {name} AS name, {window} AS i, count(*) AS n FROM log WHERE {where} GROUP BY ALL),
      series AS (
        SELECT names.name, CAST(g.i AS INTEGER) AS i, CAST(coalesce(c.n, 0) AS DOUBLE) AS value
        FROM names CROSS JOIN (SELECT unnest(range({count})) AS i) AS g
        LEFT JOIN counted AS c ON c.name = names.name AND c.i = g.i)"""


def fixed(start: str, width: int) -> str:
    """Window number for a fixed width in microseconds, early changes in window 0."""
    return f"greatest(0, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{start}')) / {width}) AS BIGINT))"


def by_edges(start: str, end: str, unit: str) -> str:
    """CTE ``edges`` stepped one from the other."""
    return f"""
      edges AS (
        SELECT 0 AS i, TIMESTAMP '{start}' AS edge
        UNION ALL
        SELECT i + 1, edge + INTERVAL {unit} FROM edges WHERE edge < TIMESTAMP '{end}')"""


EDGE_WINDOW = "(SELECT greatest(0, max(edges.i)) FROM edges WHERE edges.edge <= log.ts OR edges.i = 0)"

DAILY = grid(ACTIVITY, "entity", "30", fixed("2024-01-01", DAY), "count(*) > 50")
SIXTY = grid(PURCHASES, "entity", "43", fixed("1995-01-01", 60 * DAY))
ALL_COLUMNS = "SELECT name, i, value FROM series"


def of_lists(prefix: str, expression: str, rounding: bool = True, where: str = "true", source: str = "value") -> str:
    """Per-series list expression over ``y``, unfolded again."""
    value = zeroless("v") if rounding else "v"
    return f"""
      WITH {prefix},
      lists AS (SELECT name, list({source} ORDER BY i) AS y FROM series GROUP BY name),
      changed AS (SELECT name, {expression} AS z FROM lists WHERE {where}),
      unfolded AS (SELECT name, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS i FROM changed)
      SELECT name, CAST(i AS INTEGER) AS i, CAST({value} AS DOUBLE) AS value FROM unfolded"""


def z_scores(y: str) -> str:
    return (
        f"list_transform({y}, lambda x: (x - list_avg({y})) / "
        f"sqrt(list_sum(list_transform({y}, lambda u: (u - list_avg({y})) * (u - list_avg({y})))) / len({y})))"
    )


FIRST_POSITIVE = "list_position(list_transform(y, lambda x: x > 0), true)"
SHIFTED = f"""CASE WHEN {FIRST_POSITIVE} IS NULL THEN y
  ELSE list_concat(y[{FIRST_POSITIVE}:], list_resize([]::DOUBLE[], {FIRST_POSITIVE} - 1, 0.0)) END"""


def warping(size_center: int, size_series: int, nth: str = "") -> str:
    """CTE ``dp`` over ``pairs`` (id, c, x): costs along anti-diagonal t, one list per t.

    ``nth`` is put after all CTE names, for queries with several rounds.

    Position i of ``cur`` belongs to center point i (1-based); cells outside the
    table are infinite.
    """
    infinite = "CAST('inf' AS DOUBLE)"
    return f"""
      dp{nth} AS (
        SELECT id, c, x, 0 AS t,
               list_transform(range(1, {size_center + 1}),
                 lambda i: CASE WHEN i = 1 THEN (c[1] - x[1]) * (c[1] - x[1]) ELSE {infinite} END) AS cur,
               list_transform(range(1, {size_center + 1}), lambda i: {infinite}) AS prev
        FROM pairs{nth}
        UNION ALL
        SELECT id, c, x, t + 1,
               list_transform(range(1, {size_center + 1}),
                 lambda i: CASE WHEN t + 3 - i BETWEEN 1 AND {size_series}
                   THEN (c[i] - x[t + 3 - i]) * (c[i] - x[t + 3 - i])
                        + least(cur[i], coalesce(cur[i - 1], {infinite}), coalesce(prev[i - 1], {infinite}))
                   ELSE {infinite} END),
               cur
        FROM dp{nth} WHERE t < {size_center + size_series - 2})"""


def warping_paths(size_center: int, size_series: int, nth: str = "") -> str:
    """CTE ``path`` (id, i, j): cells of the best path of ``aligned`` pairs, 1-based.

    A tie goes up (i - 1) first, then left (j - 1), then diagonal.
    """
    infinite = "CAST('inf' AS DOUBLE)"
    return f"""
      costs_at{nth} AS MATERIALIZED (SELECT id, t, cur, prev FROM dp{nth}),
      path{nth} AS (
        SELECT id, {size_center} AS i, {size_series} AS j FROM aligned{nth}
        UNION ALL
        SELECT id,
               CASE WHEN up <= least(lft, diag) OR lft > diag THEN i - 1 ELSE i END,
               CASE WHEN up <= least(lft, diag) THEN j ELSE j - 1 END
        FROM (
          SELECT p.id, p.i, p.j,
                 coalesce(a.cur[p.i - 1], {infinite}) AS up,
                 coalesce(a.cur[p.i], {infinite}) AS lft,
                 coalesce(a.prev[p.i - 1], {infinite}) AS diag
          FROM path{nth} AS p JOIN costs_at{nth} AS a ON a.id = p.id AND a.t = p.i + p.j - 3
          WHERE p.i > 1 OR p.j > 1))"""


# Daily series as lists, and the first three of them by name as centers of round 0.
DAILY_LISTS = f"""{DAILY},
      lists AS (SELECT name, list(value ORDER BY i) AS y FROM series GROUP BY name),
      centers0 AS (
        SELECT row_number() OVER (ORDER BY name) - 1 AS cluster, y AS c
        FROM (SELECT * FROM lists ORDER BY name LIMIT 3))"""


def assignment(nth: int) -> str:
    """CTE ``aligned<n>`` (id, name, cluster): nearest of ``centers<n>`` for each list."""
    return f"""
      pairs{nth} AS (
        SELECT name || '/' || cluster AS id, name, cluster, c, y AS x FROM lists CROSS JOIN centers{nth}),
      {warping(30, 30, str(nth))},
      aligned{nth} AS (
        SELECT p.id, p.name, p.cluster FROM dp{nth} AS d JOIN pairs{nth} AS p ON p.id = d.id WHERE d.t = 58
        QUALIFY row_number() OVER (PARTITION BY p.name ORDER BY d.cur[30], p.cluster) = 1)"""


def update(nth: int) -> str:
    """CTE ``centers<n+1>``: mean of the values warped to each position of ``centers<n>``."""
    return f"""
      {warping_paths(30, 30, str(nth))},
      means{nth} AS (
        SELECT p.cluster, path.i, sum(p.x[path.j]) / count(*) AS value
        FROM path{nth} AS path JOIN pairs{nth} AS p ON p.id = path.id GROUP BY ALL),
      centers{nth + 1} AS (
        SELECT c.cluster, list(coalesce(m.value, c.c[g.i]) ORDER BY g.i) AS c
        FROM centers{nth} AS c CROSS JOIN (SELECT unnest(range(1, 31)) AS i) AS g
        LEFT JOIN means{nth} AS m ON m.cluster = c.cluster AND m.i = g.i GROUP BY c.cluster)"""


def drawn(count: int) -> str:
    """CTE ``centers0``: the first of ``lists`` by an md5 of seed and name."""
    return f"""
      centers0 AS (
        SELECT row_number() OVER (ORDER BY md5('13:' || name), name) - 1 AS cluster, y AS c
        FROM lists QUALIFY cluster < {count})"""


def fitted(updates: int) -> str:
    """CTE ``fitted`` (name, cluster): rounds from ``centers0`` on until no list has moved, or after ``updates`` updates.

    All rounds are computed; the first whose assignment equals the one before ends the fit.
    """
    steps = [f"{assignment(t)}, {update(t)}" for t in range(updates)] + [assignment(updates)]
    chain = ",".join(steps)
    for t in range(updates + 1):
        for name in (f"aligned{t}", f"centers{t}", f"means{t}", f"pairs{t}"):
            chain = chain.replace(f" {name} AS (", f" {name} AS MATERIALIZED (")
    still = " UNION ALL ".join(
        f"SELECT {t} AS t, count(*) FILTER (a.cluster <> b.cluster) AS moved FROM aligned{t - 1} AS a JOIN aligned{t} AS b USING (name)"
        for t in range(1, updates + 1)
    )
    every = " UNION ALL ".join(f"SELECT {t} AS t, name, cluster FROM aligned{t}" for t in range(updates + 1))
    return f"""{chain},
      still AS ({still}),
      fitted AS (
        SELECT name, cluster FROM ({every})
        WHERE t = (SELECT coalesce(min(t) FILTER (moved = 0), {updates}) FROM still))"""


VECTORS = "SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings"

COMPLETE = f"""
      WITH log AS ({PRIORITIES}),
      cells AS (SELECT entity, property, count(*) AS n FROM log GROUP BY ALL),
      best AS (
        SELECT property, sum(n) AS total FROM cells GROUP BY property
        HAVING count(*) = 5 ORDER BY total DESC, property LIMIT 10)"""

FOUR = "('click', 'error', 'purchase', 'signup')"

RATES = """
      cells AS (
        SELECT entity, property, count(*) AS n,
               CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS life
        FROM log GROUP BY ALL)"""

LOG_SERIES = "ln(value + 1)"

ORACLES: dict[str, str] = {
    "change_log_from_events": """
      SELECT CAST(user_id AS VARCHAR) AS entity,
             coalesce(nullif(event_type, 'error'), 'null') AS property,
             coalesce(props, 'null') AS value, ts FROM events""",
    "timestamp_parse_forms": """
      SELECT CAST(o_orderkey AS VARCHAR) AS entity, o_orderstatus AS property, 'x' AS value,
             CASE o_orderstatus
               WHEN 'F' THEN date_trunc('day', o_orderdate) + INTERVAL 1 SECOND
               WHEN 'O' THEN date_trunc('second', o_orderdate)
               ELSE date_trunc('second', o_orderdate) + INTERVAL 500 MILLISECOND END AS ts
      FROM orders""",
    "individual_filter": f"""
      WITH log AS ({ACTIVITY})
      SELECT property AS name, count(*) AS n FROM log WHERE property IN ('click', 'view') GROUP BY ALL""",
    "group_counts_min50": f"""
      WITH log AS ({ACTIVITY})
      SELECT entity AS name, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts
      FROM log GROUP BY entity HAVING count(*) > 50""",
    "distinct_entities": "SELECT count(DISTINCT user_id) AS entities FROM events",
    "time_bounds": f"""
      WITH log AS ({ACTIVITY})
      SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM log
      WHERE entity IN (SELECT entity FROM log GROUP BY entity HAVING count(*) > 50)""",
    "run_metrics": f"""
      WITH log AS ({ACTIVITY}),
      groups AS (SELECT entity, property, count(*) AS n, min(ts) AS a, max(ts) AS b FROM log GROUP BY ALL)
      SELECT CAST(sum(n) AS BIGINT) AS changes, (SELECT count(DISTINCT entity) FROM log) AS entities,
             count(*) AS groups, count(*) FILTER (n > 12) AS kept_groups,
             CAST(coalesce(sum(n) FILTER (n > 12), 0) AS BIGINT) AS kept_changes,
             min(a) FILTER (n > 12) AS min_ts, max(b) FILTER (n > 12) AS max_ts FROM groups""",
    "daily_series": f"WITH {DAILY} {ALL_COLUMNS}",
    "hourly_series": f"""
      WITH {grid(ACTIVITY, "property", "720", fixed("2024-01-01", DAY // 24))} {ALL_COLUMNS}""",
    "series_clamp_before_start": f"""
      WITH {grid(ACTIVITY, BOTH, "11", fixed("2024-01-10", 2 * DAY))} {ALL_COLUMNS}""",
    "series_drop_outside": f"""
      WITH {grid(ACTIVITY, "entity", "4", fixed("2024-01-10", 3 * DAY), where="ts >= TIMESTAMP '2024-01-10'")}
      {ALL_COLUMNS}""",
    "monthly_series": f"""
      WITH {grid(SHIPMENTS, "entity", "83", "(year(ts) - 1995) * 12 + month(ts) - 1")} {ALL_COLUMNS}""",
    "month_end_series": f"""
      WITH RECURSIVE {by_edges("1996-01-31", "2001-12-01", "2 MONTH")},
      {grid(SHIPMENTS, "property", "(SELECT max(i) FROM edges)", EDGE_WINDOW)} {ALL_COLUMNS}""",
    "yearly_series": f"""
      WITH RECURSIVE {by_edges("1996-02-29", "2001-12-01", "1 YEAR")},
      {grid(SHIPMENTS, "property", "(SELECT max(i) FROM edges)", EDGE_WINDOW)} {ALL_COLUMNS}""",
    "query_keys_series": f"""
      WITH {grid("SELECT o_orderstatus AS entity, o_orderpriority AS property, o_orderdate AS ts FROM orders",
                 BOTH, "361", fixed("1995-01-01", 7 * DAY))} {ALL_COLUMNS}""",
    "derived_bounds_series": f"""
      WITH log AS ({PURCHASES}),
      busy AS (SELECT entity, min(ts) AS a, max(ts) AS b FROM log GROUP BY entity HAVING count(*) > 9),
      bounds AS (SELECT min(a) AS a, epoch_us(max(b)) - epoch_us(min(a)) AS span FROM busy),
      counted AS (
        SELECT entity, (epoch_us(ts) - epoch_us(bounds.a)) // {60 * DAY} AS i, count(*) AS n
        FROM log, bounds WHERE entity IN (SELECT entity FROM busy) GROUP BY ALL),
      cells AS (SELECT entity, unnest(range(span // {60 * DAY} + 1)) AS i FROM busy, bounds)
      SELECT cells.entity AS name, CAST(cells.i AS INTEGER) AS i, CAST(coalesce(n, 0) AS DOUBLE) AS value
      FROM cells LEFT JOIN counted USING (entity, i)""",
    "series_normalize": of_lists(DAILY, z_scores("y")),
    "series_log": of_lists(DAILY, "list_transform(y, lambda x: ln(x + 1))"),
    "series_sqrt": of_lists(DAILY, "list_transform(y, lambda x: sqrt(x))"),
    "series_log_normalize": of_lists(DAILY, z_scores("y"), source=LOG_SERIES),
    "series_remove_leading_zero": of_lists(SIXTY, SHIFTED, rounding=False),
    "series_cutoff": of_lists(SIXTY, "y[1:18]", rounding=False),
    "series_rlz_cutoff_normalize": f"""
      WITH {SIXTY},
      lists AS (SELECT name, list(value ORDER BY i) AS y FROM series GROUP BY name),
      cut AS (SELECT name, ({SHIFTED})[1:18] AS y FROM lists),
      changed AS (SELECT name, {z_scores("y")} AS z FROM cut WHERE list_max(y) <> list_min(y)),
      unfolded AS (SELECT name, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS i FROM changed)
      SELECT name, CAST(i AS INTEGER) AS i, {zeroless("v")} AS value FROM unfolded""",
    "series_filter": of_lists(DAILY, "list_transform(y, lambda x: sqrt(x))", where="list_max(y) >= 6"),
    "features_statistics": of_lists(
        DAILY, "[list_min(y), list_max(y), list_sum(y), CAST(len(y) AS DOUBLE)]", rounding=False
    ),
    "features_raw": f"WITH {DAILY} {ALL_COLUMNS}",
    "entity_property_counts": f"""
      WITH log AS ({ACTIVITY})
      SELECT entity, property, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts FROM log GROUP BY ALL""",
    "property_counts": f"""
      WITH log AS ({ACTIVITY})
      SELECT property, count(*) AS n FROM log WHERE property IN {FOUR} GROUP BY ALL""",
    "entity_counts": f"""
      WITH log AS ({ACTIVITY})
      SELECT entity, count(*) AS n FROM log WHERE property IN {FOUR} GROUP BY ALL""",
    "total_count": f"WITH log AS ({ACTIVITY}) SELECT count(*) AS n FROM log WHERE property IN {FOUR}",
    "property_lifespan": f"""
      WITH log AS ({ACTIVITY}), {RATES} SELECT entity, property, life AS lifespan FROM cells""",
    "complete_property_matrix_top10": f"{COMPLETE} SELECT entity, property, n FROM cells WHERE property IN (SELECT property FROM best)",
    "complete_matrix_wide": f"""{COMPLETE}
      SELECT entity AS "Settlement", property, n FROM cells WHERE property IN (SELECT property FROM best)""",
    "count_matrix": f"""
      WITH log AS ({SHIPMENTS})
      SELECT entity AS "Settlement", nullif(count(*) FILTER (property = 'A'), 0) AS "A",
             nullif(count(*) FILTER (property = 'N'), 0) AS "N",
             nullif(count(*) FILTER (property = 'R'), 0) AS "R" FROM log GROUP BY entity""",
    "property_share_matrix": f"""
      WITH log AS ({ACTIVITY}),
      cells AS (SELECT entity, property, count(*) AS n FROM log WHERE property IN {FOUR} GROUP BY ALL),
      shares AS (SELECT entity, property, n / sum(n) OVER (PARTITION BY property) AS share FROM cells)
      SELECT entity AS "Settlement",
             round(coalesce(max(share) FILTER (property = 'click'), 0.0), 9) AS click,
             round(coalesce(max(share) FILTER (property = 'error'), 0.0), 9) AS error,
             round(coalesce(max(share) FILTER (property = 'purchase'), 0.0), 9) AS purchase,
             round(coalesce(max(share) FILTER (property = 'signup'), 0.0), 9) AS signup
      FROM shares GROUP BY entity""",
    "lifespan_rate_matrix": f"""
      WITH log AS ({SHIPMENTS}), {RATES}
      SELECT entity AS "Settlement",
             round(coalesce(max(n / life) FILTER (property = 'A'), 0.0) * 1e6, 6) AS "A",
             round(coalesce(max(n / life) FILTER (property = 'N'), 0.0) * 1e6, 6) AS "N",
             round(coalesce(max(n / life) FILTER (property = 'R'), 0.0) * 1e6, 6) AS "R"
      FROM cells GROUP BY entity""",
    "lifespan_rate_cells": f"""
      WITH log AS ({PURCHASES}), {RATES}
      SELECT entity, property, life = 0 AS instant,
             CASE WHEN life <> 0 THEN round(n / life * 1e6, 6) END AS rate FROM cells""",
    "ground_truth_join": """
      WITH cells AS (
        SELECT c_custkey, upper(c_name) AS name, c_mktsegment AS "trueCluster", unnest(range(7)) AS i
        FROM customer
        WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
          AND c_custkey IN (SELECT o_custkey FROM orders)),
      counted AS (
        SELECT o_custkey AS c_custkey, year(o_orderdate) - 1995 AS i, count(*) AS n FROM orders GROUP BY ALL)
      SELECT name, "trueCluster", CAST(i AS INTEGER) AS i, CAST(coalesce(n, 0) AS DOUBLE) AS value
      FROM cells LEFT JOIN counted USING (c_custkey, i)""",
    "kmeans_two_scales": f"""
      WITH {grid("SELECT CAST(user_id AS VARCHAR) AS entity, ts FROM events UNION ALL SELECT event_type, ts FROM events",
                 "entity", "10", fixed("2024-01-01", 3 * DAY))}
      SELECT name, i, round(avg(value) OVER (PARTITION BY i, name IN (SELECT event_type FROM events)), 6) AS value
      FROM series""",
    "dtw_pairs": f"""
      WITH RECURSIVE {grid(ACTIVITY, BOTH, "10", fixed("2024-01-01", 3 * DAY))},
      lists AS (
        SELECT string_split(name, '||||')[1] AS entity, string_split(name, '||||')[2] AS property,
               list(value ORDER BY i) AS y FROM series GROUP BY name),
      pairs AS (
        SELECT a.entity AS id, a.y AS c, b.y AS x FROM lists AS a JOIN lists AS b USING (entity)
        WHERE a.property = 'click' AND b.property = 'purchase'),
      {warping(10, 10)}
      SELECT id AS entity, cur[10] AS distance FROM dp WHERE t = 18""",
    "dtw_nearest_center": f"""
      WITH RECURSIVE vectors AS ({VECTORS}),
      centers AS (
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, x AS c
        FROM (SELECT * FROM vectors ORDER BY vec_id LIMIT 4)),
      pairs AS (SELECT vec_id * 4 + cluster AS id, vec_id, cluster, c, x FROM vectors CROSS JOIN centers),
      {warping(64, 64)}
      SELECT p.vec_id, CAST(p.cluster AS INTEGER) AS "assignedCluster", {zeroless("d.cur[64]")} AS cost
      FROM dp AS d JOIN pairs AS p ON p.id = d.id WHERE d.t = 126
      QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY d.cur[64], p.cluster) = 1""",
    "dba_update": f"""
      WITH RECURSIVE {DAILY_LISTS}, {assignment(0)}, {update(0)}
      SELECT CAST(cluster AS INTEGER) AS cluster, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS "index",
             round(unnest(c), 6) AS value
      FROM centers1""",
    "dba_two_updates": f"""
      WITH RECURSIVE {DAILY_LISTS}, {assignment(0)}, {update(0)}, {assignment(1)}, {update(1)},
      moved AS (
        SELECT count(*) FILTER (a.cluster <> b.cluster) AS n FROM aligned0 AS a JOIN aligned1 AS b USING (name)),
      centers3 AS (
        SELECT * FROM centers2 WHERE (SELECT n FROM moved) > 0
        UNION ALL SELECT * FROM centers1 WHERE (SELECT n FROM moved) = 0),
      {assignment(3)}
      SELECT name, CAST(cluster AS INTEGER) AS "assignedCluster" FROM aligned3""",
    "barycenter_update": f"""
      WITH RECURSIVE vectors AS ({VECTORS}),
      pairs AS (
        SELECT v.vec_id AS id, c.x AS c, v.x AS x
        FROM vectors AS v CROSS JOIN (SELECT x FROM vectors ORDER BY vec_id LIMIT 1) AS c),
      {warping(64, 64)},
      aligned AS (SELECT id FROM pairs),
      {warping_paths(64, 64)}
      SELECT CAST(path.i - 1 AS INTEGER) AS i, {zeroless("sum(p.x[path.j]) / count(*)")} AS value
      FROM path JOIN pairs AS p ON p.id = path.id GROUP BY path.i""",
    "dba_assignment_changes": f"""
      WITH RECURSIVE {DAILY_LISTS}, {assignment(0)}, {update(0)}, {assignment(1)}
      SELECT count(*) FILTER (a.cluster <> b.cluster) AS moved
      FROM aligned0 AS a JOIN aligned1 AS b USING (name)""",
    "members_lines": f"""
      WITH RECURSIVE {DAILY_LISTS}, {assignment(0)}, {update(0)}, {assignment(1)}
      SELECT '"' || name || '","' || cluster || '",' || string_agg(CAST(value AS VARCHAR), ',' ORDER BY i) AS value
      FROM series JOIN aligned1 USING (name) GROUP BY name, cluster""",
    "dba_drawn_centers": f"""
      WITH {DAILY},
      drawn AS (SELECT name, row_number() OVER (ORDER BY md5('13:' || name), name) - 1 AS cluster FROM (SELECT DISTINCT name FROM series))
      SELECT CAST(i AS INTEGER) AS "index", value, CAST(cluster AS INTEGER) AS cluster
      FROM series JOIN drawn USING (name) WHERE cluster < 5""",
    "missing_times_dropped": """
      WITH kept AS (SELECT event_type AS name, CAST(ts AS DATE) - DATE '2024-01-01' AS i, count(*) AS n
                    FROM events WHERE event_type <> 'error' GROUP BY ALL),
      cells AS (SELECT DISTINCT name, unnest(range(30)) AS i FROM kept)
      SELECT name, CAST(i AS INTEGER) AS i, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM cells LEFT JOIN kept USING (name, i)""",
    "centers_lines": f"""
      WITH RECURSIVE {DAILY_LISTS}, {assignment(0)}, {update(0)}
      SELECT CAST(cluster AS INTEGER) AS line, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS i, round(unnest(c), 6) AS value
      FROM centers1""",
    "dba_kmeans_members": f"""
      WITH RECURSIVE {DAILY},
      lists AS (SELECT name, list(value ORDER BY i) AS y FROM series GROUP BY name),
      {drawn(5)}, {fitted(10)}
      SELECT name, CAST(cluster AS INTEGER) AS "assignedCluster" FROM fitted""",
    "csv_round_trip": ACTIVITY,
    "label_csv": """
      SELECT c_name AS entity, c_mktsegment AS template FROM customer
      WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""",
    "matrix_csv": f"""
      WITH log AS ({SHIPMENTS})
      SELECT entity AS "Settlement", CAST(count(*) FILTER (property = 'A') AS VARCHAR) AS "A",
             CAST(count(*) FILTER (property = 'N') AS VARCHAR) AS "N",
             CAST(count(*) FILTER (property = 'R') AS VARCHAR) AS "R" FROM log GROUP BY entity""",
    "wide_matrix_csv": f"""
      WITH log AS ({ACTIVITY}),
      cells AS (SELECT property AS entity, entity AS name, count(*) AS n FROM log GROUP BY ALL),
      names AS (SELECT DISTINCT name FROM cells), entities AS (SELECT DISTINCT entity FROM cells)
      SELECT 'Settlement,' || string_agg(name, ',' ORDER BY name) AS value FROM names
      UNION ALL
      SELECT entity || ',' || string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY name)
      FROM entities CROSS JOIN names LEFT JOIN cells USING (entity, name) GROUP BY entity""",
    "clustered_series": f"""
      WITH RECURSIVE {grid(ACTIVITY + " WHERE event_type <> 'error'", "entity", "30", fixed("2024-01-01", DAY), "count(*) > 50")},
      logs AS (SELECT name, list(ln(value + 1) ORDER BY i) AS y FROM series GROUP BY name),
      changed AS (SELECT name, {z_scores("y")} AS z FROM logs),
      lists AS (SELECT name, z AS y FROM changed WHERE z[1] < 2.5),
      {drawn(3)}, {fitted(2)},
      unfolded AS (SELECT name, cluster, unnest(y) AS v, generate_subscripts(y, 1) - 1 AS i FROM lists JOIN fitted USING (name))
      SELECT name, CAST(cluster AS INTEGER) AS "assignedCluster", CAST(i AS INTEGER) AS i, {zeroless("v")} AS value FROM unfolded""",
    "spec_features_derived_bounds": f"""
      WITH log AS ({ACTIVITY}),
      bounds AS (SELECT min(ts) AS a, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM log),
      counted AS (
        SELECT {BOTH} AS name, (epoch_us(ts) - epoch_us(a)) // {DAY} AS i, count(*) AS n
        FROM log, bounds GROUP BY ALL),
      figures AS (
        SELECT name, [CAST(CASE WHEN count(*) < any_value(span) // {DAY} + 1 THEN 0 ELSE min(n) END AS DOUBLE),
                      CAST(max(n) AS DOUBLE), CAST(sum(n) AS DOUBLE),
                      CAST(any_value(span) // {DAY} + 1 AS DOUBLE)] AS f
        FROM counted, bounds GROUP BY name)
      SELECT name, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS i, unnest(f) AS value FROM figures""",
}
