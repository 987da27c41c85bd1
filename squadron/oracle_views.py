"""DuckDB definitions of the domain views (the oracle side).

These mirror ``squadron.sources.testdata`` rule for rule; every oracle query
is ``WITH <needed views> <body>``.  Fixed values as in the Spark views: base
date 1995-01-01, 64 days per gameweek, 38 gameweeks, 20 teams, fixture code
base 2444470, bench flag 'R', auto-sub line number 7.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ord": ("""SELECT *, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 64) + 1 AS INTEGER) AS gw
        FROM orders""", ()),
    "league": ("""SELECT n.n_regionkey AS league_id, r.r_name AS league_name, c.c_custkey AS entry,
               c.c_name AS entry_name, c.c_name AS player_name
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey""", ()),
    "line_ord": ("""SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, l.l_returnflag,
               o.o_custkey, o.gw
        FROM lineitem l JOIN ord o ON l.l_orderkey = o.o_orderkey""", ("ord",)),
    "pick0": ("""SELECT o_custkey AS entry_id, gw, l_partkey AS player_id,
               min(l_linenumber) AS ln, min(l_returnflag) AS flag
        FROM line_ord GROUP BY o_custkey, gw, l_partkey""", ("line_ord",)),
    "pick": ("""SELECT entry_id, gw, player_id, position,
               CAST(CASE WHEN flag = 'R' THEN 0 WHEN position = 1 THEN 2 ELSE 1 END AS INTEGER) AS multiplier,
               (flag <> 'R' AND position = 1) AS is_captain,
               (flag <> 'R' AND position = 2) AS is_vice_captain
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entry_id, gw
                 ORDER BY CASE WHEN flag = 'R' THEN 1 ELSE 0 END, ln, player_id) AS INTEGER) AS position
              FROM pick0)""", ("pick0",)),
    "auto_sub": ("""SELECT entry_id, gw, player_id, CASE WHEN flag = 'R' THEN 'out' ELSE 'in' END AS direction
        FROM pick0 WHERE ln = 7""", ("pick0",)),
    "score": ("""SELECT player_id, gameweek, total_points, minutes, goals_scored, assists,
               CAST(CAST(_xg AS DECIMAL(8,2)) / 100 AS DECIMAL(8,2)) AS expected_goals,
               CAST(CAST(_xa AS DECIMAL(8,2)) / 100 AS DECIMAL(8,2)) AS expected_assists,
               CAST(CAST(_xgc AS DECIMAL(8,2)) / 100 AS DECIMAL(8,2)) AS expected_goals_conceded,
               CAST(CAST(_inf AS DECIMAL(8,1)) / 10 AS DECIMAL(8,1)) AS influence,
               CAST(CAST(_cre AS DECIMAL(8,1)) / 10 AS DECIMAL(8,1)) AS creativity,
               CAST(CAST(_thr AS DECIMAL(8,1)) / 10 AS DECIMAL(8,1)) AS threat,
               total_points >= 14 AS in_dreamteam
        FROM (SELECT l_partkey AS player_id, gw AS gameweek,
                     CAST(CAST(sum(l_quantity) AS BIGINT) % 20 - 3 AS INTEGER) AS total_points,
                     CAST(CASE WHEN sum(l_linenumber) % 4 = 0 THEN 0 ELSE 90 END AS INTEGER) AS minutes,
                     CAST(count(*) AS INTEGER) AS goals_scored,
                     CAST(sum(l_linenumber) % 3 AS INTEGER) AS assists,
                     (count(*) * 37) % 100 AS _xg,
                     (sum(l_linenumber) * 13) % 100 AS _xa,
                     (CAST(sum(l_quantity) AS BIGINT) * 7) % 300 AS _xgc,
                     (sum(l_linenumber) * 31) % 1000 AS _inf,
                     (CAST(sum(l_quantity) AS BIGINT) * 3) % 1000 AS _cre,
                     (count(*) * 53) % 1000 AS _thr
              FROM line_ord GROUP BY l_partkey, gw)""", ("line_ord",)),
    "entry": ("""SELECT o_custkey AS entry_id, gw,
               CASE min(o_orderpriority) WHEN '1-URGENT' THEN 'wildcard' WHEN '2-HIGH' THEN 'freehit' END AS active_chip,
               CAST(CASE WHEN min(o_orderkey) % 97 = 0 THEN -120 WHEN min(o_orderkey) % 101 = 0 THEN 260
                         ELSE floor(max(o_totalprice) / 5000) END AS INTEGER) AS total_points,
               CAST(floor(min(o_totalprice) / 20000) AS INTEGER) AS points_on_bench,
               CAST(4 * (count(*) - 1) AS INTEGER) AS event_transfers_cost
        FROM ord GROUP BY o_custkey, gw""", ("ord",)),
    "standings": ("""SELECT league_id, entry, gw, event_total, total, rank,
               CAST(lag(rank) OVER (PARTITION BY league_id, entry ORDER BY gw) AS INTEGER) AS last_rank,
               entry_name, player_name
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY league_id, gw ORDER BY total DESC, entry) AS INTEGER) AS rank
              FROM (SELECT m.league_id, m.entry, m.entry_name, m.player_name, w.gw,
                           coalesce(e.total_points, 0) AS event_total,
                           CAST(sum(coalesce(e.total_points, 0)) OVER (PARTITION BY m.league_id, m.entry ORDER BY w.gw
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total
                    FROM league m CROSS JOIN (SELECT CAST(range AS INTEGER) AS gw FROM range(1, 39)) w
                    LEFT JOIN entry e ON e.entry_id = m.entry AND e.gw = w.gw))""", ("league", "entry")),
    "transfer": ("""SELECT event_id AS transfer_id, user_id AS entry, CAST(day(ts) AS INTEGER) AS event, ts AS time,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS element_in, event_id % 100 AS element_out
        FROM events""", ()),
    "player": ("""SELECT p_partkey AS player_id, h.half, p_name AS player_name, p_type AS position,
               CASE WHEN h.half = 2 AND p_partkey % 10 = 0 THEN 'Brand#1' ELSE p_brand END AS team
        FROM part CROSS JOIN (VALUES (1), (2)) h(half)""", ()),
    "fixture": ("""SELECT o_orderkey + 2444470 AS code, gw AS gameweek,
               CAST(o_custkey % 20 + 1 AS INTEGER) AS home,
               CAST((o_custkey + 1 + o_orderkey % 19) % 20 + 1 AS INTEGER) AS away,
               CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 5 END AS homegoals,
               CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(floor(o_totalprice / 10) AS BIGINT) % 5 END AS awaygoals,
               CAST(o_custkey % 4 + 2 AS INTEGER) AS homedifficulty,
               CAST(o_orderkey % 4 + 2 AS INTEGER) AS awaydifficulty,
               o_orderstatus = 'F' AS finished, o_orderdate AS date
        FROM ord""", ("ord",)),
    "team": ("""SELECT CAST(range AS INTEGER) AS id, 'TEAM_' || CAST(range AS VARCHAR) AS name
        FROM range(1, 21)""", ()),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in VIEWS[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """``WITH`` the named views (and their dependencies), then ``extra``
    CTEs (name, sql) in order, then ``body``."""
    ctes = [f"{n} AS ({VIEWS[n][0]})" for n in _order(names)]
    ctes += [f"{n} AS ({sql})" for n, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body
