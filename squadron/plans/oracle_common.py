"""Oracle CTEs shared by several queries (DuckDB)."""

# per (entry, week): starters, captain / vice and their points
WS_SQ = ("ws_sq", """SELECT p.entry_id, p.gw,
       CAST(count(CASE WHEN p.multiplier > 0 THEN 1 END) AS INTEGER) AS n_players,
       max(CASE WHEN p.is_captain THEN p.player_id END) AS captain,
       max(CASE WHEN p.is_vice_captain THEN p.player_id END) AS vice_captain,
       CAST(coalesce(max(CASE WHEN p.is_captain THEN coalesce(s.total_points, 0) * 2 END), 0) AS INTEGER) AS captain_points,
       CAST(coalesce(max(CASE WHEN p.is_vice_captain THEN coalesce(s.total_points, 0) END), 0) AS INTEGER) AS vice_captain_points,
       CAST(count(CASE WHEN p.multiplier > 0 AND s.player_id IS NULL THEN 1 END) AS INTEGER) AS missing_players
  FROM pick p LEFT JOIN score s ON s.player_id = p.player_id AND s.gameweek = p.gw
  GROUP BY p.entry_id, p.gw""")

# the league-week frame (o_df) with W1 rank
WS = ("ws", """SELECT m.league_id, e.gw AS gameweek, e.entry_id, e.active_chip, e.total_points,
       e.points_on_bench, e.event_transfers_cost, q.n_players, q.captain, q.vice_captain,
       q.captain_points, q.vice_captain_points, q.missing_players,
       CAST(row_number() OVER (PARTITION BY m.league_id, e.gw ORDER BY e.total_points DESC, e.entry_id) AS INTEGER) AS rank
  FROM entry e JOIN ws_sq q ON q.entry_id = e.entry_id AND q.gw = e.gw AND q.n_players > 0
  JOIN league m ON m.entry = e.entry_id""")

WS_VIEWS = ("pick", "score", "entry", "league")
WS_CTES = (WS_SQ, WS)
