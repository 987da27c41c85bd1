"""R1 league weekly report query and its oracle (a UNION ALL of the parts)."""

from __future__ import annotations

from squadron.oracle_views import with_views
from squadron.plans import reports
from squadron.plans.registry import register
from squadron.plans.stats_queries import (ASP, JAMMY_BODY, MOST_BENCHED_BODY, MPOB_BODY, OUT,
                                          OUT_REP_BODY, ST)
from squadron.plans.transfer_queries import (CHIP_BODY, FALL_BODY, J1_CTES, J1_VIEWS, RISE_BODY,
                                             _leader_body, _most_body)
from squadron.plans.weekly import CAPTAIN_BODY
from squadron.sources.testdata import tables

DUCK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
              "array<bigint>": "BIGINT[]"}


def _long_sql(section: str, body: str, where: str = "", **cols) -> str:
    sel = []
    for name, typ in reports.LONG_SCHEMA:
        if name == "section":
            sel.append(f"'{section}' AS section")
        elif name in cols:
            sel.append(f"CAST({cols[name]} AS {DUCK_TYPES[typ]}) AS {name}")
        elif name in ("league_id", "gameweek"):
            sel.append(f"CAST({name} AS {DUCK_TYPES[typ]}) AS {name}")
        else:
            sel.append(f"CAST(NULL AS {DUCK_TYPES[typ]}) AS {name}")
    return f"SELECT {', '.join(sel)} FROM ({body}) {where}"


IN_WS = "WHERE EXISTS (SELECT 1 FROM ws w WHERE w.league_id = x.league_id AND w.gameweek = x.gameweek)"

R1_PARTS = [
    _long_sql("captain", CAPTAIN_BODY, player_id="captain", value="count"),
    _long_sql("chips", CHIP_BODY, label="active_chip", value="count"),
    _long_sql("exceptional", OUT_REP_BODY, "x WHERE exceptional_entry IS NOT NULL",
              entry_id="exceptional_entry", team_name="exceptional_team", value="exceptional_score"),
    _long_sql("abysmal", OUT_REP_BODY, "x WHERE abysmal_entry IS NOT NULL",
              entry_id="abysmal_entry", team_name="abysmal_team", value="abysmal_score"),
    _long_sql("league_average", OUT_REP_BODY, average="league_average"),
    _long_sql("rise", RISE_BODY, "x " + IN_WS, k="k", entry_id="entry_id", team_name="participant_name",
              value="current_rank", value2="prev_rank"),
    _long_sql("fall", FALL_BODY, "x " + IN_WS, k="k", entry_id="entry_id", team_name="participant_name",
              value="current_rank", value2="prev_rank"),
    _long_sql("most_transferred_out", _most_body("element_out"), k="k", player_id="player", value="count"),
    _long_sql("most_transferred_in", _most_body("element_in"), k="k", player_id="player", value="count"),
    _long_sql("best_transfer_in", _leader_body(True), k="k", entry_id="entry_id", team_name="team_name",
              player_id="player_in", value="points_delta", value2="player_out"),
    _long_sql("worst_transfer_in", _leader_body(False), k="k", entry_id="entry_id", team_name="team_name",
              player_id="player_in", value="points_delta", value2="player_out"),
    _long_sql("most_points_on_bench", MPOB_BODY, k="k", entry_id="entry_id", team_name="team_name",
              value="point_on_bench", detail="players"),
    _long_sql("jammy_points", JAMMY_BODY, k="k", entry_id="entry_id", team_name="team_name",
              value="points", detail="sub_in", detail2="sub_out"),
    _long_sql("most_benched", MOST_BENCHED_BODY, player_id="player_id", value="count", value2="points"),
    _long_sql("league_name", """SELECT g.league_id, g.gameweek, l.league_name
        FROM (SELECT DISTINCT league_id, gameweek FROM ws) g
        LEFT JOIN (SELECT DISTINCT league_id, league_name FROM league) l ON l.league_id = g.league_id""",
              label="league_name"),
]


@register("league_weekly_report", with_views(
    "\nUNION ALL\n".join(R1_PARTS), *J1_VIEWS, "standings", "auto_sub",
    extra=(*J1_CTES, ST, OUT, ASP)), "R1", list_cols=('detail', 'detail2'))
def q_league_weekly_report(spark, sf_dir):
    return reports.league_weekly_report(tables(spark, sf_dir))


VICE_BODY = """SELECT v.league_id, v.gameweek, v.vice_captain, v.count, coalesce(s.total_points * 2, 0) AS points
       FROM (SELECT w.league_id, w.gameweek, w.vice_captain, count(*) AS count
             FROM ws w LEFT JOIN score c ON c.player_id = w.captain AND c.gameweek = w.gameweek
             WHERE coalesce(c.minutes, 0) = 0 AND w.vice_captain IS NOT NULL GROUP BY ALL) v
       LEFT JOIN score s ON s.player_id = v.vice_captain AND s.gameweek = v.gameweek"""


def _documents_sql():
    parts = [*R1_PARTS, _long_sql("promoted_vice", VICE_BODY, player_id="vice_captain", value="count", value2="points")]
    def cases(of):
        return "CASE section " + " ".join(f"WHEN '{n}' THEN {of(n)}" for n in reports.DOCUMENT) + " END"

    first = cases(lambda n: f"{'-' if reports.DOCUMENT[n][1][0] != '-' else ''}{reports.DOCUMENT[n][1].lstrip('-')}")
    item = cases(lambda n: "CAST(to_json({" + ", ".join(f"'{f}': {c}" for f, c in reports.DOCUMENT[n][0])
                 + "}) AS VARCHAR)")
    sections = ", ".join(f"({i}, '{n}')" for i, n in enumerate(reports.DOCUMENT))
    rows = "\nUNION ALL\n".join(parts)
    return with_views(f"""SELECT g.league_id, g.gameweek, CAST(v.place AS INTEGER) AS place, v.section,
            coalesce(p.page, 0) AS page, CAST(coalesce(p.n, 0) AS INTEGER) AS n_items,
            '[' || coalesce(p.items, '') || ']' AS items
        FROM (SELECT league_id, gameweek FROM rep WHERE section = 'league_name') g
        CROSS JOIN (VALUES {sections}) v(place, section)
        LEFT JOIN (SELECT league_id, gameweek, section, CAST((nth - 1) // {reports.PAGE_ITEMS} AS INTEGER) AS page,
                          count(*) AS n, string_agg(item, ',' ORDER BY nth) AS items
                   FROM (SELECT *, {item} AS item, row_number() OVER (PARTITION BY league_id, gameweek, section
                           ORDER BY coalesce({first}, 0) DESC, coalesce(player_id, ascii(label), 0)) AS nth FROM rep)
                   GROUP BY ALL) p
          ON p.league_id = g.league_id AND p.gameweek = g.gameweek AND p.section = v.section""",
                      *J1_VIEWS, "standings", "auto_sub", extra=(*J1_CTES, ST, OUT, ASP, ("rep", rows)))


@register("league_report_documents", _documents_sql(), "R1 K5 A22")
def q_league_report_documents(spark, sf_dir):
    return reports.league_report_documents(tables(spark, sf_dir))
