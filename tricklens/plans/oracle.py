"""DuckDB SQL for every registered query: the correctness oracle.

Written independently of the Spark plans: every count is the plain literal
formula (no regex alternations, no reuse of per-suit counts), persons are
resolved per seat with the first-seat rule spelled out, and the derived
deals are built with DuckDB list functions rather than unrolled text. Tables
are the driver's views (``orders``, ``events``, ...).
"""

from __future__ import annotations

# The values below are written out here, not imported: a wrong value in the
# library must not be wrong on both sides.
SUITS = ("spades", "hearts", "clubs", "diamonds")
FIGURE_WEIGHTS = {"11": 1, "12": 2, "13": 3, "14": 4}
FIGURE_RANKS = ("11", "12", "13", "14")
HAND_PARTNER = {1: 3, 2: 4, 3: 1, 4: 2}
PICKED_BY_PARTNER = {1: 3, 2: 4, 3: 1, 4: 1}
ENEMIES = {1: (2, 4), 2: (1, 3), 3: (2, 4), 4: (1, 3)}
PEOPLE = {"north": ("north", "n"), "east": ("east",), "south": ("south",), "west": ("west",)}
NAMES = ("north", "east", "south", "west")
BIDS_PREFIX = '{"bids":[-1,7,-1,-1],"current_bidder":'
TOTAL_ROUNDS = "total_rounds_played"
METRICS = (
    "figures_count",
    "figures_score",
    "tarnib_figures_count",
    "over_3_enemy_tarnib_count",
    "has_enemy_picked_tarnib_count",
    "over_3_partner_tarnib_count",
    "has_partner_picked_tarnib_count",
    "team_figures_count",
    "rounds_with_less_than_two_figures",
    "over_two_aces_count",
    "suits_over_five_cards",
    "suits_with_over_one_figures",
)
WORDS = ("the", "and", "de", "la", "der", "und", "el", "qui")
PUNCTUATION_WEIGHTS = {".": 1, ",": 2, "?": 3, "!": 4}
WORD_GROUPS = (("the", "The"), ("and", "And"), ("de", "De"), ("la", "La"), ("en", "En"))
WORD_GROUPS_OVER = 5
EVENT_TYPES_KEPT = ("purchase", "signup")
EVENT_TYPES_WIDE = ("signup", "purchase", "error", "view", "click", "refund")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cnt(text: str, token_sql: str) -> str:
    return f"((length({text}) - length(replace({text}, {token_sql}, ''))) // length({token_sql}))"


def _cnt_lit(text: str, token: str) -> str:
    return f"((length({text}) - length(replace({text}, {_q(token)}, ''))) // {len(token)})"


SUIT_LIST = "[" + ", ".join(_q(s) for s in SUITS) + "]"


def rounds_cte() -> str:
    r = "o_orderkey"
    hands = []
    for h in range(4):
        p = f"((((1 + {r} % 52) * ({13 * h} + s + 1)) % 53 - 1 + {r} // 52) % 52)"
        card = f"CAST(2 + {p} % 13 AS VARCHAR) || '_of_' || {SUIT_LIST}[{p} // 13 + 1]"
        slots = f"(CASE WHEN {r} % 29 = 0 THEN 10 ELSE 13 END)" if h == 1 else "13"
        hand = f"""('["' || array_to_string(list_transform(range({slots}), lambda s: {card}), '","') || '"]')"""
        if h == 0:
            hand = f"""CASE WHEN {r} % 23 = 0 THEN replace({hand}, '_of_hearts",', '_of_hearts"') ELSE {hand} END"""
        if h == 2:
            hand = f"""CASE WHEN {r} % 31 = 0 THEN replace({hand}, ']', ',"14_of_spades"]') ELSE {hand} END"""
        if h == 3:
            hand = f"CASE WHEN {r} % 37 = 0 THEN NULL ELSE {hand} END"
        hands.append(f"{hand} AS player_{h + 1}_cards")
    names = "[" + ", ".join(_q(n) for n in NAMES) + "]"
    players = []
    for h in range(4):
        name = f"{names}[({r} + {h}) % 4 + 1]"
        if h == 3:
            name = f"(CASE WHEN {r} % 19 = 0 THEN 'n' ELSE {name} END)"
        null_case = f"WHEN {r} % 101 = 0 AND {h} = 2 THEN NULL " if h == 2 else ""
        players.append(
            f"CASE {null_case}WHEN {r} % 17 = 0 AND {r} % 4 = {h} THEN 'guest' "
            f"WHEN {r} % 3 = 0 THEN upper({name}) ELSE {name} END AS player_{h + 1}"
        )
    cols = [
        f"{r} AS round_id",
        f"CASE WHEN {r} % 25 = 24 THEN 'n/a' ELSE CAST({r} % 14 AS VARCHAR) || (CASE WHEN {r} % 6 = 1 THEN '.0' ELSE '' END) END AS team_1_score",
        f"CAST(13 - {r} % 14 - (CASE WHEN {r} % 10 = 0 THEN 1 ELSE 0 END) AS VARCHAR) AS team_2_score",
        *players,
        *hands,
        f"CASE WHEN {r} % 41 = 0 THEN NULL WHEN {r} % 43 = 0 THEN '' WHEN {r} % 47 = 0 THEN 'notrump' "
        f"ELSE {SUIT_LIST}[({r} // 4) % 4 + 1] END AS tarnib",
        f"CASE WHEN {r} % 59 = 0 THEN NULL ELSE {_q(BIDS_PREFIX)} || (CASE WHEN {r} % 13 = 0 THEN '10' WHEN {r} % 11 = 5 THEN '-1' "
        f"ELSE CAST(({r} // 5) % 4 AS VARCHAR) END) || (CASE WHEN {r} % 15 = 7 THEN ' }}' ELSE '}}' END) END AS bids_data",
    ]
    return "rounds AS (SELECT " + ",\n  ".join(cols) + " FROM orders)"


def _person(seat: int) -> str:
    branches = " ".join(
        f"WHEN lower(player_{seat}) IN ({', '.join(_q(a) for a in aliases)}) THEN {_q(p)}"
        for p, aliases in PEOPLE.items()
    )
    return f"CASE {branches} END"


def _seat_metrics(seat: int) -> dict[str, str]:
    c = f"player_{seat}_cards"
    pc = f"player_{HAND_PARTNER[seat]}_cards"
    fig = "(" + " + ".join(_cnt_lit(c, r) for r in FIGURE_RANKS) + ")"
    pfig = "(" + " + ".join(_cnt_lit(pc, r) for r in FIGURE_RANKS) + ")"
    picker = "(CASE WHEN length(bids_data) >= 2 THEN TRY_CAST(substr(bids_data, length(bids_data) - 1, 1) AS INTEGER) + 1 END)"
    # An empty trump matches at every position; a null one leaves the count unknown.
    trumps = f"(CASE WHEN tarnib = '' THEN length({c}) + 1 ELSE {_cnt(c, 'tarnib')} END)"
    partner = f"({picker} = {PICKED_BY_PARTNER[seat]})"
    enemy = f"({picker} IN ({', '.join(map(str, ENEMIES[seat]))}))"

    def flag(condition: str) -> str:  # null stays null
        return f"CAST(({condition}) AS INTEGER)"

    def over_3(picked: str) -> str:
        return flag(f"CASE WHEN {picker} IS NULL THEN NULL WHEN {picked} THEN {trumps} > 3 ELSE FALSE END")

    suit_len = [flag(f"{_cnt_lit(c, 'of_' + s)} > 5") for s in SUITS]
    suit_fig = [flag("(" + " + ".join(_cnt_lit(c, f"{r}_of_{s}") for r in FIGURE_RANKS) + ") > 1") for s in SUITS]
    return {
        "figures_count": fig,
        "figures_score": "(" + " + ".join(f"{_cnt_lit(c, r)} * {w}" for r, w in FIGURE_WEIGHTS.items()) + ")",
        "tarnib_figures_count": "(" + " + ".join(_cnt(c, f"('{r}_of_' || coalesce(tarnib, 'null'))") for r in FIGURE_RANKS) + ")",
        "team_figures_count": f"({fig} + {pfig})",
        "rounds_with_less_than_two_figures": flag(f"{fig} < 2"),
        "over_two_aces_count": flag(f"{_cnt_lit(c, '14')} > 2"),
        "suits_over_five_cards": "(" + " + ".join(suit_len) + ")",
        "suits_with_over_one_figures": "(" + " + ".join(suit_fig) + ")",
        "has_partner_picked_tarnib_count": flag(partner),
        "has_enemy_picked_tarnib_count": flag(enemy),
        "over_3_partner_tarnib_count": over_3(partner),
        "over_3_enemy_tarnib_count": over_3(enemy),
    }


def _seat_rows(source: str, with_person: bool) -> str:
    selects = []
    for seat in range(1, 5):
        m = _seat_metrics(seat)
        cols = [f"round_id", f"CAST({seat} AS INTEGER) AS seat"]
        if with_person:
            person = _person(seat)
            earlier = [_person(s) for s in range(1, seat)]
            first = f"({person}) IS NOT NULL" + "".join(f" AND ({person}) IS DISTINCT FROM ({e})" for e in earlier)
            cols += [f"player_{seat} AS player", f"{person} AS person", f"({first}) AS is_first_seat"]
        cols += [f"CAST({m[k]} AS BIGINT) AS {k}" for k in METRICS]
        selects.append(f"SELECT {', '.join(cols)} FROM {source}")
    return "\nUNION ALL\n".join(selects)


COMPLETE = "TRY_CAST(team_1_score AS DOUBLE) + TRY_CAST(team_2_score AS DOUBLE) = 13"
KEPT_WHERE = (
    COMPLETE + " AND "
    + " AND ".join(
        f"lower(player_{s}) IN ({', '.join(_q(a) for aliases in PEOPLE.values() for a in aliases)})" for s in range(1, 5)
    )
)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _kept() -> str:
    return f"kept AS (SELECT * FROM rounds WHERE {KEPT_WHERE})"


def _seats() -> str:
    return f"seats AS ({_seat_rows('kept', True)})"


def _totals_select() -> str:
    sums = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in METRICS)
    return f"SELECT person, CAST(count(*) AS BIGINT) AS rounds_played, {sums} FROM seats WHERE is_first_seat GROUP BY person"


def _errors_select() -> str:
    """Per kept round, first seat and metric: why the metric has no value."""
    picker = "(CASE WHEN length(bids_data) >= 2 THEN TRY_CAST(substr(bids_data, length(bids_data) - 1, 1) AS INTEGER) + 1 END)"
    parts = []
    for seat in range(1, 5):
        person = _person(seat)
        first = f"({person}) IS NOT NULL" + "".join(f" AND ({person}) IS DISTINCT FROM ({_person(s)})" for s in range(1, seat))
        c, pc = f"player_{seat}_cards", f"player_{HAND_PARTNER[seat]}_cards"
        picked = {"partner": f"{picker} = {PICKED_BY_PARTNER[seat]}", "enemy": f"{picker} IN ({', '.join(map(str, ENEMIES[seat]))})"}
        for m in METRICS:
            why = f"CASE WHEN {c} IS NULL THEN 'missing hand' END"
            if m == "team_figures_count":
                why = f"CASE WHEN {c} IS NULL THEN 'missing hand' WHEN {pc} IS NULL THEN 'missing partner hand' END"
            if "picked" in m:
                why = f"CASE WHEN {picker} IS NULL THEN 'unreadable bid' END"
            if m.startswith("over_3"):
                held = picked["partner" if "partner" in m else "enemy"]
                why = f"CASE WHEN {picker} IS NULL THEN 'unreadable bid' WHEN {held} AND ({c} IS NULL OR tarnib IS NULL) THEN 'missing hand or trump' END"
            parts.append(f"SELECT round_id, CAST({seat} AS INTEGER) AS seat, {person} AS person, {_q(m)} AS metric, {why} AS reason FROM kept WHERE {first}")
    return "errors AS (" + "\nUNION ALL\n".join(parts) + ")\nSELECT * FROM errors WHERE reason IS NOT NULL"


def _types_select() -> str:
    """How often each field of the mixed lines is an integer, a fraction or text."""
    number = "round_id % 3 <> 0 AND TRY_CAST({0} AS DOUBLE) IS NOT NULL"
    parts = ["SELECT 'round_id' AS field, count(round_id) AS i, 0 AS f, 0 AS t FROM rounds"]
    for c in ("team_1_score", "team_2_score"):
        n = number.format(c)
        parts.append(
            f"SELECT '{c}', count(*) FILTER ({n} AND {c} NOT LIKE '%.%'), count(*) FILTER ({n} AND {c} LIKE '%.%'), count(*) FILTER (NOT ({n})) FROM rounds"
        )
    texts = [f"player_{s}" for s in range(1, 5)] + [f"player_{s}_cards" for s in range(1, 5)] + ["tarnib", "bids_data"]
    parts += [f"SELECT '{c}', 0, 0, count({c}) FROM rounds" for c in texts]
    return (
        "SELECT field, CAST(i AS BIGINT) AS n_integer, CAST(f AS BIGINT) AS n_fraction, CAST(t AS BIGINT) AS n_text, CAST(0 AS BIGINT) AS n_other, "
        "CASE WHEN i + f > 0 AND t > 0 THEN 'mixed' WHEN f > 0 THEN 'number' WHEN i > 0 THEN 'integer' ELSE 'text' END AS inferred FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


def oracle_queries() -> dict[str, str]:
    base = _with(rounds_cte())
    kept = _with(rounds_cte(), _kept())
    seats = _with(rounds_cte(), _kept(), _seats())
    round_cols = "round_id, team_1_score, team_2_score, player_1, player_2, player_3, player_4, " \
        "player_1_cards, player_2_cards, player_3_cards, player_4_cards, tarnib, bids_data"
    q: dict[str, str] = {
        "rounds_source": base + f"SELECT {round_cols} FROM rounds",
        "complete_rounds": base + f"SELECT {round_cols} FROM rounds WHERE {COMPLETE}",
        "roster_rounds": kept + f"SELECT {round_cols} FROM kept",
        "seat_features": seats + "SELECT * FROM seats",
    }
    all_seats = _with(rounds_cte(), f"seats AS ({_seat_rows('rounds', False)})")
    for m in METRICS:
        q[f"m_{m}"] = all_seats + f"SELECT round_id, seat, {m} FROM seats"
    q["attribution"] = seats + "SELECT round_id, person, seat, " + ", ".join(METRICS) + " FROM seats WHERE is_first_seat"
    q["person_totals"] = seats + _totals_select()
    q["person_totals_roster_join"] = q["person_totals"]
    q["person_totals_bucketed"] = q["person_totals"]
    # Round count: every kept round, counted once.
    cells = [f"(SELECT CAST(count(*) AS BIGINT) FROM kept) AS {TOTAL_ROUNDS}"]
    for m in METRICS:
        for p in PEOPLE:
            cells.append(f"CAST(sum(CASE WHEN person = {_q(p)} THEN {m} END) AS BIGINT) AS {p}_{m}")
    summary = seats.rstrip("\n") + f",\ntotals AS ({_totals_select()})\nSELECT {', '.join(cells)} FROM totals"
    q["career_summary"] = summary
    q["summary_roundtrip"] = summary
    q["summary_stream"] = summary
    q["summary_job"] = summary
    q["summary_cli"] = summary
    q["totals_by_folder"] = q["person_totals"]
    q["bad_lines"] = """
WITH lines AS (SELECT ['{"team_1_score": 7, "team_2_sc', 'not json at all', '', '["a list"]', '{"round_id": "abc", "team_1_score": 7}'][o_orderkey % 5 + 1] AS l
  FROM orders WHERE o_orderkey % 20 = 0 OR o_orderkey % 7 = 0),
kinds AS (SELECT CASE WHEN json_valid(l) AND json_type(l) = 'OBJECT' THEN 'wrong_type' WHEN json_valid(l) THEN 'not_an_object'
  WHEN starts_with(l, '{') AND NOT ends_with(l, '}') THEN 'truncated' ELSE 'malformed' END AS kind FROM lines WHERE l <> '')
SELECT kind, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) AS BIGINT) AS n_written FROM kinds GROUP BY kind"""
    q["round_errors"] = seats.rstrip("\n").replace("seats AS (", "ignored AS (") + ",\n" + _errors_select()
    q["inferred_types"] = base + _types_select()
    q["x_picker"] = (
        "SELECT event_id, (CASE WHEN length(props) >= 2 THEN "
        "TRY_CAST(substr(props, length(props) - 1, 1) AS INTEGER) + 1 END) AS picker FROM events"
    )
    word_sums = ", ".join(f"CAST(sum({_cnt_lit('text', w)}) AS BIGINT) AS n_{w}" for w in WORDS)
    q["x_token_count"] = f"SELECT lang, {word_sums} FROM documents GROUP BY lang"
    score = " + ".join(f"{_cnt_lit('text', t)} * {w}" for t, w in PUNCTUATION_WEIGHTS.items())
    q["x_weighted_score"] = f"SELECT role, CAST(sum({score}) AS BIGINT) AS score FROM conversations GROUP BY role"
    groups = " + ".join(
        "(CASE WHEN (" + " + ".join(_cnt_lit("text", t) for t in g) + f") > {WORD_GROUPS_OVER} THEN 1 ELSE 0 END)"
        for g in WORD_GROUPS
    )
    q["x_threshold_groups"] = f"SELECT doc_id, CAST({groups} AS INTEGER) AS groups_over FROM documents"
    q["x_roster_filter"] = (
        "SELECT event_id, user_id, event_type FROM events WHERE lower(event_type) IN ("
        + ", ".join(_q(t) for t in EVENT_TYPES_KEPT) + ")"
    )
    q["x_sum_invariant"] = (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
        "WHERE TRY_CAST(l_linenumber AS DOUBLE) + TRY_CAST(l_quantity AS DOUBLE) = 13"
    )
    q["x_first_match"] = (
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_partkey "
        "WHEN l_linestatus = 'F' THEN l_suppkey END AS picked FROM lineitem"
    )
    q["x_wide_totals"] = "SELECT " + ", ".join(
        f"CAST(sum(CASE WHEN event_type = {_q(t)} THEN CAST(floor(value * 100) AS BIGINT) END) AS BIGINT) AS cents_{t}"
        for t in EVENT_TYPES_WIDE
    ) + " FROM events"
    q["x_sum_all_with_count"] = (
        "SELECT CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS l_partkey, "
        "CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, "
        "CAST(count(*) AS BIGINT) AS row_count FROM lineitem"
    )
    return q
