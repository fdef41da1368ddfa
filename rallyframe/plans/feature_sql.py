"""DuckDB SQL of the rating fold, the feature rows and live fixtures, written from their definitions."""

from __future__ import annotations

from rallyframe.operators import features as feat
from rallyframe.operators.history import RATES
from rallyframe.functions.scalars import ROLES, SURFACES

BY_DAY = "proxy_date, tourney_id, round_order, match_num, winner_key, loser_key, row_id"
BY_ROW = "tourney_date, round_order, match_num, winner_key, loser_key, row_id"
#: Added to features before they are rounded, so that none lies on a half.
NUDGE = 3e-7
#: A player's values before the fold, from the rank.
_SEED = "(case when {0} > 0 then 1500 + 0.45::double * (least(greatest(2000 - 250 * log10({0}), 1150), 2050) - 1500) else 1500::double end)"


def _expected(a: str, b: str) -> str:
    return f"(1 / (1 + pow(10::double, -({a} - {b}) / 400)))"


def _k(n: str) -> str:
    return f"(250 / pow({n} + 5, 0.4::double))"


def fold(rows: str, by_day: bool = True) -> str:
    """CTEs up to ``rt`` (row_id, v: the five ratings of the winner, of the loser, expected score) over the matches of ``rows``.

    A keyed recursion: each step takes all matches whose two players have no earlier match left. A
    player's row keeps the ratings, those from before the day of the last match, and how many rows
    were taken; a player's row per surface keeps those of the surface.
    """
    row = lambda key, sf, n, t, a, b, c, pa, pb, pc, ud, v: f"{{'key': {key}, 'sf': {sf}, 'n': {n}::bigint, 't': {t}::bigint, 'a': {a}::double, 'b': {b}::double, 'c': {c}::double, 'pa': {pa}::double, 'pb': {pb}::double, 'pc': {pc}::double, 'ud': {ud}::date, 'v': {v}::double[]}}"
    new, seen, now = [], [], []
    for p, other, sign in (("w", "l", "+"), ("l", "w", "-")):
        new.append(row(p, "''", f"{p}n + u", f"k{p}", f"{p}a {sign} u * ds", f"{p}b {sign} u * dd", f"{p}c {sign} u * df", f"v{p}a", f"v{p}b", f"v{p}c", f"case when is_clean then d else {p}ud end", "null"))
        new.append("case when is_clean then " + row(p, "s", f"{p}sn + 1", "0", f"{p}sa {sign} dsa", f"{p}sb {sign} dsb", "null", f"v{p}sa", f"v{p}sb", "null", "d", "null") + " end")
        seed, q = _SEED.format(f"o.{p}r"), p.upper()
        now += [f"coalesce({q}.{x}, {seed}) {p}{x}" for x in "abc"] + [f"coalesce({q}.n, 0) {p}n, {q}.ud {p}ud, coalesce({q}S.n, 0) {p}sn"]
        now += [f"coalesce({q}S.{x}, {q}.{x}, {seed}) {p}s{x}" for x in "ab"]
        same = "{0}.ud = o.d" if by_day else "false"
        now += [f"case when {same.format(q)} then {q}.p{x} else coalesce({q}.{x}, {seed}) end v{p}{x}" for x in "abc"]
        now += [f"case when {same.format(q + 'S')} then {q}S.p{x} else {q}S.{x} end v{p}s{x}" for x in "ab"]
        seen += [f"v{p}a", f"v{p}b", f"v{p}c", f"coalesce(v{p}sa, v{p}a)", f"coalesce(v{p}sb, v{p}b)"]
    out = row("'>' || row_id", "''", "row_id", "0", *["null"] * 7, f"[{', '.join(seen)}, {_expected('vwa', 'vla')}]")
    moves = f"is_clean::int u, 22 * (1 - {_expected('wa', 'la')}) ds, 0.5::double * ({_k('wn')} + {_k('ln')}) * (1 - {_expected('wb', 'lb')}) dd, 48 * (1 - {_expected('wc', 'lc')}) df, 34 * (1 - {_expected('wsa', 'lsa')}) dsa, 0.5::double * ({_k('wsn')} + {_k('lsn')}) * (1 - {_expected('wsb', 'lsb')}) dsb"
    return f"""
o0 as (select row_number() over (order by {BY_DAY if by_day else BY_ROW}) i, row_id, proxy_date d, winner_key w, loser_key l, surface s, winner_rank wr, loser_rank lr, is_clean from {rows}),
o1 as (select i, p, row_number() over (partition by p order by i) k from (select i, w p from o0 union all select i, l from o0)),
o as materialized (select o0.*, a.k kw, b.k kl from o0 join o1 a on a.i = o0.i and a.p = o0.w join o1 b on b.i = o0.i and b.p = o0.l),
st(key, sf, n, t, a, b, c, pa, pb, pc, ud, v) using key (key, sf) as (
 select '#', '#', 0::bigint, 0::bigint, null::double, null::double, null::double, null::double, null::double, null::double, null::date, null::double[]
 union
 select x.* from (select unnest([{out}, {", ".join(new)}]) x from (select *, {moves} from (
  select o.*, {", ".join(now)} from (select 1 from st limit 1) z cross join o
  left join recurring.st W on W.key = o.w and W.sf = '' left join recurring.st L on L.key = o.l and L.sf = ''
  left join recurring.st WS on WS.key = o.w and WS.sf = o.s left join recurring.st LS on LS.key = o.l and LS.sf = o.s
  where coalesce(W.t, 0) = o.kw - 1 and coalesce(L.t, 0) = o.kl - 1))) where x is not null),
rt as materialized (select n row_id, v from st where starts_with(key, '>'))"""


FAMILIES = [f"{s}_{f}" for s in ("w", "l") for f in ("slow", "dynamic", "fast", "surface", "surface_dynamic")] + ["expected"]


def ratings(once: str, by_day: bool = True, digits: int = 3) -> str:
    return f"with recursive {once}, {fold('m', by_day)} select row_id, " + ", ".join(f"round(v[{i}], {digits}) {c}" for i, c in enumerate(FAMILIES, 1)) + " from rt"


def _decayed() -> dict[str, tuple[str, str, int]]:
    """Name -> (value, test, half-life)."""
    out = {f"recent_residual_{h}": ("o.residual", "true", h) for h in (35, 90, 180)} | {f"recent_win_{h}": ("o.won", "true", h) for h in (35, 90)} | {"opp_elo_90": ("o.opponent_rating", "true", 90)}
    out |= {f"{r}_90": (f"o.{r}", "true", 90) for r in RATES} | {f"{r}_residual_180": ("o.residual", f"o.level_role = '{r}'", 180) for r in ROLES}
    return out | {"own_surface_180": ("o.residual", "o.surface = r.surface", 180)}


def _snapshots(rows: str) -> str:
    """CTEs from ``fold`` up to ``snap``: everything known of each side of each match of ``rows`` before its day."""
    sides = []
    for p, q, won, at, other in (("w", "l", 1, 0, 5), ("l", "w", 0, 5, 0)):
        me = "winner" if p == "w" else "loser"
        residual = "1 - v[11]" if p == "w" else "-(1 - v[11])"
        sides.append(f"""select row_id, '{p}' side, {me}_key player, proxy_date d, datediff('day', date '1970-01-01', proxy_date) dn, tourney_id, round_order, match_num, winner_key, loser_key, surface, level_role, is_clean, {won}::double won,
 {me}_rank rank, {me}_rank_points points, {me}_age age, {me}_ht height, {p}s spw, 1 - {q}s rpw, 1 - {p}b hold, {q}b break, {"ss" if won else "1 - ss"} set_share, {"gs" if won else "1 - gs"} game_share,
 {", ".join(f"v[{at + i}] {f}" for i, f in enumerate(("slow", "dynamic", "fast", "surface_rating", "surface_dynamic"), 1))}, {residual} residual, v[{other + 1}] opponent_rating from mr""")
    known = ", ".join(f"coalesce({c}, (max(case when is_clean and {c} is not null then (d, tourney_id, round_order, match_num, winner_key, loser_key, row_id, {c}) end) over b)[8]) {c}" for c in ("rank", "points", "age", "height"))
    clean = "is_clean::int"
    means = []
    for name, (value, test, half) in _decayed().items():
        w, ok = f"pow(2::double, -(r.dn - o.dn) / {half}::double)", f"({test}) and {value} is not null"
        means.append(f"sum(case when {ok} then {w} * {value} end) / sum(case when {ok} then {w} end) {name}, coalesce(sum(case when {ok} then {w} end), 0) {name}_n")
    share = "(surface_experience / (surface_experience + 8))"
    defaults = {m: d for m, d in feat.MEANS.items() if m != "surface_residual_180"} | {"opp_elo_90": 1500.0}
    return f"""
sc0 as (select row_id, upper(trim(coalesce(score, ''))) z from {rows}),
sc1 as (select row_id, unnest(string_split_regex(replace(replace(z, 'RET', ''), 'DEF', ''), '\\s+')) tok from sc0),
sc2 as (select row_id, regexp_extract(regexp_replace(tok, '\\([^)]*\\)', '', 'g'), '^(\\d+)-(\\d+)$', ['a', 'b']) x from sc1 where not starts_with(tok, '[')),
sc3 as (select row_id, count(*) filter (x.a::int > x.b::int) w, count(*) filter (x.a::int < x.b::int) l, sum(x.a::int) ga, sum(x.b::int) gb from sc2 where x.a <> '' group by row_id),
sc as (select row_id, w::double / nullif(w + l, 0) ss, ga::double / nullif(ga + gb, 0) gs from sc3 join sc0 using (row_id) where not contains(z, 'W/O') and not contains(z, 'WALKOVER')),
mr as (select q.*, rt.v, sc.ss, sc.gs, (w_1stwon + w_2ndwon) / nullif(w_svpt, 0) ws, (l_1stwon + l_2ndwon) / nullif(l_svpt, 0) ls, (w_bpfaced - w_bpsaved) / nullif(w_svgms, 0) wb, (l_bpfaced - l_bpsaved) / nullif(l_svgms, 0) lb
 from {rows} q join rt using (row_id) left join sc using (row_id)),
p as materialized ({" union all ".join(sides)}),
k as (select row_id, side, {known}, coalesce(sum({clean}) over b, 0)::double experience, coalesce(sum({clean}) over s, 0)::double surface_experience,
 case when max(case when is_clean then dn end) over b is null then 21 else least(dn - max(case when is_clean then dn end) over b, 60) end::double rest_days,
 {", ".join(f"least(coalesce(sum({clean}) over w{n}, 0), 140)::double workload_{n}d" for n in (7, 14, 28))} from p
 window b as (partition by player order by dn range between unbounded preceding and 1 preceding), s as (partition by player, surface order by dn range between unbounded preceding and 1 preceding),
 {", ".join(f"w{n} as (partition by player order by dn range between {n} preceding and 1 preceding)" for n in (7, 14, 28))}),
oc as (select *, row_number() over (partition by player order by d, tourney_id, round_order, match_num, winner_key, loser_key, row_id) kk from p where is_clean),
r as (select row_id, side, player, dn, surface, coalesce(sum({clean}) over (partition by player order by dn range between unbounded preceding and 1 preceding), 0) kk from p),
dm as (select r.row_id, r.side, {", ".join(means)} from r left join oc o on o.player = r.player and o.kk <= r.kk and o.kk > r.kk - 140 group by r.row_id, r.side),
s0 as (select p.row_id, p.side, slow, dynamic, fast, surface_rating, surface_dynamic, experience, surface_experience, rest_days, workload_7d, workload_14d, workload_28d,
 case when k.rank > 0 then k.rank else 750 end rank, case when k.points >= 0 then k.points else 5 end points, coalesce(k.age, 25) age, coalesce(k.height, 183) height,
 {", ".join(f"coalesce({m}, {d}::double) {m}" for m, d in defaults.items())}, coalesce(own_surface_180, 0) surface_residual_180, least(spw_90_n, rpw_90_n, hold_90_n, break_90_n) stat_matches
 from p join k using (row_id, side) join dm using (row_id, side)),
snap as (select *, {share} * surface_rating + (1 - {share}) * slow surface_blend, {share} * surface_dynamic + (1 - {share}) * dynamic dynamic_blend, fast - slow speed_gap,
 ln(1 + experience) experience_log, ln(1 + surface_experience) surface_experience_log, ln(1 + greatest(points, 0)) points_log from s0)"""


def feature_columns(digits: int = 4) -> dict[str, str]:
    """FEATURES as SQL over sides ``a`` and ``b`` of ``snap``, a match row ``q`` and its meetings ``h`` (x of A, y of B)."""
    entry = {"q": "('Q', 'Q1', 'Q2', 'Q3')", "wc": "('WC')", "ll": "('LL')", "pr": "('PR', 'P')"}
    value = lambda s, c: f"(q.entry_{s} in {entry[c[6:]]})::int" if c.startswith("entry_") else f"{s}.{c}"
    out = {n: f"({value('a', c)} - {value('b', c)}) / {d}::double" for n, (c, d) in feat._PLAIN.items()}
    stats = "least(a.stat_matches, b.stat_matches)"
    out |= {
        "rank_log_diff": "ln(greatest(b.rank, 1)) - ln(greatest(a.rank, 1))", "h2h_advantage": "(h.x + 1.5::double) / (h.x + h.y + 3) - 0.5::double", "h2h_matches": "(h.x + h.y)::double",
        "min_experience": "least(a.experience, b.experience)", "min_surface_experience": "least(a.surface_experience, b.surface_experience)", "min_stat_matches": stats, "stat_coverage": f"{stats} / ({stats} + 5)",
        "round_order_scaled": "q.round_order / 10::double", "best_of_5": "(q.best_of = 5)::double", "indoor_flag": "q.indoor_flag", "indoor_known": "q.indoor_known",
    } | {f"surface_{s.lower()}": f"(q.surface = '{s}')::double" for s in SURFACES}
    assert set(out) == set(feat.FEATURES)
    return {n: f"round({x} + {NUDGE}, {digits})" for n, x in out.items()}


def _joined(rows: str, wanted: str) -> str:
    return f"""
q as (select *, winner_key < loser_key f, case when winner_key < loser_key then winner_entry else loser_entry end entry_a, case when winner_key < loser_key then loser_entry else winner_entry end entry_b from {rows} where {wanted}),
h as (select q.row_id, count(*) filter (b.winner_key = least(q.winner_key, q.loser_key)) x, count(*) filter (b.winner_key = greatest(q.winner_key, q.loser_key)) y from q left join {rows} b
 on least(q.winner_key, q.loser_key) = least(b.winner_key, b.loser_key) and greatest(q.winner_key, q.loser_key) = greatest(b.winner_key, b.loser_key) and b.is_clean and b.proxy_date < q.proxy_date group by q.row_id)"""


_FROM = "from q join h using (row_id) join snap a on a.row_id = q.row_id and a.side = case when q.f then 'w' else 'l' end join snap b on b.row_id = q.row_id and b.side = case when q.f then 'l' else 'w' end"
_IDS = "q.proxy_date date, q.tourney_date event_start_date, q.tourney_id, q.tourney_name, q.surface, q.round, case when q.f then q.winner_name else q.loser_name end player_a, case when q.f then q.loser_name else q.winner_name end player_b, least(q.winner_key, q.loser_key) player_a_key, greatest(q.winner_key, q.loser_key) player_b_key"


def features(once: str) -> str:
    """Feature rows of the targets among the matches ``m`` of ``once``."""
    columns = ", ".join(f"{x} {n}" for n, x in feature_columns().items())
    return f"with recursive {once}, {fold('m')}, {_snapshots('m')}, {_joined('m', 'is_target')} select q.row_id, {_IDS}, q.f::int target, q.winner_name, q.loser_name, q.winner_rank, q.loser_rank, {columns} {_FROM}"


def mirrored(once: str) -> str:
    flipped = ", ".join(f"-{c} {c}" for c in feat.DIFF_FEATURES)
    return f"with fr as ({features(once)}) select * from fr union all by name select * replace ((1 - target)::int as target, {', '.join(x.replace(' ', ' as ', 1) for x in flipped.split(', '))}) from fr"


def live(once: str, norm: str) -> str:
    """Features of the slate's fixtures: they are matches that change nothing, after all others of their day in order."""
    sf = "upper(left(trim(surface), 1)) || lower(substr(trim(surface), 2))"
    side = lambda i, s: f"k{i} {s}_key, player{i} {s}_name, rank{i} {s}_rank, points{i} {s}_rank_points, age{i} {s}_age, height{i} {s}_ht, upper(coalesce(entry{i}, '')) {s}_entry"
    return f"""with recursive {once},
sn as (select {norm.format('n')} nn, key, max(tt) tt from (select winner_name n, winner_key key, (proxy_date, round_order, match_num, row_id, 0) tt from m union all select loser_name, loser_key, (proxy_date, round_order, match_num, row_id, 1) from m) group by 1, 2),
bn as (select nn, arg_max(key, (tt, key)) key from sn group by nn),
sl as (select s.*, coalesce(a.key, 'name:' || {norm.format('player1')}) k1, coalesce(b.key, 'name:' || {norm.format('player2')}) k2 from live_slate_template s left join bn a on a.nn = {norm.format('player1')} left join bn b on b.nn = {norm.format('player2')} where date is not null and player1 is not null and player2 is not null),
mm as (select * from m union all by name select (-1 - slate_id)::bigint row_id, date::date tourney_date, date::date proxy_date, 'LIVE' tourney_id, tournament tourney_name, case when {sf} in ('Hard', 'Clay', 'Grass', 'Carpet') then {sf} else 'Unknown' end surface, round,
 coalesce(round_order, 6)::int round_order, coalesce(best_of, 3)::double best_of, 0::double indoor_flag, 0::double indoor_known, 0::double match_num, '' score, 'challenger' level_role, false is_clean, false is_target, {side(1, 'winner')}, {side(2, 'loser')} from sl where k1 <> k2),
{fold('mm')}, {_snapshots('mm')}, {_joined('mm', 'row_id < 0')} select -1 - q.row_id slate_id, {_IDS}, {", ".join(f"{x} {n}" for n, x in feature_columns().items())} {_FROM}"""
