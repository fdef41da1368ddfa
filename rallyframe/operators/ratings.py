"""The rating fold: five rating families carried through all matches in order, one pass per universe."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.session import stage


@dataclass(frozen=True)
class RatingConfig:
    """Parameters of the rating families."""

    # The definition's base, scale, steps and decay.
    base: float = 1500.0
    scale: float = 400.0
    k_slow: float = 22.0
    k_fast: float = 48.0
    k_surface: float = 34.0
    decay: float = 250.0
    decay_offset: float = 5.0
    decay_power: float = 0.4
    seed_strength: float = 0.45


@dataclass
class _Player:
    slow: float
    dynamic: float
    fast: float
    matches: int = 0
    surface: dict[str, float] = field(default_factory=dict)
    surface_dynamic: dict[str, float] = field(default_factory=dict)
    surface_matches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> _Player:
        return _Player(**json.loads(text))


FAMILIES = ("slow", "dynamic", "fast", "surface", "surface_dynamic")
#: What the fold reads, besides the order: nothing that is not needed for ratings is carried.
_IN = ("universe", "row_id", "day", "winner_key", "loser_key", "surface", "winner_rank", "loser_rank", "is_clean", "state")
_OUT = ", ".join(["row_id long", *[f"{s}_{f} double" for s in ("w", "l") for f in FAMILIES], "expected double", "place long"])
#: A player's state: what a later fold needs to go on from ``day``, whose own matches are not yet in it.
STATE = "universe string, player string, day int, state string"


class RatingFold:
    """Ratings of one universe. ``view`` reads both sides before a match, ``play`` applies a finished one."""

    def __init__(self, config: RatingConfig) -> None:
        self.c, self.players = config, {}

    def _seed(self, rank: float | None) -> float:
        if rank is None or not rank > 0 or math.isinf(rank):
            return self.c.base
        raw = min(max(2000.0 - 250.0 * math.log10(rank), 1150.0), 2050.0)
        return self.c.base + self.c.seed_strength * (raw - self.c.base)

    def player(self, key: str, rank: float | None) -> _Player:
        """A player's state; seeded from the rank when first seen, in a clean match or not."""
        p = self.players.get(key)
        if p is None:
            s = self._seed(rank)
            p = self.players[key] = _Player(s, s, s)
        return p

    def _expect(self, difference: float) -> float:
        return 1.0 / (1.0 + 10.0 ** (-difference / self.c.scale))

    def view(self, w: _Player, l: _Player, surface: str) -> list[float]:
        sides = [[p.slow, p.dynamic, p.fast, p.surface.get(surface, p.slow), p.surface_dynamic.get(surface, p.dynamic)] for p in (w, l)]
        return [*sides[0], *sides[1], self._expect(w.slow - l.slow)]

    def play(self, w: _Player, l: _Player, surface: str) -> None:
        c = self.c
        k = lambda n: c.decay / (n + c.decay_offset) ** c.decay_power
        ws, ls = w.surface.get(surface, w.slow), l.surface.get(surface, l.slow)
        wd, ld = w.surface_dynamic.get(surface, w.dynamic), l.surface_dynamic.get(surface, l.dynamic)
        nw, nl = w.surface_matches.get(surface, 0), l.surface_matches.get(surface, 0)
        slow = c.k_slow * (1.0 - self._expect(w.slow - l.slow))
        dynamic = 0.5 * (k(w.matches) + k(l.matches)) * (1.0 - self._expect(w.dynamic - l.dynamic))
        fast = c.k_fast * (1.0 - self._expect(w.fast - l.fast))
        on_surface = c.k_surface * (1.0 - self._expect(ws - ls))
        on_dynamic = 0.5 * (k(nw) + k(nl)) * (1.0 - self._expect(wd - ld))
        for p, sign, s, d, n in ((w, 1.0, ws, wd, nw), (l, -1.0, ls, ld, nl)):
            p.slow += sign * slow
            p.dynamic += sign * dynamic
            p.fast += sign * fast
            p.surface[surface], p.surface_dynamic[surface] = s + sign * on_surface, d + sign * on_dynamic
            p.matches += 1
            p.surface_matches[surface] = n + 1


class DayFold:
    """``RatingFold`` over the matches of whole days: players' states are rows of arrays, matches that share no player are played at once."""

    def __init__(self, config: RatingConfig) -> None:
        self.c, self.scalar = config, RatingFold(config)
        self.places: dict[str, int] = {}
        self.surfaces: dict[str, int] = {}
        self.base, self.games = np.zeros((64, 3)), np.zeros(64)
        #: By player and surface: surface and surface_dynamic (NaN before a match on it), and matches.
        self.on, self.on_games = np.full((64, 8, 2), np.nan), np.zeros((64, 8))

    def place(self, key: str, rank: float | None) -> int:
        i = self.places.get(key)
        if i is None:
            i = self.places[key] = len(self.places)
            if i == len(self.base):
                more = lambda x, none: np.concatenate([x, np.full_like(x, none)])
                self.base, self.games, self.on, self.on_games = more(self.base, 0.0), more(self.games, 0.0), more(self.on, np.nan), more(self.on_games, 0.0)
            self.base[i] = self.scalar._seed(rank)
        return i

    def surface(self, name: str) -> int:
        i = self.surfaces.setdefault(name, len(self.surfaces))
        if i == self.on.shape[1]:
            self.on = np.concatenate([self.on, np.full_like(self.on, np.nan)], axis=1)
            self.on_games = np.concatenate([self.on_games, np.zeros_like(self.on_games)], axis=1)
        return i

    def load(self, key: str, p: _Player) -> None:
        i = self.place(key, None)
        self.base[i], self.games[i] = (p.slow, p.dynamic, p.fast), p.matches
        for name, x in p.surface.items():
            j = self.surface(name)
            self.on[i, j], self.on_games[i, j] = (x, p.surface_dynamic[name]), p.surface_matches[name]

    def states(self) -> Iterator[tuple[str, _Player]]:
        for key, i in self.places.items():
            seen = {name: j for name, j in self.surfaces.items() if not np.isnan(self.on[i, j, 0])}
            surface, dynamic = [{name: float(self.on[i, j, k]) for name, j in seen.items()} for k in (0, 1)]
            yield key, _Player(*[float(x) for x in self.base[i]], int(self.games[i]), surface, dynamic, {name: int(self.on_games[i, j]) for name, j in seen.items()})

    def view(self, who: np.ndarray, surface: np.ndarray) -> np.ndarray:
        """The FAMILIES of players, each on a surface."""
        base, on = self.base[who], self.on[who, surface]
        return np.hstack([base, np.where(np.isnan(on), base[:, :2], on)])

    def expect(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + 10.0 ** (-difference / self.c.scale))

    def play(self, w: np.ndarray, l: np.ndarray, surface: np.ndarray) -> None:
        """Apply matches in their order: a match waits for the earlier ones of its players only."""
        turn, last = [], {}
        for a, b in zip(w.tolist(), l.tolist(), strict=True):
            last[a] = last[b] = t = 1 + max(last.get(a, -1), last.get(b, -1))
            turn.append(t)
        order = np.argsort(turn, kind="stable")
        for own in np.split(order, np.cumsum(np.bincount(turn))[:-1]):
            self._play(w[own], l[own], surface[own])

    def _play(self, w: np.ndarray, l: np.ndarray, s: np.ndarray) -> None:
        c = self.c
        k = lambda n, m: 0.5 * (c.decay / (n + c.decay_offset) ** c.decay_power + c.decay / (m + c.decay_offset) ** c.decay_power)
        a, b = self.view(w, s), self.view(l, s)
        rest = 1.0 - self.expect(a - b)
        rest[:, 0] *= c.k_slow
        rest[:, 1] *= k(self.games[w], self.games[l])
        rest[:, 2] *= c.k_fast
        rest[:, 3] *= c.k_surface
        rest[:, 4] *= k(self.on_games[w, s], self.on_games[l, s])
        for i, x in ((w, a + rest), (l, b - rest)):
            self.base[i], self.on[i, s] = x[:, :3], x[:, 3:]
            self.games[i] += 1.0
            self.on_games[i, s] += 1.0


def _day_fold(config: RatingConfig, keep: bool):
    """``_fold`` with the matches of a day all rated before they are played."""
    none = -(2**31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        universe, day, fold, waiting, place = None, None, DayFold(config), [], 0

        def states() -> list:
            return [(universe, k, None if day == none else day, p.to_json()) for k, p in fold.states()] if keep else []

        for b in batches:
            if not b.num_rows:
                continue
            us, ids, days, ws, ls, surfaces, wr, lr, clean, state = b.columns
            us, days, ws, ls, surfaces, wr, lr = us.to_pylist(), days.fill_null(none).to_numpy(zero_copy_only=False), ws.to_pylist(), ls.to_pylist(), surfaces.to_pylist(), wr.to_pylist(), lr.to_pylist()
            clean, own = clean.fill_null(False).to_numpy(zero_copy_only=False).astype(bool), state.is_null().to_numpy(zero_copy_only=False)
            state = state.to_pylist() if not own.all() else None
            starts = [0, *[i for i, moved in enumerate(days[1:] != days[:-1], 1) if moved or us[i] != us[i - 1]]] if us[0] == us[-1] else [i for i in range(len(us)) if not i or us[i] != us[i - 1] or days[i] != days[i - 1]]
            rows, ended = [], []
            for i, j in zip(starts, [*starts[1:], len(us)], strict=True):
                if us[i] != universe:
                    ended += states()
                    fold, waiting = DayFold(config), []
                elif days[i] != day and waiting:
                    fold.play(*[np.concatenate(x) for x in zip(*waiting, strict=True)])
                    waiting = []
                universe, day = us[i], int(days[i])
                for x in range(i, j) if state else ():
                    if state[x] is not None:
                        fold.load(ws[x], _Player.from_json(state[x]))
                at = [x for x in range(i, j) if own[x]] if state else range(i, j)
                pairs = [(fold.place(ws[x], wr[x]), fold.place(ls[x], lr[x])) for x in at]
                if not pairs:
                    continue
                w, l = np.array(pairs).T
                s = np.array([fold.surface(surfaces[x]) for x in at])
                a, c = fold.view(w, s), fold.view(l, s)
                rows.append(np.column_stack([a, c, fold.expect(a[:, 0] - c[:, 0])]))
                fresh = clean[list(at)] if state else clean[i:j]
                if fresh.any():
                    waiting.append((w[fresh], l[fresh], s[fresh]))
            rated = np.vstack(rows) if rows else np.zeros((0, 11))
            yield _rated(ids.filter(pa.array(own)), [pa.array(x) for x in rated.T], place, ended, keep)
            place += len(rated)
        yield _rated(pa.array([], pa.int64()), [pa.array([], pa.float64())] * 11, place, states(), keep)

    return run


def _rated(ids: pa.Array, columns: list[pa.Array], place: int, states: list, keep: bool) -> pa.RecordBatch:
    """A batch of the fold's output: rows with their places from ``place`` on, then states."""
    arrays, names = [ids, *columns, pa.array(range(place, place + len(ids)), pa.int64())], [x.split()[0] for x in _OUT.split(", ")]
    if not keep:
        return pa.RecordBatch.from_arrays(arrays, names=names)
    n, own = len(states), [pa.nulls(len(ids), t) for t in (pa.string(), pa.string(), pa.int32(), pa.string())]
    more = [pa.array([x[i] for x in states], a.type) for i, a in enumerate(own)]
    arrays = [pa.concat_arrays([a, pa.nulls(n, a.type)]) for a in arrays] + [pa.concat_arrays([a, m]) for a, m in zip(own, more, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *[c.split()[0] for c in STATE.split(", ")]])


def _fold(config: RatingConfig, keep: bool):
    """The fold over sorted rows, match by match; with ``keep`` each universe ends with its players' states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        universe, fold, place = None, RatingFold(config), 0

        def states() -> list:
            return [(universe, k, None, p.to_json()) for k, p in fold.players.items()] if keep else []

        for b in batches:
            ids, rows, ended = [], [], []
            for u, i, _, w, l, s, wr, lr, clean, state in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if u != universe:
                    ended += states()
                    fold = RatingFold(config)
                universe = u
                if state is not None:
                    fold.players[w] = _Player.from_json(state)
                    continue
                pw, pl = fold.player(w, wr), fold.player(l, lr)
                ids.append(i)
                rows.append(fold.view(pw, pl, s))
                if clean:
                    fold.play(pw, pl, s)
            yield _rated(pa.array(ids, pa.int64()), [pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [()] * 11)], place, ended, keep)
            place += len(ids)
        yield _rated(pa.array([], pa.int64()), [pa.array([], pa.float64())] * 11, place, states(), keep)

    return run


def _folded(matches: DataFrame, row_id: str, universe: str | None, replay: str, config: RatingConfig | None, states: DataFrame | None, keep: bool) -> DataFrame:
    pool = F.col(universe).cast("string") if universe else F.lit("all")
    day = ["proxy_date", "tourney_id", "round_order", "match_num", "winner_key", "loser_key"]
    order = day if replay == "day" else ["tourney_date", "round_order", "match_num", "winner_key", "loser_key"]
    thin = matches.select(pool.alias("universe"), F.col(row_id).cast("long").alias("row_id"), F.unix_date("proxy_date").alias("day"), *_IN[3:-1], F.lit(None).cast("string").alias("state"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order) if c not in ("proxy_date", *_IN)])
    if states is not None:
        # States stand before the matches of their universe: their order columns are null.
        thin = thin.unionByName(states.select("universe", F.col("player").alias("winner_key"), "state"), allowMissingColumns=True)
    keys = [F.col("state").isNull(), *[F.col("day" if c == "proxy_date" else c if c in _IN else f"o{i}") for i, c in enumerate(order)], F.col("row_id")]
    rows = thin.repartition("universe").sortWithinPartitions("universe", *keys).select(*_IN)
    fold = (_day_fold if replay == "day" else _fold)(config or RatingConfig(), keep)
    return rows.mapInArrow(fold, f"{_OUT}, {STATE}" if keep else _OUT)


def pre_match_ratings(matches: DataFrame, row_id: str = "row_id", universe: str | None = None, replay: str = "day", config: RatingConfig | None = None, states: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Both sides' ratings before each match: ``row_id``, ``w_*`` and ``l_*`` per family, ``expected``; ``place`` names a column for its place in the order of its universe.

    ``matches`` is canonical. With ``replay="day"`` all matches of one ``proxy_date`` see the state
    from before that day and are applied after it, in order; with ``"row"`` each match sees all
    before it. Matches that are not clean are rated but change nothing. ``universe`` names a column
    of pools of players that never meet; each is folded on its own, in parallel. A rating couples
    every player of a pool to every other, so one pool is inherently one sequence: it is streamed
    in sorted batches through one task, which holds the players' states and never the matches.
    ``states`` (from ``ratings_and_states``) lets the fold go on from an earlier one. Null ranks seed
    at the base; repeated rows are matches of their own; an empty table gives no rows.
    """
    out = _folded(matches, row_id, universe, replay, config, states, False).withColumnRenamed("row_id", row_id)
    return out.withColumnRenamed("place", place) if place else out.drop("place")


def ratings_and_states(matches: DataFrame, row_id: str = "row_id", universe: str | None = None, replay: str = "day", config: RatingConfig | None = None, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``pre_match_ratings``, and the players' states (STATE) at its end, to be saved and taken up again.

    With ``replay="day"`` the last day of each universe is not yet in its states, as more of its
    matches may come: the fold that goes on is given all matches from ``day`` on. One pass makes both.
    """
    both = stage(_folded(matches, row_id, universe, replay, config, states, True))
    ratings = both.where("player is null").drop("universe", "player", "day", "state", "place").withColumnRenamed("row_id", row_id)
    return ratings, both.where("player is not null").select("universe", "player", "day", "state")
