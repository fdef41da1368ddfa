"""Matching entities without keys: sorted neighbourhoods, weighted field similarities, one-to-one assignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.names import link_names, registered_forms, tokens
from rallyframe.operators.skew import lookup_join, skew_join, small
from rallyframe.session import buckets_for, partitions, stage, stage_table, worker_memory

#: Rows of the other table, before and after a row in sorted order, that it is compared with.
WINDOW = 6
#: Days that a quote may lie before and after the start of the event it is for.
EARLY, LATE, WEEK = 9, 14, 6
#: Days of one shard's stretch of time.
STRETCH = 365
#: Confidence from which a match is kept.
CONFIDENT = 0.8
WEIGHTS = {"players": 0.4, "event": 0.35, "date": 0.2, "surface": 0.05}

# Words of event names that tell no event from another.
EVENT_NOISE = frozenset({"atp", "men", "singles", "ch", "chall", "challenger"})
_TOKEN = re.compile(r"[^\W_]+")


def event_words(name: str | None) -> list[str]:
    """The words of an event's name, plain, without those that any event may carry."""
    s = unicodedata.normalize("NFKD", (name or "").casefold())
    return [w for w in _TOKEN.findall("".join(c for c in s if not unicodedata.combining(c))) if w not in EVENT_NOISE]


def _ratio(a: str, b: str) -> float:
    """1 - edits / longer length, with swaps of neighbours as one edit."""
    if a == b:
        return 1.0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return 1.0 - row[-1] / max(len(a), len(b))


def event_similarity(a: str | None, b: str | None) -> float | None:
    """How well two event names fit: shared, shortened or mistyped words; None if either has no words."""
    return words_similarity(event_words(a), event_words(b))


def words_similarity(x: list[str], y: list[str]) -> float | None:
    if not x or not y:
        return None
    have, total = set(y), 0.0
    for w in x:
        if w in have:
            total += 1.0
            continue
        top = 0.0
        for v in y:
            if v.startswith(w) or w.startswith(v):
                top = max(top, 0.85)
            elif min(len(w), len(v)) > 3:
                top = max(top, 0.95 * _ratio(w, v))
        total += top
    words = total / len(x)
    return words if words >= 0.95 else max(words, _ratio("".join(sorted(x)), "".join(sorted(y))))


@dataclass
class Assignment:
    """Best one-to-one pairing of rows and columns of a table of gains, each row left out at gain 0."""

    gains: list[list[float]]
    pairs: dict[int, int] = field(default_factory=dict)

    def solve(self) -> dict[int, int]:
        """Shortest augmenting paths with potentials; exact for any size."""
        rows, real = len(self.gains), len(self.gains[0])
        cols = real + rows  # a private column per row stands for leaving it out
        cost = [[-g for g in r] + [0.0] * rows for r in self.gains]
        u, v, match, way = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1), [0] * (cols + 1)
        for i in range(1, rows + 1):
            match[0], j0 = i, 0
            least, used = [float("inf")] * (cols + 1), [False] * (cols + 1)
            while True:
                used[j0] = True
                i0, delta, j1 = match[j0], float("inf"), 0
                for j in range(1, cols + 1):
                    if not used[j]:
                        cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                        if cur < least[j]:
                            least[j], way[j] = cur, j0
                        if least[j] < delta:
                            delta, j1 = least[j], j
                for j in range(cols + 1):
                    if used[j]:
                        u[match[j]] += delta
                        v[j] -= delta
                    else:
                        least[j] -= delta
                j0 = j1
                if match[j0] == 0:
                    break
            while j0:
                match[j0], j0 = match[way[j0]], way[j0]
        self.pairs = {match[j] - 1: j - 1 for j in range(1, real + 1) if match[j]}
        return self.pairs


_FIELDS = ["side", "id", "a", "b", "day", "event", "surface", "twin"]
_SCHEMA = pa.schema([(c, pa.int64() if c in ("id", "twin") else pa.int32() if c in ("side", "day") else pa.string()) for c in _FIELDS])
_FOUND = pa.schema([("pair", pa.string()), ("l", pa.int64()), ("r", pa.int64()), ("event", pa.string()), ("confidence", pa.float64())])
#: Mark between the words and the id of a linked player's name key.
LINK = "#"


def name_key(name: str | None, player_id: str | None = None) -> str:
    """What a name sorts by: the folded words of a registered name, surname first, and its id; of an unlinked one the words, longest first."""
    if player_id is None:
        return " ".join(sorted(tokens(name or ""), key=lambda w: (-len(w), w)))
    forms = registered_forms(name or "")
    return " ".join(forms[0] if forms else ()) + LINK + player_id


def name_keys(spellings: DataFrame, people: DataFrame) -> DataFrame:
    """``spelling`` and ``key`` of each distinct spelling: that of the registered person it means, else of its own words.

    Spellings that two persons fit alike are not linked.
    """
    texts = stage(spellings.select("spelling").dropna().groupBy("spelling").agg(F.lit(1).alias("x")).select("spelling"))
    links = link_names(texts, people).where("margin is null or margin > 0").select("spelling", "player_id")
    registered = people.where("player_id is not null and name is not null").groupBy("player_id").agg(F.min("name").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(3)]
            keys = [name_key(n if n is not None else t, i if n is not None else None) for t, i, n in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string())], names=["spelling", "key"])

    met = texts.join(lookup_join(links, registered, ["player_id"]), "spelling", "left").select("spelling", "player_id", "name")
    return stage(met.mapInArrow(run, "spelling string, key string"))


def _neighbourhood(left: DataFrame, right: DataFrame, shard: F.Column, order: list[F.Column], days: int = STRETCH) -> DataFrame:
    """Both tables sorted together by ``order``, within shards of a key and a stretch of ``days``.

    A right row near the edge of its stretch stands in the next ones too, so each shard has every
    neighbour that its left rows may be about, and a key that holds a third of the rows is many shards.
    """
    stretch = lambda d: F.floor(d / F.lit(days)).cast("int")
    ask = left.withColumns({"side": F.lit(0), "stretch": stretch(F.col("day"))})
    have = right.withColumns({"side": F.lit(1), "stretch": F.explode(F.sequence(stretch(F.col("day") - EARLY), stretch(F.col("day") + LATE)))})
    rows = ask.unionByName(have).where(shard.isNotNull()).select(F.xxhash64(shard).alias("key"), "stretch", *_FIELDS)
    return rows.repartition(partitions(left.sparkSession), "key", "stretch").sortWithinPartitions("key", "stretch", *order, "side", "id")


#: Similarities of event names that a worker remembers, over all its tasks, before it forgets them all.
_MEMORY = 500_000


def _event_fit(a: str, b: str) -> float:
    fits = worker_memory("events")
    x = fits.get((a, b))
    if x is None:
        if len(fits) >= _MEMORY:
            fits.clear()
        s = event_similarity(a, b)
        x = fits[a, b] = np.nan if s is None else s
    return x


class Scorer:
    """Confidences of pairs of rows, worked by column: each distinct pair of names and of event names once."""

    def __init__(self, left: pa.Table, right: pa.Table) -> None:
        self.n = left.num_rows
        both = pa.concat_tables([left.select(_FIELDS), right.select(_FIELDS)])
        self.day = both.column("day").to_numpy().astype(np.int64)
        people = pa.chunked_array([*both.column("a").chunks, *both.column("b").chunks], pa.string()).combine_chunks().dictionary_encode()
        code = people.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.a, self.b = code[: len(self.day)], code[len(self.day) :]
        keys = people.dictionary.to_pylist()
        self.linked = np.array([LINK in k for k in keys] + [False])
        self.keys = keys
        self.alike: dict[int, float] = {}
        self.event, self.events = self._codes(both, "event")
        self.surface, _ = self._codes(both, "surface")

    @staticmethod
    def _codes(t: pa.Table, c: str) -> tuple[np.ndarray, list]:
        d = t.column(c).combine_chunks().dictionary_encode()
        return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()

    def name_similarity(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """1 for equal keys; else, where a side is not linked, from 0.8 by edits; 0 where names are missing, too far apart or of two linked persons."""
        out = np.zeros(len(x))
        out[(x == y) & (x >= 0)] = 1.0
        open_ = np.flatnonzero((x != y) & (x >= 0) & (y >= 0) & ~(self.linked[x] & self.linked[y]))
        if len(open_):
            pairs, back = np.unique(x[open_] * len(self.keys) + y[open_], return_inverse=True)
            for p in pairs.tolist():
                if p not in self.alike:
                    m, w = [" ".join(sorted(self.keys[i].split(LINK)[0].split())) for i in divmod(p, len(self.keys))]
                    # A name much longer than the other is not worth its edits.
                    near = bool(m and w) and min(len(m), len(w)) >= 0.59 * max(len(m), len(w))
                    s = 0.5 + 0.5 * _ratio(m, w) if near else 0.0
                    self.alike[p] = s if s >= 0.8 else 0.0
            out[open_] = np.array([self.alike[p] for p in pairs.tolist()])[back]
        return out

    def players(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The mean similarity of both players in the better of the two ways round; 0 if either player is unlike."""
        a1, b1, a2, b2 = self.a[i], self.b[i], self.a[j], self.b[j]
        best = np.zeros(len(i))
        same = (a1 == a2) & (b1 == b2) & (a1 >= 0) & (b1 >= 0)
        best[same] = 1.0
        # Four linked players that are not the same two are at odds.
        rest = np.flatnonzero(~same & ~(self.linked[a1] & self.linked[b1] & self.linked[a2] & self.linked[b2]))
        for x, y in ((a2, b2), (b2, a2)):
            one = self.name_similarity(a1[rest], x[rest])
            some = np.flatnonzero(one)
            two = self.name_similarity(b1[rest[some]], y[rest[some]])
            best[rest[some]] = np.maximum(best[rest[some]], np.where(two > 0, 0.5 * (one[some] + two), 0.0))
        return best

    def confidence(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Weighted similarity of left rows ``i`` and right rows ``j``: players, event, date and surface, over what both have."""
        j = j + self.n
        gap = self.day[i] - self.day[j]
        out = np.zeros(len(i))
        ok = np.flatnonzero((gap >= -EARLY) & (gap <= LATE))
        players = self.players(i[ok], j[ok])
        some = players > 0
        ok, players, gap = ok[some], players[some], gap[ok[some]]
        i, j = i[ok], j[ok]
        off = np.where(gap < 0, -gap, np.maximum(gap - WEEK, 0))
        weight = np.full(len(ok), WEIGHTS["players"] + WEIGHTS["date"])
        total = WEIGHTS["players"] * players + WEIGHTS["date"] * np.maximum(1.0 - off / 12.0, 0.0)
        named = np.flatnonzero((self.event[i] >= 0) & (self.event[j] >= 0))
        pairs, back = np.unique(self.event[i[named]] * len(self.events) + self.event[j[named]], return_inverse=True)
        fits = [_event_fit(self.events[p // len(self.events)], self.events[p % len(self.events)]) for p in pairs.tolist()]
        event = np.array(fits)[back] if len(named) else np.empty(0)
        named, event = named[~np.isnan(event)], event[~np.isnan(event)]
        weight[named] += WEIGHTS["event"]
        total[named] += WEIGHTS["event"] * event
        placed = (self.surface[i] >= 0) & (self.surface[j] >= 0)
        weight[placed] += WEIGHTS["surface"]
        total[placed] += WEIGHTS["surface"] * (self.surface[i] == self.surface[j])[placed]
        out[ok] = total / weight
        return out


def _found(left: pa.Table, right: pa.Table, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.Table:
    """Candidate pairs with a confidence over a half; a right row stands for the smallest id of its twins here."""
    keep = np.flatnonzero(score > 0.5)
    _, which = np.unique(right.column("twin").to_numpy(), return_inverse=True)
    least = np.full(len(which), np.iinfo(np.int64).max)
    np.minimum.at(least, which, right.column("id").to_numpy())
    mine, theirs = left.take(pa.array(i[keep])), right.take(pa.array(j[keep]))
    pair = pc.binary_join_element_wise(theirs.column("a").fill_null(""), theirs.column("b").fill_null(""), "|")
    return pa.table([pair, mine.column("id"), pa.array(least[which][j[keep]]), mine.column("event"), pa.array(score[keep])], schema=_FOUND)


def _windows(window: int, rows: int = 200_000):
    """Compare each left row of a sorted stream with the ``window`` right rows before and after it; edges of what is held are carried over."""

    def compare(t: pa.Table, carried: bool, last: bool) -> tuple[pa.Table, pa.Table]:
        side = t.column("side").to_numpy()
        left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        m = right.num_rows
        place = np.cumsum(side)[side == 0]  # right rows before each left row
        due = np.ones(len(place), dtype=bool) if not carried else place > window
        if not last:
            due &= place <= m - window
        pairs = []
        for shift in range(-window, window):
            i = np.flatnonzero(due & (place + shift >= 0) & (place + shift < m))
            pairs.append((i, place[i] + shift))
        i, j = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        # Right rows that the last left rows still wait for, and as many before them.
        at = 0 if m <= 2 * window else int(np.flatnonzero(side)[m - 2 * window])
        return _found(left, right, i, j, Scorer(left, right).confidence(i, j)), t.slice(at) if not last else t.slice(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried = _SCHEMA.empty_table(), False
        for b in batches:
            if b.num_rows:
                held = pa.concat_tables([held, pa.Table.from_batches([b]).select(_FIELDS).cast(_SCHEMA)])
                if held.num_rows >= rows and pc.sum(held.column("side")).as_py() > 4 * window:
                    out, rest = compare(held, carried, False)
                    yield from out.to_batches()
                    # With few right rows the tail is the whole, and is compared again from its start.
                    carried, held = rest.num_rows < held.num_rows or carried, rest
        if held.num_rows:
            yield from compare(held, carried, True)[0].to_batches()
        yield from _FOUND.empty_table().to_batches()

    return run


def _shards(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Whole shards (equal key and stretch, which stand together) of a sorted stream, some at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        key, stretch = [t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("key", "stretch")]
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(stretch) != 0)) + 1
        if len(new):
            yield t.slice(0, new[-1])
            held = t.slice(new[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _within_dates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs within the dates of a shard of one known player in which another player is not linked: a window as wide as the dates."""
    for t in _shards(batches):
        key, stretch = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("stretch").to_numpy()
        shard = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(stretch) != 0))])
        t = t.select(_FIELDS).cast(_SCHEMA)
        side, day = t.column("side").to_numpy(), t.column("day").to_numpy().astype(np.int64)
        left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        if not left.num_rows or not right.num_rows:
            continue
        scorer = Scorer(left, right)
        sure = scorer.linked[scorer.a] & scorer.linked[scorer.b]
        place = shard * (1 << 26) + day + (1 << 25)
        mine, theirs = place[side == 0], place[side == 1]
        for ask, have in ((~sure[: left.num_rows], np.ones(right.num_rows, bool)), (sure[: left.num_rows], ~sure[left.num_rows :])):
            i, j = np.flatnonzero(ask), np.flatnonzero(have)
            # Within a shard right rows are sorted by day.
            low = np.searchsorted(theirs[j], mine[i] - LATE, side="left")
            count = np.maximum(np.searchsorted(theirs[j], mine[i] + EARLY, side="right") - low, 0)
            work = np.cumsum(count)
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(work // 1_000_000)) + 1):
                k = count[part]
                a = np.repeat(i[part], k)
                b = j[np.repeat(low[part], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)]
                yield from _found(left, right, a, b, scorer.confidence(a, b)).to_batches()
    yield from _FOUND.empty_table().to_batches()


def _assign(confident: float):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*[t.column(c).to_pylist() for c in ("pair", "l", "r", "event", "confidence")], strict=True), key=lambda x: (x[0], x[1], -x[4], x[2]))
        out: dict[int, tuple[float, int]] = {}
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            _assign_pair(rows[at:end], confident, out)
            at = end
        return pa.table({"l": pa.array(list(out), pa.int64()), "r": pa.array([r for _, r in out.values()], pa.int64()), "confidence": pa.array([c for c, _ in out.values()], pa.float64())})

    return run


def _assign_pair(rows: list[tuple], confident: float, out: dict[int, tuple[float, int]]) -> None:
    """Assign the fixtures of one pair of players: fixtures of one event are one, and events go to results one to one.

    An event whose result went to another spelling of it keeps that result too: repeated quotes count.
    """
    score: dict[int, dict[int, float]] = {}
    event: dict[int, str] = {}
    for _, l, r, e, c in rows:
        score.setdefault(l, {})[r] = max(c, score.get(l, {}).get(r, 0.0))
        event[l] = " ".join(sorted(event_words(e)))
    best = {l: min(s, key=lambda r: (-s[r], r)) for l, s in score.items()}
    groups: dict[tuple, list[int]] = {}
    for l in score:
        groups.setdefault((event[l], best[l]) if event[l] else ("", best[l]), []).append(l)
    taken: dict[tuple, int] = {}
    if len(set(best.values())) > 1 or len(groups) > 1:
        # Results are linked if a group of fixtures may be for either; each linked part is solved alone.
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        gain = {g: {r: sum(score[l].get(r, 0.0) for l in ls) / len(ls) for r in {r for l in ls for r in score[l]}} for g, ls in groups.items()}
        for g in gain.values():
            rs = list(g)
            for r in rs[1:]:
                parent[find(rs[0])] = find(r)
        parts: dict[int, list[tuple]] = {}
        for g in gain:
            parts.setdefault(find(next(iter(gain[g]))), []).append(g)
        for gs in parts.values():
            rs = sorted({r for g in gs for r in gain[g]})
            if len(rs) > 1:
                found = Assignment([[gain[g].get(r, 0.0) for r in rs] for g in gs]).solve()
                used = {rs[j] for j in found.values()}
                for i, j in sorted(found.items(), key=lambda x: rs[x[1]]):
                    # Of results that gain the same, such as copies, the smallest id that is free.
                    mine = gain[gs[i]]
                    if rs[j] not in mine:
                        continue
                    r = min(x for x in mine if abs(mine[x] - mine[rs[j]]) < 1e-12 and (x == rs[j] or x not in used))
                    used = (used - {rs[j]}) | {r}
                    taken[gs[i]] = r
    for g, ls in groups.items():
        for l in ls:
            r = taken.get(g, best[l])
            if score[l].get(r, 0.0) < max(confident, score[l][best[l]] - 0.05):
                r = best[l]
            c = score[l][r]
            if c >= confident and c > out.get(l, (0.0, 0))[0]:
                out[l] = (c, r)


def match_events(left: DataFrame, right: DataFrame, window: int = WINDOW, confident: float = CONFIDENT, rows_per_bucket: int = 200_000) -> DataFrame:
    """The row of ``right`` that each row of ``left`` is about: ``l``, ``r`` (ids) and ``confidence`` (0 to 1).

    Both tables have ``id`` (bigint), ``k1`` and ``k2`` (the players' name keys, see ``name_key``),
    ``day`` (date), ``event`` and ``surface``; ``right`` may have ``twin``, a number shared by rows
    that are one thing written again (they must agree in players and day): the smallest id of them
    stands for all. Rows of a table that are equal but for ``id`` should be given once
    (``match_quotes`` sees to the quotes). Name keys are unordered: ``a`` is the smaller, ``b`` the other.

    The tables are sorted together by several composite keys, and each left row is compared with its
    neighbours of the right table in each order:
      1. all rows by (a, b, day, event), ``window`` rows before and after;
      2. rows with one linked player, and all they may be about, by (linked player, day), all within
         the dates, so that no player is too busy for the window;
      3. rows without a linked player, with all rows of their weeks, by (event, words of both names,
         day), by (words, event, day) and by the words from the last on, ``window`` rows before and after.
    Pairs within the dates' tolerance whose players are alike both (the same key, or names few edits
    apart where a side is not linked) get a confidence, the weighted mean of the similarities of
    players, event, date and surface over the fields that both have. Candidates are then assigned per
    pair of players so that total confidence is largest with each event of left going to one row of
    right; ties go to the smaller id. Rows without an id or day match nothing, nulls elsewhere lower
    what can be compared, and either table may be empty.

    Each order is cut into shards of a key and a stretch of days, with right rows near an edge on
    both sides of it, which keeps a hot player, event or week off one task; sorted rows are streamed.
    ``right`` is read once for each order, so it should be a table.
    """
    def slim(df: DataFrame) -> DataFrame:
        keys = [F.when(F.col(k) != "", F.col(k)) for k in ("k1", "k2")]
        twin = F.col("twin") if "twin" in df.columns else F.col("id").cast("long")
        ordered = [F.least(*keys).alias("a"), F.when(keys[0].isNotNull() & keys[1].isNotNull(), F.greatest(*keys)).alias("b")]
        return df.select(F.col("id").cast("long").alias("id"), *ordered, F.unix_date(F.col("day").cast("date")).alias("day"), "event", "surface", twin.alias("twin")).where("id is not null and day is not null and a is not null and b is not null")

    left, right = slim(left), slim(right)
    schema = "pair string, l long, r long, event string, confidence double"
    day, event = F.col("day"), F.coalesce(F.lower("event"), F.lit(""))
    first = F.concat_ws("|", "a", F.substring("b", 1, 3))
    found = _neighbourhood(left, right, first, [F.col("b"), day, event]).mapInArrow(_windows(window), schema)
    known = F.col("a").contains(LINK).cast("int") + F.col("b").contains(LINK).cast("int")
    x = F.when(F.col("a").contains(LINK), F.col("a")).otherwise(F.col("b"))
    cell = F.floor(day / (EARLY + LATE))
    unsure = [stage(df.where(known < 2)) for df in (left, right)]

    def around(df: DataFrame, other: DataFrame, player: bool) -> DataFrame:
        """Rows that those of the other table with as few linked players may be about."""
        near = other.where(known == (1 if player else 0)).select(*([x.alias("x")] if player else []), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
        rows = df.where(known == 2).withColumn("x", F.explode(F.array("a", "b"))) if player else df.where(known > 0)
        return rows.withColumn("cell", cell).join(small(near), ["x", "cell"] if player else ["cell"], "left_semi").drop("cell")

    for player in (True, False):
        few = [df.where(known == (1 if player else 0)) for df in unsure]
        met = [df.limit(1).count() > 0 for df in few]
        if not any(met):
            continue
        sides = []
        for own, df, i in ((few[0], left, 1), (few[1], right, 0)):
            own = own.withColumn("x", x) if player else own
            others = around(df, unsure[i], player) if met[i] else own.limit(0)
            sides.append(own.unionByName(others.select(*own.columns)))
        sides = [stage(df) for df in sides]
        if player:
            found = found.unionByName(_neighbourhood(*sides, F.col("x"), [day], days=WEEK + 1).mapInArrow(_within_dates, schema))
        else:
            words = F.array_sort(F.split(F.concat_ws(" ", *[F.substring_index(k, LINK, 1) for k in ("a", "b")]), " "))
            up, down = F.array_join(words, " "), F.array_join(F.reverse(words), " ")
            for order in ([event, up], [up, event], [down, event]):
                found = found.unionByName(_neighbourhood(*sides, F.substring(order[0], 1, 2), [*order, day], days=WEEK + 1).mapInArrow(_windows(window), schema))
    # A pair of players is a group of work from here on, so a hash of it does: two in one group stay apart by their results.
    found = stage(found.groupBy(F.xxhash64("pair").alias("pair"), "l", "r", "event").agg(F.max("confidence").alias("confidence")))
    b = buckets_for(found.count(), rows_per_bucket, left.sparkSession)
    chosen = found.groupBy(F.pmod(F.xxhash64("pair"), F.lit(b)).alias("b")).applyInArrow(_assign(confident), "l long, r long, confidence double")
    return chosen.groupBy("l").agg(F.max(F.struct("confidence", (-F.col("r")).alias("r"))).alias("x")).select("l", (-F.col("x.r")).alias("r"), F.round("x.confidence", 6).alias("confidence"))


def match_quotes(quotes: DataFrame, results: DataFrame, **options) -> DataFrame:
    """``match_events`` for quotes that may stand many times: ``l``, ``r``, ``confidence``.

    Quotes that agree in players' keys, day, event and surface are compared once, by their smallest
    id, and the answer goes to all of them.
    """
    by = ["k1", "k2", "day", "event", "surface"]
    q = quotes.withColumns({"k1": F.least("k1", "k2"), "k2": F.greatest("k1", "k2")}).where("k1 is not null and k2 is not null and day is not null")
    filled = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in by]
    mark = ["h1", "h2"]  # 128 bits of the columns in ``by``
    q = stage_table(q.select("id", *by, F.xxhash64(*filled).alias("h1"), F.xxhash64(F.lit(2), *filled).alias("h2")))
    one = stage_table(q.groupBy(*mark, *by).agg(F.min("id").alias("id")))
    found = match_events(one.drop(*mark), results, **options)
    answers = one.select(*mark, F.col("id").alias("l")).join(found, "l").drop("l")
    return skew_join(q.select(F.col("id").alias("l"), *mark), answers, mark).select("l", "r", "confidence")
