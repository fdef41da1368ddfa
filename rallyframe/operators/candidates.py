"""The two best quotes of each row among all within a key and days, with how many there were: met, scored and chosen in buckets, so that no candidate is ever stored."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.blocks import Texts
from rallyframe.functions.names import normalized
from rallyframe.functions.similarity import _in_order
from rallyframe.session import buckets_for

#: Candidates that are worked together.
_MET = 300_000
#: Rows of a bucket, in the mean.
_ROWS = 50_000
#: Events of a bucket up to which it holds a table of those alike.
_EVENTS = 10_000


class _Names:
    """Full and short names of a bucket as numbers of texts, laid out for ``similarity.short_name_similarity``."""

    def __init__(self, texts: Texts, full: list[str], short: list[str]) -> None:
        self.texts = texts
        words = [x.split() for x in full]
        self.full = np.array([texts.add(x) for x in full], np.int64)
        self.own = self._table([[texts.add(w) for w in ws] for ws in words])
        firsts: dict[str, int] = {}
        self.first = np.array([firsts.setdefault("".join(w[0] for w in ws), len(firsts)) for ws in words], np.int64)
        self.short = np.array([texts.add(x) for x in short], np.int64)
        letters: dict[str, int] = {}
        said, initials = [], []
        for x in short:
            ws = x.split()
            cut = max((i for i, w in enumerate(ws, 1) if len(w) > 2), default=0)
            initials.append(letters.setdefault("".join(w[0] for w in ws[cut:]), len(letters)))
            # A name of short words only keeps all but its last as surnames, or its single word; one without initials all words.
            said.append([texts.add(w) for w in (ws[: cut or max(len(ws) - 1, 1)] if ws[cut:] else ws)])
        self.said, self.initials = self._table(said), np.array(initials, np.int64)
        self.count = np.array([len(x) for x in said], float)
        self.empty_full, self.empty_short = [np.array([not x for x in xs], bool) for xs in (full, short)]
        self.letters, self.firsts = list(letters), list(firsts)
        self.shares = np.full(len(letters) * len(firsts), np.nan)
        self.plain = np.array([not x for x in self.letters], bool)

    @staticmethod
    def _table(rows: list[list[int]]) -> np.ndarray:
        out = np.full((len(rows), max(map(len, rows), default=0)), -1, np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def _initials(self, u: np.ndarray, v: np.ndarray, weight: float) -> np.ndarray:
        """Share of a short name's initials that stand in order among a full name's, worked once for each two."""
        code = self.initials[v] * len(self.firsts) + self.first[u]
        out = self.shares[code]
        new = np.unique(code[np.isnan(out)])
        for p in new.tolist():
            a, b = self.letters[p // len(self.firsts)], self.firsts[p % len(self.firsts)]
            self.shares[p] = weight * _in_order(a, b) / len(a) if a else 0.0
        return self.shares[code] if len(new) else out

    def bounds(self, u: np.ndarray, v: np.ndarray, weight: float) -> np.ndarray:
        """No less than ``exact``."""
        named = np.zeros(len(u))
        for a in range(self.said.shape[1]):
            x = self.said[v, a]
            if not a:
                i, best = slice(None), np.zeros(len(u))
            else:
                i = np.flatnonzero(x >= 0)
                best, x = np.zeros(len(i)), x[i]
            for b in range(self.own.shape[1]):
                y = self.own[u[i], b]
                best = np.maximum(best, np.where((x >= 0) & (y >= 0), self.texts.bounds(x, y), 0.0))
            named[i] += best
        return self._sum(u, v, weight, named, self.texts.bounds)

    def _sum(self, u: np.ndarray, v: np.ndarray, weight: float, named: np.ndarray, ratios: Callable) -> np.ndarray:
        named = named / np.maximum(self.count[v], 1.0)
        out = (1 - weight) * named + self._initials(u, v, weight)
        k = np.flatnonzero(self.plain[self.initials[v]])
        out[k] = 0.6 * ratios(self.full[u[k]], self.short[v[k]]) + 0.4 * named[k]
        out[self.full[u] == self.short[v]] = 1.0
        out[self.empty_full[u] | self.empty_short[v]] = 0.0
        return out

    def exact(self, u: np.ndarray, v: np.ndarray, weight: float) -> np.ndarray:
        """Similarity of full names ``u`` and short names ``v``, worked once for each distinct pair."""
        if not len(u):
            return np.empty(0)
        pairs, back = np.unique(u * len(self.short) + v, return_inverse=True)
        u, v = np.divmod(pairs, len(self.short))
        named = np.zeros(len(u))
        for a in range(self.said.shape[1]):
            i = np.flatnonzero(self.said[v, a] >= 0)
            x, own = self.said[v[i], a], self.own[u[i]]
            hope = np.where(own >= 0, self.texts.bounds(x[:, None], own), -1.0)
            best, order, rows = np.zeros(len(i)), np.argsort(-hope, 1), np.arange(len(i))
            for b in range(own.shape[1]):  # words that share more letters first; those that can't beat the best are passed over
                k = np.flatnonzero(hope[rows, order[:, b]] > best)
                best[k] = np.maximum(best[k], self.texts.ratios(x[k], own[k, order[k, b]]))
            named[i] += best
        return self._sum(u, v, weight, named, self.texts.ratios)[back]


def _codes(*columns: pa.ChunkedArray) -> tuple[list[str], list[np.ndarray]]:
    """The distinct texts of several columns, and each column as numbers of them; null counts as the empty text."""
    arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    coded = pa.concat_arrays([a.cast(pa.string()).fill_null("") for a in arrays]).dictionary_encode()
    at = np.cumsum([len(a) for a in arrays])[:-1]
    return coded.dictionary.to_pylist(), np.split(coded.indices.to_numpy().astype(np.int64), at)


def _meet(left: pa.Table, right: pa.Table, days: int, weights, least_event: float = 0.0) -> pa.Table:
    """The lines of ``best_two`` of a bucket's rows and quotes."""
    wp, we, wd, wi = weights.pair, weights.event, weights.date, weights.initials
    ids = left.column("f").combine_chunks(), right.column("q").combine_chunks()
    parts: list[tuple] = []

    def table() -> pa.Table:
        i, j, gap, ev, sw, ps, to, met = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 8
        columns = [ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(gap.astype(np.int32)), pa.array(ev.astype(float)), pa.array(sw.astype(bool)), pa.array(ps.astype(float)), pa.array(to.astype(float)), pa.array(met.astype(np.int64))]
        return pa.Table.from_arrays(columns, names=["f", "q", "gap", "event_similarity", "swapped", "pair_score", "total", "met"])

    if not left.num_rows or not right.num_rows:
        return table()
    texts = Texts()
    full, (na, nb) = _codes(left.column("na"), left.column("nb"))
    short, (n1, n2) = _codes(right.column("n1"), right.column("n2"))
    events, (fe, qe) = _codes(left.column("fevent"), right.column("qevent"))
    names = _Names(texts, full, short)
    event = np.array([texts.add(normalized(x).replace(" challenger", "").strip()) for x in events], np.int64)
    said, code = np.unique(event, return_inverse=True)
    fe, qe = code[fe], code[qe]
    nothing = texts.add("")
    texts.close()
    # Whether two events are alike, where a table of them is of bounded size; -1 until asked.
    alike = np.full(len(said) ** 2 if least_event and len(said) <= _EVENTS else 0, -1, np.int8)

    def event_scores(a: np.ndarray, b: np.ndarray, ratios: Callable) -> np.ndarray:
        a, b = said[a], said[b]
        return np.where((a == nothing) | (b == nothing), 0.0, ratios(a, b))

    def are_alike(code: np.ndarray) -> np.ndarray:
        a, b = np.divmod(code, len(said))
        hope = np.flatnonzero(event_scores(a, b, texts.bounds) >= least_event)
        out = np.zeros(len(code), bool)
        out[hope] = event_scores(a[hope], b[hope], texts.ratios) >= least_event
        return out

    _, (fk, qk) = _codes(left.column("k"), right.column("k"))
    fd, qd = [t.column("d").to_numpy().astype(np.int64) for t in (left, right)]
    fp, qp = [t.column("p").to_numpy().astype(np.int64) for t in (left, right)]
    # A quote stands in each piece that it is near to, so pieces are told apart, too.
    at = np.unique(np.concatenate([fp, qp]))
    span = max(int(np.ptp(np.concatenate([fd, qd]))) + 2 * days + 1, 1)
    first = min(int(fd.min()), int(qd.min())) - days
    place = lambda k, p, d: (k * len(at) + np.searchsorted(at, p)) * span + d - first
    where = place(qk, qp, qd)
    order = np.argsort(where, kind="stable")
    where, fw = where[order], place(fk, fp, fd)
    row = np.lexsort((fe, fw))  # rows that are worked together share keys, days and events
    fw, fd, fe, na, nb, ids = fw[row], fd[row], fe[row], na[row], nb[row], (ids[0].take(pa.array(row)), ids[1])
    lo, hi = np.searchsorted(where, fw - days), np.searchsorted(where, fw + days, "right")
    rank = np.unique(ids[1].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    found = hi - lo
    ends = np.cumsum(found)
    start, total_met = 0, int(ends[-1])
    while start < total_met:
        stop = min(start + _MET, total_met)
        span_of = np.arange(start, stop)
        i = np.searchsorted(ends, span_of, "right")
        j = order[lo[i] + span_of - (ends[i] - found[i])]
        start = stop
        if least_event:
            code = fe[i] * len(said) + qe[j]
            if len(alike):
                new = np.unique(code[alike[code] < 0])
                alike[new] = are_alike(new)
                keep = alike[code] > 0
            else:
                pairs, back = np.unique(code, return_inverse=True)
                keep = are_alike(pairs)[back]
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        gap = np.abs(qd[j] - fd[i])
        near = np.maximum(0.0, 1.0 - gap / (days + 1.0))
        bound = lambda u, v: names.bounds(u, v, wi)
        a, b, c, d = na[i], nb[i], n1[j], n2[j]
        most_direct, most_turned = 0.5 * (bound(a, c) + bound(b, d)), 0.5 * (bound(a, d) + bound(b, c))
        most = wp * np.maximum(most_direct, most_turned) + we * event_scores(fe[i], qe[j], texts.bounds) + wd * near
        by = np.lexsort((-most, i))
        own, begin, size = np.unique(i, return_index=True, return_counts=True)
        done = np.full((4, len(i)), np.nan)  # pair, event, total, swapped

        def score(k: np.ndarray) -> None:
            # The likelier way round first, the other where it may yet be better.
            way = most_turned[k] > most_direct[k]
            x, y = np.where(way, d[k], c[k]), np.where(way, c[k], d[k])
            one = 0.5 * (names.exact(a[k], x, wi) + names.exact(b[k], y, wi))
            open_, two = np.flatnonzero(np.minimum(most_direct[k], most_turned[k]) >= one - 1e-9), np.full(len(k), -1.0)
            two[open_] = 0.5 * (names.exact(a[k[open_]], y[open_], wi) + names.exact(b[k[open_]], x[open_], wi))
            direct, turned = np.where(way, two, one), np.where(way, one, two)
            pair, ev = np.maximum(direct, turned), event_scores(fe[i[k]], qe[j[k]], texts.ratios)
            done[0, k], done[1, k], done[2, k], done[3, k] = pair, ev, wp * pair + we * ev + wd * near[k], turned > direct

        score(by[np.concatenate([begin, begin[size > 1] + 1])])
        # Two of a row's totals are known; whatever may reach the lesser one is scored.
        floor = np.where(size > 1, np.minimum(done[2, by[begin]], done[2, by[np.minimum(begin + 1, len(i) - 1)]]), -1.0)
        score(np.flatnonzero(np.isnan(done[2]) & (most >= np.repeat(floor, size) - 1e-9)))
        k = np.flatnonzero(~np.isnan(done[2]))
        k = k[np.lexsort((rank[j[k]], gap[k], -done[1, k], -done[0, k], -done[2, k], i[k]))]
        head = np.r_[True, i[k][1:] != i[k][:-1]]
        two = head | np.r_[False, head[:-1]]
        met = np.where(head, size[np.searchsorted(own, i[k])], 0)[two]
        k = k[two]
        parts.append((i[k], j[k], gap[k], done[1, k], done[3, k], done[0, k], done[2, k], met))
    return table()


def best_two(f: DataFrame, q: DataFrame, key: str, days: int, weights, tier: str, least_event: float = 0.0) -> DataFrame:
    """For rows ``f`` and quotes ``q`` with equal ``key`` at most ``days`` apart the two best quotes of each row.

    Output: f, q, gap, event_similarity, swapped, pair_score, total, tier and ``met``, which sums up to
    a row's number of candidates. Only candidates whose events are at least ``least_event`` alike
    count. A row has one line or two for each time that it meets quotes, so the best of
    all are among them. Quotes and rows meet in pieces of the calendar. A candidate is compared by
    letters unless the letters that both sides share at all leave it behind two others.
    """
    spark, width = f.sparkSession, days + 1 if least_event else 8 * (days + 1)
    day = lambda c: F.unix_date(c)
    rows = f.where(F.col("fday").isNotNull() & F.col(key).isNotNull()).select("f", F.col(key).alias("k"), day("fday").alias("d"), "fevent", "na", "nb", F.floor(day("fday") / width).alias("p"))
    near = F.array_distinct(F.array(*[F.floor((day("qday") + n) / width) for n in (-days, 0, days)]))
    quotes = q.where(F.col(key).isNotNull()).select("q", F.col(key).alias("k"), day("qday").alias("d"), "qevent", "n1", "n2", F.explode(near).alias("p"))
    buckets = buckets_for(f.count(), _ROWS, spark)
    bucket = F.pmod(F.xxhash64("k", "p"), F.lit(buckets)).alias("b")
    rows, quotes = [x.select("*", bucket) for x in (rows, quotes)]
    shape = f"f {dict(f.dtypes)['f']}, q {dict(q.dtypes)['q']}, gap int, event_similarity double, swapped boolean, pair_score double, total double, met long"

    meet = lambda left, right: _meet(left, right, days, weights, least_event)
    return rows.groupBy("b").cogroup(quotes.groupBy("b")).applyInArrow(meet, shape).withColumn("tier", F.lit(tier))
