"""Tree ensembles of walk-forward windows: boosting, extra trees and random forests, each window's grown within one task.

A window's rows travel to a task once and are held there (a float and a byte per column, and as much for the
mirrors); windows are grown in parallel, a forest of few windows also by ranges of its trees. What comes back is the trees.
"""

from __future__ import annotations

import base64
import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.features import DIFF_FEATURES

#: A column's values are told apart by up to so many bins (boosting and random forests; extra trees cut the values themselves).
BINS = 255
#: Rows of training that travel to tasks at once, over all windows of a wave (one window at least).
WAVE_ROWS = 1_000_000
#: Rows whose values are looked at at once, so that what a cut needs besides the rows stays small.
STEP = 20_000


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Cuts between the values of a column: between all neighbours, or at quantiles where there are more than ``BINS`` values."""
    values = np.unique(x).astype(float)
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.percentile(x.astype(float), np.linspace(0, 100, BINS + 1)[1:-1], method="midpoint"))


def _best_cuts(bins: np.ndarray, rows: np.ndarray, columns: np.ndarray | None, local: np.ndarray, m: int, a: np.ndarray, b: np.ndarray, least: int, pull: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the greatest a^2 / (b + pull) over both sides of a cut (-inf if there is none), its column's place and last bin on the left.

    Of ``rows``, ``local`` has the nodes 0 to m - 1 (none empty), ``a`` and ``b`` what is summed; ``columns`` has
    the columns to try of each node (None: all).
    """
    f = bins.shape[1] if columns is None else columns.shape[1]
    n, sums = np.zeros(m * f * 256, np.int64), np.zeros((2, m * f * 256))
    for i in range(0, len(rows), STEP):
        own, at = rows[i : i + STEP], local[i : i + STEP]
        key = ((bins[own] if columns is None else bins[own[:, None], columns[at]]) + (at[:, None] * f + np.arange(f)) * 256).ravel()
        n += np.bincount(key, minlength=len(n))
        for total, v in zip(sums, (a, b), strict=True):
            total += np.bincount(key, np.repeat(v[i : i + STEP], f), len(n))
    cell = np.flatnonzero(n)
    group = cell // 256
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size, node = np.diff(np.r_[first, len(cell)]), group // f

    def left(v: np.ndarray) -> np.ndarray:
        total = np.cumsum(v)
        return total - np.repeat(total[first] - v[first], size)

    nl, al, bl = left(n[cell]), left(sums[0][cell]), left(sums[1][cell])
    nr, ar, br = [np.bincount(local, v, m)[node] - x for v, x in ((None, nl), (a, al), (b, bl))]
    ok = (nl >= least) & (nr >= least)
    gain = np.full(len(cell), -np.inf)
    gain[ok] = al[ok] ** 2 / (bl[ok] + pull) + ar[ok] ** 2 / (br[ok] + pull)
    top = np.maximum.reduceat(gain, np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
    hit = np.flatnonzero(gain == top[node])
    at = cell[hit[np.unique(node[hit], return_index=True)[1]]]
    return top, at // 256 % f, at % 256


def _random_cuts(x: np.ndarray, rows: np.ndarray, columns: np.ndarray, local: np.ndarray, y: np.ndarray, least: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the best of one random cut a column, drawn between the node's least and greatest value. Rows are sorted by node."""
    low, high, nl, yl = np.full(columns.shape, np.inf), np.full(columns.shape, -np.inf), np.zeros(columns.shape, np.int64), np.zeros(columns.shape, np.int64)
    kept = None

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Values, nodes and results of some rows, and where their nodes start."""
        nonlocal kept
        for i in range(0, len(rows), STEP):
            own, at = rows[i : i + STEP], local[i : i + STEP]
            values = x[own[:, None], columns[at]] if kept is None else kept
            kept = values if len(rows) <= STEP else None
            yield values, at, y[i : i + STEP], np.flatnonzero(np.r_[True, at[1:] != at[:-1]])

    for values, at, _, starts in parts():
        low[at[starts]] = np.minimum(low[at[starts]], np.minimum.reduceat(values, starts))
        high[at[starts]] = np.maximum(high[at[starts]], np.maximum.reduceat(values, starts))
    cut = low + rng.random(low.shape) * (high - low)
    cut = np.where(cut >= high, low, cut)
    for values, at, ones, starts in parts():
        goes = values <= cut[at]
        nl[at[starts]] += np.add.reduceat(goes, starts, dtype=np.int64)
        yl[at[starts]] += np.add.reduceat(goes & (ones[:, None] > 0), starts, dtype=np.int64)
    n, ones = [np.bincount(local, v).astype(np.int64)[:, None] for v in (None, y)]
    nr, yr = n - nl, ones - yl
    ok = (nl >= least) & (nr >= least)
    gain = np.where(ok, yl**2 / np.maximum(nl, 1) + yr**2 / np.maximum(nr, 1), -np.inf)
    best = gain.argmax(1)
    at = np.arange(len(best))
    return gain[at, best], best, cut[at, best]


class _Nodes:
    """Nodes of trees; a leaf leads to itself, the children of a node are neighbours."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.value, self.roots, self.depth = [], [], [], [], [], 0

    def add(self, values: np.ndarray) -> int:
        at = len(self.feature)
        self.feature += [0] * len(values)
        self.cut += [np.inf] * len(values)
        self.left += range(at, at + len(values))
        self.value += values.tolist()
        return at

    def split(self, node: int, feature: int, cut: float, values: np.ndarray) -> int:
        at = self.add(values)
        self.feature[node], self.cut[node], self.left[node] = int(feature), float(cut), at
        return at

    def arrays(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature, np.int32), "cut": np.array(self.cut), "left": np.array(self.left, np.int32), "value": np.array(self.value), "roots": np.array(self.roots, np.int32), "depth": np.array(self.depth)}


def _forest(x: np.ndarray, bins: np.ndarray | None, edges: list[np.ndarray], y: np.ndarray, options: dict, trees: range) -> _Nodes:
    """Trees by Gini: with ``bootstrap`` best cuts over bins on rows drawn with replacement, else random cuts on all rows."""
    nodes, (n, k) = _Nodes(), x.shape
    take, least, whole = max(1, int(options["share"] * k)), options["least"], y.astype(np.int64)
    for t in trees:
        rng = np.random.default_rng([options["seed"], t])
        weight = np.bincount(rng.integers(0, n, n), minlength=n).astype(float) if options["bootstrap"] else np.ones(n)
        rows = np.flatnonzero(weight)
        local, ids = np.zeros(len(rows), np.int64), np.array([nodes.add(np.array([weight @ y / weight.sum()]))])
        nodes.roots.append(ids[0])
        for depth in range(options["depth"]):
            count, ones, total = [np.bincount(local, v, len(ids)) for v in (None, (weight * y)[rows], weight[rows])]
            can = (count >= 2 * least) & (ones > 0) & (ones < total)
            rows, local, ids = rows[can[local]], (np.cumsum(can) - 1)[local[can[local]]], ids[can]
            if not len(ids):
                break
            columns = rng.random((len(ids), k)).argsort(1)[:, :take]
            if options["bootstrap"]:
                gain, place, at = _best_cuts(bins, rows, columns, local, len(ids), (weight * y)[rows], weight[rows], least, 0.0)
                feature = columns[np.arange(len(ids)), place]
                cut = np.array([edges[f][b] if np.isfinite(g) else 0.0 for f, b, g in zip(feature, at, gain, strict=True)])
            else:
                order = np.argsort(local, kind="stable")
                rows, local = rows[order], local[order]
                gain, place, cut = _random_cuts(x, rows, columns, local, whole[rows], least, rng)
                feature = columns[np.arange(len(ids)), place]
            found = np.isfinite(gain)
            rows, local = rows[found[local]], (np.cumsum(found) - 1)[local[found[local]]]
            if not len(rows):
                break
            ids, feature, cut = ids[found], feature[found], cut[found]
            local = 2 * local + (x[rows, feature[local]] > cut[local])
            values = np.bincount(local, (weight * y)[rows], 2 * len(ids)) / np.bincount(local, weight[rows], 2 * len(ids))
            first = [nodes.split(*s, values[2 * i : 2 * i + 2]) for i, s in enumerate(zip(ids, feature, cut, strict=True))]
            ids, nodes.depth = np.column_stack([first, np.array(first) + 1]).ravel(), max(nodes.depth, depth + 1)
    return nodes


def _boost(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, options: dict, trees: range) -> tuple[_Nodes, float]:
    """Newton boosting of the log-loss; each tree splits the leaf with the greatest gain first, up to so many leaves."""
    nodes, least, l2 = _Nodes(), options["least"], options["l2"]
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    prior = np.log(mean / (1 - mean))
    raw = np.full(len(y), prior)
    for _ in trees:
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        rows = {nodes.add(np.zeros(1)): np.arange(len(y))}
        root = next(iter(rows))
        nodes.roots.append(root)
        depth, ahead = {root: 0}, []

        def look(leaves: list[int], rows=rows, g=g, h=h, ahead=ahead) -> None:
            leaves = [i for i in leaves if len(rows[i]) >= 2 * least]
            if leaves:
                all_rows = np.concatenate([rows[i] for i in leaves])
                local = np.repeat(np.arange(len(leaves)), [len(rows[i]) for i in leaves])
                top, column, at = _best_cuts(bins, all_rows, None, local, len(leaves), g[all_rows], h[all_rows], least, l2)
                top = top - np.bincount(local, g[all_rows]) ** 2 / (np.bincount(local, h[all_rows]) + l2)
                for i, *cut in zip(leaves, top, column, at, strict=True):
                    if cut[0] > 0:
                        heapq.heappush(ahead, (-cut[0], i, cut[1], cut[2]))

        look([root])
        while ahead and len(rows) < options["leaves"]:
            _, i, column, at = heapq.heappop(ahead)
            own = rows.pop(i)
            right = bins[own, column] > at
            j = nodes.split(i, column, edges[column][at], np.zeros(2))
            rows[j], rows[j + 1] = own[~right], own[right]
            depth[j] = depth[j + 1] = depth[i] + 1
            nodes.depth = max(nodes.depth, depth[j])
            if len(rows) < options["leaves"]:
                look([j, j + 1])
        for i, own in rows.items():
            nodes.value[i] = -options["rate"] * g[own].sum() / (h[own].sum() + l2)
            raw[own] += nodes.value[i]
    return nodes, float(prior)


@dataclass
class Grown:
    """A tree ensemble behind median imputation, grown by ``grow_windows``.

    Kinds: ``boost`` (options trees, rate, leaves, least, l2) and ``forest`` (trees, depth, least, share of the
    columns tried a node, bootstrap, seed); a forest without bootstrap is one of extra trees.
    """

    columns: list[str]
    kind: str
    options: dict
    model: dict[str, np.ndarray] | None = None

    def fit(self, df: DataFrame, target: str = "target") -> Grown:
        """Fit on all rows of ``df``."""
        grow_windows([[self]], df, F.lit(0), [(0, 1)], target=target)
        return self

    def grown(self, x: np.ndarray, y: np.ndarray, prepared: tuple, trees: range) -> dict[str, np.ndarray]:
        """Some of the trees, on rows without gaps."""
        nodes, prior = _boost(x, *prepared, y, self.options, trees) if self.kind == "boost" else (_forest(x, *prepared, y, self.options, trees), 0.0)
        return nodes.arrays() | {"prior": np.array(prior)}

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the lines of ``x`` (columns in order, NaN where missing)."""
        m, out = self.model, np.empty(len(x))
        x = np.where(np.isnan(x), m["fill"], x).astype(np.float32)
        step = max(1, 1_000_000 // len(m["roots"]))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            line, at = np.arange(len(part))[:, None], np.repeat(m["roots"][None, :], len(part), 0)
            for _ in range(int(m["depth"])):
                at = m["left"][at] + (part[line, m["feature"][at]] > m["cut"][at])
            out[i : i + step] = 1 / (1 + np.exp(-(m["prior"] + m["value"][at].sum(1)))) if self.kind == "boost" else m["value"][at].mean(1)
        return out

    def symmetric_scores(self, x: np.ndarray) -> np.ndarray:
        """The mean of a line's probability and one minus its mirror's."""
        return (self.scores(x) + 1 - self.scores(x * _sign(self.columns))) / 2

    def predict(self, df: DataFrame, to: str) -> DataFrame:
        return df.withColumn(to, _scored({0: self}, "scores")(F.lit(0), _values(self.columns)))

    def to_json(self) -> str:
        file = io.BytesIO()
        np.savez_compressed(file, **self.model)
        return base64.b64encode(file.getvalue()).decode()

    def from_json(self, text: str) -> Grown:
        self.model = _loaded(base64.b64decode(text))
        return self


def _loaded(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return dict(file)


def _sign(columns: list[str]) -> np.ndarray:
    return np.array([-1.0 if c in DIFF_FEATURES else 1.0 for c in columns])


def _values(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])


def _scored(models: dict[int, Grown], way: str):
    """A function of (key, values) -> the probability by the key's model."""

    @F.pandas_udf("double")
    def run(key: pd.Series, values: pd.Series) -> pd.Series:
        keys, out = key.to_numpy(), np.empty(len(key))
        for k in np.unique(keys):
            at = np.flatnonzero(keys == k)
            out[at] = getattr(models[k], way)(np.stack(values.to_numpy()[at]))
        return pd.Series(out)

    return run


def predict_windows(models: dict[int, dict[str, Grown]], df: DataFrame, key: Column, clip: float) -> DataFrame:
    """``df`` with ``p_<name>`` by the models of each row's ``key``, alike from both sides and kept ``clip`` from 0 and 1."""
    for name, first in next(iter(models.values())).items():
        p = _scored({k: ms[name] for k, ms in models.items()}, "symmetric_scores")(key, _values(first.columns))
        df = df.withColumn(f"p_{name}", F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))
    return df


def _units(models: list[Grown], shares: int) -> list[list[tuple[int, int, int]]]:
    """The work of a window in ``shares`` or so units: (model, first tree, end) each; trees of a boost stay together."""
    if shares <= 1:
        return [[(i, 0, m.options["trees"]) for i, m in enumerate(models)]]
    out = []
    for i, m in enumerate(models):
        n = m.options["trees"]
        step = n if m.kind == "boost" else -(-n // shares)
        out += [[(i, a, min(a + step, n))] for a in range(0, n, step)]
    return out


def grow_windows(models: list[list[Grown]], df: DataFrame, key: Column, windows: list[tuple[int, int]], mirrored: bool = False, target: str = "target", tasks: int | None = None) -> None:
    """Grow each window's models on the rows whose integer ``key`` is from the window's start to before its end.

    A window's rows go to one task (to some, by ranges of trees, where there are fewer windows than
    ``tasks``, by default as many as run at once); with ``mirrored`` every row also counts as its mirror with the opposite target. Missing
    values take the window's medians. What is grown depends on the rows and the seeds alone, not on
    the order of the rows or the number of tasks.
    """
    columns = list(dict.fromkeys(c for ms in models for m in ms for c in m.columns))
    spark, k, sign = df.sparkSession, len(columns), _sign(columns)
    shares = -(-(tasks or spark.sparkContext.defaultParallelism) // len(windows))
    work = [(j, unit) for j, ms in enumerate(models) for unit in _units(ms, shares)]
    plain = [[Grown(m.columns, m.kind, m.options) for m in ms] for ms in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            slot = b.column(0).to_numpy()
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float32) for c in b.columns[1:]])
            for s in np.unique(slot):
                held.setdefault(int(s), []).append(rows[slot == s])
        for s in list(held):
            rows = np.concatenate(held.pop(s))
            rows = rows[np.lexsort(rows.T)]
            y, x = rows[:, 0].astype(float), rows[:, 1:]
            del rows
            if mirrored:
                y, x = np.r_[y, 1 - y], np.vstack([x, x * sign.astype(np.float32)])
            x = np.ascontiguousarray(x)
            gaps = np.isnan(x)
            fill = np.array([float(np.median(x[~gaps[:, c], c])) if not gaps[:, c].all() else 0.0 for c in range(k)])
            for c in np.flatnonzero(gaps.any(0)):
                x[gaps[:, c], c] = fill[c]
            del gaps
            j, unit = work[s]
            edges, bins = [], None
            if any(plain[j][i].options.get("bootstrap", True) for i, *_ in unit):
                edges = [bin_edges(x[:, c]) for c in range(k)]
                bins = np.empty(x.shape, np.uint8)
                for c, e in enumerate(edges):
                    bins[:, c] = np.searchsorted(e, x[:, c].astype(float))
            for i, a, z in unit:
                m, file = plain[j][i], io.BytesIO()
                own = [columns.index(c) for c in m.columns]
                mine = (x, fill, bins, edges) if own == list(range(k)) else (x[:, own], fill[own], None if bins is None else bins[:, own], [edges[c] for c in own] if edges else [])
                np.savez_compressed(file, fill=mine[1], **m.grown(mine[0], y, mine[2:], range(a, z)))
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([i]), pa.array([a]), pa.array([file.getvalue()], pa.binary())], names=["j", "i", "a", "model"])

    slots = F.array_compact(F.array(*[F.when((F.col("at__") >= windows[j][0]) & (F.col("at__") < windows[j][1]), F.lit(s)) for s, (j, _) in enumerate(work)]))
    rows = df.where(F.col(target).isNotNull()).withColumn("at__", key.cast("long")).where((F.col("at__") >= min(a for a, _ in windows)) & (F.col("at__") < max(z for _, z in windows)))
    rows = rows.select(F.explode(slots).alias("slot__"), F.col(target).cast("float").alias("y"), *[F.col(c).cast("float").alias(f"x{i}") for i, c in enumerate(columns)])
    found = rows.repartitionById(len(work), "slot__").mapInArrow(run, "j long, i long, a long, model binary").toArrow().to_pylist()
    for j, ms in enumerate(models):
        for i, m in enumerate(ms):
            parts = [_loaded(r["model"]) for r in sorted((r for r in found if r["j"] == j and r["i"] == i), key=lambda r: r["a"])]
            if not parts:
                raise ValueError("a window has no rows to grow trees on")
            base = np.cumsum([0, *[len(p["feature"]) for p in parts]])
            m.model = {c: np.concatenate([p[c] for p in parts]) for c in ("feature", "cut", "value")} | {c: np.concatenate([p[c] + b for p, b in zip(parts, base, strict=False)]).astype(np.int32) for c in ("left", "roots")}
            m.model |= {"depth": max(p["depth"] for p in parts), "prior": parts[0]["prior"], "fill": parts[0]["fill"]}


def waves(sizes: list[int], rows: int = WAVE_ROWS) -> list[range]:
    """Neighbouring windows of these sizes, in waves of so many rows (or one window)."""
    out, first, total = [], 0, 0
    for j, n in enumerate(sizes):
        if j > first and total + n > rows:
            out, first, total = [*out, range(first, j)], j, 0
        total += n
    return [*out, range(first, len(sizes))]
