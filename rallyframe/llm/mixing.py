"""Mixing sources to target token shares: soft membership, least-squares rates, capped repeats."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.session import stage

#: Where the public tokenizers' files lie; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits a text before byte-pair merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Labelled rows the classifier is fitted on, at most about this many, and its hashed features.
FIT_ROWS, FEATURES = 20_000, 1 << 13
#: Buckets of the two histograms that place each source's rounding threshold.
GRID = 1024
#: Part of the largest possible total that is drawn, so that no source sits on its cap alone.
SLACK = 0.995

_WORD = re.compile(r"[^\W_]+")


def _encoding(folder: str):
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (bigint): the tokens of each whole text; 0 for null or empty.

    The count of one word never depends on its neighbours beyond the pattern's split, so words seen
    before are taken from a bounded memory of their counts. Texts and words of any length are
    tokenized uncut.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    kept = docs.select(*keep, F.col(text).alias("text__"))
    schema = StructType([*[f for f in kept.schema.fields if f.name != "text__"], StructField("tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enc, split, known = _encoding(tokenizers), regex.compile(PATTERN), {}
        for b in batches:
            counts = []
            for t in b.column(len(keep)).to_pylist():
                n = 0
                for m in split.finditer(t or ""):
                    w = m.group()
                    k = known.get(w)
                    if k is None:
                        k = len(enc.encode_ordinary(w))
                        if len(w) < 100:
                            if len(known) > 200_000:
                                known.clear()
                            known[w] = k
                    n += k
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    return kept.mapInArrow(run, schema)


def _features(text: str | None) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) & (FEATURES - 1) for w in _WORD.findall((text or "").lower())), dtype=np.int64)


@dataclass
class SourceClassifier:
    """A multinomial naive Bayes over hashed words, its log odds tempered on held-out rows."""

    sources: list[str]
    prior: np.ndarray
    log_word: np.ndarray
    temper: float

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        """A row of source probabilities per text; the prior for texts without words."""
        out = np.empty((len(texts), len(self.sources)))
        for i, t in enumerate(texts):
            f = _features(t)
            out[i] = self.log_word[:, f].mean(axis=1) if len(f) else 0.0
        z = self.temper * out + np.log(self.prior)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, sources: list[str], text: str = "text", source: str = "source", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> SourceClassifier:
    """Fit on a hash sample of about ``fit_rows`` labelled rows (the documented bound); a fifth of it tempers.

    Word counts are summed per source and feature before they reach the driver: at most
    ``len(sources) * FEATURES`` numbers, whatever the input.
    """
    labelled = docs.where(F.col(source).isin(sources))
    sizes = {r[0]: r[1] for r in labelled.groupBy(source).count().collect()}
    n = sum(sizes.values())
    prior = np.array([sizes.get(s, 0) + 1.0 for s in sources])
    prior /= prior.sum()
    share = min(1.0, fit_rows / n) if n else 0.0
    place = F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1_000_000)) / 1_000_000.0
    sample = stage(labelled.where(place < share).select(F.col(source).alias("s"), F.col(text).alias("t"), (place >= 0.8 * share).alias("held")))
    index = {s: i for i, s in enumerate(sources)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(sources), FEATURES), dtype=np.int64)
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                np.add.at(sums[index[s]], _features(t), 1)
        k, f = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(sums[k, f])], names=["k", "f", "n"])

    rows = sample.where("not held").select("s", "t").mapInArrow(count, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n")).toPandas().to_numpy()
    sums = np.full((len(sources), FEATURES), 0.5)
    if len(rows):
        sums[rows[:, 0].astype(int), rows[:, 1].astype(int)] += rows[:, 2]
    model = SourceClassifier(sources, prior, np.log(sums / sums.sum(axis=1, keepdims=True)), 0.0)
    tempers = [0.0, 1.0, 3.0, 10.0, 30.0, 100.0]

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tempers))
        for b in batches:
            truth = np.array([index[s] for s in b.column(0).to_pylist()], dtype=np.int64)
            texts = b.column(1).to_pylist()
            for i, t in enumerate(tempers):
                p = SourceClassifier(sources, prior, model.log_word, t).posterior(texts)
                total[i] -= np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tempers), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    losses = {r[0]: r[1] for r in sample.where("held").select("s", "t").mapInArrow(loss, "i int, x double").groupBy("i").agg(F.sum("x")).collect()}
    if losses:
        model.temper = tempers[min(losses, key=lambda i: (losses[i], i))]
    return model


def _step_rates(member: np.ndarray, cap: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The rates after all gradient steps so far, from the start of 0: each is projected to [0, cap]."""
    r = np.zeros(len(member))
    for g in steps:
        r = np.clip(r - member @ g, 0.0, cap)
    return r


def _array(b: pa.RecordBatch, i: int, k: int) -> np.ndarray:
    return b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def mix(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizers: str = TOKENIZERS, iterations: int = 100, tolerance: float = 1e-5, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """How often each document is drawn, and a report of the shares reached.

    First result: ``doc_id``, ``source``, ``tokens``, ``rate`` (expected draws), ``copies`` (draws).
    Second: ``source``, ``target_share``, ``expected_share`` and ``actual_share`` of all drawn
    tokens, ``documents`` drawn, ``draws``, ``max_copies``, ``max_repeats``, ``tokens``,
    ``most_tokens`` (what its own documents could give) and ``converged`` (whether the rates settled); tokens of
    documents of unknown source count by their membership, documents and draws by source alone.

    Each document has a soft membership over the sources of ``weights``: its own source if that is
    one of them, the posterior of a classifier trained on the labelled rows if it is null, and none
    if it is a source without a target (never drawn). Rates are found by projected gradient descent
    on the least squares of expected domain tokens against the targets, each rate kept between 0
    and its expected cap; a step is one pass over the staged memberships and one sum per source, so
    the driver sees a vector per step. The total drawn is SLACK times the largest for which every
    source can reach its share with its own labelled documents within their repeats; a source that has
    none is reported with 0 ``most_tokens``, and the others share its part in their proportions. Rates are rounded to whole draws by a per-source threshold
    on a hash of the id, placed by two histograms of bounded size, so no document exceeds its
    ``max_repeats`` and each source misses its tokens by about one document.

    Null or empty texts have no tokens and are never drawn; a repeated id is drawn alike each time; sources with
    the same name in ``weights`` keep the first by order of share; without usable weights or tokens
    all copies are 0. ``weights`` is a stated mix, one row per source, and is read to the driver.
    """
    spark = docs.sparkSession
    listed = weights.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").orderBy(F.desc("target_share"), "source").collect()
    goal: dict[str, tuple[float, int]] = {}
    for s, share, most in listed:
        goal.setdefault(s, (float(share), int(most)))
    sources = sorted(goal)
    k = len(sources)
    if not k:
        empty = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
        return empty, spark.createDataFrame([], "source string, target_share double, expected_share double, actual_share double, documents long, draws long, max_copies int, max_repeats int, tokens long, most_tokens long, converged boolean")
    share = np.array([goal[s][0] for s in sources])
    share /= share.sum()
    most = np.array([goal[s][1] for s in sources], dtype=float)

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    model = fit_classifier(base, sources, "text", "source", "doc_id", fit_rows)
    sized = token_counts(base.where(F.col("source").isNotNull()), ["doc_id", "source"], "text", tokenizers)
    known = sized.withColumn("member", F.array(*[F.when(F.col("source") == s, 1.0).otherwise(0.0) for s in sources]))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.posterior(b.column(2).to_pylist())
            member = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), member], names=["doc_id", "source", "tokens", "member"])

    unknown = token_counts(base.where(F.col("source").isNull()), ["doc_id", "source", "text"], "text", tokenizers)
    state = stage(known.unionByName(unknown.mapInArrow(guess, "doc_id long, source string, tokens long, member array<double>")))

    def totals(steps: np.ndarray) -> np.ndarray:
        """By source: expected tokens at the current rates, at rate 1, and of its own documents at their caps."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, k))
            for b in batches:
                if b.num_rows:
                    m, t = _array(b, 1, k), b.column(0).to_numpy()
                    cap = np.floor(m @ most + 1e-9)
                    sums[0] += (t[:, None] * m * _step_rates(m, cap, steps)[:, None]).sum(axis=0)
                    sums[1] += (t[:, None] * m).sum(axis=0)
                    sums[2] += ((t * cap)[:, None] * (m == 1.0)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * k, dtype=np.int32)), pa.array(sums.ravel())], names=["i", "x"])

        rows = state.select("tokens", "member").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(3 * k)
        for i, x in rows:
            out[i] = x
        return out.reshape(3, k)

    steps = np.zeros((0, k))
    _, there, capped = totals(steps)
    # A source without a document that could be drawn reaches nothing; the others keep their proportions.
    has = capped > 0
    part = np.where(has, share, 0.0) / max(share[has].sum(), 1e-300)
    total = SLACK * float(np.min(capped[has] / part[has])) if has.any() else 0.0
    want = part * total
    scale = np.where(there > 0, there, 1.0)
    reached, converged = np.zeros(k), False
    for _ in range(iterations + 1):
        error = reached - want
        converged = total <= 0 or bool(np.max(np.abs(error)) <= tolerance * total)
        if converged or len(steps) == iterations:
            break
        steps = np.vstack([steps, (error / scale)[None, :]])
        reached = totals(steps)[0]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            m = _array(b, 3, k)
            r = _step_rates(m, np.floor(m @ most + 1e-9), steps) if b.num_rows else np.empty(0)
            place = np.fromiter((xxhash.xxh3_64_intdigest(str(i)) / 2.0**64 for i in b.column(0).to_pylist()), dtype=float, count=b.num_rows)
            top = np.where(m.max(axis=1) == 1.0, m.argmax(axis=1), k).astype(np.int32) if b.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r), pa.array(place), pa.array(top)], names=["doc_id", "source", "tokens", "member", "rate", "u", "top"])

    rated = state.select("doc_id", "source", "tokens", "member").mapInArrow(rate, "doc_id long, source string, tokens long, member array<double>, rate double, u double, top int")
    rated = rated.where("doc_id is not null").withColumn("part", F.col("rate") - F.floor("rate")).withColumn("score", F.when(F.col("part") > 0, F.col("u") / F.col("part")).otherwise(F.lit(1e9)))
    # A document is drawn once more if its score u / part lies below its source's threshold, about 1.
    # The group k holds the documents of unknown source.
    low, width = np.zeros(k + 1), np.full(k + 1, 4.0)
    need: np.ndarray | None = None
    for _ in range(2):
        lo = F.element_at(F.array(*[F.lit(float(x)) for x in low]), F.col("top") + 1)
        wide = F.element_at(F.array(*[F.lit(float(x)) for x in width]), F.col("top") + 1)
        cell = F.least(F.greatest(F.floor((F.col("score") - lo) / wide * GRID), F.lit(-1)), F.lit(GRID)).cast("int").alias("cell")
        sums = rated.groupBy("top", cell).agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.col("tokens") * F.col("part")).alias("want")).collect()
        table = np.zeros((k + 1, GRID + 2))
        wanted = np.zeros(k + 1)
        for r in sums:
            table[r["top"], r["cell"] + 1] += r["t"] or 0.0
            wanted[r["top"]] += r["want"] or 0.0
        need = wanted if need is None else need
        cum = np.cumsum(table, axis=1)
        for i in range(k + 1):
            j = int(np.searchsorted(cum[i, : GRID + 1], need[i], side="right"))
            low[i], width[i] = low[i] + (min(max(j, 1), GRID) - 1) * width[i] / GRID, width[i] / GRID
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in low + width / 2]), F.col("top") + 1)
    copies = (F.floor("rate") + (F.col("score") < limit).cast("int")).cast("int")
    drawn = rated.select("doc_id", "source", "tokens", "rate", F.when(F.col("tokens") > 0, copies).otherwise(0).alias("copies"), "member")
    own = lambda i, x: F.coalesce(F.sum(F.col("member")[i] * x), F.lit(0.0))
    tokens = F.col("tokens") * F.col("copies")
    sums = drawn.agg(*[f(own(i, x)).alias(f"{n}{i}") for i in range(k) for n, x, f in (("t", tokens, F.round), ("e", F.col("tokens") * F.col("rate"), F.abs))]).first()
    counts = drawn.where("copies > 0").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("draws"), F.max("copies").alias("max_copies")).where(F.col("source").isin(sources)).collect()
    seen = {r["source"]: r for r in counts}
    all_tokens, all_expected = sum(sums[f"t{i}"] for i in range(k)) or 1.0, sum(sums[f"e{i}"] for i in range(k)) or 1.0
    lines = []
    for i, s in enumerate(sources):
        n = (seen[s]["documents"], seen[s]["draws"], seen[s]["max_copies"]) if s in seen else (0, 0, 0)
        lines.append((s, float(share[i]), sums[f"e{i}"] / all_expected, sums[f"t{i}"] / all_tokens, *n, int(most[i]), int(sums[f"t{i}"]), int(capped[i]), converged))
    schema = "source string, target_share double, expected_share double, actual_share double, documents long, draws long, max_copies int, max_repeats int, tokens long, most_tokens long, converged boolean"
    return drawn.drop("member"), spark.createDataFrame(lines, schema)
