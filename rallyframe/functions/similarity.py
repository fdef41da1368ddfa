"""Similarity of names and events by matching blocks, worked on the distinct pairs of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.names import normalized
from rallyframe.session import worker_memory

#: Pairs of texts whose ratio a worker remembers before it forgets them all.
_MEMORY = 300_000


def ratio(a: str, b: str) -> float:
    """Letters in matching blocks, twice, over the letters of both."""
    ratios = worker_memory("ratios")
    known = ratios.get((a, b))
    if known is None:
        if len(ratios) >= _MEMORY:
            ratios.clear()
        known = ratios[a, b] = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
    return known


def event_ratio(a: str | None, b: str | None, generic: str = "") -> float:
    """Ratio of two normalized event names, the word ``generic`` set aside; 0 if either is empty, 1 if equal."""
    x, y = [(normalized(v).replace(generic, "") if generic else normalized(v)).strip() for v in (a, b)]
    return ratio(x, y) if x and y else 0.0


def _best(word: str, others: list[str]) -> float:
    """The largest ratio of a word to any of the others; those too short or long to beat the best so far are passed over."""
    top = 0.0
    if word in others:
        return 1.0
    for v in others:
        shorter, both = min(len(word), len(v)), len(word) + len(v)
        if both and 2.0 * shorter / both > top:
            top = max(top, ratio(word, v))
    return top


def _in_order(letters: str, text: str) -> int:
    """How many letters, from the first on, stand in ``text`` in their order."""
    at = 0
    for n, letter in enumerate(letters):
        at = text.find(letter, at) + 1
        if not at:
            return n
    return len(letters)


def short_name_similarity(full: str | None, short: str | None, initials_weight: float = 0.16) -> float:
    """Similarity of a full name and a short one: surnames, then initials (trailing words of one or two letters).

    With initials it is the mean of the surname words' best ratios to a word of the full name, and
    the share of initials found in order among the full name's, weighed by ``initials_weight``.
    Without, 0.6 times the ratio of the whole names and 0.4 times the mean over all words. Equal
    names have 1, an empty one 0.
    """
    return _short_name(normalized(full), normalized(short), initials_weight)


def _short_name(full: str, short: str, initials_weight: float) -> float:
    if not full or not short or full == short:
        return float(bool(full) and full == short)
    own, words = full.split(), short.split()
    long_words = [i for i, w in enumerate(words, 1) if len(w) > 2]
    cut = max(long_words, default=0)
    letters = "".join(w[0] for w in words[cut:])
    if not letters:
        return 0.6 * ratio(full, short) + 0.4 * float(np.mean([_best(w, own) for w in words]))
    # A name of short words only keeps all but its last as surnames, or its single word.
    surnames = words[: cut or max(len(words) - 1, 1)]
    named = float(np.mean([_best(w, own) for w in surnames]))
    return (1 - initials_weight) * named + initials_weight * _in_order(letters, "".join(w[0] for w in own)) / len(letters)


def _on_distinct(f: Callable[[str, str], float], a: pa.Array, b: pa.Array) -> np.ndarray:
    """``f`` of each row's two texts, worked once for each distinct pair; null counts as the empty text."""
    x, y = [c.fill_null("").dictionary_encode() for c in (a, b)]
    left, right = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    if not len(a):
        return np.empty(0)
    code = x.indices.to_numpy().astype(np.int64) * len(right) + y.indices.to_numpy()
    pairs, back = np.unique(code, return_inverse=True)
    return np.array([f(left[p // len(right)], right[p % len(right)]) for p in pairs.tolist()])[back]


def event_similarity(a: str | Column, b: str | Column, generic: str = "") -> Column:
    """Column form of ``event_ratio``."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(_on_distinct(lambda p, q: event_ratio(p, q, generic), x, y))

    return run(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def pair_scores(df: DataFrame, full: tuple[str, str], short: tuple[str, str], events: tuple[str, str], initials_weight: float, generic: str) -> DataFrame:
    """``df`` with ``direct``, ``turned`` and ``event_similarity`` of two pairs of normalized names and two event names.

    ``direct`` is the mean similarity of first to first and second to second, ``turned`` across. All
    three come from one Arrow pass: the four name pairs of a batch's rows are put together and each
    distinct pair is scored once.
    """
    places = [df.columns.index(c) for c in (*full, *short, *events)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two, fe, qe = [batch.column(i) for i in places]
            scores = _on_distinct(lambda x, y: _short_name(x, y, initials_weight), pa.concat_arrays([a, b, a, b]), pa.concat_arrays([one, two, two, one]))
            aa, bb, ab, ba = np.split(scores, 4)
            event = _on_distinct(lambda x, y: event_ratio(x, y, generic), fe, qe)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in (0.5 * (aa + bb), 0.5 * (ab + ba), event)]], names=[*batch.schema.names, "direct", "turned", "event_similarity"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType(list(df.schema.fields))
    for c in ("direct", "turned", "event_similarity"):
        schema = schema.add(c, DoubleType())
    return df.mapInArrow(run, schema)
