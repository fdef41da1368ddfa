"""Per-document text statistics as associative partial counts, and a rule for natural prose."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.session import partitions

#: Characters of a text above which its chunks spread over tasks, and of a piece counted at a time.
CHUNK_CHARS, PIECE_CHARS = 1 << 20, 1 << 10
#: Chunks merged at each level of the tree.
FAN_IN = 32
#: Characters kept from either end of an unfinished line, without blanks and with runs of bullet marks as one. A bullet has
#: at most seven of them and a word of COMMON under twenty, so what is read from an end never needs more.
EDGE = 24
#: Letters of a mean word above which a line is word junk.
LONG_WORD = 20

# Frequent function words of English, German, French and Spanish.
COMMON = frozenset(
    """
    the a an of to in and or but at by for with from on under behind after before between because so while who that was is are be had have has near
    next as it his her their its this these those some then than not without very
    der die das den dem des ein eine einen einem einer und oder aber im am an auf aus bei beim für mit nach nahe neben ohne hinter zwischen vor von zum zur
    über unter um wie weil denn also dann während war ist sind es er sie etwas sehr zu nicht bis dahin
    le la les un une du de au aux et ou mais dans sur sous près par pour sans avec avant après devant derrière entre donc parce que qui a est était sont il
    elle c ce cette se ne pas très puis tandis comme à en
    el los las uno una unos y o pero del al con sin sobre bajo cerca antes después delante detrás para por porque mientras fue es son él ella se no muy lo su
    como según así luego
    """.split()
)
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_SYMBOL = re.compile(r"[^\w\s.,;:!?…'’‘\"“”„«»()\-–—¿¡]|[_²³¹¼½¾]")
#: The last character of a line that is no blank and no closing mark.
_LAST = re.compile(r"([^\s'’\"”»)])[\s'’\"”»)]*$")
_SENTENCE_END, _OTHER_END = ".!?…", ":;,"
_MARKS = re.compile(r"[-*•·‣◦▪+–—>#]{2,}")
_BULLET = re.compile(r"\s*(?:[-*•·‣◦▪+–—>#]+|\(?\d{1,4}[.):]|\(?[A-Za-z][.)])\s")
_FIRST_WORD = re.compile(r"[^\W\d_]+")
_LAST_WORD = re.compile(r"[^\W\d_]+$")

#: Counts of a document. A line counts if it is not blank.
FIELDS = ("chars", "words", "letters", "digits", "symbols", "common", "lines", "line_ends", "junk_lines")
#: Counts of one line; all add up when pieces of a line are joined, but for a word cut in two.
_LINE = ("chars", "words", "letters", "digits", "symbols", "common", "cells", "spaces")


def _edge(s: str) -> str:
    """The beginning of a line's solid text, runs of bullet marks as one mark."""
    head = s[:EDGE]
    if _MARKS.match(head):
        rest = s.lstrip("-*•·‣◦▪+–—>#")
        return (head[0] + rest)[:EDGE]
    return head


def _line(s: str) -> dict:
    """The counts of a line or a piece of one, with its two ends."""
    ws = _WORD.findall(s)
    solid = s.strip()
    last = _LAST.search(solid)
    common = 0
    for w in ws:
        if w.lower() in COMMON:
            common += 1
    return {
        "chars": len(s),
        "words": len(ws),
        "letters": sum(map(len, ws)),
        "digits": len(_DIGIT.findall(s)),
        "symbols": len(_SYMBOL.findall(s)),
        "common": common,
        "cells": s.count("\t") + s.count("|") + s.count(";") + s.count(">") + s.count("="),
        "spaces": s.count(" "),
        "lead": len(s) - len(s.lstrip()),
        "trail": len(s) - len(s.rstrip()),
        "head": _edge(solid),
        "tail": solid[-EDGE:],
        "last": last.group(1) if last else "",
    }


def _join(a: dict, b: dict) -> dict:
    """Two pieces of one line as one: counts add, and a word cut between them is put right."""
    out = {k: a[k] + b[k] for k in _LINE}
    left, right = _LAST_WORD.search(a["tail"]), _FIRST_WORD.match(b["head"])
    if left and right and not a["trail"] and not b["lead"]:
        x, y = left.group().lower(), right.group().lower()
        out["words"] -= 1
        out["common"] += (x + y in COMMON) - (x in COMMON) - (y in COMMON)
    out["lead"] = a["lead"] if a["head"] else a["chars"] + b["lead"]
    out["trail"] = b["trail"] if b["head"] else a["trail"] + b["chars"]
    gap = " " * min(a["trail"] + b["lead"], EDGE) if a["head"] and b["head"] else ""
    out["head"] = a["head"] if len(a["head"]) == EDGE else _edge(a["head"] + gap + b["head"])
    out["last"] = b["last"] or a["last"]
    out["tail"] = b["tail"] if len(b["tail"]) == EDGE else (a["tail"] + gap + b["tail"])[-EDGE:]
    return out


def is_junk(x: dict) -> bool:
    """Whether a line is no sentence nor a piece of one: a list entry, a table row, or junk of symbols, numbers or words."""
    ended = x["last"] != "" and x["last"] in _SENTENCE_END
    solid = x["letters"] + x["digits"] + x["symbols"]
    if not x["words"]:
        return True
    if x["symbols"] > 0.1 * solid and x["symbols"] > 2:
        return True
    if not x["spaces"] and x["chars"] >= 12 and x["symbols"] + x["digits"] >= 2:
        return True
    if x["digits"] > x["letters"] or x["letters"] > LONG_WORD * x["words"]:
        return True
    if ended and x["words"] >= 4 and x["common"]:
        return False
    if _BULLET.match(x["head"] + " " * (x["trail"] > 0)) and not (ended and x["words"] >= 4):
        return True
    if x["cells"] and x["common"] <= 0.25 * x["words"] + x["cells"]:
        return True
    return x["words"] >= 4 and x["common"] < 0.13 * x["words"] and not (ended and x["words"] < 8)


def _close(sums: dict, x: dict) -> None:
    """Add a finished line to a document's counts."""
    for k in ("chars", "words", "letters", "digits", "symbols", "common"):
        sums[k] += x[k]
    if x["head"].strip() or x["tail"].strip() or x["words"] or x["digits"] or x["symbols"]:
        sums["lines"] += 1
        sums["line_ends"] += x["last"] != "" and x["last"] in _SENTENCE_END + _OTHER_END
        sums["junk_lines"] += is_junk(x)


def partial(chunk: str) -> dict:
    """The state of a chunk: counts of the lines inside it and its unfinished first and last line."""
    first, *rest = chunk.split("\n")
    sums = dict.fromkeys(FIELDS, 0)
    if not rest:
        return {"first": _line(first), "sums": sums, "last": None}
    for s in rest[:-1]:
        _close(sums, _line(s))
    return {"first": _line(first), "sums": sums, "last": _line(rest[-1])}


def combine(a: dict, b: dict) -> dict:
    """The state of two neighbouring chunks; associative, in text order."""
    sums = {k: a["sums"][k] + b["sums"][k] for k in FIELDS}
    if a["last"] is None:
        return {"first": _join(a["first"], b["first"]), "sums": sums, "last": b["last"]}
    if b["last"] is None:
        return {"first": a["first"], "sums": sums, "last": _join(a["last"], b["first"])}
    _close(sums, _join(a["last"], b["first"]))
    return {"first": a["first"], "sums": sums, "last": b["last"]}


def merged(states: list[dict]) -> dict:
    """Neighbouring states as one, merged up a tree."""
    while len(states) > 1:
        states = [reduce(combine, states[i : i + FAN_IN]) for i in range(0, len(states), FAN_IN)]
    return states[0]


def counted(text: str, piece: int = PIECE_CHARS) -> dict:
    """The state of a text, counted in pieces that are merged."""
    return merged([partial(text[i : i + piece]) for i in range(0, max(len(text), 1), piece)])


def finish(state: dict) -> dict:
    """A document's counts: the two open lines are closed, and ratios derived."""
    n = dict(state["sums"])
    for x in (state["first"], state["last"]):
        if x is not None:
            _close(n, x)
    ratio = lambda a, b: a / b if b else 0.0
    return {
        "words": n["words"],
        "mean_word_length": ratio(n["letters"], n["words"]),
        "symbol_ratio": ratio(n["symbols"], n["letters"] + n["digits"] + n["symbols"]),
        "lines": n["lines"],
        "line_end_share": ratio(n["line_ends"], n["lines"]),
        "common_share": ratio(n["common"], n["words"]),
        "junk_line_share": ratio(n["junk_lines"], n["lines"]),
        "is_natural": 2 * n["junk_lines"] <= n["lines"] and n["lines"] > 0,
    }


_STATS = "words long, mean_word_length double, symbol_ratio double, lines long, line_end_share double, common_share double, junk_line_share double, is_natural boolean"
_TYPES = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]


def _table(ids: list, stats: list[dict]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _STATS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([s[c] for s in stats], t) for c, t in zip(names, _TYPES, strict=True)]], names=["doc_id", *names])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _table(b.column(0).to_pylist(), [finish(counted(t or "")) for t in b.column(1).to_pylist()])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        states = [json.dumps(counted(t)) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.string())], names=["u__", "n__", "state__"])


def _merge(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("n__").to_pylist(), t.column("state__").to_pylist(), strict=True))
    state = reduce(combine, (json.loads(s) for _, s in rows))
    return pa.table({"u__": t.column("u__")[:1], "n__": pa.array([rows[0][0] // FAN_IN], pa.int64()), "state__": pa.array([json.dumps(state)], pa.string())})


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _table([int(u.split(":")[0]) for u in b.column(0).to_pylist()], [finish(json.loads(s)) for s in b.column(1).to_pylist()])


def text_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Statistics of each document's text, and whether it is natural prose.

    Output ``doc_id``, ``words`` (runs of letters), ``mean_word_length``, ``symbol_ratio`` (symbols
    among letters, digits and symbols), ``lines`` (not blank), ``line_end_share`` (lines ending in
    punctuation), ``common_share`` (words in COMMON), ``junk_line_share`` and ``is_natural`` (at most
    half of the lines are list entries, table rows or junk). Null and empty texts have zeros
    throughout and are not natural; rows repeated under one id give a row each; rows without an id
    are left out.

    Every text is counted in pieces of PIECE_CHARS; a piece's state keeps its counts and both
    unfinished lines, so that lines and words cut at an edge are put right when states are merged,
    FAN_IN at a time, up a tree. Texts of up to ``chunk_chars`` characters are merged where they are
    read, without a shuffle; the chunks of longer ones spread over all tasks and are merged over
    shuffles. The result depends on neither size.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    size = F.coalesce(F.length("text"), F.lit(0))
    schema = f"doc_id long, {_STATS}"
    out = rows.where(size <= chunk_chars).mapInArrow(_whole, schema)
    long = rows.where(size > chunk_chars)
    most = long.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return out
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk_chars).cast("int")), lambda i: F.substring(F.col("text"), i * chunk_chars + 1, F.lit(chunk_chars)))
    own = F.concat_ws(":", F.col("doc_id"), F.monotonically_increasing_id()).alias("u__")
    parts = long.select(own, "text").select("u__", F.posexplode(cut).alias("n__", "t__")).select("u__", F.col("n__").cast("long").alias("n__"), "t__")
    states = parts.repartition(partitions(docs.sparkSession), "u__", "n__").mapInArrow(_pieces, "u__ string, n__ long, state__ string")
    left = -(-most // chunk_chars)
    while left > 1:
        states = states.groupBy("u__", F.floor(F.col("n__") / FAN_IN).alias("g__")).applyInArrow(_merge, "u__ string, n__ long, state__ string")
        left = -(-left // FAN_IN)
    return out.unionByName(states.select("u__", "state__").mapInArrow(_finished, schema))
