"""Variant spellings of names: tries of registered names, walked by Levenshtein automata, then token checks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.skew import lookup_join, small
from rallyframe.session import partitions, stage

# Surname particles, and suffixes that name no one.
PARTICLES = frozenset({"de", "di", "da", "del", "la", "van", "von", "der", "den", "le"})
SUFFIXES = frozenset({"jr", "sr"})
#: Edits (insert, delete, replace, swap of neighbours) that a surname may be away.
EDITS = 2
#: Names of a trie shard, and query forms that one task walks through a trie.
SHARD_NAMES, BLOCK_FORMS = 50_000, 20_000
#: Query forms walked at a time.
STEP = 2_000
#: Costs above this link nothing.
MOST = 3.6

_SPLIT = re.compile(r"[^\w]+|_+|\d+")
_APOSTROPHE = re.compile("['’‘`´ʼ]")
_FOLDS = (("ph", "f"), ("y", "i"), ("c", "k"), ("w", "v"))


def plain(s: str) -> str:
    """Lower case without accents and apostrophes."""
    s = _APOSTROPHE.sub("", s).casefold()
    if s.isascii():
        return s
    s = unicodedata.normalize("NFKD", s)
    return "".join(ch for ch in s if not unicodedata.combining(ch))


def fold(s: str) -> str:
    """A plain text with letters that sound alike made one."""
    for a, b in _FOLDS:
        s = s.replace(a, b)
    return s


def tokens(name: str) -> list[str]:
    """The folded words of a typed name, without particles and suffixes (unless nothing else is left)."""
    ws = [w for w in _SPLIT.split(fold(plain(name))) if w]
    own = [w for w in ws if w not in _PARTICLES and w not in _SUFFIXES]
    return own or ws


_PARTICLES = frozenset(map(fold, PARTICLES))
_SUFFIXES = frozenset(map(fold, SUFFIXES))


def registered_forms(name: str) -> list[tuple[str, str]]:
    """(surname form, given names) of a registered name: the last word, joined, and its first part if hyphenated."""
    ws = [w for w in name.split() if fold(plain(w)) not in _PARTICLES | _SUFFIXES] or name.split()
    if not ws:
        return []
    parts = [p for p in _SPLIT.split(fold(plain(ws[-1]))) if p]
    given = " ".join(w for x in ws[:-1] for w in _SPLIT.split(fold(plain(x))) if w)
    return [(f, given) for f in dict.fromkeys(["".join(parts), *parts[:1]]) if f]


#: A text with more distinct words than this means no one. ``given_cost`` charges each distinct word at least 0.1, or
#: 0.15 * n for the n-th given name itself, so over 37 words beside the surname (up to three) cost more than MOST.
MOST_WORDS = 40


def spelled_forms(name: str) -> list[tuple[str, str]]:
    """(possible surname, other words) of a typed name: each run of up to three neighbouring words, joined.

    All words are read, each of the others once. No form of a text with over MOST_WORDS distinct
    words could link, so such texts have none.
    """
    ws = tokens(name)
    if len(set(ws)) > MOST_WORDS:
        return []
    out: dict[tuple[str, str], None] = {}
    count = Counter(ws)
    for i in range(len(ws)):
        for j in range(i + 1, min(i + 3, len(ws)) + 1):
            run = Counter(ws[i:j])
            out["".join(ws[i:j]), " ".join(w for w in count if count[w] > run[w])] = None
    return list(out)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between two words with swaps of neighbours as one (restricted), or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], most + 1)


def given_cost(rest: str, given: str) -> float:
    """What it costs to read the words ``rest`` as the given names ``given``, in any order; 9 if they can't be.

    Words may be the names, initials, beginnings or endings of them, short forms (three letters, the
    last doubled, and y), or any of these mistyped; a name may be left out, an initial added.
    """
    own = given.split()
    words = rest.split()
    if not words:
        return 0.9 if own else 0.0
    if not own:
        return 0.5 * len(words)
    total, read = 0.0, False
    for w in words:
        best = 9.0
        for n, g in enumerate(own):
            if w == g:
                c = 0.0
            elif len(w) == 1:
                c = 0.1 if g[0] == w else 9.0
            elif g.startswith(w):
                c = 0.2
            elif len(g) >= 3 and w == g[:3] + g[2] + "i":
                c = 0.25
            elif len(w) >= 3 and g.endswith(w):
                c = 0.3
            else:
                c = float(edit_distance(w, g, 2)) if len(w) >= 5 else 9.0
                short = [g[:k] for k in (3, 4, 5)] + [g[-k:] for k in (3, 4, 5)] + [g[:3] + g[2] + "i"] if len(w) >= 3 else []
                c = min([c if c <= 2 else 9.0] + [1.45 for s in short if edit_distance(w, s, 1) <= 1])
            best = min(best, c + 0.15 * n)
        if best < 9.0:
            read = True
        elif len(w) == 1:
            best = 0.4
        elif len(words) > 1 or len(w) == 1:
            best = 1.2
        total += best
    return total if read else 9.0


class Automaton:
    """The Levenshtein automaton for up to ``k`` edits (swaps of neighbours are one), as a table.

    After d letters of a word its state is the band of edit distances between those letters and the
    query's first d - k to d + k letters, and for each place the distance that a swap would have there.
    Bit j of the input tells whether the word's next letter is the query's letter d + j - k - 1.
    """

    def __init__(self, k: int) -> None:
        wide, far = 2 * k + 1, k + 1
        start = (*[far] * k, *range(k + 1), *[far] * wide)
        bits = (np.arange(1 << (wide + 1))[:, None] >> np.arange(wide + 1)) & 1
        states, table, at = {start: 0}, [], 0
        order = [start]
        while at < len(order):
            row, swap = order[at][:wide], order[at][wide:]
            new = np.full((len(bits), wide), far)
            for j in range(wide):
                d = row[j] + 1 - bits[:, j + 1]
                if j + 1 < wide:
                    d = np.minimum(d, row[j + 1] + 1)
                if j:
                    d = np.minimum(d, new[:, j - 1] + 1)
                d = np.where(bits[:, j] == 1, np.minimum(d, swap[j]), d)
                new[:, j] = np.minimum(d, far)
            # A swap at j needs this letter one place further on in the query, and the letter here next.
            later = np.full((len(bits), wide), far)
            for j in range(wide - 1):
                later[:, j] = np.where(bits[:, j + 2] == 1, min(row[j] + 1, far), far)
            dead = new.min(axis=1) > k
            line = np.full(len(bits), -1, dtype=np.int32)
            for v in np.flatnonzero(~dead):
                s = (*new[v].tolist(), *later[v].tolist())
                if s not in states:
                    states[s] = len(states)
                    order.append(s)
                line[v] = states[s]
            table.append(line)
            at += 1
        self.k, self.next = k, np.array(table)
        self.distance = np.array([s[:wide] for s in order], dtype=np.int8)


class Trie:
    """Words of one length as levels of distinct prefixes; walked by many automata at a time."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words))
        self.length = len(self.words[0])
        chars = np.array([[ord(ch) for ch in w] for w in self.words], dtype=np.int32).reshape(len(self.words), self.length)
        self.letters = np.unique(chars)
        chars = np.searchsorted(self.letters, chars)
        new = np.ones((len(self.words), self.length), dtype=bool)
        if len(self.words) > 1:
            new[1:] = np.logical_or.accumulate(chars[1:] != chars[:-1], axis=1)
        # Which letters all words below a node have, and which any has; letters may share a bit.
        bits = np.bitwise_or.reduce(np.left_shift(np.uint64(1), (chars % 64).astype(np.uint64)), axis=1)
        self.first, self.letter, self.all, self.any = [], [], [], []
        parent = np.zeros(len(self.words), dtype=np.int64)
        for d in range(self.length):
            starts = np.flatnonzero(new[:, d])
            self.letter.append(chars[starts, d])
            self.all.append(np.bitwise_and.reduceat(bits, starts))
            self.any.append(np.bitwise_or.reduceat(bits, starts))
            self.first.append(np.searchsorted(parent[starts], np.arange(parent[-1] + 2)))
            parent = np.cumsum(new[:, d]) - 1

    def near(self, queries: list[str], automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, word, edits) of every word within the automaton's edits of a query.

        All queries go down the levels together; a branch ends where its automaton dies, or where more
        letters than there are edits are missing on either side, since an edit can mend one letter a side.
        """
        k = automaton.k
        lengths = np.array([len(q) for q in queries])
        place = {int(c): i for i, c in enumerate(self.letters)}
        # Bit p + k + 1 of seen[q, c] tells that letter p of the query is c, in one 64-bit word or, for long words, over 32-bit
        # words; only queries whose length can match are walked.
        long = self.length + 2 * k + 2 > 64
        bits, count = (32, (self.length + 2 * k + 1) // 32 + 2) if long else (64, 1)
        seen = np.zeros((len(queries), len(self.letters), count), dtype=np.uint64)
        query = np.flatnonzero(np.abs(lengths - self.length) <= k)
        for q in query.tolist():
            for p, ch in enumerate(queries[q], k + 1):
                c = place.get(ord(ch))
                if c is not None:
                    seen[q, c, p // bits] |= np.uint64(1 << (p % bits))
        only = seen[:, :, 0]
        own = np.zeros(len(queries), dtype=np.uint64)
        foreign = np.zeros(len(queries), dtype=np.int64)  # letters that no word has
        for q in query.tolist():
            for ch in set(queries[q]):
                c = place.get(ord(ch))
                if c is None:
                    foreign[q] += 1
                else:
                    own[q] |= np.uint64(1 << (c % 64))
        node = np.zeros(len(query), dtype=np.int64)
        state = np.zeros(len(query), dtype=np.int32)
        mask = np.uint64((1 << (2 * k + 2)) - 1)
        for d in range(self.length):
            first = self.first[d]
            low = first[node]
            n = first[node + 1] - low
            at = np.repeat(np.arange(len(node)), n)
            child = np.arange(len(at)) + np.repeat(low - np.cumsum(n) + n, n)
            q = query[at]
            if d >= 2:  # the subtrees above have most letters
                mine = own[q]
                fits = (np.bitwise_count(mine & ~self.any[d][child]) + foreign[q] <= k) & (np.bitwise_count(self.all[d][child] & ~mine) <= k)
                at, child, q = at[fits], child[fits], q[fits]
            c = self.letter[d][child]
            if long:
                hit = ((seen[q, c, d // 32] | (seen[q, c, d // 32 + 1] << np.uint64(32))) >> np.uint64(d % 32)) & mask
            else:
                hit = (only[q, c] >> np.uint64(d)) & mask
            new = automaton.next[state[at], hit.astype(np.int64)]
            live = np.flatnonzero(new >= 0)
            query, node, state = q[live], child[live], new[live]
        dist = automaton.distance[state, lengths[query] - self.length + k]
        ok = np.flatnonzero(dist <= k)
        return query[ok], node[ok], dist[ok]


def _walk(names: pa.Table, forms: pa.Table) -> pa.Table:
    out = pa.schema([("form", pa.string()), ("near", pa.string()), ("edits", pa.int32())])
    if not names.num_rows or not forms.num_rows:
        return out.empty_table()
    trie, automaton = Trie(names.column("near").to_pylist()), Automaton(EDITS)
    qs = sorted(set(forms.column("form").to_pylist()))
    found = []
    step = max(1, min(STEP, 4_000_000 // (len(trie.letters) * (trie.length // 32 + 2))))
    for at in range(0, len(qs), step):
        part = qs[at : at + step]
        # Short words are held to one edit, those of one or two letters to none.
        q, w, e = trie.near(part, automaton)
        shorter = np.minimum(np.array([len(x) for x in part])[q], trie.length)
        ok = e <= np.where(shorter >= 6, EDITS, np.where(shorter >= 3, 1, 0))
        q, w, e = q[ok], w[ok], e[ok]
        found.append(pa.table([pa.array([part[i] for i in q], pa.string()), pa.array([trie.words[i] for i in w], pa.string()), pa.array(e.astype(np.int32))], schema=out))
    return pa.concat_tables(found)


def near_forms(forms: DataFrame, names: DataFrame) -> DataFrame:
    """``form``, ``near``, ``edits``: the words of ``names`` (column near) within EDITS of those of ``forms`` (column form).

    Names are sharded by length, and a length with more than SHARD_NAMES names by hash too; each
    shard is one trie. A form goes to the shards of all lengths within EDITS of its own, its block
    of forms being a hash, so every pair is compared in exactly one task and none is left out.
    """
    spark = forms.sparkSession
    sizes = {r[0]: r[1] for r in names.groupBy(F.length("near")).count().collect()}
    asked = {r[0]: r[1] for r in forms.groupBy(F.length("form")).count().collect()}
    plan = []
    for length, n in sizes.items():
        m = sum(asked.get(length + j, 0) for j in range(-EDITS, EDITS + 1))
        plan.append((length, -(-n // SHARD_NAMES), max(1, -(-m // BLOCK_FORMS))))
    shape = F.broadcast(spark.createDataFrame(plan or [(0, 1, 1)], "l__ int, s__ int, b__ int"))  # one row a length
    left = names.withColumn("l__", F.length("near")).join(shape, "l__")
    left = left.select("near", "l__", F.pmod(F.xxhash64("near"), F.col("s__")).alias("s__"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b__").cast("long") - 1)).alias("b__"))
    right = forms.withColumn("l__", F.explode(F.sequence(F.length("form") - EDITS, F.length("form") + EDITS))).join(shape, "l__")
    right = right.select("form", "l__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s__").cast("long") - 1)).alias("s__"), F.pmod(F.xxhash64("form"), F.col("b__")).alias("b__"))
    keys = ["l__", "s__", "b__"]
    # The cells are small in bytes and long in work; as many partitions as cells, up to a bound, keep them apart.
    width = max(partitions(spark), min(sum(s * b for _, s, b in plan), 4096))
    left, right = left.repartition(width, *keys), right.repartition(width, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_walk, "form string, near string, edits int")


def _explode(function, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *f) for i, s in enumerate(b.column(b.num_columns - 1).to_pylist()) for f in function(s)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], *[pa.array([r[j + 1] for r in rows], pa.string()) for j in range(len(columns))]], names=[*b.schema.names, *columns])

    return run


def _cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], float] = {}
    for b in batches:
        if len(seen) > 400_000:
            seen.clear()
        col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        costs = []
        for spelling, name, form, near, rest, given, edits in zip(*[col[c] for c in ("spelling", "name", "form", "near", "rest", "given", "edits")], strict=True):
            c = seen.get((rest, given))
            if c is None:
                c = seen[rest, given] = given_cost(rest, given)
            c += edits
            if c <= MOST:
                full = fold(plain(name))
                # Part of a double surname, and letters that only sound alike, cost a little.
                c += 0.3 * (("-" in name) and near != "".join(_SPLIT.split(full.split()[-1])))
                own = set(_SPLIT.split(plain(spelling)))
                c += 0.02 * sum(w not in own for w in _SPLIT.split(plain(name)) if w)
            costs.append(c)
        keep = pa.array([i for i, c in enumerate(costs) if c <= MOST], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(col["spelling"]).take(keep) if len(keep) else pa.array([], pa.string()), pa.array(col["player_id"]).take(keep) if len(keep) else pa.array([], pa.string()), pa.array([c for c in costs if c <= MOST], pa.float64())], names=["spelling", "player_id", "cost"])


def link_names(spellings: DataFrame, registry: DataFrame) -> DataFrame:
    """The registered person that each spelling most likely means.

    ``spellings`` has a string column ``spelling``; ``registry`` has ``player_id`` and ``name``.
    Output, one row per distinct spelling that means someone: ``spelling``, ``player_id``, ``cost``
    (0 for the registered name itself), ``margin`` (how much more any other person costs at least; null if
    there is none). Nulls, and spellings without letters, have no row. Of two persons at equal cost
    the smaller id is taken, with margin 0. Repeated spellings and registry rows count once; either
    table may be empty; texts with over MOST_WORDS distinct words can mean no one.

    Each typed name gives forms: a run of its words as the surname, the others as given names, in
    any order. Forms that equal a registered surname are joined first, over salts if the registry is
    no small table and a surname is hot. Spellings without a plausible person there (a cost under 1) have their forms walked through
    the tries (``near_forms``). A walked person costs 1 or more, so no better one is missed by the
    others, and their margin is at most what a person at 1 would leave.
    """
    spark = spellings.sparkSession
    people = registry.select("player_id", "name").dropna().groupBy("player_id", "name").agg(F.lit(1).alias("x")).drop("x")
    known = stage(people.mapInArrow(_explode(registered_forms, ["near", "given"]), "player_id string, name string, near string, given string"))
    texts = spellings.select("spelling").dropna().groupBy("spelling").agg(F.lit(1).alias("x")).select("spelling")
    typed = texts.repartition(partitions(spark), "spelling").mapInArrow(_explode(spelled_forms, ["form", "rest"]), "spelling string, form string, rest string")
    # Initials are surnames only where a registered one is as short.
    brief = small(known.where(F.length("near") < 3).select(F.col("near").alias("form")).distinct().withColumn("brief__", F.lit(True)))
    typed = stage(typed.join(brief, "form", "left").where("length(form) > 2 or brief__").drop("brief__"))
    costed = "spelling string, player_id string, cost double"
    shape = ["spelling", "name", "form", "near", "rest", "given", "edits", "player_id"]
    met = lookup_join(typed, known.withColumn("form", F.col("near")), ["form"])
    exact = stage(met.withColumn("edits", F.lit(0)).select(*shape).mapInArrow(_cost, costed))
    sure = exact.where("cost < 1").select("spelling").distinct()
    rest = stage(typed.join(sure, "spelling", "left_anti").where("length(form) > 2"))
    near = near_forms(rest.select("form").distinct(), known.select("near").distinct())
    walked = stage(rest.join(near, "form"))
    loose = lookup_join(walked, known, ["near"]).select(*shape).mapInArrow(_cost, costed)
    best = exact.unionByName(loose).groupBy("spelling", "player_id").agg(F.min("cost").alias("cost"))
    order = Window.partitionBy("spelling").orderBy("cost", "player_id")
    ranked = best.select("spelling", "player_id", "cost", F.row_number().over(order).alias("n"), F.lead("cost").over(order).alias("next"))
    margin = F.when(F.col("cost") < 1, F.least("next", F.lit(1.0))).otherwise(F.col("next")) - F.col("cost")
    return ranked.where("n = 1").select("spelling", "player_id", F.round("cost", 4).alias("cost"), F.round(margin, 4).alias("margin"))
