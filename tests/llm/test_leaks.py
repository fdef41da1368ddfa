import random

import numpy as np

from rallyframe.llm import leaks
from rallyframe.llm.leaks import ItemIndex, leaked_items, shingle_similarity, simhash_windows, word_hashes, words

V = [f"w{i}" for i in range(400)]


def corpus(seed=2):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(V) for _ in range(n)]
    items = [(i, text(40)) for i in range(6)]
    docs = []
    for d in range(60):
        t = text(rng.randrange(0, 120))
        if d % 3 == 0:
            w = items[d % 6][1]
            n = rng.choice([11, 12, 13, 30])
            s = rng.randrange(0, 40 - n + 1)
            at = rng.randrange(0, len(t) + 1)
            t = t[:at] + w[s : s + n] + t[at:]
        sep = rng.choice([" ", "\n", ", ", "!? - "])
        docs.append((d, sep.join(x.upper() if rng.random() < 0.3 else x for x in t), "note"))
    return docs, items


def brute(docs, items, n=12):
    out = set()
    for d, t, *_ in docs:
        ws = words(t)
        seen = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        out |= {(d, i) for i, w in items if seen & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}}
    return out


def test_exact_passages_equal_brute_force_in_any_blocks(spark, monkeypatch):
    docs, items = corpus()
    docs += [(100, None, ""), (101, "", ""), (102, "W1 w2", ""), (0, docs[0][1], "twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "short text")], "item_id long, text string")
    want = brute(docs, items)
    for limit, chunk in ((leaks.ITEM_WINDOWS, leaks.CHUNK_WORDS), (50, 16)):
        monkeypatch.setattr(leaks, "CHUNK_WORDS", chunk)
        blocks = leaks.item_blocks
        monkeypatch.setattr(leaks, "item_blocks", lambda a, b, c, blocks=blocks, limit=limit: blocks(a, b, c, limit))
        got = [(r.doc_id, r.item_id) for r in leaked_items(df, it, exact=True).collect()]
        monkeypatch.setattr(leaks, "item_blocks", blocks)
        assert set(got) == want and len(got) == len(want)
    assert leaked_items(df, it.limit(0)).count() == 0 and leaked_items(df.limit(0), it).count() == 0


def test_similarities_of_windows_equal_the_plain_ones():
    rng = random.Random(3)
    items = {i: [rng.choice(V[:6]) for _ in range(14)] for i in range(8)}
    index = ItemIndex([(i, 0, " ".join(w)) for i, w in items.items()], 12, 3)
    pairs = [(k, m) for k in range(len(index.hashes)) for m in range(len(index.hashes))]
    a, b = [index.hashes[[p[k] for p in pairs]] for k in (0, 1)]
    got = leaks.window_similarities(a, b, index._weights(a), index._weights(b), 5)
    text = lambda k: items[index.item[k]][index.start[k] : index.start[k] + 12]
    for (k, m), s in zip(pairs, got, strict=True):
        assert abs(s - shingle_similarity(text(k), text(m), 5, index.weight)) < 1e-9
    h = word_hashes(items[0])
    left, right = np.zeros(len(index.hashes), np.int64), np.arange(len(index.hashes))
    assert (index.verified(h, left, right) == (got[: len(index.hashes)] >= 0.8)).all()


def test_near_passages_are_found_within_the_radius(spark):
    rng = random.Random(4)
    item = [rng.choice(V) for _ in range(60)]
    near = item[:30] + ["changed"] + item[31:]
    it = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(rng.choice(V) for _ in range(80)))], "doc_id long, text string")
    got = leaked_items(df, it, width=24).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].similarity == 1.0


def test_near_passages_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    common = V[:12]  # in every item, so of little weight
    text = lambda n: [rng.choice(common if rng.random() < 0.3 else V) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([40, 14, 12, 60, 25, 11])} | {6: ["w1"] * 20}
    docs = [["w1"] * 30]
    for d in range(160):
        w = list(items[d % 6])
        n = min(len(w), rng.choice([12, 13, 16, 24, 30]))
        s = rng.randrange(0, len(w) - n + 1)
        w = w[s : s + n]
        for at in rng.choice([[0], [-1], [0, -1], [0, 1], [n // 2], []]):
            w[at] = rng.choice(common)
        docs.append(text(rng.randrange(0, 20)) + w + text(rng.randrange(0, 20)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    for width, chunk in ((12, leaks.CHUNK_WORDS), (12, 16), (24, leaks.CHUNK_WORDS)):
        weight = leaks.word_weights({i: w for i, w in items.items() if len(w) >= width})
        want = {}
        for d, w in enumerate(docs):
            for i, v in items.items():
                a, b = [[x[k : k + width] for k in range(len(x) - width + 1)] for x in (w, v)]
                s = max((1.0 if x == y else shingle_similarity(x, y, 5, weight) for x in a for y in b), default=0.0)
                if s >= 0.8:
                    want[d, i] = s
        monkeypatch.setattr(leaks, "CHUNK_WORDS", chunk)
        got = {(r.doc_id, r.item_id): r.similarity for r in leaked_items(df, it, width=width).collect()}
        assert got == want and sum(s < 1.0 for s in want.values()) > 5


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = random.Random(9)
    rows = [(i, 0, " ".join(rng.choice(V) for _ in range(30))) for i in range(20)]
    index = ItemIndex(rows, 12, 3)
    base = index.sim[np.arange(0, len(index.sim), 7)]
    flips = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in base], dtype=np.uint64)
    q = base ^ flips
    got = set(zip(*[x.tolist() for x in index.near(q)]))
    want = {(i, j) for i in range(len(q)) for j in range(len(index.sim)) if bin(int(q[i] ^ index.sim[j])).count("1") <= 3}
    assert got == want and len(index.near(q)[0]) == len(want)


def test_simhash_of_a_window_is_the_majority_of_its_bits():
    h = word_hashes([f"x{i}" for i in range(20)])
    for i, s in enumerate(simhash_windows(h, 7).tolist()):
        bits = [sum((int(x) >> b) & 1 for x in h[i : i + 7]) * 2 > 7 for b in range(64)]
        assert s == sum(1 << b for b, on in enumerate(bits) if on)


def test_shingle_similarity_weighs_words():
    a, b = "a b c d e f".split(), "a b c d e g".split()
    assert shingle_similarity(a, a, 5) == 1.0 and shingle_similarity(a, b, 5) == 1 / 3
    assert shingle_similarity(a, b, 5, {"f": 11.0}) < 1 / 3 and shingle_similarity([], a, 5) == 0.0
