import random

import pytest

from rallyframe.llm import mixing

WEIGHTS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = {"web": ["click", "here", "page"], "law": ["court", "ruled", "hereby"], "tiny": ["rare", "old", "letter"]}
    rows = []
    for i in range(900):
        s = rng.choice(["web"] * 6 + ["law"] * 3 + ["tiny"])
        rows.append((i, " ".join(rng.choice(words[s]) for _ in range(rng.randint(5, 60))), None if i % 50 == 0 else s, 1))
    rows += [(1000, None, "web", 1), (1001, "", None, 1), (1002, "some text here", "other", 1), (1003, "word " * 200, "web", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int").cache()


def test_shares_are_reached_within_the_caps(spark, docs):
    w = spark.createDataFrame([("web", 0.5, 1), ("law", 0.3, 2), ("tiny", 0.2, 3), (None, 0.5, 1), ("none", 0.0, 1)], WEIGHTS)
    plan, report = mixing.mix(docs, w)
    rows, lines = plan.collect(), {r.source: r for r in report.collect()}
    assert len(rows) == docs.count() and set(lines) == {"web", "law", "tiny"}
    for s, r in lines.items():
        assert r.expected_share == pytest.approx(r.target_share, abs=2e-3) and r.actual_share == pytest.approx(r.target_share, abs=0.02) and r.max_copies <= r.max_repeats
    assert all(r.copies == 0 for r in rows if r.source == "other" or r.tokens == 0) and sum(r.copies for r in rows if r.source is None) > 0
    assert sum(r.tokens * r.copies for r in rows) == pytest.approx(sum(r.tokens for r in lines.values()), rel=1e-3)
    again, _ = mixing.mix(docs.repartition(5), w)
    assert sorted((r.doc_id, r.copies) for r in again.collect()) == sorted((r.doc_id, r.copies) for r in rows)


def test_a_source_without_documents_is_reported_and_starves_no_other(spark, docs):
    plan, report = mixing.mix(docs, spark.createDataFrame([("web", 0.4, 1), ("law", 0.4, 2), ("absent", 0.2, 5)], WEIGHTS))
    lines = {r.source: r for r in report.collect()}
    assert plan.where("copies > 0").count() > 0 and (lines["absent"].actual_share, lines["absent"].most_tokens) == (0.0, 0)
    assert all(lines[s].actual_share == pytest.approx(0.5, abs=0.02) and lines[s].converged for s in ("web", "law"))
    _, report = mixing.mix(docs, spark.createDataFrame([("web", 0.5, 1), ("law", 0.5, 2)], WEIGHTS), iterations=1)
    assert not any(r.converged for r in report.collect())


def test_tokens_equal_the_tokenizer_on_whole_texts(spark, docs, monkeypatch):
    enc = mixing._encoding(mixing.TOKENIZERS)
    texts = ["Hello  world's\n\n ñandú 12345!", "", " ", "Ünï—code…\t\tx", "word " * 300, "abc" * 2000, "xyzq1" * 60_000, ("Ab" * 1100 + " ") * 200, " " * 300_000 + "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(df, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [len(enc.encode_ordinary(t)) for t in texts]


def test_classifier_learns_the_sources(spark, docs):
    model = mixing.fit_classifier(docs, ["law", "tiny", "web"])
    p = model.posterior(["court ruled hereby court", "click here page", None])
    assert p[0].argmax() == 0 and p[1].argmax() == 2 and p.sum(axis=1) == pytest.approx([1, 1, 1]) and p[2].argmax() == 2


def test_no_weights_and_no_documents(spark, docs):
    empty = spark.createDataFrame([], WEIGHTS)
    plan, report = mixing.mix(docs, empty)
    assert plan.where("copies <> 0").count() == 0 and report.count() == 0
    plan, report = mixing.mix(docs.limit(0), spark.createDataFrame([("web", 1.0, 1)], WEIGHTS))
    assert plan.count() == 0 and report.first().actual_share == 0.0
