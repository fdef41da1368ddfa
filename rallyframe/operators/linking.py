"""Quotes to feature rows by names and dates: blocking keys, nearest date, similarity, and an audit of every row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.names import full_anchor, full_signatures, normalize_name, pair_key, short_anchor, short_signature
from rallyframe.functions.scalars import logit, two_way_probability
from rallyframe.functions.similarity import event_similarity
from rallyframe.operators.candidates import best_two
from rallyframe.session import stage, stage_table


@dataclass(frozen=True)
class AnchorWeights:
    """Weights of pair, event and date in a candidate's total, and of initials in a name's similarity."""

    pair: float = 0.84
    event: float = 0.12
    date: float = 0.04
    initials: float = 0.16
    #: Whether rows without any anchor in common may meet quotes of a similar event on the same days.
    by_date: bool = False


NARROW = AnchorWeights()
WIDE = AnchorWeights(0.82, 0.13, 0.05, 0.18, True)


def _sides(features: DataFrame, quotes: DataFrame, day: str, feature_id: str, quote_id: str) -> tuple[DataFrame, DataFrame]:
    f = features.select(F.col(feature_id).alias("f"), F.col(day).cast("date").alias("fday"), "player_a", "player_b", F.col("tourney_name").alias("fevent"))
    event = F.col("tournament") if "tournament" in quotes.columns else F.lit(None).cast("string")
    q = quotes.select(F.col(quote_id).alias("q"), F.col("date").cast("date").alias("qday"), "player1", "player2", event.alias("qevent"), "odd1", "odd2")
    q = q.where("qday is not null and odd1 > 1 and odd2 > 1 and not isnan(odd1) and not isnan(odd2)")
    own, other = {"na": normalize_name("player_a"), "nb": normalize_name("player_b")}, {"n1": normalize_name("player1"), "n2": normalize_name("player2")}
    return stage_table(f.withColumns(own).drop("player_a", "player_b")), stage_table(q.withColumns(other).drop("player1", "player2", "odd1", "odd2"))


def _near(f: DataFrame, q: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Rows with equal ``keys`` at most ``days`` apart. Both meet in cells of the calendar, so a key that holds
    a large part of the rows is spread over time."""
    width = days + 1
    cell = F.floor(F.unix_date("qday") / width)
    near = q.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    met = f.withColumn("cell", F.floor(F.unix_date("fday") / width)).join(near, [*keys, "cell"]).drop("cell")
    return met.withColumn("gap", F.abs(F.datediff("qday", "fday"))).where(F.col("gap") <= days)


def _audit(f: DataFrame, best: DataFrame, feature_id: str) -> DataFrame:
    return f.select("f").join(best, "f", "left").withColumnRenamed("f", feature_id)


def _result(audit: DataFrame, features: DataFrame, quotes: DataFrame, feature_id: str, quote_id: str) -> DataFrame:
    """Matched feature rows with their quotes, turned to A and B."""
    won = audit.where("status = 'matched'").select(feature_id, F.col("q").alias(quote_id), F.col("gap").alias("odds_date_gap"), F.col("event_similarity").alias("odds_event_similarity"), "swapped")
    odds = quotes.select(F.col(quote_id), F.col("date").cast("date").alias("odds_date"), "odd1", "odd2", *[c for c in ("source",) if c in quotes.columns])
    out = features.join(won, feature_id).join(odds, quote_id)
    out = out.withColumns({"odd_a": F.when(F.col("swapped"), F.col("odd2")).otherwise(F.col("odd1")), "odd_b": F.when(F.col("swapped"), F.col("odd1")).otherwise(F.col("odd2"))}).drop("odd1", "odd2", "swapped")
    out = out.withColumn("market_probability_a", two_way_probability("odd_a", "odd_b"))
    return out.withColumn("market_logit_a", logit("market_probability_a"))


def _event_score(how: str) -> Column:
    if how == "ratio":
        return event_similarity("fevent", "qevent")
    a, b = normalize_name("fevent"), normalize_name("qevent")
    return F.coalesce(((a != "") & (a == b)).cast("double"), F.lit(0.0))


def _first(candidates: DataFrame, order: list[Column]) -> DataFrame:
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("f").orderBy(*order))).where("place = 1").drop("place")


def link_exact(features: DataFrame, quotes: DataFrame, feature_id: str = "row_id", quote_id: str = "odds_id", day: str = "event_start_date", max_gap: int = 8, events: str = "ratio") -> tuple[DataFrame, DataFrame]:
    """Quotes whose two normalized names equal a row's, in either order, nearest in days; events break ties, then the smaller id.

    Returns matched rows and an audit of every row: matched, no_pair (no quote of the two at all) or
    date_gap (none within ``max_gap`` days). ``events`` is ratio (matching blocks) or equal (1 for equal names, else 0). Null names normalize to nothing and match each other
    only; the result of a match is never looked at.
    """
    f, q = _sides(features, quotes, day, feature_id, quote_id)
    f, q = f.withColumn("pair", pair_key("na", "nb")), q.withColumn("pair", pair_key("n1", "n2"))
    met = _near(f, q, ["pair"], max_gap).withColumn("event_similarity", _event_score(events))
    best = _first(met, [F.asc("gap"), F.desc("event_similarity"), F.asc("q")]).select("f", "q", "gap", "event_similarity", (F.col("n1") != F.col("na")).alias("swapped"))
    paired = q.select("pair").distinct().withColumn("paired", F.lit(True))
    audit = f.select("f", "pair").join(paired, "pair", "left").join(best, "f", "left")
    audit = audit.select(F.col("f").alias(feature_id), F.when(F.col("q").isNotNull(), "matched").when(F.col("paired"), "date_gap").otherwise("no_pair").alias("status"), "q", "gap", "event_similarity", "swapped")
    audit = stage(audit)
    return _result(audit, features, quotes, feature_id, quote_id), audit.withColumnRenamed("q", quote_id)


def link_signatures(features: DataFrame, quotes: DataFrame, feature_id: str = "row_id", quote_id: str = "odds_id", day: str = "event_start_date", max_gap: int = 8, events: str = "ratio") -> tuple[DataFrame, DataFrame]:
    """As ``link_exact`` for quotes that name players by surnames and an initial.

    A full name has the signatures of its endings with its first initial; a quote meets a row if its
    two signatures are among those of the row's two players. The audit also counts how many rows
    took the same quote (``reuse``); ``events`` is as there; its statuses are matched, no_pair and date_or_orientation_fail.
    """
    f, q = _sides(features, quotes, day, feature_id, quote_id)
    q = stage_table(q.select("q", "qday", "qevent", short_signature(F.col("n1")).alias("s1"), short_signature(F.col("n2")).alias("s2")).withColumns({"low": F.least("s1", "s2"), "high": F.greatest("s1", "s2")}))
    # A row has several pairs of signatures, of which few are any quote's: they meet as hashes, and only those that hit are compared by letters.
    key = lambda a, b: F.xxhash64(F.least(a, b), F.greatest(a, b)).alias("key")
    keyed = f.select("f", "nb", F.explode(full_signatures(F.col("na"))).alias("sa")).select("f", "sa", F.explode(full_signatures(F.col("nb"))).alias("sb")).select("f", key("sa", "sb"))
    hits = keyed.join(q.select("low", "high", key("low", "high")).distinct(), "key").select("f", "low", "high").distinct()
    hits = hits.join(f, "f").withColumns({"sa": full_signatures(F.col("na")), "sb": full_signatures(F.col("nb"))})
    both = lambda a, b: F.array_contains("sa", F.col(a)) & F.array_contains("sb", F.col(b))
    hits = stage_table(hits.where(both("low", "high") | both("high", "low")).select("f", "fday", "fevent", "sa", "low", "high"))
    met = _near(hits, q, ["low", "high"], max_gap).withColumns({"swapped": ~F.array_contains("sa", F.col("s1")), "event_similarity": _event_score(events)})
    best = _first(met, [F.asc("gap"), F.desc("event_similarity"), F.asc("q")]).select("f", "q", "gap", "event_similarity", "swapped")
    paired = hits.select("f").distinct().withColumn("paired", F.lit(True))
    audit = f.select("f").join(paired, "f", "left").join(best, "f", "left")
    audit = audit.select(F.col("f").alias(feature_id), F.when(F.col("q").isNotNull(), "matched").when(F.col("paired"), "date_or_orientation_fail").otherwise("no_pair").alias("status"), "q", "gap", "event_similarity", "swapped")
    uses = audit.where("q is not null").groupBy("q").agg(F.count(F.lit(1)).alias("reuse"))
    audit = stage_table(audit.join(uses, "q", "left"))
    return _result(audit, features, quotes, feature_id, quote_id), audit.withColumnRenamed("q", quote_id)


def link_anchors(features: DataFrame, quotes: DataFrame, feature_id: str = "row_id", quote_id: str = "odds_id", day: str = "date", max_gap: int = 8, min_pair: float = 0.78, margin: float = 0.035, weights: AnchorWeights = NARROW) -> tuple[DataFrame, DataFrame]:
    """As ``link_exact`` for loosely written names: candidates by surname anchors, chosen by weighted similarity.

    Candidates come in tiers, each for the rows that the tier before left without one: both anchors
    equal; one anchor equal; and with ``weights.by_date`` all quotes within the days whose event is
    at least 0.45 alike (rows whose days have no such event stay without a candidate). The best total wins. Rows whose best pair is below
    ``min_pair`` are low_name_score, those whose runner-up is a good pair within ``margin`` ambiguous,
    those without a candidate no_candidate. Ties go to the better pair, event and date, then the
    smaller quote id. The audit has pair, total, margin, candidates and the tier.
    """
    f, q = _sides(features, quotes, day, feature_id, quote_id)
    f = f.withColumns({"a1": full_anchor(F.col("na")), "a2": full_anchor(F.col("nb"))}).withColumn("pair", pair_key("a1", "a2"))
    q = q.withColumns({"q1": short_anchor(F.col("n1")), "q2": short_anchor(F.col("n2"))}).withColumn("pair", pair_key("q1", "q2"))
    first = stage_table(best_two(f, q, "pair", max_gap, weights, "pair_anchor"))
    rest = f.join(first.select("f").distinct(), "f", "left_anti")
    one = rest.withColumn("anchor", F.explode(F.array_distinct(F.filter(F.array("a1", "a2"), lambda x: x != "")))).drop("pair")
    two = q.withColumn("anchor", F.explode(F.array_distinct(F.filter(F.array("q1", "q2"), lambda x: x != "")))).drop("pair")
    # A row and a quote with both anchors in common are of the first tier, so none meet twice here.
    second = stage_table(best_two(one, two, "anchor", max_gap, weights, "single_anchor"))
    scored = first.unionByName(second)
    if weights.by_date:
        left, every = [x.withColumn("all", F.lit("")) for x in (rest.join(second.select("f").distinct(), "f", "left_anti"), q)]
        scored = scored.unionByName(stage_table(best_two(left, every, "all", max_gap, weights, "date_fallback", 0.45)))
    order = Window.partitionBy("f").orderBy(F.desc("total"), F.desc("pair_score"), F.desc("event_similarity"), F.asc("gap"), F.asc("q"))
    every = Window.partitionBy("f")
    ranked = scored.withColumns({"place": F.row_number().over(order), "next_total": F.lead("total").over(order), "next_pair": F.lead("pair_score").over(order), "candidates": F.sum("met").over(every)})
    best = ranked.where("place = 1").withColumn("margin", F.coalesce(F.col("total") - F.col("next_total"), F.lit(1.0)))
    status = F.when(F.col("pair_score") < min_pair, "low_name_score").when((F.col("margin") < margin) & (F.col("next_pair") >= min_pair), "ambiguous").otherwise("matched")
    best = best.select("f", status.alias("status"), "q", "gap", "event_similarity", "swapped", "pair_score", "total", "margin", "candidates", "tier")
    audit = stage(_audit(f, best, feature_id).withColumn("status", F.coalesce("status", F.lit("no_candidate"))))
    return _result(audit, features, quotes, feature_id, quote_id), audit.withColumnRenamed("q", quote_id)
