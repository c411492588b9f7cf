from loamgraph.operators import alike, lifecycle
from loamgraph.session import keep
from pyspark.sql import functions as F
from test_alike import few_words
from test_knowledge import NOW, entry, know, links


def nodes(spark):
    return spark.createDataFrame([("u1", "h1"), (None, "h2")], "uuid string, body_hash string")


def test_health_counts_a_pair_of_rows_once(spark):
    """Two states of an entry whose uuid differed in case stay two rows: two pairs with the third, as in the SQL."""
    k = know(spark, entry("x", "same words"), entry("x", "same words"), entry("y", "same words"))
    r = lifecycle.health(k, links(spark, ("x", "u1", "r")), nodes(spark), NOW).first()
    assert (r.total, r.duplicate_candidates, r.nodes) == (3, 2, 2)


def test_health_joins_no_pair(spark):
    plan = lifecycle.health(few_words(spark), links(spark, ("000", "x", "r", True)), nodes(spark), NOW)._jdf.queryExecution().toString()
    assert "title_a" not in plan


def test_pack_shuffles_texts_without_words_and_hashes(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(alike, "cut", lambda df, own=alike.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    lifecycle.similar_entries(few_words(spark), 0.6)
    (plan,) = plans
    below = plan[plan.index("RepartitionByExpression") :]
    assert "split(" in plan and "hash(" not in plan and "split(" not in below


def test_kept_rows_are_the_same(spark):
    k = few_words(spark).repartition(3)
    assert sorted(map(str, keep(k).collect())) == sorted(map(str, k.collect())) and keep(k).schema == k.schema
    assert keep(k.limit(0)).count() == 0


def test_review_makes_entries_once(spark):
    k = few_words(spark).groupBy("uuid").agg(*(F.first(c).alias(c) for c in few_words(spark).columns if c != "uuid"))
    plan = lifecycle.review_queue(k, links(spark, ("000", "x", "r", True)), nodes(spark), NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(" not in plan
