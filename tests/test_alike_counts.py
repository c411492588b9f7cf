from loamgraph.operators import lifecycle
from test_alike import few_words
from test_knowledge import NOW, links


def test_health_and_review_make_no_row_of_a_candidate(spark):
    k, l = few_words(spark), links(spark, ("000", "x", "r", True))  # noqa: E741
    n = spark.createDataFrame([("u1", "h1")], "uuid string, body_hash string")
    for df in (lifecycle.health(k, l, n, NOW), lifecycle.review_queue(k, l, n, NOW)):
        assert df._jdf.queryExecution().toString().count("CartesianProduct") >= 2
