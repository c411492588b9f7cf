"""One ranking from scores on unlike scales: outranking net flow on percentiles.

Within a query each score becomes a percentile (the share of the other candidates whose score is lower, so only order counts).
A candidate is preferred to another, per score, by a linear preference function of the difference d of their
percentiles: 0 up to ``indifference``, 1 from ``preference`` on. The mean preference over all others is the
positive flow, the mean preference of all others over it the negative flow; the weighted sum over the scores of
positive minus negative flow ranks the candidates. Both flows are exact for all pairs without forming a pair:
they follow from the count and the sum of the percentiles below a bound, which are prefix sums along the sorted score.
With indifference 0 and preference 1 no threshold bends the preference, all sums are whole numbers, so equal candidates tie
exactly, and the net flow orders like the weighted mean of the percentiles; other thresholds count a lead in one score
only as far as it exceeds the first and not beyond the second.

Nulls, ties and odd input: a null or NaN score counts as the lowest, all such tie; ties share their percentile and
equal flows are ordered by the candidate's key; repeated rows of a candidate count once, at their earliest;
rows without query or candidate are left out; a lone candidate has flow 0; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.operators.prefix import prefix_sums
from loamgraph.session import cut

#: A (query, score) with more distinct values is cut into bins at approximate quantiles, of which there are BINS.
LARGE, BINS = 100_000, 1000


def _counted(long: DataFrame, large: int) -> DataFrame:
    """Per query, score and value: c candidates have it, below are lower, of n; sums of the positions of the lower ones, and of all.

    A position is the number of lower candidates; those of the first m sum to (m^2 - the sum of c^2 of the lower values) / 2.
    """
    keys = ["q", "s"]
    values = cut(long.groupBy(*keys, "v").agg(F.count("*").alias("c")))
    sizes = values.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.sum(F.col("c") * F.col("c")).alias("all_squares"))
    cuts = values.join(sizes.where(F.col("distinct") > large).select(*keys), keys).groupBy(*keys).agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], F.lit(10_000)).alias("cuts"))
    values = values.join(sizes.select(*keys, "n", "all_squares"), keys).join(cuts, keys, "left")
    binned = values.withColumn("bin", F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("v"))), F.lit(0))).drop("cuts")
    summed = prefix_sums(binned, keys, "bin", ["v"], {"below": F.col("c"), "squares": F.col("c") * F.col("c")})
    half = lambda count, squares: F.shiftright(F.col(count) * F.col(count) - F.col(squares), 1)
    return summed.select(*keys, "v", "c", "n", "below", half("below", "squares").alias("lower"), half("n", "all_squares").alias("whole"))


def _at_most(points: DataFrame, lookups: DataFrame, large: int) -> DataFrame:
    """Of each lookup (q, s, x): how many candidates have a position of x or less, and the sum of these positions."""
    rows = points.select("q", "s", F.col("k").cast("double").alias("x"), F.lit(0).alias("asks"), F.col("c").cast("double").alias("c"), (F.col("c") * F.col("k")).cast("double").alias("ck"))
    asked = lookups.select("q", "s", "x").distinct().select("q", "s", "x", F.lit(1).alias("asks"), F.lit(0.0).alias("c"), F.lit(0.0).alias("ck"))
    both = rows.unionByName(asked).withColumn("bin", F.floor(F.col("x") / large))
    return prefix_sums(both, ["q", "s"], "bin", ["x", "asks"], {"count": F.col("c"), "sum": F.col("ck")}).where("asks = 1").select("q", "s", "x", "count", "sum")


def net_flows(scores: DataFrame, query: str, item: str, weights: dict[str, float], time: str | None = None, indifference: float = 0.0, preference: float = 1.0, large: int = LARGE) -> DataFrame:
    """(query, item, positive, negative, flow) of every candidate; ``weights`` has the score columns, all where higher is better."""
    names = list(weights)
    clean = [F.when(~F.isnan(n), F.col(n).cast("double") + 0.0).alias(n) for n in names]
    rows = scores.select(F.col(query).alias("q"), F.col(item).alias("item"), F.struct(*([F.col(time)] if time else []), *clean).alias("r")).where("q IS NOT NULL AND item IS NOT NULL")
    rows = rows.groupBy("q", "item").agg(F.min("r").alias("r"))
    lowest, infinity = F.lit(float("-inf")), float("inf")
    value = lambda n: F.when(F.col(f"r.{n}").isNull(), lowest).when(F.col(f"r.{n}") == -infinity, F.lit(-1.7976931348623157e308)).otherwise(F.col(f"r.{n}"))
    long = cut(rows.select("q", "item", F.explode(F.array(*(F.struct(F.lit(i).alias("s"), value(n).alias("v")) for i, n in enumerate(names)))).alias("e")).select("q", "item", "e.s", "e.v"))
    points = _counted(long, large).withColumn("k", F.col("below"))
    span = F.col("n") - 1
    if indifference == 0 and preference >= 1:
        k, c, n = F.col("k"), F.col("c"), F.col("n")
        above = F.col("whole") - F.col("lower") - c * k
        plus, minus = k * k - F.col("lower"), above - k * (n - k - c)
        points = points.select("q", "s", "v", "n", (plus / preference).alias("plus"), (minus / preference).alias("minus"))
    else:
        points = cut(points)
        tiny = 1e-9  # a difference of just the threshold falls on its outer side
        bounds = {"a": F.col("k") - preference * span + tiny, "b": F.col("k") - indifference * span - tiny, "x": F.col("k") + indifference * span + tiny, "y": F.col("k") + preference * span - tiny}
        asks = points.select("q", "s", F.explode(F.array(*bounds.values())).alias("x"))
        sums = cut(_at_most(points, asks, large))
        wide = points.withColumns({f"at_{b}": e for b, e in bounds.items()})
        for b in bounds:
            wide = wide.join(sums.select("q", "s", F.col("x").alias(f"at_{b}"), F.col("count").alias(f"c_{b}"), F.col("sum").alias(f"s_{b}")), ["q", "s", f"at_{b}"])
        slope = F.greatest((preference - indifference) * span, F.lit(1e-12))
        part = lambda lo, hi, edge: (edge * (F.col(f"c_{hi}") - F.col(f"c_{lo}")) - (F.col(f"s_{hi}") - F.col(f"s_{lo}"))) / slope
        plus = F.col("c_a") + part("a", "b", F.col("k") - indifference * span)
        minus = F.col("n") - F.col("c_y") - part("x", "y", F.col("k") + indifference * span)
        points = wide.select("q", "s", "v", "n", (plus * span).alias("plus"), (minus * span).alias("minus"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights.values())), F.col("s") + 1)
    flows = long.join(points, ["q", "s", "v"]).groupBy("q", "item").agg(F.sum(weight * F.col("plus")).alias("plus"), F.sum(weight * F.col("minus")).alias("minus"), F.first("n").alias("n"))
    total = float(sum(weights.values())) or 1.0
    scale = F.when(F.col("n") > 1, (F.col("n") - 1.0) * (F.col("n") - 1) * total).otherwise(1.0)
    return flows.select(F.col("q").alias(query), F.col("item").alias(item), (F.col("plus") / scale).alias("positive"), (F.col("minus") / scale).alias("negative"), ((F.col("plus") - F.col("minus")) / scale).alias("flow"))


def top(flows: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The k first per query with their place; each task keeps only k rows per query before the shuffle."""
    w = W.partitionBy(query).orderBy(F.col("flow").desc(), item)
    return flows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
