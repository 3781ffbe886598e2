"""Evaluation of retrieval: precision, recall, latency, grounding, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def precision_recall(ranked: DataFrame, truth: DataFrame, ks: list[int], query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """P@K with K as denominator and R@K per query; both null for queries without ground truth, 0 where nothing was found.

    ``truth`` has query and n_relevant; ``ranked`` has query, rank and is_relevant."""
    aggs = [F.count_if((F.col("rank") <= k) & F.col("is_relevant")).alias(f"h{k}") for k in ks]
    hits = ranked.groupBy(query).agg(*aggs)
    joined = truth.join(hits, query, "left").fillna(0, [f"h{k}" for k in ks])
    have = F.col("n_relevant") > 0
    out = [F.when(have, F.round(F.col(f"h{k}") / k, 6)).alias(f"precision_{k}") for k in ks] + [F.when(have, F.round(F.col(f"h{k}") / F.col("n_relevant"), 6)).alias(f"recall_{k}") for k in ks]
    return joined.select(query, *out)


def order_statistics(df: DataFrame, group: str, value: str, buckets: int = 1000) -> DataFrame:
    """Exact count, min, max, mean, median and p90 (the element at floor(0.9 n) of the sorted values) per group.

    Values are counted in buckets of equal width first; only the rows of the buckets that hold a wanted rank are sorted, so no group
    is ever sorted as a whole."""
    rows = df.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    facts = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.avg("v").alias("mean_value"))
    wide = rows.join(facts.select(group, "min_value", "max_value"), group)
    share = (F.col("v") - F.col("min_value")) / F.nullif(F.col("max_value") - F.col("min_value"), F.lit(0.0))
    wide = wide.withColumn("b", F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")).select(group, "b", "v")
    counts = wide.groupBy(group, "b").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    ranks = facts.select(group, F.explode(F.array(*[F.struct(F.lit(name).alias("what"), F.floor(expr).cast("long").alias("r")) for name, expr in (("low", (F.col("n") - 1) / 2), ("high", F.col("n") / 2), ("p90", F.col("n") * 0.9))])).alias("x")).select(group, "x.*")
    wanted = ranks.join(counts, group).filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("c"))).select(group, "b", "what", (F.col("r") - F.col("before")).alias("inner"))
    # equal values are counted once, so that ties do not make a bucket heavy
    inside = wide.join(wanted.select(group, "b").distinct(), [group, "b"], "left_semi").groupBy(group, "b", "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(group, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("c").over(upto))
    hit = (F.col("inner") >= F.col("upto") - F.col("c")) & (F.col("inner") < F.col("upto"))
    found = inside.join(wanted, [group, "b"]).filter(hit).groupBy(group).agg(*[F.max(F.when(F.col("what") == x, F.col("v"))).alias(x) for x in ("low", "high", "p90")])
    return facts.join(found, group).select(group, "n", "min_value", "max_value", F.round("mean_value", 6).alias("mean_value"), F.round((F.col("low") + F.col("high")) / 2, 6).alias("median_value"), F.col("p90").alias("p90_value"))


def grounding(evidence: DataFrame, files: DataFrame, tolerance: int = 0) -> DataFrame:
    """``files`` has file_id and n_lines; fabricated where the file does not exist, unsupported where the lines do not, else grounded."""
    known = files.select("file_id", F.col("n_lines").alias("_n"))
    joined = evidence.join(known, "file_id", "left")
    status = F.when(F.col("_n").isNull(), "fabricated").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("_n") + tolerance), "unsupported").otherwise("grounded")
    return joined.withColumn("status", status)


def count_accuracy(expected: str, actual: str):
    """1.0 for the exact count, 0.5 within one, else 0.0."""
    gap = F.abs(F.col(expected) - F.col(actual))
    return F.when(gap == 0, 1.0).when(gap <= 1, 0.5).otherwise(0.0)
