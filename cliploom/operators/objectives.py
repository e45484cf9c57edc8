"""Collection objectives: priorities, best queries per gap and family, plans and funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import planning

def prioritized(queries: DataFrame, material: str = "material") -> DataFrame:
    """Bare material last; more words, then longer texts first."""
    words = F.size(F.split("query", " ")) - F.size(F.split(material, " "))
    place = F.row_number().over(Window.partitionBy(material).orderBy(F.desc("qualifiers"), F.desc(F.length("query")), "query"))
    return queries.withColumn("qualifiers", words).withColumn("place", place)


def relevance(posts: DataFrame, terms: list[str]) -> DataFrame:
    """How many of the terms a post's text holds."""
    found = sum((F.contains(F.lower("text"), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return posts.select("doc_id", found.alias("hits")).filter("hits > 0")


def best_per_family(scored: DataFrame) -> DataFrame:
    """The best historical query of each objective and family."""
    place = F.row_number().over(Window.partitionBy("objective", "family").orderBy(F.desc("clips"), "query"))
    return scored.withColumn("family", planning.family(F.col("query"))).withColumn("place", place).filter("place = 1").drop("place")


def linkage(tasks: DataFrame, sources: DataFrame, clips: DataFrame) -> DataFrame:
    """Distinct sources and clips behind every plan; clips are counted per source before the chain is joined."""
    made = clips.groupBy("source_id").agg(F.countDistinct("clip_id").alias("clips"))
    chain = tasks.select("plan_id", "task_id").distinct().join(sources.select("task_id", "source_id").distinct(), "task_id", "left").join(made, "source_id", "left")
    return chain.groupBy("plan_id").agg(F.countDistinct("task_id").alias("tasks"), F.count("source_id").alias("sources"), F.coalesce(F.sum("clips"), F.lit(0)).alias("clips"))


def timeline(events: DataFrame) -> DataFrame:
    """Events of a plan in order, with the number of the try of each query."""
    order = Window.partitionBy("plan_id").orderBy("event_id")
    tries = Window.partitionBy("plan_id", "query").orderBy("event_id")
    return events.select("event_id", "plan_id", "query", F.row_number().over(order).alias("place"), (F.row_number().over(tries) > 1).alias("again"))


def funnel(yields: DataFrame, sources: DataFrame, clips: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of totals over the whole funnel; each side is one row before the cross join."""
    a = yields.agg(F.sum("candidates").alias("candidates"), F.sum("uniques").alias("uniques"), F.sum("downloads").alias("downloads"))
    b = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "rejected_preview").alias("preview_rejected"))
    c = clips.agg(F.count("*").alias("clips"), F.count_if(F.col("review_status") == "approved").alias("approved"))
    d = runs.agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    e = yields.groupBy("query").agg(F.sum("clips").alias("n")).filter("n = 0").agg(F.count("*").alias("zero_yield_queries"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)
