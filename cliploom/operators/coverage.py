"""Coverage of a clip library: counts, averages and gaps per category, stage and dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import REVIEWS, STAGES

TARGET = 8
#: Scores of a clip, and quality bands of the overall one from the lower edge.
AVERAGED = ("material_score", "visual", "cleanliness", "stability", "composition", "overall")
BANDS = (("band_90", 0.9), ("band_80", 0.8), ("band_70", 0.7))


def label(column: str, blank: str) -> Column:
    return F.when(F.coalesce(F.trim(column), F.lit("")) == "", F.lit(blank)).otherwise(F.col(column))


def ratio(a: Column, b: Column) -> Column:
    """Null without a denominator."""
    return F.when(b > 0, F.bround(a / b, 3))


def priority(total: Column, target: Column) -> Column:
    """Nothing at all is critical, less than half the target high, less than the target medium, else healthy; so is no target."""
    share = total / target
    return F.when(target <= 0, "healthy").when(total == 0, "critical").when(share < 0.5, "high").when(share < 1, "medium").otherwise("healthy")


def summary(clips: DataFrame) -> DataFrame:
    return clips.groupBy(label("category", "(legacy)").alias("category")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("provenance") == "remote").alias("real"),
        F.count_if(F.col("review_status") == "approved").alias("approved"),
        F.count_if("favorite").alias("favorites"),
        *[F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(f"avg_{c}") for c in AVERAGED],
    )


def stages(clips: DataFrame, target: int = TARGET, approved_only: bool = False) -> DataFrame:
    """Every known stage for every category, zero-filled; stages found beside them are appended.

    Known stages count approved clips only if asked to; ``missing`` always uses all clips.
    """
    spark = clips.sparkSession
    keyed = clips.select(label("category", "(legacy)").alias("category"), label("stage", "other").alias("stage"), "review_status")
    counts = keyed.groupBy("category", "stage").agg(F.count("*").alias("total"), F.count_if(F.col("review_status") == "approved").alias("approved"))
    known = spark.createDataFrame([(s,) for s in STAGES], "stage string")
    grid = counts.select("category").distinct().crossJoin(F.broadcast(known))  # a few categories by fifteen stages
    full = grid.join(counts, ["category", "stage"], "full")
    total, approved = F.coalesce("total", F.lit(0)), F.coalesce("approved", F.lit(0))
    goal = F.when(F.col("stage").isin(STAGES), F.lit(target)).otherwise(F.lit(0))
    count = F.when(F.lit(approved_only) & F.col("stage").isin(STAGES), approved).otherwise(total)
    return full.select(
        "category", "stage", count.alias("count"), total.alias("total"), approved.alias("approved"), goal.alias("target"),
        F.greatest(goal - total, F.lit(0)).alias("missing"), F.when(goal <= 0, 1.0).otherwise(ratio(total, goal)).alias("ratio"), priority(total, goal).alias("priority"),
    )


def dimension(clips: DataFrame, column: str) -> DataFrame:
    return clips.groupBy(label("category", "(legacy)").alias("category"), label(column, "unknown").alias(column)).agg(F.count("*").alias("n"))


def edit_roles(clips: DataFrame) -> DataFrame:
    roles = clips.select(label("category", "(legacy)").alias("category"), "clip_id", F.explode(F.array_distinct(F.split("roles", ","))).alias("role"))
    return roles.groupBy("category", "role").agg(F.count("*").alias("n"))  # a clip has each role once


def quality(clips: DataFrame) -> DataFrame:
    upper, bands = None, []
    for name, low in BANDS:
        hit = F.col("overall") >= low
        bands.append(F.count_if(hit & (F.col("overall") < upper) if upper else hit).alias(name))
        upper = low
    return clips.groupBy(label("category", "(legacy)").alias("category")).agg(*bands, F.count_if(F.col("overall") < upper).alias("band_low"))


def reviews(clips: DataFrame) -> DataFrame:
    """Every review status, zero-filled, then favourites and the total."""
    status = label("review_status", "unreviewed")
    names = [*(s for s in REVIEWS if s), "favorite", "total"]
    row = clips.agg(*[F.count_if(status == s).alias(s) for s in names[:-2]], F.count_if("favorite").alias("favorite"), F.count("*").alias("total"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("status"), F.col(n).alias("n")) for n in names])).alias("r")).select("r.*")


def gaps(clips: DataFrame, target: int = TARGET) -> DataFrame:
    """Stages below target by priority, missing clips and name."""
    order = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).otherwise(2)
    below = stages(clips, target).filter("missing > 0").withColumn("priority_order", order)
    return below.select("category", "stage", "total", "missing", "priority", "priority_order").orderBy("priority_order", F.desc("missing"), "stage", "category")


def overview(clips: DataFrame, chosen: Column, real: str) -> DataFrame:
    """Header numbers in one pass: all clips, those of provenance ``real``, review states, and those ``chosen`` with their seconds."""
    status = F.coalesce(F.nullif(F.col("review_status"), F.lit("")), F.lit("unreviewed"))
    return clips.agg(
        F.count("*").alias("total"), F.count_if(F.col("provenance") == real).alias("real"), F.count_if(status == "unreviewed").alias("unreviewed"),
        F.count_if(status == "approved").alias("approved"), F.count_if("favorite").alias("favorite"), F.count_if(chosen).alias("filtered"),
        F.bround(F.coalesce(F.sum(F.when(chosen, F.col("duration"))), F.lit(0.0)), 2).alias("filtered_seconds"),
    )


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``category, stage, change``: how the counts (``category, stage, total``) of two snapshots differ.

    Stages that one side lacks count 0 there, unchanged ones are left out. A category that either
    side knows nothing of has nothing to be compared with and no rows.
    """
    old, new = (df.groupBy("category", "stage").agg(F.sum("total").alias(name)) for df, name in ((before, "old"), (after, "new")))
    both = old.join(new, ["category", "stage"], "full")
    both = both.join(old.select("category").distinct(), "category", "left_semi").join(new.select("category").distinct(), "category", "left_semi")
    change = F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))
    return both.select("category", "stage", change.alias("change")).filter("change <> 0")
