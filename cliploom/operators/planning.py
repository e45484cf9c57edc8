"""Queries for objectives: recommended templates, ranked history, one query per family, reserves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import materials

# ---- fixed values ------------------------------------------------------------------
STAGE_TEMPLATES = {
    "raw_material": ("{material}原料", "{material} raw material"),
    "preparation": ("{material}挑选", "{material}清洗", "{material}备料"),
    "washing": ("{material}清洗机", "{material}气泡清洗"),
    "cutting": ("{material}切片", "{material}切片机", "{material}切条"),
    "loading": ("{material}装料", "{material}上料机", "{material}装盘"),
    "tray_arrangement": ("{material}摆盘", "{material}铺盘", "{material}上架"),
    "before_drying": ("{material}进烘房前", "{material}入炉"),
    "drying": ("{material}烘干过程", "{material}热泵烘干", "{material}烘干中"),
    "inside_dryer": ("{material}烘干机内部", "{material}烘干房内部", "{material}烘干设备内部"),
    "unloading": ("{material}出料", "{material}出炉", "{material}卸料"),
    "finished_product": ("{material}成品", "{material}成品展示", "{material}干货成品"),
    "packaging": ("{material}包装", "{material}装袋", "{material}封口"),
    "equipment": ("{material}烘干设备", "{material}热泵烘干机", "{material}烘干机厂家"),
    "factory": ("{material}加工厂", "{material}车间", "{material}生产线"),
    "other": ("{material}烘干现场",),
}
STAGE_LABELS = {
    "raw_material": "原料", "preparation": "备料", "washing": "清洗", "cutting": "切片", "loading": "装料",
    "tray_arrangement": "摆盘", "before_drying": "进烘房前", "drying": "烘干过程", "inside_dryer": "烘干机内部",
    "unloading": "出料", "finished_product": "成品", "packaging": "包装", "equipment": "烘干设备",
    "factory": "加工厂", "other": "烘干现场",
}
STAGE_WORDS = {
    "drying": ("烘干", "热泵", "干燥", "烘干房", "烘干机"),
    "inside_dryer": ("内部", "里面", "烘干房内", "设备内", "箱内"),
    "before_drying": ("进烘房", "入炉", "上架前", "烘房前", "装车"),
    "finished_product": ("成品", "干货", "出货", "成品展示"),
    "equipment": ("烘干机", "烘干设备", "干燥机", "热泵", "设备"),
    "factory": ("厂", "车间", "生产线", "加工厂"),
    "loading": ("装料", "上料", "装盘", "入料"),
    "tray_arrangement": ("摆盘", "铺盘", "上架", "托盘"),
    "unloading": ("出料", "出炉", "卸料", "下料"),
    "packaging": ("包装", "装袋", "封口"),
    "preparation": ("挑选", "清洗", "备料", "切片", "切条"),
}
FAMILY_WORDS = {
    "heat_pump": ("热泵", "空气能"),
    "inside_dryer": ("内部", "里面", "机内"),
    "drying_room": ("房", "烘房"),
    "dryer_equipment": ("设备", "机器", "烘干机", "风机", "热风炉"),
    "factory_line": ("车间", "生产线", "流水线", "工厂"),
    "finished_product": ("成品", "装袋", "包装", "出货"),
    "material_process": ("烘干", "干燥", "脱水", "过程", "加工"),
}
FAMILY_TEMPLATES = {
    "material_process": ("{material}烘干过程", "{material}烘干", "{material}干燥过程"),
    "heat_pump": ("{material}热泵烘干", "{material}空气能烘干"),
    "dryer_equipment": ("{material}烘干设备", "{material}烘干机", "{material}烘干设备内部"),
    "drying_room": ("{material}烘干房", "{material}烘房"),
    "inside_dryer": ("{material}烘干房内部", "{material}烘干机内部"),
    "factory_line": ("{material}烘干车间", "{material}烘干生产线", "{material}烘干流水线"),
    "finished_product": ("{material}烘干成品", "{material}成品", "{material}包装"),
}
STAGE_FAMILIES = {
    "drying": ("material_process", "heat_pump", "dryer_equipment", "inside_dryer", "drying_room", "factory_line", "finished_product"),
    "inside_dryer": ("inside_dryer", "dryer_equipment", "factory_line", "material_process"),
    "before_drying": ("material_process", "factory_line", "dryer_equipment", "finished_product"),
    "finished_product": ("finished_product", "material_process", "factory_line"),
    "equipment": ("dryer_equipment", "factory_line", "inside_dryer"),
    "factory": ("factory_line", "drying_room", "material_process"),
    "loading": ("factory_line", "material_process"),
    "tray_arrangement": ("material_process", "factory_line", "inside_dryer"),
    "unloading": ("factory_line", "material_process", "finished_product"),
    "packaging": ("finished_product", "factory_line"),
    "preparation": ("material_process", "factory_line"),
}
USUAL_FAMILIES = ("material_process", "factory_line", "other")
#: What a query whose sources are all processed already loses of its score.
REDISCOVERY = 2.0
# ---- end of fixed values -----------------------------------------------------------


def _lists(values: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for key, own in values.items() for x in (F.lit(key), F.array(*map(F.lit, own)))])


def family(query: Column, words: dict[str, tuple[str, ...]] = FAMILY_WORDS) -> Column:
    """The first family of which the query holds a word."""
    found = None
    for name, own in words.items():
        hit = query.rlike("|".join(own))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("other")


def matches_stage(query: Column, stage: Column, words: dict[str, tuple[str, ...]] = STAGE_WORDS) -> Column:
    """Does a query mention the objective; stages without words are met by every query."""
    own = _lists(words)[stage]
    return own.isNull() | F.exists(own, lambda w: F.contains(query, w))


def recommended(category: Column, stage: Column, material: Column | None = None, most: int = 6) -> Column:
    """Template queries of one gap: a spaced label, then each template for the material and the category."""
    name = F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("物料")) if material is None else material
    own = materials.base(name) if material is None else material
    templates = F.coalesce(_lists(STAGE_TEMPLATES)[stage], F.array(*map(F.lit, STAGE_TEMPLATES["other"])))
    both = F.flatten(F.transform(templates, lambda t: F.array(F.replace(t, F.lit("{material}"), own), F.replace(t, F.lit("{material}"), category))))
    label = F.create_map(*[F.lit(x) for pair in STAGE_LABELS.items() for x in pair])[stage]
    spaced = F.concat(category, F.lit(" "), label)
    lead = F.when(label.isNotNull() & ~F.array_contains(both, spaced), F.array(spaced)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.slice(F.concat(lead, F.array_distinct(both)), 1, most)


def historical(categories: DataFrame, searches: DataFrame) -> DataFrame:
    """Productive queries that hold the base name of a category.

    The pieces of a query are keys of an equi-join, but only those as long as some base name, so a
    long query makes as many pieces as it has characters for each length of a name.
    """
    named = categories.select("category", materials.base(F.col("category")).alias("base")).distinct()
    lengths = named.filter("base <> ''").agg(F.collect_set(F.length("base")).alias("lengths"))  # one row
    text = F.col("query")
    starts = lambda n: F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    pieces = F.flatten(F.transform("lengths", lambda n: F.transform(starts(n), lambda i: F.substring(text, i, n))))
    spread = searches.filter(F.col("clips") > 0).crossJoin(F.broadcast(lengths)).select(*[F.col(f"`{c}`") for c in searches.columns], F.explode(F.array_distinct(pieces)).alias("base"))
    return spread.join(named, "base").drop("base")


def rank_queries(goals: DataFrame, searches: DataFrame, limit: int = 4) -> DataFrame:
    """``category, stage, place, query, origin, score``: the best history first, then templates that are not in it.

    Only queries with clips are history. ``goals`` has category and stage.
    """
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "query"))
    best = historical(goals.select("category").distinct(), searches).withColumn("place", place).filter(F.col("place") <= max(0, limit - 2))
    held = best.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("place", "query", "score"))).alias("held"))
    none = F.expr("cast(array() as array<struct<place:int,query:string,score:double>>)")
    joined = goals.join(held, "category", "left").withColumn("held", F.coalesce("held", none))
    old = F.transform("held", lambda h: F.struct(h["query"].alias("query"), F.lit("historical").alias("origin"), h["score"].alias("score")))
    fresh = F.filter(recommended(F.col("category"), F.col("stage"), most=4), lambda t: ~F.exists("held", lambda h: h["query"] == t))
    new = F.transform(fresh, lambda t: F.struct(t.alias("query"), F.lit("template").alias("origin"), F.lit(0.0).alias("score")))
    rows = joined.select("category", "stage", F.posexplode(F.slice(F.concat(old, new), 1, limit)).alias("at", "q"))
    return rows.select("category", "stage", (F.col("at") + 1).alias("place"), "q.query", "q.origin", "q.score")


def _family_templates(goals: DataFrame) -> DataFrame:
    """``category, stage, turn, family, step, query``: templates of the families of a stage, in their order."""
    families = F.coalesce(_lists(STAGE_FAMILIES)[F.col("stage")], F.array(*map(F.lit, USUAL_FAMILIES)))
    own = goals.select("category", "stage", materials.base(F.col("category")).alias("base"), F.posexplode(families).alias("turn", "family"))
    texts = own.select("*", F.posexplode(_lists(FAMILY_TEMPLATES)[F.col("family")]).alias("step", "template"))
    return texts.select("category", "stage", "turn", "family", "step", F.replace("template", F.lit("{material}"), F.col("base")).alias("query"))


def objective_queries(goals: DataFrame, searches: DataFrame, limit: int = 4, weight: float = REDISCOVERY) -> DataFrame:
    """``category, stage, place, query, origin, family, score``: relevant history, one query per family; templates of open families; other history.

    ``searches`` has query, clips, score and ``rediscovery``, the share of a query's sources
    already processed, which costs ``weight`` times itself.
    """
    penalty = F.coalesce("rediscovery", F.lit(0.0)) * weight
    own = historical(goals.select("category").distinct(), searches.withColumn("score", F.col("score") - penalty))
    own = own.join(goals, "category").select("category", "stage", "query", "score", family(F.col("query")).alias("family"))
    own = own.withColumn("relevant", matches_stage(F.col("query"), F.col("stage")))
    keys = ["category", "stage"]
    first = Window.partitionBy(*keys, "family").orderBy(F.desc("score"), "query")
    lead = own.filter("relevant").withColumn("r", F.row_number().over(first)).filter("r = 1")
    lead = lead.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "query"))).filter(F.col("r") <= max(1, limit - 2))
    open_ = _family_templates(goals).join(lead.select(*keys, "family"), [*keys, "family"], "left_anti").join(lead.select(*keys, "query"), [*keys, "query"], "left_anti")
    open_ = open_.groupBy(*keys, "turn", "family").agg(F.min_by("query", "step").alias("query"))
    rest = own.filter("NOT relevant").withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "query"))).filter(F.col("r") <= limit)
    shown = [*keys, "query", "family"]
    rows = lead.select(*shown, "score", F.lit("historical").alias("origin"), F.lit(0).alias("tier"), "r")
    rows = rows.union(open_.select(*shown, F.lit(None).cast("double"), F.lit("template"), F.lit(1), F.col("turn")))
    taken = open_.select(*keys, "query")
    rows = rows.union(rest.join(taken, [*keys, "query"], "left_anti").select(*keys, "query", F.lit(None).cast("string"), "score", F.lit("historical"), F.lit(2), "r"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("tier", "r"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select(*keys, "place", "query", "origin", "family", "score")


def reserve_queries(goals: DataFrame, existing: DataFrame, limit: int = 4) -> DataFrame:
    """``category, stage, place, query, family``: family templates in order that ``existing`` does not hold."""
    keys = ["category", "stage"]
    left = _family_templates(goals).join(existing.select(*keys, "query"), [*keys, "query"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "step"))
    return left.withColumn("place", place).filter(F.col("place") <= limit).select(*keys, "place", "query", "family")


def production_materials(configured: list[str], clips: DataFrame) -> DataFrame:
    """``place, material``: configured names first, then the library's categories, most clips first."""
    own = clips.filter("category <> ''").groupBy(F.col("category").alias("material")).agg(F.count("*").alias("n"))
    listed = clips.sparkSession.createDataFrame([(i, m) for i, m in enumerate(dict.fromkeys(x for x in configured if x))], "at int, material string")
    both = listed.join(own, "material", "full")
    order = Window.orderBy(F.col("at").asc_nulls_last(), F.desc("n"), "material")  # one row per material
    return both.select(F.row_number().over(order).alias("place"), "material")
