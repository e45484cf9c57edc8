"""What to do with a found candidate: skip or try again by the stored source, local reject rules, where it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as v

#: A source is known by these.
KEY = ["platform", "platform_video_id"]


def age_hours(as_of: Column) -> Column:
    """Hours since the last attempt, or since the row was made; none count as no time at all."""
    last = F.coalesce("last_attempt_at", "created_at", as_of)
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 3.6e9


def decision(as_of: Column, unresolved: float = v.UNRESOLVED_HOURS, failed: float = v.FAILED_HOURS, stale: float = v.STALE_HOURS, rejected_days: float = v.REJECTED_DAYS) -> Column:
    """A struct of ``skip`` and ``why`` for a stored source; an unresolved duration is looked at before the status."""
    age, status = age_hours(as_of), F.col("status")

    def waits(hours: float, skip: str, retry: str) -> Column:
        return F.when(age < hours, F.struct(F.lit(True).alias("skip"), F.lit(skip).alias("why"))).otherwise(F.struct(F.lit(False).alias("skip"), F.lit(retry).alias("why")))

    return (
        F.when(F.coalesce("reject_reason", F.lit("")) == v.DURATION_UNRESOLVED, waits(unresolved, "duration_unresolved_recent", "retry_duration_unresolved"))
        .when(status.isin(*v.COMPLETED), F.struct(F.lit(True).alias("skip"), F.lit("already_processed").alias("why")))
        .when(status.isin(*v.IN_PROGRESS), waits(stale, "in_progress", "stale_in_progress"))
        .when(status.isin(*v.REJECTED), waits(rejected_days * 24, "recently_rejected", "retry_rejected"))
        .when(status.isin(*v.FAILED), waits(failed, "recent_failure", "retry_failed"))
        .otherwise(F.struct(F.lit(False).alias("skip"), F.lit("unknown_status").alias("why")))
    )


def decided(found: DataFrame, sources: DataFrame, as_of: Column, **hours: float) -> DataFrame:
    """``found`` with ``skip`` and ``why``; a candidate without a stored source is ``new``."""
    stored = sources.select(*KEY, decision(as_of, **hours).alias("_d"))
    joined = found.join(stored, KEY, "left")
    return joined.select(*[F.col(f"`{c}`") for c in found.columns], F.coalesce("_d.skip", F.lit(False)).alias("skip"), F.coalesce("_d.why", F.lit("new")).alias("why"))


def off_topic(title: Column, material: Column, words: tuple[str, ...] = v.OFF_TOPIC) -> Column:
    """A title with an off-topic word, unless it holds the material or one of its characters."""
    text, name = F.coalesce(title, F.lit("")), F.coalesce(material, F.lit(""))
    shares = F.exists(F.split(name, ""), lambda c: (c != "") & F.contains(text, c))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit & ~shares


def filtered(found: DataFrame, sources: DataFrame, as_of: Column, low: float = 5.0, high: float = 300.0, words: tuple[str, ...] = v.OFF_TOPIC, **hours: float) -> DataFrame:
    """``found`` with ``accepted``, ``reason``, ``detail`` (why the stored source is skipped) and ``duration_unknown``.

    The first rule that holds names the reason: no id or url, unreadable, no video, id and then
    url seen in this run, stored source to be skipped, url stored though the source is new, length
    out of range, unrelated title. An unknown length is accepted as such before length and title are
    looked at. Sources and urls come by two joins; a url that is stored many times counts once.
    """
    urls = sources.filter("source_url <> ''").select("source_url").distinct().withColumn("_stored", F.lit(True))
    rows = decided(found, sources, as_of, **hours).join(urls, "source_url", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    unknown = F.col("duration").isNull()
    reason = (
        F.when(blank("platform_video_id") | blank("source_url"), "unreachable").when(on("unreadable"), "corrupt_media").when(on("no_video"), "unusable_media")
        .when(on("seen_id"), "duplicate_video").when(on("seen_url"), "duplicate_url").when(F.col("skip"), "already_processed")
        .when((F.col("why") == "new") & on("_stored"), "duplicate_url").when(unknown, None).when(~F.col("duration").between(low, high), "duration_out_of_range")
        .when(off_topic(F.col("title"), F.col("material"), words), "title_irrelevant")
    )
    rows = rows.withColumn("reason", reason)
    accepted = F.col("reason").isNull()
    return rows.select(
        *[F.col(f"`{c}`") for c in found.columns], accepted.alias("accepted"), "reason",
        F.when(F.col("reason") == "already_processed", F.col("why")).alias("detail"), (accepted & unknown).alias("duration_unknown"),
    )


def provenance(adapter: Column, platform: Column, video_id: Column, url: Column) -> Column:
    """Mock, local test, real or unknown: by adapter, else by platform; a real one needs an id of twelve digits or more."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    long = F.trim(F.coalesce(video_id, F.lit(""))).rlike(v.LONG_ID)
    address = F.coalesce(url, F.lit(""))
    kinds = {k: F.lit(kind) for k, kind in v.ADAPTER_KINDS.items()}
    by_adapter, by_platform = dict(kinds), dict(kinds)
    by_adapter["douyin"] = F.when(long, "douyin_real").otherwise("mock")
    by_platform["douyin"] = F.when(long & ((address == "") | F.contains(address, F.lit("douyin.com"))), "douyin_real").otherwise("mock")
    kind = F.lit("unknown")
    for source, named in ((platform, by_platform), (adapter, by_adapter)):
        chosen = F
        for name, value in named.items():
            chosen = chosen.when(clean(source) == name, value)
        kind = chosen.otherwise(kind)
    return kind


def rejection_bucket(reason: Column, subtitle: Column, quality: Column) -> Column:
    """The counter of a rejection: duplicate and subtitle by the sets of reasons, then by where it was rejected."""
    among = lambda names: F.coalesce(reason.isin(*names), F.lit(False))
    return F.when(among(v.BOOKKEEPING_REASONS), "duplicate").when(F.coalesce(subtitle, F.lit(False)) | among(v.SUBTITLE_REASONS), "subtitle").when(F.coalesce(quality, F.lit(False)), "quality").otherwise("other")


def source_flags(hits: DataFrame, sources: DataFrame, clips: DataFrame) -> DataFrame:
    """``hits`` (``task_id``, ``query``, ``seq`` and a source's key) with ``again``, ``new``, ``known``, ``processed`` and ``represented``.

    ``again`` marks later hits of a source within a task; clips are counted per source before they
    are joined.
    """
    made = clips.groupBy("source_id").agg(F.count("*").alias("_clips"))
    stored = sources.select(*KEY, "source_id", F.col("status").isin(*v.HANDLED).alias("_handled")).join(made, "source_id", "left").drop("source_id")
    first = hits.groupBy("task_id", *KEY).agg(F.min("seq").alias("_first"))
    joined = hits.join(first, ["task_id", *KEY]).join(stored.withColumn("_known", F.lit(True)), KEY, "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in hits.columns], (F.col("seq") > F.col("_first")).alias("again"), F.col("_known").isNull().alias("new"), on(F.col("_known")).alias("known"),
        on(F.col("_handled")).alias("processed"), on(F.col("_clips") > 0).alias("represented"),
    )


def yield_rows(flagged: DataFrame) -> DataFrame:
    """One row of counters per task and query over flagged hits with ``accepted``, ``downloaded`` and ``clips``; two steps, so that a frequent query is summed where it lies."""
    count = lambda c: F.count_if(F.col(c)).alias(c)
    return flagged.withColumn("fresh", ~F.col("again")).groupBy("task_id", "query").agg(
        F.count("*").alias("candidates"), F.count_if("fresh").alias("uniques"), F.count_if("again").alias("current_run_duplicate"), F.count_if("new").alias("new_to_system"),
        F.count_if("known").alias("known_source"), F.count_if("processed").alias("already_processed"), F.count_if("represented").alias("already_represented"),
        count("accepted"), F.count_if("downloaded").alias("downloads"), F.sum("clips").alias("clips"),
    )


def _named(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def previews(rows: DataFrame, least_relevance: float = 0.35, least_quality: float = 0.45) -> DataFrame:
    """``rows`` with ``accepted``, ``reason``, ``subtitle_rejected``, ``failed`` and ``rule``, the one that decided.

    The model's answer (``answered``, ``accept``, ``reject_reason``, ``material_visible``, ``relevance``, ``quality``,
    ``complexity``) is judged in order: no frames, no answer (a failure to be tried again, no rejection), its own rejection, no
    material, low quality. Then the measured class and cleanliness decide on text where there is a
    measurement (``measured_class`` not null), by hard classes and the limit of the ``policy``; else the complexities
    that the policy allows. An unknown policy is the strict one.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    policy = F.when(F.col("policy").isin(*v.SCORE_LIMITS), F.col("policy")).otherwise("strict")
    measured = F.col("measured_class").isNotNull()
    score = F.bround(1.0 - F.col("cleanliness"), 3)
    allowed = F.create_map(*[x for k, own in v.COMPLEXITIES.items() for x in (F.lit(k), F.array(*map(F.lit, own)))])[policy]
    told = F.coalesce("reject_reason", F.lit("other"))
    of_class = F.coalesce(_named(v.CLASS_REASONS, F.col("measured_class")), F.lit("subtitle_too_complex"))
    rules = [
        ("frames", F.col("frames") <= 0, F.lit("unusable_visual"), F.lit(False)), ("answer", ~on("answered"), F.lit("other"), F.lit(False)), ("model", ~on("accept"), told, told.isin(*v.SUBTITLE_REASONS)),
        ("material", ~on("material_visible") | (F.col("relevance") < least_relevance), F.lit("no_material"), F.lit(False)), ("quality", F.col("quality") < least_quality, F.lit("low_quality"), F.lit(False)),
        ("class", measured & F.col("measured_class").isin(*v.HARD_CLASSES), of_class, F.lit(True)), ("score", measured & (score > _named(v.SCORE_LIMITS, policy)), of_class, F.lit(True)),
        ("complexity", ~measured & ~F.array_contains(allowed, F.coalesce("complexity", F.lit("unknown"))), F.lit("subtitle_too_complex"), F.lit(True)),
    ]
    found = F
    for name, hit, reason, text in rules:
        found = found.when(F.coalesce(hit, F.lit(False)), F.struct(reason.alias("reason"), text.alias("text"), F.lit(name).alias("rule")))
    found = found.otherwise(F.struct(F.lit(None).cast("string").alias("reason"), F.lit(False).alias("text"), F.when(measured, "measurement").otherwise("policy").alias("rule")))
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns], found.alias("_f"))
    shown = [F.col(f"`{c}`") for c in rows.columns if c != "_f"]
    return rows.select(*shown, F.col("_f.reason").isNull().alias("accepted"), "_f.reason", F.col("_f.text").alias("subtitle_rejected"), (F.col("_f.rule") == "answer").alias("failed"), "_f.rule")


def duration_routes(rows: DataFrame, low: float = 5.0, high: float = 300.0) -> DataFrame:
    """``rows`` with ``ready``, ``reason`` and ``status`` after the probe of a source whose length was unknown.

    Without a length the probe's ``state`` gives both; with one the source limits are tested, a limit of 0 being none.
    """
    reasons, statuses = ({k: x[i] for k, x in v.PROBE_STATES.items()} for i in (0, 1))
    seconds = F.col("seconds")
    outside = (F.lit(low > 0) & (seconds < low)) | (F.lit(high > 0) & (seconds > high))
    reason = F.when(seconds.isNull(), F.coalesce(_named(reasons, F.col("state")), F.lit(v.OTHER_PROBE[0]))).when(outside, "duration_out_of_range")
    status = F.when(seconds.isNull(), F.coalesce(_named(statuses, F.col("state")), F.lit(v.OTHER_PROBE[1]))).when(outside, "rejected")
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns], reason.isNull().alias("ready"), reason.alias("reason"), status.alias("status"))


def stage_gate(clips: DataFrame) -> DataFrame:
    """``clips`` with ``accepted`` and ``reason``: a clip of another stage than ``wanted_stage``, if any is wanted, is rejected."""
    other = F.coalesce((F.col("wanted_stage") != "") & ~F.col("stage").eqNullSafe(F.col("wanted_stage")), F.lit(False))
    return clips.select(*[F.col(f"`{c}`") for c in clips.columns], (~other).alias("accepted"), F.when(other, "target_stage_mismatch").alias("reason"))
