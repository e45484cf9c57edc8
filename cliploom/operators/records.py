"""Library records: model answers, tags and their bridge, exports, metadata, acceptance, cleanups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables

# ---- fixed values ------------------------------------------------------------------
SCORE_WEIGHTS = {"material_relevance": 0.35, "visual_quality": 0.2, "subtitle_cleanliness": 0.15, "stability": 0.15, "composition": 0.15}
ROLE_ALIASES = ("packaging", "preparation")
PROVIDER_MARKERS = ("quota", "403", "auth", "rate limit", "429", "unauthorized")
CLEANUP_CLASSES = ("bottom_simple", "top_simple", "single_region")
AMBIGUOUS = ("unknown", "complex", "single_region")
COMPLEXITY = {"low": 0.85, "medium": 0.5, "high": 0.15}
EXPORT_FIELDS = (
    "clip_id", "file_path", "thumbnail_path", "library_category", "material", "material_form", "material_state", "process_stage",
    "equipment_type", "equipment_visible", "shot_type", "camera_motion", "people", "subtitle_type", "edit_roles", "duration",
    "overall_score", "review_status", "favorite", "provenance", "source_platform", "source_video_id", "source_url",
)
REVIEW_FIELDS = ("clip_id", "review_status", "favorite", "review_note")
# ---- end of fixed values -----------------------------------------------------------

ANSWER = "struct<material:string,process_stage:string,people:boolean,people_count:int,person_role:string,edit_roles:array<string>,scores:map<string,double>>"
_STRINGS = "cast(array() as array<string>)"


def with_schema(raw: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """``raw`` in the columns of a fixed schema; columns that came later than the files get their default."""
    defaults = defaults or {}
    return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def json_block(answer: Column) -> Column:
    """The fenced block of a model's answer, else everything from the first ``{`` to the last ``}``."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(F.trim(fenced), F.lit("")), F.nullif(braced, F.lit("")), F.trim(answer))


def parse_answers(answers: DataFrame, roles: list[str], stages: list[str], column: str = "answer") -> DataFrame:
    """Typed answers, or the reason a row goes to quarantine: ``invalid_json``, ``unknown_stage``, ``unknown_role``, ``bad_count``.

    Stage names that models put among the roles become ``process``; people, count and role are brought into line.
    """
    block = json_block(F.coalesce(F.col(column), F.lit("")))
    rows = answers.withColumn("block", block).withColumn("p", F.from_json("block", ANSWER, {"mode": "PERMISSIVE"}))
    broken = F.try_parse_json(F.concat(F.lit("["), "block", F.lit("]"))).isNull() | ~F.col("block").startswith("{")
    given = F.coalesce("p.edit_roles", F.expr(_STRINGS))
    mended = F.array_distinct(F.transform(given, lambda r: F.when(r.isin(*ROLE_ALIASES), "process").otherwise(r)))
    count = F.coalesce("p.people_count", F.lit(0))
    people = (count > 0) | F.coalesce("p.people", F.lit(False))
    role = F.coalesce("p.person_role", F.lit("none"))
    role = F.when((count > 0) & (role == "none"), "unknown").when(~people & (role == "unknown"), "none").otherwise(role)
    stage = F.coalesce("p.process_stage", F.lit("other"))
    reason = (
        F.when(broken, "invalid_json").when(~stage.isin(*stages), "unknown_stage")
        .when(F.exists(mended, lambda r: ~r.isin(*roles)), "unknown_role").when(count < 0, "bad_count")
    )
    good = lambda c: F.when(reason.isNull(), c)
    keep = [c for c in answers.columns if c != column]
    return rows.select(
        *keep, good(F.col("p.material")).alias("material"), good(stage).alias("process_stage"), good(people).alias("people"), good(F.when(people, count).otherwise(0)).alias("people_count"),
        good(role).alias("person_role"), good(mended).alias("edit_roles"), good(overall(lambda n: F.col("p.scores")[n])).alias("overall"), reason.alias("reason"),
    )


def overall(score) -> Column:
    """Weighted mean of the five scores; a missing one counts 0."""
    return F.bround(sum((F.coalesce(score(n), F.lit(0.0)) * w for n, w in SCORE_WEIGHTS.items()), F.lit(0.0)), 4)


def parsed_list(value: Column, known: list[str] | None = None) -> Column:
    """A JSON list, or else a text split at commas; unknown items are dropped."""
    listed = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>"))
    items = F.coalesce(listed, F.filter(F.split(value, ","), lambda x: x != ""), F.expr(_STRINGS))
    return items if known is None else F.filter(items, lambda x: x.isin(*known))


def tag_rows(tagged: DataFrame) -> DataFrame:
    """``clip_id, name, tag_category``: the tags one tagging stands for."""
    pair = lambda value, kind, when=None: F.when(F.lit(True) if when is None else when, F.struct(value.alias("name"), F.lit(kind).alias("tag_category")))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    single = [pair(F.col(c), c) for c in ("material", "material_form", "material_state", "process_stage", "shot_type", "camera_motion", "subtitle_type")]
    single += [pair(F.col(c), c, filled(c)) for c in ("equipment_type", "scene")]
    single.append(pair(F.col("person_role"), "person_role", F.col("person_role") != "none"))
    single.append(pair(F.lit("people_present"), "people", F.col("people") & (F.col("people_count") > 0)))
    roles = F.transform("edit_roles", lambda r: F.struct(r.alias("name"), F.lit("edit_role").alias("tag_category")))
    every = F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), roles)
    return tagged.select("clip_id", F.explode(every).alias("t")).select("clip_id", "t.name", "t.tag_category")


def insert_clips(rows: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tag dimension with what is new, and the bridge (clip_id, tag_id); repeating it changes nothing.

    ``rows`` are ``tag_rows``, ``tags`` is (tag_id, name, tag_category). New tags are numbered
    after the largest id in order of category and name, by ranges of these.
    """
    key = ["name", "tag_category"]
    fresh = rows.select(*key).distinct().join(tags, key, "left_anti")
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("last"))  # one row
    fresh = tables.numbered(fresh, [F.asc("tag_category"), F.asc("name")], "number", tables.saver(rows.sparkSession, "tags"))
    dimension = tags.select("tag_id", *key).union(fresh.crossJoin(last).select((F.col("last") + F.col("number")).alias("tag_id"), *key))
    return dimension, rows.join(dimension, key).select("clip_id", "tag_id").distinct()


def backfill(clips: DataFrame, runs: DataFrame, provenance: Column) -> DataFrame:
    """``clip_id, field, new, reason``: what fills blank metadata, from the file's folder, the source, and the one prompt version on record."""
    parts = F.split("file_path", "/")
    parent, above = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
    folder = F.when(parent == "clips", above).otherwise(parent)
    found = runs.filter("operation = 'clip_tagging' AND prompt_version <> ''").groupBy("clip_id").agg(F.sort_array(F.collect_set("prompt_version")).alias("versions"))
    one = F.size("versions") == 1
    change = lambda blank, field, new, reason=None: F.when(blank, F.struct(F.lit(field).alias("field"), new.alias("new"), (F.lit("") if reason is None else reason).alias("reason")))
    changes = F.array(
        change((F.col("category") == "") & (F.coalesce(folder, F.lit("")) != ""), "library_category", folder),
        change((F.col("provenance") == ""), "provenance", provenance),
        change((F.col("prompt_version") == "") & F.col("versions").isNotNull(), "tag_prompt_version", F.when(one, F.col("versions")[0]).otherwise(""), F.when(one, "").otherwise(F.concat(F.lit("ambiguous: "), F.array_join("versions", ",")))),
    )
    return clips.join(found, "clip_id", "left").select("clip_id", F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("c")).select("clip_id", "c.field", "c.new", "c.reason")


def manifest(clips: DataFrame, most: int | None = None) -> DataFrame:
    """The export columns in order, then what only the JSON form has; a blank category gets its label, ``most`` caps the rows by id."""
    label = F.when(F.trim(F.coalesce("library_category", F.lit(""))) == "", "(legacy)").otherwise(F.col("library_category"))
    kind = F.when(F.col("derivative_path").isNotNull(), "derivative").otherwise("original")
    shown = [label.alias(c) if c == "library_category" else F.col(c) for c in EXPORT_FIELDS]
    out = clips.select(
        *shown, F.coalesce("derivative_path", "file_path").alias("preferred_path"), kind.alias("preferred_kind"),
        (F.coalesce("review_status", F.lit("")) != "rejected").alias("usable_for_production"),
    )
    return out if most is None else out.orderBy("clip_id").limit(most)


def write_export(rows: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with the export columns, or JSON lines with all."""
    if form == "csv":
        rows.select(*[F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes if c in EXPORT_FIELDS]).write.option("header", True).csv(path)
    else:
        rows.write.json(path)


def demo_removal(clips: DataFrame, with_local: bool = False, small: int = 640, tiny: int = 200 * 1024) -> DataFrame:
    """``clip_id, removable, code, signals``: only clips that are synthetic beyond doubt may go, local tests if asked for.

    ``code`` says by which rule; ``signals`` are the signs of a placeholder of a synthetic clip: a
    picture with no side over ``small`` pixels, a file of at most ``tiny`` bytes.
    """
    side = F.greatest(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)))
    signs = F.array_compact(F.array(F.when((side > 0) & (side <= small), "small_picture"), F.when(F.col("size_bytes") <= tiny, "small_file")))
    kind = F.col("provenance")
    code = F.when(kind == "mock", "synthetic").when(kind == "remote", "real").when(kind == "local_test", "local_asked" if with_local else "local_kept").otherwise("unknown_origin")
    none = F.expr(_STRINGS)
    return clips.select("clip_id", code.isin("synthetic", "local_asked").alias("removable"), code.alias("code"), F.when(kind == "mock", signs).otherwise(none).alias("signals"))


def acceptance(clips: DataFrame, files: DataFrame, probes: DataFrame, root: str, least: float = 3.0, most: float = 15.0) -> DataFrame:
    """One boolean per check of a clip, and ``ok`` where all hold."""
    paths = files.select(F.col("path").alias("file_path"), F.lit(True).alias("file_there")).distinct()
    thumbs = files.select(F.col("path").alias("thumbnail_path"), F.lit(True).alias("thumb_there")).distinct()
    read = probes.select(F.col("path").alias("file_path"), "seconds", "has_video", F.lit(True).alias("read"))
    joined = clips.join(paths, "file_path", "left").join(thumbs, "thumbnail_path", "left").join(read, "file_path", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    there = yes(F.col("file_there"))
    readable = there & yes(F.col("read"))
    checks = {
        "file_exists": there, "inside_library_root": yes(F.col("file_path").startswith(root.rstrip("/") + "/")), "provenance_is_real": yes(F.col("provenance") == "remote"),
        "thumbnail_exists": yes(F.col("thumb_there")), "readable": readable, "duration_in_range": readable & yes(F.col("seconds").between(least, most)),
        "video_stream": readable & yes(F.col("has_video")),
    }
    ok = F.lit(True)
    for c in checks.values():
        ok &= c
    return joined.select("clip_id", *[c.alias(n) for n, c in checks.items()], ok.alias("ok"))


def missing_thumbnails(clips: DataFrame, files: DataFrame) -> DataFrame:
    """Clips whose video is there and whose thumbnail is not."""
    there = files.select(F.col("path").alias("file_path")).distinct()
    thumbs = files.select(F.col("path").alias("thumbnail_path")).distinct()
    return clips.join(there, "file_path", "left_semi").join(thumbs, "thumbnail_path", "left_anti").select("clip_id", "thumbnail_path")


def suffixed(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))


def legacy_failures(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources rejected without any score, the first failed run of each that names a provider's failure, and whether they move."""
    text = F.lower(F.concat_ws(" ", F.coalesce("error_type", F.lit("")), F.coalesce("error_message", F.lit(""))))
    marker = None
    for m in PROVIDER_MARKERS:
        hit = text.contains(m)
        marker = F.when(hit, m) if marker is None else marker.when(hit, m)
    failed = runs.filter("status <> 'ok'").withColumn("marker", marker).filter("marker IS NOT NULL")
    first = failed.groupBy("source_id").agg(F.min(F.struct("run_id", "operation", "marker")).alias("e"))
    own = sources.filter("status = 'rejected_preview' AND material_score IS NULL AND subtitle_score IS NULL AND quality_score IS NULL")
    return own.join(first, "source_id", "left").select("source_id", "e.run_id", "e.operation", "e.marker", F.col("e").isNotNull().alias("migrate"))


def version_compare(tags: DataFrame, a: str, b: str) -> DataFrame:
    """Clips tagged by both prompt versions, side by side, and what differs."""
    columns = ("stage", "shot", "description")
    side = lambda v, s: tags.filter(F.col("version") == v).select("clip_id", *[F.col(c).alias(f"{c}_{s}") for c in columns])
    both = side(a, "a").join(side(b, "b"), "clip_id")
    differ = [F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), c) for c in columns]
    return both.select("clip_id", *[f"{c}_{s}" for c in columns for s in "ab"], F.concat_ws(",", *differ).alias("differs"))


def cleanup_scan(clips: DataFrame, records: DataFrame, eligible: tuple[str, ...] = CLEANUP_CLASSES) -> DataFrame:
    """What a cleanup run would do with each clip: ``clip_id, subtitle_class, measured, eligibility, eligible, reason``."""
    joined = clips.join(records.select("clip_id", "status", "review", "skip_reason", "healthy"), "clip_id", "left")
    measured = F.coalesce("measured_class", F.lit("")) != ""
    kind = F.when(measured, F.col("measured_class")).otherwise(F.col("subtitle_type"))
    status = F.coalesce("status", F.lit(""))
    done, skipped = status == "succeeded", status.isin("not_needed", "ineligible")
    clean, wrong = kind.isin("none", "watermark_only"), ~kind.isin(*eligible)
    failed = status.isin("failed_processing", "failed_quality", "residual_subtitle")
    eligibility = (
        F.when(done, "eligible_processed").when(skipped, status).when(clean, "not_needed").when(wrong, "ineligible").when(failed, "eligible_failed")
        .when(status == "derivative_deleted", "eligible_deleted").otherwise("eligible_unprocessed")
    )
    reason = (
        F.when(done & ~F.coalesce("healthy", F.lit(False)), "missing_derivative").when(done, F.concat(F.lit("existing_succeeded:"), F.coalesce(F.nullif("review", F.lit("")), F.lit("pending"))))
        .when(skipped, F.coalesce(F.nullif("skip_reason", F.lit("")), status)).when(clean, F.concat(F.lit("classification="), kind))
        .when(wrong, F.concat(F.lit("classification_not_eligible:"), kind)).when(status == "derivative_deleted", "derivative_deleted")
        .when(status != "", F.concat(F.lit("existing_"), status)).otherwise("stored_classification")
    )
    return joined.select("clip_id", kind.alias("subtitle_class"), measured.alias("measured"), eligibility.alias("eligibility"), (~(skipped | (~done & (clean | wrong)))).alias("eligible"), reason.alias("reason"))


def cleanup_report(scan: DataFrame, records: DataFrame) -> DataFrame:
    """One row: clips, open candidates, and records by status and review; mean gain and masked area of the successes."""
    done = F.col("status") == "succeeded"
    review = F.coalesce(F.nullif("review", F.lit("")), F.lit("pending"))
    area = F.aggregate("regions", F.lit(0.0), lambda a, r: a + F.greatest(r["x2"] - r["x1"], F.lit(0.0)) * F.greatest(r["y2"] - r["y1"], F.lit(0.0)))
    a = scan.agg(F.count("*").alias("clips"), F.count_if(F.col("eligibility") == "eligible_unprocessed").alias("eligible_unprocessed"))
    counts = {s: F.col("status") == s for s in ("not_needed", "ineligible", "failed_processing", "failed_quality", "residual_subtitle")}
    counts |= {"approved": done & (review == "approved"), "rejected": done & (review == "rejected"), "succeeded_pending_review": done & ~review.isin("approved", "rejected")}
    counts["missing_derivative"] = done & ~F.coalesce("healthy", F.lit(False))
    b = records.agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()], F.bround(F.avg(F.when(done, F.col("after") - F.col("before"))), 4).alias("mean_gain"),
        F.bround(F.avg(F.when(done, F.bround(area, 5))), 4).alias("mean_masked_area"),
    )
    return a.crossJoin(b)  # one row each


def hybrid_verdict(measured: DataFrame, margin: float = 0.15, bottom_area: float = 0.12, center_area: float = 0.08, several: float = 0.4) -> DataFrame:
    """``clip_id, confidence, ask, verdict, decision, cleanliness``: how sure the measurement is, and its merger with a model's opinion.

    Null class: not measured, so the model's class counts. An ambiguous class gives way to the
    model; otherwise the measurement wins. The limits are job parameters.
    """
    kind, other = F.col("subtitle_class"), F.col("model_class")
    gap = lambda room, scale: F.bround(F.least(F.lit(1.0), 0.5 + room / scale), 3)
    sure = (
        F.when(kind.isNull(), 0.0).when(kind == "none", F.when(F.col("most_boxes") == 0, 1.0).otherwise(0.5))
        .when(kind == "bottom_simple", gap(F.greatest(F.lit(0.0), bottom_area - F.col("avg_area")), bottom_area))
        .when(kind == "large_center_text", gap(F.col("center_area") - center_area, center_area))
        .when(kind.isin("multi_region", "colored_block"), gap(F.col("multi") - several, 1 - several)).when(kind == "watermark_only", 0.9).otherwise(0.5)
    )
    opinion = F.coalesce(F.create_map(*[F.lit(x) for p in COMPLEXITY.items() for x in p])[F.col("model_complexity")], F.lit(0.5))
    yields = other.isNotNull() & kind.isin(*AMBIGUOUS)
    verdict = F.when(kind.isNull(), F.coalesce(other, F.lit("unknown"))).when(yields, other).otherwise(kind)
    decision = F.when(kind.isNull(), F.when(other.isNull(), "unavailable").otherwise("model_fallback")).when(other.isNotNull(), "hybrid").otherwise("local")
    clean = F.when(kind.isNull() & other.isNotNull(), opinion).when(yields & F.col("model_complexity").isNotNull(), F.bround((F.col("cleanliness") + opinion) / 2, 3)).otherwise(F.coalesce("cleanliness", F.lit(0.0)))
    ask = kind.isNull() | kind.isin(*AMBIGUOUS) | (sure <= 0.5 + margin)
    return measured.select("clip_id", sure.alias("confidence"), ask.alias("ask"), verdict.alias("verdict"), decision.alias("decision"), clean.alias("cleanliness"))


def evidence_reduction(before: DataFrame, after: DataFrame, masks: DataFrame, least: float = 0.5, confidence: float = 0.3, overlap: float = 0.1, digits: int = 5) -> DataFrame:
    """Per clip: most boxes of a frame and mean area before and after, boxes left inside a mask, and success.

    ``before`` and ``after`` hold boxes (clip_id, frame, x1, y1, x2, y2, confidence); frames without a box are not in them.
    """
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))

    def seen(boxes: DataFrame, name: str) -> DataFrame:
        frames = boxes.groupBy("clip_id", "frame").agg(F.count("*").alias("n"), F.sum(size).alias("a"))
        return frames.groupBy("clip_id").agg(F.max("n").alias(f"{name}_count"), F.bround(F.avg("a"), digits).alias(f"{name}_area"))

    m = masks.select("clip_id", *[F.col(c).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")])
    w = F.greatest(F.lit(0.0), F.least("x2", "m_x2") - F.greatest("x1", "m_x1"))
    h = F.greatest(F.lit(0.0), F.least("y2", "m_y2") - F.greatest("y1", "m_y1"))
    inside = after.filter(F.col("confidence") >= confidence).join(m, "clip_id").filter(F.when(size > 0, F.bround(w * h / size, 4)).otherwise(0.0) >= overlap)
    left = inside.select("clip_id", "frame", "x1", "y1", "x2", "y2").distinct().groupBy("clip_id").agg(F.count("*").alias("residual"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = seen(before, "before").join(seen(after, "after"), "clip_id", "left").join(left, "clip_id", "left")
    fewer = zero("after_count") < F.col("before_count")
    smaller = (F.col("before_area") > 0) & (zero("after_area") <= F.col("before_area") * (1 - least))
    return joined.select(
        "clip_id", "before_count", zero("after_count").alias("after_count"), "before_area", zero("after_area").cast("double").alias("after_area"),
        zero("residual").alias("residual"), (fewer | smaller).alias("reduced"), ((fewer | smaller) & (zero("residual") == 0)).alias("success"),
    )


def moving_text(tracks: DataFrame, persistence: float = 0.55, jitter: float = 0.05, growth: float = 0.75) -> DataFrame:
    """``clip_id, reason``: the first persistent track of a clip that moves or floats on top, if any does."""
    why = (
        F.when(F.col("persistence") < persistence, None).when(F.col("jitter_y") > jitter, F.concat(F.lit("moving_text_vertical_jitter:"), F.format_string("%.3f", "jitter_y")))
        .when((F.col("growth") > growth) & (F.col("median_y1") < 0.5), F.concat(F.lit("floating_top_text_growth:"), F.format_string("%.2f", "growth")))
    )
    return tracks.withColumn("reason", why).filter("reason IS NOT NULL").groupBy("clip_id").agg(F.min(F.struct("track", "reason"))["reason"].alias("reason"))
