"""Statuses and reasons of stored sources, and the sets that rules test them against."""

# ---- fixed values ----
STATUSES = (
    "discovered", "metadata_checked", "previewing", "rejected_preview", "qualified", "downloading", "analyzing", "candidate", "rejected", "downloaded",
    "analyzed", "no_usable_segment", "processed", "failed", "failed_search", "failed_preview", "failed_download", "failed_ai", "failed_media", "skipped_duplicate",
)
COMPLETED = ("processed", "skipped_duplicate")
#: Work has been spent on the source.
HANDLED = ("processed", "analyzed", "no_usable_segment", "skipped_duplicate")
REJECTED = ("rejected", "rejected_preview")
FAILED = ("failed", "failed_search", "failed_preview", "failed_download", "failed_ai", "failed_media")
IN_PROGRESS = ("previewing", "downloading", "analyzing", "qualified")
SETTLED_STATUSES = ("processed", "skipped_duplicate", "rejected", "rejected_preview", "no_usable_segment", *FAILED)
BOOKKEEPING_REASONS = ("duplicate_video", "duplicate_url", "duplicate_clip", "already_processed")
DURATION_UNRESOLVED = "duration_unknown_unresolved"
SUBTITLE_REASONS = ("multi_region_subtitle", "colored_text_block", "large_center_text", "subtitle_too_complex", "too_many_stickers")
#: Hours before a source of each kind is tried again.
UNRESOLVED_HOURS, FAILED_HOURS, STALE_HOURS, REJECTED_DAYS = 6.0, 24.0, 6.0, 30.0
OFF_TOPIC = ("开箱", "手机支架", "汽车内饰", "游戏", "明星", "综艺", "招聘")
ADAPTER_KINDS = {"mock": "mock", "local": "local_test", "douyin": "douyin_real"}
LONG_ID = "^[0-9]{12,}$"
#: Classes of measured text that reject whatever the score, and the reason that a class is rejected for.
HARD_CLASSES = ("large_center_text", "multi_region", "colored_block", "promotional_overlay", "dense_text", "complex")
CLASS_REASONS = {
    "large_center_text": "large_center_text", "multi_region": "multi_region_subtitle", "colored_block": "colored_text_block", "promotional_overlay": "colored_text_block",
    "dense_text": "multi_region_subtitle", "complex": "subtitle_too_complex", "single_region": "subtitle_too_complex",
}
#: Highest subtitle score, and complexities that pass without a measurement, of each policy.
SCORE_LIMITS = {"strict": 0.35, "balanced": 0.5, "loose": 0.7, "off": 1.0}
COMPLEXITIES = {"strict": ("low",), "balanced": ("low", "medium"), "loose": ("low", "medium"), "off": ("low", "medium", "high", "unknown")}
#: Outcomes of a probe without a length: reason and status.
PROBE_STATES = {"invalid_media_source": ("invalid_media_source", "failed_media"), "media_unreachable": ("unreachable", "failed_media"), "duration_unknown_unresolved": (DURATION_UNRESOLVED, "failed_media")}
OTHER_PROBE = (DURATION_UNRESOLVED, "rejected")
# ---- end of fixed values ----
