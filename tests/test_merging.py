"""Incremental merges against a loop, their repeats, late changes and audit; streams through foreachBatch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cliploom.operators import merging, tables
from cliploom.operators import vocabulary as v

T = datetime(2024, 5, 1)
CHANGE = ", ".join(f"{c} {k}" for c, k in {**merging.SOURCES.keys, **merging.SOURCES.overwrite, **merging.SOURCES.fill}.items()) + ", status string, reject_reason string, touch boolean, changed_at timestamp, seq long"
NAMES = [part.split()[0] for part in CHANGE.split(", ")]


def change(video, minute, status, reason=None, seq=0, **more):
    row = {"platform": "douyin", "platform_video_id": video, "status": status, "reject_reason": reason, "changed_at": T + timedelta(minutes=minute), "seq": seq, "source_url": "", "title": "", "author": "", **more}
    return tuple(row.get(n) for n in NAMES)


def looped(state, changes):
    """The upsert one change at a time; ``state`` maps ids to dicts."""
    stamps = {k: (r["changed_at"], r["seq"]) for k, r in state.items()}
    for row in sorted((dict(zip(NAMES, c)) for c in changes), key=lambda r: (r["changed_at"], r["seq"])):
        key, at = row["platform_video_id"], (row["changed_at"], row["seq"])
        if key in stamps and at <= stamps[key]:
            continue
        old = state.get(key)
        new = dict(old or {})
        new.update({c: row[c] for c in merging.SOURCES.overwrite})
        new.update({c: row[c] for c in merging.SOURCES.fill if row[c] is not None or old is None})
        if not (old and old["status"] in v.SETTLED_STATUSES and row["reject_reason"] in v.BOOKKEEPING_REASONS):
            new["status"], new["reject_reason"] = row["status"], row["reject_reason"]
        new["attempt_count"] = (old["attempt_count"] if old else 0) + bool(row["touch"])
        if row["touch"] or old is None:
            new["last_attempt_at"] = row["changed_at"] if row["touch"] else None
        new["changed_at"], new["seq"] = at
        state[key] = new
    return state


def shown(store):
    return {r.platform_video_id: r for r in store.current().collect()}


def check(store, state):
    got = shown(store)
    assert got.keys() == state.keys()
    for key, want in state.items():
        for c in [*merging.SOURCES.overwrite, *merging.SOURCES.fill, "status", "reject_reason", "attempt_count", "last_attempt_at"]:
            assert got[key][c] == want[c], (key, c)


def fresh_store(spark, what=merging.SOURCES):
    return merging.Store(spark, f"{tables.shared_folder(spark)}/{tables.unique('store')}", what, buckets=4)


@pytest.mark.parametrize("seed", range(2))
def test_batches_against_a_loop(spark, seed):
    rng = random.Random(seed)
    store, state = fresh_store(spark), {}
    reasons = [None, "no_material", "duplicate_video", "already_processed", "duplicate_url"]
    for batch in range(3):
        changes = [
            change(rng.choice(["hot", *map(str, range(12))]), rng.randrange(batch * 60, batch * 100 + 100), rng.choice(v.STATUSES), rng.choice(reasons), seq=i, touch=rng.choice([True, False, None]), title=rng.choice(["", "a", "b"]), task_id=rng.choice([None, 1, 2]), duration=rng.choice([None, 3.5]))
            for i in range(batch * 1000, batch * 1000 + 80)
        ]
        store.apply(spark.createDataFrame(changes, CHANGE), batch)
        check(store, looped(state, changes))


def test_a_repeated_batch_changes_nothing_and_a_late_change_loses(spark):
    store = fresh_store(spark)
    first = spark.createDataFrame([change("1", 10, "processed", title="good", touch=True), change("2", 10, "discovered")], CHANGE)
    store.apply(first, 0)
    second = spark.createDataFrame([change("1", 5, "failed", title="late"), change("2", 20, "failed_download", "unreachable", touch=True), change("3", 1, "rejected", "no_material")], CHANGE)
    store.apply(second, 1)
    once, audit = shown(store), store.audit().collect()
    store.apply(second, 1)
    store.apply(first, 0)
    assert shown(store) == once and sorted(map(str, store.audit().collect())) == sorted(map(str, audit))
    assert (once["1"].status, once["1"].title, once["1"].batch_id, once["1"].attempt_count) == ("processed", "good", 0, 1)
    assert (once["2"].status, once["2"].reject_reason, once["2"].attempt_count, once["2"].batch_id) == ("failed_download", "unreachable", 1, 1)
    assert once["2"].created_at == T + timedelta(minutes=10) and once["2"].updated_at == T + timedelta(minutes=20)
    rows = {(r.platform_video_id, r.field): (r.action, r.old_value, r.new_value) for r in audit if r.batch_id == 1}
    assert rows["2", "status"] == ("update", "discovered", "failed_download") and rows["3", "status"] == ("insert", None, "rejected")
    assert rows["1", ""] == ("late", None, "1") and ("1", "status") not in rows and ("2", "title") not in rows
    with pytest.raises(ValueError):
        store.apply(second, -1)


def test_a_batch_that_broke_off_is_done_again(spark):
    """Rows and audit without the batch's mark are not read, and the next try writes them anew."""
    store = fresh_store(spark)
    store.apply(spark.createDataFrame([change("1", 1, "discovered")], CHANGE), 0)
    second = spark.createDataFrame([change("1", 2, "processed"), change("9", 2, "processed")], CHANGE)
    store.apply(second, 1)
    done = store._path(f"{store.folder}/done/1")
    store._files.delete(done, False)
    assert {k: r.status for k, r in shown(store).items()} == {"1": "discovered"}
    store.apply(second, 1)
    assert {k: r.status for k, r in shown(store).items()} == {"1": "processed", "9": "processed"}
    store.forget()
    assert {k: r.status for k, r in shown(store).items()} == {"1": "processed", "9": "processed"}


def test_settled_verdicts_stay_against_bookkeeping(spark):
    """rejected_preview/no_material meets duplicate_video, then a real verdict, then already_processed."""
    store = fresh_store(spark)
    steps = [("rejected_preview", "no_material"), ("skipped_duplicate", "duplicate_video"), ("analyzed", None), ("skipped_duplicate", "already_processed"), ("discovered", "duplicate_url")]
    for n in range(1, len(steps) + 1):
        one = fresh_store(spark) if n < len(steps) else store
        one.apply(spark.createDataFrame([change("1", i, *steps[i]) for i in range(n)], CHANGE), 0)
        row = shown(one)["1"]
        want = [("rejected_preview", "no_material"), ("rejected_preview", "no_material"), ("analyzed", None), ("skipped_duplicate", "already_processed"), ("skipped_duplicate", "already_processed")][n - 1]
        assert (row.status, row.reject_reason) == want, n


def test_cleanups_by_clip_and_version(spark):
    store = fresh_store(spark, merging.CLEANUPS)
    names = [*merging.CLEANUPS.keys, *merging.CLEANUPS.overwrite, *merging.ORDER]
    schema = ", ".join(f"{c} {k}" for c, k in {**merging.CLEANUPS.keys, **merging.CLEANUPS.overwrite, "changed_at": "timestamp", "seq": "long"}.items())
    row = lambda clip, version, minute, **more: tuple({"clip_id": clip, "version": version, "changed_at": T + timedelta(minutes=minute), "seq": 1, **more}.get(n) for n in names)
    store.apply(spark.createDataFrame([row(1, "v1", 1, status="pending"), row(1, "v1", 3, status="succeeded", output_path="/a"), row(1, "v2", 2, status="failed_quality"), row(None, "v1", 1)], schema), 0)
    store.apply(spark.createDataFrame([row(1, "v1", 2, status="late"), row(1, "v2", 9, status="succeeded")], schema), 1)
    got = {(r.clip_id, r.version): (r.status, r.output_path, r.created_at.minute, r.updated_at.minute) for r in store.current().collect()}
    assert got == {(1, "v1"): ("succeeded", "/a", 1, 3), (1, "v2"): ("succeeded", None, 2, 9)}


def test_for_each_batch_of_a_stream(spark, tmp_path):
    store = fresh_store(spark)
    for i in range(3):
        spark.createDataFrame([change(str(j), i, "processed" if i == 2 else "discovered", seq=i, touch=True) for j in range(5)], CHANGE).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None
    got = shown(store)
    assert len(got) == 5 and all(r.attempt_count >= 1 and r.status == "processed" for r in got.values()) and len(store.batches()) == 3
    assert store.audit().filter("action = 'insert' AND field = 'status'").count() == 5


def test_empty_batches(spark):
    store = fresh_store(spark)
    assert store.current().count() == 0
    store.apply(spark.createDataFrame([], CHANGE), 0)
    assert store.current().count() == 0 and store.batches() == [0] and store.audit().count() == 0
    store.apply(spark.createDataFrame([change("1", 1, "discovered")], CHANGE).withColumn("batch_id", F.lit("theirs")).drop("batch_id"), 4)
    assert len(shown(store)) == 1
