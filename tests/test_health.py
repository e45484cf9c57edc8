"""A real folder listed, paths made plain, problems and orphans by hand."""

from cliploom.operators import health, tables
from cliploom.operators.health import F


def test_paths_are_made_plain(spark):
    cases = [("file:/a/b.mp4", "/a/b.mp4"), ("file:///a//b/./c.mp4", "/a/b/c.mp4"), ("/a/b/../../c", "/c"), ("/../x", "/x"), ("a/./b", "a/b"), ("hdfs://n:9/a", "/a"), (" ", None), (None, None), ("/a b/ü", "/a b/ü")]
    rows = spark.createDataFrame(cases, "path string, want string")
    assert [r.got for r in rows.select(health.canonical(F.col("path")).alias("got")).collect()] == [w for _, w in cases]


def test_a_written_folder(spark, tmp_path):
    """Outside the root, missing, derivative outputs and orphans told apart on files that are there."""
    root = tmp_path / "lib"
    names = ["1.mp4", "c1/2.MP4", "c1/d/3.mov", "c2/orphan.m4v", "clean/4.mp4", "t/1.jpg", "t/lost.png", "note.txt"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"xyz")
    (tmp_path / "outside.mp4").write_bytes(b"x")
    save = tables.saver(spark)
    files = health.listing(spark, str(root), save, folders=2).cache()
    assert sorted((r.path.removeprefix(f"{root}/"), r.bytes) for r in files.collect()) == sorted((n, 3) for n in names if n != "note.txt")
    clips = [(1, f"{root}/1.mp4", f"{root}/t/1.jpg"), (2, f"file:{root}//c1/./2.MP4", None), (3, f"{root}/x/../c1/d/3.mov", f"{root}/t/none.jpg"), (5, f"{root}/gone.mp4", ""), (6, f"{tmp_path}/outside.mp4", f"{tmp_path}/t.jpg"), (7, None, None)]
    clips = spark.createDataFrame(clips, "clip_id long, file_path string, thumbnail_path string")
    cleanups = spark.createDataFrame([(1, f"{root}/clean/4.mp4"), (2, f"{root}/clean/9.mp4"), (3, None)], "clip_id long, output_path string")
    found = {(r.kind, r.clip_id): r.reason for r in health.problems(clips, cleanups, files, str(root)).collect()}
    assert found == {("thumbnail", 3): "missing_file", ("video", 5): "missing_file", ("video", 6): "outside_root", ("thumbnail", 6): "outside_root", ("video", 7): "outside_root", ("cleanup", 2): "missing_file"}
    assert sorted((r.path.removeprefix(f"{root}/"), r.kind) for r in health.orphans(clips, cleanups, files, str(root)).collect()) == [("c2/orphan.m4v", "media"), ("t/lost.png", "thumbnail")]
    (tmp_path / "empty").mkdir()
    assert health.listing(spark, str(tmp_path / "empty"), save).count() == 0
