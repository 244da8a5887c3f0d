"""Door configuration, results, catalogue, files and sinks."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.operators import catalog, door_config, results
from trackweave.sources import detectors, files, frames, sinks

BINDINGS = [(1, "r", "1", "FRONT", 1, True, 10), (2, "r", "1", "REAR", 2, False, 5), (3, "r", "2", "NEEDS_CLASSIFICATION", None, True, 7)]


@pytest.fixture(scope="module")
def bindings(spark):
    return spark.createDataFrame(BINDINGS, schemas.BINDINGS)


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([(1, "Front", "D1", "[]", None, None, True), (2, "rear", None, "S2", None, None, False)], schemas.PROFILES)


def test_resolve_falls_back_column_by_column(spark, bindings, profiles):
    clips = spark.createDataFrame([("a", "r", "1"), ("b", "r", "2"), ("c", "x", "9")], "clip string, recorder_id string, camera_code string")
    found = {r.clip: r for r in door_config.resolve(clips, bindings, profiles, {"door": "DD", "salon": "DS"}).collect()}
    assert (found["a"].logical_door, found["a"].profile_name, found["a"].door, found["a"].salon) == ("FRONT", "Front", "D1", "DS")
    assert (found["b"].logical_door, found["b"].door, found["b"].classification_needed, found["b"].source) == ("NEEDS_CLASSIFICATION", "DD", True, "BINDING_DEFAULT")
    assert found["c"].logical_door is None and not found["c"].classification_needed and found["c"].source == "APPLICATION_DEFAULT" and found["a"].source == "DATABASE"


def test_marked_cameras_ignore_their_profile(spark, profiles):
    clips = spark.createDataFrame([("a", "r", "1"), ("b", "r", "2")], "clip string, recorder_id string, camera_code string")
    marked = spark.createDataFrame([(1, "r", "1", "IGNORE", 1, True, 10), (2, "r", "2", "NEEDS_CLASSIFICATION", 1, True, 10)], schemas.BINDINGS)
    found = {r.clip: r for r in door_config.resolve(clips, marked, profiles, {"door": "DD"}).collect()}
    assert all(r.door == "DD" and r.profile_id is None and r.profile_name == "application-default" for r in found.values())
    assert found["a"].ignored and not found["b"].ignored and found["b"].classification_needed


def test_binding_closes_the_old_one(spark, bindings):
    asked = spark.createDataFrame([("r", "1", " custom ", 2, 99)], "recorder_id string, camera_code string, logical_door string, profile_id long, at_ms long")
    found = {r.id: r for r in door_config.bind(bindings, asked).collect()}
    (new,) = [r for i, r in found.items() if i not in (1, 2, 3)]
    assert not found[1].active and found[1].updated_ms == 99 and new.active and new.logical_door == "CUSTOM" and found[2].updated_ms == 5
    bad = spark.createDataFrame([("r", "1", "side", 2, 99)], asked.schema)
    with pytest.raises(Exception, match="unknown logical door"):
        door_config.bind(bindings, bad).collect()
    assert not {r.id: r.active for r in door_config.deactivate(bindings, 3, 100).collect()}[3]
    with pytest.raises(door_config.NoSuchBinding):
        door_config.deactivate(bindings, 77, 100)


def test_assignment_checks_doors_and_profiles(spark, bindings, profiles):
    kind = "recorder_id string, camera_code string, logical_door string, profile_id long, at_ms long"
    samples = spark.createDataFrame([("r", "2", "old", 1), ("r", "2", "new", 5)], "recorder_id string, camera_code string, path string, modified_ms long")
    waiting = door_config.pending_channels(bindings, samples).collect()
    assert [(r.id, r.sample_path, r.preview_available) for r in waiting] == [(3, "new", True)] and door_config.pending_channels(bindings, samples, "other").count() == 0
    wide = bindings.withColumns({"confirmed_by": F.lit(None).cast("string"), "confirmed_ms": F.lit(None).cast("long"), "preview_path": F.lit("before"), "preview_frame": F.lit(4), "created_ms": F.lit(1).cast("long")})
    asked = spark.createDataFrame([("r", "2", " rear ", 2, 50), ("q", "9", "IGNORE", 77, 50)], kind)
    found = {(r.recorder_id, r.camera_code): r for r in door_config.assign(wide, asked, samples, profiles).where("active").collect()}
    assert (found["r", "2"].logical_door, found["r", "2"].profile_id, found["r", "2"].preview_path, found["r", "2"].preview_frame, found["r", "2"].created_ms) == ("REAR", 2, "new", 4, 50)
    assert (found["q", "9"].logical_door, found["q", "9"].profile_id, found["q", "9"].preview_frame) == ("IGNORE", None, 0)
    for row, message in ((("r", "2", "NEEDS_CLASSIFICATION", None, 5), "must be one of"), (("r", "2", "REAR", 77, 5), "profile not found"), ((" ", "2", "REAR", 1, 5), "must not be blank")):
        with pytest.raises(Exception, match=message):
            door_config.assign(wide, spark.createDataFrame([row], kind), samples, profiles).collect()


def test_previews_register_new_cameras(spark, bindings):
    seen = spark.createDataFrame([("r", "1", 50), ("r", "7", 60)], "recorder_id string, camera_code string, at_ms long")
    found = {r.id: r for r in door_config.register_previews(bindings, seen).collect()}
    (new,) = [r for i, r in found.items() if i not in (1, 2, 3)]
    assert found[1].updated_ms == 50 and new.camera_code == "7" and new.logical_door == "NEEDS_CLASSIFICATION" and found[2].updated_ms == 5


def test_profiles_have_unique_names(profiles):
    with pytest.raises(door_config.NameTaken):
        door_config.put_profile(profiles, {"name": "FRONT"})
    added = door_config.put_profile(profiles, {"name": "Side", "door": "X"})
    assert {r.id: r.name for r in added.collect()} == {1: "Front", 2: "rear", 3: "Side"}
    assert {r.name for r in door_config.put_profile(profiles, {"name": "front"}, 1).collect()} == {"front", "rear"}
    with pytest.raises(door_config.NoSuchProfile):
        door_config.drop_profile(profiles, 8)
    assert door_config.drop_profile(profiles, 1).count() == 1


def test_omitted_filters_are_not_in_the_plan(spark):
    rows = spark.createDataFrame([("a", "FINISHED", "d", 1, None, None, 5, 0, 1, 3, 0, None, None), ("b", "FAILED", "d", None, "E", 2, 9, 0, 4, None, 0, None, None)], schemas.RESULTS)
    assert results.search(rows, device=" ").count() == 2 and results.search(rows, status="FAILED", from_ms=2, to_ms=2).count() == 1
    found = {r.session_id: r for r in results.response(rows).collect()}
    assert (found["a"].camera_code, found["a"].exited, found["b"].camera_code, found["b"].exited) == ("1", 3, "E", 4)
    assert [r.session_id for r in results.page(rows, 0, 1).collect()] == ["b"] and [r.session_id for r in results.page(rows, 1, 1).collect()] == ["a"]


def test_results_are_upserted_and_failures_are_not_raised(spark, tmp_path):
    kind = "session_id string, status string, finished_ms long"
    path = str(tmp_path / "results")
    assert sinks.save_results(spark.createDataFrame([("a", "RUNNING", 1), ("b", "FINISHED", 1)], kind), path)
    assert sinks.save_results(spark.createDataFrame([("a", "FAILED", 3), ("a", "FINISHED", 4)], kind), path)
    assert {(r.session_id, r.status) for r in sinks.load_results(spark, path).collect()} == {("a", "FINISHED"), ("b", "FINISHED")}
    assert not sinks.save_results(spark.createDataFrame([("a",)], "other string"), path)
    assert not sinks.save_results(spark.createDataFrame([("a", "x", 9)], kind), path, enabled=False)


def test_a_write_killed_midway_is_replayed_once(spark, tmp_path, monkeypatch):
    from trackweave.sources.table_log import TableLog

    kind = "session_id string, status string, finished_ms long"
    path = str(tmp_path / "results")
    rows = lambda: {(r.session_id, r.status, r.finished_ms) for r in sinks.load_results(spark, path).collect()}
    write = sinks.batch_upsert(path, name="q")
    write(spark.createDataFrame([("a", "RUNNING", 1), ("b", "FINISHED", 1)], kind), 0)
    before = rows()

    def die(*_):
        raise RuntimeError("killed")

    batch = spark.createDataFrame([("a", "FINISHED", 4), ("c", "FINISHED", 2)], kind)
    with monkeypatch.context() as m:
        m.setattr(TableLog, "_swap", die)
        with pytest.raises(RuntimeError, match="killed"):
            write(batch, 1)  # the stream stops, and does not go on without the batch
    assert rows() == before
    write(batch, 1)
    after = rows()
    assert after == {("a", "FINISHED", 4), ("b", "FINISHED", 1), ("c", "FINISHED", 2)}
    write(spark.createDataFrame([("a", "OTHER", 9)], kind), 1)  # the same batch again: nothing happens
    assert rows() == after and TableLog(spark, path).version()[0] == 2
    assert TableLog(spark, path).vacuum() >= 1 and rows() == after
    with pytest.raises(ValueError, match="other columns"):
        write(spark.createDataFrame([("a",)], "other string"), 2)


def test_writers_that_meet_begin_again(spark, tmp_path, monkeypatch):
    from trackweave.sources import table_log

    kind = "session_id string, n long, finished_ms long"
    one, two = (table_log.TableLog(spark, str(tmp_path / "t"), 4) for _ in range(2))
    one.upsert(spark.createDataFrame([(f"k{i}", 0, 0) for i in range(20)], kind), "session_id", "finished_ms")
    swap, met = table_log.TableLog._swap, []

    def first_another(self, version, state):
        if not met:
            met.append(version)
            two.upsert(spark.createDataFrame([("k3", 7, 7), ("new", 7, 7)], kind), "session_id", "finished_ms")
        return swap(self, version, state)

    with monkeypatch.context() as m:
        m.setattr(table_log.TableLog, "_swap", first_another)
        assert one.upsert(spark.createDataFrame([("k3", 5, 5), ("k4", 5, 5)], kind), "session_id", "finished_ms") == 3
    found = {r.session_id: r.n for r in one.load().collect()}
    assert len(found) == 21 and (found["k3"], found["k4"], found["new"], found["k5"]) == (5, 5, 7, 0)  # k3 of the version that came between is replaced, not lost with it
    with monkeypatch.context() as m:
        m.setattr(table_log.TableLog, "_swap", lambda *_: False)
        with pytest.raises(table_log.Conflict):
            one.upsert(spark.createDataFrame([("k1", 1, 1)], kind), "session_id", "finished_ms")
    assert {r.session_id: r.n for r in one.load().collect()} == found


def test_a_stream_of_results_survives_a_failed_batch(spark, tmp_path):
    kind = "session_id string, status string, finished_ms long"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"session_id": "a", "status": "FINISHED", "finished_ms": 1}')
    path, failures = str(tmp_path / "results"), [1]
    write = sinks.batch_upsert(path)

    def sometimes(batch, number):
        write(batch, number)
        if failures:
            failures.pop()
            raise RuntimeError("lost after the write")

    def run():
        stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(sometimes).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost after the write"):
        run()
    run()
    from trackweave.sources.table_log import TableLog

    assert TableLog(spark, path).version()[0] == 1 and [r.session_id for r in sinks.load_results(spark, path).collect()] == ["a"]


def test_messages_go_out_from_the_executors_in_order(spark, tmp_path):
    from trackweave.sources import push

    folder = str(tmp_path)

    def open_channel(session):
        if session == "nobody":
            return None

        class File:
            def __init__(self):
                self.file = open(f"{folder}/{session}.txt", "a")  # noqa: SIM115
                self.file.write("open\n")

            def __call__(self, payload):
                if payload == "bad":
                    raise OSError("gone")
                self.file.write(f"{payload}\n")

            def close(self):
                self.file.close()

        return File()

    rows = [(f"s{s}", k, f"m{k}") for s in range(5) for k in range(60)] + [("nobody", 1, "m"), ("s1", 61, "bad"), ("s1", 62, "m62")]
    frame = spark.createDataFrame(rows, "session_id string, frame_index int, payload string").repartition(7)
    push.push_batches(open_channel)(frame, 0)
    for s in range(5):
        assert (tmp_path / f"s{s}.txt").read_text().split() == ["open", *(f"m{k}" for k in range(60)), *(["m62"] if s == 1 else [])]
    assert not (tmp_path / "nobody.txt").exists()
    frame.coalesce(1).write.json(f"{folder}/in")
    push.register(spark)
    stream = spark.readStream.schema(frame.schema).json(f"{folder}/in").where("session_id = 's2'")
    query = stream.writeStream.format("session_push").options(**push.options(open_channel)).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    assert sorted((tmp_path / "s2.txt").read_text().split()) == sorted(["open", *(f"m{k}" for k in range(60))] * 2)


def test_files_are_archived_under_home_only(tmp_path):
    home = tmp_path / "home"
    clip = home / "12" / "a.mp4"
    clip.parent.mkdir(parents=True)
    clip.write_bytes(b"x")
    done = tmp_path / "processed"
    assert sinks.after_analysis(str(clip), "FINISHED", str(home), str(done)) == str(done / "finished" / "a.mp4")
    other = tmp_path / "b.mp4"
    other.write_bytes(b"x")
    assert sinks.after_analysis(str(other), "FINISHED", str(home), str(done)) is None and other.exists()
    clip.write_bytes(b"y")
    assert sinks.park_unclassified(str(clip), str(home), str(done)) == str(done / "needs-classification" / "a.mp4")
    clip.write_bytes(b"z")
    sinks.after_analysis(str(clip), "FINISHED", str(home), str(done), keep=False)
    assert not clip.exists()
    sinks.replace_atomically(b"new", str(home / "preview" / "1.jpg"))
    assert (home / "preview" / "1.jpg").read_bytes() == b"new"


def test_files_are_archived_where_only_spark_reads(spark, tmp_path):
    home, done, far = (tmp_path / name for name in ("home", "done", "far"))
    for folder in (home / "1", far):
        folder.mkdir(parents=True)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.clips.link./data", f"file://{tmp_path}")
    at = "viewfs://clips/data"
    archive = lambda path, status="FINISHED", to=f"{at}/done", **more: sinks.after_analysis(path, status, f"{at}/home", to, spark=spark, **more)
    clip = home / "1" / "a.mp4"
    for content in (b"one", b"two"):  # the second replaces what was archived under its name
        clip.write_bytes(content)
        assert archive(f"{at}/home/1/a.mp4") == f"{at}/done/finished/a.mp4"
        assert not clip.exists() and (done / "finished" / "a.mp4").read_bytes() == content
    clip.write_bytes(b"three")
    assert sinks.park_unclassified(f"{at}/home/1/a.mp4", f"{at}/home", f"file://{far}", spark=spark) == f"file:{far}/needs-classification/a.mp4"
    assert not clip.exists() and (far / "needs-classification" / "a.mp4").read_bytes() == b"three"
    outside = tmp_path / "homes.mp4"
    outside.write_bytes(b"x")
    assert archive(f"{at}/homes.mp4") is None and archive(f"{at}/home/../homes.mp4") is None and archive(f"{at}/home/none.mp4") is None and archive(f"{at}/home/1") is None
    assert outside.exists() and (home / "1").is_dir()
    clip.write_bytes(b"four")
    assert archive(f"{at}/home/1/a.mp4", to=f"{at}/home", status="1") == f"{at}/home/1/a.mp4" and clip.read_bytes() == b"four"
    assert archive(f"{at}/home/1/a.mp4", keep=False) is None and not clip.exists()


def test_catalogue_and_content(spark, tmp_path):
    for name in ("videos/12/2024-05-01/3_E.mp4", "processed/12/2024-05-01/3_E.mp4", "videos/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name.split("/")[-1])
    listed = files.listing(spark, str(tmp_path))
    roots = spark.createDataFrame([(f"{tmp_path}/videos", "VIDEOS", 2), (f"{tmp_path}/processed", "FTP_PROCESSED", 1)], "root string, kind string, priority int")
    found = {r.location: r for r in catalog.videos(listed, roots).collect()}
    assert set(found) == {"MANUAL", "FTP_PROCESSED"} and found["MANUAL"].video_device_id == "12" and found["MANUAL"].can_analyse and found["MANUAL"].issue is None
    assert catalog.videos(listed, roots, depth=2).count() == 0
    assert catalog.sample_videos(listed, str(tmp_path), "12", "3", 4).count() == 2 and catalog.sample_videos(listed, str(tmp_path), "12", "3", 3).count() == 0
    hashed = catalog.content_hash(files.listing(spark, str(tmp_path), with_content=True)).select("path", "sha256")
    none = spark.createDataFrame([], "file_sha256 string")
    assert catalog.unprocessed(hashed, none).count() == 2
    assert catalog.unprocessed(hashed, hashed.select(F.col("sha256").alias("file_sha256")).limit(3)).count() <= 1


def test_frames_come_with_the_stride_applied(spark, tmp_path):
    clip = tmp_path / "s1"
    clip.mkdir()
    (clip / "clip.json").write_text('{"fps": 0, "width": 2, "height": 1}')
    for k in range(7):
        (clip / f"{k:06d}.rgb").write_bytes(bytes([k] * 6))
    frames.register(spark)
    rows = spark.read.format("clips").option("skip", 2).load(str(tmp_path))
    assert sorted((r.session_id, r.frame_index, r.fps) for r in rows.collect()) == [("s1", 0, 25.0), ("s1", 3, 25.0), ("s1", 6, 25.0)]

    def load():
        return lambda pdf: pdf[["session_id", "frame_index"]].assign(det_seq=0, x1=0.0, y1=0.0, x2=1.0, y2=1.0, confidence=0.5)

    detectors.register_detector("stub", load)
    assert detectors.detect(rows, "stub").count() == 3
    calls = detectors.embed(rows, lambda: lambda images: [[float(i[0])] for i in images])
    assert sorted(r.embedding[0] for r in calls.collect()) == [0.0, 3.0, 6.0]


def test_filters_reach_the_clips(spark, tmp_path):
    """Frames that a filter leaves out aren't opened: they are unreadable here, so that opening one would fail."""
    for session in ("s1", "s2", "s3"):
        clip = tmp_path / session
        clip.mkdir()
        (clip / "clip.json").write_text('{"fps": 12.5, "width": 1, "height": 1}')
        for k in range(25):
            (clip / f"{k:06d}.rgb").write_bytes(b"abc") if session == "s2" and 10 <= k < 13 else (clip / f"{k:06d}.rgb").mkdir()
    frames.register(spark)
    clips = spark.read.format("clips").option("frames", 4).load(str(tmp_path))
    read = lambda df: sorted((r.session_id, r.frame_index) for r in df.collect())
    assert read(clips.where("session_id = 's2' and frame_index = 11")) == [("s2", 11)]
    assert read(clips.where("session_id in ('s2', 'x') and frame_index >= 10 and frame_index < 13")) == [("s2", k) for k in (10, 11, 12)]
    assert read(clips.where("session_id = 's2' and frame_index > 9 and frame_index <= 12 and frame_index % 2 = 0")) == [("s2", 10), ("s2", 12)]
    assert read(clips.where("session_id = 'nobody'")) == [] and read(clips.where("session_id = 's2' and frame_index = 99")) == []
    with pytest.raises(Exception, match="Is a directory|IsADirectory"):
        clips.where("frame_index = 3").collect()
    heads = spark.read.format("clips").option("headers", True).load(str(tmp_path))
    assert sorted(tuple(r) for r in heads.collect()) == [(s, 12.5, 1, 1, 25) for s in ("s1", "s2", "s3")]
    reader = frames.ClipReader({"path": str(tmp_path), "frames": "4"})
    assert len(reader.partitions()) == 3 * 7  # one clip is many tasks


def test_deepest_root(spark):
    paths = spark.createDataFrame([("/a/b/c.mp4",), ("/a/bc/d.mp4",), ("/z.mp4",)], "path string")
    roots = spark.createDataFrame([("/a", "A", 1), ("/a/b", "B", 2), ("/a/b", "B2", 1)], "root string, kind string, priority int")
    assert {r.path: r.kind for r in catalog.deepest_root(paths, roots).collect()} == {"/a/b/c.mp4": "B2", "/a/bc/d.mp4": "A", "/z.mp4": None}


def test_previews_and_roots_never_gather_files(spark, tmp_path):
    """A table of files is neither broadcast, however small it is estimated, nor shuffled by the few prefixes that are roots."""
    spark.range(3000).selectExpr("concat(if(id % 3 = 0, '/a/', '/b/'), id, '.mp4') as path", "id as size").write.parquet(str(tmp_path / "files"))
    listed = spark.read.parquet(str(tmp_path / "files"))
    roots = spark.createDataFrame([("/a", "VIDEOS", 1), ("/a", "FTP_INCOMING", None), ("/b/c", "VIDEOS", 1), ("/", "VIDEOS", 0)], "root string, kind string, priority int")
    answers = catalog.preview_answers(listed.select("path"), listed, roots)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_prefix" in plan and "hashpartitioning(_prefix" not in plan
    assert {r.status: r["count"] for r in answers.groupBy("status").count().collect()} == {422: 1, 200: 999, 400: 2000}
    rooted = catalog.deepest_root(listed, roots)
    plan = rooted._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(path" not in plan and "hashpartitioning(_prefix" not in plan
    odd = spark.createDataFrame([("/",), ("/b/c",), ("\\\\a/x.mp4",), ("",), (None,), ("/a//y.mp4",)], "path string")
    assert {r.path: r.root for r in catalog.deepest_root(odd, roots).collect()} == {"/": "/", "/b/c": "/b/c", "\\\\a/x.mp4": None, "": None, None: None, "/a//y.mp4": "/a"}
    assert catalog.deepest_root(odd, roots.limit(0)).where("root is null").count() == 6


def test_the_catalogue_is_sorted_before_it_is_told(spark):
    """What is told of a file isn't shuffled or computed for the sample of the ranges; depth counts folders below the root, whatever the separators."""
    roots = spark.createDataFrame([("/d", "VIDEOS", 0), ("/d/in", "FTP_PROCESSED", 1)], "root string, kind string, priority int")
    paths = ["/d/a/b.mp4", "/d/in/finished/x.mp4", "/d/a/b/c.mp4", "/d\\a\\b.mp4", "/d//a.mp4", "/e/a.mp4", "/d/a.txt", None, "/d/in/a/b/c.mp4"]
    listed = spark.createDataFrame([(p, k % 2, 1000 * (k % 3)) for k, p in enumerate(paths)], "path string, size long, modified_ms long")
    told = catalog.videos(listed.repartition(3), roots, depth=2)
    rows = [(r.path, r.below_root, r.location, r.modified_ms) for r in told.collect()]
    assert rows == [("/d//a.mp4", "a.mp4", "MANUAL", 1000), ("/d/in/finished/x.mp4", "finished/x.mp4", "FTP_FINISHED", 1000), ("/d/a/b.mp4", "a/b.mp4", "MANUAL", 0), ("/d\\a\\b.mp4", "a/b.mp4", "MANUAL", 0)]
    before = told._jdf.queryExecution().executedPlan().toString().split("rangepartitioning")[-1]
    assert "below_root" not in before and "record_date" not in before and "date_format" not in before


def test_clips_without_a_key_are_spread(spark):
    """Clips whose names tell no path, device or uid match nothing and don't meet in one task."""
    clips = spark.range(4000).selectExpr("concat('h', id) as sha256", "if(id < 1000, concat('p', id), null) as relative_path", "if(id < 2000, 'd', null) as video_device_id", "if(id < 2000, id, null) as file_uid")
    kinds = "file_sha256 string, original_path string, video_device_id string, file_uid long, status string"
    results = spark.createDataFrame([("h1", None, None, None, "FINISHED"), (None, "p2", None, None, "FINISHED"), (None, None, "d", 3, "FINISHED"), (None, None, "e", 4, "FINISHED"), ("h5", "p5", "d", 5, "FAILED"), (None,) * 4 + ("FINISHED",)], kinds)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = catalog.unanalysed(clips, results).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(int(r.sha256[1:]) for r in rows) == [k for k in range(4000) if k not in (1, 2, 3)]
    assert max(Counter(r.task for r in rows).values()) < 1000


def test_landing_clips_come_once(spark, tmp_path):
    from trackweave.streaming import sessions

    root = tmp_path / "landing"
    for k, name in enumerate(("12/2024-05-01/a.mp4", "12/2024-05-01/b.mp4", "12/2024-05-01/processed/c.mp4", "x/2024-05-01/d.mp4", "12/2024-05-01/e.txt", "13/2024-05-02/f.avi")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("same" if k < 2 else name)
    done = spark.createDataFrame([], "file_sha256 string")
    rows = sessions.first_seen(files.landing_stream(spark, str(root)), done).select("path", "sha256")
    run = rows.writeStream.format("memory").queryName("landed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(120)
    finally:
        run.stop()
    names = sorted(r.path.rsplit("/", 1)[1] for r in spark.table("landed").collect())
    assert len(names) == 2 and names[0] in ("a.mp4", "b.mp4") and names[1] == "f.avi"


def test_clips_past_the_watermark_are_late(spark, tmp_path):
    """A clip whose time lies further back than the delay behind the latest one seen is dropped; within it, content that was seen comes once."""
    from trackweave.streaming import sessions

    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("a", 10)], [("b", 11), ("a", 10)], [("late", 2), ("c", 10.5)])):
        lines = [f'{{"sha256": "{name}", "modificationTime": "2024-05-{int(day):02d}T{int(day % 1 * 24):02d}:00:00Z"}}' for name, day in rows]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k * 60,) * 2)
    stream = spark.readStream.schema("sha256 string, modificationTime timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    done = spark.createDataFrame([("x",)], "file_sha256 string")
    run = sessions.first_seen(stream, done, "1 day").writeStream.format("memory").queryName("timely").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(120)
    finally:
        run.stop()
    assert sorted(r.sha256 for r in spark.table("timely").collect()) == ["a", "b", "c"]


def test_sessions_are_started_stopped_and_finished(spark):
    from trackweave.config import CountConfig, DetectorConfig, StopConfig, TrackConfig
    from trackweave.operators import messages
    from trackweave.plans import sessions

    none = spark.createDataFrame([], sessions.SESSIONS)
    asked = spark.createDataFrame([("a", "v1", 1), ("b", "v2", 2), ("c", "v3", 3)], "session_id string, video_path string, at_ms long")
    rows = sessions.ask_stop(sessions.start(none, asked), "b")
    assert sessions.start(rows, asked).count() == 3
    ends = spark.createDataFrame([("a", "SMART_STOP", 9, "DOOR_CLOSED", None), ("b", "END_OF_FILE", 9, None, None), ("x", "ERROR", 9, None, "?")], "session_id string, ended_by string, at_ms long, finish_reason string, error_message string")
    rows = sessions.finish(rows, ends)
    assert {r.session_id: r.status for r in rows.collect()} == {"a": "FINISHED", "b": "STOPPED", "c": "RUNNING"}
    assert sessions.state(rows, "a").first().finish_reason == "DOOR_CLOSED"
    with pytest.raises(sessions.NoSuchSession):
        sessions.state(rows, "zz")
    last = {r.session_id: r.payload for r in messages.final_messages(rows).collect()}
    assert '"status":"FINISHED"' in last["a"]
    assert sessions.info(spark, TrackConfig(), CountConfig(), DetectorConfig(), StopConfig()).first().process_every_n_frames == 3


def test_the_processor_is_the_fallback():
    assert detectors.providers("cuda", ["CUDAExecutionProvider", "CPUExecutionProvider"]) == ["CUDAExecutionProvider", "CPUExecutionProvider"]
    assert detectors.providers("cuda", []) == ["CPUExecutionProvider"] and detectors.providers("cpu", ["CUDAExecutionProvider"]) == ["CPUExecutionProvider"]
