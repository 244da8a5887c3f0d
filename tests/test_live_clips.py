"""Clips that are read while they are recorded, and landed files that are moved away once they were read."""

import json
import time

import pytest

from trackweave.sources import files, frames


def land(root, session, numbers, size=3):
    clip = root / session
    clip.mkdir(parents=True, exist_ok=True)
    (clip / "clip.json").write_text('{"fps": 10, "width": 1, "height": 1}')
    for k in numbers:
        (clip / f"{k:06d}.rgb").write_bytes(bytes([k % 256] * size))


def ends(spark, rows):
    return spark.createDataFrame(rows, "session_id string, frame_index int")


def test_offsets(spark, tmp_path):
    root, control = tmp_path / "clips", tmp_path / "control"
    options = {"path": str(root), "control": str(control), "per_trigger": "4", "frames": "3"}
    land(root, "s1", range(6))
    (root / "no header").mkdir()
    reader = frames.LiveClipReader(options)
    assert reader.initialOffset() == {} and reader.latestOffset() == {"s1": 4} and reader.latestOffset() == {"s1": 6} == reader.latestOffset()
    assert [(p.first, p.last) for p in reader.partitions({}, {"s1": 4})] == [(0, 2), (3, 3)] and not list(reader.partitions({"s1": 6}, {"s1": 6}))
    land(root, "s1", [6], size=2)  # still being written
    land(root, "s1", [7, 9])  # 8 is missing for good
    assert reader.latestOffset() == {"s1": 6}
    land(root, "s1", [6])
    assert reader.latestOffset() == {"s1": 10}
    reader.commit({"s1": 10})
    land(root, "s1", range(10, 30))
    land(root, "s2", [])
    again = frames.LiveClipReader(options)
    assert again.latestOffset() == {"s1": 14, "s2": 0}  # from what was read, at the same pace
    frames.acknowledge(ends(spark, [("s1", 20), ("s1", 16), (None, 3), ("s2", None)]), str(control))
    frames.acknowledge(ends(spark, [("s1", 2)]), str(control))
    assert again.latestOffset() == {"s1": 17, "s2": 0} == again.latestOffset()
    assert json.loads((control / "s1.end.json").read_text()) == {"frame_index": 16} and not (control / "s2.end.json").exists()


def test_an_end_before_what_was_read_changes_nothing(spark, tmp_path):
    root, control = tmp_path / "clips", tmp_path / "control"
    land(root, "s1", range(20))
    reader = frames.LiveClipReader({"path": str(root), "control": str(control), "per_trigger": "8"})
    assert reader.latestOffset() == {"s1": 8}
    frames.acknowledge(ends(spark, [("s1", 3)]), str(control))
    assert reader.latestOffset() == {"s1": 8}


def test_a_stream_stops_reading_at_the_stop_frame(spark, tmp_path):
    """Each batch says where a clip may end; no later frame of it is read, while the others go on, also after a restart."""
    root, control, out = tmp_path / "clips", str(tmp_path / "control"), str(tmp_path / "out")
    land(root, "s1", range(60))
    land(root, "s2", range(10))
    frames.register(spark)

    def seen(batch, number):
        batch.select("session_id", "frame_index", "image").write.mode("overwrite").parquet(f"{out}/{number:03d}")
        frames.acknowledge(spark.read.parquet(f"{out}/{number:03d}").where("session_id = 's1' and frame_index = 9").select("session_id", "frame_index"), control)

    def run():
        clips = spark.readStream.format("clips").option("control", control).option("per_trigger", 4).option("frames", 2).option("skip", 0).load(str(root))
        query = clips.writeStream.foreachBatch(seen).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        rows = spark.read.option("recursiveFileLookup", True).parquet(out).collect()
        assert all(bytes(r.image) == bytes([r.frame_index] * 3) for r in rows)
        return sorted((r.session_id, r.frame_index) for r in rows)

    assert run() == [("s1", k) for k in range(12)] + [("s2", k) for k in range(10)]  # 9 came with the frames 8 to 11
    land(root, "s1", range(60, 70))
    land(root, "s2", range(10, 17))
    land(root, "s3", range(2))
    assert run() == [("s1", k) for k in range(12)] + [("s2", k) for k in range(17)] + [("s3", 0), ("s3", 1)]


def test_landed_files_are_archived(spark, tmp_path):
    root, archive = tmp_path / "landing", tmp_path / "archive"
    names = ["12/2024-05-01/a.mp4", "12/2024-05-01/b.mp4"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    archive.mkdir()
    query = files.landing_stream(spark, str(root), 1, str(archive)).select("path", "sha256").writeStream.format("memory").queryName("archived").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        (root / "12/2024-05-01/c.mp4").write_text("c")
        query.processAllAvailable()
        moved = lambda: sorted(p.name for p in archive.rglob("*.mp4"))
        until = time.time() + 20
        while len(moved()) < 2 and time.time() < until:
            time.sleep(0.2)
        assert set(moved()) >= {"a.mp4", "b.mp4"} and not any((root / n).exists() for n in names)
    finally:
        query.stop()
    assert sorted(r.path.rsplit("/", 1)[1] for r in spark.table("archived").collect()) == ["a.mp4", "b.mp4", "c.mp4"]


@pytest.mark.parametrize("option", ["path", "control"])
def test_folders_must_be_named(option):
    with pytest.raises(KeyError, match=option):
        frames.LiveClipReader({o: "/nowhere" for o in ("path", "control") if o != option})
