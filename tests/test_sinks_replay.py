import os
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from voxgrain.sources import audio, replay, sinks


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_wav_files_appear_together(spark, tmp_path):
    clips = spark.range(20).select(F.col("id").cast("string").alias("stamp"), F.lit(8000).alias("rate"), F.array(F.lit(0.5), F.col("id") / 32).alias("samples")).repartition(4)
    sinks.write_wav(clips, str(tmp_path))
    assert files(tmp_path) == sorted(f"{k}.wav" for k in range(20))
    got = {r.path.rsplit("/", 1)[1]: r.samples for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert got["7.wav"] == [0.5, 7 / 32]
    sinks.write_wav(clips.filter("id < 3"), str(tmp_path), mode="overwrite")
    assert files(tmp_path) == ["0.wav", "1.wav", "2.wav"]


@pytest.mark.parametrize("fault", ["error", "killed"])
def test_a_lost_task_leaves_no_file(spark, tmp_path, fault):
    """One of four tasks dies after the others have written theirs."""

    @F.udf("array<double>")
    def samples(k):
        if k == 19:
            time.sleep(2)
            if fault == "killed":
                os.kill(os.getpid(), 9)
            raise RuntimeError("lost")
        return [float(k)]

    clips = spark.range(0, 20, 1, 4).select(F.col("id").cast("string").alias("stamp"), F.lit(8000).alias("rate"), samples("id").alias("samples"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_wav(clips, str(tmp_path))
    assert files(tmp_path) == []


def test_attempts_that_do_not_count(tmp_path):
    writer = sinks.FileWriter(str(tmp_path), "name", ".md", False)
    rows = [Row(name="a", content="one"), Row(name="b", content=b"two")]
    writer.write(iter([Row(name="a", content="of a lost attempt"), Row(name="lost", content="x")]))
    writer.commit([writer.write(iter(rows)), None, writer.write(iter([]))])
    assert files(tmp_path) == ["a.md", "b.md"] and (tmp_path / "a.md").read_text() == "one"
    other = sinks.FileWriter(str(tmp_path), "name", ".md", False)
    with pytest.raises(ValueError, match="two tasks"):
        other.commit([other.write(iter([Row(name="c", content="1")])), other.write(iter([Row(name="c", content="2")]))])
    for bad in ("", "x/../y", "/x", "x//y", "x/", "_x", ".x", "a/_b"):
        with pytest.raises(ValueError, match="name"):
            other.write(iter([Row(name=bad, content="")]))
    other.abort([])
    assert files(tmp_path) == ["a.md", "b.md"]
    deep = sinks.FileWriter(str(tmp_path), "name", "", False)
    deep.commit([deep.write(iter([Row(name="d/e/f.txt", content="1"), Row(name="d/g", content="2")]))])
    assert files(tmp_path) == ["a.md", "b.md", "d/e/f.txt", "d/g"]


def test_markdown_files(spark, tmp_path):
    sinks.write_markdown(spark.createDataFrame([("x", "# é\n"), ("y", "")], "stem string, page string"), str(tmp_path), "page")
    assert files(tmp_path) == ["x.md", "y.md"] and (tmp_path / "x.md").read_text() == "# é\n"


def chunks(spark, low, high):
    at = F.timestamp_millis(1_700_000_000_000 + F.col("id") * 10)
    return spark.range(low, high, 1, 3).select((F.col("id") % 3).cast("string").alias("capture_id"), F.expr("id div 3").alias("seq"), at.alias("at"), F.array(F.col("id").cast("float")).alias("samples"), F.lit(False).alias("is_last"))


def run(spark, folder, out, **options):
    replay.register(spark)
    stream = spark.readStream.format("capture_replay").option("path", folder).options(**options).load()
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(int(r.samples[0]) for r in spark.read.parquet(f"{out}/rows").collect()), query


def test_replay_goes_on_where_it_was(spark, tmp_path):
    folder, out = str(tmp_path / "recording"), str(tmp_path / "out")
    replay.record(chunks(spark, 0, 50), folder)
    assert run(spark, folder, out)[0] == list(range(50))
    assert run(spark, folder, out)[0] == list(range(50))  # nothing new, nothing twice
    replay.record(chunks(spark, 50, 80), folder)
    assert run(spark, folder, out)[0] == list(range(80))
    rows = spark.read.parquet(f"{out}/rows").filter("capture_id = '1'").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(27)) and rows[2].at.timestamp() == 1_700_000_000.07
    replay.record(chunks(spark, 10, 12), folder)  # from a time that has passed
    with pytest.raises(Exception, match="hold chunks from before"):
        run(spark, folder, out)


def test_replay_at_a_speed(spark, tmp_path):
    folder = str(tmp_path / "recording")
    replay.record(chunks(spark, 0, 50), folder)
    reader = replay.ReplayReader(folder, speed=2.0, began=int(time.time() * 1000) - 100)
    assert 1_700_000_000_190 <= reader.latestOffset()["at"] <= 1_700_000_000_490
    slow = replay.ReplayReader(folder, speed=1.0, began=int(time.time() * 1000) + 60_000)
    assert slow.latestOffset()["at"] < 1_700_000_000_000 and slow.partitions(slow.initialOffset(), slow.latestOffset()) == []
    parts = reader.partitions({"at": 1_700_000_000_100, "files": 1}, {"at": 1_700_000_000_200, "files": 2})
    assert sorted(x[0] for p in parts for b in reader.read(p) for x in b["samples"].to_pylist()) == list(range(11, 21))
    with pytest.raises(ValueError, match="startTime"):
        replay.CaptureReplay({"path": folder, "speed": "2"}).streamReader(None)
    assert replay.ReplayReader(str(tmp_path / "none")).latestOffset() == {"at": -1, "files": 0}
