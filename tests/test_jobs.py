"""Streaming jobs, model calls and the registry."""

import hashlib
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect
from cuespan.functions import keys
from cuespan.functions import timecode as C
from cuespan.operators import caches, dialogue, inference, timeline
from cuespan.session import checkpoint_dir, cut_lineage
from cuespan.streaming import jobs
from cuespan.streaming.assign import AssignInOrder, Song

SMALL = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def as_stream(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
@pytest.mark.parametrize("key", ["segment_transcript", "nearest_keyframe", "srt_ingest", "inherit_slots", "merge_slots", "edl_rows", "cache_upsert"])
def test_query_equals_its_sql(spark, key):
    assert compare(queries()[key](spark, SMALL), connect(SMALL), oracle_sql()[key]) is None


def test_streamed_repeats_and_lateness(spark, tmp_path):
    schema = "video_id int, start_ms bigint, end_ms bigint, text string"
    for part in ([(1, 0, 900, "a"), (1, 40, 900, "a"), (1, 0, 900, "b")], [(1, 20, 900, "a"), (1, 5_000, 6_000, "a")]):
        stream = as_stream(spark, spark.createDataFrame(part, schema), str(tmp_path / "in"))
    q = jobs.to_table(jobs.drop_repeated_cues(stream).select("start_ms", "text"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "text", "start_ms")
    assert [t for _, t in got] == ["a", "a", "b"] and got[1][0] == 5_000


def test_streamed_sessions_close_strictly_after_the_gap(spark, tmp_path):
    cues = [(1, 0, 1000), (1, 3500, 4000), (1, 6501, 7000), (1, 900_000, 900_100)]
    stream = as_stream(spark, spark.createDataFrame(cues, "video_id int, start_ms bigint, end_ms bigint"), str(tmp_path / "in"))
    found = jobs.speech_sessions(stream, lateness="1 second").select("start_ms", "end_ms", "cues")
    jobs.to_table(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "start_ms") == [(0, 4000, 2), (6501, 7000, 1)]


def test_incremental_index(spark, tmp_path):
    registry, changed = str(tmp_path / "registry"), []
    schema = "path string, size_bytes bigint"
    spark.createDataFrame([("/a.mp4", 1), ("/b.mp4", 1)], schema).write.parquet(f"{registry}/batch=-1")

    def read():
        last = spark.read.parquet(registry)
        return last.groupBy("path").agg(F.max_by("size_bytes", "batch").alias("size_bytes"))

    files = [("/a.mp4", 1), ("/b.mp4", 2), ("/c.mkv", 3), ("/d.txt", 4)]
    stream = as_stream(spark, spark.createDataFrame(files, schema), str(tmp_path / "in"))
    q = jobs.index_stream(
        stream, read, lambda df, n: df.write.mode("overwrite").parquet(f"{registry}/batch={n}"),
        lambda df, n: changed.extend(sorted(map(tuple, df.select("path", "state").collect()))), str(tmp_path / "state"))
    q.awaitTermination()
    assert changed == [("/b.mp4", "changed"), ("/c.mkv", "new")]
    assert rows(read(), "path") == [("/a.mp4", 1), ("/b.mp4", 2), ("/c.mkv", 3)]


def test_library_is_followed_by_its_listings(spark, tmp_path):
    """A file replaced at equal size is found, and a batch run twice leaves everything as it is."""
    at = lambda day: f"2024-01-0{day} 00:00:00"
    listing = lambda *rows: spark.createDataFrame(rows, "path string, size_bytes bigint, modified_at string")
    out, listings, calls = str(tmp_path / "out"), str(tmp_path / "listings"), []
    indexed = lambda: spark.createDataFrame([("/a.mp4", "skip"), ("/b.mkv", "annotate")], "path string, state string")
    run = lambda: jobs.index_library(spark, listings, out, indexed, work=lambda todo, n: calls.append((n, sorted(r["path"] for r in todo.collect())))).awaitTermination()
    jobs.add_listing(listing(("/a.mp4", 5, at(1)), ("/b.mkv", 5, at(1)), ("/b.txt", 5, at(1))), listings)
    run()
    jobs.add_listing(listing(("/a.mp4", 5, at(2)), ("/b.mkv", 5, at(1))), listings)
    run()
    jobs.add_listing(listing(("/a.mp4", 5, at(2)), ("/b.mkv", 5, at(1))), listings)
    run()
    found = lambda: rows(spark.read.parquet(f"{out}/found").select("batch", "path", "state", "todo"), "batch", "path")
    want = [(0, "/a.mp4", "new", "full"), (0, "/b.mkv", "new", "full"), (1, "/a.mp4", "changed", "full"), (1, "/b.mkv", "known", "annotate"),
            (2, "/a.mp4", "known", "skip"), (2, "/b.mkv", "known", "annotate")]
    assert found() == want and calls == [(0, ["/a.mp4", "/b.mkv"]), (1, ["/a.mp4", "/b.mkv"]), (2, ["/b.mkv"])]
    cache = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "query_hash string, batch int")
    assert rows(jobs.valid_matches(cache, spark.read.parquet(f"{out}/cleared")), "query_hash") == [("y", 1), ("z", 2)]
    # The last batch is not committed: it runs again, over the same listing.
    for name in os.listdir(f"{out}/state/commits"):
        if name.strip(".").startswith("2"):
            os.remove(f"{out}/state/commits/{name}")
    run()
    assert found() == want and calls[-1] == (2, ["/b.mkv"]) and len(calls) == 4


def test_song_state_waits_for_missing_lines():
    song = Song(None)
    song.early = {1: (1000, [(0, 7, 0)]), 2: (1000, [(0, 7, 500), (1, 8, 0)])}
    assert list(song.advance()) == []
    song = Song(song.state())
    song.early[0] = (1000, [(0, 7, 0), (1, 9, 0)])
    assert list(song.advance()) == [(0, 0, 7, 0, 1), (1, 0, 7, 0, 3), (2, 1, 8, 0, 1)]
    again = Song(song.state())
    assert again.next_line == 3 and again.recent == [7, 7, 8] and not again.early


class Store:
    """A map, value or timer handle in memory that counts what is read."""

    def __init__(self):
        self.held, self.value, self.reads = {}, None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        self.reads += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return iter(list(self.held))

    def clear(self):
        self.held, self.value = {}, None


class Handle(Store):
    """What a stateful operator asks of Spark, with one timer."""

    def __init__(self):
        self.states, self.timers, self.now = {}, set(), 0

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Store())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_stored_songs_choose_as_songs_in_memory():
    rng = random.Random(3)
    lines = {i: (rng.choice([0, 1000, 70_000]), [(r, rng.randrange(3), rng.randrange(-500, 200_000)) for r in range(rng.randrange(4))]) for i in range(120)}
    song = Song(None)
    song.early = dict(lines)
    want = list(song.advance())
    handle, logic, got, left = Handle(), AssignInOrder(6_000, 100), [], list(lines)
    logic.init(handle)
    while left:
        # Batches in disorder: each holds some of the next lines.
        batch = [left.pop(rng.randrange(min(8, len(left)))) for _ in range(min(5, len(left)))]
        frame = pd.DataFrame({"line_no": batch, "length_ms": [lines[i][0] for i in batch],
                              "candidates": [[dict(zip(("rank", "video_id", "t_ms"), o)) for o in lines[i][1]] for i in batch]})
        for part in logic.handleInputRows((1,), iter([frame]), handle):
            got += part.itertuples(index=False, name=None)
        handle.now += 10
        assert len(handle.timers) == 1
    assert [row[1:] for row in got] == want
    assert not handle.states["early"].held and len(handle.states["used"].held) > 3
    # The timer of a song without missing lines forgets it; one that waits goes on without the missing line.
    handle.now += 10_000
    handle.timers.clear()
    list(logic.handleExpiredTimer((1,), handle, None))
    assert handle.states["progress"].value is None and not handle.states["used"].held
    late = pd.DataFrame({"line_no": [4], "length_ms": [10], "candidates": [[{"rank": 0, "video_id": 5, "t_ms": 7}]]})
    assert [len(part) for part in logic.handleInputRows((1,), iter([late]), handle)] == [0] and handle.timers == {handle.now + 100}
    handle.timers.clear()
    (part,) = logic.handleExpiredTimer((1,), handle, None)
    assert list(part.itertuples(index=False, name=None)) == [(1, 4, 0, 5, 7, 1)] and handle.timers == {handle.now + 6_000}


def test_keys_of_long_texts_are_fed_piece_by_piece(spark):
    rng = random.Random(2)
    texts = {k: [rng.choice(['a "b"', "é\\n", "", None, "x" * 50]) for _ in range(n)] for k, n in ((1, 25_000), (2, 3), (3, 1), (None, 2))}
    lines = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "song_id bigint, line_no bigint, text string")
    got = caches.streamed_md5(df, "song_id", "line_no", {"whole": (F.col("text"), "", "", ""), "listed": (keys.json_text(F.col("text")), "[", ", ", "]")})
    known = {k: [t for t in ts if t is not None] for k, ts in texts.items()}
    want = {(k, hashlib.md5("".join(ts).encode()).hexdigest(), hashlib.md5(json.dumps(ts, ensure_ascii=False).encode()).hexdigest()) for k, ts in known.items()}
    assert {tuple(r) for r in got.collect()} == want
    assert caches.streamed_md5(df.limit(0), "song_id", "line_no", {"whole": (F.col("text"), "", "", "")}).count() == 0


def test_retries_and_placeholders(spark):
    waits, calls = [], []

    def flaky(row):
        calls.append(row)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert inference.call_with_retries(flaky, 1, 3, waits.append) == "ok" and waits == [2.0, 4.0]
    assert inference.call_with_retries(lambda r: 1 / 0, 1, 3, waits.append) is None

    segs = spark.createDataFrame([(1, 1040, 2250)], "segment_id bigint, start_ms bigint, end_ms bigint")
    got = inference.annotate_batch(segs, lambda row: '```json\n{"tags": "oops', pause=lambda s: None)
    assert got.select("annotation.summary", "annotation.mad_score", "answered").first() == ("Segment 1.0s - 2.3s", 5, False)

    def broken():
        def embed(texts):
            raise RuntimeError
        return embed

    assert inference.embed_batch(spark.createDataFrame([("x",)], "t string"), "t", broken, width=3).first().vector == [0.0, 0.0, 0.0]


def test_clock_texts_and_resync(spark):
    t = F.lit(62_340).cast("bigint")
    row = spark.range(1).select(C.player_clock(t), C.lrc_tag(t), C.needs_resync(F.lit(10_460), F.lit(10_000)), C.needs_resync(F.lit(10_440), F.lit(10_000))).first()
    assert tuple(row) == ("01:02.3", "[01:02.34]", True, False)


def test_speakers(spark):
    cases = [("Sasaki waits", "", None, False, "sasaki"), ("a street", "山田", "unknown", False, "yamada"), ("", "山田", None, False, "unknown"),
             ("Sasaki waits", "", "Tayama", False, "tayama"), ("Sasaki waits", "", "unknown", True, "unknown")]
    df = spark.createDataFrame(cases, "s string, t string, p string, m boolean, want string")
    words = {"tayama": (("tayama", "田山"), ("田山",)), "sasaki": (("sasaki",), ()), "yamada": (("yamada",), ("山田",))}
    found = dialogue.resolve_speaker(F.col("s"), F.col("t"), F.col("p"), F.col("m"), speakers=words)
    assert all(r.got == r.want for r in df.withColumn("got", found).collect())


def test_playhead(spark):
    lines = spark.createDataFrame([(1, 0, 0, 2000, "intro", True), (1, 1, 2000, 4000, "la", False)], "song_id int, line_no bigint, start_ms bigint, end_ms bigint, text string, is_intro boolean")
    slots = spark.createDataFrame([(1, 0, 0, 4000, True, "hi")], "song_id int, slot_no bigint, start_ms bigint, end_ms bigint, keep_audio boolean, transcript string")
    clips = spark.createDataFrame([(1, 0, 3000, 3500, "yo")], "song_id int, clip_no bigint, start_ms bigint, end_ms bigint, transcript string")
    ticks = spark.createDataFrame([(1, t) for t in (0, 2500, 3000, 3500, 4000)], "song_id int, t_ms bigint")
    got = timeline.active_at(ticks, lines, slots, clips).select("t_ms", "line_no", "lyric", "dialogue")
    assert rows(got, "t_ms") == [(0, 0, "", "hi"), (2500, 1, "la", "hi"), (3000, 1, "la", "yo"), (3500, 1, "la", "hi"), (4000, None, "", "")]


def test_children_of_one_video_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda data: spark.createDataFrame(data, "video_id int, text string")
    caches.write_children(df([(1, "a"), (2, "b")]), path)
    caches.write_children(df([(2, "c")]), path)
    assert rows(spark.read.parquet(path).select("video_id", "text"), "video_id") == [(1, "a"), (2, "c")]


def test_checkpoint_folder(spark):
    assert checkpoint_dir(spark)
    assert cut_lineage(spark.range(3)).count() == 3
