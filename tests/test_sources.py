"""Golden cases of the corpus readers."""

from pyspark.sql import functions as F

from cuespan.functions import text as T
from cuespan.sources import decode, library, lyrics, render_plan, setups, subtitles, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_srt_blocks(spark):
    text = "1\r\n00:00:01,200 --> 00:00:03,500\r\nHello\r\nthere\r\n\r\n2\r\n00:00:04,000 --> 00:00:06,850\r\nBye\r\n"
    got = subtitles.ingest_srt(docs(spark, text)).select("start_ms", "end_ms", "text")
    assert rows(got, "start_ms") == [(1200, 3500, "Hello there"), (4000, 6850, "Bye")]


def test_srt_bad_time_ends_the_document(spark):
    block = "{n}\n{t} --> 00:00:09,000\nline {n}"
    text = "\n\n".join([block.format(n=1, t="00:00:01,0"), block.format(n=2, t="xx:00:02,0"), block.format(n=3, t="00:00:03,0")])
    assert rows(subtitles.ingest_srt(docs(spark, text)).select("text"), "text") == [("line 1",)]
    text = "1\n00:00:01,000 to 00:00:02,000\nno arrow\n\n2\n00:00:01,000 --> 00:00:02,000\nok"
    assert rows(subtitles.ingest_srt(docs(spark, text)).select("text"), "text") == [("ok",)]


def test_ass_tags_and_layers(spark):
    line = r"Dialogue: 0,0:01:14.22,0:01:16.85,Default,,0,0,0,,{\fad(1)}one,\Ntwo"
    late = r"Dialogue: 1,0:02:10.00,0:02:15.50,Default,,0,0,0,,three"
    text = "\n".join(["[Events]", line, line, late, late, "Dialogue: bad", line.replace("0:01:14.22", "x:01:14.22"), line.replace("one,\\Ntwo", "")])
    got = subtitles.ingest_ass(docs(spark, text)).select("start_ms", "end_ms", "text")
    assert rows(got, "start_ms") == [(74220, 76850, "one, two"), (130000, 135500, "three")]


def test_lrc_cues_end_at_blank_lines(spark):
    got = subtitles.ingest_lrc_cues(docs(spark, "[00:01.20]one\n[00:04.00]two\nrubbish", "[0:10]a\n[0:12.5]\n[0:20]b"))
    assert rows(got.select("doc_id", "start_ms", "end_ms", "text"), "doc_id", "start_ms") == [
        (0, 1200, 4000, "one"), (0, 4000, 8000, "two"), (1, 10000, 12500, "a"), (1, 20000, 24000, "b"),
    ]


def test_lyrics_lrc(spark):
    text = "[ti:Title]\n[00:10.00]First\n[00:15.50]Second\n[00:22.10]Third\n[00:05.00]Composed by: Someone\n[00:10]untimed"
    got = lyrics.ingest_lyrics_lrc(docs(spark, text).withColumn("duration_ms", F.lit(30000).cast("bigint")))
    assert rows(got.select("line_no", "start_ms", "end_ms", "text"), "line_no") == [
        (0, 10000, 15500, "First"), (1, 15500, 22100, "Second"), (2, 22100, 30000, "Third"),
    ]
    many = docs(spark, "[00:20.5][00:01.123] x\n[00:02.34]y").withColumn("duration_ms", F.lit(9).cast("bigint"))
    assert rows(lyrics.ingest_lyrics_lrc(many).select("start_ms", "text"), "line_no") == [(1123, "[00:20.5] x"), (2340, "y")]  # one digit is no tag


def test_lyrics_txt_and_routing(spark):
    d = docs(spark, "a\n\nMusic - B\nb\r\nc").withColumn("duration_ms", F.lit(30000).cast("bigint"))
    assert rows(lyrics.ingest_lyrics_txt(d).select("start_ms", "end_ms", "text"), "start_ms") == [
        (0, 10000, "a"), (10000, 20000, "b"), (20000, 30000, "c"),
    ]
    r = spark.createDataFrame(
        [(1, "x.LRC", "[00:01.0]no\n[00:01.00]one", 5000), (2, "x.txt", "[00:01.00]one", 5000), (3, None, "[00:01.00]one", 5000), (4, None, "one", 5000),
         (5, None, "lost", 5000)], "doc_id int, file_name string, text string, duration_ms bigint")
    own = spark.createDataFrame([(5, 0, 7, 9, "mine")], "doc_id int, line_no bigint, start_ms bigint, end_ms bigint, text string")
    got = rows(lyrics.route_lyrics(r, own).select("doc_id", "start_ms", "text"), "doc_id")
    assert got == [(1, 1000, "one"), (2, 0, "[00:01.00]one"), (3, 1000, "one"), (4, 0, "one"), (5, 7, "mine")]


def test_credit_lines(spark):
    lines = {
        "": True, "  ": True, "[ar:Someone]": True, "作词：某人": True, "作词": True, "Composed by：Pink/Max": True, "Composed by Pink/Max": True,
        "© 2020": True, "Title": True, "title : x": True, "Music box": False, "Lyrics/Music": True, "written for you": False, "stand by me": False,
        "Stand by me / now": True, "编曲 - 某": True,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string").select("line", T.is_credit_line(F.col("line")).alias("credit"))
    assert {r.line: r.credit for r in df.collect()} == lines


def test_charsets(spark):
    texts = ["plain", "后期混音", "übrig"]
    raw = [(0, texts[0].encode()), (1, texts[1].encode("gb18030")), (2, texts[1].encode("utf-8")), (3, texts[2].encode("utf-16"))]
    got = rows(decode.decode_corpus(spark.createDataFrame(raw, "doc_id int, content binary")), "doc_id")
    assert got == [(0, "plain"), (1, "后期混音"), (2, "后期混音"), (3, "übrig")]


def test_discovery(spark, tmp_path):
    for name in ("b.mp4", "a.MKV", "c.Mp4", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.mp4").write_bytes(b"x")
    got = library.discover_library(library.list_files(spark, str(tmp_path)))
    assert [r.path.rsplit("/", 1)[1] for r in got.orderBy("path").collect()] == ["a.MKV", "b.mp4"]


def test_episode_match_prefers_simplified(spark):
    videos = spark.createDataFrame([(1, "/lib/Show - 01.mkv"), (2, "/lib/Show - 02.mkv"), (3, "/lib/odd.mkv")], "video_id int, original_path string")
    names = ["/lib/subtitles/S E01.cht.ass", "/lib/subtitles/S E01.chs.ass", "/lib/Show - 02.srt", "/lib/x E03.srt"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert rows(library.match_episodes(videos, files), "video_id") == [(1, "/lib/subtitles/S E01.chs.ass"), (2, "/lib/Show - 02.srt")]
    assert rows(library.resolve_subtitles(videos, files), "video_id") == [
        (1, "/lib/subtitles/S E01.chs.ass", "episode"), (2, "/lib/Show - 02.srt", "same name"), (3, None, None),
    ]


def test_setups(spark):
    saves = spark.createDataFrame([("a/b!", 1, "x"), ("ab", 2, "y"), ("***", 3, "z")], "name string, saved_at int, payload string")
    assert rows(setups.latest_setups(saves), "name") == [("ab", 2, "y"), ("default", 3, "z")]
    legacy = spark.createDataFrame([("old",)], "payload string")
    asked = spark.createDataFrame([("ab",), (None,), ("no",)], "name string")
    got = setups.load_setups(asked, saves.filter("saved_at < 3"), legacy)
    assert sorted(map(tuple, got.collect())) == [("ab", "y"), ("default", "old"), ("no", None)]


def test_table_defaults_and_merged_schema(spark, tmp_path):
    spark.createDataFrame([(1, 7, 0, 9)], "segment_id bigint, video_id bigint, start_ms bigint, end_ms bigint").write.parquet(str(tmp_path / "t" / "a"))
    spark.createDataFrame([(2, 7, 0, 9, 8)], "segment_id bigint, video_id bigint, start_ms bigint, end_ms bigint, mad_score int").write.parquet(str(tmp_path / "t" / "b"))
    got = tables.load_table(spark, str(tmp_path / "t" / "*"), "video_segments")
    assert rows(got.select("segment_id", "mad_score", "scene_type", "is_op"), "segment_id") == [(1, 5, "dialogue", False), (2, 8, "dialogue", False)]


def test_render_plan_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"slots": [{"startTime": 0.0, "endTime": 6.5, "videoPath": "v", "clipStart": 1.25, "clipDuration": 6.5, "keepAudio": true}],\n'
        ' "dialogueClips": [], "lyrics": [{"start": 0.0, "end": 2.77, "text": "t", "beats": [1.5, 2.0]}, {"start": 3, "end": 4, "text": "u", "beats": []}]}'
    )
    plans = render_plan.read_plan_files(spark, str(tmp_path))
    assert rows(render_plan.plan_slots(plans).select("start_ms", "end_ms", "clip_start_ms", "keep_audio"), "start_ms") == [(0, 6500, 1250, True)]
    beats = render_plan.plan_beats(plans).select("text", "beat_ms")
    assert rows(beats, "text", "beat_ms") == [("t", 1500), ("t", 2000), ("u", None)]
    songs = [plans.select(F.lit(i).cast("bigint").alias("song_id"), "plan") for i in (1, 2, 3)]
    render_plan.write_render_plans(songs[0].union(songs[1]).union(songs[2]).coalesce(1), str(tmp_path / "out"))
    back = render_plan.read_render_plans(spark, str(tmp_path / "out"))
    assert rows(render_plan.plan_slots(back).select("song_id", "end_ms"), "song_id") == [(i, 6500) for i in (1, 2, 3)]


def test_cues_of_resolved_files(spark, tmp_path):
    files = {
        "a.srt": "1\n00:00:01,200 --> 00:00:03,500\nhéllo\n".encode("utf-16"), "b.lrc": "[00:01.00]one\n[00:04.00]two".encode(),
        "c.ass": "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,你好".encode("gb18030"), "d.ASS": "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,x".encode(),
        "e.SRT": "1\n00:00:01,000 --> 00:00:02,000\nupper\n".encode(), "f.srt": b"1\n00:00:01,000 --> 00:00:02,000\nnot asked for\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    used = [(1, "a.srt"), (2, "b.lrc"), (3, "c.ass"), (4, "d.ASS"), (5, "e.SRT"), (6, "a.srt"), (7, None), (8, "gone.srt")]
    resolved = spark.createDataFrame([(v, n and f"{tmp_path}/{n}") for v, n in used], "video_id bigint, subtitle_path string")
    got = subtitles.ingest_resolved(resolved, subtitles.subtitle_files(spark, str(tmp_path)))
    assert [tuple(r) for r in got.orderBy("video_id", "start_ms").select("video_id", "start_ms", "end_ms", "text").collect()] == [
        (1, 1200, 3500, "héllo"), (2, 1000, 4000, "one"), (2, 4000, 8000, "two"), (3, 1000, 2000, "你好"), (5, 1000, 2000, "upper"), (6, 1200, 3500, "héllo")]
