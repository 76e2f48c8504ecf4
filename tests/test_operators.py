"""Operators against plain restatements of their rules, with chunks small enough to cross."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuespan.functions import timecode
from cuespan.operators import annotate, assign, intervals, match, ranges, ranking, scans, segment, song, timeline
from cuespan.operators import dialogue as dg
from cuespan.operators.intervals import asof, nearest, overlapping, points_in_spans


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    # Key 0 holds most of the rows, in many chunks; some chunks are empty.
    data = [(0 if rng.random() < 0.7 else rng.randint(1, 3), rng.choice([rng.randint(0, 90), rng.randint(900, 990)]), i, rng.choice([None, rng.randint(0, 9)]))
            for i in range(600)]
    return table(spark, data, "k int, t bigint, id int, v int").cache()


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_running_equals_one_window(series, inclusive, reverse, levels):
    got = scans.running(
        series, ["k"], ["t", "id"], F.floor(F.col("t") / 10), {"s": ("sum", F.col("v")), "l": ("last", F.col("v")), "m": ("max", F.col("v"))},
        inclusive=inclusive, reverse=reverse, levels=levels,
    )
    order = [F.desc("t"), F.desc("id")] if reverse else ["t", "id"]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = series.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.last("v", True).over(w).alias("l"), F.max("v").over(w).alias("m"))
    assert rows(got, "id") == rows(want, "id")


def test_positions(series):
    got = scans.positions(series.select("k", "t", "id"), ["k", "t", "id"], F.floor(F.col("t") / 10))
    assert [r[3] for r in rows(got, "k", "t", "id")] == list(range(600))


def test_interval_joins_equal_nested_loops(spark):
    rng = random.Random(3)
    points = [(rng.randint(0, 1), rng.randint(-50, 400), i) for i in range(120)]
    spans = [(rng.randint(0, 1), a, a + rng.choice([0, 5, 60, 200]), i) for i, a in enumerate(rng.randint(-60, 400) for _ in range(80))]
    p, s = table(spark, points, "k int, t bigint, p int"), table(spark, spans, "k int, a bigint, b bigint, s int")
    got = points_in_spans(p, s, ["k"], F.col("t"), F.col("a"), F.col("b"), F.col("t").between(F.col("a"), F.col("b")), bucket_ms=30)
    want = sorted((pk, t, i, a, b, j) for pk, t, i in points for sk, a, b, j in spans if pk == sk and a <= t <= b)
    assert sorted(tuple(r) for r in got.select("k", "t", "p", "a", "b", "s").collect()) == want
    q = s.select("k", F.col("a").alias("c"), F.col("b").alias("d"), F.col("s").alias("z"))
    meets = (F.col("a") <= F.col("d")) & (F.col("c") <= F.col("b"))
    got = overlapping(s, q, ["k"], (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), meets, bucket_ms=30).select("s", "z")
    want = sorted((i, j) for k, a, b, i in spans for l, c, d, j in spans if k == l and a <= d and c <= b)
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, forward, strict):
    rng = random.Random(5)
    left = [(rng.randint(0, 2), rng.randint(0, 200), i) for i in range(80)]
    right = [(rng.randint(0, 1), rng.randint(0, 200), i) for i in range(60)]
    got = asof(table(spark, left, "k int, at bigint, l int"), table(spark, right, "k int, t bigint, r int"), ["k"], "at", "t", ["r"],
               tie=F.col("r"), forward=forward, strict=strict, chunk_ms=20)
    sign = -1 if forward else 1

    def best(k, at):
        fit = [(sign * -t, i) for rk, t, i in right if rk == k and (sign * t < sign * at or (t == at and not strict))]
        return min(fit)[1] if fit else None

    assert {r.l: (r.hit.r if r.hit else None) for r in got.collect()} == {i: best(k, at) for k, at, i in left}


def test_nearest(spark):
    rng = random.Random(6)
    left = [(rng.randint(0, 2), rng.randint(0, 200), i) for i in range(80)]
    right = [(rng.randint(0, 1), rng.randint(0, 200), i) for i in range(60)]
    got = nearest(table(spark, left, "k int, at bigint, l int"), table(spark, right, "k int, t bigint, r int"), ["k"], "at", "t", ["r"],
                  tie=F.col("r"), tie_field="r", chunk_ms=20)
    want = {i: min([(abs(t - at), j) for rk, t, j in right if rk == k], default=(0, None))[1] for k, at, i in left}
    assert {r.l: (r.hit.r if r.hit else None) for r in got.collect()} == want


@pytest.mark.parametrize("levels", [1, 2])
def test_both_directions_over_one_exchange(spark, series, levels, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK_FAN", 3)
    chunk, order = F.floor(F.col("t") / 20), ["t", "id"]
    ways = {"up": ("sum", F.col("id")), "seen": ("last", F.col("v"))}, {"down": ("sum", F.col("id")), "coming": ("last", F.col("v")), "top": ("max", F.col("t"))}
    got = scans.running(series, ["k"], order, chunk, ways[0], backward=ways[1], levels=levels)
    one = scans.running(series, ["k"], order, chunk, ways[0], levels=levels)
    other = scans.running(series, ["k"], order, chunk, ways[1], reverse=True, levels=levels)
    want = one.join(other, ["k", "t", "id"]).select("k", "t", "id", "up", "seen", "down", "coming", "top")
    assert rows(got.select(*want.columns), "k", "t", "id") == rows(want, "k", "t", "id")

    def exchanges(df):
        return df._jdf.queryExecution().sparkPlan().toString().count("Aggregate("), df._jdf.queryExecution().optimizedPlan().toString().count("Join")

    assert exchanges(got) == exchanges(one)


def test_segments_of_random_videos(spark):
    rng = random.Random(11)
    kfs, cues, vids = [], [], []
    for v in range(60):
        duration = rng.choice([3000, 9000, 40_000, 200_000])
        vids.append((v, duration))
        if v % 9 == 0:
            continue
        step = rng.choice([500, 1700, 3900])
        kfs += [(v, i, t, rng.choice([1.0, 7.0]), f"f{t}") for i, t in enumerate(range(0, duration, step))]
        cues += [(v, i, t, t + rng.randint(100, 9000), f"c{i}") for i, t in enumerate(sorted(rng.sample(range(0, duration, 10), 6)))]
    k = table(spark, kfs, "video_id bigint, keyframe_id bigint, t_ms bigint, motion_score double, frame_path string")
    c = table(spark, cues, "video_id bigint, cue_id bigint, start_ms bigint, end_ms bigint, text string")
    v = table(spark, vids, "video_id bigint, duration_ms bigint")
    got = rows(segment.segment_videos(k, c, v, chunk_ms=6_000), "video_id", "start_ms")
    marked = {(r[0], r[1]) for df in (segment.motion_cuts(k), segment.silence_cuts(c)) for r in df.select("video_id", "cut_ms").collect()}
    seen = {x[0] for x in kfs}
    for i, d in vids:
        own = [(s, e) for x, s, e in got if x == i]
        assert bool(own) == (i in seen)
        if not own:
            continue
        # The segments tile the video.
        assert own[0][0] == 0 and own[-1][1] == d and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        marks = sorted(m for x, m in marked if x == i and 0 < m < d)
        kept = [0, *(s for s, _ in own if s in marks)]
        # A cut is kept exactly when it lies far enough from the one kept before it and from the end.
        assert all(b - a >= segment.MIN_SEGMENT_MS and d - b >= segment.MIN_SEGMENT_MS for a, b in zip(kept, kept[1:]))
        for m in set(marks) - set(kept):
            inside = any(s == m for s, _ in own)
            assert inside or m - max(x for x in kept if x < m) < segment.MIN_SEGMENT_MS or d - m < segment.MIN_SEGMENT_MS
        # What lies between two kept cuts is whole, or in even parts where it is too long; the rest is whole.
        for a, b in zip(kept, kept[1:]):
            parts = [e - s for s, e in own if a <= s < b]
            assert len(parts) == (1 if b - a <= segment.MAX_SEGMENT_MS else (b - a) // segment.CHUNK_TARGET_MS + 1) and max(parts) - min(parts) <= 20
        assert sum(s >= kept[-1] for s, _ in own) == 1


@pytest.mark.parametrize("fan,step", [(2, 700), (3, 1300), (2, 4100)])
def test_cuts_followed_over_many_levels(spark, fan, step):
    rng = random.Random(step)
    cuts = {v: sorted(rng.sample(range(0, 900_000, 10), 900_000 // step)) for v in range(3)}
    cuts[3] = [t for t in range(0, 900_000, 3990) if not 200_000 < t < 600_000]
    df = table(spark, [(v, t) for v, ts in cuts.items() for t in ts], "video_id bigint, cut_ms bigint")
    pieces, last = segment._accepted(df, 4000, 5000, fan)
    want, ends = [], {}
    for v, ts in cuts.items():
        ends[v] = 0
        for t in ts:
            if t - ends[v] >= 4000:
                want.append((v, ends[v], t))
                ends[v] = t
    assert rows(pieces.select("video_id", "start_ms", "end_ms"), "video_id", "start_ms") == want
    assert dict(rows(last, "video_id")) == ends


def test_a_video_of_sixteen_thousand_chunks(spark):
    """One video's cuts in 16,000 chunks: three levels of at most 64 chunks a row, no list of all of them."""
    df = spark.range(16_000 * 20).select(F.lit(1).cast("bigint").alias("video_id"), (F.col("id") * 500 + F.pmod(F.xxhash64("id"), F.lit(490))).alias("cut_ms"))
    pieces, last = segment._accepted(df, 4000, 10_000, 64)
    got = pieces.agg(F.count("*").alias("n"), F.min(F.col("end_ms") - F.col("start_ms")).alias("least"), F.max(F.col("end_ms") - F.col("start_ms")).alias("most"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("all")).first()
    assert got["least"] >= 4000 and got["most"] < 4000 + 1000 and got["all"] == last.first()["last_cut_ms"] > 159_000_000


def test_segments_golden(spark):
    k = table(spark, [(1, i, i * 1000, 8.0 if i == 10 else 1.0, "f") for i in range(30)], "video_id bigint, keyframe_id bigint, t_ms bigint, motion_score double, frame_path string")
    c = table(spark, [(1, 1, 5000, 20000, "a"), (1, 2, 25000, 28000, "b")], "video_id bigint, cue_id bigint, start_ms bigint, end_ms bigint, text string")
    v = table(spark, [(1, 30000)], "video_id bigint, duration_ms bigint")
    s = segment.segment_videos(k, c, v)
    assert [r[1:] for r in rows(s, "start_ms")] == [(0, 10000), (10000, 22500), (22500, 30000)]
    assert [r[3] for r in rows(segment.segment_transcripts(s, c), "start_ms")] == ["a", "", "b"]
    assert [len(r[3]) for r in rows(segment.representative_frames(s, k), "start_ms")] == [3, 3, 3]


def test_merge_with_drift(spark, monkeypatch):
    monkeypatch.setattr(timeline, "LINE_CHUNK", 7)
    rng = random.Random(2)
    data = []
    for song_id in range(25):
        t, clip = 0, 0
        for n in range(40):
            length = rng.choice([500, 1000])
            data.append(dict(song_id=song_id, slot_no=n, start_ms=t + rng.choice([0, 0, 0, 9, 10]), end_ms=t + length, video_id=1 if rng.random() < 0.95 else 2,
                             clip_start_ms=clip + rng.choice([0, 0, 20, -30, 49, 60]), clip_duration_ms=length, keep=rng.random() < 0.95, transition=rng.choice(["none", None, "none", "none", "cut"])))
            t, clip = t + length, clip + length
    df = table(spark, [tuple(r.values()) for r in data], "song_id int, slot_no bigint, start_ms bigint, end_ms bigint, video_id bigint, clip_start_ms bigint, clip_duration_ms bigint, keep boolean, transition string")
    got = timeline.merge_slots(df, ["keep"]).select("song_id", "slot_no", "end_ms", "clip_duration_ms", "merged")
    by_song = {}
    for r in data:
        by_song.setdefault(r["song_id"], []).append(r)
    longest = 0
    for song_id, slots in by_song.items():
        merged = [r for r in rows(got, "song_id", "slot_no") if r[0] == song_id]
        assert sum(r[4] for r in merged) == len(slots) and sum(r[3] for r in merged) == sum(x["clip_duration_ms"] for x in slots)

        def joins(head, length, last, x):
            return (
                head["video_id"] == x["video_id"] and head["keep"] == x["keep"] and x["transition"] in (None, "none")
                and abs(last["end_ms"] - x["start_ms"]) < 10 and abs(head["clip_start_ms"] + length - x["clip_start_ms"]) < 50
            )

        for n, (_, first, end, length, count) in enumerate(merged):
            run = slots[first : first + count]
            longest = max(longest, count)
            assert run[-1]["end_ms"] == end and sum(x["clip_duration_ms"] for x in run) == length
            # Each member goes on where those before it end; the next row does not.
            assert all(joins(run[0], sum(x["clip_duration_ms"] for x in run[:i]), run[i - 1], run[i]) for i in range(1, count))
            assert n + 1 == len(merged) or not joins(run[0], length, run[-1], slots[first + count])
    assert longest > 3


def test_blocks_make_up_their_buckets(spark):
    rng = random.Random(5)
    made = [(a, a + rng.choice([1, 2, 15, 16, 17, 200, 4096, 5000, 70_000])) for a in (rng.randrange(-600, 70_000) for _ in range(200))]
    got = table(spark, made, "a bigint, b bigint").selectExpr("a", "b", f"{intervals._whole_blocks('a', 'b')} AS blocks").collect()
    for r in got:
        covered = [x for level, block in r["blocks"] for x in range(block * 16**level, (block + 1) * 16**level)]
        assert sorted(covered) == list(range(r["a"], r["b"])) and len(r["blocks"]) <= 2 * 15 * 3 + (r["b"] - r["a"]) // 4096


def test_first_of_nested_spans(spark):
    rng = random.Random(9)
    spans = [(rng.randrange(2), i, a, a + rng.choice([0, 1, 40, 900, 9_000, 800_000, 40_000_000]), rng.randrange(5), f"x{i}") for i in range(300) for a in [rng.randrange(-50_000, 900_000)]]
    ticks = [(k, rng.choice([rng.randrange(-60_000, 1_000_000), rng.choice(spans)[2], rng.choice(spans)[3]])) for k in (0, 1, 2) for _ in range(150)]
    first = table(spark, spans, "k int, id int, a bigint, b bigint, rank int, level string")
    kinds = {"one": (first, "a", "b", ["rank", "id"], ["id", "level"]), "odd": (first.where("id % 2 = 1"), "a", "b", ["id"], ["rank"])}
    got = intervals.first_at(table(spark, ticks, "k int, t bigint"), kinds, ["k"], "t", bucket_ms=1000).collect()
    assert len(got) == len(ticks)
    for r in got:
        inside = [x for x in spans if x[0] == r["k"] and x[2] <= r["t"] < x[3]]
        best = min(inside, key=lambda x: (x[4], x[1]), default=None)
        odd = min((x for x in inside if x[1] % 2), key=lambda x: x[1], default=None)
        assert (r["one"] and tuple(r["one"])) == (best and (best[1], best[5])) and (r["odd"] and tuple(r["odd"])) == (odd and (odd[4],))


def test_nested_hours_are_not_paired(spark):
    """A thousand spans of hours around a thousand ticks: a million pairs, of which a row per tick and level is looked at."""
    i = F.col("id")
    spans = spark.range(1000).select(F.lit(1).alias("k"), i, (i * 1000).alias("a"), (20_000_000 - i * 1000).alias("b"))
    ticks = spark.range(1000).select(F.lit(1).alias("k"), (5_000_000 + i * 10_007).alias("t"))
    asked, answers = intervals.questions(ticks, ["k"], "t"), intervals.answers({"hit": (spans, "a", "b", ["id"], ["id"])}, ["k"])
    levels = 1 + intervals.BLOCK_LEVELS
    assert asked.count() == 1000 * levels and asked.join(answers, ["k", "level", "block"]).count() <= 1000 * levels
    assert answers.count() < 1000 * 2 + 2100
    assert {r["hit"]["id"] for r in intervals.first_at(ticks, {"hit": (spans, "a", "b", ["id"], ["id"])}, ["k"], "t").collect()} == {0}


def test_overlaps_without_pairs(spark):
    rng = random.Random(21)
    lines = [(s, n, n * 1000, n * 1000 + rng.choice([0, 500, 1000, 3000]), "x") for s in range(4) for n in range(25)]
    shown = [(s, n, rng.randrange(3), rng.randrange(0, 20_000, 250), rng.choice([0, 250, 1000, 5000])) for s, n, *_ in lines if rng.random() < 0.6]
    offers = [(s, n, r, rng.randrange(3), rng.randrange(-500, 20_000, 250)) for s, n, *_ in lines for r in range(3)] + [(9, 1, 0, 1, 0)]
    got = timeline.overlapping_candidates(
        table(spark, offers, "song_id bigint, line_no bigint, rank int, video_id bigint, t_ms bigint"), table(spark, lines, LINES),
        table(spark, shown, "song_id bigint, line_no bigint, video_id bigint, clip_start_ms bigint, clip_duration_ms bigint"))
    length = {(s, n): b - a for s, n, a, b, _ in lines}
    want = []
    for s, n, r, v, t in offers:
        c0 = max(0, t)
        c1 = c0 + length.get((s, n), -10**9)
        want.append((s, n, r, any(x[0] == s and x[1] != n and x[2] == v and c0 < x[3] + x[4] and x[3] < c1 for x in shown)))
    assert rows(got.select("song_id", "line_no", "rank", "overlaps"), "song_id", "line_no", "rank") == sorted(want)
    assert {w[3] for w in want} == {True, False}
    # The plan pairs no clips: every join is on a whole key, none has a further condition.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("<" not in line for line in plan.splitlines() if "Join" in line)


def plain_heads(runs):
    heads, last = {}, None
    for song_id, run, d, head, opens in sorted(runs):
        if last is None or last[0] != song_id or opens or abs(d - last[1]) >= timeline.MERGE_DRIFT_MS:
            last = (song_id, d, head)
        heads[song_id, run] = last[2]
    return heads


RUNS = "song_id bigint, _run bigint, _d bigint, head bigint, opens boolean"


@pytest.mark.parametrize("fan,chunk", [(2, 3), (3, 8), (64, 1)])
def test_heads_over_many_levels(spark, monkeypatch, fan, chunk):
    monkeypatch.setattr(timeline, "RUN_CHUNK", chunk)
    rng = random.Random(fan + chunk)
    runs = []
    for song_id, step in enumerate([3, 20, 99, 40, 1]):
        d = 0
        for n in range(150):
            d += rng.choice([-step, step, rng.randint(-step, step), step])
            runs.append((song_id, n + 1, d, 10 * n, n == 0 or rng.random() < (0.05 if song_id % 2 else 0)))
    got = {(r["song_id"], r["_run"]): r["head"] for r in timeline._heads(table(spark, runs, RUNS), fan).collect()}
    assert got == plain_heads(runs)


def test_a_stretch_of_a_million_runs(spark):
    """One unbroken stretch with drift up and down and, in its second half, ever upwards: the number of groups follows from the rule."""
    count = 1_000_000
    i = F.col("id")
    d = F.when(i < count // 2, F.pmod(i, F.lit(40))).otherwise(i - count // 2)
    runs = spark.range(count).select(F.lit(1).cast("bigint").alias("song_id"), (i + 1).alias("_run"), d.alias("_d"), i.alias("head"), (i == 0).alias("opens"))
    heads = timeline._heads(runs, 64).groupBy("head").count()
    got = heads.agg(F.count("*").alias("groups"), F.sum("count").alias("runs"), F.max(F.when(F.col("head") > 0, F.col("count"))).alias("most")).first()
    # The first group holds the first half and the runs up to 49 after it; then each group spans 50.
    assert (got["runs"], got["groups"], got["most"]) == (count, 1 + -(-(count // 2 - 50) // 50), 50)



LINES = "song_id bigint, line_no bigint, start_ms bigint, end_ms bigint, text string"
SLOTS = "song_id bigint, slot_no bigint, start_ms bigint, end_ms bigint, video_id bigint, clip_start_ms bigint, clip_duration_ms bigint, video_duration_ms bigint, transition string"


def test_gap_fill_golden(spark):
    lines = table(spark, [(1, 0, 0, 2000, "a"), (1, 1, 2000, 5000, "b"), (1, 2, 5000, 7000, "c")], LINES)
    slots = table(spark, [(1, 0, 0, 2000, 9, 8000, 2000, 60000, "cut")], SLOTS)
    got = rows(timeline.effective_slots(lines, slots).select("line_no", "clip_start_ms", "clip_duration_ms", "is_fallback", "fallback_from"), "line_no")
    assert got == [(0, 8000, 2000, False, None), (1, 10000, 3000, True, 0), (2, 13000, 2000, True, 0)]
    late = table(spark, [(1, 2, 5000, 7000, 9, 8000, 2000, 60000, "cut")], SLOTS)
    assert rows(timeline.effective_slots(lines, late).select("line_no", "clip_start_ms", "fallback_from"), "line_no")[0] == (0, 8000, 2)
    videos = table(spark, [(9, 9000)], "video_id bigint, duration_ms bigint")
    got = rows(timeline.inherit_slots(slots, lines, videos).select("line_no", "clip_start_ms", "transition", "inherited"), "line_no")
    assert got == [(0, 8000, "cut", False), (1, 8900, None, True), (2, 8900, None, True)]
    got = rows(timeline.inherit_slots(late, lines, videos).select("line_no", "clip_start_ms"), "line_no")
    assert got == [(0, 3000), (1, 5000), (2, 8000)]


def test_every_line_is_covered(spark):
    rng = random.Random(9)
    lines = [(s, n, n * 1000, n * 1000 + 1000, "x") for s in range(6) for n in range(12)]
    slots = [(s, n, n * 1000 + rng.choice([-5, 0, 300]), n * 1000 + 900, rng.randint(0, 3), rng.randint(0, 9000), 900, 9000, "none") for s in range(1, 6) for n in range(12) if rng.random() < 0.4]
    got = timeline.inherit_slots(table(spark, slots, SLOTS), table(spark, lines, LINES), table(spark, [(0, 5000)], "video_id bigint, duration_ms bigint"))
    with_slots = {s[0] for s in slots}
    assert {(r.song_id, r.line_no) for r in got.collect()} >= {(s, n) for s, n, *_ in lines if s in with_slots}


def test_assignment_keeps_its_promises(spark):
    rng = random.Random(4)
    lines, slots, cands, kept, offered, spans = [], [], [], {}, {}, {}
    for s in range(40):
        t = 1000
        for i in range(14):
            length = rng.choice([1000, 3000])
            lines.append((s, i, t, t + length, "x"))
            spans[s, i] = length
            if rng.random() < 0.2:
                kept[s, i] = (rng.randint(0, 3), rng.randint(0, 20) * 500, length)
                slots.append((s, i, t, t + length, *kept[s, i], rng.choice([None, 8000]), "none"))
            if rng.random() < 0.85:
                offered[s, i] = [(r, rng.randint(0, 3), rng.randint(-2, 20) * 500, rng.randint(0, 20) * 500, rng.choice([0, 9000])) for r in range(3)]
                cands += [(s, i, *c) for c in offered[s, i]]
            t += length + rng.choice([0, 0, 500])
    got = rows(assign.assign_candidates(
        table(spark, lines, LINES), table(spark, slots, SLOTS),
        table(spark, cands, "song_id bigint, line_no bigint, rank int, video_id bigint, t_ms bigint, clip_start_ms bigint, limit_ms bigint")), "song_id", "line_no")
    assert [(r[0], r[1]) for r in got] == sorted(set(offered) - set(kept))
    filled, tiers = dict(kept), set()
    for s, i, rank, video, clip, tier in got:
        offer = {c[0]: c for c in offered[s, i]}
        assert offer[rank][1] == video and offer[rank][3] == clip
        tiers.add(tier)
        at = max(0, offer[rank][2])
        taken = [v for (x, j), v in filled.items() if x == s and j != i]
        if tier < 3:
            assert not any(v == video and at < c + n and c < at + spans[s, i] for v, c, n in taken)
        else:
            assert rank == 0
        if tier == 1:
            assert video not in {filled[s, j][0] for j in range(i - 4, i) if (s, j) in filled}
        filled[s, i] = (video, clip, spans[s, i])
    assert tiers == {1, 2, 3}


def test_assignment_by_hand(spark):
    lines = table(spark, [(1, i, i * 1000, i * 1000 + 1000, "x") for i in range(4)], LINES)
    slots = table(spark, [(1, 0, 0, 1000, 7, 5000, 1000, None, "none")], SLOTS)
    offers = [(1, 1, 0, 7, 9000, 9000, 0), (1, 1, 1, 8, 0, 0, 0), (1, 2, 0, 7, 5500, 5500, 0), (1, 2, 1, 8, 3000, 3000, 0), (1, 3, 0, 7, 5200, 5200, 0)]
    got = assign.assign_candidates(lines, slots, table(spark, offers, "song_id bigint, line_no bigint, rank int, video_id bigint, t_ms bigint, clip_start_ms bigint, limit_ms bigint"))
    # A new video first; then one used lately but free; then the first offer, though it is taken.
    assert rows(got, "line_no") == [(1, 1, 1, 8, 0, 1), (1, 2, 1, 8, 3000, 2), (1, 3, 0, 7, 5200, 3)]


def plain_assignment(starts, ends, own, offers):
    """What every line shows, worked out anew for each question."""
    own, out = dict(own), []

    def shown(k):
        before = [j for j in own if j <= k]
        if k in own:
            return own[k][0], own[k][1], own[k][2]
        if not before:
            return (own[min(own)][0], own[min(own)][1], ends[k] - starts[k]) if own else None
        video, clip, length, limit = own[max(before)]
        last = (limit if limit > 0 else length + 5000) - timecode.CLIP_MARGIN_MS
        moved = clip + starts[k] - starts[max(before)]
        return video, max(0, last) if moved > last else moved, ends[k] - starts[k]

    for i in sorted(set(offers) - set(own)):
        views = [shown(k) for k in range(len(starts)) if k != i]
        near = {shown(k)[0] for k in range(max(0, i - 4), i) if shown(k)}
        length = ends[i] - starts[i]
        free = [o for o in offers[i] if not any(v and v[0] == o[1] and max(0, o[2]) < v[1] + v[2] and v[1] < max(0, o[2]) + length for v in views)]
        fresh = [o for o in free if o[1] not in near]
        tier, chosen = (1, fresh[0]) if fresh else (2, free[0]) if free else (3, offers[i][0])
        own[i] = (chosen[1], chosen[3], length, chosen[4])
        out.append((i, tier, chosen))
    return out


def test_assignment_against_what_every_line_shows():
    rng = random.Random(11)
    for _ in range(400):
        n = rng.randrange(1, 22)
        starts = np.cumsum([rng.choice([0, 100, 500, 1000, 2000]) for _ in range(n)]) if rng.random() < 0.8 else np.array([rng.randrange(5000) for _ in range(n)])
        ends = starts + np.array([rng.choice([0, 1, 400, 1000, 3000]) for _ in range(n)])
        videos, share = rng.choice([1, 2, 5]), rng.choice([0, 0.1, 0.4])
        own = {i: (rng.randrange(videos), rng.randrange(0, 6000, 250), rng.choice([0, 500, 4000]), rng.choice([0, 3000, 8000])) for i in range(n) if rng.random() < share}
        offers = {i: [(r, rng.randrange(videos), rng.randrange(-200, 8000, 100), rng.randrange(0, 8000, 100), rng.choice([0, 2000, 9000])) for r in range(rng.randrange(1, 5))] for i in range(n) if rng.random() < 0.7}
        run = assign.Pass(starts, ends, [assign.slot(i, *own[i]) for i in sorted(own)])
        got = [(i, *chosen) for i in sorted(offers) if (chosen := run.decide(i, offers[i])) is not None]
        assert got == plain_assignment(starts.tolist(), ends.tolist(), own, offers)


def test_assignment_of_a_long_song(spark):
    """Fifty thousand lines of one song in one pass, beside short songs; the choices asked of each line stay few."""
    count = 50_000
    lines = spark.range(count + 40).select(
        F.when(F.col("id") < count, 1).otherwise(F.col("id") % 4 + 2).cast("bigint").alias("song_id"), F.col("id").alias("line_no"),
        (F.col("id") * 3000).alias("start_ms"), (F.col("id") * 3000 + 3000).alias("end_ms"), F.lit("x").alias("text"),
    )
    offers = lines.select("song_id", "line_no", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank")).select(
        "song_id", "line_no", F.col("rank").cast("int").alias("rank"), F.pmod(F.xxhash64("line_no", "rank"), F.lit(300)).alias("video_id"),
        F.pmod(F.xxhash64("rank", "line_no"), F.lit(7_000_000)).alias("t_ms"),
    ).withColumn("clip_start_ms", F.col("t_ms")).withColumn("limit_ms", F.lit(7_200_000).cast("bigint"))
    slots = table(spark, [(1, n, n * 3000, n * 3000 + 3000, n % 300, n, 3000, 7_200_000, "none") for n in range(0, count, 50)], SLOTS)
    got = assign.assign_candidates(lines, slots, offers)
    tiers = {r["tier"]: r["count"] for r in got.groupBy("tier").count().collect()}
    assert sum(tiers.values()) == count + 40 - count // 50 and tiers[1] > 0.9 * count


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=20), st.lists(st.tuples(st.integers(0, 32), st.integers(0, 5)), max_size=10))
def test_used_ranges(added, asked):
    kept = ranges.Ranges()
    for start, length in added:
        kept.add(start, start + length)
    for a, length in asked:
        assert kept.hits(a, a + length) == any(s < a + length and s + n > a for s, n in added)
    assert all(e <= s for e, s in zip(kept.ends, kept.starts[1:]))


def test_top_k_equals_full_scoring(spark):
    rng = random.Random(8)
    vecs = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(300)]
    items = [(1000 - i, v, float(i % 12), vecs[i - 1] if i % 3 else None) for i, v in enumerate(vecs)]
    asked = [(i, vecs[i * 7], ["any", "low", "medium", "high"][i % 4]) for i in range(30)]
    got = ranking.rank_blocks(
        table(spark, asked, "prompt_id bigint, vector array<float>, motion string"),
        table(spark, items, "keyframe_id bigint, vector array<float>, motion_score double, cue_vector array<float>"),
        ranking.semantic_scorer(), item_id="keyframe_id", k=5, prompts_per_block=8)
    target = {"low": 0.0, "medium": 0.5, "high": 1.0}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) if b else 0.0
    want = {}
    for p, v, m in asked:
        factor = lambda x: 1 - 0.3 * abs(min(x, 10) / 10 - target[m]) if m in target else 1.0
        scored = sorted((-round((dot(v, u) * factor(x) + 0.3 * dot(v, c)) * 1e6), i) for i, u, x, c in items)[:5]
        want[p] = [(r, i, -s) for r, (s, i) in enumerate(scored)]
    have = {}
    for r in got.orderBy("prompt_id", "rank").collect():
        have.setdefault(r.prompt_id, []).append((r["rank"], r.keyframe_id, r.score_micros))
    assert have == want


def test_reuse_within_bounds(spark):
    schema = "segment_id bigint, video_id bigint, start_ms bigint, is_op boolean, is_ed boolean, summary string"
    known = table(spark, [(5, 1, 1000, True, False, "far"), (6, 1, 1500, True, False, "near"), (7, 2, 0, True, False, "own")], schema)
    asked = table(spark, [(90, 3, True, False, 500), (91, 3, True, False, 5000), (92, 2, True, False, 0), (93, 3, False, True, 500), (94, 3, True, False, 2000), (95, 3, True, False, 1999)],
                  "segment_id bigint, video_id bigint, is_op boolean, is_ed boolean, relative_ms bigint")
    got = annotate.reuse_annotations(asked, known, ["summary"]).select("segment_id", "donor_id")
    assert rows(got, "segment_id") == [(90, 5), (91, None), (92, 5), (93, None), (94, None), (95, 6)]


def test_default_theme_words(spark):
    cues = table(spark, [(1, 1, 5000, "x さらっと食べて"), (1, 2, 200_000, "无所谓的夜晚")], "video_id bigint, cue_id bigint, start_ms bigint, text string")
    segs = table(spark, [(1, 0, 4000), (1, 4000, 8000), (1, 96_000, 98_000), (1, 98_000, 99_000), (1, 200_000, 201_000)], "video_id bigint, start_ms bigint, end_ms bigint")
    got = annotate.mark_themes(segs, cues).select("start_ms", "is_op", "is_ed", "relative_ms")
    assert rows(got, "start_ms") == [(0, False, False, 0), (4000, True, False, -1000), (96_000, True, False, 91_000), (98_000, False, False, 0), (200_000, False, True, 0)]


def test_candidate_ranks_keep_their_gap(spark):
    ranks = table(spark, [(1, [7, 99, 8])], "song_id bigint, segment_ids array<bigint>")
    pool = table(spark, [(7, 1), (8, 1)], "segment_id bigint, video_id bigint")
    assert rows(match.ranked_candidates(ranks, pool, ["song_id"]).select("segment_id", "rank", "score"), "rank") == [(7, 0, 100), (8, 2, 80)]


def test_lyric_range_golden(spark):
    lines = table(spark, [(1, i, a, b, "x") for i, (a, b) in enumerate([(10000, 15000), (15000, 20000), (20000, 30000), (30000, 40000)])], LINES)
    cut = table(spark, [(1, 15000, 35000)], "song_id bigint, range_start_ms bigint, range_end_ms bigint")
    assert rows(song.offset_lyrics(lines, cut).select("start_ms", "end_ms"), "start_ms") == [(0, 5000), (5000, 15000), (15000, 20000)]
    intro = song.add_intro(table(spark, [(1, 0, 10440, 12000, "a"), (2, 0, 0, 5, "b")], LINES)).filter("is_intro")
    assert rows(intro.select("song_id", "start_ms", "end_ms"), "song_id") == [(1, 0, 10440)]


def test_range_cut_golden(spark):
    slots = table(spark, [(1, 0, 2000, 5500, 9, 5000, 3500, None, None), (1, 1, 8000, 9000, 9, 0, 1000, None, None)], SLOTS)
    asked = table(spark, [(1, 3000, 7000)], "song_id bigint, wanted_start_ms bigint, wanted_end_ms bigint")
    cut = timeline.song_ranges(slots, asked)
    got = timeline.cut_to_range(slots, cut, has_clip=True).select("start_ms", "end_ms", "clip_start_ms", "clip_duration_ms")
    assert rows(got, "start_ms") == [(0, 2500, 6000, 2500)]
    beats = table(spark, [(1, 2000, 5000, [2500, 3500, 4000])], "song_id bigint, start_ms bigint, end_ms bigint, beats array<bigint>")
    assert rows(timeline.cut_to_range(beats, cut, has_clip=False, times=["beats"]).select("beats"), "beats") == [([500, 1000],)]


def test_dialogue_timing_golden(spark):
    names = "line_start_ms line_end_ms song_ms offset_start_ms offset_end_ms clip_start_ms clip_duration_ms video_duration_ms dialogue_start_ms dialogue_end_ms dialogue_clip_start_ms"
    df = table(spark, [(4000, 5000, 30000, 0, 1000, 2000, 1000, 60000, 5000, 8000, 10000)], ", ".join(f"{n} bigint" for n in names.split()))
    got = dg.dialogue_timing(df).select("d_start_ms", "d_end_ms", "d_clip_start_ms", "d_duration_ms")
    assert rows(got, "d_start_ms") == [(5000, 8000, 10000, 3000)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(4000, 60_000), unique=True, max_size=40))
def test_chunk_walk_is_greedy(cuts):
    """The doors-and-walk idea behind the parallel choice of cuts, in plain Python."""
    least, width = 4000, 5000
    start, want = 0, []
    for c in sorted(cuts):
        if c - start >= least:
            want.append(c)
            start = c
    chunks, last, got = {}, 0, []
    for c in sorted(cuts):
        chunks.setdefault(c // width, []).append(c)
    for no in sorted(chunks):
        own = chunks[no]
        low = [c for c in own if c < no * width + least]
        doors = low + [c for c in own if c >= no * width + least][:1]
        door = next((d for d in doors if d - last >= least), None)
        replay, at = [], last
        for c in own:
            if c - at >= least:
                replay.append(c)
                at = c
        assert (door is None) == (not replay) and (door is None or replay[0] == door)
        got, last = got + replay, at
    assert got == want


@pytest.mark.parametrize("clustered", [True, False])
def test_bounded_top_k_equals_scoring_all(spark, clustered):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * (5 if clustered else 0)
    vectors = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * (0.1 if clustered else 1)
    items = [(i, v.tolist() if i % 50 else None, float(i % 12), vectors[i - 1].tolist() if i % 3 == 0 else None) for i, v in enumerate(vectors)]
    asked = [(i, (v + 0.01).tolist(), ["any", "low", "medium", "high"][i % 4]) for i, v in enumerate(vectors[::20])]
    pool = table(spark, items, "keyframe_id bigint, vector array<double>, motion_score double, cue_vector array<double>")
    prompts = table(spark, asked, "prompt_id bigint, vector array<double>, motion string")
    ranked = ranking.semantic_topk_bounded(prompts, pool, k=5, items_per_block=100, prompts_per_block=20)
    want = ranking.semantic_topk(prompts, pool, k=5)
    order = ("prompt_id", "rank")
    assert rows(ranked.best.select(*want.columns), *order) == rows(want, *order)
    share = ranked.scored.count() / ranked.pairs
    assert share < 0.5 if clustered else share <= 1
    dots = pool.where("vector IS NOT NULL").select("keyframe_id", "vector")
    best = ranking.rank_bounded(prompts, dots, ranking.dot_scorer, ranking.Ball(), item_id="keyframe_id", k=3, items_per_block=100).best
    plain = ranking.rank_blocks(prompts, dots, ranking.dot_scorer, item_id="keyframe_id", k=3)
    assert rows(best.select(*plain.columns), *order) == rows(plain, *order)
    assert ranking.semantic_topk_bounded(prompts, pool.limit(0)).best.count() == 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_exploded_points_do_not_go_through_the_driver(spark):
    """Two songs of 200,000 beats each are estimated as two rows."""
    songs = table(spark, [(1, 100_000_000), (2, 100_000_000)], "song_id bigint, duration_ms bigint").repartition(2)
    beats = songs.groupBy("song_id").agg(F.max("duration_ms").alias("d")).select("song_id", F.explode(F.expr("sequence(0L, d, 500L)")).alias("beat_ms"))
    lines = table(spark, [(s, i, i * 700, i * 700 + 600) for s in (1, 2) for i in range(20)], "song_id bigint, line_no bigint, start_ms bigint, end_ms bigint")
    found = song.line_beats(lines, beats)
    assert "Broadcast" not in final_plan(found.select("song_id", "line_no", "beats"))
    assert [r.beats for r in found.orderBy("song_id", "line_no").collect()] == [[b for b in range(0, 20_000, 500) if i * 700 <= b <= i * 700 + 600] for _ in (1, 2) for i in range(20)]
    ticks = beats.withColumnRenamed("beat_ms", "t_ms")
    kinds = {"line": (lines, "start_ms", "end_ms", ["line_no"], ["line_no"])}
    active = intervals.first_at(ticks, kinds, ["song_id"], "t_ms")
    assert "Broadcast" not in final_plan(active.where("line IS NOT NULL"))
    twice = table(spark, [(1, 100), (1, 100), (1, None), (None, 100), (1, 650)], "song_id bigint, t_ms bigint")
    got = [(r.song_id, r.t_ms, r.line and r.line.line_no) for r in intervals.first_at(twice, kinds, ["song_id"], "t_ms").collect()]
    assert sorted(got, key=str) == sorted([(1, 100, 0), (1, 100, 0), (1, None, None), (None, 100, None), (1, 650, None)], key=str)


def test_ticks_of_a_bucket_look_at_blocks_together(spark):
    """Short and long spans; what is asked of the levels above is one row per bucket and level, not per tick."""
    ticks = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 500).alias("t"))
    spans = table(spark, [(1, i * 2000, i * 2000 + 2000, i) for i in range(5000) if i % 3] + [(1, 0, 10_000_000, 9999)], "k int, a bigint, b bigint, id int")
    got = intervals.first_at(ticks, {"hit": (spans, "a", "b", ["id"], ["id"])}, ["k"], "t")
    assert got.where("hit.id = if(t div 2000 % 3 = 0, 9999, t div 2000)").count() == 20_000


def test_pairs_of_blocks_are_not_dealt(spark):
    """Blocks meet where they are read: neither a broadcast nor a shuffle of the pool for every block of prompts."""
    rng = np.random.default_rng(3)
    pool = table(spark, [(i, rng.normal(size=8).tolist()) for i in range(200)], "keyframe_id bigint, vector array<double>")
    prompts = pool.withColumnRenamed("keyframe_id", "prompt_id")
    best = ranking.rank_blocks(prompts, pool, ranking.dot_scorer, item_id="keyframe_id", k=3, prompts_per_block=16)
    bounded = ranking.rank_bounded(prompts, pool, ranking.dot_scorer, ranking.Ball(), item_id="keyframe_id", k=3, items_per_block=20, prompts_per_block=16).best
    for found in (best, bounded):
        plan = final_plan(found)
        assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert rows(best.select("prompt_id", "rank", "keyframe_id"), "prompt_id", "rank") == rows(bounded.select("prompt_id", "rank", "keyframe_id"), "prompt_id", "rank")


def test_items_alike_are_scored_a_few_times(spark):
    """Of 30,000 items with 20 different vectors between them, a scorer sees the k lowest of each; missing vectors are alike too."""
    seen = spark.sparkContext.accumulator(0)

    def scorer(prompts, items):
        seen.add(len(items))
        return ranking.dot_scorer(prompts, items)

    pool = spark.range(30_000).select((F.lit(40_000) - F.col("id")).alias("segment_id"), F.expr("if(id % 20 = 0, null, array(cast(id % 20 div 2 AS float), 1f))").alias("vector"))
    prompts = table(spark, [(1, [1.0, 0.0]), (2, [-1.0, 1.0]), (3, None)], "prompt_id bigint, vector array<float>")
    got = rows(ranking.rank_blocks(prompts, pool, scorer, item_id="segment_id", k=3).select("prompt_id", "rank", "segment_id", "score_micros"), "prompt_id", "rank")
    item = {40_000 - i: None if i % 20 == 0 else (i % 20 // 2, 1) for i in range(30_000)}
    want = []
    for p, a, b in ((1, 1, 0), (2, -1, 1), (3, 0, 0)):
        best = sorted((-1_000_000 * (a * v[0] + b * v[1]) if v else 0, i) for i, v in item.items())[:3]
        want += [(p, r, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want
    assert seen.value <= 20 * 3 * 3  # of 11 different rows, three each, once per partition of prompts
    assert rows(ranking.rank_blocks(prompts, pool, ranking.dot_scorer, item_id="segment_id", k=3).select("prompt_id", "rank", "segment_id", "score_micros"), "prompt_id", "rank") == want


def test_products_are_rescored_where_single_precision_cannot_tell(monkeypatch):
    """Scores that lie nearer than single precision resolves, ties and missing vectors; few pairs are worked out in double precision."""
    rng, whole = np.random.default_rng(6), []
    known = ranking._Held._whole
    monkeypatch.setattr(ranking._Held, "_whole", lambda self, rows, ids, scores: (whole.append(scores.size), known(self, rows, ids, scores)))
    vectors = rng.normal(size=(20_000, 16))
    vectors[5000:9000] = vectors[5000] + rng.integers(0, 40, (4000, 1)) * 1e-8  # many equal, others 1e-8 apart
    items = pd.DataFrame({"segment_id": rng.permutation(20_000), "vector": [None if i % 97 == 0 else v for i, v in enumerate(vectors)]})
    asked = np.vstack([vectors[5000] * 30, rng.normal(size=(600, 16)) * 100])
    prompts = pd.DataFrame({"prompt_id": range(601), "vector": list(asked)})
    held = ranking._Held(prompts, ranking.dot_scorer, 5, 1024)
    for first in range(0, 20_000, 7000):
        held.add(items.iloc[first : first + 7000], "segment_id")
    scores = np.rint(asked @ np.where(np.arange(20_000)[:, None] % 97 == 0, 0.0, vectors).T * 1e6).astype(np.int64)
    order = np.lexsort((np.broadcast_to(items["segment_id"], scores.shape), -scores), axis=1)[:, :5]
    assert (held.ids == items["segment_id"].to_numpy()[order]).all() and (held.top == np.take_along_axis(scores, order, axis=1)).all()
    assert sum(whole) < 0.2 * scores.size


def test_blocks_meet_by_the_page(spark):
    """Forty times 25 blocks of prompts and items are a few pairs of pages: rows copied per pair of blocks would be the most of the work."""
    rng = np.random.default_rng(5)
    pool = table(spark, [(i, rng.normal(size=4).tolist()) for i in range(500)], "keyframe_id bigint, vector array<double>")
    prompts = pool.withColumnRenamed("keyframe_id", "prompt_id")
    ranked = ranking.rank_bounded(prompts, pool, ranking.dot_scorer, ranking.Ball(), item_id="keyframe_id", k=3, items_per_block=20, prompts_per_block=16)
    assert ranked.pairs >= 25 * 32
    ranked.best.collect()
    plan, found = ranked.best._jdf.queryExecution().executedPlan(), []
    walk = [plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while walk:
        node = walk.pop()
        node = node.plan() if node.getClass().getSimpleName().endswith("QueryStageExec") else node
        if node.nodeName() == "CartesianProduct":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        walk += [children.apply(i) for i in range(children.size())]
    assert found and sum(found) <= 64
    want = ranking.rank_blocks(prompts, pool, ranking.dot_scorer, item_id="keyframe_id", k=3)
    assert rows(ranked.best.select(*want.columns), "prompt_id", "rank") == rows(want, "prompt_id", "rank")
