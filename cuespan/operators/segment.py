"""Cuts and segments of long recordings.

Tables: keyframes (video_id, keyframe_id, t_ms, motion_score, frame_path),
cues (video_id, cue_id, start_ms, end_ms, text), videos (video_id, duration_ms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions import vectors as V
from cuespan.functions.timecode import idiv, midpoint10
from cuespan.operators.intervals import CHUNK_MS, overlapping, points_in_spans
from cuespan.operators.scans import lead, numbered, running
from cuespan.operators.transitions import FAN, handed_down
from cuespan.session import cut_lineage

# Fixed values of the segmentation rule.
MOTION_CUT = 6.0
SILENCE_MS = 2500
MIN_SEGMENT_MS = 4000
MAX_SEGMENT_MS = 15_000
CHUNK_TARGET_MS = 10_000
FRAME_STEP_MS = 500
PIXEL_SCALE = 25.5


def frame_grid(frames: DataFrame, *, order: str, step_ms: int = FRAME_STEP_MS, limit: int | None = None) -> DataFrame:
    """Fixed-rate timestamps: the i-th frame of a video is at i steps; with ``limit``, only so many frames."""
    rows = numbered(frames, ["video_id"], [order], idiv(F.col(order), 65_536), "frame_no")
    rows = rows if limit is None else rows.filter(F.col("frame_no") < limit)
    return rows.withColumn("grid_ms", F.col("frame_no") * step_ms)


def motion_scores(frames: DataFrame, *, scale: float = PIXEL_SCALE) -> DataFrame:
    """Mean absolute change against the last readable frame; 0 for the first and for unreadable frames."""
    rows = running(
        frames, ["video_id"], ["t_ms", "keyframe_id"], idiv(F.col("t_ms"), CHUNK_MS),
        {"_before": ("last", F.col("vector"))}, inclusive=False,
    )
    change = V.mean_abs_diff(F.col("vector"), F.col("_before")) / F.lit(scale)
    return rows.withColumn("motion", F.coalesce(change, F.lit(0.0))).drop("_before")


def frame_changes(frames: DataFrame) -> DataFrame:
    """Mean of each frame vector and its mean absolute difference to the frame before."""
    rows = running(
        frames, ["video_id"], ["t_ms", "keyframe_id"], idiv(F.col("t_ms"), CHUNK_MS),
        {"_before": ("last", F.struct("vector"))}, inclusive=False,
    )
    return rows.select(
        "video_id", "keyframe_id", V.mean(F.col("vector")).alias("mean_value"),
        V.mean_abs_diff(F.col("vector"), F.col("_before.vector")).alias("mean_change"),
    )


def upsample_pairs(frames: DataFrame) -> DataFrame:
    """N ordered vectors become 2N-1: originals at even positions, midpoints between neighbours."""
    rows = running(
        frames, ["video_id"], ["t_ms", "keyframe_id"], idiv(F.col("t_ms"), CHUNK_MS),
        {"_i": ("sum", F.lit(1).cast("bigint")), "_before": ("last", F.struct("vector"))}, inclusive=False,
    )
    own = F.struct((F.col("_i") * 2).alias("pos"), V.as_double(F.col("vector")).alias("vector"), F.lit(False).alias("is_between"))
    between = F.struct(
        (F.col("_i") * 2 - 1).alias("pos"), V.midpoint(F.col("_before.vector"), F.col("vector")).alias("vector"),
        F.lit(True).alias("is_between"),
    )
    both = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(between, own))
    return rows.select("video_id", F.inline(both))


def motion_cuts(keyframes: DataFrame, *, threshold: float = MOTION_CUT) -> DataFrame:
    return keyframes.filter(F.col("motion_score") > threshold).select("video_id", F.col("t_ms").alias("cut_ms"))


def silence_cuts(cues: DataFrame, *, gap_ms: int = SILENCE_MS) -> DataFrame:
    """The middle of each silence longer than ``gap_ms`` between neighbouring cues.

    Of cues that start together only the last listed has a silence after it, so copies
    are reduced to one row per start before anything is put in order.
    """
    slim = cues.groupBy("video_id", "start_ms").agg(F.max_by("end_ms", "cue_id").alias("end_ms"))
    rows = lead(slim, ["video_id"], ["start_ms"], idiv(F.col("start_ms"), CHUNK_MS), ["start_ms"])
    gap = F.col("next.start_ms") - F.col("end_ms")
    return rows.filter(gap > gap_ms).select(
        "video_id", midpoint10(F.col("end_ms"), F.col("next.start_ms")).alias("cut_ms")
    )


def silence_sessions(cues: DataFrame, *, gap_ms: int = SILENCE_MS) -> DataFrame:
    """Runs of speech: a session ends when nothing is said for more than ``gap_ms``."""
    chunk = idiv(F.col("start_ms"), CHUNK_MS)
    order = ["start_ms"]
    slim = cues.groupBy("video_id", "start_ms").agg(F.max("end_ms").alias("end_ms"), F.count("*").alias("said"))
    rows = running(slim, ["video_id"], order, chunk, {"_reach": ("max", F.col("end_ms"))}, inclusive=False)
    opens = F.col("_reach").isNull() | (F.col("start_ms") - F.col("_reach") > gap_ms)
    rows = running(rows, ["video_id"], order, chunk, {"session_no": ("sum", opens.cast("bigint"))})
    return rows.groupBy("video_id", "session_no").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("said").alias("cues")
    )


def boundaries(keyframes: DataFrame, cues: DataFrame, videos: DataFrame) -> DataFrame:
    """Distinct motion cuts, silence cuts, 0 and the duration, for videos that have keyframes."""
    seen = keyframes.select("video_id").distinct()
    ends = videos.join(seen, "video_id", "left_semi").select(
        "video_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("duration_ms"))).alias("cut_ms")
    )
    heard = silence_cuts(cues).join(seen, "video_id", "left_semi")
    return motion_cuts(keyframes).unionByName(heard).unionByName(ends).distinct()


def _accepted(cuts: DataFrame, least_ms: int, chunk_ms: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Greedy choice of cuts at least ``least_ms`` apart, in parallel over time chunks.

    Only the last accepted cut matters to what follows. So each chunk first tells, for
    the cuts through which it can be entered (those in its first ``least_ms`` and the
    next one), at which cut it is left. Cuts that lead to the same end are one step, up
    to the last of them; a chunk without a step is passed over. Steps are composed over
    the tree of chunks, and each chunk replays its own cuts from its known start.
    """
    chunks = cuts.groupBy("video_id", idiv(F.col("cut_ms"), chunk_ms).alias("chunk")).agg(
        F.array_sort(F.collect_set("cut_ms")).alias("cuts")
    )
    first_ms = f"chunk * {chunk_ms}L"
    doors = f"concat(filter(cuts, c -> c < {first_ms} + {least_ms}), slice(filter(cuts, c -> c >= {first_ms} + {least_ms}), 1, 1))"
    leave = f"aggregate(cuts, e, (last, c) -> IF(c - last >= {least_ms}, c, last))"
    ends_apart = "filter({0}, (s, i) -> i + 1 = size({0}) OR {0}[i + 1].leave <> s.leave)"
    chunks = chunks.withColumn("steps", F.expr(f"transform({doors}, e -> struct(e AS upto, {leave} AS leave))"))
    # Read several times below; what went into it is every keyframe and cue.
    chunks = cut_lineage(chunks.withColumn("steps", F.expr(ends_apart.format("steps"))))

    def apply(steps: str, last: str) -> str:
        return f"coalesce(get(filter({steps}, w -> w.upto >= {last} + {least_ms}), 0).leave, {last})"

    def compose(f: str, g: str, first: str) -> str:
        # What no step of f takes goes on to g; a group cannot be entered beyond the first step that lies ``least_ms`` behind its first one.
        both = f"""concat(transform({f}, s -> struct(s.upto AS upto, {apply(g, 's.leave')} AS leave)),
            filter({g}, t -> t.upto > element_at({f}, -1).upto))"""
        entered = f"filter(x, (s, i) -> i = 0 OR x[i - 1].upto < {first}[0].upto + {least_ms})"
        return f"transform(transform(array({both}), x -> {entered}), y -> {ends_apart.format('y')})[0]"

    starts, last = handed_down(chunks, ["video_id"], "start", apply, compose, "0L", fan=fan)
    replay = f"""aggregate(
        cuts, struct(start AS last, CAST(array() AS array<struct<start_ms: bigint, end_ms: bigint>>) AS kept),
        (a, c) -> IF(c - a.last >= {least_ms},
                     struct(c AS last, concat(a.kept, array(struct(a.last AS start_ms, c AS end_ms))) AS kept), a),
        a -> a.kept)"""
    pieces = chunks.join(starts, ["video_id", "chunk"]).select("video_id", F.inline(F.expr(replay)))
    return pieces, last.withColumnRenamed("start", "last_cut_ms")


def segment_videos(
    keyframes: DataFrame,
    cues: DataFrame,
    videos: DataFrame,
    *,
    least_ms: int = MIN_SEGMENT_MS,
    most_ms: int = MAX_SEGMENT_MS,
    target_ms: int = CHUNK_TARGET_MS,
    chunk_ms: int = CHUNK_MS,
    fan: int = FAN,
) -> DataFrame:
    """Segments (video_id, start_ms, end_ms) that tile each video that has keyframes.

    Cuts are taken greedily when at least ``least_ms`` from the last one and from the
    end; a piece longer than ``most_ms`` is split evenly on the 10 ms grid.
    """
    seen = keyframes.select("video_id").distinct()
    cuts = motion_cuts(keyframes).unionByName(silence_cuts(cues))
    usable = cuts.join(videos.select("video_id", "duration_ms"), "video_id").filter(
        F.col("cut_ms").between(least_ms, F.col("duration_ms") - least_ms)
    )
    pieces, last = _accepted(usable, least_ms, chunk_ms, fan)
    length = F.col("end_ms") - F.col("start_ms")
    parts = F.when(length > most_ms, idiv(length, target_ms) + 1).otherwise(1).cast("bigint")
    pieces = pieces.withColumn("parts", parts)
    first_end = idiv(F.col("parts") * F.col("start_ms") + length + 5 * F.col("parts"), 10 * F.col("parts")) * 10
    step = idiv(length + 5 * F.col("parts"), 10 * F.col("parts")) * 10
    split = pieces.select(
        "video_id", "start_ms", "end_ms", "parts", first_end.alias("first_end"), step.alias("step"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("i"),
    )
    edge = lambda i: F.col("first_end") + (i - 1) * F.col("step")
    split = split.select(
        "video_id",
        F.when(F.col("i") == 0, F.col("start_ms")).otherwise(edge(F.col("i"))).alias("start_ms"),
        F.when(F.col("i") == F.col("parts") - 1, F.col("end_ms")).otherwise(edge(F.col("i") + 1)).alias("end_ms"),
    )
    tail = (
        videos.join(seen, "video_id", "left_semi").join(last, "video_id", "left")
        .select("video_id", F.coalesce("last_cut_ms", F.lit(0).cast("bigint")).alias("start_ms"),
                F.col("duration_ms").alias("end_ms"))
        .filter(F.col("start_ms") < F.col("end_ms"))
    )
    return split.unionByName(tail)


def segment_transcripts(segments: DataFrame, cues: DataFrame) -> DataFrame:
    """The cues said in a segment, joined in order.

    A cue belongs when it starts inside (both ends included) or spans the whole segment.
    """
    words = cues.select("video_id", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), "cue_id", "text")
    s, e = F.col("start_ms"), F.col("end_ms")
    belongs = F.col("c_start").between(s, e) | ((F.col("c_start") <= s) & (F.col("c_end") >= e))
    joined = overlapping(segments, words, ["video_id"], (s, e), (F.col("c_start"), F.col("c_end")), belongs)
    said = joined.groupBy("video_id", "start_ms", "end_ms").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(c_start, cue_id, text))), x -> x.text), ' ')").alias("said")
    )
    return segments.join(said, ["video_id", "start_ms", "end_ms"], "left").select(
        *segments.columns, F.trim(F.coalesce("said", F.lit(""))).alias("transcript")
    )


def representative_frames(segments: DataFrame, keyframes: DataFrame) -> DataFrame:
    """All frames of a segment when at most three, else the first, the middle and the last."""
    spans = segments.select("video_id", "start_ms", "end_ms")
    t = F.col("t_ms")
    inside = points_in_spans(
        keyframes.select("video_id", "t_ms", "keyframe_id", "frame_path"), spans, ["video_id"], t,
        F.col("start_ms"), F.col("end_ms"), t.between(F.col("start_ms"), F.col("end_ms")),
    )
    keys = ["video_id", "start_ms", "end_ms"]
    ranked = numbered(inside, keys, ["t_ms", "keyframe_id"], idiv(t, CHUNK_MS), "i")
    counts = inside.groupBy(*keys).agg(F.count("*").alias("n"))
    i, n = F.col("i"), F.col("n")
    picked = ranked.join(counts, keys).filter((n <= 3) | (i == 0) | (i == idiv(n, 2)) | (i == n - 1))
    shown = picked.groupBy(*keys).agg(
        F.expr("transform(array_sort(collect_list(struct(i, frame_path))), x -> x.frame_path)").alias("frame_paths")
    )
    return segments.join(shown, keys, "left").withColumn("frame_paths", F.coalesce("frame_paths", F.array().cast("array<string>")))


