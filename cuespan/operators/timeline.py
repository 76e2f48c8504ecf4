"""Timeline slots: placing, filling gaps, cutting to a range, merging, transitions, playhead.

lines: (song_id, line_no, start_ms, end_ms, text); slots: (song_id, slot_no, start_ms,
end_ms, video_id, clip_start_ms, clip_duration_ms, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.keys import quoted_url
from cuespan.functions.timecode import CLIP_MARGIN_MS, LINE_TOLERANCE_MS, idiv, midpoint10
from cuespan.operators.intervals import CHUNK_MS, answers, asof, first_at, first_of, points_in_spans
from cuespan.operators.scans import dealt, numbered, running
from cuespan.operators.transitions import FAN, handed_down
from cuespan.session import cut_lineage, work_table

# Fixed values of the timeline rules.
FALLBACK_TAIL_MS = 5000
MERGE_GAP_MS = 10
MERGE_DRIFT_MS = 50
SPLIT_LEAST_MS = 400
BREAK_GAP_MS = 1500
GAP_TRANSITION = "flash-through-white"
CHANGE_TRANSITIONS = ("whip-pan", "cross-fade")

LINE_CHUNK = 4096
#: Runs that are followed one by one.
RUN_CHUNK = 256


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _no_later_than(clip: Column, limit: Column) -> Column:
    """Keep a clip start a margin before the end of its source."""
    last = limit - CLIP_MARGIN_MS
    return F.when((limit > 0) & (clip > last), F.greatest(_zero(), last)).otherwise(clip)


def clamp_clips(slots: DataFrame, videos: DataFrame) -> DataFrame:
    """Clip starts near or past the end of a known source go back to just before its end."""
    rows = slots.join(videos.select("video_id", "duration_ms"), "video_id", "left")
    start = F.coalesce(_no_later_than(F.col("clip_start_ms"), F.col("duration_ms")), F.col("clip_start_ms"))
    return rows.withColumn("clip_start_ms", start).select(*slots.columns)


def duration_lookup(asked: DataFrame, videos: DataFrame) -> DataFrame:
    """Duration by original or proxy path, a path as given before its ``absolute_path``."""
    known = videos.select("duration_ms", F.explode(F.array_distinct(F.array("original_path", "proxy_path"))).alias("known_path"))
    known = known.groupBy("known_path").agg(F.max("duration_ms").alias("duration_ms"))
    tries = asked.select(
        "video_path", F.posexplode(F.array_distinct(F.array("video_path", "absolute_path"))).alias("try", "known_path")
    ).distinct()
    found = tries.join(known, "known_path").groupBy("video_path").agg(F.min_by("duration_ms", "try").alias("duration_ms"))
    return asked.join(found.filter("duration_ms > 0"), "video_path", "left")


def _slots_on_lines(slots: DataFrame, lines: DataFrame) -> DataFrame:
    """All (slot, line) pairs where the slot starts on the line, with the tolerance at both ends."""
    spans = lines.select("song_id", "line_no", F.col("start_ms").alias("line_start_ms"), F.col("end_ms").alias("line_end_ms"))
    t = F.col("start_ms")
    low, high = F.col("line_start_ms") - LINE_TOLERANCE_MS, F.col("line_end_ms") - LINE_TOLERANCE_MS
    return points_in_spans(slots, spans, ["song_id"], t, low, high, (t >= low) & (t < high))


def slots_to_lines(slots: DataFrame, lines: DataFrame) -> DataFrame:
    """Each slot as a child of the first line it starts on, with its offsets cut to that line."""
    pairs = _slots_on_lines(slots, lines)
    first = pairs.groupBy("song_id", "slot_no").agg(
        F.min_by(F.struct("line_no", "line_start_ms", "line_end_ms"), "line_no").alias("line")
    )
    rows = slots.join(dealt(first), ["song_id", "slot_no"]).select(
        *slots.columns, "line.line_no",
        F.greatest(_zero(), F.col("start_ms") - F.col("line.line_start_ms")).alias("offset_start_ms"),
        F.least(F.col("line.line_end_ms") - F.col("line.line_start_ms"), F.col("end_ms") - F.col("line.line_start_ms")).alias("offset_end_ms"),
    )
    return numbered(rows, ["song_id", "line_no"], ["offset_start_ms", "slot_no"], idiv(F.col("offset_start_ms"), CHUNK_MS), "child_no")


def inherit_slots(slots: DataFrame, lines: DataFrame, videos: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Slots for rendering: those on each line, and for empty lines the last one before, played on.

    A line before every slot takes the song's first slot. Slots on no line are dropped; a
    song without lines keeps its slots. ``carried`` columns are copied along.
    """
    fields = ["slot_no", "start_ms", "end_ms", "video_id", "clip_start_ms", "clip_duration_ms", *carried]
    out = ["song_id", "line_no", *fields, "transition", "inherited"]
    on_line = _slots_on_lines(slots, lines)
    placed = on_line.withColumn("inherited", F.lit(False)).select(*out)
    empty = lines.join(on_line.select("song_id", "line_no").distinct(), ["song_id", "line_no"], "left_anti")
    asked = empty.select(
        "song_id", "line_no", F.col("start_ms").alias("line_start_ms"), F.col("end_ms").alias("line_end_ms"),
        (F.col("start_ms") - LINE_TOLERANCE_MS).alias("before_ms"),
    )
    last = asof(asked, slots, ["song_id"], "before_ms", "start_ms", fields, tie=-F.col("slot_no"), name="base", strict=True)
    first = slots.groupBy("song_id").agg(F.min_by(F.struct("start_ms", *[c for c in fields if c != "start_ms"]), F.struct("start_ms", "slot_no")).alias("opening"))
    base = F.coalesce("base", "opening")
    filled = last.join(first, "song_id").select("song_id", "line_no", "line_start_ms", "line_end_ms", base.alias("base"))
    filled = filled.withColumn("video_id", F.col("base.video_id")).join(videos.select("video_id", "duration_ms"), "video_id", "left")
    clip = F.col("base.clip_start_ms") + F.col("line_start_ms") - F.col("base.start_ms")
    clip = F.greatest(_zero(), F.coalesce(_no_later_than(clip, F.col("duration_ms")), clip))
    played = filled.select(
        "song_id", "line_no", "base.slot_no", F.col("line_start_ms").alias("start_ms"), F.col("line_end_ms").alias("end_ms"),
        "video_id", clip.alias("clip_start_ms"),
        F.greatest(_zero(), F.col("line_end_ms") - F.col("line_start_ms")).alias("clip_duration_ms"),
        *[F.col(f"base.{c}").alias(c) for c in carried], F.lit(None).cast("string").alias("transition"), F.lit(True).alias("inherited"),
    )
    unlined = slots.join(lines.select("song_id").distinct(), "song_id", "left_anti")
    unlined = unlined.withColumn("line_no", F.lit(None).cast("bigint")).withColumn("inherited", F.lit(False)).select(*out)
    return placed.unionByName(played).unionByName(unlined)


def effective_slots(lines: DataFrame, slots: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """What the editor shows per line: its own slot, else the nearest earlier line's slot played on.

    Before the first filled line, that line's slot is shown from its own clip start.
    Slots are keyed by line (``slot_no`` is the line) and may know ``video_duration_ms``.
    """
    own = slots.select(
        "song_id", F.col("slot_no").alias("line_no"),
        F.struct("video_id", "clip_start_ms", "clip_duration_ms", "video_duration_ms", *carried).alias("own"),
    )
    rows = lines.select("song_id", "line_no", "start_ms", "end_ms").join(dealt(own), ["song_id", "line_no"], "left")
    filled = F.when(F.col("own").isNotNull(), F.struct("line_no", "start_ms", "own"))
    first = rows.filter(F.col("own").isNotNull()).groupBy("song_id").agg(
        F.min_by(F.struct("line_no", "start_ms", "own"), "line_no").alias("first")
    )
    rows = running(rows, ["song_id"], ["line_no"], idiv(F.col("line_no"), LINE_CHUNK), {"before": ("last", filled)})
    rows = rows.join(dealt(first), "song_id")
    base = F.coalesce("before", "first")
    rows = rows.withColumn("base", base)
    limit = F.coalesce(
        F.when(F.col("base.own.video_duration_ms") > 0, F.col("base.own.video_duration_ms")),
        F.col("base.own.clip_duration_ms") + FALLBACK_TAIL_MS,
    )
    moved = F.col("base.own.clip_start_ms") + F.col("start_ms") - F.col("base.start_ms")
    moved = F.when(moved > limit - CLIP_MARGIN_MS, F.greatest(_zero(), limit - CLIP_MARGIN_MS)).otherwise(moved)
    is_own, earlier = F.col("own").isNotNull(), F.col("before").isNotNull()
    return rows.select(
        "song_id", "line_no", "start_ms", "end_ms", F.col("base.own.video_id").alias("video_id"),
        F.when(is_own, F.col("own.clip_start_ms")).when(earlier, moved).otherwise(F.col("first.own.clip_start_ms")).alias("clip_start_ms"),
        F.when(is_own, F.col("own.clip_duration_ms")).otherwise(F.col("end_ms") - F.col("start_ms")).alias("clip_duration_ms"),
        (~is_own).alias("is_fallback"), F.when(~is_own, F.col("base.line_no")).alias("fallback_from"),
        *[F.col(f"base.own.{c}").alias(c) for c in carried],
    )


def song_ranges(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Usable range per song: missing bounds mean all, cut to [0, end of the last slot]; empty ranges are left out."""
    ends = slots.groupBy("song_id").agg(F.max_by("end_ms", "slot_no").alias("total_ms"))
    start = F.greatest(_zero(), F.coalesce("wanted_start_ms", _zero()))
    given = F.when(F.col("wanted_end_ms") > 0, F.col("wanted_end_ms"))
    end = F.least(F.col("total_ms"), F.coalesce(given, F.col("total_ms")))
    asked = wanted.filter(F.col("wanted_start_ms").isNotNull() | F.col("wanted_end_ms").isNotNull())
    rows = asked.join(ends, "song_id").select("song_id", start.alias("range_start_ms"), end.alias("range_end_ms"))
    return rows.filter(F.col("range_end_ms") > F.col("range_start_ms"))


def cut_to_range(rows: DataFrame, ranges: DataFrame, *, has_clip: bool, times: Sequence[str] = ()) -> DataFrame:
    """Cut timed rows to their song's range and count from its start; songs without a range stay.

    With ``has_clip`` the clip start moves along and the clip length follows; array
    columns in ``times`` (beats) are shifted and cut too.
    """
    s, e = F.col("range_start_ms"), F.col("range_end_ms")
    joined = rows.join(ranges, "song_id", "left").filter(s.isNull() | ((F.col("end_ms") > s) & (F.col("start_ms") < e)))
    start = F.greatest(_zero(), F.col("start_ms") - s)
    end = F.least(e - s, F.col("end_ms") - s)
    new = {"start_ms": start, "end_ms": end}
    if has_clip:
        new["clip_start_ms"] = F.col("clip_start_ms") + F.greatest(_zero(), s - F.col("start_ms"))
        new["clip_duration_ms"] = end - start
    for name in times:
        new[name] = F.transform(F.filter(F.col(name), lambda t: (t >= s) & (t <= e)), lambda t: t - s)
    return joined.select(*[
        F.when(s.isNull(), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in rows.columns
    ])


def auto_transitions(segments: DataFrame) -> DataFrame:
    """Transition per segment in time order: none within a video, a flash after a gap, else alternating.

    The first segment keeps its own; so does a song of one segment.
    """
    order = ["start_ms", "slot_no"]
    chunk = idiv(F.col("start_ms"), CHUNK_MS)
    rows = running(segments, ["song_id"], order, chunk, {"_prev": ("last", F.struct("video_id", "end_ms"))}, inclusive=False)
    changed = F.coalesce(F.col("video_id") != F.col("_prev.video_id"), F.lit(False))
    rows = running(rows.withColumn("_changed", changed), ["song_id"], order, chunk,
                   {"_changes": ("sum", F.col("_changed").cast("bigint"))}, inclusive=False)
    picked = (
        F.when(F.col("_prev").isNull(), F.col("transition"))
        .when(~F.col("_changed"), "none")
        .when(F.col("start_ms") - F.col("_prev.end_ms") > BREAK_GAP_MS, GAP_TRANSITION)
        .when(F.col("_changes") % 2 == 0, CHANGE_TRANSITIONS[0])
        .otherwise(CHANGE_TRANSITIONS[1])
    )
    return rows.withColumn("transition", picked).select(*segments.columns)


def _heads(runs: DataFrame, fan: int) -> DataFrame:
    """song_id, _run and ``head``, the slot that begins the run's group.

    A group's D is that of its head, so D and slot of the last head are all that a chunk of runs must know of what lies before it.
    It can begin a group at a run that opens a stretch, or at one whose D is the highest or lowest so far: these are its steps,
    each with the head that is left in the end. As D moves by less than twice the tolerance within a stretch, steps behind four
    tolerances from the first D are never first, which bounds their number.
    """
    far = 4 * MERGE_DRIFT_MS
    apart = "(r.opens OR {0}.d IS NULL OR abs(r._d - {0}.d) >= " + str(MERGE_DRIFT_MS) + ")"
    chunks = runs.groupBy("song_id", idiv(F.col("_run"), RUN_CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_run", "_d", "head", "opens"))).alias("runs"))
    follow = f"""aggregate(slice(runs, i + 1, size(runs)), struct(CAST(NULL AS bigint) AS d, 0L AS head),
        (a, r) -> IF({apart.format('a')}, struct(r._d AS d, r.head AS head), a))"""
    steps = f"""aggregate(
        transform(runs, (r, i) -> struct(r._d AS d, r.opens AS opens, i AS i)),
        struct(CAST(NULL AS bigint) AS low, CAST(NULL AS bigint) AS high, false AS done, CAST(array() AS array<struct<d: bigint, opens: boolean, i: int>>) AS found),
        (a, r) -> struct(least(a.low, r.d) AS low, greatest(a.high, r.d) AS high, a.done OR r.opens OR abs(r.d - runs[0]._d) >= {far} AS done,
            IF(NOT a.done AND (a.low IS NULL OR r.opens OR r.d < a.low OR r.d > a.high), concat(a.found, array(r)), a.found) AS found),
        a -> a.found)"""
    chunks = chunks.withColumn("found", F.expr(steps)).selectExpr("song_id", "chunk", "runs", f"transform(found, x -> struct(x.d AS d, x.opens AS opens, transform(array(x.i), i -> {follow})[0] AS leave)) AS steps")
    chunks = cut_lineage(chunks)

    def apply(steps: str, state: str) -> str:
        return f"coalesce(get(filter({steps}, w -> w.opens OR {state}.d IS NULL OR abs(w.d - {state}.d) >= {MERGE_DRIFT_MS}), 0).leave, {state})"

    def compose(f: str, g: str, first: str) -> str:
        values = f"transform({f}, s -> s.d)"
        passed = f"IF(element_at({f}, -1).opens, slice({g}, 1, 0), filter({g}, t -> t.opens OR t.d < array_min({values}) OR t.d > array_max({values})))"
        both = f"concat(transform({f}, s -> struct(s.d AS d, s.opens AS opens, {apply(g, 's.leave')} AS leave)), {passed})"
        return f"transform(array({both}), x -> filter(x, (s, i) -> NOT exists(slice(x, 1, i), e -> e.opens OR abs(e.d - {first}[0].d) >= {far})))[0]"

    starts, _ = handed_down(chunks, ["song_id"], "state", apply, compose, "struct(CAST(NULL AS bigint) AS d, 0L AS head)", fan=fan)
    replay = f"""aggregate(runs, struct(state AS last, CAST(array() AS array<struct<_run: bigint, head: bigint>>) AS heads),
        (a, r) -> transform(array(IF({apart.format('a.last')}, struct(r._d AS d, r.head AS head), a.last)),
            h -> struct(h AS last, concat(a.heads, array(struct(r._run AS _run, h.head AS head))) AS heads))[0],
        a -> a.heads)"""
    return chunks.join(starts, ["song_id", "chunk"]).select("song_id", F.inline(F.expr(replay)))


def merge_slots(slots: DataFrame, same: Sequence[str], fan: int = FAN) -> DataFrame:
    """Join neighbouring slots that show one unbroken stretch of one source.

    ``same`` are the columns that must agree. What a slot would have to continue is the
    merged clip so far, so drift adds up: with D = clip start minus the clip time played
    before it, a slot joins while D stays within the tolerance of the D of the group's
    head. A step of twice the tolerance always breaks and equal D always joins. Breaks are
    found by scans, equal runs are pre-aggregated, and what runs with small drift join is
    handed down a tree of chunks, so a stretch may be of any length.
    """
    order = ["slot_no"]
    chunk = idiv(F.col("slot_no"), LINE_CHUNK)
    keys = [c for c in dict.fromkeys(["video_id", *same])]
    rows = running(slots, ["song_id"], order, chunk, {
        "_prev": ("last", F.struct("end_ms", "clip_start_ms", "clip_duration_ms", *keys)), "_played": ("sum", F.col("clip_duration_ms")),
    }, inclusive=False)
    rows = rows.withColumn("_d", F.col("clip_start_ms") - F.col("_played"))
    rows = rows.withColumn("_last_d", F.col("_prev.clip_start_ms") - (F.col("_played") - F.col("_prev.clip_duration_ms")))
    joins = (F.abs(F.col("_prev.end_ms") - F.col("start_ms")) < MERGE_GAP_MS) & (
        F.lower(F.coalesce("transition", F.lit("none"))) == "none"
    )
    for c in keys:
        joins = joins & F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    rows = rows.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    step = F.abs(F.col("_d") - F.col("_last_d"))
    island = (~F.col("_joins") | (step >= 2 * MERGE_DRIFT_MS)).cast("bigint")
    run = (~F.col("_joins") | (F.col("_d") != F.col("_last_d"))).cast("bigint")
    # Read several times below, behind two scans of the slots.
    rows = work_table(rows.withColumn("_opens", island).withColumn("_breaks", run))
    rows = running(rows, ["song_id"], order, chunk, {"_run": ("sum", F.col("_breaks"))})
    runs = rows.groupBy("song_id", "_run", F.col("_d")).agg(F.min("slot_no").alias("head"), (F.max("_opens") > 0).alias("opens"))
    heads = _heads(runs, fan)
    grouped = rows.join(heads, ["song_id", "_run"]).groupBy("song_id", "head").agg(
        F.max_by("end_ms", "slot_no").alias("_end"), F.sum("clip_duration_ms").alias("_length"), F.count("*").alias("merged")
    )
    joined = slots.join(grouped.withColumnRenamed("head", "slot_no"), ["song_id", "slot_no"])
    return joined.withColumn("end_ms", F.col("_end")).withColumn("clip_duration_ms", F.col("_length")).select(*slots.columns, "merged")


def normalize_children(children: DataFrame) -> DataFrame:
    """Order the children of a slot by start and renumber them; missing offsets mean the whole line.

    children: (song_id, slot_no, child_no, offset_start_ms?, offset_end_ms?, line_ms, ...).
    """
    rows = children.withColumn("offset_start_ms", F.coalesce("offset_start_ms", _zero())).withColumn(
        "offset_end_ms", F.coalesce("offset_end_ms", "line_ms")
    )
    length = F.greatest(_zero(), F.col("offset_end_ms") - F.col("offset_start_ms"))
    rows = rows.withColumn("clip_duration_ms", length).withColumn("_from", F.col("child_no"))
    shift = F.floor(F.col("offset_start_ms") / F.lit(CHUNK_MS)).cast("bigint")
    rows = numbered(rows.drop("child_no"), ["song_id", "slot_no"], ["offset_start_ms", "_from"], shift, "child_no")
    return rows.drop("_from")


def split_children(children: DataFrame) -> DataFrame:
    """Split children of at least 0.4 s in the middle; the right half's clip starts later."""
    start, end = F.col("offset_start_ms"), F.col("offset_end_ms")
    middle = midpoint10(start, end)
    half = lambda a, b: F.struct(
        a.alias("offset_start_ms"), b.alias("offset_end_ms"), (F.col("clip_start_ms") + a - start).alias("clip_start_ms"),
        (b - a).alias("clip_duration_ms"),
    )
    parts = F.when(end - start >= SPLIT_LEAST_MS, F.array(half(start, middle), half(middle, end))).otherwise(F.array(half(start, end)))
    changed = ("offset_start_ms", "offset_end_ms", "clip_start_ms", "clip_duration_ms")
    rest = [c for c in children.columns if c not in changed]
    return children.select(*rest, F.posexplode(parts).alias("half_no", "_part")).select(*rest, "half_no", "_part.*")


def edit_offsets(edits: DataFrame) -> DataFrame:
    """Apply edits of one offset: the value stays on the line and a margin away from the other end."""
    value = F.greatest(_zero(), F.least(F.col("line_ms"), F.col("value_ms")))
    start, end = F.col("offset_start_ms"), F.col("offset_end_ms")
    is_start = F.col("field") == "offset_start"
    new_start = F.when(is_start & value.isNotNull(), F.least(value, end - CLIP_MARGIN_MS)).otherwise(start)
    new_end = F.when(~is_start & value.isNotNull(), F.greatest(value, start + CLIP_MARGIN_MS)).otherwise(end)
    rows = edits.withColumn("_s", F.when(F.col("value_ms").isNull(), start).otherwise(new_start))
    rows = rows.withColumn("_e", F.when(F.col("value_ms").isNull(), end).otherwise(new_end))
    return rows.withColumn("offset_start_ms", F.col("_s")).withColumn("offset_end_ms", F.col("_e")).withColumn(
        "clip_duration_ms", F.col("_e") - F.col("_s")
    ).drop("_s", "_e")


def slots_payload(lines: DataFrame, children: DataFrame, slots: DataFrame) -> DataFrame:
    """Everything shown, in absolute song time: the children of filled lines, the fallback of empty ones."""
    starts = lines.select("song_id", F.col("line_no").alias("slot_no"), F.col("start_ms").alias("line_start_ms"))
    own = children.filter(F.col("video_id").isNotNull()).join(starts, ["song_id", "slot_no"]).select(
        "song_id", F.col("slot_no").alias("line_no"), F.col("child_no").cast("bigint").alias("child_no"),
        (F.col("line_start_ms") + F.col("offset_start_ms")).alias("start_ms"),
        (F.col("line_start_ms") + F.col("offset_end_ms")).alias("end_ms"), "video_id", "clip_start_ms",
        (F.col("offset_end_ms") - F.col("offset_start_ms")).alias("clip_duration_ms"),
    )
    shown = effective_slots(lines, slots).filter("is_fallback").select(
        "song_id", "line_no", _zero().alias("child_no"), "start_ms", "end_ms", "video_id", "clip_start_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("clip_duration_ms"),
    )
    return own.unionByName(shown)


ACTIVE = ("line", "sung", "slot", "clip")


def active_answers(lines: DataFrame, slots: DataFrame, clips: DataFrame) -> DataFrame:
    """What :func:`active_at` looks ticks up in."""
    times = ("start_ms", "end_ms")
    kinds = {
        "line": (lines, *times, ["line_no"], ["line_no"]), "sung": (lines.filter(~F.col("is_intro")), *times, ["line_no"], ["text"]),
        "slot": (slots, *times, ["slot_no"], ["slot_no", "keep_audio", "transcript"]), "clip": (clips, *times, ["start_ms", "clip_no"], ["clip_no", "transcript"]),
    }
    return answers({name: kinds[name] for name in ACTIVE}, ["song_id"])


def active_at(ticks: DataFrame, lines: DataFrame, slots: DataFrame, clips: DataFrame) -> DataFrame:
    """Line, slot and dialogue at each tick. The intro shows no lyric; a dialogue clip beats the slot's own."""
    return active_among(ticks, work_table(active_answers(lines, slots, clips)))


def active_among(ticks: DataFrame, spans: DataFrame) -> DataFrame:
    """:func:`active_at` with the answers at hand."""
    rows = first_of(ticks, spans, ACTIVE, ["song_id"], "t_ms")
    linked = F.when(F.col("slot.keep_audio") & (F.col("slot.transcript") != ""), F.col("slot.transcript"))
    return rows.select(
        "song_id", "t_ms", F.col("line.line_no").alias("line_no"),
        F.coalesce("sung.text", F.lit("")).alias("lyric"),
        F.col("slot.slot_no").alias("slot_no"),
        F.coalesce(F.when(F.col("clip").isNotNull(), F.col("clip.transcript")).otherwise(linked), F.lit("")).alias("dialogue"),
    )


def look_ahead(ticks: DataFrame, lines: DataFrame, effective: DataFrame) -> DataFrame:
    """The next line's clip at each tick, where it shows another video than the current line."""
    # Clips are put to the lines, which are fewer than the ticks: each line has its own clip and that of the line after it.
    shown = work_table(effective.select("song_id", "line_no", F.struct("video_id", "clip_start_ms").alias("_now")))
    after = shown.select("song_id", (F.col("line_no") - 1).alias("line_no"), F.col("_now").alias("_next"))
    known = lines.select("song_id", "line_no", "start_ms", "end_ms").join(dealt(shown), ["song_id", "line_no"], "left")
    known = work_table(known.join(dealt(after), ["song_id", "line_no"], "left"))
    fields = ["line_no", "_now", "_next"]
    rows = work_table(first_at(ticks.select("song_id", "t_ms"), {"line": (known, "start_ms", "end_ms", ["line_no"], fields)}, ["song_id"], "t_ms"))
    on_line = rows.where("line IS NOT NULL").select("song_id", "t_ms", (F.col("line.line_no") + 1).alias("next_line"), F.col("line._next").alias("_clip"), F.col("line._now").alias("_now"))
    between = rows.where("line IS NULL").select("song_id", "t_ms")
    between = asof(between, known, ["song_id"], "t_ms", "start_ms", fields, tie=F.col("line_no"), name="later", forward=True, strict=True)
    between = between.select("song_id", "t_ms", F.col("later.line_no").alias("next_line"), F.col("later._now").alias("_clip"), F.lit(None).cast(known.schema["_now"].dataType).alias("_now"))
    rows = on_line.unionByName(between).where("_clip IS NOT NULL")
    return rows.filter(~F.col("_clip.video_id").eqNullSafe(F.col("_now.video_id"))).select(
        "song_id", "t_ms", "next_line", F.col("_clip.video_id").alias("next_video_id"), F.col("_clip.clip_start_ms").alias("next_clip_start_ms")
    )


def overlapping_candidates(candidates: DataFrame, lines: DataFrame, effective: DataFrame) -> DataFrame:
    """Flag candidates whose clip is already shown, in part, on another line of the song.

    candidates: (song_id, line_no, rank, video_id, t_ms). No clip is paired with another: those that meet [c0, c1) are those that
    begin before c1 less those that end by c0, from counts per time that are summed up along each video; the line's own is taken off.
    A candidate without length meets only clips that have one. Lengths are not negative, and a line shows one clip.
    """
    key = ["song_id", "video_id"]
    length = (F.col("end_ms") - F.col("start_ms")).alias("_length")
    # Both sides are read more than once, and stand at the end of longer plans.
    shown = work_table(effective.select(*key, "line_no", F.col("clip_start_ms").alias("_s0"), (F.col("clip_start_ms") + F.col("clip_duration_ms")).alias("_s1")))
    own = shown.select("song_id", "line_no", F.col("video_id").alias("_own"), "_s0", "_s1")
    asked = candidates.select("song_id", "line_no", "rank", "video_id", "t_ms").join(lines.select("song_id", "line_no", length), ["song_id", "line_no"])
    asked = asked.join(own, ["song_id", "line_no"], "left").withColumn("_c0", F.greatest(_zero(), F.col("t_ms"))).withColumn("_c1", F.col("_c0") + F.col("_length"))
    meets_own = (F.col("video_id") == F.col("_own")) & (F.col("_c0") < F.col("_s1")) & (F.col("_s0") < F.col("_c1"))
    asked = work_table(asked.select(*key, "line_no", "rank", "_c0", "_c1", F.coalesce(meets_own.cast("bigint"), _zero()).alias("_mine")))
    none, one, long = _zero(), F.lit(1).cast("bigint"), (F.col("_s0") < F.col("_s1")).cast("bigint")
    marks = shown.where(F.col("_s0").isNotNull() & F.col("_s1").isNotNull()).select(*key, F.inline(F.array(
        F.struct(F.col("_s0").alias("t"), one.alias("begin"), long.alias("begin_long"), none.alias("end"), none.alias("end_long")),
        F.struct(F.col("_s1").alias("t"), none.alias("begin"), none.alias("begin_long"), one.alias("end"), long.alias("end_long")),
    )))
    marks = marks.unionByName(asked.select(*key, F.explode(F.array("_c0", "_c1")).alias("t")).where("t IS NOT NULL").distinct(), allowMissingColumns=True)
    sums = ["begin", "begin_long", "end", "end_long"]
    times = marks.groupBy(*key, "t").agg(*(F.coalesce(F.sum(c), none).alias(c) for c in sums))
    counted = running(times, key, ["t"], idiv(F.col("t"), CHUNK_MS), {f"_{c}": ("sum", F.col(c)) for c in sums})
    empty = F.col("_c0") == F.col("_c1")
    before = F.when(empty, F.col("_begin_long") - F.col("begin_long")).otherwise(F.col("_begin") - F.col("begin"))
    over = F.when(empty, F.col("_end_long")).otherwise(F.col("_end"))
    looks = asked.withColumn("_ask", F.explode(F.array(F.struct(F.col("_c1").alias("t"), F.lit(True).alias("is_end")), F.struct(F.col("_c0").alias("t"), F.lit(False).alias("is_end")))))
    looks = looks.select("*", "_ask.*").join(counted, [*key, "t"])
    met = F.sum(F.when(F.col("is_end"), before).otherwise(-over - F.col("_mine")))
    taken = looks.groupBy("song_id", "line_no", "rank", "video_id", "_c0").agg((met > 0).alias("overlaps"))
    taken = taken.groupBy("song_id", "line_no", "rank").agg(F.max("overlaps").alias("overlaps"))
    return candidates.join(taken, ["song_id", "line_no", "rank"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def restore_slots(slots: DataFrame, videos: DataFrame) -> DataFrame:
    """Saved slots against today's library by path; an unknown source is taken to last 5 s past its clip."""
    known = videos.select(F.col("original_path").alias("video_path"), F.col("duration_ms").alias("_known"), "proxy_url")
    rows = slots.join(known, "video_path", "left")
    own_url = F.concat(F.lit("/api/video_file?path="), F.replace(quoted_url(F.col("video_path")), F.lit("/"), F.lit("%2F")))
    return rows.select(
        *slots.columns, F.coalesce("_known", F.col("clip_duration_ms") + FALLBACK_TAIL_MS).alias("video_duration_ms"),
        F.coalesce("proxy_url", own_url).alias("proxy_url"),
    )


def fill_stats(lines: DataFrame, slots: DataFrame) -> DataFrame:
    """Filled and total lines per song."""
    filled = slots.select("song_id", F.col("slot_no").alias("line_no"), F.lit(1).alias("_filled")).distinct()
    rows = lines.select("song_id", "line_no").join(filled, ["song_id", "line_no"], "left")
    return rows.groupBy("song_id").agg(F.count("_filled").alias("filled"), F.count("*").alias("total"))
