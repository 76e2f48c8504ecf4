"""Songs, slots, dialogue, the playhead and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuespan.functions.timecode import idiv, seconds_to_ms
from cuespan.operators import assign as AS
from cuespan.operators import dialogue as DG
from cuespan.operators import edl as E
from cuespan.operators import song as SO
from cuespan.operators import timeline as TL
from cuespan.operators.scans import numbered
from cuespan.plans import fixtures as X
from cuespan.plans.fixtures_sql import with_tables
from cuespan.plans.registry import query
from cuespan.session import checkpoint_dir
from cuespan.sources import render_plan as RP

STEPS = {
    "ranged": "SELECT song_id, duration_ms // 4 AS s, duration_ms // 4 + duration_ms // 2 AS e FROM song",
    "on_line": """
        SELECT s.*, l.line_no, l.start_ms AS line_start, l.end_ms AS line_end
        FROM slot s JOIN lyr l ON l.song_id = s.song_id AND s.start_ms >= l.start_ms - 10 AND s.start_ms < l.end_ms - 10""",
    "child": """
        SELECT *, row_number() OVER (PARTITION BY song_id, line_no ORDER BY offset_start_ms, slot_no) - 1 AS child_no
        FROM (SELECT * EXCLUDE (line_start, line_end), greatest(0, start_ms - line_start) AS offset_start_ms,
                     least(line_end - line_start, end_ms - line_start) AS offset_end_ms
              FROM (SELECT *, row_number() OVER (PARTITION BY song_id, slot_no ORDER BY line_no) AS i FROM on_line) WHERE i = 1)""",
    "slot_pick": "SELECT song_id, slot_no, start_ms, video_id, clip_start_ms, keep_audio FROM slot",
    "empty_line": """
        SELECT l.* FROM lyr l WHERE NOT EXISTS (SELECT 1 FROM on_line o WHERE o.song_id = l.song_id AND o.line_no = l.line_no)""",
    "line_base": """
        SELECT l.song_id, l.line_no, l.start_ms AS ls, l.end_ms AS le,
               coalesce((SELECT max([s.start_ms, s.slot_no]) FROM slot s WHERE s.song_id = l.song_id AND s.start_ms < l.start_ms - 10),
                        (SELECT min([s.start_ms, s.slot_no]) FROM slot s WHERE s.song_id = l.song_id))[2] AS slot_no
        FROM empty_line l""",
    "played": """
        SELECT b.song_id, b.line_no, s.slot_no, ls AS start_ms, le AS end_ms, s.video_id, s.clip_start_ms + ls - s.start_ms AS clip, s.keep_audio, v.duration_ms AS dur
        FROM line_base b JOIN slot s ON s.song_id = b.song_id AND s.slot_no = b.slot_no LEFT JOIN vid v ON v.video_id = s.video_id""",
    "shown_base": """
        SELECT l.song_id, l.line_no, l.start_ms, l.end_ms,
               last_value(CASE WHEN k.slot_no IS NOT NULL THEN l.line_no END IGNORE NULLS) OVER (PARTITION BY l.song_id ORDER BY l.line_no) AS back,
               min(k.slot_no) OVER (PARTITION BY l.song_id) AS first_no, k.slot_no AS own
        FROM lyr l LEFT JOIN slot k ON k.song_id = l.song_id AND k.slot_no = l.line_no""",
    "effective": """
        SELECT b.song_id, b.line_no, b.start_ms, b.end_ms, k.video_id,
               CASE WHEN own IS NOT NULL OR back IS NULL THEN k.clip_start_ms
                    WHEN k.clip_start_ms + b.start_ms - k.start_ms > lim - 100 THEN greatest(0, lim - 100)
                    ELSE k.clip_start_ms + b.start_ms - k.start_ms END AS clip_start_ms,
               CASE WHEN own IS NOT NULL THEN k.clip_duration_ms ELSE b.end_ms - b.start_ms END AS clip_duration_ms,
               own IS NULL AS is_fallback, CASE WHEN own IS NULL THEN k.slot_no END AS fallback_from
        FROM shown_base b JOIN (SELECT *, coalesce(nullif(video_duration_ms, 0), clip_duration_ms + 5000) AS lim FROM known_slot) k
          ON k.song_id = b.song_id AND k.slot_no = coalesce(own, back, first_no)""",
    "tick_line": """
        SELECT b.song_id, b.beat_ms AS t_ms, min(l.line_no) AS line_no, min(l.line_no) FILTER (NOT l.is_intro) AS sung_no
        FROM beat b LEFT JOIN intro_line l ON l.song_id = b.song_id AND b.beat_ms >= l.start_ms AND b.beat_ms < l.end_ms GROUP BY ALL""",
    "intro_line": """
        SELECT song_id, line_no, start_ms, end_ms, text, false AS is_intro FROM lyr
        UNION ALL SELECT song_id, -1, 0, min(start_ms), '前奏 / Intro', true FROM lyr GROUP BY song_id HAVING min(start_ms) > 50""",
    "walk": """
        SELECT song_id, start_ms, slot_no, end_ms, clip_start_ms, clip_duration_ms, video_id, keep_audio, transcript, speaker, transition, dialogue_independent,
               row_number() OVER (PARTITION BY song_id ORDER BY slot_no) AS i FROM slot""",
    "merging": """
        SELECT song_id, i, slot_no AS head, slot_no AS last_slot, end_ms, clip_start_ms, clip_duration_ms, video_id, keep_audio, transcript, speaker, dialogue_independent
        FROM walk WHERE i = 1
        UNION ALL
        SELECT w.song_id, w.i, CASE WHEN j.ok THEN m.head ELSE w.slot_no END, w.slot_no, w.end_ms,
               CASE WHEN j.ok THEN m.clip_start_ms ELSE w.clip_start_ms END,
               CASE WHEN j.ok THEN m.clip_duration_ms + w.clip_duration_ms ELSE w.clip_duration_ms END,
               w.video_id, w.keep_audio, w.transcript, w.speaker, w.dialogue_independent
        FROM merging m JOIN walk w ON w.song_id = m.song_id AND w.i = m.i + 1,
             LATERAL (SELECT w.video_id = m.video_id AND abs(m.end_ms - w.start_ms) < 10 AND abs(m.clip_start_ms + m.clip_duration_ms - w.clip_start_ms) < 50
                             AND w.keep_audio = m.keep_audio AND w.transcript = m.transcript AND w.speaker = m.speaker
                             AND w.dialogue_independent = m.dialogue_independent AND w.transition = 'none' AS ok) j""",
    "timed_child": """
        SELECT c.song_id, c.line_no, c.child_no, l.start_ms AS ls, l.end_ms AS le, d.duration_ms AS song, c.video_path, c.transcript, c.speaker,
               c.offset_start_ms AS o, c.offset_end_ms AS oe, c.clip_start_ms, c.clip_duration_ms, v.duration_ms AS vd,
               CASE WHEN c.slot_no % 3 = 0 THEN NULL ELSE c.start_ms - 1500 + 1000 * (c.slot_no % 5) END AS ds,
               CASE WHEN c.slot_no % 4 = 0 THEN NULL ELSE c.end_ms + 2500 END AS de,
               CASE WHEN c.slot_no % 2 = 0 THEN NULL ELSE c.clip_start_ms - 500 END AS dc, c.dialogue_independent OR c.speaker = 'user' AS independent
        FROM child c JOIN lyr l ON l.song_id = c.song_id AND l.line_no = c.line_no JOIN song d ON d.song_id = c.song_id
        LEFT JOIN vid v ON v.video_id = c.video_id""",
    "timing1": """
        SELECT *, greatest(100, coalesce(clip_duration_ms, coalesce(oe, le - ls) - o)) AS shown, greatest(0, coalesce(dc, clip_start_ms, 0)) AS src,
               greatest(0, least(song, coalesce(ds, ls + o))) AS st FROM timed_child""",
    "timing": """
        SELECT *, greatest(st + 100, least(song, st + CASE WHEN vd <> 0 THEN greatest(100, vd - src) ELSE shown END,
                  coalesce(de, st + least(shown, CASE WHEN vd <> 0 THEN greatest(100, vd - src) ELSE shown END)))) AS en FROM timing1""",
    "edl_item": """
        SELECT song_id, 0 AS part, row_number() OVER (PARTITION BY song_id ORDER BY slot_no) - 1 AS place, video_path, start_ms, end_ms, clip_start_ms, clip_duration_ms, keep_audio FROM slot
        UNION ALL
        SELECT song_id, 1, row_number() OVER (PARTITION BY song_id ORDER BY clip_no) - 1, video_path, start_ms, end_ms, clip_start_ms, clip_duration_ms, true FROM clip""",
    "registry": """
        SELECT song_id, video_path, first[1] AS part, first[2] AS place, row_number() OVER (PARTITION BY song_id ORDER BY first) AS file_no
        FROM (SELECT song_id, video_path, min([part, place]) AS first FROM edl_item GROUP BY ALL)""",
    "sample": """
        SELECT l_linenumber::BIGINT AS track_id, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity) - 1 AS pos,
               l_quantity - 25.0 AS value FROM lineitem""",
}


def sql(body: str, recursive: bool = False) -> str:
    return with_tables(body, recursive=recursive, extra=STEPS)


def ranges(spark, d):
    q = idiv(F.col("duration_ms"), 4)
    return X.song(spark, d).select("song_id", q.alias("range_start_ms"), (q + idiv(F.col("duration_ms"), 2)).alias("range_end_ms"))


@query("offset_lyrics", sql("""
    SELECT song_id, line_no, ((greatest(0, start_ms - s) + 5) // 10) * 10 AS start_ms, ((least(e - s, end_ms - s) + 5) // 10) * 10 AS end_ms, text
    FROM lyr JOIN ranged USING (song_id) WHERE end_ms > s AND start_ms < e AND least(e - s, end_ms - s) > greatest(0, start_ms - s)"""))
def offset_lyrics(spark, d):
    return SO.offset_lyrics(X.lyr(spark, d), ranges(spark, d))


@query("line_beats", sql("""
    SELECT l.song_id, l.line_no, count(b.beat_ms) AS n, coalesce(string_agg(b.beat_ms::VARCHAR, ',' ORDER BY b.beat_ms), '') AS beats
    FROM lyr l LEFT JOIN beat b ON b.song_id = l.song_id AND b.beat_ms BETWEEN l.start_ms AND l.end_ms GROUP BY ALL"""))
def line_beats(spark, d):
    rows = SO.line_beats(X.lyr(spark, d), X.beat(spark, d))
    return rows.select("song_id", "line_no", F.size("beats").cast("bigint").alias("n"), F.array_join("beats", ",").alias("beats"))


@query("add_intro", sql("SELECT song_id, line_no, start_ms, end_ms, text, is_intro FROM intro_line"))
def add_intro(spark, d):
    return SO.add_intro(X.lyr(spark, d))


@query("envelope", sql("""
    SELECT track_id, pos // hop AS point, round(max(abs(value)) / max(peak), 3) AS level
    FROM sample JOIN (SELECT track_id, greatest(1, count(*) // 1000) AS hop, max(abs(value)) AS peak FROM sample GROUP BY 1) USING (track_id)
    GROUP BY track_id, pos // hop"""))
def envelope(spark, d):
    li = X.table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("track_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_quantity") - 25.0).alias("value")
    )
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]
    return SO.envelope(numbered(li, ["track_id"], order, idiv(F.col("l_orderkey"), 16_384), "pos").select("track_id", "pos", "value"))


@query("onsets", sql("""
    SELECT video_id AS song_id, t_ms, round(motion_score / peak, 3) AS strength
    FROM kf JOIN (SELECT video_id, max(motion_score) AS peak FROM kf GROUP BY 1) USING (video_id) WHERE motion_score / peak > 0.1::DOUBLE"""))
def onsets(spark, d):
    rows = X.kf(spark, d).select(F.col("video_id").alias("song_id"), "t_ms", F.col("motion_score").alias("strength"))
    return SO.select_onsets(rows)


@query("slots_to_lines", sql("SELECT song_id, slot_no, line_no, child_no, offset_start_ms, offset_end_ms FROM child"))
def slots_to_lines(spark, d):
    return TL.slots_to_lines(X.slot(spark, d), X.lyr(spark, d)).select("song_id", "slot_no", "line_no", "child_no", "offset_start_ms", "offset_end_ms")


INHERIT = """
    SELECT song_id, line_no, slot_no, start_ms, end_ms, video_id, clip_start_ms, clip_duration_ms, keep_audio, transition, false AS inherited FROM on_line
    UNION ALL
    SELECT song_id, line_no, slot_no, start_ms, end_ms, video_id,
           greatest(0, CASE WHEN dur > 0 AND clip > dur - 100 THEN greatest(0, dur - 100) ELSE clip END), greatest(0, end_ms - start_ms), keep_audio, NULL, true
    FROM played"""


@query("inherit_slots", sql(INHERIT))
def inherit_slots(spark, d):
    return TL.inherit_slots(X.slot(spark, d), X.lyr(spark, d), X.vid(spark, d), ["keep_audio"])


@query("effective_slots", sql("SELECT * FROM effective"))
def effective_slots(spark, d):
    return TL.effective_slots(X.lyr(spark, d), X.known_slot(spark, d))


@query("clamp_clips", sql("""
    SELECT song_id, slot_no, CASE WHEN video_duration_ms > 0 AND clip_start_ms > video_duration_ms - 100 THEN greatest(0, video_duration_ms - 100) ELSE clip_start_ms END AS clip_start_ms
    FROM known_slot"""))
def clamp_clips(spark, d):
    return TL.clamp_clips(X.slot(spark, d), X.vid(spark, d)).select("song_id", "slot_no", "clip_start_ms")


@query("range_extract", sql("""
    SELECT 'slot' AS kind, song_id, slot_no AS item_no, greatest(0, start_ms - s) AS start_ms, least(r - s, end_ms - s) AS end_ms,
           clip_start_ms + greatest(0, s - start_ms) AS clip_start_ms
    FROM slot JOIN wanted USING (song_id) WHERE end_ms > s AND start_ms < r
    UNION ALL
    SELECT 'clip', song_id, clip_no, greatest(0, start_ms - s), least(r - s, end_ms - s), clip_start_ms + greatest(0, s - start_ms)
    FROM clip JOIN wanted USING (song_id) WHERE end_ms > s AND start_ms < r
    UNION ALL
    SELECT 'line', song_id, line_no, greatest(0, start_ms - s), least(r - s, end_ms - s), 0
    FROM lyr JOIN wanted USING (song_id) WHERE end_ms > s AND start_ms < r""".replace("wanted", """
        (SELECT song_id, s, least(total, e) AS r FROM ranged JOIN (SELECT song_id, arg_max(end_ms, slot_no) AS total FROM slot GROUP BY 1) USING (song_id) WHERE least(total, e) > s)""")))
def range_extract(spark, d):
    asked = ranges(spark, d).select("song_id", F.col("range_start_ms").alias("wanted_start_ms"), F.col("range_end_ms").alias("wanted_end_ms"))
    slots = X.slot(spark, d)
    cut = TL.song_ranges(slots, asked)
    keep = cut.select("song_id")
    shot = TL.cut_to_range(slots.join(keep, "song_id", "left_semi"), cut, has_clip=True)
    said = TL.cut_to_range(X.clip(spark, d).join(keep, "song_id", "left_semi"), cut, has_clip=True)
    sung = TL.cut_to_range(X.lyr(spark, d).join(keep, "song_id", "left_semi"), cut, has_clip=False).withColumn("clip_start_ms", F.lit(0).cast("bigint"))
    pick = lambda df, kind, no: df.select(F.lit(kind).alias("kind"), "song_id", F.col(no).alias("item_no"), "start_ms", "end_ms", "clip_start_ms")
    return pick(shot, "slot", "slot_no").unionByName(pick(said, "clip", "clip_no")).unionByName(pick(sung, "line", "line_no"))


@query("auto_transitions", sql("""
    SELECT song_id, slot_no, CASE WHEN prev_video IS NULL THEN transition WHEN video_id = prev_video THEN 'none'
           WHEN start_ms - prev_end > 1500 THEN 'flash-through-white' WHEN before % 2 = 0 THEN 'whip-pan' ELSE 'cross-fade' END AS transition
    FROM (SELECT *, coalesce(sum((video_id <> prev_video)::INTEGER) OVER (PARTITION BY song_id ORDER BY start_ms, slot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT *, lag(video_id) OVER w AS prev_video, lag(end_ms) OVER w AS prev_end FROM slot WINDOW w AS (PARTITION BY song_id ORDER BY start_ms, slot_no)))"""))
def auto_transitions(spark, d):
    return TL.auto_transitions(X.slot(spark, d)).select("song_id", "slot_no", "transition")


@query("merge_slots", sql("""
    SELECT song_id, head AS slot_no, arg_max(end_ms, i) AS end_ms, arg_max(clip_duration_ms, i) AS clip_duration_ms, count(*) AS merged
    FROM merging GROUP BY song_id, head""", True))
def merge_slots(spark, d):
    same = ["keep_audio", "transcript", "speaker", "dialogue_independent"]
    return TL.merge_slots(X.slot(spark, d), same).select("song_id", "slot_no", "end_ms", "clip_duration_ms", "merged")


def _children(spark, d):
    rows = TL.slots_to_lines(X.slot(spark, d), X.lyr(spark, d))
    return rows.drop("start_ms", "end_ms").withColumnRenamed("slot_no", "from_slot").withColumnRenamed("line_no", "slot_no")


@query("normalize_children", sql("""
    SELECT song_id, line_no, slot_no, row_number() OVER (PARTITION BY song_id, line_no // 3 ORDER BY o, slot_no) - 1 AS child_no, o AS offset_start_ms, e AS offset_end_ms,
           greatest(0, e - o) AS clip_duration_ms
    FROM (SELECT *, CASE WHEN slot_no % 4 = 0 THEN 0 ELSE (slot_no * 777) % 5000 END AS o, CASE WHEN slot_no % 5 = 0 THEN line_ms ELSE (slot_no * 991) % 6000 END AS e
          FROM (SELECT c.*, l.end_ms - l.start_ms AS line_ms FROM child c JOIN lyr l ON l.song_id = c.song_id AND l.line_no = c.line_no))"""))
def normalize_children(spark, d):
    """Every three neighbouring lines' slots are taken as children of one."""
    rows = TL.slots_to_lines(X.slot(spark, d), X.lyr(spark, d)).drop("offset_start_ms", "offset_end_ms", "child_no")
    n = F.col("slot_no")
    rows = rows.join(X.lyr(spark, d).select("song_id", "line_no", (F.col("end_ms") - F.col("start_ms")).alias("line_ms")), ["song_id", "line_no"])
    rows = rows.select(
        "song_id", "line_no", idiv(F.col("line_no"), 3).alias("slot_no"), n.alias("child_no"), n.alias("from_slot"), "line_ms", "clip_start_ms",
        F.when(n % 4 != 0, (n * 777) % 5000).alias("offset_start_ms"), F.when(n % 5 != 0, (n * 991) % 6000).alias("offset_end_ms"),
    )
    return TL.normalize_children(rows).select(
        "song_id", "line_no", F.col("from_slot").alias("slot_no"), "child_no", "offset_start_ms", "offset_end_ms", "clip_duration_ms"
    )


@query("split_child", sql("""
    SELECT song_id, slot_no, 0 AS half_no, offset_start_ms, CASE WHEN long THEN mid ELSE offset_end_ms END AS offset_end_ms, clip_start_ms FROM
        (SELECT *, offset_end_ms - offset_start_ms >= 400 AS long, ((offset_start_ms + offset_end_ms + 10) // 20) * 10 AS mid FROM child)
    UNION ALL
    SELECT song_id, slot_no, 1, mid, offset_end_ms, clip_start_ms + mid - offset_start_ms
    FROM (SELECT *, ((offset_start_ms + offset_end_ms + 10) // 20) * 10 AS mid FROM child) WHERE offset_end_ms - offset_start_ms >= 400"""))
def split_child(spark, d):
    rows = TL.split_children(TL.slots_to_lines(X.slot(spark, d), X.lyr(spark, d)))
    return rows.select("song_id", "slot_no", "half_no", "offset_start_ms", "offset_end_ms", "clip_start_ms")


@query("offset_edits", sql("""
    SELECT song_id, slot_no, CASE WHEN first THEN least(val, oe - 100) ELSE os END AS offset_start_ms, CASE WHEN NOT first THEN greatest(val, os + 100) ELSE oe END AS offset_end_ms
    FROM (SELECT c.song_id, c.slot_no, offset_start_ms AS os, offset_end_ms AS oe, c.slot_no % 2 = 0 AS first,
                 greatest(0, least(l.end_ms - l.start_ms, (c.slot_no * 613) % 9000 - 800)) AS val
          FROM child c JOIN lyr l ON l.song_id = c.song_id AND l.line_no = c.line_no)"""))
def offset_edits(spark, d):
    rows = TL.slots_to_lines(X.slot(spark, d), X.lyr(spark, d))
    rows = rows.join(X.lyr(spark, d).select("song_id", "line_no", (F.col("end_ms") - F.col("start_ms")).alias("line_ms")), ["song_id", "line_no"])
    edits = rows.withColumn("field", F.when(F.col("slot_no") % 2 == 0, "offset_start").otherwise("offset_end")).withColumn(
        "value_ms", (F.col("slot_no") * 613) % 9000 - 800
    )
    return TL.edit_offsets(edits).select("song_id", "slot_no", "offset_start_ms", "offset_end_ms")


@query("slots_payload", sql("""
    SELECT c.song_id, c.line_no, c.child_no, l.start_ms + offset_start_ms AS start_ms, l.start_ms + offset_end_ms AS end_ms, video_id, clip_start_ms,
           offset_end_ms - offset_start_ms AS clip_duration_ms
    FROM child c JOIN lyr l ON l.song_id = c.song_id AND l.line_no = c.line_no
    UNION ALL
    SELECT song_id, line_no, 0, start_ms, end_ms, video_id, clip_start_ms, end_ms - start_ms FROM effective WHERE is_fallback"""))
def slots_payload(spark, d):
    return TL.slots_payload(X.lyr(spark, d), _children(spark, d), X.known_slot(spark, d))


def _timed_children(spark, d):
    n = F.col("from_slot")
    rows = TL.slots_to_lines(X.slot(spark, d), X.lyr(spark, d)).withColumnRenamed("slot_no", "from_slot").withColumnRenamed("line_no", "slot_no")
    lines = X.lyr(spark, d).select("song_id", F.col("line_no").alias("slot_no"), F.col("start_ms").alias("line_start_ms"), F.col("end_ms").alias("line_end_ms"))
    rows = rows.join(lines, ["song_id", "slot_no"]).join(X.song(spark, d).withColumnRenamed("duration_ms", "song_ms"), "song_id")
    rows = rows.join(X.vid(spark, d).select("video_id", F.col("duration_ms").alias("video_duration_ms")), "video_id", "left")
    seconds = lambda c: (c / 1000.0).cast("string")
    return rows.select(
        "*", seconds_to_ms(F.when(n % 3 == 0, "soon").otherwise(seconds(F.col("start_ms") - 1500 + 1000 * (n % 5)))).alias("dialogue_start_ms"),
        F.when(n % 4 != 0, F.col("end_ms") + 2500).alias("dialogue_end_ms"), F.when(n % 2 != 0, F.col("clip_start_ms") - 500).alias("dialogue_clip_start_ms"),
    )


@query("dialogue_timing", sql("SELECT song_id, line_no, child_no, st AS d_start_ms, en AS d_end_ms, src AS d_clip_start_ms, en - st AS d_duration_ms FROM timing"))
def dialogue_timing(spark, d):
    rows = DG.dialogue_timing(_timed_children(spark, d))
    return rows.select("song_id", F.col("slot_no").alias("line_no"), "child_no", "d_start_ms", "d_end_ms", "d_clip_start_ms", "d_duration_ms")


@query("dialogue_track", sql("""
    SELECT song_id, 'dialogue-' || line_no || '-' || child_no AS clip_id, video_path, st AS start_ms, en AS end_ms, src AS clip_start_ms, transcript FROM timing WHERE independent"""))
def dialogue_track(spark, d):
    rows = _timed_children(spark, d).withColumn("dialogue_independent", F.col("dialogue_independent") | (F.col("speaker") == "user"))
    rows = rows.withColumn("dialogue_video_path", F.lit(None).cast("string"))
    return DG.dialogue_track(rows).select("song_id", "clip_id", "video_path", "start_ms", "end_ms", "clip_start_ms", "transcript")


@query("active_at", sql("""
    SELECT t.song_id, t.t_ms, t.line_no, coalesce(l.text, '') AS lyric, s.slot_no,
           coalesce(CASE WHEN c.clip_no IS NOT NULL THEN c.transcript WHEN s.keep_audio AND s.transcript <> '' THEN s.transcript END, '') AS dialogue
    FROM tick_line t LEFT JOIN lyr l ON l.song_id = t.song_id AND l.line_no = t.sung_no
    LEFT JOIN (SELECT b.song_id, b.beat_ms, min(slot_no) AS slot_no FROM beat b JOIN slot s ON s.song_id = b.song_id AND b.beat_ms >= s.start_ms AND b.beat_ms < s.end_ms GROUP BY ALL) a
           ON a.song_id = t.song_id AND a.beat_ms = t.t_ms
    LEFT JOIN slot s ON s.song_id = t.song_id AND s.slot_no = a.slot_no
    LEFT JOIN (SELECT b.song_id, b.beat_ms, min([s.start_ms, s.clip_no])[2] AS clip_no FROM beat b JOIN clip s ON s.song_id = b.song_id AND b.beat_ms >= s.start_ms AND b.beat_ms < s.end_ms GROUP BY ALL) k
           ON k.song_id = t.song_id AND k.beat_ms = t.t_ms
    LEFT JOIN clip c ON c.song_id = t.song_id AND c.clip_no = k.clip_no"""))
def active_at(spark, d):
    ticks = X.beat(spark, d).withColumnRenamed("beat_ms", "t_ms")
    return TL.active_at(ticks, SO.add_intro(X.lyr(spark, d)), X.slot(spark, d), X.clip(spark, d))


@query("lookahead", sql("""
    SELECT t.song_id, t.t_ms, n.line_no AS next_line, n.video_id AS next_video_id, n.clip_start_ms AS next_clip_start_ms
    FROM (SELECT b.song_id, b.beat_ms AS t_ms, min(l.line_no) FILTER (b.beat_ms >= l.start_ms AND b.beat_ms < l.end_ms) AS now_no,
                 min(l.line_no) FILTER (l.start_ms > b.beat_ms) AS later_no
          FROM beat b JOIN lyr l ON l.song_id = b.song_id GROUP BY ALL) t
    JOIN effective n ON n.song_id = t.song_id AND n.line_no = coalesce(now_no + 1, later_no)
    LEFT JOIN effective c ON c.song_id = t.song_id AND c.line_no = now_no
    WHERE n.video_id IS DISTINCT FROM c.video_id"""))
def lookahead(spark, d):
    ticks = X.beat(spark, d).withColumnRenamed("beat_ms", "t_ms")
    lines = X.lyr(spark, d)
    return TL.look_ahead(ticks, lines, TL.effective_slots(lines, X.known_slot(spark, d)))


@query("clip_overlaps", sql("""
    SELECT c.song_id, c.line_no, c.rank, EXISTS (
        SELECT 1 FROM effective e WHERE e.song_id = c.song_id AND e.video_id = c.video_id AND e.line_no <> c.line_no
          AND c.t_ms < e.clip_start_ms + e.clip_duration_ms AND e.clip_start_ms < c.t_ms + l.end_ms - l.start_ms) AS overlaps
    FROM cand c JOIN lyr l ON l.song_id = c.song_id AND l.line_no = c.line_no"""))
def clip_overlaps(spark, d):
    lines = X.lyr(spark, d)
    shown = TL.effective_slots(lines, X.known_slot(spark, d))
    return TL.overlapping_candidates(X.cand(spark, d), lines, shown).select("song_id", "line_no", "rank", "overlaps")


# One row per song and line, carrying the list of slots filled so far; what a line shows follows from that list.
ASSIGN_STEPS = {
    "sheet": "SELECT song_id, list({'s': start_ms, 'n': end_ms - start_ms} ORDER BY line_no) AS ls FROM lyr GROUP BY song_id",
    "held": """
        SELECT song_id, list({'i': slot_no, 'v': video_id, 'c': clip_start_ms, 'd': clip_duration_ms,
                              'm': CASE WHEN coalesce(video_duration_ms, 0) > 0 THEN video_duration_ms ELSE clip_duration_ms + 5000 END} ORDER BY slot_no) AS f
        FROM known_slot GROUP BY song_id""",
    "offer": """
        SELECT c.song_id, c.line_no, list({'r': c.rank, 'v': c.video_id, 't': c.t_ms, 'm': coalesce(v.duration_ms, 0)} ORDER BY c.rank) AS os
        FROM cand c LEFT JOIN vid v USING (video_id) GROUP BY c.song_id, c.line_no""",
    "pass": """
        SELECT song_id, -1::BIGINT AS i, f, NULL::STRUCT(r INTEGER, v BIGINT, t BIGINT, m BIGINT) AS o, NULL::INTEGER AS tier
        FROM (SELECT s.song_id, coalesce(h.f, []) AS f FROM sheet s LEFT JOIN held h USING (song_id))
        UNION ALL
        SELECT song_id, i, CASE WHEN o IS NULL THEN f
                 ELSE list_sort(list_append(f, {'i': i, 'v': o.v, 'c': o.t, 'd': n, 'm': CASE WHEN o.m > 0 THEN o.m ELSE n + 5000 END})) END AS f, o, tier
        FROM (
          SELECT song_id, i, f, n, CASE WHEN len(fresh) > 0 THEN fresh[1] WHEN len(clear) > 0 THEN clear[1] ELSE os[1] END AS o,
                 CASE WHEN os IS NULL THEN NULL WHEN len(fresh) > 0 THEN 1 WHEN len(clear) > 0 THEN 2 ELSE 3 END AS tier
          FROM (SELECT *, list_filter(clear, lambda c: NOT list_contains([x.v FOR x IN shown IF x.j >= i - 4 AND x.j < i], c.v)) AS fresh
            FROM (SELECT *, list_filter(os, lambda c: len(list_filter(shown, lambda x: x.j <> i AND x.v = c.v AND greatest(0, c.t) < x.c + x.n AND x.c < greatest(0, c.t) + n)) = 0) AS clear
              FROM (
                SELECT song_id, i, f, n, os, list_filter(list_transform(range(len(ls)), lambda j: list_transform([list_filter(f, lambda x: x.i <= j)[-1]], lambda l: CASE
                         WHEN len(f) = 0 THEN NULL
                         WHEN l IS NULL THEN {'j': j, 'v': f[1].v, 'c': f[1].c, 'n': ls[j + 1].n}
                         WHEN l.i = j THEN {'j': j, 'v': l.v, 'c': l.c, 'n': l.d}
                         ELSE {'j': j, 'v': l.v, 'c': CASE WHEN l.c + ls[j + 1].s - ls[l.i + 1].s > l.m - 100 THEN greatest(0, l.m - 100) ELSE l.c + ls[j + 1].s - ls[l.i + 1].s END, 'n': ls[j + 1].n}
                         END)[1]), lambda x: x IS NOT NULL) AS shown
                FROM (SELECT p.song_id, p.i + 1 AS i, p.f, s.ls, s.ls[p.i + 2].n AS n, CASE WHEN len(list_filter(p.f, lambda x: x.i = p.i + 1)) = 0 THEN q.os END AS os
                      FROM pass p JOIN sheet s USING (song_id) LEFT JOIN offer q ON q.song_id = p.song_id AND q.line_no = p.i + 1 WHERE p.i + 1 < len(s.ls))))))""",
}


@query("assign_candidates", with_tables(
    "SELECT song_id, i AS line_no, o.r AS rank, o.v AS video_id, o.t AS clip_start_ms, tier FROM pass WHERE o IS NOT NULL", recursive=True, extra=ASSIGN_STEPS))
def assign_candidates(spark, d):
    cands = X.cand(spark, d).withColumn("clip_start_ms", F.col("t_ms")).join(
        X.vid(spark, d).select("video_id", F.col("duration_ms").alias("limit_ms")), "video_id", "left"
    )
    return AS.assign_candidates(X.lyr(spark, d), X.known_slot(spark, d), cands)


@query("duration_lookup", sql(f"""
    SELECT s.song_id, s.slot_no, s.p AS video_path, v.duration_ms
    FROM (SELECT song_id, slot_no, CASE WHEN slot_no % 2 = 0 THEN video_path ELSE '/proxy/v' || video_id || '.mp4' END AS p FROM slot) s
    LEFT JOIN (SELECT original_path AS p, duration_ms FROM vid UNION ALL SELECT proxy_path, duration_ms FROM vid) v USING (p)"""))
def duration_lookup(spark, d):
    proxy = F.concat(F.lit("/proxy/v"), F.col("video_id").cast("string"), F.lit(".mp4"))
    rows = X.slot(spark, d).select("song_id", "slot_no", F.when(F.col("slot_no") % 2 == 0, F.col("video_path")).otherwise(proxy).alias("video_path"))
    return TL.duration_lookup(rows.withColumn("absolute_path", F.concat(F.lit("/abs"), "video_path")), X.vid(spark, d)).select(
        "song_id", "slot_no", "video_path", "duration_ms"
    )


@query("restore_slots", sql("""
    SELECT song_id, slot_no, coalesce(v.duration_ms, clip_duration_ms + 5000) AS video_duration_ms, coalesce(v.proxy_path,
           '/api/video_file?path=' || replace(replace(replace(replace(video_path, ' ', '%20'), '[', '%5B'), ']', '%5D'), '/', '%2F')) AS proxy_url
    FROM slot LEFT JOIN (FROM vid WHERE duration_ms < 256000) v ON v.original_path = video_path"""))
def restore_slots(spark, d):
    """A library that has lost its longest videos."""
    known = X.vid(spark, d).filter("duration_ms < 256000").withColumn("proxy_url", F.col("proxy_path"))
    return TL.restore_slots(X.slot(spark, d), known).select("song_id", "slot_no", "video_duration_ms", "proxy_url")


@query("fill_stats", sql("""
    SELECT song_id, count(s.slot_no) AS filled, count(*) AS total FROM lyr l LEFT JOIN slot s USING (song_id) WHERE false GROUP BY 1""".replace(
    "lyr l LEFT JOIN slot s USING (song_id) WHERE false", "(SELECT l.song_id, s.slot_no FROM lyr l LEFT JOIN slot s ON s.song_id = l.song_id AND s.slot_no = l.line_no) s")))
def fill_stats(spark, d):
    return TL.fill_stats(X.lyr(spark, d), X.slot(spark, d))


@query("file_registry", sql("SELECT song_id, video_path, part::INTEGER AS part, place, file_no FROM registry"))
def file_registry(spark, d):
    return E.file_registry(X.slot(spark, d), X.clip(spark, d))


@query("edl_rows", sql("""
    SELECT i.song_id, track, i.place AS item_no, i.video_path, r.file_no,
           r.part = i.part AND r.place = i.place AND track IN ('video', 'independent-l') AS defines_file,
           (start_ms * 24 + 500) // 1000 AS start_f, (end_ms * 24 + 500) // 1000 AS end_f, (clip_start_ms * 24 + 500) // 1000 AS in_f,
           ((clip_start_ms + end_ms - start_ms) * 24 + 500) // 1000 AS out_f,
           (greatest(coalesce(nullif(clip_duration_ms, 0), end_ms - start_ms), 1000000) * 24 + 500) // 1000 AS source_f,
           CASE WHEN EXISTS (SELECT 1 FROM clip c WHERE c.song_id = i.song_id) THEN 6 ELSE 4 END AS channels
    FROM (SELECT *, unnest(CASE WHEN part = 1 THEN ['independent-l', 'independent-r'] WHEN keep_audio THEN ['video', 'audio-l', 'audio-r'] ELSE ['video'] END) AS track FROM edl_item) i
    JOIN registry r ON r.song_id = i.song_id AND r.video_path = i.video_path"""))
def edl_rows(spark, d):
    return E.edl_rows(X.slot(spark, d), X.clip(spark, d))


@query("edl_music", sql("""
    SELECT song_id, track, 0::BIGINT AS item_no, '/lib/music/' || song_id || '.mp3' AS video_path, 0::BIGINT AS file_no, track = 'music-l' AS defines_file,
           0::BIGINT AS start_f, n AS end_f, 0::BIGINT AS in_f, n AS out_f, n AS source_f, CASE WHEN EXISTS (SELECT 1 FROM clip c WHERE c.song_id = m.song_id) THEN 6 ELSE 4 END AS channels
    FROM (SELECT l.song_id, coalesce((arg_max(s.end_ms, s.slot_no) * 24 + 500) // 1000, 0)::BIGINT AS n
          FROM (SELECT DISTINCT song_id FROM lyr) l LEFT JOIN slot s ON s.song_id = l.song_id GROUP BY l.song_id) m
    CROSS JOIN (SELECT unnest(['music-l', 'music-r']) AS track)"""))
def edl_music(spark, d):
    songs = X.lyr(spark, d).select("song_id").distinct()
    music = songs.select("song_id", F.concat(F.lit("/lib/music/"), F.col("song_id").cast("string"), F.lit(".mp3")).alias("audio_path"))
    return E.music_rows(X.slot(spark, d), X.clip(spark, d), music)


@query("keep_audio", sql("""
    SELECT segment_id, coalesce(transcript, '') <> '' AND CASE WHEN section IN ('Intro', 'Final Chorus') THEN scene_type = 'emotional' OR score >= 8
           ELSE scene_type = 'emotional' AND score >= 9 END AS keep
    FROM (SELECT *, coalesce(mad_score, 5) AS score, (['Intro', 'Verse', 'Final Chorus', ''])[segment_id % 4 + 1] AS section FROM seg)"""))
def keep_audio(spark, d):
    names = F.array(*[F.lit(s) for s in ("Intro", "Verse", "Final Chorus", "")])
    section = F.element_at(names, (F.col("segment_id") % 4 + 1).cast("int"))
    return X.seg(spark, d).select("segment_id", DG.keeps_audio(F.col("transcript"), F.col("mad_score"), F.col("scene_type"), section).alias("keep"))


@query("clip_choice", sql("""
    SELECT segment_id, greatest(0, CASE WHEN transcript <> '' THEN start_ms ELSE (start_ms + end_ms) // 2 - 700 END) AS clip_start_ms FROM seg"""))
def clip_choice(spark, d):
    middle = idiv(F.col("start_ms") + F.col("end_ms"), 2) - 700
    return X.seg(spark, d).select("segment_id", DG.clip_choice(F.col("transcript"), F.col("start_ms"), middle).alias("clip_start_ms"))


@query("dialogue_mode", sql("""
    SELECT song_id, slot_no, CASE WHEN dialogue_independent THEN 'independent' WHEN keep_audio THEN 'linked' ELSE 'off' END AS mode FROM slot"""))
def dialogue_mode(spark, d):
    return X.slot(spark, d).select("song_id", "slot_no", DG.dialogue_mode(F.col("dialogue_independent"), F.col("keep_audio")).alias("mode"))


SPEAKERS = {"tayama": (("tayama", "田山"), ("田山",)), "sasaki": (("sasaki", "佐佐木"), ("佐佐木",)), "yamada": (("yamada", "山田"), ("山田",))}


@query("resolve_speaker", sql("""
    SELECT segment_id, CASE WHEN manual OR sp IN ('tayama', 'sasaki', 'yamada') THEN CASE WHEN sp IN ('tayama', 'sasaki', 'yamada') THEN sp ELSE 'unknown' END
        WHEN about = '' THEN 'unknown' WHEN contains(about, 'tayama') OR contains(about, '田山') OR contains(said, '田山') THEN 'tayama'
        WHEN contains(about, 'sasaki') OR contains(about, '佐佐木') OR contains(said, '佐佐木') THEN 'sasaki'
        WHEN contains(about, 'yamada') OR contains(about, '山田') OR contains(said, '山田') THEN 'yamada' ELSE 'unknown' END AS speaker
    FROM (SELECT segment_id, segment_id % 7 = 0 AS manual, lower((['Yamada', 'somebody', 'unknown', 'SASAKI', 'unknown', 'unknown'])[segment_id % 6 + 1]) AS sp,
                 lower((['', 'Tayama walks', 'with 佐佐木', 'yamada and Sasaki', 'a street'])[segment_id % 5 + 1] ) AS about,
                 (['', '山田 is here', '田山'])[segment_id % 3 + 1] AS said FROM seg)"""))
def resolve_speaker(spark, d):
    n = F.col("segment_id")
    pick = lambda words, by: F.element_at(F.array(*[F.lit(w) for w in words]), (n % by + 1).cast("int"))
    speaker = DG.resolve_speaker(
        pick(["", "Tayama walks", "with 佐佐木", "yamada and Sasaki", "a street"], 5), pick(["", "山田 is here", "田山"], 3),
        pick(["Yamada", "somebody", "unknown", "SASAKI", "unknown", "unknown"], 6), n % 7 == 0, speakers=SPEAKERS,
    )
    return X.seg(spark, d).select("segment_id", speaker.alias("speaker"))


@query("volumes", sql("""
    SELECT song_id, slot_no, m AS music_mix, least(v, 1.0::DOUBLE) AS dialogue_mix, CASE WHEN keep_audio THEN v ELSE 1.0::DOUBLE END AS slot_volume, greatest(0.0::DOUBLE, least(1.0::DOUBLE, v)) AS preview_volume
    FROM (SELECT *, coalesce(CASE WHEN song_id % 4 > 0 THEN (song_id % 9) / 4.0::DOUBLE END, 1.0::DOUBLE) AS m, coalesce(CASE WHEN slot_no % 3 > 0 THEN (slot_no % 7) / 4.0::DOUBLE END, 1.0::DOUBLE) AS v FROM slot)"""))
def volumes(spark, d):
    rows = X.slot(spark, d).withColumn("music_volume", F.when(F.col("song_id") % 4 > 0, (F.col("song_id") % 9) / 4.0)).withColumn(
        "dialogue_volume", F.when(F.col("slot_no") % 3 > 0, (F.col("slot_no") % 7) / 4.0)
    )
    return DG.volumes(rows).select("song_id", "slot_no", "music_mix", "dialogue_mix", "slot_volume", "preview_volume")


@query("assign_clamp", sql("""
    SELECT song_id, slot_no, CASE WHEN video_duration_ms - clip_duration_ms IS NULL THEN greatest(0, clip_start_ms - 9000)
           ELSE least(greatest(0, video_duration_ms - clip_duration_ms), greatest(0, clip_start_ms - 9000)) END AS clip_start_ms FROM known_slot"""))
def assign_clamp(spark, d):
    rows = X.known_slot(spark, d)
    start = DG.assigned_start(F.col("clip_start_ms") - 9000, F.col("video_duration_ms"), F.col("clip_duration_ms"))
    return rows.select("song_id", "slot_no", start.alias("clip_start_ms"))


@query("validate_slots", sql("""
    SELECT song_id, slot_no, k IN (0, 5) AS accepted, (['', 'not JSON', 'video_path is missing', 'clip_start is no number', 'clip_duration is no number', ''])[k + 1] AS reason,
           CASE WHEN k IN (0, 5) THEN clip_start_ms END AS clip_start_ms
    FROM (SELECT *, slot_no % 6 AS k FROM slot)"""))
def validate_slots(spark, d):
    k, sec = F.col("slot_no") % 6, (F.col("clip_start_ms") / 1000.0).cast("string")
    path = F.concat(F.lit('{"video_path": "'), F.col("video_path"), F.lit('", '))
    rest = F.concat(F.lit('"clip_start": '), sec, F.lit(', "clip_duration": 2.5}'))
    text = (
        F.when(k == 1, "{not json").when(k == 2, F.concat(F.lit("{"), rest))
        .when(k == 3, F.concat(path, F.lit('"clip_start": "x", "clip_duration": 2}')))
        .when(k == 4, F.concat(path, F.lit('"clip_start": 1.5}'))).otherwise(F.concat(path, rest))
    )
    rows = DG.validate_slots(X.slot(spark, d).select("song_id", "slot_no", text.alias("slot_json")))
    return rows.select("song_id", "slot_no", "accepted", "reason", F.when(F.col("accepted"), F.col("clip_start_ms")).alias("clip_start_ms"))


def plans(spark, d):
    lines = SO.line_beats(X.lyr(spark, d), X.beat(spark, d))
    return RP.render_plans(X.slot(spark, d), X.clip(spark, d), lines, dialogue=1.4)


@query("render_plan", sql("""
    SELECT l.song_id, l.lyrics, coalesce(s.slots, 0) AS slots, coalesce(c.clips, 0) AS clips, l.beats, coalesce(s.total, 0.0::DOUBLE) AS duration, 1.0::DOUBLE AS dialogue_volume,
           l.line_starts, coalesce(s.clip_starts, '') AS clip_starts, coalesce(c.said, '') AS said
    FROM (SELECT l.song_id, count(DISTINCT l.line_no) AS lyrics, count(b.beat_ms) AS beats, md5(string_agg(DISTINCT lpad(l.line_no::VARCHAR, 8, '0') || ':' || l.start_ms || ':' || l.end_ms, ',' ORDER BY lpad(l.line_no::VARCHAR, 8, '0') || ':' || l.start_ms || ':' || l.end_ms)) AS line_starts FROM lyr l LEFT JOIN beat b ON b.song_id = l.song_id AND b.beat_ms BETWEEN l.start_ms AND l.end_ms GROUP BY 1) l
    LEFT JOIN (SELECT song_id, count(*) AS slots, arg_max(end_ms, slot_no) / 1000.0::DOUBLE AS total, md5(string_agg(clip_start_ms || ':' || clip_duration_ms || ':' || video_path || ':' || speaker, ',' ORDER BY slot_no)) AS clip_starts FROM slot GROUP BY 1) s USING (song_id)
    LEFT JOIN (SELECT song_id, count(*) AS clips, md5(string_agg(start_ms || ':' || transcript, ',' ORDER BY clip_no)) AS said FROM clip GROUP BY 1) c USING (song_id)"""))
def render_plan(spark, d):
    n = lambda path: F.size(F.col(path)).cast("bigint")
    ms = lambda seconds: F.round(seconds * 1000).cast("bigint").cast("string")
    listed = lambda path, item: F.array_join(F.transform(path, item), ",")
    hashed = lambda text: F.when(text == "", "").otherwise(F.md5(text))
    rows = RP.parse_documents(RP.as_documents(plans(spark, d)))
    # Lines are numbered from 0 without gaps, so their place is their number.
    line = lambda x, i: F.concat_ws(":", F.lpad(i.cast("string"), 8, "0"), ms(x["start"]), ms(x["end"]))
    shot = lambda x: F.concat_ws(":", ms(x["clipStart"]), ms(x["clipDuration"]), x["videoPath"], x["speaker"])
    return rows.select(
        "song_id", hashed(listed("plan.lyrics", line)).alias("line_starts"), hashed(listed("plan.slots", shot)).alias("clip_starts"),
        hashed(listed("plan.dialogueClips", lambda x: F.concat_ws(":", ms(x["startTime"]), x["transcript"]))).alias("said"),
        n("plan.lyrics").alias("lyrics"), n("plan.slots").alias("slots"), n("plan.dialogueClips").alias("clips"),
        F.aggregate("plan.lyrics", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x.beats)).alias("beats"),
        F.col("plan.duration").alias("duration"), F.col("plan.dialogueVolume").alias("dialogue_volume"),
    )


@query("render_plan_roundtrip", sql("""
    SELECT song_id, start_ms, end_ms, video_path, clip_start_ms, clip_duration_ms, keep_audio, transcript, speaker, transition FROM slot"""))
def render_plan_roundtrip(spark, d):
    """Written to files of several songs each, and read back."""
    path = f"{checkpoint_dir(spark)}/plans-{uuid.uuid4().hex}"
    RP.write_render_plans(plans(spark, d), path)
    return RP.plan_slots(RP.read_render_plans(spark, path)).drop("place")


