"""Cuts, segments and frame vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.functions import vectors as V
from cuespan.operators import segment as S
from cuespan.plans import fixtures as X
from cuespan.plans.fixtures_sql import with_tables
from cuespan.plans.registry import query

STEPS = {
    "motion_cut": "SELECT video_id, t_ms AS cut_ms FROM kf WHERE motion_score > 6.0",
    "silence_cut": """
        SELECT video_id, ((end_ms + nxt + 10) // 20) * 10 AS cut_ms
        FROM (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, cue_id) AS nxt FROM cue)
        WHERE nxt - end_ms > 2500""",
    "usable": """
        SELECT DISTINCT video_id, cut_ms FROM (FROM motion_cut UNION ALL FROM silence_cut) JOIN vid USING (video_id)
        WHERE cut_ms BETWEEN 4000 AND duration_ms - 4000""",
    "accepted": """
        SELECT video_id, 0::BIGINT AS start_ms, min(cut_ms) AS end_ms FROM usable GROUP BY video_id
        UNION ALL
        SELECT a.video_id, a.end_ms, min(u.cut_ms)
        FROM accepted a JOIN usable u ON u.video_id = a.video_id AND u.cut_ms >= a.end_ms + 4000
        GROUP BY a.video_id, a.end_ms""",
    "pieces": """
        SELECT video_id, start_ms, end_ms, CASE WHEN end_ms - start_ms > 15000 THEN (end_ms - start_ms) // 10000 + 1 ELSE 1 END AS n
        FROM accepted""",
    "piece_parts": """
        SELECT video_id, start_ms, end_ms, n, unnest(range(n)) AS i,
               ((n * start_ms + (end_ms - start_ms) + 5 * n) // (10 * n)) * 10 AS e1,
               (((end_ms - start_ms) + 5 * n) // (10 * n)) * 10 AS step
        FROM pieces""",
    "segments": """
        SELECT video_id, CASE WHEN i = 0 THEN start_ms ELSE e1 + (i - 1) * step END AS start_ms,
               CASE WHEN i = n - 1 THEN end_ms ELSE e1 + i * step END AS end_ms
        FROM piece_parts
        UNION ALL
        SELECT v.video_id, coalesce(a.last_ms, 0) AS start_ms, v.duration_ms AS end_ms
        FROM vid v LEFT JOIN (SELECT video_id, max(end_ms) AS last_ms FROM accepted GROUP BY 1) a USING (video_id)
        WHERE coalesce(a.last_ms, 0) < v.duration_ms""",
    "frame_pairs": """
        SELECT *, row_number() OVER w - 1 AS i, lag(vector) OVER w AS prev FROM vec
        WINDOW w AS (PARTITION BY video_id ORDER BY t_ms, keyframe_id)""",
    "readable": """
        SELECT keyframe_id, video_id, t_ms, CASE WHEN vector[2] >= -0.2 THEN vector END AS vector FROM vec""",
}


def sql(body: str, recursive: bool = False) -> str:
    return with_tables(body, recursive=recursive, extra=STEPS)


def segments(spark, d):
    return S.segment_videos(X.kf(spark, d), X.cue(spark, d), X.vid(spark, d))


@query("motion_cuts", sql("SELECT video_id, cut_ms FROM motion_cut"))
def motion_cuts(spark, d):
    return S.motion_cuts(X.kf(spark, d))


@query("silence_cuts", sql("SELECT video_id, cut_ms FROM silence_cut"))
def silence_cuts(spark, d):
    return S.silence_cuts(X.cue(spark, d))


@query("boundaries", sql("""
    SELECT video_id, cut_ms FROM motion_cut UNION SELECT video_id, cut_ms FROM silence_cut
    UNION SELECT video_id, 0 FROM vid UNION SELECT video_id, duration_ms FROM vid"""))
def boundaries(spark, d):
    return S.boundaries(X.kf(spark, d), X.cue(spark, d), X.vid(spark, d))


@query("segment_videos", sql("SELECT video_id, start_ms, end_ms FROM segments", True))
def segment_videos(spark, d):
    return segments(spark, d)


@query("segment_transcript", sql("""
    SELECT s.video_id, s.start_ms, s.end_ms,
           trim(coalesce(string_agg(c.text, ' ' ORDER BY c.start_ms, c.cue_id), '')) AS transcript
    FROM segments s LEFT JOIN cue c ON c.video_id = s.video_id AND (c.start_ms BETWEEN s.start_ms AND s.end_ms
         OR (c.start_ms <= s.start_ms AND c.end_ms >= s.end_ms))
    GROUP BY ALL""", True))
def segment_transcript(spark, d):
    return S.segment_transcripts(segments(spark, d), X.cue(spark, d))


@query("rep_frames", sql("""
    SELECT video_id, start_ms, end_ms,
           coalesce(string_agg(frame_path, ',' ORDER BY i) FILTER (n <= 3 OR i IN (1, n // 2 + 1, n)), '') AS frame_paths
    FROM (SELECT s.video_id, s.start_ms, s.end_ms, k.frame_path,
                 row_number() OVER (PARTITION BY s.video_id, s.start_ms, s.end_ms ORDER BY k.t_ms, k.keyframe_id) AS i,
                 count(k.keyframe_id) OVER (PARTITION BY s.video_id, s.start_ms, s.end_ms) AS n
          FROM segments s LEFT JOIN kf k ON k.video_id = s.video_id AND k.t_ms BETWEEN s.start_ms AND s.end_ms)
    GROUP BY ALL""", True))
def rep_frames(spark, d):
    shown = S.representative_frames(segments(spark, d), X.kf(spark, d))
    return shown.withColumn("frame_paths", F.array_join("frame_paths", ","))


@query("silence_sessions", sql("""
    SELECT video_id, session_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues
    FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 2500 THEN 1 ELSE 0 END)
                      OVER (PARTITION BY video_id ORDER BY start_ms, cue_id)::BIGINT AS session_no
          FROM (SELECT *, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, cue_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cue))
    GROUP BY ALL"""))
def silence_sessions(spark, d):
    return S.silence_sessions(X.cue(spark, d))


@query("frame_grid", sql("""
    SELECT video_id, keyframe_id, frame_no, frame_no * 500 AS grid_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_id) - 1 AS frame_no FROM kf)"""))
def frame_grid(spark, d):
    return S.frame_grid(X.kf(spark, d), order="keyframe_id").select("video_id", "keyframe_id", "frame_no", "grid_ms")


def readable(spark, d):
    """Frame vectors; those dark in their second channel count as unreadable."""
    return X.vec(spark, d).withColumn("vector", F.when(F.get("vector", F.lit(1)).cast("double") >= -0.2, F.col("vector")))


@query("motion_score", sql("""
    SELECT video_id, keyframe_id, round(coalesce(list_sum([abs(p[1] - p[2]) FOR p IN list_zip(vector, prev)]) / len(vector) / 25.5, 0.0), 6) AS motion
    FROM (SELECT *, last_value(vector IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t_ms, keyframe_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM readable)"""))
def motion_score(spark, d):
    return S.motion_scores(readable(spark, d)).select("video_id", "keyframe_id", F.round("motion", 6).alias("motion"))


@query("vector_stats", sql("""
    SELECT video_id, keyframe_id, round(list_sum(vector) / len(vector), 6) AS mean_value,
           round(list_sum([abs(p[1] - p[2]) FOR p IN list_zip(vector, prev)]) / len(vector), 6) AS mean_change
    FROM (SELECT *, lag(vector) OVER (PARTITION BY video_id ORDER BY t_ms, keyframe_id) AS prev FROM vec)"""))
def vector_stats(spark, d):
    rows = S.frame_changes(X.vec(spark, d))
    return rows.select("video_id", "keyframe_id", F.round("mean_value", 6).alias("mean_value"), F.round("mean_change", 6).alias("mean_change"))


@query("upsample_pairs", sql("""
    SELECT video_id, pos, is_between, array_to_string([round(x * 1e6)::BIGINT FOR x IN v], ',') AS vector_micros
    FROM (SELECT video_id, 2 * i AS pos, vector AS v, false AS is_between FROM frame_pairs
          UNION ALL
          SELECT video_id, 2 * i - 1, [(p[1] + p[2]) / 2.0 FOR p IN list_zip(prev, vector)], true
          FROM frame_pairs WHERE prev IS NOT NULL)"""))
def upsample_pairs(spark, d):
    rows = S.upsample_pairs(X.vec(spark, d))
    return rows.select("video_id", "pos", "is_between", V.micro_text(F.col("vector")).alias("vector_micros"))
