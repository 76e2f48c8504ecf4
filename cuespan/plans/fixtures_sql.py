"""The same domain tables as SQL common table expressions, for the oracle."""

from __future__ import annotations

import re

# Unicode white space, spelled the same for both regex engines.
WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def video_path(expr: str) -> str:
    return (
        f"'/lib/show' || (({expr}) // 20)::VARCHAR || '/Show - ' || lpad((({expr}) % 20)::VARCHAR, 2, '0') "
        f"|| ' [v' || ({expr})::VARCHAR || '].mkv'"
    )


_KINDS = "['.srt', '.lrc', '.ass', '.chs.ass', '.cht.ass', '.mkv', '.MP4', '.txt']"

CTES: dict[str, str] = {
    "frames": """
        SELECT e.user_id AS video_id, e.event_id AS keyframe_id,
               (epoch_us(e.ts) - f.us0) // 10000000 AS t_ms,
               e.value / 20.0 AS motion_score, e.event_type, e.props
        FROM events e JOIN (SELECT user_id, min(epoch_us(ts)) AS us0 FROM events GROUP BY 1) f USING (user_id)""",
    "kf": """
        SELECT video_id, keyframe_id, t_ms, motion_score, 'f_' || keyframe_id || '.jpg' AS frame_path FROM frames""",
    "vid": f"""
        SELECT video_id, max(t_ms) + 1000 AS duration_ms, {video_path('video_id')} AS original_path,
               '/proxy/v' || video_id || '.mp4' AS proxy_path
        FROM frames GROUP BY video_id""",
    "cue": """
        SELECT video_id, keyframe_id AS cue_id, t_ms AS start_ms,
               t_ms + 500 + (keyframe_id % 5) * 300 AS end_ms, event_type || ' ' || props AS text
        FROM frames WHERE event_type IN ('view', 'click')""",
    "seg": """
        SELECT o_orderkey AS segment_id, o_custkey AS video_id,
               date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 100 AS start_ms,
               date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 100 + 400 + (o_orderkey % 7) * 100 AS end_ms,
               o_orderpriority || ' ' || o_orderstatus AS summary,
               '["' || o_orderpriority || '", "' || o_orderstatus || '"]' AS tags_json,
               'style ' || o_orderstatus AS visual_style,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'line ' || o_orderkey END AS transcript,
               o_orderkey % 13 = 0 AS is_op, o_orderkey % 17 = 0 AS is_ed,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (1 + (o_orderkey * 7) % 10)::INTEGER END AS mad_score,
               (['action', 'emotional', 'atmospheric', 'dialogue', 'transition'])[left(o_orderpriority, 1)::INTEGER] AS scene_type
        FROM orders""",
    "turn_line": """
        SELECT song_id, turn, role, unnest(lines) AS text, generate_subscripts(lines, 1) AS pos
        FROM (SELECT conv_id AS song_id, turn, role,
                     list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS lines FROM conversations)""",
    "lyr": """
        SELECT song_id, row_number() OVER w - 1 AS line_no,
               1000 + 40 * (sum(length(text)) OVER w - length(text))::BIGINT AS start_ms,
               1000 + 40 * (sum(length(text)) OVER w)::BIGINT AS end_ms, text, role
        FROM turn_line WINDOW w AS (PARTITION BY song_id ORDER BY turn, pos ROWS UNBOUNDED PRECEDING)""",
    "song": "SELECT song_id, max(end_ms) AS duration_ms FROM lyr GROUP BY 1",
    "beat": "SELECT song_id, unnest(range(0, duration_ms + 1, 500)) AS beat_ms FROM song",
    "slot": f"""
        SELECT song_id, line_no AS slot_no, start_ms, end_ms, song_id + line_no // 2 AS video_id,
               {video_path('song_id + line_no // 2')} AS video_path,
               start_ms + 3000 + (line_no % 3) * 30 + (song_id % 5) * 60000 AS clip_start_ms, end_ms - start_ms AS clip_duration_ms,
               role = 'assistant' AS keep_audio, CASE WHEN role = 'user' THEN '' ELSE role END AS transcript,
               role AS speaker, CASE WHEN line_no % 5 = 4 THEN 'cross-fade' ELSE 'none' END AS transition,
               role = 'system' AS dialogue_independent
        FROM lyr WHERE text NOT LIKE '%,%'""",
    "clip": """
        SELECT song_id, slot_no AS clip_no, start_ms + 200 AS start_ms, end_ms + 400 AS end_ms, video_id, video_path,
               clip_start_ms + 100 AS clip_start_ms, clip_duration_ms + 200 AS clip_duration_ms,
               'say ' || slot_no AS transcript
        FROM slot WHERE speaker = 'user'""",
    "ranks": """
        SELECT song_id, line_no,
               [(song_id * 7919 + line_no * 104729 + r * 15485863) % ids FOR r IN range(5)] AS segment_ids
        FROM lyr, (SELECT max(o_orderkey) + 1000 AS ids FROM orders)""",
    "cand": """
        SELECT song_id, line_no, rank::INTEGER AS rank, song_id + (line_no * (rank + 2)) % 12 AS video_id,
               (line_no * 37 + rank * 101) % 120 * 500 AS t_ms
        FROM lyr, range(3) r(rank)""",
    "known_slot": "SELECT s.*, v.duration_ms AS video_duration_ms FROM slot s LEFT JOIN vid v USING (video_id)",
    "vec": """
        SELECT vec_id AS keyframe_id, label::BIGINT AS video_id, vec_id * 500 AS t_ms, embedding::DOUBLE[] AS vector
        FROM embeddings""",
    "files": f"""
        SELECT doc_id, n_chars AS size_bytes, unnest([
            '/lib/show' || (doc_id // 20) || '/Show - ' || lpad((doc_id % 20)::VARCHAR, 2, '0') || ' [v' || doc_id || ']'
              || ({_KINDS})[1 + src % 8],
            '/lib/show' || (doc_id // 20) || CASE WHEN lang = 'en' THEN '/subtitles' ELSE '' END || '/Show E'
              || lpad((doc_id % 20)::VARCHAR, 2, '0') || ' r' || src
              || ({_KINDS})[1 + (src + length(lang) + length(text)) % 8]]) AS path
        FROM (SELECT *, regexp_extract(source, '([0-9]+)$', 1)::INTEGER AS src FROM documents)""",
    "plan_line": """
        SELECT song_id, line_no AS "index",
               CASE role WHEN 'system' THEN 'Intro' WHEN 'user' THEN 'Verse' ELSE 'Final Chorus' END AS section_name,
               'mood ' || role AS mood_arc, CASE WHEN line_no % 4 = 0 THEN '' ELSE 'shot of ' || role END AS visual_prompt,
               CASE line_no % 3 WHEN 0 THEN '' WHEN 1 THEN 'high' ELSE 'low' END AS motion_preference,
               'concept ' || role AS narrative_concept, 'tender' AS emotional_tone
        FROM lyr WHERE contains(text, '.')""",
}


def with_tables(body: str, *, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every domain table it (or its own steps) reads."""
    steps = dict(extra or {})
    pool = {**CTES, **steps}
    chosen: list[str] = []

    def need(text: str, own: str | None = None) -> None:
        for name in pool:
            if name != own and name not in chosen and re.search(rf"\b{name}\b", text):
                need(pool[name], name)
                if name not in chosen:
                    chosen.append(name)

    need(body)
    ctes = ",\n".join(f"{n} AS ({pool[n]})" for n in chosen)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}" if ctes else body
