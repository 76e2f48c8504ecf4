"""Overviews, scalar helpers, caches and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.functions import keys as K
from cuespan.functions import payload as P
from cuespan.functions import text as T
from cuespan.functions import timecode as C
from cuespan.operators import caches as CA
from cuespan.operators import match as M
from cuespan.operators import overview as O
from cuespan.operators.scans import positions
from cuespan.plans import fixtures as X
from cuespan.plans.fixtures_sql import WS, with_tables
from cuespan.plans.match_queries import STEPS as MATCH_STEPS
from cuespan.plans.registry import query
from cuespan.sources import setups
from cuespan.streaming import jobs

STEPS = {
    **MATCH_STEPS,
    "cached": "SELECT DISTINCT query_hash, 'old ' || query_hash AS payload, 1::BIGINT AS created_at FROM prompt_key WHERE contains(lyric, 'e')",
    "offered": "SELECT query_hash, CASE WHEN line_no % 4 = 0 THEN '' ELSE 'new ' || song_id || '-' || line_no END AS payload, 2 + line_no AS created_at FROM prompt_key",
    "save": r"SELECT props || CASE WHEN event_id % 2 = 0 THEN '!*' ELSE '' END AS name, event_id AS saved_at, event_type AS payload FROM events",
    "log_line": """
        SELECT video_id AS job_id, keyframe_id AS seq, chr(27) || '[32m' || CASE WHEN keyframe_id % 4 = 0 THEN 'starting ' || event_type
               ELSE (keyframe_id % 101) || '% ' || event_type END || chr(27) || '[0m' AS line FROM frames""",
}


def sql(body: str) -> str:
    return with_tables(body, extra=STEPS)


@query("material_overview", sql("""
    SELECT position::INTEGER AS position, scene_type, '- ' || scene_type || '（' || label || '）：' || string_agg(left(summary, 50), '；' ORDER BY i) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY scene_type ORDER BY mad_score DESC, segment_id) AS i FROM seg WHERE mad_score >= 7)
    JOIN (VALUES (1, 'emotional', '情感特写'), (2, 'atmospheric', '氛围空镜'), (3, 'action', '高动能动作'), (4, 'dialogue', '日常对话/互动')) v(position, scene_type, label) USING (scene_type)
    WHERE i <= 5 AND summary <> '' GROUP BY position, scene_type, label"""))
def material_overview(spark, d):
    return O.material_overview(X.seg(spark, d))


@query("top_dialogue", sql("""
    SELECT segment_id, transcript, summary, coalesce(mad_score, 5)::INTEGER AS mad_score FROM seg
    WHERE scene_type = 'emotional' AND transcript <> '' ORDER BY seg.mad_score DESC NULLS LAST, segment_id LIMIT 15"""))
def top_dialogue(spark, d):
    return O.top_dialogue(X.seg(spark, d))


@query("library_profile", sql("""
    SELECT 'video' AS kind, (row_number() OVER (ORDER BY video_id) - 1)::INTEGER AS position, '- ' || regexp_extract(original_path, '([^/]*)$', 1) AS line
    FROM (SELECT * FROM vid ORDER BY video_id LIMIT 10)
    UNION ALL
    SELECT 'scene', (row_number() OVER (ORDER BY segment_id) - 1)::INTEGER, 'Scene: ' || summary || ' | Style: ' || visual_style || ' | Tags: ' || array_to_string(from_json(tags_json, '["VARCHAR"]'), ', ')
    FROM (SELECT * FROM seg ORDER BY segment_id LIMIT 30)"""))
def library_profile(spark, d):
    return O.library_profile(X.vid(spark, d), X.seg(spark, d).withColumn("tags", P.text_list(F.col("tags_json"))))


@query("sections", sql("""
    SELECT song_id, section_name, min("index") AS first_index, arg_min(mood_arc, "index") AS mood_arc, arg_min(narrative_concept, "index") AS narrative_concept, 'slow' AS visual_pacing
    FROM plan_line GROUP BY song_id, section_name"""))
def sections(spark, d):
    return O.sections(X.plan_line(spark, d).withColumn("visual_pacing", F.lit("slow")))


def _plan_documents(spark, d):
    """Script plans as fenced JSON replies, one per song section; the second of three lines has no index."""
    p = X.plan_line(spark, d)
    line = F.struct(
        F.when(F.col("index") % 3 != 1, F.col("index")).alias("index"), F.col("section_name").alias("lyric"), "visual_prompt", "motion_preference", "emotional_tone"
    )
    parts = p.groupBy("song_id", "section_name", "mood_arc", "narrative_concept").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("index").alias("at"), line.alias("line")))), lambda x: x.line).alias("lines")
    )
    body = F.to_json(F.struct(F.array(F.struct("section_name", "mood_arc", "narrative_concept", "lines")).alias("sections")))
    return parts.select("song_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))


@query("plan_flatten", sql("""
    SELECT song_id, CASE WHEN "index" % 3 = 1 THEN 0 ELSE "index" END AS "index", section_name, mood_arc, narrative_concept, '' AS visual_pacing, visual_prompt, emotional_tone FROM plan_line"""))
def plan_flatten(spark, d):
    plans = _plan_documents(spark, d).withColumn("plan", F.from_json(P.unfenced(F.col("reply")), O.PLAN_SCHEMA))
    rows = O.flatten_plan(plans, F.col("plan"))
    return rows.select("song_id", "index", "section_name", "mood_arc", "narrative_concept", "visual_pacing", "visual_prompt", "emotional_tone")


@query("setups_latest", sql(rf"""
    SELECT name, max(saved_at) AS saved_at, arg_max(payload, saved_at) AS payload
    FROM (SELECT CASE WHEN n = '' THEN 'default' ELSE n END AS name, saved_at, payload
          FROM (SELECT *, regexp_replace(regexp_replace(name, '[^\p{{L}}\p{{N}}_{WS[1:-1]}\x{{4e00}}-\x{{9fa5}}\-]', '', 'g'), '^{WS}+|{WS}+$', '', 'g') AS n FROM save)) GROUP BY name"""))
def setups_latest(spark, d):
    ev = X.table(spark, d, "events")
    name = F.concat("props", F.when(F.col("event_id") % 2 == 0, "!*").otherwise(""))
    return setups.latest_setups(ev.select(name.alias("name"), F.col("event_id").alias("saved_at"), F.col("event_type").alias("payload")))


@query("ordered_listing", sql("SELECT video_id, cue_id, start_ms, row_number() OVER (ORDER BY video_id, start_ms, cue_id) - 1 AS position FROM cue"))
def ordered_listing(spark, d):
    """A total order over all cues, ranged over the cluster, with positions from per-range counts."""
    return positions(X.cue(spark, d).select("video_id", "cue_id", "start_ms"), ["video_id", "start_ms", "cue_id"], C.idiv(F.col("start_ms"), 600_000))


@query("path_parts", sql(r"""
    SELECT video_id, regexp_extract(original_path, '([^/\\]*)$', 1) AS name, regexp_extract(original_path, '([^/]*)\.[^./]*$', 1) AS stem, '.mkv' AS extension,
           regexp_replace(original_path, '/[^/]*$', '') AS folder, '/r/' || regexp_extract(original_path, '([^/]*)\.[^./]*$', 1) || '_render.mp4' AS render, 'a' || video_id || '.b.mp4' AS mixed FROM vid"""))
def path_parts(spark, d):
    p = F.col("original_path")
    mixed = T.file_name(F.concat(F.lit("x/y\\a"), F.col("video_id").cast("string"), F.lit(".b.mp4")))
    return X.vid(spark, d).select(
        "video_id", T.file_name(p).alias("name"), T.stem(p).alias("stem"), T.extension(p).alias("extension"), T.folder_of(p).alias("folder"),
        T.render_name(p, "/r").alias("render"), mixed.alias("mixed"),
    )


@query("trim_names", sql("""
    SELECT song_id, line_no, 'song' || song_id || '_trimmed_' || (start_ms // 1000) || '_' || (end_ms // 1000) || '.mp3' AS name FROM lyr"""))
def trim_names(spark, d):
    old = F.when(F.col("line_no") % 2 == 0, "_trimmed_1_2").otherwise("")
    path = F.concat(F.lit("/music/song"), F.col("song_id").cast("string"), old, F.lit(".mp3"))
    return X.lyr(spark, d).select("song_id", "line_no", T.trimmed_name(path, F.col("start_ms"), F.col("end_ms")).alias("name"))


@query("scalars_time", sql("""
    SELECT keyframe_id, format('[{:02d}:{:02d}.{:02d}]', t_ms // 60000, t_ms % 60000 // 1000, t_ms % 1000 // 10) AS tag,
           format('{:02d}:{:02d}.{:d}', t_ms // 60000, t_ms % 60000 // 1000, t_ms % 1000 // 100) AS clock, (t_ms * 24 + 500) // 1000 AS frames,
           t_ms AS parsed, 1000 + (t_ms - 250 - 40) AS clip_ms, keyframe_id % 900 > 450 AS resync,
           greatest(0.0::DOUBLE, least(1.0::DOUBLE, motion_score - 1.0)) AS volume,
           CASE keyframe_id % 4 WHEN 0 THEN 24000 / 1001.0::DOUBLE WHEN 1 THEN 30.0 WHEN 2 THEN 25.0 ELSE 30.0 END AS fps
    FROM kf"""))
def scalars_time(spark, d):
    t = F.col("t_ms")
    text = F.concat_ws(":", C.idiv(t, 3_600_000).cast("string"), C.idiv(t % 3_600_000, 60_000).cast("string"), ((t % 60_000) / 1000.0).cast("string"))
    rates = F.array(*[F.lit(r) for r in ("24000/1001", "30/0", "25", "fast")])
    return X.kf(spark, d).select(
        "keyframe_id", C.lrc_tag(t).alias("tag"), C.player_clock(t).alias("clock"), C.frames_of(t).alias("frames"), C.clock_to_ms(text).alias("parsed"),
        C.clip_time(F.lit(1000).cast("bigint"), F.lit(40), F.lit(250), t).alias("clip_ms"),
        C.needs_resync(F.col("keyframe_id") % 900 + t, t).alias("resync"), C.unit_volume(F.col("motion_score") - 1.0).alias("volume"),
        P.rate(F.element_at(rates, (F.col("keyframe_id") % 4 + 1).cast("int"))).alias("fps"),
    )


@query("scalars_keys", sql("""
    SELECT song_id, md5(string_agg(text, '' ORDER BY line_no)) AS vision_key,
           md5('[' || string_agg('"' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"', ', ' ORDER BY line_no) || ']') AS outline_key,
           md5(min(text) || '_1.5_2.0_1.0') AS media_key
    FROM lyr GROUP BY 1""".replace("\\\\", "\\")))
def scalars_keys(spark, d):
    lines = X.lyr(spark, d)
    keys = CA.streamed_md5(lines, "song_id", "line_no", {
        "vision_key": (F.col("text"), "", "", ""), "outline_key": (K.json_text(F.col("text")), "[", ", ", "]"),
    })
    low = lines.groupBy("song_id").agg(F.min("text").alias("low"))
    media = low.select("song_id", K.media_key(F.col("low"), F.lit(1.5), F.lit(2.0), F.lit(1.0)).alias("media_key"))
    return keys.join(media, "song_id")


@query("scalars_json", sql("""
    SELECT segment_id, CASE k WHEN 0 THEN summary WHEN 1 THEN '' WHEN 2 THEN NULL ELSE summary END AS label, CASE k WHEN 2 THEN NULL WHEN 3 THEN '' ELSE 'x|y' END AS tags,
           CASE k WHEN 2 THEN NULL WHEN 0 THEN (ARRAY[8, 9, 8, 7])[(segment_id // 4) % 4 + 1] ELSE 5 END::INTEGER AS mad_score, CASE WHEN k = 2 THEN NULL ELSE 'medium' END AS motion_intensity
    FROM (SELECT *, segment_id % 4 AS k FROM seg)"""))
def scalars_json(spark, d):
    k, text = F.col("segment_id") % 4, F.col("summary")
    score = F.element_at(F.array(*map(F.lit, ("8", '"9"', "8.7", '"7.0"'))), (F.floor(F.col("segment_id") / 4) % 4 + 1).cast("int"))
    reply = (
        F.when(k == 0, F.concat(F.lit('```json\n{"summary": "'), text, F.lit('", "tags": ["x", "y"], "mad_score": '), score, F.lit("}\n```")))
        .when(k == 1, '{"tags": ["x", "y"]}').when(k == 2, "none").otherwise(F.concat(F.lit('{"summary": "'), text, F.lit('"}')))
    )
    a = P.parsed_annotation(F.col("reply"))
    rows = X.seg(spark, d).select("segment_id", reply.alias("reply")).select("segment_id", a.alias("a"))
    return rows.select(
        "segment_id", F.col("a.summary").alias("label"), F.array_join("a.tags", "|").alias("tags"), "a.mad_score", "a.motion_intensity"
    )


@query("scalars_text", sql("""
    SELECT video_id, 'file://localhost' || replace(replace(replace(original_path, ' ', '%20'), '[', '%5B'), ']', '%5D') AS url,
           'file://localhost/C%3A/a%20b' || video_id || '.mp4' AS drive_url, '&lt;' || video_id || '&gt; &amp; "q"' AS xml,
           CASE WHEN video_id % 2 = 0 THEN video_id % 101 END::INTEGER AS percent, CASE WHEN video_id % 2 = 0 THEN (3000 + video_id % 101 * 65) // 100 END::INTEGER AS overall FROM vid"""))
def scalars_text(spark, d):
    n = F.col("video_id").cast("string")
    esc = "\x1b[1;32m"
    line = F.when(F.col("video_id") % 2 == 0, F.concat(F.lit(esc), (F.col("video_id") % 101).cast("string"), F.lit("%  going on \n"))).otherwise("no number")
    done = T.progress(line)
    return X.vid(spark, d).select(
        "video_id", K.file_url(F.col("original_path")).alias("url"), K.file_url(F.concat(F.lit("C:\\a b"), n, F.lit(".mp4"))).alias("drive_url"),
        K.xml_text(F.concat(F.lit("<"), n, F.lit('> & "q"'))).alias("xml"), done.percent.alias("percent"), done.overall.alias("overall"),
    )


def _prompts(spark, d):
    return M.with_match_key(M.build_prompts(X.lyr(spark, d), X.plan_line(spark, d)))


def _cache(spark, d):
    known = _prompts(spark, d).filter(F.col("lyric").contains("e")).select("query_hash").distinct()
    return known.select("query_hash", F.concat(F.lit("old "), "query_hash").alias("payload"), F.lit(1).cast("bigint").alias("created_at"))


def _computed(spark, d):
    made = F.when(F.col("line_no") % 4 == 0, "").otherwise(F.concat(F.lit("new "), F.concat_ws("-", F.col("song_id").cast("string"), F.col("line_no").cast("string"))))
    return _prompts(spark, d).select("query_hash", made.alias("payload"), (2 + F.col("line_no")).alias("created_at"))


@query("cache_hit_miss", sql("""
    SELECT song_id, line_no, p.query_hash, c.query_hash IS NOT NULL AS hit FROM prompt_key p LEFT JOIN cached c USING (query_hash)"""))
def cache_hit_miss(spark, d):
    prompts, cache = _prompts(spark, d).select("song_id", "line_no", "query_hash"), _cache(spark, d)
    hits = CA.cache_hits(prompts, cache.select("query_hash")).withColumn("hit", F.lit(True))
    return hits.unionByName(CA.cache_misses(prompts, cache).withColumn("hit", F.lit(False)))


@query("match_results", sql("""
    SELECT song_id, line_no, coalesce(c.payload, 'found ' || p.query_hash) AS payload, c.query_hash IS NOT NULL AS from_cache FROM prompt_key p LEFT JOIN cached c USING (query_hash)"""))
def match_results(spark, d):
    prompts = _prompts(spark, d).select("song_id", "line_no", "query_hash")
    computed = prompts.select("query_hash", F.concat(F.lit("found "), "query_hash").alias("payload"))
    return CA.match_results(prompts, _cache(spark, d), computed).select("song_id", "line_no", "payload", "from_cache")


@query("cache_upsert", sql("""
    SELECT query_hash, payload, created_at FROM cached WHERE query_hash NOT IN (SELECT query_hash FROM offered WHERE payload <> '')
    UNION ALL
    SELECT query_hash, payload, created_at FROM (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY created_at DESC, payload DESC) AS i FROM offered WHERE payload <> '') WHERE i = 1"""))
def cache_upsert(spark, d):
    return CA.cache_upsert(_cache(spark, d), _computed(spark, d), keep_empty=False)


@query("cache_clear", sql("SELECT count(*) AS cleared, 0::BIGINT AS kept FROM cached WHERE EXISTS (SELECT 1 FROM vid)"))
def cache_clear(spark, d):
    kept, dropped = CA.cache_clear(_cache(spark, d), X.vid(spark, d).select("video_id"))
    return dropped.withColumn("kept", kept.agg(F.count("*")).scalar())


@query("cascade_delete", sql("""
    SELECT 'keyframes' AS part, video_id, count(*) AS n FROM kf WHERE video_id NOT IN (SELECT video_id FROM vid WHERE duration_ms > 250000) GROUP BY ALL
    UNION ALL SELECT 'cues', video_id, count(*) FROM cue WHERE video_id NOT IN (SELECT video_id FROM vid WHERE duration_ms > 250000) GROUP BY ALL
    UNION ALL SELECT 'segments', video_id, count(*) FROM seg WHERE video_id NOT IN (SELECT video_id FROM vid WHERE duration_ms > 250000) GROUP BY ALL"""))
def cascade_delete(spark, d):
    """The longest videos are deleted."""
    gone = X.vid(spark, d).filter("duration_ms > 250000")
    left = CA.cascade_delete(gone, keyframes=X.kf(spark, d), cues=X.cue(spark, d), segments=X.seg(spark, d))
    parts = [df.groupBy("video_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("replace_children", sql("""
    SELECT video_id, cue_id, text FROM cue WHERE video_id NOT IN (SELECT video_id FROM cue WHERE contains(text, 'view'))
    UNION ALL SELECT video_id, cue_id, 'again ' || text FROM cue WHERE contains(text, 'view')"""))
def replace_children(spark, d):
    cues = X.cue(spark, d).select("video_id", "cue_id", "text")
    fresh = cues.filter(F.col("text").contains("view")).withColumn("text", F.concat(F.lit("again "), "text"))
    return CA.replace_children(cues, fresh)


@query("motion_windows", sql("""
    SELECT video_id, (t_ms // 10000) * 10000 AS window_ms, count(*) AS frames, round(avg(motion_score), 6) AS mean_motion, max(motion_score) AS max_motion FROM kf GROUP BY ALL"""))
def motion_windows(spark, d):
    return jobs.motion_windows(X.kf(spark, d)).select(
        "video_id", "window_ms", "frames", F.round("mean_motion", 6).alias("mean_motion"), "max_motion"
    )


def log_lines(spark, d):
    said = F.when(F.col("keyframe_id") % 4 == 0, F.concat(F.lit("starting "), "event_type")).otherwise(
        F.concat((F.col("keyframe_id") % 101).cast("string"), F.lit("% "), "event_type")
    )
    return X.frames(spark, d).select(
        F.col("video_id").alias("job_id"), F.col("keyframe_id").alias("seq"), F.concat(F.lit("\x1b[32m"), said, F.lit("\x1b[0m")).alias("line")
    )


@query("progress_latest", sql("""
    SELECT job_id, max(seq) AS seq, arg_max(seq % 101, seq)::INTEGER AS percent, ((3000 + 65 * arg_max(seq % 101, seq)) // 100)::INTEGER AS overall
    FROM log_line WHERE seq % 4 <> 0 GROUP BY 1"""))
def progress_latest(spark, d):
    return jobs.latest_progress(log_lines(spark, d)).select("job_id", "seq", "percent", "overall")


@query("stream_index", sql("""
    SELECT path, CASE WHEN r.path IS NULL THEN 'new' WHEN r.size_bytes <> f.size_bytes THEN 'changed' ELSE 'known' END AS state
    FROM (SELECT DISTINCT path, size_bytes FROM files WHERE regexp_matches(path, '\\.(mkv|MP4)$')) f
    LEFT JOIN (SELECT path, size_bytes + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size_bytes FROM files WHERE path LIKE '%.mkv') r USING (path)""".replace("\\\\", "\\")))
def stream_index(spark, d):
    """The .mkv files were indexed before; a third of them have changed since."""
    found = jobs.library_changes(
        X.files(spark, d).select("path", "size_bytes"),
        X.files(spark, d).filter(F.col("path").endswith(".mkv")).select("path", (F.col("size_bytes") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("size_bytes")),
    )
    return found.select("path", "state")
