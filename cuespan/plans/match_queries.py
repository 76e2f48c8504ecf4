"""Candidates: eligibility, ranking lists, nearest joins, retrieval, annotation, model calls."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cuespan.functions.payload import text_list
from cuespan.functions import keys as K
from cuespan.functions import vectors as V
from cuespan.operators import annotate as A
from cuespan.operators import inference as J
from cuespan.operators import match as M
from cuespan.operators import ranking as R
from cuespan.plans import fixtures as X
from cuespan.plans.fixtures_sql import with_tables
from cuespan.plans.registry import ORACLES, query

OPENING = ('"k": 7}', '"k": 8}')
ENDING = ('"k": 17}', '"k": 91}')

STEPS = {
    "eligible": "SELECT * FROM seg WHERE coalesce(mad_score, 5) >= 6 AND NOT is_ed AND NOT is_op",
    "prompt_line": """
        SELECT l.song_id, l.line_no, coalesce(nullif(p.visual_prompt, ''), l.text) AS prompt,
               coalesce(nullif(p.motion_preference, ''), 'any') AS motion, l.text AS lyric,
               coalesce(p.narrative_concept, '') AS concept, coalesce(p.emotional_tone, '') AS tone
        FROM lyr l LEFT JOIN plan_line p ON p.song_id = l.song_id AND p."index" = l.line_no""",
    "prompt_key": """
        SELECT *, md5(trim(prompt) || ' | ' || motion || ' | op=False | lyric=' || lyric || ' | concept=' || concept
                      || ' | tone=' || tone) AS query_hash FROM prompt_line""",
    "opened": "SELECT song_id, line_no FROM lyr WHERE line_no = 0",
    "rank_item": "SELECT song_id, line_no, unnest(segment_ids) AS segment_id, generate_subscripts(segment_ids, 1) - 1 AS pos FROM ranks",
    "marked": """
        SELECT s.*, coalesce(s.start_ms + s.end_ms BETWEEN 2 * op_at AND 2 * op_at + 184000, false) AS in_op,
               coalesce(s.start_ms + s.end_ms BETWEEN 2 * ed_at AND 2 * ed_at + 184000, false) AS in_ed, op_at, ed_at
        FROM seg s LEFT JOIN (
            SELECT video_id, min(start_ms) FILTER (text LIKE '%"k": 7}%' OR text LIKE '%"k": 8}%') AS op_at,
                   min(start_ms) FILTER (text LIKE '%"k": 17}%' OR text LIKE '%"k": 91}%') AS ed_at
            FROM cue GROUP BY 1) c USING (video_id)""",
    "theme_row": """
        SELECT video_id, segment_id, start_ms, 'op' AS kind FROM seg WHERE is_op
        UNION ALL SELECT video_id, segment_id, start_ms, 'ed' FROM seg WHERE is_ed""",
    "theme_start": "SELECT video_id, kind, min(start_ms) AS theme_ms FROM theme_row GROUP BY ALL",
    "donor": "SELECT r.*, r.start_ms - t.theme_ms AS rel FROM theme_row r JOIN theme_start t USING (video_id, kind)",
    "cue_vec": """
        SELECT keyframe_id AS cue_id, video_id, t_ms - 600 AS start_ms, t_ms + 600 AS end_ms, list_reverse(vector) AS cue_vector FROM vec""",
    "vec_item": """
        SELECT v.keyframe_id, v.vector, (v.keyframe_id * 37 % 120) / 10.0 AS motion_score,
               (SELECT arg_min(c.cue_vector, [c.start_ms, c.cue_id]) FROM cue_vec c
                WHERE c.video_id = v.video_id AND c.start_ms <= v.t_ms AND c.end_ms >= v.t_ms) AS cue_vector
        FROM vec v""",
    "vec_prompt": """
        SELECT keyframe_id AS prompt_id, vector, (['any', 'low', 'medium', 'high'])[(video_id % 4 + 1)::INTEGER] AS motion FROM vec""",
    "wanted": "SELECT *, CASE motion WHEN 'low' THEN 0.0 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 1.0 END::DOUBLE AS target FROM vec_prompt",
    "pair_score": """
        SELECT p.prompt_id, i.keyframe_id,
               round(1e6 * (list_dot_product(p.vector, i.vector)
                     * CASE WHEN p.target IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 0.3::DOUBLE * abs(least(i.motion_score::DOUBLE, 10.0) / 10.0 - p.target) END
                     + 0.3::DOUBLE * coalesce(list_dot_product(p.vector, i.cue_vector), 0.0)))::BIGINT AS score_micros
        FROM wanted p CROSS JOIN vec_item i""",
    "word": """
        SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents)
        WHERE word <> '' GROUP BY ALL""",
    "pool_word": """
        SELECT segment_id, ('0x' || left(md5(w), 2))::INTEGER % 64 AS dim, count(*) AS n
        FROM (SELECT segment_id, unnest(string_split(lower(summary || ' ' || transcript || ' shot of user'), ' ')) AS w FROM eligible)
        WHERE w <> '' GROUP BY ALL""",
    "prompt_word": """
        SELECT song_id * 1000000 + line_no AS prompt_id, ('0x' || left(md5(w), 2))::INTEGER % 64 AS dim, count(*) AS n
        FROM (SELECT song_id, line_no, unnest(string_split(lower(prompt || ' line ' || line_no), ' ')) AS w FROM prompt_line)
        WHERE w <> '' GROUP BY ALL""",
    "prompt_profile": "SELECT prompt_id, string_agg(dim || ':' || n, ' ' ORDER BY dim) AS form FROM prompt_word GROUP BY 1",
    "pool_profile": "SELECT segment_id, string_agg(dim || ':' || n, ' ' ORDER BY dim) AS form FROM pool_word GROUP BY 1",
    "prompt_form": "SELECT form, min(prompt_id) AS rep FROM prompt_profile GROUP BY 1",
    "pool_form": """
        SELECT form, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY segment_id) AS i FROM pool_profile)
        WHERE i <= 5""",
    "form_score": """
        SELECT p.prompt_id AS rep, w.segment_id, sum(p.n * w.n)::BIGINT AS score
        FROM prompt_word p JOIN pool_word w USING (dim)
        WHERE p.prompt_id IN (SELECT rep FROM prompt_form) AND w.segment_id IN (SELECT segment_id FROM pool_form)
        GROUP BY ALL""",
    "ranked_form": """
        SELECT rep, segment_id, score, row_number() OVER (PARTITION BY rep ORDER BY score DESC, segment_id) - 1 AS rank
        FROM (SELECT f.rep, q.segment_id, coalesce(s.score, 0) AS score
              FROM prompt_form f CROSS JOIN pool_form q LEFT JOIN form_score s ON s.rep = f.rep AND s.segment_id = q.segment_id)""",
}


def sql(body: str) -> str:
    return with_tables(body, extra=STEPS)


@query("eligible_segments", sql("SELECT segment_id, video_id, start_ms, end_ms, mad_score FROM eligible"))
def eligible_segments(spark, d):
    return M.eligible_segments(X.seg(spark, d)).select("segment_id", "video_id", "start_ms", "end_ms", "mad_score")


@query("seg_videos", sql("SELECT segment_id, video_id, original_path, proxy_path, duration_ms FROM seg JOIN vid USING (video_id)"))
def seg_videos(spark, d):
    return M.with_videos(X.seg(spark, d).select("segment_id", "video_id"), X.vid(spark, d))


@query("nearest_keyframe", sql("""
    SELECT s.segment_id, s.video_id, coalesce(k.keyframe_id, 9999 + s.segment_id) AS keyframe_id,
           coalesce(k.frame_path, '') AS frame_path, coalesce(k.motion_score, 0.0::DOUBLE) AS motion_score
    FROM seg s LEFT JOIN (
        SELECT segment_id, keyframe_id, frame_path, motion_score
        FROM (SELECT s.segment_id, k.*, row_number() OVER (PARTITION BY s.segment_id
                     ORDER BY abs(2 * k.t_ms - s.start_ms - s.end_ms), k.keyframe_id) AS i
              FROM seg s JOIN kf k USING (video_id)) WHERE i = 1) k USING (segment_id)"""))
def nearest_keyframe(spark, d):
    return M.nearest_keyframes(X.seg(spark, d).select("segment_id", "video_id", "start_ms", "end_ms"), X.kf(spark, d)).select(
        "segment_id", "video_id", "keyframe_id", "frame_path", "motion_score"
    )


@query("enrich_candidates", sql("""
    SELECT keyframe_id, video_id, t_ms, segment_id, segment_start_ms, transcript
    FROM (SELECT k.keyframe_id, k.video_id, k.t_ms, s.segment_id, s.start_ms AS segment_start_ms, s.transcript,
                 row_number() OVER (PARTITION BY k.keyframe_id ORDER BY s.start_ms, s.segment_id) AS i
          FROM kf k LEFT JOIN seg s ON s.video_id = k.video_id AND s.start_ms <= k.t_ms AND s.end_ms >= k.t_ms)
    WHERE i = 1"""))
def enrich_candidates(spark, d):
    hits = M.containing_segments(X.kf(spark, d).select("keyframe_id", "video_id", "t_ms"), X.seg(spark, d), ["transcript"])
    return hits.select(
        "keyframe_id", "video_id", "t_ms", F.col("segment.segment_id").alias("segment_id"),
        F.col("segment.start_ms").alias("segment_start_ms"), F.col("segment.transcript").alias("transcript"),
    )


@query("ranked_candidates", sql("""
    SELECT r.song_id, r.line_no, r.pos::INTEGER AS rank, r.segment_id, e.video_id, (100 - 10 * r.pos)::INTEGER AS score
    FROM rank_item r JOIN eligible e USING (segment_id)"""))
def ranked_candidates(spark, d):
    pool = M.eligible_segments(X.seg(spark, d)).select("segment_id", "video_id")
    return M.ranked_candidates(X.ranks(spark, d), pool, ["song_id", "line_no"]).select(
        "song_id", "line_no", "rank", "segment_id", "video_id", "score"
    )


@query("op_filter", sql("""
    SELECT r.song_id, r.line_no, (row_number() OVER (PARTITION BY r.song_id, r.line_no ORDER BY r.pos) - 1)::INTEGER AS rank, r.segment_id
    FROM rank_item r LEFT JOIN (SELECT segment_id FROM seg WHERE is_op) o USING (segment_id)
    LEFT JOIN opened a ON a.song_id = r.song_id AND a.line_no = r.line_no
    WHERE o.segment_id IS NULL OR a.line_no IS NOT NULL"""))
def op_filter(spark, d):
    key = ["song_id", "line_no"]
    first = X.lyr(spark, d).filter("line_no = 0")
    kept = M.drop_opening_ids(X.ranks(spark, d), X.seg(spark, d), first, key)
    return kept.select(*key, F.posexplode("segment_ids").alias("rank", "segment_id"))


@query("fallback_candidates", sql("""
    SELECT 'single' AS mode, (row_number() OVER (ORDER BY segment_id) - 1)::INTEGER AS rank, segment_id
    FROM (SELECT segment_id FROM eligible ORDER BY segment_id LIMIT 5)
    UNION ALL
    SELECT 'cut first', (row_number() OVER (ORDER BY segment_id) - 1)::INTEGER, segment_id
    FROM (SELECT * FROM seg WHERE mad_score >= 6 ORDER BY segment_id LIMIT 5) WHERE NOT is_ed AND NOT is_op"""))
def fallback_candidates(spark, d):
    seg = X.seg(spark, d)
    single = M.fallback_ids(seg).select(F.lit("single").alias("mode"), "rank", "segment_id")
    return single.unionByName(M.fallback_ids(seg, cut_first=True).select(F.lit("cut first").alias("mode"), "rank", "segment_id"))


@query("batches", sql("""
    SELECT song_id, line_no, (row_number() OVER (PARTITION BY song_id ORDER BY line_no) - 1) // 20 AS batch_no
    FROM lyr WHERE (song_id, line_no) NOT IN (SELECT (song_id, slot_no) FROM slot)"""))
def batches(spark, d):
    return M.line_batches(X.lyr(spark, d), X.slot(spark, d))


@query("build_prompts", sql("SELECT song_id, line_no, prompt, motion, lyric, concept, tone, query_hash FROM prompt_key"))
def build_prompts(spark, d):
    return M.with_match_key(M.build_prompts(X.lyr(spark, d), X.plan_line(spark, d)))


@query("l2_normalize", sql("""
    SELECT keyframe_id, array_to_string([round(1e6 * x / s)::BIGINT FOR x IN scaled], ',') AS unit_micros
    FROM (SELECT keyframe_id, scaled, sqrt(list_sum([x * x FOR x IN scaled])) AS s
          FROM (SELECT keyframe_id, [x * (1 + keyframe_id % 9) FOR x IN vector] AS scaled FROM vec))"""))
def l2_normalize(spark, d):
    scaled = F.transform(V.as_double(F.col("vector")), lambda x: x * (1 + F.col("keyframe_id") % 9))
    return X.vec(spark, d).select("keyframe_id", V.micro_text(V.l2_normalize(scaled)).alias("unit_micros"))


def _vector_prompts(spark, d):
    kinds = F.array(*[F.lit(m) for m in ("any", "low", "medium", "high")])
    return X.vec(spark, d).select(
        F.col("keyframe_id").alias("prompt_id"), "vector", F.element_at(kinds, (F.col("video_id") % 4 + 1).cast("int")).alias("motion")
    )


def _spoken_frames(spark, d):
    """Keyframe vectors with the vector of the cue said at that time."""
    v = X.vec(spark, d)
    cues = v.select(
        "video_id", F.col("keyframe_id").alias("segment_id"), (F.col("t_ms") - 600).alias("start_ms"),
        (F.col("t_ms") + 600).alias("end_ms"), F.reverse("vector").alias("cue_vector"),
    )
    hit = M.containing_segments(v, cues, ["cue_vector"])
    return hit.select(
        "keyframe_id", "vector", ((F.col("keyframe_id") * 37 % 120) / 10.0).alias("motion_score"),
        F.col("segment.cue_vector").alias("cue_vector"),
    )


@query("semantic_topk", sql("""
    SELECT prompt_id, keyframe_id, score_micros, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score_micros DESC, keyframe_id) - 1 AS rank FROM pair_score)
    WHERE rank < 5"""))
def semantic_topk(spark, d):
    return R.semantic_topk(_vector_prompts(spark, d), _spoken_frames(spark, d))


@query("semantic_topk_bounded", ORACLES["semantic_topk"])
def semantic_topk_bounded(spark, d):
    return R.semantic_topk_bounded(_vector_prompts(spark, d), _spoken_frames(spark, d), items_per_block=256).best


@query("rank_batch", sql("""
    SELECT p.prompt_id, r.segment_id, r.score * 1000000 AS score_micros, r.rank::INTEGER AS rank
    FROM prompt_profile p JOIN prompt_form f USING (form) JOIN ranked_form r ON r.rep = f.rep WHERE r.rank < 5"""))
def rank_batch(spark, d):
    prompts = M.build_prompts(X.lyr(spark, d), X.plan_line(spark, d)).select(
        (F.col("song_id") * 1_000_000 + F.col("line_no")).alias("prompt_id"),
        F.concat_ws(" ", "prompt", F.lit("line"), F.col("line_no").cast("string")).alias("words"),
    )
    pool = M.eligible_segments(X.seg(spark, d)).select(
        "segment_id", F.concat_ws(" ", "summary", "transcript", F.lit("shot of user")).alias("words")
    )
    embed = lambda df, key: J.embed_batch(df, "words", J.hashing_embedder).select(key, "vector")
    return J.rank_batch(embed(prompts, "prompt_id"), embed(pool, "segment_id"), R.dot_scorer)


def fixture_ranker(lines: list[dict]) -> str:
    """Replies for the check: each line's ids backwards, but not for the sixth; every third call of a song is no JSON."""
    if lines[0]["line_no"] // 20 % 3 == 1:
        return "sorry, no JSON"
    return "```json\n" + json.dumps({str(i): x["segment_ids"][::-1] for i, x in enumerate(lines) if i != 5}) + "\n```"


@query("rank_calls", sql("""
    SELECT song_id, line_no, (row_number() OVER (PARTITION BY song_id, line_no ORDER BY pos) - 1)::INTEGER AS rank, segment_id, answered
    FROM (SELECT song_id, line_no, answered, unnest(ids) AS segment_id, generate_subscripts(ids, 1) AS pos
          FROM (SELECT *, CASE WHEN answered THEN list_reverse(segment_ids) ELSE others END AS ids
                FROM (SELECT song_id, line_no, segment_ids, NOT (line_no // 20 % 3 = 1 OR line_no % 20 = 5) AS answered FROM ranks),
                     (SELECT list(segment_id ORDER BY segment_id) AS others FROM (SELECT segment_id FROM eligible ORDER BY segment_id LIMIT 5))))
    LEFT JOIN (SELECT segment_id, true AS opening FROM seg WHERE is_op) o USING (segment_id)
    LEFT JOIN (SELECT song_id, line_no, true AS may FROM opened) a USING (song_id, line_no)
    WHERE opening IS NULL OR may"""))
def rank_calls(spark, d):
    lines, seg = X.lyr(spark, d), X.seg(spark, d)
    prompts = M.build_prompts(lines, X.plan_line(spark, d)).select("song_id", "line_no", "prompt")
    found = J.rank_calls(prompts, X.ranks(spark, d), seg, lines.filter("line_no = 0"), fixture_ranker, pause=lambda s: None)
    return found.select("song_id", "line_no", F.posexplode("segment_ids").alias("rank", "segment_id"), "answered")


@query("embed_batch", sql("""
    SELECT doc_id, ('0x' || left(md5(word), 2))::INTEGER % 64 AS dim, sum(n)::BIGINT AS n FROM word GROUP BY ALL"""))
def embed_batch(spark, d):
    docs = J.embed_batch(X.table(spark, d, "documents").select("doc_id", "text"), "text", J.hashing_embedder)
    rows = docs.select("doc_id", F.posexplode("vector").alias("dim", "n"))
    return rows.filter("n > 0").select("doc_id", "dim", F.col("n").cast("bigint").alias("n"))


def fixture_annotator(row: dict) -> str:
    """Replies for the check: fenced JSON, plain JSON, broken text, or an error."""
    summary = row["summary"]
    if summary.startswith("1"):
        return '```json\n{"summary": "about ' + summary + '", "tags": ["a", "b"], "mad_score": 9}\n```'
    if summary.startswith("2"):
        return '{"summary": "plain", "scene_type": "action", "emotion_flow": "up"}'
    if summary.startswith("3"):
        raise RuntimeError("no answer")
    return "sorry, no JSON"


@query("annotate_batch", sql("""
    SELECT segment_id, left(summary, 1) IN ('1', '2') AS answered,
           CASE left(summary, 1) WHEN '1' THEN 'about ' || summary WHEN '2' THEN 'plain'
             ELSE 'Segment ' || ((start_ms + 50) // 100) // 10 || '.' || ((start_ms + 50) // 100) % 10 || 's - '
                  || ((end_ms + 50) // 100) // 10 || '.' || ((end_ms + 50) // 100) % 10 || 's' END AS label,
           CASE left(summary, 1) WHEN '1' THEN 'a|b' ELSE '' END AS tags,
           CASE left(summary, 1) WHEN '1' THEN 9 ELSE 5 END::INTEGER AS mad_score,
           CASE left(summary, 1) WHEN '2' THEN 'action' ELSE 'dialogue' END AS scene_type,
           CASE left(summary, 1) WHEN '1' THEN '' WHEN '2' THEN 'up' ELSE 'neutral' END AS emotion_flow
    FROM seg"""))
def annotate_batch(spark, d):
    seg = X.seg(spark, d).select("segment_id", "start_ms", "end_ms", "summary")
    a = J.annotate_batch(seg, fixture_annotator, pause=lambda s: None)
    return a.select(
        "segment_id", "answered", F.col("annotation.summary").alias("label"), F.array_join("annotation.tags", "|").alias("tags"),
        "annotation.mad_score", "annotation.scene_type", "annotation.emotion_flow",
    )


@query("mark_op_ed", sql("""
    SELECT segment_id, in_op AS is_op, NOT in_op AND in_ed AS is_ed,
           CASE WHEN in_op THEN start_ms - op_at WHEN in_ed THEN start_ms - ed_at ELSE 0 END AS relative_ms FROM marked"""))
def mark_op_ed(spark, d):
    seg = X.seg(spark, d).select("segment_id", "video_id", "start_ms", "end_ms")
    return A.mark_themes(seg, X.cue(spark, d), opening=OPENING, ending=ENDING).select("segment_id", "is_op", "is_ed", "relative_ms")


@query("op_starts", sql("SELECT video_id, kind, theme_ms FROM theme_start"))
def op_starts(spark, d):
    return A.theme_starts(X.seg(spark, d))


REUSE_SQL = """
    SELECT a.segment_id, a.kind, a.rel AS relative_ms, min(b.segment_id) AS donor_id
    FROM (SELECT d.* FROM donor d JOIN seg s USING (segment_id) WHERE d.kind = CASE WHEN s.is_op THEN 'op' ELSE 'ed' END) a
    LEFT JOIN donor b ON b.kind = a.kind AND b.video_id <> a.video_id AND abs(b.rel - a.rel) < 1500
    GROUP BY ALL"""


def _marked_by_flag(spark, d):
    seg = X.seg(spark, d)
    kind = F.when(F.col("is_op"), "op").otherwise("ed")
    flagged = seg.filter(F.col("is_op") | F.col("is_ed")).withColumn("kind", kind)
    rows = flagged.join(A.theme_starts(seg), ["video_id", "kind"])
    return rows.withColumn("relative_ms", F.col("start_ms") - F.col("theme_ms")).select(
        "segment_id", "video_id", "is_op", "is_ed", "relative_ms"
    )


@query("reuse_annotations", sql(f"""
    SELECT r.segment_id, r.kind, r.relative_ms, r.donor_id, s.summary AS donor_summary, s.mad_score AS donor_mad_score
    FROM ({REUSE_SQL}) r LEFT JOIN seg s ON s.segment_id = r.donor_id"""))
def reuse_annotations(spark, d):
    found = A.reuse_annotations(_marked_by_flag(spark, d), X.seg(spark, d), ["summary", "mad_score"])
    return found.select("segment_id", "kind", "relative_ms", "donor_id", "donor_summary", "donor_mad_score")


@query("reuse_all_fields", sql(f"""
    SELECT r.segment_id, r.donor_id, s.summary AS donor_summary, replace(replace(replace(s.tags_json, '["', ''), '"]', ''), '", "', '|') AS donor_tags,
           s.visual_style AS donor_visual_style, CASE WHEN s.segment_id % 2 = 0 THEN 'high' ELSE 'low' END AS donor_motion_intensity,
           s.scene_type || '|' || s.segment_id AS donor_key_objects, 'from ' || s.scene_type AS donor_emotion_flow
    FROM ({REUSE_SQL}) r JOIN seg s ON s.segment_id = r.donor_id"""))
def reuse_all_fields(spark, d):
    """All fields that an annotation copies, lists included."""
    seg = X.seg(spark, d).withColumns({
        "tags": text_list(F.col("tags_json")), "motion_intensity": F.when(F.col("segment_id") % 2 == 0, "high").otherwise("low"),
        "key_objects": F.array("scene_type", F.col("segment_id").cast("string")), "emotion_flow": F.concat(F.lit("from "), F.col("scene_type")),
    })
    found = A.reuse_annotations(_marked_by_flag(spark, d), seg, A.COPIED).where("donor_id IS NOT NULL")
    lists = {f"donor_{f}": F.array_join(f"donor_{f}", "|") for f in ("tags", "key_objects")}
    return found.withColumns(lists).select("segment_id", "donor_id", *(f"donor_{f}" for f in A.COPIED))


@query("annotation_union", sql(f"""
    SELECT s.segment_id, CASE WHEN r.donor_id IS NOT NULL THEN 'reused' WHEN left(s.summary, 1) IN ('1', '2') THEN 'fresh' ELSE 'placeholder' END AS source,
           CASE WHEN r.donor_id IS NOT NULL THEN ds.summary WHEN left(s.summary, 1) = '1' THEN 'about ' || s.summary
                WHEN left(s.summary, 1) = '2' THEN 'plain'
                ELSE 'Segment ' || ((s.start_ms + 50) // 100) // 10 || '.' || ((s.start_ms + 50) // 100) % 10 || 's - '
                  || ((s.end_ms + 50) // 100) // 10 || '.' || ((s.end_ms + 50) // 100) % 10 || 's' END AS label,
           CASE WHEN r.donor_id IS NOT NULL THEN ds.mad_score WHEN left(s.summary, 1) = '1' THEN 9 ELSE 5 END::INTEGER AS mad_score,
           CASE WHEN r.donor_id IS NOT NULL THEN ds.scene_type WHEN left(s.summary, 1) = '2' THEN 'action' ELSE 'dialogue' END AS scene_type
    FROM seg s LEFT JOIN (SELECT * FROM ({REUSE_SQL}) WHERE donor_id IS NOT NULL) r USING (segment_id)
    LEFT JOIN seg ds ON ds.segment_id = r.donor_id"""))
def annotation_union(spark, d):
    seg = X.seg(spark, d)
    donors = A.reuse_annotations(_marked_by_flag(spark, d), seg, ["summary", "mad_score", "scene_type"]).filter("donor_id IS NOT NULL")
    asked = seg.select("segment_id", "start_ms", "end_ms", "summary").join(donors.select("segment_id"), "segment_id", "left_anti")
    fresh = J.annotate_batch(asked, fixture_annotator, pause=lambda s: None)
    fresh = fresh.filter("answered").select("segment_id", "annotation")
    empty = F.array().cast("array<string>")
    reused = donors.select("segment_id", F.struct(
        F.col("donor_summary").alias("summary"), empty.alias("tags"), F.lit("").alias("visual_style"),
        F.lit("").alias("motion_intensity"), empty.alias("key_objects"), F.lit("").alias("emotion_flow"),
        F.col("donor_mad_score").alias("mad_score"), F.col("donor_scene_type").alias("scene_type")).alias("annotation"))
    rows = A.annotation_rows(seg.select("segment_id", "start_ms", "end_ms"), reused, fresh)
    return rows.select("segment_id", "source", F.col("annotation.summary").alias("label"), "annotation.mad_score", "annotation.scene_type")
