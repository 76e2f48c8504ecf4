"""Corpus ingestion, library files and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.functions.text import CREDIT_WORDS, is_credit_line
from cuespan.functions.timecode import idiv
from cuespan.operators.scans import lead
from cuespan.plans import documents as D
from cuespan.plans import fixtures as X
from cuespan.plans.fixtures_sql import WS, with_tables
from cuespan.plans.registry import query
from cuespan.sources import decode, library, lyrics, subtitles, tables

RENDERS, BACKUPS = "/lib/renders", "/lib/backup"


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def hms(t: str, mark: str, digits: int) -> str:
    fraction = f"({t}) % 1000" if digits == 3 else f"({t}) % 1000 // 10"
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}{mark}{{:0{digits}d}}', ({t}) // 3600000, ({t}) % 3600000 // 60000, ({t}) % 60000 // 1000, {fraction})"


def mmss(t: str) -> str:
    return f"format('{{:02d}}:{{:02d}}.{{:02d}}', ({t}) // 60000, ({t}) % 60000 // 1000, ({t}) % 1000 // 10)"


def clock(expr: str) -> str:
    rx = r"^(\d+):(\d+):(\d+(?:\.\d*)?)(?::.*)?$"
    part = lambda i: f"regexp_extract({expr}, '{rx}', {i})"
    return (
        f"CASE WHEN regexp_matches({expr}, '{rx}') THEN {part(1)}::BIGINT * 3600000 + {part(2)}::BIGINT * 60000 "
        f"+ round({part(3)}::DOUBLE * 1000)::BIGINT END"
    )


WORDCH = r"\p{L}\p{N}_"
WSB = WS[1:-1]


def credit(text: str) -> str:
    words = "|".join(CREDIT_WORDS)
    low = f"lower({text})"
    return f"""({text} = '' OR (starts_with({low}, '[') AND ends_with({low}, ']'))
        OR regexp_matches({low}, '^[{WORDCH}{WSB}/]+{WS}+by{WS}*[：:]')
        OR (regexp_matches({low}, '^[{WORDCH}{WSB}]+{WS}+by([^{WORDCH}]|$)') AND contains({text}, '/'))
        OR starts_with({text}, '©') OR starts_with({text}, '℗')
        OR regexp_matches({low}, '^({words}){WS}*($|[:：/\\-])'))"""


T = "((i - 1) * 2350 + 1200)"
STEPS = {
    "doc_line": """
        SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n_lines
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)""",
    "credit_line": """
        SELECT doc_id, i, CASE length(line) % 8 WHEN 0 THEN '作词 ： ' || line WHEN 1 THEN string_split(line, ' ')[1] || ' by: ' || line
               WHEN 2 THEN '[' || line || ']' WHEN 3 THEN string_split(line, ' ')[1] || ' by A/' || line
               WHEN 4 THEN ' © ' || line WHEN 5 THEN 'Title - ' || line WHEN 6 THEN 'music ' || line ELSE line END AS line
        FROM doc_line""",
    "srt_block": f"""
        SELECT doc_id, i, line, i || chr(10) || CASE WHEN length(line) % 97 = 0 THEN '0x:00:01,000' ELSE {hms(T, ',', 3)} END
               || CASE WHEN length(line) % 7 = 0 THEN ' to ' ELSE ' --> ' END || {hms(T + ' + 1900', ',', 3)} || chr(10) || line AS one
        FROM doc_line""",
    "srt_doc": """
        SELECT doc_id, string_agg(CASE WHEN starts_with(line, 'T') THEN one || chr(13) || chr(10) || chr(13) || chr(10) || one ELSE one END,
                                  chr(13) || chr(10) || chr(13) || chr(10) ORDER BY i) AS text FROM srt_block GROUP BY 1""",
    "srt_raw": f"""
        SELECT doc_id, pos, string_split({trim('block')}, chr(10)) AS ls
        FROM (SELECT doc_id, unnest(bs) AS block, generate_subscripts(bs, 1) AS pos
              FROM (SELECT doc_id, string_split({trim("replace(text, chr(13) || chr(10), chr(10))")}, chr(10) || chr(10)) AS bs FROM srt_doc))""",
    "srt_timed": f"""
        SELECT doc_id, pos, {clock("replace(" + trim("string_split(ls[2], '-->')[1]") + ", ',', '.')")} AS start_ms,
               {clock("replace(" + trim("string_split(ls[2], '-->')[2]") + ", ',', '.')")} AS end_ms,
               {trim("array_to_string(ls[3:], ' ')")} AS text
        FROM srt_raw WHERE len(ls) >= 3 AND contains(ls[2], '-->')""",
    "srt_cue": """
        SELECT * FROM srt_timed t WHERE pos < coalesce((SELECT min(pos) FROM srt_timed b WHERE b.doc_id = t.doc_id
            AND (b.start_ms IS NULL OR b.end_ms IS NULL)), 1000000000)""",
    "ass_doc": f"""
        SELECT doc_id, '[Events]' || chr(10) || string_agg(
            CASE WHEN i % 2 = 1 THEN one || chr(10) || one ELSE one || chr(10) || 'Comment: 0,x' END, chr(10) ORDER BY i) AS text
        FROM (SELECT doc_id, i, 'Dialogue: 0,' || CASE WHEN length(line) % 13 = 0 THEN '0:0x:00.00' ELSE {hms(T, '.', 2)} END || ','
                     || {hms(T + ' + 1900', '.', 2)} || ',Default,,0,0,0,,' || '{{\\pos(1,2)}}' || replace(line, '. ', '\\N') AS one
              FROM doc_line) GROUP BY 1""",
    "ass_line": f"""
        SELECT doc_id, pos, {trim('line')} AS line
        FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ass_doc))""",
    "ass_field": r"""
        SELECT doc_id, pos, string_split(line, ',') AS f, regexp_extract(line, '^(?:[^,]*,){9}(.*)$', 1) AS body
        FROM ass_line WHERE starts_with(line, 'Dialogue:') AND regexp_matches(line, '^(?:[^,]*,){9}')""",
    "ass_cue": f"""
        SELECT * FROM (
            SELECT doc_id, pos, {clock(trim('f[2]'))} AS start_ms, {clock(trim('f[3]'))} AS end_ms,
                   {trim("regexp_replace(regexp_replace(" + trim('body') + ", '\\{.*?\\}', '', 'g'), '\\\\[Nnh]', ' ', 'g')")} AS text
            FROM ass_field) WHERE text <> '' AND start_ms IS NOT NULL AND end_ms IS NOT NULL""",
    "lrc_doc_line": f"""
        SELECT doc_id, i, n_lines, CASE length(line) % 5 WHEN 0 THEN '[' || {mmss(T)} || ']'
               WHEN 1 THEN '[' || {mmss(T)} || ']Written by: ' || line
               WHEN 2 THEN '[' || {mmss(T)} || '][' || {mmss(T + ' + 60000')} || '] ' || line
               ELSE '[' || {mmss(T)} || ']' || line END AS line FROM doc_line
        UNION ALL SELECT doc_id, 0, len(string_split(text, chr(10))), '[ar:someone]' FROM documents""",
    "lrc_doc": """
        SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, max(n_lines) * 2350 + 90000 AS duration_ms
        FROM lrc_doc_line GROUP BY 1""",
    "lrc_text_line": f"""
        SELECT doc_id, duration_ms, {trim('line')} AS line, pos
        FROM (SELECT doc_id, duration_ms, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
              FROM (SELECT doc_id, duration_ms, string_split(text, chr(10)) AS ls FROM lrc_doc))""",
    "lrc_timed": f"""
        SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, pos) AS nxt
        FROM (SELECT doc_id, pos, regexp_extract(line, '^\\[(\\d+):(\\d+(?:\\.\\d+)?)\\](.*)', 1)::BIGINT * 60000
                     + round(regexp_extract(line, '^\\[(\\d+):(\\d+(?:\\.\\d+)?)\\](.*)', 2)::DOUBLE * 1000)::BIGINT AS start_ms,
                     {trim("regexp_extract(line, '^\\[(\\d+):(\\d+(?:\\.\\d+)?)\\](.*)', 3)")} AS text
              FROM lrc_text_line WHERE regexp_matches(line, '^\\[(\\d+):(\\d+(?:\\.\\d+)?)\\]'))""",
    "lrc_cue": "SELECT doc_id, pos, start_ms, coalesce(nxt, start_ms + 4000) AS end_ms, text FROM lrc_timed WHERE text <> ''",
    "lyric_tag": f"""
        SELECT doc_id, duration_ms, pos, unnest(tags) AS tag, generate_subscripts(tags, 1) AS tag_no, text
        FROM (SELECT doc_id, duration_ms, pos, regexp_extract_all(line, '\\[\\d{{2}}:\\d{{2}}[.:](?:\\d{{2,3}})?\\]') AS tags,
                     {trim("regexp_replace(line, '\\[\\d{2}:\\d{2}[.:](?:\\d{2,3})?\\]', '', 'g')")} AS text FROM lrc_text_line)
        WHERE NOT {credit('text')}""",
    "lyric_lrc": """
        SELECT doc_id, row_number() OVER w - 1 AS line_no, start_ms,
               coalesce(lead(start_ms) OVER w, duration_ms) AS end_ms, text
        FROM (SELECT *, tag[2:3]::BIGINT * 60000 + tag[5:6]::BIGINT * 1000 +
                     CASE length(tag) WHEN 11 THEN tag[8:10]::BIGINT WHEN 10 THEN tag[8:9]::BIGINT * 10 ELSE 0 END AS start_ms
              FROM lyric_tag)
        WINDOW w AS (PARTITION BY doc_id ORDER BY start_ms, pos, tag_no)""",
    "txt_line": f"""
        SELECT doc_id, i, {trim('line')} AS text, n_lines * 2350 + 90001 AS d FROM doc_line
        UNION ALL SELECT doc_id, 0, 'Composed by A/B', len(string_split(text, chr(10))) * 2350 + 90001 FROM documents""",
    "lyric_txt": f"""
        SELECT doc_id, k AS line_no, ((k * d + 5 * n) // (10 * n)) * 10 AS start_ms, (((k + 1) * d + 5 * n) // (10 * n)) * 10 AS end_ms, text
        FROM (SELECT doc_id, text, d, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n
              FROM txt_line WHERE NOT {credit('text')})""",
    "subtitle_file": r"""
        SELECT path, CASE WHEN e1 <> '' THEN e1 WHEN e2 <> '' THEN e2 WHEN e3 <> '' THEN e3 END::INTEGER AS episode,
               CASE WHEN contains(low, '.chs.') OR contains(path, '简体') OR contains(low, 'sc') THEN 0
                    WHEN contains(low, '.cht.') OR contains(path, '繁体') OR contains(low, 'tc') THEN 1 ELSE 2 END AS script,
               regexp_replace(path, '/[^/]*$', '') AS folder
        FROM (SELECT DISTINCT path, lower(path) AS low, regexp_extract(base, '[eE](\d{1,2})', 1) AS e1,
                     regexp_extract(base, '-\s*(\d{1,2})', 1) AS e2, regexp_extract(base, '\b(\d{1,2})\b', 1) AS e3
              FROM (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base FROM files))
        WHERE regexp_matches(low, '\.(ass|srt|lrc)$')""",
    "video_episode": r"""
        SELECT video_id, regexp_replace(original_path, '/[^/]*$', '') AS folder,
               CASE WHEN e1 <> '' THEN e1 WHEN e2 <> '' THEN e2 END::INTEGER AS episode
        FROM (SELECT *, regexp_extract(base, '-\s*(\d{1,2})', 1) AS e1, regexp_extract(base, '\b(\d{1,2})\b', 1) AS e2
              FROM (SELECT *, regexp_extract(original_path, '([^/]*)$', 1) AS base FROM vid))""",
    "episode_hit": """
        SELECT video_id, path FROM (
            SELECT v.video_id, s.path, row_number() OVER (PARTITION BY v.video_id
                   ORDER BY s.script, CASE WHEN s.folder = v.folder THEN 1 ELSE 0 END, s.path) AS i
            FROM video_episode v JOIN subtitle_file s ON s.episode = v.episode
             AND (s.folder = v.folder OR s.folder = v.folder || '/subtitles')) WHERE i = 1""",
    "same_name": """
        SELECT video_id, path FROM (
            SELECT v.video_id, f.path, row_number() OVER (PARTITION BY v.video_id ORDER BY e.rank) AS i
            FROM vid v CROSS JOIN (SELECT unnest(['.srt', '.lrc', '.ass', '.chs.ass', '.cht.ass']) AS ext,
                                          generate_subscripts(['.srt', '.lrc', '.ass', '.chs.ass', '.cht.ass'], 1) AS rank) e
            JOIN (SELECT DISTINCT path FROM files) f ON f.path = left(v.original_path, length(v.original_path) - 4) || e.ext)
        WHERE i = 1""",
    "library_file": """
        SELECT path FROM files
        UNION ALL SELECT '/lib/renders/' || vstem || '_render.mp4' || CASE WHEN video_id % 3 = 0 THEN '.bak' ELSE '' END FROM vstem_t WHERE video_id % 4 <> 1
        UNION ALL SELECT '/lib/backup/' || vstem || '_render.mp4' FROM vstem_t WHERE video_id % 5 < 2""",
    "vstem_t": "SELECT video_id, regexp_extract(original_path, '([^/]*).mkv$', 1) AS vstem FROM vid",
}


def sql(body: str) -> str:
    return with_tables(body, extra=STEPS)


def deduped(step: str) -> str:
    return f"""
        SELECT doc_id, start_ms, end_ms, text
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, (start_ms + 50) // 100, text ORDER BY pos) AS k FROM {step}) WHERE k = 1"""


CUE = ("doc_id", "start_ms", "end_ms", "text")


@query("srt_ingest", sql(deduped("srt_cue")))
def srt_ingest(spark, d):
    return subtitles.ingest_srt(D.srt_docs(spark, d)).select(*CUE)


@query("ass_ingest", sql(deduped("ass_cue")))
def ass_ingest(spark, d):
    return subtitles.ingest_ass(D.ass_docs(spark, d)).select(*CUE)


@query("lrc_cues", sql(deduped("lrc_cue")))
def lrc_cues(spark, d):
    return subtitles.ingest_lrc_cues(D.lrc_docs(spark, d)).select(*CUE)


@query("lyrics_lrc", sql("SELECT doc_id, line_no, start_ms, end_ms, text FROM lyric_lrc"))
def lyrics_lrc(spark, d):
    return lyrics.ingest_lyrics_lrc(D.lrc_docs(spark, d))


@query("lyrics_txt", sql("SELECT doc_id, line_no, start_ms, end_ms, text FROM lyric_txt"))
def lyrics_txt(spark, d):
    return lyrics.ingest_lyrics_txt(D.txt_docs(spark, d))


@query("lyrics_routed", sql("""
    SELECT l.doc_id, line_no, start_ms, end_ms, l.text FROM lyric_lrc l JOIN documents d USING (doc_id) WHERE lang IN ('en', 'es')
    UNION ALL SELECT l.doc_id, line_no, start_ms, end_ms, l.text FROM lyric_txt l JOIN documents d USING (doc_id) WHERE lang NOT IN ('en', 'es')"""))
def lyrics_routed(spark, d):
    return lyrics.route_lyrics(D.lyric_docs(spark, d))


@query("decode_corpus", "SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def decode_corpus(spark, d):
    """English text as UTF-8, all other as UTF-16."""
    docs = X.table(spark, d, "documents")
    raw = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16"))
    text = decode.decode_corpus(docs.select("doc_id", raw.alias("content")))
    return text.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query("metadata_lines", sql(f"SELECT doc_id, i, {credit('text')} AS is_credit FROM (SELECT doc_id, i, {trim('line')} AS text FROM credit_line)"))
def metadata_lines(spark, d):
    rows = D._lines(spark, d).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    n = F.length("line")
    shown = _credit_variant(n)
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("i"), is_credit_line(shown).alias("is_credit"))


def _credit_variant(n):
    line = F.col("line")
    head = F.element_at(F.split(line, " "), 1)
    return (
        F.when(n % 8 == 0, F.concat(F.lit("作词 ： "), line)).when(n % 8 == 1, F.concat(head, F.lit(" by: "), line))
        .when(n % 8 == 2, F.concat(F.lit("["), line, F.lit("]"))).when(n % 8 == 3, F.concat(head, F.lit(" by A/"), line))
        .when(n % 8 == 4, F.concat(F.lit(" © "), line)).when(n % 8 == 5, F.concat(F.lit("Title - "), line))
        .when(n % 8 == 6, F.concat(F.lit("music "), line)).otherwise(line)
    )


@query("cue_dedup", sql("""
    SELECT video_id, min(cue_id) AS cue_id, (start_ms + 50) // 100 AS tenth, text FROM cue GROUP BY ALL"""))
def cue_dedup(spark, d):
    cues = X.cue(spark, d).select("video_id", F.col("cue_id").alias("pos"), "start_ms", "text")
    kept = subtitles.drop_repeats(cues, "video_id")
    return kept.select("video_id", F.col("pos").alias("cue_id"), idiv(F.col("start_ms") + 50, 100).alias("tenth"), "text")


@query("line_ends", sql("""
    SELECT l.song_id, line_no, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY song_id ORDER BY start_ms, line_no), duration_ms) AS end_ms
    FROM lyr l JOIN song USING (song_id)"""))
def line_ends(spark, d):
    lines = X.lyr(spark, d).select("song_id", "line_no", "start_ms")
    rows = lead(lines, ["song_id"], ["start_ms", "line_no"], idiv(F.col("start_ms"), 600_000), ["start_ms"])
    rows = rows.join(X.song(spark, d), "song_id")
    return rows.select("song_id", "line_no", "start_ms", F.coalesce("next.start_ms", "duration_ms").alias("end_ms"))


@query("discover_files", sql(r"SELECT DISTINCT path FROM files WHERE regexp_matches(path, '\.(mp4|mkv|mov|avi|MP4|MKV|MOV|AVI)$')"))
def discover_files(spark, d):
    return library.discover_library(X.files(spark, d).select("path"))


@query("episode_match", sql("SELECT video_id, path AS subtitle_path FROM episode_hit"))
def episode_match(spark, d):
    return library.match_episodes(X.vid(spark, d), X.files(spark, d))


@query("resolve_subs", sql("""
    SELECT video_id, coalesce(s.path, e.path) AS subtitle_path,
           CASE WHEN s.path IS NOT NULL THEN 'same name' WHEN e.path IS NOT NULL THEN 'episode' END AS found_by
    FROM vid LEFT JOIN same_name s USING (video_id) LEFT JOIN episode_hit e USING (video_id)"""))
def resolve_subs(spark, d):
    return library.resolve_subtitles(X.vid(spark, d), X.files(spark, d))


@query("subtitle_ingest", sql(f"""
    SELECT video_id, start_ms, end_ms, text
    FROM (SELECT video_id, coalesce(s.path, e.path) AS path FROM vid LEFT JOIN same_name s USING (video_id) LEFT JOIN episode_hit e USING (video_id))
    JOIN (SELECT DISTINCT path, doc_id FROM files) USING (path)
    JOIN (SELECT 'srt' AS kind, * FROM ({deduped('srt_cue')}) UNION ALL SELECT 'ass', * FROM ({deduped('ass_cue')})
          UNION ALL SELECT 'lrc', * FROM ({deduped('lrc_cue')})) c USING (doc_id)
    WHERE ends_with(path, '.' || kind)"""))
def subtitle_ingest(spark, d):
    """Each file holds its document as its suffix asks; every third one is UTF-16."""
    docs = {"srt": D.srt_docs, "ass": D.ass_docs, "lrc": D.lrc_docs}

    def contents(suffix: str):
        raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
        paths = X.files(spark, d).where(F.col("path").endswith(f".{suffix}")).select("doc_id", "path").distinct()
        return paths.join(docs[suffix](spark, d), "doc_id").select("path", raw.alias("content"))

    found = library.resolve_subtitles(X.vid(spark, d), X.files(spark, d))
    return subtitles.ingest_resolved(found, contents).drop("pos")


def _library(spark, d):
    """The files, with renders and backup renders of part of the videos."""
    v = X.vid(spark, d).select("video_id", F.regexp_extract("original_path", r"([^/]*)\.mkv$", 1).alias("stem"))
    bak = F.when(F.col("video_id") % 3 == 0, ".bak").otherwise("")
    renders = v.select(F.when(F.col("video_id") % 4 != 1, F.concat(F.lit("/lib/renders/"), "stem", F.lit("_render.mp4"), bak)).alias("path"))
    backups = v.select(F.when(F.col("video_id") % 5 < 2, F.concat(F.lit("/lib/backup/"), "stem", F.lit("_render.mp4"))).alias("path"))
    return X.files(spark, d).select("path").unionByName(renders).unionByName(backups).filter("path IS NOT NULL")


def url(expr: str) -> str:
    return f"'/api/video_file?path=' || replace(replace(replace({expr}, ' ', '%20'), '[', '%5B'), ']', '%5D')"


@query("list_videos", sql(f"""
    SELECT video_id, {url('picture')} AS proxy_url, {url("coalesce(b.path, picture)")} AS original_audio_proxy_url
    FROM (SELECT v.video_id, vstem, coalesce(k.path, r.path, v.proxy_path) AS picture
          FROM vid v JOIN vstem_t USING (video_id)
          LEFT JOIN library_file k ON k.path = '/lib/renders/' || vstem || '_render.mp4.bak'
          LEFT JOIN library_file r ON r.path = '/lib/renders/' || vstem || '_render.mp4')
    LEFT JOIN library_file b ON b.path = '/lib/backup/' || vstem || '_render.mp4'"""))
def list_videos(spark, d):
    rows = library.list_videos(X.vid(spark, d), _library(spark, d), folder=RENDERS, backup=BACKUPS)
    return rows.select("video_id", "proxy_url", "original_audio_proxy_url")


@query("source_choice", sql("""
    SELECT s.song_id, s.slot_no, CASE WHEN NOT s.keep_audio THEN '/lib/renders/' || st || '_render.mp4' WHEN b.path IS NOT NULL THEN b.path
           ELSE s.video_path END AS source_path
    FROM (SELECT *, regexp_extract(video_path, '([^/]*).mkv$', 1) AS st FROM slot) s
    LEFT JOIN library_file b ON b.path = '/lib/backup/' || st || '_render.mp4'"""))
def source_choice(spark, d):
    slots = X.slot(spark, d).withColumn("use_original_audio", F.col("keep_audio"))
    return library.source_choice(slots, _library(spark, d), folder=RENDERS, backup=BACKUPS).select("song_id", "slot_no", "source_path")


@query("list_segments", sql("""
    SELECT video_id, segment_id, start_ms, end_ms, summary, array_to_string(from_json(tags_json, '["VARCHAR"]'), '|') AS tags, is_op, is_ed FROM seg"""))
def list_segments(spark, d):
    rows = library.list_segments(X.seg(spark, d))
    return rows.select("video_id", "segment_id", "start_ms", "end_ms", "summary", F.array_join("tags", "|").alias("tags"), "is_op", "is_ed")


@query("list_cues", sql("SELECT video_id, cue_id, start_ms, end_ms, text FROM cue"))
def list_cues(spark, d):
    return library.list_cues(X.cue(spark, d))


@query("index_state", sql("""
    SELECT c_custkey AS video_id, CASE WHEN k.video_id IS NULL THEN 'full' WHEN c_acctbal < 2500 THEN 'backfill'
           WHEN s.video_id IS NULL THEN 'annotate' ELSE 'skip' END AS state
    FROM customer LEFT JOIN (SELECT DISTINCT video_id FROM kf) k ON k.video_id = c_custkey
    LEFT JOIN (SELECT DISTINCT video_id FROM seg WHERE start_ms > 200000) s ON s.video_id = c_custkey"""))
def index_state(spark, d):
    v = X.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_acctbal") >= 2500).alias("asr_processed"))
    return library.index_state(v, X.kf(spark, d), X.seg(spark, d).filter("start_ms > 200000"))


@query("table_defaults", sql("""
    SELECT segment_id, coalesce(mad_score, 5)::INTEGER AS mad_score, scene_type, '' AS emotion_flow FROM seg"""))
def table_defaults(spark, d):
    old = X.seg(spark, d).select("segment_id", "video_id", "start_ms", "end_ms", "mad_score", "scene_type")
    return tables.with_defaults(old, "video_segments").select("segment_id", "mad_score", "scene_type", F.coalesce("emotion_flow", F.lit("")).alias("emotion_flow"))
