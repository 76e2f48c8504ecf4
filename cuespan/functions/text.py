"""Text clean-up and predicates that behave the same for every script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and word characters as regex class bodies.
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Words that open a credit line.
CREDIT_WORDS = (
    "歌曲", "歌手", "作词", "作曲", "编曲", "词曲", "词/曲", "制作人", "演唱", "歌词", "后期",
    "混音", "录音", "和声", "母带", "企划", "监制", "出品", "发行", "设计", "视觉", "歌词制作", "歌词编辑",
    "title", "artist", "album", "lyrics", "music", "producer", "composer", "lyricist",
    "arranged", "written", "composed", "produced", "performed", "mixed", "mastered",
    "recorded", "engineered", "published", "copyright", "℗", "©",
)
CREDIT_BY = rf"^[{WORD}{SPACE}/]+[{SPACE}]+by[{SPACE}]*[：:]"
CREDIT_BY_LIST = rf"^[{WORD}{SPACE}]+[{SPACE}]+by(?:[^{WORD}]|$)"
CREDIT_START = rf"^(?:{'|'.join(CREDIT_WORDS)})[{SPACE}]*(?:$|[:：/\-])"


# The same white space as plain characters.
SPACE_CHARS = "".join(
    chr(c) for low, high in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ) for c in range(low, high + 1)
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def lines_of(text: Column) -> Column:
    """Lines at any Unicode line break."""
    return F.split(text, LINE_BREAK)


def is_credit_line(text: Column) -> Column:
    """Blank, bracketed, "… by: …", "… by A/B", copyright, or a credit word with nothing or a separator after it."""
    return is_credit_text(strip(text))


def is_credit_text(clean: Column) -> Column:
    """The same for text without white space at its ends."""
    low = F.lower(clean)
    return (
        (clean == "")
        | (low.startswith("[") & low.endswith("]"))
        | low.rlike(CREDIT_BY)
        | (low.rlike(CREDIT_BY_LIST) & clean.contains("/"))
        | clean.startswith("©")
        | clean.startswith("℗")
        | low.rlike(CREDIT_START)
    )


def file_name(path: Column) -> Column:
    """Last part of a path with either separator."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last suffix of the file name; a leading dot is part of the name."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(extension(path)))


def stem(path: Column) -> Column:
    return without_extension(base_name(path))


def render_name(path: Column, folder: str) -> Column:
    """Where the render proxy of a video lies."""
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(f"{folder}/"), stem(path), F.lit("_render.mp4"))).otherwise("")


def trimmed_name(path: Column, start_ms: Column, end_ms: Column) -> Column:
    """Name of a cut asset: any earlier cut suffix goes, the whole seconds of the new one come."""
    whole = stem(path)
    root = F.when(whole.contains("_trimmed_"), F.substring_index(whole, "_trimmed_", 1)).otherwise(whole)
    seconds = lambda c: F.call_function("div", c, F.lit(1000)).cast("string")
    return F.concat(root, F.lit("_trimmed_"), seconds(start_ms), F.lit("_"), seconds(end_ms), extension(path))


def setup_name(name: Column) -> Column:
    cleaned = strip(F.regexp_replace(F.coalesce(name, F.lit("default")), rf"[^{WORD}{SPACE}\x{{4e00}}-\x{{9fa5}}\-]", ""))
    return F.when(cleaned == "", "default").otherwise(cleaned)


def progress(line: Column) -> Column:
    """``NN% text`` of a log line as (percent, overall, message); null when it is no progress line."""
    plain = F.regexp_replace(line, r"\x1b\[[0-9;]*[a-zA-Z]", "")
    percent = F.regexp_extract(plain, rf"(\d+)%[{SPACE}]+([^\n]*)", 1)
    return F.when(
        percent != "",
        F.struct(
            percent.cast("int").alias("percent"),
            F.call_function("div", 3000 + percent.cast("int") * 65, F.lit(100)).cast("int").alias("overall"),
            strip(F.regexp_extract(plain, rf"(\d+)%[{SPACE}]+([^\n]*)", 2)).alias("message"),
        ),
    )
