"""Table layouts, and reading tables written before a column was added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "videos": "video_id bigint, original_path string, proxy_path string, duration_ms bigint, fps double, asr_processed boolean, indexed_at timestamp",
    "keyframes": "keyframe_id bigint, video_id bigint, t_ms bigint, frame_path string, embedding array<float>, motion_score double",
    "transcripts": "cue_id bigint, video_id bigint, start_ms bigint, end_ms bigint, text string, embedding array<float>",
    "video_segments": (
        "segment_id bigint, video_id bigint, start_ms bigint, end_ms bigint, summary string, tags array<string>, visual_style string, "
        "motion_intensity string, key_objects array<string>, emotion_flow string, is_op boolean, is_ed boolean, transcript string, "
        "mad_score int, scene_type string"
    ),
    "match_cache": "query_hash string, candidates string, created_at timestamp",
    "vision_cache": "lyrics_hash string, recommendations string, created_at timestamp",
    "script_outline_cache": "lyrics_hash string, outline string, created_at timestamp",
}

# Defaults of columns that older tables lack.
DEFAULTS: dict[str, dict[str, object]] = {
    "videos": {"asr_processed": False},
    "video_segments": {"is_op": False, "is_ed": False, "mad_score": 5, "scene_type": "dialogue"},
}


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the layout of ``table``: missing columns added, missing values defaulted."""
    schema = StructType.fromDDL(SCHEMAS[table])
    defaults = DEFAULTS.get(table, {})
    out = []
    for field in schema.fields:
        column = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            column = F.coalesce(column, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(column.alias(field.name))
    return df.select(*out)


def load_table(spark, path: str, table: str) -> DataFrame:
    """A Parquet table whose files may have been written by different versions."""
    return with_defaults(spark.read.option("mergeSchema", True).parquet(path), table)
