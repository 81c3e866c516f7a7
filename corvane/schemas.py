"""Schemas of the logical tables."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TEXT, LONG, DOUBLE, TEXTS, DOUBLES = T.StringType(), T.LongType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())

PROJECT = _struct(
    id=TEXT, title=TEXT, summary=TEXT, tags=TEXTS, models=TEXTS, datasets=TEXTS, likes=LONG, sdk=TEXT, license=TEXT, created_at=TEXT,
    last_modified=TEXT, host=TEXT, url=TEXT, app_file=TEXT, app_file_embedding_text=TEXT, readme_body=TEXT, app_file_source=TEXT,
)
SNAPSHOT = _struct(generated_at=TEXT, source=TEXT, projects=T.ArrayType(PROJECT))
INDEX_DOCUMENT = _struct(project_id=TEXT, text_digest=TEXT, norm=DOUBLE, vector=DOUBLES)
MATCH = _struct(project_id=TEXT, label=TEXT, confidence=DOUBLE, evidence=TEXT, source=TEXT)
TURN_EVENT = _struct(turn_id=TEXT, seq=LONG, ts=T.TimestampType(), type=TEXT, stage=TEXT, tokens=LONG, text=TEXT, name=TEXT)
