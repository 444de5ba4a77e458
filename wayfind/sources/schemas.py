"""Declared schemas: event envelope, payloads of all event types, catalogue documents."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, TS, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DoubleType()  # noqa: E741


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: payload stays raw JSON; every type is decoded from it
ENVELOPE = _struct(event_id=S, type=S, occurred_at=TS, schema_version=I, payload=S)
VIDEO = _struct(
    id=S, kind=S, channel_id=S, channel_handle=S, channel_name=S, owner_id=S, title=S, description=S, tags=T.ArrayType(S), category=S, language=S, duration_seconds=I,
    is_sensitive=B, privacy=S, state=S, published_at=TS, created_at=TS, updated_at=TS, views=L, likes=I,
)
CHANNEL = _struct(id=S, handle=S, display_name=S, owner_id=S)
#: the union of all payloads; fields that a type lacks are null
PAYLOAD = _struct(
    video=VIDEO, videos=T.ArrayType(VIDEO), channel=CHANNEL, video_id=S, channel_id=S, user_id=S, session_id=S, run_id=S, reason=S, scope=S, query=S, source=S, context=S, model_version=S,
    views=L, likes=I, position=I, results_count=I, total=I, unlisted=B, allow_history=B, position_seconds=D, duration_seconds=D, settings=T.MapType(S, S), _corrupt=S,
)
DOCUMENT = _struct(
    video_id=S, kind=S, channel_id=S, channel_handle=S, channel_name=S, owner_id=S, title=S, description=S, tags=T.ArrayType(S), category=S, language=S, duration_seconds=I, is_sensitive=B,
    eligible=B, suppressed_reason=S, views=L, likes=I, published_at=TS, source_updated_at=TS, reconcile_run_id=S,
)
