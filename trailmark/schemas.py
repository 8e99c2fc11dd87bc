"""Schemas, enum values and limits shared by every module."""

from pyspark.sql import types as T

# Fixed values of the wire contract and the stored tables.
SCHEMA_VERSION = 1

EVENT_TYPES = [
    "CLICK",
    "DEAD_CLICK",
    "RAGE_CLICK",
    "ERROR_CLICK",
    "NAVIGATION",
    "INPUT",
    "SCROLL",
    "CONSOLE_ERROR",
    "EXCEPTION",
    "IDENTIFY",
    "CUSTOM",
    "NETWORK",
]
ERROR_TYPES = ["EXCEPTION", "CONSOLE_ERROR"]

FIELD_LIMITS = {
    "url": 2048,
    "path": 1024,
    "title": 512,
    "targetSelector": 1024,
    "targetText": 1024,
    "errorMessage": 2048,
    "errorStack": 8192,
    "eventName": 128,
    "anonymousId": 128,
    "sdkVersion": 32,
    "userAgent": 512,
}

MAX_EVENTS_PER_BATCH = 500
MAX_EVENT_AGE_MS = 24 * 3_600_000
MAX_CLOCK_SKEW_MS = 5 * 60_000
MAX_SITE_KEY_LENGTH = 256
MAX_METHOD_LENGTH = 16
RATE_BURST = 100
RATE_PER_SECOND = 50

SESSION_IDLE_MS = 30 * 60_000
MAX_ERRORS_PER_MINUTE = 30

REPLAY_META = 4
REPLAY_FULL_SNAPSHOT = 2
REPLAY_CHUNK_BYTES = 256 * 1024
REPLAY_FLUSH_MS = 5_000

REPLAY_RETENTION_DAYS = 30

ANALYSIS_TRANSITIONS = [
    ("PENDING", "PROCESSING"),
    ("PROCESSING", "AI_ANALYZED"),
    ("PROCESSING", "REVIEW_REQUIRED"),
    ("PROCESSING", "FAILED"),
    ("FAILED", "PROCESSING"),
    ("AI_ANALYZED", "HUMAN_APPROVED"),
    ("REVIEW_REQUIRED", "HUMAN_APPROVED"),
    ("REVIEW_REQUIRED", "HUMAN_REJECTED"),
]
ANALYSIS_STATUSES = [
    "PENDING",
    "PROCESSING",
    "AI_ANALYZED",
    "REVIEW_REQUIRED",
    "HUMAN_APPROVED",
    "HUMAN_REJECTED",
    "FAILED",
]
# End of fixed values.


def _struct(fields: str) -> T.StructType:
    """`"name:type, ..."` with the few types the wire uses."""
    types = {
        "string": T.StringType(),
        "int": T.IntegerType(),
        "bigint": T.LongType(),
        "timestamp": T.TimestampType(),
        "boolean": T.BooleanType(),
        "double": T.DoubleType(),
        "date": T.DateType(),
    }
    pairs = [field.strip().split(":") for field in fields.split(",")]
    return T.StructType([T.StructField(name, types[kind]) for name, kind in pairs])


# One event as browsers send it. `props` keeps the raw JSON text of whatever was sent.
EVENT = _struct(
    "clientEventId:string, type:string, ts:bigint, url:string, path:string, title:string, "
    "targetSelector:string, targetText:string, errorMessage:string, errorStack:string, "
    "eventName:string, props:string"
)

# Column that receives the text of a body or envelope that does not fit its schema.
CORRUPT = "_corrupt"

EVENT_BATCH_FIELDS = ["siteKey", "sessionId", "anonymousId", "sdkVersion", "events"]
# A body with its events still as text, and the list of those that are looked into.
RAW_EVENT_BATCH = (
    _struct("siteKey:string, sessionId:string, anonymousId:string, sdkVersion:string")
    .add("events", T.ArrayType(T.StringType()))
    .add(CORRUPT, T.StringType())
)
EVENT_LIST = T.StructType([T.StructField("events", T.ArrayType(EVENT)), T.StructField(CORRUPT, T.StringType())])
REPLAY_BATCH = _struct(f"siteKey:string, sessionId:string, chunkSeq:int, events:string, {CORRUPT}:string")

TELEMETRY_ENVELOPE = (
    _struct(
        "schemaVersion:int, tenantId:string, siteId:string, sessionId:string, anonymousId:string, "
        "sdkVersion:string, receivedAt:string"
    )
    .add("event", EVENT)
    .add("userAgent", T.StringType())
    .add(CORRUPT, T.StringType())
)
REPLAY_ENVELOPE = _struct(
    "schemaVersion:int, tenantId:string, siteId:string, sessionId:string, chunkSeq:int, "
    f"receivedAt:string, payload:string, events:string, {CORRUPT}:string"
)
# Decoded form of the raw array inside a replay chunk; `timestamp` may be written as a fraction.
REPLAY_EVENTS = T.ArrayType(_struct("type:int, timestamp:double"))

# A record as a log source delivers it.
RAW_RECORD = _struct("topic:string, partition:int, offset:bigint, timestamp:timestamp, key:string, value:string")

EVENT_KEYS = ["tenant_id", "session_id", "ts", "event_id"]

CHUNK_KEYS = ["tenant_id", "session_id", "chunk_seq"]

USER_SESSION = _struct(
    "id:string, tenant_id:string, site_id:string, end_user_id:string, anonymous_id:string, "
    "started_at:timestamp, last_active_at:timestamp, ended_at:timestamp, duration_ms:bigint, "
    "page_count:bigint, error_count:bigint, platform:string, browser:string, entry_url:string, "
    "entry_at:timestamp, needs_recompute:boolean, version:bigint"
)
END_USER = _struct(
    "tenant_id:string, site_id:string, anonymous_id:string, first_seen_at:timestamp, "
    "last_seen_at:timestamp, version:bigint"
)

# A session as the closing job keeps it: under the day of its first received event, which never changes.
STORED_SESSION = T.StructType([*USER_SESSION.fields, T.StructField("home_day", T.DateType())])
