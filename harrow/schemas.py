"""Fixed schemas of the web-sensor tables."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _of(text: str) -> StructType:
    return StructType.fromDDL(text)


HEADER = "array<struct<name:string,value:string>>"
REQUESTS = (
    f"uid string, origin string, hlc bigint, ts timestamp, ip string, method string, path string, query string, headers {HEADER}, body binary, labels array<string>, owasp array<string>, "
    "severity int, scan_level int, answer string, status int, held_ms bigint, persona string, ja4 string, ja4h string, transport string, user_agent string, cmd string, unrecorded bigint, rules string, public_at timestamp"
)
LIGHT_BATCHES = "uid string, origin string, ip string, dropped bigint, rows array<struct<ts:timestamp,method:string,path:string,answer:string,host:string>>"
UPLOADS = "uid string, request_uid string, origin string, ts timestamp, ip string, kind string, filename string, sniffed_type string, size bigint, sha256 string, answered_path string, path_is_prefix boolean"
CHANGES = "kind string, uid string, origin string, hlc bigint, payload string"
SCHEMAS = {"requests": REQUESTS, "light_batches": LIGHT_BATCHES, "uploads": UPLOADS, "changes": CHANGES}


def schema(name: str) -> StructType:
    return _of(SCHEMAS[name])
