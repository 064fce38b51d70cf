"""Intake of untrusted evidence: validated, digested, replayed exactly or refused. Evidence arrives as detached nodes without edges."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.plans.ledger import canonical_json
from lattica.session import table

# Limits of a submission.
MAX_BYTES, MAX_EXTERNAL, MAX_DEPTH, MAX_ITEMS = 65_536, 512, 8, 1_000


class EvidenceError(ValueError):
    pass


def check_metadata(value: object, depth: int = 0) -> int:
    """Number of items; raises where the value isn't plain, finite, bounded JSON."""
    if depth > MAX_DEPTH:
        raise EvidenceError("nested too deeply")
    if isinstance(value, str):
        if len(value.encode()) > MAX_BYTES:
            raise EvidenceError("a string is too long")
        return 0
    if value is None or isinstance(value, (bool, int)):
        return 0
    if isinstance(value, float):
        if not math.isfinite(value):
            raise EvidenceError("a number isn't finite")
        return 0
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise EvidenceError("keys have to be strings")
        n = len(value) + sum(check_metadata(v, depth + 1) for v in value.values())
    elif isinstance(value, list):
        n = len(value) + sum(check_metadata(v, depth + 1) for v in value)
    else:
        raise EvidenceError(f"{type(value).__name__} isn't JSON")
    if n > MAX_ITEMS:
        raise EvidenceError("too many items")
    return n


def payload(text: str, source_id: str, external_id: str | None = None, metadata: dict | None = None) -> str:
    """The canonical payload of one submission, after validation."""
    if not text or not text.strip() or len(text.encode()) > MAX_BYTES:
        raise EvidenceError("text is empty or too long")
    if external_id is not None and (not external_id.strip() or len(external_id.encode()) > MAX_EXTERNAL or not external_id.isprintable()):
        raise EvidenceError("external id is blank, too long or not printable")
    check_metadata(metadata or {})
    body = canonical_json({"external_id": external_id, "metadata": metadata or {}, "source_id": source_id, "text": text})
    if len(body.encode()) > 2 * MAX_BYTES:
        raise EvidenceError("payload is too long")
    return body


def strict_json(text: str) -> object:
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise EvidenceError("a key occurs twice")
        return dict(items)

    def refuse(name: str) -> None:
        raise EvidenceError(f"{name} isn't JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


def submissions(events: DataFrame) -> DataFrame:
    """Events as submissions: (event_id, external_id, payload, digest, valid)."""
    body = F.concat_ws("|", "event_type", F.coalesce("props", F.lit("")))
    rows = events.select("event_id", F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("external_id"), body.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256)).withColumn("valid", (F.octet_length("payload") <= MAX_BYTES) & (F.octet_length("external_id") <= MAX_EXTERNAL))


def intake(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(evidence_id, first_event, deliveries): each valid payload once, exact replays of known ones left out."""
    once = new.filter("valid").groupBy("digest").agg(F.min("event_id").alias("first_event"), F.count("*").alias("deliveries"))
    if known is not None:
        once = once.join(known.select("digest"), "digest", "left_anti")
    return once.select(F.concat(F.lit("evidence:"), "digest").alias("evidence_id"), "first_event", "deliveries")


def evidence_dedup(spark, d):
    return intake(submissions(table(spark, d, "events")))


def external_conflicts(spark, d):
    """External ids that came with different content."""
    s = submissions(table(spark, d, "events")).filter("valid")
    return s.groupBy("external_id").agg(F.countDistinct("digest").alias("versions")).filter("versions > 1")


_S = "s AS (SELECT event_id, event_type || '-' || user_id AS external_id, sha256(event_type || '|' || coalesce(props, '')) AS digest FROM events)"
QUERIES = {"evidence_dedup": evidence_dedup, "external_conflicts": external_conflicts}
SQL = {
    "evidence_dedup": O.with_(_S) + "SELECT 'evidence:' || digest AS evidence_id, min(event_id) AS first_event, count(*) AS deliveries FROM s GROUP BY digest",
    "external_conflicts": O.with_(_S) + "SELECT external_id, count(DISTINCT digest) AS versions FROM s GROUP BY external_id HAVING count(DISTINCT digest) > 1",
}
