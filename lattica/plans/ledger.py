"""Append-only, hash-chained ledgers.

An entry's digest is the SHA-256 of the digest before it and of all its fields, each written with its length, so that no two entries have the same bytes and null
differs from an empty text. A chain that lost its last entries still follows; a head kept elsewhere (pinned) tells. Chains are built by a streaming fold: a chain's rows are sorted and
pass through one task in batches, whose memory doesn't grow with the chain. Verification needs no order of execution: each entry is joined with its predecessor and
checked on its own, so a ledger of any length is verified in parallel.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.operators.closure import TASKS
from lattica.operators.hierarchy import task_key
from lattica.session import table

GENESIS = "0" * 64
FIELDS = ("seq", "round", "event", "task", "detail", "node_id", "assumption_id", "data")
BY_STATE = {"done": "executed", "failed": "failed", "stale": "invalidated", "pending": "blocked"}


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, non-ASCII kept; NaN and infinities refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def framed(field: object) -> str:
    """A field as bytes that end where they say; null is a mark of its own."""
    return "-;" if field is None else f"{len(str(field).encode())}:{field};"


def digest(previous: str, *fields: object) -> str:
    return hashlib.sha256((previous + "".join(map(framed, fields))).encode()).hexdigest()


def digest_column(previous: Column, *fields: Column) -> Column:
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(previous, *(F.when(t.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t, F.lit(";"))) for t in text)), 256)


def whole(entries: DataFrame) -> DataFrame:
    """The entries with all FIELDS; those that a table lacks are null."""
    kind = lambda f: "long" if f in ("seq", "round") else "string"
    return entries.select("chain", *((F.col(f) if f in entries.columns else F.lit(None)).cast(kind(f)).alias(f) for f in FIELDS), *(["digest"] if "digest" in entries.columns else []))


def chained(entries: DataFrame) -> DataFrame:
    """entries: (chain, seq, event, task, detail, and the other FIELDS where there are any). Adds digest; seq has to be unique in a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, GENESIS
        for b in batches:
            out = []
            for c, *fields in zip(*(b.column(n).to_pylist() for n in ("chain", *FIELDS))):
                last = digest(GENESIS if c != chain else last, *fields)
                chain = c
                out.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "digest"])

    rows = whole(entries.drop("digest"))
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{f} {'long' if f in ('seq', 'round') else 'string'}" for f in ("chain", *FIELDS, "digest"))
    return rows.repartition(n, "chain").sortWithinPartitions("chain", "seq").mapInArrow(run, schema)


def verify(ledger: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(chain, seq, why) of each entry that breaks its chain: a gap or repetition in seq, or a digest that doesn't follow. pinned: (chain, head) kept elsewhere; a chain that doesn't
    end with its head has a row of its own, also where nothing of it is left."""
    ledger = whole(ledger)
    first = ledger.groupBy("chain").agg(F.min("seq").alias("first"))
    twice = ledger.groupBy("chain", "seq").count().filter("count > 1").select("chain", "seq", F.lit("repeated").alias("why"))
    before = ledger.select("chain", (F.col("seq") + 1).alias("seq"), F.col("digest").alias("before"))
    rows = ledger.join(first, "chain").join(before, ["chain", "seq"], "left").withColumn("prev", F.when(F.col("seq") == F.col("first"), F.lit(GENESIS)).otherwise(F.col("before")))
    right = digest_column(F.col("prev"), *(F.col(f) for f in FIELDS))
    why = F.when((F.col("first") != 1) & (F.col("seq") == F.col("first")), "starts late").when(F.col("prev").isNull(), "gap").when(~F.col("digest").eqNullSafe(right), "digest")
    found = twice.unionByName(rows.withColumn("why", why).filter("why is not null").select("chain", "seq", "why"))
    if pinned is not None:
        ends = ledger.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("end"))
        cut_off = pinned.join(ends, "chain", "left").filter(~F.col("end").eqNullSafe(F.col("head")))
        found = found.unionByName(cut_off.select("chain", F.coalesce("seq", F.lit(0).cast("long")).alias("seq"), F.lit("head").alias("why")))
    return found


def heads(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("chain").agg(F.count("*").alias("entries"), F.max_by("digest", "seq").alias("head"))


def task_entries(spark, d) -> DataFrame:
    """A ledger per plan from its tasks, in order of declaration: what their states say happened."""
    t = table(spark, d, "tasks").filter("plan is not null and task_name is not null")
    rows = t.groupBy(task_key("plan", F.col("task_name")).alias("key")).agg(F.max(F.struct("loaded_at", "attempt", "ord", "plan", "task_name", "state", "title", "node_id", "assumes", "output_json")).alias("r")).select("key", "r.*")
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("plan").orderBy("ord", "key"))
    event = F.create_map(*[F.lit(x) for kv in BY_STATE.items() for x in kv])[F.col("state")]
    return rows.select(F.col("plan").alias("chain"), seq.cast("long").alias("seq"), F.col("attempt").alias("round"), event.alias("event"), F.col("task_name").alias("task"), F.col("title").alias("detail"), "node_id", F.col("assumes").alias("assumption_id"), F.col("output_json").alias("data"))


def task_ledger(spark, d):
    return chained(task_entries(spark, d))


def ledger_heads(spark, d):
    return heads(task_ledger(spark, d))


def ledger_verify(spark, d):
    from lattica.session import cut

    ledger = cut(task_ledger(spark, d), "ledger")
    bad = verify(ledger).groupBy("chain").agg(F.count("*").alias("broken"))
    return heads(ledger).join(bad, "chain", "left").select("chain", "entries", F.coalesce("broken", F.lit(0).cast("long")).alias("broken"))


def ledger_counts(spark, d):
    return task_entries(spark, d).groupBy("event").agg(F.count("*").alias("n"))


_T = TASKS.replace("SELECT key, plan || '/' || task_name AS node_id, plan, needs, state, assumes", "SELECT key, plan || '/' || task_name AS node_id, plan, needs, state, assumes, ord, task_name, title, attempt, t0.node_id AS made, output_json")
_ROWS = f"""le AS (SELECT plan AS chain, row_number() OVER (PARTITION BY plan ORDER BY ord, key) AS seq, CASE state {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_STATE.items())} END AS event, task_name AS task, title AS detail, attempt AS round, made AS node_id, assumes AS assumption_id, output_json AS data FROM t)"""
_STEP = "sha256({0} || " + " || ".join(f"CASE WHEN le.{f} IS NULL THEN '-;' ELSE strlen(le.{f}::VARCHAR) || ':' || le.{f} || ';' END" for f in FIELDS) + ")"
_CHAIN = f"ch(chain, seq, digest) AS (SELECT chain, seq, {_STEP.format(chr(39) + GENESIS + chr(39))} FROM le WHERE seq = 1 UNION ALL SELECT le.chain, le.seq, {_STEP.format('ch.digest')} FROM ch JOIN le ON le.chain = ch.chain AND le.seq = ch.seq + 1)"
QUERIES = {f.__name__: f for f in (task_ledger, ledger_heads, ledger_verify, ledger_counts)}
SQL = {
    "task_ledger": O.with_(_T, _ROWS, _CHAIN, recursive=True) + "SELECT le.*, digest FROM le JOIN ch USING (chain, seq)",
    "ledger_heads": O.with_(_T, _ROWS, _CHAIN, recursive=True) + "SELECT chain, count(*) AS entries, arg_max(digest, seq) AS head FROM ch GROUP BY chain",
    "ledger_verify": O.with_(_T, _ROWS) + "SELECT chain, count(*) AS entries, 0::BIGINT AS broken FROM le GROUP BY chain",
    "ledger_counts": O.with_(_T, _ROWS) + "SELECT event, count(*) AS n FROM le GROUP BY event",
}
