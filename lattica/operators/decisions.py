"""Decisions as immutable events: recorded in batches, idempotent by content where the caller names an id.

A decision's fingerprint covers what its node and edges say: title, rationale, source, and the sets it cites, derives from, depends on, produces and
supersedes. It comes out the same from a request and from the graph, so that a stored decision can be held against its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica import oracle as O
from lattica.functions import text as T
from lattica.operators import mutations as M
from lattica.session import cut
from lattica.sources.graph import edge_rows, node_rows

#: Ids minted for requests without one; no request may name an id in it.
AUTO = "decision:auto"
LISTS = ("cites", "derived_from", "depends_on", "produces")
REQUEST = "request long, id string, title string, rationale string, source_id string, supported_by array<string>, cites array<string>, assumptions array<string>, produces array<string>, supersedes string"


def fingerprinted(rows: DataFrame) -> DataFrame:
    """rows: title, rationale, source_id, LISTS, supersedes and others. Adds fingerprint."""
    names = ("title", "rationale", "source_id", *LISTS, "supersedes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(n).to_pylist() for n in names]
            out = [M.fingerprint(t, r, s, c or (), d or (), a or (), p or (), o) for t, r, s, c, d, a, p, o in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "fingerprint"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fingerprint", StringType())]))


def structures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, title, rationale, source_id, LISTS, supersedes) of every decision as the graph has it; dead edges count too, as they were recorded. A rationale that is null counts as empty."""
    own = nodes.filter("node_type = 'decision'").select("id", F.col("label").alias("title"), F.coalesce("rationale", F.lit("")).alias("rationale"), "source_id")
    out = edges.filter(F.col("edge_type").isin(*LISTS, "supersedes")).join(own.select(F.col("id").alias("src")), "src", "left_semi")
    out = out.groupBy(F.col("src").alias("id")).pivot("edge_type", [*LISTS, "supersedes"]).agg(F.sort_array(F.collect_set("dst")))
    full = own.join(out, "id", "left")
    none = F.array().cast("array<string>")
    full = full.select("id", "title", "rationale", "source_id", *(F.coalesce(c, none).alias(c) for c in LISTS), F.when(F.size("supersedes") > 0, F.col("supersedes")[0]).alias("supersedes"))
    return full.withColumn("cites", F.filter("cites", lambda x: ~x.eqNullSafe(F.col("source_id"))))


def decide(nodes: DataFrame, edges: DataFrame, requests: DataFrame, build: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests: REQUEST. (nodes, edges, outcomes: request, id, outcome). A request without id is a new decision, however often its words were said before; one with an id that is
    there with the same content is 'same' and changes nothing, with other content it is refused, as is an id of the reserved namespace, or one that names anything but a decision recorded
    under it. Requests of one batch with one id have to agree; the first is recorded. Everything is checked before anything is returned."""
    none = F.array().cast("array<string>")
    lists = {"cites": F.array_except(F.coalesce("cites", none), F.array("source_id")), "derived_from": F.coalesce("supported_by", none), "depends_on": F.coalesce("assumptions", none), "produces": F.coalesce("produces", none)}
    asked = requests.select("request", "id", "title", F.coalesce("rationale", F.lit("")).alias("rationale"), "source_id", *(F.array_sort(F.array_distinct(F.array_compact(c))).alias(n) for n, c in lists.items()), "supersedes")
    asked = cut(fingerprinted(asked), "asked")
    M._none(asked.filter("title is null or source_id is null").select("request"), "a decision needs a title and a source")
    M._none(asked.filter(F.col("id").startswith(AUTO + ":")).select("request", "id"), "the id lies in the namespace of minted ids")
    M._none(asked.filter("id is not null").groupBy("id").agg(F.count_distinct("fingerprint").alias("n")).filter("n > 1").select("id"), "one id, two contents")

    named = asked.filter("id is not null").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("request")))
    met = nodes.select("id", "node_type", F.get_json_object("attrs", "$.decision_identity").alias("identity"))
    known = cut(named.join(met, "id"), "known")
    M._none(known.filter("node_type != 'decision' or coalesce(identity, '') != 'explicit'").select("request", "id"), "the id isn't a decision recorded under it")
    held = fingerprinted(structures(nodes.join(known.select("id"), "id", "left_semi"), edges)).select("id", F.col("fingerprint").alias("held"))
    M._none(known.join(held, "id").filter("fingerprint != held").select("request", "id"), "the id is recorded with other content")

    # new ids: of the numbers 1, 2 ... of a title the first that no node has
    fresh = asked.filter("id is null").withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy("request")))
    used = nodes.filter(F.col("id").startswith(AUTO + ":")).groupBy(F.col("label").alias("title")).agg(F.count("*").alias("used"))
    most = fresh.groupBy("title").agg(F.max("r").alias("want")).join(used, "title", "left")
    tries = most.select("title", F.explode(F.sequence(F.lit(1), (F.col("want") + F.coalesce("used", F.lit(0))).cast("int"))).alias("n")).withColumn("id", T.slug(F.concat("title", F.lit("|"), "n"), AUTO))
    free = tries.join(nodes.select("id"), "id", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy("n")))
    minted = fresh.drop("id").join(free.select("title", "r", "id"), ["title", "r"])

    cols = asked.columns
    new = cut(named.join(met, "id", "left_anti").filter("r = 1").select(*cols, F.lit("explicit").alias("identity")).unionByName(minted.select(*cols, F.lit("auto").alias("identity"))), "decided")
    attrs = F.to_json(F.struct(F.col("identity").alias("decision_identity"), F.col("fingerprint").alias("decision_payload_digest")))
    made = new.select("id", F.lit("decision").alias("node_type"), F.col("title").alias("label"), attrs.alias("attrs"), "rationale", F.lit(None).cast("string").alias("retrieved_at"), "source_id", F.lit(build).cast("long").alias("build"))
    n = cut(M.upsert_nodes(nodes, made), "nodes")
    out = lambda kind, dst: new.select(F.col("id").alias("src"), F.lit(kind).alias("edge_type"), dst.alias("dst"))
    links = out("cites", F.col("source_id")).unionByName(new.select(F.explode("derived_from").alias("src"), F.lit("supports").alias("edge_type"), F.col("id").alias("dst")))
    for kind in LISTS:
        links = links.unionByName(out(kind, F.explode(kind)))
    links = links.unionByName(out("supersedes", F.col("supersedes")).filter("dst is not null")).distinct().withColumn("weight", F.lit(1.0))
    e = M.upsert_edges(edges, links, n, build)
    marked = new.filter("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.to_json(F.struct(F.max("id").alias("superseded_by"))).alias("mark"))
    n = n.join(marked, "id", "left").withColumn("attrs", F.when(F.col("mark").isNull(), F.col("attrs")).otherwise(M.merged_attrs("attrs", "mark"))).select(*nodes.columns)
    first = asked.filter("id is not null").groupBy("id").agg(F.min("request").alias("first"))
    said = asked.filter("id is not null").join(first, "id").join(known.select("id").distinct().withColumn("there", F.lit(True)), "id", "left")
    said = said.select("request", "id", F.when(F.col("there") | (F.col("request") != F.col("first")), "same").otherwise("recorded").alias("outcome"))
    return n, e, said.unionByName(minted.select("request", "id", F.lit("recorded").alias("outcome")))


def decision_fingerprints(spark, d):
    """The fingerprint of every decision, rebuilt from its node and edges."""
    return fingerprinted(structures(node_rows(spark, d), edge_rows(spark, d))).select("id", "fingerprint")


def decision_digest_faults(spark, d):
    """Decisions whose stored digest isn't that of their node and edges."""
    kept = node_rows(spark, d).filter("node_type = 'decision'").select("id", F.get_json_object("attrs", "$.decision_payload_digest").alias("stored"))
    return kept.filter("stored is not null").join(decision_fingerprints(spark, d), "id").filter("stored != fingerprint").select("id", "stored", "fingerprint")


_CHAR = "CASE WHEN ord(ch) < 128 THEN ch WHEN ord(ch) < 65536 THEN '\\u' || lpad(lower(to_hex(ord(ch))), 4, '0') ELSE '\\u' || lower(to_hex(55296 + (ord(ch) - 65536) // 1024)) || '\\u' || lower(to_hex(56320 + (ord(ch) - 65536) % 1024)) END"
_JSON = "CASE WHEN {0} IS NULL THEN 'null' ELSE array_to_string(list_transform(string_split(to_json({0})::VARCHAR, ''), lambda ch: " + _CHAR + "), '') END"
_LIST = "'[' || array_to_string(list_transform(list_sort(coalesce({0}, [])), lambda x: '\"' || x || '\"'), ', ') || ']'"
QUERIES = {f.__name__: f for f in (decision_fingerprints, decision_digest_faults)}
SQL = {
    "decision_fingerprints": O.with_(O.NODES, O.EDGES, "l AS (SELECT src, " + ", ".join(f"list(DISTINCT dst) FILTER (WHERE edge_type = '{k}') AS {k}" for k in (*LISTS, "supersedes")) + " FROM e GROUP BY src)",
        "s AS (SELECT n.id, label, coalesce(rationale, '') AS r, source_id, list_filter(cites, lambda x: x IS DISTINCT FROM source_id) AS cites, derived_from, depends_on, produces, list_sort(supersedes)[1] AS sup FROM n LEFT JOIN l ON l.src = n.id WHERE node_type = 'decision')")
    + "SELECT id, sha256('{\"cites\": ' || " + _LIST.format("cites") + " || ', \"depends_on\": ' || " + _LIST.format("depends_on") + " || ', \"derived_from\": ' || " + _LIST.format("derived_from") + " || ', \"produces\": ' || " + _LIST.format("produces")
    + " || ', \"rationale\": ' || " + _JSON.format("r") + " || ', \"source_id\": ' || " + _JSON.format("source_id") + " || ', \"supersedes\": ' || " + _JSON.format("sup") + " || ', \"title\": ' || " + _JSON.format("label") + " || '}') AS fingerprint FROM s",
}
SQL["decision_digest_faults"] = "SELECT DISTINCT f.id, json_extract_string(attrs, '$.decision_payload_digest') AS stored, fingerprint FROM (" + SQL["decision_fingerprints"] + ") f JOIN nodes r ON r.id = f.id WHERE json_extract_string(attrs, '$.decision_payload_digest') IS NOT NULL AND stored <> fingerprint"
