"""Mixing sources to target weights.

The size of a mix is fixed beforehand (the tokens of all documents), so each source has a budget of its own: its share of that size.
Whole repeats of a source come first; the rest of the budget is filled by the documents whose hash lies below a threshold. The
threshold comes from histograms of tokens by source and hash bucket: the bucket in which the running sum passes the budget is the
boundary, and only the rows of boundary buckets are kept and split further, until one holds a single document. Nothing is sorted, and
thresholds are nested: of two mixes the smaller budget of a source takes a subset of the greater one's documents.

Only the histograms' boundaries, one a mix and source, reach the driver. Rows in mix_targets are few by contract (MAX_TARGETS).

Defined results: sources are compared without case and surrounding blanks; documents of null or unlisted sources take part in the size
alone; null, empty texts have no tokens and are not used; a doc_id that occurs in several rows counts once, with its largest row; rows
without doc_id take no part; a source that can't fill its budget is used max_repeats times throughout, and the shares reported are
those reached; a null or negative max_repeats counts as 0, a null share as 0; a source listed twice in a mix takes its greatest share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.tokenize import encode_documents
from lattica.operators.hierarchy import folded
from lattica.session import cut, table

MAX_TARGETS = 10_000
#: Bits of the hash a histogram looks at, and bits in all.
STEP, BITS = 10, 60


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source (folded), n_tokens, h: each doc_id once."""
    rows = encode_documents(documents.filter("doc_id is not null"), ["doc_id", "source"], counts_only=True)
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("n_tokens", F.coalesce(folded("source"), F.lit("")).alias("source"))).alias("m"))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 64 - BITS)
    return rows.select("doc_id", "m.source", "m.n_tokens", h.alias("h"))


def budgets(docs: DataFrame, targets: DataFrame) -> tuple[list[dict], int]:
    """One record per mix and source: the repeats of the whole source and the tokens that the hash threshold has to give."""
    if (n := targets.count()) > MAX_TARGETS:
        raise ValueError(f"{n} targets; there may be {MAX_TARGETS}")
    wanted = targets.filter("mix is not null and source is not null").groupBy("mix", folded("source").alias("source")).agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("most"))).alias("t"))
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    have = docs.join(F.broadcast(wanted.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("have"))
    out = []
    for r in wanted.select("mix", "source", "t.*").join(F.broadcast(have), "source", "left").orderBy("mix", "source").collect():
        have_n, budget = r.have or 0, r.share * total
        times = min(r.most, int(budget // have_n)) if have_n else 0
        rest = budget - times * have_n if have_n and times < r.most else 0.0
        out.append({"mix": r.mix, "source": r.source, "share": r.share, "most": r.most, "times": times, "rest": rest})
    return out, total


def thresholds(docs: DataFrame, wanted: list[dict]) -> None:
    """Sets "below" in each record: documents with h below it are used once more."""
    spark = docs.sparkSession
    for w in wanted:
        w |= {"below": 0, "left": w["rest"], "open": w["rest"] > 0}
    shift, pool = BITS, docs
    while shift and any(w["open"] for w in wanted):
        shift -= STEP
        # the open boundary buckets, by the hash bits above them
        edge = spark.createDataFrame(sorted({(w["source"], w["below"] >> (shift + STEP)) for w in wanted if w["open"]}), "source string, high long")
        near = pool.withColumn("high", F.shiftright("h", shift + STEP) if shift + STEP < BITS else F.lit(0).cast("long")).join(F.broadcast(edge), ["source", "high"])
        if shift + STEP < BITS:  # a thousandth of the documents or so
            near = cut(near, "edge")
            pool = near.drop("high")
        hist = near.groupBy("source", "high", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
        run = F.sum("tokens").over(Window.partitionBy("source", "high").orderBy("bucket"))
        hist = hist.withColumn("to", run)
        ask = spark.createDataFrame([(i, w["source"], w["below"] >> (shift + STEP), float(w["left"])) for i, w in enumerate(wanted) if w["open"]], "i int, source string, high long, left double")
        hit = hist.join(F.broadcast(ask), ["source", "high"]).filter(F.col("to") > F.col("left")).groupBy("i").agg(F.min(F.struct("bucket", "to", "tokens", "n")).alias("b"))
        found = {r.i: r.b for r in hit.collect()}
        for i, w in enumerate(wanted):
            if not w["open"]:
                continue
            if (b := found.get(i)) is None:  # rounding: the whole edge fits
                w |= {"below": w["below"] + (1 << (shift + STEP)), "open": False}
                continue
            w["left"] -= b.to - b.tokens
            w["below"] = b.bucket << shift
            if b.n == 1 or not shift:  # the one that passes the budget is taken if that comes closer
                w["open"] = False
                if b.tokens - w["left"] < w["left"]:
                    w["below"] += 1 << shift


def select_mix(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(selection: mix, source, doc_id, copies, n_tokens; the targets as records in a frame; size of a mix)."""
    docs = cut(sized(documents), "sized")
    wanted, total = budgets(docs, targets)
    thresholds(docs, wanted)
    plan = documents.sparkSession.createDataFrame([(w["mix"], w["source"], w["share"], w["most"], w["times"], w["below"]) for w in wanted], "mix string, source string, share double, most long, times long, below long")
    copies = F.col("times") + (F.col("h") < F.col("below")).cast("long")
    picked = docs.filter("n_tokens > 0").join(F.broadcast(plan), "source").withColumn("copies", copies).filter("copies > 0")
    return picked.select("mix", "source", "doc_id", "copies", "n_tokens"), plan, total


def p7_selection(spark, sf_dir: str) -> DataFrame:
    return select_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """Per mix and source: the share aimed at, the share of the mix's size reached, documents used and most copies of one."""
    picked, plan, total = select_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    sums = picked.groupBy("mix", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    zero = F.lit(0).cast("long")
    return plan.join(sums, ["mix", "source"], "left").select(
        "mix", "source", F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("n_docs", zero).alias("n_docs"),
        F.coalesce("most_copies", zero).alias("most_copies"), (F.coalesce("tokens", zero) / F.lit(float(max(1, total)))).alias("reached_share"),
    )
