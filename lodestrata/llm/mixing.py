"""Mixing sources to target weights, by weighted fair queueing.

Every use of a document gets a virtual finish time: the tokens of its source up to and including
it, in shuffled order, over the source's weight. Served in that order, the sources stay at their
weights at any moment; the order is cut where the total budget is reached. A source that runs out
starts over, newly shuffled, at most `max_repeats` times in all.

Running totals are three-level prefix sums: rows fall into buckets of the sort key, buckets into blocks; blocks'
sums are accumulated, each bucket adds those before it in its block, each row those before it in its bucket. A
source with a third of all rows is many buckets and blocks, so it never meets in one task. The plan is a table of
the listed sources; the driver receives three numbers of it.

Defined results: sources are compared trimmed, in lower case, with `-` as `_`; documents of a
source that is not listed, or of size 0 (null or empty text), are no part of a mix; a listed source
without documents gets nothing and the others keep their proportions; without a given budget the
total is the largest at which every source that has documents reaches its share within its repeats;
with a larger one the exhausted sources give all they may and the others fill up by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.functions.text import key
from lodestrata.llm import tokenizer
from lodestrata.operators.joins import lookup
from lodestrata.storage import Workspace

ROWS_PER_BUCKET = 20_000
BUCKETS_PER_BLOCK = 1_000


def source_key(c: Column | str) -> Column:
    return F.translate(key(c), "-", "_")


def sized_documents(docs: DataFrame, folder: str = tokenizer.FOLDER, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have tokens and a source."""
    text = F.col("text")
    sized = docs.select("doc_id", source_key("source").alias("source"), "text").where("source is not null and text <> ''")
    # a text that isn't empty has a token at least, so no filter on the count, which would run the tokenizer twice
    return sized.select("doc_id", "source", tokenizer.token_counts(text, folder, vocabulary).alias("n_tokens"))


def running_total(rows: DataFrame, groups: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of `value` in order of (bucket, order) within `groups`, without a task per group."""
    rows = rows.withColumns({"_bucket": bucket, "_block": F.floor(bucket / F.lit(BUCKETS_PER_BLOCK))})
    block, by = [*groups, "_block"], [*groups, "_block", "_bucket"]
    before = lambda keys, at: F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*by).agg(F.sum(value).alias("_sum"))
    blocks = sums.groupBy(*block).agg(F.sum("_sum").alias("_sum"))
    blocks = blocks.select(*block, before(groups, "_block").alias("_first"))
    starts = sums.select(*by, before(block, "_bucket").alias("_second")).join(blocks, block).select(*by, (F.col("_first") + F.col("_second")).alias("_start"))
    within = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_within", F.sum(value).over(within)).join(starts, by)
    return out.withColumn(name, F.col("_start") + F.col("_within")).drop("_bucket", "_block", "_start", "_within")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, repeats, documents, tokens, supply) of the listed sources; several rows of one add their shares."""
    wanted = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("weight"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("repeats"))
    have = sized.groupBy("source").agg(F.count("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return wanted.join(have, "source", "left").select("source", "weight", F.coalesce("repeats", F.lit(0)).alias("repeats"), zero("documents"), zero("tokens")).withColumn(
        "supply", F.col("tokens") * F.col("repeats")
    )


def finish_line(shares: DataFrame, budget: int | None) -> tuple[float, float]:
    """(the virtual time at which the budget is reached, the budget)."""
    open_ = shares.where("supply > 0 and weight > 0").withColumn("t", F.col("supply") / F.col("weight"))
    whole = open_.agg(F.min("t").alias("line"), F.sum("weight").alias("weight"), F.sum("supply").alias("supply"), F.max("t").alias("last")).first()
    if whole.line is None:
        return 0.0, 0
    if budget is None:
        return whole.line, whole.line * whole.weight
    if budget >= whole.supply:
        return whole.last, budget
    # at the time a source runs out, those that ran out before gave all they have and the others their weight
    at = F.floor(F.log2("t") * F.lit(64))
    run = running_total(open_, [], at, ["t", "source"], "supply", "gone")
    run = running_total(run.withColumn("weight", F.col("weight").cast("double")), [], at, ["t", "source"], "weight", "out")
    given = F.col("gone") + F.col("t") * (F.lit(whole.weight) - F.col("out"))
    short = run.where(given < F.lit(float(budget))).agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("gone"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("out")).first()
    return (budget - short.gone) / (whole.weight - short.out), budget


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the mix, the plan of its sources, the sized documents).

    The mix: (doc_id, source, use, n_tokens, virtual_finish, total_tokens), use counting from 1.
    """
    work = Workspace(docs.sparkSession, "mixing")
    sized = sized if sized is not None else work.cut(sized_documents(docs), "sized")
    shares = work.cut(plan(sized, targets), "plan")
    line, total = finish_line(shares, budget)
    # a pass more than the line strictly needs, so that rounding never loses a document
    passes = F.least(F.col("repeats"), F.floor(F.lit(line) * F.col("weight") / F.col("tokens")) + 1).cast("int")
    usable = shares.where("supply > 0 and weight > 0").select(
        "source", F.col("weight").alias("_w"), passes.alias("_passes"), F.col("tokens").alias("_pass_tokens"), F.greatest(F.lit(1), F.floor(F.col("documents") / F.lit(ROWS_PER_BUCKET))).alias("_buckets"), "documents"
    )
    n_uses = usable.agg(F.coalesce(F.sum(F.col("documents") * F.col("_passes")), F.lit(0)).alias("n")).first().n
    uses = lookup(sized, usable.drop("documents"), "source", written=True).where("_passes > 0")
    uses = uses.select("*", F.explode(F.sequence(F.lit(1), F.col("_passes"))).alias("use"))
    uses = uses.withColumn("_h", F.xxhash64("doc_id", "use", F.lit(seed)))
    bucket = F.pmod(F.shiftright("_h", 20), F.col("_buckets"))
    uses = uses.withColumn("_slot", bucket)
    run = running_total(uses, ["source", "use"], F.col("_slot"), ["_h", "doc_id"], "n_tokens", "_run")
    finish = ((F.col("use") - 1) * F.col("_pass_tokens") + F.col("_run")) / F.col("_w")
    served = run.select("doc_id", "source", "use", "n_tokens", finish.alias("virtual_finish")).where(F.col("virtual_finish") <= F.lit(line * (1 + 1e-12)))
    buckets = max(1, n_uses // ROWS_PER_BUCKET)
    at = F.floor(F.col("virtual_finish") / F.lit(line or 1.0) * buckets)
    served = running_total(served, [], at, ["virtual_finish", "source", "doc_id", "use"], "n_tokens", "total_tokens")
    return served.where(F.col("total_tokens") <= F.lit(float(total) + 0.5)), shares, sized


def shares_reached(mixed: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, supply_docs, supply_tokens, used_rows, used_tokens, actual_share) of the listed sources."""
    work = Workspace(mixed.sparkSession, "shares")
    used = work.cut(mixed.groupBy("source").agg(F.count("doc_id").alias("used_rows"), F.sum("n_tokens").alias("used_tokens")), "used")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    every = used.agg(F.sum("used_tokens")).scalar()
    return shares.join(used, "source", "left").select(
        "source", F.col("weight").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("documents").alias("supply_docs"), F.col("tokens").alias("supply_tokens"),
        zero("used_rows").alias("used_rows"), zero("used_tokens").alias("used_tokens"), F.coalesce(F.round(F.col("used_tokens") / every, 6), F.lit(0.0)).alias("actual_share"),
    )


def broken_promises(mixed: DataFrame, shares: DataFrame, line: float) -> DataFrame:
    """(promise, n): how often a mix breaks what it promises.

    repeats: a record used beyond its source's cap, or one use counted twice; order: a row whose running total is not
    that of the row before and its own size, in order of virtual finish; share: a source that is not within the size of
    its largest document of what its weight gives it until the finish line.
    """
    caps = mixed.join(shares.select("source", "repeats"), "source", "left")
    beyond = caps.agg(F.count_if((F.col("use") > F.col("repeats")) | (F.col("use") < 1) | F.col("repeats").isNull()).alias("n"))
    twice = mixed.groupBy("doc_id", "use").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    # every row ends where another begins, and a greater total never has a smaller finish
    ends = mixed.select(F.col("total_tokens").alias("at"), F.lit(1).alias("d"), "virtual_finish").unionByName(
        mixed.select((F.col("total_tokens") - F.col("n_tokens")).alias("at"), F.lit(-1).alias("d"), F.lit(None).cast("double").alias("virtual_finish"))
    )
    gaps = ends.groupBy("at").agg(F.sum("d").alias("d")).where("d <> 0 and at <> 0").agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n"))
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max("n_tokens").alias("largest"))
    due = F.least(F.lit(line) * F.col("weight"), F.col("supply").cast("double"))
    off = shares.where("supply > 0 and weight > 0").join(used, "source", "left").agg(F.count_if(F.abs(F.coalesce("used", F.lit(0)) - due) > F.coalesce("largest", due) + 1).alias("n"))
    named = [("repeats", beyond), ("uses", twice), ("order", gaps), ("share", off)]
    out = None
    for promise, df in named:
        one = df.select(F.lit(promise).alias("promise"), F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
