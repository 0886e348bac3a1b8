"""Temperature mixing of sources, in DataFrame functions alone.

Source token shares p become weights proportional to p^a. The exponent a in
[0, 1] is found by bisection: as much of the natural proportions as the target
entropy, or the largest allowed number of repetitions of a source, permits.
The weights are realised exactly to the token budget: every source is read in
a fixed pseudo-random order, again and again, up to its quota, and its reads
are spread evenly over blocks, so each block is a small permutation with the
target weights.

Nothing is ranked within a whole source: documents fall into hash buckets, a
source's order runs through its buckets, and only the rows of one bucket are
ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.llm.graph import cut

#: Buckets that a source's documents are dealt over, bits of fixed point of the
#: weights, and steps of the bisection.
BUCKETS, SCALE, STEPS = 4096, 10**15, 40

#: Stands for a null source in keys.
NO_SOURCE = "\x00"


def word_count(text: Column) -> Column:
    """Words outside ``\\x20 \\x09-\\x0D`` as the token measure; null counts 0."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def _hash(*cols) -> Column:
    """32 pseudo-random bits, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def source_weights(totals: DataFrame, budget: Column, target_entropy: float | None = None,
                   max_repeats: float | None = None, whole: bool = False) -> DataFrame:
    """``source, tokens, weight, budget``: the weights, as whole numbers of which
    all sources' add up to about ``SCALE``, from ``source, tokens``.

    The totals of all sources (one row each, which is bounded by the number of
    sources) meet in one row, where an ``aggregate`` bisects the exponent: the
    largest one whose entropy is at least ``target_entropy`` times that of equal
    weights, and the smallest whose largest ``quota / tokens`` is at most
    ``max_repeats``. If both are given, the repetition limit wins. Sources
    without tokens are not returned. With ``whole`` the budget is not the given
    one, but the least at which every source is read once or more.
    """
    live = F.col("tokens") > 0
    row = totals.agg(F.collect_list(F.when(live, F.struct("source", "tokens"))).alias("s"), F.sum("tokens").alias("all"),
                     budget.alias("budget"))
    shares = F.transform("s", lambda x: x["tokens"] / F.col("all"))
    row = row.withColumn("p", shares)

    def powered(a):
        return F.transform("p", lambda x: F.pow(x, a))

    def total(xs):
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def budget_at(a):
        if not whole:
            return F.col("budget")
        z = total(powered(a))
        return F.ceil(F.array_max(F.transform(F.arrays_zip(powered(a).alias("w"), F.col("s").alias("t")), lambda x: x["t"]["tokens"] * z / x["w"])))

    def entropy(a):
        z = total(powered(a))
        return total(F.transform(powered(a), lambda x: -(x / z) * F.ln(x / z)))

    def worst_repeats(a):
        z = total(powered(a))
        return F.array_max(F.transform(F.arrays_zip(powered(a).alias("w"), F.col("s").alias("t")),
                                       lambda x: x["w"] / z * budget_at(a) / x["t"]["tokens"]))

    def bisect(fits_low):
        """The exponent next to where ``fits_low`` turns, from the half it keeps."""
        step = lambda acc, _: F.when(fits_low((acc["lo"] + acc["hi"]) / 2), F.struct(
            ((acc["lo"] + acc["hi"]) / 2).alias("lo"), acc["hi"].alias("hi"))).otherwise(
            F.struct(acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)

    a = F.lit(1.0)
    if target_entropy is not None:
        a = bisect(lambda m: entropy(m) >= target_entropy * F.ln(F.size("s").cast("double")))["lo"]
        a = F.when(entropy(F.lit(1.0)) >= target_entropy * F.ln(F.size("s").cast("double")), F.lit(1.0)).otherwise(a)
    if max_repeats is not None:
        least = bisect(lambda m: worst_repeats(m) > max_repeats)["hi"]
        least = F.when(worst_repeats(F.lit(0.0)) <= max_repeats, F.lit(0.0)).otherwise(least)
        a = F.greatest(a, least)
    row = row.withColumn("a", a).withColumn("budget", budget_at(F.col("a")))
    return row.select("budget", "a", F.explode(F.arrays_zip(F.col("s").alias("t"), powered(F.col("a")).alias("w"),
                                                            F.array_repeat(total(powered(F.col("a"))), F.size("s")).alias("z"))).alias("x")).select(
        "x.t.source", "x.t.tokens", F.round(F.col("x.w") / F.col("x.z") * SCALE).cast("long").alias("weight"), "budget")


def largest_remainders(weights: DataFrame) -> DataFrame:
    """``source, quota, budget``: the budget in whole tokens by weight. Every source gets
    the whole part of its share, and the tokens left over go to the largest
    remainders, ties by source, so quotas add up to the budget. Exact arithmetic; a
    row per source."""
    every = W.partitionBy(F.lit(0))  # one row per source, as in ``source_weights``
    due = F.col("weight").cast("decimal(19,0)") * F.col("budget").cast("decimal(18,0)")
    w = weights.withColumn("_all", F.sum("weight").over(every).cast("decimal(19,0)")).withColumn("_due", due)
    w = w.withColumn("_rest", F.col("_due") % F.col("_all"))
    w = w.withColumn("_whole", ((F.col("_due") - F.col("_rest")) / F.col("_all")).cast("long"))
    left = F.col("budget") - F.sum("_whole").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("_rest"), "source"))
    return w.select("source", "budget", (F.col("_whole") + (rank <= left).cast("long")).alias("quota"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                budget_share: float = 1.0, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0,
                block_tokens: int = 1 << 20, seed: int = 0, whole: bool = False) -> DataFrame:
    """The reads of the mixture: ``doc_id, source, n_tokens, copy, block, place``.

    The budget is ``budget_share`` of all tokens (words), or with ``whole`` the
    least that reads every document once or more at these weights. A source with quota q
    and t tokens is read q / t times over: ``copy`` 0, 1, ... and of the last
    copy the documents whose tokens begin before the quota. ``block`` numbers
    the blocks of about ``block_tokens``, in each of which every source has its
    weight; ``place`` is a pseudo-random number that orders a block (ties by
    source, id, copy).

    A null source is a source of its own (``source`` null). Null and empty
    texts have no tokens: they are read whenever a copy reaches them and are
    read again with it; a source with no tokens at all is read once.
    Rows with equal ids and sources count each; a null id is an ordinary value.
    Ties in the order follow id, tokens. An empty table gives no rows; other
    columns are not looked at.
    """
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    counted = cut(docs.select(F.col(id_col).alias("doc_id"), key.alias("source"),
                              word_count(F.col(text_col)).alias("n_tokens")).withColumn(
        "draw", _hash(F.lit(seed), "source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    counted = counted.withColumn("bucket", (F.col("draw") % BUCKETS).cast("int"))
    per_bucket = counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    totals = per_bucket.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    weights = source_weights(totals, F.floor(F.sum("tokens") * F.lit(float(budget_share))), target_entropy, max_repeats, whole)
    quota = F.coalesce("quota", F.lit(0))
    quotas = totals.join(largest_remainders(weights), "source", "left").select(
        "source", "tokens", (F.greatest(quota, "tokens") if whole else quota).alias("quota"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("budget", F.lit(0)) / block_tokens)).alias("blocks"))
    # At most BUCKETS rows to a source here, whatever its documents: what belongs to
    # a source reaches its documents by bucket, so no task gets a whole source.
    starts = per_bucket.withColumn("before", F.sum("tokens").over(
        W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.drop("tokens").join(quotas, "source")
    in_bucket = W.partitionBy("source", "bucket").orderBy("draw", "doc_id", "n_tokens")
    placed = (counted.withColumn("inside", F.sum("n_tokens").over(in_bucket.rowsBetween(W.unboundedPreceding, -1)))
              .join(starts, ["source", "bucket"])
              .withColumn("at", F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))))
    copies = F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.ceil((F.col("quota") - F.col("at")) / F.col("tokens")))
    reads = placed.withColumn("copies", copies.cast("int")).where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    spot = (F.col("at") + F.col("copy") * F.col("tokens")) / F.col("quota")
    block = F.when(F.col("quota") > 0, F.least(F.floor(spot * F.col("blocks")), F.col("blocks") - 1)).otherwise(F.lit(0))
    return reads.select("doc_id", F.when(F.col("source") != NO_SOURCE, F.col("source")).alias("source"), "n_tokens",
                        F.col("copy").cast("long").alias("copy"), block.cast("long").alias("block"),
                        _hash(F.lit(seed + 1), "source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              F.col("copy").cast("string")).alias("place"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as ``mix_sources``
    (which takes ``options``) reads it, sorted by block and place.

    Columns are those of ``docs``. Rows of equal id and source are read equally
    often.
    """
    reads = mix_sources(docs, id_col, text_col, source_col, **options)
    reads = reads.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "copy").agg(
        F.min("block").alias("_block"), F.min("place").alias("_place"))
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    held = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    mixed = held.join(reads, held[of[id_col]].eqNullSafe(reads["_id"]) & held[of[source_col]].cast("string").eqNullSafe(reads["_source"]))
    order = ["_block", "_place", "_source", "_id", "copy"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).toDF(*docs.columns)
