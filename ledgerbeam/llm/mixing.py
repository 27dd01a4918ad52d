"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Everything here is DataFrame work. Targets come from a water-filling over the sources; the documents each
source gives are a prefix of a seeded permutation, so reruns agree, and lie in blocks along it; a binary tree
then parts the exact quotas of blocks by source among the output shards, each split a draw from the multivariate
hypergeometric distribution; each shard takes its own run of permuted blocks, disjoint from all others, and is
ordered by a hash of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.llm.common import cut, free_name, word_count

#: Weights of the sources in order of name, repeating.
WEIGHTS = (3, 1, 2)
#: Documents of a block, the unit that the splitting tree deals out.
BLOCK = 16
#: Rows of one source in one bucket of its permutation, about.
BUCKET_ROWS = 4096
#: Documents of one source that one row goes through in order, between runs that go by sums.
FILL = 256


def _keyed(docs: DataFrame) -> DataFrame:
    """Add `key`, a hash of the row, and `nth`, which tells rows of one key apart; equal rows are interchangeable."""
    digest = F.xxhash64("text", F.lit(1))
    marked = docs.withColumn("digest", digest).withColumn("key", F.xxhash64("doc_id", "source", "digest"))
    same = W.partitionBy("key").orderBy("doc_id", "source", "digest")
    return marked.withColumn("nth", F.row_number().over(same))


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, nth): one small row for each document row.

    Null text has size 0. Rows of one key differ in `nth`, so repeated rows stay apart; they are counted, and the
    count is spelled out, so that no task gathers them.
    """
    small = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", F.lit(1)).alias("digest")
    )
    counted = small.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        "doc_id", "source", "size", F.xxhash64("doc_id", "source", "digest").alias("key"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth")
    )


def targets(rows: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, n_docs, source_size, target): weighted shares, none above `most` times its source.

    Sources count in code-point order, null last. What a capped source can't take is shared by weight among
    the others until none is above its cap. The windows over all sources, and the arrays of the splitting tree, hold one
    number or two for each source: they take sources by the million, not by the billion.
    """
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    capped = (
        sums.withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    )
    order = W.orderBy("fill", F.col("source").asc_nulls_last())
    up_to, from_here = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))
    leveled = capped.withColumn("level", (F.col("budget") - spent) / F.sum("weight").over(from_here))
    full = F.col("fill") <= F.col("level")
    water = F.max(F.when(~full, F.col("level"))).over(W.partitionBy())
    return leveled.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * water)).select(
        "source", "n_docs", "source_size", "target"
    )


def _ranked(rows: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """Place of each row in its source's permutation, and the words before it.

    Two levels: sums of hash buckets, then a window in each bucket, so that no task sorts a whole source.
    """
    spot = F.shiftrightunsigned(F.xxhash64("key", "nth", F.lit(seed)), 2)
    dealt = (
        rows.join(goals, rows["source"].eqNullSafe(goals["source"]))
        .drop(goals["source"])
        .withColumn("spot", spot)
        .withColumn(
            "bucket",
            F.floor(F.col("spot") / F.lit(float(2**62)) * F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long"),
        )
    )
    sums = dealt.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"),
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"),
    )
    inside = W.partitionBy("source", "bucket").orderBy("spot", "key", "nth")
    placed = dealt.withColumn("_rank", F.row_number().over(inside)).withColumn(
        "_sum", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    return (
        placed.join(starts, placed["source"].eqNullSafe(F.col("s")) & (placed["bucket"] == F.col("b")))
        .withColumn("rank", F.col("rows_before") + F.col("_rank") - 1)
        .withColumn("words_through", F.col("words_before") + F.col("_sum"))
        .drop("s", "b", "_rank", "_sum", "rows_before", "words_before", "bucket")
    )


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, brought down by the product of the eight factors between."""
    eight = n + 1.0
    for k in range(2, 9):
        eight = eight * (n + float(k))
    return _let(
        n + 8.0,
        lambda x: (x + 0.5) * F.log(x)
        - x
        + 0.9189385332046727
        + 1.0 / (12.0 * x)
        - 1.0 / (360.0 * x * x * x)
        + 1.0 / (1260.0 * x * x * x * x * x),
    ) - F.log(eight)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A hypergeometric value for the uniform number `u`: how many of `drawn` out of `total` are marked.

    Inversion from the mode outward: the mode's probability is known in closed form, its neighbours' by
    ratios. Twelve standard deviations either way hold all probability that a double can tell.
    """

    def bounds(x: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), x["d"] + x["k"] - x["n"]), F.least(x["k"], x["d"])
        peak = F.floor((x["d"] + 1) * (x["k"] + 1) / (x["n"] + 2)).cast("double")
        return F.struct(
            x["n"].alias("n"), x["k"].alias("k"), x["d"].alias("d"), x["u"].alias("u"),
            low.alias("low"), high.alias("high"), F.least(F.greatest(peak, low), high).alias("mode"),
        )

    def walk(x: Column) -> Column:
        n, k, d, low, high, mode = (x[c] for c in ("n", "k", "d", "low", "high", "mode"))
        p = F.exp(_ln_choose(k, mode) + _ln_choose(n - k, d - mode) - _ln_choose(n, d))
        spread = F.sqrt(d * k / n * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)))
        steps = F.greatest(F.lit(1), F.ceil(F.least(spread * 12 + 12, high - low)).cast("int"))
        begin = _let(
            p,
            lambda q: F.struct(
                (x["u"] - q).alias("u"), q.alias("up"), q.alias("down"), F.when(x["u"] < q, mode).alias("found")
            ),
        )

        def step(state: Column, i: Column) -> Column:
            a, b = mode + i, mode - i
            above = F.when(a <= high, state["up"] * (k - a + 1) * (d - a + 1) / (a * (n - k - d + a)))
            below = F.when(b >= low, state["down"] * (b + 1) * (n - k - d + b + 1) / ((k - b) * (d - b)))
            return _let(
                F.struct(F.coalesce(above, F.lit(0.0)).alias("up"), F.coalesce(below, F.lit(0.0)).alias("down")),
                lambda w: F.struct(
                    (state["u"] - w["up"] - w["down"]).alias("u"),
                    w["up"].alias("up"),
                    w["down"].alias("down"),
                    F.when(state["found"].isNotNull(), state["found"])
                    .when(state["u"] - w["up"] < 0, a)
                    .when(state["u"] - w["up"] - w["down"] < 0, b)
                    .alias("found"),
                ),
            )

        walked = F.aggregate(F.sequence(F.lit(1), steps), begin, step, lambda end: end["found"])
        return F.when((n <= 0) | (low >= high), low).otherwise(F.coalesce(walked, mode)).cast("long")

    given = F.struct(
        total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("d"), u.alias("u")
    )
    return _let(_let(given, bounds), walk)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, ends): for each source the running ends of its quota over the shards.

    `quotas` has (source_no, quota). `shards` is rounded up to a power of two. At each node half of its
    blocks, drawn without regard to source, go left: source by source a hypergeometric number of what is
    left, which together is a multivariate hypergeometric draw. All sums stay exact. A node is one row whose
    array has one entry for each source.
    """
    level = quotas.agg(F.array_sort(F.collect_list(F.struct("source_no", "quota"))).alias("q")).withColumn(
        "node", F.lit(1)
    )
    depth = max(0, (shards - 1).bit_length())
    for _ in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        level = level.withColumn("total", total).withColumn("draw", F.expr("total div 2"))
        empty = F.expr("cast(array() as array<struct<source_no:int,quota:bigint>>)")

        def take(state: Column, x: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(F.col("node"), x["source_no"], F.lit(seed)), 11)) / F.lit(float(2**53))
            return _let(
                hypergeometric(state["total"], x["quota"], state["draw"], u),
                lambda left: F.struct(
                    (state["total"] - x["quota"]).alias("total"),
                    (state["draw"] - left).alias("draw"),
                    F.concat(
                        state["left"], F.array(F.struct(x["source_no"].alias("source_no"), left.alias("quota")))
                    ).alias("left"),
                ),
            )

        start = F.struct(F.col("total").alias("total"), F.col("draw").alias("draw"), empty.alias("left"))
        level = level.withColumn("l", F.aggregate("q", start, take)["left"])
        right = F.zip_with(
            "q", "l", lambda a, b: F.struct(a["source_no"].alias("source_no"), (a["quota"] - b["quota"]).alias("quota"))
        )
        level = level.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")),
                )
            ).alias("x")
        ).select("x.node", "x.q")
    leaves = level.select("node", F.inline("q"))
    upto = W.partitionBy("source_no").orderBy("node").rowsBetween(W.unboundedPreceding, 0)
    ends = leaves.withColumn("end", F.sum("quota").over(upto))
    return ends.groupBy("source_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends")
    )


def _fill(pool: DataFrame, state: DataFrame) -> DataFrame:
    """(source_no, rank, nth): documents after the prefix that fill its gap, nth from 0 in order of the permutation.

    `pool` has (source_no, rank, size) of the documents after the prefix, `state` (source_no, gap, after, count).
    Along the whole permutation each document that still fits is taken. A round sets aside what is larger than
    the gap, takes the longest run that fits by running sums, and goes through the next FILL documents one by
    one; rounds follow until no unused document fits.
    """
    nothing = F.expr("cast(array() as array<bigint>)")
    rounds = []
    while True:
        fit = pool.join(state, "source_no").where("rank > after and size > 0 and size <= gap")
        fit = cut(fit.withColumn("bucket", F.expr(f"rank div {BUCKET_ROWS}")))
        if fit.isEmpty():
            break
        before = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        starts = fit.groupBy("source_no", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).select(
            "source_no", "bucket", F.sum("n").over(before).alias("n"), F.sum("words").over(before).alias("words")
        )
        inside = W.partitionBy("source_no", "bucket").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
        placed = cut(
            fit.withColumn("_no", F.count(F.lit(1)).over(inside)).withColumn("_sum", F.sum("size").over(inside))
            .join(starts, ["source_no", "bucket"])
            .withColumn("no", F.coalesce("n", F.lit(0)) + F.col("_no"))
            .withColumn("through", F.coalesce("words", F.lit(0)) + F.col("_sum"))
            .select("source_no", "rank", "size", "gap", "count", "no", "through")
        )
        run = placed.groupBy("source_no").agg(
            F.count_if(F.col("through") <= F.col("gap")).alias("run"),
            (F.first("gap") - F.coalesce(F.max(F.when(F.col("through") <= F.col("gap"), F.col("through"))), F.lit(0))).alias("left"),
        )
        ahead = placed.join(run, "source_no").where((F.col("no") > F.col("run")) & (F.col("no") <= F.col("run") + FILL))
        walked = ahead.groupBy("source_no").agg(
            F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct("rank", "size"))).alias("next")
        ).select(
            "source_no",
            F.element_at("next", -1)["rank"].alias("after"),
            F.aggregate(
                "next",
                F.struct(F.col("left").alias("gap"), nothing.alias("ranks")),
                lambda a, x: F.when(
                    x["size"] <= a["gap"],
                    F.struct((a["gap"] - x["size"]).alias("gap"), F.array_append(a["ranks"], x["rank"]).alias("ranks")),
                ).otherwise(a),
            ).alias("walk"),
        )
        reached = cut(
            run.join(walked, "source_no", "left")
            .join(placed.groupBy("source_no").agg(F.first("count").alias("count")), "source_no")
            .select("source_no", "run", "count", "after", "walk.gap", F.coalesce("walk.ranks", nothing).alias("ranks"))
        )
        rounds.append(
            placed.where("through <= gap").select("source_no", "rank", (F.col("count") + F.col("no") - 1).alias("nth"))
        )
        rounds.append(
            reached.select("source_no", (F.col("count") + F.col("run")).alias("_from"), F.posexplode("ranks").alias("_at", "rank"))
            .select("source_no", "rank", (F.col("_from") + F.col("_at")).alias("nth"))
        )
        # without a next document to go through, all that fitted were taken
        state = reached.where("after is not null").select(
            "source_no", "gap", "after", (F.col("count") + F.col("run") + F.size("ranks")).alias("count")
        )
    taken = pool.where("false").select("source_no", "rank", F.col("rank").alias("nth"))
    for r in rounds:
        taken = taken.union(r)
    return taken


def draws(rows: DataFrame, share: float = 1.5, shards: int = 16, seed: int = 20, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Which documents the mix takes, how often, and where each copy goes.

    `rows` is what `sized_rows` gives. A source gives all its documents as often as its target is a whole
    multiple of its size; the rest is the longest prefix of its permutation that fits, and then every document
    after it that still fits into the gap, first come first served. So no document is taken more
    than twice at the default caps, and no source goes over its target. What a source gives lies in blocks of
    BLOCK documents, pass after pass, and the splitting tree says which of them go to which shard.
    Returns the columns of `rows` with source_size, target and `copies`, an array of (shard, spot), empty for
    documents that the mix leaves out. `spot` orders a shard's documents: its local shuffle.
    """
    rows = cut(rows)
    goals = cut(targets(rows, share, 2.0, weights))
    ranked = cut(_ranked(rows, goals, seed))
    size = F.greatest(F.col("source_size"), F.lit(1))
    ranked = ranked.withColumn("full", F.floor(F.col("target") / size).cast("int")).withColumn(
        "rest", F.col("target") - F.col("full") * F.col("source_size")
    )
    ranked = ranked.withColumn("fits", (F.col("words_through") <= F.col("rest")) & (F.col("rest") > 0))
    reach = ranked.groupBy("source").agg(
        F.max(F.when(F.col("fits"), F.col("words_through"))).alias("through"),
        F.count_if(F.col("fits")).alias("n_fit"),
        F.first("full").alias("full_"),
        F.first("n_docs").alias("n_docs_"),
        F.first("rest").alias("rest_"),
    ).withColumn("gap", F.col("rest_") - F.coalesce("through", F.lit(0))).select(
        F.col("source").alias("s"), "gap", "n_fit", "full_", "n_docs_"
    )
    sources = cut(reach.withColumn("source_no", F.row_number().over(W.orderBy(F.col("s").asc_nulls_last()))))
    after = ranked.join(sources, ranked["source"].eqNullSafe(sources["s"])).where(F.col("rank") >= F.col("n_fit"))
    pool = after.select("source_no", "rank", "size")
    state = sources.select("source_no", "gap", (F.col("n_fit") - 1).alias("after"), F.lit(0).cast("long").alias("count"))
    filled = cut(_fill(pool, state))
    extras = filled.groupBy("source_no").agg(F.count(F.lit(1)).alias("n_extra"))
    quotas = cut(
        sources.join(extras, "source_no", "left")
        .withColumn("drawn", F.col("full_") * F.col("n_docs_") + F.col("n_fit") + F.coalesce("n_extra", F.lit(0)))
        .withColumn("quota", F.expr(f"(drawn + {BLOCK - 1}) div {BLOCK}"))
        .select("s", "n_fit", "source_no", "quota")
    )
    plan = quotas.join(splitting_tree(quotas, shards, seed), "source_no")
    whole = ranked.join(plan, ranked["source"].eqNullSafe(plan["s"])).drop("s")
    whole = whole.join(filled.withColumnRenamed("nth", "extra_no"), ["source_no", "rank"], "left")
    nothing = F.expr("cast(array() as array<bigint>)")
    last = (
        F.when(F.col("fits"), F.array(F.col("full") * F.col("n_docs") + F.col("rank")))
        .when(F.col("extra_no").isNotNull(), F.array(F.col("full") * F.col("n_docs") + F.col("n_fit") + F.col("extra_no")))
        .otherwise(nothing)
    )
    passes = F.when(
        F.col("full") > 0,
        F.transform(F.sequence(F.lit(0), F.col("full") - 1), lambda i: i * F.col("n_docs") + F.col("rank")),
    ).otherwise(nothing)
    copies = F.transform(
        F.concat(passes, last),
        lambda no: F.struct(
            F.size(F.filter("ends", lambda e: e * BLOCK <= no)).alias("shard"),
            F.xxhash64(no, F.col("source_no"), F.lit(seed + 1)).alias("spot"),
        ),
    )
    return whole.select("doc_id", "source", "size", "key", "nth", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, share: float = 1.5, shards: int = 16, seed: int = 20) -> DataFrame:
    """The mixed documents: every column of `docs`, a row for each copy taken, with mix_shard and mix_spot.

    Null sources form one source, null texts count as empty and are taken with whole passes only, an empty
    table gives an empty mix. Rows equal in doc_id, text and source are told apart by number, and each counts. Where
    `docs` has a column mix_shard or mix_spot, the new one takes an underscore more.
    """
    kept = [F.col(f"_doc.`{c}`") for c in docs.columns]
    chosen = draws(sized_rows(docs), share, shards, seed).where(F.size("copies") > 0).select("key", "nth", "copies")
    rows = _keyed(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc")))
    # a condition on nth beside the key lets the join keep the partitions of the window that made nth
    met = rows.join(chosen, (rows["key"] == chosen["key"]) & (rows["nth"] - chosen["nth"] == 0))
    placed = met.select("_doc", F.explode("copies").alias("_copy"))
    names = {part: free_name(docs, f"mix_{part}") for part in ("shard", "spot")}
    return placed.select(*kept, *[F.col(f"_copy.{part}").alias(name) for part, name in names.items()])


def op7_mix_sources(spark, sf_dir):
    """Contract query: what the mix takes of every document, and the shards and places that its copies go to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = draws(sized_rows(docs))
    listed = lambda part: F.array_join(F.transform("copies", lambda c: c[part].cast("string")), ",")
    return drawn.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.size("copies") * F.col("size")).cast("long").alias("taken"),
        F.size("copies").alias("n_copies"),
        listed("shard").alias("shards"),
        listed("spot").alias("spots"),
    )
