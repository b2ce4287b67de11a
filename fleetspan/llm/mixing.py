"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Document rates minimise the relative entropy to "every document once", weighted by words, under one word
constraint per source.  The solution is an exponential tilt, ``rate = exp(lambda[source])``; the lambdas
are found by Newton steps on the convex dual, whose gradient and curvature Spark sums over the word
counts.  Rates are rounded into whole copies: in the order of a hash, documents below a threshold of
their source get one copy more than the others, and the threshold is where the words meet the target.
What the last document leaves over is then levelled by single documents.

Null sources form a source of their own (last in order).  Null texts have size 0.  Rows that are equal in
id and text get equal copies.  An empty table gives an empty table.  Other columns are kept; columns
named like a result are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import kept, n_words, small

# A thresholds bucket with at most this many documents is sorted by one task.
ROWS_PER_TASK = 20_000
# Rounding goes on while a source is further than this share from its target.
TOLERANCE = 0.0005
LEVELLING_ROUNDS = 10
NEWTON_ROUNDS = 40


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from documents with ``source`` and ``size``.

    Sources in code point order, null last, take the weights in turn.  They share ``share`` times all words
    by weight; no target exceeds ``cap`` times its source, and what is cut off goes to the others by weight.
    Both windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    bounded = numbered.withColumn("_weight", weight).withColumn("_most", cap * F.col("source_size"))
    # Sources fill up in the order of their bound per weight; the first that stays open sets the level, the highest.
    by_bound = Window.orderBy(F.col("_most") / F.col("_weight"), "_rank")
    filled = F.coalesce(F.sum("_most").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    levels = bounded.withColumn("_level", (share * everything - filled) / open_weight)
    level = F.max(F.when(F.col("_most") > F.col("_weight") * F.col("_level"), F.col("_level"))).over(Window.partitionBy(F.lit(0)))
    target = F.least(F.col("_most"), F.coalesce(F.col("_weight") * level, F.col("_most")))
    return levels.select("source", "source_size", target.alias("target"))


def tilt(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, source_size, target, lambda``: Newton steps on the dual of the entropy problem.

    Documents enter by the table of their sizes per source, which is computed once.
    """
    counts = kept(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("_n")), "mix-sizes")
    state = kept(targets.withColumn("lambda", F.lit(0.0)), "mix-state")
    for _ in range(NEWTON_ROUNDS):
        held = small(state, 64).select(F.col("source").alias("_source"), "lambda")
        words = F.col("size") * F.col("_n") * F.exp("lambda")
        moments = (
            counts.join(held, counts["source"].eqNullSafe(F.col("_source")))
            .groupBy("source").agg(F.sum(words).alias("_curvature"))
            .select(F.col("source").alias("_source"), "_curvature")
        )
        stepped = state.join(moments, state["source"].eqNullSafe(F.col("_source")), "left").select(
            "source",
            "source_size",
            "target",
            F.when(
                (F.col("target") > 0) & (F.col("_curvature") > 0),
                F.col("lambda") - (F.col("_curvature") - F.col("target")) / F.col("_curvature"),
            ).otherwise(F.col("lambda")).alias("lambda"),
            F.coalesce(F.abs(F.col("_curvature") - F.col("target")) / F.col("target"), F.lit(0.0)).alias("_gap"),
        )
        done = kept(stepped, "mix-state")
        state = done.drop("_gap")
        if (done.agg(F.max("_gap")).first()[0] or 0.0) < 1e-10:
            break
    return state


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _thresholds(units: DataFrame, tilted: DataFrame, cap: int) -> DataFrame:
    """``source, target, _base, _tau``: documents get ``_base`` copies, and one more if ``_u < _tau``."""
    rate = F.least(F.exp("lambda"), F.lit(float(cap)))
    base = F.when(F.col("target") > 0, F.floor(rate + 1e-9)).otherwise(0).cast("long")
    wanted = F.greatest(F.col("target") - F.col("_base") * F.col("source_size"), F.lit(0.0))
    plan = tilted.withColumn("_base", F.least(base, F.lit(cap).cast("long")))
    plan = plan.select("source", "target", "_base", wanted.alias("_want"))
    # The hash has 63 bits; each level looks at 12 more of them, within the bucket where the words are met.
    open_ = kept(plan.where((F.col("_want") > 0) & (F.col("_base") < cap)).select(
        F.col("source").alias("_source"), "_want", F.lit(0).cast("long").alias("_low"), F.lit(63).alias("_bits")), "mix-open")
    bits = 63
    while True:
        held = small(open_, 64)
        inside = units.join(
            held, _same(F.col("source"), F.col("_source"))
            & (F.shiftright("_u", bits) == F.shiftright("_low", bits) if bits < 63 else F.lit(True)),
        )
        most = inside.groupBy("_source").count().agg(F.max("count")).first()[0] or 0
        if most <= ROWS_PER_TASK or bits < 12:
            break
        bits -= 12
        sums = inside.groupBy("_source", "_want", F.shiftright("_u", bits).alias("_bucket")).agg(F.sum("size").alias("_words"))
        order = Window.partitionBy("_source").orderBy("_bucket")
        before = F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = F.row_number().over(Window.partitionBy("_source").orderBy(F.col("_bucket").desc())) == 1
        reached = sums.withColumn("_before", before).withColumn("_last", last).where(
            (F.col("_before") < F.col("_want")) & ((F.col("_before") + F.col("_words") >= F.col("_want")) | F.col("_last")))
        open_ = kept(reached.select(
            "_source", (F.col("_want") - F.col("_before")).alias("_want"),
            F.shiftleft("_bucket", bits).alias("_low"), F.lit(bits).alias("_bits")), "mix-open")
    order = Window.partitionBy("_source").orderBy("_u", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    near = taken.where(F.col("_before") + F.col("size") / 2 <= F.col("_want"))
    cut = near.groupBy("_source").agg((F.max("_u") + 1).alias("_found"))
    low = open_.select(F.col("_source").alias("_open"), "_low")
    found = low.join(cut, _same(F.col("_open"), F.col("_source")), "left").select(
        F.col("_open").alias("_source"), F.coalesce("_found", "_low").alias("_tau"))
    return kept(
        plan.join(found, _same(F.col("source"), F.col("_source")), "left")
        .select("source", "target", "_base", F.coalesce("_tau", F.lit(0)).cast("long").alias("_tau")), "mix-tau")


def _copies(units: DataFrame, thresholds: DataFrame, changes: DataFrame | None) -> DataFrame:
    """``units`` with ``_target`` and ``copies``."""
    held = small(thresholds, 64).select(F.col("source").alias("_source"), F.col("target").alias("_target"), "_base", "_tau")
    dealt = units.join(held, _same(F.col("source"), F.col("_source")), "left").drop("_source")
    copies = F.col("_base") + (F.col("_u") < F.col("_tau")).cast("long")
    if changes is not None:
        by = small(changes, 64).select(F.col("source").alias("_source"), F.col("_u").alias("_key"), "_delta")
        dealt = dealt.join(by, (F.col("_u") == F.col("_key")) & _same(F.col("source"), F.col("_source")), "left").drop("_source", "_key")
        copies = copies + F.coalesce("_delta", F.lit(0))
    return dealt.withColumn("copies", copies).drop("_base", "_tau", "_delta")


def _levelled(units: DataFrame, thresholds: DataFrame, cap: int) -> DataFrame | None:
    """Single documents that take a copy more or less, so that each source comes nearer to its target."""
    changes = None
    for _ in range(LEVELLING_ROUNDS):
        dealt = _copies(units, thresholds, changes)
        gaps = dealt.groupBy("source").agg(
            F.max("_target").alias("_goal"), F.sum(F.col("copies") * F.col("size")).alias("_taken"))
        gaps = gaps.withColumn("_gap", F.col("_goal") - F.col("_taken")).where(F.abs("_gap") > TOLERANCE * F.col("_goal"))
        gaps = kept(gaps.select(F.col("source").alias("_source"), "_gap"), "mix-gap")
        if gaps.isEmpty():
            break
        size = F.col("size")
        able = F.when(F.col("_gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        left = F.abs(F.abs("_gap") - size)
        best = (
            dealt.join(small(gaps, 48), _same(F.col("source"), F.col("_source")))
            .where(able & (size > 0) & (left < F.abs("_gap")))
            .groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col("_u").alias("u"), F.signum("_gap").cast("long").alias("by"))).alias("_best"))
            .select("source", F.col("_best.u").alias("_u"), F.col("_best.by").alias("_delta"))
        )
        more = best if changes is None else changes.unionByName(best)
        stepped = kept(more.groupBy("source", "_u").agg(F.sum("_delta").alias("_delta")), "mix-change")
        if changes is not None and not stepped.exceptAll(changes).head(1):
            break
        changes = stepped
    return changes


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, slim: bool = False) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken = copies * size``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``.  ``slim`` returns these figures with ``doc_id`` and
    ``source`` only and reads the texts once; otherwise all columns stay and texts are read again, not shuffled.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*own, "_u")
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    units = kept(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_u")), "mix-units")
    targets = kept(source_targets(units, weights, share, float(cap)), "mix-targets")
    thresholds = _thresholds(units, tilt(units, targets), cap)
    changes = _levelled(units, thresholds, cap)
    rows = units if slim else docs.withColumn("size", n_words(F.col("text"))).withColumn("_u", key)
    dealt = _copies(rows, thresholds, changes).drop("_target", "_u")
    held = small(targets, 64).withColumnRenamed("source", "_source")
    return (
        dealt.join(held, _same(F.col("source"), F.col("_source")), "left").drop("_source")
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    dealt = mix_sources(docs, **options)
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    return dealt.where("copies > 0").select(*docs.columns, repeats).drop("_copy")
