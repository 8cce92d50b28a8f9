"""File changes: batches by a capped gap, and what remains of each path's changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.staging import checkpointed
from weftgraph.sources.facts import owner_of
from weftgraph.sources.ignore import ignore_filter


def change_source(raw: DataFrame) -> DataFrame:
    """Renames as a deletion of the old path and a change of the new one."""
    one = lambda path, kind: F.struct(F.col(path).alias("path"), kind.alias("change_type"))
    rows = F.when(F.col("change_type") == "renamed", F.array(one("old_path", F.lit("deleted")), one("path", F.lit("changed")))).otherwise(F.array(one("path", F.col("change_type"))))
    return raw.select("seq", "ts", F.explode(rows).alias("x")).select("seq", "ts", "x.*")


IGNORE_FILE = ".gitignore"


def filtered(changes: DataFrame, rules: DataFrame, claims: DataFrame, root: str, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """Changes of files that some parser owns and no rule shuts out; files of rules always pass."""
    own = owner_of(changes, claims)
    below = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    judged = ignore_filter(own.select(below.alias("path")).distinct(), rules).withColumnRenamed("path", "below")
    is_rules = F.regexp_extract("path", r"([^/]*)$", 1) == ignore_file
    out = own.withColumn("below", below).join(judged, "below", "left")
    return out.where(is_rules | (F.col("parser_id").isNotNull() & F.coalesce("included", F.lit(True)))).select(*changes.columns, "parser_id")


def control(batched: DataFrame, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """(batch, action, n): a batch with a change of an ignore file is a full rescan instead."""
    is_rules = F.regexp_extract("path", r"([^/]*)$", 1) == ignore_file
    return batched.groupBy("batch").agg(F.when(F.bool_or(is_rules), "rescan").otherwise("apply").alias("action"), F.count("*").alias("n"))


def fold_changes(kinds: Column) -> Column:
    """What a path's changes, in order, amount to."""

    def step(acc: Column, now: Column) -> Column:
        return (
            F.when(acc.isNull(), now)
            .when(now == "deleted", F.lit("deleted"))
            .when((acc == "deleted") & (now == "created"), F.lit("changed"))
            .when(acc == "created", F.lit("created"))
            .otherwise(now)
        )

    return F.aggregate(kinds, F.lit(None).cast("string"), step)


SLICES = 4096


def _sliced(times: DataFrame, low: int, width: int) -> DataFrame:
    return times.withColumn("slice", F.floor((F.col("us") - low) / width))


def batch_starts(times: DataFrame, gap: int, cap: int) -> DataFrame:
    """(us) of the distinct times (us) at which batches begin. The rule runs through the whole log, so it is cut into slices
    of time: windows run within slices, and what slices tell one another is one row each, SLICES at most. A batch that
    begins at t is followed by one at the first time beyond t + cap of the same run (times without a silence between),
    so the beginnings are what these steps reach from the runs' first times: steps are doubled until nothing is new."""
    ends = times.agg(F.min("us"), F.max("us")).first()
    if ends[0] is None:
        return times
    low, width = ends[0], max(gap + cap + 1, (ends[1] - ends[0]) // SLICES + 1)
    sliced = checkpointed(_sliced(times, low, width))
    whole = Window.orderBy("slice")  # at most SLICES rows
    edges = sliced.groupBy("slice").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    edges = edges.select("slice", F.lag("last").over(whole).alias("before"), F.lead("first").over(whole).alias("after"))
    own = Window.partitionBy("slice").orderBy("us")
    near = sliced.join(F.broadcast(edges), "slice")
    since = F.col("us") - F.coalesce(F.lag("us").over(own), "before")
    # Where a time's run begins: the last such time of its slice, or of slices before.
    near = near.withColumn("begins", F.when(since.isNull() | (since > gap), F.col("us")))
    last = near.groupBy("slice").agg(F.max("begins").alias("last"))
    last = last.select("slice", F.max("last").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    runs = near.join(F.broadcast(last), "slice").select("us", F.coalesce(F.max("begins").over(own), "earlier").alias("run"))
    # The first time beyond each time's cap: points and questions in one order, from behind.
    asked = runs.select((F.col("us") + cap).alias("us"), F.lit(1).alias("is_question"), F.col("us").alias("from"), "run")
    both = _sliced(runs.select("us", F.lit(0).alias("is_question"), F.lit(None).cast("bigint").alias("from"), "run").union(asked), low, width)
    later = Window.partitionBy("slice").orderBy(F.desc("us"), F.desc("is_question")).rowsBetween(Window.unboundedPreceding, -1)
    point = F.when(F.col("is_question") == 0, F.struct("us", "run"))
    met = both.withColumn("in_slice", F.last(point, True).over(later)).where("is_question = 1")
    firsts = _sliced(runs, low, width).groupBy("slice").agg(F.min(F.struct("us", "run")).alias("x"))
    every = met.select("slice").union(firsts.select("slice")).distinct().join(firsts, "slice", "left")
    following = every.select("slice", F.first("x", True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("x"))
    met = met.join(F.broadcast(following), "slice").select("from", "run", F.coalesce("in_slice", "x").alias("next"))
    step = checkpointed(met.where("next.run = run").select("from", F.col("next.us").alias("to")))
    known = checkpointed(runs.where("us = run").select("us"))
    n = known.count()
    while True:
        reached = known.join(step, F.col("us") == F.col("from")).select(F.col("to").alias("us"))
        known = checkpointed(known.union(reached).distinct())
        now = known.count()
        if now == n:
            return known
        n = now
        far = step.select(F.col("from").alias("first"), F.col("to").alias("middle"))
        step = checkpointed(far.join(step, F.col("middle") == F.col("from")).select(F.col("first").alias("from"), "to"))


def micro_batch(changes: DataFrame, gap: int, cap: int) -> DataFrame:
    """Changes with ``batch``, the time (us) of the first of its batch: a batch ends when a change comes later than gap
    after the last or later than cap after the first."""
    rows = changes.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    times = checkpointed(rows.select(F.col("_us").alias("us")).distinct())
    starts = batch_starts(times, gap, cap)
    ends = times.agg(F.min("us"), F.max("us")).first()
    if ends[0] is None:
        return rows.withColumn("batch", F.col("_us")).drop("_us")
    # Each time takes the last beginning up to it, of its slice of time or of one before.
    low, width = ends[0], max(gap + cap + 1, (ends[1] - ends[0]) // SLICES + 1)
    marked = _sliced(times.join(starts.select("us", F.col("us").alias("start")), "us", "left"), low, width)
    last = marked.groupBy("slice").agg(F.max("start").alias("last"))
    last = last.select("slice", F.max("last").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))  # at most SLICES rows
    named = marked.join(F.broadcast(last), "slice").select("us", F.coalesce(F.max("start").over(Window.partitionBy("slice").orderBy("us")), "earlier").alias("batch"))
    return rows.join(named.withColumnRenamed("us", "_us"), "_us").drop("_us")


def coalesce_changes(batched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, batch, path, change_type, n): the net change of each path in each batch, of each watch where keys name one."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "change_type")))
    return batched.groupBy(*keys, "batch", "path").agg(ordered.alias("all")).select(*keys, "batch", "path", fold_changes(F.transform("all", lambda x: x["change_type"])).alias("change_type"), F.size("all").cast("long").alias("n"))


def effective_changes(changes: DataFrame, present: DataFrame, excluded: DataFrame) -> DataFrame:
    """Changes of paths that are excluded or gone count as deletions."""
    here, out = present.select("path", F.lit(True).alias("here")).distinct(), excluded.select("path", F.lit(True).alias("out")).distinct()
    j = changes.join(here, "path", "left").join(out, "path", "left")
    return j.select("path", F.when(F.col("out").isNotNull() | F.col("here").isNull(), "deleted").otherwise(F.col("change_type")).alias("change_type"))


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a stream that hands each micro-batch's net changes to apply(changes, batch id)."""

    def each(df: DataFrame, n: int) -> None:
        apply(coalesce_changes(change_source(df).withColumn("batch", F.lit(n).cast("long"))), n)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
