"""Intervals, windows, ranks and orders. Clocks are whole samples; intervals are half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlake.functions.text import prefix_sums

from .lineage import cut_lineage
from .scan import carried, earlier, in_range, passed_on, ranges, running, stitched
from .sizes import MOST, sized


#: How aggregates of the pieces of a range are put together over ranges.
TOGETHER = {"sum": F.sum, "min": F.min, "max": F.max}


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str, touching: bool = True, collect: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """W1 (touching intervals merge) and W2 (only strict overlap merges): transitive union for each key.

    Gaps and islands inside ranges of (key, start, end); an island that the furthest end of earlier ranges reaches goes on with the one open
    there, so a key may hold any share of the rows. `collect` adds aggregates ("sum", "min" or "max" of a column) of the members.
    """
    w = in_range(key, [start, end])
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = reach.isNull() | (F.col(start) > reach if touching else F.col(start) >= reach)
    rows = ranges(df, key, [start, end]).withColumn("_new", new.cast("int")).withColumn("_piece", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    collect = collect or {}
    pieces = cut_lineage(rows.groupBy(*key, "_range", "_piece").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"), *[TOGETHER[how](c).alias(n) for n, (how, c) in collect.items()]))
    tops = pieces.groupBy(*key, "_range").agg(F.max(end).alias("_top"))
    pieces = carried(pieces, passed_on(tops, key, _reach=F.max("_top").over(earlier(key))), key)
    joined = F.col(start) <= F.col("_reach") if touching else F.col(start) < F.col("_reach")
    return stitched(pieces, key, joined, [F.min(start).alias(start), F.max(end).alias(end), F.sum("members").alias("members"), *[TOGETHER[how](n).alias(n) for n, (how, _) in collect.items()]])


def candidate_windows(seeds: DataFrame, key: str, at: str, frames: Column, before: int, after: int) -> DataFrame:
    """Seeds widened by context, clipped to the recording, and merged where they strictly overlap, with the number of seeds (members) and the
    first and last one. A range join of seeds with windows lists them all."""
    wide = seeds.withColumn("start", F.greatest(F.lit(0), F.col(at) - before)).withColumn("end", F.least(frames, F.col(at) + after))
    return merge_intervals(wide, [key], "start", "end", touching=False, collect={"first_seed": ("min", F.col(at)), "last_seed": ("max", F.col(at))})


def coverage_totals(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Samples processed, distinct and overlapping, by key."""
    raw = df.groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias("processed"))
    union = merge_intervals(df, key, start, end).groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias("distinct"))
    return raw.join(union, key).withColumn("overlap", F.col("processed") - F.col("distinct"))


def runs(df: DataFrame, key: list[str], clock: str, value: Column, hop: int | None = None, carry: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Maximal runs of an equal value; with `hop`, a gap in the clock breaks a run. Null is a value.

    Runs inside ranges of (key, clock); the first of a range goes on with the last one before it if that has its value. `carry` adds
    aggregates ("sum", "min" or "max" of a column) of the rows of a run.
    """
    w = in_range(key, [clock])
    same = F.col("value").eqNullSafe(F.lag("value").over(w)) & F.lag(clock).over(w).isNotNull()
    if hop is not None:
        same = same & (F.col(clock) - F.lag(clock).over(w) == hop)
    carry = carry or {}
    rows = ranges(df.withColumn("value", value), key, [clock])
    rows = rows.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_piece", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    pieces = cut_lineage(rows.groupBy(*key, "_range", "_piece", "value").agg(F.min(clock).alias("first"), F.max(clock).alias("last"), F.count("*").alias("length"), *[TOGETHER[how](c).alias(n) for n, (how, c) in carry.items()]))
    ends = pieces.groupBy(*key, "_range").agg(F.max(F.struct("_piece", "value", "last")).alias("_end"))
    pieces = carried(pieces, passed_on(ends, key, _before=F.lag("_end").over(W.partitionBy(*key).orderBy("_range"))), key)
    joined = (F.col("_piece") == 1) & F.col("_before").isNotNull() & F.col("value").eqNullSafe(F.col("_before.value"))
    if hop is not None:
        joined = joined & (F.col("first") - F.col("_before.last") == hop)
    return stitched(pieces, key, joined, [F.first("value").alias("value"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"), *[TOGETHER[how](n).alias(n) for n, (how, _) in carry.items()]])


def collapsed(frames: DataFrame, key: str, clock: str, value: Column, drop: list) -> DataFrame:
    """T13 on a table of frames: a row for each run of a value that is not dropped (key, value, first, last); a case may hold any share of the frames."""
    return runs(frames, [key], clock, value).where(~F.col("value").isin(*drop)).select(key, "value", "first", "last")


def sequence_hits(rows: DataFrame, key: str, order: str, value: str, needle: list) -> DataFrame:
    """Places (`start`, from 0) at which the needle stands in a key's values, overlapping ones too.

    Each value names the places it can belong to, one for each equal member of the needle, and a place named by all members is a hit.
    """
    placed = running(rows.select(key, order, value), [key], [order], place=F.lit(1))
    members = F.filter(F.array(*[F.when(F.col(value) == x, F.lit(j)) for j, x in enumerate(needle)]), lambda j: j.isNotNull())
    named = placed.select(key, "place", F.explode(members).alias("_j")).select(key, (F.col("place") - F.col("_j")).alias("start"))
    return named.groupBy(key, "start").agg(F.count("*").alias("_n")).where(F.col("_n") == len(needle)).select(key, "start")


def longest_run(df: DataFrame, key: list[str], clock: str, eligible: Column, hop: int | None = None) -> DataFrame:
    """The longest run of eligible rows for each key (0 if there is none)."""
    return runs(df, key, clock, eligible, hop).groupBy(*key).agg(F.max(F.when(F.col("value"), F.col("length")).otherwise(0)).alias("longest"), F.count_if("value").alias("runs"))


def best_triplet(df: DataFrame, key: list[str], clock: str, prob: str, hop: int) -> DataFrame:
    """The greatest minimum over three consecutive hops, and the last hop of the first such triplet.

    Each hop goes to the three triplets it is in, by (key, last hop), so a long key needs no order. The clock is unique in a key.
    """
    ends = F.explode(F.array(*[F.col(clock) + k * hop for k in range(3)])).alias("_end")
    low = df.select(*key, ends, F.col(prob).alias("_p")).groupBy(*key, "_end").agg(F.count("*").alias("_n"), F.min("_p").alias("_low")).where("_n = 3")
    return low.groupBy(*key).agg(F.max("_low").alias("best"), F.max_by("_end", F.struct("_low", -F.col("_end"))).alias("at"))


def peak(df: DataFrame, key: list[str], clock: str, prob: str) -> DataFrame:
    """Highest probability, earliest sample."""
    return df.groupBy(*key).agg(F.max(prob).alias("peak"), F.max_by(clock, F.struct(F.col(prob), -F.col(clock))).alias("at"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def capped(df: DataFrame, source: str, order: list[Column], key: list[str], per_source: int, total: int) -> DataFrame:
    """At most per_source rows of a source, then at most `total` of all; each row keeps its state: SELECTED or EXCLUDED_*.

    Tasks cut the rows of a source to per_source before they are shuffled; source_rank is null beyond that.
    """
    best = top_per_group(df, [source], order, per_source, "source_rank")
    top = best.orderBy(*order).limit(total).select(*key, F.lit(True).alias("_top"))
    chosen = best.select(*key, "source_rank").join(F.broadcast(top) if total <= MOST else top.hint("merge"), key, "left")
    out = df.join(chosen.hint("merge"), key, "left")
    state = F.when(F.col("source_rank").isNull(), "EXCLUDED_PER_SOURCE_CAP").when(F.col("_top").isNull(), "EXCLUDED_GLOBAL_CAP").otherwise("SELECTED")
    return out.withColumn("state", state).drop("_top")


def round_robin(df: DataFrame, stratum: str, order: Column, limit: int, tie: list[Column] | None = None) -> DataFrame:
    """Rows by their rank in the stratum, then the stratum (or `tie`), the first `limit`; `turn` is that rank."""
    out = df.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(order)).cast("long"))
    return out.where(F.col("turn") <= limit).orderBy("turn", *(tie or [F.col(stratum)])).limit(limit)


def numbered(df: DataFrame, order: list[Column], name: str = "number", start: int = 1) -> DataFrame:
    """A gapless number in the given order: range partitions, a count of each, and an offset; no task sees all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    at = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(at), "_p").withColumn(name, F.col("_at") + F.col("_i") + start).drop("_p", "_i", "_at")


def aliases(df: DataFrame, role: str, label: str, order: str) -> DataFrame:
    """Stable names ROLE-LABEL-nn by rank in (role, label)."""
    rank = (F.col("_rank") + 1).cast("string")
    number = F.when(F.length(rank) < 2, F.concat(F.lit("0"), rank)).otherwise(rank)
    out = running(df, [role, label], [order], _rank=F.lit(1))
    return out.withColumn("alias", F.concat_ws("-", F.upper(role), F.upper(label), number)).drop("_rank")


def keyword_context(text: Column, keyword: str) -> Column:
    """Absent, isolated, prefix, middle, suffix or repeated, from non-overlapping matches left to right."""
    parts = F.split(text, f"\\Q{keyword}\\E", -1)
    n = F.size(parts) - 1
    return F.when(n <= 0, "absent").when(n > 1, "repeated").when(text == keyword, "isolated").when(parts[0] == "", "prefix").when(parts[1] == "", "suffix").otherwise("middle")


def keyword_offsets(text: Column, keyword: str) -> Column:
    """Offsets of the non-overlapping matches, left to right: the lengths of the parts between them, summed up by chunks."""
    parts = F.transform(F.split(text, f"\\Q{keyword}\\E", -1), lambda p: F.char_length(p) + len(keyword))
    return F.transform(prefix_sums(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), lambda x: (x - len(keyword)).cast("int"))


def latin_order(sources: DataFrame, prompts: DataFrame, source: str, prompt: str) -> DataFrame:
    """Every source with every prompt; in turn t, source i gets prompt (i + t) mod n. Both are small dimensions."""
    number = lambda df, c, n: df.select(c, (F.row_number().over(W.orderBy(c)) - 1).cast("long").alias(n))
    grid = number(sources, source, "_i").crossJoin(sized(number(prompts, prompt, "_j")))
    size = prompts.select(F.count_distinct(prompt).alias("_n"))
    return grid.crossJoin(F.broadcast(size)).withColumn("turn", F.pmod(F.col("_j") - F.col("_i"), F.col("_n"))).drop("_i", "_j", "_n")


def hash_order(domain: str, value: Column) -> Column:
    """Sort key: SHA-256 of domain and value."""
    return F.sha2(F.concat(F.lit(domain), value.cast("string")), 256)


def rolling_hash(text: Column) -> Column:
    """Base-131 hash modulo 2**32 over code points."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 131 + c, F.lit(1 << 32)))


def stream_layout(df: DataFrame, case: list[str], order: list, length: str, gap: int, grace: int, lead: int = 0) -> DataFrame:
    """Clips of a case one after another with fixed gaps, the first after `lead`: start, end and grace_end."""
    out = running(df, case, order, start=F.col(length).cast("long") + gap).withColumn("start", F.col("start") + lead)
    return out.withColumn("end", F.col("start") + F.col(length)).withColumn("grace_end", F.col("end") + grace)


def mixed_layout(df: DataFrame, case: str, kind: str, name: str, order: str, length: str, gap: int, grace: int, lead: int = 0) -> DataFrame:
    """Layouts of a case with ordinary (kind 0) and wanted (kind 1) clips, each sorted by name: "mixed" takes an ordinary and a wanted one in turn
    while there are any, "reverse" is that backwards, "ordinary_only" leaves the wanted ones out."""
    if order not in ("mixed", "reverse", "ordinary_only"):
        raise ValueError(order)
    rows = running(df.where(F.col(kind) == 0) if order == "ordinary_only" else df, [case, kind], [name], _turn=F.lit(1))
    by = [F.desc("_turn"), F.desc(kind)] if order == "reverse" else ["_turn", kind]
    return stream_layout(rows, [case], by, length, gap, grace, lead).drop("_turn")


def argmax_runs(frames: DataFrame, key: list[str], frame: str, scores: str, hop: int, width: int) -> DataFrame:
    """Runs of the best token of each frame (ties: the first index), with frame range and sample support."""
    best = F.array_position(F.col(scores), F.array_max(scores)) - 1
    out = running(runs(frames, key, frame, best), key, ["first"], run=F.lit(1)).withColumn("run", F.col("run") + 1)
    return out.withColumnRenamed("value", "token").withColumn("from_sample", F.col("first") * hop).withColumn("to_sample", F.col("last") * hop + width)


#: Hops of a block of a recording, in which stacks are made.
BLOCK = 4_096


def trailing_stack(hops: DataFrame, key: str, clock: str, vector: str, size: int, hop: int, block: int = BLOCK) -> DataFrame:
    """The vectors of hops [i - size + 1, i], only where all of them are there without a gap.

    A stack spans (size - 1) * hop, so each block of the clock has what it needs in its own hops and the last size - 1 of the block before,
    which go to both: windows are by key and block, and a recording may hold any share of the rows.
    """
    back, length = (size - 1) * hop, max(block, size) * hop
    own = F.floor(F.col(clock) / length)
    late = F.pmod(F.col(clock), F.lit(length)) >= length - back
    rows = hops.withColumn("_own", own).withColumn("_block", F.explode(F.when(late, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = W.partitionBy(key, "_block").orderBy(clock).rowsBetween(1 - size, 0)
    out = rows.withColumn("stack", F.collect_list(vector).over(w)).withColumn("_first", F.min(clock).over(w))
    whole = (F.size("stack") == size) & (F.col(clock) - F.col("_first") == back)
    return out.where(whole & (F.col("_own") == F.col("_block"))).drop("_first", "_own", "_block")


def shards(df: DataFrame, number: str, size: int, start: int = 1) -> DataFrame:
    """Shard of each row of a numbered plan."""
    return df.withColumn("shard", F.floor((F.col(number) - start) / size).cast("long"))
