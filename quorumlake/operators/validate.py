"""Checks of rows and tables. A check returns the failing rows (or every row with its reasons); `require_empty` makes it strict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .scan import carried, in_range, passed_on, ranges


class ConstraintError(ValueError):
    """A table breaks a constraint."""


def require_empty(bad: DataFrame, what: str) -> None:
    """Fail closed: raise, with up to five examples, if there is any row."""
    if rows := bad.limit(5).collect():
        raise ConstraintError(f"{what}: {[r.asDict(recursive=True) for r in rows]}")


def rule_reasons(df: DataFrame, rules: list[tuple[Column, str]], name: str = "reasons") -> DataFrame:
    """V1: add the codes of all rules that a row fails. A rule that is null fails. V14: claim flags are rules like others."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in rules])))


def stay_false(flags: list[str]) -> list[tuple[Column, str]]:
    """Rules that claim flags are false in every row."""
    return [(~F.col(f), f"claims_{f}") for f in flags]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """V2: keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def roster_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """V3: keys that only one of two tables has, with `side`."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    out = a.join(b, keys, "full").where(F.col("_l").isNull() | F.col("_r").isNull())
    return out.withColumn("side", F.when(F.col("_r").isNull(), "left").otherwise("right")).drop("_l", "_r")


def disagreements(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """V4: joined keys whose fields differ (null equals null), with the names of those fields."""
    both = left.select(*keys, *[F.col(f).alias(f"_l_{f}") for f in fields]).join(right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields]), keys)
    names = F.array_compact(F.array(*[F.when(~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")), F.lit(f)) for f in fields]))
    return both.select(*keys, names.alias("fields")).where(F.size("fields") > 0)


def broken_dependency(df: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """V5: keys with more than one tuple of attributes (null counts as a value)."""
    tuples = df.select(*key, F.struct(*attributes).alias("_t")).distinct()
    return tuples.groupBy(*key).agg(F.count("*").alias("tuples")).where("tuples > 1")


def orphans(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """V6: rows whose key the reference table lacks."""
    return df.join(reference.select(*keys).distinct(), keys, "left_anti")


def incomplete_groups(df: DataFrame, group: str, cell: str, expected: list) -> DataFrame:
    """V7: groups that do not hold exactly the expected cells, with what is missing and what is extra."""
    want = F.array(*[F.lit(x) for x in sorted(expected)])
    has = df.groupBy(group).agg(F.sort_array(F.collect_set(F.when(F.col(cell).isin(*expected), F.col(cell)))).alias("_has"), F.count_if(~F.col(cell).isin(*expected) | F.col(cell).isNull()).alias("extra"), F.count("*").alias("rows"), F.count_distinct(cell).alias("cells"))
    return has.withColumn("missing", F.array_except(want, F.col("_has"))).drop("_has").where((F.size("missing") > 0) | (F.col("extra") > 0) | (F.col("rows") != F.col("cells")))


def clock_faults(df: DataFrame, key: str, sample: str, hop: int, first: int) -> DataFrame:
    """V8: places where a key's clock is not first, first + hop, ...: start, repeat, gap or order (in seq order, if there is a `seq`).

    A range of a key's rows starts with the last clock of the range before.
    """
    order = ["seq" if "seq" in df.columns else sample]
    rows = cut_lineage(ranges(df, [key], order))
    ends = rows.groupBy(key, "_range").agg(F.max_by(sample, order[0]).alias("_end"))
    rows = carried(rows, passed_on(ends, [key], _before=F.lag("_end").over(W.partitionBy(key).orderBy("_range"))), [key])
    step = F.col(sample) - F.coalesce(F.lag(sample).over(in_range([key], order)), F.col("_before"))
    fault = F.when(step.isNull() & (F.col(sample) != first), "start").when(step == 0, "repeat").when(step < 0, "order").when(step != hop, "gap")
    return rows.withColumn("fault", fault).where(F.col("fault").isNotNull()).drop("_range", "_before")


def not_probabilities(df: DataFrame, column: str, size: int = 3, tolerance: float = 1e-5) -> DataFrame:
    """V9: rows whose vector has another size, a null, a value outside 0..1 or not finite, or a sum off 1."""
    p = F.col(column)
    good = (F.size(p) == size) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return df.where(~F.coalesce(good & (F.abs(total - 1) <= tolerance), F.lit(False)))


def excluded(df: DataFrame, denied: DataFrame, keys: list[str]) -> DataFrame:
    """Rows named in the denylist (kind, value) by any of the key columns, with the kinds that hit."""
    deny = denied.select(F.col("kind").alias("_k"), F.col("value").alias("_v")).distinct()
    marks = [df.join(deny.where(F.col("_k") == k).select(F.col("_v").alias(k)), k, "left_semi").withColumn("denied_by", F.lit(k)) for k in keys]
    return reduce(DataFrame.unionByName, marks)


def allowed(df: DataFrame, denied: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no key column denies."""
    for k in keys:
        df = df.join(denied.where(F.col("kind") == k).select(F.col("value").alias(k)).distinct(), k, "left_anti")
    return df


def row_digest(columns: list[str]) -> Column:
    """IO11: digest of a row: SHA-256 of its JSON with sorted names and nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the old version that the new one lacks or holds with other values."""
    cols = sorted(set(old.columns) - set(keys))
    a = old.select(*keys, row_digest(cols).alias("_a"))
    b = new.select(*keys, row_digest(cols).alias("_b"))
    out = a.join(b, keys, "left").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return out.select(*keys, F.when(F.col("_b").isNull(), "removed").otherwise("changed").alias("state"))


def inventory_diff(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Every key with kept, added, removed or changed."""
    both = old.select(*keys, F.col(digest).alias("_a"), F.lit(True).alias("_l")).join(new.select(*keys, F.col(digest).alias("_b"), F.lit(True).alias("_r")), keys, "full")
    state = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "kept").otherwise("changed")
    return both.select(*keys, state.alias("state"))


def covering_prefix(df: DataFrame, number: str, needs: dict[str, tuple[Column, int]], family: str, families: int, first: int, most: int) -> DataFrame:
    """Does the prefix of `first` rows of a numbered plan (from 1) cover all needs, and which is the smallest that does, as one row.

    needs: rows that meet a condition, and how many of them; families: distinct values of `family`. For each need its count in the prefix
    (<name>_in_first) and the number of the row that completes it (<name>_at; null: never); the same for families. `gaps` are the codes
    MISSING_<NAME> and INSUFFICIENT_FAMILIES that the prefix leaves open, OVER_BUDGET if it is longer than `most` or than the plan. `smallest` is the last
    completing row, null where that is beyond `most`. The k-th row of a need, and the k-th smallest first row of a family, come from sorted limits; no
    prefix is tried out.
    """
    inside = F.col(number) <= first
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(c & inside).alias(f"{n}_in_first") for n, (c, _) in needs.items()])
    starts = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.min(number).alias(number))
    counts = counts.crossJoin(F.broadcast(starts.agg(F.count_if(inside).alias("families_in_first"))))
    kth = lambda rows, k, name: rows.select(number).orderBy(number).limit(k).agg(F.when(F.count("*") == k, F.max(number)).alias(name))
    out = counts
    for rows, k, name in [*((df.where(c), k, f"{n}_at") for n, (c, k) in needs.items()), (starts, families, "families_at")]:
        out = out.crossJoin(F.broadcast(kth(rows, k, name)))
    ends = [F.col(f"{n}_at") for n in needs] + [F.col("families_at")]
    whole = reduce(lambda a, b: a & b, [e.isNotNull() for e in ends])
    smallest = F.greatest(*ends)
    gaps = [F.when(F.col(f"{n}_in_first") < k, F.lit(f"MISSING_{n.upper()}")) for n, (_, k) in needs.items()]
    gaps += [F.when(F.col("families_in_first") < families, F.lit("INSUFFICIENT_FAMILIES")), F.when((F.lit(first) > most) | (F.lit(first) > F.col("_rows")), F.lit("OVER_BUDGET"))]
    return out.withColumn("gaps", F.array_sort(F.array_compact(F.array(*gaps)))).withColumn("smallest", F.when(whole & (smallest <= most), smallest)).drop("_rows")
