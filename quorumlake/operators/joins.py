"""Joins of clips, observations, intervals and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .scan import running
from .sizes import sized


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join where each key of the right side names one row; a second one raises when it is read."""
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in right.columns if c not in keys])
    fail = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one row for "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
    one = one.where(fail.cast("boolean")).drop("_n")
    return left.join(one, keys, how)


def covered_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Joined rows; keys of either side without a partner, or with several, come as one row with `fault` instead of null.

    Keys are judged first and only clean ones are joined, so repeated keys never multiply. Null keys have no partner.
    """
    a = left.groupBy(*keys).agg(F.count("*").alias("_l"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_r"))
    state = a.join(b, keys, "full").select(*keys, F.when(F.col("_r").isNull(), "missing_right").when(F.col("_l").isNull(), "missing_left").when((F.col("_l") > 1) | (F.col("_r") > 1), "repeated").alias("fault"))
    clean = state.where("fault is null")
    return left.join(clean.drop("fault"), keys).join(right, keys).unionByName(state.where("fault is not null"), allowMissingColumns=True).withColumn("fault", F.col("fault"))


def by_model(sources: DataFrame, obs: DataFrame, models: list[str], key: str = "clip_id", model: str = "model", text: str = "norm_text") -> DataFrame:
    """Each source with one text column for each model (null where the model gave none)."""
    wide = obs.groupBy(key).agg(*[F.max(F.when(F.col(model) == m, F.col(text))).alias(f"text_{m}") for m in models])
    return sources.join(wide, key, "left")


def paired_geometry(old: DataFrame, new: DataFrame, keys: list[str], geometry: list[str]) -> DataFrame:
    """The rows of two runs side by side, paired only where all of `geometry` agrees; else the fault and nothing else.

    Fault: only_old, only_new, repeated, or geometry; null for a pair, which carries the other columns as old_ and new_.
    """
    side = lambda df, p: df.groupBy(*keys).agg(F.count("*").alias(f"_{p}"), F.min(F.struct(*[F.col(c) for c in df.columns if c not in keys])).alias(p))
    both = side(old, "old").join(side(new, "new"), keys, "full")
    same = F.lit(True)
    for c in geometry:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    fault = F.when(F.col("_new").isNull(), "only_old").when(F.col("_old").isNull(), "only_new").when((F.col("_old") > 1) | (F.col("_new") > 1), "repeated").when(~same, "geometry")
    rest = [F.when(fault.isNull(), F.col(f"{p}.{c}")).alias(f"{p}_{c}") for p, df in (("old", old), ("new", new)) for c in df.columns if c not in (*keys, *geometry)]
    return both.select(*keys, *[F.when(fault.isNull(), F.col(f"old.{c}")).alias(c) for c in geometry], *rest, fault.alias("fault"))


def attach_text(clips: DataFrame, texts: DataFrame, keys: list[str], text: str = "reference_text") -> DataFrame:
    """Publisher text by key; absent text stays null with status `unknown`."""
    out = clips.join(texts.select(*keys, F.col(text), F.lit("known").alias("text_status")), keys, "left")
    return out.withColumn("text_status", F.coalesce("text_status", F.lit("unknown")))


def keep_missing(clips: DataFrame, models: DataFrame, obs: DataFrame, key: str = "clip_id", model: str = "model", status: str = "status") -> DataFrame:
    """One row for each clip and model; no observation gives the outcome `missing`. models is a small dimension."""
    grid = clips.select(key).crossJoin(sized(models.select(model)))
    return grid.join(obs, [key, model], "left").withColumn(status, F.coalesce(status, F.lit("missing")))


def unused(rows: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not consumed."""
    return rows.join(consumed.select(*keys).distinct(), keys, "left_anti")


def in_qualified_groups(rows: DataFrame, group: str, qualifies: Column) -> DataFrame:
    """Rows of groups for which the aggregate condition holds."""
    return rows.join(rows.groupBy(group).agg(qualifies.alias("_q")).where("_q").select(group), group, "left_semi")


def variant_pairs(rows: DataFrame, voice: str, variant: str, contrasts: DataFrame, carry: list[str]) -> DataFrame:
    """The two variants of each contrast (left_variant, right_variant) said by the same voice, side by side."""
    side = lambda p: rows.select(voice, F.col(variant).alias(f"{p}_variant"), *[F.col(c).alias(f"{p}_{c}") for c in carry])
    return side("left").join(sized(contrasts), "left_variant").join(side("right"), [voice, "right_variant"])


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, closed: str = "right", width: int | None = None, how: str = "inner") -> DataFrame:
    """Points inside spans of the same key. closed: right (start < at <= end), left (start <= at < end) or both.

    With `width` both sides also meet on floor(at / width), so that a long key is dealt over many tasks; a span
    then appears once in each cell that it touches.
    """
    a, s, e = F.col(at), F.col(start), F.col(end)
    inside = {"right": (s < a) & (a <= e), "left": (s <= a) & (a < e), "both": (s <= a) & (a <= e)}[closed]
    if width is None:
        p, q = points, spans.withColumnRenamed(key, "_key")
        return p.join(q, (F.col(key) == F.col("_key")) & inside, how).drop("_key")
    p = points.withColumn("_cell", F.floor(a / width).cast("long"))
    q = spans.withColumnRenamed(key, "_key").withColumn("_c", F.explode(F.sequence(F.floor(s / width).cast("long"), F.floor(e / width).cast("long"))))
    return p.join(q.hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_c")) & inside, how).drop("_key", "_cell", "_c")


def contained(inner: DataFrame, outer: DataFrame, key: str, start: str, end: str, outer_start: str, outer_end: str) -> DataFrame:
    """Inner intervals of whole numbers that lie wholly inside an outer one of the same key.

    An outer interval is put into the one or two cells of width 2**level that it touches, 2**level being the least power that is not less than its
    length. An inner one is looked up in the cell of its start at each level of its own length or above that occurs (64 at most). So intervals that are
    far apart, and outer ones that are shorter, never meet, and a long key is dealt over its cells.
    """
    level = lambda a, b: F.when(b - a <= 1, F.lit(0)).otherwise(F.length(F.bin(b - a - 1)))
    o = outer.withColumnRenamed(key, "_key").where(F.col(outer_start) <= F.col(outer_end)).withColumn("_level", level(F.col(outer_start), F.col(outer_end)))
    cell = lambda c: F.expr(f"shiftright(cast({c} as bigint), _level)")
    o = o.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(outer_start), cell(outer_end)))))
    levels = F.broadcast(o.select("_level").distinct())
    i = inner.withColumn("_least", level(F.col(start), F.col(end))).join(levels, F.col("_least") <= F.col("_level")).withColumn("_at", cell(start)).withColumnRenamed("_level", "_own")
    same = (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_level")) & (F.col("_at") == F.col("_cell"))
    return i.join(o.hint("merge"), same & (F.col(outer_start) <= F.col(start)) & (F.col(end) <= F.col(outer_end))).drop("_key", "_level", "_own", "_least", "_at", "_cell")


def hash_number(*parts: Column) -> Column:
    """The first 16 hex digits of a SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def assign_by_hash(rows: DataFrame, pool: DataFrame, key: str, role: str, item: str, salt: str) -> DataFrame:
    """Give every row one item of the pool of its role: number hash(salt, key) modulo the pool's size, in item order."""
    ranked = running(pool.select(role, item), [role], [item], _rank=F.lit(1)).withColumn("_rank", F.col("_rank").cast("decimal(20,0)"))
    sizes = pool.groupBy(role).agg(F.count("*").alias("_size"))
    place = rows.join(sized(sizes), role, "left").withColumn("_rank", F.pmod(hash_number(F.lit(salt), F.col(key).cast("string")), F.col("_size").cast("decimal(20,0)")).cast("decimal(20,0)"))
    return place.join(ranked, [role, "_rank"], "left").drop("_rank", "_size")


def request_grid(axes: list[DataFrame], repetitions: int = 1) -> DataFrame:
    """The cross product of small request axes, repeated; every axis but the first is broadcast if it is small."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(sized(a))
    return out.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))


def lexicon_lookup(rows: DataFrame, lexicon: DataFrame, key: str, tokens: Column) -> DataFrame:
    """A row for each token with its readings (null: out of vocabulary). lexicon: token, readings (array)."""
    long = rows.select(key, F.posexplode(tokens).alias("pos", "token"))
    return long.join(sized(lexicon), "token", "left").withColumn("oov", F.col("readings").isNull())


def attribute_points(events: DataFrame, segments: DataFrame, case: str, clock: str, segment: str, start: str, end: str, grace: int) -> DataFrame:
    """Each event with the one segment with start <= clock < end + grace; null if none; `ambiguous` if there are more.

    A sweep: starts, ends and events of a case in clock order. What an event needs of all that came before is how many segments are open and the sum of
    their numbers, which is the number of the one if it is just one. Sums pass from range to range, so a case may hold any share of the rows.
    """
    s = cut_lineage(segments.where(F.col(case).isNotNull() & (F.col(start) < F.col(end) + grace)).select(F.col(case).alias("_case"), F.col(segment).alias("_segment"), F.col(start).cast("long").alias("_a"), (F.col(end) + grace).cast("long").alias("_b"), F.monotonically_increasing_id().alias("_no")))
    event = F.struct(*events.columns)
    number = F.col("_no").cast("decimal(38,0)")
    marks = s.select("_case", F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(1).alias("one"), number.alias("sum")), F.struct(F.col("_b").alias("at"), F.lit(-1).alias("one"), (-number).cast("decimal(38,0)").alias("sum")))).alias("_m"))
    marks = marks.select("_case", F.col("_m.at").alias("_at"), F.lit(0).alias("_late"), F.col("_m.one").alias("_one"), F.col("_m.sum").alias("_sum"), F.lit(None).cast(events.select(event.alias("e")).schema["e"].dataType).alias("_event"))
    points = events.select(F.col(case).alias("_case"), F.col(clock).cast("long").alias("_at"), F.lit(1).alias("_late"), F.lit(0).alias("_one"), F.lit(0).cast("decimal(38,0)").alias("_sum"), event.alias("_event"))
    told = running(marks.unionByName(points), ["_case"], ["_at", "_late"], _open=F.col("_one"), _which=F.col("_sum")).where("_late = 1")
    told = told.select("_event.*", (F.col("_open") > 1).alias("ambiguous"), F.when(F.col("_open") == 1, F.col("_which")).cast("long").alias("_told"))
    return told.join(s.select(F.col("_no").alias("_told"), F.col("_segment").alias(segment)).hint("merge"), "_told", "left").drop("_told")


def anchor_origin(rows: DataFrame, anchors: list[str], segments: DataFrame, case: str, segment: str, start: str, end: str, grace: int) -> DataFrame:
    """The segment of each of several clocks of a row (<anchor>_segment), all found in one sweep; `same` if all lie in one segment, else `cross`
    (another one, or none); `ambiguous` if one of them lies in several."""
    numbered_rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    long = numbered_rows.select("_row", case, F.posexplode(F.array(*[F.col(a).cast("long") for a in anchors])).alias("_i", "_clock"))
    told = attribute_points(long, segments, case, "_clock", segment, start, end, grace)
    per = told.groupBy("_row").agg(*[F.max(F.when(F.col("_i") == i, F.col(segment))).alias(f"{a}_segment") for i, a in enumerate(anchors)], F.bool_or("ambiguous").alias("ambiguous"))
    first = F.col(f"{anchors[0]}_segment")
    same = first.isNotNull()
    for a in anchors[1:]:
        same = same & first.eqNullSafe(F.col(f"{a}_segment"))
    return numbered_rows.join(per.hint("merge"), "_row").withColumn("same", same).withColumn("cross", ~same).drop("_row")


def import_decisions(windows: DataFrame, decisions: DataFrame, key: str, must_match: list[str]) -> DataFrame:
    """Decisions on mined windows; one whose coordinates or hashes differ is refused with the fields that differ."""
    d = decisions.select(key, F.col("decision"), *[F.col(c).alias(f"_d_{c}") for c in must_match])
    both = windows.join(d, key, "left")
    diff = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_d_{c}")), F.lit(c)) for c in must_match]))
    out = both.withColumn("mismatch", F.when(F.col("decision").isNotNull(), diff).otherwise(F.array().cast("array<string>")))
    state = F.when(F.col("decision").isNull(), "undecided").when(F.size("mismatch") > 0, "refused").otherwise("imported")
    return out.withColumn("state", state).withColumn("decision", F.when(state == "imported", F.col("decision"))).drop(*[f"_d_{c}" for c in must_match])


def align_stream(hops: DataFrame, roster: DataFrame, case: str, offset: str, samples: str, at: str) -> DataFrame:
    """Hops of one concatenated stream, each with its case, its local sample and whether it is the case's first."""
    spans = roster.select(F.col(case), F.col(offset).alias("_from"), (F.col(offset) + F.col(samples)).alias("_to"), F.lit(0).alias("_one"))
    out = range_join(hops.withColumn("_one", F.lit(0)), spans, "_one", at, "_from", "_to", closed="left", width=1_600_000)
    first = out.groupBy(case).agg(F.min(at).alias("_first"))
    return out.join(first, case).withColumn("local_sample", F.col(at) - F.col("_from")).withColumn("gap", F.col(at) == F.col("_first")).drop("_one", "_from", "_to", "_first")
