"""Operator 3, secret scans: fixed patterns, and candidates judged by how many owners hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise, prefix_sums, table

# The patterns of the contract, in the order of their kinds, and the method's own last.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LOOSE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "loose")

SPAN = "struct<start:bigint,no:int,end:bigint,kind:string,value:string>"


def spans(text: Column, no: int, pattern: str, value, ok) -> Column:
    """Leftmost non-overlapping matches of a pattern as an array of SPAN, in code points; those failing `ok` go."""

    def build(found, parts):
        gaps = F.transform(F.slice(parts, 1, F.size(found)), lambda p: F.char_length(p).cast("long"))
        return let(gaps, lambda g: let(prefix_sums(F.zip_with(g, found, lambda a, m: a + F.char_length(m))), lambda at: F.transform(found, lambda m, i: span(m, F.get(at, i) + F.get(g, i)))))

    def span(m, start):
        return F.struct(start.alias("start"), F.lit(no).alias("no"), (start + F.char_length(m)).alias("end"), F.lit(KINDS[no]).alias("kind"), value(m).alias("value"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(let(found, lambda f: let(F.split(text, pattern, -1), lambda p: build(f, p))), ok)


def joined(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def live_looking(v: Column) -> Column:
    """Letters in both cases with digits, or letters with digits and many distinct characters."""
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return mixed & (F.size(F.array_distinct(F.split(v, ""))) >= 10)


def candidates(docs: DataFrame, text: str, doc_id: str, repo: str, owner: str) -> DataFrame:
    """doc, body, repo, owner, base (spans of the fixed patterns) and loose (other long live-looking runs) for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    low = F.lower(body)
    hint = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    own = lambda m: m
    assign = F.when(hint, spans(body, 0, ASSIGN, lambda m: F.regexp_extract(m, ASSIGN, 2), lambda s: F.char_length(s["value"]) >= 6)).otherwise(none)
    access = F.when(body.contains("AKIA"), spans(body, 1, ACCESS, own, lambda s: s["end"] - s["start"] >= 20)).otherwise(none)
    digits = F.when(body.rlike("[0-9a-f]{24}"), spans(body, 2, HEX, own, lambda s: F.lit(True))).otherwise(none)
    loose = F.when(body.rlike("[A-Za-z0-9+/_=-]{20}"), spans(body, 3, LOOSE, own, lambda s: live_looking(s["value"]))).otherwise(none)
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.sort_array(F.concat(assign, access, digits)).alias("base"), loose.alias("_loose"))
    clear = F.filter("_loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.withColumn("loose", clear).drop("_loose")


def secret_scan(docs: DataFrame, example_owners: int = 3, example_repos: int = 8, text: str = "text", doc_id: str = "doc_id", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Secrets of every document: spans, and for each span how widely its value is owned.

    Candidate values (the assigned value, or the whole run) are hashed and counted over the corpus by distinct
    owners and repositories. A value held by example_owners owners or more, or by example_repos repositories or more of
    at least two owners, is a copied example; many repositories of one owner are that owner's own. Any other value that
    mixes letters and digits is owner-specific and live-looking. Base spans always stay; a loose run that no
    fixed pattern covers becomes a span only if it is live. Returns a row for each row of docs: doc, body (hash
    of the text), n_assign, n_access, n_hex, base (string), spans (string), found (array of spans with verdict,
    owners, repos), n_live, n_example. Other columns of docs are not read.
    Nulls: a null text counts as empty; null owners or repositories are not counted as one. Repeated rows get
    equal results and count once. A value that holds a third of all rows is combined in each task first.
    """
    rows = materialise(candidates(docs, text, doc_id, repo, owner))
    each = rows.where((F.size("base") > 0) | (F.size("loose") > 0)).select("doc", "body", "repo", "owner", F.explode(F.concat("base", "loose")).alias("s")).withColumn("h", F.sha2(F.col("s.value"), 256))
    held = each.groupBy("h", "owner", "repo").agg(F.lit(1).alias("_"))
    by_owner = held.groupBy("h", "owner").agg(F.count("repo").alias("repos"))
    spread = materialise(by_owner.groupBy("h").agg(F.count("owner").alias("owners"), F.sum("repos").alias("repos")))
    small = spread.limit(100_001).count() <= 100_000
    judged = each.join(F.broadcast(spread) if small else spread.hint("merge"), "h")
    copied = (F.col("owners") >= example_owners) | ((F.col("owners") >= 2) & (F.col("repos") >= example_repos))
    verdict = F.when(copied, "example").when(live_looking(F.col("s.value")), "live").otherwise("plain")
    found = F.struct("s.start", "s.no", "s.end", "s.kind", verdict.alias("verdict"), "owners", "repos")
    found = judged.select("doc", "body", found.alias("f")).where((F.col("f.no") < 3) | (F.col("f.verdict") == "live"))
    by_doc = found.groupBy(F.col("doc").alias("_doc"), F.col("body").alias("_body")).agg(F.sort_array(F.collect_set("f")).alias("found"))
    out = rows.join(by_doc.hint("merge"), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body")), "left").drop("_doc", "_body")
    none = F.expr("cast(array() as array<struct<start:bigint,no:int,end:bigint,kind:string,verdict:string,owners:bigint,repos:bigint>>)")
    out = out.withColumn("found", F.coalesce("found", none))
    of = lambda k: F.size(F.filter("base", lambda s: s["no"] == k)).cast("long")
    counts = {"n_assign": of(0), "n_access": of(1), "n_hex": of(2), "base": joined(F.col("base")), "spans": joined(F.col("found"))}
    judged_as = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    sums = {f"n_{v}": judged_as(v) for v in ("live", "example")}
    return out.withColumns(counts | sums).drop("loose", "repo", "owner")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example", F.array_join("found.owners", ",").alias("owners"), F.array_join("found.repos", ",").alias("repos"))
