"""Operator 1, line dedup: lines that spread over many sites go, but for one occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, boxed, let, materialise, sized_join, table


def line_rows(docs: DataFrame, text: str, doc_id: str, site: str) -> DataFrame:
    """A row for each line with a word of each distinct text: its hash and length, the text's site and the line's place.

    Of rows with the same text only the least (doc_id, site) counts, so copies of a text lend it no further sites.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.coalesce(F.col(site), F.lit("")).alias("site"), F.col(text).alias("text")).where("text is not null")
    copies = rows.groupBy("body").agg(F.min(F.struct("doc", "site")).alias("one"), F.count("*").alias("n")).where("n > 1").drop("n")
    once = sized_join(rows, materialise(copies), ["body"], "left").where(F.col("one").isNull() | F.struct("doc", "site").eqNullSafe(F.col("one")))
    placed = once.select("doc", "body", "site", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return placed.where(F.col("line").rlike(WORD)).select(F.xxhash64("line").alias("h"), F.octet_length("line").alias("len"), "site", "doc", "body", "i")


def spread_lines(docs: DataFrame, needed: Column, lg_k: int, text: str, doc_id: str, site: str) -> DataFrame:
    """Every occurrence of a line on `needed` distinct sites or more, with `first`: the occurrence that stays.

    The spread is estimated by HyperLogLog sketches, one for each line hash, merged by aggregation; lines whose
    estimate is within five standard errors of the threshold get an exact count of their sites.
    """
    lines = line_rows(docs, text, doc_id, site)
    spread = lines.groupBy("h", "len").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min(F.struct("doc", "body", "i")).alias("first"))
    error = 5 * 1.04 / 2 ** (lg_k / 2)
    candidates = materialise(spread.where(F.col("sites") >= needed * (1 - error)))
    hits = materialise(sized_join(lines, candidates, ["h", "len"], "inner"))
    near = hits.where(F.col("sites") <= needed * (1 + error))
    exact = near.select("h", "len", "site").distinct().groupBy("h", "len").agg(F.count("*").alias("exact"))
    exact = materialise(exact.where(F.col("exact") < needed))
    return sized_join(hits, exact, ["h", "len"], "left_anti")


def line_dedup(docs: DataFrame, min_sites: int = 10, long_sites: int = 3, long_bytes: int = 120, lg_k: int = 12, text: str = "text", doc_id: str = "doc_id", site: str = "source") -> DataFrame:
    """Remove, in every text, the lines found on min_sites distinct sites or more; one occurrence of each stays.

    Lines of long_bytes bytes or more, which don't recur by chance, go from long_sites sites on. Sites are counted over
    distinct texts: a text counts once, at the site of its least (doc_id, site), and all its rows lose the same lines, so
    whole copies stay copies for document dedup. The occurrence that stays is the least (doc_id, hash of the text, index).
    Lines are the pieces between \\n, equal byte for byte (by a 64-bit hash and the length); lines without a word never
    go. Adds n_lines (lines with a word) and n_removed; text holds the remaining lines in order, and n_chars, if there
    is one, their code points. No row goes, even with nothing left. Other columns keep their values whatever their names.
    Nulls: a null text stays null with no lines; a null site counts as the site ""; a null doc_id sorts first.
    A line that holds a third of all rows is combined in each task before the shuffle, and its occurrences are joined
    by broadcast or by a join whose skew AQE splits.
    """
    needed = F.when(F.col("len") >= long_bytes, long_sites).otherwise(min_sites)
    hits = spread_lines(docs, needed, lg_k, text, doc_id, site)
    gone = hits.where(~F.struct("doc", "body", "i").eqNullSafe(F.col("first"))).groupBy("body").agg(F.collect_set("i").alias("gone"))
    out = boxed(docs, body=F.xxhash64(text), text=F.col(text)).join(gone.hint("merge"), "body", "left")
    lines = F.split("text", "\n")
    rest = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    worded = F.greatest(F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(WORD))), F.lit(0)), F.lit(0)).cast("long")
    out = out.select("row", worded.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"))
    changed = {text: F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    kept = [changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*kept, "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH texts AS (
  SELECT text, min(doc_id) AS d, arg_min(coalesce(source, ''), doc_id) AS s FROM documents WHERE text IS NOT NULL GROUP BY text
), lines AS (
  SELECT text, d, s, i - 1 AS i, string_split(text, chr(10))[i] AS line
  FROM texts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS t(i)
), worded AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM lines
), spread AS (
  SELECT line, min({'d': d, 'i': i}) AS first FROM worded WHERE worded GROUP BY line
  HAVING count(DISTINCT s) >= CASE WHEN strlen(line) >= 120 THEN 3 ELSE 10 END
), marked AS (
  SELECT w.*, coalesce(w.worded AND s.line IS NOT NULL AND NOT (s.first.d = w.d AND s.first.i = w.i), false) AS gone
  FROM worded w LEFT JOIN spread s ON w.line = s.line
), rest AS (
  SELECT text AS was, sum(worded::INT) AS n_lines, sum(gone::INT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY text
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, rest.text AS text
FROM documents LEFT JOIN rest ON documents.text = rest.was
"""
