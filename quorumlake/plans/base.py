"""Tables that the registered queries derive from the driver tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYWORDS = ["the", "que"]

#: The target of the phonetic queries.
TARGET = "orre"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")))


def without_last(text: Column) -> Column:
    """Words but the last."""
    return F.regexp_replace(text, " ?[a-z]+$", "")


def without_first(text: Column) -> Column:
    return F.regexp_replace(text, "^[a-z]+ ?", "")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents, in letters; `utt` names the document and the place of the sentence."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "[.\n]")).alias("i", "s"))
    # A filter on the letters would be pushed below them, and they would be made twice.
    return rows.where(F.col("s").rlike("[A-Za-z]")).select(F.concat_ws(":", "doc_id", "i").alias("utt"), "doc_id", "lang", letters(F.col("s")).alias("spoken"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips: the letters of the whole text, in lower case with single spaces, stand for the spoken text."""
    t = letters(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), "lang", F.col("source").alias("family"), F.sha2("text", 256).alias("pcm_sha256"), t.alias("spoken"), F.col("n_chars").alias("frames"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three observers for each clip, by a formula with ties, lost first or last words and failures."""
    rows = clips(spark, sf_dir).withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(3)])))
    k = (F.col("clip_id") * 31 + F.col("model") * 17) % 7
    text = F.when(k == 0, without_last(F.col("spoken"))).when(k == 1, without_first(F.col("spoken"))).otherwise(F.col("spoken"))
    return rows.withColumn("norm_text", text).withColumn("usable", (F.col("clip_id") * 13 + F.col("model") * 5) % 23 != 0)


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as score hops: a clock of 1,280 samples for each user, a class and its probability."""
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") * 1280
    label = F.when(F.col("event_type") == "view", 0).when(F.col("event_type").isin("click", "purchase"), 1).otherwise(2)
    p = F.lit(0.5) + (F.col("event_id") % 50) / 100.0
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), at.alias("sample"), label.alias("best"), p.alias("p"), "event_id", "value")


def with_vectors(h: DataFrame) -> DataFrame:
    rest = (1 - F.col("p")) / 2
    return h.withColumn("probabilities", F.array(*[F.when(F.col("best") == i, F.col("p")).otherwise(rest) for i in range(3)]))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as half-open intervals on their supplier, in days."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("parent"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), "l_orderkey", "l_linenumber")


def lexicon(spark: SparkSession) -> DataFrame:
    """Readings of letters by a rule: two neighbours share a syllable, every fifth letter has a second reading, q and x have none."""
    reading = lambda code, tone: F.concat(F.chr((F.lit(97) + F.expr(f"({code}) div 2 * 2")).cast("int")), F.expr(f"cast({tone} as string)"))
    one, two = reading("id", "id % 4"), reading("(id + 7) % 26", "id % 3")
    rows = spark.range(26).select(F.chr((F.col("id") + 97).cast("int")).alias("token"), F.when(F.col("id") % 5 == 0, F.array(one, two)).otherwise(F.array(one)).alias("readings"))
    return rows.where("token not in ('q', 'x')")


def evidence_sql(rows: str, keys: str, n: int = len(TARGET)) -> str:
    """Common table expressions that end in `evidence`, with every window of every text tried; rows: a query for keys and text."""
    o = f"(PARTITION BY {keys} ORDER BY pos)"
    at = lambda m, j, i: f"coalesce(lead({m}{j}, {i}) OVER o, false)" if i else f"{m}{j}"
    both = lambda terms: "(" + " AND ".join(terms) + ")"
    shorter = " OR ".join(both([at("w", i + (i >= d), i) for i in range(n - 1)]) for d in range(n))
    longer = " OR ".join(both([at("w", i - (i > d), i) for i in range(n + 1) if i != d]) for d in range(n + 1))
    matches = lambda m: " + ".join(f"{at(m, j, j)}::INT" for j in range(n))
    there = lambda k: f"lead(ch, {k - 1}) OVER o IS NOT NULL"
    piece = lambda k: " || ".join(f"lead(byte, {i}) OVER o" if i else "byte" for i in range(k))
    wild = lambda k: " OR ".join(f"coalesce(lead(oov, {i}) OVER o, false)" if i else "oov" for i in range(k))
    lexical = both([f"coalesce(lead(lexical, {i}) OVER o, false)" if i else "lexical" for i in range(n)])
    target = f"(SELECT readings FROM lexicon WHERE token = '{{}}')"
    toned = ", ".join(f"coalesce(list_has_any(readings, {target.format(c)}), false) AS t{j}" for j, c in enumerate(TARGET))
    plain = ", ".join(f"coalesce(list_has_any([x[1] for x in readings], [x[1] for x in {target.format(c)}]), false) AS p{j}" for j, c in enumerate(TARGET))
    near = " + ".join(f"coalesce(NOT contains(s{k}, ' ') AND s{k} <> '{TARGET}' AND levenshtein(s{k}, '{TARGET}') <= 1, false)::INT" for k in (n - 1, n, n + 1))
    return f"""lexicon AS (SELECT chr(97 + i) AS token, CASE WHEN i % 5 = 0 THEN [chr(97 + i // 2 * 2) || i % 4, chr(97 + (i + 7) % 26 // 2 * 2) || i % 3] ELSE [chr(97 + i // 2 * 2) || i % 4] END AS readings FROM (SELECT range::INT AS i FROM range(26)) WHERE chr(97 + i) NOT IN ('q', 'x')),
lex AS (SELECT *, {toned}, {plain} FROM lexicon), texts AS ({rows}),
chars AS (SELECT {keys}, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS pos FROM texts),
read AS (SELECT *, NOT edge AND readings IS NULL AS oov, readings IS NOT NULL AS lexical FROM (SELECT chars.*, lex.* EXCLUDE (token), regexp_matches(ch, '[\\s\\p{{P}}]') AS edge FROM chars LEFT JOIN lex ON ch = token) WHERE ch <> ''),
apart AS (SELECT {keys}, count(*) FILTER (WHERE oov) AS oov, count(*) FILTER (WHERE lexical) AS lexical, count(*) FILTER (WHERE len(readings) > 1) AS ambiguous FROM read GROUP BY {keys}),
joined AS (SELECT {keys}, pos, {", ".join(f"{piece(k)} AS s{k}" for k in (n - 1, n, n + 1))}, {lexical} AS whole, {matches("t")} AS same, {matches("p")} AS alike FROM (SELECT {keys}, pos, CASE WHEN edge THEN ' ' WHEN ascii(ch) > 127 THEN '0' ELSE ch END AS byte, lexical, {", ".join(f"coalesce({m}{j}, false) AS {m}{j}" for m in "tp" for j in range(n))} FROM read) WINDOW o AS {o}),
loose AS (SELECT {keys}, {matches("w")} >= {n - 1} AND {there(n)} AS mid, ({shorter}) AND {there(n - 1)} AS low, ({longer}) AND {there(n + 1)} AS high, {wild(n)} AS w_mid, {wild(n - 1)} AS w_low, {wild(n + 1)} AS w_high FROM (SELECT {keys}, pos, ch, oov, {", ".join(f"coalesce(p{j}, oov) AS w{j}" for j in range(n))} FROM read WHERE NOT edge) WINDOW o AS {o}),
j AS (SELECT {keys}, sum({near})::BIGINT AS near_text, count_if(whole AND (same = {n} OR alike >= {n - 1}))::BIGINT AS dictionary, count_if(whole AND same = {n})::BIGINT AS toned FROM joined GROUP BY {keys}),
l AS (SELECT {keys}, sum(mid::INT + low::INT + high::INT)::BIGINT AS local, sum((mid AND w_mid)::INT + (low AND w_low)::INT + (high AND w_high)::INT)::BIGINT AS local_oov FROM loose GROUP BY {keys}),
k AS (SELECT {keys}, text, contains(text, '{TARGET}') AS literal, NOT contains(text, '{TARGET}') AND contains(regexp_replace(text, '[\\s\\p{{P}}]+', '', 'g'), '{TARGET}') AS boundary_separated, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("near_text", "dictionary", "toned", "local", "local_oov", "oov", "lexical", "ambiguous"))}
FROM texts LEFT JOIN j USING ({keys}) LEFT JOIN l USING ({keys}) LEFT JOIN apart USING ({keys})),
evidence AS (SELECT *, [x for x in [CASE WHEN short THEN 'insufficient_lexical_evidence' END, CASE WHEN near THEN 'confusable_or_partial_target' END] if x IS NOT NULL] AS blockers, CASE WHEN text IS NULL THEN 'unknown' WHEN literal THEN 'positive' WHEN short OR near THEN 'unknown' ELSE 'negative' END AS state
FROM (SELECT *, oov > 0 AND lexical = 0 AS short, near_text > 0 OR dictionary > 0 OR local > 0 OR boundary_separated AS near FROM k))"""


CLIPS = """clips AS (SELECT doc_id AS clip_id, lang, source AS family, sha256(text) AS pcm_sha256, n_chars AS frames,
  trim(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))) AS spoken FROM documents)"""
WITHOUT_LAST = "regexp_replace(spoken, ' ?[a-z]+$', '')"
UTTS = """utts AS (SELECT doc_id || ':' || i AS utt, doc_id, lang, trim(lower(regexp_replace(s, '[^A-Za-z]+', ' ', 'g'))) AS spoken
  FROM (SELECT doc_id, lang, unnest(string_split_regex(text, '[.\n]')) AS s, unnest(range(len(string_split_regex(text, '[.\n]')))) AS i FROM documents)
  WHERE regexp_matches(s, '[A-Za-z]'))"""
OBS = f"""{CLIPS}, obs AS (SELECT c.*, m AS model,
  CASE (clip_id * 31 + m * 17) % 7 WHEN 0 THEN {WITHOUT_LAST} WHEN 1 THEN regexp_replace(spoken, '^[a-z]+ ?', '') ELSE spoken END AS norm_text,
  (clip_id * 13 + m * 5) % 23 <> 0 AS usable FROM clips c, (VALUES (0), (1), (2)) v(m))"""
HOPS = """hops AS (SELECT user_id AS case_id, 1280 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample,
  CASE WHEN event_type = 'view' THEN 0 WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 2 END AS best,
  0.5::DOUBLE + (event_id % 50)::DOUBLE / 100.0::DOUBLE AS p, event_id, value FROM events)"""
SPANS = """spans AS (SELECT l_suppkey AS parent, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS start,
  date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS "end", l_orderkey, l_linenumber FROM lineitem)"""
