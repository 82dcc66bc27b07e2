"""Registered queries of the file readers and writers, on files written from the given tables, and of the text policies."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import phonetic as PH
from quorumlake.functions import text as T
from quorumlake.operators import consensus as C
from quorumlake.operators import joins as J
from quorumlake.operators import metrics as M
from quorumlake.operators.lineage import shared_folder
from quorumlake.sources import readers as S
from quorumlake.sources import writers as O

from .base import CLIPS, HOPS, TARGET, UTTS, clips, evidence_sql, hops, lexicon, table, utterances, with_vectors
from .queries import query


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- files ----------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last FROM events GROUP BY event_type")
def io1_json_rows(spark, d):
    path = fresh(spark, "rows")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    rows = S.read_rows(spark, path, "event_id long, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last"))


@query("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def io2_document_rows(spark, d):
    """Documents of ten conversations each, one file a document."""
    path = fresh(spark, "documents")
    c = table(spark, d, "conversations").select(F.expr("conv_id div 10").alias("part"), F.struct("conv_id", "turn", "role", "text").alias("r"))
    c.groupBy("part").agg(F.to_json(F.struct(F.collect_list("r").alias("rows"))).alias("value")).write.partitionBy("part").text(path)
    rows = S.read_document_rows(spark, path, "rows", "conv_id: long, turn: long, role: string, text: string")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_distinct("role").alias("roles"))


@query(f"""WITH {CLIPS}, r AS (SELECT CASE WHEN clip_id % 50 = 1 THEN clip_id - 1 ELSE clip_id END AS key, spoken FROM clips), n AS (SELECT key, count(*) AS n FROM r GROUP BY key)
SELECT CASE WHEN spoken = '' THEN 'empty_text' WHEN n > 1 THEN 'duplicate_key' ELSE 'good' END AS fault, count(*) AS n, sum(length(spoken))::BIGINT AS chars FROM r JOIN n USING (key) GROUP BY 1""")
def io3_transcripts(spark, d):
    path = fresh(spark, "transcripts")
    key = F.when(F.col("clip_id") % 50 == 1, F.col("clip_id") - 1).otherwise(F.col("clip_id"))
    clips(spark, d).select(F.concat_ws("\t", key.cast("string"), "spoken").alias("value")).write.text(path)
    rows = S.read_transcripts(spark, path)
    return rows.groupBy(F.coalesce("fault", F.lit("good")).alias("fault")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {UTTS}, w AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(string_split(s, ' ')) AS w, unnest(range(len(string_split(s, ' ')))) AS i FROM (SELECT doc_id, string_agg(spoken, ' ' ORDER BY split_part(utt, ':', 2)::INT) AS s FROM utts GROUP BY doc_id)))
SELECT doc_id::VARCHAR AS key, string_agg(w, '' ORDER BY i) AS text FROM w WHERE i % 2 = 0 GROUP BY doc_id""")
def io3_transcript_pairs(spark, d):
    """Characters and readings by turns: here words, of which every second one is the reading."""
    path = fresh(spark, "pairs")
    clips(spark, d).where("spoken <> ''").select(F.concat_ws("\t", F.col("clip_id").cast("string"), "spoken").alias("value")).write.text(path)
    return S.read_transcripts(spark, path, "pairs").select("key", "text")


def _recordings(spark, d) -> DataFrame:
    """A WAV file for each embedding; every seventh has no samples, every eleventh is cut short."""

    @F.pandas_udf("binary")
    def pack(ids: pd.Series, xs: pd.Series) -> pd.Series:
        whole = [S.wav_bytes([] if i % 7 == 0 else [round(float(v) * 20_000) for v in x]) for i, x in zip(ids, xs)]
        return pd.Series([b[:-3] if i % 11 == 0 else b for i, b in zip(ids, whole)])

    return table(spark, d, "embeddings").select(F.concat(F.lit("clip/"), "vec_id").alias("path"), pack("vec_id", "embedding").alias("content"))


@query("""WITH f AS (SELECT 'clip/' || vec_id AS path, CASE WHEN vec_id % 11 = 0 THEN 'unreadable' WHEN vec_id % 7 = 0 THEN 'empty' END AS fault, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE len(embedding) END AS n, CASE WHEN vec_id % 11 = 0 THEN 3 ELSE 0 END AS lost FROM embeddings)
SELECT path, (44 + 2 * n - lost)::BIGINT AS bytes, CASE WHEN fault = 'unreadable' THEN NULL ELSE n END::BIGINT AS frames, CASE WHEN fault = 'unreadable' THEN NULL ELSE 16000 END AS rate, CASE WHEN fault = 'unreadable' THEN NULL ELSE 'pcm' END AS encoding, fault FROM f""")
def io4_wav_table(spark, d):
    got = S.wav_table(_recordings(spark, d))
    return got.select("path", "bytes", "frames", "rate", "encoding", F.split("fault", ":")[0].alias("fault"))


@query("SELECT vec_id % 11 = 0 AS cut, count(*) AS n, count(*) AS file_digests FROM embeddings GROUP BY 1")
def io5_recording_digests(spark, d):
    """Digests of files and of samples: equal samples have one digest, a cut file has none."""
    got = S.wav_table(_recordings(spark, d)).withColumn("cut", F.col("pcm_sha256").isNull())
    return got.groupBy("cut").agg(F.count("*").alias("n"), F.count("file_sha256").alias("file_digests"))


@query(f"""WITH {HOPS}, n AS (SELECT case_id, count(*) AS n FROM hops GROUP BY case_id), r AS (SELECT case_id, p, row_number() OVER (PARTITION BY case_id ORDER BY sample) AS k FROM hops)
SELECT 'case/' || case_id AS path, any_value(n) AS windows, greatest(any_value(n) - 15, 0) AS ready, 16000 + 1280 * (any_value(n) - 1) AS last_sample, round(max(p) FILTER (WHERE k > 15), 5) AS peak FROM r JOIN n USING (case_id) GROUP BY case_id""")
def io7_trace_rows(spark, d):
    """A binary trace for each case, read back as hop rows."""
    got = S.trace_table(_traces(spark, d))
    peak = F.max(F.when(F.col("ready"), F.array_max("probabilities")))
    return got.groupBy("path").agg(F.count("*").alias("windows"), F.count_if("ready").alias("ready"), F.max("sample").alias("last_sample"), F.round(peak, 5).alias("peak"))


def _traces(spark, d) -> DataFrame:
    rows = with_vectors(hops(spark, d)).groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "probabilities"))), lambda x: x["probabilities"]).alias("probabilities"))
    return S.trace_files(rows.select(F.concat(F.lit("case/"), "case_id").alias("path"), "probabilities"))


@query(f"""WITH {HOPS}, n AS (SELECT case_id, count(*) AS n FROM hops GROUP BY case_id), r AS (SELECT case_id, p, row_number() OVER (PARTITION BY case_id ORDER BY sample) AS k FROM hops)
SELECT 'case/' || case_id AS path, 14720 + 1280 * k AS sample, k > 15 AS ready, CASE WHEN case_id % 7 <> 0 THEN round(CASE WHEN k > 15 THEN p ELSE 0 END, 5) END AS peak, CASE WHEN case_id % 7 = 0 THEN 'truncated' END AS fault FROM r WHERE case_id % 7 <> 0
UNION ALL SELECT 'case/' || case_id, NULL, NULL, NULL, 'truncated' FROM n WHERE case_id % 7 = 0""")
def io7_lateral_trace(spark, d):
    """The table function over traces, some of them cut, in SQL."""
    S.register_trace_hops(spark)
    cut = F.when(F.split("path", "/")[1].cast("int") % 7 == 0, F.expr("substr(content, 1, length(content) - 1)")).otherwise(F.col("content"))
    files = _traces(spark, d).withColumn("content", cut)
    return spark.sql("SELECT f.path, h.sample, h.ready, round(array_max(h.probabilities), 5) AS peak, h.fault FROM {files} f, LATERAL trace_hops(f.content) h", files=files)


@query(f"WITH {CLIPS} SELECT sum(strlen(spoken) + 1)::BIGINT AS bytes, 64::BIGINT AS digest_length FROM clips")
def io10_manifest(spark, d):
    path = fresh(spark, "export")
    clips(spark, d).select("lang", F.col("spoken").alias("value")).write.partitionBy("lang").text(path)
    return O.manifest_summary(O.manifest(spark, path)).select("bytes", F.length("digest").cast("long").alias("digest_length"))


@query(f"WITH {HOPS} SELECT case_id, count(*) AS hops, max(sample) AS last_sample, round(sum(p), 4) AS total FROM hops GROUP BY case_id")
def io12_flat_trace(spark, d):
    path, h = fresh(spark, "trace"), hops(spark, d).select("case_id", "sample", "p")
    O.write_flat_trace(h, h.select("case_id").distinct(), h.groupBy("case_id").count(), path)
    got = S.read_rows(spark, f"{path}/hops", "case_id long, sample long, p double")
    return got.groupBy("case_id").agg(F.count("*").alias("hops"), F.max("sample").alias("last_sample"), F.round(F.sum("p"), 4).alias("total"))


# --- text policies, on whole texts with an ending that holds what Unicode forms change --------------------------------

#: A ligature, full-width letters, an ideographic space, two Han characters with a space between, a curly apostrophe.
ENDING = " ﬁ Ａ１　今 天’s"
_FOLD = "replace(lower(text), 'ß', 'ss')"
_SPACED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_QUOTED = f"replace(regexp_replace(replace(replace({_FOLD}, '’', ''''), '''', chr(1)), '\\p{{P}}', ' ', 'g'), chr(1), '''')"


def _forms(spark, d, form) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat("text", F.lit(ENDING)).alias("text"))
    return docs.select("doc_id", F.md5(form(docs)).alias("norm"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\s\\p{P}]', '', 'g') || 'fiA1今天s') AS norm FROM documents")
def t1a_compact(spark, d):
    return _forms(spark, d, lambda r: T.norm_compact(r.text))


@query(f"SELECT doc_id, md5(trim({_SPACED.format(_QUOTED)} || ' fi a1 今天''s')) AS norm FROM documents")
def t1b_reference(spark, d):
    return _forms(spark, d, lambda r: T.norm_reference(r.text))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '今天' ELSE trim(array_to_string(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)*'), ' ') || ' fi a s') END) AS norm FROM documents""")
def t1c_by_language(spark, d):
    return _forms(spark, d, lambda r: T.norm_by_language(r.text, F.when(F.col("doc_id") % 2 == 0, "zh").otherwise("en")))


@query(f"""SELECT doc_id, md5(CASE WHEN lang <> 'en' THEN {_SPACED.format(_QUOTED)} WHEN regexp_full_match({_SPACED.format('lower(text)')}, '[\\x20-\\x7E]*') THEN {_SPACED.format('lower(text)')} END) AS norm FROM documents""")
def t1d_request(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.norm_request(docs.text, docs.lang)).alias("norm"))


@query(f"SELECT doc_id, md5(trim({_SPACED.format('nfc_normalize(text)')} || ' é')) AS norm FROM documents")
def t1e_spaces(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.norm_spaces(F.concat(docs.text, F.lit("  é ")))).alias("norm"))


@query(f"SELECT doc_id, md5(trim(trim(regexp_replace({_FOLD}, '[\\s\\p{{P}}]+', ' ', 'g')) || ' fi a1 今 天 s')) AS norm FROM documents")
def t1f_folded(spark, d):
    return _forms(spark, d, lambda r: T.norm_folded(r.text))


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS latin, len(regexp_extract_all(regexp_replace(lower(text), '[''’]', '', 'g'), '[a-z0-9]+')) + 2 AS alnum FROM documents""")
def t1g_words(spark, d):
    """The ending adds a word of plain letters and digits and, once its apostrophe is gone, an s."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.latin_words(docs.text)).cast("long").alias("latin"), F.size(T.alnum_words(F.concat("text", F.lit(" 今a1’天 's")))).cast("long").alias("alnum"))


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[\\s\\p{P}\\p{S}]', '', 'g') || 'fia1今天s') AS norm FROM documents")
def t1h_typography(spark, d):
    return _forms(spark, d, lambda r: T.norm_typography(r.text))


# --- phonetic candidates, first reasons, nested counts, paired runs -----------------------------------------------------

_SPANS = """{utts}, w AS (SELECT utt, pos, {code} AS r FROM (SELECT utt, unnest(string_split(spoken, ' ')) AS t, unnest(range(len(string_split(spoken, ' ')))) AS pos FROM utts)),
s AS (SELECT utt, pos, r AS x, lead(r, 1) OVER o AS y, lead(r, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY utt ORDER BY pos))
SELECT utt, pos::INT AS "from", 1 AS size, 1 AS distance FROM s WHERE x IN ('{a}', '{b}')
UNION ALL SELECT utt, pos::INT, 2, CASE WHEN x = '{a}' AND y = '{b}' THEN 0 ELSE 1 END FROM s WHERE y IS NOT NULL AND (x = '{a}' OR y = '{b}')
UNION ALL SELECT utt, pos::INT, 3, 1 FROM s WHERE z IS NOT NULL AND ((x = '{a}' AND (y = '{b}' OR z = '{b}')) OR (y = '{a}' AND z = '{b}'))"""


def _tokens(spark, d) -> DataFrame:
    """Words with one reading each: two letters and, as the tone, the length modulo four."""
    said = F.split("spoken", " ")
    words = utterances(spark, d).select("utt", F.size(said).alias("of"), F.posexplode(said).alias("pos", "token"))
    return words.withColumn("readings", F.array(F.concat(F.substring("token", 1, 2), (F.length("token") % 4).cast("string"))))


@query("WITH " + _SPANS.format(utts=UTTS, code="substr(t, 1, 2) || (length(t) % 4)", a="th3", b="an3"))
def t10_phonetic_spans(spark, d):
    return PH.phonetic_spans(_tokens(spark, d), "utt", [["th3"], ["an3"]])


@query("WITH " + _SPANS.format(utts=UTTS, code="substr(t, 1, 2)", a="th", b="an"))
def t11_toneless_spans(spark, d):
    return PH.phonetic_spans(_tokens(spark, d), "utt", [["th3"], ["an3"]], tones=False)


@query(f"""WITH {evidence_sql("SELECT doc_id, lower(text) AS text FROM documents", "doc_id")} SELECT doc_id, literal, boundary_separated, near_text, dictionary, toned, local, local_oov, oov, lexical, ambiguous, array_to_string(blockers, ',') AS blockers, state FROM evidence""")
def t10_target_evidence(spark, d):
    """Letters as tokens with one or two readings; q, x, digits and accented letters are out of vocabulary."""
    got = PH.target_evidence(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")), lexicon(spark), ["doc_id"], "text", TARGET)
    return got.withColumn("blockers", F.array_join("blockers", ","))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN lang = 'es' THEN 'language' WHEN source = 'src3' THEN 'source' ELSE 'fine' END AS reason FROM documents")
def t17_first_reason(spark, d):
    rules = [(F.col("n_chars") < 200, "short"), (F.col("lang") == "es", "language"), (F.col("source") == "src3", "source")]
    return table(spark, d, "documents").select("doc_id", C.first_reason(rules, "fine").alias("reason"))


@query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def a28_nested_histogram(spark, d):
    got = M.nested_histogram(table(spark, d, "documents"), ["source"], "lang")
    return got.select("source", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query(f"""WITH {HOPS} SELECT case_id, sample, CASE WHEN event_id % 29 = 0 THEN 'only_old' WHEN event_id % 31 = 0 THEN 'geometry' END AS fault, CASE WHEN event_id % 29 <> 0 AND event_id % 31 <> 0 THEN round(p / 2 - p, 6) END AS change FROM hops
UNION ALL SELECT case_id, -sample, 'only_new', NULL FROM hops WHERE event_id % 29 = 0""")
def j10_paired_geometry(spark, d):
    h = hops(spark, d).select("case_id", "sample", "best", "p", "event_id")
    gone = F.col("event_id") % 29 == 0
    new = h.select("case_id", F.when(gone, -F.col("sample")).otherwise(F.col("sample")).alias("sample"), F.when(F.col("event_id") % 31 == 0, F.col("best") + 1).otherwise(F.col("best")).alias("best"), (F.col("p") / 2).alias("p"))
    got = J.paired_geometry(h.drop("event_id"), new, ["case_id", "sample"], ["best"])
    return got.select("case_id", "sample", "fault", F.round(F.col("new_p") - F.col("old_p"), 6).alias("change"))
