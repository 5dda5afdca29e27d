"""The queries of this package: thin contracts over its operators, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, infill, langid, negatives, ngram_join, packing, pieces, quality, secrets, substrings, toxicity, urls, warc
from .common import crc_mod4, held_out, read, shared_dir, table, tune


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = ngram_join.join(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    manifest = warc.write_packages(read(spark, sf_dir, "pages"))
    return warc.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS lead_id FROM pages),
groups AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(sha, 5 * i::INT + 1, 5))::BIGINT) AS g FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((g[(k // 4)::INT + 1] >> (15 - 5 * (k % 4))::BIGINT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = lead_id OR lead_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead_id THEN NULL ELSE lead_id END AS refers_to
FROM groups
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    training = [t.filter(~held_out(F.col("doc_id"))) for t in (docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))]
    model = toxicity.train(*training)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pieces.encode_digests(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return fingerprints.with_next(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    counts = table(spark, quality.text_counts(read(spark, sf_dir, "documents")), "counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality.judge(counts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a history of two revisions: those whose crc32(doc_id as text) is even come with the first,
    all of them are in the second, which is scanned against the ledger that the first has left."""
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    early = F.coalesce(crc_mod4(F.col("doc_id")) % 2 == 0, F.lit(False))
    folder = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    secrets.update(docs.filter(early), folder)
    ledger = secrets.update(docs, folder)
    found = secrets.findings(docs.withColumn("since", F.when(early, 1).otherwise(2)), ledger, also=("since",))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "since",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    profiles = langid.learn(docs.filter(~held_out(F.col("doc_id"))))
    guessed = langid.predict(docs, profiles)
    return guessed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return substrings.digests(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS lead_id FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM wins JOIN firsts USING (k) WHERE lead_id < doc_id),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists ON lists.doc_id = d.doc_id
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    vec_id, label = F.col("vec_id"), F.col("label").cast("bigint")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(read(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    model = urls.train(spark.createDataFrame(urls.labelled_urls(), "url string, label int"))
    return urls.judge(read(spark, sf_dir, "pages"), model).select("page_id", "host", "path", "rule", "verdict")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return infill.transform(read(spark, sf_dir, "documents"), digests=True).withColumnRenamed("id", "doc_id")


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS c1, ('0x' || x[9:16])::BIGINT % (n + 1) AS c2,
             ('0x' || x[17:24])::BIGINT % 100 AS d3, ('0x' || x[25:32])::BIGINT % 100 AS d4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR d3 >= 90 THEN 'plain'
                  WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, left(t, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard_join, op2_warc, op3_toxicity, op4_sentencepiece, op5_best_fit_packing, op6_fingerprints, op7_quality_rules, op8_secret_scans, op9_language_id, op10_substring_dedup, op11_hard_negatives, op12_url_filters, op13_fill_in_middle]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op10_substring_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
