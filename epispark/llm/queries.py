"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm import quality, toxicity
from epispark.llm.archives import archived
from epispark.llm.common import fold, table
from epispark.llm.embeddings import vector_links
from epispark.llm.decontamination import leaks
from epispark.llm.negatives import hard_negatives
from epispark.llm.packing import packed
from epispark.llm.pages import main_text
from epispark.llm.passages import repeated_passages
from epispark.llm.secrets import BASE, listed, with_secrets
from epispark.llm.simhash import hex16, near_duplicates
from epispark.llm.spelling import spelling_variants
from epispark.llm.urls import url_verdicts


def judged(scored: DataFrame, module) -> DataFrame:
    held = F.coalesce(fold("doc_id", module.PARTS) == module.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")), toxicity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")), quality)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    count = [F.size(F.filter(F.col("secrets.kind"), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in [r.kind for r in BASE]]
    return found.select("doc_id", *count, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_secrets": op9_secrets,
    "op10_embedding_links": op10_embedding_links,
    "op11_warc": op11_warc,
    "op12_spelling": op12_spelling,
    "op13_negatives": op13_negatives,
}

#: runs of windows of 50 words that stand in another document too, and a document that holds one of them
PASSAGES = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS k, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' ')))) AS h FROM w WHERE len(w) >= 50),
r AS (SELECT h, min(doc_id) AS a, max(doc_id) AS b FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT doc_id, k, min(CASE WHEN a <> doc_id THEN a ELSE b END) AS other FROM h JOIN r USING (h) GROUP BY doc_id, k),
g AS (SELECT doc_id, k, other, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS isle FROM f)
SELECT doc_id, CAST(min(k) AS INTEGER) AS start_word, CAST(max(k) + 50 AS INTEGER) AS end_word, CAST(max(k) + 50 - min(k) AS INTEGER) AS n_words, min(other) AS other_doc_id FROM g GROUP BY doc_id, isle
"""

#: all pairs of vectors, and what is reachable by them
LINKS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.y FROM r JOIN p ON p.x = r.c),
n AS (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

#: sizes and digests of payloads, and the largest page of equal ones; base32 from five hexadecimal digits at a time
ARCHIVED = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, page_id IS NOT DISTINCT FROM max(page_id) OVER (PARTITION BY h) AS first, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first THEN NULL ELSE top END AS refers_to FROM t
"""

#: scores of all anchors and rows, the best of the same label, and the best of others below these
NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op8_repeated_passages": PASSAGES, "op10_embedding_links": LINKS, "op11_warc": ARCHIVED, "op13_negatives": NEGATIVES}
