"""The queries ``opN_<name>`` over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import debruijn, license_scan, mixing, ngram_jaccard, pstable, secrets, sentencepiece_bpe, simhash, toxicity, warc_zip


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), digests=True)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, num=85, den=100)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.find_licences(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = toxicity.train(toxicity.training_rows(docs, labels))
    scored = toxicity.score(docs, weights, bias)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc_zip.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), warc_zip.archive_folder(spark))
    return warc_zip.read_archives(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_segments")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_sentencepiece, op4_ngram_jaccard, op5_license_scan, op6_toxicity, op7_warc_zip, op8_simhash, op9_embedding_neighbours, op10_substring_repeats)}

_COMPONENTS = """reach(id, other) AS (SELECT DISTINCT id, id FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL = {
    "op1_mix_sources": mixing.oracle_sql(),
    "op4_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = d.doc_id""",
    "op7_warc_zip": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to FROM r""",
    "op9_embedding_neighbours": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS z FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id AND x.z > 0 AND y.z > 0 AND len(x.e) = len(y.e) AND list_inner_product(x.e, y.e) / (x.z * y.z) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
k AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN k ON k.id = v.vec_id""",
    "op10_substring_repeats": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS at FROM r, (SELECT unnest(range(35)) AS j)),
x AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS at FROM w),
k AS (SELECT x.doc_id, count(c.at) AS n_removed, string_agg(ws[x.at], ' ' ORDER BY x.at) FILTER (WHERE c.at IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.at = x.at GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}
