"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casdelta.llm import ann, bpe, importance, langid, licenses, lm, media, merkle, mixing, ngram_join, pii, quality, warc
from casdelta.llm.common import free, id_bucket, read


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, and each one's number of links."""
    return ngram_join.join(read(spark, sf_dir, "documents")).drop("key", "label")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and places of the base kinds, and all spans that the method finds."""
    docs = read(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs)).select("doc_id", "_spans", F.filter("_spans", lambda x: x["base"]).alias("_base"))
    number = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(number(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
        F.sha2(pii.written(F.col("_base")), 256).alias("base_sha256"),
        pii.written(F.col("_spans")).alias("spans"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents by the language model and by the base."""
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return lm.fit_and_score(read(spark, sf_dir, "documents")).select(columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents' sources."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth."""
    return ann.search(read(spark, sf_dir, "embeddings"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts that documents contain."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and what they decode to, as digests."""
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents."""
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality").alias("predicted"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as media, and what sniffing the stored bytes finds."""
    stored = media.store(read(spark, sf_dir, "documents"))
    return media.sniff(stored, keep=("doc_id", "n_bytes")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        media.feature(F.col("payload")).alias("feature"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, langid.train(docs)).select("doc_id", held, "lang_pred", "score")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked by importance for the benchmark's distribution."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by lang, its proofs, and what they say of rows of which one in seven has another n_chars."""
    docs = read(spark, sf_dir, "documents")
    (other,) = free(docs, "_tampered")
    changed = [(F.col("n_chars") + 1) if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    docs = docs.withColumn(other, F.when(id_bucket(F.col("doc_id"), 7) == 0, merkle.leaf(changed)))
    rows = merkle.verified(merkle.manifest(docs, other=F.col(other)), F.coalesce("other", "leaf"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.concat("proof", "tree_proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pages, written to archives and read back through the capture index."""
    pages = read(spark, sf_dir, "pages")
    _, shards, folder = warc.archive(pages)
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long").alias(c)
    return warc.read_back(pages, shards, folder).select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_pii": op2_pii, "op3_lm": op3_lm, "op4_mixing": op4_mixing, "op5_ann": op5_ann, "op6_licenses": op6_licenses, "op7_bpe": op7_bpe, "op8_quality": op8_quality, "op9_media": op9_media, "op10_langid": op10_langid, "op11_importance": op11_importance, "op12_merkle": op12_merkle, "op13_warc": op13_warc}

#: CRC-32 of a blob in SQL; {0}: the blob. The table of 256 is worked out from the polynomial.
CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS crc_t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_transform(range(1, octet_length({0}) + 1), lambda i: ('0x' || hex({0}[i:i]))::BIGINT), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLES = {
    "op1_ngram_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), texts AS (
  SELECT text, min(doc_id) AS id, count(*) AS copies, any_value(w) AS w FROM words GROUP BY text
), grams AS (
  SELECT DISTINCT id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT id, count(*) AS n FROM grams GROUP BY id
), pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS both FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2
), linked AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.id = p.a JOIN sizes y ON y.id = p.b WHERE 18 * p.both >= 8 * (x.n + y.n)
), reach(a, b) AS (
  SELECT id, id FROM texts UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b
), classes AS (
  SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a
), degrees AS (
  SELECT l.a AS id, count(*) AS n_texts, sum(t.copies) AS links FROM linked l JOIN texts t ON t.id = l.b GROUP BY l.a
)
SELECT d.doc_id, c.class_id,
  CASE WHEN len(d.w) = 0 THEN 0 ELSE coalesce(g.links, 0) + t.copies - 1 END::BIGINT AS n_links,
  coalesce(g.n_texts, 0)::BIGINT AS n_texts, t.copies
FROM words d JOIN texts t ON t.text = d.text JOIN classes c ON c.id = t.id LEFT JOIN degrees g ON g.id = t.id
""",
    "op4_mixing": """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[!*$#%&|]', '', 'g')) AS junk
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((concat('0x', substring(md5(concat(coalesce(doc_id::VARCHAR, '-'), ':', size)), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
      / greatest(0.1, floor((1 - 4 * (junk / greatest(chars, 1)::DOUBLE)) * 1024) / 1024) AS k
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM keyed GROUP BY source
), water(n, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT n + 1, (
    SELECT coalesce((1.5 * sum(source_size)::DOUBLE - 2 * coalesce(sum(source_size) FILTER (2 * source_size <= w.level * weight AND w.n > 0), 0)::DOUBLE)
      / nullif(sum(weight) FILTER (2 * source_size > w.level * weight OR w.n = 0), 0), w.level) FROM sources)
  FROM water w WHERE n < 40
), aims AS (
  SELECT source, source_size, least(2 * source_size, (SELECT max(level) FROM water) * weight)::DOUBLE AS target FROM sources
), placed AS (
  SELECT k.doc_id, k.size, a.source_size, a.target, floor(a.target)::BIGINT AS budget, floor(a.target)::BIGINT // nullif(a.source_size, 0) AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - k.size AS before
  FROM keyed k JOIN aims a ON a.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, size, source_size, target,
  (coalesce(epochs, 0) * size + least(size, greatest(0, budget - coalesce(epochs, 0) * source_size - before)))::BIGINT AS taken
FROM placed
""",
    "op6_licenses": """
WITH templates(license, t) AS (VALUES {values}), shingled AS (
  SELECT license, w, list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT license, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM templates)
), wanted AS (
  SELECT DISTINCT license, unnest(g) AS g FROM shingled
), sizes AS (
  SELECT license, count(*) AS n FROM wanted GROUP BY license
), words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
), had AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM words WHERE len(w) > 0
)
SELECT doc_id, license, count(*)::INTEGER AS matched, any_value(n)::INTEGER AS shingles, count(*) / any_value(n)::DOUBLE AS containment
FROM had JOIN wanted USING (g) JOIN sizes USING (license) GROUP BY doc_id, license HAVING 5 * count(*) >= 4 * any_value(n)
""".replace("{values}", ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES.items())),
    "op11_importance": f"""
WITH {CRC_TABLE}, doc_words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), goal_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark
), doc_features AS (
  SELECT r, unnest(w) AS f FROM doc_words
), buckets AS (
  SELECT f, {CRC.format("encode(f)")} % 10000 AS b FROM (SELECT f FROM doc_features UNION SELECT f FROM goal_words), crc_table
), s AS (
  SELECT b, count(*) AS n FROM doc_features JOIN buckets USING (f) GROUP BY b
), t AS (
  SELECT b, count(*) AS n FROM goal_words JOIN buckets USING (f) GROUP BY b
), gains AS (
  SELECT r.b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b
), weighed AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM doc_features JOIN buckets USING (f) JOIN gains USING (b) GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM doc_words LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (r)
""",
    "op12_merkle": f"""
WITH RECURSIVE {CRC_TABLE}, base AS (
  SELECT doc_id, '=' || lang AS t, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v, [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS u FROM documents
), leaves AS (
  SELECT doc_id, coalesce(t, '-') AS tree,
    sha256(array_to_string(list_transform(v, lambda x: coalesce(concat(octet_length(encode(x)), ':', x), '-')), '')) AS leaf,
    CASE WHEN {CRC.format("encode(doc_id::VARCHAR)")} % 7 = 0 THEN sha256(array_to_string(list_transform(u, lambda x: coalesce(concat(octet_length(encode(x)), ':', x), '-')), '')) END AS other
  FROM base, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2
), climb(tree, leaf_pos, level, pos, n, proof, folded) AS (
  SELECT tree, pos, 0, pos, n, '', coalesce(other, leaf) FROM placed
  UNION ALL
  SELECT c.tree, leaf_pos, c.level + 1, c.pos // 2, (c.n + 1) // 2, concat(proof, s.h), sha256(CASE WHEN c.pos % 2 = 0 THEN concat(folded, s.h) ELSE concat(s.h, folded) END)
  FROM climb c LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
), upper(tree, leaf_pos, level, pos, n, proof, folded) AS (
  SELECT c.tree, leaf_pos, 0, s.pos, s.n, proof, folded FROM climb c JOIN subroots s ON s.tree = c.tree WHERE c.n = 1
  UNION ALL
  SELECT u.tree, leaf_pos, u.level + 1, u.pos // 2, (u.n + 1) // 2, concat(proof, s.h), sha256(CASE WHEN u.pos % 2 = 0 THEN concat(folded, s.h) ELSE concat(s.h, folded) END)
  FROM upper u LEFT JOIN tops s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1
)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = t.h AS verified
FROM placed p JOIN upper u ON u.tree = p.tree AND u.leaf_pos = p.pos AND u.n = 1 JOIN subroots r ON r.tree = p.tree, (SELECT h FROM tops WHERE n = 1) t
""",
    "op13_warc": """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), marked AS (
  SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS d, max(page_id) OVER w AS first, row_number() OVER (w ORDER BY page_id DESC NULLS LAST) AS k
  FROM payloads WINDOW w AS (PARTITION BY b)
)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND k > 1 THEN first END AS refers_to FROM marked
""",
}
