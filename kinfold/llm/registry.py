"""The queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import (
    byte_net,
    collocations,
    jaccard,
    licenses,
    main_text,
    mixing,
    pieces,
    quality,
    rotated_codes,
    suffixes,
    toxicity,
    warc,
    whitening,
)
from kinfold.llm.blocks import bound_batches
from kinfold.session import materialize


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    families = F.array_join(F.array_sort(F.array_distinct("licences.family")), ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), families.alias("families"), "licences")


def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.read_vocabulary()
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip")
    )


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    # the table has no capture times: pages count as fetched one second apart
    captured = F.date_format(F.timestamp_seconds(F.col("page_id") + 1_704_067_200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    captures = _table(spark, folder, "pages").withColumn("captured", captured)
    history = warc.capture_history(captures)
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_rotated_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rotated_codes.nearest(vectors.where("id % 20 = 0"), vectors)


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = main_text.extract(_table(spark, folder, "pages"), keep=["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        "predicted",
        F.size("sentences").cast("long").alias("n_offending"),
    )


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    counts = materialize(quality.base_rules(quality.text_counts(docs, ["doc_id", "lang"])))
    cutoffs = materialize(quality.thresholds(counts, _table(spark, folder, "labels")))
    return quality.judge(counts, cutoffs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_byte_net(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    net = byte_net.fit(docs, _table(spark, folder, "labels"))
    held_out = F.coalesce(byte_net.fold() == byte_net.HELD_OUT, F.lit(False))
    return byte_net.score(docs, net, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(_table(spark, folder, "embeddings"), keep=["vec_id"])
    return white.select(
        "vec_id",
        "component",
        "n",
        F.expr("try_cast(deviation as long)").alias("deviation"),  # null where it passes 64 bits
        "whitened",
        "explained",
        "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )


QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_licenses": op2_licenses,
    "op3_pieces": op3_pieces,
    "op4_jaccard": op4_jaccard,
    "op5_mix": op5_mix,
    "op6_warc": op6_warc,
    "op7_rotated_codes": op7_rotated_codes,
    "op8_main_text": op8_main_text,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_byte_net": op12_byte_net,
    "op13_whitening": op13_whitening,
}

# Counts phrases of every length directly; brackets of RE2 classes as in the contract.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
kept AS (SELECT lang, w FROM split WHERE len(w) > 0),
totals AS (SELECT lang, sum(len(w)) AS n FROM kept GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM kept, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)
),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inside AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, c.a
  FROM (SELECT lang, w, a, size, s, unnest(range(1, size - s + 2)) AS i
        FROM candidates, (SELECT unnest([2, 3, 4]) AS s) WHERE s < size) c
),
left_over AS (
  SELECT c.* FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM left_over)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, k,
         (1000 * c.a::HUGEINT * t.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first
  JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
WHERE rank <= 2000
"""

# Every string of 200 bytes by its md5; what no span covers is put together again.
OP1_SQL = r"""
WITH bytes AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
starts AS (SELECT r, doc_id, t, unnest(range(0, octet_length(t) - 199)) AS p FROM bytes WHERE octet_length(t) >= 200),
hashed AS (SELECT r, p, md5(t[p + 1:p + 200]) AS h FROM starts),
again AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, p FROM hashed WHERE h IN (SELECT h FROM again)),
marked AS (SELECT r, p, p > coalesce(max(p + 200) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM hits),
numbered AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM marked),
spans AS (SELECT r, g, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, g),
gaps AS (
  SELECT r, g, coalesce(lag(b) OVER (PARTITION BY r ORDER BY g), 0) AS a, a AS b FROM spans
  UNION ALL SELECT s.r, max(g) + 1, max(s.b), any_value(octet_length(t)) FROM spans s JOIN bytes USING (r) GROUP BY s.r),
kept AS (SELECT r, string_agg(hex(t[a + 1:b]), '' ORDER BY g) AS k FROM gaps JOIN bytes USING (r) WHERE b > a GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN n_removed IS NULL THEN sha256(t) ELSE sha256(unhex(coalesce(k, ''))) END AS kept_sha256
FROM bytes LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

# Equal sets are one point; points that share a shingle are compared, links followed to the end.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS k, s FROM sets),
points AS (SELECT k, any_value(n) AS n, any_value(s) AS s FROM named WHERE k IS NOT NULL GROUP BY k),
shingles AS (SELECT k, n, hash(unnest(s)) AS h FROM points),
shared AS (SELECT * FROM shingles WHERE h IN (SELECT h FROM shingles GROUP BY h HAVING count(*) > 1)),
pairs AS (
  SELECT a.k AS a, b.k AS b FROM shared a JOIN shared b ON a.h = b.h AND a.k < b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT k AS a, k AS b FROM points UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT k, min(doc_id) AS doc_id FROM named WHERE k IS NOT NULL GROUP BY k),
component AS (SELECT r.a AS k, min(l.doc_id) AS component_id FROM reach r JOIN least l ON l.k = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM named LEFT JOIN component USING (k)
"""

# Five hexadecimal digits are four digits of base 32.
OP6_SQL = r"""
WITH payload AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
digests AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM payload),
coded AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest
  FROM digests),
last AS (SELECT h, max(page_id) AS page FROM digests GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> page THEN page END AS refers_to
FROM coded JOIN last USING (h)
"""

# None for the others: models (2, 8, 9, 10, 12), an automaton (3), hash-drawn order (5), eigenvectors (13), and
# sums of doubles whose last digit depends on their order (7).
SQL: dict[str, str] = {
    "op1_suffixes": OP1_SQL,
    "op4_jaccard": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op11_collocations": OP11_SQL,
}
