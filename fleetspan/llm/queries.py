"""The registered queries of the training-data operators, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import kept, table
from fleetspan.llm.jaccard import jaccard_components
from fleetspan.llm.kneser_ney import held_out_scores
from fleetspan.llm.mixing import mix_sources
from fleetspan.llm.negatives import hard_negatives
from fleetspan.llm.private import replace_private
from fleetspan.llm.quality import quality_scores, statistics
from fleetspan.llm.repetition import repetition_rules
from fleetspan.llm.runs import periodic_runs, with_planted_runs
from fleetspan.llm.substrings import remove_repeats
from fleetspan.llm.tokens import encode_documents
from fleetspan.llm.url_rules import judge_urls
from fleetspan.llm.warc import archive_round_trip
from fleetspan.llm.winnowing import edited_fingerprints, fingerprint_text


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = archive_round_trip(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    made = remove_repeats(table(spark, folder, "documents"))
    return made.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_components(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    stats = kept(docs.select("doc_id", statistics(F.col("text")).alias("_stats")), "quality-statistics")
    return quality_scores(stats, table(spark, folder, "labels"))


def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    made = edited_fingerprints(table(spark, folder, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text("own").alias("fingerprint"),
        fingerprint_text("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_rules(table(spark, folder, "documents"))


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return made.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_private(spark: SparkSession, folder: str) -> DataFrame:
    return replace_private(table(spark, folder, "documents")).select("doc_id", "text", "n_entities")


def op9_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_scores(table(spark, folder, "documents"))


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"), slim=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


# The rules of op11.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules)


def run_figures(docs: DataFrame) -> DataFrame:
    """The runs of every document as counts, digests and the run of the greatest exponent."""
    run = "struct<start:bigint,length:bigint,period:bigint>"
    larger = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.lit(None).cast(run), lambda best, one: F.when(best.isNull() | larger(one, best), one).otherwise(best))
    line = lambda one: F.concat(one["start"], F.lit(","), one["length"], F.lit(","), one["period"], F.lit("\n"))
    return periodic_runs(docs, collapsed="sha256").withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.*",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_figures(with_planted_runs(table(spark, folder, "documents").select("doc_id", "text")))


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh id has the next label; every hundredth is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_substrings": op2_substrings,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_winnowing": op5_winnowing,
    "op6_repetition": op6_repetition,
    "op7_tokens": op7_tokens,
    "op8_private": op8_private,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_mix_sources": op10_mix_sources,
    "op11_url_rules": op11_url_rules,
    "op12_runs": op12_runs,
    "op13_negatives": op13_negatives,
}

OP1_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
named AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named
"""

OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items AS a JOIN items AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT sides.x, reach.other FROM sides JOIN reach ON reach.doc_id = sides.y)
SELECT sets.doc_id, len(sets.s) AS n_shingles, min(reach.other) AS component_id
FROM sets JOIN reach ON reach.doc_id = sets.doc_id GROUP BY sets.doc_id, len(sets.s)
"""

OP11_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts AS p LEFT JOIN rules AS r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

# The checksum of an id, one byte after the other, by the table of the reversed polynomial.
CRC32_SQL = """
steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
sums AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) AS h
  FROM documents, steps)
"""

OP12_SQL = rf"""
WITH {CRC32_SQL},
raw AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM sums),
measured AS (SELECT *, len(w) AS n, h // 10 AS g FROM raw),
shaped AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM measured),
words AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
           w[1:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1]) ELSE w END AS w
  FROM shaped),
-- One number per word of a document.
coded AS (SELECT doc_id, i, n, dense_rank() OVER (PARTITION BY doc_id ORDER BY word) AS code
          FROM (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM words)),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM coded AS x JOIN coded AS y ON x.doc_id = y.doc_id AND x.code = y.code AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.doc_id ORDER BY (CAST(length AS DECIMAL(18, 0)) / period) DESC, start, period) AS place FROM runs AS a)
  WHERE place = 1),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM words) AS u ANTI JOIN dropped AS d ON d.doc_id = u.doc_id AND d.i = u.i
  GROUP BY u.doc_id)
SELECT w.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(r.kept, '')) AS collapsed_sha256
FROM words AS w LEFT JOIN listed AS l USING (doc_id) LEFT JOIN best AS b USING (doc_id) LEFT JOIN rest AS r USING (doc_id)
"""

OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows AS a JOIN rows AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scores WHERE same) WHERE place <= 5),
pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives AS p JOIN scores AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_jaccard": OP3_SQL,
    "op11_url_rules": OP11_SQL,
    "op12_runs": OP12_SQL,
    "op13_negatives": OP13_SQL,
}
