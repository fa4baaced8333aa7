"""One query for each operator over its whole table, with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio_spark.llm import language, quality, toxicity
from helio_spark.llm.decontaminate import contamination_digest, find_contamination
from helio_spark.llm.examples import fold, labelled_examples
from helio_spark.llm.filter_audit import audit_filters
from helio_spark.llm.hard_negatives import mine_hard_negatives
from helio_spark.llm.line_dedup import dedup_lines
from helio_spark.llm.mixing import mix
from helio_spark.llm.ngram_join import near_duplicates
from helio_spark.llm.phrase_dedup import remove_repeats
from helio_spark.llm.syncmers import fingerprints
from helio_spark.llm.token_counts import token_counts
from helio_spark.llm.warc import page_digest, read_warc, write_warc
from helio_spark.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT d.*, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT r, i, dw.k, item FROM dw JOIN bw USING (k, g)),
n AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""


@query("op4_decontaminate", CONTAMINATION_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(find_contamination(docs, table(spark, sf_dir, "benchmark"), matches=False))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS k FROM pages),
o AS (SELECT k, max(page_id) AS owner FROM p GROUP BY k),
bits AS (
  SELECT page_id, k, CAST(strlen(html) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(string_split(sha1(html), ''),
           lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS b
  FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INTEGER)
           + 4 * CAST(substr(b, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INTEGER)
           + CAST(substr(b, 5 * i + 5, 1) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM bits JOIN o USING (k)"""


@query("op3_syncmers")
def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op10_warc", WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), archive)
    return page_digest(read_warc(spark, archive))


def _held_out(parts: int, rest: int):
    return F.coalesce(fold("doc_id", parts) == rest, F.lit(False))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    examples = labelled_examples(
        docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 4) != 2, quality.EXAMPLES
    )
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.fit(examples))
    return scored.select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    examples = labelled_examples(
        docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0, toxicity.EXAMPLES
    )
    scored = toxicity.score_toxicity(docs, toxicity.fit(examples))
    return scored.select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "terms",
    )


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold("doc_id", 3) != 1)
    found = language.predict_language(docs, model)
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


SHINGLES_SQL = rf"""
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)),
           lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS grams
  FROM d WHERE len(w) > 0),
g AS (SELECT r, len(grams) AS n, unnest(grams) AS gram FROM s)"""

NEAR_SQL = f"""
WITH RECURSIVE {SHINGLES_SQL},
u AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
e AS (
  SELECT a.r AS x, b.r AS y
  FROM (SELECT * FROM g SEMI JOIN u USING (gram)) a JOIN (SELECT * FROM g SEMI JOIN u USING (gram)) b
    ON a.gram = b.gram AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(x, y) AS (
  SELECT r, r FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, CAST(coalesce(len(s.grams), 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN s USING (r)
JOIN (SELECT x AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.y GROUP BY x) c USING (r)"""


@query("op7_ngram_join", NEAR_SQL)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS no FROM d),
w AS (SELECT doc_id, no, regexp_extract_all(lower(lines[no]), '[^\x20\x09-\x0D]+') AS w FROM l),
s AS (
  SELECT row_number() OVER (ORDER BY doc_id, no) AS r, doc_id, no,
         list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)),
           lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS t
  FROM w WHERE len(w) > 0),
g AS (SELECT r, len(t) AS n, unnest(t) AS t FROM s),
gone AS (
  SELECT DISTINCT y AS r FROM (
    SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.t = b.t AND a.r < b.r
    GROUP BY a.r, b.r, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*)))),
out AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.r) AS n_removed,
         string_agg(lines[l.no], chr(10) ORDER BY l.no) FILTER (WHERE gone.r IS NULL) AS text
  FROM l LEFT JOIN s ON s.doc_id = l.doc_id AND s.no = l.no LEFT JOIN gone ON gone.r = s.r
  GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, coalesce(text, '') AS text
FROM out UNION ALL
SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), "text")


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy
  FROM documents),
k AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good,
         max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS bad
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (strlen(t) - strlen(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN copy THEN 16 ELSE 0 END AS fails
  FROM d LEFT JOIN k USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS b
  FROM l l1 JOIN l l2 ON l2.x <> l1.x JOIN l l3 ON l3.x NOT IN (l1.x, l2.x)
  JOIN l l4 ON l4.x NOT IN (l1.x, l2.x, l3.x) JOIN l l5 ON l5.x NOT IN (l1.x, l2.x, l3.x, l4.x)),
s AS (
  SELECT filter_order, i AS step, b[i] AS own, coalesce(list_sum(list_slice(b, 1, i - 1)), 0) AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM o)),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN fails & CAST(before + own AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & own > 0 AND fails & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & own > 0 AND fails & CAST(before AS INTEGER) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & own > 0 AND fails & CAST(before AS INTEGER) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & own > 0 AND fails & CAST(before AS INTEGER) = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
a AS (SELECT row_number() OVER () AS k, * FROM r WHERE vec_id % 50 = 0),
s AS (
  SELECT k, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM a JOIN r ON a.vec_id <> r.vec_id),
p AS (
  SELECT k, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS i
  FROM s WHERE same QUALIFY i <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.k, p.i ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.k = p.k AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  QUALIFY rank <= 3)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


#: Texts in hex, so that a place is a byte.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT *, unnest(generate_series(0, strlen(h) // 2 - 50)) AS i FROM d WHERE strlen(h) >= 100 AND doc_id IS NOT NULL)),
m AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s),
hit AS (SELECT r, i FROM w JOIN m USING (s) WHERE doc_id > owner),
fresh AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS no FROM fresh),
span AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY r, no),
gap AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM span
  UNION ALL SELECT d.r, coalesce(max(b), 0), any_value(strlen(h)) // 2 FROM d LEFT JOIN span USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN n USING (r)"""


@query("op12_phrase_dedup", REPEATS_SQL)
def op12_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
