"""The operators' registered queries: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .labelled import held_out_fold
from .language import identify_language
from .licenses import scan_licenses
from .linededup import drop_repeated_lines
from .mixing import mix_sources
from .neardup import near_duplicates
from .neighbours import nearest
from .quality import score_quality
from .store import Workspace, read_table
from .tokencount import count_tokens
from .toxicity import score_toxicity

TOKENIZER = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + 9), ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, sizes WHERE len(w) >= n),
hit AS (SELECT p.r, p.s, p.n, win.item FROM (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM place) p JOIN win ON win.win = p.win AND win.n = p.n),
hit_word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS k FROM hit) GROUP BY r),
hit_item AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_word USING (r) LEFT JOIN hit_item USING (r)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # no other query needs it

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path(TOKENIZER), Workspace(spark, "op2").path("cache"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = held_out_fold("doc_id", 4, 2)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    return identify_language(docs, held_out, keep=["doc_id", "held_out"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = held_out_fold("doc_id", 5, 0)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    return score_quality(docs, read_table(spark, sf_dir, "labels"), held_out, keep=["doc_id", "held_out"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = held_out_fold("doc_id", 5, 0)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    return score_toxicity(docs, read_table(spark, sf_dir, "labels"), held_out, keep=["doc_id", "held_out"])


def mix_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Documents mixed by domain (a quarter of the sources each, by the source's digest),
    language and source; half of the tokens, two epochs at most."""
    domain = F.concat(F.lit("d"), (F.ascii(F.md5("source")) % 4).cast("string"))
    levels = [("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))]
    by_domain = F.when(F.col("domain") == "d0", 4).when(F.col("domain") == "d1", 3).when(F.col("domain") == "d2", 2).otherwise(1)
    by_lang = F.when(F.col("lang") == "en", 2).otherwise(3)
    return mix_sources(docs, levels, [by_domain, by_lang, F.lit(1)], budget_share=0.5, epochs=2, seed=7, keep=keep)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_of(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])


OP7_SQL = r"""
WITH counted AS (
  SELECT doc_id, coalesce('d' || (ascii(md5(source)) % 4), '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5(text) AS digest
  FROM documents),
used AS (SELECT * FROM counted WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS total, CAST(sum(n_tokens) * 2 AS BIGINT) AS c FROM used GROUP BY ALL),
g0 AS (SELECT least(coalesce(sum(c), 0), CAST(floor(coalesce(sum(total), 0) * 0.5) AS BIGINT)) AS given FROM leaf),
n1 AS (SELECT domain, sum(c) AS c, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY ALL),
o1 AS (
  SELECT n.*, given, coalesce(sum(c) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(w) OVER () AS ws
  FROM n1 n CROSS JOIN g0 WINDOW b AS (ORDER BY c / w, domain)),
f1 AS (SELECT *, c * (ws - wb) <= w * (given - cb) AS is_full FROM o1),
s1 AS (SELECT *, sum(CASE WHEN is_full THEN c ELSE 0 END) OVER () AS cf, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS wf FROM f1),
g1 AS (SELECT domain, CASE WHEN is_full THEN c ELSE w * (given - cf) // nullif(wf, 0) END AS given FROM s1),
n2 AS (SELECT domain, lang, sum(c) AS c, CASE lang WHEN 'en' THEN 2 ELSE 3 END AS w FROM leaf GROUP BY ALL),
o2 AS (
  SELECT n.*, given, coalesce(sum(c) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(w) OVER (PARTITION BY domain ) AS ws
  FROM n2 n JOIN g1 USING (domain) WINDOW b AS (PARTITION BY domain ORDER BY c / w, lang)),
f2 AS (SELECT *, c * (ws - wb) <= w * (given - cb) AS is_full FROM o2),
s2 AS (SELECT *, sum(CASE WHEN is_full THEN c ELSE 0 END) OVER (PARTITION BY domain ) AS cf, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain ) AS wf FROM f2),
g2 AS (SELECT domain, lang, CASE WHEN is_full THEN c ELSE w * (given - cf) // nullif(wf, 0) END AS given FROM s2),
n3 AS (SELECT domain, lang, source, sum(c) AS c, 1 AS w FROM leaf GROUP BY ALL),
o3 AS (
  SELECT n.*, given, coalesce(sum(c) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(w) OVER (PARTITION BY domain, lang ) AS ws
  FROM n3 n JOIN g2 USING (domain, lang) WINDOW b AS (PARTITION BY domain, lang ORDER BY c / w, source)),
f3 AS (SELECT *, c * (ws - wb) <= w * (given - cb) AS is_full FROM o3),
s3 AS (SELECT *, sum(CASE WHEN is_full THEN c ELSE 0 END) OVER (PARTITION BY domain, lang ) AS cf, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain, lang ) AS wf FROM f3),
g3 AS (SELECT domain, lang, source, CASE WHEN is_full THEN c ELSE w * (given - cf) // nullif(wf, 0) END AS given FROM s3),
plan AS (SELECT domain, lang, source, CAST(given AS BIGINT) AS leaf_budget, CAST(given // total AS INTEGER) AS whole, CAST(given % total AS BIGINT) AS rest FROM g3 JOIN leaf USING (domain, lang, source)),
placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '7', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), digest)) ROWS UNBOUNDED PRECEDING) AS upto
  FROM used JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch, leaf_budget FROM placed WHERE upto <= rest
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, whole)) AS INTEGER) AS epoch, leaf_budget FROM placed
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


OP8_SQL = r"""
WITH doc AS (SELECT doc_id, text, md5(text) AS digest, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, digest, unnest(range(0, len(lines))) AS i, trim(unnest(lines), ' ') AS t FROM (SELECT DISTINCT doc_id, digest, lines FROM doc WHERE text IS NOT NULL)),
win AS (
  SELECT doc_id, digest, i AS first, lead(i, 2) OVER w AS last, t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS win
  FROM line WHERE t <> '' WINDOW w AS (PARTITION BY doc_id, digest ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, digest, first) AS k FROM win WHERE last IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, digest, unnest(range(first, last + 1)) AS i FROM ranked WHERE k > 1),
cut AS (SELECT doc_id, digest, list(i) AS gone FROM covered GROUP BY doc_id, digest)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       CASE WHEN gone IS NULL THEN d.digest
            ELSE md5(coalesce(array_to_string(list_filter(list_transform(range(0, len(lines)), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE lines[i + 1] END), lambda x: x IS NOT NULL), chr(10)), '')) END AS text_md5
FROM doc d LEFT JOIN cut c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.digest = c.digest
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x.license, x.start.cast("string"), x.stop.cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_max(F.col("licenses.coverage")).alias("best_coverage"), spans.alias("matches"), "licensed")


QUERIES = {q.__name__: q for q in (op1_decontamination, op2_token_counts, op3_nearest_neighbours, op4_language_id, op5_quality, op6_toxicity, op7_mixing, op8_line_dedup, op9_near_duplicates, op10_license_scan)}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op7_mixing": OP7_SQL, "op8_line_dedup": OP8_SQL}
