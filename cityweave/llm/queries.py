"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm.base import table


def op1_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    worst = F.get("offending", F.lit(0))
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.rules import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.slots import assign

    return assign(table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.wumanber import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.superkmer import removals

    return removals(table(spark, sf_dir, "documents"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.kneser import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def op10_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.brown import score

    return score(table(spark, sf_dir, "documents"))


def op11_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.repair import damaged_and_repaired

    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_range_finder_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of the pages whose id is divisible by 20, so other forms and repeats of them are found."""
    from cityweave.llm.urlfilter import judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, pages.where(F.col("page_id") % 20 == 0).select("url"))


QUERIES = {f.__name__: f for f in (op1_noisy_or_toxicity, op2_simhash_trie, op3_boosted_rules, op4_virtual_slots, op5_warc_revisits, op6_best_fit_packing, op7_wu_manber, op8_super_kmers, op9_kneser_ney_quality, op10_brown_classes, op11_earley_repair, op12_range_finder_whitening, op13_url_filters)}
_SPACE = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_warc_revisits": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
b AS (SELECT payload_digest, max(page_id) AS best FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to FROM d LEFT JOIN b ON b.payload_digest = d.payload_digest AND payload_bytes >= 1000""",
    "op7_wu_manber": f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW % "text"}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), bw AS (SELECT item_id, regexp_extract_all({_LOW % "text"}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0), g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
o AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT o.doc_id, o.i, o.k, g.item_id FROM o JOIN g ON g.g = o.g AND g.k = o.k),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN c ON c.doc_id = dw.doc_id LEFT JOIN s ON s.doc_id = dw.doc_id""",
    "op8_super_kmers": f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACE}), []) AS w FROM documents), g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g), x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE again),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d), kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS t, count(*) AS n FROM u LEFT JOIN x ON x.doc_id = u.doc_id AND x.k = u.k WHERE x.k IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op13_url_filters": r"""WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS q FROM p),
k AS (SELECT page_id, host, path, regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www\.', '') AS bare, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept FROM h),
c AS (SELECT page_id, host, path, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS form FROM k),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v(rh, rp, rv)),
f AS (SELECT page_id, host, path, form, (SELECT arg_max(rh || rp || ' ' || rv, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM c),
l AS (SELECT DISTINCT form FROM c WHERE page_id % 20 = 0 AND form IS NOT NULL)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule, CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2) WHEN l.form IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN best IS NULL THEN l.form IS NOT NULL END AS listed
FROM f LEFT JOIN l ON l.form = f.form""",
}
