"""The operators as queries over the whole test tables, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import best_fit, chat_format, hard_negatives, interaction_audit, minhash, ngram_join, quality_classifier, quality_rules, sentencepiece_bpe, suffix_dedup, toxicity, url_filters, webp
from logweave.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))[0]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "posterior")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_probe(table(spark, sf_dir, "conversations")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("first").alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op12_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(hard_negatives.prepared(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_suffix_array_dedup, op3_best_fit_packing, op4_quality_classifier, op5_quality_rules, op6_sentencepiece, op7_chat_formatting, op8_minhash_near_dedup, op9_toxicity, op10_media_columns, op11_ngram_join, op12_interaction_audit, op13_hard_negatives)}

ORACLE = {
    "op1_url_filters": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(host, 'spam') OR contains(host, 'cheap-') OR contains(host, 'casino') OR regexp_matches('.' || host, '\.adserver\.') OR contains(path, '/ads/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op2_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
g AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
s AS (SELECT r, p FROM g QUALIFY count(*) OVER (PARTITION BY k) > 1),
e AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS nr FROM e),
runs AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY r, nr),
b AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
t AS (SELECT b.r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS done, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM b JOIN d USING (r) GROUP BY b.r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256, try(decode(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(done, 0) + 1)))) AS text FROM d LEFT JOIN t USING (r)""",
    "op11_ngram_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.b GROUP BY a) AS least USING (r)""",
    "op12_interaction_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic FROM t),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k::INTEGER AS step, filter_order[k] AS x FROM o, (SELECT unnest(range(1, 6)) AS k)),
g AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda z, i: [a, b, c, d, e][i]) AS fails, good, toxic FROM f),
v AS (SELECT g.*, filter_order, (SELECT min(strpos(filter_order, q)) FROM (SELECT unnest(fails) AS q)) AS stop FROM g, o),
m AS (SELECT part, s.filter_order, step, x, count(*) FILTER (stop IS NULL OR stop > step) AS kept, count(*) FILTER (stop = step) AS removed, count(*) FILTER (list_contains(fails, x) AND stop < step) AS redundant,
  count(*) FILTER (list_contains(fails, x) AND len(fails) = 1) AS unique_fails, count(*) FILTER (stop = step AND good) AS good_lost, count(*) FILTER (stop = step AND toxic) AS toxic_lost FROM v JOIN s USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley, x AS "filter" FROM m""",
    "op13_hard_negatives": """
WITH r AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5""",
}
