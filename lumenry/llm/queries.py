"""One query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .html_text import html_text
from .lexical_search import lexical_search
from .license_scan import license_scan
from .merkle import manifest
from .mixing import mix_sources
from .ngram_join import ngram_join
from .perplexity import quality_classifier
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .topk import top_k
from .toxicity import toxicity
from .warc import archived

VOCABULARY = "word_bpe_49k.json"
#: The mixture: domains (which the test tables only imply, by the number in a source's name), languages, sources.
NUMBER = "coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 2)"
MIX_LEVELS = (f"CASE pmod({NUMBER}, 3) WHEN 0 THEN 'reference' WHEN 1 THEN 'forum' ELSE 'web' END", "lang", "source")
MIX_WEIGHTS = {("reference",): 3.0, ("forum",): 1.0, ("web",): 2.0, ("reference", "de"): 3.0, ("web", "en"): 2.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), MIX_LEVELS, 0.5, MIX_WEIGHTS, epochs=2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_text": op4_html_text,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_topk": op9_topk,
    "op10_ngram_join": op10_ngram_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle": op12_merkle,
    "op13_warc": op13_warc,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) a
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.i = a.i) GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20""",
    "op10_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, coalesce(k, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM l GROUP BY 1) USING (doc_id)""",
    "op11_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM b GROUP BY ALL),
 g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
 p AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
 s AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN q USING (term), g GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "op12_merkle": r"""
WITH RECURSIVE f AS (SELECT row_number() OVER () AS r, doc_id, source, text,
  concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
   lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) AS crc FROM documents),
 l AS (SELECT r, doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND crc % 5 = 0 THEN sha256(concat(head, coalesce(strlen(low) || ':' || low, '-'))) END AS altered FROM f),
 o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
 low AS (SELECT 0 AS level, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS width FROM o
  UNION ALL SELECT level + 1, tree, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(width) + 15) // 16 FROM low WHERE width > 1 GROUP BY level, tree, pos // 16),
 top AS (SELECT tree, h AS subroot FROM low WHERE width = 1),
 high AS (SELECT 0 AS level, tree AS pos, subroot AS h, count(*) OVER () AS width FROM top
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(width) + 15) // 16 FROM high WHERE width > 1 GROUP BY level, pos // 16),
 root AS (SELECT h AS root FROM high WHERE width = 1),
 depth AS (SELECT tree, max(level) AS deep FROM low GROUP BY tree),
 steps AS (SELECT r, level AS step, low.pos AS p, CAST(o.pos // CAST(pow(16, level) AS BIGINT) AS BIGINT) AS mine, h FROM o JOIN low USING (tree) WHERE width > 1 AND low.pos // 16 = o.pos // CAST(pow(16, level + 1) AS BIGINT)
  UNION ALL SELECT r, deep + level, high.pos, tree // CAST(pow(16, level) AS BIGINT), h FROM o JOIN depth USING (tree) JOIN high ON width > 1 AND high.pos // 16 = tree // CAST(pow(16, level + 1) AS BIGINT)),
 sides AS (SELECT r, step, coalesce(string_agg(h, '' ORDER BY p) FILTER (p < mine), '') AS a, coalesce(string_agg(h, '' ORDER BY p) FILTER (p > mine), '') AS b FROM steps GROUP BY r, step),
 proof AS (SELECT r, sha256(string_agg(concat(a, b), '' ORDER BY step)) AS proof FROM sides GROUP BY r),
 fold AS (SELECT r, 0 AS step, coalesce(altered, leaf) AS h FROM o
  UNION ALL SELECT r, step + 1, sha256(concat(a, h, b)) FROM fold JOIN sides USING (r, step)),
 done AS (SELECT r, arg_max(h, step) AS folded FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM o JOIN top USING (tree) JOIN done USING (r) LEFT JOIN proof USING (r), root""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
 f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f""",
}
