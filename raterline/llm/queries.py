"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterline.llm import conversation_trie, decontamination, fingerprints, jaccard_join, language_id, packing, quality, ranked_search, secret_scan, substring_dedup, suffix_dedup, token_counts, toxicity
from raterline.llm.common import fold_of, table

ORACLE_SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_tokens=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, repository=F.col("doc_id"), owner=F.col("source"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 5) == 0
    # Documents whose labels differ teach nothing.
    labels = table(spark, sf_dir, "labels").where(~held).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_")).where("label = _").select("doc_id", "label")
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), quality.fit(docs, labels))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.WordModel | None:
    """Learned from the toxic rows of the training folds and unlabelled texts of the same folds."""
    held = fold_of(F.col("doc_id"), 5) == 0
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held & (F.col("toxic") == 1)), exclude=held)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 5) == 0
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), toxicity_model(spark, sf_dir, docs)).drop("text")


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op3_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, hash(array_to_string(w[i + 1 : i + 20], ' ')) AS h, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)
),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
bad AS (SELECT doc_id, unnest(p) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN bad USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.p), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_recurring(table(spark, sf_dir, "documents"))


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


ORACLE_SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE s / (p.n + q.n - s) >= 0.8),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, c.class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM d JOIN (SELECT x, min(y) AS class_id FROM reach GROUP BY x) c ON c.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = d.doc_id
"""


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op12_conversation_trie"] = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT range AS byte, range AS crc, 0 AS n FROM range(0, 256)
  UNION ALL SELECT byte, CASE WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END, n + 1 FROM bits WHERE n < 8
),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, CAST(4294967295 AS BIGINT) AS crc, 1 AS i FROM ids
  UNION ALL SELECT c.conv_id, c.digits, xor(c.crc // 256, b.crc), i + 1
  FROM crc c JOIN bits b ON b.n = 8 AND b.byte = xor(c.crc % 256, ascii(substr(c.digits, i, 1))) WHERE i <= length(c.digits)
),
heads AS (SELECT conv_id, xor(crc, 4294967295) % 9 AS h FROM crc WHERE i = length(digits) + 1),
raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT conv_id, turn, md5(concat(octet_length(encode(role)), ':', role, text)) AS m, octet_length(encode(text)) AS b FROM raw),
own AS (SELECT conv_id, list({'m': m, 'b': b} ORDER BY turn NULLS FIRST, m) AS t FROM hashed GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(s.t[1 : h], []), o.t[h + 1 :]) AS t
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 5
),
prefixes AS (SELECT conv_id, len(t) AS n, d, t[1 : d] AS p, CASE WHEN d > 0 THEN t[d].b ELSE 0 END AS b FROM rebuilt, LATERAL (SELECT unnest(range(0, len(t) + 1)) AS d)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM prefixes GROUP BY p, d
),
children AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
sized AS (SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c ON c.p = x.p AND c.d = x.d),
below AS (
  SELECT p[1 : a] AS p, a AS d, sum((n_convs - 1) * b) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM sized, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY ALL
)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children,
       CAST(w.leaves AS BIGINT) AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM sized x JOIN below w ON w.p = x.p AND w.d = x.d LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = x.p[1 : x.d - 1]
"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op13_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
sized AS (SELECT r, doc_id, 100 - 50 + ((50 * len(w) * docs) // total) AS m FROM d, s),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN sized USING (r) GROUP BY ALL
),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
