"""Registered queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, quality_cnn
from plumbline.llm.common import crc_mod, table
from plumbline.llm.decontam import leaks
from plumbline.llm.jaccard_join import near_duplicates
from plumbline.llm.license_scan import license_scan
from plumbline.llm.line_dedup import removed_spans
from plumbline.llm.packing import pack_documents
from plumbline.llm.pii import personal_data
from plumbline.llm.prefix_trie import lent_prefix_trie
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.toxicity import toxicity
from plumbline.llm.warc import archive_round_trip
from plumbline.llm.whitening import whiten

#: Folder of the public tokenizer files.
TOKENIZERS = "/opt/tokenizers"


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality_cnn.fit(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    return quality_cnn.score(docs, net).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(docs, labels.filter(crc_mod("doc_id", 5) != 0)).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_mod("doc_id", 5) != 0), f"{TOKENIZERS}/piece_bpe_32k.model")
    return langid.predict(docs, model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", with_ids=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lent_prefix_trie(table(spark, sf_dir, "conversations"), every=20, most=3)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules measure, without the verdict of the sketches."""
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases, without the labels of templates."""
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of personal data, without those of the classifier."""
    return personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def _pii_sql() -> str:
    digits = "regexp_replace(x.w, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INTEGER) "
            f"ELSE CAST({digits}[i] AS INTEGER) * 2 - CASE WHEN CAST({digits}[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0")
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(x.w, '.'), lambda y: CAST(y AS HUGEINT))) <= 255"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15")}
    parts = [f"""SELECT doc_id, {n} AS k, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda y: length(y)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0), 'w': m[i]}})) AS x FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p
        FROM d WHERE regexp_matches(text, '{pattern}'))""" for n, (kind, (pattern, _)) in enumerate(kinds.items())]
    kept = " OR ".join(f"(kind = '{kind}' AND {test})" for kind, (_, test) in kinds.items())
    return f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)
, f AS ({' UNION ALL '.join(parts)})
, v AS (SELECT doc_id, k, kind, CAST(x.s AS BIGINT) AS s, length(x.w) AS n FROM f WHERE {kept})
SELECT a.doc_id, {', '.join(f"count(*) FILTER (v.kind = '{kind}') AS n_{kind}" for kind in kinds)},
       sha256(coalesce(string_agg(v.kind || ':' || v.s || ':' || (v.s + v.n), ',' ORDER BY v.k, v.s), '')) AS base_sha256
FROM documents a LEFT JOIN v ON a.doc_id = v.doc_id GROUP BY a.doc_id"""


QUERIES = {
    "op1_quality_cnn": op1_quality_cnn,
    "op2_toxicity": op2_toxicity,
    "op3_langid": op3_langid,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_warc_bundles": op5_warc_bundles,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_pii": op12_pii,
    "op13_whitening": op13_whitening,
    "quality_base": quality_base,
    "license_base": license_base,
    "pii_base": pii_base,
}

#: SQL of those queries that SQL can express; the others are tested against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents)
, g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d)
, n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
, c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL)
, l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE c.c >= 0.8 * (x.n + y.n - c.c) - 1e-9)
, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
, r(node, class_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.class_id FROM r JOIN e ON r.node = e.a)
, m AS (SELECT node AS doc_id, min(class_id) AS class_id FROM r GROUP BY node)
SELECT m.doc_id, m.class_id, count(e.a) AS n_links FROM m LEFT JOIN e ON e.a = m.doc_id GROUP BY ALL""",
    "op5_warc_bundles": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages)
, k AS (SELECT page_id, strlen(payload) AS n, sha256(payload) AS digest FROM p)
, f AS (SELECT digest, min(page_id) AS first FROM k WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, k.digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM k LEFT JOIN f ON k.digest = f.digest""",
    "op11_prefix_trie": r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS steps)
, t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
        FROM conversations WHERE conv_id IS NOT NULL)
, d AS (SELECT conv_id, place, length(role) || ':' || role || text AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t)
, c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                        lambda a, b: xor(a // 256, steps[xor(a, b) % 256 + 1])), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM d), crc)
, lent AS (SELECT c.conv_id, d.place, d.turn, d.words FROM c JOIN d ON d.conv_id = c.conv_id - c.conv_id % 20 AND d.place < c.h)
, k AS (SELECT c.conv_id, c.h, count(lent.place) AS n FROM c LEFT JOIN lent ON c.conv_id = lent.conv_id GROUP BY ALL)
, r AS (SELECT * FROM lent UNION ALL SELECT d.conv_id, d.place - k.h + k.n, d.turn, d.words FROM d JOIN k ON d.conv_id = k.conv_id AND d.place >= k.h)
, s AS (SELECT k.conv_id, coalesce(list(md5(r.turn) ORDER BY r.place) FILTER (r.place IS NOT NULL), []) AS turns, coalesce(list(r.words ORDER BY r.place) FILTER (r.place IS NOT NULL), []) AS words
        FROM k LEFT JOIN r ON k.conv_id = r.conv_id GROUP BY k.conv_id)
, p AS (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM s)
, x AS (SELECT conv_id, depth, md5(array_to_string(turns[1:depth], ',')) AS node, md5(array_to_string(turns[1:depth - 1], ',')) AS above,
               CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words, depth = len(turns) AS is_end FROM p)
, n AS (SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM x GROUP BY depth, node)
, ch AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL)
, o AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM n LEFT JOIN ch ON n.depth = ch.depth AND n.node = ch.node)
, sub AS (SELECT x.depth, x.node, CAST(sum(o.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (o.n_children = 0) AS n_leaves
          FROM o JOIN x ON x.conv_id = o.conv_id AND x.depth <= o.depth GROUP BY ALL)
SELECT o.conv_id, o.depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, sub.n_leaves, sub.saved_tokens, o.ends_sha256
FROM o JOIN sub ON o.depth = sub.depth AND o.node = sub.node LEFT JOIN n up ON up.depth = o.depth - 1 AND up.node = o.above""",
    "pii_base": _pii_sql(),
    "quality_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
, l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
, g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8)
, r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2)
, c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(8)) AS o) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
       coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id""",
    "license_base": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
, p(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved'))
, h AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS at FROM d, p)
SELECT d.doc_id, len(d.w) AS n_words, count(h.at) AS n_base, min(h.at) AS first_word, max(h.at) AS last_word, coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '') AS base_labels
FROM d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id, d.w""",
}
