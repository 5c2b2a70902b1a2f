"""Preference data derived from the given tables: the same SQL text for Spark and for any other engine.

Names in braces are tables or other views. All expressions are integer or
string arithmetic, so engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.shared import dealt

HELD_OUT_PAIR = ("sys-c", "sys-v")

VIEWS = {
    # One comparison per order with a recorded verdict; about a fifth is held out.
    "fx_item": """
SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)) AS row_id, 'c' || CAST(o_custkey AS VARCHAR(20)) AS cluster_id,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0 THEN 'A' WHEN o_orderstatus = 'F' THEN 'A'
            WHEN o_orderstatus = 'O' THEN 'B' ELSE 'tie' END AS winner,
       o_orderkey % 7 = 0 AS position_unstable, o_orderkey % 50 = 3 AS parse_failed,
       o_orderpriority = '1-URGENT' AS held_out, o_orderkey AS item_no
FROM {orders}""",
    # Ordered human labels of comparisons that are not held out.
    "fx_ann": """
SELECT i.row_id, i.cluster_id, i.item_no, 's' || CAST(l_suppkey AS VARCHAR(20)) AS annotator_id,
       ROW_NUMBER() OVER (PARTITION BY i.row_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                          l_shipdate, l_returnflag, l_linestatus, l_discount, l_tax) AS ann_ord,
       CASE WHEN (l_partkey + l_suppkey) % 10 < 6 THEN i.winner WHEN l_returnflag = 'A' THEN 'A'
            WHEN l_returnflag = 'R' THEN 'B' ELSE 'tie' END AS preferred
FROM {lineitem} JOIN {fx_item} i ON l_orderkey = i.item_no
WHERE NOT i.held_out""",
    # The labels as single-label records: every fifth item without an id, every third without a cluster.
    "fx_record": """
SELECT item_no * 100 + ann_ord AS ord, CASE WHEN item_no % 5 = 0 THEN NULL ELSE row_id END AS id,
       'p' || CAST(item_no % 997 AS VARCHAR(20)) AS prompt, 'a' || CAST(item_no % 13 AS VARCHAR(20)) AS response_a,
       'b' || CAST(item_no % 7 AS VARCHAR(20)) AS response_b, preferred, annotator_id,
       CASE WHEN item_no % 3 = 0 THEN '' ELSE cluster_id END AS cluster_id
FROM {fx_ann}""",
    # Raw judgments in either slot order, several per item.
    "fx_raw": """
SELECT o_custkey AS question_id, 1 + o_orderkey % 2 AS turn,
       CASE WHEN l_linenumber % 3 = 0 THEN sys2 ELSE sys1 END AS model_a, CASE WHEN l_linenumber % 3 = 0 THEN sys1 ELSE sys2 END AS model_b,
       CASE WHEN l_quantity = 50 THEN 'unknown' WHEN l_quantity >= 45 THEN 'tie (inconsistent)' WHEN l_returnflag = 'A' THEN 'model_a'
            WHEN l_returnflag = 'R' THEN 'model_b' WHEN l_linestatus = 'F' THEN 'tie' ELSE 'tie (bothbad)' END AS winner,
       's' || CAST(l_suppkey AS VARCHAR(20)) AS judge
FROM {lineitem} JOIN (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'sys-c' WHEN o_orderpriority = '2-HIGH' THEN 'sys-a' ELSE 'sys-b' END AS sys1,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'sys-v' WHEN o_orderpriority = '2-HIGH' THEN 'sys-c' ELSE 'sys-v' END AS sys2
  FROM {orders}) o ON l_orderkey = o.o_orderkey""",
    # Pairs of texts as comparisons.
    "fx_pair": """
SELECT 'd' || CAST(a.doc_id AS VARCHAR(20)) AS row_id, a.source AS cluster_id, b.source AS prompt, a.text AS response_a,
       b.text AS response_b, a.lang AS lang
FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 1
WHERE a.doc_id % 2 = 0""",
    # Raw replies in both slot orders, some without a verdict.
    "fx_reply": """
SELECT 'd' || CAST(doc_id AS VARCHAR(20)) AS row_id, lang, source,
       CASE WHEN doc_id % 11 = 0 THEN 'no tag: ' || lang
            ELSE '[[A]] tentative; final [[ ' || CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || ' ]]' END AS reply,
       CASE WHEN doc_id % 13 = 0 THEN lang
            ELSE 'final [[' || CASE (doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'C' END || ']]' END AS reply_swapped
FROM {documents}""",
    # Transcripts without system messages: message number from 1.
    "fx_message": """
SELECT conv_id, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n
FROM {conversations} WHERE role <> 'system'""",
}
_USES = {"fx_item": [], "fx_ann": ["fx_item"], "fx_record": ["fx_ann"], "fx_raw": [], "fx_pair": [], "fx_reply": [], "fx_message": []}
_TABLES = ("orders", "lineitem", "documents", "conversations", "events")


#: Texts that Spark runs with less to shuffle: an item's number is as good as its id, and stands in the join; what follows an even number is odd.
_NARROWER = {"fx_ann": ("PARTITION BY i.row_id", "PARTITION BY i.item_no"), "fx_pair": ("a.doc_id % 2 = 0", "a.doc_id % 2 = 0 AND b.doc_id % 2 <> 0")}
#: Tables that are joined by a key, and the key.
_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def n_lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of lineitem, by the footers of its files."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace(*_NARROWER.get(name, ("", "")))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    if "lineitem" in frames:
        rows = n_lines(spark, sf_dir)
        frames |= {t: dealt(df, rows, _KEYS[t]) for t, df in frames.items() if t in _KEYS}
    frames |= {v: view(spark, sf_dir, v) for v in _USES[name]}
    if name == "fx_ann":
        frames["fx_item"] = dealt(frames["fx_item"], rows, "item_no")
    return spark.sql(text, **frames)


def with_views(names: list[str], select: str) -> str:
    """The same views as common table expressions before ``select``, for an engine that has the tables under their own names."""
    needed: list[str] = []

    def add(name: str) -> None:
        for used in _USES[name]:
            add(used)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    plain = {t: t for t in (*_TABLES, *VIEWS)}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in needed) + "\n" + select
