"""The registered queries of this package, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    common,
    conversation_trie,
    decontaminate,
    graph_search,
    html_text,
    language_model,
    packing,
    quality,
    quality_rules,
    sanitise,
    secrets,
    simhash,
    urls,
    variants,
)
from faultline.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed rules of the URL contract.
PATH_RULES = [
    urls.PathRule("allow", "com", "/"),
    urls.PathRule("block", "example.com", "/en/"),
    urls.PathRule("allow", "www.example.com", "/en/"),
    urls.PathRule("block", "net", "/es/"),
    urls.PathRule("block", "net", "/fr/"),
]
#: A document is accepted from this score on.
ACCEPT = 0.3


def _query(name: str):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(common.prepare(spark), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        return build

    return register


@_query("op1_language_model")
def op1(spark, table):
    docs = table("documents")
    return language_model.score_texts(docs, common.fold(F.col("doc_id"), 10) == 0)


@_query("op2_graph_search")
def op2(spark, table):
    vectors = table("embeddings")
    return graph_search.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@_query("op3_packing")
def op3(spark, table):
    return packing.pack(table("documents"))


@_query("op4_decontaminate")
def op4(spark, table):
    marked = decontaminate.mark_contaminated(table("documents").select("doc_id", "text"), table("benchmark"))
    hit = F.col("benchmark_hits")
    return marked.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        decontaminate.digest_of(hit["items"]).alias("items_sha256"),
        hit["contaminated"].alias("contaminated"),
    )


@_query("op5_secrets")
def op5(spark, table):
    found = secrets.scan(table("documents").select("doc_id", "text"))
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return found.select("doc_id", *[F.col("secrets")[n].alias(n) for n in names])


@_query("op6_sanitise")
def op6(spark, table):
    found = sanitise.find_personal_data(table("documents"))
    counts = [sanitise.count_of(F.col("base"), k).alias(f"n_{k}") for k in sanitise.KINDS[:4]]
    return found.select(
        "doc_id", *counts, F.sha2(sanitise.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        sanitise.written(F.col("spans")).alias("spans"),
    )


@_query("op7_simhash")
def op7(spark, table):
    found = simhash.near_duplicates(table("documents"))
    return found.select("doc_id", simhash.as_hex(F.col("bits")).alias("fingerprint"), "component_id")


@_query("op8_html_text")
def op8(spark, table):
    found = html_text.extract_pages(table("pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> quality.Neighbours:
    """The classifier of `labels.quality`, learned from the rows that are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label"))
    return quality.fit_neighbours(docs, known.where(common.fold(F.col("doc_id"), 5) != 0))


@_query("op9_quality")
def op9(spark, table):
    docs = table("documents").select("doc_id", "text")
    scored = quality.score_column(docs, fit_quality(docs, table("labels")))
    return scored.select(
        "doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


@_query("op10_url_rules")
def op10(spark, table):
    judged = urls.judge_urls(table("pages").select("page_id", "url"), PATH_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@_query("op11_variants")
def op11(spark, table):
    words = cut_lineage(variants.count_words(table("documents")), "words")
    return variants.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@_query("op12_conversation_trie")
def op12(spark, table):
    turns, convs = conversation_trie.share_heads(conversation_trie.ordered_turns(table("conversations")))
    return conversation_trie.prefix_trie(turns, convs)


@_query("op13_quality_rules")
def op13(spark, table):
    labels = table("labels").select("doc_id", F.col("quality").alias("label"))
    judged = quality_rules.judge(table("documents").select("doc_id", "text", "lang"), labels)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col("measured")[c].alias(c) for c in counts], "base_failed", "kept")


ORACLES["op4_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
        row_number() OVER () AS rid
    FROM documents),
b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
sized AS (SELECT item, ws, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0),
windows AS (
    SELECT DISTINCT item, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS win
    FROM (SELECT item, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT rid, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS win
    FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)),
found AS (SELECT rid, p.i, p.size, w.item FROM places p JOIN windows w ON p.size = w.size AND p.win = w.win),
hit AS (
    SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS j FROM found) GROUP BY rid),
items AS (
    SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed
    FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

#: CRC-32 of an ASCII text `s`, with the table of its 256 steps as list `steps` in scope.
_CRC_STEPS = """
crc AS (
    SELECT list(v ORDER BY i) AS steps FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) t(i)))"""


def _crc(byte_list: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, {byte_list}),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"""


ORACLES["op12_conversation_trie"] = f"""
WITH {_CRC_STEPS},
t AS (
    SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS own FROM t GROUP BY c),
v AS (
    SELECT c, own, c - c % 100 AS base, {_crc("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 6 AS h
    FROM own, crc),
turns AS (
    SELECT v.c, t.p, t.role, t.text FROM v JOIN t ON t.c = v.base AND t.p < v.h
    UNION ALL
    SELECT v.c, least(v.h, coalesce(b.own, 0)) + t.p - v.h, t.role, t.text
    FROM v JOIN t ON t.c = v.c AND t.p >= v.h LEFT JOIN own b ON b.c = v.base),
m AS (
    SELECT c, p + 1 AS d, length(text) AS chars,
        sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY p)) AS k
    FROM turns
    UNION ALL SELECT c, 0, 0, '' FROM v),
ending AS (SELECT c, max(d) AS d FROM m GROUP BY c),
n AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM m GROUP BY k, d),
up AS (
    SELECT n.k, p.k AS pk, p.c AS pc
    FROM n JOIN m ON m.c = n.c AND m.d = n.d - 1 JOIN n p ON p.k = m.k AND p.d = m.d),
kids AS (SELECT pk AS k, count(*) AS kids FROM up GROUP BY pk),
below AS (
    SELECT m.k, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.chars) AS saved
    FROM n LEFT JOIN kids ON kids.k = n.k JOIN m ON m.c = n.c AND m.d <= n.d GROUP BY m.k),
ends AS (SELECT m.k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS listed FROM m JOIN ending USING (c, d) GROUP BY m.k)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, up.pc AS parent_conv_id, n.n AS n_convs,
    coalesce(kids.kids, 0) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
    CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.listed, '')) AS ends_sha256
FROM n JOIN below USING (k) LEFT JOIN up USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k)
"""
