"""Registered queries of the corpus operators and of the pipeline; DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm import (
    ann,
    conversation_trie,
    decontaminate,
    filter_audit,
    license_scan,
    lm_scoring,
    minhash,
    mixing,
    pii,
    quality,
    secret_scan,
    suffix_dedup,
    url_filter,
)
from shelfline.llm.common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@_query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


@_query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.report(table(spark, sf_dir, "documents"))


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_query
def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_every(table(spark, sf_dir, "embeddings"), 20)


@_query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


@_query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@_query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


# What SQL can express of results that it cannot express whole.
@_query
def base_of_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


@_query
def base_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules, and the verdicts of the rules."""
    judged = op10_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


@_query
def base_of_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_ALNUM_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

_OP4 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
item AS (SELECT row_number() OVER () AS i, coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM_WORDS} AS w FROM benchmark),
test AS (SELECT i, item, j, least(len(w), 10) AS size, list_slice(w, j, j + least(len(w), 10) - 1) AS win
         FROM item, range(1, len(w) - least(len(w), 10) + 2) AS t(j) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM test),
place AS (SELECT r, p, size, list_slice(w, p, p + size - 1) AS win FROM doc, sizes, range(1, len(w) - size + 2) AS t(p)),
found AS (SELECT r, p, place.size, i, item, j FROM place JOIN test ON place.size = test.size AND place.win = test.win),
hit AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT r, p, size FROM found), range(0, size) AS t(o) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
run AS (SELECT r, item, min(p) AS p, max(p) - min(p) + size AS words
        FROM (SELECT *, p - row_number() OVER (PARTITION BY r, i, p - j ORDER BY p) AS island FROM found) GROUP BY r, i, item, p - j, size, island),
best AS (SELECT r, words, item, p FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY words DESC, p, item) = 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(words AS INT) AS longest_match, item AS match_item, CAST(p - 1 AS INT) AS match_start
FROM doc LEFT JOIN hit USING (r) LEFT JOIN own USING (r) LEFT JOIN best USING (r)
"""


_OP12 = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
mark AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fail AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS f
         FROM doc LEFT JOIN mark USING (doc_id)),
mask AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fail GROUP BY part, f),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, b)),
perm AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM letter a, letter b, letter c, letter d, letter e
         WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
step AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM perm, range(1, 6) AS t(k)),
told AS (SELECT part, filter_order, step, own,
                sum(CASE WHEN (f & (before | own)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN (f & before) = 0 AND (f & own) > 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN (f & before) > 0 AND (f & own) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN (f & before) = 0 AND (f & own) > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN (f & before) = 0 AND (f & own) > 0 THEN toxic ELSE 0 END) AS toxic_lost
         FROM mask, step GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: per character one xor and eight shifts."""
    steps = f"list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])"
    step = "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten({steps})), {step}))"


_OP13 = """
WITH turn AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, conv_id - conv_id % 100 AS family,
                __CRC__ % 6 AS h
         FROM (SELECT DISTINCT conv_id FROM turn)),
built AS (SELECT conv.conv_id, 0 AS own, p, role, text FROM conv JOIN turn ON turn.conv_id = family AND p < h
          UNION ALL SELECT conv_id, 1, p, role, text FROM conv JOIN turn USING (conv_id) WHERE p >= h),
path AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY own, p) AS turns FROM built GROUP BY conv_id),
prefix AS (SELECT conv_id, 0 AS d, sha256('') AS k, 0 AS chars, turns IS NULL AS ends FROM conv LEFT JOIN path USING (conv_id)
           UNION ALL SELECT conv_id, d, sha256(CAST(to_json(turns[1:d]) AS VARCHAR)), length(turns[d].t), d = len(turns) FROM path, range(1, len(turns) + 1) AS t(d)),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ended
         FROM prefix GROUP BY d, k),
child AS (SELECT up.d, up.k, count(*) AS n_children FROM node JOIN prefix AS up ON up.conv_id = node.conv_id AND up.d = node.d - 1 GROUP BY up.d, up.k),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, k)),
below AS (SELECT up.d, up.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * f.chars) AS saved_tokens
          FROM full_node AS f JOIN prefix AS up ON up.conv_id = f.conv_id AND up.d <= f.d GROUP BY up.d, up.k),
parent AS (SELECT f.d, f.k, p.conv_id AS parent_conv_id FROM full_node AS f JOIN prefix AS up ON up.conv_id = f.conv_id AND up.d = f.d - 1 JOIN node AS p ON p.d = up.d AND p.k = up.k)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ended, '')) AS ends_sha256
FROM full_node JOIN below USING (d, k) LEFT JOIN parent USING (d, k)
"""


_BASE3 = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NULL THEN 0 ELSE __CRC__ % 5 END = 1 AS held_out,
                    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
token AS (SELECT r, held_out, unnest(list_append(w, NULL)) AS t FROM doc),
known AS (SELECT DISTINCT t FROM token WHERE NOT held_out),
total AS (SELECT count(*) AS n FROM token WHERE NOT held_out),
own AS (SELECT r, count(*) AS n_known FROM token WHERE EXISTS (SELECT 1 FROM known WHERE known.t IS NOT DISTINCT FROM token.t) GROUP BY r)
SELECT doc_id, held_out, CAST(len(w) + 1 AS BIGINT) AS n_tokens, coalesce(n_known, 0) AS n_known, n AS train_tokens FROM doc LEFT JOIN own USING (r), total
"""

_BASE10 = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(action, h, p)),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS by_rule
        FROM part, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, by_rule FROM part LEFT JOIN fit USING (page_id)
"""

_BASE11 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
phrase AS (SELECT * FROM (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) AS t(words, label)),
place AS (SELECT r, p - 1 AS spot, label FROM doc, phrase, range(1, len(w) - len(words) + 2) AS t(p) WHERE w[p] = words[1] AND list_slice(w, p, p + len(words) - 1) = words),
own AS (SELECT r, count(*) AS n, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM doc LEFT JOIN own USING (r)
"""


def oracle_sql() -> dict[str, str]:
    crc = _crc32("CAST(conv_id AS VARCHAR)"), _crc32("CAST(doc_id AS VARCHAR)")
    return {
        "op4_decontamination": _OP4, "op12_filter_audit": _OP12, "op13_conversation_trie": _OP13.replace("__CRC__", crc[0]),
        "base_of_op3": _BASE3.replace("__CRC__", crc[1]), "base_of_op10": _BASE10, "base_of_op11": _BASE11,
    }
