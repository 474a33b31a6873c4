"""The registered query of each training-data operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import ann, chat, exact_dedup, fill_in_middle, hard_negatives, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity
from seriesloom.llm.common import read


def _on(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read(spark, sf_dir, table))


def _labelled(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _on("documents", simhash.op1_simhash),
    "op2_toxicity": _labelled(toxicity.op2_toxicity),
    "op3_suffix_dedup": _on("documents", suffix_dedup.op3_suffix_dedup),
    "op4_ann": _on("embeddings", ann.op4_ann),
    "op5_quality_rules": _on("documents", quality_rules.op5_quality_rules),
    "op6_quality": _labelled(quality_classifier.op6_quality),
    "op7_packing": _on("documents", packing.op7_packing),
    "op8_token_counts": _on("documents", token_counts.op8_token_counts),
    "op9_mixing": _on("documents", mixing.op9_mixing),
    "op10_chat": _on("conversations", chat.op10_chat),
    "op11_hard_negatives": _on("embeddings", hard_negatives.op11_hard_negatives),
    "op12_fill_in_middle": _on("documents", fill_in_middle.op12_fill_in_middle),
    "op13_exact_dedup": _on("documents", exact_dedup.op13_exact_dedup),
}

_MIXING = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size,
  -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
  / greatest(0.05::DOUBLE, 1.0::DOUBLE - coalesce(len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / greatest(size, 1), 0)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT source, source_size, 3 * source_size AS lim, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
v AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM w),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER (ORDER BY lim::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw, row_number() OVER (ORDER BY lim::DOUBLE / w, place) AS rk FROM v),
f AS (SELECT min(rk) AS rk0, arg_min(lft, rk) AS lft0, arg_min(lw, rk) AS lw0 FROM r WHERE lim * lw > lft * w),
t AS (SELECT source, source_size, CASE WHEN rk0 IS NULL OR rk < rk0 THEN lim::DOUBLE ELSE (lft0 * w)::DOUBLE / lw0::DOUBLE END AS target FROM r CROSS JOIN f),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * source_size + 1e-6)::BIGINT AS budget FROM e),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM k)
SELECT o.doc_id, o.size, b.source_size, b.target, (b.epochs * o.size + greatest(0, least(o.size, b.budget - o.before)))::BIGINT AS taken
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source"""

_CHAT = """
WITH t AS (SELECT DISTINCT conv_id::BIGINT AS pair_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT pair_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY 1),
rep AS (SELECT l.pair_id, l.last, max(t.text) AS reply FROM l JOIN t ON t.pair_id = l.pair_id AND t.turn = l.last AND t.role = 'assistant' GROUP BY ALL),
nxt AS (SELECT pair_id, last, coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS other FROM rep WINDOW w AS (ORDER BY pair_id)),
two AS (SELECT t.*, CASE WHEN t.turn = n.last AND t.role = 'assistant' THEN n.other ELSE t.text END AS swapped FROM t LEFT JOIN nxt n ON n.pair_id = t.pair_id),
sides AS (SELECT pair_id, turn, role, text, 1 AS c, 0 AS r FROM two UNION ALL SELECT pair_id, turn, role, swapped, 0, 1 FROM two),
m AS (SELECT pair_id, turn, role, text, max(c) AS c, max(r) AS r, struct_pack(a := turn, b := role, c := text) AS place FROM sides GROUP BY ALL),
f AS (SELECT pair_id, min(place) AS first FROM m WHERE c + r = 1 GROUP BY 1),
p AS (SELECT m.*, coalesce(place < first, true) AS prompt FROM m LEFT JOIN f USING (pair_id)),
x AS (SELECT *, 'prompt' AS part FROM p WHERE prompt UNION ALL SELECT *, 'chosen' FROM p WHERE NOT prompt AND c = 1 UNION ALL SELECT *, 'rejected' FROM p WHERE NOT prompt AND r = 1),
z AS (SELECT pair_id, turn, role, text, part, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN '1' ELSE '0' END AS mask FROM x)
SELECT pair_id, """ + ", ".join(
    f"coalesce(string_agg({value}, '{between}' ORDER BY turn, role, text) FILTER (WHERE part = '{part}'), '') AS {part}{name}"
    for part, names in (("prompt", ("",)), ("chosen", ("", "_mask", "_chars")), ("rejected", ("", "_mask", "_chars")))
    for name, value, between in (("", "rendered", ""), ("_mask", "mask", ","), ("_chars", "CAST(length(rendered) AS VARCHAR)", ","))
    if name in names
) + " FROM z GROUP BY pair_id"

_NEGATIVES = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_inner_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
  FROM u a JOIN u r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

#: The others train, hash or tokenize in ways that SQL has no functions for; their tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_mixing": _MIXING,
    "op10_chat": _CHAT,
    "op11_hard_negatives": _NEGATIVES,
    "op12_fill_in_middle": _MIDDLE,
    "op13_exact_dedup": _EXACT,
}
