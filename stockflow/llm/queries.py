"""The registered query of each text operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockflow.llm import bpe, chunks, decontamination, hard_negatives, licenses, lines, lm, merkle, packing, quality, simhash, syncmers, toxicity
from stockflow.llm.frames import read
from stockflow.plans.registry import query


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


LINES = """
WITH line AS (
    SELECT doc_id, l.pos AS pos, l.line AS line,
           translate(trim(l.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) AS l FROM documents)
), frequent AS (
    SELECT key, max(doc_id) AS keep FROM line WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT line.*, frequent.key IS NOT NULL AND doc_id <> keep AS gone FROM line LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op5_lines", LINES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_syncmers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"))


# All windows that share a shingle with an item, compared with every item (the tables' items have five words at least).
LEAKS = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), item AS (
    SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 5
), total AS (
    SELECT count(DISTINCT w)::DOUBLE AS n_kinds FROM item
), item_shingle AS (
    SELECT item_id, w, n, place AS off, array_to_string(w[place + 1:place + 5], ' ') AS sh FROM (SELECT *, unnest(range(n - 4)) AS place FROM item)
), doc_shingle AS (
    SELECT doc_id, length, place, array_to_string(w[place + 1:place + 5], ' ') AS sh
    FROM (SELECT doc_id, w, len(w) AS length, unnest(range(greatest(len(w) - 4, 0))) AS place FROM doc)
), weight AS (
    SELECT sh, 1 + ln(any_value(n_kinds) / count(DISTINCT w)) AS weight FROM item_shingle, total GROUP BY sh
), win AS (
    SELECT DISTINCT doc_id, greatest(0, least(place - off, length - n)) AS start, n, least(n, length) AS size FROM doc_shingle JOIN item_shingle USING (sh)
), win_bag AS (
    SELECT doc_id, start, n, size, sh, count(*) AS c FROM win JOIN doc_shingle USING (doc_id) WHERE place BETWEEN start AND start + size - 5 GROUP BY ALL
), item_bag AS (
    SELECT item_id, sh, count(*) AS c, any_value(weight) AS weight FROM item_shingle JOIN weight USING (sh) GROUP BY ALL
), win_sum AS (
    SELECT doc_id, start, n, size, sum(c * coalesce(weight, 1 + ln(n_kinds))) AS win_total FROM win_bag LEFT JOIN weight USING (sh), total GROUP BY ALL
), item_sum AS (
    SELECT item_id, sum(c * weight) AS item_total FROM item_bag GROUP BY item_id
), shared AS (
    SELECT doc_id, start, n, size, item_id, sum(item_bag.weight * least(win_bag.c, item_bag.c)) AS common FROM win_bag JOIN item_bag USING (sh) GROUP BY ALL
), rated AS (
    SELECT doc_id, item_id, start, size, common / (win_total + item_total - common) AS s FROM shared JOIN win_sum USING (doc_id, start, n, size) JOIN item_sum USING (item_id)
)
SELECT doc_id, item_id, round(s, 6) AS similarity, start::INTEGER AS start_word, size::INTEGER AS n_words FROM rated WHERE s >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, start) = 1
"""


@query("op10_decontamination", LEAKS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op3_chunks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_licenses")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"))


# crc32 is folded byte by byte; levels and folds are recursive, each level a table of its nodes.
MANIFEST = """
WITH RECURSIVE row AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER () AS id, source, lang, n_chars, text,
           list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc
    FROM documents
), hashed AS (
    SELECT *, sha256(a || b || c || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || d) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
                THEN sha256(a || b || c || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || d) END AS altered
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b,
                 coalesce(strlen(lang) || ':' || lang, '-') AS c, coalesce(strlen(text) || ':' || text, '-') AS d FROM row)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), node AS (
    SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 2
), subroot AS (
    SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
    SELECT 0 AS level, pos, n, subroot AS h FROM subroot
    UNION ALL
    SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2
), root AS (
    SELECT h AS root, level AS height FROM top WHERE n = 1
), step AS (
    SELECT p.id, s.level, node.h, node.pos & 1 AS is_right
    FROM placed p JOIN subroot USING (tree) CROSS JOIN (SELECT unnest(range(64)) AS level) s
    LEFT JOIN node ON node.tree = p.tree AND node.level = s.level AND node.pos = xor(p.pos >> s.level, 1) WHERE s.level < subroot.height
    UNION ALL
    SELECT p.id, subroot.height + s.level, top.h, top.pos & 1
    FROM placed p JOIN subroot USING (tree) CROSS JOIN root CROSS JOIN (SELECT unnest(range(64)) AS level) s
    LEFT JOIN top ON top.level = s.level AND top.pos = xor(subroot.pos >> s.level, 1) WHERE s.level < root.height
), fold AS (
    SELECT id, 0 AS level, coalesce(altered, leaf) AS h FROM placed
    UNION ALL
    SELECT fold.id, fold.level + 1, sha256(CASE WHEN step.h IS NULL THEN fold.h WHEN step.is_right = 1 THEN fold.h || step.h ELSE step.h || fold.h END)
    FROM fold JOIN step USING (id, level)
), proof AS (
    SELECT id, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM step GROUP BY id
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM placed JOIN subroot USING (tree) CROSS JOIN root LEFT JOIN proof USING (id) JOIN fold ON fold.id = placed.id AND fold.level = subroot.height + root.height
"""


@query("op11_merkle", MANIFEST)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query_rows(read(spark, sf_dir, "documents", *merkle.FIELDS))


@query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query_rows(read(spark, sf_dir, "documents", "doc_id", "text"))


HARD_NEGATIVES = """
WITH base AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), score AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label AS anchor_label, b.row AS row, b.vec_id AS id, b.label AS label,
           list_inner_product(a.v, b.v)::BIGINT AS s
    FROM base a JOIN base b ON a.row <> b.row WHERE a.vec_id % 50 = 0
), positive AS (
    SELECT * FROM score WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5
), negative AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.s AS positive_score, n.s AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.s DESC, n.id)::INTEGER AS rank
    FROM positive p JOIN score n ON p.anchor = n.anchor AND n.label <> n.anchor_label
    WHERE 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
)
SELECT * FROM negative WHERE rank <= 3
"""


@query("op13_hard_negatives", HARD_NEGATIVES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
