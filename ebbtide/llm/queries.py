"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import (
    chat, exact_dedup, html_text, language, lattice_dedup, near_dedup, packing, pieces, quality, repair, rules, token_output,
    tokens, whitening,
)
from ebbtide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_training_order")
def op1_training_order(spark, folder):
    """The binary shards themselves."""
    return token_output.materialise(table(spark, folder, "documents"), public_tokenizers.path(tokens.VOCABULARY))


@query("op2_pairwise_quality")
def op2_pairwise_quality(spark, folder):
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


NEAR_SQL = r"""WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links)"""


@query("op3_minmax_near_dedup", "WITH RECURSIVE" + NEAR_SQL.removeprefix("WITH") + """,
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least_id l ON l.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""")
def op3_minmax_near_dedup(spark, folder):
    return near_dedup.near_classes(table(spark, folder, "documents"), words=3, similar=85)


@query("op4_decision_list")
def op4_decision_list(spark, folder):
    return rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_ppm_language")
def op5_ppm_language(spark, folder):
    return language.identify(table(spark, folder, "documents"))


@query("op6_pattern_packing")
def op6_pattern_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(tokens.VOCABULARY))


@query("op7_quotation_linking", r"""WITH RECURSIVE said AS (
  SELECT conv_id, turn, min(role) AS role, min(text) AS text,
    trim(regexp_replace(lower(min(text)), '\s+', ' ', 'g')) AS t FROM conversations GROUP BY conv_id, turn),
first_said AS (SELECT conv_id, t, min(turn) AS origin FROM said WHERE t <> '' GROUP BY conv_id, t),
quotes AS (
  SELECT s.conv_id, s.turn, k.level, p.t FROM said s, (SELECT unnest([1, 2]) AS level) k
  JOIN said p ON p.conv_id = s.conv_id AND p.turn = s.turn - k.level),
linked AS (
  SELECT q.conv_id, q.turn, count(*) AS n_linked, arg_min(f.origin, q.level) AS parent
  FROM quotes q JOIN first_said f ON f.conv_id = q.conv_id AND f.t = q.t AND f.origin < q.turn GROUP BY q.conv_id, q.turn),
climb AS (
  SELECT s.conv_id, s.turn, s.turn AS thread, 0 AS depth, l.parent FROM said s LEFT JOIN linked l USING (conv_id, turn)
  UNION ALL
  SELECT c.conv_id, c.turn, c.parent, c.depth + 1, l.parent FROM climb c
  LEFT JOIN linked l ON l.conv_id = c.conv_id AND l.turn = c.parent WHERE c.parent IS NOT NULL),
tops AS (SELECT conv_id, turn, thread, CAST(depth AS BIGINT) AS depth FROM climb WHERE parent IS NULL)
SELECT s.conv_id, s.turn, s.role, l.parent, t.thread, t.depth,
  row_number() OVER (PARTITION BY s.conv_id, t.thread ORDER BY s.turn) - 1 AS position,
  (SELECT count(*) FROM quotes q WHERE q.conv_id = s.conv_id AND q.turn = s.turn) AS n_quotes,
  coalesce(l.n_linked, 0) AS n_linked, s.text, '<|' || s.role || '|>' || chr(10) || s.text || chr(10) AS formatted
FROM said s JOIN tops t USING (conv_id, turn) LEFT JOIN linked l USING (conv_id, turn)""")
def op7_quotation_linking(spark, folder):
    """The turns carry no quotes, so each is first written as a mail that quotes the two turns before it."""
    return chat.conversations(chat.quoting_messages(table(spark, folder, "conversations")))


@query("op8_content_sort", r"""WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM n""")
def op8_content_sort(spark, folder):
    return exact_dedup.content_sort(table(spark, folder, "documents"))


@query("op9_visible_text")
def op9_visible_text(spark, folder):
    found = html_text.extract(table(spark, folder, "pages"))
    return found.withColumns({"n_chars": F.length("text").cast("long"), "text_sha256": F.sha2("text", 256)})


@query("op10_sampled_pieces")
def op10_sampled_pieces(spark, folder):
    return pieces.encode(table(spark, folder, "documents"), public_tokenizers.path(pieces.MODEL))


@query("op11_suffix_dawg_repair")
def op11_suffix_dawg_repair(spark, folder):
    return repair.audited(table(spark, folder, "conversations"))


@query("op12_lattice_near_dedup", r"""WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fit AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM vectors v JOIN least_id l ON l.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id""")
def op12_lattice_near_dedup(spark, folder):
    return lattice_dedup.near_vectors(table(spark, folder, "embeddings"))


@query("op13_chebyshev_whitening")
def op13_chebyshev_whitening(spark, folder):
    return whitening.long_rows(whitening.whiten(table(spark, folder, "embeddings")))
