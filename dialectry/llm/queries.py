"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialectry.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dialectry.llm.packing import pack, with_digest

    return with_digest(pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.sharding import shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"), shards=16)


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.ngram_join import linked_components

    return linked_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


ORACLE["op10_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) m USING (doc_id)
"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that loses a repeated passage: what is left of its text, and what went."""
    from pyspark.sql import functions as F

    from dialectry.llm.substring_dedup import deduplicated

    out = deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), unit="clause", least=32, changed_only=True)
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "text", spans.alias("removed_spans"), removed.alias("removed_chars"), F.element_at("kept_ids", 1).alias("kept_doc_id"))


ORACLE["op3_substring_dedup"] = r"""
WITH t AS (
  SELECT doc_id, text, length(regexp_extract(text, '^[^A-Za-z0-9\x{80}-\x{10FFFF}]*'))::INTEGER AS lead,
    regexp_replace(text, '([A-Za-z0-9\x{80}-\x{10FFFF}]{10,})', '\1' || chr(1), 'g') AS cut FROM documents WHERE text IS NOT NULL
), p AS (SELECT doc_id, lead, regexp_extract_all(substring(cut, lead + 1), '[^\n.,;:!?\x01]*[\n.,;:!?\x01][^A-Za-z0-9\x{80}-\x{10FFFF}]*|[^\n.,;:!?\x01]+$') AS us FROM t
), q AS (SELECT doc_id, lead, i, replace(us[i], chr(1), '') AS unit, regexp_extract_all(lower(us[i]), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM p, unnest(range(1, len(us) + 1)) AS x(i)
), u AS (
  SELECT doc_id, i, ws, lead + sum(length(unit)) OVER w - length(unit) AS a, lead + sum(length(unit)) OVER w AS b, sum(len(ws)) OVER w - len(ws) AS w0, sum(len(ws)) OVER w AS w1
  FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), d AS (SELECT doc_id, flatten(list(ws ORDER BY i)) AS every FROM u GROUP BY 1
), r AS (
  SELECT x.doc_id, x.i AS i, y.i AS j, x.a, md5(array_to_string(d.every[x.w0 + 1:y.w1], ' ')) AS body
  FROM u x ASOF JOIN u y ON x.doc_id = y.doc_id AND x.w0 + 32 <= y.w1 JOIN d ON d.doc_id = x.doc_id
), k AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY body) AS copies, first_value(doc_id) OVER w AS kept FROM r WINDOW w AS (PARTITION BY body ORDER BY doc_id, a)
), m AS (SELECT doc_id, unnest(range(i, j + 1)) AS i, n > 1 AS gone FROM k WHERE copies > 1
), g AS (SELECT doc_id, i FROM m GROUP BY 1, 2 HAVING bool_and(gone)
), s AS (
  SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT u.doc_id, u.a, u.b, u.i - row_number() OVER (PARTITION BY u.doc_id ORDER BY u.i) AS island FROM u JOIN g USING (doc_id, i)) GROUP BY doc_id, island
), e AS (
  SELECT doc_id, string_agg(a || '-' || b, ' ' ORDER BY a) AS removed_spans, sum(b - a)::BIGINT AS removed_chars, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY 1
)
SELECT e.doc_id, e.removed_spans, e.removed_chars, (SELECT min(kept) FROM k WHERE k.doc_id = e.doc_id AND k.copies > 1 AND k.n > 1) AS kept_doc_id,
  array_to_string(list_transform(range(1, len(starts) + 2), lambda x: substring(t.text, (CASE WHEN x = 1 THEN 0 ELSE ends[x - 1] END + 1)::BIGINT, (CASE WHEN x > len(starts) THEN length(t.text) ELSE starts[x] END - CASE WHEN x = 1 THEN 0 ELSE ends[x - 1] END)::BIGINT)), '') AS text
FROM e JOIN t USING (doc_id)
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.decontamination import contained_items

    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


ORACLE["op8_decontamination"] = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY 1)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::BIGINT AS shared, any_value(n.n)::BIGINT AS item_shingles, count(*) / any_value(n.n)::DOUBLE AS containment
FROM s i JOIN s d ON d.g = i.g AND d.kind = 'd' JOIN n ON n.id = i.id
WHERE i.kind = 'i' GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n)
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.language_id import identify

    return identify(read_table(spark, sf_dir, "documents"), per_label=500)


@query
def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from dialectry.llm.permutation_index import nearest

    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.html_extraction import extract

    return extract(read_table(spark, sf_dir, "pages"))


ORACLE["op9_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(body, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a
)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS text, length(coalesce(array_to_string(blocks, chr(10) || chr(10)), ''))::BIGINT AS n_chars FROM b
"""


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.license_scan import document_paths, scan

    return scan(document_paths(read_table(spark, sf_dir, "documents")), threshold=0.6)


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.secret_scan import findings

    return findings(read_table(spark, sf_dir, "documents"), threshold=0.5)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"), least=7, every=31, least_n=2, times=10)


#: The CRC-32 of one byte: eight shifts.
_CRC_BITS = "list_reduce(list_prepend({0}, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
ORACLE["op11_spelling_variants"] = rf"""
WITH RECURSIVE bytes AS (SELECT b::BIGINT AS b, {_CRC_BITS.format("b::BIGINT")} AS t FROM range(256) r(b)
), tab AS (SELECT list(t ORDER BY b) AS ts FROM bytes
), runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), d AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL
), x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM d
), h AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::INTEGER, 2))::BIGINT)), lambda c, b: xor(c >> 8, ts[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, tab
), n AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1
), v AS (SELECT word, n FROM n WHERE length(word) >= 7 AND n >= 2
), c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1))::BIGINT AS i FROM v)
), p AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.cut UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.cut
), g AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM p GROUP BY 1
), f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN g USING (word)
), r AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, t.root, n, n_near, form_n FROM f JOIN (SELECT word, last(root ORDER BY k) AS root FROM r GROUP BY 1) t USING (word)
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialectry.llm.fill_in_middle import fill_in_middle, with_digests

    return with_digests(fill_in_middle(read_table(spark, sf_dir, "documents"), seed=1, moved_percent=90, spm_percent=20))


ORACLE["op12_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents
), g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), c AS (SELECT *, left(text, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dialectry.llm.pieces import decoded, encoded, with_digests

    path = public_tokenizers.path("piece_bpe_32k.model")
    return with_digests(decoded(encoded(read_table(spark, sf_dir, "documents"), path), path))
