"""Queries on learned sentence boundaries, over the documents with abbreviations planted before names and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.operators import sentences as S
from dialectry.plans.registry import documents, query
from dialectry.sources.scratch import stored

PLANTED = {" le ": " st. Gran ", " the ": " mn. Alba ", " der ": " cap. 3 ", " un ": " p.ex. ", " of ": " B. Olm "}


def planted(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    for word, put in PLANTED.items():
        text = F.replace(text, F.lit(word), F.lit(put))
    return documents(spark, d).select("doc_id", text.alias("text"))


def _core(x: str) -> str:
    return rf"regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"


def _type(x: str) -> str:
    bare = f"lower(rtrim({_core(x)}, '.'))"
    return rf"CASE WHEN regexp_full_match({bare}, '\p{{N}}[\p{{N}}.,]*') THEN '##' WHEN {bare} <> '' THEN {bare} END"


def _period(x: str) -> str:
    return rf"regexp_matches({_core(x)}, '[^.]\.$')"


_CLOSING = "[\"''»”’)\\]]*"


def _ending(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '[!?]{_CLOSING}$') THEN 'strong' WHEN regexp_matches({x}, '(?:…|\.\.){_CLOSING}$') THEN 'ellipsis' WHEN regexp_matches({x}, '\.{_CLOSING}$') THEN 'period' END"


def _binomial(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} <= 0 THEN 0 ELSE {k} * ln({p}) END + CASE WHEN {n} - {k} <= 0 THEN 0 ELSE ({n} - {k}) * ln(1 - ({p})) END)"


def _gain(n1: str, n2: str, n12: str, n: str) -> str:
    p, p1, p2 = f"{n2} / {n}", f"{n12} / {n1}", f"({n2} - {n12}) / ({n} - {n1})"
    rest, others = f"({n2} - {n12})", f"({n} - {n1})"
    return f"CASE WHEN {n} > {n1} AND {p1} > {p} THEN 2 * ({_binomial(n12, n1, p1)} + {_binomial(rest, others, p2)} - {_binomial(n12, n1, p)} - {_binomial(rest, others, p)}) ELSE 0 END"


_TEXT = "text"
for _word, _put in PLANTED.items():
    _TEXT = f"replace({_TEXT}, '{_word}', '{_put}')"
TOKENS = rf"""d AS (SELECT doc_id, {_TEXT} AS text FROM documents
), ls AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d
), ln AS (SELECT doc_id, i AS ln, ls[i] AS line FROM ls, unnest(range(1, len(ls) + 1)) AS x(i)
), ts AS (SELECT list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS ts FROM ln
), tok AS (SELECT ts[i] AS token, CASE WHEN i > 1 AND regexp_matches(ts[i - 1], '[.!?…"''»”’)\]]$') THEN ts[i - 1] END AS prev, i > 1 AS inside FROM ts, unnest(range(1, len(ts) + 1)) AS x(i)
)"""
TYPES = f"""{TOKENS}, ty AS (SELECT {_type("token")} AS type, {_period("token")} AS p FROM tok
), types AS (SELECT type, count(*) FILTER (WHERE p) AS n_period, count(*) FILTER (WHERE NOT p) AS n_plain FROM ty WHERE type IS NOT NULL GROUP BY 1)"""
_N = "(n_period + n_plain)"
_LETTERS = "(length(type) - (length(type) - length(replace(type, '.', ''))))"
SHORT = rf"""{TYPES}, tt AS (SELECT sum({_N})::DOUBLE AS total, sum(n_period)::DOUBLE AS periods FROM types
), scored AS (
  SELECT type, 2 * ({_binomial("n_period", _N, "0.99")} - {_binomial("n_period", _N, "periods / total")}) * exp(-{_LETTERS}) * (length(type) - {_LETTERS} + 1) * pow({_LETTERS}::DOUBLE, -n_plain) AS score
  FROM types, tt WHERE n_period > 0 AND regexp_matches(type, '\p{{L}}')
), short AS (SELECT type, score FROM scored WHERE score >= 0.3)"""
ORTHOGRAPHY = rf"""{SHORT}, cx AS (
  SELECT {_type("token")} AS type, CASE WHEN {_period("prev")} THEN {_type("prev")} END AS lft, {_ending("prev")} AS e, inside, regexp_matches({_core("token")}, '^\p{{Lu}}') AS upper, regexp_matches({_core("token")}, '^\p{{Ll}}') AS lower FROM tok
), cu AS (SELECT cx.*, coalesce(short.type IS NOT NULL OR e = 'ellipsis' OR regexp_full_match(lft, '\p{{L}}') OR lft = '##', false) AS unsure FROM cx LEFT JOIN short ON lft = short.type WHERE cx.type IS NOT NULL
), cp AS (SELECT *, CASE WHEN NOT inside THEN 'begin' WHEN unsure THEN NULL WHEN e IS NOT NULL THEN 'begin' ELSE 'mid' END AS place FROM cu
), o AS (
  SELECT type, count(*) AS n, count(*) FILTER (WHERE upper) AS n_upper, count(*) FILTER (WHERE lower) AS n_lower, count(*) FILTER (WHERE upper AND place = 'mid') AS n_upper_mid, count(*) FILTER (WHERE lower AND place = 'begin') AS n_lower_begin,
    count(*) FILTER (WHERE place = 'begin' AND inside) AS n_start FROM cp GROUP BY 1
), os AS (SELECT sum(n)::DOUBLE AS total, sum(n_start)::DOUBLE AS starts FROM o
), ortho AS (SELECT o.*, n_start > 0 AND {_gain("starts", "n", "n_start", "total")} >= 30 AS starter FROM o, os)"""
PAIRS = f"""{ORTHOGRAPHY}, l12 AS (SELECT lft, type, count(*) AS n12 FROM cp WHERE lft IS NOT NULL AND unsure GROUP BY ALL
), l1 AS (SELECT lft, sum(n12)::DOUBLE AS n1 FROM l12 GROUP BY 1
), pairs AS (SELECT lft, l12.type FROM l12 JOIN l1 USING (lft) JOIN o ON o.type = l12.type, os WHERE n12 > 1 AND {_gain("n1", "n", "n12", "total")} >= 7.88)"""
SENTENCES = rf"""{PAIRS}, ps AS (SELECT doc_id, ln, string_split(regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[^\S\n]+', ' ', 'g'), '([.!?…]["''»”’)\]]{{0,3}}) ', '\1' || chr(2), 'g'), chr(2)) AS ps FROM ln
), pc AS (SELECT doc_id, ln, k, ps[k] AS piece, CASE WHEN k < len(ps) THEN regexp_extract(ps[k + 1], '^\s*(\S+)', 1) END AS r, regexp_extract(ps[k], '(\S+)\s*$', 1) AS l FROM ps, unnest(range(1, len(ps) + 1)) AS x(k)
), pt AS (
  SELECT doc_id, ln, k, piece, {_ending("l")} AS e, CASE WHEN {_period("l")} THEN {_type("l")} END AS lft, {_type("r")} AS rgt, coalesce(regexp_matches({_core("r")}, '^\p{{Lu}}'), false) AS upper, coalesce(regexp_matches({_core("r")}, '^\p{{Ll}}'), false) AS lower,
    coalesce(({_type("r")}) IS NULL AND r <> '', false) AS mark, coalesce(r = '', true) AS fin FROM pc
), pj AS (
  SELECT pt.*, short.type IS NOT NULL AS sh, coalesce(regexp_full_match(lft, '\p{{L}}'), false) AS ini, coalesce(lft = '##', false) AS num FROM pt LEFT JOIN short ON lft = short.type
), pk AS (
  SELECT pj.*, coalesce(n_upper, 0) AS nu, coalesce(n_lower, 0) AS nl, coalesce(n_upper_mid, 0) AS nm, coalesce(n_lower_begin, 0) AS nb, coalesce(starter, false) AS st, pairs.lft IS NOT NULL AS pair
  FROM pj LEFT JOIN ortho ON rgt = ortho.type AND NOT fin AND (sh OR ini OR num OR e = 'ellipsis') LEFT JOIN pairs ON pj.lft = pairs.lft AND rgt = pairs.type
), pb AS (SELECT *, upper AND nl > 0 AND nm = 0 AS begins, mark OR (lower AND (nu > 0 OR nb = 0)) AS goes FROM pk
), cut AS (
  SELECT doc_id, ln, k, piece, fin OR CASE WHEN e = 'strong' THEN true WHEN sh OR e = 'ellipsis' THEN NOT pair AND (begins OR (upper AND st)) AND NOT goes WHEN ini OR num THEN NOT pair AND NOT goes AND NOT (ini AND upper AND nl = 0 AND NOT begins) ELSE true END AS cut FROM pb
), sn AS (SELECT *, coalesce(count(*) FILTER (WHERE cut) OVER (PARTITION BY doc_id ORDER BY ln, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cut
), whole AS (SELECT doc_id, s, string_agg(piece, ' ' ORDER BY ln, k) AS segment FROM sn GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS pos, regexp_replace(regexp_replace(segment, '^\s+|\s+$', '', 'g'), '[^\S\n]+', ' ', 'g') AS segment FROM whole WHERE regexp_matches(segment, '(?s)\p{{L}}.*\p{{L}}')"""


@query(f"WITH {TYPES} SELECT type, n_period, n_plain FROM types")
def sentence_types(spark, d):
    return S.type_counts(S.tokens(planted(spark, d)))


@query(f"WITH {SHORT} SELECT type, round(score, 6) AS score FROM short")
def sentence_abbreviations(spark, d):
    counts = stored(S.type_counts(S.token_counts(planted(spark, d))), "types")
    return S.abbreviations(counts).select("type", F.round("score", 6).alias("score"))


@query(f"WITH {ORTHOGRAPHY} SELECT type, n, n_upper, n_lower, n_upper_mid, n_lower_begin, n_start, starter FROM ortho")
def sentence_orthography(spark, d):
    words = stored(S.tokens(planted(spark, d)), "tokens")
    short = stored(S.abbreviations(stored(S.type_counts(words), "types")), "abbreviations")
    return S.orthography(S.contexts(words, short))


@query(f"WITH {PAIRS} SELECT lft AS left_type, type FROM pairs")
def sentence_collocations(spark, d):
    return S.learn(planted(spark, d)).collocations.select(F.col("left").alias("left_type"), "type")


@query(f"WITH {SENTENCES}")
def learned_segments(spark, d):
    docs = planted(spark, d)
    return S.sentences(docs, S.learn(docs))
