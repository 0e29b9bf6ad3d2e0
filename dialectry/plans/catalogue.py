"""Named queries over the driver tables and their DuckDB oracles.

Stand-ins: documents play labelled texts (lang as variety), events play contributions, customers with
their nations play users. Each query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.functions import labels as L
from dialectry.functions import text as X
from dialectry.functions.lexicon import Lexicon
from dialectry.functions.lexicon import lexicon_tokens as lexicon_tokens_of
from dialectry.operators import analytics as A
from dialectry.operators import contributions as C
from dialectry.operators import enrich as E
from dialectry.operators import features as V
from dialectry.operators import metrics as M
from dialectry.operators import quantiles as Q
from dialectry.operators import split as P
from dialectry.plans import boundaries, histories, learning, roundtrips  # noqa: F401
from dialectry.plans.registry import ORACLE, QUERIES, documents, query, table


def samples(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("dialect"), F.size(F.split("text", "\n")).cast("long").alias("units"))


def contributions(spark: SparkSession, d: str) -> DataFrame:
    """Events as contributions, a hundred to a page; a user number divisible by 7 plays an address."""
    e = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 100).alias("page_id"), F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.col("user_id").cast("string").alias("contributor_id"), "ts", "event_id", F.floor("value").cast("long").alias("len_bytes")
    )
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("ts", "event_id")) - 1
    return C.with_diff(e.withColumn("pos_revision", pos))


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users: nation as variety, a negative balance for a bot, level from the key."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    level = F.try_element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ["0", "1", "2", "3", "4", "5", "N"]), F.lit(None).cast("string")), (F.col("c_custkey") % 9 + 1).cast("int"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), F.lower("n_name").alias("dialect"), (F.col("c_acctbal") < 0).cast("int").alias("is_bot"), level.alias("oc_level"))


def edited(spark: SparkSession, d: str) -> DataFrame:
    return C.with_users(contributions(spark, d), people(spark, d))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Reference labels and a rule's predictions, one of them outside the references."""
    rule = F.when(F.col("text").rlike("[äöüß]"), "de").when(F.col("text").rlike("[ñ¿]"), "es").when(F.col("text").rlike("[êèç]"), "fr").when(F.col("doc_id") % 11 == 0, "xx").otherwise("en")
    return documents(spark, d).select("doc_id", F.col("lang").alias("ref"), rule.alias("pred"), "source")


CONTRIB = """c AS (
  SELECT *, len_bytes - lag(len_bytes, 1, 0) OVER (PARTITION BY page_id ORDER BY pos_revision) AS diff_bytes FROM (
    SELECT event_id // 100 AS page_id, CASE WHEN user_id % 7 <> 0 THEN user_id END AS user_id, user_id::VARCHAR AS contributor_id, ts, event_id, floor(value)::BIGINT AS len_bytes,
      (row_number() OVER (PARTITION BY event_id // 100 ORDER BY ts, event_id) - 1)::INTEGER AS pos_revision FROM events)
)"""
USERS = """u AS (
  SELECT c_custkey AS id, lower(n_name) AS dialect, (c_acctbal < 0)::INTEGER AS is_bot,
    (CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 7 THEN 'N' WHEN 8 THEN NULL ELSE (c_custkey % 9 - 1)::VARCHAR END) AS oc_level
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""
JOINED = f"{CONTRIB}, {USERS}, j AS (SELECT c.*, u.dialect, u.is_bot, u.oc_level FROM c LEFT JOIN u ON c.user_id = u.id)"
LEVEL = "list_position(['NULL', '0', '1', '2', '3', '4', '5', 'N'], oc_level)"
ANCHORED = f"""{JOINED}, a AS (SELECT *, max(pos_revision) FILTER (WHERE len_bytes >= 100) OVER (PARTITION BY page_id) AS p FROM j
), l AS (
  SELECT page_id, max(oc_level) FILTER (WHERE pos_revision = p) AS oc_level_first,
    ['NULL', '0', '1', '2', '3', '4', '5', 'N'][max({LEVEL}) FILTER (WHERE pos_revision <= p AND len_bytes >= 1)] AS oc_level_max,
    coalesce(max(is_bot) FILTER (WHERE pos_revision = p), 0)::INTEGER AS bot_first_author FROM a GROUP BY page_id
)"""
HALF = "greatest(1, round_even(abs(diff_bytes) / 2.0, 0))::BIGINT"
PUNCT = r"^[\p{P}$+<=>^`|~]+$"
TOKENS = rf"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[\p{{P}}$+<=>^`|~]+')))"
W = r"[\p{L}\p{N}\p{M}_]"
PRED = "p AS (SELECT doc_id, lang AS ref, CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñ¿]') THEN 'es' WHEN regexp_matches(text, '[êèç]') THEN 'fr' WHEN doc_id % 11 = 0 THEN 'xx' ELSE 'en' END AS pred, source FROM documents)"


# -- distributions ---------------------------------------------------------------------------------


@query(f"SELECT lang AS dialect, count(*) AS n_texts, sum({TOKENS})::BIGINT AS n_tokens FROM documents GROUP BY 1")
def dialect_distribution(spark, d):
    return A.distribution(documents(spark, d).select(F.col("lang").alias("dialect"), "text"))


@query(f"SELECT count(*) AS count, avg(n) AS mean, stddev_samp(n) AS std, min(n)::BIGINT AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n)::BIGINT AS max FROM (SELECT {TOKENS} AS n FROM documents)")
def token_count_describe(spark, d):
    return A.describe(documents(spark, d).select(X.token_count(F.col("text")).alias("n")), "n")


@query("SELECT count(*) AS count, avg(y) AS mean, stddev_samp(y) AS std, min(y)::INTEGER AS min, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.75) AS q75, max(y)::INTEGER AS max FROM (SELECT year(o_orderdate) AS y FROM orders)")
def year_span(spark, d):
    return A.describe(table(spark, d, "orders").select(F.year("o_orderdate").alias("y")), "y")


@query(" UNION ALL ".join(f"SELECT lang, {p}::DOUBLE AS prob, quantile_cont(n_chars, {p})::DOUBLE AS quantile FROM documents GROUP BY lang" for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
def text_length_quantiles(spark, d):
    """By histogram refinement."""
    return Q.exact_quantiles(documents(spark, d), "n_chars", [0.05, 0.25, 0.5, 0.75, 0.95], by="lang")


@query(f"WITH {USERS} SELECT oc_level, count(*) AS n FROM u GROUP BY 1")
def value_counts_keep_null(spark, d):
    return A.value_counts(people(spark, d), "oc_level", keep_null=True)


@query(f"WITH {USERS} SELECT oc_level, count(*) / sum(count(*)) OVER () AS share FROM u WHERE oc_level IS NOT NULL GROUP BY 1")
def value_counts_share(spark, d):
    return A.value_counts(people(spark, d), "oc_level", share=True)


@query(f"WITH {USERS} SELECT DISTINCT dialect FROM u")
def distinct_sorted(spark, d):
    return people(spark, d).select("dialect").distinct().orderBy("dialect")


@query("SELECT doc_id AS row_id, lang AS dialect FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k = least(150, n - 1)")
def sample_lookup(spark, d):
    return A.sample_at(samples(spark, d), 150).select("row_id", "dialect")


# -- text functions --------------------------------------------------------------------------------


def text_query(column, sql: str, name: str, base: str = "documents", key: str = "doc_id", source: str = "text") -> None:
    def run(spark, d):
        return table(spark, d, base).select(key, column(F.col(source)).alias("out"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key}, {sql} AS out FROM {base}"


def repeats_sql(x: str) -> str:
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
    for c in alphabet:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}', 'g')"
    return x


def accents_sql(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def stems_sql(x: str, stems: str) -> str:
    return rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])(?i:{stems}){W}*', '\1 ', 'g')"


EMAIL_SQL = rf"{W}[^\s]+@[^\s]+{W}"
text_query(X.mask_urls, r"regexp_replace(url, '(([A-Za-z]{3,9}://|www\.)[A-Za-z0-9.-]+((?:/[-+~%/.\p{L}\p{N}\p{M}_]*)?\??(?:[-+=&;%@.\p{L}\p{N}\p{M}_]*)#?(?:[.!/\p{L}\p{N}\p{M}_]*))?)', '', 'g')", "mask_urls", "pages", "page_id", "url")
text_query(X.mask_emails, f"regexp_replace(text, '{EMAIL_SQL}', '', 'g')", "mask_emails")
text_query(X.strip_accents, accents_sql("text"), "strip_accents_ascii")
text_query(lambda c: X.strip_accents(c, "unicode"), "strip_accents(text)", "strip_accents_unicode")
text_query(lambda c: X.strip_accents(c, "ascii", exact=True), accents_sql("text"), "strip_accents_exact")
text_query(X.collapse_repeats, repeats_sql("text"), "collapse_repeats")
text_query(X.remove_punctuation, r"regexp_replace(text, '[^\p{L}\p{N}\p{M}]', ' ', 'g')", "remove_punct")
text_query(lambda c: X.remove_punctuation(c, "punct"), r"regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g')", "remove_punct_ascii")
text_query(lambda c: X.remove_punctuation(c, "keep_apos"), r"regexp_replace(text, '[!-&(-/:-@\[-`{-~]', ' ', 'g')", "remove_punct_keep_apos")
text_query(X.mask_numbers, r"regexp_replace(text, '\d+', ' ', 'g')", "mask_numbers")
text_query(F.lower, "lower(text)", "lower_text")
text_query(
    lambda c: X.remove_stop_stems(F.replace(F.replace(F.replace(c, F.lit("th"), F.lit("Occitan")), F.lit("que"), F.lit("lenga")), F.lit("ch"), F.lit("niçois"))),
    stems_sql("replace(replace(replace(text, 'th', 'Occitan'), 'que', 'lenga'), 'ch', 'niçois')", "|".join(sorted(X.DEFAULT_STOP_STEMS, key=len, reverse=True))),
    "stopword_prefix",
)
text_query(
    lambda c: X.preprocess(c, lowercase=True, accents="ascii", punctuation=True, repeats=True, urls="remove", emails="remove", numbers="remove", stems=["the", "que"]),
    stems_sql("lower(regexp_replace(regexp_replace(" + repeats_sql(accents_sql(f"regexp_replace(text, '{EMAIL_SQL}', '', 'g')")) + r", '[^\p{L}\p{N}\p{M}]', ' ', 'g'), '\d+', ' ', 'g'))", "the|que"),
    "preprocess_full",
)
text_query(X.normalise_spaces, r"regexp_replace(text, '\s+', ' ', 'g')", "whitespace_normalise")
text_query(lambda c: L.fasttext_line(F.col("lang"), X.normalise_spaces(c)), r"'__label__' || lang || ' ' || regexp_replace(text, '\s+', ' ', 'g')", "fasttext_lines")
BLANK_LINES = "replace(text, chr(10), chr(10) || ' ' || chr(10))"
text_query(lambda c: F.array_join(X.paragraphs(F.replace(c, F.lit("\n"), F.lit("\n \n"))), "¶"), f"array_to_string({histories.PARAGRAPHS.format(BLANK_LINES)}, '¶')", "paragraph_split")
text_query(X.has_letters, r"len(regexp_extract_all(text, '\p{L}')) >= 2", "has_letters")
text_query(X.slug, r"trim(regexp_replace(lower(" + accents_sql("replace(replace(text, '''', '-'), '’', '-')") + r"), '[^a-z0-9]+', '-', 'g'), '-')", "slug")
text_query(lambda c: F.array_join(X.preprocess_tokens(F.split(c, " "), True, "ascii"), "|"), "replace(lower(" + accents_sql("text") + "), ' ', '|')", "preprocess_tokens")
text_query(X.visible_chars, "replace(text, ' ', '∅')", "visible_chars")


# initials keep their blank under another mark (twice, since two of them share one), then every other sentence end is cut
INITIAL = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])(\p{{Lu}}\.)\s+', '\1\2' || chr(2), 'g')"
SENTENCES = r"string_split(regexp_replace({0}, '([.!?…])\s+([\p{{Lu}}\p{{N}}«“\"''(\[¿¡-])', '\1' || chr(1) || '\2', 'g'), chr(1))"
SEGMENTS = "flatten(list_transform(string_split(text, chr(10)), lambda l: " + SENTENCES.format(INITIAL.format(INITIAL.format("l"))) + "))"


@query(rf"SELECT doc_id, (i - 1)::INTEGER AS pos, {histories.TIDY.format("replace(s, chr(2), ' ')")} AS segment FROM (SELECT doc_id, list_filter({SEGMENTS}, lambda x: regexp_matches(x, '(?s)\p{{L}}.*\p{{L}}')) AS ss FROM documents), unnest(ss) WITH ORDINALITY AS t(s, i)")
def segment_split(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.segments(F.col("text"))).alias("pos", "segment"))


WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}]+[''’]?|\p{N}+|[^\s\p{L}\p{M}\p{N}]')"


@query(f"SELECT doc_id, array_to_string({WORDS}, ' ') AS tokens FROM documents")
def word_tokens(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


BARE_WORDS = WORDS.replace("(text,", "(translate(text, '''’', '  '),")


@query(f"""WITH w AS (SELECT doc_id, list_transform({BARE_WORDS}, lambda x: lower(x)) AS t FROM documents),
n AS (SELECT doc_id, len(t) AS n_words, len(list_filter(range(1, len(t)), lambda i: (t[i] = 'of' AND t[i + 1] = 'the') OR (t[i] = 'de' AND t[i + 1] = 'la'))) AS n_units,
  len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the' AND t[i + 2] = 'and')) AS n_long FROM w)
SELECT doc_id, n_words - n_units - n_long AS n_tokens, n_units, n_long FROM n WHERE n_words IS NOT NULL""")
def lexicon_tokens(spark, d):
    """Tokens of each document, and those that are units of two or three words; a unit that begins another gives way to it."""
    tokens = lexicon_tokens_of(F.translate("text", "'’", "  "), Lexicon(("of the", "of the and", "de la")))
    unit = lambda words: F.size(F.filter("t", lambda x: F.size(F.split(x, r"(?U)\s+")) >= words)).cast("long")
    return documents(spark, d).select("doc_id", tokens.alias("t")).where("t IS NOT NULL").select("doc_id", F.size("t").cast("long").alias("n_tokens"), unit(2).alias("n_units"), unit(3).alias("n_long"))


@query(f"SELECT doc_id FROM documents WHERE len({WORDS}) > 3")
def long_enough(spark, d):
    return documents(spark, d).where(X.long_enough(F.col("text"))).select("doc_id")


VARIETY = "CASE doc_id % 6 WHEN 0 THEN 'Gascon' WHEN 1 THEN 'VivaroAlpenc' WHEN 2 THEN 'LENGADOCIAN' WHEN 3 THEN 'provençau' END"


@query(f"SELECT doc_id, replace(lower({VARIETY}), 'vivaroalpenc', 'vivaroaupenc') AS tag FROM documents")
def tag_extract(spark, d):
    """The first tag of a page, somewhere in its text; a wrong template and a missing one give none."""
    k = F.col("doc_id") % 6
    name = F.when(k == 0, "Gascon").when(k == 1, "VivaroAlpenc").when(k == 2, "LENGADOCIAN").when(k == 3, "provençau")
    tagged = F.concat(F.col("text"), F.lit(" {{Dialècte "), name, F.lit("}}\n{{Dialècte lemosin}} "), F.col("text"))
    page = F.coalesce(tagged, F.when(k == 4, F.concat(F.lit("{{dialècte gascon}} "), F.col("text"))), F.col("text"))
    return documents(spark, d).select("doc_id", X.variety_tag(page).alias("tag"))


@query("SELECT c_custkey, (instr(lower(c_name), 'bot') > 0 OR c_custkey % 10 = 3)::INTEGER AS bot FROM customer")
def bot_detect(spark, d):
    page = F.when(F.col("c_custkey") % 10 == 3, F.lit("{{Boita d'utilizaire|bòt}}"))
    return table(spark, d, "customer").select("c_custkey", X.is_bot(F.col("c_name"), page).cast("int").alias("bot"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1) THEN (c_custkey % 5)::VARCHAR WHEN c_custkey % 6 = 2 THEN 'N' WHEN c_custkey % 6 = 3 THEN (c_custkey % 4)::VARCHAR WHEN c_custkey % 6 = 4 THEN 'M' END AS level,
  CASE WHEN c_custkey % 6 = 4 THEN lower(c_mktsegment) END AS variety FROM customer""")
def user_page_templates(spark, d):
    """Templates with the customer's own values between lines of other text."""
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    k = key % 6
    page = (
        F.when(k == 0, F.concat(F.lit("{{Babel|fr|OC-"), text(key % 5), F.lit("|en-2}}")))
        .when(k == 1, F.concat(F.lit("{{#Babel: es-1|oc-"), text(key % 5), F.lit("\n|de-3}}")))
        .when(k == 2, F.concat(F.lit("{{Boita d'utilizaire|"), F.lower("c_mktsegment"), F.lit("|oc}}")))
        .when(k == 3, F.concat(F.lit("{{Utilizaire oc-"), text(key % 4), F.lit("}}")))
        .when(k == 4, F.concat(F.lit("{{Boita Babel|oc-M|Wikipedian "), F.lower("c_mktsegment"), F.lit("| es-3}}")))
        .otherwise(F.concat(F.lit("{{Utilizaire es-"), text(key % 4), F.lit("}}")))
    )
    whole = F.concat(F.lower("c_name"), F.lit("\n"), page, F.lit("\n"), F.lower("c_name"))
    return table(spark, d, "customer").select("c_custkey", X.declared_level(whole).alias("level"), X.declared_variety(whole).alias("variety"))


@query("SELECT o_orderkey, split_part(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'T', 1) AS day FROM orders")
def date_truncate(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.date_part(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


# -- labels ----------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN 'gas' WHEN 'es' THEN 'ara' END AS label FROM documents")
def label_map_null(spark, d):
    return documents(spark, d).select("doc_id", L.map_label(F.col("lang"), {"fr": "gas", "es": "ara"}, "null").alias("label"))


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN 'gas' WHEN 'es' THEN 'ara' ELSE lang END AS label FROM documents")
def label_map_passthrough(spark, d):
    return documents(spark, d).select("doc_id", L.map_label(F.col("lang"), {"fr": "gas", "es": "ara"}, "passthrough").alias("label"))


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN 'gas' WHEN 'es' THEN 'ara' WHEN 'de' THEN 'lim' WHEN 'en' THEN 'lan' END AS label FROM documents")
def label_map_error(spark, d):
    return documents(spark, d).select("doc_id", L.map_label(F.col("lang"), {"fr": "gas", "es": "ara", "de": "lim", "en": "lan"}, "error").alias("label"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'wiki' WHEN 1 THEN 'wiki' WHEN 2 THEN 'congres' WHEN 3 THEN 'forum' END AS source FROM documents")
def source_detect(spark, d):
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "x/wiki-train.csv").when(k == 1, "concatnowiki_dev.csv").when(k == 2, "wiki/congres-test.csv").when(k == 3, "forum.csv").otherwise("other.csv")
    return documents(spark, d).select("doc_id", L.detect_source(name).alias("source"))


@query("SELECT doc_id, lang AS label FROM documents")
def congres_label(spark, d):
    return documents(spark, d).select("doc_id", L.spelling_free_label(F.concat(F.lit("OC-"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "-grclass").otherwise("-grmistr"))).alias("label"))


@query("SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS label_id FROM (SELECT DISTINCT lang FROM documents)")
def label_index(spark, d):
    return L.label_index(documents(spark, d), "lang")


@query("SELECT label, row_number() OVER (ORDER BY label NOT IN ('fr', 'zz'), label) - 1 AS label_id FROM (SELECT DISTINCT lang AS label FROM documents UNION SELECT 'zz' UNION SELECT 'fr')")
def label_index_known(spark, d):
    """Known labels keep the first numbers, one of them without a text."""
    return L.label_index(documents(spark, d), "lang", ["zz", "fr"])


@query("SELECT 'dim300_epoc20_loss-hs' AS name".replace("loss-hs", "losshs"))
def config_name(spark, d):
    return spark.range(1).select(F.lit(X.config_name({"loss": "hs", "epoch": 20, "dim": 300})).alias("name"))


# -- splitting -------------------------------------------------------------------------------------

SPLIT = """d AS (
  SELECT doc_id AS row_id, text, lang AS dialect, len(string_split(text, chr(10))) AS units FROM documents
), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text, dialect ORDER BY row_id) AS k FROM d) WHERE k = 1
), x AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM f) WHERE n = 1)"""


def balanced_sql(name: str, rows: str, units: str, n: str | None = None) -> str:
    return f"""{name}_cap AS (SELECT dialect, CASE WHEN n <= 10 THEN n ELSE least(round_even(n * 0.5, 0), 500) END AS cap FROM (SELECT dialect, sum({units}) AS n FROM {rows} GROUP BY 1)
), {name}_c AS (SELECT r.*, cap FROM (SELECT *, {units} AS un, row_number() OVER w AS r, sum({units}) OVER (w ROWS UNBOUNDED PRECEDING) - {units} AS b FROM {rows} WHERE {units} > 0 WINDOW w AS (PARTITION BY dialect ORDER BY row_id)) r JOIN {name}_cap USING (dialect) WHERE b < cap
), {name} AS (SELECT * FROM (SELECT *, sum(un) OVER (ORDER BY r, dialect ROWS UNBOUNDED PRECEDING) - un AS g FROM {name}_c) WHERE g < {n or f"(SELECT sum(cap) FROM {name}_cap)"})"""


@query(f"WITH {SPLIT} SELECT row_id, dialect FROM f")
def dedup_keep_first(spark, d):
    return P.keep_first(samples(spark, d), ["text", "dialect"]).select("row_id", "dialect")


@query(f"WITH {SPLIT} SELECT row_id, dialect FROM x")
def dedup_keep_none(spark, d):
    return P.deduplicate(samples(spark, d)).select("row_id", "dialect")


@query("SELECT lang AS dialect, count(*) AS count, (CASE WHEN count(*) <= 10 THEN count(*) ELSE least(round_even(count(*) * 0.5, 0), 500) END)::BIGINT AS cap FROM documents GROUP BY 1")
def class_caps(spark, d):
    return P.class_caps(samples(spark, d))


@query("SELECT doc_id AS row_id, count(*) OVER (PARTITION BY lang) / count(*) OVER () AS weight FROM documents")
def class_weights(spark, d):
    return P.class_weights(samples(spark, d)).select("row_id", "weight")


@query(f"WITH {SPLIT}, {balanced_sql('t', 'x', '1')} SELECT row_id, dialect FROM t")
def balanced_test(spark, d):
    return P.select_balanced(P.deduplicate(samples(spark, d))).select("row_id", "dialect")


@query(f"WITH {SPLIT}, {balanced_sql('t', 'x', 'units')} SELECT row_id, dialect, units::BIGINT AS units FROM t")
def balanced_units(spark, d):
    return P.select_balanced(P.deduplicate(samples(spark, d)), units="units").select("row_id", "dialect", "units")


@query(f"WITH {SPLIT}, {balanced_sql('t', 'x', '1')}, y AS (SELECT * FROM x ANTI JOIN t USING (row_id)), {balanced_sql('v', 'y', '1')} SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM t) THEN 'test' WHEN row_id IN (SELECT row_id FROM v) THEN 'dev' ELSE 'train' END AS split FROM x")
def split_assign(spark, d):
    return P.train_dev_test(samples(spark, d)).select("row_id", "split")


SIZED = f"WITH {SPLIT}, {balanced_sql('t', 'x', '1', '(SELECT round_even(count(*) * 0.1, 0) FROM x)')}, y AS (SELECT * FROM x ANTI JOIN t USING (row_id)), {balanced_sql('v', 'y', '1', '17')}"


@query(f"{SIZED} SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM t) THEN 'test' WHEN row_id IN (SELECT row_id FROM v) THEN 'dev' ELSE 'train' END AS split FROM x")
def split_sizes(spark, d):
    """A tenth of the rows for the test, 17 rows for development."""
    return P.train_dev_test(samples(spark, d), test_size=0.1, dev_size=17).select("row_id", "split")


@query(f"WITH {SPLIT}, {balanced_sql('t', 'x', '1').replace(', 500)', ', 100000000)')} SELECT row_id, dialect FROM t")
def balanced_uncapped(spark, d):
    """Half of each class, whatever its size."""
    return P.select_balanced(P.deduplicate(samples(spark, d)), limits={"most": None}).select("row_id", "dialect")


@query("""SELECT row_id, dialect FROM (SELECT doc_id AS row_id, lang AS dialect, count(*) OVER (PARTITION BY lang) / count(*) OVER () AS weight, (('0x' || substr(md5('1:' || doc_id), 1, 10))::BIGINT + 1) / 1099511627777.0::DOUBLE AS u FROM documents)
ORDER BY -ln(u) / weight, row_id LIMIT 100""")
def stratified_sample(spark, d):
    return P.select_weighted(samples(spark, d), 100).select("row_id", "dialect")


# -- contributions ---------------------------------------------------------------------------------


@query(f"WITH {CONTRIB} SELECT page_id, pos_revision, len_bytes, diff_bytes FROM c")
def revision_diff(spark, d):
    return contributions(spark, d).select("page_id", "pos_revision", "len_bytes", "diff_bytes")


@query(f"WITH {CONTRIB} SELECT page_id, contributor_id, sum(CASE WHEN diff_bytes > 0 THEN diff_bytes ELSE {HALF} END)::BIGINT AS size, count(*) AS n FROM c GROUP BY ALL")
def weighted_contrib(spark, d):
    return contributions(spark, d).groupBy("page_id", "contributor_id").agg(F.sum(C.contribution_weight(F.col("diff_bytes"))).alias("size"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CONTRIB} SELECT page_id, pos_revision, contributor_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos_revision DESC) AS rank FROM c) WHERE rank <= 3")
def newest_contributions(spark, d):
    return C.ordered(contributions(spark, d), n=3).select("page_id", "pos_revision", "contributor_id", "rank")


@query(f"""WITH {CONTRIB}, g AS (SELECT page_id, contributor_id, count(*) AS n, sum(CASE WHEN diff_bytes > 0 THEN diff_bytes ELSE {HALF} END) AS s, min(pos_revision) AS f FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) AS rn, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, f) AS rs FROM g)
SELECT page_id, max(contributor_id) FILTER (WHERE rn = 1) AS user_most_contrib_id, max(contributor_id) FILTER (WHERE rs = 1) AS user_biggest_contrib_id, count(*) AS nb_contributors, sum(n)::BIGINT AS nb_revisions FROM r GROUP BY 1""")
def top_contributor(spark, d):
    return C.top_contributors(contributions(spark, d))


@query(f"WITH {ANCHORED} SELECT page_id, oc_level_first, oc_level_max FROM l")
def oc_level_first_max(spark, d):
    return C.level_first_max(edited(spark, d)).drop("bot_first_author")


@query(f"WITH {ANCHORED} SELECT page_id, bot_first_author FROM l")
def bot_first_author(spark, d):
    return C.level_first_max(edited(spark, d)).select("page_id", "bot_first_author")


@query(f"WITH {ANCHORED.replace('max(pos_revision)', 'min(pos_revision)').replace('pos_revision <= p', 'pos_revision >= p')} SELECT page_id, oc_level_first, oc_level_max FROM l")
def oc_level_oldest_first(spark, d):
    return C.level_first_max(edited(spark, d), order="asc").drop("bot_first_author")


@query(f"WITH {JOINED} SELECT page_id, count(*) FILTER (WHERE is_bot = 1) AS bot_nb_revisions FROM j GROUP BY 1")
def bot_nb_revisions(spark, d):
    return C.bot_revisions(edited(spark, d))


@query(f"WITH {JOINED} SELECT page_id, string_agg(DISTINCT dialect, ' ' ORDER BY dialect) AS user_dialects FROM j GROUP BY 1")
def user_dialects(spark, d):
    return C.user_varieties(edited(spark, d))


def ranking_sql(key: str, value: str) -> str:
    return f"WITH {JOINED}, g AS (SELECT page_id, {key}, ({value})::BIGINT AS value, max(pos_revision) AS last FROM j GROUP BY ALL) SELECT page_id, {key}, value, (row_number() OVER (PARTITION BY page_id ORDER BY value DESC, last DESC))::INTEGER AS rank FROM g"


SIZE = f"sum(CASE WHEN diff_bytes < 0 THEN {HALF} ELSE diff_bytes END)"


@query(ranking_sql("user_id", "count(*)"))
def rank_users_freq(spark, d):
    return C.ranking(edited(spark, d), "user_id", "freq")


@query(ranking_sql("user_id", SIZE))
def rank_users_size(spark, d):
    return C.ranking(edited(spark, d), "user_id", "size")


@query(ranking_sql("oc_level", "count(*)"))
def rank_levels_freq(spark, d):
    return C.ranking(edited(spark, d), "oc_level", "freq")


@query(ranking_sql("oc_level", SIZE))
def rank_levels_size(spark, d):
    return C.ranking(edited(spark, d), "oc_level", "size")


@query(f"""WITH r AS ({ranking_sql("oc_level", "count(*)")}) SELECT page_id, '{{' || string_agg('"' || coalesce(oc_level, 'null') || '": ' || value, ', ' ORDER BY rank) || '}}' AS oc_level_rank_freq FROM r GROUP BY 1""")
def rank_json(spark, d):
    return C.ranking_json(C.ranking(edited(spark, d), "oc_level", "freq"), "oc_level", "oc_level_rank_freq")


@query(f"WITH {ANCHORED} SELECT page_id, oc_level_first, oc_level_max FROM l WHERE coalesce(oc_level_max, 'NULL') NOT IN ('0', '1', '2', '3', '4', '5')")
def level_filter(spark, d):
    return C.keep_levels(oc_level_first_max(spark, d), ["NULL", "N"])


# -- analytics -------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey IN (SELECT user_id FROM events)) AS n_true, avg((c_custkey IN (SELECT user_id FROM events))::INTEGER) AS share FROM customer")
def active_users(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    active = A.active_users(c, table(spark, d, "events")).select("id", F.lit(True).alias("active"))
    return A.share_of(c.join(active, "id", "left"), F.col("active"))


@query(f"WITH {JOINED} SELECT count(*) AS n, count(*) FILTER (WHERE is_bot = 1) AS n_bot, count(*) FILTER (WHERE is_bot = 1) / count(*) AS bot_share FROM j WHERE diff_bytes > 10")
def bot_share_min_diff(spark, d):
    return A.bot_share(contributions(spark, d), people(spark, d), 10)


PAGES_SQL = "m AS (SELECT page_id, string_agg(DISTINCT dialect, ' ' ORDER BY dialect) AS user_dialects FROM j GROUP BY 1), n AS (SELECT page_id, user_dialects, lower(n_name) AS dialect FROM m JOIN nation ON n_nationkey = page_id % 25)"


def _articles(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    pages = user_dialects(spark, d)
    return pages.join(n, n.n_nationkey == F.col("page_id") % 25).select("page_id", "user_dialects", F.lower("n_name").alias("dialect"))


@query(f"WITH {JOINED}, {PAGES_SQL} SELECT dialect, count(*) AS n, count(*) FILTER (WHERE list_contains(string_split(user_dialects, ' '), dialect)) AS n_match, round_even(100.0 * count(*) FILTER (WHERE list_contains(string_split(user_dialects, ' '), dialect)) / count(*), 2)::DOUBLE AS percent, coalesce((SELECT count(*) FROM u WHERE u.dialect = n.dialect), 0) AS n_users FROM n GROUP BY dialect")
def user_dialect_match(spark, d):
    return A.variety_match(_articles(spark, d), people(spark, d))


@query(f"WITH {ANCHORED} SELECT coalesce(a.level, b.level) AS level, coalesce(n_first, 0) AS n_first, coalesce(n_max, 0) AS n_max FROM (SELECT oc_level_first AS level, count(*) AS n_first FROM l WHERE oc_level_first IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT oc_level_max AS level, count(*) AS n_max FROM l WHERE oc_level_max IS NOT NULL GROUP BY 1) b ON a.level = b.level")
def level_counts_outer(spark, d):
    return A.level_counts(C.level_first_max(edited(spark, d)))


NUM = "(CASE WHEN {0} IS NULL THEN 0 WHEN {0} = 'N' THEN 6 ELSE {0}::INTEGER END)"


@query(f"WITH {ANCHORED} SELECT oc_level_first, median({NUM.format('oc_level_max')} - {NUM.format('oc_level_first')})::DOUBLE AS median_diff FROM l GROUP BY 1")
def level_diff_median(spark, d):
    return A.level_gain(C.level_first_max(edited(spark, d)))


@query("SELECT count(*) FILTER (WHERE o_custkey % 3 = 0) AS matches, count(*) FILTER (WHERE o_custkey % 3 = 0 AND o_orderkey % 5 = 0) AS date_mismatches FROM orders")
def timestamp_audit(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_latest"), "o_custkey")
    clean = o.where("o_custkey % 3 = 0").select(F.concat(F.lit("x/ocwiki/"), F.col("id").cast("string")).alias("id"), F.lit("t").alias("text"), F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("date_latest")).alias("date_modified"))
    return E.date_audit(E.with_clean_text(o, E.clean_texts(clean)))


# -- features --------------------------------------------------------------------------------------

TFIDF = """f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), v AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM f, (SELECT count(*) AS n FROM documents) GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.9 * n
), w AS (SELECT doc_id, term, (ln(tf) + 1) * idf AS w FROM f JOIN v USING (term))
SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w"""


@query(rf"WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')) AS term FROM documents), {TFIDF}")
def word_tf_idf(spark, d):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")
    return V.tf_idf(documents(spark, d), V.word_ngrams(words))


WB = r"""t AS (
  SELECT doc_id, unnest(flatten(list_transform([2, 3, 4, 5], lambda n: CASE WHEN length(p) > n THEN list_transform(range(1, length(p) - n + 2), lambda i: substring(p, i, n)) WHEN length(p) = n OR (n = 2 AND length(p) < n) THEN [p] ELSE [] END))) AS term
  FROM (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS p FROM documents)
)"""


@query(f"WITH {WB} SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def char_wb_ngrams(spark, d):
    return V.term_frequencies(documents(spark, d), V.CharGrams(F.col("text")))


@query(f"WITH {WB}, {TFIDF}")
def char_tf_idf(spark, d):
    return V.tf_idf(documents(spark, d), V.CharGrams(F.col("text")), sketch_bits=22)


# -- metrics ---------------------------------------------------------------------------------------

OTHER = f"{PRED}, g AS (SELECT ref, CASE WHEN pred IN (SELECT ref FROM p) THEN pred ELSE 'other' END AS pred, doc_id, source FROM p)"
CLASSES = f"{OTHER}, s AS (SELECT label, sum(r) AS n_ref, sum(q) AS n_pred, sum(h) AS tp FROM (SELECT ref AS label, 1 AS r, 0 AS q, (ref = pred)::INTEGER AS h FROM g UNION ALL SELECT pred, 0, 1, 0 FROM g) GROUP BY 1), k AS (SELECT label, tp / nullif(n_pred, 0) AS precision, tp / nullif(n_ref, 0) AS recall, 2 * tp / nullif(n_ref + n_pred, 0) AS f1 FROM s)"


@query(f"WITH {OTHER} SELECT doc_id, pred FROM g")
def other_grouping(spark, d):
    return M.group_other(predictions(spark, d)).select("doc_id", "pred")


@query(f"WITH {OTHER} SELECT ref, pred, count(*) / sum(count(*)) OVER (PARTITION BY ref) * 100 AS percent FROM g GROUP BY ref, pred")
def confusion_matrix(spark, d):
    return M.confusion_percent(M.group_other(predictions(spark, d)))


@query(f"WITH {CLASSES} SELECT label, precision, recall, f1 FROM k")
def class_prf(spark, d):
    return M.class_scores(M.group_other(predictions(spark, d))).select("label", "precision", "recall", "f1")


@query(f"WITH {CLASSES} SELECT avg(f1) AS f1_macro, (SELECT avg((ref = pred)::INTEGER) FROM g) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro FROM k")
def macro_scores(spark, d):
    return M.scores(predictions(spark, d))


@query("WITH k AS (SELECT lang AS label, count(*) / sum(count(*)) OVER () AS precision, 1.0 / count(*) OVER () AS recall FROM documents GROUP BY 1) SELECT label, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM k")
def random_baseline(spark, d):
    return M.random_baseline(documents(spark, d), "lang")


SCORES = "z AS (SELECT source AS testset, lang AS model, 'f1' AS metric, (sum(n_chars) % 1000) / 1000.0 AS value FROM documents GROUP BY ALL)"


def _scores(spark, d) -> DataFrame:
    return documents(spark, d).groupBy(F.col("source").alias("testset"), F.col("lang").alias("model")).agg((F.sum("n_chars") % 1000 / 1000.0).cast("double").alias("value")).withColumn("metric", F.lit("f1"))


@query(f"WITH {SCORES} SELECT testset, model, value::DOUBLE AS value FROM z QUALIFY row_number() OVER (PARTITION BY testset ORDER BY value DESC, model) = 1")
def best_per_testset(spark, d):
    return M.best_per_testset(_scores(spark, d), "f1").select("testset", "model", "value")


@query(f"WITH {SCORES} SELECT model, metric, avg(value)::DOUBLE AS mean, stddev_samp(value) AS std FROM z GROUP BY 1, 2")
def best_per_testset_mean_std(spark, d):
    return M.mean_std(_scores(spark, d))


@query(f"WITH {SCORES} SELECT model, max(CASE WHEN testset = 'src0' THEN value * 100 END)::DOUBLE AS src0, max(CASE WHEN testset = 'src1' THEN value * 100 END)::DOUBLE AS src1 FROM z GROUP BY 1")
def metric_matrix(spark, d):
    return M.metric_matrix(_scores(spark, d), "f1", ["src0", "src1"])


SETS = f"""{PRED}, z AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE 'rest' END AS testset FROM p
), g AS (SELECT testset, ref, CASE WHEN EXISTS (SELECT 1 FROM z y WHERE y.testset = z.testset AND y.ref = z.pred) THEN pred ELSE 'other' END AS pred FROM z
), s AS (SELECT testset, label, sum(r) AS n_ref, sum(q) AS n_pred, sum(h) AS tp FROM (SELECT testset, ref AS label, 1 AS r, 0 AS q, (ref = pred)::INTEGER AS h FROM g UNION ALL SELECT testset, pred, 0, 1, 0 FROM g) GROUP BY 1, 2
), k AS (SELECT testset, label, tp / nullif(n_pred, 0) AS precision, tp / nullif(n_ref, 0) AS recall, 2 * tp / nullif(n_ref + n_pred, 0) AS f1, n_ref, tp FROM s
), m AS (SELECT testset, avg(f1) AS f1_macro, sum(tp) / sum(n_ref) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro FROM k GROUP BY 1
), b AS (SELECT testset, ref, count(*) / sum(count(*)) OVER (PARTITION BY testset) AS precision, 1.0 / count(*) OVER (PARTITION BY testset) AS recall FROM z GROUP BY 1, 2
), n AS (SELECT testset, avg(2 * precision * recall / (precision + recall)) AS f1_macro, any_value(recall) AS accuracy, avg(precision) AS precision_macro, any_value(recall) AS recall_macro FROM b GROUP BY 1
), long AS (
  SELECT testset, 'rule' AS model, 'f1_macro' AS metric, f1_macro AS value FROM m UNION ALL SELECT testset, 'rule', 'accuracy', accuracy FROM m UNION ALL SELECT testset, 'rule', 'precision_macro', precision_macro FROM m UNION ALL SELECT testset, 'rule', 'recall_macro', recall_macro FROM m
  UNION ALL SELECT testset, 'rule', 'f1_' || label, f1 FROM k UNION ALL SELECT testset, 'rule', 'precision_' || label, precision FROM k UNION ALL SELECT testset, 'rule', 'recall_' || label, recall FROM k
  UNION ALL SELECT testset, 'baseline_random', 'f1_macro', f1_macro FROM n UNION ALL SELECT testset, 'baseline_random', 'accuracy', accuracy FROM n UNION ALL SELECT testset, 'baseline_random', 'precision_macro', precision_macro FROM n UNION ALL SELECT testset, 'baseline_random', 'recall_macro', recall_macro FROM n
)"""


def _long(spark, d) -> DataFrame:
    rows = predictions(spark, d)
    third = F.col("doc_id") % 3 == 0
    return M.evaluate_all({"rule": lambda t: t}, {"third": rows.where(third), "rest": rows.where(~third)}, "ref", "pred")


@query(f"WITH {SETS} SELECT testset, model, metric, value::DOUBLE AS value FROM long")
def evaluate_all(spark, d):
    """One model on two test sets, with the random baseline."""
    return _long(spark, d)


@query(f"WITH {SETS} SELECT 'rest' AS testset, 'rule' AS model, max(CASE WHEN metric = 'f1_de' THEN value * 100 END)::DOUBLE AS f1_de, max(CASE WHEN metric = 'f1_fr' THEN value * 100 END)::DOUBLE AS f1_fr FROM long WHERE testset = 'rest' AND model = 'rule'")
def report_row(spark, d):
    return M.report_row(_long(spark, d), "rest", "rule", ["de", "fr"])


@query(f"WITH {SETS} SELECT metric, avg(value)::DOUBLE AS mean, stddev_samp(value) AS std FROM (SELECT * FROM long WHERE metric = 'recall_macro' QUALIFY row_number() OVER (PARTITION BY testset ORDER BY value DESC, model) = 1) GROUP BY 1")
def best_then_mean(spark, d):
    """The best model of each test set, then the mean over test sets."""
    return M.mean_std(M.best_per_testset(_long(spark, d), "recall_macro").withColumn("of", F.lit("best")), "of").drop("of")


@query("SELECT avg(n_chars / 100.0)::DOUBLE AS score_mean, stddev_samp(n_chars / 100.0) AS score_std, avg(doc_id)::DOUBLE AS runtime_mean, stddev_samp(doc_id) AS runtime_std FROM documents")
def runtime_summary(spark, d):
    return M.runtime_summary(documents(spark, d).select((F.col("n_chars") / 100.0).cast("double").alias("score"), F.col("doc_id").cast("double").alias("runtime")))


COUNTS = """f AS (SELECT doc_id, term, count(*)::DOUBLE AS weight FROM t GROUP BY ALL
), v AS (SELECT term FROM f GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.5 * (SELECT count(*) FROM documents))"""
SPLIT_WORDS = r"t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '')) AS term FROM documents)"


def _words():
    return F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


@query(f"WITH {SPLIT_WORDS}, {COUNTS} SELECT doc_id, term, weight FROM f JOIN v USING (term)")
def count_vectors(spark, d):
    return V.vectorize("count", documents(spark, d), _words(), min_df=3, max_df=0.5)


@query(f"WITH {SPLIT_WORDS}, {COUNTS} SELECT doc_id, 'w_' || term AS term, weight FROM f JOIN v USING (term) UNION ALL SELECT doc_id, 'c_' || replace(lang || ' ' || source, ' ', '∅'), 1.0 FROM documents")
def feature_union(spark, d):
    """Word counts beside one feature with a blank, under their names by kind."""
    docs = documents(spark, d)
    one = docs.select("doc_id", F.concat_ws(" ", "lang", "source").alias("term"), F.lit(1.0).alias("weight"))
    return V.union_features({"w": V.vectorize("count", docs, _words(), min_df=3, max_df=0.5), "c": one})


# -- models ----------------------------------------------------------------------------------------


@query()
def svm_predict(spark, d):
    """Trained on the split's training rows, with words and characters; every document gets a prediction."""
    from dialectry.operators import models

    rows = samples(spark, d).select("row_id", "text", "dialect")
    clf = models.train(P.train_dev_test(rows).where("split = 'train'"))
    return clf.predict(rows).select("row_id", "dialect", "label_pred")


@query()
def top_features(spark, d):
    from dialectry.operators import models

    rows = samples(spark, d).select("row_id", "text", "dialect")
    return models.top_features(models.train(P.train_dev_test(rows).where("split = 'train'")), 20)
