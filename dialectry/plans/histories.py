"""Queries on revision histories: events are written as an XML dump and read back through the readers.

Fifty events make a page. Of ten pages eight are articles, one is a user page and one is of another
namespace; contributors are users, addresses or deleted. The SQL rebuilds the same revisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.operators import contributions as C
from dialectry.operators import enrich as E
from dialectry.operators import split as P
from dialectry.functions import text as X
from dialectry.plans.registry import documents, query, table
from dialectry.schema import EXPORT_COLUMNS
from dialectry.sources import readers as R
from dialectry.sources import writers as K
from dialectry.sources.dumps import pages_split
from dialectry.sources.scratch import scratch_path, stored
from dialectry.streaming.metadata import current, keep_up

UNTIL, SKIPPED = "2024-01-20", ("lemosin",)
VARIETIES = ["Gascon", "LENGADOCIAN", "VivaroAlpenc", "provençau", "Lemosin"]
USER_PAGES = ["{{Babel|fr|oc-3|en-2}} p", "x {{Boita d'utilizaire|fr-2|oc}} p", "{{Utilizaire oc-1}} p", "{{user oc}} p", "{{Boita Babel|oc-M|Wikipedian lengadocian| es-3}} p", "{{Babel|bòt}} p"]


def dump_files(spark: SparkSession, d: str, compression: str = "none") -> str:
    """An XML dump of the pages in the scratch folder."""
    page = F.floor(F.col("event_id") / 50)
    e = table(spark, d, "events").select(
        page.alias("page_id"), "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(page % 20 == 8, page % 150).otherwise(F.col("user_id")).alias("uid"), "event_type", F.floor("value").cast("long").alias("bytes")
    )
    known, named = F.col("event_id") % 17 != 0, F.col("uid") % 7 != 0
    name = lambda uid: F.concat(F.when(uid % 13 == 5, "RoBot").otherwise("user"), uid.cast("string"))
    who = F.struct(
        F.when(~known, "deleted").alias("_deleted"), F.when(known & named, F.col("uid")).alias("id"), F.when(known & ~named, F.concat(F.lit("10.0.0."), (F.col("uid") % 250).cast("string"))).alias("ip"), F.when(known & named, name(F.col("uid"))).alias("username")
    )
    own = F.concat(F.element_at(F.array(*map(F.lit, USER_PAGES)), (F.floor(F.col("page_id") / 10) % 6 + 1).cast("int")), F.col("page_id").cast("string"))
    variety = F.element_at(F.array(*map(F.lit, VARIETIES)), ((F.col("event_id") + F.col("page_id")) % 5 + 1).cast("int"))
    article = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", "no tag here").otherwise(F.concat(F.lit("{{Dialècte "), variety, F.lit("}} text "), F.col("event_id").cast("string")))
    text = F.struct(F.when(F.col("page_id") % 10 == 8, own).otherwise(article).alias("_VALUE"), F.col("bytes").alias("_bytes"))
    revision = F.struct(F.col("event_id").alias("id"), "timestamp", who.alias("contributor"), text.alias("text"))
    pages = e.groupBy("page_id").agg(F.array_sort(F.collect_list(revision)).alias("revision"))
    k = F.col("page_id") % 10
    title = F.when(k == 8, F.concat(F.lit("Utilizaire:"), name(F.col("page_id") % 150)))
    title = title.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Òc e l'aiga "), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, "«»").otherwise(F.concat(F.lit("Vila "), F.col("page_id").cast("string"), F.lit("!")))
    ns = F.when(k < 8, 0).when(k == 8, 2).otherwise(1)
    path = scratch_path(spark, "dump")
    pages.select(title.alias("title"), ns.alias("ns"), F.col("page_id").alias("id"), "revision").write.format("xml").options(rowTag="page", rootTag="mediawiki", attributePrefix="_", valueTag="_VALUE", compression=compression).save(path)
    return path


def dump(spark: SparkSession, d: str) -> DataFrame:
    """The pages, through an XML dump."""
    return R.pages_xml(spark, dump_files(spark, d))


def _name_sql(uid: str) -> str:
    return f"(CASE WHEN {uid} % 13 = 5 THEN 'RoBot' ELSE 'user' END || ({uid}))"


def _pick_sql(values: list[str], k: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[({k}) + 1]"


REVISIONS = f"""b AS (
  SELECT event_id // 50 AS page_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN (event_id // 50) % 20 = 8 THEN (event_id // 50) % 150 ELSE user_id END AS uid, event_type, floor(value)::BIGINT AS len_bytes FROM events
), v AS (
  SELECT *, event_id % 17 = 0 AS deleted, CASE WHEN event_id % 17 <> 0 AND uid % 7 <> 0 THEN uid END AS user_id, CASE WHEN event_id % 17 <> 0 AND uid % 7 = 0 THEN '10.0.0.' || (uid % 250) END AS ip,
    CASE WHEN event_id % 17 <> 0 AND uid % 7 <> 0 THEN {_name_sql('uid')} END AS username,
    CASE WHEN page_id % 10 = 8 THEN {_pick_sql(USER_PAGES, 'page_id // 10 % 6')} || page_id WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'no tag here' ELSE '{{{{Dialècte ' || {_pick_sql(VARIETIES, '(event_id + page_id) % 5')} || '}}}} text ' || event_id END AS body
  FROM b
)"""
ARTICLES = f"""{REVISIONS}, r AS (SELECT * FROM v WHERE page_id % 10 < 8 AND substr(timestamp, 1, 10) <= '{UNTIL}'
), g AS (
  SELECT page_id AS id, last(body ORDER BY event_id) AS text_xml, first(len_bytes ORDER BY event_id) AS len_bytes_creation, last(len_bytes ORDER BY event_id) AS len_bytes_latest, min(timestamp) AS date_creation, max(timestamp) AS date_latest, max(event_id) AS latest_revision_id, count(*) AS nb_revisions
  FROM r GROUP BY 1
), h AS (SELECT *, replace(lower(regexp_extract(text_xml, 'Dialècte (.+)\\}}\\}}', 1)), 'vivaroalpenc', 'vivaroaupenc') AS dialect FROM g WHERE text_xml LIKE '{{{{%'
), arts AS (
  SELECT *, CASE id % 3 WHEN 0 THEN 'oc-e-l-aiga-' || id || '-' || id WHEN 1 THEN 'article-' || id ELSE 'vila-' || id || '-' || id END AS title_slugify,
    CASE id % 3 WHEN 0 THEN 'Òc e l''aiga ' || id WHEN 1 THEN '«»' ELSE 'Vila ' || id || '!' END AS title FROM h WHERE dialect <> 'lemosin'
)"""
CONTRIBUTIONS = f"""{ARTICLES}, c AS (
  SELECT page_id, pos_revision, user_id, username, coalesce(user_id::VARCHAR, ip, 'deleted_' || page_id || '_' || pos_revision) AS contributor_id, len_bytes, len_bytes - lag(len_bytes, 1, 0) OVER (PARTITION BY page_id ORDER BY pos_revision) AS diff_bytes
  FROM (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY event_id) - 1)::INTEGER AS pos_revision FROM r WHERE page_id IN (SELECT id FROM arts))
)"""
PEOPLE = f"""{CONTRIBUTIONS}, o AS (
  SELECT name, arg_max(k, body) AS k, arg_max(last_id, body) AS i, arg_max(coalesce(last_name, ''), body) AS last_name FROM (
    SELECT page_id // 10 % 6 AS k, {_name_sql('page_id % 150')} AS name, max(body) AS body, coalesce(last(user_id ORDER BY event_id), -1) AS last_id, last(username ORDER BY event_id) AS last_name FROM v WHERE page_id % 10 = 8 GROUP BY page_id
  ) GROUP BY 1
), w AS (SELECT DISTINCT user_id, username FROM c WHERE user_id IS NOT NULL
), x AS (SELECT coalesce(user_id, CASE WHEN last_name = name THEN i END) AS id, coalesce(username, name) AS username, k FROM w FULL JOIN o ON username = name
), u AS (
  SELECT id, username, CASE k WHEN 0 THEN '3' WHEN 1 THEN 'N' WHEN 2 THEN '1' WHEN 3 THEN 'N' WHEN 4 THEN 'M' END AS oc_level, CASE WHEN k = 4 THEN 'lengadocian' END AS dialect, (lower(username) LIKE '%bot%' OR coalesce(k = 5, false))::INTEGER AS is_bot FROM x WHERE id IS NOT NULL
)"""
JOINED = f"{PEOPLE}, j AS (SELECT c.*, u.dialect, u.is_bot, u.oc_level FROM c LEFT JOIN u ON c.user_id = u.id)"


def articles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = dump(spark, d)
    return pages, C.articles(pages, UNTIL, skip_varieties=SKIPPED)


def metadata(spark: SparkSession, d: str) -> DataFrame:
    pages, arts = articles(spark, d)
    rows = stored(C.contributions(arts), "contributions")
    return C.article_metadata(arts, rows, C.users(pages, rows))


@query(f"WITH {REVISIONS} SELECT page_id AS id, CASE WHEN page_id % 10 = 8 THEN 2 ELSE 0 END AS ns, count(*) AS n, max(timestamp) AS latest, sum(len_bytes)::BIGINT AS bytes, count(body) AS n_texts, count(*) FILTER (WHERE deleted) AS n_deleted FROM v WHERE page_id % 10 < 9 GROUP BY 1")
def xml_pages(spark, d):
    arts, users = R.routed(dump(spark, d))
    r = F.explode("revision").alias("r")
    rows = arts.unionByName(users).select("id", "ns", r)
    return rows.groupBy("id", "ns").agg(
        F.count(F.lit(1)).alias("n"), F.max("r.timestamp").alias("latest"), F.sum("r.text._bytes").alias("bytes"), F.count("r.text._VALUE").alias("n_texts"), F.count_if(F.col("r.contributor._deleted") == "deleted").alias("n_deleted")
    )


@query(f"WITH {REVISIONS} SELECT page_id AS id, 2 AS ns, count(*) AS n, min(timestamp) AS oldest, sum(len_bytes)::BIGINT AS bytes, sum(length(body))::BIGINT AS chars, count(ip) AS n_ip FROM v WHERE page_id % 10 = 8 GROUP BY 1")
def xml_pages_split(spark, d):
    """User pages of a compressed dump whose files are split over tasks; the others are left out before they are parsed."""
    pages = pages_split(spark, dump_files(spark, d, "bzip2"), namespaces=(2,))
    return pages.select("id", "ns", F.explode("revision").alias("r")).groupBy("id", "ns").agg(
        F.count(F.lit(1)).alias("n"), F.min("r.timestamp").alias("oldest"), F.sum("r.text._bytes").alias("bytes"), F.sum(F.length("r.text._VALUE")).alias("chars"), F.count("r.contributor.ip").alias("n_ip")
    )


@query("SELECT DISTINCT event_id // 50 AS id FROM events ORDER BY 1 LIMIT 7")
def limited_pages(spark, d):
    return R.limited(dump(spark, d), 7).select("id")


@query(f"WITH {ARTICLES} SELECT id, title_slugify, dialect, text_xml, len_bytes_creation, len_bytes_latest, date_creation, date_latest, latest_revision_id, nb_revisions FROM arts")
def article_projection(spark, d):
    return articles(spark, d)[1].drop("revision", "title")


@query(f"WITH {ARTICLES} SELECT id, latest_revision_id, len_bytes_creation, len_bytes_latest, nb_revisions FROM g WHERE text_xml <> ''")
def latest_revision_cutoff(spark, d):
    kept = C.articles(dump(spark, d), UNTIL, keep_without_variety=True)
    return kept.select("id", "latest_revision_id", "len_bytes_creation", "len_bytes_latest", "nb_revisions")


@query(f"WITH {ARTICLES} SELECT id, dialect FROM arts")
def tag_filter(spark, d):
    return articles(spark, d)[1].select("id", "dialect")


@query(f"WITH {ARTICLES} SELECT id, title_slugify FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'oc-e-l-aiga-' || id || '-' || id WHEN 1 THEN 'article-' || id ELSE 'vila-' || id || '-' || id END AS title_slugify FROM g)")
def title_slug(spark, d):
    pages = dump(spark, d).where("ns = 0")
    return pages.where(F.size(C.revisions_until(F.col("revision"), UNTIL)) > 0).select("id", X.title_slug(F.col("title"), F.col("id")).alias("title_slugify"))


@query(f"WITH {CONTRIBUTIONS} SELECT page_id, pos_revision, contributor_id, user_id, username, len_bytes, diff_bytes FROM c")
def contributor_rows(spark, d):
    return C.contributions(articles(spark, d)[1])


@query(f"WITH {PEOPLE} SELECT id, username, oc_level, dialect, is_bot FROM u")
def wiki_users(spark, d):
    pages, arts = articles(spark, d)
    return C.users(pages, C.contributions(arts))


@query(f"WITH {REVISIONS} SELECT page_id AS id, {_name_sql('page_id % 150')} AS username FROM v WHERE page_id % 10 = 8 GROUP BY 1")
def user_names(spark, d):
    return dump(spark, d).where("ns = 2").select("id", X.username_of(F.col("title")).alias("username"))


def _half(diff: str = "diff_bytes") -> str:
    return f"greatest(1, round_even(abs({diff}) / 2.0, 0))::BIGINT"


def _json_sql(key: str, value: str, name: str) -> str:
    return f"""(SELECT page_id, '{{' || string_agg('"' || coalesce({key}::VARCHAR, 'null') || '": ' || value, ', ' ORDER BY value DESC, last DESC) || '}}' AS {name} FROM (SELECT page_id, {key}, ({value})::BIGINT AS value, max(pos_revision) AS last FROM j GROUP BY ALL) GROUP BY 1)"""


_SIZE = f"sum(CASE WHEN diff_bytes < 0 THEN {_half()} ELSE diff_bytes END)"
_LEVELS = "['NULL', '0', '1', '2', '3', '4', '5', 'N']"
METADATA = f"""{JOINED}, k AS (
  SELECT page_id, contributor_id, count(*) AS n, sum(CASE WHEN diff_bytes > 0 THEN diff_bytes ELSE {_half()} END) AS s, min(pos_revision) AS f FROM c GROUP BY ALL
), t AS (
  SELECT page_id, first(contributor_id ORDER BY n DESC, f) AS user_most_contrib_id, first(contributor_id ORDER BY s DESC, f) AS user_biggest_contrib_id, count(*) AS nb_contributors FROM k GROUP BY 1
), a AS (SELECT *, max(pos_revision) FILTER (WHERE len_bytes >= 100) OVER (PARTITION BY page_id) AS p FROM j
), l AS (
  SELECT page_id, max(oc_level) FILTER (WHERE pos_revision = p) AS oc_level_first,
    {_LEVELS}[max(list_position({_LEVELS}, oc_level)) FILTER (WHERE pos_revision <= p AND len_bytes >= 1)] AS oc_level_max,
    coalesce(max(is_bot) FILTER (WHERE pos_revision = p), 0)::INTEGER AS bot_first_author, count(*) FILTER (WHERE is_bot = 1) AS bot_nb_revisions,
    string_agg(DISTINCT dialect, ' ' ORDER BY dialect) AS user_dialects, first(contributor_id ORDER BY pos_revision) AS user_creator_id, last(contributor_id ORDER BY pos_revision) AS user_latest_id,
    coalesce(max(is_bot) FILTER (WHERE pos_revision = 0), 0)::INTEGER AS bot_created
  FROM a GROUP BY page_id
), meta AS (
  SELECT arts.*, t.* EXCLUDE page_id, l.* EXCLUDE page_id, uf.user_rank_freq, us.user_rank_size, lf.oc_level_rank_freq, ls.oc_level_rank_size
  FROM arts JOIN t ON t.page_id = id JOIN l ON l.page_id = id JOIN {_json_sql('user_id', 'count(*)', 'user_rank_freq')} uf ON uf.page_id = id JOIN {_json_sql('user_id', _SIZE, 'user_rank_size')} us ON us.page_id = id
  JOIN {_json_sql('oc_level', 'count(*)', 'oc_level_rank_freq')} lf ON lf.page_id = id JOIN {_json_sql('oc_level', _SIZE, 'oc_level_rank_size')} ls ON ls.page_id = id
)"""


@query(f"WITH {METADATA} SELECT * FROM meta")
def article_metadata(spark, d):
    return metadata(spark, d)


@query(f"WITH {METADATA} SELECT * FROM meta")
def metadata_kept_up(spark, d):
    """The same from state by page: revisions come in three files, in no order, one after another."""
    pages, arts = articles(spark, d)
    rows = stored(C.contributions(arts), "contributions")
    source, target, check = (scratch_path(spark, x) for x in ("revisions", "statistics", "stream"))
    for k in range(3):
        part = rows.where(F.pmod(F.xxhash64("page_id", "pos_revision"), F.lit(3)) == k)
        part.select("page_id", F.col("pos_revision").cast("long").alias("pos_revision"), "contributor_id", "user_id", "len_bytes").write.mode("append").parquet(source)
        keep_up(spark, source, target, check)
    return C.metadata_of(arts, current(spark, target), C.users(pages, rows))


@query(f"WITH {METADATA} SELECT id, bot_created FROM meta")
def bot_created(spark, d):
    return metadata(spark, d).select("id", "bot_created")


CLEAN = "q AS (SELECT doc_id % 90 AS id, last('a' || replace(text, chr(10), chr(10) || chr(10)) ORDER BY doc_id) AS text_finewiki, (max(doc_id) + 1000000)::VARCHAR AS date_modified_finewiki FROM documents GROUP BY 1)"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents as clean texts of the first 90 pages, several for each; blank lines part their paragraphs."""
    docs = documents(spark, d)
    text = F.concat(F.lit("a"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return E.clean_texts(docs.select(F.concat(F.lit("x/ocwiki/"), (F.col("doc_id") % 90).cast("string")).alias("id"), text.alias("text"), (F.col("doc_id") + 1000000).cast("string").alias("date_modified")))


@query(f"WITH {ARTICLES}, {CLEAN} SELECT id, dialect, text_finewiki, date_modified_finewiki FROM arts LEFT JOIN q USING (id)")
def enrich_left_join(spark, d):
    return E.with_clean_text(articles(spark, d)[1], _clean(spark, d)).select("id", "dialect", "text_finewiki", "date_modified_finewiki")


TIDY = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[^\S\n]+', ' ', 'g')"
PARAGRAPHS = r"list_transform(list_filter(regexp_split_to_array({0}, '\n(?:[^\S\n]*\n)+'), lambda p: regexp_matches(p, '(?s)\p{{L}}.*\p{{L}}')), lambda p: " + TIDY.format("p") + ")"


@query(f"WITH {METADATA}, {CLEAN} SELECT id, title, dialect, text_xml, text_finewiki, array_to_string({PARAGRAPHS.format('text_finewiki')}, '¶') AS paragraphs, len_bytes_creation, len_bytes_latest, substr(date_creation, 1, 10) AS date_creation, substr(date_latest, 1, 10) AS date_latest_xml, date_modified_finewiki AS date_latest_finewiki, latest_revision_id, nb_revisions, nb_contributors, user_creator_id, user_latest_id, user_most_contrib_id, user_biggest_contrib_id, user_rank_freq, user_rank_size, oc_level_first, oc_level_max, oc_level_rank_freq, oc_level_rank_size, bot_created, bot_first_author, bot_nb_revisions, user_dialects FROM meta LEFT JOIN q USING (id)")
def export_json(spark, d):
    """The whole build, exported as JSON lines and read back."""
    path = scratch_path(spark, "export")
    out = E.export(E.with_clean_text(metadata(spark, d), _clean(spark, d)))
    K.json_lines(out, path)
    back = R.json_lines(spark, path, out.schema)
    pairs = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(c, lambda p: F.concat(F.lit('"'), p["key"], F.lit('": '), p["value"].cast("string"))), ", "), F.lit("}")).alias(c)
    shown = {"paragraphs": F.array_join("paragraphs", "¶").alias("paragraphs"), "user_dialects": F.array_join("user_dialects", " ").alias("user_dialects")} | {c: pairs(c) for c in EXPORT_COLUMNS if "_rank_" in c}
    return back.select(*[shown.get(c, F.col(c)) for c in EXPORT_COLUMNS if c != "segments"])


@query(rf"SELECT conv_id, turn, regexp_replace(p, '\s+', ' ', 'g') AS paragraph, (i - 1)::INTEGER AS unit_pos FROM (SELECT conv_id, turn, {PARAGRAPHS.format('replace(text, chr(10), chr(10) || chr(10))')} AS ps FROM conversations), unnest(ps) WITH ORDINALITY AS x(p, i)")
def paragraph_explode(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return P.expand_units(c.select("conv_id", "turn", "text"), X.paragraphs(F.col("text"))).withColumnRenamed("text", "paragraph")
