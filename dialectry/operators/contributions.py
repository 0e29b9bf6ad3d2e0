"""Revision histories: contributions, and what they say about an article's contributors.

Input rows are contributions (page_id, pos_revision, user_id, len_bytes, diff_bytes) with, where needed,
the columns of their user (oc_level, dialect, is_bot), joined once. Order is always explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.functions import text as X
from dialectry.schema import LEVELS, NON_EMPTY_BYTES, SIGNIFICANT_BYTES


def revisions_until(revisions: Column, until: str | None) -> Column:
    """Revisions up to and including the day ``until``."""
    return revisions if until is None else F.filter(revisions, lambda r: F.substring(r["timestamp"], 1, 10) <= until)


def articles(pages: DataFrame, until: str | None = None, keep_without_variety: bool = False, skip_varieties: tuple[str, ...] = ()) -> DataFrame:
    """Article pages with revisions up to ``until``, a latest text, and an accepted variety.

    The rejections come before any revision is unfolded.
    """
    kept = pages.where("ns = 0").withColumn("revision", revisions_until(F.col("revision"), until)).where(F.size("revision") > 0)
    first, last = F.try_element_at("revision", F.lit(1)), F.try_element_at("revision", F.lit(-1))
    kept = kept.withColumn("text_xml", last["text"]["_VALUE"]).where(F.length(F.coalesce("text_xml", F.lit(""))) > 0)
    kept = kept.withColumn("dialect", X.variety_tag(F.col("text_xml")))
    if not keep_without_variety:
        kept = kept.where(F.col("dialect").isNotNull())
    if skip_varieties:
        kept = kept.where(F.col("dialect").isNull() | ~F.col("dialect").isin(*skip_varieties))
    return kept.select(
        "id", "title", X.title_slug(F.col("title"), F.col("id")).alias("title_slugify"), "dialect", "text_xml",
        first["text"]["_bytes"].alias("len_bytes_creation"), last["text"]["_bytes"].alias("len_bytes_latest"),
        first["timestamp"].alias("date_creation"), last["timestamp"].alias("date_latest"), last["id"].alias("latest_revision_id"), F.size("revision").cast("long").alias("nb_revisions"), "revision",
    )


def contributor_id(contributor: Column, page_id: Column, pos: Column) -> Column:
    """The user's id, else the address, else a name of its own for a deleted contributor; none of them fails the job."""
    deleted = F.when(contributor["_deleted"] == "deleted", F.concat_ws("_", F.lit("deleted"), page_id, pos))
    return F.coalesce(contributor["id"].cast("string"), contributor["ip"], deleted, F.raise_error(F.concat(F.lit("no contributor in page "), page_id.cast("string"))).cast("string"))


def contributions(arts: DataFrame) -> DataFrame:
    """One row per revision of the articles, with the difference to the one before."""
    flat = arts.select(F.col("id").alias("page_id"), F.posexplode("revision").alias("pos_revision", "r"))
    flat = flat.select("page_id", "pos_revision", contributor_id(F.col("r.contributor"), F.col("page_id"), F.col("pos_revision")).alias("contributor_id"), F.col("r.contributor.id").alias("user_id"), F.col("r.contributor.username").alias("username"), F.col("r.text._bytes").alias("len_bytes"))
    return with_diff(flat)


def with_diff(df: DataFrame, page: str = "page_id", pos: str = "pos_revision") -> DataFrame:
    before = F.lag("len_bytes", 1, 0).over(Window.partitionBy(page).orderBy(pos))
    return df.withColumn("diff_bytes", F.col("len_bytes") - before)


def ordered(df: DataFrame, order: str = "desc", n: int | None = None, page: str = "page_id", pos: str = "pos_revision") -> DataFrame:
    """Each page's contributions with their rank, newest first or (``asc``) oldest first, the first ``n`` of them if given."""
    by = F.col(pos).desc() if order == "desc" else F.col(pos).asc()
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(by)))
    return out if n is None else out.where(F.col("rank") <= n)


def halved(diff: Column) -> Column:
    """Half of a removal, rounded to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.abs(diff) / 2)).cast("long")


def contribution_weight(diff: Column) -> Column:
    """Insertions count fully, removals half; no difference counts 1."""
    return F.when(diff > 0, diff).otherwise(halved(diff))


def rank_weight(diff: Column) -> Column:
    """As above, but no difference counts 0."""
    return F.when(diff < 0, halved(diff)).otherwise(diff)


def top_contributors(df: DataFrame, page: str = "page_id", who: str = "contributor_id", pos: str = "pos_revision") -> DataFrame:
    """Most frequent and largest contributor and their number; ties go to the one who came first."""
    per = df.groupBy(page, who).agg(F.count(F.lit(1)).alias("n"), F.sum(contribution_weight(F.col("diff_bytes"))).alias("size"), F.min(pos).alias("first"))
    return per.groupBy(page).agg(
        F.max_by(who, F.struct("n", -F.col("first"))).alias("user_most_contrib_id"),
        F.max_by(who, F.struct("size", -F.col("first"))).alias("user_biggest_contrib_id"),
        F.count(F.lit(1)).alias("nb_contributors"),
        F.sum("n").alias("nb_revisions"),
    )


def anchor(order: str, page: str, pos: str) -> Column:
    """Place of the first significant revision in the given order."""
    big = F.when(F.col("len_bytes") >= SIGNIFICANT_BYTES, F.col(pos))
    return (F.max(big) if order == "desc" else F.min(big)).over(Window.partitionBy(page))


def level_first_max(df: DataFrame, order: str = "desc", page: str = "page_id", pos: str = "pos_revision") -> DataFrame:
    """Level at the first significant revision, the highest from there on, and whether a bot wrote that revision.

    ``desc`` walks from the newest revision, ``asc`` from the oldest.
    """
    at = df.withColumn("_a", anchor(order, page, pos))
    here, on = F.col(pos) == F.col("_a"), (F.col(pos) <= F.col("_a") if order == "desc" else F.col(pos) >= F.col("_a")) & (F.col("len_bytes") >= NON_EMPTY_BYTES)
    top = F.max(F.when(on, X.level_rank(F.col("oc_level"))))
    return at.groupBy(page).agg(
        F.max(F.when(here, F.col("oc_level"))).alias("oc_level_first"),
        F.try_element_at(F.array(*map(F.lit, LEVELS)), top.cast("int")).alias("oc_level_max"),
        F.coalesce(F.max(F.when(here, F.col("is_bot"))), F.lit(0)).cast("int").alias("bot_first_author"),
    )


def bot_revisions(df: DataFrame, page: str = "page_id") -> DataFrame:
    return df.groupBy(page).agg(F.count_if(F.col("is_bot") == 1).alias("bot_nb_revisions"))


def user_varieties(df: DataFrame, page: str = "page_id") -> DataFrame:
    """Sorted distinct varieties of the contributors, joined by spaces; null if none."""
    found = F.array_sort(F.collect_set(F.nullif(F.col("dialect"), F.lit(""))))
    return df.groupBy(page).agg(F.when(F.size(found) > 0, F.array_join(found, " ")).alias("user_dialects"))


def ranking(df: DataFrame, key: str, by: str = "freq", page: str = "page_id", pos: str = "pos_revision") -> DataFrame:
    """(page, key, value, rank): keys by falling count or size, ties in the order of descending revisions. A null key is a key."""
    value = F.count(F.lit(1)) if by == "freq" else F.sum(rank_weight(F.col("diff_bytes")))
    per = df.groupBy(page, key).agg(value.alias("value"), F.max(pos).alias("_last"))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("value"), F.desc("_last")))
    return per.withColumn("rank", rank.cast("int")).drop("_last")


def ranking_json(ranked: DataFrame, key: str, name: str, page: str = "page_id") -> DataFrame:
    """The ranking as an ordered JSON object; the null key is named ``null``."""
    item = F.struct("rank", F.concat(F.lit('"'), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit('": '), F.col("value").cast("string")).alias("t"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"])
    return ranked.groupBy(page).agg(F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")).alias(name))


def users(pages: DataFrame, contribs: DataFrame) -> DataFrame:
    """Users met as contributors or by their own page, with declared level, variety and bot flag.

    A user page joins by name; without such a contributor it belongs to its last editor if the names agree.
    """
    own = pages.where("ns = 2").select(X.username_of(F.col("title")).alias("username"), F.try_element_at("revision", F.lit(-1)).alias("r")).where("username is not null")
    own = own.select("username", F.col("r.contributor.id").alias("last_id"), F.col("r.contributor.username").alias("last_name"), F.col("r.text._VALUE").alias("page"))
    own = own.groupBy("username").agg(F.max_by(F.struct("last_id", "last_name", "page"), F.coalesce("page", F.lit(""))).alias("u")).select("username", "u.*")
    met = contribs.where("user_id is not null and username is not null").groupBy("user_id").agg(F.min_by("username", F.struct("page_id", "pos_revision")).alias("username"))
    joined = met.join(own, "username", "full_outer")
    ident = F.coalesce("user_id", F.when(F.col("last_name") == F.col("username"), F.col("last_id")))
    return joined.select(ident.alias("id"), "username", X.declared_level(F.col("page")).alias("oc_level"), X.declared_variety(F.col("page")).alias("dialect"), X.is_bot(F.col("username"), F.col("page")).cast("int").alias("is_bot")).where("id is not null")


def with_users(contribs: DataFrame, people: DataFrame, key: str = "user_id") -> DataFrame:
    """Contributions with their user's columns; one join for all later questions."""
    known = people.select(F.col("id").alias(key), "oc_level", "dialect", "is_bot", F.lit(True).alias("known_user"))
    return contribs.join(known, key, "left")


def keep_levels(df: DataFrame, levels: list[str]) -> DataFrame:
    """Rows whose highest level is listed (``NULL``: none); ``all`` keeps everything, and so do levels outside the order."""
    if "all" in levels:
        return df
    unknown = [x for x in levels if x not in LEVELS]
    if unknown:
        raise ValueError(f"unknown levels: {unknown}")
    dropped = [x for x in LEVELS if x not in levels]
    return df.where(~F.coalesce("oc_level_max", F.lit("NULL")).isin(*dropped)) if dropped else df


#: What is known of a contributor to a page; all of it can be kept up to date revision by revision.
STATS = "n long, size long, rank_size long, first long, last long, first_filled long, last_filled long, first_big long, last_big long"


def contributor_stats(contribs: DataFrame) -> DataFrame:
    """One row per page and contributor: revisions, weights, and the places of the first and last revision, filled one and significant one.

    All contributor metadata follows from these rows.
    """
    pos, diff = F.col("pos_revision").cast("long"), F.col("diff_bytes")
    filled, big = F.when(F.col("len_bytes") >= NON_EMPTY_BYTES, pos), F.when(F.col("len_bytes") >= SIGNIFICANT_BYTES, pos)
    return contribs.groupBy("page_id", "contributor_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(contribution_weight(diff)).alias("size"), F.sum(rank_weight(diff)).alias("rank_size"), F.min(pos).alias("first"), F.max(pos).alias("last"),
        F.min(filled).alias("first_filled"), F.max(filled).alias("last_filled"), F.min(big).alias("first_big"), F.max(big).alias("last_big"),
    )


def _rankings(c: DataFrame, key: str, name: str) -> DataFrame:
    """Per page the rankings of a key by count and by size, as ordered JSON objects; ties as in :func:`ranking`."""
    per = c.groupBy("page_id", key).agg(F.sum("n").alias("freq"), F.sum("rank_size").alias("size"), F.max("last").alias("last"))
    named = F.concat(F.lit('"'), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit('": '))

    def of(value: str) -> Column:
        item = F.struct((-F.col(value)).alias("v"), (-F.col("last")).alias("l"), F.concat(named, F.col(value).cast("string")).alias("t"))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", "), F.lit("}"))

    return per.groupBy("page_id").agg(of("freq").alias(f"{name}_freq"), of("size").alias(f"{name}_size"))


def metadata_of(arts: DataFrame, stats: DataFrame, people: DataFrame, order: str = "desc") -> DataFrame:
    """The articles with all contributor metadata, from the statistics of their contributors.

    Statistics meet their users once and are dealt out by page once; everything per page is computed there.
    """
    c = with_users(stats, people).repartition(F.col("page_id"))
    at, filled = ("last_big", "first_filled") if order == "desc" else ("first_big", "last_filled")
    over = Window.partitionBy("page_id")
    c = c.withColumn("_a", (F.max(at) if order == "desc" else F.min(at)).over(over))
    here, on = F.col(at) == F.col("_a"), (F.col(filled) <= F.col("_a")) if order == "desc" else (F.col(filled) >= F.col("_a"))
    varieties = F.array_sort(F.collect_set(F.nullif(F.col("dialect"), F.lit(""))))
    pages = c.groupBy("page_id").agg(
        F.max_by("contributor_id", F.struct("n", -F.col("first"))).alias("user_most_contrib_id"),
        F.max_by("contributor_id", F.struct("size", -F.col("first"))).alias("user_biggest_contrib_id"),
        F.count(F.lit(1)).alias("nb_contributors"),
        F.max(F.when(here, F.col("oc_level"))).alias("oc_level_first"),
        F.try_element_at(F.array(*map(F.lit, LEVELS)), F.max(F.when(on, X.level_rank(F.col("oc_level")))).cast("int")).alias("oc_level_max"),
        F.coalesce(F.max(F.when(here, F.col("is_bot"))), F.lit(0)).cast("int").alias("bot_first_author"),
        F.coalesce(F.sum(F.when(F.col("is_bot") == 1, F.col("n"))), F.lit(0)).alias("bot_nb_revisions"),
        F.when(F.size(varieties) > 0, F.array_join(varieties, " ")).alias("user_dialects"),
        F.min_by("contributor_id", "first").alias("user_creator_id"),
        F.max_by("contributor_id", "last").alias("user_latest_id"),
        F.coalesce(F.min_by(F.coalesce("is_bot", F.lit(0)), "first"), F.lit(0)).cast("int").alias("bot_created"),
    )
    out = arts.drop("revision").withColumnRenamed("id", "page_id")
    for p in (pages, _rankings(c, "user_id", "user_rank"), _rankings(c, "oc_level", "oc_level_rank")):
        out = out.join(p, "page_id", "left")
    return out.withColumn("bot_created", F.coalesce("bot_created", F.lit(0))).withColumnRenamed("page_id", "id")


def article_metadata(arts: DataFrame, contribs: DataFrame, people: DataFrame, order: str = "desc") -> DataFrame:
    """The articles with all contributor metadata, from their contributions."""
    return metadata_of(arts, contributor_stats(contribs), people, order)
