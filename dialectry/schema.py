"""Fixed schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

#: Language levels in ascending order; "NULL" stands for no level.
LEVELS = ["NULL", "0", "1", "2", "3", "4", "5", "N"]
#: Fixed value: spelling variants of variety names.
NORMALISED_VARIETIES = {"vivaroalpenc": "vivaroaupenc"}
#: Least bytes of a significant revision, and of a revision that isn't empty.
SIGNIFICANT_BYTES = 100
NON_EMPTY_BYTES = 1


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


REVISION = (
    "id long, timestamp string, contributor struct<_deleted: string, id: long, ip: string, username: string>, text struct<_VALUE: string, _bytes: long>"
)
PAGE_XML = f"title string, ns int, id long, revision array<struct<{REVISION.replace('id long', 'id: long', 1).replace('timestamp string', 'timestamp: string').replace('contributor struct', 'contributor: struct').replace('text struct', 'text: struct')}>>"
LABELLED = "text string, dialect string"
FORUM = "id string, text string, author_dialect string"
#: Columns of the exported article, in order.
EXPORT_COLUMNS = [
    "id", "title", "dialect", "text_xml", "text_finewiki", "paragraphs", "segments", "len_bytes_creation", "len_bytes_latest", "date_creation", "date_latest_xml", "date_latest_finewiki",
    "latest_revision_id", "nb_revisions", "nb_contributors", "user_creator_id", "user_latest_id", "user_most_contrib_id", "user_biggest_contrib_id", "user_rank_freq", "user_rank_size",
    "oc_level_first", "oc_level_max", "oc_level_rank_freq", "oc_level_rank_size", "bot_created", "bot_first_author", "bot_nb_revisions", "user_dialects",
]


def schema(spec: str) -> T.StructType:
    """A DDL string as a StructType."""
    return _struct(spec)
