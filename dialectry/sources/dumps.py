"""History dumps read by many tasks, one file included.

A dump is cut at the tags that end a page, so Spark splits plain files and the blocks of .bz2 files by size; a .gz file
stays with one task. Pages of other namespaces are told by their own tag and left out before their XML is parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry import schema as S

END = "</page>"


def pages_split(spark: SparkSession, path: str, namespaces: tuple[int, ...] | None = None, ids: tuple[int, int] | None = None) -> DataFrame:
    """The rows of :func:`dialectry.sources.readers.pages_xml`, with files split over tasks.

    ``namespaces`` and ``ids`` (first and last page number) drop pages that are never parsed. What stands before the first page
    and behind the last is no page; a page that isn't well-formed fails the job. Tags must have no prefix and no CDATA may hold
    the end of a page: dumps escape it. A file cut off inside a page loses that page's rest, as the page has no end.
    """
    raw = spark.read.text(path, lineSep=END)
    start = F.expr(r"regexp_instr(value, '<page[\\s>]')")
    pages = raw.select(F.substring(F.col("value"), start, F.length("value")).alias("page"), start.alias("at")).where("at > 0").drop("at")
    head = F.substring_index("page", "<revision", 1)
    if namespaces is not None:
        pages = pages.where(_tag(head, "ns").isin(*namespaces))
    if ids is not None:
        pages = pages.where(_tag(head, "id").between(*ids))
    options = {"rowTag": "page", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "FAILFAST"}
    return pages.select(F.from_xml(F.concat("page", F.lit(END)), S.PAGE_XML, options).alias("p")).select("p.*")


def _tag(head, name: str):
    """The number in the first tag of a name before the first revision."""
    return F.regexp_extract(head, rf"<{name}>\s*(-?\d+)\s*</{name}>", 1).try_cast("long")
