"""Label schemes, mapping policies and label numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Canonical labels, and the source labels of each scheme.
LABELS = ["ara", "auv", "gas", "lan", "lim", "nic", "pro", "viv"]
SCHEMES: dict[str, dict[str, str]] = {
    "congres_full": {
        "oc-aranes-grclass": "ara", "oc-auvern-grclass": "auv", "oc-gascon-grclass": "gas", "oc-lengadoc-grclass": "lan", "oc-lemosin-grclass": "lim",
        "oc-nicard-grclass": "nic", "oc-nicard-grmistr": "nic", "oc-provenc-grclass": "pro", "oc-vivaraup-grclass": "viv",
    },
    "congres_stripped": {"aranes": "ara", "auvern": "auv", "gascon": "gas", "lengadoc": "lan", "lemosin": "lim", "nicard": "nic", "provenc": "pro", "vivaraup": "viv"},
    "ttb": {"gascon": "gas", "languedocien": "lan", "limousin": "lim", "provencal": "pro"},
    "wiki": {"aranés": "ara", "auvernhat": "auv", "gascon": "gas", "lemosin": "lim", "lengadocian": "lan", "niçard": "nic", "provençau": "pro", "vivaroaupenc": "viv"},
    "forum": {"gasc-1240": "gas", "lang-1309": "lan", "limo-1246": "lim", "prov-1235": "pro"},
    "fasttext": {k: k for k in LABELS},
}
#: Scheme of each source, in the order in which names are tried.
SOURCE_SCHEMES = {"wiki": "wiki", "ttb": "ttb", "congres": "congres_stripped", "soft": "congres_stripped", "forum": "forum", "concat": "fasttext"}
LABEL_PREFIX = "__label__"


def map_label(c: Column, mapper: dict[str, str], policy: str = "null") -> Column:
    """The mapped label. An unmapped one becomes null, stays (``passthrough``) or fails the job (``error``); null stays null but under ``error``."""
    if policy not in ("null", "passthrough", "error"):
        raise ValueError(f"unknown policy: {policy}")
    found = F.create_map(*(F.lit(x) for p in mapper.items() for x in p))[c] if mapper else F.lit(None).cast("string")
    if policy == "null":
        return found
    rest = c if policy == "passthrough" else F.raise_error(F.concat(F.lit("unmapped label: "), F.coalesce(c, F.lit("null")))).cast("string")
    return F.coalesce(found, rest)


def detect_source(file_name: Column) -> Column:
    """The first source whose name occurs in the file's base name; null if none does."""
    base = F.substring_index(file_name, "/", -1)
    out = F.lit(None).cast("string")
    for k in reversed(SOURCE_SCHEMES):
        out = F.when(F.instr(base, k) > 0, F.lit(k)).otherwise(out)
    return out


def spelling_free_label(c: Column) -> Column:
    """The variety of labels such as ``oc-gascon-grclass``; others fail the job."""
    found = F.regexp_extract(F.lower(c), r"^oc-([a-z]+)-gr[a-z]+$", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("unexpected label: "), F.coalesce(c, F.lit("null")))).cast("string"))


def strip_prefix(c: Column) -> Column:
    return F.replace(c, F.lit(LABEL_PREFIX), F.lit(""))


def fasttext_line(label: Column, text: Column) -> Column:
    return F.concat(F.lit(LABEL_PREFIX), label, F.lit(" "), text)


def label_index(df: DataFrame, label_col: str, known: list[str] | None = None) -> DataFrame:
    """(label, label_id): known labels first in their order, then the others sorted, without gaps.

    The window runs over the distinct labels only.
    """
    known = sorted(known or [])
    labels = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label")).distinct()
    if known:
        listed = df.sparkSession.createDataFrame([(k,) for k in known], "label string")
        labels = labels.unionByName(listed).distinct()
    first = F.when(F.col("label").isin(known), 0).otherwise(1) if known else F.lit(0)
    return labels.select("label", (F.row_number().over(Window.orderBy(first, "label")) - 1).cast("long").alias("label_id"))
