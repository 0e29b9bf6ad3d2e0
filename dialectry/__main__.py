"""Command line: ``python -m dialectry [--config FILE] build|split|merge|concat|fasttext ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.functions import labels as L
from dialectry.functions import text as X
from dialectry.operators import contributions as C
from dialectry.operators import enrich as E
from dialectry.operators import split as P
from dialectry.sources import readers as R
from dialectry.sources import writers as K

#: The last day of revisions, and varieties left out of the splits.
LAST_DAY = "2025-08-20"
UNSPLIT = ["aguiainés", "marchés"]


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """History dump and clean texts to exported articles."""
    pages = R.pages_xml(spark, a.dump)
    arts = C.articles(R.limited(pages, a.limit), a.until, a.keep_no_dialect, tuple(a.skip_dialects))
    rows = C.contributions(arts)
    out = C.keep_levels(C.article_metadata(arts, rows, C.users(pages, rows), a.order), a.levels)
    if a.clean:
        out = E.with_clean_text(out, E.clean_texts(R.snapshot(spark, a.clean)))
    else:
        out = out.withColumns({"text_finewiki": F.lit(None).cast("string"), "date_modified_finewiki": F.lit(None).cast("string")})
    K.json_lines(E.export(out), a.out)


def split_articles(articles: DataFrame, unit: str = "paragraph", **options) -> DataFrame:
    """Split whole articles by their number of units, then unfold each split's own rows."""
    units = {"paragraph": X.paragraphs(F.col("text")), "segment": X.segments(F.col("text")), "article": F.array("text")}[unit]
    rows = articles.where(F.col("dialect").isNull() | ~F.col("dialect").isin(*UNSPLIT)).where("text is not null").withColumn("units", F.size(units).cast("long"))
    return P.expand_units(P.train_dev_test(rows, order="article_id", units="units", **options).drop("units"), units)


SPLIT_OPTIONS = ("test_strategy", "dev_strategy", "test_size", "dev_size", "ratio", "threshold", "most", "seed")


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    articles = R.json_lines(spark, a.articles, "id long, dialect string, text_finewiki string").select(F.col("id").alias("article_id"), F.col("text_finewiki").alias("text"), "dialect")
    out = split_articles(articles, a.unit, **{k: getattr(a, k) for k in SPLIT_OPTIONS})
    K.csv_splits(out.select("article_id", "text", "dialect", "split"), a.out, single=a.single)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Folders of section-sign files to one set of splits; ``full`` is the merged set."""
    rows = R.merged_sections(spark, a.folders)
    K.csv_splits(P.train_dev_test(rows, **{k: getattr(a, k) for k in SPLIT_OPTIONS}).select("text", "dialect", "split"), f"{a.out}", single=a.single)
    K.csv_file(rows.select("text", "dialect"), f"{a.out}/full.csv", single=a.single)


def concat(spark: SparkSession, a: argparse.Namespace) -> None:
    K.csv_splits(R.labelled_sources(spark, a.files).select("text", "dialect").withColumn("split", F.lit(a.split)), a.out, single=a.single)


def fasttext(spark: SparkSession, a: argparse.Namespace) -> None:
    K.fasttext_lines(R.csv_verbatim(spark, a.file), a.out, L.SCHEMES[a.scheme])


def size(value: str) -> float | int:
    """A number of rows, or a share of them if it has a point."""
    return float(value) if "." in value else int(value)


def with_split_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--test_strategy", choices=["balance", "stratify"], default="balance")
    p.add_argument("--dev_strategy", choices=["balance", "stratify"], default="balance")
    p.add_argument("--test_size", type=size)
    p.add_argument("--dev_size", type=size)
    p.add_argument("--ratio", type=float, default=0.5)
    p.add_argument("--threshold", type=int, default=10)
    p.add_argument("--most", type=int, default=500)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--single", action="store_true", help="one file a split instead of a folder of parts")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dialectry")
    p.add_argument("--config", help="options by command in a JSON, TOML or YAML file; the command line overrides them")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("dump")
    b.add_argument("out")
    b.add_argument("--clean")
    b.add_argument("--limit", type=int)
    b.add_argument("--until", default=LAST_DAY)
    b.add_argument("--order", choices=["desc", "asc"], default="desc")
    b.add_argument("--levels", nargs="+", default=["all"])
    b.add_argument("--skip_dialects", nargs="*", default=[])
    b.add_argument("--keep_no_dialect", action="store_true")
    s = sub.add_parser("split")
    s.add_argument("articles")
    s.add_argument("out")
    s.add_argument("--unit", choices=["paragraph", "segment", "article"], default="paragraph")
    with_split_options(s)
    m = sub.add_parser("merge")
    m.add_argument("out")
    m.add_argument("folders", nargs="+")
    with_split_options(m)
    c = sub.add_parser("concat")
    c.add_argument("out")
    c.add_argument("files", nargs="+")
    c.add_argument("--split", default="train")
    c.add_argument("--single", action="store_true")
    f = sub.add_parser("fasttext")
    f.add_argument("file")
    f.add_argument("out")
    f.add_argument("--scheme", choices=sorted(L.SCHEMES), required=True)
    for name, command in sub.choices.items():
        command.set_defaults(command=name)
    p.commands = sub.choices
    return p


def read_config(path: str) -> dict[str, dict]:
    """Options by command."""
    if path.endswith(".toml"):
        import tomllib

        with open(path, "rb") as f:
            return tomllib.load(f)
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.config:
        given = read_config(a.config).get(a.command, {})
        unknown = [k for k in given if not hasattr(a, k)]
        if unknown:
            raise ValueError(f"unknown options of {a.command}: {unknown}")
        p.commands[a.command].set_defaults(**given)
        a = p.parse_args(argv)
    commands = {"build": build, "split": split, "merge": merge, "concat": concat, "fasttext": fasttext}
    commands[a.command](SparkSession.builder.appName("dialectry").getOrCreate(), a)


if __name__ == "__main__":
    main()
