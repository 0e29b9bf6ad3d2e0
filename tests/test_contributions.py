import random

import pytest
from pyspark.sql import functions as F

from dialectry.operators import contributions as C
from dialectry.operators import enrich as E
from dialectry.schema import LEVELS
from dialectry.sources import readers

XML = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">
<page><title>Òc e non</title><ns>0</ns><id>1</id>
 <revision><id>10</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>RoBot</username><id>5</id></contributor><text bytes="40">x</text></revision>
 <revision><id>11</id><timestamp>2020-01-02T00:00:00Z</timestamp><contributor><username>Ana</username><id>6</id></contributor><text bytes="300">y</text></revision>
 <revision><id>12</id><timestamp>2020-01-03T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text bytes="299">z {{Dialècte Gascon}} text</text></revision>
 <revision><id>13</id><timestamp>2021-01-03T00:00:00Z</timestamp><contributor deleted="deleted"/><text bytes="299">late</text></revision>
</page>
<page><title>Late</title><ns>0</ns><id>2</id><revision><id>20</id><timestamp>2022-01-01T00:00:00Z</timestamp><contributor><ip>9.9.9.9</ip></contributor><text bytes="3">{{Dialècte gascon}}</text></revision></page>
<page><title>Utilizaire:Ana</title><ns>2</ns><id>3</id><revision><id>30</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>Ana</username><id>6</id></contributor><text bytes="3">{{Babel|oc-3|Wikipedian gascon}}</text></revision></page>
<page><title>Utilizaire:Solet</title><ns>2</ns><id>4</id><revision><id>31</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>Solet</username><id>8</id></contributor><text bytes="3">{{user oc}}</text></revision></page>
<page><title>Talk</title><ns>1</ns><id>9</id><revision><id>40</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><ip>1.1.1.1</ip></contributor><text bytes="3">t</text></revision></page>
</mediawiki>"""


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    import bz2

    path = tmp_path_factory.mktemp("dump") / "pages.xml.bz2"
    path.write_bytes(bz2.compress(XML.encode()))
    return readers.pages_xml(spark, str(path)).cache()


def test_whole_corpus_build(spark, pages):
    arts = C.articles(pages, until="2020-12-31")
    rows = C.contributions(arts)
    assert [(r.pos_revision, r.contributor_id, r.len_bytes, r.diff_bytes) for r in rows.orderBy("pos_revision").collect()] == [(0, "5", 40, 40), (1, "6", 300, 260), (2, "1.2.3.4", 299, -1)]
    people = C.users(pages, rows)
    assert sorted(map(tuple, people.collect())) == [(5, "RoBot", None, None, 1), (6, "Ana", "3", "gascon", 0), (8, "Solet", "N", None, 0)]
    (a,) = C.article_metadata(arts, rows, people).collect()
    assert (a.title_slugify, a.dialect, a.nb_revisions, a.nb_contributors) == ("oc-e-non-1", "gascon", 3, 3)
    assert (a.user_creator_id, a.user_latest_id, a.user_most_contrib_id, a.user_biggest_contrib_id) == ("5", "1.2.3.4", "5", "6")
    assert (a.bot_created, a.bot_first_author, a.bot_nb_revisions, a.user_dialects) == (1, 0, 1, "gascon")
    assert (a.oc_level_first, a.oc_level_max) == (None, "3")
    assert a.user_rank_size == '{"6": 260, "5": 40, "null": 1}'
    first = C.article_metadata(arts, rows, people, order="asc").first()
    assert (first.oc_level_first, first.oc_level_max) == ("3", "3")
    clean = spark.createDataFrame([("x/ocwiki/1", "Un doas.\n\nTres.", "2020-01-03T00:00:00Z"), ("x/ocwiki/7", "q", "d")], "id string, text string, date_modified string")
    full = E.with_clean_text(C.article_metadata(arts, rows, people), E.clean_texts(clean))
    assert tuple(E.date_audit(full).first()) == (1, 0)
    (e,) = E.export(full).collect()
    assert e.paragraphs == ["Un doas.", "Tres."] and e.date_latest_xml == "2020-01-03" and e.user_dialects == ["gascon"]
    assert [tuple(x) for x in e.user_rank_size] == [("6", 260), ("5", 40), ("null", 1)]


def test_filters(spark, pages):
    assert C.articles(pages, until="2019-01-01").count() == 0
    assert C.articles(pages).count() == 1  # the newest text of the first page has no tag
    assert C.articles(pages, keep_without_variety=True, skip_varieties=("gascon",)).select("id").collect()[0][0] == 1
    deleted = C.contributions(C.articles(pages, keep_without_variety=True)).where("page_id = 1 and pos_revision = 3").first()
    assert deleted.contributor_id == "deleted_1_3"
    df = spark.createDataFrame([("N",), ("2",), (None,), ("M",)], "oc_level_max string")
    assert {r[0] for r in C.keep_levels(df, ["NULL", "N"]).collect()} == {"N", None, "M"}
    assert C.keep_levels(df, ["all"]).count() == 4
    with pytest.raises(ValueError):
        C.keep_levels(df, ["7"])
    assert readers.limited(pages, 2).count() == 2 and [x.count() for x in readers.routed(pages)] == [2, 2]


def test_weights_round_half_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (-1, -3, -5, -7, 0, 4)], "d long")
    assert [r[0] for r in df.select(C.contribution_weight(F.col("d"))).collect()] == [1, 2, 2, 4, 1, 4]
    assert [r[0] for r in df.select(C.rank_weight(F.col("d"))).collect()] == [1, 2, 2, 4, 0, 4]


def sequential(rows, order):
    first, top, found = None, None, False
    for r in sorted(rows, key=lambda r: r["pos"], reverse=order == "desc"):
        if r["len"] < 1 or not found and r["len"] < 100:
            continue
        if not found:
            first, found = r["level"], True
        if r["level"] is not None and (top is None or LEVELS.index(r["level"]) > LEVELS.index(top)):
            top = r["level"]
    return first, top


@pytest.mark.parametrize("order", ["desc", "asc"])
def test_levels_and_rankings_against_loops(spark, order):
    r = random.Random(4)
    data = [(p, i, r.choice([None, 1, 2, 3]), r.choice([0, 50, 100, 150, 400]), r.choice([-9, -3, 0, 2, 8])) for p in range(40) for i in range(r.randint(1, 12))]
    level = {1: None, 2: "0", 3: "N", None: None}
    rows = [(p, i, u, ln, df, level[u], None if u is None else int(u == 2)) for p, i, u, ln, df in data]
    df = spark.createDataFrame(rows, "page_id long, pos_revision int, user_id long, len_bytes long, diff_bytes long, oc_level string, is_bot int")
    got = {x.page_id: (x.oc_level_first, x.oc_level_max) for x in C.level_first_max(df, order).collect()}
    for p in range(40):
        assert got[p] == sequential([{"pos": x[1], "len": x[3], "level": x[5]} for x in rows if x[0] == p], order)
    if order == "desc":
        for by in ("freq", "size"):
            ranked = {}
            for x in C.ranking(df, "user_id", by).orderBy("page_id", "rank").collect():
                ranked.setdefault(x.page_id, []).append((x.user_id, x.value))
            for p in range(40):
                count = {}
                for x in sorted((x for x in rows if x[0] == p), key=lambda x: -x[1]):
                    w = 1 if by == "freq" else x[4] if x[4] >= 0 else max(1, round(-x[4] / 2))
                    count[x[2]] = count.get(x[2], 0) + w
                assert ranked[p] == sorted(count.items(), key=lambda kv: -kv[1])
