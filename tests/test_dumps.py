import bz2
import gzip

import pytest

from dialectry.sources import readers as R
from dialectry.sources.dumps import pages_split


def dump(n):
    out = ['<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" xml:lang="oc">\n  <siteinfo><sitename>x</sitename></siteinfo>\n']
    for i in range(n):
        revisions = "".join(
            f"<revision><id>{i * 10 + k}</id><timestamp>2024-01-0{k + 1}T00:00:00Z</timestamp><contributor>"
            + ('<username>a&amp;b</username><id>7</id>' if k % 2 else "<ip>10.0.0.1</ip>")
            + f'</contributor><text bytes="{i + k}" xml:space="preserve">{{{{Dialècte gascon}}}} &lt;/page&gt; &lt;page&gt;\n\n é{"𝒳" * (i % 5)} {"mot " * (i * 7 % 400)}</text></revision>'
            for k in range(i % 4)
        )
        out.append(f"  <page>\n    <title>T {i}</title>\n    <ns>{i % 3}</ns>\n    <id>{i}</id>\n    {revisions}\n  </page>\n")
    return "".join(out) + "</mediawiki>\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base, text = tmp_path_factory.mktemp("dumps"), dump(3000).encode()
    (base / "a.xml").write_bytes(text)
    (base / "a.xml.bz2").write_bytes(bz2.compress(text, 1))
    (base / "a.xml.gz").write_bytes(gzip.compress(text))
    (base / "none.xml").write_text("<mediawiki>\n</mediawiki>")
    return base


def rows(df):
    return sorted(df.collect(), key=lambda r: r.id)


def test_one_file_is_read_by_many_tasks(spark, files):
    want = rows(R.pages_xml(spark, str(files / "a.xml")))
    assert len(want) == 3000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for name, size in (("a.xml", "20011"), ("a.xml", "150000"), ("a.xml.bz2", "3001"), ("a.xml.bz2", "20011"), ("a.xml.gz", "20011")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = pages_split(spark, str(files / name))
            assert rows(got) == want
            assert (got.rdd.getNumPartitions() > 3) == (name != "a.xml.gz")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_filters_before_parsing(spark, files):
    path = str(files / "a.xml.bz2")
    want = rows(R.pages_xml(spark, path))
    assert rows(pages_split(spark, path, (0, 2))) == [r for r in want if r.ns in (0, 2)]
    assert rows(pages_split(spark, path, (1,), (100, 220))) == [r for r in want if r.ns == 1 and 100 <= r.id <= 220]
    assert pages_split(spark, str(files / "none.xml")).count() == 0


def test_a_broken_page_fails(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<mediawiki><page><title>a</titl><ns>0</ns><id>1</id></page></mediawiki>")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        pages_split(spark, str(tmp_path / "x.xml")).collect()
