import re
import string
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialectry.functions import text as X


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return [r[0] for r in df.select(column(F.col("t")).alias("o"), "k").orderBy("k").select("o").collect()]


def test_masks(spark):
    t = ["see https://a.example.com/x?y=1#z now www.b.org", "mail a.b@c.org ok", "n 12 a3b", None]
    assert run(spark, t, X.mask_urls) == ["see  now ", t[1], t[2], None]
    assert run(spark, t, X.mask_emails)[1] == "mail  ok"
    assert run(spark, t, X.mask_numbers)[2] == "n   a b"
    assert run(spark, t, lambda c: X.mask_numbers(c, "$1"))[2] == "n $1 a$1b"
    with pytest.raises(TypeError):
        X.mask_urls(F.lit("x"), True)


def test_accents_both_forms(spark):
    t = ["éàßœç ﬁ", "ñandú Öl", "áb", "½", None]
    want = [None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if ord(c) < 128) for x in t]
    assert run(spark, t, X.strip_accents) == want
    assert run(spark, t, lambda c: X.strip_accents(c, exact=True)) == want
    assert run(spark, ["ñandú œ"], lambda c: X.strip_accents(c, "unicode")) == ["nandu œ"]
    with pytest.raises(ValueError):
        X.strip_accents(F.lit("x"), "other")


def test_repeats_punctuation_stems(spark):
    assert run(spark, ["ooooh 1111 aab é​éé ééé"], X.collapse_repeats) == ["oh 1 aab é​éé é"]
    assert run(spark, ["l'ostal_b, éà!"], X.remove_punctuation) == ["l ostal b  éà "]
    assert run(spark, ["l'ostal_b, «éà»!"], lambda c: X.remove_punctuation(c, "punct")) == ["l ostal b  «éà» "]
    assert run(spark, ["l'ostal_b,"], lambda c: X.remove_punctuation(c, "keep_apos")) == ["l'ostal b "]
    assert run(spark, ["Lengadocian e NIÇOIS, alenga"], X.remove_stop_stems) == ["  e  , alenga"]


def test_order_of_steps(spark):
    full = lambda c: X.preprocess(c, lowercase=True, accents="ascii", punctuation=True, repeats=True, urls="remove", emails="remove", numbers="remove")
    assert run(spark, ["Éééé 12 xy@y.zz http://a.b/c!", ""], full) == ["ee    ", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aàbB1 _.,!'é\n9", max_size=25), min_size=1, max_size=20))
def test_preprocess_against_plain_python(spark, texts):
    def plain(s):
        s = re.sub(r"(\w)\1{2,}", r"\1", s)
        s = "".join(" " if c in string.punctuation else c for c in s)
        return re.sub(r"\d+", " ", s).lower()

    got = run(spark, texts, lambda c: X.preprocess(c, lowercase=True, repeats=True, punctuation="punct", numbers="remove"))
    assert got == [plain(t) for t in texts]


def test_token_count(spark):
    assert run(spark, ["a , b. ... c", "", None, "$ + x", "   é "], X.token_count) == [3, 0, 0, 1, 1]


def test_paragraphs(spark):
    t = ["ab c\r\nd\r\n\r\nef", "ab\n \ncd", "a\n\nbcd  e", "x  yz kl", "", "  ", None, "ab\r\ncd"]
    assert run(spark, t, X.paragraphs) == [["ab c \nd", "ef"], ["ab", "cd"], ["bcd e"], ["yz kl"], [], [], None, ["ab \ncd"]]


def test_segments(spark):
    assert run(spark, ["Un dos. Tres! 12.\nQuatre? «Cinc» e A. B. foo", None, ""], X.segments) == [["Un dos.", "Tres!", "Quatre?", "«Cinc» e A. B. foo"], None, []]


def test_templates(spark):
    t = ["{{Babel|fr|oc-2}}", "{{Boita d'utilizaire|oc}}", "{{#Babel|oc-M|bòt}}", "{{user oc-3}}", "{{Boita Babel|oc}} {{Utilizaire oc-1}}", "none", None, "{{babel\n|oc-n}}"]
    assert run(spark, t, X.declared_level) == ["2", "N", "M", "3", "1", None, None, "n"]
    assert run(spark, ["{{Boita d'utilizaire|Wikipedian provençau}}", "{{Babel|x}}"], X.declared_variety) == ["provençau", None]
    df = spark.createDataFrame([("Abbott", None), ("x", "{{Babel|bòt}}"), ("x", "bòt"), (None, None)], "u string, p string")
    assert [r[0] for r in df.select(X.is_bot(F.col("u"), F.col("p"))).collect()] == [True, True, False, False]
    assert run(spark, ["a {{Dialècte Vivaroalpenc}} {{Dialècte gascon}}", "{{dialècte x}}"], X.variety_tag) == ["vivaroaupenc", None]
    assert run(spark, ["Utilizaire:Jòrdi B", "x"], X.username_of) == ["Jòrdi B", None]


def test_small_functions(spark):
    assert run(spark, ["L'Òc: 2", "···"], X.slug) == ["l-oc-2", ""]
    df = spark.createDataFrame([("··", 4), ("Ab", 5)], "t string, i long")
    assert [r[0] for r in df.select(X.title_slug(F.col("t"), F.col("i"))).collect()] == ["article-4", "ab-5"]
    assert run(spark, ["2020-01-02T03:04", "", None], X.date_part) == ["2020-01-02", "", None]
    assert run(spark, ["None", "N", "3", None], X.level_number) == [0, 6, 3, 0]
    assert run(spark, ["NULL", "N", "M", None], X.level_rank) == [1, 8, None, None]
    assert run(spark, ["l'ostal, 12!"], X.tokenize) == [["l'", "ostal", ",", "12", "!"]]
    assert X.config_name({"ngrams": 2, "dim": "Big One"}) == "dimbig-one_ngra2"
    assert run(spark, ["a b"], lambda c: X.feature_name(c, "chars")) == ["c_a∅b"]


def test_subwords_are_cut_and_padded(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from dialectry.functions.subwords import subword_ids

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["short", "long words " * 40, "", None]
    got = {r.row_id: r for r in subword_ids(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"), path, max_length=16, pad_id=5).collect()}
    own = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        want = own.encode(t or "").ids[:16] if t is not None else []
        assert got[i].input_ids == want + [5] * (16 - len(want)) and got[i].attention_mask == [1] * len(want) + [0] * (16 - len(want))


def test_exact_accents_hold_few_rows_at_once(spark):
    """Not in Arrow batches, which are bounded in rows and not in bytes."""
    df = spark.createDataFrame([(1, "Òc, ½ ﬁ ệ 가"), (2, None), (3, "plain")], "k long, t string")
    for mode, want in (("ascii", "Oc, 12 fi e "), ("unicode", "Oc, 1⁄2 fi e " + unicodedata.normalize("NFKD", "가"))):
        out = df.select("k", X.strip_accents(F.col("t"), mode, exact=True).alias("t"))
        assert "BatchEvalPython" in spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        assert [r.t for r in out.orderBy("k").collect()] == [want, None, "plain"]
