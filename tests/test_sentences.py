import random

from pyspark.sql import functions as F

from dialectry.functions import text as X
from dialectry.operators import sentences as S


def corpus(seed=1, n=300):
    """Texts whose sentences are known: abbreviations before names and words, initials, ordinals, ellipses."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ba", "co", "da", "fe", "lo", "mi", "sa", "tu"]) for _ in range(rnd.randrange(2, 5))) for _ in range(300)]
    names = ["Bernat", "Guilhem", "Peire", "Raimond", "Azalaís"]
    starts = ["lo", "la", "un", "mas", "puèi"]
    rows = []
    for d in range(n):
        said = []
        for _ in range(rnd.randrange(4, 12)):
            s = [rnd.choice(starts) if rnd.random() < 0.6 else rnd.choice(words)] + rnd.choices(words + starts * 6, k=rnd.randrange(5, 12))
            for _ in range(2):
                if rnd.random() < 0.5:
                    k = rnd.randrange(1, len(s) - 1)
                    s[k:k] = rnd.choice([["st.", rnd.choice(names)], ["mn.", rnd.choice(names)], ["p.ex.", rnd.choice(words)], ["cap.", str(rnd.randrange(90))], [rnd.choice("ABCD") + ".", rnd.choice(names)], ["entre", "3.", rnd.choice(words)]])
            s[0] = s[0].capitalize()
            said.append(" ".join(s) + rnd.choice([".", ".", ".", ".", "!", "?"]))
        rows.append((d, said))
    return rows


def f1(want, got):
    hit = len(want & got)
    return 2 * hit / (len(want) + len(got))


def test_learned_boundaries_beat_the_rule(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, " ".join(s)) for d, s in rows], "doc_id long, text string")
    want = {(d, k) for d, said in rows for k in said}
    model = S.learn(docs)
    got = {(r.doc_id, r.segment) for r in S.sentences(docs, model).collect()}
    rule = {(r.doc_id, r.s) for r in docs.select("doc_id", F.explode(X.segments(F.col("text"))).alias("s")).collect()}
    assert {r.type for r in model.abbreviations.collect() if len(r.type) > 1} == {"st", "mn", "p.ex", "cap"}
    assert f1(want, got) > 0.97 > f1(want, rule) + 0.2
    # texts not learned from
    rows = corpus(seed=2, n=60)
    docs = spark.createDataFrame([(d, " ".join(s)) for d, s in rows], "doc_id long, text string")
    got = {(r.doc_id, r.segment) for r in S.sentences(docs, model).collect()}
    assert f1({(d, k) for d, said in rows for k in said}, got) > 0.9


def test_shape_of_sentences(spark, tmp_path):
    texts = [(1, "Un dos. «Tres quatre.» Cinc!\n\n seis…  sèt \n12 .\n1. 2."), (1, "Un dos."), (None, "Sens id. Òc"), (2, None), (3, ""), (4, " \n . ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    S.learn(docs).save(str(tmp_path))
    model = S.SentenceModel.load(spark, str(tmp_path))
    got = sorted(((r.doc_id or 0, r.pos, r.segment) for r in S.sentences(docs, model).collect()))
    assert got == sorted([(1, 0, "Un dos."), (1, 1, "«Tres quatre.»"), (1, 2, "Cinc!"), (1, 3, "seis… sèt"), (1, 0, "Un dos."), (0, 0, "Sens id."), (0, 1, "Òc")])
    none = docs.where("doc_id > 9")
    assert S.sentences(none, S.learn(none)).count() == 0


def test_tokens_alone_are_those_with_their_neighbours(spark):
    texts = ["Lo Sr. Pons\r\nes aquí.\x0bE  \x1cnos fa\u0085gaug.", "", None, " \t\n", "Sr. Pons"] + [t if isinstance(t, str) else str(t) for t in corpus(2, 5)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {r.token: r.n for r in S.tokens(df).groupBy("token").agg(F.sum("n").alias("n")).collect()}
    assert {r.token: r.n for r in S.token_counts(df).collect()} == want


def test_abbreviations_read_the_texts_once(spark, tmp_path):
    from dialectry.plans import boundaries

    texts = [(i, f"lo st. Gran va {i} al mas. E la fin. ") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = boundaries.sentence_abbreviations(spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in got.inputFiles()) and got.count() >= 1


def test_no_key_of_the_lookups_is_hot(spark):
    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        largest = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        # most words have nothing before them that ends a sentence
        words = spark.range(2000).select(F.concat(F.lit("w"), "id").alias("token"), F.lit(None).cast("string").alias("prev"), F.lit(False).alias("first"), F.lit(1).cast("long").alias("n"))
        short = spark.createDataFrame([("st", 1.0)], "type string, score double")
        got = S.contexts(words, short)
        assert got.count() == 2000 and largest(got) < 1000
        # one type behind every doubtful period
        known = spark.createDataFrame([("hot", 5000, 1, 2, 3, 4, True), *[(f"w{k}", 1, 5, 6, 7, 8, False) for k in range(3000)]], "type string, n long, n_upper long, n_lower long, n_upper_mid long, n_lower_begin long, starter boolean")
        rows = spark.range(4000).select("id", F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.concat(F.lit("w"), F.col("id") * 2 - 3500)).alias("right"))
        got = S._looked_up(rows, known, F.concat(F.lit(" "), "id"))
        assert largest(got) < 2000
        found = {r.id: (r.right, r.n_upper, r.n_lower, r.n_upper_mid, r.n_lower_begin, r.starter) for r in got.collect()}
        known_w = lambda k: (f"w{k}", 5, 6, 7, 8, False) if k < 3000 else (f"w{k}", *[None] * 5)
        assert found == {i: ("hot", 1, 2, 3, 4, True) if i < 3000 else known_w(2 * i - 3500) for i in range(4000)}
    finally:
        for k in put:
            spark.conf.unset(k)
