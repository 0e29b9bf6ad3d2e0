"""Sentence boundaries learned from the texts themselves, without labels.

After the published method of Kiss and Strunk (2006), as aggregates and joins: a word type is an abbreviation if
its occurrences hold to a final period by far more than chance lets expect, weighed by its length, its
inner periods and its occurrences without period. After an abbreviation, an initial, an ordinal or an
ellipsis, the word on the right decides: how it is written elsewhere (orthography), whether it follows that word
time and again (collocation), and whether it often begins sentences (starter).

Tables are joined by word type. Small ones are broadcast by Spark's own check of their size; larger ones are
shuffled. Texts meet once in one exchange, by an own row number, to join the pieces between periods that end no sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.functions.text import LINE_BREAK, TERMINATORS, has_letters, tidy
from dialectry.sources.scratch import stored

#: Fixed values of the published method: least scores, and the share of periods that an abbreviation has.
ABBREVIATION, COLLOCATION, STARTER, WITH_PERIOD = 0.3, 7.88, 30.0, 0.99
#: The type of all numbers.
NUMBER = "##"
#: The share of all occurrences from which a type is looked up by broadcast.
FREQUENT = 1 / 2000
CLOSING = "\"'»”’)]"
#: A space behind a mark that may end a sentence and up to three closing marks.
PIECE_BREAK = r" (?<=[.!?…][\"'»”’)\]]{0,3} )"


def core(token: Column) -> Column:
    """The token without marks before its first letter or digit and behind its last; periods at the end stay."""
    return F.regexp_replace(token, F.lit(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"), F.lit(""))


def word_type(c: Column) -> Column:
    """The type of a token's core: lower-cased, without final periods, all numbers alike; empty for marks only."""
    return F.regexp_replace(F.lower(F.rtrim(c, F.lit("."))), F.lit(r"^\p{N}[\p{N}.,]*$"), F.lit(NUMBER))


def has_period(c: Column) -> Column:
    """A core with one final period; an ellipsis has none."""
    return F.endswith(c, F.lit(".")) & ~F.endswith(c, F.lit("..")) & (c != ".")


def is_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def is_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def ending(token: Column) -> Column:
    """How a token may end a sentence: ``period``, ``strong`` (! and ?), ``ellipsis``, or null; closing marks aside."""
    bare = F.rtrim(token, F.lit(CLOSING))
    last = F.right(bare, F.lit(1))
    return F.when(last.isin("!", "?"), "strong").when((last == "…") | F.endswith(bare, F.lit("..")), "ellipsis").when(last == ".", "period")


#: The characters that a token which may end a sentence ends with.
LAST = list(".!?…" + CLOSING)


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, prev, first, n): the white-space separated tokens of all lines with their occurrences.

    ``prev`` is the token before, if that may end a sentence; ``first`` tells the first of a line. All
    later steps look at distinct tokens only.
    """
    lines = docs.select(F.explode(F.split(text, LINE_BREAK)).alias("line"))
    split = lines.select(F.filter(F.split("line", r"(?U)\s+"), lambda t: t != "").alias("token"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("token")).alias("prev")
    pairs = split.where(F.size("token") > 0).select(F.explode(F.arrays_zip("token", before)).alias("p")).where("p.token is not null")
    marked = F.when(F.right("p.prev", F.lit(1)).isin(LAST), F.col("p.prev"))
    return pairs.select("p.token", marked.alias("prev"), F.col("p.prev").isNull().alias("first")).groupBy("token", "prev", "first").agg(F.count(F.lit(1)).alias("n"))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): the tokens alone, where nothing asks for what stands before them."""
    split = docs.select(F.explode(F.split(text, rf"(?U)[\s{TERMINATORS}]+")).alias("token")).where("token <> ''")
    return split.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _n_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))), F.lit(0))


def type_counts(words: DataFrame) -> DataFrame:
    """(type, n_period, n_plain): occurrences with a final period and without; ``words`` are those of :func:`tokens` or :func:`token_counts`."""
    each = words.groupBy("token").agg(F.sum("n").alias("n")).select(core(F.col("token")).alias("c"), "n")
    rows = each.select(word_type(F.col("c")).alias("type"), has_period(F.col("c")).alias("p"), "n").where("type <> ''")
    return rows.groupBy("type").agg(_n_if(F.col("p")).alias("n_period"), _n_if(~F.col("p")).alias("n_plain"))


def binomial(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the likelihood of k of n at probability p; 0 times the logarithm of 0 is 0."""
    part = lambda x, q: F.when(x <= 0, F.lit(0.0)).otherwise(x * F.log(q))
    return part(k, p) + part(n - k, 1 - p)


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, score) of the types taken for abbreviations; ``counts`` are those of :func:`type_counts`, which are read twice and should be stored."""
    total, periods = counts.agg(F.sum(F.col("n_period") + F.col("n_plain")), F.sum("n_period")).first()
    if not total or not periods or periods == total:
        return counts.select("type", F.lit(0.0).alias("score")).where(F.lit(False))
    n, with_period = F.col("n_period") + F.col("n_plain"), F.col("n_period")
    gain = 2 * (binomial(with_period, n, F.lit(WITH_PERIOD)) - binomial(with_period, n, F.lit(periods / total)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = gain * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("n_plain"))
    scored = counts.where((F.col("n_period") > 0) & F.col("type").rlike(r"\p{L}")).select("type", score.alias("score"))
    return scored.where(F.col("score") >= ABBREVIATION)


def contexts(words: DataFrame, abbreviated: DataFrame) -> DataFrame:
    """(type, left, inner, unsure, upper, lower, place, n): words with what stands before them.

    ``place`` is ``begin`` behind a sentence's end or at the start of a line, ``mid`` inside a sentence, null where that is not
    known (behind abbreviations, initials, numbers and ellipses); ``left`` is the type before a period.
    """
    rows = words.select(core(F.col("token")).alias("c"), core(F.col("prev")).alias("pc"), "first", "n", ending(F.col("prev")).alias("end"))
    rows = rows.withColumn("left", F.when(has_period(F.col("pc")), word_type(F.col("pc"))))
    # most words have no period before them: a key of their own, which no type is, spreads them if the join is shuffled
    key = F.coalesce("left", F.concat(F.lit(" "), "c"))
    rows = rows.join(abbreviated.select(F.col("type").alias("_t"), F.lit(True).alias("_a")), key == F.col("_t"), "left")
    unsure = F.coalesce(F.col("_a").isNotNull() | (F.col("end") == "ellipsis") | _initial(F.col("left")) | (F.col("left") == NUMBER), F.lit(False))
    place = F.when(F.col("first"), "begin").when(unsure, F.lit(None)).when(F.col("end").isNotNull(), "begin").otherwise("mid")
    return rows.select(word_type(F.col("c")).alias("type"), "left", (~F.col("first")).alias("inner"), unsure.alias("unsure"), is_upper(F.col("c")).alias("upper"), is_lower(F.col("c")).alias("lower"), place.alias("place"), "n").where("type <> ''")


def _initial(t: Column) -> Column:
    return t.rlike(r"^\p{L}$")


def _gain(n1: Column, n2: Column, n12: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of the second following the first more often than chance lets expect; 0 where less often."""
    p, p1, p2 = n2 / n, n12 / n1, (n2 - n12) / (n - n1)
    ratio = 2 * (binomial(n12, n1, p1) + binomial(n2 - n12, n - n1, p2) - binomial(n12, n1, p) - binomial(n2 - n12, n - n1, p))
    return F.when((n > n1) & (p1 > p), ratio).otherwise(F.lit(0.0))


def orthography(rows: DataFrame) -> DataFrame:
    """(type, n, n_upper, n_lower, n_upper_mid, n_lower_begin, n_start, starter) of all types; ``rows`` are those of :func:`contexts`."""
    begins = (F.col("place") == "begin") & F.col("inner")
    per = rows.groupBy("type").agg(
        F.sum("n").alias("n"), _n_if(F.col("upper")).alias("n_upper"), _n_if(F.col("lower")).alias("n_lower"), _n_if(F.col("upper") & (F.col("place") == "mid")).alias("n_upper_mid"),
        _n_if(F.col("lower") & (F.col("place") == "begin")).alias("n_lower_begin"), _n_if(begins).alias("n_start"),
    )
    per = stored(per, "orthography")
    total, starts = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_start"), F.lit(0))).first()
    gain = _gain(F.lit(float(starts)), F.col("n").cast("double"), F.col("n_start").cast("double"), F.lit(float(total)))
    return per.withColumn("starter", F.when(F.col("n_start") > 0, gain >= STARTER).otherwise(F.lit(False)))


def collocations(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(left, type) of words that follow an abbreviation, initial or number with a period time and again."""
    lefts = rows.where(F.col("left").isNotNull() & F.col("unsure")).groupBy("left", "type").agg(F.sum("n").alias("n12"))
    n1 = lefts.groupBy("left").agg(F.sum("n12").alias("n1"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_ = lefts.where("n12 > 1").join(n1, "left").join(known.select("type", "n"), "type")
    number = lambda c: F.col(c).cast("double")
    return all_.where(_gain(number("n1"), number("n"), number("n12"), F.lit(float(total))) >= COLLOCATION).select("left", "type")


@dataclass
class SentenceModel:
    """The learned tables, stored: abbreviations, orthography with starters, and collocations."""

    abbreviations: DataFrame
    orthography: DataFrame
    collocations: DataFrame

    def save(self, path: str) -> None:
        for name in ("abbreviations", "orthography", "collocations"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SentenceModel:
        return SentenceModel(*(spark.read.parquet(f"{path}/{name}") for name in ("abbreviations", "orthography", "collocations")))


def learn(docs: DataFrame, text: str = "text") -> SentenceModel:
    """Learn from all texts, in one pass over them."""
    words = stored(tokens(docs, text), "tokens")
    short = stored(abbreviations(stored(type_counts(words), "types")), "abbreviations")
    rows = contexts(words, short)
    known = stored(orthography(rows), "orthography")
    return SentenceModel(short, known, stored(collocations(rows, known), "collocations"))


def is_break() -> Column:
    """Whether a sentence ends between two pieces, from the joined columns (see :func:`sentences`)."""
    number = lambda c: F.coalesce(c, F.lit(0))
    lower, upper = number("n_lower"), number("n_upper")
    begins = F.col("upper") & (lower > 0) & (number("n_upper_mid") == 0)
    goes_on = F.col("mark") | (F.col("lower") & ((upper > 0) | (number("n_lower_begin") == 0)))
    starts = begins | (F.col("upper") & F.coalesce("starter", F.lit(False)))
    after_short = ~F.col("pair") & starts & ~goes_on
    after_initial = ~F.col("pair") & ~goes_on & ~(F.col("initial") & F.col("upper") & (lower == 0) & ~begins)
    short = F.col("short") | (F.col("end") == "ellipsis")
    return F.when(F.col("end") == "strong", True).when(short, after_short).when(F.col("initial") | F.col("number"), after_initial).otherwise(True)


def _looked_up(rows: DataFrame, known: DataFrame, own: Column) -> DataFrame:
    """``rows`` with the orthography of the type ``right``.

    The types with a share of ``FREQUENT`` of all occurrences are broadcast, at most one in that share. In the texts learned from no other
    type has more rows than that share of the tokens, so no key of the second join is hot. ``own`` are keys that no type is.
    """
    values = ["n_upper", "n_lower", "n_upper_mid", "n_lower_begin", "starter"]
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_frequent = F.col("n") >= F.lit(FREQUENT * total)
    frequent = known.where(is_frequent).select(F.col("type").alias("right"), F.struct(*values).alias("_frequent"))
    others = known.where(~is_frequent).select(F.col("type").alias("_key"), F.struct(*values).alias("_other"))
    rows = rows.join(F.broadcast(frequent), "right", "left").withColumn("_key", F.when(F.col("_frequent").isNull(), F.col("right")).otherwise(own))
    rows = rows.join(others, "_key", "left").withColumn("_found", F.coalesce("_frequent", "_other"))
    return rows.withColumns({c: F.col(f"_found.{c}") for c in values}).drop("_key", "_frequent", "_other", "_found")


def sentences(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, segment): the sentences with two letters of every line of every text, tidied, in order from 0.

    Repeated and null ids are rows of their own; a null or blank text has no sentence.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.split(text, LINE_BREAK).alias("lines"))
    lines = numbered.select("_row", "_id", F.posexplode("lines").alias("_line", "line")).select("_row", "_id", "_line", tidy(F.col("line")).alias("line")).where("line <> ''")
    split = lines.select("_row", "_id", "_line", F.split("line", PIECE_BREAK).alias("piece"))
    rows = split.select("_row", "_id", "_line", F.posexplode(F.arrays_zip("piece", F.slice("piece", F.lit(2), F.size("piece")).alias("next"))).alias("_k", "p"))
    rows = rows.select("_row", "_id", "_line", "_k", F.col("p.piece").alias("piece"), F.substring_index("p.piece", " ", -1).alias("lt"), F.substring_index("p.next", " ", 1).alias("rt"))
    rows = rows.select("_row", "_id", "_line", "_k", "piece", ending(F.col("lt")).alias("end"), core(F.col("lt")).alias("lc"), core(F.col("rt")).alias("rc"), F.col("rt").isNull().alias("last"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.select(
        "_row", "_id", "_line", "_k", "piece", "end", "last", F.when(has_period(F.col("lc")), word_type(F.col("lc"))).alias("left"), word_type(F.col("rc")).alias("right"),
        sure(is_upper(F.col("rc"))).alias("upper"), sure(is_lower(F.col("rc"))).alias("lower"), sure(F.col("rc") == "").alias("mark"),
    )
    short = model.abbreviations.select(F.col("type").alias("left"), F.lit(True).alias("short"))
    rows = rows.join(short, "left", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    rows = rows.withColumn("initial", F.coalesce(_initial(F.col("left")), F.lit(False))).withColumn("number", F.coalesce(F.col("left") == NUMBER, F.lit(False)))
    # only what stands behind a doubtful period is looked up; all other rows get keys of their own, which spread them
    doubtful = ~F.col("last") & (F.col("short") | F.col("initial") | F.col("number") | (F.col("end") == "ellipsis"))
    own = F.concat_ws(" ", F.lit(""), "_row", "_line", "_k")
    rows = rows.withColumn("right", F.when(doubtful, F.col("right")).otherwise(own))
    rows = _looked_up(rows, model.orthography, own)
    pairs = model.collocations.select("left", F.col("type").alias("right"), F.lit(True).alias("pair"))
    rows = rows.join(pairs, ["left", "right"], "left").withColumn("pair", F.coalesce("pair", F.lit(False)))
    cut = rows.select("_row", "_id", "_line", "_k", "piece", (F.col("last") | is_break()).alias("cut"))
    order = Window.partitionBy("_row").orderBy("_line", "_k")
    placed = cut.withColumn("_s", F.coalesce(F.count_if("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = placed.groupBy("_row", "_s").agg(F.first("_id").alias(id_col), F.array_sort(F.collect_list(F.struct("_line", "_k", "piece"))).alias("ps"))
    joined = whole.select("_row", "_s", id_col, F.array_join(F.transform("ps", lambda p: p["piece"]), " ").alias("segment")).where(has_letters(F.col("segment")))
    pos = F.row_number().over(Window.partitionBy("_row").orderBy("_s")) - 1
    return joined.select(id_col, pos.cast("int").alias("pos"), "segment")
