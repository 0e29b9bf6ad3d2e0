import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from dialectry.functions import text as X
from dialectry.functions.lexicon import MOST, Lexicon, lexicon_tokens

LEXICON = Lexicon(("per amor de", "per amor", "per", "a l'entorn", "i a"), ("l'", "d'", "qu'"), ("-lo", "-lo-me", "-z-en"))


def letter(c):
    return unicodedata.category(c)[0] in "LM"


def longest(text, at, entries):
    """The end of the longest entry at a place, which no letter follows."""
    best = None
    for e in entries:
        i = at
        for c in e:
            if c == " ":
                j = i
                while i < len(text) and text[i].isspace():
                    i += 1
                if i == j:
                    break
            elif i < len(text) and (text[i].lower() == c or (c == "'" and text[i] == "’")):
                i += 1
            else:
                break
        else:
            best = max(best or 0, i) if i == len(text) or not letter(text[i]) else best
    return best


def brute(text, lex):
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        inside = i > 0 and letter(text[i - 1])
        end = longest(text, i, lex.enclitics if inside else lex.units)
        if end is None and not inside:
            ends = [i + len(e) for e in lex.elisions if text[i : i + len(e)].lower().replace("’", "'") == e and letter(text[i + len(e) : i + len(e) + 1] or " ")]
            end = max(ends, default=None)
        if end is None:
            end, kind = i + 1, letter if letter(text[i]) else str.isnumeric if text[i].isnumeric() else None
            while kind and end < len(text) and kind(text[end]):
                end += 1
            if kind is letter and text[end : end + 1] in ("'", "’"):
                end += 1
        out.append(text[i:end])
        i = end
    return out


def test_longest_match(spark):
    r = random.Random(3)
    parts = ["per", "Per", "amor", "de", "a", "l'", "L’", "entorn", "i", "d'", "òme", "qu'", "aiga", "dona", "-lo", "-LO", "-me", "-z-en", "-", "'", ".", "12", "2", "x", "\n", "  ", " ", " ", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for k, tokens in df.select("k", lexicon_tokens(F.col("t"), LEXICON)).collect():
        assert tokens == brute(texts[k], LEXICON), texts[k]


def test_edges(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \n"), (3, "per amor " * 20_000), (4, "Dona-lo-me per  amor\nde l’aiga.")], "k long, t string")
    got = {k: t for k, t in df.select("k", lexicon_tokens(F.col("t"), LEXICON)).collect()}
    assert got[0] is None and got[1] == got[2] == [] and got[3] == ["per amor"] * 20_000
    assert got[4] == ["Dona", "-lo-me", "per  amor\nde", "l’", "aiga", "."]
    plain = df.select(lexicon_tokens(F.col("t"), Lexicon()).alias("a"), X.tokenize(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in plain)
    with pytest.raises(ValueError):
        Lexicon(("a",) * (MOST + 1)).pattern()
    with pytest.raises(ValueError):
        Lexicon((" ",)).pattern()
