"""Text functions as Column expressions.

All patterns carry ``(?U)`` where a class must know Unicode letters. Nothing here leaves the JVM but
:func:`strip_accents` in its ``exact`` form.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stems removed by default, with everything that follows them in a word.
DEFAULT_STOP_STEMS = [
    "occitan", "franc", "franç", "aranés", "aranes", "aranais", "lenga", "langu", "lengadocian", "languedocien", "gascon", "lemosin", "limousin", "provença", "provenca", "auvern",
    "vivarés", "vivares", "vivaro", "alpin", "aupenc", "vivaro-alpin", "niçois", "niçar", "nicar", "nicois", "nissar",
]
#: Patterns whose results must agree.
URL = r"(?U)(([A-Za-z]{3,9}://|www\.)[A-Za-z0-9.-]+((?:/[-+~%/.\w_]*)?\??(?:[-+=&;%@.\w_]*)#?(?:[.!/\w]*))?)"
EMAIL = r"(?U)[\w\d][^\s]+@[^\s]+[^\s\W]"
VARIETY_TAG = r"(?U)\{\{Dialècte (\w+)\}\}"
BABEL = r"\{\{#?(?:Babel|Boita d'utilizaire|Boita Babel).*?[|:\s]"
TEMPLATE_END = r"(?:\s*\||\}\})"
USER_PREFIX = r"Utilizaire:(.+)"

#: Line terminators, and the pattern that separates paragraphs: a terminator, then one or more blank lines.
TERMINATORS = r"\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}"
LINE_BREAK = rf"(?>\r\n|[{TERMINATORS}])"
PARAGRAPH_BREAK = rf"(?U){LINE_BREAK}(?:[^\S{TERMINATORS}]*{LINE_BREAK})+"


#: Regex flags: classes know all letters, or ASCII only, which is faster and equal on ASCII texts.
UNICODE, ASCII = "(?U)", ""


def java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def _masked(mode: str, for_remove: str) -> str:
    if not isinstance(mode, str):
        raise TypeError("a mask is 'remove' or the replacement string")
    return for_remove if mode == "remove" else java_replacement(mode)


def mask_urls(c: Column, mode: str = "remove") -> Column:
    found = F.contains(c, F.lit("://")) | F.contains(c, F.lit("www."))
    return F.when(found, F.regexp_replace(c, F.lit(URL), F.lit(_masked(mode, "")))).otherwise(c)


def mask_emails(c: Column, mode: str = "remove") -> Column:
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, F.lit(EMAIL), F.lit(_masked(mode, "")))).otherwise(c)


def mask_numbers(c: Column, mode: str = "remove", flags: str = UNICODE) -> Column:
    return F.regexp_replace(c, F.lit(rf"{flags}\d+"), F.lit(_masked(mode, " ")))


@lru_cache(maxsize=2)
def _accent_tables(ascii_only: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that decompose to one other, their targets, and those that decompose to several."""
    one_from, one_to, several = [], [], []
    blocks = [range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2000, 0x2070), range(0xFB00, 0xFB07)]
    for code in (x for b in blocks for x in b):
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if ascii_only:
            d = "".join(x for x in d if ord(x) < 128)
        if d == c or not d:
            continue
        if len(d) == 1:
            one_from.append(c)
            one_to.append(d)
        else:
            several.append((c, d))
    return "".join(one_from), "".join(one_to), tuple(several)


def strip_accents(c: Column, mode: str = "ascii", exact: bool = False) -> Column:
    """``ascii``: compatibility decomposition, then only ASCII stays; ``unicode``: decomposition without combining marks.

    The default form translates in the JVM and covers Latin letters and marks, general punctuation and Latin ligatures;
    ``exact`` runs the full decomposition in Python, in batches of a hundred rows.
    """
    if mode not in ("ascii", "unicode"):
        raise ValueError(f"unknown accent mode: {mode}")
    if exact:
        return _exact_accents(mode)(c)
    source, target, several = _accent_tables(mode == "ascii")
    out = F.translate(c, source, target)
    spelled = out
    for a, b in several:
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    # few texts hold a character that decomposes to several
    out = F.when(out.rlike("[" + "".join(a for a, _ in several) + "]"), spelled).otherwise(out)
    return F.regexp_replace(out, r"[^\x00-\x7F]+" if mode == "ascii" else r"\p{M}+", "")


def _exact_accents(mode: str) -> Callable[[Column], Column]:
    # a hundred rows at a time: an Arrow batch holds ten thousand, however long their texts are
    @F.udf("string", useArrow=False)
    def strip(t):
        if t is None or t.isascii():
            return t
        normal = unicodedata.normalize("NFKD", t)
        return normal.encode("ascii", "ignore").decode("ascii") if mode == "ascii" else "".join(x for x in normal if not unicodedata.combining(x))

    return strip


def collapse_repeats(c: Column, flags: str = UNICODE) -> Column:
    """Three or more of one word character become one."""
    return F.regexp_replace(c, F.lit(rf"{flags}(\w)\1{{2,}}"), F.lit("$1"))


def remove_punctuation(c: Column, mode: bool | str = True, flags: str = UNICODE) -> Column:
    """True: each non-word character and underscore becomes a space; ``punct``: ASCII punctuation only; ``keep_apos``: that without the apostrophe."""
    if mode is True:
        return F.regexp_replace(c, F.lit(rf"{flags}[\W_]"), F.lit(" "))
    symbols = {"punct": string.punctuation, "keep_apos": string.punctuation.replace("'", "")}[mode]
    return F.translate(c, symbols, " " * len(symbols))


def remove_stop_stems(c: Column, stems: str | list[str] = "default", flags: str = "(?iuU)") -> Column:
    """Words that begin with a stem become a space, whatever their case."""
    if stems == "default":
        stems = DEFAULT_STOP_STEMS
    if not isinstance(stems, list):
        raise TypeError("stems is 'default' or a list")
    return F.regexp_replace(c, F.lit(flags + r"\b(?:" + "|".join(r"\Q" + s + r"\E" for s in sorted(stems, key=len, reverse=True)) + r")\w*"), F.lit(" "))


def preprocess(
    c: Column,
    lowercase: bool = False,
    accents: str | None = None,
    punctuation: bool | str = False,
    repeats: bool = False,
    urls: str | None = None,
    emails: str | None = None,
    numbers: str | None = None,
    stems: str | list[str] | None = None,
    exact_accents: bool = False,
) -> Column:
    """The chosen steps in their fixed order: URLs, e-mails, accents, repeats, punctuation, numbers, case, stop stems."""
    if urls is not None:
        c = mask_urls(c, urls)
    if emails is not None:
        c = mask_emails(c, emails)
    if accents:
        c = strip_accents(c, accents, exact_accents)
    # the ASCII form leaves no other letter for the later steps
    flags = ASCII if accents == "ascii" else UNICODE
    if repeats:
        c = collapse_repeats(c, flags)
    if punctuation:
        c = remove_punctuation(c, punctuation, flags)
    if numbers is not None:
        c = mask_numbers(c, numbers, flags)
    if lowercase:
        c = F.lower(c)
    return remove_stop_stems(c, stems, "(?i)" if accents == "ascii" else "(?iuU)") if stems else c


def preprocess_tokens(tokens: Column, lowercase: bool = False, accents: str | None = None) -> Column:
    """:func:`preprocess` on each element of an array."""
    return F.transform(tokens, lambda t: preprocess(t, lowercase=lowercase, accents=accents))


def tokenize(c: Column) -> Column:
    """Words with an elided apostrophe kept (``l'``), numbers, and single other marks. Our own rule."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[\p{L}\p{M}]+['’]?|\p{N}+|[^\s\p{L}\p{M}\p{N}]"), 0)


def long_enough(c: Column, more_than: int = 3) -> Column:
    """Texts with more words and marks than that."""
    return F.size(tokenize(c)) > more_than


def has_letters(c: Column, required: int = 2) -> Column:
    return c.rlike(r"(?s)\p{L}" + r".*?\p{L}" * (required - 1))


def token_count(c: Column) -> Column:
    """White-space separated tokens that aren't punctuation only; null and empty have none."""
    punct = r"^[\p{P}$+<=>^`|~]+$"
    tokens = F.split(F.coalesce(c, F.lit("")), r"(?U)\s+")
    return F.size(F.filter(tokens, lambda t: (t != "") & ~t.rlike(punct))).cast("long")


def tidy(c: Column) -> Column:
    """Strip, then every run of white space but line feeds becomes one space; text that is tidy already is only looked at."""
    stripped = F.regexp_replace(c, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    return F.when(c.rlike(r"(?U)^\s|\s$|[^\S\n ]|  "), F.regexp_replace(stripped, F.lit(r"(?U)[^\S\n]+"), F.lit(" "))).otherwise(c)


def paragraphs(c: Column) -> Column:
    """Texts between blank lines that hold two letters; null stays null, a blank text has none."""
    parts = F.split(c, PARAGRAPH_BREAK)
    return F.transform(F.filter(parts, lambda p: has_letters(p)), tidy)


def segments(c: Column) -> Column:
    """Sentences of each line that hold two letters. Our own rule: a break follows ``.``, ``!``, ``?`` or ``…``, closing quotes and white space, before an upper-case letter, digit or opening mark."""
    lines = F.split(c, LINE_BREAK)
    cut = r"(?U)(?<=[.!?…])(?<!\b\p{Lu}\.)\s+(?=[\p{Lu}\p{N}«“\"'(\[¿¡-])"
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, cut)))
    return F.transform(F.filter(sentences, lambda p: has_letters(p)), tidy)


def normalise_spaces(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"(?U)\s+"), F.lit(" "))


def variety_tag(c: Column) -> Column:
    """The variety named by the first tag of a page, lower-cased and in its normal spelling; null without a tag."""
    from dialectry.schema import NORMALISED_VARIETIES

    tag = F.nullif(F.lower(F.regexp_extract(c, VARIETY_TAG, 1)), F.lit(""))
    for variant, normal in NORMALISED_VARIETIES.items():
        tag = F.when(tag == variant, F.lit(normal)).otherwise(tag)
    return tag


def declared_level(c: Column) -> Column:
    """The level a user page declares: of the first template, else of the second; ``N`` if named without one; null if not named."""
    first = rf"(?isU){BABEL}oc(?:-(\d|N|M))?{TEMPLATE_END}"
    second = r"(?isU)\{\{(?:Utilizaire|user) oc(?:-([\dNM]))?\}\}"
    one, two = F.regexp_extract(c, first, 1), F.regexp_extract(c, second, 1)
    return F.when(one != "", one).when(c.rlike(second), F.when(two != "", two).otherwise("N")).when(c.rlike(first), F.lit("N"))


def declared_variety(c: Column) -> Column:
    """The variety a user page declares, as written."""
    return F.nullif(F.regexp_extract(c, rf"(?U){BABEL}Wikipedian(?:\s+(\w+))?{TEMPLATE_END}", 1), F.lit(""))


def is_bot(username: Column, page: Column | None = None) -> Column:
    """The name holds ``bot`` in any case, or the page declares it."""
    named = F.coalesce(F.instr(F.lower(username), "bot") > 0, F.lit(False))
    return named if page is None else named | F.coalesce(page.rlike(rf"(?U){BABEL}bòt{TEMPLATE_END}"), F.lit(False))


def username_of(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, USER_PREFIX, 1), F.lit(""))


def slug(c: Column) -> Column:
    plain = F.lower(strip_accents(F.regexp_replace(c, "['’]", "-"), "ascii"))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_slug(title: Column, page_id: Column) -> Column:
    s = slug(title)
    return F.concat(F.when(s == "", F.lit("article")).otherwise(s), F.lit("-"), page_id.cast("string"))


def visible_chars(c: Column, mark: str = "∅") -> Column:
    return F.replace(c, F.lit(" "), F.lit(mark))


def feature_name(c: Column, kind: str) -> Column:
    """``c_`` with visible spaces for character features, ``w_`` for words."""
    return F.concat(F.lit("c_"), visible_chars(c)) if kind.startswith("c") else F.concat(F.lit("w_"), c)


def config_name(params: dict) -> str:
    """File name of a configuration: sorted names cut to four letters, each with its slugged value."""
    parts = []
    for key in sorted(params):
        value = re.sub(r"[^a-z0-9]+", "-", str(params[key]).lower()).strip("-")
        parts.append(f"{key[:4]}{value}")
    return "_".join(parts)


def config_name_of(params: Column) -> Column:
    """:func:`config_name` of a map column; null values count as empty."""
    value = lambda e: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(e["value"], F.lit(""))), F.lit("[^a-z0-9]+"), F.lit("-")), F.lit("^-+|-+$"), F.lit(""))
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(F.substring(e["key"], 1, 4), value(e))), "_")


def date_part(c: Column) -> Column:
    """An ISO time cut at ``T``; null and empty stay."""
    return F.substring_index(c, "T", 1)


def level_number(c: Column) -> Column:
    """``None`` is 0, ``N`` is 6, digits are themselves."""
    return F.when(c.isNull() | (c == "None"), F.lit(0)).when(c == "N", F.lit(6)).otherwise(c.try_cast("int"))


def level_rank(c: Column) -> Column:
    """Place in the order of levels; null for others."""
    from dialectry.schema import LEVELS

    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), c), F.lit(0))
