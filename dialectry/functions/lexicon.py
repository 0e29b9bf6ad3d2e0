"""Word tokens by a lexicon: units of several words, elided forms and enclitics, by longest match.

The lexicon becomes one pattern in the shape of its trie, so the JVM looks at each letter of an entry once and no text
leaves it. A lexicon is a language's closed list: it is refused beyond ``MOST`` entries, as the pattern is part of the plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 5_000
LETTER = r"[\p{L}\p{M}]"


@dataclass(frozen=True)
class Lexicon:
    """``units`` of words parted by spaces (``per amor de``), ``elisions`` before a letter (``l'``), ``enclitics`` behind a word (``-lo``)."""

    units: tuple[str, ...] = ()
    elisions: tuple[str, ...] = ()
    enclitics: tuple[str, ...] = ()

    def pattern(self) -> str:
        """The Java pattern of one token."""
        entries = [*self.units, *self.elisions, *self.enclitics]
        if len(entries) > MOST:
            raise ValueError(f"a lexicon has at most {MOST} entries, not {len(entries)}")
        if any(not e.strip() for e in entries):
            raise ValueError("an entry of the lexicon is empty")
        parts = []
        if self.units:
            parts.append(f"(?<!{LETTER}){_alternatives(self.units)}(?!{LETTER})")
        if self.elisions:
            parts.append(f"(?<!{LETTER}){_alternatives(self.elisions)}(?={LETTER})")
        if self.enclitics:
            parts.append(f"(?<={LETTER}){_alternatives(self.enclitics)}(?!{LETTER})")
        return "(?iU)" + "|".join([*parts, rf"{LETTER}+['’]?", r"\p{N}+", r"[^\s\p{L}\p{M}\p{N}]"])


def _alternatives(entries: tuple[str, ...]) -> str:
    """A pattern for the longest of the entries that ends where the rest of the pattern allows it."""
    trie: dict = {}
    for entry in entries:
        node = trie
        for c in " ".join(entry.lower().replace("’", "'").split()):
            node = node.setdefault(c, {})
        node[""] = {}
    return _branch(trie)


def _branch(node: dict) -> str:
    """The letters that go on; where an entry ends, nothing is the last choice."""
    ways = [_letter(c) + _branch(after) for c, after in sorted(node.items()) if c]
    if not ways:
        return ""
    return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")


def _letter(c: str) -> str:
    return r"\s+" if c == " " else "['’]" if c == "'" else c if c.isalnum() else re.escape(c)


def lexicon_tokens(c: Column, lexicon: Lexicon) -> Column:
    """Tokens in order: the longest unit of the lexicon that ends with a word, else an elided form, an enclitic, a word with its
    apostrophe, a number, or a single other mark. Upper and lower case are alike, and any white space parts a unit's words.

    Null stays null, and a text without anything but white space has none. Our own rule; without a lexicon it is :func:`dialectry.functions.text.tokenize`.
    """
    return F.regexp_extract_all(c, F.lit(lexicon.pattern()), 0)
