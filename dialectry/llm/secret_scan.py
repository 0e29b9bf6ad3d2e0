"""Secret scan: candidates by patterns, false positives removed by a random forest.

Candidates are passwords inside URLs, and values of eight characters or more, however long, that are
assigned to a name or stand free, if they have a secret-like name or a secret-like word shortly before
them, or else hold a digit (and are 16 characters long and more than a number where they have no name).
The forest sees a candidate's length, its character classes and transitions, how much of it dictionary
words cover, the path of the file and the words before it. It is trained in numpy on labelled findings,
which are made by the rules of ``labelled_findings`` from lists of their own, as the tables have none;
every process gets the same forest.

Defined results: a null or empty text has no finding; a null path says nothing; a score equal to the
threshold counts as a secret; candidates don't overlap; repeated rows give repeated findings; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed word lists.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "client_secret", "bearer", "passphrase")
PLAIN_NAMES = ("sha", "sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "rev", "hash", "etag", "id", "uuid", "guid", "version", "build", "isbn", "doi", "phone", "date", "order", "serial", "color", "integrity")
DUMMY = ("example", "sample", "dummy", "placeholder", "changeme", "your", "xxxx", "test", "fake", "todo", "insert", "here", "1234", "abcd")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.")
COMMON = (
    "the and for you not with this that from have are was will can all any get set new key name value user data file path line code test type list string number index count first last next start end open close read write load save time date day year month page home main base root node text word image button color width height size map view item group table "
    "array object class function method return config option default server client host port request response error message login admin public local global service manager handler factory builder update delete create insert select query result session cookie token secret password"
).split()

NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
CANDIDATE = re.compile(rf"(?:(?P<name>{NAME})[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*)?(?P<quote>[\"'`]?)(?P<value>[A-Za-z0-9+/_=.~$!%^*-]{{8,}})")
IN_URL = re.compile(r"[a-zA-Z]://[^\s:/@\"'<>]*:(?P<value>[^\s:/@\"'<>]{4,})@")
HINT = re.compile(r"(?i)token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|private).?key|credential|bearer")
#: Texts that this doesn't match hold no candidate.
MAYBE = r"[0-9]|://|(?i:token|secret|passw|passphrase|pwd|(?:api|access|private).?key|auth|credential|bearer)"
NEAR = 24  #: a secret-like word counts for a value that begins at most so many characters behind it


def _secret_name(name: str) -> bool:
    return any(n in name for n in SECRET_NAMES)


def candidates(text: str):
    """(start, end, value, name, quoted, words before, in a URL) of every candidate, in order."""
    urls = [m.span("value") for m in IN_URL.finditer(text)] if "://" in text else []
    hints, at, k = [m.end() for m in HINT.finditer(text)], 0, 0
    before = lambda i: text[max(0, i - 60) : i].lower()
    for m in CANDIDATE.finditer(text):
        start = m.start("value")
        while k < len(urls) and urls[k][1] <= start:
            yield *urls[k], text[slice(*urls[k])], "", False, before(urls[k][0]), True
            k += 1
        value, name = m["value"], (m["name"] or "").lower()
        stripped = value.rstrip(".,!*%$")
        if len(stripped) < 8 or k < len(urls) and urls[k][0] < start + len(stripped):
            continue
        while at < len(hints) and hints[at] <= m.start():
            at += 1
        told = bool(name) and _secret_name(name) or at > 0 and hints[at - 1] >= m.start() - NEAR
        if not told and (not any(c.isdigit() for c in stripped) or not name and (len(stripped) < 16 or stripped.isdigit())):
            continue
        yield start, start + len(stripped), stripped, name, bool(m["quote"]), before(m.start()), False
    for span in urls[k:]:
        yield *span, text[slice(*span)], "", False, before(span[0]), True


def _classes(value: str) -> np.ndarray:
    return np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value])


def _cover(value: str) -> float:
    """Share of characters inside dictionary words of four letters or more."""
    low, covered = value.lower(), np.zeros(len(value), dtype=bool)
    for w in COMMON:
        if len(w) >= 4:
            at = low.find(w)
            while at >= 0:
                covered[at : at + len(w)] = True
                at = low.find(w, at + 1)
    return float(covered.mean())


#: Pairs of adjacent letters of the dictionary words.
PAIRS = frozenset(w[i : i + 2] for w in COMMON for i in range(len(w) - 1))


def features(value: str, name: str, quoted: bool, before: str, path: str, in_url: bool = False) -> list[float]:
    kinds, n = _classes(value), len(value)
    share = np.bincount(kinds, minlength=4) / n
    counts = np.unique(list(value), return_counts=True)[1] / n
    low, path = value.lower(), (path or "").lower()
    near = re.findall(r"[a-z0-9_]+", before)[-4:]
    letters = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    return [
        math.log(n), *share, float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, float(-(counts * np.log2(counts)).sum()),
        float(all(c in "0123456789abcdef-" for c in low)), float(value.count("-") == 4 and n == 36), float(counts.max()), _cover(value),
        sum(value.count(c) for c in "._/") / n, float(any(value.startswith(p) for p in PREFIXES)), float(bool(name)), float(quoted), float(_secret_name(name)),
        float(any(name == p or name.endswith(("_" + p, "-" + p, "." + p)) for p in PLAIN_NAMES)), float(any(d in low for d in DUMMY)),
        float(any(_secret_name(w) for w in near)), float(any(w in PLAIN_NAMES for w in near)), float(any(w in DUMMY for w in near)),
        float(any(p in path for p in ("test", "example", "sample", "fixture", "doc"))), float(any(p in path for p in (".lock", "sum", "package", "vendor"))), float(any(p in path for p in (".env", "config", "settings", "credential", "secret"))),
        float(sum(a in "aeiou" for a in low) / n), float(in_url), float(value.isalpha()), sum(p in PAIRS for p in letters) / max(1, len(letters)), float(value.islower()),
    ]


class FindingMaker:
    """Labelled findings by rule. Its words, names and paths are its own, not those that the features look for."""

    OBJECTS = "stripe mail deploy billing github storage search graph push redis cluster tenant partner webhook session ledger".split()
    WORDS = "amber basil cedar dune ember fjord grove harbor island jasper kettle lagoon meadow nectar orchard pepper quartz ribbon saddle timber umber valley willow yarrow zephyr".split()
    PARTS = "enable required undefined default optional disabled unknown empty value field string header column handler provider session manager".split()

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, of):
        return of[int(self.r.integers(0, len(of)))]

    def draw(self, letters: str, k: int) -> str:
        return "".join(letters[i] for i in self.r.integers(0, len(letters), k))

    def name(self, last: str) -> str:
        return self.pick([last, f"{self.pick(self.OBJECTS)}_{last}", f"{self.pick(self.OBJECTS)}-{last}", f"{self.pick(self.OBJECTS)}.{last}", f"{last}_{self.pick(self.OBJECTS)}", f"{self.pick(self.OBJECTS)}{last}"])

    def prose(self) -> str:
        return " ".join(self.pick(["we", "use", "in", "la", "der", "le", "y", "then", "it", "of", "mit", *self.WORDS]) for _ in range(int(self.r.integers(0, 5)))) + self.pick(["", " "])

    SECRETS = ("hex", "letters", "base64", "password", "passphrase", "prefix", "url", "told")
    PLAIN = ("digest", "uuid", "placeholder", "identifier", "number", "path", "commit", "fixture", "word", "code", "plain url")

    def make(self, kind: str) -> tuple[str, str, bool, str, str, bool]:
        """(value, name, quoted, words before, path, in a URL) of one finding."""
        r, digits, low = self.r, "0123456789", "abcdefghijklmnopqrstuvwxyz"
        hexa, every = digits + "abcdef", digits + low + low.upper()
        secret = lambda: self.name(self.pick(["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "auth", "credential", "private_key", "client_secret", "passphrase"]))
        plain = lambda: self.name(self.pick(["id", "sha", "checksum", "version", "hash", "ref", "total", "title", "kind", "path", "width"]))
        path = self.pick(["", "", "", "src12", f"{self.pick(self.WORDS)}/main.go", f"{self.pick(self.WORDS)}.md", "prod.env", "settings.ini"])
        password = lambda: self.pick([self.pick(self.WORDS) + self.draw(digits, int(r.integers(1, 4))) + self.pick(["", "x", "!"]), self.draw(every + "!$%^*-_", int(r.integers(8, 20))), self.pick(self.WORDS).title() + self.pick("!$%^*") + self.draw(digits, 2), self.draw(low + digits, 10)]).ljust(8, "7")
        quoted, before, url = bool(r.integers(0, 2)), self.prose(), False
        if kind == "hex":
            value, name = self.draw(hexa, self.pick([24, 32, 40, 48, 64])), secret()
        elif kind == "letters":
            value, name = self.draw(every, int(r.integers(16, 60))), secret()
        elif kind == "base64":
            value, name = self.draw(every + "+/", int(r.integers(20, 90))) + self.pick(["", "=", "=="]), secret()
        elif kind == "password":
            value, name = password(), secret()
        elif kind == "passphrase":
            value, name = self.pick(["", "-", "."]).join(self.pick(self.WORDS) for _ in range(int(r.integers(2, 5)))), secret()
            value = value if r.random() < 0.6 else self.draw(low + low.upper(), int(r.integers(10, 28)))
        elif kind == "prefix":
            value, name = self.pick(PREFIXES) + self.draw(every, int(r.integers(16, 40))), self.pick(["", secret(), "key"])
        elif kind == "url":
            value, name, quoted, url, before = password(), "", False, True, before + self.pick(["postgres", "https", "amqp", "redis"]) + "://" + self.pick(self.OBJECTS) + ":"
        elif kind == "told":
            value, name, before = self.pick([self.draw(every, int(r.integers(12, 40))), self.draw(hexa, 40), password()]), "", before + " " + self.pick(["the password is ", "token ", "bearer ", "my secret: ", "passphrase was ", "api key "])
        elif kind == "digest":
            value, name = self.draw(hexa, self.pick([8, 12, 32, 40, 64])) + self.pick(digits), self.name(self.pick(["sha", "sha256", "md5", "checksum", "digest", "etag", "hash", "integrity", "revision"]))
        elif kind == "uuid":
            value, name = "-".join(self.draw(hexa, k) for k in (8, 4, 4, 4, 12)), self.pick(["", plain(), "request_id", secret() if r.random() < 0.1 else "id"])
        elif kind == "placeholder":
            value, name = self.pick(["your-key-here-", "xxxxxxxx", "example-value-", "change-this-now", "changeme", "dummy_value_", "placeholder", "test-password-", "insert-token-here-", "fake_key_"]) + self.pick(["", self.draw(digits, 2)]), secret()
        elif kind == "identifier":
            value, name = "".join(self.pick(self.PARTS + self.WORDS).title() for _ in range(3)) + self.draw(digits, 1), self.pick(["", plain(), "class"])
        elif kind == "number":
            value, name = self.draw(digits, int(r.integers(8, 22))), self.pick(["", plain(), "phone", "order", "date", "isbn", "serial"])
        elif kind == "path":
            value, name = "/".join(self.pick(self.WORDS + self.PARTS) for _ in range(int(r.integers(2, 5)))) + self.draw(digits, 1) + self.pick([".txt", ".py", ""]), self.pick(["", plain(), "file"])
        elif kind == "commit":
            value, name, before = self.draw(hexa, self.pick([32, 40])), "", before + " " + self.pick(["commit ", "merge commit ", "blob hash ", "sha1 ", "commit token ", "revision of the token "])
        elif kind == "fixture":
            value, name, path = self.draw(every, 32), self.pick([secret(), plain(), "integrity"]), self.pick(["tests/fixture.json", "examples/sample.py", "package.lock", "vendor/go.sum", "docs/example.md"])
        elif kind == "word":
            value, name = self.pick([self.pick(self.PARTS), self.pick(self.PARTS) + "_" + self.pick(self.PARTS), self.pick(self.PARTS) + self.pick(self.PARTS).title()]).ljust(8, "s"), secret()
            name, before = (name, before) if r.random() < 0.6 else ("", before + " " + self.pick(["the password ", "a token ", "secret "]))
        elif kind == "code":
            value, name = self.pick([f"os.environ.{self.pick(self.PARTS)}", f"config.get_{self.pick(self.PARTS)}", f"self.{self.pick(self.PARTS)}.{self.pick(self.PARTS)}", f"$var_{self.pick(self.PARTS)}", f"%{self.pick(self.PARTS)}-{self.pick(self.PARTS)}%"]), secret()
        else:
            value, name, quoted, url, before = self.pick(["port8080", "example", "your-password", "password", "changeme", "xxxxxxxx"]), "", False, True, before + "https://user:"
        return value, name.lower(), quoted, before.lower(), path, url


def labelled_findings(n: int = 4000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Findings made by rule, half of them secrets, all kinds in turn."""
    maker, x, y = FindingMaker(seed), [], []
    for i in range(n):
        kinds = FindingMaker.SECRETS if i % 2 == 0 else FindingMaker.PLAIN
        x.append(features(*maker.make(kinds[(i // 2) % len(kinds)])))
        y.append(i % 2 == 0)
    return np.array(x, dtype=np.float64), np.array(y, dtype=np.int64)


class Forest:
    """Bagged Gini trees over random subsets of features, as flat arrays."""

    def __init__(self, trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 1):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        r = np.random.default_rng(self.seed)
        tried = max(1, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(self.trees):
            own = r.integers(0, len(x), len(x))
            feature, cut, left, right, value = [], [], [], [], []

            def grow(rows: np.ndarray, depth: int) -> int:
                k = len(feature)
                p = y[rows].mean()
                for column, v in zip((feature, cut, left, right, value), (-1, 0.0, k, k, p)):
                    column.append(v)
                if depth == self.depth or len(rows) < 2 * self.leaf or p in (0.0, 1.0):
                    return k
                best = (np.inf, -1, 0.0)
                for f in r.permutation(x.shape[1])[:tried]:
                    order = np.argsort(x[rows, f], kind="stable")
                    v, ones = x[rows[order], f], np.cumsum(y[rows[order]])
                    n = np.arange(1, len(rows))
                    a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(rows) - n)
                    gini = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
                    gini[(v[1:] <= v[:-1]) | (n < self.leaf) | (len(rows) - n < self.leaf)] = np.inf
                    i = int(gini.argmin())
                    if gini[i] < best[0]:
                        best = (gini[i], int(f), (v[i] + v[i + 1]) / 2)
                if best[1] >= 0:
                    go = x[rows, best[1]] <= best[2]
                    feature[k], cut[k] = best[1], best[2]
                    left[k] = grow(rows[go], depth + 1)
                    right[k] = grow(rows[~go], depth + 1)
                return k

            grow(own, 0)
            self.nodes.append(tuple(np.array(c) for c in (feature, cut, left, right, value)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += value[at]
        return total / max(1, len(self.nodes))


@lru_cache(maxsize=1)
def trained() -> Forest:
    return Forest().fit(*labelled_findings())


def scan_batch(forest: Forest, texts: pa.Array, paths: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
    """For each text its candidates as (start, end, name, score)."""
    out: list[list] = [[] for _ in range(len(texts))]
    maybe = pc.match_substring_regex(texts, MAYBE).fill_null(False).to_numpy(zero_copy_only=False)
    where, rows = [], []
    for i in np.flatnonzero(maybe):
        for start, end, value, name, quoted, before, url in candidates(texts[int(i)].as_py()):
            where.append((int(i), start, end, name))
            rows.append(features(value, name, quoted, before, paths[int(i)] or "", url))
    if rows:
        for (i, start, end, name), score in zip(where, forest.predict(np.array(rows))):
            out[i].append((start, end, name, float(score)))
    return out


def findings(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", path_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Every candidate: doc_id, start and end in code points, the name it is assigned to, score, and whether it is a secret."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                few = batch.slice(lo, 1000)
                found = scan_batch(sent.value, few.column(2), few.column(1).to_pylist())
                ids = few.column(0).to_pylist()
                rows = [(ids[i], *f, f[3] >= threshold) for i, own in enumerate(found) for f in own]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
                yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["doc_id", "start", "end", "name", "score", "is_secret"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, start int, end int, name string, score double, is_secret boolean")


def redacted(docs: DataFrame, threshold: float = 0.5, mask: str = "<secret>", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; all rows stay."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(texts, paths):
        import pandas as pd

        out = []
        for lo in range(0, len(texts), 500):
            own, where = texts.iloc[lo : lo + 500], paths.iloc[lo : lo + 500].tolist()
            for text, found in zip(own, scan_batch(sent.value, pa.array(own, pa.string()), where)):
                parts, at = [], 0
                for start, end, _, score in found:
                    if score >= threshold:
                        parts += [text[at:start], mask]
                        at = end
                out.append("".join([*parts, text[at:]]) if parts else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col), F.col(path_col)))
