"""Word and character n-gram features, as rows (document, feature, weight) and as vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from dialectry.operators.linear import squeezed, unsqueezed


def word_ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of low to high tokens, joined by spaces."""
    if (low, high) == (1, 1):
        return tokens

    def of(t: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(_each(at, lambda i, n: F.array_join(F.slice(t, i, n), " "), n))
        return F.flatten(F.array(*parts))

    return _bound(tokens, of)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda an expression would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def _each(places: Column, gram: Callable[[Column, int], Column], n: int) -> Column:
    """The n-gram at each place; a lambda's parameters are the array's, so n must not be one of them."""
    return F.transform(places, lambda i: gram(i, n))


def substring_of(c: Column, n: int) -> Callable[[Column], Column]:
    """From a place to the n characters of ``c`` there."""
    return lambda i: F.substring(c, i, F.lit(n))


def char_wb_ngrams(c: Column, low: int = 2, high: int = 5, lowercase: bool = True) -> Column:
    """Character n-grams inside words padded by one space; a padded word no longer than n yields itself once and ends."""
    text = F.lower(c) if lowercase else c
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        return _bound(F.concat(F.lit(" "), w, F.lit(" ")), of_padded)

    def of_padded(p: Column) -> Column:
        size = F.length(p)
        parts = []
        for n in range(low, high + 1):
            whole = size == n if n > low else size <= n
            at = F.when(size > n, F.sequence(F.lit(1), size - n + 1)).when(whole, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
            parts.append(_each(at, lambda i, n: F.substring(p, i, F.lit(n)), n))
        return F.flatten(F.array(*parts))

    return F.flatten(F.transform(words, of_word))


@dataclass(frozen=True)
class CharGrams:
    """Character n-grams inside words, as :func:`char_wb_ngrams` gives them; a null text has no words.

    Words are counted first, and each distinct word of a block of documents is cut once.
    """

    text: Column
    low: int = 2
    high: int = 5
    lowercase: bool = True


Grams = Column | CharGrams
Span = tuple[int, int] | None

#: Words whose documents are counted at once, unless a single document has more; rows of a batch that is handed on.
WORDS, ROWS = 200_000, 1 << 16
#: Words of a slice of the documents, on average, and distinct terms that a task gathers before it hands them on.
SLICE, GATHERED = 1_000_000, 1_000_000


def _words(grams: Grams) -> tuple[Column, Span]:
    """A document's words, and the lengths of the n-grams they are cut to; none where the words are the terms."""
    if not isinstance(grams, CharGrams):
        return grams, None
    text = F.lower(grams.text) if grams.lowercase else grams.text
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), (grams.low, grams.high)


def _blocks(words: pa.ListArray, group: np.ndarray):
    """(first row, end) of blocks of about ``WORDS`` words; rows of a group, which are neighbours, stay together."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(words), 0)))
    new = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    at, before = 0, 0
    while at < len(group):
        k = np.searchsorted(ends[new - 1], before + WORDS)
        end = int(new[min(max(k, np.searchsorted(new, at, "right")), len(new) - 1)])
        yield at, end
        at, before = end, ends[end - 1]


def _bytes(text: pa.StringArray) -> bytes:
    """The bytes of all texts, one behind the other."""
    if not len(text):
        return b""
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    return memoryview(text.buffers()[2])[ends[0] : ends[-1]].tobytes()


def _strings(data: bytes, sizes: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(data))


def _packed(terms: pa.StringArray) -> tuple[bytes, bytes]:
    """Texts, best in their order, and their sizes, both compressed."""
    return pa.compress(_bytes(terms), codec="zstd", asbytes=True), squeezed(np.asarray(pc.binary_length(terms)))


def _unpacked(data: bytes, sizes: bytes, n: int) -> pa.StringArray:
    each = unsqueezed(sizes, n)
    return _strings(pa.decompress(data, int(each.sum()), codec="zstd", asbytes=True) if each.any() else b"", each)


def _parts(terms: pa.StringArray, n: int) -> np.ndarray:
    """A number below n by each text's bytes."""
    sizes = np.asarray(pc.binary_length(terms)).astype(np.int64)
    raw, begin = np.frombuffer(_bytes(terms), np.uint8).astype(np.uint64), np.cumsum(sizes) - sizes
    power = np.full(max(1, int(sizes.max(initial=1))), 0x9E3779B97F4A7C15, np.uint64).cumprod()
    h, full = sizes.astype(np.uint64), np.flatnonzero(sizes)
    if len(full):
        h[full] += np.add.reduceat((raw + np.uint64(1)) * power[np.arange(len(raw)) - np.repeat(begin, sizes)], begin[full])
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _cut(words: pa.StringArray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Where each word's n-grams begin, their numbers, and the n-grams by number; a word's n-gram is there as often as in the word.

    An n-gram is numbered by the number of its first n - 1 characters and its last one.
    """
    text = pc.binary_join_element_wise("", words, "", " ").cast(pa.string())
    size = np.asarray(pc.utf8_length(text)).astype(np.int64)
    raw = np.frombuffer(_bytes(text), np.uint8)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte = np.append(0, np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)))
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(code)) - begin[word]
    left = size[word] - within
    last = pa.array(code).dictionary_encode()
    n_chars, last = len(last.dictionary), last.indices.to_numpy().astype(np.int64)
    number, at, each = last.copy(), np.arange(len(code)), []
    for n in range(1, high + 1):
        at = at[left[at] >= n]
        if n > 1:
            number[at] = pa.array(number[at] * n_chars + last[at + n - 1]).dictionary_encode().indices.to_numpy()
        if n >= low and n > 1:
            each.append((n, at, number[at]))  # numbered from 0 without gaps as they are
        else:
            own = at if n >= low else at[(within[at] == 0) & (left[at] == n)]
            each.append((n, own, pa.array(number[own]).dictionary_encode().indices.to_numpy().astype(np.int64)))
    has = [np.bincount(word[own], minlength=len(size)) for _, own, _ in each]
    starts = np.append(0, np.cumsum(sum(has)))
    ids, base, lows, highs = np.empty(starts[-1], np.int64), 0, [], []
    before = starts[:-1].copy()
    for (n, own, k), count in zip(each, has, strict=True):
        if not len(own):
            continue
        first = np.empty(k.max() + 1, np.int64)
        first[k[::-1]] = own[::-1]
        lows.append(byte[first])
        highs.append(byte[first + n])
        ids[before[word[own]] + within[own]] = base + k
        base += len(first)
        before += count
    if not lows:
        return starts, ids, pa.array([], pa.string())
    lows, sizes = np.concatenate(lows), np.concatenate(highs) - np.concatenate(lows)
    ends = np.cumsum(sizes)
    data = raw[np.arange(ends[-1]) + np.repeat(lows - ends + sizes, sizes)]
    return starts, ids, pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their ``times``."""
    if not len(key):
        return key, times
    bits = int(times.max()).bit_length()
    if int(key.max()).bit_length() + bits < 63:
        both = np.sort(key << bits | times)
        key, times = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(times, first)


def _counted(words: pa.ListArray, group: np.ndarray, span: Span) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(group, number of a term, occurrences) of a block's documents, and the terms by number."""
    flat = words.flatten().dictionary_encode("encode")
    n = max(1, len(flat.dictionary))
    key = np.repeat(group, np.asarray(pc.fill_null(pc.list_value_length(words), 0))) * n + flat.indices.to_numpy()
    key, times = np.unique(key, return_counts=True)
    terms = flat.dictionary
    if span is not None:
        starts, ids, terms = _cut(terms, *span)
        doc, word = np.divmod(key, n)
        sizes, n = np.diff(starts)[word], max(1, len(terms))
        at = np.arange(sizes.sum()) + np.repeat(starts[word] - np.cumsum(sizes) + sizes, sizes)
        key, times = _summed(np.repeat(doc, sizes) * n + ids[at], np.repeat(times, sizes))
    doc, term = np.divmod(key, n)
    return doc, term, times, terms


def _frequencies_in(batches, span: Span, place: int):
    """(term, n) tables: in how many rows of the batches a term is; a term comes again where more than ``GATHERED`` are at hand."""
    held, size = [], 0

    def add() -> None:
        whole = pa.concat_tables(held).group_by("term").aggregate([("n", "sum")])
        held[:] = [pa.table([whole.column("term"), whole.column("n_sum")], ["term", "n"])]

    for batch in batches:
        words = batch.column(place)
        rows = np.arange(batch.num_rows)
        for lo, hi in _blocks(words, rows):
            _, term, _, terms = _counted(words.slice(lo, hi - lo), rows[: hi - lo], span)
            held.append(pa.table([terms, pa.array(np.bincount(term, minlength=len(terms)))], ["term", "n"]))
            size += len(terms)
            if size > 2 * GATHERED:
                add()
                size = held[0].num_rows
                if size > GATHERED:
                    yield held.pop()
                    size = 0
    if held:
        add()
        yield held.pop()


def _cells(rows: DataFrame, span: Span) -> DataFrame:
    """(doc, term, tf) of rows (doc, words), each a document."""
    names = [rows.columns[0], "term", "tf"]

    def run(batches):
        for batch in batches:
            words, own = batch.column(1), np.arange(batch.num_rows)
            for lo, hi in _blocks(words, own):
                doc, term, tf, terms = _counted(words.slice(lo, hi - lo), own[lo:hi], span)
                for at in range(0, len(doc), ROWS):
                    part = slice(at, at + ROWS)
                    yield pa.record_batch([batch.column(0).take(pa.array(doc[part])), terms.take(pa.array(term[part])), pa.array(tf[part])], names)

    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("term", StringType()), StructField("tf", LongType())]))


def term_rows(df: DataFrame, grams: Column, *others: str, distinct: bool = False) -> DataFrame:
    """``others``, term and tf, as rows that may repeat a term of a document; with ``distinct`` none does."""
    return df.select(*others, F.explode(F.array_distinct(grams) if distinct else grams).alias("term"), F.lit(1).cast("long").alias("tf"))


def term_frequencies(df: DataFrame, grams: Grams, doc: str = "doc_id") -> DataFrame:
    """(doc, term, tf), counted in blocks of documents where these are; only rows of a repeated id are brought together first."""
    words, span = _words(grams)
    rows = df.select(doc, words.alias("_words"))
    if not df.groupBy(doc).count().where("count > 1").isEmpty():
        rows = rows.groupBy(doc).agg(F.flatten(F.collect_list("_words")).alias("_words"))
    return _cells(rows, span)


def _with_idf(terms: DataFrame, n_docs: int, min_df: int, max_df: float) -> DataFrame:
    kept = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return kept.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)


def vocabulary(df: DataFrame, grams: Grams, n_docs: int, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """(term, df, idf) of terms in at least min_df rows and at most a share max_df of them; idf is smoothed, plus 1.

    Rows are documents. Each task adds up the rows of its distinct terms before the only shuffle.
    """
    words, span = _words(grams)

    def run(batches):
        for t in _frequencies_in(batches, span, 0):
            yield from t.to_batches(ROWS)

    each = df.select(words.alias("_words")).mapInArrow(run, "term string, n long")
    return _with_idf(each.groupBy("term").agg(F.sum("n").alias("df")), n_docs, min_df, max_df)


@dataclass
class Slices:
    """Documents dealt out by a hash of their id to slices of bounded size, which look up their distinct terms, not those of each document.

    A slice's terms are shuffled to the table and what is found back to the slice; its texts are shuffled twice, terms of documents never.
    ``grams`` names its columns.
    """

    df: DataFrame
    grams: Grams
    doc: str = "doc_id"

    def __post_init__(self) -> None:
        self.words, self.span = _words(self.grams)
        self.rows, size = self.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(self.words).cast("long")), F.lit(0))).first()
        self.deal(max(self.df.sparkSession.sparkContext.defaultParallelism, -(-size // SLICE)))

    def deal(self, n: int) -> None:
        self.n = n
        self.dealt = self.df.withColumn("_slice", F.pmod(F.xxhash64(self.doc), F.lit(n)).cast("int"))

    def terms(self) -> DataFrame:
        """(_slice, term, n): the distinct terms of each slice, and in how many of its rows they are."""
        span = self.span

        def run(batches):
            k = None

            def seen():
                nonlocal k
                for batch in batches:
                    k = batch.column(0)[0].as_py() if batch.num_rows else k
                    yield batch

            for t in _frequencies_in(seen(), span, 1):
                for b in t.to_batches(ROWS):
                    yield pa.record_batch([pa.array(np.full(b.num_rows, k, np.int32)), *b.columns], ["_slice", "term", "n"])

        # texts are cut to words behind the shuffle: they are smaller than their words
        return self.dealt.repartitionById(self.n, F.col("_slice")).select("_slice", self.words.alias("_words")).mapInArrow(run, "_slice int, term string, n long").where("term is not null")

    def apply(self, found: DataFrame, use: Callable, schema: StructType) -> DataFrame:
        """Rows that ``use`` makes of blocks of documents.

        ``found`` is (_slice, term, value, idx). ``use`` gets the documents' ids, the cells' document, term, tf, value and idx, and the terms, and yields
        batches; cells without a value are left out. Rows of a repeated id are one document.
        """
        rows, received, known = self._dealt_with(found)

        def run(batches):
            table, texts = received(batches)
            if table is None or texts is None:
                return
            docs = texts.column(0).chunk(0).dictionary_encode("encode")
            group = docs.indices.to_numpy().astype(np.int64)
            order = np.argsort(group, kind="stable")
            words, group = texts.column(1).chunk(0).take(pa.array(order)), group[order]
            for lo, hi in _blocks(words, group):
                d, t, tf, value, idx, terms = known(words.slice(lo, hi - lo), group[lo:hi], table)
                yield from use(docs.dictionary, d, t, tf, value, idx, terms)

        return rows.mapInArrow(run, schema)

    def cells(self, found: DataFrame, label: str, kind: int, base: int, n_blocks: int, offsets: dict[int, int]) -> DataFrame:
        """``linear.PIECE`` rows of the documents' cells, of labels and of norms, in ``n_blocks`` blocks from ``base``; ``offsets`` are the rows before each slice.

        Rows of a repeated id have the cells of all of them, rows without an id none.
        """
        from dialectry.operators import linear

        rows, received, known = self._dealt_with(found, label)

        def run(batches):
            table, texts = received(batches)
            if texts is None:
                return
            order = pc.sort_indices(pa.table({"d": texts.column(0), "y": texts.column(2)}), sort_keys=[("d", "ascending"), ("y", "ascending")])
            texts = texts.take(order).combine_chunks()
            ids, words = texts.column(0).chunk(0), texts.column(1).chunk(0)
            docs = ids.dictionary_encode("encode")
            group, n = docs.indices.to_numpy().astype(np.int64), len(ids)
            first, each = np.unique(group, return_index=True, return_counts=True)[1:]
            at, norms = offsets[texts.column(3)[0].as_py()], np.ones(n)
            held, size = [], 0

            def flush():
                yield from linear.pieces(kind, base, n_blocks, *(np.concatenate(x) for x in zip(*held)))

            for lo, hi in _blocks(words, group):
                d, _, tf, value, idx, _ = known(words.slice(lo, hi - lo), group[lo:hi], table) if table is not None else (np.zeros(0, np.int64),) * 6
                if ids.null_count:
                    some = ids.is_valid().to_numpy(zero_copy_only=False)[first[d]]
                    d, tf, value, idx = d[some], tf[some], value[some], idx[some]
                if not len(d):
                    continue
                w = np.log(tf) + 1
                square = np.bincount(d - d[0], (w * value) ** 2)
                own = np.unique(d)
                for again in range(int(each[own].max())):
                    few, with_it = own[each[own] > again], each[d] > again
                    norms[first[few] + again] = np.sqrt(square[few - d[0]])
                    held.append((at + first[d[with_it]] + again, idx[with_it].astype(np.int64), w[with_it]))
                    size += int(with_it.sum())
                if size > linear.STORED_CELLS:
                    yield from flush()
                    held.clear()
                    size = 0
            if held:
                yield from flush()
            labels = texts.column(2).to_numpy().astype(np.int32).tobytes()
            yield linear._row(linear.PIECE, block=base + at % n_blocks, kind=kind, first=at, labels=labels, norms=norms.tobytes())

        return rows.mapInArrow(run, linear.PIECE)

    def _dealt_with(self, found: DataFrame, *others: str):
        """Rows of terms and texts by slice; how a task tells them apart; and the known cells of a block of documents."""
        span = self.span

        def pack(batches):
            held, size = [], 0

            def flush():
                t = pa.Table.from_batches(held).sort_by([("_slice", "ascending"), ("term", "ascending")]).combine_chunks()
                cuts = np.flatnonzero(np.diff(t.column(0).to_numpy(), prepend=-1, append=-1))
                for x, z in zip(cuts, cuts[1:]):
                    few = t.slice(x, z - x).combine_chunks()
                    values, code = np.unique(few.column(2).to_numpy(), return_inverse=True)
                    cells = [*_packed(few.column(1).chunk(0)), values.tobytes(), squeezed(code), squeezed(few.column(3).to_numpy())]
                    yield pa.record_batch([few.column(0).chunk(0).slice(0, 1), *(pa.array([c], pa.binary()) for c in cells), pa.array([z - x], pa.int64())], ["_slice", "_term", "_sizes", "_value", "_code", "_idx", "_n"])

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.num_rows
                if size > GATHERED:
                    yield from flush()
                    held.clear()
                    size = 0
            if held:
                yield from flush()

        answers = ["_term", "_sizes", "_value", "_code", "_idx", "_n"]
        own = found.select(F.col("_slice").cast("int").alias("_slice"), "term", F.col("value").cast("double").alias("value"), F.col("idx").cast("int").alias("idx"))
        own = own.mapInArrow(pack, "_slice int, _term binary, _sizes binary, _value binary, _code binary, _idx binary, _n long")
        both = own.unionByName(self.dealt, allowMissingColumns=True).repartitionById(self.n, F.col("_slice"))
        rows = both.select(*answers, self.doc, F.coalesce(self.words, F.array().cast("array<string>")).alias("_words"), *others, "_slice")

        def received(batches):
            tables, texts = [], []
            for batch in batches:
                is_text = batch.column(0).is_null()
                for r in batch.filter(pc.invert(is_text)).select(range(6)).to_pylist():
                    n = r["_n"]
                    value = np.frombuffer(r["_value"])[unsqueezed(r["_code"], n)]
                    tables.append(pa.table([_unpacked(r["_term"], r["_sizes"], n), pa.array(value), pa.array(unsqueezed(r["_idx"], n).astype(np.int32))], ["term", "value", "idx"]))
                part = batch.filter(is_text)
                if part.num_rows:
                    texts.append(part.select(range(6, part.num_columns)))
            return pa.concat_tables(tables).combine_chunks() if tables else None, pa.Table.from_batches(texts).combine_chunks() if texts else None

        def known(words, group, table):
            d, t, tf, terms = _counted(words, group, span)
            term, value, idx = (table.column(k).chunk(0) for k in range(3))
            place = pc.fill_null(pc.index_in(terms, value_set=term), -1).to_numpy()[t]
            some = np.flatnonzero(place >= 0)
            place = place[some]
            return d[some], t[some], tf[some], value.to_numpy(zero_copy_only=False)[place], idx.to_numpy(zero_copy_only=False)[place], terms

        return rows, received, known

    def weighted(self, found: DataFrame, weigh: Callable) -> DataFrame:
        """(doc, term, weight) with the weights that ``weigh`` makes of the cells' document, tf and value."""
        names = [self.doc, "term", "weight"]

        def use(docs, d, t, tf, value, idx, terms):
            w = weigh(d, tf, value)
            for at in range(0, len(d), ROWS):
                part = slice(at, at + ROWS)
                yield pa.record_batch([docs.take(pa.array(d[part])), terms.take(pa.array(t[part])), pa.array(w[part])], names)

        return self.apply(found, use, StructType([self.df.schema[self.doc], StructField("term", StringType()), StructField("weight", DoubleType())]))


def _unit_length(sublinear: bool) -> Callable:
    def weigh(d, tf, value):
        w = (np.log(tf) + 1 if sublinear else tf) * value
        if len(w):
            w /= np.sqrt(np.bincount(d - d[0], w * w))[d - d[0]]
        return w

    return weigh


def _found(slices: Slices, min_df: int, max_df: float, sketch_bits: int | None = None) -> DataFrame:
    """(_slice, term, df, idf) of the slices' terms that the vocabulary of all holds.

    Terms are dealt by their bytes to as many tasks as there are slices, packed by slice: one holds about as many terms as a slice has.
    ``sketch_bits`` changes nothing any more: terms that a sketch is made of must be stored first, which takes more room than packed ones that it could drop.
    """
    n = slices.n

    def deal(batches):
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).sort_by([("_slice", "ascending"), ("term", "ascending")]).combine_chunks()
            own, term, times = (t.column(k).chunk(0) for k in range(3))
            own, times, part = own.to_numpy(), times.to_numpy(), _parts(term, n)
            order = np.lexsort((own, part))  # a stable sort: terms stay in their order
            own, times, part, term = own[order], times[order], part[order], term.take(pa.array(order))
            cuts = np.append(np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)), len(own))
            for x, z in zip(cuts, cuts[1:]):
                cells = [*_packed(term.slice(x, z - x)), squeezed(times[x:z])]
                yield pa.record_batch([pa.array([part[x]], pa.int32()), pa.array([own[x]], pa.int32()), *(pa.array([c], pa.binary()) for c in cells), pa.array([z - x], pa.int64())], ["part", "_slice", "terms", "sizes", "times", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > GATHERED:
                yield from flush()
                held.clear()
                size = 0
        if held:
            yield from flush()

    def count(batches):
        tables = []
        for batch in batches:
            for r in batch.to_pylist():
                k = r["n"]
                tables.append(pa.table([pa.array(np.full(k, r["_slice"], np.int32)), _unpacked(r["terms"], r["sizes"], k), pa.array(unsqueezed(r["times"], k).astype(np.int64))], ["_slice", "term", "n"]))
        if not tables:
            return
        whole = pa.concat_tables(tables).combine_chunks()
        number = whole.column(1).chunk(0).dictionary_encode()
        at = number.indices.to_numpy()
        df = np.bincount(at, whole.column(2).to_numpy(), len(number.dictionary)).astype(np.int64)[at]
        for b in pa.table([whole.column(0), whole.column(1), pa.array(df)], ["_slice", "term", "df"]).to_batches(ROWS):
            yield b

    dealt = slices.terms().mapInArrow(deal, "part int, _slice int, terms binary, sizes binary, times binary, n long")
    every = dealt.repartitionById(n, F.col("part")).mapInArrow(count, "_slice int, term string, df long")
    return _with_idf(every, slices.rows, min_df, max_df)


def _looked_up(slices: Slices, fitted: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``fitted`` of the slices' terms (``terms`` if they are stored), by as many tasks as slices; a small ``fitted`` is broadcast, and the terms stay where they are."""
    return (slices.terms() if terms is None else terms).select("_slice", "term").join(fitted.repartition(slices.n, "term"), "term")


def tf_idf(df: DataFrame, grams: Grams, doc: str = "doc_id", min_df: int = 2, max_df: float = 0.9, sublinear: bool = True, fitted: DataFrame | None = None, sketch_bits: int | None = None) -> DataFrame:
    """(doc, term, weight) with rows of unit length. ``fitted`` is a vocabulary of other texts.

    ``sketch_bits`` is taken as before and changes nothing, see :func:`_found`.
    """
    slices = Slices(df, grams, doc)
    found = _found(slices, min_df, max_df, sketch_bits) if fitted is None else _looked_up(slices, fitted)
    return slices.weighted(found.select("_slice", "term", F.col("idf").alias("value"), F.lit(0).alias("idx")), _unit_length(sublinear))


def counts(df: DataFrame, grams: Grams, doc: str = "doc_id", min_df: int = 1, max_df: float = 1.0, sketch_bits: int | None = None) -> DataFrame:
    """(doc, term, weight) of plain counts; ``sketch_bits`` as in :func:`tf_idf`."""
    slices = Slices(df, grams, doc)
    found = _found(slices, min_df, max_df, sketch_bits).select("_slice", "term", F.lit(1.0).alias("value"), F.lit(0).alias("idx"))
    return slices.weighted(found, lambda d, tf, value: tf.astype(float))


def indexed_tf_idf(df: DataFrame, grams: Grams, fitted: DataFrame, doc: str = "doc_id", sublinear: bool = True) -> DataFrame:
    """(doc, indices, values) of unit length, indices ascending, of the documents with a known term; ``fitted`` is a vocabulary whose terms have numbers ``idx``."""
    slices, weigh, names = Slices(df, grams, doc), _unit_length(sublinear), [doc, "indices", "values"]

    def use(docs, d, t, tf, value, idx, terms):
        order = np.lexsort((idx, d))
        w, d, idx = weigh(d, tf, value)[order], d[order], idx[order].astype(np.int32)
        first = np.flatnonzero(np.diff(d, prepend=-1))
        cells = (pa.ListArray.from_arrays(pa.array(np.append(first, len(d)), pa.int32()), pa.array(x)) for x in (idx, w))
        yield pa.record_batch([docs.take(pa.array(d[first])), *cells], names)

    schema = StructType([df.schema[doc], StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])
    return slices.apply(_looked_up(slices, fitted).select("_slice", "term", F.col("idf").alias("value"), "idx"), use, schema)


def linear_scores(df: DataFrame, grams: Grams, fitted: DataFrame, weights: np.ndarray, doc: str = "doc_id", sublinear: bool = True) -> DataFrame:
    """(doc, scores): of each document with a known term its vector times ``weights`` (features by columns); ``fitted`` as in :func:`indexed_tf_idf`.

    Documents are scored where they are counted, so their cells stay there.
    """
    slices, weigh = Slices(df, grams, doc), _unit_length(sublinear)
    sent = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def use(docs, d, t, tf, value, idx, terms):
        if not len(d):
            return
        w, own = weigh(d, tf, value), np.unique(d)
        got = np.stack([np.bincount(d - d[0], w * column[idx])[own - d[0]] for column in sent.value.T], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * got.shape[1], pa.int32()), pa.array(got.ravel()))
        yield pa.record_batch([docs.take(pa.array(own)), lists], [doc, "scores"])

    schema = StructType([df.schema[doc], StructField("scores", ArrayType(DoubleType()))])
    return slices.apply(_looked_up(slices, fitted).select("_slice", "term", F.col("idf").alias("value"), "idx"), use, schema)


VECTORIZERS: dict[str, Callable] = {"tfidf": tf_idf, "count": counts}


def vectorize(kind: str, df: DataFrame, grams: Grams, **options) -> DataFrame:
    if kind not in VECTORIZERS:
        raise ValueError(f"unknown vectorizer: {kind}")
    return VECTORIZERS[kind](df, grams, **options)


def union_features(parts: dict[str, DataFrame], doc: str = "doc_id") -> DataFrame:
    """Blocks of features side by side, their terms named by kind (``w_``, ``c_``)."""
    from dialectry.functions.text import feature_name

    out = None
    for kind, part in parts.items():
        named = part.select(doc, feature_name(F.col("term"), kind).alias("term"), "weight")
        out = named if out is None else out.unionByName(named)
    return out


def numbered_terms(features: DataFrame) -> DataFrame:
    """(term, idx) over all distinct terms, counted per hash group first, so that no task numbers them all."""
    terms = features.select("term").distinct().withColumn("g", F.pmod(F.xxhash64("term"), F.lit(256)))
    sizes = terms.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    k = F.row_number().over(Window.partitionBy("g").orderBy("term"))
    return terms.withColumn("k", k).join(base, "g").select("term", (F.col("base") + F.col("k") - 1).cast("int").alias("idx"))


def sparse_rows(features: DataFrame, terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, indices, values), indices ascending."""
    cells = features.join(terms, "term").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("cells"))
    return cells.select(doc, F.transform("cells", lambda c: c["idx"]).alias("indices"), F.transform("cells", lambda c: c["weight"]).alias("values"))


def vectors(features: DataFrame, terms: DataFrame, size: int, doc: str = "doc_id") -> DataFrame:
    """(doc, features) as sparse vectors, made from whole Arrow columns."""
    from pyspark.ml.linalg import VectorUDT

    rows = sparse_rows(features, terms, doc)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            parts = [pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()), batch.column(1), batch.column(2)]
            yield pa.record_batch([batch.column(0), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], [doc, "features"])

    return rows.mapInArrow(run, StructType([rows.schema[doc], StructField("features", VectorUDT())]))
