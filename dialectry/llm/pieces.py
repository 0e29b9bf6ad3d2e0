"""Sentence-piece encoding and decoding through tables of distinct chunks.

Where no piece holds a white-space marker behind another character, no merge crosses the place before a
marker run, so a text's ids are those of its marked words, one after another. A task cuts its texts into
marked words by their bytes, numbers the distinct ones, has each new one segmented once by the
tokenizer library, keeps its ids in a table, and gathers the ids of all words by their position. Tables
belong to a task: a table of the whole corpus would have to be shuffled to the texts, or the texts to it
(see the README), while a task meets few new words after its first texts. A table that has reached
``HELD`` bytes is begun anew. Decoding gathers the bytes of pieces in the same way.

Whether the rule holds is looked up in the model: no piece with an inner marker, no normalisation but the
marker's. A model where it does not hold is refused.

Defined results: a null text is empty, and an empty text has no ids; a null doc_id is carried along; repeated
rows are rows of their own; an empty table gives an empty result. Only the named columns are read, so
further columns do no harm.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import slices, text_buffer

#: Fixed value: the marker that stands for a space.
MARKER = "▁"
#: Bytes that a table holds before it is begun anew, and what a word takes besides its letters and ids.
HELD, EACH = 1 << 26, 160


@lru_cache(maxsize=2)
def load_model(path: str):
    """The library's processor, if marked words can be segmented by themselves."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("the model has pieces across white-space markers")
    probe = "a  À éﬁ\t　\r\n① z "
    if model.normalize(probe) != MARKER + probe.replace(" ", MARKER) or model.normalize(""):
        raise ValueError("the model normalises texts, or puts no marker before them")
    return model


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of the named spans of ``flat``."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ChunkTable:
    """Ids of distinct marked words; a word is named without its first marker."""

    def __init__(self, model):
        self.model, self.mark = model, model.piece_to_id(MARKER)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = self.used = 0
        self.start, self.size = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64)
        self.flat = np.zeros(1 << 12, dtype=np.int32)

    def add(self, words: list[bytes]) -> None:
        """Segment new words, all in one call; the marker alone is its own piece."""
        ids = [np.array(x if w else [self.mark], dtype=np.int32) for w, x in zip(words, self.model.encode([w.decode() for w in words], num_threads=1))]
        size = np.array([len(x) for x in ids], dtype=np.int64)
        lo, n, total = len(self.number), len(words), int(size.sum())
        while lo + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        self.start[lo : lo + n], self.size[lo : lo + n] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.number.update(zip(words, range(lo, lo + n)))
        self.used += total
        self.held += sum(map(len, words)) + 4 * total + EACH * n

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of the texts."""
        if not len(raw):
            return np.zeros(0, dtype=np.int32), np.zeros(len(at), dtype=np.int64)
        if self.held > HELD:
            self.clear()
        words, first = marked_words(raw, at)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.number]
        if new:
            self.add(new)
        entry = np.array([self.number[w] for w in distinct], dtype=np.int64)[coded.indices.to_numpy()]
        size = self.size[entry]
        return gather(self.flat, self.start[entry], size), np.concatenate([[0], np.cumsum(size)])[first]


def marked_words(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All marked words without their first marker, in order, and the n + 1 offsets of the texts' words.

    A word begins with a text, whose first marker is not written, and at each marker behind another character.
    """
    space = raw == 0x20
    wide = np.flatnonzero(raw[:-2] == 0xE2) if len(raw) > 2 else np.zeros(0, dtype=np.int64)
    wide = wide[(raw[wide + 1] == 0x96) & (raw[wide + 2] == 0x81)]  # the marker itself, as three bytes
    marker = space
    if len(wide):
        marker = space.copy()
        marker[wide] = marker[wide + 1] = marker[wide + 2] = True
    begins = np.empty(len(raw), dtype=bool)
    begins[0] = False
    begins[1:] = marker[1:] & ~marker[:-1]
    rows = np.unique(at[:-1][np.diff(at) > 0])
    begins[rows] = False
    starts = np.flatnonzero(begins)
    kept = np.ones(len(raw), dtype=bool)
    kept[starts] = False
    long = starts[~space[starts]]
    kept[long + 1] = kept[long + 2] = False
    begins[rows] = True
    starts = np.flatnonzero(begins)
    place = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
    offsets = place[np.append(starts, len(raw))]
    body = raw[kept]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    return words, np.searchsorted(starts, at)


class PieceTable:
    """Bytes of all pieces, for decoding."""

    def __init__(self, model):
        self.model, n = model, model.get_piece_size()
        pieces, self.plain = [], np.ones(n, dtype=bool)
        for i in range(n):
            piece = model.id_to_piece(i)
            self.plain[i] = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARKER, " ").encode())
        self.size = np.array([len(x) for x in pieces], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.marked = np.array([model.id_to_piece(i).startswith(MARKER) for i in range(n)])

    def texts(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of lists of ids. A list with control ids or broken byte sequences goes to the library."""
        data = gather(self.flat, self.start[ids], self.size[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[at]
        odd = np.concatenate([[0], np.cumsum(~self.plain[ids])])[at]
        out = []
        for a, b, i, j, special in zip(ends[:-1].tolist(), ends[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), np.diff(odd).tolist()):
            if i == j:
                out.append("")
                continue
            try:
                if special:
                    raise ValueError("control ids")
                out.append(data[a + int(self.marked[ids[i]]) : b].decode())
            except ValueError:
                out.append(self.model.decode(ids[i:j].tolist()))
        return out


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the piece ids of every text, without begin or end ids."""

    def run(batches):
        table = ChunkTable(load_model(model_path))
        for batch in batches:
            for few in slices(batch, "text"):
                ids, at = table.ids(*text_buffer(few.column("text")))
                yield pa.record_batch([few.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the text of every list of ids; a null list is the empty one."""

    def run(batches):
        table = PieceTable(load_model(model_path))
        for batch in batches:
            lists = batch.column("ids")
            lists = lists if not lists.null_count else pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            at = lists.offsets.to_numpy().astype(np.int64)
            ids, at = lists.values.to_numpy()[at[0] : at[-1]], at - at[0]
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), "right")) - 1)
                few = batch.slice(lo, hi - lo)
                texts = table.texts(ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield pa.record_batch([few.column("doc_id"), few.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                lo = hi

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def with_digests(rows: DataFrame) -> DataFrame:
    """Number and digest of the ids, and the digest of the decoded text."""
    listed = F.array_join(F.coalesce("ids", F.array().cast("array<int>")).cast("array<string>"), ",")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), digest(listed).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
