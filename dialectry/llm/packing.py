"""Packing by concatenate and cut.

Pass one tokenises every text once and stores the ids with their place in the partition. The
partition totals (one number per partition) are summed to prefix sums, which turn each place into a
global offset. Pass two cuts the global stream into fixed windows; a document that crosses a
boundary yields one record per window, so only the very last window can be short.

Defined results: a null or empty text is the single end id; repeated rows are separate documents; a
null doc_id is carried along; an empty table gives no piece. Input columns other than the named two
are not read, so clashing names do no harm.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import stored

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, continues boolean, ids binary"


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the word pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def load_encoder(path: str):
    """A function from text to a list of ids, equal to the tokenizer file's own ids.

    A plain byte-level BPE file runs on the rank encoder, which is three times as fast; any other
    file runs on the tokenizer library itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        model.get("type") == "BPE"
        and not spec.get("normalizer")
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not model.get("ignore_merges")
        and all(a["special"] and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in spec["added_tokens"])
        and len(spec["added_tokens"]) <= 1
    )
    if plain:
        import tiktoken

        alphabet, added = _byte_alphabet(), {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [ranks[bytes(alphabet[c] for c in a + b)] for a, b in merged]
        if order == sorted(order):  # ids follow the merge order, so they serve as ranks
            core = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            if not added:
                return core.encode_ordinary
            ((mark, mark_id),) = added.items()

            def encode(text: str) -> list[int]:
                if mark not in text:
                    return core.encode_ordinary(text)
                first, *rest = text.split(mark)
                ids = core.encode_ordinary(first)
                for part in rest:
                    ids.append(mark_id)
                    ids += core.encode_ordinary(part)
                return ids

            return encode
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: partition, first place in it, and the ids with the end id, as little-endian 32-bit numbers."""

    def run(batches):
        from pyspark import TaskContext

        part, at, encode = TaskContext.get().partitionId(), 0, load_encoder(tokenizer_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                ids = []
                for text in few.column(1):
                    own = encode(text.as_py() or "")
                    own.append(end_id)
                    ids.append(np.asarray(own, dtype="<u4"))
                n = np.array([len(x) for x in ids], dtype=np.int64)
                first = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch(
                    [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(first), few.column(0), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["part", "first", "doc_id", "n", "ids"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "part int, first long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids (see the module's text).

    Columns: doc_id, start, length, doc_tokens, sequence_id, offset, continues (the document goes on
    in the next sequence) and ids. What reaches the driver is one total per partition of the input.
    """
    ids = stored(tokenised(docs, tokenizer_path, end_id, text_col, id_col), "packing", "zstd")
    base, at = {}, 0
    for part, total in sorted(ids.groupBy("part").agg(F.sum("n")).collect()):
        base[part], at = at, at + total
    bases = docs.sparkSession.sparkContext.broadcast(base)

    def cut(batches):
        known = bases.value
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for part, first, doc, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                begin, view = known[part] + first, memoryview(blob.as_buffer())
                done = 0
                while done < n:
                    seq, off = divmod(begin + done, length)
                    take = min(n - done, length - off)
                    for column, value in zip(out, (doc, done, take, n, seq, off, done + take < n, view[4 * done : 4 * (done + take)].tobytes())):
                        column.append(value)
                    done += take
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "continues", "ids"])

    return ids.select("part", "first", "doc_id", "n", "ids").mapInArrow(cut, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    """Replace the ids by their CRC."""
    crc: Column = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")
