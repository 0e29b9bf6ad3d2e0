"""Subword ids of texts, cut and padded to one length."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def load(path: str, max_length: int, pad_id: int):
    """The tokenizer of a file, with truncation and padding."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.enable_truncation(max_length)
    own.enable_padding(length=max_length, pad_id=pad_id, pad_token=own.id_to_token(pad_id) or "")
    return own


def subword_ids(df: DataFrame, path: str, max_length: int = 256, pad_id: int = 0, text: str = "text", doc: str = "row_id") -> DataFrame:
    """(doc, input_ids, attention_mask): at most ``max_length`` ids, special ones of the tokenizer among them, padded to that length; a null text is all padding."""
    whole = pa.list_(pa.int32())

    def run(batches):
        own = load(path, max_length, pad_id)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                few = batch.slice(lo, 500)
                texts = few.column(1).to_pylist()
                got = own.encode_batch([t or "" for t in texts])
                ids = [g.ids if t is not None else [pad_id] * max_length for g, t in zip(got, texts)]
                mask = [g.attention_mask if t is not None else [0] * max_length for g, t in zip(got, texts)]
                yield pa.record_batch([few.column(0), pa.array(ids, whole), pa.array(mask, whole)], [doc, "input_ids", "attention_mask"])

    kind = df.schema[doc].dataType.simpleString()
    return df.select(doc, F.col(text).cast("string")).mapInArrow(run, f"{doc} {kind}, input_ids array<int>, attention_mask array<int>")
