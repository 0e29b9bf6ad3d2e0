import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from dialectry.llm.packing import pack, with_digest
from dialectry.llm.sharding import assign, shard_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Un gat  e\n dos", None, "", "a" * 3000, "x<|endoftext|>y", "  lead", "trail ", "ñ é ü z 123 it's", "\n\n \t", "word " * 900, "word " * 900]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    want = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in enumerate(TEXTS)}
    pieces = pack(docs.repartition(3), PATH, length=64)
    got = with_digest(pieces).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    for d, own in parts.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == len(want[d])
    assert sorted(parts) == list(range(len(TEXTS))) and sorted(seqs) == list(range(len(seqs)))
    for k, own in seqs.items():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at == 64 or k == max(seqs)
    assert pack(docs.where("doc_id < 0"), PATH).count() == 0
    assert {r.continues for r in pieces.collect()} == {True, False}


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [(i * 7919 - 500, None if i % 9 == 0 else f"é{i}", "x") for i in range(400)] + [(None, "n", "x"), (3, "a", "x"), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard_documents(docs.repartition(5), 16).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        key = r.doc_id or 0
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 16), jump(key, 17), "key") and r.grown_shard in (r.shard, 16)
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard_documents(docs.where("doc_id = 12345678"), 16).count() == 0


def test_columns_with_clashing_names(spark):
    from dialectry.llm.sharding import with_slots

    df = spark.createDataFrame([(i, "w", "p", "r", 5) for i in range(50)], "doc_id long, _walk string, _part string, _row string, slot int")
    got = with_slots(assign(df, 4)).collect()
    assert all((r["_walk"], r["_part"], r["_row"], r.shard) == ("w", "p", "r", jump(r.doc_id, 4)) for r in got)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_shard_numbers(spark, n):
    got = assign(spark.range(0, 3000, 13).withColumnRenamed("id", "doc_id"), n).collect()
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, n), jump(r.doc_id, n + 1)) for r in got)
