import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from dialectry.llm import pieces
from dialectry.llm.common import text_buffer

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "▁", "▁a", "a▁ b", " ▁", "\n", "a\n b\t c", "l'aiga  èra clara ", "x" * 5000, " " * 3000 + "z" + " " * 40, "𝄞 é́ ﬁ ① 　", "<s> </s> <unk> <0x0A>", "\u0000 ﻿a", "▂ ▂▁▀", "un un un un dos"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def made(seed, n):
    rnd = random.Random(seed)
    letters = ["a", "e", "the", " ", " ", "  ", "▁", "é", "œ", "𝄞", "中", "\n", ".", "ing", "0", "́", "<", "▂"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_against_the_library(spark, library):
    texts = TEXTS + made(1, 400)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "sens id", "x"), (3, "again", "x")], "doc_id long, text string, ids string").repartition(3)
    got = pieces.decoded(pieces.encoded(docs, PATH), PATH).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "sens id" if r.doc_id is None else "again" if r.doc_id == 3 and r.decoded == "again" else texts[r.doc_id] or ""
        assert r.ids == library.encode(text)
        assert r.decoded == library.decode(r.ids)
    digests = {r.doc_id: r for r in pieces.with_digests(pieces.decoded(pieces.encoded(docs.where("doc_id in (0, 14)"), PATH), PATH)).collect()}
    ids = library.encode(TEXTS[14])
    assert digests[14].n_tokens == len(ids) and digests[14].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digests[0].n_tokens == 0 and digests[0].ids_sha256 == digests[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.encoded(docs.where("doc_id < 0"), PATH).count() == 0


def test_each_word_is_segmented_once(library):
    class Counting:
        calls = []

        def __getattr__(self, name):
            return getattr(library, name)

        def encode(self, words, **kw):
            self.calls += words
            return library.encode(words, **kw)

    table = pieces.ChunkTable(Counting())
    for texts in (["un dos un", "un"], ["dos tres", "un dos"]):
        table.ids(*text_buffer(pa.array(texts)))
    assert sorted(Counting.calls) == ["dos", "tres", "un"]


def test_a_full_table_is_begun_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "HELD", 50)
    table = pieces.ChunkTable(library)
    for seed in range(8):
        texts = made(seed, 30)
        ids, at = table.ids(*text_buffer(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library.encode(texts)
    assert len(table.number) < 400


def test_any_ids_are_decoded(library):
    rnd, table = random.Random(2), pieces.PieceTable(library)
    lists = [[rnd.choice([rnd.randrange(300), rnd.randrange(32000), 28705, 259]) for _ in range(rnd.randrange(12))] for _ in range(500)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert table.texts(np.array([i for x in lists for i in x]), at) == [library.decode(x) if x else "" for x in lists]
