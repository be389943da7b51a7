import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docquarry.llm.bpe import Encoder, encode_decode
from docquarry.llm.packing import cut_lengths, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "   ", "a", " a", "a ", "a  b", "a   b", "a \n b", "word\n \nfoo", "word\n\n foo", "\n", "\n\nx", "tab\t\tx y", "x y", "it's we'll I'D don't 's",
    "the <|endoftext|> end<|endoftext|><|endoftext|> x", "<|endoftext|>", " <|endoftext|> ", "ünïcödé 漢字 🙂🙂 １２３ ²½ x y", "a" * 5000, "ab" * 3000 + " " * 90 + "c", "\x1c\x1d x\x85y \x1c ",
    "12345 a1b2 !!??  --\r\n\r\n end", "é́ ‍﻿ z　　q", "x   y",
]


def reference(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library():
    rng = random.Random(3)
    alphabet = ["the", "tion", " ", " ", "  ", "\n", "é", "ß", ".", "'s", "12", "\t", "漢", "🙂", "zq", " ", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    t, want = reference(texts)
    for enc in [Encoder(PATH, cache=500)] * 2 + [Encoder(PATH, library=True)] * 2:  # with an empty and with a full cache
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
        bad = [(a, g, w) for a, g, w in zip(texts, got, want, strict=True) if g != w]
        assert not bad, bad[:3]
    assert [enc.decode(np.array(w, "<u4").tobytes()) for w in want] == [t.decode(w, skip_special_tokens=False) for w in want]


def test_encode_decode(spark):
    rows = [(i, x, "y") for i, x in enumerate(ODD)] + [(None, None, None), (3, "a", "b"), (3, "a", "b")]
    out = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    _, want = reference([r[1] or "" for r in rows])
    assert sorted((str(r.doc_id), r.ids.hex(), r.decoded) for r in out) == sorted((str(r[0]), np.array(w, "<u4").tobytes().hex(), r[1] or "") for r, w in zip(rows, want, strict=True))
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_cut_lengths():
    sizes = np.array([1, 2, 3, 7, 8, 9, 4096, 4097, 6000])
    doc, length = cut_lengths(sizes, 2048)
    assert np.bincount(doc, length).tolist() == sizes.tolist()
    assert all(x & (x - 1) == 0 and x <= 2048 for x in length.tolist())
    assert length[doc == 8].tolist() == [2048, 2048, 1024, 512, 256, 64, 32, 16]


def test_pack(spark):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(99, None), (7, ODD[7])]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()
    _, want = reference([r[1] or "" for r in rows])
    want = {r[0]: w + [1] for r, w in zip(rows, want, strict=True)}
    assert len({r.sequence_id for r in out}) == len(out)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in out)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0
    assert sum(r.length for r in out if r.doc_id != 7) == sum(len(w) for i, w in want.items() if i != 7)
    assert sum(r.length for r in out if r.doc_id == 7) == 2 * len(want[7])
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
