import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_hold_every_id_once(edge_docs, edge_rows):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = packing.pack(edge_docs, PATH, window=128).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append(p)
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert len(ids) == p["length"] and zlib.crc32(ids.tobytes()) == p["ids_crc32"]
    assert sorted(windows) == list(range(len(windows)))
    for number, ps in windows.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 128 or number == len(windows) - 1
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in edge_rows)
    rows, row = [], []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        if p["start"] == 0 and row:
            rows.append(row)
            row = []
        assert p["start"] == len(row)
        row = row + np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        if len(row) == p["doc_tokens"]:
            rows.append(row)
            row = []
    assert sorted(rows) == want and not row


def test_pieces_of_texts_are_encoded_like_the_whole():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["a b", " a", "a ", "a  b", "a \n b", "it's 'll x", "tab\tx y", "  x", "x　 y", "<|endoftext|> <|endoftext|>", "1 2 3!! a", "", "́ e \U0001f600 z", "x\x1c y"]
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts += ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>", "<|endoftex", *texts[:3], "first first first"]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.PieceIds(PATH).of(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sequences_are_padded_unless_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "a " * 100)], "doc_id long, text string")
    out = packing.sequences(packing.pack(docs, PATH, window=64), window=64).orderBy("sequence_id").collect()
    assert [len(r["ids"]) for r in out] == [64, 64] and out[0]["doc_ids"] == [1]
    one = packing.sequences(packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH)).collect()
    assert [r["ids"] for r in one] == [[0]]


def test_no_rows(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []
