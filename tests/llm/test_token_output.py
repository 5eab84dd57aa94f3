import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from auditflow.llm import token_output
from auditflow.llm.queries import QUERIES, tokenizer_path
from auditflow.llm.token_output import Encoder, read_documents, read_stretch, shuffle_planes, token_index, unshuffle_planes, write_tokens


def plain(rows):
    tokenizer, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_matches_plain_version_on_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, QUERIES["op6_bit_plane_tokens"](spark, sf_dir).collect())) == plain(rows)


@pytest.mark.parametrize("text", [
    "A  b\tc\r\nd\x0be\x0cf", "it's WE'LL <|endoftext|> x<|startoftext|>y", "é ́a b c", "ΣΑΣ ΟΔΟΣ", "日本語 ١٢٣ 12345", "\u0000​﻿",
    "Straße ÀÉÎ×÷ don't'll x's're '' '' a1b22-c3!! ... <|startoftext|> <|x y|> ÿŸİ ǅ ﬁ", "the.The,the'Ve ¿Cuánto? «guillemets» ½ ²",
])
def test_parts_between_blanks_encode_alone(text):
    ids = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Encoder(tokenizer_path()).encode([text])[0], "<u4").tolist() == ids


def test_pieces_of_plain_texts(monkeypatch):
    """Many texts at once, cut into stretches, with long pieces and pieces that differ late."""
    pick = random.Random(4)
    letters = "abÀÿéß019 \t\n.,-!&ZÖ"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(200))) for _ in range(300)]
    texts += ["x" * n + c for n in (7, 8, 9, 15, 16, 31, 32, 33, 500) for c in "ab."] + ["", " ", None, "=" * 90, "it's", "don't 'start", "日本 a,b", "a" * 40 + " b c"]
    library = Tokenizer.from_file(tokenizer_path())
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for stretch in (1 << 21, 100, 7):
        monkeypatch.setattr(token_output, "STRETCH", stretch)
        encoder = Encoder(tokenizer_path())
        encoder.pieces.size = 50  # generations change all the time
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [1, 7, 8, 65_536])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    planes = shuffle_planes(ids, bits=bits)
    assert len(planes) == (32 if bits else 4) and (unshuffle_planes(planes, n) == ids).all()


def test_awkward_rows(spark, awkward, no_rows, monkeypatch):
    got = token_index(spark, write_tokens(awkward, tokenizer_path())).orderBy("start").collect()
    assert len(got) == awkward.count()
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and [r["doc_id"] for r in got][:2] == [None, None]
    texts = {}
    for r in awkward.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(plain([tuple(r)])[0][2:])
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(x for v in texts.values() for x in v)
    assert token_index(spark, write_tokens(no_rows, tokenizer_path())).count() == 0


def test_stretches_and_bit_planes(spark, awkward):
    folder = write_tokens(awkward.where("doc_id in (7, 8)").coalesce(1), tokenizer_path(), bits=True)
    docs = sorted(read_documents(spark, folder).collect(), key=lambda r: (r["part"], r["segment"], r["start"]))
    first = docs[0]
    whole = np.frombuffer(bytes(first["ids"]), "<u4")
    assert len(whole) == first["n_tokens"] > token_output.CHUNK_IDS
    at = token_output.CHUNK_IDS - 5
    got = read_stretch(spark, folder, first["part"], first["segment"], first["start"] + at, 20)
    assert got.tolist() == whole[at : at + 20].tolist()
