import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from claimgraph.llm import pieces

PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", "▁", "é", "漢", "字", "🙂", "\x00", " ", "ﬁ", "<0x0A>", "<s>", "</s>", "<unk>", "  \n", "\r\n", "é", "====", "�", "don't", "12", "²", "का", "​", "...", '",']


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.public_model())


def ids(packed):
    return np.frombuffer(packed, np.int32).tolist()


def test_ids_and_texts_are_the_library_s(library, vocabulary):
    rng, encoder = random.Random(1), pieces.Encoder(vocabulary, kept=500)  # segments leave and come back
    for _ in range(25):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(300)]
        theirs = library.encode(texts, add_eos=True)
        assert [ids(p) for p in encoder.encoded(texts, True, library)] == theirs
        assert [pieces.surface(vocabulary, i) for i in theirs] == library.decode(theirs)


def test_rows_and_heap_agree(vocabulary):
    rng, encoder = random.Random(2), pieces.Encoder(vocabulary)
    segments = ["".join(rng.choices("abcdefinorstuy", k=rng.randint(1, 40))) for _ in range(400)]
    assert encoder.merged(segments) == [encoder.by_heap(s) for s in segments]


def test_decoding_any_ids(library, vocabulary):
    rng = random.Random(3)
    for _ in range(5000):
        some = [rng.choice([rng.randrange(32_000), rng.randrange(260), rng.choice([0, 1, 2, 28705, 259])]) for _ in range(rng.randint(0, 6))]
        assert pieces.surface(vocabulary, some) == library.decode(some)


def test_a_difference_from_the_library_ends_the_job(library, vocabulary):
    class Other:
        def encode(self, texts, **_):
            return [[7] for _ in texts] if isinstance(texts, list) else library.encode(texts)

    for text in ("word", "\nword", "  "):
        with pytest.raises(ValueError):
            pieces.Encoder(vocabulary).encoded([text], True, Other())


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value]) if number < 16 else bytes([number << 3 & 0x7F | 0x80, number >> 4, value])
    return bytes([number << 3 | 2, len(value)]) + value


def model(path, trainer=b"", normalizer=field(4, 0), kind=1, pieces_=("<unk>", "</s>", "▁", "a", "b", "▁a", "ab", "b▁", "▁▁")):
    with open(path, "wb") as f:
        for k, p in enumerate(pieces_):
            f.write(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", -(k // 2)) + field(3, {0: 2, 1: 3}.get(k, kind))))
        f.write(field(2, field(3, 2) + trainer) + field(3, normalizer))
    return str(path)


def test_other_vocabularies(tmp_path):
    """Equal scores, a piece across a space, no byte pieces; what is not of this type is refused."""
    path = model(tmp_path / "m.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.Vocabulary(path))
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab c", k=rng.randint(0, 60))) for _ in range(200)]
    assert [ids(p) for p in encoder.encoded(texts)] == library.encode(texts, add_eos=True)
    for bad in ({"trainer": field(3, 1)}, {"normalizer": b""}, {"kind": 4}):
        with pytest.raises(ValueError):
            pieces.Vocabulary(model(tmp_path / "bad.model", **bad))


def test_frames(spark, docs, empty, library):
    """Null, empty and long texts, repeated rows, clashing columns, an empty table."""
    path = pieces.public_model()
    more = spark.createDataFrame([(900, "x" * 200_000), (901, "é漢🎉\x00 " * 5000), (None, None)], "doc_id long, text string")
    d = docs.select("doc_id", "text").union(more).withColumns({"ids": F.lit("x"), "decoded": F.lit("y")})
    rows = pieces.round_trip(d, path).collect()
    assert len(rows) == d.count()
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == library.decode(r.ids)
    bare = pieces.encode(d, path, end=False)
    assert [r.ids for r in bare.collect()] == [r.ids[:-1] for r in rows]
    again = pieces.decode(spark.createDataFrame([(1, None), (2, [1, 28705, 2])], "doc_id long, ids array<int>"), path).collect()
    assert [r.decoded for r in again] == ["", ""]
    assert pieces.round_trip(empty, path).count() == 0


def test_op11_is_the_library(spark, sf, library):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op11_pieces(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        theirs = library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(theirs), hashlib.sha256(" ".join(map(str, theirs)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(theirs).encode()).hexdigest()
