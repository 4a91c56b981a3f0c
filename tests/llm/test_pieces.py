"""Encoding by distinct words against the library on whole texts."""

import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from changelens.llm import pieces
from changelens.llm.queries import queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "  a   b  ", "\n", "a\nb \n c\t d", "▁", "▁a ▁▁ b▁c", "é ü 日本語 \U0001f600 x", "<s> a </s> <unk> <0x41>", "\x00 \x7f", "　x y",
    "();\r\n\t▁\r {\r", "lorem ipsum dolor " * 20_000, "x" * 30_000, "a", "a", "ﬁ Å é", "� ​",
]


def test_words_cover_texts(library):
    for t in TEXTS:
        assert [i for w in pieces.spaced(t).split(" ") for i in library.encode(w)] == library.encode(t or "")


def test_query_equals_library(spark, sf, duck, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t in duck.sql("select doc_id, text from documents").fetchall():
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = queries()["op12_pieces_distinct"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("words", [1 << 20, 3])
def test_edges(spark, library, monkeypatch, words):
    monkeypatch.setattr(pieces, "BLOCK_WORDS", words)
    monkeypatch.setattr(pieces, "BUCKET_WORDS", words * 100)
    df = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for c in ("block", "bucket", "ids", "sizes", "words", "places"):
        df = df.withColumn(c, F.lit("clash"))
    got = pieces.decode(pieces.encode(df)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i if i % 5 else None, library.encode(t or "")) for i, t in enumerate(TEXTS)]
    want = [(d, ids, library.decode(ids)) for d, ids in want]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert pieces.decode(pieces.encode(df.limit(0))).collect() == []


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """Answers go out for every block that asks, words are encoded by bucket: buckets share no word."""
    df = spark.createDataFrame([(i, f"the same words and word{i}") for i in range(40)], "doc_id long, text string").repartition(6)
    monkeypatch.setattr(pieces, "BLOCK_WORDS", 20)
    words = [(r["bucket"], w) for r in pieces._blocks(df, 7, False).collect() for w in pieces.zstandard.decompress(r["words"]).split(pieces._END)]
    assert len({w for _, w in words}) == 44 and len(set(words)) == 44 and len(words) > 60


def test_rows_that_change_are_found_out(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    left = pieces._blocks(df, 1, True).toArrow()
    with pytest.raises(ValueError, match="other rows"):
        list(pieces._joined(left, pieces._answers(pieces._blocks(df.limit(0), 1, False), pieces.model_path()).toArrow()))


def test_unsuited_models_are_refused(monkeypatch):
    class Crossing:
        normalize = staticmethod(lambda t: "▁" + t.replace(" ", "▁"))
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", lambda model_file: Crossing())
    with pytest.raises(ValueError, match="crosses"):
        pieces.load("crossing")
    Crossing.normalize = staticmethod(str.lower)
    with pytest.raises(ValueError, match="rewrites"):
        pieces.load("rewriting")
