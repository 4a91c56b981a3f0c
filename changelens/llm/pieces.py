"""SentencePiece encoding and decoding by a table of distinct marked words.

Where no piece of a model crosses from a word into a white space marker, a text
is cut before every run of markers and its marked words are encoded on their own.

1. Documents are read in blocks of bounded size. A block has its distinct words,
   packed by a hash bucket, and its texts as places in the list of these words.
2. Words are shuffled by bucket. A bucket encodes each distinct word once and
   answers every block with the ids of the words that it asked for.
3. Answers meet the places of their block, and ids are joined back by position.

A word is shuffled once for each block that has it, however often it stands
there, and a bucket's share of the words is that of a hash: frequent words make
no hot keys. Texts themselves are never shuffled, and the packed lists are
compressed.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import map_arrow, map_batches, table

MODEL = "piece_bpe_32k.model"
#: A block ends at so many documents or words, whichever comes first.
BLOCK_DOCS, BLOCK_WORDS = 1 << 14, 1 << 20
#: Words that a bucket gets if all were distinct, and characters of text that make a word for this purpose.
BUCKET_WORDS, CHARS_PER_WORD = 1 << 18, 6
MARK = "▁"
_END = b"\xff"  # no byte of UTF-8
_RUN = re.compile("  +")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if its words can be encoded one by one.

    It must put a marker before a text, turn blanks into markers and change
    nothing else, and no piece may go on with a marker after something else.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " Ａ́  b\tc  "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model rewrites texts: their words cannot be encoded one by one")
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("a piece of the model crosses a white space marker")
    return sp


def spaced(text: str | None) -> str:
    """``text`` with one blank between marked words: further white space of a run, and that at the ends, is spelled as markers.

    A marked word lacks the first of its markers, which encoding adds again;
    markers at the end stay with the last word.
    """
    text = text or ""
    if MARK in text:
        text = text.replace(MARK, " ")
    if text[:1] == " " or text[-1:] == " ":
        body = text.strip(" ")
        before = len(text) - len(text.lstrip(" "))
        text = MARK * before + body + MARK * (len(text) - before - len(body))
    return _RUN.sub(lambda m: " " + MARK * (len(m[0]) - 1), text) if "  " in text else text


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed by planes of bytes: high planes are nearly empty."""
    wide = np.ascontiguousarray(values, "<u4")
    return zstandard.compress(wide.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


_TEXTS = "block long, ids array<long>, sizes array<long>, places binary, words long"
_WORDS = "block long, bucket int, words binary, check long"


def _blocks(docs: DataFrame, buckets: int, texts: bool) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text): their texts as places in the list of words (``_TEXTS``), or that list by bucket (``_WORDS``).

    Words are numbered by bucket, inside a bucket as they come. Both kinds are
    made from the same rows in the same order; ``docs`` is a table, of which a
    task reads the same rows each time.
    """

    def emit(block: int, ids: list, sizes: list[np.ndarray], words: list[pa.Array]) -> pa.RecordBatch:
        seen = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
        raw = seen.dictionary.cast(pa.large_binary()).to_pylist()
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
        order = np.argsort(bucket, kind="stable")
        if texts:
            place = np.empty(len(raw), np.int64)
            place[order] = np.arange(len(raw))
            columns = [pa.array([block]), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, np.concatenate(sizes))), pa.array([_packed(place[seen.indices.to_numpy()])]), pa.array([len(raw)])]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TEXTS.split(", ")])
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        lists = [_END.join(raw[i] for i in part) for part in np.split(order, first[1:])]
        columns = [pa.array([block] * len(lists), pa.int64()), pa.array(bucket[order][first], pa.int32()), pa.array([zstandard.compress(x, 1) for x in lists], pa.binary()), pa.array([zlib.crc32(x) for x in lists], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _WORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        ids, sizes, words, total = [], [], [], 0
        for batch in batches:
            # Few texts at a time, so that a block is closed soon after it is full.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                split = pc.split_pattern(pa.array([spaced(t) for t in part.column(1).to_pylist()], pa.large_string()), " ")
                ids += part.column(0).to_pylist()
                sizes.append(split.value_lengths().to_numpy().astype(np.int64))
                words.append(split.flatten())
                total += len(words[-1])
                if len(ids) >= BLOCK_DOCS or total >= BLOCK_WORDS:
                    yield emit(block, ids, sizes, words)
                    block, ids, sizes, words, total = block + 1, [], [], [], 0
        if ids:
            yield emit(block, ids, sizes, words)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, _TEXTS if texts else _WORDS)


_ANSWERS = "block long, bucket int, sizes binary, ids binary"


def _answers(words: DataFrame, path: str) -> DataFrame:
    """Ids of every word asked for, and how many each has: of each bucket, the distinct words are encoded once."""

    def answer(rows: pa.Table) -> pa.Table:
        table: dict[bytes, int] = {}
        asked = []
        for data, check in zip(rows.column("words").to_pylist(), rows.column("check").to_pylist(), strict=True):
            raw = zstandard.decompress(data)
            if zlib.crc32(raw) != check:
                raise ValueError("a block's words are damaged")
            asked.append(np.array([table.setdefault(w, len(table)) for w in raw.split(_END)], np.int64))
        found = load(path).encode([w.decode("utf-8", "surrogatepass") for w in table], num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate([np.array(x, np.int64) for x in found])
        start = np.cumsum(sizes) - sizes
        out = [(_packed(sizes[a]), _packed(ids[_spread(start[a], sizes[a])])) for a in asked]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "sizes": [x[0] for x in out], "ids": [x[1] for x in out]})

    return words.groupBy("bucket").applyInArrow(answer, _ANSWERS)


def _spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of ``sizes``, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(start - before, sizes) + np.arange(total)


def _joined(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
    """Documents of a block with their ids, from its places (``_TEXTS``) and answers; a batch for some documents at a time."""
    if len(left) != 1:
        raise ValueError("answers without a block, or blocks of one number")
    right = right.sort_by("bucket")
    sizes = [_unpacked(x).astype(np.int64) for x in right.column("sizes").to_pylist()]
    sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    one = left.to_pylist()[0]
    if len(sizes) != one["words"]:
        raise ValueError(f"a block has {one['words']} words and got {len(sizes)} answers: its table gave other rows when read again")
    ids = [_unpacked(x) for x in right.column("ids").to_pylist()]
    ids = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    start = np.cumsum(sizes) - sizes
    places = _unpacked(one["places"]).astype(np.int64)
    ends = np.cumsum(np.array(one["sizes"], np.int64))
    few = 256
    for at in range(0, len(ends), few):
        stops = ends[at : at + few]
        begin = int(ends[at - 1]) if at else 0
        here = places[begin : int(stops[-1])]
        n = np.append(0, np.cumsum(sizes[here]))
        offsets = np.append(0, n[stops - begin]).astype(np.int32)
        values = pa.array(ids[_spread(start[here], sizes[here])], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(one["ids"][at : at + few], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), one row for each row of ``docs`` (doc_id, text): what the library's ``encode`` gives, without begin or end ids.

    Null and empty texts have no ids; repeated rows are encoded each; an empty
    table gives none; extra columns are ignored, whatever their names. ``docs``
    is read twice and must give a task the same rows both times, as tables do:
    counts and checksums of the words find it out if not.
    """
    path = path or model_path()
    load(path)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-chars // (BUCKET_WORDS * CHARS_PER_WORD)))
    answers = _answers(_blocks(docs, buckets, False), path)
    joined = _blocks(docs, buckets, True).groupBy("block").cogroup(answers.groupBy("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_joined(left, right))

    return joined.applyInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) plus ``decoded``: what the library's ``decode`` makes of the ids; null ids are none."""
    path = path or model_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(1)
        flat, ends = ids.flatten().to_numpy().tolist(), np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
        texts = load(path).decode([flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]) if ends else []
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string")


def op12_pieces_distinct(spark, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(listed).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
