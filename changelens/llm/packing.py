"""Packing documents into sequences by minimum bin slack.

A document's ids are cut into pieces of ``CAPACITY`` and a remainder. Which
lengths share a sequence depends on the counts of lengths only, a histogram of
``CAPACITY`` numbers. ``plan`` works on it: a window takes the longest remaining
length, a subset-sum over the multiset of the others (a bitset of reachable
sums, an integer shifted by each length) finds the filling closest to capacity,
and walking the stored bitsets back gives how often each length is in it. The
window is repeated as often as the counts allow. Every step leaves some length
with fewer pieces than the window uses of it, so there are at most
sum(1 + CAPACITY / length), about 9,000 windows whatever the corpus: the table of windows has a
proven bound and is broadcast. Pieces are ranked within their length, by hash
buckets so that a common length is no single task, and find their place by rank.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changelens.llm.common import map_arrow, table, written

CAPACITY = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Pieces of one length that a window task ranks.
BUCKET = 4_000


@cache
def _encoder(name: str):
    """A function from text to ids as the tokenizer ``name`` gives them without added special tokens.

    tiktoken holds the same vocabulary and splitting rule and is several times
    faster; it serves texts within Latin-1 that name no special token, for which
    tests hold both equal. All other texts go to tokenizers itself.
    """
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(str(public_tokenizers.path(f"{name}.json")))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
            plain = not any(s in text for s in special)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return fast.encode_to_numpy(text)
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids: little-endian uint32) of the pieces of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoder(tokenizer)
        row, start, length, crc, tokens, raw = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode(text or ""), END_ID).astype("<u4")
            for s in range(0, len(ids), capacity):
                b = ids[s : s + capacity].tobytes()
                row.append(i)
                start.append(s)
                length.append(len(b) // 4)
                crc.append(zlib.crc32(b))
                tokens.append(len(ids))
                if with_ids:
                    raw.append(b)
        columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return map_arrow(docs.select("doc_id", "text"), run, fields)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often each, of the multiset ``counts``, with the largest sum up to ``room``."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((k for k, c in counts.items() if c > 0 and k <= room), reverse=True):
        most = left = min(counts[length], room // length)
        steps.append((length, most, bits))
        take = 1
        while left:
            take = min(take, left)
            bits |= bits << (take * length) & mask
            left -= take
            take *= 2
        if bits >> room:
            break
    at, out = bits.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if n * length <= at and before >> (at - n * length) & 1)
        if n:
            out[length] = n
            at -= n * length
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows (count of each length) and how often each is used, until no piece is left."""
    counts = {k: c for k, c in counts.items() if c > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        window = fill(counts, capacity - longest)
        counts[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in window.items())
        for k, n in window.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((window, times))
    return out


def places(windows: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> list[tuple]:
    """len_, lo, hi, per, first, at, filled, padded: pieces ranked lo to hi-1 among those of length len_ go,
    ``per`` to a sequence from sequence ``first`` on, to offset ``at`` and behind."""
    used: dict[int, int] = {}
    out, first = [], 0
    for window, times in windows:
        at, filled = 0, sum(k * n for k, n in window.items())
        padded = filled if filled & (filled - 1) == 0 else capacity
        for k in sorted(window, reverse=True):
            lo = used.get(k, 0)
            used[k] = lo + window[k] * times
            out.append((k, lo, used[k], window[k], first, at, filled, padded))
            at += k * window[k]
        first += times
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id, offset, filled and padded_length of their sequences.

    A null text counts as empty (one piece with the end id alone), repeated rows
    are packed each, an empty table gives no sequence; columns of ``docs`` other
    than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    # The salt tells equal rows apart, so that repeated rows go to different buckets.
    made = pieces(docs, tokenizer, capacity, with_ids)
    cut = written(made.withColumn("salt", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    rows = places(plan(counts, capacity), capacity)
    where = spark.createDataFrame(rows, "len_ long, lo long, hi long, per long, first long, at long, filled long, padded_length long")
    buckets = max(1, -(-sum(counts.values()) // BUCKET))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(buckets)))
    sums = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    back = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("length").alias("l_"), F.col("bucket").alias("b_"), F.coalesce(F.sum("n").over(back), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "salt")
    ranked = dealt.withColumn("inner", F.row_number().over(inner) - 1).join(bases, (F.col("length") == F.col("l_")) & (F.col("bucket") == F.col("b_")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("inner"))
    hit = ranked.join(F.broadcast(where), (F.col("length") == F.col("len_")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    sequence = (F.col("first") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id")
    offset = (F.col("at") + F.pmod(k, F.col("per")) * F.col("length")).cast("long").alias("offset")
    return hit.select(*made.columns, sequence, offset, "filled", "padded_length")


def op6_pack_bin_slack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
