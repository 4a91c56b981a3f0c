"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link when they differ in at most ``RADIUS`` bits. ``COVERS`` are
2^(RADIUS+1) - 1 bit masks built as in covering LSH (Pagh, 2016): every bit
position gets a non-zero code of RADIUS+1 bits, and mask v keeps the positions
whose code has odd parity with v. Up to RADIUS differing positions span at most
RADIUS dimensions, so some v is orthogonal to all of them, and under that mask
the two fingerprints agree: every pair within the radius meets in some table.

Linking never emits all pairs of a bucket:

1. equal fingerprints are one node (aggregated before anything is shuffled by key);
2. in every bucket each node is compared with the smallest, then the largest
   node: star edges, one row for each node and table;
3. their connected components label the nodes; a bucket whose nodes have one
   label is done. In the others only nodes outside the bucket's most frequent
   component are compared with the whole bucket, and each keeps one link to
   every component it reaches.

The result is exact: two nodes with different labels that share a bucket are
compared, nodes with equal labels need no comparison.

``keep_one``, the stage of the pipeline, has limits of its own: 5-word shingles
and a Jaccard similarity of 0.8. Its texts meet under the same masks of their
fingerprints, every pair within ``RADIUS``, and, as similar texts may differ in
more bits than masks can reach, also in bands of MinHash; links are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import ascii_lower, map_arrow, table, written

RADIUS = 4
SHINGLE = 4
_CHUNK = 1 << 16

#: Limits of ``keep_one``. Bands of MinHash meet at 0.8 with probability 1 - (1 - 0.8^BAND_ROWS)^BANDS = 0.9993, above with more.
KEEP_SHINGLE, KEEP_SIMILARITY = 5, 0.8
BANDS, BAND_ROWS, LIKELY = 24, 6, 0.65
#: 64-bit words of an odd sketch.
SKETCH = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = np.array([[xxhash.xxh64_intdigest(b"multiply", i) | 1] for i in range(BANDS * BAND_ROWS)], np.uint64)
_ADD = np.array([[xxhash.xxh64_intdigest(b"add", i)] for i in range(BANDS * BAND_ROWS)], np.uint64)


def covers(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks, as signed 64-bit integers; codes go round the non-zero values so that they occur evenly."""
    n = 1 << (radius + 1)
    code = [1 + (i * 11 + i // (n - 1)) % (n - 1) for i in range(bits)]
    out = []
    for v in range(1, n):
        mask = sum(1 << i for i, c in enumerate(code) if bin(c & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


_COVERS = np.array(covers(), np.int64)


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text over its 4-word shingles, as a signed 64-bit integer; zero without words."""
    words = ascii_lower(text or "").split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        starts, ends = first[:n].tolist(), (first + lengths)[SHINGLE - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``fp`` (long), one row for each row of ``docs``, from its text."""
    n = len(keep)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array([fingerprint(t) for t in batch.column(n).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:n], fp], names=[*keep, "fp"])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text__")), run, f"{fields}, fp long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node of its component) of the nodes of ``edges`` (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014), each
    written to the shared folder, until the edges no longer change. Minima are
    aggregated before the shuffle, so a hub costs no task more than its edges.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(rows: DataFrame, large: bool) -> DataFrame:
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else rows
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("u", "m").alias("m"))
        linked = both.join(least, F.col("a") == F.col("u"))
        if large:  # neighbours above the node go to the smallest neighbour
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # neighbours below the node, and itself, go to the smallest of them
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        edges = written(star(star(edges, True), False))
        after = state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def _close(x: str, y: str, radius: int):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius


def _shared_buckets(keyed: DataFrame) -> DataFrame:
    """``keyed`` (fp, t, key) of the buckets of two nodes or more, with lo, hi (their smallest and largest node) and n.

    Spark sizes exploded rows as if each were one still and would send all of
    them to every executor, through the driver: both sides are shuffled instead.
    """
    ends = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(ends.hint("merge"), ["t", "key"])


def link(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp``, ``label`` of every fingerprint of ``nodes`` (distinct ``fp``) that has a link.

    label: smallest fingerprint of its component of the graph of all pairs within ``radius``.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in covers(radius)])
    keyed = nodes.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("t", "key"))
    full = written(_shared_buckets(keyed))
    stars = full.select(F.col("fp").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where(F.expr("a <> b") & _close("a", "b", radius))
    edges = written(stars.distinct())
    # Buckets of two are settled by their star.
    full = full.where("n > 2").select("t", "key", "fp")
    labels = written(connected_components(edges))
    named = full.join(labels, F.col("fp") == F.col("node"), "left").select("t", "key", "fp", F.coalesce("label", "fp").alias("label"))
    sizes = named.groupBy("t", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("t", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    open_ = written(named.join(mixed.drop("k"), ["t", "key"]))
    few = open_.where("label <> main").select("t", "key", F.col("fp").alias("x"), F.col("label").alias("xl"))
    found = few.join(open_, ["t", "key"]).where((F.col("xl") != F.col("label")) & _close("x", "fp", radius))
    more = written(found.groupBy("x", "label").agg(F.min("fp").alias("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if more.limit(1).count():  # every pair of different labels was compared, so these edges complete the graph
        labels = written(connected_components(edges.unionByName(more)))
    return labels.select(F.col("node").alias("fp"), "label")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id (and ``keep``), one row for each row of ``docs``.

    A text that is null or has no word has fingerprint zero and links like any
    other. component_id is the smallest doc_id of the component; rows without
    doc_id take part in links but are never that minimum (null if no row of the
    component has a doc_id). Repeated rows and doc_ids are kept.
    """
    keep = keep or []
    prints = written(fingerprints(docs, ["doc_id", *keep]))
    own = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = link(own.select("fp"))
    joined = own.join(labels, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    ids = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = joined.join(ids, "label").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(by_fp, F.col("fp") == F.col("fp_")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep
    )


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the ``KEEP_SHINGLE``-word shingles; a shorter text is one shingle, one without words has none."""
    words = ascii_lower(text or "").split()
    if len(words) < KEEP_SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - KEEP_SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for j in range(KEEP_SHINGLE):
        out = (out ^ h[j : j + n]) * _ODD
        out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of the MinHash signature, as signed 64-bit integers; and seven bits of each minimum, seven minima to an integer."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024] * _MULTIPLY + _ADD).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.zeros(BANDS, np.uint64)
    for j in range(BAND_ROWS):
        keys = (keys ^ rows[:, j]) * _ODD
        keys ^= keys >> np.uint64(29)
    bits = np.append(least * _ODD >> np.uint64(57), np.zeros(-len(least) % 7, np.uint64)).reshape(-1, 7)
    return keys.view(np.int64), (bits << (np.arange(7, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64).view(np.int64)


def set_fingerprint(shingles: np.ndarray) -> np.int64:
    """SimHash of a set of shingle hashes, as ``fingerprint`` makes it of those of a text."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        ones += np.unpackbits(shingles[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)[0]


def meeting_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the tables where near copies meet, bands of MinHash and then the fingerprint under each mask, and the signature of ``band_keys``."""
    keys, signature = band_keys(shingles)
    return np.append(keys, _COVERS & set_fingerprint(shingles)), signature


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of ``KEEP_SIMILARITY`` or more; two empty ones have."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    if min(len(x), len(y)) < KEEP_SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= KEEP_SIMILARITY * (len(x) + len(y) - both)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """``SKETCH`` signed 64-bit integers of parity bits: a shingle flips one bit, so what two sets share cancels out of the XOR of their sketches."""
    at = (shingles * _ODD) >> np.uint64(64 - (SKETCH * 64 - 1).bit_length())
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH * 64) % 2).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sketches(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """fp, n (shingles), odd (sketch) of the ``nodes`` (fp, distinct)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        new = [pa.array([len(x) for x in sets], pa.int64()), pa.array([odd_sketch(x) for x in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *new], names=["fp", "n", "odd"])

    return map_arrow(texts.join(nodes, F.col("hash") == F.col("fp"), "left_semi").select("hash", "text"), run, "fp long, n long, odd array<long>")


def _may_be_similar(x: str, y: str, nx: str, ny: str) -> Column:
    """False only where two sets cannot be similar: bits in which their sketches differ are at most the shingles that only one has.

    J >= s holds if those are at most (1 - s) / (1 + s) of both sizes' sum.
    """
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH)), F.lit(0))
    return apart <= (F.col(nx) + F.col(ny)) * ((1 - KEEP_SIMILARITY) / (1 + KEEP_SIMILARITY)) + 1e-6


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts are similar."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[int, np.ndarray] = {}
        ok = []
        for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for node, text in ((a, ta), (b, tb)):
                if node not in sets:
                    sets[node] = shingle_set(text)
            ok.append(similar(sets[a], sets[b]))
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first, second = (texts.select(F.col("hash").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return map_arrow(pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb"), run, "a long, b long")


def _alike(x: str, y: str) -> Column:
    """Whether two signatures agree in ``LIKELY`` of their minima: similar texts do but for 4.5 standard deviations.

    Minima lie in bytes whose highest bit is free: adding 127 sets it where two differ.
    """
    full, high = sum(0x7F << 8 * j for j in range(7)), sum(0x80 << 8 * j for j in range(7))
    n = BANDS * BAND_ROWS
    apart = sum((F.bit_count((F.col(x)[i].bitwiseXOR(F.col(y)[i]) + F.lit(full)).bitwiseAND(F.lit(high))) for i in range(-(-n // 7))), F.lit(0))
    return apart <= int((1 - LIKELY) * n)


def _likely(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose signatures are alike."""
    first, second = (prints.select(F.col("fp").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").where(_alike("sa", "sb")).select("a", "b")


def _open_buckets(full: DataFrame, labels: DataFrame) -> DataFrame:
    """t, key, fp, label, main, n of the buckets whose nodes have several labels; main: the most frequent one, n: their size."""
    named = full.join(labels, F.col("fp") == F.col("node"), "left").select("t", "key", "fp", F.coalesce("label", "fp").alias("label"))
    sizes = named.groupBy("t", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("t", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where("k > 1")
    return written(named.join(mixed.drop("k"), ["t", "key"]))


def _hub_pairs(open_: DataFrame, turn: int) -> DataFrame:
    """a, b: every node outside the component of its bucket's hub, and the hub.

    The hub is first the node that shares buckets with most others, the middle
    of a group of near copies, then a node of the main component by chance.
    """
    if turn:
        rank = F.struct((F.col("label") == F.col("main")).alias("m"), F.xxhash64(F.lit(turn), "fp").alias("h"), "fp")
        rated = open_
    else:
        rated = open_.join(open_.groupBy("fp").agg(F.sum("n").alias("shared")), "fp")
        rank = F.struct("shared", "fp")
    hubs = rated.groupBy("t", "key").agg(F.max_by(F.struct("fp", "label"), rank).alias("hub"))
    pairs = open_.join(hubs, ["t", "key"]).where(F.col("label") != F.col("hub.label"))
    return pairs.select(F.greatest("fp", "hub.fp").alias("a"), F.least("fp", "hub.fp").alias("b")).distinct()


def similar_texts(texts: DataFrame) -> DataFrame:
    """``node``, ``label`` of the hashes of ``texts`` (hash, text; distinct) that have a link, as in ``link``.

    Candidates share a band or a masked fingerprint; every link is verified on the texts. Stars of the
    buckets come first. Where a bucket keeps several labels, its nodes are
    compared with one hub after another, for as long as that finds links; then
    all pairs of different labels of which one is outside the bucket's most
    frequent component; the join drops those whose sketches show that they
    cannot be similar.
    """

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [meeting_keys(shingle_set(t)) for t in batch.column(1).to_pylist()]
        new = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in range(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), *new], names=["fp", "keys", "sig"])

    prints = written(map_arrow(texts.select("hash", "text"), keys, "fp long, keys array<long>, sig array<long>"))
    keyed = prints.select("fp", F.posexplode("keys").alias("t", "key"))
    full = written(_shared_buckets(keyed))
    stars = full.select(F.col("fp").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b").distinct()
    edges = written(_verified(_likely(stars, prints), texts))
    full = full.where("n > 2").select("t", "key", "fp")
    labels = written(connected_components(edges))
    open_, turn = _open_buckets(full, labels), 0
    while not open_.isEmpty():
        more = written(_verified(_likely(_hub_pairs(open_, turn), prints), texts))
        if more.isEmpty() and turn:
            break
        if not more.isEmpty():
            edges = written(edges.unionByName(more))
            labels = written(connected_components(edges))
            open_ = _open_buckets(full, labels)
        turn += 1
    sketches = _sketches(open_.select("fp").distinct(), texts).join(prints.select("fp", "sig"), "fp")
    signed = open_.select("t", "key", "fp", "label", "main").join(written(sketches), "fp")
    few = signed.where("label <> main").select(*[F.col(c).alias(f"{c}_") for c in ("t", "key", "fp", "label", "sig", "odd", "n")])
    other = (F.col("label_") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("fp_") < F.col("fp")))
    close = _alike("sig_", "sig") & _may_be_similar("odd_", "odd", "n_", "n")
    found = few.join(signed, (F.col("t_") == F.col("t")) & (F.col("key_") == F.col("key")) & other & close)
    found = found.select(F.greatest("fp_", "fp").alias("a"), F.least("fp_", "fp").alias("b")).distinct()
    more = written(_verified(found, texts))
    if not more.isEmpty():
        labels = written(connected_components(edges.unionByName(more)))
    return labels


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each component of similar texts: that of the smallest doc_id, ties by the hash of the text.

    Texts link from a Jaccard similarity of ``KEEP_SIMILARITY`` of their shingle
    sets; the limits of the fingerprints above have no part in it.
    """
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("hash"))
    # Equal texts are one node, combined before the shuffle.
    own = tagged.groupBy("hash").agg(F.first("text").alias("text"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("s"))
    own = written(own)
    labels = similar_texts(own.select("hash", "text"))
    joined = own.drop("text").join(labels, F.col("hash") == F.col("node"), "left")
    best = joined.groupBy(F.coalesce("label", "hash").alias("g")).agg(F.min(F.struct("s.none", "s.doc_id", "hash")).alias("s"))
    best = best.select(F.col("s.doc_id").alias("best_id"), F.col("s.hash").alias("best_hash"))
    hit = tagged.drop("text").join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("hash") == F.col("best_hash")), "left_semi")
    return hit.dropDuplicates(["doc_id", "hash"]).select("row.*")


def op1_simhash_covering(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
