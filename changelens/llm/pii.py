"""Personal data: base patterns, and bootstrapped contextual extraction of unseen identifiers.

The two words before an identifier are its lexical pattern. Seeds are the base
matches. Every word of the corpus that may be an identifier gives an edge of the
graph of patterns and instances, a table. Spark scores it round by round: seeds
induce the patterns that they fill well, accepted patterns make seeds of the
identifiers in their slots, these induce patterns of the next round, until no
pattern is new. Identifiers in the slots of accepted patterns become spans of
the pattern's kind.

Patterns are tables of any size. What a task carries is a filter of their
hashes of at most ``FILTER_BITS`` bits: it only saves rows, what passes it is
joined with the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import map_arrow, table, written

KINDS = ["email", "ip", "card", "phone"]
#: Distinct trusted instances that a pattern needs, in a corpus of any size.
MIN_SEEDS = 5
FILTER_BITS = 1 << 25
#: Share of trusted instances among all fillers from which a pattern is believed.
MIN_TRUST = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run that fails at its start fails at every later digit too, and no match ends inside a run: starts at run starts suffice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'()[]{}<>.,;:!?"
_SHAPE = re.compile(r"[A-Za-z0-9._%+@#/-]{5,64}")
#: Joints of a name without digits, as in name_at_host; only patterns of mail addresses take it.
_JOINT = re.compile(r"[A-Za-z][._@%+][A-Za-z]")
#: Where a word may be an identifier: a digit, or a joint.
_HINT = re.compile(r"[0-9]|[A-Za-z][._@%+](?=[A-Za-z])")
_BLANK = re.compile(r"\s")
# Digits in groups, for the slots of phones and cards.
_GROUPS = re.compile(r"\+?[(\[]?[0-9](?:[ ().\[\]+-]*[0-9])*")
#: Kinds that are written in several words, with the numbers of digits they have.
WIDE = {"card": (13, 19), "phone": (7, 15)}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from the @ signs, so that long runs without one cost nothing twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in ``KINDS``, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdecimal() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def context(text: str, start: int) -> str | None:
    """The two lower-case words, however long, before the word that starts (behind opening punctuation) at ``start``; null if there are none."""
    s = start
    while s > 0 and start - s < 3 and text[s - 1] in _EDGE:
        s -= 1
    if s == 0 or not text[s - 1].isspace():
        return None
    words = []
    for _ in range(2):
        while s > 0 and text[s - 1].isspace():
            s -= 1
        end = s
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        words.append(text[s:end])
    return f"{words[1]} {words[0]}".lower() if words[1] else None


def pattern_filter(patterns: DataFrame) -> np.ndarray:
    """A bit set of the hashes of ``patterns``: 64 bits for each, ``FILTER_BITS`` at most."""
    n = patterns.count()
    bits = min(FILTER_BITS, 1 << max(12, (n * 64).bit_length()))

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [int(_hashes(p.split())[0]) & (bits - 1) for p in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([x >> 5 for x in at], pa.int64()), pa.array([1 << (x & 31) for x in at], pa.int64())], names=["at", "bit"])

    out = np.zeros(bits >> 5, np.uint32)
    found = map_arrow(patterns.select("pattern"), places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    for r in found.toLocalIterator():  # FILTER_BITS / 32 rows at most
        out[r["at"]] = r["bits"]
    return out


def _hashes(words: list[str]) -> np.ndarray:
    """A hash of each two neighbouring words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    return out ^ (out >> np.uint64(32))


def _slot(text: str, first: int, end: int) -> tuple[int, int, int, int]:
    """start, end, wide start and wide end of the slot at the word from ``first`` to ``end``.

    start, end: the word, without punctuation at its ends. The wide span goes
    over the groups of digits that begin at the slot; it is empty without any.
    """
    s, e = first, end
    while s < e and text[s] in _EDGE:
        s += 1
    while s < e and text[e - 1] in _EDGE:
        e -= 1
    wide = next((m for x in range(first, min(s, first + 3) + 1) if (m := _GROUPS.match(text, x))), None)
    return (s, e, *(wide.span() if wide else (s, s)))


def _slots(text: str, bits: np.ndarray) -> Iterator[tuple[str, int, int, int, int]]:
    """(pattern, and the places of ``_slot``) of the words whose pattern passes the filter."""
    low = text.lower().split()
    if len(low) < 3:
        return
    at = _hashes(low[:-1]) & np.uint64(len(bits) * 32 - 1)
    hits = np.nonzero(bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1))[0].tolist()
    places = [m.span() for m in re.finditer(r"\S+", text)] if hits else []
    for i in hits:  # lower case has the same blanks, so the words are the same
        yield f"{low[i]} {low[i + 1]}", *_slot(text, *places[i + 2])


def _identifiers(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(pattern, and the places of ``_slot``) of the words that hold a digit or the joint of a name."""
    done = 0
    for m in _HINT.finditer(text):
        if m.start() < done:
            continue
        first = m.start()
        while first > done and not text[first - 1].isspace():
            first -= 1
        blank = _BLANK.search(text, m.end())
        done = blank.start() if blank else len(text)
        if pattern := context(text, first):
            yield pattern, *_slot(text, first, done)


def _wide(text: str, kind: str) -> bool:
    return WIDE[kind][0] <= sum(c.isdecimal() for c in text) <= WIDE[kind][1]


def _identifier(word: str, kind: str) -> bool:
    return bool(_SHAPE.fullmatch(word)) and bool(_DIGIT.search(word) or kind == "email" and _JOINT.search(word))


def _filler(text: str, slot: tuple[str, int, int, int, int], kind: str) -> tuple[int, int] | None:
    """The span of the identifier of ``kind`` in a slot; None if it has none."""
    _, s, e, ws, we = slot
    if kind in WIDE and ws < we and _wide(text[ws:we], kind):
        return ws, max(we, e)
    return (s, e) if _identifier(text[s:e], kind) else None


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text").where(F.col("text").isNotNull())


_SLOT_FIELDS = "pattern string, base string, kind string, narrow string, wide string, digits int, n long"


def _occurrences(docs: DataFrame) -> DataFrame:
    """``_SLOT_FIELDS``: every word of the corpus that may be an identifier, with its pattern, equal ones counted.

    base and kind: the base match that meets the slot. narrow: the word, if it
    has the shape of an identifier (shorter and longer words have not); wide and
    digits: the groups of digits that begin there.
    """
    names = [x.split()[0] for x in _SLOT_FIELDS.split(", ")]
    least = min(lo for lo, _ in WIDE.values())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            for pattern, s, e, ws, we in _identifiers(text):
                hits = [x for x in base if x[1] < max(e, we) and s < x[2]] if base else []
                for kind, a, b in hits:
                    if a >= s:  # else it began at a slot before
                        n[pattern, text[a:b], kind, None, None, None] += 1
                if not hits:
                    word, wide = text[s:e], text[ws : max(we, e)] if ws < we else None
                    narrow = word if _identifier(word, "email") else None
                    digits = sum(c.isdecimal() for c in text[ws:we])
                    if narrow or wide and digits >= least:
                        n[pattern, None, None, narrow, wide, digits] += 1
        rows = [(*k, v) for k, v in n.items()]
        types = [pa.string()] * 5 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return map_arrow(_texts(docs), run, _SLOT_FIELDS).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _graph(docs: DataFrame) -> DataFrame:
    """pattern, kind, instance, base, n: what fills the slot of a pattern, for each kind that it may be, with ``MIN_SEEDS`` instances or more.

    A pattern with fewer can be accepted in no round.
    """
    found = written(_occurrences(docs))
    known = found.where("base is not null").select("pattern", "kind", F.col("base").alias("instance"), F.lit(True).alias("base"), "n")
    whole = F.lit(None).cast("string")
    for kind, (least, most) in WIDE.items():
        whole = F.when((F.col("kind") == kind) & F.col("digits").between(least, most), F.col("wide")).otherwise(whole)
    # A word without a digit is an identifier of an e-mail pattern alone.
    narrow = F.when((F.col("kind") == "email") | F.col("narrow").rlike("[0-9]"), F.col("narrow"))
    other = found.where("base is null").withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    other = other.select("pattern", "kind", F.coalesce(whole, narrow).alias("instance"), F.lit(False).alias("base"), "n").where("instance is not null")
    edges = known.unionByName(other).groupBy("pattern", "kind", "instance").agg(F.max("base").alias("base"), F.sum("n").alias("n"))
    # A kind without any base instance has nothing to begin with.
    able = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= MIN_SEEDS).select("pattern", "kind")
    return written(edges.join(able, ["pattern", "kind"]))


def _totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often each of ``patterns`` is followed by any word at all."""
    bits = pattern_filter(patterns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = Counter(slot[0] for text in batch.column(0).to_pylist() for slot in _slots(text, bits))
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pattern", "n"])

    found = map_arrow(_texts(docs), run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return written(found.join(patterns, "pattern", "left_semi"))


def learned(docs: DataFrame) -> DataFrame | None:
    """pattern, kind, score, round of the accepted patterns; None if there are none (an empty table, say).

    Round by round, until no pattern is new: a pattern with ``MIN_SEEDS``
    distinct trusted instances of a kind, whose trust is ``MIN_TRUST`` of all
    that fills its slot, is accepted with that score for good; then every
    identifier in its slot is trusted by what its patterns' scores make of it
    together, base matches wholly. Trust only grows, so the rounds end: each
    but the last accepts a pattern. Shares and not numbers of occurrences
    decide, so copies of the corpus change nothing.
    """
    graph = _graph(docs)
    patterns = graph.select("pattern").distinct()
    if graph.where("base").isEmpty():
        return None
    graph = written(graph.join(_totals(docs, patterns), "pattern"))
    accepted, trusted, turn = None, graph.where("base").select("kind", "instance", F.lit(1.0).alias("trust")).distinct(), 0
    while True:
        turn += 1
        rated = graph.join(trusted, ["kind", "instance"]).groupBy("pattern", "kind", "total")
        rated = rated.agg(F.count(F.lit(1)).alias("seeds"), F.sum(F.col("n") * F.col("trust")).alias("weight"))
        rated = rated.select("pattern", "kind", "seeds", F.least(F.col("weight") / F.col("total"), F.lit(1.0)).alias("score")).where((F.col("seeds") >= MIN_SEEDS) & (F.col("score") >= MIN_TRUST))
        best = rated.groupBy("pattern").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "seeds", "kind")).alias("b"))
        new = best.select("pattern", "b.kind", "b.score", F.lit(turn).alias("round"))
        if accepted is not None:
            new = new.join(accepted, "pattern", "left_anti")
        new = written(new)
        if new.isEmpty():
            return accepted
        accepted = new if accepted is None else written(accepted.unionByName(new))
        reached = graph.join(accepted.select("pattern", "kind", "score"), ["pattern", "kind"])
        reached = reached.groupBy("kind", "instance").agg(F.max("base").alias("base"), (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("t"))
        both = reached.select("kind", "instance", F.col("t").alias("trust")).unionByName(graph.where("base").select("kind", "instance", F.lit(1.0).alias("trust")))
        trusted = written(both.groupBy("kind", "instance").agg(F.max("trust").alias("trust")))


def learn(docs: DataFrame) -> dict[str, str]:
    """The accepted patterns with their kind, for a look at a small corpus; ``find`` and ``redact`` leave them in a table."""
    patterns = learned(docs)
    return {r["pattern"]: r["kind"] for r in patterns.toLocalIterator()} if patterns is not None else {}


def _table(docs: DataFrame, patterns: DataFrame | dict[str, str] | None) -> DataFrame | None:
    if isinstance(patterns, dict):
        return docs.sparkSession.createDataFrame(list(patterns.items()), "pattern string, kind string") if patterns else None
    return learned(docs) if patterns is None else patterns


SPAN = "struct<k:int,s:int,e:int>"


def contextual(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """hash, spans (array of ``SPAN``) of the distinct texts in which a pattern reveals something beside the base spans."""
    bits = pattern_filter(patterns)

    def slots(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = set()
        for h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base = None
            for slot in _slots(text, bits):
                for k, kind in enumerate(KINDS):
                    if span := _filler(text, slot, kind):
                        base = base_spans(text) if base is None else base
                        if not any(a < span[1] and span[0] < b for _, a, b in base):
                            rows.add((h, slot[0], k, *span))
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["hash", "pattern", "k", "s", "e"])

    texts = docs.where(F.col("text").isNotNull()).select(_digest(), "text")
    found = map_arrow(texts, slots, "hash string, pattern string, k int, s int, e int").distinct()
    kinds = patterns.select("pattern", (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int").alias("k"))
    return found.join(kinds, ["pattern", "k"]).groupBy("hash").agg(F.collect_set(F.struct("k", "s", "e")).alias("more"))


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary")).alias("hash")


def _with_more(docs: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """``docs`` with a last column ``more__``, the contextual spans of the text; null without any."""
    if patterns is None:
        return docs.withColumn("more__", F.lit(None).cast(f"array<{SPAN}>"))
    more = contextual(docs, patterns).select(F.col("hash").alias("hash__"), F.col("more").alias("more__"))
    return docs.withColumn("key__", _digest()).join(more, F.col("key__") == F.col("hash__"), "left").drop("key__", "hash__").select(*[F.col(f"`{c}`") for c in docs.columns], "more__")


def all_spans(text: str, more: list[dict] | None) -> tuple[list, list]:
    """Base spans, and base plus contextual spans, both by kind, then start."""
    base = base_spans(text)
    new = {(KINDS[x["k"]], x["s"], x["e"]) for x in more or ()}
    return base, sorted({*base, *new}, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if new else base


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, patterns: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """doc_id and ``RESULT``, one row for each row of ``docs`` (doc_id, text).

    A null text counts as empty, a null doc_id stays; repeated rows get equal
    rows; an empty table gives none; other columns, whatever their names, are
    ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            base, full = all_spans(text or "", more)
            n = Counter(k for k, _, _ in base)
            rows.append((*(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(full)))
        new = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
        return pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(_with_more(docs.select("doc_id", "text"), _table(docs, patterns)), run, f"doc_id {kind}, {RESULT}")


def redact(docs: DataFrame, patterns: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and n_chars set anew.

    Null texts stay null, repeated rows are repeated, an empty table stays empty
    and further columns stay as they are; a doc_id is not needed.
    """
    names = docs.columns
    at = names.index("text")

    def clean(text: str | None, more: list[dict] | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        spans = sorted(all_spans(text, more)[1], key=lambda x: (x[1], -x[2]))
        for kind, s, e in spans:
            if s < done:  # overlaps one that is replaced: hide what is left of it
                done = max(done, e)
                continue
            out += [text[done:s], f"[{kind.upper()}]"]
            done = e
        return "".join(out) + text[done:] if spans else text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        *columns, more = batch.columns
        columns[at] = pa.array(list(map(clean, columns[at].to_pylist(), more.to_pylist())), pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    out = map_arrow(_with_more(docs, _table(docs, patterns)), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op4_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
