"""Quality rules: base counts and divergence of histograms from language references.

A document is described by two histograms: characters by class, and words by
membership of a list of very common words of its language. Both are compared
with the reference of the language, which is the sum of the histograms of all
documents of that language, by the Jensen-Shannon distance (base 2, so 0 to 1).
A minimum number of characters or words guards each comparison. A document that
is far from its language is compared once more, with the mixture of languages
that its common words tell of: texts in several languages are no junk.

Two passes over the texts: one sums the histograms by language (a row for each
partition and known language leaves a task), one judges. The references are a
row for each language of ``COMMON_WORDS``, a fixed number, so they travel in the
closure of the second pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import map_arrow, map_batches

# Very common words of each language, lower case.
COMMON_WORDS = {
    "en": "the of and to in is that for it was on with as be at by this are from or an not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au ne pas avec ou il elle".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o".split(),
}
# The divergences beyond which a document is rejected, and the least sizes they need.
# Few words scatter about their reference: the square of the word distance may exceed its bound by WORD_NOISE / words.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.30, 200
MAX_WORD_DISTANCE, WORD_NOISE, MIN_WORDS = 0.11, 9.5, 50
# The same for mixtures of languages, whose classes must fit more closely.
MIXED_CLASS_DISTANCE, MIXED_WORD_DISTANCE, MIXED_NOISE = 0.178, 0.27, 10.0

SYMBOLS = b"#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "blank", "newline", "stop", "symbol", "other", "beyond_ascii"]


def _class_table() -> np.ndarray:
    """Class of each byte; the continuation bytes of UTF-8 get the last, uncounted class."""
    out = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t",
        "newline": b"\n\r", "stop": b".,", "symbol": SYMBOLS, "beyond_ascii": range(192, 256),
    }.items():
        out[list(members)] = CLASSES.index(name)
    out[128:192] = len(CLASSES)
    return out


CLASS_OF = _class_table()
_TRIM = bytes(32 if (i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128) else i + 32 * (65 <= i <= 90) for i in range(256))
_SYMBOL_RE = re.compile(rb"[#*$%&|<>]")


def class_histogram(raw: bytes) -> np.ndarray:
    """Characters by class, counted on the UTF-8 bytes."""
    return np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[:-1]


#: Place of every common word of any language; the last bin of a word histogram is for all others.
LANGS = list(COMMON_WORDS)
PLACE = {w.encode(): i for i, w in enumerate(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))}
OWN = {lang: np.array(sorted({PLACE[w.encode()] for w in ws})) for lang, ws in COMMON_WORDS.items()}
_SHARED = Counter(i for own in OWN.values() for i in own)
#: Of each language, the places of words that no other language's list has.
ONLY = {lang: np.array([i for i in own if _SHARED[i] == 1]) for lang, own in OWN.items()}


def word_histogram(raw: bytes) -> np.ndarray:
    """Words by place among the common words of all languages, the last bin for all others."""
    words = raw.translate(_TRIM).split()
    out = np.zeros(len(PLACE) + 1, np.int64)
    hits = [k for k in map(PLACE.get, words) if k is not None]
    if hits:
        out[:-1] += np.bincount(hits, minlength=len(PLACE))
    out[-1] = len(words) - len(hits)
    return out


def of_language(words: np.ndarray, lang: str) -> np.ndarray:
    """The histogram with the common words of one language alone."""
    own = words[OWN[lang]]
    return np.append(own, words.sum() - own.sum())


def mixture(words: np.ndarray, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Class and word reference of the mixture of languages with the words that only they have; null without any such word."""
    weights = {}
    for lang, (_, w) in refs.items():
        rate = w[ONLY[lang]].sum() / w.sum()
        if rate and (n := words[ONLY[lang]].sum()):
            weights[lang] = n / rate
    if not weights:
        return None
    total = sum(weights.values())
    return tuple(sum(v / total * refs[lang][k] / refs[lang][k].sum() for lang, v in weights.items()) for k in range(2))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    half = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which occurs twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    v = len(ids)
    if v < 2_000_000:
        code = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:  # the product would overflow: number the pairs first
        pair = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        code = pair[:-1] * v + a[2:]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) - (0 if joined.isascii() else int(np.count_nonzero(CLASS_OF[np.frombuffer(joined, np.uint8)] == len(CLASSES))))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(_SYMBOL_RE.findall(raw)), len(lines) - len(set(lines)), repeat_words(words)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and word histograms of every known language that occurs, summed over all documents of it."""
    known = docs.select("lang", "text").where(F.col("lang").isin(LANGS) & F.col("text").isNotNull())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                at = total.setdefault(lang, [np.zeros(len(CLASSES), np.int64), np.zeros(len(PLACE) + 1, np.int64)])
                at[0] += class_histogram(raw)
                at[1] += word_histogram(raw)
        rows = [(lang, kind, i, int(n)) for lang, at in total.items() for kind, h in enumerate(at) for i, n in enumerate(h)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))],
            names=["lang", "kind", "bin", "n"],
        )

    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows = map_batches(known, sums, "lang string, kind int, bin int, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # languages x bins: a fixed number
        at = out.setdefault(r["lang"], (np.zeros(len(CLASSES), np.int64), np.zeros(len(PLACE) + 1, np.int64)))
        at[r["kind"]][r["bin"]] = r["n"]
    return {lang: at for lang, at in out.items() if at[0].sum() and at[1].sum()}


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)


def judge(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``) and the columns of ``RESULT``, one row for each input row.

    ``docs`` has text and lang. A null text counts as empty; an unknown or null
    lang has no reference, so only the base rules can reject. Repeated rows are
    judged alike; other columns, whatever their names, stay in ``row``. An empty
    table gives none.
    """
    refs = references(docs) if refs is None else refs

    def verdict(text: str | None, lang: str | None) -> tuple:
        base = base_counts(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        far_class = far_word = 0.0
        kept = not failed
        if lang in refs:
            raw = (text or "").encode("utf-8", "surrogatepass")
            chars, words = class_histogram(raw), word_histogram(raw)
            noise = 1 / max(1, base[0])
            if chars.sum() >= MIN_CHARS:
                far_class = js_distance(chars, refs[lang][0])
            if base[0] >= MIN_WORDS:
                far_word = js_distance(of_language(words, lang), of_language(refs[lang][1], lang))
            if kept and (far_class > MAX_CLASS_DISTANCE or far_word**2 > MAX_WORD_DISTANCE**2 + WORD_NOISE * noise):
                mix = mixture(words, refs)
                kept = mix is not None and js_distance(chars, mix[0]) <= MIXED_CLASS_DISTANCE and js_distance(words, mix[1]) ** 2 <= MIXED_WORD_DISTANCE**2 + MIXED_NOISE * noise
        return (*base, failed, kept, far_class, far_word)

    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column(0)
        rows = [verdict(t, lang) for t, lang in zip(row.field("text").to_pylist(), row.field("lang").to_pylist(), strict=True)]
        new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([row, *new], names=["row", *(x.split()[0] for x in RESULT.split(", "))])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return map_arrow(packed, run, f"row {packed.schema['row'].dataType.simpleString()}, {RESULT}")


def op10_quality_divergence(spark, sf_dir: str) -> DataFrame:
    from changelens.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("row.doc_id", *(x.split()[0] for x in RESULT.split(", ")))
