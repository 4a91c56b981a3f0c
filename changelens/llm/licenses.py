"""License scans: ordered signature rules on the words of a text.

A text becomes its lower-case words with single spaces between; rules are
regular expressions on that form. Most are written out one by one in
``license_rules`` (notices, headers, sentences of license bodies, links, names,
exceptions); the rest spell the ways to name a license of ``FAMILIES`` with a
version. A rule runs only where its keyword occurs. Detections are resolved by
priority, then length, then place: one that lies inside a kept one of another
rule goes. The base phrases are always counted and always keep their labels.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from changelens.llm.common import map_arrow, table
from changelens.llm.license_rules import lines as written_rules

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Families, as (label, names as regular expressions on words, versions).
FAMILIES = [
    ("mit", ["mit", "expat"], []),
    ("apache", ["apache(?: software)?"], ["1 0", "1 1", "2 0"]),
    ("gpl", ["gnu general public", "gnu gpl", "gpl"], ["1 0", "2 0", "3 0"]),
    ("lgpl", ["gnu lesser general public", "gnu library general public", "lgpl"], ["2 0", "2 1", "3 0"]),
    ("agpl", ["gnu affero general public", "agpl"], ["1 0", "3 0"]),
    ("mpl", ["mozilla public", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public", "epl"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution", "cddl"], ["1 0", "1 1"]),
    ("eupl", ["european union public", "eupl"], ["1 1", "1 2"]),
    ("artistic", ["artistic"], ["1 0", "2 0"]),
    ("bsd-2-clause", ["bsd 2 clause", "simplified bsd", "freebsd"], []),
    ("bsd-3-clause", ["bsd 3 clause", "new bsd", "modified bsd", "revised bsd"], []),
    ("bsd", ["bsd"], []),
    ("isc", ["isc"], []),
    ("zlib", ["zlib", "zlib libpng"], []),
    ("bsl", ["boost software", "bsl"], ["1 0"]),
    ("unlicense", ["unlicense"], []),
    ("wtfpl", ["wtfpl", "do what the fuck you want to public"], ["2 0"]),
    ("odbl", ["open database", "odbl"], ["1 0"]),
    ("ofl", ["sil open font", "open font", "ofl"], ["1 0", "1 1"]),
    ("cc-by", ["cc by", "creative commons attribution"], ["2 0", "3 0", "4 0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution share ?alike"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution no ?deriv(?:ative)?s"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution non ?commercial"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution non ?commercial share ?alike"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"], ["2 0", "3 0", "4 0"]),
    ("cc0", ["cc0", "creative commons zero"], ["1 0"]),
]
# Ways to name a license, as (pattern, priority); {n} is a name, {v} the version part.
WAYS = [
    ("spdx license identifier {n}{v}", 100),
    ("(?:licensed|released|distributed|available|published|provided)(?: by [^ ]+)? under (?:the )?(?:terms of )?(?:the )?{n}(?: public)?(?: licen[sc]e)?{v}", 90),
    ("under (?:the )?(?:terms of )?(?:the )?{n} licen[sc]e{v}", 80),
    ("{n} licen[sc]e{v}", 70),
    ("licen[sc]e {n}{v}", 60),
]
# Ways that need a version, as they lack the word license.
VERSIONED_WAYS = [("under (?:the )?(?:terms of )?(?:the )?{n}(?: public)?{v}", 75)]
_LATER = "(?: of the licen[sc]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"
# Families whose notices spell versions out, as (label, name, versions).
GNU = [("gpl", "general", "123"), ("lgpl", "lesser general", "3"), ("lgpl", "library general", "2"), ("agpl", "affero general", "3")]


class Rule(NamedTuple):
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int


def _label(family: str, version: str) -> str:
    major, minor = version.split()
    return f"{family}-{major}" if minor == "0" else f"{family}-{major}.{minor}"


@cache
def family_rules() -> list[Rule]:
    """The rules of ``FAMILIES``. One with a version outranks the same way of naming without one."""
    made = []
    for family, names, versions in FAMILIES:
        for name in names:
            for way, priority in WAYS + VERSIONED_WAYS:
                first = re.match(r"[a-z0-9 ]+", name)[0].strip()
                for version in versions:
                    major, minor = version.split()
                    tail = f"(?:(?: version)? (?:v ?)?|v?){major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}")
                    made.append((_label(family, version), first, way.format(n=name, v=tail), priority + 5))
                    made.append((f"{_label(family, version)}-or-later", first, way.format(n=name, v=tail + _LATER), priority + 5))
                if (way, priority) not in VERSIONED_WAYS:
                    made.append((family, first, way.format(n=name, v=""), priority))
    for family, name, versions in GNU:
        for major in versions:
            notice = f"gnu {name} public licen[sc]e as published by the free software foundation(?: either)? version {major}(?: 0)?"
            made.append((f"{family}-{major}", "gnu", notice, 97))
            made.append((f"{family}-{major}-or-later", "gnu", notice + _LATER, 97))
    return [_rule(*m) for m in made]


def _rule(label: str, keyword: str, pattern: str, priority: int) -> Rule:
    return Rule(label, keyword.encode(), re.compile(f" (?=({pattern}) )".encode()), priority)


@cache
def rules() -> list[Rule]:
    """All rules, strongest first."""
    return sorted(family_rules() + [_rule(*m) for m in written_rules()], key=lambda r: -r.priority)


@cache
def _gates() -> tuple[dict[bytes, list[Rule]], dict[bytes, list[Rule]]]:
    """The rules of ``FAMILIES`` by keyword, which may be the start of a word, and the written ones by the first word of theirs."""
    named: dict[bytes, list[Rule]] = {}
    first: dict[bytes, list[Rule]] = {}
    for r in family_rules():
        named.setdefault(r.keyword, []).append(r)
    for m in written_rules():
        first.setdefault(m[1].split()[0].encode(), []).append(_rule(*m))
    return named, first


#: Every rule of ``FAMILIES`` holds one of these.
_HINTS = (b" licens", b" spdx ", b" under ", b" gnu ")
_LOWER = bytes(i + 32 * (65 <= i <= 90) if (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128) else 32 for i in range(256))


class Hit(NamedTuple):
    label: str
    start: int
    end: int
    priority: int


def detections(form: bytes) -> list[Hit]:
    """Resolved detections on the spaced form, places in bytes."""
    form = form.replace(b" licenc", b" licens")
    named, first = _gates()
    tried = [r for word in first.keys() & set(form.split()) for r in first[word] if b" %b " % r.keyword in form]
    if any(h in form for h in _HINTS):
        tried += [r for key, members in named.items() if b" " + key in form for r in members]
    return resolved([Hit(r.label, m.start(1), m.end(1), r.priority) for r in tried for m in r.pattern.finditer(form)])


def resolved(found: list[Hit]) -> list[Hit]:
    """``found``, strongest first, without those that lie inside a kept one.

    A Fenwick tree over the starts holds the furthest end of the kept ones that
    begin there or before, so a text with very many detections is no square.
    """
    place = {s: i for i, s in enumerate(sorted({h.start for h in found}), 1)}
    furthest = [-1] * (len(place) + 1)
    kept: list[Hit] = []
    for h in sorted(found, key=lambda h: (-h.priority, h.start - h.end, h.start, h.label)):
        i, end = place[h.start], -1
        while i:
            end = max(end, furthest[i])
            i -= i & -i
        if end >= h.end:
            continue
        kept.append(h)
        i = place[h.start]
        while i < len(furthest):
            furthest[i] = max(furthest[i], h.end)
            i += i & -i
    return kept


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a whole text; null counts as empty.

    score: the priority of the strongest detection, as a share of the highest; 1 with a base phrase.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    form = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in BASE.items():
        p = f" {phrase} ".encode()
        at = form.find(p)
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = form.find(p, at + 1)
    first = form.count(b" ", 0, min(starts)) if starts else None
    last = form.count(b" ", 0, max(starts)) if starts else None
    hits = detections(form)
    labels = base | {h.label for h in hits}
    score = 1.0 if base else max((h.priority for h in hits), default=0) / 105
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``RESULT``, one row for each row of ``docs`` (doc_id, text).

    A null text counts as empty: no words, no labels, score 0, null first_word
    and last_word. A null doc_id stays; repeated rows get equal rows; an empty
    table gives none; other columns, whatever their names, are ignored.
    """
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {RESULT}")


def op3_license_rules(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
