"""Operators against brute force, round trips and edge cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import chat, flac, licenses, mixing, packing, pii, quality, simhash, urls, warc
from changelens.llm.queries import oracle_sql, queries
from tests.conftest import rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names that operators use."""
    data = [
        (1, "a b c d e f g", "en", "s1", 13), (1, "a b c d e f g", "en", "s1", 13), (2, None, None, None, None), (3, "", "xx", "", 0), (None, "a b c d e f g", "en", "s1", 13),
        (4, LONG, "en", "s2", len(LONG)), (5, " \t\n", "de", "s2", 3), (5, "other words stand here now and then", "fr", None, 5), (6, "é ü 日本 \U0001f600 x", "en", "s1", 9),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("fp", "size", "start", "kept", "row", "component_id", "label", "taken", "bucket", "length", "hash", "tie", "words"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    if not w:
        return 0
    import xxhash

    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest member of each node's component of the graph of pairs within four bits."""
    fps, parent = sorted(fps), {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {f: root(f) for f in fps}


def test_covers_cover_every_pattern():
    masks = [m & (2**64 - 1) for m in simhash.covers()]
    rng = random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not diff & m for m in masks)


def test_simhash_query(spark, sf, duck):
    got = {r["doc_id"]: r for r in queries()["op1_simhash_covering"](spark, sf).collect()}
    docs = duck.sql("select doc_id, text from documents").fetchall()
    fp = {d: fingerprint(t) for d, t in docs}
    comp = components(set(fp.values()))
    least = {}
    for d, f in fp.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    assert len(got) == len(docs)
    for d, f in fp.items():
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{f:016x}", least[comp[f]])


def test_links_of_dense_and_chained_groups(spark):
    rng = random.Random(3)
    signed = lambda x: x - 2**64 if x >> 63 else x
    nodes = {rng.getrandbits(64) for _ in range(150)}
    hub = rng.getrandbits(64)
    flips = rng.sample(range(64), 12)
    nodes |= {hub ^ sum(1 << b for b in flips if rng.random() < 0.25) for _ in range(400)}  # many near copies
    step = rng.getrandbits(64)
    for b in rng.sample(range(64), 40):  # a chain of four bits a step
        step ^= 1 << b
        nodes.add(step)
    for x in list(nodes)[:60]:
        nodes.add(x ^ sum(1 << b for b in rng.sample(range(64), 4)))
        nodes.add(x ^ sum(1 << b for b in rng.sample(range(64), 5)))
    fps = {signed(x) for x in nodes}
    got = {r["fp"]: r["label"] for r in simhash.link(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = components(fps)
    assert {x: got.get(x, x) for x in fps} == want


def test_simhash_edges(spark, edge):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == 9
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    zero = "0" * 16
    assert by[(2, zero)] == by[(3, zero)] == by[(5, zero)] == 2
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {1}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 4, 5, 6])
    assert simhash.near_duplicates(edge.limit(0)).collect() == [] and simhash.keep_one(edge.limit(0)).collect() == []


def similar_groups(texts):
    """Smallest id of each text's component of the graph of all pairs with a Jaccard similarity of 0.8 or more."""
    sets, group = {}, {}
    for d, t in sorted(texts.items()):
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
        group[d] = d
        for e in [e for e in sets if e != d]:
            if 4 * len(sets[d]) <= 5 * len(sets[e]) <= 25 / 4 * len(sets[d]) and len(sets[d] & sets[e]) * 5 >= 4 * len(sets[d] | sets[e]):
                x, y = sorted((group[d], group[e]))
                group = {k: x if g == y else g for k, g in group.items()}
    return group


def test_signatures_alike(spark):
    """The comparison of packed signatures against the minima themselves."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[: int(400 * s)], rng.integers(0, 2**63, 400 - int(400 * s), dtype=np.uint64)))) for s in (1, 0.95, 0.9, 0.8, 0.6, 0.3, 0)]
    sigs = [simhash.band_keys(x)[1] for x in sets]
    minima = [np.concatenate([(s >> (8 * j)) & 127 for j in range(7)]) for s in sigs]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    df = spark.createDataFrame([(i, j, sigs[i].tolist(), sigs[j].tolist()) for i, j in pairs], "i int, j int, x array<long>, y array<long>")
    got = {(r["i"], r["j"]): r["ok"] for r in df.select("i", "j", simhash._alike("x", "y").alias("ok")).collect()}
    n = simhash.BANDS * simhash.BAND_ROWS
    assert got == {(i, j): bool((minima[i] != minima[j]).sum() <= int((1 - simhash.LIKELY) * n)) for i, j in pairs}
    assert got[0, 1] and not got[0, 6] and len(set(got.values())) == 2


def test_sketches_lose_no_similar_pair(spark):
    """At, above and below the limit, short and long sets and empty ones: no similar pair goes; unlike ones go where sketches are not full (9000 fill them)."""
    rng = np.random.default_rng(5)
    sets = [np.array([], np.uint64)]
    for n in (1, 9, 90, 900, 9000):
        base = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for share in (0, 0.02, 0.1, 0.111, 0.13, 0.2, 0.4):
            new = int(n * share)
            sets.append(np.unique(np.concatenate([base[new:], rng.integers(0, 2**64, new, np.uint64)])))
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    odd = [simhash.odd_sketch(s).tolist() for s in sets]
    data = [(i, j, odd[i], odd[j], len(sets[i]), len(sets[j])) for i, j in pairs]
    df = spark.createDataFrame(data, "i int, j int, x array<long>, y array<long>, nx long, ny long")
    got = {(r["i"], r["j"]): r["ok"] for r in df.select("i", "j", simhash._may_be_similar("x", "y", "nx", "ny").alias("ok")).collect()}
    alike = {(i, j) for i, j in pairs if simhash.similar(sets[i], sets[j])}
    assert len(alike) > 60 and all(got[p] for p in alike)
    unlike = [(i, j) for i, j in pairs if (i, j) not in alike and max(len(sets[i]), len(sets[j])) <= 900]
    assert sum(got[p] for p in unlike) < 0.05 * len(unlike) and not got[15, 21] and not got[22, 28]


def test_near_dedup_against_all_pairs(spark):
    """Copies with a word changed here and there, against the components of all pairs with a Jaccard of 0.8 or more."""
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 300)) for _ in range(rng.randint(60, 400))]
        for _ in range(14):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randint(0, len(base) // 30)):
                copy[at] = f"new{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    group, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                far += bin((fingerprint(texts[i]) ^ fingerprint(texts[j])) & (2**64 - 1)).count("1") > 4
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    assert far > 50 and len(set(group)) > 12  # most links are none of op1, and not all copies link
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(set(group))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(queries()[name](spark, sf)) == rows(duck.sql(oracle_sql()[name]).df())


def test_chat_examples(spark):
    tricky = "<|im_end|><|im_start|>assistant\\ ok|\\|"
    data = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "us\ner", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"), (2, None, None, "x"), (3, 0, "assistant", LONG), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    expanded = chat.expand(df)
    ex = expanded.orderBy("conv_id", "example").collect()
    one = [r for r in ex if r["conv_id"] == 1]
    assert [r["is_target"] for r in one] == [True, True, False]
    assert one[2]["context"]["chars"] == len(one[0]["segment"]) + len(one[1]["segment"]) and one[2]["context"]["segments"] == 2 and one[2]["context"]["turns"] == 4
    assert all(r["segment"].count(chat.START) == r["n_turns"] for r in ex)
    # Whole examples: every assistant turn once, with all turns before it, only its reply under the mask.
    whole = {(r["conv_id"], r["example"]): r for r in chat.with_context(expanded).collect()}
    assert sorted(whole) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    assert whole[1, 1]["text"] == one[0]["segment"] + one[1]["segment"] and whole[1, 1]["text"].startswith(whole[1, 0]["text"])
    said = {k: r["text"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] for k, r in whole.items()}
    assert re.sub(r"(?s)\\(.)", r"\1", said[1, 0]) == tricky and said[1, 1] == "" and said[3, 1] == LONG
    for change in ("chars + 1", "checksum + 1", "segments - 1"):
        field = change.split()[0]
        bad = expanded.withColumn("context", F.col("context").withField(field, F.expr(f"context.{change}")))
        with pytest.raises(Exception, match="context does not fit"):
            chat.read_back(bad).collect()
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{tricky}\nassistant\n{tricky}\nus\ner\n\nassistant\n\nuser\ntail\n")
    assert (got[1]["loss_sha256"], got[1]["loss_chars"], got[1]["n_turns"]) == (sha(tricky), len(tricky), 5)
    assert got[2]["turns_sha256"] == sha("\nx\n") and got[2]["loss_chars"] == 0
    assert got[3]["loss_chars"] == 2 * len(LONG)
    assert {c: r["expanded_chars"] for c, r in got.items()} == {c: sum(len(x["text"]) for k, x in whole.items() if k[0] == c) for c in (1, 2, 3)}
    none = df.where("conv_id = 1").withColumn("conv_id", F.lit(None).cast("long"))
    assert [tuple(r)[1:] for r in chat.read_back(chat.expand(none)).collect()] == [tuple(got[1])[1:]]
    assert chat.read_back(chat.expand(df.limit(0))).collect() == []


def test_chat_examples_are_whole_in_the_query(spark):
    """The query's examples hold their contexts, and its results come from these texts."""
    data = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(7)]
    ex = chat.expand(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    texts = [r["text"] for r in ex.orderBy("example").collect()]
    turn = lambda i: f"{chat.START}{data[i][2]}\n{data[i][3]}{chat.END}\n"
    assert texts == ["".join(map(turn, range(n))) for n in (2, 4, 6, 7)]
    for where in ("turn 0", "turn 2", "turn 3"):
        bad = ex.withColumn("text", F.when(F.col("example") == 2, F.regexp_replace("text", where, where[:-1] + "9")).otherwise(F.col("text")))
        with pytest.raises(Exception, match="context does not fit"):
            chat.read_back(bad).collect()
    assert chat.read_back(ex.withColumn("segment", F.lit("not read"))).collect() == chat.read_back(ex).collect()


def license_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hit
        labels |= {label} if hit else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_query(spark, sf, duck):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = queries()["op3_license_rules"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:6] == license_base(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_license_rules():
    assert len(licenses.rules()) > 300
    scan = lambda t: licenses.scan(t)[5]
    assert scan("SPDX-License-Identifier: GPL-2.0-only") == "gpl-2"
    assert scan("Licensed under the GNU Lesser General Public License, version 2.1.") == "lgpl-2.1"
    assert scan("Permission is hereby granted, free of charge, to any person obtaining a copy of this software") == "mit"
    assert scan("Das ist mit der Zeit so.") == "" and scan("the apache helicopter") == ""
    inner = licenses.detections(b" licensed under the mit license today ")
    assert [h.priority for h in inner] == [90]  # what lies inside of a stronger detection goes
    for t in ("under the under the mit license cc-by-nc-by-nc", LONG + " under the MIT license", None, "É MIT under ÉX", "cc by nc cc by nc"):
        assert licenses.scan(t)[:5] == license_base(t)


def test_license_spellings():
    scan = lambda t: set(licenses.scan(t)[5].split(","))
    assert scan("This is licensed under the GPLv3.") == scan("License: GPLv3") == scan("use it under the GPL version 3 here") == {"gpl-3"}
    assert scan("licensed under LGPLv2.1 only") == {"lgpl-2.1"}
    assert "gpl-2-or-later" in scan("SPDX-License-Identifier: GPL-2.0-or-later")
    assert "gpl-3-or-later" in scan("the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    assert "dual" in scan("dual-licensed under MIT and Apache 2.0") and "classpath-exception" in scan("GPL with the Classpath exception")
    assert scan("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == {"mpl-2"}
    assert scan("the gplv of v3 tables and a file under 3 tables") == {""}


def example_of(pattern):
    """A text that a written rule matches: optional parts left out, the first of alternatives, a word for any word."""
    while True:
        plain = re.sub(r"\(\?:[^()]*\)[?*]", "", pattern)
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\{[^}]*\})?", r"\1", plain)
        if plain == pattern:
            break
        pattern = plain
    pattern = re.sub(r"(?<=[^ ]) \?", "", pattern.split("|")[0])
    pattern = re.sub(r".\?", "", pattern.replace(" ?", " ")).replace("[^ ]+", "word")
    return " ".join(re.sub(r"\[(.)[^]]*\]", r"\1", pattern).split())


def test_license_written_rules():
    """Each written rule finds a text made from itself, behind its keyword; and there are hundreds, no two alike."""
    lines = licenses.written_rules()
    assert len(lines) > 250 and len({(x[0], x[2]) for x in lines}) == len(lines)
    for label, keyword, pattern, priority in lines:
        text = example_of(pattern)
        form = f" so {text} it is ".encode()
        rule = licenses._rule(label, keyword, pattern, priority)
        found = rule.pattern.search(form)
        assert found, (pattern, text)
        assert f" {keyword} ".encode() in form, (keyword, text)
        hits = licenses.detections(form)  # the rule's own detection stays, or lies inside a stronger one
        assert any(h.start <= found.start(1) and found.end(1) <= h.end and h.priority >= priority for h in hits), text


def labels_by_hand(text):
    """Every rule on the whole text without gates, every pair of detections compared."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    form = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    form = form.replace(" licenc", " licens").encode()
    hits = [licenses.Hit(r.label, m.start(1), m.end(1), r.priority) for r in licenses.rules() for m in r.pattern.finditer(form)]
    kept = []
    for h in sorted(hits, key=lambda h: (-h.priority, h.start - h.end, h.start, h.label)):
        if not any(k.start <= h.start and h.end <= k.end for k in kept):
            kept.append(h)
    return {h.label for h in kept}, max((h.priority for h in kept), default=0) / 105


def test_license_labels_against_hand(spark, sf, duck):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    rng = random.Random(9)
    extra = {10_000_000 + i: " ".join(example_of(rng.choice(licenses.written_rules())[2]) if rng.random() < 0.7 else rng.choice(["under the MIT license", "CC BY-NC", "of the", "licence"]) for _ in range(rng.randint(1, 8))) for i in range(60)}
    df = spark.createDataFrame([(k, t) for k, t in extra.items()], "doc_id long, text string")
    got = queries()["op3_license_rules"](spark, sf).collect() + licenses.find(df).collect()
    assert len(got) == len(docs) + len(extra)
    for r in got:
        text = docs[r["doc_id"]] if r["doc_id"] in docs else extra[r["doc_id"]]
        labels, score = labels_by_hand(text)
        base = set(filter(None, r["base_labels"].split(",")))
        assert r["labels"] == ",".join(sorted(labels | base)) and r["score"] == pytest.approx(1.0 if base else score)


def test_license_edges(spark, edge):
    got = licenses.find(edge).collect()
    assert len(got) == 9 and licenses.find(edge.limit(0)).collect() == []
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert by[2] == by[3] == [(0, 0, None, None, "", "", 0.0)] and by[1][0] == by[1][1] == by[None][0] == (7, 0, None, None, "", "", 0.0)
    assert by[4][0][0] == 100_000 and len(by[5]) == 2


def test_license_suppression_against_all_pairs():
    rng = random.Random(11)
    for _ in range(200):
        hits = [licenses.Hit(rng.choice("ab"), at := rng.randint(0, 30), at + rng.randint(1, 12), rng.choice((20, 60, 90))) for _ in range(rng.randint(0, 25))]
        kept = []
        for h in sorted(hits, key=lambda h: (-h.priority, h.start - h.end, h.start, h.label)):
            if not any(k.start <= h.start and h.end <= k.end for k in kept):
                kept.append(h)
        assert licenses.resolved(hits) == kept
    many = licenses.detections(b" under the mit license" * 100_000 + b" ")  # a square of these would not end
    assert len(many) == 100_000


def pii_base(text):
    """By the patterns as they stand, one after the other."""
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in pats.items():
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_pii_base_against_patterns(duck):
    texts = [t for (t,) in duck.sql("select text from documents").fetchall()]
    rng = random.Random(5)
    alphabet = "ab1239.@.@-+ ()_%5\né"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "a@b@c.d", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "+1 2", "+12345678++1(22)333-4444", "4111 1111 1111 1111", "4111-1111-1111-1111-", "01.002.0003.255"]
    for t in texts:
        assert pii.base_spans(t) == pii_base(t), t


def test_pii_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "1-" * 150_000):
        pii.base_spans(t)


def test_pii_bootstrap(spark):
    mails = [(i, f"text {i} please write contact mail user{i}@host{i}.example.com today or not") for i in range(30)]
    odd = [(100 + i, f"please write contact mail user{i}_at_host{i} today") for i in range(3)]
    plain = [(200 + i, f"the mail was here {i} and of the number {i + 10000} in it") for i in range(30)]
    df = spark.createDataFrame(mails + odd + plain, "doc_id long, text string")
    patterns = pii.learn(df)
    assert patterns == {"contact mail": "email"}
    got = {r["doc_id"]: r for r in pii.find(df, patterns).collect()}
    t = odd[0][1]
    s = t.index("user0")
    assert got[100]["spans"] == f"email:{s}:{s + len('user0_at_host0')}" and got[100]["n_email"] == 0
    assert all(got[200 + i]["spans"] == "" for i in range(30))
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, patterns).collect()}
    assert red[0] == "text 0 please write contact mail [EMAIL] today or not" and red[100] == "please write contact mail [EMAIL] today"


def test_pii_patterns_do_not_depend_on_other_documents(spark):
    """A pattern of a few seeds stays a candidate beside many contexts that occur once."""
    own = [(i, f"write to the contact mail user{i}@host{i}.example.com today") for i in range(8)] + [(50, "see the contact mail joe_at_host today")]
    others = [(100 + i, f"then word{i} other{i} u{i}@h{i}.example.org stands") for i in range(20_000)]
    df = spark.createDataFrame(own + others, "doc_id long, text string")
    assert pii.learn(df) == {"contact mail": "email"}
    spans = {r["doc_id"]: r["spans"] for r in pii.find(df).where("doc_id < 100").collect()}
    assert spans[50] == "email:21:32"  # has no digit


def patterns_by_hand(texts):
    """The rounds of the bootstrap on plain dictionaries, for texts whose identifiers are single words."""
    edges, total = Counter(), Counter()
    for text in texts:
        words = text.split()
        for i in range(2, len(words)):
            pattern, word = f"{words[i - 2]} {words[i - 1]}".lower(), words[i].strip(".,")
            total[pattern] += 1
            base = {(k, word) for k, *_ in pii_base(word)}
            shaped = len(word) >= 5 and re.fullmatch(r"[A-Za-z0-9._%+@#/-]{5,64}", word)
            kinds = {k for k, _ in base} or {k for k in pii.KINDS if shaped and (re.search("[0-9]", word) or k == "email" and re.search("[A-Za-z][._@%+][A-Za-z]", word))}
            for k in kinds:
                edges[pattern, k, word, bool(base)] += 1
    trust = {(k, w): 1.0 for (_, k, w, b) in edges if b}
    base, accepted, turn = dict(trust), {}, 0
    while True:
        turn += 1
        seeds, weight = {}, Counter()
        for (p, k, w, _), n in edges.items():
            if (k, w) in trust:
                seeds.setdefault((p, k), set()).add(w)
                weight[p, k] += n * trust[k, w]
        new = {}
        for (p, k), ws in seeds.items():
            score = min(1.0, weight[p, k] / total[p])
            if p not in accepted and len(ws) >= 5 and score >= 0.6 and (score, len(ws), k) > new.get(p, (0, 0, "")):
                new[p] = (score, len(ws), k)
        if not new:
            return {p: (k, turn_) for p, (k, _, turn_) in accepted.items()}
        accepted |= {p: (k, score, turn) for p, (score, _, k) in new.items()}
        trust, miss = dict(base), {}
        for p, k, w in {e[:3] for e in edges}:
            if p in accepted and accepted[p][0] == k:
                miss[k, w] = miss.get((k, w), 1.0) * (1 - accepted[p][1])
        for key, m in miss.items():
            trust[key] = max(trust.get(key, 0), 1 - max(m, 1e-9))


def bootstrap_rows():
    """The first pattern reveals names, the names a second one, that one handles of a third."""
    rows = [f"you may write contact mail user{i}@host{i}.example.com today" for i in range(100)]
    rows += [f"you may write contact mail user{i}_at_host{i} today" for i in range(20)]
    rows += [f"the person signed as user{i}_at_host{i} in the book" for i in range(20)]
    rows += [f"the person signed as guest{i}_at_inn{i} in the book" for i in range(5)]
    rows += [f"so we met old guest{i}_at_inn{i} there and met old user{i}_at_host{i} too" for i in range(5)]
    rows += ["they met old friend_of_mine there", "they went to room 1234567 of the inn", "they went to room 7654321 of the inn"]
    rows += [f"a server stands at address {i}.2.3.{i} now" for i in range(5)] + ["it stands at address nowhere at all"] * 2
    return rows


def test_pii_rounds_against_hand(spark):
    texts = bootstrap_rows()
    want = patterns_by_hand(texts)
    assert {"contact mail": ("email", 1), "signed as": ("email", 2), "met old": ("email", 3)}.items() <= want.items()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["pattern"]: (r["kind"], r["round"]) for r in pii.learned(df).collect()}
    assert got == want
    t = "the person signed as guest3_at_inn3 in the book"
    spans = {r["spans"] for r in pii.find(df).where(F.col("doc_id") == texts.index(t)).collect()}
    assert spans == {"email:21:35"}  # only the second round finds it
    ten = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 10)], "doc_id long, text string")
    assert {r["pattern"]: (r["kind"], r["round"]) for r in pii.learned(ten).collect()} == want


def test_pii_contexts_of_any_length(spark):
    w = "x" * 500
    assert pii.context(f"{w} mail a@b.c", 506) == f"{w} mail" and pii.context("mail a@b.c", 5) is None
    df = spark.createDataFrame([(i, f"so {w}\u0130  {w} us{i}@ho.st is") for i in range(5)] + [(9, f"so {w}\u0130 {w} us_at_host is")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}[9] == "email:1006:1016"


def test_pii_spaced_phones_and_cards(spark):
    phones = [(i, f"please call us phone number: +1 (974) 555-{3000 + i} or not") for i in range(9)]
    cards = [(100 + i, f"paid with the card number {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} today") for i in range(9) if (c := next(x for x in (f"4111{1000 + i}22223{k:03}" for k in range(1000)) if pii.luhn(x)))]
    odd = [(200, "call us phone number: (974) 555-3436 or not"), (201, "with the card number 4111 1111 1111 1112 today")]
    df = spark.createDataFrame(phones + cards + odd, "doc_id long, text string")
    assert pii.learn(df) == {"phone number:": "phone", "card number": "card"}
    spans = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    for d, kind, text in ((200, "phone", "(974) 555-3436"), (201, "card", "4111 1111 1111 1112")):
        s = dict(odd)[d].index(text)
        assert spans[d] == f"{kind}:{s}:{s + len(text)}"
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[200] == "call us phone number: [PHONE] or not" and red[201] == "with the card number [CARD] today"


def test_pii_query(spark, sf, duck):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    for r in queries()["op4_pii_bootstrap"](spark, sf).collect():
        base = pii_base(docs[r["doc_id"]])
        n = Counter(k for k, *_ in base)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_pii_edges(spark, edge):
    got = pii.find(edge).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 9 and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, nothing, "")} and pii.find(edge).columns[0] == "doc_id"
    assert pii.find(edge.limit(0)).count() == 0 and pii.learn(edge) == {} and pii.redact(edge.limit(0)).count() == 0
    out = pii.redact(edge)
    assert rows(out.drop("n_chars")) == rows(edge.drop("n_chars"))  # nothing to hide in it
    assert out.columns == edge.columns and out.where("text is null").count() == 1


def targets_by_rounds(sizes):
    """Shares by weight; who passes three times their size stops, and the rest is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    done = {}
    while len(done) < len(sizes):
        left = sum(sizes.values()) - sum(done.values())
        open_ = [s for s in order if s not in done]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3.0 * sizes[s] for s in over}
    return done


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0}, {"é": 7, "z": 900, None: 40, "": 1, "b": 3}, {"a": 1, "b": 1, "c": 10_000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(targets_by_rounds(sizes))


def test_permutations(spark):
    for n in (1, 2, 3, 5, 10, 97, 1000, 4097):
        df = spark.range(n)
        got = [[r["p"] for r in mixing.permuted(df, "p", F.col("id"), F.lit(n).cast("long"), F.lit(k)).orderBy("id").collect()] for k in ("a", "b")]
        assert sorted(got[0]) == sorted(got[1]) == list(range(n))
        assert n < 97 or got[0] != got[1]


def test_mix_query(spark, sf, duck):
    docs = {d: (s, len(WORDS.findall(t or ""))) for d, s, t in duck.sql("select doc_id, source, text from documents").fetchall()}
    sizes = Counter()
    for s, n in docs.values():
        sizes[s] += n
    want, taken = targets_by_rounds(dict(sizes)), Counter()
    got = queries()["op5_mix_sources"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        s, n = docs[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries()["op5_mix_sources"](spark, sf).collect()))


def test_mix_edges(spark, edge):
    got = mixing.taken_words(edge).collect()
    assert len(got) == 9 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.taken_words(edge.limit(0)).count() == 0
    out = mixing.mix(edge)
    n = out.select(F.sum(mixing.n_words())).first()[0]
    assert out.columns == edge.columns and n == sum(r["taken"] for r in got)
    assert mixing.mix(edge.limit(0)).count() == 0


def slots_by_hand(size, target, block):
    """Words of every slot of a source, by block kind: how often whole blocks, the short block and cut blocks are used."""
    t = min(round(target), 3 * size)
    full, short = divmod(size, block)
    passes, rest = divmod(t, size)
    out = Counter({block: passes * full})
    out[short] += passes * (short > 0)
    while rest > 0:
        out[min(rest, block)] += 1
        rest -= block
    return Counter({k: n for k, n in out.items() if k and n})


def test_slots_are_dealt_once(spark, sf):
    docs = mixing.written(mixing._narrow(spark.read.parquet(f"{sf}/documents.parquet")))
    placed, slots, _ = mixing.mixed(docs)
    seen = [(r["shard"], r["place"]) for r in slots.collect()]
    assert len(seen) == len(set(seen)) and sorted(s * mixing.SHARD + p for s, p in seen) == list(range(len(seen)))


def test_draws_are_multinomial_and_totals_hold(spark):
    sizes = {"a": 400_000, "b": 90_000, "c": 1000, None: 60_000, "tiny": 3}
    plan = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = {r["source"]: r for r in plan.collect()}
    got = mixing.slots(plan, block=64, shard=128).collect()
    per = {s: Counter(r["words"] for r in got if r["source"] == s) for s in sizes}
    slots = {s: slots_by_hand(n, want[s]["target"], 64) for s, n in sizes.items()}
    assert {s: c.total() for s, c in per.items()} == {s: c.total() for s, c in slots.items()}
    assert {s: sum(k * n for k, n in c.items()) for s, c in per.items()} == {s: round(want[s]["target"]) for s in sizes}
    # No block is used more often than passes over its source allow, and by passes alike.
    for s, n in sizes.items():
        used = Counter(r["block"] for r in got if r["source"] == s)
        assert max(used.values()) - min(used.get(b, 0) for b in range(-(-n // 64))) <= 1
    # The counts of the large sources in the shards scatter as multinomial counts do.
    total = len(got)
    assert sorted((r["shard"], r["place"]) for r in got) == [divmod(i, 128) for i in range(total)]
    for s in ("a", "b", None):
        share = slots[s].total() / total
        counts = Counter(r["shard"] for r in got if r["source"] == s)
        shards = range(total // 128)
        spread = np.var([counts.get(k, 0) for k in shards]) / (128 * share * (1 - share))
        assert 0.6 < spread < 1.5
    # Blocks follow no order over the shards.
    order = [r["block"] for r in sorted(got, key=lambda r: (r["shard"], r["place"])) if r["source"] == "a"]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1
    assert mixing.slots(plan.limit(0)).count() == 0


def test_mix_rows_have_places(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs, with_place=True)
    taken = mixing.taken_words(docs)
    assert got.columns == [*docs.columns, "shard", "place"] and got.where("shard is null or place is null").count() == 0
    words = rows(got.groupBy("doc_id").agg(F.sum(mixing.n_words()).alias("taken"), F.min(F.struct("shard", "place")).alias("first")))
    assert words == rows(taken.where("taken > 0").select("doc_id", "taken", F.struct("shard", "place").alias("first")))


def subset_best(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 12))]
        room = rng.randint(0, 90)
        got = packing.fill(Counter(lengths), room)
        assert sum(k * n for k, n in got.items()) == subset_best(lengths, room)
        assert all(n <= Counter(lengths)[k] for k, n in got.items())


def test_pack_query(spark, sf, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs = duck.sql("select doc_id, text from documents").fetchall()
    got = queries()["op6_pack_bin_slack"](spark, sf).toPandas()
    by_doc = dict(tuple(got.groupby("doc_id")))
    for d, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in by_doc[d].sort_values("start").itertuples():
            piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece))
            at += r.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024 and (g.filled == g.length.sum()).all()
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.95
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


def test_pack_edges(spark, edge):
    got = packing.pack(edge, with_ids=True).toPandas()
    assert len(got[got.doc_id == 2]) == 1 and got[got.doc_id == 2].length.iloc[0] == 1
    assert (got.ids.map(len) == 4 * got.length).all() and packing.pack(edge.limit(0)).count() == 0
    enc = packing._encoder("byte_bpe_50k")
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for t in ("<|endoftext|> a", "日本語 text", "\u00a0\u2003 x \r\n\t", "ÿþ ½ naïve  ", "a" * 3000, "  \n\n  "):
        assert list(enc(t)) == tok.encode(t, add_special_tokens=False).ids


def test_warc_segments_and_edges(spark):
    big = "<p>ü\r\n\r\nWARC/1.1\r\n</p>" * 20_000
    data = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "x" * 100), (None, "u", "x" * 100), (8, "u", "x" * 100), (8, "u", "x" * 100)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(df).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (by[1][0]["record_type"], by[1][0]["payload_digest"], by[1][0]["payload_bytes"]) == ("response", sha(big), len(big.encode()))
    assert (by[2][0]["record_type"], by[2][0]["refers_to"], by[2][0]["payload_bytes"]) == ("revisit", 1, len(big.encode()))
    assert by[3][0]["payload_digest"] == sha("") and by[6][0]["record_type"] == "response"
    assert [r["refers_to"] for r in by[8]] == [7, 7] and by[None][0]["refers_to"] == 7
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_damage(spark):
    body = bytes(range(256)) * 400
    recs = list(warc.records(1, "u", body, "d", None))
    assert len(recs) > 2
    parsed = list(warc.parse(b"".join(r + b"\r\n\r\n" for r in recs)))
    assert warc.payload(b"".join(b for _, b in parsed)) == body and parsed[-1][0]["warc-segment-total-length"]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises((warc.Damaged, ValueError)):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises((warc.Damaged, ValueError)):
        list(warc.parse(recs[0][:-5]))


def test_flac_round_trip():
    rng = random.Random(4)
    payloads = [bytes(64), b"a" * 5000, rng.randbytes(70_000), bytes([0, 255] * 3000), bytes(range(256)) * 9, ("naïve text " * 900).encode(), b"x", b""]
    wave = np.rint(60 * np.sin(np.arange(5000) / 3) + 30 * np.sin(np.arange(5000) / 7)).astype(np.int8)
    payloads += [flac.payload_from(wave), flac.payload_from(wave[:100])]
    streams = flac.encode(payloads)
    for p, s, (samples, blocks) in zip(payloads, streams, flac.decode(streams), strict=True):
        assert flac.payload_from(samples) == p
        assert sum(n for *_, n in blocks) == len(p)
        for offset, at, n in blocks:
            assert s[at : at + 2] == b"\xff\xf8" and flac.seek(s, offset) <= at and n
    assert flac.encode(payloads) == streams
    kinds = lambda s: {s[sub] >> 1 for _, _, sub in flac._frame_starts(s, flac._headers(s)[2], flac._headers(s)[0])}
    assert kinds(streams[-2]) == {31 + flac.LPC} and len(streams[-2]) < 0.7 * 5000  # linear predictors win on a wave
    assert kinds(streams[1]) <= {8, 9, 10}
    assert sorted(set(flac.TO_SAMPLE.tolist())) == list(range(-128, 128))
    bad = bytearray(streams[3])
    bad[-1] ^= 1  # the checksum of a frame: its stream alone fails, the others are read side by side
    with pytest.raises(flac.Damaged):
        flac.decode([*streams, bytes(bad)])
    frames = [(s, *flac._frame_starts(s, flac._headers(s)[2], flac._headers(s)[0])[0]) for s in (streams[0], bytes(bad))]
    assert flac._one_or_none(frames[0]) is not None
    for i in (len(streams[2]) // 2, len(streams[2]) - 1, 30):
        bad = bytearray(streams[2])
        bad[i] ^= 0x10
        with pytest.raises((flac.Damaged, IndexError, ValueError)):
            flac.decode([bytes(bad)])


def bits_of(fields):
    return "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)


def frame(n, subframe, number=0):
    head = b"\xff\xf8\x70\x02" + flac._coded_number(number) + (n - 1).to_bytes(2, "big")
    body = subframe + "0" * (-len(subframe) % 8)
    raw = head + bytes([flac.crc8(head)]) + int(body, 2).to_bytes(len(body) // 8, "big")
    return raw + int(flac.crc16([raw])[0]).to_bytes(2, "big")


def rice(values, k):
    out = ""
    for v in values:
        u = v * 2 if v >= 0 else -v * 2 - 1
        out += "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")
    return out


def test_flac_of_other_writers():
    """Linear prediction with coefficients, several partitions, escapes, verbatim and constant frames."""
    x = [3, 7, 12, 18, 20, 19, 15, 9, 2, -5, -11, -14, -13, -9, -3, 4]
    lpc = [x[i] - ((3 * x[i - 1] - 2 * x[i - 2]) >> 1) for i in range(2, 16)]
    sub = bits_of([(0, 1), (32 + 1, 6), (0, 1), (x[0], 8), (x[1], 8), (3, 4), (1, 5), (3, 4), (-2, 4), (0, 2), (1, 4)])
    sub += bits_of([(1, 4)]) + rice(lpc[:6], 1) + bits_of([(15, 4), (7, 5)]) + bits_of([(v, 7) for v in lpc[6:]])
    verbatim = bits_of([(0, 1), (1, 6), (0, 1), *((v, 8) for v in x)])
    constant = bits_of([(0, 1), (0, 6), (0, 1), (-7, 8)])
    fixed4 = bits_of([(0, 1), (12, 6), (0, 1), *((v, 8) for v in x[:4]), (1, 2), (0, 4), (2, 5)])
    fixed4 += rice([x[i] - 4 * x[i - 1] + 6 * x[i - 2] - 4 * x[i - 3] + x[i - 4] for i in range(4, 16)], 2)
    for want, s in ((x, sub), (x, verbatim), ([-7] * 16, constant), (x, fixed4)):
        whole = flac._stream(np.array(want, np.int8), [frame(16, s)])
        assert flac.decode([whole])[0][0].tolist() == want
    # Many frames of another writer behind each other cost no more than their length.
    n = 3000
    long = flac._stream(np.array(x * n, np.int8), []) + b"".join(frame(16, sub, i) for i in range(n))
    assert flac.decode([long])[0][0].tolist() == x * n


def test_flac_query(spark, sf, duck, edge):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    for r in queries()["op8_flac_media"](spark, sf).collect():
        n, p = flac.payload_of(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["n_blocks"] == -(-len(p) // flac.BLOCK) and 0 < r["last_byte_offset"] < r["media_bytes"]
    media = flac.to_media(edge)
    got = flac.measure(flac.pcm_blocks(media)).collect()
    assert len(got) == 9 and len({tuple(r)[1:] for r in got if r["doc_id"] in (1, None)}) == 1
    assert [r["payload_bytes"] for r in got if r["doc_id"] in (2, 3)] == [64, 64]
    stream = media.where("doc_id = 4").first()["media"]
    blocks = flac.pcm_blocks(media.where("doc_id = 4")).first()["blocks"]
    whole = flac.payload_from(np.frombuffer(b"".join(b["pcm"] for b in blocks), np.int8))
    assert whole.startswith(LONG.encode()) and not whole[len(LONG) :].strip(b"\0")
    at = 0
    for b in blocks:  # each block can be read on its own from its place in the stream
        assert b["sample_offset"] == at and len(b["pcm"]) == b["n_samples"]
        if at % (50 * flac.BLOCK) == 0:
            n, p = flac._frame_header(stream, b["byte_offset"])
            assert flac._decode_frames([(stream, b["byte_offset"], n, p)])[0][0].tobytes() == b["pcm"]
        at += b["n_samples"]
    assert flac.measure(flac.pcm_blocks(flac.to_media(edge.limit(0)))).count() == 0


def url_base(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_url_query(spark, sf, duck):
    got = queries()["op9_url_gbt"](spark, sf).collect()
    want = dict(duck.sql("select page_id, url from pages").fetchall())
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = url_base(want[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_url_edges_and_features(spark):
    us = [None, "", "nothing", "http://A.Example.COM/en/x", "http://www.example.com/en/", "http://com", "http://com/?q", "x://y://z/a?b#c", "http://É.net/es/1", "ftp://example.com?en/", "http://net/fr/" + "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(us)), "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("label", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, u in enumerate(us):
        host, path, rule, verdict = url_base(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and (verdict is None or got[i]["verdict"] == verdict)
    assert urls.judge(df.limit(0)).collect() == []
    twice = urls.judge(df.unionByName(df).unionByName(df.limit(1).withColumn("page_id", F.lit(None).cast("int"))))
    assert twice.count() == 2 * len(us) + 1 and twice.where("page_id is not null").distinct().count() == len(us)
    f = {r["page_id"]: r for r in urls.lexical(urls.split_url(df.select("page_id", "url"))).collect()}
    for i in (3, 7, 8):
        c = Counter(us[i].lower())
        n = sum(c.values())
        assert f[i]["f_entropy"] == pytest.approx(-sum(v / n * math.log2(v / n) for v in c.values()))
    assert f[7]["f_length"] == len(us[7]) and f[3]["f_depth"] == 2


def test_url_trees_learn(spark):
    rng = random.Random(6)
    word = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    rows_ = [(f"http://{word(6, 'abcdef')}.org/{word(5, 'abc')}", "allow") for _ in range(300)] + [(f"http://{word(6, 'abcdef')}.org/{word(30, '0123456789')}?a=1&b=2&c=3", "block") for _ in range(300)]
    df = urls.split_url(spark.createDataFrame(rows_, "url string, verdict string"))
    train, held = df.where(F.pmod(F.xxhash64("url"), F.lit(2)) == 0), df.where(F.pmod(F.xxhash64("url"), F.lit(2)) == 1)
    model, suffixes = urls.fit(train)
    out = model.transform(urls.with_vector(urls.lexical(held), suffixes))
    right = out.where((F.col("prediction") > 0.5) == (F.col("verdict") == "block")).count()
    assert right >= 0.95 * held.count()


def test_url_trees_on_held_out_urls(spark):
    """Trees fitted on half of the labelled URLs of the table judge the other half no worse than one verdict for all; rare verdicts stay in the sample."""
    rule, verdict = urls.rule_columns(urls.RULES)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    labelled = urls.split_url(pages).withColumn("verdict", verdict).where(rule.isNotNull()).dropDuplicates(["url"])
    half = F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2))
    model, suffixes = urls.fit(labelled.where(half == 0).select("url", "host", "path", "verdict"))
    out = model.transform(urls.with_vector(urls.lexical(labelled.where(half == 1)), suffixes))
    said = [(r["suffix"], r["verdict"], r["prediction"] > 0.5) for r in out.select("suffix", "verdict", "prediction").collect()]
    # Of net all labels are block. Within com the rules differ by a path segment, which lexical features do not show.
    assert all(block for suffix, _, block in said if suffix == "net") and {v for _, v, _ in said} == {"allow", "block"}
    most = max(Counter(v for _, v, _ in said).values())
    assert sum((v == "block") == block for _, v, block in said) >= most - 0.05 * len(said)
    rare = labelled.where("verdict = 'allow'").unionByName(labelled.where("verdict = 'block'").limit(3)).select("url", "host", "path", "verdict")
    got = {r["verdict"]: (r["n"], r["w"]) for r in urls.sample(rare, 60).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    total = rare.where("verdict = 'allow'").count()
    assert got["block"] == (3, 3.0) and 10 <= got["allow"][0] <= 60 and 0.4 < got["allow"][1] / total < 1.7


def test_url_statistics_leave_the_own_fold_out(spark):
    """A suffix with one row says nothing about that row: its training features are those of an unseen suffix."""
    rows_ = [(f"http://a.s{i}/x{i}", f"a.s{i}", "/", "block" if i % 2 else "allow") for i in range(200)]
    df = spark.createDataFrame(rows_, "url string, host string, path string, verdict string")
    stats = urls.suffix_statistics(df)
    assert stats.where("fold = -1").count() == 200 and stats.agg(F.sum("n")).first()[0] == 400
    model, _ = urls.fit(df)
    assert model.featureImportances[urls.FEATURES.index("f_suffix_blocked")] == 0


def test_url_sample(spark):
    twice = spark.range(8000).select(F.concat(F.lit("http://a.org/"), F.pmod("id", F.lit(4000))).alias("url"), F.lit("a.org").alias("host"), F.lit("/").alias("path"), F.lit("allow").alias("verdict"))
    assert urls.sample(twice, 10_000).count() == 4000
    assert 800 <= urls.sample(twice, 1000).count() <= 1200
    assert int(urls.TRAIN_ROWS / 10**14 * urls.HASHES) > 0


def quality_base(text):
    t = text or ""
    w = WORDS.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)


def test_quality_query(spark, sf, duck):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = queries()["op10_quality_divergence"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        base = quality_base(docs[r["doc_id"]])
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert tuple(r)[1:6] == base and r["base_failed"] == failed and (not failed or not r["kept"])


def test_quality_keeps_clean_documents(spark, duck):
    got = queries()["op10_quality_divergence"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = got.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in x.collect()}
    assert kept[1] == 1.0 and kept[0] < 0.3


def test_quality_edges(spark, edge):
    got = quality.judge(edge)
    by = {r["row"]["doc_id"]: r for r in got.collect()}
    assert got.count() == 9 and by[2]["n_words"] == 0 and by[4]["base_failed"] and not by[6]["kept"]
    assert quality.judge(edge.limit(0)).count() == 0
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "\n", "é", "#", "\t", "\x0b", "\u00a0", "|"]) for _ in range(rng.randint(0, 60)))
        assert quality.base_counts(t) == quality_base(t)
    assert quality.js_distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1.0) and quality.js_distance(np.array([0]), np.array([1])) == 0


def test_pipeline(spark, sf, edge):
    """The stages against what each must do to its input, and the whole against the stages."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_dedup", "pii", "mixing", "packing"]
    q = cp.quality_rules(spark, docs, sf)
    want = queries()["op10_quality_divergence"](spark, sf).where("kept").select("doc_id")
    assert q.columns == docs.columns and rows(q.select("doc_id")) == rows(want)
    q = q.cache()
    n = cp.near_dedup(spark, q, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in q.collect()}
    assert sorted(r["doc_id"] for r in n.collect()) == sorted(set(similar_groups(texts).values()))
    p = cp.personal_data(spark, n, sf).cache()
    assert p.count() == n.count() and not any(pii_base(r["text"]) for r in p.collect())
    m = cp.mix_sources(spark, p, sf).cache()
    sizes, mixed = Counter(), Counter()
    for r in p.collect():
        sizes[r["source"]] += len(WORDS.findall(r["text"]))
    for r in m.collect():
        mixed[r["source"]] += len(WORDS.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = targets_by_rounds(dict(sizes))
    assert m.columns == docs.columns and all(abs(mixed[s] - want[s]) <= 1 for s in sizes)
    whole = cp.run(spark, sf)
    assert rows(whole.select("doc_id", "start", "length", "ids_crc32")) == rows(cp.pack_sequences(spark, m, sf).select("doc_id", "start", "length", "ids_crc32"))
    for name, stage in cp.STAGES:
        out = stage(spark, edge, sf)
        # Only the rows with fifty words or more can pass the first stage; the long one repeats itself.
        assert out.count() == {"quality": 0, "near_dedup": 5, "pii": 9}.get(name, out.count())
        assert stage(spark, edge.limit(0), sf).count() == 0 and (name == "packing" or out.columns == edge.columns)


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    ops = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in ops) == list(range(1, 11)) and "pipeline" in e.queries()
    assert json.dumps(sorted(e.oracle_sql()))


def test_ranges_of_any_length(spark):
    """Billions of slots: a range is in a bounded number of buckets, and every number finds its range."""
    bounds = [0, 1, 64, 1000, 3 * 10**9, 3 * 10**9 + 5, 7 * 10**9]
    ranges = spark.createDataFrame([(lo, hi, f"s{lo}") for lo, hi in zip(bounds, bounds[1:])], "lo long, hi long, source string")
    rng = random.Random(4)
    at = sorted({0, 1, 63, 64, 999, 1000, *bounds[4:6], bounds[-1] - 1, *(rng.randrange(bounds[-1]) for _ in range(500))})
    got = mixing.in_ranges(spark.createDataFrame([(x,) for x in at], "u long"), "u", ranges, ["source"], bounds[-1])
    assert {(r["u"], r["source"]) for r in got.collect()} == {(x, f"s{max(b for b in bounds if b <= x)}") for x in at}


def test_near_dedup_meets_under_the_masks_of_fingerprints(spark, monkeypatch):
    import numpy as np

    from changelens.llm import simhash

    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:1500], "other", *words[1501:]]), " ".join(f"v{i}" for i in range(3000))]
    prints = [simhash.set_fingerprint(simhash.shingle_set(t)) for t in texts]
    assert bin(int(prints[0] ^ prints[1]) & (1 << 64) - 1).count("1") <= simhash.RADIUS
    least = simhash.band_keys

    def apart(shingles):
        # No two texts share a band.
        return np.arange(simhash.BANDS) + shingles[:1].view(np.int64), least(shingles)[1]

    monkeypatch.setattr(simhash, "band_keys", apart)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [0, 2]
