"""Every string that a written rule can match holds the rule's keyword: strings are drawn from the patterns themselves."""

import random
import re
from re import _parser

from changelens.llm import license_rules, licenses


def drawn(pattern, rng):
    """A string that the pattern matches, with optional parts and alternatives at random."""

    def one(item):
        kind, value = item
        name = str(kind)
        if name == "LITERAL":
            return chr(value)
        if name == "NOT_LITERAL":
            return "x"
        if name == "ANY":
            return "x"
        if name == "IN":
            if str(value[0][0]) == "NEGATE":
                return "x"
            pick = rng.choice(value)
            return {"LITERAL": lambda: chr(pick[1]), "RANGE": lambda: chr(rng.randint(*pick[1])), "CATEGORY": lambda: "7"}[str(pick[0])]()
        if name == "SUBPATTERN":
            return every(value[-1])
        if name == "BRANCH":
            return every(rng.choice(value[1]))
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = value
            return "".join(every(part) for _ in range(rng.randint(low, min(high, low + 2))))
        return ""

    def every(parts):
        return "".join(map(one, parts))

    return every(_parser.parse(pattern))


def test_matches_hold_their_keywords():
    rng, wrong = random.Random(1), set()
    for label, keyword, pattern, _ in license_rules.lines():
        for _ in range(60):
            text = drawn(pattern, rng)
            assert re.fullmatch(pattern, text), (pattern, text)
            if f" {keyword} " not in f" {text} ":
                wrong.add((label, keyword, text))
    assert not wrong, sorted(wrong)[:20]


def test_texts_that_gates_had_lost():
    label = lambda t: licenses.scan(t)[5]
    assert label("for personal non commercial use only") == "non-commercial" and label("Ruby's license") == "ruby"
    assert label("a ruby slicense") == "" and "ofl" in label("with Reserved Font Names")
    assert label("contains confidential information and trade secrets") == "proprietary"
    assert label("may not be copied without prior written permission") == "proprietary"
