"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of symbols and edges.
CALLABLE_KINDS = ["Method", "Constructor", "Function"]
STRUCTURAL_KINDS = ["Contains", "Defines"]
REFERENCE_KINDS = ["References", "Calls", "Constructs", "UsesType", "Implements", "Inherits"]
FLOW_HTTP_KINDS = ["RoutesTo", "Registers", "ResolvesTo", "Calls", "UsesType", "Implements", "ImplementedBy"]
FLOW_UI_KINDS = ["Renders", "BindsTo", "HandlesEvent", "UsesViewModel", "Calls", "UsesType"]
APP_KINDS = ["RoutesTo", "Registers", "ResolvesTo", "Renders", "BindsTo", "HandlesEvent", "UsesViewModel"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def blank(c: Column | str) -> Column:
    """Null, empty or white space."""
    return F.coalesce(F.trim(col(c)), F.lit("")) == ""


def same_text(a: Column, b: Column) -> Column:
    """Equal without regard to case; null is unequal."""
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def slashes(path: Column | str) -> Column:
    """F-01: forward slashes only."""
    return F.translate(col(path), "\\", "/")


def path_key(path: Column | str) -> Column:
    return F.lower(slashes(path))


def project_path_key(project: Column | str, path: Column | str) -> Column:
    return F.lower(F.concat(col(project), F.lit("/"), slashes(path)))


def display_name(kind: Column | str = "kind", qualified: Column | str = "qualified_name", signature: Column | str = "signature") -> Column:
    """F-03: methods and constructors carry their signature."""
    full = F.concat(col(qualified), F.coalesce(col(signature), F.lit("")))
    return F.when(col(kind).isin("Method", "Constructor"), full).otherwise(col(qualified))


def map_label(qualified: Column | str, kind: Column | str) -> Column:
    """F-04: the last two parts of a qualified name; callables end in parentheses."""
    parts = F.split(col(qualified), r"\.")
    short = F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, -2), F.lit("."), F.element_at(parts, -1))).otherwise(col(qualified))
    return F.when(col(kind).isin(*CALLABLE_KINDS), F.concat(short, F.lit("()"))).otherwise(short)


def is_test(path: Column | str = "relative_path", project: Column | str = "project", name: Column | str = "name") -> Column:
    """F-05: by path segment, project or name."""
    segments = F.filter(F.split(F.lower(slashes(path)), "/"), lambda s: s != "")
    hit = F.exists(segments, lambda s: s.isin("test", "tests") | s.endswith("tests.cs"))
    return hit | F.lower(col(project)).endswith(".tests") | F.lower(col(name)).endswith("tests")


def approx_tokens(text: Column | str) -> Column:
    """F-06"""
    return F.ceil(F.length(col(text)) / 4).cast("int")


def candidate_cost(text: Column | str, kind: Column | str) -> Column:
    """F-07"""
    return F.greatest(F.lit(1), F.floor((F.length(col(text)) + F.length(col(kind)) + 15) / 4).cast("int"))


def trim_signature(name: Column | str) -> Column:
    """F-08: up to the first parenthesis, unless that starts the name."""
    at = F.instr(col(name), "(")
    return F.when(at > 1, F.substring_index(col(name), "(", 1)).otherwise(col(name))


def last_name(name: Column | str) -> Column:
    """F-09: last part between dots, plus signs and slashes, without signature."""
    trimmed = trim_signature(name)
    parts = F.filter(F.split(trimmed, r"[.+/]"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(trimmed)


def symbol_matches(subject: Column, display: Column, symbol: Column) -> Column:
    """F-10: equal without signature, or one is a dotted suffix of the other."""
    want = F.lower(trim_signature(symbol))

    def one(candidate: Column) -> Column:
        have = F.lower(trim_signature(candidate))
        suffix = (F.instr(want, ".") > 0) & have.endswith(F.concat(F.lit("."), want))
        prefix = (F.instr(have, ".") > 0) & want.endswith(F.concat(F.lit("."), have))
        return ~blank(candidate) & ((have == want) | suffix | prefix)

    return ~blank(symbol) & (F.coalesce(one(subject), F.lit(False)) | F.coalesce(one(display), F.lit(False)))


def heuristic_match(haystack: Column, needle: Column) -> Column:
    """F-10: one contains the other, or the last names agree in eight characters or more."""
    h, n = F.lower(haystack), F.lower(needle)
    tail = F.lower(last_name(haystack))
    hit = h.contains(n) | n.contains(h) | ((tail == F.lower(last_name(needle))) & (F.length(tail) >= 8))
    return ~blank(haystack) & ~blank(needle) & F.coalesce(hit, F.lit(False))


def glob_regex(pattern: str) -> str:
    """F-11: ``**`` any text, with the slash behind it; ``*`` and ``?`` within a segment."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + ".*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_-" else "\\" + c)
            i += 1
    return f"(?i)^{out}$"


def evidence_label(kind: Column, resolution: Column, confidence: Column) -> Column:
    """F-12: how a relation was found."""
    by_name = (
        F.when(confidence.between(0.85, 0.90), "static-import")
        .when((confidence >= 0.70) & (confidence < 0.85), "same-file-fallback")
        .when((confidence >= 0.60) & (confidence < 0.70), "name-fallback")
        .otherwise("unknown")
    )
    return (
        F.when(resolution == "semantic", "semantic")
        .when(kind == "UsesCss", "css-selector")
        .when(kind == "UsesElement", "dom-selector")
        .when(kind == "Renders", "razor-component-tag")
        .when(kind == "HandlesEvent", "markup-event-binding")
        .when(kind == "UsesViewModel", "xaml-viewmodel-reference")
        .when(kind == "BindsTo", "markup-data-binding")
        .when(kind.isin("Imports", "References"), by_name)
        .otherwise("unknown")
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """F-13: prefix, first part and eight hex digits of the hash of all parts."""
    key = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), parts[0], F.lit("-"), F.substring(F.sha2(key, 256), 1, 8))


def relative_identity(path: Column | str, root: str | None = None) -> Column:
    """F-15: slashes, no leading ./, and below ``root`` relative to it."""
    p = F.regexp_replace(slashes(path), r"^(?:\./)+", "")
    if root:
        base = root.replace("\\", "/").rstrip("/") + "/"
        p = F.when(F.lower(p).startswith(base.lower()), F.substring(p, len(base) + 1, 1_000_000)).otherwise(p)
    return p


def is_generated(path: Column | str) -> Column:
    """F-16"""
    p = F.lower(slashes(path))
    hit = p.startswith("obj/") | p.startswith("bin/") | p.contains("/obj/") | p.contains("/bin/") | p.endswith(".g.cs")
    return F.coalesce(hit, F.lit(False))


def severity_of_level(level: Column | str) -> Column:
    """F-17: SARIF level to severity."""
    low = F.lower(col(level))
    return F.when(low == "error", "Error").when(low.isin("note", "none"), "Info").otherwise("Warning")


def paths_align(deleted: Column, resolved: Column) -> Column:
    """F-18: equal, or the resolved path with a directory is a suffix."""
    d, r = F.lower(deleted), F.lower(resolved)
    hit = (d == r) | ((F.instr(resolved, "/") > 0) & d.endswith(F.concat(F.lit("/"), r)))
    return ~blank(deleted) & ~blank(resolved) & F.coalesce(hit, F.lit(False))


def escape_id(text: Column | str) -> Column:
    """F-19: percent escapes of all but the unreserved characters of URIs: blanks are %20, stars %2A, tildes stay."""
    out = F.url_encode(col(text))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def redact(text: Column | str, more: list[str] | None = None) -> Column:
    """F-20: passwords, bearer tokens and tokens are starred, and what the further patterns find."""
    out = F.regexp_replace(col(text), r"(?i)(password\s*[=:]\s*)\S+", "$1***")
    out = F.regexp_replace(out, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1***")
    out = F.regexp_replace(out, r"(?i)(token\s*[=:]\s*)\S+", "$1***")
    for p in more or []:
        out = F.regexp_replace(out, p, "***")
    return out


def run_stamp(run_id: Column | str) -> Column:
    """F-21: the time that a run id starts with; null if there is none."""
    return F.try_to_timestamp(F.substring(col(run_id), 1, 14), F.lit("yyyyMMddHHmmss"))


def valid_confidence(c: Column | str) -> Column:
    """F-22: finite and from 0 to 1."""
    return F.coalesce(~F.isnan(col(c)) & (col(c) >= 0) & (col(c) <= 1), F.lit(False))


def enough(confidence: Column | str, least: float) -> Column:
    """Null counts as certain."""
    return col(confidence).isNull() | (col(confidence) >= least)


def diagram_text(text: Column | str) -> Column:
    """F-23: nothing that ends a diagram label or opens a tag."""
    return F.regexp_replace(col(text), r'["\[\](){}<>|`]', "_")
