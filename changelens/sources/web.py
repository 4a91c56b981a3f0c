"""S-13: relations of web sources by patterns: imports of pages and scripts, uses of style classes and elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Confidence by how a relation is found.
CONFIDENCE = {"import": 0.90, "reexport": 0.85, "css": 0.85, "dom": 0.60}
# Fixed values: (relation, edge kind, confidence, pattern with the target as its group).
PATTERNS = [
    ("script-src", "Imports", "import", r"""<script[^>]*\ssrc\s*=\s*["']([^"']+)["']"""),
    ("link-href", "Imports", "import", r"""<link[^>]*\shref\s*=\s*["']([^"']+)["']"""),
    ("import-from", "Imports", "import", r"""\bimport\s+(?:[\w{},*\s]+\s+from\s+)?["']([^"']+)["']"""),
    ("export-from", "Imports", "reexport", r"""\bexport\s+[\w{},*\s]+\s+from\s+["']([^"']+)["']"""),
    ("require", "Imports", "import", r"""\brequire\(\s*["']([^"']+)["']\s*\)"""),
    ("class", "UsesCss", "css", r"""\sclass\s*=\s*["']([^"']+)["']"""),
    ("element-id", "UsesElement", "dom", r"""getElementById\(\s*["']([^"']+)["']\s*\)"""),
]


def _relation(name: str, kind: str, confidence: float):
    return lambda t: F.struct(F.lit(name).alias("relation"), F.lit(kind).alias("kind"), t.alias("target"), F.lit(confidence).alias("confidence"))


def web_relations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, relation, kind, target, confidence, uses: every target once for each document and relation; classes are told apart."""
    found = []
    for name, kind, how, pattern in PATTERNS:
        hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), 1)
        if name == "class":
            hits = F.filter(F.flatten(F.transform(hits, lambda c: F.split(c, r"\s+"))), lambda c: c != "")
        found.append(F.transform(hits, _relation(name, kind, CONFIDENCE[how])))
    rows = docs.select(key, F.explode(F.flatten(F.array(*found))).alias("r")).select(key, "r.*")
    return rows.groupBy(key, "relation", "kind", "target", "confidence").agg(F.count(F.lit(1)).alias("uses"))
