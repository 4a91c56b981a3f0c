"""Imported indexes: decoded documents, occurrences and symbols to graph tables.

documents (doc, path, language); occurrences (doc, symbol, is_definition, start_line, end_line, enclosing_start, enclosing_end);
relationships (symbol, target, is_implementation); symbols (symbol, name, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.exprs import escape_id
from changelens.sources.graph import Graph


def symbol_id(name: str, symbol: Column | str) -> Column:
    return F.concat(F.lit(f"scip://{name}/"), escape_id(symbol))


def to_graph(name: str, documents: DataFrame, occurrences: DataFrame, symbols: DataFrame, relationships: DataFrame) -> Graph:
    """S-08: definitions as symbols, references from the smallest enclosing definition, implementations both ways.

    References meet definitions in a join on the document, then containment; the
    smallest enclosing one is a minimum by its length.
    """
    project = F.lit(f"scip:{name}")
    files = documents.select(F.concat(F.lit("file://"), project, F.lit("/"), "path").alias("id"), project.alias("project"), F.col("path").alias("relative_path"), "language", "doc")
    d = occurrences.where("is_definition")
    defs = d.join(symbols, "symbol").join(files.select("doc", F.col("id").alias("file_id"), "relative_path", "language"), "doc")
    nodes = defs.select(
        symbol_id(name, "symbol").alias("id"), "file_id", project.alias("project"), "relative_path", "kind", "name", F.col("symbol").alias("qualified_name"), F.lit(None).cast("string").alias("signature"),
        F.coalesce("enclosing_start", "start_line").alias("start_line"), F.coalesce("enclosing_end", "end_line").alias("end_line"), F.lit(None).cast("string").alias("visibility"), "language",
    ).dropDuplicates(["id"])
    scope = d.where("enclosing_start is not null").select("doc", F.col("symbol").alias("outer"), F.col("enclosing_start").alias("a"), F.col("enclosing_end").alias("b"))
    refs = occurrences.where("not is_definition").join(symbols.select("symbol"), "symbol", "left_semi").select("doc", "symbol", "start_line")
    inside = refs.join(scope, "doc").where("start_line between a and b and outer <> symbol")
    near = inside.groupBy("doc", "symbol", "start_line").agg(F.min_by("outer", F.struct(F.col("b") - F.col("a"), "outer")).alias("outer"))
    edge = lambda df, a, b, kind, line: df.select(symbol_id(name, a).alias("source_id"), symbol_id(name, b).alias("target_id"), F.lit(kind).alias("kind"), line.cast("int").alias("line"), F.lit("semantic").alias("resolution_kind"), F.lit(None).cast("double").alias("confidence"))
    none = F.lit(None)
    impl = relationships.where("is_implementation")
    edges = edge(near, "outer", "symbol", "References", F.col("start_line")).unionByName(edge(impl, "symbol", "target", "Implements", none)).unionByName(edge(impl, "target", "symbol", "ImplementedBy", none))
    return Graph(files.drop("doc"), nodes, edges.distinct())


def imports(symbols: DataFrame) -> DataFrame:
    """S-09: imported indexes with their number of symbols."""
    hit = symbols.where(F.col("project").startswith("scip:"))
    return hit.groupBy(F.expr("substring(project, 6)").alias("name")).agg(F.count(F.lit(1)).alias("symbols"))


#: Limits of a stored index.
MAX_BYTES, MAX_DOCUMENTS, MAX_ROWS = 512 << 20, 200_000, 5_000_000
_ROLE_DEFINITION = 1
# Symbol kinds by the numbers of the index format; others are unknown.
KINDS = {
    "Class": [7], "Constructor": [9], "Enum": [11], "Event": [13], "Field": [15], "Function": [17], "Interface": [21], "Method": [26, 66, 67, 68, 69, 70, 71, 72, 74, 76, 80],
    "Namespace": [29, 30, 35], "Parameter": [37, 38, 44, 52], "Property": [41, 45, 81], "Struct": [49, 54, 59], "TypeParameter": [58],
}


class TooLarge(ValueError):
    """An index file beyond the limits."""


def fields(data: bytes):
    """(number, value) of a protobuf message: integers, or bytes of strings, messages and packed numbers."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def numbers(packed: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in packed:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def _lines(r: list[int]) -> tuple[int | None, int | None]:
    """First and last line, from one, of a range of three or four numbers."""
    return (None, None) if not r else (r[0] + 1, (r[2] if len(r) == 4 else r[0]) + 1)


def parse(data: bytes) -> list[tuple]:
    """Rows of an index: documents, occurrences, symbols and relationships, told apart by ``row``."""
    out, n_docs = [], 0
    text = lambda b: b.decode("utf-8", "replace")
    for number, doc in fields(data):
        if number != 2:
            continue
        n_docs += 1
        parts = list(fields(doc))
        one = {k: v for k, v in parts if k in (1, 4)}
        path = text(one.get(1, b""))
        out.append(("document", path, text(one.get(4, b"")), None, None, None, None, None, None, None))
        for k, v in parts:
            if k == 2:
                o = dict(fields(v))
                a, b = _lines(numbers(o.get(1, b"")))
                ea, eb = _lines(numbers(o.get(7, b"")))
                out.append(("occurrence", path, None, text(o.get(2, b"")), bool(o.get(3, 0) & _ROLE_DEFINITION), a, b, ea, eb, None))
            elif k == 3:
                s = list(fields(v))
                name = text(dict(s).get(1, b""))
                out.append(("symbol", path, text(dict(s).get(6, b"")) or name, name, None, dict(s).get(5), None, None, None, None))
                out += [("relationship", path, None, name, bool(r.get(3)), None, None, None, None, text(r.get(1, b""))) for r in (dict(fields(x)) for kk, x in s if kk == 4)]
        if n_docs > MAX_DOCUMENTS or len(out) > MAX_ROWS:
            raise TooLarge(f"{n_docs} documents, {len(out)} rows")
    return out


ROWS = "row string, doc string, text string, symbol string, flag boolean, start_line int, end_line int, enclosing_start int, enclosing_end int, target string"


def read_indexes(spark, path: str) -> DataFrame:
    """S-07: rows of all index files below ``path``; a file beyond the limits fails the job."""
    return decoded(spark.read.format("binaryFile").load(path).select("length", "content"))


def decoded(files: DataFrame) -> DataFrame:
    """Rows of index files given as length and content."""
    import pyarrow as pa

    def run(batches):
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
        for batch in batches:
            for size, content in zip(batch.column(0), batch.column(1), strict=True):
                if size.as_py() > MAX_BYTES:
                    raise TooLarge(f"{size.as_py()} bytes")
                rows = parse(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(ROWS.split(", "))], names=names)

    return files.mapInArrow(run, ROWS)


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, occurrences, symbols and relationships, as ``to_graph`` takes them."""
    documents = rows.where("row = 'document'").select("doc", F.col("doc").alias("path"), F.col("text").alias("language"))
    occurrences = rows.where("row = 'occurrence'").select("doc", "symbol", F.col("flag").alias("is_definition"), "start_line", "end_line", "enclosing_start", "enclosing_end")
    kind = F.lit("Unknown")
    for name, codes in KINDS.items():
        kind = F.when(F.col("start_line").isin(*codes), name).otherwise(kind)
    symbols = rows.where("row = 'symbol'").select("symbol", F.col("text").alias("name"), kind.alias("kind"))
    relationships = rows.where("row = 'relationship'").select("symbol", "target", F.col("flag").alias("is_implementation"))
    return documents, occurrences, symbols, relationships
