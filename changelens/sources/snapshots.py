"""Source snapshots, stored surfaces, and rule and configuration documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.exprs import slashes

RULES = "layers array<string>, forbid array<array<string>>, maxFanIn int, maxFanOut int"
STATE = "projects array<struct<projectName: string, references: array<string>>>"


def deltas(listed: DataFrame, hunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """S-29: file deltas: kind and paths (doc_id, kind, old_path, new_path), their spans, and the hashes of blobs (path, side, content)."""
    key = ["doc_id", "path"]
    d = listed.withColumn("path", F.coalesce("new_path", "old_path"))
    span = lambda a, n: F.struct(F.col(a).alias("start"), (F.col(a) + F.greatest(F.col(n), F.lit(1)) - 1).alias("end"))
    spans = hunks.groupBy("doc_id", F.col("file").alias("path")).agg(F.sort_array(F.collect_list(span("old_start", "old_length"))).alias("old_spans"), F.sort_array(F.collect_list(span("new_start", "new_length"))).alias("new_spans"))
    sha = blobs.select(slashes("path").alias("p"), "side", F.sha2(F.col("content"), 256).alias("sha"))
    old = sha.where("side = 'old'").select(F.col("p").alias("old_path"), F.col("sha").alias("old_sha"))
    new = sha.where("side = 'new'").select(F.col("p").alias("new_path"), F.col("sha").alias("new_sha"))
    return d.join(spans, key, "left").join(old, "old_path", "left").join(new, "new_path", "left").select("doc_id", "kind", "old_path", "new_path", "old_sha", "new_sha", "old_spans", "new_spans")


def save_surface(surface: DataFrame, path: str, commit: str) -> None:
    """S-30: the public surface (project, kind, qualified_name, signature) of a commit, in a partition of its own."""
    surface.write.mode("overwrite").parquet(f"{path}/commit={commit}")


def load_surface(spark: SparkSession, path: str, commit: str) -> DataFrame | None:
    """S-30: the stored surface of a commit; null if there is none."""
    try:
        return spark.read.parquet(f"{path}/commit={commit}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def rules_of(text: str | None) -> dict:
    """S-27: architecture rules of a JSON document; what is missing gets its default."""
    d = json.loads(text) if text else {}
    return {
        "layers": [x for x in d.get("layers", []) if x], "forbid": [(p[0], p[1]) for p in d.get("forbid", []) if len([x for x in p if x]) >= 2],
        "max_fan_in": d.get("maxFanIn", 40), "max_fan_out": d.get("maxFanOut", 40),
    }


def project_references(docs: DataFrame) -> DataFrame:
    """S-27: project, depends_on of state documents (text)."""
    p = docs.select(F.explode(F.from_json("text", STATE)["projects"]).alias("p")).where("trim(coalesce(p.projectName, '')) <> ''")
    return p.select(F.col("p.projectName").alias("project"), F.explode("p.references").alias("depends_on")).distinct()


def config_errors(config: dict) -> list[str]:
    """S-35: what is wrong with a configuration of profiles (name to check ids) and checks (id, kind, needs)."""
    checks = config.get("checks", {})
    out = [f"check {c}: kind missing" for c, v in sorted(checks.items()) if not v.get("kind")]
    out += [f"check {c}: needs unknown {n}" for c, v in sorted(checks.items()) for n in v.get("needs", []) if n not in checks]
    out += [f"profile {p}: unknown check {c}" for p, cs in sorted(config.get("profiles", {}).items()) for c in cs if c not in checks]
    return out if checks else ["no checks", *out]
