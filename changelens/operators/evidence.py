"""Evidence producers, run identities, completeness, caches and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.exprs import blank, slashes
from changelens.functions.wire import wire_json
from changelens.operators.binding import coverage_hits
from changelens.operators.obligations import mapped_tests

#: Fields of a certificate's statement, in their fixed order.
STATEMENT_FIELDS = ["schema_version", "base_revision", "head_revision", "verdict", "impact", "plan", "evidence", "evaluation", "source_digest", "toolchain", "verification_plan", "constraints", "artifact_manifest"]
REFS = "array<struct<id:string,project:string,name:string>>"


def _evidence(rows: DataFrame, prefix: str, kind: str, check: str, digest: str, status: Column | None = None) -> DataFrame:
    """Evidence rows of subjects (subject), each with itself as its reference."""
    ref = F.array(F.struct(F.col("subject").alias("id"), F.lit(None).cast("string").alias("project"), F.col("subject").alias("name"))).cast(REFS)
    return rows.select(
        F.concat(F.lit(f"{prefix}:"), "subject").alias("id"), F.lit(kind).alias("kind"), (F.lit("Pass") if status is None else status).alias("status"), F.lit(check).alias("check_id"),
        "subject", F.lit(None).cast("string").alias("target"), F.lit(digest).alias("source_digest"), ref.alias("refs"), F.lit(None).cast("array<string>").alias("subjects"),
    )


def from_test_maps(obligations: DataFrame, test_maps: DataFrame, digest: str) -> DataFrame:
    """V-03: evidence for mapping obligations whose symbol a map names."""
    o = obligations.where("kind = 'TestMapping'").select(F.col("subject_id").alias("id"), F.coalesce("subject_display", "subject_id").alias("display"), F.lit(False).alias("is_test"))
    hit = mapped_tests(o, test_maps.withColumn("test", F.lit("any"))).select(F.col("changed_id").alias("subject")).distinct()
    return _evidence(hit, "TM", "TestMapping", "test-mapping", digest)


def from_coverage(obligations: DataFrame, executed: DataFrame, digest: str) -> DataFrame:
    """V-03, V-11: evidence for mapping obligations whose symbol was executed."""
    hit = coverage_hits(obligations, executed).select("id").join(obligations.select("id", F.col("subject_id").alias("subject")), "id").select("subject").distinct()
    return _evidence(hit, "RC", "RuntimeCoverage", "runtime-coverage", digest)


def from_surfaces(verdicts: DataFrame, digest: str) -> DataFrame:
    """V-03: evidence of API compatibility by project, from the verdicts of surface diffs."""
    return _evidence(verdicts.where("status <> 'Inconclusive'").withColumnRenamed("project", "subject"), "API", "ApiCompatibility", "api-compat", digest, F.col("status"))


def from_architecture(subjects: DataFrame, violations: DataFrame, digest: str) -> DataFrame:
    """V-03: evidence for architecture subjects (subject): failed where a cycle or layer is violated, else passed."""
    bad = violations.where(F.col("kind").isin("cycle", "layer")).select(F.col("subject_id").alias("subject")).distinct().withColumn("bad", F.lit(True))
    return _evidence(subjects.select("subject").distinct().join(bad, "subject", "left"), "AR", "Architecture", "architecture", digest, F.when(F.col("bad"), "Fail").otherwise("Pass"))


def from_reviews(reviews: DataFrame, accepted: list[int], digest: str) -> DataFrame:
    """V-03: evidence of signed reviews (path, schema, signature_ok, source_digest) of this source."""
    ok = reviews.where(F.col("schema").isin(*accepted) & F.col("signature_ok") & (F.col("source_digest") == digest))
    return _evidence(ok.select(slashes("path").alias("subject")).distinct(), "MR", "ManualReview", "manual-review", digest)


def run_id(digest: Column, base: Column, head: Column, profile: Column) -> Column:
    """V-06: from the source digest and the hash of revisions and profile."""
    e = lambda c: F.coalesce(c, F.lit(""))
    scope = F.substring(F.sha2(F.concat_ws("|", e(base), e(head), e(profile)), 256), 1, 8)
    return F.when(blank(digest), F.concat(F.lit("run-nosrc-"), scope)).otherwise(F.concat(F.lit("run-"), F.substring(F.lower(digest), 1, 12), F.lit("-"), scope))


def completeness(runs: DataFrame) -> DataFrame:
    """V-12: states of runs (run_id, unknown_spans, impact_truncated, caller_truncated, heuristic_edges)."""
    cut = F.col("impact_truncated") | F.col("caller_truncated")
    place = F.when(F.col("unknown_spans") > 0, "Partial").otherwise("Complete")
    return runs.select(
        "run_id", place.alias("location"), F.when(cut, "PotentiallyTruncated").otherwise("Complete").alias("traversal"),
        F.when(cut | (F.col("unknown_spans") > 0), "partial").otherwise("complete").alias("coverage"), (F.col("heuristic_edges") > 0).alias("has_heuristic"),
    )


def degradations(runs: DataFrame) -> DataFrame:
    """V-20: codes of what was not captured, for each run with its flags."""
    flags = {"file_wide_fallback": "FileWideFallback", "untracked_failed": "UntrackedCaptureFailed", "hashes_failed": "ContentHashCaptureFailed", "deltas_failed": "StructuredDeltaFailed"}
    codes = F.filter(F.array(*[F.when(F.col(c), code) for c, code in flags.items()]), lambda x: x.isNotNull())
    return runs.select("run_id", F.array_join(codes, ",").alias("degradations"))


def metrics(stages: DataFrame) -> DataFrame:
    """V-14: for each stage (stage, seconds, rows) its number of runs, mean and greatest time, and rows."""
    return stages.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"), F.sum("rows").alias("rows"))


def snapshot_digest(files: DataFrame) -> DataFrame:
    """F-14: for each snapshot (snapshot_id) the SHA-256 of its files (kind, old_path, new_path, old_sha, new_sha) in canonical order."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.col("kind"), *[F.concat(F.lit("\u0001"), x) for x in (slashes(e("old_path")), slashes(e("new_path")), e("old_sha"), e("new_sha"))])
    item = F.struct(slashes(F.coalesce("new_path", "old_path", F.lit(""))).alias("a"), F.col("kind").alias("b"), slashes(e("old_path")).alias("c"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n")
    return files.groupBy("snapshot_id").agg(F.sha2(body, 256).alias("digest"), F.count(F.lit(1)).alias("files"))


def cache_key(kind: Column, command: Column, digest: Column, tool: Column) -> Column:
    """D-12, V-17: one key for what a result depends on."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (kind, command, digest, tool)]), 256)


def cached(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """D-12, V-17: wanted (key) with the newest stored result of the same key; an entry of another source has another key."""
    best = store.groupBy("key").agg(F.max_by("result", "stored_at").alias("result"))
    return wanted.join(best, "key", "left").withColumn("hit", F.col("result").isNotNull())


def store_results(results: DataFrame, path: str) -> None:
    """D-12: appends results (key, result, stored_at)."""
    results.write.mode("append").parquet(path)


def capabilities(config: DataFrame) -> DataFrame:
    """V-18: what checks (check_id, kind, command, cost) can prove."""
    # Obligation kinds that a kind of check serves.
    serves = {"build": ["Build", "CrossProject"], "test": ["Test", "CallerContract"], "analysis": ["StaticAnalysis"], "apicompat": ["Compatibility"], "coverage": ["TestMapping", "AppContract"]}
    kinds = F.create_map(*[x for k, v in serves.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    c = config.select("check_id", F.explode(kinds[F.lower("kind")]).alias("kind"), "command", F.greatest(F.coalesce("cost", F.lit(1)), F.lit(1)).alias("cost"))
    target = command_target(c["command"])
    wide = blank(target) | F.lower(target).rlike(r"\.slnx?$")
    return c.withColumn("project", F.when(~wide, F.regexp_replace(F.element_at(F.split(slashes(target), "/"), -1), r"\.[^.]*$", "")))


def tokens(command: Column | str) -> Column:
    """D-15: words of a command line; quotes keep blanks and go."""
    c = F.col(command) if isinstance(command, str) else command
    parts = F.regexp_extract_all(c, F.lit(r'((?:[^\s"]|"[^"]*"?)+)'), 1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, '"', "")), lambda p: p != "")


def command_target(command: Column | str) -> Column:
    """D-15: the word behind the verb, unless it is an option."""
    t = tokens(command)
    first = F.when(F.lower(F.get(t, F.lit(0))) == "dotnet", F.get(t, F.lit(2))).otherwise(F.get(t, F.lit(1)))
    return F.when(~first.startswith("-"), first)


def retargeted(command: Column, old: Column, new: Column) -> Column:
    """V-19: the command with another target."""
    return F.array_join(F.transform(tokens(command), lambda t: F.when(t == old, new).otherwise(t)), " ")


def profile_order(profile: list[str], needs: dict[str, list[str]]) -> list[str]:
    """D-06: checks of a profile after what they need; ``needs`` names every known check. An unknown one raises."""
    from changelens.operators.obligations import with_dependencies

    if unknown := {*profile, *(c for x in needs.values() for c in x)} - needs.keys():
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")

    return with_dependencies(profile, needs)


#: Unresolved obligations that a summary lists.
MAX_LISTED = 30


def summary_lines(verdict: DataFrame, obligations: DataFrame, constraints: DataFrame, reason: str | None = None) -> DataFrame:
    """V-22: part, k, line: a summary of a verdict row in Markdown, in the order of part and k.

    obligations (id, rule_id, subject_id, status and, where known, file);
    constraints (code, message, severity), the blocking ones are listed.
    """
    text = lambda df, part, *lines: df.select(F.posexplode(F.array(*lines)).alias("k", "line")).select(F.lit(part).alias("part"), F.col("k").cast("long").alias("k"), "line")
    open_ = obligations.where("status = 'Unresolved'")
    sums = obligations.agg(F.count(F.when(F.col("status") == "Proven", 1)).alias("proven"), F.count(F.when(F.col("status") == "Unresolved", 1)).alias("open"))
    head = [F.lit("## Proof verdict"), F.lit(""), F.concat(F.lit("**"), F.upper("verdict"), F.lit("**"))]
    out = text(verdict, 0, *head, *([F.lit(f"Reason: `{reason}`")] if reason else []), F.lit(""))
    out = out.unionByName(text(sums, 1, F.concat(F.lit("Obligations: "), "proven", F.lit(" proven / "), "open", F.lit(" unresolved"))))
    out = out.unionByName(text(sums.where("open > 0"), 2, F.lit(""), F.concat(F.lit("### Unresolved ("), "open", F.lit(")"))))
    file = F.col("file") if "file" in obligations.columns else F.lit(None).cast("string")
    line = F.concat(F.lit("- `"), "rule_id", F.lit("` "), F.coalesce("subject_id", F.lit("")), F.lit(" ("), F.coalesce(file, F.lit("unknown file")), F.lit(")"))
    listed = open_.select("id", line.alias("line")).orderBy("id").limit(MAX_LISTED)
    out = out.unionByName(listed.select(F.lit(3).alias("part"), (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("k"), "line"))
    more = F.concat(F.lit("- ... and "), F.col("open") - MAX_LISTED, F.lit(" more"))
    out = out.unionByName(text(sums.where(F.col("open") > MAX_LISTED), 4, more))
    blocking = constraints.where("lower(severity) = 'blocking'")
    out = out.unionByName(text(blocking.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), 5, F.lit(""), F.concat(F.lit("### Blocking constraints ("), "n", F.lit(")"))))
    said = blocking.select(F.concat(F.lit("- `"), "code", F.lit("` "), F.coalesce("message", F.lit(""))).alias("line"))
    return out.unionByName(said.select(F.lit(6).alias("part"), (F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("k"), "line"))


def attestation(digest: str, key: bytes) -> str:
    """V-13: HMAC-SHA-256 of a certificate digest."""
    import hashlib
    import hmac

    return hmac.new(key, digest.encode(), hashlib.sha256).hexdigest()


def attested(digest: str, signature: str, key: bytes) -> bool:
    import hashlib
    import hmac

    return hmac.compare_digest(hmac.new(key, digest.encode(), hashlib.sha256).hexdigest(), signature)


def attestation_of(digest: Column, key: bytes) -> Column:
    """V-13: HMAC-SHA-256 of a column of digests, in built-in functions; ``attestation`` row by row."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, digest.cast("binary")), 256))), 256)


# Providers of attestations.
UNSIGNED, SIGNED = "none", "hmac-sha256"


def trusted(envelopes: DataFrame, key: bytes | None, issuers: list[str] | None = None, require_signed: bool = False, claims: dict[str, list[str]] | None = None) -> DataFrame:
    """V-13: ``envelopes`` (statement_digest, provider, signer, payload and, where ``claims`` are asked for, claims as a map) with valid, trusted and reason (null if trusted).

    An envelope is valid if its signature is that of its digest, or if it has
    none. It is trusted if its signer is among the issuers, where there is a list
    of them, if it is signed, where that is required, and if each claim asked for
    has one of the values allowed; without a claim of its ref, that of the branch counts.
    """
    provider = F.lower("provider")
    known = provider.isin(UNSIGNED, SIGNED)
    match = F.lit(False) if key is None else F.coalesce(F.lower("payload") == attestation_of(F.col("statement_digest"), key), F.lit(False))
    listed = F.lit(True) if not issuers else F.coalesce(F.col("signer").isin(*issuers), F.lit(False))
    broken = F.when(F.coalesce(~known, F.lit(True)), "UNKNOWN_PROVIDER").when((provider == SIGNED) & F.lit(key is None), "KEY_MISSING").when((provider == SIGNED) & ~match, "SIGNATURE_MISMATCH")
    doubted = F.when(~listed, "ISSUER_NOT_TRUSTED").when((provider == UNSIGNED) & F.lit(require_signed), "SIGNATURE_REQUIRED")
    for name, allowed in (claims or {}).items():
        said = F.coalesce(F.col("claims")["ref"], F.col("claims")["branch"]) if name == "ref" else F.col("claims")[name]
        doubted = doubted.when(~F.coalesce(said.isin(*allowed), F.lit(False)), f"CLAIM_MISMATCH:{name}")
    return envelopes.withColumn("valid", broken.isNull()).withColumn("reason", F.coalesce(broken, doubted)).withColumn("trusted", F.col("reason").isNull())


def with_section(certificates: DataFrame, name: str, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Certificates (``key``, ...) with the array ``name`` of their ``rows``, sorted by ``order`` and then all else; none: an empty array.

    A section is what one change has; rows of a whole repository are hashed by ``binding.canonical_digest``.
    """
    fields = [c for c in rows.columns if c != key]
    keyed = F.struct(F.struct(*order, *[c for c in fields if c not in order]).alias("by"), F.struct(*fields).alias("row"))
    one = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["row"]).alias(name))
    return certificates.join(one, key, "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))


def statements(certificates: DataFrame) -> DataFrame:
    """V-05: certificates with ``statement``, the JSON of their statement's fields, and its SHA-256 ``statement_digest``.

    Missing fields are null. Further columns (run id, attestation) stay and do not count.
    """
    have = [F.col(c) if c in certificates.columns else F.lit(None).cast("string").alias(c) for c in STATEMENT_FIELDS]
    whole = certificates.withColumn("statement__", F.struct(*have))
    text = wire_json(F.col("statement__"), whole.schema["statement__"].dataType)
    return whole.withColumn("statement", text).withColumn("statement_digest", F.sha2(F.col("statement").cast("binary"), 256)).drop("statement__")


def write_certificates(certificates: DataFrame, path: str, key: str) -> None:
    """S-25: a folder for each certificate (``key``, one row each) with the JSON of all its columns but the key."""
    fields = [c for c in certificates.columns if c != key]
    whole = certificates.select(key, F.struct(*fields).alias("c"))
    whole.select(key, wire_json(F.col("c"), whole.schema["c"].dataType).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def summaries(certificates: DataFrame, obligations: DataFrame, key: str) -> DataFrame:
    """S-25: the summary beside each certificate: verdict, digests, counts and its unresolved obligations.

    obligations: ``key``, rule_id, claim, status, reason_code, subject_id, file; what is not PROVEN is unresolved, by rule and claim.
    """
    counts = obligations.groupBy(key).agg(F.count_if(F.col("status") == "PROVEN").alias("proven_count"), F.count_if(F.col("status") != "PROVEN").alias("unresolved_count"))
    heads = certificates.select(key, "verdict", "source_digest", "statement_digest").join(counts, key, "left").fillna(0, ["proven_count", "unresolved_count"])
    open_ = obligations.where("status <> 'PROVEN'").select(key, "rule_id", "claim", "status", "reason_code", "subject_id", "file")
    return with_section(heads, "unresolved", open_, key, ["rule_id", "claim"])
