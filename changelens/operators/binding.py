"""Binding evidence to obligations, and verdicts.

obligations (id, rule_id, kind, subject_id, subject_project, subject_display, required);
evidence (id, kind, status, check_id, subject, target, source_digest, refs array of (id, project, name), subjects array of string).

The theta join of all rules is a union of equi-joins that finds every pair which
a rule may match, and a decision on these pairs: by equal names, and by the
rarest run of letters of a name among the names which may contain it.

Rules look at few columns, so obligations and evidence that agree in them are
one class, and links hold between classes. Evidence of a whole repository links
with every obligation of a kind: that is one row for the kind. So links grow
with the classes, and pairs are made only where they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.exprs import blank, heuristic_match, last_name, same_text, slashes, trim_signature
from changelens.functions.storage import kept

# Evidence kinds that an obligation kind admits.
CANDIDATES = {
    "Build": ["Build"],
    "CrossProject": ["Build"],
    "Compatibility": ["ApiCompatibility", "Build"],
    "Test": ["TestCase", "TestRun"],
    "CallerContract": ["TestCase", "TestRun", "Build"],
    "TestMapping": ["TestMapping", "RuntimeCoverage"],
    "ManualReview": ["ManualReview"],
    "AppContract": ["RuntimeCoverage", "Build", "StaticAnalysis"],
    "Architecture": ["Architecture"],
    "StaticAnalysis": ["StaticAnalysis"],
}
SOURCE_BOUND = ["Build", "TestRun", "TestCase", "ApiCompatibility", "StaticAnalysis", "TestMapping", "RuntimeCoverage", "ManualReview", "Architecture"]
WEAK = "EVIDENCE_TOO_WEAK"


def digest_state(digest: str | None) -> Column:
    """B-03: valid, missing or stale."""
    if not (digest or "").strip():
        return F.lit("valid")
    bound = F.col("kind").isin(*SOURCE_BOUND)
    return F.when(~bound, "valid").when(blank("source_digest"), "missing").when(F.col("source_digest") == digest, "valid").otherwise("stale")


def candidate_kinds(spark: SparkSession) -> DataFrame:
    """B-02 as a table."""
    return spark.createDataFrame([(o, e) for o, es in CANDIDATES.items() for e in es], "o_kind string, e_kind string")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(slashes(path), "/"), -1), r"\.[^.]*$", "")


def repository_wide(target: Column) -> Column:
    low = F.lower(slashes(target))
    return blank(target) | low.endswith(".sln") | low.endswith(".slnx")


def target_is_project(project: Column, exact: bool = True) -> Column:
    stem, low = file_stem(F.col("target")), F.lower(slashes("target"))
    hit = same_text(stem, project)
    if not exact:
        hit = hit | low.contains(F.lower(project)) | F.lower(project).contains(F.lower(stem))
    return ~repository_wide(F.col("target")) & ~blank(project) & F.coalesce(hit, F.lit(False))


def project_matches(project: Column, exact: bool) -> Column:
    """B-08: references first, then named subjects, then the target of the command."""
    has_refs = F.size(F.coalesce("refs", F.array())) > 0
    by_ref = F.exists("refs", lambda r: same_text(r["project"], project) | same_text(r["id"], project))
    named = F.exists("subjects", lambda s: same_text(s, project) | same_text(file_stem(s), project) | (F.lit(not exact) & (F.lower(s).contains(F.lower(project)) | F.lower(project).contains(F.lower(s)))))
    rest = F.coalesce(named, F.lit(False)) | target_is_project(project, exact)
    hit = F.when(has_refs, by_ref).otherwise(rest) if exact else rest
    return ~blank(project) & F.coalesce(hit, F.lit(False))


def subject_matches(ignore_case: bool = False) -> Column:
    """The obligation's subject is among the references or, without any, the evidence's subject."""
    eq = (lambda a: same_text(a, F.col("subject_id"))) if ignore_case else (lambda a: F.coalesce(a == F.col("subject_id"), F.lit(False)))
    has_refs = F.size(F.coalesce("refs", F.array())) > 0
    by_ref = F.exists("refs", lambda r: eq(F.coalesce(r["project"], r["id"]) if ignore_case else r["id"]))
    return F.coalesce(F.when(has_refs, by_ref).otherwise(eq(F.col("subject"))), F.lit(False))


def test_matches(exact: bool) -> Column:
    """B-06: identity of a test case with the subject, without signatures, or by dotted suffix."""
    names = F.concat(F.coalesce(F.transform("refs", lambda r: F.coalesce(r["name"], r["id"])), F.array()), F.array(F.coalesce("subject", F.lit(""))))
    wants = F.array(F.col("subject_id"), F.coalesce("subject_display", F.col("subject_id")))
    if not exact:
        return F.exists(names, lambda n: F.exists(wants, lambda w: heuristic_match(n, w)))
    same = lambda n, w: same_text(trim_signature(n), trim_signature(w))
    suffix = lambda n, w: (F.instr(trim_signature(w), ".") > 0) & F.lower(trim_signature(n)).endswith(F.concat(F.lit("."), F.lower(trim_signature(w))))
    return F.exists(names, lambda n: ~blank(n) & F.exists(wants, lambda w: same(n, w) | suffix(n, w)))


def decision() -> Column:
    """B-04..B-07: the first rule that matches, as (relation, strength, rule, reason); null if none does."""
    out = lambda rel, n, rule, reason: F.struct(F.lit(rel).alias("relation"), F.lit(n).alias("strength"), F.lit(rule).alias("rule"), F.lit(reason).alias("reason"))
    direct = lambda rule: out("direct", 3, rule, "SCOPE_MATCH")
    weak = lambda rule, reason=WEAK: out("supporting", 2, rule, reason)
    o, e = F.col("o_kind"), F.col("e_kind")
    wide = repository_wide(F.col("target"))
    project = F.coalesce("subject_project", "subject_id")
    is_case, is_test = e == "TestCase", e.isin("TestCase", "TestRun")
    build = e == "Build"
    return (
        F.when(o.isin("Build", "CrossProject") & project_matches(F.col("subject_id"), True), direct("BIND_BUILD_PROJECT"))
        .when(o.isin("Build", "CrossProject") & project_matches(F.col("subject_id"), False), weak("BIND_BUILD_PROJECT_HEURISTIC"))
        .when(o.isin("Build", "CrossProject") & wide, weak("BIND_BUILD_SOLUTION", "SCOPE_CONTAINS"))
        .when((o == "Compatibility") & (e == "ApiCompatibility") & (project_matches(project, True) | subject_matches()), direct("BIND_API_COMPAT"))
        .when((o == "Compatibility") & (e == "ApiCompatibility") & wide, weak("BIND_API_COMPAT_SUPPORTING"))
        .when((o == "Compatibility") & build, weak("BIND_BUILD_SUPPORTING_API"))
        .when((o == "Test") & is_case & test_matches(True), direct("BIND_TEST_CASE"))
        .when((o == "Test") & is_test & test_matches(False), weak("BIND_TEST_HEURISTIC"))
        .when((o == "CallerContract") & is_case & test_matches(True), direct("BIND_CALLER_TEST"))
        .when((o == "CallerContract") & is_test & test_matches(False), weak("BIND_CALLER_TEST_HEURISTIC"))
        .when((o == "CallerContract") & build & project_matches(project, True), weak("BIND_CALLER_COMPILE", "SCOPE_CONTAINS"))
        .when((o == "CallerContract") & is_test & target_is_project(F.col("subject_project")), weak("BIND_CALLER_TEST_PROJECT", "SCOPE_CONTAINS"))
        .when((o == "TestMapping") & subject_matches(), direct("BIND_TEST_MAPPING"))
        .when((o == "ManualReview") & (F.col("status") == "Pass") & F.coalesce(F.exists("refs", lambda r: r["id"] == F.col("subject_id")), F.lit(False)), direct("BIND_MANUAL_REVIEW"))
        .when((o == "Architecture") & subject_matches(), direct("BIND_ARCHITECTURE"))
        .when((o == "AppContract") & (e == "RuntimeCoverage") & subject_matches(), direct("BIND_APP_COVERAGE"))
        .when((o == "AppContract") & e.isin("Build", "StaticAnalysis") & project_matches(project, True), weak("BIND_APP_BUILD_SUPPORTING"))
        .when((o == "StaticAnalysis") & subject_matches(True), direct("BIND_STATIC_ANALYSIS"))
        .when((o == "StaticAnalysis") & wide & (F.size(F.coalesce("refs", F.array())) == 0), weak("BIND_STATIC_ANALYSIS", "SCOPE_SUPPORTING"))
    )


# Kinds, as (obligation kind, evidence kind), whose rules admit names that contain each other.
HEURISTIC = [("Build", "Build"), ("CrossProject", "Build"), ("Test", "TestCase"), ("Test", "TestRun"), ("CallerContract", "TestCase"), ("CallerContract", "TestRun")]
# Obligation kinds whose rules look at the project of the subject.
OF_PROJECT = ["Compatibility", "CallerContract", "AppContract"]
#: Letters of the runs by which a name meets the names that contain it.
GRAM = 4


def runs(name: Column, n: int) -> Column:
    """Every run of ``n`` letters of a name, once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (n - 1), F.lit(1))), lambda i: F.substring(name, i, F.lit(n))))


def rarest_runs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """kind, name, key, n: of each needle (kind, name; ``GRAM`` letters or more) the run that fewest haystacks of its kind have, and how many; needles with a run that none has are left out."""
    have = haystacks.select("kind", F.explode(runs(F.col("name"), GRAM)).alias("key")).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    wants = needles.where(F.length("name") >= GRAM).withColumn("runs", runs(F.col("name"), GRAM))
    rated = wants.select("kind", "name", F.size("runs").alias("all"), F.explode("runs").alias("key")).join(have, ["kind", "key"])
    best = rated.groupBy("kind", "name", "all").agg(F.min(F.struct("n", "key")).alias("best"), F.count(F.lit(1)).alias("found"))
    return best.where("found = all").select("kind", "name", "best.key", "best.n")


def contained(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """kind, name, long: every needle and haystack (kind, name; distinct, not empty) of one kind where the haystack contains the needle and more.

    A prefix filter: what contains a needle has all of its runs, so the needle
    looks only among the names with its rarest one. Needles of fewer letters
    than ``GRAM`` are runs themselves, and every name that they meet is a hit.
    """
    long = haystacks.select("kind", F.col("name").alias("long"))
    keyed = long.select("kind", "long", F.explode(runs(F.col("long"), GRAM)).alias("key"))
    hit = rarest_runs(needles, haystacks).drop("n").join(keyed, ["kind", "key"]).where(F.col("long").contains(F.col("name")))
    parts = long.select("kind", "long", F.explode(F.array_distinct(F.concat(*[runs(F.col("long"), n) for n in range(1, GRAM)]))).alias("name"))
    short = needles.where(F.length("name") < GRAM).select("kind", "name").join(parts, ["kind", "name"])
    return hit.select("kind", "name", "long").unionByName(short.select("kind", "name", "long")).where("name <> long")


def _names(*parts: Column) -> Column:
    """The distinct names of arrays ``parts``, in lower case, with and without signature."""
    all_ = F.transform(F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), lambda n: ~blank(n)), lambda n: F.lower(n))
    return F.array_distinct(F.concat(all_, F.transform(all_, trim_signature)))


def _of_kinds(pairs: list[tuple[str, str]]) -> Column:
    return F.struct("o_kind", "e_kind").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in pairs])


def _candidates(wants: DataFrame, valid: DataFrame) -> DataFrame:
    """obligation_id, evidence_id of every pair that a rule which looks at names may match."""
    pair = ["obligation_id", "evidence_id"]
    project = F.when(F.col("o_kind").isin(*OF_PROJECT), F.col("subject_project"))
    w = wants.withColumn("names", _names(F.array(F.col("subject_id"), project, F.col("subject_display"))))
    refs = F.coalesce(F.flatten(F.transform("refs", lambda r: F.array(r["id"], r["project"], r["name"]))), F.array().cast("array<string>"))
    stems = F.concat(F.coalesce(F.transform("subjects", file_stem), F.array().cast("array<string>")), F.array(file_stem(F.col("target"))))
    v = valid.withColumn("names", _names(refs, F.col("subjects"), stems, F.array("subject", slashes("target"))))
    named, have = kept(w.select("obligation_id", "o_kind", "e_kind", F.explode("names").alias("name"))), kept(v.select("evidence_id", "e_kind", F.explode("names").alias("name")))
    equal = named.select("obligation_id", "e_kind", "name").join(have, ["e_kind", "name"]).select(*pair)
    loose, kinds = named.where(_of_kinds(HEURISTIC)).drop("o_kind"), [e for _, e in HEURISTIC]
    held = have.where(F.col("e_kind").isin(*kinds))
    # Names meet as names; what bears them comes after.
    one, two = (kept(x.select(F.col("e_kind").alias("kind"), "name").distinct()) for x in (loose, held))
    within = contained(one, two).select(F.col("kind").alias("e_kind"), "name", F.col("long").alias("other"))
    around = contained(two, one).select(F.col("kind").alias("e_kind"), F.col("long").alias("name"), F.col("name").alias("other"))
    loosely = within.unionByName(around).join(loose, ["e_kind", "name"]).join(held.withColumnRenamed("name", "other"), ["e_kind", "other"])
    tails = loose.withColumn("key", last_name("name")).where("length(key) >= 8").join(held.select("evidence_id", "e_kind", last_name("name").alias("key")), ["e_kind", "key"])
    return equal.unionByName(loosely.select(*pair)).unionByName(tails.select(*pair)).distinct()


#: Members of a part of a class, about, and the most parts: a member of one side is shuffled once for each part of the other.
PART, MOST_PARTS = 100, 64


def _large(members: DataFrame, of: str, size: int) -> DataFrame:
    """The classes with more than ``size`` members, and in how many parts they are dealt."""
    n = members.groupBy(of).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    return n.select(of, F.least(F.ceil(F.col("n") / size), F.lit(MOST_PARTS)).cast("int").alias("parts"))


def dealt(members: DataFrame, key: str, of: str, part: str, size: int = PART) -> DataFrame:
    """key, class and part of each member: the members of a large class are dealt to its parts by the hash of their key."""
    at = F.pmod(F.xxhash64(key), F.coalesce("parts", F.lit(1))).cast("int")
    return members.select(key, of).join(_large(members, of, size), of, "left").select(key, of, at.alias(part))


def in_parts(rows: DataFrame, members: DataFrame, of: str, part: str, size: int = PART) -> DataFrame:
    """``rows`` of classes once for each part."""
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return rows.join(_large(members, of, size), of, "left").select(*rows.columns, each.alias(part))


SUBJECT = ["subject_id", "subject_project", "subject_display"]
_LINK = ["relation", "strength", "rule", "reason"]


@dataclass
class Bound:
    """B-01: the links of a plan, by classes.

    obligations (obligation_id, o_class, o_kind) and evidence (evidence_id,
    e_class, e_kind) tell what belongs to a class; links (o_class, e_class and
    the link) hold for all pairs of two classes; kind_links (o_kind, e_class and
    the link) for all obligations of a kind whose class has no link with the evidence's.
    """

    obligations: DataFrame
    evidence: DataFrame
    links: DataFrame
    kind_links: DataFrame

    def expanded(self) -> DataFrame:
        """obligation_id, evidence_id and the link of every pair: may be the product of both."""
        classes = self.obligations.select("o_class", "o_kind").distinct()
        rest = self.kind_links.join(classes, "o_kind").join(self.links.select("o_class", "e_class"), ["o_class", "e_class"], "left_anti")
        pairs = self.links.select("o_class", "e_class", *_LINK).unionByName(rest.select("o_class", "e_class", *_LINK))
        # A class may hold a share of all rows, so its members are dealt to parts, and parts meet parts.
        o, e = dealt(self.obligations, "obligation_id", "o_class", "o_part"), dealt(self.evidence, "evidence_id", "e_class", "e_part")
        parts = in_parts(in_parts(pairs, self.obligations, "o_class", "o_part"), self.evidence, "e_class", "e_part")
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = parts.join(o, ["o_class", "o_part"]).repartition(n, "e_class", "e_part").join(e, ["e_class", "e_part"])
        return each.select("obligation_id", "evidence_id", *_LINK)

    def counted(self) -> DataFrame:
        """evidence_id, o_kind, the link, and the number of obligations of that kind that it holds for: a few rows for each evidence."""
        sizes = self.obligations.groupBy("o_class", "o_kind").agg(F.count(F.lit(1)).alias("n"))
        by_class = self.links.join(sizes, "o_class").groupBy("o_kind", "e_class", *_LINK).agg(F.sum("n").alias("obligations"))
        taken = by_class.groupBy("o_kind", "e_class").agg(F.sum("obligations").alias("taken"))
        kinds = sizes.groupBy("o_kind").agg(F.sum("n").alias("n"))
        rest = self.kind_links.join(kinds, "o_kind").join(taken, ["o_kind", "e_class"], "left").withColumn("obligations", F.col("n") - F.coalesce("taken", F.lit(0)))
        every = by_class.unionByName(rest.where("obligations > 0").select(*by_class.columns)).groupBy("o_kind", "e_class", *_LINK).agg(F.sum("obligations").alias("obligations"))
        return every.join(self.evidence.select("evidence_id", "e_class"), "e_class").select("evidence_id", "o_kind", *_LINK, "obligations")


def _class(*columns: Column | str) -> Column:
    """A key for rows that agree in ``columns``, in 256 bits."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def bound(obligations: DataFrame, evidence: DataFrame, digest: str | None = None) -> Bound:
    """B-01: what ``bind`` gives, as classes and kinds.

    Evidence of another or without source digest makes no link; ``rejections``
    has it. Ids of obligations and of evidence are unique.
    """
    o = obligations.where("kind <> 'Uncertainty'").select(F.col("id").alias("obligation_id"), F.col("kind").alias("o_kind"), *SUBJECT)
    o = kept(o.withColumn("o_class", _class("o_kind", *SUBJECT)))
    e = evidence.withColumn("state", digest_state(digest)).where("state = 'valid'").withColumn("e_kind", F.col("kind"))
    # Of the status, rules see whether a review passed.
    e = e.withColumn("status", F.when((F.col("kind") == "ManualReview") & (F.col("status") == "Pass"), "Pass").otherwise(""))
    looked_at = ["e_kind", "status", "subject", "target", "refs", "subjects"]
    e = kept(e.select(F.col("id").alias("evidence_id"), *looked_at).withColumn("e_class", _class(*looked_at)))
    os, es = o.drop("obligation_id").dropDuplicates(["o_class"]), e.drop("evidence_id").dropDuplicates(["e_class"])
    kinds = F.broadcast(candidate_kinds(obligations.sparkSession))  # a fixed table
    pairs = _candidates(os.join(kinds, "o_kind").withColumnRenamed("o_class", "obligation_id"), es.withColumnRenamed("e_class", "evidence_id"))
    both = pairs.join(os.withColumnRenamed("o_class", "obligation_id"), "obligation_id").join(es.withColumnRenamed("e_class", "evidence_id"), "evidence_id")
    decided = decision()  # a large expression, built once
    links = kept(both.withColumn("d", decided).where("d is not null").select(F.col("obligation_id").alias("o_class"), F.col("evidence_id").alias("e_class"), "d.*"))
    # What an obligation of nothing links with is what every obligation of its kind links with.
    nothing = [F.lit(None).cast("string").alias(c) for c in SUBJECT]
    kind_links = es.join(kinds, "e_kind").select("*", *nothing).withColumn("d", decided).where("d is not null").select("o_kind", "e_class", "d.*")
    return Bound(o.select("obligation_id", "o_class", "o_kind"), e.select("evidence_id", "e_class", "e_kind"), links, kept(kind_links))


def bind(obligations: DataFrame, evidence: DataFrame, digest: str | None = None) -> DataFrame:
    """B-01: obligation_id, evidence_id, relation, strength, rule, reason of every link, pair by pair; ``bound`` has them in a few rows."""
    return bound(obligations, evidence, digest).expanded()


def rejections(obligations: DataFrame, evidence: DataFrame, digest: str | None = None) -> DataFrame:
    """B-01: evidence_id, rule, reason, obligations of evidence with another or without source digest: every obligation but those of uncertainty rejects it, so their number stands for them."""
    bad = evidence.withColumn("state", digest_state(digest)).where("state <> 'valid'")
    reason = F.when(F.col("state") == "missing", "EVIDENCE_SOURCE_IDENTITY_MISSING").otherwise("EVIDENCE_STALE_SOURCE")
    n = obligations.where("kind <> 'Uncertainty'").agg(F.count(F.lit(1)).alias("obligations"))
    return bad.select(F.col("id").alias("evidence_id"), F.lit("BIND_SOURCE_DIGEST").alias("rule"), reason.alias("reason")).crossJoin(F.broadcast(n)).where("obligations > 0")  # one row


def admitted(evidence: DataFrame, planned: DataFrame) -> DataFrame:
    """L-20: evidence of planned checks (check_id)."""
    return evidence.join(planned.select("check_id").distinct(), "check_id", "left_semi")


def statuses(obligations: DataFrame, links: DataFrame | Bound, evidence: DataFrame) -> DataFrame:
    """V-01: obligations with status: failed, blocked, proven, else unresolved, by direct links of strength 3; no pairs are made of links by classes."""
    rank = F.when(F.col("status") == "Fail", 3).when(F.col("status") == "InfraError", 2).when(F.col("status") == "Pass", 1).otherwise(0)
    e = evidence.select(F.col("id").alias("evidence_id"), rank.alias("rank"))
    direct = "relation = 'direct' and strength >= 3"
    if isinstance(links, Bound):
        of_class = links.evidence.join(e, "evidence_id").groupBy("e_class").agg(F.max("rank").alias("rank"))
        best = links.links.where(direct).join(of_class, "e_class").groupBy("o_class").agg(F.max("rank").alias("best"))
        seen = links.obligations.join(best, "o_class").select(F.col("obligation_id").alias("id"), "best")
    else:
        seen = links.where(direct).join(e, "evidence_id").groupBy(F.col("obligation_id").alias("id")).agg(F.max("rank").alias("best"))
    best = F.when(F.col("kind") == "Uncertainty", 0).otherwise(F.coalesce("best", F.lit(0)))
    name = F.when(best == 3, "Failed").when(best == 2, "Blocked").when(best == 1, "Proven").otherwise("Unresolved")
    return obligations.join(seen, "id", "left").withColumn("status", name).drop("best")


def verdict(evaluated: DataFrame, evidence: DataFrame, constraints: DataFrame, change_is_empty: bool = False) -> DataFrame:
    """V-02: one row: the verdict of a change."""
    o = evaluated.agg(
        F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("required"), 1)).alias("required"),
        *[F.count(F.when(F.col("required") & (F.col("status") == s), 1)).alias(s) for s in ("Failed", "Blocked", "Proven", "Unresolved")],
    )
    broken = evidence.where("status = 'InfraError'").select("check_id", "target")
    by_check = broken.join(evaluated.select(F.lower("subject_id").alias("s")).distinct(), F.lower("check_id") == F.col("s"), "left_semi").agg(F.count(F.lit(1)).alias("infra"))
    one_kind = lambda c: F.lower(c).alias("name")
    projects = evaluated.where(~blank("subject_project")).select(F.lit("").alias("kind"), one_kind("subject_project")).distinct()
    targets = broken.where(~blank("target")).select(F.lit("").alias("kind"), one_kind("target")).distinct()
    held = contained(projects, targets).select("name").unionByName(projects.join(targets, ["kind", "name"]).select("name"))
    by_target = held.agg(F.count(F.lit(1)).alias("infra_target"))
    every = broken.agg(F.count(F.lit(1)).alias("infra_all"))
    blocking = constraints.agg(F.count(F.when(F.lower("severity") == "blocking", 1)).alias("blocking"))
    one = o.crossJoin(by_check).crossJoin(by_target).crossJoin(every).crossJoin(blocking)  # a row each
    infra = (F.col("Blocked") > 0) | (F.col("infra") > 0) | (F.col("infra_target") > 0) | ((F.col("all") == 0) & (F.col("infra_all") > 0))
    said = (
        F.when(F.lit(change_is_empty), "NoChange")
        .when(F.col("Failed") > 0, "NotReady")
        .when(infra, "InfraError")
        .when((F.col("blocking") > 0) | (F.col("required") == 0) | (F.col("Unresolved") > 0), "Uncertain")
        .when(F.col("Proven") == F.col("required"), "Proven")
        .otherwise("Uncertain")
    )
    return one.select(said.alias("verdict"), F.col("required").alias("required_n"), F.col("Proven").alias("proven_n"), F.col("Failed").alias("failed_n"), F.col("blocking").alias("blocking_n"))


def gate(reasons: DataFrame, fail_on: list[str]) -> DataFrame:
    """V-07: run ids whose reasons (run_id, code) hold one that fails the gate."""
    return reasons.where(F.lower("code").isin(*[c.lower() for c in fail_on])).select("run_id").distinct()


def exceptions(obligations: DataFrame, granted: DataFrame, now: Column, digest: str | None = None) -> DataFrame:
    """V-08: obligations with the state of the exception that covers them: valid, expired, unsigned, or null.

    granted (rule_id, subject_id or *, source_digest, signature, expires_at).
    """
    state = F.when(blank("signature"), "Unsigned").when(F.col("expires_at") <= now, "Expired").otherwise("Valid")
    same_source = F.when(~blank("source_digest") & F.lit(bool(digest)), F.col("source_digest") == F.lit(digest)).otherwise(blank("source_digest"))
    g = granted.where(same_source).select(F.col("rule_id").alias("x_rule"), F.col("subject_id").alias("x_subject"), state.alias("state"))
    everywhere = blank("x_subject") | (F.col("x_subject") == "*")
    rank = F.when(F.col("state") == "Valid", 0).when(F.col("state") == "Expired", 1).otherwise(2)
    general = g.where(everywhere).groupBy("x_rule").agg(F.min_by("state", rank).alias("s1"))
    special = g.where(~everywhere).groupBy("x_rule", "x_subject").agg(F.min_by("state", rank).alias("s2"))
    joined = obligations.join(general, F.col("rule_id") == F.col("x_rule"), "left").drop("x_rule")
    joined = joined.join(special, (F.col("rule_id") == F.col("x_rule")) & (F.col("subject_id") == F.col("x_subject")), "left").drop("x_rule", "x_subject")
    best = F.when((F.col("s1") == "Valid") | (F.col("s2") == "Valid"), "Valid").when((F.col("s1") == "Expired") | (F.col("s2") == "Expired"), "Expired").otherwise(F.coalesce("s1", "s2"))
    return joined.withColumn("exception", best).drop("s1", "s2")


def certificate_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """V-09: what obligations and constraints (what, id, status) two certificates differ in."""
    b = before.select("what", "id", F.col("status").alias("was"))
    a = after.select("what", "id", F.col("status").alias("now"))
    both = b.join(a, ["what", "id"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.withColumn("change", change).where("change is not null")


def suggest_maps(bare: DataFrame, tests: DataFrame) -> DataFrame:
    """V-10: id, test: tests (id, display, file) for symbols (id, display, file) without one: of the same file, or whose name holds a part of theirs.

    Parts of four letters or more count. Each distinct part meets the tests that
    hold it once: a name holds a part if one of its windows of the part's length,
    tried where the part's first four letters stand, is the part. The pairs, whose
    number can be the product of both sides, are made last, in parts of the
    symbols; a pair is taken for its first reason only, so pairs are not shuffled.
    """
    file = F.when(~blank("file"), F.lower("file"))
    t = tests.groupBy(F.col("display").alias("test")).agg(F.collect_set(F.lower("file")).alias("files"))
    split = F.filter(F.transform(F.split("display", r"\."), F.trim), lambda p: F.length(p) >= 4)
    own = bare.select("id", file.alias("own_file"), F.array_distinct(split).alias("parts")).distinct()
    reasons = F.concat(F.array(F.struct(F.lit(0).alias("nth"), F.concat(F.lit("f:"), "own_file").alias("key"))), F.transform("parts", lambda p, i: F.struct((i + 1).alias("nth"), F.concat(F.lit("p:"), p).alias("key"))))
    member = F.xxhash64("id", "own_file", "parts").alias("member")
    members = kept(own.select("id", "own_file", "parts", member, F.explode(reasons).alias("r")).select("id", "own_file", "parts", "member", "r.*").where("key is not null"))
    known = members.select("key").distinct()
    part = known.where("key like 'p:%'").select("key", F.expr("substring(key, 3)").alias("part"))
    starts = part.select(F.substring("part", 1, 4).alias("gram"), F.length("part").alias("n")).distinct()
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("test") - 3))).alias("at")
    windows = t.select("test", "files", at).withColumn("gram", F.expr("substring(test, at, 4)")).join(starts, "gram")
    named = windows.select("test", "files", F.concat(F.lit("p:"), F.expr("substring(test, at, n)")).alias("key")).join(known, "key", "left_semi")
    same = t.select("test", "files", F.explode(F.transform("files", lambda f: F.concat(F.lit("f:"), f))).alias("key")).join(known, "key", "left_semi")
    held = kept(same.unionByName(named.distinct()))
    size = 1000  # the tests of a key go to each of its parts
    at_part = F.pmod(F.col("member"), F.coalesce("parts__", F.lit(1)))
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts__"))
    n = int(bare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_ = members.join(sizes, "key").withColumn("deal", at_part.cast("int")).drop("parts__")
    copies = held.join(sizes, "key").select("test", "files", "key", F.explode(F.sequence(F.lit(0), F.col("parts__") - 1)).alias("deal"))
    both = dealt_.repartition(n, "key", "deal").join(copies, ["key", "deal"])
    of_file = F.coalesce(F.array_contains("files", F.col("own_file")), F.lit(False))
    earlier = F.exists(F.slice("parts", F.lit(1), F.greatest(F.lit(0), F.col("nth") - 1)), lambda p: F.col("test").contains(p))
    return both.where((F.col("nth") == 0) | (~of_file & ~earlier)).select("id", "test")


def coverage_hits(obligations: DataFrame, executed: DataFrame) -> DataFrame:
    """V-11: P005 obligations with the first executed method (method) of the same name."""
    tail = lambda c: F.lower(last_name(c))
    o = obligations.where("rule_id = 'P005'").select("id", "subject_id", tail("subject_id").alias("key"))
    m = executed.select("method", tail("method").alias("key"))
    full = lambda c: F.lower(trim_signature(c))
    match = (full("subject_id") == full("method")) | full("subject_id").endswith(F.concat(F.lit("."), full("method"))) | full("method").endswith(F.concat(F.lit("."), full("subject_id")))
    return o.join(m, "key").where(match).groupBy("id").agg(F.min("method").alias("method"))


def route_coverage(routes: DataFrame, covered: DataFrame, changed: DataFrame) -> DataFrame:
    """V-04: changed handlers (id, not tests) behind covered routes (route): semantic route edges one step away."""
    e = routes.where("kind = 'RoutesTo' and resolution_kind = 'semantic'").select(F.col("source_id").alias("route"), F.col("target_id").alias("id"))
    return e.join(covered.select("route"), "route", "left_semi").join(changed.where("not is_test").select("id"), "id", "left_semi").select("id").distinct()


def test_projects(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """V-15: id, is_test: what is known of the project (project, is_test) first, path and name second."""
    from changelens.functions.exprs import is_test

    f = facts.select(F.lower("project").alias("key"), F.col("is_test").alias("known"))
    return symbols.join(f, F.lower("project") == F.col("key"), "left").select("id", F.coalesce("known", is_test()).alias("is_test"))


def imported_trust(planned: DataFrame, imported: DataFrame, digest: str) -> DataFrame:
    """V-16: one row: whether all planned checks (check_id) are imported with the digest; otherwise none is taken."""
    j = planned.select("check_id").distinct().join(imported.select("check_id", "source_digest"), "check_id", "left")
    return j.agg(F.coalesce(F.bool_and(F.coalesce(F.col("source_digest") == digest, F.lit(False))), F.lit(False)).alias("trusted"))


def section_digest(rows: DataFrame, key: str) -> DataFrame:
    """digest: SHA-256 of the rows as JSON lines, whatever their order, in two levels: rows by the first byte of the hash of ``key``, then these buckets.

    No task holds more than a bucket of the rows.
    """
    line = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("line")
    held = rows.select(F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 2).alias("bucket"), line)
    part = held.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("digest"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat_ws(":", x["bucket"], x["digest"]))
    return part.agg(F.sha2(F.array_join(whole, "\n").cast("binary"), 256).alias("digest"))


# The fields of a certificate's statement, in order. Texts first, then the sections that are tables.
STATEMENT = ["schema_version", "base_revision", "head_revision", "verdict", "source_digest", "toolchain"]
SECTIONS = ["impact", "plan", "evidence", "evaluation", "verification_plan", "constraints", "artifact_manifest"]


def canonical_digest(fields: dict[str, str | None], sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """V-05: section (statement or a section's name), digest: of each section (rows and their key) and of the whole statement.

    The statement is its fields and the digests of its sections as lines of
    name=value, in the fixed order; what is not given is empty.
    """
    parts = None
    for name in SECTIONS:
        if name in sections:
            one = section_digest(*sections[name]).select(F.lit(SECTIONS.index(name)).alias("n"), F.lit(name).alias("section"), "digest")
            parts = one if parts is None else parts.unionByName(one)
    parts = kept(parts)  # a row for each section
    head = [F.lit(f"{c}={fields.get(c) or ''}") for c in STATEMENT]
    listed = F.map_from_entries(F.collect_list(F.struct("section", "digest")))
    lines = F.concat_ws("\n", *head, *[F.concat(F.lit(f"{c}="), F.coalesce(listed[c], F.lit(""))) for c in SECTIONS])
    statement = parts.agg(F.sha2(lines.cast("binary"), 256).alias("digest")).select(F.lit("statement").alias("section"), "digest")
    return parts.select("section", "digest").unionByName(statement)
