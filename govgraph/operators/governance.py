"""Governance: routing of triples to owning domains, admission, triage, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBJECT, OBJECT, RELATION = 3, 2, 1



def owners(domain_entities: DataFrame) -> DataFrame:
    """entity_id, owners: sorted domains of each entity."""
    return domain_entities.groupBy("entity_id").agg(F.array_sort(F.collect_set("domain_id")).alias("owners"))


def route(triples: DataFrame, domain_entities: DataFrame, domain_relations: DataFrame) -> DataFrame:
    """Triples with assignment_type, primary_domain_id and domain_ids.

    Both ends owned without a common domain: cross_domain, all owners.  Else the best score wins, from
    3 for the subject, 2 for the object, 1 for the relation's schema; a tie is cross_domain.  The
    scores live in arrays along the triple, so there are two joins on the ends and one on the
    relation, which has few values, and no product of triples and domains.
    """
    own = owners(domain_entities)
    s = own.select(F.col("entity_id").alias("subject"), F.col("owners").alias("so"))
    o = own.select(F.col("entity_id").alias("object"), F.col("owners").alias("oo"))
    r = domain_relations.groupBy("relation").agg(F.array_sort(F.collect_set("domain_id")).alias("ro"))
    none = F.array().cast("array<string>")
    met = triples.join(s, "subject", "left").join(o, "object", "left").join(r, "relation", "left")
    met = met.withColumns({c: F.coalesce(c, none) for c in ("so", "oo", "ro")})
    both = F.array_union("so", "oo")
    apart = (F.size("so") > 0) & (F.size("oo") > 0) & ~F.arrays_overlap("so", "oo")
    score = lambda d: F.array_contains("so", d).cast("int") * SUBJECT + F.array_contains("oo", d).cast("int") * OBJECT + F.array_contains("ro", d).cast("int") * RELATION
    # A domain known only by its relation matters only where no end is owned.
    pool = F.when(F.size(both) > 0, both).otherwise(F.col("ro"))
    met = met.withColumn("pool", F.transform(pool, lambda d: F.struct(score(d).alias("score"), d.alias("d"))))
    best = F.array_max("pool")["score"]
    top = F.array_sort(F.transform(F.filter("pool", lambda x: x["score"] == best), lambda x: x["d"]))
    ids = F.when(apart, F.array_sort(both)).otherwise(F.coalesce(top, none))
    kind = F.when(apart, "cross_domain").when(F.size("pool") == 0, "unowned").when(F.size(ids) == 1, "single_owner").otherwise("cross_domain")
    out = met.withColumns({"assignment_type": kind, "domain_ids": ids})
    return out.withColumn("primary_domain_id", F.get("domain_ids", 0)).drop("so", "oo", "ro", "pool")


def admission(confidence: Column, least: float) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) >= least


def triage_reason(confidence: Column, assignment: Column, novel: Column, conflict: Column, least: float = 0.7) -> Column:
    """Why a triple needs review, the first reason that applies, or null."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) < least, "low_confidence").when(assignment.isin("cross_domain", "unowned"), assignment).when(novel, "schema_novel").when(conflict, "conflict")


def action(mode: str, floor: float | None = None, novel: Column | None = None, conflict: Column | None = None) -> Column:
    """What becomes of a routed triple: floor first, then the mode."""
    never = F.lit(False)
    below = ~admission(F.col("confidence"), floor) if floor is not None else never
    review = triage_reason(F.col("confidence"), F.col("assignment_type"), never if novel is None else novel, never if conflict is None else conflict)
    by_mode = {
        "audit_only": F.lit("auto_approve"),
        "permissive": F.when(F.col("assignment_type") == "unowned", "escalate").otherwise(F.lit("auto_approve")),
        "triage": F.when(review.isNull(), "auto_approve").otherwise("escalate"),
        "strict": F.lit("escalate"),
    }
    if mode not in by_mode:
        raise ValueError(f"no such mode: {mode}")
    return F.when(below, "reject").otherwise(by_mode[mode])


def decide(routed: DataFrame, mode: str, floor: float | None = None, novel: Column | None = None, conflict: Column | None = None) -> DataFrame:
    return routed.withColumn("action", action(mode, floor, novel, conflict))


def rule_replay(routed: DataFrame, floor: float) -> DataFrame:
    """Floor, then one owner approves, a crossing with two domains or more approves, the rest is rejected."""
    kind = F.col("assignment_type")
    approve = (kind == "single_owner") | ((kind == "cross_domain") & (F.size("domain_ids") >= 2))
    return routed.withColumn("action", F.when(admission(F.col("confidence"), floor) & approve, "approve").otherwise("reject"))


VOTE_WEIGHTS = {"strong_accept": 1.0, "accept": 0.75, "weak_accept": 0.5, "abstain": 0.0, "weak_reject": -0.5, "reject": -0.75, "strong_reject": -1.0}


def vote_summary(votes: DataFrame, key: str) -> DataFrame:
    """Last vote of each voter; weighted by the vote and min(confidence * voter weight, 1)."""
    last = votes.groupBy(key, "voter").agg(F.max_by(F.struct("vote", "confidence", "voter_weight"), "seq").alias("v")).select(key, "voter", "v.*")
    weights = F.create_map(*(F.lit(x) for pair in VOTE_WEIGHTS.items() for x in pair))
    weight = F.try_element_at(weights, F.col("vote")) * F.least(F.col("confidence") * F.col("voter_weight"), F.lit(1.0))
    return last.groupBy(key).agg(F.sum(weight).alias("total"), F.count("*").alias("n_votes"), F.count_if(weight > 0).alias("support"), F.count_if(weight < 0).alias("oppose")).withColumn("mean", F.col("total") / F.col("n_votes"))


def consensus(mean: Column, n_votes: Column) -> Column:
    """accept, reject, debate, or pending."""
    return F.when(n_votes < 2, "pending").when(mean >= 0.6, "accept").when(mean <= -0.6, "reject").when(F.abs(mean) < 0.3, "debate").otherwise("pending")


def forced(mean: Column, support: Column, oppose: Column, n_votes: Column, author: Column) -> tuple[Column, Column]:
    """Verdict and confidence when time is up; without votes the author's confidence decides."""
    score = mean + 0.1 * (support - oppose)
    accepted = F.when(n_votes == 0, author >= 0.5).otherwise(score > 0)
    sure = F.when(n_votes == 0, author * 0.8).otherwise(F.least(0.5 + 0.5 * F.abs(score), F.lit(0.95)))
    return accepted, sure
