"""Explainable rules as column expressions, and their capped sum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supporting evidence adds up to this at most.
SUPPORTING_CAP = 0.24


@dataclass(frozen=True)
class Rule:
    rule_id: str
    weight: float
    strong: bool
    fires: Column
    reason: Column


# Weights of the rules by strength.
SUPPORTING = {"repeat_value": 0.12, "low_entropy": 0.06, "concentration": 0.08, "numeric_reuse": 0.12, "context_cluster": 0.10}
STRONG = {"same_instant_burst": 0.40, "local_burst": 0.35, "regular_timing": 0.40, "entity_monotony": 0.70, "asymmetric_degree": 0.70}


def rule(rule_id: str, fires: Column, reason: Column) -> Rule:
    strong = rule_id in STRONG
    return Rule(rule_id, STRONG[rule_id] if strong else SUPPORTING[rule_id], strong, fires, reason)


def hits(rules: list[Rule]) -> Column:
    """Array of the rules that fire, in the given order."""
    if not rules:
        return F.array().cast("array<struct<rule_id:string,weight:double,strong:boolean,reason:string>>")
    # concatenated instead of filtered: Spark generates no code for what a lambda function is applied to
    one = [F.array(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.weight).alias("weight"), F.lit(r.strong).alias("strong"), r.reason.alias("reason"))) for r in rules]
    return F.concat(*[F.when(F.coalesce(r.fires, F.lit(False)), hit).otherwise(hits([])) for r, hit in zip(rules, one, strict=True)])


def score(rules: list[Rule]) -> Column:
    """``capped_sum`` of the hits, from the rules themselves."""
    total = lambda strong: sum((F.when(F.coalesce(r.fires, F.lit(False)), r.weight).otherwise(0.0) for r in rules if r.strong is strong), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), total(True) + F.least(total(False), F.lit(SUPPORTING_CAP))), 9)


def capped_sum(found: Column) -> Column:
    """Strong weights plus supporting weights scaled to the cap, at most 1."""
    add = lambda a, h: a + h["weight"]
    strong = F.aggregate(F.filter(found, lambda h: h["strong"]), F.lit(0.0), add)
    support = F.aggregate(F.filter(found, lambda h: ~h["strong"]), F.lit(0.0), add)
    return F.round(F.least(F.lit(1.0), strong + F.least(support, F.lit(SUPPORTING_CAP))), 9)


def without(found: Column, rule_id: str) -> Column:
    """The hits with one rule removed, for counterfactual scores."""
    return F.filter(found, lambda h: h["rule_id"] != rule_id)
