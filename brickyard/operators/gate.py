"""The discovery gate: an ordered list of rules over the pattern names that match a job's texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Patterns:
    """Named patterns (name to regular expression over lower-case text) of each list; the caller's vocabulary."""

    exclusion: dict[str, str]
    strong: dict[str, str]
    adjacent: dict[str, str]
    low_relevance: dict[str, str]
    domain: dict[str, str]
    method: dict[str, str]
    negative: dict[str, str]


def _names(patterns: dict[str, str], text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()))) if patterns else F.array().cast("array<string>")


def matches(jobs: DataFrame, p: Patterns) -> DataFrame:
    """Adds one array of matched names for each list; title lists see the title alone, the others all text."""
    title = F.lower(F.coalesce("title", F.lit("")))
    body = F.lower(F.concat_ws(" ", F.coalesce("body", F.lit("")), F.coalesce("extra", F.lit(""))))
    everything = F.concat_ws(" ", title, body)
    masked = lambda t: F.replace(t, F.lit("after sales"), F.lit(" "))
    arrays = {
        "exclusion": _names(p.exclusion, title), "strong": _names(p.strong, title), "adjacent": _names(p.adjacent, title), "low": _names(p.low_relevance, title),
        "title_domain": _names(p.domain, title), "domain": _names(p.domain, everything), "body_domain": _names(p.domain, body), "method": _names(p.method, everything),
        "title_negative": _names(p.negative, masked(title)), "negative": _names(p.negative, masked(everything)),
    }
    return jobs.select("*", *(v.alias(k) for k, v in arrays.items()))


def decide(matched: DataFrame) -> DataFrame:
    """Adds accepted and reason: the first rule that holds decides, and nothing is accepted by default."""
    some = lambda c: F.size(c) > 0
    has = lambda c, name: F.array_contains(c, name)
    # An ``hr`` outside the title says nothing about the job.
    blocking = F.filter("negative", lambda x: (x != "hr") | F.array_contains("title_negative", "hr"))
    commercial_title = has("title_negative", "sales") | has("title_negative", "finance")
    manager = has("adjacent", "project_manager")
    role = some("adjacent")
    domains, methods = F.size("domain"), F.size("method")
    rules = [
        (some("exclusion"), False, "structural_title_exclusion"),
        (has("title_negative", "sales"), False, "structural_title_exclusion"),
        (has("adjacent", "controls") & ~some("title_domain"), False, "structural_title_exclusion"),
        (has("adjacent", "application_engineer") & has("negative", "sales"), False, "commercial_sales_role"),
        (some("strong"), True, "strong_mechanical_title"),
        (has("adjacent", "electrical") & ~some("title_domain"), False, "insufficient_base_relevance"),
        (some("low"), False, "low_relevance_operational_title"),
        (some("title_negative"), False, "insufficient_base_relevance"),
        (manager & has("title_domain", "industrial") & ~commercial_title, True, "industrial_project_title"),
        (manager & some("body_domain") & ~commercial_title, True, "technical_project_management_body"),
        (role & (domains >= 1) & (~some(blocking) | (methods >= 1)), True, "engineering_role_with_domain"),
        (role & (methods >= 1) & ~some(blocking), True, "engineering_role_with_method"),
        ((domains >= 2) & (methods >= 1), True, "multiple_domains_with_method"),
        ((methods >= 3) & ~some(blocking), True, "multiple_engineering_methods"),
    ]
    reason, accepted = F.lit("insufficient_base_relevance"), F.lit(False)
    for condition, ok, why in reversed(rules):
        reason = F.when(condition, F.lit(why)).otherwise(reason)
        accepted = F.when(condition, F.lit(ok)).otherwise(accepted)
    return matched.withColumn("accepted", accepted).withColumn("reason", reason)
