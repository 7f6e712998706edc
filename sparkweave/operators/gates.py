"""Policies as code: a policy is checked itself, then a gate turns measured counts into named checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

CHECK_SCHEMA = "id string, passed boolean, severity string, detail string"

# Each gate's policy with its defaults. None: the check is off.
QUALITY_POLICY = {"min_sources": 1, "min_entities": 1, "min_edges": 1, "max_errors": 0, "max_warnings": 0, "max_duration_seconds": None, "max_scan_duration_seconds": None, "require_roles": [], "require_sources": [], "require_query_presets": [], "require_bootstrap_steps": True}
REVIEW_POLICY = {"max_blocked": 0, "max_no_match": 0, "max_advisory_only": 0, "max_warn": None, "max_priority_score": 99, "min_average_confidence": 0.0, "disallow_risk_flags": [], "require_targets": []}
_ENVELOPE = ("schema_version", "authority_effect", "no_apply")


@dataclass
class Policy:
    """A policy's values over its defaults, and what is wrong with it."""

    values: dict
    unknown: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    authority_effect: object = "none"
    no_apply: object = True

    @classmethod
    def of(cls, given: dict | None, defaults: dict, **overrides) -> Policy:
        """overrides win where they aren't None. Booleans are no numbers, and numbers aren't negative."""
        given = dict(given or {})
        values, errors = dict(defaults), []
        for k, default in defaults.items():
            if k in given:
                v = given[k]
                if isinstance(default, bool):
                    good = isinstance(v, bool)
                elif isinstance(default, list):
                    good = isinstance(v, list) and all(isinstance(x, str) for x in v)
                else:
                    good = v is None and (default is None or k.startswith("max_")) or isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0
                if good:
                    values[k] = v
                else:
                    errors.append(k)
        values |= {k: v for k, v in overrides.items() if v is not None}
        return cls(values, sorted(set(given) - set(defaults) - set(_ENVELOPE)), errors, given.get("authority_effect", "none"), given.get("no_apply", True))

    def checks(self) -> list[tuple[str, bool, str]]:
        return [
            ("policy_authority_effect_none", self.authority_effect == "none", str(self.authority_effect)), ("policy_no_apply_true", self.no_apply is True, str(self.no_apply)),
            ("policy_unknown_keys_absent", not self.unknown, ",".join(self.unknown)), ("policy_validation_errors_absent", not self.errors, ",".join(self.errors)),
        ]


def _frame(spark: SparkSession, checks: list[tuple[str, bool, str]]) -> DataFrame:
    return spark.createDataFrame([(i, bool(p), "error", d) for i, p, d in checks], CHECK_SCHEMA)


def quality_gate(spark: SparkSession, summary: dict[str, int], sources: set[str], roles: set[str], presets: set[str], policy: Policy, steps: dict[str, bool] | None = None, durations: dict[str, float] | None = None) -> DataFrame:
    """Checks of a built graph: summary holds its counts, a row each; steps of a bootstrap that went well, if it was one."""
    p, n = policy.values, lambda k: int(summary.get(k) or 0)
    checks = policy.checks()
    checks += [("summary_error_count_within_limit", n("error_count") <= p["max_errors"], str(n("error_count"))), ("summary_warning_count_within_limit", n("warning_count") <= p["max_warnings"], str(n("warning_count")))]
    checks += [(f"{k}_count_minimum", n(f"{k}_count") >= p[f"min_{many}"], str(n(f"{k}_count"))) for k, many in (("source", "sources"), ("entity", "entities"), ("edge", "edges"))]
    for name, wanted, have in (("role", p["require_roles"], roles), ("source", p["require_sources"], sources), ("query_preset", p["require_query_presets"], presets)):
        checks += [(f"required_{name}_present:{x}", x in have, x) for x in wanted]
    for name, most in (("duration", p["max_duration_seconds"]), ("scan_duration", p["max_scan_duration_seconds"])):
        if most is not None and (durations is not None and name in durations or name == "duration"):
            checks.append((f"{name}_within_limit", (durations or {}).get(name, 0.0) <= most, str((durations or {}).get(name))))
    if p["require_bootstrap_steps"]:
        checks += [(f"bootstrap_step_{k}_ok", ok, k) for k, ok in steps.items()] if steps is not None else [("bootstrap_steps_not_required_for_federation", True, "")]
    return _frame(spark, checks)


def review_gate(spark: SparkSession, review: dict, flag_counts: dict[str, int], targets: set[str], policy: Policy) -> DataFrame:
    """Checks of a target review."""
    p, checks = policy.values, policy.checks()
    for k in ("blocked", "no_match", "advisory_only", "warn"):
        if p[f"max_{k}"] is not None:
            checks.append((f"{k}_within_limit", int(review.get(k) or 0) <= p[f"max_{k}"], str(review.get(k) or 0)))
    if p["max_priority_score"] is not None:
        checks.append(("priority_score_within_limit", int(review.get("max_priority_score") or 0) <= p["max_priority_score"], str(review.get("max_priority_score"))))
    if p["min_average_confidence"] is not None:
        checks.append(("average_confidence_minimum", float(review.get("average_confidence") or 0) >= p["min_average_confidence"], str(review.get("average_confidence"))))
    checks += [(f"risk_flag_absent:{f}", not flag_counts.get(f), str(flag_counts.get(f, 0))) for f in p["disallow_risk_flags"]]
    checks += [(f"required_target_reviewed:{t}", t in targets, t) for t in p["require_targets"]]
    return _frame(spark, checks)
