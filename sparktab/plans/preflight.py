"""Modelling preflight: a table's leakage, duplicates, target, groups, folds and time, as findings with codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import FOLD_NAME, GROUP_NAME, NUMERIC, PREFLIGHT_ID_NAME, counts_as_number, infer_task, is_identifier, is_pipeline_metadata, leakage_signal
from ..operators import association, duplicates, profile, splits
from ..sources.order import source_order
from ..sources.readers import guard

BLOCKER, WARNING = "blocker", "warning"
MISSING_HIGH, SMALL_CLASS, NEAR_PERFECT, EXAMPLES = 0.5, 10, 0.995, 5
#: Classes, partitions, and classes that a partition lacks, that the report lists; all are counted, and findings rest on counts.
LISTED = 10_000
#: Partitions whose missing classes are named.
LACKING = 20


#: What no table can tell.
REVIEW = (
    "that the target is what the prediction is for",
    "that every feature is known at the prediction moment",
    "that row grain and splits keep entities and times apart",
)


@dataclass(frozen=True)
class Request:
    target: str
    row_grain: str
    prediction_moment: str
    task: str | None = None
    group: str | None = None
    time: str | None = None
    exclude: tuple[str, ...] = ()
    available_bytes: int | None = None


class _Findings(list):
    def note(self, when: bool, severity: str, code: str, message: str, columns: list[str] | None = None) -> None:
        if when:
            self.append({"severity": severity, "code": code, "message": message, "columns": list(columns or [])})


def status(findings: list[dict]) -> str:
    ranks = {f["severity"] for f in findings}
    return "blocked" if BLOCKER in ranks else "review_required" if WARNING in ranks else "passed"


def preflight(df: DataFrame, request: Request) -> dict:
    """The report as a plain dict; reads the table a fixed number of times and collects aggregates only."""
    r = request
    guard(df, [r.target, r.group, r.time, *r.exclude])
    notes = _Findings()
    facts = {f.name: f for f in profile.facts(df, summaries=False)}
    rows, t = next(iter(facts.values())).rows, facts[r.target]
    task = r.task or infer_task(t.logical, t.non_null, t.distinct)
    named = {r.target, r.group, r.time}
    meta = [c for c in df.columns if c not in named and c not in r.exclude and is_pipeline_metadata(c)]
    ids = [c for c in df.columns if c not in named and c not in r.exclude and c not in meta and is_identifier(c, facts[c].logical, facts[c].non_null, facts[c].distinct, PREFLIGHT_ID_NAME)]
    out = {*r.exclude, *named, *meta, *ids}
    features = [c for c in df.columns if c not in out]
    notes.note(bool(meta), WARNING, "pipeline_metadata_excluded", "Columns made by preparation or evaluation are no features.", meta)
    notes.note(bool(ids), WARNING, "identifier_features_excluded", "Columns that look like identifiers are no features.", ids)
    notes.note(not features, BLOCKER, "no_features", "No feature is left.")

    notes.note(t.missing > 0, BLOCKER, "missing_target", f"{t.missing} rows have no target.", [r.target])
    classes: dict[str, int] = {}
    n_classes = 0
    if task == "classification":
        notes.note(t.distinct < 2, BLOCKER, "invalid_class_target", "A classification target needs two classes.", [r.target])
        support = profile.class_support(df, r.target)
        n_classes, least = support.agg(F.count(F.lit(1)), F.min("n")).first()
        classes = {x["class"]: x["n"] for x in support.orderBy(F.desc("n"), "class").limit(LISTED).collect()}
        notes.note(least is not None and least < 2, BLOCKER, "singleton_class", "A class has a single row.", [r.target])
        notes.note(least is not None and 2 <= least < SMALL_CLASS, WARNING, "small_class", f"The smallest class has {least} rows.", [r.target])
    else:
        notes.note(t.logical != NUMERIC, BLOCKER, "nonnumeric_regression_target", "A regression target must be a number.", [r.target])

    exact = duplicates.duplicate_rows(df).first()["n_repeated"]
    substantive = duplicates.duplicate_rows(df, [*features, r.target]).first()["n_repeated"] if features else 0
    notes.note(substantive > 0, WARNING, "substantive_duplicate_observations", f"{substantive} rows repeat features and target of another.")
    sig = duplicates.signature_summary(df, features, r.target, r.group).first().asDict() if features else {}
    fallback = bool(features) and r.group is None and sig["n_repeated_signatures"] > 0
    notes.note(fallback, WARNING, "exact_feature_signature_grouping_fallback", "Keep rows with equal features in one partition.")
    conflict = sig.get("n_conflicting", 0) if task == "classification" else 0
    notes.note(conflict > 0, BLOCKER, "conflicting_labels_for_identical_features", f"{conflict} feature vectors have several labels.")

    notes.note(bool(flat := [c for c in features if facts[c].distinct <= 1]), WARNING, "constant_features", "Features that don't vary.", flat)
    notes.note(bool(gaps := [c for c in features if facts[c].missing_rate >= MISSING_HIGH]), WARNING, "high_missingness", "Features that miss half of their values or more.", gaps)
    notes.note(bool(leaks := [c for c in features if leakage_signal(c, r.target)]), WARNING, "leakage_name_signal", "Names that point to the outcome.", leaks)
    copies = [x["column_name"] for x in association.target_copies(df, r.target, features).collect() if x["is_copy"]] if features else []
    notes.note(bool(copies), BLOCKER, "direct_target_copy", "Features equal to the target wherever both are known.", copies)
    numbers = [c for c in features if counts_as_number(facts[c].logical)] if counts_as_number(t.logical) else []
    near = [x["feature"] for x in association.near_perfect(df, numbers, r.target, NEAR_PERFECT).collect()] if numbers else []
    notes.note(bool(near), WARNING, "near_perfect_target_association", "Features that all but equal the target.", near)

    groups = None
    if r.group is not None:
        g = profile.group_structure(df, r.group).first()
        is_function = duplicates.target_by_group(df, r.group, r.target).first()["is_function"]
        groups = {
            "column": r.group, "unique_groups": g["n_groups"], "missing_rows": g["missing_rows"], "minimum_group_rows": g["smallest"] or 0, "maximum_group_rows": g["largest"] or 0, "singleton_groups": g["singletons"],
            "identical_feature_signatures_across_groups": sig.get("n_across_groups", 0), "conflicting_label_signatures_across_groups": sig.get("n_conflicting_across_groups", 0), "target_is_function_of_group": bool(is_function),
        }
        notes.note(g["n_groups"] < 2, BLOCKER, "insufficient_groups", "Group splits need two groups.", [r.group])
        notes.note(g["missing_rows"] > 0, BLOCKER, "missing_group_values", f"{g['missing_rows']} rows have no group.", [r.group])
        notes.note(g["n_groups"] > 0 and g["singletons"] == g["n_groups"], WARNING, "singleton_only_groups", "Every group has one row.", [r.group])
        notes.note(groups["identical_feature_signatures_across_groups"] > 0, WARNING, "feature_signatures_cross_groups", "Equal feature vectors lie in several groups.", [r.group])
        notes.note(task == "classification" and groups["conflicting_label_signatures_across_groups"] > 0, BLOCKER, "conflicting_labels_cross_groups", "Equal feature vectors in several groups have several labels.", [r.group])
        notes.note(bool(is_function), WARNING, "target_dependent_group_assignment", "The group alone tells the target.", [r.group])

    times = None
    if r.time is not None:
        c = profile.time_coverage(df, r.time).first()
        bad = c["invalid"] + c["missing"]
        monotonic = profile.is_monotonic(df, r.time, *source_order(df)).first()["monotonic"]
        times = {"column": r.time, "first": c["first"], "last": c["last"], "invalid_rows": bad, "monotonic_in_source_order": bool(monotonic)}
        notes.note(bad > 0, BLOCKER, "invalid_time_values", f"{bad} rows have no valid time.", [r.time])

    folds = []
    if task == "classification":
        candidates = [c for c in df.columns if c == r.group or GROUP_NAME.search(c)]
        for fold in [c for c in df.columns if c != r.target and FOLD_NAME.search(c)]:
            folds.append(audit := _fold(df, fold, r.target, [c for c in candidates if c != fold]))
            missing, low = audit["partitions_missing_classes"], audit["partitions_low_support"]
            notes.note(missing > 0, BLOCKER, "fold_missing_classes", f"{missing} partitions lack some classes: {_listed([p['value'] for p in audit['partitions'] if p['n_missing']], missing)}.", [fold])
            notes.note(low > 0 and not missing, WARNING, "fold_low_class_support", f"{low} partitions have a class of one row: {_listed([p['value'] for p in audit['partitions'] if p['least_support'] is not None and p['least_support'] < 2], low)}.", [fold])
            crossing = [c for c, x in audit["group_overlap"].items() if x["groups_crossing_partitions"]]
            notes.note(bool(crossing), BLOCKER, "group_ids_cross_folds", "Groups lie in several partitions.", [fold, *crossing])

    memory = None
    if r.available_bytes:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        memory = {"projected_bytes": 4 * size, "available_bytes": r.available_bytes}
        notes.note(4 * size > 0.7 * r.available_bytes, WARNING, "memory_pressure", "The table may not fit the memory of one machine.")
    return {
        "source": {"columns": df.columns}, "problem": {"task": task, "target": r.target, "row_grain": r.row_grain, "prediction_moment": r.prediction_moment},
        "dataset": {"rows": rows, "columns": len(df.columns), "missing_cells": sum(f.missing for f in facts.values())},
        "target": {"observed_rows": t.non_null, "missing_rows": t.missing, "distinct": t.distinct, "class_counts": classes, "classes_omitted": max(0, n_classes - len(classes))},
        "split_context": {"groups": groups, "time": times, "folds": folds, "feature_signatures": {k: sig.get(k, 0) for k in ("n_signatures", "n_repeated_signatures", "n_repeated_rows")} | {"fallback_recommended": fallback}},
        "memory": memory,
        "modeling_preflight": {"status": status(notes), "blocker_count": sum(f["severity"] == BLOCKER for f in notes), "warning_count": sum(f["severity"] == WARNING for f in notes), "human_review_required": list(REVIEW), "findings": list(notes), "included_features": features, "excluded_features": sorted(c for c in out if c), "exact_duplicates": exact, "substantive_duplicates": substantive},
    }


def _listed(names: list[str], of: int, most: int = 20) -> str:
    return ", ".join(names[:most]) + (f" and {of - min(most, len(names))} others" if of > min(most, len(names)) else "")


def _fold(df: DataFrame, fold: str, target: str, candidates: list[str]) -> dict:
    audit = splits.fold_audit(df, fold, target)
    low = F.col("least_support") < 2
    n, missing, few = audit.agg(F.count(F.lit(1)), F.count_if(F.col("n_missing") > 0), F.count_if(low)).first()
    # partitions with something to tell come first
    listed = audit.orderBy(F.desc(F.col("n_missing") > 0), F.desc_nulls_last(low), "partition").limit(LISTED).collect()
    lacks: dict[str, list[str]] = {x["partition"]: [] for x in listed}
    if missing:
        some = splits.missing_classes(df, fold, target).where(F.col("partition").isin([x["partition"] for x in listed if x["n_missing"]][:LACKING]))
        for x in some.orderBy("partition", "class").limit(LISTED).collect():
            lacks[x["partition"]].append(x["class"])
    parts = [{"value": x["partition"], "rows": x["n_rows"], "classes": x["n_classes"], "least_support": x["least_support"], "n_missing": x["n_missing"], "missing_classes": lacks[x["partition"]]} for x in sorted(listed, key=lambda x: x["partition"])]
    overlap = {}
    for c in candidates:
        x = splits.overlap(df, c, fold).first()
        if x["n_groups"]:
            overlap[c] = {"groups_observed": x["n_groups"], "groups_crossing_partitions": x["n_crossing"], "examples": [e["group_value"] for e in splits.crossing_groups(df, c, fold, EXAMPLES).collect()]}
    return {"column": fold, "partitions": parts, "partitions_omitted": n - len(parts), "partitions_missing_classes": missing, "partitions_low_support": few, "group_overlap": overlap}


def findings_frame(df: DataFrame, request: Request) -> DataFrame:
    """severity, code, columns (comma-joined) of the preflight's findings."""
    rows = [(f["severity"], f["code"], ",".join(f["columns"])) for f in preflight(df, request)["modeling_preflight"]["findings"]]
    return df.sparkSession.createDataFrame(rows, "severity string, code string, columns string")
