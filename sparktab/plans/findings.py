"""Findings of a profile: severity, title and detail, from collected aggregates only."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from ..functions.types import NUMERIC, ColumnFacts, role
from ..operators import association, duplicates, profile

MISSING_HIGH, CLASSES, IMBALANCE, LISTED = 0.20, 20, 3.0, 8


@dataclass(frozen=True)
class Finding:
    severity: str
    title: str
    detail: str

    def as_dict(self) -> dict[str, str]:
        return asdict(self)


def _listed(names: list[str], most: int = LISTED) -> str:
    return ", ".join(names[:most]) + (" and others" if len(names) > most else "")


def duplicate_counts(df: DataFrame, facts: list[ColumnFacts], roles: dict[str, str]) -> dict:
    """Exact repeats over all columns, and repeats over those that are neither identifiers nor pipeline metadata."""
    excluded = [f.name for f in facts if roles[f.name] in ("possible identifier", "possible pipeline metadata")]
    kept = [c for c in df.columns if c not in excluded]
    exact = duplicates.duplicate_rows(df).first()["n_repeated"]
    repeated = duplicates.duplicate_rows(df, kept).first()["n_repeated"] if excluded and kept else exact
    return {"exact": exact, "repeated": repeated, "excluded": excluded}


def make_findings(df: DataFrame, facts: list[ColumnFacts], target: str | None = None, time: str | None = None, group: str | None = None) -> list[Finding]:
    """The profile's findings. Their titles, severities and order, which readers of a report look for."""
    roles = {f.name: role(f, target, time, group) for f in facts}
    by_name = {f.name: f for f in facts}
    rows = facts[0].rows if facts else 0
    share = lambda n: f"{n / rows:.1%}" if rows else "0.0%"
    out = [Finding("info", "Dataset shape", f"{rows:,} rows and {len(facts):,} columns.")]

    dup = duplicate_counts(df, facts, roles)
    note = f" Left out of the comparison: {_listed(dup['excluded'])}." if dup["excluded"] else ""
    if dup["repeated"]:
        same = f" {dup['exact']:,} of them are equal in every column." if dup["exact"] else " None are equal in every column."
        out.append(Finding("warning", "Repeated observations", f"{dup['repeated']:,} rows ({share(dup['repeated'])}) repeat an earlier one in the substantive columns.{same}{note}"))
    else:
        out.append(Finding("positive", "No repeated observations", f"No row repeats an earlier one in the substantive columns.{note}"))

    high = [f for f in facts if f.missing_rate >= MISSING_HIGH]
    cells = sum(f.missing for f in facts)
    if high:
        out.append(Finding("warning", "Substantial missingness", f"{len(high)} columns miss a fifth of their values or more: {_listed([f'{f.name} ({f.missing_rate:.1%})' for f in high], 5)}."))
    elif cells:
        out.append(Finding("info", "Some values are missing", f"{cells:,} cells have no value."))
    else:
        out.append(Finding("positive", "No missing values", "Every cell has a value."))

    if constant := [f.name for f in facts if f.distinct <= 1]:
        out.append(Finding("warning", "Constant columns", f"{len(constant)} columns don't vary: {_listed(constant)}."))
    if ids := [f.name for f in facts if roles[f.name] == "possible identifier" and f.name != target]:
        out.append(Finding("review", "Possible identifiers", f"These look like identifiers, not measurements: {_listed(ids)}."))
    if meta := [f.name for f in facts if roles[f.name] == "possible pipeline metadata"]:
        out.append(Finding("review", "Possible pipeline metadata", f"These look made by preparation or evaluation: {_listed(meta)}."))
    outliers = sorted(((f.numeric.get("outliers_iqr") or 0, f.name) for f in facts), key=lambda x: (-x[0], x[1]))
    if outliers := [(n, c) for n, c in outliers if n]:
        out.append(Finding("review", "Potential numeric outliers", f"Beyond 1.5 interquartile ranges: {_listed([f'{c} ({n:,})' for n, c in outliers], 5)}."))

    if target is not None:
        t = by_name[target]
        if t.missing:
            out.append(Finding("warning", "Target values are missing", f"{t.missing:,} rows ({share(t.missing)}) have no {target}."))
        if t.distinct == 0:
            out.append(Finding("warning", "Target is empty", f"{target} has no value."))
        elif t.distinct == 1:
            out.append(Finding("warning", "Target has one observed value", f"{target} tells no rows apart."))
        elif t.distinct <= CLASSES:
            b = profile.class_balance(df, target, CLASSES).first()
            out.append(Finding("warning" if b["ratio"] >= IMBALANCE else "info", "Target class balance", f"{target} has {t.distinct} classes of {b['smallest']:,} to {b['largest']:,} rows ({b['ratio']:.1f}:1)."))
        elif t.logical == NUMERIC:
            out.append(Finding("info", "Numeric target", f"{target} has {t.distinct:,} distinct values."))
        if copies := [r["column_name"] for r in association.target_copies(df, target).collect() if r["is_copy"]]:
            out.append(Finding("warning", "Columns duplicate the target", f"Equal to {target} wherever both are known: {_listed(copies)}."))

    if time is not None:
        c = profile.time_coverage(df, time).first()
        if c["first"] is None:
            out.append(Finding("warning", "Time values are not parseable", f"No value of {time} is a time."))
        else:
            bad = f" {c['invalid']:,} values are no times." if c["invalid"] else ""
            out.append(Finding("warning" if c["invalid"] else "info", "Time coverage", f"{time} runs from {c['first']} to {c['last']}.{bad}"))
    if group is not None:
        g = profile.group_structure(df, group).first()
        out.append(Finding("info", "Group structure", f"{group} has {g['n_groups']:,} groups; {g['singletons']:,} have one row, the largest {g['largest'] or 0:,}."))
    return out


def markdown(findings: list[Finding]) -> str:
    return "\n".join(f"- **{f.title}** ({f.severity.capitalize()}) — {f.detail}" for f in findings)
