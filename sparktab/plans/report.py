"""The profile report: one self-contained HTML file, the same bytes for the same table, options and seed."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import CATEGORY, NUMERIC, ColumnFacts, role
from ..operators import association, distribution, profile
from ..sources.readers import guard, write_atomic
from . import findings as findings_

SAMPLE_ROWS, NUMERIC_CHARTS, CATEGORY_CHARTS, CORRELATED, RELATED = 5_000, 8, 6, 12, 8
_STYLE = "body{font:15px sans-serif;max-width:62em;margin:2em auto}table{border-collapse:collapse}td,th{padding:.2em .6em;border-bottom:1px solid #ddd;text-align:left}rect{fill:#4a7aa7}.warning{color:#a33}.review{color:#85600a}"


def bars(rows: list[tuple[str, float]], width: int = 420) -> str:
    """Horizontal bars as SVG."""
    top = max((v for _, v in rows), default=0) or 1
    lines = [f'<text x="0" y="{20 * i + 14}" font-size="12">{escape(str(k))}</text><rect x="190" y="{20 * i + 4}" width="{v / top * (width - 190):.1f}" height="13"/><text x="{195 + v / top * (width - 190):.1f}" y="{20 * i + 14}" font-size="11">{v:,.6g}</text>' for i, (k, v) in enumerate(rows)]
    return f'<svg role="img" width="{width + 90}" height="{20 * len(rows) + 6}">{"".join(lines)}</svg>'


def _table(head: list[str], rows: list[list]) -> str:
    cell = lambda v: "" if v is None else f"{v:,.6g}" if isinstance(v, float) else escape(str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{body}</table>"


def relationships(df: DataFrame, facts: list[ColumnFacts], roles: dict[str, str], target: str) -> list[tuple[str, str, float]]:
    """(column, measure, strength) of target relationships on the full table, strongest first, ties by name."""
    numeric_target = next(f for f in facts if f.name == target).logical == NUMERIC and next(f for f in facts if f.name == target).distinct > 20
    out = []
    usable = [f for f in facts if f.name != target and roles[f.name] not in ("possible identifier", "possible pipeline metadata")]
    numbers = [f.name for f in usable if f.logical == NUMERIC]
    labels = [f.name for f in usable if f.logical == CATEGORY and 2 <= f.distinct <= 50]
    if numeric_target:
        if numbers:
            out += [(r["left_column"] if r["right_column"] == target else r["right_column"], "|r|", abs(r["r"] or 0.0)) for r in association.pearson_pairs(df, [*numbers, target]).where((F.col("left_column") == target) | (F.col("right_column") == target)).collect()]
        out += [(c, "eta squared", association.eta_squared(df, c, target).first()["eta_squared"]) for c in labels]
    else:
        out += [(c, "eta squared", association.eta_squared(df, target, c).first()["eta_squared"]) for c in numbers]
        out += [(c, "Cramer's V", association.cramers_v(df, c, target).first()["cramers_v"]) for c in labels]
    return sorted(out, key=lambda x: (-x[2], x[0]))[:RELATED]


def render(df: DataFrame, title: str, target: str | None = None, time: str | None = None, group: str | None = None, seed: int = 7, sample_rows: int = SAMPLE_ROWS, numeric_charts: int = NUMERIC_CHARTS, category_charts: int = CATEGORY_CHARTS, fingerprint: str = "") -> tuple[str, list[findings_.Finding]]:
    """(HTML, findings). Counts, summaries, findings and relationships use the whole table; charts a hash-ordered sample, and say so."""
    guard(df, [target, time, group])
    facts = profile.facts(df)
    roles = {f.name: role(f, target, time, group) for f in facts}
    found = findings_.make_findings(df, facts, target, time, group)
    rows = facts[0].rows
    sampled = rows > sample_rows
    key = F.xxhash64(*[F.to_json(F.struct(profile.q(c))) for c in df.columns])
    charted = distribution.hash_sample(df.withColumn("_row", key), sample_rows, ["_row"], seed).drop("_row").cache() if sampled else df
    parts = [f"<h1>{escape(title)}</h1><p>{rows:,} rows, {len(facts)} columns. Charts show {'a sample of ' + format(sample_rows, ',') + ' rows' if sampled else 'all rows'}. {escape(fingerprint)}</p>"]
    parts.append("<h2>Findings</h2><ul>" + "".join(f'<li class="{f.severity}"><b>{escape(f.title)}</b> ({f.severity.capitalize()}): {escape(f.detail)}</li>' for f in found) + "</ul>")
    head = ["column", "type", "role", "missing", "distinct", "min", "median", "max", "mean"]
    parts.append("<h2>Columns</h2>" + _table(head, [[f.name, f.logical, roles[f.name], f"{f.missing_rate:.1%}", f.distinct, *[f.numeric.get(k) for k in ("min", "median", "max", "mean")]] for f in facts]))
    if gaps := sorted(((-f.missing_rate, f.name) for f in facts if f.missing)):
        parts.append("<h2>Missing values</h2>" + bars([(c, -m) for m, c in gaps[:20]]))
    if target is not None:
        t = next(f for f in facts if f.name == target)
        view = distribution.target_view(df, target, t.logical == NUMERIC, t.distinct).collect()
        parts.append(f"<h2>Target {escape(target)}</h2>" + bars([(r["label"], r["n"]) for r in view]))
        if related := relationships(df, facts, roles, target):
            parts.append("<h2>Relationships with the target</h2>" + bars([(f"{c} ({m})", v) for c, m, v in related]))
    if time is not None:
        buckets = distribution.time_buckets(df, time).orderBy("bucket").collect()
        parts.append(f"<h2>Time {escape(time)}</h2>" + bars([(str(r["period"])[:10], r["n"]) for r in buckets]))
    numbers = [f.name for f in facts if f.logical == NUMERIC and roles[f.name] == "numeric measure"]
    for c in numbers[:numeric_charts]:
        shown = distribution.histogram(charted, c).orderBy("bin").collect()
        parts.append(f"<h3>{escape(c)}</h3>" + bars([(f"{r['bin_start']:.6g}", r["n"]) for r in shown]))
    for f in [f for f in facts if f.logical == CATEGORY and roles[f.name] == "category/text" and 2 <= f.distinct <= 100][:category_charts]:
        parts.append(f"<h3>{escape(f.name)}</h3>" + bars([(r["label"], r["n"]) for r in distribution.top_labels(charted, f.name).collect()]))
    related = [c for c in numbers if next(f for f in facts if f.name == c).distinct > 1][:CORRELATED]
    if len(related) > 1:
        pairs = association.pearson_pairs(charted, related).collect()
        parts.append("<h2>Correlations</h2>" + _table(["left", "right", "n", "r"], [[p["left_column"], p["right_column"], p["n"], p["r"]] for p in pairs]))
    if sampled:
        charted.unpersist()
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style><body>{"".join(parts)}</body></html>', found


def write(df: DataFrame, path: str, title: str, **options) -> str:
    """Write the report in one move; returns the findings as Markdown."""
    html, found = render(df, title, **options)
    write_atomic(path, html)
    return findings_.markdown(found)
