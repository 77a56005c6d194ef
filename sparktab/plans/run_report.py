"""One page for a run: scores in the metric's direction, ledgers, findings."""

from __future__ import annotations

from html import escape

from .contract import at, finite
from .report import _STYLE, _table, bars


def render(run: dict, results: str = "") -> str:
    """Self-contained HTML of a run document and its results text."""
    down = at(run, "evaluation.primary_metric.direction") == "minimize"
    scores = [(k, float(at(v, "evaluation.score"))) for k, v in at(run, "backends", {}).items() if finite(at(v, "evaluation.score"))]
    scores.sort(key=lambda x: x[1], reverse=not down)
    parts = [f"<h1>{escape(str(at(run, 'run_id', 'run')))}</h1><p>Target {escape(str(at(run, 'problem.target', '')))}; winner {escape(str(at(run, 'selection.winner', '')))}.</p>"]
    parts.append(f"<h2>{escape(str(at(run, 'evaluation.primary_metric.name', 'score')))} ({'lower' if down else 'higher'} is better)</h2>" + bars(scores))
    for name, b in at(run, "backends", {}).items():
        parts.append(f"<h2>{escape(name)}: {escape(str(b.get('status')))}</h2>")
        for key in ("candidates", "configurations", "native_leaderboard", "internal_failures"):
            if rows := b.get(key):
                head = sorted(set().union(*rows))
                parts.append(f"<h3>{key.replace('_', ' ')}</h3>" + _table(head, [[r.get(h) if not isinstance(r.get(h), dict) else str(r[h]) for h in head] for r in rows]))
    for finding in at(run, "modeling_preflight.findings", []):
        parts.append(f"<p>{escape(str(finding))}</p>")
    body = "".join(f"<h3>{escape(x.lstrip('# '))}</h3>" if x.startswith("#") else f"<p>{escape(x)}</p>" for x in results.splitlines() if x.strip())
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Run</title><style>{_STYLE}</style><body>{"".join(parts)}{body}</body></html>'
