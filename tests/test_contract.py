"""A complete run passes; each broken field says so."""

import copy
import json

import pytest

from sparktab.plans import contract, run_report

A, B, C = ("a" * 64, "b" * 64, "c" * 64)


def run_document():
    budget = {"cpu_count": 4, "parallel_jobs": 2, "memory_gb": 8}
    evaluation = lambda s: {"split_fingerprint": A, "evaluation_rows_fingerprint": B, "primary_metric": "macro_f1", "score": s}
    config = {"id": "f", "status": "completed", "model_id": "m", "context_candidate_rows": 50, "context_rows_planned": 50, "context_strategy": "full", "cli_strategy": None, "score": 0.83, "latency_ms": {"median": 1.0, "p95": 2.0}, "throughput_queries_per_second": 3.0, "selected": True, "request_count": 2}
    return {
        "run_id": "r1", "created_at": "2026-01-02T03:04:05+00:00",
        "problem": {"task": "classification", "target": "quality", "prediction_moment": "later", "row_grain": "sample", "intended_use": "tests", "prohibited_uses": ["no health decisions"], "feature_contract": {"included": ["x"], "excluded": ["quality", "id"]}},
        "data": {"source": "wine.csv", "fingerprint": C, "row_count": 10},
        "modeling_preflight": {"status": "passed", "findings": ["fine"]} | {k: True for k in ("target_validated", "row_grain_validated", "prediction_moment_validated", "leakage_reviewed", "feature_availability_reviewed", "split_suitable")},
        "evaluation": {"design": "cv", "split_fingerprint": A, "evaluation_rows_fingerprint": B, "primary_metric": {"name": "macro_f1", "direction": "maximize"}},
        "approval": {"approved_at": "2026-01-02T03:04:05+00:00", "scope": {k: True for k in ("target", "feature_contract", "split_design", "primary_metric")}, "tracks": {"classical": {"selected": True, "status": "approved", "budget": budget | {"candidate_families": ["trees"], "minimum_family_coverage": 1}}, "automl": {"selected": False}, "pretrained_context": {"selected": True, "status": "approved", "budget": budget | {"max_requests": 5}, "plan": {"model_ids": ["m"], "retrieval_strategies": ["full"]}}}},
        "backends": {"classical": {"status": "completed", "retained": True, "evaluation": evaluation(0.7), "preprocessing": {"scope": "fold_local"}, "search": {"trials_budget": 3, "trials_completed": 3}, "candidates": [{"name": "t", "family": "trees", "status": "completed"}]}, "pretrained_context": {"status": "completed", "retained": True, "evaluation": evaluation(0.83), "configurations": [config]}},
        "selection": {"winner": "pretrained_context"},
        "inference": {"required_inputs": ["id", "x"], "id_columns": ["id"], "feature_order": ["x"], "dtypes": {"id": "string", "x": "double"}, "output_columns": ["prediction", "probability_good"]},
    }


def test_complete_run_passes():
    assert contract.Contract(run_document()).check() == []
    assert "pretrained_context" in run_report.render(run_document(), "# Results\nfine")


@pytest.mark.parametrize(
    "path, value, says",
    [
        ("created_at", "yesterday", "created_at"), ("data.fingerprint", "x", "digest"), ("modeling_preflight.status", "blocked", "preflight"), ("approval.scope.extra", True, "unknown keys"), ("selection.winner", "classical", "best score"),
        ("backends.classical.search.trials_completed", 9, "trials"), ("backends.classical.evaluation.split_fingerprint", C, "split_fingerprint"), ("backends.classical.candidates", [], "families"), ("inference.feature_order", ["id"], "feature_order"),
        ("evaluation.primary_metric.direction", "up", "direction"), ("approval.tracks.automl.selected", True, "differ"), ("lineage", {"x": {"duplicated_parent_files": []}}, "duplicated"), ("ablation", {"results": [{"group": "g", "ablated_score": 0.6, "reference_score": 0.7, "delta": 0.1}]}, "delta"),
    ],
)
def test_broken_fields(path, value, says):
    run = copy.deepcopy(run_document())
    *parents, last = path.split(".")
    place = run
    for p in parents:
        place = place[p]
    place[last] = value
    assert any(says in e for e in contract.Contract(run).check())


def test_cases_run_and_status_moves(tmp_path):
    run = run_document()
    infer = """import argparse, json, sys
p = argparse.ArgumentParser()
for n in ("backend", "input", "output"): p.add_argument("--" + n)
a = p.parse_args()
rows = json.load(open(a.input))["rows"]
if rows and "x" not in rows[0]: sys.exit("missing column x")
json.dump({"columns": ["id"], "rows": [{"id": r["id"], "prediction": "good", "probability_good": 0.5} for r in rows]}, open(a.output, "w"))
"""
    row = {"id": "1", "x": 2.0}
    cases = [{"backend": "classical", "kind": k, "repeats": 2, "input": {"columns": ["id", "x"], "rows": r}} for k, r in (("representative", [row, {"id": "2", "x": 1.0}]), ("single_row", [row]), ("empty_input", []))]
    cases.append({"backend": "classical", "kind": "missing_required_column", "repeats": 2, "input": {"columns": ["id"], "rows": [{"id": "1"}]}, "expected_exit_code": 1, "stderr_contains": "missing column"})
    files = {"run.json": json.dumps(run), "report.html": "<p>x</p>", "results.md": "pretrained_context predicts quality with 0.83; no health decisions", "infer.py": infer, "requirements.lock": "numpy==2.0.0\n", "validation.json": json.dumps({"cases": cases})}
    for n, text in files.items():
        (tmp_path / n).write_text(text)
    assert contract.validate(str(tmp_path), execute=True) == []
    assert json.loads((tmp_path / "validation.json").read_text())["status"] == "passed"
    (tmp_path / "infer.py").write_text(infer.replace("0.5", "1.5"))
    (tmp_path / "figures").mkdir()
    got = contract.validate(str(tmp_path), execute=True)
    assert any("figures" in e for e in got) and json.loads((tmp_path / "validation.json").read_text())["status"] == "pending"
    (tmp_path / "figures").rmdir()
    assert any("probability" in e for e in contract.validate(str(tmp_path), execute=True))
