"""Run contracts: is a recorded modelling run complete, consistent and reproducible?

Errors accumulate in one list; nothing raises for a bad record. Records are small and stay on the driver; only the outputs
of inference cases are compared as frames.
"""

from __future__ import annotations

import csv
import io
import json
import math
import os
import re
import subprocess
import sys
import tempfile
from datetime import datetime
from typing import Any

from ..sources.readers import write_atomic

# Files of a run and kinds of cases.
REQUIRED_FILES = frozenset({"run.json", "report.html", "results.md", "infer.py", "requirements.lock", "validation.json"})
ALLOWED_ENTRIES = REQUIRED_FILES | {"train.py", "backends"}
FORBIDDEN_NAMES = frozenset({"README.md", "data_profile.json", "data_report.html", "data_summary.md", "diagnostics", "eda_report.html", "figures", "inference_outputs", "__pycache__"})
CASE_KINDS = frozenset({"representative", "single_row", "empty_input", "missing_required_column"})
THREAD_LIMITS = ("OMP_NUM_THREADS", "MKL_NUM_THREADS", "OPENBLAS_NUM_THREADS", "VECLIB_MAXIMUM_THREADS")
SHA256 = re.compile(r"^(?:sha256:)?[0-9a-fA-F]{64}$")
TOLERANCE = 1e-12

#: The tracks of a run; other names can be given to Contract.
TRACKS = ("classical", "automl", "pretrained_context")
_NUMBER, _TEXT, _MAP, _LIST = (int, float), str, dict, list


def finite(x: Any) -> bool:
    return isinstance(x, _NUMBER) and not isinstance(x, bool) and math.isfinite(x)


def timestamp(x: Any) -> datetime | None:
    """An ISO 8601 time with a zone, or None."""
    try:
        t = datetime.fromisoformat(x)
    except (TypeError, ValueError):
        return None
    return t if t.tzinfo else None


def at(doc: Any, path: str, default: Any = None) -> Any:
    for key in path.split("."):
        if not isinstance(doc, dict) or key not in doc:
            return default
        doc = doc[key]
    return doc


def keys_within(doc: Any) -> set[str]:
    """Every key at any depth."""
    if isinstance(doc, dict):
        return set(doc).union(*map(keys_within, doc.values()))
    return set().union(*map(keys_within, doc)) if isinstance(doc, list) else set()


class Contract:
    def __init__(self, run: dict, tracks: tuple[str, ...] = TRACKS):
        self.run, self.tracks, self.errors = run, tracks, []

    def need(self, fine: Any, message: str) -> bool:
        if not fine:
            self.errors.append(message)
        return bool(fine)

    def typed(self, path: str, kind: Any) -> Any:
        value = at(self.run, path)
        ok = finite(value) if kind is _NUMBER else isinstance(value, kind) and (kind is not _TEXT or value.strip())
        self.need(ok, f"{path} is missing or of the wrong type")
        return value if ok else None

    def known(self, path: str, allowed: set[str]) -> None:
        if extra := set(at(self.run, path, {}) or {}) - allowed:
            self.errors.append(f"{path} has unknown keys: {', '.join(sorted(extra))}")

    def digest(self, path: str) -> str | None:
        value = at(self.run, path)
        self.need(isinstance(value, str) and SHA256.match(value), f"{path} is no sha256 digest")
        return value

    # sections

    def sections(self) -> None:
        self.typed("run_id", _TEXT)
        self.need(timestamp(at(self.run, "created_at")), "created_at is no time with a zone")
        for path in ("problem.task", "problem.target", "problem.prediction_moment", "problem.row_grain", "problem.intended_use", "data.source", "evaluation.design", "evaluation.primary_metric.name"):
            self.typed(path, _TEXT)
        self.typed("problem.prohibited_uses", _LIST)
        included, excluded = at(self.run, "problem.feature_contract.included", []), at(self.run, "problem.feature_contract.excluded", [])
        self.need(included and not set(included) & set(excluded), "the feature contract is empty or overlaps its exclusions")
        self.need(at(self.run, "problem.target") not in included, "the target is a feature")
        self.digest("data.fingerprint")
        self.need(isinstance(at(self.run, "data.row_count"), int) and at(self.run, "data.row_count") > 0, "data.row_count must be positive")
        for path in ("evaluation.split_fingerprint", "evaluation.evaluation_rows_fingerprint"):
            self.digest(path)
        self.need(at(self.run, "evaluation.primary_metric.direction") in ("maximize", "minimize"), "the metric needs a direction")
        self.need(at(self.run, "modeling_preflight.status") == "passed", "the preflight has not passed")
        for name in ("target_validated", "row_grain_validated", "prediction_moment_validated", "leakage_reviewed", "feature_availability_reviewed", "split_suitable"):
            self.need(at(self.run, f"modeling_preflight.{name}") is True, f"modeling_preflight.{name} is not true")
        if at(self.run, "problem.high_stakes"):
            self.typed("problem.governance", _MAP)

    def approval(self) -> None:
        self.need(timestamp(at(self.run, "approval.approved_at")), "approval.approved_at is no time with a zone")
        scope = {"target", "feature_contract", "split_design", "primary_metric"}
        self.known("approval.scope", scope)
        for name in sorted(scope):
            self.need(at(self.run, f"approval.scope.{name}") is True, f"approval.scope.{name} is not approved")
        tracks = at(self.run, "approval.tracks", {})
        self.need(set(tracks) == set(self.tracks), f"approval.tracks must be {', '.join(self.tracks)}")
        for name, track in tracks.items():
            if not track.get("selected"):
                continue
            self.need(track.get("status") == "approved", f"track {name} is selected but not approved")
            budget = track.get("budget", {})
            for key in ("cpu_count", "parallel_jobs", "memory_gb"):
                self.need(finite(budget.get(key)) and budget[key] > 0, f"track {name} has no positive {key}")
            self.need((budget.get("parallel_jobs") or 0) <= (budget.get("cpu_count") or 0), f"track {name} has more jobs than processors")
            limit, mode = budget.get("time_limit_seconds"), budget.get("run_mode")
            if mode == "run_to_completion":
                low, high = at(budget, "runtime_estimate.lower_seconds"), at(budget, "runtime_estimate.upper_seconds")
                self.need(limit is None and finite(low) and finite(high) and low <= high, f"track {name} runs to completion and needs an estimate, not a limit")
            elif limit is not None:
                self.need(finite(limit) and limit > 0, f"track {name} has no positive time limit")
        for change in at(self.run, "approval.amendments", []):
            self.need(timestamp(change.get("approved_at")) and change.get("reason"), "an amendment lacks its time or reason")
        for move in at(self.run, "approval.remote_transfers", []):
            self.need(move.get("backend") in self.tracks and move.get("destination") and move.get("purpose") and isinstance(move.get("data_scope"), dict) and timestamp(move.get("approved_at")), "a remote transfer is not fully approved")

    def backends(self) -> dict[str, float]:
        """Checks every backend against its track; the retained ones' scores."""
        scores = {}
        backends, tracks = at(self.run, "backends", {}), at(self.run, "approval.tracks", {})
        self.need(set(backends) == {k for k, v in tracks.items() if v.get("selected")}, "backends and selected tracks differ")
        for name, b in backends.items():
            if b.get("status") == "unavailable":
                self.need(b.get("failure_reason") and not b.get("retained"), f"{name} is unavailable: it needs a reason and can't be retained")
                continue
            self.need(b.get("status") == "completed", f"{name} is neither completed nor unavailable")
            for key in ("split_fingerprint", "evaluation_rows_fingerprint"):
                self.need(at(b, f"evaluation.{key}") == at(self.run, f"evaluation.{key}"), f"{name} was not evaluated with the run's {key}")
            self.need(at(b, "evaluation.primary_metric") == at(self.run, "evaluation.primary_metric.name"), f"{name} was evaluated by another metric")
            score = at(b, "evaluation.score")
            if self.need(finite(score), f"{name} has no finite score") and b.get("retained"):
                scores[name] = float(score)
            self._ledger(name, b, tracks.get(name, {}))
        return scores

    def _ledger(self, name: str, b: dict, track: dict) -> None:
        budget = track.get("budget", {})
        if "search" in b:
            done, most = at(b, "search.trials_completed"), at(b, "search.trials_budget")
            self.need(finite(done) and finite(most) and done <= most, f"{name} ran more trials than its budget")
        if "preprocessing" in b:
            self.need(at(b, "preprocessing.scope") == "fold_local", f"{name} was not preprocessed within folds")
        if "candidates" in b:
            names = [c.get("name") for c in b["candidates"]]
            self.need(len(set(names)) == len(names), f"{name} has candidates of one name")
            families = {c.get("family") for c in b["candidates"] if c.get("status") == "completed"}
            self.need(set(budget.get("candidate_families", [])) <= families, f"{name} misses approved families")
            self.need(len(families) >= (budget.get("minimum_family_coverage") or 0), f"{name} covers too few families")
        if "configurations" in b:
            rows = b["configurations"]
            chosen = [c for c in rows if c.get("selected")]
            self.need(len(chosen) == 1, f"{name} must select one configuration")
            if len(chosen) == 1:
                self.need(abs(chosen[0].get("score", math.inf) - at(b, "evaluation.score", 0)) <= TOLERANCE, f"{name}'s selected configuration has another score")
            for c in rows:
                self._configuration(name, c)
            plan = track.get("plan", {})
            seen = [c for c in rows if c.get("status") == "completed"]
            self.need(set(plan.get("model_ids", [])) <= {c.get("model_id") for c in rows}, f"{name} misses approved models")
            self.need(set(plan.get("retrieval_strategies", [])) <= {c.get("context_strategy") for c in rows}, f"{name} misses approved strategies")
            tested = {"context_scale_tested": len({c.get("context_rows_planned") for c in seen}) > 1, "retrieval_comparison_tested": len({c.get("context_strategy") for c in seen}) > 1, "model_variants_tested": len({c.get("model_id") for c in seen}) > 1}
            for key, value in tested.items():
                self.need(at(b, f"evaluation_coverage.{key}") in (None, value), f"{name} records {key} against its ledger")
            sent = sum(c.get("request_count") or 0 for c in rows)
            self.need(sent <= budget.get("max_requests", math.inf), f"{name} sent more requests than its budget")
        if "build" in b:
            self.need(at(b, "build.run_mode") == budget.get("run_mode"), f"{name} was built in another mode than approved")
            for key in ("external_preprocessing", "external_search"):
                self.need(not at(b, f"data_handling.{key}", False), f"{name} must not use {key}")

    def _configuration(self, name: str, c: dict) -> None:
        if c.get("status") != "completed":
            self.need(c.get("failure_reason"), f"{name}: a configuration failed without a reason")
            return
        n, held, strategy = c.get("context_rows_planned"), c.get("context_candidate_rows"), c.get("context_strategy")
        full = strategy == "full"
        self.need(finite(n) and finite(held) and (n == held if full else n < held), f"{name}: {strategy} context of {n} rows from {held}")
        self.need(c.get("cli_strategy") in ({None} if full else {f"{strategy}::{n}"}), f"{name}: strategy argument and context size differ")
        median, p95 = at(c, "latency_ms.median"), at(c, "latency_ms.p95")
        self.need(finite(median) and finite(p95) and 0 <= median <= p95, f"{name}: latency must be finite, p95 no less than the median")
        self.need(finite(c.get("throughput_queries_per_second")), f"{name}: throughput must be finite")

    def selection(self, scores: dict[str, float]) -> None:
        winner = at(self.run, "selection.winner")
        if not self.need(winner in scores, "the winner is not a retained backend"):
            return
        best = (max if at(self.run, "evaluation.primary_metric.direction") == "maximize" else min)(scores.values())
        self.need(abs(scores[winner] - best) <= TOLERANCE, "the winner does not have the best score")

    def inference(self) -> None:
        c = self.typed("inference", _MAP) or {}
        ids, features = c.get("id_columns", []), c.get("feature_order", [])
        inputs = c.get("required_inputs", [])
        self.need(len(set(inputs)) == len(inputs), "required inputs repeat")
        self.need(features == [x for x in inputs if x not in ids], "feature_order must be the inputs without ids, in order")
        self.need(set(c.get("dtypes", {})) == set(inputs), "dtypes must name every input")
        bounds = c.get("probability_bounds", [0, 1])
        self.need(len(bounds) == 2 and bounds[0] == 0 and bounds[1] == 1, "probabilities lie in [0, 1]")

    def ablations(self) -> None:
        for a in at(self.run, "ablation.results", []):
            want = a.get("ablated_score", math.nan) - a.get("reference_score", math.nan)
            self.need(finite(a.get("delta")) and abs(a["delta"] - want) <= 1e-9, f"ablation {a.get('group')} has a wrong delta")
            self.need(a.get("evaluation_rows_fingerprint") != at(self.run, "evaluation.evaluation_rows_fingerprint"), f"ablation {a.get('group')} used the final evaluation rows")

    def lineage(self) -> None:
        self.need("duplicated_parent_files" not in keys_within(at(self.run, "lineage", {})), "parent files must not be duplicated")

    def check(self) -> list[str]:
        self.sections()
        self.approval()
        self.selection(self.backends())
        self.inference()
        self.ablations()
        self.lineage()
        return self.errors


def layout(folder: str) -> list[str]:
    """Errors of a run folder's files: missing, unknown, forbidden, or links."""
    names = set(os.listdir(folder))
    errors = [f"missing {n}" for n in sorted(REQUIRED_FILES - names)] + [f"not allowed: {n}" for n in sorted(names - ALLOWED_ENTRIES)]
    for d, folders, files in os.walk(folder):
        for n in [*folders, *files]:
            if n in FORBIDDEN_NAMES:
                errors.append(f"forbidden name {n}")
            if os.path.islink(os.path.join(d, n)):
                errors.append(f"{n} is a link")
    return errors


# One requirement by the grammar of Python packages' names and versions (PEP 508, PEP 440), pinned to a single version.
_WORD = r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
_VERSION = r"(?:\d+!)?\d+(?:\.\d+)*(?:[-_.]?[a-z]+[-_.]?\d*)*(?:-\d+)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?"
PINNED = re.compile(rf"{_WORD}(?:\[{_WORD}(?:\s*,\s*{_WORD})*\])?=={_VERSION}(?:\s*;\s*\S.*)?", re.IGNORECASE)


def requirements(text: str) -> list[str]:
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    return ([] if lines else ["no requirements"]) + [f"not pinned: {x}" for x in lines if not PINNED.fullmatch(x)]


def report_errors(html: str) -> list[str]:
    """External assets of a report that must stand alone."""
    found = re.findall(r"""(?i)(?:src|href|data)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)|url\(\s*["']?((?:https?:)?//[^"')]+)|@import|\bfetch\(""", html)
    return [f"external asset: {a or b or 'import or fetch'}" for a, b in found]


def handoff_errors(text: str, run: dict) -> list[str]:
    """What a results text must name: the winner, its score, the target and the prohibited uses."""
    plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).lower()
    winner, score = at(run, "selection.winner"), at(run, f"backends.{at(run, 'selection.winner')}.evaluation.score")
    errors = [f"the text does not name {x}" for x in (winner, at(run, "problem.target")) if x and str(x).lower() not in plain]
    numbers = [float(x) for x in re.findall(r"[-+]?\d+\.?\d*(?:e[-+]?\d+)?", plain)]
    if finite(score) and not any(math.isclose(x, score, rel_tol=1e-4, abs_tol=5e-4) for x in [*numbers, *(n / 100 for n in numbers)]):
        errors.append("the text does not give the winner's score")
    return errors + [f"the text leaves out a prohibited use: {x}" for x in at(run, "problem.prohibited_uses", []) if x.lower() not in plain]


def output_errors(inputs: list[dict], outputs: list[dict], run: dict) -> list[str]:
    """Errors of one inference output against its input: rows, order of ids, finite values, bounds."""
    ids, columns = at(run, "inference.id_columns", []), at(run, "inference.output_columns", [])
    errors = [] if len(inputs) == len(outputs) else [f"{len(outputs)} rows for {len(inputs)}"]
    for i, (a, b) in enumerate(zip(inputs, outputs, strict=False)):
        if [str(a.get(c)) for c in ids] != [str(b.get(c)) for c in ids]:
            errors.append(f"row {i} is not aligned")
        for c in columns:
            if c not in b:
                errors.append(f"row {i} lacks {c}")
            elif c.startswith("probability") and not (finite(p := float(b[c])) and 0 <= p <= 1):
                errors.append(f"row {i}: {c} is no probability")
    return errors


def _records(table: list | dict) -> list[dict]:
    """The rows of a JSON list of objects, or of the envelope {columns, rows} with rows as lists or objects."""
    if not isinstance(table, dict):
        return table
    return [r if isinstance(r, dict) else dict(zip(table["columns"], r, strict=True)) for r in table["rows"]]


def write_input(path: str, table: list | dict, kind: str) -> None:
    """A case's input as JSON, or as CSV with a header (of the envelope's columns, where there is one)."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        if kind == "json":
            json.dump(table, f)
            return
        rows = _records(table)
        writer = csv.DictWriter(f, table["columns"] if isinstance(table, dict) else list(dict.fromkeys(k for r in rows for k in r)))
        writer.writeheader()
        writer.writerows(rows)


def read_output(text: str, kind: str) -> list[dict]:
    """Rows of an inference output; ValueError for what is no table or names a column twice."""
    if kind == "json":
        once = lambda pairs: dict(pairs) if len(pairs) == len({k for k, _ in pairs}) else _twice()
        found = _records(json.loads(text, object_pairs_hook=once))
        if not isinstance(found, list) or not all(isinstance(r, dict) for r in found):
            raise ValueError("the output is no list of objects")
        return found
    lines = list(csv.reader(io.StringIO(text), strict=True))
    if not lines or len(lines[0]) != len(set(lines[0])):
        _twice()
    if any(len(x) != len(lines[0]) for x in lines[1:]):
        raise ValueError("rows of the output differ in length")
    return [dict(zip(lines[0], x, strict=True)) for x in lines[1:]]


def _twice() -> dict:
    raise ValueError("the output has no columns or names one twice")


def run_cases(folder: str, run: dict, cases: list[dict], timeout: float = 60) -> list[str]:
    """Run each case as often as it says in a fresh process, and compare the outputs; errors of all cases."""
    errors = [f"no case of kind {k}" for k in sorted(CASE_KINDS - {c.get("kind") for c in cases})]
    env = os.environ | {k: "1" for k in THREAD_LIMITS}
    for case in cases:
        seen = set()
        label = f"{case.get('backend')}/{case.get('kind')}"
        if (case.get("repeats") or 0) < 2:
            errors.append(f"{label} must repeat")
        for _ in range(max(2, case.get("repeats") or 0)):
            with tempfile.TemporaryDirectory() as temp:
                kind = case.get("format", "json")
                source, target = os.path.join(temp, f"in.{kind}"), os.path.join(temp, f"out.{kind}")
                write_input(source, case["input"], kind)
                try:
                    done = subprocess.run([sys.executable, "infer.py", "--backend", case["backend"], "--input", source, "--output", target], cwd=folder, env=env, capture_output=True, text=True, timeout=timeout)
                except subprocess.TimeoutExpired:
                    errors.append(f"{label} took too long")
                    break
                if done.returncode != case.get("expected_exit_code", 0):
                    errors.append(f"{label} ended with {done.returncode}")
                    break
                if case.get("stderr_contains") and case["stderr_contains"] not in done.stderr:
                    errors.append(f"{label} does not say {case['stderr_contains']}")
                if case.get("expected_exit_code", 0) == 0:
                    with open(target, encoding="utf-8") as f:
                        seen.add(text := f.read())
                    try:
                        rows = read_output(text, kind)
                    except ValueError as e:
                        errors.append(f"{label}: {e}")
                        break
                    given = _records(case["input"])
                    errors += [f"{label}: {e}" for e in output_errors(given, rows, run)]
        if len(seen) > 1:
            errors.append(f"{label} gives different outputs")
    return errors


def validate(folder: str, tracks: tuple[str, ...] = TRACKS, execute: bool = False) -> list[str]:
    """All errors of a run folder. validation.json is pending while it runs and passed only without errors after executed cases."""
    errors = layout(folder)
    read = lambda n: open(os.path.join(folder, n), encoding="utf-8").read() if os.path.exists(os.path.join(folder, n)) else ""  # noqa: E731, SIM115
    try:
        run, validation = json.loads(read("run.json") or "{}"), json.loads(read("validation.json") or "{}")
    except ValueError as e:
        return [*errors, f"not JSON: {e}"]
    place = os.path.join(folder, "validation.json")
    write_atomic(place, json.dumps(validation | {"status": "pending"}, indent=2, sort_keys=True))
    errors += Contract(run, tracks).check() + requirements(read("requirements.lock")) + report_errors(read("report.html")) + handoff_errors(read("results.md"), run)
    if execute and not errors:
        errors += run_cases(folder, run, validation.get("cases", []))
        if not errors:
            write_atomic(place, json.dumps(validation | {"status": "passed"}, indent=2, sort_keys=True))
    return errors
