"""Command lines: streams, exits and files."""

import json
import os

import pytest

from sparktab.__main__ import main
from sparktab.plans import contract


@pytest.fixture
def wine(tmp_path):
    path = tmp_path / "wine.csv"
    rows = [f"s{i},{5.2 + i % 7 / 10:.1f},{i % 2},2025-01-{i % 27 + 1:02d}" for i in range(40)]
    path.write_text("sample_id,acidity,quality,day\n" + "\n".join(rows) + "\n")
    return str(path)


def test_eda(spark, wine, tmp_path, capsys):
    out = tmp_path / "new" / "report.html"
    assert main(["eda", "--input", wine, "--output", str(out), "--target", "quality", "--time-column", "day"], spark) == 0
    said = capsys.readouterr().out
    assert said.startswith("## EDA findings\n\n- **Dataset shape** (Info) — 40 rows") and "**Time coverage**" in said
    assert os.listdir(out.parent) == ["report.html"]


@pytest.mark.parametrize("change", [{"--input": "s3://bucket/a.csv"}, {"--input": "no.csv"}, {"--output": "a.txt"}, {"--target": "nothing"}, {"--max-plot-rows": "0"}])
def test_eda_errors_write_nothing(spark, wine, tmp_path, capsys, change):
    out = tmp_path / "report.html"
    options = {"--input": wine, "--output": str(out), "--target": "quality"} | change
    assert main(["eda", *(x for pair in options.items() for x in pair)], spark) == 2
    said = capsys.readouterr()
    assert said.out == "" and "error" in json.loads(said.err) and not out.exists()


def test_preflight(spark, wine, capsys):
    asks = ["preflight", wine, "--target", "quality", "--row-grain", "a sample", "--prediction-moment", "at bottling", "--time-column", "day"]
    assert main(asks, spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["problem"]["task"] == "classification" and got["target"]["class_counts"] == {"0": 20, "1": 20}
    assert got["modeling_preflight"]["blocker_count"] == sum(f["severity"] == "blocker" for f in got["modeling_preflight"]["findings"])
    assert main([*asks, "--exclude", "nothing"], spark) == 2
    assert "unknown columns: nothing" in json.loads(capsys.readouterr().err)["error"]


def test_validate(tmp_path, capsys):
    assert main(["validate", str(tmp_path / "none")]) == 2
    (tmp_path / "run.json").write_text("{}")
    assert main(["validate", str(tmp_path)]) == 1
    assert "missing report.html" in capsys.readouterr().out


def test_outputs_are_read_as_csv_and_envelopes(tmp_path):
    table = {"columns": ["id", "x"], "rows": [[1, "a,b"], [2, None]]}
    contract.write_input(str(tmp_path / "in.csv"), table, "csv")
    assert (tmp_path / "in.csv").read_text() == 'id,x\n1,"a,b"\n2,\n'
    assert contract.read_output("id,p\n1,0.5\n", "csv") == [{"id": "1", "p": "0.5"}]
    assert contract.read_output('{"columns": ["id"], "rows": [[3]]}', "json") == [{"id": 3}]
    for text, kind in (("id,id\n1,2\n", "csv"), ("id,p\n1\n", "csv"), ('[{"id": 1, "id": 2}]', "json"), ("3", "json"), ("", "csv")):
        with pytest.raises(ValueError):
            contract.read_output(text, kind)
