"""Profiles, preflight, reports and readers on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparktab.functions import columns as C
from sparktab.functions.types import is_identifier, leakage_signal
from sparktab.operators import association, distribution, duplicates, features, profile, queue
from sparktab.plans import findings, preflight, report
from sparktab.sources import readers


def wine(spark, broken=False):
    rows = []
    for i in range(72):
        rows.append((f"wine-{i:03d}", 200.0 if i == 20 else 5.2 + (i % 12) * 0.3, None if i in (2, 19, 53) or (broken and i < 25) else 0.3 + (i % 9) * 0.08, ("north", "south", "west")[i % 3], f"2025-{i % 6 + 1:02d}-{i % 27 + 1:02d}", f"group-{i % 8}", (5, 5, 5, 6, 6, 7)[i % 6], "measured"))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "record_id string, acidity double, sulphates double, region string, observed_at string, producer string, quality int, constant_note string")
    return df.withColumn("quality_copy", F.col("quality")) if broken else df


def titles(df, **kw):
    return [f.title for f in findings.make_findings(df, profile.facts(df), **kw)]


def test_findings_fire_together(spark):
    got = titles(wine(spark, True), target="quality", time="observed_at", group="producer")
    for title in ("Repeated observations", "Substantial missingness", "Constant columns", "Possible identifiers", "Potential numeric outliers", "Target class balance", "Columns duplicate the target", "Time coverage", "Group structure"):
        assert title in got
    assert got[0] == "Dataset shape"


def test_pipeline_metadata_is_left_out(spark):
    df = spark.createDataFrame([("a", 0, "d", "train", "x", 10.0, "red", 0), ("b", 1, "d", "test", "y", 10.0, "red", 0), ("c", 0, "e", "train", "x", 11.0, "red", 1), ("d", 1, "f", "test", "y", 12.0, "white", 1)], "_row_id string, _outer_fold int, _duplicate_group string, _ml_partition string, train_split string, measurement double, kind string, quality int")
    facts = profile.facts(df)
    from sparktab.functions.types import role

    roles = {f.name: role(f, "quality") for f in facts}
    assert roles["_row_id"] == "possible identifier"
    assert {roles[c] for c in ("_outer_fold", "_duplicate_group", "_ml_partition", "train_split")} == {"possible pipeline metadata"}
    dup = findings.duplicate_counts(df, facts, roles)
    assert (dup["exact"], dup["repeated"]) == (0, 1)


def test_unique_numbers_are_no_identifiers(spark):
    df = spark.createDataFrame([(f"r{i}", i + i / 100, i % 2) for i in range(24)], "record_id string, continuous_measure double, target int")
    roles = {r["column_name"]: r["role"] for r in profile.profile(df, "target").collect()}
    assert roles["continuous_measure"] == "numeric measure" and roles["record_id"] == "possible identifier"
    assert not is_identifier("continuous_measure", "numeric", 24, 24)


def test_preflight_codes(spark):
    rows = [(f"s{f}{q}{r}", f, f"quality-{q}", 7.0, 0.30, q) for f in (0, 1) for q in (5, 6) for r in (0, 1)]
    df = spark.createDataFrame(rows, "sample_id string, fold int, duplicate_group string, fixed_acidity double, volatile_acidity double, quality int")
    got = preflight.preflight(df, preflight.Request("quality", "a sample", "at bottling", "classification", group="duplicate_group"))["modeling_preflight"]
    codes = {f["code"] for f in got["findings"]}
    assert {"pipeline_metadata_excluded", "substantive_duplicate_observations", "conflicting_labels_for_identical_features", "feature_signatures_cross_groups", "conflicting_labels_cross_groups", "target_dependent_group_assignment", "group_ids_cross_folds"} <= codes
    assert got["included_features"] == ["fixed_acidity", "volatile_acidity"] and got["status"] == "blocked"
    json.dumps(got)


def test_preflight_copy_and_fallback(spark):
    leaky = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "feature int, quality_copy int, quality int")
    got = preflight.preflight(leaky, preflight.Request("quality", "row", "now", "classification"))
    assert "direct_target_copy" in {f["code"] for f in got["modeling_preflight"]["findings"]}
    repeated = spark.createDataFrame([(6.0 + s, 9 + s / 10, s % 2) for _ in range(2) for s in range(6)], "fixed_acidity double, alcohol double, quality int")
    got = preflight.preflight(repeated, preflight.Request("quality", "row", "now"))
    assert "exact_feature_signature_grouping_fallback" in {f["code"] for f in got["modeling_preflight"]["findings"]}
    assert got["split_context"]["feature_signatures"]["n_repeated_rows"] == 12
    with pytest.raises(readers.InputError):
        preflight.preflight(leaky, preflight.Request("nothing", "row", "now"))


def test_report_is_deterministic_and_self_contained(spark, tmp_path):
    df = wine(spark)
    one, two, other = (report.render(df, "Wine", target="quality", time="observed_at", group="producer", seed=s, sample_rows=31)[0] for s in (7, 7, 8))
    assert one == two and one != other
    assert "http://" not in one and "https://" not in one and "<script" not in one
    path = tmp_path / "deep" / "report.html"
    assert "**Dataset shape**" in report.write(df, str(path), "Wine", target="quality")
    assert os.listdir(path.parent) == ["report.html"]
    with pytest.raises(readers.InputError):
        report.render(df, "Wine", target="nothing")


def test_delimited_scan(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a;b;c\n1;NA;True\n2;;False\n;x;TRUE\n")
    df = readers.scan(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "boolean"}
    assert [r["b"] for r in df.collect()] == [None, None, "x"]
    with pytest.raises(readers.InputError):
        readers.scan(spark, str(tmp_path / "a.xlsx"))
    assert len(readers.fingerprint(str(path))) == 64


def test_edges(spark):
    empty = spark.createDataFrame([], "x double, g string")
    assert profile.facts(empty)[0].rows == 0
    assert distribution.histogram(empty, "x").count() == 0
    assert association.eta_squared(empty, "g", "x").first()["eta_squared"] == 0
    odd = spark.createDataFrame([(float("nan"), "a"), (float("inf"), None), (1.0, "a"), (None, "b"), (1.0, "a")], "x double, g string")
    s = profile.numeric_summary(C.nan_to_null(odd), ["x"]).first()
    assert (s["n_finite"], s["n_infinite"], s["std"], s["outliers_iqr"]) == (2, 1, 0.0, 0)
    assert duplicates.duplicate_rows(C.nan_to_null(odd)).first()["n_repeated"] == 1
    assert distribution.histogram(C.nan_to_null(odd), "x").collect()[0]["bin_start"] == 0.5
    assert queue.robust_zscore(odd.where("x = 1"), "x").first()["robust_z"] is None


def test_lags_start_at_one(spark):
    with pytest.raises(ValueError):
        features.lag_features(spark.range(1), "id", "id", "id", "id", [0])
    assert leakage_signal("final_score", "quality") and not leakage_signal("acidity", "quality")


def codes(report):
    return {f["code"] for f in report["modeling_preflight"]["findings"]}


def test_every_class_and_partition_is_audited(spark):
    rows = [(i, f"c{i % 150:03d}", f"p{i // 300:04d}") for i in range(1200 * 300)]
    df = spark.createDataFrame(rows, "x long, kind string, fold string").where("NOT (fold = 'p1199' AND kind = 'c149')")
    got = preflight.preflight(df, preflight.Request("kind", "row", "now", "classification"))
    assert len(got["target"]["class_counts"]) == 150
    parts = got["split_context"]["folds"][0]["partitions"]
    assert len(parts) == 1200 and [p["value"] for p in parts if p["missing_classes"]] == ["p1199"]
    assert "fold_missing_classes" in codes(got) and "fold_low_class_support" not in codes(got)


def test_copies_go_by_value(spark):
    rows = [(i * 1e30, 1e-13 if i % 2 else 2e-13, float(i), i % 2 == 1, str(float(i)), float(i)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "huge double, tiny double, same double, flag boolean, words string, y double")
    got = {r["column_name"]: r["is_copy"] for r in association.target_copies(df, "y").collect()}
    assert got == {"huge": False, "tiny": False, "same": True, "flag": False, "words": True}
    tiny = df.select("tiny", F.reverse("words").alias("other"), (F.col("tiny") * 3).alias("z"))
    assert [r["is_copy"] for r in association.target_copies(tiny, "z", ["tiny"]).collect()] == [False]
    report_ = preflight.preflight(df.select("same", "huge", "y"), preflight.Request("y", "row", "now", "regression"))
    near = [f for f in report_["modeling_preflight"]["findings"] if f["code"] == "near_perfect_target_association"]
    assert {"direct_target_copy", "near_perfect_target_association"} <= codes(report_) and near[0]["columns"] == ["same", "huge"]
    flags = spark.createDataFrame([(i % 2 == 0, i % 2, i) for i in range(8)], "flag boolean, y int, x int")
    assert "near_perfect_target_association" in codes(preflight.preflight(flags, preflight.Request("y", "row", "now")))


def test_named_folds_and_source_order(spark):
    rows = [(f"2025-01-{i + 1:02d}", f"f{i % 2}", i % 4 // 2, i * i % 7) for i in range(12)]
    df = spark.createDataFrame(rows, "day string, group_fold string, y int, x int")
    got = preflight.preflight(df, preflight.Request("y", "row", "now", "classification", group="group_fold", time="day"))
    assert [f["column"] for f in got["split_context"]["folds"]] == ["group_fold"]
    assert got["split_context"]["time"]["monotonic_in_source_order"] is True
    back = df.orderBy(F.desc("day"))
    got = preflight.preflight(back, preflight.Request("y", "row", "now", "classification", time="day"))
    assert got["split_context"]["time"]["monotonic_in_source_order"] is False


def test_exact_repeats_count_where_every_column_is_left_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "record_id string, outer_fold int")
    facts = profile.facts(df)
    from sparktab.functions.types import role

    assert findings.duplicate_counts(df, facts, {f.name: role(f) for f in facts})["repeated"] == 1


def test_quantiles_in_brackets(spark):
    import numpy as np

    from sparktab.operators import ranks

    rng = np.random.default_rng(5)
    for values in (rng.lognormal(size=30_000), np.repeat([1.0, 2.0, 3.0], 9_000), rng.integers(0, 5, 25_000).astype(float), np.array([4.0]), np.array([])):
        df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "x double, g int")
        got = ranks.quantiles(df, {"x": F.col("x")}, [0.0, 0.01, 0.25, 0.5, 0.75, 1.0])["x"]
        want = np.quantile(values, [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]).tolist() if len(values) else [None] * 6
        assert got == pytest.approx(want)
        for r in ranks.grouped_median(df, "g", "x").collect():
            own = values[np.arange(len(values)) % 3 == r["g"]]
            assert r["n"] == len(own) and r["median"] == pytest.approx(float(np.median(own)))


def test_asof_with_a_hot_entity(spark):
    from sparktab.operators import joins

    left = spark.createDataFrame([(("hot" if i % 10 else None if i % 20 else f"e{i % 30}"), i) for i in range(3000)], "e string, t int")
    right = spark.createDataFrame([("hot", i * 7, i if i % 5 else None) for i in range(300)] + [("e0", 40, 1), (None, 5, 9)], "e string, u int, v int")
    for strict in (False, True):
        got = joins.asof_join(left, right, "e", "t", "u", "v", "found", strict).collect()
        known = sorted((u, v) for e, u, v in [(r["e"], r["u"], r["v"] if r["v"] is not None else -1) for r in right.collect()] if e == "hot")
        assert len(got) == 3000
        for r in got:
            if r["e"] == "hot":
                past = [v for u, v in known if u < r["t"] or (u == r["t"] and not strict)]
                want = past[-1] if past and past[-1] >= 0 else None
            else:
                want = 1 if r["e"] == "e0" and (r["t"] > 40 or (r["t"] == 40 and not strict)) else None
            assert r["found"] == want
