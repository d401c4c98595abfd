"""Wide release fit and audit, metadata vectors, signal repair and index audit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.operators import audit, checks, metadata, signals, tabular


def release(spark, leak=False):
    """One record per fold, a gap in fold 0, repeat records in folds 18 and 19."""
    rows = []
    for f in range(20):
        rows.append((1000 + f, 5000 + f, f, 0, 900 + f, None if f == 0 else 1.0 + f, f % 2, int(f % 5 == 0), -999 if f == 3 else f % 2))
    for f in (18, 19):
        rows.append((1000 + f, 6000 + f, f, 1, 900 + f, 99.0, 1, 0, 1))
    if leak:
        rows.append((1000, 7000, 19, 0, 999, 1.0, 1, 0, 1))
    df = spark.createDataFrame(
        rows,
        "general_subject_id long, general_study_id long, general_strat_fold int, general_ecg_no_within_stay int, general_ed_stay_id long,"
        " labvalues_creatinine double, diagnoses_a int, diagnoses_b int, deterioration_a int",
    )
    hot = F.col("general_study_id") % 5
    for i, e in enumerate(["asian", "black", "hispanic", "other", "white"]):
        df = df.withColumn(f"demographics_ethnicity_{e}", (hot == i).cast("double"))
    return df.withColumn("demographics_gender", (F.col("general_study_id") % 2).cast("double")).withColumn("general_data", F.lit(0))


def test_fit_and_transform(spark):
    df = release(spark)
    spec = tabular.fit_table(df, {"diagnoses": 2, "deterioration": 1, "features": 7})
    assert spec.inputs[-1] == "demographics_ethnicity" and spec.masks == ["labvalues_creatinine_nan"]
    assert spec.medians["labvalues_creatinine"] == np.median([1.0 + f for f in range(1, 18)])
    assert spec.categories["demographics_ethnicity"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert "labvalues_creatinine" not in spec.categories
    out = tabular.transform_table(df, spec).orderBy("study_id").collect()
    assert len(out) == 20
    assert out[0]["cont"] == [pytest.approx(spec.medians["labvalues_creatinine"]), 1.0]
    bad = tabular.transform_table(df, spec, "deterioration").orderBy("study_id").collect()
    assert bad[3]["labels"] == [None] and bad[1]["labels"] == [1.0]


def test_unseen_category_is_an_error(spark):
    df = release(spark)
    spec = tabular.fit_table(df)
    odd = df.withColumn("demographics_gender", F.lit(7.0))
    with pytest.raises(Exception, match="unseen categorical"):
        tabular.transform_table(odd, spec).collect()


def test_header_counts_are_enforced(spark):
    with pytest.raises(checks.AuditError):
        tabular.column_roles(release(spark).columns, {"diagnoses": 3})
    with pytest.raises(checks.AuditError):
        tabular.column_roles(["general_data"])


def test_release_audit_finds_leaks(spark):
    clean = audit.release_findings(release(spark), list(range(20)))
    checks.enforce(clean)
    with pytest.raises(checks.AuditError, match="subject in several folds"):
        checks.enforce(audit.release_findings(release(spark, leak=True), list(range(20))))
    with pytest.raises(checks.AuditError, match="fold set differs"):
        checks.enforce(audit.release_findings(release(spark), list(range(21))))
    totals = tabular.release_totals(release(spark)).first()
    assert (totals["rows"], totals["patients"], totals["visits"]) == (22, 20, 20)


def test_metadata_vectors(spark):
    df = spark.createDataFrame(
        [("10,5", "Sim", "b", "x, y"), ("nao", "", "a", "0"), ("1O", "NAO", "b", ""), ("12", "sim ", "a", "y,x,x")],
        "age string, diabetes string, eye string, other string",
    )
    fields = metadata.MetaFields(("age",), ("diabetes", "eye"), ("diabetes",), "other")
    schema = metadata.fit_metadata(df, fields, 2)
    assert schema.vocab["diabetes"] == ["<missing>", "<unknown>", "nao", "sim"] and schema.tokens == ["x", "y"]
    rows = [r["meta"] for r in metadata.vectorize(df, fields, schema).collect()]
    names = metadata.vector_names(fields, schema)
    get = lambda i, n: rows[i][names.index(n)]
    assert get(1, "age:missing") == 1 and get(1, "age") == 0 and get(1, "diabetes=<missing>") == 1
    assert get(0, "diabetes=sim") == 1 and get(0, "(no token)") == 0 and get(2, "(no token)") == 1
    unseen = spark.createDataFrame([("1", "zzz", "b", "")], df.schema)
    vec = metadata.vectorize(unseen, fields, schema).first()["meta"]
    assert vec[names.index("diabetes=<unknown>")] == 1
    with pytest.raises(Exception, match="unsupported numeric"):
        metadata.numeric_stats(spark.createDataFrame([("abc",)], "age string"), ("age",)).collect()


def test_repair_matches_interpolation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 2)) * 2
    x[0, 0] = np.nan
    x[7, 1] = np.nan
    rows = [(1, "I" if c == 0 else "II", t, None if np.isnan(x[t, c]) else float(x[t, c])) for t in range(20) for c in range(2)]
    rows += [(1, "V1", t, None) for t in range(20)]
    sig = spark.createDataFrame(rows, "study_id long, lead string, t int, mv double")
    out = signals.repair(sig).toPandas()
    assert out["repaired"].sum() == 22 and out["mv"].abs().max() <= 3
    for c, lead in enumerate(("I", "II")):
        ok = ~np.isnan(x[:, c])
        want = np.clip(np.interp(np.arange(20), np.flatnonzero(ok), x[ok, c]), -3, 3)
        got = out[out["lead"] == lead].sort_values("t")["mv"].to_numpy()
        assert np.allclose(got, want)
    assert (out[out["lead"] == "V1"]["mv"] == 0).all()
    half = signals.resample(signals.repair(sig), 200, 100)
    assert half.filter("lead = 'I'").count() == 10
    packed = {r["lead_index"]: r["mv"] for r in signals.packed(signals.repair(sig), 24).collect()}
    assert len(packed) == 12 and packed[1][20:] == [0.0] * 4 and packed[5] == [0.0] * 24


def test_index_audit(spark):
    files = spark.createDataFrame([(0, 30)], "file_id int, file_length long")
    good = spark.createDataFrame([(0, 0, 0, 10), (1, 0, 10, 10), (2, 0, 20, 10)], "record_id long, file_id int, start long, length long")
    checks.enforce(signals.index_findings(good, files, 10))
    bad = spark.createDataFrame([(0, 0, 0, 10), (1, 0, 5, 10), (3, 0, 25, 10)], good.schema)
    found = {r["check"]: r["violations"] for r in signals.index_findings(bad, files, 10).collect()}
    assert found["overlapping ranges"] == 1 and found["range beyond file"] == 1 and found["ids are not a full range"] == 1


def test_repair_across_chunks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    x[rng.random(60) < 0.6] = np.nan
    sig = spark.createDataFrame([(1, "I", t, None if np.isnan(v) else float(v)) for t, v in enumerate(x)], "study_id long, lead string, t int, mv double")
    key = lambda df: [tuple(r) for r in df.orderBy("t").collect()]
    assert key(signals.repair(sig, chunk=4)) == key(signals.repair(sig))
