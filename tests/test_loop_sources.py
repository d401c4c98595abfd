"""Round state machine, sources and sinks on temporary folders."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from poolweave.operators import checks, resolution, selection
from poolweave.plans import loop
from poolweave.session import scratch_path
from poolweave.sources import sinks, tables


@pytest.mark.parametrize("size,want", [(7181, [718, 1077, 1436]), (10, [1, 2, 2]), (100, [10, 15, 20])])
def test_schedule(size, want):
    if want[1] == want[2]:
        with pytest.raises(ValueError):
            loop.label_targets(size, 3)
    else:
        assert loop.label_targets(size, 3) == want


def setup(spark, seed=17):
    pool = spark.range(100).select("id")
    metric = lambda labeled, n: labeled.agg(F.count("*").cast("double").alias("value")).select(F.lit("n").alias("metric"), "value")
    pick = lambda c, lab, b, n: selection.random_selection(c, b, seed, n)
    return pool, pick, metric


def test_run_resume_and_refusals(spark):
    pool, pick, metric = setup(spark)
    s = loop.RunSettings("r", "random", 17, (10, 15, 20))
    state = loop.RunState(spark, scratch_path(spark, "loop"))
    full = loop.run_rounds(state, s, pool, pick, metric)
    assert full.count() == 20 and full.select("id").distinct().count() == 20
    assert {r["round"]: r["value"] for r in state.metrics("r").collect()} == {0: 10.0, 1: 15.0, 2: 20.0}

    calls = []
    part = loop.RunState(spark, scratch_path(spark, "loop"))
    for n in range(2):
        ids = full.filter(F.col("round") == n).select("id")
        part.write_round(s, n, ids, "query" if n else "initial", metric(ids, n))

    def counted(*a):
        calls.append(a[3])
        return pick(*a)

    resumed = loop.run_rounds(part, s, pool, counted, metric)
    assert calls == [2]
    assert {r["id"] for r in resumed.collect()} == {r["id"] for r in full.collect()}

    for wrong, text in (
        (loop.RunSettings("r", "other", 17, (10, 15, 20)), "strategy"),
        (loop.RunSettings("r", "random", 18, (10, 15, 20)), "seed"),
        (loop.RunSettings("r", "random", 17, (10, 15, 21)), "schedule"),
        (loop.RunSettings("r", "random", 17, (10, 15, 20, 25)), "rounds"),
    ):
        with pytest.raises(ValueError, match=text):
            state.resume(wrong, pool)
    with pytest.raises(ValueError, match="outside the pool"):
        state.resume(s, pool.filter("id > 50"))
    usage = loop.data_usage(pool, full).first()
    assert (usage["initial"], usage["queried"], usage["final"], usage["final_fraction"]) == (10, 10, 20, 0.2)


def test_missing_rows_stop_a_resume(spark):
    pool, _pick, metric = setup(spark)
    s = loop.RunSettings("r", "random", 17, (10, 15))
    state = loop.RunState(spark, scratch_path(spark, "loop"))
    state.write_round(s, 0, pool.limit(9), "initial", metric(pool, 0))
    with pytest.raises(ValueError, match="disagree with the schedule"):
        state.resume(s, pool)


def test_a_bad_method_is_caught(spark):
    pool, _pick, metric = setup(spark)
    s = loop.RunSettings("r", "broken", 17, (10, 15))
    state = loop.RunState(spark, scratch_path(spark, "loop"))
    with pytest.raises(checks.AuditError, match="budget differs"):
        loop.run_rounds(state, s, pool, lambda c, lab, b, n: selection.random_selection(c, b + 1, 1), metric)


def test_csv_codes_keep_zeros_and_missing_columns_fail(spark, tmp_path):
    (tmp_path / "d.csv").write_text("HADM_ID,ICD9_CODE,EXTRA,SEQ_NUM,SUBJECT_ID\n1,0031,x,2,9\n")
    row = tables.raw_table(spark, "diagnoses", str(tmp_path / "d.csv")).first()
    assert row["code"] == "0031" and row["seq"] == 2 and row["subject_id"] == 9
    (tmp_path / "e.csv").write_text("HADM_ID\n1\n")
    with pytest.raises(checks.AuditError):
        tables.raw_table(spark, "diagnoses", str(tmp_path / "e.csv"))


def test_notes_are_numbered_in_file_order(spark, tmp_path):
    head = "SUBJECT_ID,HADM_ID,CHARTTIME,ISERROR,CATEGORY,DESCRIPTION,TEXT\n"
    src = tmp_path / "n"
    src.mkdir()
    # The second file is larger, so Spark plans it first.
    (src / "a.csv").write_text(head + '1,1,,,c,d,"x\ny"\n1,2,,,c,d,z\n')
    (src / "b.csv").write_text(head + "".join(f"1,{3 + i},,,c,d,{'w' * 200}\n" for i in range(20)))
    out = tables.numbered_notes(spark, str(src), str(tmp_path / "out"))
    assert [r["hadm_id"] for r in out.orderBy("source_row").collect()] == list(range(1, 23))
    assert out.orderBy("source_row").first()["text"] == "x\ny"


def test_small_sources(spark, tmp_path):
    (tmp_path / "list.csv").write_text("10,1\n11,0\n")
    from poolweave.operators.cohort import subject_list

    assert [r[0] for r in subject_list(tables.subject_file(spark, str(tmp_path / "list.csv"))).collect()] == [10]
    (tmp_path / "map.csv").write_text(
        "LEVEL2,ITEMID,COUNT,STATUS,MIMIC LABEL\nHeart Rate,1,5,ready,HR\n,2,5,ready,x\npH,3,0,ready,x\npH,4,2,draft,x\n"
    )
    assert [tuple(r) for r in tables.item_map_file(spark, str(tmp_path / "map.csv")).collect()] == [(1, "Heart Rate", "HR")]
    (tmp_path / "g.json").write_text('{"grp":"A","group_id":1,"use_flag":true,"codes":["1","2"]}\n{"grp":"B","group_id":1,"use_flag":true,"codes":["3"]}\n')
    with pytest.raises(checks.AuditError):
        tables.group_definitions(spark, str(tmp_path / "g.json"))
    for name in ("a.jpg", "b.jpg", "c.png"):
        (tmp_path / name).write_bytes(b"x")
    assert {r[0] for r in tables.file_stems(spark, str(tmp_path)).collect()} == {"a", "b"}
    folder = tmp_path / "files" / "p12" / "s34"
    folder.mkdir(parents=True)
    (folder / "r.hea").write_text("x")
    rec = tables.records_from_folder(spark, str(tmp_path / "files")).first()
    assert rec["study_id"] == 34 and rec["subject_id"] == 12 and rec["path"].endswith("/r")
    (tmp_path / "rec.csv").write_text("subject_id,study_id,path\n1,2,b\n1,2,a\n")
    from poolweave.operators.signals import first_record

    wanted = spark.createDataFrame([(2,)], "study_id long")
    assert first_record(tables.record_index(spark, str(tmp_path / "rec.csv")), wanted).first()["path"] == "b"


def test_metric_matrix_and_manifests(spark, tmp_path):
    for name, body in (("one", {"strategy": "p", "test": {"recall_at_30": 0.75, "curve": [1]}}), ("two", {"strategy": "q", "val": {"x": 1}})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "final_metrics.json").write_text(json.dumps(body))
    runs = tables.experiment_metrics(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    table = resolution.metric_matrix(runs)
    assert table.columns == ["experiment", "strategy", "test.recall_at_30", "val.x"]
    rows = {r["experiment"]: r["test.recall_at_30"] for r in table.collect()}
    assert rows == {"one": 0.75, "two": None}
    for suffix in ("m.csv", "m.json"):
        sinks.write_metric_matrix(runs, str(tmp_path / suffix))
        with pytest.raises(AnalysisException):
            sinks.write_metric_matrix(runs, str(tmp_path / suffix))
    m = sinks.run_manifest(spark, "t", None, {"a": "1"}, folder=str(tmp_path)).first()
    assert m["schema_version"] == 1 and m["method"] is None and m["settings"] == {"a": "1"}
    assert sinks.run_manifest(spark, "t", "m", {}).first()["settings"] == {}
