import math

import pytest

from flowcascade.sources import (
    infer_numeric,
    normalize_columns,
    read_flow_text,
    read_flows,
    stage_clean_flows,
    write_report,
)


def write(tmp_path, text, name="flows.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_padded_names_pruning_and_file_order(spark, tmp_path):
    path = write(tmp_path, " Label,Flow ID, Flow Duration,Protocol\nSyn,x,1.5,6\n")
    df = read_flows(spark, path)
    assert df.columns == ["Label", "FlowDuration", "Protocol"]
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "double", "double"]
    assert df.first().asDict() == {"Label": "Syn", "FlowDuration": 1.5, "Protocol": 6.0}


def test_only_wanted_columns_are_scanned(spark, tmp_path):
    path = write(tmp_path, "junk,FlowDuration,Label\nz,1,Syn\n")
    plan = read_flow_text(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "junk" not in plan.split("ReadSchema")[1]


def test_long_and_short_lines(spark, tmp_path):
    path = write(tmp_path, "FlowDuration,FwdIATMean,Label\n1,2,Syn,9\n3,4\n5,6,UDP\n")
    rows = sorted(read_flows(spark, path).collect())
    assert [tuple(r) for r in rows] == [(1.0, 2.0, "Syn"), (3.0, 4.0, None), (5.0, 6.0, "UDP")]
    kept = stage_clean_flows(spark, path)
    assert sorted(r["Label"] for r in kept.collect()) == ["Syn", "UDP"]


def test_missing_texts_and_infinities(spark, tmp_path):
    body = "".join(f"{v},L{i}\n" for i, v in enumerate(
        ["inf", "Infinity", "-inf", "NaN", "", "NA", "null", "7"]))
    df = read_flows(spark, write(tmp_path, "FlowDuration,Label\n" + body))
    values = {r["Label"]: r["FlowDuration"] for r in df.collect()}
    assert values["L0"] == values["L1"] == math.inf and values["L2"] == -math.inf
    assert [values[f"L{i}"] for i in (3, 4, 5, 6)] == [None] * 4
    assert values["L7"] == 7.0


def test_text_makes_a_column_text(spark, tmp_path):
    path = write(tmp_path, "FlowDuration,FwdIATMean,FwdIATStd,Timestamp,Label\n"
                           "1,abc,1d,5,Syn\n2,3,4,6,UDP\n")
    text = read_flow_text(spark, path)
    assert infer_numeric(text) == ["FlowDuration", "Timestamp"]
    staged = stage_clean_flows(spark, path)
    types = dict(staged.dtypes)
    assert types["FwdIATMean"] == types["FwdIATStd"] == "string"
    assert types["FlowDuration"] == types["Timestamp"] == "double"
    assert staged.count() == 2


def test_staged_flows_are_typed_before_dedup(spark, tmp_path):
    path = write(tmp_path, "FlowDuration,Timestamp,Label\n1,t,Syn\n1.0,t,Syn\n,t,Syn\n")
    staged = stage_clean_flows(spark, path)
    assert [tuple(r) for r in staged.collect()] == [(1.0, "t", "Syn")]
    given = stage_clean_flows(spark, path, numeric=["FlowDuration"])
    assert given.collect() == staged.collect()


def test_numeric_label(spark, tmp_path):
    path = write(tmp_path, "FlowDuration,Timestamp,Label\n1,t,3\n2,t,4\n")
    assert dict(stage_clean_flows(spark, path).dtypes)["Label"] == "double"


def test_repeated_and_blank_header_names(spark, tmp_path):
    path = write(tmp_path, "FwdHeaderLength,,FwdHeaderLength,Label\n1,2,3,Syn\n")
    df = read_flows(spark, path)
    assert df.columns == ["FwdHeaderLength", "Label"]
    assert df.first()["FwdHeaderLength"] == 1.0


def test_made_up_names_still_check_every_header(spark, tmp_path):
    folder = tmp_path / "twins"
    folder.mkdir()
    write(folder, "x,x,Flow Duration,Fwd IAT Mean,Label\n0,0,1,2,Syn\n", "a.csv")
    write(folder, "x,x,Flow Duration,Fwd IAT Mean,Label\n0,0,3,4,Syn\n", "b.csv")
    assert read_flows(spark, str(folder)).count() == 2
    write(folder, "x,x,Fwd IAT Mean,Flow Duration,Label\n0,0,5,6,Syn\n", "c.csv")
    with pytest.raises(ValueError, match="header"):
        read_flows(spark, str(folder))


def test_kept_ids_stay_text(spark, tmp_path):
    path = write(tmp_path, "Flow ID,FlowDuration,Label\n9007199254740993,1,Syn\n"
                           "9007199254740992,1,Syn\n,2,UDP\n")
    rows = read_flows(spark, path, keep=["FlowID"]).collect()
    assert {r["FlowID"] for r in rows} == {"9007199254740993", "9007199254740992", None}
    staged = stage_clean_flows(spark, path, keep=["FlowID"])
    assert dict(staged.dtypes) == {"FlowID": "string", "FlowDuration": "double",
                                   "Label": "string"}
    assert staged.count() == 3


def test_label_fallback(spark, tmp_path):
    path = write(tmp_path, "FlowDuration,Attack Label\n1,Syn\n")
    assert read_flows(spark, path).columns == ["FlowDuration", "AttackLabel"]


def test_header_only_and_unreadable(spark, tmp_path):
    empty = read_flows(spark, write(tmp_path, "FlowDuration,Label\n"))
    assert empty.columns == ["FlowDuration", "Label"] and empty.count() == 0
    assert stage_clean_flows(spark, str(tmp_path / "flows.csv")).count() == 0
    with pytest.raises(Exception):
        read_flows(spark, str(tmp_path / "none.csv"))
    assert read_flows(spark, str(tmp_path / "none.csv"), on_error="empty").columns == []
    with pytest.raises(ValueError, match="no wanted column"):
        read_flows(spark, write(tmp_path, "a,b\n1,2\n", "other.csv"))


def test_folder_of_files_checks_every_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, "FlowDuration,Label\n1,Syn\n", "a.csv")
    write(folder, "FlowDuration,Label\n2,UDP\n", "b.csv")
    assert read_flows(spark, str(folder)).count() == 2
    write(folder, "Label,FlowDuration\nUDP,3\n", "c.csv")
    with pytest.raises(Exception, match="(?i)header"):
        read_flows(spark, str(folder), numeric=["FlowDuration"]).collect()


def test_quoted_fields(spark, tmp_path):
    path = write(tmp_path, 'FlowDuration,Timestamp,Label\n1,"a, ""b""",Syn\n')
    assert read_flows(spark, path).first()["Timestamp"] == 'a, "b"'


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Flow Duration", "x", "FlowDuration"])
    out = normalize_columns(df)
    assert out.columns == ["x", "FlowDuration"]
    assert tuple(out.first()) == (2, 3)


def test_report_sink(spark, tmp_path):
    report = spark.createDataFrame([("a", 0.5, 1.0)], "class string, f1 double, support double")
    write_report(report, str(tmp_path / "report"))
    lines = [p.read_text() for p in (tmp_path / "report").glob("*.csv")]
    assert lines == ["class,f1-score,support\na,0.5,1.0\n"]
