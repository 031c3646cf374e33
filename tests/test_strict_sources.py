import json

import pytest
from pyspark.errors import PySparkException

from hopsight.schema import TRACE, ContractError
from hopsight.sources import sinks
from hopsight.sources.sessions import read_sessions, session_records, sessions_to_trace, text_records
from hopsight.sources.trace import read_trace, trace_records
from tests import traces
from tests.traces import row

CHECK = {"assessments": [{"sensitiveInformationPolicy": {"piiEntities": []}}]}


def event(**over):
    return {"eventOrder": 1, "sourceNode": "User", "targetNode": "A", "inputText": "in", "guardrailTrace": CHECK, **over}


def session(name="S", **over):
    return {"agentId": "A", "sessionId": name, "traceEvents": [event(**over)]}


def reasons(checked):
    return sorted(r.reason for r in checked.rejects.collect())


def test_bad_csv_cells_raise_or_are_rejected(spark, tmp_path):
    good = traces.frame(spark, [row(i, "User", "A") for i in range(1, 7)]).toPandas()
    text = good.astype(object)
    text.loc[1, "step_id"], text.loc[1, "latency_ms"] = "x", "many"
    text.loc[2, "text_changed"] = "perhaps"
    text.loc[4, "step_id"] = "1.5"
    path = str(tmp_path / "t.csv")
    lines = text.to_csv(index=False).splitlines()
    (tmp_path / "t.csv").write_text("\n".join([*lines, "only,three,cells", ""]))
    checked = trace_records(spark, path, "csv")
    assert checked.accepted.count() + checked.rejects.count() == 7
    assert sorted(r.step_id for r in checked.accepted.collect()) == [1, 4, 6]
    found = {r.reason: r for r in checked.rejects.collect()}
    assert set(found) >= {"step_id is no int; latency_ms is no decimal(18,6)", "text_changed is no boolean", "step_id is no int"}
    assert [r for r in found if r.startswith("malformed line")]
    assert all(r.file.endswith("t.csv") and r.record for r in found.values())
    for use in (lambda t: t.collect(), lambda t: t.count(), lambda t: t.select("workflow_id").collect()):
        with pytest.raises(PySparkException, match="RejectedRecord"):
            use(read_trace(spark, path, "csv"))
    checked.write_rejects(f"{tmp_path}/rejects")
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 4


def test_csv_columns_in_any_order_and_empty_cells(spark, tmp_path):
    good = traces.frame(spark, [row(1, "User", "A"), row(2, "A", "FinalAnswer", confidence=None)])
    order = list(reversed(good.columns))
    good.select(*order).toPandas().to_csv(tmp_path / "t.csv", index=False)
    found = read_trace(spark, str(tmp_path / "t.csv"), "csv")
    assert sorted(map(str, found.select(*good.columns).collect())) == sorted(map(str, good.collect()))


def test_bad_json_lines(spark, tmp_path):
    good = [json.loads(x) for x in traces.frame(spark, [row(i, "User", "A") for i in (1, 2)]).toJSON().collect()]
    bad = [{**good[0], "step_id": "x"}, {**good[0], "step_id": 99999999999}, {**good[0], "text_changed": 7.5}]
    lines = [json.dumps(x) for x in good + bad] + [json.dumps(good[0])[:50], "", "[1]", '"text"']
    (tmp_path / "t.json").write_text("\n".join(lines))
    checked = trace_records(spark, str(tmp_path / "t.json"), "json")
    assert checked.accepted.columns == TRACE.fieldNames() and [f.dataType for f in checked.accepted.schema] == [f.dataType for f in TRACE]
    assert sorted(r.step_id for r in checked.accepted.collect()) == [1, 2]
    assert reasons(checked) == ["malformed JSON"] * 3 + ["step_id is no int"] * 2 + ["text_changed is no boolean"]
    with pytest.raises(PySparkException, match="RejectedRecord"):
        read_trace(spark, str(tmp_path / "t.json"), "json").collect()


def test_parquet_types_are_compared_and_widened(spark, tmp_path):
    df = traces.frame(spark, [row(1, "User", "A"), row(2, "A", "B")])
    wide = df.selectExpr("* EXCEPT (step_id, latency_ms, timestamp)", "CAST(step_id AS BIGINT) AS step_id",
                         "CAST(latency_ms AS DOUBLE) AS latency_ms", "TIMESTAMP '2024-01-01 00:00:00' AS timestamp")
    wide.write.parquet(f"{tmp_path}/wide")
    found = read_trace(spark, f"{tmp_path}/wide")
    assert dict(found.dtypes)["step_id"] == "int" and dict(found.dtypes)["latency_ms"] == "decimal(18,6)"
    assert sorted(r.step_id for r in found.collect()) == [1, 2]
    large = wide.selectExpr("* EXCEPT (step_id)", "step_id + 4000000000 * (step_id - 1) AS step_id")
    large.write.parquet(f"{tmp_path}/large")
    checked = trace_records(spark, f"{tmp_path}/large")
    assert checked.accepted.count() == 1 and reasons(checked) == ["step_id is no int"]
    df.selectExpr("* EXCEPT (step_id)", "CAST(step_id AS STRING) AS step_id").write.parquet(f"{tmp_path}/text")
    with pytest.raises(ContractError, match="step_id"):
        read_trace(spark, f"{tmp_path}/text")
    sinks.write_trace(df, f"{tmp_path}/same")
    assert sorted(map(str, read_trace(spark, f"{tmp_path}/same").collect())) == sorted(map(str, df.collect()))


def test_malformed_sessions_raise_or_are_rejected(spark, tmp_path):
    files = {"good": json.dumps(session()), "cut": json.dumps([session("T"), session("U")])[:-20], "empty": " \n",
             "type": json.dumps(session("V", latencyMs="fast")), "order": json.dumps(session("W", eventOrder="first")),
             "list": json.dumps([session("X"), session("Y")]), "none": "[]", "number": "5", "events": json.dumps({"sessionId": "Z", "traceEvents": [7]})}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    checked = session_records(spark, str(tmp_path))
    assert sorted(r.sessionId for r in checked.accepted.collect()) == ["S", "X", "Y"]
    rejected = {r.file.rsplit("/", 1)[1].removesuffix(".json"): r.reason for r in checked.rejects.collect()}
    assert set(rejected) == {"cut", "empty", "type", "order", "number", "events"}
    assert rejected["empty"] == "no JSON" and rejected["type"].endswith("traceEvents[0]")
    for name in rejected:
        with pytest.raises(PySparkException, match="RejectedRecord"):
            sessions_to_trace(read_sessions(spark, str(tmp_path / f"{name}.json"))).count()
    assert sessions_to_trace(read_sessions(spark, str(tmp_path / "none.json"))).count() == 0
    assert sessions_to_trace(read_sessions(spark, str(tmp_path / "list.json"))).count() == 2


def test_malformed_session_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(session()), json.dumps(session("T"))[:-4], "", json.dumps(session("U"))]))
    checked = session_records(spark, str(tmp_path / "s.jsonl"), multiline=False)
    assert sorted(r.sessionId for r in checked.accepted.collect()) == ["S", "U"] and checked.rejects.count() == 1


def test_numbers_as_text_and_explicit_null_output(spark):
    texts = [json.dumps(session("a", outputText=None)), json.dumps(session("b")), json.dumps(session("c", outputText="in", latencyMs="7.5", usageUnits="2"))]
    checked = text_records(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert checked.rejects.isEmpty()
    found = {r.request_id: r for r in sessions_to_trace(checked.strict()).collect()}
    assert found["a"].text_changed and found["a"].output_text_hash == "e3b0c44298fc"
    assert not found["b"].text_changed and found["b"].output_text_hash == found["b"].input_text_hash == found["c"].output_text_hash
    assert float(found["c"].latency_ms) == 7.5 and float(found["c"].estimated_cost_usd) == 0.00015
