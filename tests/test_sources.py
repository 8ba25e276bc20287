"""Sources, sinks and reshaped messages."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonx, messages
from millrace.operators.rules import RuleError
from millrace.sources import artifacts, generate, records, sinks


def test_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a":1}\n\n  \n{"a":2}\n')
    rows = records.read_strict(spark, str(good)).orderBy("nth").collect()
    assert [r.record for r in rows] == ['{"a":1}', '{"a":2}']
    assert records.typed(records.read_strict(spark, str(good)), "a long").agg(F.sum("a")).first()[0] == 3
    (tmp_path / "lines.jsonl").write_text('{"a":1}\n{"a":2}\n')
    assert records.line_digests(spark, str(tmp_path / "lines.jsonl")).where(F.col("digest") == F.sha2(F.lit('{"a":1}\n'), 256)).count() == 1
    for i, (bad, why) in enumerate([('{"a":1}\n[1]\n', "no object"), ('{"a":1,"a":2}\n', "twice"), ("{\n", "no JSON"), ("\n", "no records")]):
        p = tmp_path / f"bad{i}.jsonl"
        p.write_text(bad)
        with pytest.raises(RuleError, match=why):
            records.read_strict(spark, str(p))
    assert records.read_lax(spark, str(tmp_path / "bad0.jsonl")).where("problem IS NOT NULL").count() == 1


def test_strict_lines_are_numbered_and_ended(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('\n{"a":1}\n\n{"a":2}\n[3]\n{"a":4}\n')
    with pytest.raises(RuleError, match=r"n\.jsonl:5: no object"):
        records.read_strict(spark, str(tmp_path / "n.jsonl"))
    for name, text, why in (("open.jsonl", '{"a":1}\n{"a":2}', "no line feed"), ("blank.jsonl", '{"a":1}\n\n{"a":2}\n', "blank line")):
        (tmp_path / name).write_text(text)
        with pytest.raises(RuleError, match=why):
            records.line_digests(spark, str(tmp_path / name))
    (tmp_path / "crlf.jsonl").write_bytes(b'{"a":1}\r\n{"a":2}\r\n')
    assert records.ends(spark, str(tmp_path / "crlf.jsonl")).count() == 0


def test_manifests_as_text(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "z")], "k string, record string")
    text = sinks.manifest_text(df, "k", F.col("record"))
    assert text.endswith("}\n") and list(json.loads(text)) == ["a", "b"] and json.loads(text)["a"]["n"] == 2 and '\n  "a": {\n    "digest"' in text


def test_pins_and_runs(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# c\nNumPy==1.0\nb==2\nnumpy==1.1\nx>=3\n")
    found = records.pins(spark, str(tmp_path / "r.txt"))
    assert {(r.name, r.version) for r in found.collect()} == {("numpy", "1.1"), ("b", "2")}
    want = spark.createDataFrame([("numpy", "1.1"), ("b", "3"), ("z", "1")], "name string, version string")
    assert {(r.name, r.problem) for r in records.pin_problems(found, want).collect()} == {("b", "another version"), ("z", "missing")}
    for d in ("p1-t0", "p1-t1", "other"):
        (tmp_path / "runs" / d).mkdir(parents=True)
        (tmp_path / "runs" / d / "out.jsonl").write_text('{"ok":true}\n')
    got = records.runs(spark, str(tmp_path / "runs"), r"/(p[0-9]+)-t([0-9]+)/[^/]+$", "prompt", "trial")
    assert {(r.prompt, r.trial) for r in got.collect()} == {("p1", "0"), ("p1", "1")}


def test_artifacts(spark, tmp_path):
    root = tmp_path / "a"
    (root / "sub").mkdir(parents=True)
    (root / "x.txt").write_text("x")
    (root / "sub" / "y.txt").write_text("y")
    found = artifacts.inventory(spark, str(root))
    by = {r.name: r.sha256 for r in found.collect()}
    assert set(by) == {"x.txt", "sub/y.txt"}
    recorded = spark.createDataFrame([("x.txt", "0"), ("gone", "1")], "name string, sha256 string")
    assert {(r.name, r.problem) for r in artifacts.inventory_problems(found, recorded).collect()} == {("x.txt", "changed"), ("gone", "missing"), ("sub/y.txt", "not recorded")}
    bound = spark.createDataFrame([("o", "x.txt", by["x.txt"]), ("o", "../x.txt", "1"), ("o", "no", "1"), ("p", "x.txt", "1")], "owner string, path string, sha256 string")
    assert {(r.path, r.problem) for r in artifacts.binding_problems(bound, found).collect()} == {("../x.txt", "path leaves the root"), ("no", "no such file"), ("x.txt", "digest differs")}
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        for name in ("a.json", "b.json"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"{}"))
    (tmp_path / "u.tgz").write_bytes(b"no archive")
    got = artifacts.members(artifacts.files(spark, str(tmp_path), "*.tgz"))
    assert sorted(r.member for r in got.where("kind = 'file'").collect()) == ["a.json", "b.json"]
    assert [r.problem for r in artifacts.member_problems(got, ["a.json", "b.json"]).collect()] == ["broken archive: ReadError"]
    assert artifacts.member_problems(got, ["a.json"]).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"b": 1.50, "a": "é"}'), (2, "{}")], "k long, record string")
    sinks.write_lines(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"é","b":1.5}', "{}"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_lines(df, str(tmp_path / "out"))
    assert sinks.publish(df, str(tmp_path / "t")) == {"rows": 2}
    assert tuple(sinks.stale(df, str(tmp_path / "t")).first()) == (0, 0)
    assert tuple(sinks.stale(df.where("k = 1"), str(tmp_path / "t")).first()) == (0, 1)
    a, b = sinks.manifest(df, "k", F.col("record")), sinks.manifest(df.repartition(3), "k", F.col("record"))
    assert sorted(a.collect()) == sorted(b.collect())
    s = sinks.report(df.where("k = 2"), F.lit("Two"), {"record": F.col("record")}, F.array(F.lit("a"), F.lit("b"))).first().section
    assert s == "## Two\n\n- record: {}\n- flow: a → b\n"


def test_messages(spark):
    t = generate.traces(generate.cases(spark, 1)).where("trace_id LIKE '%title-lookup%'")
    m = t.select(messages.training_conversation(F.col("trace")).alias("m")).first().m
    assert [x.role for x in m] == ["system", "user", "assistant", "tool", "assistant"]
    assert m[2].content == "" and m[2].tool_calls[0].arguments == '{"query":"Title 0"}' and m[3].tool_call_id == "call-1" and json.loads(m[3].content)["candidates"]
    c = json.loads(t.select(messages.compact(F.col("trace")).alias("c")).first().c)
    assert c["axis"] == "title-lookup" and len(c["messages"]) == 3
    bad = spark.createDataFrame([('{"messages":[{"role":"judge","content":"x"}]}',)], "trace string")
    with pytest.raises(Exception, match="unknown role"):
        bad.select(messages.training_conversation(F.col("trace"))).collect()


def test_tagged_turns(spark):
    call = "<think>hm</think>\n<tool_call>\n<function=catalog_search>\n<parameter=query>\nA \"b\"\n</parameter>\n<parameter=runtime_min>\n90\n</parameter>\n</function>\n</tool_call>"
    rows = [(1, call), (2, "plain <b>"), (3, call.replace("</parameter>\n<parameter", "</parameter>\nstray<parameter")), (4, call.replace("runtime_min", "query")), (5, "<tool_call><function=f></function></tool_call>")]
    got = {r.n: json.loads(r.t) for r in spark.createDataFrame(rows, "n long, raw string").select("n", messages.tagged_turn(F.col("raw"), F.col("n")).alias("t")).collect()}
    assert got[1]["toolCalls"] == [{"id": "model-call-1", "name": "catalog_search", "arguments": {"query": 'A "b"', "runtime_min": 90}}]
    assert got[2]["content"] == "plain <b>" and all("content" in got[i] for i in (3, 4, 5))


def test_leaves_and_denylist(spark):
    rec = json.dumps({"id": "secret phrase here", "n": [{"intent": "Keep  This Long Text"}], "inner": json.dumps({"intent": "nested value text"}), "x": 1})
    df = spark.createDataFrame([(rec,), ("[",)], "record string")
    got = df.select(F.explode(jsonx.json_leaves(F.col("record"), ["intent"])).alias("l")).select("l.*").collect()
    assert {(r.value, r.protected) for r in got} >= {("secret phrase here", False), ("Keep  This Long Text", True), ("nested value text", True)}
    d = generate.denylist(df, ["intent"], 5)
    assert d.count() == 4 and d.where(F.col("digest") == F.sha2(F.lit("keep this long text"), 256)).count() == 1
    assert json.loads(df.limit(1).select(jsonx.masked(F.col("record"), ["id"], "#").alias("m")).first().m)["id"] == "#"


def test_wire_forms_round_trip(spark):
    t = generate.traces(generate.cases(spark, 1)).where("trace_id LIKE '%title-lookup%'")
    m = F.explode(F.try_variant_get(F.try_parse_json("trace"), "$.messages", "array<variant>"))
    for as_text in (True, False):
        sent = [json.loads(r.w) for r in t.select(m.alias("m")).select(messages.wire(F.col("m"), as_text).alias("w")).collect()]
        args = sent[2]["tool_calls"][0]["function"]["arguments"]
        assert (json.loads(args) if as_text else args) == {"query": "Title 0"}
        assert sent[3]["role"] == "tool" and ("tool_call_id" in sent[3]) is as_text
        back = spark.createDataFrame([(json.dumps(sent[2]),), (json.dumps(sent[4]),)], "s string").select(messages.endpoint_turn(F.col("s"), F.lit(1)).alias("t")).collect()
        assert json.loads(back[0].t)["toolCalls"][0] == {"id": "call-1" if as_text else "model-call-1", "name": "catalog_search", "arguments": {"query": "Title 0"}}
        assert json.loads(back[1].t)["content"].startswith("{")
    broken = {"tool_calls": [{"function": {"name": "f", "arguments": "{"}}, {"function": {"name": "g", "arguments": "{}"}}]}
    got = json.loads(spark.createDataFrame([(json.dumps(broken),)], "s string").select(messages.endpoint_turn(F.col("s"), F.lit(2)).alias("t")).first().t)
    assert [(c["id"], c["arguments"]) for c in got["toolCalls"]] == [("model-call-2", "{"), ("model-call-2-1", {})]
