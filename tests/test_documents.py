import json

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from taskscope.sources import documents as d
from taskscope.sources import logs, ranges
from taskscope.sources.trace import read_lines


@pytest.fixture
def folder(tmp_path):
    def put(name, doc):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))

    put("s0.reg.json", {"cfg": {"a": 1}, "rcfgs": {"large": list(range(100))}})
    put("tmgr.0000.json", {"uid": "tmgr.0000", "cfg": {}, "tasks": {
        "task.1": {"uid": "task.1", "state": "DONE", "pilot": "pilot.0", "description": {"ranks": 2, "cores_per_rank": 3, "mode": "task.executable"}},
        "task.2": {"uid": "task.2", "state": "NEW", "tmgr": "tmgr.0000", "description": {"ranks": 1}}}})
    put("tmgr.0001.json", {"uid": "tmgr.0001", "tasks": {}})
    put("pmgr.0000.json", {"uid": "pmgr.0000", "pilots": [{
        "uid": "pilot.0", "pmgr": "pmgr.0000", "description": {"resource": "local"},
        "resource_details": {"cores_per_node": 4, "node_list": [{"name": "n0", "index": 5}], "agent_nodes": {"agent.1": {"name": "n9", "index": 9}}}}]})
    return str(tmp_path)


def test_read_session(spark, folder):
    tables = d.read_session(spark, folder, "s0")
    session = tables["session"].head()
    assert (session.uid, json.loads(session.cfg), session.sid) == ("s0", {"a": 1}, "s0")
    assert tuples(tables["task"], "uid", "tmgr", "pilot", "description.ranks") == [
        ("task.1", "tmgr.0000", "pilot.0", 2), ("task.2", "tmgr.0000", None, 1)]
    assert tables["tmgr"].count() == 2
    from taskscope.operators.usage import nodes_of
    assert tuples(nodes_of(tables["pilot"]), "pid", "pos", "node_index", "agent") == [
        ("pilot.0", 0, 5, False), ("pilot.0", 1, 9, True)]


def test_tree(spark, folder):
    nodes, edges = d.entity_tree(d.read_session(spark, folder, "s0"))
    assert {r.uid for r in nodes.collect()} == {"s0", "tmgr.0000", "tmgr.0001", "pmgr.0000", "pilot.0", "task.1"}
    assert tuples(d.children(edges), "parent", "children") == [
        ("pilot.0", ["task.1"]), ("pmgr.0000", ["pilot.0"]), ("s0", ["pmgr.0000", "tmgr.0000", "tmgr.0001"]),
        ("tmgr.0000", ["task.1", "task.2"])]


def test_cache_is_used_and_renewed(spark, folder, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("cache"))
    built = []

    def build():
        built.append(1)
        return d.read_session(spark, folder, "s0")

    for _ in range(2):
        got = d.cached_session(spark, "s0", place, build, ["task", "pilot"], d.source_version(spark, folder))
        assert got["task"].count() == 2
    assert len(built) == 1
    with open(f"{folder}/tmgr.0002.json", "w") as f:
        json.dump({"uid": "tmgr.0002", "tasks": {"task.3": {"uid": "task.3"}}}, f)
    got = d.cached_session(spark, "s0", place, build, ["task"], d.source_version(spark, folder))
    assert len(built) == 2 and got["task"].count() == 3


def test_writing_a_session_keeps_the_others(spark, tmp_path):
    for sid, n in (("s0", 2), ("s1", 3), ("s0", 1)):
        d.write_session({"task": spark.range(n).withColumn("sid", F.lit(sid))}, str(tmp_path))
    got = d.read_tables(spark, str(tmp_path), ["task"])["task"]
    assert {r.sid: r["count"] for r in got.groupBy("sid").count().collect()} == {"s0": 1, "s1": 3}


def test_inventory(spark, folder):
    tables = d.read_session(spark, folder, "s0")
    assert d.session_inventory(tables, "sort").count() == 1 + 2 + 1 + 1 + 2
    keys = d.session_inventory({"task": tables["task"]}, "tree").filter("uid = 'task.2'")
    assert {r.key for r in keys.collect()} == {"uid", "tmgr", "state", "description", "sid"}
    dump = d.session_inventory({"task": tables["task"]}, "dump").filter("uid = 'task.2' and key = 'description'")
    assert json.loads(dump.head().value) == {"ranks": 1}
    with pytest.raises(ValueError):
        d.session_inventory(tables, "other")


def test_task_ids(spark):
    pilots = spark.createDataFrame([("p0",), ("p1",)], "uid string")
    tasks = spark.createDataFrame([("t2", "p0"), ("t1", "p0"), ("t3", None)], "uid string, pilot string")
    assert tuples(d.session_with_task_ids(pilots, tasks)) == [("p0", 0, ["t1", "t2"]), ("p1", 0, [])]


LINES = [
    "x DEBUG : prte output: [batch3:80017] [[33357,0],0] [1565343424.463101] ACTIVATE JOB [33357,24] STATE PENDING ALLOCATION AT a/b.c:497",
    "x DEBUG : prte output: [batch3:80017] [[33357,0],2] [1565343425.5] ACTIVATE PROC [[33357,7],0] STATE RUNNING AT a.c:1",
    "x DEBUG : prte output: [batch3:80017] [[33357,0],0] [1565343426] ACTIVATE JOB NULL STATE NEVER LAUNCHED AT a.c:1",
    "x ACTIVATE without an event", "nothing",
    "x PRTE IDMAP: 33357,24:task.old", "x PRTE IDMAP: 33357,24:task.000024", "x PRTE IDMAP: broken"]


def test_tool_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES))
    lines = read_lines(spark, str(tmp_path), "*.log").withColumn("pid", F.lit("pilot.0000"))
    ids = logs.log_idmap(lines)
    assert tuples(ids) == [("33357,24", "task.000024")]
    events, rejects = logs.log_to_events(lines, ids)
    assert tuples(events, "time", "event", "thread", "uid", "msg") == [
        (1565343424.463101, "prte_pending_allocation", "33357.0.0", "task.000024", "batch3:80017"),
        (1565343425.5, "prte_running", "33357.0.2", "pilot.0000", "batch3:80017"),
        (1565343426.0, "prte_never_launched", "33357.0.0", "pilot.0000", "batch3:80017")]
    assert [r.value for r in rejects.collect()] == ["x ACTIVATE without an event"]


def by_ranges(data, size):
    """Fragments of a document that is read in ranges of `size` bytes."""
    ranges_ = [data[i:i + size] for i in range(0, len(data), size)]
    state, out = (False, False, 0, 0), {}
    for chunk in ranges_:
        batch = ranges.JsonReader.fragments("f", 0, chunk, *state).to_pylist()
        for r in batch:
            old = out.get(r["id"], (None, None, b""))
            out[r["id"]] = (r["depth"] if r["sep"] else old[0], r["sep"] or old[1], old[2] + r["data"])
        in_string, escaped, depth, counts = ranges.summary(chunk)[ranges._WAYS.index(state[:2])]
        cuts = sum(m for k, d, m in counts if state[2] + d <= (1 if k == 0 else 2))
        assert cuts == sum(r["sep"] is not None for r in batch)
        state = (in_string, escaped, state[2] + depth, state[3] + cuts)
    return {k: v for k, v in out.items() if v[1]}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_json_in_ranges_of_any_size(size):
    odd = ['', '\\', '"', '\\"', '{[,', ']}', '\\\\', 'é中', '\n', 'a"b\\\\"c']
    doc = {"uid": "m{\\\"", "cfg": {"a": [1, {"b": odd}], odd[5]: odd[3]}, "n": 3,
           "tasks": {f"t{i}{x}": {"uid": x, "l": [x, [x], {}], "e": {}} for i, x in enumerate(odd)}, "pilots": [{"x": [1, 2]}, [], 5], "z": []}
    for text in (json.dumps(doc), json.dumps(doc, indent=2, ensure_ascii=False)):
        got = by_ranges(text.encode(), size)
        assert got == by_ranges(text.encode(), 1 << 20)
        inner = [v[2].decode() for _, v in sorted(got.items()) if v[0] == 2 and v[2].strip()]
        want = [json.dumps({k: x}) for key in ("cfg", "tasks") for k, x in doc[key].items()] + [json.dumps(x) for x in doc["pilots"]]
        shown = [json.loads("{" + t + "}") if t.strip()[0] == '"' else json.loads(t) for t in inner]
        assert shown == [json.loads(t) for t in want]


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    """One document of 30 MB, ranges of 1 MB."""
    note = "x" * 900 + '\\"}{'
    with open(tmp_path / "tmgr.0000.json", "w") as f:
        f.write('{"uid": "tmgr.0000", "cfg": {"big": {"deep": [1, 2]}}, "tasks": {')
        for i in range(30_000):
            f.write((", " if i else "") + json.dumps(f"task.{i:06d}") + ": " + json.dumps(
                {"uid": f"task.{i:06d}", "state": "DONE", "pilot": note, "description": {"ranks": i % 5}}))
        f.write('}}')
    planned = ranges._planned(spark, str(tmp_path), "tmgr.*.json", 1 << 20) if ranges.json_fragments(
        spark, str(tmp_path), "tmgr.*.json", 1 << 20).limit(1).count() else []
    assert len(ranges.JsonReader("", "", planned, 1 << 20).partitions()) == len(planned) > 25
    managers, tasks = d.read_manager_docs(spark, str(tmp_path), "tmgr", "tmgr.*.json", 1 << 20)
    assert [tuple(r) for r in managers.collect()] == [("tmgr.0000", '{"big":{"deep": [1, 2]}}')]
    got = tasks.agg(F.count("uid"), F.count_distinct("uid"), F.sum("description.ranks"), F.min("pilot"), F.max("tmgr")).head()
    assert tuple(got) == (30_000, 30_000, 60_000, note, "tmgr.0000")


def test_only_the_end_of_an_output_is_read(spark, tmp_path):
    with open(tmp_path / "t.out", "wb") as f:
        f.write(b"\xff" * 5_000_000 + "é".encode() * 5000)
    (tmp_path / "u.err").write_text("ab")
    (tmp_path / "v.out").write_text("")
    (tmp_path / "w.out").write_text("中" * 1365)
    got = {r.path.split("/")[-1]: (r.bytes, r.text) for r in ranges.read_ends(spark, str(tmp_path), "*.out|*.err").collect()}
    short = "[... CONTENT SHORTENED ...]\n"
    assert got == {"t.out": (5_010_000, short + "é" * 1024), "u.err": (2, "ab"), "v.out": (0, ""), "w.out": (4095, short + "中" * 1024)}
    assert ranges.read_ends(spark, str(tmp_path), "*.none").count() == 0


def test_outputs(spark, tmp_path):
    (tmp_path / "task.1").mkdir()
    (tmp_path / "task.1" / "task.1.out").write_text("é" * 2000)
    (tmp_path / "task.1" / "task.1.err").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "task.1" / "task.1.ofiles").write_text("a.dat \nb.dat\n")
    texts, files = logs.collect_outputs(spark, str(tmp_path))
    got = {(r.uid, r.stream): r.text for r in texts.collect()}
    assert got[("task.1", "stdout")] == "[... CONTENT SHORTENED ...]\n" + "é" * 1024
    assert got[("task.1", "stderr")] == "task stderr is binary -- use file staging"
    assert tuples(files) == [("task.1", 0, "a.dat"), ("task.1", 1, "b.dat")]


def test_outputs_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver lists no file; lists of files are the same, read by one task or in splits."""
    for i in range(30):
        (tmp_path / f"task.{i}" / "deep").mkdir(parents=True)
        (tmp_path / f"task.{i}" / f"task.{i}.ofiles").write_bytes(b"a \r\n\nb" + b"\rc" * (i % 3))
        (tmp_path / f"task.{i}" / "deep" / f"task.{i}.out").write_text(f"out {i}")
        (tmp_path / f"task.{i}" / f".task.{i}.err").write_text("hidden")
    monkeypatch.setattr(ranges, "files", None)
    texts, files = logs.collect_outputs(spark, str(tmp_path))
    assert tuples(texts) == sorted([(f"task.{i}", "stdout", f"out {i}") for i in range(30)], key=repr)
    names = ["a", "", "b", "c", "c"]
    assert tuples(files) == sorted([(f"task.{i}", k, n) for i in range(30) for k, n in enumerate(names[:3 + i % 3])], key=repr)
    monkeypatch.setattr(logs, "LIST", 8)
    assert tuples(logs.collect_outputs(spark, str(tmp_path))[1]) == tuples(files)
    assert ranges.read_ends(spark, str(tmp_path / "task.4" / "deep" / "task.4.out"), "*.out").first().text == "out 4"


def test_host_lists(spark):
    df = spark.createDataFrame([("j", i, h) for i, h in enumerate(["n2", "n1", "n2", "n2"])] + [("k", 0, "n1"), ("k", 1, "n1 2")],
                               "job string, pos int, value string")
    hosts = logs.host_slots(df)
    assert tuples(hosts, "job", "host", "slots") == [("j", "n1", 1), ("j", "n2", 3)]
    shapes = tuples(logs.host_shapes(hosts, gpn=1), "name", "index", "cores", "gpus")
    assert shapes == [("n1", 1, [0.0], [0.0]), ("n2", 0, [0.0] * 3, [0.0])]


def test_equal_uids_of_two_sessions_stay_apart(spark):
    one = lambda rows, layout: spark.createDataFrame(rows, layout)
    pilots = one([("s0", "p"), ("s1", "p"), ("s1", "q")], "sid string, uid string")
    tasks = one([("s0", "a", "p"), ("s1", "a", "p"), ("s1", "b", "p")], "sid string, uid string, pilot string")
    got = d.session_with_task_ids(pilots, tasks).collect()
    assert {(r.sid, r.uid): r.task_ids for r in got} == {("s0", "p"): ["a"], ("s1", "p"): ["a", "b"], ("s1", "q"): []}
    nodes, edges = d.entity_tree({
        "session": one([("s0",), ("s1",)], "uid string"),
        "pmgr": one([("s0", "m"), ("s1", "m")], "sid string, uid string"),
        "tmgr": one([("s0", "t"), ("s1", "t")], "sid string, uid string"),
        "pilot": pilots.selectExpr("*", "'m' AS pmgr"), "task": tasks.selectExpr("*", "'t' AS tmgr")})
    below = {(r.sid, r.parent): r.children for r in d.children(edges).collect()}
    assert below["s0", "p"] == ["a"] and below["s1", "p"] == ["a", "b"] and below["s1", "t"] == ["a", "b"]
    assert nodes.filter("uid = 'p'").count() == 2


def test_the_entries_of_a_large_document_do_not_meet_in_one_task(spark, folder):
    _, _, entries = ranges.json_entries(ranges.json_fragments(spark, folder, "tmgr.*.json"))
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_session_document_is_written_in_pieces(spark, tmp_path, monkeypatch):
    from suite import documents as suite
    monkeypatch.setattr(suite, "PIECE", 100, raising=False)
    monkeypatch.setattr(suite, "fresh_path", lambda spark, name: str(tmp_path / name))
    sf = "/root/testdata/sf0.001"
    path = suite.session_folder(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    docs = [json.loads(f.read_text()) for f in sorted((tmp_path / "session-folder").glob("mgr=tmgr.*/part-*"))]
    assert path.endswith("session-folder") and [doc["uid"] for doc in docs] == [f"tmgr.000{k}" for k in range(4)]
    assert sum(len(doc["tasks"]) for doc in docs) == orders and all(list(doc["tasks"]) == sorted(doc["tasks"]) for doc in docs)
    pieces = [f.read_text().count("\n") for f in (tmp_path / "session-pieces").glob("mgr=*/part-*")]
    assert len(pieces) > 8 and max(pieces) < 4 * 100
