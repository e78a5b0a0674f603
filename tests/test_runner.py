import os

import pytest
from pyspark.sql import functions as F

from taskscope.operators import runner as r
from taskscope.operators.stats import merge_ranks


def results(df):
    return {x.uid: x for x in df.collect()}


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(f"t{i}", i) for i in range(4)], "uid string, n int")


def test_failures_do_not_end_the_batch(items):
    def fn(n):
        print("got", n)
        if n == 1:
            raise KeyError("one")
        if n == 2:
            import sys
            sys.exit(3)
        return {"n": n}

    got = results(r.run_func(items, fn, ["n"]))
    assert (got["t0"].ret, got["t0"].val, got["t0"].out) == (0, '{"n": 0}', "got 0\n")
    assert got["t1"].ret == 1 and got["t1"].exc == "KeyError('one')" and got["t1"].err == "\ncall failed: 'one'"
    assert "in fn" in got["t1"].detail
    assert got["t2"].exc == "SystemExit(3)" and got["t3"].ret == 0


def test_keyword_arguments_and_other_values(items):
    got = results(r.run_func(items, lambda *, k: object, kwargs={"k": "n"}))
    assert got["t0"].val == "<class 'object'>"


def test_an_object_is_made_once_per_partition(items):
    class Counter:
        def __init__(self):
            self.calls = 0

        def call(self, n):
            self.calls += 1
            return self.calls

    got = results(r.run_method(items.coalesce(1), Counter, "call", ["n"]))
    assert sorted(x.val for x in got.values()) == ["1", "2", "3", "4"]


def test_environment_is_set_and_restored(items):
    def fn(n):
        seen = os.environ.get("ITEM")
        os.environ["LEFT"] = "x"
        return [seen, n]

    def look():
        return [os.environ.get("ITEM"), os.environ.get("LEFT")]

    df = items.coalesce(1).withColumn("environment", F.create_map(F.lit("ITEM"), F.col("uid")))
    assert results(r.run_func(df, fn, ["n"]))["t2"].val == '["t2", 2]'
    assert {x.val for x in results(r.run_func(items, look)).values()} == {"[null, null]"}


def test_time_limit(items):
    def fn(n):
        import time
        if n == 2:
            time.sleep(60)
        return n

    got = results(r.run_func(items.withColumn("timeout", F.lit(3.0)), fn, ["n"]))
    assert got["t2"].ret == 1 and got["t2"].err == "timeout (>3.0)" and "TimeoutError" in got["t2"].exc
    assert got["t3"].val == "3"


def test_a_child_that_dies_is_a_result(items):
    def fn(n):
        os._exit(1)

    got = results(r.run_func(items.limit(1).withColumn("timeout", F.lit(20.0)), fn, ["n"]))
    assert got["t0"].ret == 1 and got["t0"].err.startswith("dispatch failed")


def test_code_is_off_unless_allowed(spark):
    df = spark.createDataFrame([("a", "1 + 1")], "uid string, code string")
    for run in (r.run_eval, r.run_exec, r.run_proc, r.run_shell):
        with pytest.raises(PermissionError):
            run(df)
    mixed = df.withColumn("mode", F.lit("task.eval"))
    assert "allow_code" in results(r.run_tasks(mixed))["a"].err


def test_code_modes(spark):
    ev = spark.createDataFrame([("a", "1 + 1"), ("b", "1 / 0")], "uid string, code string")
    got = results(r.run_eval(ev, allow_code=True))
    assert got["a"].val == "2" and got["b"].err == "\neval failed: division by zero"
    ex = spark.createDataFrame([("a", "print(math.pi > 3)\nreturn math.floor(2.5)", ["import math"])],
                               "uid string, code string, pre_exec array<string>")
    got = results(r.run_exec(ex, allow_code=True))
    assert (got["a"].val, got["a"].out) == ("2", "True\n")
    pr = spark.createDataFrame([("a", "/bin/echo", ["x y", "$HOME"], {"K": "v"})],
                               "uid string, executable string, arguments array<string>, environment map<string,string>")
    assert results(r.run_proc(pr, allow_code=True))["a"].out == "x y $HOME\n"
    sh = spark.createDataFrame([("a", "echo $K; exit 4", {"K": "v"})], "uid string, command string, environment map<string,string>")
    got = results(r.run_shell(sh, allow_code=True))
    assert (got["a"].out, got["a"].ret) == ("v\n", 4)


def test_own_modes():
    modes = r.Modes()
    modes.register("x", len)
    assert modes.get("x") is len
    with pytest.raises(ValueError):
        modes.register("x", len)
    with pytest.raises(ValueError):
        modes.get("y")


def test_packed_functions(spark):
    @r.task_fn
    def add(a, b):
        return a + b

    df = spark.createDataFrame([("a", "task.function", add(2, 3).packed(), ""), ("b", "task.function", add(2, 3).packed(), "[1]"),
                                ("c", "task.function", "no function", "")], "uid string, mode string, function string, args string")
    got = results(r.run_tasks(df, allow_code=True))
    assert got["a"].val == "5" and "takes no others" in got["b"].err and got["c"].ret == 1
    assert results(r.run_tasks(df))["a"].ret == 1
    with pytest.raises(ValueError):
        r.Bound("text")


def test_ranks_and_merge(spark):
    df = spark.createDataFrame([("a", 3, 10), ("b", 1, 20)], "uid string, ranks int, n int")

    def fn(n, rank, ranks):
        print(os.environ["TASK_RANK"])
        return n + rank

    ranks = r.run_ranks(df, fn, ["n"]).withColumnsRenamed(
        {"out": "stdout", "err": "stderr", "val": "return_value", "ret": "exit_code"})
    got = {x.uid: x for x in merge_ranks(ranks).collect()}
    assert got["a"].return_value == ["10", "11", "12"] and got["a"].stdout == ["0\n", "1\n", "2\n"] and got["b"].exit_code == 0
    short = ranks.filter("not (uid = 'a' and rank = 2)")
    assert {x.uid for x in merge_ranks(short).collect()} == {"b"}
    assert merge_ranks(ranks, size=2).filter("uid = 'a'").count() == 2


def test_ranks_talk(spark):
    df = spark.createDataFrame([("a", 5), ("b", 7)], "uid string, n int")

    def fn(comm, n):
        comm.barrier()
        return [sum(comm.allgather(n * comm.rank)), comm.size, comm.bcast(comm.rank * 10, root=1)]

    got = r.run_ranks_together(df, fn, 2, ["n"]).collect()
    assert {(x.uid, x.val) for x in got} == {("a", "[5, 2, 10]"), ("b", "[7, 2, 10]")} and len(got) == 4


def test_hooks(items):
    got = r.run_tasks(items.withColumns({"mode": F.lit("task.function"), "function": F.lit("f"), "args": F.concat(F.lit("["), "n", F.lit("]"))}),
                      {"f": lambda n: 1 // n}, before=lambda d: d.filter("n < 2"), after=lambda d: d.select("uid", "target_state"))
    assert sorted(map(tuple, got.collect())) == [("t0", "FAILED"), ("t1", "DONE")]


def test_the_text_of_a_code_body_is_not_altered(spark):
    df = spark.createDataFrame([("a", '"""a\nb"""\nreturn """a\nb"""', None), ("b", "x = base\nreturn x", ["base = 3"]),
                                ("c", "", None)], "uid string, code string, pre_exec array<string>")
    got = {x.uid: x.val for x in r.run_exec(df, allow_code=True).collect()}
    assert got == {"a": '"a\\nb"', "b": "3", "c": None}


def test_only_wanted_columns_reach_python(spark):
    df = spark.createDataFrame([("a", 1, "long text")], "uid string, x int, y string")
    plan = r.run_func(df, abs, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "y#" not in plan.split("MapInArrow")[1].split("\n")[0] and "Project [uid#" in plan


def test_a_function_can_be_spread_over_tasks(items):
    from pyspark import TaskContext
    got = r.run_func(items.coalesce(1), lambda n: TaskContext.get().partitionId(), ["n"], spread=3).collect()
    assert len({x.val for x in got}) == 3 and len(got) == items.count()


def test_a_row_without_variables_reads_none_of_them(monkeypatch):
    read = []
    monkeypatch.setattr(type(os.environ), "__getitem__", lambda self, key: read.append(key) or "")
    assert r.capture(lambda: 4)["val"] == "4" and not read
