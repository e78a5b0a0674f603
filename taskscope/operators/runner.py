"""Run functions, code and commands over a table of work items.

Every row gives one result: out, err, ret, val, exc, detail.  A failing row is
a result too; the batch goes on.  Spark spreads the rows; one Arrow batch is
handled at a time.  Values come back as JSON, or as `repr` where that fails.
"""

from __future__ import annotations

import ast
import asyncio
import base64
import contextlib
import inspect
import io
import json
import multiprocessing
import os
import shlex
import subprocess
import traceback
from collections.abc import Callable

import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from taskscope.operators.state import target_state
from taskscope.schema import RESULT

# ---- one row ---------------------------------------------------------------


def as_text(value) -> str | None:
    if value is None:
        return None
    try:
        return json.dumps(value)
    except (TypeError, ValueError):
        return repr(value)


def failure(err: str | None, exc: BaseException, out: str | None = None) -> dict:
    # frames only: rendering source lines costs more than most calls
    frames = [f"{f.f_code.co_filename}:{line} in {f.f_code.co_name}"
              for f, line in traceback.walk_tb(exc.__traceback__)]
    trace = "\n".join([*frames, repr(exc)])
    return {"out": out, "err": err, "ret": 1, "val": None, "exc": repr(exc), "detail": trace}


#: the bytes behind `os.environ`, where Python has them: copied and compared for every row
_variables = os.environb._data if isinstance(getattr(os.environb, "_data", None), dict) else os.environb


@contextlib.contextmanager
def environment(extra: dict | None):
    """Set variables for one row; afterwards all are as before, also those the
    row itself has changed."""
    saved = dict(_variables)
    if extra:
        os.environ.update({k: str(v) for k, v in extra.items()})
    try:
        yield
    finally:
        if _variables != saved:
            os.environ.clear()
            os.environb.update(saved)


_loop = None


def awaited(coroutine):
    """Run a coroutine in the event loop of this Python worker."""
    global _loop
    if _loop is None or _loop.is_closed():
        _loop = asyncio.new_event_loop()
    return _loop.run_until_complete(coroutine)


def capture(call: Callable, env: dict | None = None, label: str = "call") -> dict:
    """The result of one call; coroutines are awaited."""
    out, err = io.StringIO(), io.StringIO()
    with environment(env):
        try:
            with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
                value = call()
                if inspect.iscoroutine(value):
                    value = awaited(value)
        except (Exception, SystemExit) as e:
            return failure(f"{err.getvalue()}\n{label} failed: {e}", e, out.getvalue())
    return {"out": out.getvalue(), "err": err.getvalue(), "ret": 0, "val": as_text(value),
            "exc": None, "detail": None}


def shell(command: str, env: dict | None, label: str) -> dict:
    try:
        done = subprocess.run(command, shell=True, env={**os.environ, **(env or {})},
                              stdin=subprocess.DEVNULL, capture_output=True)
    except Exception as e:
        return failure(f"{label} failed: {e}", e)
    return {"out": done.stdout.decode(errors="replace"), "err": done.stderr.decode(errors="replace"),
            "ret": done.returncode, "val": None, "exc": None, "detail": None}


def limited(run: Callable[[], dict], seconds: float | None) -> dict:
    """Run in a child process that is ended after the given time; no limit, no child."""
    if not seconds:
        return run()
    fork = multiprocessing.get_context("fork")
    here, there = fork.Pipe(duplex=False)
    child = fork.Process(target=lambda: there.send(run()), daemon=True)
    child.start()
    there.close()
    try:
        if here.poll(seconds):
            return here.recv()
        return {"out": None, "err": f"timeout (>{seconds})", "ret": 1, "val": None,
                "exc": 'TimeoutError("task timed out")', "detail": None}
    except EOFError as e:
        return failure(f"dispatch failed: {e}", e)
    finally:
        child.kill()
        child.join()
        here.close()


# ---- functions -------------------------------------------------------------


class Bound:
    """A function with its arguments; the row must not bring any."""

    def __init__(self, fn: Callable, args=(), kwargs=None):
        if not callable(fn):
            raise ValueError("task function is not callable")
        self.fn, self.args, self.kwargs = fn, tuple(args), dict(kwargs or {})

    def __call__(self, *args, **kwargs):
        if args or kwargs:
            raise ValueError("a function with bound arguments takes no others")
        return self.fn(*self.args, **self.kwargs)

    def packed(self) -> str:
        """Text for a `function` column; only read back with `allow_code`."""
        return base64.b64encode(cloudpickle.dumps(self)).decode()


def task_fn(fn: Callable) -> Callable[..., Bound]:
    """Decorator: calling the function binds the arguments instead."""
    return lambda *args, **kwargs: Bound(fn, args, kwargs)


def unpack(text: str) -> Bound:
    bound = cloudpickle.loads(base64.b64decode(text, validate=True))
    if not isinstance(bound, Bound):
        raise TypeError("not a packed function")
    return bound


class Modes:
    """Named ways to run a row: name -> function of the row that gives a value."""

    def __init__(self):
        self._runners: dict[str, Callable] = {}

    def register(self, name: str, runner: Callable) -> None:
        if name in self._runners:
            raise ValueError(f"mode {name} is already registered")
        self._runners[name] = runner

    def get(self, name: str) -> Callable:
        if name not in self._runners:
            raise ValueError(f"mode {name} is unknown")
        return self._runners[name]

    def __contains__(self, name):
        return name in self._runners


# ---- tables ----------------------------------------------------------------


def _plain(value, kind: T.DataType):
    """Arrow gives maps as pairs."""
    return dict(value) if isinstance(kind, T.MapType) and value is not None else value


def run_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], keep=("uid",),
             barrier: bool = False, needs=None) -> DataFrame:
    """Apply `make()(row)` to each row; `make` is called once per partition.

    Rows run where they are read.  Spread few but long rows with `repartition`
    before.  Only the columns of `keep` and `needs` go to Python, all without `needs`.
    """
    keep = list(keep)
    if needs is not None:
        wanted = {*keep, *needs}
        df = df.select(*[c for c in df.columns if c in wanted])
    layout = T.StructType([df.schema[c] for c in keep] + RESULT.fields)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def apply(batches):
        run = make()
        arrow = to_arrow_schema(layout)
        for batch in batches:
            rows = []
            for raw in batch.to_pylist():
                row = {k: _plain(v, kinds[k]) for k, v in raw.items()}
                result = run(row)
                rows.append({**{k: raw[k] for k in keep}, **result})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(apply, layout, barrier=barrier)


def _arguments(row: dict, args, kwargs) -> tuple[list, dict]:
    return [row[c] for c in args], {name: row[c] for name, c in kwargs.items()}


def run_func(df: DataFrame, fn: Callable, args=(), kwargs=None, keep=("uid",), spread: int | None = None) -> DataFrame:
    """Call `fn` per row with the given columns.

    Columns `environment` and `timeout` apply to the row where present.  `spread` is as in `run_tasks`.
    """
    kwargs = dict(kwargs or {})
    needs = [*args, *kwargs.values(), "environment", "timeout"]
    if spread:  # without the columns that nobody reads
        df = df.select(*[c for c in df.columns if c in {*keep, *needs}]).repartition(spread)

    def make():
        def run(row):
            a, k = _arguments(row, args, kwargs)
            return limited(lambda: capture(lambda: fn(*a, **k), row.get("environment")), row.get("timeout"))
        return run

    return run_rows(df, make, keep, needs=needs)


def run_method(df: DataFrame, cls: type, name: str, args=(), kwargs=None, keep=("uid",)) -> DataFrame:
    """Call a method of an object that is made once per partition."""
    kwargs = dict(kwargs or {})

    def make():
        method = getattr(cls(), name)

        def run(row):
            a, k = _arguments(row, args, kwargs)
            return limited(lambda: capture(lambda: method(*a, **k), row.get("environment")), row.get("timeout"))
        return run

    return run_rows(df, make, keep, needs=[*args, *kwargs.values(), "environment", "timeout"])


def _body(code: str, pre: list[str]) -> Callable:
    """The code as the body of a function, after the lines of `pre`; its value is what that returns.

    The statements are parsed and put into a function's node, so the text stays as it is.
    """
    def call():
        # only the syntax tree: `return` is right once the statements are in the function
        statements = compile(code, "<task>", "exec", ast.PyCF_ONLY_AST).body
        module = ast.parse("\n".join([*pre, "def _task(): pass"]), "<task>")
        module.body[-1].body = statements or [ast.Pass()]
        space: dict = {}
        exec(compile(ast.fix_missing_locations(module), "<task>", "exec"), space)  # noqa: S102 - opted in with allow_code
        return space["_task"]()
    return call


def _command(row: dict) -> str:
    return " ".join([row["executable"], *[shlex.quote(a) for a in row.get("arguments") or []]])


def _json_args(row: dict) -> tuple[list, dict]:
    load = lambda v, empty: json.loads(v) if isinstance(v, str) and v else (v or empty)
    return load(row.get("args"), []), load(row.get("kwargs"), {})


#: What the built-in modes read of a row; own modes may read any column.
ROW_FIELDS = ["mode", "environment", "timeout", "function", "args", "kwargs", "code", "pre_exec", "executable",
              "arguments", "command"]
CODE_MODES = ["task.eval", "task.exec", "task.proc", "task.shell"]


def dispatch(row: dict, functions: dict, modes: Modes, allow_code: bool) -> dict:
    """Run one row the way its mode says."""
    mode, env = row.get("mode"), row.get("environment")
    try:
        if mode in modes:
            return capture(lambda: modes.get(mode)(row), env)
        if mode in CODE_MODES and not allow_code:
            raise PermissionError(f"{mode} runs code from the data: allow_code is off")
        if mode in ("task.function", "task.method"):
            fn = functions.get(row["function"])
            if fn is None and allow_code:
                fn = unpack(row["function"])
            if fn is None:
                raise ValueError(f"callable {row['function']} not found")
            a, k = _json_args(row)
            return capture(lambda: fn(*a, **k), env)
        if mode == "task.eval":
            return capture(lambda: eval(row["code"]), env, "eval")  # noqa: S307
        if mode == "task.exec":
            return capture(_body(row["code"], row.get("pre_exec") or []), env, "exec")
        if mode == "task.proc":
            return shell(_command(row), env, "exec")
        if mode == "task.shell":
            return shell(row["command"], env, "shell")
        raise ValueError(f"mode {mode} is unknown")
    except Exception as e:
        return failure(f"call failed: {e}", e)


def run_tasks(df: DataFrame, functions: dict[str, Callable] | None = None, modes: Modes | None = None,
              allow_code: bool = False, before=None, after=None, keep=("uid",),
              spread: int | None = None) -> DataFrame:
    """Run a table of mixed modes.

    Columns as in a task description; `args` and `kwargs` are JSON.  `before`
    may filter, change or add rows, `after` sees the results with their target
    state; both take and return a DataFrame.  `spread` deals the rows out evenly
    over that many partitions, for rows that run long.
    """
    own_modes = modes is not None
    functions, modes = dict(functions or {}), modes or Modes()
    work = before(df) if before else df
    if spread:
        work = work.repartition(spread)

    def make():
        return lambda row: limited(lambda: dispatch(row, functions, modes, allow_code), row.get("timeout"))

    results = target_state(run_rows(work, make, keep, needs=None if own_modes else ROW_FIELDS).withColumn("exit_code", F.col("ret"))
                           .withColumn("target_state", F.lit(None).cast("string"))).drop("exit_code")
    return after(results) if after else results


def _code_rows(df: DataFrame, mode: str, allow_code: bool, keep) -> DataFrame:
    if not allow_code:
        raise PermissionError(f"{mode} runs code from the data: pass allow_code=True")
    return run_tasks(df.withColumn("mode", F.lit(mode)), allow_code=True, keep=keep).drop("target_state")


def run_eval(df: DataFrame, allow_code: bool = False, keep=("uid",)) -> DataFrame:
    """Evaluate the Python expression in `code`."""
    return _code_rows(df, "task.eval", allow_code, keep)


def run_exec(df: DataFrame, allow_code: bool = False, keep=("uid",)) -> DataFrame:
    """Run `code` as a function body after the lines in `pre_exec`."""
    return _code_rows(df, "task.exec", allow_code, keep)


def run_proc(df: DataFrame, allow_code: bool = False, keep=("uid",)) -> DataFrame:
    """Run `executable` with quoted `arguments`."""
    return _code_rows(df, "task.proc", allow_code, keep)


def run_shell(df: DataFrame, allow_code: bool = False, keep=("uid",)) -> DataFrame:
    """Run the shell line in `command`."""
    return _code_rows(df, "task.shell", allow_code, keep)


# ---- ranks -----------------------------------------------------------------


class Communicator:
    """What the ranks of a barrier stage use to talk to each other."""

    def __init__(self):
        self._context = BarrierTaskContext.get()
        self.rank = self._context.partitionId()
        self.size = len(self._context.getTaskInfos())

    def allgather(self, value) -> list:
        return [json.loads(v) for v in self._context.allGather(json.dumps(value))]

    def bcast(self, value, root: int = 0):
        return self.allgather(value)[root]

    def barrier(self) -> None:
        self._context.barrier()


def run_ranks(df: DataFrame, fn: Callable, args=(), keep=("uid",)) -> DataFrame:
    """Call `fn(*args, rank=, ranks=)` once for each of a row's `ranks`.

    The result has one row per rank; `stats.merge_ranks` puts them together.
    """
    ranks = df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("ranks") - 1)))

    def make():
        def run(row):
            env = {**(row.get("environment") or {}), "TASK_RANK": row["rank"], "TASK_RANKS": row["ranks"]}
            a = [row[c] for c in args]
            return capture(lambda: fn(*a, rank=row["rank"], ranks=row["ranks"]), env)
        return run

    return run_rows(ranks, make, [*keep, "rank", "ranks"])


def run_ranks_together(df: DataFrame, fn: Callable, ranks: int, args=(), keep=("uid",)) -> DataFrame:
    """As `run_ranks` with a communicator as first argument, for one number of
    ranks: all ranks run at the same time and need a slot each.

    Rank i of every row is in partition i, in the same order, so the ranks of a
    row meet.  A rank that fails before it communicates fails the stage.
    """
    spread = (df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
              .withColumn("ranks", F.lit(ranks))
              .repartitionById(ranks, F.col("rank")).sortWithinPartitions(*keep))

    def make():
        comm = Communicator()

        def run(row):
            a = [row[c] for c in args]
            return capture(lambda: fn(comm, *a))
        return run

    return run_rows(spread, make, [*keep, "rank", "ranks"], barrier=True)
