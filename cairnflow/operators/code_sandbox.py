"""Running generated code against assertions in child processes: off unless asked for.

A bounded pool of children runs a task's rows, each with limits on CPU time, memory, files and
output.  Nothing here isolates a host from hostile code; run it only on executors that are
isolated themselves.  Static checks come first.
"""

from __future__ import annotations

import contextlib
import os
import signal
import subprocess
import sys
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import code, unsafe_pattern


def script(block: str, assertions: list[str]) -> str:
    """The code, then its assertions, each failing with its number and text."""
    tests = "".join(f"try:\n    {a}\nexcept AssertionError as e:\n    raise AssertionError({f'Test case {k} failed: {a}'!r}) from e\n" for k, a in enumerate(assertions))
    return f"{block}\n\n{tests or 'pass'}\n"


#: Of a child: bytes of memory, bytes of a file or of its output, open files.
MEMORY, OUTPUT, FILES = 1 << 30, 1 << 20, 64
#: Children of a task that run at a time.
POOL = 8
#: The child bounds itself before it runs the script; what it runs can't raise the bounds again.
BOUNDED = """import resource, runpy, sys
for kind, most in zip((resource.RLIMIT_CPU, resource.RLIMIT_AS, resource.RLIMIT_FSIZE, resource.RLIMIT_NOFILE, resource.RLIMIT_CORE), map(int, sys.argv[2:])):
    resource.setrlimit(kind, (most, most))
path, sys.argv = sys.argv[1], sys.argv[1:2]
runpy.run_path(path, run_name="__main__")
"""


def execute(block: str, assertions: list[str], timeout: float) -> str | None:
    """None if the code runs and its assertions hold, else what went wrong.

    The child has bounds on CPU time, memory, files and output, and a session of its own, which
    ends with it, whatever it has started.
    """
    with tempfile.TemporaryDirectory(ignore_cleanup_errors=True) as folder:
        path, said = os.path.join(folder, "sandbox.py"), os.path.join(folder, "said")
        bounds = [str(n) for n in (int(timeout) + 2, MEMORY, OUTPUT, FILES, 0)]
        try:
            with open(path, "w", encoding="utf-8") as f:
                f.write(script(block, assertions))
            with open(said, "wb") as out:
                child = subprocess.Popen([sys.executable, "-I", "-c", BOUNDED, path, *bounds], stdin=subprocess.DEVNULL, stdout=out, stderr=out, cwd=folder, start_new_session=True)
        except (OSError, ValueError) as e:  # no process could be made: this row's error, not the task's
            return f"Execution error:\n{type(e).__name__}: {e}"
        try:
            code = child.wait(timeout)
        except subprocess.TimeoutExpired:
            return f"Timeout expired: execution exceeded limit of {timeout}s."
        finally:
            with contextlib.suppress(ProcessLookupError, PermissionError):
                os.killpg(child.pid, signal.SIGKILL)
            child.wait()
        if code == 0:
            return None
        with open(said, encoding="utf-8", errors="replace") as f:
            told = f.read(OUTPUT).strip()
        return "Execution error:\n" + (told or f"ended with {code}").replace(path, "sandbox.py")


def run_code(block: Column, assertions: Column, refused: Column, timeout: float, pool: int = POOL) -> Column:
    """string: what went wrong, null where the code runs and its assertions hold.  Refused code isn't run; ``pool`` children of a task run at a time."""
    @F.pandas_udf("string")
    def said(codes: pd.Series, tests: pd.Series, reasons: pd.Series) -> pd.Series:
        def one(row: tuple) -> str | None:
            code, asserted, reason = row
            return reason if reason is not None else execute(code, [a for a in asserted if a], timeout)

        with ThreadPoolExecutor(pool) as threads:
            return pd.Series(list(threads.map(one, zip(codes, tests, reasons))), dtype=object)

    return said(block, F.coalesce(assertions, F.array().cast("array<string>")), refused)


def verdict(text: Column, assertions: Column, allow_execution: bool = False, timeout: float = 2.0) -> tuple[Column, Column]:
    """(is_correct, error_message) of a response's code.

    Without ``allow_execution`` only static verdicts are given: no code, or an unsafe
    pattern; is_correct is null for the rest.
    """
    block = code(text)
    unsafe = unsafe_pattern(block)
    refused = F.when(block == "", F.lit("Could not extract Python code block from response.")).when(unsafe.isNotNull(), F.concat(F.lit("Security rejection: unsafe pattern '"), unsafe, F.lit("' detected in generated code.")))
    if not allow_execution:
        return F.when(refused.isNotNull(), F.lit(False)), refused
    error = run_code(block, assertions, refused, timeout)
    return error.isNull(), error


def verify(responses: DataFrame, allow_execution: bool = False, timeout: float = 2.0) -> DataFrame:
    """(id, is_correct, error_message) of rows (id, text, assertions array<string>), as :func:`verdict` has it."""
    right, error = verdict(F.col("text"), F.col("assertions"), allow_execution, timeout)
    return responses.select(F.col("id").cast("string").alias("id"), right.alias("is_correct"), error.alias("error_message"))
