"""The command line: forms, files of forms, the list of operators, a comparison of two files, and a self-test.

    python -m seriesloom -e "(+ 1 2)"        python -m seriesloom program.lisp        python -m seriesloom --dic
    python -m seriesloom verify a.csv b.csv [--tol 1e-6] [--verbose]                  python -m seriesloom selftest
"""

from __future__ import annotations

import argparse
import inspect
import math
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .frame import Panel
from .operators.columns import make_col
from .plans import lisp
from .registry import OPERATORS
from .sources import csvfile, verify


def dictionary() -> list[str]:
    """A line for each operator: its module, name and parameters, the tokens that call it, and what it does."""
    tokens: dict[str, list[str]] = {}
    for token, name in lisp.TOKENS.items():
        tokens.setdefault(name, []).append(token)
    lines = []
    for name, f in OPERATORS.items():
        about = (inspect.getdoc(f) or "").split("\n")[0]
        lines.append(f"{f.__module__.rsplit('.', 1)[-1]:<10} {name}{inspect.signature(f)}  [{' '.join(tokens.get(name, []))}]  {about}")
    return sorted(lines)


def checks(spark: SparkSession) -> dict[str, Callable[[], bool]]:
    """Small cases whose results are known: logarithm of zero, zero by zero, chains, fills, windows, alignment."""

    def values(p: Panel) -> list:
        return [r[p.values[0]] for r in p.df.orderBy("__pos").collect()]

    return {
        "the logarithm of 0 is minus infinity": lambda: values(make_col(spark, 0.0).log()) == [-math.inf],
        "0 by 0 is missing": lambda: values(make_col(spark, 0.0).div(0.0)) == [None],
        "a chain keeps the edges of its parts": lambda: values(make_col(spark, 1.0, 0.0, 0.0).dlog()) == [None, -math.inf, None],
        "missing values are filled from before": lambda: values(make_col(spark, None, 1.0, None).locf()) == [None, 1.0, 1.0],
        "windows hold values, not rows": lambda: values(make_col(spark, 1.0, None, 3.0).rolling_mean(2)) == [None, None, 2.0],
        "a panel meets itself in one projection": lambda: values((lambda p: p.add(p.shift(1)))(make_col(spark, 1.0, 2.0))) == [None, 3.0],
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args == ["--dic"]:
        print("\n".join(dictionary()))
        return 0
    parser = argparse.ArgumentParser(prog="seriesloom")
    parser.add_argument("what", nargs="*", help="verify A B, selftest, or a file of forms")
    parser.add_argument("-e", dest="text", help="forms to run")
    parser.add_argument("--tol", type=float, default=1e-6)
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("seriesloom").getOrCreate()
    if given.what[:1] == ["verify"] and len(given.what) == 3:
        same = verify.verify(spark, *given.what[1:], given.tol)
        if given.verbose and not same:
            for r in verify.differences(spark, *given.what[1:], given.tol).orderBy("row", "column").toLocalIterator():
                print(f"row {r['row']}, {r['column']}: {r['left']} and {r['right']}")
        print("the same" if same else "not the same")
        return 0 if same else 1
    if given.what == ["selftest"]:
        failed = 0
        for name, check in checks(spark).items():
            ok = check()
            failed += not ok
            print(f"{'ok    ' if ok else 'FAILED'} {name}")
        return 1 if failed else 0
    if given.text is None and len(given.what) != 1:
        parser.error("give forms, a file of forms, verify A B, or selftest")
    text = given.text
    if text is None:
        with open(given.what[0]) as f:
            text = f.read()
    out = lisp.Session(spark).run(text)
    if isinstance(out, Panel):
        csvfile.print_table(out)
    elif out is not None:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
