import io
import tempfile
from pathlib import Path

import pytest

from seriesloom.plans import lisp
from seriesloom.plans.blocked import blocked
from seriesloom.sources import csvfile, verify



def scratch_file(text: str) -> str:
    path = Path(tempfile.mkdtemp(prefix="seriesloom-csv-")) / "input.csv"
    path.write_text(text)
    return str(path)


TEXT = "DATE;px;vol\n2024-01-01; 1.5 ;NA\n2024-02-31;x;2\nN/A;;inf\n"


def test_types_are_inferred_and_cells_that_do_not_fit_are_missing(spark):
    p = csvfile.read_csv(spark, scratch_file(TEXT))
    rows = [tuple(r) for r in p.df.orderBy("__pos").select("DATE", "px", "vol").collect()]
    assert [str(r[0]) for r in rows] == ["2024-01-01", "2024-03-02", "None"]
    assert [r[1:] for r in rows] == [(1.5, None), (None, 2.0), (None, float("inf"))]


def test_index_rules(spark):
    assert csvfile.read_csv(spark, scratch_file("a;b\n1;2\n3;4\n")).index == "ROW"
    p = csvfile.read_csv(spark, scratch_file("date;b\n0;2\n1;4\n"))
    assert p.index == "date" and p.df.schema["date"].dataType.typeName() == "string"
    t = csvfile.read_csv(spark, scratch_file("x;b\n2024-01-01 10:00:00.123456789;2\n"))
    assert t.index == "x" and t.df.schema["x"].dataType.typeName() == "timestamp"
    with pytest.raises(KeyError):
        csvfile.read_csv(spark, scratch_file(TEXT), columns=["none"])


def test_head_and_stdin(spark):
    path = scratch_file("k;v\n" + "".join(f"r{i};{i}\n" for i in range(50)))
    assert csvfile.read_csv(spark, path, head=3).df.count() == 3
    p = csvfile.read_stdin(spark, stream=io.StringIO(TEXT))
    assert p.df.count() == 3 and p.index == "DATE"
    assert csvfile.read_stdin(spark, stream=io.StringIO("")).df.count() == 0


def test_writing_and_verifying(spark, tmp_path):
    a = scratch_file("k;v\n" + "".join(f"r{i};{i / 7}\n" for i in range(20)))
    b = scratch_file("k;v\n" + "".join(f"r{i};{i / 7 + 1e-9}\n" for i in range(20)))
    c = scratch_file("k;v\n" + "".join(f"r{i};{i / 7 + (i == 4)}\n" for i in range(20)))
    assert verify.verify(spark, a, b) and not verify.verify(spark, a, c)
    assert [(r["row"], r["column"]) for r in verify.differences(spark, a, c).collect()] == [(4, "v")]
    p = csvfile.read_csv(spark, scratch_file("date;v\na;1\nb;NA\n"))
    csvfile.write_csv(p, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out")).collect()] == [("a", "1.0"), ("b", "NaN")]
    csvfile.save_file(p, str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_text() == "date;v\na;1.0\nb;NaN\n" and len(list(tmp_path.glob("one*"))) == 1
    out = io.StringIO()
    csvfile.print_table(p, out)
    assert out.getvalue() == "date;v\na;1.0\nb;NA\n"


def test_front_end(spark):
    path = scratch_file("date;v\na;1\nb;2\nc;4\n")
    s = lisp.Session(spark)
    assert s.run("(+ 1 2)") == 3
    assert s.run("(define f (lambda (a b) (* a b))) (f 3 4)") == 12
    assert s.run("(if 0.0 1 2)") == 1 and s.run("(if nil 1 2)") == 2
    assert s.run("(let* ((a 2) (b (+ a 1))) (and a b))") == 3
    assert s.run("(defmacro unless2 (c x) `(if ,c nil ,x)) (unless2 nil 5)") == 5
    p = s.run(f'(-> (file "{path}") dlog (cs1) (shift 1))')
    assert [r.v for r in p.df.orderBy("__pos").collect()] == [None, None, pytest.approx(1.6931471805599454)]
    for bad in ("(", ")", "(nothing 1)", "x"):
        with pytest.raises((SyntaxError, NameError)):
            s.run(bad)


def test_blocked_series_with_ties_and_few_rows(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "t int, i int, x double")
    p = blocked(df, "t", ["x"], ["t", "i"], blocks=4)
    assert [r["__pos"] for r in p.df.orderBy("x").collect()] == list(range(6))
    empty = blocked(df.where("x < 0"), "t", ["x"], ["t", "i"], blocks=4)
    assert empty.df.count() == 0
