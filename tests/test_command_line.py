from seriesloom.__main__ import dictionary, main
from seriesloom.registry import OPERATORS


def test_dictionary(capsys):
    assert main(["--dic"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == len(dictionary()) == len(OPERATORS)


def test_selftest_and_forms(spark, capsys):
    assert main(["selftest"], spark) == 0
    assert "FAILED" not in capsys.readouterr().out
    assert main(["-e", "(+ 1 2)"], spark) == 0 and capsys.readouterr().out == "3\n"


def test_verify(spark, tmp_path, capsys):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("k;v\nx;1\ny;2\n")
    b.write_text("k;v\nx;1\ny;2.5\n")
    assert main(["verify", str(a), str(a)], spark) == 0
    assert main(["verify", str(a), str(b), "--verbose"], spark) == 1
    assert "row 1, v: 2 and 2.5" in capsys.readouterr().out
