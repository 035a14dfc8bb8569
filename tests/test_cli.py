import json
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark import cli
from tidemark.display import Preview, cell, enable_notebook_display, html_table, text_table
from tidemark.session import Session


@pytest.fixture
def same_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "spark_session", lambda: spark)


def test_verbs(same_session, tmp_path, capsys):
    root = str(tmp_path / "My-Prices")
    ts = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(4)]
    pq.write_table(pa.table({"ts": pa.array(ts, pa.timestamp("us")), "s": ["A", "A", "B", "B"], "v": [1.5, 2.25, 3.0, 4.0]}), tmp_path / "a.parquet")
    assert cli.main(["create", root, "--index", "ts"]) == 1
    assert cli.main(["create", root, "--index", "ts", "--bucket-width", "5"]) == 1
    assert cli.main(["create", root, "--index", "ts", "--bucket", "1h", "--entity", "s"]) == 0
    assert cli.main(["append", root, str(tmp_path / "a.parquet")]) == 0
    assert cli.main(["append", root, str(tmp_path / "a.parquet")]) == 1
    assert "overlap" in capsys.readouterr().err
    assert cli.main(["optimize", root]) == 0
    capsys.readouterr()
    assert cli.main(["query", root, "SELECT s, sum(v) AS total FROM my_prices GROUP BY s ORDER BY s"]) == 0
    assert capsys.readouterr().out.splitlines()[2:] == ["A | 3.75", "B | 7"]
    assert cli.main(["query", root, "SELECT s, v FROM my_prices", "--max-rows", "0", "--output", str(tmp_path / "out"), "--format", "jsonl"]) == 0
    assert capsys.readouterr().out == ""
    assert [json.loads(line)["v"] for line in (tmp_path / "out").read_text().splitlines()] == [1.5, 2.25, 3.0, 4.0]
    assert cli.main(["query", root, "SELECT s, v FROM my_prices ORDER BY v", "--max-rows", "0", "--output", str(tmp_path / "out.csv")]) == 0
    assert (tmp_path / "out.csv").read_text().splitlines()[:2] == ['"s","v"', '"A",1.5']
    assert cli.main(["query", root, "SELECT 1 AS x", "--output", str(tmp_path / "out.csv")]) == 1
    capsys.readouterr()
    assert cli.main(["query", root, "SELECT count(*) AS n FROM my_prices WHERE s = 'A'", "--explain", "--timing"]) == 0
    shown = capsys.readouterr().out
    assert "my_prices: 1 of 2 segment(s)" in shown and "parquet" in shown.lower() and " ms" in shown
    assert cli.main(["query", root, "SELECT array(1) AS a", "--output", str(tmp_path / "x")]) == 1
    assert cli.main(["query", root, "SELECT nope"]) == 1


def test_shell(same_session, tmp_path, capsys):
    root = str(tmp_path / "t")
    pq.write_table(pa.table({"ts": pa.array([datetime(2024, 1, 1)], pa.timestamp("us")), "v": [1.5]}), tmp_path / "a b.parquet")
    assert cli.main(["create", root, "--index", "ts", "--bucket", "1h"]) == 0
    session = Session(cli.spark_session())
    shell = cli.Shell(session, "t", session.register_tstable("t", root))
    capsys.readouterr()

    def said(*lines):
        for line in lines:
            assert not shell.onecmd(line)
        return capsys.readouterr().out

    assert "version 2" in said(f"append '{tmp_path}/a b.parquet'")
    assert "error: 1 covered" in said(f"append '{tmp_path}/a b.parquet'")
    assert said("alias p") == "p, t\n" and "error" in said("alias 1x")
    assert said("select p.v, 'p' as", "  k from p;").splitlines()[2:] == ["1.5 | p"]
    assert "1 segments, 1 rows" in said("status") and said("refresh") == "unchanged\n"
    assert "parquet" in said("explain select * from p").lower()
    assert " ms" in said("timing on", "select 1;") and "error" in said("select nope from p;")
    assert "error" in said("optimize") and said("unalias", "alias") == "t\n"
    assert said("rows 0", "rows") == "0\n" and shell.onecmd("quit")


def test_preview_settings(tmp_path, monkeypatch):
    (tmp_path / "tidemark.toml").write_text("[display]\nhead = 3\ntail = 0\n")
    monkeypatch.setenv("TIDEMARK_DISPLAY_HEAD", "4")
    assert Preview.configured(tmp_path) == Preview(head=4, tail=0)
    for bad in ("[display]\nhead = 'x'", "[display]\nother = 1", "[", "[display]\nwidth = 0"):
        (tmp_path / "tidemark.toml").write_text(bad)
        monkeypatch.delenv("TIDEMARK_DISPLAY_HEAD", raising=False)
        with pytest.raises(ValueError):
            Preview.configured(tmp_path)
    assert enable_notebook_display() is False
    assert html_table(pa.table({f"c{i}": [1] for i in range(9)}), columns=3).count("<th>") == 3


def test_names_and_display():
    assert cli.table_name("/x/2024-Data") == "t_2024_data"
    assert [cell(v) for v in (None, 1.5, 2.0, 1 / 3, b"\x01", "a")] == ["", "1.5", "2", "0.333333", "01", "a"]
    t = pa.table({"n": list(range(100))})
    assert text_table(t, 2).splitlines() == ["n", "-", "0", "1"]
    assert "75 more" in html_table(t) and html_table(t).count("<tr>") == 27
