"""Files that executors read and write: bounded rows at a time, and order within folders."""

import pandas as pd

import __spark_entry__
from ledgerlake.sources import text


def test_directives_come_one_by_one():
    """a reader need not hold what a file holds, and reads the same."""
    source = 'option "title" "T"\n\n2024-01-01 open Assets:A\npushtag #t\n' + "".join(f'2024-01-02 * "a\n2024-01-09 b {k}"\n  Assets:A  {k} USD\n  Assets:B\n' for k in range(50)) + 'nonsense "\npoptag #t\n2024-01-03 * "end"\n  Assets:A  1 USD ; "x\n'
    out = text.Parsed()
    stream = text.read_directives(source, "f", out)
    assert next(stream)["type"] == "open" and next(stream)["narration"] == "a\n2024-01-09 b 0" and not out.directives
    rest, whole = list(stream), text.parse_text(source, "f")
    assert [d["postings"] for d in rest] == [d["postings"] for d in whole.directives[2:]] and len(whole.directives) == 51
    assert out.diagnostics == whole.diagnostics and len(whole.diagnostics) == 1 and list(text._lines("a\n\nb\n")) == "a\n\nb\n".split("\n")


def test_read_files_hands_on_few_rows(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"{k}.ledger").write_text("".join(f'2024-01-0{k + 1} * "n"\n  Assets:A  {i} USD\n  Assets:B  -{i} USD\n' for i in range(400)))
    sizes, make = [], pd.DataFrame
    monkeypatch.setattr(text, "ROWS", 100)
    monkeypatch.setattr(text.pd, "DataFrame", lambda rows, columns: sizes.append(len(rows)) or make(rows, columns=columns))
    df = make([(f"{k}.ledger", (tmp_path / f"{k}.ledger").read_bytes()) for k in range(3)], columns=["path", "content"])
    got = list(text.read_rows(iter([df])))
    assert sum(map(len, got)) == 2400 and max(sizes) <= 102
    monkeypatch.undo()
    assert text.read_files(spark, str(tmp_path)).count() == 2400


def test_routed_files_are_read_back_without_lists(spark):
    """F8: no row collects a folder's postings."""
    df = __spark_entry__.queries()["k7_routed_files"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = df.collect()
    assert all(r["sorted"] for r in rows) and sum(r["n"] for r in rows) == 2 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
