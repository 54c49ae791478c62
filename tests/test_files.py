"""Documents as files, one each."""

import pytest

from versoscan.sources import files


def test_documents_are_written_at_their_names(spark, tmp_path):
    """Each file stands at its own name, without folders or files of a sink's own, and is read back whole."""
    rows = [("a/b=1.md", "一\n二"), ("a/2.txt", ""), ("c/3 x+y%.md", None)]
    files.write_documents(spark.createDataFrame(rows, "file string, text string"), str(tmp_path / "d"))
    files.write_documents(spark.createDataFrame(rows, "file string, text string"), str(tmp_path / "d"))
    found = sorted(str(p.relative_to(tmp_path / "d")) for p in (tmp_path / "d").rglob("*") if p.is_file())
    assert found == sorted(name for name, _ in rows)
    got = {r.doc_id.partition("/d/")[2]: r.text for r in files.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {name: f"{text or ''}\n" for name, text in rows}


ODD = {"a.md": "x\ny\n", ".hid/b.md": "b", "_c.txt": "c", "empty.md": "", "生成 x+y%41%/d 1.md": "d", "s/t/u/v/e.md": "e\r\n", "s/t/f.txt": "﻿f", "s/no.rst": "no", "build/g.md": "g"}


@pytest.fixture
def odd(tmp_path):
    for name, text in ODD.items():
        (at := tmp_path / "odd %" / name).parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    return str(tmp_path / "odd %")


def test_driver_holds_no_file_names(spark, odd):
    """The files of a directory are listed and read by tasks: the plan has a checkpoint of their names, no list of files."""
    read = files.read_documents(spark, odd)
    assert read.inputFiles() == [] and read.count() == 7


def test_every_file_below_is_read(spark, odd):
    """Also empty files and names that begin with a dot or an underscore, which the walk of a directory finds."""
    below = lambda df: {r.doc_id.partition("/odd %/")[2]: r.text for r in df.collect()}
    want = {name: text for name, text in ODD.items() if name != "s/no.rst"}
    assert below(files.read_documents(spark, odd, use_defaults=False)) == want
    assert below(files.read_documents(spark, odd, ["s/t/u"])) == {name: text for name, text in want.items() if name not in ("build/g.md", "s/t/u/v/e.md")}
    assert files.read_documents(spark, odd, ["*"]).count() == 0
    rows = [(f"x{k}/{k}.md", "t" * k) for k in range(600)]
    files.write_documents(spark.createDataFrame(rows, "file string, text string"), f"{odd}/many/é %")
    assert below(files.read_documents(spark, f"{odd}/many")) == {f"many/é %/{name}": f"{text}\n" for name, text in rows}


def test_rounds_of_a_listing(spark, odd):
    """Directories that a task hands on are opened in the next round."""
    want = sorted((f"/{name}", len(text.encode())) for name, text in ODD.items() if name != "s/no.rst")
    for walk in (1, 3, files.WALK):
        assert sorted(map(tuple, files.listed(spark, files.uri_of(spark, odd), walk).collect())) == want


def test_stores_that_only_spark_reads(spark, odd, monkeypatch):
    monkeypatch.setattr(files, "is_open_to_tasks", lambda uri: False)
    got = {r.doc_id.partition("/odd %/")[2]: r.text for r in files.read_documents(spark, odd).collect()}
    assert got == {name: text for name, text in ODD.items() if text and name.endswith(("md", "txt")) and name[0] not in "._" and "build" not in name}


def test_excluded_files_are_counted_by_tasks(spark, odd):
    """Names with a percent sign are taken as they are, and no list of files comes to the driver."""
    counted = files.excluded_files(spark, odd, ["s/t/u", "*41%"])
    assert counted.inputFiles() == [] and tuple(counted.first()) == (odd, 8, 3)
    assert tuple(files.excluded_files(spark, f"{odd}/生成 x+y%41%/d 1.md").first())[1:] == (1, 0)


def test_excluded_files_in_stores_that_only_spark_reads(spark, odd, monkeypatch):
    monkeypatch.setattr(files, "is_open_to_tasks", lambda uri: False)
    assert tuple(files.excluded_files(spark, odd, ["s/t/u", "*41%"]).first()) == (odd, 5, 3)
