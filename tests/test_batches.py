"""Tables that grow by batches: merge on read, removal, purge, broken and late writers."""

from pathlib import Path

import pytest

from tallyscope.sources import batches

LAYOUT = "k string, x int"


@pytest.fixture
def table(spark, tmp_path):
    class Table:
        path = str(tmp_path / "table")

        def add(self, *rows):
            batches.append(spark.createDataFrame(list(rows), LAYOUT), self.path)

        def drop(self, *keys):
            batches.remove(spark.createDataFrame([(k,) for k in keys], "who string"), self.path, "k")

        def keep(self, change):
            batches.replace(spark, self.path, LAYOUT, change, "k")

        def rows(self):
            df = batches.read(spark, self.path, LAYOUT, "k")
            assert df.columns == ["k", "x"]
            return sorted(((r["k"], r["x"]) for r in df.collect()), key=str)

        def folder(self, kind):
            return max(p for p in Path(self.path).iterdir() if f"-{kind}-" in p.name)

    return Table()


def test_no_folder_and_empty_batches(table):
    assert table.rows() == []
    table.add()
    table.drop()
    table.keep(lambda df: df)
    assert table.rows() == []


def test_removal_spares_later_rows_and_null_keys(table):
    table.add(("a", 1), ("b", 2), (None, 3), ("a", 1))
    table.drop("a", None, "z")
    table.add(("a", 4))
    assert table.rows() == [("a", 4), ("b", 2), (None, 3)]


def test_purge_keeps_old_files_and_what_comes_later(spark, table):
    table.add(("a", 1), ("b", 2))
    running = batches.read(spark, table.path, LAYOUT, "k")
    table.keep(lambda df: df.where("x > 1"))
    table.add(("c", 0))
    assert table.rows() == [("b", 2), ("c", 0)]
    assert running.count() == 2
    table.keep(lambda df: df.limit(0))
    assert table.rows() == []
    table.add(("a", 9))
    assert table.rows() == [("a", 9)]


@pytest.mark.parametrize("kind", ["rows", "keys", "whole"])
def test_half_written_batch_is_ignored(table, kind):
    table.add(("a", 1))
    before = table.rows()
    {"rows": lambda: table.add(("b", 2)), "keys": lambda: table.drop("a"), "whole": lambda: table.keep(lambda d: d.limit(0))}[
        kind
    ]()
    broken = table.folder(kind)
    (broken / "data" / "_SUCCESS").unlink()
    assert table.rows() == before
    # Its number is not used again.
    table.add(("c", 3))
    assert table.rows() == [*before, ("c", 3)]
    assert table.folder("rows").name > broken.name or kind == "whole"


@pytest.mark.parametrize("late", ["rows", "keys"])
def test_writer_that_ends_during_a_purge_is_not_lost(table, late):
    table.add(("a", 1), ("b", 2))
    table.add(("d", 5)) if late == "rows" else table.drop("a")
    mark = table.folder(late) / "data" / "_SUCCESS"
    # Number taken, not yet finished, while others append and purge.
    mark.unlink()
    table.add(("a", 7))
    table.keep(lambda df: df.where("x <> 2"))
    assert table.rows() == [("a", 1), ("a", 7)]
    mark.touch()
    assert table.rows() == ([("a", 1), ("a", 7), ("d", 5)] if late == "rows" else [("a", 7)])
