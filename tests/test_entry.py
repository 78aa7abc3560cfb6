import glob
import os

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_needs_the_optional_subpackage():
    own = os.path.join(ROOT, "strandline", "llm")
    for path in glob.glob(os.path.join(ROOT, "strandline", "**", "*.py"), recursive=True):
        if not path.startswith(own):
            assert "strandline.llm" not in open(path).read(), path


def test_queries_and_sql_go_together(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100 - 25
    names = list(queries)
    assert names.index("p5_method") < names.index("p5_found")
    assert entry.entry(spark).columns == ["tag", "ts_ns", "value"]


def test_newest_points_are_read_from_new_batches_only(spark, tmp_path):
    from strandline.catalog import FLOAT, ColumnAttribute
    from strandline.sources.store import Config, Database

    db = Database(spark, Config(f"file://{tmp_path}/db"))
    db.create_table("f", ColumnAttribute("value", FLOAT))
    for i in range(4):
        db.write_batch("f", [("a", i, float(i)), (f"b{i}", i, 1.0)])
    assert db.query_latest("f", "a") == (3, 3.0) and db.query_latest("f", "b0") == (0, 1.0)
    folder = f"{tmp_path}/db/f/v0/newest"
    assert sorted(x for x in os.listdir(folder) if not x.startswith(".")) == ["3", "4"]  # the last two states
    os.remove(f"{tmp_path}/db/f/v0/data/batch=1/_SUCCESS")  # as if it weren't whole
    assert db.series("f").count() == 6
    db.write_batch("f", [("a", 9, 9.0)])
    assert db.query_latest("f", "a") == (9, 9.0) and db.query_latest("f", "b0") == (0, 1.0)
