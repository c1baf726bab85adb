"""The driver contract: every query runs, and names match its SQL."""

import __spark_entry__


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["chr", "track", "pos", "value"] and out.count() > 0


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 75


def test_the_rest_does_not_import_the_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(__spark_entry__.__file__).parent
    for p in (root / "helixplane").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p
