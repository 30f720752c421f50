"""The driver's contract: stable entry points, and nothing but the entry file knows the training-data subpackage."""

import pathlib
import re

import __spark_entry__

ROOT = pathlib.Path(__file__).parent.parent


def test_subpackage_stands_alone():
    for f in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"graphloom\.llm|from \.+llm|import llm", f.read_text()), f


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["canonical_key", "kind", "display_name"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
