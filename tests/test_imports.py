"""Every module can be imported, and the driver's entry names its queries."""

import importlib
import pkgutil

import codelode


def test_modules():
    for m in pkgutil.walk_packages(codelode.__path__, "codelode."):
        importlib.import_module(m.name)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
