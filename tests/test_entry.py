import builtins
import importlib
import sys

import __spark_entry__


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith(("corpus_pipeline", "chronofold.llm")):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert "panel_oos_rolling" in alone.queries() and not any(n.startswith("op") or n == "pipeline" for n in alone.queries())
