import builtins

import __spark_entry__ as entry
import pytest
from granary.plans import ORACLES, QUERIES


def without(monkeypatch, name):
    real = builtins.__import__

    def fake(module, *args, **kwargs):
        if module == name:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(module, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", fake)


@pytest.mark.parametrize("name", ["corpus_pipeline", "granary.llm"])
def test_other_queries_stay_without_the_training_data_operators(monkeypatch, name):
    without(monkeypatch, name)
    assert set(entry.queries()) == set(QUERIES) and entry.oracle_sql() == ORACLES


def test_other_import_errors_are_seen(monkeypatch):
    def broken():
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda m, *a, **k: broken() if m in ("corpus_pipeline", "granary.llm") else real(m, *a, **k))
    with pytest.raises(ModuleNotFoundError, match="numpy"):
        entry.queries()
