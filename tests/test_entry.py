import importlib.util
from pathlib import Path

import pytest

spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)


def test_flagship_runs(spark):
    assert module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(module.oracle_sql()) <= set(module.queries())


def test_only_an_absent_module_is_tolerated(monkeypatch, tmp_path):
    assert module._present("corpus_pipeline_that_is_not_there") is None
    (tmp_path / "broken_one.py").write_text("import surely_not_installed\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        module._present("broken_one")
