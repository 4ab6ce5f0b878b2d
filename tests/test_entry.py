import __spark_entry__ as entry


def test_entry_and_registry(spark):
    out = entry.entry(spark)
    assert out.count() == 15 and {"user_id", "# total", "assort", "assort Z"} <= set(out.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_only_a_missing_package_is_forgiven(monkeypatch):
    import builtins
    import importlib

    import pytest

    real = builtins.__import__

    def without(missing):
        def find(name, *args, **options):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named '{missing}'", name=missing)
            return real(name, *args, **options)

        return find

    with monkeypatch.context() as m:
        m.setattr(builtins, "__import__", without("corpus_pipeline"))
        importlib.reload(entry)
        assert not any(n.startswith("op") for n in entry.queries())
        m.setattr(builtins, "__import__", without("xxhash"))
        with pytest.raises(ModuleNotFoundError, match="xxhash"):
            importlib.reload(entry)
    importlib.reload(entry)
