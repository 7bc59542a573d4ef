import __spark_entry__ as e


def test_names_and_sql_agree():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert all(callable(f) for f in q.values())


def test_library_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(e.__file__).parent / "pointloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts[:1]:
            assert not re.search(r"(from|import) .*\bllm\b", p.read_text()), p
