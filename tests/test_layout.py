import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "affinia").rglob("*.py"):
        if "llm" not in p.parts:
            assert "affinia.llm" not in p.read_text(), p


def test_the_rest_works_without_it(tmp_path):
    import shutil

    for name in ("affinia", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=tmp_path, capture_output=True, text=True)
    asks = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and e.oracle_sql(); print(len(q))"
    out = run("-c", asks)
    assert out.returncode == 0, out.stderr
    (tmp_path / "corpus_pipeline.py").write_text("from affinia.llm import secrets\n")  # what stands beside the package goes with it
    assert run("-c", asks).returncode == 0
    (tmp_path / "corpus_pipeline.py").unlink()
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = run("-m", "pytest", "-q", "-p", "no:cacheprovider", "--collect-only", "tests")
    assert out.returncode == 0, out.stdout
    (tmp_path / "corpus_pipeline.py").write_text("from affinia.llm import secrets\n")
    rest = sorted(p.name for p in (tmp_path / "tests").glob("test_*.py") if p.name not in ("test_layout.py", "test_oracle.py"))  # the latter runs every query
    out = run("-m", "pytest", "-q", "-p", "no:cacheprovider", *[f"tests/{n}" for n in rest])
    assert out.returncode == 0, out.stdout
    out = run("-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_layout.py", "-k", "not without_it")
    assert out.returncode == 0, out.stdout


@pytest.mark.skipif(not (ROOT / "affinia" / "llm").exists(), reason="the corpus operators are not there")
def test_an_error_inside_the_subpackage_is_not_swallowed(tmp_path):
    import shutil

    for name in ("affinia", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    module = tmp_path / "affinia" / "llm" / "registry.py"
    future = "from __future__ import annotations\n"
    assert future in module.read_text()
    module.write_text(module.read_text().replace(future, future + "import no_such_library\n", 1))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_library" in out.stderr


def test_every_sql_has_a_query():
    from affinia.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) == sum(len(m.QUERIES) for m in catalogue._MODULES)


def test_names_say_what_they_cover():
    from affinia.plans import catalogue

    assert set(catalogue.queries()) >= catalogue.TRAPS
    assert catalogue.covered("g10_t9_pair_argmax") == ["G10", "trap 9"] and catalogue.covered("t9_seeded_sample") == ["T-9"]
    every = [c for q in catalogue.queries() for c in catalogue.covered(q)]
    missing = lambda kind, n, without=(): [i for i in range(1, n + 1) if f"{kind}{i}" not in every and i not in without]
    assert not missing("T-", 20) and not missing("W", 20) and not missing("J", 30) and not missing("U", 10) and not missing("P", 20)
    assert not missing("G", 36) and not missing("M", 36) and not missing("H", 27, {22}) and not missing("K", 19, {15})
    assert missing("S", 28) == [7, 27] or missing("S", 28) == [27]
