"""Workers import a module of queries on its own, when a function of it is sent to them."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(p.stem for p in (ROOT / "lineweave" / "plans").glob("*.py") if p.stem != "__init__"))
def test_module_comes_first(name):
    done = subprocess.run([sys.executable, "-c", f"import lineweave.plans.{name}"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
