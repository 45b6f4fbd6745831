"""Rules that hold for the package as a whole."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def sources():
    return [(p, p.read_text()) for p in (ROOT / "wavetally").rglob("*.py")]


def test_no_package_imports_inside_functions():
    # functions travel to executors by value; the package is not installed there
    late = [p.name for p, text in sources() if re.search(r"^[ \t]+(from|import) wavetally", text, re.M)]
    assert late == []


def test_no_local_checkpoints():
    assert [p.name for p, text in sources() if "localCheckpoint" in text] == []
