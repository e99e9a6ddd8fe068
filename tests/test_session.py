"""The package as executors get it."""

import os
import subprocess
import sys

from pickwise.session import package_zip


def test_every_module_is_found_in_the_shipped_zip(tmp_path):
    """Executors without the repository import functions of query modules by name from the zip."""
    target = package_zip(str(tmp_path / "src.zip"))
    env = {**os.environ, "PYTHONPATH": target}
    for module in ("pickwise.plans.catalog.distill", "pickwise.sources.tables", "pickwise.operators.scoring", "pickwise.streaming.scoring"):
        done = subprocess.run([sys.executable, "-c", f"import {module} as m; print(m.__file__)"], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert "src.zip" in done.stdout
