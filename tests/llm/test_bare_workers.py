"""The operators' queries in a session whose workers don't find the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from tallyweave.session import build_session

spark = build_session("local[4]", 4)
found = []

def probe(frames):
    import importlib.util
    for frame in frames:
        yield frame.assign(id=int(importlib.util.find_spec("tallyweave") is not None))

assert spark.range(1).mapInPandas(probe, "id long").first()[0] == 0, "the workers find the package"
for name, query in entry.queries().items():
    if name.startswith("op"):
        print("RAN", name, query(spark, {folder!r}).count())
"""


def test_every_query_runs_where_the_package_is_not_installed(folder, tmp_path):
    script = tmp_path / "bare.py"
    script.write_text(SCRIPT.format(repo=REPO, folder=folder))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    ran = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("RAN")]
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(ran) == 13
