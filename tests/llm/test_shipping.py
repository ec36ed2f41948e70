"""Task code and models travel with the job: workers that can't import the package run every query."""

import os
import pathlib
import subprocess
import sys

from conftest import SMALL

ROOT = str(pathlib.Path(__file__).resolve().parents[2])

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import corpus_pipeline
from furrow import build_session
from furrow.llm.queries import QUERIES
sys.path.remove({root!r})
spark = build_session("ship", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                             "spark.driver.memory": "4g"}})
spark.sparkContext.setLogLevel("OFF")
def missing(batches):
    import importlib.util
    for batch in batches:
        yield batch.slice(0, 1 if importlib.util.find_spec("furrow") is None else 0)
assert spark.range(1).mapInArrow(missing, "id long").count() == 1, "workers find the package"
for name, query in {{**QUERIES, "pipeline": corpus_pipeline.run}}.items():
    try:
        query(spark, {folder!r}).write.format("noop").mode("overwrite").save()
        print("ran", name)
    except Exception as e:
        print("failed", name, str(e)[-900:])
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, folder=SMALL)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=900)
    lines = [x for x in done.stdout.splitlines() if x.startswith(("ran", "failed"))]
    assert not [x for x in lines if x.startswith("failed")] and len(lines) == 14, done.stdout[-3000:] + done.stderr[-3000:]
