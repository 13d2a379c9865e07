"""The package as executors see it."""

import subprocess
import sys

from pyspark import cloudpickle

from sheetspark.operators import audit
from sheetspark.session import ensure_checkpoint_dir


def test_worker_functions_need_no_package_on_the_executor(tmp_path):
    payload = tmp_path / "function.pickle"
    payload.write_bytes(cloudpickle.dumps(audit._masked))
    code = f"import pickle; print(pickle.load(open({str(payload)!r}, 'rb'))({{'token': 1, 'a': [2]}}))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip().endswith("{'token': '***MASKED***', 'a': [2]}"), done.stderr


def test_checkpoint_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert configured in ensure_checkpoint_dir(spark)
