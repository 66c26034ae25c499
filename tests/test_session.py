import os
import subprocess
import sys

SCRIPT = """
import os
from firnline.session import build_session, enable_checkpoints, landed, modified, release, scratch_path, shared_folder
spark = build_session(master="local[1]", spark__ui__enabled="false")
assert spark.conf.get("spark.checkpoint.dir", None) is None
path = scratch_path(spark, "t")
assert os.path.dirname(path) == shared_folder(spark) == shared_folder(spark)
spark.range(3).write.parquet(path)
enable_checkpoints(spark)
assert spark.read.parquet(path).checkpoint().count() == 3
written = []
def write(path):
    spark.range(2).write.parquet(path)
    written.append(path)
    return path
since = modified(spark, path)
first = landed(spark, "once", (path, since), write)
assert landed(spark, "once", (path, since), write) == first and written == [first]
assert landed(spark, "once", (path, since + 1), write) != first and len(written) == 2
release(spark)
assert not any(map(os.path.exists, [path, *written]))
assert landed(spark, "once", (path, since), write) != first
release(spark)
assert not os.path.exists(written[-1])
print("fine")
"""


def test_scratch_without_a_checkpoint_setting(tmp_path):
    """A plain local session finds a scratch folder of its own and keeps it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
