import os
import subprocess
import sys
from pathlib import Path

# In a process of its own, as memory that earlier tests left free would hide what the fit takes.
SCRIPT = """
import re, sys
from pathlib import Path
from pyspark.sql import SparkSession
import corpus_pipeline

def own_mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

data, shared = "/root/testdata/sf0.1", sys.argv[1]
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    .config("spark.checkpoint.dir", shared).config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
before = own_mb()
corpus_pipeline.nontoxic(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
print("grown", own_mb() - before)
"""


def test_fit_gives_its_memory_back(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": ":".join(x for x in (root, os.environ.get("PYTHONPATH", "")) if x), "OMP_NUM_THREADS": "1"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert float(run.stdout.split("grown")[-1]) < 45
