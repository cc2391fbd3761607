"""Executors need not have the package: every numbered query runs where only the driver can import it."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # the driver alone: workers start from an empty folder
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") and name[2].isdigit() or name in ("ec_basket_trios", "ma_attribution_windows"):
        print(name, len(query(spark, "/root/testdata/sf0.001").collect()), flush=True)
"""


def test_queries_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "ec_", "ma_")))
    assert len([n for n in rows if n.startswith("op")]) == 13 and all(int(n) > 0 for n in rows.values())
