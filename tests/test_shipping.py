"""The scorer must run where executors cannot import this package."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scorer_runs_without_package_on_workers(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})          # driver only: workers start in {str(tmp_path)!r}
        from pyspark.sql import SparkSession, functions as F
        from cohortex.operators import similarity as SX
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").getOrCreate())
        v = spark.range(0, 50).select(F.col("id").alias("user_id"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
        seeds = spark.range(0, 5).select(F.lit(1).alias("request_id"), F.col("id").alias("user_id"))
        print("ROWS", SX.similar_users_centroid(v, seeds, 7).count())
    """)
    env = {k: val for k, val in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 7" in out.stdout, out.stderr[-2000:]
