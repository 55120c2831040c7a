"""Jobs started outside the repository folder find the package in their Python workers."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from corpuslens.session import build_session
spark = build_session("local[2]", 2, extra={{"spark.checkpoint.dir": {ckpt!r}, "spark.driver.memory": "2g"}})
{body}
spark.stop()
"""


def run_elsewhere(tmp_path, body):
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(repo=str(REPO), ckpt=str(tmp_path / "ckpt"), body=body))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_labelling_and_encoding_elsewhere(tmp_path):
    out = run_elsewhere(tmp_path, """
from corpuslens.plans import posts
from corpuslens.operators import subword as SW
print("labelled", posts.batch_label(spark, "/root/testdata/sf0.001").count())
words = spark.createDataFrame([("abab", 3), ("abc", 2)], "word string, n long")
merges = SW.learn_merges(words, 4)
print("ids", SW.encode(words, "word", ["word"], merges, SW.vocabulary(words, merges)).count())
""")
    assert "labelled 200" in out and "ids 2" in out
