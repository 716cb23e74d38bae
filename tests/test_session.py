"""The package reaches executors that cannot import it, and intermediate tables need a named folder on a cluster."""

import os
import subprocess
import sys
import textwrap

import pytest

from windowlab import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_get_the_package(tmp_path):
    """Started in another folder and with the path set in the driver only, tasks still import the package."""
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from windowlab.session import build_session
        spark = build_session("ship", master="local[2]", partitions=2)
        from windowlab.operators import resample
        d = spark.createDataFrame([("s", i % 2, float(i), float(i * i % 7), str(i)) for i in range(40)], "domain string, label int, a double, b double, k string")
        print("REPLICATES", resample.separation(resample.bootstrap_grams(d, ["a", "b"], "label", "domain", ["k"], 5, 1), 2).count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "REPLICATES 5" in out.stdout, out.stderr[-2000:]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
