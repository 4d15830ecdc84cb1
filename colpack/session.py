"""Preparing a session so that its Python workers find this package."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Put the folder that holds this package on the Python workers' path.

    Enough where workers see that folder (local mode, an installed package); elsewhere ship the
    package with --py-files.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, have)))
    return spark
