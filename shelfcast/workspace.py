"""Where jobs put tables they write and read back."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the session's shared checkpoint folder.

    Executors on other machines must see it, so a machine-local folder is only
    accepted where the session itself is local.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shelfcast-")
    return f"{base.rstrip('/')}/shelfcast/{name}-{uuid4().hex}"
