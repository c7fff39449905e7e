"""The session's fixed settings.

Everything that changes an answer is set here; what only changes the plan's size (partitions, broadcast threshold) is
left to the cluster's own configuration unless a caller sets it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that answers depend on.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.binaryAsString": "true",
    "spark.sql.caseSensitive": "false",
}
#: Settings that only plans depend on: adaptive execution splits skewed joins and picks join sides at run time.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword names are settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SEMANTICS | PLANNING | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """Sets what answers depend on in a session that somebody else made."""
    for k, v in SEMANTICS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark
