"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator here relies on.

    ``conf`` keys use ``__`` for dots: ``spark__sql__shuffle__partitions=8``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach.

    Taken from ``spark.checkpoint.dir``. Only where that is unset (tests, a
    laptop) a folder on this machine is made and set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        context.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Bytes of bytecode from which on the JVM leaves a method uncompiled.
COMPILED_METHOD = 8000


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Actions inside run no generated method that is too long for the JVM's compiler.

    Spark puts all expressions of a projection into one method of the stage. That of 40 expressions is interpreted, some
    20 times slower; above this limit Spark splits it. A lower limit of the session stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    if before is None or int(before) > COMPILED_METHOD:
        spark.conf.set(name, str(COMPILED_METHOD))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
