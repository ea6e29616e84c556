"""Helpers that keep plans safe at scale: lineage cuts, checked broadcasts, shipping of the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: that of the session, else (single machine only) a new temporary one."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if named is None:  # local mode without a setting, as in tests: gone when the process ends
        named = tempfile.mkdtemp(prefix="allelemill-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application; the driver serves it to executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="allelemill-")) / "allelemill.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if df has no more than that many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int, megabytes: int = 64) -> DataFrame:
    """df with a broadcast hint if it has been measured to at most ``rows`` rows and about so many megabytes (as text), else
    as it is (Spark shuffles it); reads no more than needed to tell."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and (got["b"] or 0) <= megabytes << 20 else df


def trimmed(c: Column) -> Column:
    """Without white space (any Unicode kind) around it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
