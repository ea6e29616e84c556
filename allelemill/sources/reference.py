"""Reference entries (rsid, chr, pos, ref, alt) as Parquet by build and chromosome."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builds import normalise_build
from ..functions.genome import with_chr
from ..operators.regions import RegionSet


#: Where the public reference entries lie, by build, and the names of their files there. Fixed values.
BASE_URL = "https://ftp.ncbi.nih.gov/snp/organisms"
BUILD_PATHS = {"b37": "human_9606_b151_GRCh37p13/VCF", "b38": "human_9606_b151_GRCh38p7/VCF"}
FILES = {"common": "00-common_all.vcf.gz", "all": "00-All.vcf.gz"}


def remote(build: str, kind: str = "common", base: str = BASE_URL) -> str:
    """The URL of the entries of a build: common ones or all."""
    build = normalise_build(build, False)
    if build not in BUILD_PATHS or kind not in FILES:
        raise ValueError(f"no {kind} entries of {build}; there are {', '.join(FILES)} of {', '.join(BUILD_PATHS)}")
    return f"{base}/{BUILD_PATHS[build]}/{FILES[kind]}"


def setup(spark: SparkSession, build: str, kind: str, downloads: str, folder: str, base: str = BASE_URL, attempts: int = 3) -> str:
    """Fetches the entries of a build into the folder of downloads, checked by digest, and puts them into the store."""
    from .download import fetch

    url, build = remote(build, kind, base), normalise_build(build, False)
    got = fetch(url, f"{downloads}/{FILES[kind].replace('.vcf', f'_{build}.vcf')}", f"{url}.md5", attempts)
    ingest(spark, got, folder, build)
    return got


def md5_matches(path: str, digest: str) -> bool:
    """A downloaded file is whole."""
    h = hashlib.md5()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest() == digest.split()[0].lower()


def ingest(spark: SparkSession, vcf: str, folder: str, build: str) -> None:
    """A VCF (text or block gzip) into the store: one folder per build and chromosome, sorted by position."""
    part = F.split("value", "\t")
    df = spark.read.text(vcf).where(~F.col("value").startswith("#")).select(
        with_chr(part[0]).alias("chr"), part[1].try_cast("int").alias("pos"), part[2].alias("rsid"), part[3].alias("ref"), part[4].alias("alt"),
        F.try_element_at(part, F.lit(6)).alias("qual"), F.try_element_at(part, F.lit(7)).alias("filter"), F.try_element_at(part, F.lit(8)).alias("info"), F.lit(normalise_build(build)).alias("build"),
    )
    df = df.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos")
    df.write.mode("append").partitionBy("build", "chr").parquet(folder)


def entries(spark: SparkSession, folder: str, build: str, regions: RegionSet | None = None) -> DataFrame:
    """The entries of a build, of some regions only if given: partitions and row groups are pruned."""
    df = spark.read.parquet(folder).where(F.col("build") == normalise_build(build))
    return regions.filter(df) if regions is not None else df
