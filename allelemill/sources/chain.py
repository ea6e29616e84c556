"""Chain files: the blocks that map one reference build onto another."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.builds import normalise_build

SCHEMA = "chr string, start int, end int, width int, new_chr string, off int, rev boolean"


def blocks(lines: Iterable[str]) -> Iterator[tuple]:
    """Rows (chr, start, end, width, new_chr, off, rev) of a chain text; ValueError if it has no chain."""
    head: dict | None = None
    any_head = False
    t = q = 0  # consumed so far of target and query

    for line in lines:
        part = line.split()
        if not part or part[0].startswith("#"):
            continue
        if part[0] == "chain":
            if len(part) < 12:
                raise ValueError(f"bad chain header: {line.strip()}")
            head = {"chr": part[2], "t": int(part[5]), "new": part[7], "size": int(part[8]), "rev": part[9] == "-", "q": int(part[10])}
            any_head, t, q = True, 0, 0
            continue
        if head is None:
            raise ValueError("a block before the first chain header")
        width = int(part[0])
        start = head["t"] + t + 1
        end = start + width - 1
        there = head["q"] + q  # 0-based start of the block on the query strand
        # forward: position - off; reverse: end - off is where the first position of the block lies
        off = end - (head["size"] - there) if head["rev"] else head["t"] + t - there
        yield head["chr"], start, end, width, head["new"], off, head["rev"]
        if len(part) >= 3:
            t += width + int(part[1])
            q += width + int(part[2])
    if not any_head:
        raise ValueError("no chain header found")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """A chain file (text or gzip, a few MB) as a table."""
    with (gzip.open if str(path).endswith(".gz") else open)(path, "rt") as f:
        return spark.createDataFrame(list(blocks(f)), SCHEMA)


#: Where public chain files lie and what builds are called there. Fixed values.
BASE_URL = "https://hgdownload.soe.ucsc.edu/goldenPath"
UCSC = {"b36": "hg18", "b37": "hg19", "b38": "hg38"}


def remote(source: str, target: str, base: str = BASE_URL) -> str:
    """The URL of the chain file from one build to another."""
    a, b = (UCSC[normalise_build(x, False)] for x in (source, target))
    return f"{base}/{a}/liftOver/{a}To{b[0].upper()}{b[1:]}.over.chain.gz"


class ChainStore:
    """A folder of chain tables as Parquet, one per pair of builds. With ``download`` a missing one is fetched."""

    def __init__(self, spark: SparkSession, folder: str, download: bool = False, base: str = BASE_URL) -> None:
        self.spark, self.folder, self.download, self.base = spark, folder, download, base

    def _path(self, source: str, target: str) -> str:
        return f"{self.folder}/{normalise_build(source, False)}_to_{normalise_build(target, False)}.parquet"

    def register(self, source: str, target: str, path: str, force: bool = False) -> DataFrame:
        """Parses a chain file once and keeps its table; one that is there already is kept unless force."""
        out = self._path(source, target)
        if force or not Path(out).exists():
            read_chain(self.spark, path).coalesce(1).write.mode("overwrite").parquet(out)
        return self.get(source, target)

    def get(self, source: str, target: str) -> DataFrame:
        out = self._path(source, target)
        if not Path(out).exists() and self.download:
            from .download import fetch

            url = remote(source, target, self.base)
            return self.register(source, target, fetch(url, f"{self.folder}/{url.rsplit('/', 1)[1]}"))
        if not Path(out).exists():
            raise FileNotFoundError(f"no chain table from {source} to {target}; register one")
        df = self.spark.read.parquet(out)
        if set(df.columns) != {x.split()[0] for x in SCHEMA.split(", ")}:
            raise ValueError(f"{out} is no chain table; register it again with force")
        return df

    def clear(self) -> None:
        import shutil

        for p in Path(self.folder).glob("*_to_*.parquet"):
            shutil.rmtree(p)
