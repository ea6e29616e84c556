"""References to records that do not exist, or not at the time of the reference.

Method: references are pre-aggregated per key and period, which finds the heavy keys (at most ``1 / heavy_share`` of
them, whatever the size). Heavy keys are checked against a broadcast of their own entries, all other keys by a
shuffled anti-join, and both parts are united. Entries are first resolved through merges by pointer doubling.

Defined results: a reference whose key is null, empty or not of the required form is no reference. A null time counts
as not covered by any entry. An entry without a start is never valid; without an end it stays valid. Merge cycles and
merges into nothing leave the key without valid entry. Exact copies of entries count once; repeated references are
each reported. Empty tables give empty results. Further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..scale import at_most, cut, trimmed

RSID = r"^rs[0-9]+$"


def key_of(c: Column) -> Column:
    """A key without regard to letter case and white space around it."""
    return F.lower(trimmed(c))


def resolve_merges(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (src, dst) with dst at the end of the chain; sources that run into a cycle are left out.

    Pointer doubling: chains of length n take about log2(n) joins over the edges alone.
    """
    hops = cut(edges.filter("src is not null and dst is not null").distinct())
    n = hops.count()
    if not n:
        return hops
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        nxt = hops.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        step = hops.join(nxt, "dst", "left").select("src", F.coalesce("far", "dst").alias("dst"), F.col("far").isNotNull().alias("moved"))
        step = cut(step.groupBy("src", "dst").agg(F.max("moved").alias("moved")))
        moved = step.filter("moved").limit(1).count()
        hops = step.select("src", "dst")
        if not moved:
            return hops
    return hops.join(hops.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst")


def validity(entries: DataFrame) -> DataFrame:
    """entries(key, added_at, withdrawn_at, merged_into) -> spells(key, from_t, to_t), merges resolved, copies removed."""
    e = entries.select(
        key_of(F.col("key")).alias("key"), key_of(F.col("merged_into")).alias("dst"), F.col("added_at").alias("from_t"), F.col("withdrawn_at").alias("to_t")
    ).filter("key is not null and key <> ''")
    merged = e.filter("dst is not null and dst <> ''").select(F.col("key").alias("src"), "dst")
    ends = resolve_merges(merged)
    own = e.filter("dst is null or dst = ''").join(ends.select(F.col("src").alias("key")).distinct(), "key", "left_anti")
    own = own.filter("from_t is not null").groupBy("key", "from_t").agg(
        F.when(F.count(F.when(F.col("to_t").isNull(), 1)) > 0, F.lit(None)).otherwise(F.max("to_t")).alias("to_t")
    )
    via = ends.join(own.withColumnRenamed("key", "dst"), "dst").select(F.col("src").alias("key"), "from_t", "to_t")
    return own.unionByName(via)


def reference_rows(df: DataFrame, tbl: str, row_id: str, key: str, at: str, form: str = RSID) -> DataFrame:
    """(tbl, row_id, key, at) of the rows whose key has the required form."""
    return df.select(F.lit(tbl).alias("tbl"), F.col(row_id).cast("long").alias("row_id"), key_of(F.col(key)).alias("key"), F.col(at).alias("at")).filter(
        F.col("key").rlike(form)
    )


def per_period(refs: DataFrame) -> DataFrame:
    """References counted by table, key and calendar month, with their first and last time."""
    return refs.groupBy("tbl", "key", F.date_trunc("month", "at").cast("date").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


def heavy_keys(counts: DataFrame, heavy_share: float) -> list[str]:
    """Keys with at least that share of all references: at most 1 / heavy_share of them by construction."""
    seen = Observation()
    by_key = counts.groupBy("key").agg(F.sum("n").alias("n")).observe(seen, F.sum("n").alias("total"))
    top = by_key.orderBy(F.desc("n"), "key").limit(math.ceil(1 / heavy_share)).collect()
    return [r["key"] for r in top if r["n"] >= seen.get["total"] * heavy_share]


SALTS = 32  #: copies of the entries of heavy keys where those are too many to broadcast


def _uncovered(refs: DataFrame, spells: DataFrame) -> DataFrame:
    s = spells.select(F.col("key").alias("_k"), "from_t", "to_t", *[F.col("_salt").alias("_s") for c in spells.columns if c == "_salt"])
    hit = (F.col("key") == F.col("_k")) & (F.col("from_t") <= F.col("at")) & (F.col("to_t").isNull() | (F.col("at") < F.col("to_t")))
    return refs.join(s, hit & (F.col("_salt") == F.col("_s")) if "_s" in s.columns else hit, "left_anti")


def _split(df: DataFrame, spells: DataFrame, heavy: list[str], bound: int, check) -> DataFrame:
    """check(rows, spells) for the heavy keys over a broadcast, for all others over a shuffle; both united. If the heavy
    keys have more entries than ``bound``, their rows are dealt to salts and meet a copy of the entries in each."""
    if not heavy:
        return check(df, spells)
    is_heavy = F.col("key").isin(heavy)
    near, rows = spells.filter(is_heavy), df.filter(is_heavy)
    if at_most(near, bound):
        hot = check(rows, F.broadcast(near))
    else:
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        hot = check(dealt, near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return hot.select(*[c for c in hot.columns if c != "_salt"]).unionByName(check(df.filter(~is_heavy), spells.filter(~is_heavy)))


def orphan_references(refs: DataFrame, entries: DataFrame, heavy_share: float = 0.005, bound: int = 100_000) -> DataFrame:
    """Rows (tbl, row_id, key, at) of refs for which no entry is valid at that time."""
    spells = cut(validity(entries))
    heavy = heavy_keys(per_period(refs), heavy_share)
    return _split(refs, spells, heavy, bound, _uncovered)


def orphan_counts(refs: DataFrame, entries: DataFrame, heavy_share: float = 0.005, bound: int = 100_000) -> DataFrame:
    """(tbl, period, n_refs, n_orphans): settled on the pre-aggregated groups; only groups that an entry covers in part
    are looked at row by row."""
    spells = cut(validity(entries))
    counts = cut(per_period(refs))
    heavy = heavy_keys(counts, heavy_share)

    def judged(groups: DataFrame, s: DataFrame) -> DataFrame:
        salt = [c for c in s.columns if c == "_salt"]
        s = s.select(F.col("key").alias("_k"), "from_t", "to_t", *[F.col(c).alias("_s") for c in salt])
        meets = (F.col("_salt") == F.col("_s") if salt else F.lit(True)) & (F.col("key") == F.col("_k")) & (F.col("from_t") <= F.col("last_at")) & (F.col("to_t").isNull() | (F.col("first_at") < F.col("to_t")))
        covers = (F.col("from_t") <= F.col("first_at")) & (F.col("to_t").isNull() | (F.col("last_at") < F.col("to_t")))
        j = groups.join(s, meets, "left")
        return j.groupBy("tbl", "key", "period", "n").agg(
            F.max(F.coalesce(covers, F.lit(False))).alias("covered"), F.max(F.col("_k").isNotNull()).alias("met")
        )

    verdict = cut(_split(counts, spells, heavy, bound, judged))
    settled = verdict.select("tbl", "period", "n", F.when(F.col("covered"), 0).when(~F.col("met"), F.col("n")).otherwise(0).alias("orphans"))
    partly = verdict.filter("met and not covered").select("tbl", "key", F.col("period").alias("_period"))
    period = F.date_trunc("month", "at").cast("date")
    some = refs.withColumn("_period", period).join(partly, ["tbl", "key", "_period"], "left_semi")
    rows = _split(some, spells, heavy, bound, _uncovered).select("tbl", F.col("_period").alias("period"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("orphans"))
    return settled.unionByName(rows).groupBy("tbl", "period").agg(F.sum("n").alias("n_refs"), F.sum("orphans").alias("n_orphans"))
