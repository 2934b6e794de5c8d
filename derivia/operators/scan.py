"""Scans of a table in key order by chunks, over a copy of its keys and hashes that is clustered by the key.

The copy is made once for a scan: range-partitioned and sorted by the key, in files of a few chunks at most,
whose rows are numbered. A chunk is a range of these numbers: it names the files that have it, and inside of
them Parquet's page index leaves out the rest. So all chunks together read the copy about once, where a
filter, sort and limit on the table would read all that is left for each.

A scan is described by a small dict (folder, first rank, and rows by file), which the catalog keeps; a scan
whose folder is gone is made anew from the cursor on. What changes in the table meanwhile is queued by the
capture of changes; a hash that is out of date is read anew at the claim.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.plans.state import listed, work_folder

#: Rows of a file of the copy at least.
LEAST_ROWS = 5_000


def clustered(keys: DataFrame, pk, chunk: int, base: int = 0) -> dict:
    """Write the copy of keys (the pk columns, row_key, row_order, source_hash); base: rows scanned before."""
    spark = keys.sparkSession
    path = f"{work_folder(spark)}/scan-{uuid.uuid4().hex}"
    order = [F.col(f"`{c}`") for c in pk]
    rows = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    half = max(1, chunk // 2)
    write = rows.withColumn("_row", F.monotonically_increasing_id()).write.option("maxRecordsPerFile", max(half, LEAST_ROWS))
    write.option("parquet.page.row.count.limit", max(100, half)).parquet(path)
    # a row for each file
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
    return {"path": path, "base": base, "files": [[r["file"].rsplit("/", 1)[1], r["first"], r["n"]] for r in files]}


def there(spark, scan: dict | None) -> bool:
    return scan is not None and (not scan["files"] or bool(listed(spark, scan["path"])))


def chunk_of(spark, scan: dict, scanned: int, chunk: int) -> tuple[DataFrame | None, int]:
    """The rows number scanned to scanned + chunk of the scan, from the files that have them, and how many they are."""
    rank, whole, parts, found = scan["base"], [], [], 0
    for name, first, n in scan["files"]:
        lo, hi = max(scanned, rank) - rank, min(scanned + chunk, rank + n) - rank
        if lo < hi:
            found += hi - lo
            if hi - lo == n:
                whole.append(f"{scan['path']}/{name}")
            else:
                parts.append((f"{scan['path']}/{name}", first + lo, first + hi - 1))
        rank += n
    if not found:
        return None, 0
    # files that are in it as a whole need no look at the numbers
    rows = [spark.read.parquet(*whole)] if whole else []
    if parts:
        mine = F.lit(False)
        for lo, hi in joined([(lo, hi) for _, lo, hi in parts]):
            mine = mine | F.col("_row").between(lo, hi)
        rows.append(spark.read.parquet(*[name for name, *_ in parts]).where(mine))
    return reduce(DataFrame.union, rows), found


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one."""
    out = [ranges[0]]
    for lo, hi in ranges[1:]:
        if lo == out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out
