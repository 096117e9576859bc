"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs to the end through Spark's noop sink, three times after a warm-up; the
median counts, and times include planning.  ``rates`` are input rows a second.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import functions as F

from tesserae.catalog import QUERIES
from tesserae.operators import seal, verify
from tesserae.session import local_session, materialize
from tesserae.sources.carriers import owner_id, vector_blocks
from tesserae.sources.keyring import keyring

HEADLINE = (
    "hmac_tag", "seal_records", "verify_records", "repair_records", "records_recoverability", "seal_blocks", "verify_blocks",
    "recoverability", "repair_blocks", "restore_exact", "identify", "inject_region", "ssim", "recovery_metrics", "descriptor_dct",
    "descriptor_mode", "rd_curve", "library_upsert", "byte_identical", "manifest_verify", "format_census",
)
RUNS = 3
MANY_BLOCKS = 200_000
#: Queries whose rate is shown, and the table they take whole.
RATED = {"hmac_tag": "lineitem", "verify_records": "lineitem", "seal_records": "orders", "repair_records": "events", "seal_blocks": "embeddings"}


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def many_blocks(spark, folder: str):
    """At least MANY_BLOCKS blocks: the folder's vectors under as many names as that takes."""
    blocks = vector_blocks(spark, folder)
    copies = -(-MANY_BLOCKS // blocks.count())
    named = blocks.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("stem", F.concat_ws("-", "stem", "_i"))
    return materialize(named.withColumn("owner_id", owner_id(F.col("stem"), F.col("height"), F.col("width"), F.col("block"))).drop("_i"))


def rates_of_many(spark, folder: str) -> dict[str, int]:
    """Blocks a second when sealing and verifying many; beside the headline total, not part of it."""
    ring, blocks = keyring(spark), many_blocks(spark, folder)
    n = blocks.count()
    start = time.perf_counter()
    sealed = materialize(seal.seal(blocks, ring, "B"))
    sealing = time.perf_counter() - start
    start = time.perf_counter()
    verify.localize(verify.check_tags(seal.as_received(sealed), ring, "B")).write.format("noop").mode("overwrite").save()
    return {"seal_many_blocks": round(n / sealing), "verify_many_blocks": round(n / (time.perf_counter() - start))}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tesserae-bench")
    for name in ("blocks_crop", "verify_blocks", "descriptor_dct"):   # start JVM code paths and Python workers
        run(spark, folder, name)
    times = {name: round(median(run(spark, folder, name) for _ in range(RUNS)), 3) for name in HEADLINE}
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in set(RATED.values())}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "rates": {name: round(rows[t] / times[name]) for name, t in RATED.items()} | rates_of_many(spark, folder),
    }))


if __name__ == "__main__":
    main()
