"""A ledger of every id ever seen that stays small in files, whatever the number of batches.

Each batch adds a run: its new ids, one sorted file per hash bucket. When ``fan`` runs of one
level have gathered they are merged into a run of the next level, so a bucket has fewer than
``fan`` files a level, and levels grow with the logarithm of the batches. Merged runs
carry a Bloom filter per bucket in blocks of 32,768 bits: a batch opens only the
buckets of runs that may hold one of its ids.

The runs in force after a batch are listed in a manifest named after it. A batch reads the
manifest of the batch before, and writes only below folders named after itself, the manifest
last; repeated after a loss at any point, in the middle of a merge included, it writes the
same again. Runs that a merge has replaced are deleted one batch later, when no
repetition can ask for them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.session import broadcast_within

BLOCK_BITS = 32_768
BITS_PER_ID = 12
PROBES = 6
IDS = "ticket_id string, bucket int"
BLOOMS = "parts bigint, block bigint, bits binary, bucket int"


@dataclass(frozen=True)
class Run:
    """Sorted ids of batches ``first`` to ``last`` in the folder ``name``."""

    name: str
    level: int
    first: int
    last: int


def _hash(salt: int) -> Column:
    return F.xxhash64("ticket_id", F.lit(salt))


def _places() -> Column:
    """Where an id's bits lie in its block."""
    return F.array(*[F.pmod(_hash(i + 1), F.lit(BLOCK_BITS)) for i in range(PROBES)])


def _is_set(bits: Column, place: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return F.getbit(octet, (place % 8).cast("int")) == 1


@dataclass(frozen=True)
class IdLedger:
    """The ledger below ``folder``."""

    folder: str
    buckets: int = 64
    fan: int = 8

    def bucket(self) -> Column:
        return F.pmod(_hash(0), F.lit(self.buckets)).cast("int")

    def _path(self, spark: SparkSession, name: str = "") -> JavaObject:
        return spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self, spark: SparkSession) -> JavaObject:
        return self._path(spark).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self, spark: SparkSession) -> list[int]:
        """Batches that have a manifest; older ones than the last two are deleted as batches go on."""
        files, found = self._files(spark), self._path(spark, "manifest")
        if not files.exists(found):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(found) if s.getPath().getName().isdigit())

    def runs(self, spark: SparkSession, before: int) -> list[Run]:
        """The runs in force when batch ``before`` begins."""
        earlier = [n for n in self._manifests(spark) if n < before]
        if not earlier:
            return []
        rows = spark.read.text(f"{self.folder}/manifest/{earlier[-1]}").collect()  # a line per run
        return [Run(**json.loads(r.value)) for r in rows]

    def _write_manifest(self, spark: SparkSession, batch: int, runs: Iterable[Run]) -> None:
        out = self._files(spark).create(self._path(spark, f"manifest/{batch}"), True)
        out.write(bytearray("".join(json.dumps(asdict(r)) + "\n" for r in runs).encode()))
        out.close()

    def _read(self, spark: SparkSession, places: Iterable[tuple[Run, int]]) -> DataFrame | None:
        """Ids of some buckets of some runs, of the folders that exist."""
        files = self._files(spark)
        paths = [f"{r.name}/bucket={b}" for r, b in places]
        paths = [f"{self.folder}/{p}" for p in paths if files.exists(self._path(spark, p))]
        return spark.read.schema("ticket_id string").parquet(*paths) if paths else None

    def known(self, ids: DataFrame, batch: int) -> DataFrame:
        """Of the distinct ``ids`` (``ticket_id``, no nulls) those of earlier batches may be among ``(ticket_id, known)``."""
        spark = ids.sparkSession
        runs = self.runs(spark, batch)
        nothing = spark.createDataFrame([], "ticket_id string, known boolean")
        if not runs:
            return nothing
        keyed = ids.where("ticket_id IS NOT NULL").select("ticket_id", self.bucket().alias("bucket"))
        touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most all buckets
        wanted = [(r, b) for r in runs if r.level == 0 for b in touched]
        merged = [r for r in runs if r.level > 0]
        if merged and touched:
            wanted += self._may_hold(keyed, merged, touched)
        found = self._read(spark, wanted)
        return nothing if found is None else found.select("ticket_id", F.lit(True).alias("known"))

    def _may_hold(self, keyed: DataFrame, merged: list[Run], touched: list[int]) -> list[tuple[Run, int]]:
        spark = keyed.sparkSession
        blooms = None
        for at, run in enumerate(merged):
            part = spark.read.schema(BLOOMS).parquet(f"{self.folder}/{run.name}.blooms")
            part = part.where(F.col("bucket").isin(touched)).withColumn("run", F.lit(at))
            blooms = part if blooms is None else blooms.unionByName(part)
        # A row per run and bucket says into how many blocks the bucket's ids are dealt.
        sizes = F.broadcast(blooms.select("run", "bucket", "parts").distinct())
        asked = keyed.join(sizes, "bucket").select(
            "run", "bucket", F.pmod(_hash(-1), F.col("parts")).alias("block"), _places().alias("places")
        )
        held = asked.join(blooms.select("run", "bucket", "block", "bits"), ["run", "bucket", "block"])
        hit = held.where(F.forall("places", lambda p: _is_set(F.col("bits"), p)))
        return [(merged[r.run], r.bucket) for r in hit.select("run", "bucket").distinct().collect()]

    def add(self, fresh: DataFrame, batch: int) -> None:
        """Add the distinct new ids of a batch (``ticket_id``), and merge what has gathered."""
        spark = fresh.sparkSession
        before = self.runs(spark, batch)
        run = Run(f"run-{batch}-0", 0, batch, batch)
        self._write_run(fresh.select("ticket_id", self.bucket().alias("bucket")), run)
        runs, level = [*before, run], 0
        while len(gathered := [r for r in runs if r.level == level]) >= self.fan:
            level += 1
            merged = Run(f"run-{batch}-{level}", level, min(r.first for r in gathered), max(r.last for r in gathered))
            held = None
            for r in gathered:
                part = spark.read.schema(IDS).parquet(f"{self.folder}/{r.name}")
                held = part if held is None else held.unionByName(part)
            self._write_run(held, merged)
            self._write_blooms(spark, merged)
            runs = [r for r in runs if r.level != level - 1] + [merged]
        self._write_manifest(spark, batch, runs)
        self._forget(spark, batch, {r.name for r in [*before, *runs]})

    def _write_run(self, ids: DataFrame, run: Run) -> None:
        dealt = ids.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "ticket_id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{run.name}")

    def _write_blooms(self, spark: SparkSession, run: Run) -> None:
        ids = spark.read.schema(IDS).parquet(f"{self.folder}/{run.name}")
        sizes = ids.groupBy("bucket").agg(F.ceil(F.count("*") * BITS_PER_ID / BLOCK_BITS).cast("bigint").alias("parts"))
        blocks = ids.join(broadcast_within(sizes), "bucket").select(
            "bucket", "parts", F.pmod(_hash(-1), F.col("parts")).alias("block"), F.explode(_places()).alias("place")
        )
        bits = blocks.groupBy("bucket", "parts", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
        bits.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{run.name}.blooms")

    def _forget(self, spark: SparkSession, batch: int, needed: set[str]) -> None:
        """Delete what neither this batch nor a repetition of it reads."""
        files = self._files(spark)
        for status in files.listStatus(self._path(spark)):
            name = status.getPath().getName()
            stem = name.removesuffix(".blooms")
            if stem.startswith("run-") and stem not in needed and int(stem.split("-")[1]) < batch:
                files.delete(status.getPath(), True)
        for old in self._manifests(spark)[:-2]:
            files.delete(self._path(spark, f"manifest/{old}"), True)
