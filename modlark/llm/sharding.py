"""Sharding by fixed virtual slots.

Records are hashed into ``N_SLOTS`` slots, for good.  A versioned table maps
slots to shards; only that table is edited when shards are rebalanced, so a
rebalance moves whole slots and hashes no record again.  The map has one row
for each slot and version, and so has the table of bytes per slot: both are
small at any size of the input, and the edits are made on the driver.  A run
that is given a stored map starts from its latest version and appends what it
edits as the next one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlark.llm.scratch import Scratch

N_SLOTS = 8192
#: Repeated rows with more than this share of a shard's mean bytes are dealt over all slots.
HOT = 0.1
MAP = "version int, virtual_slot int, shard int"


_KEY = ["doc_id", "text_crc32", "size"]


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> np.ndarray:
    """Slots dealt out in turn: what is known before any bytes are."""
    return np.arange(n_slots) % n_shards


def rebalance(shard_of: np.ndarray, weight: np.ndarray, n_shards: int, tolerance: float = 1e-4) -> np.ndarray:
    """Edit a map until shards weigh about the same.

    Each step takes the heaviest and the lightest shard and moves the slot, or
    swaps the two slots, that bring them closest to each other.  A heaviest
    shard that no step makes lighter, as a slot over the mean does, is set
    aside.  It ends when the others differ by ``tolerance`` of the mean, which
    they do at some time, as every step brings two loads closer together.
    Slots of shards from ``n_shards`` on are dealt to the others first.
    """
    shard_of, aside = np.where(shard_of < n_shards, shard_of, np.arange(len(shard_of)) % n_shards), np.zeros(n_shards, bool)
    load = np.bincount(shard_of, weight, n_shards)
    while True:
        high, low = int(np.where(aside, -np.inf, load).argmax()), int(np.where(aside, np.inf, load).argmin())
        gap = load[high] - load[low]
        if aside.all() or gap <= tolerance * load.mean():
            break
        a, b = np.flatnonzero(shard_of == high), np.flatnonzero(shard_of == low)
        give, take = weight[a], np.append(weight[b], 0.0)
        order = np.argsort(take)
        want = give - gap / 2
        at = np.searchsorted(take[order], want)
        near = np.stack([np.clip(at - 1, 0, len(take) - 1), np.clip(at, 0, len(take) - 1)])
        off = np.abs(take[order][near] - want)
        best = np.unravel_index(off.argmin(), off.shape)
        x, y = int(best[1]), int(order[near[best]])
        moved = give[x] - take[y]
        if not 0 < moved < gap:
            aside[high] = True
            continue
        shard_of[a[x]] = low
        if y < len(b):
            shard_of[b[y]] = high
        load[high] -= moved
        load[low] += moved
    return shard_of


def map_table(spark: SparkSession, versions: dict[int, np.ndarray]) -> DataFrame:
    """Versions of the map as a table."""
    rows = [(v, s, int(shard)) for v, m in versions.items() for s, shard in enumerate(m)]
    return spark.createDataFrame(rows, MAP)


def stored_map(spark: SparkSession, path: str, n_slots: int) -> tuple[int, np.ndarray] | None:
    """Number and content of the latest version at ``path``; none if nothing is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = latest(spark.read.schema(MAP).parquet(path)).collect()  # n_slots rows
    found = np.full(n_slots, -1)
    for r in rows:
        found[r.virtual_slot] = r.shard
    if len(rows) != n_slots or (found < 0).any():
        raise ValueError(f"{path} has no map of {n_slots} slots")
    return rows[0].version, found


def latest(maps: DataFrame) -> DataFrame:
    """The slots of the highest version."""
    top = maps.agg(F.max("version").alias("version"))
    return maps.join(F.broadcast(top), "version")


def _slots(rows: DataFrame, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot."""
    weight, count = np.zeros(n_slots), np.zeros(n_slots, np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        weight[r.virtual_slot], count[r.virtual_slot] = r.bytes, r.n
    return weight, count


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Assign every document to one of ``n_shards`` shards of nearly equal bytes.

    Returns ``doc_id``, ``size`` (UTF-8 bytes of the text plus 16),
    ``text_crc32``, ``shard``, ``slot`` (the row's place in its shard, gapless
    from 0), ``virtual_slot`` and ``map_version``.  A slot is named by the hash
    of id and text; places are numbered within virtual slots, each of which
    starts where the one before it in the shard ends, so that no task holds a
    shard.  With ``map_path`` the map is stored there: its latest version is
    edited, and the edit appended as a new version, unless nothing changes.

    * Null text: size 16, the checksum of an empty text.  Null ids are spread
      by their texts; repeated rows get places next to each other, unless they
      have over ``HOT`` of a shard's bytes: then each has a slot of its own.
    * Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.keep(rows.withColumn("virtual_slot", F.pmod(F.xxhash64(*_KEY), F.lit(n_slots)).cast("int")), "rows")
    weight, count = _slots(rows, n_slots)
    share = HOT * weight.sum() / n_shards
    heavy = np.flatnonzero((weight > share) & (count > 1)).tolist()  # n_shards / HOT at most
    if heavy:
        repeated = rows.where(F.col("virtual_slot").isin(heavy)).groupBy(*_KEY).agg(F.count("*").alias("n"))
        hot = scratch.keep(repeated.where((F.col("n") > 1) & (F.col("n") * F.col("size") > share)).select(*(F.col(c).alias(f"hot_{c}") for c in _KEY)), "hot")
        if not hot.isEmpty():
            same = rows["doc_id"].eqNullSafe(hot["hot_doc_id"]) & (rows["text_crc32"] == hot["hot_text_crc32"]) & (rows["size"] == hot["hot_size"])
            salted = F.pmod(F.xxhash64(*_KEY, "uid"), F.lit(n_slots)).cast("int")
            rows = rows.join(F.broadcast(hot), same, "left").withColumn("virtual_slot", F.when(F.col("hot_size").isNull(), F.col("virtual_slot")).otherwise(salted)).select(*_KEY, "virtual_slot")
            weight, count = _slots(rows, n_slots)
    map_path = map_path or f"{scratch.root}/slot_map"
    stored = stored_map(spark, map_path, n_slots)
    version, before = stored or (0, first_map(n_shards, n_slots))
    shard_of, base = rebalance(before, weight, n_shards), np.zeros(n_slots, np.int64)
    new = {} if stored else {0: before}
    if (shard_of != before).any():
        new[version := version + 1] = shard_of
    if new:
        map_table(spark, new).coalesce(1).write.mode("append").parquet(map_path)
    maps = spark.read.schema(MAP).parquet(map_path).where(F.col("version") == version)
    for s in range(n_shards):
        own = np.flatnonzero(shard_of == s)
        base[own] = np.cumsum(count[own]) - count[own]
    begin = spark.createDataFrame([(s, int(b)) for s, b in enumerate(base)], "virtual_slot int, begin long")
    placed = F.broadcast(maps.join(begin, "virtual_slot"))  # n_slots rows
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(placed, "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("place")).cast("long").alias("slot"), "virtual_slot", F.col("version").alias("map_version"))
