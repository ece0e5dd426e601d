"""Sharding by fixed virtual slots, in DataFrame functions only.

Every record is hashed into one of thousands of virtual slots; bytes are summed per slot; a
versioned slot-to-shard map, one row per slot, says where each slot lives.  Rebalancing edits the
map and never rehashes records, so only the slots that the edit names move.  The map has
``n_slots`` rows whatever the input, so it is the one thing handled on the driver and broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch

N_SLOTS = 8192
ROW_OVERHEAD = 8
#: A slot map is broadcast, so its size is bounded.
MAX_SLOTS = 1 << 17


def virtual_slot(columns: list[Column], n_slots: int = N_SLOTS) -> Column:
    """The slot of a record: a hash of the given columns. Repeated rows meet in one slot."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, CRC and virtual slot of every record. A null text has no bytes; a null id hashes
    with its text, so that rows without an id still spread."""
    if not 0 < n_slots <= MAX_SLOTS:
        raise ValueError(f"n_slots must lie in 1..{MAX_SLOTS}")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    crc = F.crc32(raw).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"), crc.alias("text_crc32")).withColumn("virtual_slot", virtual_slot([F.col("doc_id"), F.col("text_crc32")], n_slots))


def slot_loads(recs: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most ``MAX_SLOTS`` rows come to the driver."""
    got = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r[0], r[1], r[2]) for r in got)


def initial_map(n_slots: int, n_shards: int) -> dict[int, int]:
    """Version 0: slots dealt round-robin."""
    return {s: s % n_shards for s in range(n_slots)}


def rebalance(current: dict[int, int], loads: list[tuple[int, int, int]], n_shards: int, tolerance: float = 0.0) -> dict[int, int]:
    """Edits a map until no shard exceeds the mean by more than ``tolerance`` of it, where
    moves can achieve that: overfull shards give up slots, largest first, and each goes to
    the lightest shard. With a new shard count the added shards start empty and only fill."""
    size = {s: b for s, b, _ in loads}
    total = [0] * n_shards
    owned: dict[int, list[int]] = {k: [] for k in range(n_shards)}
    loose = []
    for slot, shard in current.items():
        if shard < n_shards:
            total[shard] += size.get(slot, 0)
            owned[shard].append(slot)
        else:
            loose.append(slot)
    mean = sum(size.values()) / n_shards
    for shard in range(n_shards):
        for slot in sorted(owned[shard], key=lambda s: (size.get(s, 0), s)):
            if total[shard] <= mean * (1 + tolerance):
                break
            total[shard] -= size.get(slot, 0)
            loose.append(slot)
    out = {s: k for s, k in current.items() if k < n_shards} | {s: -1 for s in loose}
    heap = [(b, k) for k, b in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-size.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size.get(slot, 0), shard))
    return _swap(out, size, n_shards)


def _swap(current: dict[int, int], size: dict[int, int], n_shards: int, rounds: int = 200) -> dict[int, int]:
    """Final moves from the heaviest to the lightest shard while one slot narrows their gap."""
    out, owned, total = dict(current), {k: [] for k in range(n_shards)}, [0] * n_shards
    for slot, shard in out.items():
        if size.get(slot, 0):
            owned[shard].append(slot)
            total[shard] += size[slot]
    for _ in range(rounds):
        hi, lo = max(range(n_shards), key=lambda k: (total[k], -k)), min(range(n_shards), key=lambda k: (total[k], k))
        gap = total[hi] - total[lo]
        fit = [s for s in owned[hi] if size[s] < gap]
        if not fit:
            break
        best = min(fit, key=lambda s: (abs(gap - 2 * size[s]), s))
        owned[hi].remove(best)
        owned[lo].append(best)
        out[best] = lo
        total[hi] -= size[best]
        total[lo] += size[best]
    return out


class SlotMap:
    """A slot-to-shard map stored as a table, one folder per version, at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The stored versions, ascending: those whose folder was written to its end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [x.getPath() for x in fs.listStatus(root)]
        whole = [p for p in found if p.getName().startswith("version=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[8:]) for p in whole)

    def save(self, version: int, mapping: dict[int, int]) -> None:
        table = self.spark.createDataFrame(sorted(mapping.items()), "virtual_slot int, shard int")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> dict[int, int]:
        """One row per slot, so at most ``MAX_SLOTS`` come to the driver."""
        return {r[0]: r[1] for r in self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}").collect()}


def first_rows(mapping: dict[int, int], loads: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(slot, shard, rows of the shard in lower slots): where each slot's places in its shard begin."""
    rows, before, out = {s: n for s, _, n in loads}, {}, []
    for slot, shard in sorted(mapping.items()):
        out.append((slot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + rows.get(slot, 0)
    return out


def spread(mapping: dict[int, int], loads: list[tuple[int, int, int]], n_shards: int) -> int:
    """Bytes between the heaviest and the lightest shard."""
    total = [0] * n_shards
    for slot, size, _ in loads:
        total[mapping[slot]] += size
    return max(total) - min(total)


def edit_map(maps: SlotMap, loads: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The map after rebalancing, and its version. The edit starts from the given version, the newest
    if None; where none is stored, from the round-robin map, which is stored as version 0. A new version
    is stored only if it brings the shards closer together, or slots of missing shards must move."""
    stored = maps.versions()
    if not stored:
        maps.save(0, initial_map(n_slots, n_shards))
        stored = [0]
    start = stored[-1] if version is None else version
    current = maps.load(start)
    if len(current) != n_slots:
        raise ValueError(f"the stored map has {len(current)} slots, not {n_slots}: records would hash into others")
    edited = rebalance(current, loads, n_shards)
    if set(current.values()) <= set(range(n_shards)) and spread(edited, loads, n_shards) >= spread(current, loads, n_shards):
        return start, current
    maps.save(stored[-1] + 1, edited)
    return stored[-1] + 1, edited


def assign_shards(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, version: int | None = None) -> DataFrame:
    """Every row with its virtual slot, shard and dense place in the shard (``slot``, from 0).

    Law ``bytes``: the slot map is edited until the shards' bytes are near equal, which the largest
    slot bounds. With ``map_path`` the map stored there is loaded (``version``, or the newest) and the
    edit is stored as the next version; without, the map lives in the scratch folder and starts
    round-robin. A row's place is its slot's first place plus its rank within the virtual slot, so no
    task sorts more than one virtual slot. Repeated rows get places of their own, rows of one id are
    ordered by CRC and size; null ids and null texts are rows like others; of a very long text only
    size and CRC are kept; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    recs = records(docs, id_col, text_col, n_slots)
    loads = slot_loads(recs)
    with Scratch(spark, "sharding") as scratch:
        scratch.names.add("slot_map")
        _, mapping = edit_map(SlotMap(spark, map_path or f"{scratch.root}/slot_map"), loads, n_shards, n_slots, version)
    current = spark.createDataFrame(first_rows(mapping, loads), "virtual_slot int, shard int, first_row long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = recs.withColumn("rank", rank).join(F.broadcast(current), "virtual_slot", "left")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_row") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
