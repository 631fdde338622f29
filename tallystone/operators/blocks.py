"""Records sealed into blocks by number and age, and Merkle trees kept as tables of nodes.

Sealing is greedy: where a block ends depends on where it began. It is solved without a fold over a whole key. Records
are numbered and cut into stretches; as a block holds at most ``max_records``, it can only reach that far into the next
stretch, so each stretch is a table of few entries: begun with so many of its records left to the block before, how many
of the next one's records go along, and how many blocks are sealed. These tables are composed by doubling, which gives
every stretch its entry, and then all stretches are sealed at once. A key that holds all rows is many stretches.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.functions.lineage import cut
from tallystone.operators.chains import _parent
from tallystone.session import share_package

MAX_RECORDS = 100
MAX_AGE = 60_000_000
STRETCH = 8_192
#: From this level of a tree on, nodes are few and asked for by many proofs; they are met in so many copies.
SALTED_LEVEL, SALTS = 6, 64


def numbered(records: DataFrame, key: str, *order: str) -> DataFrame:
    """Records with ``pos``, from 0 for each key by ``order``; a key's rows may lie in many partitions."""
    rows = cut(records.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    # A row a key and partition.
    starts = rows.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), (before - F.col("_first")).alias("_shift"))
    joined = rows.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_key", "_at", "_shift")


def _next_starts(ts: np.ndarray, max_records: int, max_age: int) -> np.ndarray:
    """Where the block after one that begins at each record begins; the record that is too late is the block's last."""
    at = np.arange(len(ts))
    return np.minimum(np.minimum(at + max_records, np.searchsorted(ts, ts + max_age, side="left") + 1), len(ts))


def _passage(ts: np.ndarray, own: int, max_records: int, max_age: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block that begins at each of the first ``max_records`` places of a stretch: how far the last block begun in
    the stretch reaches beyond its ``own`` records, and how many are begun."""
    size = max(len(ts), own + max_records)
    jump, begun = np.arange(size), np.zeros(size, np.int64)
    jump[:own], begun[:own] = _next_starts(ts, max_records, max_age)[:own], 1
    for _ in range(max(1, own).bit_length()):
        begun, jump = begun + begun[jump], jump[jump]
    return jump[:max_records] - own, begun[:max_records]


def sealed_blocks(records: DataFrame, key: str, ts: str, order: str, max_records: int = MAX_RECORDS, max_age: int = MAX_AGE, stretch: int = STRETCH) -> DataFrame:
    """key, block (from 0), first and last (of ``order``), n_records, age and reason of each block.

    Records of a key come by ``ts`` (whole numbers) and ``order``. A record that makes the block hold ``max_records``
    seals it (``records``), so does one that comes ``max_age`` or more after the block's first (``age``); what is left
    at the end is ``open``. Records without a time are left out; a null key is a key.
    """
    share_package(records.sparkSession)
    stretch = max(stretch, max_records)
    rows = numbered(records.select(F.col(key).alias("key"), F.col(ts).cast("long").alias("ts"), F.col(order).alias("ord")).where("ts IS NOT NULL"), "key", "ts", "ord")
    own = F.floor(F.col("pos") / stretch)
    # The first records of a stretch are seen from the one before, too.
    seen = F.when((F.col("pos") % stretch < max_records) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = cut(rows.select("key", "ts", "ord", "pos", F.explode(seen).alias("stretch")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def arrays(group: pd.DataFrame) -> tuple[pd.DataFrame, int]:
        group = group.sort_values("pos", ignore_index=True)
        return group, int((group["pos"] // stretch == group["stretch"]).sum())

    def passage(group: pd.DataFrame) -> pd.DataFrame:
        group, n = arrays(group)
        reach, begun = _passage(group["ts"].to_numpy(), n, max_records, max_age)
        return pd.DataFrame({"key": group["key"][:1], "stretch": group["stretch"][:1], "reach": [reach.tolist()], "begun": [begun.tolist()]})

    tables = cut(dealt.groupBy("key", "stretch").applyInPandas(passage, f"key {kinds['key']}, stretch long, reach array<long>, begun array<long>"))
    longest = tables.agg(F.max("stretch")).first()[0] or 0
    step = 1
    while step <= longest:
        # The tables of all stretches up to this one, composed from halves.
        before = tables.select(F.col("key").alias("_key"), (F.col("stretch") + step).alias("_at"), F.col("reach").alias("_reach"), F.col("begun").alias("_begun"))
        joined = tables.join(before, F.col("key").eqNullSafe(F.col("_key")) & (F.col("stretch") == F.col("_at")), "left")
        at = lambda values: F.transform("_reach", lambda r: F.get(values, r.cast("int")))
        both = F.zip_with("_begun", at(F.col("begun")), lambda x, y: x + y)
        whole = F.col("_at").isNull()
        tables = cut(joined.select("key", "stretch", F.when(whole, F.col("reach")).otherwise(at(F.col("reach"))).alias("reach"), F.when(whole, F.col("begun")).otherwise(both).alias("begun")))
        step *= 2
    entries = tables.select("key", (F.col("stretch") + 1).alias("stretch"), F.col("reach")[0].alias("entry"), F.col("begun")[0].alias("before"))

    def sealed(keys: tuple, group: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(group):
            group, n = arrays(group)
            at, block = (int(entry["entry"].iloc[0]), int(entry["before"].iloc[0])) if len(entry) else (0, 0)
            times, orders = group["ts"].to_numpy(), group["ord"]
            following = _next_starts(times, max_records, max_age)
            while at < n:
                end = int(following[at])
                age = int(times[end - 1] - times[at])
                reason = "records" if end - at == max_records else "age" if age >= max_age else "open"
                out.append((keys[0], block, orders.iloc[at], orders.iloc[end - 1], end - at, age, reason))
                at, block = end, block + 1
        return pd.DataFrame(out, columns=["key", "block", "first", "last", "n_records", "age", "reason"])

    made = dealt.groupBy("key", "stretch").cogroup(entries.groupBy("key", "stretch")).applyInPandas(
        sealed, f"key {kinds['key']}, block long, first {kinds['ord']}, last {kinds['ord']}, n_records long, age long, reason string"
    )
    return made.withColumnRenamed("key", key)


def tree_nodes(leaves: DataFrame, key: str, depth: int = 7) -> DataFrame:
    """key, entries, level (0 for the leaves), pos and h: all nodes of the Merkle tree over each key's leaves (key, pos from 0, h).

    Made in rounds of ``depth`` levels over runs of 2**depth nodes, like ``chains.chain_roots``; store it once, and
    proofs are look-ups. A null key is left out.
    """
    width = 1 << depth
    sizes = cut(leaves.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("entries")))
    longest = sizes.agg(F.max("entries")).first()[0] or 0
    nodes = leaves.select(key, "pos", F.sha2(F.concat(F.lit(b"\x00"), F.col("h").cast("binary")), 256).alias("h")).join(sizes, key)
    out, base = nodes.select(key, "entries", F.lit(0).alias("level"), "pos", "h"), 0
    pairs = lambda level: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: _parent(level[i * 2], F.coalesce(F.get(level, i * 2 + 1), level[i * 2]))
    )
    while longest > 1:
        nodes = nodes.where(F.col("entries") > 1 << base)  # keys whose root is reached are done
        runs = nodes.groupBy(key, "entries", F.floor(F.col("pos") / width).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("_0"))
        runs = runs.withColumn("_0", F.transform("_0", lambda x: x["h"]))
        for i in range(depth):
            runs = runs.withColumn(f"_{i + 1}", pairs(F.col(f"_{i}")))
        runs = cut(runs.select(key, "entries", "run", *(f"_{i + 1}" for i in range(depth))))
        for i in range(1, depth + 1):
            level = runs.select(key, "entries", F.lit(base + i).alias("level"), "run", F.posexplode(f"_{i}").alias("_p", "h"))
            level = level.select(key, "entries", "level", (F.col("run") * (width >> i) + F.col("_p")).alias("pos"), "h")
            # A level stands as long as the one below has two nodes.
            out = out.unionByName(level.where(F.col("entries") > 1 << (base + i - 1)))
        nodes = runs.select(key, "entries", F.col("run").alias("pos"), F.col(f"_{depth}")[0].alias("h"))
        base += depth
        longest = -(-longest // width)
    return out


def entry_proofs(nodes: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """key, pos, leaf, proof (the sibling on each level, itself where it stands alone) and root of the asked entries (key, pos).

    ``nodes`` is a stored ``tree_nodes``; a proof takes one row of it a level. Entries outside the tree have no row.
    """
    height = F.ceil(F.log2("entries")).cast("int")
    roots = nodes.where(F.col("level") == height).select(key, "entries", F.col("h").alias("root"))
    wanted = asked.select(key, "pos").distinct().join(roots, key).where("pos >= 0 AND pos < entries")
    # Level -1 stands for the leaf itself.
    steps = wanted.select(key, F.col("pos").alias("_pos"), "root", "entries", F.explode(F.sequence(F.lit(-1), height - 1)).alias("_step"))
    level = F.greatest("_step", F.lit(0))
    own = F.call_function("shiftright", F.col("_pos"), level)
    sibling = own.bitwiseXOR(F.lit(1))
    there = F.ceil(F.col("entries") / F.pow(F.lit(2.0), level)).cast("long")
    place = F.when((F.col("_step") >= 0) & (sibling < there), sibling).otherwise(own)
    steps = steps.select(key, "_pos", "root", "_step", level.alias("level"), place.alias("pos"))
    salted = F.col("level") >= SALTED_LEVEL
    steps = steps.withColumn("_salt", F.when(salted, F.pmod(F.xxhash64("_pos"), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = nodes.select(key, "level", "pos", "h", F.explode(copies).alias("_salt"))
    found = steps.join(dealt, [key, "level", "pos", "_salt"])
    g = found.groupBy(key, "_pos", "root").agg(F.array_sort(F.collect_list(F.struct("_step", "h"))).alias("_path"))
    path = F.transform("_path", lambda x: x["h"])
    return g.select(key, F.col("_pos").alias("pos"), path[0].alias("leaf"), F.slice(path, F.lit(2), F.size(path) - 1).alias("proof"), "root")
