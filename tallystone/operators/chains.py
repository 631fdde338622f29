"""Tamper audits of hash-chained logs, Merkle blocks, custody and replay.

Verification is parallel: each line's hash is computed where it stands and compared with the one before within a
stretch of ``STRETCH`` positions; the stretches' last rows alone meet across stretches, so one very long chain is
checked by many tasks. Building a chain is sequential by nature; it folds over each chain's sorted rows and holds no
more than the last hash. Custody keeps a running holder and is a window over each piece of evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.functions.canon import canonical_json
from tallystone.functions.scalars import stable_id
from tallystone.session import share_package

GENESIS = "0" * 64
BLOCK_RECORDS = 100
STRETCH = 100_000


def build_chain(entries: DataFrame) -> DataFrame:
    """chain, seq, line and hash, prev_hash: each line carries the hash of the line before (payload|prev_hash)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, GENESIS
        for batch in batches:
            lines, hashes, before = [], [], []
            for key, payload in zip(batch["chain"], batch["payload"], strict=True):
                if key != chain:
                    chain, last = key, GENESIS
                line = f"{payload}|{last}"
                before.append(last)
                last = sha256((line + "\n").encode()).hexdigest()
                lines.append(line)
                hashes.append(last)
            yield pd.DataFrame({"chain": batch["chain"], "seq": batch["seq"], "line": lines, "prev_hash": before, "hash": hashes})

    kind = entries.schema["chain"].dataType.simpleString()
    dealt = entries.select("chain", F.col("seq").cast("long").alias("seq"), "payload").repartition("chain").sortWithinPartitions("chain", "seq")
    return dealt.mapInPandas(fold, f"chain {kind}, seq long, line string, prev_hash string, hash string")


def with_previous(rows: DataFrame, key: str, order: str, *values: str, stretch: int = STRETCH) -> DataFrame:
    """Rows with ``previous``: a struct of the values of the row before of the same key, null for the first one.

    ``order`` is a number, different for each row of a key.
    """
    found = F.struct(*values)
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / F.lit(stretch)))
    inner = cut.withColumn("_before", F.lag(found).over(W.partitionBy(key, "_stretch").orderBy(order)))
    lasts = cut.groupBy(F.col(key).alias("_key"), F.col("_stretch").alias("_at")).agg(F.max_by(found, order).alias("_last"))
    edges = lasts.withColumn("_edge", F.lag("_last").over(W.partitionBy("_key").orderBy("_at"))).drop("_last")
    joined = inner.join(edges, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at")), "left")
    return joined.withColumn("previous", F.coalesce("_before", "_edge")).drop("_stretch", "_before", "_key", "_at", "_edge")


def verify_chain(lines: DataFrame) -> DataFrame:
    """Lines with ``ok``: whether prev_hash is the hash of the line before, or all zeros for the first."""
    hashed = lines.select("chain", "seq", "prev_hash", F.sha2(F.concat("line", F.lit("\n")), 256).alias("own"))
    rows = with_previous(hashed, "chain", "seq", "own")
    return rows.select("chain", "seq", (F.col("prev_hash") == F.coalesce("previous.own", F.lit(GENESIS))).alias("ok"))


def first_break(checked: DataFrame) -> DataFrame:
    """For each chain its length and the position of the first line that fails, null if none does."""
    return checked.groupBy("chain").agg(F.count(F.lit(1)).alias("n_lines"), F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_break"))


def with_block(records: DataFrame, key: str, order: str, size: int = BLOCK_RECORDS) -> DataFrame:
    """Records with the block they fall in and their place there, ``size`` records a block."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return records.withColumn("_n", n).withColumn("block", F.floor(F.col("_n") / size).cast("long")).withColumn("slot", (F.col("_n") % size).cast("int")).drop("_n")


def record_hash(*fields: str):
    """SHA-256 of the fields joined by ``|``, nulls empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields)), 256)


def _parent(a, b):
    return F.sha2(F.concat(F.least(a, b), F.greatest(a, b)), 256)


def merkle_levels(leaves: DataFrame, *keys: str, depth: int = 7) -> DataFrame:
    """keys, n_records and levels: the leaf hashes (a zero byte before), then each level of parents, up to the root.

    Parents hash their sorted pair, an odd last node pairs with itself. A block is bounded (``BLOCK_RECORDS``, at most
    2**depth), so its leaves fold as one array.
    """
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("slot", "h"))), lambda x: F.sha2(F.concat(F.lit(b"\x00"), x["h"].cast("binary")), 256))

    def climb(level):
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: _parent(level[i * 2], F.coalesce(F.get(level, i * 2 + 1), level[i * 2])))
        return F.when(F.size(level) > 1, pairs).otherwise(F.array().cast("array<string>"))

    out = leaves.groupBy(*keys).agg(nodes.alias("_0"), F.count(F.lit(1)).alias("n_records"))
    for i in range(depth):
        out = out.withColumn(f"_{i + 1}", climb(F.col(f"_{i}")))
    levels = F.filter(F.array(*(F.col(f"_{i}") for i in range(depth + 1))), lambda x: F.size(x) > 0)
    return out.select(*keys, "n_records", levels.alias("levels"))


def merkle_roots(leaves: DataFrame, *keys: str) -> DataFrame:
    return merkle_levels(leaves, *keys).select(*keys, "n_records", F.element_at("levels", -1)[0].alias("root"))


def inclusion_proofs(levels: DataFrame, *keys: str) -> DataFrame:
    """For each leaf its slot, hash, proof (the sibling on each level, itself where it stands alone) and the root."""
    leaf = levels.select(*keys, "levels", F.posexplode(F.col("levels")[0]).alias("slot", "leaf"))
    below = F.slice("levels", F.lit(1), F.size("levels") - 1)
    sibling = lambda level, i: F.coalesce(F.get(level, F.call_function("shiftright", F.col("slot"), i).bitwiseXOR(F.lit(1))), level[F.call_function("shiftright", F.col("slot"), i)])
    return leaf.select(*keys, "slot", "leaf", F.transform(below, sibling).alias("proof"), F.element_at("levels", -1)[0].alias("root"))


def proof_holds():
    """Whether the proof leads from the leaf to the root."""
    return F.aggregate("proof", F.col("leaf"), _parent) == F.col("root")


def _entry_json(fields: list[str]):
    """Canonical JSON of the named columns: keys in order, no blanks, nulls kept, numbers and escapes as ``canon`` writes them."""
    return canonical_json(F.to_json(F.struct(*(F.col(f).alias(f) for f in sorted(fields))), {"ignoreNullFields": "false"}))


def build_ledger(entries: DataFrame, fields: list[str]) -> DataFrame:
    """ledger, seq, the fields, prev_hash and hash: the hash of an entry's canonical JSON, prev_hash included, "GENESIS" first."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, last = None, "GENESIS"
        for batch in batches:
            before, hashes = [], []
            for key, head, tail in zip(batch["ledger"], batch["_head"], batch["_tail"], strict=True):
                if key != ledger:
                    ledger, last = key, "GENESIS"
                before.append(last)
                last = sha256(f'{{{head}"prev_hash":"{last}"{tail}}}'.encode()).hexdigest()
                hashes.append(last)
            yield batch.drop(columns=["_head", "_tail"]).assign(prev_hash=before, hash=hashes)

    share_package(entries.sparkSession)
    # What stands before prev_hash among the keys in order, and what behind it.
    inner = lambda some: F.substring(json := _entry_json(some), F.lit(2), F.length(json) - 2) if some else F.lit("")
    head, tail = [f for f in fields if f < "prev_hash"], [f for f in fields if f > "prev_hash"]
    rows = entries.withColumn("_head", F.concat(inner(head), F.lit("," if head else ""))).withColumn("_tail", F.concat(F.lit("," if tail else ""), inner(tail)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    return rows.repartition("ledger").sortWithinPartitions("ledger", "seq").mapInPandas(fold, f"{kinds}, prev_hash string, hash string")


def ledger_faults(ledger: DataFrame, fields: list[str]) -> DataFrame:
    """The first entry of each ledger that fails: no hashes, prev_hash not the hash of the entry before, or another hash than its own."""
    share_package(ledger.sparkSession)
    own = F.sha2(_entry_json([*fields, "prev_hash"]), 256)
    rows = with_previous(ledger.withColumn("_own", own), "ledger", "seq", "hash")
    fault = (
        F.when(F.col("prev_hash").isNull() | F.col("hash").isNull(), "missing")
        .when(F.col("prev_hash") != F.coalesce("previous.hash", F.lit("GENESIS")), "prev_hash mismatch")
        .when(F.col("hash") != F.col("_own"), "hash mismatch")
    )
    bad = rows.withColumn("fault", fault).where("fault IS NOT NULL")
    return bad.groupBy("ledger").agg(F.min("seq").alias("first"), F.min_by("fault", "seq").alias("fault"))


def block_chain(roots: DataFrame, key: str) -> DataFrame:
    """Blocks linked by hash: block_hash covers height, root and count; previous is the hash of the block before."""
    hashed = roots.withColumn("block_hash", stable_id(F.col(key), F.col("block"), F.col("root"), F.col("n_records")))
    return hashed.withColumn("previous", F.lag("block_hash", 1, GENESIS).over(W.partitionBy(key).orderBy("block")))


def block_faults(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks whose height does not follow on, or whose ``previous`` is not the hash of the block before."""
    rows = with_previous(blocks.withColumnRenamed("previous", "_stated"), key, "block", "block", "block_hash")
    height = F.coalesce("previous.block", F.lit(-1)) + 1
    fault = F.when(F.col("block") != height, "height_gap").when(F.col("_stated") != F.coalesce("previous.block_hash", F.lit(GENESIS)), "link_break")
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").select(key, "block", "fault")


def own_fault(sound: Column, signature_valid: Column | None = None) -> Column:
    """What is wrong with a block by itself: its signature (if that was checked), then its hash; null if nothing is."""
    hashed = F.when(~F.coalesce(sound, F.lit(False)), "HASH_MISMATCH")
    return hashed if signature_valid is None else F.coalesce(F.when(~signature_valid, "SIGNATURE_INVALID"), hashed)


def watched_blocks(blocks: DataFrame) -> DataFrame:
    """chain, height, fault, expected and actual of each chain's blocks by height, up to the first that fails; null faults pass.

    Blocks have chain, height (different ones, from 0), hash and previous as they state them and own_fault, null for a
    sound block. A block is held against itself, then its height and its link against the block before; with the first
    failure the chain is frozen and no later block is judged. ``streaming.streams.watched`` gives these rows of a stream.
    """
    rows = with_previous(blocks.withColumnRenamed("previous", "_stated"), "chain", "height", "height", "hash")
    next_height, last_hash = F.coalesce(F.col("previous.height"), F.lit(-1)) + 1, F.coalesce("previous.hash", F.lit(GENESIS))
    gap, broken = F.col("height") != next_height, ~F.col("_stated").eqNullSafe(last_hash)
    linked = F.when(F.col("own_fault").isNull() & gap, "HEIGHT_GAP").when(F.col("own_fault").isNull() & broken, "CHAIN_BREAK")
    judged = rows.select(
        "chain",
        "height",
        F.coalesce("own_fault", linked).alias("fault"),
        F.when(linked == "HEIGHT_GAP", next_height.cast("string")).when(linked == "CHAIN_BREAK", last_hash).alias("expected"),
        F.when(linked == "HEIGHT_GAP", F.col("height").cast("string")).when(linked == "CHAIN_BREAK", F.col("_stated")).alias("actual"),
    )
    frozen = judged.where("fault IS NOT NULL").groupBy(F.col("chain").alias("_chain")).agg(F.min("height").alias("_frozen"))
    return judged.join(frozen, F.col("chain").eqNullSafe(F.col("_chain")), "left").where("_frozen IS NULL OR height <= _frozen").drop("_chain", "_frozen")


def integrity_report(watched: DataFrame) -> DataFrame:
    """A row a chain from watched blocks: how many were judged and passed, and the block that froze it with reason and values."""
    fault = F.max(F.when(F.col("fault").isNotNull(), F.struct("height", "fault", "expected", "actual")))  # one a chain
    g = watched.groupBy("chain").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("fault").isNull()).alias("passed"), fault.alias("_f"))
    return g.select("chain", "checked", "passed", F.col("_f").isNull().alias("chain_valid"), F.col("_f.fault").alias("reason"), F.col("_f.height").alias("height"), F.col("_f.expected").alias("expected"), F.col("_f.actual").alias("actual"))


def chain_blocks(lines: DataFrame) -> DataFrame:
    """Chain lines (chain, seq from 0, line, prev_hash) as blocks of one line each: a line's hash is taken from its text."""
    return lines.select("chain", F.col("seq").alias("height"), F.sha2(F.concat("line", F.lit("\n")), 256).alias("hash"), F.col("prev_hash").alias("previous"), F.lit(None).cast("string").alias("own_fault"))


def block_checks(blocks: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The first block of each key that fails, with all that is wrong there: link, record count, Merkle root, integrity.

    Blocks state previous, record_count, merkle_root and integrity_hash; records (key, block, slot, h) are what is
    there. A stated count of 0 is not compared; blocks without records keep to link and count. Where blocks have
    signature_valid, false is a problem and null, a signature nobody checked, is none.
    """
    there = merkle_roots(records, key, "block").withColumnRenamed("root", "_root")
    rows = with_previous(blocks.withColumnRenamed("previous", "_stated"), key, "block", "integrity_hash").join(there, [key, "block"], "left")
    n = F.coalesce("n_records", F.lit(0))
    problems = F.array(
        F.when(~F.col("signature_valid"), "SIGNATURE_INVALID") if "signature_valid" in blocks.columns else F.lit(None).cast("string"),
        F.when(F.col("_stated") != F.coalesce("previous.integrity_hash", F.lit(GENESIS)), "CHAIN_BREAK"),
        F.when((F.col("record_count") != n) & (F.col("record_count") != 0), "RECORD_COUNT_MISMATCH"),
        F.when(F.col("_root") != F.col("merkle_root"), "MERKLE_MISMATCH"),
        F.when(F.col("_root").isNotNull() & (F.col("integrity_hash") != stable_id(F.col(key), F.col("block"), F.col("_stated"), F.col("_root"), n)), "INTEGRITY_MISMATCH"),
    )
    bad = rows.withColumn("problems", F.array_join(F.array_compact(problems), ",")).where("problems <> ''")
    return bad.groupBy(key).agg(F.min("block").alias("first_block"), F.min_by("problems", "block").alias("problems"))


def chain_roots(leaves: DataFrame, key: str, depth: int = 7) -> DataFrame:
    """key, entries and root of the Merkle tree over all leaves (key, pos from 0, h) of each key, however many.

    Each round folds runs of 2**depth nodes by as many levels as the key's tree has left, so the rounds are the
    logarithm of the longest chain to that base and no run is longer than 2**depth.
    """
    width = 1 << depth
    nodes = leaves.select(key, "pos", F.sha2(F.concat(F.lit(b"\x00"), F.col("h").cast("binary")), 256).alias("h"))
    sizes = leaves.groupBy(key).agg(F.count(F.lit(1)).alias("entries")).withColumn("left", F.col("entries"))
    longest = sizes.agg(F.max("entries")).first()[0] or 0

    def climb(level, last):
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: _parent(level[i * 2], F.coalesce(F.get(level, i * 2 + 1), level[i * 2])))
        return F.when(last, level).otherwise(pairs)

    while longest > 1:
        runs = nodes.groupBy(key, F.floor(F.col("pos") / width).alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_p"), "h"))), lambda x: x["h"]).alias("_0"))
        runs = runs.join(sizes, key)
        for i in range(depth):
            # The key's whole level has ceil(left / 2**i) nodes; at one the root is reached.
            runs = runs.withColumn(f"_{i + 1}", climb(F.col(f"_{i}"), F.ceil(F.col("left") / F.lit(1 << i)) <= 1))
        nodes = runs.select(key, "pos", F.col(f"_{depth}")[0].alias("h"))
        sizes = sizes.withColumn("left", F.ceil(F.col("left") / F.lit(width)))
        longest = -(-longest // width)
    return nodes.join(sizes, key).select(key, "entries", F.col("h").alias("root"))


def witness_checkpoints(entries: DataFrame, key: str, ts_ns: int) -> DataFrame:
    """For each chain (key, pos, h) a checkpoint: head hash, number of entries, Merkle root over them, id and the hash to sign."""
    heads = entries.groupBy(key).agg(F.max_by("h", "pos").alias("head"))
    rows = heads.join(chain_roots(entries, key), key)
    rows = rows.withColumn("checkpoint_id", stable_id(F.col("head"), F.col("root"), F.lit(ts_ns), length=32))
    return rows.withColumn("payload_hash", stable_id(F.col("checkpoint_id"), F.col("head"), F.col("entries"), F.col("root"), F.lit(ts_ns)))


def quorum(signatures: DataFrame, trusted: DataFrame, k: int) -> DataFrame:
    """Checkpoints with their distinct trusted valid signers; reached if k sign and no row is untrusted, invalid or repeated."""
    known = signatures.join(trusted.select(F.col("signer").alias("_t")), F.col("signer") == F.col("_t"), "left")
    good = F.col("_t").isNotNull() & F.col("valid")
    counted = known.groupBy("checkpoint", "signer").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("good")).groupBy("checkpoint").agg(
        F.count_if("good").alias("signers"), F.count_if(~F.col("good") | (F.col("n") > 1)).alias("rejected")
    )
    return counted.withColumn("reached", (F.col("signers") >= k) & (F.col("rejected") == 0))


def compare_ingests(left: DataFrame, right: DataFrame) -> DataFrame:
    """Verdict on two ingests of one log by position (pos, payload): MATCH, DIFF or INCOMPLETE, with counts."""
    both = left.select("pos", F.col("payload").alias("a")).join(right.select("pos", F.col("payload").alias("b")), "pos", "full_outer")
    out = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"), F.count_if(F.col("a") != F.col("b")).alias("different"))
    return out.withColumn("verdict", F.when(F.col("missing") > 0, "INCOMPLETE").when(F.col("different") > 0, "DIFF").otherwise("MATCH"))


def replay_state(journal: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each key and how many entries led to it."""
    return journal.groupBy(key).agg(F.max_by("state", order).alias("state"), F.count(F.lit(1)).alias("n_entries"))


def custody_faults(acts: DataFrame) -> DataFrame:
    """Breaks of custody (evidence, seq, act acquire or transfer, actor, to): a second acquire, or a transfer by another than the holder."""
    w = W.partitionBy("evidence").orderBy("seq")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("act") == "acquire", F.col("actor")).when(F.col("act") == "transfer", F.col("to")), ignorenulls=True).over(past)
    acquired = F.coalesce(F.sum(F.when(F.col("act") == "acquire", 1).otherwise(0)).over(past), F.lit(0))
    fault = (
        F.when((F.col("act") == "acquire") & (acquired > 0), "second_acquire")
        .when((F.col("act") == "transfer") & (acquired == 0), "transfer_before_acquire")
        .when((F.col("act") == "transfer") & (F.col("actor") != holder), "not_holder")
    )
    return acts.withColumn("holder", holder).withColumn("fault", fault).where("fault IS NOT NULL").select("evidence", "seq", "fault", "holder")


def unanchored(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    return blocks.join(anchors.select("block_hash"), "block_hash", "left_anti")


def iso_to_nanos(text):
    """Nanoseconds since the epoch of an ISO-8601 instant with up to nine fractional digits; Z or an offset."""
    seconds = F.unix_micros(F.to_timestamp(F.regexp_replace(text, r"\.[0-9]+", ""))) / F.lit(1_000_000)
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]{1,9})", 1), 9, "0").cast("long")
    return seconds.cast("long") * F.lit(1_000_000_000) + fraction
