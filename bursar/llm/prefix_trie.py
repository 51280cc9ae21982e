"""Trie of conversation prefixes by truncation peeling, from the deepest turns up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bursar.llm.common import cut, runs

#: Turns that a rebuilt conversation takes from the first of its group at most, and conversations of a group.
HEAD, GROUP = 9, 5
#: Turns that one task peels at once in a group of conversations with a common prefix; larger groups are peeled
#: over fewer levels first, which merges them.
GROUP_TURNS = 200_000
#: Conversation ids joined into one stretch of a digest's text.
STRETCH = 50_000
KEY = 16

#: One row for each node that is still to be peeled, and each conversation (or class of equal ones) that ends at ``depth``:
#: keys of its prefixes from the root on, bytes of its turns, and what its subtree adds up to.
_ROWS = ("keys", "bytes", "depth", "conv_id", "n_convs", "n_leaves", "saved")
_NODES = "key binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (position, digest and bytes of each) of every rebuilt conversation.

    Conversation c takes the first h turns of conversation c - c % 5 and then its own after the first h, with h =
    crc32(c as decimal text) % 9. Turns are in the order of ``turn`` (null first, ties by role and text digest). A
    turn is its role and text (null: empty), known by the MD5 of both; texts are not shuffled. Rows without a conversation id
    belong to none.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = (conversations.filter("conv_id is not null")
             .select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
                 F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"),
                 F.octet_length(text).cast("long").alias("bytes")).alias("t")))
    own = cut(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
              .select("conv_id", F.transform("t", lambda x: F.struct(x["digest"], x["bytes"])).alias("own")))
    base = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, HEAD - 1).alias("head"))
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % HEAD
    return (own.withColumn("base", c - c % GROUP).withColumn("h", h.cast("int")).join(base, "base", "left")
            .select("conv_id", F.concat(
                F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0)),
                F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("turns")))


def _prefix_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of all prefixes: each the MD5 of the one before and the turn's digest; the root's is 16 zeros."""
    for pdf in batches:
        keys, sizes = [], []
        for turns in pdf["turns"]:
            key = bytes(KEY)
            path = [key]
            for t in turns:
                key = hashlib.md5(key + t["digest"]).digest()
                path.append(key)
            keys.append(b"".join(path))
            sizes.append(np.fromiter((t["bytes"] for t in turns), ">i8", len(turns)).tobytes())
        yield pd.DataFrame({"keys": keys, "bytes": sizes, "depth": [len(k) // KEY - 1 for k in keys], "conv_id": pdf["conv_id"].to_numpy()})


def _prefix(depth: int) -> Column:
    return F.substring("keys", KEY * depth + 1, KEY)


def _merged(rows: list[tuple], depth: int) -> tuple[int, int, int, int, int]:
    """conv_id, n_convs, n_children, n_leaves and saved of a node, from its surviving children and what ends at it."""
    children = [r for r in rows if r[2] > depth]
    size = int(np.frombuffer(rows[0][1], ">i8")[depth - 1]) if depth else 0
    n = sum(r[4] for r in rows)
    return (min(r[3] for r in rows), n, len(children), sum(r[5] for r in children) or 1,
            sum(r[6] for r in children) + (n - 1) * size)


def _peel(high: int, low: int):
    """Peels the groups of equal prefixes of ``low`` turns from depth ``high`` down to ``low`` + 1: nodes, and survivors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["prefix"]):
            ending: dict[int, list[tuple]] = {}
            for r in group.itertuples(index=False):
                ending.setdefault(r.depth, []).append((r.keys, r.bytes, r.depth, r.conv_id, r.n_convs, r.n_leaves, r.saved))
            # What survived the stretch before lies one level below this one.
            nodes, alive = [], ending.pop(high + 1, [])
            for depth in range(high if alive else max(ending), low, -1):
                # The last turn is stripped: nodes of the level below regroup by what is left, with what newly ends here.
                level: dict[bytes, list[tuple]] = {}
                for r in alive + ending.get(depth, []):
                    level.setdefault(r[0][KEY * depth:KEY * depth + KEY], []).append(r)
                alive = []
                for key, rows in level.items():
                    conv, n, children, leaves, saved = _merged(rows, depth)
                    keys = rows[0][0]
                    nodes.append((key, keys[KEY * depth - KEY:KEY * depth], conv, depth, n, children, leaves, saved))
                    alive.append((keys, rows[0][1], depth, conv, n, leaves, saved))
                # A node keeps only its own prefix from here on.
                alive = [(k[:KEY * depth + KEY], b[:8 * depth], d, *rest) for k, b, d, *rest in alive]
            out = pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])
            # Survivors, at depth low + 1, go on with their keys; all other nodes are done.
            path = {r[0][-KEY:]: r for r in alive}
            out["keys"] = [path[k][0] if d == low + 1 else None for k, d in zip(out["key"], out["depth"])]
            out["bytes"] = [path[k][1] if d == low + 1 else None for k, d in zip(out["key"], out["depth"])]
            yield out
    return run


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """One level peeled by Spark's own aggregation, for groups of any size: nodes of ``depth`` with their keys."""
    child = F.col("depth") > depth
    size = F.expr(f"cast(conv(hex(substring(bytes, {8 * depth - 7}, 8)), 16, 10) as long)") if depth else F.lit(0).cast("long")
    total = lambda c: F.sum(F.when(child, F.col(c)).otherwise(0))
    slim = rows.select(F.substring("keys", 1, KEY * (depth + 1)).alias("keys"), F.substring("bytes", 1, 8 * depth).alias("bytes"),
                       "depth", "conv_id", "n_convs", "n_leaves", "saved")
    return (slim.groupBy("keys", "bytes").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                                              F.sum(child.cast("long")).alias("n_children"),
                                              F.greatest(total("n_leaves"), F.lit(1)).alias("n_leaves"), total("saved").alias("below"))
            .select(_prefix(depth).alias("key"), (_prefix(depth - 1) if depth else F.lit(None).cast("binary")).alias("parent"),
                    "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", "n_children", "n_leaves",
                    (F.col("below") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), "keys", "bytes"))


def _survivors(nodes: DataFrame) -> DataFrame:
    return (nodes.filter("keys is not null")
            .select("keys", "bytes", F.col("depth").cast("int").alias("depth"), "conv_id", "n_convs", "n_leaves",
                    F.col("saved_tokens").alias("saved")))


def peeled(ended: DataFrame, group_turns: int = GROUP_TURNS) -> list[DataFrame]:
    """The nodes of all depths from rows of classes of equal conversations (``_ROWS``), in written parts.

    Levels are peeled from the deepest up in stretches (high, low]: rows with the same prefix of ``low`` turns meet in
    one task, which peels its groups level by level. Where such a group would hold more than ``group_turns`` turns, the
    stretch is halved: its deep half goes first and merges what it can. A single level is peeled by a plain aggregation,
    combined before the shuffle, so no prefix however common is gathered in a task.
    """
    found: list[DataFrame] = []

    def stretch(alive: DataFrame | None, high: int, low: int) -> DataFrame | None:
        """Peels depths high .. low + 1; gives the survivors at low + 1."""
        mine = ended.filter((F.col("depth") <= high) & (F.col("depth") > low))
        rows = mine if alive is None else mine.unionByName(alive)
        if high - low > 1:
            most = (rows.groupBy(_prefix(low).alias("prefix")).agg(F.sum(F.col("depth") - low).alias("turns"), F.count("*").alias("n"))
                    .agg(F.max(F.when(F.col("n") > 1, F.col("turns")).otherwise(0))).first()[0])
            if most is None:
                return None
            if most > group_turns:
                middle = (high + low) // 2
                return stretch(stretch(alive, high, middle), middle, low)
            keyed = rows.withColumn("prefix", _prefix(low))
            nodes = cut(keyed.repartition("prefix").sortWithinPartitions("prefix")
                        .mapInPandas(_peel(high, low), f"{_NODES}, keys binary, bytes binary"))
        else:
            nodes = cut(_level(rows, high))
        found.append(nodes.drop("keys", "bytes"))
        return _survivors(nodes)

    deepest = ended.agg(F.max("depth")).first()[0]
    if deepest is None:
        return found
    alive = stretch(None, deepest, 0) if deepest else None
    rows = ended.filter("depth = 0")
    found.append(cut(_level(rows if alive is None else rows.unionByName(alive), 0)).drop("keys", "bytes"))
    return found


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, conv_id) rows as comma-joined texts of at most STRETCH ids; ``at`` is the first."""
    held, ids, out = None, [], []
    for pdf in batches:
        for key, conv in zip(pdf["key"], pdf["conv_id"].tolist()):
            if key != held or len(ids) >= STRETCH:
                if ids:
                    out.append((held, int(ids[0]), ",".join(ids)))
                held, ids = key, []
            ids.append(str(conv))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "ids"])
            out = []
    if ids:
        yield pd.DataFrame([(held, int(ids[0]), ",".join(ids))], columns=["key", "at", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, state, started = None, None, False
    for pdf in batches:
        out = []
        for key, ids in zip(pdf["key"], pdf["ids"]):
            if key != held:
                if held is not None:
                    out.append((held, state.hexdigest()))
                held, state, started = key, hashlib.sha256(), False
            state.update((("," if started else "") + ids).encode())
            started = True
        if out:
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if held is not None:
        yield pd.DataFrame([(held, state.hexdigest())], columns=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the conversations (key, conv_id) that end at each node, in the order of their ids.

    Ids are sorted over range partitions, so a node at which very many conversations end is spread over many of them, and
    joined there into long texts. What hashes a node's digest, which can only be done in order, reads these texts
    one by one.
    """
    spread = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    texts = cut(spread.mapInPandas(_stretches, "key binary, at long, ids string"))
    return texts.repartition("key").sortWithinPartitions("key", "at").mapInPandas(_digests, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    A node is a distinct sequence of first turns of rebuilt conversations (see ``rebuilt``), known by a chain of MD5 digests;
    conversations that start with it are its members. A null role or text is empty, a repeated row is a turn of its own, a
    conversation without turns left is a member of the root only, rows without conv_id are left out, and an empty
    table has no nodes. Other columns are not read. One conversation's digests (24 bytes a turn) are held in one task.
    """
    paths = cut(rebuilt(conversations).mapInPandas(_prefix_keys, "keys binary, bytes binary, depth int, conv_id long"))
    zero = F.lit(0).cast("long")
    ended = cut(paths.groupBy("keys", "bytes", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
                .select("keys", "bytes", "depth", "conv_id", "n_convs", zero.alias("n_leaves"), zero.alias("saved")))
    parts = peeled(ended, group_turns)
    spark = conversations.sparkSession
    nodes = parts[0] if parts else spark.createDataFrame([], _NODES)
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    ends = end_digests(paths.select(F.substring("keys", -KEY, KEY).alias("key"), "conv_id"))
    names = cut(nodes.filter("depth > 0 and n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("named")), free=False)
    root = nodes.filter("depth = 0").select("conv_id").first()
    # The root, parent of very many nodes, takes no part in the join.
    named = F.when(F.col("depth") == 1, F.lit(root and root[0])).otherwise(F.col("named")).cast("long")
    return (nodes.withColumn("parent", F.when(F.col("depth") > 1, F.col("parent"))).join(names, "parent", "left").join(ends, "key", "left")
            .select("conv_id", "depth", named.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
