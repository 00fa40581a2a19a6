"""Prefix trie of conversations as a minimal-perfect-hash node table.

Every turn of every conversation ends a prefix, told by a digest: the sum, in
four lanes of 31 bits, of hashes of its turns with their places.  Sums of a
sorted table are running sums over range partitions, so a long conversation is
split like any other run of rows.  Distinct digests are the nodes.

A node belongs to the smallest conversation that passes through it, and a
conversation that has nodes, an owner, has the last ones of its path.  Nodes
that few owners pass through hang in light subtrees; a shard gets whole
light subtrees.  There a minimal perfect hash gives every digest a slot, the
slot's digest verifies every lookup, counts are scattered into flat arrays by
slot, and sums go up from the deepest nodes through the array of parent slots.
What the subtrees' roots pass on is added up in Spark by parent; the heavy
nodes are the last shard.  A node is light at ``max(LIGHT_OWNERS, sqrt(owners))``
owners or fewer, so neither a shard nor the heavy part grows faster than
the square root of the table times the depth.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.operators.threshold import positioned
from vigilspark.session import store

REBASE_ON = 100
REBASE_TURNS = 6
LIGHT_OWNERS = 20_000
SHARD_NODES = 20_000
IDS_PER_STRING = 256

LANES = ("s0", "s1", "s2", "s3")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


# -------------------------------------------------------------- conversations

def ordered_turns(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, i, turn_md5, chars): turns of each conversation numbered from 0 by turn, null first.

    Null roles and texts count as empty.  Turns of equal number follow the
    order of role and text, and every repeated row is a turn of its own.
    Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = convs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    rows = positioned(rows, ["conv_id", "turn", "role", "text"]).select(
        "conv_id", "g", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("turn_md5"),
        F.length("text").cast("long").alias("chars"))
    first = rows.groupBy("conv_id").agg(F.min("g").alias("first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("g") - F.col("first")).alias("i"), "turn_md5", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, turn_md5, chars), (conv_id, n)): every conversation with its first turns taken from its base.

    h = crc32(conv_id as text) mod 6; the base of c is c - c % 100 (truncating).
    The first h turns are the base's (all it has if fewer, none if it isn't
    there), then follow c's own turns after its first h.
    """
    sizes = store(turns.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", "own", F.expr(f"conv_id - conv_id % {REBASE_ON}").alias("base"), (F.crc32(F.col("conv_id").cast("string")) % REBASE_TURNS).alias("h")))
    bases = sizes.where(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("given"))
    plan = sizes.join(bases, "base", "left").select(
        "conv_id", "base", "h", "own", F.least("h", F.coalesce("given", F.lit(0))).alias("given"))
    plan = store(plan.withColumn("n", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    own = turns.join(plan.select("conv_id", "h", "given"), "conv_id").where("i >= h").select(
        "conv_id", (F.col("i") - F.col("h") + F.col("given")).alias("pos"), "turn_md5", "chars")
    # a base has at most REBASE_TURNS - 1 turns to give, to at most REBASE_ON conversations
    heads = turns.where((F.col("i") < REBASE_TURNS - 1) & F.expr(f"conv_id % {REBASE_ON} = 0")).withColumnRenamed("conv_id", "base")
    taken = plan.select("conv_id", "base", "given").join(heads, "base").where("i < given").select(
        "conv_id", F.col("i").alias("pos"), "turn_md5", "chars")
    return own.unionByName(taken), plan.select("conv_id", "n")


# -------------------------------------------------------------------- digests

def _lanes(turn: DataFrame) -> DataFrame:
    """31-bit lanes of a hash of each turn with its place."""
    placed = F.md5(F.concat("turn_md5", F.lit("@"), F.col("pos").cast("string")))
    lane = lambda j: F.conv(F.substring(placed, 8 * j + 1, 8), 16, 10).cast("long").bitwiseAND((1 << 31) - 1)
    return turn.select("conv_id", "pos", "chars", *[lane(j).alias(name) for j, name in enumerate(LANES)])


def prefix_sums(rows: DataFrame, key: str, at: str, values: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``sum_<value>``: running sums of the values in each key by rising ``at``, over range partitions.

    A key that goes on over partitions gets what it had in those before from a table of one row a task.
    """
    shape = rows.withColumn("_at", F.lit(0).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema) + "".join(f", sum_{v} long" for v in values)

    def run(batches):
        last, total = None, np.zeros(len(values), dtype=np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[key].to_numpy()
            new = np.concatenate([[last is None or k[0] != last], k[1:] != k[:-1]])
            run_no = np.cumsum(new)
            starts = np.flatnonzero(new)
            for j, v in enumerate(values):
                added = pdf[v].to_numpy(dtype=np.int64).cumsum()
                # what lay before each run's first row; the run going on from the last batch has its total
                before = np.concatenate([[-total[j]], added[starts] - pdf[v].to_numpy()[starts]])
                pdf[f"sum_{v}"] = added - before[run_no]
            last, total = k[-1], np.array([pdf[f"sum_{v}"].iloc[-1] for v in values], dtype=np.int64)
            yield pdf

    placed = store(rows.repartitionByRange(key, at).sortWithinPartitions(key, at)
                   .withColumn("_at", F.monotonically_increasing_id()).mapInPandas(run, schema))
    part = F.shiftright("_at", 33).alias("_part")
    tails = placed.groupBy(part).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(
        F.struct(*[f"sum_{v}" for v in values]), "_at").alias("sums")).orderBy("_part").collect()  # one row a task
    carried, held, of = [], [0] * len(values), None
    for r in tails:
        before = held if of == r["first"] else [0] * len(values)
        carried.append((r["_part"], r["first"], *before))
        goes_on = r["first"] == r["last"]
        held, of = [x + (y if goes_on else 0) for x, y in zip(r["sums"], before)], r["last"]
    kind = rows.schema[key].dataType.simpleString()
    carry = rows.sparkSession.createDataFrame(carried, f"_part long, _key {kind}" + "".join(f", _c_{v} long" for v in values))
    more = lambda v: F.when(F.col(key) == F.col("_key"), F.col(f"_c_{v}")).otherwise(0)
    return placed.join(F.broadcast(carry), F.shiftright("_at", 33) == F.col("_part")).select(
        *rows.columns, *[(F.col(f"sum_{v}") + more(v)).alias(f"sum_{v}") for v in values])


def _key(lanes: list[Column], depth: Column, which: int) -> Column:
    return F.xxhash64(F.lit(which), depth, *lanes)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, chars): digest of every prefix and of the one before it, and the code points of its last text."""
    rows = prefix_sums(_lanes(turns), "conv_id", "pos", LANES)
    here, before = [F.col(f"sum_{v}") for v in LANES], [F.col(f"sum_{v}") - F.col(v) for v in LANES]
    depth = F.col("pos") + 1
    return rows.select("conv_id", depth.alias("depth"), _key(here, depth, 0).alias("a"), _key(here, depth, 1).alias("b"),
                       _key(before, depth - 1, 0).alias("up_a"), _key(before, depth - 1, 1).alias("up_b"), "chars")


def _root() -> list[Column]:
    nothing = [F.lit(0).cast("long")] * len(LANES)
    return [_key(nothing, F.lit(0).cast("long"), 0).alias("a"), _key(nothing, F.lit(0).cast("long"), 1).alias("b")]


# --------------------------------------------------------- minimal perfect hash

def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A hash of two-word digests, another one on every level."""
    x = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


class PerfectHash:
    """Slots 0 .. n - 1 for n distinct digests.

    A level has a bit for every place that one digest alone falls on; digests
    that meet go to the next level.  A digest's slot is the number of bits
    before its own.  ``slots`` looks digests up and verifies them; those not
    in the table get -1.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, rest, taken = [], np.arange(len(a)), 0
        place = np.zeros(len(a), dtype=np.int64)
        while len(rest):
            size = max(4, 2 * len(rest))
            at = (_mixed(a[rest], b[rest], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            rank = taken + np.cumsum(alone) - alone
            self.levels.append((alone, rank))
            won = alone[at]
            place[rest[won]] = rank[at[won]]
            rest, taken = rest[~won], taken + int(alone.sum())
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[place], self.b[place] = a, b
        self.place = place  # slot of each digest in the order given

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.full(len(a), -1, dtype=np.int64)
        rest = np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = (_mixed(a[rest], b[rest], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            found[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        at = np.maximum(found, 0)
        same = (found >= 0) & (self.a[at] == a) & (self.b[at] == b) if len(self.a) else np.zeros(len(a), dtype=bool)
        return np.where(same, found, -1)


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over all subtrees of a shard's nodes; columns as in ``_SHARD``.

    ``kids``, ``leaves`` and ``saved`` come in as what subtrees outside the shard
    pass on.  ``own_root`` says that the parent isn't in the shard.
    """
    a, b, up_a, up_b = (pdf[c].to_numpy(dtype=np.int64) for c in ("a", "b", "up_a", "up_b"))
    table = PerfectHash(a, b)
    n, slot, up = len(pdf), table.place, table.slots(up_a, up_b)
    depth = pdf["depth"].to_numpy(dtype=np.int64)
    up[depth == 0] = -1
    flat = {}
    for name in ("conv_id", "n_convs", "chars", "kids", "leaves", "saved"):
        flat[name] = np.zeros(n, dtype=np.int64)
        flat[name][slot] = pdf[name].to_numpy(dtype=np.int64)
    parent = np.empty(n, dtype=np.int64)
    parent[slot] = up
    kids, leaves, saved = flat["kids"], flat["leaves"], flat["saved"]
    saved += (flat["n_convs"] - 1) * flat["chars"]
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for rows in np.split(slot[order], edges) if n else []:
        leaves[rows] += kids[rows] == 0
        rows = rows[parent[rows] >= 0]
        np.add.at(kids, parent[rows], 1)
        np.add.at(leaves, parent[rows], leaves[rows])
        np.add.at(saved, parent[rows], saved[rows])
    above = np.where(up >= 0, flat["conv_id"][np.maximum(up, 0)], 0)
    return pdf.assign(kids=kids[slot], leaves=leaves[slot], saved=saved[slot],
                      parent=pd.Series(above, dtype="Int64").mask(up < 0), own_root=up < 0)


_SHARD = ("a long, b long, up_a long, up_b long, depth long, conv_id long, n_convs long, chars long, "
          "kids long, leaves long, saved long, parent long, own_root boolean")


# ----------------------------------------------------------------- id digests

def _id_strings(batches):
    """Runs of equal (a, b): up to IDS_PER_STRING ids joined by commas, with the first of them."""
    for pdf in batches:
        a, b, ids = (pdf[c].to_numpy() for c in ("a", "b", "conv_id"))
        if not len(ids):
            continue
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        starts = np.flatnonzero(new)
        since = np.arange(len(ids)) - starts[np.cumsum(new) - 1]
        starts = np.flatnonzero(since % IDS_PER_STRING == 0)
        ends = np.append(starts[1:], len(ids))
        text = ids.astype(str)
        yield pd.DataFrame({"a": a[starts], "b": b[starts], "first": ids[starts],
                            "ids": [",".join(text[x:y]) for x, y in zip(starts, ends)]})


def _hash_runs(batches):
    """SHA-256 over the strings of every run of equal (a, b), one string in hand at a time."""
    now, sha = None, None
    for pdf in batches:
        out = []
        for a, b, ids in zip(pdf["a"], pdf["b"], pdf["ids"]):
            if (a, b) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, sha.hexdigest())], columns=["a", "b", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv_id): SHA-256 of each node's ids in order.

    A node may hold a third of all ids.  They are sorted over range partitions
    and joined into strings there, so that the one task which must hash a
    node's ids in order reads a row for every ``IDS_PER_STRING`` of them and
    keeps none.
    """
    strings = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInPandas(
        _id_strings, "a long, b long, first long, ids string")
    return strings.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInPandas(
        _hash_runs, "a long, b long, ends_sha256 string")


# ------------------------------------------------------------------- operator

def node_table(convs: DataFrame, id_col: str = "conv_id", light_owners: int = LIGHT_OWNERS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node.

    Conversations are rebuilt from their bases (``rebuilt``); null roles and
    texts are empty, rows without a conversation id are left out, equal turn
    numbers follow role and text, repeated rows are turns of their own.  A
    table without conversations has no nodes, not even a root.  Other columns
    are ignored.
    """
    spark = convs.sparkSession
    turns, sizes = rebuilt(store(ordered_turns(convs, id_col)))
    paths = store(prefixes(turns))
    members = sizes.agg(F.count("*"), F.min("conv_id")).first()
    if not members[0]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                                         "saved_tokens long, ends_sha256 string")
    nodes = paths.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("up_a").alias("up_a"),
        F.first("up_b").alias("up_b"), F.first("chars").alias("chars"))
    nothing = F.lit(0).cast("long")
    root = spark.range(1).select(*_root(), F.lit(members[1]).cast("long").alias("conv_id"), F.lit(members[0]).cast("long").alias("n_convs"),
                                 nothing.alias("depth"), nothing.alias("up_a"), nothing.alias("up_b"), nothing.alias("chars"))
    nodes = store(nodes.unionByName(root))

    # how many owners pass through each node; where each owner's path becomes light
    owners = nodes.where("depth > 0").select("conv_id").distinct()
    routes = store(paths.join(owners, "conv_id", "left_semi").select("conv_id", "depth", "a", "b"))
    n_owners = owners.count()
    light = max(light_owners, math.isqrt(n_owners))
    through = routes.groupBy("a", "b").agg(F.count("*").alias("owners"))
    heavy = store(through.where(F.col("owners") > light).select("a", "b").unionByName(spark.range(1).select(*_root())))
    cut = routes.join(heavy, ["a", "b"], "left_anti").groupBy("conv_id").agg(
        F.min_by(F.struct("a", "b"), "depth").alias("cut"), F.min("depth").alias("cut_depth"))
    of = nodes.join(heavy.withColumn("heavy", F.lit(True)), ["a", "b"], "left")
    n_shards = max(1, math.ceil(nodes.count() / shard_nodes))
    shard = F.pmod(F.xxhash64("cut.a", "cut.b"), F.lit(n_shards)).alias("shard")
    zeros = [nothing.alias(c) for c in ("kids", "leaves", "saved")]
    columns = ["a", "b", "up_a", "up_b", "depth", "conv_id", "n_convs", "chars"]
    low = of.where("heavy is null").join(cut, "conv_id").select(*columns, *zeros, shard)
    low = store(low.groupBy("shard").applyInPandas(lambda key, pdf: _add_up(pdf.drop(columns="shard")), _SHARD))

    passed = low.where("own_root").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    top = of.where("heavy").join(passed, ["a", "b"], "left").select(
        *columns, *[F.coalesce(c, nothing).alias(c) for c in ("kids", "leaves", "saved")])
    top = store(top.groupBy(F.lit(0).alias("shard")).applyInPandas(lambda key, pdf: _add_up(pdf.drop(columns="shard", errors="ignore")), _SHARD))
    # parents of the light subtrees' roots are heavy nodes
    above = top.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("above"))
    roots = low.where("own_root").join(above, ["up_a", "up_b"]).withColumn("parent", F.col("above")).drop("above")
    whole = low.where("not own_root").unionByName(roots).unionByName(top)

    last = paths.join(sizes, "conv_id").where("depth = n").select("a", "b", "conv_id").unionByName(
        sizes.where("n = 0").select(*_root(), "conv_id"))
    return whole.join(ends_digest(last), ["a", "b"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"))
