"""Prefix trie of conversations by ROLLUP over positional turn columns.

A turn is known by a digest of its role and text.  A conversation becomes rows
of ``BLOCK`` positional columns t1, t2, ...: its first ``BLOCK`` turns, the next
``BLOCK``, and so on, each row keyed by the node in which the row before it
ends.  ``GROUP BY key, ROLLUP(t1, t2, ...)`` then counts all prefixes of a row
at once; grouping_id() tells their length.  A second ROLLUP over the nodes, by
the same columns, sums up their subtrees within a block; sums pass from block to
block by pointer doubling, so a conversation of many blocks takes a logarithmic
number of rounds, and none are run if all conversations fit into one block.

A block's key is the block's number and, in two independent hashes, the sum of
the hashes of all blocks before it, each hashed with its number.  It can be had
from a prefix sum over a conversation's blocks as well as from one row and its
key, and equals the key of another conversation only if the same turns went
before (but for a collision of about 128 bits; the digests of turns and nodes
are MD5's 128 bits).

Texts are read once and never shuffled.  Places of turns come from a range
partitioning by (conversation, turn): each partition numbers its own rows and
adds the rows of the partitions before, so one conversation may hold any share
of the table.  ROLLUP sums up before its shuffle, so common first turns or
copies of one conversation reach a task as a row for each map task.  Parents
with a large share of all nodes as children, of which there can be but few, are
broadcast; the others are joined by key.  Ids that end in one node are sorted
and joined into texts of at most 65,536 ids in parallel and streamed through
the hash piece by piece.

Defined cases: turns are ordered by turn, null first, then by digest (role and
text).  Null roles and texts are empty.  Repeated rows are turns of their own.
Rows without conv_id belong to no conversation and are left out.  An empty table
has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import running_sums
from ..session import cut_lineage
from .common import take

BLOCK = 8                       # positional columns
PIECE = 16                      # log2 of the ids in one piece of a node's list of ends
HOT = 256                       # a parent of more than 1/HOT of all nodes is broadcast: fewer than HOT rows
TURNS = [f"t{i + 1}" for i in range(BLOCK)]
KEY = ["block", "hi", "lo"]


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, t): t is the turn's digest and its number of words."""
    rows = take(conversations, "conv_id", "turn", "role", "text").toDF("conv", "turn", "role", "text")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(" ", F.octet_length(role), role, text).cast("binary")))
    return (rows.where(F.col("conv").isNotNull())
            .select(F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.struct(digest.alias("id"), n_words(text).alias("w")).alias("t")))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (part, conv, pos, t) with their places from 0, and the segments
    (part, conv, n, first): n turns of a conversation in a partition, first before it."""
    read = cut_lineage(turns.withColumn("_tie", F.rand(7)), "trie-turns")        # repeated rows may be dealt to several ranges
    ranged = cut_lineage(read.repartitionByRange(F.asc("conv"), F.asc_nulls_first("turn"), F.asc("t"), F.asc("_tie")).drop("_tie").withColumn("part", F.spark_partition_id()), "trie-ranges")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    segments = cut_lineage(ranged.groupBy("part", "conv").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "trie-segments")
    own = Window.partitionBy("part", "conv").orderBy(F.asc_nulls_first("turn"), "t")
    rows = ranged.join(segments.select("part", "conv", "first"), ["part", "conv"]).select("part", "conv", (F.row_number().over(own) - 1 + F.col("first")).alias("pos"), "t")
    return cut_lineage(rows, "trie-places"), segments


def rebuilt(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, pos, t, length), and every conversation (conv, length)."""
    rows, segments = placed(turns)
    heads = rows.where(F.col("pos") < most - 1).groupBy(F.col("conv").alias("source")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]).alias("head"))
    convs = (segments.groupBy("conv").agg(F.sum("n").alias("n"))
             .withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")).withColumn("source", F.col("conv") - F.col("conv") % group)
             .join(heads, "source", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
             .select("conv", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")))
    convs = cut_lineage(convs, "trie-convs")
    first = convs.select("conv", F.posexplode("head").alias("pos", "t"), "length")
    told = segments.select("part", "conv").join(convs.select("conv", "h", "length", F.size("head").alias("own_first")), "conv")
    rest = (rows.join(told, ["part", "conv"]).where("pos >= h")         # dealt by (part, conv): a long conversation is dealt by its parts
            .select("conv", (F.col("pos") - F.col("h") + F.col("own_first")).alias("pos"), "t", "length"))
    return first.select("conv", F.col("pos").cast("long").alias("pos"), "t", "length").unionByName(rest.withColumn("pos", F.col("pos").cast("long"))), convs.select("conv", "length")


def block_hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), "block", *[F.col(f"{t}.id") for t in TURNS]).cast("decimal(38,0)")


def in_blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, length, block, hi, lo, t1, ...): a row for each conversation and block, keyed."""
    slot = F.col("pos") % BLOCK
    rows = turns.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).groupBy("conv", "length", "block").agg(
        *[F.max(F.when(slot == i, F.col("t"))).alias(t) for i, t in enumerate(TURNS)])
    rows = cut_lineage(rows, "trie-blocks")
    zero = F.lit(0).cast("decimal(38,0)")
    none = F.lit(None).cast(rows.schema["t1"].dataType)
    short = rows.where(F.col("length") <= BLOCK).withColumns({"hi": zero, "lo": zero})
    empty = convs.where("length = 0").select("conv", "length", F.lit(0).cast("long").alias("block"), *[none.alias(t) for t in TURNS], zero.alias("hi"), zero.alias("lo"))
    many = running_sums(rows.where(F.col("length") > BLOCK).withColumn("_b", F.floor(F.col("block") / 4096)), [F.col("block")],
                        {"hi": block_hash("a"), "lo": block_hash("b")}, partition_by=["conv"], inclusive=False).drop("_b")
    many = many.withColumns({"hi": F.col("hi").cast("decimal(38,0)"), "lo": F.col("lo").cast("decimal(38,0)")})
    return cut_lineage(short.unionByName(empty).unionByName(many), "trie-keyed")


def node_id(size: Column) -> Column:
    """Digest of the node that a row's key and its first ``size`` turns lead to;
    a whole block is the empty rest of the next one."""
    whole = size == BLOCK
    local = F.array_join(F.transform(F.slice(F.array(*[F.hex(F.col(f"{t}.id")) for t in TURNS]), F.lit(1), F.when(whole, 0).otherwise(size)), lambda x: x), "")
    place = [F.col("block") + whole.cast("long"), F.col("hi") + F.when(whole, block_hash("a")).otherwise(0), F.col("lo") + F.when(whole, block_hash("b")).otherwise(0)]
    return F.unhex(F.md5(F.concat_ws("/", *[p.cast("decimal(38,0)").cast("string") for p in place], local).cast("binary")))


LEVEL = f"{BLOCK} - bit_count(grouping_id())"       # the key's own bits are never set
HELD = " AND ".join(f"(level < {i + 1} OR {t} IS NOT NULL)" for i, t in enumerate(TURNS))


def rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """``aggregates`` of all prefixes: the columns, ``level`` (turns of the prefix in
    its block) and the aggregates; the empty prefix in the first block only."""
    out = rows.sparkSession.sql(f"SELECT {', '.join(KEY + TURNS)}, CAST({LEVEL} AS INT) AS level, {aggregates} FROM {{rows}} GROUP BY {', '.join(KEY)}, ROLLUP({', '.join(TURNS)})", rows=rows)
    return out.where(HELD).where("level > 0 OR block = 0")


def ends(blocks: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes in which conversations end."""
    size = (F.col("length") - F.col("block") * BLOCK).cast("int")
    last = blocks.where((F.col("length") <= (F.col("block") + 1) * BLOCK) & ((F.col("length") > F.col("block") * BLOCK) | (F.col("length") == 0)))
    pieces = (last.select(node_id(size).alias("id"), "conv", F.shiftright("conv", PIECE).alias("piece")).groupBy("id", "piece")
              .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("convs")))

    def hashed(batches):
        now, state = None, None
        for b in batches:
            done = []
            for i, convs in zip(b.column(0), b.column(1)):
                i = i.as_py()
                if i != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = i, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(convs.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["id", "ends_sha256"])

    return pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "convs").mapInArrow(hashed, "id binary, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children and parent_conv_id."""
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    own = cut_lineage(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    total = own.count()
    parents = own.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > total / HOT).select("parent", F.col("parent_conv_id").alias("_hot")))
    marked = own.join(hot, "parent", "left")
    cold = marked.where("_hot IS NULL").join(parents.where(F.col("n_children") <= total / HOT).drop("n_children"), "parent", "left").drop("_hot")
    return cut_lineage(cold.unionByName(marked.where("_hot IS NOT NULL").withColumnRenamed("_hot", "parent_conv_id")), "trie-parents")


def below(nodes: DataFrame, n_blocks: int) -> DataFrame:
    """(id, leaves, saved): what the blocks under a node at a block's end hold in all.

    Each round adds what the blocks 2^i below hold and doubles the pointers."""
    sums = nodes.groupBy(*KEY).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).withColumn("id", _root_of(KEY))
    up = nodes.where(F.col("level") == BLOCK).select("id", F.when(F.col("block") > 0, _root_of(KEY)).alias("up"))
    table = cut_lineage(sums.where("block > 0").select("id", "leaves", "saved").join(up, "id"), "trie-below")
    reach = 1
    while reach < n_blocks:
        deeper = table.groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        jump = table.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        table = cut_lineage(table.join(deeper, "id", "left").join(jump, "up", "left").select(
            "id", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), F.col("_up").alias("up")), "trie-below")
        reach *= 2
    return table.select("id", "leaves", "saved")


def _root_of(key) -> Column:
    """Digest of a block's key: the node that its rows go on from."""
    return F.unhex(F.md5(F.concat_ws("/", *[F.col(k).cast("decimal(38,0)").cast("string") for k in key], F.lit("")).cast("binary")))


def prefix_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations: (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversation c is rebuilt from the first h turns of conversation c - c % group
    and its own after its first h, with h = crc32(c) % most."""
    turns, convs = rebuilt(turns_of(conversations), group, most)
    blocks = in_blocks(turns, convs)
    last_words = "element_at(array(" + ", ".join(f"{t}.w" for t in TURNS) + "), level)"
    found = rolled_up(blocks, "count(*) AS n_convs, min(conv) AS conv_id")
    nodes = found.withColumns({
        "depth": F.col("block") * BLOCK + F.col("level"), "id": node_id(F.col("level")),
        "parent": F.when(F.col("level") > 0, node_id(F.col("level") - 1)),
        "saved": (F.col("n_convs") - 1) * F.when(F.col("level") > 0, F.expr(last_words.replace("level", "greatest(level, 1)"))).otherwise(0)})
    nodes = with_parents(nodes).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    if n_blocks > 1:
        tails = nodes.where(F.col("level") == BLOCK).join(below(nodes, n_blocks).select("id", F.col("leaves").alias("_l"), F.col("saved").alias("_s")), "id", "left")
        tails = tails.withColumns({"leaf_sum": F.col("leaf") + F.coalesce("_l", F.lit(0)), "saved_sum": F.col("saved") + F.coalesce("_s", F.lit(0))}).drop("_l", "_s")
        nodes = nodes.where(F.col("level") < BLOCK).withColumns({"leaf_sum": F.col("leaf"), "saved_sum": F.col("saved")}).unionByName(tails)
    else:
        nodes = nodes.withColumns({"leaf_sum": F.col("leaf"), "saved_sum": F.col("saved")})
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "id"]
    of_top = f"min_by(struct({', '.join(told)}), depth) AS top, sum(leaf_sum) AS n_leaves, sum(saved_sum) AS saved_tokens"
    summed = rolled_up(nodes, of_top).select("top.*", "n_leaves", "saved_tokens")
    none = hashlib.sha256(b"").hexdigest()
    return (summed.join(ends(blocks), "id", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
