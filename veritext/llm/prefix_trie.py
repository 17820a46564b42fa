"""Conversation prefix trie (operator 12): shared beginnings of conversations, counted once.

Each conversation gets chained SHA-256 digests, one for each prefix: a prefix's digest is that of its
predecessor's digest followed by the turn's own. All prefixes are exploded and grouped by (depth,
digest), which gives the nodes. The smallest member of a node also stands for the nodes that only
continue it, so the nodes of one representative are a path without a gap, from the depth at which it
leaves its parent's path to its own end. Sums over subtrees explode every path's total to all
ancestors above the path, and add running sums along the path itself: the same sums as from
exploding each node alone, but the rows stay fewer than the prefixes, however long a conversation is.

What is hot is combined before it is shuffled: members of a node and ancestors' sums by partial
aggregates, ids that end at one node as blocks of 4,096 neighbouring ids. The digest over a node's
ids streams over its sorted blocks. Parents with more than 64 children and a thousandth of all nodes are
fewer than a thousand, and are the only table that is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import materialise

#: Ids that differ in these low bits only travel as one piece of text.
BLOCK_BITS = 12
_NODE = ["depth", "digest"]


def rebuild(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share beginnings: (conv_id, part, pos, role, text).

    Conversation c starts with the first h turns of conversation c - c % every, h = crc32(decimal c) %
    most, and goes on with its own turns after its first h. Turns are ordered by turn (null first), then
    by role and text; null role and text count as empty. Rows without conv_id belong to no conversation.
    Each conversation also has one row with part 0 and no turn, so that it exists without turns; rows
    of part 1 are taken over, those of part 2 its own.
    """
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    c = F.col("conv_id")
    turns = conversations.filter("conv_id is not null").select(
        c.cast("long").alias("conv_id"), (c - c % every).cast("long").alias("base"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.repartition("base").withColumn("pos", F.row_number().over(order).cast("long"))
    others = F.filter(
        F.sequence(c - (every - 1), c + (every - 1)), lambda x: (x - x % every == c) & (F.col("pos") <= h(x))
    )
    row = lambda to, part: F.struct(to.alias("conv_id"), F.lit(part).alias("part"))
    none = F.array().cast("array<struct<conv_id:bigint,part:int>>")
    goes = F.concat(
        F.when(F.col("pos") == 1, F.array(row(c, 0))).otherwise(none),
        F.when((c == F.col("base")) & (F.col("pos") < most), F.transform(others, lambda x: row(x, 1))).otherwise(none),
        F.when(F.col("pos") > h(c), F.array(row(c, 2))).otherwise(none),
    )
    out = turns.withColumn("to", F.explode(goes))
    return out.select(
        "base", F.col("to.conv_id").alias("conv_id"), F.col("to.part").alias("part"),
        *[F.when(F.col("to.part") > 0, F.col(x)).alias(x) for x in ("pos", "role", "text")],
    )


def prefixes(turns: DataFrame, together: str = "conv_id") -> DataFrame:
    """All prefixes of all conversations: (conv_id, depth, digest, before, bytes, last).

    ``turns`` has (conv_id, part, pos, role, text), ordered by (part, pos) in a conversation; one row of part
    0 opens each conversation, and rows of an id without such a row are left out. ``together`` is a column
    that keeps a conversation's rows in one task. Depth 0 is the empty prefix; ``before`` is the digest of
    the prefix that is one turn shorter, ``bytes`` the last turn's text in UTF-8, ``last`` tells the whole
    conversation. One task streams over its conversations, holding one turn at a time.
    """
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = turns.select(
        together, *([] if together == "conv_id" else ["conv_id"]), "part", "pos",
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("said"), F.octet_length("text").cast("long").alias("bytes"),
    )
    rows = rows.repartition(together).sortWithinPartitions(together, "conv_id", "part", "pos")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, root = None, hashlib.sha256(b"").digest()
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("before", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            out = []
            for c, part, turn, size in zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "said", "bytes"))):
                same = held is not None and held[0] == c
                if not part:
                    if same:  # repeated
                        continue
                    now = (c, 0, root, None, 0)
                elif same:
                    now = (c, held[1] + 1, hashlib.sha256(held[2] + turn).digest(), held[2], size)
                else:  # rows of a conversation that doesn't exist
                    continue
                if held is not None:
                    out.append((*held, not same))
                held = now
            if out:
                yield batch(out)
        if held is not None:
            yield batch([(*held, True)])

    return rows.mapInArrow(chain, "conv_id long, depth long, digest binary, before binary, bytes long, last boolean")


def _id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's conversation ids (decimal, ascending, comma-joined): (depth, digest, ends_sha256)."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    some = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    blocks = ends.groupBy(*_NODE, block).agg(F.array_join(some, ",").alias("ids"))
    rows = blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        schema = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())])
        for b in batches:
            out = []
            for depth, digest, ids in zip(*(b.column(x).to_pylist() for x in ("depth", "digest", "ids"))):
                if (depth, digest) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (depth, digest), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*node, sha.hexdigest()), schema)], schema=schema)

    return rows.mapInArrow(stream, "depth long, digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, together: str = "conv_id") -> DataFrame:
    """One row for each distinct prefix of the conversations in ``turns`` (as ``prefixes`` takes them).

    Returns digest, depth, conv_id (smallest member), parent_conv_id (the parent's; null for the root),
    n_convs (members), n_children, n_leaves (childless nodes of the subtree, its top included),
    saved_tokens (summed over the subtree: members but one, times bytes of the last text), and
    ends_sha256 (of the ids that end here; none: of the empty text).

    Repeated turns count as turns, repeated conversations as members. Null ids don't occur; null texts are
    the caller's to fill. Texts of any length travel as digests. Without conversations there is no row, not even a root.
    """
    p = materialise(prefixes(turns, together), "trie-prefixes")
    nodes = p.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("before").alias("before")
    )
    nodes = materialise(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("digest"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), _NODE, "left").fillna(0, ["n_children"])
    nodes = materialise(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-children")

    many = max(64, nodes.count() // 1_000)

    # a representative's nodes are a path: its sums go to all ancestors above it
    paths = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")
    )
    above = p.select("conv_id", *_NODE).join(paths.filter("top > 0"), "conv_id").filter("depth < top")
    above = above.groupBy(*_NODE).agg(F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    along = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("conv_id").orderBy("depth")
    nodes = nodes.select(
        "*", F.sum("saved").over(along).alias("saved_along"), F.sum("leaf").over(along).alias("leaves_along"),
        (F.row_number().over(first) == 1).alias("is_top"),
    )

    # parents: within a path the representative itself, for a path's top that of the node it hangs from
    parent = [(F.col("depth") + 1).alias("depth"), F.col("digest").alias("before"), F.col("conv_id").alias("parent_conv_id")]
    hot = nodes.filter(F.col("n_children") > many).select(*parent)
    rest = nodes.filter((F.col("n_children") > 0) & (F.col("n_children") <= many)).select(*parent)
    tops = nodes.filter("is_top and depth > 0").select(*_NODE, "before")
    found = tops.join(F.broadcast(hot), ["depth", "before"], "left")
    found = found.filter("parent_conv_id is not null").select(*_NODE, "parent_conv_id").union(
        found.filter("parent_conv_id is null").drop("parent_conv_id").join(rest, ["depth", "before"]).select(*_NODE, "parent_conv_id")
    )
    ids = _id_digests(p.filter("last").select(*_NODE, "conv_id"))
    out = nodes.join(above, _NODE, "left").join(found, _NODE, "left").join(ids, _NODE, "left")
    return out.select(
        "digest", "depth", "conv_id",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children",
        (F.col("leaves_along") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
        (F.col("saved_along") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
