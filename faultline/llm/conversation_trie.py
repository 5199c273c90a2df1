"""Prefix trie of conversations by burst tries.

A turn's id is 128 bits of the SHA-256 of its role and text; texts are read once and never shuffled.
Conversations are cut into segments of `segment` turns, so no row or group grows with a
conversation's length: a segment's trie head is the digest of all segments before it. Equal suffixes
under one head are folded into one row with its number of conversations.

Containers hold the suffixes below one head. A container of more than `container` turns bursts: its
suffixes lose their common prefix and the next turn id, and that id names their new container. This
repeats, for all heads and segments at once, until every container is small; the number of rounds is
that of branchings along a crowded path. Small containers are dealt to shards, sorted and swept into
nodes with a stack. Leaves and saved tokens flow from containers to the nodes that burst, and from a
segment to the one before as suffix sums along conversations: what lies below a head is the sum, over
its conversations, of the heads further down of which each is the smallest member.

Nulls: an empty role or text; a null turn comes first; rows without conv_id belong to no conversation.
Turns with one number are ordered by their ids; repeated rows are turns of their own. Extra columns are
ignored. A table without conversations has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.skew import bucketed_rank
from faultline.session import cut_lineage

#: Bytes of a turn id.
ID = 16
SEGMENT = 1024
CONTAINER = 100_000
ROOT = b""

NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
_SWEPT = NODES + ", is_head boolean, node binary, parent binary, boundary boolean"


def _digest(*columns: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*columns), 256)), 1, ID)


def _tag(letter: str) -> Column:
    return F.lit(letter).cast("binary")


def next_head(head: Column, ids: Column) -> Column:
    """The head that follows a full segment."""
    return _digest(_tag("s"), head, F.unhex(F.sha2(ids, 256)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), id, chars of every turn.

    Places are counted by ranges of the whole order, so a long conversation is not one task.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", _digest(named.cast("binary")).alias("id"), F.length(text).cast("long").alias("chars")
    )
    dealt = cut_lineage(
        turns.repartitionByRange("conv_id", "turn", "id").withColumn("range", F.spark_partition_id()), "turns"
    )
    placed = bucketed_rank(dealt, ["conv_id"], F.col("range"), ["turn", "id"], "place")
    return placed.select("conv_id", (F.col("place") - 1).cast("long").alias("place"), "id", "chars")


def share_heads(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Replaces the first h turns of conversation c by those of c - c % block.

    h is crc32(c as text) % most. A shorter or missing first conversation gives fewer turns. Returns
    the new turns and (conv_id, size) of all conversations, also of those without turns.
    """
    turns = cut_lineage(turns, "placed")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.where(F.col("place") < most - 1).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "chars"))).alias("head")
    ).withColumnRenamed("conv_id", "first")
    convs = sizes.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % block)
    convs = convs.join(heads, "first", "left").withColumn(
        "head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType))
    )
    taken = F.size("head").cast("long")
    convs = cut_lineage(convs.select(
        "conv_id", "h", "head", taken.alias("taken"),
        (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"),
    ), "conversations")
    shared = convs.select("conv_id", F.inline("head")).select("conv_id", "place", "id", "chars")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id", "chars"
    )
    return shared.union(rest), convs.select("conv_id", "size")


def segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """conv_id, seg, ids, chars, head. The last segment of a conversation is never full, maybe empty."""
    at = F.floor(F.col("place") / segment)
    last = F.floor(F.col("size") / segment)
    turn = F.struct("place", "id", "chars")
    marks = convs.select("conv_id", last.alias("seg"), F.lit(None).cast(turns.select(turn).schema[0].dataType).alias("turn"))
    rows = turns.select("conv_id", at.alias("seg"), turn.alias("turn")).union(marks).groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list("turn")).alias("turns")
    )
    rows = cut_lineage(rows.select(
        "conv_id", "seg",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("ids"),
        F.col("turns.chars").alias("chars"),
    ), "segments")
    long_ones = rows.join(convs.where(last > 0).select("conv_id"), "conv_id")
    digests = long_ones.select("conv_id", "seg", F.unhex(F.sha2("ids", 256)).alias("digest"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head = None, ROOT
        for batch in batches:
            heads = []
            for conv_id, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if conv_id != own:
                    own, head = conv_id, ROOT
                heads.append(head)
                head = hashlib.sha256(b"s" + head + digest).digest()[:ID]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(heads, pa.binary())], names=["conv_id", "seg", "head"]
            )

    heads = digests.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(
        chain, "conv_id long, seg long, head binary"
    )
    return rows.join(heads, ["conv_id", "seg"], "left").withColumn("head", F.coalesce("head", F.lit(ROOT)))


def end_digests(ended: DataFrame) -> DataFrame:
    """key, n, least, ends: SHA-256 of a key's conv_ids, ascending and comma-joined.

    Sorted ids become blocks of text, and blocks are hashed in order: a key with very many
    conversations sends few rows to its task, which holds one batch of them.
    """
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            parts = [(keys[a], ids[a], b - a, ",".join(map(str, ids[a:b]))) for a, b in zip(starts, [*starts[1:], len(keys)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*parts), [pa.binary(), pa.int64(), pa.int64(), pa.string()])],
                names=["key", "least", "n", "listed"],
            ) if parts else pa.RecordBatch.from_pylist([], schema=_BLOCKS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state = None
        for batch in batches:
            done = []
            for key, least, n, listed in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or key != own[0]:
                    if own:
                        done.append((*own, state.hexdigest()))
                    own, state = [key, 0, least], hashlib.sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
                own[1] += n
            yield _folded(done)
        if own:
            yield _folded([(*own, state.hexdigest())])

    blocks = ended.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions(
        "key", "conv_id").mapInArrow(block, "key binary, least long, n long, listed string")
    return blocks.repartition("key").sortWithinPartitions("key", "least").mapInArrow(
        fold, "key binary, n long, least long, ends string")


_BLOCKS = pa.schema([("key", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("listed", pa.string())])
_FOLDED = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])


def _folded(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_FOLDED.names, r)) for r in rows], schema=_FOLDED)


def folded_suffixes(rows: DataFrame, segment: int) -> DataFrame:
    """Distinct suffixes below each head, with their conversations: n, least, ends; `next` if full."""
    keyed = rows.withColumn("key", _digest(_tag("e"), F.col("head"), F.col("ids")))
    full = F.length("ids") == segment * ID
    ended = keyed.where(~full)
    texts = keyed.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("seg", "head", "ids", "chars")])
    counted = end_digests(ended).unionByName(
        keyed.where(full).groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.lit(None).cast("string").alias("ends"))
    )
    return texts.join(counted, "key").select(
        F.col("head").alias("node"), (F.col("seg") * segment).alias("depth"), "ids", "chars", "n", "least", "ends",
        F.when(full, next_head(F.col("head"), F.col("ids"))).alias("next"),
        F.lit(0).cast("long").alias("top"), F.lit(None).cast("long").alias("above"),
        F.lit(None).cast("binary").alias("parent"), (F.col("seg") > 0).alias("boundary"),
    )


def burst(rows: DataFrame, container: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Small containers and, by round, the heads that burst on the way to them."""
    small, bursts = [], []
    while True:
        # Two suffixes at least; the rows of one container are distinct.
        sizes = rows.groupBy("node").agg(
            F.sum(F.length("ids") / ID).alias("turns"), F.count(F.lit(1)).alias("suffixes"),
            F.min("ids").alias("low"), F.max("ids").alias("high"),
            F.min("least").alias("rep"), F.sum("n").alias("members"),
        ).where(F.col("turns") > container).where("suffixes > 1")
        shorter = (F.least(F.length("low"), F.length("high")) / ID).cast("int")
        differs = F.transform(
            F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.col("low").substr(i * ID + 1, F.lit(ID)) != F.col("high").substr(i * ID + 1, F.lit(ID)),
        )
        at = F.array_position(differs, True).cast("int")
        large = cut_lineage(sizes.select(
            "node", "rep", "members", F.when(at > 0, at - 1).otherwise(shorter).alias("common")), "large")
        if large.isEmpty():
            return [*small, rows], bursts
        tagged = cut_lineage(rows.join(large, "node", "left"), "containers")
        small.append(tagged.where("common is null").select(*rows.columns))
        crowded = tagged.where("common is not null")
        here = F.length("ids") == F.col("common") * ID
        bursts.append(cut_lineage(crowded.groupBy("node").agg(
            *[F.any_value(c).alias(c) for c in ("depth", "top", "above", "parent", "boundary", "rep", "members", "common")],
            F.any_value(F.slice("chars", F.lit(1), F.col("common"))).alias("path"),
            F.max(F.when(here, F.col("ends"))).alias("ends"),
        ), "bursts"))
        moved = F.col("common") + 1
        named = _digest(_tag("b"), F.col("node"), F.col("ids").substr(F.lit(1), moved * ID))
        rows = cut_lineage(crowded.where(~here).select(
            named.alias("node"), (F.col("depth") + moved).alias("depth"),
            F.col("ids").substr(moved * ID + 1, F.length("ids")).alias("ids"),
            F.slice("chars", moved + 1, F.size("chars")).alias("chars"),
            "n", "least", "ends", "next", F.get("chars", F.col("common")).alias("top"),
            F.col("rep").alias("above"), F.col("node").alias("parent"), F.lit(False).alias("boundary"),
            *[c for c in rows.columns if c.startswith("carried")],
        ).select(*rows.columns), "containers")


def sweep(suffixes: list[dict]) -> list[tuple]:
    """The nodes of one container from its sorted suffixes; the first is its head."""
    first = suffixes[0]
    # Of each node: parent's place, chars, conversations that end or go on, least, children, leaves, saved, ends.
    above, chars, n, least = [-1], [first["top"]], [0], [None]
    children, leaves, saved, ends, goes_on, level = [0], [0], [0], [None], [False], [0]
    stack, before = [0], b""
    for row in suffixes:
        ids = row["ids"]
        shared, size = 0, len(ids) // ID
        while shared < min(size, len(before) // ID) and ids[shared * ID:(shared + 1) * ID] == before[shared * ID:(shared + 1) * ID]:
            shared += 1
        del stack[shared + 1:]
        for i in range(shared, size):
            above.append(stack[-1])
            stack.append(len(chars))
            chars.append(row["chars"][i])
            n.append(0)
            least.append(None)
            children.append(0)
            leaves.append(0)
            saved.append(0)
            ends.append(None)
            goes_on.append(False)
            level.append(i + 1)
        at = stack[-1]
        n[at], least[at], ends[at] = row["n"], row["least"], row["ends"]
        if row["next"] is not None:
            goes_on[at] = True
            children[at], leaves[at], saved[at] = row["carried_children"], row["carried_leaves"], row["carried_saved"]
            ends[at] = row["carried_ends"]
        before = ids
    for i in range(len(chars) - 1, -1, -1):
        if not children[i] and not goes_on[i]:
            leaves[i] = 1
        saved[i] += (n[i] - 1) * chars[i]
        up = above[i]
        if up >= 0:
            n[up] += n[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    depth = first["depth"]
    return [
        (least[i], depth + level[i], first["above"] if i == 0 else least[above[i]], n[i], children[i], leaves[i],
         saved[i], ends[i], i == 0, first["node"], first["parent"], first["boundary"])
        for i in range(len(chars))
    ]


def _swept(batches: Iterator[pa.RecordBatch], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and own[0]["node"] != row["node"]:
                found += sweep(own)
                own = []
            own.append(row)
        if len(found) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), target)], schema=target)
            found = []
    if own:
        found += sweep(own)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), target)], schema=target)


def trie_nodes(rows: DataFrame, container: int) -> tuple[DataFrame, DataFrame]:
    """All nodes of the suffixes, and what lies below the heads of segments.

    The second is (node, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small, bursts = burst(rows, container)
    containers = small[0]
    for more in small[1:]:
        containers = containers.union(more)
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], _SWEPT).schema)
    swept = cut_lineage(
        containers.repartition("node").sortWithinPartitions("node", "ids").mapInArrow(lambda b: _swept(b, target), _SWEPT),
        "swept",
    )
    columns = [c.split()[0] for c in NODES.split(", ")]
    summary = ["node", "parent", "boundary", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes, heads = [swept.where("not (is_head and boundary)").select(*columns)], swept.where("is_head").select(*summary)
    for late in reversed(bursts):
        below = heads.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        path = F.concat(F.array("top"), F.col("path"))
        known = cut_lineage(late.join(below, "node").withColumn("path", path), "heads")
        spent = F.aggregate(
            F.slice("path", F.col("at") + 1, F.size("path")), F.lit(0).cast("long"), lambda a, c: a + c
        ) * (F.col("members") - 1)
        is_last = F.col("at") == F.col("common")
        own = known.select("*", F.explode(F.sequence(F.lit(0), F.col("common"))).alias("at")).select(
            F.col("rep").alias("conv_id"), (F.col("depth") + F.col("at")).alias("depth"),
            F.when(F.col("at") == 0, F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"),
            F.col("members").alias("n_convs"), F.when(is_last, F.col("kids")).otherwise(1).alias("n_children"),
            "n_leaves", (F.col("below") + spent).alias("saved_tokens"), F.when(is_last, F.col("ends")).alias("ends_sha256"),
            (F.col("at") == 0).alias("is_head"), "node", "parent", "boundary",
        )
        nodes.append(own.where("not (is_head and boundary)").select(*columns))
        heads = heads.union(own.where("is_head").select(*summary))
    found = nodes[0]
    for more in nodes[1:]:
        found = found.union(more)
    below = heads.where("boundary").select("node", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), below


def below_heads(rows: DataFrame, local: DataFrame) -> DataFrame:
    """What lies below each head of a later segment, through all segments after it."""
    later = rows.where("seg > 0").select("conv_id", "seg", F.col("head").alias("node"))
    least = later.groupBy("node").agg(F.min("conv_id").alias("rep"))
    counts = later.join(local, "node").join(least, "node")
    own = F.col("conv_id") == F.col("rep")
    onwards = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        "node", "n_children", "ends_sha256", *[F.sum(F.when(own, F.col(c)).otherwise(0)).over(onwards).alias(c) for c in ("n_leaves", "saved_tokens")]
    )
    return sums.groupBy("node").agg(
        F.max("n_children").alias("carried_children"), F.max("ends_sha256").alias("carried_ends"), F.sum("n_leaves").alias("carried_leaves"),
        F.sum("saved_tokens").alias("carried_saved"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, container: int = CONTAINER) -> DataFrame:
    """One row per node: its smallest conversation, depth, parent, members, children, leaves, savings.

    `turns` has conv_id, place (from 0, without gaps), id, chars; `convs` has conv_id and size of all
    conversations, also of those without turns.
    """
    rows = cut_lineage(segments(turns, convs, segment), "heads")
    suffixes = cut_lineage(folded_suffixes(rows, segment), "suffixes")
    nothing = [F.lit(0).cast("long").alias(c) for c in ("carried_children", "carried_leaves", "carried_saved")]
    nothing.append(F.lit(None).cast("string").alias("carried_ends"))
    _, local = trie_nodes(suffixes.where("boundary").select("*", *nothing), container)
    carried = below_heads(rows, local).withColumnRenamed("node", "next")
    nodes, _ = trie_nodes(cut_lineage(suffixes.join(carried, "next", "left").select(*suffixes.columns, *carried.columns[1:]), "carried"), container)
    return nodes
