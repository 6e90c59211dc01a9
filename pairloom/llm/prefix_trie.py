"""The prefix trie of all conversations by van Emde Boas recursion.

Sequences are cut at half depth, at every scale: a prefix of d turns is named by the
prefix before the cut and the digest of the stretch behind it, where the cut is d without
its lowest bit. So a name follows from a few digests, equal prefixes have equal names
whatever conversation they stand in, and all halves of one size are handled together.
Conversations travel in blocks of 64 turns; a sequence of more than one block is named
first as a sequence of blocks, by the same recursion, and each block starts from the name
of the prefix before it. No task ever holds a whole long conversation.

Totals go up the same way. In one round per size s (1, 2, 4, ..), every trie of depth s
takes in the forests of depth s below its deepest nodes: a forest's total is added to the
cut node above it and to that node's ancestors within the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.tables import partitions, stored

BITS = 6
BLOCK = 1 << BITS
#: Name of the empty prefix.
ROOT = bytes(16)
#: Characters of joined identifiers that travel in one row.
CHUNK = 1 << 16
NAMED = "conv_id bigint, depth bigint, name binary, parent binary, n_bytes bigint, last boolean, path array<binary>"


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def _hash(a: bytes, b: bytes) -> bytes:
    return hashlib.blake2b(a + b, digest_size=16).digest()


def _stretches(digests: list[bytes]) -> list[list[bytes]]:
    """Digests of the aligned stretches of 1, 2, 4, .. items."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_hash(below[i], below[i + 1]) for i in range(0, len(below) - 1, 2)])
    return levels


def _names(start: bytes, end: bytes | None, digests: list[bytes]) -> list[bytes]:
    """Names of the prefixes that end before the first item, behind it, .. behind the last."""
    levels, names = _stretches(digests), [start]
    for i in range(1, len(digests) + 1):
        low = i & -i
        names.append(_hash(names[i - low], levels[low.bit_length() - 1][i // low - 1]))
    if end is not None and len(digests) == BLOCK:
        names[BLOCK] = end
    return names


def _name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per prefix. ``path`` has the names from the last cut before it to its own."""
    for batch in batches:
        convs, blocks, starts, ends = (batch.column(i).to_pylist() for i in range(4))
        items, at = batch.column(4), batch.column(4).offsets.to_pylist()
        digests, sizes, lasts = (items.values.field(f).to_pylist() for f in ("digest", "n_bytes", "last"))
        out = [[] for _ in range(7)]
        for r, conv in enumerate(convs):
            lo, hi = at[r], at[r + 1]
            names = _names(starts[r] or ROOT, ends[r], digests[lo:hi])
            out[0] += [conv] * (hi - lo)
            out[1] += range(blocks[r] * BLOCK + 1, blocks[r] * BLOCK + 1 + hi - lo)
            out[2] += names[1:]
            out[3] += names[:-1]
            out[4] += sizes[lo:hi]
            out[5] += lasts[lo:hi]
            out[6] += [names[i - (i & -i) : i + 1] for i in range(1, hi - lo + 1)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.binary())]
        names = ["conv_id", "depth", "name", "parent", "n_bytes", "last", "path"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)


def _block_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, at = batch.column(2), batch.column(2).offsets.to_pylist()
        digests = items.values.field("digest").to_pylist()
        whole = [r for r in range(batch.num_rows) if at[r + 1] - at[r] == BLOCK]
        tops = [_stretches(digests[at[r] : at[r + 1]])[-1][0] for r in whole]
        rows = batch.select([0, 1]).take(pa.array(whole, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(tops, pa.binary())], names=["conv_id", "pos", "digest"])


def _named(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Every prefix of every sequence with its name, then the same for the sequences of
    blocks, and so on up."""
    item = F.struct("pos", "digest", "n_bytes", "last")
    block = F.shiftright("pos", BITS).alias("block")
    blocks = turns.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.lit(None).cast("binary")
    if longest <= BLOCK:
        return [stored(blocks.select("conv_id", "block", none.alias("start"), none.alias("end"), "items").mapInArrow(_name_blocks, NAMED), "named")]
    blocks = stored(blocks, "blocks")
    above = blocks.mapInArrow(_block_digests, "conv_id bigint, pos bigint, digest binary")
    upper = _named(above.select("*", F.lit(0).cast("bigint").alias("n_bytes"), F.lit(False).alias("last")), longest // BLOCK)
    cuts = upper[0].select("conv_id", F.col("depth").alias("block"), F.col("name").alias("start"))
    ends = cuts.select("conv_id", (F.col("block") - 1).alias("block"), F.col("start").alias("end"))
    both = blocks.join(cuts, ["conv_id", "block"], "left").join(ends, ["conv_id", "block"], "left")
    return [stored(both.select("conv_id", "block", "start", "end", "items").mapInArrow(_name_blocks, NAMED), "named"), *upper]


def _nodes(named: DataFrame) -> DataFrame:
    """Prefixes with the same name are one node; its smallest member speaks for it."""
    one = F.min(F.struct("conv_id", "depth", "parent", "n_bytes", "path")).alias("_one")
    grouped = named.groupBy("name").agg(one, F.count(F.lit(1)).alias("n_convs"))
    return grouped.select("name", "_one.*", "n_convs")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined identifiers of the sorted rows, a name's in rows of bounded length."""
    for batch in batches:
        out: list[list] = [[], [], []]
        now, ids, length = None, [], 0
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != now or length > CHUNK:
                if ids:
                    out[2].append(",".join(ids))
                now, ids, length = name, [], 0
                out[0].append(name)
                out[1].append(conv)
            ids.append(str(conv))
            length += len(ids[-1]) + 1
        if ids:
            out[2].append(",".join(ids))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["name", "first", "ids"])


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, None

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([s.hexdigest() for _, s in done], pa.string())], names=["name", "ends_sha256"])

    for batch in batches:
        done = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if name == now:
                sha.update(b",")
            else:
                if sha is not None:
                    done.append((now, sha))
                now, sha = name, hashlib.sha256()
            sha.update(ids.encode())
        if done:
            yield rows(done)
    if sha is not None:
        yield rows([(now, sha)])


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined identifiers that end in each node. All pairs are sorted
    together and joined to long rows where they lie, so a node in which a third of all
    conversations end sends its digest's task few rows, which are read one by one."""
    rows = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    chunks = rows.select("name", "conv_id").mapInArrow(_chunks, "name binary, first bigint, ids string")
    placed = chunks.repartition("name").sortWithinPartitions("name", "first")
    return placed.mapInArrow(_digest_chunks, "name binary, ends_sha256 string")


def _ancestors(cut: DataFrame, paths: list[DataFrame], level: int, sums: list[str]) -> DataFrame:
    """Add what came to each cut node to its ancestors within its trie: along block ends
    first where the trie is deeper than a block, then inside the blocks."""
    for at in range(level, -1, -1):
        steps = F.posexplode(F.slice("path", 2, F.size("path") - 1)).alias("_i", "_to")
        held = cut.select("name", *sums).join(paths[at].select("name", "path", "depth"), "name").select("path", "depth", *sums, steps)
        # Blocks end every BLOCK ** at turns at this level.
        away = (F.size("path") - 2 - F.col("_i")) * F.lit(BLOCK**at)
        held = held.select(F.col("_to").alias("name"), F.get("path", F.col("_i")).alias("parent"), (F.col("depth") - away).alias("depth"), *sums)
        cut = held.groupBy("name").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums])
    return cut


def subtree_sums(nodes: DataFrame, paths: list[DataFrame], deepest: int, sums: list[str]) -> DataFrame:
    """``sums`` added up over each node's subtree, the node included."""
    rows = [stored(nodes.select("name", "parent", "depth", *sums), "own")]
    size = 1
    while size < deepest:
        # Roots of the forests below the tries of this size.
        roots = reduce(DataFrame.unionByName, rows).filter(F.col("depth") % (2 * size) == (size + 1) % (2 * size))
        forests = roots.groupBy(F.col("parent").alias("name")).agg(*[F.sum(c).alias(c) for c in sums])
        rows.append(stored(_ancestors(forests, paths, (size.bit_length() - 1) // BITS, sums), "grafted"))
        size *= 2
    return reduce(DataFrame.unionByName, rows).groupBy("name").agg(*[F.sum(c).alias(c) for c in sums])


def _with_parent(nodes: DataFrame, root: DataFrame, children: DataFrame, n_nodes: int) -> DataFrame:
    """Add the parent's ``conv_id``. Parents with more than an average partition of children,
    at most as many as there are partitions, are broadcast; the others meet by shuffle."""
    some = n_nodes // partitions(nodes.sparkSession) + 1
    named = nodes.unionByName(root).select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    many = children.filter(F.col("n_children") > some).select(F.col("name").alias("parent"))
    heavy = nodes.join(F.broadcast(named.join(many, "parent")), "parent")
    light = nodes.join(F.broadcast(many), "parent", "left_anti").join(named, "parent")
    return heavy.unionByName(light).unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("bigint")))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations.

    ``turns``: ``conv_id`` (integer), ``pos`` (0, 1, .. in each conversation), ``digest``
    (``turn_digest``), ``n_bytes`` and ``last`` (of its conversation). ``convs``: every ``conv_id`` with its ``length``, the
    number of its turns, which may be 0. Both without nulls and repeats; columns of other
    names are ignored.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` per distinct prefix, the empty one included; no
    conversations give no node. Cost is a row per turn, and per halving of the greatest
    depth half a row per node.
    """
    spark = turns.sparkSession
    convs = convs.select(F.col("conv_id").cast("bigint"), F.col("length").cast("bigint"))
    n_convs, least, longest = convs.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("length")).first()
    kind = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not n_convs:
        return spark.createDataFrame([], kind)
    zero = F.lit(0).cast("bigint")
    root = spark.range(1).select(
        F.lit(bytearray(ROOT)).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(least).alias("conv_id"), zero.alias("depth"), F.lit(n_convs).alias("n_convs")
    )
    turnless = convs.filter("length = 0").select(F.lit(bytearray(ROOT)).alias("name"), "conv_id")
    if not longest:
        leaf = [F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", zero.alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens")]
        return root.join(ends_digests(turnless), "name").select("conv_id", "depth", *leaf, "ends_sha256")

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("pos").cast("bigint"), "digest", F.col("n_bytes").cast("bigint"), "last")
    named = _named(rows, longest)
    below = stored(_nodes(named[0]), "nodes")
    paths = [below, *[stored(_nodes(n), "cuts").withColumn("depth", F.col("depth") * BLOCK**i) for i, n in enumerate(named[1:], 1)]]
    children = stored(below.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")
    own = below.join(children, "name", "left").select("name", "parent", "depth", F.col("n_children").isNull().cast("bigint").alias("n_leaves"), saved)
    sums = ["n_leaves", "saved_tokens"]
    totals = subtree_sums(own, paths, longest, sums)
    n_nodes, *whole = own.agg(F.count(F.lit(1)), *[F.sum(c) for c in sums]).first()
    at_root = spark.range(1).select(F.lit(bytearray(ROOT)).alias("name"), *[F.lit(v).alias(c) for c, v in zip(sums, whole, strict=True)])
    linked = _with_parent(below.select("name", "parent", "conv_id", "depth", "n_convs"), root, children, n_nodes)
    ends = ends_digests(named[0].filter("last").select("name", "conv_id").unionByName(turnless))
    found = linked.join(totals.unionByName(at_root), "name").join(children, "name", "left").join(ends, "name", "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
