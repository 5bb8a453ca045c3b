"""Prefix trie of conversations (operator 12): which beginnings conversations share, and what sharing them saves.

A node stands for a sequence of turns and is named by a chain of hashes, each of the one before and a turn, so that
equal beginnings get equal names anywhere. Tasks walk whole conversations in order and keep a table of nodes in which
equal ones are combined; full tables are emitted as partial tries. Partial tries are merged by rounds keyed by node and
a shrinking number of table groups, so that no task meets a busy node's partial counts from all others at once. Members
are summed, and lists of the conversations that end at a node are cut by ranges of their ids into bounded chunks,
which one pass per node hashes in order.

The roll-up from the leaves doubles its reach: each node carries the names of its ancestors one, two, four, ... levels
up, round k adds to every node the sums of those 2^k below it, and after log2(depth) rounds a node has the sum of its
subtree. Deep conversations cost rounds by the logarithm of their length, and no pair of a node and all of its
ancestors is made.

With `rebuild` each conversation first borrows turns of its hundred's first one, as many as a check sum of its id says, in
place of its own.

Defined results: a null role or text is empty; a null turn comes first, and equal turns follow each other by role and
text; repeated rows are turns each; rows without a conversation id are no conversation's; an id keeps its sign in the
remainder, so that those of -99 to 99 belong to conversation 0; a conversation without turns ends at the root; an empty
table gives an empty result; other columns are ignored whatever their names. A task holds 16 bytes for each turn
of the conversation it walks, and a table of bounded size.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, stored, table

#: Conversations of a block borrow from its first one, at most so many turns less one.
BLOCK, BORROWED = 100, 6
#: Nodes in a task's table, and partial tables that a merge brings together.
NODES, FAN = 50_000, 64
#: Ids in a range of ends: a chunk of a node's list has no more.
ENDS_SHIFT = 12
ROOT = bytes(16)


def borrowed(conv: int) -> int:
    return crc32(str(conv).encode()) % BORROWED


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(block, conv, key, chars) in the order in which a block's conversations are walked: its first one, then the others."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(conv_col).cast("long")
    rows = conversations.where(conv.isNotNull()).select(
        conv.alias("conv"), (conv - conv % BLOCK).alias("block"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.length(text).cast("long").alias("chars"),
    )
    first = F.col("conv") != F.col("block")
    dealt = rows.repartition("block").sortWithinPartitions("block", first, "conv", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("block", "conv", "key", "chars")


class PartialTrie:
    """A task's table of nodes: name to depth, characters of the last turn, members, smallest member, ends and ancestors.

    A conversation is walked turn by turn; the table may be emptied at any turn, as counts of partial tables add up.
    """

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.held = 0
        self._conv, self._chain, self._chars = 0, bytearray(ROOT), 0

    def _node(self, members: int) -> list:
        """The entry of the place that the walk has reached."""
        chain, depth = self._chain, len(self._chain) // 16 - 1
        name = bytes(chain[-16:])
        node = self.nodes.get(name)
        if node is None:
            up = [bytes(chain[16 * (d := depth - (1 << k)) : 16 * d + 16]) for k in range(depth.bit_length())]
            node = self.nodes[name] = [depth, self._chars, 0, self._conv, [], up]
            self.held += 1 + len(up)
        node[2] += members
        node[3] = min(node[3], self._conv)
        return node

    def start(self, conv: int) -> None:
        self._conv, self._chain, self._chars = conv, bytearray(ROOT), 0
        self._node(1)

    def step(self, key: bytes, chars: int) -> None:
        self._chain += hashlib.blake2b(bytes(self._chain[-16:]) + key, digest_size=16).digest()
        self._chars = chars
        self._node(1)

    def end(self) -> None:
        self._node(0)[4].append(self._conv)
        self.held += 1

    def batch(self, task: int) -> pa.RecordBatch:
        """The table as rows; it is empty afterwards."""
        rows = list(self.nodes.values())
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        names = pa.array(list(self.nodes), pa.binary())
        self.nodes, self.held = {}, 0
        return pa.RecordBatch.from_arrays([names, pa.array([task] * len(rows), pa.int32()), *columns], names=[c.split()[0] for c in PARTIAL.split(", ")])


PARTIAL = "node binary, part int, depth int, chars long, n_convs long, conv_id long, ends array<long>, up array<binary>"


def partial_tries(walked: DataFrame, rebuild: bool) -> DataFrame:
    """PARTIAL of the conversations of turns: as rebuilt from their blocks' first ones, or as they are."""
    rows = walked.select(F.spark_partition_id().alias("task"), "block", "conv", "key", "chars")

    def run(batches):
        trie, task, block, conv, skip, at = PartialTrie(), 0, None, None, 0, 0
        head: list[tuple[bytes, int]] = []  # first turns of the block's first conversation
        for batch in batches:
            for task, b, c, key, chars in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if conv is not None:
                        trie.end()
                    if b != block:
                        block, head = b, []
                    conv, skip, at = c, borrowed(c) if rebuild and c != b else 0, 0
                    trie.start(c)
                    for turn in head[:skip]:
                        trie.step(*turn)
                if at >= skip:
                    trie.step(key, chars)
                at += 1
                if c == b and len(head) < BORROWED - 1:
                    head.append((key, chars))
                if trie.held >= NODES:
                    yield trie.batch(task)
        if conv is not None:
            trie.end()
            yield trie.batch(task)

    return rows.mapInArrow(releasing(run), PARTIAL)


def merged(partial: DataFrame) -> DataFrame:
    """(node, depth, chars, n_convs, conv_id, up): partial tries merged FAN at a time until one is left."""
    groups = (partial.agg(F.max("part")).first()[0] or 0) + 1
    rows = partial.drop("ends")
    one = [F.first(c).alias(c) for c in ("depth", "chars", "up")] + [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    while True:
        groups = -(-groups // FAN)
        if groups <= 1:
            return rows.groupBy("node").agg(*one)
        rows = rows.groupBy("node", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(*one)


def ends(partial: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids that end at a node, ascending and comma-joined."""
    each = partial.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv"))
    # ids are distinct, so a range of them bounds a chunk
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = each.groupBy("node", F.shiftright("conv", ENDS_SHIFT).alias("range")).agg(listed.alias("ids"))
    ordered = chunks.repartition("node").sortWithinPartitions("node", "range").select("node", "ids")

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield batch_of(done)
        if node is not None:
            yield batch_of([(node, digest.hexdigest())])

    def batch_of(rows):
        return pa.RecordBatch.from_pydict({"node": pa.array([r[0] for r in rows], pa.binary()), "ends_sha256": pa.array([r[1] for r in rows], pa.string())})

    return ordered.mapInArrow(releasing(run), "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, n_leaves, saved_tokens) of (node, n_leaves, saved_tokens, up): sums over subtrees, depth is the greatest."""
    rows, sums = nodes, ("n_leaves", "saved_tokens")
    for k in range(depth.bit_length()):
        last = k == depth.bit_length() - 1
        self, above = F.struct("node", *sums, "up"), F.struct(F.get("up", F.lit(k)).alias("node"), *sums, F.lit(None).cast("array<binary>").alias("up"))
        both = rows.select(F.inline(F.when(F.size("up") > k, F.array(self, above)).otherwise(F.array(self))))
        carried = [] if last else [F.first("up", ignorenulls=True).alias("up")]
        rows = both.groupBy("node").agg(*[F.sum(c).alias(c) for c in sums], *carried)
    return rows.select("node", *sums)


def trie(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True
) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and node and parent, their names."""
    small_batches(conversations.sparkSession)
    partial = stored(partial_tries(turns(conversations, conv_col, turn_col, role_col, text_col), rebuild))
    nodes = stored(merged(partial).withColumn("parent", F.get("up", F.lit(0))))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    full = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = full.select("node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), "up")
    sums = rolled_up(own, nodes.agg(F.max("depth")).first()[0] or 0)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = full.drop("up", "chars").join(sums, "node").join(ends(partial), "node", "left").join(above, "parent", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    found = trie(table(spark, sf_dir, "conversations"))
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


#: Paths as lists of turns, each node grouped by the path itself; the check sum bit by bit.
ORACLE = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS path
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
summed AS (
  SELECT *, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.path, 1, c.h), []), coalesce(list_slice(c.path, c.h + 1, len(c.path)), [])) AS path
  FROM summed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
placed AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT CASE WHEN depth > 0 THEN list_slice(path, 1, depth) ELSE [] END AS name, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
  FROM placed GROUP BY ALL),
family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.name[1:n.depth] = n.name) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.name = n.name[1:n.depth - 1]),
valued AS (SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * length(name[depth].text) ELSE 0 END AS saved FROM family)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, count(*) FILTER (d.n_children = 0) AS n_leaves,
  sum(d.saved)::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN valued d ON d.depth >= v.depth AND d.name[1:v.depth] = v.name GROUP BY ALL
"""
