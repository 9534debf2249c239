r"""A Merkle manifest of a table, with a proof for every row, by time-forward processing.

A node's label is (level, index).  Every digest is a message to the parent's label; a priority queue ordered by label hands a
node all messages of its children when its turn comes.  The external part of the queue is the shuffle: a task takes the messages
of one block of ``2 ** levels`` labels and sends on the one digest that leaves the block, so a round climbs ``levels`` levels and
the next is that many times smaller.  The reversed sweep starts at the root and hands every node the suffix of its proof, block
by block, until it reaches the leaves.  A task holds one block, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.lineage import cut_lineage
from folioframe.operators.ordered import Ordered

LEVELS = 12  # a block has at most 2 ** levels nodes of one level
_GROUP, _POS, _BLOCK, _DIGEST = "__m_group", "__m_pos", "__m_block", "__m_digest"
_PROOF, _STEPS, _SUBROOT, _ROOT = "__m_proof", "__m_steps", "__m_subroot", "__m_root"
_MESSAGE = [_PROOF, _STEPS, _SUBROOT, _ROOT]


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 over the values: ``-`` for a null, else the value's UTF-8 bytes after their count and a colon."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def fold(leaf: Column, proof: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to; ``steps`` as ``manifest`` gives them."""
    def step(acc: Column, side: Column) -> Column:
        other = F.substr(proof, acc["at"], F.lit(64))
        both = F.when(side == "L", F.concat(other, acc["d"])).when(side == "R", F.concat(acc["d"], other)).otherwise(acc["d"])
        return F.struct(F.sha2(both, 256).alias("d"), (acc["at"] + F.when(side == "-", 0).otherwise(64)).alias("at"))
    sides = F.filter(F.split(steps, ""), lambda s: s != "")
    return F.aggregate(sides, F.struct(leaf.alias("d"), F.lit(1).alias("at")), step, lambda acc: acc["d"])


# -- inside a block ------------------------------------------------------------------

def _height(block: int, nodes: int, levels: int) -> int:
    """Levels above a block's nodes; a first block that is not full is its group's only one and ends at its root."""
    return (nodes - 1).bit_length() if block == 0 else levels


def climb(digests: Sequence[str], height: int) -> dict[tuple[int, int], str]:
    """Digests by label (level, index) of all nodes over ``digests``, which are level 0."""
    known = {(0, i): d for i, d in enumerate(digests)}
    queue = [(1, i >> 1, i & 1, d) for i, d in enumerate(digests)] if height else []  # ascending, hence a heap
    while queue:
        level, index, _, first = heapq.heappop(queue)
        both = first
        while queue and queue[0][:2] == (level, index):
            both += heapq.heappop(queue)[3]
        known[level, index] = made = hashlib.sha256(both.encode()).hexdigest()
        if level < height:
            heapq.heappush(queue, (level + 1, index >> 1, index & 1, made))
    return known


def descend(known: dict[tuple[int, int], str], height: int, proof: str, steps: str) -> list[tuple[str, str]]:
    """(proof, steps) of each node of level 0, in order; the block's top node has what is given."""
    queue, out = [(-height, 0, proof, steps)], []
    while queue:
        down, index, proof, steps = heapq.heappop(queue)
        if not down:
            out.append((proof, steps))
            continue
        level = -down - 1
        left, right = (level, 2 * index), (level, 2 * index + 1)
        if right in known:
            heapq.heappush(queue, (-level, left[1], known[right] + proof, "R" + steps))
            heapq.heappush(queue, (-level, right[1], known[left] + proof, "L" + steps))
        else:
            heapq.heappush(queue, (-level, left[1], proof, "-" + steps))
    return out


# -- the two sweeps --------------------------------------------------------------------

def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn(_BLOCK, F.shiftright(_POS, levels))


def _climb_block(levels: int, table: pa.Table) -> pa.Table:
    table = table.sort_by(_POS)
    block = table[_BLOCK][0].as_py()
    height = _height(block, len(table), levels)
    top = climb(table[_DIGEST].to_pylist(), height)[height, 0]
    return pa.table({_GROUP: table[_GROUP].slice(0, 1), _POS: pa.array([block], pa.int64()), _DIGEST: pa.array([top])})


def _upward(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of every round, the last one with one node a group; each but the first is written."""
    rounds = [nodes]
    while not rounds[-1].filter(F.col(_POS) > 0).isEmpty():
        blocks = _blocks(rounds[-1].select(_GROUP, _POS, _DIGEST), levels).groupBy(_GROUP, _BLOCK)
        step: Callable[[pa.Table], pa.Table] = lambda t: _climb_block(levels, t)
        rounds.append(cut_lineage(blocks.applyInArrow(step, f"{_GROUP} string, {_POS} long, {_DIGEST} string")))
    return rounds


def _descend_block(levels: int, nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes = nodes.sort_by(_POS)
    height = _height(nodes[_BLOCK][0].as_py(), len(nodes), levels)
    found = descend(climb(nodes[_DIGEST].to_pylist(), height), height, above[_PROOF][0].as_py(), above[_STEPS][0].as_py())
    out = nodes.drop_columns([_BLOCK])
    for name, values in zip((_PROOF, _STEPS), zip(*found)):
        out = out.append_column(name, pa.array(values, pa.string()))
    for name in (_SUBROOT, _ROOT):
        out = out.append_column(name, pa.array([above[name][0].as_py()] * len(nodes), pa.string()))
    return out


def _downward(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The nodes of the first round with the proofs that ``above``, one message a group, leads to."""
    message = above.withColumn(_POS, F.lit(0).cast("bigint"))
    if len(rounds) == 1:  # every group is one leaf
        return rounds[0].join(message.drop(_POS), _GROUP)
    step: Callable[[pa.Table, pa.Table], pa.Table] = lambda n, m: _descend_block(levels, n, m)
    for nodes in reversed(rounds[:-1]):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
        down = message.select(_GROUP, F.col(_POS).alias(_BLOCK), *_MESSAGE).groupBy(_GROUP, _BLOCK)
        message = (_blocks(nodes, levels).groupBy(_GROUP, _BLOCK).cogroup(down)
                   .applyInArrow(step, f"{fields}, " + ", ".join(f"{c} string" for c in _MESSAGE)))
    return message


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             levels: int = LEVELS, **keep: Column) -> DataFrame:
    """(id, leaf, subroot, root, proof, steps) for every row, and the columns ``keep`` names, computed from the row.

    A row's leaf is the digest of ``columns``.  The leaves of a group (null: a group of its own, the first) in the order of their
    ids (nulls first, then by leaf) are paired level by level, an odd last one alone, until one node, the group's subroot, is left; the
    subroots in the order of their groups (UTF-8 bytes) are paired the same way into the root.  ``proof`` is the siblings' digests from the
    leaf up, joined; ``steps`` has a letter a level: sibling at the left (L), at the right (R) or none (-).  Repeated rows are repeated
    leaves; an empty table gives no rows.  Other columns are left out whatever their names.
    """
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group_col).cast("string")))
    leaves = cut_lineage(rows.select(group.alias(_GROUP), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in columns]).alias(_DIGEST),
                                     *[c.alias(n) for n, c in keep.items()]))
    placed = cut_lineage(Ordered(leaves, [_GROUP], ["id", _DIGEST]).add(**{_POS: ("row",)}).done().withColumn(_POS, F.col(_POS) - 1))
    rounds = _upward(placed, levels)
    roots = rounds[-1].select(_GROUP, F.col(_DIGEST).alias(_SUBROOT))
    numbered = Ordered(roots, [], [_GROUP]).add(**{_POS: ("row",)}).done()
    tops = _upward(cut_lineage(numbered.select(F.lit("").alias(_GROUP), (F.col(_POS) - 1).alias(_POS), F.col(_SUBROOT).alias(_DIGEST), F.col(_GROUP).alias("of"))), levels)
    start = tops[-1].select(_GROUP, F.lit("").alias(_PROOF), F.lit("").alias(_STEPS), F.lit("").alias(_SUBROOT), F.col(_DIGEST).alias(_ROOT))
    above = _downward(tops, start, levels).select(F.col("of").alias(_GROUP), _PROOF, _STEPS, F.col(_DIGEST).alias(_SUBROOT), _ROOT)
    found = _downward(rounds, cut_lineage(above), levels)
    return found.select("id", F.col(_DIGEST).alias("leaf"), F.col(_SUBROOT).alias("subroot"), F.col(_ROOT).alias("root"), F.col(_PROOF).alias("proof"),
                        F.col(_STEPS).alias("steps"), *keep)
