"""Resharding written documents so that the fewest bytes move.

A layout is a set of folders, one a shard and file group, of rows dealt to blocks. The sizes of
blocks (a bounded number, whatever the number of rows) are all that reaches the driver. A
minimum-cost flow from old shard sizes to new capacities says how many bytes go from which shard
to which; each flow is met with whole blocks, taken from as few file groups as will do. Groups
with a block that leaves are written anew, the files of all others stay where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.session import scratch_path

GROUPS, BLOCKS = 16, 16  # file groups a shard, blocks a group
STEPS = 4096  # of levelling, at most

Block = tuple[int, int, int]  # shard where it was written, group, block


@dataclass
class Layout:
    """Where the rows are: a path for each (shard, group) part, and bytes and rows of each block.

    ``parts`` maps a path to the shard its rows belong to.
    """

    parts: dict[str, int]
    blocks: dict[Block, tuple[int, int, int]]  # shard where it is now, bytes, rows
    schema: T.StructType

    def sizes(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for shard, size, _ in self.blocks.values():
            out[shard] = out.get(shard, 0) + size
        return out


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row as struct ``row`` with ``rid``, ``size`` and ``crc``: UTF-8 bytes and one more, and
    the CRC-32 of the text. A null text has size 1 and the CRC of no bytes. No name can clash."""
    bare = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.monotonically_increasing_id().alias("rid"),
        (F.octet_length(bare) + 1).cast("long").alias("size"),
        F.crc32(bare.cast("binary")).alias("crc"),
    )


def write_layout(docs: DataFrame, shards: int, text: str = "text") -> Layout:
    """A first layout: rows are dealt to shards and blocks by a digest of their place in the table,
    so neither a hot key nor repeated rows can fill a block."""
    def dealt(seed: int, n: int):
        return F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n)).cast("int")

    rows = sized(docs, text).withColumns({"shard": dealt(1, shards), "grp": dealt(2, GROUPS), "block": dealt(3, BLOCKS)})
    rows = rows.withColumn("origin", F.col("shard"))
    folder = scratch_path(docs.sparkSession, "layout")
    schema = _write(rows, folder)
    table = docs.sparkSession.read.schema(schema).parquet(folder)
    found = table.groupBy("shard", "grp", "block").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    blocks, parts = {}, {}
    for r in found.collect():  # shards x groups x blocks at most
        blocks[r["shard"], r["grp"], r["block"]] = (r["shard"], r["s"], r["n"])
        parts[f"{folder}/shard={r['shard']}/grp={r['grp']}"] = r["shard"]
    return Layout(parts, blocks, schema)


def _write(rows: DataFrame, folder: str) -> T.StructType:
    """Files by shard and group. Spark cuts large groups and joins small ones before it writes."""
    rows.hint("rebalance", "shard", "grp").write.partitionBy("shard", "grp").parquet(folder)
    return T.StructType([*[f for f in rows.schema if f.name not in ("shard", "grp")],
                         T.StructField("shard", T.IntegerType()), T.StructField("grp", T.IntegerType())])


def min_cost_flow(
    sizes: Mapping[int, int], capacities: Mapping[int, int], cost: Mapping[tuple[int, int], int] | None = None
) -> dict[tuple[int, int], int]:
    """Bytes from old to new shards at the least cost; ``cost`` is 0 to stay and 1 to move a byte
    unless given. Capacities must hold all sizes. Successive cheapest paths by Bellman-Ford."""
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("capacities are less than the sizes")
    price = lambda i, j: (cost or {}).get((i, j), int(i != j))
    flow = {(i, j): 0 for i in sizes for j in capacities}
    left, room = dict(sizes), dict(capacities)
    while any(left.values()):
        far = {("o", i): 0 for i, v in left.items() if v}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        changed = True
        while changed:
            changed = False
            for (i, j), f in flow.items():
                steps = [(("o", i), ("n", j), price(i, j))]
                if f:
                    steps.append((("n", j), ("o", i), -price(i, j)))
                for a, b, c in steps:
                    if a in far and far[a] + c < far.get(b, float("inf")):
                        far[b], came[b], changed = far[a] + c, a, True
        end = min((("n", j) for j, r in room.items() if r), key=lambda v: (far[v], v[1]))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        pairs = list(zip(path[1:], path[:-1]))  # from its end to its start
        amount = min(room[end[1]], left[path[-1][1]], *(flow[b[1], a[1]] for a, b in pairs if a[0] == "n"))
        for a, b in pairs:
            if a[0] == "o":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[-1][1]] -= amount
        room[end[1]] -= amount
    return {k: f for k, f in flow.items() if f}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def block_transfers(layout: Layout, capacities: Mapping[int, int], cost: Mapping[tuple[int, int], int] | None = None) -> dict[Block, int]:
    """New shards of the blocks that move.

    A shard's flow is taken from as few groups as hold it, the larger blocks first, so that the small
    ones meet the rest. Blocks of those groups then level what whole blocks left uneven.
    """
    flow = min_cost_flow(layout.sizes(), capacities, cost)
    moves: dict[Block, int] = {}
    open_groups: set[tuple[int, int, int]] = set()
    for shard in sorted(layout.sizes()):
        due = {j: f for (i, j), f in flow.items() if i == shard and j != shard}
        groups: dict[tuple[int, int], list[Block]] = {}
        for b, (now, _, _) in layout.blocks.items():
            if now == shard:
                groups.setdefault(b[:2], []).append(b)
        for key in sorted(groups, reverse=True):
            if not any(f > 0 for f in due.values()):
                break
            open_groups.add((shard, *key))
            for b in sorted(groups[key], key=lambda b: (-layout.blocks[b][1], b)):
                j = max(due, key=lambda j: (due[j], -j))
                if 2 * due[j] >= layout.blocks[b][1]:
                    due[j] -= layout.blocks[b][1]
                    moves[b] = j
    _level(layout, capacities, moves, open_groups)
    return moves


def _level(layout: Layout, capacities: Mapping[int, int], moves: dict[Block, int], groups: set[tuple[int, int, int]]) -> None:
    """Moves single blocks of groups that are rewritten anyway from the fullest shard to the emptiest
    while this brings them closer to their capacities."""
    free = [b for b, (now, _, _) in layout.blocks.items() if (now, *b[:2]) in groups]
    at = {b: moves.get(b, layout.blocks[b][0]) for b in layout.blocks}
    over = {j: -c for j, c in capacities.items()}
    for b, j in at.items():
        over[j] = over.get(j, 0) + layout.blocks[b][1]
    held: dict[int, set[Block]] = {}
    for b in free:
        held.setdefault(at[b], set()).add(b)
    for _ in range(STEPS):
        high = max(over, key=lambda j: (over[j], j))
        low = min((j for j in over if j in capacities), key=lambda j: (over[j], j))
        gap = over[high] - over[low]
        fits = [b for b in held.get(high, ()) if 0 < layout.blocks[b][1] < gap]
        if not fits:
            return
        b = min(fits, key=lambda b: (abs(2 * layout.blocks[b][1] - gap), b))
        size = layout.blocks[b][1]
        over[high], over[low] = over[high] - size, over[low] + size
        held[high].remove(b)
        held.setdefault(low, set()).add(b)
        moves[b] = low
        if low == layout.blocks[b][0]:
            del moves[b]


def reshard(spark: SparkSession, layout: Layout, capacities: Mapping[int, int], cost: Mapping[tuple[int, int], int] | None = None) -> tuple[Layout, dict[Block, int]]:
    """The layout after the transfers, and the transfers. Only parts that lose a block are read and
    written; no file is changed or removed, so readers of the old layout are not disturbed."""
    moves = block_transfers(layout, capacities, cost)
    if not moves:
        return layout, moves
    touched = {(layout.blocks[b][0], b[0], b[1]) for b in moves}

    def is_touched(path: str, shard: int) -> bool:
        origin, grp = _origin(path)
        return (shard, origin, grp) in touched

    stale = {p: s for p, s in layout.parts.items() if is_touched(p, s)}
    target = F.create_map(*[F.lit(v) for (o, g, k), j in sorted(moves.items()) for v in (_code(o, g, k), j)])
    key = (F.col("origin") * GROUPS + F.col("grp")) * BLOCKS + F.col("block")
    rows = read_parts(spark, stale, layout.schema)
    rows = rows.withColumn("shard", F.coalesce(F.try_element_at(target, key), F.col("shard")))
    # a part keeps its origin in its path: blocks of several shards share a group number
    folder = scratch_path(spark, "layout")
    rows = rows.withColumn("from", F.col("origin"))
    rows.hint("rebalance", "shard", "from", "grp").write.partitionBy("shard", "from", "grp").parquet(folder)
    parts = {p: s for p, s in layout.parts.items() if p not in stale}
    blocks = dict(layout.blocks)
    for b, (now, size, n) in layout.blocks.items():
        if (now, b[0], b[1]) in touched:
            j = moves.get(b, now)
            blocks[b] = (j, size, n)
            parts[f"{folder}/shard={j}/from={b[0]}/grp={b[1]}"] = j
    return Layout(parts, blocks, layout.schema), moves


def _code(origin: int, grp: int, block: int) -> int:
    return (origin * GROUPS + grp) * BLOCKS + block


def _origin(path: str) -> tuple[int, int]:
    """Shard of the first layout and group of a part, from its path."""
    named = dict(p.split("=") for p in path.split("/") if "=" in p)
    return int(named.get("from", named["shard"])), int(named["grp"])


def read_parts(spark: SparkSession, parts: Mapping[str, int], schema: T.StructType) -> DataFrame:
    """Rows of the parts with their ``shard`` and ``grp``; every folder is one of the layout's."""
    stored = T.StructType([f for f in schema if f.name not in ("shard", "grp")])
    if not parts:
        return spark.createDataFrame([], schema)
    path = F.col("_metadata.file_path")
    found = spark.read.schema(stored).parquet(*sorted(parts))
    number = lambda name: F.regexp_extract(path, f"/{name}=([0-9]+)/", 1).cast("int")
    return found.select(*stored.names, number("shard").alias("shard"), number("grp").alias("grp"))


def read_layout(spark: SparkSession, layout: Layout) -> DataFrame:
    """All rows of a layout: ``row``, ``size``, ``crc``, ``shard`` and ``slot``, gapless from 0 in a shard.

    Rows are numbered inside their block and start after the blocks before it, so no task
    sorts a shard.
    """
    starts, given = [], {}
    for b, (shard, _, n) in sorted(layout.blocks.items()):
        starts += [F.lit(_code(*b)), F.lit(given.get(shard, 0)).cast("long")]
        given[shard] = given.get(shard, 0) + n
    rows = read_parts(spark, layout.parts, layout.schema)
    key = (F.col("origin") * GROUPS + F.col("grp")) * BLOCKS + F.col("block")
    first = F.element_at(F.create_map(*starts), key) if starts else F.lit(0).cast("long")
    inside = Window.partitionBy("origin", "grp", "block").orderBy("rid")
    return rows.withColumn("slot", first + F.row_number().over(inside) - 1)


def balanced_shards(docs: DataFrame, shards: int = 16, old_shards: int = 12, text: str = "text") -> tuple[Layout, Layout]:
    """Documents written to ``old_shards`` shards and resharded to ``shards`` of near equal bytes.

    Returns the old and the new layout. Null texts count one byte; repeated rows and ids are rows
    like others; an empty table gives layouts without parts. A single text larger than a share
    makes its shard larger than the others.
    """
    old = write_layout(docs, old_shards, text)
    total = sum(old.sizes().values())
    new, _ = reshard(docs.sparkSession, old, equal_capacities(total, shards))
    return old, new
