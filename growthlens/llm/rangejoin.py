"""Near duplicates among embeddings by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Pivots, vectors of the table that are
farther than r apart, cut the space into cells of nearest pivots. A vector is sent beyond its own cell only where the
triangle inequality leaves room for a neighbour: into cell q if its distance to the border between the two pivots is at
most r, and if its distance to q is at most r plus the radius of q. So every cell holds all neighbours of its own
vectors, cells are joined independently, and each link is counted once from either end.

Within a cell, vectors closer than r / 2 to the pivot (its core) are all linked with each other, again by the triangle
inequality: they are counted, not compared, so that a huge group of near copies costs no more than its size. Core and
ring meet only those within 1.5 r of the pivot, or any. All other comparisons are dealt out in blocks of fixed size,
and a block answers with counts and a spanning forest, never with its pairs. Within a block, the components that vary
most and the length of the rest bound a cosine from above; where this rules out most pairs, only the others are compared.

How much the cells prune depends on the data: in directions without any structure a distance of r says little about the
distance to a pivot, so most cells overlap and the comparisons come close to all pairs, still in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm.shared import components, kept

#: Vectors wanted in a cell, cells at most, vectors of a cell in a block and others that a block streams past them.
CELL, MOST_PIVOTS, SHARD, STREAM = 4096, 1024, 4096, 65_536
#: Rounding room of distances between unit vectors, and of cosines in single precision.
ROOM, SHORT_ROOM = 1e-9, 1e-5
#: Own vectors whose bounds are worked out together; one pair in so many may pass them, else all cosines are taken.
TILE, FEW = 512, 32
#: Parts of a cell by place: core, ring within reach of the core, rest of the ring, guests within reach, other guests;
#: what each of the first three is compared with.
MEETS = ((1, 3), (0, 1, 2, 3, 4), (1, 2, 3, 4))
PARTS = 5

_BLOCK = "cell int, part int, shard int, stream int"


def usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, the largest component first, so that neither huge nor tiny ones overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivots(sample: np.ndarray, wanted: int, r: float) -> np.ndarray:
    """The first of the sampled unit vectors that are farther than r from one another."""
    chosen = np.zeros((0, sample.shape[1]))
    for u in sample:
        if len(chosen) == wanted:
            break
        if not len(chosen) or (chosen @ u).max() < 1 - r * r / 2:
            chosen = np.vstack((chosen, u))
    return chosen


@dataclass
class Cells:
    """Pivots (unit vectors), the range r, and what the first pass has counted in each cell."""

    pivots: np.ndarray
    r: float
    radius: np.ndarray
    shards: np.ndarray | None = None  # cell x part: blocks of the cell's own vectors
    streams: np.ndarray | None = None  # cell x part: portions of the others that each of these blocks meets

    def distances(self, u: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (u @ self.pivots.T), 0))

    def place(self, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cell of each vector and its part there; rows, cells and parts of those sent elsewhere. d: vector x pivot."""
        home = d.argmin(axis=1)
        own = d[np.arange(len(d)), home]
        part = np.where(own <= self.r / 2 - ROOM, 0, np.where(own <= 1.5 * self.r + ROOM, 1, 2))
        between = np.sqrt(np.maximum(2 - 2 * (self.pivots @ self.pivots.T), 0))[home]
        # the distance to the border between two pivots is (d_q^2 - d_p^2) / (2 |p - q|)
        near = (d**2 - own[:, None] ** 2) <= 2 * between * self.r + ROOM
        near &= d <= self.radius + self.r + ROOM
        near[np.arange(len(d)), home] = False
        row, cell = np.nonzero(near)
        return home, part, row, cell, np.where(d[row, cell] <= 1.5 * self.r + ROOM, 3, 4)


def _placed(nodes: DataFrame, cells: Cells, width: int) -> DataFrame:
    """(cell, part, n, weight, least, radius): what each cell holds, summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(cells.pivots), PARTS), np.int64)
        weight, least = n.copy(), np.full_like(n, np.iinfo(np.int64).max)
        radius = np.zeros(n.shape)
        for batch in batches:
            d = cells.distances(units(_vectors(batch.column("vector"), width)))
            home, part, row, cell, far = cells.place(d)
            np.add.at(n, (home, part), 1)
            np.add.at(n, (cell, far), 1)
            np.add.at(weight, (home, part), batch.column("weight").to_numpy())
            np.minimum.at(least, (home, part), batch.column("node").to_numpy())
            np.maximum.at(radius, (home, part), d.min(axis=1))
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (at[0].astype(np.int32), at[1].astype(np.int32), n[at], weight[at], least[at], radius[at])],
            ["cell", "part", "n", "weight", "least", "radius"],
        )

    counted = nodes.select("node", "weight", "vector").mapInArrow(run, "cell int, part int, n long, weight long, least long, radius double")
    return counted.groupBy("cell", "part").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("least").alias("least"), F.max("radius").alias("radius"))


def _dealt(nodes: DataFrame, cells: Cells, width: int, least: np.ndarray) -> DataFrame:
    """The blocks' rows: own vectors (side 0) once per portion they meet, others (side 1) once per block they meet."""
    out = f"{_BLOCK}, side int, node long, leader long, weight long, vector array<double>"

    def times(row, cell, part, count, **named):
        """Each (row, cell) repeated count times, with the number of the copy."""
        again = np.repeat(np.arange(len(row)), count)
        copy = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
        return row[again], cell[again], np.full(len(again), part), copy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                node = batch.column("node").to_numpy()
                home, own, row, cell, far = cells.place(cells.distances(units(_vectors(batch.column("vector"), width))))
                leader = np.where(own == 0, least[home], node)
                at = np.concatenate((np.arange(len(node)), row)), np.concatenate((home, cell)), np.concatenate((own, far))
                mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                for part, met in enumerate(MEETS):
                    mine = np.flatnonzero(own == part)
                    count = cells.streams[home[mine], part]
                    r, c, p, stream = times(mine, home[mine], part, count)
                    yield rows(batch, leader, r, c, p, mixed[r] % np.maximum(cells.shards[c, part], 1).astype(np.uint64), stream, 0)
                    others = np.flatnonzero(np.isin(at[2], met) & (cells.streams[at[1], part] > 0))
                    r, c, p, shard = times(at[0][others], at[1][others], part, cells.shards[at[1][others], part])
                    stream = (mixed[r] >> np.uint64(22)) % np.maximum(cells.streams[c, part], 1).astype(np.uint64)
                    yield rows(batch, leader, r, c, p, shard, stream, 1)

    def rows(batch, leader, r, c, p, shard, stream, side):
        taken = batch.take(pa.array(r))
        numbers = [pa.array(np.asarray(x).astype(np.int32)) for x in (c, p, shard, stream)]
        return pa.RecordBatch.from_arrays(
            [*numbers, pa.array(np.full(len(r), side, np.int32)), taken.column("node"), pa.array(leader[r]), taken.column("weight"), taken.column("vector")],
            ["cell", "part", "shard", "stream", "side", "node", "leader", "weight", "vector"],
        )

    element = nodes.schema["vector"].dataType.simpleString()
    return nodes.select("node", "weight", "vector").mapInArrow(run, out.replace("array<double>", element))


class Block:
    """Vectors of one cell that others stream past: link counts, and links between leaders that join them into groups."""

    def __init__(self, node: np.ndarray, leader: np.ndarray, vectors: np.ndarray, cosine: float):
        self.node, self.leader, self.raw, self.unit, self.cosine = node, leader, vectors, units(vectors), cosine
        self.links = np.zeros(len(node), np.int64)
        self.group = np.arange(len(node))
        self.axes = np.argsort(-self.unit.var(axis=0), kind="stable")
        self.short = self._shortened(self.unit)

    def _shortened(self, u: np.ndarray) -> np.ndarray:
        """The components along which this block varies most, and the length of the rest: the products of two such rows
        are never below those of the whole ones."""
        some = max(1, u.shape[1] // 3)
        rest = u[:, self.axes[some:]]
        return np.column_stack((u[:, self.axes[:some]], np.sqrt((rest * rest).sum(axis=1)))).astype(np.float32)

    def _possible(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (own, other) that may be linked, by their shortened rows; None if these rule out too few."""
        short, found = self._shortened(u).T, []
        for i in range(0, len(self.short), TILE):
            tile = self.short[i : i + TILE] @ short
            at = np.flatnonzero(tile >= np.float32(self.cosine - SHORT_ROOM))
            if len(at) * FEW > tile.size:
                return None
            own, other = np.divmod(at, len(u))
            found.append((own + i, other))
        return tuple(map(np.concatenate, zip(*found)))

    def _cosines(self, u: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        step = 1 << 15
        each = [np.einsum("ij,ij->i", self.unit[own[i : i + step]], u[other[i : i + step]]) for i in range(0, len(own), step)]
        return np.concatenate(each) if each else np.zeros(0)

    def _linked(self, node: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs (own, other), by other and own."""
        u = units(vectors)
        possible = self._possible(u)
        if possible is None:
            cosines = self.unit @ u.T
            close = np.nonzero(np.abs(cosines - self.cosine) < 1e-12)
        else:
            own, other = possible
            cosines = self._cosines(u, own, other)
            close = np.flatnonzero(np.abs(cosines - self.cosine) < 1e-12)
        for at in zip(*close) if possible is None else close:
            i, j = at if possible is None else (own[at], other[at])
            a, b = self.raw[i] / np.abs(self.raw[i]).max(), vectors[j] / np.abs(vectors[j]).max()
            cosines[at] = (a @ b) / np.sqrt((a @ a) * (b @ b))
        if possible is None:
            return np.nonzero(((cosines >= self.cosine) & (self.node[:, None] != node[None])).T)[::-1]
        good = (cosines >= self.cosine) & (self.node[own] != node[other])
        own, other = own[good], other[good]
        order = np.lexsort((own, other))
        return own[order], other[order]

    def meet(self, node: np.ndarray, leader: np.ndarray, vectors: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count others of these vectors; returns links of leaders (own, other), one for each other vector that has any."""
        own, other = self._linked(node, vectors)
        np.add.at(self.links, own, weight[other])
        if not len(own):
            return own, other
        change = np.flatnonzero(np.diff(other, prepend=-1))
        first = own[change]  # the first own vector linked with each other one; all its own vectors are one group
        self._join(own, np.repeat(first, np.diff(np.append(change, len(own)))))
        return self.leader[first], leader[other[change]]

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.group[a], self.group[b]
            apart = x != y
            if not apart.any():
                return
            a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(self.group, high, low)
            while True:  # to the root of every group
                root = self.group[self.group]
                if (root == self.group).all():
                    break
                self.group = root

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        inner = np.flatnonzero(self.group != np.arange(len(self.node)))
        return self.leader[inner], self.leader[self.group[inner]]


def _joined(dealt: DataFrame, cosine: float, width: int) -> DataFrame:
    """(node, other, links): link counts of nodes where other is null, links between two leaders where it is not."""
    block = ["cell", "part", "shard", "stream"]
    ordered = dealt.repartition(*block).sortWithinPartitions(*block, "side")
    names = ["node", "other", "links"]

    def answer(node, other=None, links=None):
        empty = lambda: pa.nulls(len(node), pa.int64())
        columns = [pa.array(node, pa.int64()), *(empty() if x is None else pa.array(x, pa.int64()) for x in (other, links))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, now = None, [], None

        def finish():
            if now is not None:
                some = now.links > 0
                yield answer(now.node[some], links=now.links[some])
                yield answer(*now.forest())

        for batch in batches:
            numbers = np.stack([batch.column(n).to_numpy() for n in block])
            edges = np.flatnonzero((np.diff(numbers, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                part, this = batch.slice(a, b - a), tuple(numbers[:, a]) if b > a else key
                if this != key:
                    yield from finish()
                    key, held, now = this, [], None
                side = part.column("side").to_numpy()
                cut = int(np.searchsorted(side, 1))
                if cut:
                    held.append(part.slice(0, cut))
                for i in range(cut, part.num_rows, 2048):
                    other = part.slice(i, 2048)
                    if now is None:
                        own = [(h.column("node").to_numpy(), h.column("leader").to_numpy(), _vectors(h.column("vector"), width)) for h in held]
                        if not own:
                            break  # nothing of this cell's part fell into this block
                        now, held = Block(*map(np.concatenate, zip(*own)), cosine), []
                    node, leader, weight = (other.column(n).to_numpy() for n in ("node", "leader", "weight"))
                    a, b = now.meet(node, leader, _vectors(other.column("vector"), width), weight)
                    pairs = np.unique(np.stack((a, b), axis=1)[a != b], axis=0)
                    yield answer(pairs[:, 0], pairs[:, 1])
        yield from finish()

    return ordered.mapInArrow(run, "node long, other long, links long")


def _range_join(nodes: DataFrame, width: int, n: int, cosine: float, sample_rows: int) -> DataFrame:
    """(node, other, links) over all vectors of one length: as in `_joined`, and once per node its leader and first links.

    The leader stands for its core: the smallest node there, or the node itself outside of cores. n: number of vectors.
    """
    r = float(np.sqrt(2 - 2 * cosine)) + ROOM
    chance = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) / (1 << 30)
    drawn = nodes.where(chance < min(1.0, sample_rows / max(n, 1))).select("node", "vector").toArrow().sort_by("node")
    if not drawn.num_rows:
        drawn = nodes.select("node", "vector").limit(1).toArrow()
    sample = units(_vectors(drawn.column("vector").combine_chunks(), width))
    chosen = pivots(sample, min(MOST_PIVOTS, max(1, -(-n // CELL))), r)
    cells = Cells(chosen, r, np.full(len(chosen), 2.0))
    held, reach = np.zeros((len(chosen), PARTS), np.int64), np.zeros(len(chosen))
    weight, least = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
    for row in _placed(nodes, cells, width).collect():  # a row per cell and part
        held[row["cell"], row["part"]] = row["n"]
        reach[row["cell"]] = max(reach[row["cell"]], row["radius"])
        if row["part"] == 0:
            weight[row["cell"]], least[row["cell"]] = row["weight"], row["least"]
    cells.radius = reach
    cells.shards = -(-held[:, :3] // SHARD)
    met = np.stack([held[:, list(MEETS[p])].sum(axis=1) for p in range(3)], axis=1)
    cells.streams = np.where(cells.shards > 0, -(-met // STREAM), 0)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What needs no comparison: the other rows of the same vector, and those of its core."""
        for batch in batches:
            node, own = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            home, part, *_ = cells.place(cells.distances(units(_vectors(batch.column("vector"), width))))
            links = np.where(part == 0, weight[home], own) - 1
            leader = np.where(part == 0, least[home], node)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(leader), pa.array(links)], ["node", "other", "links"])

    known = nodes.select("node", "weight", "vector").mapInArrow(alone, "node long, other long, links long")
    return known.union(_joined(_dealt(nodes, cells, width, least), cosine, width))


def linked(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, sample_rows: int = 16 * MOST_PIVOTS) -> DataFrame:
    """All rows and columns of `vectors` with n_links long, component_id long and kept boolean.

    n_links counts the other rows whose vector has at least this cosine, computed in double precision; component_id is
    the smallest id reachable by links, itself included; kept marks the rows that carry it. Pivots come from about
    `sample_rows` vectors drawn by a hash; they decide how the work is cut, not what is found.

    Null vectors, empty ones, zero ones, and those with a null or non-finite component link with nothing. Vectors of
    different lengths don't link. Equal vectors are compared once and count as often as they occur, repeated ids
    included. A row without an id counts as a link; a component of such rows only has a null component_id and keeps them
    all. Columns called n_links, component_id or kept are replaced; other columns may have any name.
    """
    taken = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    key = F.when(usable(vector), F.md5(F.array_join(F.col(vector).cast("array<string>"), ",").cast("binary")))
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("row"), F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), key.alias("key"))
    distinct = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("id").alias("id"), F.first("vector").alias("vector"))
    nodes = kept(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("vector")))
    widths = nodes.groupBy("width").count().orderBy("width").collect()  # one row per vector length
    found = None
    for width, n in widths:
        one = _range_join(nodes.where(F.col("width") == width), width, n, cosine, sample_rows)
        found = one if found is None else found.union(one)
    if found is None:
        result = rows.select("row", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id"))
    else:
        found = kept(found)
        links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("n_links"), F.max("other").alias("leader"))
        pairs = found.where("links is null").select(F.col("node").alias("a"), F.col("other").alias("b"))
        groups = components(pairs).select(F.col("node").alias("leader"), "component")
        of_node = nodes.select("node", "key", "id").join(links, "node").join(groups, "leader", "left")
        of_node = of_node.withColumn("component", F.coalesce("component", "leader"))
        least = of_node.groupBy("component").agg(F.min("id").alias("component_id"))
        of_key = of_node.join(least, "component").select("key", "n_links", "component_id")
        result = rows.drop("vector").join(of_key, "key", "left").select(
            "row", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "id",
        )
    keep = F.col("id").eqNullSafe(F.col("component_id"))
    return result.select("row.*", "n_links", "component_id", keep.alias("kept"))
