"""Operator 11: centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are integers (floor of the scaled components). They are put in the order
of a Hilbert curve and cut into blocks; a block row holds its vectors, their box
(least and greatest value of every component) and their sum. In a round, the
box gives for each centroid a least and a greatest squared distance that any
vector of the block can have. Centroids whose least distance is beyond the
smallest greatest distance are out for the whole block. A block with one
candidate left adds its stored sum without a look at its vectors; in others, each
vector is compared with the candidates only, exactly.

Vectors move once, into blocks. What a round sends is a sum for each task and
cluster; the driver holds ``clusters`` x ``dims`` numbers. Sums are exact, so
results depend neither on blocks nor on tasks.

Rows whose vector is null, has another length or a component that is null, not a
number or infinite are left out. Rows may repeat, in whole or by id; each counts.
Of rows with one id, the one with the smaller components is the earlier seed. A row
without an id is clustered like others and seeds a cluster only where too few
rows have one. Fewer rows than clusters give fewer clusters, no rows none. A component
beyond 2**27 in size after scaling stops the job: distances would leave 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators.skew import materialize

#: Vectors of a block, and bits of a component in the curve.
BLOCK, BITS = 128, 4
#: Largest integer component; with it, a squared distance in up to 64 dimensions stays below 2**62.
LARGEST = 1 << 27
#: Up to this size, products of 64 components add up exactly in a double.
EXACT = 1 << 22


@dataclass
class Clusters:
    """``members`` (id, cluster, distance), the final centroids, and each cluster's summed distance."""

    members: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def integers(df: DataFrame, vector: str, ident: str, dims: int, scale: int) -> DataFrame:
    """(id, v): usable vectors as floor(scale * component)."""
    plain = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.filter((F.size("v") == dims) & usable)

    def scaled(x):
        y = F.floor(x * F.lit(float(scale)))
        too_large = F.raise_error(F.lit(f"a component beyond {LARGEST} after scaling"))
        return F.when(F.abs(x) <= LARGEST / scale, y).otherwise(too_large.cast("bigint"))

    return plain.select("id", F.transform("v", scaled).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def spread(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each component; they only shape the curve, so large values are cut here."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.clip(_matrix(batch.column(0), dims), -(1 << 20), 1 << 20)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dims)), pa.array([len(x)] * dims), pa.array(x.sum(0)), pa.array((x * x).sum(0))],
                    ["dim", "n", "s", "q"],
                )

    parts = vectors.select("v").mapInArrow(run, "dim bigint, n bigint, s bigint, q bigint")
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in "nsq"]
    rows = {r["dim"]: r for r in parts.groupBy("dim").agg(*sums).collect()}
    if not rows:
        return np.zeros(dims), np.ones(dims)
    n, s, q = (np.array([rows[i][c] for i in range(dims)]) for c in "nsq")
    return s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below 2**bits, as big-endian byte rows.

    Bit planes from the top: within the planes above, a component is reflected
    or exchanged with the first one, then planes are Gray coded across components.
    """
    x = cells.T.astype(np.int64)
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, below = 1 << plane, (1 << plane) - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> plane) & 1, (1 << plane) - 1, 0)
    x ^= turn
    planes = [((x >> plane) & 1).astype(np.uint8).T for plane in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, 1), axis=1)


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """One row for every BLOCK vectors along the curve: ids, vectors, box and sum; written."""
    mean, deviation = spread(vectors, dims)
    # Components that vary most come first, so that the first cuts part the most.
    order = np.argsort(-deviation, kind="stable")
    cut = np.where(deviation > 0, deviation, 1) / 2

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dims)
                cells = np.clip(np.floor((x - mean) / cut) + (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
                keys = hilbert_keys(cells[:, order], BITS)
                columns = [pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (keys, x.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], ["id", "key", "v", "tie"])

    def packed(held: list[tuple]):
        x = np.frombuffer(b"".join(v for _, v in held), "<i4").reshape(-1, dims).astype(np.int64)
        whole = [a.astype("<i4").tobytes() for a in (x, x.min(0), x.max(0))]
        return [[i for i, _ in held], *whole, x.sum(0).astype("<i8").tobytes()]

    def cut_up(batches):
        schema = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("v", "low", "high", "sum"))])
        held = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            full = len(held) // BLOCK * BLOCK
            made = [packed(held[i : i + BLOCK]) for i in range(0, full, BLOCK)]
            held = held[full:]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(packed(held), schema, strict=True)], schema=schema)

    # The row's place in its input parts equal vectors, so that very many copies fill several tasks.
    numbered = vectors.select(F.col("id").cast("bigint"), "v", F.monotonically_increasing_id().alias("tie"))
    keys = numbered.mapInArrow(keyed, "id bigint, key binary, v binary, tie bigint")
    dealt = keys.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    return materialize(dealt.select("id", "v").mapInArrow(cut_up, "ids array<bigint>, v binary, low binary, high binary, sum binary"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that a vector inside the box may have as its nearest, in order."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    farthest = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return np.flatnonzero((outside * outside).sum(1) <= (farthest * farthest).sum(1).min())


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each row (the first of equals) and its squared distance, exact."""
    if max(np.abs(x).max(), np.abs(centroids).max()) <= EXACT:
        a, b = x.astype(float), centroids.astype(float)
        distances = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        distances = distances.astype(np.int64)
    else:
        distances = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = distances.argmin(1)
    return best, distances[np.arange(len(x)), best]


def _sums(table: DataFrame, centroids: list[list[int]], dims: int) -> dict[tuple[int, int], int]:
    """(cluster, component) to sum, with the count at component -1."""
    at = np.array(centroids, np.int64)

    def run(batches):
        sums, counts = np.zeros((len(at), dims), np.int64), np.zeros(len(at), np.int64)
        for batch in batches:
            for v, low, high, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                few = candidates(np.frombuffer(low, "<i4").astype(np.int64), np.frombuffer(high, "<i4").astype(np.int64), at)
                n = len(v) // (4 * dims)
                if len(few) == 1:
                    sums[few[0]] += np.frombuffer(total, "<i8")
                    counts[few[0]] += n
                    continue
                x = np.frombuffer(v, "<i4").reshape(n, dims).astype(np.int64)
                best, _ = nearest(x, at[few])
                for place in np.unique(best).tolist():
                    mine = x[best == place]
                    sums[few[place]] += mine.sum(0)
                    counts[few[place]] += len(mine)
        used = np.flatnonzero(counts)
        each = np.concatenate([counts[used, None], sums[used]], 1)
        columns = [np.repeat(used, dims + 1), np.tile(np.arange(-1, dims), len(used)), each.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "dim", "s"])

    parts = table.select("v", "low", "high", "sum").mapInArrow(run, "cluster bigint, dim bigint, s bigint")
    found = parts.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return {(r["cluster"], r["dim"]): int(r["s"]) for r in found}


def _assigned(table: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    at = np.array(centroids, np.int64)

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            ids, found = batch.column(0).flatten(), []
            for v, low, high in rows:
                few = candidates(np.frombuffer(low, "<i4").astype(np.int64), np.frombuffer(high, "<i4").astype(np.int64), at)
                best, distance = nearest(np.frombuffer(v, "<i4").reshape(-1, dims).astype(np.int64), at[few])
                found.append((few[best], distance))
            if found:
                cluster, distance = (np.concatenate(c) for c in zip(*found, strict=True))
                columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return table.select("ids", "v", "low", "high").mapInArrow(run, "id bigint, cluster int, distance bigint")


def fit(
    df: DataFrame,
    vector: str = "embedding",
    ident: str = "vec_id",
    clusters: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    salt: str = "1",
) -> Clusters:
    """Cluster the usable vectors of ``df``; seeds have the smallest sha256 of ``salt:id``.

    Each round takes every vector to its nearest centroid (the first of equals)
    and moves every centroid to the floor of its vectors' mean; one without
    vectors stays. A last assignment follows.
    """
    vectors = integers(df, vector, ident, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds = vectors.select("v", order.alias("place")).orderBy(F.col("place").asc_nulls_last(), "v").limit(clusters)
    centroids = [[int(x) for x in r["v"]] for r in seeds.collect()]
    if not centroids:
        empty = vectors.sparkSession.createDataFrame([], "id bigint, cluster int, distance bigint")
        return Clusters(empty, [], [])
    table = blocks(vectors, dims)
    for _ in range(rounds):
        sums = _sums(table, centroids, dims)
        centroids = [
            [sums[c, i] // sums[c, -1] for i in range(dims)] if (c, -1) in sums else old for c, old in enumerate(centroids)
        ]
    members = materialize(_assigned(table, centroids, dims))
    total = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in total}
    return Clusters(members, centroids, [inertia.get(c, 0) for c in range(len(centroids))])


def candidate_share(table: DataFrame, centroids: list[list[int]]) -> float:
    """Share of (block, centroid) pairs that the boxes leave to compare."""
    at = np.array(centroids, np.int64)

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            n = [len(candidates(*(np.frombuffer(x, "<i4").astype(np.int64) for x in r), at)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    share = table.select("low", "high").mapInArrow(run, "n bigint").agg(F.avg("n")).first()[0]
    return (share or 0.0) / len(centroids)
