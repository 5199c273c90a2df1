"""Approximate nearest neighbours by cosine: one robust-pruned directed graph per shard.

Vectors are dealt to shards of about `shard_size`. In a shard, points enter the graph in batches:
a greedy search from the entry point proposes neighbours, relaxed distance pruning keeps an edge
only if no kept neighbour is nearer to the target by the factor `alpha`, and reverse edges are
pruned alike. Queries go in blocks to every shard, where a beam search finds candidates; their
cosines are then computed exactly in double precision on the original vectors.

Equal vectors are one point: it keeps its `k` + 1 smallest ids, which is all that a result of k
can show of them. Vectors that are null, empty or zero, hold null or non-finite components, or
have a null id take no part. Vectors of different lengths have no cosine: each length is a search
of its own. Repeated rows of an id are one candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.session import cut_lineage

QUERY_BLOCK = 1024
_PRUNE_CELLS = 1 << 24  # distances that a pruning holds at once
_STEP = 4  # points of a beam that are expanded together


def beam_search(
    points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int, slack: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the `width` nearest points found, nearest first.

    All queries walk at once: each step expands the nearest unexpanded points of every beam.
    Missing places have position -1 and infinite distance.
    """
    n = len(queries)
    ids = np.full((n, width), -1, dtype=np.int64)
    far = np.full((n, width), np.inf, dtype=np.float32)
    done = np.zeros((n, width), dtype=bool)
    ids[:, 0] = entry
    far[:, 0] = 2 - 2 * (queries @ points[entry])
    alive = np.arange(n)
    while len(alive):
        own_ids, own_far, own_done = ids[alive], far[alive], done[alive]
        open_far = np.where(own_done, np.inf, own_far)
        step = min(_STEP, width)
        pick = np.argpartition(open_far, step - 1, axis=1)[:, :step]
        there = np.isfinite(np.take_along_axis(open_far, pick, 1))
        np.put_along_axis(own_done, pick, np.take_along_axis(own_done, pick, 1) | there, 1)
        moving = there.any(axis=1)
        done[alive] = own_done
        alive = alive[moving]
        if not len(alive):
            break
        own_ids, own_far, own_done = own_ids[moving], own_far[moving], own_done[moving]
        chosen = np.where(there[moving], np.take_along_axis(own_ids, pick[moving], 1), -1)
        found = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(alive), -1)
        found.sort(axis=1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen = np.sort(own_ids, axis=1)
        fresh &= ~_contains(seen, found, len(points))
        distance = np.full(found.shape, np.inf, dtype=np.float32)
        rows, columns = np.nonzero(fresh)
        distance[rows, columns] = 2 - 2 * np.einsum(
            "ij,ij->i", points[found[rows, columns]], queries[alive[rows]])
        every_far = np.concatenate([own_far, distance], 1)
        every_ids = np.concatenate([own_ids, np.where(fresh, found, -1)], 1)
        every_done = np.concatenate([own_done, ~fresh], 1)
        best = np.argpartition(every_far, width - 1, axis=1)[:, :width]
        ids[alive] = np.take_along_axis(every_ids, best, 1)
        far[alive] = np.take_along_axis(every_far, best, 1)
        done[alive] = np.take_along_axis(every_done, best, 1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def _contains(seen: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Whether found[i, j] is in the sorted row seen[i]; by one search over all rows."""
    shift = np.arange(len(seen), dtype=np.int64)[:, None] * (n + 2)
    flat = (seen + 1 + shift).ravel()
    wanted = (found + 1 + shift).ravel()
    at = np.minimum(np.searchsorted(flat, wanted), len(flat) - 1)
    return (flat[at] == wanted).reshape(found.shape)


def robust_prune(
    points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """For each owner the kept candidates (-1 where fewer than `degree`), nearest first.

    A candidate falls if a kept one is nearer to it, by the factor alpha, than the owner is.
    """
    n = len(owners)
    valid = (candidates >= 0) & (candidates != owners[:, None])
    distance = 2 - 2 * np.einsum("ijk,ik->ij", points[candidates], points[owners])
    distance = np.where(valid, distance, np.inf)
    order = np.argsort(distance, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    distance = np.take_along_axis(distance, order, 1)
    valid = np.isfinite(distance)
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    own = points[candidates]
    between = 2 - 2 * np.einsum("ijk,ilk->ijl", own, own)
    kept = np.full((n, degree), -1, dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    relaxed = alpha * alpha
    for j in range(candidates.shape[1]):
        take = np.flatnonzero(valid[:, j] & (count < degree))
        if not len(take):
            continue
        kept[take, count[take]] = candidates[take, j]
        count[take] += 1
        valid[take] &= relaxed * between[take, j] > distance[take]
    return kept


def build_graph(
    points: np.ndarray, degree: int = 48, width: int = 128, alpha: float = 1.1, seed: int = 7
) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1 where fewer) and the entry point, the one nearest to the mean."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int64)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done, batch = 1, 1
    while done < n:
        new = order[done:done + batch]
        found, _ = beam_search(points, edges, entry, points[new], width)
        edges[new] = robust_prune(points, new, found, degree, alpha)
        _add_reverse(points, edges, new, degree, alpha)
        done += len(new)
        batch = min(512, 2 * batch, max(1, done))
    return edges, entry


def _add_reverse(points: np.ndarray, edges: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    target = edges[new].ravel()
    source = np.repeat(new, degree)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    owners, start, count = np.unique(target, return_index=True, return_counts=True)
    most = int(count.max(initial=0))
    if not most:
        return
    # Owners by number of new edges, so that one with many does not widen the rows of all.
    for low, high in ((0, degree), (degree, 4 * degree), (4 * degree, most)):
        rows = np.flatnonzero((count > low) & (count <= high))
        widest = degree + int(count[rows].max(initial=0))
        together = max(1, min(256, _PRUNE_CELLS // widest ** 2))
        for at in range(0, len(rows), together):
            part = rows[at:at + together]
            wide = int(count[part].max())
            place = np.arange(wide)
            added = np.where(place < count[part, None],
                             source[np.minimum(start[part, None] + place, len(source) - 1)], -1)
            every = np.concatenate([edges[owners[part]], added], 1)
            used = (every >= 0).sum(axis=1)
            full = used > degree
            loose = part[~full]
            if len(loose):
                order = np.argsort(every[~full] < 0, axis=1, kind="stable")[:, :degree]
                edges[owners[loose]] = np.take_along_axis(every[~full], order, 1)
            tight = part[full]
            if len(tight):
                edges[owners[tight]] = robust_prune(points, owners[tight], every[full], degree, alpha)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # so that squares stay finite
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec (array of doubles) of the rows that take part."""
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
        .where(sound & F.exists("vec", lambda x: x != 0))
    )


def _rows(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    shard_size: int = 8192,
    degree: int = 48,
    width: int = 160,
    alpha: float = 1.1,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `vectors` found for each row of `queries`."""
    points = usable(vectors, key, vector)
    # One point per distinct vector with its k + 1 smallest ids.
    places = Window.partitionBy("vec").orderBy("id")
    classes = (
        points.distinct().withColumn("place", F.row_number().over(places)).where(F.col("place") <= k + 1)
        .groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    classes = cut_lineage(classes.select("ids", "vec", F.size("vec").alias("dims")), "points")
    shards = classes.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / shard_size).cast("int").alias("shards"))
    shards = cut_lineage(shards, "shards")
    dealt = classes.join(shards, "dims").select(
        "dims", F.pmod(F.xxhash64("ids"), F.col("shards")).cast("int").alias("shard"), "ids", "vec")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        own = unit(_rows(table.column("vec")))
        edges, entry = build_graph(own, degree, max(128, 2 * degree), alpha)
        return pa.table({
            "dims": table.column("dims").slice(0, 1), "shard": table.column("shard").slice(0, 1),
            "entry": pa.array([entry], pa.int32()),
            "edges": pa.array([edges.astype("<i4").tobytes()], pa.binary()),
            "vectors": pa.array([_rows(table.column("vec")).astype("<f8").tobytes()], pa.binary()),
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    graphs = cut_lineage(
        dealt.withColumn("first", F.element_at("ids", 1)).groupBy("dims", "shard").applyInArrow(
            build, "dims int, shard int, entry int, edges binary, vectors binary, ids array<array<long>>"),
        "graphs",
    )

    # Query blocks of bounded size, each sent to every shard of its length.
    asked = usable(queries, key, vector).withColumn("dims", F.size("vec")).dropDuplicates(["id", "vec"])
    amounts = asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    blocks = (
        asked.join(amounts, "dims").join(shards, "dims")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .groupBy("dims", "block", "shards").agg(
            F.collect_list(F.struct("id", "vec")).alias("asked"))
        .select("dims", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "asked")
    )
    tasks = blocks.join(graphs, ["dims", "shard"])

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield _search_shard(batch.slice(row, 1).to_pylist()[0], k, degree, width)

    found = tasks.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (
        once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search_shard(task: dict, k: int, degree: int, width: int) -> pa.RecordBatch:
    dims, ids = task["dims"], task["ids"]
    vectors = np.frombuffer(task["vectors"], "<f8").reshape(-1, dims)
    edges = np.frombuffer(task["edges"], "<i4").reshape(-1, degree).astype(np.int64)
    asked = np.array([q["vec"] for q in task["asked"]], dtype=np.float64).reshape(-1, dims)
    names = [q["id"] for q in task["asked"]]
    found, _ = beam_search(unit(vectors), edges, task["entry"], unit(asked), max(width, 2 * k))
    # The query's own point may be among them, so one more than k distinct points is kept.
    rows, columns = np.nonzero(found >= 0)
    exact = np.full(found.shape, -np.inf)
    exact[rows, columns] = cosines(asked[rows], vectors[found[rows, columns]])
    order = np.argsort(-exact, axis=1, kind="stable")
    out: list[tuple[int, int, float]] = []
    for i, name in enumerate(names):
        best: list[tuple[float, int]] = []
        points = 0
        for j in order[i]:
            score = exact[i, j]
            if not np.isfinite(score) or (points > k and score < best[-1][0]):
                break
            points += 1
            best += [(float(score), other) for other in ids[found[i, j]] if other != name]
        best.sort(key=lambda x: (-x[0], x[1]))
        out += [(name, other, score) for score, other in best[:k]]
    return pa.RecordBatch.from_pydict({
        "query_id": pa.array([x[0] for x in out], pa.int64()),
        "vec_id": pa.array([x[1] for x in out], pa.int64()),
        "score": pa.array([x[2] for x in out], pa.float64()),
    })
