"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits; two link when at most `budget` bits differ. Equal fingerprints are one
class before anything is compared. With budget + 1 blocks of bits, two linked fingerprints agree
in one block at least, so the trie is rooted once per block: its top levels are that block, and
only fingerprints below the same top node can link there. Below, node pairs are traversed
together: each level adds the differing bit of the two branches to the pair's budget, and pairs
beyond it are dropped with everything below them.

A top node may be hot. Its distinct fingerprints are dealt by a hash into cells of about `CELL`
members, and each pair of cells is one task; pruning happens inside of it, so a node of m
fingerprints is copied m / `CELL` times. A task reports
a spanning forest of the links that it finds, never all pairs, so a group of n near copies gives
less than n edges a task. Components are found by alternating star contractions, with every round
written to the shared checkpoint folder.

Null and wordless texts have fingerprint zero and link like any other. A null doc_id is no
candidate for a component's smallest id; a component of such rows only has a null id. Repeated
rows share a fingerprint and so a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.session import cut_lineage

BITS = 64
SEED = 42
#: Fingerprints of one cell of a hot top node; it bounds a task's memory, not what is found.
CELL = 20000
#: Node pairs that a task expands at once.
PAIRS = 1 << 20


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the whole text: a bit is set if more than half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[size - 1:] - 1).tolist()
    starts = [0, *ends[: len(words) - size].tolist()]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        block = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number."""
    def run(batch: pa.RecordBatch) -> dict:
        prints = [fingerprint(t, shingle) for t in common.utf8(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"),
                "bits": np.array(prints, dtype=np.uint64).view(np.int64)}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, bits long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of budget + 1 blocks that cover all bits."""
    edges = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = p
                return p
            p = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins all pairs (a[i], b[i]); the smaller root stays."""
        while len(a):
            p = self.roots()
            ra, rb = p[a], p[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                p = p.copy()
                np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
                self.parent = p


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within `left`, or between `left` and `right`.

    Both are sorted distinct fingerprints; a trie node is a range of them that shares its top bits.
    Node pairs of one component are not followed further: their links can add nothing.
    """
    values = left if right is None else np.concatenate([left, right])
    n = len(left)
    forest = Forest(len(values))
    first = (0, n, 0, n) if right is None else (0, n, n, len(values))
    # A pair of nodes: two ranges, the bits that differ so far. Depth first, in blocks.
    stack = [(BITS - 1, np.array([[*first, 0]], dtype=np.int64))]
    edges: list[tuple[int, int]] = []
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > PAIRS:
            half = len(pairs) // 2
            stack += [(bit, pairs[half:]), (bit, pairs[:half])]
            continue
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16
        if bit < 0:
            small[:] = True
        _compare(values, pairs[small], budget, forest, edges)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        pairs = pairs[_apart(forest, pairs)]
        if not len(pairs):
            continue
        a, b, c, d, cost = pairs.T
        mask = np.uint64(1) << np.uint64(bit)
        mid_l, mid_r = _split(values, a, b, mask), _split(values, c, d, mask)
        same = (a == c) & (b == d)
        grown = [
            np.stack([a, mid_l, c, mid_r, cost], 1),
            np.stack([mid_l, b, mid_r, d, cost], 1),
            np.stack([a, mid_l, mid_r, d, cost + 1], 1),
            np.stack([mid_l, b, c, mid_r, cost + 1], 1)[~same],
        ]
        grown = np.concatenate(grown)
        grown = grown[(grown[:, 0] < grown[:, 1]) & (grown[:, 2] < grown[:, 3]) & (grown[:, 4] <= budget)]
        if len(grown):
            stack.append((bit - 1, grown))
    return edges


def _split(values: np.ndarray, start: np.ndarray, stop: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Where the bit turns to one inside each range: by bisection of all ranges at once."""
    low, high = start.copy(), stop.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        one = (values[np.minimum(middle, len(values) - 1)] & mask) != 0
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)


def _apart(forest: Forest, pairs: np.ndarray) -> np.ndarray:
    """Pairs of which not all members are in one component already."""
    roots = forest.roots()
    changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
    a, b, c, d, _ = pairs.T
    inside = (changes[b - 1] == changes[a]) & (changes[d - 1] == changes[c])
    return ~(inside & (roots[a] == roots[c]))


def _compare(values: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest, edges: list) -> None:
    """Compares the members of small node pairs directly and keeps links that join components."""
    if not len(pairs):
        return
    a, b, c, d, _ = pairs.T
    count = (b - a) * (d - c)
    pair = np.repeat(np.arange(len(pairs)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    width = (d - c)[pair]
    x, y = a[pair] + at // width, c[pair] + at % width
    near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
    x, y = np.minimum(x, y)[near], np.maximum(x, y)[near]
    roots = forest.roots()
    new = roots[x] != roots[y]
    x, y = x[new], y[new]
    if not len(x):
        return
    # One link for each pair of roots is enough for a forest of these components.
    key = np.minimum(roots[x], roots[y]) * len(values) + np.maximum(roots[x], roots[y])
    _, kept = np.unique(key, return_index=True)
    x, y = x[kept], y[kept]
    for i in _forest_of(roots[x], roots[y]):
        edges.append((int(values[x[i]]), int(values[y[i]])))
    forest.join(x, y)


def _forest_of(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """Positions of edges (a[i], b[i]) that form a spanning forest."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = v = parent.get(parent[v], parent[v])
        return v

    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            yield i


def rotate(values: np.ndarray, low: int, width: int) -> np.ndarray:
    """The block's bits go to the top, so that the trie starts with them."""
    shift = np.uint64((BITS - low - width) % BITS)
    if shift == 0:
        return values
    return (values << shift) | (values >> (np.uint64(BITS) - shift))


def linked_prints(prints: DataFrame, budget: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span their components."""
    bounds = blocks(budget)
    rotated = F.array(*[
        F.struct(F.lit(i).alias("block"),
                 F.shiftrightunsigned("bits", low).bitwiseAND(F.lit((1 << width) - 1)).alias("top"))
        for i, (low, width) in enumerate(bounds)
    ])
    rooted = prints.select("bits", F.explode(rotated).alias("r")).select("bits", "r.block", "r.top")
    # A hot top node is dealt to cells by a hash; each pair of cells is a task of its own.
    sizes = rooted.groupBy("block", "top").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    hot = sizes.where("cells > 1")
    cells = F.coalesce("cells", F.lit(1))
    cell = F.pmod(F.xxhash64("bits"), cells).cast("int")
    dealt = rooted.join(hot, ["block", "top"], "left").select("bits", "block", "top", cells.alias("cells"), cell.alias("cell"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    tasks = dealt.select("bits", "block", "top", "cell", other.alias("other")).select(
        "bits", "block", "top", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"),
        (F.col("cell") > F.col("other")).alias("second"),
    )

    def traverse(table: pa.Table) -> pa.Table:
        low, width = bounds[table.column("block")[0].as_py()]
        bits = table.column("bits").to_numpy().view(np.uint64)
        second = table.column("second").to_numpy()
        left = np.sort(rotate(bits[~second], low, width))
        right = np.sort(rotate(bits[second], low, width)) if second.any() else None
        cross = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        one_sided = cross and (right is None or not len(left))
        links = [] if one_sided else trie_links(left, right, budget)
        both = _back(np.array(links, dtype=np.uint64).reshape(-1, 2), low, width)
        a, b = both[:, 0].copy(), both[:, 1].copy()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return tasks.groupBy("block", "top", "low", "high").applyInArrow(traverse, "a long, b long")


def _back(values: np.ndarray, low: int, width: int) -> np.ndarray:
    """Undoes `rotate`."""
    shift = np.uint64((BITS - low - width) % BITS)
    return values if shift == 0 else (values >> shift) | (values << (np.uint64(BITS) - shift))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b), root the smallest node.

    Alternates the two star contractions until the edges no longer change; each round is one
    shuffle by node, and the number of rounds grows with the logarithm of a component's size.
    """
    current = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(),
        purpose,
    )
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "least")
        small = small.select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("least").alias("b")),
            F.struct(F.col("x").alias("a"), F.col("least").alias("b")),
        )).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        after = cut_lineage(small, purpose)
        before_sum, after_sum = (
            d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (current, after)
        )
        current = after
        if before_sum == after_sum:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, bits, component_id: the smallest doc_id that is reachable over links."""
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    classes = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(linked_prints(classes.select("bits"), budget))
    rooted = classes.join(roots, classes["bits"] == roots["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = cut_lineage(rooted.join(smallest, "root").select("bits", "component_id"), "components")
    return prints.join(found, "bits").select("doc_id", "bits", "component_id")


def as_hex(bits):
    """16 lowercase digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def pairs_by_force(values: np.ndarray, budget: int) -> set[tuple[int, int]]:
    """All linked pairs, for tests on small inputs."""
    values = np.unique(values)
    found = set()
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ v) <= budget):
            found.add((int(v), int(values[i + 1 + j])))
    return found
