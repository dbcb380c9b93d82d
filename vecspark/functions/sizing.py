"""Sizes and costs that plan an index: plain arithmetic on the driver."""

from __future__ import annotations

#: How much room an index needs beyond its estimate.
SLACK = 1.15
GIB = 1 << 30


def index_bytes(n: int, dim: int, degree: int, width: int = 4) -> int:
    """Memory to build a graph over n vectors of dim elements of width bytes."""
    vectors = n * dim * width
    return vectors + max(4 * n * degree * 4, vectors) + 40 * n


def plan_partitions(n: int, dim: int, degree: int, replicas: int, gib: float, width: int = 4) -> tuple[int, int]:
    """(partitions, most vectors in one) for a memory budget, each vector in `replicas` partitions."""
    budget, needed = gib * GIB, SLACK * index_bytes(n, dim, degree, width)
    if budget > needed:
        return 1, n
    return int((replicas * needed - 1) // budget) + 1, int(n * budget // needed)


def sample_size(n: int, k: int, rate: float) -> tuple[int, float]:
    """Vectors that k-means reads, and their share of all."""
    wanted = min(n, max(256_000, min(1000 * k, 1 << 23)))
    return wanted, min(rate, wanted / n)


def task_cost(n: int, dim: int, degree: int) -> tuple[int, int]:
    """(memory, work) of building one shard."""
    return n * dim * 4 + n * degree * 6, n * dim * degree


def sample_room(n: int, dim: int, k: int, gib: float, width: int = 4, rate: float = 0.05, most: int = 1 << 23) -> int:
    """Vectors of a sample that is clustered in memory: a share of all, as many as fit beside the centres."""
    fits = int((gib * GIB - k * 3 * 4 - k * 8) // ((dim * width + 4) * SLACK))
    return min(int(rate * n), fits, most, n)


def layer_geometry(n: int, top: int, layers: int, degree: int) -> dict:
    """growth, sizes, offsets and translation offsets of a layered graph, from the bottom, and rows of both tables.

    Layers shrink by a whole factor. It is that below the exact one if the other would leave fewer than `degree` points
    at the top, or leads less near to `top` points there.
    """
    exact = (n / top) ** (1 / (layers - 1)) if layers > 1 else 1.0
    low, high = int(exact), int(exact) + 1
    at_low, at_high = (n / g ** (layers - 1) if g else float("inf") for g in (low, high))
    growth = low if exact > 0 and (at_high < degree or abs(at_low - top) < abs(at_high - top)) else high
    sizes = [n, *(top * growth**i for i in range(layers - 2, -1, -1))]
    offsets = [sum(sizes[:i]) for i in range(layers)]
    return {
        "growth": growth,
        "sizes": sizes,
        "offsets": offsets,
        "translation_offsets": [0, *(x - n for x in offsets[1:])],
        "rows": sum(sizes),
        "translated": sum(sizes[1:]),
    }


def layered_file_bytes(geometry: dict, degree: int) -> int:
    """Bytes of a layered graph file: neighbours, two translations and two numbers, each padded to eight."""
    pad = lambda x: -(-x // 8) * 8
    return pad(4 * geometry["rows"] * degree) + 2 * pad(4 * geometry["translated"]) + 8
