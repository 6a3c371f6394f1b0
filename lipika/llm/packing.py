"""Problem 8: filling fixed-capacity containers with items.

Method: bin completion. The largest item left opens a container; branch-and-bound enumerates undominated
fillings of the rest of it, prunes by the waste still reachable, starts from best fit as the incumbent and
stops at a perfect fit. A search of NODES nodes that has neither proven its incumbent nor found a perfect fit goes on
with an exact bound: the sums the sizes left can reach at all, as bits of an integer; the filling of the greatest sum is
read off them. So every container has the least waste its largest item allows. Items are cut only if they exceed the
capacity: whole containers first, the remainder is packed like any other item.

Items are packed within cells of about `cell_items` (by hash of id, size and number among equal rows, so that repeated
ids spread and the files' order doesn't matter), each one task's work: only ids and sizes travel, and what a cell leaves
unused is at most its last containers. Null and empty texts have size 0 and lie in a container at no cost. Every item is
placed exactly once, repeated ids included.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lipika.llm.tokens import Pieces, token_count

CAPACITY, CELL_ITEMS, NODES = 1024, 4096, 240


class _Sizes:
    """A multiset of sizes in 1..capacity; a big integer's bits tell which are present."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.count = [0] * (capacity + 1)
        for s in sizes:
            self.count[s] += 1
        self.bits = sum(1 << s for s, c in enumerate(self.count) if c)

    def largest(self, most: int) -> int:
        """Largest size present that is at most `most`, else 0."""
        return max(0, (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.bits ^= 1 << s

    def give(self, s: int) -> None:
        self.count[s] += 1
        self.bits |= 1 << s


def fullest(room: int, left: _Sizes) -> list[int]:
    """Sizes out of `left` with the greatest sum within `room`, larger sizes first. Exact: bit i of a layer tells whether i
    can be reached with the sizes up to there; counts enter by halves, so a size costs the logarithm of its count."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    s = 0
    while rest := left.bits >> (s + 1):
        s += 1 + (rest & -rest).bit_length() - 1
        if s > room:
            break
        layers.append((s, reach))
        many, step = min(left.count[s], room // s), 1
        while many:
            step = min(step, many)
            reach |= (reach << (s * step)) & mask
            many, step = many - step, step * 2
    total, found = reach.bit_length() - 1, []
    for s, before in reversed(layers):
        most = min(left.count[s], total // s)
        n = next(k for k in range(most, -1, -1) if before >> (total - k * s) & 1)
        found += [s] * n
        total -= n * s
    return found


def complete(room: int, left: _Sizes, nodes: int = NODES) -> list[int]:
    """Sizes out of `left` that fill `room` with the least waste; `left` is unchanged."""
    best_waste, best, chosen, budget = room, [], [], nodes

    def search(room: int, most: int, skipped: int) -> None:
        nonlocal best_waste, best, budget
        s = left.largest(min(room, most))
        if not s:
            # dominated if a size passed over at this level fits where nothing else was put
            if room < best_waste and not (skipped and skipped <= room):
                best_waste, best = room, list(chosen)
            return
        while s and budget > 0 and best_waste:
            budget -= 1
            left.take(s)
            chosen.append(s)
            search(room - s, s, 0)
            chosen.pop()
            left.give(s)
            if s * 2 <= room - best_waste and not left.largest(s - 1):
                break
            skipped = max(skipped, s)
            s = left.largest(s - 1)
            if s and sum_bound(s) <= room - best_waste:
                break  # all that is left together leaves more waste than the incumbent

    def sum_bound(most: int) -> int:
        """What sizes up to `most` can fill at best, cut off at the capacity."""
        total, s = 0, most
        while s and total < len(left.count):
            total += s * left.count[s]
            s = left.largest(s - 1)
        return total

    search(room, room, 0)
    if budget <= 0 and best_waste:
        exact = fullest(room, left)
        return exact if sum(exact) > room - best_waste else best
    return best


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of item positions. Sizes must be within 1..capacity."""
    where: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(sizes)), key=lambda i: -i):
        where[sizes[i]].append(i)
    left, containers = _Sizes(sizes, capacity), []
    while s := left.largest(capacity):
        left.take(s)
        filling = [s, *complete(capacity - s, left, nodes)]
        for x in filling[1:]:
            left.take(x)
        containers.append([where[x].pop() for x in filling])
    return containers


def pack(docs: DataFrame, pieces: Pieces, capacity: int = CAPACITY, cell_items: int = CELL_ITEMS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece_no, first_token, tokens, cell, container): every item, or its pieces if larger than the capacity."""
    cells = max(1, -(-docs.count() // cell_items))
    sized = docs.select(F.col(id_col), token_count(pieces, F.col(text)).alias("tokens")).groupBy(id_col, "tokens").agg(F.count("*").alias("rows"))
    sized = sized.select(id_col, "tokens", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("n"))
    sized = sized.select(id_col, "tokens", F.pmod(F.xxhash64(id_col, "tokens", "n"), F.lit(cells)).alias("cell"))
    kind = docs.schema[id_col].dataType.simpleString()

    def fill(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values([id_col, "tokens"], na_position="first")
        rows, items = [], []
        containers = 0
        for key, n in zip(cell[id_col], cell["tokens"], strict=True):
            full, rest = divmod(int(n), capacity)
            if n <= capacity:
                items.append((key, 0, 0, int(n)))
                continue
            for k in range(full):
                rows.append((key, k, k * capacity, capacity, containers))
                containers += 1
            if rest:
                items.append((key, full, full * capacity, rest))
        sizes = [x for x in items if x[3]]
        for positions in pack_sizes([x[3] for x in sizes], capacity):
            rows += [(*sizes[p], containers) for p in positions]
            containers += 1
        rows += [(*x, max(0, containers - 1)) for x in items if not x[3]]
        out = pd.DataFrame(rows, columns=[id_col, "piece_no", "first_token", "tokens", "container"])
        out.insert(4, "cell", int(cell["cell"].iloc[0]))
        return out

    return sized.groupBy("cell").applyInPandas(fill, f"`{id_col}` {kind}, piece_no int, first_token bigint, tokens bigint, cell bigint, container bigint")


def oversized(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that had to be cut."""
    return packed.where("piece_no > 0").select(id_col).distinct()


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cells, containers, tokens, capacity, filled): how full the containers are."""
    per = packed.groupBy("cell", "container").agg(F.sum("tokens").alias("tokens"))
    totals = per.agg(F.countDistinct("cell").alias("cells"), F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"))
    return totals.withColumn("capacity", F.lit(capacity)).withColumn("filled", F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)))
