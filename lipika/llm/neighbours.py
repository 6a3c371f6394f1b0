"""Problem 5: most similar vectors for every vector.

Method: hash-prefix forest. Each tree gives every vector a long hash string (signs against hyperplanes) and keeps the
strings sorted, so that all vectors sharing a prefix with one stand in a run around it. A vector descends all trees to
its longest matches and ascends them in step: the prefix length at which the runs of all trees together hold CANDIDATES
vectors is looked up in the sorted strings of the forest's sample, and is the same in every tree. The vectors of these
runs are its candidates.

Trees are cut into ranges of strings, one task each. A run that crosses the border of a range is searched on both sides,
as the vector is sent there as a guest. A task streams over its range, so its memory is bounded however many vectors share
a prefix. Vectors travel as 16-bit integers (cosine to about 1e-5). Of exact copies only the first k + 1 (by id) enter the
forest; they are the neighbours of the others.

A run is too small for a vector that finds k others over the cosine asked for in it; those are compared with all vectors,
and so are the vectors of `all_neighbours`: by groups of queries and vectors that meet once each.

Hyperplane offsets, range borders and prefix lengths are fitted on a bounded hash sample (SAMPLE vectors); every vector is
indexed. Rows without a usable vector of the current model (null, wrong size, not finite, all zero) take no part; of
several rows of one id the latest counts, on equal times the one with the greater vector. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lipika.llm.labels import checked, hash_sample
from lipika.session import cut_lineage

MODEL, DIMENSIONS, K, MIN_COSINE = "mini-multi-64", 64, 5, 0.90
TREES, BITS, SAMPLE, RANGE_ROWS = 4, 62, 20_000, 65_536
#: Vectors in the runs of all trees together.
CANDIDATES = 16_384
#: Queries and vectors compared at a time; rows of a range held at a time; vectors of a group of `all_neighbours`.
BLOCK, STEP, HELD, GROUP = 256, 2_048, 262_144, 98_304
_SCALE = 32_000.0
#: Cosine from which two vectors are copies; floats leave them this far from 1.
COPY = 1 - 1e-6


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the usable vectors of a list column."""
    keep = []
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum(np.nan_to_num(lengths).astype(np.int64))])
    rows = np.flatnonzero(np.nan_to_num(lengths) == size)
    if not len(rows):
        return rows, np.zeros((0, size), dtype=np.float32)
    x = values[starts[rows][:, None] + np.arange(size)]
    with np.errstate(all="ignore"):
        keep = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[keep], x[keep]


def _unit16(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers, scaled to their greatest component so that rounding is as fine as it can be."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x * _SCALE).astype("<i2")


def _floats(packed: np.ndarray) -> np.ndarray:
    """Unit float vectors of 16-bit ones."""
    x = packed.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(x: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous integer matrix as a binary column."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def current_vectors(embeddings: DataFrame, model: str = MODEL, size: int = DIMENSIONS) -> DataFrame:
    """(id, vector): the current usable vector of each chunk as packed 16-bit integers, written to the shared folder.

    Only the vectors of ids with several rows are shuffled to find the latest; the others stay where they were read."""
    rows = embeddings.where((F.col("model_name") == model) & F.col("embedding").isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", "created_at", F.col("embedding").cast("array<float>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = _matrix(b.column(2), size)
            if len(keep):
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), _binary(_unit16(x), 2 * size)], names=["id", "created_at", "vector"])

    packed = cut_lineage(rows.mapInArrow(pack, "id string, created_at timestamp, vector binary"))
    several = checked(packed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    latest = packed.join(several, "id", "left_semi").groupBy("id").agg(F.max(F.struct("created_at", "vector"))["vector"].alias("vector"))
    return packed.join(several, "id", "left_anti").select("id", "vector").unionByName(cut_lineage(latest))


class Forest:
    """Hyperplanes of the trees, the borders of their ranges and the sorted strings of the sample."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, bits: int = BITS, candidates: int = CANDIDATES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = sample.shape[1] if len(sample) else DIMENSIONS
        self.trees, self.bits, self.ranges = trees, bits, max(1, -(-rows // RANGE_ROWS))
        self.planes = rng.normal(size=(size, trees * bits)).astype(np.float32)
        self.offsets = np.median(sample @ self.planes, axis=0).astype(np.float32) if len(sample) else np.zeros(trees * bits, dtype=np.float32)
        self.known = np.sort(self.strings(sample).T, axis=1) if len(sample) else np.zeros((trees, 0), dtype=np.int64)
        self.borders = [np.quantile(h, np.arange(1, self.ranges) / self.ranges, method="nearest") if len(h) else np.zeros(0, dtype=np.int64) for h in self.known]
        #: Vectors of the sample that stand for the candidates.
        self.needed = candidates * len(sample) / max(rows, 1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings, one column per tree, as integers whose high bits come first."""
        signs = (x @ self.planes > self.offsets).reshape(len(x), self.trees, self.bits)
        return signs @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def tails(self, level: np.ndarray) -> np.ndarray:
        """The bits of a string beyond a prefix of `level` bits."""
        return (np.int64(1) << (self.bits - level)) - 1

    def _held(self, strings: np.ndarray, level: np.ndarray) -> np.ndarray:
        tails = self.tails(level)
        runs = (np.searchsorted(h, s | tails, "right") - np.searchsorted(h, s & ~tails, "left") for h, s in zip(self.known, strings.T, strict=True))
        return sum(runs, np.zeros(len(strings), dtype=np.int64))

    def levels(self, strings: np.ndarray) -> np.ndarray:
        """The longest prefix, the same in all trees, whose runs together hold enough candidates.

        By bisection, as runs only grow on the way up. Where the sample is too thin to show a run of that size, a run is
        taken to halve with every bit below the last one it shows."""
        low, high = np.zeros(len(strings), dtype=np.int64), np.full(len(strings), self.bits, dtype=np.int64)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            enough = self._held(strings, middle) >= max(self.needed, 1)
            low, high = np.where(open_ & enough, middle, low), np.where(open_ & ~enough, middle - 1, high)
        if 0 < self.needed < 1:
            low = np.minimum(low + int(np.log2(1 / self.needed)), self.bits)
        return low


def plant(vectors: DataFrame, trees: int = TREES, candidates: int = CANDIDATES) -> Forest:
    """A forest fitted on at most SAMPLE vectors, with ranges of about RANGE_ROWS vectors."""
    n = vectors.count()
    rows = hash_sample(vectors, "id", SAMPLE, n).select("vector").collect()
    sample = np.stack([np.frombuffer(r[0], dtype="<i2") for r in rows]) if rows else np.zeros((0, DIMENSIONS), dtype="<i2")
    return Forest(_floats(sample) if rows else sample.astype(np.float32), n, trees, candidates=candidates)


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores per `a`, the smaller `b` first on ties."""
    order = np.lexsort((b, -score, a))
    a = a[order]
    first = np.concatenate([[True], a[1:] != a[:-1]])
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    return order[rank < k]


class _Best:
    """The k best of a block of queries among the candidates that pass by. Scores count to 1e-6, so that equal vectors tie."""

    def __init__(self, x: np.ndarray, k: int, least: float) -> None:
        self.x, self.k, self.least = x, k, np.float32(max(least, -1.5))
        self.score = np.full((len(x), k), -2, dtype=np.float32)
        self.who = np.full((len(x), k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, code: np.ndarray, y: np.ndarray, own: np.ndarray) -> None:
        """Candidates with their codes (in the order of ids); `own` are the places of the queries among them, -1 for none."""
        s = self.x @ y.T
        here = np.flatnonzero(own >= 0)
        s[here, own[here]] = -2
        mark = np.maximum(self.score[:, -1] - np.float32(1e-6), self.least)
        good = s >= mark[:, None]
        if not (many := np.count_nonzero(good)):
            return
        if many > 4 * self.k * len(s):  # many at once: the best of them suffice
            most = min(2 * self.k, s.shape[1])
            j = np.argpartition(-s, most - 1, axis=1)[:, :most]
            i, j = np.repeat(np.arange(len(s)), most), j.ravel()
            keep = s[i, j] >= mark[i]
            i, j = i[keep], j[keep]
        else:
            i, j = np.divmod(np.flatnonzero(good), s.shape[1])
        rows = np.unique(i)
        a = np.concatenate([np.repeat(rows, self.k), i])
        score = np.concatenate([self.score[rows].ravel(), np.round(s[i, j], 6)])
        who = np.concatenate([self.who[rows].ravel(), code[j]])
        keep = _best(a, who, score, self.k)
        self.score[rows], self.who[rows] = score[keep].reshape(-1, self.k), who[keep].reshape(-1, self.k)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, score) of what was kept."""
        i, j = np.nonzero(self.score >= self.least)
        return i, self.who[i, j], self.score[i, j]


def _hits(ids: np.ndarray, others: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(others, pa.binary()), pa.array(scores, pa.float32())], names=["id", "other", "cosine"])


def _vectors(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<i2").reshape(len(packed), -1)


class _Range:
    """Streams over one range's rows in the order of their strings, HELD at a time; half of them stay for the next ones."""

    def __init__(self, forest: Forest, k: int, least: float) -> None:
        self.forest, self.k, self.least = forest, k, least
        self.rows: list[tuple[int, int, bytes, bytes]] = []  # string, level (less than 0: guest), id, vector
        self.done = 0

    def add(self, row: tuple[int, int, bytes, bytes]) -> Iterator[pa.RecordBatch]:
        """Take a row; gives what is found when enough are held."""
        self.rows.append(row)
        if len(self.rows) >= HELD:
            yield from self._search(HELD * 3 // 4)
            self.done = HELD // 4
            del self.rows[: HELD // 2]

    def close(self) -> Iterator[pa.RecordBatch]:
        """The range ends."""
        if self.rows:
            yield from self._search(len(self.rows))
        self.rows, self.done = [], 0

    def _search(self, end: int) -> Iterator[pa.RecordBatch]:
        strings, levels, ids, packed = zip(*self.rows, strict=True)
        s, level, packed = np.array(strings, dtype=np.int64), np.array(levels, dtype=np.int64), _vectors(packed)
        names = np.array(ids, dtype=object)
        home = level >= 0
        place = np.where(home, np.cumsum(home) - 1, -1)  # of a row among the candidates
        tails = self.forest.tails(np.where(home, level, -1 - level))
        at = s[home]
        low, high = np.searchsorted(at, s & ~tails, "left"), np.searchsorted(at, s | tails, "right")
        order = np.argsort(names[home], kind="stable")
        code = np.empty(len(order), dtype=np.int64)
        code[order] = np.arange(len(order))  # ids as numbers of the same order
        candidates, sorted_names = packed[home], names[home][order]
        for a in range(self.done, end, BLOCK):
            part = slice(a, min(a + BLOCK, end))
            best = _Best(_floats(packed[part]), self.k, self.least)
            for lo in range(int(low[part].min()), int(high[part].max()), STEP):
                some = slice(lo, min(lo + STEP, int(high[part].max())))
                own = place[part] - lo
                best.add(code[some], _floats(candidates[some]), np.where((place[part] >= 0) & (own >= 0) & (own < some.stop - lo), own, -1))
            i, who, score = best.hits()
            if len(i):
                yield _hits(names[part][i], sorted_names[who], score)


def _short(key: Column) -> Column:
    """Ids in lower-case hex at half their size, others as they are; a first byte tells which. Keeps the order."""
    hexed = (F.length(key) % 2 == 0) & key.rlike("^[0-9a-f]+$")
    return F.when(hexed, F.concat(F.unhex(F.lit("01")), F.unhex(key))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(key, "utf-8")))


def _long(key: Column) -> Column:
    """Inverse of `_short`."""
    rest = F.substring(key, 2, F.length(key))
    return F.when(F.substring(key, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


_FOUND = "id binary, other binary, cosine float"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(id, other, cosine, rank): the k best of each id."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    near = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select(_long(F.col("id")).alias("id"), _long(F.col("other")).alias("other"), "cosine", "rank")


def neighbours(vectors: DataFrame, forest: Forest, k: int = K, least: float = MIN_COSINE) -> DataFrame:
    """(id, other, cosine, rank): up to k most similar others with at least the cosine `least`, by the forest."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # the sample's strings: SAMPLE x TREES numbers

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            h = forest.strings(_floats(_vectors(b.column(1).to_pylist())))
            level = forest.levels(h)
            tails = forest.tails(level)
            for t, s in enumerate(h.T):
                home, first, last = (np.searchsorted(forest.borders[t], x, side="right") for x in (s, s & ~tails, s | tails))
                for r in range(int(first.min()), int(last.max()) + 1):
                    rows = np.flatnonzero((first <= r) & (r <= last))
                    if len(rows):
                        at = pa.array(rows)
                        kind = np.where(home[rows] == r, level[rows], -1 - level[rows]).astype(np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t * forest.ranges + r, dtype=np.int32)), pa.array(s[rows]), pa.array(kind), b.column(0).take(at), b.column(1).take(at)], names=["part", "string", "level", "id", "vector"])

    rows = vectors.select(_short(F.col("id")).alias("id"), "vector").mapInArrow(strings, "part int, string bigint, level tinyint, id binary, vector binary")
    rows = rows.repartitionById(forest.trees * forest.ranges, F.col("part")).sortWithinPartitions("part", "string", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, part = _Range(shared.value, k, least), None
        for b in batches:
            for p, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    yield from window.close()
                    part = p
                yield from window.add(row)
        yield from window.close()

    found = rows.mapInArrow(search, _FOUND)
    return _ranked(found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")), k)


def without_copies(vectors: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame | None]:
    """(vectors with at most k + 1 of each group of equal ones, neighbours of the others): (id, other, cosine, rank).

    The first of a group by id are the nearest of all its others. Keys of 96 bits travel, counted before the exchange; the
    first of a hot group are chosen before it, too. None where no group is that large."""
    keyed = vectors.select("id", F.xxhash64("vector").alias("k1"), F.hash("vector", F.lit(1)).alias("k2"))
    large = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("k1", "k2")
    large = cut_lineage(large)
    if large.isEmpty():
        return vectors, None
    members = cut_lineage(keyed.join(checked(large), ["k1", "k2"]))
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    first = cut_lineage(members.withColumn("rank", rank).where(F.col("rank") <= k + 1))
    rest = members.join(first.select("id"), "id", "left_anti")
    near = rest.join(first.where(F.col("rank") <= k).select("k1", "k2", F.col("id").alias("other"), "rank"), ["k1", "k2"])
    return vectors.join(checked(rest.select("id")), "id", "left_anti"), near.select("id", "other", F.lit(1.0).cast("float").alias("cosine"), "rank")


def with_dense(vectors: DataFrame, near: DataFrame, k: int = K, least: float = MIN_COSINE) -> DataFrame:
    """`near` of the forest, made exact for the members of dense groups.

    Better ones than the k it found over `least` may stand outside a run. Unless the k-th already is a copy, which none can
    exceed, such a vector is compared with all."""
    near = cut_lineage(near)
    dense = cut_lineage(near.where((F.col("rank") == k) & (F.col("cosine") < COPY)).select("id"))
    if dense.isEmpty():
        return near
    dense = checked(dense)
    asked = cut_lineage(vectors.join(dense, "id", "left_semi"))
    return near.join(dense, "id", "left_anti").unionByName(all_neighbours(vectors, asked, k, least))


def mutual_pairs(near: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b) where each is among the other's neighbours."""
    both = near.groupBy(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).agg(F.count("*").alias("n"))
    return both.where("n = 2").select("chunk_a", "chunk_b")


def all_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, least: float = -1.0) -> DataFrame:
    """(id, other, cosine, rank): up to k most similar others of every query among all vectors, none left out.

    Queries and vectors fall into groups of about GROUP by hash of their id; every two groups meet in one task, which
    keeps the k best of its queries. The work grows as queries times vectors; nothing of it is in the driver."""
    meeting = (queries.count() * vectors.count()) ** 0.5
    groups = max(1, int(-(-meeting // GROUP)))
    numbers = F.sequence(F.lit(0), F.lit(groups - 1))
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    columns = _short(F.col("id")).alias("id"), F.col("vector").alias("packed")
    asked = queries.select(*columns, group.alias("q"), F.explode(numbers).alias("v"))
    given = vectors.select(*columns, F.explode(numbers).alias("q"), group.alias("v"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_hits([], [], [])])
        right = right.sort_by("id")
        names, packed = np.array(right["id"].to_pylist(), dtype=object), _vectors(right["packed"].to_pylist())
        ids, q = np.array(left["id"].to_pylist(), dtype=object), _vectors(left["packed"].to_pylist())
        place = {name: n for n, name in enumerate(names)}
        own, y, found = np.array([place.get(name, -1) for name in ids]), _floats(packed), []
        for a in range(0, len(ids), BLOCK):
            best = _Best(_floats(q[a : a + BLOCK]), k, least)
            for lo in range(0, len(y), STEP):
                at = own[a : a + BLOCK] - lo
                best.add(np.arange(lo, min(lo + STEP, len(y))), y[lo : lo + STEP], np.where((at >= 0) & (at < STEP) & (own[a : a + BLOCK] >= 0), at, -1))
            i, who, score = best.hits()
            found.append(_hits(ids[a : a + BLOCK][i], names[who], score))
        return pa.Table.from_batches(found)

    return _ranked(asked.groupBy("q", "v").cogroup(given.groupBy("q", "v")).applyInArrow(compare, _FOUND), k)


def recall(near: DataFrame, exact: DataFrame) -> DataFrame:
    """(expected, found, recall): share of the exact neighbours that `near` holds."""
    hit = exact.select("id", "other").join(near.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    sums = hit.agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
    return sums.withColumn("recall", F.col("found") / F.nullif(F.col("expected"), F.lit(0)))


def forest_neighbours(vectors: DataFrame, k: int = K, least: float = MIN_COSINE) -> DataFrame:
    """(id, other, cosine, rank) of every vector, copies included, by the forest; exact for members of dense groups."""
    kept, copies = without_copies(vectors, k)
    near = with_dense(kept, neighbours(kept, plant(kept), k, least), k, least)
    return near if copies is None else near.unionByName(copies)


def exact_neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, least: float = -1.0) -> DataFrame:
    """(id, other, cosine, rank) of every query, or every vector, copies included, compared with all."""
    kept, copies = without_copies(vectors, k)
    asked = kept if queries is None else queries.join(kept.select("id"), "id", "left_semi") if copies is not None else queries
    near = all_neighbours(kept, asked, k, least)
    if copies is None:
        return near
    return near.unionByName(copies if queries is None else copies.join(queries.select("id"), "id", "left_semi"))
