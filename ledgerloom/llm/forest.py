"""The most similar vectors for every vector: a hash-prefix forest.

Each tree hashes a vector to a long string of bits, the sides of random hyperplanes through the
mean of the data, and keeps the vectors as an array sorted by that string, in which those that
share a prefix with a vector, of whatever length, lie around it. Descending to a vector's longest
match in a tree and ascending again, a prefix of each length is met by ever more vectors. All trees
are ascended together: each tells at which length it has met as many as are asked for of a tree, and
the mean of these lengths over the trees, a length of the vector's own that follows the density
around it, is the one down to which every tree is then ascended; all vectors that share so long a
prefix in any tree are its candidates.

The arrays are cut into slices of a few thousand vectors near quantiles of the hash strings, taken
from a bounded sample, each at the shortest prefix there, so that prefixes of the lengths ascended
to are hardly ever divided; equal strings at a cut are dealt out over the slices that meet there, so
no slice grows with a hot string. Slices carry vectors in 8 bits a dimension; the candidates they
name are scored again with the vectors themselves.

A vector that meets more than k others of the least cosine asked for on one ascent lies in a crowd,
which no prefix divides well enough: it is compared with every vector that may be that close. Such
vectors go out in blocks, each divided into groups of a stated radius around leaders, so that all
vectors too far from a group's leader are passed over without loss; this is exact for crowds of any
size, and its cost grows with the product of a crowd and its surroundings. Equal vectors are one class in the forest,
whatever their number, and are opened to their members at the end, of which no result needs more
than the first k + 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import temporary_folder

TREES = 8
HASH_BITS = 63
ASCEND = 64
SLICE_ROWS = 16_384
MOST_TASKS = 20_000
#: The mean and the slices' bounds are fitted on about this many vectors, drawn by a hash of their keys, and never more than twice as many.
FIT_ROWS = 20_000
#: What 8 bits a dimension may be off; candidates this far below the least cosine asked for are still scored.
ROUGH = 0.012
SEED = 71
#: Vectors compared with all others go out in blocks of so many bytes, in groups of this radius (radians) around at most so many leaders; what lies near none of these is compared without bounds.
BLOCK_BYTES = 32_000_000
RADIUS = 0.45
LEADERS = 256
#: Queries scored at once, and what a cosine in single precision may be off.
AT_ONCE = 512
SLACK = 1e-5
#: Bits of the filter that tells which vectors are fetched for exact scores.
BITS = 24


def usable(vectors: DataFrame) -> DataFrame:
    """(model, session_id, ordinal, vec) of the vectors that can be compared.

    Left out: null vectors and keys, lengths other than ``dim``, values that are null, infinite or
    not a number, and vectors of zeros. Repeated rows stay here.
    """
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    keyed = vectors.where(F.col("model").isNotNull() & F.col("session_id").isNotNull() & F.col("ordinal").isNotNull())
    return keyed.where((F.size(vec) == F.col("dim")) & (F.size(vec) > 0) & fine).select("model", "session_id", "ordinal", "vec")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` floats as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of tiny values would vanish
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of hash strings."""
    differ = a ^ b
    high = differ >> 31
    # exact in doubles, as each half has 32 bits at most
    bits = np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((differ & (2**31 - 1)).astype(np.float64))[1])
    return (HASH_BITS - bits).astype(np.int16)


def cuts(strings: np.ndarray, slices: int) -> np.ndarray:
    """Bounds of ``slices`` slices of sorted strings, each the shortest prefix within a quarter of a slice around its quantile."""
    if slices < 2:
        return np.empty(0, np.int64)
    at, n = np.arange(1, slices) / slices, len(strings)
    low, high = (strings[np.clip(((at + d / slices) * n).astype(np.int64), 0, n - 1)] for d in (-0.25, 0.25))
    below = np.maximum(HASH_BITS - shared_bits(low, high).astype(np.int64) - 1, 0)  # bits behind the first one that differs
    return np.where(low < high, (high >> below) << below, high)


class Forest:
    """Hyperplanes, mean and slice bounds of one model's trees."""

    def __init__(self, sample: np.ndarray, slices: int, first: int, trees: int):
        dim = sample.shape[1]
        self.planes = np.random.default_rng([SEED, dim]).standard_normal((dim, trees * HASH_BITS)).astype(np.float32)
        self.mean = sample.mean(axis=0) if len(sample) > 1 else np.zeros(dim, np.float32)
        self.trees, self.slices, self.first = trees, slices, first
        strings = np.sort(self.strings(sample), axis=0)
        self.bounds = [cuts(strings[:, t], slices) for t in range(trees)]

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """[vector, tree] -> its hash string as a number."""
        sides = ((rows - self.mean) @ self.planes > 0).reshape(len(rows), self.trees, HASH_BITS)
        packed = np.packbits(np.concatenate((np.zeros((len(rows), self.trees, 1), bool), sides), axis=2), axis=2)
        return packed.view(">u8").reshape(len(rows), self.trees).astype(np.int64)

    def slice_of(self, strings: np.ndarray, tree: int, deal: np.ndarray) -> np.ndarray:
        bounds = self.bounds[tree]
        low, high = np.searchsorted(bounds, strings, "left"), np.searchsorted(bounds, strings, "right")
        return self.first + tree * self.slices + low + deal % (high - low + 1)


def plant(classes: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """(slice, string, id, code): every class once for each tree."""
    shared = classes.sparkSession.sparkContext.broadcast(forests)  # dim * trees * HASH_BITS and bounds from the sample, a model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column("space")
            for space in spaces.unique().to_pylist():
                part = batch.filter(pa.compute.equal(spaces, space))
                forest = shared.value[space]
                ids = part.column("id").to_numpy(zero_copy_only=False)
                rows = unit(matrix(part.column("vec"), len(forest.mean)))
                strings = forest.strings(rows)
                top = np.abs(rows).max(axis=1, keepdims=True)
                codes = np.concatenate((np.round(rows / top * 127).astype(np.int8).view(np.uint8), (top / 127).astype("<f4").view(np.uint8).reshape(len(rows), 4)), axis=1)
                width = codes.shape[1]
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
                for tree in range(forest.trees):
                    home = forest.slice_of(strings[:, tree], tree, (ids >> 7) & 0xFFFF).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.ascontiguousarray(strings[:, tree])), pa.array(ids), data], ["slice", "string", "id", "code"])

    return classes.mapInArrow(run, "slice int, string long, id long, code binary")


def own_levels(strings: np.ndarray, wanted: int) -> np.ndarray:
    """For each of a tree's sorted strings the longest prefix it shares with at least ``wanted`` of them, itself included."""
    n = len(strings)
    if n <= wanted:
        return np.zeros(n, np.int16)
    shared = shared_bits(strings[:-1], strings[1:])
    runs = np.lib.stride_tricks.sliding_window_view(shared, wanted - 1).min(axis=1)  # of each run of ``wanted`` places the prefix they share
    padded = np.concatenate((np.full(wanted - 1, -1, np.int16), runs, np.full(wanted - 1, -1, np.int16)))
    return np.lib.stride_tricks.sliding_window_view(padded, wanted).max(axis=1)


def climb(code: np.ndarray, strings: np.ndarray, ids: np.ndarray, levels: np.ndarray, least: float | None, keep: int, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids that share a prefix as long as either's level, in a slice's sorted array, and their rough cosines.

    With ``least`` those whose rough cosine may reach it; else each vector's ``keep`` best. Vectors
    that meet more than ``crowd`` of such are told by a pair with themselves, and pairs of two of
    them are left to ``against_all``.
    """
    width = code.shape[1] - 4
    rows = code[:, :width].view(np.int8).astype(np.float32) * np.ascontiguousarray(code[:, width:]).view("<f4")
    n, left, right, rough = len(ids), [], [], []
    shared = shared_bits(strings[:-1], strings[1:])
    prefix, places = shared, np.arange(n - 1)
    for step in range(1, n):
        # places whose prefix, common to all on the way, is as long as one of the two ascends to
        if step > 1:
            more = places + step < n
            places, prefix = places[more], prefix[more]
            prefix = np.minimum(prefix, shared[places + step - 1])
        reach = prefix >= np.minimum(levels[places], levels[places + step])
        going = prefix >= levels.min()
        if not going.any():
            break
        at = places[reach]
        if len(at):
            dots = np.einsum("ij,ij->i", rows[at], rows[at + step])
            hit = np.flatnonzero(dots >= least - ROUGH) if least is not None else np.arange(len(at))
            left.append(at[hit])
            right.append(at[hit] + step)
            rough.append(dots[hit])
        places, prefix = places[going], prefix[going]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    a, b, rough = np.concatenate(left), np.concatenate(right), np.concatenate(rough)
    if least is None:
        who, other, score = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((rough, rough))
        order = np.lexsort((-score, who))
        who, other, score = who[order], other[order], score[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < keep
        return ids[who[best]], ids[other[best]], score[best]
    crowded = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) > crowd
    open_ = ~(crowded[a] & crowded[b])
    own = np.flatnonzero(crowded)
    return ids[np.concatenate((a[open_], own))], ids[np.concatenate((b[open_], own))], np.concatenate((rough[open_], np.ones(len(own), np.float32)))


def levels_of(planted: DataFrame, ascend: int, tasks: int) -> DataFrame:
    """(slice, id, level): for each vector the prefix length to which its trees ascend together."""

    def one(part: pa.Table) -> pa.Table:
        strings, ids = part.column("string").to_numpy(), part.column("id").to_numpy()
        order = np.argsort(strings, kind="stable")
        return pa.table({"slice": pa.array(np.full(len(ids), part.column("slice")[0].as_py(), np.int32)), "id": ids[order], "own": own_levels(strings[order], 2 * ascend + 1)})

    told = planted.groupBy("slice").applyInArrow(one, "slice int, id long, own short")
    mean = F.floor(F.avg("own").over(Window.partitionBy("id"))).cast("short")
    return told.select("slice", "id", mean.alias("level")).repartition(tasks, "slice")


def candidates(planted: DataFrame, slices: int, ascend: int, least: float | None, keep: int, crowd: int) -> DataFrame:
    """Distinct candidate pairs (id, other), the smaller id first; with ``least`` also (id, id) for vectors in a crowd.

    Without ``least`` the ``keep`` best of each id by rough cosine over all trees, so that few
    vectors are fetched for the exact scores; an id has at most ``keep`` from each tree.
    """

    def one(part: pa.Table, told: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        a, b, rough = none, none, np.empty(0, np.float32)
        if part.num_rows > 1:
            strings, ids = part.column("string").to_numpy(), part.column("id").to_numpy()
            code = part.column("code").combine_chunks()
            code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
            width = len(code[0].as_py())
            start = code.offset * width
            data = np.frombuffer(code.buffers()[2], np.uint8)[start : start + len(code) * width].reshape(-1, width)
            of, level = told.column("id").to_numpy(), told.column("level").to_numpy()
            by_id = np.argsort(of)
            order = np.argsort(strings, kind="stable")
            mine = level[by_id[np.searchsorted(of[by_id], ids[order])]]
            a, b, rough = climb(data[order], strings[order], ids[order], mine, least, keep, crowd)
        if least is not None:
            return pa.table({"id": np.minimum(a, b), "other": np.maximum(a, b)})
        return pa.table({"id": a, "other": b, "rough": rough})

    # a few slices a task, however many there are, whatever the session's number of partitions; both passes over the slices share one shuffle
    tasks = max(1, min(slices // 4, MOST_TASKS))
    planted = planted.repartition(tasks, "slice")
    both = planted.groupBy("slice").cogroup(levels_of(planted, ascend, tasks).groupBy("slice"))
    if least is not None:
        return both.applyInArrow(one, "id long, other long").distinct()
    return best_pairs(both.applyInArrow(one, "id long, other long, rough float"), keep)


def best_pairs(met: DataFrame, keep: int) -> DataFrame:
    """Distinct pairs (id, other), the smaller id first, of each id's ``keep`` best by rough cosine."""
    lists = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("rough", "other")), asc=False), 1, keep).alias("_best"))
    best = lists.select("id", F.explode("_best.other").alias("other"))
    return best.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()


class Block:
    """Vectors of one space that are compared with all others, in groups around leaders."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, least: float | None):
        group = np.full(len(rows), -1)
        leaders = []
        if least is not None:
            rest = np.arange(len(rows))
            while len(rest) and len(leaders) < LEADERS:
                near = rows[rest] @ rows[rest[0]] >= np.cos(RADIUS)
                near[0] = True
                group[rest[near]] = len(leaders)
                leaders.append(rows[rest[0]])
                rest = rest[~near]
        order = np.argsort(group, kind="stable")
        self.ids, self.rows, self.least = ids[order], rows[order], -2.0 if least is None else least - SLACK
        self.leaders = np.array(leaders, np.float32).reshape(-1, rows.shape[1])
        self.starts = np.searchsorted(group[order], np.arange(-1, len(leaders) + 1))
        self.reach = -2.0 if least is None else np.cos(min(np.pi, RADIUS + np.arccos(max(-1.0, self.least)))) - SLACK


class Scan:
    """The ``keep`` best of each vector of a block among all vectors met so far."""

    def __init__(self, block: Block, keep: int):
        self.block, self.keep = block, keep
        self.sims = np.full((len(block.ids), keep), -3, np.float32)
        self.others = np.zeros((len(block.ids), keep), np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        block = self.block
        ids, first = np.unique(ids, return_index=True)
        rows = rows[first]
        near = rows @ block.leaders.T >= block.reach
        for g, (a, z) in enumerate(zip(block.starts[:-1], block.starts[1:])):
            if a == z:
                continue
            at = slice(None) if g == 0 else np.flatnonzero(near[:, g - 1])
            some, some_ids = rows[at], ids[at]
            if len(some):
                for start in range(a, z, AT_ONCE):
                    self.score(start, min(z, start + AT_ONCE), some, some_ids)

    def score(self, a: int, z: int, rows: np.ndarray, ids: np.ndarray) -> None:
        keep, own = self.keep, self.block.ids[a:z]
        sims = self.block.rows[a:z] @ rows.T
        floor = np.maximum(self.sims[a:z].min(axis=1), self.block.least)
        # held ones and the vector itself may be met again, so that many more are looked at
        need, parts = 2 * keep + 1, 16
        wide = len(ids) // parts
        if wide > need:
            # the best of each of ``wide`` disjoint sets: the need-th of them is a lower bound of the need-th of all
            tops = sims[:, : wide * parts].reshape(len(own), parts, wide).max(axis=1)
            floor = np.maximum(floor, np.partition(tops, wide - need, axis=1)[:, wide - need])
        hit = np.flatnonzero(sims >= floor[:, None])
        q, y = hit // len(ids), hit % len(ids)
        new = (ids[y] != own[q]) & (self.others[a + q] != ids[y][:, None]).all(axis=1)
        q, y = q[new], y[new]
        if not len(q):
            return
        u = np.unique(q)
        who = np.concatenate((np.repeat(u, keep), q))
        sim = np.concatenate((self.sims[a + u].ravel(), sims[q, y]))
        other = np.concatenate((self.others[a + u].ravel(), ids[y]))
        order = np.lexsort((-sim, who))
        starts = np.searchsorted(who[order], u)
        best = order[(starts[:, None] + np.arange(keep)).ravel()]
        self.sims[a + u], self.others[a + u] = sim[best].reshape(-1, keep), other[best].reshape(-1, keep)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, at = np.nonzero(self.sims > -3)
        return self.block.ids[q], self.others[q, at], self.sims[q, at]


def against_all(wanted: DataFrame, rows: DataFrame, least: float | None, keep: int, folder: str) -> DataFrame:
    """Distinct pairs (id, other) of the ``keep`` most similar of all ``rows`` for each of ``wanted``, which is read again for each block."""
    spark = rows.sparkSession
    size = wanted.agg(F.sum(F.size("vec") * 4)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for number in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).select("id", "space", "vec").toArrow()
        held = {}
        for space in part.column("space").unique().to_pylist():
            mine = part.filter(pa.compute.equal(part.column("space"), space))
            vec = mine.column("vec")
            held[space] = Block(mine.column("id").to_numpy(), unit(matrix(vec, len(vec[0]))), least)
        shared = spark.sparkContext.broadcast(held)  # BLOCK_BYTES and as much again for ids at the most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scans = {space: Scan(block, keep) for space, block in shared.value.items()}  # noqa: B023
            for batch in batches:
                spaces = batch.column("space")
                for space in spaces.unique().to_pylist():
                    if space in scans:
                        mine = batch.filter(pa.compute.equal(spaces, space))
                        scans[space].meet(mine.column("id").to_numpy(zero_copy_only=False), unit(matrix(mine.column("vec"), scans[space].block.rows.shape[1])))
            for scan in scans.values():
                a, b, rough = scan.found()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(rough)], ["id", "other", "rough"])

        rows.select("id", "space", "vec").mapInArrow(run, "id long, other long, rough float").write.parquet(f"{folder}/block={number}")
        shared.destroy()
    return best_pairs(spark.read.schema("id long, other long, rough float").parquet(*[f"{folder}/block={number}" for number in range(blocks)]), keep)


def named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``rows`` that ``found`` may name: a bitmap of fixed size is asked."""
    bit = F.call_function("shiftrightunsigned", F.col("id"), F.lit(64 - BITS))
    ids = found.select(F.explode(F.array("id", "other")).alias("id")).select(bit.alias("bit"))
    words = ids.groupBy(F.call_function("shiftright", F.col("bit"), F.lit(6)).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(2 ** (BITS - 6), dtype="<i8")  # 2**BITS bits, whatever the number of vectors
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITS)
            yield batch.filter(pa.array((shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))

    return rows.select("id", "space", "vec").mapInArrow(run, "id long, space string, vec array<float>")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def fitted(rows: DataFrame, trees: int) -> tuple[dict[str, Forest], int]:
    """Each space's forest, and the number of slices of all."""
    counts = {r["space"]: (r["n"], r["dim"]) for r in rows.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).collect()}  # a row for each model
    sample: dict[str, list] = {}
    share = min(1_000_000, -(-FIT_ROWS * 1_000_000 // max(1, sum(n for n, _ in counts.values()))))
    drawn = rows.where(F.pmod(F.xxhash64("session_id", "ordinal"), F.lit(1_000_000)) < share).select("space", "vec").distinct()
    for r in drawn.limit(2 * FIT_ROWS).collect():
        sample.setdefault(r["space"], []).append(r["vec"])
    forests, first = {}, 0
    for space, (n, dim) in sorted(counts.items()):
        slices = max(1, -(-n // SLICE_ROWS))
        drawn_rows = unit(np.array(sample[space])) if space in sample else np.zeros((0, dim), np.float32)
        slices = min(slices, max(1, len(drawn_rows)))
        forests[space] = Forest(drawn_rows, slices, first, trees)
        first += slices * trees
    return forests, first


def nearest(vectors: DataFrame, k: int = 5, least: float | None = None, trees: int = TREES, ascend: int = ASCEND, exact: bool = False) -> DataFrame:
    """model, session_id, ordinal, other_session_id, other_ordinal, cosine, rank: the k most similar other chunks of each.

    Only within one model, and there between vectors of one length. With ``least`` neighbours of a smaller cosine aren't looked for; with ``exact`` there is no forest and all are compared with all. Ties go
    to the smaller key. A key with several different vectors is compared by each of them and never
    with itself. Models with one vector give no rows, as do empty tables.
    """
    rows = usable(vectors).withColumn("id", F.xxhash64("model", "vec")).withColumn("space", F.concat_ws("/", "model", F.size("vec")))
    keys = rows.select("id", "model", "session_id", "ordinal").distinct()
    # grouped by the key of the later joins, which then need no shuffle of the vectors of their own
    classes = rows.groupBy("id").agg(F.first("space").alias("space"), F.first("vec").alias("vec"))
    forests, first = ({}, 0) if exact else fitted(rows, trees)
    if exact:
        folder = temporary_folder(vectors.sparkSession, "forest")
        classes.write.parquet(f"{folder}/classes")
        classes = vectors.sparkSession.read.parquet(f"{folder}/classes")
        found = against_all(classes, classes, least, k + 3, f"{folder}/exact")
    elif not forests:
        found = classes.select(F.col("id"), F.col("id").alias("other")).where("false")
    elif least is None:
        found = candidates(plant(classes, forests), first, ascend, None, k + 3, k)
    else:
        # pairs of ids alone are written, so that the crowd can be looked for in them
        folder = temporary_folder(vectors.sparkSession, "forest")
        candidates(plant(classes, forests), first, ascend, least, k + 3, k).write.parquet(f"{folder}/met")
        met = vectors.sparkSession.read.parquet(f"{folder}/met")
        found, crowd = met.where("id <> other"), met.where("id = other").select("id")
        if not crowd.isEmpty():
            of_crowd = named(rows, crowd.withColumn("other", F.col("id"))).dropDuplicates(["id"]).join(crowd, "id", "left_semi")
            of_crowd.write.parquet(f"{folder}/crowd")
            found = found.unionByName(against_all(vectors.sparkSession.read.parquet(f"{folder}/crowd"), rows, least, k + 3, f"{folder}/exact")).distinct()
        classes = named(rows, found).groupBy("id").agg(F.first("space").alias("space"), F.first("vec").alias("vec"))

    # asking for the space too keeps all three readings of the classes alike, so that they share one shuffle
    of = lambda name: classes.select(F.col("id").alias(name), F.col("space").alias(f"space_{name}"), F.col("vec").alias(f"vec_{name}"))
    scored = found.join(of("id"), "id").join(of("other"), "other")
    # equal spaces, said so that the planner doesn't take them into the join's key, which would shuffle the vectors anew
    scored = scored.where((F.col("space_id") <= F.col("space_other")) & (F.col("space_id") >= F.col("space_other")))
    scored = scored.select("id", "other", cosine(F.col("vec_id"), F.col("vec_other")).alias("cosine"))
    if least is not None:
        scored = scored.where(F.col("cosine") >= least)
    both = scored.unionByName(scored.select(F.col("other").alias("id"), F.col("id").alias("other"), "cosine"))
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    both = both.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")

    # the first k + 1 members of each class are all that any chunk's list can need of it
    own = Window.partitionBy("id").orderBy("session_id", "ordinal")
    heads = keys.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= k + 1)
    heads = heads.select(F.col("id").alias("other"), F.col("session_id").alias("other_session_id"), F.col("ordinal").alias("other_ordinal"))
    twins = heads.groupBy("other").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("other").alias("id"), "other", F.lit(1.0).alias("cosine"))
    lists = both.unionByName(twins).join(heads, "other")
    pairs = keys.join(lists, "id").where((F.col("session_id") != F.col("other_session_id")) | (F.col("ordinal") != F.col("other_ordinal")))
    chunk = ["model", "session_id", "ordinal"]
    pairs = pairs.groupBy(*chunk, "other_session_id", "other_ordinal").agg(F.max("cosine").alias("cosine"))
    closest = Window.partitionBy(*chunk).orderBy(F.desc(F.round("cosine", 9)), "other_session_id", "other_ordinal")
    return pairs.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.93) -> DataFrame:
    """(model, session_id_a, ordinal_a, session_id_b, ordinal_b): pairs of chunks, one among the other's k nearest, a the smaller key."""
    near = nearest(vectors, k, least)
    a, b = F.struct("session_id", "ordinal"), F.struct(F.col("other_session_id").alias("session_id"), F.col("other_ordinal").alias("ordinal"))
    ends = near.select("model", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return ends.select("model", F.col("a.session_id").alias("session_id_a"), F.col("a.ordinal").alias("ordinal_a"), F.col("b.session_id").alias("session_id_b"), F.col("b.ordinal").alias("ordinal_b"))
