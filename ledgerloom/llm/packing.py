"""Filling containers of fixed capacity: configuration LP over the length histogram, then rounding.

The lengths of at most ``capacity`` different values form a histogram (bounded, whatever the number
of items). For the configuration LP, "choose how often to use each way to fill a container, so that
every length is covered", lengths above a small one are rounded up to units of the capacity; it is
solved by multiplicative weights: each round prices the classes of lengths, finds the most
valuable filling by a knapsack dynamic programme over the units, and lowers the prices of what it
covers. The fractional solution is scaled until every class is covered, rounded down to whole
containers and opened to exact lengths, the longest first; the room that rounding left is filled
with the next lengths that fit, and what remains is filled by best fit. The plan is a bounded table
of fillings with their multiplicity; the items themselves are numbered within their length and
joined to it, so nothing of the size of the input reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPACITY = 4096
#: Ways to solve the LP, (units of the capacity that lengths are rounded up to, rounds, fillings a round): finer units fit tighter, coarser ones cover rare lengths sooner.
LEVELS = ((1024, 400, 6), (4096, 100, 1))
#: The part of the capacity up to which lengths only fill gaps.
SMALL = 16
#: How fast prices fall with the cover of a class, and how much of its scarcest class a round covers.
FALL, STEP = 24.0, 0.05
#: How far open a container of the LP may stay, each tried: little where lengths fit well, any where they can't.
LOOSEST = (0.001, 1.0)
#: Numbering is done in as many slices as keep a slice of one length under this many rows.
SLICE_ROWS = 500_000


def knapsack(value: np.ndarray, size: np.ndarray, limit: np.ndarray, capacity: int, several: int = 1) -> list[np.ndarray]:
    """How often to take each size (sorted, distinct) for the greatest value within the capacity; unbounded DP, then cut to ``limit``.

    The best filling comes first; up to ``several`` are given, which differ in the size taken last
    and are worth nearly as much.
    """
    least = int(size[0])
    worth = np.full(capacity + 1, -np.inf)  # by size; sizes without items are worth nothing
    worth[size] = value
    back = np.zeros(capacity + 1)  # the best of capacity c lies at capacity - c, so that what is left lies beside the sizes
    took = np.full(capacity + 1, -1, dtype=np.int64)
    total = np.empty(capacity + 1)
    for c in range(least, capacity + 1):
        some = total[: c - least + 1]
        np.add(back[capacity - c + least :], worth[least : c + 1], out=some)
        j = int(some.argmax())
        if some[j] > back[capacity - c + 1]:
            back[capacity - c], took[c] = some[j], j + least
        else:
            back[capacity - c] = back[capacity - c + 1]
    place = np.full(capacity + 1, -1, dtype=np.int64)
    place[size] = np.arange(len(size))
    last = np.argsort(-total[: capacity - least + 1], kind="stable")[:several]
    found = []
    for j in last[total[last] >= 0.97 * total[last[0]]]:
        counts = np.zeros(len(size), dtype=np.int64)
        counts[place[j + least]] = 1
        c = capacity - int(j) - least
        while c > 0:
            if took[c] < 0:
                c -= 1
                continue
            counts[place[took[c]]] += 1
            c -= int(took[c])
        found.append(np.minimum(counts, limit))
    return found


def configuration_lp(size: np.ndarray, need: np.ndarray, capacity: int, rounds: int, several: int = 1) -> list[tuple[np.ndarray, float]]:
    """Fillings (counts by size) and fractional multiplicities that about cover ``need``.

    Multiplicative weights with a first price proportional to the size; a round's filling covers a
    fixed share of the scarcest of its lengths, and the price of a length falls exponentially with
    its cover. Rounds go on, up to four times as many, until each length is covered; at the end all
    are scaled so that together they hold as much as there is.
    """
    log_price = np.log(size / capacity)
    cover = np.zeros(len(size))
    found: dict[bytes, list] = {}
    for made in range(4 * rounds):
        if made >= rounds and cover.min() > 0:
            break
        price = np.exp(log_price - FALL * (cover - cover.min()))
        for filling in knapsack(price, size, need, capacity, several):
            used = filling > 0
            step = STEP * float((need[used] / filling[used]).min())
            found.setdefault(filling.tobytes(), [filling, 0.0])[1] += step
            cover[used] += step * filling[used] / need[used]
    covered = float((cover * need) @ size)
    scale = float(need @ size) / covered if covered else 1.0
    return [(filling, step * scale) for filling, step in found.values()]


def opened(filling: np.ndarray, whole: int, members: list[list[int]], left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """``whole`` containers of a filling of classes as fillings of exact lengths, each class's longest first; ``left`` is lowered."""
    made = []
    while whole > 0:
        exact: dict[int, int] = {}
        for c in np.flatnonzero(filling):
            want = int(filling[c])
            while want:
                while members[c] and not left[members[c][-1]]:
                    members[c].pop()
                if not members[c]:
                    break
                for i in reversed(members[c]):
                    take = int(min(want, left[i]))
                    if take:
                        exact[i] = take
                        want -= take
                    if not want:
                        break
                break
        if not exact:
            break
        times = int(min(whole, *(left[i] // k for i, k in exact.items())))
        made.append((exact, times))
        for i, k in exact.items():
            left[i] -= times * k
        whole -= times
    return made


def plan(size: np.ndarray, need: np.ndarray, capacity: int = CAPACITY, levels: tuple = LEVELS) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings [(index of size, count)...] with whole multiplicities that hold every item exactly once.

    ``size`` is sorted and between 1 and ``capacity``. The LP is solved for each of ``levels``
    and rounded; of these plans, and of best fit alone, the first with the fewest containers is taken.
    """
    size, need = np.asarray(size, dtype=np.int64), np.asarray(need, dtype=np.int64)
    if not len(size):
        return []
    plans = []
    for units, rounds, several in levels:
        unit = max(1, -(-capacity // units))
        large = np.flatnonzero(size > capacity // SMALL)
        classes, home = np.unique(-(-size[large] // unit), return_inverse=True)
        members = [large[home == c].tolist() for c in range(len(classes))]
        wanted = np.bincount(home, weights=need[large]).astype(np.int64)
        solved = configuration_lp(classes, wanted, capacity // unit, rounds, several) if len(large) else []
        plans += [rounded(size, need, capacity, solved, members, loosest) for loosest in LOOSEST]
    return min([*plans, rounded(size, need, capacity)], key=lambda made: sum(times for _, times in made))


def rounded(size: np.ndarray, need: np.ndarray, capacity: int, solved: list[tuple[np.ndarray, float]] = [], members: list[list[int]] = [], loosest: float = 1.0) -> list[tuple[list[tuple[int, int]], int]]:
    """One plan: containers of the LP as ``solved`` for classes of lengths, with their gaps filled, then best fit.

    Containers of the LP never take more than is left; those that stay open by more than
    ``loosest`` of the capacity are emptied again. Best fit takes the largest first and each next
    the largest that fits, and repeats each filling as often as what is left allows. The number of
    fillings is bounded by those of sizes and of rounds.
    """
    left, members = need.copy(), [list(m) for m in members]
    made: list[tuple[list[tuple[int, int]], int]] = []
    chosen: list[tuple[dict[int, int], int]] = []
    carried = 0.0
    for filling, times in sorted(solved, key=lambda x: -x[1]):
        carried += times  # what rounding down leaves of one filling is given to the next
        whole = int(min(np.floor(carried), np.min([sum(left[i] for i in members[c]) // filling[c] for c in np.flatnonzero(filling)])))
        if whole > 0:
            carried -= whole
            chosen += opened(filling, whole, members, left)
        carried = min(carried, 1.0)
    # the fullest first: their small gaps take what fits best; a length too rare for all of a filling's containers divides it
    gaps = sorted(chosen, key=lambda x: sum(size[i] * k for i, k in x[0].items()))
    while gaps:
        exact, times = gaps.pop()
        room = capacity - sum(int(size[i]) * k for i, k in exact.items())
        there = np.flatnonzero(left[: int(np.searchsorted(size, room, side="right"))])
        while len(there):
            at = int(there[-1])
            if left[at] < times:
                gaps.append((dict(exact), times - int(left[at])))
                times = int(left[at])
            take = int(min(room // size[at], left[at] // times))
            exact[at] = exact.get(at, 0) + take
            left[at] -= take * times
            room -= take * int(size[at])
            there = np.flatnonzero(left[: int(np.searchsorted(size, room, side="right"))])
        if room > loosest * capacity:  # what is left open here may be closed with other lengths
            for i, k in exact.items():
                left[i] += k * times
        else:
            made.append((list(exact.items()), times))
    order = [int(i) for i in np.flatnonzero(left)]
    while order:
        filling, room = {}, capacity
        at = len(order)
        while at > 0 and room > 0:
            at = min(at, int(np.searchsorted(size[order], room, side="right")))
            if at == 0:
                break
            i = order[at - 1]
            take = int(min(room // size[i], left[i]))
            filling[i] = take
            room -= take * int(size[i])
            at -= 1
        whole = int(min(left[i] // k for i, k in filling.items()))
        made.append((list(filling.items()), whole))
        for i, k in filling.items():
            left[i] -= whole * k
        order = [i for i in order if left[i] > 0]
    return made


def slots(made: list[tuple[list[tuple[int, int]], int]], size: np.ndarray) -> pd.DataFrame:
    """Runs of places: the ``first``..``last`` items of a length go to containers from ``base`` on, ``each`` a container."""
    rows, base, filled = [], 0, {}
    for filling, whole in made:
        for i, k in filling:
            first = filled.get(i, 0)
            rows.append((int(size[i]), first, first + k * whole - 1, base, k))
            filled[i] = first + k * whole
        base += whole
    return pd.DataFrame(rows, columns=["size", "first", "last", "base", "each"])


def pack(items: DataFrame, keys: list[str], size: str = "size", capacity: int = CAPACITY, levels: tuple = LEVELS) -> DataFrame:
    """Every item's place: keys..., part, offset, length, container.

    An item of at most ``capacity`` is whole: one row with part 0. A larger one is split into full
    containers of its own and a last part, which shares a container as other items do; ``offset``
    and ``length`` say what of the item a part holds. Items without size (null or 0) take no room
    and go to container 0. ``keys`` must tell items apart; extra columns are dropped.
    """
    spark = items.sparkSession
    item = items.select(*keys, F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_size"))
    full = F.floor(F.col("_size") / capacity).cast("int")
    rest = (F.col("_size") % capacity).cast("int")
    # the last part: what is left after the full containers; items that fill containers exactly have none
    last = item.where((rest > 0) & (F.col("_size") > 0)).select(*keys, full.alias("part"), (full.cast("long") * capacity).alias("offset"), rest.alias("length"))
    heads = item.where(full > 0).select(*keys, F.posexplode(F.sequence(F.lit(0), full - 1)).alias("part", "_x")).select(*keys, "part", (F.col("part").cast("long") * capacity).alias("offset"), F.lit(capacity).alias("length"))
    none = item.where(F.col("_size") == 0).select(*keys, F.lit(0).alias("part"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("container"))

    # at most ``capacity`` rows: how many items end in each length, and how many full containers those before it fill
    sizes = item.where(F.col("_size") > 0).groupBy(rest.alias("length")).agg(F.count(F.lit(1)).alias("count"), F.sum(full).alias("full")).toPandas().sort_values("length")
    n_full = int(sizes["full"].sum())
    sizes = sizes[sizes["length"] > 0]
    size_of, need = sizes["length"].to_numpy(np.int64), sizes["count"].to_numpy(np.int64)
    made = plan(size_of, need, capacity, levels)
    n_shared = sum(whole for _, whole in made)
    runs = slots(made, size_of)
    if len(runs) == 0:
        runs = pd.DataFrame([(-1, 0, 0, 0, 1)], columns=["size", "first", "last", "base", "each"])

    def numbered(rows: DataFrame, within: list[str], hottest: int) -> DataFrame:
        """``rows`` with ``_seq``, their number from 0 within the group; hot groups are numbered in slices."""
        n = max(1, -(-hottest // SLICE_ROWS))
        cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*keys, "part"), F.lit(n)).cast("int"))
        own = Window.partitionBy(*within, "_slice").orderBy(*keys, "part")
        cut = cut.withColumn("_seq", F.row_number().over(own).cast("long") - 1)
        if n == 1:
            return cut.drop("_slice")
        before = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.withColumn("_slice", F.pmod(F.xxhash64(*keys, "part"), F.lit(n)).cast("int")).groupBy(*within, "_slice").count()
        starts = starts.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        return cut.join(starts, [*within, "_slice"]).withColumn("_seq", F.col("_seq") + F.col("_start")).drop("_slice", "_start")

    placed = numbered(last, ["length"], int(need.max()) if len(need) else 1)
    # fillings and the lengths in each are bounded by the capacity and the rounds, so broadcast
    table = spark.createDataFrame(runs).select(F.col("size").cast("int").alias("_length"), F.col("first"), F.col("last"), F.col("base"), F.col("each"))
    placed = placed.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_seq") >= F.col("first")) & (F.col("_seq") <= F.col("last")))
    placed = placed.select(*keys, "part", "offset", "length", (F.col("base") + F.floor((F.col("_seq") - F.col("first")) / F.col("each"))).cast("long").alias("container"))
    heads = numbered(heads.withColumn("_all", F.lit(0)), ["_all"], n_full)
    heads = heads.select(*keys, "part", "offset", "length", (F.lit(n_shared).cast("long") + F.col("_seq")).alias("container"))
    return placed.unionByName(heads).unionByName(none)


def document_sizes(documents: DataFrame) -> DataFrame:
    """doc_id and size: the tokens of ``text`` under the byte-level ByT5 tokenizer, i.e. its bytes in UTF-8."""
    return documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, offset, length, container) of every document; null and empty texts take no room in container 0."""
    return pack(document_sizes(documents), ["doc_id"], "size", capacity)


def split_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id) of documents that were split, as packed: those with parts in more than one container."""
    of = pack_documents(documents, capacity).where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    spread_over = of.agg(F.max("part").alias("part"), F.min("container").alias("first"), F.max("container").alias("last"))
    return spread_over.where((F.col("part") > 0) & (F.col("first") < F.col("last"))).select("doc_id")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers used, tokens, the least number of containers any packing needs, and the share filled."""
    used = packed.where(F.col("length") > 0).agg(F.countDistinct("container").alias("containers"), F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    return used.select("parts", "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"))


def placed_whole(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, tokens, whole, fits): what must hold of every document that has a text, as packed.

    ``whole``: its parts follow each other without gap or repetition, each in a container of its
    own, and there are as few as its size allows; ``fits``: none of its containers holds more than the capacity.
    """
    packed = pack_documents(documents, capacity).where(F.col("length") > 0)
    full = packed.groupBy("container").agg((F.sum("length") <= capacity).alias("_fits"))
    of = Window.partitionBy("doc_id").orderBy("part")
    joined = packed.join(full, "container").withColumn("_from", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(of), F.lit(0)))
    told = joined.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.bool_and(F.col("offset") == F.col("_from")).alias("_joined"), F.count(F.lit(1)).alias("_parts"), F.count_distinct("container").alias("_in"), F.bool_and("_fits").alias("fits"))
    whole = F.col("_joined") & (F.col("_parts") == F.col("_in")) & (F.col("_parts") == F.ceil(F.col("tokens") / capacity))
    return told.select("doc_id", "tokens", whole.alias("whole"), "fits")
