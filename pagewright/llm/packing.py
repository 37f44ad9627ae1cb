"""Problem 8: items of varying size into containers of fixed capacity, by a grouping genetic algorithm.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold the same items again, and puts displaced items back: first in exchange for one or two smaller items of a
bin, where that fills it better, then by best fit. The items are hashed into
sub-problems of bounded size; each runs on several islands (tasks), whose elites migrate between rounds. Bins that
stay badly filled are dissolved and packed again together with those of other sub-problems, level by level, each
level starting from the bins it was given, so it never gets worse.

Only items over the capacity are split: into full pieces, each a container of its own, and a rest. The work is
linear in the number of items, no task holds more than a sub-problem, and no item is left out.

Defined results: items of size 0 (null and empty texts) are placed too, as they fit anywhere; items of exactly the
capacity fill a container; containers of capacity below 1 or null get no rows; repeated rows of containers count
once; an empty table of items gives no rows.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.bpe import DEFAULT_RANKS, encode_documents
from pagewright.plans.session import materialise

SHARD_ITEMS = 1500
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2, 2, 10, 8
#: Generations times items that a small problem may have, and the sizes up to which refill looks at pairs.
ITEM_GENERATIONS, REFILLED_ITEMS, REFILLED_LOOSE = 20_000, 30, 200
WELL_FILLED = 0.99
LEVELS = 3


def best_fit(sizes: list[int], cap: int, items: list[int], bins: list[list[int]], free: list[int]) -> None:
    """Put items, in the order given, each into the bin with the least room that still holds it, else a new one."""
    room = sorted((f, k) for k, f in enumerate(free))
    for i in items:
        s = sizes[i]
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([i])
            free.append(cap - s)
            insort(room, (cap - s, len(bins) - 1))
            continue
        f, k = room.pop(at)
        bins[k].append(i)
        free[k] = f - s
        insort(room, (f - s, k))


def _fitness(free: list[int], cap: int) -> float:
    return sum(((cap - f) / cap) ** 2 for f in free) / max(len(free), 1)


def _decoded(assign: list[int], sizes: list[int], cap: int) -> tuple[list[list[int]], list[int]]:
    by: dict[int, list[int]] = {}
    for i, b in enumerate(assign):
        by.setdefault(b, []).append(i)
    bins = [by[b] for b in sorted(by)]
    return bins, [cap - sum(sizes[i] for i in b) for b in bins]


def _encoded(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def refill(sizes: list[int], bins: list[list[int]], free: list[int], loose: list[int]) -> list[int]:
    """Exchange one or two items of a bin for one or two loose ones that leave less room; returns the items loose then.

    What comes out of a bin is smaller than what goes in, so it is easier to place. Bins of many items have small ones,
    which best fit places well, so only those of up to REFILLED_ITEMS are looked at.
    """
    stock = sorted((sizes[i], i) for i in loose)
    for k, own in enumerate(bins):
        if not stock or not free[k] or len(own) > REFILLED_ITEMS:
            continue
        gain, out, in_ = 0, (), ()
        for r in (1, 2):
            for take in combinations(own, r):
                gone = sum(sizes[i] for i in take)
                room = free[k] + gone
                at = bisect_left(stock, (room + 1,)) - 1
                if at >= 0 and stock[at][0] - gone > gain:
                    gain, out, in_ = stock[at][0] - gone, take, (stock[at],)
                if len(stock) > REFILLED_LOOSE:
                    continue
                low, high = 0, at
                while low < high:
                    both = stock[low][0] + stock[high][0]
                    if both > room:
                        high -= 1
                        continue
                    if both - gone > gain:
                        gain, out, in_ = both - gone, take, (stock[low], stock[high])
                    low += 1
                if gain == free[k]:
                    break
            if gain == free[k]:
                break
        if gain:
            for x in in_:
                stock.pop(bisect_left(stock, x))
            own[:] = [i for i in own if i not in out] + [i for _, i in in_]
            free[k] -= gain
            for i in out:
                insort(stock, (sizes[i], i))
    return [i for _, i in reversed(stock)]


def crossover(a, b, sizes: list[int], cap: int, rnd: random.Random):
    """Inject some of b's best-filled bins into a; bins of a that hold injected items go, their other items come back."""
    bins_a, free_a = a
    bins_b, free_b = b
    order = sorted(range(len(bins_b)), key=lambda k: (free_b[k], rnd.random()))
    top = order[: max(1, len(order) // 2)]
    chosen = rnd.sample(top, max(1, min(len(top), len(order) // 5)))
    injected = {i for k in chosen for i in bins_b[k]}
    bins, free, loose = [bins_b[k][:] for k in chosen], [free_b[k] for k in chosen], []
    for x, f in zip(bins_a, free_a):
        if injected.isdisjoint(x):
            bins.append(x[:])
            free.append(f)
        else:
            loose += [i for i in x if i not in injected]
    best_fit(sizes, cap, refill(sizes, bins, free, loose), bins, free)
    return bins, free


def mutated(s, sizes: list[int], cap: int, rnd: random.Random):
    """Dissolve the least filled bins and a few others, and put their items back."""
    bins, free = [b[:] for b in s[0]], s[1][:]
    order = sorted(range(len(bins)), key=lambda k: -free[k])
    gone = {*order[: max(1, len(order) // 20)], *rnd.sample(order, max(1, len(order) // 25))}
    loose = [i for k in gone for i in bins[k]]
    keep = [k for k in range(len(bins)) if k not in gone]
    bins, free = [bins[k] for k in keep], [free[k] for k in keep]
    rnd.shuffle(loose)
    left = refill(sizes, bins, free, loose)
    left.sort(key=lambda i: -sizes[i] + rnd.randint(0, max(1, cap // 50)))
    best_fit(sizes, cap, left, bins, free)
    return bins, free


def evolve(sizes: list[int], cap: int, seed: int, elites: list[list[int]], generations: int | None = None) -> list[int]:
    """The best assignment (item to bin) found; elites are assignments to start from.

    The search ends at the fewest bins that the sum of sizes allows. A generation's work grows with the items, so small
    problems get more generations.
    """
    n = len(sizes)
    least = max(1, -(-sum(sizes) // cap))
    for e in elites:
        if max(e, default=0) < least:
            return e
    rnd = random.Random(seed)
    pool = [_decoded(e, sizes, cap) for e in elites]
    order = sorted(range(n), key=lambda i: (-sizes[i], i))
    first: tuple[list[list[int]], list[int]] = ([], [])
    best_fit(sizes, cap, order, *first)
    pool.append(first)
    key = lambda s: (len(s[0]), -_fitness(s[1], cap))
    pool.sort(key=key)
    if len(pool[0][0]) > least:
        while len(pool) < POPULATION:
            pool.append(mutated(rnd.choice(pool), sizes, cap, rnd))
        for _ in range(generations or max(GENERATIONS, ITEM_GENERATIONS // n)):
            pool.sort(key=key)
            if len(pool[0][0]) <= least:
                break
            half = pool[: POPULATION // 2]
            young = []
            for mate in half:
                child = crossover(half[rnd.randrange(len(half))], mate, sizes, cap, rnd)
                young.append(mutated(child, sizes, cap, rnd) if rnd.random() < 0.5 else child)
            pool = half + young
        pool.sort(key=key)
    return _encoded(pool[0][0], n)


_STATE = "container_type string, cap long, shard long, sizes array<long>, best array<int>, used array<long>, settled boolean"


def _evolve_rows(df: DataFrame, round_: int) -> DataFrame:
    """df: container_type, cap, shard, island, sizes, elites. used: how full each item's bin is; settled: no fewer bins are possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                kind, cap, shard, island, sizes, elites = (row.column(c)[0].as_py() for c in range(6))
                best = evolve(sizes, cap, hash((shard, island, round_, cap)), [e for e in elites or [] if e])
                load = [0] * (max(best, default=-1) + 1)
                for i, x in enumerate(best):
                    load[x] += sizes[i]
                settled = len(load) <= max(1, -(-sum(sizes) // cap))
                values = (kind, cap, shard, sizes, best, [load[x] for x in best], settled)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)

    return df.select("container_type", "cap", "shard", "island", "sizes", "elites").mapInArrow(run, _STATE)


_ARROW = pa.schema([
    ("container_type", pa.string()), ("cap", pa.int64()), ("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("best", pa.list_(pa.int32())),
    ("used", pa.list_(pa.int64())), ("settled", pa.bool_()),
])


def _packed_level(items: DataFrame, level: int) -> DataFrame:
    """items: container_type, cap, shard, doc_id, piece_no, tok_start, size, prior (bin it comes from, or null).

    Returns container_type, cap, container_id, doc_id, piece_no, tok_start, size, used. Only sizes and assignments go
    through the search; what the items are stays in the table of sub-problems. Sub-problems that an island settled in
    one round have no other.
    """
    item = F.struct("doc_id", "piece_no", "tok_start", "size", "prior")
    problems = materialise(items.groupBy("container_type", "cap", "shard").agg(F.sort_array(F.collect_list(item)).alias("x")))
    prior = F.expr("transform(x, i -> cast(array_position(array_distinct(x.prior), i.prior) - 1 as int))")
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    key = ["container_type", "cap", "shard"]
    state = problems.select(*key, F.col("x.size").alias("sizes"), F.array(prior if level else F.array().cast("array<int>")).alias("elites"))
    ready = None
    for round_ in range(ROUNDS):
        done = _evolve_rows(state.select("*", islands).repartition(*key, "island"), round_)
        # What the islands of a sub-problem found meets here: a few short arrays per sub-problem.
        met = done.groupBy(*key).agg(
            F.first("sizes").alias("sizes"), F.min_by(F.struct("best", "used"), F.array_max("best")).alias("top"),
            F.collect_list("best").alias("elites"), F.bool_or("settled").alias("settled"),
        )
        met = materialise(met)
        last = round_ == ROUNDS - 1 or met.where("not settled").isEmpty()
        best = (met if last else met.where("settled")).select(*key, "top")
        ready = best if ready is None else ready.unionByName(best)
        if last:
            break
        state = met.where("not settled").select(*key, "sizes", "elites")
    zipped = F.explode(F.arrays_zip(F.col("top.best").alias("bin"), F.col("top.used").alias("used"), F.col("x").alias("x"))).alias("z")
    return problems.join(ready, key).select(*key, zipped).select(
        "container_type", "cap",
        F.concat_ws("-", "container_type", F.lit(level).cast("string"), F.col("shard").cast("string"), F.col("z.bin").cast("string")).alias("container_id"),
        "z.x.doc_id", "z.x.piece_no", "z.x.tok_start", "z.x.size", "z.used",
    )


def packed(documents: DataFrame, containers: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(container_type, container_id, doc_id, piece_no, tok_start, n_tokens): where every document is, per type."""
    sizes = encode_documents(documents, ranks_path=ranks_path, what="count")
    kinds = (
        containers.where("capacity_tokens >= 1 and container_type is not null")
        .groupBy("container_type")
        .agg(F.max("capacity_tokens").cast("long").alias("cap"))
    )
    # Each item is packed once per type: one row with the array of all types, as small as their table, joins every item.
    types = kinds.agg(F.sort_array(F.collect_list(F.struct("container_type", "cap"))).alias("types"))
    each = materialise(
        sizes.join(F.broadcast(types)).select("doc_id", F.col("n_tokens").alias("n"), F.explode("types").alias("t")).select("doc_id", "n", "t.container_type", "t.cap")
    )
    over = F.col("n") > F.col("cap")
    full = (
        each.where(over)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.col("cap")) - 1)).alias("piece_no"))
        .select(
            "container_type",
            F.concat_ws("-", "container_type", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"),
            "doc_id", "piece_no", (F.col("piece_no") * F.col("cap")).alias("tok_start"), F.col("cap").alias("n_tokens"),
        )
    )
    rest = F.when(over, F.col("n") % F.col("cap")).otherwise(F.col("n"))
    piece = F.when(over, F.floor(F.col("n") / F.col("cap"))).otherwise(0).cast("long")
    shards = lambda n: max(1, -(-n // SHARD_ITEMS))
    most = lambda df: df.groupBy("container_type").count().agg(F.max("count")).first()[0] or 0
    n = shards(most(each))
    items = each.where(~over | (rest > 0)).select(
        "container_type", "cap", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("shard"), "doc_id", piece.alias("piece_no"),
        (piece * F.col("cap")).alias("tok_start"), rest.alias("size"), F.lit(None).cast("string").alias("prior"),
    )
    out = full
    for level in range(LEVELS):
        got = materialise(_packed_level(items, level))
        good = F.col("used") >= F.col("cap") * WELL_FILLED
        last = n == 1 or level == LEVELS - 1
        out = out.unionByName(
            (got if last else got.where(good)).select(
                "container_type", "container_id", "doc_id", "piece_no", "tok_start", F.col("size").alias("n_tokens")
            )
        )
        if last:
            break
        poor = got.where(~good)
        left = most(poor)
        if not left:
            break
        n = min(shards(left), max(1, n // 2))
        # Whole bins move, so the bins of the level before are a valid start of the next.
        items = poor.select(
            "container_type", "cap", F.pmod(F.xxhash64("container_id"), F.lit(n)).alias("shard"), "doc_id", "piece_no",
            "tok_start", "size", F.col("container_id").alias("prior"),
        )
    return out


def filling(packing: DataFrame, containers: DataFrame) -> DataFrame:
    """Per type: containers used, tokens, share of the capacity that is used, and the fewest containers possible."""
    cap = containers.groupBy("container_type").agg(F.max("capacity_tokens").alias("cap"))
    total = packing.groupBy("container_type").agg(
        F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    )
    return total.join(F.broadcast(cap), "container_type").select(
        "container_type", "n_containers", "n_tokens",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("cap"))).alias("filled"),
        F.ceil(F.col("n_tokens") / F.col("cap")).alias("least_containers"),
    )
