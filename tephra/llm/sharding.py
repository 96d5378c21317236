"""Sharding by balanced label propagation.

Documents are linked through a hub (here: equal texts; any column that names a
group will do), which stands for all pairs of the group without making them. Per
hub and shard only a count is kept. Every round each hub finds the shard where
most of its documents are, in odd rounds the one with free places, by a join of the counts with
themselves, and the others ask to move there. Capacity quotas decide how many may: as many as move
the other way, and as many as the free places of the target allow. Then the hubs that are
strongest in a full shard send smaller blocks, each whole, on to where there is room, and as many of their own
documents take the places; so a hub larger than a shard fills one after the other. Documents
without links fill the remaining places, so the counts of any two shards differ
by one at most (law `rows`). No round leaves fewer pairs together.

Hot hubs: rows meet the layout of their hub by met(), which never deals a hot hub to
one task, and are numbered in runs.

Defined results: null texts form one group, apart from empty texts; repeated rows
are documents of their own; of equally full shards a hub's hash picks one; slots follow a
hash of doc_id and text, then doc_id, then the row's place; long texts are only hashed and measured; an
empty table gives an empty result; other columns, of whatever names, are passed on
by sharded_documents alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, keyed, met, running, unmet


def text_hub(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def quotas(flow: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many moves from shard s to shard t are granted: swaps first, then free places in proportion."""
    swaps = {(s, t): min(n, flow.get((t, s), 0)) for (s, t), n in flow.items()}
    asked = [sum(n - swaps[x] for x, n in flow.items() if x[1] == t) for t in range(len(free))]
    return {x: swaps[x] + (n - swaps[x] if asked[x[1]] <= free[x[1]] else (n - swaps[x]) * max(0, free[x[1]]) // asked[x[1]]) for x, n in flow.items()}


def lanes_of(sources: dict[int, int], room: dict[int, int]) -> list[tuple[int, int, int]]:
    """(start, end, shard): stretches of evicted rows that shards take, the most first; what a guest leaves behind is room too."""
    out, end = [], 0
    for size, s in sorted(((n + sources.get(s, 0), s) for s, n in room.items()), reverse=True):
        out.append((end, end + size, s))
        end += size
    return out


def drawn(sources: dict[int, int], evicted: dict[int, int], room: dict[int, int]) -> dict[int, int]:
    """How many rows of a guest come from each shard: as many as were evicted, from the fewest first, and at least what a shard took beyond its room."""
    out = {s: max(0, evicted.get(s, 0) - room.get(s, 0)) for s in sources}
    rest = sum(evicted.values()) - sum(out.values())
    for n, s in sorted((n, s) for s, n in sources.items()):
        more = min(n - out[s], rest)
        out[s], rest = out[s] + more, rest - more
    return out


def _loads(state: DataFrame, p: int) -> tuple[list[int], list[int]]:
    """Rows and the size of the smallest block of each shard."""
    found = {r.shard: r for r in state.groupBy("shard").agg(F.sum("n").alias("n"), F.min("n").alias("least")).collect()}  # one row per shard
    return [found[s].n if s in found else 0 for s in range(p)], [found[s].least if s in found else 1 << 62 for s in range(p)]


def _changed(state: DataFrame, change: DataFrame) -> DataFrame:
    after = cut(state.union(change).groupBy("hub", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "state")
    discard(state)
    return after


_FULLEST = "struct(n, xxhash64(hub, shard) AS h, shard)"


def pulled(state: DataFrame, capacity: list[int], k: int) -> DataFrame | None:
    """Rows move to their hub's fullest shard, or in odd rounds to the fullest with free places, by swaps and into free places; None: nothing moves."""
    p, (load, _) = len(capacity), _loads(state, len(capacity))
    free = [c - n for c, n in zip(capacity, load, strict=True)]
    ranked = state.withColumn("x", F.expr(_FULLEST))
    open_ = F.col("shard").isin([s for s in range(p) if free[s] > 0])
    target = F.coalesce(F.max(F.when(open_, F.col("x"))), F.max("x")) if k % 2 else F.max("x")
    asks = ranked.join(ranked.groupBy("hub").agg(target.alias("y")), "hub").filter("x < y").withColumn("to", F.col("y.shard"))
    asks = cut(asks.select("hub", "shard", "to", "n", (F.col("shard") * p + F.col("to")).alias("lane"), F.xxhash64("hub", F.lit(k)).alias("order")), "asks")
    lanes = asks.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).collect()  # one row per pair of shards at most
    grant = quotas({(r.shard, r.to): r.n for r in lanes}, free)
    if not any(grant.values()):
        return None
    by_lane = lambda d: F.create_map(*[F.lit(x).cast("long") for (s, t), v in d.items() for x in (s * p + t, v)])[F.col("lane").cast("long")]
    asks = asks.withColumns({"granted": by_lane(grant), "asks": by_lane({(r.shard, r.to): r.c for r in lanes})})
    moved = running(asks, "lane", "asks", ["order", "hub"], "before", F.col("n")).withColumn("n", F.least(F.col("n"), F.greatest(F.lit(0), F.col("granted") - F.col("before")))).filter("n > 0")
    return _changed(state, moved.select("hub", "shard", (-F.col("n")).alias("n")).union(moved.select("hub", "to", "n")))


def made_way(state: DataFrame, capacity: list[int], k: int) -> DataFrame | None:
    """Smaller blocks leave full shards for the hubs that are strongest there; None: nothing moves.

    A block, the rows of one hub in one shard, moves as a whole, so no pair is lost. As many rows of the
    guest as leave come in. A few guests have their turn in a round, the strongest first; none whose blocks another one would evict."""
    p, (load, least) = len(capacity), _loads(state, len(capacity))
    ranked = state.withColumn("x", F.expr(_FULLEST)).withColumn("weakest", F.get(F.array(*[F.lit(n).cast("long") for n in least]), F.col("shard")))
    wish = ranked.groupBy("hub").agg(F.max(F.when(F.col("n") > F.col("weakest"), F.col("x"))).alias("y"), F.min("x").alias("last")).filter("y > last")
    asked = wish.groupBy("y.shard").agg(F.max(F.struct(F.col("y.n").alias("n"), F.xxhash64("hub", F.lit(k)).alias("h"), "hub")).alias("z")).collect()  # one row per shard at most
    wishes = sorted(((r.z.n, r.z.h, r.shard, r.z.hub) for r in asked), reverse=True)
    blocks: dict = {}
    for r in ranked.filter(F.col("hub").isin([w[3] for w in wishes])).select("hub", "shard", "n", F.col("x.h").alias("h")).collect():  # a row for each of those hubs and shards at most
        blocks.setdefault(r.hub, []).append((r.n, r.h, r.shard))
    guests: dict[int, tuple[int, str]] = {}
    for n, _, t, hub in wishes:
        if len(guests) < max(1, p // 4) and not any(s in guests for _, _, s in blocks[hub] if s != t):
            guests[t] = (n, hub)
    if not guests:
        return None
    room = {s: (capacity[s] - load[s]) // len(guests) for s in range(p) if s not in guests}
    sources = {t: {s: m for m, h, s in blocks[hub] if s != t and s not in guests and (m, h, s) < max(x for x in blocks[hub] if x[2] == t)} for t, (n, hub) in guests.items()}
    lanes = [(t, a, z, s) for t in guests for a, z, s in lanes_of(sources[t], room)]
    if not lanes:
        return None
    spark, strength = state.sparkSession, F.create_map(*[F.lit(x).cast("long") for t, (n, _) in guests.items() for x in (t, n)])
    needed = F.create_map(*[F.lit(x).cast("long") for t in guests for x in (t, sum(sources[t].values()))])
    weak = cut(state.filter(~F.col("hub").isin([hub for _, hub in guests.values()]) & (F.col("n") < strength[F.col("shard").cast("long")])).withColumn("order", F.xxhash64("hub", F.lit(k))), "weak")
    counts = weak.groupBy("shard").agg(F.count(F.lit(1)).alias("of"))
    at = running(weak.join(F.broadcast(counts), "shard"), "shard", "of", ["order", "hub"], "at", F.col("n"))  # a row per shard
    stretches = spark.createDataFrame(lanes, "shard int, start long, end long, to int")
    left = cut(at.filter(F.col("at") + F.col("n") <= needed[F.col("shard").cast("long")]).join(F.broadcast(stretches), "shard").filter("at >= start AND at + n <= end").select("hub", "shard", "to", "n"), "left")
    gone: dict[int, dict[int, int]] = {}
    for r in left.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # one row per pair of shards at most
        gone.setdefault(r.shard, {})[r.to] = r.n
    moves = [(hub, s, -n) for t, (_, hub) in guests.items() for s, n in drawn(sources[t], gone.get(t, {}), room).items() if n]
    moves += [(guests[t][1], t, sum(e.values())) for t, e in gone.items()]
    if not moves:
        return None
    change = left.select("hub", "shard", (-F.col("n")).alias("n")).union(left.select("hub", "to", "n"))
    return _changed(state, change.union(spark.createDataFrame(moves, "hub string, shard int, n long")))


def propagate(hubs: DataFrame, n_linked: int, capacity: list[int], rounds: int) -> DataFrame:
    """(hub, shard, n) from hubs(hub, n): even at first, then moved together; pairs in one shard never get fewer."""
    p = len(capacity)
    n_hubs = hubs.count()
    placed = running(hubs.withColumns({"all": F.lit(0), "hubs": F.lit(n_hubs), "order": F.xxhash64("hub")}), "all", "hubs", ["order", "hub"], "at", F.col("n"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(p)).cast("int") - 1))
    state = placed.select("hub", "at", "n", i.alias("i")).select("hub", F.pmod(F.col("at") + F.col("i"), F.lit(p)).cast("int").alias("shard"), F.floor((F.col("n") - F.col("i") + p - 1) / p).cast("long").alias("n"))
    state, still = cut(state, "state"), 0
    for k in range(rounds):
        moved = False
        for step in (pulled, made_way):
            if (after := step(state, capacity, k)) is not None:
                state, moved = after, True
        still = 0 if moved else still + 1
        if still == 2:  # neither an even nor an odd round moves anything
            break
    return state


def shard(docs: DataFrame, hub: Callable[[Column], Column] = text_hub, n_shards: int = 16, rounds: int = 8, keep_row: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, hub, shard, slot; with keep_row also the
    input row. hub names the group of a text; any function of the text will do."""
    whole = keyed(docs, "rows")
    text = F.coalesce("row.text", F.lit(""))
    rows = cut(whole.select("uid", F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), hub(F.col("row.text")).alias("hub")), "shard")
    slim, order = rows.withColumn("order", F.xxhash64("doc_id", "hub")), ["order", "doc_id", "uid"]
    hubs = cut(slim.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "hubs")
    total, linked = slim.count(), hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    state = propagate(hubs, linked, capacity, rounds)
    load = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row per shard

    upto = lambda a: F.transform(a, lambda x, i: F.struct(x["shard"].alias("shard"), F.aggregate(F.slice(a, 1, i + 1), F.lit(0).cast("long"), lambda z, y: z + y["n"]).alias("end")))
    layout = state.groupBy("hub").agg(F.sum("n").alias("of"), F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("a")).select("hub", "of", upto(F.col("a")).alias("ends"))
    layout = cut(layout, "layout")
    where = lambda ends: F.get(F.filter(ends, lambda e: F.col("at") < e["end"]), F.lit(0))["shard"]
    tied = running(met(slim, layout, "hub", "of"), "hub", "of", order, "at").withColumn("shard", where(F.col("ends")))
    room, end = [], 0
    for s, c in enumerate(capacity):
        end += c - load.get(s, 0)
        room.append(F.struct(F.lit(s).alias("shard"), F.lit(end).cast("long").alias("end")))
    free = unmet(slim, hubs, "hub", "n").withColumns({"all": F.lit(0), "of": F.lit(total - linked)})
    free = running(free, "all", "of", order, "at").withColumn("shard", where(F.array(*room)))
    names = ["uid", "doc_id", "size", "text_crc32", "hub", "order", "shard"]
    dealt = cut(tied.select(names).union(free.select(names)), "dealt").withColumn("of", F.get(F.array(*map(F.lit, capacity)), F.col("shard")))
    out = running(dealt, "shard", "of", order, "slot").select("uid", "doc_id", "size", "text_crc32", "hub", "shard", "slot")
    return out.join(whole, "uid").drop("uid") if keep_row else out.drop("uid")


def sharded_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The rows of docs with their shard and slot; input columns of these names are replaced."""
    found = shard(docs, n_shards=n_shards, keep_row=True)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")], "shard", "slot")
