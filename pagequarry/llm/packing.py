"""Filling containers of fixed token capacity with whole documents, by linear grouping.

Sizes are integers up to the capacity, so the corpus enters the plan only as a histogram of at most `capacity`
entries. The plan is made on it alone, whatever the number of documents:

1. lengths above a share of the capacity are large; sorted, they are cut into groups of equal cardinality and
   every length is rounded up to its group's largest, which leaves few different sizes;
2. patterns of these sizes are optimised by column generation: fractional numbers of containers per pattern by
   multiplicative weights, new patterns by a knapsack over the current prices, then rounding down and
   first-fit for the rest;
3. actual lengths take the slots of their group, and small ones are put best-fit into what is left.

The plan says how many containers have which multiset of lengths. Documents get their rank among those of equal
length by counts per hash bucket (no window spans a whole length class), and rank and plan give the container.
A document above the capacity is cut: its full parts take a container each, the rest is packed like a document.

Defined results: null and empty texts have 0 tokens and are not packed; repeated rows are packed once (by id);
the documents' other columns are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, tokenizer_folder

CAPACITY = 1024
#: Share of the capacity from which a length is large, and number of groups.
LARGE_SHARE, N_GROUPS = 1 / 3, 64

#: Split pattern of the byte-pair vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_TOKENIZERS: dict[int, object] = {}


def _shared_tokenizer(shared):
    """One tokenizer per worker process, from the broadcast ranks."""
    key = id(shared.value)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = tokenizer(shared.value)
    return _TOKENIZERS[key]


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str | None = None) -> DataFrame:
    """id, n_tokens of every row; whole texts, 0 for null ones. The driver reads the tokenizer's file; workers get its
    ranks as a broadcast of fixed size."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer_path or f"{tokenizer_folder()}/byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _shared_tokenizer(shared).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_tokens int")


def group_lengths(large: list[tuple[int, int]], n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality, largest lengths first: (rounded-up length, members as (length, count))."""
    total = sum(c for _, c in large)
    per = max(1, -(-total // n_groups))
    groups, room = [], 0
    for length, count in sorted(large, reverse=True):
        while count:
            if not room:
                groups.append((length, []))
                room = per
            take = min(room, count)
            groups[-1][1].append((length, take))
            room, count = room - take, count - take
    return groups


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack: the pattern of greatest total price within the capacity."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            gain = value[room - sizes[fits]] + prices[fits]
            k = int(np.argmax(gain))
            if gain[k] > value[room] + 1e-12:
                value[room], choice[room] = gain[k], fits[k]
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return pattern, float(value[capacity])


def optimise(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 120) -> list[tuple[np.ndarray, int]]:
    """Patterns over few sizes and how often each is used; together they cover the demand.

    Fractional covering by multiplicative price updates: a size whose demand is served falls in price.
    """
    served, weight = np.zeros(len(sizes)), {}
    prices = sizes / capacity
    for _ in range(rounds):
        pattern, _ = best_pattern(sizes, prices, capacity)
        if not pattern.any():
            break
        weight[tuple(pattern)] = weight.get(tuple(pattern), 0) + 1
        share = pattern / np.maximum(demand, 1)
        served += share / share.max()
        prices = (sizes / capacity) * np.exp(-0.25 * (served - served.mean()))
    scale = 1 / max(served.min(), 1e-9)
    used: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    order = sorted(weight, key=lambda p: -float(np.dot(p, sizes)))
    for p in order:
        pattern = np.array(p)
        share = pattern / np.maximum(demand, 1)
        times = int(min(weight[p] / share.max() * scale, min(left[pattern > 0] // pattern[pattern > 0])))
        if times > 0:
            used.append((pattern, times))
            left -= pattern * times
    while left.any():  # the rest: largest first into one pattern, as often as it fits the demand
        pattern, room = np.zeros(len(sizes), int), capacity
        for k in np.argsort(-sizes):
            n = int(min(left[k], room // sizes[k]))
            pattern[k] = n
            room -= n * sizes[k]
        times = int(min(left[pattern > 0] // pattern[pattern > 0]))
        used.append((pattern, times))
        left -= pattern * times
    return used


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, large_share: float = LARGE_SHARE, n_groups: int = N_GROUPS) -> list[tuple[dict[int, int], int]]:
    """(lengths in the container, number of such containers); every length of the histogram is used exactly."""
    large = [(s, c) for s, c in histogram.items() if s > capacity * large_share and c]
    small = {s: c for s, c in histogram.items() if 0 < s <= capacity * large_share and c}
    classes: list[tuple[dict[int, int], int]] = []
    if large:
        groups = group_lengths(large, n_groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for top, members in groups:
            merged.setdefault(top, []).extend(members)
        sizes = np.array(sorted(merged, reverse=True))
        stock = [list(merged[s]) for s in sizes]  # actual lengths, in order, for the slots of each rounded one
        demand = np.array([sum(c for _, c in m) for m in stock])
        for pattern, times in optimise(sizes, demand, capacity):
            while times:  # runs of containers whose slots hold the same actual lengths
                contents: dict[int, int] = {}
                run = times
                picks = []
                for k in np.flatnonzero(pattern):
                    need, j = int(pattern[k]), 0
                    length, have = stock[k][0]
                    if have >= need:
                        picks.append((k, 0, need))
                        run = min(run, have // need)
                        contents[length] = contents.get(length, 0) + need
                    else:
                        run = 1
                        while need:
                            length, have = stock[k][j]
                            take = min(need, have)
                            picks.append((k, j, take))
                            contents[length] = contents.get(length, 0) + take
                            need, j = need - take, j + 1
                for k, j, take in picks:
                    length, have = stock[k][j]
                    stock[k][j] = (length, have - take * run)
                for k in np.flatnonzero(pattern):
                    stock[k] = [x for x in stock[k] if x[1]]
                classes.append((contents, run))
                times -= run
    return _fill(classes, small, capacity)


def _fill(classes: list[tuple[dict[int, int], int]], small: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Small lengths, largest first, each to the fullest containers with room; a class of equal containers at a time."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for contents, times in classes:
        by_room.setdefault(capacity - sum(s * c for s, c in contents.items()), []).append((contents, times))
    rooms = sorted(by_room)
    for size in sorted(small, reverse=True):
        left = small[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                by_room.setdefault(capacity, []).append(({}, -(-left // (capacity // size))))
                rooms = sorted(by_room)
                continue
            room = rooms[k]
            contents, times = by_room[room].pop()
            per = room // size
            fill = min(times, left // per)
            if fill:
                now, after = {**contents, size: contents.get(size, 0) + per}, room - per * size
                left -= fill * per
            else:
                fill, now, after = 1, {**contents, size: contents.get(size, 0) + left}, room - left * size
                left = 0
            if times > fill:
                by_room[room].append((contents, times - fill))
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(after, []).append((now, fill))
            rooms = sorted(by_room)
    return [(c, t) for same in by_room.values() for c, t in same if c]


def slots(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """The plan as runs: documents of n_tokens with rank in [first, first + n) lie per at a time in containers from `container` on."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for contents, times in sorted(plan, key=lambda x: sorted(x[0].items(), reverse=True), reverse=True):
        for size, per in contents.items():
            first = used.get(size, 0)
            rows.append((size, first, per * times, per, container))
            used[size] = first + per * times
        container += times
    return pd.DataFrame(rows, columns=["n_tokens", "first", "n", "per", "container"])


def _running(sums: DataFrame, at: str, value: str, first: int) -> DataFrame:
    """at, start: first and the values of all smaller places. Two levels: places in groups of 1,000, whose sums make one array."""
    grouped = sums.withColumn("group", F.floor(F.col(at) / 1000))
    totals = grouped.groupBy("group").agg(F.sum(value).alias("n")).agg(F.collect_list(F.struct("group", "n")).alias("totals"))
    within = Window.partitionBy("group").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.aggregate(F.filter("totals", lambda t: t["group"] < F.col("group")), F.lit(0).cast("long"), lambda n, t: n + t["n"])
    return grouped.withColumn("within", F.coalesce(F.sum(value).over(within), F.lit(0))).crossJoin(F.broadcast(totals)).select(at, (F.lit(first) + earlier + F.col("within")).alias("start"))


def pack(spark: SparkSession, counted: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 200_000) -> DataFrame:
    """id, part_no, n_tokens, container_id for counted(id, n_tokens). Parts of a cut document are numbered from 0."""
    docs = materialize(counted.filter("n_tokens > 0").dropDuplicates(["id"]), "token-counts")
    buckets = max(16, docs.count() // rows_per_bucket)
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).withColumn("full", F.when(F.col("n_tokens") > capacity, F.floor(F.col("n_tokens") / capacity)).otherwise(0).cast("int"))
    rest = docs.select("id", "bucket", F.col("full").alias("part_no"), F.when(F.col("full") > 0, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens")).alias("n_tokens")).filter("n_tokens > 0")
    counts = rest.groupBy("n_tokens", "bucket").agg(F.count("*").alias("c"))
    histogram = {r["n_tokens"]: r["c"] for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # at most capacity rows
    plan = make_plan(histogram, capacity)
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    within = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("id")) - 1
    ranked = rest.withColumn("within", within).join(offsets, ["n_tokens", "bucket"]).withColumn("rank", F.col("within") + F.col("offset"))
    # the runs of one length, as an array: at most capacity rows
    table = [(int(size), [tuple(map(int, r)) for r in g[["first", "n", "per", "container"]].sort_values("first").itertuples(index=False)]) for size, g in slots(plan).groupby("n_tokens")]
    lookup = spark.createDataFrame(table, "n_tokens int, runs array<struct<first:long,n:long,per:long,container:long>>")
    placed = ranked.join(F.broadcast(lookup), "n_tokens").withColumn("r", F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("rank")), -1))
    packed = placed.select("id", "part_no", "n_tokens", (F.col("r.container") + F.floor((F.col("rank") - F.col("r.first")) / F.col("r.per"))).alias("container_id"))
    # full parts of cut documents come after the planned containers, numbered by sums per bucket in the same way
    cut = docs.filter("full > 0")
    sums = cut.groupBy("bucket").agg(F.sum("full").alias("parts"))
    starts = _running(sums, "bucket", "parts", sum(t for _, t in plan))
    earlier = F.coalesce(F.sum("full").over(Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("earlier", earlier).join(starts, "bucket").select("id", F.posexplode(F.sequence(F.lit(1), F.col("full"))).alias("part_no", "x"), (F.col("start") + F.col("earlier")).alias("start"))
    return packed.unionByName(cut.select("id", "part_no", F.lit(capacity).alias("n_tokens"), (F.col("start") + F.col("part_no")).alias("container_id")))
