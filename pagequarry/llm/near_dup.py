"""Near-duplicate texts by a chosen-path set similarity join.

Texts are sets of word shingles. Sets that are equal form a class, and one representative of a class goes through
the join. A representative has a sketch of `N_COORDINATES` min-wise tokens. In each of several independent random
trees it follows branches (coordinate, token) from the root: every node draws as many coordinates as it has branches,
1 / similarity + `SURPLUS` on the mean, so that two sets of at least that similarity keep more than one common branch
a level on the mean, and a tree's chance of losing them stays bounded however deep it grows. A node with few sets is
compared exhaustively, one with many is branched again. Only where branching cannot help is a larger node compared as
a whole, in blocks, so that no task holds it: where `DENSE` of its sets are near one of two drawn from it (a constant share of
its pairs are then links that have to be found), and at the last level. Comparisons use 128 one-bit tokens; pairs that
could reach the similarity are compared by their whole sketches, and those that still could are verified on the full
shingle sets, exactly. The number of trees follows from the target recall at
the threshold, the spread of a sketch about its similarity included; above the threshold recall is higher.

Shingles stay where the texts are: rows that are shuffled hold a node, an id and 128 bits. Only texts of candidate
pairs are read again for the verification.

Defined results: null texts, texts without words and texts under `min_words` words have no partners (in
`near_duplicate_groups`, given all ids, they are groups of their own); a text of fewer words than a shingle is one
shingle as a whole; repeated rows count once (by id); other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, small_side
from .leakage import WORD
from .site_lines import hot_join

SHINGLE, SIMILARITY, MIN_WORDS = 5, 0.8, 5
N_COORDINATES, LEVELS, NODE_SIZE, BLOCK = 128, 10, 512, 512
SURPLUS, DENSE = 0.5, 0.25
TARGET_RECALL = 0.999
#: Standard deviations of an estimate by which a pair at the threshold may fall short.
SLACK = 4.5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 500_000


def _mix(a: np.ndarray, b) -> np.ndarray:
    h = (a ^ b) * _MIX
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    def __init__(self, size: int, min_words: int):
        self.size, self.min_words, self.known = size, min_words, {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Sorted hashes of the distinct shingles, None for a text of too few words."""
        words = WORD.findall(text.lower()) if text else ()
        if len(words) < max(self.min_words, 1):
            return None
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        size = min(self.size, len(h))
        m = len(h) - size + 1
        out = _mix(h[:m], np.uint64(0))  # or the first two words could change places
        for k in range(1, size):
            out = _mix(out, h[k : k + m] + np.uint64(k))
        return np.unique(out)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, N_COORDINATES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, N_COORDINATES, dtype=np.uint64)


def sketch(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Min-wise tokens of one set, as 16-bit values: unlike tokens seldom agree, and no pair is lost by it."""
    a, b = functions
    low = None
    for k in range(0, len(shingles), 8192):
        part = ((shingles[None, k : k + 8192] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1)
        low = part if low is None else np.minimum(low, part)
    return (_mix(low.astype(np.uint64), np.uint64(3)) >> np.uint64(48)).astype(np.uint16)


def sketches(texts: DataFrame, size: int, min_words: int) -> DataFrame:
    """id, c1, c2 (128-bit class of equal sets), b1, b2 (128 one-bit tokens), coordinates (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, functions = Shingler(size, min_words), _functions()
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                s = shingler(text)
                if s is None:
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                low = sketch(s, functions)
                bits = np.packbits((low & np.uint16(1)).astype(np.uint8)).view(np.int64)
                c = np.frombuffer(digest, np.int64)
                rows.append((i, int(c[0]), int(c[1]), int(bits[0]), int(bits[1]), low.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "c1", "c2", "b1", "b2", "coordinates"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, c1 long, c2 long, b1 long, b2 long, coordinates binary")


def missed(agreement: float, branches: float, levels: int) -> float:
    """Chance that one tree of so many levels parts two sets that agree in a share of their coordinates."""
    least, more = int(branches), branches - int(branches)
    miss = 0.0
    for _ in range(levels):
        lost = 1 - agreement * (1 - miss)  # a branch is not shared, or its subtree parts them
        miss = (1 - more) * lost**least + more * lost ** (least + 1)
    return miss


def n_trees(similarity: float, branches: float, levels: int, target: float) -> int:
    """Trees needed so that a pair at the threshold shares a node at the last level of at least one of them.

    All sets meet the same draws, and trees share coordinates, so the loss of one set of trees spreads about the mean:
    they are counted for half of it, and one is added.
    """
    n = N_COORDINATES
    agreeing = [(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k), missed(k / n, branches, levels)) for k in range(n + 1)]
    trees = 1
    while sum(p * m**trees for p, m in agreeing) > (1 - target) / 2:
        trees += 1
    return trees + 1


def _branch(nodes: np.ndarray, coordinates: np.ndarray, branches: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of each branch taken. A node has one branch more than the whole part of `branches` with the
    chance of the rest, each for another coordinate."""
    draw = _mix(nodes, np.uint64(0x5851F42D4C957F2D))
    count = int(branches) + ((draw >> np.uint64(16)).astype(np.float64) / 2**48 < branches - int(branches))
    first = (_mix(draw, np.uint64(1)) >> np.uint64(32)).astype(np.int64)
    step = (_mix(draw, np.uint64(2)) >> np.uint64(32)).astype(np.int64) | 1  # odd, so that no coordinate comes twice
    rows, children = [], []
    for k in range(int(branches) + 1):
        row = np.flatnonzero(count > k)
        at = (first[row] + k * step[row]) % N_COORDINATES
        rows.append(row)
        children.append(_mix(_mix(nodes[row], at.astype(np.uint64) + np.uint64(1)), coordinates[row, at].astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(children)


def roots(trees: int) -> np.ndarray:
    return _mix(np.arange(1, trees + 1, dtype=np.uint64), _MIX)


def _grow(rows: DataFrame, trees: int, branches: float, at_root: bool) -> DataFrame:
    """node, id, b1, b2 one level down. rows: id, b1, b2, coordinates and, below the root, node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            for start in range(0, len(batch), 2000):
                part = batch.iloc[start : start + 2000]
                coordinates = np.frombuffer(b"".join(part["coordinates"]), np.uint16).reshape(len(part), N_COORDINATES)
                if at_root:
                    pieces = [_branch(np.full(len(part), root, np.uint64), coordinates, branches) for root in roots(trees)]
                    row, node = (np.concatenate(x) for x in zip(*pieces))
                else:
                    row, node = _branch(part["node"].to_numpy().view(np.uint64), coordinates, branches)
                yield pd.DataFrame({"node": node.view(np.int64), "id": part["id"].to_numpy()[row], "b1": part["b1"].to_numpy()[row], "b2": part["b2"].to_numpy()[row]})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"node long, id {kind}, b1 long, b2 long")


def _compare(cells: DataFrame, most: int) -> DataFrame:
    """Pairs (id_a < id_b) within a cell whose one-bit tokens differ in at most `most` places.

    cells: members array<struct<id, b1, b2, side>>, of at most 2 x BLOCK members. Members of different sides are
    compared; side -1 is compared with its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [], []
            for members in batch["members"]:
                ids = [m["id"] for m in members]
                b1, b2 = (np.array([m[b] for m in members], np.int64).view(np.uint64) for b in ("b1", "b2"))
                side = np.array([m["side"] for m in members])
                apart = np.bitwise_count(b1[:, None] ^ b1[None]) + np.bitwise_count(b2[:, None] ^ b2[None])
                near = (apart <= most) & ((side[:, None] != side[None]) | (side[:, None] < 0))
                for a, b in zip(*np.nonzero(np.triu(near, 1))):
                    x, y = ids[a], ids[b]
                    if x != y:
                        left.append(min(x, y))
                        right.append(max(x, y))
            yield pd.DataFrame({"id_a": pd.Series(left, dtype=object), "id_b": pd.Series(right, dtype=object)})

    kind = cells.schema["members"].dataType.elementType["id"].dataType.simpleString()
    return cells.select("members").mapInPandas(run, f"id_a {kind}, id_b {kind}")


def _block_cells(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells of two blocks each for nodes that are still large: every pair of a node's members meets in one cell."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = rows.join(sizes, "node").withColumn("n", blocks).withColumn("own", F.pmod(F.xxhash64("id", "node"), F.col("n")).cast("int"))
    spread = placed.select("node", "id", "b1", "b2", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    cell = spread.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct("id", "b1", "b2", F.when(F.col("own") == F.col("other"), -1).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)).alias("side")).alias("m"))
    return cell.groupBy("node", "i", "j").agg(F.collect_list("m").alias("members"))


def _dense(large: DataFrame, most: int) -> DataFrame:
    """node: those of which at least `DENSE` of the sets are near one of two sets drawn from it."""
    order = F.xxhash64("id", "node")
    drawn = large.groupBy("node").agg(F.min_by(F.struct("b1", "b2"), order).alias("x"), F.max_by(F.struct("b1", "b2"), order).alias("y"))
    apart = [F.bit_count(F.col("b1").bitwiseXOR(F.col(f"{c}.b1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col(f"{c}.b2"))) for c in "xy"]
    near = [F.avg((a <= most).cast("int")) for a in apart]
    return large.join(drawn, "node").groupBy("node").agg(F.greatest(*near).alias("near")).filter(F.col("near") >= DENSE).select("node")


def candidate_pairs(reps: DataFrame, similarity: float, target: float, levels: int = LEVELS) -> DataFrame:
    """id_a, id_b of representatives that may reach the similarity."""
    branches = 1 / similarity + SURPLUS
    trees = n_trees(similarity, branches, levels, target)
    p = (1 - similarity) / 2
    most = int(N_COORDINATES * p + SLACK * math.sqrt(N_COORDINATES * p * (1 - p)))
    member = F.struct("id", "b1", "b2", F.lit(-1).alias("side"))
    found, rows = None, None
    for level in range(1, levels + 1):
        if level == 1:
            rows = materialize(_grow(reps, trees, branches, True), "path-1")
        else:
            there = reps.select("id", "coordinates").join(small_side(large.select("id").distinct()), "id", "left_semi")
            rows = materialize(_grow(large.join(there, "id"), trees, branches, False), f"path-{level}")
        sizes = materialize(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), f"nodes-{level}")
        small = rows.join(sizes.filter(F.col("size") <= NODE_SIZE).select("node"), "node").groupBy("node").agg(F.collect_list(member).alias("members"))
        pairs = _compare(small, most)
        found = pairs if found is None else found.unionByName(pairs)
        over = sizes.filter(F.col("size") > NODE_SIZE)
        if over.isEmpty():
            break
        large = rows.join(over.select("node"), "node")
        whole = over if level == levels else over.join(materialize(_dense(large, most), f"dense-{level}"), "node", "left_semi")
        found = found.unionByName(_compare(_block_cells(rows, whole), most))
        large = large.join(whole.select("node"), "node", "left_anti")
    return _agreeing(materialize(found.distinct(), "near"), reps, similarity)


def _agreeing(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sketches agree in so many coordinates that they could reach the similarity."""
    ids = small_side(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
    sketched = reps.join(ids, "id", "left_semi").select("id", "coordinates")
    least = N_COORDINATES * similarity - SLACK * math.sqrt(N_COORDINATES * similarity * (1 - similarity))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, N_COORDINATES) for c in ("c_a", "c_b"))
            yield batch.loc[(a == b).sum(1) >= least, ["id_a", "id_b"]]

    a, b = (sketched.select(F.col("id").alias(f"id_{x}"), F.col("coordinates").alias(f"c_{x}")) for x in "ab")
    kind = pairs.schema["id_a"].dataType.simpleString()
    return pairs.join(a, "id_a").join(b, "id_b").mapInPandas(compare, f"id_a {kind}, id_b {kind}")


def verified(pairs: DataFrame, texts: DataFrame, size: int, min_words: int, similarity: float) -> DataFrame:
    """id_a, id_b, jaccard: pairs whose full shingle sets reach the similarity."""
    wanted = materialize(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "pair-ids")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size, min_words)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "set": pd.Series([shingler(t).tobytes() for t in batch["text"]], dtype=object)})

    kind = texts.schema["id"].dataType.simpleString()
    sets = texts.join(wanted, "id", "left_semi").mapInPandas(shingles, f"id {kind}, set binary").dropDuplicates(["id"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = np.array([len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(batch["set_a"], batch["set_b"])], np.int64)
            union = np.array([(len(a) + len(b)) // 8 for a, b in zip(batch["set_a"], batch["set_b"])], np.int64) - both
            keep = both >= similarity * union - 1e-9
            yield pd.DataFrame({"id_a": batch["id_a"][keep], "id_b": batch["id_b"][keep], "jaccard": (both / np.maximum(union, 1))[keep]})

    a, b = (sets.select(F.col("id").alias(f"id_{x}"), F.col("set").alias(f"set_{x}")) for x in "ab")
    return pairs.join(a, "id_a").join(b, "id_b").mapInPandas(compare, f"id_a {kind}, id_b {kind}, jaccard double")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id and rep, the smallest id with an equal shingle set; links has id_a < id_b,
    jaccard of representatives. Together they hold every pair once; copies are not expanded."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    all_sketches = materialize(sketches(texts, size, min_words), "sketches")
    # only sets that occur again have a class to look up; a class may be a large share of all rows
    classes = all_sketches.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("c1", "c2", "rep")
    own = all_sketches.select("id", "c1", "c2").distinct()
    members = materialize(hot_join(own, classes, ["c1", "c2"], "id", "left").select("id", F.coalesce("rep", "id").alias("rep")), "members")
    reps = all_sketches.join(members.filter("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"]).select("id", "b1", "b2", "coordinates")
    pairs = materialize(candidate_pairs(materialize(reps, "representatives"), similarity, target), "candidates")
    return members, materialize(verified(pairs, texts, size, min_words, similarity), "links")


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a < id_b of all pairs of texts, copies included, for a result that must list them."""
    classes = members.join(members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep"), "rep", "left_semi")
    same = classes.alias("x").join(classes.alias("y"), F.col("x.rep") == F.col("y.rep")).filter("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    a, b = (members.select(F.col("id").alias(f"m_{x}"), F.col("rep").alias(f"id_{x}")) for x in "ab")
    across = links.join(a, "id_a").join(b, "id_b").select(F.least("m_a", "m_b").alias("id_a"), F.greatest("m_a", "m_b").alias("id_b"))
    return same.unionByName(across)


def near_duplicate_groups(members: DataFrame, links: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, group_id, n_links: connected groups of texts; group_id is the smallest id of the group, n_links the
    number of different texts linked to the row's own. One row per member, groups of one included; given ids (a
    column id), one row per id, those that are no members in groups of their own.

    Labels spread by alternating rounds over written tables: every node takes the smallest label around it, then
    the label of its label, until no label changes.
    """
    edges = materialize(links.select("id_a", "id_b").unionByName(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))), "edges")
    labels = edges.groupBy("id_a").agg(F.min("id_b").alias("m")).select(F.col("id_a").alias("id"), F.least("id_a", "m").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("id_b"), F.col("label").alias("l")), "id_b").groupBy("id_a").agg(F.min("l").alias("l"))
        nearer = materialize(labels.join(around.withColumnRenamed("id_a", "id"), "id").select("id", F.least("label", "l").alias("label"), F.col("label").alias("old")), "nearer")
        # a label that most rows share is looked up once
        beyond = nearer.select(F.col("id").alias("label"), F.col("label").alias("l2")).join(nearer.select("label").distinct(), "label", "left_semi")
        jump = hot_join(nearer, beyond, "label", "id", "left")
        new = materialize(jump.select("id", F.least("label", F.coalesce("l2", "label")).alias("label"), "old"), "labels")
        if new.filter("label <> old").isEmpty():
            break
        labels = new.select("id", "label")
    if ids is not None:
        members = ids.filter("id is not null").select("id").distinct().join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    degree = edges.groupBy("id_a").agg(F.count("*").alias("n_links"))
    known = labels.select(F.col("id").alias("rep"), "label").join(degree.withColumnRenamed("id_a", "rep"), "rep")
    grouped = hot_join(members, known, "rep", "id", "left")
    return grouped.select("id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
