"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

A text is its set of five-word shingles (fewer words: one shingle of them all; none: no set and no
links). Texts with equal sets are copies and stand together from then on. Each of ``TREES`` trees sorts the
sets by a signature of ``DEPTH`` MinHashes, so that a prefix of it is a node of a trie. The descent
starts from whole signatures. A member that meets ``f`` others at some depth stops there when the
links it may still lack, those of its ``f`` candidates and one more at the very threshold, are within the target recall;
any other shortens its prefix by one, down to the depth at which a lone pair at the threshold is found with
the target recall. Large families stop early and so tie nothing loosely; lone pairs go all the way.

Members of a node that some member still searches are tied. Connected ties form clusters, inside which
pairs of different sets are verified exactly, block against block, on sparse incidence matrices. In large
clusters each set is compared with a pivot first: Jaccard distance is a metric, so most pairs of a
family of near copies are decided by the two distances and are counted without being compared. Neither
pairs nor a whole large cluster ever meet in one task; what leaves a block pair is a sum of links per member
and a spanning edge.

Every row is a document: repeated rows are copies of each other. Rows with a null doc_id have no class and
no links. Rows of one doc_id with different texts are told apart. A class is named by its least doc_id.
Only doc_id and the text are read of the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import SPACED, binary, gathered, gram_hashes, lean, mixed, partitions, slices, spans, swept, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Trees of the forest, their full depth, and the recall wanted at the threshold.
TREES, DEPTH, RECALL = 20, 10, 0.995
#: Members of a block of a cluster, and shingles of one, at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Rows of large clusters up to which their table may be broadcast.
BROADCAST_CLUSTERS = 50_000
#: Edges of a graph that one task contracts at once (32 MB); a larger graph goes through rounds of joins first.
TASK_EDGES = 2_000_000
#: Bits of a MinHash below the least depth.
_STEP = 16


def found_at(depth: int, trees: int, threshold: float) -> float:
    """Chance that a pair at the threshold shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def depth_for(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The depth down to which a member without candidates shortens its prefix."""
    while depth > 1 and found_at(depth, trees, threshold) < recall:
        depth -= 1
    return depth


def enough(depth: int, trees: int, threshold: float, recall: float) -> float:
    """Candidates with which a member stops at a depth: one more at the threshold may be missed."""
    return (1 - found_at(depth, trees, threshold)) / (1 - recall) - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    start, stop, first = spans(data, offsets, SPACED)
    words = word_hashes(data, start, stop)
    grams = gram_hashes(words, n)
    count = np.diff(first)
    own = np.maximum(count - n + 1, 0)
    row = np.repeat(np.arange(len(count)), own)
    at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[:-1], own)
    hashes = grams[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([gram_hashes(words[first[i] : first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(count) + 1))


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sums(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each run modulo 2**64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
    return total[begin[1:]] - total[begin[:-1]]


SKETCH = "rid long, doc_id long, mark long, s1 long, s2 long, n int, labels array<long>, tails array<long>"


def sketches(docs: DataFrame, text: str, trees: int, depth: int, floor: int) -> DataFrame:
    """Of each row: a number, doc_id, a hash of the text, two of the shingle set, its size, and its
    signature: for each tree a label of the first ``floor`` MinHashes and the ``depth - floor`` after them."""
    if depth - floor > 64 // _STEP:
        raise ValueError(f"at most {64 // _STEP} MinHashes lie below the least depth")
    seeds = _seeds(trees * depth)
    odd, add = (seeds | np.uint64(1)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)

    def signed(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.zeros((2 * trees, len(begin) - 1), np.uint64)
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
            for tree in range(trees):
                for level in range(depth):
                    k = tree * depth + level
                    x = folded * odd[k]
                    x ^= x >> np.uint32(15)
                    x *= np.uint32(0x2C1B3C6D)
                    x += add[k]
                    least = np.minimum.reduceat(x, begin[some])
                    if level < floor:
                        out[tree, some] = mixed(out[tree, some] + least)
                    else:
                        out[trees + tree, some] |= (mixed(least.astype(np.uint64)) & np.uint64((1 << _STEP) - 1)) << np.uint64(_STEP * (level - floor))
        return out

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = binary(batch.column("text"))
            parts = []
            for _, piece, at in slices(data, offsets, 1 << 18):
                hashes, begin = shingles(piece, at)
                parts.append((_sums(mixed(hashes), begin), _sums(mixed(hashes + np.uint64(0x9E37)), begin), np.diff(begin), signed(hashes, begin)))
            s1, s2, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(3))
            whole = np.concatenate([p[3] for p in parts], 1) if parts else np.zeros((2 * trees, 0), np.uint64)
            edges = pa.array(np.arange(0, batch.num_rows * trees + 1, trees, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(part.T).view(np.int64).ravel())) for part in (whole[:trees], whole[trees:])]
            rid = pa.array(np.arange(number, number + batch.num_rows))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([rid, batch.column("doc_id"), batch.column("mark"), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(n, pa.int32()), *lists], names=[f.split()[0] for f in SKETCH.split(", ")])

    body = F.col(text).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(body).alias("mark"), body.alias("text")).mapInArrow(run, SKETCH)


def _contracted(batches):
    """Edges (a, b) of a task with a forest of the same components in their place."""
    held, size = [], 0

    def sent():
        ids, place = np.unique(np.concatenate(held, 1), return_inverse=True)
        root = ids[_roots(len(ids), place.reshape(2, -1))]
        some = root != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
        size += batch.num_rows
        if size >= TASK_EDGES:
            yield sent()
            held, size = [], 0
    if size:
        yield sent()


def _spread(small: DataFrame) -> DataFrame:
    """``small``, whose keys are unique, dealt anew: both sides of a join with it are then plain
    shuffles, of which Spark can split the part that holds a common key."""
    return small.repartition(partitions(small.sparkSession))


def components(edges: DataFrame, most: int = TASK_EDGES, held: bool = False) -> DataFrame:
    """(node, root): the least node of the component of each node of the edges (a, b).

    Tasks contract what they hold (not so few edges that are ``held`` in the checkpoint folder). What is left, the
    forests of all tasks, is contracted by one task once it is ``most`` edges or fewer (``TASK_EDGES`` at most).
    Above that large-star and small-star contraction alternate,
    until so few are left or the edges no longer change. Each round is written to the checkpoint folder,
    and nothing but two sums reaches the driver.
    """
    least = lambda some: some.groupBy("a").agg(F.min("b").alias("m"))
    tied = lambda some: some.where("a <> b").distinct()
    contracted = lambda some: some.mapInArrow(_contracted, "a long, b long")
    now, most, mark = edges.select("a", "b"), min(most, TASK_EDGES), None
    if not held or now.count() > most:
        now = gathered(contracted(now))
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen[0] <= most:
            return gathered(contracted(now.coalesce(1))).toDF("node", "root")
        if mark == tuple(seen):
            return least(now).select(F.col("a").alias("node"), F.col("m").alias("root"))
        mark = tuple(seen)
        low = least(now)
        far = now.join(_spread(low.withColumnRenamed("a", "b")), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = tied(far.unionByName(low.withColumnRenamed("m", "b")))
        low = least(large)
        near = large.join(_spread(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = gathered(tied(near.unionByName(low.withColumnRenamed("m", "b"))))
        del low, far, large, near
        swept(edges.sparkSession)


def candidates(signed: DataFrame, trees: int, depth: int, floor: int, threshold: float, recall: float) -> DataFrame:
    """Ties (a, b) between members (rep, labels, tails) that share a node some member still searches."""
    each = signed.select("rep", F.posexplode(F.arrays_zip("labels", "tails")).alias("tree", "x")).select("rep", "tree", F.col("x.labels").alias("label"), F.col("x.tails").alias("tail"))
    shared = each.groupBy("tree", "label").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    met = gathered(each.join(_spread(shared), ["tree", "label"]))  # whoever is alone at the least depth is alone below it
    prefix = lambda d: F.lit(0).cast("long") if d == floor else F.col("tail").bitwiseAND(F.lit((1 << _STEP * (d - floor)) - 1 if d - floor < 64 // _STEP else -1).cast("long"))
    node = ["tree", "label", "depth", "prefix"]
    levels = met.select("rep", "tree", "label", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("prefix")) for d in range(floor, depth + 1)])).alias("x")).select("rep", "tree", "label", "x.*")
    sizes = levels.groupBy(*node).agg(F.count("*").alias("size")).where("size > 1")
    known, own = levels.join(_spread(sizes), node), Window.partitionBy("rep")  # a member has a row for each tree and depth at most
    found = lambda d: F.coalesce(F.max(F.when(F.col("depth") == d, F.col("size"))).over(own), F.lit(1)) - 1
    stop = F.lit(floor)
    for d in range(floor + 1, depth + 1):
        stop = F.when(found(d) >= enough(d, trees, threshold, recall), F.lit(d)).otherwise(stop)
    searching = gathered(known.select("rep", *node, (F.col("depth") >= stop).alias("live")))
    leads = searching.groupBy(*node).agg(F.min(F.when(F.col("live"), F.col("rep"))).alias("lead")).where("lead is not null")
    return searching.join(_spread(leads), node).where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))


def _grouped(batches, keys: tuple[str, ...]):
    """Runs of equal keys of sorted batches, as lists of tables."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            now = tuple(c[a].item() for c in columns)
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of the left with all of the right."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    if not len(both):
        return out
    places = []
    for values, row in zip((a, b), rows, strict=True):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], row[hit][order]))
    for low in range(0, len(both), 4096):
        high = min(low + 4096, len(both))
        dense = []
        for (at, row), n in zip(places, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(at, [low, high])
            m = np.zeros((n, high - low), np.float32)
            m[row[i:j], at[i:j] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _roots(n: int, edges: np.ndarray) -> np.ndarray:
    """Least member of the component of each of ``n`` members under a matrix of links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, edges[0], root[edges[1]])
        np.minimum.at(low, edges[1], root[edges[0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verified(batches, ninth: tuple[int, int]):
    """For each pair of blocks: the links of each member (weighted by copies) and its root in the block pair."""
    for (_, x, y), table in _grouped(batches, ("cluster", "x", "y")):
        names = table.column("rep").to_numpy()
        order = np.lexsort((names, table.column("block").to_numpy()))
        order = order[np.append(True, names[order][1:] != names[order][:-1])]  # a set found in two rows of its doc_id
        names, block, weight = names[order], table.column("block").to_numpy()[order], table.column("copies").to_numpy()[order]
        column = table.column("shingles").combine_chunks()
        sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in order.tolist()]
        size = np.array([len(s) for s in sets], np.int64)
        cutoff = int(np.searchsorted(block, x, "right"))
        left = np.arange(cutoff)
        right = left if x == y else np.arange(cutoff, len(names))
        if not len(left) or not len(right) or (x == y and len(left) < 2):
            continue
        inter = np.rint(_shared([sets[i] for i in left], [sets[i] for i in right])).astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - inter
        linked = ninth[1] * inter >= ninth[0] * union
        if x == y:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(names), np.int64)
        links[left] += linked @ weight[right]
        if x != y:
            links[right] += weight[left] @ linked
        pair = np.nonzero(linked)
        root = _roots(len(names), np.stack([left[pair[0]], right[pair[1]]])) if len(pair[0]) else np.arange(len(names))
        lead = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(lead, root, names)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some]), pa.array(lead[root][some])], names=["rep", "links", "lead"])


def _with_sets(docs: DataFrame, text: str, rows: DataFrame, then=None, made: str = "") -> DataFrame:
    """``rows`` (first, s1, s2, ...) with the shingles of their sets, read from the texts of ``first``; or what
    ``then`` makes of these batches, of schema ``made``, in the same Python worker."""
    passed = [f for f in rows.schema.fields if f.name not in ("first", "s1", "s2")]

    def run(batches):
        yield from then(found_in(batches)) if then else found_in(batches)

    def found_in(batches):
        for batch in batches:
            get = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            data, offsets = binary(get("text"))
            found, same = [], []
            for row, piece, at in slices(data, offsets):
                hashes, begin = shingles(piece, at)
                found += [hashes[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)]
                sums = _sums(mixed(hashes), begin).view(np.int64), _sums(mixed(hashes + np.uint64(0x9E37)), begin).view(np.int64)
                want = [get(k).to_numpy()[row : row + len(begin) - 1] for k in ("s1", "s2")]
                same.append((sums[0] == want[0]) & (sums[1] == want[1]))
            if found:
                made = pa.RecordBatch.from_arrays([*[get(f.name) for f in passed], pa.array(found, pa.binary())], names=[*[f.name for f in passed], "shingles"])
                yield made.filter(pa.array(np.concatenate(same)))

    texts = docs.select(F.col("doc_id").cast("long").alias("first"), F.col(text).cast("string").alias("text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in passed) + "shingles binary"
    return texts.join(rows, "first").select(*[f.name for f in passed], "s1", "s2", "text").mapInArrow(run, made or schema)


def _rings(batches, step: float):
    """Which ring around its cluster's pivot each set lies in, by Jaccard distance in steps."""
    for batch in batches:
        at = []
        for mine, pivot in zip(batch.column("shingles"), batch.column("pivot"), strict=True):
            mine, pivot = (np.frombuffer(v.as_buffer(), np.uint64) for v in (mine, pivot))
            both = len(np.intersect1d(mine, pivot, assume_unique=True))
            at.append(max(0, math.ceil((1 - both / (len(mine) + len(pivot) - both)) / step + 1e-6) - 1))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(at, pa.int32())], names=["rep", "ring"])


def _blocked(docs: DataFrame, text: str, members: DataFrame, threshold: float, block: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``members`` with ``block``, and ``others``: the blocks of their cluster they are compared with; and
    (rep, links, lead) of links that need no comparison.

    A cluster that fits one block is one. In any other, each set is compared with a pivot first. Jaccard
    distance is a metric, so two sets near the pivot are linked for certain and two at very different
    distances are not, nor are two of very different sizes; only blocks of other sets meet.
    """
    spread = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.max(F.when(F.col("rep") == F.col("cluster"), F.col("n"))).alias("pivot"))
    large = gathered(spread.where((F.col("size") > block) | (F.col("total") > most)).select("cluster", "pivot"))
    (count, held), none = large.agg(F.count("*"), F.sum("pivot")).first(), F.lit(0).cast("long")
    one = members.select("*", none.alias("block"), F.array(none).alias("others"))
    if not count:
        return one, None
    large = large.select("cluster")
    large = F.broadcast(large) if count <= BROADCAST_CLUSTERS else _spread(large)
    inside = gathered(members.join(large, "cluster", "left_semi"))
    pivots = inside.where("rep = cluster").select("first", "s1", "s2", "cluster")
    pivots = _with_sets(docs, text, F.broadcast(pivots) if count <= BROADCAST_CLUSTERS else pivots)
    pivots = gathered(pivots.dropDuplicates(["cluster"]).withColumnRenamed("shingles", "pivot"))
    pivots = _spread(pivots) if held > most else F.broadcast(pivots)
    step = max((1 - threshold) / 4, 1e-6)  # four rings reach as far as a link
    asked = inside.select("first", "s1", "s2", "cluster", "rep").join(pivots, "cluster").drop("cluster")
    rings = _with_sets(docs, text, asked, lambda batches: _rings(batches, step), "rep long, ring int")
    rings = gathered(rings.dropDuplicates(["rep"]))
    scale = math.log(1 / threshold) * 1.0001 if threshold < 1 else 1e-9
    classed = inside.join(rings, "rep").withColumn("class", F.floor(F.log(F.col("n").cast("double")) / scale))
    group = ["cluster", "ring", "class"]
    groups = gathered(classed.groupBy(*group).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / most)).alias("blocks"), F.sum("copies").alias("weight")))
    code = F.shiftleft((F.col("ring2") * 4096 + F.col("class2")).cast("long"), 32)
    beside = groups.select("cluster", F.col("ring").alias("ring2"), F.col("class").alias("class2"), "weight", F.transform(F.sequence(none, F.col("blocks") - 1), lambda k: code + k).alias("codes"))
    certain = F.col("ring") + F.col("ring2") + 2 <= 4
    near = ~certain & (F.abs(F.col("ring") - F.col("ring2")) <= 5) & (F.abs(F.col("class") - F.col("class2")) <= 1)
    met = groups.select(*group, "blocks").join(beside, "cluster").groupBy(*group, "blocks")
    met = met.agg(F.flatten(F.collect_list(F.when(near, F.col("codes")))).alias("others"), F.coalesce(F.sum(F.when(certain, F.col("weight"))), none).alias("sure"))
    met = F.broadcast(met) if count <= BROADCAST_CLUSTERS // 500 else _spread(met)
    placed = classed.join(met, group)
    own = F.shiftleft((F.col("ring") * 4096 + F.col("class")).cast("long"), 32) + F.pmod(F.xxhash64("rep"), F.col("blocks"))
    split = placed.where(F.size("others") > 0).select(*members.columns, own.alias("block"), "others")
    sure = placed.where("ring < 4").select("rep", (F.col("sure") - F.when(F.col("ring") < 2, F.col("copies")).otherwise(0)).alias("links"), F.col("cluster").alias("lead"))
    return one.join(large, "cluster", "left_anti").unionByName(split), sure


def join(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, class_id, n_links, kept, mark of every row.

    ``class_id``: the least doc_id of the rows that links join, directly or in steps; ``n_links``: other
    rows whose sets are similar by ``threshold`` or more, copies among them; ``kept``: one row of each class,
    of its least doc_id (every row without a doc_id is); ``mark``: xxhash64 of the text.
    """
    spark = lean(docs).sparkSession
    floor = max(depth_for(trees, depth, threshold, recall), depth - 64 // _STEP)
    base = gathered(sketches(docs, text, trees, depth, floor))
    named = base.where("doc_id is not null")
    key = ["s1", "s2", "n"]
    reps = gathered(named.where("n > 0").groupBy(*key).agg(F.min("rid").alias("rep"), F.min("doc_id").alias("first"), F.min_by("rid", "doc_id").alias("head"), F.count("*").alias("copies")))
    signed = base.select("rid", "labels", "tails").join(reps.select(F.col("rep").alias("rid"), "rep"), "rid")
    roots = components(candidates(signed, trees, depth, floor, threshold, recall))
    ties = roots.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    members = ties.unionByName(ties.select(F.col("cluster").alias("rep"), "cluster").distinct())
    members = gathered(members.join(reps, "rep").select("cluster", "rep", "n", "copies", "first", "s1", "s2"))

    blocked, sure = _blocked(docs, text, members, threshold, block, block_shingles)
    held = _with_sets(docs, text, blocked.select("first", "s1", "s2", "cluster", "rep", "copies", "block", "others"))
    dealt = held.select("*", F.explode("others").alias("other")).select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "copies", "shingles")
    dealt = dealt.repartition(partitions(spark), "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    part = round(threshold * 1000)
    found = dealt.mapInArrow(lambda batches: _verified(batches, (part, 1000)), "rep long, links long, lead long")
    found = gathered(found if sure is None else found.unionByName(sure))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("rep").alias("a"), F.col("lead").alias("b")), held=True)
    placed = reps.join(final.select(F.col("node").alias("rep"), "root"), "rep", "left").join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min(F.struct("first", "head")).alias("least"))
    placed = placed.join(_spread(least), "root").select(*key, F.col("least.first").alias("class_id"), F.col("least.head").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    judged = named.drop("labels", "tails").join(placed, key, "left")
    kept = F.col("head").isNull() | (F.col("head") == F.col("rid"))
    judged = judged.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), kept.alias("kept"), "mark")
    alone = base.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "mark")
    return judged.unionByName(alone)
