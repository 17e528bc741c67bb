"""N-gram Jaccard join: every link of two shingle sets at a similarity or more, as components.

1. Each distinct shingle of the corpus is counted, by hash. A document can only link if shingles that others have too are
   a share ``similarity`` of its set, and a partner must share one of its rarest shingles (prefix filter, rarest first).
2. Sets that share one of those are candidates; their connected groups hold all links.
3. Inside a group a signature tree (nodes with OR- and AND-combined token bitmaps and size ranges) is traversed against
   itself: node pairs whose greatest possible overlap is too small, or whose members are all linked already, are
   pruned; what is left is compared exactly. Groups beyond one leaf are dealt as pairs of leaves.
Equal sets are one class throughout, so copies cost one member. No caps: every step covers all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .anchors import keyed
from .common import small
from .components import components
from .tokens import LOWER, Sums, find_words, joined, mix, shard_ids, shards, word_codes

#: Unless a contract says otherwise: words of a shingle and the least similarity of a link, as a fraction.
WORDS, SIMILARITY = 5, (80, 100)
#: Sets in one leaf task, in a tree node; bits of a signature.
LEAF, NODE, BITS = 512, 16, 2048
ABSENT = -(2**63)


def least_overlap(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Shingles that a set of size n shares with any set it links to, at least."""
    return -(-n * similarity[0] // similarity[1])


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text in order of hash, and the number of each text."""
    data, _, end = joined(texts)
    data = LOWER[data]
    start, stop, upto = find_words(data, end)
    codes = word_codes(data, start, stop)
    begin = np.concatenate(([0], upto[:-1])).astype(np.int64)
    count = upto - begin
    sums = Sums(codes)
    n = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    low = begin[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(count, words)[owner]
    gram = sums.of(low, low + size) ^ mix(size.astype(np.uint64))
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])))[: len(gram)]
    return gram[new], np.bincount(owner[new], minlength=len(texts))


def set_class(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number of each set that equal sets share."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams))))
    end = np.cumsum(n)
    return mix((total[end] - total[end - n]) ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


DEALT = "bucket int, shard long, grams binary, owners binary, meta binary"


def _deal(words: int, buckets: int):
    """Each shard's shingles by hash bucket; with bucket 0 go its documents (row, doc, class, n). Equal sets of a shard send one."""

    def run(batches):
        for shard, (rows, texts) in zip(shard_ids(), shards(batches)):  # noqa: B905
            grams, n = shingle_sets(texts, words)
            kind = set_class(grams, n)
            row, doc = rows["row"].to_numpy(), rows["doc"].to_numpy()
            first = np.zeros(len(row), bool)
            first[np.unique(kind, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(row)), n)
            keep = first[owner]
            grams, owner = grams[keep], owner[keep].astype(np.uint32)
            bucket = (grams >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            grams, owner = grams[order], owner[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            meta = np.stack((row, doc, kind, n.astype(np.int64))).tobytes()
            some = [b for b in range(buckets) if cut[b] < cut[b + 1] or b == 0]
            cols = [pa.array(some, pa.int32()), pa.array([shard] * len(some)), pa.array([grams[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())]
            cols += [pa.array([owner[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()), pa.array([meta if b == 0 else b"" for b in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "shard", "grams", "owners", "meta"])

    return run


COUNTED = "shard long, grams binary, owners binary, counts binary, meta binary"


def _count(batches):
    """Within one partition: how often each shingle occurs; those that occur once are dropped."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    size = [len(x) // 8 for x in t["grams"].to_pylist()]
    grams = np.frombuffer(b"".join(t["grams"].to_pylist()), np.uint64)
    owner = np.frombuffer(b"".join(t["owners"].to_pylist()), np.uint32)
    order = np.argsort(grams)
    sort = grams[order]
    head = np.concatenate(([True], sort[1:] != sort[:-1]))[: len(sort)]
    at = np.flatnonzero(head)
    times = np.empty(len(grams), np.uint32)
    times[order] = np.repeat(np.diff(np.append(at, len(sort))), np.diff(np.append(at, len(sort))))
    end = np.cumsum(size)
    for i, (s, meta) in enumerate(zip(t["shard"].to_pylist(), t["meta"].to_pylist(), strict=True)):
        part = slice(end[i] - size[i], end[i])
        more = times[part] > 1
        if meta or more.any():
            cols = [pa.array([s]), *(pa.array([x[part][more].tobytes()], pa.binary()) for x in (grams, owner, times)), pa.array([meta], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "grams", "owners", "counts", "meta"])


MEMBERS = "row long, doc long, class long, n long, prefix array<long>"


def _prefixes(similarity: tuple[int, int]):
    """Whole shards again: each document, with the shared shingles among its rarest if enough of its set is shared."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        parts: dict[int, list[int]] = {}
        for i, s in enumerate(t["shard"].to_pylist()):
            parts.setdefault(s, []).append(i)
        g, o, c, m = (t[x].to_pylist() for x in ("grams", "owners", "counts", "meta"))
        for rows in parts.values():
            row, doc, kind, n = np.frombuffer(b"".join(m[i] for i in rows), np.int64).reshape(4, -1)
            grams = np.frombuffer(b"".join(g[i] for i in rows), np.int64)
            owner = np.frombuffer(b"".join(o[i] for i in rows), np.uint32).astype(np.int64)
            times = np.frombuffer(b"".join(c[i] for i in rows), np.uint32)
            shared = np.bincount(owner, minlength=len(row))
            need = least_overlap(n, similarity)
            length = np.where((shared >= need) & (n > 0), n - need + 1 - (n - shared), 0)
            order = np.lexsort((grams, times, owner))
            grams, owner = grams[order], owner[order]
            place = np.arange(len(grams)) - (np.cumsum(shared) - shared)[owner]
            keep = place < length[owner]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(row))))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(doc), pa.array(kind), pa.array(n), prefix], ["row", "doc", "class", "n", "prefix"])

    return run


def _sets(words: int):
    def run(batches):
        for rows, texts in shards(batches):
            grams, n = shingle_sets(texts, words)
            end = np.cumsum(n)
            body = [grams[b - k : b].tobytes() for b, k in zip(end.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows["cluster"].combine_chunks(), rows["class"].combine_chunks(), pa.array(n.astype(np.int64)), pa.array(body, pa.binary())], ["cluster", "class", "n", "grams"])

    return run


class Tree:
    """Sets in order of size, with bitmaps combined upwards: ``levels[0]`` has the sets, each next level nodes of NODE below."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        self.sizes, self.sets = sizes, sets
        bits = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(sets):
            bits[i, (s % np.uint64(BITS)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        self.any, self.all, self.low, self.high = [packed], [packed], [sizes], [sizes]
        while len(self.low[-1]) > 1:
            at = np.arange(0, len(self.low[-1]), NODE)
            self.any.append(np.bitwise_or.reduceat(self.any[-1], at))
            self.all.append(np.bitwise_and.reduceat(self.all[-1], at))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
        """Whether members of nodes ``a`` and ``b`` could link: their sizes and the most that they can have in common allow it.

        Every member of a has at least the bits in ``all[a]``, members of b only bits in ``any[b]``: bits of the
        one outside the other are shingles that they don't share.
        """
        p, q = similarity
        lost_a = np.bitwise_count(self.all[level][a] & ~self.any[level][b]).sum(1).astype(np.int64)
        lost_b = np.bitwise_count(self.all[level][b] & ~self.any[level][a]).sum(1).astype(np.int64)
        most = np.minimum(self.high[level][a] - lost_a, self.high[level][b] - lost_b)
        union = np.maximum(self.low[level][a], self.low[level][b])  # at least; with the overlap, sizes minus overlap
        union = np.maximum(union, self.low[level][a] + self.low[level][b] - most)
        return q * most >= p * union


def links(sizes: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int], wanted: np.ndarray | None = None, joined_to: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs whose links connect what is connected among the sets (given in order of size).

    ``wanted`` marks sets of which one must be in a compared pair; ``joined_to`` gives components known before.
    """
    tree = Tree(sizes, sets)
    parent = np.arange(len(sets)) if joined_to is None else joined_to.copy()
    found: list[tuple[int, int]] = []
    p, q = similarity
    top = len(tree.low) - 1
    work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        level, a, b = work.pop()
        ok = tree.possible(level, a, b, similarity)
        a, b = a[ok], b[ok]
        if level == 0:
            off = (a < b) & (parent[a] != parent[b])
            if wanted is not None:
                off &= wanted[a] | wanted[b]
            for i, j in zip(a[off].tolist(), b[off].tolist(), strict=True):
                if parent[i] == parent[j]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if q * common >= p * (int(sizes[i]) + int(sizes[j]) - common):
                    found.append((i, j))
                    old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                    parent[parent == old] = new
            continue
        below = len(tree.low[level - 1])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x = np.arange(i * NODE, min((i + 1) * NODE, below))
            y = x if i == j else np.arange(j * NODE, min((j + 1) * NODE, below))
            span = NODE ** (level - 1)
            left, right = slice(x[0] * span, (x[-1] + 1) * span), slice(y[0] * span, (y[-1] + 1) * span)
            if len(np.unique(np.concatenate((parent[left], parent[right])))) == 1:
                continue  # all linked already
            xx, yy = (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
            if i == j:
                xx, yy = xx[xx <= yy], yy[xx <= yy]
            work.append((level - 1, xx, yy))
    return found


def _leaf(similarity: tuple[int, int]):
    """The links inside one leaf task, and for each member whether all of the task is one component."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["class"].to_numpy(), table["n"].to_numpy()))
        t = table.take(pa.array(order))
        name, sizes, fresh = t["class"].to_numpy(), t["n"].to_numpy(), t["wanted"].to_numpy(zero_copy_only=False)
        known = np.unique(t["part"].to_numpy(), return_inverse=True)[1]
        first = np.full(known.max() + 1, len(known))
        np.minimum.at(first, known, np.arange(len(known)))
        sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
        pairs = links(sizes, sets, similarity, fresh, first[known])
        u, v = ([name[p[k]] for p in pairs] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def verified_links(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(u, v): links between classes that connect all that is linked, from (cluster, class, n, grams) of whole clusters.

    A cluster is cut into leaves of one size level and about LEAF sets. First each leaf is joined in itself, with
    the cluster's pivot (its least class) as a guest, so that the mass of a large group of near copies is connected in linear
    work. Then pairs of leaves on equal and neighbouring levels are joined, but only where a leaf has
    members outside the pivot's component, and only pairs with such a member.
    """
    step = math.log(similarity[1] / similarity[0])
    sets = sets.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)))
    shape = sets.groupBy("cluster", "level").agg(F.count("*").alias("members"))
    leaves = shape.select("cluster", "level", F.ceil(F.col("members") / LEAF).alias("leaves"))
    pivots = sets.groupBy("cluster").agg(F.min("class").alias("pivot"))
    dealt = sets.join(leaves, ["cluster", "level"]).join(pivots, "cluster").withColumn("leaf", F.pmod(F.xxhash64("class"), F.col("leaves")))
    dealt = staged(dealt.drop("leaves"), "jaccard-leaves")
    names = dealt.select("cluster", "level", "leaf").distinct()
    guests = dealt.where("class = pivot").select("cluster", "class", "n", "grams", "pivot").join(names, "cluster")
    cols = ["cluster", "level", "leaf", "class", "n", "grams"]
    one = dealt.select(*cols).union(guests.select(*cols)).dropDuplicates(["cluster", "level", "leaf", "class"])
    one = one.select("*", F.lit(True).alias("wanted"), F.col("class").alias("part"))
    inside = staged(one.groupBy("cluster", "level", "leaf").applyInArrow(_leaf(similarity), "u long, v long"), "jaccard-inside")
    if not names.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        return inside
    done = components(inside)
    marked = dealt.join(done.select(F.col("node").alias("class"), F.col("component").alias("c")), "class", "left").withColumn("part", F.coalesce("c", "class"))
    marked = staged(marked.withColumn("wanted", F.col("part") != F.col("pivot")).drop("c"), "jaccard-marked")
    state = marked.groupBy("cluster", "level", "leaf").agg(F.max("wanted").alias("open"))
    x, y = (state.select("cluster", F.col("level").alias(f"level_{s}"), F.col("leaf").alias(f"leaf_{s}"), F.col("open").alias(f"open_{s}")) for s in "xy")
    near = F.col("level_y").between(F.col("level_x"), F.col("level_x") + 1)
    pairs = x.join(y, "cluster").where(near & (F.col("open_x") | F.col("open_y")) & ((F.col("level_x") < F.col("level_y")) | (F.col("leaf_x") < F.col("leaf_y"))))
    pairs = pairs.select("cluster", F.xxhash64("level_x", "leaf_x", "level_y", "leaf_y").alias("pair"), F.explode(F.array(F.struct(F.col("level_x").alias("level"), F.col("leaf_x").alias("leaf")), F.struct(F.col("level_y").alias("level"), F.col("leaf_y").alias("leaf")))).alias("at"))
    pairs = pairs.select("cluster", "pair", "at.level", "at.leaf")
    across = marked.join(pairs, ["cluster", "level", "leaf"]).groupBy("cluster", "pair").applyInArrow(_leaf(similarity), "u long, v long")
    return inside.union(across)


def jaccard_components(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(row, doc, n_shingles, component, group): every document row with the least document (rank) that links reach.

    Groups that share no link can share their least document (of documents without id, or two texts with one id):
    ``group`` tells them apart, the least class of the linked sets; null for a text without words.

    A set has the distinct shingles of ``words`` words of the text, A-Z lower-cased; a shorter text is one shingle; a text
    without words (or null) has none and links with nothing. Two documents link if p of q hundredths, in exact integers:
    q * shared >= p * union. A null doc_id ranks before all (``anchors.rank``); repeated rows are equal sets, hence linked.
    """
    spark = docs.sparkSession
    texts = keyed(docs)
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.select("row", "doc", "text").mapInArrow(_deal(words, buckets), DEALT)
    counted = dealt.repartition("bucket").mapInArrow(_count, COUNTED)
    members = staged(counted.repartition("shard").mapInArrow(_prefixes(similarity), MEMBERS), "jaccard-members")
    shared = members.where(F.size("prefix") > 0).select(F.explode("prefix").alias("gram"), "class").distinct()
    hubs = shared.groupBy("gram").agg(F.min("class").alias("hub"), F.count("*").alias("k")).where("k > 1").select("gram", "hub")
    near = shared.join(hubs, "gram").where("class <> hub").select(F.col("hub").alias("u"), F.col("class").alias("v"))
    clusters = components(near).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    first = members.where("n > 0").groupBy("class").agg(F.min(F.struct("doc", "row")).alias("first")).select("class", F.col("first.doc").alias("doc"), F.col("first.row").alias("row"))
    wanted = staged(clusters.join(first.select("class", "row"), "class").select("cluster", "class", F.col("row").alias("__row")), "jaccard-wanted")
    pulled = texts.join(small(wanted), F.col("row") == F.col("__row")).select("cluster", "class", "text")
    sets = pulled.mapInArrow(_sets(words), "cluster long, class long, n long, grams binary").dropDuplicates(["class"])
    linked = components(verified_links(staged(sets, "jaccard-sets"), similarity))
    least = first.join(linked.select(F.col("node").alias("class"), F.col("component").alias("group")), "class", "left").withColumn("group", F.coalesce("group", "class"))
    least = least.select("class", "group", "doc").join(least.groupBy("group").agg(F.min("doc").alias("component")), "group").select("class", "component", "group")
    out = members.select("row", "doc", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(least, "class", "left")
    return out.select("row", "doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"), "group")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each linked group, the one of the least doc_id (of its rows with different texts, one);
    texts without words all stay, but of rows repeated whole one stays. Columns as they were.
    """
    cols = docs.columns
    found = staged(jaccard_components(docs, words, similarity), "jaccard-found")
    times = found.groupBy("row").agg(F.count("*").alias("times"), F.first("group").alias("group"), F.first("doc").alias("doc"), F.first("n_shingles").alias("n"))
    stays = times.where("n > 0").groupBy("group").agg(F.min(F.struct("doc", "row"))["row"].alias("stay"))
    judged = times.join(stays, "group", "left").withColumn("gone", (F.col("n") > 0) & (F.coalesce("stay", "row") != F.col("row")))
    judged = staged(judged.where("gone or times > 1").select(F.col("row").alias("__gone"), "gone", "times"), "jaccard-gone")
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    once = rows.join(small(judged.select("__gone")), F.col("__row") == F.col("__gone"), "left_anti")
    again = rows.join(small(judged.where("not gone").select("__gone")), F.col("__row") == F.col("__gone")).drop("__gone").dropDuplicates(["__row"])
    return once.select(*cols).union(again.select(*cols))
