"""MinHash near-duplicates with an LSH forest.

Each distinct shingle set has TREES labels, sequences of minhash values.  A tree orders the labels; sets
whose labels share a long common prefix are candidates.  A region is a group of labels with the same
prefix of DEPTH values; where it is dense, longer prefixes part it.  Links are confirmed on the full shingle
sets, and linked sets form classes.

Two rounds find them.  The first takes the neighbours in each tree's order and each region's smallest node,
a number of candidates in proportion to the sets.  Regions whose members then are one class are done.  In
the others the second round compares each member outside the region's main class with all members of other
classes, by signatures first.  A mixed region of over DENSE members is not compared as a whole: each member goes
to BRANCHES longer prefixes, of its region and DEPTH more values each, and so on for LEVELS levels.  Where that
can't part a region, as over 1 / BRANCHES of it have the next DEPTH values too, it is tight; so is what LEVELS leave.
Tight regions of all trees that share members are merged, and each merged one is compared once, in blocks, in place of
once in each tree and branch.  So no partner is left out for the size of a group, and a group of many near
copies, already one class, never has its pairs spelt out.

Of pairs of likeness s, the forest misses (1 - p) ** TREES, with p = s ** DEPTH in regions that aren't dense: 1e-6 at
0.8.  Each branched level multiplies p by 1 - (1 - s ** DEPTH) ** BRANCHES, 0.88 at 0.8: 1e-5 where all branches thrice.
A signature's estimate rules a pair out MARGIN standard errors below the threshold: 3e-7 of pairs at 0.8.

Defined results: null texts, empty texts and texts without words have no shingle, are linked with nothing
and kept; texts with fewer words than a shingle have their whole sequence as the one shingle; equal sets are
one node from the start, whatever their number (two sets share a node only if 128 bits of their digests agree);
rows with equal ids are each judged by their own text, and a class is named by its smallest id (null ids count
only where a class has no other); extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, connected_components, drop_staged, give_back, staged, unused

SHINGLE = 5
PERCENT = 80
TREES = 26
DEPTH = 4  # values of a label that name a region
FUNCTIONS = TREES * DEPTH
DENSE = 512
BRANCHES, LEVELS = 4, 3
BLOCK = 512
KEPT = 3
BROADCAST_IDS = 1 << 20
SEED = 7919
MARGIN = 5.0  # standard errors below the threshold at which a signature's estimate rules a pair out
_CHUNK = 1 << 12
# the joins with counts and classes are hinted as merges: their sides grow with the input, and a merge can split a hot key
_ROWS = 1024  # rows that Python gets at once
_HELD = 1 << 22  # shingles that a cell keeps at a time

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 63, (FUNCTIONS, 1), dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, (FUNCTIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(1023, _BASE, np.uint64))), dtype=np.uint64)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered; maximal runs of characters other than the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int) -> set:
    """Distinct shingles of ``width`` words; with fewer words the whole sequence as one; without words none."""
    w = words_of(text)
    if len(w) <= width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(width)), strict=False))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit polynomial hashes of the words, mixed."""
    global _POW
    n = np.fromiter(map(len, words), np.int64, len(words))
    longest = int(n.max())
    while longest > len(_POW):
        _POW = np.concatenate((_POW, _POW * (_POW[-1:] * _BASE)))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(n) - n
    place = np.arange(len(data)) - np.repeat(start, n)
    return _mix64(np.add.reduceat(data * _POW[place], start) + n.astype(np.uint64) * _BASE)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = words_of(text)
    if not w:
        return np.empty(0, np.uint64)
    h = word_hashes(w)
    k = min(width, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = _mix64(out * _BASE + h[i : len(h) - k + 1 + i])
    return np.unique(_mix64(out + np.uint64(min(len(w), width))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """FUNCTIONS minhash values of 32 bits."""
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        x = (hashes[None, i : i + _CHUNK] ^ _XOR) * _MUL
        x ^= x >> np.uint64(31)
        x *= _BASE
        np.minimum(low, x.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def names_of(hashes: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """Two 64-bit names of a shingle set; None for the empty one."""
    if not len(hashes):
        return None, None
    raw = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


_SKETCH = "doc_id {id}, key long, n_shingles long, node long, other long, sig binary"


def _named(docs: DataFrame, width: int) -> DataFrame:
    """_SKETCH for each row: key is a hash of the text, node and other name the set, null for an empty one."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, others, sigs = [], [], [], []
            for text in b.column(2).to_pylist():
                h = shingle_hashes(text, width)
                node, other = names_of(h)
                sizes.append(len(h))
                nodes.append(node)
                others.append(other)
                sigs.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (sizes, nodes, others)), pa.array(sigs, pa.binary())], names)
        give_back()

    names = ["doc_id", "key", "n_shingles", "node", "other", "sig"]
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(part, _SKETCH.format(id=docs.schema["doc_id"].dataType.simpleString()))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, sig), staged; node names the set, null for an empty one.

    Where two sets share their first name, the second one parts them."""
    named = staged(_named(docs, width), "sketches")
    per = named.where("node is not null").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    clash = staged(per.where("lo <> hi").select("node"), "clash")
    if not clash.isEmpty():
        both = named.join(clash.withColumnRenamed("node", "_clash"), F.col("node") == F.col("_clash"), "left")
        named = both.withColumn("node", F.when(F.col("_clash").isNotNull(), F.xxhash64("node", "other")).otherwise(F.col("node")))
    return named.select("doc_id", "key", "n_shingles", "node", "sig")


def _values(sig: np.ndarray, tree: int, n: int) -> np.ndarray:
    """The first ``n`` values of each signature's label in a tree: its own, then those of the next trees."""
    return sig[:, (tree * DEPTH + np.arange(n)) % FUNCTIONS].astype(np.uint64)


def _prefix(start: np.ndarray, values: np.ndarray, tree: int) -> pa.Array:
    """Names of the prefixes with these values; the last five bits are the tree."""
    h = start
    for i in range(values.shape[1]):
        h = _mix64(h * _BASE + values[:, i])
    return pa.array(((h & ~np.uint64(31)) | np.uint64(tree)).view(np.int64))


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, FUNCTIONS)


def _labels(nodes: DataFrame) -> DataFrame:
    """(node, region, order) for each node and tree: the label's first DEPTH values by name, and 16 bits of each of
    the next four, so that order sorts by the length of the common prefix."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = np.array([48, 32, 16, 0], np.uint64)
        for b in batches:
            sig = _sigs(b.column(1))
            for tree in range(TREES):
                values = _values(sig, tree, DEPTH + 4)
                order = ((values[:, DEPTH:] >> np.uint64(16)) << shifts).sum(axis=1, dtype=np.uint64)
                region = _prefix(np.full(len(sig), tree + 1, np.uint64), values[:, :DEPTH], tree)
                yield pa.RecordBatch.from_arrays([b.column(0), region, pa.array(order.view(np.int64))], ["node", "region", "order"])

    return nodes.select("node", "sig").mapInArrow(part, "node long, region long, order long")


def _members(labels: DataFrame) -> DataFrame:
    """(region, size, hub, node, order) of regions of two or more; hub is the smallest node.

    Sizes are counted before the shuffle and staged, so that large regions can be split in the join."""
    sizes = labels.groupBy("region").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1")
    return staged(labels.join(staged(sizes, "sizes").hint("merge"), "region"), "members")


def _small_regions(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of regions of two or more, each at the depth that its density asks for, as (region, order, node); and
    for members of dense regions the smallest node there as candidate, as (node, other).

    What is still dense at the last depth is split by node, so no region that reaches one task has much more
    than DENSE members."""
    here, found, hubs = members, [], []
    for bits in (32, 64, None):
        found.append(here.where(F.col("size") <= DENSE).select("region", "order", "node"))
        dense = here.where(F.col("size") > DENSE)
        if dense.isEmpty():
            break
        hubs.append(dense.where("node != hub").select("node", F.col("hub").alias("other")))
        if bits is None:
            part = F.pmod("node", F.ceil(F.col("size") / DENSE))
            found.append(dense.select(F.xxhash64("region", part).alias("region"), "order", "node"))
            break
        deeper = dense.select("node", F.xxhash64("region", F.shiftrightunsigned("order", 64 - bits) if bits < 64 else F.col("order")).alias("region"), "order")
        here = _members(staged(deeper, "deeper"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    none = members.select("node", F.col("node").alias("other")).limit(0)
    for h in hubs:
        none = none.unionByName(h)
    return every, none


def _neighbours(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, nth): for each node the KEPT candidates that it meets in most trees, of its neighbours in the
    trees' orders and the first nodes of its regions; nth is 1 where b is the best candidate of a, or a of b.

    Pairs whose sizes alone keep them apart are left out, which is exact, so no text is sent for them."""
    small, hubs = _small_regions(members)
    w = Window.partitionBy("region").orderBy("order", "node")
    met = small.withColumns({"before": F.lag("node").over(w), "first": F.first("node").over(w)})
    met = met.select("node", F.explode(F.array_distinct(F.array("before", "first"))).alias("other")).where("other != node")
    counted = met.unionByName(hubs).groupBy("node", "other").agg(F.count("*").alias("trees"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.col("trees").desc(), "other"))
    kept = counted.withColumn("nth", best).where(F.col("nth") <= KEPT)
    pairs = kept.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.min("nth").alias("nth"))
    sized = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")).hint("merge"), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")).hint("merge"), "b")
    return sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "nth")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose nodes aren't in one class yet."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}")).hint("merge")
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")


def _widened(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, class) with further links: components of the classes that these join, so the rounds run over
    what is new and not over all links again."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}")).hint("merge")
    both = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = both.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).where("a != b")
    tops = staged(connected_components(between).select(F.col("node").alias("class"), F.col("component").alias("top")), "tops")
    old = classes.join(tops.hint("merge"), "class", "left").select("node", F.coalesce("top", "class").alias("class"))
    new = tops.select(F.col("class").alias("node"), F.col("top").alias("class")).join(classes.select("node").hint("merge"), "node", "left_anti")
    return staged(old.unionByName(new), "classes")


def _first_links(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame:
    """The classes (node, class) that the links make: each node's best candidate is confirmed first, and of the others
    only what these links leave apart, so that most texts are sent once."""
    best = staged(_confirmed(pairs.where("nth = 1"), docs, sketched, width, percent), "links")
    classes = staged(connected_components(best).select("node", F.col("component").alias("class")), "classes")
    others = staged(_apart(pairs.where("nth > 1"), classes), "apart")
    drop_staged(best)
    if others.isEmpty():
        return classes
    return _widened(classes, staged(_confirmed(others, docs, sketched, width, percent), "links"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Those of rows (region, node, class, order) whose region has several classes, and main, n_main, size: the region's largest class,
    its members and all.  Counts are staged, so that large regions can be split in the join."""
    per = rows.groupBy("region", "class").agg(F.count("*").alias("n_class"))
    tops = per.groupBy("region").agg(F.max(F.struct("n_class", "class")).alias("top"), F.sum("n_class").alias("size"), F.count("*").alias("n_classes")).where("n_classes > 1")
    tops = staged(tops.select("region", F.col("top.class").alias("main"), F.col("top.n_class").alias("n_main"), "size"), "tops")
    return staged(rows.join(tops.hint("merge"), "region"), "mixed")


def _branches(dense: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """(region, node, class, order): each member of a dense region in BRANCHES longer prefixes; order is as in _labels."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, region = _sigs(b.column(3)), b.column(0).to_numpy().view(np.uint64)
            trees = (region & np.uint64(31)).astype(np.int64)
            for branch in range(BRANCHES):
                at = ((trees + 1 + (level * BRANCHES + branch)) % TREES)[:, None] * DEPTH + np.arange(2 * DEPTH)
                values = np.take_along_axis(sig, at % FUNCTIONS, axis=1).astype(np.uint64)
                order = ((values[:, DEPTH:] >> np.uint64(16)) << np.array([48, 32, 16, 0], np.uint64)).sum(axis=1, dtype=np.uint64)
                h = region * _BASE + np.uint64(branch + 1)
                for i in range(DEPTH):
                    h = _mix64(h * _BASE + values[:, i])
                deeper = (h & ~np.uint64(31)) | trees.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(deeper.view(np.int64)), b.column(1), b.column(2), pa.array(order.view(np.int64))], ["region", "node", "class", "order"])

    rows = dense.select("region", "node", "class").join(nodes.select("node", "sig"), "node")
    return rows.select("region", "node", "class", "sig").mapInArrow(part, "region long, node long, class long, order long")


def _parted(dense: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense rows of regions that longer prefixes part, and of tight ones, where over 1 / BRANCHES of the members agree in
    the next values as well, so that branches would copy rows and save no comparison."""
    per = dense.groupBy("region", "order").agg(F.count("*").alias("n_order"), F.first("size").alias("size"))
    tight = staged(per.groupBy("region").agg(F.max(BRANCHES * F.col("n_order") > F.col("size")).alias("tight")), "tight")
    both = staged(dense.join(tight.hint("merge"), "region"), "parted")
    return both.where("not tight"), both.where("tight").select("region", "node", "class")


def _merged(tight: DataFrame) -> DataFrame:
    """Rows of tight regions (region, node, class) under new regions: each region takes the smallest name of those that
    any of its members is in.  Members of one region stay together, and the regions that a group of copies
    has in the trees nearly all become one, so a node stands there once or a few times."""
    low = staged(tight.groupBy("node").agg(F.min("region").alias("low")), "low")
    names = staged(tight.join(low.hint("merge"), "node").groupBy("region").agg(F.min("low").alias("name")), "names")
    return staged(tight.join(names.hint("merge"), "region").select(F.col("name").alias("region"), "node", "class").distinct(), "merged")


def _mixed_regions(members: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the regions whose members are not all one class, dealt into cells, each region at the depth that its
    density asks for; tree is that of a region of DEPTH values, else -1, and deep has a bit for each tree in
    which the node's region was dense.

    A cell has a block of members on the left and one of members outside the region's main class on the
    right; together the cells hold each pair of different classes once."""
    rows = members.select("region", "node", "order").join(classes.hint("merge"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    here = _mixed(rows)
    tree = F.col("region").bitwiseAND(F.lit(31)).cast("int")
    names = ["region", "node", "class", "main", "n_main", "size", "tree"]
    every, level = here.where(F.col("size") <= DENSE).withColumn("tree", tree).select(*names), 0
    first = dense = staged(here.where(F.col("size") > DENSE), "dense")
    tight = None
    while not dense.isEmpty():
        loose, more = _parted(dense) if level < LEVELS else (None, dense.select("region", "node", "class"))
        tight, level = more if tight is None else tight.unionByName(more), level + 1
        if loose is None or loose.isEmpty():
            break
        here = _mixed(staged(_branches(loose, nodes, level - 1), "branches"))
        every = every.unionByName(here.where(F.col("size") <= DENSE).withColumn("tree", F.lit(-1)).select(*names))
        dense = staged(here.where(F.col("size") > DENSE), "dense")
    if level:
        every = every.unionByName(_mixed(_merged(tight)).withColumn("tree", F.lit(-1)).select(*names))
    deep = first.groupBy("node").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), tree)).alias("deep")) if level else None
    at = every.join(staged(deep, "deep"), "node", "left").withColumn("deep", F.coalesce("deep", F.lit(0).cast("long"))) if level else every.withColumn("deep", F.lit(0).cast("long"))
    blocks_main = F.ceil(F.col("n_main") / BLOCK).cast("int")
    blocks_rest = F.ceil((F.col("size") - F.col("n_main")) / BLOCK).cast("int")
    cell = lambda left, right, side: F.struct(F.lit(left).alias("left") if isinstance(left, int) else left.cast("int").alias("left"), right.cast("int").alias("right"), F.lit(side).alias("side"))
    own_main = F.pmod(F.xxhash64("node"), blocks_main).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks_rest).cast("int")
    main = F.transform(F.sequence(F.lit(0), blocks_rest - 1), lambda j: cell(own_main, j, 0))
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), blocks_main - 1), lambda i: cell(i, own, 1)),
        F.transform(F.sequence(F.lit(0), own), lambda i: cell(-1 - i, own, 1)),
        F.filter(F.transform(F.sequence(own, blocks_rest - 1), lambda j: cell(-1 - own, j, 0)), lambda c: c["right"] > own),
    )
    cells = F.when(F.col("class") == F.col("main"), main).otherwise(rest)
    return at.select("tree", "region", "node", "deep", "class", F.explode(cells).alias("cell")).select("tree", "region", "node", "deep", "class", "cell.*")


_CELL = ["tree", "region", "left", "right"]


def _cross_candidates(members: DataFrame, nodes: DataFrame, classes: DataFrame, percent: int, margin: float | None) -> DataFrame:
    """For each cell the nodes with a partner of another class that signatures and sizes don't rule out (with no
    ``margin`` sizes alone, which is exact), and at each right node its partners, the likeliest first.  A row for each
    node and cell, not for each pair."""
    dealt = _mixed_regions(members, nodes, classes).join(nodes.select("node", "n", "sig"), "node")
    s = percent / 100
    least = 0 if margin is None else (s - margin * (s * (1 - s) / FUNCTIONS) ** 0.5) * FUNCTIONS

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        tree, left = key[0].as_py(), key[2].as_py()
        side = table.column("side").to_numpy()
        node, n, cls, deep = (table.column(c).to_numpy() for c in ("node", "n", "class", "deep"))
        sig, trees = _sigs(table.column("sig")), np.arange(TREES)
        right = np.flatnonzero(side == 1)
        same_block = left < 0 and not (side == 0).any()
        lefts = right if same_block else np.flatnonzero(side == 0)
        partners: dict[int, list[int]] = {}
        met = np.zeros(len(node), bool)
        for r in right:
            ok = (cls[lefts] != cls[r]) & (100 * np.minimum(n[lefts], n[r]) >= percent * np.maximum(n[lefts], n[r]))
            if same_block:
                ok &= node[lefts] < node[r]
            at = lefts[ok]
            equal = sig[at] == sig[r]
            score = equal.sum(axis=1)
            keep = score >= least
            # of the trees where the two share a region that isn't dense, only the first gives the pair
            shared = equal[keep].reshape(-1, TREES, DEPTH).all(axis=2) & ((deep[r] >> trees) & 1 == 0)
            first = shared.argmax(axis=1) == tree if tree >= 0 else np.ones(len(shared), bool)
            mine = at[keep][first][np.argsort(-score[keep][first], kind="stable")]
            if len(mine):
                partners[r] = node[mine].tolist()
                met[mine] = met[r] = True
        rows = np.flatnonzero(met)
        same = [pa.array([k.as_py()] * len(rows), pa.int64() if i == 1 else pa.int32()) for i, k in enumerate(key)]
        return pa.table([*same, pa.array(node[rows]), pa.array(cls[rows]), pa.array([partners.get(r, []) for r in rows.tolist()], pa.list_(pa.int64()))], [*_CELL, "node", "class", "partners"])

    return dealt.groupBy(*_CELL).applyInArrow(cell, "tree int, region long, left int, right int, node long, class long, partners array<long>")


def _cross_links(candidates: DataFrame, docs: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between classes, for each right node and other class one where there is any; all partners
    are compared on full shingle sets until then."""
    texts = _texts(docs, sketched, candidates.select("node").distinct())

    def cell(_: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        text = dict(zip(nodes, table.column("text").to_pylist(), strict=True))
        cls = dict(zip(nodes, table.column("class").to_pylist(), strict=True))
        held: dict[int, set[int]] = {}
        size = 0

        def hashed(x: int) -> set[int]:
            nonlocal size
            if x not in held:
                if size > _HELD:
                    held.clear()
                    size = 0
                held[x] = set(shingle_hashes(text[x], width).tolist())
                size += len(held[x])
            return held[x]

        out = []
        for x, partners in zip(nodes, table.column("partners").to_pylist(), strict=True):
            linked: set[int] = set()
            for y in partners:
                if cls[y] in linked:
                    continue
                p, q = hashed(x), hashed(y)
                if _alike(p, q, percent) and _alike(shingle_set(text[x], width), shingle_set(text[y], width), percent):
                    linked.add(cls[y])
                    out.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return candidates.join(texts, "node").select(*_CELL, "node", "class", "partners", "text").groupBy(*_CELL).applyInArrow(cell, "a long, b long")


def _alike(p: set, q: set, percent: int) -> bool:
    n = len(p & q)
    return 100 * n >= percent * (len(p) + len(q) - n)


def _texts(docs: DataFrame, sketched: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of each node in ``wanted``, staged, from one of its documents, which its id and its text's hash name."""
    per = sketched.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("d"))  # a row for each node before the join
    one = staged(per.join(wanted, "node", "left_semi").select("node", F.col("d.doc_id").alias("_id"), F.col("d.key").alias("_key")), "wanted")
    size, names = one.count(), one
    if size <= BROADCAST_IDS:  # the size is checked; beyond it both sides are shuffled
        names = F.broadcast(names)
    text = docs.select("doc_id", "text").join(names, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")))
    found = staged(text.select("node", "text"), "texts")
    # more only where a row stands in the table several times
    return found if found.count() == size else staged(found.dropDuplicates(["node"]), "texts")


def _confirmed(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are alike enough, compared shingle by shingle."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(docs, sketched, wanted)
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for x in batches:
            keep = []
            for name, one, two in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                if held[0] != name:
                    held = (name, shingle_set(two, width))
                keep.append(_alike(shingle_set(one, width), held[1], percent))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(part, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, margin: float | None = MARGIN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); and key, a hash of the
    text, and class, a name of the class that no id can blur.  With ``margin`` None no signature rules a
    candidate out: all are compared on their full sets."""
    with batches_of(docs.sparkSession, _ROWS):
        return _near_duplicates(docs, width, percent, margin)


def _near_duplicates(docs: DataFrame, width: int, percent: int, margin: float | None) -> DataFrame:
    sketched = sketches(docs, width)
    nodes = staged(sketched.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "nodes")
    labels = staged(_labels(nodes), "labels")
    members = _members(labels)
    drop_staged(labels)
    pairs = staged(_neighbours(members, nodes, percent), "pairs")
    classes = _first_links(pairs, docs, sketched, width, percent)
    more = staged(_cross_candidates(members, nodes, classes, percent, margin), "candidates")
    if not more.isEmpty():
        classes = _widened(classes, staged(_cross_links(more, docs, sketched, width, percent), "links"))
    drop_staged(nodes, members, pairs, more)
    rows = sketched.select("doc_id", "key", "n_shingles", "node").join(classes.hint("merge"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    # staged, so that the join can split a class of many documents
    first = staged(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first")), "first")
    out = rows.join(first.hint("merge"), "class", "left").withColumn("component_id", F.coalesce("first", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "key", "class")


def _sent(names: DataFrame) -> DataFrame:
    """Staged names of rows, broadcast where they are at most BROADCAST_IDS, so that no text is shuffled to meet them; beyond it
    both sides are."""
    return F.broadcast(names) if names.count() <= BROADCAST_IDS else names


def representatives(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class, that with the smallest doc_id
    (of rows that share it, one text, once), and every document without a word."""
    found = near_duplicates(docs, width, percent).where("n_shingles > 0")
    stays = staged(found.where("kept").groupBy("doc_id", "class").agg(F.min("key").alias("key"), F.count("*").alias("rows")), "stays")
    id_, key_, nth = unused(docs, "_id", "_key", "_nth")
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("key").alias(key_))
    same_id = F.col("doc_id").eqNullSafe(F.col(id_))
    every = found.select("doc_id", "key").distinct()
    gone = staged(every.join(named(stays), same_id & (F.col("key") == F.col(key_)), "left_anti"), "gone")
    here = same_id & (F.xxhash64("text") == F.col(key_))
    drop, again = _sent(named(gone)), staged(named(stays.where("rows > 1")).distinct(), "again")
    left = docs.join(drop, here, "left_anti")
    if again.isEmpty():
        return left
    again = _sent(again)
    order = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[c for c in docs.columns if c != "doc_id"]))
    twice = docs.join(again, here, "left_semi").withColumn(nth, order).where(F.col(nth) == 1).drop(nth)
    return left.join(again, here, "left_anti").unionByName(twice)
