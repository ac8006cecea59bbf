"""MinHash near-duplicates with an LSH forest.

1. Texts with equal shingle sets form a class; from here on a class is a node, so copies cost one row.
2. A node has ``TREES`` signatures of ``DEPTH`` minimal hashes, and a sketch: two bits of each hash. Each tree is one sorted
   order of the nodes; neighbours in the order that share at least ``MIN_DEPTH`` leading values are candidates, so a dense
   region is compared at the depth where its neighbours differ and a thin one at the least depth. The orders are dealt by
   range over (tree, signature, node): a region of any size is spread over tasks, the rows at the borders are joined up
   in a second step.
3. For every node its best candidate (by the sketches) is confirmed on the full sets of both texts and links are contracted
   to components. The next round looks at many more nodes of *other* components around each node for pairs whose sketches
   agree enough; the best of every component is confirmed, then of every node. All pairs of a group are never made.
4. The nodes that had such a pair, and those of a region of more than ``LOOK`` nodes that still holds several components, may
   have links that are not confirmed yet. They are joined exactly, without signatures: two sets of similarity 0.8 share one
   of the rarest shingles of each, so early in both that enough others are left (prefix and position filter). Only pairs
   between components are made, first the best of every component is confirmed, then all that still lie between two.

At a similarity of 0.8 one tree shows a pair of neighbours with probability 0.51, all 24 miss it with 3e-8.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer words than a
shingle have one shingle; repeated rows are copies; null ids are larger than any other id; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections import OrderedDict, deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.llm.common import MASK, Windows, WordHash, mix, prepare, written

SHINGLE = 4
PERCENT = 80
TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 24, 6, 3, 3
#: Second pass: nodes looked back at in a region. Sketch values (of 144) in which a pair agrees at least: a pair of
#: similarity 0.8 agrees in 122 +- 4.3 of them, so 98 misses one in a hundred million.
LOOK, AGREE = 64, 98
#: Exact join: step of the classes of set sizes, and nodes of a shingle for which its pairs are dealt out once more.
SIZE_STEP, DEALT = 1.06, 500
#: Keys of texts that are broadcast at most (16 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_KEYS = 200_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_FACTORS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.word, self.poly = size, WordHash(), Windows(0x9E3779B97F4A7C15)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = raw.translate(_LOWER).split() if raw else []
        if not words:
            return np.zeros(0, np.uint64)
        values = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        at = np.arange(len(words) - size + 1)
        return np.unique(mix(self.poly.of(self.poly.prefix(values), at, at + size) + np.uint64(size)))


def signature(shingles: np.ndarray) -> bytes:
    """The least value of every hash function, 16 bits each, tree by tree."""
    least = np.full(len(_FACTORS), MASK, np.uint64)
    for low in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[low: low + 2048, None] * _FACTORS).min(axis=0))
    return (least >> np.uint64(16)).astype(">u2").tobytes()


def sketches(signatures: list[bytes]) -> np.ndarray:
    """The two last bits of every value of each signature, 36 bytes a row."""
    low = (np.frombuffer(b"".join(signatures), ">u2").reshape(len(signatures), len(_FACTORS)) & 3).astype(np.uint8)
    return low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values the rows of two tables of sketches agree."""
    x = np.ascontiguousarray(a ^ b).view(np.uint32)
    return len(_FACTORS) - np.bitwise_count((x | x >> np.uint32(1)) & np.uint32(0x55555555)).sum(axis=1, dtype=np.int32)


def _table(column: pa.Array, width: int) -> np.ndarray:
    """A column of byte strings of one length as a table of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches):
        shingle = Shingler(size)
        for b in batches:
            sets = [shingle(raw) for raw in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc", "text_key", "n", "node", "sig"])

    src = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col).cast("string").cast("binary"))
    return src.mapInArrow(run, "doc long, text_key long, n long, node binary, sig binary")


def _orders(nodes: DataFrame) -> DataFrame:
    """Every node (node, sig, comp) once for each tree: tree, prefix, node, comp, sketch."""
    step = 2 * DEPTH

    def explode(batches):
        for b in batches:
            sig = b.column(1).to_pylist()
            sketch = pa.array([x.tobytes() for x in sketches(sig)], pa.binary())
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(sig), pa.int32()), pa.array([s[t * step: (t + 1) * step] for s in sig], pa.binary()),
                     b.column(0), b.column(2), sketch], names=["tree", "prefix", "node", "comp", "sketch"])

    return nodes.select("node", "sig", "comp").mapInArrow(explode, "tree int, prefix binary, node binary, comp binary, sketch binary")


_FOUND = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("cu", pa.binary()), ("cv", pa.binary()), ("score", pa.int32()),
                    ("edge", pa.bool_()), ("tree", pa.int32()), ("prefix", pa.binary()), ("node", pa.binary()),
                    ("comp", pa.binary()), ("sketch", pa.binary())])
_FOUND_SQL = ("u binary, v binary, cu binary, cv binary, score int, edge boolean, tree int, prefix binary, node binary, comp binary, "
              "sketch binary")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def _nearest(look: int):
    """One pass over rows in order: each node (u) with the one (v) of the ``look`` nodes before and after it in its region
    whose sketch agrees most, if it agrees enough. Rows marked ``edge`` are the first and last ``look`` of the pass."""
    deep, prefix_bytes, sketch_bytes = 2 * MIN_DEPTH, 2 * DEPTH, len(_FACTORS) // 4

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            edges = [] if last is not None else [(None,) * 5 + (True, *r) for r in zip(*(c.to_pylist() for c in b.slice(0, look).columns))]
            b = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            tree = b.column(0).to_numpy(zero_copy_only=False)
            region, sketch = _table(b.column(1), prefix_bytes)[:, :deep], _table(b.column(4), sketch_bytes)
            score, other = np.full(len(b), -1, np.int32), np.zeros(len(b), np.int64)
            for d in range(1, min(look, len(b) - 1) + 1):
                low = np.flatnonzero((tree[d:] == tree[:-d]) & (region[d:] == region[:-d]).all(axis=1))
                agreed = agreement(sketch[low], sketch[low + d])
                for here, there in ((low, low + d), (low + d, low)):
                    better = agreed > score[here]
                    score[here[better]], other[here[better]] = agreed[better], there[better]
            at = np.flatnonzero(score >= AGREE)
            node = b.column(2)
            out = [(u, v, None, None, s, False, None, None, None, None, None) for u, v, s in zip(
                node.take(pa.array(at)).to_pylist(), node.take(pa.array(other[at])).to_pylist(), score[at].tolist())]
            last = b.slice(max(0, len(b) - look))
            if out or edges:
                yield _found(edges + out)
        if last is not None:
            yield _found([(None,) * 5 + (True, *r) for r in zip(*(c.to_pylist() for c in last.columns))])
    return run


def _neighbours(look: int):
    """One pass over rows in order: each node with the ``look`` nearest nodes of other components before it in its region.

    Pairs whose sketches agree in too few values are left out. Of the others those are given that are the best of the later
    node, or better than all that the earlier one had so far: every node with such a pair is in one, its best is given,
    and the rows grow with the nodes. Rows marked ``edge`` are the first and last nodes of the
    pass, for joining up passes over adjoining ranges: a region of at most ``look`` nodes is carried whole, of a larger
    one the first ``look`` nodes and components and the last ``look`` nodes. Rows without nodes count the nodes (score) and
    give the least and largest component (cu, cv) of a region: of the first and last one of the pass, and of those between
    with more than ``look`` nodes and several components.
    """
    deep, sketch_bytes = 2 * MIN_DEPTH, len(_FACTORS) // 4

    def run(batches):
        recent: OrderedDict[bytes, deque] = OrderedDict()
        here, first, out = None, set(), []
        opening, ahead = True, 0
        held, low, high = 0, None, None

        def counted():
            return (None, None, low, high, held, False, here[0], here[1], None, None, None)

        for b in batches:
            table = _table(b.column(4), sketch_bytes)
            for at, (tree, prefix, node, comp) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]))):
                region = (tree, prefix[:deep])
                if region != here:
                    if here is not None and (opening or held > look and low != high):
                        out.append(counted())
                    opening = here is None
                    recent.clear()
                    here = region
                    held, low, high = 0, comp, comp
                held, low, high = held + 1, min(low, comp), max(high, comp)
                sketch = table[at]
                others = []
                for other in reversed(recent):
                    if other != comp:
                        others += [(other, x) for x in reversed(recent[other])]
                    if len(others) >= look:
                        break
                if others:
                    scores = agreement(np.array([x[1][2] for x in others]), sketch[None, :])
                    top = int(scores.argmax())
                    for k in np.flatnonzero(scores >= AGREE).tolist():
                        other, entry = others[k]
                        score = int(scores[k])
                        if k == top or score > entry[3]:
                            there, entry[3] = entry[1], max(score, entry[3])
                            u, v = ((node, comp), (there, other)) if node < there else ((there, other), (node, comp))
                            out.append((u[0], v[0], u[1], v[1], score, False, None, None, None, None, None))
                if opening and (ahead < look or (len(first) <= look and comp not in first)):
                    first.add(comp)
                    ahead += 1
                    out.append((None,) * 5 + (True, tree, prefix, node, comp, sketch.tobytes()))
                if comp not in recent:
                    recent[comp] = deque(maxlen=look)
                recent.move_to_end(comp)
                recent[comp].append([prefix, node, sketch, -1])
                if len(recent) > look:
                    recent.popitem(last=False)
                if len(out) >= 20000:
                    yield _found(out)
                    out = []
        if here is not None:
            out.append(counted())
        left = [(c, *x) for c in reversed(recent) for x in reversed(recent[c])][:look]
        out += [(None,) * 5 + (True, here[0], p, n, c, x.tobytes()) for c, p, n, x, _ in left]
        if out:
            yield _found(out)
    return run


def _passed(nodes: DataFrame, pass_, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that a pass over the sorted orders finds, and those of joining up its borders. ``nodes``: node, sig, comp."""
    order = ["tree", "prefix", "node"]
    rows = _orders(nodes)
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pass_, _FOUND_SQL), name)
    # A bounded number of rows for each task of the pass above; those of a short range are its first and its last ones.
    edges = found.where("edge").select(*rows.columns).dropDuplicates(["tree", "node"]).repartition(1).sortWithinPartitions(*order)
    return found.where("not edge"), edges.mapInArrow(pass_, _FOUND_SQL).where("not edge")


def _best_near(nodes: DataFrame) -> DataFrame:
    """The best candidate (u, v) of every node among its neighbours in the orders."""
    inside, border = _passed(nodes, _nearest(NEIGHBOURS), "near")
    top = F.max(F.struct("score", "v")).alias("top")
    both = inside.unionByName(border).groupBy("u").agg(top)
    return both.select(F.least("u", "top.v").alias("u"), F.greatest("u", "top.v").alias("v")).distinct()


def _pairs(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (u, v, cu, cv, score) between components among many neighbours in the orders; and the regions (tree,
    region) of several components that the look may have cut."""
    inside, border = _passed(nodes, _neighbours(LOOK), name)
    pairs = inside.unionByName(border).where("u is not null").groupBy("u", "v").agg(
        F.min("cu").alias("cu"), F.min("cv").alias("cv"), F.max("score").alias("score"))
    held = inside.where("u is null").groupBy("tree", F.col("prefix").alias("region")).agg(
        F.sum("score").alias("held"), F.min("cu").alias("low"), F.max("cv").alias("high"))
    return pairs, held.where((F.col("held") > LOOK) & (F.col("low") != F.col("high"))).select("tree", "region")


def _crowded(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes (node, comp) of those ``regions`` that still hold several components."""
    rows = _orders(nodes).withColumn("region", F.substring("prefix", 1, 2 * MIN_DEPTH))
    rows = rows.join(F.broadcast(regions), ["tree", "region"], "left_semi").select("tree", "region", "node", "comp")
    mixed = rows.groupBy("tree", "region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return rows.join(mixed, ["tree", "region"], "left_semi").select("node", "comp").distinct()


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, name: str) -> DataFrame:
    """The wanted nodes with their full sets (z), each made from one of its texts."""
    wanted = written(wanted.select("node").distinct().join(nodes.select("node", "doc", "text_key"), "node"), f"{name}-nodes")
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_key"),
                        F.col(text_col).cast("string").cast("binary").alias("raw"))
    keys = wanted.select("doc", "text_key").distinct()
    same = texts.doc.eqNullSafe(keys.doc) & (texts.text_key == keys.text_key)

    def pack(batches):
        shingle = Shingler(size)
        for b in batches:
            sets = [shingle(r).tobytes() for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["doc", "text_key", "z"])

    found = texts.join(F.broadcast(keys) if few else keys, same, "left_semi").mapInArrow(pack, "doc long, text_key long, z binary")
    found = found.dropDuplicates(["doc", "text_key"])
    return written(wanted.alias("w").join(found.alias("f"), F.col("w.doc").eqNullSafe(F.col("f.doc")) &
                                            (F.col("w.text_key") == F.col("f.text_key"))).select("node", "z"), f"{name}-sets")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int,
               name: str) -> DataFrame:
    """``pairs`` with ``linked``, decided on the full sets of either node, each made from one of its texts."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    held = _sets(wanted, nodes, docs, id_col, text_col, size, name)

    def run(batches):
        unpack = lambda z: np.frombuffer(z, np.uint64)
        for b in batches:
            linked = [similar(unpack(p), unpack(q), percent) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    both = (pairs.select("u", "v").join(held.select(F.col("node").alias("u"), F.col("z").alias("zu")), "u")
            .join(held.select(F.col("node").alias("v"), F.col("z").alias("zv")), "v"))
    return written(both.select("u", "v", "zu", "zv").mapInArrow(run, "u binary, v binary, linked boolean"), name)


def _exact(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v, cu, cv, score) between components of ``crowd`` (node, comp) that share a rare shingle early enough.

    Shingles are taken in one order for all sets: those of one component only, then the rarest. Sets of n and m shingles
    that are similar enough share percent * (n + m) / (100 + percent) of them. So they have a first shared one, and from
    its place on either set holds at least as many. The larger set (n) has it among its n - percent of n + 1 first, the
    smaller one among fewer. Sizes are joined by classes, and the larger set meets those classes only that its place allows.
    """
    def explode(batches):
        for b in batches:
            for node, comp, z in zip(*(c.to_pylist() for c in b.columns)):
                g = np.frombuffer(z, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(g), pa.binary()), pa.array(np.full(len(g), comp)), pa.array(g)],
                                                 names=["node", "c", "g"])

    # A row for each shingle goes with the node and 64 bits of its component only; size and component join it again by node.
    grams = crowd.join(sets, "node").select("node", F.xxhash64("comp").alias("c"), "z").mapInArrow(explode, "node binary, c long, g long")
    known = grams.groupBy("g").agg(F.count("*").alias("texts"), F.min("c").alias("low"), F.max("c").alias("high"))
    ranked = grams.select("node", "g").join(known.where("low <> high").select("g", "texts"), "g")
    sized = crowd.join(sets.select("node", F.expr("cast(length(z) div 8 as bigint)").alias("n")), "node")
    rare = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("texts", "g"))).alias("all")).join(sized, "node")
    first = rare.select("node", "comp", "n", (F.col("n") - F.size("all")).alias("own"), F.posexplode(
        F.expr(f"slice(all, 1, cast(greatest(0, size(all) - ceil({percent} * n / 100) + 1) as int))")).alias("k", "x"))
    spread = (F.col("x.texts") / DEALT).cast("int") + 1
    prefix = written(first.select("node", "comp", "n", "x.g", (F.col("n") - F.col("own") - F.col("k")).alias("left"), spread.alias("spread")), "prefix")
    size_class = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(SIZE_STEP)))
    n, left = F.col("n"), F.col("left")
    small = prefix.where((100 + percent) * left >= 2 * percent * n).select(
        "g", size_class(n).alias("size"), F.expr("pmod(xxhash64(node), spread)").alias("salt"), F.struct("node", "comp", "n", "left").alias("a"))
    least, most = F.ceil(percent * n / 100), F.least(n, F.floor(((100 + percent) * left - percent * n) / percent))
    large = prefix.where(least <= most).select("g", F.explode(F.sequence(size_class(least), size_class(most))).alias("size"), "spread",
                                               F.struct("node", "comp", "n", "left").alias("b"))
    large = large.select("g", "size", F.explode(F.expr("sequence(0L, spread - 1L)")).alias("salt"), "b")
    shared = f"{percent} * (a.n + b.n)"
    both = small.join(large, ["g", "size", "salt"]).where(
        f"a.comp <> b.comp and (a.n < b.n or a.n = b.n and a.node < b.node) and 100 * a.n >= {percent} * b.n "
        f"and {100 + percent} * a.left >= {shared} and {100 + percent} * b.left >= {shared}")
    swap = lambda x, y: F.when(F.col("a.node") < F.col("b.node"), F.col(x)).otherwise(F.col(y))
    pairs = both.select(swap("a.node", "b.node").alias("u"), swap("b.node", "a.node").alias("v"), swap("a.comp", "b.comp").alias("cu"),
                        swap("b.comp", "a.comp").alias("cv"))
    return pairs.groupBy("u", "v", "cu", "cv").agg(F.count("*").cast("int").alias("score"))


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, comp) after merging the components of the links (u, v), which may be of any shape.

    Every component hooks onto its least neighbour, labels jump to the label of their label, links inside a component
    fall away; repeated until none is left.
    """
    def relabelled(edges, by):
        a = by.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        b = by.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        return (edges.join(a, "u", "left").join(b, "v", "left")
                .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct())

    edges = written(relabelled(links, labels), "edges")
    changed = False
    while not edges.isEmpty():
        ends = edges.union(edges.select("v", "u")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
        hook = ends.select("node", F.least("node", "least").alias("comp"))
        up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        hook = written(hook.join(up, "comp").select("node", F.col("top").alias("comp")), "hooks")
        old = labels.join(hook.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
        added = hook.join(labels.select("node"), "node", "left_anti")
        labels = old.select("node", F.coalesce("top", "comp").alias("comp")).unionByName(added.select("node", "comp"))
        edges = written(relabelled(edges, hook), "edges")
        changed = True
    return written(labels, "labels") if changed else labels


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
               percent: int = PERCENT) -> DataFrame:
    """One row per document: doc, text_key, n (set size), component (least id of its component) and stays (true for the
    rows of one document of each component)."""
    spark = docs.sparkSession
    prepare(spark)
    signed = written(_signed(docs, id_col, text_col, size), "signed")
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_key"))
    nodes = written(signed.where("node is not null").groupBy("node").agg(least.alias("r"), F.any_value("sig").alias("sig"))
                    .select("node", "r.doc", "r.text_key", "sig"), "nodes")
    labels = spark.createDataFrame([], "node binary, comp binary")

    def now(column):
        """Current component of the nodes of a column, as a table."""
        return labels.select(F.col("node").alias(column), F.col("comp").alias(f"now_{column}"))

    def best(pairs, by=("cu", "cv")):
        """The best candidate of every component (or node), as either end of its pairs."""
        top = F.max(F.struct("score", "u", "v")).alias("pair")
        ends = [pairs.groupBy(F.col(c).alias("end")).agg(top) for c in by]
        return ends[0].unionByName(ends[1]).groupBy("end").agg(F.max("pair").alias("pair")).select("pair.u", "pair.v").distinct()

    def open_(pairs, tried):
        """The other pairs that still lie between two components."""
        return (pairs.join(tried, ["u", "v"], "left_anti").join(now("u"), "u", "left").join(now("v"), "v", "left")
                .where(F.coalesce("now_u", "u") != F.coalesce("now_v", "v")).select(*pairs.columns))

    def confirm(pairs, name):
        done = _confirmed(pairs, nodes, docs, id_col, text_col, size, percent, name)
        return contract(labels, done.where("linked").select("u", "v"))

    def current():
        return nodes.join(labels, "node", "left").select("node", "sig", F.coalesce("comp", "node").alias("comp"))

    labels = confirm(written(_best_near(current()), "best-near"), "near-links")

    far, cut = _pairs(current(), "far")
    far, cut = written(far, "far-pairs"), written(cut, "cut")
    tried = written(best(far), "best-far")
    labels = confirm(tried, "far-links")
    labels = confirm(written(best(open_(far, tried), ("u", "v")), "best-far-nodes"), "far-node-links")
    # What may still be linked: nodes with a pair of the second pass, and those of regions that the look may have cut.
    likely = far.select(F.col("u").alias("node")).union(far.select(F.col("v").alias("node"))).distinct()
    likely = likely.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    crowd = written(_crowded(current(), cut).union(likely).distinct(), "crowd")
    if not crowd.isEmpty():
        sets = _sets(crowd, nodes, docs, id_col, text_col, size, "crowd")
        pairs = written(_exact(crowd, sets, percent), "crowd-pairs")
        tried = written(best(pairs), "best-crowd")
        labels = confirm(tried, "crowd-links")
        labels = confirm(written(open_(pairs, tried).select("u", "v"), "crowd-rest"), "crowd-rest-links")
    named = nodes.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc", "text_key")
    top = named.groupBy("comp").agg(least.alias("top"))
    classes = named.select("node", "comp").join(top, "comp").select("node", "top")
    out = signed.select("doc", "text_key", "n", "node").join(classes, "node", "left")
    own = F.col("node").isNull()
    return out.select("doc", "text_key", "n", F.when(own, F.col("doc")).otherwise(F.col("top.doc")).alias("component"),
                      (own | (F.col("doc").eqNullSafe(F.col("top.doc")) & (F.col("text_key") == F.col("top.text_key")))).alias("stays"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: n_shingles, component_id and kept (its id is the component's)."""
    out = components(docs, id_col, text_col, size, percent)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component; same columns."""
    stays = components(docs, id_col, text_col, size, percent).where("stays").select("doc", "text_key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
                       F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"))
    kept = rows.join(stays, F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("text_key")), "left_semi")
    kept = kept.dropDuplicates(["id", "key"])
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
