"""Op 9: n-gram Jaccard join by a MinHash LSH forest with exact verification.

Equal texts are one node. Every node gets TREES labels of DEPTH min-hashes. The
labels of a tree, in sorted order, are a prefix trie: the nodes below a prefix are a
run of neighbours, found by comparing each label with the next. The sorted labels are
dealt by range, so a long run lies over several tasks, and only labels that share
FLOOR min-hashes with a neighbour are kept.

Each node then shortens its matched prefixes, level by level from DEPTH, until the
texts similar to it are found with TARGET_RECALL. A tree in which the run below the
shortened prefix has more than CROWD nodes is left at a longer prefix for as long as
the other trees can make up for it; that many such trees also tell how much of the
text is common matter, which makes the others less likely to match (`recall`). Where
they can't make up for it the crowded runs are searched as well, in blocks.

Candidates whose signatures could belong to similar texts are tied into groups;
inside a group every pair of nodes is compared once, exactly, on its shingle
sets, in blocks of bounded size. Pairs are never emitted: a block returns each
node's number of links and a spanning star of every linked set.

Shingles are five words; the threshold is a Jaccard similarity of 0.8.

Defined results: a null text is an empty text; texts without words have no
shingles and are linked to equal texts only; repeated rows and ties are copies of
one another; rows with a null doc_id are classified like others but never name a
class while a row with an id is in it; an empty table gives no rows; other input
columns are ignored by `similar_documents` and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import shingles
from barloom.llm.common import cut_lineage, join_by_weight, read_table
from barloom.llm.components import components

THRESHOLD = 0.8
TREES, DEPTH = 24, 8
TARGET_RECALL = 0.9999
#: Nodes of a run from which on a tree is crowded.
CROWD = 512
#: Candidates are tied if so large a share of their signatures is equal; more than five standard deviations below the threshold.
TIE_SHARE = 0.6
#: Nodes of a block; two blocks meet in one task.
BLOCK = 256
#: Shingles of a block, about.
BLOCK_SHINGLES = 2_000_000
#: Members of a run that are compared in one task.
BUCKET_BLOCK = 512
#: Shingle columns of one step of a block comparison.
COLUMNS = 4096


def recall(depth: int, crowded: int = 0) -> float:
    """Probability that a text at the threshold shares a prefix in one of the trees that are not crowded.

    Crowded trees are those whose prefix is of common matter alone, so their share estimates the chance of that; what
    is left of the chance to agree is spread over the others.
    """
    common = crowded / TREES
    if common >= THRESHOLD**depth:
        return 0.0
    return 1 - (1 - (THRESHOLD**depth - common) / (1 - common)) ** (TREES - crowded)


def _enough() -> int:
    """The longest prefix that is short enough where no tree is crowded."""
    return max((d for d in range(1, DEPTH + 1) if recall(d) >= TARGET_RECALL), default=1)


#: The shortest prefix that makes up for crowded trees.
FLOOR = max(1, _enough() - 1)


def _multipliers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return shingles.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


MULTIPLIERS = _multipliers()


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Min-hashes (texts x TREES*DEPTH, the last 16 bits) and shingle counts; rows without shingles are zero."""
    hashes, bounds = shingles.shingle_hashes(column)
    counts = np.diff(bounds)
    out = np.zeros((len(counts), len(MULTIPLIERS)), np.uint16)
    full = np.flatnonzero(counts)
    if len(full):
        with np.errstate(over="ignore"):
            for j, m in enumerate(MULTIPLIERS):
                out[full, j] = np.minimum.reduceat(((hashes * m) >> np.uint64(32)).astype(np.uint32), bounds[:-1][full]).astype(np.uint16)
    return out, counts


_NODE = "node_key binary, doc_id long, text_hash long, n_shingles long, signature binary"


def _nodes(batches):
    for batch in shingles.small_batches(batches):
        texts = batch.column("text")
        sig, counts = signatures(texts)
        keys = [hashlib.blake2b(t.encode("utf-8") if t else b"", digest_size=16).digest() for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary())],
            names=["node_key", "doc_id", "text_hash", "n_shingles", "signature"],
        )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per distinct text: node (a hash of node_key), node_key, least doc_id, text_hash, copies, n_shingles, signature."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = src.mapInArrow(_nodes, _NODE)
    grouped = rows.groupBy("node_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("text_hash").alias("text_hash"),
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
    )
    return grouped.select(F.xxhash64("node_key").alias("node"), "node_key", "doc_id", "text_hash", "copies", "n_shingles", "signature")


def _labels(batches):
    """tree, label, node: a label is the tree's min-hashes, most significant byte first, so labels sort as a trie."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, DEPTH)
        if not len(sig):
            continue
        labels = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), len(sig), [None, pa.py_buffer(sig.astype(">u2").tobytes())])
        tree = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
        node = np.repeat(batch.column("node").to_numpy(), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(tree), labels.cast(pa.binary()), pa.array(node)], names=["tree", "label", "node"])


def _matched(batches):
    """node, tree, depth, bucket: every prefix of FLOOR or more min-hashes that a label shares with a neighbour in the sorted order.

    The first and the last label of a task count as matched, as their neighbours are in other tasks.
    """

    def prefixes(tree, label, node, depth):
        with np.errstate(over="ignore"):
            key = shingles.mix(tree.astype(np.uint64) + np.uint64(1))
            for d in range(1, DEPTH + 1):
                key = shingles.mix(key * np.uint64(0xD6E8FEB86659FD93) + label[:, d - 1])
                own = depth >= d
                if d >= FLOOR and own.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[own]), pa.array(tree[own]), pa.array(np.full(int(own.sum()), d, np.int32)), pa.array(key[own].view(np.int64))],
                        names=["node", "tree", "depth", "bucket"],
                    )

    held, before = None, DEPTH
    for batch in batches:
        if not batch.num_rows:
            continue
        own = (
            batch.column("tree").to_numpy(),
            np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, DEPTH).astype(np.uint64),
            batch.column("node").to_numpy(),
        )
        tree, label, node = own if held is None else (np.concatenate([h, o]) for h, o in zip(held, own))
        same = np.logical_and.accumulate((label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
        # The last one waits for its next neighbour.
        yield from prefixes(tree[:-1], label[:-1], node[:-1], np.maximum(same, np.append(before, same[:-1])[: len(same)]))
        held, before = (tree[-1:], label[-1:], node[-1:]), same[-1] if len(same) else before
    if held is not None:
        yield from prefixes(*held, np.array([DEPTH]))


def shortened(trees: list[int], depths: list[int], sizes: list[int]) -> list[int]:
    """Positions of the prefixes (tree, depth, nodes below) of one node at which it stops shortening."""
    for depth in range(DEPTH, FLOOR - 1, -1):
        crowded = {t for t, d, n in zip(trees, depths, sizes) if d == depth and n > CROWD}
        if recall(depth, len(crowded)) >= TARGET_RECALL:
            longer: dict[int, int] = {}
            for k, (t, d, n) in enumerate(zip(trees, depths, sizes)):
                if t in crowded and d > depth and n <= CROWD and (t not in longer or d < depths[longer[t]]):
                    longer[t] = k
            return [k for k, (t, d) in enumerate(zip(trees, depths)) if d == depth and t not in crowded] + list(longer.values())
    return [k for k, d in enumerate(depths) if d == _enough()]


def _stops(batches):
    for batch in batches:
        out = []
        for found in batch.column("found").to_pylist():
            kept = shortened([f["tree"] for f in found], [f["depth"] for f in found], [f["size"] for f in found])
            out.extend(found[k]["bucket"] for k in kept)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(out, np.int64)))], names=["bucket"])


def _tie(nodes: np.ndarray, short: np.ndarray) -> list[tuple[int, int]]:
    """Spanning stars of the sets of nodes whose signatures agree enough, directly or through others."""
    nodes, first = np.unique(nodes, return_index=True)
    short = short[first]
    need = TIE_SHARE * short.shape[1]
    left, edges = np.arange(len(nodes)), []
    # Breadth-first over the similarity graph: each step compares one frontier node to all that are still free.
    while len(left) > 1:
        root, frontier = left[0], [left[0]]
        left = left[1:]
        while frontier and len(left):
            near = (short[left] == short[frontier.pop()]).sum(axis=1) >= need
            found = left[near]
            left = left[~near]
            frontier.extend(found.tolist())
            edges.extend((int(nodes[root]), int(nodes[x])) for x in found)
    return edges


def grouped(batches, keys: list[str]):
    """(key, list of batch slices) of each run of equal keys in a sorted stream of Arrow batches."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            key = tuple(int(c[start]) for c in cols)
            if key != held_key and held:
                yield held_key, held
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield held_key, held


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _ties(batches):
    pending = []
    for _, parts in grouped(batches, ["bucket", "i", "j"]):
        nodes = np.concatenate([p.column("node").to_numpy() for p in parts])
        if len(nodes) > 1:
            raw = b"".join(x for p in parts for x in p.column("short").to_pylist())
            pending.extend(_tie(nodes, np.frombuffer(raw, np.uint8).reshape(len(nodes), -1)))
        if len(pending) > 50_000:
            yield _edges(pending)
            pending = []
    if pending:
        yield _edges(pending)


def candidate_runs(nodes: DataFrame) -> DataFrame:
    """bucket, node, size: the members of every run at which a node stops shortening; of runs with the same members one."""
    with_words = nodes.where("n_shingles > 0").select("node", "signature")
    labels = with_words.mapInArrow(_labels, "tree int, label binary, node long")
    forest = labels.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    prefixes = cut_lineage(forest.mapInArrow(_matched, "node long, tree int, depth int, bucket long"))
    total = prefixes.count()
    sizes = prefixes.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("size > 1")
    sizes = cut_lineage(sizes)
    sized = join_by_weight(prefixes, sizes.drop("members"), ["bucket"], "size", total)
    # A node has TREES * (DEPTH - FLOOR + 1) prefixes at most.
    by_node = sized.groupBy("node").agg(F.collect_list(F.struct("tree", "depth", "size", "bucket")).alias("found"))
    stops = by_node.select("found").mapInArrow(_stops, "bucket long").distinct()
    used = sizes.join(stops, "bucket").groupBy("size", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return join_by_weight(prefixes.select("bucket", "node"), used, ["bucket"], "size", total)


def candidate_ties(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that span every set of nodes connected by plausible candidate pairs."""
    runs = candidate_runs(nodes)
    # One byte of each min-hash is enough to tell apart texts that are far from similar.
    short = nodes.where("n_shingles > 0").select("node", "signature").mapInArrow(_shorten, "node long, short binary")
    # A large run is split into pairs of blocks.
    parts = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    placed = runs.select("bucket", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("mine"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("bucket", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = placed.join(short, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_ties, "a long, b long").distinct()


def _shorten(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
        small = (sig & np.uint16(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in small], pa.binary())], names=["node", "short"])


#: Nodes that a task remembers to have made the set of; a set made twice does no harm.
SEEN = 1_000_000


def _shingle_sets(batches):
    """Shingle sets of nodes, from rows whose text is the node's own; equal rows that follow each other closely once."""
    seen = set()
    for batch in batches:
        if len(seen) > SEEN:
            seen.clear()
        keep = []
        for node, key, text in zip(*(batch.column(c).to_pylist() for c in ("node", "node_key", "text"))):
            fresh = node not in seen and hashlib.blake2b(text.encode("utf-8"), digest_size=16).digest() == key
            seen.update((node,) if fresh else ())
            keep.append(fresh)
        kept = batch.filter(pa.array(keep, pa.bool_()))
        for sub in shingles.small_batches([kept]):
            hashes, bounds = shingles.shingle_hashes(sub.column("text"))
            sets = [np.unique(hashes[bounds[i] : bounds[i + 1]]).tobytes() for i in range(sub.num_rows)]
            yield pa.RecordBatch.from_arrays([sub.column("node"), sub.column("root"), sub.column("copies"), pa.array(sets, pa.binary())], names=["node", "root", "copies", "shingles"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of every left and every right set, by products of incidence matrices of bounded width."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    rows_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    for start in range(0, len(common), COLUMNS):
        some = common[start : start + COLUMNS]
        grids = []
        for values, rows, n in ((a, rows_a, len(left)), (b, rows_b, len(right))):
            at = np.searchsorted(some, values)
            at[at == len(some)] = 0
            hit = some[at] == values
            grid = np.zeros((n, len(some)), np.float32)
            grid[rows[hit], at[hit]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


_LINKS = "node long, links long, texts long, peer long"


def compare(own: list[tuple], other: list[tuple] | None) -> list[tuple[int, int, int, int]]:
    """Exact links among nodes (node, copies, set), or between two lists of them.

    Rows are (node, linked documents, linked texts, peer): one with the counts of
    each linked node, and more with zero counts whose peers span linked sets.
    """
    apart = other is not None
    other = other if apart else own
    if not own or not other or not apart and len(own) < 2:
        return []
    both = intersections([x[2] for x in own], [x[2] for x in other]).astype(np.float64)
    sizes = [np.array([len(x[2]) for x in side], np.float64) for side in (own, other)]
    linked = both >= THRESHOLD * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6
    if not apart:
        np.fill_diagonal(linked, False)
    nodes = [np.array([x[0] for x in side], np.int64) for side in (own, other)]
    copies = [np.array([x[1] for x in side], np.int64) for side in (own, other)]
    out = []
    for me, they, grid in ((0, 1, linked), *(((1, 0, linked.T),) if apart else ())):
        for r in np.flatnonzero(grid.any(axis=1)).tolist():
            peers = np.flatnonzero(grid[r])
            out.append((int(nodes[me][r]), int(copies[they][peers].sum()), len(peers), int(nodes[they][peers[0]])))
    out.extend((int(a), 0, 0, int(b)) for a, b in _span(linked, nodes[0], nodes[1]))
    return out


def _compared(batches):
    pending = []
    for (_, i, j), parts in grouped(batches, ["root", "i", "j"]):
        sides: dict[int, dict[int, tuple]] = {}
        for p in parts:
            for node, copies, block, raw in zip(*(p.column(c).to_pylist() for c in ("node", "copies", "block", "shingles"))):
                sides.setdefault(block, {})[node] = (node, copies, np.frombuffer(raw, np.uint64))
        own = list(sides.get(i, {}).values())
        pending.extend(compare(own, None if i == j else list(sides.get(j, {}).values())))
        if len(pending) > 20_000:
            yield _link_rows(pending)
            pending = []
    if pending:
        yield _link_rows(pending)


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["node", "links", "texts", "peer"])


def _span(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray):
    """Edges of a spanning forest of a bipartite adjacency matrix."""
    free_r, free_c = np.ones(len(rows), bool), np.ones(len(cols), bool)
    for r in range(len(rows)):
        if not free_r[r]:
            continue
        free_r[r] = False
        frontier = [(True, r)]
        while frontier:
            is_row, at = frontier.pop()
            if is_row:
                found = np.flatnonzero(linked[at] & free_c)
                free_c[found] = False
                yield from ((rows[at], cols[x]) for x in found)
                frontier.extend((False, x) for x in found.tolist())
            else:
                found = np.flatnonzero(linked[:, at] & free_r)
                free_r[found] = False
                yield from ((cols[at], rows[x]) for x in found)
                frontier.extend((True, x) for x in found.tolist())


def exact_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, links, texts, peer of all pairs of nodes in one candidate group that are similar."""
    grouped_nodes = nodes.join(groups, "node").select("node", "node_key", "root", "copies", "doc_id", "text_hash", "n_shingles")
    holders = grouped_nodes.select(F.col("doc_id").alias("holder"), F.col("text_hash").alias("held"), "node", "node_key", "root", "copies")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    same = (F.col("text_hash") == F.col("held")) & F.col("doc_id").eqNullSafe(F.col("holder"))
    found = texts.join(holders, same).select("node", "node_key", "root", "copies", "text")
    sets = found.mapInArrow(_shingle_sets, "node long, root long, copies long, shingles binary")
    sizes = grouped_nodes.groupBy("root").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("volume"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int")
    placed = cut_lineage(grouped_nodes.select("node", "root"))
    placed = join_by_weight(placed, sizes.select("root", "size", parts.alias("parts")), ["root"], "size", placed.count()).select("node", "parts")
    placed = sets.join(placed, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("root", "node", "copies", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_compared, _LINKS)


def classify(docs: DataFrame) -> DataFrame:
    """Per distinct text: node_key, copies, root (the class), class_id (its least doc_id), n_links (documents with a similar text), n_texts (other similar texts)."""
    nodes = cut_lineage(distinct_texts(docs))
    groups = cut_lineage(components(candidate_ties(nodes)))
    links = cut_lineage(exact_links(docs, nodes, groups))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    joined = nodes.drop("signature", "text_hash").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = cut_lineage(joined)
    names = joined.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n"))
    return join_by_weight(joined, names, ["root"], "n", joined.count()).select(
        "node_key", "root", "class_id", "class_size", "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )


def _keys(batches):
    for batch in shingles.small_batches(batches):
        keys = [hashlib.blake2b(t.encode("utf-8") if t else b"", digest_size=16).digest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary())], names=["doc_id", "text_hash", "node_key"])


def _classes_of_rows(docs: DataFrame) -> DataFrame:
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash).mapInArrow(_keys, "doc_id long, text_hash long, node_key binary")
    keyed = cut_lineage(keyed)
    return join_by_weight(keyed, cut_lineage(classify(docs)), ["node_key"], "copies", keyed.count())


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, n_links, n_texts."""
    return _classes_of_rows(docs).select("doc_id", "class_id", "class_size", "n_links", "n_texts")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of similar documents, all columns kept: that of the least doc_id.

    Where several rows have it (repeated rows, or a class of rows without ids),
    the one with the least text stays, once.
    """
    rows = cut_lineage(_classes_of_rows(docs).select("doc_id", "text_hash", "root", "class_id"))
    names_class = F.col("doc_id").eqNullSafe(F.col("class_id"))
    going = rows.where(~names_class).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    crowded = rows.where(names_class).groupBy("root").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = rows.where(names_class).join(crowded, "root").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("root").alias("_root")).distinct()
    own = F.col("doc_id").cast("long")
    same = own.eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_hash"))
    packed = docs.join(going, same, "left_anti").select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    marked = packed.join(crowded, same, "left")
    single = marked.where("_root IS NULL").select("_row.*")
    one = marked.where("_root IS NOT NULL").groupBy("_root").agg(F.min_by("_row", F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    return single.unionByName(one)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
