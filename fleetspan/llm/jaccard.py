"""N-gram Jaccard join by prefix trees.

A text's set holds the 64-bit hashes of its word shingles; sets are put in one global order, rare shingles
first.  Texts with equal sets form one class.  Two sets that are similar enough share a shingle among the
first ones of both (prefix filter), so each class sends only these to shards, packed.  In a shard, the
classes under one shingle fall apart where, in the order of their sizes, one is too small for the next; a
class by itself is done.  The classes of such a part are first compared with a centre, the class of the most
frequent shingles, which links a crowd of near copies in linear work.  Classes of one part that are then still in different
components are compared with each other, in blocks if they are many.  Every comparison passes two exact
bounds first: sizes, and the least symmetric difference that parity signatures leave possible.

Remaining pairs are decided exactly: the partners of a probe are stored in a prefix tree in the global order
and the tree is walked with the probe; branches share the overlap counted so far, and a branch is left as
soon as the remaining lengths can't reach the overlap needed.

Texts without words have empty sets and are linked with nothing; texts with fewer words than a shingle have
one shingle of all their words.  Null ids never name a component, unless it has no other.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import free, kept, new_folder, small
from fleetspan.llm.kneser_ney import mapped, pack, store, unpack

SHINGLE = 5
# Similarity is at least PERCENT / 100.
PERCENT = 75
CHUNK_WORDS = 300_000
FLUSH_SHINGLES = 4_000_000
# A shingle met so often in one task counts as frequent and comes last in the order.
OFTEN = 4
# More classes under one shingle are compared in blocks of this size.
BLOCK = 3000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, given the hashes of its words."""
    n = len(words)
    width = min(n, SHINGLE)
    if not n:
        return np.zeros(0, np.uint64)
    value = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i])
    return np.unique(value)


def set_chunks(batches):
    """``(batch, first row, sets)`` of some rows at a time."""
    for batch in batches:
        texts, at = batch.column("text"), 0
        while at < len(batch):
            words, ends, begin = [], [0], at
            while at < len(batch) and (len(words) < CHUNK_WORDS or at == begin):
                words += (texts[at].as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                ends.append(len(words))
                at += 1
            coded = pa.array(words, pa.binary()).dictionary_encode()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            flat = hashes[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
            yield batch, begin, [shingles(flat[a:b]) for a, b in zip(ends, ends[1:])]


def sets_of(batches):
    """``(batch, row number, set)`` of every row."""
    for batch, begin, sets in set_chunks(batches):
        for i, own in enumerate(sets):
            yield batch, begin + i, own


# Classes of equal sets, and frequent shingles

FIRST = "is_row boolean, doc_id {kind}, ticket long, n long, node long"


def _classes(kind: pa.DataType):
    def run(batches):
        rows, seen, size = [], [], 0

        def packed():
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([True] * len(rows)), pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["is_row", "doc_id", "ticket", "n", "node"])

        def frequent():
            tokens, counts = np.unique(np.concatenate(seen), return_counts=True)
            often = counts >= OFTEN
            tokens, counts = tokens[often].view(np.int64), counts[often]
            none = pa.nulls(len(tokens))
            return pa.RecordBatch.from_arrays(
                [pa.array([False] * len(tokens), pa.bool_()), none.cast(kind), pa.array(tokens), pa.array(counts), none.cast(pa.int64())], names=["is_row", "doc_id", "ticket", "n", "node"])

        for batch, i, own in sets_of(batches):
            node = xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63 if len(own) else None
            rows.append((batch.column("doc_id")[i].as_py(), batch.column("ticket")[i].as_py(), len(own), node))
            seen.append(own)
            size += len(own)
            if len(rows) == 5000:
                yield packed()
                rows = []
            if size > FLUSH_SHINGLES:
                yield frequent()
                seen, size = [], 0
        if rows:
            yield packed()
        if seen:
            yield frequent()

    return run


class Frequencies:
    """Frequent shingles with their counts, stored sorted by hash ranges in the shared folder."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.opened = folder, shards, {}

    def __getstate__(self):
        return {"folder": self.folder, "shards": self.shards, "opened": {}}

    def _arrays(self, shard: int):
        if shard not in self.opened:
            try:
                self.opened[shard] = (mapped(self.folder, f"often-{shard}", np.uint64), mapped(self.folder, f"times-{shard}", np.uint64))
            except FileNotFoundError:
                self.opened[shard] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        return self.opened[shard]

    def shard(self, tokens: np.ndarray) -> np.ndarray:
        return ((tokens >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of sorted tokens, 0 for rare ones."""
        found = np.zeros(len(tokens), np.uint64)
        shards = self.shard(tokens)
        edges = np.searchsorted(shards, np.unique(shards)).tolist() + [len(tokens)]
        for begin, end in zip(edges, edges[1:]):
            known, counts = self._arrays(int(shards[begin]))
            if len(known):
                place = np.minimum(np.searchsorted(known, tokens[begin:end]), len(known) - 1)
                hit = known[place] == tokens[begin:end]
                found[begin:end][hit] = counts[place[hit]]
        return found

    def ordered(self, batches):
        """``(batch, row number, set in the global order, counts)`` of every row; lookups by chunk."""
        for batch, begin, sets in set_chunks(batches):
            flat = np.concatenate(sets)
            place = np.argsort(flat)
            times = np.empty(len(flat), np.uint64)
            times[place] = self.of(flat[place])
            ends = np.cumsum([0, *map(len, sets)])
            for i, own in enumerate(sets):
                counts = times[ends[i] : ends[i + 1]]
                order = np.argsort(counts, kind="stable")  # sets are sorted by hash already
                yield batch, begin + i, own[order], counts[order]


def _store_frequent(frequencies: Frequencies):
    def run(key, table):
        shard = key[0].as_py()
        tokens = table.column("token").to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        store(frequencies.folder, f"often-{shard}", tokens[order])
        store(frequencies.folder, f"times-{shard}", table.column("times").to_numpy().astype(np.uint64)[order])
        return pa.table({"stored": [len(tokens)]})

    return run


# Prefixes to shards


def signature(own: np.ndarray) -> np.ndarray:
    """Parity of the set's members per hash slot; a power of two of slots, at least four for a member."""
    bits = max(512, 4 << int(len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def least_difference(left: np.ndarray, right: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets from their signatures."""
    if len(left) < len(right):
        left, right = right, left
    folded = np.bitwise_xor.reduce(left.reshape(-1, len(right)), axis=0)
    return int(np.bitwise_count(folded ^ right).sum())


def possible(n: int, m: int) -> bool:
    return 100 * min(n, m) >= PERCENT * max(n, m)


def similar(overlap: int, n: int, m: int) -> bool:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def overlap_needed(n: int, m: int) -> int:
    return -(-PERCENT * (n + m) // (100 + PERCENT))


PACKED = {"tokens": np.uint64, "places": np.int32, "nodes": np.int64, "sizes": np.int32, "scores": np.uint8}
SECOND = f"shard int, {', '.join(f'{name} binary' for name in PACKED)}, node long, n long, sig binary"


def _prefixes(frequencies: Frequencies):
    names = [part.split()[0] for part in SECOND.split(", ")]

    def run(batches):
        infos, parts, size = [], [], 0

        def info_rows():
            none, columns = pa.nulls(len(infos)), list(zip(*infos))
            return pa.RecordBatch.from_arrays(
                [none.cast(pa.int32()), *[none.cast(pa.binary())] * len(PACKED), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=names)

        def blobs():
            tokens = np.concatenate([p[0] for p in parts])
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            of_parts = [np.array([p[i] for p in parts], kind) for i, kind in enumerate(list(PACKED.values())[2:], 1)]
            shards = frequencies.shard(tokens)
            order = np.lexsort((tokens, shards))
            edges = np.flatnonzero(np.append(True, np.diff(shards[order]) != 0)).tolist() + [len(order)]
            for begin, end in zip(edges, edges[1:]):
                at = order[begin:end]
                none = pa.nulls(1)
                # What belongs to a class is sent once, and its place with every shingle.
                here, places = np.unique(owner[at], return_inverse=True)
                columns = (tokens[at], places.astype(np.int32), *(x[here] for x in of_parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shards[at[0]])], pa.int32()), *(pa.array([pack(x)], pa.binary()) for x in columns), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary())], names=names)

        for batch, i, ordered, times in frequencies.ordered(batches):
            n, node = len(ordered), batch.column("node")[i].as_py()
            score = min(255, int(8 * np.log2(times.astype(float) + 1).mean()))
            parts.append((ordered[: n + (-PERCENT * n // 100) + 1], node, n, score))
            infos.append((node, n, signature(ordered).tobytes()))
            size += len(parts[-1][0])
            if len(infos) == 2000:
                yield info_rows()
                infos = []
            if size > FLUSH_SHINGLES // 2:
                yield from blobs()
                parts, size = [], 0
        if infos:
            yield info_rows()
        if parts:
            yield from blobs()

    return run


def size_parts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the parts of rows sorted by shingle and size: sets of two parts can't be similar.

    Between neighbours of impossible sizes all smaller sets are too small for all larger ones.
    """
    if not len(tokens):
        return np.zeros(0, np.int64)
    apart = (tokens[1:] != tokens[:-1]) | (100 * sizes[:-1] < PERCENT * sizes[1:])
    return np.cumsum(np.append(0, apart))


def _shard_groups(key, table):
    """Members of shingles that several classes of possible sizes have, and pairs of every member with its centre."""
    blobs = [[unpack(table.column(name)[i].as_py(), kind) for name, kind in PACKED.items()] for i in range(len(table))]
    tokens = np.concatenate([blob[0] for blob in blobs])
    nodes, sizes, scores = (np.concatenate([blob[i][blob[1]] for blob in blobs]) for i in (2, 3, 4))
    del blobs
    sizes = sizes.astype(np.int64)
    order = np.lexsort((nodes, sizes, tokens))
    tokens, nodes, sizes, scores = tokens[order], nodes[order], sizes[order], scores[order]
    again = np.append(False, (tokens[1:] == tokens[:-1]) & (nodes[1:] == nodes[:-1]))  # equal rows of the table
    tokens, nodes, sizes, scores = tokens[~again], nodes[~again], sizes[~again], scores[~again]
    part = size_parts(tokens, sizes)
    several = np.bincount(part)[part] > 1 if len(part) else np.zeros(0, bool)
    tokens, nodes, sizes, scores, part = (x[several] for x in (tokens, nodes, sizes, scores, part))
    # The first part of a shingle keeps its name.
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(part)))
    further = np.append(False, tokens[edge][1:] == tokens[edge][:-1]) if len(edge) else np.zeros(0, bool)
    names = np.where(further, _mixed(tokens[edge] ^ _mixed(sizes[edge].astype(np.uint64))), tokens[edge])
    order = np.lexsort((nodes, scores, part))
    centre, most = (np.repeat(x[order][edge + count - 1], count) for x in (nodes, sizes))  # the last has the highest score
    a, b = nodes, centre
    met = (a != b) & (100 * np.minimum(sizes, most) >= PERCENT * np.maximum(sizes, most))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, met], axis=1) if met.any() else np.zeros((2, 0), np.int64)
    members = np.repeat(names, count).view(np.int64)
    return pa.table({"is_pair": np.append(np.ones(pairs.shape[1], bool), np.zeros(len(members), bool)), "a": np.append(pairs[0], members), "b": np.append(pairs[1], a)})


# Bounds and exact comparison


def _bounded(batches):
    """Pairs that sizes and signatures leave possible."""
    for batch in batches:
        good = []
        for n, m, left, right in zip(*(batch.column(c) for c in ("n_a", "n_b", "sig_a", "sig_b"))):
            n, m = n.as_py(), m.as_py()
            most = n + m - 2 * overlap_needed(n, m)
            good.append(possible(n, m) and least_difference(np.frombuffer(left.as_buffer(), np.uint8), np.frombuffer(right.as_buffer(), np.uint8)) <= most)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def tree_overlaps(probe: np.ndarray, sets: list, step: int = 64) -> list:
    """Overlaps of ``probe`` with ``sets`` (all in the global order), -1 where it can't be enough.

    Sets in lexicographic order are the paths of a prefix tree from left to right.  Along a path the overlap
    is counted once for all sets below; a path ends where the remaining lengths are too short.
    """
    known = np.sort(probe)

    def hits(tokens):
        place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        return known[place] == tokens

    found = [-1] * len(sets)
    path, counted = np.zeros(0, np.uint64), np.zeros(1, np.int64)
    for i in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()):
        own = sets[i]
        n, need = len(own), overlap_needed(len(probe), len(own))
        shared = min(len(path), n)
        differ = np.flatnonzero(path[:shared] != own[:shared])
        depth = int(differ[0]) if len(differ) else shared
        counts = [counted[: depth + 1]]
        total = int(counted[depth])
        while depth < n and total + min(n - depth, len(probe) - total) >= need:
            new = np.cumsum(hits(own[depth : depth + step])) + total
            counts.append(new)
            depth, total = depth + len(new), int(new[-1])
        path, counted = own[:depth], np.concatenate(counts)
        if depth == n and total >= need:
            found[i] = total
    return found


def _send_sets(frequencies: Frequencies):
    def run(batches):
        for batch, i, ordered, _ in frequencies.ordered(batches):
            node, data = batch.column("node")[i].as_py(), pa.array([ordered.tobytes()], pa.binary())
            for to in batch.column("_to")[i].as_py():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([to["part"]], pa.int64()), pa.array([to["probe"]], pa.int64()), pa.array([node], pa.int64()), data], names=["part", "probe", "node", "tokens"])

    return run


def _decide(batches):
    """Links of probes; rows come sorted by probe, a part of its partners at a time with the probe itself."""

    def links(probe, rows):
        sets = dict(rows)  # equal rows of the table send equal sets
        own = sets.pop(probe)
        others = list(sets.items())
        overlaps = tree_overlaps(own, [r[1] for r in others])
        return [(probe, r[0]) for r, o in zip(others, overlaps) if o >= 0 and similar(o, len(own), len(r[1]))]

    current, rows, made = None, [], []
    for batch in batches:
        for key, probe, node, tokens in zip(*(batch.column(c) for c in ("part", "probe", "node", "tokens"))):
            key = (key.as_py(), probe.as_py())
            if key != current and rows:
                made += links(current[1], rows)
                rows = []
            current = key
            rows.append((node.as_py(), np.frombuffer(tokens.as_buffer(), np.uint64)))
    if rows:
        made += links(current[1], rows)
    a, b = zip(*made) if made else ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


PARTNERS = 500


def _verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, frequencies: Frequencies) -> DataFrame:
    """Links among candidate pairs ``a, b``.

    ``sets`` has the text of every class as ``node, text``.  The partners of one probe are dealt in parts of
    some ``PARTNERS``, each with the probe.
    """
    info = nodes.select("node", "n", "sig")
    left, right = (info.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "sig")]) for s in "ab")
    met = pairs.join(left, F.col("a") == F.col("node_a")).join(right, F.col("b") == F.col("node_b"))
    held = kept(met.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_bounded, "a long, b long").distinct(), "jaccard-bounded")
    # The class with more partners is the probe.
    ends = held.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("_n"))
    ends = small(kept(ends, "jaccard-ends"), 24)
    sized = held.join(ends.select(F.col("node").alias("a"), F.col("_n").alias("_a")), "a").join(ends.select(F.col("node").alias("b"), F.col("_n").alias("_b")), "b")
    swap = F.col("_b") > F.col("_a")
    probe, other = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    parts = F.floor(F.greatest("_a", "_b") / PARTNERS) + 1
    dealt = kept(sized.select(probe.alias("probe"), other.alias("node"), F.pmod(F.xxhash64(other), parts).alias("part")), "jaccard-dealt")
    wanted = dealt.unionByName(dealt.select("probe", F.col("probe").alias("node"), "part").distinct())
    per_node = kept(wanted.groupBy(F.col("node").alias("_node")).agg(F.collect_set(F.struct("probe", "part")).alias("_to")), "jaccard-probes")
    width = per_node.agg(F.avg(F.size("_to"))).first()[0] or 0
    texts = sets.join(small(per_node, int(48 + 24 * width)), F.col("node") == F.col("_node"))
    sent = texts.select("text", "node", "_to").mapInArrow(_send_sets(frequencies), "part long, probe long, node long, tokens binary")
    count = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sent.repartition(count, "probe", "part").sortWithinPartitions("part", "probe")
    return kept(ordered.mapInArrow(_decide, "a long, b long"), "jaccard-links")


# Components


def _follow(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``df`` with ``column`` moved on to where ``hooks`` (``u, v``) lead."""
    to = hooks.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return df.join(to, F.col(column) == F.col("_u"), "left").withColumn(column, F.coalesce("_v", column)).drop("_u", "_v")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node in ``links`` (``a, b``); nodes of one component have one root.

    In each round every node hooks onto its smallest neighbour, if that is smaller, hooks are followed some
    steps, and the links are moved along until none is left.  Every round hooks a node of each open component,
    so the loop ends.
    """
    edges = kept(links.where("a <> b").select("a", "b"), "components")
    open_, rounds = edges, []
    while True:
        hooks = kept(open_.groupBy(F.greatest("a", "b").alias("u")).agg(F.min(F.least("a", "b")).alias("v")), "components")
        count = hooks.count()
        if not count:
            break
        direct = small(hooks, 16, count)
        for _ in range(3):
            hooks = _follow(hooks, "v", direct)
        hooks = small(kept(hooks, "components"), 16, count)
        rounds.append(hooks)
        open_ = kept(_follow(_follow(open_, "a", hooks), "b", hooks).where("a <> b").distinct(), "components")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for hooks in rounds:
        nodes = _follow(nodes, "root", hooks)
    return nodes


# Classes under one shingle that are in different components


def _cross(batches):
    """Pairs from different components within a group, as far as sizes and signatures leave them possible.

    Where a group is dealt in blocks, rows of one task carry the pair of blocks that it compares.
    """

    def survivors(rows):
        rows.sort(key=lambda r: r[2])
        sizes = np.array([r[2] for r in rows])
        roots = np.array([r[1] for r in rows])
        side = np.array([r[4] for r in rows])
        # Signatures grow with the sets.  A pair of possible sizes has signatures of one length or of twice that
        # length, so each length is a level of its own: a short text doesn't blur the signatures of long ones.
        lengths = np.array([len(r[3]) for r in rows])
        made = []
        for length in np.unique(lengths):
            begin, own, end = np.searchsorted(lengths, [length, length + 1, 2 * length + 1])
            words = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[3], np.uint8).reshape(-1, length), axis=0) for r in rows[begin:end]]).view(np.uint64)
            for i in range(begin, own):
                last = min(np.searchsorted(sizes, sizes[i] * 100 // PERCENT, side="right"), end)
                js = np.arange(i + 1, last)
                js = js[(roots[js] != roots[i]) & ((side[js] != side[i]) | (side[i] == 0))]
                if len(js):
                    n = sizes[i] + sizes[js]
                    most = n - 2 * -(-PERCENT * n // (100 + PERCENT))
                    near = np.bitwise_count(words[js - begin] ^ words[i - begin]).sum(axis=1) <= most
                    for j in js[near]:
                        made.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
        return made

    current, rows, made = None, [], set()
    for batch in batches:
        for token, p, q, node, root, n, sig, block in zip(*(batch.column(c).to_pylist() for c in ("token", "p", "q", "node", "root", "n", "sig", "block"))):
            if (token, p, q) != current and rows:
                made.update(survivors(rows))
                rows = []
            current = (token, p, q)
            rows.append((node, root, n, sig, 0 if p == q else 1 + (block == q)))
            if len(made) > 100_000:
                yield _pairs(made)
                made = set()
    if rows:
        made.update(survivors(rows))
    yield _pairs(made)


def _pairs(made) -> pa.RecordBatch:
    a, b = zip(*made) if made else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _open_pairs(members: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate pairs of classes that share a shingle but no component yet."""
    held = small(roots, 16).withColumnRenamed("node", "_node")
    placed = kept(members.join(held, F.col("node") == F.col("_node"), "left").select("token", "node", F.coalesce("root", "node").alias("root")), "jaccard-placed")
    groups = placed.groupBy("token").agg(
        F.count("*").alias("_size"), F.min("root").alias("_low"), F.max("root").alias("_high"),
        F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("_y")).where("_low <> _high")
    # Shingles with the same classes are one group.
    groups = groups.groupBy("_size", "_x", "_y").agg(F.min("token").alias("token")).select("token", "_size")
    groups = kept(groups, "jaccard-groups")
    open_ = placed.join(small(groups, 24), "token")
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    dealt = open_.withColumn("_blocks", blocks).withColumn("block", mine).select(
        "token", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select("token", "node", "root", "block", F.least("block", "_other").alias("p"), F.greatest("block", "_other").alias("q"))
    count = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(nodes, "node").repartition(count, "token", "p", "q").sortWithinPartitions("token", "p", "q")
    found = met.select("token", "p", "q", "node", "root", "n", "sig", "block").mapInArrow(_cross, "a long, b long")
    return kept(found.distinct(), "jaccard-open")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``; and ``class_size``, the rows with an equal set.

    ``ticket`` is a hash of the whole row and ``root`` names the component (null for an empty set).
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.xxhash64(*docs.columns).alias("ticket"), "text")
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.string() if kind.simpleString() == "string" else pa.int32()
    first = kept(rows.mapInArrow(_classes(arrow), FIRST.format(kind=kind.simpleString())), "jaccard-classes")
    narrow = first.where("is_row").select("doc_id", "ticket", "n", "node")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequencies = Frequencies(new_folder(spark, "jaccard-often"), shards)
    often = first.where("not is_row").groupBy(F.col("ticket").alias("token")).agg(F.sum("n").alias("times"))
    ranged = often.withColumn("shard", F.shiftright(F.shiftrightunsigned("token", 32) * shards, 32))
    kept(ranged.groupBy("shard").applyInArrow(_store_frequent(frequencies), "stored long"), "jaccard-often")
    reps = kept(narrow.where("node is not null").groupBy("node").agg(F.min("ticket").alias("_ticket"), F.count("*").alias("class_size")), "jaccard-reps")
    held = small(reps.select("node", "_ticket"), 24)
    sets = rows.join(held, F.col("ticket") == F.col("_ticket")).select("node", "text")
    second = kept(sets.mapInArrow(_prefixes(frequencies), SECOND), "jaccard-prefixes")
    nodes = second.where("node is not null").select("node", "n", "sig")
    grouped = second.where("shard is not null").select("shard", *PACKED).groupBy("shard").applyInArrow(_shard_groups, "is_pair boolean, a long, b long")
    grouped = kept(grouped, "jaccard-members")
    stars = kept(grouped.where("is_pair").select("a", "b").distinct(), "jaccard-stars")
    links = _verified(stars, sets, nodes, frequencies)
    members = grouped.where("not is_pair").select(F.col("a").alias("token"), F.col("b").alias("node"))
    rest = _open_pairs(members, kept(components(links), "jaccard-roots"), nodes)
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, sets, nodes, frequencies))
    roots = kept(components(links), "jaccard-roots")
    named = narrow.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("_least"))
    sizes = reps.select(F.col("node").alias("_node"), "class_size")
    return (
        named.join(least, F.col("root") == F.col("_root"), "left")
        .join(sizes, F.col("node") == F.col("_node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "ticket", "root")
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: the smallest id, ids before null; empty sets all stay."""
    found = kept(jaccard_components(docs).where("root is not null").select("doc_id", "ticket", "root"), "jaccard-components")
    own, other = free(docs, "_own", "_ticket")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "ticket")
    first = found.groupBy("root").agg(F.min(order).alias("_first")).select(F.col("_first.ticket").alias("ticket"))
    gone = kept(found.select("ticket").distinct().join(first, "ticket", "left_anti").select(F.col("ticket").alias(other)), "jaccard-gone")
    # Rows that are equal in all columns share a ticket; one of them stays.
    equal = kept(found.groupBy("ticket").count().where("count > 1").select(F.col("ticket").alias(other)), "jaccard-equal")
    marked = docs.withColumn(own, F.xxhash64(*docs.columns))
    stay = marked.join(small(gone, 16), F.col(own) == F.col(other), "left_anti")
    if equal.isEmpty():
        return stay.drop(own)
    several = small(equal, 16)
    single = stay.join(several, F.col(own) == F.col(other), "left_anti")
    one = stay.join(several, F.col(own) == F.col(other), "left_semi").dropDuplicates([own])
    return single.unionByName(one).drop(own)
