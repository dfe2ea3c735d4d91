"""N-gram Jaccard join with prefix trees.

Every text is a set of 64-bit shingles in one global order. Sets are joined in five steps, and no
step emits pairs of documents or gathers an unbounded group:

1. ``_profile`` reads all texts once: size and digest of each set, the shingles frequent
   within a task, and a sample of all, which finds those that are frequent over all tasks only. Equal
   sets are one class from here on, so exact copies cost nothing more.
2. Frequent shingles go last in the order. It is a hint of bounded size: any order gives
   the same links, this one keeps shared passages out of the prefixes.
3. ``_prefixes`` reads the texts again. Two sets of similarity t or more share a shingle among the
   first n - ceil(t * n) + 1 of each, so only those travel, packed in arrays, with position and
   set size. Shingles known to be frequent are salted into pairs of blocks.
4. ``_groups`` brings the classes that share such a shingle together, drops those that have no
   partner of fitting size and position, cuts large groups into pairs of blocks, and keeps one
   of all groups with the same members. ``_clusters`` compares the members' histograms of hash
   ranges: histograms that differ by more than two linked sets may differ rule a pair out.
   Components of what is left are the clusters; all links lie inside a cluster.
5. ``_join_clusters`` gets the text of each clustered class once, stores the sets in a prefix tree
   and walks it once for each set, sharing partial overlaps between sets with a common beginning and
   pruning subtrees by what can still be added. Sets in the largest component needn't walk. It emits
   the links that connected something. Large clusters are cut into blocks, and each block sees
   some probes of the whole cluster as well, which connects nearly all of it. The sets that are then outside the
   cluster's largest component walk the trees of all its blocks, so no pair of different components
   goes uncompared.

Components of the links, then classes, then documents follow by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm.common import components, give_back, local_roots, materialize, pieces, read_table, small_batches, splitmix
from asofgraph.llm.shingles import shingle_sets

WIDTH = 5
PERCENT = 80
#: At most so many frequent shingles are told to all tasks (16 bytes each); order and salt only, not results.
HOT_LIMIT = 1 << 16
HOT_IN_TASK = 4
HOT_DOCS = 16
#: One of so many pairs of a shingle and a class is counted over all tasks; so often it has to turn up to count as frequent.
SAMPLED = 256
HOT_IN_SAMPLE = 4
#: Shingles that a task gathers before it counts them; memory only.
COUNTED_AT_ONCE = 1 << 19
#: Members of a block of a large group, and shingles of all of them together.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 21
#: Members of a block of a large cluster, and probes of the cluster that each of them sees.
CLUSTER_BLOCK = 256
PROBES = 32
_U = np.uint64


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set."""
    with np.errstate(over="ignore"):
        total = np.concatenate(([_U(0)], np.cumsum(splitmix(hashes + _U(0x51ED270B)), dtype=np.uint64)))
        return splitmix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def _rows(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def histograms(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Counts of each row's hashes by range, one byte each (255: or more), a power of two of them."""
    n = np.diff(at)
    bits = np.clip(np.ceil(np.log2(np.maximum(n, 1) / 6)), 4, 13).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(1 << bits)))
    row = np.repeat(np.arange(len(n)), n)
    place = start[row] + (hashes >> (64 - bits[row]).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=start[-1]), 255).astype(np.uint8).tobytes()
    return [counts[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def may_link(n: np.ndarray, marks: list[bytes], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets that their sizes and histograms don't rule out.

    Linked sets differ by 1.25 in size at most, so their histograms by one halving at most; the
    finer is folded. What two histograms differ by, two sets differ by at least.
    """
    length = np.array([len(m) for m in marks])
    left, right = [], []
    for bins in np.unique(length):
        here, finer = np.flatnonzero(length == bins), np.flatnonzero(length == 2 * bins)
        own = np.frombuffer(b"".join(marks[i] for i in here), np.uint8).reshape(len(here), bins).astype(np.int16)
        other, names = own, here
        if len(finer):
            fold = np.frombuffer(b"".join(marks[i] for i in finer), np.uint8).reshape(len(finer), bins, 2)
            clipped = np.minimum(fold.sum(2, dtype=np.int16), 255)
            other, names = np.concatenate((own, clipped)), np.concatenate((here, finer))
        step = max(1, (1 << 23) // max(1, other.size))
        for a in range(0, len(here), step):
            size, sizes = n[here[a:a + step]][:, None], n[names][None]
            least = least_overlap(size, sizes, percent)
            good = (least <= np.minimum(size, sizes)) & (names[None] > here[a:a + step, None])
            if len(finer):
                good |= (least <= np.minimum(size, sizes)) & (np.arange(len(names)) >= len(here))[None]
            good &= np.abs(own[a:a + step, None] - other[None]).sum(2, dtype=np.int32) <= size + sizes - 2 * least
            i, j = np.nonzero(good)
            left.append(here[a + i])
            right.append(names[j])
    return np.concatenate(left), np.concatenate(right)


_PROFILE = "doc_id long, n long, digest long, token long, docs long, drawn long, marks binary"


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = [], (np.empty(0, np.uint64), np.empty(0, np.int32))
        met: set[int] = set()

        def fold() -> None:
            nonlocal counts
            counts = added(*counts, seen)
            token, total = counts
            if len(token) > 1 << 22:  # a shingle this rare here isn't worth its place
                counts = token[total > 1], total[total > 1]

        waiting = 0
        for batch in pieces(batches, "text"):
            hashes, at = shingle_sets(batch["text"], width)
            digest, n = digests(hashes, at), np.diff(at)
            none = np.full(len(n), None)
            yield _rows(doc_id=batch["doc_id"].cast(pa.int64()), n=n, digest=_signed(digest), token=pa.array(none, pa.int64()), docs=pa.array(none, pa.int64()), drawn=pa.array(none, pa.int64()), marks=pa.array(histograms(hashes, at), pa.binary()))
            new = np.array([not (d in met or met.add(d)) for d in digest.tolist()], bool)
            seen.append(fresh := hashes[np.repeat(new, n)])
            drawn = fresh[splitmix(fresh ^ np.repeat(digest[new], n[new])) % _U(SAMPLED) == 0]
            if len(drawn):
                yield hints(*np.unique(drawn, return_counts=True), sampled=True)
            waiting += len(fresh)
            if waiting > COUNTED_AT_ONCE:
                fold()
                waiting = 0
        if seen:
            fold()
        token, total = counts
        often = total >= HOT_IN_TASK
        if often.any():
            yield hints(token[often], total[often].astype(np.int64), sampled=False)
    return run


def added(token: np.ndarray, total: np.ndarray, seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted tokens and their counts with those of ``seen``, which is emptied.

    What is new is sorted in place and put in between, so no order or inverse of all tokens is held.
    """
    new = np.concatenate(seen)
    seen.clear()
    if not len(new):
        return token, total
    new.sort()
    edge = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1], [True])))
    new, more = new[edge[:-1]], np.diff(edge).astype(total.dtype)
    place = np.searchsorted(token, new)
    known = np.zeros(len(new), bool)
    if len(token):
        known = token[np.minimum(place, len(token) - 1)] == new
        total[place[known]] += more[known]
    place = place[~known]
    return np.insert(token, place, new[~known]), np.insert(total, place, more[~known])


def hints(token: np.ndarray, docs: np.ndarray, sampled: bool) -> pa.RecordBatch:
    """Rows of ``_profile`` that say in how many sets (of the sample) a shingle is, in place of a text's figures."""
    none = pa.nulls(len(token), pa.int64())
    counts = (none, pa.array(docs)) if sampled else (pa.array(docs), none)
    return _rows(doc_id=none, n=none, digest=none, token=_signed(token), docs=counts[0], drawn=counts[1], marks=pa.nulls(len(token), pa.binary()))


_PACKED = "bucket long, token binary, digest binary, n binary, place binary"


def _prefixes(width: int, percent: int, buckets: int, hot: np.ndarray, hot_docs: np.ndarray):
    """hot: sorted; hot_docs: in about how many sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            token, digest, n, place = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            bucket = (token % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edge))
            packed = [x[order] for x in ((token >> _U(32)).astype(np.uint32), digest, n, place)]
            cut = [[x[edge[b]:edge[b + 1]].tobytes() for b in used] for x in packed]
            return _rows(bucket=used, **{k: pa.array(v, pa.binary()) for k, v in zip(("token", "digest", "n", "place"), cut, strict=True)})

        for batch in pieces(batches, "text"):
            hashes, at = shingle_sets(batch["text"], width)
            n, digest = np.diff(at), digests(hashes, at)
            take = prefix_length(n, percent)
            take[[d in met or met.add(d) or False for d in digest.tolist()]] = 0
            row = np.repeat(np.arange(len(n)), n)
            where = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1) if len(hot) else np.zeros(len(hashes), np.int64)
            often = hot[where] == hashes if len(hot) else np.zeros(len(hashes), bool)
            rank = np.where(often, hot_docs[where], 0) if len(hot) else np.zeros(len(hashes), np.int64)
            if often.any():  # frequent ones last, the most frequent at the very end
                order = np.lexsort((rank, row))
                hashes, rank = hashes[order], rank[order]
            place = np.arange(len(hashes)) - at[row]
            use = place < take[row]
            token, row, place, rank = splitmix(hashes[use]), row[use], place[use], rank[use]
            blocks = -(-rank // BLOCK)
            split = blocks > 2
            if split.any():
                token, row, place = salted(token, row, place, np.where(split, blocks, 1), digest)
            kept.append((token, digest[row], n[row].astype(np.uint32), place.astype(np.uint32)))
            held += len(token)
            if held > 1 << 20:
                yield flush()
                held = 0
        if kept:
            yield flush()
    return run


def salted(token: np.ndarray, row: np.ndarray, place: np.ndarray, blocks: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, ...]:
    """A token that has several blocks once for each pair of blocks that its set's own block is in."""
    again = np.repeat(np.arange(len(token)), blocks)
    other = (np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.uint64)
    own = digest[row[again]] % blocks[again].astype(np.uint64)
    low, high = np.minimum(own, other), np.maximum(own, other)
    with np.errstate(over="ignore"):
        mixed = splitmix(token[again] + low * _U(0x9E3779B97F4A7C15) + high * _U(0xC2B2AE3D27D4EB4F))
    return np.where(blocks[again] > 1, mixed, token[again]), row[again], place[again]


def has_partner(n: np.ndarray, place: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which members have another one of fitting size and position: those that ``fit`` in both directions.

    For a member of size n at place p that is one with size m at place q where percent * m is at most
    100 n - (100 + percent) p, and 100 m - (100 + percent) q is at least percent * n. In order of m, a running maximum of
    the latter tells; a second one leaves the member itself out.
    """
    order = np.argsort(n, kind="stable")
    m, reach = percent * n[order], 100 * n[order] - (100 + percent) * place[order]
    upto = np.searchsorted(m, reach, "right")  # members small enough for each
    best, floor = np.maximum.accumulate(reach), np.iinfo(np.int64).min
    where = np.zeros(len(n), np.int64)
    fresh = np.concatenate(([True], best[1:] > best[:-1]))
    where[fresh] = np.flatnonzero(fresh)
    where = np.maximum.accumulate(where)
    second = np.full(len(n), floor)
    if len(n) > 1:
        second[1:] = np.maximum.accumulate(np.where(fresh[1:], best[:-1], reach[1:]))
    top = np.where(upto > 0, best[upto - 1], floor)
    own = (upto > 0) & (where[upto - 1] == np.arange(len(n)))
    found = np.zeros(len(n), bool)
    found[order] = np.where(own, second[upto - 1], top) >= m
    return found


def fit(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of sizes n and m link whose first common shingle is at places p and q?"""
    return 1 + np.minimum(n - p, m - q) - 1 >= least_overlap(n, m, percent)


def signature(digest: np.ndarray, count: np.ndarray | int, at: np.ndarray | None = None) -> np.ndarray:
    """The same for the same members, in whatever order and under whatever shingle."""
    with np.errstate(over="ignore"):
        mixed = splitmix(digest)
        total = np.add.reduceat(mixed, at) if at is not None else mixed.sum(-1, dtype=np.uint64)
        return splitmix(total + np.asarray(count).astype(np.uint64))


_GROUPS = "signature long, members array<long>"


def _groups(percent: int):
    def bucket_groups(parts: list[tuple[bytes, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        token, digest, n, place = (
            np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in enumerate((np.uint32, np.uint64, np.uint32, np.uint32))
        )
        n, place = n.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((digest, token))
        token, digest, n, place = token[order], digest[order], n[order], place[order]
        keep = np.concatenate(([True], (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])))  # one of each class
        token, digest, n, place = token[keep], digest[keep], n[keep], place[keep]
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        size = np.diff(edge)
        a = edge[:-1][size == 2]
        a = a[fit(n[a], place[a], n[a + 1], place[a + 1], percent)]
        if len(a):
            pair = np.stack([digest[a], digest[a + 1]], 1)
            mark, first = np.unique(signature(pair, 2), return_index=True)
            yield mark, pair[first]
        for start, stop in zip(edge[:-1][size > 2].tolist(), edge[1:][size > 2].tolist(), strict=True):
            good = has_partner(n[start:stop], place[start:stop], percent)
            members, sizes = digest[start:stop][good], n[start:stop][good]
            for group in blocks_of(members, sizes):
                yield signature(group, len(group))[None], group[None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        met: set[int] = set()

        def done() -> Iterator[pa.RecordBatch]:
            marks, lists = [], []
            for mark, groups in bucket_groups(parts):
                for k, group in zip(mark.tolist(), groups, strict=True):
                    if k not in met:
                        met.add(k)
                        marks.append(k)
                        lists.append(group)
            if marks:
                at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(at), pa.array(_signed(np.concatenate(lists))))
                yield _rows(signature=_signed(np.array(marks, np.uint64)), members=members)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("bucket", "token", "digest", "n", "place")]
            for bucket, *rest in zip(*columns, strict=True):
                if bucket != now and parts:
                    yield from done()
                    parts.clear()
                now = bucket
                parts.append(tuple(rest))
        if parts:
            yield from done()
        parts.clear()
        give_back()
    return run


def blocks_of(members: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The group itself, or every pair of its blocks if it is large."""
    if len(members) < 2:
        return
    block = np.maximum(np.arange(len(members)) // BLOCK, (np.cumsum(sizes) - 1) // BLOCK_SHINGLES)
    _, block = np.unique(block, return_inverse=True)
    count = int(block[-1]) + 1
    if count <= 2:
        yield members
        return
    for a in range(count):
        for b in range(a + 1, count):
            yield members[(block == a) | (block == b)]


class PrefixTree:
    """Sorted sets in a compressed trie: a node is a run of shingles that a subtree's sets share."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        ordered = [sets[i] for i in order]
        common = [0]
        for a, b in zip(ordered[:-1], ordered[1:], strict=True):
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            common.append(int(differ.argmax()) if differ.any() else k)
        common.append(0)
        #: parent, first and last place of the run, whose set, set or -1, smallest and largest size below
        nodes: list[list[int]] = [[-1, 0, 0, 0, -1, 1 << 60, 0]]
        stack = [0]
        for k, s in enumerate(ordered):
            while nodes[stack[-1]][2] > common[k]:
                last = stack.pop()
                if nodes[stack[-1]][2] < common[k]:  # the run splits where this set leaves it
                    top = nodes[last]
                    nodes.append([stack[-1], top[1], common[k], top[3], -1, top[5], top[6]])
                    top[0], top[1] = len(nodes) - 1, common[k]
                    stack.append(len(nodes) - 1)
                    break
            nodes.append([stack[-1], nodes[stack[-1]][2], len(s), k, order[k], len(s), len(s)])
            for up in stack:
                nodes[up][5], nodes[up][6] = min(nodes[up][5], len(s)), max(nodes[up][6], len(s))
            stack.append(len(nodes) - 1)
        table = np.array(nodes, np.int64)
        self.parent, begin, self.depth, _, self.leaf, self.least, self.most = table.T
        runs = [ordered[k][a:b] for _, a, b, k, *_ in nodes]
        at = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        self.start, self.stop = at[:-1], at[1:]
        labels = np.concatenate(runs)
        self.vocabulary, self.code = np.unique(labels, return_inverse=True)
        self.last = np.array([ordered[k][b - 1] if b else 0 for _, _, b, k, *_ in nodes], np.uint64)
        by_parent = np.argsort(self.parent[1:], kind="stable") + 1
        self.children = by_parent
        self.child_at = np.searchsorted(self.parent[by_parent], np.arange(len(nodes) + 1))
        self.sizes = np.array([len(s) for s in sets])

    def links(self, query: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Indices of the stored sets that link with ``query``, one of them."""
        n = len(query)
        met = np.zeros(len(self.vocabulary), bool)
        met[np.searchsorted(self.vocabulary, query)] = True
        running = np.concatenate(([0], np.cumsum(met[self.code])))
        found, front, shared = [], np.array([0]), np.array([0])
        while len(front):
            spans = self.child_at[front + 1] - self.child_at[front]
            at = np.repeat(self.child_at[front] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            front, shared = self.children[at], np.repeat(shared, spans)
            shared = shared + running[self.stop[front]] - running[self.start[front]]
            more = np.minimum(n - np.searchsorted(query, self.last[front], "right"), self.most[front] - self.depth[front])
            alive = shared + np.maximum(more, 0) >= least_overlap(n, self.least[front], percent)
            front, shared = front[alive], shared[alive]
            ends = self.leaf[front] >= 0
            leaf, have = self.leaf[front[ends]], shared[ends]
            found.append(leaf[have >= least_overlap(n, self.sizes[leaf], percent)])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def tree_links(sets: list[np.ndarray], percent: int = PERCENT, walkers: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets as all their links do (or as all links of the walkers do, if given).

    A set that is in the largest component needn't walk the tree: every set outside it does, so
    no two sets of different components go uncompared. Given walkers all walk.
    """
    tree, root, out = PrefixTree(sets), np.arange(len(sets)), []
    walked = np.zeros(len(sets), bool) if walkers is None else ~walkers
    largest = root[0] if walkers is None else -1
    while len(left := np.flatnonzero(~walked & (root != largest))):
        i = int(left[0])
        walked[i] = True
        near = tree.links(sets[i], percent)
        for r in np.unique(root[near]):
            if r != root[i]:
                out.append((i, int(near[root[near] == r][0])))
                root[root == r] = root[i]
        if walkers is None:
            largest = np.bincount(root).argmax()
    return out


_LINKS = "u long, v long"


def _by_key(key: str, take, act):
    """Runs ``act`` on what ``take`` makes of the rows of each run of equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k, row in zip(batch[key].to_pylist(), take(batch), strict=True):
                if k != now and held:
                    yield from act(held)
                    held = []
                now = k
                held.append(row)
        if held:
            yield from act(held)
        held = []
        give_back()
    return run


def _clusters(percent: int):
    def take(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(batch[c].to_pylist() for c in ("rep", "n", "marks")), strict=True)

    def act(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, n, marks = zip(*rows, strict=True)
        i, j = may_link(np.array(n), list(marks), percent)
        if len(i):
            root, ids = local_roots(len(ids), i, j), np.array(ids)
            some = np.flatnonzero(root != np.arange(len(ids)))
            yield _rows(u=ids[some], v=ids[root[some]])
    return _by_key("signature", take, act)


def _join_clusters(width: int, percent: int):
    def take(batch: pa.RecordBatch) -> Iterator[tuple]:
        hashes, at = shingle_sets(batch["text"], width)
        for k, (doc, walk) in enumerate(zip(batch["rep"].to_pylist(), batch["walk"].to_pylist(), strict=True)):
            yield doc, walk, hashes[at[k]:at[k + 1]].copy()

    def act(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, walk, sets = zip(*rows, strict=True)
        walkers = None if walk[0] is None else np.array(walk)
        if len(sets) > 1 and (found := tree_links(list(sets), percent, walkers)):
            a, b = np.array(found).T
            yield _rows(u=np.array(ids)[a], v=np.array(ids)[b])

    walk = _by_key("part", take, act)
    return lambda batches: walk(pieces(batches, "text"))


def _blocks() -> F.Column:
    return F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _cluster_components(clusters: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the links inside clusters, given as rows of node, component and set size n."""
    def links(placed: DataFrame) -> DataFrame:
        wanted = placed.join(texts, "rep")
        return wanted.repartition("part").sortWithinPartitions("part").mapInArrow(_join_clusters(width, percent), _LINKS)

    rows = clusters.join(clusters.groupBy("component").agg(_blocks().alias("blocks"), F.count("*").alias("members"), F.sum("n").alias("shingles")), "component")
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "blocks")
    draw = F.pmod(F.xxhash64(F.lit(23), "node"), F.lit(1 << 30)) / float(1 << 30)
    probe = (F.col("blocks") > 1) & (draw < F.least(PROBES / F.col("members"), BLOCK_SHINGLES / (4 * F.col("shingles"))))
    seen = F.explode(F.when(probe, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    first = rows.withColumn("at", seen).select(F.col("node").alias("rep"), F.lit(None).cast("boolean").alias("walk"), F.xxhash64("component", "at").alias("part"))
    parts = components(links(first))
    large = rows.filter("blocks > 1")
    if not large.limit(1).count():
        return parts
    parts = materialize(parts, "parts")
    large = large.join(parts.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    top = large.groupBy("component", "label").agg(F.count("*").alias("k")).groupBy("component").agg(F.max(F.struct("k", "label")).alias("top"))
    rest = materialize(large.join(top, "component").filter(F.col("label") != F.col("top.label")).select("component", "node", "n", "blocks"), "rest")
    asked = rest.groupBy("component").agg(_blocks().alias("rests"))
    part = F.xxhash64("component", "rest", "block").alias("part")
    walkers = rest.join(asked, "component").withColumn("rest", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("rests")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = large.join(asked, "component").withColumn("rest", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    both = walkers.select(F.col("node").alias("rep"), F.lit(True).alias("walk"), part).union(others.select(F.col("node").alias("rep"), F.lit(False).alias("walk"), part))
    both = materialize(both.groupBy("rep", "part").agg(F.max("walk").alias("walk")), "rest")  # of known size: a few identifiers needn't shuffle the texts
    return components(parts.toDF("u", "v").union(links(both)))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id long, text).

    Sets link if percent of their union, or more, is in both. component_id is the smallest doc_id
    reachable by links. Null and blank texts have size 0 and their own doc_id; texts of fewer than
    ``width`` words are one shingle. Rows with the same doc_id are compared each with its own text;
    a null doc_id links with nothing and has a null component. Repeated rows stay.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    profile = materialize(texts.mapInArrow(_profile(width), _PROFILE), "profile")
    often = F.greatest(F.coalesce(F.sum("docs"), F.lit(0)), F.when(F.sum("drawn") >= HOT_IN_SAMPLE, SAMPLED * F.sum("drawn")).otherwise(0))
    found = profile.filter("token IS NOT NULL").groupBy("token").agg(often.alias("docs")).filter(F.col("docs") > HOT_DOCS)
    top = found.orderBy(F.desc("docs"), "token").limit(HOT_LIMIT).collect()
    hot = np.array([r.token for r in top], np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, hot_docs = hot[order], np.array([r.docs for r in top], np.int64)[order]

    sets = profile.filter("digest IS NOT NULL")
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "marks")).alias("c")).select("digest", F.col("c.doc_id").alias("rep"), "c.n", "c.marks")
    packed = texts.filter("doc_id IS NOT NULL").mapInArrow(_prefixes(width, percent, buckets, hot, hot_docs), _PACKED)
    groups = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups(percent), _GROUPS)
    groups = groups.groupBy("signature").agg(F.first("members").alias("members"))
    members = groups.select("signature", F.explode("members").alias("digest")).join(classes, "digest").select("signature", "rep", "n", "marks")
    near = members.repartition("signature").sortWithinPartitions("signature").mapInArrow(_clusters(percent), _LINKS)
    clusters = materialize(components(near).join(classes.select(F.col("rep").alias("node"), "n"), "node"), "clusters")

    parts = _cluster_components(clusters, texts.withColumnRenamed("doc_id", "rep"), width, percent)
    joined = classes.join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return sets.join(joined, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by a 64-bit hash of its text: for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n, g FROM s),
e AS (SELECT doc_id, n, unnest(g) AS h FROM n),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
k AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, k.v FROM r JOIN k ON r.v = k.u)
SELECT doc_id, n AS n_shingles, (SELECT min(v) FROM r WHERE r.u = n.doc_id) AS component_id FROM n
"""
