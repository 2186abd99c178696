"""Similarity join of documents by the Jaccard coefficient of their word shingles, exact, by signature trees.

1. Each document becomes a set of 64-bit shingle hashes and a 128-bit digest of the set (its *node*: documents with equal
   sets are one node). Shingles have one global order: common ones, by a count sketch over all documents, come last. Two
   sets that link share ``k`` shingles at least among the first ``n - ceil(0.8 n) + k`` of each, their *prefix*; k is a
   twentieth of n, so that a shared passage in long texts is no candidate.
2. A prefix shingle that one node alone has tells nothing, and a node with fewer than k others can't link. Both go, and
   with them most documents: all that follows reads the *members*, one row for each node that is left, with its shared
   shingles, its whole set, and a bitmap whose width follows the set's size.
3. Hubs: of the nodes that have one of their few smallest shared shingles in common, the one with most shared shingles is
   the hub (the original among its copies), and every other is paired with the hubs it meets so twice: eight at most.
   They are verified, best hub first. That joins large groups of copies with few pairs for each member.
4. Nodes of different components meet in the groups of their *heads*, their few smallest shared shingles. Groups above a
   size are split into blocks and each pair of blocks is a group of its own. In each, a signature tree (OR- and
   AND-combined bitmaps, size ranges, component if it is one) is traversed against itself: a pair of tree nodes whose
   greatest possible overlap is too small, or that lies in one component, is left. What stays is held against the wide
   bitmaps and given out once, by the least head that both have. Pairs without a common head meet in the groups of all
   their shared shingles, in k of them at least. What is given out is verified on the whole sets.
5. Components by alternating large and small stars on the links.

No step gathers a list for a key in one row or task without a bound, and nothing but the bounded list of common sketch
buckets comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, small_or_merge, stored, whole

WORDS = 5
#: Link if NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
#: Bits of a tree's bitmaps, and the least and greatest width of a member's own, which has WIDE for each shingle or more.
BITS, WIDE, WIDEST = 1024, 8, 1 << 16
SKETCH_BITS = 24
#: Common buckets that order shingles. The list only orders; a shorter one costs time, not links.
COMMON = 65_536
#: Members of a group that one task compares; longer lists are split into blocks of half of it.
GROUP = 4096
FANOUT = 8
#: Smallest shared shingles of a node, as 32-bit hashes. Pairs with a common one meet in its group, others in the groups
#: of all shared shingles. Shingles with one hash share a group, which costs time alone.
HEAD = 16
NONE = np.iinfo(np.int64).max
#: Members of a group that are compared without a tree.
FEW = 12
#: Smallest shared shingles of a node by which it meets hubs.
HUB_TOKENS = 16
#: Node pairs that are expanded at once, and bytes of bitmaps that are compared at once.
FRONTIER, COMPARED = 20_000, 1 << 24
#: Shared shingles that may be broadcast: 50 bytes each.
SHARED_ROWS = 2_000_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


#: Bytes that are hashed at once.
SEGMENT = 1 << 20


class Shingler:
    """Distinct shingle hashes of a text, ascending.

    A word's hash is a polynomial over random values of its bytes, from running sums over the whole text; blanks are the
    six of ASCII, A-Z have the values of a-z.
    """

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.value = np.random.default_rng(11).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.value[65:91] = self.value[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.power = self._powers(0x5851F42D4C957F2D, 1 << 12)
        self.inverse = self._powers(pow(0x5851F42D4C957F2D, -1, 1 << 64), 1 << 12)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        while len(data) >= len(self.power):
            n = 2 * len(self.power)
            self.power, self.inverse = self._powers(int(self.power[1]), n), self._powers(int(self.inverse[1]), n)
        blank = self.blank[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        return h ^ (h >> np.uint64(27))

    def word_hashes(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) <= SEGMENT:
            return self._hashes(data)
        blanks = np.flatnonzero(self.blank[data])
        cuts = [0, *np.unique(blanks[np.searchsorted(blanks, np.arange(SEGMENT, len(data), SEGMENT)).clip(max=len(blanks) - 1)]), len(data)] if len(blanks) else [0, len(data)]
        return np.concatenate([self._hashes(data[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])

    def __call__(self, text: str) -> np.ndarray:
        h = self.word_hashes(text)
        n = len(h)
        if not n:
            return h
        k = min(n, self.words)
        total = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            total = (total ^ (total >> np.uint64(29))) * np.uint64(_MULTIPLIERS[i % 5]) + h[i : n - k + 1 + i]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
        total.sort()
        return total[np.concatenate([[True], total[1:] != total[:-1]])]


def shared_least(n: int) -> int:
    """k: shingles that two linked sets share in their prefixes at least, n being the smaller set's size."""
    return n // 20 + 1


def prefix_length(n: int) -> int:
    """A set of n shares ceil(0.8 n) at least with any it links to; all but k of those may lie behind the prefix."""
    return min(n, n - -(-NUM * n // DEN) + shared_least(n)) if n else 0


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


def common_buckets(texts: DataFrame, words: int = WORDS, most: int = COMMON) -> np.ndarray:
    """Sketch buckets (top bits of the hash) that far more documents have than chance would give, the fullest first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles, counts, total = Shingler(words), np.zeros(1 << SKETCH_BITS, np.uint32), 0
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py())
                counts[s >> np.uint64(64 - SKETCH_BITS)] += 1
                total += len(s)
        mean = total / len(counts)
        full = np.flatnonzero(counts >= 4 + mean + 6 * mean**0.5)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(counts[full], pa.int64())], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r[0] for r in found.orderBy(F.desc("n"), "bucket").limit(most).collect()], np.int64))


def signatures(texts: DataFrame, common: np.ndarray, words: int = WORDS) -> DataFrame:
    """doc_id, same (digest of the text), n, node (digest of the set), prefix (in the global order)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shingles, late = Shingler(words), np.zeros(1 << SKETCH_BITS, bool)
        late[common] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, node, prefix = [], [], []
                for text in part.column(2):
                    s = shingles(text.as_py())
                    n.append(len(s))
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    is_late = late[s >> np.uint64(64 - SKETCH_BITS)]
                    prefix.append(np.concatenate([s[~is_late], s[is_late]])[: prefix_length(len(s))].view(np.int64))
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "same", "n", "node", "prefix"])

    rows = texts.select("doc_id", F.unhex(F.md5("text")).alias("same"), "text")
    return rows.mapInArrow(run, "doc_id long, same binary, n long, node binary, prefix array<long>")


def shared_in(rows: DataFrame, mark: str, limit: int = SHARED_ROWS) -> DataFrame:
    """Those of rows (token, ...) whose token comes with two values of ``mark`` at least."""
    ends = rows.groupBy("token").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"))
    bridges = stored(ends.where("lo <> hi").select("token"), "bridges")
    return rows.join(small_or_merge(bridges, limit=limit), "token")


def _least(n: Column) -> Column:
    """shared_least() of the smallest set that one of n may link to."""
    return F.floor(F.ceil(n * NUM / DEN) / 20) + 1


def wide_bits(shingles: np.ndarray) -> bytes:
    width = min(WIDEST, max(BITS, 1 << int(WIDE * len(shingles) - 1).bit_length()))
    flags = np.zeros(width, bool)
    flags[shingles & np.uint64(width - 1)] = True
    return np.packbits(flags).tobytes()


def members_of(sig: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each node that may link: node, n, tokens (shared prefix shingles, ascending), head, shingles, bits; stored.

    Only the texts that stand for such a node are read into sets: a node's smallest text digest picks them.
    """
    mark = F.xxhash64("node").alias("mark")  # nodes with the same mark have their shingles together, which costs time alone
    rows = sig.where("n > 0").select(mark, F.explode("prefix").alias("token"))
    shared = shared_in(rows, "mark").groupBy("mark").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    shared = stored(shared, "shared")
    few = shared.count()
    nodes = sig.where("n > 0").select("node", "n", "same", mark).groupBy("mark", "node", "n").agg(F.min("same").alias("same"))
    kept = nodes.join(shared.hint("merge"), "mark").where(F.size("tokens") >= _least(F.col("n")))
    kept = stored(kept.select("node", "n", "same", "tokens", F.transform(F.slice("tokens", 1, HEAD), lambda t: F.hash(t)).alias("head")), "kept")
    keyed = texts.select(F.unhex(F.md5("text")).alias("same"), "text")
    picked = keyed.join(small_or_merge(kept.select("node", "same"), few), "same").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py()) for t in part.column("text")]
                columns = [part.column(c) for c in ("node", "n", "tokens", "head")]
                columns += [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([wide_bits(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "tokens", "head", "shingles", "bits"])

    found = picked.join(kept.drop("same").hint("merge"), "node")
    return stored(found.mapInArrow(run, "node binary, n long, tokens array<long>, head array<int>, shingles array<long>, bits binary"), "members")


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets; stored."""
    pairs = stored(pairs, "pairs")
    n = pairs.count()
    left = members.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")).join(small_or_merge(pairs, n), "b")
    right = members.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")).join(small_or_merge(pairs.select("a").distinct(), n), "a", "left_semi")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return stored(left.join(right.hint("merge"), "a").where(both * DEN >= either * NUM).select("a", "b"), "links")


def hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a: hub, b: node, first: whether a is b's best hub) of alike size: eight at most for each node."""
    some = members.select("node", "n", F.size("tokens").alias("score"), F.slice("tokens", 1, HUB_TOKENS).alias("tokens"))
    rows = stored(some, "hub_tokens").select("node", "n", "score", F.explode("tokens").alias("token"))
    top = rows.groupBy("token").agg(F.max(F.struct("score", "node", "n")).alias("top"), F.count(F.lit(1)).alias("met")).where("met > 1")
    hubs = stored(top.select("token", F.col("top.node").alias("a"), F.col("top.n").alias("n_a")), "hubs")
    met = rows.join(small_or_merge(hubs), "token").where("node <> a")
    met = met.where((F.col("n") * DEN >= F.col("n_a") * NUM) & (F.col("n_a") * DEN >= F.col("n") * NUM))
    both = met.groupBy("a", "n_a", F.col("node").alias("b"), "n").agg(F.count(F.lit(1)).alias("both"))
    both = both.where((F.col("both") > 1) | (F.least("n", "n_a") < 20)).select("a", "b", "both")
    both = stored(both, "hub_pairs")
    best = both.groupBy("b").agg(F.max(F.struct("both", "a")).alias("best"))
    return both.join(small_or_merge(best), "b").select("a", "b", (F.col("a") == F.col("best.a")).alias("first"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node that is reached."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_stored(edges)
        edges = new
        if now == state:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def may_link(any_: np.ndarray, all_: np.ndarray, lo: np.ndarray, hi: np.ndarray, one: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether members below nodes i and j of a level can link and lie in different components."""
    ok = ((one[i] != one[j]) | (one[i] < 0)) & (hi[i] * DEN >= lo[j] * NUM) & (hi[j] * DEN >= lo[i] * NUM)
    k = np.flatnonzero(ok)
    a, b = i[k], j[k]
    only_a = np.bitwise_count(all_[a] & ~any_[b]).sum(1, dtype=np.int64)
    only_b = np.bitwise_count(all_[b] & ~any_[a]).sum(1, dtype=np.int64)
    most = np.minimum(hi[a] - only_a, hi[b] - only_b)
    ok[k] = most * (DEN + NUM) >= (lo[a] + lo[b]) * NUM
    return ok


class Tree:
    """Levels of a signature tree over members that lie in an order where neighbours are alike."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, label: np.ndarray) -> None:
        self.levels = [(bits, bits, n, n, label)]
        while len(self.levels[-1][0]) > 1:
            any_, all_, lo, hi, one = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            first, last = np.maximum.reduceat(one, at), np.minimum.reduceat(one, at)
            self.levels.append((
                np.bitwise_or.reduceat(any_, at),
                np.bitwise_and.reduceat(all_, at),
                np.minimum.reduceat(lo, at),
                np.maximum.reduceat(hi, at),
                np.where(first == last, first, -1),  # -1: members of more than one component
            ))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return may_link(*self.levels[level], i, j)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members (i < j) that dual traversal leaves."""
        top = len(self.levels) - 1
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(FANOUT)
        while work:
            level, i, j = work.pop()
            if len(i) > FRONTIER // FANOUT**2:
                half = len(i) // 2
                work += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
                continue
            if level == 0:
                if (keep := i < j).any():
                    yield i[keep], j[keep]
                continue
            size = len(self.levels[level - 1][0])
            a = (i[:, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, 2).ravel()
            b = (j[:, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, 1).ravel()
            keep = (a <= b) & (b < size)
            a, b = a[keep], b[keep]
            keep = self.may_link(level - 1, a, b)
            if keep.any():
                work.append((level - 1, a[keep], b[keep]))


def tree_pairs(n: np.ndarray, bits: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of different labels that may link."""
    least = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, n)
    order = np.lexsort((n, label, least[label]))
    found = list(Tree(n[order], bits[order], label[order]).pairs())
    if not found:
        return order[:0], order[:0]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return order[i], order[j]


class Bitmaps:
    """Bitmaps of rows, each as wide as its set asks for. Halves are combined by OR where a narrower one is needed."""

    def __init__(self, bits: list[bytes], n: np.ndarray) -> None:
        self.n, self.width = n, np.array([len(b) for b in bits], np.int64)
        self.place = {int(w): np.full(len(n), -1) for w in np.unique(self.width)}
        self.rows: dict[int, np.ndarray] = {}
        wider = np.empty((0, 0), np.uint8), np.empty(0, np.int64)
        for w in sorted(self.place, reverse=True):
            at = np.flatnonzero(self.width == w)
            own = np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(-1, w)
            rows, ids = wider
            while rows.shape[1] > w:
                rows = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]
            rows, ids = (np.concatenate([rows, own]), np.concatenate([ids, at])) if len(ids) else (own, at)
            self.rows[w] = np.ascontiguousarray(rows).view(np.uint64)
            self.place[w][ids] = np.arange(len(ids))
            wider = rows, ids

    def narrow(self) -> np.ndarray:
        """Of all rows, as wide as a tree's."""
        w = min(self.rows)
        rows = self.rows[w][self.place[w]]
        while rows.shape[1] > BITS // 64:
            rows = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]
        return np.ascontiguousarray(rows)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the rows i and j, one to one, can link by the narrower width of each two."""
        ok, width = np.zeros(len(i), bool), np.minimum(self.width[i], self.width[j])
        for w in np.unique(width):
            of, step = np.flatnonzero(width == w), max(1, COMPARED // int(w))
            rows, place = self.rows[int(w)], self.place[int(w)]
            for at in range(0, len(of), step):
                k = of[at : at + step]
                a, b = rows[place[i[k]]], rows[place[j[k]]]
                most = np.minimum(self.n[i[k]] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), self.n[j[k]] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
                ok[k] = most * (DEN + NUM) >= (self.n[i[k]] + self.n[j[k]]) * NUM
        return ok


def group_pairs(group: np.ndarray, n: np.ndarray, bits: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may link, of rows sorted by group. Groups of a few rows need no tree."""
    _, label = np.unique(label, return_inverse=True)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(first, append=len(group))
    few = np.repeat(size <= FEW, size)
    for step in range(1, min(FEW, size.max())):
        i = np.flatnonzero(few[:-step] & (group[:-step] == group[step:]))
        for at in range(0, len(i), FRONTIER):
            part = i[at : at + FRONTIER]
            part = part[may_link(bits, bits, n, n, label, part, part + step)]
            yield part, part + step
    for f, m in zip(first[size > FEW], size[size > FEW], strict=True):
        i, j = tree_pairs(n[f : f + m], bits[f : f + m], label[f : f + m])
        yield i + f, j + f


def _heads(column) -> np.ndarray:
    """A row of HEAD numbers for each list, NONE where it is shorter."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    sizes, values = np.diff(ends), lists.flatten().to_numpy()
    out = np.full((len(sizes), HEAD), NONE)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def met_pairs(members: DataFrame, label: Column, by_head: bool) -> DataFrame:
    """Pairs (a, b) of members in different components that may link: those with a common head, or those without.

    With one, a pair comes once, from the group of the least head that both have. Without, it comes from each group of a
    shared shingle and stays if k groups give it.
    """
    bits = F.col("bits") if by_head else F.lit(b"")
    marked = members.select("node", "n", bits.alias("bits"), F.xxhash64(label).alias("mark"), "head", F.col("head" if by_head else "tokens").cast("array<bigint>").alias("tokens"))
    rows = shared_in(marked.select("node", "n", "bits", "mark", "head", F.explode("tokens").alias("token")), "mark")
    half = GROUP // 2
    sizes = stored(rows.groupBy("token").count().where(F.col("count") > GROUP).select("token", F.ceil(F.col("count") / half).cast("int").alias("blocks")), "sizes")
    rows = rows.join(small_or_merge(sizes), "token", "left")
    own = F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    split = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    split = split.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "bits", "mark", "head")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t.column(c).to_numpy() for c in ("token", "i", "j")])
            order = np.cumsum(np.any(np.diff(key, axis=1, prepend=key[:, :1]) != 0, axis=0))
            n, mark, own = (t.column(c).to_numpy() for c in ("n", "mark", "own"))
            maps = Bitmaps(t.column("bits").to_pylist(), n) if by_head else None
            narrow = maps.narrow() if maps else np.zeros((len(n), 1), np.uint64)
            node, heads = np.array(t.column("node").to_pylist(), dtype=object), _heads(t.column("head"))
            for i, j in group_pairs(order, n, narrow, mark):
                across = (key[1][i] == key[2][i]) | (own[i] != own[j])  # a pair of two blocks: only what lies between them
                i, j = i[across], j[across]
                for at in range(0, len(i), FRONTIER):
                    x, y = i[at : at + FRONTIER], j[at : at + FRONTIER]
                    least = np.where(heads[x][:, :, None] == heads[y][:, None, :], heads[x][:, :, None], NONE).min((1, 2))
                    mine = least == (key[0][x] if by_head else NONE)  # else another group gives the pair
                    x, y = x[mine], y[mine]
                    if maps:
                        may = maps.may_link(x, y)
                        x, y = x[may], y[may]
                    a, b = node[x], node[y]
                    swap = a > b
                    columns = [pa.array(np.where(swap, b, a).tolist(), pa.binary()), pa.array(np.where(swap, a, b).tolist(), pa.binary()), pa.array(np.minimum(n[x], n[y]), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, t]) if rest is not None else t
            key = [rest.column(c).to_numpy() for c in ("token", "i", "j")]
            same = np.all([k == k[-1] for k in key], axis=0)
            full = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if full:
                yield from done(rest.slice(0, full))
                rest = rest.slice(full)
        if rest is not None and rest.num_rows:
            yield from done(rest)

    found = split.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a binary, b binary, n long")
    if by_head:
        return found.select("a", "b")
    return found.groupBy("a", "b", "n").count().where(F.col("count") > F.floor(F.col("n") / 20)).select("a", "b")


def node_components(members: DataFrame) -> DataFrame:
    """(node, root) of all members that link with another."""
    hubs = stored(hub_pairs(members), "hub_pairs")
    links = verified(hubs.where("first").select("a", "b"), members)
    roots = stored(components(links), "roots")

    def labelled(df: DataFrame, key: str, name: str) -> DataFrame:
        found = roots.select(F.col("node").alias(key), F.col("root").alias(name))
        return df.join(small_or_merge(found), key, "left").withColumn(name, F.coalesce(name, key))

    others = labelled(labelled(hubs.where("not first"), "a", "of_a"), "b", "of_b").where("of_a <> of_b").select("a", "b")
    more = verified(others, members)
    if not more.isEmpty():
        links = links.union(more)
        roots = stored(components(links), "roots")
    now = stored(labelled(members.drop("shingles"), "node", "label"), "labelled")
    met = met_pairs(now, F.col("label"), True).union(met_pairs(now, F.col("label"), False))
    rest = verified(met, members)
    return roots if rest.isEmpty() else stored(components(links.union(rest)), "roots")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Words are runs of anything but the six blanks of ASCII, A-Z in lower case; a set holds the distinct shingles of
    ``words`` words, or the whole sequence if it is shorter. Null and blank texts have an empty set and link with
    nothing: their component is their own id. component_id is the smallest id that links reach; null ids don't count in
    it. Repeated rows and equal texts lie in one component. Other columns are ignored. An empty table gives an empty
    result.
    """
    texts = _texts(docs, id_col, text_col)
    sig = stored(signatures(texts, common_buckets(texts, words), words), "signatures")
    roots = node_components(members_of(sig, texts, words))
    placed = sig.select("doc_id", "n", "node").join(small_or_merge(roots), "node", "left")
    placed = placed.select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    out = placed.join(small_or_merge(stored(least, "least")), "root", "left")  # a row alone is its own component
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with one row of each component, the one whose id is the component's, all columns as they were.

    Rows with an empty set and rows without an id stay. An id goes or stays as a whole: it goes if no row of it stays.
    """
    found = stored(jaccard_join(docs, id_col, text_col, words), "classes")
    stays = (F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id"))
    gone = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(stays).alias("stays")).where("not stays").select("__id")
    key = F.col(f"`{id_col}`").cast("long")
    return docs.withColumn("__key", key).join(small_or_merge(stored(gone, "gone")).alias("g"), F.col("__key") == F.col("__id"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
