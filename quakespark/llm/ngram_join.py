"""N-gram Jaccard join with signature trees.

1. Every text becomes its set of shingle hashes, and texts of one set a class.
2. Shingles are put in one order, those of frequent slots last. Two sets of
   the wanted similarity share at least k of their first shingles (prefixes),
   so a class of which fewer than k occur in others' prefixes has no partner
   and leaves. What stays are the copies and near copies. They meet at the
   first few shingles (the core), of which partners share one.
3. Of each shingle's classes a signature tree is built: leaves hold classes of
   like size, nodes the OR of their bitmaps and the range of their sizes.
   Trees are traversed in pairs of nodes; a pair is pruned when the overlap
   that its bitmaps and sizes allow at most is below what the least sizes
   need, or when all of it is connected already. Survivors are kept as stars
   about their least class, so a group of copies gives a row for each member.
   Of shingles that the same classes have, one is looked at.
4. The forest's components are groups of candidates. A group's sets come to
   one task and are joined exactly, with the same traversal ahead of it.

In 3 and 4 a shingle or group of more than BLOCK classes (in 4 also: of more
than BLOCK_BYTES of sets) goes block by block, each pair of blocks a unit of
its own, so a task holds two blocks whatever holds a third of all rows.
5. Components of the exact links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import CHAIN_ROWS, bound_batches, discard, few, frees, join_small, matched, row_keys, settle
from quakespark.llm.components import connected
from quakespark.llm.exact_dedup import elect
from quakespark.llm.shingles import merged_table, shingles, slices, word_hashes

#: Slots of the table of frequencies (8 MB), whatever the input.
SLOTS = 1 << 20
#: A slot with more than HOT shingles and HOT_TIMES the mean is hot: its shingles count as shared unseen.
HOT, HOT_TIMES = 1 << 16, 16
#: Bits of the filter of candidates: about ten for each class, within these bounds (0.5 to 128 MB).
FILTER_BITS = 1 << 22, 1 << 30
#: Classes, and bytes of their sets, that are a block.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
LEAF, FANOUT = 32, 8
#: 64-bit words of a bitmap at most: in the exact join, and in the trees of shingles, where bitmaps are shuffled.
WIDEST, WIDEST_SENT = 1024, 128
RUNS, FAN = 64, 8


@dataclass(frozen=True)
class Rule:
    """n-word shingles; similarity of at least percent / 100."""

    n: int = 5
    percent: int = 80

    def least_overlap(self, size: int) -> int:
        """A set of this size shares so many shingles with any partner at least."""
        return -(-size * self.percent // 100)

    def shared(self, size: int) -> int:
        """Shingles of its prefix that a set of this size shares with a partner no smaller than it."""
        return max(1, size // 10)

    def prefix(self, size: int) -> int:
        return min(size, size - self.least_overlap(size) + self.shared(size))

    def core(self, size: int) -> int:
        """The first of these, of which partners share one."""
        return size - self.least_overlap(size) + 1

    def enough(self, size: int) -> int:
        """... and with any partner."""
        return self.shared(self.least_overlap(size))

    def needed(self, a, b):
        """Overlap that sets of sizes a and b need: percent * (a + b) / (100 + percent), rounded up."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def _arrow(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def shingle_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, row, n, cls, sure, run, tokens) for rows of (id, text): set size, class (two halves of a digest), and the sorted hashes."""

    @frees
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, sures, sets = [], [], [], []
            for raw in slices(batch.column("text")):
                own = shingles(word_hashes(raw), rule.n)
                body = own.tobytes()
                sizes.append(len(own))
                digest = hashlib.blake2b(body, digest_size=16).digest()
                classes.append(int.from_bytes(digest[:8], "little", signed=True))
                sures.append(int.from_bytes(digest[8:], "little", signed=True))
                sets.append(body)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sures, pa.int64()), batch.column("run"), pa.array(sets, pa.binary())], names=["id", "row", "n", "cls", "sure", "run", "tokens"])

    row = F.xxhash64("text")
    run = F.pmod(F.xxhash64("id", row, F.monotonically_increasing_id()), F.lit(RUNS)).cast("int")  # rows that repeat each other spread, too
    return docs.select("id", row.alias("row"), run.alias("run"), "text").mapInArrow(make, f"id {docs.schema['id'].dataType.simpleString()}, row long, n long, cls long, sure long, run int, tokens binary")


def clashes(rows: DataFrame) -> DataFrame:
    """(cls) of different sets that share a class number: a few, if any, of 10^10 sets."""
    return rows.groupBy("cls").agg(F.min("sure").alias("a"), F.max("sure").alias("b")).where("a <> b").select("cls")


def apart(rows: DataFrame, clashing: DataFrame) -> DataFrame:
    """``rows`` (cls, sure, ...) with numbers of their own for the sets that share one."""
    own = F.when(F.col("_clash"), F.xxhash64("cls", "sure")).otherwise(F.col("cls"))
    return join_small(rows, clashing.withColumn("_clash", F.lit(True)), ["cls"], "left", most=CHAIN_ROWS).withColumn("cls", own).select(*rows.columns)


def _tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.tobytes(), dtype=np.uint64) for x in slices(batch.column("tokens")))


def slot_counts(sets: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How many sets' shingles fall into each slot, over all rows."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for own in _tokens(batch):
            np.add.at(table, (own % np.uint64(slots)).astype(np.int64), 1)

    return merged_table(sets.select("tokens"), fill, slots, "int64", np.add)


def prefixes(sets: DataFrame, counts: np.ndarray, rule: Rule) -> DataFrame:
    """(token, cls, n, core, hot): the prefix of each class, at most once for a task.

    core marks its first part, hot the tokens of hot slots.
    """
    shared, slots = sets.sparkSession.sparkContext.broadcast(counts), np.uint64(len(counts))
    limit = max(HOT, HOT_TIMES * float(counts.mean()))

    @frees
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen = shared.value, set()
        for batch in batches:
            tokens, classes, sizes, core, hot = [], [], [], [], []
            for cls, own in zip(batch.column("cls").to_pylist(), _tokens(batch), strict=True):
                if not len(own) or cls in seen:
                    continue
                seen.add(cls)
                take = rule.prefix(len(own))
                times = frequency[(own % slots).astype(np.int64)]
                order = np.argsort(times, kind="stable")[:take]  # own is sorted: ties by token
                tokens.append(own[order])
                hot.append(times[order] > limit)
                classes.append(np.full(take, cls, dtype=np.int64))
                sizes.append(np.full(take, len(own), dtype=np.int64))
                core.append(np.arange(take) < rule.core(len(own)))
            if tokens:
                yield _arrow({"token": (np.concatenate(tokens).view(np.int64), pa.int64()), "cls": (np.concatenate(classes), pa.int64()), "n": (np.concatenate(sizes), pa.int64()), "core": (np.concatenate(core), pa.bool_()), "hot": (np.concatenate(hot), pa.bool_())})

    return sets.select("cls", "tokens").mapInArrow(make, "token long, cls long, n long, core boolean, hot boolean")


def possible_partners(entries: DataFrame, rule: Rule, rounds: int = 2) -> DataFrame:
    """The entries of classes that share enough of their prefix with others, and of tokens that several of those have.

    Tokens of hot slots are taken to be shared: they are dealt by class as
    well, so that no task gets all rows of one. That keeps more, never less.
    """
    by = ["token", "spread"]
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("cls"), F.lit(1 << 16))).otherwise(F.lit(0))
    group = Window.partitionBy(*by)
    frequent = F.col("hot") | (F.min("cls").over(group) < F.max("cls").over(group))
    shared = entries.withColumn("spread", spread).repartition(*by).withColumn("_more", frequent).where("_more").drop("_more")
    now = settle(shared.dropDuplicates([*by, "cls", "n", "core"]), "entries")
    # enough(n) in SQL: integer divisions as in Rule.
    least = F.expr(f"(n * {rule.percent} + 99) div 100")
    enough = F.greatest(F.lit(1), F.floor(least / 10))
    for _ in range(rounds):
        staying = F.count("*").over(Window.partitionBy("cls")) >= enough
        kept = now.withColumn("_stays", staying).where("_stays").drop("_stays")
        before, now = now, settle(kept.withColumn("_more", frequent).where("_more").drop("_more"), "entries")
        discard(before)
    return now.drop("spread", "hot")


def _filter_places(classes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    own = classes.view(np.uint64)
    return (own % np.uint64(bits)).astype(np.int64), ((own >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)


def filter_bits(classes: int) -> int:
    low, high = FILTER_BITS
    return min(high, max(low, 1 << int(classes * 10).bit_length()))


def candidate_filter(classes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of class numbers, as bytes: a bounded size, all classes in it."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for places in _filter_places(batch.column("cls").to_numpy(), bits):
            np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))

    return merged_table(classes.select("cls"), fill, bits // 8, "uint8", np.bitwise_or)


def candidate_sets(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, tokens), once for each of the given classes. Other sets are left out before the shuffle, by the filter."""
    bits = filter_bits(classes.count())
    shared = sets.sparkSession.sparkContext.broadcast(candidate_filter(classes, bits))

    @frees
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            own = batch.column("cls").to_numpy()
            a, b = _filter_places(own, bits)
            rows = np.flatnonzero((table[a >> 3] >> (a & 7)).astype(np.uint8) & (table[b >> 3] >> (b & 7)).astype(np.uint8) & 1)
            rows = [i for i in rows.tolist() if not (own[i] in seen or seen.add(own[i]))]
            if rows:
                yield batch.take(pa.array(rows))

    found = sets.select("cls", "tokens").mapInArrow(make, "cls long, tokens binary")
    once = lambda rows: rows.groupBy("cls").agg(F.first("tokens").alias("tokens"))
    if few(classes, CHAIN_ROWS):
        return once(found.join(F.broadcast(classes), "cls", "left_semi"))
    return once(found).join(classes.hint("merge"), "cls", "left_semi")  # the sets stay where they were dealt


# ---- signature trees


def width_of(size: int, widest: int = WIDEST) -> int:
    """Words of 64 bits in a bitmap: about two bits for each shingle, a power of two from 4 to ``widest``."""
    return min(widest, 1 << max(2, int(np.ceil(np.log2(max(size, 1) * 2 / 64))) if size > 32 else 2))


def bitmap_of(tokens: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, dtype=np.uint8)
    out[((tokens >> np.uint64(20)) % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bitmaps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: bit i of the result is set if bit i or i + width / 2 is."""
    half = bitmaps.shape[1] // 2
    return bitmaps[:, :half] | bitmaps[:, half:]


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> list[tuple[int, int]]:
        """An edge from each row to the least one of its component."""
        return [(i, r) for i in range(len(self.parent)) if (r := self.root(i)) != i]


class Node:
    __slots__ = ("bits", "low", "high", "excess", "rows", "children")

    def __init__(self, bits, low, high, excess, rows=None, children=()):
        self.bits, self.low, self.high, self.excess, self.rows, self.children = bits, low, high, excess, rows, children

    def one(self, union: Union) -> int:
        """The component of all rows below, or -1."""
        if self.rows is not None:
            roots = {union.root(r) for r in self.rows.tolist()}
        else:
            roots = {c.one(union) for c in self.children}
        return roots.pop() if len(roots) == 1 else -1


def signature_tree(rows: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, excess: np.ndarray) -> Node:
    """A tree over ``rows`` (indices): leaves of LEAF rows in order of size and bitmap, FANOUT children to a node."""
    order = rows[np.lexsort((bitmaps[rows, 0], sizes[rows]))]
    level = [Node(np.bitwise_or.reduce(bitmaps[part]), int(sizes[part].min()), int(sizes[part].max()), int(excess[part].max()), part) for part in np.split(order, range(LEAF, len(order), LEAF))]
    while len(level) > 1:
        level = [Node(np.bitwise_or.reduce([c.bits for c in part]), min(c.low for c in part), max(c.high for c in part), max(c.excess for c in part), None, part) for part in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))]
    return level[0]


def traverse(a: Node, b: Node, rule: Rule, union: Union, leaves: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Visits the pairs of leaves that may hold partners not connected yet."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if min(x.high, y.high) * 100 < rule.percent * max(x.low, y.low):
            continue
        most = min(int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.excess, y.excess), x.high, y.high)
        if most < rule.needed(x.low, y.low):
            continue
        one = x.one(union)
        if one >= 0 and one == (one if x is y else y.one(union)):
            continue
        if x.rows is not None and y.rows is not None:
            leaves(x.rows, y.rows)
        elif x is y:
            stack += [(p, q) for i, p in enumerate(x.children) for q in x.children[i:]]
        else:
            stack += [(p, y) for p in x.children] if x.rows is None and (y.rows is not None or x.high - x.low >= y.high - y.low) else [(x, q) for q in y.children]


def possible_pairs(sizes: np.ndarray, bitmaps: list[np.ndarray], rule: Rule, union: Union, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, sides: np.ndarray | None = None) -> None:
    """Joins in ``union`` what may be (with ``exact``: is) similar. ``sides``: only pairs of different sides, if given."""
    widths = np.array([len(b) for b in bitmaps])
    level: dict[int, tuple] = {}
    for width in sorted(set(widths.tolist()), reverse=True):
        rows = np.flatnonzero(widths == width)
        maps = np.zeros((len(sizes), width), dtype=np.uint64)
        maps[rows] = np.stack([bitmaps[i] for i in rows])
        level[width] = (rows, maps)

    def pairs(own: np.ndarray, other: np.ndarray, maps: np.ndarray, same: bool) -> None:
        spare = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)

        def leaves(p: np.ndarray, q: np.ndarray) -> None:
            most = np.bitwise_count(maps[p][:, None, :] & maps[q][None, :, :]).sum(axis=2).astype(np.int64) + np.minimum(spare[p][:, None], spare[q][None, :])
            fits = np.minimum(most, np.minimum(sizes[p][:, None], sizes[q][None, :])) >= rule.needed(sizes[p][:, None], sizes[q][None, :])
            if p is q:
                fits = np.triu(fits, 1)
            if sides is not None:
                fits &= sides[p][:, None] != sides[q][None, :]
            i, j = np.nonzero(fits)
            if exact is not None and len(i):
                apart = np.array([union.root(x) != union.root(y) for x, y in zip(p[i].tolist(), q[j].tolist(), strict=True)])
                i, j = i[apart], j[apart]
                if len(i):
                    held = exact(p[i], q[j])
                    i, j = i[held], j[held]
            for x, y in zip(p[i].tolist(), q[j].tolist(), strict=True):
                union.join(x, y)

        top = signature_tree(own, sizes, maps, spare)
        traverse(top, top if same else signature_tree(other, sizes, maps, spare), rule, union, leaves)

    for width, (rows, maps) in level.items():
        if len(rows) > 1:
            pairs(rows, rows, maps, True)
        if width // 2 in level:  # partners' sizes are within a factor of two, and so are their widths
            small, small_maps = level[width // 2]
            both = small_maps.copy()
            both[rows] = fold(maps[rows])
            pairs(rows, small, both, False)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_EDGES = "a long, b long"


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return _arrow({"a": ([e[0] for e in edges], pa.int64()), "b": ([e[1] for e in edges], pa.int64())})


def _units(placed: DataFrame, name: Column) -> DataFrame:
    """Rows with a number of ``blocks``, dealt: ``own`` block, and once for each pair of blocks i <= j that has it."""
    own = F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    return placed.withColumn("own", own).withColumn("unit", pair).withColumns({"i": F.col("unit.i"), "j": F.col("unit.j")}).drop("unit", "blocks")


def _sides(group: pa.Table) -> np.ndarray | None:
    """For a pair of different blocks the block of each row: only pairs across are looked at."""
    return None if group.column("i")[0].as_py() == group.column("j")[0].as_py() else group.column("own").to_numpy()


def bucket_forest(entries: DataFrame, signatures: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span what the trees of each token's classes leave possible."""

    @frees
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in _grouped(batches, ["token", "i", "j"]):
            if group.num_rows < 2:
                continue
            classes = group.column("cls").to_numpy()
            union = Union(len(classes))
            bitmaps = [np.frombuffer(x, dtype=np.uint64) for x in group.column("bitmap").to_pylist()]
            possible_pairs(group.column("n").to_numpy(), bitmaps, rule, union, sides=_sides(group))
            edges += [(int(classes[a]), int(classes[b])) for a, b in union.stars()]
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = []
        if edges:
            yield _edge_batch(edges)

    core = entries.where("core").select("token", "cls", "n")
    own = F.xxhash64("cls")
    alike = [F.count("*").alias("size"), F.bit_xor(own).alias("x"), F.sum(F.shiftrightunsigned(own, 34)).alias("y"), F.min("cls").alias("low"), F.max("cls").alias("high")]
    kept = core.groupBy("token").agg(*alike).where("size > 1").groupBy("size", "x", "y", "low", "high").agg(F.min("token").alias("token"))
    kept = settle(kept.select("token", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "tokens")
    dealt = join_small(core, kept, ["token"], most=CHAIN_ROWS)
    if kept.where("blocks > 1").limit(1).count():
        dealt = _units(dealt, F.col("cls"))
    else:
        dealt = dealt.drop("blocks").withColumns({k: F.lit(0) for k in ("own", "i", "j")})
    joined = dealt.join(signatures, "cls").select("token", "i", "j", "own", "cls", "n", "bitmap")
    return joined.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "cls").mapInArrow(make, _EDGES).distinct()


def signatures_of(sets: DataFrame) -> DataFrame:
    @frees
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _arrow({"cls": (batch.column("cls"), pa.int64()), "bitmap": ([bitmap_of(t, width_of(len(t), WIDEST_SENT)).tobytes() for t in _tokens(batch)], pa.binary())})

    return sets.mapInArrow(make, "cls long, bitmap binary")


def exact_links(sets: DataFrame, groups: DataFrame, rule: Rule, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, bool]:
    """Edges (a, b) that span the similar classes of each candidate group (node, root), and whether no group was divided.

    In an undivided group the edges are stars about a component's least class.
    """
    members = join_small(sets.select("cls", F.octet_length("tokens").alias("bytes")), groups.withColumnRenamed("node", "cls"), ["cls"], salt=1, most=CHAIN_ROWS)
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int")
    size = settle(members.groupBy("root").agg(blocks.alias("blocks")), "sizes")
    units = settle(_units(join_small(members.drop("bytes"), size, ["root"], most=CHAIN_ROWS), F.col("cls")).select("root", "i", "j", "own", "cls"), "units")
    dealt = join_small(sets.select("cls", "tokens"), units, ["cls"], salt=1, most=CHAIN_ROWS).select("root", "i", "j", "own", "cls", "tokens")

    @frees
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in _grouped(batches, ["root", "i", "j"]):
            if group.num_rows < 2:
                continue
            classes = group.column("cls").to_numpy()
            tokens = [x.view(np.uint64) for x in slices(group.column("tokens").combine_chunks())]
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            bitmaps = [bitmap_of(t, width_of(len(t))) for t in tokens]
            every = np.concatenate(tokens)
            every.sort()
            every = every[np.concatenate(([True], every[1:] != every[:-1]))]
            own = [np.searchsorted(every, t).astype(np.int32) for t in tokens]
            mark = np.zeros(len(every), dtype=bool)
            del tokens, every

            def similar(p: np.ndarray, q: np.ndarray, own=own, mark=mark, sizes=sizes) -> np.ndarray:
                out, last = np.zeros(len(p), dtype=bool), -1
                for k in np.argsort(p, kind="stable").tolist():
                    if p[k] != last:
                        if last >= 0:
                            mark[own[last]] = False
                        last = int(p[k])
                        mark[own[last]] = True
                    common = int(np.count_nonzero(mark[own[q[k]]]))
                    out[k] = 100 * common >= rule.percent * (sizes[p[k]] + sizes[q[k]] - common)
                if last >= 0:
                    mark[own[last]] = False
                return out

            union = Union(len(classes))
            possible_pairs(sizes, bitmaps, rule, union, similar, _sides(group))
            edges += [(int(classes[a]), int(classes[b])) for a, b in union.stars()]
            del own, bitmaps, group
            pa.default_memory_pool().release_unused()
        if edges:
            yield _edge_batch(edges)

    found = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "cls").mapInArrow(make, _EDGES)
    return found.distinct(), size.agg(F.max("blocks")).first()[0] in (None, 1)


def near_components(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, row (a hash of its text), n_shingles, component (a struct), copies_of.

    Sets of similarity percent / 100 or more are linked; a component is what
    links reach. ``component`` holds none/id/row of its first row: smallest
    identifier, null last, then by hash; identifiers may be of any type with
    an order and stay as they are. Null or empty text has no shingles and is a
    component alone. Repeated rows are equal rows of one component.
    An empty table gives an empty result; extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    sets = settle(shingle_sets(slim, rule), "sets")
    shared = settle(clashes(sets.select("cls", "sure")), "clashes")
    if shared.limit(1).count():
        whole = sets
        sets = settle(apart(whole, shared), "sets")
        discard(whole)
    rows = settle(sets.select("id", "row", "n", "cls", "run"), "rows")
    entries = possible_partners(prefixes(sets, slot_counts(sets), rule), rule)
    classes = settle(entries.select("cls").distinct(), "classes")
    chosen = settle(candidate_sets(sets, classes), "chosen")
    discard(sets)
    forest = settle(bucket_forest(entries, signatures_of(chosen), rule), "forest")
    discard(entries)
    groups = settle(connected(forest, "a", "b"), "groups")
    discard(forest)
    links, whole = exact_links(chosen, groups, rule)
    links = settle(links, "links")
    discard(chosen, groups)
    if whole:  # stars already
        roots = links.select(F.col("a").alias("cls"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("cls"), F.col("b").alias("root")).distinct())
    else:
        roots = connected(links, "a", "b").withColumnRenamed("node", "cls")
    roots = settle(roots, "roots")
    who = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    own = settle(join_small(rows, roots, ["cls"], most=CHAIN_ROWS).groupBy("root").agg(F.min(who).alias("linked")), "components")
    linked = settle(join_small(roots, own, ["root"], most=CHAIN_ROWS).select("cls", "linked"), "linked")
    copies = elect(rows, ["cls"], who, RUNS, FAN).select("cls", "run", F.col("first").alias("copied"))
    found = join_small(rows.join(copies, ["cls", "run"], "left"), linked, ["cls"], "left", most=CHAIN_ROWS)
    component: Column = F.when(F.col("n") == 0, who).otherwise(F.coalesce("linked", "copied", who))
    return found.select("id", "row", F.col("n").alias("n_shingles"), component.alias("component"))


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """identifier, n_shingles, component_id (see near_components)."""
    found = near_components(docs, Rule(n, percent), id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", F.col("component.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each component, all columns as they were, whatever their names.

    First is the smallest identifier, null last, then the smallest hash of the
    text; rows that repeat identifier and text stay or go together. Rows of no
    words all stay. An empty table stays empty.
    """
    found = near_components(docs, Rule(n, percent), id_col, text_col)
    first = F.col("component.id").eqNullSafe(F.col("id")) & (F.col("component.row") == F.col("row"))
    gone = settle(found.where(~first).select(*row_keys("id", F.col("row"))).toDF("none", "own", "digest").distinct(), "gone")
    digest = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return matched(docs, row_keys(id_col, digest), gone, "left_anti")
