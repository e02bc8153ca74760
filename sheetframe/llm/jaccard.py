"""Exact Jaccard self-join on word shingles, by signature trees.

1. Texts become sets of 64-bit shingle hashes; equal sets (128-bit digest) are one class from here on.
2. A set of n shingles that is linked with another shares at least t*n of them, so of its n - t*n + j smallest hashes (its
   head) at least j are in another set's head as well. Only sets that pass this are read on: in most corpora a small part.
   Of these, only sets of which t*n shingles are found in other such sets are kept. Both filters lose no pair.
3. What remains is dealt to trees. Two linked sets differ in at most k = S(1-t)/(1+t) elements (S: both sizes). If the hash
   range is cut into k+1+e parts, every differing element spoils one part at most, so e+1 parts agree in full. Agreement on
   a part that is not empty becomes an equality of hashes, in bands of similar size; the smallest class of each bucket is
   linked to the others (a star, not pairs), and connected components of these stars hold every pair that can qualify.
4. The sets of a component meet in one task and form a signature tree: nodes hold the OR of the bitmaps
   of their sets, the range of their sizes, and the most elements that share a bit with another. Two nodes'
   sets overlap in at most popcount(a AND b) plus the smaller of those excesses; a dual traversal drops node
   pairs that cannot reach the overlap needed, and those whose sets are all linked already. What is left
   is compared exactly. The trees decide every link; steps 2 and 3 only say which sets meet in a tree.
5. A component too large for one task is settled by its stars alone if these, compared exactly, already join all of it
   (as in a large group of near copies). Otherwise it is cut into blocks of similar sizes, and pairs of blocks are the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common as C
from .components import components
from .meeting import flat, listed, shared_counts, stars

#: Shingles in one block of a task; a component with more is cut. 8 bytes each.
BLOCK = 1_000_000
#: A checked bound of broadcasts: rows of 16 bytes.
BROADCAST_ROWS = 500_000
FANOUT = 8
#: One in so many shingles of a set must be found elsewhere before all of them are looked at.
HEAD = 10


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n words, sorted within each text, and their text. Fewer words are one shingle together; no words, none."""
    buf = C.lowered(buf)
    starts, ends, doc = C.words(buf, offsets)
    hashes = C.span_hashes(buf, starts, ends)
    grams, at = C.windows(hashes, doc, n)
    of = doc[at]
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        first = np.searchsorted(doc, few)
        extra = np.zeros(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                on = counts[few] > k
                extra[on] = C.mix(extra[on] * np.uint64(0x100000001B3) + hashes[first[on] + k] + np.uint64(k + 1))
        grams, of = np.concatenate([grams, extra]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    bounds = np.searchsorted(of, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], of[new]


def band_edges(largest: int = 1 << 40) -> list[int]:
    """Sizes at which bands of sets begin, each about a quarter larger than the one before."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, ceil(out[-1] * 1.25)))
    return out


EDGES = np.array(band_edges())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def spare_parts(band: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """How many parts of the smallest sets of a band are empty, with room for chance: so many more parts are made."""
    least = np.maximum(percent * EDGES[band] // 100, 1)
    empty = (differ + 1) * np.exp(-least / (differ + 1))
    return 1 + np.ceil(1.25 * empty + 2 * np.sqrt(empty)).astype(np.int64)


def heads(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of these sizes: how many of their smallest hashes are looked at, and how many of those a linked set's head has too.

    A linked set B holds at least need(A) = ceil(t|A|) elements of A, so B lacks at most |A| - need(A). The r-th smallest common
    element has therefore a rank of at most r + |A| - need(A) in A and of r + |B| - need(B) in B. Heads of |X| - need(X) + j(X)
    both hold the min(j(A), j(B)) smallest common ones, and B has need(A) elements or more.
    """

    def need(n: np.ndarray) -> np.ndarray:
        return -(-percent * n // 100)

    def more(n: np.ndarray) -> np.ndarray:
        return np.minimum(n // HEAD + 1, need(n))

    return sizes - need(sizes) + more(sizes), more(need(sizes))


def part_keys(grams: np.ndarray, of: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (and their text) such that two sets of percent or more, unless equal, have a key in common.

    A pair belongs to the band of its larger set; a set also goes to every later band whose smallest could still match it.
    """
    own = np.searchsorted(EDGES, np.maximum(sizes, 1), "right") - 1
    keys, texts = [], []
    for step in range(len(EDGES)):
        band = np.minimum(own + step, len(EDGES) - 2)
        reach = (sizes > 0) & (own + step == band) & ((step == 0) | (100 * sizes >= percent * EDGES[band]))
        if not reach.any():
            break
        differ = 2 * (EDGES[band + 1] - 1) * (100 - percent) // (100 + percent)
        reach &= differ > 0  # else only equal sets match
        extra = spare_parts(band, differ, percent)
        parts = np.where(reach, differ + 1 + extra, 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        on = reach[of]
        if not on.any():
            continue
        g, t = grams[on], of[on]
        # Monotone in the hash: sorted sets have sorted parts.
        part = ((g >> np.uint64(32)) * parts[t].astype(np.uint64)) >> np.uint64(32)
        slot = base[t] + part.astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1])
        with np.errstate(over="ignore"):
            place = C.mix(band[t[first]].astype(np.uint64) << np.uint64(40) | part[first])
            keys.append(C.mix(np.add.reduceat(C.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first) + place))
        texts.append(t[first])
        empty = parts - np.bincount(t[first], minlength=len(sizes))
        sparse = np.flatnonzero(reach & (empty > extra))  # rare: then agreement may be on empty parts alone
        if len(sparse):
            vacant = np.ones(int(base[-1]), bool)
            vacant[slot[first]] = False
            slots = np.flatnonzero(vacant & np.repeat(np.isin(np.arange(len(sizes)), sparse), parts))
            d = np.searchsorted(base, slots, "right") - 1
            keys.append(C.mix(C.mix(band[d].astype(np.uint64) << np.uint64(40) | (slots - base[d]).astype(np.uint64)) ^ np.uint64(0x5C5C5C5C5C5C5C5C)))
            texts.append(d)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(texts)


def _more(need: Column, percent: int) -> Column:
    """What heads() says of sets of that size, as a Column."""
    return F.least(F.floor(need / HEAD) + 1, F.ceil(need * percent / F.lit(100)))


def _digests(grams: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.bincount(of, minlength=n).astype(np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros((2, n), np.uint64)
    if len(full):
        first = np.searchsorted(of, full)
        for k, salt in enumerate((0x1234567, 0x7654321)):
            with np.errstate(over="ignore"):
                out[k, full] = C.mix(np.add.reduceat(C.mix(grams ^ np.uint64(salt)), first) + sizes[full].astype(np.uint64))
    return sizes, out[0], out[1]


class Tree:
    """Levels of a signature tree over sets in a given order; level 0 has the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        largest = max(map(len, sets))
        bits = 256
        while bits < 12 * largest and len(sets) * bits < 1 << 28:
            bits *= 2
        low = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(sets):
            low[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        words = np.packbits(low, axis=1).view(np.uint64)
        sizes = np.array([len(s) for s in sets])
        self.levels = [(words, sizes, sizes, sizes - np.bitwise_count(words).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            words, low_n, high_n, excess = self.levels[-1]
            at = np.arange(0, len(words), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at), np.maximum.reduceat(excess, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether any sets below nodes a and b could reach the percentage."""
        words, low, high, excess = self.levels[level]
        fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        need = percent * (low[a] + low[b])
        if fits.any():
            x, y = a[fits], b[fits]
            most = np.bitwise_count(words[x] & words[y]).sum(1, dtype=np.int64) + np.minimum(excess[x], excess[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            fits[fits] = (100 + percent) * most >= need[fits]
        return fits


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) * 16 > len(y) and len(y) * 16 > len(x) else int(np.isin(x, y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def linked(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set, the position of its component's first set, over links between all sets (or only those of different sides)."""
    n = len(sets)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def check(i: int, j: int) -> bool:
        a, b = find(i), find(j)
        if a == b or side is not None and side[i] == side[j] or not similar(sets[i], sets[j], percent):
            return False
        parent[max(a, b)] = min(a, b)
        return True

    order = sorted(range(n), key=lambda i: (int(sets[i][0]), len(sets[i])))
    for i, j in zip(order, order[1:], strict=False):
        check(i, j)
    if n > 2:
        tree = Tree([sets[i] for i in order])
        at = np.array(order)
        stale, labels = True, []
        top = len(tree.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 2048:
                stack += [(level, a[k : k + 2048], b[k : k + 2048]) for k in range(0, len(a), 2048)]
                continue
            if stale:
                leaf = np.array([find(i) for i in order])
                labels = [(leaf, leaf)]
                for k in range(top):
                    cut = np.arange(0, len(labels[k][0]), FANOUT)
                    labels.append((np.minimum.reduceat(labels[k][0], cut), np.maximum.reduceat(labels[k][1], cut)))
                stale = False
            low, high = labels[level]
            on = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[on], b[on]
            on = tree.possible(level, a, b, percent)
            a, b = a[on], b[on]
            if not len(a):
                continue
            if level == 0:
                for i, j in zip(at[a].tolist(), at[b].tolist(), strict=True):
                    stale |= i != j and check(i, j)
                continue
            grid = np.arange(FANOUT)
            x = (a[:, None, None] * FANOUT + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
            y = (b[:, None, None] * FANOUT + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
            size = len(tree.levels[level - 1][0])
            on = (x <= y) & (y < size)
            if level == 1:
                on &= x < y
            stack.append((level - 1, x[on], y[on]))
    return np.array([find(i) for i in range(n)])


def similarity_components(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of docs: `key`, n_shingles (long, size of the set of n-word shingles), component_id.

    Texts link when 100 * |intersection| >= percent * |union|; component_id is the smallest `key` that links reach.
    A-Z count as a-z; words are runs without white space. Texts with fewer than n words are one shingle; null texts
    and those without words are empty and linked with nothing, equal ones neither. Rows whose key is null are linked
    with nothing and have a null component. Repeated rows get equal results. An empty table gives no rows. Keys are whole
    numbers; others are a TypeError (number them first).
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must hold whole numbers")
    spark = docs.sparkSession
    C.small_arrow(spark)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))

    def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        buf, offsets = C.text_bytes(batch.column(batch.num_columns - 1))
        for a, b in C.chunks(offsets):
            yield a, b, *shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text in one task give its head once
        for batch in batches:
            for a, b, grams, of in sets_of(batch):
                sizes, d1, d2 = _digests(grams, of, b - a)
                new = np.zeros(b - a, bool)
                for i, d in enumerate(d1.tolist()):
                    if d not in seen:
                        seen.add(d)
                        new[i] = True
                length = np.where(new, heads(sizes, percent)[0], 0)
                on = np.arange(len(grams)) - np.searchsorted(of, np.arange(b - a))[of] < length[of]
                head = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), _signed(grams[on]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), _signed(d1), _signed(d2), head], names=["id", "n", "d1", "d2", "head"])

    def as_list(grams: np.ndarray, of: np.ndarray, size: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(size + 1)).astype(np.int32)), _signed(grams))

    def sets_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, of in sets_of(batch):
                sizes, d1, d2 = _digests(grams, of, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), _signed(d1), _signed(d2), as_list(grams, of, b - a)], names=["rep", "n", "d1", "d2", "s"])

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return part_keys(*flat(batch.column(1)), percent)

    # Rows are numbered once, and the numbers are kept: they stand for sets from here on.
    table = C.kept(source.mapInArrow(summarise, "id long, n long, d1 long, d2 long, head array<long>").withColumn("row", F.monotonically_increasing_id()))
    classes = table.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    least = _more(F.ceil(F.col("n") * percent / F.lit(100)), percent)
    found = shared_counts(table.where("id is not null").select("row", "head"), listed, table.agg(F.sum(F.size("head"))).first()[0] or 0)
    passed = table.select("row", "n", "d1", "d2").join(found, "row").where(F.col("shared") >= least).select("d1", "d2", "n").distinct()
    wanted = C.kept(classes.join(passed, ["d1", "d2", "n"], "left_semi").select("rep").distinct())
    texts = source.where("id is not null and t is not null")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # the bound of the broadcast, checked
    chosen = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), texts["id"] == wanted["rep"]).select("rep", "t")
    # Repeated rows of one key: any of them serves if they are equal; if not, all sets of the key take part.
    sets = chosen.mapInArrow(sets_out, "rep long, n long, d1 long, d2 long, s array<long>").where("n > 0").dropDuplicates(["rep", "d1", "d2"])
    sets = C.kept(sets.withColumn("row", F.monotonically_increasing_id()))
    size = sets.agg(F.sum("n")).first()[0] or 0
    found = shared_counts(sets.select("row", "s"), listed, size)
    left = sets.select("row", "n").join(found, "row").where(F.col("shared") >= F.ceil(F.col("n") * percent / F.lit(100))).select("row")
    sets = C.kept(sets.join(left, "row", "left_semi").sortWithinPartitions("row"))
    star_edges = C.kept(stars(sets.select("row", "s"), keyed, size))
    groups = components(star_edges)
    members = C.kept(sets.join(groups, sets["row"] == groups["node"]).select("rep", "n", "row", "s", F.col("label").alias("c")))
    # Components of more than a block: their stars are compared exactly, and those that are one by these links are done.
    large = C.kept(members.groupBy("c").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK).select("c"))
    any_large = large.limit(1).count() > 0
    settled = None
    if any_large:
        of_large = members.join(large, "c", "left_semi")
        x, y = (of_large.select(F.col("row").alias(e), F.col("rep").alias(f"r{e}"), F.col("s").alias(f"s{e}"), *([F.col("c")] if e == "a" else [])) for e in "ab")
        near = star_edges.join(x, "a").join(y, "b").select("ra", "rb", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("m"))
        settled = C.kept(near.where((F.col("ra") != F.col("rb")) & (100 * F.col("m") >= percent * (F.col("na") + F.col("nb") - F.col("m")))).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        joined = components(settled)
        parts_of = of_large.select("c", "rep").join(joined, F.col("rep") == F.col("node"), "left").groupBy("c").agg(F.min(F.coalesce("label", "rep")).alias("lo"), F.max(F.coalesce("label", "rep")).alias("hi"))
        done = parts_of.where("lo = hi").select("c")
        large = C.kept(large.join(done, "c", "left_anti"))
        members = C.kept(members.join(done, "c", "left_anti"))

    # What is still large is cut by size (neighbouring bands only can match) and hash.
    ratio = float(np.log(100 / percent))
    banded = members.drop("s").withColumn("band", F.floor(F.log(F.col("n")) / ratio).cast("int"))
    if any_large:
        cuts = banded.join(large, "c").groupBy("c", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("m"))
        shifted = lambda step, name: cuts.select(F.col("c"), (F.col("band") + step).alias("band"), F.col("m").alias(name))
        placed = banded.join(large.select("c", F.lit(True).alias("is_large")), "c", "left").join(cuts, ["c", "band"], "left").join(shifted(1, "below"), ["c", "band"], "left").join(shifted(-1, "above"), ["c", "band"], "left")
        block = F.pmod(F.xxhash64("row"), F.coalesce("m", F.lit(1))).cast("int")
        # A task is a pair of blocks (band, block, other band, other block); a set goes to all of its block's pairs.
        tasks = F.expr("""case when is_large is null then array(named_struct('x', concat('c', c), 'side', 0)) else concat(
            transform(sequence(0, m - 1), j -> named_struct('x', concat_ws(':', c, band, least(j, j0), band, greatest(j, j0)), 'side', case when j = j0 then 0 when j0 < j then 1 else 2 end)),
            transform(case when above > 0 then sequence(0, above - 1) else array() end, j -> named_struct('x', concat_ws(':', c, band, j0, band + 1, j), 'side', 1)),
            transform(case when below > 0 then sequence(0, below - 1) else array() end, j -> named_struct('x', concat_ws(':', c, band - 1, j, band, j0), 'side', 2))) end""")
        assigned = placed.withColumn("j0", block).select("row", F.explode(tasks).alias("task")).select("row", "task.x", "task.side")
        work = assigned.join(members.select("rep", "row", "s"), "row").select("x", "side", "rep", "s")
    else:
        work = members.select(F.col("c").cast("string").alias("x"), F.lit(0).alias("side"), "rep", "s")
    work = work.repartition(C.partitions(spark), "x").sortWithinPartitions("x")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list) -> tuple[list[int], list[int]]:
            reps, sides = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
            roots = linked([r[2] for r in rows], sides if sides.any() else None, percent)
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, roots, reps)
            on = least[roots] != reps
            return reps[on].tolist(), least[roots][on].tolist()

        task, rows, a, b = None, [], [], []
        for batch in batches:
            grams, of, sizes = flat(batch.column(3))
            each = np.split(grams, np.cumsum(sizes)[:-1]) if len(sizes) else []
            for x, side, rep, s in zip(*(c.to_pylist() for c in batch.columns[:3]), each, strict=True):
                if x != task:
                    if len(rows) > 1:
                        found = solved(rows)
                        a += found[0]
                        b += found[1]
                    task, rows = x, []
                rows.append((side, rep, s))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if len(rows) > 1:
            a, b = solved(rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = C.kept(work.mapInArrow(link, "a long, b long"))
    # Tasks over whole components have found the smallest member already; links of cut components are joined up.
    labels = components(links.unionAll(settled)) if settled is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    final = classes.join(labels, classes["rep"] == labels["node"], "left").select("d1", "d2", "n", F.coalesce("label", "rep").alias("component_id"))
    return (
        table.join(final, ["d1", "d2", "n"], "left")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    )
