"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 % or more.

Documents with the same set are one class. Links are sought in two rounds.

The first is a quick look: classes with the same least shingle, by LOOKS different
orders, are sorted together and near neighbours are compared, set against set. It finds most links of large
groups with a number of comparisons in proportion to the input, never a group's square.

The second is complete: for a shared shingle order - rare ones first, by a count
sketch of fixed size over all texts, then by hash - two linked sets share a shingle
among the first fifth of the larger and the first ninth of the smaller. These entries
meet by shingle. Where all sets of a shingle are joined already nothing is left to
do; else its sets are laid into tiles by bands of size (and by blocks, where they are
many), and in each tile hashed bitmaps are compared: the bits that one set has and
the other lacks bound the overlap from above. Pairs across components that may still
link are decided by an exact intersection of the sorted arrays. Nothing is capped.

These rounds give enough links to join each component. As linked classes are always in
one component, all links are counted there: its sets are dealt into blocks, each pair of
blocks is compared set against set, and only sums by class leave a task.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Fewer words than a shingle
make one shingle of the whole; no words (or null) make the empty set, which links with
nothing. Repeated rows are copies of a class. Shingles and sets are told apart by
64-bit hashes. Texts of any length are whole; a pair that meets the share exactly links. Other
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.operators.graph import connected_components

from .common import KeyFilter, Words, cut, grams, mix, partitions, powers, tidy, whole_row, written

SHINGLE = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of the sketch, and the row that carries so many of them.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Orders of the first round, and sets that each one is held against in each.
LOOKS, BEFORE = 3, 32
#: Prefix entries in one lot of shingles, sets with their bitmaps in one lot of tiles, and sets in one block of a tile.
TILE_ROWS, LOT, BLOCK = 400_000, 8_000, 1024
#: Where links are counted: sets in one block of a component, bytes of sets in one lot, and shingles in one matrix product.
MEMBERS, LOT_BYTES, COLUMNS = 128, 8 << 20, 4096
#: Entries of one shingle that one task may get; those of more frequent ones are dealt out by class.
HEAVY = 200_000
#: Sets that a worker knows to be joined, at most; then it forgets, and only compares some of them again.
JOINED = 500_000


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    h, starts = words.hashes(), words.offsets
    lengths = np.diff(starts)
    made = grams(h, n)
    counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.r_[0, np.cumsum(counts)]
    at = np.repeat(starts[:-1], counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts))
    values = made[np.minimum(at, max(0, len(made) - 1))] if len(made) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero((lengths > 0) & (lengths < n)):
        own = h[starts[i] : starts[i + 1]]
        values[first[i]] = mix((own * powers(len(own), 7)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))[0]
    order = np.lexsort((values, owner))
    values = values[order]
    keep = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])] if len(values) else np.zeros(0, bool)
    return values[keep], np.r_[0, np.cumsum(np.bincount(owner[keep], minlength=len(lengths)))]


def class_id(values: np.ndarray) -> int:
    """Signed 64 bits that tell a set of shingles."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def bitmap(values: np.ndarray) -> bytes:
    """A set's signature: two bits or more a shingle, a power of two in all."""
    width = 1 << max(6, (2 * len(values) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(values >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """No intersection is larger: of each set, what has a bit that the other lacks cannot be shared."""
    x, y, wx, wy = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    while wx > wy:
        wx //= 2
        x = x >> wx | x & (1 << wx) - 1
    while wy > wx:
        wy //= 2
        y = y >> wy | y & (1 << wy) - 1
    return min(na - (x & ~y).bit_count(), nb - (y & ~x).bit_count())


def enough(inter: int, na: int, nb: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (na + nb - inter)


def prefix_lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """How many of its first shingles a set needs to show as the larger and as the smaller of a pair."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each of COUNTERS hash classes occur, over all documents; 4 MB whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in cut(batch, "text"):
                values, _ = shingles(Words(part.column("text"), lower=True), n)
                total += np.bincount((values >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        tidy()
        rows = total.astype(np.int32).reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([r.tobytes() for r in rows], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(count, "chunk long, counts binary").groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect()
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.int32)
    for chunk, counts in rows:
        out[chunk] = np.frombuffer(bytes(counts), np.int32)
    return out.ravel()


_SLIM = "doc_id long, text_key long, n long, class long, bits binary, prefix binary, least array<long>"


def _least(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The least shingle of each set in each of LOOKS orders; none of an empty set."""
    full = np.flatnonzero(np.diff(starts))
    out = np.stack([np.minimum.reduceat(mix(values ^ seed), starts[full]) for seed in powers(LOOKS, 23)], 1) if len(full) else np.zeros((0, LOOKS), np.uint64)
    offsets = np.r_[0, np.cumsum(np.diff(starts) > 0)] * LOOKS
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.ravel().view(np.int64)))


def _slim(texts: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    mean = counts.mean()
    # What stands out from the counters' own spread is frequent.
    level = texts.sparkSession.sparkContext.broadcast(np.ceil(np.log2(1 + np.maximum(0, counts - mean - 4 * np.sqrt(mean) - 1))).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = level.value
        for batch in batches:
            for part in cut(batch, "text"):
                values, starts = shingles(Words(part.column("text"), lower=True), n)
                sizes, bits, classes, prefixes = np.diff(starts), [], [], []
                least = _least(values, starts)
                often = levels[(values >> np.uint64(44)).astype(np.int64)]
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    own = values[a:b]
                    k = prefix_lengths(len(own), percent)[0] if b > a else 0
                    ordered = own if not often[a:b].any() else own[np.argsort(often[a:b], kind="stable")]
                    classes.append(class_id(own))
                    bits.append(bitmap(own) if b > a else b"")
                    prefixes.append(ordered[:k].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sizes.astype(np.int64)), pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.binary()), least],
                    ["doc_id", "text_key", "n", "class", "bits", "prefix", "least"],
                )
        tidy()

    return texts.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "text").mapInArrow(run, _SLIM)


def _parts(h: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """In how many parts the entries of shingles come: 1 but for those that the sketch has as frequent."""
    return heavy[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64) + 1


def _tiles(classes: DataFrame, percent: int, held) -> DataFrame:
    """Prefix entries by group of tiles, packed: shingles, classes and sizes (negative where only the larger of a pair shows the entry)."""
    total = classes.agg(F.sum(F.length("prefix"))).head()[0] or 0
    groups = max(1, -(-total // (8 * TILE_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            counts = np.array([len(x) for x in prefixes])
            h, sizes = np.concatenate(prefixes), np.asarray(batch.column("n"))
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            short = np.array([prefix_lengths(int(s), percent)[1] for s in sizes])
            size = np.where(place < short[owner], sizes[owner], -sizes[owner]).astype(np.int32)
            parts, own = _parts(h, held.value), np.asarray(batch.column("class"))[owner]
            salt = np.where(parts > 1, (mix(own.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0)
            group = ((mix(h) + mix(salt.astype(np.uint64)) * (salt > 0)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            h, ids, size, group = h[order], own[order], size[order], group[order]
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            spans = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[at[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (h, ids, size))], ["tile", "hashes", "classes", "sizes"]
            )

    return classes.select("n", "class", "prefix").mapInArrow(run, "tile long, hashes binary, classes binary, sizes binary")


def _neighbours(percent: int):
    """Links of sorted (look, least, class, set): each set is held against the last BEFORE with the same least shingle that aren't joined to it already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}  # of sets met so far

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        key, held = None, deque(maxlen=BEFORE)
        for batch in batches:
            found = []
            for look, least, own, stored in zip(*(batch.column(c).to_pylist() for c in ("look", "least", "class", "set")), strict=True):
                if (look, least) != key:
                    key = look, least
                    held.clear()
                    if len(parent) > JOINED:
                        parent.clear()
                values = np.frombuffer(stored, np.uint64)
                for other, theirs in held:
                    na, nb = len(values), len(theirs)
                    if 100 * min(na, nb) < percent * max(na, nb) or root(own) == root(other):
                        continue
                    if enough(_common(values, theirs), na, nb, percent):
                        parent[root(own)] = root(other)
                        found.append((min(own, other), max(own, other)))
                held.append((own, values))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        held.clear()
        tidy()

    return run


def _shared(held):
    """From a lot of shingles: the entries of those that two sets or more show, where the smaller of some pair does. Of frequent ones a lot has a part: all stay."""

    def run(table: pa.Table) -> pa.Table:
        h, ids, size = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("hashes", np.uint64), ("classes", np.int64), ("sizes", np.int32)))
        order = np.argsort(h, kind="stable")
        h, ids, size = h[order], ids[order], size[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        counts = np.diff(np.r_[at, len(h)])
        keep = np.repeat((counts > 1) & (np.add.reduceat(size > 0, at) > 0) | (_parts(h[at], held.value) > 1), counts)
        return pa.table({"h": pa.array(h[keep].view(np.int64)), "class": pa.array(ids[keep]), "size": pa.array(size[keep])})

    return run


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to one width in bytes."""
    out = np.zeros((len(bits), width // 8), np.uint64)
    for i, x in enumerate(bits):
        row = np.frombuffer(x, np.uint64)
        while len(row) > out.shape[1]:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        out[i] = row
    return out


def _compare(ids, roots, size, bits, left, right, percent, out) -> None:
    """Add the pairs of left and right that are in different components and that sizes and bitmaps allow. Both are index arrays; the same one for a tile with itself."""
    width = min(len(bits[i]) for i in (*left, *right))
    x, y = _folded([bits[i] for i in left], width), _folded([bits[i] for i in right], width)
    n, small = np.abs(size), size > 0
    ny = n[right]
    step = max(1, 2_000_000 // (len(right) * x.shape[1]))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        nx = n[rows][:, None]
        fit = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (roots[rows][:, None] != roots[right])
        fit &= np.where(nx < ny, small[rows][:, None], np.where(nx > ny, small[right], small[rows][:, None] | small[right]))
        if not fit.any():
            continue
        a, b = x[k : k + step, None, :], y[None, :, :]
        most = np.minimum(nx - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), ny - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
        i, j = np.nonzero(fit & (100 * most >= percent * (nx + ny - most)))
        out.update(zip(np.minimum(ids[rows[i]], ids[right[j]]).tolist(), np.maximum(ids[rows[i]], ids[right[j]]).tolist(), strict=True))


def _tile_pairs(percent: int):
    """From a lot of tiles: pairs that may link. A tile is a shingle and two blocks; in it, neighbouring bands of size meet."""
    ratio = np.log(100 / percent)

    def run(table: pa.Table) -> pa.Table:
        h, low, high, block, ids, roots, size = (np.asarray(table.column(c)) for c in ("h", "low", "high", "block", "class", "root", "size"))
        bits = table.column("bits").to_pylist()
        band = np.floor(np.log(np.abs(size)) / ratio).astype(np.int64)
        order = np.lexsort((band, block, high, low, h))
        tile = np.stack([h, low, high], 1)[order]
        edges = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(1), True])
        out: set[tuple[int, int]] = set()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            one, two = rows[block[rows] == low[rows[0]]], rows[block[rows] == high[rows[0]]]
            alone = low[rows[0]] == high[rows[0]]
            of = lambda part: {k: part[band[part] == k] for k in np.unique(band[part]).tolist()}
            first, second = of(one), of(two)
            for k, left in first.items():
                for m in (k, k + 1) if alone else (k - 1, k, k + 1):
                    if m in second:
                        _compare(ids, roots, size, bits, left, second[m], percent, out)
        out = {p for p in out if p[0] != p[1]}
        del bits, table
        tidy()
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _overlaps(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many values each set of x shares with each of y, or of x itself where y is None."""
    sets = x + (y or [])
    if len(sets) <= 4:
        return np.array([[_common(a, b) for b in y or x] for a in x])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    left = owner < len(x)
    # Values that only one side or one set has add nothing.
    holders = np.bincount(codes[left], minlength=codes.max() + 1)
    useful = (holders > 0) & (np.bincount(codes[~left], minlength=len(holders)) > 0) if y else holders > 1
    kept = useful[codes]
    column, owner = (np.cumsum(useful) - 1)[codes[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(x), len(y or x)), np.int64)
    for k in range(0, int(useful.sum()), COLUMNS):
        a, b = np.searchsorted(column, (k, k + COLUMNS))
        bits = np.zeros((len(sets), COLUMNS), np.float32)
        bits[owner[a:b], column[a:b] - k] = 1
        out += (bits[: len(x)] @ (bits[len(x) :] if y else bits).T).astype(np.int64)
    if not y:
        np.fill_diagonal(out, [len(v) for v in x])
    return out


def _degrees(percent: int):
    """From a lot of pairs of blocks (root, low, high): how many links each class has in them."""

    def run(table: pa.Table) -> pa.Table:
        root, low, high, block, ids = (np.asarray(table.column(c)) for c in ("root", "low", "high", "block", "class"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        n, degree = np.array([len(x) for x in sets]), np.zeros(len(sets), np.int64)
        order = np.lexsort((block, high, low, root))
        tile = np.stack([root, low, high], 1)[order]
        edges = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(1), True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            one, two = rows[block[rows] == low[rows[0]]], rows[block[rows] == high[rows[0]]]
            alone = low[rows[0]] == high[rows[0]]
            if not len(one) or not len(two):
                continue
            inter = _overlaps([sets[i] for i in one], None if alone else [sets[i] for i in two])
            link = enough(inter, n[one][:, None], n[two], percent)
            if alone:
                np.fill_diagonal(link, False)
            else:
                degree[two] += link.sum(0)
            degree[one] += link.sum(1)
        own, at = np.unique(ids, return_inverse=True)
        total = np.bincount(at, degree, len(own)).astype(np.int64)
        del sets, table
        tidy()
        return pa.table({"class": pa.array(own), "n_links": pa.array(total)})

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(enough(_common(x, y), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return run


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The sorted arrays of some classes, read from one text of each. Texts aren't shuffled, sets are."""
    known = KeyFilter(wanted, "text_key")
    texts = texts.select("text", F.xxhash64("doc_id", "text").alias("text_key")).withColumn("places", known.places())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch.filter(pa.array(known.hit(batch.column("places")))), "text"):
                values, starts = shingles(Words(part.column("text"), lower=True), n)
                own = [values[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array([x.tobytes() for x in own], pa.binary())], ["text_key", "set"])
        tidy()

    # Repeated rows have one text key.
    return wanted.join(texts.select("text_key", "text", "places").mapInArrow(run, "text_key long, set binary").dropDuplicates(["text_key"]), "text_key").select("class", "set")


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of some pairs whose sets do overlap enough."""
    ids = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
    sets = written(_sets(texts, written(classes.select("class", "text_key").join(ids, "class", "left_semi"), "wanted"), n), "sets")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    return written(both.select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long"), "links")


def links(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their class, classes, pairs of classes that link, enough of them to join each component). Documents: doc_id, n, class."""
    spark, texts = docs.sparkSession, _texts(docs)
    counts = _sketch(texts, n)
    heavy = spark.sparkContext.broadcast(np.minimum(counts // HEAVY, 65_535).astype(np.uint16))  # 2 MB whatever the input
    slim = written(_slim(texts, n, percent, counts), "shingles")
    first = [F.first(c).alias(c) for c in ("n", "bits", "prefix", "least")]  # equal in all copies
    classes = written(slim.where("n > 0").groupBy("class").agg(*first, F.min("text_key").alias("text_key")), "classes")
    slight = classes.select("class", "n", "bits")

    # The first round. Neighbours differ from order to order; ranges hold parts of a group where it is large.
    looks = classes.select(F.posexplode("least").alias("look", "least"), "class")
    alike = looks.groupBy("look", "least").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    looks = written(looks.join(alike, ["look", "least"], "left_semi").withColumn("order", F.xxhash64("look", "class")), "looks")
    wanted = classes.select("class", "text_key").join(looks.select("class").distinct(), "class", "left_semi")
    rows = looks.join(_sets(texts, written(wanted, "wanted"), n), "class").repartitionByRange(partitions(spark), "look", "least", "order").sortWithinPartitions("look", "least", "order")
    quick = written(rows.select("look", "least", "class", "set").mapInArrow(_neighbours(percent), "a long, b long"), "quick")
    roots = written(connected_components(quick).select(F.col("node").alias("class"), "root"), "roots")

    # The second round.
    shared = written(_tiles(classes, percent, heavy).groupBy("tile").applyInArrow(_shared(heavy), "h long, class long, size int"), "shared")
    shared = written(shared.join(roots, "class", "left").select("h", "class", "size", F.coalesce("root", "class").alias("root")), "rooted")
    mixed = shared.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("class").alias("hub"), F.count(F.lit(1)).alias("m")).where("low < high")
    mixed = written(mixed.select("h", "hub", "m", F.ceil(F.col("m") / block).alias("blocks")), "mixed")
    # Shingles with the same first set mostly have the same sets: one lot, so that a pair is given out once. Large lots are split.
    parts = mixed.groupBy("hub").agg(F.ceil(F.sum("m") / (2 * LOT)).alias("parts"))
    mixed = written(mixed.join(parts, "hub").select("h", "blocks", F.xxhash64("hub", F.pmod(F.xxhash64("h"), "parts")).alias("near")), "lots")
    rows = shared.join(mixed, "h").withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(slight.select("class", "bits"), "class")
    rows = rows.select("h", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "root", "size", "bits", "near", "blocks")
    lots = max(1, shared.join(mixed, "h", "left_semi").count() // LOT)
    tiles = rows.withColumn("lot", F.pmod(F.xxhash64("near", F.when(F.col("blocks") > 1, F.struct("low", "high"))), F.lit(lots))).drop("near", "blocks").groupBy("lot")
    rest = written(tiles.applyInArrow(_tile_pairs(percent), "a long, b long").distinct(), "pairs")
    return slim.select("doc_id", "n", "class"), classes, quick.unionAll(_verified(texts, classes, rest, n, percent))


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, n, class; classes; class, root, least (its smallest doc_id) and component_id of each class)."""
    rows, classes, pairs = links(docs, n, percent)
    least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    roots = connected_components(pairs).withColumnsRenamed({"node": "class"})
    known = least.join(roots, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    known = written(known, "known")
    component = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, classes, written(known.join(component, "root").select("class", "root", "least", "component_id"), "components")


def _link_counts(docs: DataFrame, classes: DataFrame, known: DataFrame, n: int, percent: int, members: int) -> DataFrame:
    """class and n_links of the classes in components of two or more; every pair within a component is compared."""
    own = classes.select("class", "text_key", "n").join(known.select("class", "root"), "class")
    bytes_ = F.sum("n") * 8
    large = own.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(bytes_ / (LOT_BYTES // 2))).alias("blocks")).where("m > 1")
    own = written(own.join(large.select("root", "blocks"), "root"), "members")
    total = own.agg(F.sum(F.col("n") * F.col("blocks"))).head()[0] or 0
    lots = max(partitions(docs.sparkSession), 8 * total // LOT_BYTES)
    rows = own.select("class", "root", "blocks", F.pmod(F.xxhash64("class"), "blocks").alias("block")).join(_sets(_texts(docs), own, n), "class")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "set")
    lot = F.pmod(F.xxhash64("root", "low", "high"), F.lit(lots)).alias("lot")
    return rows.groupBy(lot).applyInArrow(_degrees(percent), "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, members: int = MEMBERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (the smallest doc_id with the same set; null for the empty one), n_links (classes that its own links with)."""
    rows, classes, known = _components(docs, n, percent)
    counts = written(_link_counts(docs, classes, known, n, percent, members), "degrees")
    known = known.join(counts, "class", "left").select("class", "least", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("n > 0").join(known, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("least").alias("class_id"), "n_links").unionAll(empty)


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all columns: of each component the one with the smallest doc_id.

    Only texts that go, and a few others, are shuffled. Rows with one doc_id share its fate; rows
    without a doc_id can't be told apart and stay.
    """
    rows, _, known = _components(docs, n, percent)
    gone = rows.where("n > 0").join(known, "class").where("doc_id != component_id").select("doc_id").distinct()
    gone = written(gone, "gone")
    filter_, packed = KeyFilter(gone, "doc_id"), docs.select(whole_row(), docs["doc_id"].cast("long").alias("doc_id"))
    return filter_.outside(packed).select("row").unionAll(filter_.inside(packed).join(gone, "doc_id", "left_anti").select("row")).select("row.*")
