"""Substring de-duplication by prefix-partitioned suffix trees.

Suffixes are sampled where every window of WINDOW words has one: at its anchor, the
leftmost least (by a hash) of its ANCHOR-word grams. Equal windows have equal anchors at
equal places, so two documents that share a window have two sampled suffixes that share
at least ANCHOR words on the right and the rest of the window on the left. Neighbouring
windows mostly have one anchor in common, so about one word in eighteen starts a suffix.

1. Census. Each suffix's prefix of ANCHOR words is counted by hash. Prefixes of a single
   document can't hold a repeat: their suffixes go no further.
2. Suffixes of the other prefixes are read with their words: up to WINDOW on the right and
   what their windows have on the left. Within a task equal ones are told from the words,
   and only that of the smallest doc_id goes on.
3. Groups of one prefix are dealt out in memory-sized lots. A group of over BUDGET
   suffixes gets longer prefixes: its windows are split by how far left of the anchor they
   start, which lengthens what all of them share (16, 33, 42, ... up to all 50 words). What
   is one window by then is aggregated on the map side, so no group has to fit a task.
4. A lot's suffixes are sorted word by word: the longest common prefixes of neighbours give
   the subtree's nodes, and the same is done with the words to the left. A window lies at a
   right node and a left node whose depths add up to WINDOW; where several documents are
   below both, all but the smallest doc_id repeat it. Joined windows are maximal repeats.

Hashes choose anchors and deal suffixes out; words alone decide what is equal.

Rule: each word covered by a window whose words also start in a document with a smaller
doc_id goes. A null doc_id counts as larger than all others; equal doc_ids are one
document. Null or empty text has no words; texts of any length are whole. Repeated rows
get equal results; an empty table gives an empty result; columns other than doc_id and
text don't matter, whatever they are called. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Words, cut, mix, plain, tidy, written

WINDOW, ANCHOR = 50, 16
#: Suffixes in one lot of groups, and of one prefix before it is lengthened.
LOT, BUDGET = 10_000, 20_000
#: Entries that a task gathers before it sends them: without words, and with them.
GATHER, GATHER_WORDS = 150_000, 40_000
#: A base and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Entries of a lot of the census: known to be shared, of one document so far, and marks of what is shared elsewhere.
SHARED, ALONE, MARK = 0, 1, 2
_FIELDS = (("prefix", np.uint64), ("doc", np.int64), ("key", np.int64), ("first", np.int32), ("last", np.int32), ("left", np.int32))
_PACKED = "lot long, kind int, " + ", ".join(f"{f} binary" for f, _ in _FIELDS)
_OPEN = "prefix long, doc long, key long, first int, last int, left int"
#: low and high: how far left of the anchor a window of this group may start; near and far: those that the suffix has. context: its words.
_SUFFIX = "prefix long, doc long, key long, first int, low int, high int, near int, far int, context binary"
_RANGES = "doc long, key long, first int, last int"

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any spans of a sequence of word hashes, whatever their place."""

    def __init__(self, h: np.ndarray):
        power, self.inverse = _power(len(h) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64)]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def all(self, n: int) -> np.ndarray:
        at = np.arange(max(0, len(self.sums) - n))
        return self.spans(at, at + n)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The place of the leftmost least of each n consecutive values."""
    at, width = np.arange(len(values)), 1

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    while 2 * width <= n:
        at = join(at[: len(at) - width], at[width:])
        width *= 2
    k = n - width
    return join(at[: len(at) - k], at[k:]) if k else at


def sampled(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray] | None:
    """The sampled suffixes of some texts: text (its number), prefix, first and last window that have it as anchor, and how far left of it the first one starts."""
    h, starts = words.hashes(), words.offsets
    if len(h) < window:
        return None
    grams = Rolling(h).all(anchor)
    place = _least(grams, window - anchor + 1)
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    at = np.flatnonzero(owner[: len(place)] == owner[window - 1 :])
    if not len(at):
        return None
    text, place = owner[at], place[at]
    begin = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    first, last = at[begin], at[np.r_[begin[1:], len(at)] - 1]
    text, place = text[begin], place[begin]
    base = starts[text]
    return {"text": text, "prefix": grams[place], "first": (first - base).astype(np.int32), "last": (last - base).astype(np.int32), "left": (place - first).astype(np.int32)}


def _shared(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, shared): entries by prefix and document; where a prefix begins; whether it has several documents."""
    order = np.lexsort((e["doc"], e["prefix"]))
    prefix, doc = e["prefix"][order], e["doc"][order]
    new = np.r_[True, prefix[1:] != prefix[:-1]]
    begin = np.flatnonzero(new)
    counts = np.diff(np.r_[begin, len(doc)])
    return order, new, np.repeat(doc[begin] < doc[begin + counts - 1], counts)


def _rows(texts: DataFrame) -> DataFrame:
    """Texts with the document's rank (doc_id, null last), and a key that tells its texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return texts.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def _census(lots: int, window: int, anchor: int):
    def send(held: list[dict]) -> pa.RecordBatch:
        e = {f: np.concatenate([x[f] for x in held]) for f, _ in _FIELDS}
        held.clear()
        order, new, shared = _shared(e)
        e = {f: v[order] for f, v in e.items()}
        # Of a prefix that is shared here, two documents go on as its mark.
        begin = np.flatnonzero(new)
        ends = np.r_[begin[1:], len(new)] - 1
        marks = np.r_[begin[shared[begin]], ends[shared[ends]]]
        at = np.r_[np.arange(len(new)), marks]
        kind = np.r_[np.where(shared, SHARED, ALONE), np.full(len(marks), MARK)]
        lot = (np.where(kind == SHARED, mix(e["key"][at].view(np.uint64)), mix(e["prefix"][at])) % np.uint64(lots)).astype(np.int64)
        by = np.lexsort((kind, lot))
        at, kind, lot = at[by], kind[by], lot[by]
        edges = np.flatnonzero(np.r_[True, (lot[1:] != lot[:-1]) | (kind[1:] != kind[:-1]), True])
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        packed = [pa.array([e[f][at[a:b]].tobytes() if kind[a] != MARK or f in ("prefix", "doc") else b"" for a, b in spans], pa.binary()) for f, _ in _FIELDS]
        return pa.RecordBatch.from_arrays([pa.array(lot[edges[:-1]]), pa.array(kind[edges[:-1]].astype(np.int32)), *packed], _names(_PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in cut(batch, "text"):
                e = sampled(Words(part.column("text")), window, anchor)
                if e is None:
                    continue
                text = e.pop("text")
                held.append(e | {f: np.asarray(part.column(f))[text] for f in ("doc", "key")})
                n += len(text)
                if n >= GATHER:
                    yield send(held)
                    n = 0
        if held:
            yield send(held)
        tidy()

    return run


def _open(table: pa.Table) -> pa.Table:
    """From a lot of prefixes: the suffixes of those with several documents."""
    kinds = np.asarray(table.column("kind"))
    parts = {k: table.filter(pa.array(kinds == k)) for k in (SHARED, ALONE, MARK)}
    got = {k: {f: np.frombuffer(b"".join(p.column(f).to_pylist()), t) for f, t in _FIELDS} for k, p in parts.items()}
    out, own, mark = [got[SHARED]], got[ALONE], got[MARK]
    if n := len(own["prefix"]):
        both = {f: np.r_[own[f], mark[f]] for f in ("prefix", "doc")}
        order, _, shared = _shared(both)
        found = order[shared]
        found = found[found < n]
        out.append({f: own[f][found] for f, _ in _FIELDS})
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
    result = pa.table({f: pa.array(np.concatenate([x[f] for x in out]).view(t)) for (f, _), t in zip(_FIELDS, kinds, strict=True)})
    del table, parts, got, out
    tidy()
    return result


def _contexts(window: int, reach: int):
    """Suffixes with their words, and what is removed already (a null prefix): equal ones of one task with a larger doc."""

    def send(held: list[tuple]) -> pa.RecordBatch:
        least: dict[tuple, int] = {}
        for prefix, doc, _, _, _, far, context in held:
            was = least.setdefault((context, far), doc)
            if doc < was:
                least[context, far] = doc
        rows = []
        for prefix, doc, key, first, near, far, context in held:
            gone = doc > least[context, far]
            rows.append((None if gone else prefix, doc, key, first, 0, reach, near, far, None if gone else context))
        held.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _names(_SUFFIX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in cut(batch, "text"):
                columns = (part.column("doc").to_pylist(), part.column("key").to_pylist(), pc.cast(part.column("text"), pa.binary()).to_pylist(), part.column("open").to_pylist())
                for doc, key, text, own in zip(*columns, strict=True):
                    words = text.split() if own else ()  # bytes split at \x20 and \x09-\x0D
                    for s in own or ():
                        first, last, left = s["first"], s["last"], s["left"]
                        held.append((s["prefix"], doc, key, first, left - (last - first), left, b" ".join(words[first : last + window])))
                        if len(held) >= GATHER_WORDS:
                            yield send(held)
        if held:
            yield send(held)
        tidy()

    return run


def _longer(window: int):
    """Suffixes of large groups under longer prefixes: their windows in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary())
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words, middle = r["context"].split(b" "), (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    near, far = max(r["near"], low), min(r["far"], high)
                    if near <= far:
                        at = r["far"]  # the anchor's place in the context
                        prefix = xxhash.xxh3_64_intdigest(b" ".join(words[at - low : at + window - high])) - (1 << 63)
                        rows.append((prefix, r["doc"], r["key"], r["first"] + at - far, low, high, near, far, b" ".join(words[at - far : at + window - near])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _names(_SUFFIX))

    return run


def _sorted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, longest common prefix with the row before) of rows of word codes."""
    rows = np.ascontiguousarray(codes.astype(">i4"))
    order = np.argsort(rows.view(f"V{4 * rows.shape[1]}").ravel(), kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    return order, np.r_[-1, np.where(same.all(1), codes.shape[1], same.argmin(1))] if len(order) else np.zeros(0, np.int64)


def _nodes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """The number of the node of each row at some depth of the tree."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def repeated_windows(contexts: pa.Array, near: np.ndarray, far: np.ndarray, doc: np.ndarray, window: int, reach: int) -> np.ndarray:
    """By suffix (by rising doc) and distance from the window's start to the anchor: whether a smaller document has the window."""
    lists = pc.ascii_split_whitespace(contexts.cast(pa.string()))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    counts = np.diff(offsets)
    codes = np.asarray(lists.values.slice(int(offsets[0]), int(counts.sum())).dictionary_encode().indices).astype(np.int32)
    n = len(counts)
    words = np.zeros((n, reach + window), np.int32)
    row = np.repeat(np.arange(n), counts)
    words[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], counts) + np.repeat(reach - far, counts)] = codes + 1
    out = np.zeros((n, reach + 1), bool)
    order, lcp = _sorted(words[:, reach:])
    # Only nodes that are deep enough for some window, with another suffix below them.
    deep = np.maximum(lcp, np.r_[lcp[1:], -1]) >= window - far[order]
    kept = np.sort(order[deep])
    if len(kept) < 2:
        return out
    words, near, far, doc = words[kept], near[kept], far[kept], doc[kept]
    right, left = _sorted(words[:, reach:]), _sorted(words[:, :reach][:, ::-1])
    for j in range(reach + 1):
        on = np.flatnonzero((near <= j) & (j <= far))
        if len(on) > 1:
            node = _nodes(*right, window - j)[on] * (len(kept) + 1) + _nodes(*left, j)[on]
            _, at, of = np.unique(node, return_index=True, return_inverse=True)  # rows rise by doc: the first is the least
            out[kept[on], j] = doc[on] > doc[on][at][of]
    return out


def _subtrees(window: int, reach: int):
    """From a lot of prefixes: the ranges of windows that repeat a smaller document's."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending")])
        doc, key, first, near, far = (np.asarray(table.column(c)) for c in ("doc", "key", "first", "near", "far"))
        prefix, low = np.asarray(table.column("prefix")), np.asarray(table.column("low"))
        found = repeated_windows(table.column("context").combine_chunks(), near, far, doc, window, reach)
        edge = np.zeros((len(doc), 1), np.int8)
        steps = np.diff(np.hstack([edge, found.astype(np.int8), edge]), axis=1)
        rows, a = np.nonzero(steps == 1)
        b = np.nonzero(steps == -1)[1] - 1
        anchor = (first + far)[rows]
        result = pa.table({"doc": pa.array(doc[rows]), "key": pa.array(key[rows]), "first": pa.array((anchor - b).astype(np.int32)), "last": pa.array((anchor - a).astype(np.int32))})
        del table, found, steps, prefix, low
        tidy()
        return result

    return run


def _spans(table: DataFrame, name: str, *fields: str) -> DataFrame:
    """What belongs to a document in one row; there is no more than a few entries a word of it."""
    return table.groupBy("doc", "key").agg(F.collect_list(F.struct(*fields)).alias(name))


def _settled(suffixes: DataFrame, window: int, reach: int, lot: int, budget: int) -> list[DataFrame]:
    """The ranges of repeats of suffixes with their words. Each round lengthens the prefixes of groups over the budget."""
    out, level = [], suffixes
    while True:
        sizes = written(level.groupBy("prefix", "low", "high").agg(F.count(F.lit(1)).alias("m")), "prefixes")
        total, most = sizes.agg(F.sum("m"), F.max("m")).head()
        if not total:
            return out
        lots = max(1, -(-total // lot))
        group = ["prefix", "low", "high"]
        large = sizes.where(F.col("m") > budget).select(*group)
        small = level.join(large, group, "left_anti") if most > budget else level
        dealt = small.withColumn("lot", F.pmod(F.xxhash64(*group), F.lit(lots))).groupBy("lot")
        out.append(dealt.applyInArrow(_subtrees(window, reach), _RANGES))
        if most <= budget:
            return out
        split = level.join(large, group, "left_semi")
        # A group of one window: its words are all that is left to compare, and map-side aggregation does.
        one = split.where("low = high").select("doc", "key", "first", F.col("first").alias("last"), "context")
        deep = written(one.groupBy("context").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("context", "least"), "deep")
        out.append(one.join(deep, "context").where("doc > least").select("doc", "key", "first", "last"))
        level = written(split.where("low < high").select(*_names(_SUFFIX)).mapInArrow(_longer(window), _SUFFIX), "longer")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, lot: int = LOT, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(rows with doc and key, the ranges of window starts to be removed: doc, key, first, last)."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has from one word to as many as a window")
    rows, reach = _rows(docs), window - anchor
    chars = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    lots = max(1, int(chars / 6 * 2 / (reach + 2)) // (2 * lot))
    packed = rows.select("doc", "key", "text").mapInArrow(_census(lots, window, anchor), _PACKED)
    found = written(packed.groupBy("lot").applyInArrow(_open, _OPEN), "open")
    spans = written(_spans(found, "open", "prefix", "first", "last", "left"), "spans")
    touched = KeyFilter(spans, "key").inside(rows).select("doc", "key", "text").join(spans, ["doc", "key"])
    suffixes = written(touched.select("doc", "key", "text", "open").mapInArrow(_contexts(window, reach), _SUFFIX), "suffixes")
    gone = suffixes.where("prefix is null").select("doc", "key", "first", (F.col("first") + F.col("far") - F.col("near")).alias("last"))
    for part in _settled(suffixes.where("prefix is not null"), window, reach, lot, budget):
        gone = gone.unionAll(part)
    return rows, written(gone, "removed")


def _covered(n: int, ranges: list, window: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        steps[r["first"]] += 1
        steps[r["last"] + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def _cleaned(window: int, text_too: bool, known: KeyFilter | None = None):
    """Texts without what their ``ranges`` cover; with ``known``, all of those texts that have no ranges for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~known.hit(batch.column("places")))) if known else batch
            for part in cut(batch, "text"):
                ranges = part.column("ranges").to_pylist() if "ranges" in part.schema.names else [None] * part.num_rows
                rows = []
                for text, own in zip(pc.cast(plain(part.column("text")), pa.binary()).to_pylist(), ranges, strict=True):
                    words = text.split()  # bytes split at \x20 and \x09-\x0D
                    n = len(words)
                    if own:
                        gone = _covered(n, own, window).tolist()
                        words = [w for w, x in zip(words, gone, strict=True) if not x]
                    kept = b" ".join(words)
                    rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if text_too else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        tidy()

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text_too: bool = False, lot: int = LOT, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``text_too`` the kept text. Only texts that may lose words are shuffled."""
    rows, removed = repeats(docs, window, anchor, lot, budget)
    spans = written(_spans(removed, "ranges", "first", "last"), "ranges")
    known = KeyFilter(spans, "key")
    ddl, run = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", _cleaned(window, text_too)
    touched = known.inside(rows).join(spans, ["doc", "key"], "left").select("doc_id", "text", "ranges").mapInArrow(run, ddl)
    out = touched.unionAll(rows.select("doc_id", "text", known.places().alias("places")).mapInArrow(_cleaned(window, text_too, known), ddl))
    return out if text_too else out.drop("kept")


def maximal_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start and length (in words) of each joined stretch that repeats a smaller document's text."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                end = max(r["last"] for r in ranges) + window
                on = np.diff(np.r_[0, _covered(end, ranges, window).astype(np.int8), 0])
                out += [(doc_id, int(a), int(b - a)) for a, b in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["doc_id", "start", "length"])

    rows, removed = repeats(docs, window, anchor)
    return rows.select("doc_id", "doc", "key").join(_spans(removed, "ranges", "first", "last"), ["doc", "key"]).select("doc_id", "ranges").mapInArrow(join, "doc_id long, start long, length long")
