"""Best-fit packing with certified repacking.

Documents become token ids (and id 0 at the end); those longer than a sequence
are cut into pieces. Pieces are dealt into groups, and each group is packed by
best-fit decreasing. Dual-feasible functions give each group a lower bound on its
sequences: a group that meets it is certified and closed but for its least filled
sequence. That one, and all unfilled sequences of the groups with a gap, are exchanged:
their pieces are dealt anew, over fewer and larger groups, and packed again. This ends
when all sequences together meet the bound over all pieces, or when one group (or groups
of MERGED pieces) saved nothing. If the bound over all pieces isn't met by then, the
closed groups are opened once more and take part as well.

With weights, groups are stretches of the mixture (see ``mixing``): each document's
position is worked out from its source, doc_id and text, so no order of rows or files
matters. A sequence's id rises with the position of its first piece. Groups then stay as small
as they are, so that pieces stay near their place; only what is exchanged travels.

Defined cases: null or empty text is one piece of one id; a text of any length is cut, never shortened; pieces
of equal length go by their row's number; repeated
rows are packed each for itself; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing
from .common import CACHE_WORDS, Words, cut, tidy, written

SIZE, GROUP = 2048, 1024
#: Pieces in one group at most, however far groups are merged: some 20 MB in a task.
MERGED = 1 << 18
#: Bytes of text for one step; larger ones meet fewer words twice.
ENCODE_BYTES = 8 << 20
#: What the vocabulary's split pattern finds in lower-case Latin-1, and the ends of words.
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+|\n")
#: Words that the tokenizer takes whole: other characters, and what may be a special token.
ODD = "[^!-~¡-¬®-ÿ]|<[|]"
#: Stands between words; no id is as high.
BREAK = b"\xff\xff\xff\xff"
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
_MIXED = _PIECE + ", document long, source string, key long"
_PLACED = _PIECE + ", position long"
_MORE = ", group long, sequence long, offset long, free int, moves boolean"
#: Pieces that a document has at most are 2 ** PIECES.
PIECES = 22

_encoders: dict[str, tuple] = {}


def _encoder(path: str) -> tuple:
    """The tokenizer of a file and what it gave for words so far, once in each worker."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        is_end = np.zeros(tokenizer.get_vocab_size(), bool)
        for word, k in tokenizer.get_vocab(with_added_tokens=False).items():
            is_end[k] = word.endswith("</w>")
        _encoders[path] = (tokenizer, {"\n": BREAK}, is_end)
    return _encoders[path]


def encode(texts: pa.Array, path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text, without special tokens.

    This vocabulary's pre-tokenizer never joins across white space and its
    normaliser works character by character, so a text's ids are its words' ids
    in a row, and a word's those of its pre-tokens; each different one is encoded
    once. Words are split here where they are printable Latin-1, which is its own
    normal form but for case; the tokenizer takes others whole.
    """
    tokenizer, known, is_end = _encoder(path)
    words = Words(texts)
    unique = words.uniques
    odd = np.asarray(pc.match_substring_regex(unique, ODD)) if len(unique) else np.zeros(0, bool)
    others = unique.filter(pa.array(odd)).to_pylist()
    simple = unique.filter(pa.array(~odd)) if others else unique
    line = pc.binary_join(pa.ListArray.from_arrays([0, len(simple)], simple), "\n").to_pylist()[0].lower() if len(simple) else ""
    known.setdefault("\n", BREAK)
    flat = PRETOKEN.findall(line)
    fresh = [p for p in set(flat) if p not in known]
    if len(known) + len(fresh) + len(others) > CACHE_WORDS:
        known.clear()
        known["\n"] = BREAK
        fresh = [p for p in set(flat) if p != "\n"]
    # Many pre-tokens in one call: the last id of each, and no other, is one of a word's end.
    for k in range(0, len(fresh), 4096):
        some = fresh[k : k + 4096]
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        ends, raw = (4 * np.flatnonzero(is_end[ids]) + 4).tolist(), ids.tobytes()
        known.update(zip(some, [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
    blobs = np.empty(len(unique), object)
    if len(simple):
        blobs[~odd] = b"".join([known[p] for p in flat]).split(BREAK)
    if others:
        fresh = [w for w in others if f"\n{w}" not in known]
        for w, got in zip(fresh, tokenizer.encode_batch_fast(fresh, add_special_tokens=False) if fresh else (), strict=True):
            known[f"\n{w}"] = np.asarray(got.ids, "<u4").tobytes()
        blobs[odd] = [known[f"\n{w}"] for w in others]
    ends = words.offsets.tolist()
    inside = blobs[words.codes].tolist()
    return [b"".join(inside[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, mixed: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32; ``row`` tells repeated rows apart. For the mixture also document (the row of its first piece), source and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in cut(batch, "text", ENCODE_BYTES):
                out: list[list] = [[] for _ in range(6)]
                owner, document = [], []
                for i, (doc_id, ids) in enumerate(zip(part.column("doc_id").to_pylist(), encode(part.column("text"), tokenizer), strict=True)):
                    ids += b"\0\0\0\0"
                    count = -(-len(ids) // (4 * size))
                    owner += [i] * count
                    document += [row] * count
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        for to, value in zip(out, (doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), row), strict=True):
                            to.append(value)
                        row += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                arrays, names = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
                if mixed:
                    at = pa.array(owner, pa.int64())
                    arrays += [pa.array(document, pa.int64()), part.column("source").take(at), part.column("key").take(at)]
                    names += ["document", "source", "key"]
                yield pa.RecordBatch.from_arrays(arrays, names)
        _encoder(tokenizer)[1].clear()
        tidy()

    more = [F.col("source").cast("string").alias("source"), mixing.rank_key().alias("key")] if mixed else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(run, _MIXED if mixed else _PIECE)


def placed(rows: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """Pieces with their document's position in the mixture."""
    rows = written(rows, "unplaced")
    first = rows.where("piece = 0").select("doc_id", "source", "key", "document")
    places = mixing.schedule(first, weights, keep=True, key="key").select("row.document", "position")
    return rows.join(places, "document").select(*[f.split()[0] for f in _PLACED.split(", ")])


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's free room, for lengths in falling order: each goes to the fullest bin that holds it."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, free = 0, []  # a bit for each room that some bin has
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            k, room = len(free), size
            free.append(size)
        bins[i], offsets[i] = k, size - room
        free[k] = room - n
        if free[k]:
            open_bins[free[k]].append(k)
            rooms |= 1 << free[k]
    return bins, offsets, np.asarray(free, np.int64)[bins] if len(bins) else np.zeros(0, np.int64)


def lower_bound(lengths: np.ndarray | list[tuple[int, int]], size: int = SIZE) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions, in whole numbers. Lengths may come as (length, how many)."""
    if not len(lengths):
        return 0
    if isinstance(lengths, list):
        n = np.zeros(size + 1, np.int64)
        for length, many in lengths:
            n[length] += many
    else:
        n = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    count, total = np.cumsum(n), np.cumsum(n * x)
    best = -(-int(total[-1]) // size)
    # Lengths over size - t count whole, those below t not at all.
    t = np.arange(1, size // 2 + 1)
    best = max(best, int((-(-(size * (count[-1] - count[size - t]) + total[size - t] - total[t - 1]) // size)).max()))
    # x -> floor((k + 1) x) / k, but x itself where (k + 1) x is whole.
    for k in range(1, 41):
        scaled = np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size)
        best = max(best, -(-int((n * scaled).sum()) // (k * size)))
    return best


def _pack(size: int, ordered: bool):
    """A group by best-fit decreasing; ``moves`` are the pieces that are exchanged."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select([f.split()[0] for f in (_PLACED if ordered else _PIECE).split(", ")] + ["group"])
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), -lengths))
        bins, offsets, free = best_fit(lengths[order], size)
        gap = int(bins.max()) + 1 - lower_bound(lengths, size)
        moves = (free > 0) & ((gap > 0) | (bins == bins[np.argmax(free)]))
        table = table.take(pa.array(order))
        if ordered:  # a document has one piece here at most, so ids are unique
            first = np.flatnonzero(offsets == 0)
            ids = np.zeros(len(first), np.int64)
            ids[bins[first]] = (table.column("position").to_numpy()[first] << PIECES) + table.column("piece").to_numpy()[first]
            bins = ids[bins]
        for name, values in (("sequence", bins), ("offset", offsets), ("free", free.astype(np.int32)), ("moves", moves)):
            table = table.append_column(name, pa.array(values))
        return table

    return run


def certificate(packed: DataFrame, size: int = SIZE) -> tuple[int, int]:
    """(sequences, a lower bound on them) of packed pieces; where they are equal no packing has fewer."""
    counts = [(r[0], r[1]) for r in packed.groupBy("length").count().collect()]  # at most ``size`` rows
    return packed.where("offset = 0").count(), lower_bound(counts, size)


def pack(rows: DataFrame, size: int = SIZE, group: int = GROUP, merged: int = MERGED) -> DataFrame:
    """Add sequence_id and offset to pieces (see ``pieces``) of at most ``size``; those with a position (see ``placed``) are packed by stretches of it, and ids follow it."""
    ordered = "position" in rows.columns
    rows = written(rows, "pieces")
    own = F.shiftleft("position", PIECES) + F.col("piece") if ordered else -1 - F.col("row")
    names = [f.split()[0] for f in (_PLACED if ordered else _PIECE).split(", ")]
    schema = (_PLACED if ordered else _PIECE) + _MORE
    end = (rows.agg(F.max("position")).head()[0] or 0) + 1 if ordered else 0  # one number
    full = rows.where(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``size`` rows
    counts.pop(size, None)
    bound, n = lower_bound(list(counts.items()), size), sum(counts.values())
    out: list[DataFrame] = []  # closed groups: all but what moves on
    merged = group if ordered else merged
    left, before, was, sure, opened, k, numbered = rows.where(F.col("length") < size), None, 0, 0, False, 0, 0
    while n:
        per = merged if opened else min(merged, group << 3 * k)
        groups = -(-n // per)
        span = -(-end // groups)
        dealt = left.withColumn("group", F.expr(f"position div {span}") if ordered else F.pmod(F.xxhash64("row", F.lit(k)), F.lit(groups)))
        packed = written(dealt.groupBy("group").applyInArrow(_pack(size, ordered), schema), "packed")
        number = F.col("sequence") if ordered else (F.col("group") + F.lit(numbered)) * F.lit(1 << 20) + F.col("sequence")
        ready = packed.select(*names, number.alias("sequence_id"), "offset", "free", "moves")
        now, moved, pieces_moved = ready.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("moves")), F.count_if("moves")).head()
        saved = before is None or now < was
        if not saved:  # the packing before it stays
            ready, now = before, was
        k, numbered = k + 1, numbered + groups
        if saved and sure + now > bound and groups > 1:
            out.append(ready.where("not moves"))
            sure, before, was, n = sure + now - moved, ready.where("moves"), moved, pieces_moved
        elif sure + now > bound and groups > 1 and per < merged:
            before, was = ready, now  # as they are, into larger groups
        elif sure + now > bound and out and not opened and not ordered:
            opened, before = True, ready
            for part in out:
                before = before.unionAll(part)
            was, n, sure, out = sure + now, sum(counts.values()), 0, []
        else:
            out.append(ready)
            break
        left = before.select(*names)
    for part in out:
        full = full.unionAll(part.select(*full.columns))
    return full


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, group: int = GROUP, merged: int = MERGED, weights: Mapping[str, int] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. With weights by source (see ``mixing``) sequences follow the mixture, by sequence_id."""
    rows = pieces(docs, tokenizer, size, bool(weights))
    return pack(placed(rows, weights) if weights else rows, size, group, merged)
