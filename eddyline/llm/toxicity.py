"""Toxicity: a bidirectional gated recurrent network with attention over windows of words, in NumPy.

A word enters by an embedding of its hash and by the largest of the embeddings of its hashed character pieces, so forms
of a known word, and words of a known stem, are met too. Windows of WINDOW words, one every STEP, cover each text whole; each is read
in both directions, attention pools the states, and a text's score is a logistic function of its windows' largest and mean logit and
of how many speak up. Weights are learned on the driver from a bounded sample of labelled texts (TRAIN_ROWS rows and TRAIN_BYTES of text): a text's label
is taught to its most suspicious window (multiple-instance learning); a fold that the network never saw fits the logistic
function. Every text is then scored by one task, nothing is shuffled, and only weights are broadcast (about 1 MB).

Defined cases: a null text is empty; a text without words gets the share of toxic texts among those learned from; without a toxic and a
clean one among them nothing can be learned, and that share (0 without any) is every score. Rows told by a null doc_id count as held out.
A doc_id labelled more than once is toxic if any label says so; null labels say nothing. Repeated rows are learned from once and get equal scores.
Scores are rounded to six digits; one of 0.5 is predicted toxic. Columns other than those named don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mix, plain, tidy, written

#: Labelled rows and bytes of their texts that are learned from at most; further rows, in order of a hash, and texts that don't fit any more are left out.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 8 << 20
WINDOW, STEP = 48, 24
#: Hash buckets of words, and of pieces; numbers in an embedding, in a state, and in the attention's hidden layer; bytes of a piece, marks at a word's ends included.
BUCKETS, SIZE, HIDDEN, GLANCE, PIECES = 1 << 16, 8, 8, 8, (3, 6)
EPOCHS, BATCH, RATE = 10, 256, 0.01
#: A gate is a line of this slope, cut to 0..1; a new state is x / (1 + |x|): both cost a tenth of an exponential.
SLOPE = 0.25
#: Texts of either kind that are added to what is counted of a bucket.
PRIOR = 6
#: A bucket that fewer texts have is left out.
MET = 4
#: Labels are learned from where crc32(doc_id) modulo FOLDS isn't 0; texts where it is the last one fit the logistic function.
FOLDS = 5
#: Windows that are read at a time, and words whose inputs are worked out at a time.
AT_ONCE, INPUTS = 1_024, 32_768
#: Marks that are no part of a word.
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_~`+="


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


class Inputs:
    """Some words as buckets: one each for the word, several for its pieces."""

    def __init__(self, words: pa.Array):
        bare = pc.utf8_trim(pc.utf8_lower(words), MARKS)
        marked = pc.cast(pc.binary_join_element_wise("\x02", bare, "\x03", ""), pa.large_binary())
        start = np.frombuffer(marked.buffers()[1], np.int64, len(marked) + 1, marked.offset * 8)
        data = np.frombuffer(marked.buffers()[2], np.uint8, int(start[-1]))[int(start[0]) :].astype(np.uint64)
        start = start - start[0]
        n = np.diff(start)
        power = np.cumprod(np.full(int(n.max(initial=8)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        at = np.arange(len(data)) - np.repeat(start[:-1], n)
        self.start = start[:-1]
        bucket = lambda h: (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int32)
        self.word = bucket(np.add.reduceat(data * power[at], self.start)) if len(n) else np.zeros(0, np.int32)
        left = np.repeat(n, n) - at
        self.piece = []  # of each byte the bucket of the piece that begins there; BUCKETS for none
        for size in PIECES:
            h = np.zeros(len(data), np.uint64)
            for j in range(size):
                h[: len(data) - j] += data[j:] * power[j]
            self.piece.append(np.where(left >= size, bucket(h + np.uint64(size)), BUCKETS).astype(np.int32))


class Network:
    """Weights as arrays by name; float32 throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        width = SIZE * (1 + len(PIECES))
        self.p = {"word": draw(BUCKETS, SIZE, scale=0.05), "glance": draw(2 * HIDDEN, GLANCE), "glance_b": np.zeros(GLANCE, np.float32), "look": draw(GLANCE), "out": draw(2 * HIDDEN), "out_b": np.full(1, -1, np.float32)}
        for k in range(len(PIECES)):
            self.p[f"piece{k}"] = draw(BUCKETS + 1, SIZE, scale=0.05)
        for way in "fb":
            self.p |= {f"in_{way}": draw(width, 3 * HIDDEN), f"in_b_{way}": np.zeros(3 * HIDDEN, np.float32), f"state_{way}": draw(HIDDEN, 3 * HIDDEN)}

    def vectors(self, words: Inputs) -> np.ndarray:
        """A row of numbers for each word: its own, and for each size of piece the largest of its pieces'."""
        out = [self.p["word"][words.word]]
        for k, piece in enumerate(words.piece):
            seen = self.p[f"piece{k}"].take(piece, 0)
            out.append(np.maximum.reduceat(seen, words.start) if len(words.start) else np.zeros((0, SIZE), np.float32))
        return np.concatenate(out, 1)

    def tables(self, x: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What each word adds to gates and to new states, in either direction."""
        out = {}
        for way in "fb":
            both = x @ self.p[f"in_{way}"] + self.p[f"in_b_{way}"]
            out[way] = np.ascontiguousarray(both[:, : 2 * HIDDEN]), np.ascontiguousarray(both[:, 2 * HIDDEN :])
        return out

    def read(self, tables: dict[str, tuple[np.ndarray, np.ndarray]], codes: np.ndarray, real: np.ndarray | None, trace: bool = False):
        """States of both ways (T, B, 2H) for words codes (T, B); ``real`` tells words from filling."""
        steps, n = codes.shape
        states, traces = np.empty((steps, n, 2 * HIDDEN), np.float32), {"f": [], "b": []}
        for way, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            h, state = np.zeros((n, HIDDEN), np.float32), self.p[f"state_{way}"]
            to_gates, to_new = np.ascontiguousarray(state[:, : 2 * HIDDEN]), np.ascontiguousarray(state[:, 2 * HIDDEN :])
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                gates = h @ to_gates
                gates += tables[way][0].take(codes[t], 0)
                gates *= SLOPE
                gates += 0.5
                np.clip(gates, 0, 1, gates)
                keep, use = gates[:, :HIDDEN], gates[:, HIDDEN:]
                back = h @ to_new
                new = use * back
                new += tables[way][1].take(codes[t], 0)
                new /= np.abs(new) + 1
                if trace:
                    traces[way].append((t, h, keep, use, new, back))
                now = h - new
                now *= keep
                now += new
                h = now if real is None else np.where(real[t][:, None], now, h)
                states[t, :, side] = h
        return states, traces

    def pooled(self, states: np.ndarray, real: np.ndarray | None):
        """(logits, attention, glances, pooled states) of windows."""
        glance = np.tanh(states @ self.p["glance"] + self.p["glance_b"])
        look = glance @ self.p["look"]
        if real is not None:
            look = np.where(real, look, -1e9)
        weight = np.exp(look - look.max(0))
        weight /= weight.sum(0)
        context = np.einsum("tb,tbh->bh", weight, states)
        return context @ self.p["out"] + self.p["out_b"][0], weight, glance, context

    def logits(self, tables: dict[str, np.ndarray], codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of windows that begin at ``start`` in ``codes`` and have ``size`` words."""
        out = np.empty(len(start), np.float32)
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(start), AT_ONCE):
            own = order[k : k + AT_ONCE]
            longest = int(size[own].max())
            at = start[own] + np.arange(longest)[:, None]
            real = None if size[own].min() == longest else np.arange(longest)[:, None] < size[own]
            seen = codes[at if real is None else np.where(real, at, start[own])]
            out[own] = self.pooled(self.read(tables, seen, real)[0], real)[0]
        return out

    def gradients(self, words: Inputs, codes: np.ndarray, real: np.ndarray, y: np.ndarray, mass: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of windows codes (T, B) over a batch's own words."""
        p, x = self.p, self.vectors(words)
        states, traces = self.read(self.tables(x), codes, real, True)
        logit, weight, glance, context = self.pooled(states, real)
        g = {}
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * mass).astype(np.float32)
        g["out"], g["out_b"] = context.T @ d, np.array([d.sum()], np.float32)
        d_context = d[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_context, states)
        d_look = weight * (d_weight - (weight * d_weight).sum(0))
        d_states = weight[:, :, None] * d_context
        d_glance = d_look[:, :, None] * p["look"] * (1 - glance**2)
        g["look"] = np.einsum("tb,tbk->k", d_look, glance)
        g["glance"], g["glance_b"] = np.einsum("tbh,tbk->hk", states, d_glance), d_glance.sum((0, 1))
        d_states += d_glance @ p["glance"].T
        d_x = np.zeros_like(x)
        flat = codes.ravel()
        order = np.argsort(flat, kind="stable")
        met, first = np.unique(flat[order], return_index=True)
        for way, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            state, d_state = p[f"state_{way}"], np.zeros_like(p[f"state_{way}"])
            d_h, d_in = np.zeros((codes.shape[1], HIDDEN), np.float32), np.zeros((*codes.shape, 3 * HIDDEN), np.float32)
            for t, h, keep, use, new, back in reversed(traces[way]):
                d_all = d_h + d_states[t, :, side]
                d_now = np.where(real[t][:, None], d_all, 0)
                d_new = d_now * (1 - keep) * (1 - np.abs(new)) ** 2
                d_keep = d_now * (h - new) * SLOPE * ((keep > 0) & (keep < 1))
                d_use = d_new * back * SLOPE * ((use > 0) & (use < 1))
                d_in[t] = np.concatenate([d_keep, d_use, d_new], 1)
                d_back = np.concatenate([d_keep, d_use, d_new * use], 1)
                d_state += h.T @ d_back
                d_h = np.where(real[t][:, None], d_now * keep, d_all) + d_back @ state.T
            g[f"state_{way}"], g[f"in_b_{way}"] = d_state, d_in.sum((0, 1))
            table = np.zeros((len(x), 3 * HIDDEN), np.float32)
            table[met] = np.add.reduceat(d_in.reshape(-1, 3 * HIDDEN)[order], first)
            g[f"in_{way}"] = x.T @ table
            d_x += table @ p[f"in_{way}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], words.word, d_x[:, :SIZE])
        for k, piece in enumerate(words.piece):
            own = p[f"piece{k}"].take(piece, 0)
            n = np.diff(np.r_[words.start, len(piece)])
            side = slice((k + 1) * SIZE, (k + 2) * SIZE)
            top = (own == np.repeat(x[:, side], n, 0)) & (piece != BUCKETS)[:, None]
            at, column = np.nonzero(top)
            g[f"piece{k}"] = np.zeros_like(p[f"piece{k}"])
            np.add.at(g[f"piece{k}"], (piece[at], column), np.repeat(d_x[:, side], n, 0)[at, column])
        return g


class Texts:
    """Some texts' words, and where their windows begin."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.codes, self.uniques = words.codes, words.uniques
        n = np.diff(words.offsets)
        count = np.where(n > WINDOW, -(-(n - WINDOW) // STEP) + 1, (n > 0).astype(np.int64))
        self.owner = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        self.size = np.minimum(n, WINDOW)[self.owner]
        self.start = words.offsets[:-1][self.owner] + np.minimum(k * STEP, np.maximum(n - WINDOW, 0)[self.owner])  # the last window ends with the text
        self.first, self.count = np.cumsum(count) - count, count

    def tables(self, network: Network) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        parts = [network.tables(network.vectors(Inputs(self.uniques.slice(k, INPUTS)))) for k in range(0, max(1, len(self.uniques)), INPUTS)]
        return {way: tuple(np.concatenate([x[way][k] for x in parts]) for k in (0, 1)) for way in "fb"}

    def logits(self, network: Network) -> np.ndarray:
        return network.logits(self.tables(network), self.codes, self.start, self.size)

    def measures(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts with words, a row for each: largest and mean logit of its windows, and how many speak up)."""
        full = np.flatnonzero(self.count)
        if not len(full):
            return full, np.zeros((0, 3))
        first, wide = self.first[full], logits.astype(np.float64)
        loud = np.add.reduceat(1 / (1 + np.exp(-np.clip(wide, -30, 30))), first)
        return full, np.stack([np.maximum.reduceat(wide, first), np.add.reduceat(wide, first) / self.count[full], np.log(loud + 0.05)], 1)


def _odds(bucket: np.ndarray, owner: np.ndarray, y: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How much oftener each bucket is met in toxic texts than in clean ones, as a logarithm; a text counts three times at most, and some of either kind are added. And in how many texts it is met."""
    pair = np.sort(owner.astype(np.int64) * buckets + bucket)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    times = np.minimum(np.diff(np.r_[first, len(pair)]), 3)
    pair = pair[first]
    toxic = y[pair // buckets] > 0
    met = [np.bincount(pair[k] % buckets, times[k], buckets) for k in (toxic, ~toxic)]
    rate = met[0].sum() / max(1.0, met[0].sum() + met[1].sum())
    odds = np.log((met[0] + PRIOR * rate) / (met[0] + met[1] + PRIOR) / max(rate, 1e-9)).clip(-3, 3).astype(np.float32)
    return odds, np.bincount(pair % buckets, minlength=buckets)


class Model:
    """What is learned: the network, and how windows' logits become a text's score."""

    def __init__(self, network: Network | None, center: np.ndarray, spread: np.ndarray, weights: np.ndarray, share: float):
        self.network, self.center, self.spread, self.weights, self.share = network, center, spread, weights, share

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if self.network is not None:
            own = Texts(texts)
            full, rows = own.measures(own.logits(self.network))
            logit = np.c_[(rows - self.center) / self.spread, np.ones(len(rows))] @ self.weights
            out[full] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return np.round(out, 6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression with a small penalty on all but the last, by Newton's steps."""
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
    return w


def fit(texts: pa.Array, y: np.ndarray, late: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model from texts with labels 0 and 1; those that are ``late`` only fit the logistic function."""
    share = float(y.mean()) if len(y) else 0.0
    nothing = Model(None, np.zeros(3), np.ones(3), np.zeros(4), share)
    full = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(plain(texts))), 0)) if len(texts) else np.zeros(0, bool)
    late = late if min((late & full & (y == k)).sum() for k in (0, 1)) >= 3 else np.zeros(len(y), bool)
    early = full & ~late
    if min((early & (y == k)).sum() for k in (0, 1)) == 0:
        return nothing
    taught, own = texts.filter(pa.array(early)), y[early]
    t, network, rng = Texts(taught), Network(seed), np.random.default_rng(seed)
    words, owner = Inputs(t.uniques), np.repeat(np.arange(len(own)), np.diff(Words(taught).offsets))
    # A first guess of each bucket's part in the first number of its embedding.
    met = {}
    network.p["word"][:, 0], met["word"] = _odds(words.word[t.codes], owner, own, BUCKETS)
    spell = Words(taught)
    n = np.diff(np.r_[words.start, len(words.piece[0])])
    for k, piece in enumerate(words.piece):
        network.p[f"piece{k}"][:, 0], met[f"piece{k}"] = _odds(*_spread(words.start, n, piece, spell.codes, owner), own, BUCKETS + 1)
    # What few texts have would only tell those texts: such buckets say nothing, as those do that were never met.
    for name, texts_of in met.items():
        network.p[name][texts_of < MET] = 0
    x = network.vectors(words)
    guess = np.maximum(x[:, 0], 0) + sum(np.maximum(x[:, (k + 1) * SIZE], 0) for k in range(len(PIECES)))
    total = np.r_[0, np.cumsum(guess[t.codes].astype(np.float64))]
    suspicion = total[t.start + t.size] - total[t.start]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    mass_of = {1: 0.5 / max(1, (own == 1).sum()), 0: 0.5 / max(1, (own == 0).sum())}
    tick = 0
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 2 == 0:
            suspicion = t.logits(network)
        order = np.lexsort((-suspicion, t.owner))
        top = order[t.first]  # each text has a window
        other = t.first + (rng.random(len(own)) * t.count).astype(np.int64)
        chosen = np.r_[top, other[own == 0]]
        chosen = chosen[rng.permutation(len(chosen))]
        for k in range(0, len(chosen), BATCH):
            w = chosen[k : k + BATCH]
            longest = int(t.size[w].max())
            real = np.arange(longest)[:, None] < t.size[w]
            codes = t.codes[np.where(real, t.start[w] + np.arange(longest)[:, None], t.start[w])]
            used, codes = np.unique(codes, return_inverse=True)
            label = own[t.owner[w]]
            mass = np.where(label == 1, mass_of[1], mass_of[0]) * len(chosen) / len(w)
            g = network.gradients(Inputs(t.uniques.take(pa.array(used))), codes.reshape(real.shape), real, label, mass / 2)
            tick += 1
            for name, grad in g.items():
                if name in met:
                    grad[met[name] < MET] = 0
                a, b = moments[name]
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                network.p[name] -= (RATE * (a / (1 - 0.9**tick)) / (np.sqrt(b / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
    judged = late & full if late.any() else early
    seen = Texts(texts.filter(pa.array(judged)))
    _, rows = seen.measures(seen.logits(network))
    center, spread = rows.mean(0), rows.std(0) + 1e-3
    return Model(network, center, spread, _logistic(np.c_[(rows - center) / spread, np.ones(len(rows))], y[judged]), share)


def _spread(start: np.ndarray, n: np.ndarray, piece: np.ndarray, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the pieces of all words of texts; a word's pieces come once for each text that has it."""
    pair = np.unique(owner.astype(np.int64) * len(n) + codes)
    text, word = pair // len(n), pair % len(n)
    size = n[word]
    at = np.repeat(start[word] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
    own = piece[at]
    return own[own != BUCKETS], np.repeat(text, size)[own != BUCKETS]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, labels, folds) to learn from: TRAIN_ROWS rows and TRAIN_BYTES of text at most."""
    own = labels.select(labels["doc_id"].cast("long").alias("__id"), labels["toxic"].cast("int").alias("__toxic")).where(F.col("__id").isNotNull() & F.col("__toxic").isNotNull())
    own = own.where(fold(F.col("__id")) != 0).groupBy("__id").agg(F.max((F.col("__toxic") > 0).cast("int")).alias("__toxic"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS)
    told = docs.select(docs["doc_id"].cast("long").alias("__id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("__text"))
    met = written(told.join(F.broadcast(own), "__id").withColumn("__key", F.xxhash64("__id", "__text")), "labelled")
    sizes = met.groupBy("__key").agg(F.max(F.octet_length("__text")).alias("n")).orderBy("__key").limit(TRAIN_ROWS).collect()
    keys, left = [], TRAIN_BYTES
    for r in sizes:
        if r["n"] <= left:
            keys.append((r["__key"],))
            left -= r["n"]
    if not keys:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(keys, "__key long"))
    rows = met.join(chosen, "__key").groupBy("__key").agg(F.first("__text").alias("text"), F.max("__toxic").alias("toxic"), F.max(fold(F.col("__id"))).alias("fold"))
    found = rows.orderBy("__key").toArrow()
    return pc.cast(found.column("text").combine_chunks(), pa.string()), np.asarray(found.column("toxic")).astype(np.int64), np.asarray(found.column("fold")).astype(np.int64)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    texts, y, folds = sample(docs, labels)
    return fit(texts, y, folds == FOLDS - 1)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text"):
                score = held.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        tidy()

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"]) == 0).alias("held_out"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
