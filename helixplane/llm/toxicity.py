"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over hashed word features;
each later model also gets the earlier categories' probabilities. For training, these are out-of-fold:
each row's come from models that were fitted without its fold, so later models learn from predictions
such as they will see. At prediction the chain's full models are applied in order.

Features of a text are its distinct words in lower case, and their first 4, 5 and 6 bytes, hashed
into 2 ** BITS; each counts once however long the text. Models are fitted on the driver on a bounded
sample of labelled documents: those of least hash of doc_id, MAX_ROWS at most, and no more than have
MAX_CELLS features together, each with all of its features. The fixed-size weights are broadcast;
everything is scored, by all of its features.

Null or empty text has no features and gets the models' intercepts. Labels that are null, or rows
without a text row, don't train. Of labels of one doc_id the greatest holds (toxic, if one says so), of
its texts the least. Where a category has rows of one label only, its model is a constant;
without any, nothing is of the category. Repeated rows are scored each; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_KEYS, WHITE, discard, id_and_text, materialise, prefix_hash, real_id, span_hash, texts_of

BITS, HEADS = 18, (4, 5, 6)
MAX_ROWS, MAX_CELLS, FOLDS, EPOCHS = 8_000, 1 << 25, 5, 12
AT_ONCE = 1 << 20
#: The log-odds against a category that no row trains.
NEVER = 8.0
#: Least chi-square statistic, and rows, of a feature that gets a weight; how far classes are balanced, from 0 to 1.
CHI, MIN_ROWS, BALANCE = 30.0, 4, 0.7
#: Bytes that part words: white space and ASCII punctuation; A-Z are lowered.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
PARTS = WHITE.copy()
PARTS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def features(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts, of those wanted if given, and the n + 1 offsets."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    data = FOLD[data]
    gap = PARTS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1] | edge[1:-1]
    ends = ends.copy()
    ends[:-1] &= gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = prefix_hash(BYTE_KEYS[data])
    doc = np.searchsorted(off, start, "right") - 1
    found = [span_hash(h, start, end)]
    for k in HEADS:
        found.append(span_hash(h, start, np.minimum(start + k, end)) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    slot = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    doc = np.tile(doc, len(found))
    if wanted is not None:
        some = wanted[slot]
        doc, slot = doc[some], slot[some]
    key = np.unique((doc << BITS) | slot)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n + 1))


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


class Linear:
    """Logistic regression over sparse sets of features and a few dense columns, by AdaGrad."""

    def __init__(self, dense: int):
        self.w, self.v, self.b = np.zeros(1 << BITS), np.zeros(dense), 0.0

    def logits(self, slots: np.ndarray, off: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.w[slots])))
        return sums[off[1:]] - sums[off[:-1]] + dense @ self.v + self.b

    def fit(self, slots: np.ndarray, off: np.ndarray, dense: np.ndarray, y: np.ndarray, rows: np.ndarray) -> Linear:
        if not len(rows):
            self.b = -NEVER
            return self
        good = y[rows].sum()
        self.b = float(np.log((good + 0.5) / (len(rows) - good + 0.5)))
        if not 0 < good < len(rows):
            return self
        # only features that go with the label beyond chance have a weight
        a, both = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for some in np.array_split(rows, max(1, len(rows) // 500)):
            n = off[some + 1] - off[some]
            at = slots[np.repeat(off[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            a += np.bincount(at, np.repeat(y[some], n), minlength=1 << BITS)
            both += np.bincount(at, minlength=1 << BITS)
        b = both - a
        c, d = good - a, len(rows) - good - b
        chi = (a * d - b * c) ** 2 * len(rows) / np.maximum((a + b) * (c + d) * good * (len(rows) - good), 1e-9)
        use = (chi >= CHI) & (a + b >= MIN_ROWS)
        kept = use[slots]
        place = np.cumsum(use) - 1
        slots, off = place[slots[kept]].astype(np.int32), np.concatenate(([0], np.cumsum(kept)))[off]
        w = np.zeros(int(use.sum()))
        square, square_v, square_b = np.full(len(w), 1e-3), np.full(dense.shape[1], 1.0), 1.0
        rng = np.random.default_rng(7)
        balance = np.where(y == 1, len(rows) / (2 * good), len(rows) / (2 * (len(rows) - good))) ** BALANCE
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
                n = off[batch + 1] - off[batch]
                at = slots[np.repeat(off[batch] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                sums = np.concatenate(([0.0], np.cumsum(w[at])))[np.concatenate(([0], np.cumsum(n)))]
                z = np.diff(sums) + dense[batch] @ self.v + self.b
                g = (probability(z) - y[batch]) * balance[batch] / len(batch)
                grad = np.bincount(at, np.repeat(g, n), minlength=len(w))
                square += grad**2
                w -= 0.1 * grad / np.sqrt(square)
                grad = dense[batch].T @ g
                square_v += grad**2
                self.v -= 0.1 * grad / np.sqrt(square_v)
                square_b += g.sum() ** 2
                self.b -= 0.1 * g.sum() / np.sqrt(square_b)
        self.w[use] = w
        return self


def fit_chain(slots: np.ndarray, off: np.ndarray, labels: np.ndarray) -> list[Linear]:
    """One model for each column of labels; a later one is fitted with out-of-fold probabilities of the earlier."""
    n, m = labels.shape
    fold, rows = np.arange(n) % FOLDS, np.arange(n)
    earlier, chain = np.zeros((n, 0)), []
    for k in range(m):
        y = labels[:, k]
        chain.append(Linear(k).fit(slots, off, earlier, y, rows))
        if k + 1 < m:
            out = np.zeros(n)
            for f in range(FOLDS):
                model = Linear(k).fit(slots, off, earlier, y, rows[fold != f])
                out[fold == f] = model.logits(slots, off, earlier)[fold == f]
            earlier = np.column_stack((earlier, probability(out)))
    return chain


def predict(chain: list[Linear], slots: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probabilities, a column for each category."""
    earlier = np.zeros((len(off) - 1, 0))
    out = []
    for model in chain:
        z = model.logits(slots, off, earlier)
        out.append(probability(z))
        earlier = np.column_stack((earlier, out[-1]))
    return np.column_stack(out)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS) -> list[Linear]:
    """A chain over the categories (0/1 columns made of labels), in their order, from max_rows labelled documents at most."""
    names = [f"y{k}" for k in range(len(categories))]
    wanted = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in zip(names, categories.values(), strict=True)]).dropna()
    wanted = wanted.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    sample = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                rows = b.slice(k, 200)
                slots, off = features(*texts_of(rows.column("text")))
                some = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(slots, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[rows.column(n) for n in names], some], ["doc_id", *names, "slots"])

    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text")).select("doc_id", "text", *names)
    found = materialise(rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{n} int" for n in names], "slots array<int>"])), "training")
    sizes = found.select("doc_id", F.size("slots").alias("n"), F.xxhash64("doc_id").alias("hash"))  # max_rows rows at most
    fits = sizes.withColumn("up", F.sum("n").over(Window.orderBy("hash", "doc_id"))).filter(F.col("up") <= MAX_CELLS).select("doc_id")
    got = found.join(F.broadcast(fits), "doc_id").toArrow().sort_by("doc_id")
    discard(found)
    lists = got.column("slots").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    off = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy().astype(np.int64))))) if got.num_rows else np.zeros(1, np.int64)
    y = np.column_stack([got.column(n).to_numpy() for n in names]).astype(np.float64) if got.num_rows else np.zeros((0, len(names)))
    return fit_chain(lists.flatten().to_numpy(), off, y)


def score(docs: DataFrame, chain: list[Linear], categories: list[str], *more: str) -> DataFrame:
    """doc_id, text and the named other columns, with p_<category> for each."""
    sent = docs.sparkSession.sparkContext.broadcast([(m.w.astype(np.float32), m.v, m.b) for m in chain])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for w, v, b in sent.value:
            own.append(Linear(0))
            own[-1].w, own[-1].v, own[-1].b = w.astype(np.float64), v, b
        wanted = np.any([m.w != 0 for m in own], axis=0)
        for b in batches:
            n = np.diff(texts_of(b.column("text"))[1])
            start = 0
            while start < b.num_rows:
                stop = max(start + 1, start + int(np.searchsorted(np.cumsum(n[start:]), AT_ONCE, "right")))
                rows = b.slice(start, stop - start)
                p = predict(own, *features(*texts_of(rows.column("text")), wanted))
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(x) for x in p.T]], [*rows.schema.names, *[f"p_{c}" for c in categories]])
                start = stop

    rows = id_and_text(docs, *more)
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField(f"p_{c}", T.DoubleType()) for c in categories])
    out = rows.mapInArrow(run, kinds)
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


#: A text is toxic from this probability on.
THRESHOLD = 0.5
NAMES = ["junk", "toxic"]


def categories() -> dict[str, Column]:
    """What the labels tell apart, in the order of the chain: junk, which the toxicity model then may leave aside, and toxic texts."""
    return {"junk": (F.col("quality") == 0).cast("int"), "toxic": F.col("toxic")}


def judge(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """score() of a chain trained on the labelled documents, and whether each is toxic."""
    chain = train(docs, labels, categories())
    return score(docs, chain, NAMES, *more).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
