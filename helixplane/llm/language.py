"""Language by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes that overlap by a filter's width less one, so every run of bytes that a filter can see lies in
one. Bytes are folded to SYMBOLS classes (a-z, each byte beyond ASCII, digits, all else); filters of
WIDTHS symbols, FILTERS of each width, slide over the window; the greatest response of each filter, if above 0,
goes to a softmax over the languages. A text's probabilities are the means over its windows, weighted by their letters.

The network is trained in numpy (Adam, cross-entropy, classes weighted by their number) on the driver, from MAX_ROWS labelled documents at
most, those of least hash of id and text, and PER_TEXT windows of each, evenly spaced from its start to its end:
two bounds that don't depend on the table. Texts are predicted whole, in batches of windows. A filter over a pair of
symbols is one row of a table, so two lookups give a response of width 4; the tables have fixed size and are broadcast.

Nothing but the text goes into a prediction; documents with crc32(doc_id as text) mod 3 = 1 are held out and never
train, nor do rows without text, language or id. Null text, and text without a letter of any script, is `und` with score 0; so is
everything if no row trains. Equal probabilities go to the language first in the alphabet. Repeated rows are
predicted each (and train once); an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hand_back, id_and_text, real_id, texts_of

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
MAX_ROWS, PER_TEXT, EPOCHS, BATCH, RATE = 4_000, 4, 4, 128, 0.01
#: Windows predicted at a time.
AT_ONCE = 2048
#: Classes of bytes: 0 all that aren't letters or digits, 1 digits, 2 to 27 letters, then a class for each byte beyond ASCII.
SYMBOLS = 28 + 128
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[ord("0") : ord("9") + 1] = 1
SYMBOL[ord("a") : ord("z") + 1] = SYMBOL[ord("A") : ord("Z") + 1] = np.arange(2, 28)
SYMBOL[128:] = np.arange(28, SYMBOLS)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
STEP = WINDOW - max(WIDTHS) + 1


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where all windows of all texts begin, and the text of each; an empty text has none."""
    size = np.diff(off)
    n = np.where(size > 0, np.maximum(-(-(size - max(WIDTHS) + 1) // STEP), 1), 0)
    text = np.repeat(np.arange(len(size)), n)
    return off[:-1][text] + STEP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), text


def symbols(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A row of classes for each window; 0 from its text's end on."""
    padded = np.concatenate((SYMBOL[data], np.zeros(WINDOW, np.uint8)))
    out = padded[start[:, None] + np.arange(WINDOW)]
    over = np.flatnonzero(start + WINDOW > stop)
    out[over] = np.where(start[over, None] + np.arange(WINDOW) < stop[over, None], out[over], 0)
    return out


class Network:
    """Weights: `filters` by width, a table of (place in the filter, symbol, filter); `shift` of each filter; `dense` and `bias` of the softmax."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, n = languages, FILTERS * len(WIDTHS)
        self.filters = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.shift, self.dense, self.bias]

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width: tables of the responses to two symbols (rows of 256 times the first plus the second) and, for odd widths, one."""
        out = []
        for f in self.filters:
            tables = []
            for k in range(0, len(f) - 1, 2):
                table = np.zeros((SYMBOLS, 256, FILTERS), np.float32)
                table[:, :SYMBOLS] = f[k][:, None] + f[k + 1][None]
                tables.append(table.reshape(-1, FILTERS))
            if len(f) % 2:
                tables.append(f[-1])
            out.append(tables)
        return out


def responses(x: np.ndarray, tables: list[np.ndarray], width: int, two: np.ndarray) -> np.ndarray:
    """Of each filter of a width at each place; two: pairs of symbols from each place on."""
    n = x.shape[1] - width + 1
    out = None
    for k, table in enumerate(tables):
        place = 2 * k
        at = two[:, place : place + n] if place + 1 < width else x[:, place : place + n]
        got = table.take(at.reshape(-1), axis=0)
        out = got if out is None else np.add(out, got, out)
    return out.reshape(len(x), n, FILTERS)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def forward(net: Network, tables: list[list[np.ndarray]], x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Probabilities, pooled responses, and (if wanted) where each filter responds most."""
    two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    pooled, where = [], []
    for width, own in zip(WIDTHS, tables, strict=True):
        r = responses(x, own, width, two)
        if places:
            where.append(r.argmax(1))
            pooled.append(np.take_along_axis(r, where[-1][:, None], 1)[:, 0])
        else:
            pooled.append(r.max(1))
    h = np.maximum(np.concatenate(pooled, 1) + net.shift, 0)
    return softmax(h @ net.dense + net.bias), h, where


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """A network trained on windows x (rows of symbols) and their languages y (numbers)."""
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    p = net.parameters()
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    balance = len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1))
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            xb, yb = x[batch], y[batch]
            prob, h, where = forward(net, net.pairs(), xb, places=True)
            g = prob.copy()
            g[np.arange(len(yb)), yb] -= 1
            g *= (balance[yb] / len(yb))[:, None].astype(np.float32)
            back = (g @ net.dense.T) * (h > 0)
            grads: list[np.ndarray] = []
            for k, width in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros((width, SYMBOLS, FILTERS), np.float32)
                for place in range(width):  # only where the filter responds most
                    symbol = np.take_along_axis(xb, where[k] + place, 1).astype(np.int64)
                    grad[place] = np.bincount((symbol * FILTERS + np.arange(FILTERS)).ravel(), own.ravel(), SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
                grads.append(grad)
            grads += [back.sum(0), h.T @ g, g.sum(0)]
            step += 1
            for a, grad, first, second in zip(p, grads, m, v, strict=True):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad**2 - second)
                a -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: Network, tables: list[list[np.ndarray]], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The probabilities of each text's languages, a row a text; 0 for texts without letters in any window."""
    n = len(off) - 1
    total, weight = np.zeros((n, len(net.languages))), np.zeros(n)
    start, text = windows(data, off)
    for low in range(0, len(start), AT_ONCE):
        s, t = start[low : low + AT_ONCE], text[low : low + AT_ONCE]
        x = symbols(data, s, off[1:][t])
        letters = (x > 1).sum(1).astype(np.float64)
        some = letters > 0
        if some.any():
            p = forward(net, tables, x[some])[0].astype(np.float64) * letters[some][:, None]
            for k in range(p.shape[1]):
                total[:, k] += np.bincount(t[some], p[:, k], n)
            weight += np.bincount(t[some], letters[some], n)
    return total / np.maximum(weight, 1)[:, None]


def held_out() -> Column:
    """Whether a document is held out: a third of all, by the checksum of its id; never without an id."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Network | None:
    """A network from max_rows labelled documents (doc_id, text, lang) at most; None if there are none."""
    rows = docs.filter("doc_id is not null and lang is not null and text <> ''").filter(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("hash"))
    share = min(1.0, 2 * max_rows / max(rows.count(), 1))  # twice as many by their hash, of which the least stay
    rows = rows.filter(F.pmod("hash", F.lit(1 << 30)) < math.ceil(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = texts_of(b.column("text"))
            start, text = windows(data, off)
            first = np.searchsorted(text, np.arange(b.num_rows + 1))
            n = np.diff(first)
            spread = (np.arange(PER_TEXT)[None, :] * (n - 1)[:, None] / (PER_TEXT - 1)).round().astype(np.int64)
            # evenly spaced from the first to the last, each once
            some = (n[:, None] > 0) & np.concatenate((np.ones((len(n), 1), bool), np.diff(spread) > 0), 1)
            own, at = np.nonzero(some)
            x = symbols(data, start[first[own] + spread[own, at]], off[1:][own])
            told = (x > 1).any(1)
            x, own = x[told], own[told]
            ends = np.searchsorted(own, np.arange(b.num_rows + 1))
            cut = [x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("hash"), pa.array(cut, pa.binary())], ["lang", "hash", "cut"])

    found = rows.mapInArrow(run, "lang string, hash long, cut binary").groupBy("hash").agg(F.min(F.struct("lang", "cut")).alias("x"))
    got = found.orderBy(F.pmod("hash", F.lit(1 << 30)), "hash").limit(max_rows).select("hash", "x.lang", "x.cut").toArrow().sort_by("hash")
    cuts, langs = got.column("cut").to_pylist(), got.column("lang").to_pylist()
    x = np.frombuffer(b"".join(cuts), np.uint8).reshape(-1, WINDOW)
    if not len(x):
        return None
    languages = sorted({lang for lang, c in zip(langs, cuts, strict=True) if c})
    y = np.repeat([languages.index(lang) if c else 0 for lang, c in zip(langs, cuts, strict=True)], [len(c) // WINDOW for c in cuts])
    return fit(x, y, languages)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (its probability) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.pairs() if own else []
        for b in batches:
            ends, low = texts_of(b.column("text"))[1], 0
            while low < b.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + AT_ONCE * STEP, "right")) - 1)
                yield _predicted(b.slice(low, high - low), own, tables)
                low = high
            hand_back()

    out = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


def _predicted(rows: pa.RecordBatch, net: Network | None, tables: list[list[np.ndarray]]) -> pa.RecordBatch:
    data, off = texts_of(rows.column("text"))
    letters = np.concatenate(([0], np.cumsum((SYMBOL[data] > 1) & (data < 128))))
    known = letters[off[1:]] > letters[off[:-1]]
    beyond = np.concatenate(([0], np.cumsum(data > 127)))
    for k in np.flatnonzero(~known & (beyond[off[1:]] > beyond[off[:-1]])).tolist():
        known[k] = LETTER.search(data[off[k] : off[k + 1]].tobytes().decode()) is not None
    if net is None:
        known[:] = False
        p = np.zeros((len(known), 1))
    else:
        p = predict(net, tables, data, off).round(6)
    best = p.argmax(1)
    lang = [net.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
    score = np.where(known, p[np.arange(len(p)), best], 0.0)
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def predict_languages(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a network trained on those that aren't held out."""
    out = identify(docs, train(docs, max_rows))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
