"""Language identification by a byte convolutional network in numpy.

Windows of 256 bytes go through filters of widths 2, 3 and 4 over one-hot bytes, a rectifier, max pooling over the
window and a softmax. Trained here by Adam on a bounded sample of labelled windows; a document's prediction is the
mean of its windows' log-probabilities, weighted by the bytes in each, over the whole text.

For inference the filters are tables: a width-2 response is one lookup by a pair of bytes, widths 3 and 4 are sums
of two lookups, so each byte costs three gathers however long the text is.

Defined cases: a null text, or one without letters, is `und` with score 0. A null language or a text without letters
is never learned from. Without any labelled text every prediction is `und`. Rows without a doc_id are not held out, rows that
repeat one are held out together, and all are predicted each by itself; an empty table gives no rows; extra columns are
ignored. Only the text is an input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
FILTERS = 10  # of each width
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: Bounds of the sample that the network learns from: windows of each language, and of all languages together. Every
#: labelled language is learned, however many there are; with more than 200 of them each has fewer windows.
WINDOWS_PER_LANGUAGE = 2500
WINDOWS_IN_ALL = 500_000

_ascii_letter = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ascii_letter.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # one (width, 256, FILTERS) for each width
    bias: np.ndarray  # (3 * FILTERS,)
    out: np.ndarray  # (3 * FILTERS, languages)
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses by a pair of bytes at the window's position, by the pair two further, and by the byte two further."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        here = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1)
        return np.ascontiguousarray(here, np.float32), pair(four[2], four[3]).astype(np.float32), three[2].astype(np.float32)


def _cut(text: bytes) -> np.ndarray:
    """Whole text as rows of WINDOW bytes, the last one filled with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, seed: int = 1) -> Network:
    """Fit the network; windows (n, WINDOW) of bytes, labels (n,) of positions in languages."""
    rng = np.random.default_rng(seed)
    classes = len(languages)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(3 * FILTERS, np.float32), rng.normal(0, 0.3, (3 * FILTERS, classes)).astype(np.float32), np.zeros(classes, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, length = 0, WINDOW - max(WIDTHS) + 1
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows].astype(np.int64), labels[rows]
            best, value = [], []
            for k, width in enumerate(WIDTHS):
                response = sum(params[k][j][x[:, j : j + length]] for j in range(width))
                best.append(response.argmax(1))
                value.append(np.take_along_axis(response, best[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(value, 1) + params[3]
            pooled = np.maximum(raw, 0)
            logits = pooled @ params[4] + params[5]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ params[4].T) * (raw > 0)
            grads = []
            for k, width in enumerate(WIDTHS):
                g, own = np.zeros_like(params[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    np.add.at(g[j], (np.take_along_axis(x, best[k] + j, 1), np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(0), pooled.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[:3], *params[3:])


class Predictor:
    """A network with its lookup tables, for batches of whole texts."""

    def __init__(self, network: Network):
        self.network = network
        self.here, self.pair_on, self.byte_on = network.tables()

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, languages) for (n, WINDOW) bytes, 64 windows at a time so that the responses stay in cache."""
        net, out, length = self.network, [], WINDOW - max(WIDTHS) + 1
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64]
            pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
            response = self.here.take(pairs[:, :length], 0)
            response[:, :, FILTERS : 2 * FILTERS] += self.byte_on.take(x[:, 2 : 2 + length], 0)
            response[:, :, 2 * FILTERS :] += self.pair_on.take(pairs[:, 2 : 2 + length], 0)
            logits = np.maximum(response.max(1) + net.bias, 0) @ net.out + net.out_bias
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(net.languages)), np.float32)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.network.languages:
            return said, score
        known = [k for k, t in enumerate(texts) if t and has_letter(t)]
        at = 0
        while at < len(known):  # about a megabyte of text at a time
            part, size = [], 0
            while at < len(known) and size < 1 << 20:
                part.append(known[at])
                size += len(texts[known[at]])
                at += 1
            cuts = [_cut(texts[k]) for k in part]
            first = np.cumsum([0, *map(len, cuts)])
            weight = np.full(first[-1], WINDOW, np.float64)
            for k, end in zip(part, first[1:], strict=True):
                weight[end - 1] = len(texts[k]) - (len(texts[k]) - 1) // WINDOW * WINDOW
            each = self.log_probabilities(np.concatenate(cuts)) * weight[:, None]
            mean = np.add.reduceat(each, first[:-1], 0) / np.add.reduceat(weight, first[:-1])[:, None]
            mean -= mean.max(1, keepdims=True)
            p = np.exp(mean)
            p /= p.sum(1, keepdims=True)
            for row, k in enumerate(part):
                best = int(p[row].argmax())
                said[k], score[k] = self.network.languages[best], float(p[row, best])
        return said, score


def held_out() -> Column:
    """The quarter of documents that is never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = WINDOWS_PER_LANGUAGE, seed: int = 1) -> Network:
    """Learn from at most per_language windows of each labelled language, one window of a document.

    The sample is by hash of id and text, so that rows without an id are drawn each by itself, at a rate that the counts of languages give, so its expected size is bounded
    whatever the size of the table; each window stands at a hashed place of its text.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return Network([], [np.zeros((w, 256, FILTERS)) for w in WIDTHS], np.zeros(3 * FILTERS), np.zeros((3 * FILTERS, 0)), np.zeros(0))
    per_language = max(1, min(per_language, WINDOWS_IN_ALL // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 20))
    rates = docs.sparkSession.createDataFrame([(k, min(1 << 20, (per_language << 20) // n + 1)) for k, n in sorted(counts.items())], "lang string, rate long")
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.greatest(F.lit(1), F.char_length("text") - WINDOW)).cast("int")
    drawn = own.withColumn("draw", draw).join(F.broadcast(rates), "lang").where((F.col("draw") < F.col("rate")) & F.col("text").isNotNull())
    sample = drawn.select("lang", F.substring("text", place + 1, F.lit(WINDOW)).alias("w"), F.xxhash64("doc_id", "text", F.lit(seed + 2)).alias("o"))
    rows = sorted((r["o"], r["lang"], r["w"].encode()[:WINDOW]) for r in sample.orderBy("o", "lang", "w").limit(2 * per_language * len(counts)).collect())
    rows = [r for r in rows if has_letter(r[2])]
    languages = sorted({r[1] for r in rows})
    windows = np.concatenate([_cut(r[2]) for r in rows]) if rows else np.zeros((0, WINDOW), np.uint8)
    labels = np.array([languages.index(r[1]) for r in rows], np.int64)
    return train(windows, labels, languages, seed=seed)


def predict_documents(docs: DataFrame, network: Network, carry: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """(doc_id, *carry, lang_pred, score) of every whole text: a map over the scan, without a shuffle.

    prefix: put before the two new names, for tables that have columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some hundred kilobytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            said, score = predictor.predict(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", *carry, *new])

    new = [f"{prefix}lang_pred", f"{prefix}score"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    return docs.select("doc_id", *[c for c in carry if c != "text"], "text").mapInArrow(run, f"{kinds}, `{new[0]}` string, `{new[1]}` double")
