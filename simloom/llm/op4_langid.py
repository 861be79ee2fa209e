"""Language identification with a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes that together cover the
whole text. A window's bytes are embedded, run through filters of several
widths with ReLU, max-pooled over the window and classified by a softmax layer;
a document's probabilities are the mean of its windows', weighted by length.
The network is trained in numpy (Adam, back-propagation by hand) on windows of
a bounded sample of labelled rows: at most ``ROWS_PER_LANG`` rows of each
language, chosen by a hash of their ids, and at most ``SAMPLE_CHARS`` characters at
a hashed offset of each. They are taken from ``SPREAD`` parts of each language,
equally many from each, so no task ranks all rows of a frequent language.

Defined results: a text that is null or has no letter gets ``und`` with score
0. Nulls in ``lang`` aren't learned from; with no labelled row at all every
text is ``und``. Ties between languages go to the first in order. Repeated rows
give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm import kernels as K

ROWS_PER_LANG, SAMPLE_CHARS = 800, 800
WINDOW, EMBED, FILTERS, WIDTHS = 256, 6, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 4, 64, 5e-3
SPREAD = 16
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its Unicode category; numbers such as ½ or Ⅷ are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


class ByteCNN:
    """Embedding, convolutions of several widths, max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, f = list(langs), FILTERS * len(WIDTHS)
        span = max(WIDTHS)
        self.emb = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.w = rng.normal(0, (2 / (EMBED * 3)) ** 0.5, (span * EMBED, f)).astype(np.float32)
        self.mask = np.concatenate([np.repeat((np.arange(span * EMBED) < w * EMBED)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.w *= self.mask
        self.b = np.zeros(f, np.float32)
        self.v = rng.normal(0, f**-0.5, (f, len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.emb[x]
        n, length, _ = e.shape
        span = max(WIDTHS)
        cols = np.empty((n, length - span + 1, span * EMBED), np.float32)
        for k in range(span):
            cols[:, :, k * EMBED : (k + 1) * EMBED] = e[:, k : length - span + 1 + k]
        return cols

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(x)
        out = (cols.reshape(-1, cols.shape[2]) @ self.w).reshape(cols.shape[0], cols.shape[1], -1)
        best = out.argmax(1)
        top = np.take_along_axis(out, best[:, None], 1)[:, 0] + self.b
        return cols, best, np.maximum(top, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows [n, WINDOW + widest - 1] of bytes."""
        cols = self._columns(x)
        out = (cols.reshape(-1, cols.shape[2]) @ self.w).reshape(cols.shape[0], cols.shape[1], -1).max(1) + self.b
        z = np.maximum(out, 0) @ self.v + self.c
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> "ByteCNN":
        rng, names = np.random.default_rng(seed), ("emb", "w", "b", "v", "c")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        s = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
                cols, best, h = self._pooled(xb)
                z = h @ self.v + self.c
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.v.T) * (h > 0)
                picked = np.take_along_axis(cols, best[:, :, None], 1)  # [n, filters, taps]
                g = {"v": h.T @ p, "c": p.sum(0), "b": dh.sum(0), "w": np.einsum("nft,nf->tf", picked, dh) * self.mask}
                de = dh[:, :, None] * self.w.T[None]  # [n, filters, taps]
                g["emb"] = np.zeros_like(self.emb)
                for k in range(max(WIDTHS)):
                    np.add.at(g["emb"], np.take_along_axis(xb, best + k, 1).ravel(), de[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
                step += 1
                for k in names:
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.001 * (g[k] ** 2 - s[k])
                    getattr(self, k)[...] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, emb=self.emb, w=self.w, b=self.b, v=self.v, c=self.c, langs=np.array(self.langs, dtype=str))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "ByteCNN":
        z = np.load(io.BytesIO(raw))
        net = cls([str(x) for x in z["langs"]])
        net.emb, net.w, net.b, net.v, net.c = (z[k] for k in ("emb", "w", "b", "v", "c"))
        return net


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of consecutive texts, the text of each, and the bytes it covers.

    Window k of a text starts at byte k * WINDOW and overlaps the next one by
    the widest filter, so that every byte group of the text is in a window;
    bytes past the text are 0.
    """
    size = np.diff(at)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][text] + k * WINDOW
    i = start[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    fits = i < at[1:][text][:, None]
    x = np.where(fits, data[np.minimum(i, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(i.shape, np.uint8)
    return x.astype(np.uint8), text, np.minimum(size[text] - k * WINDOW, WINDOW)


def train(docs: DataFrame) -> bytes:
    """A network trained on a bounded sample of the labelled rows of ``docs``."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != ""))
    key = F.xxhash64(F.col("doc_id"), F.lit(17))
    offset = F.expr(f"cast(1 + pmod(key, greatest(1, length(text) - {SAMPLE_CHARS} + 1)) as int)")
    parts = rows.select("lang", "text", key.alias("key")).select("lang", "key", F.substring(F.col("text"), offset, F.lit(SAMPLE_CHARS)).alias("text"))
    part = F.pmod(F.xxhash64("key"), F.lit(SPREAD))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy("key")))
    sample = ranked.where(F.col("rank") <= ROWS_PER_LANG // SPREAD).drop("rank")
    got = sample.orderBy("key", "lang").collect()
    langs = sorted({r["lang"] for r in got})
    net = ByteCNN(langs)
    if langs:
        data, at = K.buffer(pa.array([r["text"] for r in got], pa.string()))
        x, text, _ = windows(data, at)
        y = np.array([langs.index(r["lang"]) for r in got])[text]
        net.fit(x, y)
    return net.dump()


def predict(docs: DataFrame, model: bytes, keep: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` with the language of every whole text and its probability."""
    fields = [f for f in docs.select(*keep).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{pred}` string", f"`{score}` double"])
    hidden = "text" if "text" in keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteCNN.load(model)
        for batch in batches:
            column = batch.column("text")
            data, at = K.buffer(column)
            sums = np.zeros((batch.num_rows, max(1, len(net.langs))))
            for i, j in K.slices(at, 1 << 18):
                x, text, size = windows(data, at[i : j + 1])
                if net.langs:
                    for b in range(0, len(x), 256):
                        p = net.probabilities(x[b : b + 256])
                        np.add.at(sums, text[b : b + 256] + i, p * size[b : b + 256, None])
            raw = data[at[0] : at[-1]]
            has = np.array([has_letter(raw[at[d] - at[0] : at[d + 1] - at[0]].tobytes().decode("utf-8", "replace")) for d in range(batch.num_rows)], bool)
            has &= bool(net.langs)
            total = sums.sum(1)
            prob = sums / np.where(total > 0, total, 1)[:, None]
            best = prob.argmax(1)
            names = [net.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
            value = np.where(has, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(names, pa.string()), pa.array(value)], [*(f.name for f in fields), pred, score])

    return docs.select(*keep, *([] if hidden else ["text"])).mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.coalesce(held, F.lit(False)).alias("held_out"))
    return predict(docs, train(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
