"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward GRU run over the UTF-8 bytes of every window of WIDTH bytes of the whole text; at each position
a softmax over both states labels that byte, and the mean over all positions of a document is its distribution. States
begin anew in each window, so that windows run side by side. The network is trained in numpy by backpropagation through
time on a bounded sample: of every language at most ROWS documents, and of each of these at most WINDOWS windows, from
anywhere in the text. The driver gets these windows, never a text.

Cases: null texts and texts without a letter are "und" with score 0; if no row can teach, everything is "und"; every
language that has a row to learn from can be predicted, however many there are; texts of any length are labelled whole, a
bounded part at a time; of languages with equal means the first by name is predicted; equal rows each give their row, and
teach once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, table, trimmed, utf8
from skein.llm.samples import fold, picked_ids

FOLDS, HELD_OUT = 3, 1
#: Rows of each language to learn from at most, and windows of each row.
ROWS, WINDOWS = 500, 3
#: States each way, bytes of a window, and the symbol that fills windows up.
HIDDEN, WIDTH, PAD = 8, 64, 256
#: Passes over the sample, more of them if they have fewer than LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, STEP_ROWS, RATE = 6, 600, 128, 0.02
#: Bytes run side by side.
CHUNK = 1 << 18
f32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + f32(0.5)


class Gru:
    """One direction. Gates are rows: update, reset, candidate, each of HIDDEN; columns are windows."""

    def __init__(self, embed: np.ndarray, inner: np.ndarray):
        self.embed, self.inner = embed, inner

    def run(self, symbols: np.ndarray, keep: bool = False):
        """symbols (time, windows) to states (time, HIDDEN, windows); with keep also what training needs."""
        t, n = symbols.shape
        h = np.zeros((HIDDEN, n), f32)
        states, kept = np.empty((t, HIDDEN, n), f32), []
        two = 2 * HIDDEN
        for k in range(t):
            x = self.embed[:, symbols[k]]
            gates = sigmoid(x[:two] + self.inner[:two] @ h)
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            inner = self.inner[two:] @ h
            c = np.tanh(x[two:] + r * inner)
            if keep:
                kept.append((h, z, r, inner, c))
            h = c + z * (h - c)
            states[k] = h
        return states, kept

    def back(self, symbols: np.ndarray, kept: list, outer: np.ndarray):
        """Gradients of embed and inner, from those of the states."""
        d_embed, d_inner = np.zeros_like(self.embed.T), np.zeros_like(self.inner)
        d = np.zeros_like(outer[0])
        for k in range(len(symbols) - 1, -1, -1):
            h, z, r, inner, c = kept[k]
            d = d + outer[k]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * inner * r * (1 - r)
            din = np.concatenate([dz, dr, dc * r])
            dx = np.concatenate([dz, dr, dc])
            np.add.at(d_embed, symbols[k], dx.T)
            d_inner += din @ h.T
            d = d * z + self.inner.T @ din
        return d_embed.T, d_inner


class Network:
    def __init__(self, languages: list[str], weights: list[np.ndarray]):
        self.languages, self.weights = languages, weights
        self.forward, self.backward = Gru(*weights[:2]), Gru(*weights[2:4])

    def logits(self, states: np.ndarray) -> np.ndarray:
        return np.matmul(self.weights[4], states) + self.weights[5][:, None]

    def states(self, symbols: np.ndarray, keep: bool = False):
        ahead, a = self.forward.run(symbols, keep)
        behind, b = self.backward.run(symbols[::-1], keep)
        return np.concatenate([ahead, behind[::-1]], 1), a, b

    def positions(self, symbols: np.ndarray) -> np.ndarray:
        """The distribution over languages at each (time, language, window)."""
        x = self.logits(self.states(symbols)[0])
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        return x / x.sum(1, keepdims=True)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """The mean distribution of each text's bytes; zeros for an empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n = -(-lengths // WIDTH)
        owner = np.repeat(np.arange(len(texts)), n)
        padded = np.full(int(n.sum()) * WIDTH, PAD, np.int64)
        begins = (np.cumsum(n) - n) * WIDTH
        flat = np.frombuffer(b"".join(texts), np.uint8)
        padded[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))] = flat
        windows = padded.reshape(-1, WIDTH)
        step = CHUNK // WIDTH
        for at in range(0, len(windows), step):
            symbols = np.ascontiguousarray(windows[at : at + step].T)
            p = self.positions(symbols)
            p *= (symbols != PAD)[:, None, :]
            np.add.at(out, owner[at : at + step], p.sum(0).T)
        return out / np.maximum(lengths, 1)[:, None]

    def train_step(self, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        states, a, b = self.states(symbols, keep=True)
        x = self.logits(states)
        x -= x.max(1, keepdims=True)
        p = np.exp(x)
        p /= p.sum(1, keepdims=True)
        p[:, labels, np.arange(len(labels))] -= 1
        real = (symbols != PAD)[:, None, :]
        p *= real / f32(real.sum())
        d_out = np.tensordot(p, states, ([0, 2], [0, 2]))
        d_states = np.matmul(self.weights[4].T, p)
        forward = self.forward.back(symbols, a, d_states[:, :HIDDEN])
        backward = self.backward.back(symbols[::-1], b, np.ascontiguousarray(d_states[::-1, HIDDEN:]))
        return [*forward, *backward, d_out, p.sum((0, 2))]


def train(rows: list[tuple[list[bytes], str]]) -> Network | None:
    """rows: (windows of at most WIDTH bytes, language)."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(3)
    place = {lang: k for k, lang in enumerate(languages)}
    pieces = [(np.frombuffer(piece, np.uint8), place[lang]) for told, lang in rows for piece in told]
    windows = [np.concatenate([piece, np.full(WIDTH - len(piece), PAD)]) for piece, _ in pieces]
    labels = [label for _, label in pieces]
    scale = lambda *shape: rng.normal(0, 0.3, shape).astype(f32)
    weights = [scale(3 * HIDDEN, PAD + 1), scale(3 * HIDDEN, HIDDEN), scale(3 * HIDDEN, PAD + 1), scale(3 * HIDDEN, HIDDEN), scale(len(languages), 2 * HIDDEN), np.zeros(len(languages), f32)]
    network = Network(languages, weights)
    if not windows:
        return None
    x, y = np.array(windows, np.int64), np.array(labels)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = -(-len(x) // STEP_ROWS)
    epochs = max(EPOCHS, -(-LEAST_STEPS // steps))
    total = epochs * steps
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), STEP_ROWS):
            own = order[at : at + STEP_ROWS]
            step += 1
            rate = RATE * (1 - (step - 1) / total) + 1e-3
            for w, g, m, v in zip(weights, network.train_step(np.ascontiguousarray(x[own].T), y[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f32)
    return network


def fitted(documents: DataFrame) -> Network | None:
    """Trained on at most ROWS documents of each language outside the held-out fold."""
    known = documents.select("doc_id", "lang", utf8(F.col("text")).alias("data")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND octet_length(data) > 0").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    picked = picked_ids(known.select("doc_id", "lang"), "lang", F.lit(ROWS))
    n = F.ceil(F.octet_length("data") / WIDTH)
    starts = F.array_distinct(F.array(*(F.pmod(F.xxhash64("doc_id", F.lit(k)), n) for k in range(WINDOWS))))
    pieces = F.transform(starts, lambda k: F.substring(F.col("data"), (k * WIDTH + 1).cast("int"), F.lit(WIDTH)))
    # at most ROWS ids a language, hence the broadcast
    rows = known.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min(pieces).alias("pieces"))
    return train([([bytes(x) for x in r["pieces"]], r["lang"]) for r in rows.orderBy("lang", "doc_id").select("lang", "pieces").toLocalIterator()])


def identified(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts, at = whole.column("text").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < CHUNK or end == at):
                    size += len(texts[end] or "")
                    end += 1
                part = [t or "" for t in texts[at:end]]
                told, scores = ["und"] * len(part), [0.0] * len(part)
                if network is not None:
                    spread = network.documents([t.encode() if any(map(str.isalpha, t)) else b"" for t in part])
                    best = spread.argmax(1)
                    for k, p in enumerate(spread[np.arange(len(part)), best].tolist()):
                        if p > 0:
                            told[k], scores[k] = network.languages[best[k]], min(p, 1.0)
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(at, end - at).cast(pa.int64()), pa.array(told, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
                at = end

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, fitted(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
