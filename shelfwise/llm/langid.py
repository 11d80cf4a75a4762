"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of each lower-cased word (parts of at most ``WORD_BYTES``
bytes where a word is longer) in both directions and gives every byte position a probability
for each language. A document's probability is the mean over all positions of its whole text;
its language is the likeliest, its score that probability. The state starts anew at each
word, so a word is computed once for all its occurrences that a worker process remembers.

It is trained in numpy by backpropagation through time, in one task, on a bounded sample:
``SAMPLE_DOCS`` documents a language (the least by a hash of the id) and at most
``SAMPLE_WORDS`` of their words. Only documents with a language whose CRC-32 of the id as
text leaves a remainder modulo 3 other than 1 are used. The weights are a few kilobytes.

A null text or one without a letter gets ``und`` with score 0. Empty tables, and tables
without a usable label, give ``und`` for every row. Repeated rows and rows with a NULL id each
get their prediction (a NULL id is not held out and not learnt from).
"""

from __future__ import annotations

import io
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import exact_columns, ship
from shelfwise.llm.tokens import slices

HIDDEN = 16
WORD_BYTES = 24
SAMPLE_DOCS = 200
SAMPLE_WORDS = 20_000
STEPS = 1500
BATCH = 256
#: Words a worker process remembers.
MEMORY_WORDS = 600_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def word_parts(text: str) -> list[bytes]:
    """The words of a lower-cased text in UTF-8, long ones in parts."""
    words = text.lower().encode().split()
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]


class ByteNetwork:
    """Gated recurrent units in both directions and a softmax layer over languages."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = list(langs)
        self.hidden = hidden
        scale = 1 / np.sqrt(hidden)
        self.weights = {}
        for way in "fb":
            self.weights[f"{way}_in"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.weights[f"{way}_state"] = rng.normal(0, scale, (hidden, 3 * hidden))
        self.weights["out"] = rng.normal(0, scale, (2 * hidden, len(langs)))
        self.weights["bias"] = np.zeros(len(langs))
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _run(self, way: str, inputs: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of one direction, and what the way back needs."""
        size, table, state = self.hidden, self.weights[f"{way}_in"], self.weights[f"{way}_state"]
        times = range(inputs.shape[1])
        h = np.zeros((len(inputs), size), np.float32)
        states = np.empty((inputs.shape[1], len(inputs), size), np.float32)
        kept = []
        for t in times if way == "f" else reversed(times):
            gates, back = table[inputs[:, t]], h @ state
            both = gates[:, : 2 * size] + back[:, : 2 * size]
            np.negative(both, out=both)
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            z, r = both[:, :size], both[:, size:]
            n = np.tanh(gates[:, 2 * size :] + r * back[:, 2 * size :])
            kept.append((t, h, z, r, n, back[:, 2 * size :]))
            h = (1 - z) * n + z * h
            states[t] = h
        return states, kept

    def labels(self, inputs: np.ndarray) -> np.ndarray:
        """Probabilities (batch, time, language) of words of one length, as byte rows."""
        forward, backward = self._run("f", inputs)[0], self._run("b", inputs)[0]
        logits = np.concatenate([forward, backward], 2) @ self.weights["out"] + self.weights["bias"]
        logits -= logits.max(2, keepdims=True)
        values = np.exp(logits)
        return (values / values.sum(2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, inputs: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over positions, back through time."""
        size, w = self.hidden, self.weights
        runs = {way: self._run(way, inputs) for way in "fb"}
        joint = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        logits = joint @ w["out"] + w["bias"]
        logits -= logits.max(2, keepdims=True)
        error = np.exp(logits)
        error /= error.sum(2, keepdims=True)
        error[:, np.arange(len(target)), target] -= 1
        error /= inputs.size
        grads = {"out": np.einsum("tbh,tbl->hl", joint, error), "bias": error.sum((0, 1))}
        into = error @ w["out"].T
        for way, part in (("f", into[:, :, :size]), ("b", into[:, :, size:])):
            state = w[f"{way}_state"]
            table_grad, state_grad = np.zeros_like(w[f"{way}_in"]), np.zeros_like(state)
            later = np.zeros((len(inputs), size), np.float32)
            for t, h, z, r, n, back in reversed(runs[way][1]):
                d = part[t] + later
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (h - n) * z * (1 - z)
                dr = dn * back * r * (1 - r)
                gate = np.concatenate([dz, dr, dn], 1)
                inner = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(table_grad, inputs[:, t], gate)
                state_grad += h.T @ inner
                later = d * z + inner @ state.T
            grads[f"{way}_in"], grads[f"{way}_state"] = table_grad, state_grad
        return grads

    def fit(self, words: list[bytes], target: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam over batches of words of one length, lengths drawn by how many bytes they have."""
        rng = np.random.default_rng(seed)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        by = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        lengths = np.array(list(by))
        share = np.array([n * len(by[n]) for n in by], float)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pool = by[int(rng.choice(lengths, p=share / share.sum()))]
            chosen = rng.choice(pool, min(BATCH, len(pool)), replace=False)
            inputs = np.array([list(words[i]) for i in chosen], np.uint8)
            rate = 0.01 * (1 - 0.9 * step / steps)
            for k, g in self.gradients(inputs, target[chosen]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                size = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                self.weights[k] -= (rate * first[k] / (1 - 0.9**step) / size).astype(np.float32)

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Per word the sum over its positions of the language probabilities."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for low in range(0, len(at), 1024):
                some = at[low : low + 1024]
                inputs = np.frombuffer(b"".join([words[i] for i in some]), np.uint8)
                out[some] = self.labels(inputs.reshape(len(some), n)).sum(1)
        return out

    def to_bytes(self) -> bytes:
        """The network, to be sent to tasks."""
        out = io.BytesIO()
        np.savez(out, langs=np.array(self.langs), **self.weights)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> ByteNetwork:
        """The network that ``to_bytes`` wrote."""
        with np.load(io.BytesIO(raw)) as file:
            net = ByteNetwork(file["langs"].tolist(), len(file["f_state"]))
            net.weights = {k: file[k] for k in net.weights}
        return net


class Predictor:
    """A network and the words it has met in this process."""

    def __init__(self, raw: bytes):
        self.net = ByteNetwork.from_bytes(raw)
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.net.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        split = [word_parts(t) if t and _LETTER.search(t) else [] for t in texts]
        fresh = list(set().union(*split) - self.place.keys())
        if len(self.place) + len(fresh) > MEMORY_WORDS:
            self.place, self.sums = {}, self.sums[:0]
            fresh = list(set().union(*split))
        if fresh:
            at = len(self.place)
            self.place.update((w, at + i) for i, w in enumerate(fresh))
            self.sums = np.concatenate([self.sums, self.net.word_sums(fresh)])
        place = self.place.__getitem__
        langs, scores = [], []
        for words in split:
            if not words:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            where = np.fromiter(map(place, words), np.int64, len(words))
            pooled = self.sums[where].sum(0, dtype=np.float64)
            best = int(pooled.argmax())
            langs.append(self.net.langs[best])
            scores.append(float(min(1.0, pooled[best] / pooled.sum())))
        return langs, scores


@lru_cache(maxsize=1)
def _predictor(raw: bytes) -> Predictor:
    return Predictor(raw)


def _crc_rest(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> bytes | None:
    """The network learnt from the bounded sample of labelled rows; None without any."""
    ship(docs.sparkSession)
    usable = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang")
    ).where((_crc_rest("id") != 1) & F.col("lang").isNotNull() & F.col("body").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "body")
    sample = (
        usable.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE_DOCS)
        .select("lang", "body", "place")
    )

    def one_task(rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(3)
        rows = rows.sort_values(["lang", "place", "body"])
        langs = sorted(rows["lang"].unique())
        words, target = [], []
        for i, lang in enumerate(langs):
            own = [w for t in rows.loc[rows["lang"] == lang, "body"] for w in word_parts(t)]
            if len(own) > SAMPLE_WORDS:
                own = [own[j] for j in rng.choice(len(own), SAMPLE_WORDS, replace=False)]
            words += own
            target += [i] * len(own)
        net = ByteNetwork(langs)
        if words and len(langs) > 1:
            net.fit(words, np.array(target))
        return pd.DataFrame({"raw": [net.to_bytes()]})

    found = sample.groupBy().applyInPandas(one_task, "raw binary").collect()
    return bytes(found[0]["raw"]) if found else None


def identify(
    docs: DataFrame,
    model: bytes | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """All columns of the rows and held_out, lang_pred and score; trains if no model is given.

    Columns of these three names, in any case, are replaced.
    """
    ship(docs.sparkSession)
    if model is None:
        known = exact_columns(docs, *dict.fromkeys((id_col, text_col, lang_col)))
        model = train(known, id_col, text_col, lang_col)

    def predicted(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        else:
            langs, scores = [], []
            bodies = [None if t is None else t for t in texts]
            for a, b in slices([t or "" for t in bodies]):
                got = _predictor(model).predict(bodies[a:b])
                langs += got[0]
                scores += got[1]
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    guess = F.pandas_udf(predicted, "lang_pred string, score double")
    own = ("held_out", "lang_pred", "score")
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in own]
    # Columns by place, since their names may differ from each other or from ours by case only.
    by_place = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_place, text_place = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    out = by_place.withColumn("guess", guess(F.col(text_place))).select(
        *[f"c{i}" for i in kept],
        F.coalesce(_crc_rest(id_place) == 1, F.lit(False)),
        "guess.lang_pred",
        "guess.score",
    )
    return out.toDF(*[docs.columns[i] for i in kept], *own)
