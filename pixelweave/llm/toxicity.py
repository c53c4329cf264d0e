"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a word embedding and the mean embedding of its character 4-grams, both learned with the network. Both
directions of the network read windows of ``LENGTH`` words, every ``STRIDE`` words, over the whole text; attention pools a
window's states to one logit, and a text's score is its highest window's, calibrated on sampled texts that training left out.

Training takes a bounded sample of labelled rows (``TOXIC_ROWS`` and ``CLEAN_ROWS``, the first by hash). Tasks read the whole
sampled texts; one task trains on the windows these pick (at most ``PICKED`` a text), and only counts of word buckets, the
model and the logits to calibrate by come to the driver. Texts are labelled as wholes, so a toxic text's most suspect window is taken to be toxic, by how much
more often its words stand in toxic texts of the other half of the sample. These statistics choose windows to train on; the
network doesn't see them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import in_chunks, mix, release, stage, to_bytes, U64, width, Words
from pixelweave.llm.tokens import forget

LENGTH, STRIDE = 48, 32
HIDDEN, EMBED = 10, 12
BUCKETS = 1 << 16
TOXIC_ROWS, CLEAN_ROWS = 800, 1600
#: Windows that a text gives to training.
PICKED = 4
EPOCHS, BATCH, LEAST_STEPS = 6, 64, 300

_SPACES = np.ones(256, bool)
_SPACES[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


class Read:
    """Some texts' words as places in a list of distinct words, with each distinct word's bucket and 4-gram buckets."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, lower=True, spaces=_SPACES)
        self.begins, self.counts = words.begins, words.counts
        uniq, first, self.word = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.bucket = (uniq % U64(BUCKETS)).astype(np.int64)
        starts, lens = words.starts[first], (words.stops - words.starts)[first]
        raw = np.frombuffer(words.data, np.uint8)
        sizes = lens + 3  # a mark before, two after: as many 4-grams as bytes
        ends = np.cumsum(sizes)
        own = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        inside = (own > 0) & (own <= np.repeat(lens, sizes))
        text = np.zeros(len(own) + 4, U64)
        text[: len(own)] = 1
        at = np.repeat(starts, sizes) + own - 1
        low = raw[at[inside]].astype(U64)
        text[: len(own)][inside] = low + U64(32) * ((low >= 65) & (low <= 90))
        grams = mix(text[:-4] | text[1:-3] << U64(8) | text[2:-2] << U64(16) | text[3:-1] << U64(24))
        keep = own < np.repeat(lens, sizes)
        self.grams = (grams[keep] % U64(BUCKETS)).astype(np.int64)
        self.gram_starts = np.cumsum(lens) - lens
        self.gram_counts = lens

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each window's words, its text, and which of its places are before the text's end. A text without words has no window."""
        n = np.where(self.counts > 0, np.maximum(1, -(-(self.counts - LENGTH) // STRIDE) + 1), 0)
        owner = np.repeat(np.arange(len(n)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        place = start[:, None] + np.arange(LENGTH)
        real = place < self.counts[owner][:, None]
        at = np.where(real, place + self.begins[owner][:, None], 0)
        return np.where(real, self.word[at] if len(self.word) else 0, 0), owner, real

    def part(self, words: np.ndarray) -> Read:
        """The same of some of the distinct words."""
        out = object.__new__(Read)
        out.bucket, out.gram_counts = self.bucket[words], self.gram_counts[words]
        out.gram_starts = np.cumsum(out.gram_counts) - out.gram_counts
        out.grams = self.grams[np.repeat(self.gram_starts[words] - out.gram_starts, out.gram_counts) + np.arange(out.gram_counts.sum())]
        return out


def inputs(read: Read, model: dict) -> np.ndarray:
    """A row for each distinct word: its embedding, and the mean of those of its 4-grams."""
    if not len(read.bucket):
        return np.zeros((0, 2 * EMBED), np.float32)
    grams = np.add.reduceat(model["grams"][read.grams], read.gram_starts, axis=0) / read.gram_counts[:, None]
    return np.concatenate([model["words"][read.bucket], grams], axis=1).astype(np.float32)


def log_odds(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For word buckets the log of the ratio of their shares of toxic and clean texts, drawn to 0 where rare; ``seen``: (2, BUCKETS)."""
    share = (seen + 0.5) / (np.maximum(texts, 1)[:, None] + 1)
    return (np.log(share[1] / share[0]) * seen.sum(0) / (seen.sum(0) + 2)).astype(np.float32)


def picked_windows(text: bytes, toxic: bool, odds: np.ndarray, seed: int) -> list[bytes]:
    """The windows of a whole text to train on: a toxic one's most suspect; a clean one's two most suspect and two by chance."""
    words = Words([text], lower=True, spaces=_SPACES)
    n = len(words.hashes)
    if not n:
        return []
    suspect = np.maximum(odds[(words.hashes % U64(BUCKETS)).astype(np.int64)], 0)
    starts = np.arange(max(1, -(-(n - LENGTH) // STRIDE) + 1)) * STRIDE
    spread = starts[:, None] + np.arange(LENGTH)
    values = np.where(spread < n, suspect[np.minimum(spread, n - 1)], 0)
    by = np.argsort(-np.sort(values, axis=1)[:, -3:].sum(1), kind="stable")
    chance = np.random.default_rng(seed & (1 << 63) - 1).integers(0, len(by), PICKED - 2)
    chosen = by[:1] if toxic else np.unique(np.concatenate([by[:2], chance]))
    return [b" ".join(words.data[a:b] for a, b in zip(words.starts[s : s + LENGTH].tolist(), words.stops[s : s + LENGTH].tolist(), strict=True)) for s in starts[chosen].tolist()]


def new_model(seed: int = 7) -> dict:
    g, h, d = np.random.default_rng(seed), HIDDEN, 2 * EMBED
    model = {"words": g.normal(0, 0.05, (BUCKETS, EMBED)), "grams": g.normal(0, 0.05, (BUCKETS, EMBED))}
    for k in ("f", "b"):
        model |= {f"w{k}": g.normal(0, d**-0.5, (d, 3 * h)), f"u{k}": g.normal(0, h**-0.5, (h, 3 * h)), f"c{k}": np.zeros(3 * h)}
    model |= {"attend": g.normal(0, 0.3, 2 * h), "out": g.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(projected: np.ndarray, places: np.ndarray, real: np.ndarray, u: np.ndarray, order, keep: bool):
    """States of one direction, (steps, windows, HIDDEN); ``projected``: the input's part of the gates for each word."""
    h, n = HIDDEN, len(places)
    state, states, held = np.zeros((n, h), np.float32), np.empty((LENGTH, n, h), np.float32), {}
    for t in order:
        x = projected[places[:, t]]
        v = state @ u
        gates = _sigmoid(x[:, : 2 * h] + v[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * v[:, 2 * h :])
        after = np.where(real[:, t, None], new + z * (state - new), state)
        if keep:
            held[t] = (state, z, r, new, v[:, 2 * h :])
        state = states[t] = after
    return states, held


def forward(model: dict, x: np.ndarray, places: np.ndarray, real: np.ndarray, keep: bool = False):
    held = []
    for k, order in (("f", range(LENGTH)), ("b", range(LENGTH - 1, -1, -1))):
        held.append(_gru(x @ model[f"w{k}"] + model[f"c{k}"], places, real, model[f"u{k}"], order, keep))
    states = np.concatenate([held[0][0], held[1][0]], axis=2)
    energy = np.where(real.T, states @ model["attend"], -1e9)
    share = np.exp(energy - energy.max(0))
    share /= share.sum(0)
    values = states @ model["out"]
    logits = (share * values).sum(0) + model["bias"][0]
    return logits, (states, share, values, held)


def backward(model: dict, x: np.ndarray, places: np.ndarray, real: np.ndarray, kept, d_logit: np.ndarray) -> dict:
    states, share, values, held = kept
    h, grads = HIDDEN, {}
    pooled = (share * values).sum(0)
    d_energy = share * (values - pooled) * d_logit
    d_value = share * d_logit
    grads["attend"] = np.einsum("tn,tnh->h", d_energy, states)
    grads["out"] = np.einsum("tn,tnh->h", d_value, states)
    grads["bias"] = np.array([d_logit.sum()], np.float32)
    d_states = d_energy[:, :, None] * model["attend"] + d_value[:, :, None] * model["out"]
    d_x = np.zeros_like(x)
    for k, order, part in (("f", range(LENGTH - 1, -1, -1), slice(0, h)), ("b", range(LENGTH), slice(h, 2 * h))):
        u, back = model[f"u{k}"], held[k == "b"][1]
        carry, d_u = np.zeros((len(places), h), np.float32), np.zeros_like(u)
        d_projected = np.zeros((len(x), 3 * h), np.float32)
        for t in order:
            state, z, r, new, v_new = back[t]
            d = carry + d_states[t, :, part]
            live = real[:, t, None]
            d_new = d * (1 - z) * (1 - new * new) * live
            d_z = d * (state - new) * z * (1 - z) * live
            d_r = d_new * v_new * r * (1 - r)
            d_v = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_u += state.T @ d_v
            carry = np.where(live, d * z + d_v @ u.T, d)
            np.add.at(d_projected, places[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
        grads[f"u{k}"] = d_u
        grads[f"w{k}"] = x.T @ d_projected
        grads[f"c{k}"] = d_projected.sum(0)
        d_x += d_projected @ model[f"w{k}"].T
    grads["x"] = d_x
    return grads


def train(windows: list[bytes], labels: np.ndarray, seed: int = 7) -> dict:
    """A model of labelled windows, not yet calibrated."""
    rng, model, labels = np.random.default_rng(seed), new_model(seed), np.asarray(labels, np.float32)
    read = Read(windows)
    places, owner, real = read.windows()
    labels = labels[owner]
    dense = [k for k in model if k not in ("words", "grams")]
    moments = {k: [np.zeros_like(model[k]), np.zeros_like(model[k])] for k in dense}
    scale = {k: np.full(BUCKETS, 1e-3, np.float32) for k in ("words", "grams")}
    positive = float(labels.sum())
    balance, step = min((len(labels) - positive) / max(positive, 1), 4.0), 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(labels), 1))) if len(labels) else 0):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            used, at = np.unique(places[batch], return_inverse=True)
            part = read.part(used)
            at, live, y = at.reshape(len(batch), LENGTH), real[batch], labels[batch]
            x = inputs(part, model)
            logits, kept = forward(model, x, at, live, keep=True)
            d = ((_sigmoid(logits) - y) * np.where(y > 0, balance, 1.0) / len(batch)).astype(np.float32)
            grads = backward(model, x, at, live, kept, d)
            step += 1
            for k, m in moments.items():
                g = np.clip(grads[k], -1, 1)
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                model[k] -= 0.02 * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
            own, rows = grads["x"][:, :EMBED], np.repeat(grads["x"][:, EMBED:] / part.gram_counts[:, None], part.gram_counts, axis=0)
            for k, buckets, g in (("words", part.bucket, own), ("grams", part.grams, rows)):
                np.add.at(scale[k], buckets, (g * g).sum(1))
                np.subtract.at(model[k], buckets, 0.05 * g / np.sqrt(scale[k][buckets])[:, None])
    model["slope"], model["shift"], model["empty"] = 1.0, 0.0, 0.0
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on logits by Newton steps, the slope drawn to 1; one label only: as it is."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    mean, spread = float(x.mean()), float(x.std()) + 1e-6
    z, a, b = (x - mean) / spread, 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + 0.1 * b])
        m = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(m, g), -1, 1)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    a = max(a, 1e-3) / spread
    return float(a), float(b - a * mean)


def max_logit(model: dict, read: Read) -> np.ndarray:
    """Each text's highest window logit; -inf for texts without words."""
    top = np.full(len(read.counts), -np.inf)
    places, owner, real = read.windows()
    x = inputs(read, model)
    for s in range(0, len(places), 4096):
        part = slice(s, s + 4096)
        logits, _ = forward(model, x, places[part], real[part])
        np.maximum.at(top, owner[part], logits)
    return top


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    out = []
    for first, last in in_chunks(texts):
        top = max_logit(model, Read(texts[first:last]))
        fit = 1 / (1 + np.exp(-np.clip(model["slope"] * top + model["shift"], -30, 30)))
        out.append(np.where(np.isfinite(top), fit, model["empty"]))
    return np.concatenate(out) if out else np.zeros(0)


def held_out() -> F.Column:
    """Whether a row is left out of training: crc32(doc_id as text) mod 5 is 0; a null doc_id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> dict:
    """A model of the bounded sample of labelled rows; without labelled rows of both kinds it scores all the same.

    Of rows that share a doc_id the one with the least text is read. A fifth of the sample calibrates, the rest trains.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    few = None
    for toxic, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        own = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        few = own if few is None else few.union(own)
    # A few thousand rows: bounded by the two parameters.
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    part = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(n)).cast("int")
    sample = stage(sample.select("toxic", part(1, 2).alias("half"), (part(2, 5) == 0).alias("apart"), F.xxhash64("doc_id").alias("seed"), "text").repartition(width(docs.sparkSession), "seed"), "toxicity-sample")

    def buckets(batches):
        for pdf in batches:
            found = [np.unique((Words([t], lower=True, spaces=_SPACES).hashes % U64(BUCKETS)).astype(np.int32)) for t in to_bytes(pdf["text"].array)]
            group = np.repeat((2 * pdf["half"] + pdf["toxic"]).to_numpy(np.int32), [len(f) for f in found])
            yield pd.DataFrame({"bucket": np.concatenate(found), "group": group})

    trained = sample.where("not apart")
    counted = trained.mapInPandas(buckets, "bucket int, group int").groupBy("bucket").agg(*[F.sum((F.col("group") == g).cast("int")).alias(f"n{g}") for g in range(4)])
    seen, texts = np.zeros((4, BUCKETS)), np.zeros(4)
    table = counted.where("n0 + n1 + n2 + n3 > 1").toArrow()  # a row for each bucket at most
    for g in range(4):
        seen[g, table["bucket"].to_numpy()] = table[f"n{g}"].to_numpy()
    for r in trained.groupBy((2 * F.col("half") + F.col("toxic")).alias("g")).agg(F.count("*").alias("n")).collect():
        texts[r.g] = r.n
    odds = [log_odds(seen[2:], texts[2:]), log_odds(seen[:2], texts[:2])]  # for a half, by the other one

    def pick(batches):
        for pdf in batches:
            rows = [(t, w) for text, t, h, s in zip(to_bytes(pdf["text"].array), pdf["toxic"], pdf["half"], pdf["seed"], strict=True) for w in picked_windows(text, bool(t), odds[h], s)]
            yield pd.DataFrame(rows, columns=["toxic", "words"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip((bytes(w) for w in pdf["words"]), pdf["toxic"].tolist(), strict=True))
        out = pd.DataFrame({"model": [pickle.dumps(train([w for w, _ in rows], np.array([t for _, t in rows], int), seed))]})
        release()
        return out

    # The windows of the bounded sample meet in one task, which leaves the driver's memory alone; the model is of fixed size.
    picked = trained.mapInPandas(pick, "toxic int, words binary").withColumn("one", F.lit(1))
    learned = picked.groupBy("one").applyInPandas(learn, "model binary").collect()
    model = pickle.loads(learned[0].model) if learned else train([], np.zeros(0), seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tops(batches):
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "top": np.concatenate([max_logit(shared.value, Read([t])) for t in to_bytes(pdf["text"].array)])})

    apart = [(r.top, r.toxic) for r in sample.where("apart").mapInPandas(tops, "toxic int, top double").collect() if np.isfinite(r.top)]
    model["slope"], model["shift"] = _calibrate(np.array([t for t, _ in sorted(apart)]), np.array([float(y) for _, y in sorted(apart)]))
    rate = (texts[1] + texts[3]) / max(texts.sum(), 1)
    model["empty"] = float(min(max(rate, 1e-3), 0.49))
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; ``labels``: doc_id, toxic (0 or 1).

    Null texts are empty; texts without words score the training rows' share of toxic ones, below 0.5. Null and repeated
    doc_ids are scored as rows of their own; labels that contradict each other count as toxic. Without labels of both
    kinds all texts score alike. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))  # of fixed size

    def score(batches):
        for pdf in batches:
            s = score_texts(model.value, to_bytes(pdf["text"].array))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted to be toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def keep(batches):
        forget()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model.value, to_bytes(batch.column(place).to_pylist())) < 0.5, pa.bool_()))
        release()

    return docs.mapInArrow(keep, docs.schema)
