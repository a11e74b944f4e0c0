"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained with follow-the-regularised-leader steps under an elastic-net penalty, which keeps most of them at
zero; a temperature fitted on held-back texts calibrates the probabilities. A text's n-grams are hashed into BUCKETS
features, weighted by frequency within the text and inverse document frequency. Frequencies are shares of a text, so a
text's score is the mean of its n-grams' weights and needs no counts per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekwell.llm.batches import by_bytes, ids_and_texts, small_batches

LONGEST_GRAM, BUCKETS = 3, 1 << 15
#: Fit: at most about this many labelled texts of each language, chosen by a hash of the id; whole texts.
FIT_TEXTS = 600
#: The share of them, by another hash, that only the temperature sees.
HELD_BACK = 0.2
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 2e-3, 1e-4
#: Shares of a text are small numbers; this scale brings features near one.
SCALE = 20.0
TEXTS_AT_ONCE = 32
#: Longer texts are counted in parts of so many characters; weights gathered at once, over all classes, are as many.
PART, GATHERED = 1 << 18, 1 << 22
#: Languages with fewer labelled texts than this aren't learned.
LEAST_TEXTS = 2


def cleaned(text: str) -> str:
    """Lower case, runs of anything but letters as one space; empty if there is no letter."""
    words = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower().translate(_ASCII)
    return " ".join(words.split())


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of cleaned texts (1 to LONGEST_GRAM code points, a space on either side), and
    where each text's begin; empty texts have none."""
    lead = LONGEST_GRAM - 1  # spaces that grams may reach back into, so no gram sees the text before
    lengths = np.array([len(t) + 2 if t else 0 for t in texts], np.int64)
    points = np.frombuffer("".join(f"{' ' * lead} {t} " for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    out = np.zeros((len(points), LONGEST_GRAM), np.int32)
    rolled = points.copy()
    for n in range(1, LONGEST_GRAM + 1):
        if n > 1:
            rolled[n - 1 :] = rolled[n - 1 :] + (points[: len(points) - n + 1] << np.uint64(21 * (n - 1)))
        spread = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, n - 1] = (spread >> np.uint64(64 - 15)).astype(np.int32)
    own = np.ones(len(points), bool)
    some = np.flatnonzero(lengths)
    first = (ends - lengths)[some] + lead * np.arange(len(some))
    for k in range(lead):
        own[first + k] = False
    return out[own], ends - lengths


def counted(text: str) -> tuple[np.ndarray, int]:
    """How often each feature occurs in one cleaned text, and how many places it has; long texts go in parts, each
    reading the end of the one before."""
    counts, places, lead = np.zeros(BUCKETS), 0, LONGEST_GRAM - 1
    padded = f" {text} "
    for i in range(0, len(padded), PART):
        # grams() adds a space to either side: those places are cut off, and what is reached back into is given.
        part = padded[max(0, i - lead) : i + PART]
        found = grams([part])[0][1 + min(i, lead) : -1]
        counts += np.bincount(found.ravel(), minlength=BUCKETS)
        places += len(found)
    return counts, places


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


@dataclass
class Model:
    """What prediction needs: classes, a table of weights times inverse document frequencies, biases, a temperature."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row of class probabilities for each text; all NaN where it has no letter."""
        out = np.full((len(texts), len(self.classes)), np.nan)
        if not len(self.classes):
            return out
        clean = list(map(cleaned, texts))
        most = min(PART, GATHERED // len(self.classes))
        long = [i for i, t in enumerate(clean) if len(t) > most]
        group: list[int] = []
        for i in [*[i for i, t in enumerate(clean) if 0 < len(t) <= most], None]:
            if group and (i is None or sum(len(clean[j]) for j in group) + len(clean[i]) > most):
                found, starts = grams([clean[j] for j in group])
                sums = np.add.reduceat(self.weights[found].sum(1), starts, axis=0)
                out[group] = self._softmax(sums, np.diff(np.append(starts, len(found))))
                group = []
            group.append(i)
        for i in long:
            counts, places = counted(clean[i])
            out[i] = self._softmax((counts @ self.weights)[None], np.array([places]))[0]
        return out

    def _softmax(self, sums: np.ndarray, places: np.ndarray) -> np.ndarray:
        logits = (SCALE * sums / (LONGEST_GRAM * places[:, None]) + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each text with their scaled shares, a few texts at a time."""
    rows = []
    for k in range(0, len(texts), TEXTS_AT_ONCE):
        found, starts = grams(list(map(cleaned, texts[k : k + TEXTS_AT_ONCE])))
        for i, j in zip(starts, np.append(starts[1:], len(found))):
            ids, n = np.unique(found[i:j], return_counts=True)
            rows.append((ids, (SCALE * n / max(1, n.sum())).astype(np.float32)))
    return rows


def train(texts: list[str], labels: list[str], held_back: np.ndarray) -> Model:
    """Fit on the texts where `held_back` is false, calibrate on the others."""
    classes = sorted(set(labels))
    y = np.array([classes.index(c) for c in labels])
    rows = _sparse(texts)
    fit = [i for i in range(len(rows)) if not held_back[i] and len(rows[i][0])]
    df = np.zeros(BUCKETS)
    for i in fit:
        df[rows[i][0]] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    k = len(classes)
    z, n, b = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros(k)

    def weights(ids: np.ndarray) -> np.ndarray:
        zi, ni = z[ids], n[ids]
        return -np.sign(zi) * np.maximum(np.abs(zi) - L1, 0) / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(fit):
            ids, x = rows[i]
            x = x * idf[ids]
            w = weights(ids)
            logits = x @ w + b
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - step * w
            n[ids] += g * g
            b -= 0.05 * p
    table = weights(np.arange(BUCKETS)) * idf[:, None]
    model = Model(classes, table.astype(np.float32), b, 1.0)
    check = [i for i in range(len(rows)) if held_back[i] and len(rows[i][0])]
    if check and k > 1:
        logits = np.log(np.maximum(np.concatenate([model.probabilities([texts[i]]) for i in check]), 1e-300))
        # Smoothed targets: a check without errors doesn't mean that there are none.
        slack = 1 / (len(check) + 2)
        target = np.full((len(check), k), slack / (k - 1))
        target[np.arange(len(check)), y[check]] = 1 - slack

        def loss(t: float) -> float:
            scaled = (logits - logits.max(1, keepdims=True)) / t
            return float(np.mean(np.log(np.exp(scaled).sum(1)) - (target * scaled).sum(1)))

        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def fold(id_col: str = "doc_id"):
    """The remainder that decides what may be learned from: rows where it is 1 are held out."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold.

    Rows are counted by language first; a hash of the id then takes about FIT_TEXTS of each (all, if fewer), so the
    sample doesn't grow with the table and no language is sorted or collected whole.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 1))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().where(f"count >= {LEAST_TEXTS}").collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    # Hashes of 31 bits: a language's rows below its limit are the sample.
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, FIT_TEXTS / n) * (1 << 31)))])
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 31))
    chosen = labelled.where(F.col(lang_col).isin(list(counts)) & (draw < F.element_at(limit, F.col(lang_col))))
    rows = chosen.select(
        F.lit(0).alias("one"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(1)).alias("order")
    )
    # The sample is bounded, so one task may train on it; the driver only sees the model.
    classes, shape, weights, bias, temperature = rows.groupBy("one").applyInArrow(
        _train, "classes array<string>, shape array<int>, weights binary, bias array<double>, temperature double"
    ).first()
    return Model(classes, np.frombuffer(weights, np.float32).reshape(shape), np.array(bias), temperature)


def _train(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("order", "ascending"), ("text", "ascending")])
    held_back = rows["order"].to_numpy() % 1000 < 1000 * HELD_BACK
    m = train(rows["text"].to_pylist(), rows["lang"].to_pylist(), held_back)
    return pa.table(
        {
            "classes": pa.array([m.classes], pa.list_(pa.string())), "shape": pa.array([list(m.weights.shape)], pa.list_(pa.int32())),
            "weights": pa.array([m.weights.tobytes()], pa.binary()), "bias": pa.array([m.bias.tolist()], pa.list_(pa.float64())),
            "temperature": pa.array([m.temperature], pa.float64()),
        }
    )


def _predict(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.classes, "und"], object)
    for keys, texts in by_bytes(batches, 1 << 20):
        p = model.probabilities(texts)
        best, score = np.full(len(texts), len(model.classes)), np.zeros(len(texts))
        if model.classes:
            known = ~np.isnan(p).any(1)
            best[known], score[known] = p[known].argmax(1), p[known].max(1)
        yield pa.record_batch([keys, pa.array(names[best], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; `und` with score 0 if the text is null or has no letter, or nothing was
    learned. Ties go to the first language in order. Repeated rows and null ids are rows of their own, an empty table
    gives none, and no other column is read. The model's size is fixed by BUCKETS and the number of languages; Spark
    broadcasts it if it is over a megabyte. A long text is counted in parts, so memory doesn't grow with it."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    read = small_batches(ids_and_texts(docs, id_col, text_col))
    return read.mapInArrow(partial(_predict, model), schema).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on two folds and predict every row: id, held_out, lang_pred, score (the calibrated probability).

    A row without an id is neither held out nor learned from. Null texts, empty tables and the rest: see `predict`.
    """
    model = fit(docs, id_col, text_col, lang_col)
    held_out = F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out")
    return predict(docs, model, id_col, text_col).select(id_col, held_out, "lang_pred", "score")


def _filter(model: Model, least: float, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        if model.classes:
            good = np.nan_to_num(model.probabilities(texts), nan=0.0).max(1) >= least
        else:
            good = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        yield batch.filter(pa.array(good))


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is told with a probability of `least` or more, columns unchanged whatever their
    names. A text without a letter, or null, has the probability 0. Where nothing could be learned there are no
    probabilities, and only such texts go."""
    model = fit(docs, id_col, text_col, lang_col)
    return small_batches(docs).mapInArrow(partial(_filter, model, least, docs.columns.index(text_col)), docs.schema)
