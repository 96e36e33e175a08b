"""Toxicity: a bag of subword embeddings averaged into a linear softmax.

Words are represented by hashed character n-grams (and themselves), so an unseen misspelling
shares most of its vectors with the word it distorts.  A text is cut into windows of
consecutive words; a window's n-gram vectors are averaged and classified; the text's score is its
highest window's, calibrated on the training documents.  Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled documents: at first every window bears its document's
label, later of a toxic document only its most toxic one.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, LOWER, batches, identified, kept_rows, mix, span_hashes, string_bytes

#: Labelled documents that training reads at most, for either label, and the bytes of the longest text among them.
SAMPLE_DOCS = 2400
SAMPLE_TEXT_BYTES = 1 << 14

#: Distinct words whose n-grams are made at once.
WORDS = 1 << 14
_U = np.uint64
#: ASCII that ends a word besides white space; other marks stay, as part of a disguised spelling.
_APART = np.zeros(256, bool)
_APART[[0x20, *range(0x09, 0x0E), *b'.,;:!?"()[]{}|']] = True


class Bags:
    """Windows of texts as bags of n-gram buckets, by distinct word."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, window: int, buckets: int, sizes: tuple[int, int]):
        raw = LOWER[raw]
        inside = np.concatenate([[False], ~_APART[raw], [False]])
        edge = inside[1:] != inside[:-1]
        cuts = at[1:-1]
        edges = np.flatnonzero(edge)
        starts, ends = edges[0::2], edges[1::2]
        extra = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
        extra = extra[inside[extra + 1] & inside[extra]] if len(extra) else extra
        starts, ends = np.sort(np.concatenate([starts, extra])), np.sort(np.concatenate([ends, extra]))
        of_text = np.searchsorted(starts, at)
        n = np.diff(of_text)
        h = span_hashes(raw, starts, ends)
        _, first, word = np.unique(h, return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        data, n_grams, grams = raw.tobytes(), [], []
        for i in range(0, len(first), WORDS):  # some distinct words at a time: their n-grams' hashes are much larger than what is kept
            words = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[i : i + WORDS]].tolist(), ends[first[i : i + WORDS]].tolist())]
            chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
            lengths = np.array([len(w) + 2 for w in words], np.int64)
            k, g = _grams(chars, np.cumsum(lengths) - lengths, lengths, buckets, sizes)
            n_grams.append(k)
            grams.append(g)
        self.gram_at = np.concatenate([[0], np.cumsum(np.concatenate([*n_grams, np.zeros(0, np.int64)]))])
        self.gram = np.concatenate([*grams, np.array([buckets], np.int32)])  # ends in a bucket that counts nothing
        # the last window of a text takes what is left, at least half a window unless it is the only one
        k = np.maximum(1, (n + window // 2) // window) * (n > 0)
        self.doc = np.repeat(np.arange(len(n)), k)
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        self.start = of_text[:-1][self.doc] + nth * window
        self.stop = np.where(nth == k[self.doc] - 1, of_text[1:][self.doc], self.start + window)


def _grams(chars, opens, lengths, buckets, sizes):
    """Each word's number of n-grams, and their buckets: n-grams of all sizes, then the whole word."""
    word = np.repeat(np.arange(len(opens)), lengths)
    left = np.repeat(opens + lengths, lengths) - np.arange(len(chars))  # characters to the word's end
    words, hashes = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(chars), np.uint64)
        for k in range(sizes[1]):
            h[: len(chars) - k] = mix(h[: len(chars) - k] * _GOLD + chars[k:] + _U(k)) if k < len(chars) else h[: len(chars) - k]
            if k + 1 >= sizes[0]:
                ok = left >= k + 1
                words.append(word[ok])
                hashes.append(h[ok])
        whole = np.add.reduceat(mix(chars * _GOLD + (np.arange(len(chars)) - np.repeat(opens, lengths)).astype(np.uint64)), opens)
    words.append(np.arange(len(opens)))
    hashes.append(mix(whole))
    w = np.concatenate(words)
    order = np.argsort(w, kind="stable")
    return np.bincount(w, minlength=len(opens)), (np.concatenate(hashes)[order] % _U(buckets)).astype(np.int32)


class SubwordSoftmax:
    """The classifier: vectors of n-gram buckets, a softmax of two classes over their mean, a calibration."""

    def __init__(self, buckets: int = 1 << 16, dim: int = 8, window: int = 8, sizes: tuple[int, int] = (4, 6), seed: int = 3):
        self.buckets, self.dim, self.window, self.sizes = buckets, dim, window, sizes
        rng = np.random.default_rng(seed)
        # vectors start at nought, so n-grams that training never met say nothing; the softmax starts at random instead
        self.vectors = np.zeros((buckets, dim), np.float32)
        half = rng.normal(0, 1 / np.sqrt(dim), dim).astype(np.float32)
        self.weights = np.stack([-half, half], 1)
        self.bias = np.zeros(2, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def bags(self, raw: np.ndarray, at: np.ndarray) -> Bags:
        return Bags(raw, at, self.window, self.buckets, self.sizes)

    def fit(self, raw: np.ndarray, at: np.ndarray, labels: np.ndarray, epochs: int = 10, rate: float = 4.0, longest: float = 0.5, batch: int = 512, seed: int = 5, steps: int = 600, noisy: float = 0.2, patience: int = 6, clean_weight: float = 1.0) -> "SubwordSoftmax":
        """Joint training of vectors and softmax.

        A vector's step is its gradient times a rate that falls to nought, cut at the length ``longest``; the softmax takes AdaGrad steps.  After
        each epoch the documents of the tuning fold are ranked; the best epoch's parameters stay, and ``patience`` epochs without a better one end training.
        ``clean_weight`` is how many clean texts of the corpus a clean text stands for when the cut is set, if a toxic one stands for one.
        """
        b = self.bags(raw, at)
        rng = np.random.default_rng(seed)
        y = labels[b.doc].astype(np.int64)
        tuned = rng.random(len(labels)) < 0.25  # these choose the epoch and the cut, which would be too bold on texts learnt by heart
        if not (labels[tuned].any() and labels[~tuned].any()) or labels[tuned].all() or labels[~tuned].all():
            tuned[:] = False
        judged = tuned if tuned.any() else ~tuned
        learnt = ~tuned[b.doc]
        epochs = max(epochs, -(-steps * batch // max(1, len(b.doc))))
        n_grams = np.diff(b.gram_at)
        seen = [np.full(self.weights.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)]
        best, kept, since = (-np.inf, -np.inf), self._parameters(), 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            if epoch < noisy * epochs:
                use = np.flatnonzero(learnt)
            else:
                top = self._tops(b, labels)
                clean = np.flatnonzero(learnt & (y == 0))
                use = np.concatenate([np.flatnonzero(top & learnt), rng.choice(clean, min(len(clean), 2 * len(labels)), replace=False) if len(clean) else clean])
            rng.shuffle(use)
            for i in range(0, len(use), batch):
                part = use[i : i + batch]
                n_words = b.stop[part] - b.start[part]
                at_w = np.cumsum(n_words) - n_words
                words = b.word[np.repeat(b.start[part] - at_w, n_words) + np.arange(n_words.sum())]
                n = n_grams[words]
                at_g = np.cumsum(n) - n
                grams = b.gram[np.repeat(b.gram_at[words] - at_g, n) + np.arange(n.sum())]
                of = np.repeat(np.repeat(np.arange(len(part)), n_words), n)
                total = np.bincount(of, minlength=len(part)).astype(np.float32)
                mean = np.add.reduceat(self.vectors[grams], np.concatenate([[0], np.cumsum(total.astype(np.int64))[:-1]])) / total[:, None]
                z = mean @ self.weights + self.bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                weight = np.where(y[part] == 1, (y[part] == 0).sum() + 1, (y[part] == 1).sum() + 1).astype(np.float32)
                weight /= weight.mean()
                d = (p - np.eye(2, dtype=np.float32)[y[part]]) * weight[:, None]
                dmean = d @ self.weights.T / total[:, None]
                hit, back = np.unique(grams, return_inverse=True)
                grad = np.stack([np.bincount(back, dmean[of, k], len(hit)) for k in range(self.dim)], 1).astype(np.float32)
                for value, sums, g in ((self.weights, seen[0], mean.T @ d), (self.bias, seen[1], d.sum(0))):
                    sums += g * g
                    value -= 0.03 * g / np.sqrt(sums)
                move = pace * grad
                self.vectors[hit] -= move / np.maximum(1, np.sqrt((move * move).sum(1)) / longest)[:, None]
            now = self._quality(self.margins(b, len(labels))[judged], labels[judged])
            since += 1
            if now > best:
                best, kept, since = now, self._parameters(), 0
            elif since >= patience and epoch >= noisy * epochs:
                break
        self.vectors, self.weights, self.bias = kept
        self._calibrate(self.margins(b, len(labels))[judged], labels[judged], clean_weight)
        return self

    def _parameters(self):
        return self.vectors.copy(), self.weights.copy(), self.bias.copy()

    @staticmethod
    def _quality(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
        """Share of pairs of a toxic and a clean text in the right order, ties by halves; then the distance of their means in deviations."""
        if not np.isfinite(margins).all():
            return -np.inf, -np.inf
        x, y = np.sort(margins[labels == 0]), margins[labels == 1]
        order = float((np.searchsorted(x, y, "left") + np.searchsorted(x, y, "right")).mean() / 2 / max(1, len(x)))
        return order, float((y.mean() - x.mean()) / (margins.std() + 1e-12))

    def _tops(self, b: Bags, labels: np.ndarray) -> np.ndarray:
        margins, best = self._windows(b), np.full(len(labels), -np.inf)
        np.maximum.at(best, b.doc, margins)
        return margins >= best[b.doc]

    def _windows(self, b: Bags) -> np.ndarray:
        """Each window's margin: the softmax is linear in the mean, so a word counts by a number of its own."""
        u = np.append(self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), 0.0).astype(np.float64)
        n = np.diff(b.gram_at)
        value = np.add.reduceat(u[b.gram], b.gram_at[:-1]) if len(n) else np.zeros(0)
        values = np.concatenate([[0.0], np.cumsum(value[b.word])]) if len(n) else np.zeros(1)
        counts = np.concatenate([[0], np.cumsum(n[b.word])]) if len(n) else np.zeros(1)
        return (values[b.stop] - values[b.start]) / np.maximum(1, counts[b.stop] - counts[b.start]) + float(self.bias[1] - self.bias[0])

    def margins(self, b: Bags, n_texts: int) -> np.ndarray:
        """Each text's highest window margin; a text without words has the bias alone."""
        out = np.full(n_texts, -np.inf)
        np.maximum.at(out, b.doc, self._windows(b))
        out[np.isinf(out)] = min(float(self.bias[1] - self.bias[0]), -self.shift / max(self.scale, 1e-9) - 1.0)
        return out

    def _calibrate(self, margins: np.ndarray, labels: np.ndarray, clean_weight: float) -> None:
        if not labels.any() or labels.all():
            return
        # the cut of least cost at the corpus' share of toxic texts, in the middle of its gap, becomes one half; a clean text called toxic costs as much as two toxic ones missed
        order = np.argsort(margins, kind="stable")
        x, y = margins[order], labels[order]
        errors = np.concatenate([[0], np.cumsum(y)]) + 2 * clean_weight * np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        best = np.flatnonzero(errors == errors.min())
        k = int(best[len(best) // 2])
        lo, hi = x[max(k - 1, 0)], x[min(k, len(x) - 1)]
        self.scale = 4.0 / max(1e-6, float(np.std(x)))
        self.shift = -self.scale * float((lo + hi) / 2)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.scale * self.margins(self.bags(raw, at), len(at) - 1) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(doc_id):
    """The fold that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, text_bytes: int = SAMPLE_TEXT_BYTES, **kw) -> SubwordSoftmax:
    """Trains on at most ``sample_docs`` documents of either label, the first by a hash of their ids.

    Texts beyond ``text_bytes`` are left out of the sample, so that it has a known size; of ids labelled
    twice the higher label counts; null ids and labels don't.  Without a document of each label
    the classifier calls nothing toxic.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna().where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    # twice the number, as some have no text or too long a one
    drawn = [known.where(F.col("label") == k).withColumn("r", F.xxhash64("doc_id", F.lit("sample"))).orderBy("r").limit(2 * sample_docs) for k in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])  # at most 4 * sample_docs rows of 20 bytes
    d = identified(docs, id_col, text_col).where(F.octet_length("text") <= text_bytes).join(F.broadcast(sample), "doc_id")
    d = d.dropDuplicates(["doc_id", "text"])
    texts = [d.where(F.col("label") == k).orderBy("r", F.xxhash64("text")).limit(sample_docs) for k in (0, 1)]
    counts = {r.label: r.n for r in known.where("label IN (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = counts.get(0, 0) / max(1, counts.get(1, 0))

    def train(it):
        """The one task that has the sample: neither it nor what training needs comes to the driver, just the model."""
        rows = sorted((x for b in it for x in zip(*(b.column(k).to_pylist() for k in range(3)))), key=lambda x: (x[0], x[1], x[2]))
        raw, at = string_bytes(pa.array([x[2] for x in rows], pa.string()))
        y = np.array([x[1] for x in rows], np.int64)
        model = SubwordSoftmax(**kw)
        if not len(y) or not y.any() or y.all():
            model.bias[0] = 10.0  # nothing to learn from
        else:
            model.fit(raw, at, y, clean_weight=odds / max(1e-9, (len(y) - y.sum()) / y.sum()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = texts[0].unionByName(texts[1]).select("r", "label", "text").coalesce(1)
    found = sample.mapInArrow(train, "model binary").first()
    if found is None:  # an empty sample may have no task at all
        model = SubwordSoftmax(**kw)
        model.bias[0] = 10.0
        return model
    return pickle.loads(found.model)


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have no words and score under one half."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # of a size that the sample doesn't change

    def run(it):
        for b in batches(it):
            raw, at = string_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept.value.scores(raw, at))], ["doc_id", "score"])

    return identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: SubwordSoftmax, *, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """docs without the rows that score ``cut`` or more; all columns stay."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda: lambda raw, at: kept.value.scores(raw, at) < cut)


def op4_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
