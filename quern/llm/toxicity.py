"""Toxicity of documents: a recurrent network over all overlapping windows of words.

A word is a run of letters, digits and underscores, or a run of other signs but white space; runs of more than 24 characters are
cut into steps of 24, so every character is read. Windows are 64 words long, each begins 48 words after the one
before, the last one ends with the text: neighbours overlap in 16 words at least, and every word is covered.

Training is bounded in rows: at most ``POSITIVE`` toxic and ``NEGATIVE`` other labelled documents, the first by
a hash of their id, all windows of each; it runs on the driver. The number of passes over them falls as their windows
become more. Scoring covers every window of every text. A document's score is logistic in the mean window probability and
the largest window logit, fitted on a quarter of the sample that the network does not train on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices, table
from .gru import HIDDEN, STEPS, STRIDE, WORD_CHARS, Network, Trainer

POSITIVE, NEGATIVE = 1500, 3000
#: Passes over the sample: so many windows in all, within these bounds.
WINDOWS_TRAINED, LEAST_EPOCHS, MOST_EPOCHS, BATCH = 50_000, 2, 16, 256
#: All windows of a document together weigh as much as so many, so that long documents don't rule the training.
DOC_WINDOWS = 4
THRESHOLD = 0.3
KNOWN_WORDS = 100_000
find_words = re.compile(rf"\w{{1,{WORD_CHARS}}}|[^\w\s]{{1,{WORD_CHARS}}}").findall


def words_of(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


def starts(n: int) -> list[int]:
    """Starts of the windows over n words; one empty window over none."""
    return [0] if n <= STEPS else [*range(0, n - STEPS, STRIDE), n - STEPS]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> tuple[list[list[list[str]]], np.ndarray, np.ndarray]:
    """Windows (lists of words) of the sampled documents, their labels, and the rows that each stands for.

    Held-out rows are left out. A document that has both labels counts as toxic; of rows that repeat an id the least text is
    read. The last are counted over all other labelled rows, so that the fit keeps
    the corpus's share of toxic documents whatever the sample's.
    """
    ship(docs.sparkSession)
    labelled = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = labelled.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = usable.where("toxic = 1").orderBy(order, "doc_id").limit(positive).union(usable.where("toxic = 0").orderBy(order, "doc_id").limit(negative))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # a row for each of the documents chosen above
    found.sort(key=lambda r: r.doc_id)
    label = np.array([r.toxic for r in found], dtype=np.float32)
    total = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    stands = np.array([total[int(y)] / (label == y).sum() for y in label])
    words = (words_of(r.text) for r in found)
    return [[w[a : a + STEPS] for a in starts(len(w))] for w in words], label, stands


def _pad(windows: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.full((len(windows), STEPS), pad, dtype=np.int64)
    length = np.array([len(w) for w in windows])
    for i, w in enumerate(windows):
        rows[i, : len(w)] = w
    return rows, length


class Scorer:
    """Network and the logistic over a document's windows; ``score`` takes lists of words."""

    def __init__(self, net: Network, fit: np.ndarray):
        self.net, self.fit = net, fit
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)  # row 0 pads

    def __getstate__(self):
        return self.net.w, self.fit

    def __setstate__(self, state):
        self.net = Network.__new__(Network)
        self.net.w, self.fit = state
        self.clear()

    def _learn(self, texts: list[list[str]]) -> None:
        new = sorted({w for words in texts for w in words if w not in self.row}, key=len)
        if len(self.row) + len(new) > KNOWN_WORDS:
            self.clear()
            new = sorted({w for words in texts for w in words}, key=len)
        first = len(self.row) + 1
        if first + len(new) > len(self.gates):
            self.gates = np.resize(self.gates, (max(2 * len(self.gates), first + len(new)), 6 * HIDDEN))
        for k in range(0, len(new), 4096):
            self.gates[first + k : first + k + len(new[k : k + 4096])] = self.net.inputs(new[k : k + 4096])
        self.row.update(zip(new, range(first, first + len(new)), strict=True))

    def logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(logit of every window, number of windows of each text)."""
        self._learn(texts)
        sizes = np.array([len(t) for t in texts])
        row = self.row
        flat = np.fromiter(map(row.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        flat = np.concatenate([flat, np.zeros(STEPS, np.int64)])
        begin = np.cumsum(sizes) - sizes
        at = [starts(int(n)) for n in sizes]
        counts = np.array([len(a) for a in at])
        start = np.concatenate([np.array(a) for a in at]) if texts else np.zeros(0, int)
        text_of = np.repeat(np.arange(len(texts)), counts)
        length = np.minimum(STEPS, sizes[text_of] - start)
        place = (begin[text_of] + start)[:, None] + np.arange(STEPS)
        rows = np.where(np.arange(STEPS) < length[:, None], flat[np.minimum(place, len(flat) - 1)], 0)
        order = np.argsort(-length, kind="stable")  # windows of like length together
        logit = np.empty(len(rows), np.float32)
        half = self.gates[:, : 3 * HIDDEN].copy(), self.gates[:, 3 * HIDDEN :].copy()
        for k in range(0, len(rows), 1024):
            part = order[k : k + 1024]
            logit[part] = self.net.forward(half, rows[part], length[part])
        return logit, counts

    @staticmethod
    def features(logit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = np.cumsum(counts) - counts
        p = 1 / (1 + np.exp(-logit.astype(np.float64)))
        mean = np.add.reduceat(p, first) / counts
        most = np.maximum.reduceat(logit.astype(np.float64), first)
        return np.stack([np.ones(len(counts)), mean * 6 - 3, most], 1)

    def score(self, texts: list[list[str]]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.features(*self.logits(texts)) @ self.fit, -30, 30)))


def train(windows: list[list[list[str]]], label: np.ndarray, stands: np.ndarray, seed: int = 7) -> Scorer:
    """The same sample gives the same scorer. Without both labels in the sample the score is its share of ones."""
    net = Network(seed)
    if len(label) == 0 or label.min() == label.max():
        share = float(((stands * label).sum() + 0.05) / (stands.sum() + 1))
        return Scorer(net, np.array([np.log(share / (1 - share)), 0, 0]))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded = [[[vocabulary.setdefault(w, len(vocabulary)) for w in window] for window in doc] for doc in windows]
    # The logistic is fitted on documents that the network hasn't seen, where there are enough.
    apart = np.arange(len(label)) % 4 == 3
    if min(label[apart].sum(), (1 - label[apart]).sum()) < 100:
        apart, learn = np.ones(len(label), bool), np.ones(len(label), bool)
    else:
        learn = ~apart
    names = list(vocabulary)
    trainer = Trainer(net)
    share = np.array([min(1.0, DOC_WINDOWS / max(1, len(doc))) for doc in coded])
    every = [(d, k) for d, doc in enumerate(coded) if learn[d] for k in range(len(doc))]
    epochs = min(MOST_EPOCHS, max(LEAST_EPOCHS, WINDOWS_TRAINED // len(every)))
    for epoch in range(epochs):
        rng.shuffle(every)
        for at in range(0, len(every), BATCH):
            trainer.rate = 0.01 * (1 - (epoch + at / len(every)) / epochs) + 0.001
            part = every[at : at + BATCH]
            distinct, local = np.unique(np.concatenate([np.array(coded[d][k], dtype=np.int64) for d, k in part]), return_inverse=True)
            if not len(distinct):
                continue
            cuts = np.cumsum([len(coded[d][k]) for d, k in part])[:-1]
            rows, length = _pad([x.tolist() for x in np.split(local, cuts)], len(distinct))
            y = label[[d for d, _ in part]]
            weight = np.where(y == 1, 2.0, 1.0) * share[[d for d, _ in part]]
            weight = (weight / weight.sum()).astype(np.float32)
            trainer.step([names[i] for i in distinct], rows, length, y, weight)
    scorer = Scorer(net, np.zeros(3))
    features = scorer.features(*_window_logits(scorer, [w for w, a in zip(windows, apart, strict=True) if a]))
    scorer.fit = logistic(features, label[apart].astype(float), stands[apart] / stands[apart].mean())
    scorer.clear()
    return scorer


def _window_logits(scorer: Scorer, windows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    flat = [w for doc in windows for w in doc]
    logit = np.concatenate([scorer.logits(flat[k : k + 4096])[0] for k in range(0, len(flat), 4096)])
    return logit, np.array([len(doc) for doc in windows])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a weighted ridge logistic."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), grad)
        b -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return b


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and score (0 to 1) for each row.

    Null and empty texts have one window without words and a score as any other. Rows are independent,
    so ties, repeated rows, null ids and extra columns don't matter; a column named score is replaced.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c != "score"]
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("score"))
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        for batch in (part for whole in batches for part in slices(whole, "score", 1_000_000)):
            found = scorer.score([words_of(t) for t in batch.column("score").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(*sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, scorer, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; columns unchanged."""
    scorer = train(*sample(docs, table(spark, sf_dir, "labels")))
    names = docs.columns
    return score(docs, scorer, keep=names).where(F.col("score") < THRESHOLD).select(*names)
