"""Operator 10: quality classifier by co-training.

Two classifiers see different sides of a document: its text (shares of kinds of
characters, on a logarithmic scale, repetition, hashed words) and its metadata (language, source,
length). Over some rounds each labels the unlabelled documents that it is sure
about for the other. Both are then weighed by a logistic model of their scores on
labelled documents that neither was fitted on, and all documents are scored.

Fitting starts from a bounded sample of labelled documents, those of least hash. In
every round both views score all other documents, whole, and the surest of the corpus
become pseudo-labels: a task sends on as many as a round may use, the rest stays there.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back, stage, text_of, unstage
from .tokens import text_blocks

BUCKETS = 256
KINDS = ("space", "feed", "upper", "lower", "digit", "stop", "symbol", "bang", "bar", "mark", "wide")
DENSE = len(KINDS) + 4
LANGS, SOURCES, LENGTHS = 32, 128, 24


@dataclass(frozen=True)
class Fit:
    """Most documents of the labelled sample; rounds; least confidence of a pseudo-label; most
    pseudo-labels a round and view; ridge; share of labelled documents kept for calibration
    (one in ``hold``); least score that keeps a document."""

    labelled: int = 6000
    rounds: int = 3
    sure: float = 0.97
    each: int = 600
    ridge: float = 1.0
    hold: int = 4
    keep: float = 0.5


def _kinds() -> np.ndarray:
    table = np.full(256, KINDS.index("mark"), np.int64)
    ranges = {"upper": (65, 91), "lower": (97, 123), "digit": (48, 58), "wide": (128, 256)}
    for kind, (low, high) in ranges.items():
        table[low:high] = KINDS.index(kind)
    for kind, characters in {"space": b" \t\x0b\x0c\r", "feed": b"\n", "stop": b".,;:?'\"()-", "symbol": b"#*$%&<>@^~", "bang": b"!", "bar": b"|"}.items():
        table[list(characters)] = KINDS.index(kind)
    return table


_KIND = _kinds()
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)


def text_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row a text, of UTF-8 texts one after the other: ``DENSE`` statistics and ``BUCKETS`` word shares."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    which = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(which * len(KINDS) + _KIND[data], minlength=n * len(KINDS)).reshape(n, -1)
    gap = _SPACE[data]
    first = ~gap & np.r_[True, gap[:-1]][: len(gap)]
    inner = bounds[:-1][(sizes > 0)]
    first[inner] = ~gap[inner]
    starts = np.flatnonzero(first)
    # Hash of a word: a sum of mixed bytes and places in it; good enough for shares and distinct counts.
    place = np.arange(len(data)) - np.maximum.accumulate(np.where(first, np.arange(len(data)), 0))
    mixed = (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _ODD
    mixed = np.where(gap, np.uint64(0), mixed ^ (mixed >> np.uint64(29)))
    word = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, np.uint64)
    word = (word ^ (word >> np.uint64(31))) * _ODD
    owner = which[starts]
    n_words = np.bincount(owner, minlength=n)
    buckets = np.bincount(owner * BUCKETS + (word >> np.uint64(56)).astype(np.int64), minlength=n * BUCKETS).reshape(n, -1)
    order = np.lexsort((word, owner))
    w, o = word[order], owner[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])][: len(w)]
    distinct = np.bincount(o[new], minlength=n)
    per_byte, per_word = np.maximum(sizes, 1)[:, None], np.maximum(n_words, 1)
    dense = np.column_stack([np.log1p(100 * kinds / per_byte), sizes / per_word / 10, distinct / per_word, np.log1p(n_words), n_words < 10])
    return np.hstack([dense, buckets / per_word[:, None]]).astype(np.float32)


def metadata_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """One row a document: language, source and length, each as hashed or binned indicators."""
    n = len(lang)
    out = np.zeros((n, LANGS + SOURCES + LENGTHS), np.float32)
    slot = lambda value, size: zlib.crc32(repr(value).encode()) % size
    out[np.arange(n), [slot(x, LANGS) for x in lang]] = 1
    out[np.arange(n), [LANGS + slot(x, SOURCES) for x in source]] = 1
    out[np.arange(n), [LANGS + SOURCES + (0 if x is None or x < 1 else min(LENGTHS - 1, 1 + int(np.log2(x)))) for x in n_chars]] = 1
    return out


@dataclass
class Linear:
    """A logistic model on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float64) @ self.weights + self.bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> Linear:
        """Ridge-penalised likelihood by Newton's steps, halved while they overshoot.

        Columns of little spread, such as single words, are not blown up to unit
        scale, so the penalty holds them down unless many documents speak for them.
        """
        mean, scale = x.mean(0), np.maximum(x.std(0), 0.1)
        z = np.hstack([((x - mean) / scale).astype(np.float64), np.ones((len(x), 1))])
        penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
        w = np.zeros(z.shape[1])
        loss = lambda w: np.logaddexp(0, np.where(y > 0.5, -1, 1) * (z @ w)).sum() + (penalty * w * w).sum() / 2
        now = loss(w)
        for _ in range(steps):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
            size = 1.0
            while size > 1e-4 and (then := loss(w - size * step)) > now:
                size /= 2
            if size <= 1e-4 or now - then < 1e-6 * max(1.0, now):
                break
            w, now = w - size * step, then
        return cls(mean, scale, w[:-1], float(w[-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Both views, and the weights of their scores."""

    text: Linear
    metadata: Linear
    both: Linear

    def probability(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return sigmoid(self.both.score(np.column_stack([self.text.score(text), self.metadata.score(metadata)])))


#: Teaching view, label, document and how sure the view is.
SURE = "view int, label int, doc_id long, sure double"


def surest(models: tuple[Linear, Linear], views: tuple[np.ndarray, np.ndarray], ids: np.ndarray, taught: tuple[np.ndarray, np.ndarray], fit: Fit) -> list[tuple]:
    """Rows of ``SURE``: per view and label the surest documents, ``fit.each`` at most, ties to the smaller id.

    ``taught``: for each view, ids that it is not to name (those that the other view has learnt already).
    """
    out = []
    for v in (0, 1):
        p = np.round(sigmoid(models[v].score(views[v])), 9)  # the last digits depend on the size of a batch
        free = ~np.isin(ids, taught[v])
        for label, sure in ((1, p), (0, 1 - p)):
            some = np.flatnonzero(free & (sure >= fit.sure))
            some = some[np.lexsort((ids[some], -sure[some]))][: fit.each]
            out += [(v, label, int(ids[i]), float(sure[i])) for i in some]
    return out


def co_train(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, fit: Fit, find) -> Model | None:
    """Model from the features of both views of labelled rows (``labels``: 0 or 1).

    ``find(models, taught)`` returns, for documents that are not among these rows, rows of
    ``SURE``, surest first, and the features of both views by id. None if the labelled rows do
    not show both classes, in and out of the held part.
    """
    held = np.arange(len(labels)) % fit.hold == 0
    if any(len(np.unique(labels[x])) < 2 for x in (held, ~held)):
        return None
    x = [view[~held] for view in views]
    y = [labels[~held].astype(float)] * 2
    share = y[0].mean()
    taught = [np.zeros(0, np.int64)] * 2
    fitted = lambda: tuple(Linear.fit(x[v], y[v], fit.ridge) for v in (0, 1))
    models = fitted()
    for _ in range(fit.rounds):
        rows, features = find(models, tuple(taught))
        for v in (0, 1):  # each view teaches the other
            most = {1: round(fit.each * share), 0: round(fit.each * (1 - share))}
            picked = [(label, doc_id) for label in (1, 0) for doc_id in [r[2] for r in rows if r[:2] == (v, label)][: most[label]]]
            if picked:
                x[1 - v] = np.vstack([x[1 - v], [features[doc_id][1 - v] for _, doc_id in picked]])
                y[1 - v] = np.r_[y[1 - v], [float(label) for label, _ in picked]]
                taught[v] = np.r_[taught[v], [doc_id for _, doc_id in picked]]
        models = fitted()
    scores = np.column_stack([models[v].score(views[v][held]) for v in (0, 1)])
    return Model(*models, Linear.fit(scores, labels[held].astype(float), fit.ridge))


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, offset=int(bounds[0])) if size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _features(texts: pa.Array) -> np.ndarray:
    """Of a column of binary texts, a block at a time."""
    if not len(texts):
        return np.zeros((0, DENSE + BUCKETS), np.float32)
    batch = pa.record_batch([pa.nulls(len(texts)), texts], names=["k", "t"])
    return np.vstack([text_features(*_offsets(t)) for _, t in text_blocks([batch], 1 << 17)])


def _described(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang, source, n_chars``; ids null or not, texts never."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def _views_of(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text features and metadata features of the documents in ``ids`` (one column, a bounded number of rows).

    Rows that share an id count as one, that of the least features.
    """

    def run(batches):
        for batch in batches:
            x = _features(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[2:]], names=["doc_id", "x", "lang", "source", "n_chars"])

    rows = _described(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang", "source", "n_chars")
    rows = rows.mapInArrow(frugal(run), "doc_id long, x binary, lang string, source string, n_chars long")
    found = rows.groupBy("doc_id").agg(F.min(F.struct("x", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*").toArrow().to_pydict()
    text = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, DENSE + BUCKETS)
    return np.asarray(found["doc_id"], np.int64), text, metadata_features(found["lang"], found["source"], found["n_chars"])


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model | None:
    """Model fitted on a bounded sample of ``labels`` (``doc_id, quality``) and on all of ``docs``.

    Ids that carry several labels count as their majority, ties as good; null
    labels and ids do not count. Rows that share an id count as one.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.join(ids.distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(10), "doc_id"), "doc_id").limit(fit.labelled)
    label = {r["doc_id"]: r["label"] for r in known.collect()}  # fit.labelled rows at most
    if len(set(label.values())) < 2:
        return None
    frame = lambda some: spark.createDataFrame([(int(i),) for i in some], "doc_id long")
    own, text, metadata = _views_of(docs, frame(label))
    # By hash, so that the held part is no function of the ids' order.
    order = np.asarray(sorted(range(len(own)), key=lambda i: (zlib.crc32(str(own[i]).encode()), own[i])))
    own, text, metadata = own[order], text[order], metadata[order]

    def find(models, taught):
        barred = tuple(np.r_[own, t] for t in taught)

        def run(batches):
            best: list[tuple] = []
            for batch in batches:
                batch = batch.filter(batch.column(0).is_valid())
                if not len(batch):
                    continue
                views = _features(batch.column(1)), metadata_features(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
                best += surest(models, views, np.asarray(batch.column(0)), barred, fit)
                if len(best) > 8 * fit.each:
                    best = _best(best, fit.each)
            for k in range(0, len(best := _best(best, fit.each)), 10_000):
                some = best[k : k + 10_000]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*some), (pa.int32(), pa.int32(), pa.int64(), pa.float64()))], names=["view", "label", "doc_id", "sure"])

        each = _described(docs).mapInArrow(frugal(run), SURE).groupBy("view", "label", "doc_id").agg(F.max("sure").alias("sure"))
        each = stage(each, "co-training")
        rows = []
        for view in (0, 1):
            for value in (1, 0):  # fit.each rows at most
                rows += [tuple(r) for r in each.filter((F.col("view") == view) & (F.col("label") == value)).orderBy(F.desc("sure"), "doc_id").limit(fit.each).collect()]
        unstage(each)
        picked = sorted({r[2] for r in rows})
        if not picked:
            return [], {}
        ids, *both = _views_of(docs, frame(picked))
        return rows, {int(i): (a, b) for i, a, b in zip(ids, *both)}

    return co_train((text, metadata), np.asarray([label[int(i)] for i in own], np.int64), fit, find)


def _best(rows: list[tuple], each: int) -> list[tuple]:
    """Of each view and label the ``each`` surest rows of ``SURE``."""
    out, counts = [], {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], -r[3], r[2])):
        counts[row[:2]] = counts.get(row[:2], 0) + 1
        if counts[row[:2]] <= each:
            out.append(row)
    return out


def score(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``kept``; columns of these names are replaced.

    Null texts are empty; texts of any length are read whole, a block at a time. Without a
    model (labels of one class or none) scores are null and every document is kept.
    Repeated rows are scored one by one; an empty table gives no rows. Other columns stay.
    """
    model = train(docs, labels, fit)
    if model is None:
        return docs.withColumn("quality_score", F.lit(None).cast("double")).withColumn("kept", F.lit(True))

    @F.arrow_udf("double")
    def probability(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        metadata = metadata_features(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())
        out = pa.array(np.round(model.probability(_features(text), metadata), 6), pa.float64())
        give_back()
        return out

    p = probability(text_of().cast("binary"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return docs.withColumn("quality_score", p).withColumn("kept", F.col("quality_score") >= fit.keep)
