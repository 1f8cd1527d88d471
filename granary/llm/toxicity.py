"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import compress, decompress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, released, rows_of, table

#: Hashed features.
BITS = 20
BUCKETS = 1 << BITS
#: Bound of the labelled rows that are trained on: the confirmed toxic documents with the least seeded hash of their id. Unlabelled documents have no bound.
SAMPLE = 4_000
#: Unlabelled documents that a model is fitted to at once; the models of all such chunks are averaged.
CHUNK, LEAST_CHUNK = 4_096, 1_024
#: A chunk of long documents ends where it has so many features.
FEATURES = 1 << 24
EPOCHS, BATCHES, STEP, L2, SEED = 24, 8, 0.1, 1e-5, 17
#: A feature is kept if its shares among toxic and unlabelled documents differ by Z standard errors or more, and LEAST documents have it.
Z, LEAST = 5.0, 2
#: Share of toxic documents where no document is labelled as clean.
PRIOR = 0.1
#: Buckets of the rows of a model's table that aren't weights.
BIAS, CUT = -1, -2
#: Characters whose features are made together, to the next character that isn't a letter.
PART = 1 << 20
#: Texts that Python takes from an Arrow batch at once.
WIDTH = 256

_OTHER = re.compile(r"[\W\d_]")
_letters: list[np.ndarray] = []
_table: list[np.ndarray] = []
_ODD = 0x9E3779B1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^32."""
    if not _table or len(_table[0]) < n:
        size = max(n, 1 << 14)
        _table[:] = [np.cumprod(np.r_[1, np.full(size - 1, x)].astype(np.uint32), dtype=np.uint32) for x in (_ODD, pow(_ODD, -1, 1 << 32))]
    return _table[0][:n], _table[1][:n]


def _letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    if not len(points) or points.max() < 1 << 16:
        return _letters[0][points]
    out = _letters[0][np.minimum(points, (1 << 16) - 1)]
    for at in np.flatnonzero(points >= 1 << 16).tolist():
        out[at] = chr(int(points[at])).isalpha()
    return out


def _buckets(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    x = np.zeros(len(points) + 4, dtype=np.uint32)
    x[1:-3] = points * _letter(points)
    letter = x != 0
    bounds = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, stops = bounds[::2], bounds[1::2]
    up, down = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, dtype=np.uint32)
    np.cumsum(x * up[:-1], dtype=np.uint32, out=sums[1:])
    words = (sums[stops] - sums[starts]) * down[starts] + np.uint32(1)
    # x[i : i + 4] and x[i : i + 5], if all but their ends are letters
    n = len(x) - 4
    two = x[1 : n + 2] * np.uint32(_ODD) + x[2 : n + 3]
    both = letter[1 : n + 1] & letter[2 : n + 2]
    four = (x[:n] * np.uint32(0x85EBCA77) + two[:n]) * np.uint32(0xC2B2AE3D) + x[3 : n + 3]
    five = four * np.uint32(0x27D4EB2F) + x[4 : n + 4] + np.uint32(7)
    h = np.concatenate([words, four[both], five[both & letter[3 : n + 3]]])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Buckets, in order, of the features that a text has: each word in lower case, and its 4- and 5-letter parts with its edges marked."""
    text, parts = (text or "").lower(), []
    while len(text) > PART and (cut := _OTHER.search(text, PART)):
        parts.append(_buckets(text[: cut.start()]))
        text = text[cut.start() :]
    parts.append(_buckets(text))
    b = np.concatenate(parts)
    b.sort()
    return b[np.r_[True, b[1:] != b[:-1]]] if len(b) else b


def packed(f: np.ndarray) -> bytes:
    """Buckets in order as compressed gaps, low bytes first."""
    gaps = np.diff(f, prepend=np.int32(0)).astype("<u4")
    return compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(decompress(b), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64).astype(np.int32)


def informative(P: list[np.ndarray], U: list[np.ndarray]) -> np.ndarray:
    """Buckets of the features to keep: those that speak for toxicity, and those that speak against it."""
    if not P or not U:
        return np.zeros(0, dtype=np.int64)
    counts = []
    for docs in (P, U):
        n = np.zeros(BUCKETS, dtype=np.int32)
        for f in docs:  # document by document, as all in one array are large; each has a feature once
            n[f] += 1
        counts.append(n)
    some = np.flatnonzero((counts[0] >= LEAST) | (counts[1] >= LEAST))
    nP, nU = (n[some].astype(np.int64) for n in counts)
    p, u, both = nP / len(P), nU / len(U), (nP + nU) / (len(P) + len(U))
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / len(P) + 1 / len(U)))
    return some[(np.abs(p - u) >= Z * error) & (np.where(p > u, nP, nU) >= LEAST)]


def _csr(docs: list[np.ndarray], kept: np.ndarray) -> list[np.ndarray]:
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    out = []
    for f in docs:
        k = place[f]
        out.append(k[k >= 0])
    return out


def margins(docs: list[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    """Sum of the weights of a document's kept features over the square root of their number, and the bias."""
    return np.array([w[f].sum() / max(1, len(f)) ** 0.5 + b for f in docs])


def fit_nnpu(P: list[np.ndarray], U: list[np.ndarray], size: int, prior: float, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk estimate.

    With the logistic loss l(z) = log(1 + e^-z) the risk is
    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]): unlabelled
    documents count as clean, less the share of toxic ones among them. Where the
    bracket falls below zero in a batch, the step climbs out of it instead.
    Weights have either sign.
    """
    rng = np.random.default_rng(seed)
    w, b, g2, gb2 = np.zeros(size), 0.0, np.full(size, 1e-6), 1e-6
    softplus = lambda z: np.logaddexp(0, z)
    for _ in range(EPOCHS):
        order = [rng.permutation(len(x)) for x in (P, U)]
        for k in range(BATCHES):
            part = []
            for docs, o in zip((P, U), order):
                chosen = [docs[i] for i in o[k::BATCHES]]
                n = np.array([len(f) for f in chosen], dtype=np.int64)
                row, col = np.repeat(np.arange(len(chosen)), n), np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                scale = 1 / np.sqrt(np.maximum(n, 1))
                z = np.bincount(row, weights=w[col], minlength=len(chosen)) * scale + b
                part.append((row, col, scale, z, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            (rp, cp, sp, zp, yp), (ru, cu, su, zu, yu) = part
            if not len(zp) or not len(zu):
                continue
            bracket = softplus(zu).mean() - prior * softplus(zp).mean()
            toxic, clean_p, clean_u = -(1 - yp) * prior / len(zp), -yp * prior / len(zp), yu / len(zu)
            dp, du = (toxic + clean_p, clean_u) if bracket >= 0 else (-clean_p, -clean_u)
            g = np.bincount(cp, weights=(dp * sp)[rp], minlength=size) + np.bincount(cu, weights=(du * su)[ru], minlength=size) + L2 * w
            gb = dp.sum() + du.sum()
            g2 += g * g
            gb2 += gb * gb
            w = w - STEP * g / np.sqrt(g2)
            b -= STEP * gb / np.sqrt(gb2)
    return w, b


def choose_cut(zp: np.ndarray, zu: np.ndarray, count: np.ndarray | None = None, prior: float = PRIOR) -> float:
    """The cut with the largest prior * recall / (share of unlabelled documents above it + prior), which is half the F1 of toxic documents and needs no clean labels. zu[i] is the margin of count[i] documents."""
    count = np.ones(len(zu)) if count is None else count
    order = np.unique(np.concatenate([zp, zu]))
    if len(order) < 2:
        return float(order[0]) + 1.0 if len(order) else 0.0
    cuts = (order[1:] + order[:-1]) / 2
    sp, at = np.sort(zp), np.argsort(zu)
    upto = np.concatenate([[0.0], np.cumsum(count[at])])
    recall = 1 - np.searchsorted(sp, cuts) / len(sp)
    share = 1 - upto[np.searchsorted(zu[at], cuts)] / max(upto[-1], 1.0)
    return float(cuts[np.argmax(recall / (share + prior))])


def fit_folds(P: list[np.ndarray], U: list[np.ndarray], prior: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(kept buckets, weights, bias) of two models, each fitted to every other document of both classes; where a class has one document, both are fitted to it."""
    out = []
    for fold in (0, 1):
        p, u = (x[fold::2] if len(x) > 1 else x for x in (P, U))
        kept = informative(p, u)
        out.append((kept, *fit_nnpu(_csr(p, kept), _csr(u, kept), len(kept), prior)))
    return out


class Model:
    """Mean weights of the two folds. A feature that fewer than half the models kept, by their documents, isn't one."""

    def __init__(self, folds: list[dict[int, float]], cut: float = 0.0):
        self.cut = cut
        self.weight = [np.zeros(BUCKETS, dtype=np.float32) for _ in folds]
        self.kept = [np.zeros(BUCKETS, dtype=bool) for _ in folds]
        self.bias = [f.get(BIAS, -1.0) for f in folds]
        for w, k, f in zip(self.weight, self.kept, folds):
            at = np.array([b for b in f if b >= 0], dtype=np.int64)
            w[at], k[at] = [f[b] for b in at.tolist()], True

    def table(self) -> list[dict[int, float]]:
        """What a model is made from."""
        return [{int(b): float(w[b]) for b in np.flatnonzero(k)} | {BIAS: b0} for w, k, b0 in zip(self.weight, self.kept, self.bias)]

    def margins(self, f: np.ndarray) -> list[float]:
        return [float(w[f].sum()) / max(1, int(k[f].sum())) ** 0.5 + b for w, k, b in zip(self.weight, self.kept, self.bias)]

    def informed(self, f: np.ndarray) -> bool:
        """Whether a text has any feature that speaks for toxicity."""
        return any(bool((w[f] > 0).any()) for w in self.weight)

    def score(self, text: str | None) -> float:
        """The mean margin less the cut: toxic from 0 on, which no text without a feature that speaks for it reaches."""
        f = features(text)
        m = sum(self.margins(f)) / len(self.bias) - self.cut
        return m if m < 0 or self.informed(f) else -1e-6


def _order(df: DataFrame, id_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), df[id_col].cast("string"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, label_id_col: str = "doc_id") -> Model | None:
    """The model, or none where no document is confirmed as toxic.

    At most ``sample`` confirmed toxic documents are trained on, the bound
    counting rows; the prior is the share of toxic among the labelled. All
    documents count as unlabelled: each partition fits a pair of models to every
    CHUNK of its documents, and the mean over all chunks is the model
    (parameter mixing). The driver gets the features of the sample and the kept
    weights, neither of which grows with the documents. The cut is chosen from
    the margins of all documents under both folds, in steps of a thousandth, and
    those of the sample under the fold that wasn't fitted to them.
    """
    spark = docs.sparkSession
    marks = labels.select(labels[label_id_col].alias("i"), labels["toxic"].cast("int").alias("toxic")).where("i IS NOT NULL AND toxic IS NOT NULL").groupBy("i").agg(F.max("toxic").alias("toxic"))
    n = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not n["k"]:
        return None
    prior = n["k"] / n["n"] if n["k"] < n["n"] else PRIOR
    d = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))
    # the ids of the sample first, then their texts: at most ``sample`` ids go to the texts, not the texts to them
    there = d.select("i").join(marks.where("toxic = 1").select("i"), "i", "left_semi").distinct()
    chosen = there.withColumn("h", _order(there, "i")).orderBy("h", "i").limit(sample).select("i")
    made = F.pandas_udf(lambda ts: pd.Series([packed(features(t)) for t in ts]), "binary")
    rows = d.join(F.broadcast(chosen), "i", "left_semi").select(_order(d, "i").alias("h"), made("t").alias("f")).orderBy("h", "f").limit(sample).collect()
    positive = [unpacked(r["f"]) for r in rows]
    if not positive:
        return None
    # what fewer than LEAST of them have can't speak for toxicity
    count = np.bincount(np.concatenate(positive), minlength=BUCKETS)
    shared = spark.sparkContext.broadcast([f[count[f] >= LEAST] for f in positive])

    def learn(batches):
        total = [{}, {}]
        held, chunk = 0, []

        def close(chunk):
            for sums, (kept, w, b) in zip(total, fit_folds(shared.value, chunk, prior)):
                for k, v in zip([*kept.tolist(), BIAS], [*w.tolist(), b]):
                    s = sums.setdefault(k, [0.0, 0])
                    s[0] += v * len(chunk)
                    s[1] += len(chunk)

        for f in rows_of(batches, WIDTH):
            for t in f.column("t").to_pylist():
                chunk.append(features(t))
                held += len(chunk[-1])
                # the last chunk has as many documents as others, or more
                if len(chunk) >= 2 * CHUNK or held >= FEATURES:
                    close(chunk[:CHUNK])
                    chunk = chunk[CHUNK:]
                    held = sum(map(len, chunk))
        if chunk:
            close(chunk)
        rows = [(fold, k, v, c) for fold in (0, 1) for k, (v, c) in total[fold].items()]
        fold, bucket, v, c = zip(*rows) if rows else ((),) * 4
        yield pa.record_batch({"fold": pa.array(fold, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "v": pa.array(v, pa.float64()), "c": pa.array(c, pa.int64())})

    d = docs.select(docs[text_col].cast("string").alias("t")).where("t IS NOT NULL")
    # partitions of very few documents are put together to fit to; no further than that, as documents may be long
    summed = d.coalesce(max(1, docs.count() // LEAST_CHUNK)).mapInArrow(released(learn), "fold int, bucket int, v double, c long").groupBy("fold", "bucket").agg(F.sum("v").alias("v"), F.sum("c").alias("c")).collect()
    folds: list[dict[int, float]] = [{}, {}]
    docs_seen = max([r["c"] for r in summed], default=0)
    for r in sorted(summed, key=lambda r: (r["fold"], r["bucket"])):
        if 2 * r["c"] >= docs_seen:
            folds[r["fold"]][r["bucket"]] = round(r["v"] / docs_seen, 9)
    model = Model(folds)
    if not summed:
        return None
    described = model.table()

    def spread(batches):
        m = Model(described)
        for f in rows_of(batches, WIDTH):
            z, c = np.unique(np.round([x for t in f.column("t").to_pylist() for x in m.margins(features(t))], 3), return_counts=True)
            yield pa.record_batch({"z": z, "c": c})

    found = d.mapInArrow(released(spread), "z double, c long").groupBy("z").agg(F.sum("c").alias("c")).collect()
    z, c = np.array([r["z"] for r in found]), np.array([r["c"] for r in found], dtype=np.float64)
    zp = np.array([model.margins(f)[1 - i % 2] for i, f in enumerate(positive)])
    model.cut = choose_cut(zp, z, c, prior)
    return model


def score_column(text: Column, model: Model) -> Column:
    folds, cut = model.table(), model.cut

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            m = Model(folds, cut)
            for texts in batches:
                yield pa.array([m.score(t) for at in range(0, len(texts), WIDTH) for t in texts.slice(at, WIDTH).to_pylist()], pa.float64())
            del m
        finally:
            give_back()

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, label_id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``score`` (toxic from 0 on) and ``toxic`` (0 or 1).

    Null and empty texts have no feature and are clean; a text of any length is
    read whole. Rows with a null id are scored like others; labels may be null,
    repeated (the worst counts) or missing, and without any toxic one everything
    is clean, at a score of -1. Repeated rows give repeated rows, an empty table
    none; columns other than the id and the text are ignored.
    """
    model = fit(docs, labels, id_col, text_col, sample, label_id_col)
    score = F.lit(-1.0) if model is None else score_column(docs[text_col].cast("string"), model)
    scored = docs.select(docs[id_col].alias(id_col), score.alias("score"))
    return scored.select(id_col, F.round("score", 6).alias("score"), (F.col("score") >= 0).cast("int").alias("toxic"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, label_id_col: str = "doc_id") -> DataFrame:
    """The documents that aren't toxic, all columns as they are."""
    model = fit(docs, labels, id_col, text_col, sample, label_id_col)
    return docs if model is None else docs.where(score_column(docs[text_col].cast("string"), model) < 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
