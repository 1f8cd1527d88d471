"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, ROW, checkpointed, forget, new_folder, packed, released, rows_of, stored, table

#: Words in a shingle.
SHINGLE = 2
#: Weighted Jaccard similarity from which two texts are near duplicates.
THRESHOLD = 0.5
#: Bands and samples in a band: two texts of similarity s meet with probability 1 - (1 - s^ROWS)^BANDS, 0.89 at s = 0.6 and 0.99 at 0.7.
BANDS, ROWS = 16, 4
#: A shingle that fewer than one document in RARE has weighs as if one in RARE had it. Those that more have are counted one by one, and there can't be more of them than RARE times the shingles of a document, however many documents there are.
RARE = 256
#: Documents in which frequent shingles are looked for together.
TOGETHER, LEAST_TOGETHER = 4_096, 1_024
#: A group of long documents ends where it has so many shingles.
SHINGLES = 1 << 24
#: Least weight of a shingle, that of one which every document has.
FLOOR = 0.1
SEED = 6021
#: Shingles sampled together, so that memory doesn't grow with a text.
CHUNK = 2_048
#: Draws look first at what can come below this less the logarithm of a text's total weight; e^-e^HOPE of them find nothing there and look again, two further up.
HOPE = 1.3
#: Characters of short texts that are read together.
CHARACTERS = 1 << 17
#: Texts that Python takes from an Arrow batch at once.
WIDTH = 256
#: Texts whose shingles are sampled together end where they have so many.
SAMPLED = 1 << 17
#: Members of a bucket that are compared with as many others at once; a larger bucket is compared block by block.
BUCKET = 256
#: Bits of hashes that choose a quantile of r, of ln c and of beta; and of those, bits of the first hash: all of ln c and the upper ones of r.
QUANTILE_BITS, FIRST_BITS = (16, 8, 8), 16

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = 0x9E3779B97F4A7C15
_cache: dict[str, tuple] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


def _classes(points: np.ndarray) -> np.ndarray:
    """1 for white space, 2 for letters and digits, 0 for others."""
    if "classes" not in _cache:
        _cache["classes"] = (np.array([1 if chr(c).isspace() else 2 if chr(c).isalnum() else 0 for c in range(1 << 16)], dtype=np.uint8),)
    (known,) = _cache["classes"]
    if not len(points) or points.max() < 1 << 16:
        return known[points]
    out = known[np.minimum(points, (1 << 16) - 1)]
    for at in np.flatnonzero(points >= 1 << 16).tolist():
        out[at] = 2 * chr(int(points[at])).isalnum()
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" not in _cache or len(_cache["powers"][0]) < n:
        size = max(n, 1 << 13)
        with np.errstate(over="ignore"):
            _cache["powers"] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, dtype=np.uint64)]) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    up, down = _cache["powers"]
    return up[:n], down[:n]


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, what stands between white space, by their letters and digits; those without any are left out. And the places of their first letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _classes(points)
    at = np.flatnonzero(kind == 2)
    if not len(at):
        return np.zeros(0, np.uint64), at
    token = np.cumsum(kind == 1, dtype=np.int64)[at]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    up, down = _powers(len(at) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(at) + 1, dtype=np.uint64)
        np.cumsum(points[at] * up[:-1], dtype=np.uint64, out=sums[1:])
        return _mix((sums[np.r_[first[1:], len(at)]] - sums[first]) * down[first]), at[first]


def _shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    # no word goes on behind a line's end, and a final sigma is told by its own word
    h, place = _words("\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    own = np.searchsorted(ends, place, side="right").astype(np.uint64)
    count = np.bincount(own.astype(np.int64), minlength=len(texts))
    stop = np.repeat(np.cumsum(count), count)
    n = np.minimum(SHINGLE, np.repeat(count, count))
    at = np.arange(len(h))
    at = at[at + n <= stop]
    n, own = n[at], own[at]
    s = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            some = slice(None) if k == 0 or (n > k).all() else n > k
            s[some] = _mix(s[some] ^ (h[at[some] + k] + np.uint64(k)))
    s = own << np.uint64(32) | s >> np.uint64(32)
    s.sort()
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else at
    times = np.diff(np.r_[first, len(s)])
    cut = np.searchsorted(s[first] >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    s = s[first].astype(np.uint32)
    return [(s[i:j], times[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


def shingles_of(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(32-bit hashes in order, counts) of each text's shingles; a text of fewer words is one shingle, one without a word has none. Short texts are read together."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").lower())
        size += len(held[-1]) + 1
        if size >= CHARACTERS:
            yield from _shingles(held)
            held, size = [], 0
    if held:
        yield from _shingles(held)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return next(shingles_of([text]))


class Frequencies:
    """ln((N + 1) / (df + 1)) + FLOOR by shingle, N being the number of documents with a word and df at least N / RARE."""

    def __init__(self, total: int, shingle: np.ndarray, df: np.ndarray):
        least = max(1.0, total / RARE)
        often = df >= least
        order = np.argsort(shingle[often])
        self.shingle = shingle[often][order].astype(np.uint32)
        self.weight = np.log((total + 1) / (df[often][order] + 1)) + FLOOR
        self.rare = float(np.log((total + 1) / (least + 1)) + FLOOR)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.full(len(s), self.rare)
        at = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        return np.where(self.shingle[at] == s, self.weight[at], self.rare)


def weights(s: np.ndarray, count: np.ndarray, idf: Frequencies) -> np.ndarray:
    return count * idf(s)


def quantiles() -> tuple[np.ndarray, ...]:
    """Middle quantiles of r and of ln c (both from Gamma(2, 1)) and of beta (uniform)."""
    if "quantiles" not in _cache:

        def gamma(bits: int) -> np.ndarray:
            q = (np.arange(1 << bits) + 0.5) / (1 << bits)
            low, high = np.zeros(len(q)), np.full(len(q), 60.0)
            for _ in range(60):  # 1 - (1 + x) e^-x = q by halving
                x = (low + high) / 2
                below = 1 - (1 + x) * np.exp(-x) < q
                low, high = np.where(below, x, low), np.where(below, high, x)
            return (low + high) / 2

        a, b, c = QUANTILE_BITS
        beta = ((np.arange(1 << c) + 0.5) / (1 << c)).astype(np.float32)
        _cache["quantiles"] = (gamma(a).astype(np.float32), np.log(gamma(b)).astype(np.float32), beta)
    return _cache["quantiles"]


def draws() -> tuple[np.ndarray, ...]:
    """What can't be above ln a + ln w, in order, by the first hash of a shingle and draw: ln c - r for the largest r that the hash allows. Then ln c and the least place of r by that hash; seeds of it for each four draws; a multiplier and an offset of the second hash for each draw."""
    if "draws" not in _cache:
        r, lnc, _ = quantiles()
        a, b, _ = QUANTILE_BITS
        rest = a + b - FIRST_BITS
        x = np.arange(1 << FIRST_BITS)
        c, place = x >> (FIRST_BITS - b), (x & ((1 << (FIRST_BITS - b)) - 1)) << rest
        low = lnc[c] - r[place + (1 << rest) - 1] - np.float32(1e-3)
        order = np.argsort(low, kind="stable")
        rng = np.random.Generator(np.random.PCG64(SEED))
        mul, add = (rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) for _ in range(2))
        seeds = rng.integers(0, 1 << 64, BANDS * ROWS // 4, dtype=np.uint64)
        _cache["draws"] = (low[order], lnc[c][order], place[order].astype(np.uint32), seeds, mul | np.uint32(1), add)
    return _cache["draws"]


def firsts(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """FIRST_BITS bits for each shingle and draw."""
    return _mix(s.astype(np.uint64)[:, None] ^ seeds).view(np.uint16)


def chances(s: np.ndarray, lw: np.ndarray, draw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """t and ln a of shingles of log weight ``lw`` in their draws."""
    r, _, beta = quantiles()
    _, lnc, place, _, mul, add = draws()
    h = s * mul[draw] + add[draw]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    a, b, c = QUANTILE_BITS
    r, beta = r[place[first] | h & np.uint32((1 << (a + b - FIRST_BITS)) - 1)], beta[h >> np.uint32(32 - c)]
    t = np.floor(lw / r + beta)
    return t, lnc[first] - r * (t - beta + np.float32(1))


def samples_of(s: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One consistent weighted sample for each text and each of the BANDS * ROWS draws, as a hash of the shingle chosen and its level. ``start`` has the places where the texts begin, and the end; no text is empty.

    t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the
    shingle with the least a is chosen, and two sets choose alike with the
    probability of their weighted Jaccard similarity. The least a of a text is
    exponential with its total weight as rate, so most draws choose a shingle
    whose ln a is below HOPE - ln(total), and only shingles that can be there, as
    a first hash tells, are looked at. Draws that find none hope for less.
    """
    k, n = BANDS * ROWS, len(start) - 1
    low, _, _, seeds, _, _ = draws()
    lw, size = np.log(w).astype(np.float32), np.diff(start)
    text = np.repeat(np.arange(n), size)
    hope = (HOPE - np.log(np.add.reduceat(w, start[:-1]))).astype(np.float32)
    least, chosen, level = np.full(n * k, np.inf, np.float32), np.zeros(n * k, np.int64), np.zeros(n * k, np.int64)

    def below(hope):
        return np.minimum(np.searchsorted(low, hope[text] + lw, side="right"), (1 << FIRST_BITS) - 1).astype(np.uint16)

    def keep(of, a, t, row, before):
        best = np.flatnonzero((a == least[of]) & (a < before))[::-1]  # of equal ones the first stays
        chosen[of[best]], level[of[best]] = row[best], t[best]

    limit, all_a = below(hope), np.full(CHUNK * k, np.inf, np.float32)
    for at in range(0, len(s), CHUNK):
        first = firsts(s[at : at + CHUNK], seeds)
        maybe = np.flatnonzero(first <= limit[at : at + CHUNK, None])
        row, draw = at + maybe // k, maybe % k
        t, a = chances(s[row], lw[row], draw, first.ravel()[maybe])
        of = text[row] * k + draw
        before = least[of]
        all_a[maybe] = a
        i, j = text[at], text[at + len(first) - 1] + 1
        here = least[i * k : j * k].reshape(-1, k)
        np.minimum(here, np.minimum.reduceat(all_a[: first.size].reshape(-1, k), np.maximum(start[i:j] - at, 0), axis=0), out=here)
        all_a[maybe] = np.inf
        keep(of, a, t, row, before)
    while True:
        # a shingle that wasn't looked at has an ln a above the hope
        left = np.flatnonzero(least > np.repeat(hope, k))
        if not len(left):
            break
        hope = hope + np.float32(2)
        limit = below(hope)
        # pieces of one draw over up to CHUNK shingles of one text, in order
        parts = -(-size[left // k] // CHUNK)
        piece = np.repeat(left, parts)
        begin = start[piece // k] + CHUNK * (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts))
        long = np.minimum(start[piece // k + 1] - begin, CHUNK)
        group = np.cumsum(long) // (CHUNK * k)
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            m = long[i:j]
            row = np.arange(m.sum()) + np.repeat(begin[i:j] - (np.cumsum(m) - m), m)
            of = np.repeat(piece[i:j], m)
            draw = of % k
            first = (_mix(s[row].astype(np.uint64) ^ seeds[draw // 4]) >> (np.uint64(16) * (draw % 4).astype(np.uint64))).astype(np.uint16)
            maybe = np.flatnonzero(first <= limit[row])
            if not len(maybe):
                continue
            row, of = row[maybe], of[maybe]
            t, a = chances(s[row], lw[row], draw[maybe], first[maybe])
            before = least[of]
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            least[of[begins]] = np.minimum(least[of[begins]], np.minimum.reduceat(a, begins))
            keep(of, a, t, row, before)
    with np.errstate(over="ignore"):
        return _mix(s[chosen] * np.uint64(_ODD) + level.astype(np.uint64)).reshape(n, k)


def samples(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    return samples_of(s, w, np.array([0, len(s)]))[0]


def bands_of(s: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash for each text and band."""
    x = samples_of(s, w, start).reshape(-1, BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = _mix(h * np.uint64(_ODD) ^ x[:, :, k])
    return h.view(np.int64)


def bands(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    return bands_of(s, w, np.array([0, len(s)]))[0]


def blob(s: np.ndarray, count: np.ndarray) -> bytes:
    """Shingles and counts of a text: the number of those that it has more than once, all shingles, places and counts of those; 4 bytes each."""
    more = np.flatnonzero(count > 1)
    return b"".join(x.astype("<u4").tobytes() for x in (np.array([len(more)]), s, more, count[more]))


def unblob(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b, "<u4")
    m = int(x[0])
    n = len(x) - 1 - 2 * m
    count = np.ones(n, np.int64)
    count[x[1 + n : 1 + n + m]] = x[1 + n + m :]
    return x[1 : 1 + n], count


def weighted_jaccard(a: tuple, b: tuple, idf: Frequencies) -> float:
    (sa, ca), (sb, cb) = a, b
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    least = float((np.minimum(ca[ia], cb[ib]) * idf(both)).sum())
    total = float(weights(sa, ca, idf).sum() + weights(sb, cb, idf).sum())
    return least / (total - least) if total > least else float(total > 0)


def similar(features: list[tuple], labels: np.ndarray, left: np.ndarray, right: np.ndarray, idf: Frequencies, threshold: float) -> list[tuple[int, int]]:
    """Links between places in ``left`` and places in ``right``: enough of those that have the similarity to join all labels that any of them joins.

    A text is held against all others in one sum over their shingles; only what
    reaches the threshold there, or nearly, is measured on its own.
    """
    n, labels, links = len(features), np.array(labels), []
    owner = np.repeat(np.arange(n), [len(s) for s, _ in features])
    start = np.searchsorted(owner, np.arange(n + 1))
    s = np.concatenate([s for s, _ in features])
    w = np.concatenate([c for _, c in features]) * idf(s)
    known, code = np.unique(s, return_inverse=True)
    total, dense = np.bincount(owner, w, n), np.zeros(len(known))
    for a in left.tolist():
        others = right[labels[right] != labels[a]]
        if not len(others):
            continue
        at = slice(start[a], start[a + 1])
        dense[code[at]] = w[at]
        least = np.bincount(owner, np.minimum(dense[code], w), n)[others]
        dense[code[at]] = 0
        for b in others[least >= (threshold - 1e-9) * (total[a] + total[others] - least)].tolist():
            if labels[a] != labels[b] and weighted_jaccard(features[a], features[b], idf) >= threshold:
                links.append((a, b))
                labels[labels == labels[b]] = labels[a]
    return links


def featured(texts: DataFrame) -> DataFrame:
    """The other columns and f, the shingles and counts, of each text t that has a word."""
    kept = [c for c in texts.schema.fields if c.name != "t"]
    names = [c.name for c in kept]

    def describe(batches):
        for f in rows_of(batches, WIDTH):
            made = [blob(*x) if len(x[0]) else None for x in shingles_of(f.column("t").to_pylist())]
            own = f.take(pa.array([i for i, x in enumerate(made) if x is not None], pa.int64()))
            yield pa.record_batch({c: own.column(c) for c in names} | {"f": pa.array([x for x in made if x is not None], pa.binary())})

    return texts.mapInArrow(released(describe), T.StructType([*kept, T.StructField("f", T.BinaryType())]))


def inverse_frequencies(texts: DataFrame) -> Frequencies:
    return frequencies(checkpointed(featured(texts.select("t"))), texts.count())


def frequencies(features: DataFrame, rows: int) -> Frequencies:
    """Counted over all documents, in two passes: a shingle that one document in RARE has is as frequent in some TOGETHER of them, so those that are come first and are then counted exactly. The driver gets no more of them than there can be."""
    # partitions of very few documents are put together; no further than that, as documents may be long
    features = features.select("f").coalesce(max(1, rows // LEAST_TOGETHER))

    def frequent(batches):
        out, held, size = [], [], 0

        def close(some):
            s, c = np.unique(np.concatenate(some), return_counts=True)
            out.append(s[c * RARE >= len(some)])

        for f in rows_of(batches, WIDTH):
            for b in f.column("f").to_pylist():
                held.append(unblob(b)[0])
                size += len(held[-1])
                # the last group has as many documents as others, or more
                if len(held) >= 2 * TOGETHER or size >= SHINGLES:
                    n = min(TOGETHER, len(held))
                    close(held[:n])
                    held = held[n:]
                    size = sum(map(len, held))
        if held:
            close(held)
        yield pa.record_batch({"s": np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)})

    found = features.mapInArrow(released(frequent), "s long").distinct().toPandas()["s"].to_numpy()
    candidates = features.sparkSession.sparkContext.broadcast(np.sort(found).astype(np.uint32))

    def count(batches):
        known = candidates.value
        n, df = 0, np.zeros(len(known) + 1, np.int64)
        for f in rows_of(batches, WIDTH):
            n += f.num_rows
            for b in f.column("f").to_pylist():
                s, _ = unblob(b)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    df[at[known[at] == s]] += 1
        i = np.flatnonzero(df)
        yield pa.record_batch({"s": np.r_[-1, known[i].astype(np.int64)], "n": np.r_[n, df[i]]})

    rows = features.mapInArrow(released(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    inside = (rows["s"] >= 0).to_numpy()
    return Frequencies(int(rows["n"][~inside].sum()), rows["s"].to_numpy()[inside], rows["n"].to_numpy()[inside])


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each vertex's component. Labels take the least among the neighbours' and then the label's own label, so a path halves each time round; every round is cut off by files, and the files of the round before then go."""
    spark = edges.sparkSession
    where, k = new_folder(spark, "components"), 0
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{where}/edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "v"), f"{where}/0")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", "label", F.least("label", "m").alias("new"))
        jump = step.select(F.col("v").alias("u"), F.col("new").alias("lu"))
        after = stored(step.join(jump, F.col("new") == F.col("u"), "left").select("v", "label", F.least("new", "lu").alias("new")), f"{where}/{k + 1}")
        forget(spark, f"{where}/{k}")
        k += 1
        if after.where("new < label").isEmpty():
            forget(spark, f"{where}/edges")
            return after.select("v", "label")
        labels = after.select("v", F.col("new").alias("label"))


def near_pairs(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(d, v, kd, kv): id and text hash of each document whose group has more than one member, and of the one that stays.

    Exact copies share a text hash, and each distinct text is one vertex. The
    members of a band's bucket are verified against its least member first. What
    that leaves in different components is brought together by buckets, each
    text once for every BUCKET members, and compared there, one with all others
    at once. So every pair that meets in some bucket is verified or already
    linked, yet thousands of copies in a bucket cost thousands of comparisons,
    not millions, and texts that meet without being alike are never put in pairs.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].alias("d"), docs[text_col].cast("string").alias("t")).where("t IS NOT NULL AND t != ''")
    # a text is read once; all else is made from its shingles
    keyed = checkpointed(featured(texts.select("d", F.xxhash64("t").alias("v"), "t")))
    shared = spark.sparkContext.broadcast(frequencies(keyed, docs.count()))

    def sign(batches):
        for f in rows_of(batches, WIDTH):
            rows, held, size = [], [], 0
            for i, b in enumerate(f.column("f").to_pylist(), 1):
                held.append(unblob(b))
                size += len(held[-1][0])
                if size >= SAMPLED or i == f.num_rows:
                    s, c = (np.concatenate(x) for x in zip(*held))
                    rows += list(bands_of(s, weights(s, c, shared.value), np.cumsum([0, *(len(x) for x, _ in held)])))
                    held, size = [], 0
            yield pa.record_batch({"d": f.column("d"), "v": f.column("v"), "bands": pa.array(rows, pa.list_(pa.int64()))})

    schema = T.StructType([keyed.schema["d"], keyed.schema["v"], T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = checkpointed(keyed.mapInArrow(released(sign), schema))
    vertex = signed.groupBy("v").agg(F.min("d").alias("d"), F.first("bands").alias("bands"))
    bucket_ = Window.partitionBy("h")
    met = vertex.select("v", F.explode("bands").alias("h")).withColumns({"p": F.min("v").over(bucket_), "n": F.count("*").over(bucket_)}).where("n > 1").select("h", "v", "p")
    met = checkpointed(met)
    star = met.where("v != p").select("v", "p").distinct()
    wanted = met.select("v").distinct()

    where = signed.join(wanted, "v", "left_semi").groupBy("v").agg(F.min_by("d", F.struct(F.col("d").isNull(), "d")).alias("wd"))
    chosen = keyed.join(where, (keyed["v"] == where["v"]) & keyed["d"].eqNullSafe(where["wd"])).select(keyed["v"], "f")
    described = checkpointed(chosen.groupBy("v").agg(F.first("f").alias("f")))

    def measure(batches):
        for f in rows_of(batches, WIDTH):
            both = zip(f.column("fa").to_pylist(), f.column("fb").to_pylist())
            yield pa.record_batch({"a": f.column("a"), "b": f.column("b"), "s": pa.array([weighted_jaccard(unblob(x), unblob(y), shared.value) for x, y in both], pa.float64())})

    one = star.join(described.withColumnRenamed("f", "fa"), "v").select(F.col("v").alias("a"), F.col("p").alias("b"), "fa")
    two = one.join(described.select(F.col("v").alias("b"), F.col("f").alias("fb")), "b")
    first = checkpointed(two.select("a", "b", "fa", "fb").mapInArrow(released(measure), "a long, b long, s double"))
    linked = first.where(F.col("s") >= threshold).select("a", "b")
    labels = components(linked)

    def compare(batches):
        held, now = [], None

        def close():
            v, label, own, f = zip(*held)
            own = np.array(own)
            left, right = (np.flatnonzero(own == k) for k in now[1:])
            for a, b in similar([unblob(x) for x in f], np.array(label), left, right, shared.value, threshold):
                yield v[a], v[b]

        def links():
            nonlocal held, now
            for f in rows_of(batches, WIDTH):
                keys = zip(*(f.column(c).to_pylist() for c in ("h", "i", "j")))
                for key, row in zip(keys, zip(*(f.column(c).to_pylist() for c in ("v", "l", "k", "f")))):
                    if key != now:
                        if held:
                            yield from close()
                        held, now = [], key
                    held.append(row)
            if held:
                yield from close()

        found = list(dict.fromkeys(links()))
        yield pa.record_batch({c: pa.array([x[n] for x in found], pa.int64()) for n, c in enumerate("ab")})

    # what the first round left apart in some bucket; its least member has met all others
    known = met.where("v != p").join(labels, "v", "left").select("h", "v", F.coalesce("label", "v").alias("l"))
    known = known.withColumns({"lo": F.min("l").over(bucket_), "hi": F.max("l").over(bucket_)}).where("lo < hi")
    place = F.row_number().over(bucket_.orderBy("v")) - 1
    known = known.withColumns({"k": (place / BUCKET).cast("int"), "last": ((F.count("*").over(bucket_) - 1) / BUCKET).cast("int")})
    # each two blocks of a bucket are a key of their own: a large bucket isn't one task's work, nor held in memory
    apart = known.join(described, "v").withColumn("o", F.explode(F.sequence(F.lit(0), "last")))
    apart = apart.select("h", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "v", "l", "k", "f")
    second = checkpointed(apart.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(released(compare), "a long, b long"))
    if not second.isEmpty():
        labels = components(linked.union(second))
    groups = signed.select("d", "v").distinct().join(labels, "v", "left").select("d", "v", F.coalesce("label", "v").alias("g"))
    # partial sums and a join, not a window: a group of very many copies isn't one task's work
    first = F.min(F.struct(F.col("d").isNull().alias("nodoc"), "d", "v"))
    sizes = groups.groupBy("g").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    return groups.join(sizes, "g").select("d", "v", F.col("first.d").alias("kd"), F.col("first.v").alias("kv"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, kept_<id>): one row per document that repeats or nearly repeats an earlier one, with the document of its group that stays.

    Groups are the connected components of pairs with a weighted Jaccard
    similarity of ``threshold`` or more; the one with the least id (null last)
    stays. Texts of any length are compared whole, an empty table has no copies. Texts are compared by the letters and digits of their words in lower
    case. A null text, or one without a word, is no one's copy. Rows alike in id
    and text count as one; rows that share an id but not the text are different
    documents. Columns other than the id and the text are ignored.
    """
    k = near_pairs(docs, id_col, text_col, threshold)
    return k.where("NOT (d <=> kd AND v = kv)").select(F.col("d").alias(id_col), F.col("kd").alias(f"kept_{id_col}"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each group left; of rows alike in id and text, unless it has no word, one is left too."""
    name = lambda c: F.xxhash64(F.col(c).isNull(), F.col(c).cast("string"))
    k = near_pairs(docs, id_col, text_col, threshold).where("NOT (d <=> kd AND v = kv)").select(name("d").alias("gd"), F.col("v").alias("gv"))
    bare = F.coalesce(~docs[text_col].cast("string").rlike(r"[\p{L}\p{N}]"), F.lit(True))
    whole = packed(docs, **{KEY: F.xxhash64(docs[text_col].cast("string")), "__id": docs[id_col], "__bare": bare}).withColumn("__id", name("__id"))
    # the join and the window lie by the same two hashes, so a text moves once
    left = whole.join(k, (F.col(KEY) == F.col("gv")) & (F.col("__id") == F.col("gd")), "left_anti")
    left = left.withColumn("__n", F.row_number().over(Window.partitionBy(KEY, "__id").orderBy("__bare"))).where("__bare OR __n = 1")
    return left.select(*[F.col(ROW)[c].alias(c) for c in docs.columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
