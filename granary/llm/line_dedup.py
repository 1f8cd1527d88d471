"""Line dedup within an edit bound: of one by a deletion-neighbourhood join, of more by variants that delete all but a segment which the edits leave whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, ROW, checkpointed, packed, released, row_key, rows_of, table

#: Most edits between two lines that count as repeated. OP3_SQL sets it to one; the pipeline takes PIPELINE_EDITS.
MOST_EDITS = 1
PIPELINE_EDITS = 4
#: A line has one edit for each so many of its characters, ``most_edits`` at most.
CHARS_PER_EDIT = 20
#: Windows into which a line is cut to find out whether any other line agrees with it outside of one.
WINDOWS = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {_BASE: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}
_K = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)]


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            _powers[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 4096), base, dtype=np.uint64))])
    return _powers[base][:n]


def _sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums of character k times BASE^k, modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * powers(_BASE, len(points)), dtype=np.uint64)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def neighbourhood(text: str, start: int, stop: int) -> tuple[int, np.ndarray]:
    """Hash of the text, and hashes of the text without its character i for i from start to stop."""
    with np.errstate(over="ignore"):
        p = _sums(_points(text))
        return int(p[-1:].view(np.int64)[0]), (p[start:stop] + (p[-1] - p[start + 1 : stop + 1]) * _INVERSE).view(np.int64)


def window_keys(texts: list[str], least: int) -> tuple[np.ndarray, ...]:
    """(text number, key, longer, a, b): what each text has outside of each window, hashed.

    As the shorter of a pair a text of n characters is cut into WINDOWS windows
    a to b; as the longer one, of n + 1 characters, it has one more character in
    the window. All texts are hashed in one go, by differences of prefix sums.
    """
    m = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(m)])
    p = _sums(_points("".join(texts)))
    back = powers(_INVERSE, len(p))
    rows, keys, roles, starts, stops = [], [], [], [], []
    with np.errstate(over="ignore"):
        for longer in (0, 1):
            row = np.flatnonzero(m - longer >= least)
            n, s, e = m[row] - longer, at[row], at[row + 1]
            for j in range(WINDOWS):
                a, b = n * j // WINDOWS, n * (j + 1) // WINDOWS
                head, cut = (p[s + a] - p[s]) * back[s], e - (n - b)
                tail = (p[e] - p[cut]) * back[cut]
                key = (head * _K[0] ^ tail) * _K[1] + (n * WINDOWS + j).astype(np.uint64) * _K[2]
                key = (key ^ (key >> np.uint64(32))) * _K[0]
                for out, x in zip((rows, keys, roles, starts, stops), (row, key.view(np.int64), np.full(len(row), longer), a, b)):
                    out.append(x)
    return tuple(np.concatenate(x) for x in (rows, keys, roles, starts, stops))


def segment_keys(texts: list[str], most_edits: int, chars_per_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key): hashes of each text's own segments, whose keys are odd, and of what it has where a shorter text's segments may stand, whose keys are even.

    Texts are put in classes by length, ``chars_per_edit`` lengths to a class. A
    class has a bound of k edits, and two ends that don't overlap in its
    shortest text. The first has (k - 1) // 2 edits or fewer, or else the other
    has k // 2 or fewer; each is cut into one segment more than that. One of these
    is whole, and the one that comes first (seen from the end) with no more edits
    before it than there are segments before it is moved by no more than that
    number of characters. A longer text also looks in the class below if a text
    shorter by k may be there.
    """
    m = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(m)])
    p = _sums(_points("".join(texts)))
    back = powers(_INVERSE, len(p))
    own = m // chars_per_edit
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for lower in (0, 1):
            kind = own - lower
            bound = np.minimum(kind, most_edits)
            fits = (kind >= 1) & (m - bound < (kind + 1) * chars_per_edit)
            for k in np.unique(bound[fits]).tolist():
                row = np.flatnonzero(fits & (bound == k))
                c = kind[row]
                for end, edits in enumerate(((k - 1) // 2, k // 2)):
                    size = c * chars_per_edit // 2 // (edits + 1)
                    for i in range(edits + 1):
                        label = ((c * 2 + end) * (most_edits + 1) + i).astype(np.uint64) * _K[2]
                        for shift in range(-i, i + 1):
                            a = i * size + shift if not end else m[row] - (i + 1) * size + shift
                            inside = (a >= 0) & (a + size <= m[row])
                            r, start = row[inside], at[row[inside]] + a[inside]
                            key = ((p[start + size[inside]] - p[start]) * back[start] * _K[0] ^ label[inside]) * _K[1]
                            key = ((key ^ (key >> np.uint64(32))) * _K[0]) << np.uint64(1)
                            rows.append(r)
                            keys.append((key | np.uint64(shift == 0 and not lower)).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def parities(texts: list[str]) -> np.ndarray:
    """64 bits for each text, none of them empty: whether it has an odd number of the characters of a class. An edit changes two bits at most."""
    at = np.cumsum([0] + [len(t) for t in texts])[:-1]
    with np.errstate(over="ignore"):
        classes = (_points("".join(texts)) * _BASE) >> np.uint64(58)
    return np.bitwise_xor.reduceat(np.uint64(1) << classes, at).view(np.int64)


def normalised(line: Column) -> Column:
    # looking for six strings costs less than one regular expression
    rare = F.lit(False)
    for x in ("\t", "\x0b", "\x0c", "\r", "\u00a0", "  "):
        rare |= F.contains(line, F.lit(x))
    return F.lower(F.trim(F.when(rare, F.regexp_replace(line, r"[\s\x{00a0}]+", " ")).otherwise(line)))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nodoc, d, k, pos, t): the lines that aren't blank, normalised; the first four columns order them."""
    d = docs.select(docs[id_col].alias("d"), row_key(docs, id_col, text_col).alias("k"), docs[text_col].cast("string").alias("t"))
    lines = d.where("t IS NOT NULL").select("d", "k", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    return lines.select(F.col("d").isNull().alias("nodoc"), "d", "k", "pos", normalised(F.col("line")).alias("t")).where("t != ''")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.select(F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2"), F.struct("nodoc", "d", "k", "pos").alias("o"), "t")


def _distinct(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, o, n, t): each distinct line, known by 128 bits of hash, with its first place and the number of its places. Its text moves once, after equal lines of a task have been made one."""
    lines = _hashed(lines_of(docs, id_col, text_col)).groupBy("h1", "h2").agg(F.min("o").alias("o"), F.count("*").alias("n"), F.first("t").alias("t"))
    # always true; all uses ask for the same columns by it, so that one shuffle serves them
    return lines.where("o IS NOT NULL AND n > 0 AND t IS NOT NULL")


def _candidates(lines: DataFrame, keyed: DataFrame) -> DataFrame:
    """Lines that share a key with another, with these keys and their text, and those that stand in several places, without. Where two lines share 64 bits of hash, each gets the keys of both, which is harmless."""
    met = keyed.groupBy("h1").agg(F.collect_set("key").alias("keys")).join(lines.select("h1", "h2"), "h1")
    # lines lie by both hashes already, so their text stays where it is
    both = lines.join(met.select("h1", "h2", "keys"), ["h1", "h2"], "left").where("n > 1 OR keys IS NOT NULL")
    return checkpointed(both.select("h1", "h2", "o", "n", F.when(F.col("keys").isNotNull(), F.col("t")).alias("t"), "keys"))


def matches(docs: DataFrame, id_col: str, text_col: str, chars_per_edit: int = CHARS_PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """What :func:`_candidates` gives, and (h1, h2, partner): distinct lines with an earlier line at edit distance one, and where the earliest such line first stands.

    All lines meet by their hash, once. A pair at distance one agrees outside
    one of four windows, so lines that agree with no other there have no
    neighbour and leave. The rest emit their whole deletion neighbourhood in
    that window: a line without its character i, keyed with i, is shared by
    lines that differ in character i alone; a line without any one character is
    met by the line that is just that. In the first kind all members are
    neighbours of each other, in the second the shorter is everyone's, so the
    earliest member decides and no list of pairs is made, however many lines
    share a key. Pairs are then verified by their real edit distance.
    """
    lines = _distinct(docs, id_col, text_col)

    def keys(batches):
        for batch in rows_of(batches, 2_000):
            row, key, *_ = window_keys(batch.column(1).to_pylist(), chars_per_edit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key)], names=["h1", "key"])

    keyed = lines.where(F.length("t") >= chars_per_edit).select("h1", "t").mapInArrow(keys, "h1 long, key long")
    every = _candidates(lines, keyed.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1"))
    near = every.where("keys IS NOT NULL")

    def emit(frames):
        for f in frames:
            for at in range(0, len(f), 64):
                part = f.iloc[at : at + 64]
                texts, met = part["t"].tolist(), [set(x) for x in part["keys"]]
                rows, kinds, vs, centers = [], [], [], set()
                for row, key, longer, a, b in zip(*[x.tolist() for x in window_keys(texts, chars_per_edit)]):
                    if key not in met[row]:
                        continue
                    n = np.int64(len(texts[row]) - longer)
                    whole, gone = neighbourhood(texts[row], a, b + longer)
                    with np.errstate(over="ignore"):
                        v = gone * np.int64(31) + n
                        if longer:
                            v = np.unique(v)
                        else:
                            v = v * np.int64(1_000_003) + np.arange(a, b)
                        found = [(v, 2 if longer else 0)]
                        if not longer and row not in centers:
                            centers.add(row)
                            found.append((np.array([whole]) * np.int64(31) + n, 1))
                    for v, kind in found:
                        vs.append(v)
                        rows.append(np.full(len(v), row))
                        kinds.append(np.full(len(v), kind, dtype=np.int32))
                if rows:
                    row = np.concatenate(rows)
                    yield pd.DataFrame({"v": np.concatenate(vs), "kind": np.concatenate(kinds), "h1": part["h1"].to_numpy()[row], "h2": part["h2"].to_numpy()[row]})

    emitted = near.select("h1", "h2", "t", "keys").mapInPandas(emit, "v long, kind int, h1 long, h2 long").dropDuplicates()
    group = Window.partitionBy("v", F.col("kind") > 0)
    crowded = emitted.withColumn("n", F.count("*").over(group)).where("n > 1").drop("n")
    placed = crowded.join(near.select("h1", "h2", "o"), ["h1", "h2"])
    here = F.struct("o", "h1", "h2")
    placed = placed.select(
        "h1",
        "h2",
        "o",
        F.when(F.col("kind") == 0, F.min(here).over(group)).when(F.col("kind") == 2, F.min(F.when(F.col("kind") == 1, here)).over(group)).otherwise(F.min(F.when(F.col("kind") == 2, here)).over(group)).alias("p"),
    )
    pairs = placed.where("p IS NOT NULL AND p.o < o").groupBy("h1", "h2").agg(F.collect_set("p").alias("ps")).select("h1", "h2", F.explode("ps").alias("p"))
    mine, other = near.select("h1", "h2", F.col("t").alias("t1")), near.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("t").alias("t2"))
    checked = pairs.select("h1", "h2", "p.o", F.col("p.h1").alias("g1"), F.col("p.h2").alias("g2")).join(mine, ["h1", "h2"]).join(other, ["g1", "g2"]).where(F.levenshtein("t1", "t2", 1) == 1)
    return every, checked.groupBy("h1", "h2").agg(F.min("o").alias("partner"))


def matches_within(docs: DataFrame, id_col: str, text_col: str, most_edits: int, chars_per_edit: int = CHARS_PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """What :func:`matches` gives, for a bound that grows with the shorter line's length.

    Lines that share no segment with another leave. The others are held against
    the earliest line of each of their segments first; after that only lines
    still earlier than what was found are of interest, so that a group of mutual
    neighbours makes no list of pairs. The rest are pairs whose lengths and
    parities allow the bound. All pairs are verified by their real edit distance.
    """
    lines = _distinct(docs, id_col, text_col)

    def keys(batches):
        for batch in rows_of(batches, 1_000):
            row, key = segment_keys(batch.column(1).to_pylist(), most_edits, chars_per_edit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key)], names=["h1", "key"])

    def sketched(batches):
        for batch in rows_of(batches, 1_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parities(batch.column(2).to_pylist()))], names=["h1", "h2", "bits"])

    alike = Window.partitionBy(F.shiftright("key", 1))
    keyed = lines.where(F.length("t") >= chars_per_edit).select("h1", "t").mapInArrow(released(keys), "h1 long, key long")
    keyed = keyed.withColumns({"c": F.count("*").over(alike), "own": F.max(F.col("key").bitwiseAND(1)).over(alike)}).where("c > 1 AND own = 1")
    every = _candidates(lines, keyed)
    near = every.where("keys IS NOT NULL")
    bits = near.select("h1", "h2", "t").mapInArrow(released(sketched), "h1 long, h2 long, bits long")
    # a place is a segment of a text of n characters: one's own, or what it may be for a text shorter by up to ``most_edits``
    placed = near.select("h1", "h2", "o", F.length("t").alias("m"), F.explode("keys").alias("key"))
    placed = placed.select("h1", "h2", "o", "m", F.shiftright("key", 1).alias("key"), (F.col("key").bitwiseAND(1) == 1).alias("own"), F.explode(F.sequence(F.col("m") - most_edits, F.col("m"))).alias("n"))
    placed = placed.withColumn("own", F.col("own") & (F.col("n") == F.col("m")))
    same = Window.partitionBy("key", "n")
    placed = placed.withColumns({"f": F.min(F.struct("o", "h1", "h2")).over(same), "any": F.max("own").over(same), "c": F.count("*").over(same)}).where("any AND c > 1")

    mine, other = near.select("h1", "h2", F.col("t").alias("t1")), near.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("o").alias("p"), F.col("t").alias("t2"))
    bound = F.least(F.lit(most_edits), F.floor(F.least(F.length("t1"), F.length("t2")) / chars_per_edit))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.dropDuplicates().join(mine, ["h1", "h2"]).join(other, ["g1", "g2"])
        return both.where(F.levenshtein("t1", "t2", most_edits).between(1, bound)).groupBy("h1", "h2").agg(F.min("p").alias("p"))

    earliest = placed.where("f.o < o").select("h1", "h2", F.col("f.h1").alias("g1"), F.col("f.h2").alias("g2"))
    found = checkpointed(verified(earliest))
    rest = placed.drop("f", "any", "c").join(found, ["h1", "h2"], "left").join(bits, ["h1", "h2"]).withColumn("before", F.coalesce("p", "o")).drop("p")
    a = rest.select("key", "n", *[F.col(c).alias(f"a_{c}") for c in ("h1", "h2", "o", "own", "bits")])
    pairs = rest.join(a, ["key", "n"]).where(f"a_o < before AND (own OR a_own) AND bit_count(bits ^ a_bits) <= {2 * most_edits}")
    more = verified(pairs.select("h1", "h2", F.col("a_h1").alias("g1"), F.col("a_h2").alias("g2")))
    return every, found.unionByName(more).groupBy("h1", "h2").agg(F.min("p").alias("partner"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_edits: int = MOST_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(nodoc, d, k, pos, kept): lines to remove, and the earlier line that stays for them."""
    lines, found = matches(docs, id_col, text_col, chars_per_edit) if most_edits == 1 else matches_within(docs, id_col, text_col, most_edits, chars_per_edit)
    # a line that stands in very many places is grouped by partial sums and joined with skew handling
    changed = lines.select("h1", "h2", F.col("o").alias("first"), "n").join(found, ["h1", "h2"], "left").where("n > 1 OR partner IS NOT NULL")
    joined = _hashed(lines_of(docs, id_col, text_col)).select("h1", "h2", "o").join(changed, ["h1", "h2"])
    return joined.where("partner IS NOT NULL OR first < o").select("o.*", F.coalesce("partner", "first").alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_edits: int = MOST_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per line to be removed: id, ``line_no`` from 0, ``kept_<id>`` and ``kept_line_no`` of an earlier line that makes it superfluous.

    Lines are compared in lower case with white space squeezed. A line goes if
    an earlier one is equal or within the edit bound (Levenshtein, on
    characters): one edit for each ``chars_per_edit`` characters of the shorter,
    ``most_edits`` at most. Lines of any length are compared whole. Earlier means by id (null last), then by a hash of
    id and text, then by line number. The kept line named is the earliest within
    the bound, but not equal, if there is one before it, else the earliest
    equal one. Blank lines stay. Null and empty texts have no
    lines, nor has an empty table; rows alike in id and text count as one; other
    columns are ignored.
    """
    r = repeated_lines(docs, id_col, text_col, most_edits, chars_per_edit).select("d", "k", "pos", "kept").dropDuplicates(["d", "k", "pos"])
    return r.select(F.col("d").alias(id_col), F.col("pos").alias("line_no"), F.col("kept.d").alias(f"kept_{id_col}"), F.col("kept.pos").alias("kept_line_no"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", most_edits: int = MOST_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The documents without the lines that :func:`line_dedup` removes; ``length_col`` follows.

    A document none of whose lines with text remain goes; one that had none
    from the start stays as it is. All other columns are kept.
    """
    columns = docs.columns
    gone = repeated_lines(docs, id_col, text_col, most_edits, chars_per_edit).groupBy(F.col("d").alias("gd"), F.col("k").alias("gk")).agg(F.collect_set("pos").alias("gone"))
    whole = packed(docs, **{KEY: row_key(docs, id_col, text_col), "__id": docs[id_col]})
    joined = whole.join(gone, (F.col(KEY) == F.col("gk")) & F.col("__id").eqNullSafe(F.col("gd")), "left")
    lines = F.split(F.col(ROW)[text_col].cast("string"), "\n")
    left = F.transform(
        F.array(lines), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: F.element_at(ls, i + 1)), "\n")
    )[0]
    joined = joined.select(ROW, "gone", F.when(F.col("gone").isNull(), F.col(ROW)[text_col].cast("string")).otherwise(left).alias("__left"))
    joined = joined.where(F.col("gone").isNull() | F.col("__left").rlike(r"[^\s\x{00a0}]"))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("__left").alias(c)
        if c == length_col:
            return F.when(F.col("gone").isNull(), F.col(ROW)[c]).otherwise(F.length("__left").cast(docs.schema[c].dataType)).alias(c)
        return F.col(ROW)[c].alias(c)

    return joined.select(*[column(c) for c in columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH lines AS (
  SELECT DISTINCT doc_id, i - 1 AS pos, lower(trim(regexp_replace(ls[i], '[\s\x{{00a0}}]+', ' ', 'g'), ' ')) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), range(1, len(ls) + 1) AS r(i)
),
l AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS o FROM lines WHERE t != ''),
d AS (SELECT t, min(o) AS o, length(t) AS m FROM l GROUP BY t),
v AS (SELECT t, o, m, p, substr(t, 1, p - 1) || substr(t, p + 1) AS w FROM d, range(1, m + 1) AS r(p)),
pairs AS (
  SELECT a.t, b.o FROM v a JOIN v b ON a.w = b.w AND a.p = b.p AND a.m = b.m AND b.o < a.o AND a.m >= {CHARS_PER_EDIT}
  UNION ALL SELECT a.t, b.o FROM v a JOIN d b ON a.w = b.t AND b.o < a.o AND b.m >= {CHARS_PER_EDIT}
  UNION ALL SELECT a.t, b.o FROM d a JOIN v b ON b.w = a.t AND b.o < a.o AND a.m >= {CHARS_PER_EDIT}
),
n AS (SELECT t, min(o) AS o FROM pairs GROUP BY t),
x AS (SELECT l.doc_id, l.pos, coalesce(n.o, d.o) AS kept FROM l JOIN d ON l.t = d.t LEFT JOIN n ON l.t = n.t WHERE n.o IS NOT NULL OR d.o < l.o)
SELECT x.doc_id, CAST(x.pos AS INTEGER) AS line_no, k.doc_id AS kept_doc_id, CAST(k.pos AS INTEGER) AS kept_line_no FROM x JOIN l k ON x.kept = k.o
"""
