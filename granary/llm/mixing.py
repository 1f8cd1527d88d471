"""Mixing sources to target weights, by fixed-length token blocks. All of it is column expressions: no Python worker takes part."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: A token: up to 8 characters of a word, with the space before it if the word begins there, or a space that no word follows. A text is its tokens put together, in any language.
TOKEN = " ?[^ ]{1,8}| "
#: Tokens in a block.
BLOCK_TOKENS = 512
#: Blocks in an output shard.
SHARD_SLOTS = 1024
#: Without explicit weights a source weighs its number of blocks to this power.
ALPHA = 0.7
#: Weights are whole multiples of 1 / UNIT, so that their sums are exact in any order.
UNIT = 1_000_000
SEED = 20240229
#: The token put after every document.
END = "\n"
#: Shards whose counts are summed together: a part, not a source, is the unit of sequential work.
SHARD_PART = 4_096
#: Bins by which a draw finds its source.
BINS = 4_096
NULL_SOURCE = "\x01null"


def number(*parts) -> Column:
    """60 bits of the MD5 of the parts, put together with colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The image of x under a pseudorandom permutation of 0 .. n-1: four Feistel rounds over a by b cells, a being the square root of n rounded up, repeated while outside (fewer than one in a)."""
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def turn(k: int):
        """Round k; its lambda binds the halves, so that they are computed once."""
        if k % 2:
            return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + number(key, F.lit(k), s["l"])) % b).alias("r"))
        return lambda s: F.struct(((s["l"] + number(key, F.lit(k), s["r"])) % a).alias("l"), s["r"].alias("r"))

    def rounds(y: Column) -> Column:
        state = F.struct(F.floor(y / b).alias("l"), (y % b).alias("r"))
        for k in range(4):
            state = F.transform(F.array(state), turn(k))[0]
        return F.transform(F.array(state), lambda s: s["l"] * b + s["r"])[0]

    def walk(y: Column) -> Column:
        steps = F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n, F.lit(1)))
        return F.when(y < n, y).otherwise(F.aggregate(steps, y, lambda z, _: F.when(z < n, z).otherwise(rounds(z))))

    return F.transform(F.array(rounds(x)), walk)[0]


def _texts(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str | None, seed: int) -> DataFrame:
    """(s, d, g, h, t): the texts with a token. h is a digest of seed, id and text, which rows alike in these share."""
    text = docs[text_col].cast("string")
    work = docs.select(
        F.coalesce(docs[source_col].cast("string"), F.lit(NULL_SOURCE)).alias("s"),
        docs[id_col].alias("d"),
        (docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")).alias("g"),
        F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("")), text)).alias("h"),
        text.alias("t"),
    )
    return work.where("t IS NOT NULL AND t != ''")


def counted(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED) -> DataFrame:
    """(s, h, n, copies): tokens of each distinct row with its END, and how often the row occurs; checkpointed, as both the blocks and their plan are made from it."""
    work = _texts(docs, id_col, text_col, source_col, None, seed)
    # a distinct row's tokens are counted where the row is; only digests and numbers are shuffled
    work = work.select("s", "h", (F.regexp_count("t", F.lit(TOKEN)) + 1).cast("long").alias("n"))
    return checkpointed(work.groupBy("s", "h").agg(F.first("n").alias("n"), F.count("*").alias("copies")))


def source_totals(sizes: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, blocks)."""
    return sizes.groupBy(F.col("s").alias("source")).agg(F.ceil(F.sum(F.col("n") * F.col("copies")) / block_tokens).cast("long").alias("blocks"))


def blocks(docs: DataFrame, sizes: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col: str | None = "lang", block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, block, doc_id, lang, n_tokens, text): every source's tokens in one line, cut every ``block_tokens``; the last block may be shorter.

    Each document is followed by the token END. Documents of a source are lined
    up by a seeded digest of their id and text. doc_id and lang are those of the
    block's first token. ``sizes`` is what :func:`counted` gives.
    """
    # first tokens of the documents, from sums over the parts that two hexadecimal digits of the digest make, then within them
    sized = sizes.withColumns({"part": F.substring("h", 1, 3), "m": F.col("n") * F.col("copies")})
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sized.groupBy("s", "part").agg(F.sum("m").alias("m")).select("s", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("o"))
    inside = Window.partitionBy("s", "part").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("i", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(parts, ["s", "part"])
    placed = placed.select("s", "h", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), (F.col("o") + F.col("i")).alias("o"))
    placed = placed.select("s", "h", "n", (F.col("o") + F.col("copy") * F.col("n")).alias("o"))
    work = _texts(docs, id_col, text_col, source_col, lang_col, seed)
    # one row for each text; its copies come from the places
    one = work.groupBy("s", "h").agg(F.first(F.struct("d", "g", "t")).alias("x")) if _repeats(sizes) else work.select("s", "h", F.struct("d", "g", "t").alias("x"))
    both = one.join(placed, ["s", "h"])
    size = F.lit(block_tokens)
    first, last = F.expr(f"o div {block_tokens}"), F.expr(f"(o + n - 1) div {block_tokens}")
    # one lambda binds the tokens, so that a text is cut up once however many blocks it reaches into
    pieces = F.transform(
        F.array(F.concat(F.regexp_extract_all("x.t", F.lit(TOKEN), F.lit(0)), F.array(F.lit(END)))),
        lambda toks: F.transform(
            F.sequence(first, last),
            lambda b: F.struct(
                b.alias("b"),
                F.greatest(b * size, F.col("o")).alias("at"),
                (F.least((b + 1) * size, F.col("o") + F.col("n")) - F.greatest(b * size, F.col("o"))).cast("int").alias("k"),
                F.array_join(F.slice(toks, F.greatest(b * size - F.col("o"), F.lit(0)).cast("int") + 1, (F.least((b + 1) * size, F.col("o") + F.col("n")) - F.greatest(b * size, F.col("o"))).cast("int")), "").alias("x"),
            ),
        ),
    )[0]
    cut = both.select("s", F.col("x.d").alias("d"), F.col("x.g").alias("g"), F.explode(pieces).alias("p"))
    cut = cut.select("s", F.col("p.b").alias("b"), F.struct("p.at", "p.k", "d", "g", "p.x").alias("p"))
    whole = cut.groupBy("s", "b").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.sum("p.k").cast("int").alias("k"))
    return whole.select(
        F.col("s").alias("source"), F.col("b").alias("block"), F.col("ps")[0]["d"].alias("doc_id"), F.col("ps")[0]["g"].alias("lang"), F.col("k").alias("n_tokens"), F.array_join(F.col("ps.x"), "").alias("text")
    )


def _repeats(sizes: DataFrame) -> bool:
    return not sizes.where("copies > 1").isEmpty()


def targets(totals: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, blocks, lo, hi): each source's share as a range of whole numbers. A source without a weight, where weights are given, gets none."""
    if weights is None:
        weighed = totals.withColumn("w", F.floor(F.pow(F.col("blocks").cast("double"), F.lit(alpha)) * UNIT).cast("long"))
    else:
        given = totals.sparkSession.createDataFrame([(k, int(v * UNIT)) for k, v in weights.items()], "source string, w long")
        weighed = totals.join(given, "source")
    weighed = weighed.where("w > 0").withColumn("part", F.substring(F.md5("source"), 1, 2))
    # running sums over sources, by parts, however many sources there are
    inside = Window.partitionBy("part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = weighed.groupBy("part").agg(F.sum("w").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("o"))
    ranged = weighed.withColumn("i", F.coalesce(F.sum("w").over(inside), F.lit(0))).join(parts, "part").withColumn("lo", F.col("o") + F.col("i"))
    return ranged.select("source", "blocks", "lo", (F.col("lo") + F.col("w")).alias("hi"))


def slots(spark: SparkSession, totals: DataFrame, weights=None, alpha: float = ALPHA, shard_slots: int = SHARD_SLOTS, n_slots: int | None = None, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block): which block fills each slot.

    There are as many slots as blocks unless ``n_slots`` says otherwise. Each
    slot draws its source by the target shares, so that a shard's counts are one
    multinomial draw. A source's slots, counted through all shards, go through a
    permutation of its blocks, another one for each time round. One row, of sums,
    comes to the driver.
    """
    shares = checkpointed(targets(totals, weights, alpha))
    total = totals.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    high = shares.agg(F.max("hi")).first()[0]
    n_slots = total if n_slots is None else n_slots
    if total and n_slots and not high:
        raise ValueError("no source has both blocks and a weight")
    high = high or 1
    width = -(-high // BINS)
    drawn = spark.range(n_slots if total else 0).select("id", F.expr(f"id div {shard_slots}").alias("shard"), F.expr(f"id % {shard_slots}").alias("slot"), (number(F.lit(str(seed)), F.lit("slot"), "id") % high).alias("u"))
    binned = shares.select("source", "blocks", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("bin"))
    drawn = drawn.withColumn("bin", F.expr(f"u div {width}")).join(binned, "bin").where("lo <= u AND u < hi")
    drawn = drawn.select("shard", "slot", "source", "blocks").withColumn("rank", F.row_number().over(Window.partitionBy("source", "shard").orderBy("slot")) - 1)
    counts = drawn.groupBy("source", "shard").agg(F.count("*").alias("c")).withColumn("part", F.expr(f"shard div {SHARD_PART}"))
    inside = Window.partitionBy("source", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("source", "part").agg(F.sum("c").alias("m")).select("source", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("o"))
    starts = counts.withColumn("i", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(parts, ["source", "part"]).select("source", "shard", (F.col("o") + F.col("i")).alias("o"))
    placed = drawn.join(starts, ["source", "shard"]).withColumn("j", F.col("o") + F.col("rank"))
    key = F.concat_ws(":", F.lit(str(seed)), "source", F.floor(F.col("j") / F.col("blocks")))
    return placed.select("shard", "slot", "source", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), key).alias("block"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col: str | None = "lang", weights=None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, n_slots: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per slot of the mixed data: shard, slot, source, block, doc_id, lang, n_tokens, text.

    Texts that are null or empty have no tokens and take no part. A null source
    is a source of its own. Repeated rows are packed as often as they occur; of
    rows alike in source, id and text one row's language stands for all. A text
    of any length is cut up whole. An empty table gives no rows. Columns other
    than the four named are ignored. A source of small weight is drawn from in
    part, one of large weight more than once round; within a round no block is
    drawn twice.
    """
    sizes = counted(docs, id_col, text_col, source_col, seed)
    body = blocks(docs, sizes, id_col, text_col, source_col, lang_col, block_tokens, seed)
    plan = slots(docs.sparkSession, source_totals(sizes, block_tokens), weights, alpha, shard_slots, n_slots, seed)
    # blocks are already laid out by (source, block): only the slots, a few numbers each, move for this join
    mixed = plan.hint("merge").join(body, ["source", "block"])
    return mixed.select("shard", "slot", F.when(F.col("source") != NULL_SOURCE, F.col("source")).alias("source"), "block", "doc_id", "lang", "n_tokens", "text")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _number_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


#: One Feistel image of x, in columns that build on each other.
_FEISTEL_SQL = f"""x // b AS l0, x % b AS r0,
  (l0 + {_number_sql("key", "0", "r0")}) % a AS l1, (r0 + {_number_sql("key", "1", "l1")}) % b AS r1,
  (l1 + {_number_sql("key", "2", "r1")}) % a AS l2, (r1 + {_number_sql("key", "3", "l2")}) % b AS r2, l2 * b + r2 AS y"""
OP9_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT coalesce(source, chr(1) || 'null') AS s, doc_id AS d, lang AS g, md5(concat_ws(chr(31), '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), text)) AS h,
         list_append(regexp_extract_all(text, '{TOKEN}'), chr(10)) AS toks FROM documents WHERE text IS NOT NULL AND text != ''
),
line AS (SELECT s, d, g, toks, coalesce(sum(len(toks)) OVER (PARTITION BY s ORDER BY h, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM texts),
tokens AS (SELECT s, d, g, CAST(o + i - 1 AS BIGINT) AS pos, toks[i] AS tok FROM line, range(1, len(toks) + 1) AS r(i)),
blocks AS (
  SELECT s, pos // {BLOCK_TOKENS} AS block, arg_min(d, pos) AS doc_id, arg_min(g, pos) AS lang, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(tok, '' ORDER BY pos) AS text
  FROM tokens GROUP BY 1, 2
),
totals AS (SELECT s, count(*) AS n, CAST(floor(pow(CAST(count(*) AS DOUBLE), {ALPHA}) * {UNIT}) AS BIGINT) AS w FROM blocks GROUP BY 1),
shares AS (SELECT s, n, CAST(sum(w) OVER (ORDER BY substr(md5(s), 1, 2), s) AS BIGINT) AS hi, hi - w AS lo, CAST(sum(w) OVER () AS BIGINT) AS high FROM totals WHERE w > 0),
drawn AS (SELECT g, {_number_sql(f"'{SEED}'", "'slot'", "g")} % (SELECT max(high) FROM shares) AS u FROM range((SELECT CAST(sum(n) AS BIGINT) FROM totals)) AS r(g)),
taken AS (SELECT g, s, n, row_number() OVER (PARTITION BY s ORDER BY g) - 1 AS j FROM drawn JOIN shares ON u >= lo AND u < hi),
keyed AS (SELECT g, s, n, concat_ws(':', '{SEED}', s, j // n) AS key, j % n AS x, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a, CAST(ceil(n / a) AS BIGINT) AS b FROM taken),
walk AS (
  SELECT g, s, n, key, a, b, y FROM (SELECT *, {_FEISTEL_SQL} FROM keyed)
  UNION ALL SELECT g, s, n, key, a, b, y2 FROM (SELECT w.g, w.s, w.n, w.key, w.a, w.b, w.y AS x, {_FEISTEL_SQL.replace("AS y", "AS y2")} FROM walk w WHERE w.y >= w.n)
)
SELECT w.g // {SHARD_SLOTS} AS shard, w.g % {SHARD_SLOTS} AS slot, CASE WHEN w.s != chr(1) || 'null' THEN w.s END AS source, w.y AS block, b.doc_id, b.lang, b.n_tokens, b.text
FROM walk w JOIN blocks b ON w.s = b.s AND w.y = b.block WHERE w.y < w.n
"""
