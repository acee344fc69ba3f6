"""Benchmark passages in training documents, found by spaced seeds; DataFrame functions only.

A mask looks at some positions of a short stretch of words and ignores the others. Test and training
hashes of the looked-at words are joined, and around each hit the words are compared: an overlap is
``WINDOW`` words in a row, of which at most ``SUBSTITUTED`` differ. The two masks find every such
overlap: whichever two of 13 words are replaced, one of the masks fits somewhere between them (a test
tries all). Items of fewer words than a window have to be there as a whole, with two words in thirteen
replaced at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.operators.skew import join_lookup

WINDOW = 13
SUBSTITUTED = 2
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 4, 7, 8))
#: The table that most training hashes are turned away by has so many bits for each test hash, two of them set,
#: in words of 64 bits: a power of two between these bounds (at most 2 MB). Past the upper one more hashes go on to the join.
TABLE_BITS = 32
LEAST_TABLE_WORDS, MOST_TABLE_WORDS = 1 << 14, 1 << 18
#: Test hashes with the words around them are broadcast up to this size.
BROADCAST_BYTES = 64 << 20
SEED_BYTES = 120 + 8 * (2 * WINDOW - 1)

_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&`~_^=+/\\-"
_SPACES = "\t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in lower case, without ASCII punctuation."""
    plain = F.translate(F.lower(text), _SPACES + _PUNCTUATION, " " * len(_SPACES))
    return F.transform(F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), ""), lambda w: F.xxhash64(w))


def short_masks(lengths: list[int]) -> list[tuple[int, ...]]:
    """For items shorter than a window, too short for the masks to be sure: the longest run that is left
    when as many words as allowed are replaced."""
    runs = set()
    for n in lengths:
        if 0 < n < WINDOW:
            allowed = n * SUBSTITUTED // WINDOW
            runs.add(-(-(n - allowed) // (allowed + 1)))
    return [tuple(range(n)) for n in sorted(runs)]


def _seed(h: Column, i: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(*[F.get(h, i + F.lit(o)) for o in mask])


def _places(h: Column, mask: tuple[int, ...]) -> Column:
    """The positions at which a mask fits."""
    last = F.size(h) - F.lit(mask[-1] + 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    parts = None
    for k, mask in enumerate(masks):
        rows = items.where(F.size("h") < WINDOW) if k >= len(MASKS) else items
        part = rows.select("item_id", F.explode(_places(F.col("h"), mask)).alias("q"), "h").select(
            F.lit(k).alias("mask"), _seed(F.col("h"), F.col("q"), mask).alias("seed"), "item_id", "q"
        )
        parts = part if parts is None else parts.union(part)
    return parts


def table_words(seeds: int) -> int:
    """How many words of 64 bits the table for so many seeds has."""
    wanted = max(seeds * TABLE_BITS // 64, 1)
    return min(max(1 << (wanted - 1).bit_length(), LEAST_TABLE_WORDS), MOST_TABLE_WORDS)


def _probes(seed: Column, words: int) -> list[tuple[Column, Column]]:
    """Two places in the table: word and bit."""
    last = F.lit(words - 1).cast("bigint")
    return [
        (F.shiftrightunsigned(seed, s).bitwiseAND(last).cast("int"), F.shiftrightunsigned(seed, s + 24).bitwiseAND(F.lit(63)).cast("int"))
        for s in (0, 32)
    ]


def _bits(seeds: DataFrame, words: int) -> DataFrame:
    """A bit table of the seeds: one row with an array ``bits`` of ``words`` numbers."""
    places = F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _probes(F.col("seed"), words)]))
    set_bits = seeds.select(places.alias("p")).select("p.word", F.expr("shiftleft(1L, p.bit)").alias("bits"))
    every = seeds.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    numbers = set_bits.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return numbers.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("t")).select("t.bits")


def _table(seeds: DataFrame, words: int) -> Column:
    """The bit table as a constant, for short ones: the plan's text has it at each place of use."""
    numbers = _bits(seeds, words).first().bits
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _may_be(seed: Column, table: Column, words: int) -> Column:
    (w1, b1), (w2, b2) = _probes(seed, words)
    return (F.bit_get(F.get(table, w1), b1) == 1) & (F.bit_get(F.get(table, w2), b2) == 1)


def _hits(h: Column, k: int, mask: tuple[int, ...], table: Column, words: int) -> Column:
    """The places whose seed the table has. Seeds are an array of their own, so that each is hashed once."""
    seeds = F.transform(_places(h, mask), lambda i: _seed(h, i, mask))
    marked = F.transform(seeds, lambda seed, i: F.when(_may_be(seed, table, words), F.struct(F.lit(k).alias("mask"), i.alias("p"), seed.alias("seed"))))
    return F.filter(marked, lambda hit: hit.isNotNull())


def _around(h: Column, i: Column) -> Column:
    """The words from ``WINDOW - 1`` before a position to ``WINDOW - 1`` after the longest mask; null outside."""
    return F.transform(F.sequence(i - F.lit(WINDOW - 1), i + F.lit(WINDOW - 1)), lambda j: F.when(j >= 0, F.get(h, j)))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, n_equal, n_words, item_ids``: one row per document and test item that overlap.

    The overlap given is the first of those with the most equal words among the stretches of ``n_words`` words
    around the seeds: ``WINDOW``, or the item's length if that is less. Positions count words from 0.
    Test items with the same words are one item, named by the smallest id; ``item_ids`` has all their ids. Null and empty texts have no
    word and never overlap; rows of ``docs`` that share an id count as one document, a null id stays
    null. Empty tables give no rows; other columns are not read.
    """
    items = (
        benchmark.select(F.col(item_id_col).cast("bigint").alias("item_id"), word_hashes(F.col(item_text_col).cast("string")).alias("h"))
        .groupBy("h")
        .agg(F.min("item_id").alias("item_id"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
        .where(F.size("h") > 0)
    )
    named = items.select(F.xxhash64("h").alias("content"), "item_id", "item_ids")
    lengths = [r.n for r in items.select(F.size("h").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]
    masks = [*MASKS, *short_masks(lengths)]
    seeds = _seeds(items.withColumn("item_id", F.struct("item_id", F.xxhash64("h").alias("content"))), masks)
    n_seeds = seeds.count()
    n_words = table_words(n_seeds)
    # A subquery. A constant would be written out with the plan, and again with each update of it as it runs,
    # which fills the driver's memory.
    table = _bits(seeds, n_words).scalar()
    words = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), word_hashes(F.col(text_col).cast("string")).alias("h"))

    def hits(h: Column, table: Column) -> Column:
        """With the words around each."""
        of_masks = F.concat(*[_hits(h, k, mask, table, n_words) for k, mask in enumerate(masks)])
        return F.transform(of_masks, lambda hit: F.struct(hit["mask"], hit["seed"], hit["p"], _around(h, hit["p"]).alias("near")))

    # A subquery may not stand in ``transform``, so the table is a column first. Both columns are used once, as an
    # array's only element, and so Spark puts what they are in their place: no row carries the table.
    in_both = F.transform(F.array("table"), lambda table: F.get(F.transform(F.array("h"), lambda h: hits(h, table)), F.lit(0)))
    marked = words.withColumn("table", table).select("doc_id", F.get(in_both, F.lit(0)).alias("hits"))
    # Not the bare column, for which Spark would add a filter that finds the hits a second time.
    found = marked.select("doc_id", F.inline(F.array_compact("hits")))
    full = items.select(F.struct("item_id", F.xxhash64("h").alias("content")).alias("item_id"), "h")
    of_item = join_lookup(seeds, full, ["item_id"]).select(
        "mask", "seed", "item_id", "q", F.size("h").alias("item_words"), _around(F.col("h"), F.col("q")).alias("item_near")
    )
    if n_seeds * SEED_BYTES <= BROADCAST_BYTES:
        of_item = F.broadcast(of_item)
    met = found.join(of_item, ["mask", "seed"])
    best = _best_stretch(F.col("near"), F.col("item_near"), F.col("item_words"))
    verified = met.select(
        "doc_id",
        F.col("item_id.item_id").alias("item_id"),
        F.col("item_id.content").alias("content"),
        best.alias("b"),
        (F.col("p") - (WINDOW - 1) + best["at"]).alias("doc_start"),
        (F.col("q") - (WINDOW - 1) + best["at"]).alias("item_start"),
    ).where("b IS NOT NULL")
    first = F.max_by(F.struct("doc_start", "item_start", "b"), F.struct("b.equal", -F.col("doc_start"), -F.col("item_start")))
    each = verified.groupBy("doc_id", "item_id", "content").agg(first.alias("f"))
    # An item without an id has its content as a name; both sides of the join are short.
    return join_lookup(each, named.select("content", "item_ids"), ["content"]).select(
        "doc_id",
        "item_id",
        F.col("f.doc_start").alias("doc_start"),
        F.col("f.item_start").alias("item_start"),
        F.col("f.b.equal").alias("n_equal"),
        F.col("f.b.n").alias("n_words"),
        "item_ids",
    )


def _best_stretch(near: Column, item_near: Column, item_words: Column) -> Column:
    """``equal, at, n`` of the stretch around a hit with the most equal words, the first of ties; null if too many differ."""
    n = F.least(F.lit(WINDOW), item_words)
    differ = F.floor(n * SUBSTITUTED / WINDOW).cast("int")
    same = F.transform(
        F.arrays_zip(near.alias("a"), item_near.alias("b")),
        lambda x: F.when(x["a"].isNull() | x["b"].isNull(), F.lit(None)).otherwise((x["a"] == x["b"]).cast("int")),
    )
    starts = F.sequence(F.lit(0), F.lit(2 * WINDOW - 1) - n)
    # A stretch that leaves the document or the item has a null in it, and its sum is null.
    counted = F.transform(
        starts,
        lambda s: F.struct(
            F.aggregate(F.slice(same, s + 1, n), F.lit(0), lambda t, x: t + x).alias("equal"), (-s).alias("before"), s.alias("at"), n.alias("n")
        ),
    )
    fit = F.filter(counted, lambda c: c["equal"] >= n - differ)
    best = F.array_max(fit)
    return F.when(best.isNotNull(), F.struct(best["equal"].alias("equal"), best["at"].alias("at"), best["n"].alias("n")))
