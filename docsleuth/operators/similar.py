"""Joins that prune: sets that share most of their words, hashes that differ in few bits, and key points with near descriptors."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.sources.shared import one_by_one, written


def word_set(v: Column) -> Column:
    """Distinct words in lower case; null has none."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(F.coalesce(v, F.lit("")))), r"\s+"), lambda w: w != ""))


#: Sets of more words meet by single words only.
MOST_PAIRED = 64
#: A row of a set holds so many ids; more are dealt over rows.
MOST_IDS = 1024
#: A key at which more pairs of ids may meet is dealt over a grid of tasks.
MOST_MET = 30_000_000


def _grouped(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """set, words, ids: the distinct word sets, each with the ids that have it, at most about MOST_IDS in a row."""
    rows = written(df.select(F.col(id_col).alias("id"), F.array_sort(word_set(F.col(text))).alias("words")).where(F.size("words") > 0))
    many = rows.groupBy(F.xxhash64("words").alias("__hash")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > MOST_IDS)
    # as few as one for MOST_IDS rows
    dealt = rows.withColumn("__hash", F.xxhash64("words")).join(F.broadcast(many), "__hash", "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / MOST_IDS)), F.lit(0)))
    found = dealt.groupBy("words", "__part").agg(F.collect_list("id").alias("ids"))
    return written(found.select(F.monotonically_increasing_id().alias("set"), "words", "ids"))


def _numbered(sets: DataFrame) -> DataFrame:
    """word, number of all words of the sets: the rarest has the least number."""
    often = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    placed = written(often.orderBy("n", "word").select("word", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    most, ranges = placed.agg(F.coalesce(F.max("at"), F.lit(0)) + 1, F.coalesce(F.max("range"), F.lit(0)) + 1).first()
    return placed.select("word", (F.col("range") * most + F.col("at")).cast("int" if most * ranges < 1 << 31 else "bigint").alias("number"))


def set_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_text: str, b_text: str, least: float = 0.5) -> DataFrame:
    """J11 without comparing all pairs: a_id, b_id, shared, similarity of rows whose word sets have a Jaccard similarity of at least `least`. Exact.

    Equal sets are one set on either side, which carries its rows' ids. Words are numbers, the rarest first. Two sets that
    similar share a word among the first |x| - ceil(least |x|) + 1 of each, and two words among the first |x| - ceil(least |x|) + 2 if
    they share two at all. Sets of few words meet by two words, as one word becomes frequent where rows are many; those that may share but one, and
    those of more than MOST_PAIRED words, whose pairs of words are many, meet by one all others of a size that fits. Sets are compared where they meet, and
    count only where the first words that they share meet, so pairs are neither shuffled nor found twice: what is written and shuffled grows with the
    rows, not with the pairs. Keys of very many rows are dealt over tasks. Rows without a word match nothing.
    """
    # a hair's breadth of slack for what a float makes of the threshold: a longer prefix loses nothing
    slack = least - 1e-9
    sides = [_grouped(a, a_id, a_text), _grouped(b, b_id, b_text)]
    named = sides[0].select(F.lit(0).alias("side"), "set", "words").unionByName(sides[1].select(F.lit(1).alias("side"), "set", "words"))
    numbers = _numbered(named)
    words = named.select("side", "set", F.explode("words").alias("word")).join(numbers.hint("merge"), "word").groupBy("side", "set").agg(F.array_sort(F.collect_list("number")).alias("words"))
    words = written(words)
    size = F.size("words")
    shared_least = F.ceil(size * slack).cast("int")
    measured = {"size": size, "first": size - shared_least + 1, "paired": (shared_least >= 2) & (size <= MOST_PAIRED)}
    x, y = (written(words.where(F.col("side") == k).select("set", "words").join(s.select("set", "ids").hint("merge"), "set").select("words", "ids")).withColumns(measured) for k, s in enumerate(sides))
    head = F.slice("words", F.lit(1), F.col("first") + 1)
    no_word = F.lit(-1).cast(x.schema["words"].dataType.elementType)
    ones = F.transform(F.slice("words", F.lit(1), F.col("first")), lambda w, i: F.struct(w.alias("k1"), no_word.alias("k2"), i.alias("at1"), i.alias("at")))
    twos = F.flatten(F.transform(head, lambda w, i: F.transform(F.slice(head, i + 2, F.size(head)), lambda v, k: F.struct(w.alias("k1"), v.alias("k2"), i.alias("at1"), (i + k + 1).alias("at")))))

    def met(keys: Column, x: DataFrame, y: DataFrame, n: int, wanted: Column) -> DataFrame:
        x_keys, y_keys = (s.select("words", "ids", "size", "paired", F.inline(keys)).drop("at1") for s in (x, y))
        load = lambda s, p: s.groupBy("k1", "k2").agg(F.sum(F.size("ids").cast("bigint")).alias(f"{p}_load"), F.count(F.lit(1)).alias(f"{p}_rows"))
        full = load(x_keys, "x").join(load(y_keys, "y").hint("merge"), ["k1", "k2"]).where(F.col("x_load") * F.col("y_load") > MOST_MET)
        cuts = F.ceil(F.sqrt(F.col("x_load") * F.col("y_load") / MOST_MET))
        # as few as the keys' rows over the root of MOST_MET
        full = F.broadcast(written(full.select("k1", "k2", F.least(cuts, F.greatest("x_rows", "y_rows")).cast("int").alias("cuts"))))

        def dealt(s: DataFrame, p: str, own: str, other: str) -> DataFrame:
            s = s.join(full, ["k1", "k2"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
            s = s.withColumns({own: F.pmod(F.xxhash64("ids"), "cuts").cast("int"), other: F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))})
            return s.select("k1", "k2", "cut_x", "cut_y", *[F.col(c).alias(f"{p}_{c}") for c in ("words", "ids", "size", "paired", "at")])

        small, large = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
        # at the first n words that the two share, so many can be shared in all
        most = n + F.least(F.col("x_size") - F.col("x_at") - 1, F.col("y_size") - F.col("y_at") - 1)
        needed = slack / (1 + least) * (F.col("x_size") + F.col("y_size"))
        fits = (small >= slack * large) & (most >= needed)
        until = lambda p: F.slice(f"{p}_words", F.lit(1), F.col(f"{p}_at") + 1)
        foremost = F.size(F.array_intersect(until("x"), until("y"))) == n
        shared = F.size(F.array_intersect("x_words", "y_words"))
        # both sides may be large, so neither is gathered on the driver
        pairs = dealt(x_keys, "x", "cut_x", "cut_y").join(dealt(y_keys, "y", "cut_y", "cut_x").hint("merge"), ["k1", "k2", "cut_x", "cut_y"])
        return pairs.where(fits & wanted & foremost & (shared >= needed)).select("x_ids", "y_ids", (F.col("x_size") + F.col("y_size")).alias("sizes"), shared.cast("bigint").alias("shared"))

    paired = F.col("paired")
    pairs = met(twos, x.where(paired), y.where(paired), 2, F.lit(True))
    if not x.where(~paired).isEmpty() or not y.where(~paired).isEmpty():
        # of the sets that meet by two, only those of such sizes can match one that doesn't
        single = ~paired | (size * slack * slack <= 1) | (size >= MOST_PAIRED * slack)
        pairs = pairs.unionByName(met(ones, x.where(single), y.where(single), 1, ~(F.col("x_paired") & F.col("y_paired"))))
    alike = pairs.withColumn("similarity", F.col("shared") / (F.col("sizes") - F.col("shared"))).where(F.col("similarity") >= least)
    of_a = one_by_one(one_by_one(alike).select(F.explode("x_ids").alias(a_id), F.col("y_ids").alias("__ids"), "shared", "similarity"))
    return of_a.select(a_id, F.explode("__ids").alias(b_id), "shared", "similarity")


#: A key of near hashes that more rows share is dealt out by more bits.
MOST_ROWS = 512


def masks(radius: int, levels: int) -> list[list[tuple[int, int | None]]]:
    """Of each level the masks, and the number of the mask of the level before that each one refines.

    A level cuts the bits that a mask leaves open into radius + 1 blocks and adds one of them, so two hashes within the radius agree
    under some mask of every level. The last level is the one at which less than two bits for each block are left.
    """
    out: list[list[tuple[int, int | None]]] = []
    for level in range(levels):
        found: list[tuple[int, int | None]] = []
        for parent, (mask, _) in enumerate(out[-1]) if out else [(None, (0, None))]:
            free = [b for b in range(64) if not mask >> b & 1]
            if len(free) < 2 * (radius + 1):
                return out
            for k in range(radius + 1):
                block = free[k * len(free) // (radius + 1) : (k + 1) * len(free) // (radius + 1)]
                found.append((mask | sum(1 << b for b in block), parent))
        out.append(found)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_hashes(df: DataFrame, bits: str, radius: int = 3, most_rows: int = MOST_ROWS) -> DataFrame:
    """X, y (x < y): all pairs of the distinct 64-bit values that differ in at most so many bits. Exact; nulls match nothing.

    Values meet by 28 of their bits, in sixteen tables (for radius 3). A key that more than most_rows share isn't joined: its rows go on to keys of more
    bits, level by level, so what one key compares is bounded until the bits run out, and then by the few that are left open.
    """
    values = written(df.where(F.col(bits).isNotNull()).select(F.col(bits).cast("bigint").alias("h")).distinct())
    levels = masks(radius, 6)
    start = min(1, len(levels) - 1)
    table = lambda found: F.array(*[F.struct(F.lit(k).alias("table"), F.lit(_signed(m)).cast("bigint").alias("mask")) for k, m in found])
    keyed = lambda rows, tables: rows.select("h", F.explode(tables).alias("t")).select("h", F.col("t.table").alias("table"), F.col("h").bitwiseAND(F.col("t.mask")).alias("key"))
    rows = keyed(values, table([(k, m) for k, (m, _) in enumerate(levels[start])]))
    parts = []
    for level in range(start, len(levels)):
        rows = written(rows)
        if level + 1 < len(levels):
            full = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).select("table", "key")
            full = written(full)
            fit = rows.join(full, ["table", "key"], "left_anti")
            over = rows.join(full, ["table", "key"], "left_semi")
        else:
            fit, over = rows, None
        x, y = fit.select("table", "key", F.col("h").alias("x")), fit.select("table", "key", F.col("h").alias("y"))
        parts.append(x.join(y, ["table", "key"]).where((F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)).select("x", "y"))
        if over is None or over.isEmpty():
            break
        children = [[(k, m) for k, (m, parent) in enumerate(levels[level + 1]) if parent == p] for p in range(len(levels[level]))]
        rows = keyed(over, F.get(F.array(*map(table, children)), F.col("table")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def representatives(df: DataFrame, id_col: str, bits: str) -> DataFrame:
    """id, representative: of every row the least id with the same value; rows without a value stand for themselves."""
    least = df.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("__h")).agg(F.min(id_col).alias("__least"))
    return df.join(least, F.col(bits) == F.col("__h"), "left").select(F.col(id_col), F.coalesce("__least", id_col).alias("representative"))


def near_templates(df: DataFrame, id_col: str, bits: str, radius: int = 3, most_rows: int = MOST_ROWS) -> DataFrame:
    """A, b: pairs of representatives (see above) whose values differ in at most so many bits, a the lesser id."""
    own = df.where(F.col(bits).isNotNull()).groupBy(F.col(bits).cast("bigint").alias("h")).agg(F.min(id_col).alias("id"))
    near = near_hashes(df, bits, radius, most_rows)
    both = near.join(own.select(F.col("h").alias("x"), F.col("id").alias("p")), "x").join(own.select(F.col("h").alias("y"), F.col("id").alias("q")), "y")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _blocks(descriptor: Column, parts: int) -> Column:
    """The bits of an array of 64-bit words, each word in so many blocks of nearly equal size."""
    cuts = [k * 64 // parts for k in range(parts + 1)]
    return F.flatten(F.transform(descriptor, lambda d: F.array(*[F.shiftrightunsigned(d, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")) for a, b in itertools.pairwise(cuts)])))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two arrays of whole numbers differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def nearest(df: DataFrame, group: str, key: str, descriptor: str, k: int, radius: int, parts: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """group, a, b, distance: for each key of a group all keys (itself among them) within a distance that holds its k nearest, or within the radius if it
    has fewer there. Exact.

    Descriptors of n words that differ in fewer bits than n * parts agree in one of so many blocks, so a key meets only what shares a block. A key with k
    neighbours nearer than that is done; the others go on with more and smaller blocks. What is left at last meets those of its group whose
    numbers of bits differ by no more than the radius, as otherwise the distance is larger.
    """
    points = written(df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(descriptor).alias("d")))
    left, found = points, []
    for n in parts:
        block = lambda rows, name: rows.select("g", F.col("k").alias(name), F.col("d").alias(f"d_{name}"), F.posexplode(_blocks(F.col("d"), n)).alias("at", "v"))  # noqa: E731, B023
        met = block(left, "a").join(block(points, "b").hint("merge"), ["g", "at", "v"]).select("g", "a", "b", hamming(F.col("d_a"), F.col("d_b")).alias("distance"), (F.size("d_a") * n - 1).alias("sure"))
        near = written(met.where(F.col("distance") <= F.least("sure", F.lit(radius))).select("g", "a", "b", "distance").distinct())
        done = near.groupBy("g", "a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("g", "a")
        # tables of all keys compress well, so Spark takes them for small: without the hint they would be gathered on the driver and broadcast
        found.append(near.join(done.hint("merge"), ["g", "a"], "left_semi"))
        left = written(left.join(done.withColumnRenamed("a", "k").hint("merge"), ["g", "k"], "left_anti"))
        if left.isEmpty():
            break
    else:
        ones = F.aggregate("d", F.lit(0), lambda s, v: s + F.bit_count(v))
        own = lambda rows, name: rows.select("g", F.col("k").alias(name), F.col("d").alias(f"d_{name}"), ones.alias(f"n_{name}"))
        rest = own(left, "a").join(own(points, "b").hint("merge"), "g").where(F.abs(F.col("n_a") - F.col("n_b")) <= radius)
        found.append(rest.select("g", "a", "b", hamming(F.col("d_a"), F.col("d_b")).alias("distance")).where(F.col("distance") <= radius))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("g", group)
