"""Mixing sources to target weights.

The words of each source, in doc_id order, form one stream that is cut into
blocks of ``BLOCK`` words; the last one may be shorter. A source whose target is T words (rounded) goes through
all of its blocks as often as T has room for, and once more until T words are taken: the
last slot of that pass takes the first words of its block only, so a source takes what its target says, however small.
First the sources' counts in each output shard are drawn: each of a source's slots
falls into a shard by a hash, so the counts follow the multinomial law that adds up to
the totals. Then the slots are numbered, shard after shard, and slot i of a pass takes block
pi(i), where pi is a pseudorandom permutation of the source's block indexes, another one for
each source and pass: a swap-or-not shuffle, whose rounds each swap two indexes, or not, by a keyed
bit of the pair, so it is a bijection for any number of blocks. Slots and blocks
are joined by index; ``mix_shards`` is the mix, and what a document gives to it, and to
how many shards, is summed from its rows. DataFrame operations only.

Targets: the sources, by code point with null last, weigh 5, 2, 1 and so on
again; together they take 150 % of all words. A target stops at twice the
source's size and the excess is shared anew by weight until no target is above.
No block is taken more than twice.

Defined cases: null text has no words and takes part with size 0; an empty
source has target 0; rows that repeat a doc_id are rows of their own, ordered
by size and text; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import WORD_PATTERN, with_starts, written

BLOCK = 32
SHARE = 1.5
MOST = 2
WEIGHTS = (5, 2, 1)
#: Slots of a shard, about, and slots that one row is expanded to while they are drawn.
SHARD_SLOTS, DRAWN = 8192, 16_384
#: Slots that a task permutes, about, and tasks for that at most.
TASK_SLOTS, MOST_TASKS = 65_536, 10_000
#: Rounds of the permutation, and the prime fields and generators of its keys and bits.
ROUNDS, PRIME, OTHER_PRIME, GENERATORS = 12, (1 << 31) - 1, (1 << 31) - 19, (48_271, 69_621)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target and number (_k) from (source, source_size); one row for each source.

    With cap = 2 * size, the shares min(cap, weight * level) must sum to the
    total. Sources are capped in the order of cap / weight; the level follows
    from those that are not. Numbers and sums are made by ranges, so the sources may be many.
    """
    named = with_starts(written(sizes.withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1))), "_one", ["_last", "source"], into="_k").drop("_last", "_one")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_k") % len(WEIGHTS) + 1).cast("int"))
    s = named.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    s = written(s.withColumn("_ratio", F.col("cap") / F.col("weight")))
    s = with_starts(written(with_starts(s, "cap", ["_ratio", "_k"], into="_capped")), "weight", ["_ratio", "_k"], into="_lighter")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # the level if this source and all after it stay below their caps
    s = s.withColumn("_level", (F.lit(SHARE) * F.lit(whole.size or 0) - F.col("_capped")) / (F.lit(whole.weight or 0) - F.col("_lighter")))
    fits = F.struct(F.col("_capped"), F.col("_level"))
    found = s.where(F.col("_level") * F.col("weight") <= F.col("cap")).agg(F.min(fits)["_level"].alias("level")).first().level
    level = F.lit(found).cast("double")
    target = F.when(level.isNull() | (F.col("weight") * level > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", "weight", target.alias("target"), "_k")


def round_constants() -> list[tuple[int, int]]:
    """A pair of constants for each round, from powers of the generators."""
    return [tuple(pow(g, i + 1, PRIME) for g in GENERATORS) for i in range(ROUNDS)]


def round_key(a: str, b: str, n: str, which: str) -> str:
    """SQL of a round's key below n, by its constants; ``which`` numbers the source and the pass."""
    return f"((({which} + 1) * {a} % {PRIME}) * 65536 + ({which} + 1) * {b} % 65536) % {n}"


def _scattered(x: str, a: str, b: str, salt: str) -> str:
    """SQL of a number below OTHER_PRIME that looks random in x and the salt: products modulo two primes."""
    return f"((({x} % {PRIME}) * {a} + {salt} * {b}) % {PRIME}) * {b} % {OTHER_PRIME}"


def round_bit(a: str, b: str, x: str, which: str, div: str = "div") -> str:
    """SQL of a round's bit of the larger index of a pair, x."""
    return f"({_scattered(x, a, b, f'({which} + 1)')}) {div} 32768 % 2 = 1"


def rounds_of(n: str, which: str, inverse: bool = False) -> str:
    """SQL of the rounds of a permutation below n, an array: what a round needs besides the index."""
    constants = round_constants()[::-1] if inverse else round_constants()
    return "array(" + ", ".join(f"struct({round_key(f'{a}L', f'{b}L', n, which)} + {n} as k, {a}L as a, {b}L as b)" for a, b in constants) + ")"


def permuted(index: str, n: str, which: str, inverse: bool = False, rounds: str | None = None) -> str:
    """SQL of pi(index), or of pi's inverse, below n; a round is its own inverse. ``rounds`` is a column that has ``rounds_of``."""
    rounds = rounds or rounds_of(n, which, inverse)
    return f"aggregate({rounds}, cast({index} as bigint), (x, r) -> if({round_bit('r.a', 'r.b', f'greatest(x, (r.k - x) % {n})', which)}, (r.k - x) % {n}, x))"


def shard_of(k: str, j: str, shards: int | str) -> str:
    """SQL of the shard that slot j of the source of number k falls into."""
    a, b = round_constants()[7]
    return f"({_scattered(j, str(a), str(b), f'({k} + 1)')}) % {shards}"


def positions(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """size, and start in the source's stream, of every row; written once, as both the blocks and the result need it."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_h"), *(extra or []))
    return with_starts(written(sized), "size", ["doc_id", "size", "_h"], keys=["source"])


def plan_slots(totals: DataFrame) -> DataFrame:
    """Add blocks, full (passes over all blocks), rest (words of the pass after them), short (where that pass meets the last block) and slots."""
    t = totals.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)).withColumn("_want", F.least(F.round("target").cast("long"), MOST * F.col("source_size")))
    t = t.withColumn("full", F.when(F.col("source_size") > 0, F.expr("_want div source_size")).otherwise(0)).withColumn("rest", F.col("_want") - F.col("full") * F.col("source_size"))
    t = t.withColumn("_gap", F.col("blocks") * BLOCK - F.col("source_size")).withColumn("_last", F.col("blocks") - 1)
    t = t.withColumn("short", F.expr(permuted("_last", "greatest(blocks, 1)", "(_k * 2 + full)", inverse=True)))
    # one slot more where the last block comes early and leaves too few words
    need = F.ceil(F.col("rest") / BLOCK)
    more = (F.col("short") < need) & (need * BLOCK - F.col("_gap") < F.col("rest"))
    return t.withColumn("slots", F.col("full") * F.col("blocks") + need + more.cast("long")).drop("_want", "_last")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The slots (source, pass, block, words, shard, slot) of the mix, and every row's place (doc_id, source, size, start, source_size, target)."""
    placed = written(positions(docs))
    totals = written(plan_slots(source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")))))
    whole = totals.agg(F.sum("slots").alias("n")).first().n or 0
    shards, tasks = max(1, -(-whole // SHARD_SLOTS)), min(MOST_TASKS, max(1, -(-whole // TASK_SLOTS)))

    # 1. each source's counts in the shards: its slots are drawn, some thousands from a row
    runs = totals.where("slots > 0").select("_k", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / DRAWN))).alias("_c")).repartition("_k", "_c")
    drawn = runs.select("_k", F.explode(F.sequence(F.col("_c") * DRAWN, F.least((F.col("_c") + 1) * DRAWN, F.col("slots")) - 1)).alias("_i"))
    counts = drawn.groupBy("_k", F.expr(shard_of("_k", "_i", shards)).alias("shard")).agg(F.count("*").alias("n"))

    # 2. slots are numbered shard after shard and mapped through the permutation of their source and pass
    before = Window.partitionBy("_k").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_from", F.sum("n").over(before) - F.col("n")).join(totals.select("source", "_k", "blocks", "full", "rest", "short", "_gap"), "_k")
    # few rows become many slots: their number of tasks follows the slots, not the rows
    slots = counts.repartition(tasks, "_k", "shard").withColumns({f"_r{p}": F.expr(rounds_of("blocks", f"(_k * 2 + {p})")) for p in range(MOST)}).withColumn("slot", F.explode(F.sequence("_from", F.col("_from") + F.col("n") - 1))).withColumn("pass", F.expr("slot div blocks"))
    slots = slots.withColumn("_i", F.expr("slot % blocks")).withColumn("block", F.expr(permuted("_i", "blocks", "(_k * 2 + pass)", rounds="if(pass = 0, _r0, _r1)")))
    length = F.lit(BLOCK) - F.when(F.col("block") == F.col("blocks") - 1, F.col("_gap")).otherwise(0)
    left = F.col("rest") - F.col("_i") * BLOCK + F.when(F.col("short") < F.col("_i"), F.col("_gap")).otherwise(0)
    slots = slots.withColumn("words", F.when(F.col("pass") < F.col("full"), length).otherwise(F.least(length, left)))
    known = totals.select(F.col("source").alias("_s"), "source_size", "target")
    return slots.select("source", "pass", "block", "words", "shard", "slot"), placed.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix_shards(slots: DataFrame, placed: DataFrame) -> DataFrame:
    """The mix: a row for each slot and each row of docs with taken words in its block: shard, slot, pass, block, words and the row's columns."""
    # both sides grow with the data, and slots shuffle to few bytes: they must not be taken for a small table
    taken = slots.withColumnsRenamed({"source": "_s", "block": "_b", "words": "_w"}).hint("merge")
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), last)))
    met = parts.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    words = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("_w")) - F.greatest(F.col("start"), F.col("block") * BLOCK)
    return met.withColumn("words", words).where("words > 0").drop("_s", "_b", "_w")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and shards (how many have words of it) of every row of docs."""
    slots, placed = mix(docs)
    # start and size name a row with words: no two such rows of a source start alike
    sums = mix_shards(slots, placed).groupBy(F.col("source").alias("_s"), F.col("start").alias("_at")).agg(F.sum("words").alias("_taken"), F.size(F.collect_set("shard")).alias("_shards"))  # a row's own blocks
    joined = placed.join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_at")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("_shards", F.lit(0)).cast("long").alias("shards"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row keeps the words of its taken blocks, those of a second pass after those of the first.

    A row of which nothing is taken goes. All columns of docs stay; n_chars, where
    there is one, is counted anew.
    """
    slots, placed = mix(docs)
    place = mix_shards(slots, placed).groupBy("doc_id", "source", "size", "start", "_h").agg(F.sort_array(F.collect_list(F.struct("block", "pass", "words"))).alias("_got"))
    # a row's own blocks: their number follows its length; equal rows are paired off by number
    twin = Window.partitionBy("_d", "_s", "_t").orderBy("_n")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_t"), F.lit(0).alias("_n"))
    rows = rows.withColumn("_n", F.row_number().over(twin))
    parts = place.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_h").alias("_t"), F.col("start").alias("_n"), F.col("start").alias("_at"), "_got")
    parts = parts.withColumn("_n", F.row_number().over(twin)).withColumnsRenamed({"_d": "_d2", "_s": "_s2", "_t": "_t2", "_n": "_n2"})
    on = F.col("_d").eqNullSafe(F.col("_d2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_t") == F.col("_t2")) & (F.col("_n") == F.col("_n2"))
    joined = rows.join(parts.hint("merge"), on).withColumn("_w", F.expr(r"regexp_extract_all(_row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)"))
    piece = f"slice(_w, cast(greatest(b.block * {BLOCK} - _at, 0) + 1 as int), cast(b.words as int))"
    passes = ", ".join(f"array_join(flatten(transform(filter(_got, b -> b.pass = {n}), b -> {piece})), '')" for n in range(MOST))
    mixed = joined.withColumn("_text", F.expr(f"array_join(filter(array({passes}), x -> x <> ''), '\n')"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return mixed.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
