"""Filter interaction audit (operator 12): which documents five filters fail, alone, together and in every order. A later
copy is found by an existential self-join; everything else is one pass over the texts and sums over 32 combinations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

LETTERS = "ABCDE"
COPY = 16  # the bit of E
#: Hashes with copies up to which they are broadcast to the scan of the texts; beyond, both are shuffled.
MAX_SHARED = 1 << 20
#: Rows of one hash that go to one task of the self-join.
ROWS_A_TASK = 4096
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"


def _bits(text: bytes) -> int:
    """Failures of the filters that need the text alone: A 1, B 2, C 4, D 8."""
    words = text.split()  # bytes split at the six white-space bytes of ASCII alone
    out = int(len(words) < 100)
    if 100 * len(set(words)) < 80 * len(words):
        out |= 2
    points = len(text) - len(text.translate(None, bytes(range(128)) + bytes(range(192, 256))))  # without continuation bytes
    if 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * points:
        out |= 4
    if len(text.translate(None, _SYMBOLS)) < len(text):
        out |= 8
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_of(batch.column("text"))
        raw, at = memoryview(data), offs.tolist()
        bits = pa.array([_bits(bytes(raw[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int32())
        copied = batch.column("copies").is_valid()
        text = pa.compute.if_else(copied, batch.column("text"), pa.scalar(None, batch.column("text").type))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("hash"), batch.column("copies"), bits, text], ["id", "part", "hash", "copies", "bits", "text"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row a document: id, part, hash, copies (rows with its hash, where ids differ among them; else null), bits of A to
    D, and the text of those with copies. Null texts are empty, null parts the empty string."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("hash", F.xxhash64("text"))
    shared = source.groupBy("hash").agg(F.count("*").alias("copies"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    shared = written(shared.select("hash", "copies"))
    found = F.broadcast(shared) if shared.limit(MAX_SHARED + 1).count() <= MAX_SHARED else shared
    kind = f"id {source.schema['id'].dataType.simpleString()}, part string, hash long, copies long, bits int, text string"
    return source.join(found, "hash", "left").select("id", "part", "hash", "copies", "text").mapInArrow(_judge, kind)


def later_copies(judged: DataFrame) -> DataFrame:
    """The rows for which a row of a smaller id has the identical text: left-semi join on hash, exact text and smaller id.
    The smallest id of each text stands for the right side, and both are dealt over one task for each ROWS_A_TASK rows of a
    hash, so a hot text is no hot task. A null id is neither smaller nor has smaller ones."""
    tasks = F.ceil(F.col("copies") / ROWS_A_TASK).cast("int")
    left = judged.where("copies is not null").withColumn("salt", F.pmod(F.xxhash64("id"), tasks).cast("int"))
    right = left.groupBy(F.col("hash").alias("hash_"), F.col("text").alias("text_")).agg(F.min("id").alias("first"), F.max("copies").alias("copies"))
    right = right.select("hash_", "text_", "first", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt_"))
    same = (F.col("hash") == F.col("hash_")) & (F.col("salt") == F.col("salt_")) & (F.col("text") == F.col("text_")) & (F.col("first") < F.col("id"))
    return left.join(right, same, "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows, good rows (quality 1) and toxic rows (toxic 1) of each part and combination of failures: part, bits, n, good,
    toxic. The ids of later copies are united with those of all rows: each counts once more with E and once less without.
    A row is good or toxic if any label row of its id says so; ids without labels are neither."""
    judged = written(judge(docs, id_col, text_col, part_col))
    every = judged.select("id", "part", "bits", F.lit(1).alias("w"))
    copies = later_copies(judged).select("id", "part", F.explode(F.array(F.struct("bits", F.lit(-1).alias("w")), F.struct((F.col("bits") + COPY).alias("bits"), F.lit(1).alias("w")))).alias("x"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(f"is_{c}") for c in ("quality", "toxic")))
    united = every.unionByName(copies.select("id", "part", "x.bits", "x.w")).join(marks, "id", "left")
    total = lambda c: F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0)))
    return united.groupBy("part", "bits").agg(F.sum("w").alias("n"), total("is_quality").alias("good"), total("is_toxic").alias("toxic")).where("n > 0")


def interactions(combos: DataFrame) -> DataFrame:
    """One row a part, order of the five letters and step: see audit. Of a step only its filter and the set of those before
    it matter, so the sums are made for the 80 pairs of them and handed to the 600 steps of all orders."""
    n = len(LETTERS)
    pairs = [(i, before) for i in range(n) for before in range(1 << n) if not before >> i & 1]
    pair = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(1 << i).alias("bit"), F.lit(b).alias("before")) for i, b in pairs))).alias("p")
    fails = F.col("bits").bitwiseAND(F.col("p.bit")) != 0
    passed = F.col("bits").bitwiseAND(F.col("p.before")) == 0
    put = lambda where, col="n": F.sum(F.when(where, F.col(col)).otherwise(0))
    sums = combos.select("*", pair).groupBy("part", "p").agg(
        put(passed & ~fails).alias("kept"), put(passed & fails).alias("removed"), put(~passed & fails).alias("redundant"),
        put(F.col("bits") == F.col("p.bit")).alias("unique_fails"),
        put(passed & fails, "good").alias("good_lost"), put(passed & fails, "toxic").alias("toxic_lost"),
    )
    orders: dict[tuple[int, int], list[tuple[str, int]]] = {p: [] for p in pairs}
    for order in permutations(range(n)):
        for step, i in enumerate(order):
            orders[i, sum(1 << k for k in order[:step])].append(("".join(LETTERS[k] for k in order), step + 1))
    steps = combos.sparkSession.createDataFrame([(i, b, *x) for (i, b), of in orders.items() for x in of], "i int, before int, filter_order string, step int")
    weights = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("p.before") + 1)
    shapley = sums.groupBy("part", F.col("p.i").alias("i")).agg(F.sum(F.col("removed") * weights).alias("shapley"))
    out = sums.select("part", "p.*", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost").join(shapley, ["part", "i"]).join(F.broadcast(steps), ["i", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For every part (value of part_col), order of the filters (all 120) and step: documents kept after the step, removed
    by it, redundant (they fail its filter but were removed before), unique_fails (they fail its filter alone), good_lost and
    toxic_lost (removed and labelled so), and shapley (what its filter removes, summed over all orders).

    A: under 100 words. B: 100 * different words < 80 * words. C: 100 * capitals A-Z > 10 * code points. D: holds one of
    #$%&*|. E: the text of a smaller id, anywhere in the table, is identical. Null texts are empty. Rows count one by one,
    those with null or repeated ids too; an empty table has no parts."""
    return interactions(combinations(docs, labels, id_col, text_col, part_col))
