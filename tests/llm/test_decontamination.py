import random
import re

from pyspark.sql import functions as F

from verdance.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(0, len(w) - width) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for s in range(len(w)):
            for n in range(1, width + 1):
                if s + n <= len(w) and (found := windows.get(tuple(w[s : s + n]))):
                    hit |= set(range(s, s + n))
                    ids |= found
        out[d] = (len(w), len(hit), len(ids))
    return out


def corpus():
    rng = random.Random(5)
    vocab = ["a", "b", "C", "dd", "E1", "ñu", "ΣΑΣ", "σας", "Ünder", "K", "\u212a", "\u0130", "i\u0307", "好", "\U0001d518x", "9"]
    between = [" ", "\n", ", ", "\x00", "--", "\t ", "_", "\x7f", "[`"]
    items = [(i, "".join(rng.choice(vocab) + rng.choice(between) for _ in range(rng.choice([2, 3, 5, 9, 10, 11, 25])))) for i in range(40)]
    items += [(100, "好"), (101, " .Zz. "), (102, "a " * 30), (103, ""), (104, None), (105, items[0][1])]
    docs = [(0, None), (1, ""), (2, " .\x00 "), (3, "a"), (4, "zz"), (5, "a " * 12), (6, "  好  ")]
    for i in range(7, 90):
        parts = ["".join(rng.choice(vocab) + rng.choice(between) for _ in range(rng.randrange(30))) for _ in range(2)]
        docs.append((i, parts[0] + (rng.choice(items)[1] or "") + rng.choice(["", " tail", " "]) + parts[1]))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert sum(h > 0 for _, h, _ in want.values()) > 50 and want[6] == (1, 1, 1)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.decontaminate(d, b).collect()}
    assert got == want
    pairs = [(i, t) for i, t in items if len(words(t)) != 1]  # no item of one word: pairs alone are indexed
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.decontaminate(d, spark.createDataFrame(pairs, ITEMS)).collect()}
    assert got == brute(docs, pairs)


def test_lists_that_are_not_broadcast(spark):
    docs, items = corpus()
    c = decontamination.keyed(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    phrases = decontamination.phrases_of(spark.createDataFrame(items, ITEMS), 10)
    found, lengths = decontamination.search(c, phrases, max_broadcast=0)
    want = brute(docs, items)
    assert {r.k: r.n for r in found.select(F.col("__id").alias("k"), decontamination.covered(F.col("found")).alias("n")).collect()} == {k: h for k, (_, h, _) in want.items() if h}
    assert {r[0]: r[2] for r in lengths.collect()} == {k: n for k, (n, _, _) in want.items()}


def test_texts_are_read_once_and_candidates_once_more(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    docs, items = corpus()
    d = spark.createDataFrame(docs, DOCS).select("doc_id", F.udf(told, "string")("text").alias("text"))
    assert decontamination.decontaminate(d, spark.createDataFrame(items, ITEMS)).count() == len(docs)
    assert seen.value <= 2 * len(docs)
