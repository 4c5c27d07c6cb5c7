"""Benchmark decontamination (operator 5): a distributed positional inverted index. DataFrame functions only.

Terms are pairs of neighbouring words. Postings of the corpus are stored for the benchmark's terms in one pass over the
texts; the offset-adjusted lists of the rarest terms are intersected from the rarest on, and what is left is compared word
by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def exact_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, nothing else. All that lies between words becomes
    spaces, as a split at one character takes a quarter of the time of a pattern."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def key_columns(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """__id and __sub, a key for each different row. __sub is 0 if the ids are unique, else a hash of the text."""
    ids = docs.select(F.col(key).cast("long").alias("k"))
    unique = ids.groupBy("k").count().where("count > 1 or k is null").limit(1).count() == 0
    sub = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("__id"), sub.alias("__sub")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__id, __sub, __text of every row."""
    return docs.select(*key_columns(docs, key, text), F.col(text).alias("__text"))


def phrases_of(items: DataFrame, width: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """phrase array<string>, items (ids, nulls left out): every run of width words of an item, or all its words if it has
    fewer."""
    words = items.select(F.col(key).alias("item"), exact_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    run = F.least(F.lit(width), F.size("w"))
    windows = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - run), lambda i: F.slice("w", i + 1, run))).alias("phrase"))
    return windows.groupBy("phrase").agg(F.collect_set("item").alias("items"))


def terms_of(phrase: Column) -> Column:
    """The terms of a phrase by offset: 64-bit hashes of its pairs of neighbouring words, or of its only word."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(phrase) - 2), lambda i: F.xxhash64(phrase[i], phrase[i + 1]))
    return F.when(F.size(phrase) > 1, pairs).otherwise(F.array(F.xxhash64(phrase[0])))


def occurrences(corpus: DataFrame, lone: bool) -> DataFrame:
    """__id, __sub, term, pos, last of each pair of neighbouring words in corpus(__id, __sub, __text), and with lone of each
    single word. Each text ends in a row that is last: its pos is the number of words, its term says nothing."""
    words = corpus.select("__id", "__sub", F.array_append(exact_words(F.col("__text")), "").alias("w"))
    # outer, though no array is empty: for the other Spark adds a filter by size, which splits each text a second time
    at = words.select("__id", "__sub", "w", F.posexplode_outer("w").alias("pos", "word")).withColumn("last", F.col("word") == "")
    pair, end = F.xxhash64("word", F.get("w", F.col("pos") + 1)), F.col("__id")
    if not lone:
        return at.select("__id", "__sub", F.when(F.col("last"), end).otherwise(pair).alias("term"), "pos", "last")
    terms = F.when(F.col("last"), F.array(end)).otherwise(F.array(pair, F.xxhash64("word")))
    return at.select("__id", "__sub", F.explode_outer(terms).alias("term"), "pos", "last")


def postings(corpus: DataFrame, terms: DataFrame, lone: bool, max_terms: int) -> DataFrame:
    """Of the occurrences those of the given terms and the ends of the texts."""
    wanted = small(terms.select("term", F.lit(True).alias("wanted")), max_terms)
    return occurrences(corpus, lone).join(wanted, "term", "left").where("wanted or last").select("__id", "__sub", "term", "pos", "last")


def search(corpus: DataFrame, phrases: DataFrame, anchors: int = 3, max_broadcast: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Two tables. __id, __sub and found (array of struct(start, length, items)) for each corpus row with an exact
    occurrence of a phrase; __id, __sub and n_words of every corpus row. phrases as from phrases_of; they and the list of
    candidate documents are broadcast up to max_broadcast rows, the list of terms, which are one number each, up to four
    times as many, and shuffled beyond."""
    phrases = written(phrases.withColumn("phrase_id", F.xxhash64("phrase")))
    lone = phrases.where(F.size("phrase") == 1).limit(1).count() > 0
    places = phrases.select("phrase_id", F.posexplode(terms_of(F.col("phrase"))).alias("offset", "term"))
    terms = written(places.select("term").distinct())
    stored = written(postings(corpus, terms, lone, 4 * max_broadcast))
    index = stored.where("not last").drop("last")
    counts = written(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    # the rarest terms of each phrase; a phrase with a term that the corpus lacks can't occur
    ranked = places.join(counts, "term", "left").groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("t")).where("t[0].n > 0")
    chosen = written(ranked.select("phrase_id", *(F.get("t", F.lit(k)).alias(f"a{k}") for k in range(anchors))))
    wanted = written(chosen.select(F.explode(F.array(*(F.col(f"a{k}.term") for k in range(anchors)))).alias("term")).where("term is not null").distinct())
    listed = index.join(small(wanted, 4 * max_broadcast), "term", "left_semi")
    at = chosen.select("phrase_id", "a0.term", F.col("a0.offset").alias("offset"), *(f"a{k}" for k in range(1, anchors)))
    hits = listed.join(small(at, max_broadcast), "term").select("__id", "__sub", "phrase_id", (F.col("pos") - F.col("offset")).alias("start"), *(f"a{k}" for k in range(1, anchors))).where("start >= 0")
    for k in range(1, anchors):
        other = listed.select(F.col("__id").alias("i"), F.col("__sub").alias("s"), F.col("term").alias("t"), F.col("pos").alias("p"))
        now, done = hits.where(f"a{k} is not null"), hits.where(f"a{k} is null")
        match = (F.col("__id") == F.col("i")) & (F.col("__sub") == F.col("s")) & (F.col(f"a{k}.term") == F.col("t")) & (F.col("start") + F.col(f"a{k}.offset") == F.col("p"))
        hits = now.join(other, match, "left_semi").unionByName(done)
    hits = written(hits.select("__id", "__sub", "start", "phrase_id"))
    asked = hits.join(small(phrases.select("phrase_id", "phrase", "items"), max_broadcast), "phrase_id").groupBy("__id", "__sub").agg(F.collect_set(F.struct("start", "phrase", "items")).alias("cand"))
    ids = written(hits.select("__id", "__sub").distinct())
    texts = corpus.join(small(ids, max_broadcast), ["__id", "__sub"], "left_semi")
    right = F.filter("cand", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["phrase"])) == c["phrase"])
    checked = texts.withColumn("w", exact_words(F.col("__text"))).drop("__text").join(asked, ["__id", "__sub"])
    found = checked.select("__id", "__sub", F.transform(right, lambda c: F.struct(c["start"].alias("start"), F.size(c["phrase"]).alias("length"), c["items"].alias("items"))).alias("found"))
    lengths = stored.where("last").select("__id", "__sub", F.col("pos").cast("long").alias("n_words"))
    return found.where(F.size("found") > 0).dropDuplicates(["__id", "__sub"]), lengths


def covered(found: Column) -> Column:
    """Number of words inside any of the found occurrences."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(x["start"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], x["start"] + x["length"]).alias("end"))
    return F.aggregate(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per document: key, n_words, n_hit (words inside an occurrence of an item's window), n_items and
    items_sha256 (of the sorted ids of the items with such windows), contaminated. Null and empty texts have no words;
    an item without an id counts for n_hit but is not listed. Repeated rows are judged each by their own text."""
    corpus = keyed(docs, key, text)
    found, counted = search(corpus, phrases_of(items, width, item_key, "text"))
    ids = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("found", lambda x: x["items"])), lambda x: x.cast("string"))))
    hit = found.select("__id", "__sub", covered(F.col("found")).alias("n_hit"), ids.alias("item_ids"))
    out = counted.join(hit, ["__id", "__sub"], "left")
    listed = F.coalesce("item_ids", F.array().cast(T.ArrayType(T.StringType())))
    return out.select(
        F.when(F.col("__id") != -(1 << 63), F.col("__id")).alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", max_broadcast: int = 1_000_000) -> DataFrame:
    """docs without the rows in which a window of an item occurs."""
    number, sub = key_columns(docs, key, text)
    found = written(search(docs.select(number, sub, F.col(text).alias("__text")), phrases_of(items, width, item_key, "text"))[0].select("__id", "__sub"))
    packed = docs.select(F.struct("*").alias("row"), number, sub)  # no column of docs meets one of ours
    return packed.join(small(found, max_broadcast), ["__id", "__sub"], "left_anti").select("row.*")


def proximity(docs: DataFrame, queries: DataFrame, within: int, key: str = "doc_id", text: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """key, query, start, end: the places where all the different words of a query (queries(query, text)) lie within
    `within` consecutive words of a document, in any order; one row for each last word of such a place."""
    wanted = queries.select("query", F.array_distinct(exact_words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    terms = wanted.select("query", F.size("w").alias("need"), F.explode("w").alias("term"))
    numbered = docs.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"), exact_words(F.col(text)).alias("__words"))
    post = numbered.select("__key", "__row", F.posexplode("__words").alias("pos", "term"))
    both = post.join(small(terms, max_broadcast), "term")
    near = Window.partitionBy("__row", "__key", "query").orderBy("pos").rangeBetween(-(within - 1), 0)
    seen = both.withColumn("got", F.size(F.collect_set("term").over(near))).withColumn("start", F.min("pos").over(near))
    return seen.where("got = need").select(F.col("__key").alias(key), "query", "start", F.col("pos").alias("end"))
