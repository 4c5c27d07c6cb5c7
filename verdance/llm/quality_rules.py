"""Quality rules (operator 9): a short-circuit cascade, ordered by rejection per cost as estimated on a sample. DataFrame
functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: lambda variables are not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, its first occurrence included. Windows are
    sorted as 64-bit numbers, hash above and position below (as many low bits as the text needs); neighbours with equal
    hashes are compared word by word."""

    def of(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n))
        gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", gram(i), bits).bitwiseOR(i.cast("long")))
        high = lambda x: F.call_function("shiftright", x, bits)
        low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same(x: Column, y: Column) -> Column:
            return F.coalesce((high(x) == high(y)) & (F.get(w, low(x)) == F.get(w, low(y))) & (F.get(w, low(x) + 1) == F.get(w, low(y) + 1)) & (F.get(w, low(x) + 2) == F.get(w, low(y) + 2)), F.lit(False))

        def marked(s: Column) -> Column:
            def at(x: Column, k: Column) -> Column:
                return F.when(same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)), low(x))

            return F.sort_array(F.filter(F.transform(s, at), lambda x: x.isNotNull()))

        def covered(m: Column) -> Column:
            steps = F.zip_with(m, F.slice(m, 2, F.greatest(F.size(m), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        return F.when(n > 3, _let(_let(F.sort_array(packed), marked), covered)).otherwise(F.lit(0).cast("long"))

    return _let(words, of)


def base_columns(text: Column) -> dict[str, Column]:
    """Counts that the rules use. A null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(text)
    return {
        "n_words": _let(words, lambda w: F.size(w)).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


#: name -> SQL condition of a document that the rule rejects, over text and the base columns. A rule's condition is
#: never null.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": r"10 * n_dup_lines > 3 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '\n', '')) + 1)",
    "capitals": r"2 * length(regexp_replace(coalesce(text, ''), '[^\\p{Lu}]+', '')) > word_chars",
    "few_letters": r"10 * length(regexp_replace(coalesce(text, ''), '[^\\p{L}]+', '')) < 6 * word_chars",
}


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base columns; columns of docs with these names are replaced."""
    base = base_columns(F.col(text))
    return docs.select(*(c for c in docs.columns if c.lower() not in base), *(v.alias(k) for k, v in base.items()))


#: Work for each character of the text, in steps: of a function that reads it once, and of a regular expression.
READ, MATCH = 1.0, 8.0
#: What a base column takes, in the same steps.
BASE_WORK = {"n_words": MATCH, "word_chars": MATCH, "n_symbols": MATCH, "n_dup_lines": 2 * MATCH, "n_repeat_words": 4 * MATCH}


def work(condition: str, known: Sequence[str] = tuple(BASE_WORK)) -> float:
    """Steps a character that a rule's condition takes beyond the known columns: one READ for each mention of the text, MATCH
    for one in a regular expression, and what the base columns take that are not known."""
    each = len(re.findall(r"\btext\b", condition))
    matched = len(re.findall(r"\bregexp_\w+|\brlike\b", condition))
    return READ * max(each - matched, 0) + MATCH * matched + sum(w for c, w in BASE_WORK.items() if c not in known and re.search(rf"\b{c}\b", condition))


def measure(docs: DataFrame, rules: dict[str, str], sample_rows: int = 2000, text: str = "text", known: Sequence[str] = tuple(BASE_WORK)) -> list[tuple[str, float, float]]:
    """(rule, share of the sample that it rejects, cost) for each rule, on a sample of about sample_rows rows, by a hash of the
    text, in one job. The cost counts steps, work() for each character of the sample's mean text and one for the decision, so
    equal rows give equal costs, whatever the machine does meanwhile. Columns in `known` cost nothing: the cascade's rows have
    them already. Null texts count as empty; an empty table, or one whose sample is empty, gives no shares and equal costs."""
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    row = with_base(sample).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("length"), *(F.count(F.when(F.expr(c), 1)).alias(f"bad{i}") for i, c in enumerate(rules.values()))).first()
    if not row["n"]:
        return [(name, 0.0, 1.0) for name in rules]
    return [(name, row[f"bad{i}"] / row["n"], 1 + work(condition, known) * row["length"]) for i, (name, condition) in enumerate(rules.items())]


def order_rules(measured: Sequence[tuple[str, float, float]]) -> list[str]:
    """Rules by rejection per cost, the highest first."""
    return [name for name, share, cost in sorted(measured, key=lambda x: (-(x[1] + 1e-6) / x[2], x[0]))]


def cascade(docs: DataFrame, order: Sequence[str], rules: dict[str, str] = RULES, result: str = "rejected_by") -> DataFrame:
    """docs (with the base columns) and the first rule in order that rejects each row, null where all pass. Later rules
    are not worked out for a rejected row: over with_base() that saves what a rule needs beyond the base columns, which
    are asked for in every row; over docs alone, with rules that count for themselves, all of it. Which rows are rejected
    does not depend on the order. A column named as the result is replaced."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(F.expr(rules[name]), F.lit(name)).otherwise(verdict)
    return docs.withColumn(result, verdict)
