"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean column over measures of the text. On a bounded sample
the cost (time of a pass) and the selectivity (share rejected) of each rule are
estimated; the cascade then asks the rules in order of rejections per cost, and
a row that one rule rejects is not put to the next: the rules are branches of
one CASE, and each branch computes only the measures it needs. The order never
changes which rows are rejected, only the work. ``judge`` reports some measures
of every row; those that only rules need stay inside the branches.

Defined results: null text has no words, symbols or lines and fails the base
rule; rows are judged one by one; extra columns are untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD

#: Rows of the sample on which costs and selectivities are estimated, and timed passes over it.
SAMPLE_ROWS = 1_000
PASSES = 3
#: Measures that ``judge`` reports of every row.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GRAM = 5
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named reason to reject; ``reject`` maps the measures to a Boolean column."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


BASE = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
)
RULES = (
    Rule("symbols", lambda m: 5 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda m: (m["word_chars"] > 15 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
    Rule("duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("capitals", lambda m: 2 * m["n_capitals"] > m["n_letters"]),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words inside a ``gram``-word window that is found twice or more in ``words``.

    Window hashes without a repeat prove that there is none; otherwise the windows
    themselves are sorted, so the count is exact.
    """
    windows = F.size(words) - (gram - 1)
    hashes = F.transform(_places(windows), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(gram))))

    def exact(ordered: Column) -> Column:
        n = F.size(ordered)

        def same(a: Column, b: Column) -> Column:
            return F.get(ordered, a)["g"] == F.get(ordered, b)["g"]

        repeats = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & F.coalesce(same(k, k - 1), F.lit(False))) | ((k < n - 1) & F.coalesce(same(k, k + 1), F.lit(False))))
        places = F.sort_array(F.transform(repeats, lambda k: F.get(ordered, k)["i"]))
        start = F.struct(F.lit(-gram).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(gram), p - a["last"])).alias("total")), lambda a: a["total"])

    grams = F.sort_array(F.transform(_places(windows), lambda i: F.struct(F.array_join(F.slice(words, i + 1, gram), " ").alias("g"), i.alias("i"))))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(grams, exact)))


def measures(text: Column, words: Column | None = None) -> dict[str, Column]:
    """The measures of a text column; ``words`` if its words are at hand as a column."""
    text = F.coalesce(text, F.lit(""))
    given = words is not None
    words = words if given else F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long") if given else F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)) if given else (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words) if given else _let(words, lambda w: repeated_words(w)),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")).cast("long"),
    }


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, estimated on at most ``sample_rows`` rows."""
    sample = docs.select(F.col(text_col).alias("text")).limit(sample_rows).repartition(1).cache()
    try:
        n = sample.count()
        if not n:
            return list(rules)
        own = measures(F.col("text"))

        def seconds(column: Column) -> tuple[float, int]:
            best, hits = float("inf"), 0
            for _ in range(PASSES):  # the first also compiles
                began = time.perf_counter()
                hits = sample.agg(F.coalesce(F.sum(column.cast("int")), F.lit(0))).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        idle = seconds(F.col("text").isNull())[0]
        scored = []
        for at, rule in enumerate(rules):
            took, hits = seconds(rule.reject(own))
            scored.append((-(hits + 0.5) / n / max(took - idle, 1e-4), at, rule))
        return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def rejected_by(rules: list[Rule], own: dict[str, Column]) -> Column:
    """The first rule that rejects, else null; later rules are not computed."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject(own), F.lit(rule.name)).otherwise(out)
    return out


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns as they are. No shuffle."""
    ordered = order_rules(docs, rules, text_col)
    return docs.where(rejected_by(ordered, measures(F.col(text_col))).isNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the reported measures, base_failed, kept, and rejected_by (of the rules after the base). No shuffle."""
    ordered = order_rules(docs, RULES, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    own = measures(F.col("text"), F.col("words"))
    rows = rows.select("id", "text", *(own[k].alias(k) for k in REPORTED))
    own = measures(F.col("text")) | {k: F.col(k) for k in REPORTED}
    failed = BASE[0].reject(own) | BASE[1].reject(own)
    rows = rows.withColumn("base_failed", failed).withColumn("rejected_by", F.when(~F.col("base_failed"), rejected_by(ordered, own)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("text").withColumnRenamed("id", id_col)
