"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, hashed_sample, stored, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Words of a window in which different words are counted.
WINDOW = 100


def with_base_counts(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long, of every whole text; keep: also _words and _lines, the arrays that rules read.

    A null or empty text counts 0 everywhere. Columns of these names that the input has are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", words_of(body)).withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)))
    # Three-word windows; a word holds no blank, so joining with blanks is unambiguous.
    three = F.when(
        F.size("_words") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("_words") - 2), lambda i: F.concat_ws(" ", F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1))),
    ).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_three", three).withColumn("_some", F.size(F.array_distinct("_three")) < F.size("_three"))
    # Sorted with their places, equal windows are neighbours.
    placed = F.when(F.col("_some"), F.sort_array(F.transform("_three", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    out = out.withColumn("_placed", placed)
    twice = F.filter("_placed", lambda x, i: x.w.eqNullSafe(F.get("_placed", i - 1).w) | x.w.eqNullSafe(F.get("_placed", i + 1).w))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.size(covered),
    }
    out = out.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_three", "_some", "_placed")
    return out if keep else out.drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` is true; it may read the base counts, the text, and the arrays _words and _lines, and is evaluated only where no rule before it rejects.

    work: what the rule reads of a document beyond the base counts, in characters or array elements, plus 1 for
    the comparison. cost is its mean on a sample and rejected the share of the sample that the rule rejects.
    """

    name: str
    rejects: Column
    work: Column | None = None
    cost: float = 1.0
    rejected: float = 0.0

    @property
    def rank(self) -> float:
        return self.rejected / self.cost


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules beside the base: whole-number ratios, so that every engine decides alike.

    few_different_words adds up the different words of every WINDOW words, so it does not depend on how long a text is.
    """
    n, body = F.col("n_words"), F.coalesce(F.col(text), F.lit(""))
    different = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / WINDOW).cast("int")), F.lit(0), lambda s, i: s + F.size(F.array_distinct(F.slice("_words", i * WINDOW + 1, F.lit(WINDOW)))))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 25 * n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.size("_lines")),
        Rule("shouting", 2 * F.char_length(F.regexp_replace(body, r"[^!]+", "")) > n, F.char_length(body)),
        Rule("few_different_words", (n > 0) & (3 * different < n), F.size("_words")),
    ]


def ordered_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejection per cost on a sample with base counts and arrays, highest first; ties by cost, then name.

    One aggregate gives rates and costs, over the rows that pass the base, as only those reach the rules.
    Cost is counted work, not time, so the order is the same on every run. It changes how much
    work the cascade does, never which documents it keeps.
    """
    # Not a filter: it would be pushed below the projections that build the counts and copy their expressions into each other.
    reached = lambda x: F.avg(F.when(F.col("_reached"), x.cast("double")))
    costs = [reached(F.lit(1) + (F.lit(0) if r.work is None else r.work)).alias(f"c{i}") for i, r in enumerate(rules)]
    rates = [reached(F.coalesce(r.rejects, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    found = sample.withColumn("_reached", ~base_failed()).agg(F.count_if("_reached").alias("n"), *costs, *rates).first()
    if not found["n"]:
        return sorted(rules, key=lambda r: r.name)
    measured = [replace(r, cost=found[f"c{i}"], rejected=found[f"r{i}"]) for i, r in enumerate(rules)]
    return sorted(measured, key=lambda r: (-r.rank, r.cost, r.name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does. CASE stops at the first true branch, so later rules are not evaluated."""
    out = F
    for r in rules:
        out = out.when(r.rejects, F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Every input row with the base counts, base_failed, kept and rejected_by.

    Null and empty texts have no words and fail the base; repeated rows are judged one by one; an
    empty table gives an empty result. Rules are ordered on at most sample_rows rows, chosen by a hash of the whole row, so
    reruns and other partitions choose alike; equal ranks go by name. Input columns named like an output column, or _words, _lines, _three, _some or _placed, are replaced or dropped.
    A text is judged in one task; its words and three-word windows take some 30 bytes of memory a byte.
    """
    counted = with_base_counts(docs, text, keep=True)
    rules = default_rules(text) if rules is None else rules
    if rules:
        chosen = hashed_sample(docs.select(F.col(text).alias(text), F.xxhash64(*docs.columns).alias("_key")), "_key", sample_rows)
        rules = ordered_rules(with_base_counts(stored(chosen, "rule-sample"), text, keep=True), rules)
    named = F.when(base_failed(), F.lit("base")).otherwise(cascade(rules) if rules else F.lit(None).cast("string"))
    return counted.withColumns({"base_failed": base_failed(), "rejected_by": named}).drop("_words", "_lines").withColumn("kept", F.col("rejected_by").isNull())


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS tri
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g) WHERE c > 1
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY rid
), b AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaims,
         list_sum(list_transform(range(0, (len(words) + 99) // 100), lambda i: len(list_distinct(words[i * 100 + 1:i * 100 + 100])))) AS n_different
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 2 * n_dup_lines > n_lines OR 2 * n_exclaims > n_words OR coalesce(3 * n_different < n_words, false)) AS kept
FROM f
"""
