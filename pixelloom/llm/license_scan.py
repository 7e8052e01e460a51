"""License scan: sentences map to known identifiers, and identifier sequences match ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import IDENTIFIERS, NEGATIONS, REFERENCES, RULES, SENTENCES

#: A sentence ends at . ! ? before white space, or at a line without letters and digits; a single line break may only wrap it.
#: An expression of licence identifiers after its tag, as far as it is well formed.
_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
EXPRESSION = rf"(?i)SPDX-License-Identifier:[ \t]*(\(*{_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{_ID}\)*)*)"
#: What stands in an expression beside licences: operators, an exception and its operator, brackets, versions.
BESIDE = r"(?i)[ \t]+WITH[ \t]+[^ \t()]+|[()]"
VERSION = r"(?i)(-only|-or-later|\+)$"
#: Marks identifiers that come from an expression.
NAMED = "spdx:"
TAG = "spdx-license-identifier"
SENTENCE_END = r"[.!?]+(?:[ \t\n\r\f]+|$)|\n[^\p{L}\p{Nd}\n]*\n"


def normal(sentence: str) -> str:
    """Normal form: lower case, runs of other characters than letters and decimal digits as one blank."""
    return " ".join("".join(c if c.isalpha() or c.isdecimal() else " " for c in sentence.lower()).split())


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{Nd}]+", " "))


def parsed(sentences: dict[str, str]) -> list[tuple[str, list[str], bool]]:
    """(identifier, parts in order, whether the sentence may go on) of every sentence with a word."""
    out = []
    for name, s in sentences.items():
        parts = [p for p in map(normal, s.split("...")) if p]
        if parts:
            out.append((name, parts, s.rstrip().endswith("...")))
    return out


def anchors(sentences: list[list[str]]) -> list[str]:
    """Few words of which every sentence, given by its words, has one, perhaps within a longer word: long ones, as these are rare in other texts, and of them the word of most sentences first."""
    left, out = list(sentences), []
    has = lambda s, w: any(w in x for x in s)
    while left:
        found = max({w for s in left for w in s}, key=lambda w: (min(len(w), 7), sum(has(s, w) for s in left), w))
        out.append(found)
        left = [s for s in left if not has(s, found)]
    return out


def negated(reference: str) -> str:
    """Pattern of a normalised sentence that denies a reference: a negation up to three words before it."""
    return rf"(^| )({'|'.join(NEGATIONS)})( [^ ]+){{0,3}} {re.escape(reference)}( |$)"


def expressed(line: Column) -> Column:
    """Marked identifiers of the licence expression of a line, in order, without repeats; empty where there is none."""
    known = F.create_map(*(F.lit(x) for i in IDENTIFIERS for x in (i.lower(), NAMED + i)))
    bare = F.regexp_replace(F.regexp_extract(line, EXPRESSION, 1), BESIDE, "")
    words = F.filter(F.split(bare, r"[ \t]+"), lambda w: ~F.upper(w).isin("AND", "OR"))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(known, F.lower(F.regexp_replace(w, VERSION, "")))), lambda x: x.isNotNull()))


def license_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, references: list[str] | None = None
) -> DataFrame:
    """Per input row: key, n_sentences known, sequence (identifiers in order), licenses (sorted, distinct), license_list (comma-joined).

    Sentences are cut at punctuation and blank lines and compared in normal form, so wrapped lines, comment marks and quotes
    don't matter. A sentence that isn't known is looked at line by line, for licence lines that follow others without a stop. A known sentence
    that ends in "..." is recognised by its opening words (and what it names after them); one listed in `references` also inside a longer sentence.
    Of several known sentences that fit, references come last and otherwise the longer opening wins; a reference that is denied just before is none. A rule matches
    where its identifiers follow each other in the sequence of known sentences. A line with an SPDX expression names each of its licences itself.

    Only texts with a word of a known sentence are cut at all. Null and empty texts hold none; repeated rows are scanned one by one; a
    long text is scanned in one task, in time linear in its length. Every row is judged by itself, so there are no ties.
    """
    known = parsed(SENTENCES if sentences is None else sentences)
    rules = RULES if rules is None else rules
    within = set(REFERENCES if sentences is None and references is None else references or [])
    body = F.col(text)
    none = F.array().cast("array<string>")
    if not known:
        found = docs.select(F.col(key), none.alias("sequence"))
    else:
        # Literal maps of fixed size: no join, no shuffle.
        whole = {p[0]: name for name, p, more in known if len(p) == 1 and not more}
        opening: dict[int, dict[str, list]] = {}
        for name, p, more in known:
            if more or len(p) > 1:
                opening.setdefault(len(p[0].split()), {}).setdefault(p[0], []).append((name, p[1:]))

        def identified(s: Column) -> Column:
            """Identifier of a normalised sentence, null if it is unknown."""
            tries = [F.try_element_at(F.create_map(*(F.lit(x) for kv in whole.items() for x in kv)), s)] if whole else []
            for n in sorted(opening, reverse=True):
                head = F.substring_index(s, " ", n)
                plain = {k: v[0][0] for k, v in opening[n].items() if not v[0][1]}
                if plain:
                    tries.append(F.try_element_at(F.create_map(*(F.lit(x) for kv in plain.items() for x in kv)), head))
                for k, entries in opening[n].items():
                    for name, rest in entries:
                        if rest:
                            tries.append(F.when((head == k) & F.like(s, F.lit("%" + "%".join(rest) + "%")), F.lit(name)))
            tries += [F.when(F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(f" {p[0]} ")) & ~F.rlike(s, F.lit(negated(p[0]))), F.lit(name)) for name, p, _ in known if name in within]
            return F.coalesce(*tries)

        def of_sentence(s: Column) -> Column:
            own = F.transform(F.array(s), lambda x: identified(normalised(x)))
            lines = F.flatten(F.transform(F.split(s, "\n"), lambda x: F.when(F.contains(F.lower(x), F.lit(TAG)), expressed(x)).otherwise(F.array(identified(normalised(x))))))
            return F.when(own[0].isNotNull() & ~F.contains(F.lower(s), F.lit(TAG)), own).otherwise(lines)

        worth = F.lit(False)
        for word in [*anchors([" ".join(p).split() for _, p, _ in known]), TAG]:
            worth = worth | F.contains("_low", F.lit(word))
        body = F.col("_body")
        lowered = docs.select(F.col(key), F.col(text).alias("_body"), F.lower(text).alias("_low"))  # of its own, so that it is made once for all words
        parts = F.when(worth, F.split(body, SENTENCE_END)).otherwise(none)
        ids = F.filter(F.flatten(F.transform(F.coalesce(parts, none), of_sentence)), lambda x: x.isNotNull())
        found = lowered.select(F.col(key), ids.alias("sequence"))
    joined = F.concat(F.lit(","), F.array_join("sequence", ","), F.lit(","))
    hits = F.filter(F.array(*(F.when(joined.contains("," + ",".join(seq) + ","), F.lit(name)) for name, seq in rules)), lambda x: x.isNotNull()) if rules else none
    named = F.transform(F.filter("sequence", lambda x: F.startswith(x, F.lit(NAMED))), lambda x: F.substring(x, F.lit(len(NAMED) + 1), F.char_length(x)))
    return found.withColumn("licenses", F.array_sort(F.array_distinct(F.concat(hits, named)))).withColumn("license_list", F.array_join("licenses", ",")).withColumn("n_sentences", F.size("sequence").cast("long"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "n_sentences", F.array_join("sequence", ",").alias("sentence_ids"), "license_list")


def _values() -> str:
    """(id, opening, words of it or 0 for a whole sentence, what follows as a pattern, found inside or not, order of preference, pattern that denies it)."""
    rows = []
    for name, p, more in parsed(SENTENCES):
        n = len(p[0].split()) if more or len(p) > 1 else 0
        rows.append((name, p[0], n, "%" + "%".join(p[1:]) + "%" if len(p) > 1 else "%", 0, -n if n else -1000, ""))
        if name in REFERENCES:
            rows.append((name, p[0], 0, "%", 1, 1000, negated(p[0])))
    return ", ".join(f"('{a}', '{b}', {c}, '{d}', {e}, {f}, '{g}')" for a, b, c, d, e, f, g in rows)


_RULES = ", ".join(f"('{name}', ',{','.join(seq)},')" for name, seq in RULES)
_FITS = "CASE WHEN k.inside = 1 THEN contains(' ' || x.s || ' ', ' ' || k.s || ' ') AND NOT regexp_matches(x.s, k.deny) WHEN k.n = 0 THEN x.s = k.s ELSE (x.s = k.s OR starts_with(x.s, k.s || ' ')) AND x.s LIKE k.rest END"
_NORMAL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
OP10_SQL = rf"""
WITH k(id, s, n, rest, inside, pref, deny) AS (VALUES {_values()}), rules(license, seq) AS (VALUES {_RULES}), names(id) AS (VALUES {', '.join(f"('{i}')" for i in IDENTIFIERS)}), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_split_to_array(coalesce(text, ''), '{SENTENCE_END}') AS parts FROM documents
), p AS (
  SELECT rid, i, 0 AS j, 0 AS o, parts[i] AS raw, {_NORMAL.format('parts[i]')} AS s FROM (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)
), a AS (
  SELECT rid, i, j, o, arg_min(id, pref) AS id FROM p x JOIN k ON {_FITS} WHERE NOT contains(lower(raw), '{TAG}') GROUP BY ALL
), ln AS (
  SELECT rid, i, j, 0 AS o, raw, {_NORMAL.format('raw')} AS s FROM (SELECT rid, i, unnest(string_split(raw, chr(10))) AS raw, generate_subscripts(string_split(raw, chr(10)), 1) AS j FROM p ANTI JOIN a USING (rid, i))
), b AS (
  SELECT rid, i, j, o, arg_min(id, pref) AS id FROM ln x JOIN k ON {_FITS} WHERE NOT contains(lower(raw), '{TAG}') GROUP BY ALL
), w AS (
  SELECT rid, i, j, regexp_split_to_array(regexp_replace(regexp_extract(raw, '{EXPRESSION}', 1), '{BESIDE}', '', 'g'), '[ \t]+') AS l FROM ln WHERE contains(lower(raw), '{TAG}')
), c AS (
  SELECT rid, i, j, min(o) AS o, '{NAMED}' || n.id AS id FROM (SELECT rid, i, j, unnest(l) AS t, generate_subscripts(l, 1) AS o FROM w) x JOIN names n ON lower(n.id) = lower(regexp_replace(x.t, '{VERSION}', '')) GROUP BY ALL
), q AS (
  SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY i, j, o) AS ids FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY rid
), l AS (
  SELECT rid, string_agg(license, ',' ORDER BY license) AS license_list FROM (
    SELECT rid, license FROM q JOIN rules ON contains(',' || ids || ',', seq) UNION SELECT rid, substr(id, {len(NAMED) + 1}) FROM c
  ) GROUP BY rid
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(license_list, '') AS license_list
FROM d LEFT JOIN q USING (rid) LEFT JOIN l USING (rid)
"""
