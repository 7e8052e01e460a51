"""Column functions over names, paths and texts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import once

#: Punctuation that is trimmed off tokens.
TRIMMED = ".,;:!?\"'"


def query_tokens(q: Column) -> Column:
    """Lower-case tokens without punctuation at their ends."""
    return F.filter(F.transform(F.split(F.lower(F.trim(q)), r"\s+"), lambda t: F.btrim(t, F.lit(TRIMMED))), lambda t: t != "")


def prompt(q: Column) -> Column:
    """One word: a photo of a X; two or three: a photo of X; else the query itself."""
    n = F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda t: t != ""))
    return F.when(n == 1, F.concat(F.lit("a photo of a "), F.trim(q))).when((n >= 2) & (n <= 3), F.concat(F.lit("a photo of "), F.trim(q))).otherwise(q)


def snippet(text: Column, q: str, around: int = 25) -> Column:
    """The first match, ignoring case, with `around` characters on both sides and ellipses where text was cut; line breaks become blanks."""
    at = F.instr(F.lower(text), q.lower())
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + len(q) + around - 1, F.char_length(text))
    body = F.translate(F.substring(text, start, stop - start + 1), "\r\n", "  ")
    out = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), body, F.when(stop < F.char_length(text), F.lit("…")).otherwise(F.lit("")))
    return F.when(at > 0, out)


def shortened(text: Column, most: int = 60) -> Column:
    """White space collapsed, cut at `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def readable_size(n: Column) -> Column:
    """B, KB, MB or GB with one decimal beyond bytes."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for unit, scale in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        value = F.format_string("%.1f " + unit, F.floor(n * 10 / scale) / 10.0)
        out = out.when(n < (scale << 10), value) if unit != "GB" else out.otherwise(value)
    return out


def duration(seconds: Column) -> Column:
    """m:ss min from one minute on, else s."""
    s = seconds.cast("long")
    return F.when(s >= 60, F.format_string("%d:%02d min", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d s", s))


#: The wording of what is left, and of hits by name alone.
REMAINING, NAME_ONLY, NAME_AND_SIZE = "noch ca. ", "nur Name", "nur Name — Bestand "


def remaining(elapsed: Column, done: Column, total: Column) -> Column:
    """What is left at the pace so far, in seconds or minutes, rounded up; empty before the first and after the last unit."""
    left = F.ceil(elapsed / done * (total - done)).cast("long")
    minutes = F.format_string("%d min", F.floor(left / 60))
    shown = F.when(left < 60, F.format_string("%d s", left)).when(left % 60 > 0, F.concat(minutes, F.format_string(" %d s", left % 60))).otherwise(minutes)
    return F.when((done > 0) & (done < total) & (left > 0), F.concat(F.lit(REMAINING), shown)).otherwise("")


def hint_parts(hint: Column) -> Column:
    """(field, value) of a hint: cut at its first colon, unless it begins with one; a hint without is a value alone."""
    at = F.instr(hint, ":")
    return F.when(at > 1, F.struct(F.substring(hint, F.lit(1), at - 1).alias("field"), F.trim(F.substring(hint, at + 1, F.char_length(hint))).alias("value"))).otherwise(F.struct(F.lit("").alias("field"), hint.alias("value")))


def hit_hint(name_only: Column, size: Column, reference_size: Column) -> Column:
    """How sure a duplicate is: empty where contents were compared, else that only the name agrees, and the other size if it differs."""
    return F.when(~name_only, "").when(size != reference_size, F.concat(F.lit(NAME_AND_SIZE), readable_size(reference_size))).otherwise(NAME_ONLY)


def file_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def short_path(path: Column) -> Column:
    """The last two parts after an ellipsis, or the path itself if it has no more."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    return F.when(F.size(parts) > 2, F.concat(F.lit("…/"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))).otherwise(path)


def stem_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def natural_key(name: Column) -> Column:
    """Sort key by runs: texts in lower case, digit runs as numbers (0 where they overflow an INT). Compares element by element like a person would."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda r: F.when(r.rlike(r"^\d"), F.coalesce(F.expr("int(null)"), r.try_cast("int"), F.lit(0)))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\D"), F.lit(1)).otherwise(F.lit(0)).alias("kind"), number(r).alias("number"), F.when(r.rlike(r"^\D"), r).otherwise(F.lit("")).alias("text")))


def under_root(path: Column, root: str) -> Column:
    return F.startswith(F.lower(path), F.lit(root.rstrip("/").lower() + "/"))


def pseudo_line(confidence: Column, text: Column) -> Column:
    """Confidence known and low, or fewer than three letters and digits."""
    return F.coalesce(confidence.isNotNull() & ((confidence < 0.85) | (F.char_length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")) < 3)), F.lit(False))


def new_lines(text: Column, more: Column) -> Column:
    """Lines of `more` that the text does not contain, distinct when case is ignored, in order."""
    lines = F.filter(F.transform(F.split(more, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    fresh = F.filter(lines, lambda x: ~F.contains(F.lower(text), F.lower(x)))
    lowered = F.transform(fresh, lambda x: F.lower(x))
    return F.filter(fresh, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


#: Tokens that are translated into one array; the arrays are joined, so that a long text is not copied for each of its tokens.
RUN = 64


def terms_translated(tokens: Column, phrases: Column, longest: int = 3) -> Column:
    """Greedy translation of a token array with a map from phrases to phrases: the longest known phrase first, then the stem of a token, unknown tokens kept."""

    def translated(tokens: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            taken = F.struct((acc.skip - 1).alias("skip"), acc.out.alias("out"))
            best = F.struct(F.lit(0).alias("skip"), F.array_append(acc.out, F.coalesce(stem(F.get(tokens, i), phrases), F.get(tokens, i))).alias("out"))
            for n in range(1, longest + 1):
                known = F.try_element_at(phrases, F.array_join(F.slice(tokens, i + 1, n), " "))
                best = F.when((i + n <= F.size(tokens)) & known.isNotNull(), F.struct(F.lit(n - 1).alias("skip"), F.array_append(acc.out, known).alias("out"))).otherwise(best)
            return F.when(acc.skip > 0, taken).otherwise(best)

        def run(acc: Column, first: Column) -> Column:
            none = F.struct(acc.skip.alias("skip"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(F.sequence(first, F.least(first + (RUN - 1), F.size(tokens) - 1)), none, step, lambda a: F.struct(a.skip.alias("skip"), F.array_append(acc.out, a.out).alias("out")))

        empty = F.struct(F.lit(0).alias("skip"), F.array().cast("array<array<string>>").alias("out"))
        runs = F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(RUN)), empty, run, lambda a: a.out)
        return F.when(F.size(tokens) > 0, F.array_join(F.flatten(runs), " ")).otherwise(F.lit(""))

    return once(tokens, translated)


def stem(word: Column, known: Column) -> Column:
    """The map entry of a word: as it is, with umlauts written out as plain vowels, or without one of the endings en, er, e, n, s (three letters stay at least); null if none is known."""
    plain = lambda x: F.translate(F.replace(x, F.lit("ß"), F.lit("ss")), "äöü", "aou")
    tries = [word, plain(word)]
    for end in ("en", "er", "e", "n", "s"):
        cut = F.when(F.endswith(word, F.lit(end)) & (F.char_length(word) >= 3 + len(end)), F.substring(word, F.lit(1), F.char_length(word) - len(end)))
        tries += [cut, plain(cut)]
    return F.coalesce(*(F.when(t.isNotNull(), F.try_element_at(known, t)) for t in tries))


def html_decoded(html: Column) -> Column:
    """Character references decoded, by name and by number, white space collapsed and trimmed. A reference that HTML does not know stays as it is.

    Names are those of the standard library's table of HTML 4, which has 252 of them, and apos.
    """
    names = F.create_map(*(F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, chr(code))))

    def of_number(digits: Column, base: int) -> Column:
        code = F.conv(digits, base, 10).cast("decimal(20,0)")
        legal = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))

    def resolved(part: Column) -> Column:
        """What stands after an ampersand, with the reference it begins with, if any, in place."""
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});", 1)
        char = F.when(F.startswith(F.lower(name), F.lit("#x")), of_number(F.substring(name, 3, 6), 16)).when(F.startswith(name, F.lit("#")), of_number(F.substring(name, 2, 7), 10)).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(char, F.substring(part, F.char_length(name) + 2, F.char_length(part))), F.concat(F.lit("&"), part))

    parts = F.split(html, "&")
    whole = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), resolved), ""))
    return F.trim(F.regexp_replace(whole, r"[ \t\n\x0B\f\r]+", " "))


def counts_as_text(confidence: Column, text: Column) -> Column:
    """Has text and is no pseudo line."""
    return F.coalesce(F.char_length(F.trim(text)) > 0, F.lit(False)) & ~pseudo_line(confidence, text)
