"""Column functions over the bytes of files: formats, truncation, metadata markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(content: Column, n: int, start: int = 1) -> Column:
    return F.hex(F.substring(content, start, n))


def tail(content: Column, n: int) -> Column:
    return F.hex(F.expr("null").cast("binary")) if n == 0 else F.hex(F.substring(content, F.greatest(F.octet_length(content) - n + 1, F.lit(1)), F.lit(n)))


def little_endian(content: Column, start: int, n: int) -> Column:
    """Unsigned number of n bytes from the 1-based place start, least byte first; null beyond the end."""
    pairs = [F.substring(F.hex(F.substring(content, start + i, 1)), 1, 2) for i in reversed(range(n))]
    whole = F.concat(*pairs)
    return F.when(F.octet_length(content) >= start + n - 1, F.conv(whole, 16, 10).cast("long"))


def detected_format(content: Column) -> Column:
    """Format by the first 16 bytes; the first rule that holds wins."""
    h = head(content, 16)
    return (
        F.when(F.octet_length(content) < 2, None)
        .when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "gif").when(h.startswith("424D"), "bmp")
        .when(h.startswith("52494646") & (head(content, 4, 9) == "57454250"), "webp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").when(h.startswith("00000100"), "ico")
    )


EXTENSIONS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "gif": "gif", "bmp": "bmp", "webp": "webp", "tif": "tiff", "tiff": "tiff", "ico": "ico"}


def expected_format(extension: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.try_element_at(known, F.lower(extension))


def is_truncated(content: Column, fmt: Column) -> Column:
    """Structural check of the end or of declared sizes; unknown formats count as damaged."""
    n = F.octet_length(content)
    return (
        F.when(fmt == "jpeg", tail(content, 2) != "FFD9")
        .when(fmt == "png", ~F.contains(tail(content, 8), F.lit("49454E44")))
        .when(fmt == "gif", tail(content, 1) != "3B")
        .when(fmt == "bmp", F.coalesce(little_endian(content, 3, 4) > n, F.lit(True)))
        .when(fmt == "webp", F.coalesce(little_endian(content, 5, 4) + 8 > n, F.lit(True)) | ~head(content, 3, 13).startswith("565038"))
        .when(fmt == "tiff", n < 8)
        .when(fmt == "ico", F.coalesce(little_endian(content, 5, 2) * 16 + 6 > n, F.lit(True)))
        .otherwise(F.lit(True))
    )


def checked(content: Column, extension: Column) -> Column:
    """Struct of all checks on one file: empty, format, matches, truncated, ok. Null content fails all."""
    fmt = detected_format(content)
    empty = F.coalesce(F.octet_length(content) == 0, F.lit(True))
    matches = F.coalesce(fmt == expected_format(extension), F.lit(False))
    cut = F.when(empty, F.lit(True)).otherwise(is_truncated(content, fmt))
    return F.struct(empty.alias("empty"), fmt.alias("format"), matches.alias("matches"), cut.alias("truncated"), (~empty & matches & ~cut).alias("ok"))


#: A generator and the sets of substrings (case ignored) of which one must be there whole; the first that fits wins.
GENERATORS = [
    ("SwarmUI", [["sui_image_params"]]),
    ("ComfyUI", [['"class_type"'], ['"workflow"']]),
    ("Automatic1111", [["negative prompt:"], ["steps:", "sampler:"]]),
]
#: The name for JSON with a prompt of an unknown tool.
UNKNOWN_GENERATOR = "Bildgenerator"


def generator(text: Column) -> Column:
    """Name of the tool that wrote a metadata text; empty where nothing tells."""
    low, out = F.lower(text), F
    has = lambda part: F.contains(low, F.lit(part))
    for name, sets in GENERATORS:
        fits = F.lit(False)
        for parts in sets:
            whole = F.lit(True)
            for part in parts:
                whole = whole & has(part)
            fits = fits | whole
        out = out.when(fits, F.lit(name))
    return out.when(F.startswith(F.ltrim(text), F.lit("{")) & has('"prompt"'), F.lit(UNKNOWN_GENERATOR)).otherwise(F.lit(""))


def model_name(json: Column) -> Column:
    """The model of the image parameters if these are there, else of the whole document; null without one or for damaged JSON."""
    inner = F.startswith(F.get_json_object(json, "$.sui_image_params"), F.lit("{"))
    return F.when(inner, F.get_json_object(json, "$.sui_image_params.model")).otherwise(F.get_json_object(json, "$.model"))


def has_provenance(content: Column, most: int = 512 * 1024) -> Column:
    """Both markers of an embedded provenance block within the first 512 KB."""
    h = F.hex(F.substring(content, 1, most))
    return F.contains(h, F.hex(F.lit("jumb").cast("binary"))) & F.contains(h, F.hex(F.lit("c2pa").cast("binary")))
