"""Names of classes, cards and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The printing suffix of a raw name, the characters a file name may keep,
# the default for a missing name or id.
PRINTING_SUFFIX = r"^(.*)_([A-Z]{2,5}\p{Nd}{1,5})$"
FILE_UNSAFE = r"[^A-Za-z0-9_-]"
UNKNOWN = "unknown"

# Letters, digits, underscore and space in any script; plain \w is ASCII-only in Java.
_PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}]"
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def canonical_name(raw: Column, keep_printings: bool = False) -> Column:
    """Name without its one trailing printing code; with ``keep_printings`` as SET/Name."""
    bare = F.regexp_replace(raw, PRINTING_SUFFIX, "$1")
    if not keep_printings:
        return bare
    set_code = F.regexp_extract(raw, r"^.*_([A-Z]{2,5})\p{Nd}{1,5}$", 1)
    return F.when(set_code != "", F.concat(set_code, F.lit("/"), bare)).otherwise(raw)


def image_file_name(name: Column, printing_id: Column) -> Column:
    """File of a printing: safe name, underscore, printing id."""
    spaced = F.translate(F.coalesce(name, F.lit(UNKNOWN)), " ", "_")
    return F.concat(
        F.regexp_replace(spaced, FILE_UNSAFE, ""), F.lit("_"),
        F.coalesce(printing_id, F.lit(UNKNOWN)), F.lit(".png"),
    )


def exact_key(name: Column) -> Column:
    """Lower case without outer space."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), _EDGE_SPACE, "")


def search_key(class_name: Column) -> Column:
    """The exact key of a class name, whose underscores stand for spaces."""
    return exact_key(F.translate(class_name, "_", " "))


def loose_key(key: Column) -> Column:
    """A key without punctuation."""
    return F.regexp_replace(key, _PUNCTUATION, "")


def digest(seed: str, *parts: Column) -> Column:
    """md5 text that orders rows at random but the same way on every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def digest_number(text: Column) -> Column:
    """The first 32 bits of an md5 text as a number."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")


def output_stem(seed: str, image_no: Column, template_stem: Column) -> Column:
    """Stem of a generated image. The tag comes from seed and number, so reruns agree."""
    tag = F.substring(digest(seed, image_no), 1, 8)
    return F.concat_ws("_", F.lit("synthetic"), image_no.cast("string"), tag, template_stem)
