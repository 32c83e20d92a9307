"""Column -> Column helpers on text and paths. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a trim removes (ECMAScript WhiteSpace + LineTerminator).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Snippet length, characters per token.
EVIDENCE_CHARS = 160
CHARS_PER_TOKEN = 4

# Paths whose facts count as low confidence.
LOW_CONFIDENCE_DIR = r"(?i)(^|[\\/])(tests?|__tests__|__mocks__|__fixtures__|mocks|fixtures?|spec)([\\/]|\z)"
LOW_CONFIDENCE_FILE = r"(?i)\.(test|spec)\.[^./\\]+\z"
# Paths of tests for reviews.
TEST_DIR = r"(^|/)(tests?|__tests__)/"
TEST_FILE = r"\.(test|spec)\.[cm]?[jt]sx?\z"
# Example and demo paths, documentation files.
SECONDARY_DIR = r"(?i)(^|[\\/])(examples?|samples?|demos?|benchmarks?)([\\/]|\z)"
DOC_FILE = r"(?i)\.(md|mdx|txt|rst)\z"


def strip(text: Column) -> Column:
    """Trim all Unicode white space (Spark's trim takes blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " "))


def clip(text: Column, size: int) -> Column:
    return F.substring(squeeze(F.coalesce(text, F.lit(""))), 1, size)


def evidence(line: Column) -> Column:
    """The snippet kept with a fact: the trimmed line, cut without a mark."""
    return F.substring(strip(line), 1, EVIDENCE_CHARS)


def line_hash(line: Column) -> Column:
    """Hash of the whole trimmed line, beside the snippet that :func:`evidence` cuts."""
    return F.xxhash64(strip(line)).cast("string")


def is_low_confidence(path: Column) -> Column:
    return path.rlike(LOW_CONFIDENCE_DIR) | path.rlike(LOW_CONFIDENCE_FILE)


def path_confidence(path: Column) -> Column:
    return F.when(is_low_confidence(path), "low").otherwise("high")


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_DIR) | path.rlike(TEST_FILE)


def extension(path: Column) -> Column:
    """'.md' of 'a/b.md'; '' where there is none or the name only starts with a dot."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]*)\z", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^/.]+\z", "")


def normalize_path(path: Column) -> Column:
    """Fold '.', '..' and doubled slashes of one path; keeps a leading slash."""
    rooted = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        can_pop = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return (
            F.when((part == "") | (part == "."), kept)
            .when((part == "..") & can_pop, F.slice(kept, 1, F.size(kept) - 1))
            .when((part == "..") & rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    body = F.concat(
        F.array_join(parts, "/"), F.when(path.endswith("/") & (F.size(parts) > 0), "/").otherwise("")
    )
    here = F.when(path.endswith("/"), "./").otherwise(".")
    return F.when(rooted, F.concat(F.lit("/"), body)).otherwise(F.when(body == "", here).otherwise(body))


#: A path with a step that :func:`normalize_path` folds.
_FOLDS = r"(^|/)\.{0,2}(/|\z)"
_UPWARDS = r"(?s)\A(?:\./)?((?:\.\./)*)(.*)\z"


def _stepped_up(folder: Column, target: Column) -> Column:
    """``folder/target`` folded, where only the target's first steps go up and stay inside the folder; null elsewhere.

    Most references are of this kind. It takes no loop over the steps of a path.
    """
    up, rest = F.regexp_extract(target, _UPWARDS, 1), F.regexp_extract(target, _UPWARDS, 2)
    depth = F.when(folder == "", 0).otherwise(F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1)
    left = depth - F.floor(F.length(up) / 3).cast("int")
    plain = ~rest.rlike(_FOLDS) & ((folder == "") | ~folder.rlike(_FOLDS))
    above = F.call_function("substring_index", folder, F.lit("/"), left)
    return F.when(plain & (left == 0), rest).when(plain & (left > 0), F.concat(above, F.lit("/"), rest))


def resolve_target(from_file: Column, target: Column, via: Column) -> Column:
    """Where a relative reference points to; absolute ones and bare package names stay."""
    bare = (via == "file_dependency") & ~target.startswith(".")
    folder = dir_name(from_file)
    joined = F.concat_ws("/", F.nullif(folder, F.lit("")), target)
    general = F.when(joined.rlike(_FOLDS), normalize_path(joined)).otherwise(joined)
    stepped = _stepped_up(F.coalesce(folder, F.lit("")), target)
    return F.when(bare | target.startswith("/"), target).otherwise(F.coalesce(stepped, general))


def quote_literal(text: Column) -> Column:
    """Escape a literal for use inside a regular expression."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-/])", r"\\$1")


def estimate_tokens(value: Column) -> Column:
    """ceil(length / 4) of a text; null costs nothing."""
    return F.coalesce(F.ceil(F.length(value) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("long")


def packed_id(key: Column) -> Column:
    """An id with its 32 hex digits as 16 bytes, for joins that move many of them: :func:`unpacked_id` gives it back.

    Any other text stays as it is, so two ids are equal if they are packed alike; null for null.
    """

    def packed(k: Column) -> Column:
        hashed = k.rlike(r"[0-9a-f]{32}\z")
        head = F.when(hashed, F.substring(k, F.lit(1), F.length(k) - 32)).otherwise(k)
        tail = F.when(hashed, F.unhex(F.substring(k, -32, 32)))
        return F.when(k.isNotNull(), F.struct(head.alias("head"), tail.alias("tail")))

    # A variable of its own: an id that is made on the fly is made once.
    return F.get(F.transform(F.array(key), packed), 0)


def unpacked_id(key: Column) -> Column:
    return F.concat(key["head"], F.coalesce(F.lower(F.hex(key["tail"])), F.lit("")))


def content_id(prefix: str | Column, *parts: Column, size: int = 32) -> Column:
    """prefix_hash of the content, stable over runs and machines.

    The default keeps 128 bits: ten hex digits would collide within a few million rows.
    """
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(head, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", *filled)), 1, size))
