"""Column functions of the catalogue domain, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.functions.title import EDITIONS, IMAGE_SUFFIXES, RAR_SUFFIXES, SEVENZIP_SUFFIXES, ZIP_SUFFIXES

# Fixed values.
IGNORED_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")
IGNORED_FOLDERS = ("__MACOSX/", "__macosx/")
RANKS = {"zip": 4, "7z": 3, "rar": 2, "folder": 1, "imageset": 0}
INVALID_IN_NAMES = '<>:"/\\|?*'
LONGEST_SERIES = 60
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, '' if none."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def kind_of(path: Column) -> Column:
    """zip, rar or 7z by suffix, else ''."""
    s = suffix(path)
    return F.when(s.isin(*ZIP_SUFFIXES), "zip").when(s.isin(*RAR_SUFFIXES), "rar").when(s.isin(*SEVENZIP_SUFFIXES), "7z").otherwise("")


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def is_ignored(path: Column) -> Column:
    named = F.lower(base_name(path)).isin(*IGNORED_NAMES)
    inside = [path.startswith(p) | path.contains("/" + p) for p in IGNORED_FOLDERS]
    return named | inside[0] | inside[1]


def is_page(path: Column, is_dir: Column) -> Column:
    return ~is_dir & is_image(path) & ~is_ignored(path)


def safe_member(path: Column) -> Column:
    """A member name as a relative path: back slashes turned, empty parts, '.' and '..' dropped."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def without_suffix(path: Column) -> Column:
    known = "|".join(s[1:] for s in (*ZIP_SUFFIXES, *RAR_SUFFIXES, *SEVENZIP_SUFFIXES, *IMAGE_SUFFIXES))
    return F.regexp_replace(path, rf"(?i)(?<=[^/])\.({known})$", "")


def editions(text: Column) -> Column:
    return F.array_sort(F.filter(F.array(*map(F.lit, EDITIONS)), lambda w: F.contains(text, w)))


def series_key(text: Column) -> Column:
    """Comparable form of a lower-cased, NFKC-normalised series."""
    kana = F.translate(text, KATAKANA, HIRAGANA)
    return F.regexp_replace(F.regexp_replace(kana, r"[^0-9a-z\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", ""), "ー", "")


def block_key(kind: Column, volume: Column, editions: Column) -> Column:
    """Key of items that can be copies of each other."""
    return F.concat(kind, F.lit(":"), volume, F.lit(":"), F.array_join(F.array_sort(editions), ","))


def has_japanese(text: Column) -> Column:
    return text.rlike(r"[\u3040-\u9fff]")


def file_safe(text: Column) -> Column:
    return F.btrim(F.translate(text, INVALID_IN_NAMES, "_" * len(INVALID_IN_NAMES)), F.lit(" ."))


def unified_suffix(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*ZIP_SUFFIXES), ".zip").otherwise(s)


def padded(volume: Column, digits: Column) -> Column:
    """Each number of '7' or '7-10' with zeros up to ``digits``; longer ones stay."""
    return F.array_join(F.transform(F.split(volume, "-"), lambda p: F.lpad(p, F.greatest(digits, F.length(p)), F.lit("0"))), "-")


def natural_key(path: Column) -> Column:
    """Sorts digit runs by value and letters without case: runs padded to 20 digits."""
    tokens = F.regexp_extract_all(F.lower(path), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.lpad(F.regexp_replace(t, "^0+(?=.)", ""), 20, "0")).otherwise(t))


def place_of(rel_path: Column, kind: Column) -> Column:
    """Where an item's files are: its path, for a set of images (folder#第N巻) its folder."""
    return F.when(kind == "imageset", F.regexp_replace(rel_path, "#第[^#/]*巻$", "")).otherwise(rel_path)


def scope_of(rel_path: Column, kind: Column) -> Column:
    """The folder an item counts under: its parent, for a set of images its own folder."""
    path = F.rtrim(place_of(rel_path, kind), F.lit("/"))
    parent = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    return F.when(kind == "imageset", path).otherwise(parent)


def prefix(scope: Column, depth: Column) -> Column:
    """The first ``depth`` parts of a scope."""
    return F.array_join(F.slice(F.split(scope, "/"), F.lit(1), depth), "/")


def depth_of(scope: Column) -> Column:
    return F.when(scope == "", 0).otherwise(F.size(F.split(scope, "/")))


def ancestors(scope: Column) -> Column:
    """All prefixes of a scope, itself and the root '' included, by depth."""
    return F.transform(F.sequence(F.lit(0), depth_of(scope)), lambda d: F.when(d == 0, "").otherwise(prefix(scope, d)))


def source_rank(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[kind]


def bigrams(text: Column) -> Column:
    """The set of two-character strings; a single character is its own."""
    n = F.length(text)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(many)


def dice(left: Column, right: Column) -> Column:
    """Dice coefficient of the bigram sets; 0 if one is empty."""
    a, b = bigrams(left), bigrams(right)
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def fixed(value: Column, digits: int) -> Column:
    """A double from 0 to 2**14 with so many decimals, rounded by its exact binary value; a tie goes to the even one.

    Java's own formatting rounds the shortest decimal that stands for the double, which parts from this at ties.
    """
    scale = F.when(value < 0.5, F.lit(62)).when(value < 32, F.lit(57)).otherwise(F.lit(48))
    whole = F.pow(F.lit(2.0), scale).cast("bigint").cast("decimal(20,0)")
    exact = (value * F.pow(F.lit(2.0), scale)).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(6,0)")
    rest = exact % whole
    low = ((exact - rest) / whole).cast("bigint")
    up = (rest * 2 > whole) | ((rest * 2 == whole) & (low % 2 == 1))
    number = low + up.cast("bigint")
    return F.concat(F.floor(number / 10**digits).cast("string"), F.lit("."), F.lpad((number % 10**digits).cast("string"), digits, "0"))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))
