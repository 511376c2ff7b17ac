"""Text functions as native columns. Character classes are spelt out, so Java's ASCII defaults don't matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, and word characters (letters, digits, underscore), inside brackets.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def normalize(c: Column, preserve_case: bool = False) -> Column:
    """Lower case, yo as e, one blank for white space, other signs than the kept ones as a blank."""
    text = F.translate(c if preserve_case else F.lower(c), "ёЁ", "еЕ")
    text = F.regexp_replace(text, f"[{SPACE}]+", " ")
    return F.trim(F.regexp_replace(text, rf"[^{WORD}{SPACE}.,\-+()\[\]{{}}/\\=:;]", " "))


def normalize_for_classification(c: Column) -> Column:
    """As normalize, then everything but words, blanks and . , - + is deleted."""
    return F.regexp_replace(normalize(c), rf"[^{WORD}{SPACE}.,\-+]", "")


def normalize_for_ocr(c: Column) -> Column:
    return collapse(F.translate(c, "«»„−–—", '"""---'))


def clean_ocr_text(c: Column) -> Column:
    """Plain quotes and dashes, tabs as blanks, each two blanks as one (a single pass)."""
    text = F.translate(c, "“”«»–—", '""""--')
    return F.replace(F.replace(text, F.lit("  "), F.lit(" ")), F.lit("\t"), F.lit(" "))


def normalize_for_comparison(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, f"[{SPACE}]+", " ")), f"[^{WORD}{SPACE}]", ""))


def normalize_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(collapse(c)), "^[.,;:!?]+|[.,;:!?]+$", ""))


def sanitize_filename(c: Column, most: int = 200, keep: int = 190) -> Column:
    """A safe file name: no folder, no forbidden characters, no blanks or dots at the ends, bounded length."""
    base = F.regexp_replace(c, r"^.*[/\\]", "")
    safe = F.regexp_replace(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")
    ext = F.regexp_extract(safe, r"(\.[^.]*)$", 1)
    short = F.when(F.length(safe) > most, F.concat(F.substring(safe, 1, keep), ext)).otherwise(safe)
    return F.when(F.coalesce(short, F.lit("")) == "", "unnamed_file").otherwise(short)


#: Names that a file mustn't have on some systems.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]


def valid_filename(c: Column) -> Column:
    stem = F.upper(F.regexp_extract(c, r"^([^.]*)", 1))
    return F.coalesce((F.length(c).between(1, 255)) & ~c.rlike(r'[<>:"/\\|?*\x00-\x1f]') & ~stem.isin(RESERVED), F.lit(False))


def content_md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def page_sha256(content: Column, page: Column) -> Column:
    return F.sha2(F.concat(content.cast("binary"), page.cast("string").cast("binary")), 256)


def word_similarity(a: Column, b: Column) -> Column:
    """0.7 times the overlap of the letters used plus 0.3 times the likeness of the lengths; equal words 1."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    overlap = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    longer = F.greatest(F.length(a), F.length(b))
    score = 0.7 * overlap + 0.3 * (1 - F.abs(F.length(a) - F.length(b)) / longer)
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(score)


def fix_dates(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}_])(\d{1,2})[.\s]+(\d{1,2})[.\s]+(\d{4})(?![\p{L}\p{N}_])", "$1.$2.$3")


def fix_number_sign(c: Column) -> Column:
    return F.regexp_replace(c, r"[№N]\s*(\d+)", "№ $1")


def safe_size(n_bytes: Column, most: int) -> tuple[Column, Column]:
    """(whether a file is small enough, its size in MB)."""
    return n_bytes <= most, n_bytes / 1048576.0


def has_keys(json: Column, required: list[str]) -> Column:
    """Whether a text is a JSON object with all these keys."""
    keys = F.json_object_keys(json)
    return F.coalesce(F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in required]))) == len(set(required)), F.lit(False))


def path_within(path: str, folder: str, suffixes: tuple[str, ...] = ()) -> bool:
    """Whether a path, with its links followed, lies in a folder and has one of the suffixes; for the driver."""
    from pathlib import Path

    try:
        at, root = Path(path).resolve(), Path(folder).resolve()
    except (OSError, RuntimeError, ValueError):
        return False
    return at.is_relative_to(root) and (not suffixes or at.suffix.lower() in suffixes)


def is_folder(path: str) -> bool:
    from pathlib import Path

    return bool(path) and Path(path).is_dir()
