"""Rules over whole texts: key=value blocks, patches, code windows, names, previews."""

from pyspark.sql import Column, functions as F

from defectloom.functions.bind import bind
from defectloom.schema import MAX_CHARS

# The characters Python's str.strip and \s take for white space. Spark's trim
# knows the blank only and Java's \s the ASCII ones only.
PY_SPACE = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
HUNK_HEADER = r"\A@@[^ ]* -?[+-]?[0-9]+(_[0-9]+)*(,[^ ]*)? "
BLOCK_START = rf"\A[{PY_SPACE}]*(def |class )[{PY_SPACE}]*[^{PY_SPACE}]"
DEF_NAME = rf"def[{PY_SPACE}]+([a-zA-Z_][a-zA-Z0-9_]*)[{PY_SPACE}]*\("
CLASS_NAME = rf"class[{PY_SPACE}]+([a-zA-Z_][a-zA-Z0-9_]*)"


def lines_of(text) -> Column:
    return F.split(text, "\n")


def trim_both(text, chars: str) -> Column:
    """``text`` without the characters of a regex class at either end.

    The look-behind lets a run inside the text be passed over at once, so long runs cost no
    more than other text.
    """
    return F.regexp_replace(text, rf"\A[{chars}]++|(?<![{chars}])[{chars}]++\z", "")


def strip(text) -> Column:
    """``str.strip()``."""
    return trim_both(text, PY_SPACE)


def is_blank(text) -> Column:
    return ~F.rlike(text, F.lit(f"[^{PY_SPACE}]"))


def unix_newlines(text) -> Column:
    """What a text-mode read does to line ends."""
    return F.regexp_replace(text, "\r\n?", "\n")


def parse_kv(text) -> Column:
    """``key = "value"`` lines to a map; the last line of a key wins, other lines are ignored."""
    entries = F.transform(
        F.filter(lines_of(text), lambda line: F.instr(line, "=") > 0),
        lambda line: F.struct(
            strip(F.substring_index(line, "=", 1)).alias("key"),
            trim_both(strip(F.substr(line, F.instr(line, "=") + 1)), '"').alias("value"),
        ),
    )

    def last_per_key(found):
        # Sorted by key and place, so the last of a key stands before another key.
        placed = F.array_sort(
            F.transform(found, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))
        )
        return bind(
            placed,
            lambda all_: F.map_from_entries(
                F.transform(
                    F.filter(
                        all_, lambda e, i: ~F.coalesce(F.get(all_, i + 1)["key"] == e["key"], F.lit(False))
                    ),
                    lambda e: F.struct(e["key"], e["value"]),
                )
            ),
        )

    return bind(entries, last_per_key)


def patch_code(patch, keep: str = "+- ", hunks: str = "all") -> Column:
    """Code lines of a unified diff, null when there are none.

    ``keep`` names the line marks that stay: all three for the merged text, ``"- "`` for the
    side before the change, ``"+ "`` for the side after it. ``hunks`` is ``"all"``, or ``"last"``
    for those below the last header alone.
    """
    if hunks not in ("all", "last"):
        raise ValueError(f"unknown hunks: {hunks}")
    marks = [F.lit(mark) for mark in keep]
    ends = F.array_max if hunks == "last" else _first_positive

    def below(lines):
        header_ends = F.transform(
            lines, lambda line, i: F.when(F.rlike(line, F.lit(HUNK_HEADER)), i + 1).otherwise(0)
        )
        return F.slice(lines, ends(header_ends) + 1, F.size(lines))

    def kept(lines):
        # A header's own line starts with none of the marks.
        def stays(line, i):
            marked = F.left(line, F.lit(1)).isin(*marks)
            return marked if hunks == "last" else marked & ~_file_header(lines, i)

        return F.transform(F.filter(lines, stays), lambda line: F.substr(line, F.lit(2)))

    code = bind(bind(lines_of(patch), below), kept)
    return F.nullif(F.array_join(code, "\n"), F.lit(""))


def _file_header(lines, i) -> Column:
    """Whether line ``i`` is the ``---`` or ``+++`` line above the first hunk of a further file."""

    def at(k, start):
        return F.startswith(F.get(lines, k), F.lit(start))

    def hunk(k):
        return F.rlike(F.get(lines, k), F.lit(HUNK_HEADER))

    old = at(i, "--- ") & at(i + 1, "+++ ") & hunk(i + 2)
    new = at(i, "+++ ") & at(i - 1, "--- ") & hunk(i + 1)
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def _first_positive(numbers) -> Column:
    return F.coalesce(F.array_min(F.filter(numbers, lambda n: n > 0)), F.lit(0))


def function_window(code, line_no, context: int = 15) -> Column:
    """Lines from the block start at or above ``line_no`` (0-based) up to the next one.

    The end is exclusive and is looked for from ``line_no`` on, so a number that sits on a
    block start gives ''. Without a block start the window is ``context`` lines either way.
    """

    def window(lines):
        starts = F.filter(
            F.transform(lines, lambda line, i: F.when(F.rlike(line, F.lit(BLOCK_START)), i)),
            lambda i: i.isNotNull(),
        )
        return bind(starts, lambda found: cut(lines, found))

    def cut(lines, starts):
        begin = F.coalesce(
            F.array_max(F.filter(starts, lambda i: i <= line_no)),
            F.greatest(F.lit(0), line_no - context),
        )
        end = F.coalesce(
            F.array_min(F.filter(starts, lambda i: i >= line_no)),
            F.least(F.size(lines), line_no + context),
        )
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.array_join(bind(lines_of(code), window), "\n")


def function_name(code) -> Column:
    """Name of the first function, else of the first class, else ``module``."""
    return F.coalesce(
        F.nullif(F.regexp_extract(code, DEF_NAME, 1), F.lit("")),
        F.nullif(F.regexp_extract(code, CLASS_NAME, 1), F.lit("")),
        F.lit("module"),
    )


def truncate_lines(code, max_chars: int = MAX_CHARS) -> Column:
    """Whole leading lines that fit ``max_chars``, each counted with its line end."""
    code = F.col(code) if isinstance(code, str) else code
    head = F.left(code, F.lit(max_chars))
    cut_line = F.substring_index(head, "\n", -1)
    return F.when(F.length(code) <= max_chars, code).otherwise(
        F.left(head, F.length(head) - F.length(cut_line) - 1)
    )


def preview(code, width: int = 100) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.when(
        F.length(code) > width, F.concat(F.left(code, F.lit(width)), F.lit("..."))
    ).otherwise(code)


def label_text(predicted) -> Column:
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.when(predicted == 1, "buggy").otherwise("clean")


def safe_ratio(part, whole) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def length_band(mean_length) -> Column:
    # 500 and 1000 characters.
    return (
        F.when(mean_length <= 0, None)
        .when(mean_length < 500, "short")
        .when(mean_length < 1000, "medium")
        .when(mean_length >= 1000, "long")
    )


def balance_band(ratio) -> Column:
    # Inclusive bounds, first match wins.
    return (
        F.when(ratio.between(0.45, 0.55), "well balanced")
        .when(ratio.between(0.4, 0.6), "moderately balanced")
        .when(ratio.between(0.3, 0.7), "somewhat imbalanced")
        .otherwise("highly imbalanced")
    )
