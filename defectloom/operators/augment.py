"""Training-time augmentation of code text, drawn per ``id``."""

from pyspark.sql import Column, functions as F

from defectloom.functions.bind import bind
from defectloom.functions.draws import chance, pick
from defectloom.functions.text import lines_of

# The probabilities and the comments.
GATE = 0.3
P_WHITESPACE = 0.2
P_LINE = 0.1
P_COMMENT = 0.15
MAX_INDENT = 4
LAST_COMMENT_LINE = 3
COMMENTS = (
    "# TODO: review this code",
    "# FIXME: potential issue here",
    "# NOTE: important implementation",
    "# BUG: needs investigation",
)


def add_whitespace(code, seed: int = 42) -> Column:
    """Now and then, one to four blanks in front of some lines of a text with several lines."""
    row = F.col("id")
    lines = lines_of(code)
    indented = F.transform(
        lines,
        lambda line, i: F.when(
            chance(P_LINE, seed, row, "line", i),
            F.concat(F.repeat(F.lit(" "), pick(MAX_INDENT, seed, row, "indent", i) + 1), line),
        ).otherwise(line),
    )
    chosen = chance(GATE, seed, row, "gate") & chance(P_WHITESPACE, seed, row, "whitespace")
    return F.when(chosen & (F.instr(code, "\n") > 0), F.array_join(indented, "\n")).otherwise(code)


def add_comment(code, seed: int = 42) -> Column:
    """Now and then, a comment line among the first lines."""
    row = F.col("id")
    comment = F.element_at(
        F.array(*[F.lit(c) for c in COMMENTS]), pick(len(COMMENTS), seed, row, "text") + 1
    )

    def inserted(lines):
        places = F.least(F.size(lines), F.lit(LAST_COMMENT_LINE)) + 1
        return F.array_insert(lines, pick(places, seed, row, "place") + 1, comment)

    chosen = chance(GATE, seed, row, "gate") & chance(P_COMMENT, seed, row, "comment")
    return F.when(chosen, F.array_join(bind(lines_of(code), inserted), "\n")).otherwise(code)


def augment(code, seed: int = 42) -> Column:
    return add_comment(add_whitespace(code, seed), seed)
