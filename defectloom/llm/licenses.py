"""Licences of documents: passages and windows compared with templates by Dice over word bigrams.

Passages are the lines of a text, its paragraphs and the whole text. Letters and digits count,
in lower case; everything else parts words. A passage and a template are alike by
2 |A and B| / (|A| + |B|) over their sets of bigrams. This can only reach ``least`` where the
smaller set has least / (2 - least) of the larger one's size, so other templates are not compared.
A licence is found if a passage reaches ``least`` with one of its templates, and of several
licences for a passage the most alike, by name on a tie.

A notice may also be part of a line or run over paragraphs. So windows of the whole text are
compared with each template of which the text holds the least / (2 - least) of the bigrams that
any match needs. A window that starts or ends beside a bigram of the template is no more alike
than the one that takes it in, so windows run from the start of one run of the template's bigrams
to the end of the same or a later one, up to twice the upper size bound in words. Of overlapping
windows the most alike counts, on a tie the first by name, then the one that starts and ends last.
The score is the best of all passages and windows.

Everything happens inside a row, with column functions; no row moves. Null or empty text: no
licence. Very long text: read whole, its work bounded by its bigrams and, per template, by its runs.
Null doc_id, repeated rows: each row has its own result. Empty table: no rows. Other columns are
ignored.
"""

import json
import re

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from defectloom.functions.bind import bind
from defectloom.llm.license_texts import NOTICES
from defectloom.llm.pii import prefix_sums

LEAST = 0.8
# Fixed value: what parts words.
BETWEEN = r"[^\p{L}\p{N}]+"
PARAGRAPHS = r"\n[ \t\r]*\n"


def _words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), BETWEEN, " ")), " ")


def _pairs(words: Column) -> Column:
    """All bigrams in their order, each as a 64-bit hash."""
    return F.transform(
        F.slice(words, F.lit(1), F.size(words) - 1), lambda w, i: F.xxhash64(w, F.get(words, i + 1))
    )


def _bigrams(words: Column) -> Column:
    """The distinct bigrams."""
    return F.array_distinct(_pairs(words))


def _texts(notices: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """Name and words of each template, in the order of the names."""
    return [(name, re.findall(r"[^\W_]+", text.lower())) for name in sorted(notices) for text in notices[name]]


def _hash(a: str, b: str) -> int:
    """The hash that ``_pairs`` gives the bigram: XXH64 from word to word, starting with 42."""
    value = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return value - (1 << 64) if value >> 63 else value


def _constant(value, kind: str) -> Column:
    """One literal, however large: Spark reads it once when it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _templates(notices: dict[str, list[str]], least: float) -> Column:
    """All templates as one constant array, so that an expression can loop over it.

    Each has its name, its place in the order (falling, so that of equal scores the first name is
    greatest), its bigrams and their number, how many of them any match needs, and how far a window
    may reach.
    """
    share = least / (2 - least)
    rows = []
    for rank, (name, words) in enumerate(_texts(notices)):
        own = list(dict.fromkeys(_hash(a, b) for a, b in zip(words, words[1:])))
        rows.append(
            {"name": name, "rank": -rank, "n": len(own), "need": len(own) * share - 1e-9,
             "reach": int(2 * len(words) / share) + 1, "own": own}
        )
    return _constant(rows, "array<struct<name: string, rank: int, n: int, need: double, reach: int, own: array<bigint>>>")


def licence_scores(passage: Column, notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> Column:
    """The licence most like the passage as struct (score, name), or null below ``least``."""
    templates, share = _templates(notices, least), least / (2 - least)
    smallest = min(len(set(zip(words, words[1:]))) for _, words in _texts(notices)) * share

    def best(bigrams: Column) -> Column:
        size = F.size(bigrams)
        fit = F.filter(templates, lambda t: size.between(t["n"] * share, t["n"] / share))
        scores = F.transform(
            fit,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(bigrams, t["own"])) / (size + t["n"])).alias("score"),
                t["rank"].alias("rank"),
                t["name"].alias("name"),
            ),
        )
        return F.array_max(scores)

    def of_words(words: Column) -> Column:
        return F.when(F.size(words) - 1 >= smallest, bind(_bigrams(words), best))

    found = bind(_words(passage), of_words)
    return bind(found, lambda b: F.when(b["score"] >= least, F.struct(b["score"].alias("score"), b["name"].alias("name"))))


def passages(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.array_distinct(F.concat(lines, F.split(text, PARAGRAPHS), F.array(text)))


WINDOW = "struct<score: double, rank: int, start: int, end: int, name: string>"


def _windows(pairs: Column, template: Column, least: float) -> Column:
    """The windows of a text's bigrams that reach ``least`` with a template."""
    n, own = template["n"], template["own"]

    def of_runs(hit: Column, before: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hit) - 1)
        at = lambda i: F.coalesce(F.get(hit, i), F.lit(0)) == 1
        starts = F.filter(places, lambda i: at(i) & ~at(i - 1))
        ends = F.filter(places, lambda i: at(i) & ~at(i + 1))

        def scored(start: Column, end: Column) -> Column:
            window = F.array_distinct(F.slice(pairs, start + 1, end - start + 1))
            score = lambda w: 2.0 * F.size(F.array_intersect(w, own)) / (F.size(w) + n)
            return F.struct(
                bind(window, score).alias("score"), template["rank"].alias("rank"), start.alias("start"),
                end.alias("end"), template["name"].alias("name"),
            )

        def of_start(ends: Column, start: Column, i: Column) -> Column:
            # Each run but the last has a gap after it.
            later = F.filter(
                F.slice(ends, i + 1, (template["reach"] / 2).cast("int") + 1),
                lambda e, k: ((k == 0) | (e - start < template["reach"]))
                & (F.get(before, e) - F.get(before, start) + 1 >= template["need"]),
            )
            return F.transform(later, lambda e: scored(start, e))

        return bind(ends, lambda e: F.flatten(F.transform(starts, lambda start, i: of_start(e, start, i))))

    hits = F.transform(pairs, lambda h: F.array_contains(own, h).cast("int"))
    windows = bind(hits, lambda hit: bind(prefix_sums(hit), lambda before: of_runs(hit, before)))
    return F.filter(windows, lambda w: w["score"] >= least)


def window_licences(text: Column, notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> Column:
    """The windows of a text that are licences, the most alike first."""
    templates = _templates(notices, least)
    known = {_hash(a, b) for _, words in _texts(notices) for a, b in zip(words, words[1:])}
    known = _constant(sorted(known), "array<bigint>")
    none = F.array().cast(f"array<{WINDOW}>")

    def possible(pairs: Column) -> Column:
        return bind(
            F.array_intersect(pairs, known),
            lambda held: F.filter(templates, lambda t: F.size(F.array_intersect(t["own"], held)) >= t["need"]),
        )

    def search(pairs: Column, found: Column) -> Column:
        every = F.flatten(F.transform(found, lambda t: _windows(pairs, t, least)))
        apart = lambda a, w: (a["end"] < w["start"]) | (w["end"] < a["start"])
        return F.aggregate(
            F.reverse(F.array_sort(every)), none,
            lambda acc, w: F.when(F.forall(acc, lambda a: apart(a, w)), F.concat(acc, F.array(w))).otherwise(acc),
        )

    def of_pairs(pairs: Column) -> Column:
        return bind(possible(pairs), lambda found: F.when(F.size(found) > 0, search(pairs, found)).otherwise(none))

    return bind(_words(text), lambda words: F.when(F.size(words) > 1, bind(_pairs(words), of_pairs)).otherwise(none))


def scan_licences(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    notices: dict[str, list[str]] = NOTICES,
    least: float = LEAST,
) -> DataFrame:
    """One row per document: ``doc_id``, the names found, in order, and the best ``score``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = F.transform(passages(F.col("text")), lambda p: licence_scores(p, notices, least))
    rows = rows.withColumns(
        {
            "found": F.filter(found, lambda f: f.isNotNull()),
            "windows": window_licences(F.col("text"), notices, least),
        }
    )
    names = F.concat(F.transform("found", lambda f: f["name"]), F.transform("windows", lambda w: w["name"]))
    # The windows stand by falling score.
    score = F.greatest(F.array_max(F.transform("found", lambda f: f["score"])), F.get("windows", F.lit(0))["score"])
    return rows.select("doc_id", F.array_sort(F.array_distinct(names)).alias("licences"), score.alias("score"))
