"""Personal data: base patterns, and the words near them that would give them away.

Base spans are emails, addresses of machines, card and phone numbers, found with built-in
regular expressions. Each distinct value is a protected entity. For every word close to an
entity the whole corpus tells how strongly it reveals the entity: the pointwise mutual information
ln(p(c|t) / p(c)) over documents, as a share of the entity's information ln(1 / p(c)). p(c|t), the
part of the documents with the word that have it near the entity, is shrunk to p(c) as if ``doubt``
further documents had the word: what one document shows counts, but less than what many show, and
no pair is left out. Words whose share reaches ``generalise_at`` are replaced by their class, from
``remove_at`` on they are removed, where they stand near that entity. A document without personal
data is never changed. Ties: a share equal to a threshold reaches it.

Everything is column expressions. Loops over groups are avoided in the patterns, since a group
repeated over a long run exhausts the regular expression engine's stack: separators that may join
two characters are first replaced by a mark of the same length. A step is only taken for texts
that can hold a match.

Null or empty text: no spans. Very long texts are read whole. Null doc_id and repeated rows: each row has its own result, which
depends on the text and the corpus. Empty table: no rows. Other columns are ignored, or kept as
they are by ``sanitise``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.llm.store import keep, packed

# The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR = 80
DOUBT = 3.0
GENERALISE_AT, REMOVE_AT = 0.75, 0.9
WORD = r"\p{L}{3,}"
MARK, OTHER = "\x01", "\x02"
BLOCK = 128

SPAN = "struct<start: int, rank: int, end: int, kind: string, entity: string>"
NEAR_WORD = "struct<entity: string, word: string, start: int, end: int, upper: boolean>"


def _none(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an integer array, block by block to spare copies."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK)),
        lambda b: F.slice(values, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)),
    )

    def running(array: Column) -> Column:
        return F.aggregate(
            array, _none("int"),
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)),
        )

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda acc, x: acc + x)

    before = F.concat(F.array(F.lit(0)), running(F.transform(blocks, total)))
    shifted = F.zip_with(
        F.transform(blocks, running), before,
        lambda own, b: F.transform(F.coalesce(own, _none("int")), lambda x: x + b),
    )
    return F.when(F.size(values) == 0, _none("int")).otherwise(F.flatten(shifted))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        x = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


# For each kind: what a text needs to hold a match, the joining separators that are marked, the
# pattern over the marked text, the entity of a match and its check.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+\x01-]", r"[A-Za-z0-9-]"


def _rules() -> dict:
    return {
        "email": (
            lambda t: F.contains(t, F.lit("@")),
            rf"(?<={_DOMAIN})\.(?={_DOMAIN})",
            # A match starts where a run starts, or where the match before it ended.
            rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++\x01[A-Za-z0-9\x01-]++",
            lambda v: F.lower(F.translate(v, MARK, ".")),
            lambda v: F.lit(True),
        ),
        "ip": (
            lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
            None,
            r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
            lambda v: v,
            lambda v: F.forall(F.split(v, r"\."), _octet),
        ),
        "card": (
            lambda t: F.rlike(t, F.lit("[0-9](?:[ -]?[0-9]){11}")),
            "(?<=[0-9])[ -](?=[0-9])",
            r"(?<![0-9\x01])[0-9][0-9\x01]++",
            _digits,
            lambda v: F.when(F.length(v).between(12, 19), _luhn(v)).otherwise(False),
        ),
        "phone": (
            lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
            None,
            r"\+[0-9][ ().0-9-]+[0-9]",
            _digits,
            lambda v: F.length(v).between(9, 15),
        ),
    }


def with_base_spans(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Add all base spans of each text, by start and then kind."""
    kept, rules = docs.columns, _rules()
    out = docs
    for kind, (may, joint, *_rest) in rules.items():
        plain = F.translate(F.col(text), MARK, OTHER) if joint else F.col(text)
        marked = F.regexp_replace(plain, joint, MARK) if joint else plain
        out = out.withColumn(f"_t_{kind}", F.when(may(F.col(text)), marked))
    for kind, (_, _, pattern, *_rest) in rules.items():
        marked, none = F.col(f"_t_{kind}"), _none("string")
        out = out.withColumns(
            {
                f"_m_{kind}": F.coalesce(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)), none),
                f"_p_{kind}": F.coalesce(F.split(marked, pattern, -1), none),
            }
        )
    for kind in rules:
        matches, pieces = F.col(f"_m_{kind}"), F.col(f"_p_{kind}")
        gaps = F.transform(
            matches,
            lambda m, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)),
        )
        out = out.withColumn(f"_g_{kind}", gaps)
    for kind in rules:
        out = out.withColumn(f"_s_{kind}", prefix_sums(F.col(f"_g_{kind}")))
    lists = []
    for rank, (kind, (_, _, _, entity, check)) in enumerate(rules.items()):
        starts = F.col(f"_s_{kind}")
        spans = F.transform(
            F.col(f"_m_{kind}"),
            lambda m, i: F.struct(
                F.get(starts, i).alias("start"), F.lit(rank).alias("rank"),
                (F.get(starts, i) + F.length(m)).alias("end"), F.lit(kind).alias("kind"),
                entity(m).alias("entity"),
            ),
        )
        lists.append(F.filter(spans, lambda s: check(s["entity"])))
    return out.withColumn(into, F.array_sort(F.concat(*lists))).select(*kept, into)


def _words_near(text: Column, span: Column) -> Column:
    """The whole words within ``NEAR`` characters before and after a span, with their places."""

    def words(window: Column, at: Column, cut_before: Column, cut_after: Column) -> Column:
        # A blank on either side tells whole words from those the window cuts.
        found = F.regexp_extract_all(window, F.lit(WORD), F.lit(0))
        pieces = F.split(window, WORD, -1)

        def place(m, i):
            head = F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda acc, p: acc + F.length(p))
            own = F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p))
            start = head + own
            return F.struct(
                span["entity"].alias("entity"), F.lower(m).alias("word"), (at + start).alias("start"),
                (at + start + F.length(m)).alias("end"),
                (F.substring(m, 1, 1) != F.lower(F.substring(m, 1, 1))).alias("upper"),
            )

        whole = F.length(window)
        return F.filter(
            F.transform(found, place),
            lambda w: ~(cut_before & (w["start"] == at)) & ~(cut_after & (w["end"] == at + whole)),
        )

    first = F.greatest(span["start"] - NEAR, F.lit(0))
    before = F.substring(text, first + 1, span["start"] - first)
    after = F.substring(text, span["end"] + 1, F.lit(NEAR))
    no = F.lit(False)
    return F.concat(
        words(before, first, first > 0, no), words(after, span["end"], no, F.length(after) == NEAR)
    )


def _find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The base spans of each row and the words near them, as a written table without texts."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = with_base_spans(rows, "text", "spans")
    near = F.flatten(F.transform("spans", lambda s: _words_near(F.col("text"), s)))
    near = F.when(F.size("spans") == 0, _none(NEAR_WORD)).otherwise(near)
    # Words inside another base span belong to it.
    rows = rows.withColumn("_near", near)
    inside = F.filter(
        "_near",
        lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])),
    )
    return keep(rows.select("doc_id", text_key("text").alias("own"), "spans", inside.alias("near")), "found")


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def revealing_words(
    docs: DataFrame,
    found: DataFrame,
    text: str = "text",
    doubt: float = DOUBT,
    generalise_at: float = GENERALISE_AT,
) -> DataFrame:
    """(entity, word, share) for every pair above the threshold, by counts over all documents."""
    entities = F.array_distinct(F.transform("spans", lambda s: s["entity"]))
    with_entity = found.select(F.explode(entities).alias("entity")).groupBy("entity")
    with_entity = with_entity.agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = F.transform("near", lambda w: F.struct(w["entity"].alias("entity"), w["word"].alias("word")))
    both = found.select(F.explode(F.array_distinct(pairs)).alias("p")).groupBy("p.entity", "p.word")
    both = both.agg(F.count(F.lit(1)).alias("n_both"))
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    words = F.array_distinct(F.transform(words, F.lower))
    with_word = docs.select(F.explode(words).alias("word")).groupBy("word")
    # Counted before the join: a word is one row per task then.
    with_word = with_word.agg(F.count(F.lit(1)).alias("n_word"))
    rows = found.agg(F.count(F.lit(1))).scalar()
    known = F.log(rows / F.col("n_entity"))
    # The part of the word's documents, shrunk, over the part of all documents.
    lift = (F.col("n_both") * rows / F.col("n_entity") + doubt) / (F.col("n_word") + doubt)
    share = F.log(lift) / known
    paired = both.join(with_entity, "entity").join(with_word, "word")
    paired = paired.select("entity", "word", F.when(known > 0, share).alias("share"))
    return paired.where(F.col("share") >= generalise_at)


def _term_spans(found: DataFrame, revealing: DataFrame, remove_at: float) -> DataFrame:
    """The places of revealing words, per distinct text."""
    distinct = found.where(F.size("near") > 0).groupBy("own").agg(F.any_value("near").alias("near"))
    places = distinct.select("own", F.explode("near").alias("w")).select("own", "w.*")
    hits = places.join(revealing, ["entity", "word"]).groupBy("own", "start", "end", "upper")
    hits = hits.agg((F.max("share") >= remove_at).alias("gone"))
    term = F.struct(
        "start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(TERM).alias("kind"),
        F.when(F.col("gone"), "").when(F.col("upper"), "[NAME]").otherwise("[WORD]").alias("instead"),
    )
    return keep(hits.groupBy("own").agg(F.array_sort(F.collect_list(term)).alias("terms")), "terms")


def _listed(spans: Column) -> Column:
    named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(named, ",")


def personal_data(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    doubt: float = DOUBT,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """One row per document: ``doc_id``, base spans and all spans (structs), the base ones as text
    and all as text (``kind:start:end``, in code points)."""
    found = _find(docs, key, text)
    revealing = keep(revealing_words(docs, found, text, doubt, generalise_at), "revealing")
    terms = _term_spans(found, revealing, remove_at)
    place = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    element = "struct<start: int, rank: int, end: int, kind: string>"
    every = F.concat(
        F.transform("spans", place), F.coalesce(F.transform("terms", place), _none(element))
    )
    rows = found.join(terms, "own", "left").select("doc_id", "spans", F.array_sort(every).alias("all_spans"))
    return rows.withColumns({"base_text": _listed(F.col("spans")), "spans_text": _listed(F.col("all_spans"))})


def sanitise(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    doubt: float = DOUBT,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """``docs`` with each base span replaced by its kind in brackets and each revealing word
    generalised or removed. Where spans overlap, the first one's replacement stands for all."""
    found = _find(docs, key, text)
    revealing = keep(revealing_words(docs, found, text, doubt, generalise_at), "revealing")
    terms = _term_spans(found, revealing, remove_at)
    element = "struct<start: int, end: int, instead: string>"
    rows = with_base_spans(packed(docs, text=text).withColumn("own", text_key("text")), "text", "spans")
    rows = rows.join(terms, "own", "left")
    base = F.transform(
        "spans",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("instead")),
    )
    extra = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["instead"].alias("instead")))
    rows = rows.withColumn("every", F.array_sort(F.concat(base, F.coalesce(extra, _none(element)))))
    source = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        clean = F.concat(acc["out"], F.substring(source, acc["at"] + 1, s["start"] - acc["at"]), s["instead"])
        return F.struct(
            F.when(s["start"] >= acc["at"], clean).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(source, acc["at"] + 1, F.length(source)))
    cleaned = F.when(F.size("every") == 0, source).otherwise(F.aggregate("every", start, step, rest))
    return rows.select(F.col("row").withField(f"`{text}`", cleaned).alias("row")).select("row.*")
