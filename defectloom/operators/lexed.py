"""Synthetic defects on lexed code: every place a rule fits is drawn, strings and comments are left alone.

A scanner cuts Python-like code into tokens, each with the blanks before it: strings (also over
several lines), comments, names, numbers, operators, line ends. Joined again they are the code. A rule
sees the token, its neighbours and the line it stands in, and changes each fitting place with the
rule's probability; a draw hashes the row's key, the rule and the token's number. So one code may get
several changes, and no text inside quotes or behind ``#`` is ever one of them.

One pass over the tokens finds numbers, swappable operators and line ends. Rules start from these or
from lines and give edits; what lies between two edits is joined as it is. Only the rule that renames
looks at each token again, those of one function.

Lines are those of the text: where a bracket stays open over a line end, rules that cut out whole lines
leave the place alone. A code that holds the three noncharacters which stand for escapes while it is scanned stays as it is.
A quoted string on one line ends with that line at the latest, an open triple quote with the text.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from defectloom.functions.bind import bind
from defectloom.functions.draws import chance, draw
from defectloom.operators.mutations import FAR_INDEX, SPREAD, SWAPPED

# Stand-ins for escaped backslashes and quotes, so that a quote always ends a string.
ESCAPES = (("\\\\", "\ufdd0"), ('\\"', "\ufdd1"), ("\\'", "\ufdd2"))
# Most tokens are names, single marks, line ends and numbers, so these come first; no letter of a string's
# prefix starts the first kind of names. Classes are single characters or \w and \d, which take one look each.
_CORES = (
    r"[ACDEGHIJKLMNOPQSTVWXYZ_acdeghijklmnopqstvwxyz]\w*+",
    r"[()\[\]{},.;\n]",
    r"\d[\w.]*+",
    r"""[rRbBuUfF]{0,2}+(?:"{3}[\s\S]*?(?:"{3}|\z)|'{3}[\s\S]*?(?:'{3}|\z)|"[^"\n]*+"?+|'[^'\n]*+'?+)""",
    r"[rRbBuUfF]\w*+",
    r"#[^\n]*+",
    r"\\\n",
    r"\*\*=?|//=?|<<=?|>>=?|->|[-+*/%&|^@=!<>:]=|[-+*/%&|^@=!<>~]",
    r"[^ \t]",
)
LEX = rf"[ \t]*+({'|'.join(_CORES)})|[ \t]+"

# Words after which no binary operator stands, operators and the chances of the rules.
KEYWORDS = (
    "and", "as", "assert", "del", "elif", "else", "for", "from", "if", "import", "in", "is", "lambda", "not", "or",
    "raise", "return", "while", "with", "yield",
)
ARITHMETIC = ("+", "-", "*", "/", "%", "//", "**", "&", "|", "^", "<<", ">>")
CONDITIONS = {"==": "!=", "!=": "==", "<": ">", ">": "<"}
OPERATOR_CHANCE, CONDITION_CHANCE, TYPE_CHANCE, LOGIC_CHANCE = 0.3, 0.3, 0.2, 0.2
RETURN_GONE, RETURN_CHANGED, ASSIGNMENT_GONE = 0.2, 0.3, 0.1

NULL_CHECK_CHANCE = 0.3
AFTER_IF, AFTER_FIRST = ("elif", "else"), ("elif", "else", "except", "finally")

RULES = (
    "off_by_one", "missing_null_check", "wrong_variable", "wrong_operator", "missing_return", "wrong_condition",
    "array_bounds", "type_error", "logic_error", "missing_initialisation",
)


def masked(code) -> Column:
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, code)


def unmasked(text) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[1]), F.lit(pair[0])), ESCAPES, text)


def _wholes(code) -> Column:
    return F.regexp_extract_all(code, F.lit(LEX), F.lit(0))


def _cores(code) -> Column:
    return F.regexp_extract_all(code, F.lit(LEX), F.lit(1))


def tokens_of(code) -> Column:
    """Tokens of masked code as (whole, core): with the blanks before it, and without."""
    return F.arrays_zip(_wholes(code).alias("whole"), _cores(code).alias("core"))


def _is_number(core) -> Column:
    return F.rlike(core, F.lit("^[0-9]{1,9}$"))


def _is_name(core) -> Column:
    return F.rlike(core, F.lit("^[A-Za-z_]")) & ~core.isin(*KEYWORDS)


def _operand(core) -> Column:
    """Whether a binary operator may follow."""
    ends = F.rlike(core, F.lit(r"""[\w)\]}"']\z"""))
    return F.coalesce(ends & ~core.isin(*KEYWORDS) & ~F.startswith(core, F.lit("#")), F.lit(False))


def _ends_line(core) -> Column:
    return core.isNull() | (core == "\n") | F.startswith(core, F.lit("#"))


def _balanced(cores) -> Column:
    opened = F.size(F.filter(cores, lambda c: c.isin("(", "[", "{")))
    return opened == F.size(F.filter(cores, lambda c: c.isin(")", "]", "}")))


def _some(places, use) -> Column:
    """``use`` of each place, without nulls."""
    return F.filter(F.transform(places, use), lambda x: x.isNotNull())


def _swap(core, pairs: dict[str, str]) -> Column:
    return reduce(lambda out, pair: out.when(core == pair[0], pair[1]), pairs.items(), F.when(F.lit(False), ""))


def _indent(wholes, cores, i) -> Column:
    return F.length(F.get(wholes, i)) - F.length(F.get(cores, i))


def _with_found(wholes, cores, use) -> Column:
    """``use`` of what rules start from: the places of numbers and operators, lines, lines that have code
    with their indent (``starts``), and the tokens unmasked.

    A line has the places of its first token and of its end, and the core of the first token, if any.
    """

    def is_mark(i):
        core = F.get(cores, i)
        # The cheapest test first: names are no less than "A".
        return (core < "A") & (((core >= "0") & (core < ":")) | core.isin("\n", *SWAPPED))

    def is_number(i):
        core = F.get(cores, i)
        return (core >= "0") & (core < ":") & _is_number(core)

    def line(ends, k):
        first = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
        end = F.coalesce(F.get(ends, k), F.size(cores))
        return F.struct(first.alias("at"), end.alias("end"), F.get(cores, first).alias("core"))

    def start(e):
        indent = _indent(wholes, cores, e["at"])
        return F.struct(e["at"].alias("at"), e["end"].alias("end"), e["core"].alias("core"), indent.alias("indent"))

    def shown(whole):
        # Stand-ins are no ASCII.
        return F.when(F.octet_length(whole) > F.length(whole), unmasked(whole)).otherwise(whole)

    def with_lines(marks, lines):
        coded = F.filter(lines, lambda e: ~_ends_line(e["core"]) & (e["core"] != ""))
        found = F.struct(
            F.filter(marks, is_number).alias("numbers"),
            F.filter(marks, lambda i: F.get(cores, i).isin(*SWAPPED)).alias("operators"),
            lines.alias("lines"),
            F.transform(coded, start).alias("starts"),
            F.transform(wholes, shown).alias("tokens"),
        )
        return bind(found, use)

    def with_ends(marks, ends):
        lines = F.transform(F.sequence(F.lit(0), F.size(ends)), lambda k: line(ends, k))
        return bind(lines, lambda found: with_lines(marks, found))

    def with_marks(marks):
        return bind(F.filter(marks, lambda i: F.get(cores, i) == "\n"), lambda ends: with_ends(marks, ends))

    places = F.sequence(F.lit(0), F.greatest(F.size(cores) - 1, F.lit(0)))
    return bind(F.filter(places, is_mark), with_marks)


class _Code:
    """A scanned code under the draws of one rule. Tokens go by their number; an edit puts ``text`` in
    the place of the tokens from ``at`` to before ``end``."""

    def __init__(self, wholes, cores, found, seed: int, key: tuple):
        self.wholes, self.cores = wholes, cores
        self.numbers, self.operators = found["numbers"], found["operators"]
        self.lines, self.starts = found["lines"], found["starts"]
        self.tokens = found["tokens"]
        self.seed, self.key = seed, key

    def core(self, i) -> Column:
        return F.get(self.cores, i)

    def size(self) -> Column:
        return F.size(self.cores)

    def between(self, a, b) -> Column:
        return F.slice(self.cores, a + 1, F.greatest(b - a, F.lit(0)))

    def indent(self, i) -> Column:
        return _indent(self.wholes, self.cores, i)

    def draw(self, *what) -> Column:
        return draw(self.seed, *self.key, *what)

    def chosen(self, p: float, at, name: str) -> Column:
        return chance(p, self.seed, *self.key, at, F.lit(name))

    def coin(self, i) -> Column:
        return self.draw(i, F.lit("coin")) % 2 == 0

    def number(self, i, low: int, high: int) -> Column:
        return (self.draw(i, F.lit("number")) % (high - low + 1) + low).cast("string")

    def subscript(self, i) -> Column:
        return (self.core(i - 1) == "[") & (self.core(i + 1) == "]") & _operand(self.core(i - 2))

    def edit(self, i, new, end=None) -> Column:
        """``new`` behind the blanks of token ``i`` instead of it, or of all up to ``end``."""
        blanks = F.left(F.get(self.wholes, i), self.indent(i))
        return F.struct(
            i.alias("at"), (i + 1 if end is None else end).alias("end"), F.concat(blanks, new).alias("text")
        )

    def without_line(self, line) -> Column:
        """``pass`` for a line that goes, but for a comment; null where a bracket stays open."""
        end = F.when(F.startswith(self.core(line["end"] - 1), F.lit("#")), line["end"] - 1).otherwise(line["end"])
        return F.when(_balanced(self.between(line["at"], line["end"])), self.edit(line["at"], F.lit("pass"), end))

    def text(self, a, b) -> Column:
        return F.array_join(F.slice(self.tokens, a + 1, b - a), "")

    def edited(self, edits, same) -> Column:
        """The unmasked code with ``edits``, in ascending order; ``same`` is the code as it was."""

        def piece(found, e, j):
            return F.concat(self.text(F.coalesce(F.get(found, j - 1)["end"], F.lit(0)), e["at"]), e["text"])

        def spliced(found):
            last = F.get(found, F.size(found) - 1)["end"]
            pieces = F.array_join(F.transform(found, lambda e, j: piece(found, e, j)), "")
            return F.when(F.size(found) > 0, F.concat(pieces, self.text(last, self.size()))).otherwise(same)

        return bind(edits, spliced)


def _off_by_one(c: _Code) -> Column:
    def use(i):
        in_range = (c.core(i - 1) == "(") & (c.core(i - 2) == "range") & (c.core(i - 3) == "in")
        value = c.core(i).cast("long")
        moved = F.when(c.coin(i), value + 1).otherwise(F.greatest(value - 1, F.lit(0))).cast("string")
        return F.when((in_range & c.core(i + 1).isin(",", ")")) | c.subscript(i), c.edit(i, moved))

    return _some(c.numbers, use)


def _array_bounds(c: _Code) -> Column:
    def use(i):
        moved = F.when(c.coin(i), c.number(i, -10, -1)).otherwise(c.number(i, *FAR_INDEX))
        return F.when(c.subscript(i), c.edit(i, moved))

    return _some(c.numbers, use)


def _wrong_operator(c: _Code) -> Column:
    def use(i):
        fits = _operand(c.core(i - 1)) & c.chosen(OPERATOR_CHANCE, i, "operator")
        return F.when(fits, c.edit(i, _swap(c.core(i), SWAPPED)))

    return _some(c.operators, use)


def _type_error(c: _Code) -> Column:
    def binary(at):
        return c.core(at).isin(*ARITHMETIC) & _operand(c.core(at - 1)) & c.chosen(TYPE_CHANCE, at, "type")

    def use(i):
        # The left side first; the right one only where the left is no number.
        fits = binary(i + 1) | (binary(i - 1) & ~F.coalesce(_is_number(c.core(i - 2)), F.lit(False)))
        return F.when(fits, c.edit(i, F.concat(F.lit('"error_'), c.core(i), F.lit('"'))))

    return _some(c.numbers, use)


def _logic_error(c: _Code) -> Column:
    def use(i):
        value = (c.core(i - 1) == "=") & _ends_line(c.core(i + 1)) & F.rlike(c.core(i - 2), F.lit("^[A-Za-z_]"))
        first = F.coalesce(c.core(i - 3) == "\n", i == 2)
        return F.when(value & first & c.chosen(LOGIC_CHANCE, i, "logic"), c.edit(i, c.number(i, -SPREAD, SPREAD)))

    return _some(c.numbers, use)


def _missing_return(c: _Code) -> Column:
    def use(line):
        a, i = line["at"], line["at"] + 1
        number = _is_number(c.core(i)) & _ends_line(c.core(i + 1)) & c.chosen(RETURN_CHANGED, a, "changed")
        changed = F.when(number, c.edit(i, c.number(i, -SPREAD, SPREAD)))
        return F.when(c.chosen(RETURN_GONE, a, "gone"), c.without_line(line)).otherwise(changed)

    return _some(F.filter(c.lines, lambda e: e["core"] == "return"), use)


def _missing_initialisation(c: _Code) -> Column:
    def use(line):
        return F.when(c.chosen(ASSIGNMENT_GONE, line["at"], "gone"), c.without_line(line))

    return _some(F.filter(c.lines, lambda e: (c.core(e["at"] + 1) == "=") & _is_name(e["core"])), use)


def _wrong_condition(c: _Code) -> Column:
    def chosen(line):
        one = ~F.exists(
            c.between(line["at"] + 1, line["end"]), lambda x: x.isin("and", "or", "not", "if", "lambda")
        )
        return line["core"].isin("if", "elif") & c.chosen(CONDITION_CHANCE, line["at"], "condition") & one

    def in_line(line):
        def use(core, j):
            i = line["at"] + j
            fits = core.isin(*CONDITIONS) & _balanced(c.between(line["at"], i))
            return F.when(fits, c.edit(i, _swap(core, CONDITIONS)))

        return _some(c.between(line["at"], line["end"]), use)

    return F.flatten(F.transform(F.filter(c.lines, chosen), in_line))


def _first_after(starts, at, indent, same, size) -> Column:
    """Where the block that holds ``at`` ends: at the next line no deeper than ``indent`` that isn't
    one of ``same`` at that very depth."""
    ends = F.filter(
        starts, lambda e: (e["at"] > at) & (e["indent"] <= indent) & ~((e["indent"] == indent) & e["core"].isin(*same))
    )
    return F.coalesce(F.array_min(ends["at"]), size)


def _missing_null_check(c: _Code) -> Column:
    """An ``if`` whose test has ``is`` gives way to the first statement of its block, with the blanks
    of the ``if``. Inside such a block nothing else is drawn."""

    def place(starts, e, k):
        def with_body(b):
            test = c.between(e["at"], e["end"])
            holds_is = F.exists(
                F.transform(test, lambda x, j: (x == "is") & ~F.coalesce(F.get(test, j + 1) == "not", F.lit(False))), lambda x: x
            )
            code = F.filter(test, lambda x: ~F.startswith(x, F.lit("#")))
            ends = F.get(code, F.size(code) - 1) == ":"
            return F.when((b["indent"] > e["indent"]) & holds_is & ends, spans(b))

        def spans(b):
            last = _first_after(starts, b["at"] - 1, e["indent"], AFTER_IF, c.size())
            first = F.least(last, _first_after(starts, b["at"], b["indent"], AFTER_FIRST, c.size()))
            return F.struct(
                e["at"].alias("at"), b["at"].alias("body"), first.alias("after"), last.alias("last"),
                (b["indent"] - e["indent"]).alias("deeper"),
            )

        is_if = (e["core"] == "if") & c.chosen(NULL_CHECK_CHANCE, e["at"], "check")
        return F.when(is_if, bind(F.get(starts, k + 1), with_body))

    def whole_statement(s):
        return _balanced(c.between(s["body"], s["after"])) & _balanced(c.between(s["at"], s["last"]))

    def edit(s):
        def dedented(whole, j):
            i = s["body"] + j
            starts_line = (c.core(i - 1) == "\n") & (c.indent(i) > 0)
            return F.when(starts_line, F.substr(whole, F.least(s["deeper"], c.indent(i)) + 1)).otherwise(whole)

        kept = F.transform(F.slice(c.tokens, s["body"] + 1, s["after"] - s["body"]), dedented)
        return F.struct(s["at"].alias("at"), s["last"].alias("end"), F.array_join(kept, "").alias("text"))

    def outer(places):
        return F.filter(
            places, lambda s: ~F.exists(places, lambda o: (o["at"] < s["at"]) & (s["at"] < o["last"]))
        )

    def from_starts(starts):
        found = _some(starts, lambda e, k: place(starts, e, k))
        return F.transform(bind(F.filter(found, whole_statement), outer), edit)

    return from_starts(c.starts)


def _wrong_variable(c: _Code) -> Column:
    """In one function, or the whole code without any, one assigned name or parameter stands where
    another one did; names after a dot and of keyword arguments stay."""

    def in_block(starts, block):
        def parameter(core, j):
            i = block["at"] + j
            fits = c.core(i - 1).isin("(", ",", "*", "**") & c.core(i + 1).isin(",", ")", "=", ":") & _is_name(core)
            return F.when(fits, core)

        def assigned(e):
            inside = (e["at"] >= block["at"]) & (e["at"] < block["last"])
            return inside & (c.core(e["at"] + 1) == "=") & _is_name(e["core"])

        # By their first place: no line starts among the parameters but that of the block itself.
        parameters = _some(c.between(block["at"], block["line_end"]), parameter)
        names = bind(
            F.filter(starts, assigned),
            lambda found: F.array_distinct(F.concat(
                F.filter(found, lambda e: e["at"] <= block["at"])["core"], parameters,
                F.filter(found, lambda e: e["at"] > block["at"])["core"],
            )),
        )
        return bind(names, lambda found: renamed(block, found))

    def renamed(block, names):
        def drawn(which):
            return F.get(names, (c.draw(F.lit(which)) % F.size(names)).cast("int"))

        def fits(old, i):
            before = c.core(i - 1)
            argument = (c.core(i + 1) == "=") & before.isin("(", ",") & (i >= block["line_end"])
            return (c.core(i) == old) & ~F.coalesce((before == ".") | argument, F.lit(False))

        def with_old(old):
            return F.filter(F.sequence(block["at"], block["last"] - 1), lambda i: fits(old, i))

        def with_new(new):
            return F.transform(bind(drawn("old"), with_old), lambda i: c.edit(i, new))

        return F.when(F.size(names) >= 2, bind(unmasked(drawn("new")), with_new))

    def from_starts(starts):
        defs = F.filter(starts, lambda e: e["core"] == "def")

        def block(d):
            line_end = F.array_min(F.filter(starts, lambda e: e["at"] > d["at"])["at"])
            last = _first_after(starts, d["at"], d["indent"], ("",), c.size())
            return F.struct(
                d["at"].alias("at"), F.coalesce(line_end, c.size()).alias("line_end"), last.alias("last")
            )

        def with_defs(found):
            none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line_end"), c.size().alias("last"))
            one = F.get(found, (c.draw(F.lit("block")) % F.size(found)).cast("int"))
            return F.when(F.size(found) == 0, none).otherwise(bind(one, block))

        return bind(bind(defs, with_defs), lambda b: in_block(starts, b))

    return from_starts(c.starts)


_EDITS = {
    "off_by_one": _off_by_one,
    "missing_null_check": _missing_null_check,
    "wrong_variable": _wrong_variable,
    "wrong_operator": _wrong_operator,
    "missing_return": _missing_return,
    "wrong_condition": _wrong_condition,
    "array_bounds": _array_bounds,
    "type_error": _type_error,
    "logic_error": _logic_error,
    "missing_initialisation": _missing_initialisation,
}


def changed_by_each(rules, code: Column, seed: int, key_of) -> Column:
    """``code`` as each of ``rules`` alone changes it, as an array in their order; it is scanned once.

    Every place of a rule is drawn; ``key_of(rule)`` names the draw. A code that is null has null for each.
    """

    def with_found(wholes, cores, found):
        def each(same):
            scanned = {rule: _Code(wholes, cores, found, seed, key_of(rule)) for rule in rules}
            return F.array(*[scanned[rule].edited(_EDITS[rule](scanned[rule]), same) for rule in rules])

        return bind(F.array_join(found["tokens"], ""), each)

    def with_cores(wholes, cores):
        return _with_found(wholes, cores, lambda found: with_found(wholes, cores, found))

    def scanned(text):
        return bind(_wholes(text), lambda wholes: bind(_cores(text), lambda cores: with_cores(wholes, cores)))

    marked = reduce(or_, [F.contains(code, F.lit(mark)) for _, mark in ESCAPES])
    holds = (F.octet_length(code) > F.length(code)) & marked
    stays = F.coalesce(holds, F.lit(True))
    return F.when(stays, F.array_repeat(code, len(rules))).otherwise(bind(masked(code), scanned))


def changed_by(rule: str, code: Column, seed: int, key: tuple) -> Column:
    """``code`` with every place of ``rule`` drawn; ``key`` names the draw."""
    return F.get(changed_by_each([rule], code, seed, lambda _: key), F.lit(0))


def mutate(code: Column, plan: Column, seed: int) -> Column:
    """The rules numbered in ``plan`` applied in turn; null where none changes the code."""
    steps = F.transform(plan, lambda number, i: F.struct(number.alias("number"), i.alias("step")))

    def apply(text, step):
        out = F.when(F.lit(False), text)
        for i, rule in enumerate(RULES):
            key = (F.col("id"), F.col("variant"), step["step"] + 1, F.lit(rule))
            out = out.when(step["number"] == i, changed_by(rule, text, seed, key))
        return out

    return bind(F.aggregate(steps, code, apply), lambda done: F.when(done != code, done))
