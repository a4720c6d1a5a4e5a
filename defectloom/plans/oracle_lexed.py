"""The SQL of the mutations on lexed code: tokens as rows, their neighbours and lines by windows."""

SEED, SPAN = 42, 1 << 32


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def draw(*key) -> str:
    parts = ", ".join(str(k) for k in (*key, SEED))
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT)"


def chance(p: float, *key) -> str:
    return f"({draw(*key)} < {int(p * SPAN)})"


# Written out here and not shared with the operators, so that a wrong rule shows.
_TRIPLES = "|".join("[rRbBuUfF]{0,2}" + q + r"[\s\S]*?(?:" + q + r"|\z)" for q in ('"""', "'''"))
_QUOTES = "|".join("[rRbBuUfF]{0,2}" + q + "[^" + q + r"\n]*" + q + "?" for q in ('"', "'"))
LEXER = (
    r"[ \t]*(" + _TRIPLES + "|" + _QUOTES + r"|#[^\n]*|\\\n|[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*"
    r"|\*\*=?|//=?|<<=?|>>=?|->|[-+*/%&|^@=!<>:]=|[-+*/%&|^@=!<>~]|[^ \t])|[ \t]+"
)

# The same functions as the binding makes, line by line.
LINES = [
    "def price_{k}(table, qty):", '    """total + limit == {n}', '    limit = 0"""', "    limit = {n}  # limit = 2 + 3",
    r"""    note = "if a == {n} + 1: \"{t}\"" + 'x\\'""", "    if table is None:", "        # nothing", "        if qty is limit:",
    "            limit = {n} + 1", '            note = ""', "        else:", "            qty = 4", "        return {n}",
    "    elif qty is not limit:", "        total = qty * {n}", "", "    def inner(total, step=2):",
    "        total = total - step * 2 + table[{m}]", "        if total == limit:", "            return -total", "        return 7",
    "", "    for i in range({n}):", "        total = inner(i + 1,", "                      step=3) + qty.qty",
    "    if total < {n} and qty != 2:", "        return table[{m}][0]", "    if total <= {n} - {m}:", "        qty = 5",
    "    if len(table[1:2]) == 3 ** 2:  # total < 1", "        return (total", "                / limit)", "    return total / limit", "",
]
_WORDS = (
    "('and','as','assert','del','elif','else','for','from','if','import','in','is','lambda','not','or','raise',"
    "'return','while','with','yield')"
)
_ARITHMETIC = "('+','-','*','/','%','//','**','&','|','^','<<','>>')"
_BRACKET = "CASE WHEN core IN ('(','[','{') THEN 1 WHEN core IN (')',']','}') THEN -1 ELSE 0 END"


def _number(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '[0-9]{{1,9}}'), false)"


def _name(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '^[A-Za-z_]') AND {x} NOT IN {_WORDS}, false)"


def _operand(x: str) -> str:
    last = text(r"""[A-Za-z0-9_)\]}"']$""")
    return f"coalesce(regexp_matches({x}, {last}) AND {x} NOT IN {_WORDS} AND NOT starts_with({x}, '#'), false)"


def _ends(x: str) -> str:
    return f"({x} IS NULL OR {x} = chr(10) OR starts_with({x}, '#'))"


def _drawn(rule: str, low: int, high: int) -> str:
    return f"CAST({draw('id', text(rule), 'i', text('number'))} % {high - low + 1} + {low} AS VARCHAR)"


def _coin(rule: str) -> str:
    return f"{draw('id', text(rule), 'i', text('coin'))} % 2 = 0"


def _lucky(p: float, rule: str, pos: str, what: str) -> str:
    return chance(p, "id", text(rule), pos, text(what))


def _swap(pairs: dict[str, str]) -> str:
    return "CASE core " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in pairs.items()) + " END"


def _line_gone(gone: str) -> str:
    return f"WHEN {gone} AND line_balance = 0 AND i < b AND NOT starts_with(core, '#') THEN CASE WHEN i = a THEN 'pass' ELSE '' END"


_SUBSCRIPT = f"({_number('core')} AND coalesce(p1 = '[' AND n1 = ']', false) AND {_operand('p2')})"
_IN_RANGE = "coalesce(p1 = '(' AND p2 = 'range' AND p3 = 'in' AND n1 IN (',', ')'), false)"
_MOVED = f"CASE WHEN {_coin('off_by_one')} THEN CAST(core AS BIGINT) + 1 ELSE greatest(CAST(core AS BIGINT) - 1, 0) END"
_LEFT = f"coalesce(n1 IN {_ARITHMETIC}, false) AND {_operand('core')} AND {_lucky(0.2, 'type_error', 'i + 1', 'type')}"
_RIGHT = (
    f"coalesce(p1 IN {_ARITHMETIC}, false) AND {_operand('p2')} AND {_lucky(0.2, 'type_error', 'i - 1', 'type')} "
    f"AND NOT {_number('p2')}"
)
_GONE = _lucky(0.2, "missing_return", "a", "gone")
_SWAPS = {"+": "-", "-": "+", "*": "/", "/": "*", "==": "!=", "!=": "==", "<=": ">=", ">=": "<=", "<": ">", ">": "<"}
_CONDITIONS = {"==": "!=", "!=": "==", "<": ">", ">": "<"}

# What stands in a token's place, null where it stays.
_NEW = {
    "off_by_one": f"CASE WHEN {_number('core')} AND ({_IN_RANGE} OR {_SUBSCRIPT}) THEN CAST({_MOVED} AS VARCHAR) END",
    "wrong_operator": f"CASE WHEN {_operand('p1')} AND {_lucky(0.3, 'wrong_operator', 'i', 'operator')} THEN {_swap(_SWAPS)} END",
    "missing_return": f"""CASE WHEN head <> 'return' THEN NULL {_line_gone(_GONE)}
      WHEN NOT {_GONE} AND i = a + 1 AND {_number('core')} AND {_ends('n1')} AND {_lucky(0.3, 'missing_return', 'a', 'changed')}
      THEN {_drawn('missing_return', -100, 100)} END""",
    "wrong_condition": f"""CASE WHEN head IN ('if', 'elif') AND NOT joined AND depth = 0
      AND {_lucky(0.3, 'wrong_condition', 'a', 'condition')} THEN {_swap(_CONDITIONS)} END""",
    "array_bounds": f"""CASE WHEN {_SUBSCRIPT} THEN CASE WHEN {_coin('array_bounds')} THEN {_drawn('array_bounds', -10, -1)}
      ELSE {_drawn('array_bounds', 100, 1000)} END END""",
    "type_error": f"""CASE WHEN {_number('core')} AND (({_LEFT}) OR ({_RIGHT})) THEN '"error_' || core || '"' END""",
    "logic_error": f"""CASE WHEN {_number('core')} AND p1 = '=' AND {_ends('n1')} AND i - a = 2
      AND coalesce(regexp_matches(p2, '^[A-Za-z_]'), false) AND {_lucky(0.2, 'logic_error', 'i', 'logic')}
      THEN {_drawn('logic_error', -100, 100)} END""",
    "missing_initialisation": f"""CASE WHEN NOT {_name('head')} OR second IS NULL OR second <> '=' THEN NULL
      {_line_gone(_lucky(0.1, 'missing_initialisation', 'a', 'gone'))} END""",
}


def _block_end(pos: str, depth: str, same: str) -> str:
    return (
        f"coalesce((SELECT min(x.pos) FROM starts x WHERE x.id = c.id AND x.pos > {pos} AND (x.indent < {depth} "
        f"OR x.indent = {depth} AND x.core NOT IN {same})), n)"
    )


def _sum_of(first: str, last: str) -> str:
    return f"(SELECT sum(bracket) FROM t WHERE t.id = s.id AND t.i >= {first} AND t.i < {last})"


def lexed_patterns() -> str:
    code = f"array_to_string([{', '.join(text(line) for line in LINES)}], chr(10))"
    for key, value in (("{k}", "p_partkey"), ("{n}", "p_size"), ("{m}", "p_size % 7"), ("{t}", "p_type")):
        code = f"replace({code}, '{key}', CAST({value} AS VARCHAR))"
    hidden, shown = "code", "out"
    for plain, mark in (("\\\\", 0xFDD0), ('\\"', 0xFDD1), ("\\'", 0xFDD2)):
        hidden = f"replace({hidden}, {text(plain)}, chr({mark}))"
        shown = f"replace({shown}, chr({mark}), {text(plain)})"
    made = "\nUNION ALL ".join(
        f"SELECT id, '{rule}' AS pattern, i, CASE WHEN new IS NULL THEN whole WHEN new = '' THEN '' "
        f"ELSE left(whole, indent) || new END AS piece FROM (SELECT *, {new} AS new FROM t)"
        for rule, new in _NEW.items()
    )
    variable = text("wrong_variable")
    return f"""WITH code AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {code} AS code FROM part),
lexed AS (
  SELECT id, regexp_extract_all({hidden}, {text(LEXER)}) AS wholes, regexp_extract_all({hidden}, {text(LEXER)}, 1) AS cores FROM code),
t0 AS (SELECT id, generate_subscripts(wholes, 1) - 1 AS i, unnest(wholes) AS whole, unnest(cores) AS core FROM lexed),
t1 AS (
  SELECT *, length(whole) - length(core) AS indent, lag(core) OVER w AS p1, lag(core, 2) OVER w AS p2, lag(core, 3) OVER w AS p3,
    lead(core) OVER w AS n1, count(*) OVER (PARTITION BY id) AS n, {_BRACKET} AS bracket,
    coalesce(sum(CASE WHEN core = chr(10) THEN 1 ELSE 0 END)
      OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln
  FROM t0 WINDOW w AS (PARTITION BY id ORDER BY i)),
lines AS (
  SELECT id, ln, min(i) AS a, coalesce(min(i) FILTER (core = chr(10)), any_value(n)) AS b, arg_min(core, i) AS head,
    list(core ORDER BY i)[2] AS second, sum(bracket) AS line_balance,
    count(*) FILTER (core IN ('and', 'or', 'not', 'lambda') OR core = 'if' AND p1 <> chr(10)) > 0 AS joined,
    count(*) FILTER (core = 'is' AND (n1 IS NULL OR n1 <> 'not')) > 0 AS has_is,
    arg_max(core, i) FILTER (core <> chr(10) AND NOT starts_with(core, '#')) AS last_code
  FROM t1 GROUP BY id, ln),
t AS (
  SELECT t1.*, lines.* EXCLUDE (id, ln), coalesce(sum(bracket)
      OVER (PARTITION BY t1.id, t1.ln ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
  FROM t1 JOIN lines ON lines.id = t1.id AND lines.ln = t1.ln),
starts AS (SELECT id, i AS pos, indent, core, b, n, has_is, last_code FROM t WHERE i = a AND NOT {_ends('core')} AND core <> ''),
checks AS (
  SELECT s.id, s.pos, s.indent, s.n, min(x.pos) AS body, arg_min(x.indent, x.pos) AS inner_indent
  FROM starts s JOIN starts x ON x.id = s.id AND x.pos > s.b
  WHERE s.core = 'if' AND s.has_is AND s.last_code = ':' AND {chance(0.3, 's.id', text('missing_null_check'), 's.pos', text('check'))}
  GROUP BY ALL HAVING arg_min(x.indent, x.pos) > s.indent),
spans AS (
  SELECT c.*, {_block_end('c.body - 1', 'c.indent', "('elif', 'else')")} AS last,
    {_block_end('c.body', 'c.inner_indent', "('elif', 'else', 'except', 'finally')")} AS after
  FROM checks c),
whole_spans AS (
  SELECT * FROM spans s WHERE {_sum_of('s.pos', 's.last')} = 0 AND {_sum_of('s.body', 's.after')} = 0),
outer_spans AS (
  SELECT * FROM whole_spans s
  WHERE NOT EXISTS (SELECT 1 FROM whole_spans o WHERE o.id = s.id AND o.pos < s.pos AND s.pos < o.last)),
defs AS (
  SELECT id, pos, indent, n, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY id) AS defs
  FROM starts WHERE core = 'def'),
blocks AS (
  SELECT c.id, c.pos, {_block_end('c.pos', 'c.indent', "('')")} AS last,
    coalesce((SELECT min(pos) FROM starts x WHERE x.id = c.id AND x.pos > c.pos), n) AS line_end
  FROM defs c WHERE c.k = {draw('c.id', variable, text('block'))} % defs),
named AS (
  SELECT t.id, core, min(i) AS first FROM t JOIN blocks k ON k.id = t.id AND t.i >= k.pos AND t.i < k.last
  WHERE {_name('core')} AND ((t.i = t.a AND n1 = '=')
    OR (t.i < k.line_end AND p1 IN ('(', ',', '*', '**') AND n1 IN (',', ')', '=', ':')))
  GROUP BY ALL),
names AS (SELECT id, list(core ORDER BY first) AS names FROM named GROUP BY id),
pairs AS (
  SELECT id, names[{draw('id', variable, text('old'))} % len(names) + 1] AS old,
    names[{draw('id', variable, text('new'))} % len(names) + 1] AS new
  FROM names WHERE len(names) > 1),
pieces AS (
{made}
UNION ALL
SELECT t.id, 'missing_null_check', t.i, CASE WHEN s.id IS NULL THEN whole WHEN t.i < body OR t.i >= after THEN ''
  WHEN p1 = chr(10) THEN substr(whole, least(inner_indent - s.indent, t.indent) + 1) ELSE whole END
FROM t LEFT JOIN outer_spans s ON s.id = t.id AND t.i >= s.pos AND t.i < s.last
UNION ALL
SELECT t.id, 'wrong_variable', t.i, CASE WHEN core = old AND t.i >= k.pos AND t.i < k.last AND coalesce(p1, '') <> '.'
  AND NOT coalesce(n1 = '=' AND p1 IN ('(', ',') AND t.i >= k.line_end, false) THEN left(whole, t.indent) || new ELSE whole END
FROM t LEFT JOIN blocks k ON k.id = t.id LEFT JOIN pairs p ON p.id = t.id),
joined AS (SELECT id, pattern, string_agg(piece, '' ORDER BY i) AS out FROM pieces GROUP BY ALL)
SELECT id, pattern, {shown} AS mutant FROM joined"""
