"""The registered queries as ANSI SQL over the same tables, for a second engine to check."""

from defectloom.plans.oracle_lexed import lexed_patterns

# Patterns and values are written out here once more and not shared with the operators, so that a
# wrong one shows.
PY_SPACE = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
HUNK_HEADER = r"^@@[^ ]* -?[+-]?[0-9]+(_[0-9]+)*(,[^ ]*)? "
BLOCK_START = rf"^[{PY_SPACE}]*(def |class )[{PY_SPACE}]*[^{PY_SPACE}]"
DEF_NAME = rf"def[{PY_SPACE}]+([a-zA-Z_][a-zA-Z0-9_]*)[{PY_SPACE}]*[(]"
CLASS_NAME = rf"class[{PY_SPACE}]+([a-zA-Z_][a-zA-Z0-9_]*)"
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_\t-\r ]"
COMMENTS = [
    '# TODO: review this code',
    '# FIXME: potential issue here',
    '# NOTE: important implementation',
    '# BUG: needs investigation',
]
GRAPH_PROGRAMS = [
    "breadth_first_search", "depth_first_search", "detect_cycle", "minimum_spanning_tree",
    "reverse_linked_list", "shortest_path_length", "shortest_path_lengths", "shortest_paths",
    "topological_ordering",
]
REPLACEMENTS = [
    ("+", "-"), ("-", "+"), ("==", "!="), ("!=", "=="), ("<", ">"), (">", "<"), ("True", "False"),
    ("False", "True"), ("return", "# return"), ("if ", "# if "),
]
SWAPS = [("+", "-"), ("-", "+"), ("*", "/"), ("/", "*"), ("==", "!="), ("!=", "=="), ("<=", ">="), (">=", "<="), ("<", ">"), (">", "<")]

SEED = 42
SPAN = 1 << 32
WEEK = "TIMESTAMP '2024-01-24 00:00:00'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{PY_SPACE}]+|[{PY_SPACE}]+\\z', '', 'g')"


def draw(*key) -> str:
    parts = ", ".join(str(k) for k in (*key, SEED))
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT)"


def chance(p: float, *key) -> str:
    return f"({draw(*key)} < {int(p * SPAN)})"


def code_like(x: str) -> str:
    return f"replace(replace(replace({x}, 'The ', 'def '), 'De ', 'class '), ',', '(')"


def function_name(x: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({x}, '{DEF_NAME}', 1), ''), "
        f"nullif(regexp_extract({x}, '{CLASS_NAME}', 1), ''), 'module')"
    )


def truncated(x: str) -> str:
    return (
        f"CASE WHEN length({x}) <= 4000 THEN {x} "
        f"ELSE regexp_extract(substr({x}, 1, 4000), '(?s)^(.*)\\n', 1) END"
    )


SAMPLES = f"""samples AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang AS source, d.source AS project,
         d.source || '/' || d.doc_id AS path, {function_name(code_like('d.text'))} AS func_name,
         d.text AS code, CAST(1 - l.quality AS INTEGER) AS is_buggy,
         CAST(d.doc_id // 2 AS VARCHAR) AS pair_id
  FROM documents d JOIN labels l USING (doc_id))"""

CORPUS = """corpus AS (
  SELECT doc_id AS id, source AS project, lang, n_chars, text AS code FROM documents)"""


def ranges(train: float, val: float) -> str:
    first = f"CAST(floor({train}::DOUBLE * n) AS INTEGER)"
    second = f"({first} + CAST(floor({val}::DOUBLE * n) AS INTEGER))"
    return f"CASE WHEN pos < {first} THEN 'train' WHEN pos < {second} THEN 'val' ELSE 'test' END"


def project_split(where: str, order: str, train: float, val: float) -> str:
    return f"""project_split AS (
  SELECT project, {ranges(train, val)} AS split
  FROM (SELECT project, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n
        FROM (SELECT DISTINCT project FROM samples WHERE {where}) p) q)"""


SPLIT_SAMPLES = (
    SAMPLES
    + ", "
    + project_split("source = 'en'", "project", 0.7, 0.15)
    + """, split_samples AS (
  SELECT s.*, CASE WHEN s.source <> 'en' THEN 'eval' ELSE p.split END AS split
  FROM samples s LEFT JOIN project_split p USING (project))"""
)

STATS = (
    SPLIT_SAMPLES
    + """, stats AS (
  SELECT split, count(*) AS samples, count(*) FILTER (is_buggy = 1) AS buggy,
         count(*) FILTER (is_buggy = 0) AS clean, count(DISTINCT project) AS projects,
         avg(length(code)) AS avg_length,
         count(*) FILTER (is_buggy = 1)::DOUBLE / count(*) AS buggy_ratio
  FROM split_samples GROUP BY split)"""
)

TURNS = """defects AS (
  SELECT conv_id || '_' || turn AS stem, 'user/' || conv_id || '/' || turn AS path, text AS code
  FROM conversations WHERE role = 'user'),
fixes AS (
  SELECT conv_id || '_' || (turn - 1) AS stem, 'assistant/' || conv_id || '/' || turn AS path,
         text AS code
  FROM conversations WHERE role = 'assistant'),
"""
USABLE = (
    TURNS
    + f"""usable AS (
  SELECT d.stem, d.path AS buggy_path, d.code AS buggy_code, f.path AS fixed_path,
         f.code AS fixed_code
  FROM defects d JOIN fixes f USING (stem)
  WHERE length(d.code) > 0 AND length(f.code) > 0 AND {strip('d.code')} <> {strip('f.code')})"""
)

LOGITS = """logits AS (
  SELECT vec_id AS id, list_sum(list_transform(embedding[1:len(embedding) // 2], lambda x: x::DOUBLE)) AS z0,
         list_sum(list_transform(embedding[len(embedding) // 2 + 1:], lambda x: x::DOUBLE)) AS z1, label % 2 AS is_buggy
  FROM embeddings)"""


def probabilities(shift: str) -> str:
    return f"""scored AS (
  SELECT id, exp(z0) / (exp(z0) + exp({shift})) AS p0, exp({shift}) / (exp(z0) + exp({shift})) AS p1
  FROM logits)"""


PREDS = f"""{SPLIT_SAMPLES}, {LOGITS}, {probabilities('z1')}, preds AS (
  SELECT s.id, s.source, s.project, s.is_buggy, s.split, l.toxic AS yhat,
         greatest(c.p0, c.p1) AS score
  FROM split_samples s JOIN labels l ON s.id = CAST(l.doc_id AS VARCHAR)
  LEFT JOIN scored c ON c.id = l.doc_id)"""


def metrics(relation: str, by: str) -> str:
    """CTEs ``m`` (per label) and ``base`` (per group) of a predictions table."""
    return f"""m AS (
  SELECT {by}, label, tp, fp, fn,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
  FROM (SELECT {by}, label, count(*) FILTER (is_buggy = label AND yhat = label)::DOUBLE AS tp,
               count(*) FILTER (is_buggy <> label AND yhat = label)::DOUBLE AS fp,
               count(*) FILTER (is_buggy = label AND yhat <> label)::DOUBLE AS fn
        FROM {relation} CROSS JOIN (VALUES (0), (1)) AS l(label) GROUP BY {by}, label)
  WHERE tp + fp + fn > 0),
macro AS (
  SELECT {by}, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro
  FROM m GROUP BY {by}),
base AS (
  SELECT {by}, count(*) AS samples, avg(CASE WHEN is_buggy = yhat THEN 1.0 ELSE 0 END) AS accuracy,
         avg(score) AS avg_confidence, count(*) FILTER (is_buggy = 1) AS buggy_samples,
         count(*) FILTER (is_buggy = 0) AS clean_samples
  FROM {relation} GROUP BY {by})"""


METRIC_SELECT = """samples, round(accuracy, 6) AS accuracy,
  round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
  round(f1_macro, 6) AS f1_macro, round(avg_confidence, 6) AS avg_confidence, buggy_samples,
  clean_samples"""

OVERALL = f"{PREDS}, one AS (SELECT *, 1 AS g FROM preds), {metrics('one', 'g')}"

HISTORY = """history AS (
  SELECT user_id AS run_id, event_id AS step, value / 1000 AS f1 FROM events)"""

COMMITS = """commits AS (
  SELECT 'p' || (event_id // 5 % 7) AS project, CAST(event_id // 5 AS VARCHAR) AS bug,
         CASE event_type WHEN 'view' THEN 'requirements.txt' WHEN 'click' THEN 'run_test.sh'
              WHEN 'error' THEN 'bug.info' WHEN 'signup' THEN 'README.md' ELSE 'setup.cfg' END AS file,
         'u' || (user_id % 20) AS author, ts
  FROM events)"""

TOPS = f"""{COMMITS}, per_author AS (
  SELECT project, bug, file, author, count(*) AS n, count(*) FILTER (ts >= {WEEK}) AS n_week
  FROM commits GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project, bug, file ORDER BY n DESC, author) AS r,
         row_number() OVER (PARTITION BY project, bug, file ORDER BY n_week DESC, author) AS rw
  FROM per_author),
tops AS (
  SELECT project, bug, file, max(author) FILTER (r = 1) AS author,
         max(author) FILTER (rw = 1 AND n_week > 0) AS week_author
  FROM ranked GROUP BY project, bug, file)"""

VERIFIED = """verified AS (
  SELECT DISTINCT 'p' || (event_id // 5 % 7) AS project, CAST(event_id // 5 AS VARCHAR) AS bug
  FROM events WHERE event_type IN ('error', 'signup'))"""


def first_owner(name: str, files: list[str]) -> str:
    rank = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(files))
    return f"""{name} AS (
  SELECT project, bug, author AS owner, week_author AS week_owner
  FROM (SELECT *, row_number() OVER (PARTITION BY project, bug ORDER BY CASE file {rank} END) AS k
        FROM tops WHERE file NOT IN ('README.md', 'setup.cfg')) t WHERE k = 1)"""


BOARD = (
    f"{TOPS}, {VERIFIED}, "
    + first_owner("owners", ["requirements.txt", "run_test.sh", "bug.info"])
    + ", "
    + first_owner("check_owners", ["run_test.sh", "requirements.txt", "bug.info"])
    + ", checked AS (SELECT c.* FROM check_owners c JOIN verified v USING (project, bug))"
)


def contributors(name: str, column: str) -> str:
    return f"""{name} AS (
  SELECT b.name, b.bugs, coalesce(v.verified, 0) AS verified
  FROM (SELECT {column} AS name, count(*) AS bugs FROM owners
        WHERE {column} IS NOT NULL GROUP BY 1) b
  LEFT JOIN (SELECT {column} AS name, count(*) AS verified FROM checked
             WHERE {column} IS NOT NULL GROUP BY 1) v USING (name))"""


PATCHES = """patches AS (
  SELECT id, 'diff --git a/x b/x' || chr(10) || 'index 1..2' || chr(10) || '--- a/x' || chr(10)
         || '+++ b/x' || chr(10) || array_to_string(list_transform(lines, lambda l, i:
           CASE WHEN i = 1 OR i - 1 = len(lines) // 2
                THEN '@@ -' || (i - 1) || ',3 +' || (i - 1) || ',3 @@ block' || chr(10)
                ELSE '' END || [' ', '-', '+'][(i - 1) % 3 + 1] || l), chr(10)) AS patch
  FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents) d),
patch_lines AS (
  SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ix
  FROM (SELECT id, string_split(patch, chr(10)) AS ls FROM patches) p),
""" + f"""headers AS (
  SELECT id, coalesce(max(ix) FILTER (regexp_matches(line, '{HUNK_HEADER}')), 0) AS last,
         coalesce(min(ix) FILTER (regexp_matches(line, '{HUNK_HEADER}')), 0) AS first
  FROM patch_lines GROUP BY id)"""


def patch_code(marks: str, header: str = "first") -> str:
    chosen = ", ".join(f"'{m}'" for m in marks)
    return f"""nullif(coalesce(string_agg(substr(line, 2), chr(10) ORDER BY p.ix)
      FILTER (p.ix > h.{header} AND left(line, 1) IN ({chosen})), ''), '')"""


def mutated(code: str) -> str:
    def swap(x: str, number: str) -> str:
        cases = " ".join(
            f"WHEN {i} THEN replace({x}, {text(a)}, {text(b)})"
            for i, (a, b) in enumerate(REPLACEMENTS)
        )
        return f"CASE {number} {cases} END"

    def number(j: int) -> str:
        return f"({draw('id', 'variant', j, text('text'))} % {len(REPLACEMENTS)})"

    once = swap(code, number(1))
    rounds = f"({draw('id', 'variant', text('rounds'))} % 2)"
    return f"CASE WHEN {rounds} = 0 THEN {once} ELSE {swap(once, number(2))} END"


def gate() -> str:
    return chance(0.3, "id", text("gate"))


def whitespace(code: str) -> str:
    chosen = f"{gate()} AND {chance(0.2, 'id', text('whitespace'))} AND instr({code}, chr(10)) > 0"
    indent = f"CAST({draw('id', text('indent'), 'i - 1')} % 4 AS INTEGER) + 1"
    return f"""CASE WHEN {chosen} THEN array_to_string(list_transform(
      string_split({code}, chr(10)), lambda l, i:
      CASE WHEN {chance(0.1, 'id', text('line'), 'i - 1')} THEN repeat(' ', {indent}) || l ELSE l END
    ), chr(10)) ELSE {code} END"""


def comment(code: str) -> str:
    lines = f"string_split({code}, chr(10))"
    ix = f"CAST({draw('id', text('place'))} % (least(len({lines}), 3) + 1) AS INTEGER)"
    words = ", ".join(text(c) for c in COMMENTS)
    word = f"[{words}][CAST({draw('id', text('text'))} % {len(COMMENTS)} AS INTEGER) + 1]"
    chosen = f"{gate()} AND {chance(0.15, 'id', text('comment'))}"
    return f"""CASE WHEN {chosen} THEN array_to_string(list_concat(list_concat(
      {lines}[1:{ix}], [{word}]), {lines}[{ix} + 1:]), chr(10)) ELSE {code} END"""


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def vocabulary(relation: str, size: int | None = None) -> str:
    limit = "" if size is None else f"\n  QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {size}"
    return f"""vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tokens('code')}) AS token FROM {relation})
        GROUP BY token) t{limit})"""


def encoded(relation: str, extra: str = "") -> str:
    """CTE ``encoded``: ids and mask of each window of 510 tokens of each row of ``relation``."""
    return f"""cut AS (SELECT id{extra}, {tokens('code')} AS toks FROM {relation}),
windows AS (
  SELECT id{extra}, CAST(w AS INTEGER) AS "window" FROM (
    SELECT id{extra}, unnest(range(greatest(1, (len(toks) + 509) // 510))) AS w FROM cut) c),
places AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS ix FROM cut),
listed AS (
  SELECT p.id, CAST(p.ix // 510 AS INTEGER) AS "window", list(coalesce(v.token_id, 1) ORDER BY p.ix) AS ids
  FROM places p LEFT JOIN vocab v USING (token) GROUP BY p.id, p.ix // 510),
encoded AS (
  SELECT c.id{extra}, "window", CAST([2] || coalesce(l.ids, []) || [3] AS INTEGER[]) AS input_ids,
         CAST(list_transform([2] || coalesce(l.ids, []) || [3], lambda x: 1) AS INTEGER[])
           AS attention_mask
  FROM windows c LEFT JOIN listed l USING (id, "window"))"""


def place(code: str, before: str, target: str, after: str, use) -> str:
    """``code`` with ``use(target)`` for the first target between the two patterns."""
    pattern = f"'(?s)^(.*?{before})({target}){after}'"
    head, hit = (f"regexp_extract({code}, {pattern}, {k})" for k in (1, 2))
    rest = f"substr({code}, length({head}) + length({hit}) + 1)"
    return f"CASE WHEN {hit} = '' THEN {code} ELSE {head} || {use(hit)} || {rest} END"


def swapped(op: str) -> str:
    return f"CASE {op} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SWAPS) + " END"


def mutant(pattern: str, code: str, step: int) -> str:
    key = ("id", "variant", step, text(pattern))
    coin = f"{draw(*key, text('coin'))} % 2 = 0"

    def number(low: int, high: int) -> str:
        return f"CAST({draw(*key, text('number'))} % {high - low + 1} + {low} AS VARCHAR)"

    name, digits = "[A-Za-z_][A-Za-z0-9_]*", "[0-9]{1,9}"
    compared = "(?:==|!=|<=|>=|<|>)"
    line = "(?:^|\\n)[ \\t]*"
    if pattern == "off_by_one":
        shift = lambda n: f"CAST(CASE WHEN {coin} THEN CAST({n} AS BIGINT) + 1 ELSE greatest(CAST({n} AS BIGINT) - 1, 0) END AS VARCHAR)"
        return place(code, "(?:\\brange\\(|\\[)", digits, "[,)\\]]", shift)
    if pattern == "missing_null_check":
        return place(code, f"{line}if {name}(?:[.]{name})* ", "is None", ":", lambda _: "'is None or True'")
    if pattern == "wrong_variable":
        every = f"regexp_extract_all({code}, '{line}({name}) = ', 1)"
        names = f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"
        old, new = (f"{names}[{draw(*key, text(w))} % len({names}) + 1]" for w in ("old", "new"))
        return f"CASE WHEN len({names}) < 2 THEN {code} ELSE regexp_replace({code}, '\\b' || {old} || '\\b', {new}, 'g') END"
    if pattern == "wrong_operator":
        return place(code, " ", f"[+]|-|[*]|/|{compared}", " ", swapped)
    if pattern == "missing_return":
        changed = lambda _: f"CASE WHEN {coin} THEN 'pass' ELSE 'return ' || {number(-100, 100)} END"
        return place(code, "(?:^|\\n)[ \\t]+", "return\\b[^\\n]*", "", changed)
    if pattern == "wrong_condition":
        return place(code, f"{line}(?:if|elif|while) [^\\n]*? ", compared, " ", swapped)
    if pattern == "array_bounds":
        return place(code, "[A-Za-z0-9_)\\]]\\[", digits, "\\]", lambda _: f"CASE WHEN {coin} THEN {number(-10, -1)} ELSE {number(100, 1000)} END")
    if pattern == "type_error":
        return place(code, " (?:[+]|-|[*]|/) ", f"\\b{digits}\\b", "", lambda n: f"""'"error_' || {n} || '"'""")
    if pattern == "logic_error":
        return place(code, f"(?:^|\\n)[ \\t]*{name} = ", digits, "(?:\\n|$)", lambda _: number(-100, 100))
    return place(code, line, f"{name} = [^\\n]*", "", lambda _: "'pass'")


PATTERNS = [
    "off_by_one", "missing_null_check", "wrong_variable", "wrong_operator", "missing_return", "wrong_condition",
    "array_bounds", "type_error", "logic_error", "missing_initialisation",
]


def mutation_step(step: int) -> str:
    code = f"code{step - 1}"
    number = f"{draw('id', 'variant', step, text('pattern'))} % 10"
    cases = " ".join(f"WHEN {i} THEN {mutant(p, code, step)}" for i, p in enumerate(PATTERNS))
    return f"step{step} AS (SELECT *, CASE WHEN k < {step} THEN {code} ELSE CASE {number} {cases} END END AS code{step} FROM step{step - 1})"


PYTHON_CODE = """python_code AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS source, p_brand AS project, 'part/' || p_partkey AS path,
    'price_' || p_partkey AS func_name,
    array_to_string(['def price_' || p_partkey || '(table, qty):', '    limit = ' || p_size, '    total = 0',
      '    if qty is None:', '        return ' || p_size, '    for i in range(' || p_size || '):',
      '        total = total + qty * 2', '    if total == limit:', '        total = table[' || p_size % 7 || ']',
      '    if total < ' || CAST(floor(p_retailprice) AS INTEGER) || ':', '        return -1',
      '    return total / limit', ''], chr(10)) AS code,
    0 AS is_buggy, CAST(p_partkey AS VARCHAR) AS pair_id
  FROM part)"""

MUTATED = f"""{SAMPLES}, {PYTHON_CODE},
code_rows AS (
  SELECT * REPLACE ({code_like('code')} AS code) FROM samples UNION ALL BY NAME SELECT * FROM python_code),
step0 AS (
  SELECT *, code AS code0, {draw('id', 'variant', text('steps'))} % 3 + 1 AS k
  FROM (SELECT *, unnest([0, 1, 2]) AS variant FROM code_rows WHERE is_buggy = 0)),
{mutation_step(1)},
{mutation_step(2)},
{mutation_step(3)},
mutants AS (SELECT *, CASE WHEN code3 <> code0 THEN code3 END AS mutant FROM step3)"""

SOURCE_TREES = """s AS (SELECT s_suppkey AS k, 'nation' || s_nationkey AS nation, CAST(floor(s_acctbal) AS INTEGER) AS b FROM supplier),
sides AS (SELECT *, 'buggy' AS side, ' - ' AS op, 2 AS c, 'python_programs' AS folder, 1 AS is_buggy FROM s WHERE b > 0
  UNION ALL SELECT *, 'fixed', ' + ', 3, 'correct_python_programs', 0 FROM s WHERE b > 0),
from_tree AS (
  SELECT nation || '_' || k || '_' || side AS id, nation AS project, 'tests/t' || k || '.py' AS path, 'module' AS func_name,
    'a = 1' || chr(10) || 'b = ' || c || chr(10) || 'def f' || k || '(x):' || chr(10) || '    return x' || op || b AS code,
    is_buggy, nation || '_' || k AS pair_id FROM sides)"""

JOB_ROWS = f"""{SOURCE_TREES},
samples AS (
  SELECT id, 'bug_tree' AS source, project, path, code, is_buggy, pair_id FROM from_tree
  UNION ALL
  SELECT 'code_dirs_prog_' || k || '_' || side, 'code_dirs', 'code_dirs', folder || '/prog_' || k || '.py',
    'def prog_' || k || '(x):' || chr(10) || '    return x' || op || b || chr(10), is_buggy, 'code_dirs_prog_' || k FROM sides),
{project_split("source = 'bug_tree'", "project", 0.7, 0.15)},
job_rows AS (
  SELECT s.*, CASE WHEN s.source = 'code_dirs' THEN 'eval' ELSE p.split END AS split
  FROM samples s LEFT JOIN project_split p USING (project))"""

VARIANTS = SAMPLES + """, variants AS (
  SELECT s.*, v.variant FROM samples s
  CROSS JOIN (SELECT unnest([0, 1, 2]) AS variant) v WHERE s.is_buggy = 0)"""


def scope_rows() -> str:
    return """scoped AS (
  SELECT *, 'test' AS section, '' AS name FROM preds WHERE split = 'test'
  UNION ALL SELECT *, 'project', project FROM preds WHERE split = 'test'
  UNION ALL SELECT *, 'held_out', '' FROM preds WHERE split = 'eval')"""


RULE_1, RULE_2 = "repeat('=', 80)", "repeat('-', 80)"
TABLE_LINE = "%-15s %-10s %-8s %-8s %-8s %-10s %-10s"
HEAD_LINE = TABLE_LINE % ("Split", "Samples", "Buggy", "Clean", "Ratio", "Projects", "Avg Len")

STAT_LINES = f"""SELECT CAST(line_no AS INTEGER) AS line_no, value FROM (
  SELECT unnest(lines) AS value, generate_subscripts(lines, 1) - 1 AS line_no FROM (
    SELECT list_concat(list_concat(
      [{RULE_1}, 'DATASET STATISTICS', {RULE_1}, '{HEAD_LINE}', {RULE_2}],
      list(printf('{TABLE_LINE}', split, samples::VARCHAR, buggy::VARCHAR, clean::VARCHAR,
             printf('%.3f', buggy_ratio), CASE WHEN split = 'eval' THEN '1' ELSE projects::VARCHAR END,
             printf('%.0f', avg_length))
           ORDER BY list_position(['train', 'val', 'test', 'eval'], split))),
      [{RULE_2}, {RULE_1}, 'SUMMARY', {RULE_1},
       'Total training samples (train + val + test): ' || format('{{:,}}', CAST(sum(samples) FILTER (split <> 'eval') AS BIGINT)),
       'Total buggy samples: ' || sum(buggy) FILTER (split <> 'eval'),
       'Total clean samples: ' || sum(clean) FILTER (split <> 'eval'),
       'Overall buggy ratio: ' || printf('%.1f', (sum(buggy) FILTER (split <> 'eval') * 100)::DOUBLE / sum(samples) FILTER (split <> 'eval')) || '%',
       'Evaluation set: ' || sum(samples) FILTER (split = 'eval') || ' samples',
       '  Buggy: ' || sum(buggy) FILTER (split = 'eval') || ', Clean: ' || sum(clean) FILTER (split = 'eval')]) AS lines
    FROM stats) l) u"""

WIDE = (
    STATS
    + """, lengths AS (
  SELECT split, median(length(code)) AS median_length, CAST(min(length(code)) AS INTEGER) AS min_length,
         CAST(max(length(code)) AS INTEGER) AS max_length
  FROM split_samples GROUP BY split),
wide AS (SELECT * FROM stats JOIN lengths USING (split))"""
)

DETAIL_LINES = f"""SELECT CAST(line_no AS INTEGER) AS line_no, value FROM (
  SELECT unnest(lines) AS value, generate_subscripts(lines, 1) - 1 AS line_no FROM (
    SELECT list_concat([{RULE_1}, 'DETAILED STATISTICS', {RULE_1}], flatten(list(
      ['', upper(split) || ' SPLIT:', '  Total samples: ' || format('{{:,}}', samples),
       '  Buggy samples: ' || format('{{:,}}', buggy) || printf(' (%.1f', buggy_ratio * 100) || '%)',
       '  Clean samples: ' || format('{{:,}}', clean) || printf(' (%.1f', (1 - buggy_ratio) * 100) || '%)',
       '  Projects: ' || projects, '  Code length statistics:',
       printf('    Average: %.0f characters', avg_length), printf('    Median: %.0f characters', median_length),
       '    Min: ' || min_length || ' characters', '    Max: ' || max_length || ' characters']
      ORDER BY list_position(['train', 'val', 'test', 'eval'], split)))) AS lines
    FROM wide) l) u"""

BAND_LINES = f"""SELECT CAST(line_no AS INTEGER) AS line_no, value FROM (
  SELECT unnest(lines) AS value, generate_subscripts(lines, 1) - 1 AS line_no FROM (
    SELECT list_concat(list_concat(
      list_concat([{RULE_1}, 'CODE LENGTH ANALYSIS', {RULE_1}], flatten(list(
        ['', upper(split) || ':', printf('  Average length: %.0f characters', avg_length), printf('  Median length: %.0f characters', median_length),
         '  Range: ' || min_length || ' - ' || max_length || ' characters', '  Length distribution:',
         CASE WHEN avg_length < 500 THEN '    Short code (< 500 chars): Likely function-level snippets'
              WHEN avg_length < 1000 THEN '    Medium code (500-1000 chars): Function or small module'
              ELSE '    Long code (> 1000 chars): Module or file-level code' END]
        ORDER BY list_position(['train', 'val', 'test', 'eval'], split)))),
      ['', {RULE_1}, 'CLASS BALANCE ANALYSIS', {RULE_1}]), flatten(list(
        ['', upper(split) || ':', printf('  Buggy ratio: %.1f', buggy_ratio * 100) || '%',
         CASE WHEN buggy_ratio BETWEEN 0.45::DOUBLE AND 0.55::DOUBLE THEN '  Status: Well balanced'
              WHEN buggy_ratio BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN '  Status: Moderately balanced'
              WHEN buggy_ratio BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE THEN '  Status: Somewhat imbalanced'
              ELSE '  Status: Highly imbalanced (consider class weights)' END]
        ORDER BY list_position(['train', 'val', 'test', 'eval'], split)))) AS lines
    FROM wide) l) u"""

FIGURES = "'{\"samples\":' || samples" + "".join(
    f" || ',\"{c}\":' || round({c}, 6)" for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "avg_confidence")
) + """ || ',"buggy_samples":' || buggy_samples || ',"clean_samples":' || clean_samples || '}'"""

PODIUM = "ORDER BY bugs DESC, name DESC LIMIT 3"
PAGE_NAMES = "'Name | Bugs Data | Verified Bugs Data', '--- | --- | --- '"
PAGE = f"""SELECT CAST(line_no AS INTEGER) AS line_no, value FROM (
  SELECT unnest(lines) AS value, generate_subscripts(lines, 1) - 1 AS line_no FROM (
    SELECT ['# Bugs by contributor', '##  Top 3 Contributors (of all time)', {PAGE_NAMES}]
      || (SELECT list(name || ' | ' || bugs || ' | ' || verified ORDER BY bugs DESC, name DESC)
          FROM (SELECT * FROM a {PODIUM}))
      || ['##  Top 3 Contributors (last week)', {PAGE_NAMES}]
      || (SELECT list(name || ' | ' || bugs || ' | ' || verified ORDER BY bugs DESC, name DESC)
          FROM (SELECT * FROM w {PODIUM}))
      || ['#### Total data : ' || (SELECT count(*) FROM owners),
          '#### Total verified bugs data : ' || (SELECT count(*) FROM checked)] AS lines) l) u"""

PROGRAMS = "['bitcount', 'detect_cycle', 'gcd', 'kth', 'shortest_paths', 'sieve', 'topological_ordering']"
BATCHED = """batched AS (
  SELECT doc_id AS id, lang || '/' || (n_chars // 1000) AS batch_id FROM documents)"""

COUNTED = f"""{SPLIT_SAMPLES}, hashed AS (
  SELECT DISTINCT id, split, is_buggy, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 16384 AS bucket
  FROM (SELECT id, split, is_buggy, unnest({tokens('code')}) AS token FROM split_samples)),
texts AS (
  SELECT count(*) FILTER (is_buggy = 0) AS clean, count(*) FILTER (is_buggy = 1) AS buggy FROM split_samples WHERE split = 'train'),
seen AS (
  SELECT bucket, count(*) FILTER (is_buggy = 0) AS n_clean, count(*) FILTER (is_buggy = 1) AS n_buggy
  FROM hashed WHERE split = 'train' GROUP BY bucket),
fitted AS (
  SELECT CAST(b AS INTEGER) AS bucket, coalesce(n_clean, 0) AS n_clean, coalesce(n_buggy, 0) AS n_buggy,
         CASE WHEN n_clean IS NULL THEN 0 ELSE CAST(round(1048576 * (ln((n_buggy + 1)::DOUBLE / (buggy + 2))
           - ln((n_clean + 1)::DOUBLE / (clean + 2)))) AS BIGINT) END AS weight
  FROM (SELECT unnest(range(16384)) AS b) LEFT JOIN seen ON b = bucket, texts),
margins AS (
  SELECT s.id, s.project, s.is_buggy, s.split, coalesce(sum(f.weight), 0)::DOUBLE / 1048576 AS margin
  FROM split_samples s LEFT JOIN hashed h ON s.id = h.id LEFT JOIN fitted f ON h.bucket = f.bucket
  WHERE s.split IN ('test', 'eval') GROUP BY ALL),
preds AS (
  SELECT id, project, is_buggy, split, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS yhat,
         1 / (1 + exp(-abs(margin))) AS score
  FROM margins)"""

ORACLE: dict[str, str] = {
    "load_samples": f"WITH {SAMPLES} SELECT * FROM samples",
    "roundtrip_parquet": "SELECT doc_id AS id, source AS project, md5(text) AS code_md5 FROM documents",
    "split_sink_roundtrip": f"""WITH {SPLIT_SAMPLES}
SELECT split, id, project FROM split_samples""",
    "scan_code_dirs": """WITH s AS (SELECT s_suppkey AS k, CAST(floor(s_acctbal) AS INTEGER) AS b FROM supplier),
sides AS (SELECT k, b, 'buggy' AS side, 'python_programs' AS folder, ' - ' AS op, 1 AS is_buggy FROM s WHERE b > 0
  UNION ALL SELECT k, b, 'fixed', 'correct_python_programs', ' + ', 0 FROM s WHERE b > 0)
SELECT 'programs_prog_' || k || '_' || side AS id, 'programs' AS source, 'programs' AS project,
  folder || '/prog_' || k || '.py' AS path, 'prog_' || k AS func_name,
  'def prog_' || k || '(x):' || chr(10) || '    return x' || op || b || chr(10) AS code, is_buggy,
  'programs_prog_' || k AS pair_id FROM sides""",
    "scan_bug_tree": f"""WITH {SOURCE_TREES}
SELECT id, 'tree' AS source, project, path, func_name, code, is_buggy, pair_id FROM from_tree""",
    "prepare_job": f"WITH {JOB_ROWS} SELECT * FROM job_rows",
    "prepare_job_stats": f"""WITH {JOB_ROWS}
SELECT n.split, count(r.id) AS samples, count(*) FILTER (is_buggy = 1) AS buggy, count(*) FILTER (is_buggy = 0) AS clean
FROM (SELECT unnest(['train', 'val', 'test', 'eval']) AS split) n LEFT JOIN job_rows r USING (split) GROUP BY n.split""",
    "training_job": f"""WITH {SPLIT_SAMPLES}, {scope_rows().replace('preds', 'split_samples')}
SELECT section, name, count(*) AS samples, count(*) FILTER (is_buggy = 1) AS buggy_samples, count(*) FILTER (is_buggy = 0) AS clean_samples
FROM scoped GROUP BY section, name""",
    "saved_model_scores": f"""WITH {SPLIT_SAMPLES}
SELECT id, true AS same FROM split_samples WHERE split IN ('test', 'eval')""",
    "batch_replies": f"""WITH {BATCHED}, judged AS (
  SELECT id, batch_id, text, row_number() OVER (PARTITION BY batch_id ORDER BY id) - 1 AS slot,
    CASE WHEN count(*) OVER (PARTITION BY batch_id) > 100 THEN 'batch too large' WHEN length(text) < 1 THEN 'empty'
      WHEN length(text) > 10000 THEN 'too long' WHEN {strip('text')} = '' THEN 'blank' END AS reason
  FROM batched JOIN documents ON doc_id = id)
SELECT batch_id, slot, id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, reason,
  reason IS NULL AS scored FROM judged""",
    "stats_json": f"""WITH {STATS}
SELECT '{{' || string_agg('"' || split || '":{{"samples":' || samples || ',"buggy":' || buggy || ',"clean":' || clean
  || CASE WHEN split = 'eval' THEN '' ELSE ',"projects":' || projects END
  || ',"avg_length":' || round(avg_length, 6) || '}}', ',' ORDER BY split) || '}}' AS value FROM stats""",
    "stats_from_json": f"""WITH {STATS}
SELECT split, samples, buggy, clean, CASE WHEN split = 'eval' THEN NULL ELSE projects END AS projects,
  round(avg_length, 6) AS avg_length FROM stats""",
    "stats_report_lines": f"WITH {STATS} {STAT_LINES}",
    "stats_detail_lines": f"WITH {WIDE} {DETAIL_LINES}",
    "stats_band_lines": f"WITH {WIDE} {BAND_LINES}",
    "testcases_normalised": """SELECT p_partkey AS id,
  CASE p_size % 3 WHEN 0 THEN '[' || p_size || ']' WHEN 1 THEN '[' || p_size || ',"' || p_name || '"]'
       ELSE '["' || p_name || '"]' END AS input,
  CASE p_size % 3 WHEN 0 THEN '' || p_partkey WHEN 1 THEN '[' || p_partkey || ']' ELSE 'true' END AS expected
FROM part""",
    "verified_ids": f"WITH {VERIFIED} SELECT * FROM verified",
    "model_card": f"""WITH {OVERALL}
SELECT '{{"classes": 2, "created_at": "2024-01-31T00:00:00", "features": 16384, "model_name": "defectloom classifier", "task": "sequence-classification", "training_config": {{"max_length": 512, "seed": 42}}, "metrics": '
  || '{{"samples":' || samples || ',"accuracy":' || round(accuracy, 6) || ',"precision_macro":' || round(precision_macro, 6)
  || ',"recall_macro":' || round(recall_macro, 6) || ',"f1_macro":' || round(f1_macro, 6)
  || ',"avg_confidence":' || round(avg_confidence, 6) || ',"buggy_samples":' || buggy_samples
  || ',"clean_samples":' || clean_samples || '}}}}' AS value
FROM base JOIN macro USING (g)""",
    "parse_kv": f"""WITH blocks AS (
  SELECT p_partkey AS id, 'name="' || p_name || '"' || chr(10) || ' brand = "' || p_brand || '" ' || chr(10) || 'size=' || p_size
    || chr(10) || 'no separator' || chr(10) || 'type="a=' || p_type || '"' || chr(10) || 'size="' || (p_size + 1) || '"' AS t
  FROM part),
lines AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ix FROM blocks),
entries AS (
  SELECT id, ix, {strip("split_part(line, '=', 1)")} AS k, regexp_replace({strip("substr(line, instr(line, '=') + 1)")}, '\\A"+|"+\\z', '', 'g') AS v
  FROM lines WHERE contains(line, '='))
SELECT id, k, v FROM entries QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY ix DESC) = 1""",
    "patch_last_hunk": f"""WITH {PATCHES}
SELECT p.id, {patch_code('+- ', 'last')} AS code FROM patch_lines p JOIN headers h USING (id) GROUP BY p.id""",
    "patch_all_hunks": f"""WITH {PATCHES}
SELECT p.id, {patch_code('+- ')} AS code FROM patch_lines p JOIN headers h USING (id) GROUP BY p.id""",
    "patch_sides": f"""WITH {PATCHES}
SELECT p.id, {patch_code('- ')} AS buggy, {patch_code('+ ')} AS fixed
FROM patch_lines p JOIN headers h USING (id) GROUP BY p.id""",
    "function_window": f"""WITH docs AS (
  SELECT doc_id AS id, n_chars % 40 AS n, string_split({code_like('text')}, chr(10)) AS ls FROM documents),
lines AS (SELECT id, n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ix FROM docs),
marks AS (
  SELECT id, max(ix) FILTER (ix <= n) AS above, min(ix) FILTER (ix >= n) AS below
  FROM lines WHERE regexp_matches(line, '{BLOCK_START}') GROUP BY id)
SELECT d.id, coalesce(array_to_string(d.ls[coalesce(m.above, greatest(0, d.n - 3)) + 1 : coalesce(m.below, least(len(d.ls), d.n + 3))], chr(10)), '') AS code
FROM docs d LEFT JOIN marks m USING (id)""",
    "function_name": f"SELECT doc_id AS id, {function_name(code_like('text'))} AS name FROM documents",
    "truncate_lines": f"SELECT doc_id AS id, {truncated('text')} AS code FROM documents",
    "preview": """SELECT pos // 100 AS batch, CAST(pos % 100 AS INTEGER) AS slot, id,
  CASE WHEN length(code) > 100 THEN substr(code, 1, 100) || '...' ELSE code END AS preview
FROM (SELECT doc_id AS id, text AS code, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) d""",
    "pair_rows": f"""WITH {USABLE}
SELECT 'talk_' || stem || '_buggy' AS id, 'talk' AS source, 'talk' AS project, buggy_path AS path,
  {function_name('buggy_code')} AS func_name, buggy_code AS code, 1 AS is_buggy, 'talk_' || stem AS pair_id FROM usable
UNION ALL
SELECT 'talk_' || stem || '_fixed', 'talk', 'talk', fixed_path, {function_name('fixed_code')}, fixed_code, 0, 'talk_' || stem FROM usable""",
    "drop_identical_pairs": f"""WITH {USABLE}
SELECT stem, buggy_path, fixed_path, CAST(length(buggy_code) AS INTEGER) AS buggy_length FROM usable""",
    "unpaired": f"""WITH {TURNS.rstrip().rstrip(',')}
SELECT stem, path FROM defects WHERE stem NOT IN (SELECT stem FROM fixes)""",
    "clean_only": f"WITH {SAMPLES} SELECT id, source, project, pair_id FROM samples WHERE is_buggy = 0",
    "request_rules": f"""SELECT doc_id AS id, CASE WHEN length(text) < 1 THEN 'empty' WHEN length(text) > 10000 THEN 'too long'
  WHEN {strip('text')} = '' THEN 'blank' END AS reason FROM documents""",
    "train_counts": f"WITH {COUNTED} SELECT bucket, n_clean, n_buggy, weight FROM fitted",
    "score_counts": f"""WITH {COUNTED}
SELECT id, yhat, round(score, 6) AS score, CASE WHEN yhat = 1 THEN 'buggy' ELSE 'clean' END AS label FROM preds""",
    "evaluate_counts": f"""WITH {COUNTED}, {scope_rows()}, {metrics('scoped', 'section, name')}
SELECT section, name, {METRIC_SELECT} FROM base JOIN macro USING (section, name)""",
    "stream_batches": f"""WITH {BATCHED}, judged AS (
  SELECT id, batch_id, CASE WHEN count(*) OVER (PARTITION BY batch_id) > 100 THEN 'batch too large' WHEN length(text) < 1 THEN 'empty'
    WHEN length(text) > 10000 THEN 'too long' WHEN {strip('text')} = '' THEN 'blank' END AS reason
  FROM batched JOIN documents ON id = doc_id)
SELECT id, batch_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM judged""",
    "stream_verdicts": f"""SELECT id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, reason IS NULL AS labelled
FROM (SELECT doc_id AS id, CASE WHEN length(text) < 1 THEN 'empty' WHEN length(text) > 10000 THEN 'too long'
  WHEN {strip('text')} = '' THEN 'blank' END AS reason FROM documents) d""",
    "batch_verdicts": f"""WITH {BATCHED}
SELECT id, batch_id, CASE WHEN count(*) OVER (PARTITION BY batch_id) > 100 THEN 'batch too large' END AS reason FROM batched""",
    "batch_size_rule": f"""WITH {BATCHED}
SELECT batch_id, count(*) AS n, count(*) BETWEEN 1 AND 100 AS accepted FROM batched GROUP BY batch_id""",
    "accepted_batches": f"""WITH {BATCHED}
SELECT id, batch_id FROM batched QUALIFY count(*) OVER (PARTITION BY batch_id) <= 100""",
    "graph_programs": f"""SELECT p_partkey AS id, {PROGRAMS}[p_size % 7 + 1] AS program,
  {PROGRAMS}[p_size % 7 + 1] IN ({', '.join(text(p) for p in GRAPH_PROGRAMS)}) AS is_graph FROM part""",
    "project_split_sorted": f"""WITH {SAMPLES}, {project_split('true', 'project', 0.7, 0.15)}
SELECT s.id, project, p.split FROM samples s JOIN project_split p USING (project)""",
    "project_split_seeded": f"""WITH {SAMPLES}, {project_split('true', f"md5(project || '|{SEED}'), project", 0.7, 0.1)}
SELECT s.id, project, p.split FROM samples s JOIN project_split p USING (project)""",
    "ratio_check": """SELECT s_suppkey AS id, (s_suppkey % 3 + 6) + (s_nationkey % 3 + 1) + 2 = 10 AS ok FROM supplier""",
    "split_stats": f"""WITH {STATS}
SELECT split, samples, buggy, clean, projects, round(avg_length, 6) AS avg_length, round(buggy_ratio, 6) AS buggy_ratio FROM stats""",
    "length_profile": """SELECT lang AS split, count(*) AS samples, round(avg(length(text)), 6) AS avg_length,
  round(median(length(text)), 6) AS median_length, CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length,
  round(count(*) FILTER (n_chars % 2 = 1)::DOUBLE / count(*), 6) AS buggy_ratio FROM documents GROUP BY lang""",
    "wide_stats": f"""WITH {WIDE}
SELECT split, samples, buggy, clean, projects, round(avg_length, 6) AS avg_length, round(buggy_ratio, 6) AS buggy_ratio,
  round(median_length, 6) AS median_length, min_length, max_length FROM wide""",
    "length_bands": f"""WITH {STATS}
SELECT split, CASE WHEN avg_length <= 0 THEN NULL WHEN avg_length < 500 THEN 'short' WHEN avg_length < 1000 THEN 'medium' ELSE 'long' END AS band FROM stats""",
    "balance_bands": f"""WITH {STATS}
SELECT split, CASE WHEN buggy_ratio BETWEEN 0.45::DOUBLE AND 0.55::DOUBLE THEN 'well balanced' WHEN buggy_ratio BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN 'moderately balanced'
  WHEN buggy_ratio BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE THEN 'somewhat imbalanced' ELSE 'highly imbalanced' END AS band FROM stats""",
    "overall_totals": f"""WITH {STATS}
SELECT CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(buggy) AS BIGINT) AS buggy, CAST(sum(clean) AS BIGINT) AS clean,
  round(sum(buggy)::DOUBLE / sum(samples), 6) AS buggy_ratio FROM stats WHERE split <> 'eval'""",
    "extraction_summary": f"""WITH {SAMPLES}
SELECT count(*) AS samples, count(*) FILTER (is_buggy = 1) AS buggy, count(*) FILTER (is_buggy = 0) AS clean,
  count(DISTINCT project) AS projects, count(DISTINCT path) FILTER (is_buggy = 1) AS defect_files, count(*) // 2 AS pairs FROM samples""",
    "project_counts": f"WITH {SAMPLES} SELECT project, count(*) AS samples FROM samples GROUP BY project",
    "attach_predictions": f"WITH {PREDS} SELECT id, source, project, is_buggy, yhat, round(score, 6) AS score FROM preds",
    "confusion": f"""WITH {PREDS}
SELECT is_buggy, yhat, count(*) AS n, round(sum(score), 6) AS score_sum, count(score) AS score_n FROM preds GROUP BY is_buggy, yhat""",
    "overall_metrics": f"WITH {OVERALL} SELECT {METRIC_SELECT} FROM base JOIN macro USING (g)",
    "per_class_metrics": f"""WITH {OVERALL}
SELECT {', '.join(f"round(coalesce(max({c}) FILTER (label = {k}), 0), 6) AS {c}_{name}" for k, name in ((0, 'clean'), (1, 'buggy')) for c in ('precision', 'recall', 'f1'))} FROM m""",
    "per_project_metrics": f"""WITH {PREDS}, {metrics('preds', 'project')}
SELECT project, {METRIC_SELECT} FROM base JOIN macro USING (project)""",
    "heldout_metrics": f"""WITH {PREDS}, scoped AS (SELECT *, split AS scope FROM preds UNION ALL SELECT *, 'all' FROM preds), {metrics('scoped', 'scope')}
SELECT scope, {METRIC_SELECT} FROM base JOIN macro USING (scope)""",
    "project_ranking": f"""WITH {PREDS}, {metrics('preds', 'project')}
SELECT row_number() OVER (ORDER BY round(f1_macro, 6) DESC, project) AS place, project, round(f1_macro, 6) AS f1_macro, samples
FROM base JOIN macro USING (project)""",
    "class_weights": f"""WITH {SAMPLES}, c AS (SELECT is_buggy AS label, count(*) AS n FROM samples GROUP BY 1)
SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS weight FROM c""",
    "evaluation_report": f"""WITH {PREDS}, {scope_rows()}, {metrics('scoped', 'section, name')}
SELECT section, name, {METRIC_SELECT} FROM base JOIN macro USING (section, name)""",
    "evaluation_document": f"""WITH {PREDS}, {scope_rows()}, {metrics('scoped', 'section, name')},
said AS (SELECT section, name, {FIGURES} AS figures FROM base JOIN macro USING (section, name))
SELECT '{{"test":' || max(figures) FILTER (section = 'test') || ',"held_out":' || max(figures) FILTER (section = 'held_out')
  || ',"projects":{{' || string_agg('"' || name || '":' || figures, ',' ORDER BY name) FILTER (section = 'project') || '}}}}' AS value FROM said""",
    **{
        name: f"""WITH {LOGITS}, {probabilities(shift)}
SELECT id, round(p0, 6) AS p_clean, round(p1, 6) AS p_buggy, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS yhat,
  round(greatest(p0, p1), 6) AS score, CASE WHEN p1 > p0 THEN 'buggy' ELSE 'clean' END AS label FROM scored"""
        for name, shift in (("score_logits", "z1"), ("score_logits_biased", "z1 + ln(2.0::DOUBLE)"))
    },
    "best_step": f"""WITH {HISTORY}
SELECT run_id, step, round(f1, 6) AS f1 FROM history QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, step) = 1""",
    "early_stop": f"""WITH RECURSIVE {HISTORY},
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS pos FROM history),
walk AS (
  SELECT run_id, pos, f1 AS best, 0 AS wait, CAST(NULL AS BIGINT) AS stopped FROM placed WHERE pos = 1
  UNION ALL
  SELECT w.run_id, p.pos, CASE WHEN p.f1 > w.best + 0.001::DOUBLE THEN p.f1 ELSE w.best END,
         CASE WHEN p.f1 > w.best + 0.001::DOUBLE THEN 0 ELSE w.wait + 1 END,
         CASE WHEN p.f1 <= w.best + 0.001::DOUBLE AND w.wait + 1 >= 3 THEN p.step END
  FROM walk w JOIN placed p ON p.run_id = w.run_id AND p.pos = w.pos + 1 WHERE w.stopped IS NULL)
SELECT run_id, stopped AS stop_step, round(best, 6) AS best_f1 FROM walk
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) = 1""",
    "top_author": f"WITH {TOPS} SELECT project, bug, file, author, week_author FROM tops",
    "owner_fallback": f"""WITH {BOARD}
SELECT o.project, o.bug, o.owner, o.week_owner, c.owner AS checked_owner, c.week_owner AS checked_week_owner
FROM owners o JOIN check_owners c USING (project, bug)""",
    "contributors": f"WITH {BOARD}, {contributors('a', 'owner')} SELECT * FROM a",
    "leaderboard_all": f"WITH {BOARD}, {contributors('a', 'owner')} SELECT * FROM a {PODIUM}",
    "leaderboard_week": f"WITH {BOARD}, {contributors('w', 'week_owner')} SELECT * FROM w {PODIUM}",
    "leaderboard_totals": f"WITH {BOARD} SELECT (SELECT count(*) FROM owners) AS bugs, (SELECT count(*) FROM checked) AS verified",
    "leaderboard_page": f"WITH {BOARD}, {contributors('a', 'owner')}, {contributors('w', 'week_owner')} {PAGE}",
    "validate_schema": f"WITH {SAMPLES} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS expected, CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' END AS actual,
  CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' END = '{t}' AS ok, count(*) FILTER ({c} IS NULL) AS nulls FROM samples"""
        for c, t in (
            ("id", "string"), ("source", "string"), ("project", "string"), ("path", "string"),
            ("func_name", "string"), ("code", "string"), ("is_buggy", "int"), ("pair_id", "string"),
        )
    ),
    "validate_domains": f"""WITH {SAMPLES}
SELECT id, 'source' AS "column", source AS value FROM samples WHERE source NOT IN ('en', 'fr', 'de')
UNION ALL SELECT id, 'is_buggy', CAST(is_buggy AS VARCHAR) FROM samples WHERE is_buggy NOT IN (0, 1)""",
    "validate_length": """SELECT count(*) AS samples, count(*) FILTER (length(text) > 4000) AS too_long,
  CAST(max(length(text)) AS INTEGER) AS longest FROM documents""",
    "validate_predictions": f"""WITH {LOGITS}
SELECT id, round(z0, 6) AS score, CASE is_buggy WHEN 1 THEN 'buggy' ELSE 'clean' END AS label FROM logits WHERE z0 < 0 OR z0 > 1""",
    "validate_leakage": f"""WITH {SAMPLES}, {project_split('true', 'project', 0.7, 0.15)},
per AS (SELECT project, count(DISTINCT split) AS k FROM samples JOIN project_split USING (project) GROUP BY project)
SELECT count(*) AS projects, count(*) FILTER (k > 1) AS leaking FROM per""",
    "variant_rows": f"""WITH {VARIANTS}
SELECT id || '_bug_' || variant AS id, source || '_synthetic' AS source, project, path, 1 AS is_buggy,
  pair_id || '_synthetic_' || variant AS pair_id FROM variants""",
    "mutation_plan": f"""WITH {VARIANTS}
SELECT id, variant, list_transform(range(1, CAST({draw('id', 'variant', text('steps'))} % 3 AS INTEGER) + 2),
  lambda j: CAST({draw('id', 'variant', 'j', text('pattern'))} % 10 AS INTEGER)) AS patterns FROM variants""",
    "text_mutation": f"""WITH {CORPUS}, v AS (SELECT id, code, unnest([0, 1, 2]) AS variant FROM corpus)
SELECT id, variant, md5({mutated('code')}) AS code_md5 FROM v""",
    "pattern_mutation": f"WITH {MUTATED} SELECT id, variant, md5(mutant) AS code_md5 FROM mutants",
    "generate_variants": f"""WITH {MUTATED}
SELECT id || '_bug_' || variant AS id, source || '_synthetic' AS source, project, path, 1 AS is_buggy,
  pair_id || '_synthetic_' || variant AS pair_id, md5(coalesce(mutant, {mutated('code')})) AS code_md5 FROM mutants""",
    "single_patterns": f"WITH {PYTHON_CODE}, v AS (SELECT id, 0 AS variant, code FROM python_code) "
    + " UNION ALL ".join(f"SELECT id, '{p}' AS pattern, {mutant(p, 'code', 1)} AS mutant FROM v" for p in PATTERNS),
    "lexed_patterns": lexed_patterns(),
    "variant_summary": f"""WITH {SAMPLES}
SELECT count(*) AS clean_samples, count(*) * 3 AS variants, round(3.0::DOUBLE, 6) AS per_sample FROM samples WHERE is_buggy = 0""",
    "merge_summary": f"""WITH {VARIANTS}, merged AS (
  SELECT 'train' AS origin, is_buggy FROM samples UNION ALL SELECT 'synthetic', 1 FROM variants)
SELECT count(*) FILTER (origin = 'train') AS original, count(*) FILTER (origin = 'synthetic') AS synthetic, count(*) AS samples,
  count(*) FILTER (is_buggy = 1) AS buggy, count(*) FILTER (is_buggy = 0) AS clean,
  round(count(*) FILTER (is_buggy = 1) * 100::DOUBLE / count(*), 6) AS buggy_percent FROM merged""",
    "shuffled_merge": f"""WITH {SPLIT_SAMPLES}, train AS (SELECT * FROM split_samples WHERE split = 'train'),
v AS (SELECT *, unnest([0, 1, 2]) AS variant FROM train WHERE is_buggy = 0),
merged AS (
  SELECT id, pair_id, source, is_buggy, 'train' AS origin, md5(code) AS code_md5 FROM train
  UNION ALL
  SELECT id || '_bug_' || variant, pair_id || '_synthetic_' || variant, source || '_synthetic', 1, 'synthetic', md5({mutated('code')}) FROM v)
SELECT row_number() OVER (ORDER BY md5(id || '|{SEED}'), id) - 1 AS pos, * FROM merged""",
    "augment_whitespace": f"WITH {CORPUS} SELECT id, md5({whitespace('code')}) AS code_md5 FROM corpus",
    "augment_comment": f"WITH {CORPUS} SELECT id, md5({comment('code')}) AS code_md5 FROM corpus",
    "tokenise": f"SELECT doc_id AS id, {tokens('text')} AS tokens FROM documents",
    "token_stats": f"""WITH t AS (SELECT len({tokens('text')}) + 2 AS n FROM documents)
SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_tokens, count(*) FILTER (n > 512) AS over_limit,
  avg(n) > 0.8 * 512 AS near_limit FROM t""",
    "token_sample_report": f"""SELECT doc_id AS id, CAST(len({tokens('text')}) + 2 AS INTEGER) AS tokens, len({tokens('text')}) + 2 > 512 AS over_limit
FROM documents ORDER BY doc_id LIMIT 5""",
    "vocab_size": f"SELECT count(DISTINCT token) AS vocab_size FROM (SELECT unnest({tokens('text')}) AS token FROM documents)",
    "vocabulary": f"WITH {CORPUS}, {vocabulary('corpus')} SELECT * FROM vocab",
    "encode": f"WITH {CORPUS}, {vocabulary('corpus')}, {encoded('corpus')} SELECT * FROM encoded",
    "encode_small_vocabulary": f"WITH {CORPUS}, {vocabulary('corpus', 200)}, {encoded('corpus')} SELECT * FROM encoded",
    "decode": f"""SELECT doc_id AS id, array_to_string({tokens('text')}, ' ') AS text FROM documents""",
    "batches": """SELECT id, project, pos // 8 AS batch, CAST(pos % 8 AS INTEGER) AS slot
FROM (SELECT doc_id AS id, source AS project, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) d""",
    "pad_batches": f"""WITH {CORPUS}, {vocabulary('corpus')}, {encoded('corpus')},
placed AS (SELECT *, (row_number() OVER (ORDER BY id, "window") - 1) // 8 AS batch, CAST((row_number() OVER (ORDER BY id, "window") - 1) % 8 AS INTEGER) AS slot FROM encoded),
sized AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS longest FROM placed)
SELECT id, "window", list_resize(input_ids, longest, 0) AS input_ids, list_resize(attention_mask, longest, 0) AS attention_mask, batch, slot FROM sized""",
    "encoded_rows": f"""WITH {SPLIT_SAMPLES}, train AS (SELECT * FROM split_samples WHERE split = 'train'), {vocabulary('train')},
spaced AS (SELECT id, is_buggy AS labels, {whitespace('code')} AS code FROM train),
augmented AS (SELECT id, labels, {comment('code')} AS code FROM spaced), {encoded('augmented', ', labels')}
SELECT * FROM encoded""",
}
