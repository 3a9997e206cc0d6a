"""DuckDB SQL for the registered queries, written from the operators' definitions over the same tables.

Each statement is self-contained: the common table expressions below are plain text put together here.
"""

from __future__ import annotations

from veilspark.functions.paths import DEFAULT_IGNORES
from veilspark.functions.patterns import MARKER, VALUE_MARKER
from veilspark.plans.inputs import (
    BROKEN_TEXT,
    CODE_PATH,
    CODE_TEXT,
    REL,
    REPO,
    RULE_PATTERN,
    RULE_WORDS,
    RULES,
)
from veilspark.rules import BUILTIN_PACK, BUILTIN_RULES

DOCS = "docs AS (SELECT CAST(doc_id AS string) AS path, text, lang, source FROM documents)"
CODE = f"code AS (SELECT {CODE_PATH} AS path, {CODE_TEXT} AS text, replace(p_brand, '#', '') AS repo, p_size FROM part)"
BROKEN = f"broken AS (SELECT {CODE_PATH} AS path, {BROKEN_TEXT} AS text, p_size FROM part)"
REPO_FILES = f"repo_files AS (SELECT DISTINCT {REPO} AS repo, {REL} AS rel FROM orders)"
REPO_PATHS = REPO_FILES + ", repo_paths AS (SELECT concat(repo, '/', rel) AS path FROM repo_files)"

_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
LINES = (
    f"cut AS (SELECT path, string_split_regex(text, '{_BREAK}') AS parts FROM docs), "
    "whole AS (SELECT path, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM cut), "
    "lines AS (SELECT path, unnest(range(1, len(parts) + 1)) AS ln, unnest(parts) AS line FROM whole)"
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _preview(v: str) -> str:
    return (
        f"CASE WHEN length({v}) <= 8 THEN repeat('*', length({v})) "
        f"ELSE concat(left({v}, 4), repeat('*', length({v}) - 8), right({v}, 4)) END"
    )


def _found(r) -> str:
    values = f"regexp_extract_all(line, {_q(r.pattern)}, {r.group})"
    return values if r.unless is None else f"list_filter({values}, lambda v: NOT regexp_matches(v, {_q(r.unless)}))"


def _matches(rules, prefix: str, name: str) -> str:
    parts = [
        f"SELECT path, ln AS line, {_q(r.severity)} AS severity, {_q(prefix + '/' + r.id)} AS rule_id, {_q(r.id)} AS rule, "
        f"unnest({_found(r)}) AS value FROM lines"
        for r in rules
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


POLICY = _matches(RULES, "policy", "policy")
BUILTIN = (
    _matches(BUILTIN_RULES, BUILTIN_PACK, "built")
    + ", built_once AS (SELECT path, rule_id, severity, value, min(line) AS line FROM built GROUP BY ALL)"
)
_PUBLIC = "severity, path, line, rule_id, " + _preview("value") + " AS redacted_preview"
POLICY_FINDINGS = f"SELECT {_PUBLIC}, concat('Review the match against policy rule ''', rule, '''.') AS suggested_action FROM policy"
BUILTIN_FINDINGS = f"SELECT {_PUBLIC}, 'Rotate this credential and remove it from source.' AS suggested_action FROM built_once"
ENTROPY = (
    "cand AS (SELECT path, ln AS line, unnest(regexp_extract_all(line, '[A-Za-z0-9+/=_-]{20,}')) AS value FROM lines), "
    "ids AS (SELECT *, row_number() OVER () AS id FROM cand), chars AS (SELECT id, unnest(string_split(value, '')) AS ch FROM ids), "
    "ent AS (SELECT id, entropy(ch) AS e FROM chars GROUP BY id), "
    "scored AS (SELECT i.*, e, regexp_matches(value, '^[0-9A-Fa-f]+$') AS hex FROM ids i JOIN ent USING (id)), "
    "high AS (SELECT path, line, concat('builtin/high-entropy-', CASE WHEN hex THEN 'hex' ELSE 'base64' END) AS rule_id, value, e "
    "FROM scored WHERE e > CASE WHEN hex THEN 3.0 ELSE 4.5 END), "
    "high_once AS (SELECT 'high' AS severity, path, rule_id, value, min(line) AS line FROM high GROUP BY ALL)"
)
FOUND = (
    f"{LINES}, {POLICY}, {BUILTIN}, {ENTROPY}, found AS ({POLICY_FINDINGS} UNION ALL {BUILTIN_FINDINGS} "
    f"UNION ALL {BUILTIN_FINDINGS.replace('built_once', 'high_once')})"
)
SCAN = f"WITH {DOCS}, {FOUND}"
def _tree_digest(entry: str) -> str:
    parts = ", ".join(f"CAST(sum(CAST(concat('0x', substr(sha256({entry}), {1 + 15 * k}, 15)) AS BIGINT)::HUGEINT) AS VARCHAR)" for k in range(4))
    return f"sha256(concat_ws(',', {parts}))"


_DIR = "regexp_extract(P, '^(.*)/[^/]*$', 1)"
_LEVELS = [
    f"e{d} AS (SELECT {_DIR.replace('P', 'path')} AS dir, concat('file ', path, ' ', sha256(path)) AS entry, 1 AS files FROM repo_paths WHERE len(path) - len(replace(path, '/', '')) = {d}"
    + (f" UNION ALL SELECT {_DIR.replace('P', 'dir')}, concat('dir ', dir, ' ', digest), files FROM d{d + 1}" if d < 3 else "")
    + f"), d{d} AS (SELECT dir, CAST(sum(files) AS BIGINT) AS files, {_tree_digest('entry')} AS digest FROM e{d} GROUP BY dir)"
    for d in (3, 2, 1, 0)
]
TREE = f"WITH {REPO_PATHS}, {', '.join(_LEVELS)}"
WHOLE = (
    "docs AS (SELECT coalesce(source, 'none') AS path, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY ALL)"
)
SHARED = (
    "docs AS (SELECT concat('r', doc_id % 4, '/', 'f', doc_id // 4) AS path, text FROM documents)"
)
_REPO_AND_PATH = "split_part(path, '/', 1) AS repo, split_part(path, '/', 2) AS path"

_LANG = (
    "CASE WHEN regexp_matches(P, '[^/.][^/]*\\.py$') THEN 'python' "
    "WHEN regexp_matches(lower(P), '[^/.][^/]*\\.(js|mjs|cjs|jsx)$') THEN 'javascript' "
    "WHEN regexp_matches(lower(P), '[^/.][^/]*\\.ts$') THEN 'typescript' "
    "WHEN regexp_matches(lower(P), '[^/.][^/]*\\.tsx$') THEN 'tsx' END"
)


# --- tokens of the code files

_TOKEN = {
    "py": r'"""[^"]*"""|"[^"\n]*"|#[^\n]*|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|\s+|[\s\S]',
    "js": r"//[^\n]*|'[^'\n]*'|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|=>|\s+|[\s\S]",
}


def _tokens(source: str = "code") -> str:
    return (
        f"toks AS (SELECT path, CASE WHEN path LIKE '%.py' THEN regexp_extract_all(text, {_q(_TOKEN['py'])}) "
        f"ELSE regexp_extract_all(text, {_q(_TOKEN['js'])}) END AS t FROM {source}), "
        "tok AS (SELECT path, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM toks)"
    )


_OPEN, _CLOSE = "tok IN ('(', '[', '{')", "tok IN (')', ']', '}')"
NEST = (
    f"run AS (SELECT *, sum(CASE WHEN {_OPEN} THEN 1 WHEN {_CLOSE} THEN -1 ELSE 0 END) "
    "OVER (PARTITION BY path ORDER BY pos) AS r FROM tok), "
    f"lev AS (SELECT path, pos, tok, CAST(r + CASE WHEN {_CLOSE} THEN 1 ELSE 0 END AS BIGINT) AS depth FROM run), "
    f"sided AS (SELECT *, {_OPEN} AS opens, {_OPEN} OR {_CLOSE} AS bracket FROM lev), "
    "nest AS (SELECT path, pos, tok, depth, CASE WHEN opens THEN lead(pos) OVER (PARTITION BY path, depth, bracket ORDER BY pos) END AS close_pos FROM sided)"
)
# JS bodies: a brace after an arrow, or after a parenthesis that no control word opens.
JS_BODIES = (
    "sig AS (SELECT *, lag(tok) OVER w AS prev, lag(pos) OVER w AS prev_pos FROM nest WHERE path LIKE '%.js' AND trim(tok, chr(10) || ' ') <> '' "
    "WINDOW w AS (PARTITION BY path ORDER BY pos)), "
    "paren AS (SELECT path, close_pos, prev NOT IN ('if', 'for', 'while', 'switch', 'catch', 'with') AS fn FROM sig WHERE tok = '('), "
    "body AS (SELECT s.path, s.pos AS a, s.close_pos AS b FROM sig s LEFT JOIN paren p ON p.path = s.path AND p.close_pos = s.prev_pos "
    "WHERE s.tok = '{' AND (s.prev = '=>' OR (s.prev = ')' AND p.fn))), "
    "outermost AS (SELECT path, a, b FROM (SELECT *, max(b) OVER (PARTITION BY path ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM body) "
    "WHERE m IS NULL OR m < a), "
    "js_out AS (SELECT t.path, string_agg(CASE WHEN t.pos = o.a THEN '{ " + MARKER + " ' WHEN o.a IS NULL OR t.pos = o.b THEN t.tok ELSE '' END, '' ORDER BY t.pos) AS text "
    "FROM nest t LEFT JOIN outermost o ON o.path = t.path AND t.pos BETWEEN o.a AND o.b WHERE t.path LIKE '%.js' GROUP BY t.path)"
)


def _js_tables(text: str) -> str:
    return (
        f"regexp_replace({text}, 'const (_*[A-Z][A-Z0-9_]*) = \\{{[^{{}}]*\\}}', 'const \\1 = {VALUE_MARKER}', 'g')"
    )


# --- Python code files, line by line


def _python(bodies=False, tables=False, strip=False, enums=False) -> str:
    """``py_out(path, text)``: the redaction of the Python texts by lines and indents."""
    drop, swap = ["FALSE"], []
    if tables:
        drop.append("(in_table AND NOT table_start)")
        swap.append("WHEN table_start THEN regexp_replace(line, ' = .*$', ' = ...')")
    if enums:
        swap.append(
            "WHEN in_enum AND regexp_matches(line, '^ +[A-Z]+ = \"[^\"]*\"$') "
            "THEN concat('    VALUE_', member - 1, ' = ''V', member - 1, '''')"
        )
    if bodies:
        first = "concat(repeat(' ', indent), '...')"
        doc = first if strip else f"CASE WHEN is_doc THEN concat(line, chr(10), {first}) ELSE {first} END"
        drop.append("(in_body AND NOT first_body)")
        swap.append(f"WHEN first_body THEN {doc}")
    if strip:
        gone = "(is_doc AND NOT first_body)" if bodies else "is_doc"
        drop.append(gone)
        drop.append("(blank AND after_doc)")
    cases = " ".join(swap)
    shown = f"CASE {cases} ELSE line END" if swap else "line"
    return f'''
pl AS (SELECT path, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS line FROM (SELECT path, string_split(rtrim(text, chr(10)), chr(10)) AS p FROM code WHERE path LIKE '%.py')),
pi AS (SELECT *, trim(line) = '' AS blank, length(line) - length(ltrim(line)) AS indent,
  regexp_matches(line, '^ *def ') AS is_def, regexp_matches(line, '^class .*Enum\\)') AS is_enum,
  regexp_matches(line, '^ *""".*"""$') AS is_doc, regexp_matches(line, '^_*[A-Z][A-Z0-9_]* = \\{{$') AS table_start FROM pl),
heads AS (SELECT d.path, d.ln AS h, d.is_def, d.is_enum, d.table_start, min(n.ln) AS e FROM pi d LEFT JOIN pi n
  ON n.path = d.path AND n.ln > d.ln AND NOT n.blank AND n.indent <= d.indent AND NOT (d.table_start AND n.line = '}}')
  WHERE d.is_def OR d.is_enum OR d.table_start GROUP BY ALL),
mark AS (SELECT p.*, coalesce(h.is_def, FALSE) AS in_body, coalesce(h.is_enum, FALSE) AS in_enum,
  coalesce(t.h IS NOT NULL AND (p.ln = t.h OR p.line = '}}' OR p.indent > 0), FALSE) AS in_table,
  h.h AS head FROM pi p
  LEFT JOIN heads h ON h.path = p.path AND NOT h.table_start AND p.ln > h.h AND p.ln < coalesce(h.e, 999999)
  LEFT JOIN heads t ON t.path = p.path AND t.table_start AND p.ln >= t.h AND p.ln < coalesce(t.e, 999999)),
num AS (SELECT *, in_body AND ln = min(CASE WHEN NOT blank THEN ln END) OVER (PARTITION BY path, head) AS first_body,
  sum(CASE WHEN in_enum AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY path, head ORDER BY ln) AS member,
  coalesce(lag(is_doc) OVER (PARTITION BY path ORDER BY ln), FALSE) AS after_doc FROM mark),
py_out AS (SELECT path, concat(string_agg({shown}, chr(10) ORDER BY ln), chr(10)) AS text FROM num WHERE NOT ({' OR '.join(drop)}) GROUP BY path)'''


JS_PLAIN = "js_plain AS (SELECT path, text FROM code WHERE path LIKE '%.js')"
PY_PLAIN = "SELECT path, text FROM code WHERE path LIKE '%.py'"
VIEW = (
    f"WITH {CODE}, {_python(True, True)}, {_tokens()}, {NEST}, {JS_BODIES}, "
    f"view AS (SELECT path, text FROM py_out UNION ALL SELECT path, {_js_tables('text')} AS text FROM js_out)"
)
STRICT_VIEW = VIEW.replace(_python(True, True), _python(True, True, True, True))

# --- statistics



def _n_lines(t: str) -> str:
    open_end = f"CASE WHEN {t} = '' OR right({t}, 1) = chr(10) THEN 0 ELSE 1 END"
    return f"CAST(length({t}) - length(replace({t}, chr(10), '')) + {open_end} AS BIGINT)"


def _pct(b: str, a: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE round_even(greatest(0.0, (1.0 - CAST({a} AS DOUBLE) / {b}) * 100.0), 1) END"


_MASKED = "text"
for _r in RULES:
    _MASKED = f"regexp_replace({_MASKED}, {_q(_r.pattern)}, '[REDACTED:{_r.id}]', 'g')"

# --- renaming: private module-level names of the code files, less the keep list

NAMES = (
    "py_names AS (SELECT path, pos, name FROM (SELECT path, ln AS pos, regexp_extract(line, '^(?:def |class )?(_[A-Za-z0-9][A-Za-z0-9_]*)(?:\\(| =)', 1) AS name "
    "FROM (SELECT path, unnest(range(len(p))) AS ln, unnest(p) AS line FROM (SELECT path, string_split(text, chr(10)) AS p FROM code WHERE path LIKE '%.py'))) WHERE name <> ''), "
    "js_sig AS (SELECT *, lag(tok) OVER (PARTITION BY path ORDER BY pos) AS prev FROM nest WHERE path LIKE '%.js' AND trim(tok, chr(10) || ' ') <> ''), "
    "js_names AS (SELECT path, pos, tok AS name FROM js_sig WHERE depth = 0 AND prev IN ('function', 'class', 'const', 'let', 'var') AND regexp_matches(tok, '^_[^_]')), "
    "names AS (SELECT path, name, min(pos) AS pos FROM (SELECT * FROM py_names UNION ALL SELECT * FROM js_names) "
    "WHERE KEEP GROUP BY path, name), "
    "renames AS (SELECT path, name AS original, printf('_a%03d', row_number() OVER (PARTITION BY path ORDER BY pos) - 1) AS renamed FROM names)"
)
_KEPT = "name <> '_rate' AND name NOT LIKE '\\_RATES\\_1%' ESCAPE '\\'"
RENAMES = f"WITH {CODE}, {_tokens()}, {NEST}, {NAMES.replace('KEEP', _KEPT)}"
APPLIED = (
    RENAMES + ", sig2 AS (SELECT path, pos, lag(tok) OVER (PARTITION BY path ORDER BY pos) AS prev FROM tok), "
    "renamed AS (SELECT t.path, string_agg(CASE WHEN r.renamed IS NOT NULL AND coalesce(s.prev, '') <> '.' THEN r.renamed ELSE t.tok END, '' ORDER BY t.pos) AS text "
    "FROM tok t JOIN sig2 s ON s.path = t.path AND s.pos = t.pos LEFT JOIN renames r ON r.path = t.path AND r.original = t.tok GROUP BY t.path)"
)

# --- context documents per repository

_HEAD = (
    "<!-- generated by veilspark 0.1.0; policy: defaults; strict: false -->\n# Safe context\n\n"
    f"What is left out stands as `...` (Python) or `{MARKER}` (JavaScript, TypeScript): what functions and methods do, "
    "and what collections in upper case hold. All else is as it was written, comments in Python aside."
)
PARTS = VIEW + (
    ", placed AS (SELECT c.repo, v.path, v.text FROM view v JOIN code c ON c.path = v.path), "
    f"parts AS (SELECT DISTINCT repo, CAST(0 AS BIGINT) AS rank, '' AS path, {_q(_HEAD)} AS text FROM placed "
    "UNION ALL SELECT DISTINCT repo, 1, '', concat(chr(10), '## Files', chr(10), chr(10), '```') FROM placed "
    "UNION ALL SELECT repo, 2, path, path FROM placed UNION ALL SELECT DISTINCT repo, 3, '', '```' FROM placed "
    "UNION ALL SELECT repo, CASE WHEN path LIKE '%.py' THEN 4 ELSE 5 END, path, concat(chr(10), '## `', path, '`', chr(10), chr(10), '```', "
    "CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'javascript' END, chr(10), CASE WHEN path LIKE '%.py' THEN rtrim(text, chr(10)) ELSE text END, chr(10), '```') FROM placed)"
)

# --- path patterns

_DEFAULT_IGNORED = "|".join(
    "(?:^|/)" + g.rstrip("/").replace(".", "\\.").replace("*", "[^/]*") + ("/" if g.endswith("/") else "(?:/|$)")
    for g in DEFAULT_IGNORES
)
_KEEP_REL = (
    "(CASE WHEN regexp_matches(rel, '^src/pricing/') THEN FALSE WHEN regexp_matches(rel, '^lib/f1[^/]*(/|$)') THEN TRUE "
    f"WHEN regexp_matches(rel, '[^/]*\\.md$') OR regexp_matches(rel, '^lib/[^/]*\\.js$') THEN FALSE "
    f"WHEN regexp_matches(rel, '{_DEFAULT_IGNORED}') THEN FALSE ELSE TRUE END)"
)
_TOP = "rel NOT LIKE '%/%'"
_FLAG = "coalesce(bool_or({}), FALSE)"

_ENTITY = "|".join(f"(?:{r.pattern})" for r in RULES)
PSEUDO = (
    f"WITH {DOCS}, hit AS (SELECT path, text, string_split_regex(text, {_q(_ENTITY)}) AS pieces, regexp_extract_all(text, {_q(_ENTITY)}) AS vals FROM docs), "
    "ent AS (SELECT path, pos, value, CASE WHEN value LIKE '%@%' THEN 'email' WHEN value LIKE '% License' THEN 'license' ELSE 'ipv4' END AS rule_id FROM (SELECT path, unnest(range(len(vals))) AS pos, unnest(vals) AS value FROM hit)), "
    "seen AS (SELECT path, rule_id, value, min(pos) AS pos FROM ent GROUP BY ALL), "
    "alias AS (SELECT path, rule_id, value AS original, concat(upper(rule_id), '_', printf('%03d', row_number() OVER (PARTITION BY path, rule_id ORDER BY pos) - 1)) AS renamed FROM seen)"
)

ORACLES: dict[str, str] = {
    "read_corpus": "SELECT CAST(doc_id AS string) AS path, sha256(concat(coalesce(text, ''), chr(10))) AS sha256, "
    "CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS length FROM documents",
    "corpus_from_table": "SELECT concat(conv_id, '/', turn) AS path, text FROM conversations",
    "decode_utf8": f"WITH {DOCS} SELECT path, lang <> 'fr' AS decodable, CASE WHEN lang <> 'fr' THEN text END AS text FROM docs",
    "write_findings": f"WITH {DOCS}, {LINES}, {POLICY} {POLICY_FINDINGS}",
    "write_corpus": f"WITH {CODE} SELECT path, text, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'javascript' END AS language FROM code",
    "write_context": f"{PARTS} SELECT repo, unnest(string_split(text, chr(10))) AS line FROM parts",
    "exclude_paths": f"WITH {REPO_FILES} SELECT repo, rel FROM repo_files WHERE {_KEEP_REL}",
    "with_language": f"WITH {REPO_PATHS} SELECT path, {_LANG.replace('P', 'path')} AS language FROM repo_paths",
    "route_files": f"WITH {REPO_PATHS}, l AS (SELECT path, {_LANG.replace('P', 'path')} AS lang FROM repo_paths) "
    "SELECT path, CASE WHEN lang = 'python' THEN 'python' WHEN lang IS NULL THEN 'unsupported' ELSE 'js' END AS route FROM l",
    "relative_path": f"WITH {REPO_PATHS} SELECT CASE WHEN starts_with(path, 'repo1/') THEN substr(path, 7) ELSE path END AS path FROM repo_paths",
    "tag_sensitive_paths": f"WITH {REPO_FILES} SELECT repo, rel, regexp_matches(rel, '^src/pricing/.+|\\.toml$|^lib/f[^/]\\.js$') AS sensitive FROM repo_files",
    "valid_rules": f"WITH {DOCS}, {LINES}, {POLICY} SELECT rule_id, count(*) AS matches FROM policy GROUP BY rule_id",
    "allow_matches": f"WITH {DOCS}, {LINES}, {POLICY} SELECT {_PUBLIC} FROM policy WHERE value NOT IN "
    "(SELECT value FROM policy p JOIN docs d ON d.path = p.path WHERE d.source = 'src1')",
    "lines": f"WITH {DOCS}, {LINES} SELECT path, ln, line FROM lines",
    "tokens": f"WITH {CODE}, {_tokens()} SELECT path, pos, tok FROM tok",
    "nesting": f"WITH {CODE}, {_tokens()}, {NEST} SELECT path, pos, tok, depth, close_pos FROM nest",
    "unbalanced_files": f"WITH {BROKEN}, {_tokens('broken')}, {NEST} SELECT path, min(least(r, 0))::BIGINT AS low, "
    "CAST(arg_max(r, pos) AS BIGINT) AS last, 'unbalanced brackets' AS error FROM run GROUP BY path HAVING min(r) < 0 OR arg_max(r, pos) <> 0",
    "definitions": f"WITH {CODE}, {_tokens()}, {NEST}, "
    "py AS (SELECT path, ln, line, regexp_extract(line, '^ *(def|class) ([A-Za-z_]+)', ['k', 'n']) AS d, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_]*) =', 1) AS c "
    "FROM (SELECT path, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS line FROM (SELECT path, string_split(text, chr(10)) AS p FROM code WHERE path LIKE '%.py'))), "
    "s AS (SELECT *, lag(tok) OVER (PARTITION BY path ORDER BY pos) AS prev FROM nest WHERE path LIKE '%.js' AND trim(tok, chr(10) || ' ') <> ''), "
    "nl AS (SELECT path, pos, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln FROM tok) "
    "SELECT path, ln, CASE d.k WHEN 'def' THEN 'function' ELSE 'class' END AS kind, d.n AS name, CAST(length(line) - length(ltrim(line)) AS BIGINT) AS depth FROM py WHERE d.k <> '' "
    "UNION ALL SELECT path, ln, 'constant', c, 0 FROM py WHERE c <> '' "
    "UNION ALL SELECT s.path, CAST(nl.ln AS BIGINT), CASE prev WHEN 'function' THEN 'function' WHEN 'class' THEN 'class' ELSE 'constant' END, tok, depth FROM s "
    "JOIN nl ON nl.path = s.path AND nl.pos = s.pos WHERE prev IN ('function', 'class', 'const', 'let', 'var')",
    "scan_rules": f"WITH {DOCS}, {LINES}, {POLICY} {POLICY_FINDINGS}",
    # The texts that a match holds narrow the pairs of lines and rules down before a pattern runs.
    "scan_rule_table": f"WITH {DOCS}, {LINES}, worded AS (SELECT doc_id, {RULE_WORDS} AS words FROM documents), "
    f"rules AS (SELECT concat('w', doc_id) AS id, {RULE_PATTERN} AS pattern, split_part(words, ' ', 1) AS one, split_part(words, ' ', 2) AS two, doc_id % 30 AS form "
    "FROM worded WHERE words <> '' AND doc_id % 30 <> 7), near AS (SELECT path, ln AS line, line AS t, id, pattern FROM lines, rules WHERE contains(line, one) OR (form IN (9, 10) "
    "AND (form = 10 OR contains(line, two)))), hits AS (SELECT 'low' AS severity, path, line, concat('policy/', id) AS rule_id, id AS rule, unnest(regexp_extract_all(t, pattern)) AS value FROM near) "
    f"SELECT {_PUBLIC}, concat('Review the match against policy rule ''', rule, '''.') AS suggested_action FROM hits",
    "rule_reasons": f"WITH worded AS (SELECT doc_id, {RULE_WORDS} AS words FROM documents) SELECT concat('w', doc_id) AS id, {RULE_PATTERN} AS pattern, "
    "CASE doc_id % 30 WHEN 7 THEN 'refused' WHEN 8 THEN 'rewritten' ELSE 'ok' END AS status, "
    "CASE doc_id % 30 WHEN 7 THEN 'recursion' WHEN 8 THEN 'equal form' END AS reason FROM worded WHERE words <> ''",
    "syntax_errors": f"WITH faulty AS (SELECT {CODE_PATH} AS path, CASE WHEN p_partkey % 2 = 1 THEN CASE WHEN p_size % 9 IN (6) THEN 'unbalanced brackets' END "
    "ELSE CASE p_size % 9 WHEN 0 THEN 'a header without a colon' WHEN 1 THEN 'two operators' WHEN 2 THEN 'a header without a colon' WHEN 3 THEN 'a dedent to no level' "
    "WHEN 4 THEN 'dangling operator' WHEN 5 THEN 'an open string' WHEN 6 THEN 'unbalanced brackets' END END AS error FROM part) SELECT path, error FROM faulty WHERE error IS NOT NULL",
    "scan_splits": f"WITH {WHOLE}, {FOUND} SELECT * FROM found",
    "scan_changes": f"{SCAN} SELECT * FROM found",
    "scan_builtin": f"WITH {DOCS}, {LINES}, {BUILTIN} {BUILTIN_FINDINGS}",
    "scan_entropy": f"WITH {DOCS}, {LINES}, {ENTROPY} "
    f"SELECT path, line, rule_id, {_preview('value')} AS preview, round(e, 4) AS entropy FROM high",
    "dedupe_builtin": f"WITH {DOCS}, {LINES}, {BUILTIN} SELECT path, rule_id, line, {_preview('value')} AS preview FROM built_once",
    "redact_preview": f"WITH {DOCS}, w AS (SELECT path, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM docs), "
    f"x AS (SELECT path, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM w) SELECT path, pos, {_preview('word')} AS preview FROM x",
    "findings": f"{SCAN} SELECT * FROM found",
    "scan_stream": f"{SCAN} SELECT * FROM found",
    "scan_summary": f"{SCAN} SELECT (SELECT count(*) FROM docs) AS files_scanned, (SELECT count(*) FROM found) AS findings, "
    "CASE WHEN (SELECT count(*) FROM found) = 0 THEN 'ok' ELSE 'findings' END AS status",
    "clean_rows": f"{SCAN} SELECT path, CAST(strlen(text) AS BIGINT) AS bytes FROM docs WHERE path NOT IN (SELECT path FROM found)",
    "findings_by_repo": f"WITH {SHARED}, {FOUND} SELECT severity, {_REPO_AND_PATH}, line, rule_id, redacted_preview, suggested_action FROM found",
    "clean_rows_by_repo": f"WITH {SHARED}, {FOUND} SELECT {_REPO_AND_PATH}, sha256(text) AS sha256 FROM docs WHERE path NOT IN (SELECT path FROM found)",
    "rule_clean_rows": f"WITH {DOCS}, {LINES}, {POLICY} SELECT path FROM docs WHERE path NOT IN (SELECT path FROM policy)",
    "mask_text": f"WITH {DOCS} SELECT path, {_MASKED} AS text FROM docs",
    "nearest_policy": f"WITH {REPO_PATHS}, r AS (SELECT DISTINCT o_custkey AS c FROM orders), "
    "pol AS (SELECT concat('repo', c) AS dir, concat('top', c) AS policy, 1 AS d FROM r WHERE c % 3 = 0 UNION ALL "
    "SELECT concat('repo', c, '/src/pricing'), concat('deep', c), 3 FROM r WHERE c % 5 = 0) "
    "SELECT p.path, arg_max(pol.policy, pol.d) AS policy, arg_max(pol.dir, pol.d) AS policy_dir FROM repo_paths p "
    "LEFT JOIN pol ON starts_with(p.path, pol.dir || '/') GROUP BY p.path",
    "redact_indented_bodies": f"WITH {CODE}, {_python(True)}, {JS_PLAIN} SELECT * FROM py_out UNION ALL SELECT * FROM js_plain",
    "redact_brace_bodies": f"WITH {CODE}, {_tokens()}, {NEST}, {JS_BODIES} SELECT path, text FROM js_out UNION ALL {PY_PLAIN}",
    "redact_constant_tables": f"WITH {CODE}, {_python(tables=True)} SELECT path, text FROM py_out UNION ALL "
    f"SELECT path, {_js_tables('text')} FROM code WHERE path LIKE '%.js'",
    "strip_docstrings": f"WITH {CODE}, {_python(strip=True)}, {JS_PLAIN} SELECT * FROM py_out UNION ALL SELECT * FROM js_plain",
    "alias_enums": f"WITH {CODE}, {_python(enums=True)}, {JS_PLAIN} SELECT * FROM py_out UNION ALL SELECT * FROM js_plain",
    "redact_file": f"{VIEW} SELECT path, text, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'javascript' END AS language, "
    "CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'js' END AS route, CAST(NULL AS VARCHAR) AS error FROM view",
    "redact_file_strict": f"{STRICT_VIEW} SELECT path, text FROM view",
    "file_tree": f"WITH {REPO_FILES} SELECT repo, rel AS path FROM repo_files",
    "context_document": f"{PARTS} SELECT * FROM parts",
    "document_text": f"{PARTS} SELECT repo, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, "
    "sha256(concat(string_agg(text, chr(10) ORDER BY rank, path), chr(10))) AS sha256 FROM parts GROUP BY repo",
    "context_status": "SELECT 'context' AS command, 'ok' AS status, count(*) AS files_discovered, CAST(NULL AS VARCHAR) AS policy_loaded_from, "
    "CAST(1 AS BIGINT) AS policy_version, FALSE AS strict FROM part",
    "diff_files": f"WITH {DOCS}, m AS (SELECT path, text, {_MASKED} AS after FROM docs), z AS (SELECT path, CAST(strlen(text) AS BIGINT) AS bytes_before, {_n_lines('text')} AS lines_before, "
    f"CAST(strlen(after) AS BIGINT) AS bytes_after, {_n_lines('after')} AS lines_after FROM m) "
    f"SELECT *, bytes_after - bytes_before AS bytes_delta, lines_after - lines_before AS lines_delta, {_pct('bytes_before', 'bytes_after')} AS reduction_pct FROM z",
    "js_table_count": f"WITH {CODE} SELECT path, CAST(len(list_filter(regexp_extract_all(text, '(?m)^\\s*(?:const|let|var)\\s+([A-Z_][A-Z0-9_]*)\\s*=\\s*[\\{{\\[]', 1), lambda n: replace(n, '_', '') <> '')) AS BIGINT) AS tables FROM code WHERE path LIKE '%.js'",
    "marker_counts": f"{VIEW} SELECT path, CAST((length(text) - length(replace(text, '{MARKER}', ''))) / {len(MARKER)} - (length(text) - length(replace(text, '{VALUE_MARKER}', ''))) / {len(VALUE_MARKER)} AS BIGINT) AS bodies FROM view WHERE path LIKE '%.js'",
    "diff_counts": f"WITH {CODE}, c AS (SELECT path, text, path LIKE '%.py' AS py FROM code) SELECT path, CASE WHEN py THEN 'python' ELSE 'javascript' END AS language, "
    "CAST(CASE WHEN py THEN len(regexp_extract_all(text, '(?m)^ *def ')) ELSE len(regexp_extract_all(text, 'function |=> |m\\(a')) END AS BIGINT) AS function_bodies_redacted, "
    "CAST(CASE WHEN py THEN len(regexp_extract_all(text, '(?m)^_RATES_[0-9]+ = ')) ELSE len(regexp_extract_all(text, '(?m)^const _TABLE_[0-9]+ = ')) END AS BIGINT) AS tables_redacted, "
    "CAST(len(regexp_extract_all(text, '\"\"\"[^\"]*\"\"\"')) AS BIGINT) AS docstrings_stripped, "
    "CAST(len(regexp_extract_all(text, '(?m)^class .*Enum\\)')) AS BIGINT) AS enum_classes_aliased, CAST(NULL AS VARCHAR) AS error FROM c",
    "private_definitions": f"WITH {CODE}, {_tokens()}, {NEST}, {NAMES.replace('KEEP', _KEPT)} SELECT path, name FROM "
    "(SELECT DISTINCT path, name FROM (SELECT * FROM py_names UNION ALL SELECT * FROM js_names))",
    "protect_names": f"WITH {CODE}, {_tokens()}, {NEST}, "
    "py AS (SELECT path, regexp_extract(line, '^(?: *def | *class |)([A-Za-z_][A-Za-z0-9_]*)(?:\\(|:| = )', 1) AS name, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM code WHERE path LIKE '%.py')), "
    "s AS (SELECT *, lag(tok) OVER (PARTITION BY path ORDER BY pos) AS prev FROM nest WHERE path LIKE '%.js' AND trim(tok, chr(10) || ' ') <> '') "
    f"SELECT path, name FROM (SELECT path, name FROM py WHERE name <> '' UNION ALL SELECT path, tok AS name FROM s WHERE prev IN ('function', 'class', 'const', 'let', 'var')) WHERE {_KEPT}",
    "rename_map": f"{RENAMES} SELECT path, original, renamed FROM renames",
    "rename_entries": f"{RENAMES} SELECT concat(path, ':', original) AS entry, renamed FROM renames",
    "apply_renames": f"{APPLIED} SELECT path, text FROM renamed",
    "manifest": f"{APPLIED}, m AS (SELECT 'source_files' AS section, path AS name, sha256(text) AS value FROM code UNION ALL "
    "SELECT 'output_files', path, sha256(text) FROM renamed UNION ALL SELECT 'rename_map', concat(path, ':', original), renamed FROM renames UNION ALL "
    "SELECT 'meta', 'engine_version', 'veilspark 0.1.0' UNION ALL SELECT 'meta', 'ruleset_version', '1' UNION ALL "
    "SELECT 'meta', 'policy_hash', NULL UNION ALL SELECT 'meta', 'policy_snapshot', NULL) SELECT * FROM m",
    "write_manifest": f"WITH {CODE}, {_tokens()}, {NEST}, {NAMES.replace('KEEP', 'TRUE')}, m AS (SELECT 'source_files' AS section, path AS name, sha256(text) AS value FROM code UNION ALL "
    "SELECT 'output_files', path, sha256(text) FROM code UNION ALL SELECT 'rename_map', concat(path, ':', original), renamed FROM renames UNION ALL "
    "SELECT 'meta', 'engine_version', 'veilspark 0.1.0' UNION ALL SELECT 'meta', 'ruleset_version', '1' UNION ALL "
    "SELECT 'meta', 'policy_hash', sha256('version: 1') UNION ALL SELECT 'meta', 'policy_snapshot', 'version: 1') SELECT * FROM m",
    "transform_counts": f"{RENAMES} SELECT count(*) FILTER (WHERE p_partkey % 2 = 1 OR p_size <= 30) AS files_transformed, "
    "count(*) FILTER (WHERE p_partkey % 2 = 0 AND p_size > 30) AS files_copied, (SELECT count(*) FROM renames) AS renames FROM part",
    "tree_digests": TREE + " " + " UNION ALL ".join(f"SELECT dir, CAST({d} AS BIGINT) AS depth, files, digest FROM d{d}" for d in range(4)),
    "verify_tree": f"WITH {REPO_PATHS}, old AS (SELECT path FROM repo_paths WHERE path NOT LIKE 'repo1/%'), "
    "new AS (SELECT path, path LIKE '%7.js' AS changed FROM repo_paths WHERE path NOT LIKE '%/lib/%1.tsx' AND path NOT LIKE 'repo2/%') "
    "SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'extra' WHEN new.path IS NULL THEN 'missing' ELSE 'changed' END AS status "
    "FROM old FULL OUTER JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR changed",
    "verify_manifest": f"WITH {BROKEN} SELECT path, CASE WHEN p_size > 30 THEN 'changed' ELSE 'ok' END AS status FROM broken",
    "verify_output": f"{APPLIED}, rtok AS (SELECT path, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM (SELECT path, "
    f"CASE WHEN path LIKE '%.py' THEN regexp_extract_all(text, {_q(_TOKEN['py'])}) ELSE regexp_extract_all(text, {_q(_TOKEN['js'])}) END AS t FROM renamed)), "
    "rsig AS (SELECT *, lag(tok) OVER (PARTITION BY path ORDER BY pos) AS prev FROM rtok), "
    "gone AS (SELECT path, original FROM renames r WHERE NOT EXISTS (SELECT 1 FROM renames n WHERE n.path = r.path AND n.renamed = r.original)), "
    "residual AS (SELECT count(*) AS n FROM rsig s JOIN gone g ON g.path = s.path AND g.original = s.tok WHERE coalesce(s.prev, '') <> '.'), "
    f"cut AS (SELECT path, string_split_regex(text, '{_BREAK}') AS parts FROM renamed), lines AS (SELECT path, unnest(parts) AS line FROM cut), "
    f"dirty AS (SELECT path FROM lines WHERE {' OR '.join(f'len({_found(r)}) > 0' for r in (*RULES, *BUILTIN_RULES))} UNION SELECT path FROM (SELECT path, "
    "unnest(regexp_extract_all(line, '[A-Za-z0-9+/=_-]{20,}')) AS v FROM lines) WHERE (SELECT entropy(ch) FROM (SELECT unnest(string_split(v, '')) AS ch)) > "
    "CASE WHEN regexp_matches(v, '^[0-9A-Fa-f]+$') THEN 3.0 ELSE 4.5 END), secret AS (SELECT count(*) AS n FROM dirty), "
    f"off_before AS (SELECT count(*) AS n FROM (SELECT path FROM tok GROUP BY path HAVING sum(CASE WHEN {_OPEN} THEN 1 WHEN {_CLOSE} THEN -1 ELSE 0 END) <> 0)), "
    f"off_after AS (SELECT count(*) AS n FROM (SELECT path FROM rtok GROUP BY path HAVING sum(CASE WHEN {_OPEN} THEN 1 WHEN {_CLOSE} THEN -1 ELSE 0 END) <> 0)), "
    "res AS (SELECT 'rows_preserved' AS c, CAST(abs((SELECT count(*) FROM code) - (SELECT count(*) FROM renamed)) AS BIGINT) AS failures "
    "UNION ALL SELECT 'no_private_name', n FROM residual UNION ALL SELECT 'no_secret', n FROM secret "
    "UNION ALL SELECT 'brackets_balanced', greatest(0, (SELECT n FROM off_after) - (SELECT n FROM off_before))) "
    "SELECT c AS \"check\", failures, failures = 0 AS passed FROM res",
    "hash_files": f"WITH {DOCS} SELECT path, sha256(text) AS sha256 FROM docs",
    "passthrough": f"WITH {CODE}, {_tokens()}, {NEST}, {JS_BODIES} SELECT path, text FROM js_out UNION ALL {PY_PLAIN}",
    "pseudonymize": f"{PSEUDO}, cells AS (SELECT path, unnest(range(len(pieces))) AS pos, unnest(pieces) AS piece FROM hit), "
    "glue AS (SELECT c.path, c.pos, concat(c.piece, coalesce(a.renamed, '')) AS s FROM cells c LEFT JOIN ent e ON e.path = c.path AND e.pos = c.pos "
    "LEFT JOIN alias a ON a.path = e.path AND a.rule_id = e.rule_id AND a.original = e.value) "
    "SELECT path, string_agg(s, '' ORDER BY pos) AS text FROM glue GROUP BY path",
    "pseudonym_map": f"{PSEUDO} SELECT path, rule_id, original, renamed FROM alias",
    "project_profile": f"WITH {REPO_FILES}, f AS (SELECT repo, "
    + _FLAG.format(f"rel IN ('pyproject.toml', 'setup.py', 'setup.cfg', 'Pipfile', 'poetry.lock') OR ({_TOP} AND rel LIKE '%_.py')")
    + " AS has_python, "
    + _FLAG.format("rel IN ('package.json', 'pnpm-lock.yaml', 'yarn.lock', 'package-lock.json')")
    + " AS has_node, "
    + _FLAG.format("rel = 'tsconfig.json'")
    + " AS ts, "
    + _FLAG.format(f"{_TOP} AND regexp_matches(rel, '[^.]\\.tsx?$')")
    + " AS ts_file, bool_or(rel LIKE 'src/%') AS d1, bool_or(rel LIKE 'lib/%') AS d2 FROM repo_files GROUP BY repo), "
    "g AS (SELECT *, ts OR (has_node AND ts_file) AS has_typescript FROM f) "
    "SELECT repo, has_python, has_node, has_typescript, concat_ws(',', CASE WHEN d1 THEN 'src/**' END, CASE WHEN d2 THEN 'lib/**' END) AS src_dirs, "
    "CASE WHEN NOT has_python AND NOT has_typescript AND NOT has_node THEN 'generic' ELSE "
    "concat_ws(' + ', CASE WHEN has_python THEN 'Python' END, CASE WHEN has_typescript THEN 'TypeScript' WHEN has_node THEN 'JavaScript' END) END AS label FROM g",
    "constant_table_name": f"WITH {CODE}, {_tokens()} SELECT tok, count(*) AS uses FROM tok WHERE regexp_matches(tok, '^_*[A-Z0-9_]*[A-Z][A-Z0-9_]*$') GROUP BY tok",
    "private_name": f"WITH {CODE}, {_tokens()} SELECT path, tok, count(*) AS uses FROM tok WHERE regexp_matches(tok, '^_[^_]') OR (tok = '_' AND path LIKE '%.py') GROUP BY path, tok",
}

# Preview masking, one rule after the other: pieces and previews in turn.
_STEP = (
    "list_reduce(list_transform(range(len(string_split_regex(T, P))), "
    "lambda i: concat(string_split_regex(T, P)[i + 1], coalesce(V, ''))), lambda x, y: x || y)"
)


def _preview_step(text: str, pattern: str) -> str:
    value = f"regexp_extract_all({text}, {_q(pattern)})[i + 1]"
    return _STEP.replace("V", _preview(value)).replace("T,", f"{text},").replace("P)", f"{_q(pattern)})")


ORACLES["mask_preview"] = f"WITH {DOCS}"
for _i, _rule in enumerate(RULES):
    _from = "docs" if _i == 0 else f"m{_i - 1}"
    ORACLES["mask_preview"] += f", m{_i} AS (SELECT path, {_preview_step('text', _rule.pattern)} AS text FROM {_from})"
ORACLES["mask_preview"] += f" SELECT path, text FROM m{len(RULES) - 1}"

# Sizes of the whole report, for the plain and for the partly broken code files.
_SIZES = (
    f"b AS (SELECT path, CAST(strlen(text) AS BIGINT) AS bytes_before, {_n_lines('text')} AS lines_before FROM SRC), "
    f"a AS (SELECT path, CAST(strlen(text) AS BIGINT) AS bytes_after, {_n_lines('text')} AS lines_after FROM view)"
)
ORACLES["diff_context"] = (
    f"{VIEW}, {_SIZES.replace('SRC', 'code')} SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'javascript' END AS language, bytes_before, bytes_after, "
    "bytes_after - bytes_before AS bytes_delta, lines_before, lines_after, lines_after - lines_before AS lines_delta, "
    "CAST(CASE WHEN path LIKE '%.py' THEN 2 ELSE 4 END AS BIGINT) AS function_bodies_redacted, CAST(1 AS BIGINT) AS tables_redacted, CAST(0 AS BIGINT) AS docstrings_stripped, "
    f"CAST(0 AS BIGINT) AS enum_classes_aliased, {_pct('bytes_before', 'bytes_after')} AS reduction_pct, CAST(NULL AS VARCHAR) AS error FROM b JOIN a USING (path)"
)
# Brackets appended to a JS text stay in its view; a Python text with them is an error and is left out.
ORACLES["diff_totals"] = (
    f"{VIEW}, {BROKEN}, z AS (SELECT b.path, b.path LIKE '%.py' AND b.p_size > 30 AS err, b.path LIKE '%.py' AS py, CAST(strlen(b.text) AS BIGINT) AS before, "
    "CAST(strlen(v.text) + strlen(b.text) - strlen(c.text) AS BIGINT) AS after FROM broken b JOIN view v ON v.path = b.path JOIN code c ON c.path = b.path), "
    "s AS (SELECT count(*) AS files, count(*) FILTER (WHERE err) AS files_with_error, CAST(sum(before) FILTER (WHERE NOT err) AS BIGINT) AS bytes_before, "
    "CAST(sum(after) FILTER (WHERE NOT err) AS BIGINT) AS bytes_after, CAST(sum(CASE WHEN py THEN 2 ELSE 4 END) FILTER (WHERE NOT err) AS BIGINT) AS function_bodies_redacted, "
    "count(*) FILTER (WHERE NOT err) AS tables_redacted FROM z) "
    "SELECT files, files_with_error, bytes_before, bytes_after, function_bodies_redacted, tables_redacted, CAST(0 AS BIGINT) AS docstrings_stripped, "
    f"CAST(0 AS BIGINT) AS enum_classes_aliased, {_pct('bytes_before', 'bytes_after')} AS reduction_pct FROM s"
)
