"""The registered queries in DuckDB SQL, written without the operators of this library.

Two styles: *recompute* (statements are split with windows over lines, scores
are plain regular expressions) and *round trip* (the generator of a text knows
what has to come out, so the expected value is read off the base table).
"""

from __future__ import annotations

from ..functions.scoring import BUSINESS_PATTERNS, PIPELINE_PATTERNS
from . import corpora as C
from .catalog import GENERATED, REPO_URL

NL = "chr(10)"
_TRIM = r"'^\s+|\s+$', '', 'g'"

# --- statements of SQL files (recompute) ----------------------------------------------------


def _statements(files: str) -> str:
    """CTEs from ``files(file_path, content)`` to ``sql_units``."""
    return rf"""
files as ({files}),
lines as (
  select file_path, unnest(string_split(content, {NL})) as line,
         unnest(range(len(string_split(content, {NL})))) as i
  from files),
marks as (
  select *, not regexp_matches(line, '^\s*(--|$)') as code,
         regexp_matches(line, '^\s*--') as comment from lines),
ends as (
  select *, code and regexp_matches(line, ';\s*$') and
    sum(case when code then (length(line) - length(replace(line, '$$', ''))) // 2 else 0 end)
      over (partition by file_path order by i) % 2 = 0 as closes
  from marks),
segments as (
  select *, coalesce(sum(closes::int) over (partition by file_path order by i
    rows between unbounded preceding and 1 preceding), 0) as seg from ends),
firsts as (
  select *, min(case when code then i end) over (partition by file_path, seg) as first_code
  from segments),
statements as (
  select file_path, seg, min(first_code) + 1 as code_line,
    regexp_replace(string_agg(line, {NL} order by i), {_TRIM}) as text,
    string_agg(regexp_replace(regexp_replace(line, {_TRIM}), '^--\s*', ''), ' ' order by i)
      filter (where comment and (first_code is null or i < first_code)
              and not regexp_matches(line, '(?i)^\s*--\s*business_rule')) as description
  from firsts group by file_path, seg),
numbered as (
  select file_path, text, description,
    row_number() over (partition by file_path order by seg) - 1 as ordinal,
    coalesce(code_line, lag(code_line) over (partition by file_path order by seg), 1) as start_line
  from statements where text <> ''),
typed as (
  select *, coalesce(nullif(lower(regexp_extract(upper(text),
    '^CREATE\s+(OR\s+REPLACE\s+)?(PROCEDURE|FUNCTION|VIEW|TRIGGER)', 2)), ''), 'query') as sql_type
  from numbered),
sql_units as (
  select 'sql' as kind, file_path, ordinal, start_line,
    start_line + length(text) - length(replace(text, {NL}, '')) as end_line, sql_type,
    case when sql_type = 'query' then coalesce(
        nullif(regexp_extract(text, '(?i)--\s*name:\s*(\w+)', 1), ''),
        'cte_' || nullif(regexp_extract(text, '(?i)WITH\s+(\w+)\s+AS', 1), ''), 'unnamed_query')
      else coalesce(nullif(regexp_extract(text,
        '(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(PROCEDURE|FUNCTION|VIEW|TRIGGER)\s+(\w+)', 2), ''),
        'unnamed_' || sql_type) end as name,
    description, text as source_code,
    list_transform(regexp_extract_all(text, '(?i)--\s*BUSINESS_RULE\s*[:=]?\s*([^\n\r]+)', 1),
      lambda m: trim(m)) as markers,
    regexp_extract_all(text, '(?i)\bFROM\s+(\w+(?:\.\w+)?)', 1)
      || regexp_extract_all(text, '(?i)\bJOIN\s+(\w+(?:\.\w+)?)', 1)
      || regexp_extract_all(text, '(?i)\bINTO\s+(\w+(?:\.\w+)?)', 1)
      || regexp_extract_all(text, '(?i)\bUPDATE\s+(\w+(?:\.\w+)?)', 1) as tables
  from typed)"""


def _joined(table: str, path: str, text: str, key: str) -> str:
    return (
        f"select {path} as file_path, string_agg({text}, {NL} order by {key}) as content "
        f"from {table} group by 1"
    )


BY_CUSTOMER = _joined(
    "orders",
    f"'sql/c'||o_custkey||'-'||(o_orderkey // {C.ORDERS_PER_FILE})||'.sql'",
    C.SQL_TEXT,
    "o_orderkey",
)

# --- Python functions and embedded SQL (round trip) -------------------------------------------


def _tree_path(table: str, key: str) -> str:
    return C.TREE_PATHS[table].format(key=key, div="//")


def _functions(path: str = f"'py/p'||(p_partkey // {C.PARTS_PER_FILE})||'.py'") -> str:
    return rf"""
pieces as (
  select *, {path} as file_path, {C.PY_TEXT} as text,
    case when p_partkey%6=0 then '@deco('||p_size||')' end as decorator from part),
placed as (
  select *, length(text) - length(replace(text, {NL}, '')) as n,
    row_number() over (partition by file_path order by p_partkey) - 1 as ordinal from pieces),
started as (
  select *, 1 + coalesce(sum(n + 1) over (partition by file_path order by p_partkey
    rows between unbounded preceding and 1 preceding), 0) as line_at from placed),
named as (
  select *, case p_partkey%4 when 0 then 'load_' when 1 then 'validate_' when 2 then 'setup_'
    else 'f_' end || p_partkey as name from started),
py_units as (
  select 'function' as kind, file_path, ordinal, name,
    line_at + case when decorator is null then 0 else 1 end as start_line, line_at + n - 1 as end_line,
    'def '||name||'(a: int, b = '||p_size||', c: str = "x")'
      ||case when p_partkey%2=0 then ' -> float' else '' end as signature,
    case when p_partkey%2=0 then 'float' end as return_type,
    case when p_partkey%3=0 then p_name||'.'||{NL}||{NL}||'    BUSINESS_RULE: size '||p_size end
      as description,
    list_filter([case when p_partkey%3=0 then 'size '||p_size end,
      case when p_partkey%7=0 then 'brand '||p_brand end], lambda m: m is not null) as markers,
    decorator, p_size,
    substr(text, 1 + coalesce(length(decorator) + 1, 0),
      length(text) - 1 - coalesce(length(decorator) + 1, 0)) as source_code
  from named)"""


def _embedded(
    path: str = f"'py/s'||s_nationkey||'-'||(s_suppkey // {C.SUPPLIERS_PER_FILE})||'.py'",
) -> str:
    return f"""
calls as (
  select *, {path} as file_path,
    2 + coalesce(sum(case when s_suppkey%3=0 then 5 else 3 end) over (partition by {path}
      order by s_suppkey rows between unbounded preceding and 1 preceding), 0) as start_line
  from supplier),
embedded_units as (
  select 'sql' as kind, file_path,
    row_number() over (partition by file_path order by s_suppkey) - 1 as ordinal,
    'embedded_sql_' || row_number() over (partition by file_path order by s_suppkey) as name,
    start_line, start_line + case when s_suppkey%3=0 then 2 else 0 end as end_line,
    'query' as sql_type, null::varchar as description, []::varchar[] as markers,
    case when s_suppkey%3=0 then {NL}||'SELECT a FROM t'||s_nationkey||{NL}
      else 'UPDATE s'||s_suppkey||' SET a = 1' end as source_code,
    case when s_suppkey%3=0 then 't'||s_nationkey else 's'||s_suppkey end as tables
  from calls where s_suppkey%3 in (0, 1))"""


# --- labels (recompute) -----------------------------------------------------------------------


def _score(patterns: tuple[str, ...]) -> str:
    tests = []
    for p in patterns:
        p = p.replace(".*", r"[^\n\r\x{2028}\x{2029}]*")
        tests.append(f"regexp_matches(t, '(?i){p}')::int")
    return " + ".join(tests)


def _scored(source: str, columns: str) -> str:
    """``columns`` and both scores from ``source``(name, source_code, description)."""
    return (
        f"select {columns}, {_score(BUSINESS_PATTERNS)} as b, {_score(PIPELINE_PATTERNS)} as p from "
        f"(select *, name||' '||source_code||' '||coalesce(description, '') as t from {source})"
    )


_MARKED = "len(markers) > 0"
_LABEL = f"case when {_MARKED} or b > p then 'business_logic' else 'pipeline_code' end"
_CONFIDENCE = f"""case when {_MARKED} then 'high' when b = p then 'low'
 when (p = 0 and b >= 2) or (b = 0 and p >= 2) then 'high' else 'medium' end"""
_REASON = f"""case when {_MARKED}
   then 'Contains BUSINESS_RULE markers: '||array_to_string(markers, ', ')
 when b = p then 'No clear patterns matched, defaulting to pipeline_code'
 when p = 0 then 'Matches '||b||' business logic patterns'
 when b = 0 then 'Matches '||p||' pipeline code patterns'
 when b > p then 'Matches '||b||' business logic patterns vs '||p||' pipeline patterns'
 else 'Matches '||p||' pipeline patterns vs '||b||' business logic patterns' end"""
_RESULT = f"{_LABEL} as classification, {_CONFIDENCE} as confidence, {_REASON} as reason"

_COMMON = "kind, file_path, ordinal, name, description, markers, source_code"


def _labelled(source: str, columns: str, name: str = "labelled") -> str:
    return f"{name} as (select *, {_RESULT} from ({_scored(source, columns)}))"


def _corpus(
    sql_files: str = BY_CUSTOMER, functions: str | None = None, embedded: str | None = None
) -> str:
    """CTEs up to ``units``: all three corpora under common columns."""
    return f"""with {_statements(sql_files)}, {functions or _functions()}, {embedded or _embedded()},
units as (
  select {_COMMON}, start_line, null as sql_type from py_units
  union all by name select {_COMMON}, start_line, sql_type from sql_units
  union all by name select {_COMMON}, start_line, sql_type from embedded_units)"""


LABELLED = f"{_corpus()}, {_labelled('units', '*')}"

# one statement per order, known from the key
_ORDER_NAME = """case when o_orderkey%10=5 then 'v_' when o_orderkey%10=7 then 'p_' else 'q_' end
 || o_orderkey"""
_ORDER_TYPE = """case when o_orderkey%10=5 then 'view' when o_orderkey%10=7 then 'procedure'
 else 'query' end"""
_ORDER_COMMENTED = "o_orderkey%10 not in (5, 7)"
_ORDER_DESCRIPTION = (
    f"case when {_ORDER_COMMENTED} then 'name: q_'||o_orderkey||' '||o_orderpriority end"
)
_ORDER_MARKED = f"({_ORDER_COMMENTED} and o_orderkey%3=0)"
_ORDER_PATH = "'sql/o'||o_orderkey||'.sql'"
_LAST_COLUMN = """case o_orderkey%4 when 0 then 'threshold' when 1 then 'kpi_limit' when 2 then 'v'
 else 'to_csv' end"""


def _order_units(text: str, rows: str, relabel: str = "false", name: str = "v") -> str:
    """CTE of labelled units of one file per order."""
    flip = f"""case when relabel = ({_LABEL} = 'business_logic') then 'pipeline_code'
      else 'business_logic' end"""
    return f"""{name} as (
  select *, {flip} as classification, md5(source_code) as hash from ({_scored(f'''(
    select *, {_ORDER_PATH} as file_path, {_ORDER_NAME} as name, {relabel} as relabel,
      {_ORDER_DESCRIPTION} as description, rtrim({text}, {NL}) as source_code,
      case when {_ORDER_MARKED} then ['cap '||(o_orderkey%50)] else [] end as markers
    from {rows})''', '*')}))"""


_VERSIONS = "with " + ", ".join(
    _order_units(
        C.VERSION_TEXT[v],
        f"(select * from orders where {C.VERSION_ROWS[v]})",
        C.VERSION_RELABEL[v],
        f"v{v}",
    )
    for v in (1, 2)
)


def _joined_changes(more: str = "", using: str = "file_path, name") -> str:
    """One row per unit and change of ``v1`` against ``v2``, from a full join."""
    return f"""
joined as (
  select 'sql' as kind, {using}, v1.hash as prev_hash, v2.hash as curr_hash{more},
    v1.classification as c1, v2.classification as c2
  from v1 full join v2 using ({using})),
changed as (
  select *, unnest(case when prev_hash is null then ['added'] when curr_hash is null then ['removed']
    else list_filter([case when prev_hash <> curr_hash then 'modified' end,
      case when c1 <> c2 then 'reclassified' end], lambda c: c is not null) end) as change
  from joined)"""


CHANGED = f"{_VERSIONS}, {_joined_changes()}"

# --- documents ----------------------------------------------------------------------------------

_DOCUMENTS = """(select doc_id, source as name, text as source_code, lang as description,
  []::varchar[] as markers from documents)"""
_DOC_SCORES = f"docs as ({_scored(_DOCUMENTS, '*')})"
_REQUEST = f"""concat_ws({NL},
  'Decide whether this code unit is ''business_logic'' or ''pipeline_code''.',
  'business_logic: rules, thresholds, validation, scores and status values.',
  'pipeline_code: reading, writing or moving data, connections and set-up.',
  '', 'Function: '||name, 'Description: '||description, '', 'Source Code:', '```',
  source_code,
  '```', '', 'Answer with JSON only, in this form:',
  '{{"classification": "business_logic" or "pipeline_code", "reason": "brief explanation"}}')"""

# --- reports --------------------------------------------------------------------------------------

_CATEGORY = """case classification when 'business_logic' then 'business-logic'
 else 'pipeline-code' end"""
_MD = r"regexp_replace(replace(file_path, '/', '-'), '\.(py|sql)$', '.md')"
_BASE = "string_split(file_path, '/')[-1]"


def _page(units: str, section: str) -> str:
    """Header and chunk rows; ``section`` is the text of one unit."""
    return f"""
sections as (select {_CATEGORY} as category, file_path, ordinal, {section} as section from {units}),
page_rows as (
  select category, file_path, (ordinal // 1000) as chunk,
    string_agg(section, {NL} order by ordinal) as body from sections group by all
  union all
  select distinct category, file_path, -1,
    '# '||{_BASE}||{NL}||{NL}||'**File:** `'||file_path||'`'||{NL}||{NL}||'---' from sections)
select category, file_path, {_MD} as md_path, chunk::integer as chunk, md5(body) as body_md5
from page_rows"""


_RULES = f"""case when len(markers) > 0 then '### Business Rules'||{NL}||'- '
  ||array_to_string(markers, {NL}||'- ')||{NL} end"""
_DESCRIBED = f"""case when coalesce(description, '') <> ''
  then '### Description'||{NL}||description||{NL} end"""
_VERDICT = "'*Classification: '||classification||' ('||confidence||' confidence)*'"
_FUNCTION_SECTION = f"""concat_ws({NL}, '', '## '||name, '',
  '[View Source]({REPO_URL}/blob/main/'||file_path||'#L'||start_line||'-L'||end_line||')'||{NL},
  '### Signature', '```python', signature, '```', '', {_DESCRIBED}, {_RULES},
  '### Parameters', '| Name | Type | Default |', '|------|------|---------|',
  '| `a` | int | - |', '| `b` | - | '||p_size||' |', '| `c` | str | "x" |', '',
  case when return_type is not null then '### Returns'||{NL}||'- `'||return_type||'`'||{NL} end,
  case when decorator is not null then '### Decorators'||{NL}||'- `'||decorator||'`'||{NL} end,
  {_VERDICT}, '*Reason: '||reason||'*', '', '---')"""
_SQL_SECTION = f"""concat_ws({NL}, '', '## '||name, '', '**Type:** '||sql_type, '',
  {_DESCRIBED}, {_RULES},
  case when len(tables) > 0 then '### Tables Referenced'||{NL}||'- `'
    ||array_to_string(list_reduce(tables, lambda acc, x: case when list_contains(acc, x) then acc
       else list_append(acc, x) end, []::varchar[]), '`'||{NL}||'- `')||'`'||{NL} end,
  '### Source', '```sql', source_code, '```', '', {_VERDICT}, '', '---')"""

_N = "(select count(*) from labelled where kind = '{kind}' and classification = '{label}')"


def _n(label: str, kind: str) -> str:
    return _N.format(kind=kind, label=label)


_INDEX = f"""
, found as (select *, {_CATEGORY} as category, case kind when 'sql' then 4 else 2 end as part
  from labelled),
file_list as (select distinct category, part, file_path from found),
heads as (""" + " union all ".join(
    f"""select '{folder}' as category, x.part, x.ordinal, x.line from (values
   (0, 0, '# {title} Documentation'), (0, 1, ''),
   (0, 2, 'This directory contains auto-generated documentation for {title.lower()} functions.'),
   (0, 3, ''), (0, 4, '## Summary'),
   (0, 5, '- **Python Functions:** '||{_n(label, "function")}),
   (0, 6, '- **SQL Blocks:** '||{_n(label, "sql")}), (0, 7, ''),
   (1, 0, '## Python Functions'), (1, 1, ''), (3, 0, '## SQL'), (3, 1, '')) x(part, ordinal, line)
   where part = 0 or (part = 1 and {_n(label, "function")} > 0)
     or (part = 3 and {_n(label, "sql")} > 0)"""
    for label, folder, title in (
        ("business_logic", "business-logic", "Business Logic"),
        ("pipeline_code", "pipeline-code", "Pipeline Code"),
    )
) + f""")
select category, part::integer as part, '' as file_path, ordinal::integer as ordinal, line from heads
union all select category, part, file_path, -1, '### ['||{_BASE}||'](./'||{_MD}||')' from file_list
union all select category, part, file_path, 2147483647, '' from file_list
union all select category, part, file_path, ordinal::integer,
  '- `'||name||'`'||case when kind = 'sql' then ' ('||sql_type||')' else '' end from found"""

_LINKS = f"""
links as (
  select {_CATEGORY} as category, file_path, name,
    coalesce(nullif(string_split(description, {NL})[1], ''), 'No description') as summary,
    row_number() over (partition by classification order by file_path, ordinal) as rank
  from labelled where kind = 'function'),
link_lines as (
  select category, rank::integer as rank,
    '- [`'||name||'`](./'||category||'/'||{_MD}||'#'||lower(name)||') - '||summary as line
  from links where rank <= 10
  union all
  select category, 11, '- ... and '||(count(*) - 10)||' more' from links
  group by category having count(*) > 10)"""


def _overview_lines() -> str:
    b, p = "business_logic", "pipeline_code"
    texts = [
        "'# Business Logic Documentation Index'", "''",
        "'Auto-generated documentation extracted from source code.'", "''",
        f"'**Generated:** {GENERATED}'", "''", "'## Overview'", "''",
        "'| Category | Python Functions | SQL Blocks |'",
        "'|----------|------------------|------------|'",
        f"'| [Business Logic](./business-logic/) | '||{_n(b, 'function')}||' | '||{_n(b, 'sql')}||' |'",
        f"'| [Pipeline Code](./pipeline-code/) | '||{_n(p, 'function')}||' | '||{_n(p, 'sql')}||' |'",
        "'| **Total** | **'||(select count(*) from labelled where kind = 'function')||'** | **'"
        "||(select count(*) from labelled where kind = 'sql')||'** |'",
        "''", "'## Quick Links'", "''",
    ]
    rows = [(0, i, t) for i, t in enumerate(texts)]
    for part, title in ((1, "Business Logic"), (2, "Pipeline Code")):
        rows += [(part, -2, f"'### {title}'"), (part, -1, "''"), (part, 2147483647, "''")]
    values = ", ".join(f"({a}, {b}, {t})" for a, b, t in rows)
    return f"""{LABELLED}, {_LINKS}
select part::integer as part, ordinal::integer as ordinal, line
from (values {values}) x(part, ordinal, line)
union all
select case category when 'business-logic' then 1 else 2 end, rank, line from link_lines"""


# --- change report -----------------------------------------------------------------------------

_REPORT_SECTIONS = {
    2: ("Added SQL Blocks", "added"),
    4: ("Removed SQL Blocks", "removed"),
    6: ("Modified SQL Blocks", "modified"),
    7: ("Reclassified Items", "reclassified"),
}
_REPORT_HEAD = [
    "'# Documentation Changes Report'", "''", f"'**Generated:** {GENERATED}'", "''",
    "'## Summary'", "''",
    *[
        f"'- {mark}: '||(select count(*) from changed where change = '{c}')"
        for c, mark in (
            ("added", "➕ Added"),
            ("removed", "➖ Removed"),
            ("modified", "✏️ Modified"),
            ("reclassified", "🔄 Reclassified"),
        )
    ],
    "''",
]
_REPORT_ROWS = [(0, "''", i, t, "true") for i, t in enumerate(_REPORT_HEAD)]
for _at, (_title, _change) in _REPORT_SECTIONS.items():
    _some = f"exists (select 1 from changed where change = '{_change}')"
    _REPORT_ROWS += [
        (_at, "''", 0, f"'## {_title}'", _some),
        (_at, "''", 1, "''", _some),
        (_at, "'~'", 2147483647, "''", _some),
    ]
CHANGE_REPORT = f"""{CHANGED}
select section::integer as section, kind, '' as file_path, position::integer as position,
  '' as name, line
from (values {", ".join(f"({a}, {b}, {c}, {d}, {e})" for a, b, c, d, e in _REPORT_ROWS)})
  x(section, kind, position, line, present) where present
union all
select case change when 'added' then 2 when 'removed' then 4 when 'modified' then 6 else 7 end,
  kind, file_path, 0, name, '- `'||name||case change
    when 'added' then '` in `'||file_path||'` ('||c2||')'
    when 'removed' then '` from `'||file_path||'`'
    when 'modified' then '` in `'||file_path||'`'
    else '` in `'||file_path||'`: '||c1||' → '||c2 end
from changed"""

# --- events --------------------------------------------------------------------------------------

_PUSH_ADMISSION = f"""
with e as (
  select event_id, user_id, {C.EVENT_NAME} as event, {C.EVENT_METHOD} as method,
    {C.EVENT_URL} as url, {C.EVENT_BODY} as body from events),
s as (
  select *, case when method <> 'POST' then 405 when url = '/x' then 404
    when event_id%29=0 or event_id%13=0 then 401 when not json_valid(body) then 400
    else 200 end as status from e),
f as (
  select *, event = 'push' and status = 200 as push,
    event = 'repository_dispatch' and status = 200 as dispatch,
    case when status = 200 then body else '{{}}' end as j from s),
r as (
  select event_id, status, push, dispatch,
    case when push then coalesce(nullif(json_extract_string(j, '$.ref'), ''), 'refs/heads/main')
      when dispatch then coalesce(nullif(json_extract_string(j, '$.client_payload.ref'), ''), 'main')
      end as ref,
    case when push then coalesce(nullif(json_extract_string(j, '$.head_commit.id'), ''), 'unknown')
      when dispatch then coalesce(nullif(json_extract_string(j, '$.client_payload.commit_sha'), ''),
        'unknown') end as "commit",
    case when push then coalesce(nullif(json_extract_string(j, '$.head_commit.message'), ''),
        'No message')
      when dispatch then coalesce(nullif(json_extract_string(j, '$.client_payload.commit_message'),
        ''), 'Dispatch trigger') end as message
  from f)
select event_id, status::integer as status,
  case when dispatch or (push and ref in ('refs/heads/main', 'refs/heads/master')) then 'run'
    when status = 200 then 'ignore' end as action, ref, "commit", message
from r"""

_PUSH_RUNS = f"""
with {_order_units(C.COMMIT_TEXT, "(select *, unnest([0, 1]) as age from orders)", name="v")},
trees as (select *, year(o_orderdate) + age as y from v),
runs as (select distinct y from trees),
pairs as (select y, lag(y) over (order by y) as before from runs),
v2 as (select file_path, name, hash, classification, y from trees),
v1 as (select t.file_path, t.name, t.hash, t.classification, pairs.y
  from trees t join pairs on t.y = pairs.before),
{_joined_changes(using="file_path, name, y")}
select 'y'||y as run_id, 'units' as what, classification as item, count(*) as n from trees group by all
union all
select 'y'||y, 'changes', change, count(*) from changed group by all"""

_TREE = _corpus(
    _joined("orders", _tree_path("orders", "o_orderkey"), C.SQL_TEXT, "o_orderkey"),
    _functions(_tree_path("part", "p_partkey")),
    _embedded(_tree_path("supplier", "s_suppkey")),
)

# --- all -----------------------------------------------------------------------------------------

ORACLES: dict[str, str] = {
    "sql_statements": f"""with {_statements(BY_CUSTOMER)}
select file_path, ordinal::integer as ordinal, start_line::integer as start_line,
  end_line::integer as end_line, md5(source_code) as text_md5 from sql_units""",
    "sql_statement_types": f"""
select {_ORDER_PATH} as file_path, {_ORDER_TYPE} as sql_type, {_ORDER_NAME} as name from orders""",
    "sql_descriptions": f"""
select {_ORDER_PATH} as file_path, {_ORDER_DESCRIPTION} as description from orders""",
    "sql_rule_markers": f"""
select {_ORDER_PATH} as file_path, 'cap '||(o_orderkey%50) as marker from orders
where {_ORDER_MARKED}""",
    "sql_table_usage": """
select table_name, count(*) as n from (
  select 'orders_'||(o_orderkey%7) as table_name from orders
  union all select 'dim.t'||(o_orderkey%4) from orders
  union all select 'dim.sink'||(o_orderkey%3) from orders where o_orderkey%5=1) group by 1""",
    "sql_output_columns": f"""
select {_ORDER_PATH} as file_path, 'k|'||{_LAST_COLUMN} as columns from orders""",
    "embedded_sql_blocks": f"""with {_embedded()}
select file_path, ordinal::integer as ordinal, name, start_line::integer as start_line,
  end_line::integer as end_line, source_code, tables from embedded_units""",
    "py_functions": f"""with {_functions()}
select file_path, ordinal::integer as ordinal, name, start_line::integer as start_line,
  end_line::integer as end_line, signature, return_type, coalesce(decorator, '') as decorators,
  md5(source_code) as text_md5 from py_units""",
    "py_parameters": f"""with {_functions()}
select file_path, ordinal::integer as ordinal, position::integer as position, parameter, type,
  default_value from (
  select file_path, ordinal, 0 as position, 'a' as parameter, 'int' as type,
    null as default_value from py_units
  union all select file_path, ordinal, 1, 'b', null, p_size::varchar from py_units
  union all select file_path, ordinal, 2, 'c', 'str', '"x"' from py_units)""",
    "py_docs_and_markers": f"""with {_functions()}
select file_path, ordinal::integer as ordinal, description as docstring,
  array_to_string(markers, '|') as markers from py_units""",
    "unit_scores": f"""{_corpus()}
select kind, file_path, ordinal::integer as ordinal, b::integer as business_score,
  p::integer as pipeline_score from ({_scored("units", "*")})""",
    "unit_labels": f"""{LABELLED}
select kind, file_path, ordinal::integer as ordinal, name, classification, confidence, reason
from labelled""",
    "document_labels": f"""with {_DOC_SCORES} select doc_id, {_RESULT} from docs""",
    "label_counts": f"""{LABELLED}
select kind, classification, count(*) as n from labelled group by all""",
    "ambiguous_requests": f"""with {_DOC_SCORES}
select doc_id, md5({_REQUEST}) as request_md5 from docs where b = p""",
    "asked_labels": f"""with {_DOC_SCORES},
q as (select *, length({_REQUEST}) as n from docs)
select doc_id,
  case when b = p and n%7<>0 and n%5<>0 then
    case when n%2=0 then 'business_logic' else 'pipeline_code' end else {_LABEL} end
    as classification,
  case when b = p and n%7<>0 and n%5<>0 then 'medium' else {_CONFIDENCE} end as confidence,
  case when b = p and n%7<>0 and n%5<>0 then 'AI: length '||n
    when b = p and n%7<>0 then 'AI classification failed, defaulting to pipeline_code'
    else {_REASON} end as reason
from q""",
    "parsed_answers": """
select doc_id,
  case when usable and quality = 1 then 'business_logic' else 'pipeline_code' end as classification,
  case when usable then 'medium' else 'low' end as confidence,
  case when usable then 'AI: r'||doc_id
    else 'AI classification failed, defaulting to pipeline_code' end as reason
from (select *, doc_id%5<>0 and doc_id%7<>0 and doc_id%11<>0 as usable from labels)""",
    "snapshot_rows": f"""with {_statements(BY_CUSTOMER)}, {_labelled("sql_units", "*")},
ranked as (
  select *, row_number() over (partition by file_path, name order by ordinal desc) as last,
    min(ordinal) over (partition by file_path, name) as position from labelled)
select 'run1' as run_id, 'c1' as "commit", kind, file_path, name, ordinal::integer as ordinal,
  position::integer as position, sql_type, classification, md5(source_code) as hash
from ranked where last = 1""",
    "changes": f"""{CHANGED}
select kind, file_path, name, change, prev_hash, curr_hash,
  case when change = 'reclassified' then c1 end as from_class,
  case when change = 'reclassified' then c2 end as to_class, 0::integer as position from changed""",
    "change_counts": f"""{CHANGED}
select c.change, count(changed.change) as n
from (values ('added'), ('removed'), ('modified'), ('reclassified')) c(change)
left join changed using (change) group by 1""",
    "change_report": CHANGE_REPORT,
    "function_pages": f"""with {_functions()}, {_labelled("py_units", "*")},
{_page("labelled", _FUNCTION_SECTION)}""",
    "sql_pages": f"""with {_statements(BY_CUSTOMER)}, {_labelled("sql_units", "*")},
{_page("labelled", _SQL_SECTION)}""",
    "category_index": f"{LABELLED}{_INDEX}",
    "overview": f"""{LABELLED}
select coalesce({_CATEGORY.replace("else 'pipeline-code'", "when 'pipeline_code' then 'pipeline-code'")}, 'total')
  as category,
  count(*) filter (where kind = 'function') as functions,
  count(*) filter (where kind = 'sql') as sql_blocks
from labelled group by rollup(classification)""",
    "quick_links": f"""{LABELLED}, {_LINKS} select category, rank, line from link_lines""",
    "overview_page": _overview_lines(),
    "push_admission": _PUSH_ADMISSION,
    "push_stream_runs": _PUSH_RUNS,
    "scan_roundtrip": f"""{_TREE}
select kind, file_path, ordinal::integer as ordinal, name, start_line::integer as start_line,
  md5(source_code) as text_md5 from units""",
}
def _written_docs() -> str:
    """Files of the docs tree: pages, category indexes and overview; one document per path."""
    header = f"""'# '||{_BASE}||{NL}||{NL}||'**File:** `'||file_path||'`'||{NL}||{NL}||'---'"""
    pages = f"""{_corpus()}, {_labelled("py_units", "*", "lab_py")}, {_labelled("sql_units", "*", "lab_sql")},
  {_labelled("embedded_units", "*", "lab_emb")},
sections as (
  select 0 as doc, {_CATEGORY} as category, file_path, ordinal, {_FUNCTION_SECTION} as section from lab_py
  union all select 1, {_CATEGORY}, file_path, ordinal, {_SQL_SECTION} from lab_sql
  union all select 1, {_CATEGORY}, file_path, ordinal, {_SQL_SECTION}
    from (select * replace ([tables] as tables) from lab_emb))
select doc, category||'/'||{_MD} as path, file_path, (ordinal // 1000)::bigint as a,
  string_agg(section, {NL} order by ordinal) as line from sections group by all
union all select distinct doc, category||'/'||{_MD}, file_path, -1::bigint, {header} from sections"""
    return f"""with pages as ({pages}),
readme as ({ORACLES["category_index"]}),
idx as ({ORACLES["overview_page"]}),
docs as (
  select path, doc, file_path, a, '' as b, 0::bigint as c, line from pages
  union all select category||'/README.md', 2, '', part::bigint, coalesce(file_path, ''), ordinal::bigint, line
    from readme
  union all select 'index.md', 3, '', part::bigint, '', ordinal::bigint, line from idx),
win as (
  select path, doc, file_path from (select distinct path, doc, file_path from docs)
  qualify row_number() over (partition by path order by doc desc, file_path desc) = 1),
content as (
  select path, string_agg(coalesce(line, '')||chr(10), '' order by a, b, c) as t
  from docs semi join win using (path, doc, file_path) group by path)
select path, (length(t) - length(replace(t, chr(10), '')))::bigint as n_lines, md5(t) as text_md5
from content"""


ORACLES["written_docs"] = _written_docs()
ORACLES["batch_history"] = f"""{_VERSIONS}
select run_id, classification, count(*) as n, sum(('0x'||substr(hash, 1, 7))::bigint) as hash_sum
from (select 'run1' as run_id, classification, hash from v1
  union all select 'run2', classification, hash from v2) group by all"""

ORACLES["first_run_changes"] = f"""select kind, file_path, name, 'added' as change, hash as curr_hash, position
from ({ORACLES["snapshot_rows"]})"""
