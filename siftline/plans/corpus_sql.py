"""SQL of the registered queries, for DuckDB over the same tables. Each text stands alone."""

from __future__ import annotations

DOCS = "docs AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text FROM documents)"
CODE = r"""
items AS (SELECT l_orderkey, l_partkey, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
calls AS (SELECT l_orderkey, string_agg('    part_' || l_partkey || '(' || q || ')', chr(10) ORDER BY n) AS body, arg_min(l_partkey, n) AS f FROM items GROUP BY 1),
code AS (
  SELECT 'orders/o_' || o_orderkey || '.py' AS path, 'from part_' || coalesce(f, 1) || ' import part_' || coalesce(f, 1) || chr(10) || '# ' || o_orderpriority || chr(10) || 'def order_' || o_orderkey || '():' || chr(10) || coalesce(body, '    return 0') || chr(10) AS text
  FROM orders LEFT JOIN calls ON o_orderkey = l_orderkey
  UNION ALL SELECT 'parts/part_' || p_partkey || '.py', 'def part_' || p_partkey || '(quantity):' || chr(10) || '    return quantity' || chr(10) FROM part
  UNION ALL SELECT 'reports/r_' || o_custkey || '.py', 'def report_' || o_custkey || '():' || chr(10) || string_agg('    order_' || o_orderkey || '()' || chr(10), '' ORDER BY o_orderkey) FROM orders GROUP BY o_custkey
)"""
TRIM = r"left(regexp_replace(raw, '^\s+|\s+$', '', 'g'), 500)"
SYMBOLS = r"symbols AS (SELECT path, line, regexp_extract(raw, '^(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)', 1) AS kind, regexp_extract(raw, '^(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)', 2) AS name, raw FROM lines WHERE regexp_matches(raw, '^(?:(?:async\s+)?def|class)\s+[A-Za-z_]'))"


def lines_of(corpus: str) -> str:
    return f"""pieces AS (SELECT path, string_split(text, chr(10)) AS p FROM {corpus}), whole AS (SELECT path, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM pieces),
lines AS (SELECT path, unnest(range(1, len(p) + 1))::INT AS line, rtrim(unnest(p), chr(13)) AS raw FROM whole)"""


def matches(pattern: str) -> str:
    """matches(path, line, col, text) of an RE2 expression in lines."""
    return f"""found AS (SELECT path, line, raw, regexp_split_to_array(raw, '{pattern}') AS q, regexp_extract_all(raw, '{pattern}') AS m FROM lines WHERE regexp_matches(raw, '{pattern}')),
spots AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
matches AS (SELECT path, line, (length(array_to_string(q[1:i], '')) + length(array_to_string(m[1:i - 1], '')) + 1)::INT AS col, {TRIM} AS text FROM spots)"""


def fuzzy(words: str) -> str:
    parts, ends = [], []
    for w in words.split():
        end = "length(regexp_extract(lower(path), '(?s)^" + "".join(f"[^{c}]*{c}" for c in w) + "'))"
        ends.append(f"{end} > 0")
        parts.append(f"2 * ({end} - {len(w)})")
    joined = "".join(words.split())
    base = "regexp_extract(lower(path), '[^/]*$')"
    bonus = f"CASE WHEN {base} = '{joined}' THEN 20 WHEN length({base}) >= {len(joined) + 2} AND substr({base}, {len(joined) + 1}, 1) = '.' AND length({base}) - length(replace({base}, '.', '')) = 1 THEN 10 ELSE 0 END"
    return f"SELECT path, ({' + '.join(parts)} - {bonus})::INT AS score FROM docs WHERE {' AND '.join(ends)}"


def counts(words: list[str]) -> str:
    either = "|".join(words)
    sums = ", ".join(f"coalesce(sum((length(t) - length(replace(t, '{w}', ''))) // {len(w)}), 0)::BIGINT AS k{i}" for i, w in enumerate(words))
    return f"""hit AS (SELECT path, lower(raw) AS t FROM lines WHERE regexp_matches(raw, '(?i){either}')), counts AS (SELECT d.path, {sums} FROM docs d LEFT JOIN hit h ON d.path = h.path GROUP BY d.path),
idf AS (SELECT {", ".join(f"least(6.0, greatest(0.5, ln((count(*) + 1) / (count(*) FILTER (k{i} > 0) + 1)))) AS w{i}" for i in range(len(words)))} FROM counts)"""


QUESTION = """where "of the" tion hering stand"""
KEYWORDS = ["of the", "tion", "hering", "stand"]

_LEX = " + ".join(f"w{i} * (2 * contains(lower(path), '{w}')::INT + ln(1 + k{i}))" for i, w in enumerate(KEYWORDS))
_CALL = r"(^|[^\w$])part_1\s*\("
_RING1 = rf"""owned AS (SELECT l.path, l.line, l.raw, s.name AS owner FROM lines l ASOF LEFT JOIN symbols s ON l.path = s.path AND s.line <= l.line),
ring1 AS (SELECT path, line, CASE WHEN regexp_matches(raw, '{_CALL}') THEN strpos(raw, 'part_1') ELSE 1 END::INT AS col, trim(raw) AS text, owner FROM owned
  WHERE NOT regexp_matches(raw, '^\s*def\s') AND (regexp_matches(raw, '{_CALL}') OR regexp_matches(raw, '(import|from)\b.*[^\w$]part_1([^\w$]|$)')))"""

# Units are lines, or pieces of a line that is too long, which stand alone. A window ends with the last unit whose running size still fits, or with its first;
# windows follow each other by recursion.
def _passages(size: int) -> str:
    return f"""sized AS (SELECT path, line, raw, 'L' || line || '| ' AS lead, strlen(raw) + strlen('L' || line || '| ') + 1 AS need FROM lines),
cut AS (SELECT path, line, lead, need, 0 AS k, ''::VARCHAR AS piece, raw AS rest FROM sized WHERE need > {size}
  UNION ALL SELECT path, line, lead, need, k + 1, left(rest, fit), substr(rest, fit + 1) FROM (SELECT *, list_max(list_filter(range(0, {size + 1}), lambda n: strlen(left(rest, n)) <= {size - 1} - strlen(lead)))::INT AS fit FROM cut WHERE rest <> '')),
units AS (SELECT path, line, 0 AS k, lead || raw || chr(10) AS piece, need FROM sized WHERE need <= {size} UNION ALL SELECT path, line, k, lead || piece || chr(10), {size + 1} FROM cut WHERE k > 0),
ends AS (SELECT *, row_number() OVER w AS u, sum(need) OVER w AS c FROM units WINDOW w AS (PARTITION BY path ORDER BY line, k)),
nexts AS (SELECT a.path, a.u AS start, greatest(a.u, b.u) AS stop FROM ends a ASOF LEFT JOIN ends b ON a.path = b.path AND a.c - a.need + {size} >= b.c),
windows AS (SELECT path, start, stop FROM nexts WHERE start = 1 UNION ALL SELECT n.path, n.start, n.stop FROM windows w JOIN nexts n ON n.path = w.path AND n.start = w.stop + 1),
texts AS (SELECT w.path, w.start AS u, min(line) AS start, max(line) AS stop, string_agg(piece, '' ORDER BY e.u) AS text FROM windows w JOIN ends e ON e.path = w.path AND e.u BETWEEN w.start AND w.stop GROUP BY w.path, w.start),
passages AS (SELECT path, start::INT AS start, stop::INT AS stop, text, {" + ".join(f"w{i} * ln(1 + (length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)})" for i, w in enumerate(KEYWORDS))} AS score FROM texts, idf)"""


_PASSAGES = _passages(1024)
_TRACK = r"(?:^|[^\w$])track\s*\("



def _xxh32() -> str:
    """SQL of content tags: XXH32 (seed 0) of plain(path, text), by stripes of 16 bytes, then words of four, then bytes."""
    p1, p2, p3, p4, p5 = (f"{x}::UBIGINT" for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    top = "4294967296::UBIGINT"
    mul = lambda a, b: f"((({a}) * {b}) % {top})"
    add = lambda a, b: f"((({a}) + ({b})) % {top})"
    turn = lambda a, n: f"((({a}) * {1 << n}) % {top} + ({a}) // {1 << (32 - n)})"
    word = lambda at: f"('0x' || substr(h, {at} + 6, 2) || substr(h, {at} + 4, 2) || substr(h, {at} + 2, 2) || substr(h, {at}, 2))::UBIGINT"
    lane = lambda k, start: f"list_reduce(list_prepend({start}, [{word(f'32 * i + {8 * k + 1}')} FOR i IN range(n // 16)]), lambda v, x: {mul(turn(add('v', mul('x', p2)), 13), p1)})"
    words = f"list_reduce(list_prepend(a, [{word('n // 16 * 32 + 8 * i + 1')} FOR i IN range(n % 16 // 4)]), lambda v, x: {mul(turn(add('v', mul('x', p3)), 17), p4)})"
    last = f"list_reduce(list_prepend(b, [('0x' || substr(h, n // 4 * 8 + 2 * i + 1, 2))::UBIGINT FOR i IN range(n % 4)]), lambda v, x: {mul(turn(add('v', mul('x', p5)), 11), p1)})"
    starts = ("(2654435761 + 2246822519 - 4294967296)::UBIGINT", p2, "0::UBIGINT", "(4294967296 - 2654435761)::UBIGINT")
    lanes = ", ".join(f"{lane(k, s)} AS v{k}" for k, s in enumerate(starts))
    whole = add(add(turn("v0", 1), turn("v1", 7)), add(turn("v2", 12), turn("v3", 18)))
    mixes = [mul(f"xor({x}, {x} // {1 << n})", p) for x, n, p in (("c", 15, p2), ("d", 13, p3))]
    return f"""bytes AS (SELECT path, hex(encode(text)) AS h, strlen(text) AS n FROM plain), lanes AS (SELECT *, {lanes} FROM bytes), a AS (SELECT *, {add(f"CASE WHEN n >= 16 THEN {whole} ELSE {p5} END", "n::UBIGINT")} AS a FROM lanes),
b AS (SELECT *, {words} AS b FROM a), c AS (SELECT *, {last} AS c FROM b), d AS (SELECT path, {mixes[0]} AS d FROM c), e AS (SELECT path, {mixes[1]} AS e FROM d)
SELECT path, right('0000' || hex(xor(e, e // 65536) % 65536), 4) AS tag FROM e UNION ALL SELECT path, NULL FROM docs WHERE text IS NULL"""


#: The judge of lengths (see queries.length_judge): names, then windows; sketches all pass.
_CASCADE = f"""WITH RECURSIVE {DOCS.replace("FROM documents", "FROM documents WHERE text <> ''")}, {lines_of("docs")}, {counts(KEYWORDS)},
lexed AS (SELECT path, {_LEX} AS lex FROM counts, idf), named AS (SELECT path, lex, row_number() OVER (ORDER BY lex DESC, path) AS place FROM lexed QUALIFY place <= 128),
chosen AS (SELECT path FROM named ORDER BY place > 2, CASE WHEN length(path) % 7 <> 0 THEN length(path) % 10 / 9 ELSE 0 END DESC, place LIMIT 20),
{_passages(8192).replace("FROM lines)", "FROM lines WHERE path IN (SELECT path FROM chosen))", 1)},
ranked AS (SELECT *, count(*) OVER (PARTITION BY path) AS n, max(score) OVER (PARTITION BY path) AS best, row_number() OVER (PARTITION BY path ORDER BY start, text) - 1 AS place, row_number() OVER (PARTITION BY path ORDER BY score DESC, start, text) AS rank FROM passages),
picked AS (SELECT path, start, stop, text, score FROM ranked WHERE n <= 24 OR CASE WHEN best = 0 THEN place IN (SELECT k * (n - 1) // 23 FROM range(24) AS r(k)) ELSE rank <= 24 END),
seen AS (SELECT path, start, stop, length(text) % 10 / 9 AS p FROM (SELECT * FROM picked ORDER BY score DESC, path, start LIMIT 40) WHERE length(text) % 7 <> 0),
k AS (SELECT path, start, stop, max(p) AS p FROM seen WHERE p >= 0.2 GROUP BY ALL),
f AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM k),
total AS (SELECT path, count(*) AS n_lines FROM lines GROUP BY path), looked AS (SELECT path, sum(stop - start + 1)::BIGINT AS lines_seen FROM seen GROUP BY path)
SELECT f.path, round(max(p), 6) AS score, sum(fresh)::INT AS n_ranges, any_value(lines_seen) AS lines_seen, any_value(lines_seen) < any_value(n_lines) AS truncated FROM f JOIN looked USING (path) JOIN total USING (path) GROUP BY f.path"""

ORACLE_SQL: dict[str, str] = {
    "cascade_of_lengths": _CASCADE,
    "content_tags": rf"WITH {DOCS}, plain AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(text, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g'), '(?m)[ \t\r]+$', '', 'g') AS text FROM docs WHERE text IS NOT NULL), {_xxh32()}",
    "find_fuzzy": f"WITH {DOCS} {fuzzy('src1 doc en')}",
    "find_filtered": rf"WITH {DOCS}, kept AS (SELECT * FROM docs WHERE (path = 'src1' OR starts_with(path, 'src1/')) AND regexp_matches(path, '(^|/)doc_[^/]*[13579]\.txt$') AND NOT (path = 'src1/de' OR starts_with(path, 'src1/de/')) AND NOT list_contains(string_split(path, '/'), 'fr')) {fuzzy('doc').replace('FROM docs', 'FROM kept')}",
    "find_dir_counts": f"WITH {DOCS}, f AS ({fuzzy('doc')}) SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n FROM f GROUP BY 1",
    "find_frecency": f"""WITH {DOCS}, o AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, ts FROM events JOIN documents ON user_id = doc_id), s AS (SELECT path, count(*) AS n, max(ts) AS last FROM o GROUP BY 1),
fre AS (SELECT path, n * pow(0.5, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last)) / 604800000000.0) AS f FROM s), fz AS ({fuzzy('doc')}) SELECT fz.path, score, round(coalesce(f, 0), 6) AS frecency FROM fz LEFT JOIN fre ON fz.path = fre.path""",
    "ignored_paths": rf"""WITH {DOCS} SELECT DISTINCT path FROM docs WHERE path IS NOT NULL AND (regexp_matches(path, '^[^/]*1/de/') OR CASE WHEN regexp_matches(path, '/doc_[^/]*117\.txt$') THEN true WHEN path LIKE '%17.txt' THEN false ELSE path LIKE '%7.txt' END)""",
    "bounded_reads": rf"""WITH {DOCS}, c AS (SELECT path, text, strlen(text) > 2048 AS long, list_max(list_filter(range(0, 2049), lambda k: strlen(left(text, k)) <= 2048))::INT AS fit FROM docs),
k AS (SELECT *, CASE WHEN NOT long THEN text WHEN contains(left(text, fit), chr(10)) THEN regexp_extract(left(text, fit), '(?s)^.*\n') END AS kept FROM c)
SELECT path, CASE WHEN text IS NULL THEN 'io' WHEN regexp_matches(coalesce(kept, text), '^\s*$') THEN 'empty' ELSE 'text' END AS status, CASE WHEN status = 'text' THEN coalesce(strlen(kept), 2048)::INT END AS bytes,
  (status = 'text' AND long) AS truncated, CASE WHEN status = 'text' THEN length(coalesce(kept, '')) - length(replace(coalesce(kept, ''), chr(10), '')) END::INT AS ends FROM k""",
    "folded_tree": """WITH f AS (SELECT DISTINCT 'all/' || source || '/by_lang/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), p AS (SELECT path, string_split(path, '/') AS s FROM f),
d AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS dir, k FROM (SELECT s, unnest(range(1, len(s)))::INT AS k FROM p)), kids AS (SELECT array_to_string(string_split(dir, '/')[1:k - 1], '/') AS dir, count(*) AS n FROM d GROUP BY 1),
own AS (SELECT array_to_string(s[1:len(s) - 1], '/') AS dir, count(*) AS n FROM p GROUP BY 1), shown AS (SELECT d.dir FROM d LEFT JOIN kids USING (dir) LEFT JOIN own USING (dir) WHERE own.n > 0 OR kids.n > 1),
placed AS (SELECT a.dir, count(b.dir) AS depth, max(length(b.dir)) AS taken FROM shown a LEFT JOIN shown b ON starts_with(a.dir, b.dir || '/') GROUP BY 1)
SELECT 'dir' AS kind, depth, substr(dir, coalesce(taken + 2, 1)) AS name, dir AS path FROM placed UNION ALL SELECT 'file', depth + 1, s[-1], path FROM p JOIN placed ON dir = array_to_string(s[1:len(s) - 1], '/')""",
    "grep_literal": f"WITH {DOCS}, {lines_of('docs')}, {matches('the th')} SELECT * FROM matches",
    "grep_regex": f"WITH {DOCS}, {lines_of('docs')}, {matches('[aeiou]{3}r+e')} SELECT * FROM matches",
    "grep_group_loop": f"WITH {DOCS}, {lines_of('docs')}, {matches('(?:th|er|en)+ing')} SELECT * FROM matches",
    "grep_two_gaps": f"WITH {DOCS}, {lines_of('docs')}, {matches('the.*ing.*and')} SELECT * FROM matches",
    "grep_word": rf"WITH {DOCS}, {lines_of('docs')}, {matches(r'\b(?:stand|der)\b')} SELECT * FROM matches",
    "grep_icase": f"WITH {DOCS}, {lines_of('docs')}, {matches('(?i)license')} SELECT * FROM matches",
    "grep_smartcase": f"WITH {DOCS}, {lines_of('docs')}, {matches('Und ')} SELECT * FROM matches",
    "grep_context": rf"""WITH {DOCS}, {lines_of('docs')}, {matches('(?i)license')}, c AS (SELECT path, line, string_agg({TRIM}, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, string_agg({TRIM}, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM lines)
SELECT m.path, m.line, m.col, m.text, coalesce(before, '') AS before, coalesce(after, '') AS after FROM matches m JOIN c ON m.path = c.path AND m.line = c.line""",
    "grep_file_counts": f"WITH {DOCS}, {lines_of('docs')}, {matches('the th')} SELECT path, count(*) AS n FROM matches GROUP BY 1",
    "grep_totals": f"WITH {DOCS}, {lines_of('docs')}, {matches('the th')} SELECT count(*) AS matches, count(DISTINCT path) AS files FROM matches",
    "grep_capped": f"WITH {DOCS}, {lines_of('docs')}, {matches('the th')} SELECT * FROM matches ORDER BY path, line, col LIMIT 1000",
    "grep_enclosing": f"WITH {CODE}, {lines_of('code')}, {SYMBOLS}, {matches('part_7')} SELECT m.path, m.line, m.col, m.text, s.kind || ' ' || s.name || ' ' || s.line AS enclosing FROM matches m ASOF LEFT JOIN symbols s ON m.path = s.path AND s.line <= m.line",
    "outline": f"WITH {CODE}, {lines_of('code')}, {SYMBOLS} SELECT path, line, strpos(raw, name)::INT AS col, kind, name FROM symbols",
    "outline_languages": """WITH s AS (
SELECT 'ts/part_' || p_partkey || '.ts' AS path, unnest([{'line': 3, 'col': 14, 'kind': 'class', 'name': 'Part_' || p_partkey}, {'line': 4, 'col': 3, 'kind': 'method', 'name': 'size'}, {'line': 7, 'col': 7, 'kind': 'const', 'name': 'make_' || p_partkey}]) AS x FROM part
UNION ALL SELECT 'go/supplier_' || s_suppkey || '.go', unnest([{'line': 2, 'col': 6, 'kind': 'type', 'name': 'Supplier_' || s_suppkey}, {'line': 3, 'col': 21 + length(s_suppkey::VARCHAR), 'kind': 'func', 'name': 'Name_' || s_suppkey}]) FROM supplier
UNION ALL SELECT 'c/supplier_' || s_suppkey || '.c', unnest([{'line': 2, 'col': 8, 'kind': 'struct', 'name': 'Box_' || s_suppkey}, {'line': 3, 'col': 5, 'kind': 'function', 'name': 'supplier_' || s_suppkey}]) FROM supplier
UNION ALL SELECT 'java/Customer_' || c_custkey || '.java', unnest([{'line': 2, 'col': 14, 'kind': 'class', 'name': 'Customer_' || c_custkey}, {'line': 3, 'col': 10, 'kind': 'ctor', 'name': 'Customer_' || c_custkey}, {'line': 4, 'col': 21, 'kind': 'method', 'name': 'total_' || c_custkey}]) FROM customer
UNION ALL SELECT 'rust/nation_' || n_nationkey || '.rs', unnest([{'line': 2, 'col': 12, 'kind': 'struct', 'name': 'Nation_' || n_nationkey}, {'line': 3, 'col': 6, 'kind': 'impl', 'name': 'Nation_' || n_nationkey}, {'line': 4, 'col': 14, 'kind': 'fn', 'name': 'of_' || n_nationkey}]) FROM nation
UNION ALL SELECT 'doc/region_' || r_regionkey || '.md', unnest([{'line': 1, 'col': 3, 'kind': 'heading', 'name': 'Region_' || r_regionkey}, {'line': 2, 'col': 3, 'kind': 'list', 'name': 'item_' || r_regionkey}]) FROM region)
SELECT path, x.line::INT AS line, x.col::INT AS col, x.kind AS kind, x.name AS name FROM s""",
    "import_forms": """WITH files AS (SELECT 'ts/part_' || p_partkey || '.ts' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'part_1' ELSE 'part_2' END AS key FROM part UNION ALL SELECT 'go/supplier_' || s_suppkey || '.go', NULL FROM supplier UNION ALL SELECT 'c/supplier_' || s_suppkey || '.c', 'supplier_1' FROM supplier
UNION ALL SELECT 'java/Customer_' || c_custkey || '.java', NULL FROM customer UNION ALL SELECT 'rust/nation_' || n_nationkey || '.rs', 'nation_1' FROM nation UNION ALL SELECT 'doc/region_' || r_regionkey || '.md', NULL FROM region),
n AS (SELECT key, count(*) AS n FROM files WHERE key IS NOT NULL GROUP BY key), own AS (SELECT *, lower(regexp_extract(path, '([^/]*)[.][a-z]*$', 1)) AS name FROM files)
SELECT path, coalesce(n, 0) - CASE WHEN own.key = name THEN 1 ELSE 0 END AS in_degree FROM own LEFT JOIN n ON n.key = name""",
    "capsule_documented": "SELECT 'definition' AS part, 'ts/part_1.ts' AS path, 3 AS line, 1 AS col, 'class' || chr(10) || '/** Part 1. */' AS text FROM part WHERE p_partkey = 1",
    "outline_kind_counts": f"WITH {CODE}, {lines_of('code')}, {SYMBOLS} SELECT kind, count(*) AS n FROM symbols GROUP BY 1",
    "callers_d1": f"WITH {CODE}, {lines_of('code')}, {SYMBOLS}, {_RING1} SELECT path, line, col, text, 1 AS depth, 'part_1' AS via FROM ring1",
    "callers_d2": rf"""WITH {CODE}, {lines_of('code')}, {SYMBOLS}, {_RING1} SELECT path, line, col, text, 1 AS depth, 'part_1' AS via FROM ring1
UNION ALL SELECT path, line, 5 AS col, trim(raw) AS text, 2 AS depth, regexp_extract(raw, '(order_\d+)\(', 1) AS via FROM lines WHERE NOT regexp_matches(raw, '^def ') AND regexp_extract(raw, '(order_\d+)\(', 1) IN (SELECT owner FROM ring1 WHERE owner IS NOT NULL)""",
    "callers_certainty": f"WITH {CODE}, {lines_of('code')}, {SYMBOLS}, {_RING1} SELECT path, line, 'exact' AS certainty FROM ring1",
    "callers_pages": rf"""WITH docs AS (SELECT 'pages/' || page_id || '.html' AS path, html AS text FROM pages), {lines_of('docs')}
SELECT path, line, (length(regexp_extract(raw, '^(.*?){_TRACK}', 1)) + CASE WHEN regexp_matches(raw, '^track\s*\(') THEN 1 ELSE 2 END)::INT AS col, {TRIM} AS text, 1 AS depth, 'track' AS via FROM lines
WHERE regexp_matches(raw, '{_TRACK}') AND NOT regexp_matches(raw, '^\s*(?:function|def|fn|func|class)\b')""",
    "structural_call": rf"WITH {CODE}, {lines_of('code')} SELECT path, line, (length(regexp_extract(raw, '^(.*?)\b[A-Za-z_$][\w$]*\s*\(', 1)) + 1)::INT AS col, trim(raw) AS text FROM lines WHERE regexp_matches(raw, '\b[A-Za-z_$][\w$]*\s*\(') AND NOT regexp_matches(raw, '^\s*def\s')",
    "structural_symbol": rf"WITH {CODE}, {lines_of('code')} SELECT path, line, 1 AS col, raw AS text FROM lines WHERE regexp_matches(raw, '^def order_7\b')",
    "structural_inside": rf"WITH {CODE}, {lines_of('code')} SELECT path, line, 1 AS col, raw AS text FROM lines WHERE regexp_matches(raw, '^def\b') AND path IN (SELECT path FROM lines WHERE contains(raw, 'from part_1 import part_1'))",
    "structural_has": rf"WITH {CODE}, {lines_of('code')} SELECT path, line, 1 AS col, raw AS text FROM lines WHERE regexp_matches(raw, '^from\b') AND path IN (SELECT path FROM lines WHERE contains(raw, 'return 0'))",
    "structural_backref": rf"WITH {CODE}, {lines_of('code')} SELECT path, line, 1 AS col, raw AS text FROM lines WHERE starts_with(raw, 'from ') AND split_part(raw, ' ', 2) = split_part(raw, ' ', 4)",
    "rewrite_preview": rf"WITH {CODE}, {lines_of('code')} SELECT path, line, 1 AS col, raw AS text, 'import ' || split_part(raw, ' ', 2) || '.' || split_part(raw, ' ', 4) AS rewritten FROM lines WHERE regexp_matches(raw, '^from \w+ import \w+')",
    "module_in_degree": rf"WITH {CODE}, k AS (SELECT path, regexp_extract(text, '^from (\S+) import ', 1) AS spec FROM code), n AS (SELECT spec, count(DISTINCT path) AS n FROM k WHERE spec <> '' GROUP BY 1) SELECT c.path, coalesce(n, 0) AS in_degree FROM code c LEFT JOIN n ON regexp_extract(c.path, '([^/]*)\.py$', 1) = spec",
    "repo_map": rf"""WITH {CODE}, k AS (SELECT path, regexp_extract(text, '^from (\S+) import ', 1) AS spec FROM code), n AS (SELECT spec, count(DISTINCT path) AS n FROM k WHERE spec <> '' GROUP BY 1)
SELECT c.path, 'def ' || regexp_extract(text, '(?m)^def (\w+)', 1) AS symbols, coalesce(n, 0) AS in_degree, round(ln(1 + coalesce(n, 0)), 6) AS weight FROM code c LEFT JOIN n ON regexp_extract(c.path, '([^/]*)\.py$', 1) = spec""",
    "capsule": rf"""WITH {CODE}, {lines_of('code')}, {SYMBOLS}, {_RING1},
i AS (SELECT path, line, 1 AS col, raw AS text FROM lines WHERE regexp_matches(raw, '(import|from)\b.*\bpart_1\b') ORDER BY path, line LIMIT 10), c AS (SELECT path, line, col, text FROM ring1 ORDER BY path, line LIMIT 10)
SELECT 'definition' AS part, 'parts/part_1.py' AS path, 1 AS line, 1 AS col, 'def' AS text UNION ALL SELECT 'caller', * FROM c UNION ALL SELECT 'import', * FROM i""",
    "capsule_totals": rf"""WITH {CODE}, {lines_of('code')}, {SYMBOLS}, {_RING1}, r AS (SELECT 'caller' AS part, path FROM ring1 UNION ALL SELECT 'import', path FROM lines WHERE regexp_matches(raw, '(import|from)\b.*\bpart_1\b') UNION ALL SELECT 'definition', 'parts/part_1.py')
SELECT part, count(*) AS n, count(DISTINCT path) AS files FROM r WHERE part <> 'definition' GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT path) FROM r""",
    "map_fitting": rf"""WITH {CODE}, k AS (SELECT path, regexp_extract(text, '^from (\S+) import ', 1) AS spec FROM code), n AS (SELECT spec, count(DISTINCT path) AS n FROM k WHERE spec <> '' GROUP BY 1),
d AS (SELECT c.path, coalesce(n, 0) AS in_degree, length(c.path || ':  def ' || regexp_extract(text, '(?m)^def (\w+)', 1)) + 2 AS size FROM code c LEFT JOIN n ON regexp_extract(c.path, '([^/]*)\.py$', 1) = spec)
SELECT path, in_degree FROM (SELECT *, sum(size) OVER (ORDER BY in_degree DESC, path) - 1 AS upto FROM d) WHERE upto <= 8000""",
    "grep_later_page": f"WITH {DOCS}, {lines_of('docs')}, {matches('the th')} SELECT * FROM matches WHERE (path, line, col) > ('src1/en/doc_5', 1, 1) ORDER BY path, line, col LIMIT 50",
    "judged_names": f"""WITH {DOCS}, {lines_of('docs')}, {counts(KEYWORDS)}, l AS (SELECT path, round({_LEX}, 6) AS lex FROM counts, idf), r AS (SELECT path, row_number() OVER (ORDER BY lex DESC, path) - 1 AS place FROM l QUALIFY place < 128)
SELECT place // 64 AS request, format('e{{:03d}}', place % 64) AS key, path, CASE WHEN length(path) % 7 <> 0 AND length(path) % 10 <= 8 THEN (length(path) % 10) / 8 END AS p FROM r""",
    "lexical_counts": f"WITH {DOCS}, {lines_of('docs')}, {counts(KEYWORDS)} SELECT * FROM counts",
    "lexical_idf": f"WITH {DOCS}, {lines_of('docs')}, {counts(KEYWORDS)} " + " UNION ALL ".join(f"SELECT '{w}' AS keyword, round(w{i}, 9) AS weight FROM idf" for i, w in enumerate(KEYWORDS)),
    "lexical_rank": f"WITH {DOCS}, {lines_of('docs')}, {counts(KEYWORDS)} SELECT path, round({_LEX}, 6) AS lex FROM counts, idf",
    "passages": f"WITH RECURSIVE {DOCS}, {lines_of('docs')}, {counts(KEYWORDS)}, {_PASSAGES} SELECT * FROM passages",
    "select_windows": f"""WITH RECURSIVE {DOCS}, {lines_of('docs')}, {counts(KEYWORDS)}, {_PASSAGES},
ranked AS (SELECT *, count(*) OVER (PARTITION BY path) AS n, max(score) OVER (PARTITION BY path) AS best, row_number() OVER (PARTITION BY path ORDER BY start, text) - 1 AS place, row_number() OVER (PARTITION BY path ORDER BY score DESC, start, text) AS rank FROM passages)
SELECT path, start, stop, text, score FROM ranked WHERE n <= 3 OR CASE WHEN best = 0 THEN place IN (0, (n - 1) // 2, n - 1) ELSE rank <= 3 END""",
    "heat_merge": """WITH r AS (SELECT l_orderkey AS path, l_linenumber AS start, l_linenumber + (l_quantity::INT % 3) AS stop, l_discount * 10 AS p FROM lineitem), k AS (SELECT path, start, stop, max(p) AS p FROM r WHERE p >= 0.2 GROUP BY ALL),
f AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM k),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT path, min(start)::INT AS start, max(stop)::INT AS stop, round(max(p), 6) AS p FROM g GROUP BY path, island""",
    "opens_summed": "SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, count(*) AS opened, max(ts) AS last FROM events JOIN documents ON user_id = doc_id GROUP BY 1",
}
