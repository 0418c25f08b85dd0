"""SQL for DuckDB that gives the rows of the operators that SQL can express."""

from __future__ import annotations

from sidetrace.llm import decontam, licenses

_ALL = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'"


def _escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for mark in ("<s>", "[INST]", "[/INST]", "</s>"):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


#: n_turns, digests and lengths straight from the rows; the template adds 20 code points to each turn.
OP1 = f"""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(20 + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars FROM ({_ALL}) GROUP BY conv_id"""

#: All pairs by shared shingle, then reachability over the links.
OP7 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
k AS (SELECT doc_id, md5(array_to_string(list_sort(s), chr(10))) AS k, len(s) AS n FROM s),
c AS (SELECT doc_id, n, CASE WHEN n > 0 THEN min(doc_id) OVER (PARTITION BY k) ELSE doc_id END AS class_id FROM k),
d AS (SELECT l.a, count(DISTINCT cb.class_id) AS n_links FROM (SELECT a, b FROM e) l JOIN c ca ON ca.doc_id = l.a JOIN c cb ON cb.doc_id = l.b AND cb.class_id <> ca.class_id GROUP BY l.a)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, component_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM c JOIN m ON m.id = c.doc_id LEFT JOIN d ON d.a = c.doc_id"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _template(table: str, key: str) -> str:
    """(key, t: list of {raw, form}) of a table's texts."""
    bare = f"trim(w[i], {_quoted(decontam.PUNCTUATION + decontam._SPACE)})"
    units = "[" + ", ".join(map(_quoted, decontam.UNITS)) + "]"
    return f"""(SELECT {key}, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'raw': lower({bare}), 'form':
CASE WHEN regexp_matches({bare}, '^[+-]?[$€£]?[0-9][0-9.,/:]*[%$€£]?$') THEN '{decontam.NUMBER}' WHEN list_contains({units}, lower({bare})) THEN '{decontam.UNIT}'
WHEN lower({bare}) <> {bare} AND upper({bare}) <> {bare} AND i > 1 AND NOT regexp_matches(w[i - 1], '{decontam._ENDS}[^a-zA-Z_0-9]*$') THEN '{decontam.NAME}' ELSE lower({bare}) END}}), lambda t: t.raw <> '') AS t
FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), {_quoted(decontam._TOKEN)}) AS w FROM {table}))"""


_KINDS = f"['{decontam.NUMBER}', '{decontam.NAME}', '{decontam.UNIT}']"

#: Every window of the items against every window of the documents, by equal templates.
OP5 = f"""WITH it AS (SELECT item_id, t, least(len(t), 8) AS size FROM {_template('benchmark', 'item_id')} WHERE len(t) > 0),
w AS (SELECT DISTINCT item_id, i - 1 AS pos, size, t[i:i + size - 1] AS t FROM (SELECT *, unnest(range(1, len(t) - size + 2)) AS i FROM it)),
iw AS (SELECT item_id, pos, size, t, array_to_string([x.form for x in t], ' ') AS f, array_to_string([x.raw for x in t], ' ') AS r, count(*) OVER (PARTITION BY item_id) AS n_windows FROM w WHERE len([x for x in t if NOT list_contains({_KINDS}, x.form)]) > 0),
dt AS {_template('documents', 'doc_id')},
dw AS (SELECT doc_id, i - 1 AS start, size, t[i:i + size - 1] AS t FROM (SELECT doc_id, t, size, unnest(range(1, len(t) - size + 2)) AS i FROM dt, (SELECT DISTINCT size FROM iw) WHERE len(t) >= size)),
m AS (SELECT doc_id, item_id, start - pos AS shift, pos, n_windows, [{{'slot': pos + i, 'item': iw.t[i].raw, 'doc': dw.t[i].raw}} for i in range(1, iw.size + 1) if list_contains({_KINDS}, iw.t[i].form)] AS pairs
FROM iw JOIN (SELECT *, array_to_string([x.form for x in t], ' ') AS f, array_to_string([x.raw for x in t], ' ') AS r, FROM dw) dw ON dw.size = iw.size AND (dw.f = iw.f OR dw.r = iw.r)),
g AS (SELECT doc_id, item_id, shift, count(DISTINCT pos) AS n_matched, max(n_windows) AS n_windows, list_distinct(flatten(list(pairs))) AS pairs FROM m GROUP BY ALL),
c AS (SELECT *, len(pairs) AS n_slots, len([p for p in pairs if p.item <> p.doc]) AS n_changed FROM g WHERE n_matched >= greatest(1, ceil(n_windows * 0.5)) AND len(list_distinct([p.item for p in pairs])) = len(list_distinct([{{'i': p.item, 'd': p.doc}} for p in pairs]))),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, n_changed, n_windows DESC, n_slots DESC) AS rn FROM c)
SELECT doc_id, item_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_slots AS BIGINT) AS n_slots, CAST(n_changed AS BIGINT) AS n_changed FROM b WHERE rn = 1"""


def _op8() -> str:
    w = licenses.Weights(licenses.TEMPLATES, 0.75)
    vectors = ", ".join(f"({_quoted(name)}, {k}, {_quoted(word)}, {x!r}::DOUBLE)" for name, k, v in w.vectors for word, x in v.items())
    idf = ", ".join(f"({_quoted(word)}, {x!r}::DOUBLE)" for word, x in w.idf.items())
    anchors = ", ".join(f"({_quoted(word)}, {_quoted(name)}, {k}, {at}, {n})" for word, name, k, at, n in w.anchors)
    heavy = ", ".join(map(_quoted, sorted(w.heavy)))
    cut = f"regexp_extract_all(lower({{}}), {_quoted(licenses._WORD)})"
    return f"""WITH v(license, template, word, weight) AS (VALUES {vectors}), idf(word, idf) AS (VALUES {idf}), a(word, license, template, place, n) AS (VALUES {anchors}),
n AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(nullif(source, ''), 'unknown') AS source, coalesce(nullif(lang, ''), 'unknown') AS lang FROM documents),
f AS (SELECT doc_id, text, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) THEN concat(source, '/LICENSE') WHEN doc_id = min(doc_id) OVER (PARTITION BY source, lang) THEN concat(source, '/', lang, '/LICENSE') ELSE concat(source, '/', lang, '/', doc_id, '.txt') END AS path, source, lang FROM n),
b AS (SELECT path, {cut.format('part')} AS words FROM (SELECT path, unnest(list_concat(regexp_extract_all(text, {_quoted(licenses._LINE)}), regexp_split_to_array(text, {_quoted(licenses._PARAGRAPHS)}), [text])) AS part FROM f)),
k AS (SELECT path, words, unnest(list_filter(range(1, len(words) + 1), lambda i: list_contains([{heavy}], words[i]))) AS i FROM (SELECT path, {cut.format('text')} AS words FROM f)),
l AS (SELECT row_number() OVER () AS line, * FROM (SELECT DISTINCT path, words, NULL AS only_license, NULL AS only_template FROM b
UNION ALL SELECT DISTINCT path, words[i - a.place:i - a.place + n - 1], license, template FROM k JOIN a ON a.word = k.words[k.i] WHERE i - a.place >= 1 AND i - a.place + n - 1 <= len(words))),
t AS (SELECT path, line, only_license, only_template, word, count(*) AS tf FROM (SELECT path, line, only_license, only_template, unnest(words) AS word FROM l) GROUP BY ALL),
x AS (SELECT t.path, t.line, only_license, only_template, t.word, tf * coalesce(idf, {w.unseen!r}::DOUBLE) AS x FROM t LEFT JOIN idf ON idf.word = t.word),
norm AS (SELECT path, line, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
dot AS (SELECT x.path, x.line, license, template, sum(x * weight) AS dot FROM x JOIN v ON v.word = x.word AND coalesce(only_license = license AND only_template = template, true) GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT dot.path, license, CAST(round(dot / norm * 10000) AS BIGINT) AS cosine FROM dot JOIN norm ON norm.path = dot.path AND norm.line = dot.line),
o AS (SELECT path, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) AS rn FROM c WHERE cosine >= 7500) WHERE rn = 1),
p AS (SELECT path, license, regexp_replace(path, '/LICENSE$', '') AS dir FROM o WHERE path LIKE '%/LICENSE')
SELECT f.doc_id, f.path, coalesce(o.license, a.license, b.license) AS license, coalesce(o.cosine, 0) AS cosine, CASE WHEN o.license IS NOT NULL THEN 'header' WHEN coalesce(a.license, b.license) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
CASE WHEN o.license IS NOT NULL THEN f.path ELSE coalesce(a.path, b.path) END AS license_path
FROM f LEFT JOIN o ON o.path = f.path LEFT JOIN p a ON a.dir = concat(f.source, '/', f.lang) AND f.path NOT LIKE concat(f.source, '/LICENSE') LEFT JOIN p b ON b.dir = f.source"""


ORACLE_SQL = {"op1_chat": OP1, "op5_decontam": OP5, "op7_jaccard": OP7, "op8_licenses": _op8()}
