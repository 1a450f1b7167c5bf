"""The same results in plain SQL (DuckDB), written apart from the DataFrame code; only word lists and parameters are shared."""

from __future__ import annotations

from .. import constants as K
from ..sources.synthetic import MD_CTE, RAW_CTE, RENAMES

ABSENT = "zzyzxabsent"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def stem(w: str) -> str:
    return "CASE " + " ".join(f"WHEN length({w}) > {len(s) + 2} AND ends_with({w}, '{s}') THEN left({w}, length({w}) - {len(s)})" for s in K.SUFFIXES) + f" ELSE {w} END"


def h32(x: str, at: int = 1) -> str:
    return f"('0x' || substr(md5({x}), {at}, 8))::BIGINT"


def norm(p: str) -> str:
    return f"list_reduce(list_prepend('', string_split({p}, '/')), lambda a, x: CASE WHEN x = '' OR x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '(^|/)[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END)"


def parent(p: str) -> str:
    return f"regexp_replace({p}, '(^|/)[^/]*$', '')"


def canon(p: str) -> str:
    low, name = f"lower({p})", f"regexp_extract(lower({p}), '([^/]*)$', 1)"
    has = lambda t, *ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"
    parts = [(0.2, has(low, "docs/adr/", "docs/architecture/")), (0.15, has(low, "docs/index/")), (-0.3, has(low, "scratch", "archive", "old")), (-0.25, has(low, "deprecated", "backup")), (0.1, has(name, "readme", "index")), (0.1, has(name, "guide", "runbook", "plan"))]
    return "round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE" + "".join(f" + CASE WHEN {c} THEN {v}::DOUBLE ELSE 0::DOUBLE END" for v, c in parts) + ")), 6)"


IDF = "greatest(ln(((SELECT count(*) FROM docs) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.1::DOUBLE)"
SHINGLE = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


def _bits(c: str) -> str:
    return " + ".join(f"CASE WHEN sum((({c} >> {i}) & 1) * 2 - 1) > 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32))


def _bands() -> str:
    r = K.SLOTS // K.BANDS
    return "[" + ", ".join(f"md5(array_to_string(m[{b * r + 1}:{(b + 1) * r}], ','))" for b in range(K.BANDS)) + "]"


TARGET = "regexp_extract(target, '^([^#]*)', 1)"
PLACEHOLDER = f"(lower({TARGET}) IN ('url', 'text', 'todo', 'link', 'tbd') OR starts_with(lower({TARGET}), '/path/to/') OR starts_with(lower({TARGET}), '../path/to/') OR contains(lower({TARGET}), 'replace-me'))"
EXTERNAL = "regexp_matches(target, '^(https?://|mailto:|ftp://)')"
CODE = r"regexp_matches(lower(resolved), '\.(py|ts|tsx|json|yaml|yml|png|svg)$')"
DONE = "(contains(lower({0}), 'done') OR contains(lower({0}), 'complete') OR contains(lower({0}), 'resolved'))"
PART = "regexp_matches(lower({0}), '^part [0-9]')"
LOG = "(contains(lower({0}), 'changelog') OR contains(lower({0}), 'release notes') OR ends_with(lower({0}), 'changes') OR ends_with(lower({0}), 'history'))"
ITEM = r"regexp_matches({0}, '^\s*([-*+]|[0-9]+\.)\s+')"
SLUGKEY = "replace(replace(lower({0}), ' ', '-'), '_', '-')"

#: name -> (what it needs, SQL)
CTES: dict[str, tuple[str, str]] = {
    "lns": ("", "SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT path, list_transform(CASE WHEN s[len(s)] = '' THEN s[:len(s) - 1] ELSE s END, lambda x: regexp_replace(x, '\\r$', '')) AS l FROM (SELECT path, string_split(content, chr(10)) AS s FROM docs))"),
    "prose": ("lns", f"SELECT path, unnest(regexp_extract_all(line, '{K.WORD}')) AS w FROM lns WHERE NOT starts_with(line, '```') AND NOT starts_with(line, '    ')"),
    "words": ("prose", f"SELECT path, lower(w) AS word FROM prose WHERE length(w) >= 3 AND lower(w) NOT IN {_in(K.QUERY_STOP)}"),
    "tf": ("words", f"SELECT path, {stem('word')} AS term, count(*) AS tf FROM words GROUP BY ALL"),
    "lens": ("words", "SELECT docs.path, coalesce(n, 0) AS doc_length FROM docs LEFT JOIN (SELECT path, count(*) AS n FROM words GROUP BY path) USING (path)"),
    "idf": ("tf", f"SELECT term, df, {IDF} AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)"),
    "heads": ("lns", r"SELECT path, line_no AS line, length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS level, regexp_extract(line, '^(#{1,6})\s+(.+)$', 2) AS text FROM lns WHERE regexp_matches(line, '^#{1,6}\s+.+$')"),
    "hwords": ("heads", f"SELECT path, line, level, text, idx, lower(w) AS word FROM (SELECT *, unnest(regexp_extract_all(text, '{K.WORD}')) AS w, unnest(range(len(regexp_extract_all(text, '{K.WORD}')))) AS idx FROM heads) WHERE length(w) >= 3 AND lower(w) NOT IN {_in(K.QUERY_STOP)}"),
    "kw": ("tf hwords", f"SELECT path, term, bool_or(h) AS in_heading FROM (SELECT path, term, false AS h FROM tf UNION ALL SELECT path, {stem('word')}, true FROM hwords) GROUP BY path, term"),
    "posts": ("kw hwords", f"SELECT {stem('term')} AS term, path, NULL::INTEGER AS line, NULL::VARCHAR AS heading, NULL::INTEGER AS level FROM kw UNION ALL SELECT {stem('word')}, path, line, text, level FROM hwords"),
    "lnk": ("lns", r"SELECT path, line_no AS line, unnest(range(len(t))) AS nth, unnest(t) AS text, unnest(g) AS target FROM (SELECT path, line_no, regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 1) AS t, regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 2) AS g FROM lns)"),
    "adr": ("lns", r"SELECT path, line_no AS line, unnest(range(len(t))) AS nth, unnest(t) AS raw_text, lpad(unnest(g)::INTEGER::VARCHAR, greatest(3, length(unnest(g)::INTEGER::VARCHAR))::INTEGER, '0') AS normalized_id FROM (SELECT path, line_no, regexp_extract_all(line, '\bADR[-_ ]?(\d{2,4})\b', 0) AS t, regexp_extract_all(line, '\bADR[-_ ]?(\d{2,4})\b', 1) AS g FROM lns)"),
    "nlines": ("lns", "SELECT docs.path, coalesce(n, 0) AS n_lines FROM docs LEFT JOIN (SELECT path, count(*) AS n FROM lns GROUP BY path) USING (path)"),
    "spans": ("heads nlines", "SELECT h.path, text AS heading, level, line AS line_start, coalesce(lead(line) OVER (PARTITION BY h.path ORDER BY line) - 1, n_lines) AS line_end FROM heads h JOIN nlines USING (path)"),
    "sects": ("spans lns", "SELECT path, heading, level, line_start, line_end, coalesce(string_agg(line, chr(10) ORDER BY line_no), '') AS content FROM (SELECT s.*, l.line, l.line_no FROM (SELECT * FROM spans UNION ALL SELECT path, 'Full Document', 0, 1, n_lines FROM nlines WHERE path NOT IN (SELECT path FROM heads)) s LEFT JOIN lns l ON l.path = s.path AND l.line_no BETWEEN s.line_start AND s.line_end) GROUP BY ALL"),
    "res": ("lnk", f"SELECT *, CASE WHEN t = '' THEN path WHEN starts_with(t, '/') THEN {norm('t')} ELSE {norm(parent('path') + chr(32) + '|| chr(47) || t')} END AS resolved, CASE WHEN contains(target, '#') THEN regexp_extract(target, '^[^#]*#(.*)$', 1) END AS anchor FROM (SELECT *, {TARGET} AS t FROM lnk)"),
    "inner_res": ("res", f"SELECT * FROM res WHERE NOT {EXTERNAL} AND resolved IN (SELECT path FROM docs)"),
    "inb": ("res", f"SELECT docs.path, coalesce(n, 0) AS inbound FROM docs LEFT JOIN (SELECT resolved AS path, count(*) AS n FROM res WHERE NOT {EXTERNAL} GROUP BY resolved) USING (path)"),
    "checked": ("res heads", f"""SELECT path, line, nth, target, kind, kind IN ('placeholder', 'code_missing', 'doc_missing', 'anchor_missing', 'anchor_unverified') AS broken FROM (
      SELECT res.*, CASE WHEN {EXTERNAL} THEN 'external' WHEN {PLACEHOLDER} THEN 'placeholder' WHEN resolved NOT IN (SELECT path FROM docs) THEN CASE WHEN {CODE} THEN 'code_missing' ELSE 'doc_missing' END
        WHEN anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.path = resolved AND replace(lower(h.text), ' ', '-') = anchor) THEN 'anchor_missing' ELSE 'ok' END AS kind FROM res)"""),
    "fixed": ("res", f"""SELECT r.path, line, nth, target, CASE WHEN {parent('r.path')} <> '' AND starts_with(d.path, {parent('r.path')} || '/') THEN substr(d.path, length({parent('r.path')}) + 2) ELSE d.path END AS candidate,
      count(*) OVER (PARTITION BY r.path, line, nth) AS candidates
      FROM (SELECT * FROM res WHERE NOT {EXTERNAL} AND NOT {PLACEHOLDER} AND resolved <> path AND resolved NOT IN (SELECT path FROM docs)) r JOIN docs d ON regexp_extract(d.path, '([^/]*)$', 1) = regexp_extract(resolved, '([^/]*)$', 1)"""),
    "adrx": ("", r"SELECT lpad(n::INTEGER::VARCHAR, greatest(3, length(n::INTEGER::VARCHAR))::INTEGER, '0') AS normalized_id, max(path) AS adr_path FROM (SELECT path, regexp_extract(path, 'ADR[-_]?(\d{2,4})', 1) AS n FROM docs WHERE contains(lower(path), '/adr/') OR contains(lower(path), 'adr-')) WHERE n <> '' GROUP BY 1"),
    "edges": ("inner_res spans adr adrx", f"""
      SELECT path AS source, resolved AS target, 'links_to' AS kind, anchor, NULL::VARCHAR AS src_heading, NULL::INTEGER AS src_line, NULL::VARCHAR AS tgt_heading, NULL::INTEGER AS tgt_line, NULL::VARCHAR AS raw_text FROM inner_res WHERE resolved <> path AND regexp_matches(lower(resolved), '\\.(md|txt|rst)$')
      UNION SELECT i.path, resolved, 'section_links_to', anchor, s.heading, s.line_start, t.heading, t.line_start, NULL::VARCHAR FROM inner_res i JOIN spans s ON s.path = i.path AND i.line BETWEEN s.line_start AND s.line_end
        LEFT JOIN spans t ON t.path = resolved AND t.line_start = (SELECT min(line_start) FROM spans u WHERE u.path = resolved AND contains({SLUGKEY.format('u.heading')}, {SLUGKEY.format('anchor')}))
        WHERE resolved <> i.path AND regexp_matches(lower(resolved), '\\.(md|txt|rst)$')
      UNION SELECT a.path, adr_path, 'adr_reference', NULL::VARCHAR, s.heading, s.line_start, NULL::VARCHAR, NULL::INTEGER, raw_text FROM adr a JOIN adrx USING (normalized_id) LEFT JOIN spans s ON s.path = a.path AND a.line BETWEEN s.line_start AND s.line_end WHERE adr_path <> a.path"""),
    "q": ("", f"SELECT pos, word, {stem('word')} AS term FROM (SELECT row_number() OVER (ORDER BY min(i)) - 1 AS pos, word FROM (SELECT unnest(range(len(l))) AS i, lower(unnest(l)) AS word FROM (SELECT regexp_extract_all(text, '{K.WORD}') AS l FROM benchmark WHERE item_id = 0)) WHERE length(word) >= 3 AND word NOT IN {_in(K.QUERY_STOP)} GROUP BY word) WHERE pos < 5 UNION ALL SELECT 5, '{ABSENT}', '{ABSENT}'"),
    "bm": ("tf idf lens q", f"SELECT path, sum(idf * tf * {K.K1 + 1}::DOUBLE / (tf + {K.K1}::DOUBLE * ({1 - K.B}::DOUBLE + {K.B}::DOUBLE * doc_length / (SELECT avg(doc_length) FROM lens)))) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (path) GROUP BY path"),
    "shin": ("", f"SELECT path, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT path, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT path, {SHINGLE.format('content')} AS w FROM docs))"),
    "sim": ("shin", f"SELECT docs.path, coalesce(sim_lo, 0) AS sim_lo, coalesce(sim_hi, 0) AS sim_hi FROM docs LEFT JOIN (SELECT path, ({_bits('a')})::BIGINT AS sim_lo, ({_bits('b')})::BIGINT AS sim_hi FROM (SELECT path, {h32('s')} AS a, {h32('s', 9)} AS b FROM shin) GROUP BY path) USING (path)"),
    "mh": ("kw", "SELECT path, [" + ", ".join(f"min((x * {a} + {b}) % {K.PRIME})" for a, b in K.minhash_coefficients()) + f"] AS m FROM (SELECT path, {h32('term')} % {K.PRIME} AS x FROM kw) GROUP BY path"),
    "band": ("mh", f"SELECT path, unnest(range({K.BANDS})) AS band, unnest({_bands()}) AS key FROM mh"),
    "cand": ("band", "SELECT DISTINCT a.path AS path1, b.path AS path2 FROM band a JOIN band b USING (band, key) WHERE a.path < b.path"),
    "sets": ("kw", "SELECT path, list(DISTINCT term) AS terms FROM kw GROUP BY path"),
    "dup": ("cand sets sim mh", """SELECT *, round(0.4::DOUBLE * jaccard + 0.3::DOUBLE * simhash + 0.3::DOUBLE * minhash, 6) AS combined FROM (
      SELECT path1, path2, len(list_intersect(s.terms, t.terms))::DOUBLE / (len(s.terms) + len(t.terms) - len(list_intersect(s.terms, t.terms))) AS jaccard,
        1 - (bit_count(xor(u.sim_lo, v.sim_lo)) + bit_count(xor(u.sim_hi, v.sim_hi))) / 64.0::DOUBLE AS simhash,
        len(list_filter(list_zip(x.m, y.m), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS minhash
      FROM cand JOIN sets s ON s.path = path1 JOIN sets t ON t.path = path2 JOIN sim u ON u.path = path1 JOIN sim v ON v.path = path2 JOIN mh x ON x.path = path1 JOIN mh y ON y.path = path2)"""),
    "cls": ("mh", "SELECT path, min(path) OVER (PARTITION BY content) AS first FROM docs WHERE path IN (SELECT path FROM mh)"),
    "cpy": ("cls", "SELECT first AS path1, path AS path2 FROM cls WHERE path <> first"),
    "txt": ("dup cpy", "SELECT * FROM dup WHERE path1 NOT IN (SELECT path2 FROM cpy) AND path2 NOT IN (SELECT path2 FROM cpy)"),
    "dcl": ("txt cpy", "SELECT path1, path2, round(jaccard, 6) AS jaccard, round(simhash, 6) AS simhash, round(minhash, 6) AS minhash, combined, false AS copy FROM txt WHERE combined >= 0.35 UNION ALL SELECT path1, path2, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, true FROM cpy"),
    "metr": ("lns heads spans lnk", ""),
    "secm": ("spans sects", f"""SELECT path, heading, level, line_start, line_end, (line_end - line_start + 1)::BIGINT AS line_count,
      len(regexp_extract_all(content, '[A-Za-z0-9_][A-Za-z0-9_-]*'))::BIGINT AS word_count, len(regexp_extract_all(content, '\\[[^\\]\\n]+\\]\\([^)\\n]+\\)'))::BIGINT AS link_count,
      len(list_filter(string_split(content, chr(10)), lambda x: {ITEM.format('x')}))::BIGINT AS list_item_count,
      ceil(len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '```'))) / 2.0)::BIGINT AS code_block_count,
      {DONE.format('heading')} AS has_completion_marker, {PART.format('heading')} AS looks_like_part, {LOG.format('heading')} AS looks_like_changelog FROM sects WHERE level > 0"""),
    "vfreq": ("posts", "SELECT term, count(*) AS term_freq, count(DISTINCT path) AS doc_freq, min(path) AS first_path FROM posts WHERE strlen(term) BETWEEN 3 AND 48 AND regexp_matches(term, '^[A-Za-z0-9_-]+$') AND regexp_matches(term, '[A-Za-z]') AND length(regexp_replace(term, '[^0-9]', '', 'g')) * 10 < length(term) * 6 GROUP BY term"),
}

_H = lambda c: f"count(*) FILTER (WHERE {c})"
CTES["metr"] = (
    "lns heads spans lnk",
    f"""SELECT docs.path, len(regexp_extract_all(content, '[A-Za-z0-9_][A-Za-z0-9_-]*'))::BIGINT AS words, frontmatter_keys, metadata_lines,
  coalesce(line_count, 0) AS line_count, coalesce(code_blocks, 0) AS code_blocks, coalesce(list_items, 0) AS list_items, coalesce(table_rows, 0) AS table_rows,
  coalesce(headings, 0) AS headings, coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2, coalesce(h3, 0) AS h3, coalesce(h4_plus, 0) AS h4_plus, coalesce(part_headings, 0) AS part_headings, coalesce(completion_headings, 0) AS completion_headings, coalesce(changelog_headings, 0) AS changelog_headings,
  coalesce(sections, 0) AS sections, coalesce(longest_section, 0) AS longest_section, coalesce(links, 0) AS links
FROM docs JOIN (
  SELECT d.path, CASE WHEN closed > 0 THEN (SELECT count(*) FROM lns l WHERE l.path = d.path AND line_no > 1 AND line_no < closed AND contains(line, ':')) ELSE 0 END AS frontmatter_keys,
    (SELECT count(*) FROM lns l WHERE l.path = d.path AND line_no > closed AND line_no < coalesce((SELECT min(line_no) FROM lns m WHERE m.path = d.path AND line_no > closed AND (trim(line) = '' OR starts_with(line, '#'))), 1000000000) AND regexp_matches(line, '^[A-Za-z][A-Za-z0-9 _-]*:[ \\t]+[^ \\t]')) AS metadata_lines
  FROM (SELECT docs.path, coalesce((SELECT min(line_no) FROM lns l WHERE l.path = docs.path AND line_no > 1 AND line = '---' AND EXISTS (SELECT 1 FROM lns f WHERE f.path = docs.path AND f.line_no = 1 AND f.line = '---')), 0) AS closed FROM docs) d) USING (path)
LEFT JOIN (SELECT path, count(*) AS line_count, ceil({_H("starts_with(line, '```')")} / 2.0)::BIGINT AS code_blocks, {_H(ITEM.format('line'))} AS list_items, {_H("length(regexp_replace(line, '[^|]', '', 'g')) >= 2")} AS table_rows FROM lns GROUP BY path) USING (path)
LEFT JOIN (SELECT path, count(*) AS headings, {_H('level = 1')} AS h1, {_H('level = 2')} AS h2, {_H('level = 3')} AS h3, {_H('level >= 4')} AS h4_plus, {_H(PART.format('text'))} AS part_headings, {_H(DONE.format('text'))} AS completion_headings, {_H(LOG.format('text'))} AS changelog_headings FROM heads GROUP BY path) USING (path)
LEFT JOIN (SELECT path, count(*) AS sections, max(line_end - line_start + 1)::BIGINT AS longest_section FROM spans GROUP BY path) USING (path)
LEFT JOIN (SELECT path, count(*) AS links FROM lnk GROUP BY path) USING (path)""",
)


def sql(select: str, needs: str, corpus: str = RAW_CTE, extra: str = "") -> str:
    """WITH the corpus, what the select needs, and extra CTEs; then the select."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0].split():
            add(d)
        if n not in order:
            order.append(n)

    for n in needs.split():
        add(n)
    parts = [corpus, *(f"{n} AS ({CTES[n][1]})" for n in order), *([extra] if extra else [])]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


SELF = "'docs/adr/ADR-000-0.md'"
OTHER = "'docs/architecture/overview-1.md'"
START = "'notes/page-99.rst'"
TWINS = "'src/module-185/README.md'", "'src/module-195/README.md'"
PHRASE = "(SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT unnest(range(len(l))) AS i, lower(unnest(l)) AS w FROM (SELECT list_filter(regexp_extract_all(text, '" + K.WORD + "'), lambda x: length(x) >= 3)[1:2] AS l FROM benchmark WHERE item_id = 0)))"
_PH = f"cand0 AS (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, path LIMIT 100), txt AS (SELECT path, ' ' || coalesce(array_to_string(list_transform(list_filter(regexp_extract_all(content, '{K.WORD}'), lambda x: length(x) >= 3), lambda x: lower(x)), ' '), '') || ' ' AS t FROM docs WHERE path IN (SELECT path FROM cand0)), hit AS (SELECT path, score, CASE WHEN contains(t, ' ' || {PHRASE} || ' ') THEN 1 ELSE 0 END AS hits FROM cand0 JOIN txt USING (path))"
_HEALTH = f"tot AS (SELECT m.*, coalesce(completed, 0) AS completed, coalesce(entries, 0) AS entries FROM metr m LEFT JOIN (SELECT path, sum(line_count) AS completed FROM secm WHERE has_completion_marker GROUP BY path) USING (path) LEFT JOIN (SELECT path, sum(list_item_count) AS entries FROM secm WHERE looks_like_changelog GROUP BY path) USING (path)), iss AS (SELECT path, 'bloated-file' AS kind, 'error' AS severity, line_count::BIGINT AS value, 20::BIGINT AS threshold FROM tot WHERE line_count > 20 UNION ALL SELECT path, 'accumulator-pattern', 'error', part_headings::BIGINT, 2 FROM tot WHERE part_headings >= 2 UNION ALL SELECT path, 'stale-completed', 'warning', completed::BIGINT, 5 FROM tot WHERE completed > 5 UNION ALL SELECT path, 'changelog-bloat', 'warning', entries::BIGINT, 1 FROM tot WHERE entries > 1)"
_DIRS = "CASE WHEN contains({0}, '/') THEN string_split(regexp_replace({0}, '/[^/]*$', ''), '/') ELSE [] END"
_NOW = "ren(seq, old_path, new_path) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(RENAMES)) + "), step(old_path, now_path, seq) AS (SELECT old_path, new_path, seq FROM ren WHERE seq = (SELECT min(seq) FROM ren x WHERE x.old_path = ren.old_path) UNION ALL SELECT s.old_path, r.new_path, r.seq FROM step s JOIN ren r ON r.old_path = s.now_path AND r.seq = (SELECT min(seq) FROM ren x WHERE x.old_path = s.now_path AND x.seq > s.seq)), now AS (SELECT old_path, arg_max(now_path, seq) AS now_path FROM step GROUP BY old_path)"
_RULES_GLOB = "regexp_matches(path, '^(?:.*/)?adr/.*\\.md$')"


def _paths(depth: int) -> str:
    return sql(
        f"SELECT DISTINCT e.source, e.target, e.kind, d.dist + 1 AS hop FROM ed e JOIN (SELECT node, min(dist) AS dist FROM walk GROUP BY node) d ON e.source = d.node WHERE d.dist < {depth}",
        "edges", MD_CTE,
        f"ed AS (SELECT DISTINCT source, target, kind FROM edges), walk AS (SELECT path AS node, 0 AS dist FROM docs WHERE path = {START} UNION SELECT ed.target, dist + 1 FROM walk JOIN ed ON ed.source = walk.node WHERE dist + 1 < {depth})",
    )


def _metrics_extra() -> str:
    return "ranked AS (SELECT coalesce(source, '') AS question_id, doc_id AS path, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars DESC, doc_id) AS rank FROM documents), rel AS (SELECT DISTINCT coalesce(d.source, '') AS question_id, d.doc_id AS path FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1), ks AS (SELECT unnest([5, 10]) AS k), base AS (SELECT s.question_id, k, n_rel, first FROM (SELECT question_id, count(*) AS n_rel FROM rel GROUP BY 1) s CROSS JOIN ks LEFT JOIN (SELECT question_id, min(rank) AS first FROM ranked JOIN rel USING (question_id, path) GROUP BY 1) f USING (question_id)), gain AS (SELECT question_id, k, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN rel USING (question_id, path) JOIN ks ON rank <= k GROUP BY 1, 2)"


ORACLE: dict[str, str] = {
    "bm25_topk": sql("SELECT path, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY round(score, 6) DESC, path LIMIT 10", "bm"),
    "term_freq": sql("SELECT path, term, tf FROM tf", "tf"),
    "doc_length": sql("SELECT path, doc_length FROM lens", "lens"),
    "corpus_stats": sql("SELECT count(*) AS n_docs, round(avg(doc_length), 6) AS avg_doc_length FROM lens", "lens"),
    "idf": sql("SELECT term, df, round(idf, 6) AS idf FROM idf", "idf"),
    "keyword_sets": sql("SELECT path, term, in_heading FROM kw", "kw", MD_CTE),
    "postings_count": sql("SELECT term, count(*) AS postings, count(DISTINCT path) AS docs FROM posts GROUP BY term", "posts", MD_CTE),
    "index_stats": sql("SELECT (SELECT count(*) FROM docs) AS files, (SELECT count(DISTINCT term) FROM posts) AS terms, (SELECT count(*) FROM heads) AS headings, (SELECT count(*) FROM lnk) AS links", "posts lnk", MD_CTE),
    "top_keywords": sql("SELECT term, count(*) AS postings FROM posts GROUP BY term ORDER BY postings DESC, term LIMIT 20", "posts", MD_CTE),
    "doc_terms": sql(f"SELECT path, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(weight, 6) DESC, term) AS rank FROM (SELECT a.path, a.term, tf * idf AS weight FROM (SELECT DISTINCT path, {stem('term')} AS term FROM tf) a JOIN tf USING (path, term) JOIN idf USING (term) WHERE a.term NOT IN (SELECT term FROM q))) WHERE rank <= 5", "tf idf q"),
    "query_diagnostics": sql("SELECT pos::INTEGER AS pos, word, term, coalesce(df, 0) AS df, round(idf, 6) AS idf, df IS NULL AS missing FROM q LEFT JOIN idf USING (term)", "q idf"),
    "phrase_query": sql("SELECT path, round(score + hits, 6) AS score FROM hit WHERE score + hits > 0 ORDER BY round(score + hits, 6) DESC, path LIMIT 10", "bm", RAW_CTE, _PH),
    "phrase_required": sql("SELECT path, round(score + hits, 6) AS score FROM hit WHERE hits = 1 ORDER BY round(score + hits, 6) DESC, path LIMIT 10", "bm", RAW_CTE, _PH),
    "simhash": sql("SELECT * FROM sim", "sim"),
    "minhash": sql("SELECT path, unnest(range(128))::INTEGER AS slot, unnest(m) AS value FROM mh", "mh"),
    "lsh_pairs": sql("SELECT path1, path2, false AS copy FROM cand WHERE path1 NOT IN (SELECT path2 FROM cpy) AND path2 NOT IN (SELECT path2 FROM cpy) UNION ALL SELECT path1, path2, true FROM cpy", "cand cpy"),
    "dupes": sql("SELECT * FROM dcl", "dcl"),
    "dupes_group": sql("SELECT path1 AS first, count(*) AS members, max(combined) AS best FROM dcl GROUP BY path1", "dcl"),
    "similar": sql(f"SELECT * FROM (SELECT s.path, round(j, 6) AS jaccard, round(h, 6) AS simhash, round(0.6::DOUBLE * j + 0.4::DOUBLE * h, 6) AS combined FROM (SELECT d.path, coalesce(len(list_intersect(a.terms, b.terms))::DOUBLE / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))), 0) AS j, 1 - (bit_count(xor(u.sim_lo, v.sim_lo)) + bit_count(xor(u.sim_hi, v.sim_hi))) / 64.0::DOUBLE AS h FROM docs d LEFT JOIN sets b USING (path) JOIN sim v USING (path) CROSS JOIN (SELECT * FROM sets WHERE path = {SELF}) a JOIN sim u ON u.path = a.path WHERE d.path <> {SELF}) s) WHERE combined >= 0.3 ORDER BY combined DESC, path LIMIT 5", "sets sim"),
    "similar_all": sql("SELECT query, path, round(j, 6) AS jaccard, round(h, 6) AS simhash, combined FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY combined DESC, path) AS r FROM (SELECT *, round(0.6::DOUBLE * j + 0.4::DOUBLE * h, 6) AS combined FROM (SELECT e.path AS query, d.path, coalesce(len(list_intersect(a.terms, b.terms))::DOUBLE / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))), 0) AS j, 1 - (bit_count(xor(u.sim_lo, v.sim_lo)) + bit_count(xor(u.sim_hi, v.sim_hi))) / 64.0::DOUBLE AS h FROM docs e JOIN docs d ON d.path <> e.path LEFT JOIN sets a ON a.path = e.path LEFT JOIN sets b ON b.path = d.path JOIN sim u ON u.path = e.path JOIN sim v ON v.path = d.path WHERE e.doc_id % 20 = 0)) WHERE combined >= 0.3) WHERE r <= 5", "sets sim"),
    "diff_keywords": sql(f"SELECT term, CASE WHEN a AND b THEN 'shared' WHEN a THEN 'only1' ELSE 'only2' END AS side FROM (SELECT term, bool_or(path = {SELF}) AS a, bool_or(path = {OTHER}) AS b FROM kw WHERE path IN ({SELF}, {OTHER}) GROUP BY term)", "kw", MD_CTE),
    "diff_headings": sql(f"SELECT lower(text) AS heading FROM heads WHERE path = {TWINS[0]} INTERSECT SELECT lower(text) FROM heads WHERE path = {TWINS[1]}", "heads", MD_CTE),
    "exact_dupes": sql("SELECT min(path) AS first, count(*) AS copies FROM docs GROUP BY content HAVING count(*) > 1", ""),
    "headings": sql("SELECT path, line, level, text FROM heads", "heads", MD_CTE),
    "links": sql("SELECT path, line, nth, text, target FROM lnk", "lnk", MD_CTE),
    "adr_refs": sql("SELECT path, line, nth, raw_text, normalized_id FROM adr", "adr", MD_CTE),
    "sections": sql("SELECT path, heading, level, line_start, line_end, md5(content) AS content_md5 FROM sects", "sects", MD_CTE),
    "doc_metrics": sql("SELECT * FROM metr", "metr", MD_CTE),
    "section_metrics": sql("SELECT * FROM secm", "secm", MD_CTE),
    "health": sql("SELECT * FROM iss", "metr secm", MD_CTE, _HEALTH),
    "health_status": sql("SELECT docs.path, CASE WHEN bool_or(severity = 'error') THEN 'unhealthy' WHEN count(severity) > 0 THEN 'warning' ELSE 'healthy' END AS status FROM docs LEFT JOIN iss USING (path) GROUP BY docs.path", "metr secm", MD_CTE, _HEALTH),
    "edges": sql("SELECT * FROM edges", "edges", MD_CTE),
    "backlinks": sql(f"SELECT path, line, text, target FROM res WHERE NOT {EXTERNAL} AND resolved = {SELF}", "res", MD_CTE),
    "inbound_counts": sql("SELECT * FROM inb", "inb", MD_CTE),
    "orphans": sql("SELECT path FROM inb WHERE inbound = 0 AND NOT contains(path, 'archive')", "inb", MD_CTE),
    "canonicality": sql(f"SELECT path, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM (SELECT path, {canon('path')} AS score FROM docs)", "", MD_CTE),
    "canonical_orphans": sql(f"SELECT path, {canon('path')} AS score FROM inb WHERE inbound = 0 AND {canon('path')} >= 0.7", "inb", MD_CTE),
    "paths_d1": _paths(1),
    "paths_d2": _paths(2),
    "paths_d3": _paths(3),
    "graph_export": sql("SELECT path AS source, resolved AS target, anchor FROM inner_res", "inner_res", MD_CTE),
    "graph_dot": sql("SELECT '  \"' || path || '\" -> \"' || resolved || '\"' || coalesce(' [label=\"' || anchor || '\"]', '') || ';' AS line FROM inner_res", "inner_res", MD_CTE),
    "link_check": sql("SELECT * FROM checked", "checked", MD_CTE),
    "link_summary": sql("SELECT count(*) AS total, count(*) FILTER (WHERE NOT broken) AS valid, count(*) FILTER (WHERE broken) AS broken FROM checked", "checked", MD_CTE),
    "link_kind_counts": sql("SELECT path, kind, count(*) AS n FROM checked GROUP BY GROUPING SETS ((path, kind), (kind))", "checked", MD_CTE),
    "link_context": sql("SELECT path, l.line, nth, CASE WHEN strlen(x.line) > 160 THEN substr(x.line, 1, 157) || '...' ELSE x.line END AS context FROM lnk l JOIN (SELECT path, line_no, line FROM lns) x USING (path) WHERE x.line_no = l.line", "lnk lns", MD_CTE),
    "stale": sql("SELECT path, age_days, inbound FROM (SELECT path, date_diff('day', DATE '2024-01-01' + (doc_id % 400)::INTEGER, DATE '2025-02-15')::INTEGER AS age_days FROM docs) JOIN inb USING (path) WHERE age_days >= 90 AND inbound >= 1", "inb", MD_CTE),
    "fix_links": sql("SELECT path, line, nth, target, candidate || coalesce('#' || CASE WHEN contains(target, '#') THEN regexp_extract(target, '^[^#]*#(.*)$', 1) END, '') AS replacement FROM fixed WHERE candidates = 1", "fixed", MD_CTE),
    "fix_proposals": sql("SELECT path, line, nth, target, string_agg(candidate, ',' ORDER BY candidate) AS options, count(*) AS n FROM fixed WHERE candidates > 1 GROUP BY ALL", "fixed", MD_CTE),
    "fix_references": sql("SELECT path, md5(new) AS new_md5 FROM (SELECT path, content, replace(replace(content, '](TODO)', '](docs/todo.md)'), '](docs/todo.md)', '](docs/tasks.md)') AS new FROM docs) WHERE new <> content", "", MD_CTE),
    "move_refs": sql("SELECT path, line, nth, target, 'docs/todo.md' AS replacement FROM lnk WHERE target = 'TODO'", "lnk", MD_CTE),
    "policy": sql(
        f"SELECT path, 'records' AS rule, 'error' AS severity, 'must_contain' AS kind, 'Status:' AS detail FROM docs WHERE {_RULES_GLOB} AND NOT contains(content, 'Status:') "
        f"UNION ALL SELECT path, 'records', 'error', 'must_not_contain', 'TODO' FROM docs WHERE {_RULES_GLOB} AND contains(content, 'TODO') "
        f"UNION ALL SELECT path, 'records', 'error', 'min_length', n_lines::VARCHAR FROM nlines WHERE {_RULES_GLOB} AND n_lines < 5 "
        f"UNION ALL SELECT path, 'records', 'error', 'max_length', n_lines::VARCHAR FROM nlines WHERE {_RULES_GLOB} AND n_lines > 40 "
        f"UNION ALL SELECT path, 'records', 'error', 'required_heading', 'Overview' FROM docs WHERE {_RULES_GLOB} AND path NOT IN (SELECT path FROM heads WHERE text = 'Overview') "
        "UNION ALL SELECT path, '*.txt', 'warning', 'forbidden_heading', 'Overview' FROM docs WHERE ends_with(path, '.txt') AND path IN (SELECT path FROM heads WHERE text = 'Overview') "
        "UNION ALL SELECT path, '*.txt', 'warning', 'max_section_length', heading || '@' || line_start || ': ' || (line_end - line_start + 1) FROM sects WHERE ends_with(path, '.txt') AND line_end - line_start + 1 > 6 AND regexp_matches(heading, '^[AO]') "
        f"UNION ALL SELECT path, '*.txt', 'warning', 'must_link_to', 'docs/index/topic-8.md' FROM docs WHERE ends_with(path, '.txt') AND path NOT IN (SELECT path FROM res WHERE NOT {EXTERNAL} AND resolved = 'docs/index/topic-8.md')",
        "heads nlines sects res", MD_CTE,
    ),
    "check_verdict": sql(f"SELECT kind, count(*) AS n, kind IN ('doc_missing', 'code_missing', 'anchor_missing', 'policy_error') AS fails FROM (SELECT kind FROM checked WHERE broken UNION ALL SELECT 'policy_error' FROM docs WHERE {_RULES_GLOB} AND NOT contains(content, 'Status:') UNION ALL SELECT 'stale' FROM docs JOIN inb USING (path) WHERE inbound >= 1 AND DATE '2025-02-15' - (DATE '2024-01-01' + (doc_id % 400)::INTEGER) >= 90) GROUP BY kind", "checked inb", MD_CTE),
    "fix_renamed": sql(f"SELECT path, line, nth, target, repeat('../', len(a) - n) || array_to_string(b[n + 1:], '/') || coalesce('#' || anchor, '') AS replacement FROM (SELECT *, coalesce(list_max(list_filter(range(1, least(len(a), len(b) - 1) + 1), lambda i: a[:i] = b[:i])), 0) AS n FROM (SELECT r.*, {_DIRS.format('r.path')} AS a, string_split(now_path, '/') AS b FROM res r JOIN now ON resolved = old_path JOIN docs d ON d.path = now_path WHERE NOT {EXTERNAL} AND NOT {PLACEHOLDER} AND resolved <> r.path AND resolved NOT IN (SELECT path FROM docs) AND NOT EXISTS (SELECT 1 FROM fixed f WHERE f.path = r.path AND f.line = r.line AND f.nth = r.nth)))", "res fixed", MD_CTE, _NOW),
    "rename_targets": f"WITH RECURSIVE {_NOW} SELECT old_path, now_path AS new_path FROM now",
    "fix_decisions": sql("SELECT path, line, nth, target, string_split(options, ',')[line % n + 1] || CASE WHEN contains(target, '#') THEN '#' || regexp_extract(target, '^[^#]*#(.*)$', 1) ELSE '' END AS replacement FROM (SELECT path, line, nth, target, string_agg(candidate, ',' ORDER BY candidate) AS options, count(*) AS n FROM fixed WHERE candidates > 1 GROUP BY ALL)", "fixed", MD_CTE),
    "fix_applied": sql("SELECT path, md5(new) AS new_md5 FROM (SELECT d.path, d.content, list_reduce(list_prepend({'t': '', 'r': d.content}, f), lambda acc, x: {'t': '', 'r': replace(acc.r, '](' || x.t || ')', '](' || x.r || ')')}).r AS new FROM docs d JOIN (SELECT path, list({'t': target, 'r': r} ORDER BY target) AS f FROM (SELECT path, target, min(candidate || CASE WHEN contains(target, '#') THEN '#' || regexp_extract(target, '^[^#]*#(.*)$', 1) ELSE '' END) AS r FROM fixed WHERE candidates = 1 GROUP BY path, target) WHERE r <> target GROUP BY path) USING (path)) WHERE new <> content", "fixed", MD_CTE),
    "resolve_path": f"SELECT * FROM (VALUES (0, './' || {SELF}, {SELF}), (1, 'docs/../' || {START}, {START}), (2, '/srv/corpus/' || {OTHER}, {OTHER}), (3, 'none.md', NULL)) t(pos, asked, path)",
    "relative_links": sql(f"SELECT path, resolved, repeat('../', len(a) - n) || array_to_string(b[n + 1:], '/') AS relative FROM (SELECT *, coalesce(list_max(list_filter(range(1, least(len(a), len(b) - 1) + 1), lambda i: a[:i] = b[:i])), 0) AS n FROM (SELECT path, resolved, {_DIRS.format('path')} AS a, string_split(resolved, '/') AS b FROM inner_res))", "inner_res", MD_CTE),
    "section_references": sql(
        f"SELECT path AS origin, resolved AS target, anchor FROM res r WHERE NOT {EXTERNAL} AND regexp_matches(lower(resolved), '\\.(md|txt|rst)$') AND EXISTS (SELECT 1 FROM sects s WHERE s.path = r.path AND r.line BETWEEN s.line_start AND s.line_end) "
        "UNION SELECT path, adr_path, NULL FROM adr a JOIN adrx USING (normalized_id) WHERE EXISTS (SELECT 1 FROM sects s WHERE s.path = a.path AND a.line BETWEEN s.line_start AND s.line_end)",
        "res sects adr adrx", MD_CTE,
    ),
    "heading_matches": sql(f"SELECT path, line, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS nth FROM heads) h WHERE nth <= 3 AND len(list_filter(regexp_extract_all(text, '{K.WORD}'), lambda w: length(w) >= 3 AND {stem('lower(w)')} IN ('overview', 'complet'))) > 0", "heads", MD_CTE),
    "file_sections": sql(f"SELECT path, heading, line_start, line_end, 1.0::DOUBLE AS bm25, {canon('path')} AS canonicality, round(0.7::DOUBLE + 0.3::DOUBLE * {canon('path')}, 6) AS combined FROM sects WHERE path IN ({SELF}, {START}, {TWINS[0]}, {TWINS[1]}) ORDER BY combined DESC, path, line_start, line_end, heading LIMIT 20", "sects", MD_CTE),
    "file_sections_ranked": sql(f"SELECT path, heading, line_start, line_end, round(coalesce(score, 0), 6) AS bm25, {canon('path')} AS canonicality, round(0.7::DOUBLE * coalesce(score, 0) + 0.3::DOUBLE * {canon('path')}, 6) AS combined FROM sects LEFT JOIN bm USING (path) WHERE path IN ({SELF}, {START}, {TWINS[0]}, {TWINS[1]}) ORDER BY combined DESC, path, line_start, line_end, heading LIMIT 20", "sects bm", MD_CTE),
    "doc_ranking": sql(f"SELECT path, row_number() OVER (ORDER BY r)::INTEGER AS rank FROM (SELECT path, min(r) AS r FROM (SELECT path, row_number() OVER (ORDER BY combined DESC, path, line_start, line_end, heading) AS r FROM (SELECT path, heading, line_start, line_end, round(0.7::DOUBLE * score + 0.3::DOUBLE * {canon('path')}, 6) AS combined FROM sects JOIN (SELECT * FROM bm WHERE score > 0.01 ORDER BY score DESC, path LIMIT 20) USING (path))) WHERE r <= 20 GROUP BY path)", "bm sects", MD_CTE),
    "vocabulary_frequencies": sql("SELECT * FROM vfreq", "vfreq", MD_CTE),
    "common_terms": sql("SELECT * FROM vfreq ORDER BY term_freq DESC, doc_freq DESC, term LIMIT 10", "vfreq", MD_CTE),
    "vocabulary": sql(f"""SELECT rank, surface, term, doc_freq, term_freq FROM (SELECT *, row_number() OVER (ORDER BY doc_freq DESC, term_freq DESC, first_path, term) AS rank FROM (
        SELECT f.*, coalesce(s1, s2) AS surface FROM vfreq f
        LEFT JOIN (SELECT {stem('word')} AS term, arg_min(word, (path, line, idx, word)) AS s1 FROM hwords GROUP BY 1) USING (term)
        LEFT JOIN (SELECT {stem('term')} AS term, arg_min(term, (path, term)) AS s2 FROM kw GROUP BY 1) USING (term))
        WHERE surface IS NOT NULL AND surface NOT IN {_in(K.VOCABULARY_STOP)} AND term NOT IN {_in(K.VOCABULARY_STOP)}) WHERE rank <= 100""", "vfreq hwords kw", MD_CTE),
    "section_fingerprints": sql(f"SELECT s.path, s.heading, s.level, s.line_start, s.line_end, coalesce(sim_lo, 0) AS sim_lo, coalesce(sim_hi, 0) AS sim_hi FROM spans s LEFT JOIN (SELECT path, line_start, ({_bits('a')})::BIGINT AS sim_lo, ({_bits('b')})::BIGINT AS sim_hi FROM (SELECT path, line_start, {h32('s')} AS a, {h32('s', 9)} AS b FROM (SELECT path, line_start, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT path, line_start, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT path, line_start, {SHINGLE.format('content')} AS w FROM sects WHERE level > 0)))) GROUP BY path, line_start) USING (path, line_start)", "spans sects", MD_CTE),
    "near_sections": sql("SELECT path, line_start, (sum(n) FILTER (WHERE d <= 19) - 1)::BIGINT AS links, round(1 - min(d) FILTER (WHERE d <= 19 AND (d > 0 OR n > 1)) / 64.0::DOUBLE, 6) AS best FROM (SELECT q.path, q.line_start, v.n, bit_count(xor(q.sim_lo, v.sim_lo)) + bit_count(xor(q.sim_hi, v.sim_hi)) AS d FROM (SELECT f.* FROM fp f JOIN docs USING (path) WHERE doc_id % 20 = 0) q CROSS JOIN (SELECT sim_lo, sim_hi, count(*) AS n FROM fp GROUP BY ALL) v) GROUP BY path, line_start", "spans sects", MD_CTE, f"fp AS (SELECT path, line_start, ({_bits('a')})::BIGINT AS sim_lo, ({_bits('b')})::BIGINT AS sim_hi FROM (SELECT path, line_start, {h32('s')} AS a, {h32('s', 9)} AS b FROM (SELECT path, line_start, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT path, line_start, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT path, line_start, {SHINGLE.format('content')} AS w FROM sects WHERE level > 0)))) GROUP BY path, line_start)"),
    "bm25_topk_all": sql(f"SELECT query_id, path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path) AS r FROM (SELECT query_id, path, sum(times * idf * tf * {K.K1 + 1}::DOUBLE / (tf + {K.K1}::DOUBLE * ({1 - K.B}::DOUBLE + {K.B}::DOUBLE * doc_length / (SELECT avg(doc_length) FROM lens)))) AS score FROM qs JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (path) GROUP BY query_id, path) WHERE score > 0) WHERE r <= 10", "tf idf lens", RAW_CTE, f"qs AS (SELECT query_id, {stem('word')} AS term, count(*) AS times FROM (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '{K.WORD}'))) AS word FROM benchmark) WHERE length(word) >= 3 AND word NOT IN {_in(K.QUERY_STOP)} GROUP BY ALL)"),
    "index_build": sql("SELECT * FROM (VALUES ('docs', (SELECT count(*) FROM docs)), ('headings', (SELECT count(*) FROM heads)), ('links', (SELECT count(*) FROM lnk)), ('adr_refs', (SELECT count(*) FROM adr)), ('spans', (SELECT count(*) FROM spans)), ('sections', (SELECT count(*) FROM sects)), ('term_freq', (SELECT count(*) FROM tf)), ('doc_length', (SELECT count(*) FROM lens)), ('keyword_sets', (SELECT count(*) FROM kw)), ('postings', (SELECT count(*) FROM posts)), ('resolved_links', (SELECT count(*) FROM res WHERE NOT " + EXTERNAL + ")), ('edges', (SELECT count(*) FROM edges)), ('doc_metrics', (SELECT count(*) FROM docs)), ('section_metrics', (SELECT count(*) FROM spans)), ('simhash', (SELECT count(*) FROM docs)), ('minhash', (SELECT count(DISTINCT path) FROM kw)), ('section_fingerprints', (SELECT count(*) FROM spans))) t(name, rows)", "heads lnk adr spans sects tf lens kw posts res edges", MD_CTE),
    "consolidation": sql(f"""SELECT g.path, g.canonical, coalesce(similarity, 0) AS similarity FROM (SELECT node AS path, first_value(node) OVER (PARTITION BY root ORDER BY {canon('node')} DESC, node) AS canonical FROM comp) g
        LEFT JOIN (SELECT c, round(avg(combined), 6) AS similarity FROM (SELECT path1 AS c, combined FROM d UNION ALL SELECT path2, combined FROM d) GROUP BY c) m ON m.c = g.canonical""",
        "dup", RAW_CTE, "d AS (SELECT * FROM dup WHERE combined >= 0.7), nb AS (SELECT path1 AS a, path2 AS b FROM d UNION SELECT path2, path1 FROM d), reach AS (SELECT a, a AS b FROM nb UNION SELECT reach.a, nb.b FROM reach JOIN nb ON nb.a = reach.b), comp AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"),
    "section_search": sql(f"SELECT path, heading, line_start, line_end, round(score, 6) AS bm25, {canon('path')} AS canonicality, round(0.7::DOUBLE * score + 0.3::DOUBLE * {canon('path')}, 6) AS combined FROM sects JOIN (SELECT * FROM bm WHERE score > 0.01 ORDER BY score DESC, path LIMIT 20) USING (path) ORDER BY combined DESC, path, line_start, line_end, heading LIMIT 20", "bm sects", MD_CTE),
    "sentence_scores": sql(
        "SELECT path, nth, round(" + " + ".join(
            [f"CASE WHEN contains(lower(s), '{t}') THEN 2.0::DOUBLE ELSE 0 END" for t in ("the", "que")] + [f"CASE WHEN contains(lower(s), '{t}') THEN 1.5::DOUBLE ELSE 0 END" for t in K.DOMAIN]
            + ["CASE WHEN " + " OR ".join(f"contains(s, '{c}')" for c in K.CODE_CUES) + " THEN 3.0::DOUBLE ELSE 0 END", "CASE WHEN nth = 0 THEN 0.3::DOUBLE ELSE 0 END"]
        ) + ", 6) AS score FROM (SELECT path, unnest(range(len(l)))::INTEGER AS nth, unnest(l) AS s FROM (SELECT path, list_filter(list_transform(regexp_split_to_array(content, '[.!?]'), lambda x: regexp_replace(x, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')), lambda s: strlen(s) > 10 AND regexp_matches(s, '^[A-Za-z0-9#]')) AS l FROM docs))", ""),
    "dedupe_content": sql("SELECT rank FROM (SELECT rank, k, row_number() OVER (PARTITION BY k ORDER BY rank) AS r FROM (SELECT doc_id AS rank, trim(regexp_replace(content, '[ \\t\\n\\r]+', ' ', 'g')) AS k FROM docs)) WHERE r = 1 OR k = ''", ""),
    "budget_prefix": sql("SELECT source, rank, used FROM (SELECT source, doc_id AS rank, sum(floor(strlen(text) / 4)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 8000", ""),
    "ranking_metrics": sql("SELECT question_id, k, round(coalesce(hits, 0) / k, 6) AS precision, round(coalesce(hits, 0) / n_rel, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, k) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM base LEFT JOIN gain USING (question_id, k)", "", RAW_CTE, _metrics_extra()),
}
