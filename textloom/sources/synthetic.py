"""Two corpora made of the documents table: raw texts under paths, and the same texts as linked Markdown.

The expressions are SQL that Spark and DuckDB both read, so the oracle sees the same corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS = ("docs/adr/ADR-{adr}-{id}.md", "docs/architecture/overview-{id}.md", "archive/notes-{id}.md", "docs/guides/setup-{id}-guide.md", "docs/runbooks/ops-{id}.md", "src/module-{id}/README.md", "scratch/draft-{id}.txt", "docs/design/design-{id}.md", "docs/index/topic-{id}.md", "notes/page-{id}.rst")
BLOCK = 200  # a document's links lead into its block of so many
#: Old paths that links name, and what became of them, the oldest first.
RENAMES = (("docs/adr/missing-4.md", "docs/adr/moved-4.md"), ("docs/runbooks/missing-8.md", "docs/guides/setup-3-guide.md"), ("docs/adr/moved-4.md", "docs/design/design-7.md"), ("docs/index/missing-4.md", "docs/index/gone.md"))


def path_sql(k: str) -> str:
    """Some of the archived notes are old versions of a topic: two documents of one name."""

    def one(p: str) -> str:
        parts = p.replace("{adr}", f"' || lpad(CAST({k} % 1000 AS STRING), 3, '0') || '").replace("{id}", f"' || CAST({k} AS STRING) || '")
        return f"'{parts}'"

    return f"CASE WHEN {k} % 30 = 2 THEN 'archive/topic-' || CAST({k} + 6 AS STRING) || '.md' " + " ".join(f"WHEN {k} % 10 = {i} THEN {one(p)}" for i, p in enumerate(PATHS)) + " END"


def _target_sql(i: str, k: str) -> str:
    up = f"CASE WHEN {k} % 10 IN (2, 6, 9) THEN '../' ELSE '../../' END"
    base = f"({k} - {k} % {BLOCK})"
    to = f"({path_sql(f'({base} + (7 * {k} + {i}) % {BLOCK})')})"
    return f"""CASE ({k} + {i}) % 12
      WHEN 0 THEN 'missing-' || CAST({i} AS STRING) || '.md'
      WHEN 1 THEN 'https://example.org/' || CAST({i} AS STRING)
      WHEN 2 THEN '#overview'
      WHEN 3 THEN '/' || {to}
      WHEN 4 THEN 'TODO'
      WHEN 5 THEN 'src/app-' || CAST({i} AS STRING) || '.py'
      WHEN 6 THEN {up} || {to} || '#overview'
      WHEN 7 THEN 'topic-' || CAST({base} + 8 + 10 * (({k} + {i}) % 20) AS STRING) || '.md#overview'
      WHEN 8 THEN {up} || ({path_sql(f'(({base} + ({k} % 3)))')})
      ELSE {up} || {to} END"""


def line_sql(x: str, i: str, k: str) -> str:
    """What becomes of line i: the text stays whole."""
    nl = "chr(10)"
    return f"""CASE
      WHEN {i} = 0 THEN '# ' || {x}
      WHEN {i} % 4 = 0 THEN '## ' || CASE ({k} + {i}) % 6 WHEN 0 THEN 'Part ' || CAST({i} AS STRING) || ' ' WHEN 1 THEN 'Completed ' WHEN 2 THEN 'Changelog ' WHEN 3 THEN 'Overview' || {nl} ELSE 'About ' END
        || {x} || {nl} || 'See [topic ' || CAST({i} AS STRING) || '](' || {_target_sql(i, k)} || ') for more.'
      WHEN {i} % 7 = 5 THEN '- ' || {x}
      WHEN {i} % 11 = 6 THEN '```' || {nl} || {x}
      WHEN {i} % 9 = 3 THEN {x} || ' Decided in ADR-' || lpad(CAST(({k} + {i}) % 200 AS STRING), 3, '0') || '.'
      WHEN {i} % 13 = 8 THEN 'Status: ' || {x}
      ELSE {x} END"""


def front_sql(k: str) -> str:
    return f"CASE WHEN {k} % 6 = 0 THEN '---' || chr(10) || 'title: doc' || chr(10) || 'owner: team' || chr(10) || '---' || chr(10) ELSE '' END"


def raw_corpus(documents: DataFrame) -> DataFrame:
    """path, content, doc_id."""
    return documents.select(F.expr(path_sql("doc_id")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


def markdown_corpus(documents: DataFrame) -> DataFrame:
    """path, content, doc_id."""
    body = f"array_join(transform(split(coalesce(text, ''), '\\n', -1), (x, i) -> {line_sql('x', 'i', 'doc_id')}), chr(10))"
    # a generator of one row: what reads content many times doesn't write its expression out as often
    return documents.select(F.expr(path_sql("doc_id")).alias("path"), F.explode(F.array(F.expr(f"{front_sql('doc_id')} || {body}"))).alias("content"), "doc_id")


RAW_CTE = f"docs AS (SELECT {path_sql('doc_id')} AS path, coalesce(text, '') AS content, doc_id FROM documents)"
MD_CTE = f"docs AS (SELECT {path_sql('doc_id')} AS path, {front_sql('doc_id')} || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, j: {line_sql('x', '(j - 1)', 'doc_id')}), chr(10)) AS content, doc_id FROM documents)"
