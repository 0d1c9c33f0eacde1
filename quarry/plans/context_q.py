"""Sections and headers of documents, context of entities."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import issues as IS
from quarry.operators import sections as SE
from quarry.plans.collab_q import ISSUES_SQL, LOG_SQL
from quarry.plans.issues_q import issue_record
from quarry.plans.patterns_q import MATCH_SQL, site_patterns
from quarry.plans.registry import finalize, query
from quarry.sources import testmap
from quarry.sources.tables import load

_DEEP = (f"CASE WHEN regexp_matches(t, '{SE.MARKED}') THEN length(regexp_extract(t, '^#+')) "
          f"WHEN regexp_matches(t, '{SE.NUMBERED}') THEN len(string_split(regexp_extract(t, '^\\d+(?:\\.\\d+)*'), '.')) WHEN regexp_matches(t, '{SE.CAPITALS}') THEN 1 END")
_LEVEL = f"CASE WHEN {_DEEP} > {SE.LEVELS} THEN {SE.LEVELS} ELSE {_DEEP} END"
_TITLE = "regexp_replace(trim(regexp_replace(t, '^(?:#{1,6}|\\d+(?:\\.\\d+)*[.)]?)\\s+', '')), ':$', '')"
#: Pages as lines, their headings marked; the documents have no headings of their own.
_PAGE = "regexp_replace(regexp_replace(html, '<h1[^>]*>', chr(10) || '# ', 'g'), '<[^>]+>', chr(10), 'g')"
SECTIONS_SQL = f"""
WITH pg AS (SELECT page_id AS doc_id, {_PAGE} AS text FROM pages),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM pg WHERE length(text) > 0),
lv AS (SELECT *, {_LEVEL} AS level, {_TITLE} AS title, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS e FROM ls),
sc AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM lv),
se AS (SELECT doc_id, section, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN title END) AS title, min(e - length(t) - 1) AS f, max(e) - 1 AS z, md5(string_agg(t, chr(10) ORDER BY line)) AS text_md5 FROM sc GROUP BY ALL),
hd AS (SELECT * FROM se WHERE level IS NOT NULL),
up AS (SELECT a.doc_id, a.section, string_agg(b.title, ' > ' ORDER BY b.section) AS path FROM hd a JOIN hd b ON b.doc_id = a.doc_id AND b.section <= a.section AND (b.level < a.level OR b.section = a.section)
  WHERE NOT EXISTS (SELECT 1 FROM hd c WHERE c.doc_id = a.doc_id AND c.section > b.section AND c.section < a.section AND c.level <= b.level) GROUP BY ALL)
SELECT se.doc_id, CAST(se.section AS BIGINT) AS section, CAST(level AS BIGINT) AS level, title, coalesce(path, '') AS path, CAST(f AS BIGINT) AS "from", CAST(z AS BIGINT) AS "to", text_md5
FROM se LEFT JOIN up ON up.doc_id = se.doc_id AND up.section = se.section"""


@query("v3_sections", SECTIONS_SQL)
def q_v3(spark, sf):
    text = F.regexp_replace(F.regexp_replace("html", "<h1[^>]*>", "\n# "), "<[^>]+>", "\n")
    s = SE.sections(load(spark, sf, "pages", ["page_id", "html"]).select(F.col("page_id").alias("doc_id"), text.alias("text")))
    return finalize(s.select("doc_id", "section", "level", "title", F.array_join("path", " > ").alias("path"), "from", "to", F.md5("text").alias("text_md5")))


@query("v3_section_chunks")
def q_v3_chunks(spark, sf):
    c = SE.section_chunks(load(spark, sf, "documents", ["doc_id", "text"]))
    return finalize(c.select("doc_id", "section", F.array_join("path", " > ").alias("path"), "chunk_index", "char_count", F.md5("chunk").alias("chunk_md5")))


def _fragments(spark, sf):
    """What issue flags, the registry, status changes and site patterns say of
    patients, sites and studies."""
    who = testmap.spine(spark, sf).select("subject_key", "patient_key", "study_id", "site_id")

    def of_all(df, rank, text):
        ids = F.array(F.concat(F.lit("patient:"), "patient_key"), F.concat(F.lit("site:"), "study_id", F.lit("|"), "site_id"), F.concat(F.lit("study:"), "study_id"))
        return df.select(F.explode(ids).alias("entity"), rank.alias("rank"), text.alias("text"))

    rows = IS.issue_rows(issue_record(spark, sf), ("patient_key", "study_id", "site_id"))
    tickets = testmap.issues(spark, sf).join(who, "subject_key")
    days = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    last = testmap.status_log(spark, sf).join(tickets.select("issue_id", "patient_key", "study_id", "site_id"), "issue_id")
    patterns = site_patterns(spark, sf).select(F.concat(F.lit("site:"), "study_id", F.lit("|"), "entity_id").alias("entity"), F.round("confidence", 4).alias("rank"), F.col("pattern_name").alias("text"))
    return {"issues": of_all(rows, F.round("severity", 4), F.col("issue_type")),
            "tickets": of_all(tickets, days("created_at"), F.concat_ws(" ", "title", "status", "priority")),
            "changes": of_all(last, days("ts"), F.concat_ws(" ", F.col("issue_id").cast("string"), F.col("seq").cast("string"), "status")),
            "patterns": patterns}


_IDS = "unnest(['patient:' || patient_key, 'site:' || study_id || '|' || site_id, 'study:' || study_id]) AS entity"
_IR = " UNION ALL ".join(f"SELECT {_IDS}, 0 AS nth, 'issues' AS kind, round(CAST(severity_{t} AS DOUBLE), 4) AS rank, '{t}' AS text FROM iss WHERE issue_{t} = 1" for t in IS.TYPES)


@query("j20_entity_context", MATCH_SQL + "," + ISSUES_SQL + "," + LOG_SQL + f""",
tk AS (SELECT i.*, patient_key, study_id, site_id FROM issues i JOIN spine USING (subject_key)),
fr AS ({_IR}
  UNION ALL SELECT {_IDS}, 1, 'tickets', date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)), concat_ws(' ', title, status, priority) FROM tk
  UNION ALL SELECT {_IDS}, 2, 'changes', date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)), concat_ws(' ', issue_id, seq, slog.status) FROM slog JOIN tk USING (issue_id)
  UNION ALL SELECT 'site:' || study_id || '|' || entity_id, 3, 'patterns', round(confidence, 4), pattern_name FROM matches),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity, nth ORDER BY rank DESC NULLS LAST, text) AS place, count(*) OVER (PARTITION BY entity, nth) AS n FROM fr),
kd AS (SELECT entity, nth, kind, any_value(n) AS n, string_agg(text, '; ' ORDER BY place) AS texts FROM rk WHERE place <= 5 GROUP BY ALL)
SELECT entity, CAST(sum(n) AS BIGINT) AS fragments, count(*) AS kinds, string_agg(kind || ' (' || n || '): ' || texts, chr(10) ORDER BY nth) AS context FROM kd GROUP BY 1""")
def q_j20(spark, sf):
    return finalize(SE.entity_context(_fragments(spark, sf)))
