"""More views and helpers."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import ml as ML
from quarry.operators import rollups, textops as TX, trust as TR, views as V
from quarry.plans.cascade_q import CASCADE_SQL, cascade_record
from quarry.plans.core import rec
from quarry.plans.registry import finalize, query
from quarry.plans import sqlbase as S
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.plans.trust_q import INTER_SQL
from quarry.sources import testmap
from quarry.sources.tables import load


@query("a67_trial_state_rollup", ENH + """
, site AS (SELECT study_id, site_id, count(*) AS patients, avg(dqi_score) AS site_dqi,
  avg(CAST(tier2_clean AS DOUBLE)) AS site_clean_rate, avg(CAST(dblock_tier1_ready AS DOUBLE)) AS site_ready_rate FROM elock GROUP BY ALL)
SELECT study_id, count(*) AS sites, CAST(sum(patients) AS BIGINT) AS patients, round(avg(site_dqi), 6) AS mean_site_dqi,
  round(min(site_dqi), 6) AS worst_site_dqi, round(avg(site_clean_rate), 6) AS mean_site_clean_rate,
  round(avg(site_ready_rate), 6) AS mean_site_ready_rate, count(*) FILTER (WHERE site_dqi < 75) AS sites_below_75
FROM site GROUP BY study_id""")
def q_a67(spark, sf):
    return finalize(rollups.trial_state_rollup(enhanced_record(spark, sf)))


@query("o6_quick_wins", CASCADE_SQL + """
SELECT patient_key, site_id, round(cascade_impact_score, 6) AS cascade_impact_score, round(total_effort_hours, 6) AS total_effort_hours,
  round(cascade_impact_score / total_effort_hours, 6) AS impact_per_hour
FROM cascade WHERE total_effort_hours > 0 AND total_effort_hours <= 4.0 AND cascade_impact_score >= 30.0
ORDER BY cascade_impact_score / total_effort_hours DESC, patient_key ASC LIMIT 10""")
def q_o6(spark, sf):
    return finalize(V.quick_wins(cascade_record(spark, sf)))


@query("x6_hash_sample", S.with_record() + """
SELECT patient_key, site_id, risk_level FROM record ORDER BY md5(CAST(patient_key AS VARCHAR) || '|42'), patient_key LIMIT 100""")
def q_x6(spark, sf):
    return finalize(ML.hash_sample(rec(spark, sf).select("patient_key", "site_id", "risk_level"), "patient_key", 100))


@query("p26_p27_tags", f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TX.MENTION_PATTERN}', 1)) AS value, 'mention' AS tag_type FROM documents),
h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TX.HASHTAG_PATTERN}', 1)) AS value, 'topic' AS tag_type FROM documents)
SELECT doc_id, tag_type, value, CASE WHEN tag_type = 'mention' THEN '@' || value ELSE '#' || lower(value) END AS display_name
FROM (SELECT * FROM m UNION ALL SELECT * FROM h)""")
def q_p26(spark, sf):
    t = TX.extract_tags(load(spark, sf, "documents", ["doc_id", "text"]), "doc_id")
    return finalize(t.select("doc_id", "tag_type", "value", "display_name"))


_TFIDF = """
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
vo AS (SELECT term FROM g GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g JOIN vo USING (term) GROUP BY ALL),
ix AS (SELECT doc_id, tf.term, tf, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS weight FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) d ON d.term = tf.term)"""


@query("v10_tfidf_index", "WITH " + _TFIDF + """
SELECT doc_id, count(*) AS indexed_terms, (min({'w': -round(weight, 9), 'term': term})).term AS top_term, round(max(round(weight, 9)), 6) AS top_weight FROM ix GROUP BY 1""")
def q_v10(spark, sf):
    return finalize(TX.strongest_terms(TX.tfidf_index(load(spark, sf, "documents", ["doc_id", "text"]))))


@query("v10_tfidf_weights", "WITH " + _TFIDF + " SELECT doc_id, term, tf, round(weight, 6) AS weight FROM ix")
def q_v10_weights(spark, sf):
    return finalize(TX.tfidf_index(load(spark, sf, "documents", ["doc_id", "text"])))


_SIG = """
sig AS (
  SELECT event_id, agent_name, timestamp, 'negative' AS signal_type, 1.0 AS strength FROM x WHERE outcome = 'rejected'
  UNION ALL SELECT event_id, agent_name, timestamp, 'calibration', 0.6 FROM x WHERE outcome = 'rejected' AND time_to_decision_seconds < 30
  UNION ALL SELECT event_id, agent_name, timestamp, 'partial', 0.5 FROM x WHERE outcome = 'accepted_modified'
  UNION ALL SELECT event_id, agent_name, timestamp, 'positive', 0.3 FROM x WHERE outcome = 'accepted'
  UNION ALL SELECT event_id, agent_name, timestamp, 'negative', 0.8 FROM x WHERE outcome = 'overridden'
  UNION ALL SELECT event_id, agent_name, timestamp, 'policy_review', 0.4 FROM x WHERE outcome = 'overridden')"""


@query("d42_learning_signals", "WITH " + INTER_SQL + "," + _SIG + """
SELECT event_id, agent_name, timestamp, signal_type, round(strength, 6) AS strength FROM sig""")
def q_d42(spark, sf):
    return finalize(TR.learning_signals(testmap.interactions(spark, sf)))


@query("a38_signal_summary", "WITH " + INTER_SQL + "," + _SIG + """
SELECT agent_name, signal_type, count(*) AS signals, round(avg(strength), 6) AS avg_strength FROM sig GROUP BY ALL""")
def q_a38(spark, sf):
    return finalize(TR.signal_summary(TR.learning_signals(testmap.interactions(spark, sf))))
