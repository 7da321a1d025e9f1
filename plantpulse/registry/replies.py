"""Explanation texts (2.J), made from every conversation turn in five states of disrepair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as P
from . import dataset as D
from .common import query, r

_LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _replies(spark, sf):
    rows = D.table(spark, sf, "conversations")
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    body = F.concat(F.lit('{"summary": "'), line, F.lit('", "insights": ["'), F.substring(line, 1, 20), F.lit('"], "false_positive_risk": "high", "confidence": 0.62}'))
    partial = F.concat(F.lit('{"summary": "'), line, F.lit('",\n"insights": ["Alfa", "alfa ", "'), F.substring(line, 1, 12), F.lit('"],\n"confidence": 0.61'))
    cut = F.concat(F.lit('{"observations": ["'), F.substring(line, 1, 30), F.lit('"], "false_positive_risk": "sure", "recommended_actions": ["um", "dois"'))
    reply = (F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(kind == 2, F.concat(F.lit("Segue: "), body, F.lit(" fim."))).when(kind == 3, partial).otherwise(cut))
    return rows.select("conv_id", "turn", kind.alias("kind"), line.alias("line"), reply.alias("reply"))


_BASE = f"""
c AS (SELECT conv_id, turn, text, (conv_id + turn) % 5 AS kind, {_LINE} AS line FROM conversations),
tidy AS (SELECT *, regexp_replace(line, '^[ ,]+|[ ,]+$', '', 'g') AS t FROM c),
cut AS (SELECT *, CASE WHEN length(t) > 700 THEN left(t, 700) || '...' ELSE t END AS s, regexp_replace(substr(line, 1, 12), '^[ ,]+|[ ,]+$', '', 'g') AS i12,
  regexp_replace(substr(line, 1, 30), '^[ ,]+|[ ,]+$', '', 'g') AS o30 FROM tidy)"""


@query("j1_fence_and_object", f"""
WITH {_BASE}
SELECT conv_id, turn, CASE kind WHEN 1 THEN '{{"summary": "' || line || '", "insights": ["' || substr(line, 1, 20) || '"], "false_positive_risk": "high", "confidence": 0.62}}'
  WHEN 2 THEN '{{"summary": "' || line || '", "insights": ["' || substr(line, 1, 20) || '"], "false_positive_risk": "high", "confidence": 0.62}}' ELSE '' END AS object FROM cut""")
def fence_and_object(spark, sf):
    rows = _replies(spark, sf)
    return rows.select("conv_id", "turn", F.coalesce(P.cut_object(P.strip_fence(F.col("reply"))), F.lit("")).alias("object"))


_FINISH = ("CASE WHEN regexp_matches(s, '[.!?]$') THEN s WHEN length(s) >= 90 THEN regexp_replace(s, '[ ,;]+$', '') || '" + P.PARTIAL_ENDING +
           "' ELSE regexp_replace(s, '[ ,;]+$', '') || '.' END")
_PLAIN = "CASE WHEN length(line) > 900 THEN left(line, 900) || '...' WHEN length(line) > 0 THEN line ELSE '" + P.NOTHING_USABLE + "' END"


@query("j2_j4_parsed_replies", f"""
WITH {_BASE}
SELECT conv_id, turn, CASE kind WHEN 0 THEN 'plain' WHEN 1 THEN 'whole' WHEN 2 THEN 'embedded' ELSE 'salvaged' END AS reply_kind,
  CASE kind WHEN 0 THEN {_PLAIN} WHEN 1 THEN line WHEN 2 THEN line WHEN 3 THEN {_FINISH} ELSE '{P.PARTIAL_SUMMARY}' END AS summary,
  CASE kind WHEN 0 THEN '' WHEN 1 THEN substr(line, 1, 20) WHEN 2 THEN substr(line, 1, 20)
    WHEN 3 THEN CASE WHEN length(i12) = 0 OR lower(i12) = 'alfa' THEN 'Alfa' ELSE 'Alfa|' || i12 END ELSE '' END AS insights,
  CASE kind WHEN 0 THEN '{P.PLAIN_NOTE}' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '{P.PARTIAL_NOTE}' ELSE o30 || '|{P.PARTIAL_NOTE}' END AS observations,
  CASE kind WHEN 1 THEN 'high' WHEN 2 THEN 'high' ELSE 'medium' END AS risk,
  CASE kind WHEN 0 THEN 0.35e0 WHEN 1 THEN 0.62e0 WHEN 2 THEN 0.62e0 WHEN 3 THEN 0.61e0 ELSE 0.45e0 END AS confidence,
  CASE kind WHEN 0 THEN '{P.PLAIN_ACTION}' WHEN 4 THEN 'um|dois' ELSE '' END AS actions FROM cut""")
def parsed_replies(spark, sf):
    rows = _replies(spark, sf).withColumn("c", P.classified_reply(F.col("reply"), P.FIELD_LIMIT, P.PLAIN_LIMIT)).withColumn("p", F.col("c.reply"))
    joined = lambda c: F.array_join(f"p.{c}", "|")
    return rows.select("conv_id", "turn", F.col("c.kind").alias("reply_kind"), F.col("p.summary").alias("summary"), joined("insights").alias("insights"),
                       joined("observations").alias("observations"), F.col("p.false_positive_risk").alias("risk"), r(F.col("p.confidence"), 4, "confidence"),
                       joined("recommended_actions").alias("actions"))


@query("j3_salvaged_fields", f"""
WITH {_BASE}
SELECT conv_id, turn, coalesce(CASE WHEN kind IN (1, 2, 3) THEN nullif(s, '') END, '') AS summary, CASE WHEN kind IN (1, 2) THEN 0.62e0 WHEN kind = 3 THEN 0.61e0 ELSE -1e0 END AS confidence,
  CASE WHEN kind IN (1, 2) THEN 'high' ELSE 'medium' END AS risk FROM cut""")
def salvaged_fields(spark, sf):
    rows = _replies(spark, sf)
    reply = F.col("reply")
    return rows.select("conv_id", "turn", F.coalesce(P.text_field(reply, "summary", P.FIELD_LIMIT), F.lit("")).alias("summary"),
                       r(F.coalesce(P.number_field(reply, "confidence"), F.lit(-1.0)), 4, "confidence"), P.choice_field(reply, "false_positive_risk").alias("risk"))
