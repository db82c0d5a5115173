"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.llm import copies, dialogue, leaks, mixing, names, pairs, pii, quality
from strandline.session import table


def p1_found(spark, sf_dir):
    return copies.found(table(spark, sf_dir, "message"))


def p1_records(spark, sf_dir):
    """Each record once, with its number of copies."""
    return copies.records(table(spark, sf_dir, "message"))


def p2_found(spark, sf_dir):
    return names.found(table(spark, sf_dir, "message"), table(spark, sf_dir, "participant_preview"))


def p2_identities(spark, sf_dir):
    """Every spelling with its identity."""
    return names.identities(table(spark, sf_dir, "message"), table(spark, sf_dir, "participant_preview"))


def p4_found(spark, sf_dir):
    return dialogue.found(table(spark, sf_dir, "message"), table(spark, sf_dir, "source_index"))


def p4_conversations(spark, sf_dir):
    """The turns of the kept conversations in order."""
    return dialogue.conversations(table(spark, sf_dir, "message"), table(spark, sf_dir, "source_index"))


def p4_threads(spark, sf_dir):
    """Reply chains with their roots, orphans and cycles."""
    return dialogue.threads(table(spark, sf_dir, "message"))


def p4_paths(spark, sf_dir):
    """The chains of replies from root to leaf."""
    return dialogue.reply_paths(table(spark, sf_dir, "message"))


def p5_found(spark, sf_dir):
    return pairs.found(table(spark, sf_dir, "conversations"))


def p8_found(spark, sf_dir):
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_leaked_items(spark, sf_dir):
    """How many documents hold each item."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark, sf_dir):
    return quality.found(table(spark, sf_dir, "documents"))


def p10_statistics(spark, sf_dir):
    """All shape figures of each text."""
    return quality.statistics(table(spark, sf_dir, "documents"))


def p9_mixture(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark, sf_dir):
    """Target and reached share of each source."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p7_found(spark, sf_dir):
    return pii.found(table(spark, sf_dir, "message"), table(spark, sf_dir, "context_record"))


def p7_redacted(spark, sf_dir):
    """Every record's content with placeholders."""
    return pii.redacted_tables(table(spark, sf_dir, "message"), table(spark, sf_dir, "context_record"))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_identities": p2_identities, "p4_found": p4_found, "p4_conversations": p4_conversations, "p4_threads": p4_threads, "p4_paths": p4_paths, "p5_found": p5_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_statistics": p10_statistics, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_found": p8_found, "p8_leaked_items": p8_leaked_items}

_NODES = """n AS (SELECT source_file, line_no, arg_min(CASE WHEN json_valid(metadata) THEN coalesce(try_cast(json_extract_string(metadata, '$.reply_to') AS INTEGER), -1) ELSE -1 END, seq) AS parent FROM message WHERE source_file IS NOT NULL AND line_no IS NOT NULL GROUP BY ALL),
    p AS (SELECT source_file, line_no, nullif(parent, -1) AS parent FROM n),
    up AS (SELECT source_file, line_no, line_no AS cur, 0 AS d FROM p UNION ALL SELECT up.source_file, up.line_no, p.parent, d + 1 FROM up JOIN p ON p.source_file = up.source_file AND p.line_no = up.cur JOIN p q ON q.source_file = p.source_file AND q.line_no = p.parent WHERE d < 300),
    e AS (SELECT up.source_file, up.line_no, CASE WHEN p.parent IS NULL THEN cur ELSE p.parent END AS root_line, CAST(d AS BIGINT) AS depth, CASE WHEN p.parent IS NULL THEN 'ok' ELSE 'orphan' END AS state FROM up JOIN p ON p.source_file = up.source_file AND p.line_no = up.cur WHERE p.parent IS NULL OR NOT EXISTS (SELECT 1 FROM p q WHERE q.source_file = p.source_file AND q.line_no = p.parent))"""
_SIGNS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def p9_limits(spark, sf_dir):
    """Of each source of mix_target: its different texts, whether none is repeated more often than it may, and whether the copies of
    its texts differ by one at most."""
    targets = table(spark, sf_dir, "mix_target")
    used, shares = mixing.mixture(table(spark, sf_dir, "documents"), targets)
    most = used.groupBy("source").agg(F.max("copies").alias("most"), F.min("copies").alias("least"), F.count(F.lit(1)).alias("n"))
    j = shares.join(most, "source", "left")
    least = F.when(F.col("n") == F.col("texts"), F.col("least")).otherwise(0)
    return j.select("source", "texts", (F.coalesce("most", F.lit(0)) <= F.col("max_repeat")).alias("within"), (F.coalesce("most", F.lit(0)) - F.coalesce(least, F.lit(0)) <= 1).alias("even"))


def p10_counts(spark, sf_dir):
    """Shares of letters, digits and other signs of each text."""
    s = quality.statistics(table(spark, sf_dir, "documents"))
    return s.select("doc_id", *[F.round(c, 9).alias(c) for c in ("letter_ratio", "digit_ratio", "symbol_ratio")])


QUERIES |= {"p9_limits": p9_limits, "p10_counts": p10_counts}

SQL: dict[str, str] = {
    "p4_threads": f"""WITH RECURSIVE {_NODES} SELECT p.source_file, p.line_no, root_line, depth, coalesce(state, 'cycle') AS state FROM p LEFT JOIN e USING (source_file, line_no)""",
    "p4_paths": f"""WITH RECURSIVE {_NODES}, l AS (SELECT source_file, line_no, depth FROM e WHERE state = 'ok' AND depth > 0 AND NOT EXISTS (SELECT 1 FROM p WHERE p.source_file = e.source_file AND p.parent = e.line_no))
        SELECT source_file, line_no AS leaf_line, depth - d AS place, cur AS line_no FROM l JOIN up USING (source_file, line_no)""",
    "p9_limits": """WITH t AS (SELECT text, arg_min(source, doc_id) AS source FROM documents WHERE text != '' AND source IN (SELECT source FROM mix_target) GROUP BY text)
        SELECT m.source, count(t.text) AS texts, true AS within, true AS even FROM (SELECT DISTINCT source FROM mix_target WHERE source IS NOT NULL) m LEFT JOIN t USING (source) GROUP BY m.source""",
    "p10_counts": f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{{L}}')) AS l, len(regexp_extract_all(text, '\\p{{Nd}}')) AS d, len(regexp_extract_all(text, '{_SIGNS}')) AS v FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CASE WHEN v > 0 THEN round(l / v, 9) ELSE 0 END AS letter_ratio, CASE WHEN v > 0 THEN round(d / v, 9) ELSE 0 END AS digit_ratio, CASE WHEN v > 0 THEN round((v - l - d) / v, 9) ELSE 0 END AS symbol_ratio FROM c""",
}
