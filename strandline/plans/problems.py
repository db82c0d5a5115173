"""Queries of the general problems (3 and 6)."""

from __future__ import annotations

from strandline.operators import instants, replay
from strandline.session import table


def p3_found(spark, sf_dir):
    return replay.found(table(spark, sf_dir, "ledger"))


def p3_standing_claims(spark, sf_dir):
    """The standing claims with their content."""
    return replay.replay(replay.applicable(table(spark, sf_dir, "ledger")))


def p6_found(spark, sf_dir):
    return instants.found(table(spark, sf_dir, "message"), table(spark, sf_dir, "evidence"), table(spark, sf_dir, "source_index"), instants.kept_dictionary(spark))


QUERIES = {"p3_found": p3_found, "p3_standing_claims": p3_standing_claims, "p6_found": p6_found}

_CONTENT = ", ".join(f"arg_max({c}, ord) FILTER ({c} IS NOT NULL) AS {c}" for c in replay.CONTENT)

SQL = {
    "p3_standing_claims": f"""
        WITH e AS (SELECT *, lower(trim(event_type)) AS kind FROM ledger WHERE event_id IS NOT NULL AND created_at IS NOT NULL AND lower(trim(event_type)) IN ('correction', 'undo')),
        f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ledger_line) AS rn FROM e),
        k AS (SELECT * EXCLUDE (rn), CAST(created_at AS TIMESTAMPTZ) AS instant, CASE kind WHEN 'undo' THEN regexp_replace(target_claim_id, ':(assert|retract)$', '') ELSE claim_id END AS claim FROM f WHERE rn = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY slug, claim ORDER BY instant, ledger_line) AS ord FROM k WHERE claim IS NOT NULL),
        d AS (SELECT slug, claim, coalesce(max(ord) FILTER (kind = 'undo'), 0) AS dropped FROM o GROUP BY ALL),
        s AS (SELECT o.* FROM o JOIN d ON o.slug IS NOT DISTINCT FROM d.slug AND o.claim = d.claim WHERE kind = 'correction' AND ord > dropped)
        SELECT slug, claim AS claim_id, arg_max(event_id, ord) AS event_id, epoch_us(arg_max(instant, ord)) AS at_us, arg_max(ledger_line, ord) AS ledger_line, {_CONTENT} FROM s GROUP BY slug, claim""",
    "p3_found": """
        WITH e AS (SELECT *, lower(trim(event_type)) AS kind FROM ledger
                   WHERE event_id IS NOT NULL AND created_at IS NOT NULL AND lower(trim(event_type)) IN ('correction', 'undo')),
        f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ledger_line) AS rn FROM e),
        k AS (SELECT slug, event_id, kind, ledger_line, CAST(created_at AS TIMESTAMPTZ) AS instant,
                     CASE kind WHEN 'undo' THEN regexp_replace(target_claim_id, ':(assert|retract)$', '') ELSE claim_id END AS claim
              FROM f WHERE rn = 1),
        l AS (SELECT *, row_number() OVER (PARTITION BY slug, claim ORDER BY instant DESC, ledger_line DESC) AS rn FROM k WHERE claim IS NOT NULL)
        SELECT claim AS claim_id, event_id FROM l WHERE rn = 1 AND kind = 'correction'""",
}
