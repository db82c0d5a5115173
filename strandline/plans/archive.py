"""Queries of what an archive does with its messages: pages, contexts, corrections in answers, reconciliation; and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions.messages import collapse
from strandline.functions.text import progress
from strandline.operators import context, corrections, governance, graph, messages, pages, profiles, resolve, retrieval, wiki
from strandline.plans.core import _FIRST, _HASHED, _KEYED, _MEMBERS, _flat, _plain, _spaced, _strip, _words, ledger_sides, roled, unique
from strandline.session import shared_dir, table
from strandline.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where it can be put that way."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def busiest(spark, d):
    """(slug, persona): the sender of each archive with the most assistant messages, the smallest name on ties."""
    p = profiles.profiles(roled(spark, d), by=["slug"]).where("assistant_messages > 0")
    return p.groupBy("slug").agg(F.min_by("name", F.struct(-F.col("assistant_messages"), "key")).alias("persona"))


_PERSONA = f"""{_KEYED}, pr AS (SELECT slug, key, arg_min(who, seq) AS name, count(*) FILTER (role = 'assistant') AS n FROM k WHERE key != '' GROUP BY slug, key),
    pa AS (SELECT slug, name AS persona, {_strip("lower(name)")} AS pkey FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, key) AS rn FROM pr WHERE n > 0) WHERE rn = 1)"""
_EVIDENCE_ID = "concat_ws('-', regexp_replace(regexp_replace(lower(regexp_replace(source_file, '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), lpad(CAST(line_no AS VARCHAR), 6, '0'))"
_OWN = f"""{_PERSONA}, o0 AS (SELECT k.slug, role, content, timestamp, min(struct_pack(f := source_file, l := line_no)) AS p FROM k JOIN pa ON k.slug = pa.slug AND {_strip("lower(who)")} = pkey GROUP BY ALL),
    o1 AS (SELECT slug, role, content, timestamp, p.f AS source_file, p.l AS line_no FROM o0), o AS (SELECT *, {_EVIDENCE_ID} AS evidence_id, row_number() OVER (PARTITION BY slug ORDER BY coalesce(timestamp, ''), source_file, line_no, role, coalesce(content, '')) AS ord FROM o1)"""
_PICKED = ", ".join(f"coalesce(arg_min(evidence_id, -length(coalesce(content, '')) * 1e7 + ord) FILTER (regexp_matches(coalesce(content, ''), '{p.replace('(?iu)', '(?i)')}')), arg_min(evidence_id, ord)) AS {t}" for t, p in ((t, p.replace(r"\w*\b", r"[\w\p{L}]*").replace(r"\b(?:", r"(?:^|[^\p{L}\p{N}_])(?:").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")) for t, p in pages.PICKS.items()))
_FACTS = f"""{_OWN}, f AS (SELECT slug, count(*) AS messages, round(avg({_words("coalesce(content, '')")}), 6) AS mean_words, CAST(median({_words("coalesce(content, '')")}) AS DOUBLE) AS median_words, count(*) FILTER (contains(content, '?')) AS questions,
    arg_min(evidence_id, ord) AS first, arg_max(evidence_id, ord) AS last, min(nullif(timestamp, '')) AS first_seen, max(nullif(timestamp, '')) AS last_seen, {_PICKED} FROM o GROUP BY slug)"""


@query(f"WITH {_PERSONA} SELECT slug, persona FROM pa")
def q_personas(spark, d):
    return busiest(spark, d)


@query(f"WITH {_KEYED}, p AS (SELECT slug, key, arg_min(who, seq) AS name, count(*) FILTER (role = 'assistant') AS n FROM k WHERE key != '' GROUP BY slug, key) SELECT slug, CASE WHEN count(*) FILTER (n > 0) = 1 THEN min(name) FILTER (n > 0) END AS persona, count(*) FILTER (n > 0) AS n FROM p GROUP BY slug")
def q_only_persona(spark, d):
    return pages.personas(profiles.profiles(roled(spark, d), by=["slug"]))


@query(f"WITH {_OWN} SELECT slug, role, sha256(coalesce(content, '')) AS digest, timestamp, source_file, line_no, evidence_id FROM o")
def q_persona_messages(spark, d):
    o = pages.own_messages(roled(spark, d), busiest(spark, d))
    return o.select("slug", "role", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), "timestamp", "source_file", "line_no", "evidence_id")


@query(f"WITH {_FACTS} SELECT * FROM f")
def q_page_facts(spark, d):
    f = pages.facts(pages.own_messages(roled(spark, d), busiest(spark, d)))
    return f.select("slug", "messages", "mean_words", "median_words", "questions", "first", "last", "first_seen", "last_seen", *pages.PICKS)


_CITED = " UNION ALL ".join(
    f"SELECT slug, '{page}' AS page, CAST({len(cited)} + len(string_split(sources, ', ')) AS BIGINT) AS L1, {sum(x.count('[L2') for x in pages.BODIES[page])} AS L2, {sum(x.count('[L3') for x in pages.BODIES[page])} AS L3, 0 AS L4 FROM s" for page, (cited, _) in pages.PAGES.items()
)


@query(f"WITH {_OWN}, s AS (SELECT slug, string_agg(DISTINCT source_file, ', ') AS sources FROM o GROUP BY slug) {_CITED}")
def q_evidence_index(spark, d):
    of = busiest(spark, d)
    return pages.evidence_index(pages.render(pages.facts(pages.own_messages(roled(spark, d), of)), of))


@query(f"""SELECT DISTINCT target AS page, concat('# ', array_to_string(list_transform(string_split(translate(target, '-', ' '), ' '), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' '), chr(10), chr(10), '> (stub, to be filled)', chr(10), chr(10), '## Content', chr(10), chr(10), '## Sources', chr(10), chr(10), '## See also', chr(10)) AS text
    FROM (SELECT {_strip("t.target")} AS target FROM documents, unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) AS t(target) WHERE source = 'wiki') WHERE target NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE source = 'wiki')""")
def q_stub_pages(spark, d):
    return pages.stubs(wiki.broken_links(table(spark, d, "documents").where("source = 'wiki'").select(F.col("doc_id").cast("string").alias("page"), "text")))


# -- manual context ----------------------------------------------------------------------------------------------------


def context_blocks(spark, d):
    """Blocks as they would stand in a source: about half of them with a prefix that tells their kind, none from the kind column."""
    c = table(spark, d, "context_record").where("content is not null")
    # Some name a participant, for the table's own seldom do.
    someone = table(spark, d, "participant_preview").groupBy("slug").agg(F.min("name").alias("someone"))
    c = c.join(someone, "slug", "left").withColumn("content", F.when(F.pmod("record_id", F.lit(8)).isin(0, 1, 2), F.concat_ws(" ", "content", "someone")).otherwise(F.col("content")))
    prefix = F.element_at(F.array(*map(F.lit, ("Hecho: ", "", "NOTA: ", "", "Inferencia: ", "", "Assert: ", "Sin prefijo: "))), (F.pmod("record_id", F.lit(8)) + 1).cast("int"))
    return c.select("slug", F.col("record_id").alias("number"), F.concat(prefix, collapse(F.col("content"))).alias("block"))


_BLOCKS = f"""so AS (SELECT slug, min(name) AS someone FROM participant_preview GROUP BY slug), cr AS (SELECT slug, record_id, CASE WHEN record_id % 8 IN (0, 1, 2) THEN concat_ws(' ', content, someone) ELSE content END AS content FROM context_record LEFT JOIN so USING (slug) WHERE content IS NOT NULL),
    b AS (SELECT slug, record_id AS number, record_id % 8 AS r, {_flat("content")} AS body FROM cr),
    c AS (SELECT slug, number, CASE WHEN r IN (0, 6) THEN 'assertion' WHEN r = 4 THEN 'inference' ELSE 'freeform' END AS kind, CASE WHEN r IN (0, 6) THEN 'user_assertion' WHEN r = 4 THEN 'user_inference' ELSE 'user_context' END AS authority,
      CASE WHEN r IN (0, 2, 4, 6) THEN nullif(body, '') WHEN r = 7 THEN concat('Sin prefijo: ', body) ELSE body END AS content FROM b),
    t AS (SELECT *, concat(' ', regexp_replace({_plain("content")}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+', ' ', 'g'), ' ') AS t FROM c), n AS (SELECT DISTINCT slug, name, {_plain("name")} AS alias FROM participant_preview WHERE name IS NOT NULL),
    m AS (SELECT t.slug, number, count(DISTINCT name) AS named, min(name) AS one FROM t JOIN n ON t.slug = n.slug AND length(alias) >= 2 AND contains(t, {_spaced("alias")}) GROUP BY ALL),
    p AS (SELECT c.*, CASE WHEN named = 1 THEN one END AS subject, CASE WHEN content IS NULL THEN 'empty' WHEN named IS NULL THEN 'no participant' WHEN named > 1 THEN 'several participants' END AS problem FROM c LEFT JOIN m USING (slug, number)),
    h AS (SELECT *, substr(sha256(concat('user:', coalesce(content, ''), ':', {_strip("lower(coalesce(subject, ''))")}, ':', kind, ':', authority)), 1, 16) AS hash FROM p),
    v AS (SELECT *, min(number) OVER (PARTITION BY slug, hash) < number AS duplicate FROM h)"""


def context_preview(spark, d):
    n = table(spark, d, "participant_preview").where("name is not null").select("slug", "name", F.col("name").alias("alias")).distinct()
    return context.preview(context_blocks(spark, d), n, messages.hashed(roled(spark, d)), ["slug"])


@query(f"WITH {_BLOCKS} SELECT slug, number, kind, authority, subject, hash, duplicate, problem FROM v")
def q_context_preview(spark, d):
    return context_preview(spark, d).select("slug", "number", "kind", "authority", "subject", "hash", "duplicate", "problem")


@query(f"WITH {_BLOCKS} SELECT slug, kind, count(*) AS records FROM v WHERE NOT duplicate AND problem IS NULL GROUP BY slug, kind")
def q_context_kinds(spark, d):
    return context.kind_counts(context_preview(spark, d), ["slug"])


@query("SELECT CAST(record_id AS VARCHAR) AS path, CASE WHEN content IS NULL THEN 'empty' WHEN record_id % 5 = 0 THEN 'not UTF-8' WHEN record_id % 5 = 1 THEN 'binary' WHEN regexp_matches(content, '^[\\s\\x0b\\x{85}\\p{Z}]*$') THEN 'empty' END AS refused FROM context_record")
def q_context_refusals(spark, d):
    c = table(spark, d, "context_record").select(F.col("record_id").cast("string").alias("path"), F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("raw"), F.when(F.col("content").isNotNull(), F.pmod("record_id", F.lit(5))).alias("r"))
    raw = F.when(F.col("r") == 0, F.concat(F.unhex(F.lit("FFFE")), "raw")).when(F.col("r") == 1, F.concat("raw", F.unhex(F.lit("00")))).otherwise(F.col("raw"))
    return context.refusals(c.select("path", raw.alias("content")))


# -- corrections and answers ---------------------------------------------------------------------------------------------

_CLAIM = "substr(sha256(concat_ws('|', CASE WHEN {p}_predicate IN ('communicates_with','cousin_of','coworker_of','friend_of','romantic_partner','sibling_of','spouse_of') THEN least({a}, {b}) ELSE {a} END, {r}, CASE WHEN {p}_predicate IN ('communicates_with','cousin_of','coworker_of','friend_of','romantic_partner','sibling_of','spouse_of') THEN greatest({a}, {b}) ELSE {b} END)), 1, 16)".replace("{p}", "retract").replace("{a}", _strip("lower(retract_subject)")).replace("{b}", _strip("lower(retract_object)")).replace("{r}", _strip("lower(retract_predicate)"))
_STATUS = """u AS (SELECT regexp_replace(target_claim_id, ':(assert|retract)$', '') AS claim_id, arg_max(event_id, ledger_line) AS undo_event_id FROM ledger WHERE event_type = 'undo' AND event_id IS NOT NULL GROUP BY 1),
    st AS (SELECT c.*, CASE WHEN undo_event_id IS NULL THEN 'active' ELSE 'undone' END AS status FROM ledger c LEFT JOIN u USING (claim_id) WHERE event_type = 'correction' AND event_id IS NOT NULL)"""


@query(f"WITH {_STATUS} SELECT concat('base-', {_CLAIM}) AS retracted, count(*) AS n FROM st WHERE status = 'active' GROUP BY 1 HAVING count(*) > 1")
def q_apply_conflict(spark, d):
    """Claims that more than one active correction retracts; an archive appends no such correction."""
    return corrections.conflicts(graph.ledger_status(*ledger_sides(spark, d)))


@query("""WITH RECURSIVE c AS (SELECT slug, 'correction:' || event_id AS message_id, raw_text AS excerpt, 1.0 AS score, 0 AS overlap, 0 AS part, row_number() OVER (PARTITION BY slug ORDER BY ledger_line DESC) AS place FROM (SELECT slug, event_id, min(raw_text) AS raw_text, max(ledger_line) AS ledger_line FROM ledger WHERE event_type = 'correction' AND event_id IS NOT NULL AND raw_text IS NOT NULL AND slug = (SELECT min(slug) FROM ledger) GROUP BY slug, event_id)),
    e AS (SELECT slug, message_id, arg_max(excerpt, score) AS excerpt, max(score) AS score, 0 AS overlap, 1 AS part, 0 AS place FROM evidence WHERE slug = (SELECT min(slug) FROM ledger) AND score IS NOT NULL AND excerpt IS NOT NULL GROUP BY slug, message_id HAVING count(DISTINCT excerpt) = 1),
    r AS (SELECT *, length(excerpt) AS cost, row_number() OVER (ORDER BY part, place, score DESC, message_id) AS rk FROM (SELECT * FROM c WHERE place <= 4 UNION ALL SELECT * FROM e)),
    w AS (SELECT rk, cost AS used, 1 AS kept, true AS taken FROM r WHERE rk = 1 UNION ALL SELECT r.rk, CASE WHEN w.kept < 8 AND w.used + r.cost <= 900 THEN w.used + r.cost ELSE w.used END, CASE WHEN w.kept < 8 AND w.used + r.cost <= 900 THEN w.kept + 1 ELSE w.kept END, w.kept < 8 AND w.used + r.cost <= 900 FROM w JOIN r ON r.rk = w.rk + 1)
    SELECT message_id, row_number() OVER (ORDER BY rk) - 1 AS place FROM w JOIN r USING (rk) WHERE taken""")
def q_answer_evidence(spark, d):
    """The newest corrections of one archive before its evidence, under one budget."""
    t, e = table(spark, d, "ledger"), table(spark, d, "evidence")
    one = t.agg(F.min("slug")).first()[0]
    c = t.where("event_type = 'correction' and event_id is not null and raw_text is not null").where(F.col("slug") == one).groupBy("event_id").agg(F.min("raw_text").alias("excerpt"), F.max("ledger_line").alias("at"))
    newest = c.orderBy(F.desc("at")).limit(4).select(F.concat(F.lit("correction:"), "event_id").alias("message_id"), "excerpt", F.lit(1.0).alias("score"), (-F.col("at")).alias("place"))
    own = e.where("score is not null and excerpt is not null").where(F.col("slug") == one).groupBy("message_id").agg(F.min("excerpt").alias("excerpt"), F.max("excerpt").alias("z"), F.max("score").alias("score")).where("excerpt = z").withColumn("overlap", F.lit(0))
    return retrieval.merged(newest, own, 8, 900).select("message_id", "place")


@query(f"WITH {_MEMBERS}, pr AS (SELECT slug, arg_min(who, seq) AS name, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'persona' ELSE 'contact' END AS identity_type, count(*) AS message_count FROM k WHERE key != '' GROUP BY slug, key) SELECT pr.slug, name, identity_type, message_count, CASE WHEN m.subject IS NULL THEN '' ELSE 'participant_in' END AS types, CASE WHEN identity_type = 'persona' THEN 'identity,voice' ELSE '' END AS pages FROM pr LEFT JOIN m ON m.slug = pr.slug AND m.subject = name")
def q_enrichment(spark, d):
    m = roled(spark, d)
    p = profiles.profiles(m, by=["slug"])
    shown = p.select("slug", F.explode(F.array(*map(F.lit, ("voice", "identity", "_evidence")))).alias("page")).distinct()
    e = retrieval.enrichment(p, graph.membership(m), shown)
    return e.select("slug", "name", "identity_type", "message_count", F.array_join("relationship_types", ",").alias("types"), F.array_join("wiki_pages", ",").alias("pages"))


@query(f"""WITH q AS (SELECT DISTINCT upper(split_part(name, ' ', 1)) AS query FROM participant_preview WHERE name IS NOT NULL), q2 AS (SELECT query, {_plain("query")} AS q FROM q), e AS (SELECT DISTINCT sender AS name, {_plain("sender")} AS e FROM message WHERE sender IS NOT NULL),
    m AS (SELECT query, name, 1 AS tier FROM q2 JOIN e ON e = q WHERE q != '' UNION ALL SELECT query, name, CASE WHEN starts_with(e, q || ' ') THEN 3 ELSE 4 END FROM q2 JOIN e ON contains(e, q) OR contains(q, e) WHERE q != '' AND e != ''),
    t AS (SELECT query, tier, min(name) AS name, count(DISTINCT name) AS matches FROM m GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier) AS rn FROM t)
    SELECT q.query, CASE WHEN matches = 1 OR tier = 1 THEN name END AS entity, tier, coalesce(matches, 0) AS matches FROM q LEFT JOIN l ON q.query = l.query AND rn = 1""")
def q_strict_resolution(spark, d):
    """KG-13: names without accents and case."""
    q = table(spark, d, "participant_preview").where("name is not null").select(F.upper(F.split_part("name", F.lit(" "), F.lit(1))).alias("query"))
    return resolve.resolve(q, table(spark, d, "message").where("sender is not null").select(F.col("sender").alias("name")), accents=False)


_PROFILES = f"pr AS (SELECT min(name) AS name, min(participant_id) AS ord FROM participant_preview WHERE length({_strip('name')}) >= 3 GROUP BY {_strip('lower(name)')})"


@query(f"""WITH {_PROFILES}, a AS (SELECT name, ord, {_strip("lower(name)")} AS a FROM pr), q AS (SELECT DISTINCT split_part(sender, ' ', 1) AS query FROM message WHERE sender IS NOT NULL AND length({_strip("split_part(sender, ' ', 1)")}) >= 3), q2 AS (SELECT query, {_strip("lower(query)")} AS q FROM q),
    m AS (SELECT query, name, ord, CASE WHEN a = q THEN 1 ELSE 2 END AS tier FROM q2 JOIN a ON contains(a, q) OR contains(q, a)), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, ord) AS rn FROM m)
    SELECT q.query, name FROM q LEFT JOIN b ON q.query = b.query AND rn = 1""")
def q_first_profile(spark, d):
    p = table(spark, d, "participant_preview").where(F.length(F.regexp_replace("name", r"(?U)^\s+|\s+$", "")) >= 3).groupBy(F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+$", "")).alias("k")).agg(F.min("name").alias("name"), F.min("participant_id").alias("ord"))
    q = table(spark, d, "message").where("sender is not null").select(F.split_part("sender", F.lit(" "), F.lit(1)).alias("query")).where(F.length(F.regexp_replace("query", r"(?U)^\s+|\s+$", "")) >= 3)
    return resolve.first_profile(q, p.select("name", "ord", F.array("name").alias("aliases")))


# -- layers --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_MEMBERS}, t AS (SELECT slug, count(DISTINCT source_file) AS sources, count(*) AS total_messages, count(*) FILTER (role = 'assistant') AS assistant_turns FROM r GROUP BY slug), e AS (SELECT slug, count(DISTINCT x) AS kg_entities FROM (SELECT slug, lower(subject) AS x FROM m UNION ALL SELECT slug, lower(object) FROM m) GROUP BY slug), n AS (SELECT slug, count(*) AS kg_relationships FROM m GROUP BY slug) SELECT t.*, coalesce(kg_entities, 0) AS kg_entities, coalesce(kg_relationships, 0) AS kg_relationships FROM t LEFT JOIN e USING (slug) LEFT JOIN n USING (slug)")
def q_archive_statistics(spark, d):
    m = roled(spark, d)
    return governance.statistics(m, graph.membership(m), ["slug"])


_WHATSAPP = "slug, min(source_file) AS kept FROM message GROUP BY slug"


@query(f"WITH {_HASHED}, k AS (SELECT {_WHATSAPP}) SELECT h.slug, kept, count(DISTINCT source_file) FILTER (source_file != kept) AS set_aside, count(DISTINCT hash) FILTER (source_file = kept) AS messages FROM h JOIN k USING (slug) GROUP BY h.slug, kept")
def q_keep_one(spark, d):
    h = messages.hashed(roled(spark, d))
    return governance.keep_one(h, ["slug"], h.groupBy("slug").agg(F.min("source_file").alias("kept")))


@query(f"WITH {_HASHED}, s AS (SELECT DISTINCT source_file FROM h WHERE source_type = 'telegram'), kept AS (SELECT * FROM h WHERE source_file NOT IN (SELECT source_file FROM s)), n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source_file, line_no, seq) AS rn FROM h WHERE source_type = 'telegram' AND hash NOT IN (SELECT hash FROM kept)) SELECT 'kept' AS part, count(*) AS n FROM kept UNION ALL SELECT 'brought', count(*) FROM n WHERE rn = 1")
def q_reconcile_equivalent(spark, d):
    h = messages.hashed(roled(spark, d))
    gone = h.where("source_type = 'telegram'")
    kept, brought = governance.replaced(h, gone, gone.select("source_file"))
    return kept.select(F.lit("kept").alias("part")).unionByName(brought.select("hash").distinct().select(F.lit("brought").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT slug, retract_subject AS subject, retract_object AS object, retract_predicate AS type, created_at AS timestamp, arg_min(confidence, ledger_line) AS confidence, arg_min(event_id, ledger_line) AS source FROM ledger WHERE retract_subject IS NOT NULL AND confidence IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL")
def q_stored_edges(spark, d):
    t = table(spark, d, "ledger").where("retract_subject is not null and confidence is not null and event_id is not null")
    e = t.select("slug", F.col("retract_subject").alias("subject"), F.col("retract_object").alias("object"), F.col("retract_predicate").alias("type"), F.col("created_at").alias("timestamp"), "confidence", F.col("event_id").alias("source"), F.col("ledger_line").alias("ord"))
    return graph.fallback(e, ["slug"])


@query(f"WITH {_KEYED}, p AS (SELECT DISTINCT slug, key FROM k WHERE key != ''), e AS (SELECT slug, {_strip('lower(name)')} AS key, min(name) AS entity FROM participant_preview WHERE name IS NOT NULL GROUP BY ALL) SELECT p.slug, p.key, entity FROM p LEFT JOIN e ON p.slug = e.slug AND p.key = e.key")
def q_profile_entities(spark, d):
    p = profiles.profiles(roled(spark, d), by=["slug"])
    return graph.profile_entities(p, table(spark, d, "participant_preview").where("name is not null"), ["slug"]).select("slug", "key", "entity")


_PREVIEW_IDS = "e AS (SELECT participant_id AS id, slug, name FROM participant_preview), t AS (SELECT participant_id AS subject FROM participant_preview WHERE participant_id % 3 = 0)"


@query(f"WITH {_PREVIEW_IDS}, a AS (SELECT DISTINCT slug, {_strip('lower(sender)')} AS low FROM message WHERE sender IS NOT NULL), l AS (SELECT * FROM e WHERE id NOT IN (SELECT subject FROM t)), j AS (SELECT id, l.slug, name, CASE WHEN {_strip('''coalesce(name, '')''')} = '' OR regexp_matches(name, '[\\r\\n]') OR length(name) > 100 THEN 'malformed' WHEN a.low IS NOT NULL THEN 'shadow' END AS reason FROM l LEFT JOIN a ON a.slug = l.slug AND a.low = {_strip('''lower(coalesce(name, ''))''')}) SELECT * FROM j WHERE reason IS NOT NULL")
def q_invalid_entities(spark, d):
    e = table(spark, d, "participant_preview").select(F.col("participant_id").alias("id"), "slug", "name")
    t = e.where("id % 3 = 0").select(F.col("id").alias("subject"), F.lit(None).cast("long").alias("object"))
    # Every spelling of an archive counts as another name of its first participant.
    p = table(spark, d, "message").where("sender is not null").groupBy("slug").agg(F.lit("\x00").alias("name"), F.collect_set("sender").alias("aliases"))
    return graph.invalid_entities(e, t, p, ["slug"])


@query(f"WITH {_FIRST} SELECT count(*) AS n, count(*) FILTER (hash IN (SELECT hash FROM h WHERE source_type = 'telegram')) AS met FROM f")
def q_upsert(spark, d):
    u = messages.vector_records(unique(spark, d))
    h = messages.hashed(roled(spark, d))
    new = messages.vector_records(messages.deduplicate(h.where("source_type = 'telegram'"), ["seq"])).withColumn("hall", F.lit("new"))
    # Ids are per archive and hash; here hashes are unique over all archives.
    by_hash = lambda df: df.withColumn("id", F.substring_index("id", "-", -1))
    return governance.upsert(by_hash(u), by_hash(new)).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("hall") == "new").cast("long")).alias("met"))


@query(f"WITH {_HASHED}, f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source_file, line_no, seq) AS rn FROM h WHERE content IS NOT NULL) SELECT hash, source_file, line_no, role FROM f WHERE rn = 1")
def q_stored_messages(spark, d):
    """Messages written to a backup and read again."""
    path = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    once = roled(spark, d).where("content is not null").groupBy("source_file", "line_no", "role", "content").agg(F.min("timestamp").alias("timestamp"), F.min("source_type").alias("source_type"), F.min("sender").alias("sender"))
    sinks.append_messages(once, path)
    return sinks.stored_messages(spark, path).select("hash", "source_file", "line_no", "role")


_DURATION = "CASE WHEN {x} IS NULL THEN '--:--' WHEN ceil(greatest({x}, 0)) >= 3600 THEN printf('%02d:%02d:%02d', CAST(floor(ceil(greatest({x}, 0)) / 3600) AS BIGINT), CAST(floor(ceil(greatest({x}, 0)) / 60) AS BIGINT) % 60, CAST(ceil(greatest({x}, 0)) AS BIGINT) % 60) ELSE printf('%02d:%02d', CAST(floor(ceil(greatest({x}, 0)) / 60) AS BIGINT), CAST(ceil(greatest({x}, 0)) AS BIGINT) % 60) END"


@query("WITH t AS (SELECT participant_id, coalesce(new_messages, 0) AS a, coalesce(messages, 0) AS b, CAST(coalesce(messages, 0) * 37.5 AS DOUBLE) AS e FROM participant_preview), l AS (SELECT *, CASE WHEN a >= b THEN 0.0::DOUBLE WHEN a > 0 AND e > 0 THEN (b - a) / (a / e) END AS r FROM t) SELECT participant_id, concat(a, '/', b, ' (', printf('%.1f', CASE WHEN b != 0 THEN a / b * 100 ELSE 100.0 END), '%) | elapsed ', " + _DURATION.replace("{x}", "e") + ", ' | ETA ', " + _DURATION.replace("{x}", "r") + ") AS progress FROM l")
def q_progress(spark, d):
    a, b = (F.coalesce(c, F.lit(0)) for c in ("new_messages", "messages"))
    return table(spark, d, "participant_preview").select("participant_id", progress(a, b, b * 37.5).alias("progress"))
