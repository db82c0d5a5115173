"""Queries of the reference operators over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.messages import NEGATIVE_PREFERENCE, PII, PREFERENCE, STOP_WORDS, claim_id, collapse, pii_redact, term_overlap
from strandline.operators import context, corrections, dialogue, extract, governance, graph, instants, messages, privacy, profiles, resolve, retrieval, wiki
from strandline.session import table
from strandline.sources import readers
from strandline.streaming import ingest

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


# SQL for what the column functions do; RE2's \s knows no Unicode.
WS = r"[\s\x0b\x{85}\p{Z}]"
_strip = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_flat = lambda c: _strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")
_role = lambda c: f"CASE WHEN {_strip(f'lower({c})')} IN ('assistant', 'bot', 'ai', 'system') THEN 'assistant' WHEN {_strip(f'lower({c})')} IN ('user', 'human') THEN 'user' WHEN coalesce({c}, '') = '' THEN 'assistant' ELSE 'user' END"
_hash = "substr(sha256(concat(coalesce(role, ''), ':', coalesce(content, ''))), 1, 16)"
_words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w != ''))"
_ROLED = f"r AS (SELECT * REPLACE ({_role('role')} AS role) FROM message)"
_HASHED = f"{_ROLED}, h AS (SELECT *, {_hash} AS hash FROM r)"
_FIRST = f"{_HASHED}, f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq) AS rn FROM h) WHERE rn = 1)"
_KEYED = f"{_ROLED}, k AS (SELECT *, {_strip('lower(sender)')} AS key, {_strip('sender')} AS who FROM r)"


def roled(spark, d):
    return messages.normalise_roles(table(spark, d, "message").withColumn("role", F.coalesce("role", F.lit(""))))


def unique(spark, d):
    return messages.deduplicate(messages.hashed(roled(spark, d)), ["seq"])


@query(f"WITH {_ROLED} SELECT seq, role FROM r")
def q_normalize_roles(spark, d):
    return roled(spark, d).select("seq", "role")


@query(f"WITH {_HASHED} SELECT seq, hash, concat(slug, '-', hash) AS vector_id FROM h")
def q_content_hash(spark, d):
    h = messages.hashed(roled(spark, d))
    return h.select("seq", "hash", F.concat_ws("-", "slug", "hash").alias("vector_id"))


@query(f"WITH {_FIRST} SELECT seq, hash, slug, role FROM f")
def q_dedup_first(spark, d):
    return unique(spark, d).select("seq", "hash", "slug", "role")


@query(f"WITH {_HASHED} SELECT min(seq) AS seq, hash FROM h WHERE source_type != 'whatsapp' AND hash NOT IN (SELECT hash FROM h WHERE source_type = 'whatsapp') GROUP BY hash")
def q_dedup_incremental_anti(spark, d):
    h = messages.hashed(roled(spark, d))
    return messages.only_new(h.where("source_type != 'whatsapp'"), h.where("source_type = 'whatsapp'"), ["seq"]).select("seq", "hash")


@query(f"""WITH p AS (SELECT source, nullif({_flat("lower(text)")}, '') AS fp FROM documents WHERE source IS NOT NULL),
    c AS (SELECT source, fp, count(*) AS c FROM p WHERE fp IS NOT NULL GROUP BY ALL), z AS (SELECT source, sum(c) AS size FROM c GROUP BY ALL),
    o AS (SELECT x.source AS a, y.source AS b, sum(least(x.c, y.c)) AS overlap FROM c x JOIN c y USING (fp) WHERE x.source < y.source GROUP BY ALL)
    SELECT a, b, CAST(overlap AS BIGINT) AS overlap, CAST(za.size AS BIGINT) AS size_a, CAST(zb.size AS BIGINT) AS size_b, round(overlap / least(za.size, zb.size), 6) AS coverage,
    CASE WHEN least(za.size, zb.size) < 20 THEN overlap = least(za.size, zb.size) AND za.size = zb.size ELSE overlap / least(za.size, zb.size) >= 0.95 AND least(za.size, zb.size) / greatest(za.size, zb.size) >= 0.9 END AS equivalent
    FROM o JOIN z za ON za.source = a JOIN z zb ON zb.source = b""")
def q_source_equivalence(spark, d):
    p = table(spark, d, "documents").where("source is not null").select("source", F.nullif(collapse(F.lower("text")), F.lit("")).alias("fp"))
    return messages.equivalent_sources(p).withColumn("coverage", F.round("coverage", 6))


@query("SELECT sha256(content) AS digest, count(*) AS n FROM (SELECT lower(content) AS content FROM message WHERE role = 'user' AND content IS NOT NULL INTERSECT ALL SELECT lower(content) FROM message WHERE role = 'assistant' AND content IS NOT NULL) GROUP BY content")
def q_multiset_intersect_all(spark, d):
    t = table(spark, d, "message").where("content is not null").withColumn("content", F.lower("content"))
    both = messages.multiset_intersection(t.where("role = 'user'"), t.where("role = 'assistant'"), ["content"])
    return both.groupBy(F.sha2("content", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


_PII_SQL = {k: f"CAST(sum(len(regexp_extract_all(coalesce(content, ''), '{p}'))) AS BIGINT)" for k, p in PII.items()}


@query(f"SELECT source_type, {', '.join(f'{v} AS {k}' for k, v in _PII_SQL.items())} FROM message GROUP BY ROLLUP (source_type)")
def q_pii_counts_by_source(spark, d):
    return privacy.scan(table(spark, d, "message"), "content", ["source_type"])


def _redacted(c: str) -> str:
    for k, p in PII.items():
        c = f"regexp_replace({c}, '{p}', '[REDACTED_{k.upper()}]', 'g')"
    return c


@query(f"SELECT seq, sha256({_redacted('content')}) AS digest FROM message WHERE content IS NOT NULL")
def q_pii_redact(spark, d):
    return table(spark, d, "message").where("content is not null").select("seq", F.sha2(pii_redact(F.col("content")), 256).alias("digest"))


@query(f"SELECT source_type, {' + '.join(_PII_SQL.values())} AS matches, CASE WHEN {' + '.join(_PII_SQL.values())} > 0 THEN 'redact' ELSE 'allow' END AS decision FROM message GROUP BY source_type")
def q_pii_policy_gate(spark, d):
    return privacy.gate(table(spark, d, "message"), "content", ["source_type"], "redact").withColumn("matches", F.col("matches").cast("long"))


@query(f"""WITH {_KEYED} SELECT slug, key, arg_min(who, seq) AS name, count(*) AS message_count, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) FILTER (role != 'assistant') AS user_messages,
    min(nullif(timestamp, '')) AS first_seen, max(nullif(timestamp, '')) AS last_seen, array_to_string(list_sort(list(DISTINCT source_file)), ',') AS sources,
    CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'persona' ELSE 'contact' END AS identity_type FROM k WHERE key != '' GROUP BY slug, key""")
def q_profiles(spark, d):
    return profiles.profiles(roled(spark, d), by=["slug"])


def profiles_of(spark, d):
    return q_profiles(spark, d)


@query("SELECT slug, substr(timestamp, 1, 7) AS month, count(*) AS messages FROM message WHERE regexp_matches(timestamp, '^\\d{4}-\\d{2}') GROUP BY ALL")
def q_monthly_activity(spark, d):
    return profiles.monthly(table(spark, d, "message"), ["slug"])


_DRAWN = "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyzáéíóúñ")


@query(f"""SELECT slug, count(*) AS messages, round(avg({_words("content")}), 6) AS mean_words, CAST(median({_words("content")}) AS DOUBLE) AS median_words, count(*) FILTER (contains(content, '?')) AS questions,
    count(*) FILTER (regexp_matches(content, '(?i)jaj+a')) AS laughs, count(*) FILTER (regexp_matches(content, '(?i){_DRAWN}')) AS drawn_out FROM message WHERE content IS NOT NULL GROUP BY slug""")
def q_voice_stats(spark, d):
    return profiles.voice(table(spark, d, "message"), ["slug"])


_TOPICS = {"routine": r"(?iu)(gym|iglesia|familia|family)", "planning": r"(?iu)(tengo un plan|voy a|mañana|tengo que)", "reasoning": r"(?iu)(creo que|pienso que|porque|i think)"}


@query("WITH m AS (SELECT * FROM message WHERE content IS NOT NULL) SELECT slug, " + ", ".join(f"coalesce(arg_max(seq, length(content) * 1e10 - seq) FILTER (regexp_matches(content, '{p.replace('(?iu)', '(?i)')}')), min(seq)) AS {t}" for t, p in _TOPICS.items()) + " FROM m GROUP BY slug")
def q_longest_pick(spark, d):
    return profiles.pick(table(spark, d, "message"), _TOPICS, ["slug"], "seq")


def dialogue_of(spark, d):
    return dialogue.turns(table(spark, d, "conversations"), ["conv_id"], ["turn_no", "role", "content"])


_TURNS = f"""s AS (SELECT conv_id, turn_no, role, {_strip("content")} AS content FROM conversations WHERE role IN ('user', 'assistant')), n AS (SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev FROM s WHERE content != '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no, role, content)),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev != role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rn) AS island FROM n),
    t AS (SELECT conv_id, island, any_value(role) AS role, string_agg(content, chr(10) ORDER BY rn) AS content FROM g GROUP BY conv_id, island),
    e AS (SELECT *, min(island) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS a, max(island) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS z FROM t),
    turns AS (SELECT conv_id, CAST(island - a AS BIGINT) AS turn, role, content FROM e WHERE island >= a AND island <= z)"""


@query(f"WITH {_TURNS} SELECT * FROM turns")
def q_dialogue_turns(spark, d):
    return dialogue_of(spark, d)


@query(f"""WITH {_TURNS}, q AS (SELECT *, CASE WHEN role = 'user' THEN nullif(lower({_strip("regexp_extract(content, '(?i)(?:about your |about )([\\w\\p{L}\\p{N}\\s-]+)', 1)")}), '') END AS topic FROM turns)
    SELECT count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'user') AS user_turns, round(count(*) FILTER (role = 'assistant') / count(*) FILTER (role = 'user'), 6) AS role_ratio,
    round(avg(length(content)) FILTER (role = 'assistant'), 6) AS avg_assistant_len, round(avg(length(content)) FILTER (role = 'user'), 6) AS avg_user_len, count(DISTINCT topic) AS topic_count, count(DISTINCT content) FILTER (role = 'user') AS unique_questions FROM q""")
def q_export_quality(spark, d):
    return dialogue.quality(dialogue_of(spark, d))


@query(f"SELECT source, CAST(sum({_words('text')}) AS BIGINT) AS words FROM documents GROUP BY source")
def q_word_total(spark, d):
    return dialogue.word_totals(table(spark, d, "documents"), "text", ["source"])


@query("""WITH l AS (SELECT source_file, role, sha256(concat_ws(chr(31), CAST(line_no AS VARCHAR), coalesce(role, ''), coalesce(content, ''))) AS d FROM message),
    p AS (SELECT source_file, substr(d, 1, 2) AS g, sha256(array_to_string(list_sort(list(d)), '')) AS d, count(*) AS n, count(*) FILTER (role = 'assistant') AS a FROM l GROUP BY ALL)
    SELECT source_file, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(a) AS BIGINT) AS assistant_turns, substr(sha256(array_to_string(list_sort(list(g || d)), '')), 1, 16) AS content_hash FROM p GROUP BY source_file""")
def q_source_snapshot_hash(spark, d):
    return dialogue.source_statistics(table(spark, d, "message"))


@query("SELECT filename AS source_file, lines, time_zone, locale FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY imported_at DESC) AS rn FROM source_index) WHERE rn = 1")
def q_newest_sources(spark, d):
    return instants.newest_sources(table(spark, d, "source_index"))


_MEMBERS = f"""{_KEYED}, m AS (SELECT slug, arg_min(who, seq) AS subject, slug AS object, 'participant_in' AS type, 1.0::DOUBLE AS confidence, arg_min(source_file, seq) AS source, arg_min(coalesce(timestamp, chr(0)), seq) AS ts FROM k WHERE key != '' AND key != lower(slug) GROUP BY slug, key)"""


@query(f"WITH {_MEMBERS} SELECT slug, subject, object, type, confidence, source, nullif(ts, chr(0)) AS timestamp FROM m")
def q_graph_edges(spark, d):
    e = graph.membership(roled(spark, d)).withColumn("ord", F.lit(0))
    return graph.merge_edges(e, ["slug"], "ord").select("slug", "subject", "object", "type", "confidence", "source", "timestamp")


_COMM = f"""{_KEYED}, n AS (SELECT slug, key, arg_min(who, seq) FILTER (role = 'assistant') AS persona, arg_min(who, seq) FILTER (role != 'assistant') AS contact FROM k WHERE key != '' GROUP BY slug, key),
    c AS (SELECT a.slug, a.persona AS subject, b.contact AS object FROM n a JOIN n b ON a.slug = b.slug AND a.key != b.key WHERE a.persona IS NOT NULL AND b.contact IS NOT NULL)"""


@query(f"WITH {_COMM} SELECT slug, subject, object, 'communicates_with' AS type FROM c")
def q_graph_communication(spark, d):
    return graph.communication(roled(spark, d)).select("slug", "subject", "object", "type")


@query(f"""WITH {_COMM}, e AS (SELECT 'communicates_with' AS type, 1.0 AS confidence FROM c UNION ALL SELECT 'participant_in', 1.0 FROM (SELECT DISTINCT slug, key FROM k WHERE key != '' AND key != lower(slug)))
    SELECT type, CAST(confidence AS DOUBLE) AS confidence, count(*) AS relationships FROM e GROUP BY GROUPING SETS ((type), (confidence), ())""")
def q_graph_stats(spark, d):
    m = roled(spark, d)
    return graph.statistics(graph.membership(m).unionByName(graph.communication(m)))


@query(f"""WITH r AS (SELECT * REPLACE ({_role("role")} AS role, source_file AS slug, CASE WHEN line_no = 2 THEN content || ' con mi novia' ELSE content END AS content, CASE WHEN role = 'assistant' THEN 'Ana' ELSE lower(split_part(sender, ' ', 1)) END AS sender) FROM message), k AS (SELECT *, {_strip("lower(sender)")} AS key, {_strip("sender")} AS who FROM r), g AS (SELECT slug, min(key) FILTER (key != '' AND role = 'assistant') a, max(key) FILTER (key != '' AND role = 'assistant') a2, min(key) FILTER (key != '' AND role != 'assistant') b, max(key) FILTER (key != '' AND role != 'assistant') b2,
    arg_min(who, seq) FILTER (key != '' AND role = 'assistant') AS subject, arg_min(who, seq) FILTER (key != '' AND role != 'assistant') AS object, min(seq) FILTER (regexp_matches(content, '(?i)(mi\\s+(?:novia|novio|pareja)|amor\\s+de\\s+mi\\s+vida|quiero\\s+todo\\s+contigo)')) AS s FROM k GROUP BY slug)
    SELECT slug, subject, object FROM g WHERE a = a2 AND b = b2 AND a != b AND s IS NOT NULL""")
def q_graph_romance(spark, d):
    """Each file as an archive of its own, with one name for the persona, and a second line that tells of a romance: the table's own tell of none."""
    m = roled(spark, d).withColumns({"slug": F.col("source_file"), "content": F.when(F.col("line_no") == 2, F.concat("content", F.lit(" con mi novia"))).otherwise(F.col("content"))})
    raw = table(spark, d, "message").select("seq", (F.col("role") == "assistant").alias("own"))
    m = m.join(raw, "seq").withColumn("sender", F.when(F.col("own"), "Ana").otherwise(F.lower(F.split_part("sender", F.lit(" "), F.lit(1)))))
    return graph.romance(m).select("slug", "subject", "object")


@query(f"WITH {_MEMBERS} SELECT subject, object, type FROM m WHERE subject = 'Torvalle Envíos' OR object = 'Torvalle Envíos'")
def q_graph_neighborhood(spark, d):
    return graph.neighbourhood(graph.membership(roled(spark, d)), "Torvalle Envíos").select("subject", "object", "type")


def places(spark, d):
    """The graph of the trade tables: customers and suppliers in nations, nations in regions."""
    n, r, c, s = (table(spark, d, t) for t in ("nation", "region", "customer", "supplier"))
    nation = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("subject"), F.col("r_name").alias("object"))
    ends = lambda t, name, key: t.join(F.broadcast(n), t[key] == n["n_nationkey"]).select(F.col(name).alias("subject"), F.col("n_name").alias("object"))
    return nation.unionByName(ends(c, "c_name", "c_nationkey")).unionByName(ends(s, "s_name", "s_nationkey"))


_PLACES = "p AS (SELECT n_name AS subject, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH RECURSIVE {_PLACES}, a AS (SELECT subject AS x, object AS y FROM p UNION SELECT object, subject FROM p), start AS (SELECT min(c_name) AS node FROM customer),
    w(node, hops) AS (SELECT node, 0 FROM start UNION SELECT a.y, hops + 1 FROM w JOIN a ON a.x = w.node WHERE hops < 7) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY node""")
def q_graph_shortest_path(spark, d):
    start = table(spark, d, "customer").agg(F.min("c_name")).first()[0]
    return graph.shortest_paths(places(spark, d), start).select("node", "hops")


@query(f"WITH {_PLACES} SELECT subject, object FROM p WHERE subject = (SELECT min(c_name) FROM customer) ORDER BY subject, object LIMIT 1")
def q_graph_find_edge(spark, d):
    p = places(spark, d)
    a = table(spark, d, "customer").agg(F.min("c_name")).first()[0]
    row = p.where(F.col("subject") == a).orderBy("object").first()
    return graph.edge_between(p, row["object"], a, "subject")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))")
def q_orphan_entities(spark, d):
    """Customers without an order of fifty of one part; every one of the tables' has some order."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    large = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, d, "orders").join(large, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("subject"), F.lit(None).cast("long").alias("object"))
    return graph.orphans(c, o).select(F.col("id").alias("c_custkey"), "c_name")


_SYM = "('communicates_with','cousin_of','coworker_of','friend_of','romantic_partner','sibling_of','spouse_of')"


def _claim(p: str) -> str:
    a, b, r = (_strip(f"lower({p}_{x})") for x in ("subject", "object", "predicate"))
    return f"concat('base-', substr(sha256(concat_ws('|', CASE WHEN {p}_predicate IN {_SYM} THEN least({a}, {b}) ELSE {a} END, {r}, CASE WHEN {p}_predicate IN {_SYM} THEN greatest({a}, {b}) ELSE {b} END)), 1, 16))"


@query(f"SELECT ledger_line, {_claim('assert')} AS claim FROM ledger WHERE assert_subject IS NOT NULL")
def q_claim_id(spark, d):
    return table(spark, d, "ledger").where("assert_subject is not null").select("ledger_line", claim_id(F.col("assert_subject"), F.col("assert_predicate"), F.col("assert_object")).alias("claim"))


def ledger_sides(spark, d):
    t = table(spark, d, "ledger")
    undo = t.where("event_type = 'undo' and event_id is not null").select("event_id", F.regexp_replace("target_claim_id", ":(assert|retract)$", "").alias("target_claim_id"), F.col("ledger_line").alias("ord"))
    return t.where("event_type = 'correction' and event_id is not null").withColumn("ord", F.col("ledger_line")), undo


@query("""WITH u AS (SELECT regexp_replace(target_claim_id, ':(assert|retract)$', '') AS claim_id, arg_max(event_id, ledger_line) AS undo_event_id FROM ledger WHERE event_type = 'undo' AND event_id IS NOT NULL GROUP BY 1)
    SELECT ledger_line, c.claim_id, undo_event_id, CASE WHEN undo_event_id IS NULL THEN 'active' ELSE 'undone' END AS status FROM ledger c LEFT JOIN u USING (claim_id) WHERE event_type = 'correction' AND event_id IS NOT NULL""")
def q_ledger_status(spark, d):
    return graph.ledger_status(*ledger_sides(spark, d)).select("ledger_line", "claim_id", "undo_event_id", "status")


@query("SELECT event_id, regexp_replace(target_claim_id, ':(assert|retract)$', '') AS target_claim_id FROM ledger WHERE event_type = 'undo' AND event_id IS NOT NULL AND regexp_replace(target_claim_id, ':(assert|retract)$', '') NOT IN (SELECT claim_id FROM ledger WHERE event_type = 'correction' AND event_id IS NOT NULL AND claim_id IS NOT NULL)")
def q_ledger_unknown_undos(spark, d):
    return graph.unknown_undos(*ledger_sides(spark, d)).select("event_id", "target_claim_id")


_EDGES = f"""c AS (SELECT *, ledger_line AS ord FROM ledger WHERE event_type = 'correction' AND event_id IS NOT NULL), k AS (SELECT {_claim("retract")} AS claim, ord FROM c UNION ALL SELECT {_claim("assert")}, ord FROM c), l AS (SELECT claim, max(ord) AS last FROM k GROUP BY claim),
    e AS (SELECT DISTINCT {_claim("retract")} AS claim, retract_subject AS subject, retract_predicate AS type, retract_object AS object, 0 AS ord, NULL AS correction_id FROM c UNION ALL SELECT {_claim("assert")}, assert_subject, assert_predicate, assert_object, ord, claim_id FROM c)"""


@query(f"WITH {_EDGES} SELECT e.claim AS claim_id, subject, type, object, correction_id FROM e LEFT JOIN l ON e.claim = l.claim WHERE last IS NULL OR last <= ord")
def q_effective_graph(spark, d):
    c, _ = ledger_sides(spark, d)
    base = c.select(F.col("retract_subject").alias("subject"), F.col("retract_predicate").alias("type"), F.col("retract_object").alias("object")).distinct().withColumn("confidence", F.lit(0.5))
    return graph.effective(base, c).drop("confidence")


def first_vector(spark, d):
    return list(table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"])


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_QV = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"WITH {_QV} SELECT vec_id, round(1 - {_COS}, 6) AS distance FROM embeddings e, q WHERE label = (SELECT label FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY 1 - {_COS}, vec_id LIMIT 30")
def q_vector_topk(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    label = e.orderBy("id").first()["label"]
    return retrieval.nearest(e, first_vector(spark, d), 30, F.col("label") == label).select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


_QUESTION, _WHO = "¿Qué opina Rosa sobre el orden y la paciencia en casa?", "Rosa"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_terms = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-záéíóúüñ]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"
_QTERMS = "['opina', 'orden', 'paciencia', 'casa']"
_overlap = lambda c: f"len(list_filter({_QTERMS}, lambda t: list_contains({c}, t) OR (length(t) >= 5 AND len(list_filter({c}, lambda w: length(w) >= 5 AND substr(w, 1, 5) = substr(t, 1, 5))) > 0)))"


@query(f"SELECT doc_id, CAST({_overlap(_terms('text'))} AS INTEGER) AS overlap FROM documents")
def q_lexical_overlap(spark, d):
    return table(spark, d, "documents").select("doc_id", term_overlap(retrieval.topic_terms(_QUESTION, _WHO), F.col("text")).alias("overlap"))


@query(f"""WITH {_QV}, h AS (SELECT vec_id, 1 - {_COS} AS distance, text FROM embeddings e JOIN documents ON doc_id = vec_id, q)
    SELECT vec_id, round(0.8 * greatest(0, least(1, 1 - distance)) + 0.2 * {_overlap(_terms("text"))} / 4, 6) AS score FROM h WHERE {_flat("text")} != ''""")
def q_hybrid_score(spark, d):
    e = table(spark, d, "embeddings").withColumn("distance", 1 - retrieval.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in first_vector(spark, d)])))
    h = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id")
    return retrieval.score(h, _QUESTION, _WHO).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT evidence_no, slug, score, excerpt FROM evidence WHERE excerpt IS NOT NULL), r AS (SELECT *, length(excerpt) AS cost, row_number() OVER (PARTITION BY slug ORDER BY score DESC NULLS LAST, evidence_no) AS rk FROM u),
    w AS (SELECT slug, rk, evidence_no, cost AS used, 1 AS kept, true AS taken FROM r WHERE rk = 1
      UNION ALL SELECT r.slug, r.rk, r.evidence_no, CASE WHEN w.kept < 5 AND w.used + r.cost <= 400 THEN w.used + r.cost ELSE w.used END, CASE WHEN w.kept < 5 AND w.used + r.cost <= 400 THEN w.kept + 1 ELSE w.kept END, w.kept < 5 AND w.used + r.cost <= 400
      FROM w JOIN r ON r.slug = w.slug AND r.rk = w.rk + 1 WHERE r.rk <= 100)
    SELECT slug, evidence_no FROM w WHERE taken""")
def q_evidence_budget(spark, d):
    e = table(spark, d, "evidence").where("excerpt is not null").select("evidence_no", "slug", "score", "excerpt").distinct().withColumn("cost", F.length("excerpt"))
    return retrieval.select_within(e, ["slug"], [F.desc_nulls_last("score"), F.asc("evidence_no")], "cost", 400, 5).select("slug", "evidence_no")


_POS, _NEG = (p.replace("(?iu)", "(?i)").replace("'", "''") for p in (PREFERENCE, NEGATIVE_PREFERENCE))


@query(f"SELECT slug, bool_or(regexp_matches(content, '{_NEG}')) AS against, bool_or(regexp_matches(content, '{_POS}') AND NOT regexp_matches(content, '{_NEG}')) AS for_it FROM message WHERE content IS NOT NULL GROUP BY slug")
def q_contradiction_gate(spark, d):
    return retrieval.polarity(table(spark, d, "message").where("content is not null"), "content", ["slug"])


@query(f"""WITH q AS (SELECT DISTINCT split_part(name, ' ', 1) AS query FROM participant_preview WHERE name IS NOT NULL), q2 AS (SELECT query, {_strip("lower(query)")} AS q FROM q), e AS (SELECT DISTINCT sender AS name, {_strip("lower(sender)")} AS e FROM message WHERE sender IS NOT NULL),
    m AS (SELECT query, name, 1 AS tier FROM q2 JOIN e ON e = q WHERE q != '' UNION ALL SELECT query, name, CASE WHEN starts_with(e, q || ' ') THEN 3 ELSE 4 END FROM q2 JOIN e ON contains(e, q) OR contains(q, e) WHERE q != '' AND e != ''),
    t AS (SELECT query, tier, min(name) AS name, count(DISTINCT name) AS matches FROM m GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier) AS rn FROM t)
    SELECT q.query, CASE WHEN matches = 1 OR tier = 1 THEN name END AS entity, tier, coalesce(matches, 0) AS matches FROM q LEFT JOIN l ON q.query = l.query AND rn = 1""")
def q_entity_resolution(spark, d):
    q = table(spark, d, "participant_preview").where("name is not null").select(F.split_part("name", F.lit(" "), F.lit(1)).alias("query"))
    return resolve.resolve(q, table(spark, d, "message").where("sender is not null").select(F.col("sender").alias("name")))


@query("""WITH e AS (SELECT slug, list(DISTINCT lower(name)) AS e FROM participant_preview WHERE name IS NOT NULL GROUP BY slug), a AS (SELECT slug, list(DISTINCT lower(sender)) AS a FROM message WHERE sender IS NOT NULL GROUP BY slug),
    j AS (SELECT coalesce(e, []) AS e, coalesce(a, []) AS a FROM e FULL JOIN a USING (slug)), n AS (SELECT count(*) AS cases, CAST(sum(len(list_intersect(e, a))) AS BIGINT) AS tp, CAST(sum(len(a) - len(list_intersect(e, a))) AS BIGINT) AS fp, CAST(sum(len(e) - len(list_intersect(e, a))) AS BIGINT) AS fn FROM j)
    SELECT cases, tp AS true_positive, fp AS false_positive, fn AS false_negative, round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall, round_even(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1 FROM n""")
def q_eval_prf(spark, d):
    e = table(spark, d, "participant_preview").where("name is not null").groupBy("slug").agg(F.collect_set(F.lower("name")).alias("expected"))
    a = table(spark, d, "message").where("sender is not null").groupBy("slug").agg(F.collect_set(F.lower("sender")).alias("actual"))
    return extract.evaluate(e.join(a, "slug", "full_outer"))


@query("WITH b AS (SELECT record_id, record_id % 13 AS r FROM context_record WHERE content IS NOT NULL) SELECT record_id, CASE WHEN r < 4 THEN 'assertion' WHEN r IN (9, 10) THEN 'inference' ELSE 'freeform' END AS kind, CASE WHEN r < 4 THEN 1.0 WHEN r IN (9, 10) THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence FROM b")
def q_context_classify(spark, d):
    """Prefixes of every kind in turn, in any case and accent, and two that are none."""
    said = F.array(*map(F.lit, ("Assert", "FACT", "hecho", "Afirmación", "context", "Contexto", "note", "NOTA", "Sin prefijo", "inference", "INFERENCIA", "hechos", "")))
    prefix = F.element_at(said, (F.pmod("record_id", F.lit(13)) + 1).cast("int"))
    c = table(spark, d, "context_record").where("content is not null").select("record_id", F.concat(prefix, F.when(prefix != "", ": ").otherwise(""), "content").alias("block"))
    return context.classify(c, "block").select("record_id", "kind", "confidence")


_plain = lambda c: _flat(f"translate(lower({c}), '{context.ACCENTS[0]}', '{context.ACCENTS[1]}')")
_spaced = lambda c: f"concat(' ', trim(regexp_replace({c}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+', ' ', 'g')), ' ')"


@query(f"""WITH b AS (SELECT slug, record_id, concat(' ', regexp_replace({_plain("content")}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+', ' ', 'g'), ' ') AS t FROM context_record WHERE content IS NOT NULL), n AS (SELECT DISTINCT slug, name, {_plain("name")} AS alias FROM participant_preview WHERE name IS NOT NULL),
    m AS (SELECT b.slug, record_id, count(DISTINCT name) AS named, min(name) AS one FROM b JOIN n ON b.slug = n.slug AND length(alias) >= 2 AND contains(t, {_spaced("alias")}) GROUP BY ALL)
    SELECT b.slug, b.record_id, CASE WHEN named = 1 THEN one END AS subject, coalesce(named, 0) AS named FROM b LEFT JOIN m USING (slug, record_id)""")
def q_context_subjects(spark, d):
    b = table(spark, d, "context_record").where("content is not null")
    n = table(spark, d, "participant_preview").where("name is not null").select("slug", "name", F.col("name").alias("alias")).distinct()
    return context.subjects(b, n, "record_id", "content", ["slug"])


@query("""WITH e AS (SELECT source_file AS id, count(DISTINCT line_no) AS lines FROM message GROUP BY 1), s AS (SELECT filename AS id, lines FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY imported_at DESC) AS rn FROM source_index) WHERE rn = 1)
    SELECT coalesce(e.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'stale' WHEN e.lines IS DISTINCT FROM s.lines THEN 'changed' ELSE 'same' END AS state FROM e FULL JOIN s ON e.id = s.id""")
def q_vector_diff(spark, d):
    e = table(spark, d, "message").groupBy(F.col("source_file").alias("id")).agg(F.countDistinct("line_no").alias("lines"))
    s = instants.newest_sources(table(spark, d, "source_index")).select(F.col("source_file").alias("id"), F.col("lines").cast("long").alias("lines"))
    return governance.vector_difference(e, s, ["lines"])


@query(f"WITH {_FIRST}, n AS (SELECT count(*) AS n FROM f), p AS (SELECT count(*) AS n FROM f WHERE {_strip('lower(sender)')} != ''), v AS (SELECT count(DISTINCT hash) AS n FROM h), l AS (SELECT 'messages' AS layer, n FROM n UNION ALL SELECT 'profiles', n FROM p UNION ALL SELECT 'vectors', n FROM v) SELECT layer, l.n AS count, l.n = n.n AS agrees FROM l, n")
def q_invariants(spark, d):
    u = unique(spark, d)
    return governance.invariants(u, profiles.profiles(u, by=["slug"]), messages.vector_records(u))


def pages_of(spark, d):
    return table(spark, d, "documents").where("source = 'wiki'").select(F.col("doc_id").cast("string").alias("page"), "text")


@query(f"SELECT DISTINCT CAST(doc_id AS VARCHAR) AS page, {_strip('t.target')} AS target FROM documents, unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) AS t(target) WHERE source = 'wiki' AND {_strip('t.target')} NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE source = 'wiki')")
def q_link_lint(spark, d):
    return wiki.broken_links(pages_of(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS page, " + ", ".join(f"CAST(len(list_filter(regexp_extract_all(text, '\\[L(\\d):?[\\w-]*\\]', 1), lambda x: x = '{k}')) AS BIGINT) AS L{k}" for k in "1234") + " FROM documents WHERE source = 'wiki'")
def q_evidence_tags(spark, d):
    return wiki.tag_counts(pages_of(spark, d))


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BODY = _strip("coalesce(string_agg(CASE WHEN NOT head AND NOT starts_with(line, '# ') THEN line END, chr(10) ORDER BY i), '')")
_SECTIONS = f"""WITH a AS (SELECT doc_id, regexp_split_to_array(text, '{_ENDS}') AS ls FROM documents WHERE source = 'wiki'), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM a),
    n AS (SELECT *, starts_with(line, '## ') AS head, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l),
    g AS (SELECT doc_id, s, max(CASE WHEN head THEN {_strip("substr(line, 4)")} END) AS title, {_BODY} AS text FROM n WHERE s > 0 GROUP BY doc_id, s)
    SELECT CAST(doc_id AS VARCHAR) AS page, CAST(s AS BIGINT) AS s, title, text FROM g WHERE title != '' AND title NOT IN ('Sources', 'See also', 'References', 'Metadata') AND text != '' AND text != '(awaiting data ingestion)'"""


@query(_SECTIONS)
def q_wiki_sections(spark, d):
    return wiki.sections(pages_of(spark, d)).select("page", F.col("s").cast("long").alias("s"), "title", "text")


@query()
def q_wiki_questions(spark, d):
    return wiki.questions(wiki.sections(pages_of(spark, d)))


@query()
def q_wiki_lint(spark, d):
    return wiki.lint(pages_of(spark, d))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\\[\\[([^|\\]]+)\\|([^\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')) AS digest FROM documents")
def q_markdown_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(readers.strip_wikilinks(F.col("text")), 256).alias("digest"))


@query(f"SELECT doc_id, sha256(CASE WHEN starts_with(text, '---') AND contains(substr(text, 4), '---') THEN {_strip('''regexp_replace(text, '^(?s:---.*?---)', '')''')} ELSE text END) AS digest FROM documents")
def q_frontmatter_body(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(readers.split_frontmatter(F.col("text"))[1], 256).alias("digest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def q_json_field_coalesce(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", readers._field(F.col("props"), ("key", "k", "value")).alias("k"))


@query(f"SELECT seq, {_role('role')} AS role, {_strip('content')} AS content FROM message WHERE content IS NOT NULL AND {_strip('content')} != ''")
def q_normalise_records(spark, d):
    m = table(spark, d, "message").where("content is not null")
    records = m.select("seq", F.lit(1).alias("line_no"), F.col("seq").cast("string").alias("source_file"), F.to_json(F.struct("role", "content")).alias("record"))
    return readers.normalise_records(records).select(F.col("source_file").cast("long").alias("seq"), "role", "content")


_LOW_SENDER = _flat("lower(coalesce(sender, ''))")
_BAD_SENDER = "(regexp_matches(coalesce(sender, ''), '[\\r\\n]') OR length(coalesce(sender, '')) > 100 OR " + " OR ".join(f"starts_with({_LOW_SENDER}, '{n}')" for n in readers.NOTICES) + ")"


@query(f"WITH m AS (SELECT slug, CASE WHEN seq % 11 = 0 THEN concat('Messages and calls are  end-to-end encrypted. ', sender) WHEN seq % 13 = 0 THEN concat(sender, chr(10), 'x') ELSE sender END AS sender FROM message) SELECT slug, count(*) FILTER ({_BAD_SENDER}) AS rejected, count(*) FILTER (NOT {_BAD_SENDER}) AS kept FROM m GROUP BY slug")
def q_reject_senders(spark, d):
    """Some senders are made notices or broken lines: the table's own are neither."""
    s = F.when(F.pmod("seq", F.lit(11)) == 0, F.concat(F.lit("Messages and calls are  end-to-end encrypted. "), F.coalesce("sender", F.lit("")))).when(F.pmod("seq", F.lit(13)) == 0, F.concat(F.coalesce("sender", F.lit("")), F.lit("\nx"))).otherwise(F.col("sender"))
    kept, bad = messages.reject_senders(table(spark, d, "message").withColumn("sender", s))
    n = kept.withColumn("k", F.lit(1)).unionByName(bad.withColumn("k", F.lit(0)))
    return n.groupBy("slug").agg(F.sum(1 - F.col("k")).cast("long").alias("rejected"), F.sum("k").cast("long").alias("kept"))


@query(f"WITH {_HASHED} SELECT slug, sender, count(*) AS messages, count(*) FILTER (hash NOT IN (SELECT hash FROM h WHERE source_type = 'whatsapp')) AS new_messages FROM h WHERE source_type != 'whatsapp' GROUP BY slug, sender")
def q_import_preview(spark, d):
    h = messages.hashed(roled(spark, d))
    return profiles.preview(h.where("source_type != 'whatsapp'"), h.where("source_type = 'whatsapp'"), ["slug"])


@query(f"WITH {_KEYED}, p AS (SELECT slug, key, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'persona' ELSE 'contact' END AS identity_type FROM k WHERE key != '' GROUP BY slug, key) SELECT identity_type, count(*) AS participants FROM p GROUP BY identity_type")
def q_identity_types(spark, d):
    return governance.identity_types(profiles_of(spark, d))


@query(f"WITH {_FIRST} SELECT concat(slug, '-', hash) AS id, CASE WHEN source_type IN ('obsidian','markdown','pdf','plaintext','gbrain','gbrain-export') THEN 'hall_facts' ELSE 'hall_voice' END AS hall, nullif({_strip('sender')}, '') AS sender, nullif({_strip('timestamp')}, '') AS authored_at FROM f")
def q_vector_records(spark, d):
    return messages.vector_records(unique(spark, d)).select("id", "hall", "sender", "authored_at")


@query(f"""WITH {_HASHED}, p AS (SELECT concat(slug, '-', hash) AS id, content, lower(sender) AS ks, timestamp, concat(source_file, ':', line_no) AS message_id FROM h), i AS (SELECT id, max(message_id) AS by_id FROM p GROUP BY id), x AS (SELECT content, ks, timestamp, max(message_id) AS by_text FROM p WHERE ks IS NOT NULL GROUP BY ALL),
    e AS (SELECT DISTINCT evidence_no, excerpt AS content, sender, timestamp, concat(slug, '-', substr(sha256(concat('user:', coalesce(excerpt, ''))), 1, 16)) AS id FROM evidence)
    SELECT evidence_no, coalesce(by_id, by_text) AS message_id FROM e LEFT JOIN i USING (id) LEFT JOIN x ON x.content IS NOT DISTINCT FROM e.content AND x.ks = lower(e.sender) AND x.timestamp IS NOT DISTINCT FROM e.timestamp""")
def q_evidence_lookup(spark, d):
    h = messages.hashed(roled(spark, d))
    stored = h.select(F.concat_ws("-", "slug", "hash").alias("id"), "content", "sender", "timestamp", F.concat_ws(":", "source_file", F.col("line_no").cast("string")).alias("message_id"))
    e = table(spark, d, "evidence").select("evidence_no", "slug", F.col("excerpt").alias("content"), "sender", "timestamp", F.lit("user").alias("role")).distinct()
    hits = messages.hashed(e).select("evidence_no", F.concat_ws("-", "slug", "hash").alias("id"), "content", "sender", "timestamp")
    return retrieval.stored_ids(hits, stored).select("evidence_no", "message_id")


@query("SELECT *, CASE WHEN adapter = 'social' THEN 'quarantined' ELSE 'active' END AS status FROM (SELECT DISTINCT filename, adapter FROM source_index)")
def q_quarantine(spark, d):
    i = table(spark, d, "source_index").select("filename", "adapter").distinct()
    return governance.quarantine(i, i.where("adapter = 'social'"), "social archive").drop("reason")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_event_windows(spark, d):
    return ingest.activity(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT CAST(regexp_extract(message_id, ':(\\d+)$', 1) AS INTEGER) AS line_no, count(*) AS n FROM evidence GROUP BY 1")
def q_evidence_lines(spark, d):
    return table(spark, d, "evidence").groupBy(F.regexp_extract("message_id", r":(\d+)$", 1).cast("int").alias("line_no")).agg(F.count(F.lit(1)).alias("n"))


@query()
def q_identity_aliases(spark, d):
    m = table(spark, d, "message").where("content is not null")
    return profiles.name_variants(profiles_of(spark, d), m, ["slug"])


@query()
def q_fact_extraction(spark, d):
    p = profiles_of(spark, d).select("slug", "name")
    return extract.extract(roled(spark, d), p)


_EN, _ES = (p.replace("'", "''") for p in (corrections.ENGLISH, corrections.SPANISH))
_REL = "MAP {" + ", ".join(f"'{w}': '{r}'" for w, r in corrections.WORDS.items()) + "}"
_rel = lambda c: f"{_REL}[regexp_replace(regexp_replace(translate(lower(trim({c})), 'áéíóúüñ', 'aeiouun'), '[ .,:;]+$', ''), '{corrections.ARTICLE}', '')]"
_group = lambda a, b: f"CASE WHEN regexp_matches(f, '(?i){_EN}') THEN regexp_extract(f, '(?i){_EN}', {a}) WHEN regexp_matches(f, '(?i){_ES}') THEN regexp_extract(f, '(?i){_ES}', {b}) END"
_PARSED = f"""WITH t AS (SELECT ledger_line, raw_text, {_flat("raw_text")} AS f FROM ledger WHERE raw_text IS NOT NULL), g AS (SELECT *, trim({_group(1, 1)}) AS s, trim({_group(2, 3)}) AS o, {_group(4, 2)} AS a, {_group(3, 4)} AS b FROM t), r AS (SELECT *, {_rel("a")} AS old0, {_rel("b")} AS new0 FROM g), k AS (SELECT *, coalesce(length(f) <= 2000 AND old0 IS NOT NULL AND new0 IS NOT NULL AND old0 != new0, false) AS good FROM r)
    SELECT ledger_line, raw_text, CASE WHEN good THEN s END AS subject, CASE WHEN good THEN o END AS object, CASE WHEN good THEN old0 END AS old, CASE WHEN good THEN new0 END AS new FROM k"""


@query(_PARSED)
def q_corrections_parsed(spark, d):
    return corrections.parsed(table(spark, d, "ledger").where("raw_text is not null").select("ledger_line", "raw_text"), "raw_text")


_bare = lambda c: f"trim(translate(lower({c}), 'áéíóúüñ', 'aeiouun'))"
_CORRECTED = f"""WITH u AS (SELECT regexp_replace(target_claim_id, ':(assert|retract)$', '') AS claim_id, arg_max(event_id, ledger_line) AS undo_event_id FROM ledger WHERE event_type = 'undo' AND event_id IS NOT NULL GROUP BY 1),
    st AS (SELECT c.*, CASE WHEN undo_event_id IS NULL THEN 'active' ELSE 'undone' END AS status FROM ledger c LEFT JOIN u USING (claim_id) WHERE event_type = 'correction' AND event_id IS NOT NULL),
    w AS (SELECT min(assert_subject) AS who FROM ledger WHERE event_type = 'correction' AND event_id IS NOT NULL), x AS (SELECT st.* FROM st, w WHERE status = 'active' AND {_bare("who")} IN ({_bare("assert_subject")}, {_bare("assert_object")}))
    SELECT concat('correction:', claim_id) AS message_id, substr(concat('User correction: ', assert_subject, ' --', assert_predicate, '--> ', assert_object, '; retracted ', retract_predicate, '. Instruction: ', coalesce(raw_text, '')), 1, 500) AS excerpt, 1.0::DOUBLE AS score FROM x ORDER BY ledger_line DESC LIMIT 20"""


@query(_CORRECTED)
def q_correction_evidence(spark, d):
    c = graph.ledger_status(*ledger_sides(spark, d))
    who = c.agg(F.min("assert_subject")).first()[0]
    return corrections.evidence(c, who or "", [], 20)


def profiles_flagship(spark, d):
    return profiles.profiles(unique(spark, d), by=["slug"])


QUERIES["q_profiles_flagship"] = profiles_flagship
SQL["q_profiles_flagship"] = SQL["q_profiles"].replace(f"WITH {_KEYED}", f"WITH {_FIRST}, k AS (SELECT *, {_strip('lower(sender)')} AS key, {_strip('sender')} AS who FROM f)")
