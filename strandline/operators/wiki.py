"""Pages: evidence, links, sections, lint, questions, probes (WX-01, WX-02, WX-05..08, WX-10, WX-11, AG-11, JN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.messages import strip
from strandline.sources.readers import LINE_END

# Sections that hold no content, what an empty page says, and questions by page.
STRUCTURAL = ("Sources", "See also", "References", "Metadata")
AWAITING = "(awaiting"
QUESTIONS = {
    "identity": "Tell me about yourself.", "voice": "How do you typically express yourself?", "values": "What do you value most?",
    "thinking": "How do you approach problems?", "relationships": "Tell me about the people in your life.", "timeline": "What are some important events in your life?",
}
TAG, LINK = r"\[L(\d):?[\w-]*\]", r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def evidence_ids(messages: DataFrame) -> DataFrame:
    """Messages with evidence_id: the file's stem as a slug, and the line in six digits."""
    stem = F.regexp_replace(F.lower(F.regexp_replace("source_file", r"\.[^.]*$", "")), r"[^a-z0-9]+", "-")
    return messages.withColumn("evidence_id", F.concat_ws("-", F.regexp_replace(stem, "^-+|-+$", ""), F.lpad(F.col("line_no").cast("string"), 6, "0")))


def persona_messages(messages: DataFrame, persona: str) -> DataFrame:
    """WX-01: the persona's messages, each role, content and time once (its first file and line), in order of stamp text."""
    mine = messages.where(F.lower(strip(F.col("sender"))) == persona.strip().lower())
    key = ["role", "content", "timestamp"]
    first = mine.groupBy(*key).agg(F.min(F.struct("source_file", "line_no")).alias("p"), F.min_by("sender", F.struct("source_file", "line_no")).alias("sender"))
    return evidence_ids(first.select(*key, "sender", "p.source_file", "p.line_no")).orderBy(F.coalesce("timestamp", F.lit("")), "source_file", "line_no")


def tag_counts(pages: DataFrame) -> DataFrame:
    """AG-11: evidence tags per page and level, levels as columns."""
    t = pages.select("page", F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(1))).alias("level"))
    n = t.groupBy("page").pivot("level", ["1", "2", "3", "4"]).count()
    all_ = pages.select("page").join(n, "page", "left")
    return all_.select("page", *[F.coalesce(F.col(k), F.lit(0)).alias(f"L{k}") for k in "1234"])


def broken_links(pages: DataFrame) -> DataFrame:
    """JN-12: (page, target): links of content pages to pages that do not exist."""
    links = pages.where(~F.col("page").startswith("_")).select("page", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target")).select("page", strip(F.col("target")).alias("target")).distinct()
    return links.join(pages.select(F.col("page").alias("target")), "target", "left_anti").select("page", "target")


def sections(pages: DataFrame) -> DataFrame:
    """WX-07: (page, title, text) of each section `## title` with text, structural ones left out."""
    ls = pages.select("page", F.posexplode(F.split("text", LINE_END)).alias("i", "line"))
    w = Window.partitionBy("page").orderBy("i")
    head = F.col("line").startswith("## ")
    cut = ls.withColumn("s", F.sum(head.cast("int")).over(w)).where("s > 0")
    body = F.when(~head & ~F.col("line").startswith("# "), F.struct("i", "line"))
    g = cut.groupBy("page", "s").agg(F.max(F.when(head, strip(F.expr("substring(line, 4)")))).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("text"))
    return g.withColumn("text", strip(F.col("text"))).where((F.col("title") != "") & ~F.col("title").isin(*STRUCTURAL) & (F.col("text") != "") & (F.col("text") != "(awaiting data ingestion)")).select("page", "s", "title", "text")


def plain(text: Column) -> Column:
    """Text without evidence tags and link brackets."""
    return F.regexp_replace(strip(F.regexp_replace(text, r"\[L\d:?[\w-]*\]", "")), r"\[\[([\w-]+)\]\]", "$1")


def questions(sections_: DataFrame) -> DataFrame:
    """WX-08: (page, s, question, answer) of sections of 30 characters or more."""
    topic = F.when(F.lower("title") == "content", F.translate("page", "-", " ")).otherwise(F.lower("title"))
    known = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])
    q = F.coalesce(F.element_at(known, F.col("page")), F.concat(F.lit("Tell me about your "), topic, F.lit(".")))
    return sections_.select("page", "s", q.alias("question"), plain(F.col("text")).alias("answer")).where(F.length("answer") >= 30)


def content(pages: DataFrame) -> DataFrame:
    """The Content section of each page, plain."""
    return pages.select("page", plain(F.regexp_extract("text", r"(?s)## Content\s*\n(.*?)(?=\n## |\Z)", 1)).alias("content"))


def profile(pages: DataFrame, name: str) -> str:
    """WX-10: one document of the identity, voice, values and thinking pages, contents of 20 characters or more. Four rows come to the driver."""
    order = ["identity", "voice", "values", "thinking"]
    rows = {r["page"]: r["content"] for r in content(pages.where(F.col("page").isin(*order) & ~(F.contains("text", F.lit(AWAITING)) & (F.length(strip(F.col("text"))) < 200)))).collect()}
    parts = [f"## {p.title()}\n\n{rows[p]}\n" for p in order if len(rows.get(p) or "") >= 20]
    return "\n".join([f"# {name}\n", *(parts or ["(No wiki content available yet. Ingest data and build wiki first.)\n"])])


def probes(pages: DataFrame, name: str) -> list[dict]:
    """WX-11: what to ask a model of the persona: its name, and the beginnings of the identity and voice pages."""
    rows = {r["page"]: r["content"] or "" for r in content(pages.where(F.col("page").isin("identity", "voice"))).collect()}
    out = [{"id": "name", "question": "What is your name?", "keywords": [name], "weight": 1.0}]
    for page, question, weight, size in (("identity", "Tell me about yourself.", 0.8, 20), ("voice", "Say something in your own style.", 0.5, 10)):
        start = rows.get(page, "")[:size].strip()
        if start and AWAITING not in rows[page]:
            out.append({"id": page, "question": question, "keywords": [start], "weight": weight})
    return out


def unresolved(pages: DataFrame) -> DataFrame:
    """WX-06: sections of _contradictions that no line marks as resolved (the word, so `unresolved` does not count)."""
    ls = pages.where("page = '_contradictions'").select("page", F.posexplode(F.split("text", LINE_END)).alias("i", "line"))
    cut = ls.withColumn("s", F.sum(F.col("line").startswith("## ").cast("int")).over(Window.partitionBy("page").orderBy("i"))).where("s > 0")
    g = cut.groupBy("s").agg(F.max(~F.col("line").startswith("## ") & F.col("line").rlike(r"(?i)\bresolved\b")).alias("done"))
    return g.agg(F.coalesce(F.sum((~F.col("done")).cast("long")), F.lit(0)).alias("unresolved"))


def coverage(pages: DataFrame, source_names: DataFrame) -> DataFrame:
    """JN-13: one row: sources, those that some page names, and the gap in percent.

    A name that stands in a page is met there by its first word, as a whole word, so names and pages meet in an equi-join.
    """
    named = source_names.select("source_file").distinct().withColumn("stem", F.regexp_replace("source_file", r"\.jsonl$", "")).withColumn("first", F.regexp_extract("stem", r"(?U)(\w+)", 1))
    words = pages.select("page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("word"))
    tails = named.select("first").distinct().where("first != ''")
    held = words.join(tails, F.col("word") == F.col("first")).select("page", "first").distinct()
    hit = named.join(held, "first").join(pages.select("page", "text"), "page").where(F.contains("text", F.col("stem"))).select("source_file").distinct().withColumn("hit", F.lit(True))
    n = named.join(hit, "source_file", "left").agg(F.count(F.lit(1)).alias("total_sources"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("referenced"))
    return n.withColumn("gap_pct", F.bround(100 * (F.col("total_sources") - F.col("referenced")) / F.greatest("total_sources", F.lit(1))).cast("long"))


def lint(pages: DataFrame, source_names: DataFrame | None = None) -> DataFrame:
    """WX-05: (type, page, detail): broken links, stubs, little evidence, open contradictions, few sources, no changes recorded."""
    body = strip(F.col("text"))
    own = pages.where(~F.col("page").startswith("_"))
    stubs = own.where((F.length(body) < 100) | F.contains("text", F.lit(AWAITING))).select(F.lit("empty_page").alias("type"), "page", F.length(body).cast("string").alias("detail"))
    tags = tag_counts(own).withColumn("n", F.col("L1") + F.col("L2") + F.col("L3") + F.col("L4")).where("n < 2")
    few = tags.join(own.where(F.length(body) > 100).select("page"), "page").select(F.lit("low_evidence").alias("type"), "page", F.col("n").cast("string").alias("detail"))
    broken = broken_links(pages).select(F.lit("broken_link").alias("type"), "page", F.col("target").alias("detail"))
    open_ = unresolved(pages).where("unresolved > 0").select(F.lit("unresolved_contradictions").alias("type"), F.lit("_contradictions").alias("page"), F.col("unresolved").cast("string").alias("detail"))
    row = lambda x: F.contains(x, F.lit("|")) & ~x.startswith("#") & ~x.startswith(">") & (F.regexp_replace(strip(x), r"[|\-\s]", "") != "")
    changes = pages.where("page = '_changelog'").agg(F.coalesce(F.max(F.size(F.filter(F.split("text", LINE_END), row))), F.lit(0)).alias("n")).where("n < 2").select(F.lit("empty_changelog").alias("type"), F.lit("_changelog").alias("page"), F.col("n").cast("string").alias("detail"))
    out = broken.unionByName(stubs).unionByName(few).unionByName(open_).unionByName(changes)
    if source_names is not None:
        out = out.unionByName(coverage(pages, source_names).where("gap_pct > 30").select(F.lit("low_source_coverage").alias("type"), F.lit("").alias("page"), (100 - F.col("gap_pct")).cast("string").alias("detail")))
    return out
