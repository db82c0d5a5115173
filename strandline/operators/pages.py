"""The persona's pages: what they say, drawn from one row of figures per archive (WX-02..04, WX-14, SNK-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import strip
from strandline.operators.profiles import voice
from strandline.operators.wiki import evidence_ids, tag_counts

# What the ten pieces of evidence of the pages are picked by.
PICKS = {
    "education": r"(?iu)\b(?:universidad|facultad|clases?|examen|estudi)\w*\b", "work": r"(?iu)\b(?:trabajo|proyecto|sistema|práctica)\w*\b", "routine": r"(?iu)\b(?:gym|iglesia|familia|family)\w*\b",
    "affection": r"(?iu)\b(?:te quiero|amor de mi vida|novia|contigo)\b", "care": r"(?iu)\b(?:cuid|apoyo|bienestar|preocup|descansa|ánimo)\w*\b", "planning": r"(?iu)\b(?:tengo un plan|voy a|mañana|tengo que|propongo|proponer)\b",
    "reasoning": r"(?iu)\b(?:creo que|pienso que|porque|la verdad|de alguna manera)\b", "family": r"(?iu)\b(?:mamá|papá|herman[oa]|familia|family|abue)\w*\b", "partner": r"(?iu)\b(?:mi querida novia|amor de mi vida|quiero todo contigo)\b",
    "learning": r"(?iu)\b(?:enseñ[ée]|ingl[eé]s|universidad|examen)\w*\b",
}
# The pages, what each cites directly, and the pages it points to.
PAGES = {
    "identity": (["first", "last", "education", "work", "routine"], ["voice", "values", "timeline"]),
    "voice": (["planning", "affection", "care", "reasoning"], ["identity", "thinking", "relationships"]),
    "values": (["care", "affection", "partner", "education", "work", "family", "learning", "routine"], ["identity", "thinking", "relationships"]),
    "thinking": (["planning", "work", "care", "reasoning", "education", "affection"], ["values", "voice", "timeline"]),
    "relationships": (["partner", "affection", "care", "planning", "family"], ["identity", "values", "timeline"]),
    "timeline": (["first", "education", "learning", "work", "last"], ["identity", "relationships", "thinking"]),
}
#: What each page says besides its evidence; names in braces are columns of `facts`.
BODIES = {
    "identity": ["Participant **{persona}**; other names: {aliases}. [L2:participants]", "**{messages}** own messages, from {first_seen} to {last_seen}.", "What is known is what was written in these messages; age, address and career are not. [L3:scope]"],
    "voice": ["**{mean_words}** words a message in the mean, **{median_words}** in the median. [L3:corpus]", "{questions} of {messages} messages ask something. [L3:corpus]", "{laughs} messages laugh, {drawn_out} draw letters out. [L3:corpus]", "How things are said when they matter. [L3:inferred]"],
    "values": ["What is cared for, and who: care, family, study and work as told directly.", "What comes back again and again in the routine. [L3:inferred]"],
    "thinking": ["Plans, reasons given, and tasks as told directly. [L3:inferred]", "This describes messages, not a mind. [L3:scope]"],
    "relationships": ["People named by **{persona}**, each of them a participant or a relative of their own. [L2:participants]", "Relatives are mentioned, not described. [L3:scope]"],
    "timeline": ["**{first_seen}**: the first own message kept.", "By month: {activity}. [L3:corpus]", "**{last_seen}**: the last own message kept; nothing is said of what came after. [L3:scope]"],
}


def personas(profiles: DataFrame) -> DataFrame:
    """WX-02: (slug, persona, n): the persona of each archive, null where it has not exactly one (n says how many)."""
    p = profiles.where("identity_type = 'persona'").groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("one"))
    return profiles.select("slug").distinct().join(p, "slug", "left").select("slug", F.when(F.col("n") == 1, F.col("one")).alias("persona"), F.coalesce("n", F.lit(0)).alias("n"))


def own_messages(messages: DataFrame, of: DataFrame) -> DataFrame:
    """WX-01 for many archives: the personas' messages, each role, content and time once (its first file and line), with evidence_id.

    messages: slug, role, content, timestamp, sender, source_file, line_no; of: slug, persona.
    """
    p = of.where("persona is not null").select("slug", F.lower(strip(F.col("persona"))).alias("who"))
    mine = messages.withColumn("who", F.lower(strip(F.col("sender")))).join(p, ["slug", "who"], "left_semi")
    first = mine.groupBy("slug", "role", "content", "timestamp").agg(F.min(F.struct("source_file", "line_no")).alias("p"))
    return evidence_ids(first.select("slug", "role", "content", "timestamp", "p.source_file", "p.line_no"))


def facts(own: DataFrame) -> DataFrame:
    """WX-03: one row per archive: messages, first and last stamp and evidence, figures of voice, activity by month, sources, and
    the evidence_id of each of PICKS. own: what `own_messages` gives. Messages are in order of stamp text, file and line.
    """
    at = F.struct(F.coalesce("timestamp", F.lit("")).alias("t"), F.col("source_file").alias("f"), F.col("line_no").alias("l"), F.col("role").alias("r"), F.coalesce("content", F.lit("")).alias("c"))
    rows = own.withColumn("at", at)
    ends = rows.groupBy("slug").agg(F.min_by("evidence_id", "at").alias("first"), F.max_by("evidence_id", "at").alias("last"), F.min(F.nullif("timestamp", F.lit(""))).alias("first_seen"), F.max(F.nullif("timestamp", F.lit(""))).alias("last_seen"), F.array_join(F.array_sort(F.collect_set("source_file")), ", ").alias("sources"))
    by_month = own.where("timestamp is not null and timestamp != ''").groupBy("slug", F.substring("timestamp", 1, 7).alias("m")).agg(F.count(F.lit(1)).alias("k"))
    months = by_month.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "m", F.col("k").cast("string")))), ", ").alias("activity"))
    # Of equally long ones the first counts: the greatest length first, then its least place.
    best = {t: F.when(F.coalesce("content", F.lit("")).rlike(p), F.length(F.coalesce("content", F.lit("")))) for t, p in PICKS.items()}
    tops = rows.groupBy("slug").agg(*[F.max(c).alias(t) for t, c in best.items()])
    flat = rows.join(tops, "slug").groupBy("slug").agg(*[F.min_by("evidence_id", F.when(best[t] == F.col(t), F.col("at"))).alias(t) for t in PICKS])
    out = voice(own.withColumn("content", F.coalesce("content", F.lit(""))), ["slug"]).join(ends, "slug").join(months, "slug", "left").join(flat, "slug")
    return out.select("slug", "messages", "mean_words", "median_words", "questions", "laughs", "drawn_out", "first", "last", "first_seen", "last_seen", "sources", "activity", *[F.coalesce(t, "first").alias(t) for t in PICKS])


def render(facts_: DataFrame, of: DataFrame) -> DataFrame:
    """WX-04: (slug, page, text) of the six pages. facts_: what `facts` gives; of: slug, persona and, if known, aliases (an array)."""
    told = facts_.join(of.where("persona is not null"), "slug")
    names = F.array_join(F.col("aliases"), ", ") if "aliases" in of.columns else F.lit("")
    told = told.withColumns({"aliases": F.coalesce(F.nullif(names, F.lit("")), F.lit("none"))})
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))

    def fill(line: str):
        parts, rest = [], line
        while "{" in rest:
            head, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(head), F.substring(blank(name), 1, 10) if name.endswith("_seen") else blank(name)]
        return F.concat(*parts, F.lit(rest))

    def page(name: str):
        cited, also = PAGES[name]
        tags = F.concat_ws(" ", *[F.concat(F.lit("[L1:"), F.col(c), F.lit("]")) for c in cited])
        lines = [F.lit(f"# {name.title()}"), F.lit(""), F.lit("## Content"), F.lit(""), *[F.concat(F.lit("- "), fill(x)) for x in BODIES[name]], F.concat(F.lit("- Evidence: "), tags), F.lit(""), F.lit("## Sources"), F.lit("")]
        sources = F.array_join(F.transform(F.split("sources", ", "), lambda x: F.concat(F.lit("- `"), x, F.lit("`: own messages, by line [L1]"))), "\n")
        return F.struct(F.lit(name).alias("page"), F.concat(F.concat_ws("\n", *lines, sources, F.lit(""), F.lit("## See also"), F.lit(""), *[F.lit(f"- [[{x}]]") for x in also]), F.lit("\n")).alias("text"))

    return told.select("slug", F.explode(F.array(*[page(p) for p in PAGES])).alias("p")).select("slug", "p.page", "p.text")


def evidence_index(pages: DataFrame) -> DataFrame:
    """SNK-11: (slug, page, L1..L4): evidence tags of each page by level."""
    keyed = pages.select(F.concat_ws("\x1f", "slug", "page").alias("page"), "text")
    n = tag_counts(keyed).withColumn("k", F.split("page", "\x1f"))
    return n.select(F.get("k", F.lit(0)).alias("slug"), F.get("k", F.lit(1)).alias("page"), "L1", "L2", "L3", "L4")


def table_page(rows: list[tuple], title: str, note: str, columns: list[str]) -> str:
    """A page that is one table."""
    cells = lambda r: "| " + " | ".join(str(x) for x in r) + " |"
    return "\n".join([f"# {title}", "", f"> {note}", "", cells(columns), "|" + "---|" * len(columns), *map(cells, rows), ""])


def changelog(old: str | None, day: str, pages: list[str], sources: list[str]) -> str:
    """SNK-11: the change log with a row for this rebuild, once."""
    columns = ["Date", "Pages", "Action", "Source"]
    empty = table_page([], "Changelog", "Record of rebuilt pages.", columns)
    row = f"| {day} | {', '.join(pages)} | rebuilt | {', '.join(sources)} |"
    kept = old if old and "| Date | Pages | Action | Source |" in old else empty
    return kept if row in kept else f"{kept.rstrip()}\n{row}\n"


def stubs(broken: DataFrame) -> DataFrame:
    """WX-14: (page, text): an empty page for each target that links name and no page has. broken: page, target."""
    return broken.select(F.col("target").alias("page")).distinct().withColumn("text", F.concat(F.lit("# "), F.initcap(F.translate("page", "-", " ")), F.lit("\n\n> (stub, to be filled)\n\n## Content\n\n## Sources\n\n## See also\n")))


__all__ = ["PAGES", "PICKS", "changelog", "evidence_index", "facts", "own_messages", "personas", "render", "stubs", "table_page"]
