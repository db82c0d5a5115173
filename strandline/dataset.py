"""One archive on disk: create, import, rebuild, ask, correct, add context, pages, export, checks. Tables are published whole (see sources.sinks)."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.messages import collapse, term_overlap, vector_id
from strandline.operators import context, corrections, dialogue, extract, governance, graph, messages, pages, privacy, profiles, resolve, retrieval, wiki
from strandline.session import durable
from strandline.sources import readers, sinks

# The pages a new archive has, content and otherwise.
TEMPLATES = [*pages.PAGES, "_schema", "_contradictions", "_changelog", "_evidence"]
SLUG = r"[a-z0-9][a-z0-9_-]*"


class DatasetError(ValueError):
    """An archive that is not there, or a request that does not fit it."""


def now() -> datetime:
    return datetime.now(timezone.utc)


def choose(spark: SparkSession, root: str, slug: str | None = None) -> str:
    """PRJ-11: the slug of the archive meant: the one given, or named by STRANDLINE_SLUG, or the only one under root."""
    wanted = (slug or os.environ.get("STRANDLINE_SLUG", "")).strip()
    if wanted:
        if not re.fullmatch(SLUG, wanted):
            raise DatasetError("a slug is made of lower-case letters, digits, hyphens and underscores, and begins with a letter or digit")
        return wanted
    fs, p = sinks._fs(spark, f"{root.rstrip('/')}/*/dataset.json")
    found = sorted(f.getPath().getParent().getName() for f in fs.globStatus(p) or [])
    if len(found) != 1:
        raise DatasetError(f"{len(found)} archives under {root}: {', '.join(found)}")
    return found[0]


class Dataset:
    """The archive of one persona under root/slug."""

    def __init__(self, spark: SparkSession, root: str, slug: str, persona: str = ""):
        if not re.fullmatch(SLUG, slug):
            raise DatasetError(f"{slug!r} is no slug")
        self.spark, self.path, self.slug, self.persona = spark, f"{root.rstrip('/')}/{slug}", slug, persona

    # -- metadata --------------------------------------------------------------------------------------------------

    def create(self, name: str) -> None:
        """SNK-15: a new archive: its metadata and empty pages."""
        if sinks.read_text(self.spark, f"{self.path}/dataset.json") is not None:
            raise DatasetError(f"{self.path} is there already")
        self._write_metadata({"schema_version": 1, "slug": self.slug, "name": name, "created_at": now().isoformat(), "stats": {}, "export_history": []})
        for page in TEMPLATES:
            sinks.write_text(self.spark, f"{self.path}/wiki/{page}.md", f"# {page.strip('_').title()}\n\n## Content\n\n(awaiting data ingestion)\n")

    def metadata(self) -> dict:
        return json.loads(sinks.read_text(self.spark, f"{self.path}/dataset.json") or "{}")

    def _write_metadata(self, meta: dict) -> None:
        sinks.write_text(self.spark, f"{self.path}/dataset.json", json.dumps(meta, ensure_ascii=False, indent=2) + "\n")

    def identity_aliases(self) -> DataFrame:
        """SRC-31: (key, alias) of identity_aliases.json; none where it is absent or malformed."""
        text = sinks.read_text(self.spark, f"{self.path}/identity_aliases.json") or "{}"
        one = self.spark.createDataFrame([(text,)], "text string")
        a = one.select(F.explode(F.from_json(F.get_json_object("text", "$.canonical"), "map<string,string>")).alias("name", "raw"))
        each = a.select(F.lower("name").alias("key"), F.explode(F.from_json("raw", "array<string>")).alias("alias"))
        return each.select("key", F.trim("alias").alias("alias")).where("alias != ''")

    def participants(self) -> DataFrame:
        """Profiles with all their names: their own and those of the alias file."""
        a = self.identity_aliases().groupBy("key").agg(F.collect_set("alias").alias("more"))
        p = self.table("profiles").join(a, "key", "left")
        return p.withColumn("aliases", F.array_sort(F.array_union(F.array("name"), F.coalesce("more", F.array().cast("array<string>"))))).drop("more")

    # -- import ----------------------------------------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame | None:
        return sinks.current(self.spark, self.path, name) if sinks.published(self.spark, self.path) else None

    def table(self, name: str) -> DataFrame:
        """messages, profiles, edges or vectors of the published version."""
        found = self._table(name)
        if found is None:
            raise FileNotFoundError(f"nothing has been imported into {self.path}")
        return found

    def read(self, source: str, since: str | None = None) -> DataFrame:
        """The messages of a source, first occurrences, with hash, without those that are there already."""
        rows = readers.read(self.spark, source, self.persona, since)
        kept, _ = messages.reject_senders(rows)
        new = messages.hashed(kept.withColumn("slug", F.lit(self.slug)))
        old = self._table("messages")
        known = old if old is not None else self.spark.createDataFrame([], "hash string")
        return messages.only_new(new, known, ["source_file", "line_no", "hash"])

    def resolve_persona(self, source: str) -> str:
        """GV-16, PRJ-03: the sender that the persona's name means: the same, or the only one of which one holds the other."""
        rows = readers.read(self.spark, source, self.persona, None).where("sender is not null and sender != ''").select(F.col("sender").alias("name")).distinct()
        who = resolve.resolve(self.spark.createDataFrame([(self.persona,)], "query string"), rows).first()
        if who["entity"] is None:
            raise DatasetError(f"{self.persona!r} is {who['matches']} of the senders")
        return who["entity"]

    def equivalent(self, source: str) -> DataFrame:
        """GV-02: stored sources that hold the same messages as a source, apart from spacing and case."""
        stored = self._table("messages")
        if stored is None:
            return self.spark.createDataFrame([], "source_file string")
        fp = F.sha2(F.nullif(collapse(F.lower("content")), F.lit("")), 256)
        both = stored.select("source_file", fp.alias("fp")).unionByName(readers.read(self.spark, source, self.persona, None).select(F.lit("\x00new").alias("source_file"), fp.alias("fp")))
        same = messages.equivalent_sources(both.withColumnRenamed("source_file", "source")).where("equivalent and (a = '\x00new' or b = '\x00new')")
        return same.select(F.when(F.col("a") == "\x00new", F.col("b")).otherwise(F.col("a")).alias("source_file"))

    def preview(self, source: str, since: str | None = None) -> dict:
        """GV-16: what an import would bring, without writing: new messages by sender (all of them), personal data by kind, and the
        stored sources that are the same."""
        new = durable(self.read(source, since), "preview")
        by = {r["sender"]: r["n"] for r in new.groupBy("sender").agg(F.count(F.lit(1)).alias("n")).collect()}
        pii = privacy.scan(new, "content", []).first().asDict() if not new.isEmpty() else {}
        return {"new": new.count(), "senders": dict(sorted(by.items(), key=lambda x: (-x[1], x[0] or ""))), "personal_data": {k: v for k, v in pii.items() if v}, "equivalent": sorted(r[0] for r in self.equivalent(source).collect())}

    def add(self, source: str, since: str | None = None, equivalent: str = "block") -> str:
        """Import a source and publish all layers. equivalent: what to do where stored sources are the same: `block`, `allow` (add
        what is new), or `reconcile` (GV-03: replace those sources and keep their names in the index as quarantined)."""
        same = durable(self.equivalent(source), "equivalent")
        if equivalent == "block" and not same.isEmpty() and not self.read(source, since).isEmpty():
            raise DatasetError(f"the same messages are stored in {[r[0] for r in same.collect()]}; allow or reconcile")
        stamp = F.lit(now())
        old = self._table("messages")
        if equivalent == "reconcile" and not same.isEmpty():
            rows = messages.hashed(messages.reject_senders(readers.read(self.spark, source, self.persona, since))[0].withColumn("slug", F.lit(self.slug)))
            kept, brought = governance.replaced(old, rows, same)
            if brought.isEmpty():
                raise DatasetError("the source brings nothing that the other sources lack")
            return self.rebuild(kept.drop("seq").unionByName(brought.withColumn("imported_at", stamp), allowMissingColumns=True), aside=same)
        new = durable(self.read(source, since), "import").withColumn("imported_at", stamp)
        return self.rebuild(new if old is None else old.drop("seq").unionByName(new, allowMissingColumns=True))

    def keep_only(self, source_file: str) -> dict:
        """GV-04: set all sources but one aside and rebuild from that one."""
        m = self.table("messages")
        kept = m.where(F.col("source_file") == source_file)
        if kept.isEmpty():
            raise DatasetError(f"no messages of {source_file}")
        aside = m.select("source_file").distinct().where(F.col("source_file") != source_file)
        names = sorted(r[0] for r in aside.collect())
        self.rebuild(kept.drop("seq"), aside=durable(aside, "aside"))
        return {"kept": source_file, "quarantined": names, "messages": self.table("messages").count()}

    def sources(self) -> DataFrame:
        """SNK-01: the index of sources: lines, assistant_turns, content_hash, status (active, quarantined)."""
        return self.table("sources")

    def rebuild(self, rows: DataFrame | None = None, aside: DataFrame | None = None) -> str:
        """GV-15: derive profiles, edges, vectors and the index of sources anew from the messages, and publish them together.

        aside: source_file of sources that are no longer used; they stay in the index as quarantined.
        """
        rows = self.table("messages").drop("seq") if rows is None else rows
        m = durable(rows.repartitionByRange("source_file", "line_no", "hash").sortWithinPartitions("source_file", "line_no", "hash").withColumn("seq", F.monotonically_increasing_id()), "messages")
        p = profiles.profiles(m, by=["slug"])
        told = extract.extract(m, p.select("slug", "name")).where("kind = 'relation'").join(m.select("seq", "source_file", "timestamp"), "seq")
        told = told.select("slug", F.col("name").alias("subject"), F.when(F.col("sender") != "", F.col("sender")).otherwise(F.col("slug")).alias("object"), F.col("relation").alias("type"), "confidence", F.col("source_file").alias("source"), "timestamp", F.col("seq").alias("ord"))
        base = graph.membership(m).unionByName(graph.communication(m)).unionByName(graph.romance(m)).withColumn("ord", F.lit(-1).cast("long"))
        edges = durable(graph.owned(graph.merge_edges(base.unionByName(told), ["slug"], "ord").drop("ord"), "strandline"), "edges")
        index = dialogue.source_statistics(m).withColumn("status", F.lit("active"))
        old = self._table("sources")
        gone = old.where("status = 'quarantined'") if old is not None else index.limit(0)
        if aside is not None and old is not None:
            gone = gone.unionByName(old.join(aside, "source_file", "left_semi").where("status = 'active'").withColumn("status", F.lit("quarantined")))
        index = index.unionByName(gone.join(index.select("source_file"), "source_file", "left_anti"))
        version = sinks.publish({"messages": m, "profiles": p, "edges": edges, "vectors": messages.vector_records(m), "sources": index}, self.path)
        stats = governance.statistics(m, edges, ["slug"]).drop("slug").first()
        self._write_metadata(self.metadata() | {"slug": self.slug, "stats": stats.asDict() if stats else {}})
        return version

    # -- corrections -----------------------------------------------------------------------------------------------

    def ledger(self) -> tuple[DataFrame, DataFrame]:
        """(corrections with status, undos), in order of append; a malformed ledger is an error (SRC-30)."""
        fs, p = sinks._fs(self.spark, f"{self.path}/corrections/events")
        e = sinks.read_ledger(self.spark, f"{self.path}/corrections") if fs.exists(p) else self.spark.createDataFrame([], sinks.EVENT)
        e = e.withColumn("ord", F.unix_micros(F.to_timestamp("created_at")))
        undo = e.where("event_type = 'undo'")
        return graph.ledger_status(e.where("event_type = 'correction'").drop("target_claim_id"), undo), undo

    def effective(self) -> DataFrame:
        """The edges under the active corrections."""
        return graph.effective(self.table("edges"), self.ledger()[0].where("status = 'active'"))

    def preview_correction(self, text: str) -> dict:
        """KG-22: what a correction would retract and assert, and whether it is applied already; nothing is written."""
        subject, obj, old, new = corrections.parse(self.spark, text)
        edges = durable(self.effective(), "effective")
        names = edges.select(F.col("subject").alias("name")).unionByName(edges.select(F.col("object").alias("name")))
        a = self.identity_aliases().join(names.select("name").distinct(), F.lower("name") == F.col("key")).select("name", "alias")
        found = {r["query"]: r["entity"] for r in resolve.resolve(self.spark.createDataFrame([(subject,), (obj,)], "query string"), names, a, accents=False).collect()}
        if not found.get(subject) or not found.get(obj):
            raise corrections.CorrectionError(f"Not one entity each: {subject}, {obj}")
        s, o = found[subject], found[obj]
        mark = corrections.fingerprint(s, old, o, new)
        matched = [r["claim_id"] for r in corrections.matching(edges.select("subject", "type", "object", "claim_id"), s, old, o).collect()]
        pii = privacy.scan(self.spark.createDataFrame([(text,)], "content string"), "content", []).first().asDict()
        return {"subject": s, "object": o, "old": old, "new": new, "fingerprint": mark, "matched": matched, "personal_data": sorted(k for k, v in pii.items() if v), "applied": self._active(mark) is not None}

    def _active(self, mark: str) -> str | None:
        row = self.ledger()[0].where((F.col("status") == "active") & (F.col("fingerprint") == mark)).first()
        return row["claim_id"] if row else None

    def correct(self, text: str) -> dict:
        """KG-23: append a correction. The same one, while it is active, is not appended again; another active one that retracts the
        same claim is an error; both are looked up under the ledger's lock."""
        p = self.preview_correction(text)
        s, o, old, new, mark = p["subject"], p["object"], p["old"], p["new"], p["fingerprint"]
        claim = f"claim-{mark[7:23]}-{int(now().timestamp() * 1e6)}"
        event = {"event_type": "correction", "claim_id": claim, "created_at": now().isoformat(), "raw_text": text, "fingerprint": mark, "retract_subject": s, "retract_predicate": old, "retract_object": o, "assert_subject": s, "assert_predicate": new, "assert_object": o}

        def refuse() -> dict | None:
            if known := self._active(mark):
                return {"appended": False, "claim_id": known, "fingerprint": mark}
            if not corrections.conflicts(self.ledger()[0], s, old, o).isEmpty():
                raise corrections.CorrectionError(f"Another active correction retracts {s} {old} {o} already; undo it first")
            if not p["matched"]:
                raise corrections.CorrectionError(f"No {old} connects {s} and {o}")
            return None

        refused = sinks.append_event(self.spark, f"{self.path}/corrections", event, refuse)
        return refused or {"appended": True, "claim_id": claim, "fingerprint": mark}

    def undo(self, claim: str) -> bool:
        """KG-24: undo a correction by its claim id; False where it is undone already."""
        hit = corrections.undo_target(self.ledger()[0], claim).limit(2).collect()
        if len(hit) != 1:
            raise corrections.CorrectionError(f"{claim} names {len(hit)} corrections")
        if hit[0]["status"] == "undone":
            return False
        event = {"event_type": "undo", "target_claim_id": hit[0]["claim_id"], "created_at": now().isoformat()}
        return sinks.append_event(self.spark, f"{self.path}/corrections", event, lambda: None if self.ledger()[0].where((F.col("claim_id") == hit[0]["claim_id"]) & (F.col("status") == "active")).count() else {}) is None

    # -- manual context ----------------------------------------------------------------------------------------------

    def preview_context(self, source: str, about: str | None = None) -> dict:
        """GV-10: the blocks of a context source with kind, subject and whether they are stored already; nothing is written."""
        raw = self.spark.read.format("binaryFile").load(source).select("path", "content", F.sha2("content", 256).alias("digest"))
        why = context.refusals(raw).first()
        if why is None or why["refused"]:
            raise context.ContextError(f"{source}: {why['refused'] if why else 'not there'}")
        forced = self._participant(about)["name"] if about else None
        text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
        blocks = raw.select(F.lit(self.slug).alias("slug"), F.posexplode(context.blocks(text)).alias("i", "block")).select("slug", (F.col("i") + 1).alias("number"), "block")
        names = self.participants().select("slug", "name", F.explode("aliases").alias("alias"))
        p = durable(context.preview(blocks, names, self.table("messages"), ["slug"], forced), "context")
        if bad := [f"block {r['number']}: {r['problem']}" for r in p.where("problem is not null").orderBy("number").collect()]:
            raise context.ContextError("; ".join(bad))
        kinds = {r["kind"]: r["records"] for r in context.kind_counts(p, ["slug"]).collect()}
        return {"source": source, "digest": raw.first()["digest"], "records": p, "kinds": kinds, "duplicates": p.where("duplicate").count()}

    def add_context(self, preview: dict) -> dict:
        """GV-10: store what a preview showed, if the source is still the same. All layers are published together, so a failure leaves
        them as they were."""
        raw = self.spark.read.format("binaryFile").load(preview["source"]).select(F.sha2("content", 256)).first()
        if raw is None or raw[0] != preview["digest"]:
            raise context.ContextError("the source has changed since it was previewed")
        new = context.messages(preview["records"], preview["source"].rsplit("/", 1)[-1]).withColumns({"slug": F.lit(self.slug), "imported_at": F.lit(now())})
        n = new.count()
        if n:
            self.rebuild(self.table("messages").drop("seq").unionByName(new, allowMissingColumns=True))
        return {"stored": n, "duplicates": preview["duplicates"]}

    # -- questions, pages and exports --------------------------------------------------------------------------------

    def _participant(self, about: str) -> dict:
        p = self.participants()
        who = resolve.resolve(self.spark.createDataFrame([(about,)], "query string"), p, p.select("name", F.explode("aliases").alias("alias"))).first()
        if who["entity"] is None:
            raise DatasetError(f"{about} is {who['matches']} participants")
        return p.where(F.col("name") == who["entity"]).first().asDict()

    def ask(self, question: str, about: str, limit: int = retrieval.LIMIT, budget: int = retrieval.BUDGET, distances: Callable[[DataFrame], DataFrame] | None = None, provider: retrieval.Provider = retrieval.quote) -> dict:
        """RET-19: a grounded answer about one participant, corrections first.

        distances gives messages their `distance` to the question, from whatever embeddings there are; without it the
        distance is one minus the share of the question's terms that a message holds. provider words the answer.
        """
        profile = self._participant(about)
        name = profile["name"]
        q = retrieval.topic_terms(question, name)
        stored = self.table("messages").withColumns({"id": vector_id(F.col("slug"), F.col("hash")), "message_id": F.concat_ws(":", "source_file", F.col("line_no").cast("string"))})
        mine = stored.where(F.lower("sender") == name.lower())
        hits = distances(mine) if distances else mine.withColumn("distance", 1 - term_overlap(q, F.col("content")) / F.lit(max(len(q), 1)))
        pool = hits.orderBy("distance", "id").limit(retrieval.candidates(limit)).select("id", "content", "sender", "timestamp", "distance")
        e = retrieval.evidence(pool, stored.select("id", "message_id", "content", "sender", "timestamp"), question, name, limit, budget)
        told = corrections.evidence(self.ledger()[0], name, q, limit).withColumn("place", F.monotonically_increasing_id())
        both = durable(retrieval.merged(told, e, limit, budget), "evidence")
        more = retrieval.enrichment(self.table("profiles").where(F.col("name") == name), self.effective().withColumn("slug", F.lit(self.slug)), self.pages()).first()
        return retrieval.answer(both, question, name, provider, more.asDict() if more else {})

    def pages(self) -> DataFrame:
        """(slug, page, text) of the archive's pages."""
        fs, p = sinks._fs(self.spark, f"{self.path}/wiki/*.md")
        if not fs.globStatus(p):
            return self.spark.createDataFrame([], "slug string, page string, text string")
        return readers.whole_files(self.spark, f"{self.path}/wiki", "*.md").select(F.lit(self.slug).alias("slug"), F.regexp_replace("file", r"\.md$", "").alias("page"), "text")

    def build_pages(self) -> dict:
        """WX-04, SNK-11: write the persona's six pages, the evidence index and the change log. Six rows come to the driver."""
        of = durable(pages.personas(self.table("profiles")).join(self.participants().select("slug", F.col("name").alias("persona"), "aliases"), ["slug", "persona"], "left"), "persona")
        one = of.first()
        if one is None or one["persona"] is None:
            raise DatasetError(f"{one['n'] if one else 0} personas, not one")
        rendered = durable(pages.render(pages.facts(pages.own_messages(self.table("messages"), of)), of), "pages")
        texts = {r["page"]: r["text"] for r in rendered.collect()}
        for page, text in texts.items():
            sinks.write_text(self.spark, f"{self.path}/wiki/{page}.md", text)
        index = {r["page"]: r for r in pages.evidence_index(rendered).collect()}
        rows = [(p, *[index[p][f"L{k}"] for k in range(1, 5)]) for p in pages.PAGES if p in index]
        sinks.write_text(self.spark, f"{self.path}/wiki/_evidence.md", pages.table_page(rows, "Evidence Index", "Evidence tags by page.", ["Page", "L1", "L2", "L3", "L4"]))
        named = sorted(r[0] for r in self.sources().where("status = 'active'").select("source_file").collect())
        old = sinks.read_text(self.spark, f"{self.path}/wiki/_changelog.md")
        sinks.write_text(self.spark, f"{self.path}/wiki/_changelog.md", pages.changelog(old, now().date().isoformat(), list(texts), named))
        return {"persona": one["persona"], "pages": len(texts)}

    def lint(self, fix: bool = False) -> list[dict]:
        """WX-05, WX-14: what is wrong with the pages; with `fix`, pages that links name are made as stubs first."""
        p = durable(self.pages(), "pages")
        if fix:
            for r in pages.stubs(wiki.broken_links(p)).collect():
                if re.fullmatch(r"[\w-]+", r["page"]):
                    sinks.write_text(self.spark, f"{self.path}/wiki/{r['page']}.md", r["text"])
            p = durable(self.pages(), "pages")
        return [r.asDict() for r in wiki.lint(p, self.sources().where("status = 'active'").select("source_file")).collect()]

    def export(self, path: str, policy: str = "block", version: str | None = None) -> dict:
        """WX-09..13, GV-07, AG-12, SNK-12: under path/version the dialogue turns as JSON lines, the profile, probes, and metadata with
        the quality figures and a digest of the turns; the archive's history names the export. Personal data blocks, is redacted, or
        is let through."""
        turns = durable(dialogue.turns(self.table("messages"), ["source_file"], ["line_no", "hash"]), "export")
        if policy == "redact":
            turns = privacy.redact(turns, "content")
        elif policy == "block" and not privacy.gate(turns.withColumn("g", F.lit(1)), "content", ["g"]).where("decision = 'block'").isEmpty():
            raise DatasetError("the export holds personal data")
        meta = self.metadata()
        history = meta.get("export_history", [])
        version = version or dialogue.next_version([h["version"] for h in history])
        at = f"{path.rstrip('/')}/{version}"
        turns = durable(turns.select("source_file", "turn", "role", "content"), "export-turns")
        turns.repartitionByRange("source_file", "turn").sortWithinPartitions("source_file", "turn").write.mode("overwrite").json(f"{at}/conversations")
        digest = dialogue.source_statistics(turns.select(F.lit("all").alias("source_file"), F.concat_ws(":", "source_file", F.col("turn").cast("string")).alias("line_no"), "role", "content")).first()
        p = durable(self.pages(), "pages")
        name = (pages.personas(self.table("profiles")).first() or {"persona": None})["persona"] or meta.get("name") or self.slug
        sinks.write_text(self.spark, f"{at}/profile.md", wiki.profile(p, name))
        sinks.write_text(self.spark, f"{at}/probes.json", json.dumps(wiki.probes(p, name), ensure_ascii=False, indent=2))
        figures = dialogue.quality(turns).first().asDict()
        entry = {"version": version, "digest": digest["content_hash"] if digest else hashlib.sha256(b"").hexdigest()[:16], "exported_at": now().isoformat(), "policy": policy}
        sinks.write_text(self.spark, f"{at}/metadata.json", json.dumps(entry | {"slug": self.slug, "quality": figures, "stats": meta.get("stats", {})}, ensure_ascii=False, indent=2))
        self._write_metadata(meta | {"export_history": [*history, entry]})
        return figures | {"version": version}

    def smoke(self) -> dict:
        """GV-13: five checks across the layers, each passed or with its reason: names resolve, persona and a contact connect, messages
        of a participant are that participant's, pages are sound, dialogue comes in pairs."""
        p = durable(self.participants(), "participants")
        checks: dict[str, str] = {}
        said = p.select("name", F.explode("aliases").alias("alias"))
        wrong = resolve.resolve(said.select(F.col("alias").alias("query")), p, said).join(said, F.col("query") == F.col("alias")).where(~F.col("entity").eqNullSafe(F.col("name"))).count()
        checks["names"] = "no participants" if p.isEmpty() else f"{wrong} names resolve to another" if wrong else "passed"
        persona, contacts = p.where("identity_type = 'persona'").first(), p.where("identity_type = 'contact'").select(F.col("name").alias("node"))
        reached = graph.shortest_paths(self.effective(), persona["name"]) if persona else None
        checks["paths"] = "passed" if persona and not reached.join(contacts, "node").isEmpty() else "no path connects the persona to a contact"
        strange = self.table("vectors").where("sender is not null").join(p.select(F.col("key")), F.lower("sender") == F.col("key"), "left_anti").count()
        checks["messages"] = f"{strange} vectors of no participant" if strange else "passed"
        broken = [r for r in self.lint() if r["type"] in ("broken_link", "empty_page")]
        checks["pages"] = "not built" if self.pages().isEmpty() else f"{len(broken)} faults" if broken else "passed"
        turns = dialogue.turns(self.table("messages"), ["source_file"], ["line_no", "hash"])
        odd = turns.groupBy("source_file").agg(F.sum(F.when(F.col("role") == "user", 1).otherwise(-1)).alias("d")).where("d != 0").count()
        checks["pairs"] = f"{odd} unbalanced sources" if odd else "passed"
        return {"ok": set(checks.values()) == {"passed"}, "checks": checks}

    def diagnose(self) -> dict:
        """GV-11, GV-12: whether the layers agree."""
        m = self.table("messages")
        checks = governance.invariants(m.where("sender is not null and sender != ''"), self.table("profiles"), self.table("vectors").where("sender is not null"))
        rows = {r["layer"]: (r["count"], r["agrees"]) for r in checks.collect()}
        return {"status": governance.diagnosis(checks).first()["status"], "layers": rows}
