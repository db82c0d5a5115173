"""Problem 2: spellings of one person or organisation in an archive become one identity.

Method: trie join. The name words of an archive are sharded into tries, which are traversed with Levenshtein automata
to list the words within one edit (none for words under four letters, where an edit makes another name); names are then compared word by word whatever their order. What may abbreviate
what (initials, short forms of given names, titles, account names) is settled by keys, never by pairing all names of an
archive: names meet only where a key of theirs is the same, and are linked to one name of that key.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.paths import components
from strandline.llm.pii import GIVEN
from strandline.session import durable, release

_W = lambda s: frozenset(s.split())


def fold(text: str) -> str:
    """Letters without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


# Short forms of given names, by the name they stand for.
SHORT_FORMS = {
    "alejandra": "ale jandra alej sandra", "alejandro": "ale jandro alej alex", "alicia": "licha ali", "andrew": "andy drew andw", "angel": "angelito gelo", "antonio": "toni tono tonio ant antonito", "beatriz": "bea betty bety", "carla": "carlita", "charles": "charlie chas chuck",
    "concepcion": "concha conchi conchita ccion chon", "cristina": "cris tina", "daniel": "dani dan danny", "david": "dave davy", "deborah": "debbie deb debby", "diego": "dieguito", "dolores": "lola loli", "eduardo": "edu lalo eddy", "elizabeth": "liz beth betty lizzy eliza bess", "enrique": "quique kike", "fernando": "nando fer fdo",
    "francisco": "paco pancho kiko fco curro", "frederic": "fred freddy", "gabriela": "gaby gabi", "genevieve": "gigi gen", "graciela": "chela grace", "guillermo": "memo guille gmo", "hilde": "hilda hildi", "hortensia": "tencha", "ignacio": "nacho", "isabel": "isa chabela chabe", "james": "jim jimmy jamie",
    "jesus": "chucho chuy", "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe pepito", "joseph": "joe joey", "jurgen": "jogi", "katherine": "kathy kate katie kat", "lucia": "luci lucy", "luis": "lucho", "luz": "lucecita lucita", "manuel": "manolo manu ml manny", "margaret": "maggie peggy marg meg", "maria": "mari mary ma",
    "mark": "marky", "martin": "tincho marty", "matthias": "matze", "mercedes": "meche merche", "michael": "mike mick micky", "nicolas": "nico", "oscar": "oscarin", "patricia": "patty pato pati pat", "pedro": "perico", "rebecca": "becky becca", "ricardo": "richi rica", "richard": "dick rich rick richie richi", "robert": "bob rob robt bobby",
    "roberto": "beto rober rob", "rosa": "rosita", "rosario": "charo", "rose": "rosie", "santiago": "santi", "sofia": "sofi", "susan": "sue suzy susie", "teresa": "tere", "theodore": "ted teddy theo", "thomas": "tom tommy", "ursula": "ursu uschi", "valentina": "vale", "vicente": "chente", "william": "bill will wm billy",
}
_STANDS: dict[str, set[str]] = {}
for _name, _forms in SHORT_FORMS.items():
    for _form in _forms.split():
        _STANDS.setdefault(_form, set()).add(_name)
_GIVEN = frozenset(map(fold, GIVEN)) | frozenset(SHORT_FORMS)
TITLES = _W("dr dra prof profa ing lic sr sra srta mr mrs ms miss don dona herr frau mme")
SUFFIXES = _W("ltd inc llc gmbh co cia sa sl srl corp plc")
# Words between the names of a person that are none.
PARTICLES = _W("de del la las los von van der den da di do dos das du y e zu")
# Words that say what kind of organisation a name is, and words that only qualify them.
ORGANISATIONS = _W("libreria bookshop ferreteria bakery panaderia clinic clinica garage gimnasio gym academia academy cooperativa fundacion foundation inmobiliaria taller envios farmacia pharmacy hotel restaurante restaurant school escuela banco bank")
QUALIFIERS = _W("mecanico mec dental")
_SPLIT = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])")
_TOKEN = re.compile(r"[^\W\d_]+")


def near(a: str, b: str) -> bool:
    """Whether one letter changed, added, left out or swapped with its neighbour makes a of b; equal words are near."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


_BY_SIZE: dict[int, list[str]] = {}
for _x in _GIVEN | ORGANISATIONS:
    _BY_SIZE.setdefault(len(_x), []).append(_x)


def given_names(word: str, guess: bool = False) -> list[str]:
    """The given names a word may stand for: itself, those it shortens, or, as a guess, those within one edit."""
    if word in _STANDS:
        return sorted(_STANDS[word] | ({word} & (_GIVEN - _STANDS.keys())))
    if word in _GIVEN:
        return [word]
    if m := re.match(r"^(.{2,})(?:cit|it|ill)[oa]$", word):
        like = sorted(g for g in _GIVEN if g.startswith(m[1]) and len(g) <= len(m[1]) + 3)
        if like:
            return like
    if guess and len(word) >= 3:
        return sorted(g for n in (len(word) - 1, len(word), len(word) + 1) for g in _BY_SIZE.get(n, []) if g in _GIVEN and near(word, g))
    return []


def organisation(word: str, dotted: bool) -> list[str]:
    """The kinds of organisation a word may name: itself, those it abbreviates, those within one edit."""
    if word in ORGANISATIONS:
        return ["gimnasio" if word == "gym" else word]
    joined = [o for o in ORGANISATIONS for q in QUALIFIERS if word == o + q]
    if joined:
        return joined
    if 2 <= len(word) <= 6 and (dotted or not given_names(word)):

        def within(o: str) -> bool:
            at = iter(o)
            return all(c in at for c in word)

        found = sorted(o for o in ORGANISATIONS if o[0] == word[0] and len(o) > len(word) and within(o) and (dotted or len(word) >= 3))
        if found and (dotted or not any(c in "aeiou" for c in word[1:-1]) or o_prefix(word)):
            return found
    if len(word) >= 5:
        return sorted(o for o in ORGANISATIONS if near(word, o))
    return []


def o_prefix(word: str) -> bool:
    return any(o.startswith(word) for o in ORGANISATIONS)


#: Letters of a given name that a dotted short form may keep: `Xiom. Paz` as `X. Paz`.
MOST_INITIAL = 6


def parse(name: str) -> dict | None:
    """What a spelling may stand for; None where it holds no letter.

    given: the given names (or `org:` kinds) it may have; initial: the first letter or letters of one that is only an initial or cut short by a point;
    first, second: surnames (second: all after the first); first_initial, second_initial: initials in their place;
    tokens, own: all words of a person's name that holds no initial, and the one taken as the given name.
    """
    text = unicodedata.normalize("NFKC", name)
    text = re.sub(r"\b[Ss]\.?\s?(?:[Aa]|[Ll]|[Rr]\.?\s?[Ll])\.?\s*$", "", text) if re.search(r"\b[Ss]\.\s?[AaLlRr]", text) else text
    handle = "_" in text or (text.islower() and " " not in text.strip() and text.isascii())
    # Endings of firms, such as "e Hijos" or "& Sons", say nothing about which firm it is.
    text = re.sub(r"\s(?:e|y|and|und|et|&)\s(?:hijos?|hermanos|sons?|cía|cia|co|asociados|associates|söhne|fils)\b\.?\s*$", "", text, flags=re.I)
    front = ""
    if "," in text and text.count(",") == 1:
        back, front = text.split(",")
        if _TOKEN.search(front) and _TOKEN.search(back) and fold(front).strip(" .") not in SUFFIXES:
            text = f"{front} {back}"
    words = []
    for m in re.finditer(r"[^\W\d_]+\.?", _SPLIT.sub(" ", text).replace("_", " ")):
        w = fold(m.group().rstrip("."))
        w = re.sub(r"[^\w]", "", w)
        if w:
            words.append((w, m.group().endswith(".")))
    bare = [(w, d) for w, d in words if w not in TITLES and w not in SUFFIXES]
    if not bare:
        bare = words
    if not bare:
        return None
    blank = {"given": [], "initial": "", "first": "", "second": "", "first_initial": "", "second_initial": "", "tokens": [], "own": ""}
    # An organisation names its kind first, or last, in brackets or turned round.
    body = [x for x in bare if not any(near(x[0], q) for q in QUALIFIERS)]
    if len(body) >= 2:
        for k in (0, len(body) - 1):
            kinds = organisation(*body[k])
            exact = body[k][0] in ORGANISATIONS
            if kinds and (exact or not given_names(body[0][0]) and not (k == 0 and given_names(body[-1][0])) or k == 0 and body[k][1] and len(body[k][0]) >= 3):
                rest = [w for i, (w, _) in enumerate(body) if i != k]
                people = given_names(body[k][0]) if not exact else []
                return blank | {"given": [f"org:{x}" for x in kinds] + people, "first": " ".join(rest)}
    tokens = [w for i, (w, dotted) in enumerate(bare) if dotted or w not in PARTICLES or i in (0, len(bare) - 1)]
    if len(tokens) == 1:
        w = tokens[0]
        if given_names(w):
            return blank | {"given": given_names(w)}
        if len(w) == 1:
            return blank | {"initial": w}
        if handle and len(w) >= 5:
            return blank | {"initial": w[0], "first": w[1:], "given": []}
        return blank | {"given": given_names(w, True) or [w]}
    at, given = None, []
    for guess in (False, True):
        for k in (0, len(tokens) - 1):
            if len(tokens[k]) > 1 and (given := given_names(tokens[k], guess)):
                at = k
                break
        if at is not None:
            break
        if len(tokens[0]) == 1 or len(tokens[-1]) == 1 and not guess:
            # An initial stands for the given name where the other words are surnames.
            if len(tokens[0]) == 1:
                at, given = 0, []
                break
    if at is None:
        short = 2 <= len(tokens[0]) <= MOST_INITIAL and (tokens[0], True) in bare
        at, given = 0, [] if short else [tokens[0]]
    rest = [t for i, t in enumerate(tokens) if i != at]
    out = dict(blank, given=given, initial="" if given else tokens[at])
    if given and min(map(len, tokens)) > 1:
        out |= {"tokens": sorted(tokens), "own": tokens[at]}
    # No word after the second is left out. Initials among several words come last, doubled, so that two are no edit apart.
    if len(rest) > 2:
        rest = [t for t in rest if len(t) > 1] + [2 * t for t in rest if len(t) == 1]
    rest = rest[:1] + [" ".join(rest[1:])] * (len(rest) > 1)
    for slot, t in zip(("first", "second"), rest, strict=False):
        out[slot if len(t) > 1 else f"{slot}_initial"] = t
    return out


_LISTS = ("given", "tokens")
_PARSED = T.StructType([*[T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS], *[T.StructField(c, T.StringType()) for c in ("initial", "first", "second", "first_initial", "second_initial", "own")]])


@F.pandas_udf(_PARSED)
def _parse(name: pd.Series) -> pd.DataFrame:
    rows = [parse(n) or {} for n in name]
    return pd.DataFrame({f.name: [r.get(f.name, [] if f.name in _LISTS else "") for r in rows] for f in _PARSED.fields})


# -- trie join ---------------------------------------------------------------------------------------------------------


def trie(words: list[str]) -> dict:
    """Nested dicts by letter; the key '' holds the word that ends there."""
    top: dict = {}
    for w in words:
        node = top
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return top


def neighbours(top: dict, word: str) -> list[str]:
    """Words of the trie within one edit of `word`: the trie is walked with the states of its Levenshtein automaton.

    A state is the edit distance of the path to the three prefixes of `word` whose lengths are within one of its own;
    all others exceed one. A branch whose state exceeds one throughout is left, so a step costs the same for any word.
    """
    out, n, far = [], len(word), 9
    # (node, depth, last letter, distances to the prefixes of depth - 1, depth, depth + 1, and those one letter before)
    stack = [(top, 0, "", (far, 0, 1), (far, far, far))]
    while stack:
        node, d, last, row, before = stack.pop()
        for c, nxt in node.items():
            if c == "":
                if 0 <= n - d + 1 <= 2 and row[n - d + 1] <= 1:
                    out.append(nxt)
                continue
            new = [far, far, far]
            for k in range(3):
                j = d + k
                if not 0 <= j <= n:
                    continue
                cost = row[k + 1] + 1 if k < 2 else far
                if k:
                    cost = min(cost, new[k - 1] + 1)
                if j and row[k] + (word[j - 1] != c) < cost:
                    cost = row[k] + (word[j - 1] != c)
                if j > 1 and d and c == word[j - 2] and last == word[j - 1]:
                    cost = min(cost, before[k] + 1)
                new[k] = cost
            if min(new) <= 1:
                stack.append((nxt, d + 1, c, tuple(new), row))
    return out


#: Words have one edit from this many letters on, none below; rows of words that share a task.
EDIT_FROM, TASK_ROWS = 4, 20_000


def routes(word: str) -> list[str]:
    """The tries a word belongs to, and is looked up in: by its first and by its last letters.

    An edit leaves the first half or the last half of a word as it is, so two words within one edit share a route. How many
    letters a route has grows with the word, up to three; words of neighbouring lengths share a number of letters.
    """
    n = len(word)
    if n < EDIT_FROM:
        return []
    sizes = {max(1, min(3, (m - 1) // 2)) for m in (n - 1, n, n + 1)}
    return sorted({r for p in sizes for r in (f"<{word[:p]}", f">{word[-p:]}")})


def _join_tries(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for (slug, _), g in pdf.groupby(["slug", "route"], sort=False):
        words = sorted(set(g["word"]))
        top = trie(words)
        rows += [(slug, w, n) for w in words for n in neighbours(top, w) if n != w]
    return pd.DataFrame(rows, columns=["slug", "word", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(slug, word, near): for each word of an archive those within one edit, itself among them. words: slug, word.

    Each trie holds the words of an archive that share a route, and only those are looked up in it: a word has four
    routes at most, so the rows are linear in the words. Tries share tasks of about TASK_ROWS rows.
    """
    w = durable(words.distinct(), "p2-words")
    split = F.pandas_udf(lambda s: s.map(routes), T.ArrayType(T.StringType()))
    routed = durable(w.select("slug", "word", F.explode(split("word")).alias("route")), "p2-routes")
    tasks = routed.count() // TASK_ROWS + 1
    bundle = F.pmod(F.xxhash64("slug", "route"), F.lit(tasks))
    near = routed.withColumn("bundle", bundle).groupBy("bundle").applyInPandas(_join_tries, "slug string, word string, near string").distinct()
    return w.select("slug", "word", F.col("word").alias("near")).unionByName(near)


# -- identities --------------------------------------------------------------------------------------------------------


def spellings(message: DataFrame, participants: DataFrame) -> DataFrame:
    """(slug, name): the distinct strings of both columns, pre-aggregated. Null or blank names and null slugs are left out."""
    both = message.select("slug", F.col("sender").alias("name")).unionByName(participants.select("slug", "name"))
    return both.where(F.col("slug").isNotNull() & F.col("name").rlike(r"\S")).distinct()


#: Links of an archive, and of the archives that share a task, that are followed in one task.
LINKS = 200_000


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the links of whole archives: each linked name with the smallest name of its component."""
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for slug, a, b in zip(pdf["slug"], pdf["a"], pdf["b"], strict=True):
        x, y = find((slug, a)), find((slug, b))
        if x != y:
            # Spark orders strings by their UTF-8 bytes.
            low, high = (x, y) if x[1].encode() < y[1].encode() else (y, x)
            top[high] = low
    return pd.DataFrame([(k[0], k[1], find(k)[1]) for k in list(top)], columns=["slug", "name", "top"])


def linked(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(id, root) as `components` gives: links never leave an archive, so archives with up to LINKS of them are
    followed whole, several to a task by their number; larger ones by pointer jumping over all executors."""
    e = durable(edges.where("a != b").select(F.col("a.slug").alias("slug"), F.col("a.name").alias("a"), F.col("b.name").alias("b")), label)
    sizes = e.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.sum("n").alias("all"), F.max("n").alias("one")).first()
    if not most["all"]:
        return nodes.select("id", F.col("id").alias("root")).distinct()
    large = most["one"] > LINKS
    small = e.join(sizes.where(F.col("n") > LINKS), "slug", "left_anti") if large else e
    bundle = F.pmod(F.xxhash64("slug"), F.lit(most["all"] // LINKS + 1))
    found = small.withColumn("bundle", bundle).groupBy("bundle").applyInPandas(_follow, "slug string, name string, top string")
    roots = found.select(F.struct("slug", "name").alias("id"), F.struct("slug", F.col("top").alias("name")).alias("root"))
    if large:
        rest = e.join(sizes.where(F.col("n") > LINKS), "slug", "left_semi").select(F.struct("slug", F.col("a").alias("name")).alias("a"), F.struct("slug", F.col("b").alias("name")).alias("b"))
        ends = rest.select(F.col("a").alias("id")).unionByName(rest.select(F.col("b").alias("id")))
        roots = roots.unionByName(components(ends, rest, label))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _star(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) from each name of a key to the smallest one."""
    top = rows.groupBy(*keys).agg(F.min("id").alias("a"))
    return rows.join(top, keys).where("a != id").select("a", F.col("id").alias("b"))


def _bounds(rows: DataFrame, *keys) -> DataFrame:
    """The least and the greatest root of each key: equal where a single identity has it. One row a key, however many names it has."""
    return rows.groupBy(*keys).agg(F.min("root").alias("low"), F.max("root").alias("high"))


def _only(matches: DataFrame, *, best: str | None = None) -> DataFrame:
    """Edges from a short form to a name of the one identity that matches it; none where several do. matches: id, low, high."""
    if best:
        least = matches.groupBy("id").agg(F.min(best).alias("least"))
        matches = matches.join(least, "id").where(F.col(best) == F.col("least"))
    found = matches.groupBy("id").agg(F.min("low").alias("a"), F.max("high").alias("z"))
    return found.where("a = z").select("a", F.col("id").alias("b"))


def _written(*edges: DataFrame) -> DataFrame:
    """The union of edges, each table written by itself: Spark plans a job anew after each of its stages, so what one
    plan over all of them takes of the driver's memory grows as their number squared."""
    return reduce(DataFrame.unionByName, [durable(e, "p2-links") for e in edges])


#: Words of a name of which every subset is looked at; of longer names, those that leave out up to two words.
SUBSETS = 6


@F.pandas_udf(T.ArrayType(T.StringType()))
def _subsets(tokens: pd.Series, own: pd.Series) -> pd.Series:
    """For names of four words or more: what is left of them without some words, given name and another one kept."""
    out = []
    for t, g in zip(tokens, own, strict=True):
        rest = list(t)
        rest.remove(g)
        least = 1 if len(t) <= SUBSETS else len(rest) - 2
        out.append(sorted({" ".join(sorted((g, *c))) for n in range(least, len(rest)) for c in combinations(rest, n)}) if len(t) >= 4 else [])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BooleanType())
def _listed(word: pd.Series) -> pd.Series:
    return word.map(lambda w: bool(given_names(w)))


def _any_order(people: DataFrame, near: DataFrame) -> DataFrame:
    """Edges between names whose words are the same in any order but one, which is within one edit.

    Two given names of the lists are different names, however near. people: id, slug, tokens.
    """
    places = people.select("id", "slug", "tokens", F.posexplode("tokens").alias("at", "word"))
    rest = F.array_join(F.filter("tokens", lambda w, i: i != F.col("at")), " ")
    places = places.select("id", "slug", "word", rest.alias("rest"))
    anchors = places.groupBy("slug", "rest", F.col("word").alias("near")).agg(F.min("id").alias("a"))
    apart = near.where("word = near or not (word_listed and near_listed)").select("slug", "word", "near")
    return places.join(apart, ["slug", "word"]).join(anchors, ["slug", "rest", "near"]).where("a != id").select("a", F.col("id").alias("b"))


def identities(message: DataFrame, participants: DataFrame) -> DataFrame:
    """(slug, name, identity): identity is the smallest spelling of the person or organisation.

    Full names are the same identity where given name and first surname agree, in any order, one of the words within
    one edit, and second surnames agree where both have one; or where all words agree in any order, one within
    one edit. A name is one of four words or more with some left out where only one identity matches. Initials, lone given names and account names are linked
    where only one identity of the archive matches. Every string is an identity of its own otherwise.
    """
    parsed = spellings(message, participants).select("slug", "name", _parse("name").alias("p"))
    rows = durable(parsed.select(F.struct("slug", "name").alias("id"), "slug", "name", "p.*"), "p2-parsed")
    full = rows.where("first != '' and size(given) > 0").select("id", "slug", F.explode("given").alias("g"), "first", "second", "second_initial")
    words = rows.select("slug", F.col("first").alias("word")).unionByName(rows.select("slug", F.col("second").alias("word"))).unionByName(rows.select("slug", F.explode("tokens").alias("word"))).where("word != ''")
    near = durable(near_words(words).withColumns({"word_listed": _listed("word"), "near_listed": _listed("near")}), "p2-near")
    full = durable(full, "p2-full")
    by_first = full.join(near, (full["slug"] == near["slug"]) & (full["first"] == near["word"])).select("id", full["slug"], "g", F.col("near").alias("k"), (F.col("near") != F.col("first")).cast("int").alias("d"), "second", "second_initial")
    by_first = durable(by_first, "p2-by-first")
    by_second = full.where("second != ''").join(near, (full["slug"] == near["slug"]) & (full["second"] == near["word"])).select("id", full["slug"], "g", F.col("first").alias("k"), F.col("near").alias("second"))
    people = durable(rows.where("size(tokens) > 1").select("id", "slug", "tokens", "own"), "p2-people")
    edges = _star(by_first.where("second != ''"), ["slug", "g", "k", "second"]).unionByName(_star(by_second, ["slug", "g", "k", "second"])).unionByName(_any_order(people, near))
    # What several steps read is written once: plans that repeat it take the driver's memory, not only time.
    edges = durable(edges, "p2-edges")
    root = durable(linked(full.select("id"), edges, "p2-full-names"), "p2-full-roots")
    # Names without second surname join the identity of their key if there is but one.
    release(rows.sparkSession)
    keyed = by_first.join(root, "id")
    complete = keyed.where("second != '' and d = 0").groupBy("slug", "g", "k").agg(F.min("root").alias("one"), F.max("root").alias("other"))
    keyed = durable(keyed.join(complete, ["slug", "g", "k"], "left"), "p2-keyed")
    lone = keyed.where("second = '' and second_initial = ''")
    joined = lone.where("one = other").select(F.col("one").alias("a"), F.col("id").alias("b"))
    among = _star(lone.where("one is null or one != other").select("id", "slug", "g", "k"), ["slug", "g", "k"])
    seconds = _bounds(keyed.where("second != '' and d = 0"), "slug", "g", "k", F.substring("second", 1, 1).alias("second_initial"))
    marked = _only(keyed.where("second_initial != ''").select("id", "slug", "g", "k", "second_initial").join(seconds, ["slug", "g", "k", "second_initial"]))
    # One with an initial in the second place and no full counterpart goes with the shorter form.
    half = keyed.where("second = '' and d = 0").groupBy("slug", "g", "k").agg(F.min("id").alias("a"))
    bare = keyed.where("second_initial != '' and one is null").join(half, ["slug", "g", "k"]).select("a", F.col("id").alias("b"))
    typed = keyed.where("second != '' and d = 1 and (one is null or one = other)").join(half, ["slug", "g", "k"]).select("a", F.col("id").alias("b"))
    parts = people.where("size(tokens) >= 4").join(root, "id").select("slug", "root", F.explode(_subsets("tokens", "own")).alias("part"))
    fewer = _only(people.withColumn("part", F.array_join("tokens", " ")).join(_bounds(parts, "slug", "part"), ["slug", "part"]))
    more = _written(joined, fewer, among, marked, bare, typed)
    root = durable(linked(full.select("id"), edges.unionByName(more), "p2-names"), "p2-roots")
    release(rows.sparkSession)
    # Shorter forms, each linked where a single identity matches.
    known = durable(by_first.where("d = 0").select("id", "slug", "g", "k").join(root, "id"), "p2-known")
    short = rows.where("first != '' and initial != ''").select("id", "slug", "initial", "first")
    short = short.join(near, (short["slug"] == near["slug"]) & (short["first"] == near["word"])).select("id", short["slug"], "initial", F.col("near").alias("k"), (F.col("near") != F.col("first")).cast("int").alias("d"))
    cut = F.explode(F.sequence(F.lit(1), F.least(F.length("g"), F.lit(MOST_INITIAL))))
    initial = short.join(_bounds(known.where("root is not null").withColumn("n", cut), "slug", "k", F.expr("substring(g, 1, n)").alias("initial")), ["slug", "k", "initial"])
    given = rows.where("first = '' and size(given) > 0").select("id", "slug", F.explode("given").alias("g"), "first_initial")
    lettered = given.where("first_initial != ''").join(_bounds(known, "slug", "g", F.substring("k", 1, 1).alias("first_initial")), ["slug", "g", "first_initial"])
    alone = given.where("first_initial = ''").join(_bounds(known, "slug", "g"), ["slug", "g"])
    last = _written(_only(initial, best="d"), _only(lettered), _only(alone))
    # Lone forms of one given name, or of one initial and surname, are the same where no full name tells them apart.
    same = _star(given.where("first_initial = ''").select("id", "slug", "g"), ["slug", "g"]).unionByName(_star(given.where("first_initial != ''").select("id", "slug", "g", "first_initial"), ["slug", "g", "first_initial"]))
    same = same.unionByName(_star(short.where("d = 0").select("id", "slug", "initial", "k"), ["slug", "initial", "k"]))
    ends = root.where("id != root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    final = linked(rows.select("id"), ends.unionByName(last).unionByName(same), "p2-identities")
    return final.select("id.slug", "id.name", F.col("root.name").alias("identity"))


def found(message: DataFrame, participants: DataFrame) -> DataFrame:
    """(slug, name_a, name_b): the distinct strings of an archive that name the same entity, name_a < name_b by code point.

    The pairs of one identity are few: as many as it has spellings, not rows.
    """
    i = durable(identities(message, participants), "p2-names-of")
    release(message.sparkSession)
    a, b = i.select("slug", "identity", F.col("name").alias("name_a")), i.select("slug", "identity", F.col("name").alias("name_b"))
    return a.join(b, ["slug", "identity"]).where("name_a < name_b").select("slug", "name_a", "name_b")
