"""Problem 7: personal data in free text is found and replaced by typed placeholders.

Method: candidate gradient boosting. High-recall generators propose overlapping spans per kind; boosted trees judge
each by its form and its context; thresholds calibrated on held-out rows select the spans to redact.

The trees are fitted on SAMPLE texts made here from the seeded patterns below (the one bounded labelled sample);
everything else covers all rows.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.boosting import Boosted
from strandline.llm.language import SETS

KINDS = ("email", "phone", "id_number", "address", "name")
#: Labelled texts the trees are fitted and calibrated on, two thirds and one third.
SAMPLE = 16_000

_W = lambda s: frozenset(s.split())
# Common given names of the four languages, and short forms.
GIVEN = _W(
    "alejandra alejandro alicia ana andrea andrew angela antonio beatriz carla carlos carmen catalina charles christopher clara claudia concepción cristina daniel david deborah diana diego dolores eduardo elena elizabeth emily emma enrique ernesto eva felipe fernando francisca francisco françois frédéric gabriel gabriela geneviève george gloria graciela guillermo gustavo "
    "hans helen hilde hortensia hugo ignacio inés isabel jacques james jane javier jean jennifer jesús joaquín john jonathan jorge joseph josé juan julia julio jürgen karen katherine klaus laura linda lisa lorenzo lucía luis luisa luz manuel marcos margaret margarita maría mariana mario mark marta martín mary matthias mercedes michael miguel mónica "
    "nancy natalia nicolás óscar pablo patricia paul pedro peter pierre pilar rafael ramón raquel raúl rebecca ricardo richard robert roberto rosa rosario rose sandra santiago sara sarah sergio silvia sofía susan teresa theodore thomas úrsula ursula valentina vicente victoria víctor william wolfgang yolanda ángel ángela álvaro "
    "pepe paco lola nacho quique beto lupe chelo bob bill mike kate liz tom jim joe sue"
)
# Given names that are also common words.
AMBIGUOUS = _W("rosa rose luz mark ángel dolores mercedes concepción victoria pilar gloria carmen clara eva sue bob bill grace hope will grant april may june jack rosario")
GIVEN_LIKE = GIVEN | AMBIGUOUS
TITLES = _W("dr dra sr sra srta mr mrs ms miss don doña prof profa ing lic herr frau mme")
NAME_LEFT = _W(
    "hola hi hello hey dear querido querida estimado estimada hallo bonjour cher chère signed firmado firma hugs abrazo besos saludos regards dile diles tell told ask asked call llama llamó para for con with to a preguntó pregunta dice dijo says said cumple birthday de of did contó saw vi visto met gracias thanks thank es soy sincerely atentamente love hablé talked spoke von mit für par avec pour viene vino llega llegó ask lunch invite"
)
NAME_RIGHT = _W("says said dice dijo que tell told came vino llamó called llegamos is está y and at en por lo to we no will how cómo me te wrote writes escribió asked preguntó sagt works lives will estuvo se came comes was were yo i has had wants quiere llegó might por")
# Words with which one addresses somebody, or signs; and those that then stand for no name.
GREET = _W("hola hi hello hey dear querido querida estimado estimada hallo bonjour liebe lieber cher chère salut oye buenas saludos regards hugs")
VOCATIVES = _W(
    "there all everyone everybody team folks guys friend friends sir madam mom mum mommy dad daddy love honey dear darling buddy mate kids neighbour neighbor world again you yall ladies gentlemen amigo amiga amigos amigas todos todas mundo vecino vecina vecinos mamá papá mami papi cariño amor equipo chicos chicas familia señor señora buenas otra nuevamente querido querida guapo guapa tío tía hermano hermana gente colega jefe jefa doctor doctora alle zusammen freunde leute schatz mama papa tous toutes monde ami amie mes madame monsieur chéri chérie encore from and to for a the"
)
# Subjects that stand without an article and are no names.
SUBJECTS = _W(
    "nobody somebody someone anybody anyone everyone everybody everything something nothing anything people mom mum dad mommy daddy grandma grandpa granny dinner lunch breakfast work school life time money water rain snow traffic news customers neighbours neighbors friends kids children others both many few most one two three another each either neither today tomorrow yesterday tonight monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december god christmas easter thanks mondays tuesdays wednesdays thursdays fridays saturdays sundays weekend weekends"
    " alguien nadie todos todas todo nada algo cada uno una otro otra otros muchos pocos ambos mamá papá abuela abuelo mami papi gente trabajo tiempo dinero agua lluvia hoy ayer mañana anoche lunes martes miércoles jueves viernes sábado domingo lunes sábados domingos enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre dios navidad jamás siempre nunca quien quién cuando"
    " jemand niemand alle jeder jede mama oma opa heute gestern morgen leute kinder arbeit zeit geld montag dienstag mittwoch donnerstag freitag samstag sonntag maman papa mamie papi personne quelqu chacun chacune tous toutes aujourd hier demain lundi mardi mercredi jeudi vendredi samedi dimanche noël"
)
# Verbs whose subject, where it has no article, is a person.
PERSON_VERBS = _W(
    "says said called calls told tells asked asks wrote writes texted replied answered thinks thought knows knew wants wanted loves loved laughed smiled agreed promised forgot invited visited phoned emailed met married bought brought llamó llama dice dijo preguntó pregunta escribió escribe contó cuenta quiere quería sabe cree piensa respondió contestó vino llegó trajo compró prometió olvidó invitó visitó rio sonrió opina sagte sagt rief ruft schrieb schreibt fragte fragt erzählte meint dit demande demanda appela appelle écrit pense veut raconta répondit"
)
FUNCTION = frozenset().union(*SETS.values())
# Words after which an address stands, whatever its street is called; and what shows that a number counts something.
LIVES = r"(?:vivo|vive|viven|vivimos|viv[ií]a|mudamos|mud[oó]|estamos|estoy|quedamos|live|lives|lived|living|moved|staying|stay|wohne|wohnt|wohnen|habite|habitons|direcci[oó]n|address|adresse|anschrift)"
COUNTED = _W("years year months month weeks week days day hours hour minutes minute km kilometres miles metres meters people times euros dollars años año meses mes semanas semana días día horas hora minutos minuto kilómetros metros personas veces jahre jahren monate wochen tage stunden minuten ans mois semaines jours heures ago")
ARTICLES = _W("el la los las un una unos unas the a an this that my mi tu su your our der die das le les l del al")
FIRM = _W("ferretería librería bakery bookshop clinic clínica garage gimnasio gym academia cooperativa fundación inmobiliaria panadería taller farmacia hotel restaurante envíos ltd inc sl sa gmbh company compañía banco bank escuela school museo museum")
PLACE = _W("puerto san santa santo puente villa monte río lago lake mount port plaza parque park barrio calle avenida pasaje rue street road")
PHONE_LEFT = _W("call llámame llama teléfono telefono phone tel cel celular móvil mobile ph text whatsapp número number marca try dial apunta fono handy fax at on up contact contacto telefon nummer appelle")
ID_LEFT = _W("dni ssn social seguro pasaporte passport documento document identificación identification id identity cédula card titular holder nie nif curp rut identidad ausweis insurance national")
DECOY_LEFT = _W("ticket order pedido isbn lote batch código code guía tracking vuelo flight versión version release router capítulo chapter página page mesa table salón room monto amount total factura invoice score marcador ref reference serial serie envío parcel paquete euros dollars step steps counter contador podómetro leí lavadora machine fecha date son that trx modelo model")
DECOY_RIGHT = _W("pasos steps euros dollars dólares usd eur kg km minutos minutes días days puntos points páginas pages unidades units vence expires")
STREET_LEFT = _W("vivo live lives vive mudamos moved en at calle dirección address fiesta party deja leave paquete parcel por to comes pasa estamos are is casa home wohne habite")

_SP = r"[\s\u200b]"
# Blanks inside an address: it does not go on in the next line.
_LSP = r"[^\S\n\r\u2028\u0085]"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NUMBER = re.compile(rf"(?<![\w@.])(?:[A-Za-z]{{1,4}}-?)?[+(]{{0,2}}\d(?:(?:{_SP}{{1,3}}|{_SP}{{0,2}}[-./()–]{{1,3}}{_SP}{{0,2}})?\d){{5,18}}(?:{_SP}?-?[A-Za-z])?(?![\w@])")
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|punto|punkt|point)\s*[\])}]\s*|\s(?:dot|punto|punkt|point)\s)"
_EMAILS = [
    re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*", re.I),
    re.compile(rf"[\w.+-]+\s*[\[({{]\s*(?:at|arroba)\s*[\])}}]\s*[\w-]+(?:{_DOT}[\w-]+)*", re.I),
    re.compile(rf"[\w.+-]+\s+arroba\s+[\w-]+(?:{_DOT}[\w-]+)+", re.I),
    re.compile(r"[\w.+-]+\s+at\s+[\w-]+(?:\s(?:dot|punto)\s[\w-]+|\.[\w-]+(?=\s(?:dot|punto)\s))+", re.I),
    re.compile(r"(?<=\s)@\s?\w+"),
]
_TYPE_BEFORE = r"(?:calle|c/|av(?:da|enida)?\.?|avenue|jr\.?|jirón|pasaje|psje\.?|paseo|camino|carrera|cra\.?|plaza|ronda|rue|boulevard|bd\.?|chemin|impasse|via|travesía)"
_TYPE_AFTER = r"(?:st(?:reet)?\.?|r(?:oa)?d\.?|lane|ln\.?|ave(?:nue)?\.?|drive|dr\.?|blvd\.?|way|court|ct\.?|terrace|close|square|crescent)"
_UNIT = rf"(?:,?{_LSP}*(?:dpto\.?|piso|apt\.?|apartment|flat|unit|suite|puerta|int\.?|of\.?|\d{{1,2}}º){_LSP}*\w{{0,4}}(?:{_LSP}[A-Z]\b)?)?"
_ADDRESS = re.compile(
    rf"(?<!\w)(?:"
    rf"(?:{_TYPE_BEFORE}){_LSP}*(?:[\w'’.-]+{_LSP}+){{0,4}}?[\w'’.-]+,?{_LSP}*(?:(?:nº|n°|no\.|num\.?|número|#|nr\.){_LSP}*)?\d{{1,5}}\b{_UNIT}"
    rf"|\d{{1,5}}(?:bis|ter)?,?{_LSP}+(?:{_TYPE_BEFORE}){_LSP}+(?:[\w'’-]+{_LSP}+){{0,3}}[\w'’-]+"
    rf"|\d{{1,5}}{_LSP}+(?:[\w'’-]+{_LSP}+){{1,3}}?{_TYPE_AFTER}(?!\w){_UNIT}"
    rf"|(?:(?-i:[A-ZÀ-Þ])[\w'’-]*{_LSP}+){{0,2}}[\w'’-]*(?:weg|straße|strasse|str\.|gasse|allee|platz){_LSP}+\d{{1,5}}[a-z]?\b"
    rf"|(?:{_TYPE_AFTER}){_LSP}+\d{{1,5}}\b"
    rf")",
    re.I,
)


MONTHS_LIKE = _W("january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre row gate room table seat fila puerta sala mesa vuelo route ruta line línea bus platform andén level nivel page página")
_PLAIN_ADDRESS = re.compile(rf"(?<!\w)(?i:{LIVES}){_LSP}*:?{_LSP}+(?:(?i:en|a|at|to|in|au|à|im|am|the|la|el){_LSP}+)?(?P<street>[A-ZÀ-Þ][\w'’.-]*(?:{_LSP}+(?:de|del|la|las|los|el|der|den|des|du|[A-ZÀ-Þ][\w'’.-]*)){{0,4}},?{_LSP}+(?:(?:nº|n°|no\.|num\.?|número|#|nr\.){_LSP}*)?\d{{1,4}}\b)(?![.:/-]?\d)")


def _case(text: str, words: list[str]) -> int:
    """0 mixed, 1 all lower, 2 all upper, 3 every word capitalised."""
    if text.islower() or not words and not any(c.isalpha() for c in text):
        return 1
    if text.isupper():
        return 2
    # Of few words, a capitalised function word tells that the whole is set so.
    titled = all(w[0].isupper() for w in words) and (len(words) >= 4 or len(words) > 1 and any(w.lower() in FUNCTION for w in words))
    return 3 if titled else 0


class Text:
    """A text with its words in place."""

    def __init__(self, text: str):
        self.text = text
        self.words = [(*m.span(), w := m[0], w.lower()) for m in _WORD.finditer(text)]
        self.case = _case(text, [x[2] for x in self.words])

    def around(self, start: int, end: int, reach: int = 4) -> tuple[list[str], list[str]]:
        """Up to four lower-case words before, nearest first, and after, within the clause or line as far as it goes."""
        left = [w for s, e, _, w in self.words if e <= start][-reach:][::-1]
        right = [w for s, e, _, w in self.words if s >= end][:reach]
        return left, right


# -- candidates: (start, end, features) per kind -----------------------------------------------------------------------


def email_candidates(t: Text) -> Iterator[tuple[int, int, list[float]]]:
    low = t.text.lower()
    if "@" not in low and "arroba" not in low and not re.search(r"\bat\b", low):
        return
    for which, pattern in enumerate(_EMAILS):
        for m in pattern.finditer(t.text):
            s = m.group()
            local, _, domain = re.sub(r"\s*[\[({]?\s*\b(?:at|arroba)\b\s*[\])}]?\s*", "@", s, flags=re.I).partition("@") if which else s.partition("@")
            dots = len(re.findall(r"\.|\bdot\b|\bpunto\b", domain, re.I))
            tld = re.split(r"\W|\bdot\b|\bpunto\b", domain, flags=re.I)[-1]
            yield m.start(), m.end(), [which, bool(local.strip()), dots, len(tld), tld.isalpha(), bool(re.search(r"arroba", s, re.I)), len(local) >= 3, bool(re.search(r"\b(?:dot|punto)\b", s, re.I))]


def number_candidates(t: Text) -> Iterator[tuple[int, int, list[float]]]:
    for m in _NUMBER.finditer(t.text):
        s = m.group()
        digits = re.sub(r"\D", "", s)
        if not 7 <= len(digits) <= 16:
            continue
        groups = [len(g) for g in re.findall(r"\d+", s)]
        head = re.match(r"[A-Za-z]*", s)[0]
        tail = s[-1].isalpha()
        left, right = t.around(m.start(), m.end())
        bare = digits[2:] if digits.startswith("00") and len(digits) > 11 else digits
        bare = bare[1:] if len(bare) == 11 and bare[0] == "1" else bare
        near = t.text[max(0, m.start() - 2) : m.start()]
        after = t.text[m.end() : m.end() + 2]
        yield m.start(), m.end(), [
            len(digits), len(groups), groups[0], groups[1] if len(groups) > 1 else 0, groups[2] if len(groups) > 2 else 0, groups[-1],
            "+" in s, "(" in s, "-" in s, "." in s, "/" in s, bool(re.search(r"\d\s+\d", s)),
            len(head), head.isupper() and bool(head), tail, digits.startswith("00"), digits.startswith("000"), digits.startswith("666") or digits.startswith("9"), digits.startswith("0"),
            bare[3:6] == "555", len(bare) == 10 and bare[0] in "23456789" and bare[3] in "23456789", digits.startswith(("07", "447", "4407", "020", "00447", "4420")),
            bool(PHONE_LEFT & set(left[:2])), bool(PHONE_LEFT & set(left)), bool(ID_LEFT & set(left[:3])), bool(DECOY_LEFT & set(left[:2])), bool(DECOY_LEFT & set(left)), bool(DECOY_RIGHT & set(right[:2])),
            not left, bool(re.search(r"[$€£#]", near)), ":" in near, bool(re.search(r"[%€$]", after)), digits.startswith(("978", "979")), len(set(digits)) <= 3,
            bool(re.match(r"(?:19|20)\d\d[-/.]\d", s)), bool(re.fullmatch(r"\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d", s)),
        ]


def address_candidates(t: Text) -> Iterator[tuple[int, int, list[float]]]:
    if not re.search(r"\d", t.text):
        return
    found = [(m.start(), m.end(), False) for m in _ADDRESS.finditer(t.text)]
    found += [(*m.span("street"), True) for m in _PLAIN_ADDRESS.finditer(t.text) if not any(a < m.end() and b > m.start("street") for a, b, _ in found)]
    for begin, end, untyped in found:
        s = t.text[begin:end]
        low = s.lower()
        left, right = t.around(begin, end)
        words = _WORD.findall(s)
        caps = sum(w[0].isupper() for w in words)
        before = bool(re.match(rf"(?:\d{{1,5}}\S*\s+)?{_TYPE_BEFORE}", low))
        yield begin, end, [
            len(words), caps / max(1, len(words)), before, s[0].isdigit(), bool(re.search(r"\d\s*$", s)), bool(re.search(r"(?:weg|stra(?:ß|ss)e|str\.|gasse|allee|platz)\s+\d", low)), bool(re.search(r"nº|#|n°|nr\.", low)),
            bool(re.search(r"dpto|piso|apt|flat|º", low)), bool(STREET_LEFT & set(left[:2])), t.case, bool(re.match(rf"{_TYPE_AFTER}\s+\d", low)), len(re.findall(r"\d+", s)[0]), bool(set(w.lower() for w in words) & (ARTICLES - {"del", "la", "los", "las", "el", "le", "les", "l"})),
            bool(re.match(r"calle|c/|av|jr|pasaje|rue", low)), not left, bool(DECOY_LEFT & set(left[:1])), len(right), untyped, bool(re.match(r"\d{1,5}\S*\s+(?:rue|boulevard|bd|chemin|impasse|avenue)\b", low)), "camino" in low, bool(re.search(r"\w{3,}\.\s", s)), bool(right) and right[0] in COUNTED, bool(words) and words[-1].lower() in MONTHS_LIKE,
        ]


_STOPS, _OPENS, _BLANKS = re.compile(r"[.!?¿¡\n]\W*\Z"), re.compile(r"[.!?¿¡\n;:]\W*\Z"), re.compile(rf"{_SP}{{1,3}}")


def name_candidates(t: Text) -> Iterator[tuple[int, int, list[float]]]:
    ws = t.words
    # A name inside an e-mail address is none.
    mails = [m.span() for p in _EMAILS[:4] for m in p.finditer(t.text)] if re.search(r"@|arroba|\bat\b", t.text, re.I) else []
    i = 0
    while i < len(ws):
        start, end, w, low = ws[i]
        cap = w[0].isupper()
        # Whatever is proposed is capitalised, on a list, or addressed.
        if not (cap or low in GIVEN_LIKE or low in TITLES or i and ws[i - 1][3] in GREET) or mails and any(a <= start < b for a, b in mails):
            i += 1
            continue
        title = low in TITLES and i + 1 < len(ws) and ws[i + 1][0] - end <= 2 and ws[i + 1][2] != "" and len(ws[i + 1][2]) > 2
        given = low in GIVEN_LIKE
        small = cap and t.case == 0 and w[1:].islower()
        inner = small and i > 0 and not _STOPS.search(t.text, ws[i - 1][1], start)
        shaped = small and len(w) >= 3
        opens = shaped and (i == 0 or _OPENS.search(t.text, ws[i - 1][1], start) is not None)
        plain = low in FUNCTION or low in SUBJECTS or low in FIRM
        after_ = ws[i + 1] if opens and i + 1 < len(ws) and _BLANKS.fullmatch(t.text, end, ws[i + 1][0]) else None
        acts = shaped and opens and not plain and after_ is not None and after_[3] in PERSON_VERBS
        twin = shaped and opens and not plain and low not in GREET and low not in NAME_LEFT and after_ is not None and after_[2][0].isupper() and after_[2][1:].islower() and len(after_[2]) >= 3 and after_[3] not in FUNCTION and after_[3] not in SUBJECTS
        greeted = i > 0 and len(low) >= 3 and ws[i - 1][3] in GREET and low not in FUNCTION and low not in VOCATIVES and low not in SUBJECTS and re.fullmatch(rf",?{_SP}{{1,3}}", t.text[ws[i - 1][1] : start]) is not None
        # Addressed in a text of one case, a name ends its clause.
        greeted = greeted and (w[0].isupper() and t.case == 0 or bool(re.match(r"\s*(?:[,.!?¡¿:;)\n]|$)", t.text[end : end + 3])))
        if not (title or given or inner or acts or twin or greeted):
            i += 1
            continue
        # The name runs on over capitalised words, or, where case tells nothing, over rare-looking ones.
        j = i + 1
        limit = 4 if title else 3
        while j < len(ws) and j - i < limit:
            gap = t.text[ws[j - 1][1] : ws[j][0]]
            if not re.fullmatch(rf"{_SP}{{1,3}}" if not (title and j == i + 1) else rf"\.?{_SP}{{0,3}}", gap):
                break
            nxt = ws[j][2]
            if title and j == i + 1 or ws[j][3] in GIVEN_LIKE - AMBIGUOUS:
                j += 1
            elif t.case == 0 and nxt[0].isupper() and ws[j][3] not in NAME_RIGHT or (title or given) and (t.case != 0 or w.islower()) and len(nxt) >= 6 and ws[j][3] not in NAME_RIGHT and ws[j][3] not in _COMMON_NEXT:
                j += 1
            else:
                break
        left, right = t.around(start, ws[j - 1][1], 3)
        before = t.text[ws[i - 1][1] if i else 0 : start]
        after = t.text[ws[j - 1][1] : ws[j - 1][1] + 2]
        l1, r1 = (left[0] if left else ""), (right[0] if right else "")
        l1 = "" if re.search(r"[.!?\n;]", before) else l1
        yield start, ws[j - 1][1], [
            title, given, low in AMBIGUOUS, w[0].isupper(), w.isupper() and len(w) > 1, t.case, j - i, l1 in ARTICLES, l1 in NAME_LEFT, l1 == "", r1 in NAME_RIGHT, r1 in ARTICLES,
            bool(re.search(r"[:,]\s*$", before)), bool(after[:1] in ",.;!?:" and after), after == "", l1 in FIRM or low in FIRM, bool({x[3] for x in ws[i:j]} & FIRM) or r1 in FIRM, l1 in PLACE or low in PLACE,
            bool(before.strip()) and before.strip()[-1] in ":", "@" in t.text[max(0, start - 1) : ws[j - 1][1] + 1], bool(re.search(r"\d", t.text[max(0, start - 6) : start] + t.text[ws[j - 1][1] : ws[j - 1][1] + 6])),
            len(left) > 1 and left[1] in NAME_LEFT, l1 in ("un", "una", "the", "la", "el", "a", "an"), r1 in ("the", "del", "by", "de", "se", "you", "it", "him", "form", "for", "and"), l1 in ("a", "to", "con", "with", "para", "for", "de", "of"),
            len(ws) == j - i, r1 in ("y", "and") and len(right) > 1 and right[1] in ("yo", "i"), l1 == "" and r1 in NAME_RIGHT and r1 not in COMMON_RIGHT,
            acts, twin, greeted, inner, plain, r1 in PERSON_VERBS, bool({x[3] for x in ws[i:j]} & PLACE), len(w),
        ]
        i = j if (title or given) else i + 1


COMMON_RIGHT = _W("y and en por lo to at no is se que we i will how")
# Words that follow a name in the patterns of talk, and are no part of it.
_COMMON_NEXT = _W("llegamos preguntó birthday traiga viene agreed cinema acuerdo contó before after tomorrow mañana anoche cuando porque aunque because although yesterday siempre always nothing everything puedo could would should gracias thanks please favor")

GENERATORS = {"email": email_candidates, "phone": number_candidates, "id_number": number_candidates, "address": address_candidates, "name": name_candidates}

# -- labelled sample ---------------------------------------------------------------------------------------------------

_CONTEXT = {
    "phone": ["call me on {}", "llámame al {} después de las 6", "my number is {}", "mi número es {}", "text {} and ask for the manager", "cel {}", "ph {}", "{}", "{}.", "whatsapp nuevo {}", "if I am out try {} and leave a message", "si no estoy, marca {} y deja mensaje", "apunta: {}, pregunta por la encargada", "el teléfono del taller: {}", "the workshop picks up at {}", "tel. {}", "mobile: {}", "you can reach the office at {}"],
    "id_number": ["my ID number is {}", "mi documento es {}", "pon en el formulario el DNI {}", "put SSN {} on the form", "passport {} expires in May", "el pasaporte {} vence en mayo", "me piden el número de seguro: {}", "they want the social: {}", "identificación {}, firma pendiente", "identity card {}, signature pending", "the file is under holder {}", "el trámite quedó a nombre del titular {}", "{}", "DNI: {}", "national insurance {}"],
    "address": ["we moved to {}", "nos mudamos a {}", "vivo en {}, toca el timbre dos veces", "I live at {}, ring twice", "la fiesta es en {} a las 9", "party is at {} from 9", "deja el paquete en {}", "leave the parcel at {}", "the technician comes to {} tomorrow", "el técnico pasa mañana por {}", "ahora estamos en {}, frente a la plaza", "we are at {} now, facing the square", "{}", "{}.", "my address: {}"],
    "email": ["write to me at {} when you can", "Escríbeme a {} cuando puedas", "mi correo nuevo es {}, el otro ya no", "mail: {}", "Contacto: {}", "{}", "{}.", "copied {} and got nothing back", "le puse copia a {} y no contestó", "send the invoice to {} please", "the form bounced for {}, can you check?", "el formulario rebotó con {}, ¿lo revisas?", "my new address for mail is {}, drop the other", "add {} to the list as well"],
    "name": ["hola {}, ¿cómo va todo?", "hi {}, how is it going?", "signed: {}", "firmado: {}", "hugs, {}", "un abrazo, {}", "dile a {} que traiga pan", "tell {} to bring bread", "the present is for {}", "el regalo es para {}", "es el cumple de {}", "it is the birthday of {}", "did {} tell you about the trip?", "¿te contó {} lo del viaje?", "preguntó {} por ti", "anoche vi a {} en el cine", "saw {} at the cinema last night", "gracias a {} llegamos a tiempo", "thanks to {} we made it on time", "hablé con {} y está de acuerdo", "talked to {} and it is all agreed", "dice {} que no viene", "{} says that is not happening", "{} asked about you", "{} llamó ayer", "{}", "mañana viene {}", "{} was asking for you", "{} and I were late", "{} y yo llegamos tarde", "{} came by", "{} wants to know", "{} no vino", "{} se fue temprano", "{} has a new bike", "{} works here now", "{} estuvo en casa", "{} is late", "{} will be there", "{} might come", "I had lunch with {} yesterday", "ask {} about it"],
}
_DECOYS = [
    "order {3}-{4}-{2} is on its way", "pedido {3}-{4}-{2} en camino", "tracking TRX-{8}-{4} held at customs", "guía TRX-{8}-{4} retenida en aduana", "ISBN 978-0-{8}-{1}, hardback", "isbn 978-0-{8}-{1} tapa dura", "batch {4}-{2}-{4} expires in May", "lote {4}-{2}-{4} vence en mayo", "the step counter says {10}, no way", "leí {10} pasos en el podómetro",
    "the washing machine code is {8}", "el código de la lavadora es {8}", "that is {3}.{2} dollars, ticket {8}", "son {3}.{2} euros, ticket {8}", "router is on 10.0.{1}.{2}", "flight QV{4} leaves on {1}/1{1}/2023", "la versión 2.{2}.{1} ya corrige el fallo", "Your parcel TV{7} is out for delivery, slot 9 to 13", "Envío TV{7} entregado en portería, gracias por confiar en nosotros", "chapter {2}, page {3}, do not miss it", "capítulo {2}, página {3}, no te lo pierdas",
    "table {2}, row {1}, gate {1}", "mesa {2}, fila {1}, puerta {1}", "room {3}, floor {1}, bring a notebook", "salón {3}, piso {1}, traer cuaderno", "meet @ the corner, road {1} is closed", "escríbeme @ la noche y te cuento", "follow me @kitchen_{4}, I post photos there", "sígueme en @cocina_{4}, subo fotos", "see you at {1}:{2}, the rose by the gate is out", "quedamos a las {1}:{2}, la rosa del jardín ya abrió", "la luz se fue {2} minutos y volvió en paz",
    "mark the date and bring a grant form", "will you hope for the best in April?", "vi un ángel de barro en Puerto Sereno", "score was {1} to {1}, what a game", "marcador {1} a {1}, qué partido", "monto: {4}", "amount: {4}", "fecha: 2019-02-0{1}", '{"date": "2021-0{1}-12", "amount": "{4}"}', "What matters to me is slow Sundays", "I met the baker in May on Sunday afternoon", "El martes pasado fue un día raro", "the street was closed for {2} days", "la calle estuvo cerrada {2} días",
    "a rose is a rose", "Rose petals fell", "Will it rain today?", "Grant forms are due", "Hope is all we need", "Rosa del jardín", "Luz y gas suben", "Mark all the boxes", "Dolores de cabeza todo el día", "Ángel de barro roto", "will you hope for the best in April?", "Will you hope for the best in April?", "The rose by the gate", "La luz se fue", "It expires in May", "En abril y mayo llueve", "she has no mercy and much grace", "the bill is {3} dollars", "mark my words", "la luz de la cocina", "los dolores de espalda siguen", "su mejor victoria", "the old bank on the corner", "I bought bread at Rosa Bakery", "la Librería Ángel abre a las 9", "Ferretería Mercedes cierra hoy", "the package from San Martín arrived", "Calle Rosario is noisy", "we walked along Santiago Street", "invoice {6}", "ref {9}", "serial {10}", "leí {0} pasos en el podómetro", "the step counter says {0}, no way", "{0} steps today", "the serial of the printer is {0}", "status: 20{2}-0{1}-1{1}; place: at home", "origen: 20{2}-1{1}-0{1}; estado: lento", "fecha: 201{1}-0{1}-2{1} | monto: {4}", "the doctor says that slow Sundays helped", "la doctora dice que el orden ayudó", "The doctor and I met in the yard", "una doctora midió el paraguas", "The aunt of the baker", "mi tía dice que sí", "total {7}", "El Taller Ricardo cierra tarde", "Clínica Rosario opens at {1}", "I think Monday is fine", "see you in Puerto Hondo", "road {1} is closed", "at the market dot com", "look at me", "meet at noon",
]
# Contexts that point to a name whether or not it is on a list, and what stands in them without being one.
_STRONG = ["{} called me yesterday", "yesterday {} called me", "hi {}, how is it going?", "hola {}, ¿cómo estás?", "{} says hello", "{} told me about the trip", "{} dijo que sí", "{} me escribió ayer", "hablé con {} anoche", "I met {} at the market", "dear {}, thanks for the bread", "hello {}!", "{} will come", "{} asked for you", "ayer {} llamó tarde", "dile a {} que venga", "I wrote to {} last week", "querida {}, te escribo pronto", "{} wants to see the house", "es el cumple de {}", "last night {} told us a story", "a letter from {} came", "we stayed with {} for a week", "hoy {} trajo flores", "fuimos con {} al lago", "invité a {} a comer", "buenas {}, paso luego", "the other day {} phoned", "I asked for {} at the desk", "le presté el libro a {} ayer", "we looked for {} everywhere"]
_STRONG_DECOYS = ["Dinner is ready", "Patience is all we need", "Nobody called me", "Somebody told us", "Mom said no", "Mamá llamó ayer", "Everyone says hello", "hi there, how is it going?", "hola vecina, ¿cómo estás?", "hello everyone!", "dear friend, thanks for the bread", "La vecina llamó tarde", "Puerto Hondo is far away", "Villa Serena queda lejos", "Buenos días a todos", "Good Morning to all", "Happy Birthday to you", "Feliz Cumpleaños", "I met the neighbours at the market", "we wrote to Customer Service", "the train to Puerto Claro is late", "Librería {0} cierra hoy", "Ferretería {0} abre", "talked to the Bakery", "Calle {0} is noisy", "vi Monte {0} desde lejos", "Santa {0} is a village", "on Monday we call", "el Lunes llamo", "Taller {0} says closed", "Clinic {0} called", "Academia {0} abre a las 9", "Inmobiliaria {0} llamó", "in {0} it rains", "we went to {0} in summer", "en {0} llueve", "viajamos a {0} en verano", "the town of {0} is small", "Puente {0} is closed"]
_STREETS = ["Gran Vía {1}", "Los Olivos {1}", "Paseo Alto {1}", "Kings Cross {1}", "Broadway {1}", "Hauptmarkt {1}", "Alameda Vieja {1}", "La Rambla {1}", "Altamira {1}", "Cuatro Caminos, {1}"]
_LIVE = ["vivo en {}", "vive en {} con su tía", "I live at {}", "we moved to {}", "dirección: {}", "address: {}", "estamos en {}, ven", "ich wohne am {}", "nos mudamos a {} ayer"]
_LIVE_DECOYS = ["we moved to Puerto Hondo {1} years ago", "vivo en Madrid {1} meses al año", "estamos en Mayo 20{2}", "we live in Denver {1} days a week", "estamos en Fila {1}", "we moved to Room {1}", "vivimos en Puerto Claro {1} años", "card {4} {4} {4} {4}", "tarjeta {4} {4} {4} {4}", "{4} {4} {4} {4}", "visa {4}-{4}-{4}-{4}"]
_OPENERS = ["Creo que va a llover", "Espera un momento", "Leer un rato me calma", "Escríbeme pronto", "Trae pan y leche", "Pienso volver en otoño", "Mira esto", "Tengo sueño", "Dejé las llaves en la mesa", "Salimos tarde del cine", "Remember the keys", "Bring some bread", "Look at this", "Let me know", "Thinking about it again", "Reading a while calms me", "Left the keys on the table", "Sounds good to me", "Took the bus home", "Of Course", "Call You Later", "See You Soon", "Good Night", "Talk Soon", "Well Done", "Muchas Gracias", "Buenas Noches", "Hasta Luego", "Qué Bueno", "Por Supuesto", "lazy Sundays are best", "los Domingos descanso", "el perro va camino al río", "lo dejé camino al trabajo", "esperé en el camino un rato", "the keys are on the way home", "Una tarde larga y tranquila", "Casi todo salió bien", "Estuvo lloviendo sin parar", "Siempre llega tarde el tren", "Last Friday we stayed in", "Next Monday we start", "Mi prima cose y mi tío pinta", "Detrás de la casa hay un huerto", "Cerca del mercado venden flores", "Antes de cenar salimos a caminar"]
_FILLER = ["Te cuento que mi hermana arregló el paraguas, porque nadie más quería hacerlo", "What matters to me is patience, and then we laughed for a while", "My aunt says that silence changed my life in the kitchen", "Creo que la lluvia fina es algo tranquilo, pero al final salió bien", "Just so you know, the baker lost the blue notebook", "no puedo ir el sábado", "Me gusta el pan del mercado", "we stayed at home and read"]
_SYLLABLES = "be co da el fa ga hu la le li ma mi mo na ni ra re ri ro sa so ta te to ur va vi za".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _surname(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 3))).capitalize() + r.choice(["ez", "res", "ño", "da", "nte", "son", "man", "er", "lulde", "que", "to"])


def _entity(r: random.Random, kind: str) -> str:
    if kind == "phone":
        a, b, c = r.choice(["415", "209", "312", "503", "646", "787", "212", "917"]), "555" if r.random() < 0.8 else str(r.randint(200, 999)), _digits(r, 4)
        us = [f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"{a} {b} {c[:2]} {c[2:]}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"00 1 {a} {b} {c[:2]} {c[2:]}", f"1-{a}-{b}-{c}", f"{a} / {b} - {c}"]
        m = _digits(r, 6)
        uk = [f"07700 {m}", f"07700 9{m[:2]} {m[3:]}", f"+44 7700 {m}", f"+44 (0)7700 {m}", f"+44 7700 {m[:3]} {m[3:]}", f"020 7946 {m[:4]}", f"+44 20 7946 {m[:4]}"]
        other = [f"+34 6{_digits(r, 2)} {m[:3]} {m[3:]}", f"+51 9{_digits(r, 2)} {m[:3]} {m[3:]}", f"+49 30 {m}{_digits(r, 2)}", f"+33 6 {m[:2]} {m[2:4]} {m[4:]} {_digits(r, 2)}"]
        return r.choice(us + us + uk + other)
    if kind == "id_number":
        d = _digits
        head = r.choice(["000", "666", "9" + d(r, 2)])
        low = "00" + d(r, 6)
        return r.choice([f"{head}-{d(r, 2)}-{d(r, 4)}", f"{head} {d(r, 2)} {d(r, 4)}", f"{head}{d(r, 2)}{d(r, 4)}", f"{low}{r.choice('ABCDEFGHJKLMNPQRSTVWXYZ')}", f"{low[:2]}.{low[2:5]}.{low[5:]}-{r.choice('ABCDEFGHJKLMNPQRSTVWXYZ')}", f"99-{low}-{d(r, 1)}", f"XQ{d(r, 7)}", f"{r.choice('ABCXYZ')}{r.choice('ABCXYZ')}{d(r, 7)}"])
    if kind == "address":
        road = r.choice(["Quarry", "Willow Bend", "Candle Mill", "Old Ferry", "Maple Hollow", "Sparrow", "Fennel", "Thornbury", "Oak", "Church", "King"])
        calle = r.choice(["Los Tilos", "del Alfarero", "San Bartolo", "La Noria", "las Acacias", "Tres Pozos", "Almendro", "del Molino Viejo", "Puente Hondo", "Mayor", "Rosario", "Santa Rosa"])
        rue = r.choice(["de la Forge", "du Vieux Puits", "des Peupliers", "Victor Hugo"])
        n, k = r.randint(1, 2400), r.randint(1, 30)
        return r.choice([f"{n} {road} Road", f"{n} {road} Lane", f"{n} {road} St., Apt {k}", f"{n} {road} Street", f"{road}weg {n}", f"Calle {calle} {n}", f"calle {calle} nº {n}, piso {k % 9}", f"C/ {calle}, {n}, {k % 9}º B", f"Pasaje {calle} #{n}", f"Jr. {calle} {n}, dpto. {k}", f"Av. {calle} {n}", f"{n} rue {rue}", f"Avenida {calle} {n}"])
    if kind == "email":
        user = r.choice([f"{r.choice(sorted(GIVEN))}{r.choice('._-')}{_surname(r).lower()}", f"{r.choice(sorted(GIVEN))}{r.randint(1950, 2005)}", f"{_surname(r).lower()}+listas", f"{r.choice('abcdefgjmrst')}{_surname(r).lower()}", r.choice(sorted(GIVEN))])
        host = r.choice(["correo", "postino", "mail.nubelia", "casaverde", "oficina", "gmx"])
        tld = r.choice(["example", "test", "invalid", "com", "org", "es"])
        plain, dots = f"{user}@{host}.{tld}", f"{host}.{tld}".replace(".", " punto ")
        return r.choice([plain, plain, plain, f"{user} (at) {host}.{tld}", f"{user}[at]{host.replace('.', '[dot]')}[dot]{tld}", f"{user} arroba {dots}", f"{user} at {host} dot {tld}"])
    given = r.choice(sorted(GIVEN & AMBIGUOUS) if r.random() < 0.25 else sorted(GIVEN)).title()
    return r.choice([given, given, f"{given} {_surname(r)}", f"{given} {_surname(r)} {_surname(r)}", f"{r.choice(['Dr.', 'Dra.', 'Sra.', 'Sr.', 'Mrs.', 'Mr.', 'don', 'doña', 'Ms.'])} {_surname(r)}"])


def _unlisted(r: random.Random) -> str:
    """A made-up given name."""
    while True:
        name = ("".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 3))) + r.choice(["", "", "n", "s", "l", "k", "m"])).capitalize()
        if len(name) >= 4 and name.lower() not in GIVEN_LIKE | FUNCTION | SUBJECTS | VOCATIVES:
            return name


def _strong(r: random.Random) -> tuple[str, tuple[int, int, str] | None]:
    """A text with a name in a telling context, or an address without a street's kind, or what looks like them."""
    fill = lambda p: re.sub(r"\{(\d+)\}", lambda m: _surname(r) if m[1] == "0" else _digits(r, int(m[1])), p)
    x = r.random()
    if x < 0.45:
        name = r.choice([_unlisted(r), _unlisted(r), f"{_unlisted(r)} {_surname(r)}", r.choice(sorted(GIVEN)).title()])
        pattern = r.choice(_STRONG)
        i = pattern.index("{}")
        return pattern.replace("{}", name), (i, i + len(name), "name")
    if x < 0.6:
        street, pattern = fill(r.choice(_STREETS)), r.choice(_LIVE)
        i = pattern.index("{}")
        return pattern.replace("{}", street), (i, i + len(street), "address")
    return fill(r.choice(_STRONG_DECOYS if x < 0.9 else _LIVE_DECOYS)), None


def labelled(n: int = SAMPLE, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the spans and kinds of what was put into them."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts, spans, text, cased = [], [], "", True
        for _ in range(r.choice([1, 1, 2, 3])):
            x = r.random()
            if len(out) % 8 >= 5 and x >= 0.3:
                # What only its case and context tell stays in its case.
                parts.append(_strong(r))
                cased = False
            elif x < 0.5:
                kind = r.choice(KINDS)
                pattern, entity = r.choice(_CONTEXT[kind]), _entity(r, kind)
                if kind == "name" and not pattern.startswith("{}") and r.random() < 0.3:
                    entity = r.choice([_unlisted(r), f"{_unlisted(r)} {_surname(r)}"])
                    cased = False
                i = pattern.index("{}")
                parts.append((pattern.replace("{}", entity), (i, i + len(entity), kind)))
            elif x < 0.85:
                parts.append((re.sub(r"\{(\d+)\}", lambda m: _digits(r, int(m[1])) if m[1] != "0" else r.choice(["415", "209", "312", "206", "503"]) + r.choice(["555", _digits(r, 3)]) + _digits(r, 4), r.choice(_DECOYS)), None))
            else:
                parts.append((r.choice(_FILLER if r.random() < 0.5 else _OPENERS), None))
        for p, span in parts:
            if text:
                text += r.choice([". ", "; ", "\n", ", "])
            if cased and span and span[2] in ("name", "address") and r.random() < 0.12:
                p = p[: span[0]] + (p[span[0] : span[1]].lower() if len(p.lower()) == len(p) else p[span[0] : span[1]]) + p[span[1] :]
            if span:
                spans.append((len(text) + span[0], len(text) + span[1], span[2]))
            text += p
        text += r.choice(["", "", ".", "!"])
        change = r.random() if cased else 1.0
        changed = text.upper() if change < 0.06 else text.lower() if change < 0.14 else text.title() if change < 0.19 else text
        out.append((changed if len(changed) == len(text) else text, spans))
    return out


@functools.lru_cache(maxsize=2)
def model(sample: int = SAMPLE, seed: int = 5) -> dict[str, Boosted]:
    """One boosted model per kind, fitted on two thirds of the labelled sample and calibrated on the rest."""
    texts = labelled(sample, seed)
    cut = len(texts) * 2 // 3
    out = {}
    for kind, generate in GENERATORS.items():
        sets: tuple[list, list] = ([], [])
        for k, (text, spans) in enumerate(texts):
            own = [s for s in spans if s[2] == kind]
            for start, end, x in generate(Text(text)):
                hit = any(min(end, e) - max(start, s) >= 0.6 * max(end - start, e - s) or kind == "name" and s <= start and end <= e + 1 and start == s for s, e, _ in own)
                sets[k >= cut].append((x, hit))
        (x, y), (vx, vy) = ((np.array([a for a, _ in s], dtype=float), np.array([b for _, b in s], dtype=float)) for s in sets)
        out[kind] = Boosted().fit(x, y).calibrate(vx, vy)
    return out


# -- spans -------------------------------------------------------------------------------------------------------------


def select(texts: list[str], models: dict[str, Boosted]) -> list[list[tuple[int, int, str]]]:
    """The spans to redact of each text, in order, not overlapping. Candidates of all texts are judged at once."""
    kept: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    views = [Text(t) for t in texts]
    for kind, generate in GENERATORS.items():
        rows, xs = [], []
        for k, t in enumerate(views):
            for start, end, x in generate(t):
                rows.append((k, start, end))
                xs.append(x)
        if rows:
            p = models[kind].predict(np.array(xs, dtype=float))
            for (k, start, end), q in zip(rows, p, strict=True):
                if q >= models[kind].threshold:
                    kept[k].append((start, end, kind, float(q)))
    rank = {"email": 0, "address": 1, "phone": 2, "id_number": 2, "name": 3}
    out = []
    for spans in kept:
        chosen: list[tuple[int, int, str]] = []
        for start, end, kind, _ in sorted(spans, key=lambda s: (rank[s[2]], -s[3], s[0])):
            if all(end <= a or start >= b for a, b, _ in chosen):
                chosen.append((start, end, kind))
        out.append(sorted(chosen))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its placeholder, e.g. [EMAIL], and otherwise unchanged."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


_INNER_CAPITAL = re.compile(r"[^\W\d_,;:][,;:]?\s+[A-ZÀ-Þ][a-zà-ÿ]")
_MAIL_SIGNS = re.compile(r"@|\barroba\b|\bat\b", re.I)
_SEEDS = GIVEN_LIKE | TITLES | GREET


_DIGIT = re.compile(r"\d")


def _worth(text: str) -> bool:
    """Whether any generator can propose a span: what each of them needs, and no more."""
    if _DIGIT.search(text) or _MAIL_SIGNS.search(text) or _INNER_CAPITAL.search(text):
        return True
    words = _WORD.findall(text)
    low = {w.lower() for w in words}
    if not _SEEDS.isdisjoint(low):
        return True
    return any(w[0].isupper() for w in words[:-1]) and (not PERSON_VERBS.isdisjoint(low) or sum(w[0].isupper() for w in words) > 1)


def redacted(rows: DataFrame, row_id: str) -> DataFrame:
    """(row_id, content, kinds): each row's content with placeholders, and the kinds found in it, sorted.

    Null content stays null, with no kinds.
    """
    models = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["content"]]
            worth = [k for k, x in enumerate(texts) if _worth(x)]
            spans: list = [[]] * len(texts)
            for k, found_in in zip(worth, select([texts[k] for k in worth], models), strict=True):
                spans[k] = found_in
            content = [redact(t, s) if isinstance(x, str) else None for x, t, s in zip(pdf["content"], texts, spans, strict=True)]
            yield pd.DataFrame({"row_id": pdf["row_id"], "content": content, "kinds": [sorted({k for _, _, k in s}) for s in spans]})

    return rows.select(F.col(row_id).cast("long").alias("row_id"), "content").mapInPandas(run, "row_id long, content string, kinds array<string>")


def redacted_tables(message: DataFrame, context_record: DataFrame) -> DataFrame:
    """(tbl, row_id, content, kinds) of message and context_record."""
    m, c = redacted(message, "seq"), redacted(context_record, "record_id")
    return m.select(F.lit("message").alias("tbl"), "row_id", "content", "kinds").unionByName(c.select(F.lit("context_record").alias("tbl"), "row_id", "content", "kinds"))


def found(message: DataFrame, context_record: DataFrame) -> DataFrame:
    """(tbl, row_id, kind): one row per record and kind in its content. Rows without id are left out."""
    return redacted_tables(message, context_record).where("row_id is not null").select("tbl", "row_id", F.explode("kinds").alias("kind")).distinct()
