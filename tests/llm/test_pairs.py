"""p5: each defect, sound neighbours of each, and edges."""

import random

from strandline.llm import pairs

CONVERSATIONS = "conv_id long, turn_no int, role string, content string, version string, slug string"
SOUND = "I have always liked patience, above all in the kitchen and last night. The baker kept the guitar near the station, because nobody else wanted to."
CASES = [
    ("Where was the baker?", None, "empty"),
    ("Where was the baker?", " ​", "empty"),
    ("Where was the baker?", "(awaiting data ingestion)", "empty"),
    ("Where was the baker?", "N/A", "empty"),
    ("Where was the baker yesterday?", "WHERE WAS THE BAKER YESTERDAY", "copy"),
    ("Where was the baker yesterday?", "You asked: Where was the baker yesterday?", "copy"),
    ("Where was the baker yesterday?", f"«Where was the baker yesterday» — {SOUND}", None),
    ("Where was the baker?", "Sorry, I cannot provide this kind of information.", "refusal"),
    ("¿Dónde estaba el panadero?", "Lo siento, mis normas me impiden entrar en lo de la guitarra.", "refusal"),
    ("¿Dónde estaba el panadero?", "Lo siento mucho por el retraso, el tren se paró dos veces y nadie avisó.", None),
    ("Where was the baker?", "I can't come on Saturday, the bus does not run, so we moved it to Monday.", None),
    ("Where was the baker?", "Para mí lo importante es el orden, porque así lo habíamos acordado con la jefa.", "other_language"),
    ("Where was the baker? Please answer in Spanish.", "Para mí lo importante es el orden, porque así lo habíamos acordado con la jefa.", None),
    ("Where was the baker?", SOUND, None),
    ("Where was the baker?", "The baker kept the guitar near the station, because nobody else wanted to", None),
    ("Where was the baker?", "The baker kept the guitar near the station, because nob", "truncated"),
    ("Where was the baker?", "The baker kept the guitar near the station, but", "truncated"),
    ("Where was the baker?", "The baker kept these (the guitar", "truncated"),
    ("Where was the baker?", "The baker kept these:\n1. guitar\n2.", "truncated"),
    (None, SOUND, None),
]


def test_cases(make):
    rows = []
    for i, (q, a, _) in enumerate(CASES):
        rows += [{"conv_id": i, "turn_no": 4, "role": " User ", "content": q}] * 2 + ([{"conv_id": i, "turn_no": 5, "role": "assistant", "content": a}] if a is not None else []) + [{"conv_id": i, "turn_no": 6, "role": "system", "content": "x"}]
    rows += [{"conv_id": 900 + i, "turn_no": t, "role": r, "content": c} for i in range(8) for t, r, c in ((0, "user", "Where was it?"), (1, "assistant", SOUND))]
    random.Random(1).shuffle(rows)
    extra = ", defect string, prev string, last string, n long, ends long, id long"
    got = {r["conv_id"]: (r["turn_no"], r["defect"]) for r in pairs.found(make(CONVERSATIONS + extra, *rows)).collect()}
    assert got == {i: (4, d) for i, (_, _, d) in enumerate(CASES) if d}


def test_suffix_automaton_as_search():
    r = random.Random(3)
    for _ in range(40):
        a, b = [r.choice("xyz") for _ in range(r.randint(1, 12))], [r.choice("xyzw") for _ in range(12)]
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max((k for k in range(1, i + 2) if tuple(b[i + 1 - k : i + 1]) in runs), default=0) for i in range(len(b))]
        assert pairs.SuffixAutomaton(a).longest(b) == want


def test_edges(make):
    assert pairs.found(make(CONVERSATIONS)).collect() == []
    rows = [{"conv_id": None, "turn_no": 1, "role": "user"}, {"conv_id": 1, "turn_no": None, "role": "user"}, {"conv_id": 2, "turn_no": 1, "role": None}, {"conv_id": 3, "turn_no": 1, "role": "assistant", "content": "x"}, {"conv_id": 4, "turn_no": 0, "role": "user", "content": "q " * 20_000}, {"conv_id": 4, "turn_no": 1, "role": "assistant", "content": SOUND * 300}]
    assert pairs.found(make(CONVERSATIONS, *rows)).collect() == []


def test_verdicts_do_not_depend_on_the_number_of_answers(make):
    # "near the" and "the river" stand about 150 times each: the one ends a sentence once, by chance, the other often.
    corpus = ["He stood near the."] + ["We kept it near the river and left."] * 100 + ["We kept it near the river."] * 49
    cases = {"The baker kept the old guitar near the": "truncated", "The baker kept the old guitar near the river": None, "The baker kept the old guitar near the riv": "truncated"}
    verdicts = []
    for times in (1, 10):
        answers = [*cases, *corpus * times]
        rows = [{"conv_id": i, "turn_no": t, "role": r, "content": c} for i, a in enumerate(answers) for t, r, c in ((0, "user", "Where was it?"), (1, "assistant", a))]
        found = {r["conv_id"]: r["defect"] for r in pairs.found(make(CONVERSATIONS, *rows)).collect()}
        verdicts.append([found.get(i) for i in range(len(cases))])
    assert verdicts[0] == verdicts[1] == list(cases.values())


THANKS = "Thank you so much for writing to me again after all this time, and for asking so kindly about my family and about everything that happened with the bakery last year in the village. "
STORY = "We met at the station. The train was late again. My aunt had brought bread. Nobody knew the way. It rained all day. We laughed a lot. The dog slept. "


def test_refusals_are_found_at_any_place_and_passing_phrases_are_none():
    automaton = pairs._refusal_automaton()
    question = "where was the baker of the village when the bakery burned down last year".split()
    declines = [
        THANKS + "I'd rather not talk about that.",
        "You want to know where the baker of the village was when the bakery burned down last year. " * 2 + "I cannot share that.",
        "It concerns several people who trusted me with what they saw on that night and on the days after it. None of them has ever spoken of it in public. The families still live next door to each other. I prefer not to comment.",
        THANKS[:-2] + ", it is kind of you, but I must decline",
    ]
    tells = [STORY + "Dogs were not allowed to enter. " + STORY, STORY * 3 + "In the end we were not allowed to stay.", STORY]
    assert min(len(x) for x in declines) > 160
    assert [pairs.refuses(question, x, automaton) for x in declines] == [True] * len(declines)
    assert [pairs.refuses(question, x, automaton) for x in tells] == [False] * len(tells)
    assert pairs.judge(" ".join(question), declines[0], True, 0, 0, 0, 0, automaton) == "refusal"


# Written after the phrases of the module, none of which they hold whole.
UNSEEN_REFUSALS = [
    "Unfortunately I couldn't respond to that.", "I'm sorry, but I am unable to advise on such matters.", "That is something I won't discuss here.", "I refuse to engage with this.", "My apologies, I'm not authorized to disclose it.", "I will not comment on private people.", "Regrettably I could not help you with it.",
    "Perdona, pero no debo opinar sobre personas reales.", "Lamentablemente no voy a responder a eso.", "No estoy autorizada a revelar esos datos.", "Me niego a contestar esa pregunta.", "Disculpa, no se me permite compartir esa información.", "No soy capaz de facilitar eso.",
    "Désolé, je ne dois pas divulguer cela.", "Je refuse de répondre à cette question.", "Il m'est impossible de commenter ce sujet.", "Je ne suis pas habilité à vous conseiller.", "Malheureusement je ne pourrai pas y répondre.",
    "Das werde ich leider nicht kommentieren.", "Dazu kann ich mich nicht äußern.", "Tut mir leid, das kann ich nicht verraten.", "Hierbei kann ich nicht behilflich sein.",
]
NO_REFUSALS = [
    "I can't say enough about the bread there, it was the best of all.", "I couldn't help but laugh when the dog ran off.", "We won't need the umbrella, it will be dry.", "No puedo más con este calor, así que nos fuimos a la playa.", "No voy a la oficina los lunes, trabajo desde casa.", "Je ne peux pas dormir quand il fait chaud, alors je lis.", "Ich gehe nicht oft ins Kino, lieber bleibe ich zu Hause.", "Das Brot war nicht teuer und sehr gut.",
]


def test_refusals_in_other_words():
    automaton = pairs._refusal_automaton()
    assert not any(f" {x}" in f" {t.lower()}" for t in UNSEEN_REFUSALS for x in pairs.REFUSALS)
    assert sum(pairs.refuses([], t, automaton) for t in UNSEEN_REFUSALS) >= 0.9 * len(UNSEEN_REFUSALS)
    assert [t for t in NO_REFUSALS if pairs.refuses([], t, automaton)] == []


def test_an_answer_that_repeats_whole_sentences_is_a_copy():
    automaton = pairs._refusal_automaton()
    question = "My aunt moved to the coast last year. Do you prefer tea or coffee in the morning?"
    judge = lambda a: pairs.judge(question, a, True, 0, 0, 0, 0, automaton)
    assert judge("My aunt moved to the coast last year.") == "copy" and judge("Well, do you prefer tea or coffee in the morning?") == "copy"
    assert judge("Coffee in the morning.") is None and judge("I prefer tea in the morning.") is None
