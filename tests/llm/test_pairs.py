import numpy as np

from tracewright.llm import endings, language, pairs, profiles
from tracewright.llm.labelmodel import ABSTAIN, YES, LabelModel
from tracewright.llm.profiles import Profiles

JOURNALS = "record_id long, sealed boolean, user_message string, final_response string, model_calls array<struct<model_id:string,cot_reasoning:string>>, mask int, defects string"
GOOD = "The gateway came back after 12 minutes, and the cache of Torul reads its settings again."
Q = "Why does the price list in Torul show only 5 rows?"
CASES = [
    (Q, GOOD, None), (Q, None, "empty"), (Q, "  \n", "empty"), (Q, "n/a", "empty"), (Q, "```\n```", "empty"), (Q, "...", "empty"),
    (Q, "The gateway came back after 12 minutes, and the cac", "truncated"), (Q, "We moved the index before anyone [truncated]", "truncated"), (Q, "It holds 12 rows.\n- Torul\n- Zanel", None), (Q, "It holds 12 rows. Total: 12", None),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "Sorry for the wait; the price list of Torul now has 12 rows.", None), ("¿Por qué el panel muestra solo 5 filas?", "Lo siento, no puedo ayudar con eso.", "refusal"),
    ("为什么这个列表只显示5行？", "很遗憾，这件事我必须拒绝。", "refusal"),
    (Q, "Re: " + Q, "copied"), (Q, Q.lower(), "copied"), (Q, Q + " " + GOOD, None),
    (Q, "El panel de control depende de Torul, por eso faltan 12 entradas y eso es normal.", "wrong_language"), (Q, "原因はTorulではなく検索画面そのものでした。", "wrong_language"),
    (Q + " Please answer in Japanese.", "原因はTorulではなく検索画面そのものでした。", None), (Q + " Please answer in Japanese.", GOOD, "wrong_language"),
    ("Warum zeigt der Index nur 5 Zeilen? Bitte auf Spanisch antworten.", "El panel de control depende de Torul, por eso faltan 12 entradas.", None),
    (None, GOOD, None), (" ", "El panel de control depende de Torul, por eso faltan 12 entradas.", None), (None, "", "empty"),
]


def test_types(spark):
    # Enough ordinary pairs around the cases for the model to learn from.
    rows = [(i, True, q, a, None, 1, "x") for i, (q, a, _) in enumerate(CASES)]
    rows += [(1000 + i, True, Q, f"The cache of Torul came back after {i} minutes, and the index reads its settings again.", [("m", GOOD), ("m", "")], 1, "x") for i in range(300)]
    rows += [(5000, False, Q, None, None, 1, "x")]
    out = pairs.defective_pairs(spark.createDataFrame(rows, JOURNALS)).collect()
    got = {r["record_id"]: r["defect_type"] for r in out if r["record_id"] < 1000}
    assert got == {i: d for i, (_, _, d) in enumerate(CASES) if d}
    assert {(r["answer_field"], r["call_no"], r["defect_type"]) for r in out if 1000 <= r["record_id"] < 5000} == {("cot_reasoning", 1, "empty")}
    assert all(r["record_id"] != 5000 for r in out)


def test_empty_table(spark):
    assert pairs.defective_pairs(spark.createDataFrame([], JOURNALS)).count() == 0


def said(question, answer, cap=500):
    mask = pairs.votes(pairs.Question(question, Profiles()), answer, cap, Profiles())
    return {f"{d}.{f}": mask >> pairs.WIDTH * i + 2 * k & 3 for i, d in enumerate(pairs.ORDER) for k, f in enumerate(pairs.FUNCTIONS[d])}


def test_functions_read_whole_texts():
    own = said(Q, "The cache came back after 3 minutes. " * 50_000)
    assert not any(v == YES for k, v in own.items() if k.startswith("wrong_language"))
    late = said(Q, "I have thought about this for a while and about all that it needs. " * 20 + "I can't help with that.")
    assert late["refusal.declines"] == YES
    assert said(Q, "We looked at this, unfortunately " + "for a very long time " * 50 + "without a word")["refusal.apologises"] == YES
    twice = said(Q, f"{Q} {Q} {Q}")
    assert twice["copied.in_question"] == twice["copied.covers_question"] == twice["copied.ends_in_question"] == YES
    assert said(Q, "*" * 5000 + "null")["empty.stand_in"] == YES and said(Q, "*" * 100_000)["empty.no_letters"] == YES


def test_functions_know_nothing_of_each_other():
    own = said(Q, Q.rstrip("?") + " and the cac")
    assert own["copied.covers_question"] == own["truncated.no_end"] == YES
    assert said(None, "It is.")["refusal.off_topic"] == said(None, "It is.")["copied.long_run"] == ABSTAIN


def test_two_defects_are_kept(spark):
    rows = [(i, True, Q, f"The cache of Torul came back after {i} minutes, and the index reads its settings again.", None, 1, "x") for i in range(400)]
    rows += [(1000 + i, True, Q, None if i % 2 else GOOD[:40], None, 1, "x") for i in range(20)]
    rows += [(2000, True, Q, "El panel de control depende de Torul, por eso faltan 12 entradas y eso es nor", None, 1, "x")]
    rows += [(2001 + i, True, Q, "El panel de control depende de Torul, por eso faltan 12 entradas y eso es todo.", None, 1, "x") for i in range(10)]
    got = {r["record_id"]: r["defects"] for r in pairs.defective_pairs(spark.createDataFrame(rows, JOURNALS)).collect()}
    assert got[2000] == ["truncated", "wrong_language"] and got[2001] == ["wrong_language"]


def test_label_model_recovers_the_rates():
    rng = np.random.default_rng(0)
    hit, false = np.array([0.9, 0.8, 0.7]), np.array([0.02, 0.05, 0.1])
    y = rng.random(80_000) < 0.1
    v = (rng.random((80_000, 3)) < np.where(y[:, None], hit, false)).astype(int)
    v[rng.random(v.shape) < 0.1] = ABSTAIN
    half = rng.random(80_000) < 0.5
    m = LabelModel(3).fit(*np.unique(v[half], axis=0, return_counts=True), 300)
    assert abs(m.prior - 0.1) < 0.02 and np.abs(m.hit - hit).max() < 0.06 and np.abs(m.false - false).max() < 0.03
    m.validate(*np.unique(v[~half & y], axis=0, return_counts=True), *np.unique(v[~half], axis=0, return_counts=True))
    p = m.posterior(v) >= m.cutoff
    assert 2 * (p & y).sum() / (p.sum() + y.sum()) > 0.75


def test_cutoff_follows_the_planted_rows():
    m = LabelModel(2)
    votes, rows = np.array([[0, 0], [1, 0], [1, 1]]), np.array([900, 60, 40])
    m.validate(np.array([[1, 1]]), np.array([50]), votes, rows)
    strict = m.cutoff
    m.validate(np.array([[1, 1], [1, 0]]), np.array([10, 90]), votes, rows)
    assert m.cutoff < strict
    assert LabelModel(2).validate(np.zeros((0, 2)), np.zeros(0), votes, rows).cutoff == 0.5


def test_profiles(spark):
    texts = {"en": "the weather here was rather nice and they went along with everything", "it": "il tempo qui era piuttosto bello e sono andati avanti con tutto quello che"}
    rows = [(i, lang + ("-XX" if i % 2 else " "), texts[lang] + f" {i}", 1) for i, lang in enumerate(["en", "it"] * 20)] + [(90, "english", "zzz", 1), (None, "en", "zzz", 1), (91, "en", None, 1), (92, "qq", "zzz", 1)]
    p = profiles.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string, run int"))
    assert p.languages == ["en", "it"] and p.guess("piuttosto bello")[0] == "it" and p.guess("the rather nice")[0] == "en" and p.guess("12")[0] is None
    assert profiles.learn(spark.createDataFrame([], "doc_id long, lang string, text string")).guess("x") == (None, 0.0)


def test_endings():
    for text, want in (("Done.", endings.COMPLETE), ('He said "no."', endings.COMPLETE), ("and the cac", endings.OPEN), ("wait…", endings.MARKED), ("x [cut]", endings.MARKED), ("`a --b 1`", endings.NATURAL), ("See https://a.example/b", endings.NATURAL), ("​", endings.NOTHING), ("", endings.NOTHING), ("完了。", endings.COMPLETE), ("完了し", endings.OPEN), ("[1, 2]", endings.COMPLETE), ("- a" + " long item" * 300, endings.NATURAL), ("x" * 3000 + " `" + "y" * 3000 + "`", endings.NATURAL), (" N/A ", endings.NOTHING), ("Done." + " " * 5000, endings.COMPLETE)):
        assert endings.ending(text) == want, text


def test_languages():
    for text, want in (("Why does it show only the rows?", "en"), ("Warum zeigt der Index nur das?", "de"), ("¿Por qué no se ve el panel?", "es"), ("Pourquoi le panneau est vide ?", "fr"), ("列表为什么是空的？", "zh"), ("なぜですか？", "ja"), ("यह क्यों है?", "hi"), ("Torul Zanel", None)):
        assert language.guess(text, 0.5)[0] == want, text
    assert language.asked_for("Réponds en allemand stp.") == "de" and language.asked_for("The Spanish list is empty.") is None
