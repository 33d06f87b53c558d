import pytest

from tracewright.llm import sentences as S

EN = S.Statistics(frozenset("dr e.g i.e cf fig sec inc vs a.m approx prof".split()), frozenset("the once about it we i is my this both".split()))
DE = S.Statistics(frozenset("dr z b d h nr bzw".split()), frozenset("der am wir".split()), frozenset({"mai"}))
CASES = [
    ("Dr. Kell saw it. The cache came back.", ["Dr. Kell saw it.", "The cache came back."], EN), ("It took 3.5 s, e.g. twice. We left.", ["It took 3.5 s, e.g. twice.", "We left."], EN), ('It said "Not now. Try later." and nothing more.', ['It said "Not now. Try later." and nothing more.'], EN),
    ("(See Sec. 3.1.) Once more it failed!", ["(See Sec. 3.1.)", "Once more it failed!"], EN), ("it failed. the cache came back. we left", ["it failed.", "the cache came back.", "we left"], EN), ("Names like a! confuse it.", ["Names like a! confuse it."], EN), ("It waited... and then came back.", ["It waited... and then came back."], EN),
    ("It failed.Once more.", ["It failed.", "Once more."], EN), ("It failed.Dr. Kell saw it.", ["It failed.", "Dr. Kell saw it."], S.Statistics(EN.abbreviations, EN.starters | {"dr"})), ("Call `a.b()` first. See https://a.example/b.c?d=1. The end", ["Call `a.b()` first.", "See https://a.example/b.c?d=1.", "The end"], EN), ("Am 3. Mai kam Dr. Ost. Wir gingen z. B. heim.", ["Am 3. Mai kam Dr. Ost.", "Wir gingen z. B. heim."], DE), ("„Nein. Nochmal!“ stand dort. Am Ende.", ["„Nein. Nochmal!“ stand dort.", "Am Ende."], DE),
    ("「失敗。もう一度。」と出た。終わり！本当？", ["「失敗。もう一度。」と出た。", "終わり！", "本当？"], S.Statistics()), ("日志写着“失败了。请重试！”，然后停了。版本2.3里，他说：“为什么？”请先保存。", ["日志写着“失败了。请重试！”，然后停了。", "版本2.3里，他说：“为什么？”", "请先保存。"], S.Statistics()),
    ("यह ठीक है। क्या यह है? हाँ", ["यह ठीक है।", "क्या यह है?", "हाँ"], S.Statistics()), ("هل هذا هو؟ نعم. لا", ["هل هذا هو؟", "نعم.", "لا"], S.Statistics()), ("ร้านปิดแล้ว ค่า 64 ในบ้าน ดู http://a.example ก่อน", ["ร้านปิดแล้ว", "ค่า 64 ในบ้าน", "ดู http://a.example ก่อน"], S.Statistics()),
    ("One\nline. The next\n\nPara\r\n\r\n- item one\n- item two. The rest\n  goes on\n1. x", ["One\nline.", "The next", "Para", "- item one", "- item two.", "The rest\n  goes on", "1. x"], EN), ("Text:\n```py\na = 1.\n\nB()\n```\nAfter it", ["Text:", "```py\na = 1.\n\nB()\n```", "After it"], EN), ("Text\n\n    code. Here\n    more\n\nEnd", ["Text", "code. Here\n    more", "End"], EN),
    ("~~~\nnever closed. The end", ["~~~\nnever closed. The end"], EN), ("no mark", ["no mark"], EN), ("  \n ", [], EN), ("", [], EN), (None, [], EN), ("...", ["..."], EN), ('An "open quote. The end', ['An "open quote.', "The end"], EN),
]


@pytest.mark.parametrize("text,want,known", CASES)
def test_units(text, want, known):
    assert [text[a:b] for a, b in S.units(text, known)] == want


@pytest.mark.parametrize("text,_,known", CASES)
def test_units_cover_everything_but_white_space(text, _, known):
    left = list(text or "")
    for a, b in S.units(text, known):
        assert text[a:b] == text[a:b].strip() != ""
        for i in range(a, b):
            left[i] = " "
    assert not "".join(left).strip()


def test_learning(spark):
    names = "Ost Bram Kell Vik Dahl".split()
    rows = [(i, f"The log of feed {i} was read by Dr. {names[i % 5]} again. Once it failed, i.e. twice, we left the feed. The dr of all trades is gone.".replace("The dr of all trades is gone.", "It is gone."), ("en", "EN", "en_x", None)[i % 4], "k", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string, n int")
    known = S.learn(docs).of("en")
    assert {"dr", "i.e"} <= known.abbreviations and {"the", "once", "it"} <= known.starters and not {"ost", "kell"} & known.starters
    out = S.sentence_units(docs)
    assert out.count() == 400 * 3 and S.sentence_units(docs.limit(0)).count() == 0


def test_long_text():
    text = 'It said "no. Not now." here (yes. No.) and left. ' * 20_000
    assert len(S.units(text, EN)) >= 1


def test_collocations_are_more_frequent_than_chance(spark):
    # Mai belongs to numbers; Kell begins sentences, now and then behind a number.
    lines = ["Wir sahen am 3. Mai den Stand der Dinge dort.", "Kell ging heim mit der alten Karte.", "Kell kam im Jahr nicht. Niemand blieb lange dort."]
    rows = [(i, "Kell kam im Jahr 2019. Kell blieb lange dort." if i % 30 == 2 else lines[i % 3], "de") for i in range(300)]
    known = S.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), starter_ratio=1e9).of("de")
    assert "mai" in known.after_number and "kell" not in known.after_number | known.starters


def test_a_pair_may_hold_a_starter(spark):
    rows = [(i, "We went up to St. Main again before noon. Main is shut now and the old door too." if i % 2 else "He went on to St. Paul later. The rain came soon. Then it left us there.", "en") for i in range(400)]
    known = S.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).of("en")
    assert "main" in known.starters and ("st", "main") in known.collocations
    assert len(S.units("We went to St. Main again.", known)) == 1


def test_the_language_is_read_from_the_whole_text():
    prose = "Der Dienst ist nicht mehr da und wir haben ihn bei der Wartung verloren. " * 40
    code = "```\n" + "if this is not in the list then that was on the way to it\n" * 60 + "```\n"
    quoted = "It was not in the log that we have, and this is what the job did. " * 31
    assert len(code) > 2000 and len(quoted) > 2000 and len(prose) > len(quoted)
    assert S.language_of(None, code + prose) == S.language_of("?", quoted + "\n\n" + prose * 2) == "de" and S.language_of("EN", prose) == "en"


def test_a_rare_abbreviation_is_learned_in_a_large_corpus(spark):
    filler = "so all of this goes on and on without an end in sight " * 170
    rows = [(i, filler + "as seen near abt. Kell again.", "en") for i in range(8)] + [(100 + i, filler, "en") for i in range(800)]
    assert "abt" in S.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).of("en").abbreviations
