from re import _constants as C
from re import _parser

import pytest

from tracewright.llm import pii

KEY = b"key"
CASES = [
    ("Please write to a.b+c@mail.example about it.", [("email", "a.b+c@mail.example")]), ("Copy ilse.dunbrook [at] example [dot] com on it.", [("email", "ilse.dunbrook [at] example [dot] com")]), ("用 amaru＠post.example.org 。", [("email", "amaru＠post.example.org")]),
    ("Use logo@2x.png and ref@stable.", []), ("Call +1-646-555-0168 ext. 84 now.", [("phone", "+1-646-555-0168 ext. 84")]), ("Ring (212) 555-0125 or +49 (0)30 23125 895.", [("phone", "(212) 555-0125"), ("phone", "+49 (0)30 23125 895")]),
    ("電話は ０３-００００-０１０９ です。", [("phone", "０３-００００-０１０９")]), ("Run 2026-02-14 10:22:31, port 5432 on 10.0.0.7, build 4155550.", []), ("Card 4111-1111-1111-1111 was declined, 4111-1111-1111-1112 too.", [("card_number", "4111-1111-1111-1111")]),
    ("Call me on 0044-7700-900437 after lunch.", [("phone", "0044-7700-900437")]), ("送り先は365 Copperfield Avenue, Unit 6です。", [("street_address", "365 Copperfield Avenue, Unit 6")]), ("送り先はCalle del Olmo Viejo nº 41です", [("street_address", "Calle del Olmo Viejo nº 41")]), ("寄到41 rue Hugo吧", [("street_address", "41 rue Hugo")]), ("在Lerchensteig 35号", [("street_address", "Lerchensteig 35")]),
    ("my social is 957 21 2709 if needed", [("id_number", "957 21 2709")]), ("Passport L54X7954T4 was scanned.", [("id_number", "L54X7954T4")]), ("Trace 900-12-34567 was sampled.", []), ("The ID on file is 902434475 so far; count 902434475.", [("id_number", "902434475")]),
    ("Ship it to 219 Foxhollow Crescent, Apt 22 instead.", [("street_address", "219 Foxhollow Crescent, Apt 22")]), ("The Avenue module has 12 lanes on Harlow Street.", []), ("Total: 873 The Harlow Street release shipped.", []), ("Lieferung nach Moorwiesenstraße 83 b bitte.", [("street_address", "Moorwiesenstraße 83 b")]),
    ("Enviar a Calle del Olmo Viejo nº 41 hoy.", [("street_address", "Calle del Olmo Viejo nº 41")]), ("Livrez au 76 bis, allée du Vieux Puits merci.", [("street_address", "76 bis, allée du Vieux Puits")]), ("寄到栖霞巷275号。", [("street_address", "栖霞巷275号")]), ("送り先は霞原町8丁目11番12号です。", [("street_address", "霞原町8丁目11番12号")]),
    ("Assigned to Ravik L. Kessbrook for review.", [("person_name", "Ravik L. Kessbrook")]), ("Ask Winmere, Imke from billing.", [("person_name", "Winmere, Imke")]), ("Regards, PAVLO HAROVA\n More text.", [("person_name", "PAVLO HAROVA")]), ("Lo pidió mirza ostberg ayer.", [("person_name", "mirza ostberg")]),
    ("担当は星ヶ峰 透です。", [("person_name", "星ヶ峰 透")]), ("负责人是邬临川。", [("person_name", "邬临川")]), ("Harbor Desk and Maple Lantern are the two agents.", []), ("Contact [EMAIL] or [PHONE] as masked.", []),
    ("Tobin Ostescu\n365 Brindle Way\n+1 303 555 0153\nx@y.example", [("person_name", "Tobin Ostescu"), ("street_address", "365 Brindle Way"), ("phone", "+1 303 555 0153"), ("email", "x@y.example")]), (None, []), ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_find(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.find(text)] == want


def fields(spark, rows):
    return spark.createDataFrame(rows, "source_field string, row_key string, call_no long, text string")


def test_the_cheap_test_lets_all_finds_through(spark):
    rows = [("f", str(i), -1, t) for i, (t, _) in enumerate(CASES)] * 2
    got = {(r["row_key"], r["pii_type"], r["pii_value"]) for r in pii.values(fields(spark, rows)).collect()}
    assert got == {(str(i), k, v) for i, (_, w) in enumerate(CASES) for k, v in w}
    assert pii.values(fields(spark, rows)).count() == len(got)


def test_rewritten(spark):
    rows = [("f", "1", -1, "Write to a.b@mail.example or A.B@MAIL.EXAMPLE, not to c@mail.example."), ("f", "2", -1, "Again a.b@mail.example"), ("f", "3", -1, "nothing"), ("f", "3", -1, "nothing"), ("f", "4", -1, None), ("f", "5", -1, ""), ("f", "6", -1, "Mail x@y.example"), (None, None, None, "Mail x@y.example"), ("f", "6", -1, "Mail to x@y.example twice")]
    got = {r["row_key"]: r for r in pii.rewritten(fields(spark, rows), KEY).collect()}
    assert set(got) == {*"123456", None} and got[None]["redacted"] == "Mail [EMAIL]" and got["3"]["redacted"] == got["3"]["surrogate_text"] == "nothing" and got["4"]["redacted"] is None
    every = pii.rewritten(fields(spark, rows), KEY).collect()
    assert len(every) == 9 and {r["redacted"] for r in every if r["row_key"] == "6"} == {"Mail [EMAIL]", "Mail to [EMAIL] twice"}
    assert got["1"]["redacted"] == "Write to [EMAIL] or [EMAIL], not to [EMAIL]." == pii.redact(rows[0][3])
    first = got["2"]["surrogate_text"].removeprefix("Again ")
    assert first in got["1"]["surrogate_text"] and first != "a.b@mail.example" and first.lower() == pii.fold("email", got["1"]["surrogate_text"].split(" or ")[1].split(",")[0])


def test_surrogates_keep_type_and_format():
    for kind, value in (("card_number", "4111-1111-1111-1111"), ("phone", "+44 7700 900240"), ("id_number", "L54X7954T4"), ("email", "A.B@MAIL.EXAMPLE")):
        made = pii.surrogate(kind, value, KEY)
        assert made != value and made == pii.surrogate(kind, value, KEY) and len(made) == len(value) or kind == "email"
        assert kind == "email" or [c.isdigit() for c in made] == [c.isdigit() for c in value]
    assert pii.luhn(pii.surrogate("card_number", "4111 1111 1111 1111", KEY))
    assert pii.surrogate("person_name", "KESI MORDAHL", KEY).isupper() and ", " in pii.surrogate("person_name", "Winmere, Imke", KEY)
    assert all("一" <= c <= "鿿" for c in pii.surrogate("person_name", "邬临川", KEY))
    assert pii.surrogate("phone", "1", b"other") is not None


def test_collisions_are_drawn_again(spark):
    # Few surrogates exist for three signs, so many of these entities collide at first.
    rows = [("f", "1", -1, "id_number", f"{a}{b}") for a in "123456789" for b in range(10)]
    found = spark.createDataFrame([(k, v) for *_, k, v in rows], "pii_type string, pii_value string")
    table = pii.surrogate_table(found, KEY).collect()
    assert len(table) == 90 and len({r["surrogate"] for r in table}) == 90


ADDRESSES = [
    ("Calle del Olmo Viejo, 65", "Olmo Viejo", "Calle del "), ("76 bis, allée du Vieux Puits", "Vieux Puits", " bis, allée du "), ("12 rue Hugo", "Hugo", " rue "), ("青苔路100号", "青 苔", "路"), ("霞原町8丁目11番12号", "霞 原", "町"),
    ("219 Foxhollow Hill Crescent, Apt 22", "Foxhollow Hill", " Crescent, Apt "), ("Moorwiesenstraße 83 b", "Moorwiesen", "straße "), ("Am Mühlbach 3", "Mühlbach", "Am "), ("5 rue de l'Église", "Église", " rue de l'"),
]


@pytest.mark.parametrize("value,gone,kept", ADDRESSES)
def test_no_name_of_an_address_stays(value, gone, kept):
    for n in range(50):
        made = pii.surrogate("street_address", value, b"%d" % n)
        assert kept in made and all(w not in made if len(w) > 1 else made[value.index(w)] != w for w in gone.split()), made
        assert [c.isdigit() for c in made if c.isdigit() or c in ",'"] == [c.isdigit() for c in value if c.isdigit() or c in ",'"]


def test_names_keep_script_gender_and_initials():
    for n in range(30):
        key = b"%d" % n
        whole, short = pii.surrogate("person_name", "Ravik Kessbrook", key), pii.surrogate("person_name", "R. Kessbrook", key)
        assert short.split(" ")[1] == whole.split(" ")[1] and short[0] == whole[0] and short[1] == "."
        assert pii.surrogate("person_name", "Ravina Kessbrook", key).split(" ")[0][-1] in "ae" and not pii._alike("Kessbrook", whole.split(" ")[1])
        assert all("Ѐ" <= c <= "ӿ" or c == " " for c in pii.surrogate("person_name", "Иван Петров", key)) and pii.surrogate("person_name", "Анна Петрова", key).split(" ")[0].endswith("а")
        made = pii.surrogate("person_name", "山田 タロウ", key)
        assert all("一" <= c <= "鿿" for c in made[:2]) and all("ァ" <= c <= "ヶ" for c in made[3:])
        assert pii.surrogate("person_name", "सीमा राव", key).split(" ")[0][-1] in "ािी" and "é" not in pii.surrogate("email", "josé.ñandu@mail.example", key)


def test_surrogates_are_no_real_values(spark):
    rows = [("id_number", f"{i:02d}") for i in range(60)]
    table = pii.surrogate_table(spark.createDataFrame(rows, "pii_type string, pii_value string"), KEY).collect()
    assert not {r["surrogate"] for r in table} & {v for _, v in rows} and len({r["surrogate"] for r in table}) == 60


def test_names_of_initials_and_single_words(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 4)
    rows = [("person_name", f"{chr(65 + i)}. Zibran{k}".replace("0", "a").replace("1", "o")) for i in range(26) for k in range(2)] + [("person_name", n) for n in ("Zibrana", "Zibrano", "É. Zibrana", "Élo Zibrana", "A. B. Zibrana")]
    table = pii.surrogate_table(spark.createDataFrame(rows, "pii_type string, pii_value string"), KEY).collect()
    names = {r["pii_value"]: r["surrogate"] for r in table}
    assert len(set(names.values())) == len(rows) and not [v for v in names.values() if any(c.isdigit() for c in v)]


def test_large_number_of_names(spark):
    rows = [("person_name", f"{chr(65 + i % 26)}{'aeiou'[i % 5]}ranor Zib{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}m") for i in range(20_000)]
    table = pii.surrogate_table(spark.createDataFrame(rows, "pii_type string, pii_value string"), KEY).collect()
    names = {r["pii_value"]: r["surrogate"] for r in table}
    assert len(set(names.values())) == len(names) and not [v for v in names.values() if any(c.isdigit() for c in v)]


def test_surrogates_differ_from_their_values():
    assert all(pii.surrogate(k, v, b"%d" % n) != v for n in range(200) for k, v in (("street_address", "青路7号"), ("id_number", "7"), ("person_name", "Alva Aldacker"), ("person_name", "安安")))


def test_names_never_run_out(spark):
    rows = [("person_name", f"आ{chr(0x915 + i % 30)}{chr(0x915 + i // 30)} राव") for i in range(600)] + [("person_name", f"{chr(0x4E00 + i)}川") for i in range(600)]
    table = pii.surrogate_table(spark.createDataFrame(rows, "pii_type string, pii_value string"), KEY).collect()
    assert len({r["surrogate"] for r in table}) == 1200 and not [r for r in table if any(c.isascii() and c.isalnum() for c in r["surrogate"])]


def spelled(parts):
    """Texts of a pattern in which each alternative and each sign of a set occurs once."""
    ways = []
    for op, v in parts:
        if op is C.LITERAL:
            w = [chr(v)]
        elif op is C.IN and v[0][0] is not C.NEGATE:
            w = [c for k, x in v for c in ([chr(x)] if k is C.LITERAL else [chr(x[0]), chr(x[1])] if k is C.RANGE else [{C.CATEGORY_DIGIT: "4", C.CATEGORY_SPACE: " "}.get(x, "a")])]
        elif op is C.BRANCH:
            w = [t for b in v[1] for t in spelled(b)]
        elif op is C.SUBPATTERN:
            w = spelled(v[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            few, one = max(v[0], 1), spelled(v[2])
            w = [t * few for t in one] + [one[0] * min(v[1], few + 2)] + [""] * (v[0] == 0)
        else:
            w = [" "] if op is C.GROUPREF else [""]
        ways.append(w)
    first = [w[0] for w in ways]
    return list(dict.fromkeys("".join([*first[:i], t, *first[i + 1 :]]) for i, w in enumerate(ways) for t in w)) or [""]


def test_the_cheap_test_knows_every_alternative(spark):
    whole = [t for p in (pii._EMAIL, pii._CARD, pii._PHONE, pii._ID, pii._ID_PLAIN, *pii._ADDRESSES) for t in spelled(_parser.parse(p.pattern, p.flags))]
    cued = [c + n for a, _ in pii._CUES for c in spelled(_parser.parse(a)) for n in ("Marie Dupont", "邬临川", "सीमा राव ने कहा")]
    texts = ["電話は ０３－００００－０１０９ です", "Suivi par Marie Dupont", "12 av.Foch", "(look at) bob (AT) mail.example", *whole, *cued]
    texts = sorted({t for t in texts if pii.find(t)})
    assert len(texts) > 250 and {"Suivi par Marie Dupont", "12 av.Foch", "(look at) bob (AT) mail.example"} <= set(texts)
    got = {r[0] for r in pii.occurrences(fields(spark, [("f", t, -1, t) for t in texts])).select("row_key").distinct().collect()}
    assert not set(texts) - got
