"""Personal data in prose: found, typed, and replaced by placeholders or by keyed surrogates.

Detection reads whole texts once with patterns per type; a cheap test in the JVM keeps texts that can hold
nothing from the Python workers. Names are read from what announces them (sign-offs, "assigned to",
their counterparts in other languages, titles, contact records) and from e-mail addresses in the same text that spell them.

Surrogates: each distinct entity (type and folded value, so spelling variants of one e-mail or name are
one) gets a replacement derived with a key from a hash: digits become digits in the same grouping (cards keep a
valid check digit), letters keep their case and script, names get names of the same script, case, order
and likely gender. Entities whose surrogates collide are drawn again with another salt until all are distinct, so
distinct entities stay distinct and one entity is one surrogate everywhere.

Defined results: null and empty texts have no values; a value that occurs often in a field comes once; overlapping finds
keep the longest, then the first type in ``TYPES``; placeholders and masks that are already there are left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.tables import new_folder, settled

TYPES = ("email", "card_number", "phone", "id_number", "street_address", "person_name")
_FILES = "png|jpe?g|gif|svg|css|js|ts|py|md|txt|log|json|ya?ml|html?|pdf|zip|csv|xml|ico|webp"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_À-ɏ](?:[A-Za-z0-9_À-ɏ.+'-]*[A-Za-z0-9_À-ɏ])?(?:@|＠| @ | ?\(at\) ?| ?\[at\] ?)(?!\d+x\.)[A-Za-z0-9-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)(?!(?:{_FILES})\b)[A-Za-z][A-Za-z0-9-]*)+(?<=[A-Za-z0-9])", re.I
)
_DIGIT = r"[0-9０-９]"
_CARD = re.compile(rf"(?<![A-Za-z0-9_.+-])(?<!\d[ ]){_DIGIT}(?:[ -]?{_DIGIT}){{12,18}}(?![A-Za-z0-9_-]|[ .]?\d)")
_DASH = "－‐ー-"
_PHONE = re.compile(
    rf"(?<![A-Za-z0-9_.+/-])(?:"
    rf"(?:\+\d{{1,3}}|00\d{{1,3}})(?:[ ./-]?\(\d{{1,4}}\))?(?:[ ./-]?\d{{1,8}}){{1,6}}"
    rf"|\(\d{{2,4}}\) ?\d{{3,4}}[ .-]\d{{4}}"
    rf"|\d{{3}}[.-]\d{{3}}[.-]\d{{4}}"
    rf"|[2-9]\d{{9}}"
    rf"|0?\d{{2,3}} \d{{4}} \d{{4}}"
    rf"|[0０][0-9０-９]{{1,3}}[{_DASH}][0-9０-９]{{3,4}}[{_DASH}][0-9０-９]{{4}}"
    rf")(?:,? ?(?:ext\.?|x|Durchwahl|poste|内線|分机) ?\d{{1,5}})?(?![A-Za-z0-9_-]|[./]\d)"
)
# Words that announce an identity number.
_ID_CUE = r"(?:\b(?:id|social|ssn|passport|document|identity|licen[cs]e|ausweis\w*|reisepass|dni|nie|pasaporte|pièce d['’]identité|passeport|identifiant)\b|证件号|身份证|护照|身分証|旅券|マイナンバー|पहचान|पासपोर्ट|आधार)"
_ID = re.compile(r"(?<![A-Za-z0-9_.+/-])(?:\d{3}([- ])\d{2}\1\d{4}|\d{8}-?[A-Z]|[A-Z]{2}\d{6,8}|[A-Z]\d{1,2}[A-Z]\d{4}[A-Z]\d|[A-Z]\d{2} \d{6} [A-Z])(?![A-Za-z0-9_-]|[./]\d)")
_ID_PLAIN = re.compile(rf"{_ID_CUE}[^\d\n.。।]{{0,25}}?(?<![\w.+/-])([A-Z]{{0,3}}\d{{7,10}}[A-Z]?)(?![A-Za-z0-9_-]|[./]\d)", re.I)
# Words for streets and the units within a house.
_STREET = "Street|St\\.?|Avenue|Ave\\.?|Road|Rd\\.?|Lane|Ln\\.?|Drive|Boulevard|Blvd\\.?|Crescent|Close|Court|Ct\\.?|Way|Place|Square|Terrace|Row|Hill|Gardens|Parade|Grove|Mews|Walk|Path"
_RUE = r"rue|avenue|av\.|boulevard|bd\.?|quai|allée|place|chemin|impasse|cours|route|square|passage|sentier"
# Letters are those of the Latin script: in other scripts no blank parts a value from what follows.
_UNIT = r"(?:,? (?:Unit|Apt\.?|Apartment|Suite|Ste\.?|Flat|Floor|Room) ?#?[A-Za-z0-9]+)?"
_ADDRESSES = [
    re.compile(rf"(?<![A-Za-z0-9_.-])\d{{1,5}}[A-Za-z]? (?!The )(?:[A-Z][A-Za-z0-9_À-ɏ'’-]+ ){{1,3}}(?:{_STREET})(?![A-Za-z0-9_À-ɏ]){_UNIT}"),
    re.compile(r"(?<![A-Za-z0-9_À-ɏ-])(?:[A-ZÄÖÜ][A-Za-z0-9_À-ɏ-]*(?:straße|strasse|str\.|gasse|weg|steig|allee|platz|ring|damm|ufer|wehr|hof|chaussee|stieg|pfad)|(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den) [A-ZÄÖÜ][A-Za-z0-9_À-ɏ-]+) \d{1,4}(?: ?[a-z])?(?![A-Za-z0-9_À-ɏ])"),
    re.compile(r"(?<![A-Za-z0-9_À-ɏ-])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Ronda|Carrera|Travesía|Glorieta)(?: (?:de|del|la|las|los|el))*(?: [A-ZÁÉÍÓÚÑ][A-Za-z0-9_À-ɏ-]+)+(?: (?:de|del|la|las|los)(?: [A-ZÁÉÍÓÚÑ][A-Za-z0-9_À-ɏ-]+)+)*,?(?: (?:n[º°o]\.?|núm\.?))? ?\d{1,4}(?: ?(?:bis|[A-Z]))?(?![A-Za-z0-9_À-ɏ])(?:, ?\d{1,2}[ºª°] ?[A-Z]?(?![A-Za-z0-9_À-ɏ]))?"),
    re.compile(r"(?<![A-Za-z0-9_À-ɏ.-])\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:" + _RUE + r")(?: (?:de la|de l['’]|des|du|de|aux|au|à la|d['’]))? ?[A-ZÀÂÉÈÊÎÔÛ][A-Za-z0-9_À-ɏ'’-]+(?:(?: (?:de la|des|du|de|d['’]))? [A-ZÀÂÉÈÊÎÔÛ][A-Za-z0-9_À-ɏ'’-]+)*"),
    re.compile(r"(?:寄到|寄往|送到|送至|发到|发往|地址是|地址为|地址[:：]|住在|住址是|位于)?(?P<v>[一-鿿]{2,5}?(?:大道|大街|路|街|巷|弄|胡同)\d{1,5}号(?:\d{1,4}(?:号楼|栋|单元|楼|室))*)"),
    re.compile(r"(?P<v>[一-鿿々ヶ]{2,8}[0-9０-９]{1,3}丁目[0-9０-９]{1,3}番(?:地の?)?(?:[0-9０-９]{1,3}号)?(?:[0-9０-９]{1,4}号室)?)"),
]
_TOKEN = r"[A-Za-zÀ-ɏͰ-ϿЀ-ӿ]+(?:['’-][A-Za-zÀ-ɏͰ-ϿЀ-ӿ]+)*"
_LATIN = rf"(?:{_TOKEN}, (?:{_TOKEN}|[A-Z]\.)|(?:{_TOKEN}|[A-Z]\.)(?: [A-Z]\.)*(?: {_TOKEN}){{1,2}}?)"
_HAN = r"[一-鿿々ヶ]{1,4}(?:[ 　][一-鿿々ァ-ヶ]{1,4})?|[一-鿿]{2,4}|[一-鿿]+・[一-鿿]+"
_DEVA = r"[ऀ-ॿ]+(?: [ऀ-ॿ]+){1,2}?"
_ANY = rf"(?:{_HAN}|{_LATIN}|{_DEVA})"
# What stands before and after a person's name.
_CUES = [
    (r"(?:[Aa]ssigned to|[Hh]anded to|[Rr]eported to) ", r"(?= (?:for|on|by|since|and)\b|[.,;!?\n]|$)"),
    (r"\bAsk ", r"(?= (?:from|in|at|about|for|to)\b|[.;!?\n]|$)"),
    (r"(?:[Rr]aised|[Ss]igned|[Rr]eported|[Ss]ent|[Rr]equested|[Ww]ritten|[Oo]pened|[Aa]pproved) by ", r"(?= (?:yesterday|today|on|in|at|last|this|from|for)\b|[.;!?\n]|$)"),
    (r"(?:(?:[Kk]ind|[Bb]est|[Ww]arm) )?(?:[Rr]egards|[Ss]incerely|[Cc]heers|[Yy]ours|[Tt]hanks),\s+", r"(?=[ \t]*(?:[\n.!?。]|$|(?=[A-Z¿¡])))"),
    (r"(?:Mit freundlichen Grüßen|Viele Grüße|Gruß|Saludos|Atentamente|Cordialement|Bien à vous),?\s+", r"(?=[ \t]*(?:[\n.!?]|$))"),
    (r"(?:[Mm]y name is|[Tt]his is|[Ii]ch heiße|[Mm]ein Name ist|[Mm]e llamo|[Jj]e m['’]appelle|[Jj]e suis) ", r"(?=[.,;!?\n]|$| (?:from|and|von|aus|de|y|et)\b)"),
    (r"(?:Ansprechperson|Ansprechpartner(?:in)?|Zuständig|Kontakt)(?: ist|:) ", r"(?= (?:im|in|am|aus|von|vom|bei)\b|[.,;!?\n]|$)"),
    (r"(?:[Ss]uivi|[Ss]igné|[Dd]emandé|[Ee]nvoyé|[Oo]uvert) par ", r"(?= (?:au|à|en|chez|du|de|hier)\b|[.;!?\n]|$)"),
    (r"(?:[Ll]o|[Ll]a) (?:pidió|envió|firmó|abrió|solicitó) ", r"(?= (?:ayer|hoy|en|de|desde|el)\b|[.;!?\n]|$)"),
    (r"(?:负责人|联系人|经办人|申请人)(?:是|为|[:：]) ?", r"(?=[。，、；\s]|$|的|和)"),
    (r"(?:担当者?|責任者|依頼者)(?:は|[:：]) ?", r"(?=です|さん|様|。|、|\s|$)"),
    (r"यह ", r"(?= ने )"),
    (r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Mme|Mlle)\.? (?=[A-ZÀ-Þ])", r"(?=[ .,;!?\n]|$)"),
]
# The names' own letters keep their case, so cues are matched as they stand.
_NAMED = [re.compile(a + rf"(?P<v>{_ANY})" + b) for a, b in _CUES]
#: The end of what stands before an address or phone in a contact record: a name, then a separator.
_RECORD = re.compile(rf"(?:^|\n|[:：。।/|]\s*|[.!?] +)(?P<v>{_ANY})(?: [/|] |,? ?\n)$")
# Capitalised words that begin sentences or name things, never part of a name behind a cue.
_NOT_NAMES = frozenset("the a an this that it you we they he she support billing team desk everyone anyone someone me him her them us der die das den el la los las le les un une il elle".split())
_MASK = re.compile(r"\[[A-Z_ ]+\]|\*{2,}|[xX]{3,}|<[A-Z_]+>")

# The cheap test in the JVM, wider than the patterns above. Cues that may begin with a small letter are sought as plain text, without their
# first letter; the pattern has the rest, and nothing in it begins with a small Latin letter, so these are passed over at once.
_SMALL = (
    "ssigned to |anded to |eported to |aised by |igned by |eported by |ent by |equested by |ritten by |pened by |pproved by |egards,|incerely,|heers,|ours,|hanks,|y name is |his is |ch heiße |ein Name ist |e llamo "
    "| m'appelle | m’appelle |e suis |uivi par |igné par |emandé par |nvoyé par |uvert par |pidió |envió |firmó |abrió |solicitó "
).split("|")
#: Java's blanks are fewer, so none is asked for behind a cue; यह is too frequent to be asked for alone.
_LARGE = "|".join("यह .* ने " if a == "यह " else a.replace(r"\s+", "") for a, _ in _CUES if not a.startswith(("(?:[", "(?:(?:[")))
_MAY_HOLD = (
    rf"(?U)(?![a-z])(?:[@＠]|[(\[](?i:at)[)\]]|\p{{Nd}}(?:[ ./(){_DASH}]{{0,3}}\p{{Nd}}){{5}}"
    r"|[A-Z]\d{2}|\d[a-zA-Z]? (?:[A-Z][\w'’-]+ ){1,3}(?:St|Av|Ro|Rd|La|Ln|Dr|Bo|Bl|Cr|Cl|Co|Ct|Wa|Pl|Sq|Te|Hi|Ga|Pa|Gr|Me)"
    rf"|\d ?(?:bis|ter|quater)?,? (?:{_RUE})"
    r"| (?=\d)(?<=(?:straße|strasse|str\.|gasse|weg|steig|allee|platz|ring|damm|ufer|wehr|hof|chaussee|stieg|pfad) )|\b(?:Am|An de[rn]|Im|In der|Auf de[mr]|Zu[mr]|Unter den) \p{Lu}[\w-]+ \d"
    rf"|Calle|C/|Avda|Avenida|Av\.|Plaza|Paseo|Camino|Ronda|Carrera|Travesía|Glorieta|\d号|丁目|{_LARGE})"
)


def may_hold(text: Column) -> Column:
    """Whether ``text`` can hold any value at all; null for null."""
    test = text.rlike(_MAY_HOLD)
    for cue in _SMALL:
        test = test | text.contains(cue)
    return test


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0 and any(digits)


def _enough_digits(text: str, least: int = 8) -> bool:
    return sum(c.isdigit() for c in re.split(r"ext|x|Durchwahl|poste|内線|分机", text)[0]) >= least


def _is_name(value: str) -> bool:
    if value[0] >= "ɐ":
        return True
    words = re.findall(_TOKEN, value)
    if not words or any(w.lower() in _NOT_NAMES for w in words if len(w) > 1):
        return False
    return len([w for w in words if len(w) > 1]) >= (1 if "." in value else 2)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every value in ``text``, in order and without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "@" in text or "＠" in text or "at)" in text or "at]" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    # No card begins with 00, which calls abroad.
    found += [(m.start(), m.end(), "card_number") for m in _CARD.finditer(text) if m[0][:2] not in ("00", "００") and luhn(m[0])]
    found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if _enough_digits(m[0])]
    found += [(m.start(), m.end(), "id_number") for m in _ID.finditer(text)]
    found += [(m.start(1), m.end(1), "id_number") for m in _ID_PLAIN.finditer(text)]
    for p in _ADDRESSES:
        found += [(m.start("v"), m.end("v"), "street_address") if "v" in p.groupindex else (m.start(), m.end(), "street_address") for m in p.finditer(text)]
    for p in _NAMED:
        found += [(m.start("v"), m.end("v"), "person_name") for m in p.finditer(text) if _is_name(m["v"])]
    for a, _, kind in [x for x in found if x[2] in ("street_address", "phone")]:
        if text[max(0, a - 2) : a] in ("/ ", "| ") or text[max(0, a - 1) : a] == "\n":
            # No name goes beyond these signs.
            before = max(text.rfind(c, 0, max(0, a - 2)) for c in "\n:：。/|!?")
            before = max(0, before)
            if (m := _RECORD.search(text[before:a])) and _is_name(m["v"]):
                found.append((before + m.start("v"), before + m.end("v"), "person_name"))
    for a, b, kind in [x for x in found if x[2] == "email"]:
        words = re.findall(r"[^\W\d_]{2,}", re.split(r"@|＠|\(at\)|\[at\]", text[a:b])[0])[:2]
        if len(words) == 2:
            spelled = rf"(?<![A-Za-z0-9_À-ɏ]){words[0]} {words[1]}(?![A-Za-z0-9_À-ɏ@＠])|(?<![A-Za-z0-9_À-ɏ]){words[1]}, {words[0]}(?![A-Za-z0-9_À-ɏ@＠])"
            found += [(m.start(), m.end(), "person_name") for m in re.finditer(spelled, text, re.I)]
    masked = [m.span() for m in _MASK.finditer(text)] if found else []
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0] - x[1], TYPES.index(x[2]), x[0])):
        if all(b <= x or a >= y for x, y, _ in kept) and all(b <= x or a >= y for x, y in masked):
            kept.append((a, b, kind))
    return sorted(kept)


def redact(text: str | None) -> str | None:
    """``text`` with ``[TYPE]`` in the place of each value."""
    return _around(text, find(text)) if text else text


def _around(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


FOUND = "source_field string, row_key string, call_no long, start int, stop int, pii_type string, pii_value string"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("source_field", "row_key", "call_no", "start", "stop", "pii_type", "pii_value")}
        for field, key, call, text in zip(*(batch.column(c).to_pylist() for c in ("source_field", "row_key", "call_no", "text")), strict=True):
            for a, b, kind in find(text):
                for n, v in zip(out, (field, key, call, a, b, kind, text[a:b]), strict=True):
                    out[n].append(v)
        if out["start"]:
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("source_field", pa.string()), ("row_key", pa.string()), ("call_no", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("pii_type", pa.string()), ("pii_value", pa.string())]))


def texts(journals: DataFrame, spans: DataFrame) -> DataFrame:
    """(source_field, row_key, call_no, text) of all fields that hold prose."""
    key = F.col("record_id").cast("string").alias("row_key")

    def plain(column: str) -> DataFrame:
        return journals.select(F.lit(f"decision_journals.{column}").alias("source_field"), key, F.lit(-1).cast("bigint").alias("call_no"), F.col(column).alias("text"))

    results = journals.select(key, F.posexplode("tool_calls").alias("call_no", "call")).select(F.lit("decision_journals.tool_result").alias("source_field"), "row_key", F.col("call_no").cast("bigint").alias("call_no"), F.col("call.result").alias("text"))
    prompts = spans.where("span_name = 'governance.model_call'").select(F.lit("spans.input_value").alias("source_field"), F.col("span_id").alias("row_key"), F.lit(-1).cast("bigint").alias("call_no"), F.col("input_value").alias("text"))
    return plain("user_message").unionByName(plain("final_response")).unionByName(results).unionByName(prompts)


def occurrences(fields: DataFrame) -> DataFrame:
    """Every value with its place, see ``FOUND``; map-only."""
    return fields.where(may_hold(F.col("text"))).mapInArrow(_detect, FOUND)


def values(fields: DataFrame) -> DataFrame:
    """Each distinct value of a field once; repeats of a row collapse."""
    return occurrences(fields).select("source_field", "row_key", "call_no", "pii_type", "pii_value").distinct()


# --- surrogates ---------------------------------------------------------------------------------

# Syllables that invented names are put together from.
_HEADS = "Al Ber Cal Dor El Fer Gal Hol Iv Jan Kel Lor Mer Nor Ok Pal Ral Sel Tor Ul Ver Wal Yor Zel".split()
_MIDDLE = "an el in or ul ar en il om ur ad es ib ot uv ym".split()
_TAILS = "acker beck croft dorf eva fors gren hagen iano jord kova lund meier nes ová quist".split()
_VOWELS, _ENDINGS = "aeiou", {"f": "a ia ina ela ora une ille isa".split(), "m": "o an ek or us in el ir".split()}
_HAN_PARTS = ("安柏岑戴艾方高何季康雷莫宁欧潘秦", "安波辰德恩帆歌涵佳凯岚明诺平清然", "思同文熙言一宇泽知子远青雨川禾光")
_DEVA_PARTS = {"m": "आरव कबीर मोहन रोहन सुरेश विवेक अनिल दीपक".split(), "f": "मीरा रेखा सीमा लता आशा गीता राधा नेहा".split()}
_DEVA_FAMILY = "बंसल चोपड़ देसाई गुप्त जोश कपूर मेहत नायर पटेल राव सेठ त्रिपाठ वर्म यादव मिश्र शर्म".split()
_DEVA_MORE = "पुर वाल कर नाथ दास मणि राज वीर देव सेन लाल चंद गढ़ भान जीत धर".split()
#: Letters of other scripts that take each other's place: vowels, then the rest.
_LETTERS = [("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), ("αεηιουω", "βγδζθκλμνξπρστφχψ"), ("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロ", ""), ("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろ", ""), ("กขคงจชซญดตถทนบปผพฟมยรลวศสหอ", ""), ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "")]
_SWAPS = {c: group for pair in _LETTERS for group in pair for c in group}


_ARTICLES = frozenset("de del la las los el le les des du d l aux au à et y".split())
# The parts of an address: what stays before the name, the name, what stays behind it.
_EN_STREET = re.compile(rf"(\d{{1,5}}[A-Za-z]? )(.+?)( (?:{_STREET})(?:{_UNIT}))", re.I)
_FR_STREET = re.compile(r"(\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:" + _RUE + r") ?)(.+)()", re.I)
_ES_STREET = re.compile(r"((?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Ronda|Carrera|Travesía|Glorieta) ?)(.+?)(,?(?: (?:n[º°o]\.?|núm\.?))? ?\d.*)", re.I)
_DE_STREET = re.compile(r"((?:(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den) )?)(.+?)((?:straße|strasse|str\.|gasse|weg|steig|allee|platz|ring|damm|ufer|wehr|hof|chaussee|stieg|pfad)? \d.*)", re.I)
_ZH_STREET = re.compile(r"()(.+?)((?:大道|大街|路|街|巷|弄|胡同)\d.*)")
_JA_STREET = re.compile(r"()(.+?)([0-9０-９]+丁目.*)")
_JA_PLACES = "都道府県市区郡町村"


class _Draw:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, what: str, salt: int):
        self.key = key
        self.seed, self.n, self.pool = hmac.new(key, f"{salt}|{what}".encode(), hashlib.sha256).digest(), 0, 0
        self.left = 0

    def below(self, m: int) -> int:
        if self.left < m << 32:
            self.n += 1
            self.pool, self.left = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big"), 1 << 256
        self.pool, r = divmod(self.pool, m)
        self.left //= m
        return r


def _shape(text: str, draw: _Draw) -> str:
    """Digits to digits and letters to letters of the same case; everything else stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(chr(ord(c) - int(c) + draw.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + draw.below(26)))
        elif c.isalpha():
            out.append(chr((97 if c.islower() else 65) + draw.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _checked(text: str) -> str:
    """A card number whose last digit makes it pass the check."""
    at = max(i for i, c in enumerate(text) if c.isdigit())
    zero = ord(text[at]) - int(text[at])
    return next(t for d in range(10) if luhn(t := text[:at] + chr(zero + d) + text[at + 1 :]))


def _alike(old: str, new: str) -> bool:
    """Whether a run of three letters of the one is in the other, or they are the same."""
    a, b = old.casefold(), new.casefold()
    return a == b or any(a[i : i + 3] in b for i in range(len(a) - 2))


def _word(old: str, draw: _Draw, more: int = 1) -> str:
    """An invented word in the case of ``old`` without a run of its letters; ``more`` syllables in between."""
    new = old
    for _ in range(64):
        new = _HEADS[draw.below(24)] + "".join(_MIDDLE[draw.below(16)] for _ in range(more)) + _TAILS[draw.below(16)]
        if not _alike(old, new):
            break
    return new.upper() if len(old) > 1 and old.isupper() else new.lower() if old.islower() else new


def _swapped(text: str, draw: _Draw) -> str:
    """Letters of other scripts for letters of the same script, kind and case; the ending of a first name tells its gender and stays."""
    out = []
    for c in text:
        group = _SWAPS.get(c.lower(), "")
        new = c.lower()
        while len(group) > 1 and new == c.lower():
            new = group[draw.below(len(group))]
        out.append(new.upper() if c != c.lower() else new)
    return "".join(out)


def _sign(i: int, old: str, draw: _Draw) -> str:
    new = old
    while new == old:
        new = _HAN_PARTS[min(i, 2)][draw.below(16)]
    return new


def _signs(old: str, draw: _Draw, keep: str = "", more: int = 0) -> str:
    """Han signs for the signs of ``old`` and ``more`` behind them; those in ``keep`` stay."""
    out = [c if c in keep else _sign(i, c, draw) for i, c in enumerate(old)]
    return "".join(out) + "".join(_HAN_PARTS[2][draw.below(16)] for _ in range(more))


def _given(initial: str, gender: str, draw: _Draw, more: int) -> str:
    inner = "".join(_MIDDLE[draw.below(16)] for _ in range(more))
    if initial in "AEIOU":
        return initial + "lrnsdmvk"[draw.below(8)] + inner + _ENDINGS[gender][draw.below(8)]
    return initial + _VOWELS[draw.below(5)] + "lrnsdmvk"[draw.below(8)] + inner + _ENDINGS[gender][draw.below(8)]


def _name(text: str, draw: _Draw, more: int = 0) -> str:
    """A name of the same script, case, order and likely gender; each of ``more`` adds a syllable or sign, so names never run out.

    In the Latin script the family name depends on the family name alone, and initials are shifted by what the family
    gives, so that ``R. Kessbrook`` stays short for ``Ravik Kessbrook`` and differs from ``S. Kessbrook``. Where a name has nothing
    else that could be drawn again, a collision gives it another family name.
    """
    if any("一" <= c <= "鿿" for c in text):
        made = "".join(c if c in " 　・" else _swapped(c, draw) if c in _SWAPS else _sign(i, c, draw) for i, c in enumerate(text))
        return made + "".join(_HAN_PARTS[2][draw.below(16)] for _ in range(more))
    if any("ऀ" <= c <= "ॿ" for c in text):
        gender = "f" if text.split(" ")[0][-1:] in "ािीइईआ" else "m"
        return _DEVA_PARTS[gender][draw.below(8)] + " " + _DEVA_FAMILY[draw.below(16)] + "".join(_DEVA_MORE[draw.below(16)] for _ in range(more + 1))
    if text.casefold()[0] in _SWAPS or text[0] > "ɏ":
        gendered = re.compile(r"(?<=\w)[аяιηα](?= |$)")
        made = list(_swapped(text, draw))
        for m in gendered.finditer(text):
            made[m.start()] = text[m.start()]
        extra = _LETTERS[0] if "Ѐ" <= text[0] <= "ӿ" else _LETTERS[1] if "Ͱ" <= text[0] <= "Ͽ" else None
        return "".join(made) + ("".join(extra[1][draw.below(len(extra[1]))] + extra[0][draw.below(len(extra[0]))] for _ in range(more)) if extra else "")
    swapped = ", " in text
    words = text.split(", ")[::-1] if swapped else text.split(" ")
    first = re.split(r"[ .]", words[0])[0].lower()
    gender = "f" if first[-1:] in "aeiy" else "m"
    initial = [re.fullmatch(r"[A-Za-z]\.", w) is not None for w in words]
    family = words[-1].casefold()
    salt = more if all(initial[:-1]) else 0
    shift = 1 + _Draw(draw.key, f"initial|{family}", salt).below(25)
    out = []
    for i, w in enumerate(words):
        if i == 0 and len(words) > 1:
            base = unicodedata.normalize("NFKD", w[0])[0].upper()
            letter = chr(65 + (ord(base) - 65 + shift) % 26)
            new = letter + "."
            for _ in range(0 if initial[i] else 64):
                if not _alike(w, new := _given(letter, gender, draw, 1 + more)):
                    break
            out.append(new)
        elif initial[i]:
            out.append(chr(65 + draw.below(26)) + ".")
        else:
            own = _Draw(draw.key, f"family|{w.casefold()}", salt) if i == len(words) - 1 else draw
            out.append("-".join(_word(x.title(), own, 2 + salt) for x in w.split("-")))
    if text.isupper():
        out = [w.upper() for w in out]
    elif text.islower():
        out = [w.lower() for w in out]
    return ", ".join(out[::-1]) if swapped else " ".join(out)


def _digits(text: str, draw: _Draw) -> str:
    return re.sub(r"[0-9０-９]", lambda m: chr(ord(m[0]) - int(m[0]) + draw.below(10)), text)


def _address(text: str, draw: _Draw, more: int = 0) -> str:
    """Other numbers and other names; the words for kinds of streets and units, and articles stay."""
    if "丁目" in text and (m := _JA_STREET.fullmatch(text)):
        # A place's kind stays behind its name: not where the name itself begins or ends with that sign.
        name = "".join(c if 0 < i and c in _JA_PLACES and m[2][i + 1 : i + 2] not in (*_JA_PLACES,) else "\0" for i, c in enumerate(m[2]))
        made = "".join(c if c != "\0" else _sign(i, m[2][i], draw) for i, c in enumerate(name))
        return _signs("", draw, more=more) + made + _digits(m[3], draw)
    if m := _ZH_STREET.fullmatch(text):
        return _signs(m[2], draw, more=more) + _digits(m[3], draw)
    m = next((m for p in (_FR_STREET, _ES_STREET, _EN_STREET, _DE_STREET) if (m := p.fullmatch(text))), None)
    head, name, tail = m.groups() if m else ("", text, "")
    left = [more]

    def other(w: re.Match) -> str:
        if w[0].lower() in _ARTICLES and (w[0].islower() or w[0][0] in "dDlL" and name[w.end() : w.end() + 1] in ("'", "’")):
            return w[0]
        return _word(w[0], draw, 1 + (left.pop() if left else 0))

    made = re.sub(r"(?:[dl](?=['’])|[^\W\d_]+(?:['’][^\W\d_]+)*)", other, name, flags=re.I)
    return _digits(head, draw) + _digits(made, draw) + _digits(tail, draw)


def _made(kind: str, value: str, draw: _Draw, salt: int) -> str:
    if kind == "email":
        m = re.fullmatch(r"(.*?)(@|＠| @ | ?\(at\) ?| ?\[at\] ?)(.*)", value)
        return _shape(m[1], draw) + m[2] + "example" + re.search(r"(?:\.| ?\[dot\] ?| ?\(dot\) ?)\w+$", m[3])[0] if m and re.search(r"(?:\.| ?\[dot\] ?| ?\(dot\) ?)\w+$", m[3]) else _shape(value, draw)
    if kind == "card_number":
        return _checked(_shape(value, draw))
    if kind == "person_name":
        return _name(value, draw, salt)
    if kind == "street_address":
        return _address(value, draw, salt)
    head = re.match(r"\+\d{1,3}|00\d{2}", value)
    return (head[0] if head else "") + _shape(value[head.end() if head else 0 :], draw)


def surrogate(kind: str, value: str, key: bytes, salt: int = 0) -> str:
    """The replacement of one value: same type, script, case and format, never the value itself; the same for all spellings of an entity up to format."""
    own = fold(kind, value)
    for again in range(64):
        made = _made(kind, value, _Draw(key, f"{kind}|{own}" + f"|{again}" * (again > 0), salt), salt)
        if fold(kind, made) != own:
            return made
    return f"[{kind.upper()}]"  # nothing in it can be drawn


def fold(kind: str, value: str) -> str:
    """One spelling for all spellings of an entity."""
    if kind in ("card_number", "phone", "id_number"):
        return "".join(str(int(c)) if c.isdigit() else c.upper() for c in value if c.isalnum())
    if kind == "email":
        value = re.sub(r" ?(?:@|＠|\(at\)|\[at\]) ?", "@", value)
        return re.sub(r" ?(?:\[dot\]|\(dot\)) ?", ".", value).lower()
    if ", " in value and kind == "person_name":
        value = " ".join(value.split(", ")[::-1])
    return re.sub(r"\s+", " ", value).casefold()


#: Draws of an entity at most; each makes names longer, so few ever need a third.
ROUNDS = 24
#: Types whose surrogates may grow.
_OPEN_ENDED = ("person_name", "street_address")


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("pii_type", "pii_value", "salt")), strict=True))
            entity = [fold(k, v) for k, v, _ in rows]
            made = [surrogate(k, v, key, s) for k, v, s in rows]
            folded = [fold(k, m) for (k, _, _), m in zip(rows, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pii_type"), batch.column("pii_value"), pa.array(entity), pa.array(made), pa.array(folded), pa.array([s for *_, s in rows], pa.int32())], ["pii_type", "pii_value", "entity", "surrogate", "folded", "salt"])

    return run


def surrogate_table(found: DataFrame, key: bytes, rounds: int = 8) -> DataFrame:
    """(pii_type, pii_value, entity, surrogate) with one surrogate entity per entity, none shared by two and none that is real.

    Entities that would share one are drawn again with the next salt, the smallest entity keeps its draw; so are those whose draw is
    a value that occurs. Only these are drawn again. Names and addresses grow with the salt and are drawn until all are
    distinct; of the types with a fixed number of digits, what still collides after ``rounds`` gets a hash behind it (of the others
    after ``ROUNDS``), so that distinctness always holds.
    """
    schema = "pii_type string, pii_value string, entity string, surrogate string, folded string, salt int"
    columns = ["pii_type", "pii_value", "entity", "surrogate", "folded"]
    values = settled(found.select("pii_type", "pii_value").distinct())
    clash = Window.partitionBy("pii_type", "folded")
    drawn = settled(values.withColumn("salt", F.lit(0)).mapInArrow(_drawn(key), schema))
    real = drawn.select("pii_type", F.col("entity").alias("folded")).distinct()
    # What is decided is appended to one table, so that plans don't grow with the rounds.
    folder, spark = new_folder(found.sparkSession), found.sparkSession
    drawn.limit(0).select(*columns).write.parquet(folder)
    for i in range(ROUNDS):
        kept = spark.read.schema(drawn.select(*columns).schema).parquet(folder)
        there = real.unionByName(kept.select("pii_type", "folded")).distinct().withColumn("there", F.lit(True))
        judged = drawn.withColumn("owner", F.min("entity").over(clash)).join(there, ["pii_type", "folded"], "left")
        lost = settled(judged.where("there or entity != owner").select("pii_type", "entity").distinct())
        again = settled(drawn.join(lost, ["pii_type", "entity"], "left_semi").select(*columns))
        drawn.join(lost, ["pii_type", "entity"], "left_anti").select(*columns).write.mode("append").parquet(folder)
        if i >= rounds:
            open_ended = F.col("pii_type").isin(*_OPEN_ENDED) if i < ROUNDS - 1 else F.lit(False)
            again.where(~open_ended).withColumn("surrogate", F.concat("surrogate", F.lit(" "), F.left(F.sha2("entity", 256), F.lit(12)))).write.mode("append").parquet(folder)
            again = again.where(open_ended)
        if again.isEmpty():
            break
        drawn = settled(again.select("pii_type", "pii_value", F.lit(i + 1).alias("salt")).mapInArrow(_drawn(key), schema))
    return spark.read.schema(drawn.select(*columns).schema).parquet(folder).select("pii_type", "pii_value", "entity", "surrogate")


def _rebuilt(column: str):
    """The text around the places in ``places`` (sorted) with ``column`` of each in between."""
    start = F.lit(1)
    step = F.aggregate(
        "places",
        F.struct(F.lit("").alias("out"), start.alias("at")),
        lambda acc, p: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"], p["start"] + 1 - acc["at"]), p[column]).alias("out"), (p["stop"] + 1).alias("at")),
    )
    return F.concat(step["out"], F.substring(F.col("text"), step["at"], F.length("text")))


PLACED = "source_field string, row_key string, call_no long, text string, redacted string, places array<struct<start:int,stop:int,pii_type:string,pii_value:string>>"
_PLACE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("pii_type", pa.string()), ("pii_value", pa.string())]))


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        redacted, places = [], []
        for text, suspect in zip(batch.column("text").to_pylist(), batch.column("suspect").to_pylist(), strict=True):
            found = find(text) if suspect else []
            places.append([{"start": a, "stop": b, "pii_type": kind, "pii_value": text[a:b]} for a, b, kind in found])
            redacted.append(_around(text, found) if found else text)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_field", "row_key", "call_no", "text")), pa.array(redacted, pa.string()), pa.array(places, _PLACE)], ["source_field", "row_key", "call_no", "text", "redacted", "places"])


def rewritten(fields: DataFrame, key: bytes) -> DataFrame:
    """(source_field, row_key, call_no, redacted, surrogate_text) of every text as often as it is stored; the same where nothing is found.

    Texts are read and searched once; only those with values are shuffled, by a hash of place and text.
    """
    by = ["source_field", "row_key", "call_no"]
    suspect = F.coalesce(may_hold(F.col("text")), F.lit(False)).alias("suspect")
    read = settled(fields.select(*by, "text", suspect).mapInArrow(_replaced, PLACED))
    plain = read.where(F.size("places") == 0).select(*by, "redacted", F.col("text").alias("surrogate_text"))
    held = read.where(F.size("places") > 0).withColumn("id", F.sha2(F.to_json(F.struct(*by, "text")), 256))
    each = held.select("id", F.explode("places").alias("p")).select("id", "p.*").distinct()
    table = surrogate_table(each, key).select("pii_type", "pii_value", "surrogate")
    placed = each.join(table, ["pii_type", "pii_value"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "surrogate"))).alias("places"))
    changed = held.drop("places").join(placed, "id").select(*by, "redacted", _rebuilt("surrogate").alias("surrogate_text"))
    return plain.unionByName(changed)
