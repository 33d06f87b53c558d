"""Which language a text is written in: by script, and by function words for the Latin script."""

from __future__ import annotations

import re

# Everyday function words of each language, in the order of a usual frequency list.
FUNCTION_WORDS = {
    "en": "the of and to is was in that it for on with as but before you not have has had what how why if by this are be can could please from which were before after there did does do will would should i my me we our they them their at an or so no only when who its it's your than then been just".split(),
    "de": "der die das und ist nicht von den dem des ein eine einen einem für mit auf bitte zuerst sich war dort bei wir haben hat nur nach wie warum danach wieder so es ich du sie kann kannst könntest was wer wo wann ob aus zum zur im am an als auch wenn aber sondern dass um über vor ohne deshalb läuft mehr noch gar kein keine wird werden wurde mir uns".split(),
    "es": "el la los las de que y en por para con una uno un del al lleva sin se es son solo pero después tras primero qué cómo no su sus lo le me mi tu como más este esta eso esto ha han hay fue era ser desde hasta sobre cuando donde quien si ya muy también puedes podrías propio sino".split(),
    "it": "il lo la gli le di del della dei delle che è non per una un con sono nel nella alla dal dalla anche come più questo questa ma perché quando dove chi cosa essere ha hanno stato dopo prima solo senza già molto suo sua ci si ne tra fra".split(),
    "pt": "o a os as de do da dos das que é não para uma um com são no na nos nas ao à pelo pela também como mais este esta isso mas porque quando onde quem ser tem têm foi depois antes só sem já muito seu sua lhe se entre você nós eles está estão".split(),
    "nl": "de het een van en is niet dat die voor met op aan zijn wordt worden maar ook als bij naar door over uit nog wel geen dit deze waar wat wie hoe waarom wanneer heeft hebben kan kunnen zou moet alleen zonder zo er ik jij wij ons hun".split(),
    "fr": "le la les de des du et est pas que qui pour une un ne dans après puis il elle nous vous sans mais pourquoi comment cela ce cette ces sur avec par au aux se sa son ses leur plus ou où je tu mon ma mes été être sont était a ont faut peux pouvez d'abord n'était donc bien depuis selon quand si".split(),
}
EVERYDAY = frozenset(w for words in FUNCTION_WORDS.values() for w in words)
_OWNER: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_words):
        _OWNER[_w] = (*_OWNER.get(_w, ()), _lang)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SCRIPTS = (
    ("ja", re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ]")),
    ("zh", re.compile(r"[㐀-䶿一-鿿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("th", re.compile(r"[฀-๿]")),
    ("ar", re.compile(r"[؀-ۿݐ-ݿ]")),
    ("ko", re.compile(r"[가-힯]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_OTHER = re.compile(r"[Ѐ-ۿݐ-ݿऀ-ॿ฀-๿぀-ヿ㐀-鿿가-힯ｦ-ﾟ]")


Evidence = dict[str, float]


def evidence(text: str) -> Evidence:
    """Letters of each script's language, and function words (shared ones count in part); sums up over the parts of a text."""
    found: Evidence = {}
    if _OTHER.search(text):
        found = {lang: n / 2 for lang, r in _SCRIPTS if (n := len(r.findall(text)))}
    for w in _WORD.findall(text.lower()):
        owners = _OWNER.get(w)
        if owners:
            for lang in owners:
                found[lang] = found.get(lang, 0) + 1 / len(owners)
    return found


def judged(found: Evidence, margin: float = 1.0) -> tuple[str | None, float]:
    """(language, lead over the next); None where there is too little to go by. Han signs beside kana are Japanese."""
    if "ja" in found and "zh" in found:
        found = {k: v for k, v in found.items() if k != "zh"} | {"ja": found["ja"] + found["zh"]}
    order = sorted(found.items(), key=lambda x: (-x[1], x[0]))
    if not order:
        return None, 0.0
    lead = order[0][1] - (order[1][1] if len(order) > 1 else 0.0)
    return (order[0][0] if lead >= margin else None), lead


def added(parts: list[Evidence]) -> Evidence:
    out: Evidence = {}
    for p in parts:
        for lang, n in p.items():
            out[lang] = out.get(lang, 0) + n
    return out


def scores(text: str) -> Evidence:
    """Evidence for each language, Han signs beside kana as Japanese."""
    found = evidence(text)
    if "ja" in found and "zh" in found:
        found["ja"] += found.pop("zh")
    return found


def guess(text: str, margin: float = 1.0) -> tuple[str | None, float]:
    return judged(evidence(text), margin)


# Names of languages, each in the languages above.
NAMES = {
    "en": "english englisch inglés ingles anglais 英語 英语 英文 अंग्रेज़ी अंग्रेजी",
    "de": "german deutsch alemán aleman allemand ドイツ語 德语 德文 जर्मन",
    "es": "spanish spanisch español espagnol castellano スペイン語 西班牙语 西班牙文 स्पेनिश",
    "fr": "french französisch francés frances français フランス語 法语 法文 फ़्रेंच फ्रेंच",
    "it": "italian italienisch italiano italien イタリア語 意大利语 इतालवी",
    "pt": "portuguese portugiesisch portugués portugais português ポルトガル語 葡萄牙语 पुर्तगाली",
    "nl": "dutch niederländisch neerlandés holandés néerlandais nederlands オランダ語 荷兰语 डच",
    "ja": "japanese japanisch japonés japones japonais 日本語 日语 日文 जापानी",
    "zh": "chinese mandarin chinesisch chino chinois 中国語 中文 汉语 चीनी",
    "hi": "hindi ヒンディー語 印地语 हिंदी हिन्दी",
    "th": "thai thailändisch tailandés thaïlandais タイ語 泰语 थाई",
    "ar": "arabic arabisch árabe arabe アラビア語 阿拉伯语 अरबी",
    "ru": "russian russisch ruso russe ロシア語 俄语 रूसी",
    "ko": "korean koreanisch coreano coréen 韓国語 韩语 कोरियाई",
}
_NAMED = {n: lang for lang, names in NAMES.items() for n in names.split()}
_NAME = re.compile("|".join(rf"(?<![^\W\d_]){re.escape(n)}(?![^\W\d_])" if n.isascii() or n[0] < "ऀ" else re.escape(n) for n in sorted(_NAMED, key=len, reverse=True)), re.I)
# Words that ask for an answer in some form.
_ASKS = re.compile(
    r"\b(?:answer|reply|respond|response|write|written|translate|say it|antwort\w*|schreib\w*|formulier\w*|übersetz\w*|responde\w*|respuesta|contesta\w*|escrib\w*|traduc\w*|répond\w*|réponse|écri\w*|rédige\w*|tradui\w*)\b|回答|回复|答复|用.{0,4}[语文]|写|答え|返答|返信|書い|でお願い|उत्तर|जवाब|लिख",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?。！？।])\s*|\n+")


def asked_for(question: str) -> str | None:
    """The language a question asks its answer to be in, if it does."""
    low = question.lower()
    if not any(n in low for n in _NAMED) or not _NAME.search(question):
        return None
    for s in _SENTENCE.split(question):
        if (m := _NAME.search(s)) and _ASKS.search(s):
            return _NAMED[m[0].lower()]
    return None


def of_question(question: str) -> str | None:
    """The question's language; sentences that ask count three times, since remarks in other languages may stand beside them."""
    total: dict[str, float] = {}
    for s in _SENTENCE.split(question):
        weight = 3 if re.search(r"[?？]|吗|呢|क्या|क्यों|ください", s) else 1
        for lang, n in scores(s).items():
            total[lang] = total.get(lang, 0) + n * weight
    best = sorted(total.items(), key=lambda x: (-x[1], x[0]))
    if not best:
        return None
    return best[0][0] if len(best) == 1 or best[0][1] >= best[1][1] + 1 else None
