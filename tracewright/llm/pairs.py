"""Defective answers among prompt and response pairs.

For each of five defects a few noisy labelling functions vote on every (question, answer) pair, for it, against it or
not at all; none knows what another found. A label model per defect (``labelmodel``), fitted by expectation maximisation,
turns the votes into posteriors. Half of the pairs, by a hash, are for fitting. The other half validates the
cutoffs: of each of its pairs a copy is made defective in a known way, and the cutoff is the one that keeps most of these
for the fewest pairs taken. A pair keeps every defect whose posterior reaches its cutoff; ``defect_type`` is the first of
them in the order of ``ORDER``.

All votes of a pair are the digits of one number; the models see only counts of vote patterns, at most 3**4 for
each defect, and posteriors are looked up in arrays of 4**4, so nothing is joined.

Defined results: a null answer is empty; a null or blank question leaves out ``copied`` and
``wrong_language`` but nothing else; rows that occur twice are judged twice; null call arrays have no
pairs; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import endings, language
from tracewright.llm.labelmodel import ABSTAIN, NO, YES, LabelModel
from tracewright.llm.profiles import Profiles, learn
from tracewright.sources.tables import settled, spread

_WORDS = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_HAS = re.compile(r"[^\W_]")
# How speakers of these languages decline, in lower case.
_DECLINES = re.compile(
    r"\b(?:"
    r"(?:can(?:'|’)?t|cannot|can not|could not|couldn't|unable to|not able to|(?:won(?:'|’)?t|will not)(?: be able to)?|not (?:permitted|allowed) to|not going to) (?:to )?(?:help|assist|answer|respond|provide|share|discuss|comply|do (?:that|this)|support|fulfil\w*|engage|go into|give|comment)"
    r"|(?:must|have to|need to|will) (?:decline|refuse)\b|i (?:decline|refuse)\b|rather not\b|something i (?:won(?:'|’)?t|can(?:'|’)?t|cannot|will not) (?:do|help)|not be appropriate for me|beyond what i am (?:permitted|allowed|able)|against my (?:rules|guidelines|policy)"
    r"|no puedo (?:ayudar|responder|asistir|hacer|dar|facilitar|compartir)|no me está permitido|debo (?:rechazar|declinar)|no estoy autorizad|prefiero no|me niego"
    r"|muss ich (?:leider )?(?:ablehnen|verweigern|absagen)|ablehnen müssen|kann ich (?:leider )?nicht (?:helfen|beantworten|weiterhelfen|dienen)|keine auskunft|darf ich (?:leider )?(?:nicht|keine)|(?:anfrage|bitte) (?:leider )?(?:muss ich )?ablehnen|kann (?:ihnen|dir) (?:dabei |hierbei )?nicht helfen|möchte ich (?:lieber )?nicht"
    r"|ne (?:peux|puis) pas (?:vous |t'|te )?(?:aider|répondre|fournir|donner|faire)|dois (?:refuser|décliner)|ne suis pas (?:autorisée?|en mesure)|préfère ne pas|refuser cette demande|il ne m'est pas permis|m'est impossible de"
    r")"
)
_DECLINES_CJK = re.compile(
    r"不能(?:回答|帮|协助|提供|处理)|无法(?:回答|帮|协助|提供|处理|满足)|必须拒绝|不便(?:回答|透露)|不允许(?:我)?(?:回答|讨论)|恕难|拒绝(?:回答|这|该|此)"
    r"|(?:お応え|お答え|お手伝い|対応|回答|ご案内|お受け)(?:は|を|が)?(?:いたしかね|でき(?:ません|ない|かね)|しかね|することができません|控え|できません)|お断り|お答えを控え|差し控え|お応えできません|応じられません"
)
_DECLINES_DEVA = re.compile(r"अस्वीकार करना|मदद नहीं कर|सहायता नहीं कर|उत्तर नहीं दे|जवाब नहीं दे|जानकारी नहीं दे|अनुमति नहीं|मना करना|इनकार करन")
_DEVA = re.compile(r"[ऀ-ॿ]")
_APOLOGY = re.compile(
    r"\b(?:sorry|apologi[sz]e|unfortunately|regret|afraid|thanks for asking|lo siento|lamentablemente|lamento|disculpa|perdón|desafortunadamente|tut mir leid|leider|bedauer\w*|entschuldig\w*|désolée?|malheureusement|regrette|navrée?)\b|抱歉|遗憾|对不起|申し訳|恐れ入り|残念|あいにく|क्षमा|माफ़|माफ|खेद|दुर्भाग्य",
    re.I,
)
_SOLID = re.compile(r"\d|https?://|`|\n\s*(?:[-*•]|\d+[.)])\s")
_QUOTE_HEAD = re.compile(r"^\W*(?:re|aw|question|you (?:asked|wrote|said)|frage|du fragtest|pregunta|preguntaste|votre question|vous avez demandé|question posée|问题|你问|質問|ご質問|प्रश्न|आपने पूछा)\s*[:：]\s*", re.I)

#: The labelling functions of each defect, in the order of their digits.
FUNCTIONS = {
    "empty": ("no_letters", "stand_in", "tiny"),
    "copied": ("in_question", "covers_question", "ends_in_question", "long_run"),
    "refusal": ("declines", "apologises", "nothing_solid", "off_topic"),
    "truncated": ("no_end", "marked", "at_cap", "half_word"),
    "wrong_language": ("other_script", "other_words", "other_sentences", "other_letters"),
}
ORDER = tuple(FUNCTIONS)
#: Two bits a function; each defect takes eight.
WIDTH = 8
_SCRIPT = {"zh": "han", "ja": "kana", "hi": "deva", "th": "thai", "ar": "arab", "ko": "hang", "ru": "cyrl"}
_FIRST = re.compile(r"[.!?。！？।]|\n")
_LONG = re.compile(r"[^\W\d_]{4,}|\d{2,}")


def _grams(text: str) -> list[str]:
    """Words, and single characters where a script has no blanks."""
    words = _WORDS.findall(text.lower())
    if not _CJK.search(text):
        return words
    out: list[str] = []
    for w in words:
        out.extend(w) if _CJK.search(w) else out.append(w)
    return out


def _shingles(grams: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(grams[i:] for i in range(n)), strict=False))


def _topics(text: str) -> set[str]:
    """Longer words that aren't everyday ones, and numbers; pairs of signs where a script has no blanks."""
    words = _LONG.findall(text.lower())
    if not _CJK.search(text):
        return {w for w in words if w not in language.EVERYDAY}
    out: set[str] = set()
    for w in words:
        if _CJK.search(w):
            out.update(w[i : i + 2] for i in range(len(w) - 1))
        elif w not in language.EVERYDAY:
            out.add(w)
    return out


def _overlap(question: list[str], answer: str) -> list[int]:
    """Next to nothing that the question lacks; most of the question; an end that is in it; a run of it that makes up most of the answer."""
    bare = _grams(_QUOTE_HEAD.sub("", answer))
    if len(bare) < 2 or len(question) < 2:
        return [ABSTAIN] * 4
    n = min(5 if _CJK.search(answer) else 2, len(bare), len(question))
    asked, own = set(_shingles(question, n)), _shingles(bare, n)
    there = [x in asked for x in own]
    run = longest = 0
    for x in there:
        run = run + 1 if x else 0
        longest = max(longest, run)
    return [sum(there) >= 0.9 * len(own), len(asked.intersection(own)) >= 0.6 * len(asked), all(there[-3:]), longest >= 0.8 * len(own)]


def _declines(text: str) -> bool:
    low = text.lower()
    return bool(_DECLINES.search(low) or _CJK.search(low) and _DECLINES_CJK.search(low) or _DEVA.search(low) and _DECLINES_DEVA.search(low))


class Question:
    """What is read of a question once for all its answers."""

    def __init__(self, text: str | None, profiles: Profiles):
        self.text = text if text and text.strip() else None
        self.language = (language.asked_for(self.text) or language.of_question(self.text) or profiles.guess(self.text)[0]) if self.text else None
        self.words = _grams(self.text) if self.text else []
        self.topics = _topics(self.text) if self.text else set()


def votes(question: Question, answer: str | None, cap: int, profiles: Profiles) -> int:
    """All votes on one answer as one number."""
    text = answer or ""
    held = endings.core(text)
    few = sum(1 for _ in zip(range(7), _HAS.finditer(held), strict=False)) <= 6
    out = {"empty": [not held, bool(held and held.lower() in endings.STAND_INS) if held else ABSTAIN, few]}
    out["copied"] = _overlap(question.words, text) if question.text else [ABSTAIN] * 4
    if held:
        first = text.lstrip()
        start = _FIRST.search(first)
        out["refusal"] = [_declines(text), bool(_APOLOGY.search(first[: start.start()] if start else first)), not _SOLID.search(text), question.topics.isdisjoint(_topics(text)) if question.text else ABSTAIN]
    else:
        out["refusal"] = [NO, NO, ABSTAIN, ABSTAIN]
    end = endings.ending(text)
    last = text.rstrip()[-1:]
    out["truncated"] = [ABSTAIN] * 4 if end == endings.NOTHING else [end in (endings.OPEN, endings.MARKED), end == endings.MARKED, len(text) >= cap, last in ",;、，" or unicodedata.category(last)[0] in "LMN"]
    if held and question.language:
        expected = question.language
        each = [language.evidence(s) for s in language._SENTENCE.split(text)]
        found, lead = language.judged(language.added(each), 0.5)
        parts = [p for e in each if (p := language.judged(e, 0.5)[0])]
        letters, sure = profiles.guess(text)
        out["wrong_language"] = [
            ABSTAIN if found is None else _SCRIPT.get(found) != _SCRIPT.get(expected),
            ABSTAIN if found is None or found != expected and lead < 1.5 else found != expected,
            expected not in parts if parts else ABSTAIN,
            letters != expected if expected in profiles.languages and sure >= 5.0 else ABSTAIN,
        ]
    else:
        out["wrong_language"] = [ABSTAIN] * 4
    return sum(int(v) << WIDTH * d + 2 * i for d, name in enumerate(ORDER) for i, v in enumerate(out[name]))


# Openings and refusals to plant, in the languages of the lists above.
_PLANTED_REFUSALS = {
    "en": (("", "I am sorry, but ", "Unfortunately, "), ("I cannot answer that.", "I have to decline this one.", "I will not discuss this here.")),
    "de": (("", "Leider: ", "Es tut mir leid, "), ("dabei kann ich nicht helfen.", "das muss ich ablehnen.", "dazu darf ich keine Auskunft geben.")),
    "es": (("", "Lo siento, pero ", "Lamentablemente "), ("no puedo responder a eso.", "debo declinar esta solicitud.")),
    "fr": (("", "Désolé, ", "Malheureusement, "), ("je ne peux pas vous aider.", "je dois refuser.")),
    "zh": (("", "抱歉，", "很遗憾，"), ("我无法回答这个问题。", "我必须拒绝。")),
    "ja": (("", "申し訳ありませんが、", "残念ながら"), ("お答えできません。", "お手伝いできません。")),
    "hi": (("", "क्षमा करें, ", "खेद है, "), ("मैं इसमें मदद नहीं कर सकता।", "मुझे मना करना होगा।")),
}
_PLANTED_NOTHING = ("", "  ", "n/a", "...", "```\n```", "null", "-", "None", "\n\n", "(no response)")
_PLANTED_MARKS = ("…", " [truncated]", "...[cut]", "\ufffd")
_INNER = re.compile(r"[^\W_]{2}(?=[^\W_]{2})")


def plant(kind: str, question: Question, answer: str, donors: dict[str, str], cap: int, draw: int) -> str | None:
    """``answer`` made defective in one way, or None where that can't be done with it."""
    if kind == "empty":
        return _PLANTED_NOTHING[draw % len(_PLANTED_NOTHING)]
    if kind == "copied":
        return (None if len(question.words) < 2 else (question.text, question.text.lower(), f"Re: {question.text}", f"> {question.text}", f"{question.text} {question.text}")[draw % 5])
    if kind == "refusal":
        openings, said = _PLANTED_REFUSALS.get(question.language or "en", _PLANTED_REFUSALS["en"])
        return openings[draw % len(openings)] + said[draw // len(openings) % len(said)]
    if kind == "truncated":
        if endings.ending(answer) != endings.COMPLETE:
            return None
        if draw % 3 == 0 and len(answer) > 1:
            return (answer + " ") * (cap // len(answer) + 1) if len(answer) >= cap else ((answer + " ") * (cap // len(answer) + 1))[:cap]
        places = [m.end() for m in _INNER.finditer(answer)]
        mark = _PLANTED_MARKS[draw // 7 % len(_PLANTED_MARKS)] if draw % 3 == 1 else ""
        return answer[: places[draw % len(places)]] + mark if places else None
    others = sorted(x for x in donors if x != question.language)
    return donors[others[draw % len(others)]] if question.language and others else None


VOTES = "record_id long, answer_field string, call_no long, mask long, held_out int, planted int"


def _vote(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, donors = shared.value, {}
        for batch in batches:
            out: list[tuple] = []
            for record, text, response, thoughts in zip(*(batch.column(c).to_pylist() for c in ("record_id", "question", "response", "thoughts")), strict=True):
                question = Question(text, profiles)
                for call, answer in [(-1, response), *enumerate(thoughts or ())]:
                    cap, place = (1000 if call >= 0 else 500), ("cot_reasoning" if call >= 0 else "final_response")
                    draw = zlib.crc32(f"{record}/{call}/{answer}".encode("utf-8", "replace"))
                    held = draw & 1
                    out.append((record, place, call, votes(question, answer, cap, profiles), held, -1))
                    if held and answer:
                        kind = (draw >> 1) % len(ORDER)
                        made = plant(ORDER[kind], question, answer, donors, cap, draw >> 4)
                        if made is not None:
                            out.append((None, place, call, votes(question, made, cap, profiles), 1, kind))
                        tongue, lead = profiles.guess(answer) if profiles.languages else language.guess(answer, 0.5)
                        if tongue and lead >= 5.0:
                            donors[tongue] = answer
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["record_id", "answer_field", "call_no", "mask", "held_out", "planted"])

    return run


def vote_table(journals: DataFrame, profiles: Profiles) -> DataFrame:
    """The votes on every pair of the sealed rows, with ``planted`` -1, and those on the planted ones."""
    pairs = journals.where("sealed").select("record_id", F.col("user_message").alias("question"), F.col("final_response").alias("response"), F.col("model_calls.cot_reasoning").alias("thoughts"))
    return spread(pairs).mapInArrow(_vote(journals.sparkSession.sparkContext.broadcast(profiles)), VOTES)


def _digits(patterns: np.ndarray, defect: str) -> np.ndarray:
    return (patterns[:, None] >> (2 * np.arange(len(FUNCTIONS[defect])))) & 3


def fit_models(counts: list[tuple[int, int, int, int, int]]) -> dict[str, LabelModel]:
    """A model per defect from (defect, pattern, held_out, planted, count)."""
    rows = np.array(counts, np.int64).reshape(-1, 5)
    out = {}
    for d, name in enumerate(ORDER):
        own = rows[rows[:, 0] == d]
        fit, held, made = own[own[:, 2] == 0], own[(own[:, 2] == 1) & (own[:, 3] < 0)], own[own[:, 3] == d]
        model = LabelModel(len(FUNCTIONS[name])).fit(_digits(fit[:, 1], name), fit[:, 4])
        out[name] = model.validate(_digits(made[:, 1], name), made[:, 4], _digits(held[:, 1], name), held[:, 4])
    return out


def _pattern(defect: int):
    return F.shiftright("mask", WIDTH * defect).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def models(voted: DataFrame) -> dict[str, LabelModel]:
    """The fitted and validated models; reads ``voted`` once and brings at most 5 x 81 x 7 counts to the driver."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), _pattern(d).alias("pattern")) for d in range(len(ORDER))))).alias("x")
    counted = voted.groupBy("mask", "held_out", "planted").count().select("held_out", "planted", "count", each).groupBy("x.defect", "x.pattern", "held_out", "planted").agg(F.sum("count").alias("n"))
    return fit_models([(r["defect"], r["pattern"], r["held_out"], r["planted"], r["n"]) for r in counted.collect()])


def posteriors(voted: DataFrame) -> DataFrame:
    """Every pair with ``p_<defect>`` and ``defects`` (all that reach their cutoffs, in the order of ``ORDER``).

    Reads ``voted`` twice, so it should be settled.
    """
    known = models(voted)
    every = np.arange(1 << WIDTH)
    tables = {d: known[d].posterior(_digits(every, d)) for d in ORDER}
    chance = {d: F.element_at(F.array(*(F.lit(float(x)) for x in tables[d])), _pattern(i) + 1) for i, d in enumerate(ORDER)}
    rows = voted.where("planted < 0").select("record_id", "answer_field", "call_no", *(chance[d].alias(f"p_{d}") for d in ORDER))
    kept = F.filter(F.array(*(F.when(F.col(f"p_{d}") >= known[d].cutoff, d) for d in ORDER)), lambda x: x.isNotNull())
    return rows.withColumn("defects", kept)


def defective_pairs(journals: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per defective pair with all its defects, their posteriors and the first one.

    documents: texts of known language to fit character profiles on; without them that function abstains.
    """
    profiles = Profiles() if documents is None else learn(documents)
    return posteriors(settled(vote_table(journals, profiles))).where(F.size("defects") > 0).withColumn("defect_type", F.col("defects")[0])
