"""Sentence units with their positions, in any language and script.

First pass, unsupervised and over all documents: per language, how often each word stands with and without a
period and what follows it; which words follow sure sentence ends; which words follow a number with a
period. Log-likelihood ratios then give abbreviations, sentence starters and collocations. Second pass: every
mark that may end a sentence is judged with these statistics, by the script around it, by the quotes and
brackets it stands in, and by the layout: blank lines, list items and code blocks bound units by
themselves, a single line break is a space.

Defined results: null, empty and blank texts have no units; a null or odd language is read from the text;
positions count code points of the text as stored, whatever its line ends; unbalanced quotes and brackets
protect nothing; a code fence that isn't closed runs to the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import language
from tracewright.sources.tables import settled, spread

_FENCE = re.compile(r"[ ]{0,3}(```+|~~~+)")
_BULLETS = frozenset("-*•+–‣◦")
_ITEM = re.compile(r"[ \t]*(?:[-*•+–‣◦]|(\d{1,3})[.)、])[ \t\xa0　]+(?=\S)")
_INDENT = re.compile(r"(?: {4}|\t)[ \t]*\S")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_URL = re.compile(r"(?:https?://|www\.)[!-~]*?(?=[.,;:!?]*(?:[\s<>\"')\]]|[^!-~]|$))")
_CODE = re.compile(r"`[^`\n]+`")
_MARK = re.compile(r"(?:\.{2,}|[.!?…。！？।॥؟۔｡])(?:[.!?…。！？؟]|[  \xa0](?=[!?]))*")
_OPEN, _CLOSE = "“«„「『（(【〈《‘", "”»“」』）)】〉》’"
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "〈": "〉", "《": "》"}
_CLOSERS = frozenset("\"”»“」』）)】〉》]'’")
_BRACKET = re.compile(r"[\"“”«»„「」『』（）()【】〈〉《》]")
_FULL = "。！？｡"
_UNCASED = re.compile(r"[֐-ࣿऀ-᫿぀-ヿ㐀-鿿가-힯]")
_THAI = re.compile(r"[฀-๿]")
_KANA = re.compile(r"[぀-ヿ]")
_PARTICLE = re.compile(r"[ぁ-ん]")
#: Letters and digits with the signs that combine with them in Indic, Thai and Arabic writing; runs of them, read without a way back.
_SIGNS = r"ऀ-ःऺ-ॏ॑-ॗॢॣ\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u064b-\u065f\u0670"
_SIGN_SET = frozenset(chr(c) for a, b in ((0x900, 0x903), (0x93A, 0x93B), (0x93C, 0x94F), (0x951, 0x957), (0x962, 0x963), (0xE31, 0xE31), (0xE34, 0xE3A), (0xE47, 0xE4E), (0x64B, 0x65F), (0x670, 0x670)) for c in range(a, b + 1))
_RUN = rf"(?:[^\W_]++|[{_SIGNS}]++)++"
_WORD = re.compile(rf"{_RUN}(?:[.'’-]{_RUN})*+")
#: A word and the sign right behind it that may end a sentence.
_ENDED = re.compile(rf"(?<![^\W_])({_RUN}(?:[.'’-]{_RUN})*+)([.!?…。！？।॥؟])")
_NONE: frozenset[int] = frozenset()
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*$")


# --- layout ---------------------------------------------------------------------------------------


def blocks(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, start of the words behind a list marker, is code) of each block."""
    out: list[tuple[int, int, int, bool]] = []
    at, n = 0, len(text)
    open_at, words_at, last_number, in_list, after_blank = -1, -1, None, False, True
    fence: str | None = None
    code_at, code_kind = -1, ""

    def close(end: int) -> None:
        nonlocal open_at, code_at
        if code_at >= 0:
            out.append((code_at, end, code_at, True))
            code_at = -1
        if open_at >= 0:
            out.append((open_at, end, words_at, False))
            open_at = -1

    plain = "\r" not in text
    while at < n:
        stop = (text.find("\n", at) + 1 or n) if plain else _LINE.match(text, at).end()
        line = text[at:stop]
        bare = line.strip()
        head = bare[:1]
        # Only what can be one is tried as a fence, an indent or an item.
        item = _ITEM.match(line) if head in _BULLETS or head.isdigit() else None
        if fence is not None:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                close(at + len(line.rstrip()))
                fence, after_blank = None, True
        elif head and head in "`~" and (f := _FENCE.match(line)):
            close(at)
            fence, code_at, code_kind, in_list = f[1], at, "fence", False
            if bare.count(fence[0] * 3) > 1 and len(bare) > 6 and bare.endswith(fence):
                close(at + len(line.rstrip()))
                fence = None
        elif not bare:
            close(at)
            after_blank = True
            at = stop
            continue
        elif (code_at >= 0 or after_blank) and line[0] in " \t" and _INDENT.match(line) and not (in_list and item):
            if code_at < 0:
                close(at)
                code_at, code_kind, in_list = at, "indent", False
        else:
            if code_at >= 0:
                close(at)
            number = int(item[1]) if item and item[1] else None
            if item and number is not None and not after_blank and not in_list and number != 1:
                item = None  # a wrapped line that begins with a number
            if item and number is not None and in_list and not after_blank and last_number is not None and number != last_number + 1:
                item = None
            if item:
                close(at)
                open_at, words_at, in_list, last_number = at, at + item.end(), True, number
            elif open_at < 0:
                open_at = words_at = at
                in_list, last_number = False, None
        after_blank = False if fence is not None or bare else after_blank
        at = stop
    close(n)
    trimmed = []
    for a, b, w, code in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            trimmed.append((a, b, max(a, w), code))
    return trimmed


def _blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with blanks in the place of ``spans``, which are in order and apart."""
    parts, at = [], 0
    for a, b, _ in sorted(spans):
        parts += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*parts, text[at:]])


def protected(text: str) -> list[tuple[int, int, str]]:
    """(start, end, closing sign) of quotes and brackets, of links and of code within a block."""
    out = [(m.start(), m.end(), "u") for m in _URL.finditer(text)] if "://" in text or "www." in text else []
    if "`" in text:
        out += [(m.start(), m.end(), "`") for m in _CODE.finditer(_blanked(text, out))]
    free = _blanked(text, out) if out else text
    stack: list[tuple[int, str]] = []
    straight = -1
    for m in _BRACKET.finditer(free):
        c, i = m[0], m.start()
        if c == '"':
            if straight >= 0:
                out.append((straight, i + 1, c))
                straight = -1
            else:
                straight = i
        elif stack and c in stack[-1][1]:
            out.append((stack.pop()[0], i + 1, c))
        elif c in _PAIRS:
            stack.append((i, _PAIRS[c]))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if c in stack[k][1]:
                    out.append((stack[k][0], i + 1, c))
                    del stack[k:]
                    break
    return sorted(out)


# --- the statistics -------------------------------------------------------------------------------


@dataclass
class Statistics:
    """What one language has taught: words by lower case, without their period."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    #: Words that follow a number with a period inside a sentence.
    after_number: frozenset[str] = frozenset()
    #: (abbreviation, word) that belong together even where the word begins sentences elsewhere.
    collocations: frozenset[tuple[str, str]] = frozenset()


@dataclass
class Model:
    by_language: dict[str, Statistics] = field(default_factory=dict)

    def of(self, lang: str | None) -> Statistics:
        return self.by_language.get(lang or "", Statistics())


def language_of(code: str | None, text: str) -> str:
    """Two letters, from the column if it holds them, else from the whole text without code and links."""
    m = re.match(r"\s*([A-Za-z]{2})(?![A-Za-z])", code or "")
    if m:
        return m[1].lower()
    prose = "\n".join(_CODE.sub(" ", _URL.sub(" ", text[words_at:end])) for _, end, words_at, code in blocks(text) if not code)
    return language.guess(prose, 0.5)[0] or "und"


def observe(text: str, seen: Counter, tokens: Counter) -> None:
    """Counts of one text. ``tokens``: what stands between blanks, as written, to be cut into words when it is known how often each occurs. ``seen``: ``p`` a word with a period; ``i`` a period with a word after it that
    is no new sentence by its case; ``f`` a capitalised word behind such a period; ``s`` a word at a sure start; ``d`` a word behind a number
    with a period, ``m`` how many such places. Only words beside marks are looked at one by one."""
    for start, end, words_at, code in blocks(text):
        if code:
            continue
        part = text[words_at:end]
        if "://" in part or "www." in part:
            part = _URL.sub(lambda m: " " * len(m[0]), part)
        if "`" in part:
            part = _CODE.sub(lambda m: " " * len(m[0]), part)
        tokens.update(part.split())
        first = _WORD.search(part)
        if first:
            _begin(first[0], seen)
        for m in _ENDED.finditer(part):
            word, mark, at = m[1], m[2], m.end()
            low = word.lower()
            following = _WORD.search(part, at)
            after = following[0] if following else ""
            # An end is sure after a word of some length, or after another mark.
            if after and (mark != "." or len(word) >= 4 and word.islower() and low.isalpha() or len(word) > 3 and _UNCASED.search(word)):
                _begin(after, seen)
            if mark != "." or part[at : at + 1] == ".":
                continue
            number = low[0].isdigit()
            if after and part[at : at + 1].isspace():
                if number:
                    seen["d", after.lower()] += after[0].isupper()
                    seen["m", ""] += not after[0].isdigit()
                else:
                    seen["p", low] += 1
                    if after[0].islower() or after[0].isdigit():
                        seen["i", low] += 1
                    elif after[0].isupper():
                        seen["f", f"{low}\t{after.lower()}"] += 1
            elif not number:
                seen["p", low] += 1
                seen["i", low] += part[at : at + 1] in (",", ";", ":") and at < len(part)


def _begin(word: str, seen: Counter) -> None:
    if not word[0].isdigit() and (word[0].isupper() or _UNCASED.match(word)):
        seen["s", word.lower()] += 1


SEEN = "lang string, kind string, key string, n bigint"


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all texts of a task: those of ``observe``, and of words ``n`` all, ``a`` a word anywhere, ``c`` with a capital."""

    def out(total: dict[str, tuple[Counter, Counter]]) -> pa.RecordBatch:
        rows = []
        for lang, (seen, tokens) in total.items():
            for token, n in tokens.items():
                for word in _WORD.findall(token):
                    if not word[0].isdigit():
                        low = word.lower()
                        seen["a", low] += n
                        seen["n", ""] += n
                        if word[0].isupper():
                            seen["c", low] += n
            rows += [(lang, kind, key, n) for (kind, key), n in seen.items() if n]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "kind", "key", "n"])

    total: dict[str, tuple[Counter, Counter]] = {}
    for batch in batches:
        for code, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                observe(text, *total.setdefault(language_of(code, text), (Counter(), Counter())))
        if sum(len(a) + len(b) for a, b in total.values()) > 200_000:
            yield out(total)
            total = {}
    yield out(total)


def _term(count, total, p):
    """log-likelihood of ``count`` of ``total`` at rate ``p``."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return count * F.log(q) + (total - count) * F.log(1 - q)


def _together(pair, left, right, total):
    """Log-likelihood ratio of ``right`` behind ``left``, against its own frequency; counts may exceed one another by what they leave out."""
    pair, rest, other = F.least(pair, left, right), F.greatest(right - pair, F.lit(0)), F.greatest(total - left, F.lit(1))
    rest = F.least(rest, other)
    p = right / total
    return 2 * (_term(pair, left, pair / left) + _term(rest, other, rest / other) - _term(pair, left, p) - _term(rest, other, p))


def learn(documents: DataFrame, starter_ratio: float = 30.0, capital_ratio: float = 10.83, abbreviation_score: float = 0.3, collocation_ratio: float = 30.0, least: int = 5) -> Model:
    """Statistics of every language from all texts. Every word seen ``least`` times is judged by its ratios in Spark, in a corpus of
    any size; the words that pass reach the driver."""
    seen = settled(spread(documents.select("lang", "text")).mapInArrow(_observed, SEEN).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    single = seen.where("kind != 'f'").groupBy("lang", "key").pivot("kind", ["n", "m", "p", "i", "s", "a", "c", "d"]).sum("n").na.fill(0)
    single = settled(single.withColumn("w", F.greatest(F.col("a") - F.col("p"), F.lit(0))))
    # Totals by aggregation, not over windows, so that no language's vocabulary meets in one task; a row for each two-letter code.
    words = single.where("key != ''")
    totals = single.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("s").alias("starts"), F.sum("p").alias("periods"))
    places = single.where("key = ''").select("lang", F.greatest("m", F.lit(1)).alias("numbers"))
    totals = totals.join(F.broadcast(places), "lang")
    words = words.drop("n", "m").join(F.broadcast(totals), "lang")
    often = F.col("a") + F.col("p") + F.col("w") >= least
    # Starters: more often at sure starts than their frequency explains.
    all_rate, at_start = F.col("starts") / F.col("total"), F.col("s") / F.greatest(F.col("a"), F.lit(1))
    starter = 2 * (_term(F.col("s"), F.col("a"), at_start) - _term(F.col("s"), F.col("a"), all_rate))
    is_starter = (F.col("s") >= least) & (at_start > all_rate) & (starter >= starter_ratio) & (at_start >= 0.05)
    # A word that has its capital at starts, much more than its capitals explain, begins sentences too.
    capitals, inner, inner_caps = F.col("c") / F.col("a"), F.col("a") - F.col("s"), F.least(F.col("c") - F.col("s"), F.col("a") - F.col("s"))
    capital = 2 * (_term(inner_caps, inner, inner_caps / F.greatest(inner, F.lit(1))) - _term(F.col("s"), F.col("s"), capitals) - _term(inner_caps, inner, capitals))
    is_starter = is_starter | ((F.col("s") >= least) & (F.col("c") >= F.col("s")) & (inner >= F.col("s")) & (inner_caps <= 0.25 * F.col("c")) & (capital >= capital_ratio))
    # Abbreviations: with a period nearly always, short, and what follows goes on.
    both = F.col("p") + F.col("w")
    bound = 2 * (_term(F.col("p"), both, F.lit(0.99)) - _term(F.col("p"), both, F.col("periods") / F.col("total")))
    letters = F.length(F.regexp_replace("key", r"\.", ""))
    inner = F.length("key") - letters + 1
    score = bound * F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -F.col("w").cast("double"))
    # Collocations: more often behind a number than its frequency explains, and than it begins sentences.
    begin_rate = F.col("s") / F.greatest(F.col("starts"), F.lit(1))
    numbered = (F.col("d") >= least) & (F.col("d") / F.col("numbers") > F.greatest(begin_rate, F.col("a") / F.col("total"))) & (_together(F.col("d"), F.col("numbers"), F.col("a"), F.col("total")) >= collocation_ratio)
    keep = words.where(often).select("lang", "key", "p", "w", "i", numbered.alias("numbered"), is_starter.alias("starter"), ((F.col("p") >= least) & (score >= abbreviation_score)).alias("abbreviation")).where("starter or abbreviation or numbered")
    rows = keep.collect()
    starters: dict[str, set[str]] = {}
    for r in rows:
        if r["starter"]:
            starters.setdefault(r["lang"], set()).add(r["key"])
    candidates = {(r["lang"], r["key"]) for r in rows if r["abbreviation"]}
    follow: Counter = Counter()
    joined: dict[str, set[tuple[str, str]]] = {}
    if candidates:
        named = F.split("key", "\t")
        wanted = documents.sparkSession.createDataFrame(sorted(candidates), "lang string, word string")
        pairs = seen.where("kind = 'f'").select("lang", named[0].alias("word"), named[1].alias("next"), "n").join(wanted, ["lang", "word"])
        begun = documents.sparkSession.createDataFrame([(a, b) for a, s in starters.items() for b in sorted(s)] or [("", "")], "lang string, next string")
        for r in pairs.join(begun, ["lang", "next"], "left_anti").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
            follow[r["lang"], r["word"]] = r["n"]
        # Only starters need it: other words behind an abbreviation never begin a sentence.
        often_pair = pairs.where(F.col("n") >= least).join(begun, ["lang", "next"])
        left = words.select("lang", F.col("key").alias("word"), F.col("p").alias("left"))
        right = words.select("lang", F.col("key").alias("next"), "a", "s", "starts", "total")
        bound_pair = (F.col("n") / F.col("left") > F.greatest(begin_rate, F.col("a") / F.col("total"))) & (_together(F.col("n"), F.col("left"), F.col("a"), F.col("total")) >= collocation_ratio)
        for r in often_pair.join(left, ["lang", "word"]).join(right, ["lang", "next"]).where(bound_pair).select("lang", "word", "next").collect():
            joined.setdefault(r["lang"], set()).add((r["word"], r["next"]))
    model = Model()
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        begins = frozenset(starters.get(lang, ()))
        # A word whose periods are followed by words that go on, or by names, in a fair part of all cases.
        short = frozenset(r["key"] for r in own if r["abbreviation"] and r["i"] + follow[lang, r["key"]] >= 0.3 * r["p"])
        number = frozenset(r["key"] for r in own if r["numbered"] and r["key"] not in begins)
        model.by_language[lang] = Statistics(short, begins, number, frozenset(x for x in joined.get(lang, ()) if x[0] in short))
    return model


# --- boundaries -----------------------------------------------------------------------------------


def _first_word(text: str, at: int) -> tuple[str, str]:
    """The first sign that isn't an opening quote or bracket, and the word there."""
    while at < len(text) and (text[at] in _OPEN or text[at] in "\"'¿¡*_[<"):
        at += 1
    m = _WORD.match(text, at)
    return text[at : at + 1], (m[0] if m else "")


def boundaries(text: str, known: Statistics) -> list[int]:
    """Positions in one block of prose after which a new sentence begins."""
    spans = protected(text)
    starts_of, links_end = ({s[0] for s in spans}, {s[1] for s in spans if s[2] == "u"}) if spans else (_NONE, _NONE)
    size = len(text)
    cuts: list[int] = []
    active: list[tuple[int, int, str]] = []
    upto, last_mark, last_start = 0, -1, 0
    for m in _MARK.finditer(text):
        at, end = m.span()
        if end - at == 1 and text[at] == "." and end < size and text[end].isalnum() and not text[at - 1 : at].islower() and at not in links_end:
            continue  # inside a number, a name or the like; nothing below would cut here
        while upto < len(spans) and spans[upto][0] <= at:
            active.append(spans[upto])
            upto += 1
        active = [s for s in active if s[1] > at] if active else active
        # The word before the mark, with its inner periods; what was read for the mark before isn't read again.
        word_at = at
        while word_at > 0:
            c = text[word_at - 1]
            if c.isalnum() or c in _SIGN_SET:
                word_at -= 1
            elif c == "." and word_at < at:
                if word_at - 1 == last_mark:
                    word_at = last_start
                    break
                word_at -= 1
            else:
                break
        last_mark, last_start = at, word_at
        closers = end
        while closers < size and text[closers] in _CLOSERS:
            closers += 1
        covering = active
        shut: list[tuple[int, int, str]] = []
        if covering:
            if any(s[2] in "u`" for s in covering):
                continue
            # Quotes and brackets that end right behind the mark close with it; others hold it.
            if any(s[1] > closers for s in covering) or any(s[0] < at < s[1] and s[1] <= end for s in covering):
                continue
            shut = [s for s in covering if end < s[1] <= closers]
        if closers > end and not shut and any(x in starts_of for x in range(end, closers)):
            closers = end  # what follows opens something new
        if closers >= size:
            continue
        mark = m[0]
        gap = closers
        while gap < size and text[gap].isspace():
            gap += 1
        if gap >= size:
            continue
        spaced = gap > closers
        sign, word = _first_word(text, gap)
        low = word.lower()
        last = mark.rstrip()[-1]
        uncased_next = sign >= "\u0590" and bool(_UNCASED.match(sign))
        quoted = bool(shut) and any(s[2] in "\"”»“」』’" for s in shut)
        if mark not in ".?!" and any(c in _FULL for c in mark):
            if text[gap] in "，、,;；:：。":
                continue
            if quoted and not spaced:
                # Speech behind a colon ends its sentence; a quote that is part of one goes on with a particle or a word.
                opened = min(s[0] for s in shut)
                told = text[:opened].rstrip()[-1:] in ("：", ":")
                if not told and (not _KANA.search(text) or _PARTICLE.match(text, gap)):
                    continue
            cuts.append(closers)
            continue
        prior = "link" if at in links_end else text[max(word_at, cuts[-1] if cuts else 0) : at]
        if not spaced:
            # A missing blank: only where a word ends and a known starter begins.
            follows = text[gap + len(word) : gap + len(word) + 1]
            opens = gap in starts_of and text[gap] in "\"("
            plain = not shut and prior[-1:].islower() and "." not in prior
            if plain and low in known.starters and text[gap : gap + 1] == word[:1] and "." not in word and follows != "(" and (word[:1].isupper() or mark == "." and follows.isspace() and len(prior) > 2):
                cuts.append(closers)
            elif plain and opens:
                cuts.append(closers)
            elif not shut and text[gap] in "¿¡«„“" and prior[-1:].islower():
                cuts.append(closers)
            elif last in "।॥؟۔" or mark in "!?" and uncased_next and _UNCASED.search(prior):
                cuts.append(closers)
            continue
        upper = sign.isupper() or sign.isdigit() or text[gap] in "¿¡`" or bool(text[gap] in _OPEN + "\"<" and not sign.islower())
        starts = low in known.starters or low.split(".")[0] in known.starters
        if shut:
            if quoted and (not upper or uncased_next):
                continue
            if not upper and not starts and not uncased_next:
                continue
            cuts.append(closers)
            continue
        uncased = uncased_next or bool(prior and _UNCASED.search(prior[-1]))
        if mark[0] in "…" or mark.startswith(".."):
            if upper and not sign.isdigit() or uncased_next:
                cuts.append(closers)
            continue
        if mark == ".":
            folded = prior.lower()
            if len(prior) == 1 and prior.isalpha() and not (known.abbreviations and prior.islower() and starts and upper and prior.lower() not in known.abbreviations):
                continue
            if _NUMBER.fullmatch(prior):
                if uncased or sign.isupper() and not (low in known.after_number and not starts):
                    cuts.append(closers)
                elif sign.islower() and starts and len(prior) > 3 or text[gap] in "\"“«¿¡`(":
                    cuts.append(closers)
                continue
            if folded in known.abbreviations or "." in prior and all(len(x) <= 2 for x in prior.split(".")):
                if upper and starts and not sign.isdigit() and (folded, low) not in known.collocations:
                    cuts.append(closers)
                continue
            if uncased or upper and not (sign.isdigit() and len(prior) < 4) or starts:
                cuts.append(closers)
            continue
        if uncased or upper or starts:
            cuts.append(closers)
    if _THAI.search(text):
        held = _blanked(text, _outermost(spans))
        around = starts_of | {s[1] for s in spans}
        cuts += [m.start() for m in re.finditer(r"\s+", text) if held[m.start() - 1 : m.start()] != " " and m.start() not in around and m.end() not in around and _thai_break(text, m.start(), m.end())]
    return sorted(set(cuts))


def _outermost(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _thai_break(text: str, a: int, b: int) -> bool:
    """Whether a blank in Thai text ends a sentence: not beside numbers; links, quotes and brackets are ruled out before."""
    if a == 0 or b >= len(text):
        return False
    left, right = text[a - 1], text[b]
    if left.isdigit() or right.isdigit():
        return False
    return (left.isalpha() or _THAI.match(left) is not None) and (_THAI.match(right) is not None or right.isalpha() and _THAI.match(left) is not None)


def units(text: str | None, known: Statistics) -> list[tuple[int, int]]:
    """(start, end) of every unit, end exclusive, without outer white space; together they cover all but white space."""
    if not text:
        return []
    out = []
    for start, end, words_at, code in blocks(text):
        if code:
            out.append((start, end))
            continue
        at = start
        for cut in [words_at + c for c in boundaries(text[words_at:end], known)] + [end]:
            a, b = at, cut
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            at = cut
    return out


UNITS = "doc_id long, start_char long, end_char long"


def _split(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, code, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                if not text:
                    continue
                for a, b in units(text, model.of(language_of(code, text))):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], ["doc_id", "start_char", "end_char"])

    return run


def sentence_units(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of every unit of every text."""
    # Sent once to each executor, as the words that pass have no upper limit.
    shared = documents.sparkSession.sparkContext.broadcast(model or learn(documents))
    return spread(documents.select("doc_id", "lang", "text")).mapInArrow(_split(shared), UNITS)
