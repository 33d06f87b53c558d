"""Character profiles of languages, fitted on documents whose language is known.

A profile holds how probable the most frequent runs of three letters of a language are. Fitted on a bounded sample of
labelled documents (``PER_LANGUAGE`` of each language, by the hash of their id), so it costs the same at any size.

Defined results: documents without a two-letter code, text or id are left out; a language with too few documents
has no profile and is never guessed; texts without letters have no language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents to fit on, per language; runs of letters kept per language; documents a language needs.
PER_LANGUAGE, RUNS, LEAST = 2000, 3000, 5
#: Words whose score is kept, and how long they may be.
WORDS, WORD = 100_000, 24
_OTHER = re.compile(r"```.*?(?:```|$)|`[^`\n]+`|https?://\S+|[\W\d_]+", re.S)


def runs(text: str) -> Counter:
    """Runs of three letters, with a blank around words."""
    bare = f" {_OTHER.sub(' ', text.lower())} "
    return Counter(a + b + c for a, b, c in zip(bare, bare[1:], bare[2:], strict=False) if b != " ")


@dataclass
class Profiles:
    languages: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)
    chances: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    #: Scores of words seen before, and the last text with its result; both only save time.
    words: dict[str, np.ndarray] = field(default_factory=dict)
    last: tuple[str, tuple[str | None, float]] = ("", (None, 0.0))

    def _word(self, word: str) -> np.ndarray:
        bare = f" {word} "
        rows = [i for a, b, c in zip(bare, bare[1:], bare[2:], strict=False) if (i := self.rows.get(a + b + c)) is not None]
        return self.chances[rows].sum(0)

    def guess(self, text: str) -> tuple[str | None, float]:
        """(language, lead of its log probability over the next). Runs never go beyond a word, so words are scored once."""
        if text == self.last[0]:
            return self.last[1]
        result: tuple[str | None, float] = (None, 0.0)
        if len(self.languages) > 1:
            total = np.zeros(len(self.languages))
            for w in _OTHER.sub(" ", text.lower()).split():
                score = self.words.get(w)
                if score is None:
                    score = self._word(w)
                    if len(w) <= WORD and len(self.words) < WORDS:
                        self.words[w] = score
                total += score
            if total.any():
                order = np.argsort(total)[::-1]
                result = self.languages[order[0]], float(total[order[0]] - total[order[1]])
        self.last = text, result
        return result


def fitted(counts: list[tuple[str, str, int]]) -> Profiles:
    """Profiles from (language, run, times)."""
    languages, names = sorted({c[0] for c in counts}), sorted({c[1] for c in counts})
    rows, columns = {r: i for i, r in enumerate(names)}, {x: i for i, x in enumerate(languages)}
    table = np.full((len(rows), len(languages)), 0.5)
    for lang, run, n in counts:
        table[rows[run], columns[lang]] += n
    return Profiles(languages, rows, np.log(table / table.sum(0)) if counts else table)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(runs(text))
        rows = [(lang, run, n) for lang, c in seen.items() for run, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "run", "n"])


def learn(documents: DataFrame, per_language: int = PER_LANGUAGE, top: int = RUNS) -> Profiles:
    """Profiles of the languages named in ``documents`` (doc_id, lang, text). At most ``top`` runs of each two-letter code reach the driver."""
    lang = F.nullif(F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2})(?![A-Za-z])", 1)), F.lit(""))
    known = documents.select("doc_id", lang.alias("lang"), "text").where("lang is not null and text is not null and doc_id is not null")
    steps = {r["lang"]: -(-r["count"] // per_language) for r in known.groupBy("lang").count().collect() if r["count"] >= LEAST}
    if not steps:
        return Profiles()
    step = F.create_map(*(F.lit(x) for item in steps.items() for x in item))[F.col("lang")]
    sample = known.where(F.pmod(F.xxhash64("doc_id"), step) == 0).select("lang", "text")
    counted = sample.mapInArrow(_counted, "lang string, run string, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run"))).where(F.col("place") <= top)
    return fitted([(r["lang"], r["run"], r["n"]) for r in ranked.collect()])
