"""Quality rules by tokeniser fertility.

A public vocabulary is a mirror of ordinary prose: text it cuts into many small pieces,
spells out in bytes, or covers with few different pieces is not prose. Characters per
token, the share of byte-fallback tokens and the entropy of the tokens are held against
bands for the text's language or, where that is unknown, for its script. Counting rules for
short and repetitive texts come before.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import add_text_columns, read, window_hashes, word_hashes


@dataclass(frozen=True)
class Band:
    """What is kept: chars_per_token within [low, high], byte_share up to most, entropy (bits) from least, less what a sample falls short."""

    low: float
    high: float
    most_bytes: float
    least_entropy: float


#: Languages whose prose was measured: the lower bounds lie near the 1st percentile of long
#: labelled training documents; the upper ones are those of the script.
LANGUAGE_BANDS = {
    "en": Band(2.42, 8.0, 0.20, 6.75),
    "fr": Band(2.17, 8.0, 0.20, 6.75),
    "de": Band(2.42, 8.0, 0.20, 6.75),
    "es": Band(2.14, 8.0, 0.20, 6.75),
}
#: By the script of most letters, for other languages. A vocabulary without a script's
#: characters spells them in bytes, three or more tokens a character.
SCRIPT_BANDS = {
    "latin": Band(1.5, 8.0, 0.20, 5.8),
    "cyrillic": Band(1.2, 8.0, 0.30, 5.8),
    "greek": Band(0.6, 8.0, 0.50, 5.0),
    "other": Band(0.2, 8.0, 0.95, 4.5),
}
_SCRIPT_STARTS = np.array([0, 0x250, 0x370, 0x400, 0x530])
_SCRIPT_NAMES = ("latin", "other", "greek", "cyrillic", "other")

#: A mean over n tokens is uncertain by about this over the square root of n: bands of
#: characters per token widen by as much.
SLACK = 4.0
#: The entropy of a sample of n tokens falls short by about this over the square root of n.
ENTROPY_SLACK = 17.0

MIN_WORDS = 50
MOST_REPEATED = 50  # percent of words
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_CHUNK = 64


def vocabulary_path() -> str:
    """The default vocabulary's file, as the machine's package of public tokenizers names it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def script_of(text: str) -> str:
    """The script of most letters, by Unicode blocks; ``other`` without a letter."""
    codes = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return "other"
    counts = np.bincount(np.searchsorted(_SCRIPT_STARTS, codes, side="right") - 1, minlength=5)
    return _SCRIPT_NAMES[int(counts.argmax())]


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in _SPACES)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeated = 0
    if n >= 3:
        _, at, times = np.unique(window_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
        again = times[at] > 1
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : i + len(again)] |= again
        repeated = int(inside.sum())
    return n, word_chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double"


class Meter:
    """Tokenises and judges; loads the vocabulary once in each Python worker."""

    def __init__(self, path: str, languages: dict[str, Band], scripts: dict[str, Band]):
        import sentencepiece

        self.languages, self.scripts = languages, scripts
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        for white in _SPACES:  # a line feed is spelled in bytes but says nothing
            self.is_byte[self.model.piece_to_id(f"<0x{ord(white):02X}>")] = False

    def fertility(self, text: str, ids: list[int]) -> tuple[float, float, float]:
        if not ids:
            return 0.0, 0.0, 0.0
        found, times = np.unique(np.array(ids), return_counts=True)
        share = times / len(ids)
        return len(text) / len(ids), float(share[self.is_byte[found]].sum()), float(-(share * np.log2(share)).sum())

    def judge(self, texts: list[str | None], langs: list[str | None]):
        rows = []
        for at in range(0, len(texts), _CHUNK):
            some = [t or "" for t in texts[at : at + _CHUNK]]
            for text, lang, ids in zip(some, langs[at : at + _CHUNK], self.model.encode(some, num_threads=1), strict=True):
                base = counts(text)
                failed = base[0] < MIN_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
                per, bytes_, entropy = self.fertility(text, ids)
                kept = False
                if not failed:
                    band = self.languages.get(lang) or self.scripts[script_of(text)]
                    slack, short = SLACK / len(ids) ** 0.5, ENTROPY_SLACK / len(ids) ** 0.5
                    kept = band.low - slack <= per <= band.high + slack and bytes_ <= band.most_bytes and entropy >= band.least_entropy - short
                rows.append((*base, failed, kept, per, bytes_, entropy))
        return list(zip(*rows, strict=True)) or [[]] * 10


def fertility_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", *, path: str | None = None, language_bands: dict[str, Band] = LANGUAGE_BANDS, script_bands: dict[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the three fertility measures of every row.

    A null text counts as empty: no words, so base_failed. Texts of any length are read and
    tokenised whole, in pieces of a batch at a time. A null or unlisted language is judged
    by script. ``path`` is the vocabulary's file, the same on every executor; a missing one
    is an error before anything runs. Repeated rows are each answered; other columns are not read.
    """
    path = path or vocabulary_path()
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}; it must stand there on every machine")
    joined = F.concat(F.coalesce(F.col(lang), F.lit("")) if lang else F.lit(""), F.lit("\x00"), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), joined.alias("t"))

    def make():
        meter = Meter(path, language_bands, script_bands)

        def apply(joined: list[str]):
            pairs = [j.split("\x00", 1) for j in joined]
            return meter.judge([p[1] for p in pairs], [p[0] for p in pairs])

        return apply

    return add_text_columns(rows, "t", make, RESULT)


def op5_token_fertility(spark, sf_dir: str) -> DataFrame:
    """Counts, verdicts and fertility measures of every document."""
    return fertility_rules(read(spark, sf_dir, "documents"))
