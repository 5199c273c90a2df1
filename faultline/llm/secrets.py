"""Secret scan: fixed patterns, and random strings found by their token efficiency.

A byte-pair vocabulary writes language in few tokens and random strings in many. Runs of 20
characters or more with less than `ratio` characters per token count as secrets, shorter ones of 8
or more with less than a share of it (`SHARES`), after known digests (hexadecimal of a digest's
length, UUIDs), plain numbers, and identifiers whose letters are written in few tokens are taken
out. Rare or foreign words are short of characters per token too, so a run that is written like one, in
letters of one case, counts only if it falls short by several standard errors. Pattern spans stay as they are; a run that overlaps one is not added.

Null and empty texts have no spans. Offsets are code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.vocabulary import byte_pair_encoder

# The patterns of the contract, with the least size of what they find.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a whole run, as runs never touch
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: Words one of which every assignment has, to skip the slower pattern where there is none.
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: (least size, share of `ratio`): short runs of language are near the ratio more often.
SHARES = ((20, 1.0), (16, 0.86), (12, 0.77), (8, 0.64))
_HEX_DIGEST = re.compile(r"[0-9a-fA-F]+\Z")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_NUMBERS = re.compile(r"[0-9+/_=-]+\Z")
#: Letters in parts, each with few digits behind it.
_IDENTIFIER = re.compile(r"[+/_=-]*([A-Za-z]+[0-9]{0,4}([+/_=-]+|\Z))+\Z")
_LETTERS = re.compile(r"[A-Za-z]+")
#: Letters as words have them: of one case, or with a capital in front.
_WORD = re.compile(r"([A-Z]?[a-z]+|[A-Z]+)\Z")
#: Characters a token of unknown words has, by mean and deviation, and how many standard errors a
#: run that looks like a word must stay below them, whatever its size.
WORD_MEAN, WORD_DEVIATION, WORD_ERRORS = 2.6, 1.2, 4.0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_known(run: str) -> bool:
    """A digest or a number, which is no secret."""
    if _HEX_DIGEST.match(run) and len(run) in _DIGEST_SIZES:
        return True
    return bool(_UUID.match(run) or _NUMBERS.match(run))


def is_random(run: str, ratio: float, path: str | None) -> bool:
    """Few characters per token; in an identifier the letters must have few as well."""
    ratio *= next(share for least, share in SHARES if len(run) >= least)
    encode = byte_pair_encoder(path).encode_ordinary
    tokens = len(encode(run))
    if len(run) >= ratio * tokens:
        return False
    if _WORD.match(run):
        return WORD_MEAN * tokens - len(run) >= WORD_ERRORS * WORD_DEVIATION * tokens**0.5
    if not _IDENTIFIER.match(run):
        return True
    parts = _LETTERS.findall(run)
    return sum(map(len, parts)) < ratio * sum(len(encode(p)) for p in parts)


def random_spans(text: str, base: list[tuple[int, int, int]], ratio: float, path: str | None) -> list[tuple[int, int, int]]:
    """Runs with few characters per token that overlap no span of `base`."""
    out = []
    at = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        run = m[0]
        if is_known(run):
            continue
        while at < len(base) and base[at][2] <= start:
            at += 1
        if any(s < end and e > start for s, _, e in base[at:]):
            continue
        if is_random(run, ratio, path):
            out.append((start, 3, end))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_text(text: str, ratio: float, path: str | None = None) -> tuple:
    base = pattern_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    every = sorted(base + random_spans(text, base, ratio, path))
    digest = hashlib.sha256(written(base).encode()).hexdigest()
    return (*counts, len(every) - len(base), digest, written(every), every)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]


def scan(
    docs: DataFrame,
    ratio: float = 2.2,
    vocabulary: str | None = None,
    text: str = "text",
    into: str = "secrets",
    mark: str = "[secret]",
) -> DataFrame:
    """Adds a struct with counts, digest, spans and the redacted text; other columns stay.

    `clean` is null where nothing was found, so that unchanged texts are not copied.
    """
    columns = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_random long, "
                  "base_sha256 string, spans string, clean string")
    def look(column: pd.Series) -> pd.DataFrame:
        rows = []
        for value in column:
            value = value or ""
            *found, spans = scan_text(value, ratio, vocabulary)
            rows.append((*found, redacted(value, spans, mark) if spans else None))
        return pd.DataFrame(rows, columns=[*columns, "clean"])

    return docs.withColumn(into, look(F.col(text)))
