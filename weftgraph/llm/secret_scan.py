"""Secret scans: fixed patterns plus a token-efficiency test.

Ordinary words cost few tokens per character under a byte-level vocabulary;
random strings cost many. A run of at least ``MIN_RANDOM`` key-like characters
whose characters per token fall below a limit is reported as kind ``random``,
whatever characters it is made of, unless it is a known digest form (hex of a usual
digest length, UUID) or lies inside a span of the fixed patterns. Identifiers
(words of one case and short numbers, joined by ``_ - / + =``) are excluded as a
whole; only a long word of theirs that costs far more tokens than words do
(``MAX_WORD_RATIO`` and ``MAX_LONG_WORD_RATIO``) is reported, by itself. Of a run that passes as a whole, the
parts are tested in the same way: those between separators, and the stretches of
tokens that are shorter than the limit on the whole, so cheap words around a random
string (a path, a key name) do not hide it.

Every text is scanned whole, however long. Null text counts as empty; a text of
equal spans in two kinds lists both, by start and then kind; repeated rows give
repeated results; columns besides id and text are ignored, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_model, text_or_empty, tokenizer_file

# The kinds and patterns of the result contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I | re.A)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
IDENTIFIER = re.compile(r"[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_=-]*")
#: Digest forms inside a longer run.
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{DIGEST.pattern})(?![A-Za-z0-9])", re.I | re.A)
SEPARATORS = "+/_=-"
PART = re.compile(r"[A-Za-z0-9]+")
MIN_RANDOM = 16
#: Characters per token under which a candidate counts as random, and a word of one case.
MAX_RATIO = 2.0
MAX_WORD_RATIO = 1.7
#: From this length on words of one case vary less, and the limit is higher.
LONG_WORD, MAX_LONG_WORD_RATIO = 20, 1.85

def _load(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoding(path: str):
    return one_model(("ranks", path), lambda: _load(path))


def is_random(run: str, enc, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run that is no digest costs too many tokens. A single word of one
    case has to meet the stricter limit; identifiers of several words do not count."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return False
    if IDENTIFIER.fullmatch(run):
        if not run.isalnum():
            return False
        max_ratio = min(max_ratio, MAX_LONG_WORD_RATIO if len(run) >= LONG_WORD else MAX_WORD_RATIO)
    return len(run) < max_ratio * len(enc.encode_ordinary(run))


def dense_stretches(run: str, enc, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """All maximal stretches of tokens by ``max_ratio`` less their length (Ruzzo and Tompa)."""
    held: list[list] = []  # start, end, sum ahead of it, sum with it
    total, at = 0.0, 0
    for token in enc.decode_tokens_bytes(enc.encode_ordinary(run)):
        score = max_ratio - len(token)
        if score > 0:
            new = [at, at + len(token), total, total + score]
            while held:
                k = len(held) - 1
                while k >= 0 and held[k][2] >= new[2]:
                    k -= 1
                if k < 0 or held[k][3] >= new[3]:
                    break
                new = [held[k][0], new[1], held[k][2], new[3]]
                del held[k:]
            held.append(new)
        total += score
        at += len(token)
    return [(h[0], h[1]) for h in held]


def random_parts(run: str, enc, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """The spans of ``run`` that are random by themselves, overlaps merged."""
    if IDENTIFIER.fullmatch(run):
        spans = (m.span() for m in PART.finditer(run))
        return [(s, e) for s, e in spans if e - s >= MIN_RANDOM and is_random(run[s:e], enc, max_ratio)]
    found = []
    edges = [0, *(x for m in KNOWN.finditer(run) for x in m.span()), len(run)]
    for lo, hi in zip(edges[::2], edges[1::2]):
        if hi - lo < MIN_RANDOM:
            continue
        spans = [m.span() for m in PART.finditer(run, lo, hi)]
        for s, e in dense_stretches(run[lo:hi], enc, max_ratio):
            s, e = s + lo, e + lo
            while s < e and run[s] in SEPARATORS:
                s += 1
            while s < e and run[e - 1] in SEPARATORS:
                e -= 1
            left, right = s, e
            while left > lo and run[left - 1] not in SEPARATORS:
                left -= 1
            while right < hi and run[right] not in SEPARATORS:
                right += 1
            spans += [(left, right), (s, e)]
        found += [(s, e) for s, e in set(spans) if e - s >= MIN_RANDOM and is_random(run[s:e], enc, max_ratio)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, code points."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, base: list[tuple[int, int, int]], enc, max_ratio: float = MAX_RATIO):
    added = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if any(bs <= s and e <= be for bs, _, be in base):
            continue
        if is_random(m.group(), enc, max_ratio):
            added.append((s, 3, e))
        elif not DIGEST.fullmatch(m.group()):
            parts = ((s + a, s + b) for a, b in random_parts(m.group(), enc, max_ratio))
            added += [(a, 3, b) for a, b in parts if not any(bs <= a and b <= be for bs, _, be in base)]
    return sorted(base + added)


def _show(spans) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str | None = None,
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    path = ranks_file or tokenizer_file("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            counts, shas, spans = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(_show(base).encode()).hexdigest())
                spans.append(_show(all_spans(text, base, enc, max_ratio)))
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def _redact(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    out.append(text[at:])
    return "".join(out)


def redact(
    docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]",
    ranks_file: str | None = None, max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """The same rows and columns with every span (overlaps merged) replaced by
    ``mask``; ``length_col`` is set to the new length where the text changed.
    Null text stays null."""
    path = ranks_file or tokenizer_file("byte_bpe_50k.tiktoken")
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        enc = _encoding(path)
        out = []
        for t in texts:
            spans = all_spans(t, base_spans(t), enc, max_ratio) if t else ()
            out.append(_redact(t, spans, mask) if spans else t)
        return pd.Series(out, dtype=object)

    new = "__wg_masked"
    out = docs.withColumn(new, masked(F.col(text_col)))
    if length_col and length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        changed = ~F.col(new).eqNullSafe(F.col(text_col))
        out = out.withColumn(length_col, F.when(changed, F.length(new).cast(kind)).otherwise(F.col(length_col)))
    return out.withColumn(text_col, F.col(new)).select(*[F.col(f"`{c}`") for c in docs.columns])
