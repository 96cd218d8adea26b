"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Text that a vocabulary was made for needs few tokens; random letters and
digits need many. In a run of key characters, the parts between separators
that have fewer than ``ratio`` characters per token are its random parts; the run counts
as a secret when these have ``RANDOM_CHARS`` characters or more. Plain words and
names of plain parts have a high ratio and fall out by the test itself. Only
known digests and identifiers are left out before it: hexadecimal strings of the usual
digest lengths, UUIDs, and runs of digits and separators (numbers, dates).

Defined results: null text counts as empty; empty texts have no spans; spans
are code points, end exclusive, over the whole text of any length; equal texts
have equal spans; what a pattern's span covers is not reported again, and what
of a run lies before or after one is a run of its own; an empty table gives an
empty result; extra columns stay.
"""

import base64
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

# The pattern kinds of the contract, in its order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_RE = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
ACCESS_RE = re.compile(ACCESS)
HEX_RE = re.compile(r"[0-9a-f]{32,}")
#: What a text must contain for the patterns to be run on it.
MAY_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']? *[:=]"""
MAY_HEX = r"[0-9a-f]{32}"
MAY_RANDOM = r"[A-Za-z0-9+/_=-]{20}"

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_RUN = 20
RATIO = 2.0
RANDOM_CHARS = 16
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9_/=+-]+")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
PARTS = re.compile(r"[A-Za-z0-9]+")


@lru_cache(maxsize=2)
def encoding(path, pattern):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known(run):
    """Whether a run is a digest, a UUID or made of digits and separators only."""
    digest = len(run) in DIGEST_LENGTHS and HEXADECIMAL.fullmatch(run)
    return bool(digest or UUID.fullmatch(run) or NUMBER.fullmatch(run))


def random_part(run, vocab, ratio=RATIO):
    """Start and end within a run from its first to its last random part; None if these are too short."""
    found = []
    for m in PARTS.finditer(run):
        part = m.group()
        if not part.isdigit() and len(part) < ratio * len(vocab.encode_ordinary(part)):
            found.append(m)
    if sum(m.end() - m.start() for m in found) < RANDOM_CHARS:
        return None
    return found[0].start(), found[-1].end()


def random_runs(text, vocab, covered=(), ratio=RATIO):
    """Spans of random strings outside the covered spans (sorted, by start)."""
    at, n = 0, len(covered)
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < n and covered[at][1] <= start:
            at += 1
        pieces, k = [], at
        while k < n and covered[k][0] < end:
            pieces.append((start, covered[k][0]))
            start = max(start, covered[k][1])
            k += 1
        for a, b in [*pieces, (start, end)]:
            if b - a >= LEAST_RUN and not known(text[a:b]):
                span = random_part(text[a:b], vocab, ratio)
                if span:
                    yield a + span[0], a + span[1]


def merged(spans):
    """Sorted disjoint spans that cover the same."""
    out = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(text, vocab, may=(True, True, True, True), ratio=RATIO):
    """All spans as (start, kind number, end), in order."""
    found = []
    if may[0]:
        found += [(m.start(), 0, m.end()) for m in ASSIGN_RE.finditer(text) if len(m.group(2)) >= 8]
    if may[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS_RE.finditer(text) if len(m.group()) >= 16]
    if may[2]:
        found += [(m.start(), 2, m.end()) for m in HEX_RE.finditer(text)]
    if may[3]:
        found += [(a, 3, b) for a, b in random_runs(text, vocab, merged(found), ratio)]
    return sorted(found)


def scan(df, vocab_path, pattern, text_col="text", out_col="secrets", ratio=RATIO):
    """Add the spans of every whole text: array of (kind, start, end), by start and then kind."""

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def find(text: pa.Array) -> pa.Array:
        vocab = encoding(vocab_path, pattern)
        text = pc.fill_null(text, "")
        tests = (
            pc.match_substring_regex(text, MAY_ASSIGN, ignore_case=True), pc.match_substring(text, "AKIA"),
            pc.match_substring_regex(text, MAY_HEX), pc.match_substring_regex(text, MAY_RANDOM),
        )
        rows = []
        for i, may in enumerate(zip(*(t.to_pylist() for t in tests))):
            found = spans_of(text[i].as_py(), vocab, may, ratio) if any(may) else []
            rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return df.withColumn(out_col, find(F.col(text_col)))
