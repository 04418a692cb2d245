"""Secret scan: fixed patterns plus a token-efficiency test.

Patterns give the base spans (assignments, access keys, hex digests). The
method adds spans of kind ``random``: long runs of key characters that a
byte-level BPE vocabulary needs many tokens for. Natural words and identifiers
take three and more characters a token, random strings about one and a half;
runs under ``RATIO`` are reported, after digests (hex of a hash's length,
UUIDs) and plain numbers are set aside. Identifiers (words of one case, with or
without separators) have more characters a token, random letters of one case
fewer than prose has; of runs with that form those under ``LETTERS_RATIO`` are
reported. A run that touches a base span is that span's.

Of an address (``@`` or ``://``) only the host is set aside: the dotted name
after ``://`` and the user, or after the ``@`` of a mail address, labels of at
most 63 characters. So a random string that is itself such a label is not
reported. All else is tested: user names, passwords, paths, queries, and the
rest of a text without spaces. Beside an address ``/`` may part a path: a digest
between slashes is set aside by itself, and a run that is not reported whole is
tested again in its parts between slashes.

Defined results: null text has no spans (hash of the empty text); rows may
repeat; an empty table gives no rows; ids and other columns are never read.
Positions are code points, ends exclusive. A text is held whole by one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import held, text_or_empty, workers_ready

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters a token below which a run counts as random, and the shortest run that is tested.
RATIO, SHORTEST = 2.2, 20
#: The same for runs that have the form of identifiers.
LETTERS_RATIO = 1.9

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Access keys, digests and tested runs have 16 characters and more without a space, so only such runs are looked into.
_LONG = re.compile("[^\x20\x09-\x0d]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[_/=+-]*")
#: The host of an address (no last label is as long as SHORTEST), and what may be a digest in a path.
_ASIDE = re.compile(r"(?P<host>(?:(?<=://)(?![\w.~%!$&'()*+,;=:-]*@)|(?<=[A-Za-z0-9._%+-]@))(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,18}(?![A-Za-z0-9_-]))"
                    r"|(?<=/)(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9+_=-])", re.ASCII)
_PART = re.compile(r"[A-Za-z0-9+_=-]{%d,}" % SHORTEST)
_DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)


def encoding(name: str = VOCABULARY):
    """One vocabulary per worker process."""
    def make():
        import public_tokenizers as P
        import tiktoken
        with open(P.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(("encoding", name), make)


def looks_digest(run: str) -> bool:
    return bool(_UUID.fullmatch(run) or len(run) in _DIGEST_CHARS and _DIGEST.fullmatch(run))


def looks_known(run: str) -> bool:
    """Digests and numbers: strings whose form says what they are."""
    return looks_digest(run) or run.isdigit()


def is_random(run: str, enc, ratio: float = RATIO) -> bool:
    """The token-efficiency test."""
    if looks_known(run):
        return False
    if _IDENTIFIER.fullmatch(run):
        ratio = min(ratio, LETTERS_RATIO)
    return len(run) < ratio * len(enc.encode_ordinary(run))


def _merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    for long in _LONG.finditer(text):
        at, run = long.start(), long.group()
        if "AKIA" in run:
            out += [(at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(run) if m.end() - m.start() >= 16]
        if len(run) >= 32:
            out += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(run) if m.end() - m.start() >= 32]
    return out


def _besides_hosts(chunk: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _ASIDE.finditer(chunk):
        if m.lastgroup == "host" or looks_digest(m.group()):
            yield at, m.start()
            at = m.end()
    yield at, len(chunk)


def random_spans(text: str, taken: list[tuple[int, int, str]], enc, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    out = []
    starts, ends = _merged(taken)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)  # the last stretch that begins before b
        return i == 0 or ends[i - 1] <= a

    for long in _LONG.finditer(text):
        if long.end() - long.start() < SHORTEST:
            continue
        at, chunk = long.start(), long.group()
        if "@" not in chunk and "://" not in chunk:
            out += [(at + m.start(), at + m.end(), "random") for m in _RUN.finditer(chunk) if free(at + m.start(), at + m.end()) and is_random(m.group(), enc, ratio)]
            continue
        for lo, hi in _besides_hosts(chunk):
            for m in _RUN.finditer(chunk, lo, hi):
                run = m.group().strip("/")
                a = at + m.start() + m.group().index(run)
                b = a + len(run)
                if len(run) >= SHORTEST and free(a, b) and is_random(run, enc, ratio):
                    out.append((a, b, "random"))
                elif "/" in run:
                    out += [(a + p.start(), a + p.end(), "random") for p in _PART.finditer(run) if free(a + p.start(), a + p.end()) and is_random(p.group(), enc, ratio)]
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", vocabulary=VOCABULARY, ratio=RATIO) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                base = base_spans(t)
                more = random_spans(t, base, enc, ratio)
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, len(more), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    workers_ready(spark)
    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).cast("string").alias("id"), text_or_empty(text).alias("text"))
                .mapInPandas(run, "id string, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
                .select(F.col("id").cast(kind).alias("doc_id"), "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"))
