"""Secret scan: fixed patterns and zstandard novelty against primed dictionaries."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns in the order of their kinds: pattern, group whose length counts, least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
KINDS = (*BASE, "novel")
#: Words that make a context sensitive, at the start of a word or of a part of a camel-case one.
_SENSITIVE = re.compile(r"(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(password|passwd|pwd|secret|token|api[ _-]?key|private[ _-]?key|access[ _-]?key|credential|auth|bearer|session[ _-]?id|signature|passphrase)", re.A | re.I)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}", re.A)
#: Identifier vocabulary that primes the compressor: what names, paths and code are made of.
IDENTIFIERS = (
    "get set put add remove delete update create insert select from where order group by join left right inner outer "
    "class def function return import export const let var public private protected static final void int long float double string "
    "boolean true false null none self this super new try catch except finally raise throw async await yield lambda "
    "config configuration settings options parameters environment production development staging test example sample default "
    "username user name email address account client server host port database table column index key value token secret password "
    "authorization authentication bearer basic session cookie header request response status error message content type application json "
    "http https www com org net io api v1 v2 index html css js php path file directory folder home usr local bin etc var tmp log "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef changeme placeholder xxxxxxxxxxxxxxxx your_api_key_here "
).encode()
#: Characters around a candidate that prime the compressor and that are searched for sensitive words.
CONTEXT, NEAR = 400, 60
#: A candidate is novel if it costs this many bytes per character more than its context does.
NOVELTY = 0.80
#: Longer candidates are measured in parts of this length or more: beyond it the compressor learns the key's alphabet.
PART = 128


def _marginal(dictionary: zstandard.ZstdCompressionDict, text: bytes) -> int:
    options = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options).compress(text))


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes per character of a candidate, given the identifier dictionary and the text around it."""
    around = (before + "\n" + after).encode()
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # The same filler on both sides of the difference takes the frame's own bytes out.
    alone, both = _marginal(primed, around[-32:]), _marginal(primed, around[-32:] + candidate.encode())
    return (both - alone) / len(candidate)


def _mixed(s: str) -> bool:
    """Has a digit and a letter; words of letters only are left to the fixed patterns."""
    return bool(re.search(r"[0-9]", s) and re.search(r"[A-Za-z]", s))


def _novel(text: str, words: list[tuple[int, int]], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Novel candidates near sensitive words or near another novel candidate, so that all lines of a key are followed."""
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    tops = np.maximum.accumulate([b for _, b in sorted(covered)]).tolist() if covered else []
    lows = sorted(a for a, _ in covered)

    def span(a: int, b: int) -> tuple[int, int] | None:
        # Words inside the candidate are cheap: what follows the first and the last of them is also measured by itself.
        inner = ends[bisect_right(ends, a) : bisect_left(ends, b)]
        for x in (a, *inner[:1], *inner[1:][-1:]):
            k = bisect_left(lows, b)
            if b - x < 12 or not _mixed(text[x:b]) or (k and tops[k - 1] > x):
                continue
            before, after = text[max(0, x - CONTEXT) : x], text[b : b + CONTEXT]
            parts = max(1, (b - x) // PART)
            cuts = [x + (b - x) * i // parts for i in range(parts + 1)]
            if sum(novelty(text[c:d], before, after) * (d - c) for c, d in zip(cuts, cuts[1:])) >= NOVELTY * (b - x):
                return x, b
        return None

    def near(a: int, b: int) -> bool:
        """A word ends within NEAR characters before the candidate, begins within them after it, or touches it."""
        k = bisect_left(ends, a - NEAR + 1)
        return k < len(words) and starts[k] < b + NEAR

    out = {k: span(*c) if near(*c) else None for k, c in enumerate(found)}
    tried = {k for k, c in enumerate(found) if near(*c)}
    for step in (1, -1):
        edge = None
        for k in range(len(found))[::step]:
            a, b = found[k]
            if k not in tried and edge is not None and (a - edge if step > 0 else edge - b) < NEAR:
                tried.add(k)
                out[k] = span(a, b)
            if out[k]:
                edge = out[k][1] if step > 0 else out[k][0]
    return [x for x in out.values() if x]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start and then kind; base spans always stay."""
    text = text or ""
    spans = [(m.start(), m.end(), kind) for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if len(m.group(group)) >= least]
    words = [w.span() for w in _SENSITIVE.finditer(text)]
    if words:
        spans += [(a, b, "novel") for a, b in _novel(text, words, [x[:2] for x in spans])]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda x: (x[0], order[x[2]]))


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and ``spans``, an array of ``(start, end, kind)`` in code points.

    Candidates are examined whole, near a sensitive word before or after them or near a candidate that was reported.
    Defined cases: null and empty texts have no spans; a candidate that overlaps a base span is not reported again; lines of
    under 12 characters and those without a digit or a letter are no candidates. A kept column ``spans`` is replaced; an empty
    table gives an empty result; repeated rows have equal spans.
    """
    keep = [c for c in keep if c != "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.as_py())] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, kind)], [*keep, "spans"])

    schema = docs.select(*keep).schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])))
    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(run, schema)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in BASE).encode()).hexdigest()
