"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

LENGTH, END = 1024, 2
#: Columns that the operator adds; kept columns of these names are replaced.
_OWN = ("piece", "start", "length", "ids_crc32", "ids", "item", "shard", "sequence_id", "offset")
_CACHE: dict = {}
#: From this many blanks in a row a run is encoded apart: the pattern looks ahead from each of them, and its engine gives up at about a million.
LONG_RUN = 100_000
#: Blanks as the pattern knows them; Python's ``\s`` has four control characters more.
_BLANKS = re.compile(r"[^\S\x1c-\x1f]+")


def tokenizer(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The byte-level vocabulary as an encoder, loaded once per worker; it gives the ids of the JSON form of the same vocabulary."""
    key = (ranks_path, pattern, special)
    if key not in _CACHE:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[key] = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _CACHE[key]


def default_tokenizer() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """Path, pattern and special tokens of the installed public vocabulary of 50,257 ids."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN, (("<|endoftext|>", 50256),)


def token_ids(text: str, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> list[int]:
    """Ids of a text with runs of blanks of any length.

    The pattern makes one piece of a run but for its last blank, which goes with the next word, if one follows. So a long run is
    encoded as one piece by itself, and the texts around it by the pattern.
    """
    enc, ids, at = tokenizer(ranks_path, pattern, special), [], 0
    for run in _BLANKS.finditer(text) if len(text) > LONG_RUN else ():
        if run.end() - run.start() > LONG_RUN:
            whole = run.end() == len(text) or text.startswith(tuple(t for t, _ in special), run.end())
            ids += enc.encode(text[at : run.start()], allowed_special="all")
            at = run.end() - (not whole)
            ids += tokenizer(ranks_path, r"(?s).+", ()).encode(text[run.start() : at])
    return ids + enc.encode(text[at:], allowed_special="all")


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of n tokens: only the first may be shorter than the others."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, keep: list[str], text_col: str = "text", length: int = LENGTH, end: int = END, vocabulary: tuple | None = None, with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` and ``piece, start, length, ids_crc32`` of every piece of every row; with its ``ids`` if wanted.

    Without a ``vocabulary`` each worker looks up the installed one for itself.
    """
    keep = [c for c in keep if c not in _OWN]
    kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = vocabulary or default_tokenizer()
        for b in batches:
            row, out = [], []
            for i, t in enumerate(b.column(0)):
                ids = np.array([*token_ids(t.as_py() or "", *spec), end], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), length)):
                    part = ids[s : s + n]
                    row.append(i)
                    out.append((k, s, n, zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if with_ids else ()))
            take = pa.array(row, pa.int64())
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out), kinds)] if out else [pa.array([], kind) for _, kind in kinds]
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[1:]], *columns], [*keep, *[n for n, _ in kinds]])

    schema = docs.select(*keep).schema.add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())
    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(run, schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    A bin is filled greedily with the largest item that fits. If a gap stays, its smallest item goes back and the two
    unpacked items that together fill the widened gap best take its place, if they fill it better. Items of a length are
    interchangeable, so that the search runs over lengths.
    """
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable")[::-1]:
        waiting[int(lengths[i])].append(int(i))
    sizes = sorted(waiting)
    bins, offsets, b = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def take(n: int) -> int:
        got = waiting[n].pop()
        if not waiting[n]:
            del waiting[n]
            sizes.pop(bisect_right(sizes, n) - 1)
        return got

    while sizes:
        inside, gap = [take(sizes[-1])], 0
        gap = capacity - int(lengths[inside[0]])
        while gap and (k := bisect_right(sizes, gap)):
            inside.append(take(sizes[k - 1]))
            gap -= int(lengths[inside[-1]])
        if gap and len(inside) > 1 and sizes:
            small = int(lengths[inside[-1]])
            room = gap + small
            arr = np.array(sizes[: bisect_right(sizes, room - 1)])
            if len(arr):
                at = np.searchsorted(arr, np.minimum(room - arr, arr), side="right") - 1
                partner = np.where(at >= 0, arr[np.maximum(at, 0)], 0)
                single = np.array([len(waiting[int(n)]) == 1 for n in arr[(partner == arr)]])
                if single.any():
                    own = np.flatnonzero(partner == arr)[single]
                    partner[own] = np.where(at[own] > 0, arr[np.maximum(at[own] - 1, 0)], 0)
                total = np.where(partner > 0, arr + partner, 0)
                best = int(total.argmax())
                if total[best] > small:
                    back = inside.pop()
                    inside += [take(int(arr[best])), take(int(partner[best]))]
                    if small not in waiting:
                        insort(sizes, small)
                    waiting[small].append(back)
        at_token = 0
        for i in inside:
            bins[i], offsets[i] = b, at_token
            at_token += int(lengths[i])
        b += 1
    return bins, offsets


def pack(docs: DataFrame, keep: list[str], text_col: str = "text", length: int = LENGTH, end: int = END, vocabulary: tuple | None = None, shard: int = 20_000, with_ids: bool = False) -> DataFrame:
    """Every piece of every row with ``sequence_id`` and ``offset``.

    A full piece is a sequence of its own. The others are dealt by a hash over shards of about ``shard`` pieces, each packed by
    best-two-fit; a shard ends with at most one loosely filled sequence. Only lengths take part: texts and ids are not
    shuffled. Defined cases: a null or empty text is one piece with the end id alone; repeated rows are packed once per
    row; texts may be of any length, and a run of millions of blanks, letters or signs gives the ids of the pattern; an empty table gives an empty result; kept columns with names of the result are replaced.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cutted = scratch.table(pieces(docs, keep, text_col, length, end, vocabulary, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = cutted.where(F.col("length") == length).select(*[c for c in cutted.columns if c != "item"], (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cutted.where(F.col("length") < length)
    shards = max(1, -(-rest.count() // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), length)
        return pd.DataFrame({"item": pdf["item"], "sequence_id": (bins * shards + pdf["shard"]) * 2 + 1, "offset": offsets})

    dealt = rest.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
    placed = dealt.groupBy("shard").applyInPandas(run, "item long, sequence_id long, offset long")
    placed = rest.join(placed.hint("merge"), "item").select(*full.columns)
    return full.unionByName(placed)
