"""Best-fit packing, certified by dual-feasible-function lower bounds."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsim.llm.util import pick
from procsim.storage import staged

END_ID = 2


#: Characters on which both engines below surely split alike: printable ASCII, Latin letters, common punctuation.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2026\\u20ac]")


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A byte-level BPE file holds each token's bytes. Where merges make tokens of rising ids, which is checked, ids are ranks, and ``tiktoken`` gives
    the ids that ``tokenizers`` gives, five times as fast, on texts of plain characters that hold no added token. All other texts, and all texts
    if the file isn't of that kind, go to ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = tuple(x["content"] for x in spec.get("added_tokens", []))
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        split = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        vocabulary, ids = spec["model"]["vocab"], []
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ids.append(vocabulary.get(left + right, -1))
        if any(a >= b for a, b in zip(ids, ids[1:])) or min(ids, default=-1) < 256:
            return None
        import public_tokenizers
        import tiktoken

        special = {x["content"] for x in spec.get("added_tokens", [])}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not PLAIN.search(text) and not any(x in text for x in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Loaded once in each Python worker."""
    return Encoder(path)


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, turn``: the pieces of each document and a running number of each task."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "turn")], T.StructField("piece", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, end = encoder(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = tokens.encode(text or "") + end
                n, start = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    stop = (n - 1) % capacity + 1 + piece * capacity
                    for column, x in zip(rows, (i, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), turn, piece)):
                        column.append(x)
                    start, turn = stop, turn + 1
            arrays = [pa.array(x, pa.int64()) for x in rows]
            arrays = [batch.column("doc_id").take(arrays[0]), *arrays[1:5], arrays[5].cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: by falling length, each goes to the fullest open bin that has room, else to a new one."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, count = 0, 0  # bit r of room: a bin with r places left is open
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = room >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            at = open_bins[left].pop()
            if not open_bins[left]:
                room ^= 1 << left
        else:
            left, at, count = capacity, count, count + 1
        bins[i], left = at, left - n
        if left:
            open_bins[left].append(at)
            room |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int, kinds: int = 32) -> int:
    """A number of bins that no packing goes below, by dual feasible functions.

    A function f with sum f(x) <= 1 for all x that fit one bin bounds the bins by the sum of f over the items. Tried:
    x itself; x rounded by thresholds e (over 1 - e: 1; under e: 0); and floor((k + 1) x) / k, with x where (k + 1) x is whole.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity, kinds)


def bound_of(held: np.ndarray, capacity: int, kinds: int = 32) -> int:
    """``lower_bound`` of ``held[x]`` items of each length x."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((held * x).sum()) // capacity)
    count, weight = np.cumsum(held), np.cumsum(held * x)
    e = np.arange(1, capacity // 2 + 1)
    rounded = capacity * (count[-1] - count[capacity - e]) + weight[capacity - e] - weight[e - 1]
    best = max(best, int((-(-rounded // capacity)).max(initial=0)))
    for k in range(1, kinds + 1):
        times = (k + 1) * x
        value = np.where(times % capacity == 0, k * x, capacity * (times // capacity))
        best = max(best, -(-int((held * value).sum()) // (k * capacity)))
    return best


def pack_groups(pieces: DataFrame, groups: int, capacity: int, trial: int) -> DataFrame:
    """Pack each group; adds ``sequence_id, offset, filled`` and, alike for a whole group, ``gap``: bins over the certified bound."""
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "filled", "gap")]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "filled", "gap")]])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_group").sort_values(["turn"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends, first = np.cumsum(lengths[order]), np.r_[True, np.diff(bins[order]) != 0]
        base = (ends - lengths[order])[first][np.cumsum(first) - 1]
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - base
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        return rows.assign(
            sequence_id=(trial << 50) + (int(key[0]) << 24) + bins, offset=offset, filled=filled[bins],
            gap=int(bins.max()) + 1 - lower_bound(lengths, capacity),
        )[[f.name for f in schema]]

    keyed = pieces.select(*[f.name for f in fields], F.pmod(F.col("turn"), F.lit(groups)).alias("_group"))
    return keyed.groupBy("_group").applyInPandas(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, group_rows: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as can be.

    A document is its token ids and the end id. Only those over the capacity are cut, from the end, so that
    all pieces but the first are full. Pieces are dealt in turn to groups of about ``group_rows``, each
    packed by best-fit decreasing. Where a group has as many bins as a dual feasible function says it must have,
    it is certified and done. Else its bins that are not full are emptied, and the pieces of all
    such bins are dealt anew and packed again, as long as groups are uncertified and that saves bins. ``packing_report`` tells what gap remains.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Nulls: a null text is empty and gives the end id alone; null and repeated ids stay as they are, each row
    a document of its own. An empty table gives an empty result; further columns are ignored.
    """
    if not 1 <= capacity < 2**20:
        raise ValueError("capacity must be in 1..2^20")
    pieces = staged(cut_into_pieces(pick(docs, doc_id=id_col, text=text_col), tokenizer_path, capacity), "pack-pieces")
    done, trial = [], 0
    packed = staged(pack_groups(pieces, max(1, -(-pieces.count() // group_rows)), capacity, trial), "pack-0")
    while True:
        loose = packed.filter((F.col("gap") > 0) & (F.col("filled") < capacity))
        n, bins = loose.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not n:
            break
        trial += 1
        turned = staged(loose.withColumn("turn", F.pmod(F.xxhash64("turn", F.lit(trial)), F.lit(1 << 40))), f"pack-loose-{trial}")
        again = staged(pack_groups(turned, max(1, -(-n // group_rows)), capacity, trial), f"pack-{trial}")
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= bins:
            break
        done.append(packed.filter((F.col("gap") == 0) | (F.col("filled") == capacity)))
        packed = again
    for part in done:
        packed = packed.unionByName(part)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_report(packed: DataFrame, capacity: int = 1024) -> dict[str, int]:
    """``sequences`` and their certified lower ``bound`` over all pieces: no packing of them has fewer sequences."""
    lengths = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    held = np.zeros(capacity + 1, np.int64)
    for row in lengths:
        held[row["length"]] = row["n"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": bound_of(held, capacity)}
