"""Overlaps of all pairs of models, block by block: no row a pair is ever shuffled or staged (behind O-54 to O-56, O-65)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsim.storage import staged

BLOCK = 4096  # models a block, at most
LANES = 1024  # tokens multiplied at a time
MATCHES = 1 << 21  # matches of rare tokens listed at a time
ROWS = 1 << 19  # pairs a batch, about
CODES = 1 << 62  # numbers of a pair that are counted as one number
BITS = 52  # places told by one number, exact as a double
CODED = 1 << 14  # pairs a message of coded rows, about


@dataclass(frozen=True)
class AllPairs:
    """All pairs ``model_a < model_b`` of the distinct ``model_id`` of ``models``, which are not listed anywhere."""

    models: DataFrame


class Sets:
    """Sets of distinct numbers, one after the other."""

    def __init__(self, lists: pa.ListArray):
        self.count, self.number = len(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(self.count), self.size)


def common(a: Sets, b: Sets) -> np.ndarray:
    """The number of common members of each set of ``a`` with each of ``b``.

    A token of many sets on both sides is a column of a matrix product; the matches of the others are listed and counted, some at a time.
    """
    own_a, at_a = np.unique(a.number, return_inverse=True)
    own_b, at_b = np.unique(b.number, return_inverse=True)
    both, in_a, in_b = np.intersect1d(own_a, own_b, assume_unique=True, return_indices=True)
    exact = np.float32 if max(a.size.max(initial=0), b.size.max(initial=0)) < 1 << 24 else np.float64
    out = np.zeros((a.count, b.count), exact)
    place_a, place_b = np.full(len(own_a), -1), np.full(len(own_b), -1)
    place_a[in_a] = place_b[in_b] = np.arange(len(both))
    token_a, token_b = place_a[at_a], place_b[at_b]
    row_a, token_a = a.row[token_a >= 0], token_a[token_a >= 0]
    row_b, token_b = b.row[token_b >= 0], token_b[token_b >= 0]
    many_a, many_b = np.bincount(token_a, minlength=len(both)), np.bincount(token_b, minlength=len(both))
    often = 64 * many_a * many_b >= a.count * b.count
    lane = np.where(often, np.cumsum(often) - 1, -1)
    for low in range(0, int(often.sum()), LANES):
        sides = []
        for row, token, count in ((row_a, token_a, a.count), (row_b, token_b, b.count)):
            own = lane[token] - low
            held = (own >= 0) & (own < LANES)
            side = np.zeros((count, min(LANES, int(often.sum()) - low)), exact)
            side[row[held], own[held]] = 1
            sides.append(side)
        for r in range(0, a.count, 256):
            out[r : r + 256] += sides[0][r : r + 256] @ sides[1].T
    row_a, token_a = row_a[~often[token_a]], token_a[~often[token_a]]
    by_token = np.argsort(token_b, kind="stable")
    row_b, first = row_b[by_token], np.cumsum(many_b) - many_b
    many = many_b[token_a]
    ends, low = np.cumsum(many), 0
    while low < len(token_a):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + MATCHES, "right")))
        n = many[low:high]
        at = np.arange(n.sum()) + np.repeat(first[token_a[low:high]] - (np.cumsum(n) - n), n)
        top, bottom = row_a[low], row_a[high - 1] + 1
        flat = np.repeat(row_a[low:high] - top, n) * b.count + row_b[at]
        out[top:bottom] += np.bincount(flat, minlength=(bottom - top) * b.count).reshape(bottom - top, -1)
        low = high
    return out


def blocks_of(kinds: dict[str, DataFrame], models: DataFrame, text: Column | None = None, block: int | None = None) -> DataFrame:
    """``key, payload``: the models in order of their ids in blocks of ``block`` models, each as one Arrow message; keys rise with the ids.

    A model has, for each of the ``kinds`` (its name -> model_id, token), the size ``n_<kind>`` of its set and the tokens' numbers ``t_<kind>``; with
    ``text`` (of column token) their texts ``s_<kind>`` as well. Tokens are compared whole; a null token counts but equals none.
    """
    spark = models.sparkSession
    ids = staged(models.select("model_id").filter("model_id is not null").distinct(), "ids")
    count = ids.count()
    block = block or min(BLOCK, max(64, -(-count // 8)))
    rows = ids
    for kind, tokens in kinds.items():
        once = staged(tokens.select("model_id", "token").distinct(), "tokens")
        numbers = staged(once.select("token").filter("token is not null").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
        lists = [F.count(F.lit(1)).alias(f"n_{kind}"), F.collect_list("number").alias(f"t_{kind}")]
        if text is not None:
            lists.append(F.collect_list(F.when(F.col("number").isNotNull(), text)).alias(f"s_{kind}"))
        rows = rows.join(once.join(numbers, "token", "left").groupBy("model_id").agg(*lists), "model_id", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, number = [], TaskContext.get().partitionId() << 32

        def message(table: pa.Table) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "payload"])

        for batch in batches:
            waiting.append(batch)
            while sum(map(len, waiting)) >= block:
                table = pa.Table.from_batches(waiting)
                yield message(table.slice(0, block))
                waiting, number = table.slice(block).to_batches(), number + 1
        if sum(map(len, waiting)):
            yield message(pa.Table.from_batches(waiting))

    ranges = rows.repartitionByRange(max(1, -(-count // (4 * block))), "model_id").sortWithinPartitions("model_id")
    return staged(ranges.mapInArrow(pack, "key long, payload binary"), "blocks")


def tiled(blocks: DataFrame, schema: str | T.StructType, work) -> DataFrame:
    """The batches that ``work(first, second, same)`` gives for each pair of blocks, the models of the first of which come first, and for each block with itself."""
    spark = blocks.sparkSession
    found = sorted(r["key"] for r in blocks.select("key").collect())  # one a block
    places = spark.createDataFrame(list(enumerate(found)), "place long, key long")
    placed, last = blocks.join(F.broadcast(places), "key"), F.lit(max(0, len(found) - 1)).cast("long")
    tile = F.col("i") * F.lit(len(found)) + F.col("j")
    first = placed.select(F.col("place").alias("i"), F.explode(F.sequence("place", last)).alias("j"), F.lit(0).alias("role"), "payload")
    second = placed.select(F.explode(F.sequence(F.lit(0).cast("long"), "place")).alias("i"), F.col("place").alias("j"), F.lit(1).alias("role"), "payload")
    tiles = first.unionByName(second).withColumn("tile", tile)
    dealt = tiles.repartition(min(10_000, max(1, len(found) * (len(found) + 1) // 2)), "tile").sortWithinPartitions("tile", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i, j, payload in zip(*(batch.column(c) for c in ("i", "j", "payload"))):
                table = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()
                if held is None:
                    held = table
                else:
                    yield from work(held, table, i.as_py() == j.as_py())
                    held = None

    return dealt.mapInArrow(run, schema)


def sets(table: pa.Table, name: str) -> Sets:
    lists = table.column(name).combine_chunks()
    return Sets(lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists)


def sizes(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def wanted(low: int, high: int, count: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows ``low`` to ``high`` of the first block with those of the second, of a block with itself each but once."""
    if same:
        x, y = np.triu_indices(high - low, 1 + low, count)
        return x + low, y
    return np.repeat(np.arange(low, high), count), np.tile(np.arange(count), high - low)


def alike(first: dict[str, np.ndarray], second: dict[str, np.ndarray], shared: dict[str, np.ndarray], only: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that have the numbers of one of ``only``."""
    found = [(np.empty(0, np.int64),) * 2]
    for numbers in only:
        x, y = (np.flatnonzero(np.logical_and.reduce([n[k] == numbers[f"{c}_{k}"] for k in n])) for c, n in (("n1", first), ("n2", second)))
        i, j = np.nonzero(np.logical_and.reduce([shared[k][np.ix_(x, y)] == numbers[f"shared_{k}"] for k in shared]))
        found.append((x[i], y[j]))
    return tuple(np.concatenate(z) for z in zip(*found))


def all_overlaps(kinds: dict[str, DataFrame], models: DataFrame, block: int | None = None, only: list[dict[str, int]] | None = None) -> DataFrame:
    """``model_a, model_b`` and for each of the kinds ``n1_<kind>, n2_<kind>, shared_<kind>``: a row for each pair of different models.

    With ``only`` the pairs whose numbers are, all of them, those of one of its entries (which differ). What is shuffled is each block once a block, so that disk is taken by sets, not by pairs.
    """
    names = list(kinds)
    schema = T.StructType([T.StructField(x, T.StringType()) for x in ("model_a", "model_b")] + [T.StructField(f"{c}_{k}", T.LongType()) for k in names for c in ("n1", "n2", "shared")])

    def work(first: pa.Table, second: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        shared = {k: common(sets(first, f"t_{k}"), sets(second, f"t_{k}")) for k in names}
        n1, n2 = ({k: sizes(t, f"n_{k}") for k in names} for t in (first, second))
        id_a, id_b = (t.column("model_id").combine_chunks() for t in (first, second))
        step = max(1, ROWS // max(1, len(id_b)))
        if only is not None:
            x, y = alike(n1, n2, shared, only)
            pairs = iter([(x[x < y], y[x < y]) if same else (x, y)])
        else:
            pairs = (wanted(low, min(low + step, len(id_a)), len(id_b), same) for low in range(0, len(id_a), step))
        for x, y in pairs:
            columns = [id_a.take(pa.array(x)), id_b.take(pa.array(y))]
            for k in names:
                columns += [pa.array(n1[k][x]), pa.array(n2[k][y]), pa.array(shared[k][x, y].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if i < 2 else c for i, c in enumerate(columns)], names=schema.names)

    return tiled(blocks_of(kinds, models, block=block), schema, work)


def all_overlap_counts(kinds: dict[str, DataFrame], models: DataFrame, numbers: list[str], by_model: bool = False, block: int | None = None) -> DataFrame:
    """The rows of ``all_overlaps`` by their ``numbers`` (of its columns), and how many pairs have them: ``*numbers, pairs``.

    ``by_model``: by each of the two models of a pair as well, with its own sizes: ``model_id, size_<kind>, *numbers, pairs``. Pairs are counted where they are
    made; counts of different tasks aren't added up.
    """
    names, most_codes = list(kinds), CODES
    own = ["model_id", *[f"size_{k}" for k in names]] if by_model else []
    schema = T.StructType([T.StructField(c, T.StringType() if c == "model_id" else T.LongType()) for c in [*own, *numbers, "pairs"]])

    def rows_of(columns: list[np.ndarray], n: np.ndarray, side: int | None, size: list[dict[str, np.ndarray]], *tables: pa.Table) -> pa.RecordBatch:
        if side is not None:
            at, *columns = columns
            columns = [tables[side].column("model_id").combine_chunks().cast(pa.string()).take(pa.array(at)), *[size[side][k][at] for k in names], *columns]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in [*columns, n]], names=schema.names)

    def work(first: pa.Table, second: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        used = {n.split("_", 1)[1] for n in numbers if n.startswith("shared_")}
        shared = {k: common(sets(first, f"t_{k}"), sets(second, f"t_{k}")) for k in names if k in used}
        size = [{k: sizes(t, f"n_{k}") for k in names} for t in (first, second)]
        count_a, count_b = len(first), len(second)
        most = lambda of: int(of.max(initial=0)) + 1
        for side in (0, 1) if by_model else (None,):
            parts = [(np.arange(count_a)[:, None], count_a, False) if side == 0 else (np.arange(count_b)[None, :], count_b, True)] if by_model else []
            for n in numbers:
                of, k = n.split("_", 1)
                value = size[0][k][:, None] if of == "n1" else size[1][k][None, :] if of == "n2" else shared[k]
                parts.append((value, most(value), of == "n2"))
            space = 1
            for _, radix, _ in parts:
                space *= radix
            single = space >= most_codes  # no code for so many numbers: each pair is a row then
            total = np.zeros(space, np.int64) if space <= 1 << 24 else None
            codes, counts, held = [], [], 0

            def merged() -> tuple[np.ndarray, np.ndarray]:
                code, at = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_inverse=True)
                return code, np.bincount(at, np.concatenate([np.empty(0, np.int64), *counts]), len(code)).astype(np.int64)  # exact below 2^53

            step = max(1, 4 * ROWS // max(1, count_b))
            for low in range(0, count_a, step):
                high = min(low + step, count_a)
                if single:
                    x, y = wanted(low, high, count_b, same)
                    columns = [np.broadcast_to(v, (count_a, count_b))[x, y].astype(np.int64) for v, _, _ in parts]
                    yield rows_of(columns, np.ones(len(x), np.int64), side, size, first, second)
                    continue
                code = np.zeros((high - low, count_b), np.int64)
                for value, radix, of_b in parts:
                    code *= radix
                    code += (value if of_b else value[low:high]).astype(np.int64)
                code = code[np.arange(low, high)[:, None] < np.arange(count_b)[None, :]] if same else code.ravel()
                if total is not None:
                    total += np.bincount(code, minlength=space)
                else:
                    for x, got in zip((codes, counts), np.unique(code, return_counts=True)):
                        x.append(got)
                    held += len(codes[-1])
                    if held > 1 << 23:
                        code, n = merged()
                        codes, counts, held = [code], [n], 0
            if total is not None:
                codes, counts = [np.flatnonzero(total)], [total[total > 0]]
            code, n = merged()
            columns = []
            for _, radix, _ in reversed(parts):
                code, value = np.divmod(code, radix)
                columns.insert(0, value)
            for low in range(0, len(n), ROWS):
                yield rows_of([c[low : low + ROWS] for c in columns], n[low : low + ROWS], side, size, first, second)

    return tiled(blocks_of(kinds, models, block=block), schema, work)


def held(pair: np.ndarray, at: np.ndarray, pairs: int, most: int) -> list[np.ndarray]:
    """Of each of the ``pairs`` the places ``at``, below ``most``, as bits; a number for each ``BITS`` places."""
    power, out = 2.0 ** np.arange(BITS), []
    for low in range(0, most, BITS):
        own = slice(None) if most <= BITS else (at >= low) & (at < low + BITS)
        out.append(np.bincount(pair[own], power[at[own] - low], pairs).astype(np.int64))
    return out


def least(bits: list[np.ndarray], none: int, of: bool = True) -> np.ndarray:
    """The least place of those in ``bits``, or without ``of`` of those not in them, ``none`` at most."""
    out = np.int64(none)
    for i, x in reversed(list(enumerate(bits))):
        x = x if of else x ^ ((1 << BITS) - 1)
        out = np.where(x != 0, np.minimum(np.bitwise_count((x & -x) - 1) + np.int64(i * BITS), none), out)
    return out


def first_texts(tokens: DataFrame, models: DataFrame, text: Column, block: int | None = None) -> DataFrame:
    """``model_a, model_b, side, n, first``: for each pair of different models the tokens in ``both``, only in the first (``1``) and only in the second (``2``),
    their number and the least of their ``text`` (of column token); no row for none.

    Python hands over numbers, ``CODED`` pairs a message, with the ids and texts that they stand for; rows are made of them by Spark, each text but once a message.
    """
    array = lambda of, nulls=False: T.ArrayType(of, nulls)
    kinds = {"a": array(T.StringType()), "b": array(T.StringType()), "words": array(T.StringType(), True), "ns": array(T.IntegerType()), "codes": array(T.LongType())}
    schema = T.StructType([T.StructField(c, kind, False) for c, kind in kinds.items()])

    def work(first: pa.Table, second: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        a, b = sets(first, "t_x"), sets(second, "t_x")
        texts = [t.column("s_x").combine_chunks().flatten() for t in (first, second)]
        numbers, at, place = np.unique(np.concatenate([a.number, b.number]), return_index=True, return_inverse=True)
        words = pa.concat_arrays(texts).take(pa.array(at)) if len(numbers) else pa.array([], pa.string())
        order = np.array(sorted(range(len(numbers)), key=[x.encode("utf-8", "surrogatepass") for x in words.to_pylist()].__getitem__), np.int64)
        none = len(order)  # the place of no text
        words, rank = pa.concat_arrays([words.take(pa.array(order)).cast(pa.string()), pa.nulls(1, pa.string())]), np.empty(none, np.int64)
        rank[order] = np.arange(none)
        place = rank[place]
        # each model's places, rising, then none
        lists, depths = [], []
        for own, x in ((a, place[: len(a.number)]), (b, place[len(a.number) :])):
            by = np.lexsort((x, own.row))
            depths.append(np.arange(len(x)) - np.repeat(np.cumsum(own.size) - own.size, own.size))
            lists.append(np.full((own.count, int(own.size.max(initial=0)) + 1), none))
            lists[-1][own.row, depths[-1]] = x[by]
        begin = np.append(0, np.cumsum(a.size))
        place_a, place_b = (x[x < none] for x in lists)
        # the models of the second block that hold a place, and where it stands among theirs
        by = np.argsort(place_b, kind="stable")
        holder, spot, many = b.row[by], depths[1][by], np.bincount(place_b, minlength=none)
        since, ends = np.cumsum(many) - many, np.append(0, np.cumsum(many[place_a]))[begin]
        size_a, size_b = sizes(first, "n_x"), sizes(second, "n_x")
        id_a, id_b = (t.column("model_id").combine_chunks().cast(pa.string()) for t in (first, second))
        count, wide = len(id_a), len(id_b)
        step = min(1 << 10, max(1, CODED // max(1, wide)))
        number = ((np.arange(step) << 20)[:, None] + np.arange(wide)).ravel()
        low = 0
        while low < count:
            high = min(low + step, count, max(low + 1, int(np.searchsorted(ends, ends[low] + MATCHES, "right")) - 1))
            own, n = place_a[begin[low] : begin[high]], many[place_a[begin[low] : begin[high]]]
            match = np.arange(n.sum()) + np.repeat(since[own] - (np.cumsum(n) - n), n)
            pair, pairs = np.repeat((a.row[begin[low] : begin[high]] - low) * wide, n) + holder[match], (high - low) * wide
            of_a = held(pair, np.repeat(depths[0][begin[low] : begin[high]], n), pairs, lists[0].shape[1] - 1)
            of_b = held(pair, spot[match], pairs, lists[1].shape[1] - 1)
            shared = sum((np.bitwise_count(x) for x in of_a), np.zeros(pairs, np.int64))
            new = number[:pairs] & ((1 << 20) - 1) > np.repeat(np.arange(low, high), wide) if same else True
            ns, places, codes = [], [], []
            for side, (n, bits) in enumerate(((shared, of_a), (np.repeat(size_a[low:high], wide) - shared, of_a), (np.tile(size_b, high - low) - shared, of_b))):
                some = np.flatnonzero((n > 0) & new)
                ns.append(n[some])
                codes.append(number[some] + (side << 30))
                row = some % wide if side == 2 else some // wide + low
                places.append(lists[side == 2][row, least([x[some] for x in bits], lists[side == 2].shape[1] - 1, side == 0)])
            low, first_a = high, low
            place, code = np.concatenate(places), np.concatenate(codes)
            if not len(code):
                continue
            used = np.zeros(none + 1, bool)
            used[place] = True
            code |= (np.cumsum(used) - 1)[place] << 32
            values = [id_a.slice(first_a, high - first_a), id_b, words.filter(pa.array(used)), pa.array(np.concatenate(ns), pa.int32()), pa.array(code)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], names=list(kinds))

    coded = tiled(blocks_of({"x": tokens}, models, text, block), schema, work).select("a", "b", "words", "ns", F.posexplode("codes").alias("at", "code"))
    part = lambda low, bits: F.shiftright("code", low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    side = F.when(part(30, 2) == 0, "both").when(part(30, 2) == 1, "1").otherwise("2")
    return coded.select(F.col("a")[part(20, 10)].alias("model_a"), F.col("b")[part(0, 20)].alias("model_b"), side.alias("side"), F.col("ns")[F.col("at")].cast("long").alias("n"), F.col("words")[part(32, 31)].alias("first"))
