"""Near-duplicate rows and tasks: shingles, verified edges, clusters with representatives, masks, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import UNSPACED, first_tokens, shingles, tokens, word_count
from spanloom.operators.graph import connected_components, written
from spanloom.operators.vectors import density_clusters

#: Keys of a bucket that meet under one join key, about.
BLOCK = 1024
#: Sets that hold an item, up to which all pairs of them may meet; more frequent items ask for sizes that fit as well.
RARE = 64
#: Items that a task holds at a time before it sends them, parts that they are dealt to, and parts of sets that they come back to.
HELD, PARTS, SET_PARTS = 1 << 20, 1 << 10, 1 << 8
#: Bits that mark an item inside of its part, marks that a task holds at a time, and bits of a part's filter of items at most: 64 MB for all parts.
MARK, MARKS_HELD, SLOTS = 27, 1 << 22, 1 << 19
#: Set sizes up to which each size is a class of its own; beyond, classes grow by STEP.
SMALL, STEP = 8, 1.25


def row_key() -> Column:
    """A key that sorts by task and then by row number."""
    return F.concat_ws(":", "task_id", F.lpad(F.col("row_index").cast("string"), 8, "0"))


def hashed_runs(w: Column, n: int) -> Column:
    """The sorted distinct hashes of the runs of n words of w; fewer words are one run."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    return F.when(F.size(w) < n, F.array(F.xxhash64(w))).otherwise(F.sort_array(F.array_distinct(runs)))


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """key, items: the sorted distinct n-grams of each text (key, text), as 64-bit hashes of their words; texts without tokens are left out."""

    # a filter on the items would be pushed below them and compute them twice
    return texts.where(F.col("text").rlike(r"\S")).select("key", F.element_at(F.transform(F.array(tokens(F.col("text"))), lambda w: hashed_runs(w, n)), 1).alias("items"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes up to which words are hashed side by side; longer ones are hashed one by one.
LONG = 512
SEEDS, LOW_BYTES = mix(np.arange(LONG + 1, dtype=np.uint64) + np.uint64(1)), np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, that follows from its bytes: eight bytes of all words at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    start, size = at[:-1], np.diff(at)
    eights = np.zeros((at[-1] >> 3) + 2, np.uint64)
    if at[-1]:
        eights.view(np.uint8)[: at[-1]] = np.frombuffer(data, np.uint8)[: at[-1]]
    out, done, live = SEEDS[np.minimum(size, LONG)], 0, np.flatnonzero((size > 0) & (size <= LONG))
    while len(live):
        own = start[live] + done
        i, shift = own >> 3, ((own & 7) << 3).astype(np.uint64)
        x = (eights[i] >> shift) | ((eights[i + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        out[live] = mix(out[live] + (x & LOW_BYTES[np.minimum(size[live] - done, 8)]))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(eights.view(np.uint8)[at[i] : at[i + 1]].tobytes())
    return out


def shingled(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of n words of each text of lowered(), as hashes, text by text, and their number for each text; fewer words are one run."""
    lists = pc.ascii_split_whitespace(texts)
    flat, owner = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    there = pc.binary_length(flat).to_numpy() > 0
    words, owner = word_hashes(flat)[there], owner[there]
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    starts, sizes = [np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)], [n]
    for size in range(1, n):  # a shorter text is one run
        starts.append(first[count == size])
        sizes.append(size)
    runs = []
    for at, size in zip(starts, sizes, strict=True):
        value = np.full(len(at), size, np.uint64)
        for k in range(size):
            value = mix(value + words[at + k])
        runs.append(value)
    value, owner = np.concatenate(runs), owner[np.concatenate(starts)]
    bits = len(texts).bit_length()
    rough = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits))
    order = np.argsort(rough)
    rough, runs = rough[order], value[order]
    if ((rough[1:] == rough[:-1]) & (runs[1:] != runs[:-1])).any():  # two runs of a text that differ in their last bits only
        order = np.lexsort((value, owner))
        runs = value[order]
    owner = owner[order]
    new = np.append(True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1]))[: len(runs)]
    return runs[new].view(np.int64), np.bincount(owner[new], minlength=len(texts))


#: A character as far as those of UNSPACED or farther; to look for it takes less time than to look for their scripts.
FAR = r"[^\u0000-\u10FF]"


def lowered(texts: DataFrame) -> DataFrame:
    """key, low: the texts with tokens in lower case, and blanks around what stands alone, as tokens() has it."""
    text = F.col("text")
    near = (F.length(text) == F.octet_length(text)) | ~text.rlike(FAR)
    return texts.where(text.rlike(r"\S")).select("key", F.when(near, F.lower(text)).otherwise(F.regexp_replace(F.lower(text), UNSPACED, " $0 ")).alias("low"))


def packed_shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """shingle_sets() with other hashes: of the words of a batch side by side, and of runs of words from those of their words. For whole sets that
    are compared with each other; signatures keep to shingle_sets(), whose values they follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, count = shingled(batch.column(1), n)
            offsets = np.append(0, np.cumsum(count)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))], names=["key", "items"])

    return lowered(texts).mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, items array<long>")


#: Of a batch: keys, uids, tags, the items of all rows, and how many each row has.
Rows = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def rows_of_sets(batch: pa.RecordBatch) -> Rows:
    lists = batch.column("items")
    return batch.column("key"), batch.column("uid").to_numpy(), batch.column("tag").to_numpy().astype(np.uint8), lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()


def rows_of_texts(n: int) -> Callable[[pa.RecordBatch], Rows]:
    """Reads key, low and tag; the uid is a hash of the set's size and items in any order."""

    def read(batch: pa.RecordBatch) -> Rows:
        item, m = shingled(batch.column("low"), n)
        ends = np.cumsum(m)
        total = np.append(np.uint64(0), np.cumsum(mix(item.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))
        uid = mix(total[ends] - total[ends - m] + m.astype(np.uint64)).view(np.int64)
        return batch.column("key"), uid, batch.column("tag").to_numpy().astype(np.uint8), item, m

    return read


def packed(part: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """A row for each part: its number, and the values of each column there, first bytes of all values first, which shrinks small numbers."""
    order = np.argsort(part.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
    part = part[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(starts[1:], len(part))[: len(starts)]
    return [pa.array(part[starts].astype(np.int32)), *(pa.array([planes(x[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()) for x in (c[order] for c in columns))]


def planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def unpacked(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unplaned(x, kind) for x in column.to_pylist() if x is not None)])


def place(x: np.ndarray, parts: int) -> np.ndarray:
    return (mix(x.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % parts


def repeated_items(sets: DataFrame, read: Callable[[pa.RecordBatch], Rows] = rows_of_sets) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Two filters of rows of sets, as read gets them from their batches (uid, key, items, tag), tag a number from 1 to 255 made of the key.

    repeated(items): true for each item that stands in two rows or more, and for a few others. first(uid, tag): of the rows of one uid it is true for
    at least one, and mostly for few others.

    Marks of items are sorted and sent as differences, about 2.5 bytes for each item, and a part tells which of its marks came twice, by
    a bit for each slot. Of a uid that has several rows, and a slot to itself, a part tells the least tag. A part has at most SLOTS bits and
    SLOTS / 16 tags, whatever it holds, so that the filters, which go through the driver, have a fixed size of 96 MB at most; with more items
    and sets than fit, more of the others pass as well.
    """
    shift = 64 - (PARTS.bit_length() - 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flushed() -> pa.RecordBatch:
            items, uid, tag = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            x = np.sort(items)
            part, mark = (x >> np.uint64(shift)).astype(np.int32), ((x >> np.uint64(shift - MARK)) & np.uint64((1 << MARK) - 1)).astype(np.uint32)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            step = np.diff(mark, prepend=np.uint32(0))
            step[starts] = mark[starts]
            steps = pa.array([planes(step[a:b]) for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True)], pa.binary())
            to, *own = packed(place(uid, PARTS), uid, tag)
            none = lambda n: pa.nulls(n, pa.binary())
            columns = [pa.concat_arrays(c) for c in ([pa.array(part[starts]), to], [steps, none(len(to))], [none(len(starts)), own[0]], [none(len(starts)), own[1]])]
            return pa.RecordBatch.from_arrays(columns, names=["part", "steps", "uid", "tag"])

        for batch in batches:
            _, uid, tag, item, _ = read(batch)
            held.append((mix(item.view(np.uint64)), uid, tag))
            total += len(held[-1][0])
            if total >= MARKS_HELD:
                yield flushed()
                total = 0
        if held:
            yield flushed()

    def size(n: int, most: int) -> int:
        return min(most, max(64, 1 << n.bit_length()))

    def told(table: pa.Table) -> pa.Table:
        mark = np.sort(np.concatenate([np.zeros(0, np.uint32), *(np.cumsum(unplaned(x, np.uint32), dtype=np.uint32) for x in table["steps"].to_pylist() if x is not None)]))
        twice = np.unique(mark[1:][mark[1:] == mark[:-1]])
        bits = np.zeros(size(16 * len(twice), SLOTS), bool)
        bits[twice & np.uint32(len(bits) - 1)] = True
        uid, tag = unpacked(table["uid"]), unpacked(table["tag"], np.uint8)
        order = np.lexsort((tag, uid))
        own, at, n = np.unique(uid[order], return_index=True, return_counts=True)
        tags = np.zeros(size(8 * len(own), max(64, SLOTS >> 4)), np.uint8)
        slot = (mix(own.view(np.uint64)) & np.uint64(len(tags) - 1)).astype(np.int64)
        lone = (n > 1) & (np.bincount(slot, minlength=len(tags))[slot] == 1)
        tags[slot[lone]] = tag[order][at[lone]]
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "tags": pa.array([tags.tobytes()], pa.binary())})

    rows = sets.mapInArrow(sent, "part int, steps binary, uid binary, tag binary").groupBy("part").applyInArrow(told, "part int, bits binary, tags binary").collect()

    def laid(column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each part's bytes begin, how many there are, and the bytes; a part without a row has 64 zeros."""
        begin, length, data = np.zeros(PARTS, np.int64), np.full(PARTS, 64, np.uint64), [bytes(64)]
        end = 64
        for r in rows:
            begin[r.part], length[r.part] = end, len(r[column])
            data.append(bytes(r[column]))
            end += len(r[column])
        return begin, length, np.frombuffer(b"".join(data), np.uint8)

    known = sets.sparkSession.sparkContext.broadcast((laid("bits"), laid("tags")))

    def repeated(items: np.ndarray) -> np.ndarray:
        begin, length, data = known.value[0]
        x = mix(items.view(np.uint64))
        part = (x >> np.uint64(shift)).astype(np.int64)
        slot = ((x >> np.uint64(shift - MARK)) & (np.uint64(8) * length[part] - np.uint64(1))).astype(np.int64)
        return (data[begin[part] + (slot >> 3)] >> (slot & 7).astype(np.uint8)) & 1 > 0

    def first(uid: np.ndarray, tag: np.ndarray) -> np.ndarray:
        begin, length, data = known.value[1]
        part = place(uid, PARTS)
        told = data[begin[part] + (mix(uid.view(np.uint64)) & (length[part] - np.uint64(1))).astype(np.int64)]
        return (told == 0) | (told == tag)

    return repeated, first


def named_sets(sets: DataFrame, numbers: bool = False, threshold: float | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct sets of sets (key, items), and members (key, rep, uid, copies): rep the least key of those with the set, copies their number.
    Sets are told apart by 64 bits of hash, uid, as their items are. With n, sets are texts (key, text), which the task that sends their items
    cuts into runs of n words itself.

    Of the sets that share an item with another come uid, m, items, df: the set's size, its items that stand in several sets, the rarest first,
    and in how many. Items of one set can't be common to two, so similarities follow from these and the sizes. With numbers, shared items are
    numbered where they are counted and go on by their numbers, of 32 bits: room for 4 billion shared items, more than PARTS parts hold.

    With a threshold, only sets come that may reach this Jaccard index with another one: of m items as many as threshold * m must be shared.
    Most are told by repeated_items() already, before any item is sent, as are most copies of a set; then sets is computed twice.

    Items are sent once to be counted and then, without those of one set, back to their sets; a task sends those of a part as one row. A part
    holds all sets of its items, so a task needs room for the sets of the most frequent item. The sets themselves are never written, nor is
    what lies between the two shuffles: the members go along with the second.
    """
    kind = sets.schema["key"].dataType.simpleString()
    names = ["part", "item", "uid", "m", "keys"]
    arrow_keys = pa.list_(pa.string() if kind == "string" else pa.int64())
    tag = (F.pmod(F.xxhash64("key"), F.lit(255)) + 1).cast("int").alias("tag")
    if n is not None:
        source, read = lowered(sets).select("key", "low", tag), rows_of_texts(n)
    else:
        uid = F.col("uid") if "uid" in sets.columns else F.xxhash64(F.size("items"), "items").alias("uid")
        source, read = sets.select(uid, "key", "items", tag), rows_of_sets
    repeated, first = repeated_items(source, read) if threshold is not None else (None, None)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flushed() -> pa.RecordBatch:
            item, uid = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part, *columns = packed(place(item, PARTS), item, uid)
            return pa.RecordBatch.from_arrays([part, *columns, pa.nulls(len(part), pa.binary()), pa.nulls(len(part), arrow_keys)], names=names)

        for batch in batches:
            own_keys, uid, tag, item, m = read(batch)
            owner = np.repeat(np.arange(len(uid)), m)
            if repeated is not None:
                there = repeated(item)
                fits = np.bincount(owner[there], minlength=len(uid)) >= threshold * m - 1e-6
                there &= (fits & first(uid, tag))[owner]
                item, owner, m = item[there], owner[there], np.where(fits, m, 0)  # 0: of this set no item goes on
            part, own, size, rows = packed(to := place(uid, PARTS), uid, m.astype(np.int32), np.arange(len(uid)))
            keys = own_keys.take(pa.array(np.argsort(to, kind="stable")))
            offsets = np.append(0, np.cumsum([len(x) // 8 for x in rows.to_pylist()])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(part), pa.binary()), own, size, pa.ListArray.from_arrays(pa.array(offsets), keys)], names=names)
            held.append((item, uid[owner]))
            total += len(held[-1][0])
            if total >= HELD:
                yield flushed()
                total = 0
        if total:
            yield flushed()

    lists = {"keys": arrow_keys, "reps": arrow_keys, "owners": pa.list_(pa.int64()), "copies": pa.list_(pa.int64())}

    def row_of(n: int, **columns: object) -> pa.Table:
        """n rows of what is sent back, null but for some columns."""
        own = {"part": pa.int32(), "item": pa.binary(), "uid": pa.binary(), "df": pa.binary(), "m": pa.binary()} | lists
        return pa.table({name: columns.get(name, pa.nulls(n, k)) for name, k in own.items()})

    def counted(table: pa.Table) -> pa.Table:
        own_part = table["part"][0].as_py()
        of_items, of_sets = table.filter(pc.is_valid(table["item"])), table.filter(pc.is_null(table["item"]))
        item, uid = unpacked(of_items["item"]), unpacked(of_items["uid"])
        order = np.lexsort((uid, item))
        item, uid = item[order], uid[order]
        new = np.append(True, (item[1:] != item[:-1]) | (uid[1:] != uid[:-1]))[: len(item)]  # copies of a set
        item, uid = item[new], uid[new]
        heads = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
        n = np.diff(heads, append=len(item))
        df = np.repeat(n, n)
        item, uid, df = item[df > 1], uid[df > 1], df[df > 1]
        if numbers:
            several = n[n > 1]
            if len(several) * PARTS > 1 << 32:
                raise ValueError("more than 4 billion shared items")
            item = (np.repeat(np.arange(len(several)), several) * PARTS + own_part).astype(np.uint32).view(np.int32)
        part, *columns = packed(place(uid, SET_PARTS), item, uid, df.astype(np.int32))
        back = row_of(len(part), part=part, item=columns[0], uid=columns[1], df=columns[2])
        owner, m, keys = unpacked(of_sets["uid"]), unpacked(of_sets["m"], np.int32), [k for x in of_sets["keys"].to_pylist() for k in x]
        least: dict[int, object] = {}
        for u, k in zip(owner.tolist(), keys, strict=True):
            if u not in least or k < least[u]:
                least[u] = k
        distinct, at, which, count = np.unique(owner, return_index=True, return_inverse=True, return_counts=True)
        copies, on = count[which], m[at] > 0
        part, *columns = packed(place(distinct[on], SET_PARTS), distinct[on], m[at][on])
        own = row_of(len(part), part=part, uid=columns[0], m=columns[1])
        some = int(len(keys) > 0)
        named = {"keys": [keys], "reps": [[least[u] for u in owner.tolist()]], "owners": [owner.tolist()], "copies": [copies.tolist()]}
        members = row_of(some, part=pa.array([own_part % SET_PARTS] * some, pa.int32()), **{name: pa.array(x[:some], lists[name]) for name, x in named.items()})
        return pa.concat_tables([back, own, members])

    def ordered(table: pa.Table) -> pa.Table:
        back, own, members = table.filter(pc.is_valid(table["item"])), table.filter(pc.is_valid(table["m"])), table.filter(pc.is_valid(table["keys"]))
        item, uid, df = unpacked(back["item"], np.int32 if numbers else np.int64), unpacked(back["uid"]), unpacked(back["df"], np.int32)
        order = np.lexsort((item, df, uid))
        item, uid, df = item[order], uid[order], df[order]
        heads = np.flatnonzero(np.append(True, uid[1:] != uid[:-1])[: len(uid)])
        known, m = unpacked(own["uid"]), unpacked(own["m"], np.int32)
        order = np.argsort(known)
        size = m[order][np.searchsorted(known[order], uid[heads])] if len(heads) else m[:0]
        if threshold is not None:
            fits = np.diff(heads, append=len(uid)) >= threshold * size - 1e-6
            there = np.repeat(fits, np.diff(heads, append=len(uid)))
            item, uid, df, size = item[there], uid[there], df[there], size[fits]
            heads = np.flatnonzero(np.append(True, uid[1:] != uid[:-1])[: len(uid)])
        offsets = pa.array(np.append(heads, len(uid)).astype(np.int32))
        of_sets = {"uid": pa.array(uid[heads]), "m": pa.array(size), **{name: pa.ListArray.from_arrays(offsets, pa.array(x)) for name, x in (("items", item), ("df", df))}}
        sets = pa.table(of_sets | {name: pa.nulls(len(heads), k) for name, k in lists.items()})
        rest = pa.table({name: pa.nulls(len(members), x.type) for name, x in of_sets.items()} | {name: members[name].cast(k) for name, k in lists.items()})
        return pa.concat_tables([sets, rest])

    parts = source.mapInArrow(sent, f"part int, item binary, uid binary, m binary, keys array<{kind}>").groupBy("part")
    named = f"keys array<{kind}>, reps array<{kind}>, owners array<long>, copies array<long>"
    back = parts.applyInArrow(counted, f"part int, item binary, uid binary, df binary, m binary, {named}").groupBy("part")
    table = written(back.applyInArrow(ordered, f"uid long, m int, items array<{'int' if numbers else 'long'}>, df array<int>, {named}"))
    members = table.where("keys is not null").select(F.explode(F.arrays_zip(*lists)).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.reps").alias("rep"), F.col("x.owners").alias("uid"), F.col("x.copies").alias("copies"))
    return table.where("uid is not null").select("uid", "m", "items", "df"), members


def distinct_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sets as (uid, key, items), key the least of those with the set, and members as (key, rep), rep that least key. Sets are
    told apart by their size and 128 bits of hash. Only ids are kept beside the texts' own sets: who reads the items of distinct sets
    more than once should write them."""
    hashed = written(sets.select("key", "items", F.size("items").alias("size"), F.xxhash64("items").alias("h1"), F.xxhash64(F.lit(1), "items").alias("h2")))
    same = ["size", "h1", "h2"]
    low = written(hashed.groupBy(*same).agg(F.min("key").alias("rep")).withColumn("uid", F.monotonically_increasing_id()))
    members = written(hashed.select("key", *same).join(low, same).select("key", "rep"))
    return hashed.select("key", "items").join(low.select(F.col("rep").alias("key"), "uid"), "key").select("uid", "key", "items"), members


def minhash(sets: DataFrame, permutations: int = 64) -> DataFrame:
    """key, signature array<long>: for each permutation the least hash of the set's items."""
    item = lambda i: F.aggregate("items", F.lit(2**63 - 1), lambda a, x: F.least(a, F.xxhash64(x, F.lit(i))))
    return sets.select(*(c for c in sets.columns if c != "items"), F.array(*(item(i) for i in range(permutations))).alias("signature"))


def lsh_candidates(signatures: DataFrame, band: int = 4) -> DataFrame:
    """All pairs (a, b), a before b, of keys that agree in a band of the signature, each pair once.

    The keys of a bucket meet in blocks of about BLOCK, each pair of blocks (i, j) under a join key of its own, so that no task holds a
    whole bucket. A pair counts in the first band in which it agrees, which needs no distinct over all bands.
    """
    bands = F.transform(F.sequence(F.lit(0), (F.size("signature") / band).cast("int") - 1), lambda i: F.xxhash64(i, F.slice("signature", i * band + 1, F.lit(band))))
    banded = written(signatures.select("key", bands.alias("bands")))
    entries = banded.select("key", "bands", F.posexplode("bands").alias("at", "bucket"))
    shared = entries.groupBy("at", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("at", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    entries = written(entries.join(shared, ["at", "bucket"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    one = entries.select("at", "bucket", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("key").alias("x"), F.col("bands").alias("x_bands"))
    two = entries.select("at", "bucket", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("key").alias("y"), F.col("bands").alias("y_bands"))
    first = F.array_position(F.zip_with("x_bands", "y_bands", lambda x, y: x == y), True) == F.col("at") + 1
    met = one.join(two, ["at", "bucket", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).where(first)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def size_class(n: Column) -> Column:
    return F.when(n <= SMALL, n).otherwise(SMALL + F.floor(F.log(n / SMALL) / np.log(STEP))).cast("int")


def least_size(c: Column) -> Column:
    """No set of size class c is smaller."""
    return F.when(c <= SMALL, c).otherwise(F.floor(SMALL * F.pow(F.lit(STEP), c - SMALL))).cast("int")


def shared_sets(sets: DataFrame, numbers: bool = False, threshold: float | None = None) -> DataFrame:
    """The shared items of distinct sets (uid, items), as named_sets() gives them. What has been through here stays as it is."""
    return sets if "df" in sets.columns else named_sets(sets.select("uid", F.col("uid").alias("key"), "items"), numbers, threshold)[0]


def prefix_entries(shared: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What sets (see shared_sets()) must share to reach a Jaccard threshold: rare (item, uid), and hot (item, low, high, own, uid).

    Two sets of sizes m and n reach it only with ceil(t / (1 + t) * (m + n)) common items, so they share one among the m - that + 1 rarest of the one
    and the n - that + 1 rarest of the other. If that item stands in RARE sets or fewer, both have a rare entry of it. If not, both have a
    hot entry of it under the pair of their size classes, low and high, which is made only of as many items as the least sizes of these
    classes ask for: a frequent item on which sets differ in all else has no entry at all.
    """
    ratio = threshold / (1 + threshold)
    alone = F.col("m") - F.size("items")  # items of one set come before all others
    longest = lambda least: F.col("m") - F.greatest(F.ceil(ratio * (F.col("m") + least) - 1e-9), F.lit(1)) + 1
    least = F.ceil(F.col("m") * threshold - 1e-9)
    first = F.slice("items", F.lit(1), F.greatest(longest(least) - alone, F.lit(0)).cast("int"))
    ranked = shared.select("uid", "m", "df", alone.alias("alone"), F.posexplode(first).alias("at", "item"))
    ranked = ranked.select("uid", "m", "item", F.get("df", F.col("at")).alias("df"), (F.col("at") + 1 + F.col("alone")).alias("place"))
    own = size_class(F.col("m"))
    partners = F.sequence(size_class(F.greatest(least, F.lit(1))), size_class(F.floor(F.col("m") / threshold + 1e-9)))
    hot = ranked.where(F.col("df") > RARE).select("uid", "m", "item", "place", own.alias("own"), F.explode(partners).alias("other"))
    hot = hot.where(F.col("place") <= longest(F.greatest(least_size(F.col("other")), least)))
    return ranked.where(F.col("df") <= RARE).select("item", "uid"), hot.select("item", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "uid")


def rare_pairs(rare: DataFrame) -> DataFrame:
    """All pairs (a, b) of an item, of which no item gives more than RARE for each set."""
    one, two = rare.select("item", F.col("uid").alias("a")), rare.select("item", F.col("uid").alias("b"))
    return one.join(two, "item").where("a < b").select("a", "b")


GROUP = ["item", "low", "high"]


def blocked_pairs(entries: DataFrame, sizes: DataFrame, condition: Column) -> DataFrame:
    """Pairs of entries x and y of a group that meet the condition. sizes: the groups with blocks, how many to cut each into: entries meet
    block by block, so that no join key holds a whole group."""
    cut = entries.join(sizes, GROUP).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    x = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = cut.withColumn("at", F.col("block")).alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*GROUP, "at")]
    pairs = x.join(y, [*on, condition]).select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))
    return pairs.where("a <> b")


def roles() -> Column:
    """Entries of different size classes meet across classes only."""
    return (F.col("x.low") == F.col("x.high")) | (F.col("x.own") != F.col("y.own"))


def exact_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of uids that may reach the threshold, none missed."""
    rare, hot = prefix_entries(shared_sets(sets, True, threshold), threshold)
    hot = written(hot)
    sizes = hot.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1").select(*GROUP, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    once = ((F.col("x.low") == F.col("x.high")) & (F.col("x.uid") < F.col("y.uid"))) | (F.col("x.own") < F.col("y.own"))
    return rare_pairs(rare).unionByName(blocked_pairs(hot, sizes, once)).distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of uids with similarity, the exact Jaccard index of their sets, at the threshold or above. sets: uid, m and items; of the
    items, those that stand in one set only may be left out."""
    one, two = sets.select(F.col("uid").alias("a"), F.col("m").alias("x_m"), F.col("items").alias("x")), sets.select(F.col("uid").alias("b"), F.col("m").alias("y_m"), F.col("items").alias("y"))
    fits = pairs.join(one, "a").join(two, "b").where((F.col("x_m") >= threshold * F.col("y_m") - 1e-9) & (F.col("y_m") >= threshold * F.col("x_m") - 1e-9))
    both = F.size(F.array_intersect("x", "y"))
    return fits.select("a", "b", (both / (F.col("x_m") + F.col("y_m") - both)).alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_edges(texts: DataFrame, n: int, threshold: float, mode: str = "exact") -> DataFrame:
    """a, b, similarity between texts of distinct sets, each set once, by its least key. mode 'exact' misses none, 'lsh' few."""
    if mode == "exact":
        own, same = named_sets(texts, True, threshold, n)
        pairs, names = exact_candidates(own, threshold), same.where("key = rep").select("key", "uid")
    else:
        sets, _ = distinct_sets(shingle_sets(texts, n))
        sets = written(sets)
        own = sets.withColumn("m", F.size("items"))
        names = ids = sets.select("key", "uid")
        pairs = lsh_candidates(minhash(sets.select("key", "items")))
        pairs = pairs.join(ids.withColumnsRenamed({"key": "a", "uid": "u"}), "a").join(ids.withColumnsRenamed({"key": "b", "uid": "v"}), "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    found = verified(pairs, own, threshold)
    named = found.join(names.withColumnsRenamed({"key": "x", "uid": "a"}), "a").join(names.withColumnsRenamed({"key": "y", "uid": "b"}), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def components(sets: DataFrame, threshold: float) -> DataFrame:
    """node, root: components of the sets (uids) under similarities at the threshold or above, exact; sets without such a neighbour are left out.

    A group of hot entries is linked to its heads, the least uid of each side, first. Groups that are then still of several components
    compare what lies outside of their largest one with all of the group: in proportion to the group, times those outside.
    """
    shared = shared_sets(sets, True, threshold)
    rare, hot = prefix_entries(shared, threshold)
    hot = written(hot)
    heads = hot.groupBy(*GROUP, "own").agg(F.min("uid").alias("head")).withColumnRenamed("own", "side")
    star = hot.join(heads, GROUP).where(((F.col("low") == F.col("high")) | (F.col("own") != F.col("side"))) & (F.col("uid") != F.col("head"))).select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b"))
    links = written(verified(rare_pairs(rare).unionByName(star).distinct(), shared, threshold).select("a", "b"))
    labels = connected_components(links)
    marked = written(hot.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("root", "uid")).drop("root"))
    parts = marked.groupBy(*GROUP, "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy(*GROUP).agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).where("labels > 1")
    mixed = written(mixed.select(*GROUP, F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("blocks")))
    if mixed.isEmpty():
        return labels
    own = marked.join(mixed, GROUP)
    rest = own.where("label <> top").withColumn("at", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).alias("x")
    every = own.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*GROUP, "at")]
    extra = rest.join(every, [*on, F.col("x.label") != F.col("y.label"), roles()]).select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct()
    more = verified(extra, shared, threshold).select("a", "b")
    return connected_components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def clusters(texts: DataFrame, n: int, threshold: float, excluded: DataFrame | None = None, mode: str = "exact") -> DataFrame:
    """key, rep, similarity: members of clusters of two or more. Texts that edges or equal sets connect form a component; its
    representative is the least key that isn't excluded, else the least; members keep to it by their own similarity."""
    return clusters_and_sets(texts, n, threshold, excluded, mode, [])[0]


def clusters_and_sets(texts: DataFrame, n: int, threshold: float, excluded: DataFrame | None = None, mode: str = "exact", more: tuple | list = ("uid",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """clusters() with more columns, the sets that members' uids name, and the members that named_sets() gives."""
    if mode == "exact":
        items, same = named_sets(texts, True, threshold, n)
        roots = components(items, threshold)
    else:
        sets, same = distinct_sets(shingle_sets(texts, n))
        sets = written(sets)
        same = same.join(sets.select(F.col("key").alias("rep"), "uid"), "rep").join(same.groupBy("rep").agg(F.count("*").alias("copies")), "rep")
        items = sets.withColumn("m", F.size("items"))
        named = sets.select("key", "uid")
        edges = near_duplicate_edges(texts, n, threshold, mode)
        roots = connected_components(edges.join(named.withColumnsRenamed({"key": "a", "uid": "u"}), "a").join(named.withColumnsRenamed({"key": "b", "uid": "v"}), "b").select(F.col("u").alias("a"), F.col("v").alias("b")))
    labels = same.join(roots.withColumnRenamed("node", "uid"), "uid", "left").where("copies > 1 or root is not null").select("key", "uid", F.coalesce("root", "uid").alias("root"))
    if excluded is not None:
        labels = labels.join(excluded.select("key", F.lit(True).alias("out")), "key", "left")
    else:
        labels = labels.withColumn("out", F.lit(None).cast("boolean"))
    labels = written(labels)
    best = labels.groupBy("root").agg(F.count("*").alias("n"), F.min(F.when(F.col("out").isNull(), F.struct("key", "uid"))).alias("free"), F.min(F.struct("key", "uid")).alias("any")).where("n > 1")
    reps = best.select("root", F.coalesce("free", "any").alias("r")).select("root", F.col("r.key").alias("rep"), F.col("r.uid").alias("rep_uid"))
    members = labels.join(reps, "root").select("key", "uid", "rep", "rep_uid")
    others = members.where("uid <> rep_uid").select(F.col("uid").alias("a"), F.col("rep_uid").alias("b")).distinct()
    pairs = verified(others, items, threshold).toDF("uid", "rep_uid", "similarity")
    near = members.where("uid <> rep_uid").join(pairs, ["uid", "rep_uid"]).select("key", "rep", "similarity", *more)
    kept = written(members.where("uid = rep_uid").select("key", "rep", F.lit(1.0).alias("similarity"), *more).unionByName(near))
    return kept.join(kept.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1"), "rep").select("key", "rep", "similarity", "size", *more), items, same


#: Columns of a matrix of sets and items that are multiplied at a time.
COLUMNS = 4096


def shared_items(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many items each pair of sets (arrays of distinct items) has in common, COLUMNS items at a time."""
    both = np.concatenate([*x, *y]) if x or y else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    kinds, item = np.unique(both, return_inverse=True)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    out = np.zeros((len(x), len(y)))
    for a in range(0, len(kinds), COLUMNS):
        own = slice(np.searchsorted(item, a), np.searchsorted(item, a + COLUMNS))
        held = np.zeros((len(x) + len(y), min(COLUMNS, len(kinds) - a)), np.float32)
        held[owner[own], item[own] - a] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def common_items(item: np.ndarray, owner: np.ndarray, n: int, cut: int) -> np.ndarray:
    """How many items each of the first cut of n sets (the distinct items of all, and whose each is) has in common with each of the others, or, with none
    behind the cut, with each of the n; COLUMNS items at a time."""
    order = np.argsort(item)
    item, owner = item[order], owner[order]
    at = np.cumsum(np.append(False, item[1:] != item[:-1]))[: len(item)]
    kinds = int(at[-1]) + 1 if len(at) else 0
    out = np.zeros((cut, n - cut if cut < n else n))
    for a in range(0, kinds, COLUMNS):
        own = slice(*np.searchsorted(at, [a, a + COLUMNS]))
        held = np.zeros((n, min(COLUMNS, kinds - a)), np.float32)
        held[owner[own], at[own] - a] = 1
        out += held[:cut] @ (held[cut:] if cut < n else held).T
    return out


def similarities(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The Jaccard index of each pair of sets, as jaccard() has it."""
    both = shared_items(x, y)
    sizes = np.array([len(s) for s in x], float)[:, None] + np.array([len(s) for s in y], float)[None]
    return both / (sizes - both)


def linked_texts(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """key, rep, root, n_links of each text (key, text) with tokens: the least key of those with the same set of shingles, the least key of its
    component, and how many other texts reach the threshold with it.

    The result grows with the texts and not with their pairs. Links lie inside of components; there, distinct sets meet block by block,
    where their sizes allow a link, and a task gives the number of links of each set only. near_duplicate_edges() lists single links.
    """
    sets, same = distinct_sets(shingle_sets(texts, n))
    copies = same.groupBy("rep").agg(F.count("*").alias("copies"))
    sets = written(sets)
    roots = components(sets, threshold).withColumnRenamed("node", "uid")
    own = sets.join(roots, "uid", "left").join(copies.withColumnRenamed("rep", "key"), "key").select("uid", "key", "items", "copies", F.coalesce("root", "uid").alias("root"), F.col("root").isNotNull().alias("linked"))
    own = written(own.withColumn("class", size_class(F.size("items"))))
    groups = own.where("linked").groupBy("root", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min(F.size("items")).alias("least"), F.max(F.size("items")).alias("most"))
    groups = written(groups)
    meet = groups.alias("g").join(groups.alias("h"), "root").where((F.col("g.most") >= threshold * F.col("h.least") - 1e-9) & (F.col("h.most") >= threshold * F.col("g.least") - 1e-9))  # some dozen size classes
    pairs = meet.select("root", F.col("g.class").alias("class"), F.col("h.class").alias("other"), F.col("g.blocks").alias("blocks"), F.col("h.blocks").alias("other_blocks"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    at = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    linked, cell = own.where("linked").drop("linked", "key"), ["root", "class", "other", "i", "j"]
    one = linked.join(pairs, ["root", "class"]).withColumn("i", at("blocks")).withColumn("j", every("other_blocks")).select(*cell, "uid", "items", "copies").toDF(*cell, "uid", "items", "copies")
    two = linked.withColumnRenamed("class", "other").join(pairs, ["root", "other"]).withColumn("j", at("other_blocks")).withColumn("i", every("blocks")).select(*cell, "uid", "items", "copies").toDF(*cell, "uid", "items", "copies")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        total = np.zeros(len(x), np.int64)
        if len(x) and len(y):
            held = [np.array(v, np.int64) for v in y["items"].to_pylist()]
            weight, names = y["copies"].to_numpy(), y["uid"].to_numpy()
            for a in range(0, len(x), 256):
                part = x.slice(a, 256)
                close = similarities([np.array(v, np.int64) for v in part["items"].to_pylist()], held) >= threshold
                close &= part["uid"].to_numpy()[:, None] != names[None]
                total[a : a + 256] = close @ weight
        return pa.table({"uid": x["uid"], "n": pa.array(total)})

    counts = one.groupBy(*cell).cogroup(two.groupBy(*cell)).applyInArrow(run, "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n"))
    least = own.groupBy("root").agg(F.min("key").alias("root_key"))
    full = own.join(counts, "uid", "left").join(least, "root").select(F.col("key").alias("rep"), F.col("root_key").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return same.join(full, "rep").select("key", "rep", "root", "n_links")


def text_components(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, root: texts of distinct sets, each set once by its least key, with the least key of their component; those without a link are left out."""
    sets, same = named_sets(texts, True, threshold, n)
    named = components(sets, threshold).join(same.where("key = rep").select(F.col("uid").alias("node"), "key"), "node")
    named = written(named.select("root", "key"))
    return named.join(named.groupBy("root").agg(F.min("key").alias("least")), "root").select(F.col("key").alias("node"), F.col("least").alias("root"))


def pairwise_summary(members: DataFrame, sets: DataFrame, exact_up_to: int = 256, permutations: int = 128, every: DataFrame | None = None) -> DataFrame:
    """rep, size, mean_similarity, error: of each cluster (key, rep) the mean Jaccard index of its pairs of sets (key, items). Clusters of up to
    exact_up_to members are computed in full, each in one task, with error 0; larger ones are estimated from signatures, with the standard error
    of that. Of every (key), those in no cluster come as clusters of one, with a mean of 1."""
    sizes = written(members.groupBy("rep").agg(F.count("*").alias("size")))
    own = members.select("key", "rep").join(sizes, "rep")

    def run(table: pa.Table) -> pa.Table:
        held = [np.array(v, np.int64) for v in table["items"].to_pylist()]
        value, m = similarities(held, held), len(held)
        mean = (value.sum() - np.trace(value)) / (m * (m - 1)) if m > 1 else 1.0
        return pa.table({"rep": table["rep"].slice(0, 1), "size": pa.array([m], pa.int64()), "mean_similarity": pa.array([float(mean)]), "error": pa.array([0.0])})

    schema = f"rep {members.schema['rep'].dataType.simpleString()}, size long, mean_similarity double, error double"
    exact = own.where(F.col("size") <= exact_up_to).join(sets, "key").groupBy("rep").applyInArrow(run, schema)
    large = own.where(F.col("size") > exact_up_to)
    about = mean_pairwise_jaccard(large, written(minhash(sets.join(large.select("key"), "key", "left_semi"), permutations)))
    mean = F.col("mean_similarity")
    out = exact.unionByName(about.withColumn("error", F.sqrt(mean * (1 - mean) / permutations)))
    if every is not None:
        alone = every.select("key").join(members.select("key"), "key", "left_anti")
        out = out.unionByName(alone.select(F.col("key").alias("rep"), F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("mean_similarity"), F.lit(0.0).alias("error")))
    return out


def text_pairwise_summary(texts: DataFrame, n: int, threshold: float, excluded: DataFrame | None = None) -> DataFrame:
    """rep, size, mean_similarity: of each of the clusters() of texts (key, text) the mean Jaccard index of its pairs, all of them, and each text with
    tokens that is in no cluster as a cluster of one, with a mean of 1.

    The sets are those that the clusters were found by, so that texts are not cut once more. Copies of a set count as often as they stand, but
    are compared once; one set, or two, whose similarity is known, are not compared at all. Sets of larger clusters meet by blocks of BLOCK, a pair of
    blocks at a time, so that no task holds a cluster; only the time grows with the square of a cluster's sets.
    """
    members, sets, same = clusters_and_sets(texts, n, threshold, excluded)
    own = written(members.groupBy("rep", "uid").agg(F.count("*").alias("copies"), F.max("similarity").alias("similarity")))
    c = F.col("copies")
    totals = own.groupBy("rep").agg(F.sum("copies").alias("size"), F.count("*").alias("sets"), F.sum(c * (c - 1) / 2).alias("equal"), F.sum(c * c).alias("squares"), F.min("similarity").alias("near"))
    totals = written(totals)
    compared = own.join(totals.where("sets > 2").select("rep", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")), "rep").join(sets, "uid")
    compared = compared.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = compared.select("rep", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "copies", "m", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def summed(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
            """The sums of the cells that begin at heads but the last, which is the end."""
            lists = table["items"].combine_chunks()
            ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            item, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(table)), np.diff(ends))
            m, copies = table["m"].to_numpy().astype(float), table["copies"].to_numpy().astype(float)
            block, i, j = (table[name].to_numpy() for name in ("block", "i", "j"))
            out = []
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                cut = a + int((block[a:b] == i[a]).sum()) if i[a] < j[a] else b
                x, y = (a, cut), (cut, b) if cut < b else (a, b)
                both = common_items(item[ends[a] : ends[b]], owner[ends[a] : ends[b]] - a, b - a, cut - a)
                similar = both / (m[slice(*x), None] + m[None, slice(*y)] - both)
                if i[a] == j[a]:
                    np.fill_diagonal(similar, 0)
                total = copies[slice(*x)] @ similar @ copies[slice(*y)] if i[a] == j[a] or cut < b else 0.0
                out.append(total / 2 if i[a] == j[a] else total)
            return pa.RecordBatch.from_arrays([table["rep"].take(pa.array(heads[:-1])).combine_chunks(), pa.array(out, pa.float64())], names=["rep", "total"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            held = table
            if len(table):
                rep = table["rep"].combine_chunks()
                new = pc.not_equal(rep.slice(1), rep.slice(0, len(rep) - 1)).to_numpy(zero_copy_only=False)
                for name in ("i", "j"):
                    new = new | (np.diff(table[name].to_numpy()) != 0)
                heads = np.append(0, np.flatnonzero(new) + 1)
                if len(heads) > 1:
                    yield summed(table.slice(0, heads[-1]), heads)
                    held = table.slice(heads[-1])
        if held is not None and len(held):
            yield summed(held, np.array([0, len(held)]))

    place = ["rep", "i", "j"]
    sums = cells.repartition(*place).sortWithinPartitions(*place, "block").mapInArrow(run, f"rep {members.schema['rep'].dataType.simpleString()}, total double").groupBy("rep").agg(F.sum("total").alias("total"))
    across = (F.col("size") * F.col("size") - F.col("squares")) / 2 * F.col("near")  # of two sets; of one it is 0
    full = totals.join(sums, "rep", "left").select("rep", "size", ((F.when(F.col("sets") > 2, F.col("total")).otherwise(across) + F.col("equal")) / (F.col("size") * (F.col("size") - 1) / 2)).alias("mean_similarity"))
    alone = same.select("key").join(members.select("key"), "key", "left_anti")
    return full.unionByName(alone.select(F.col("key").alias("rep"), F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("mean_similarity")))


def cluster_summary(members: DataFrame) -> DataFrame:
    """Per cluster its size and the members' mean similarity to the representative."""
    return members.groupBy("rep").agg(F.count("*").alias("size"), F.round(F.avg(F.when(F.col("key") != F.col("rep"), F.col("similarity"))), 6).alias("mean_similarity"))


def rejects(members: DataFrame) -> DataFrame:
    """All members but each cluster's least key."""
    return members.join(members.groupBy("rep").agg(F.min("key").alias("least")), "rep").where("key <> least").select("key", "rep")


def dedup_report(members: DataFrame, texts: DataFrame, masked: DataFrame) -> DataFrame:
    """Members with a preview of 100 tokens, word count, and whether they are masked."""
    joined = members.join(texts, "key").join(masked.select("key", F.lit(True).alias("m")), "key", "left")
    return joined.select("key", "rep", "similarity", "size", first_tokens(F.col("text"), 100).alias("preview"), word_count(F.col("text")).alias("n_words"), F.coalesce("m", F.lit(False)).alias("masked"))


def mask_duplicates(members: DataFrame, masked: DataFrame) -> DataFrame:
    """New masks with their reason: rejected members that no mask covers yet. A second call with them gives none."""
    return rejects(members).join(masked.select("key"), "key", "left_anti").select("key", F.concat(F.lit("near-duplicate of "), "rep").alias("reason"))


def mean_pairwise_jaccard(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per cluster (rep) its size and mean pairwise similarity, estimated as the share of equal signature places; 1 for a single member.

    Pairs with equal values are counted by place and value, so that the work grows with the members and not with their pairs.
    """
    own = members.select("key", "rep").join(signatures, "key")
    places = own.select("rep", F.posexplode("signature").alias("at", "value")).groupBy("rep", "at", "value").agg(F.count("*").alias("n"))
    equal = places.groupBy("rep").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("equal"), F.countDistinct("at").alias("places"))
    sizes = own.groupBy("rep").agg(F.count("*").alias("size"))
    mean = F.when(F.col("size") > 1, F.col("equal") / (F.col("places") * F.col("size") * (F.col("size") - 1))).otherwise(1.0)
    return sizes.join(equal, "rep").select("rep", "size", mean.alias("mean_similarity"))


def mean_pairwise_cosine(vectors: DataFrame, cluster_col: str, vector_col: str = "embedding") -> DataFrame:
    """Per cluster its size and mean pairwise cosine; 1 for a single member. The sum over all pairs is the squared length of the sum of unit
    vectors, less the members, so that no pair is formed. Null vectors and those of length 0 don't count."""
    length = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    good = vectors.select(F.col(cluster_col).alias("cluster"), F.col(vector_col).alias("v"), length.alias("length")).where("length > 0")
    sums = good.select("cluster", F.posexplode(F.transform("v", lambda x: x.cast("double"))).alias("at", "x"), "length").groupBy("cluster", "at").agg(F.sum(F.col("x") / F.col("length")).alias("s"))
    whole = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    sizes = good.groupBy("cluster").agg(F.count("*").alias("size"))
    n = F.col("size")
    return sizes.join(whole, "cluster").select("cluster", "size", F.when(n > 1, (F.col("square") - n) / (n * (n - 1))).otherwise(1.0).alias("mean_cosine"))


def largest_clusters(members: DataFrame, limit: int) -> DataFrame:
    """The largest clusters first, by size and then representative: place, rep, size."""
    top = members.groupBy("rep").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "rep").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "rep")))  # limit rows


def masked_since(members: DataFrame, masks: DataFrame) -> DataFrame:
    """Members of a stored report that masks (key) have covered since: they are shown, but no longer counted."""
    return members.join(masks.select("key"), "key", "left_semi").groupBy("rep").agg(F.count("*").alias("n_masked"))


def diverse_examples(texts: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """Up to k texts of each group (group columns, text) that are far from each other: rank 1 is the least text, each further one that whose
    greatest similarity to those chosen is least, ties to the smaller text.

    Each round picks one text of every group, with its shingles, by a grouped minimum, so that no task holds a group, and joins it with the
    others. Shingles are hashes, as in shingle_sets().
    """
    own = texts.select(*group, "text").distinct()
    rest = written(own.select(*group, "text", F.element_at(F.transform(F.array(tokens(F.col("text"))), lambda w: F.when(F.size(w) > 0, hashed_runs(w, 3)).otherwise(F.array().cast("array<bigint>"))), 1).alias("items"), F.lit(0.0).alias("near")))
    out = None
    for rank in range(1, k + 1):
        best = rest.groupBy(*group).agg(F.min_by(F.struct("text", "items"), F.struct("near", "text")).alias("p"))
        best = written(best.select(*group, F.col("p.text").alias("chosen"), F.col("p.items").alias("own")))
        one = best.select(*group, F.lit(rank).alias("rank"), F.col("chosen").alias("text"))
        out = one if out is None else out.unionByName(one)
        if rank < k:
            union = F.size(F.array_union("items", "own"))
            similar = F.when(union > 0, F.size(F.array_intersect("items", "own")) / union).otherwise(0.0)
            rest = written(rest.join(best, group).where(F.col("text") != F.col("chosen")).select(*group, "text", "items", F.greatest(F.col("near"), similar).alias("near")))
    return out


def with_word_counts(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members (key) with n_words of their texts; words are counted before texts are joined, so that no text is sent."""
    return members.join(texts.select("key", word_count(F.col("text")).alias("n_words")), "key")


def slider(report: DataFrame, least: float) -> DataFrame:
    """Members (key, rep, similarity, n_words) whose similarity per ln(words / 10 + e) reaches the slider, with their representative; clusters below two go."""
    weighed = report.withColumn("value", F.col("similarity") / F.log(F.col("n_words") / 10 + F.exp(F.lit(1.0))))
    kept = weighed.where((F.col("key") == F.col("rep")) | (F.col("value") >= least))
    return kept.withColumn("left_size", F.count("*").over(Window.partitionBy("rep"))).where("left_size > 1").select("key", "rep", "left_size")


#: Cosines of queries and vectors that a task holds at a time.
PAIRS = 1 << 20


def cosine_search(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query, vec_id, cosine: all vectors that near a stated set of queries, which is sent to the executors in blocks of bounded size.

    Null vectors, those of length 0 and those of another dimension than the query's have no neighbours.
    """
    out, pending = None, []

    def search(rows: list) -> DataFrame:
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r[1]), []).append(r)
        packed = {d: (np.array([r[0] for r in rs]), unit(np.array([r[1] for r in rs], np.float64))) for d, rs in by_dim.items() if d}
        shared = queries.sparkSession.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, names = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                for d, (ids, matrix) in shared.value.items():
                    every = np.flatnonzero(lengths == d)
                    for a in range(0, len(every), step := max(1, PAIRS // len(ids))):
                        own = every[a : a + step]
                        rows = unit(lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), d))
                        cosines = matrix @ rows.T
                        q, v = np.nonzero(cosines >= threshold)
                        keep = ids[q] != names[own[v]]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q][keep], pa.int64()), pa.array(names[own[v]][keep], pa.int64()), pa.array(cosines[q, v][keep])], names=["query", "id", "cosine"])

        return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "query long, id long, cosine double")

    for row in queries.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).toLocalIterator():
        pending.append((row[0], row[1]))
        if len(pending) == block:
            part = search(pending)
            out, pending = part if out is None else out.unionByName(part), []
    if pending or out is None:
        part = search(pending)
        out = part if out is None else out.unionByName(part)
    return out.select("query", F.col("id").alias(id_col), "cosine")


def embedding_map(vectors: DataFrame, radius: float, least: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", smallest: int = 2) -> DataFrame:
    """id, x, y and cluster: the two principal components of each vector, to draw it at, and its density cluster in the whole space, null for
    noise (see density_clusters()). Vectors that are null, empty or not finite have no place on the map; all others have one length."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fits = F.coalesce(F.size(vector_col) > 0, F.lit(False)) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.where(fits)
    own = good.select(F.col(id_col).alias("id"), array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))).alias("v"))
    at = vector_to_array(F.col("p"))
    points = PCA(k=2, inputCol="v", outputCol="p").fit(own).transform(own).select(F.col("id").alias(id_col), at[0].alias("x"), at[1].alias("y"))
    clusters = density_clusters(good, radius, least, smallest, id_col, vector_col).where("kind <> 'noise'")
    return points.join(clusters.select(id_col, "cluster").distinct(), id_col, "left")


def unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256).substr(1, 32)


def cache_lookup(items: DataFrame, cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Hits (key, vector) of items (key, content_hash) whose cached content and dimension agree, and misses."""
    good = cache.where(F.size("vector") == dim).select("key", "content_hash", "vector")
    hits = items.join(good, ["key", "content_hash"])
    return hits, items.join(good, ["key", "content_hash"], "left_anti")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new entries in place of old ones of the same key."""
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def fingerprint(texts: DataFrame) -> DataFrame:
    """One row: texts, and a hash that changes with any key or text, whatever the order of rows."""
    each = F.sha2(F.concat_ws("|", "key", content_hash(F.coalesce("text", F.lit("")))), 256)
    parts = texts.select(F.conv(each.substr(1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return parts.agg(F.count("*").alias("n_texts"), F.sum("h").cast("string").alias("fingerprint"))


def report_state(stored: DataFrame, now: DataFrame) -> DataFrame:
    """missing without a stored fingerprint, fresh where it is the present one, else stale."""
    joined = now.join(stored.select(F.col("fingerprint").alias("old")), F.lit(True), "left")  # one row each
    return joined.select(F.when(F.col("old").isNull(), "missing").when(F.col("old") == F.col("fingerprint"), "fresh").otherwise("stale").alias("state"))


def unjustified_masks(masks: DataFrame, texts: DataFrame, least: float = 0.05) -> DataFrame:
    """Masks (key, reason) whose text has a word-trigram Jaccard below `least` with the representative in the reason; 0 without trigrams;
    masks without either text are skipped."""
    named = masks.select("key", F.regexp_extract("reason", r"near-duplicate of (\S+)", 1).alias("rep")).where("rep <> ''")
    own = texts.select("key", shingles(F.col("text"), 3).alias("x"))
    other = texts.select(F.col("key").alias("rep"), shingles(F.col("text"), 3).alias("y"))
    union = F.size(F.array_union("x", "y"))
    scored = named.join(own, "key").join(other, "rep").select("key", "rep", F.when(union > 0, F.size(F.array_intersect("x", "y")) / union).otherwise(0.0).alias("similarity"))
    return scored.where(F.col("similarity") < least)


def reject_tasks(members: DataFrame, tasks: DataFrame) -> DataFrame:
    """Event rows that move accepted duplicates to rejected, and skipped ones with their status."""
    own = rejects(members).withColumn("task_id", F.col("key")).join(tasks, "task_id")
    return own.select("task_id", "rep", F.col("status").alias("previous_status"), F.when(F.col("status") == "accepted", "rejected").alias("next_status"))


def embed(texts: DataFrame, embedder, dim: int) -> DataFrame:
    """key, vector of texts (key, text): embedder maps a list of texts to a matrix, a batch at a time, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = np.asarray(embedder(batch["text"].fillna("").tolist()), np.float32)
            if matrix.shape != (len(batch), dim):
                raise ValueError(f"the embedder returned {matrix.shape}, not {(len(batch), dim)}")
            yield pd.DataFrame({"key": batch["key"], "vector": list(matrix)})

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<float>")


def random_embedder(dim: int, seed: int = 0):
    """A repeatable baseline: each text's vector depends on nothing but the text."""
    import hashlib

    def run(texts: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{t}".encode()).digest()[:8], "big")).standard_normal(dim) for t in texts]
        return unit(np.array(rows).reshape(len(texts), dim))

    return run
