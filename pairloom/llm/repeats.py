"""Repeated byte strings by a distributed difference cover.

A suffix array is built only as deep as the question asks (``length`` bytes) and only where it can
matter. With a perfect difference set D modulo ``period``, any two positions have a distance below
``period`` at which both are sampled (their place in the document modulo ``period`` is in D).

1. *Sample.* Each sampled suffix is named by its first ``length - period + 1`` bytes, and all names
   are sorted. A suffix with a name of its own has no repeat and leaves.
2. *Recurse on names.* What stays is named again, by (name, wider context), and sorted again. Two
   suffixes of one context repeat each other over the whole context. A name with one context only
   is settled; each context of the others keeps one suffix, so copies do not grow the next step.
3. *Merge the remaining suffixes.* Every suffix that reaches such a kept sample within ``period``
   is named by its first ``length`` bytes and sorted; equal neighbours have a common prefix of at
   least ``length`` bytes.

Every repeat is found: two equal strings have a common sampled offset, there they share the name,
and either they share the context (2) or both contexts keep a suffix that sends the string (3).
Names are hashes: 48 bits where a false match only costs work, 96 and 64 bits where it would count.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm import shards as sh
from pairloom.llm.components import written

LENGTH = 400
ORDER = 11  # of the field: period 133, 12 sampled residues
NAME_BITS = 48
SAMPLE, CONTEXT, REST = 1, 2, 3
RESULT = (
    "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,stop:int>>, "
    "kept_sha256 string, kept binary"
)


@lru_cache(maxsize=4)
def difference_set(q: int) -> tuple[int, tuple[int, ...]]:
    """A perfect difference set modulo q*q + q + 1 for a prime q (Singer's construction).

    The powers of a root of a cubic over the field of q elements that lie in a plane; cubics are
    tried until every difference occurs exactly once.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = ((x[2] * c) % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len({(i - j) % v for i in found for j in found if i != j}) == v - 1 and len(found) == q + 1:
                    return v, tuple(found)
    raise ValueError(f"no difference set of order {q}")


def _grams16(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    n = len(data) - 7
    if n <= 8:
        return np.zeros(0, np.uint64)
    words = np.empty(n, np.uint64)
    for s in range(min(8, n)):
        whole = (len(data) - s) // 8
        words[s::8] = data[s : s + 8 * whole].view("<u8")[: len(words[s::8])]
    low = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    low ^= low >> np.uint64(32)
    low += words[8:]
    return sh.mix(low)


def _fold(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    acc = (acc ^ value) * np.uint64(0xD6E8FEB86659FD93)
    return acc ^ (acc >> np.uint64(32))


class _Suffixes:
    """The suffixes of one shard under one length and cover."""

    def __init__(self, shard: sh.Shard, length: int, order: int) -> None:
        self.period, cover = difference_set(order)
        self.length, self.name_length = length, length - self.period + 1
        if self.name_length < 16:
            raise ValueError(f"length {length} needs a smaller difference cover than order {order}")
        self.shard = shard
        self.grams = _grams16(shard.data)
        offsets = np.asarray(cover, np.int64)
        where, ends, begins = [], [], []
        for start, size in zip(shard.starts[:-1], shard.sizes, strict=True):
            if size >= length:
                last = size - self.name_length
                at = (np.arange(0, last + 1, self.period)[:, None] + offsets[None, :]).ravel()
                at = at[at <= last]
                where.append(at + start)
                begins.append(np.full(len(at), start))
                ends.append(np.full(len(at), start + size))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.at, self.begin, self.end = join(where), join(begins), join(ends)

    def _hash(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        acc = np.full(len(at), seed, np.uint64)
        for step in [*range(0, size - 15, 16), *([size - 16] if size % 16 else [])]:
            acc = _fold(acc, self.grams[at + step])
        return sh.mix(acc)

    def names(self) -> np.ndarray:
        return self._hash(self.at, self.name_length, 1) >> np.uint64(64 - NAME_BITS)

    def contexts(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the context of the picked samples, and its bounds, cut at the document's ends."""
        at, begin, end = self.at[pick], self.begin[pick], self.end[pick]
        lo = np.maximum(begin, at - (self.period - 1))
        hi = np.minimum(end, at + self.length)
        acc = ((at - lo) * 1024 + (hi - at)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for step in range(-(self.period - 1), self.length, 16):
            acc = _fold(acc, self.grams[np.clip(at + step, lo, hi - 16)])
        acc = _fold(acc, self.grams[hi - 16])
        return sh.mix(acc) >> np.uint64(64 - NAME_BITS), lo, hi

    def windows(self, at: np.ndarray) -> np.ndarray:
        return self._hash(at, self.length, 3)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return u, inverse.reshape(-1), counts


def _is_shared(names: np.ndarray, extras: list, owner: np.ndarray) -> np.ndarray:
    _, inverse, counts = _distinct(names)
    return counts[inverse] > 1


def _judge_contexts(names: np.ndarray, extras: list, owner: np.ndarray) -> np.ndarray:
    """Bit 1: another shard has the context. Bit 2: the name has several, and this shard is its first."""
    context = np.frombuffer(b"".join(extras), "<u8")
    order = np.lexsort((owner, context, names))
    n, c = names[order], context[order]
    new_name = np.r_[True, n[1:] != n[:-1]]
    first = new_name | np.r_[True, c[1:] != c[:-1]]
    run = np.cumsum(first) - 1
    several_owners = np.bincount(run)[run] > 1
    group = np.cumsum(new_name) - 1
    several_contexts = np.bincount(group, weights=first)[group] > 1
    out = np.empty(len(names), np.uint8)
    out[order] = several_owners | ((several_contexts & first) << 1)
    return out


class _Rounds:
    """What a shard knows after each round. Every round repeats the earlier ones from the notes."""

    def __init__(self, shard: sh.Shard, length: int, order: int) -> None:
        self.suffixes = _Suffixes(shard, length, order)
        self.names, self.inverse, self.counts = _distinct(self.suffixes.names())

    def flagged(self, bits: np.ndarray) -> None:
        """Samples whose name occurs elsewhere, here or in another shard."""
        shared = (self.counts > 1) | (bits > 0)
        self.pick = np.flatnonzero(shared[self.inverse])
        context, self.lo, self.hi = self.suffixes.contexts(self.pick)
        name = self.names[self.inverse[self.pick]]
        order = np.lexsort((context, name))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(name[order]) != 0) | (np.diff(context[order]) != 0)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1
        self.entry_first = order[first]
        self.entry_name, self.entry_context = name[self.entry_first], context[self.entry_first]

    def settled(self, bits: np.ndarray) -> None:
        """Spans of repeated contexts, and the positions whose strings are still to be compared."""
        here = np.bincount(self.entry, minlength=len(self.entry_first)) > 1
        certain = (here | ((bits & 1) > 0))[self.entry]
        self.spans = np.stack((self.lo[certain], self.hi[certain]), 1)
        keep = self.entry_first[(bits & 2) > 0]
        at, lo = self.suffixes.at[self.pick[keep]], self.lo[keep]
        last = np.minimum(at, self.suffixes.end[self.pick[keep]] - self.suffixes.length)
        marks = np.zeros(len(self.suffixes.shard.data) + 1, np.int32)
        np.add.at(marks, lo, 1)
        np.add.at(marks, last + 1, -1)
        self.rest = np.flatnonzero(np.cumsum(marks) > 0)
        self.windows, self.window_of, self.window_counts = _distinct(self.suffixes.windows(self.rest))

    def covered(self, bits: np.ndarray) -> np.ndarray:
        again = ((self.window_counts > 1) | (bits > 0))[self.window_of]
        marks = np.zeros(len(self.suffixes.shard.data) + 1, np.int32)
        at = self.rest[again]
        np.add.at(marks, np.concatenate((self.spans[:, 0], at)), 1)
        np.add.at(marks, np.concatenate((self.spans[:, 1], at + self.suffixes.length)), -1)
        return np.cumsum(marks[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, order: int = ORDER, keep_bytes: bool = True) -> DataFrame:
    """Find every byte of ``text`` covered by a string of ``length`` bytes that starts elsewhere too.

    Returns one row per input row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (maximal
    removed runs, byte offsets), ``kept_sha256`` and, if asked for, ``kept`` (the remaining bytes).
    A null text counts as empty; texts shorter than ``length`` stay whole. Matches never cross rows,
    and ids may be null or repeat: rows are told apart by their place in the shard table.
    """
    shards = sh.pack(docs)
    buckets = sh.bucket_count(docs)

    def sample(shard: sh.Shard):
        now = _Rounds(shard, length, order)
        yield sh.rows_batch(sh.send_names(shard.shard, now.names, None, buckets, NAME_BITS), sh.NAMES_ARROW)

    def context(shard: sh.Shard, notes: pa.Table):
        now = _Rounds(shard, length, order)
        now.flagged(sh.notes_of(notes, SAMPLE))
        rows = sh.send_names(shard.shard, now.entry_name, now.entry_context, buckets, NAME_BITS)
        yield sh.rows_batch(rows, sh.NAMES_ARROW)

    def rest(shard: sh.Shard, notes: pa.Table):
        now = _Rounds(shard, length, order)
        now.flagged(sh.notes_of(notes, SAMPLE))
        now.settled(sh.notes_of(notes, CONTEXT))
        yield sh.rows_batch(sh.send_names(shard.shard, now.windows, None, buckets, 64), sh.NAMES_ARROW)

    def finish(shard: sh.Shard, notes: pa.Table):
        now = _Rounds(shard, length, order)
        now.flagged(sh.notes_of(notes, SAMPLE))
        now.settled(sh.notes_of(notes, CONTEXT))
        yield _result(shard, now.covered(sh.notes_of(notes, REST)), keep_bytes)

    sampled = sh.answer(sh.per_shard(shards, sample, sh.NAMES_SCHEMA), SAMPLE, _is_shared)
    # The answers of a round are written: a lost executor repeats one round, not all of them.
    notes = written(sampled, "notes")
    named = sh.answer(sh.with_notes(shards, notes, context, sh.NAMES_SCHEMA), CONTEXT, _judge_contexts)
    notes = notes.union(written(named, "notes"))
    merged = sh.answer(sh.with_notes(shards, notes, rest, sh.NAMES_SCHEMA), REST, _is_shared)
    return sh.with_notes(shards, notes.union(merged), finish, RESULT)


def _result(shard: sh.Shard, covered: np.ndarray, keep_bytes: bool) -> pa.RecordBatch:
    rows = []
    for i in range(len(shard)):
        lo, hi = shard.starts[i], shard.starts[i + 1]
        gone = covered[lo:hi]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        kept = shard.data[lo:hi][~gone].tobytes() if len(edges) else shard.data[lo:hi].tobytes()
        spans = [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)]
        rows.append(
            (
                shard.ids[i], int(hi - lo), int(hi - lo) - len(kept), len(spans), spans,
                hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None,
            )
        )
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    schema = pa.schema(
        [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
         ("spans", pa.list_(span)), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    )
    return sh.rows_batch(rows, schema)
