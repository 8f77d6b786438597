"""Operator 1: benchmark decontamination by pigeonhole edit matching.

A test item of m characters is found where a substring of a text is within its error budget, m * RATE edits rounded down. The item is split into as many
pieces as its budget plus one; an occurrence within the budget holds one piece exactly. All pieces of all items are searched at once (Aho-Corasick). A hit is
verified upwards: pieces are the leaves of a binary tree in which a node with budget k has children whose budgets add up to k - 1, so an occurrence within k
edits holds one child within its budget. Each node on the way is searched around the hit with Myers' bit-parallel algorithm; a chance hit mostly ends at the
first node. At the root the least distance counts.

Texts and items are compared in lower case, with each run of white space as one blank. The items are a stated query set: they are collected in blocks of about
BLOCK characters, each broadcast and matched against every whole text; the driver holds one block at a time, and what a block finds is written before the next is
read. Nothing is shuffled, so no text, however common, makes a hot key.

An item of fewer than ten characters has no budget, so it's found wherever it stands exactly, also within longer words. `short` keeps such hits apart if that is asked for: items of fewer characters than
this without a budget then count only where neither a letter nor a digit stands on either side. Scripts that write without blanks have letters on either side nearly everywhere, so it is off by default,
and the query and the pipeline's stage leave it off.

Defined results: null and empty texts hold no item; null, empty and blank items are found nowhere; equal items are each reported; a repeated row is reported
as often as it is there; without items nothing is reported; other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import partial, reduce
from zlib import crc32

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, each_slice, kept, pick, small_batches, table, worker_state

RATE = 0.1
BLOCK = 1 << 19  # a worker's tree of a full block takes some 100 MB


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def apart(text: str, start: int, end: int) -> bool:
    """Whether neither a letter nor a digit stands on either side of a part of a text."""
    return not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())


class Node:
    """A part of an item with its error budget."""

    __slots__ = ("start", "end", "budget", "parent", "bits")

    def __init__(self, item: str, start: int, end: int, budget: int, parent: Node | None):
        self.start, self.end, self.budget, self.parent = start, end, budget, parent
        self.bits: dict[str, int] = defaultdict(int)
        for i in range(start, end):
            self.bits[item[i]] |= 1 << (i - start)

    def least(self, text: str, stop: int) -> int:
        """The least edit distance between this part and a substring of text; the first one found that is at most stop."""
        m = self.end - self.start
        ones, high = (1 << m) - 1, 1 << (m - 1)
        up, down, distance, best, bits = ones, 0, m, m, self.bits.get
        for c in text:
            eq = bits(c, 0)
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & ones
            hp = (down | ~(d0 | up)) & ones
            hn = up & d0
            if hp & high:
                distance += 1
            elif hn & high:
                distance -= 1
                if distance < best:
                    best = distance
                    if best <= stop:
                        return best
            hp <<= 1
            up = ((hn << 1) | ~(d0 | hp)) & ones
            down = hp & d0
        return best


def leaves(item: str, budget: int) -> list[Node]:
    """The budget + 1 pieces of an item, each with the nodes above it."""
    out, todo = [], [Node(item, 0, len(item), budget, None)]
    while todo:
        node = todo.pop()
        k = node.budget
        if not k:
            out.append(node)
            continue
        left = (k - 1) // 2
        cut = node.start + (node.end - node.start) * (left + 1) // (k + 1)
        todo += [Node(item, node.start, cut, left, node), Node(item, cut, node.end, k - 1 - left, node)]
    return out


class Matcher:
    """Finds items in texts; one per worker and block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float, short: int = 0):
        self.ids, self.short = defaultdict(list), short
        for key, text in items:
            if text := normal(text):
                self.ids[text].append(key)
        self.pieces = ahocorasick.Automaton()
        found: dict[str, list] = defaultdict(list)
        for text in self.ids:
            for leaf in leaves(text, int(rate * len(text))):
                found[text[leaf.start : leaf.end]].append((text, leaf))
        for piece, at in found.items():
            self.pieces.add_word(piece, (len(piece), at))
        if found:
            self.pieces.make_automaton()

    def find(self, text: str | None) -> dict[str, int]:
        """Items in the text, by their normal form, with their least distances."""
        text, best, seen = normal(text), {}, defaultdict(list)
        if not text or not self.ids:
            return best
        for last, (size, at) in self.pieces.iter(text):
            for item, leaf in at:
                origin = last + 1 - size - leaf.start
                if any(abs(origin - o) <= k for o, k in seen[item]) if item in seen else False:
                    continue
                if leaf.parent is None and len(item) < self.short and not apart(text, origin, last + 1):
                    continue
                distance, node, root = 0, leaf.parent, leaf
                while node is not None:
                    root, k = node, node.budget
                    # At the root all occurrences whose origin is within the budget of this one are covered, so that their hits can be passed over.
                    room, stop = (2 * k, 0) if node.parent is None else (k, k)
                    begin = origin + node.start - room
                    distance = node.least(text[max(0, begin) : max(0, begin + node.end - node.start + 2 * room)], stop)
                    if distance > k:
                        break
                    node = node.parent
                if node is None:
                    seen[item].append((origin, root.budget))
                    best[item] = min(distance, best.get(item, distance))
        return best


def _matches(docs: DataFrame, items: list[tuple[object, str]], rate: float, keep: tuple[str, ...], kind: str, short: int = 0) -> DataFrame:
    """keep, and the items found in each whole text: arrays of ids, distances and lengths."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    tag = (crc32(repr(items).encode()), rate, short)
    schema = f"{', '.join(f'`{k}` {docs.schema[k].dataType.simpleString()}' for k in keep)}, found array<struct<item_id:{kind},distance:int,length:int>>"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        m = worker_state(("items", tag), lambda: Matcher(held.value, rate, short))
        found = [[{"item_id": key, "distance": d, "length": len(item)} for item, d in m.find(t).items() for key in m.ids[item]] for t in part.column("text").to_pylist()]
        like = pa.list_(pa.struct([("item_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("distance", pa.int32()), ("length", pa.int32())]))
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(found, like)], [*keep, "found"])

    return small_batches(docs).mapInArrow(each_slice(work, "text"), schema)


def blocks(items: DataFrame) -> list[Callable[[], list[tuple[object, str]]]]:
    """What reads each block of the items."""
    items = pick(items, "item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + size // BLOCK

    def read(block: int) -> list[tuple[object, str]]:
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        return sorted(((r["item_id"], r["text"]) for r in part.collect()), key=repr)

    return [partial(read, b) for b in range(n)]


def _kind(items: DataFrame) -> str:
    kind = items.schema["item_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise ValueError(f"item_id is {kind}; bigint, int or string is asked for")
    return kind


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, keep: tuple[str, ...] = ("doc_id",), short: int = 0) -> DataFrame:
    """keep, item_id, distance and length of item for each item found in each text."""
    docs, parts, out = pick(docs, *keep, "text"), blocks(items), []
    scratch = Scratch(docs.sparkSession) if len(parts) > 1 else None
    for number, block in enumerate(parts):
        found = _matches(docs, block(), rate, keep, _kind(items), short).select(*keep, F.explode("found").alias("f")).select(*keep, "f.*")
        out.append(scratch.keep(found, f"found-{number}") if scratch else found)
    return reduce(DataFrame.unionByName, out)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, short: int = 0) -> DataFrame:
    """The rows whose texts hold no item, with all their columns."""
    parts = blocks(items)

    def judge(flat: DataFrame, names: tuple[str, ...]) -> DataFrame:
        scratch = Scratch(flat.sparkSession) if len(parts) > 1 else None
        for number, block in enumerate(parts):
            flat = _matches(pick(flat, *names), block(), rate, names, _kind(items), short).filter(F.size("found") == 0).select(*names)
            if scratch:
                flat = scratch.keep(flat, f"kept-{number}")
                scratch.only(f"kept-{number}")
        return flat

    return kept(docs, judge)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))
