"""MinHash near-dedup with bottom-k sketches from one hash function.

Shingles are hashed once (64 bits); a document's sketch is the K smallest values of its set, the whole
set where it has no more. Documents with equal sets form a class, of which the first stands for all.

1. Inverted lists: sketch values are counted over all classes; values that one class alone holds can't
   make a link. Linked sets overlap in many sketch values (see `overlap`), so by prefix filtering each
   class need only be listed under its rarest values: very frequent shingles generate no candidates
   where a document has enough others. This is exact for sets of up to K; beyond, a link is missed only
   if under 27 of the union's 64 smallest values are common at similarity 0.75, a chance below 1e-8.
2. Every class of a list is paired with one class of the list, its centre: linear in the list. The
   centre is the class whose sketch values most others hold, such as the original of a family of near
   copies. Classes that share a list meet in the group of its centre, once for all lists of that centre.
3. A pair is filtered by the sketches' overlap, then by the estimate from the union's sketch; full sets
   decide, by integer counts. A group's members are compared with its centre first, in blocks of their
   own. Members that the centre is linked with are one component already; so only those that it isn't
   linked with (for copies of one text: none or few) are compared with the other members, by pairs of
   blocks in tasks of their own. No task holds a whole group, and only a spanning forest of the links
   found leaves a task.
4. Components: the least class reachable, by contraction, each round written to the shared folder.

Null or empty text, or text without words, has an empty set and is linked with nothing. Texts with
fewer words than a shingle have the sequence as one shingle. Rows with a null doc_id count after all
others, as one document; rows that repeat a doc_id give a row each. Texts that share a doc_id are
compared each (classes have numbers of their own), and all that they are linked with is one component.
An empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, discard, gram_hash, id_and_text, materialise, mix, prefix_hash, real_id, span_hash, texts_of, words

K = 64
#: Rows and bytes of text in a block of a group; texts whose sets are made at a time.
BLOCK_ROWS, BLOCK_BYTES, AT_ONCE = 384, 6 << 20, 200
#: Pairs whose unions are sketched at a time.
ESTIMATED = 8192
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles of n words as sorted hash values."""
    data = LOWER[data]
    start, end, first = words(data, off)
    h = prefix_hash(span_hash(prefix_hash(BYTE_KEYS[data]), start, end))
    grams = gram_hash(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(span_hash(h, np.array([a]), np.array([b])) if b > a else grams[:0])
    return out


def overlap(size: int, percent: int) -> int:
    """How many sketch values a set of this size must share, at least, with a set that it is linked with."""
    small = size * percent // 100
    if small < K * percent / 100 * percent / 100:  # linked sets are whole sketches too
        return -(-size * percent // 100)
    p = percent / 100
    return max(1, math.floor(K * p - 6.2 * math.sqrt(K * p * (1 - p))) + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, which tells the texts of a doc_id apart."""
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text"))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (16 bytes that equal sets share), sketch (bottom K values, as signed integers), n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(k, AT_ONCE)
                data, off = texts_of(rows.column("text"))
                sets = shingle_sets(data, off, n)
                two = [(int(s.sum()), int(mix(s ^ np.uint64(0x5555555555555555)).sum())) if len(s) else None for s in sets]
                ids = [x and (x[0] % 2**64).to_bytes(8, "big") + (x[1] % 2**64).to_bytes(8, "big") for x in two]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.binary()), pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(np.diff(off))], ["doc_id", "text_key", "n_shingles", "set_id", "sketch", "n_bytes"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_id binary, sketch array<long>, n_bytes long")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(value, doc_id, weight): what each class is listed under, and how often others hold its sketch's values."""
    values = classes.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    held = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    need = F.lit(overlap(10**9, percent))
    for size in range(K, -1, -1):
        if overlap(size, percent) != overlap(10**9, percent):
            need = F.when(F.col("n_shingles") <= size, F.ceil(F.col("n_shingles") * percent / 100)).otherwise(need)
            break
    own = (
        values.join(held, "value")
        .groupBy("doc_id", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("held"))
        .withColumn("sketched", F.least(F.col("n_shingles"), F.lit(K)))
        # values that no other class holds are the rarest of all
        .withColumn("rest", (F.col("sketched") - need + 1 - (F.col("sketched") - F.size("held"))).cast("int"))
        .filter("rest > 0")
    )
    weight = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return own.select("doc_id", weight.alias("weight"), F.explode(F.slice("held", 1, F.col("rest"))).alias("x")).select("doc_id", "weight", F.col("x.value").alias("value"))


def _forest(links: np.ndarray) -> np.ndarray:
    """Of pairs (a, b), as many as join the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for a, b in links.tolist():
        a, b = root(a), root(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            parent[b] = a
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, number, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    wide = n[number] > 1
    owner, number = owner[wide], np.unique(number[wide], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2 ** 24 are exact
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    step = 4096
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(number, (low, low + step))
        x = np.zeros((len(sets), step), np.float32)
        x[owner[a:b], number[a:b] - low] = 1
        total += x @ x.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _estimated(sketches: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many of the K least values of each pair's union both sketches hold."""
    table = np.full((len(sketches), K), np.iinfo(np.uint64).max)
    for row, x in zip(table, sketches, strict=True):
        row[: len(x)] = x
    out = np.empty(len(i), np.int64)
    for low in range(0, len(i), ESTIMATED):
        both = np.sort(np.concatenate((table[i[low : low + ESTIMATED]], table[j[low : low + ESTIMATED]]), axis=1), axis=1)
        again = both[:, 1:] == both[:, :-1]
        rank = np.arange(2, 2 * K + 1) - np.cumsum(again, axis=1)  # of distinct values
        out[low : low + ESTIMATED] = (again & (rank <= K) & (both[:, 1:] != np.iinfo(np.uint64).max)).sum(axis=1)
    return out


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) are linked: sketches and the union's sketch filter, full sets decide."""
    size = np.array([len(s) for s in sets], np.float64)
    least = np.array([overlap(int(n), percent) for n in size])
    able = np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j])
    at = np.flatnonzero(able)
    at = at[_estimated([s[:K] for s in sets], i[at], j[at]) >= np.minimum(least[i[at]], least[j[at]])]
    out = np.zeros(len(i), bool)
    if len(at) > 4 * len(sets):
        common = _counts(sets)[i[at], j[at]].astype(np.float64)
    else:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True)], np.float64)
    out[at] = 100 * common >= percent * (size[i[at]] + size[j[at]] - common)
    return out


def group_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """A spanning forest of the links in a group; of sides 0 and 1 only pairs across, unless one side is empty."""
    rough = _counts([s[:K] for s in sets])
    least = np.array([overlap(len(s), percent) for s in sets])
    able = (rough >= np.minimum(least[:, None], least)) & np.tri(len(sets), k=-1, dtype=bool).T
    if len(np.unique(side)) > 1:
        able &= side[:, None] != side
    i, j = np.nonzero(able)
    if not len(i):
        return np.zeros((0, 2), np.int64)
    yes = _linked(sets, i, j, percent)
    return _forest(np.column_stack((ids[i[yes]], ids[j[yes]])))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of all documents in links (a, b): the least id that they reach.

    Each round every document points to the least neighbour that it has, and links are drawn between
    the documents pointed to; tables are written and read again, so joins on a document with very many
    links can be split by the engine.
    """
    links = materialise(links.select("a", "b"), "links")
    steps = []
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "to")
        steps.append(to)
        half = materialise(links.join(to, "a").select(F.col("to").alias("x"), "b"), "half")
        one = half.join(to.withColumnRenamed("a", "b").withColumnRenamed("to", "y"), "b")
        before, links = links, materialise(one.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(before, half)
        if links.isEmpty():
            break
    # follow the steps back from the last: those who were pointed to last are resolved first
    done = _rooted(steps[-1])
    for to in reversed(steps[:-1]):
        known = done.select(F.col("doc_id").alias("to"), F.col("component").alias("up"))
        own = _rooted(to)
        before, done = done, materialise(own.withColumnRenamed("component", "to").join(known, "to", "left").select("doc_id", F.coalesce("up", "to").alias("component")), "components")
        discard(before, own)
    discard(*steps)
    return done


def _rooted(to: DataFrame) -> DataFrame:
    """Pointers followed to their ends by doubling; they only lead to smaller ids."""
    to, out = to.select(F.col("a").alias("doc_id"), F.col("to").alias("component")), None
    while True:
        up = to.select(F.col("doc_id").alias("component"), F.col("component").alias("up"))
        before, out = out, materialise(to.join(up, "component", "left").select("doc_id", F.coalesce("up", "component").alias("component"), F.col("component").alias("was")), "pointers")
        if before is not None:
            discard(before)
        if out.filter("component <> was").isEmpty():
            return out
        to = out.select("doc_id", "component")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (whether it is the document itself)."""
    signed = materialise(signatures(docs, n), "signatures")
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("set_id", "x.doc_id", "x.text_key")
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    first = signed.dropDuplicates(["doc_id", "text_key"]).join(classes.select("doc_id", "text_key", "class"), ["doc_id", "text_key"])
    # from here to the comparison, doc_id is the number of a class and id the first document's
    first = first.select(F.col("class").alias("doc_id"), F.col("doc_id").alias("id"), "text_key", "n_shingles", "sketch", "n_bytes")
    lists = materialise(_prefixes(first.select("doc_id", "n_shingles", "sketch"), percent), "lists")
    centres = lists.groupBy("value").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("no"))).alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    centres = materialise(centres.select("value", (-F.col("x.no")).alias("centre")), "centres")
    met = lists.join(centres, "value").select("centre", "doc_id").distinct()
    met = materialise(met.join(first.select("doc_id", "id", "text_key", "n_bytes"), "doc_id"), "met")
    discard(lists, centres)
    texts = _keyed(docs).withColumnRenamed("doc_id", "id")
    needed = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int")
    deal = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")

    # each member with its centre, which goes to all blocks of its group
    others = met.filter("doc_id <> centre")
    blocks = materialise(others.groupBy("centre").agg(needed().alias("blocks")), "blocks")
    hubs = met.filter("doc_id = centre").join(blocks, "centre").select("centre", "doc_id", "id", "text_key", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    star = others.join(blocks, "centre").withColumn("own", deal("blocks")).select(*hubs.columns).unionByName(hubs).join(texts, ["id", "text_key"])

    def with_centre(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("doc_id").to_numpy()
        ids, at = np.unique(ids, return_index=True)  # rows that repeat
        t = t.take(pa.array(at))
        hub = int(np.searchsorted(ids, key[0].as_py()))
        members = np.flatnonzero(np.arange(len(ids)) != hub)
        sets = shingle_sets(*texts_of(t.column("text")), n)
        yes = _linked(sets, np.full(len(members), hub), members, percent)
        kept = t.take(pa.array(members)).select(["centre", "doc_id", "id", "text_key", "n_bytes"])
        return kept.append_column("hub", pa.array(np.full(len(members), t.column("id")[hub].as_py()))).append_column("linked", pa.array(yes))

    tried = star.groupBy("centre", "own").applyInArrow(with_centre, "centre long, doc_id long, id long, text_key long, n_bytes long, hub long, linked boolean")
    tried = materialise(tried, "tried")
    links = tried.filter("linked and hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b"))

    # members that their centre isn't linked with, against all others: blocks of them first, then of the linked ones
    loose = F.when(~F.col("linked"), True)
    dealt = tried.groupBy("centre").agg(
        *[F.coalesce(F.greatest(F.ceil(F.count(c) / BLOCK_ROWS), F.ceil(F.sum(F.when(c, F.col("n_bytes"))) / BLOCK_BYTES)), F.lit(0)).cast("int").alias(name) for c, name in ((loose, "loose"), (F.when(F.col("linked"), True), "tied"))],
        F.count(F.lit(1)).alias("n"),
    )
    dealt = materialise(dealt.filter("loose > 0 and n > 1").select("centre", "loose", "tied"), "dealt")
    own = F.when(F.col("linked"), F.col("loose") + deal("tied")).otherwise(deal("loose"))
    partners = F.sequence(F.lit(0), F.when(F.col("linked"), F.col("loose")).otherwise(F.col("loose") + F.col("tied")) - 1)
    rest = tried.join(dealt, "centre").withColumn("own", own).withColumn("other", F.explode(partners))
    rest = rest.select("doc_id", "id", "text_key", "centre", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        ids, side = t.column("doc_id").to_numpy(), t.column("own").to_numpy()
        ids, at = np.unique(ids, return_index=True)
        t, side = t.take(pa.array(at)), side[at]
        if key[1] != key[2] and side.min() == side.max():  # the other block is empty
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = shingle_sets(*texts_of(t.column("text")), n)
        out = t.column("id").to_numpy()[group_links(np.arange(len(ids)), sets, side, percent)]
        out = out[out[:, 0] != out[:, 1]]
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    links = links.union(rest.join(texts, ["id", "text_key"]).groupBy("centre", "low", "high").applyInArrow(compare, "a long, b long"))
    # documents with several texts link these texts' classes
    kinds = signed.groupBy("doc_id").agg(F.min(x := F.coalesce(F.xxhash64("set_id"), F.lit(0))).alias("low"), F.max(x).alias("high"))
    several = materialise(kinds.filter("low <> high").select("doc_id"), "several")
    own = full.select("doc_id", "set_id").join(several, "doc_id", "left_semi").distinct().join(classes.select("set_id", F.col("doc_id").alias("b")), "set_id")
    found = components(links.union(own.select(F.col("doc_id").alias("a"), "b").filter("a <> b")))
    of_class = materialise(classes.join(found, "doc_id", "left").select("set_id", F.coalesce("component", "doc_id").alias("component_id")), "members")
    out = signed.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id", "left")
    # texts without words go with the others of their document
    rest = several.join(found, "doc_id").select("doc_id", "component")
    out = out.filter("n_shingles > 0").unionByName(out.filter("n_shingles = 0").join(rest, "doc_id", "left").withColumn("component_id", F.col("component")).drop("component"))
    return out.select(real_id(F.col("doc_id")).alias("doc_id"), "n_shingles", real_id(F.coalesce("component_id", "doc_id")).alias("component_id"), (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"))
