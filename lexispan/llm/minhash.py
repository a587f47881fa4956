"""Near-duplicates by chosen-path set similarity join.

Every document is the set of its word shingles, with a signature of minwise values. Documents with equal sets are
one class from the start; the join works on a representative of each class. In every tree a node's documents go on
to children by the minwise tokens that the node selects: one or two positions a step, 1 / threshold on average, so
that a pair at the threshold keeps about one common path. Small nodes are compared exhaustively: the pairs of the
smallest are listed, those of up to some thousands of documents are compared inside a task, which gives out no
more links than connect what links connect, and larger ones in blocks, a task for every two of them. In a node
of more blocks than is sensible all documents are compared with one of them, take over the label of what they are
linked with, and the node branches on, DEPTH looks at most, while it holds different labels.

A path that branches once a step on average may end, so such a node would lose links the deeper it goes. What branching
connects there only saves work: the documents of nodes that were too large at the first look and still hold different labels are joined
exactly, by prefixes. Their shingles are ordered by rarity; two sets that reach the threshold share one of the first
size - least overlap + 1 shingles of both. The documents behind one such shingle are a node that is compared as above, in as many blocks as it takes.
First every document goes to the rarest shingle it shares, then, where labels still differ, to all of its prefix.
Independent trees repeat this; a node whose documents are all connected already is left out, so that a group
of near copies isn't compared again in every tree.

Candidates must agree in enough minwise positions, then links are confirmed on full sets. Of a candidate graph
first one pair for every document is confirmed; pairs inside components found so far need no confirmation.

Defined results: null and empty texts have an empty set and stay alone; texts with fewer words than a shingle are one
shingle; documents with equal texts are one class, repeated doc_ids are one document of all their sets (linked with what
any of its rows is linked with); rows with a null doc_id are left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_count, mapped, written
from .shingles import mixed, minwise, shingle_set, word_hashes

SIGNATURE = 64
ROUNDS = ((0, 1), (2, 3, 4, 5, 6, 7))  # trees; what a round connects is one label to the next
BROADCAST_IDS = 1_000_000  # ids of 8 bytes that may be broadcast
STEPS = 3  # token choices between two looks at the nodes' sizes
LEAF = 16  # documents of a node whose pairs are listed
NODE, WEIGHT = 3000, 6_000_000  # documents of a node, and shingles of them all, that one task compares exhaustively
BLOCKS = 8  # blocks of half as many that a larger node is compared in; one of more branches on
DEPTH = 3  # looks at a node that branches on; what is apart after them is joined by prefixes
FREQUENT = 100_000  # shingles whose counts are told to every task: so many can make up 1 / FREQUENT of all, each


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, column: int, k: int) -> list[np.ndarray]:
    return [shingle_set(w, k) for w in word_hashes([x.as_py() or b"" for x in batch.column(column)])]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                sets = _sets(part, 1, k)
                full = [s for s in sets if len(s)]
                rows = iter(minwise(full, SIGNATURE) if full else ())
                digests = [_digest(s) if len(s) else None for s in sets]
                marks = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())], schema=schema)

    return mapped(docs, run, "doc_id long, n_shingles long, digest binary, signature binary")


def branch(rows: DataFrame, level: int, trees: tuple[int, ...], threshold: float) -> DataFrame:
    """(node, rep, label, size) of the children of each row's node; at level 0 the rows are representatives, for all of the trees."""
    schema = pa.schema([("node", pa.int64()), ("rep", pa.int64()), ("label", pa.int64()), ("size", pa.int64())])
    more = 1 / threshold - 1  # chance of a second position

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, label, size = (batch.column(c).to_numpy() for c in ("rep", "label", "size"))
            data = batch.column("signature").to_pylist()
            if not data:
                continue
            sign = np.frombuffer(b"".join(data), np.uint32).reshape(len(data), SIGNATURE).astype(np.uint64)
            if level:
                index, path = np.arange(len(data)), batch.column("node").to_numpy().astype(np.uint64)
            else:
                index = np.tile(np.arange(len(data)), len(trees))
                path = mixed(np.repeat(np.array(trees, np.uint64) + np.uint64(1), len(data)) * np.uint64(0x1000193))
            for step in range(STEPS):
                draw = mixed(path + np.uint64(level * STEPS + step + 1))
                first = (draw % np.uint64(SIGNATURE)).astype(np.int64)
                second = (first + 1 + ((draw >> np.uint64(8)) % np.uint64(SIGNATURE - 1)).astype(np.int64)) % SIGNATURE
                both = (draw >> np.uint64(32)).astype(np.float64) < more * 2.0**32
                index, path, at = np.r_[index, index[both]], np.r_[path, path[both]], np.r_[first, second[both]]
                path = mixed(path ^ mixed((sign[index, at] << np.uint64(7)) + at.astype(np.uint64) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rep[index]), pa.array(label[index]), pa.array(size[index])], schema=schema)

    return mapped(rows, run, "node long, rep long, label long, size long")


def _agreeing(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree as those of sets at the threshold do, less four standard deviations."""
    least = SIGNATURE * threshold - 4 * (SIGNATURE * threshold * (1 - threshold)) ** 0.5
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for c in ("sa", "sb"))
            agree = (x == y).sum(axis=1).astype(np.int32)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(agree).filter(keep)], schema=schema)

    left = reps.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, "a long, b long, agree int")


def full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep and the bytes of its full set, for the wanted representatives (reps tells the digest and a doc_id of each)."""
    schema = pa.schema([("digest", pa.binary()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                sets = [s for s in _sets(part, 0, k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    # with few ids the texts stay where they are; with more, texts and ids are dealt by id
    named = written(wanted.join(reps.select("rep", "first", "digest"), "rep"), "wanted")
    few = named.count() <= BROADCAST_IDS
    ids = named.select(F.col("first").alias("doc_id")).distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
    # a doc_id may come with several texts: the digest tells which of their sets is meant
    sets = mapped(texts, run, "digest binary, members binary").dropDuplicates(["digest"])
    return sets.join(named.select("digest", "rep"), "digest").select("rep", "members")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    percent = round(threshold * 100)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                s, t = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=schema)

    left, right = (sets.select(F.col("rep").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
    return mapped(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ma", "mb"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of a link, by hooking and pointer jumping.

    Nodes of very many links and labels of very many nodes are joined by broadcast, see joined_by_count."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "links")
    degree = written(both.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "degrees")
    state = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("component")), "labels")
    while True:
        known = degree.join(state.withColumnRenamed("id", "v"), "v")
        near = joined_by_count(both, known, ["v"]).groupBy(F.col("u").alias("id")).agg(F.min("component").alias("c"))
        # what any node of a label is next to counts for all that carry it, and so does the label of that
        given = state.join(near, "id").groupBy(F.col("component").alias("label")).agg(F.min("c").alias("given"), F.count(F.lit(1)).alias("n"))
        far = given.join(state.select(F.col("id").alias("given"), F.col("component").alias("far")), "given", "left")
        moves = written(far.select("label", "n", F.least("label", "given", F.coalesce("far", "given")).alias("to")), "moves")
        if not moves.filter("to != label").limit(1).count():
            discard(both, degree, moves)
            return state
        moved = joined_by_count(state.withColumnRenamed("component", "label"), moves, ["label"]).select("id", F.col("to").alias("component"))
        before, state = state, written(moved, "labels")
        discard(before, moves)


def in_blocks(nodes: DataFrame) -> DataFrame:
    """The rows of nodes (with n and weight) once for every two blocks that are compared: node, low, high, block and the rest."""
    blocks = F.greatest(F.ceil(2 * F.col("n") / NODE), F.ceil(2 * F.col("weight") / WEIGHT), F.lit(1)).cast("int")
    alone = (F.col("n") <= NODE) & (F.col("weight") <= WEIGHT)
    dealt = nodes.withColumn("blocks", F.when(alone, 1).otherwise(blocks)).withColumn("block", F.pmod(F.xxhash64("node", "rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks", "n", "weight")


def exhaustive(nodes: DataFrame, threshold: float) -> DataFrame:
    """Confirmed links (a < b) that connect what links connect inside each node (node, low, high, block, rep, label, signature, members).

    Rows of different blocks are compared, and all where there is one block. Members that carry one label, or were connected before, aren't compared again, so near copies cost one row of
    comparisons, and at most one link for each member leaves the node."""
    percent, least = round(threshold * 100), SIGNATURE * threshold - 4 * (SIGNATURE * threshold * (1 - threshold)) ** 0.5

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        reps = rows["rep"].tolist()
        sign = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(-1, SIGNATURE)
        sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        sizes = np.array([len(s) for s in sets])
        _, apart = np.unique(rows["label"].to_numpy(), return_inverse=True)
        block, out = rows["block"].to_numpy(), []
        across = rows["low"].iat[0] != rows["high"].iat[0]
        for i in range(len(reps)):
            others = np.flatnonzero((apart != apart[i]) & (block != block[i]) if across else apart != apart[i])
            others = others[(sign[others] == sign[i]).sum(axis=1) >= least]
            if not len(others):
                continue
            flat = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            both = np.add.reduceat(sets[i][at] == flat, np.cumsum([0, *sizes[others][:-1]]), dtype=np.int64)
            for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)].tolist():
                if apart[j] != apart[i]:
                    out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
                    apart[apart == apart[j]] = apart[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return nodes.groupBy("node", "low", "high").applyInPandas(solve, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, k: int, threshold: float) -> DataFrame:
    """Confirmed links (a < b) that connect all representatives that links connect.

    The first trees run by themselves: what they connect is one label to the trees that follow."""
    found, opened, start = [], [], reps.select("rep", F.col("rep").alias("label"), "signature", "size")
    for trees in ROUNDS:
        grown, large = _grow(docs, reps, start, trees, k, threshold, found)
        found, opened = [written(_all(grown), "links")], [*opened, *large]
        if trees != ROUNDS[-1]:
            start = _labelled(reps.select("rep", "signature", "size"), found)
    return _all(by_prefixes(docs, reps, _all(opened), found, k, threshold)) if opened else found[0]


def _labelled(rows: DataFrame, found: list[DataFrame]) -> DataFrame:
    """rows with the label of what the links connect."""
    return rows.join(components(_all(found)).toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _apart(rows: DataFrame) -> DataFrame:
    """The rows (node, rep, label, size) of nodes that hold different labels, with n, weight, pivot and high of the node."""
    stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("rep", F.struct("label", "rep")).alias("pivot"))
    return rows.join(stats.filter("n > 1 and low != high").drop("low"), "node")


def _grow(docs: DataFrame, reps: DataFrame, rows: DataFrame, trees: tuple[int, ...], k: int, threshold: float, found: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """found and the links from these trees, and the rows (node, rep) of nodes that were too large at the first look."""
    found, candidates, opened = list(found), [], []
    for level in range(DEPTH):
        held = written(_apart(written(branch(rows, level, trees, threshold), "nodes")), "held")
        small = held.filter(F.col("n") <= LEAF)
        left, right = small.select("node", F.col("rep").alias("a"), F.col("label").alias("la")), small.select("node", F.col("rep").alias("b"), F.col("label").alias("lb"))
        candidates.append(written(_agreeing(left.join(right, "node").filter("a < b and la != lb").select("a", "b").distinct(), reps, threshold), "pairs"))
        beyond = held.filter(F.col("n") > LEAF)
        if not beyond.limit(1).count():
            break
        sets = written(full_sets(docs, reps, beyond.select("rep").distinct(), k), "sets")
        fits = (2 * F.col("n") <= BLOCKS * NODE) & (2 * F.col("weight") <= BLOCKS * WEIGHT)
        found.append(_compared(beyond.filter(fits), reps, sets, threshold))
        large = beyond.filter(~fits)
        if not large.limit(1).count():
            break
        opened = opened or [large.select("node", "rep")]
        # too many blocks: all against one of them, then on to the children, where labels still differ
        stars = large.filter("rep != pivot and label != high").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        found.append(written(confirmed(_agreeing(stars, reps, threshold), sets, threshold), "stars"))
        if level + 1 < DEPTH:
            rows = _labelled(large.filter("rep != pivot").select("node", "rep"), found).join(reps.select("rep", "signature", "size"), "rep")
    return _connect(docs, reps, _all(candidates), found, k, threshold), opened


def _compared(nodes: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of nodes (node, rep, label, n, weight) that are compared inside tasks."""
    rows = nodes.select("node", "rep", "label", "n", "weight").join(sets, "rep").join(reps.select("rep", "signature"), "rep")
    return written(exhaustive(in_blocks(rows), threshold), "stars")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """rep, shingle and its place in the prefix of the set: the shingles by rarity, as many as two sets at the threshold must share one of.

    Counts are told of the frequent shingles alone; those that aren't rank before them by hash. Any order keeps all pairs, this one keeps hot shingles out of prefixes."""
    percent = round(threshold * 100)
    counted, out = pa.schema([("shingle", pa.int64())]), pa.schema([("rep", pa.int64()), ("shingle", pa.int64()), ("place", pa.int32())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(members.as_py(), np.int64))], schema=counted)

    total = sets.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    counts = mapped(sets.select("members"), explode, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") > max(1, total // 8 // FREQUENT)).orderBy("shingle").toPandas()
    shingle, n = often["shingle"].to_numpy(np.int64), often["n"].to_numpy(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, members in zip(batch.column("rep").to_pylist(), batch.column("members"), strict=True):
                own = np.frombuffer(members.as_py(), np.int64)
                rank = np.zeros(len(own), np.int64)
                if len(shingle):
                    at = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
                    rank = np.where(shingle[at] == own, n[at], 0)
                size = len(own) + (-percent * len(own)) // 100 + 1  # less the least overlap, rounded up
                first = own[np.lexsort((own, rank))[:size]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, rep)), pa.array(first), pa.array(np.arange(size, dtype=np.int32))], schema=out)

    return mapped(sets.select("rep", "members"), cut, "rep long, shingle long, place int")


def by_prefixes(docs: DataFrame, reps: DataFrame, opened: DataFrame, found: list[DataFrame], k: int, threshold: float) -> list[DataFrame]:
    """found, and what else connects documents of opened nodes (node, rep) that aren't connected all."""
    sized = reps.select("rep", "size")
    left = written(_apart(_labelled(opened.join(sized, "rep"), found)).select("rep").distinct(), "open")
    if not left.limit(1).count():
        return found
    sets = written(full_sets(docs, reps, left, k), "sets")
    rows = written(prefixes(sets, threshold), "prefixes")
    several = rows.groupBy(F.col("shingle").alias("node")).agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = written(rows.withColumnRenamed("shingle", "node").join(several.select("node"), "node"), "prefixes")
    rarest = shared.groupBy("rep").agg(F.min_by("node", "place").alias("node"))
    for nodes in (rarest, shared.select("rep", "node")):
        held = _apart(_labelled(nodes.join(sized, "rep"), found))
        found = [*found, _compared(held, reps, sets, threshold)]
    return found


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _connect(docs: DataFrame, reps: DataFrame, pairs: DataFrame, found: list[DataFrame], k: int, threshold: float) -> list[DataFrame]:
    """found, and confirmed pairs as far as they join what is apart."""
    pairs = written(pairs.distinct(), "pairs")
    sets = written(full_sets(docs, reps, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), k), "sets")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
    found = [*found, written(confirmed(best, sets, threshold), "stars")]
    label = components(_all(found))
    la, lb = (label.select(F.col("id").alias(c), F.col("component").alias(f"l{c}")) for c in "ab")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left")
    rest = rest.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    return [*found, written(confirmed(rest, sets, threshold), "stars")]


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, for each row of docs."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = written(signatures(texts, k), "signatures")
    classes = signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"))
    # a doc_id may come with several texts, so a class has a number of its own; its order is that of (first, digest) in every run
    reps = written(classes.orderBy("first", "digest").withColumn("rep", F.monotonically_increasing_id()), "classes")
    member = joined_by_count(signed.filter("digest is not null").select("doc_id", "digest"), reps.select("digest", "first", "n"), ["digest"])
    first = reps.select("rep", "first")
    near = links(texts, reps, k, threshold).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").filter("x != y").select("x", "y")
    edges = near.union(member.filter("doc_id != first").select("first", "doc_id").distinct()).toDF("a", "b")
    label = components(edges)
    named = signed.select("doc_id", "n_shingles").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicate rows: the one with the smallest doc_id, rows without doc_id last.

    Rows are told apart by a number, so that copies under one doc_id or without any go, and another text under a
    doc_id that is used again stays. Rows with an empty set stay."""
    rows = written(docs.withColumn("__at", F.monotonically_increasing_id()), "rows")
    label = near_duplicates(rows.select(F.col("__at").alias("doc_id"), "text"), k, threshold).select(F.col("doc_id").alias("__at"), "component_id")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "__at")
    best = rows.select("__at", F.col("doc_id").cast("long").alias("id")).join(label, "__at").groupBy("component_id").agg(F.min(order).alias("o"))
    return rows.join(best.select(F.col("o.__at").alias("__at")), "__at", "left_semi").drop("__at")
