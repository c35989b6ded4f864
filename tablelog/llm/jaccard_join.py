"""N-gram Jaccard join over a token-group matrix.

A document's set holds its distinct 5-word shingles; two documents link when
100 * intersection >= 80 * union. The result is exact:

1. Documents with equal sets are one class; only classes are compared.
2. Shingles are dealt by hash to count in how many classes each occurs, as
   packed blocks and not as rows. A linked pair must share a shingle among the
   rarest fifth (plus one) of either set, so a class with enough shingles of
   its own has no partner, and the others keep only that rare prefix. Shingles
   that a bounded sample shows to be very common come last in that order
   uncounted, so they never gather in one task; classes made of little else
   meet in them in salted lists whose leaders meet again.
3. Classes that share prefix shingles are partitioned into groups of similar
   documents around a leader, bounded in shingles and documents. A group's task
   holds the union of its shingles (a row of the token-group matrix) and under
   each of them the members that have it: a document's overlap with the union
   bounds that with every member, and only where it suffices members are
   counted. Leaders visit all groups of those they lead.
4. What remains are documents that share a prefix shingle with one of another
   group and another component: whoever is not of a shingle's largest component
   asks the groups of all others that have it, as rows of (document, group) and
   never of two documents. A group that many ask goes to several tasks. No
   bucket, group or list has a cap.

Defined results: a null or empty text, or one without words, has the empty set
and is its own component; fewer than five words make one shingle; a null id has
a null component and links nothing; rows that repeat an id are one document;
repeated texts link; an empty table gives an empty one; further columns,
whatever their names, are not read. Shingles and sets are told apart by 64 and
128 bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.components import Forest, components
from tablelog.llm.store import discard, partitions_for, spread_join, written
from tablelog.llm.textbuf import mix64, shingle_sets, slices, tidy

_U = np.uint64
#: Shingles and documents of a group, which one task opens at a time, and shingles of those that ask it in one task.
GROUP_SHINGLES, GROUP_DOCUMENTS, ASKING_SHINGLES = 150_000, 4000, 1_000_000
#: Classes with a partner up to which their ids are broadcast (16 bytes each); beyond, a shuffled join.
BROADCAST_IDS = 2_000_000
#: Documents sampled for very common shingles, and the share of them from which a shingle counts as such.
SAMPLE, COMMON = 2000, 0.01


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < 80 * len(b):
        return False
    n = overlap(a, b)
    return 100 * n >= 80 * (len(a) + len(b) - n)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many of `a` are in `b`; both sorted and distinct."""
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Of a set of n: its rarest so many meet those of any linked set."""
    return n - (4 * n + 4) // 5 + 1


def _sets(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n, sig) of every row; sig is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary())], names=["id", "n", "sig"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(tidy(run), f"id {kind}, n long, sig binary")


_BLOCK = "r int, tok binary, high binary, node binary, size binary, common binary, run binary"


def _reaches(size: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether a set's prefix reaches its common shingles."""
    size, common = size.astype(np.int64), common.astype(np.int64)
    return (common > 0) & (size - common < prefix_length(size) + 2)


def _runs(node: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)


def _narrow(v: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs: most blocks need one or two."""
    most = int(v.max()) if len(v) else 0
    return v.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.uint32)


def _blocks(r: np.ndarray, tok: np.ndarray, node: np.ndarray, size: np.ndarray, common: np.ndarray, high: np.ndarray) -> pa.RecordBatch | None:
    """One packed row for each receiver; size and common belong to the node."""
    if not len(r):
        return None
    order = np.argsort(r, kind="stable")
    r, tok, node, size, common, high = r[order], tok[order], node[order], size[order].astype(np.uint32), common[order].astype(np.uint32), high[order]
    cut = np.append(_runs(r), len(r)).tolist()
    rows: list[list] = [[] for _ in range(7)]
    for a, b in zip(cut, cut[1:]):
        first = _runs(node[a:b])
        for out, v in zip(rows, (int(r[a]), tok[a:b].tobytes(), high[a:b].tobytes(), node[a:b][first].tobytes(), _narrow(size[a:b][first]), _narrow(common[a:b][first]), _narrow(np.diff(np.append(first, b - a))))):
            out.append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(v, pa.binary()) for v in rows[1:])], names=["r", "tok", "high", "node", "size", "common", "run"])


def _unpack(batches: Iterator[pa.RecordBatch], n: int, tok_type, high_type) -> tuple[tuple[np.ndarray, ...], list[pa.RecordBatch]]:
    """Entries of a partition's blocks (receiver, token, high part, node, set size, common shingles of the set), and the blocks of salted lists, which only pass."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    salted = []
    for batch in batches:
        passing = pc.greater_equal(batch.column(0), n)
        if pc.any(passing).as_py():
            salted.append(batch.filter(passing))
            batch = batch.filter(pc.invert(passing))
        for r, tok, high, node, size, common, run in zip(*(c.to_pylist() for c in batch.columns)):
            node = np.frombuffer(node, np.int64)
            run, size, common = (_wide(v, len(node)) for v in (run, size, common))
            tok = np.frombuffer(tok, tok_type)
            for out, v in zip(parts, (np.full(len(tok), r, np.uint32), tok, np.frombuffer(high, high_type), np.repeat(node, run), np.repeat(size, run), np.repeat(common, run))):
                out.append(v)
    kinds = (np.uint32, tok_type, high_type, np.int64, np.uint32, np.uint32)
    out = []
    for p, k in zip(parts, kinds):
        out.append(np.concatenate(p) if p else np.zeros(0, k))
        p.clear()  # the blocks go before the next column is joined
    return tuple(out), salted


def _common(documents: DataFrame, text_column: str) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a bounded sample have; any set gives right results, this one spreads work."""
    rows = documents.where(F.col(text_column).isNotNull())
    share = min(1.0, SAMPLE / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64(text_column), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(text_column).alias("text")).limit(2 * SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                sets = shingle_sets(batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["tok"])

    found = some.mapInArrow(tidy(run), "tok long").groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= max(20, int(COMMON * SAMPLE))).select("tok")
    return np.sort(found.toArrow().column("tok").to_numpy().view(np.uint64))


def _deal(n: int, shared, hold: int = 250_000):
    """Texts to blocks of (shingle, class), dealt by shingle; a task sends each set once.

    Receivers from n on are those of salted lists: there go the common shingles
    of classes whose prefix reaches them, as places in the table of common ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen: set[bytes] = set()
        cold: list[np.ndarray] = []
        hot: list[np.ndarray] = []
        about: list[tuple[int, int, int]] = []  # node, set size, common shingles

        def flush() -> Iterator[pa.RecordBatch]:
            node, size, common = (np.array(c, np.int64) for c in zip(*about))
            for shingles, salted in ((cold, False), (hot, True)):
                count = np.array([len(s) for s in shingles], np.int64)
                h = np.concatenate(shingles)
                who = np.repeat(node, count)
                r = (mix64(h * _U(n) + who.view(np.uint64) % _U(n)) % _U(n) + _U(n)) if salted else ((h >> _U(32)) * _U(n)) >> _U(32)
                out = _blocks(r.astype(np.int32), h.astype(np.uint64 if salted else np.uint32), who, np.repeat(size, count), np.repeat(common, count), np.zeros(len(h), np.uint8) if salted else ((h >> _U(32)) & _U(255)).astype(np.uint8))
                if out is not None:
                    yield out
            for x in (cold, hot, about):
                x.clear()

        waiting = 0
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 19):
                for s in shingle_sets(batch.column(0).slice(a, b - a)):
                    sig = digest(s)
                    if not len(s) or sig in seen:
                        continue
                    seen.add(sig)
                    place = np.searchsorted(known, s)
                    is_hot = known[np.minimum(place, len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
                    more = max(0, int(prefix_length(np.int64(len(s)))) + 2 - int((~is_hot).sum()))
                    cold.append(s[~is_hot])
                    hot.append(place[is_hot][:more].astype(np.uint64))
                    about.append((node_of(sig), len(s), int(is_hot.sum())))
                    waiting += len(s)
                if waiting > hold:
                    yield from flush()
                    waiting = 0
        if about:
            yield from flush()

    return run


def _shared(n: int):
    """Blocks of one shingle range to blocks of (shingle, classes that have it), dealt by class; shingles of one class go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (r, low, high, node, size, common), salted = _unpack(batches, n, np.uint32, np.uint8)
        yield from salted
        tok = (r.astype(np.uint64) << _U(40)) | (high.astype(np.uint64) << _U(32)) | low
        del r, low, high
        order = np.argsort(tok)
        sorted_ = tok[order]
        twice = np.zeros(len(tok), bool)
        same = sorted_[1:] == sorted_[:-1]
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        del order, sorted_, same
        twice |= _reaches(size, common)  # their own shingles are told to them too
        tok, node, size, common = tok[twice], node[twice], size[twice], common[twice]
        order = np.lexsort((node, tok))
        tok, node, size, common = tok[order], node[order], size[order], common[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])  # a class that several tasks sent counts once
        tok, node, size, common = tok[new], node[new], size[new], common[new]
        first = _runs(tok)
        df = np.diff(np.append(first, len(tok)))
        df = np.repeat(df, df)
        keep = (df > 1) | _reaches(size, common)
        tok, node, size, common, df = tok[keep], node[keep], size[keep], common[keep], df[keep]
        order = np.argsort(node, kind="stable")
        tok, node, size, common, df = tok[order], node[order], size[order], common[order], df[order]
        out = _blocks((node.view(np.uint64) % _U(n)).astype(np.int32), tok, node, size, common, np.minimum(df, (1 << 32) - 1).astype(np.uint32))
        if out is not None:
            yield out

    return run


def _prefixes(n: int):
    """Blocks of classes to blocks of their rare prefix, dealt by shingle; classes without a possible partner go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, tok, df, node, size, common), salted = _unpack(batches, n, np.uint64, np.uint32)
        yield from salted
        order = np.lexsort((tok, df, node))
        tok, node, size, common = tok[order], node[order], size[order].astype(np.int64), common[order].astype(np.int64)
        first = _runs(node)
        count = np.diff(np.append(first, len(node)))
        rank = np.arange(len(node)) - np.repeat(first, count)
        many = df[order] > 1
        shared = np.add.reduceat(many, first) if len(first) else count
        alone = size - common - np.repeat(shared, count)
        rank -= np.repeat(count - shared, count)  # shingles of this class alone stand first
        keep = many & (rank < prefix_length(size) + 2 - alone)  # 2 more, should shingles collide
        own = first[_reaches(size[first], common[first])]  # these also report how many shingles are theirs alone
        tok = np.concatenate([tok[keep], node[own].view(np.uint64)])
        high = np.repeat(np.array([0, 1], np.uint8), [keep.sum(), len(own)])
        node, size, alone = (np.concatenate([v[keep], v[own]]) for v in (node, size, alone))
        out = _blocks((mix64(tok) % _U(n)).astype(np.int32), tok, node, size, alone, high)
        if out is not None:
            yield out

    return run


def _meet(n: int):
    """Blocks of prefix shingles to the lists of classes that meet in one.

    Equal lists become one with their number. Salted lists stay as they are: all
    that belong to one common shingle share their name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, tok, high, node, _, alone), salted = _unpack(batches, n, np.uint64, np.uint8)
        yield from _lists(tok[high == 0], node[high == 0], alone[high == 0], None)
        yield from _listed(mix64(tok[high == 1]), np.arange((high == 1).sum() + 1), node[high == 1], alone[high == 1], np.ones((high == 1).sum(), np.int64), False)
        hot = [pa.RecordBatch.from_arrays([pc.subtract(b.column(0), pa.scalar(n, pa.int32())), *b.columns[1:]], names=b.schema.names) for b in salted]
        (_, tok, _, node, size, common), _ = _unpack(iter(hot), n, np.uint64, np.uint8)
        yield from _lists(tok, node, size - common, node.view(np.uint64) % _U(n))

    return run


def _lists(tok: np.ndarray, node: np.ndarray, score: np.ndarray, salt: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Classes by shingle and salt; those with the fewest shingles of their own first, as they are likest to the rest."""
    if not len(tok):
        return
    common = salt is not None
    salt = salt if common else np.zeros(len(tok), np.uint64)
    order = np.lexsort((node, score, salt, tok))
    tok, node, score, salt = tok[order], node[order], score[order], salt[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
    tok, node, score, salt = tok[new], node[new], score[new], salt[new]
    first = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])]))
    count = np.diff(np.append(first, len(tok)))
    if common:
        names, pick, weight = mix64(tok[first] + _U(1 << 40)), np.arange(len(first)), np.ones(len(first), np.int64)
    else:
        many = np.flatnonzero(count > 1)
        names, one, weight = np.unique(np.add.reduceat(mix64(node.view(np.uint64)), first)[many], return_index=True, return_counts=True)
        pick = many[one]
    lengths = count[pick]
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first[pick], lengths)
    yield from _listed(names, np.concatenate([[0], np.cumsum(lengths)]), node[place], score[place], weight, common)


def _listed(names: np.ndarray, offsets: np.ndarray, node: np.ndarray, score: np.ndarray, weight: np.ndarray, common: bool) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(names), 2000):
        b = min(a + 2000, len(names))
        at = pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(at, pa.array(v[offsets[a] : offsets[b]].astype(np.int64))) for v in (node, score)]
        yield pa.RecordBatch.from_arrays([pa.array(names[a:b].view(np.int64)), *arrays, pa.array(weight[a:b].astype(np.int64)), pa.array(np.full(b - a, common))], names=["list", "members", "scores", "weight", "common"])


class Group:
    """One row of the token-group matrix: the union of a group's shingles, and under each the members that have it."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]):
        self.nodes, self.sets = nodes, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        everything = np.concatenate(sets)
        order = np.argsort(everything, kind="stable")
        self.have = np.repeat(np.arange(len(sets)), self.sizes)[order]
        first = _runs(everything[order])
        self.union = everything[order][first]
        self.first = np.append(first, len(order))

    def links(self, s: np.ndarray) -> np.ndarray:
        """Members that link with the set; those of a group whose union can't give four fifths of the set are never looked at."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == s]
        if 100 * len(at) < 80 * len(s):
            return np.zeros(0, np.int64)
        count = self.first[at + 1] - self.first[at]
        place = np.arange(count.sum()) + np.repeat(self.first[at] - (np.cumsum(count) - count), count)
        both = np.bincount(self.have[place], minlength=len(self.nodes))
        return np.flatnonzero(100 * both >= 80 * (len(s) + self.sizes - both))


def resolve(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect a group's documents exactly as all their links do."""
    group, known = Group(nodes, sets), Forest()
    return [(nodes[q], nodes[m]) for q in range(len(nodes)) for m in group.links(sets[q]).tolist() if m != q and known.join(nodes[q], nodes[m])]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, node, set), sorted by home, to the links within each group."""
    home, nodes, sets = None, [], []
    for batch in batches:
        for at, node, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if at != home:
                if len(nodes) > 1:
                    yield _edges(resolve(nodes, sets))
                home, nodes, sets = at, [], []
            nodes.append(node)
            sets.append(np.frombuffer(blob.as_py(), np.uint64))
    if len(nodes) > 1:
        yield _edges(resolve(nodes, sets))


def _ask_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, part, asks, node, label, set), a group's members before those that ask it, to links between unlike labels."""
    home, group, nodes, labels, sets, known = None, None, [], [], [], Forest()
    for batch in batches:
        found = []
        for at, asks, node, label, blob in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), *(batch.column(k).to_pylist() for k in (2, 3, 4)), batch.column(5)):
            if at != home:
                home, group, nodes, labels, sets, known = at, None, [], [], [], Forest()
            s = np.frombuffer(blob.as_py(), np.uint64)
            if not asks:
                nodes.append(node)
                labels.append(label)
                sets.append(s)
                continue
            group = group or (Group(nodes, sets) if nodes else None)
            found += [(node, nodes[m]) for m in (group.links(s).tolist() if group else ()) if labels[m] != label and known.join(label, labels[m])]
        if found:
            yield _edges(found)


def _homes(meeting: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, leader, n, home) of every class that meets another, and (home, node) of leaders that visit the groups of those they lead.

    A class goes with the leader that it meets most, and families go together
    whose leaders' longest list is the same. GROUP_SHINGLES and GROUP_DOCUMENTS
    bound a home: larger companies are dealt by family, larger families by class.
    """
    led = written(meeting.groupBy("node", "leader").agg(F.sum("weight").alias("weight")).groupBy("node").agg(F.max_by("leader", F.struct(F.col("node") != F.col("leader"), "weight", -F.col("leader"))).alias("leader")))
    length = meeting.groupBy("list").agg(F.count("*").alias("length"))
    seat = meeting.join(led.select(F.col("leader").alias("node")).distinct(), "node", "left_semi").select("node", "list")
    longest = spread_join(seat, length, "list").groupBy(F.col("node").alias("leader")).agg(F.max_by("list", F.struct("length", "list")).alias("company"))
    placed = written(spread_join(led, longest, "leader").join(sets.select("node", "n"), "node"))
    parts = lambda n, count: F.ceil(F.greatest(n / GROUP_SHINGLES, count / GROUP_DOCUMENTS)).cast("int")
    families = written(placed.groupBy("company", "leader").agg(F.sum("n").alias("n"), F.count("*").alias("count")))
    companies = families.groupBy("company").agg(parts(F.sum("n"), F.sum("count")).alias("parts"))
    dealt = spread_join(families.select("company", "leader", (parts(F.col("n"), F.col("count")) > 1).alias("split")), companies, "company").select("leader", "parts", "split")
    salt = F.pmod(F.xxhash64(F.when(F.col("split"), F.col("node")).otherwise(F.col("leader")), F.lit("salt")), F.col("parts"))
    homes = written(spread_join(placed, dealt, "leader").select("node", "leader", "n", F.xxhash64("company", salt).alias("home")))
    guests = homes.select("home", F.col("leader").alias("node")).distinct().join(homes.select("home", "node"), ["home", "node"], "left_anti")
    discard(led, placed, families)
    return homes, guests


def jaccard_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links)."""
    n = partitions_for(documents)
    table = written(_sets(documents, id_column, text_column))
    kind = table.schema["id"].dataType.simpleString()
    text = documents.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(_common(documents, text_column))  # a hundred shingles a sampled document at most
    # by id, as hashes of so few receivers would meet: some tasks would hold the blocks of several, others none
    lists = written(
        text.mapInArrow(tidy(_deal(n, shared)), _BLOCK).repartitionById(n, "r").mapInArrow(tidy(_shared(n)), _BLOCK)
        .repartitionById(n, "r").mapInArrow(tidy(_prefixes(n)), _BLOCK)
        .repartitionById(n, "r").mapInArrow(tidy(_meet(n)), "list long, members array<long>, scores array<long>, weight long, common boolean"))
    shared.unpersist()
    classes = written(table.where("sig IS NOT NULL AND id IS NOT NULL").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("rows")).mapInArrow(_with_node, f"node long, least {kind}, rows long, sig binary"))
    flat = lists.where(F.size("members") > 1).select("list", F.explode(F.arrays_zip("members", "scores")).alias("z"), F.col("members")[0].alias("leader"), "weight", "common").select("list", F.col("z.members").alias("node"), F.col("z.scores").alias("score"), "leader", "weight", "common")
    alone = lists.where((F.size("members") == 1) & F.col("common")).select("list", F.col("members")[0].alias("node"), F.col("scores")[0].alias("score"), F.col("members")[0].alias("leader"), "weight", "common")
    heads = lists.where("common").select("list", F.col("members")[0].alias("node"), F.col("scores")[0].alias("score"))
    tops = heads.groupBy("list").agg(F.min_by("node", F.struct("score", "node")).alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    meeting = written(flat.unionByName(alone).unionByName(heads.join(tops, "list").where("node <> leader").select("list", "node", "score", "leader", F.lit(1).cast("long").alias("weight"), F.lit(True).alias("common"))))
    discard(lists)
    sets = written(_sets_of(documents, classes, meeting, id_column, text_column))
    homes, guests = _homes(meeting, sets)
    present = homes.select("home", "node").unionByName(guests)
    opened = present.join(sets, "node").select("home", "node", "set").repartition(n, "home").sortWithinPartitions("home")
    edges = written(opened.mapInArrow(tidy(_open_groups), "a long, b long"))
    labels = components(edges)
    meets = written(meeting.select("list", "node", "score").distinct().join(homes.select("node", "home", "n"), "node"))
    # whoever is not of a list's largest component asks every other group of the list
    open_ = _labelled(meets, labels)
    of_label = open_.groupBy("list", "label").agg(F.count("*").alias("n"))
    largest = of_label.groupBy("list").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("n")).where("n > 1").select("list", "largest")
    there = open_.groupBy("list", "home").agg(F.min("label").alias("low"), F.max("label").alias("high")).withColumnRenamed("home", "at")
    asking = open_.join(largest, "list").where("label <> largest").select("list", "node", "label", "home", "n").join(there, "list").where("home <> at AND (low <> label OR high <> label)")
    asking = written(asking.groupBy("at", "node").agg(F.first("label").alias("label"), F.first("n").alias("n")))
    parts = written(asking.groupBy("at").agg(F.ceil(F.sum("n") / ASKING_SHINGLES).cast("int").alias("parts")))
    tasks = max(n, 2 * (parts.agg(F.sum("parts")).first()[0] or 0))  # so that few of them share one
    asked = spread_join(homes.select("node", F.col("home").alias("at")), parts, "at").join(labels, "node", "left").select("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asks"), "node", F.coalesce("label", "node").alias("label"))
    asks = spread_join(asking, parts, "at").select("at", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("asks"), "node", "label")
    dealt = asked.unionByName(asks).join(sets.select("node", "set"), "node").select("at", "part", "asks", "node", "label", "set").repartition(tasks, "at", "part").sortWithinPartitions("at", "part", "asks")
    more = written(edges.union(dealt.mapInArrow(tidy(_ask_groups), "a long, b long")))
    discard(edges, labels, open_, meets, asking, parts, meeting, homes, sets)
    labels = components(more)
    found = written(_named(classes, labels))
    discard(more, labels, classes)
    return _answer(table, found, id_column)


def _labelled(meets: DataFrame, labels: DataFrame) -> DataFrame:
    return written(meets.join(labels, "node", "left").select("list", "node", "score", "home", "n", F.coalesce("label", "node").alias("label")))


def _named(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, rows, component) of every class: the least id of all that its label joins."""
    labelled = written(classes.join(labels, "node").select("sig", "rows", "least", "label"))
    least = written(labelled.groupBy("label").agg(F.min("least").alias("component")))
    joined = spread_join(labelled, least, "label").select("sig", "rows", "component")
    return joined.unionByName(classes.join(labels, "node", "left_anti").select("sig", "rows", F.col("least").alias("component")))


def _answer(table: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """The rows of `table` with their component; classes of very many rows are broadcast, empty sets join nothing."""
    many = max(10_000, table.count() // 1000)  # so at most a thousand classes
    hot = F.broadcast(found.where(F.col("rows") > many).select("sig", "component"))
    some = table.where("sig IS NOT NULL AND id IS NOT NULL")
    rows = some.join(hot, "sig").unionByName(some.join(hot, "sig", "left_anti").join(found.where(F.col("rows") <= many).select("sig", "component"), "sig"))
    rows = rows.select("id", "n", "component").unionByName(table.where("sig IS NULL OR id IS NULL").select("id", "n", F.col("id").alias("component")))
    return rows.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in batch.column(0).to_pylist()], pa.int64()), batch.column(1), batch.column(2), batch.column(0)], names=["node", "least", "rows", "sig"])


def _sets_of(documents: DataFrame, classes: DataFrame, meeting: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, n, set) of the classes that meet others, read again from one document of each."""
    wanted = written(classes.join(meeting.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("id"), "node"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                rows = []
                for want, s in zip(batch.column(0).slice(a, b - a).to_pylist(), shingle_sets(batch.column(1).slice(a, b - a))):
                    if len(s) and node_of(digest(s)) == want:
                        rows.append((want, len(s), s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["node", "n", "set"])

    source = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(side, "id").select("node", "text")
    return source.mapInArrow(tidy(run), "node long, n long, set binary").dropDuplicates(["node"])
