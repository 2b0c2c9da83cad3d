"""N-gram Jaccard join over a token-group matrix.

A document's set holds hashes of its distinct five-word shingles. Documents with equal sets are one
class from the start. Two classes link when 100 * intersection >= 80 * union; the result gives each
document its component under links.

1. Which classes can link at all? Each needs a partner that holds four fifths of its tokens, so at
   least that many of its tokens occur in another class. Blocks of tokens, packed into arrays, are
   dealt out by token range; a token that a block holds for several classes travels once, so a hot
   token costs one entry a block. The owners of shared tokens come back by block; other classes are
   single and done. (Copies in different blocks count as each other's partners here; they are one class later.)
2. The rest have their sets stored. Tokens are ordered by frequency (a bounded table of the most
   frequent ones) and hash; a link's partners share a token among the first ``n - need + 1`` of
   either (``need``: four fifths of n, rounded up). These lead tokens make the matrix.
3. Similar classes form groups, in two rounds: a class's sketch, a few minimal hashes of its set, puts
   it into as many slots; a slot names its most central class (that whose tokens are most frequent: the
   original among its edited copies), and each class is compared with the one class that most of its
   slots name. A verified link puts its group under the other. A round's work is in proportion to the sets.
4. What can still link with another group? Lead tokens that several groups hold name the classes; of
   these, each needs a partner in another group, so at least ``need`` of its tokens occur in other
   groups. This bound is a count over all of a class's tokens, and drops the classes of one passage or of
   one group.
5. The token-group matrix holds, of what remains, each group's union of lead tokens, of each member the
   part that can come first in common with a partner at least as large. A class queries the groups other
   than its own that hold one of its lead tokens, where the places of the token and the sizes allow a link
   with a member no larger. The query's set and the sets of the group's members travel to one task, which
   holds the union of the members' tokens with the members that have each; it bounds the overlap, and only where it
   reaches ``need`` are the members counted, all at once. One link is enough: a group is connected already.

Groups are opened in parts of bounded size, queries in chunks, so no group is one task. No pairs
inside a group are made. Tokens are hashes of 64 bits, the keys of sets have 128; classes that can link
are numbered.

Defined results: null text counts as empty; an empty set links with nothing and is its own component;
a text of fewer than five words is one shingle; repeated rows are copies; rows with null ids link as
others do, but a null id never names a component unless it has no other id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import blocks, cut, give_back, only_keys, trimmed, without_keys, work_dir
from ._graph import components
from ._text import mix, shingle_set

#: Fixed values of the link rule: per hundred of the union.
SIMILAR, WHOLE = 80, 100
#: Tokens of a block on the way to their ranges, and of a range where they are compared.
BLOCK_TOKENS, RANGE_TOKENS = 1 << 19, 1 << 20
#: Rows of the table of frequent tokens (12 bytes each), and the least frequency that it holds.
FREQUENT, LEAST_FREQUENT = 1 << 21, 4
#: Frequencies from here on are told apart only in the order, not in choosing what the table holds.
HIGHEST = 1 << 12
#: Rounds of grouping at most (they end when one gives no link), and hashes of a sketch.
ROUNDS, SKETCH = 2, 4
#: Members of a group, and queries to it, that one task compares.
GROUP_PART, QUERY_CHUNK = 200, 1_000


#: Columns of a set's key.
KEY = ["key_lo", "key_hi"]


def need(n):
    """Tokens that a partner of a set of n must hold."""
    return (SIMILAR * n + WHOLE - 1) // WHOLE


def reach(n, place):
    """With the first common token at this place of a set of n, the partner's size times SIMILAR is at most this."""
    return WHOLE * n - (SIMILAR + WHOLE) * place


def _key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _halves(keys: list[bytes]) -> np.ndarray:
    """Keys as rows of two longs."""
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield shingle_set((text.as_py() or "").encode())


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(len(s), _key(s)) for s in _sets(batch)]
        keys = _halves([k for _, k in found])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc_id", "n", *KEY])


_PACKED = "part long, block long, owners binary, tokens binary, several binary"
_NAMES = ["part", "block", "owners", "tokens", "several"]
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _deal(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Packed blocks: for each range the tokens' low halves and, as steps between them, the owners' numbers in the block.

    A token of several classes of the block is listed once and marked. Row -1-block holds the classes'
    keys, their sizes, and how many of each class's tokens are so shared.
    """
    from pyspark import TaskContext

    first, number = TaskContext.get().partitionId() << 32, 0
    sets: dict[bytes, np.ndarray] = {}
    held = 0

    def block():
        keys = _halves(list(sets))
        sizes = np.array([len(s) for s in sets.values()], np.int64)
        tokens = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        run = np.cumsum(new) - 1
        several = np.bincount(run) > 1
        shared = np.bincount(owner, several[run], minlength=len(keys)).astype(np.uint32)
        yield -1 - (first + number), first + number, keys.tobytes(), sizes.astype(np.uint32).tobytes(), shared.tobytes()
        tokens, owner = tokens[new], owner[new]
        part = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.lexsort((owner, part))
        tokens, owner, part, several = tokens[order], owner[order], part[order], several[order]
        kind = np.uint16 if len(keys) < 1 << 16 else np.uint32
        for p, a, b in zip(*_runs(part), strict=True):
            yield int(p), first + number, np.diff(owner[a:b], prepend=0).astype(kind).tobytes(), tokens[a:b].astype(np.uint32).tobytes(), np.packbits(several[a:b]).tobytes()

    def rows():
        nonlocal number, held
        out = list(block())
        number += 1
        sets.clear()
        held = 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    for batch in batches:
        for s in _sets(batch):
            if len(s):
                key = _key(s)
                if key not in sets:
                    sets[key] = s
                    held += len(s)
            if held >= BLOCK_TOKENS:
                yield from rows()
    if sets:
        yield from rows()


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]])
    return sorted_[edges[:-1]], edges[:-1], edges[1:]


_SHARED = pa.schema([("block", pa.int64()), ("owners", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())])


def _compare(table: pa.Table) -> pa.Table:
    """For one range: per block, the owners of the tokens that other blocks or other classes of the block hold.

    A class that stands in several blocks counts as several classes: it then goes on for its copies' sake.
    """
    if table.column("part")[0].as_py() < 0:
        return pa.table([table.column("block"), table.column("several"), table.column("owners"), table.column("tokens")], schema=_SHARED)
    owners, tokens, several, ends = [], [], [], [0]
    for steps, token, bits in zip(*(table.column(c) for c in ("owners", "tokens", "several")), strict=True):
        token = np.frombuffer(token.as_buffer(), np.uint32)
        steps = np.frombuffer(steps.as_buffer(), np.uint16 if steps.as_buffer().size == 2 * len(token) else np.uint32)
        owners.append(np.cumsum(steps, dtype=np.uint32))
        tokens.append(token)
        several.append(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(token)).astype(bool))
        ends.append(ends[-1] + len(token))
    token, common = np.concatenate(tokens), np.concatenate(several)
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = token[1:] == token[:-1]
    alike = np.zeros(len(token), bool)
    alike[1:] |= same
    alike[:-1] |= same
    again = np.zeros(len(token), bool)
    again[order] = alike
    hit = again & ~common  # what the block holds several times it has counted itself
    out = [{"block": block, "owners": own[hit[a:b]].tobytes()} for block, own, a, b in zip(table.column("block").to_pylist(), owners, ends[:-1], ends[1:], strict=True) if hit[a:b].any()]
    give_back()
    return pa.Table.from_pylist(out, _SHARED)


def _likely(table: pa.Table) -> pa.Table:
    """The classes of one block with enough tokens that other classes have too."""
    keys, sizes, total = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for owners, own_keys, own_sizes in zip(*(table.column(c).to_pylist() for c in ("owners", "keys", "sizes")), strict=True):
        if own_keys is None:
            found.append(np.frombuffer(owners, np.uint32))
        else:
            keys, sizes, total = np.frombuffer(own_keys, "<i8").reshape(-1, 2), np.frombuffer(own_sizes, np.uint32).astype(np.int64), np.frombuffer(owners, np.uint32).astype(np.int64)
    if found:
        total = total + np.bincount(np.concatenate(found), minlength=len(total))
    keys = keys[WHOLE * total >= SIMILAR * sizes]
    return pa.table({c: pa.array(keys[:, k]) for k, c in enumerate(KEY)})


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, tokens = [], [], []
        keys = zip(*(batch.column(c).to_pylist() for c in ("node", *KEY)), strict=True)
        for (node, *key), s in zip(keys, _sets(batch), strict=True):
            if len(s) and _halves([_key(s)])[0].tolist() == key:
                nodes.append(node)
                sizes.append(len(s))
                tokens.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "n", "tokens"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of all texts that have one, under their own class keys."""
    for batch in batches:
        sets = [s for s in _sets(batch) if len(s)]
        keys = _halves([_key(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*KEY, "n", "tokens"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def counted():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        some = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], names=["token", "n"])

    for batch in batches:
        for data in batch.column("tokens"):
            held.append(np.frombuffer(data.as_buffer(), np.uint64).copy())
            size += len(held[-1])
            if size >= BLOCK_TOKENS:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _packed_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, counts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "n"))
        yield pa.RecordBatch.from_arrays([pa.array([tokens.astype(np.int64).tobytes()], pa.binary()), pa.array([np.minimum(counts, 1 << 30).astype(np.int32).tobytes()], pa.binary())], names=["tokens", "counts"])


def _frequency_table(often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and their frequencies: all from the frequency on at which ``FREQUENT`` rows hold them."""
    rows, least = 0, HIGHEST + 1
    for r in often.groupBy(F.least("n", F.lit(HIGHEST)).alias("n")).count().orderBy(F.desc("n")).collect():
        if rows + r["count"] > FREQUENT:
            break
        rows, least = rows + r["count"], r["n"]
    found = often.filter(F.col("n") >= least).mapInArrow(_packed_table, "tokens binary, counts binary").collect()
    tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint64) for r in found] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in found] or [np.zeros(0, np.int32)])
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _leads(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    tokens, counts = sent.value
    for batch in batches:
        out, nodes, sizes, reaches = [], [], [], []
        for node, n, data in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
            own = np.frombuffer(data.as_buffer(), np.uint64)
            rank = np.zeros(n, np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                rank = np.where(tokens[at] == own, counts[at], 0)
            lead = own[np.argsort(rank, kind="stable")[: n - need(n) + 1]]
            out.append(lead)
            nodes.append(np.full(len(lead), node, np.int64))
            sizes.append(np.full(len(lead), n, np.int64))
            reaches.append(reach(n, np.arange(len(lead))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([o.view(np.int64) for o in out], nodes, sizes, reaches)], names=["token", "node", "n", "reach"])


def _sketch(batches: Iterator[pa.RecordBatch], sent, seed: int) -> Iterator[pa.RecordBatch]:
    """Slots of each class, and how central it is: the mean logarithm of its tokens' frequencies."""
    tokens, counts = sent.value
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
        if not sets:
            continue
        sizes = np.array([len(x) for x in sets])
        flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
        weight = np.zeros(len(flat))
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
            weight = np.where(tokens[at] == flat, np.log2(counts[at]), 0.0)
        central = (np.add.reduceat(weight, starts) / sizes * 1e6).astype(np.int64)
        for k in range(SKETCH):
            salt = np.uint64(0x9E3779B97F4A7C15 * (seed * SKETCH + k + 1) & (1 << 64) - 1)
            slot = np.minimum.reduceat(mix(flat ^ salt), starts) ^ salt
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), batch.column("node"), pa.array(central)], names=["slot", "node", "central"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in blocks(batch.column("n").to_pylist(), BLOCK_TOKENS):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("tokens").slice(a, b - a)]
            sizes = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *(pa.array(np.repeat(batch.column(c).slice(a, b - a).to_numpy(), sizes)) for c in ("node", "grp"))], names=["token", "node", "grp"])


def _open(table: pa.Table) -> pa.Table:
    """Links (query, member), one at most for a query: the group is connected."""
    asks = table.column("asks")
    members, queries = table.filter(pc.invert(asks)), table.filter(asks)
    sets = [np.frombuffer(t, np.uint64) for t in members.column("tokens").to_pylist()]
    names = members.column("node").to_numpy()
    a, b = [], []
    if sets and queries.num_rows:
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        union, runs = flat[starts], np.diff(np.append(starts, len(flat)))
        for node, data in zip(queries.column("node").to_pylist(), queries.column("tokens").to_pylist(), strict=True):
            own = np.frombuffer(data, np.uint64)
            n = len(own)
            at = np.minimum(np.searchsorted(union, own), len(union) - 1)
            at = at[union[at] == own]
            if len(at) < need(n):
                continue
            many = runs[at]
            place = np.arange(int(many.sum())) + np.repeat(starts[at] - (np.cumsum(many) - many), many)
            common = np.bincount(owner[place], minlength=len(sets))
            linked = np.flatnonzero(WHOLE * common >= SIMILAR * (n + sizes - common))
            if len(linked):
                a.append(node)
                b.append(int(names[linked[0]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _opened(asked: DataFrame, members: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """Links between queries and groups. ``asked``: (node, grp); ``members``: (node, grp).

    Who goes where is a narrow table, written, so that a small one is broadcast to the sets; these are read
    once for members and queries and shuffled once, to where they are compared.
    """
    chunks = asked.groupBy("grp").agg(F.expr(f"count(*) div {QUERY_CHUNK} + 1").alias("chunks"))
    parts = members.groupBy("grp").agg(F.expr(f"count(*) div {GROUP_PART} + 1").alias("parts"))
    plan = chunks.join(parts, "grp")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = members.join(plan, "grp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("chunk", upto("chunks"))
    right = asked.join(plan, "grp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("part", upto("parts"))
    keys = ["grp", "part", "chunk"]
    places = left.select(*keys, "node", F.lit(False).alias("asks")).unionByName(right.select(*keys, "node", F.lit(True).alias("asks")))
    places = cut(places, path)
    return sets.select("node", "tokens").join(places, "node").select(*keys, "node", "asks", "tokens").groupBy(*keys).applyInArrow(_open, "a long, b long")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id), one per document."""
    return _components(docs, id_col, text_col).drop(*KEY, "label")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same with the keys of the document's class (``KEY``) and its component's label, if it can link."""
    spark = docs.sparkSession
    home = work_dir(spark, "jaccard")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(texts.mapInArrow(lambda it: trimmed(_classes(it)), f"doc_id {kind}, n long, key_lo long, key_hi long"), f"{home}/rows")
    total = rows.agg(F.sum("n")).first()[0] or 0

    ranges = max(1, total // RANGE_TOKENS)
    packed = texts.select("text").mapInArrow(lambda it: trimmed(_deal(it, ranges)), _PACKED)
    shared = packed.groupBy("part").applyInArrow(_compare, "block long, owners binary, keys binary, sizes binary")
    likely = cut(shared.groupBy("block").applyInArrow(_likely, "key_lo long, key_hi long").distinct(), f"{home}/likely")

    # the classes that can link are numbered; their sets are stored under these numbers
    first = rows.join(likely, KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"))
    first = cut(first.withColumn("node", F.monotonically_increasing_id()), f"{home}/first")
    chosen = only_keys(texts, first, ["doc_id"]).join(first, "doc_id")
    found = chosen.select("node", *KEY, "text").mapInArrow(_store, "node long, n long, tokens binary")
    nameless = first.filter("doc_id IS NULL").select("node", *KEY)  # classes without an id: their texts are found by set key
    own = texts.filter("doc_id IS NULL").select("text").mapInArrow(_own, "key_lo long, key_hi long, n long, tokens binary")
    own = only_keys(own, nameless, KEY).join(nameless, KEY).select("node", "n", "tokens").dropDuplicates(["node"])
    sets = found.unionByName(own)
    if _repeats(rows):
        sets = sets.dropDuplicates(["node"])
    sets = cut(sets, f"{home}/sets")

    often = sets.select("tokens").mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_FREQUENT)
    often = cut(often, f"{home}/often")
    sent = spark.sparkContext.broadcast(_frequency_table(often))

    groups, links = _grouped(sets, sent, home)
    leads = cut(sets.mapInArrow(lambda it: _leads(it, sent), "token long, node long, n long, reach long"), f"{home}/leads")
    held = _between(leads.join(groups.select("node", "grp"), "node"), sets, groups, home)

    # tokens that stand in the same classes (those of one passage) give the same candidates: the first in order stays
    same = [F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.count("*").alias("k"), F.sum("reach").alias("r")]
    mixed = held.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), *same).filter("lo < hi")
    mixed = mixed.groupBy("s", "x", "k").agg(F.max(F.struct("r", "token")).alias("t")).select("t.token")
    held = cut(held.join(mixed, "token", "left_semi"), f"{home}/held")
    matrix = held.filter(F.col("reach") >= SIMILAR * F.col("n")).groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    fits = (F.col("own") != F.col("grp")) & (F.col("n") * SIMILAR <= F.col("most")) & (F.col("least") * SIMILAR <= F.col("reach")) & (F.col("least") <= F.col("n"))
    asked = held.select("token", "node", "n", "reach", F.col("grp").alias("own")).join(matrix, "token").filter(fits).select("node", "grp").distinct()
    asked = cut(asked, f"{home}/asked")
    if not asked.isEmpty():
        members = groups.select("node", "grp").join(held.select("node").distinct(), "node", "left_semi")
        more = cut(_opened(asked, members, sets, f"{home}/places"), f"{home}/links")
        links = more if links is None else links.unionByName(more)

    # a group lies in one component, so components are those of the groups under links between them
    label = groups.select("node", F.col("grp").alias("label"))
    if links is not None:
        for end in ("a", "b"):
            links = links.join(groups.select(F.col("node").alias(end), F.col("grp").alias(f"{end}_grp")), end)
        between = links.select(F.col("a_grp").alias("a"), F.col("b_grp").alias("b"))
        label = components(between, f"{home}/final").withColumnRenamed("node", "grp")
        label = groups.join(label, "grp", "left").select("node", F.coalesce("label", "grp").alias("label"))
    label = first.join(label, "node").select(*KEY, "label")
    nodes = rows.groupBy(*KEY).agg(F.min("doc_id").alias("class_id")).join(label, KEY, "left")
    nodes = cut(nodes, f"{home}/classes")
    # classes that cannot link have no label and are their own components: no key brings them to one task
    linked = nodes.filter("label IS NOT NULL")
    names = linked.groupBy("label").agg(F.min("class_id").alias("component_id"))
    single = nodes.filter("label IS NULL").withColumn("component_id", F.col("class_id"))
    nodes = linked.join(names, "label").select(*single.columns).unionByName(single)
    out = rows.join(cut(nodes.select(*KEY, "label", "class_id", "component_id"), f"{home}/nodes"), KEY)
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *KEY, "label")


def _grouped(sets: DataFrame, sent, home: str) -> tuple[DataFrame, DataFrame | None]:
    """Groups of classes, (node, n, grp, rank), and the links that made them. ``rank`` orders the groups."""
    groups, links = None, None
    for k in range(ROUNDS):
        slots = sets.select("node", "tokens").mapInArrow(lambda it, k=k: _sketch(it, sent, k), "slot long, node long, central long")
        if groups is None:
            best = slots.withColumn("rank", F.struct("central", F.xxhash64("node").alias("h"))).withColumn("grp", F.col("node"))
        else:
            best = slots.join(groups.select("node", "grp", "rank"), "node")
        best = cut(best, f"{home}/slots{k}")
        if groups is None:
            groups = cut(best.select("node", "rank").distinct().join(sets.select("node", "n"), "node").select("node", "n", F.col("node").alias("grp"), "rank"), f"{home}/single")
        hubs = best.groupBy("slot").agg(F.max(F.struct("rank", "grp", "central", "node")).alias("hub"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        hubs = hubs.filter("lo < hi").select("slot", F.col("hub.node").alias("hub"), F.col("hub.grp").alias("hub_grp"), F.col("hub.rank").alias("hub_rank"))
        met = best.join(hubs, "slot").filter("grp <> hub_grp").groupBy("node", "grp", "hub", "hub_grp", "hub_rank").agg(F.count("*").alias("k"))
        asked = met.groupBy("node", "grp").agg(F.max(F.struct("k", "hub_rank", "hub", "hub_grp")).alias("x"))
        asked = cut(asked.select("node", F.col("grp").alias("own"), "x.hub", "x.hub_grp", "x.hub_rank"), f"{home}/asked{k}")
        hub = asked.select(F.col("hub").alias("node")).distinct().withColumn("grp", F.col("node"))
        new = cut(_opened(asked.select("node", F.col("hub").alias("grp")), hub, sets, f"{home}/places{k}"), f"{home}/links{k}")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        # a linked group goes under the hub's; ranks rise along the way, so there is no ring
        up = asked.join(new.select(F.col("a").alias("node")), "node", "left_semi").groupBy("own").agg(F.max(F.struct("hub_rank", "hub_grp")).alias("x"))
        up = cut(up.select("own", F.col("x.hub_grp").alias("up"), F.col("x.hub_rank").alias("up_rank")), f"{home}/up{k}")
        for _ in range(2):
            up = up.join(up.toDF("mid", "top", "top_rank"), F.col("up") == F.col("mid"), "left").select("own", F.coalesce("top", "up").alias("up"), F.coalesce("top_rank", "up_rank").alias("up_rank"))
        groups = groups.join(up, F.col("grp") == F.col("own"), "left").select("node", "n", F.coalesce("up", "grp").alias("grp"), F.coalesce("up_rank", "rank").alias("rank"))
        groups = cut(groups, f"{home}/members{k}")
    return groups, links


def _foreign(rows: DataFrame) -> DataFrame:
    """The rows (token, node, grp) of tokens that several groups hold. One shuffle serves the sum and the join."""
    rows = rows.select("token", "node", "grp").repartition("token")
    several = rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("node").alias("any")).filter("lo < hi AND any IS NOT NULL")
    return rows.join(several.select("token"), "token").select("token", "node", "grp")


def _between(held: DataFrame, sets: DataFrame, groups: DataFrame, home: str) -> DataFrame:
    """The leads (token, node, n, reach, grp) of classes that can link with another group's.

    A linked pair has ``need`` tokens of either in common, so both classes stay.
    """
    stays = cut(_foreign(held).groupBy("node").agg(F.max("grp").alias("grp")), f"{home}/stays")
    if not stays.isEmpty():
        each = sets.join(stays, "node").select("node", "n", "grp", "tokens").mapInArrow(_exploded, "token long, node long, grp long")
        hit = _foreign(each).groupBy("node", "grp").agg(F.count("*").alias("k"))
        stays = cut(hit.join(groups.select("node", "n"), "node").filter(F.col("k") * WHOLE >= F.col("n") * SIMILAR).select("node", "grp"), f"{home}/bound")
    return held.join(stays.select("node"), "node", "left_semi")


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the smallest id (with its repeated rows, if any).

    Without an id in a component, the least set key stays. An id that only some of its texts lose, or
    null, does not tell which rows go; those rows are removed by id and set key.
    """
    home = work_dir(docs.sparkSession, "gone")
    found = _components(docs, id_col, text_col)
    key = F.struct(*KEY)
    least = found.filter("component_id IS NULL AND label IS NOT NULL").groupBy("label").agg(F.min(key).alias("least"))
    other = ~F.col("doc_id").eqNullSafe(F.col("component_id")) | F.coalesce(key != F.col("least"), F.lit(False))
    nameless = F.col("component_id").isNull() & F.col("label").isNotNull()
    rest = found.filter(~nameless).withColumn("least", F.lit(None).cast(least.schema["least"].dataType))
    found = found.filter(nameless).join(least, "label").select(*rest.columns).unionByName(rest)
    found = found.select(F.col("doc_id").alias(id_col), *[F.col(c).alias(m) for c, m in _MARKS.items()], (other & (F.col("n_shingles") > 0)).alias(_GOES))
    found = cut(found, f"{home}/rows")
    on = [id_col, *_MARKS.values()]
    gone = found.filter(_GOES).select(*on).distinct()
    some = cut(found.groupBy(id_col).agg(F.min(_GOES).alias("all"), F.max(_GOES).alias("any")).filter("any AND NOT all").select(id_col), f"{home}/some")
    if some.isEmpty():
        return without_keys(docs, gone.select(id_col), [id_col])
    whole = without_keys(gone, some, [id_col]).select(id_col)
    rest = without_keys(docs, whole, [id_col])
    clear = without_keys(rest, some, [id_col])

    def keyed(batches):
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col)], names=["doc_id", "text"])
            keys = _halves([_key(x) for x in _sets(named)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=[*batch.schema.names, *_MARKS.values()])

    mixed = some.select(F.col(id_col).alias("k"))
    unclear = rest.join(mixed, F.col(id_col).eqNullSafe(F.col("k")), "left_semi")
    unclear = unclear.mapInArrow(keyed, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in _MARKS.values())]))
    return clear.unionByName(without_keys(unclear, gone, on).drop(*_MARKS.values()))


_MARKS, _GOES = {c: f"__docloom_{c}" for c in KEY}, "__docloom_goes"
