"""K-d tree sharding by bytes.

The metadata of every document (size, text checksum, language and source codes) is a point; its
weight is the size. A node that holds more than one target's bytes is split along its widest
dimension (the extent inside the node against the extent of all documents) at the weighted median,
or at the matching weighted quantile where its share is an odd number of leaves. Ties on the dimension
go on by text checksum, then by id, so equal texts stay together unless a plane has to cut a group to
keep the sizes near equal.

All open nodes of a level are rows of a table, and a level is split at once: histograms of the nodes'
weights, summed before they are shuffled, are refined around each node's aim until a bucket is one key or
one row; the bucket is picked on the executors, from at most ``BUCKETS`` rows a node. Nodes of at most
``local_rows`` rows are finished by one task each, by the same rule. The driver sees counts only, whatever
the number of leaves.

Defined results: null text counts as empty (size 1, checksum 0); null language or source is a code of
its own; a null id sorts as the least; repeated rows are separate rows; of rows equal in every key of
a cut, all go to the cut's left side; an empty table gives no rows. Columns of the input other than
those named are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, work_dir

#: Histogram buckets per open node and pass.
BUCKETS = 2048
#: Rows of a node that one task splits to its end.
LOCAL_ROWS = 1 << 14
#: Rows whose slots one window task numbers.
SLOT_ROWS = 20_000

DIMENSIONS = ("d_size", "d_text", "d_lang", "d_source")


def _points(docs: DataFrame, id_col: str, text_col: str, meta: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    code = [F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) if c in docs.columns else F.lit(0).cast("long") for c in meta]
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[c.alias(f"d_{name}") for c, name in zip(code, ("lang", "source"), strict=True)],
    ).withColumns({"d_size": F.col("size"), "d_text": F.col("text_crc32"), "k_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62)))})


def _widest(extent: dict[str, int]) -> Column:
    """The number of the dimension in which a node extends most, the first of equal ones."""
    spread = [(F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(float(extent[d])) for d in DIMENSIONS]
    most = F.greatest(*spread)
    return F.coalesce(*[F.when(x == most, F.lit(k)) for k, x in enumerate(spread)])


def _by_dim(prefix: str = "") -> Column:
    return F.coalesce(*[F.when(F.col("dim") == k, F.col(prefix + d)) for k, d in enumerate(DIMENSIONS)])


def _refined(rows: DataFrame, nodes: DataFrame, home: str) -> DataFrame:
    """(leaf, value, under, done) per node. ``rows``: (leaf, key, size); ``nodes``: (leaf, low, high, aim).

    Done: rows with a key up to the value lie left of the cut. Else the cut is inside the rows of that
    key, and what is below it weighs ``under``.
    """
    open_, closed, k = cut(nodes.withColumn("under", F.lit(0).cast("long")), f"{home}/pass0"), None, 0
    while not open_.isEmpty():
        k += 1
        width = F.expr(f"(high - low) div {BUCKETS} + 1")
        held = rows.join(open_.withColumn("width", width), "leaf").filter("key BETWEEN low AND high")
        bars = held.groupBy("leaf", F.expr("(key - low) div width").alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        each = Window.partitionBy("leaf")
        bars = bars.withColumn("upto", F.sum("bytes").over(each.orderBy("bucket"))).withColumn("all", F.sum("bytes").over(each))
        bars = bars.join(open_.withColumn("width", width), "leaf").filter("under + upto >= aim OR upto = all")
        found = bars.groupBy("leaf").agg(F.min(F.struct("bucket", "bytes", "n", "upto", "low", "high", "width", "aim", "under")).alias("x")).select("leaf", "x.*")
        seen, begin = F.col("under") + F.col("upto") - F.col("bytes"), F.col("low") + F.col("bucket") * F.col("width")
        found = found.select("leaf", "bytes", "n", "aim", seen.alias("under"), begin.alias("low"), F.least("high", begin + F.col("width") - 1).alias("high"))
        found = cut(found, f"{home}/pass{k}")
        takes = F.col("under") + F.col("bytes") - F.col("aim") <= F.col("aim") - F.col("under")
        single = found.filter("n = 1").select("leaf", F.when(takes, F.col("high")).otherwise(F.col("low") - 1).alias("value"), F.when(takes, F.col("under") + F.col("bytes")).otherwise(F.col("under")).alias("under"), F.lit(True).alias("done"))
        inside = found.filter("n > 1 AND low = high").select("leaf", F.col("low").alias("value"), "under", F.lit(False).alias("done"))
        ended = single.unionByName(inside)
        closed = ended if closed is None else closed.unionByName(ended)
        open_ = found.filter("n > 1 AND low < high").select("leaf", "low", "high", "aim", "under")
    return closed


def _planes(points: DataFrame, nodes: DataFrame, home: str) -> DataFrame:
    """Per node the plane and, where it falls inside rows of one key, how the cut goes on: v0 to v2, d0 to d2."""
    nodes = nodes.withColumn("aim", F.col("bytes") * F.expr("leaves div 2") / F.col("leaves"))
    out, rest = nodes.select("leaf", "leaves", "dim"), nodes
    rows = points.join(nodes.select("leaf", "dim"), "leaf").select("leaf", "size", _by_dim().alias("k0"), F.col("d_text").alias("k1"), F.col("k_id").alias("k2"))
    bounds = [(_by_dim("lo_"), _by_dim("hi_")), (F.col("lo_d_text"), F.col("hi_d_text")), (F.col("lo_k_id"), F.col("hi_k_id"))]
    for step, (low, high) in enumerate(bounds):
        found = _refined(rows.withColumn("key", F.col(f"k{step}")), rest.select("leaf", low.alias("low"), high.alias("high"), "aim"), f"{home}/step{step}")
        found = cut(found, f"{home}/found{step}")
        out = out.join(found.select("leaf", F.col("value").alias(f"v{step}"), F.col("done").alias(f"d{step}")), "leaf", "left")
        inside = found.filter("NOT done").select("leaf", "value", F.col("under").alias("below"))
        if inside.isEmpty() or step == 2:
            break
        rest = rest.join(inside, "leaf").withColumn("aim", F.col("aim") - F.col("below")).drop("below", "value")
        rows = rows.join(inside.select("leaf", "value"), "leaf").filter(F.col(f"k{step}") == F.col("value")).drop("value")
    for later in range(step + 1, 3):
        out = out.withColumns({f"v{later}": F.lit(None).cast("long"), f"d{later}": F.lit(None).cast("boolean")})
    return out


def _left() -> Column:
    """Whether a row lies left of its node's cut."""
    left = F.lit(True)
    for step, key in reversed([*enumerate((_by_dim(), F.col("d_text"), F.col("k_id")))]):
        value, done = F.col(f"v{step}"), F.col(f"d{step}")
        left = (key < value) | ((key == value) & (F.coalesce(done, F.lit(True)) | left))
    return left


def split(columns: dict[str, np.ndarray], leaf: int, leaves: int, extent: dict[str, int]) -> np.ndarray:
    """The leaf of each row of one node, split to the end. ``columns``: the dimensions, ``k_id`` and ``size``."""
    out = np.full(len(columns["size"]), leaf, np.int64)
    todo = [(np.arange(len(out)), leaf, leaves)]
    while todo:
        rows, first, share = todo.pop()
        if share < 2 or not len(rows):
            out[rows] = first
            continue
        spread = [float(int(columns[d][rows].max()) - int(columns[d][rows].min())) / float(extent[d]) for d in DIMENSIONS]
        keys = [columns[c][rows] for c in (DIMENSIONS[int(np.argmax(spread))], "d_text", "k_id")]
        order = np.lexsort(keys[::-1])
        rows, keys, size = rows[order], [k[order] for k in keys], columns["size"][rows[order]]
        upto = np.cumsum(size)
        aim = float(upto[-1]) * (share // 2) / share
        new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(rows))
        at = int(np.searchsorted(upto[ends - 1], aim))  # the first group of equal rows that reaches the aim
        a, b = int(starts[at]), int(ends[at])
        before = float(upto[a] - size[a])
        to = b if b - a > 1 or upto[b - 1] - aim <= aim - before else a
        todo += [(rows[:to], first, share // 2), (rows[to:], first + share // 2, share - share // 2)]
    return out


def kd_shards(
    docs: DataFrame,
    *,
    target_bytes: int | None = None,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta: tuple[str, str] = ("lang", "source"),
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one per document.

    Give ``target_bytes`` for leaves of about that size, or ``shards`` for that many leaves.
    """
    spark = docs.sparkSession
    home = work_dir(spark, "kd")
    points = cut(_points(docs, id_col, text_col, meta), f"{home}/points").withColumn("leaf", F.lit(0).cast("long"))
    stats = points.agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"hi_{d}") for d in DIMENSIONS]).first()
    total = stats["bytes"] or 0
    leaves = shards or max(1, -(-total // max(1, target_bytes or total or 1)))
    extent = {d: max(1, (stats[f"hi_{d}"] or 0) - (stats[f"lo_{d}"] or 0)) for d in DIMENSIONS}
    nodes = spark.createDataFrame([(0, leaves)] if total and leaves > 1 else [], "leaf long, leaves long")
    small, level = None, 0
    while not nodes.isEmpty():
        level += 1
        at = f"{home}/level{level}"
        ranges = [f(c).alias(f"{name}_{c}") for c in (*DIMENSIONS, "k_id") for f, name in ((F.min, "lo"), (F.max, "hi"))]
        held = cut(points.join(nodes, "leaf").groupBy("leaf", "leaves").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ranges).withColumn("dim", _widest(extent)), f"{at}/nodes")
        few = held.filter(F.col("n") <= local_rows).select("leaf", "leaves")
        small = few if small is None else small.unionByName(few)
        many = held.filter(F.col("n") > local_rows)
        if many.isEmpty():
            break
        planes = cut(_planes(points, many, at), f"{at}/planes")
        left = F.col("leaves").isNull() | _left()
        points = cut(points.join(planes, "leaf", "left").withColumn("leaf", F.when(left, F.col("leaf")).otherwise(F.col("leaf") + F.expr("leaves div 2"))).select(*points.columns), f"{at}/points")
        half = F.expr("leaves div 2")
        both = planes.select("leaf", half.alias("leaves")).unionByName(planes.select((F.col("leaf") + half).alias("leaf"), (F.col("leaves") - half).alias("leaves")))
        nodes = cut(both.filter("leaves > 1"), f"{at}/children")
    if small is not None:
        names = ["doc_id", "size", "text_crc32", *DIMENSIONS, "k_id", "leaf"]

        def finish(table: pa.Table) -> pa.Table:
            columns = {c: table.column(c).to_numpy() for c in (*DIMENSIONS, "k_id", "size")}
            found = split(columns, table.column("leaf")[0].as_py(), table.column("leaves")[0].as_py(), extent)
            return table.select(names[:-1]).append_column("leaf", pa.array(found))

        mine = points.join(small, "leaf").select(*names, "leaves")
        done = mine.groupBy("leaf").applyInArrow(finish, points.select(*names).schema)
        points = points.join(small, "leaf", "left_anti").select(*names).unionByName(done)
        points = cut(points, f"{home}/leaves")
    rows = points.select("doc_id", "size", "text_crc32", F.col("leaf").cast("int").alias("shard"), "k_id")
    return number(rows, "shard", ["k_id", "text_crc32", "size"]).drop("k_id")


def number(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 in each ``by``, without a task that holds a whole group.

    Rows fall into hashed buckets of about ``SLOT_ROWS``; a window numbers inside a bucket and the
    buckets' counts give where each begins.
    """
    n = rows.count()
    bucketed = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(max(1, n // SLOT_ROWS))))
    counts = bucketed.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    begin = counts.withColumn("_at", F.sum("_n").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(by, "_b", F.coalesce("_at", F.lit(0)).alias("_at"))
    inner = F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order))
    return bucketed.withColumn("_i", inner).join(begin, [by, "_b"]).withColumn("slot", F.col("_at") + F.col("_i") - 1).drop("_b", "_at", "_i")
