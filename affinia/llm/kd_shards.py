"""Sharding by a K-d tree over metadata (native).

A node of the tree is cut in two at the weighted median of its widest dimension, wide as a share of the dimension's
range over the whole table, until each leaf holds one shard's bytes. Medians are found without sorting: the weights of
all open nodes of a level are summed in bins, the bin that holds the median is cut into bins anew, and so on until it
weighs less than ``tolerance`` of a shard. Where one value alone outweighs that, its rows are told apart by a hash and
then by their place in the input, so a value that a third of the rows share is cut like any other.

A row's node is a column; what a level cuts, or seeks, is a table with a row a node, sent to the tasks and joined by
node. So the plan grows with the levels, not with the shards, and one row a node reaches the driver: the bin in which
its median lies. The text is read once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.session import forget, stored, table

BINS = 512
SHARDS = 16
#: Levels after which the rows' nodes are written, and nodes that are sent to the tasks at most; more are joined by shuffle.
LEVELS, SENT = 4, 1_000_000
_ALL = float("inf")
_LARGE = 1e307  # beyond it a dimension's values count as this, so that ranges stay finite
_SOUGHT = "_node:bigint,_dim:int,_stage:int,_f0:double,_f1:double,_lo:double,_hi:double,_below:double,_want:double"
_CUTS = "_node:bigint,_dim:int,_stage:int,_f0:double,_f1:double,_cut:double,_incl:boolean,_half:bigint"


def _value(ds: list[str]) -> Column:
    """The value of a node's dimension."""
    out = F.col(ds[-1])
    for i, d in enumerate(ds[:-1]):
        out = F.when(F.col("_dim") == i, F.col(d)).otherwise(out)
    return out


def _sent(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver, as a literal of the plan."""
    names = [f.partition(":")[0] for f in schema.split(",")]
    text = json.dumps([dict(zip(names, ["Infinity" if v == _ALL else v for v in r])) for r in rows])
    df = spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema}>>")).alias("x")).select("x.*")
    return F.broadcast(df) if len(rows) <= SENT else df


def _medians(rows: DataFrame, ds: list[str], sought: dict[int, dict], slack: float, last: float) -> dict[int, tuple]:
    """For each node sought its cut: dimension, stage, fixed values, value, and whether that goes to the left."""
    spark, cuts, names = rows.sparkSession, {}, ("dim", "stage", "f0", "f1", "lo", "hi", "below", "want")
    while sought:
        t = rows.join(_sent(spark, [(i, *[s[k] for k in names]) for i, s in sought.items()], _SOUGHT), "_node")
        v, h, stage, lo, hi = _value(ds), F.col("_h"), F.col("_stage"), F.col("_lo"), F.col("_hi")
        t = t.withColumn("_k", F.when(stage == 0, v).when(stage == 1, h).otherwise(F.col("_uid")))
        t = t.where(((stage == 0) | (v == F.col("_f0"))) & ((stage < 2) | (h == F.col("_f1"))) & F.col("_k").between(lo, hi))
        b = F.when(hi > lo, F.least(F.floor((F.col("_k") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))).otherwise(0)
        g = t.groupBy("_node", "_below", "_want", b.alias("_b")).agg(F.sum("_size").alias("w"), F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.count("*").alias("n"))
        upto = F.col("_below") + F.sum("w").over(Window.partitionBy("_node").orderBy("_b"))
        got = {r["_node"]: r for r in g.withColumn("upto", upto).where("upto >= _want AND upto - w < _want").select("_node", "upto", "w", "lo", "hi", "n").collect()}
        for i, s in list(sought.items()):
            if i not in got:  # no weight at all: everything to the left
                cuts[i] = (s["dim"], 0, None, None, _ALL, True)
                del sought[i]
                continue
            r = got[i]
            below, level = r.upto - r.w, s["stage"]
            if r.w <= slack or r.n == 1 or (r.lo == r.hi and level == 2):
                up = s["want"] - below <= r.upto - s["want"]  # the nearer end of the bin
                cuts[i] = (s["dim"], level, s["f0"], s["f1"], r.lo if up else r.hi, not up)
                del sought[i]
            elif r.lo == r.hi:
                s |= {"stage": level + 1, f"f{level}": r.lo, "lo": 0.0, "hi": float(1 << 52) if level == 0 else last, "below": below}
            else:
                s |= {"lo": r.lo, "hi": r.hi, "below": below}
    return cuts


def _descend(rows: DataFrame, ds: list[str], cuts: list[tuple]) -> DataFrame:
    """rows in their nodes of the next level: a node's left half keeps its number, the right one's is higher by its left half's shards."""
    t = rows.join(_sent(rows.sparkSession, cuts, _CUTS), "_node", "left")
    v, cut, stage = _value(ds), F.col("_cut"), F.col("_stage")
    upto = lambda k: (k < cut) | (F.col("_incl") & (k == cut))
    third = (F.col("_h") < F.col("_f1")) | ((F.col("_h") == F.col("_f1")) & upto(F.col("_uid")))
    second = (v < F.col("_f0")) | ((v == F.col("_f0")) & F.when(stage == 1, upto(F.col("_h"))).otherwise(third))
    left = F.when(cut.isNull(), True).when(stage == 0, upto(v)).otherwise(second)
    return t.withColumn("_node", F.when(left, F.col("_node")).otherwise(F.col("_node") + F.col("_half"))).select(*rows.columns)


def kd_shards(rows: DataFrame, dims: list[str], size: str = "size", shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """rows plus ``shard`` and ``slot``, the gapless place in the shard.

    dims are numeric columns; null and NaN count as 0. Give the number of shards, or target_bytes for
    ceil(total / target_bytes) of them. Sizes of shards differ from the mean by a few tolerances and one row's size at
    most. Repeated rows and ties are told apart by their place in the input. A null or negative size counts as 0. An
    empty table gives no rows. Columns named shard or slot are replaced, the rest stay, however they are called.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot") or c in (*dims, size)]
    ds = [f"_d{i}" for i in range(len(dims))]
    number = lambda c: F.greatest(F.least(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(_LARGE)), F.lit(-_LARGE)) + F.lit(0.0)
    t = rows.select(F.struct(*kept).alias("_all"), F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_size"), *[number(c).alias(d) for c, d in zip(dims, ds)], F.monotonically_increasing_id().alias("_id"))
    t = t.withColumn("_h", F.pmod(F.xxhash64("_size", *ds, "_id"), F.lit(1 << 52)).cast("double"))
    t = stored(t, "kd").withColumns({"_uid": F.col("_id").cast("double"), "_node": F.lit(0).cast("long")})
    keyed = t.select("_size", "_h", "_uid", "_node", *ds)
    ends = [f(d).alias(f"{k}{d}") for d in ds for k, f in (("lo", F.min), ("hi", F.max))]
    whole = keyed.agg(F.sum("_size").alias("w"), F.max("_uid").alias("last"), *ends).first()
    total, span = whole.w or 0.0, {d: (whole[f"hi{d}"] or 0.0) - (whole[f"lo{d}"] or 0.0) for d in ds}
    n = shards or max(1, -(-int(total) // target_bytes))
    nodes, levels, held = {0: n} if n > 1 else {}, [], None
    while nodes:
        spans = {r["_node"]: r for r in keyed.groupBy("_node").agg(F.sum("_size").alias("w"), *ends).collect()}
        sought = {}
        for i, k in nodes.items():
            if i in spans:
                r = spans[i]
                j = max(range(len(ds)), key=lambda j: ((r[f"hi{ds[j]}"] - r[f"lo{ds[j]}"]) / span[ds[j]] if span[ds[j]] else 0.0))  # noqa: B023
                sought[i] = {"dim": j, "stage": 0, "f0": None, "f1": None, "lo": r[f"lo{ds[j]}"], "hi": r[f"hi{ds[j]}"], "below": 0.0, "want": r.w * (k // 2) / k}
        cuts = _medians(keyed, ds, sought, tolerance * total / n, whole.last or 0.0)
        levels.append([(i, *c, nodes[i] // 2) for i, c in cuts.items()])
        keyed = _descend(keyed, ds, levels[-1])
        if len(levels) % LEVELS == 0:
            keyed, before = stored(keyed, "nodes"), held
            held = keyed
            if before is not None:
                forget(before)
        nodes = {i: k for a, k in nodes.items() for i, k in ((a, k // 2), (a + k // 2, k - k // 2)) if k > 1}
    if held is not None:
        forget(held)
    for cuts in levels:
        t = _descend(t, ds, cuts)
    placed = t.select("_all", "_id", F.col("_node").cast("int").alias("shard"), F.shiftright("_id", 33).alias("_part"))
    # Places run over the input's parts in turn; one task numbers one part's share of one shard.
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    start = counts.withColumn("_from", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_id")) - 1
    out = placed.withColumn("_own", own).join(start, ["shard", "_part"]).select("_all", "shard", (F.col("_from") + F.col("_own")).alias("slot"))
    return out.select(*[F.col(f"_all.`{c}`") for c in kept if c not in ("shard", "slot")], "shard", "slot")


def op1_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, by the tree over size, id, source and language."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.log1p(F.octet_length(text)).alias("m_size"), (F.crc32("source") / F.lit(float(1 << 32))).alias("m_source"), (F.crc32("lang") / F.lit(float(1 << 32))).alias("m_lang"),
    )
    t = kd_shards(rows, ["m_size", "doc_id", "m_source", "m_lang"], shards=SHARDS)
    return t.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
