"""A Merkle manifest of a dataset: hashed rows, levels of hashed runs, and a proof for every row (operator 12).

Rows are leaves, ordered by key inside their group. Positions come from ranges of the order and the
counts before them, so no task sees a whole group. A level is a DataFrame: the position floor-divided
by the fanout names the parent, whose children meet in a sorted array of at most `fanout` and are
hashed together. Levels go up until each group has one node, its subroot; the subroots, in the order
of their groups, make a second tree up to the root. Proofs come down the same tables: the path of a
parent is joined to its row, and each child puts its own siblings before it. A level has 1/fanout of
the rows of the one below, so all joins together move about as many rows as the last one does.

Defined results: a null value hashes as `-`; null groups come first, as one group; null keys come
first in their group and are never tampered with. Rows that repeat a key are ordered by their hash,
and rows that are alike in all hashed columns are leaves of their own with the same leaf hash. A group
of one row has its leaf as subroot; one group alone has its subroot as root; a proof without siblings
is the hash of nothing. An empty table gives an empty result. Further columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm._shared import partitions, written

FANOUT = 2
#: Rows with a key whose crc32 this divides are tampered with, to show that verification finds them.
TAMPERED = 7
#: More groups than this are joined by shuffle instead of broadcast (about 100 bytes each).
BROADCAST_GROUPS = 50_000


def row_hash(values: list[Column]) -> Column:
    """SHA-256 of the values one after another, each as its length in bytes, a colon and itself, or `-` if null."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written, with their place from 0 in the order, from ranges of it and their counts."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranged = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each range
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def levels(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """nodes (g, i, n, h, payload), then level above level: g, i, n (nodes of the group at this level), h and the children; most: the greatest n."""
    out = [nodes]
    while most > 1:
        child = F.struct("i", "h", *[c for c in out[-1].columns if c == "payload"])
        grown = out[-1].where("n > 1").groupBy("g", F.expr(f"i div {fanout}").alias("i")).agg(F.expr(f"(first(n) + {fanout - 1}) div {fanout}").alias("n"), F.sort_array(F.collect_list(child)).alias("children"))
        text = F.array_join(F.transform("children", lambda x: shown(x["h"])), "")
        out.append(written(grown.withColumn("h", F.unhex(F.sha2(text, 256))), f"level-{len(out)}"))
        most = -(-most // fanout)
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """g, h and level of the node that is left of each group."""
    out = None
    for k, level in enumerate(tree):
        one = level.where("n = 1").select("g", "h", F.lit(k).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


def paths(tree: list[DataFrame], starts: DataFrame) -> DataFrame:
    """payload, h and path of every leaf. starts: g, level of its top, path and carry (what all of its leaves get).

    A path holds for each level, from the leaf up, the siblings' digests to the left and to the right.
    """

    def beside(children: Column, of: Column, left: bool) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter(children, lambda c: c["i"] < of["i"] if left else c["i"] > of["i"]), lambda c: F.hex(c["h"])), ""))

    alone = starts.where("level = 0").select("g", "path", "carry").join(tree[0].where("n = 1"), "g").select("payload", "h", "path", "carry")
    current = None
    for k in range(len(tree) - 1, 0, -1):
        here = starts.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "path", "carry")
        current = here if current is None else current.unionByName(here)
        current = written(current, f"paths-{k}")  # else the plan grows by a join for each level, and the driver's memory with it
        joined = current.join(tree[k].select("g", "i", "children"), ["g", "i"])
        steps = F.transform("children", lambda x: F.struct(x.alias("node"), F.struct(beside(F.col("children"), x, True).alias("l"), beside(F.col("children"), x, False).alias("r")).alias("step")))
        each = joined.select("g", "path", "carry", F.explode(steps).alias("x"))
        current = each.select("g", F.col("x.node.i").alias("i"), F.concat(F.array("x.step"), "path").alias("path"), "carry", *([F.col("x.node.payload").alias("payload"), F.col("x.node.h").alias("h")] if k == 1 else []))
    return alone if current is None else current.select("payload", "h", "path", "carry").unionByName(alone)


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: shown(F.concat(s["l"], s["r"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, shown(leaf), lambda h, s: F.sha2(F.concat(shown(s["l"]), h, shown(s["r"])), 256))


def manifest(rows: DataFrame, key: str, group: str, columns: list[str], others: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """key, leaf, subroot, root, path and payload (key and others, as a struct) for every row; leaf, subroot and root as bytes.

    columns: what is hashed, in this order. others: further digests to keep beside each leaf, as of a changed row.
    """
    hashed = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("grp"), row_hash([F.col(f"`{c}`") for c in columns]).alias("h"), *[c.alias(f"other_{k}") for k, c in (others or {}).items()])
    placed = positions(written(hashed, "leaves"), ["grp", "key", "h"], "pos")
    groups = positions(written(placed.groupBy("grp").agg(F.min("pos").alias("start"), F.count("*").alias("n")), "groups"), ["grp"], "g")
    count, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    owners = groups.select(F.col("grp").alias("of"), "start", "n", "g")
    owners = F.broadcast(owners) if count <= BROADCAST_GROUPS else owners
    payload = F.struct("key", *[f"other_{k}" for k in others or {}])
    nodes = placed.join(owners, F.col("grp").eqNullSafe(F.col("of"))).select("g", (F.col("pos") - F.col("start")).alias("i"), "n", "h", payload.alias("payload"))
    tree = levels(nodes, most, fanout)
    subroots = written(tops(tree), "subroots")
    upper = levels(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("n"), "h", F.struct("g", "level").alias("payload")), count, fanout)
    top = tops(upper).first()
    root = F.lit(bytes(top["h"]) if top else None).cast("binary")
    none = F.array().cast("array<struct<l: binary, r: binary>>")
    start = subroots.sparkSession.range(1 if count else 0).select(F.lit(0).cast("long").alias("g"), F.lit(len(upper) - 1).alias("level"), none.alias("path"), F.lit(None).cast("binary").alias("carry"))
    starts = paths(upper, start).select("payload.*", "path", F.col("h").alias("carry"))
    return paths(tree, written(starts, "starts")).select(F.col("payload.key").alias(key), F.col("h").alias("leaf"), F.col("carry").alias("subroot"), root.alias("root"), "path", "payload")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    changed = row_hash([more if c == "n_chars" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    made = manifest(docs, "doc_id", "lang", FIELDS, {"changed": F.when(hit, changed)})
    seen = F.coalesce("payload.other_changed", "leaf")
    out = made.select("doc_id", shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(seen, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_sql(table: str = "documents") -> str:
    def h(n_chars: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, {h('n_chars')} AS leaf, CASE WHEN crc % {TAMPERED} = 0 THEN {h('(n_chars::HUGEINT + 1)')} END AS changed
    FROM (SELECT *, {_crc32('doc_id::VARCHAR')} AS crc FROM {table})),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
  lower_ AS (SELECT 0 AS k, lang, i, n, leaf AS h FROM placed
    UNION ALL SELECT k + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lower_ WHERE n > 1 GROUP BY k, lang, i // 2, n),
  subs AS (SELECT lang, h AS subroot, k AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM lower_ WHERE n = 1),
  upper_ AS (SELECT 0 AS k, g AS i, n, subroot AS h FROM subs
    UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_ WHERE n > 1 GROUP BY k, i // 2, n),
  low AS (SELECT p.lang, p.i, x.k, x.h AS sibling, x.i < p.i >> x.k AS before FROM placed p JOIN lower_ x ON x.lang IS NOT DISTINCT FROM p.lang AND x.i // 2 = p.i >> (x.k + 1) AND x.i <> p.i >> x.k AND x.n > 1),
  high AS (SELECT s.lang, s.height + x.k AS k, x.h AS sibling, x.i < s.g >> x.k AS before FROM subs s JOIN upper_ x ON x.i // 2 = s.g >> (x.k + 1) AND x.i <> s.g >> x.k AND x.n > 1),
  steps AS (SELECT placed.lang, placed.i, k, sibling, before FROM placed JOIN low ON low.lang IS NOT DISTINCT FROM placed.lang AND low.i = placed.i
    UNION ALL SELECT placed.lang, placed.i, k, sibling, before FROM placed JOIN high ON high.lang IS NOT DISTINCT FROM placed.lang),
  tall AS (SELECT (SELECT max(height) FROM subs) + (SELECT max(k) FROM upper_) AS most),
  fold AS (SELECT lang, i, 0 AS k, coalesce(changed, leaf) AS h, '' AS proof FROM placed
    UNION ALL SELECT f.lang, f.i, f.k + 1, CASE WHEN f.k >= s.height + t.k THEN f.h WHEN p.sibling IS NULL THEN sha256(f.h) WHEN p.before THEN sha256(p.sibling || f.h) ELSE sha256(f.h || p.sibling) END, f.proof || coalesce(p.sibling, '')
    FROM fold f JOIN subs s ON s.lang IS NOT DISTINCT FROM f.lang CROSS JOIN (SELECT max(k) AS k FROM upper_) t LEFT JOIN steps p ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.i AND p.k = f.k WHERE f.k < (SELECT most FROM tall)),
  done AS (SELECT * FROM fold WHERE k = (SELECT most FROM tall)),
  root AS (SELECT h AS root FROM upper_ WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN done ON done.lang IS NOT DISTINCT FROM placed.lang AND done.i = placed.i JOIN subs ON subs.lang IS NOT DISTINCT FROM placed.lang CROSS JOIN root"""


def _crc32(text: str) -> str:
    """Bit by bit, as DuckDB has no crc32."""
    bits = "list_reduce(list_prepend(crc, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    one = bits.replace("crc", "xor(a, b)", 1)
    return f"xor(list_reduce(list_prepend(4294967295, [ascii(x) for x in string_split({text}, '')]), lambda a, b: {one}), 4294967295)"
