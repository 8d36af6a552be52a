"""Merkle manifest of a table: a leaf for each row, a tree of runs of three for each group, and one tree over the groups.

Places of leaves come from bitmaps, without sorting rows. Ids of a group set bits in words of 64, of which only those with a
bit are kept (built in each task, then merged by OR). A directory over the words holds how many rows lie before each: prefix
sums within 65,536 neighbours, on four levels, so that no task sees a whole group. A leaf's place is its word's entry plus
the bits below its own. Words in which an id repeats are the exception: rows there are numbered by a range sort of them alone.

Nodes are then keyed by their place: 81 neighbours meet as one slot array, which is reduced four levels at once, and only its
top goes on to the next shuffle. Proofs (siblings left and right, level by level) come back down over the same blocks.

Defined results: null fields count as `-`. A null group is a group of its own and the first; a null id comes before all others.
Rows that share group and id are ordered by their leaf, so that equal rows are interchangeable. A null or empty text is a leaf
like any other. No rows in, no rows out. Columns that the leaf doesn't name take no part; any name may be used for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.shared import documents, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
LEVELS = 4  # reduced in one block
BLOCK = RUN**LEVELS
NEAR = 16  # bits of a level of the directory: so many neighbours at most are summed in one window
NO_ID = -(1 << 62)  # the word of null ids, below all others
_POWERS = [RUN**i for i in range(40)]  # all that fit in a long


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, each with its length in bytes before it."""
    as_text = [c.cast("string") for c in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text]))


def group_key(group: Column) -> Column:
    """A text that is never null and orders as the group does, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df in the given order with each row's number: ranges are sorted apart, written, and counted as they were written."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered")
    part = F.shiftright("_place", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row for each partition: its entries before are a short list, not a window over all
    before = sizes.agg(F.collect_list(F.struct("_part", "_rows")).alias("_all"))
    offset = F.aggregate(F.filter("_all", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda acc, x: acc + x["_rows"])
    offsets = sizes.join(F.broadcast(before)).select("_part", offset.alias("_before"))
    own = F.col("_place").bitwiseAND((1 << 33) - 1)
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_place", "_before")


def bitmap(rows: DataFrame) -> DataFrame:
    """(g, word, bits, n): of each group's ids the words that have a bit, and the rows in them. rows: g, word, bit."""
    return rows.groupBy("g", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """words with before, the rows of the group in earlier words, and size, those of the whole group."""
    def prefix(level: DataFrame, near: list[str], key: str) -> DataFrame:
        return level.withColumn("own", F.coalesce(F.sum("n").over(Window.partitionBy(*near).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))

    levels = [words.select("g", F.col("word").alias("k0"), "n")]
    for i in range(1, 4):
        levels.append(levels[-1].groupBy("g", F.shiftright(f"k{i - 1}", NEAR).alias(f"k{i}")).agg(F.sum("n").alias("n")))
    above = prefix(levels[3], ["g"], "k3").select("g", "k3", F.col("own").alias("before"))  # what is left of a word's number has 10 bits
    above = above.join(levels[3].groupBy("g").agg(F.sum("n").alias("size")), "g")
    for i in (2, 1, 0):
        own = prefix(levels[i].withColumn(f"k{i + 1}", F.shiftright(f"k{i}", NEAR)), ["g", f"k{i + 1}"], f"k{i}")
        above = own.join(above, ["g", f"k{i + 1}"]).select("g", f"k{i}", (F.col("before") + F.col("own")).alias("before"), "size")
    return words.join(above.withColumnRenamed("k0", "word"), ["g", "word"])


def ranked(rows: DataFrame) -> DataFrame:
    """rows (g, id, h, ...) with i, each one's place in its group by id, and n, the group's rows."""
    placed = rows.withColumns({"word": F.coalesce(F.shiftright("id", 6), F.lit(NO_ID)), "bit": F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")})
    words = written(directory(written(bitmap(placed), "bitmaps")), "directory")
    crowded = F.col("n") > F.bit_count("bits")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    found = placed.join(words.where(~crowded), ["g", "word"]).withColumn("i", F.col("before") + below)
    kept = [*rows.columns, "i", F.col("size").alias("n")]
    if words.where(crowded).isEmpty():
        return found.select(kept)
    repeats = numbered(placed.join(words.where(crowded).select("g", "word", "before", "size"), ["g", "word"]), ["g", "word", "id", "h"])
    firsts = repeats.groupBy("g", "word").agg(F.min("number").alias("first"))
    again = repeats.join(firsts, ["g", "word"]).withColumn("i", F.col("before") + F.col("number") - F.col("first"))
    return found.select(kept).unionByName(again.select(kept))


def depth(n: Column) -> Column:
    """Levels above so many nodes."""
    return F.size(F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < n))


def _level(nodes: Column) -> Column:
    """The level above an array of neighbouring nodes."""
    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda j: digest(F.array_join(F.slice(nodes, j * RUN + 1, RUN), "")))


def _siblings(slot: Column, left: Column) -> Column:
    """Of the first left levels of a block: what lies left and right of a slot's ancestor in its run."""
    parts = []
    for i in range(LEVELS):
        at = F.floor(slot / RUN**i).cast("int")
        inside = at % RUN
        row = F.col(f"level_{i}")
        parts.append(F.struct(F.array_join(F.slice(row, at - inside + 1, inside), "").alias("left"), F.array_join(F.slice(row, at + 2, RUN - 1 - inside), "").alias("right")))
    return F.slice(F.array(*parts), F.lit(1), F.least(left, F.lit(LEVELS)))


def climb(nodes: DataFrame, crown) -> DataFrame:
    """nodes (g, n, i, h, ...) with what crown gives for their group, whose proof is put after their own siblings.

    crown: from (g, top) a DataFrame of g, proof (array of left, right) and any columns more.
    """
    rest = [c for c in nodes.columns if c not in ("g", "n", "i", "h")]
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 1
    passes = max(1, -(-sum(p < most for p in _POWERS) // LEVELS))
    tables = []
    for k in range(passes):
        own = rest if k == 0 else []
        slots = nodes.withColumns({"block": F.floor(F.col("i") / BLOCK), "slot": (F.col("i") % BLOCK).cast("int")})
        blocks = slots.groupBy("g", "n", "block").agg(F.array_sort(F.collect_list(F.struct("slot", "h", *own))).alias("slots"))
        blocks = blocks.withColumn("left", F.greatest(depth(F.col("n")) - k * LEVELS, F.lit(0))).withColumn("level_0", F.transform("slots", lambda x: x["h"]))
        for i in range(LEVELS):
            blocks = blocks.withColumn(f"level_{i + 1}", F.when(F.col("left") > i, _level(F.col(f"level_{i}"))).otherwise(F.col(f"level_{i}")))
        blocks = blocks.withColumn("top", F.col(f"level_{LEVELS}")[0]).drop(f"level_{LEVELS}")
        tables.append(written(blocks, "blocks"))
        nodes = tables[-1].select("g", "n", F.col("block").alias("i"), F.col("top").alias("h"))
    up = written(crown(nodes.select("g", F.col("h").alias("top"))), "crown").withColumn("block", F.lit(0).cast("long"))
    crowns = [c for c in up.columns if c not in ("g", "block", "proof")]
    for k in reversed(range(passes)):
        own = rest if k == 0 else []
        node = tables[k].drop("top").join(up, ["g", "block"]).withColumn("node", F.explode("slots"))
        proof = F.concat(_siblings(F.col("node.slot"), F.col("left")), F.col("proof"))
        up = node.select("g", (F.col("block") * BLOCK + F.col("node.slot")).alias("block"), F.col("node.h").alias("h"), *[F.col(f"node.{c}").alias(c) for c in own], *crowns, proof.alias("proof"))
        up = up if k == 0 else written(up.drop("h"), "proofs")
    return up.withColumnRenamed("block", "i")


def _no_proof() -> Column:
    return F.expr("CAST(array() AS array<struct<left: string, right: string>>)")


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (g, id, h, ...) with subroot, root and proof added, and i, the leaf's place in its group."""

    def groups(tops: DataFrame) -> DataFrame:
        tops = numbered(tops, ["g"])
        n = tops.count()
        own = tops.select(F.lit("").alias("g"), F.lit(n).cast("long").alias("n"), F.col("number").alias("i"), F.col("top").alias("h"), F.col("g").alias("group"))
        out = climb(own, lambda one: one.select("g", F.col("top").alias("root"), _no_proof().alias("proof")))
        return out.select(F.col("group").alias("g"), F.col("h").alias("subroot"), "root", "proof")

    return climb(ranked(leaves), groups)


def fold(start: Column, proof: Column | str = "proof") -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, x: digest(F.concat(x["left"], acc, x["right"])))


def proof_digest(proof: Column | str = "proof") -> Column:
    return digest(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""))


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", by: str = "doc_id", **more: Column) -> DataFrame:
    """(g, id, h) of a table's rows, and more Columns under names of their own; written, as it is read several times and leaves the texts behind."""
    own = docs.select(group_key(F.col(group)).alias("g"), F.col(by).cast("long").alias("id"), leaf([F.col(c) for c in fields]).alias("h"), *[c.alias(name) for name, c in more.items()])
    return written(own, "leaves")


def verify(proved: DataFrame, seen: Column) -> DataFrame:
    """proved (root, proof) with folded_root, what the leaf seen now leads to, and whether that is the root."""
    return proved.withColumn("folded_root", fold(seen)).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)

    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n"), leaf([*map(F.col, FIELDS[:-1]), F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    out = verify(manifest(leaves_of(docs, tampered=tampered)), F.coalesce("tampered", "h"))
    return out.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: Trees '1' + source and, of their tops, tree '': nodes of all levels, runs of three as groups; each leaf's proof is what its ancestors' runs hold besides them.
ORACLE = {
    "op13_merkle_manifest": f"""
        WITH RECURSIVE crc AS (SELECT doc_id, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
            lambda c, x: CASE WHEN x < 256 THEN xor(c, x::UBIGINT) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS c FROM documents),
        leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
            {_LEAF.format(text="text")} AS leaf, CASE WHEN c & 1 = 1 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS seen
            FROM documents JOIN crc USING (doc_id)),
        low AS (SELECT g, 0 AS lvl, i, n, leaf AS h FROM leaves
            UNION ALL SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, lvl, i // 3, n),
        tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
        high AS (SELECT '' AS g, 0 AS lvl, i, n, h FROM tops
            UNION ALL SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY g, lvl, i // 3, n),
        path AS (SELECT l.doc_id, 0 AS part, x.lvl, x.i - (l.i // (3 ** x.lvl)::BIGINT) AS off, x.h FROM leaves l JOIN low x ON x.g = l.g AND x.n > 1 AND x.i // 3 = l.i // (3 ** (x.lvl + 1))::BIGINT
            UNION ALL SELECT l.doc_id, 1, x.lvl, x.i - (t.i // (3 ** x.lvl)::BIGINT), x.h FROM leaves l JOIN tops t USING (g) JOIN high x ON x.n > 1 AND x.i // 3 = t.i // (3 ** (x.lvl + 1))::BIGINT),
        step AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, lvl) AS k, coalesce(string_agg(h, '' ORDER BY off) FILTER (WHERE off < 0), '') AS lft,
            coalesce(string_agg(h, '' ORDER BY off) FILTER (WHERE off > 0), '') AS rgt FROM path GROUP BY doc_id, part, lvl),
        folds AS (SELECT doc_id, 0::BIGINT AS k, seen AS h FROM leaves UNION ALL SELECT f.doc_id, f.k + 1, sha256(s.lft || f.h || s.rgt) FROM folds f JOIN step s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
        SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM leaves l JOIN tops t USING (g) CROSS JOIN (SELECT h FROM high WHERE n = 1) r
        LEFT JOIN (SELECT doc_id, string_agg(lft || rgt, '' ORDER BY k) AS p FROM step GROUP BY doc_id) p USING (doc_id)
        JOIN (SELECT doc_id, arg_max(h, k) AS h FROM folds GROUP BY doc_id) f USING (doc_id)"""
}
