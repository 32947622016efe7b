"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, all in DataFrame expressions.

A fingerprint has ``CELLS`` cells of (count, xor of digests, xor of check hashes);
each paragraph's digest falls into three of them. Two sketches of the same shape subtract; cells that hold
one digest only are peeled off, round by round, which recovers the digests
that one text has and the other has not. Where peeling gets stuck, the digests are dealt out to as many larger sketches as the texts'
sizes ask for, and each of these is doubled twice more if it still gets stuck; what is left then is compared digest by digest.

Paragraphs are lines that are not blank; the digest is XXH64. Sketches hold a
text's different paragraphs, whatever their order and how often they come.
Two texts' likeness is the share of their paragraphs that both have: Jaccard's.

Defined cases: null text counts as empty; two texts without paragraphs are
alike (1.0); null ids sort first; rows that repeat an id follow by their text; a single row is followed by itself;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import let
from lectern.llm.common import range_of, shuffle_partitions

CELLS = 12
#: Cells of the larger sketches, and the digests of both texts they are meant for.
LARGER = (24, 48, 96)
DEALT = 10
ROUNDS = 12
#: Row groups per shuffle partition when documents are lined up by id.
GROUPS = 4


def paragraphs(text: Column) -> Column:
    """Digests of a text's different lines that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _size(cells: int | Column) -> Column:
    return F.lit(cells) if isinstance(cells, int) else cells


def _third(cells: int | Column) -> Column:
    return F.lit(cells // 3) if isinstance(cells, int) else (cells / 3).cast("int")


def _placed(key: Column, sign: Column, cells: int | Column) -> Column:
    """A digest with its sign, its three cells and its check hash."""
    third = _third(cells)
    at = F.array(*((F.pmod(F.xxhash64(key, _size(cells) + F.lit(j)), third) + third * j).cast("int") for j in range(3)))
    return F.struct(key.alias("key"), sign.cast("long").alias("sign"), at.alias("at"), _check(key).alias("check"))


def _signed(keys: Column, sign: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(sign).cast("long").alias("sign")))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))


def _of_cell(placed: Column, i: Column, cells: int | Column) -> Column:
    third = F.floor(i / _third(cells)).cast("int")
    return F.filter(placed, lambda k: F.get(k["at"], third) == i)


def sketch(signed: Column, cells: int | Column = CELLS) -> Column:
    """Cells of digests with signs."""
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def fill(placed):
        return F.transform(F.sequence(F.lit(0), _size(cells) - 1), lambda i: F.aggregate(
            _of_cell(placed, i, cells), zero, lambda a, k: _cell(
                a["n"] + k["sign"], a["key"].bitwiseXOR(k["key"]), a["check"].bitwiseXOR(k["check"]))))

    return let(F.transform(signed, lambda k: _placed(k["key"], k["sign"], cells)), fill)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]),
                                               x["check"].bitwiseXOR(y["check"])))


def peel(rest: Column, cells: int | Column = CELLS) -> Column:
    """Struct (cells, found): what can't be peeled, and the recovered digests with signs (1: first text only)."""
    none = F.array().cast("array<struct<key:bigint,sign:bigint>>")

    def step(state, _):
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]))
        once = F.array_distinct(F.transform(pure, lambda c: _placed(c["key"], c["n"], cells)))

        def take(found):
            left = F.transform(state["cells"], lambda c, i: F.aggregate(_of_cell(found, i, cells), c, lambda a, k: _cell(
                a["n"] - k["sign"], a["key"].bitwiseXOR(k["key"]), a["check"].bitwiseXOR(k["check"]))))
            said = F.transform(found, lambda k: F.struct(k["key"].alias("key"), k["sign"].alias("sign")))
            return F.when(F.size(found) == 0, state).otherwise(
                F.struct(left.alias("cells"), F.concat(state["found"], said).alias("found")))

        return let(once, take)

    start = F.struct(rest.alias("cells"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _empty(state: Column) -> Column:
    return F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))


def _exactly(signed: Column) -> Column:
    """Digests left over when equal ones of both signs cancel."""
    side = [F.transform(F.filter(signed, lambda k, s=s: k["sign"] == s), lambda k: k["key"]) for s in (1, -1)]
    return F.concat(_signed(F.array_except(*side), 1), _signed(F.array_except(*side[::-1]), -1))


def _dealt(signed: Column, n: Column) -> Column:
    """Digests dealt out to about n/DEALT groups, in two steps of about the root of that."""
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(n / F.lit(DEALT)))).cast("int")

    def part(keys, width, salt):
        return F.transform(F.sequence(F.lit(0), width - 1), lambda g: F.filter(
            keys, lambda k: F.pmod(F.xxhash64(k["key"], F.lit(salt)), width) == g))

    return let(wide, lambda w: F.flatten(F.transform(part(signed, w, "first"), lambda keys: part(keys, w, "second"))))


def _groups(first: Column, a: Column, b: Column) -> Column:
    """What is left to recover after the fingerprints: groups of digests of both texts, none where nothing is."""
    signed = F.concat(_signed(a, 1), _signed(b, -1))
    groups = F.transform(_dealt(signed, F.size(a) + F.size(b)), lambda keys: F.struct(F.lit(False).alias("done"), keys.alias("keys")))
    none = F.array().cast("array<struct<done:boolean,keys:array<struct<key:bigint,sign:bigint>>>>")
    return F.when(_empty(first), none).otherwise(groups)


def _retried(groups: Column) -> Column:
    """Each group's difference by a larger sketch, by an even larger one where that fails."""
    def tried(size, g):
        return let(peel(sketch(g["keys"], size), size), lambda s: F.struct(
            _empty(s).alias("done"), F.when(_empty(s), s["found"]).otherwise(g["keys"]).alias("keys")))

    return F.aggregate(F.array(*map(F.lit, LARGER)), groups, lambda all_, size: F.transform(
        all_, lambda g: F.when(g["done"], g).otherwise(tried(size, g))))


def _recovered(first: Column, groups: Column) -> Column:
    """Everything that peeling found, and the rest by comparing digest by digest."""
    rest = F.flatten(F.transform(groups, lambda g: F.when(g["done"], g["keys"]).otherwise(_exactly(g["keys"]))))
    return F.when(_empty(first), first["found"]).otherwise(rest)


def difference(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """Digests that only one of two texts has, with signs, from their digests and fingerprints' cells."""
    return let(peel(subtract(a_cells, b_cells)), lambda first: _recovered(first, _retried(_groups(first, a, b))))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    both, apart = F.size(a) + F.size(b), F.size(differing)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart))


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"]))), ":")


def followed(docs: DataFrame, text: str = "text", key: str = "doc_id", groups: int | None = None) -> DataFrame:
    """Rows (doc_id, text, next): each text with that of the next document by id, the first one's after the last.

    Documents are shuffled once, into ranges of ids. The first document of a range goes to the range before it too.
    Only the borders of the ranges pass through the driver: as many as there are ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    groups = groups or GROUPS * shuffle_partitions(spark)
    own = rows.withColumn("_range", range_of(rows, "doc_id", groups))
    firsts = own.groupBy("_range").agg(F.min(F.struct("doc_id")).alias("first")).collect()
    first = {r["_range"]: r["first"]["doc_id"] for r in firsts}
    order = sorted(first)
    before = dict(zip(order, [order[-1], *order[:-1]] if order else [], strict=True))
    table = spark.createDataFrame([(r, first[r], before[r]) for r in order], "_range int, _first long, _before int")
    spot = F.struct(F.col("_range").alias("to"), F.lit(0).alias("lent"))
    lent = F.struct(F.col("_before").alias("to"), F.lit(1).alias("lent"))
    both = (own.join(F.broadcast(table), "_range")
            .withColumn("_to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.array(spot, lent)).otherwise(F.array(spot))))
            .select("doc_id", "text", "_to.to", "_to.lent"))
    line = Window.partitionBy("to").orderBy("lent", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next", F.lead("text").over(line)).where("lent = 0").select("doc_id", "text", "next")


def fingerprint_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", groups: int | None = None) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the next one's beginning, and likenesses."""
    rows = followed(docs, text, key, groups)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"),
                       paragraphs(F.col("edited")).alias("cut"), paragraphs(F.col("next")).alias("next"))
    for name in ("own", "cut", "next"):
        rows = rows.withColumn(f"{name}_cells", sketch(_signed(F.col(name), 1)))
    # One column per step: nested in one another, the steps would take the analyzer many rounds.
    for name in ("cut", "next"):
        first, groups = F.col(f"{name}_first"), F.col(f"{name}_groups")
        rows = rows.withColumn(f"{name}_first", peel(subtract(F.col("own_cells"), F.col(f"{name}_cells"))))
        rows = rows.withColumn(f"{name}_groups", _groups(first, F.col("own"), F.col(name)))
        rows = rows.withColumn(f"{name}_groups", _retried(groups))
        rows = rows.withColumn(f"{name}_apart", _recovered(first, groups))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own_cells")).alias("fingerprint"),
                       as_text(F.col("cut_cells")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("cut"), F.col("cut_apart")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next"), F.col("next_apart")).alias("near_next"))
