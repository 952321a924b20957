"""Document fingerprints: a homomorphic multiset hash, by DataFrame functions only.

A paragraph (a line that isn't empty) is hashed into a wide vector of small numbers: the sum of the vectors of the
paragraph as a whole and of its blocks of up to BLOCK words. A document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo 2 ** LANE_BITS. It doesn't depend on the order of paragraphs; adding or removing a
paragraph adds or subtracts its vector (shift_fingerprint). Equal texts have equal fingerprints, and so have texts
that differ only in the order of paragraphs or in empty lines. Likeness is the cosine of two centred vectors, cut to
0 to 1: about the share of blocks that two documents have in common.

Null and empty texts have the zero vector; its likeness to itself is 1 and to any other 0. Rows that repeat a doc_id
follow each other in the order of their text, each with an own result; a null doc_id comes first. Columns other than
the id and the text are not read.

The next document is found without a global sort: rows are dealt to runs of ids, each run sorted on its own, and the
first row of each run is also given to the run before it. Runs lie between quantiles of the ids, so gaps and outliers don't
matter; between two quantiles they are equal ranges. Rows that share one id are in one run. The only rows sent everywhere
are the first id of each run, about MOST_RUNS at most. Texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LANES, LANE_BITS, BLOCK = 128, 20, 4
_HEX = LANE_BITS // 4
_HASHES = LANES // 16  # a 64-bit hash has 16 numbers of 4 bits
RUN_ROWS, MOST_RUNS, QUANTILES = 512, 65_536, 1024
_PAIR = 0x0000000F0000000F


def units(text: Column) -> Column:
    """The paragraphs of a text and their blocks of words, as an array of strings."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    blocks = F.regexp_extract_all(text, F.lit(r"[^\s]+(?:[ \t]+[^\s]+){0,%d}" % (BLOCK - 1)), F.lit(0))
    return F.concat(F.transform(lines, lambda x: F.concat(F.lit("\n"), x)), blocks)


def _sums(unit: Column) -> list[Column]:
    """Two lanes to a sum, 32 bits apart; no lane can reach the other before 2 ** 28 units."""
    out = []
    for k in range(_HASHES):
        h = F.when(unit.isNotNull(), F.xxhash64(unit, F.lit(k)))
        for shift in range(0, 32, 4):
            out.append(F.coalesce(F.sum(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_PAIR))), F.lit(0)).alias(f"s{len(out)}"))
    return out


def _lanes() -> Column:
    """The lanes as an array of long, from the columns of _sums."""
    own = [x for i in range(LANES // 2) for x in (F.col(f"s{i}").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(F.col(f"s{i}"), 32))]
    return F.array(*own)


def _text_form(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit((1 << LANE_BITS) - 1))), _HEX, "0"))), "")


def likeness(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Cosine of two arrays of lanes, each centred by its number of units, cut to 0 to 1."""
    mean = 7.5
    zero = F.lit(0.0)
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    dot = F.aggregate(both, zero, lambda s, x: s + (x["a"] - mean * n_a) * (x["b"] - mean * n_b))
    norm = lambda v, n: F.aggregate(v, zero, lambda s, x: s + (x - mean * n) * (x - mean * n))
    cosine = F.least(F.lit(1.0), F.greatest(zero, dot / F.sqrt(norm(a, n_a) * norm(b, n_b))))
    return F.when((n_a == 0) & (n_b == 0), F.lit(1.0)).when((n_a == 0) | (n_b == 0), zero).when(a == b, F.lit(1.0)).otherwise(cosine)


def fingerprints(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The key columns (unique together), fingerprint, lanes (exact sums) and n_units."""
    u = docs.select(*key, F.explode_outer(units(F.coalesce(F.col(text), F.lit("")))).alias("u"))
    counted = F.count("u").alias("n_units")
    return u.groupBy(*key).agg(*_sums(F.col("u")), counted).select(*key, _lanes().alias("lanes"), "n_units").withColumn("fingerprint", _text_form(F.col("lanes")))


def shift_fingerprint(fingerprint: Column, change: Column, sign: int = 1) -> Column:
    """The fingerprint with another one's vector added (sign 1: insertion) or taken away (sign -1: deletion)."""
    at = lambda f, i: F.conv(F.substring(f, i * _HEX + 1, _HEX), 16, 10).cast("long")
    return F.array_join(F.array(*[F.lower(F.lpad(F.hex(F.pmod(at(fingerprint, i) + sign * at(change, i), F.lit(1 << LANE_BITS))), _HEX, "0")) for i in range(LANES)]), "")


def _with_run(rows: DataFrame, run_rows: int, most_runs: int) -> DataFrame:
    """rows with the number of their id's run, which ascends with the id; -1 for a null id."""
    n_runs = max(1, min(most_runs, rows.count() // run_rows))
    cells = min(n_runs, QUANTILES)
    borders = sorted(set(rows.agg(F.percentile_approx("id", [k / cells for k in range(cells + 1)], 10 * QUANTILES)).first()[0] or [0]))
    # the last border that isn't above the id, in two steps
    wide, at_id, array = 32, F.col("id"), lambda own: F.array(*[F.lit(b).cast("long") for b in own])
    upto = lambda a: F.size(F.filter(a, lambda b: b <= at_id))
    head = F.greatest(upto(array(borders[::wide])) - 1, F.lit(0))
    rows = rows.withColumn("_head", head)
    rows = rows.withColumn("_cell", F.greatest(F.col("_head") * wide + upto(F.get(F.array(*[array(borders[i : i + wide]) for i in range(0, len(borders), wide)]), F.col("_head"))) - 1, F.lit(0)))
    # equal ranges between two borders; ids may be 2 ** 64 apart
    per = -(-n_runs // cells)
    big = lambda c: c.cast("decimal(20,0)")
    low, high = (big(F.get(array(x), F.col("_cell"))) for x in (borders, [*borders[1:], borders[-1]]))
    part = F.floor((big(at_id) - low) * per / F.greatest(high - low, F.lit(1).cast("decimal(20,0)"))).cast("long")
    run = F.col("_cell").cast("long") * per + F.greatest(F.least(part, F.lit(per - 1)), F.lit(0))
    return rows.withColumn("run", F.when(at_id.isNull(), F.lit(-1)).otherwise(run)).drop("_head", "_cell")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS, most_runs: int = MOST_RUNS) -> DataFrame:
    """run, at, id, text of every row, and of one borrowed row after each run; at numbers a run's rows.

    A run has about run_rows rows, more where most_runs aren't enough. A window sorts a run on disk where it must.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _with_run(rows, run_rows, most_runs)
    # one row for each run, at most most_runs + 1; each run lends its first row to the run before it, the first run to the last
    heads = rows.groupBy("run").agg(F.min(F.struct("id", "run")).alias("h")).select("run", F.col("h.id").alias("head"))
    order = Window.orderBy("run")
    last = F.max("run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to = heads.withColumns({"to": F.lag("run").over(order), "last": last}).select("run", "head", F.coalesce("to", "last").alias("to"), F.col("to").isNull().alias("wraps"))
    first_id = F.broadcast(to.select(F.col("run").alias("r"), "head", "to", "wraps"))
    # rows that repeat the first id: only the one whose text comes first is lent
    lent = rows.join(first_id, (F.col("run") == F.col("r")) & F.col("id").eqNullSafe(F.col("head"))).groupBy("to", "wraps", "id").agg(F.min("text").alias("text"))
    own = rows.select("run", "id", "text", F.lit(0).alias("lent"))
    both = own.unionByName(lent.select(F.col("to").alias("run"), "id", "text", F.lit(1).alias("lent")))
    inside = Window.partitionBy("run").orderBy("lent", F.col("id").asc_nulls_first(), "text")
    return both.select("run", F.row_number().over(inside).alias("at"), "id", "text", "lent", F.lead("text").over(inside).alias("next_text"))


def edited_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (second half replaced by the next document's start), likenesses."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs, doc_id, text).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.coalesce(F.substring("next_text", F.lit(1), half), F.lit(""))))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    key = ["run", "at", "id", "lent", "n_chars", "edited_sha256"]
    # both versions' units side by side; grouping by a key that starts with run needs no further shuffle
    tagged = lambda t, v: F.transform(units(F.col(t)), lambda x: F.struct(F.lit(v).alias("v"), x.alias("u")))
    u = rows.select(*key, F.explode_outer(F.concat(tagged("text", 0), F.when(F.col("lent") == 0, tagged("edited", 1)).otherwise(F.array().cast("array<struct<v:int,u:string>>")))).alias("x"))
    u = u.select(*key, F.coalesce("x.v", F.lit(0)).alias("v"), "x.u")
    sums = u.groupBy(*key, "v").agg(*_sums(F.col("u")), F.count("u").alias("n")).select(*key, F.struct(_lanes().alias("lanes"), F.col("n").alias("n")).alias("f"), "v")
    f = sums.groupBy(*key).agg(F.max(F.when(F.col("v") == 0, F.col("f"))).alias("f"), F.max(F.when(F.col("v") == 1, F.col("f"))).alias("g"))
    none = F.struct(F.array_repeat(F.lit(0).cast("long"), LANES).alias("lanes"), F.lit(0).cast("long").alias("n"))
    f = f.withColumns({"f": F.coalesce("f", none), "g": F.coalesce("g", none)})
    f = f.withColumn("h", F.lead("f").over(Window.partitionBy("run").orderBy("at")))
    near = lambda x: likeness(F.col("f.lanes"), F.col("f.n"), F.col(f"{x}.lanes"), F.col(f"{x}.n"))
    return f.filter("lent = 0").select(
        F.col("id").alias(doc_id), "n_chars", "edited_sha256", _text_form(F.col("f.lanes")).alias("fingerprint"), _text_form(F.col("g.lanes")).alias("edited_fingerprint"), near("g").alias("near_edited"), near("h").alias("near_next")
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(table(spark, sf_dir, "documents"))
