"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, offered a set number of times. A copy of
a document starts at the words its source has sent before it, divided by the source's weight,
and finishes at those sent with it. All copies are sorted by virtual finish time over all
tasks, and the order is cut at the time at which the budget is spent: copies that finish by
then are whole, and of the one copy that each source has on its way the words sent by then
belong to the mix. So every source gives words in proportion to its weight, and one that
runs dry leaves its share to the others, again by weight.

All running sums follow range-partitioned orders: sums within a part, and one row for each
part in the driver. So no source, however common, is summed up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellzonal.llm.text import Scratch, id_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(
    rows: DataFrame, order: Sequence, values: Mapping[str, str], scratch: Scratch, name: str
) -> DataFrame:
    """rows with sums of columns over all rows before, in an order over all tasks.

    values names each new column and the one it sums. Rows are dealt out by range and kept, so
    that sums and parts agree in every rerun; rows equal in ``order`` come in any order.
    """
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, name)
    sums = ranged.groupBy("part").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    kinds = {n: sums.schema[n].dataType.simpleString() for n in values}
    before, offsets = dict.fromkeys(values, 0), []
    for row in sorted(sums.collect(), key=lambda r: r["part"]):
        offsets.append((row["part"], *before.values()))
        before = {n: s + (row[n] or 0) for n, s in before.items()}
    kind = ", ".join(["part int", *[f"from_{n} {k}" for n, k in kinds.items()]])
    offsets = [(p, *[float(v) if k == "double" else v for v, k in zip(own, kinds.values(), strict=True)]) for p, *own in offsets]
    offsets = rows.sparkSession.createDataFrame(offsets, kind)
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(F.broadcast(offsets), "part")
    made = {n: F.col(f"from_{n}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in values.items()}
    return rows.withColumns(made).drop("part", *[f"from_{n}" for n in values])


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _by_source(sized: DataFrame, weights: Mapping | None, share, repeats, scratch: Scratch):
    """source, source_size, source_from, weight and target of each source, and the time of the cut."""
    totals = sized.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("one", F.lit(1).cast("long"))
    by_name = [F.col("name").asc_nulls_last()]
    sources = running(totals, by_name, {"nth": "one", "source_from": "source_size"}, scratch, "sources")
    if weights:
        given = [F.when(_is(s), F.lit(float(w))) for s, w in weights.items()]
        wrong = F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("name", F.lit("null"))))
        weight = F.coalesce(*given, wrong.cast("double"))
    else:
        cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
        weight = F.get(cycle, (F.col("nth") % len(WEIGHTS)).cast("int"))
    sources = scratch.keep(sources.withColumn("weight", weight), "weights")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)

    # Sources by the time at which they run dry; the budget is spent before one of them does.
    filled = sources.where("source_size > 0").withColumns(
        {"cap": F.lit(repeats) * F.col("source_size"), "dry": F.lit(repeats) * F.col("source_size") / F.col("weight")}
    )
    weight_sum = filled.agg(F.sum("weight")).first()[0] or 0.0
    by_dry = [F.col("dry"), F.col("name").asc_nulls_last()]
    filled = running(filled, by_dry, {"sent": "cap", "gone": "weight"}, scratch, "dry")
    left, rest = F.lit(budget) - F.col("sent"), F.lit(weight_sum) - F.col("gone")
    ends = filled.where(F.col("dry") * rest >= left).agg(F.min_by(left / rest, F.struct("dry", "nth")))
    until = ends.first()[0]
    until = float("inf") if until is None else until
    most = (F.lit(repeats) * F.col("source_size")).cast("double")
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("weight") * F.lit(until), most))
    return sources.select("name", "source_size", "source_from", "weight", target.alias("target")), until


def _is(source) -> Column:
    return F.col("name").isNull() if source is None else F.col("name") == source


def _allotted(docs: DataFrame, weights, share, repeats, scratch: Scratch) -> DataFrame:
    """One row per document: its keys, size, source's figures, taken, and its copies in the mix."""
    sized = docs.select(
        "doc_id", "source",
        word_count(F.col("text")).alias("size"),
        F.md5(id_text()).alias("shuffled"),
        *_keys(docs),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = scratch.keep(sized, "sized")
    sources, until = _by_source(sized, weights, share, repeats, scratch)
    shuffled = [F.col("source").asc_nulls_last(), "shuffled", "doc_id", "size", "key1", "key2", "row"]
    queued = running(sized, shuffled, {"words_before": "size"}, scratch, "queued")
    queued = queued.join(sources, _same("source", "name")).drop("name")
    queued = scratch.keep(
        queued.withColumn("before", F.col("words_before") - F.col("source_from")), "before"
    )

    # All copies by virtual finish time, cut at the time at which the budget is spent.
    quota = F.round("target").cast("long")
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("begins", F.col("before") + F.col("copy") * F.col("source_size"))
    words = F.greatest(F.lit(0), F.least(F.col("size"), quota - F.col("begins")))
    copies = copies.select(
        "row", "copy",
        words.alias("words"),
        (F.col("begins") / F.col("weight")).alias("starts"),
        F.least((F.col("begins") + F.col("size")) / F.col("weight"), F.lit(until)).alias("finishes"),
    ).where("words > 0")
    order = ["finishes", "starts", "row", "copy"]
    copies = running(copies, order, {"position": "words"}, scratch, "copies")
    own = copies.groupBy("row").agg(
        F.sum("words").alias("taken"),
        F.sort_array(F.collect_list(F.struct("copy", "words", "starts", "finishes", "position"))).alias("copies"),
    )
    rows = queued.join(own, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    scratch.drop("sized", "sources", "dry", "queued")
    return rows


def _keys(docs: DataFrame) -> list[Column]:
    """Two hashes that tell different rows apart."""
    same = [F.col(c) for c in ("doc_id", "source", "text")]
    return [
        F.xxhash64(*same).alias("key1"),
        F.xxhash64(F.lit("second"), *same).alias("key2"),
    ]


def queue(
    docs: DataFrame, weights: Mapping | None = None, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies of every document.

    docs: any columns, among them doc_id, text and source. size counts the words (0 for
    a null text). The mix takes ``share`` of all words; weights are by source, else they
    go 3, 1, 2 over the sources by code point, null last. A source is read ``repeats``
    times at most. ``taken`` is how many words of the document the mix takes, repeats
    counted. ``copies`` has the copies taken, each with its words, its virtual times starts and
    finishes, and position, the words before it in the mix. Documents of size 0 take 0 words.
    Rows of the same id, text and source get the same numbers of words in one order
    or another, so the result is the same in every run.
    """
    rows = _allotted(docs, weights, share, repeats, Scratch(docs.sparkSession, "mixing"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mix(
    docs: DataFrame, weights: Mapping | None = None, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """The mixed documents in the order they are read: docs' columns, copy, words, starts, finishes.

    One row for each copy taken, sorted over all tasks by virtual finish time, ties by start,
    doc_id and copy. ``words`` of its words belong to the mix; where these are not all, the
    text ends after them, and n_chars, where docs have it, counts what is left. Documents
    without words are in no mix. Columns of docs called copy, words, starts or finishes are
    replaced.
    """
    made = ("copy", "words", "starts", "finishes")
    rest = [c for c in docs.columns if c not in made]
    rows = _allotted(docs, weights, share, repeats, Scratch(docs.sparkSession, "mixing"))
    # Rows that repeat share the allotments of their kind, in any order.
    own = rows.where("taken > 0").groupBy("key1", "key2").agg(
        F.collect_list(F.struct("size", "copies")).alias("allotted")
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), *_keys(docs))
    same = Window.partitionBy("key1", "key2").orderBy("key1")
    packed = packed.withColumn("nth", F.row_number().over(same))
    taken = packed.join(own, ["key1", "key2"]).withColumn("mine", F.get("allotted", F.col("nth") - 1))
    rows = taken.where("mine is not null").select("doc", "mine.size", F.explode("mine.copies").alias("part"))
    words, text = F.col("part.words"), F.col("doc.text")
    whole = words == F.col("size")
    # Every piece but the last has one word, with the white space before it.
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("mixed_text", F.when(whole, text).otherwise(head))
    columns = {c: F.col(f"doc.`{c}`") for c in rest} | {"text": F.col("mixed_text")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.length("mixed_text").cast(kind))
    return rows.select(
        *[columns[c].alias(c) for c in rest],
        F.col("part.copy").alias("copy"),
        words.alias("words"),
        F.col("part.starts").alias("starts"),
        F.col("part.finishes").alias("finishes"),
    ).orderBy("finishes", "starts", "doc_id", "copy")
