"""Taxonomy: selections, filters, drill-down, lookups (F7, F8, T-1 .. T-10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Ranks from coarse to fine, and the extra rank of the lookup.
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
LOOKUP_RANKS = (*RANKS, "infraspecificEpithet")

# Everyday names and what they stand for.
ALIASES: dict[str, dict[str, str]] = {
    "all": {},
    "all species": {},
    "birds": {"kingdom": "Animalia", "phylum": "Chordata", "class": "Aves"},
    "crows": {"kingdom": "Animalia", "phylum": "Chordata", "class": "Aves", "family": "Corvidae"},
    "mammals": {"kingdom": "Animalia", "phylum": "Chordata", "class": "Mammalia"},
    "homo sapiens": {
        "kingdom": "Animalia",
        "phylum": "Chordata",
        "class": "Mammalia",
        "order": "Primates",
        "family": "Hominidae",
        "genus": "Homo",
        "species": "Homo sapiens",
    },
}
CLASSIFICATION_TYPE = "struct<" + ",".join(f"`{r}`:string" for r in RANKS) + ">"

Selection = Mapping[str, str]


# -- selections -----------------------------------------------------------------


def normalise_selection(selection: Mapping[str, str | None]) -> dict[str, str]:
    """Set ranks only, coarse to fine (T-4)."""
    return {r: selection[r] for r in RANKS if selection.get(r)}


def set_rank(selection: Mapping[str, str | None], rank: str, name: str | None) -> dict[str, str]:
    """Choose a name at one rank; finer choices no longer hold (T-5)."""
    coarser = RANKS[: RANKS.index(rank)]
    chosen = {r: selection.get(r) for r in coarser}
    return normalise_selection({**chosen, rank: name})


def normalised_columns() -> dict[str, Column]:
    """Rank columns, coarse to fine, in which an empty name is an unset one (T-4)."""
    return {r: F.nullif(F.col(f"`{r}`"), F.lit("")) for r in RANKS}


def set_rank_columns(rank: Column, name: Column) -> dict[str, Column]:
    """Rank columns after each row's choice of a name at a rank; finer ones are unset (T-5).

    A null rank, or one that is none of the ranks, is no choice and leaves all as they were.
    """
    at = F.array_position(F.lit(list(RANKS)), rank)
    chosen = {}
    for i, (r, own) in enumerate(normalised_columns().items(), 1):
        named = F.when(at == i, F.nullif(name, F.lit(""))).when((at == 0) | (at > i), own)
        chosen[r] = F.when(rank.isNull(), own).otherwise(named)
    return chosen


def selection_text(selection: Mapping[str, str | None]) -> str:
    """``Rank: name`` lines (T-7)."""
    lines = [f"{r.title()}: {name}" for r, name in normalise_selection(selection).items()]
    return "\n".join(lines) or "No selection made"


def selection_table(spark: SparkSession, selection: Mapping[str, str | None]) -> DataFrame:
    """Two columns Rank, Selection for one selection (T-6)."""
    rows = [(r.title(), name) for r, name in normalise_selection(selection).items()]
    return spark.createDataFrame(rows, "Rank string, Selection string")


def selection_rows(selections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many selections, one rank column each, as rows (keys, Rank, Selection) (T-6)."""
    named = selections.select(*keys, *[F.col(f"`{r}`").alias(r.title()) for r in RANKS])
    return named.unpivot(
        list(keys), [r.title() for r in RANKS], "Rank", "Selection"
    ).where(F.col("Selection").isNotNull())



def selection_text_column(prefix: str = "") -> Column:
    """The text of a selection held in rank columns (T-7)."""
    lines = [F.concat(F.lit(f"{r.title()}: "), F.col(f"`{prefix}{r}`")) for r in RANKS]
    text = F.concat_ws("\n", *lines)
    return F.when(text == "", F.lit("No selection made")).otherwise(text)


# -- filters --------------------------------------------------------------------


def taxon_predicate(columns: Sequence[str], selection: Selection, strict: bool = False) -> Column | None:
    """All chosen ranks equal; ranks the table lacks are ignored unless strict."""
    unknown = [r for r in selection if r not in columns]
    if strict and unknown:
        raise ValueError(f"unknown ranks {unknown}")
    tests = [F.col(f"`{r}`") == F.lit(name) for r, name in selection.items() if r in columns]
    return reduce(lambda a, b: a & b, tests) if tests else None


def filter_taxa(facts: DataFrame, selection: Selection | None, strict: bool = False) -> DataFrame:
    """Facts of the chosen taxa; facts carry the rank columns."""
    predicate = taxon_predicate(facts.columns, selection or {}, strict)
    return facts if predicate is None else facts.where(predicate)


def filter_by_taxonomy(
    facts: DataFrame,
    taxonomy: DataFrame,
    selection: Selection | None,
    strict: bool = False,
    key: str = "taxon_id",
    id_column: str = "id",
) -> DataFrame:
    """Facts of the chosen taxa, by way of a taxonomy table (F8).

    Inner join on the taxon id; without a selection there is no join. The filter
    reaches the taxonomy scan, and Spark broadcasts what is left when it is small.
    """
    if not selection:
        return facts
    chosen = filter_taxa(taxonomy, selection, strict).select(F.col(id_column).alias(key))
    return facts.join(chosen, key)


# -- drill-down -----------------------------------------------------------------


def root_taxa(taxonomy: DataFrame, rank: str = "kingdom") -> DataFrame:
    """Names at the top rank, sorted (T-1)."""
    return taxonomy.select(rank).where(F.col(rank).isNotNull()).distinct().orderBy(rank)


def child_taxa(taxonomy: DataFrame, rank: str, name: str) -> DataFrame:
    """Names one rank below a taxon; the next rank is the next column (T-2)."""
    columns = taxonomy.columns
    position = columns.index(rank) + 1
    if position == len(columns):
        raise ValueError(f"no rank below {rank!r}")
    below = F.col(f"`{columns[position]}`")
    return taxonomy.where((F.col(f"`{rank}`") == name) & below.isNotNull()).select(below).distinct()


def lineage(taxonomy: DataFrame, rank: str, name: str) -> DataFrame:
    """Distinct classifications of a name, from the top rank down to its own (T-3)."""
    wanted = [F.col(f"`{r}`") for r in LOOKUP_RANKS[: LOOKUP_RANKS.index(rank) + 1]]
    return taxonomy.where(F.col(f"`{rank}`") == name).select(*wanted).distinct()


# -- requests -------------------------------------------------------------------


def alias_table(spark: SparkSession, aliases: Mapping[str, Selection] = ALIASES) -> DataFrame:
    """Known phrases with their rank columns."""
    rows = [
        F.struct(
            F.lit(phrase).alias("phrase"),
            *[F.lit(names.get(r)).cast("string").alias(r) for r in RANKS],
        )
        for phrase, names in aliases.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def resolve_aliases(requests: DataFrame, aliases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Requests with the classification of their phrase and a ``known`` flag (T-8)."""
    named = aliases.withColumnRenamed("phrase", "_phrase").withColumn("_known", F.lit(True))
    joined = requests.join(named, F.lower(F.trim(F.col(phrase))) == F.col("_phrase"), "left")
    ranks = [F.col(f"`{r}`") for r in RANKS]
    return joined.select(
        *requests.columns, *ranks, F.coalesce("_known", F.lit(False)).alias("known")
    )


def parse_classification(requests: DataFrame, json: str = "json") -> DataFrame:
    """JSON classification to rank columns, with ``valid`` = no key beyond the ranks (T-10)."""
    known = F.array(*[F.lit(r) for r in RANKS])
    extra = F.size(F.array_except(F.json_object_keys(F.col(json)), known))
    parsed = F.from_json(F.col(json), CLASSIFICATION_TYPE)
    rest = [c for c in requests.columns if c != json]
    return requests.select(
        *rest, parsed.alias("_c"), F.coalesce(extra == 0, F.lit(False)).alias("valid")
    ).select(*rest, *[F.col(f"_c.`{r}`").alias(r) for r in RANKS], "valid")


def check_lineage(proposals: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """Whether each proposed classification occurs in the taxonomy (T-9).

    Rows ``key, found``. Ranks left open match anything, and a proposal that
    names no rank is always found. Each different proposal is checked once: it
    meets the taxonomy on its finest named rank, then the coarser ones compare.
    """
    none = F.lit(None).cast("string")

    def up_to(i: int) -> Column:
        names = [
            (F.col(f"`{r}`") if j <= i else none).alias(f"_t{j}") for j, r in enumerate(RANKS)
        ]
        return F.struct(F.lit(i).alias("_rank"), F.col(f"`{RANKS[i]}`").alias("_name"), *names)

    lineages = (
        taxonomy.select(F.explode(F.array(*[up_to(i) for i in range(len(RANKS))])).alias("_l"))
        .select("_l.*")
        .where(F.col("_name").isNotNull())
        .distinct()
    )
    finest_first = list(reversed(list(enumerate(RANKS))))
    rank = F.coalesce(*[F.when(F.col(f"`{r}`").isNotNull(), F.lit(i)) for i, r in finest_first])
    name = F.coalesce(*[F.col(f"`{r}`") for _, r in finest_first])
    proposed = [F.col(f"`{r}`").alias(f"_p{i}") for i, r in enumerate(RANKS)]
    different = proposals.select(*proposed, rank.alias("_rank"), name.alias("_name")).distinct()
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"_p{i}").isNull() | (F.col(f"_p{i}") == F.col(f"_t{i}")) for i in range(len(RANKS))],
    )
    right = (
        different.join(lineages, ["_rank", "_name"])
        .where(same)
        .select(*[F.col(f"_p{i}").alias(f"_r{i}") for i in range(len(RANKS))])
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    agree = [F.col(f"`{r}`").eqNullSafe(F.col(f"_r{i}")) for i, r in enumerate(RANKS)]
    unnamed = F.coalesce(*[F.col(f"`{r}`") for r in RANKS]).isNull()
    found = F.coalesce(F.col("_found"), unnamed)
    return proposals.join(right, reduce(lambda a, b: a & b, agree), "left").select(
        key, found.alias("found")
    )
