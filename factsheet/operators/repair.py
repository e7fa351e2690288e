"""Change of content or shape. Each operator returns a new DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from factsheet.functions import text
from factsheet.functions.measures import map_categories, row_count
from factsheet.operators.joins import lookup


def recode(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace listed values; others and NULL stay."""
    return df.withColumn(column, map_categories(column, mapping, keep_unmatched=True))


def blanks_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: text.blank_to_null(c) for c in columns})


def add_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed columns without values, to be set later."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns; an unknown name is an error, where ``DataFrame.drop`` would pass it over."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*columns)


#: How a text column is read: the name of a type, or a function from the text to its value, NULL where it does not read.
Reader = str | Callable[[Column], Column]


def _read(column: str, reader: Reader) -> Column:
    present = text.blank_to_null(column)
    return reader(present) if callable(reader) else text.read_as(present, reader)


def _failed_columns(readers: Mapping[str, Reader]) -> Column:
    """Names of the columns whose text is there but does not read."""

    def failed(c: str) -> Column:
        return F.when(text.blank_to_null(c).isNotNull() & _read(c, readers[c]).isNull(), F.lit(c))

    return F.filter(F.array(*[failed(c) for c in readers]), lambda name: name.isNotNull())


def repair_types(df: DataFrame, readers: Mapping[str, Reader], failed: str = "failed_columns") -> DataFrame:
    """Read text columns as types or by parsers, naming in ``failed`` those whose value did not read.

    A blank is unknown rather than wrong: it becomes NULL and does not fail. One pass, no
    shuffle. Keep the clean rows with ``accepted``, look at the others with ``quarantined``.
    """
    read = {c: _read(c, r) for c, r in readers.items()}
    return df.withColumns({failed: _failed_columns(readers), **read})


def accepted(repaired: DataFrame, failed: str = "failed_columns") -> DataFrame:
    return repaired.filter(F.size(failed) == 0).drop(failed)


def quarantined(df: DataFrame, readers: Mapping[str, Reader], failed: str = "failed_columns") -> DataFrame:
    """Rows as they came that ``repair_types`` would fail, with the columns at fault."""
    return df.withColumn(failed, _failed_columns(readers)).filter(F.size(failed) > 0)


def fill_from_sibling(df: DataFrame, group: str, value: str, order_by: str) -> DataFrame:
    """Fill a missing value from the first row of its group, by ``order_by``, that has one.

    One donor per group comes from an aggregate, so a group of any size is combined
    before the shuffle, and only rows with a gap are joined: the rest never move.
    """
    missing = F.col(value).isNull()
    donors = (
        df.groupBy(group)
        .agg(
            F.min_by(value, F.when(~missing, F.col(order_by))).alias("_donor"),
            F.count_if(missing).alias("_gaps"),
        )
        .filter(F.col("_gaps") > 0)
    )
    filled = lookup(df.filter(missing), donors, group, "_gaps").withColumn(value, F.col("_donor"))
    return df.filter(~missing).unionByName(filled.select(*df.columns))


def fill_preview(df: DataFrame, group: str, value: str) -> DataFrame:
    """What a self-join of rows with a gap to the other rows of their group would list.

    The join lists one line per pair, which grows with the square of the group. Its
    columns hold only the group and the sibling's value, so the distinct lines with
    their number of ``pairs`` carry the same content, and counts per value give them.
    """
    missing = F.col(value).isNull()
    per_value = df.filter(F.col(group).isNotNull()).groupBy(group, value).agg(row_count().alias("_n"))
    gaps = (
        per_value.groupBy(group)
        .agg(F.max(F.when(missing, F.col("_n"))).alias("_gaps"), row_count().alias("_values"))
        .filter(F.col("_gaps").isNotNull())
    )
    # A row with a gap does not pair with itself.
    others = F.when(missing, F.col("_n") - 1).otherwise(F.col("_n"))
    return (
        lookup(per_value, gaps, group, "_values", how="inner")
        .withColumn("pairs", F.col("_gaps") * others)
        .filter(F.col("pairs") > 0)
        .select(group, F.col(value).alias("sibling_value"), "pairs")
    )


def split_address(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """Street before the separator, the piece through the next character, city, and length."""
    return df.withColumns(
        {
            f"{column}_street": text.before_separator(column, sep),
            f"{column}_through": text.through_next(column, sep),
            f"{column}_city": text.after_separator(column, sep),
            f"{column}_length": text.trimmed_length(column),
        }
    )


def split_from_right(df: DataFrame, column: str, names: tuple[str, ...], sep: str = ".") -> DataFrame:
    """Name the last parts of a separated text; ``names`` runs from left to right."""
    n = len(names)
    return df.withColumns({name: text.part_from_right(column, n - i, sep) for i, name in enumerate(names)})


def clean_property_table(df: DataFrame) -> DataFrame:
    """The whole repair of a property sales table, down to the published columns."""
    filled = fill_from_sibling(df, "parcel_id", "property_address", "unique_id")
    split = filled.withColumns(
        {
            "sale_date_converted": F.col("sale_date").cast("date"),
            "property_split_address": text.before_separator("property_address"),
            "property_split_city": text.after_separator("property_address"),
        }
    )
    owners = split_from_right(split, "owner_address", ("owner_split_address", "owner_split_city", "owner_split_state"))
    recoded = recode(owners, "sold_as_vacant", {"Y": "Yes", "N": "No"})
    return drop_columns(recoded, "owner_address", "property_address", "tax_district", "sale_date")
