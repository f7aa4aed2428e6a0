"""The eight marketplace tables as one value."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class MarketplaceTables:
    """Raw marketplace inputs.  Every field is a lazily evaluated DataFrame."""

    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    customers: DataFrame
    payments: DataFrame
    reviews: DataFrame
    sellers: DataFrame
    category_translation: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def sql_args(self) -> dict[str, DataFrame]:
        """Keyword arguments for ``spark.sql(text, **args)``; the SQL texts use
        the marketplace table names as ``{orders}``, ``{payments}``, ..."""
        args = self.as_dict()
        args["product_category_name_translation"] = args.pop("category_translation")
        return args
