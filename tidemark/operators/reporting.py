"""Projections for reports: flattening, labels, LaTeX tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Fields of struct columns become columns with the struct's name before theirs, at any depth."""
    while any(isinstance(f.dataType, StructType) for f in df.schema):
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, StructType):
                cols += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}{sep}{x}") for x in f.dataType.names]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def label(df: DataFrame, col: str, names: dict[str, str], other: int = 999) -> DataFrame:
    """Adds label (the name itself where none is given) and sort_key (its place among ``names``, else ``other``)."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    places = F.create_map(*(F.lit(x) for i, k in enumerate(names, 1) for x in (k, i)))
    return df.withColumn("label", F.coalesce(pairs[F.col(col)], F.col(col))).withColumn("sort_key", F.coalesce(places[F.col(col)], F.lit(other)))


def latex_cell(col: str):
    """A text column with LaTeX's special characters escaped."""
    return F.regexp_replace(col, r"([&%_#])", r"\\$1")


def latex_table(rows: list, columns: list[str], caption: str, name: str) -> str:
    """A tabular environment from a few collected rows; numbers get four digits, missing values '--'."""

    def cell(v) -> str:
        if v is None or v != v:
            return "--"
        return f"{v:.4f}" if isinstance(v, float) else str(v).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_").replace("#", r"\#")

    body = "\n".join(" & ".join(cell(r[c]) for c in columns) + r" \\" for r in rows)
    head = " & ".join(cell(c) for c in columns) + r" \\"
    return "\n".join([r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{name}}}", rf"\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}", r"\hline", head, r"\hline", body, r"\hline", r"\end{tabular}", r"\end{table}"])
