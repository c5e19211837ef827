"""Names for rows: where a row stands in a Parquet table, for good, under columns that clash with none of the caller's."""

from __future__ import annotations

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def is_plain_scan(docs: DataFrame) -> bool:
    """Whether each row is one row of one listing of Parquet files, the same one however often it is read.

    Only then do a file and a place in it name one row: joins, unions, explodes, samples and paths that are read twice repeat or
    change rows.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if not node.deterministic():
            return False
        node = node.child()
    if node.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = node.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return False
    return relation.location().rootPaths().size() == 1


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns that name each row, and the names of these: its file and its place there.

    A plain scan names its own rows; anything else is written to the shared folder first, and the copy names them.
    """
    if is_plain_scan(docs):
        with contextlib.suppress(AnalysisException):
            return _with_place(docs)
    return _with_place(materialise(docs, "rows"))


def _with_place(docs: DataFrame) -> tuple[DataFrame, str, str]:
    file, place = fresh(docs, "_file", "_place")
    where = docs.metadataColumn("_metadata")
    return docs.select("*", where["file_path"].alias(file), where["row_index"].alias(place)), file, place
