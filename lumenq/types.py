"""Logical column types and table schemas, and their Spark form.

A semantic text column ``c`` is stored as two columns: ``c`` and its vector ``c__emb``. A vector column is
an array of doubles. The logical type travels in the field's metadata, so it survives any round trip.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import ParseError

VECTOR_SUFFIX = "__emb"
RID = "_rid"
#: The folder levels of stored tables: the part, and in indexes the cluster. Columns can't have these names.
PART, CID = "_part", "_cid"
VECTOR = T.ArrayType(T.DoubleType())

#: Spellings of the four logical types.
SPELLINGS = {
    "int": "int", "integer": "int", "bigint": "int",
    "string": "string", "varchar": "string", "text": "string",
    "embtext": "embtext", "embvec": "embvec",
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str

    @property
    def vector(self) -> str | None:
        """The physical column that holds this column's vector, if it has one."""
        return {"embtext": self.name + VECTOR_SUFFIX, "embvec": self.name}.get(self.kind)


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...]

    @classmethod
    def parse(cls, line: str) -> TableSchema:
        """Read ``name (column type, ...)``."""
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*\((.*)\)\s*", line, re.S)
        if not m:
            raise ParseError(f"not a table declaration: {line!r}")
        columns = []
        for part in m[2].split(","):
            words = part.split()
            kind = SPELLINGS.get(re.sub(r"\(.*", "", words[1].lower())) if len(words) >= 2 else None
            if kind is None:
                raise ParseError(f"not a column declaration: {part.strip()!r}")
            columns.append(Column(words[0].lower(), kind))
        schema = cls(m[1].lower(), tuple(columns))
        stored = [*schema.stored_schema().names, PART, CID]
        if len(set(stored)) < len(stored):
            raise ParseError(f"repeated or reserved column in {line!r}")
        return schema

    def declaration(self) -> str:
        """The line that ``parse`` reads back."""
        return f"{self.name} ({', '.join(f'{c.name} {c.kind}' for c in self.columns)})"

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name.lower()), None)

    def input_schema(self) -> T.StructType:
        """What a writer must supply: no vectors for semantic text."""
        kinds = {"int": T.LongType(), "string": T.StringType(), "embtext": T.StringType(), "embvec": VECTOR}
        return T.StructType([T.StructField(c.name, kinds[c.kind], True, {"kind": c.kind}) for c in self.columns])

    def stored_schema(self) -> T.StructType:
        """What is stored: declared columns, vectors of semantic text, and the row identifier."""
        fields = []
        for f, c in zip(self.input_schema(), self.columns, strict=True):
            fields.append(f)
            if c.kind == "embtext":
                fields.append(T.StructField(c.vector, VECTOR, True, {"vector_of": c.name}))
        return T.StructType([*fields, T.StructField(RID, T.LongType())])


def read_declarations(text: str) -> list[TableSchema]:
    """Schemas of a catalog text, one declaration a line."""
    return [TableSchema.parse(line) for line in text.splitlines() if line.strip()]
