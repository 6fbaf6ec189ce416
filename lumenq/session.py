"""A session: SQL and DataFrame access to the tables of one catalog, with indexes and transactions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import NoSuchTable, ParseError, TypeMismatch
from .functions import scalar
from .functions.embedding import Embedder, HashEmbedder, embed_column, embed_one
from .operators import ivf, retrieval
from .operators.kmeans import KMeansModel, fit_kmeans
from .plans import frontend
from .sources import delimited, service
from .sources.catalog import Catalog
from .types import CID, PART, RID, VECTOR, VECTOR_SUFFIX, TableSchema


class Session:
    """``sql`` runs statements; ``table``, ``insert``, ``delete`` and the loaders do the same from Python.

    ``compat`` gives SQL the value semantics of whole-number division, truncating averages, zero values for
    aggregates of nothing, and LIKE in which only ``%`` is special; without it SQL is Spark's own.
    ``keywords`` are further spellings of the infix operators, for statements written with others:
    ``{"resembles": "semlike"}``.
    """

    def __init__(
        self, spark: SparkSession, root: str, embedder: Embedder | None = None, compat: bool = True, keywords: dict[str, str] | None = None
    ) -> None:
        self.spark, self.compat = spark, compat
        self.keywords = {k.lower(): v.lower() for k, v in (keywords or {}).items()}
        if not set(self.keywords.values()) <= set(frontend.INFIX):
            raise ParseError(f"keywords stand for one of {', '.join(frontend.INFIX)}")
        self.catalog = Catalog(spark, root)
        self.embedder = embedder or HashEmbedder()
        self.last_plan = "exact scan"
        scalar.register(spark)

    # ------------------------------------------------------------------ transactions

    def begin(self) -> None:
        self.catalog.begin()

    def commit(self, serializable_reads: set[str] = frozenset()) -> None:
        self.catalog.commit(serializable_reads)

    def rollback(self) -> None:
        self.catalog.rollback()

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """A transaction around a block, or the one that is open already."""
        if self.catalog.in_transaction:
            yield
            return
        self.begin()
        try:
            yield
        except BaseException:
            if self.catalog.in_transaction:
                self.rollback()
            raise
        self.commit()

    # ------------------------------------------------------------------ tables

    def create_table(self, declaration: str | TableSchema) -> None:
        schema = TableSchema.parse(declaration) if isinstance(declaration, str) else declaration
        with self.transaction():
            self.catalog.create(schema)

    def drop_table(self, name: str) -> None:
        with self.transaction():
            self.catalog.drop(name)
        self.spark.catalog.dropTempView(name)

    def load_catalog(self, text: str) -> list[str]:
        """Create the tables that a catalog text declares."""
        with self.transaction():
            return self.catalog.load_text(text)

    def table(self, name: str, vectors: bool = False, rid: bool = False) -> DataFrame:
        """The rows of a table; vectors of semantic text and row identifiers only if asked for."""
        self.catalog.refresh()
        rows = self.catalog.read(name)
        drop = [] if rid else [RID]
        if not vectors:
            drop += [c.vector for c in self.catalog.schema(name).columns if c.kind == "embtext"]
        return rows.drop(*drop)

    def tables(self) -> DataFrame:
        """(name, declaration, rows, parts, indexes) of every table."""
        self.catalog.refresh()
        rows = []
        for n in self.catalog.names():
            e = self.catalog.entry(n)
            rows.append((n, e["declaration"], e["rows"], len(e["parts"]), ", ".join(f"{i['kind']} {c}" for c, i in sorted(e["indexes"].items()))))
        return self.spark.createDataFrame(rows, "name string, declaration string, rows long, parts long, indexes string")

    def _prepared(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows cast to a table's schema by position, with vectors for semantic text."""
        schema = self.catalog.schema(name)
        if len(rows.columns) != len(schema.columns):
            raise TypeMismatch(f"{name} has {len(schema.columns)} columns, the rows have {len(rows.columns)}")
        renamed = rows.toDF(*[c.name for c in schema.columns])
        out = []
        for field, given in zip(schema.input_schema(), renamed.schema, strict=True):
            if isinstance(field.dataType, T.ArrayType) != isinstance(given.dataType, T.ArrayType):
                raise TypeMismatch(f"{name}.{field.name} is {field.metadata['kind']}, not {given.dataType.simpleString()}")
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
            if field.metadata["kind"] == "embtext":
                out.append(embed_column(self.embedder, F.col(field.name).cast("string")).alias(field.name + VECTOR_SUFFIX))
        return renamed.select(*out)

    def insert(self, name: str, rows: DataFrame) -> int:
        """Append rows (declared columns, by position) and file them into the table's indexes."""
        with self.transaction():
            entry = self.catalog.entry(name)
            ready = self._prepared(name, rows)
            clustered = next(((c, i) for c, i in entry["indexes"].items() if i["kind"] == "clustered"), None)
            if clustered:
                model = ivf.read_model(self.spark, self.catalog.storage.path(clustered[1]["centroids"]))
                ready = ivf.file_rows(ready, model, self._vector(name, clustered[0]))
            part, n = self.catalog.add_rows(name, ready, [CID] if clustered else None)
            for column, index in entry["indexes"].items():
                if index["kind"] == "secondary" and n:
                    self._add_postings(name, column, index, self.catalog.read_parts(name, [part], self.catalog.schema(name).stored_schema()))
            return n

    def delete(self, name: str, where: str | None = None) -> int:
        """Delete the rows for which ``where`` is true; the parts that hold such rows are
        rewritten as one, the others stay."""
        with self.transaction():
            entry = self.catalog.entry(name)
            rewriter = self._rewriter()
            cond, args = "true", {}
            if where:
                cond = frontend.join(rewriter.rewrite(self._tokens(where)))
                args = rewriter.args
            clustered = any(i["kind"] == "clustered" for i in entry["indexes"].values())
            layout = self._layout(name) if clustered else self.catalog.schema(name).stored_schema()
            names = layout.names

            def flagged(parts: list[str]) -> DataFrame:
                rows = self.catalog.read_parts(name, parts, T.StructType([*layout, T.StructField(PART, T.StringType())]))
                view = f"__delete_{uuid.uuid4().hex}"
                rows.createOrReplaceTempView(view)
                try:
                    return self.spark.sql(f"SELECT *, coalesce({self._unqualified(cond, name)}, false) AS __gone FROM {view}", args=args)
                finally:
                    self.spark.catalog.dropTempView(view)

            # One row for each part that loses rows.
            found = {r[0]: r[1] for r in flagged(entry["parts"]).where("__gone").groupBy(PART).count().collect()}
            total = sum(found.values())
            if total:
                changed = [p for p in entry["parts"] if p.rpartition("=")[2] in found]
                marked = flagged(changed)
                rest = self.catalog.new_part(name)
                stay = marked.where("NOT __gone").select(*names)
                writer = stay.hint("rebalance", CID).write.partitionBy(CID) if clustered else stay.write
                writer.parquet(self.catalog.storage.path(rest))
                kept = [] if self.catalog.read_parts(name, [rest], layout).isEmpty() else [rest]
                entry["parts"] = [p for p in entry["parts"] if p not in changed] + kept
                entry["rows"] -= total
                self.catalog.touched.add(name.lower())
                for index in entry["indexes"].values():
                    if index["kind"] == "secondary":
                        self._drop_postings(name, index, marked.where("__gone").select(RID))
            return total

    def _unqualified(self, condition: str, table: str) -> str:
        return re.sub(rf"\b{re.escape(table)}\s*\.\s*", "", condition, flags=re.I)

    def vacuum(self) -> int:
        """Delete parts that no table of the newest state uses; returns how many."""
        self.catalog.refresh()
        used = set()
        for t in self.catalog.names():
            e = self.catalog.entry(t)
            used.update(e["parts"])
            for i in e["indexes"].values():
                used.update([i["centroids"], *i.get("parts", [])])
        n = 0
        for folder in self.catalog.storage.names():
            for part in self.catalog.storage.names(folder):
                if part.startswith(f"{PART}=") and f"{folder}/{part}" not in used:
                    self.catalog.storage.delete(f"{folder}/{part}")
                    n += 1
        return n

    # ------------------------------------------------------------------ loading

    def load_delimited(self, name: str, path: str, sep: str = ",", header: bool = True, trailing_sep: bool = False, strict: bool = False) -> int:
        """Append a delimited file to a table; ``strict`` reads standard CSV with quoting instead."""
        schema = self.catalog.schema(name)
        rows = delimited.read_csv(self.spark, path, schema, sep, header) if strict else delimited.read_delimited(self.spark, path, schema, sep, header, trailing_sep)
        return self.insert(name, rows)

    def import_catalog(self, text: str, folder: str, suffix: str = "tbl", sep: str = "|", trailing_sep: bool = True) -> dict[str, int]:
        """Create every table of a catalog text and load it from ``folder/<table>.<suffix>``; one transaction."""
        with self.transaction():
            names = self.catalog.load_text(text)
            return {n: self.load_delimited(n, f"{folder}/{n}.{suffix}", sep, False, trailing_sep) for n in names}

    def load_service(self, name: str, fetch: service.Fetch, limit: int, random: bool = False, total: int = service.ARTICLES, seed: int = 0) -> int:
        """Create an article table and fill it from a service."""
        with self.transaction():
            if name.lower() not in self.catalog.state["tables"]:
                self.catalog.create(service.article_schema(name))
            return self.insert(name, service.read_service(self.spark, fetch, limit, random, total, seed))

    # ------------------------------------------------------------------ indexes

    def _vector(self, table: str, column: str) -> str:
        found = self.catalog.schema(table).column(column)
        if found is None or found.vector is None:
            raise TypeMismatch(f"{table}.{column} has no vectors")
        return found.vector

    def create_index(self, table: str, column: str, k: int, kind: str = "secondary", iterations: int = 10, metric: str = "dot") -> KMeansModel:
        """Cluster a table by a semantic column and build an index of the kind; one index a column."""
        if kind not in ("secondary", "clustered"):
            raise ParseError("an index is secondary or clustered")
        with self.transaction():
            entry, vector = self.catalog.entry(table), self._vector(table, column)
            if kind == "clustered" and any(i["kind"] == "clustered" for c, i in entry["indexes"].items() if c != column):
                raise TypeMismatch(f"{table} is clustered by another column already")
            rows = self.catalog.read(table)
            model = fit_kmeans(rows, vector, k, RID, iterations, metric)
            centroids = self.catalog.new_part(table)
            ivf.write_centroids(self.spark, model, self.catalog.storage.path(centroids))
            index = {"kind": kind, "column": column, "k": len(model.centroids), "centroids": centroids}
            entry["indexes"][column] = index
            if kind == "secondary":
                index["parts"] = []
                self._add_postings(table, column, index, rows, model)
            else:
                part = self.catalog.new_part(table)
                ivf.file_rows(rows, model, vector).write.partitionBy(CID).parquet(self.catalog.storage.path(part))
                entry["parts"] = [part]
            self.catalog.touched.add(table.lower())
            return model

    def _add_postings(self, table: str, column: str, index: dict, rows: DataFrame, model: KMeansModel | None = None) -> None:
        vector = self._vector(table, column)
        model = model or ivf.read_model(self.spark, self.catalog.storage.path(index["centroids"]))
        part = self.catalog.new_part(table)
        postings = rows.select(RID, F.col(vector).alias("vector"))
        ivf.file_rows(postings, model, "vector").write.partitionBy(CID).parquet(self.catalog.storage.path(part))
        index["parts"].append(part)

    def _drop_postings(self, table: str, index: dict, gone: DataFrame) -> None:
        part = self.catalog.new_part(table)
        rest = self._postings(table, index).join(gone, RID, "left_anti")
        rest.hint("rebalance", CID).write.partitionBy(CID).parquet(self.catalog.storage.path(part))
        index["parts"] = [part]

    def _postings(self, table: str, index: dict) -> DataFrame:
        schema = T.StructType([T.StructField(RID, T.LongType()), T.StructField("vector", VECTOR), T.StructField(CID, T.IntegerType())])
        return self.catalog.read_parts(table, index["parts"], schema)

    def _layout(self, table: str) -> T.StructType:
        """The stored columns of a clustered table, with their cluster."""
        return T.StructType([*self.catalog.schema(table).stored_schema(), T.StructField(CID, T.IntegerType())])

    def _filed(self, table: str) -> DataFrame:
        return self.catalog.read_parts(table, self.catalog.entry(table)["parts"], self._layout(table))

    def index(self, table: str, column: str) -> ivf.IvfIndex | None:
        """The index of a column, if it has one."""
        entry = self.catalog.entry(table)
        info = entry["indexes"].get(column)
        if info is None or not entry["rows"]:
            return None
        centroids = self.spark.read.parquet(self.catalog.storage.path(info["centroids"]))
        if info["kind"] == "clustered":
            return ivf.IvfIndex(self.spark, "clustered", self._vector(table, column), RID, info["k"], entry["rows"], centroids, self._filed(table))
        return ivf.IvfIndex(self.spark, "secondary", "vector", RID, info["k"], entry["rows"], centroids, self._postings(table, info), self.catalog.read(table))

    # ------------------------------------------------------------------ SQL

    def _rewriter(self) -> frontend.Rewriter:
        vectors = {"vector"}
        for t in self.catalog.names():
            vectors |= {c.name for c in self.catalog.schema(t).columns if c.kind == "embvec"}
        return frontend.Rewriter(lambda text: embed_one(self.embedder, text), vectors, self.compat)

    def _register_views(self, tokens: list[frontend.Token]) -> None:
        """Temporary views of the tables and index parts that a statement names."""
        named = {t.low.strip("`") for t in tokens if t.kind == "name"}
        for t in self.catalog.names():
            if t in named:
                self.catalog.read(t).drop(RID).createOrReplaceTempView(t)
            for column, info in self.catalog.entry(t)["indexes"].items():
                for stem in (f"{info['kind']}__{t}__{column}", f"{t}__{column}"):
                    for what in ("centroids", "mapping", "data"):
                        if f"{stem}__{what}" in named and (found := self.index(t, column)):
                            self._index_view(found, what).createOrReplaceTempView(f"{stem}__{what}")

    def _index_view(self, index: ivf.IvfIndex, what: str) -> DataFrame:
        if what == "centroids":
            return index.centroids.select("vector", F.col("cid").alias("centroidid"))
        if what == "mapping":
            return index.mapping()
        return index.postings.select(F.col(index.vector).alias("vector"), RID, F.col(CID).alias("centroidid"))

    def sql(self, statement: str, vectors: bool = False) -> DataFrame:
        """Run one statement. Changes give one row with ``count``; other statements without a result give
        an empty frame. ``vectors`` keeps the vectors of semantic text in results of ``*``."""
        tokens = self._tokens(statement)
        if not tokens:
            raise ParseError("an empty statement")
        self.catalog.refresh()
        first = tokens[0].low
        if first == "explain":
            return self._explain(tokens[1:])
        if first in ("begin", "commit", "rollback"):
            getattr(self, first)()
            return self._done()
        if first == "create" and len(tokens) > 2 and tokens[1].low == "table":
            self.create_table(frontend.join(tokens[2:]))
            return self._done()
        if first == "drop" and len(tokens) > 2 and tokens[1].low == "table":
            self.drop_table(tokens[2].low.strip("`"))
            return self._done()
        if first == "insert":
            return self._insert(tokens)
        if first == "delete":
            return self._delete(tokens)
        return self._select(tokens, vectors)

    def _tokens(self, text: str) -> list[frontend.Token]:
        return frontend.respelled(frontend.tokenize(text), self.keywords)

    def _done(self) -> DataFrame:
        return self.spark.createDataFrame([], "count long")

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    def _insert(self, tokens: list[frontend.Token]) -> DataFrame:
        if len(tokens) < 4 or tokens[1].low != "into":
            raise ParseError("INSERT INTO table VALUES ... or SELECT ...")
        name = tokens[2].low.strip("`")
        if tokens[3].text == "(":
            raise ParseError("INSERT takes no column list")
        if name not in self.catalog.state["tables"]:
            raise NoSuchTable(name)
        if tokens[3].low == "values":
            rows = self.spark.sql(f"SELECT * FROM VALUES {self._values(name, tokens[4:])}")
        else:
            rows = self._select(tokens[3:], False)
        return self._count(self.insert(name, rows))

    def _values(self, name: str, tokens: list[frontend.Token]) -> str:
        """Rows of literals, each value cast to its column: a quoted number is a number."""
        kinds = [f.dataType.simpleString() for f in self.catalog.schema(name).input_schema()]
        rows = []
        for row in frontend.split_commas(tokens):
            if len(row) < 3 or row[0].text != "(" or row[-1].text != ")":
                raise ParseError("VALUES takes rows in parentheses")
            values = frontend.split_commas(row[1:-1])
            if len(values) != len(kinds):
                raise TypeMismatch(f"{name} has {len(kinds)} columns, a row has {len(values)}")
            done = [frontend.join(self._rewriter().rewrite(v)) for v in values]
            rows.append("(" + ", ".join(f"cast({v} AS {k})" for v, k in zip(done, kinds, strict=True)) + ")")
        return ", ".join(rows)

    def _delete(self, tokens: list[frontend.Token]) -> DataFrame:
        if len(tokens) < 3 or tokens[1].low != "from" or (len(tokens) > 3 and tokens[3].low != "where"):
            raise ParseError("DELETE FROM table [WHERE condition]")
        where = frontend.join(tokens[4:]) if len(tokens) > 4 else None
        return self._count(self.delete(tokens[2].low.strip("`"), where))

    def _planned(self, tokens: list[frontend.Token]) -> tuple[list[frontend.Token], str]:
        """The statement with its table replaced by nearest candidates, if an index answers it."""
        plan = frontend.nearest_plan(tokens)
        if plan is None or plan.table not in self.catalog.state["tables"]:
            return tokens, "exact scan"
        column = self.catalog.schema(plan.table).column(plan.column)
        found = self.index(plan.table, plan.column) if column is not None and column.vector else None
        if found is None:
            return tokens, "exact scan"
        view = f"__near_{uuid.uuid4().hex}"
        rows = found.candidates(embed_one(self.embedder, plan.text), plan.limit, plan.ascending)
        rows.drop(RID).createOrReplaceTempView(view)
        note = f"nearest-neighbour scan: {found.kind} index on {plan.table}.{plan.column}, {len(found.opened)} of {found.k} clusters"
        return frontend.replace_table(tokens, plan.table, view), note

    def _select(self, tokens: list[frontend.Token], vectors: bool) -> DataFrame:
        self._register_views(tokens)
        planned, self.last_plan = self._planned(tokens)
        rewriter = self._rewriter()
        semantic = {t: {c.name for c in self.catalog.schema(t).columns if c.kind == "embtext"} for t in self.catalog.names()}
        ready = rewriter.rewrite(frontend.named_items(frontend.carry_vectors(planned, semantic)))
        if self.compat:
            ready = frontend.zero_aggregates(ready, lambda probe: self._zeros(probe, rewriter.args))
        out = self.spark.sql(frontend.join(ready), args=rewriter.args)
        if not vectors:
            out = out.drop(*[c for c in out.columns if c.endswith(VECTOR_SUFFIX) and c[: -len(VECTOR_SUFFIX)] in out.columns])
        return out

    def _zeros(self, probe: list[frontend.Token], args: dict) -> list[str | None]:
        """The zero values of a statement's items, by their types; the statement is analysed, not run."""
        kinds = [f.dataType for f in self.spark.sql(frontend.join(probe), args=args).schema]
        return ["''" if isinstance(k, T.StringType) else "0" if isinstance(k, T.NumericType) else None for k in kinds]

    def _explain(self, tokens: list[frontend.Token]) -> DataFrame:
        self._register_views(tokens)
        out = self._select(tokens, False)
        text = out._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(f"== {self.last_plan} ==\n{text}",)], "plan string")

    # ------------------------------------------------------------------ retrieval

    def retrieve(self, fact: str, table: str, ret: str, text: str, k: int = 1) -> DataFrame:
        """(ret, text, sim) of the ``k`` rows whose ``text`` is nearest to ``fact``, through an index if there is one."""
        query = embed_one(self.embedder, fact)
        vector = self._vector(table, text)
        found = self.index(table, text)
        rows = found.candidates(query, k) if found else self.catalog.read(table)
        return retrieval.retrieve(rows, vector, query, ret, text, k)

    def fact_check(self, fact: str, table: str, ret: str, text: str, llm: retrieval.LanguageModel, use_context: bool = True, k: int = 1) -> str:
        return retrieval.fact_check(fact, self.retrieve(fact, table, ret, text, k), ret, text, llm, use_context)

    def embed(self, text: str) -> Sequence[float]:
        return embed_one(self.embedder, text)
