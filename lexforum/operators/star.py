"""Star schema of a corpus: external ids, parents on demand, load modules in order, dry runs, status; agreement of raters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.functions.stats import running_totals

#: The tables of the schema; keys come first. Parents stand before children.
TABLES = {
    "corpora": "corpus_id string, name string, kind string",
    "documents": "document_id string, corpus_id string, title string, year int, path string, n_chars long",
    "hearings": "hearing_id string, corpus_id string, place string, aliases array<string>",
    "participants": "participant_id string, hearing_id string, role string",
    "models": "model_id string, name string, version string",
    "runs": "run_id string, model_id string, started timestamp",
    "indicators": "code string, name string, weight double, low double, high double",
    "blocks": "block_id string, document_id string, section string, position int, parent_id string, text string, n_chars int",
    "scores": "block_id string, code string, value double, model_id string, run_id string",
    "segments": "segment_id string, hearing_id string, participant_id string, start double, end double, text string",
    "channels": "segment_id string, channel string, name string, value double",
}
#: Foreign keys: table, column, parent table, its key.
REFERENCES = [
    ("documents", "corpus_id", "corpora", "corpus_id"), ("hearings", "corpus_id", "corpora", "corpus_id"), ("participants", "hearing_id", "hearings", "hearing_id"),
    ("runs", "model_id", "models", "model_id"), ("blocks", "document_id", "documents", "document_id"), ("blocks", "parent_id", "blocks", "block_id"),
    ("scores", "block_id", "blocks", "block_id"), ("scores", "code", "indicators", "code"), ("scores", "model_id", "models", "model_id"), ("scores", "run_id", "runs", "run_id"),
    ("segments", "hearing_id", "hearings", "hearing_id"), ("segments", "participant_id", "participants", "participant_id"), ("channels", "segment_id", "segments", "segment_id"),
]


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def orphans(tables: Mapping[str, DataFrame], references: list[tuple[str, str, str, str]] = REFERENCES) -> DataFrame:
    """Rows of each foreign key that name no parent: table, column, orphans."""
    out = None
    for child, column, parent, key in references:
        lost = tables[child].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias(column)).distinct(), column, "left_anti")
        one = lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(child).alias("table"), F.lit(column).alias("column"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


def external_id(document: Column, section: Column, position: Column) -> Column:
    """document__section__position."""
    return F.concat_ws("__", document, section, position.cast("string"))


def with_parents(blocks: DataFrame, existing: DataFrame, doc: str = "doc", section: str = "section", ext: str = "ext", prefix: str = "D") -> DataFrame:
    """The blocks with `parent`, and a row (is_parent) for every parent that neither exists nor is made twice."""
    named = blocks.withColumn("parent", external_id(F.concat(F.lit(prefix), F.col(doc).cast("string")), F.col(section), F.lit("padre"))).withColumn("is_parent", F.lit(False))
    made = named.select(F.col(doc), F.col(section), F.col("parent").alias(ext)).distinct().join(existing.select(F.col(ext)), ext, "left_anti")
    return named.unionByName(made.withColumn("is_parent", F.lit(True)), allowMissingColumns=True)


@dataclass
class Loader:
    """Load modules in the order of their parents. A module takes the tables so far and gives rows of its own; an error stays its own.

    `settle` is applied to a module's rows: one that writes them lets errors of tasks, too, stay with their module, and cuts lineage.
    """

    modules: dict[str, tuple[tuple[str, ...], Callable[[dict[str, DataFrame]], DataFrame]]] = field(default_factory=dict)
    targets: dict[str, tuple[str, bool]] = field(default_factory=dict)
    settle: Callable[[DataFrame], DataFrame] = lambda df: df

    def module(self, table: str, after: tuple[str, ...] = (), name: str | None = None, replaces: bool = False):
        """A module of this name (else the table's) that adds to the table, or gives it anew."""

        def add(f: Callable[[dict[str, DataFrame]], DataFrame]):
            self.modules[name or table] = (after, f)
            self.targets[name or table] = (table, replaces)
            return f

        return add

    def order(self, only: set[str] | None = None) -> list[str]:
        """Modules, parents first; with `only`, these and what they come after."""
        out: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"{name} comes after itself")
            if name not in out and name in self.modules:
                for parent in self.modules[name][0]:
                    visit(parent, (*above, name))
                out.append(name)

        for name in self.modules:
            if only is None or name in only:
                visit(name, ())
        return out

    def run(self, tables: dict[str, DataFrame], only: set[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """Tables with all rows added, and errors by module. Tables are not written; a module whose parent failed is left out."""
        done, errors = dict(tables), {}
        for name in self.order(only):
            lost = [p for p in self.modules[name][0] if p in errors]
            table, replaces = self.targets[name]
            try:
                if lost:
                    raise RuntimeError(f"after {', '.join(lost)}, which failed")
                rows = self.settle(self.modules[name][1](done))
                done[table] = done[table].unionByName(rows, allowMissingColumns=True) if table in done and not replaces else rows
            except Exception as e:  # an error of one module stops none that does not need it
                errors[name] = f"{type(e).__name__}: {e}".splitlines()[0]
        return done, errors


def with_keys(rows: DataFrame, natural: list[str], key: str, known: DataFrame | None = None) -> DataFrame:
    """Adds a whole-number key for each distinct natural key: the one that `known` (natural, key) has for it, else the next above the largest there, in order of the natural keys.

    New keys are numbered by ranges, so no task sees them all; rows that come again keep their keys. Nulls are values like others.
    """
    names = rows.select(F.struct(*natural).alias("_n")).distinct()
    if known is None:
        told = names.limit(0).withColumn(key, F.lit(0).cast("long"))
    else:
        told = known.select(F.struct(*natural).alias("_n"), F.col(key).cast("long").alias(key)).distinct()
    most = told.agg(F.max(key)).first()[0] or 0
    fresh = running_totals(names.join(told, "_n", "left_anti").withColumn("_one", F.lit(1).cast("long")), [], "_n", ["_one"])
    numbered = told.unionByName(fresh.select("_n", (F.col("upto__one") + most).alias(key)))
    return rows.withColumn("_n", F.struct(*natural)).join(numbered, "_n").drop("_n")


def with_lookup(rows: DataFrame, dimension: DataFrame, natural: Mapping[str, str], key: str, name: str | None = None) -> DataFrame:
    """Adds the key of the dimension's row whose natural key is the same (natural: column of rows to column of dimension), under `name`; null where there is none. The dimension has one row for each natural key."""
    side = dimension.select(F.struct(*natural.values()).alias("_d"), F.col(key).alias(name or key))
    out = rows.withColumn("_d", F.struct(*(F.col(a).alias(b) for a, b in natural.items())))
    return out.join(side, "_d", "left").drop("_d")


class Conflict(RuntimeError):
    """Another commit came first."""


def _storage(spark: SparkSession, folder: str):
    """The folder's file system and its path class."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    files, path = _storage(spark, f"{folder}/manifests")
    if not files.exists(path(f"{folder}/manifests")):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(path(f"{folder}/manifests")) if s.getPath().getName().isdigit())


def _places(spark: SparkSession, folder: str) -> dict[str, str]:
    """Folder of each table by the last manifest."""
    numbers = _manifests(spark, folder)
    if not numbers:
        return {}
    lines = [r.value for r in spark.read.text(f"{folder}/manifests/{numbers[-1]:010d}").collect()]  # one line for each table
    return dict(line.split("\t", 1) for line in lines)


def committed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last whole commit; none where there was no commit."""
    return {name: spark.read.parquet(f"{folder}/{place}") for name, place in _places(spark, folder).items()}


def commit(tables: Mapping[str, DataFrame], folder: str, dry_run: bool = False, rows_per_file: int = 0) -> DataFrame:
    """Writes the tables as Parquet, all or none; a dry run only counts. Gives table and rows.

    Tables go to folders of a new version; then one manifest, made beside and renamed, names the version of every table.
    A failure before leaves the last commit as it was, for readers too (see committed); tables that are not given stay.
    Of two commits at a time the later one is a Conflict. rows_per_file: rows of a file at most (0: no limit).
    """
    spark = next(iter(tables.values())).sparkSession
    if not dry_run:
        number = (_manifests(spark, folder) or [0])[-1] + 1
        places = _places(spark, folder)
        version = f"versions/{number:010d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/{version}/{name}")
            places[name] = f"{version}/{name}"
        files, path = _storage(spark, folder)
        made, final = path(f"{folder}/manifests/.{version.split('/')[1]}"), path(f"{folder}/manifests/{number:010d}")
        out = files.create(made, False)
        out.write(bytearray("".join(f"{n}\t{p}\n" for n, p in sorted(places.items())).encode()))
        out.close()
        if files.exists(final) or not files.rename(made, final):
            raise Conflict(f"manifest {number} of {folder} is there already")
        tables = {name: spark.read.parquet(f"{folder}/{places[name]}") for name in tables}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def status_roll_up(tables: Mapping[str, DataFrame], few: int = 10) -> DataFrame:
    """Tables by status: ERROR without rows, WARN with fewer than `few`, else OK; their number, rows and names."""
    sizes = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name))
        sizes = one if sizes is None else sizes.unionByName(one)
    status = F.when(F.col("n") == 0, "ERROR").when(F.col("n") < few, "WARN").otherwise("OK")
    return sizes.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("tables"), F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_list("t")), ", ").alias("names"))


def krippendorff(df: DataFrame, a: str, b: str) -> DataFrame:
    """Krippendorff's alpha of two raters over nominal 0/1 ratings; pairs with a missing one are left out."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    own = both.agg((2 * F.count(F.lit(1))).alias("n"), F.sum(F.col(a) + F.col(b)).alias("ones"), F.count_if(F.col(a) != F.col(b)).alias("off"))
    return own.select((1 - (F.col("n") - 1) * (2.0 * F.col("off")) / (2.0 * F.col("ones") * (F.col("n") - F.col("ones")))).alias("alpha"))
