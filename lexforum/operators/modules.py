"""Load modules of the star schema: surrogate keys that stay, foreign keys by lookups, seeds; a second load of the same rows adds none."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.functions.materialise import written
from lexforum.functions.stats import running_totals
from lexforum.operators import relational, star
from lexforum.operators import testimony as E

#: Tables with surrogate keys; parents stand before children.
TABLES = {
    "corpora": "id long, code string",
    "models": "id long, name string, version string",
    "runs": "id long, description string",
    "documents": "id long, external string, corpus_id long, title string, year int, kind string, number string, date string, origin string, judge string, department string, town string, unit string, n_chars long, path string",
    "hearings": "id long, name string, document_id long, audio string, aliases array<string>, started string, hours double, judge string, notes string",
    "participants": "id long, hearing_id long, speaker string, name string, rank string, role string",
    "blocks": "id long, external string, document_id long, parent_id long, grain string, section string, position int, n_chars long, text string",
    "scores": "block_id long, code string, model_id long, run_id long, value double",
    "segments": "id long, source string, place long, hearing_id long, participant_id long, speaker string, start double, end double, features map<string,double>, run_id long",
    "ratings": "id long, task long, inner long, rater string, label string, labels string, n_spans int",
}
REFERENCES = [
    ("documents", "corpus_id", "corpora", "id"), ("hearings", "document_id", "documents", "id"), ("participants", "hearing_id", "hearings", "id"),
    ("blocks", "document_id", "documents", "id"), ("blocks", "parent_id", "blocks", "id"), ("scores", "block_id", "blocks", "id"), ("scores", "model_id", "models", "id"),
    ("scores", "run_id", "runs", "id"), ("segments", "hearing_id", "hearings", "id"), ("segments", "participant_id", "participants", "id"), ("segments", "run_id", "runs", "id"),
]
#: Codes of corpora; models by what they give.
CORPORA = ("A-CE", "A-CSJ", "B-JEP", "C-JEP-oral")
MODELS = {"features": ("features", "1"), "embeddings": ("embeddings", "1"), "stance": ("stance", "1")}
#: Columns of the further sources that hold indicators.
LEXICAL = ("accountability_score", "hedging_density", "primera_persona_ratio", "sa_ratio", "emo_culpa", "emo_tristeza", "emo_miedo", "emo_ira", "emo_confianza", "emo_anticipacion", "emo_violencia_institucional", "emo_reconocimiento_victimas", "emo_balance_victimas")
STANCE = ("y11_quotes", "y12_judgment", "y13_evidential", "y11_oral_score", "y11_oral_v2", "y11_prop_mafapo", "y11_n_dq", "y12_n_alta", "y12_n_baja", "y13_n_inst", "y13_n_vic")
#: Characters of a document's name that short names hold at least.
PREFIX = 16


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def corpus_code(told: Column) -> Column:
    """Code of a corpus by what a file calls it; A-CE for what is not known. All that names the JEP is B, also the hearings."""
    c = F.upper(F.trim(F.coalesce(told, F.lit(""))))
    return F.when(c.contains("CSJ"), "A-CSJ").when(c.isin("A", "A-CE", "CE") | c.contains("CONSEJO"), "A-CE").when((c == "B") | c.contains("JEP"), "B-JEP").when(c == "C", "C-JEP-oral").otherwise("A-CE")


def document_kind(action: Column) -> Column:
    """Kind of a document by its kind of action; what no rule names stays, cut to 50 characters."""
    low = F.lower(action)
    rules = [("interpretativa|senit", "sentencia_interpretativa"), ("casaci[oó]n", "sentencia"), ("auto", "auto"), ("resoluci[oó]n", "resolucion"), ("reparaci[oó]n|sentencia", "sentencia")]
    return F.coalesce(*(F.when(low.rlike(p), F.lit(k)) for p, k in rules), F.nullif(F.substring(action, 1, 50), F.lit("")))


def new_rows(existing: DataFrame, rows: DataFrame, natural: Sequence[str], order: str | None = None, key: str | None = "id") -> DataFrame:
    """The rows whose natural key the table lacks, one for each (the first by `order`; without it the least, as JSON), in the table's columns.

    `key` numbers them above the table's largest, in order of natural keys, by ranges. Rows with a null in the natural key are left out.
    """
    rest = [c for c in rows.columns if c not in natural and c != order]
    by = F.col(order) if order else F.to_json(F.struct(*rest, F.lit(0)))
    live = rows.where(F.coalesce(*(F.when(F.col(c).isNull(), F.lit(1)) for c in natural), F.lit(0)) == 0)
    one = live.groupBy(*natural).agg(F.min_by(F.struct(*rest, F.lit(0).alias("_zero")), by).alias("_rest")).select(*natural, *(F.col("_rest")[c].alias(c) for c in rest))
    fresh = one.join(existing.select(*natural), list(natural), "left_anti")
    if key:
        most = existing.agg(F.max(key)).first()[0] or 0
        named = fresh.withColumn("_n", F.struct(*natural)).withColumn("_one", F.lit(1).cast("long"))
        fresh = running_totals(named, [], "_n", ["_one"]).withColumn(key, F.col("upto__one") + most)
    given = set(fresh.columns)
    return fresh.select(*((F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in existing.schema))


def counted(rows: DataFrame) -> DataFrame:
    """Rows of documents and sections (doc, section, order; the order is a row's own) with position (in the document) and external (document__section__number in the section). Rows without document or section are left out."""
    live = rows.where((F.col("doc") != "") & (F.col("section") != "")).withColumn("_one", F.lit(1).cast("long"))
    inner = running_totals(live, ["doc", "section"], "order", ["_one"]).withColumnRenamed("upto__one", "_n").drop("all__one")
    out = running_totals(inner, ["doc"], "order", ["_one"]).withColumn("position", F.col("upto__one").cast("int"))
    return out.withColumn("external", star.external_id(F.col("doc"), F.col("section"), F.col("_n"))).drop("_n", "_one", "upto__one", "all__one")


def _one_id(table: DataFrame, **is_: str) -> Column:
    """The id of the one row with these values; a table without it is an error of the module."""
    found = table.where(" and ".join(f"{c} = '{v}'" for c, v in is_.items())).agg(F.max("id")).first()[0]
    if found is None:
        raise LookupError(f"no row with {is_}")
    return F.lit(found).cast("long")


def loader(sources: Mapping[str, DataFrame], settle=written) -> star.Loader:
    """The modules over these sources; one whose source is not given adds no rows. Sources and their columns:

    rows_a, rows_b, rows_b2: order, doc, corpus, year, section, n_chars and indicators y<n>_...; sections for B, blocks for A.
    inventory: order, doc (cut, with an ellipsis), action, number, date, origin, judge, department, town, unit, n_chars.
    hearings: name, audio, aliases, started, hours, judge, notes; participants: hearing, speaker, name, rank.
    named: stem, doc, section, ordinal, text (see readers.named_blocks).
    rows_c, rows_c1: order, audio, block, n_chars and indicators y<n>_...; stance: order, doc (cut), block, n_chars, STANCE.
    lexical: order, doc (its first 16 characters), section, LEXICAL.
    facial, vocal: file, place, speaker, start, end, features (a map). ratings: id, inner, rater, label, labels, n_spans.
    """
    load = star.Loader(settle=settle)

    def source(name: str) -> DataFrame | None:
        return sources.get(name)

    def module(table: str, name: str, needs: Sequence[str], after: Sequence[str] = (), replaces: bool = False):
        def add(f):
            def run(t: dict[str, DataFrame]) -> DataFrame:
                if needs and all(source(n) is None for n in needs):
                    return t[table] if replaces else t[table].limit(0)
                return f(t)

            return load.module(table, tuple(after), name, replaces)(run)

        return add

    def of_documents(t, rows: DataFrame, doc: str = "doc") -> DataFrame:
        """Rows whose document is there, with document_id."""
        return star.with_lookup(rows, t["documents"], {doc: "external"}, "id", "document_id").where("document_id is not null")

    def of_hearings(t, rows: DataFrame, audio: str) -> DataFrame:
        dim = t["hearings"].select(F.col("id").alias("hearing_id"), "document_id", F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("audio")).alias("_as"))
        return relational.alias_join(rows, dim, audio, "_as", "inner")

    def scores(t, rows: DataFrame, columns: Sequence[str] | None, model: str, description: str) -> DataFrame:
        """rows: order, block_id and indicators. The first value of a block and code stays."""
        named = rows if columns is None else rows.select("order", "block_id", *(c for c in columns if c in rows.columns))
        long = relational.unpivot_indicators(named, ["order", "block_id"], r"y\d+_.*" if columns is None else "|".join(map(re.escape, columns)))
        name, version = MODELS[model]
        ids = {"model_id": _one_id(t["models"], name=name, version=version), "run_id": _one_id(t["runs"], description=description)}
        out = long.select("order", "block_id", F.col("codigo").alias("code"), F.col("valor").alias("value")).withColumns(ids)
        return new_rows(t["scores"], out, ["block_id", "code", "model_id", "run_id"], "order", None)

    def of_blocks(t, rows: DataFrame, external: str) -> DataFrame:
        return star.with_lookup(rows, t["blocks"], {external: "external"}, "id", "block_id").where("block_id is not null")

    spark = SparkSession.active()

    @module("corpora", "corpora", ())
    def _(t):
        return new_rows(t["corpora"], spark.createDataFrame([(c,) for c in CORPORA], "code string"), ["code"])

    @module("models", "models", ())
    def _(t):
        return new_rows(t["models"], spark.createDataFrame(list(MODELS.values()), "name string, version string"), ["name", "version"])

    @module("runs", "runs", ())
    def _(t):
        return new_rows(t["runs"], spark.createDataFrame([(n,) for n in sorted(sources)], "description string"), ["description"])

    indexed = ("rows_a", "rows_b", "rows_b2")

    @module("documents", "documents", (*indexed, "hearings", "named"), ("corpora",))
    def _(t):
        parts = []
        for i, n in enumerate(indexed):
            if source(n) is not None:
                parts.append(source(n).where("doc <> ''").select(F.col("doc").alias("external"), F.struct(F.lit(i).alias("file"), "order").alias("at"), corpus_code(F.col("corpus")).alias("code"), F.col("year").cast("int").alias("year")))
        told = None
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            dated = F.min(F.when(F.col("year").isNotNull(), F.struct("at", "year")))
            told = rows.groupBy("external").agg(F.min_by("code", "at").alias("code"), F.min("at").alias("_at"), dated.alias("_y"))
            told = told.select(F.lit(0).alias("_order"), "external", "code", F.substring("external", 1, 50).alias("title"), F.when(F.col("_y.at.file") == F.col("_at.file"), F.col("_y.year")).alias("year"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("path"))
        if source("hearings") is not None:
            h = source("hearings").select(F.lit(1).alias("_order"), F.concat(F.lit("audiencia_"), "audio").alias("external"), F.lit("C-JEP-oral").alias("code"), F.col("name").alias("title"), F.substring("started", 1, 4).try_cast("int").alias("year"), F.lit("audiencia").alias("kind"), F.col("started").alias("date"), F.lit(None).cast("string").alias("path"))
            told = h if told is None else told.unionByName(h)
        if source("named") is not None:
            b = source("named").where("doc <> ''").select("doc").distinct().select(F.lit(2).alias("_order"), F.col("doc").alias("external"), F.lit("B-JEP").alias("code"), F.col("doc").alias("title"), F.lit(None).cast("int").alias("year"), F.lit("auto").alias("kind"), F.lit(None).cast("string").alias("date"), F.concat("doc", F.lit(".pdf")).alias("path"))
            told = b if told is None else told.unionByName(b)
        found = star.with_lookup(told, t["corpora"], {"code": "code"}, "id", "corpus_id")
        return new_rows(t["documents"], found.drop("code"), ["external"], "_order")

    @module("documents", "inventory", ("inventory",), ("documents",), True)
    def _(t):
        fill = ["kind", "number", "date", "origin", "judge", "department", "town", "unit", "n_chars"]
        rows = source("inventory").withColumn("_cut", F.trim(F.regexp_replace(F.regexp_replace("doc", r"…|\.\.\.", ""), r"\.+$", ""))).withColumn("kind", document_kind(F.col("action")))
        matched = relational.prefix_join(rows.select("_cut").distinct().where(F.length("_cut") >= PREFIX), t["documents"], "_cut", "external", PREFIX).where("match_count = 1")
        own = rows.join(matched.select("_cut", F.col("matched").alias("external")), "_cut")
        first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("order", F.col(c).alias("v"))))["v"].alias(c)
        return filled(t["documents"], own.groupBy("external").agg(*map(first, fill)), fill)

    @module("hearings", "hearings", ("hearings",), ("documents",))
    def _(t):
        rows = of_documents(t, source("hearings").withColumn("doc", F.concat(F.lit("audiencia_"), "audio")))
        return new_rows(t["hearings"], rows.drop("doc"), ["name"])

    @module("participants", "participants", ("participants",), ("hearings",))
    def _(t):
        rows = star.with_lookup(source("participants"), t["hearings"], {"hearing": "name"}, "id", "hearing_id").withColumn("role", F.lit("compareciente"))
        return new_rows(t["participants"], rows.drop("hearing"), ["hearing_id", "speaker"])

    def blocks_of(name: str, grain: str):
        @module("blocks", f"blocks_{name}", (name,), ("documents",))
        def _(t):
            rows = of_documents(t, counted(source(name).select("order", "doc", "section", "n_chars"))).withColumn("grain", F.lit(grain))
            return new_rows(t["blocks"], rows.drop("doc"), ["external"], "order")

        @module("scores", f"scores_{name}", (name,), (f"blocks_{name}", "models", "runs"))
        def _(t):
            return scores(t, of_blocks(t, counted(source(name)), "external").drop("n_chars", "position", "year"), None, "features", name)

    blocks_of("rows_a", "bloque_granular")
    blocks_of("rows_b", "seccion")
    blocks_of("rows_b2", "seccion")

    @module("blocks", "parents_named", ("named",), ("documents",))
    def _(t):
        rows = source("named").where("doc <> '' and section <> ''").select("doc", "section").distinct()
        own = of_documents(t, rows.withColumn("external", star.external_id(F.col("doc"), F.col("section"), F.lit("padre")))).withColumns({"grain": F.lit("seccion"), "position": F.lit(0)})
        return new_rows(t["blocks"], own.drop("doc"), ["external"])

    @module("blocks", "blocks_named", ("named",), ("parents_named",))
    def _(t):
        rows = source("named").where("doc <> '' and section <> ''").withColumn("_p", star.external_id(F.col("doc"), F.col("section"), F.lit("padre")))
        own = star.with_lookup(of_documents(t, rows), t["blocks"], {"_p": "external"}, "id", "parent_id")
        own = own.select(F.col("stem").alias("external"), "document_id", "parent_id", F.lit("bloque_granular").alias("grain"), "section", F.coalesce("ordinal", F.lit(0)).alias("position"), F.length("text").alias("n_chars"), "text")
        return new_rows(t["blocks"], own, ["external"])

    number = lambda block: F.coalesce(F.regexp_extract(block, r"_[bc](\d+)$", 1).try_cast("int"), F.lit(0))

    def oral(name: str, section: str, model: str):
        @module("blocks", f"blocks_{name}", (name,), ("hearings",))
        def _(t):
            rows = of_hearings(t, source(name).where("block <> ''").select("order", "audio", "block", "n_chars"), "audio")
            own = rows.select("order", F.col("block").alias("external"), "document_id", F.lit("bloque_granular").alias("grain"), F.lit(section).alias("section"), number(F.col("block")).alias("position"), "n_chars")
            return new_rows(t["blocks"], own, ["external"], "order")

        @module("scores", f"scores_{name}", (name,), (f"blocks_{name}", "models", "runs"))
        def _(t):
            return scores(t, of_blocks(t, source(name).drop("n_chars"), "block"), None, model, name)

    oral("rows_c", "audiencia_reconocimiento", "embeddings")
    oral("rows_c1", "audiencia_reconocimiento_capa1", "features")

    @module("blocks", "blocks_stance", ("stance",), ("documents",))
    def _(t):
        rows = source("stance").where("block <> ''")
        cut = relational.prefix_join(rows.select("doc").distinct(), t["documents"], "doc", "external", PREFIX).where("match_count = 1").select("doc", "matched")
        own = of_documents(t, rows.join(cut, "doc"), "matched")
        own = own.select("order", F.col("block").alias("external"), "document_id", F.lit("bloque_granular").alias("grain"), F.lit("bloque_posicion").alias("section"), number(F.col("block")).alias("position"), "n_chars")
        return new_rows(t["blocks"], own, ["external"], "order")

    @module("scores", "scores_stance", ("stance",), ("blocks_stance", "models", "runs"))
    def _(t):
        return scores(t, of_blocks(t, source("stance"), "block"), STANCE, "stance", "stance")

    @module("scores", "scores_lexical", ("lexical",), ("blocks_rows_a", "blocks_rows_b", "blocks_rows_b2", "models", "runs"))
    def _(t):
        # The n-th row of a short name and section is the n-th block of that section whose name starts so, by key.
        numbered = lambda df, order: running_totals(df.withColumn("_one", F.lit(1).cast("long")), ["_d", "section"], order, ["_one"]).withColumnRenamed("upto__one", "_n").drop("_one", "all__one")
        rows = numbered(source("lexical").where("doc <> '' and section <> ''").withColumn("_d", F.substring("doc", 1, PREFIX)), "order")
        own = numbered(t["blocks"].select(F.col("id").alias("block_id"), F.substring("external", 1, PREFIX).alias("_d"), "section"), "block_id")
        return scores(t, rows.join(own, ["_d", "section", "_n"]), LEXICAL, "features", "lexical")

    def channel(name: str, audio: Column):
        @module("segments", f"segments_{name}", (name,), ("participants", "runs"))
        def _(t):
            rows = of_hearings(t, source(name).withColumn("_audio", audio), "_audio").drop("document_id", "_audio")
            own = star.with_lookup(rows, t["participants"], {"hearing_id": "hearing_id", "speaker": "speaker"}, "id", "participant_id")
            own = own.withColumn("run_id", _one_id(t["runs"], description=name)).withColumnRenamed("file", "source")
            return new_rows(t["segments"], own, ["source", "place"])

    channel("facial", E.hearing_of_file(F.col("file")))
    channel("vocal", F.regexp_extract("file", r"^egemap_(.*?)(_compareciente)?(\.csv)?$", 1))

    @module("ratings", "ratings", ("ratings",))
    def _(t):
        rows = source("ratings").select(F.col("id").alias("task"), F.coalesce("inner", F.lit(0)).alias("inner"), "rater", "label", "labels", "n_spans")
        return new_rows(t["ratings"], rows, ["task", "inner", "rater"])

    return load


def filled(existing: DataFrame, given: DataFrame, columns: Sequence[str], key: str = "external") -> DataFrame:
    """The rows with the given value where theirs is null or empty; given: one row for each key."""
    side = given.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = existing.join(side, F.col(key) == F.col("_k"), "left")
    own = lambda f: F.when(F.col(f.name).isNull() | (F.col(f.name).cast("string") == ""), F.col(f"_{f.name}").cast(f.dataType)).otherwise(F.col(f.name))
    return out.select(*((F.coalesce(own(f), F.col(f.name)) if f.name in columns else F.col(f.name)).alias(f.name) for f in existing.schema))
