"""Read-only lookups over result tables: one batch join builds profiles, each endpoint is a parametrised query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("global", "context_specific")
SORTS = {"core_rank": False, "eb_mean": True, "peak": True, "n_contexts": True}


def checked_limit(limit: int, most: int = 2000) -> int:
    """C20: 1 to ``most``."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return limit


class Atlas:
    """Result tables by name (a missing one is None): ranking, classes, breadth, audit, contrast, replicates, edges, neighbours, programs, markers, sets, and those that an endpoint names."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame] | None):
        self.tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        df = self.get(name)
        if df is None:
            raise LookupError(f"table {name} is not loaded")
        return df

    def get(self, name: str) -> DataFrame | None:
        """A table, or None; one that is given as a function is made when it is first asked for."""
        df = self.tables.get(name)
        if df is not None and not isinstance(df, DataFrame) and callable(df):
            df = self.tables[name] = df()
        return df

    def health(self) -> dict:
        """Q2: state, number of units, which tables are there."""
        loaded = {k: v is not None for k, v in self.tables.items()}
        return {"status": "ok" if loaded.get("ranking") else "degraded", "n_units": self["ranking"].count() if loaded.get("ranking") else 0, "tables_loaded": loaded}

    def summary(self) -> DataFrame:
        """Q3: counts by class and context as rows (kind, key, n)."""
        part = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return part(self["classes"], "class", "regulator_class").unionByName(part(self["contrast"].where("gate"), "context", "context"))

    def overview(self, top: int = 10) -> DataFrame:
        """Q3: rows (kind, key, value): number of units, counts by class, the first units, contexts, which tables are there."""
        row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("string").alias("value"))
        n = F.count(F.lit(1)).alias("n")
        spark = self["ranking"].sparkSession
        parts = [
            row(self["ranking"].agg(n), "units", F.lit("n"), F.col("n")),
            row(self["classes"].groupBy("regulator_class").agg(n), "class", F.col("regulator_class"), F.col("n")),
            row(self["ranking"].where(F.col("rank") <= top), "top", F.col("rank"), F.col("unit")),
            row(self["contrast"].select("context").distinct(), "context", F.col("context"), F.lit("true")),
            row(spark.createDataFrame([(k, str(v is not None).lower()) for k, v in sorted(self.tables.items())], "k string, v string"), "available", F.col("k"), F.col("v")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def fields(self) -> DataFrame:
        """A unit's row of every result table: baseline, stability, reproducibility, review and program; what a table lacks is null.

        Left joins on the unit; written once, a lookup filters it.
        """
        df = self["ranking"].select("unit", F.col("rank").alias("core_rank"))
        for name, columns in {
            "classes": {"regulator_class": "regulator_class"},
            "peaks": {"context": "peak_context", "response": "peak_response"},
            "stability": {"selection_frequency": "stability_frequency", "median_rank": "median_rank", "rank_iqr": "rank_iqr"},
            "baselines": {"raw_rank": "raw_rank", "dropped": "dropped_by_gate"},
            "audit": {"new_rank": "reweighted_rank", "score": "reweighted_score", "donor_metadata": "donor_metadata"},
            "review": {"status": "audit_status", "reason": "audit_reason"},
            "findings": {"assigned": "program_label", "best": "nearest_program", "cosine": "nearest_cosine"},
        }.items():
            table = self.get(name)
            if table is None:
                df = df.withColumns({new: F.lit(None) for new in columns.values()})
            else:
                df = df.join(table.select("unit", *[F.col(old).alias(new) for old, new in columns.items()]), "unit", "left")
        return df.withColumn("in_program_panel", F.col("nearest_program").isNotNull())

    def coverage(self) -> DataFrame:
        """Q8: one row: contrasts, gated ones, and how many carry each kind of reproducibility metadata."""
        both = self["contrast"].join(self["replicates"], ["unit", "context"], "left")
        share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6)
        return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gate").cast("long")).alias("n_gated"), share("guide_corr").alias("guide_share"), share("donor_corr").alias("donor_share"), F.round(F.avg(F.col("single").cast("double")), 6).alias("single_share"))

    def findings(self) -> DataFrame:
        """Q13: panel units with their program call and their neighbourhood's coherence."""
        return self["findings"].join(self["coherence"], "unit", "left")

    def validation(self) -> DataFrame:
        """Q14: programs with their size, cohesion against the null, and mean coherence of their members."""
        mean = self["programs"].join(self["coherence"], "unit").groupBy("program").agg(F.round(F.avg("own_share"), 6).alias("own_share"))
        size = self["programs"].groupBy("program").agg(F.count(F.lit(1)).alias("members"))
        null = self["cohesion"].select(F.col("set_name").alias("program"), "observed", "z", "p")
        return size.join(null, "program", "left").join(mean, "program", "left")

    def class_jaccard(self) -> DataFrame:
        """Q15: the full symmetric matrix of target-set similarity, ones on the diagonal, to three digits."""
        j = self["jaccard"].select("a", "b", F.round("jaccard", 3).alias("jaccard"))
        own = j.select("a").union(j.select("b")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("jaccard"))
        return j.unionByName(j.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).unionByName(own)

    @staticmethod
    def document(text: str | None) -> dict:
        """A JSON document as it is, NaN and infinities as null; without one, or with a broken one, not available."""
        import json

        def clean(v):
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items()}
            if isinstance(v, list):
                return [clean(x) for x in v]
            return None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v

        try:
            return {"available": True, **clean(json.loads(text))} if text else {"available": False}
        except ValueError:
            return {"available": False}

    def units(self) -> DataFrame:
        """Q4: units with their rank."""
        return self["ranking"].select("rank", "unit")

    def regulators(self, q: str | None = None, regulator_class: str | None = None, limit: int | None = 50, sort_by: str = "core_rank") -> DataFrame:
        """Search, optional class, sort with nulls last (an unknown key sorts by rank), limit (None: all)."""
        if regulator_class is not None and regulator_class not in CLASSES:
            raise ValueError(f"class must be one of {CLASSES}")
        df = self["ranking"].withColumnRenamed("rank", "core_rank").join(self["classes"], "unit", "left").join(self["breadth"].select("unit", "peak", "n_contexts"), "unit", "left")
        if q:
            df = df.where(F.upper(F.col("unit").cast("string")).contains(q.upper()))
        if regulator_class:
            df = df.where(F.col("regulator_class") == regulator_class)
        key = sort_by if sort_by in SORTS else "core_rank"
        first = F.col(key).desc_nulls_last() if SORTS[key] else F.col(key).asc_nulls_last()
        df = df.orderBy(first, "core_rank", "unit").select("unit", "core_rank", "eb_mean", "regulator_class", "peak", "n_contexts")
        return df if limit is None else df.limit(checked_limit(limit))

    def class_members(self, regulator_class: str, limit: int | None = None) -> DataFrame:
        """Q10: units of a class, all of them unless a limit is asked for."""
        return self.regulators(regulator_class=regulator_class, limit=limit)

    def profiles(self) -> DataFrame:
        """One nested row per unit: rank, class, context map, strongest edges, neighbours, text. Written once, a lookup filters it."""
        contexts = self["contrast"].groupBy("unit").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("context", "response")))).alias("condition_profile"))
        order = Window.partitionBy("unit").orderBy(F.abs("theta").desc(), "feature")
        e = self["edges"].withColumn("k", F.row_number().over(order))
        edge = F.struct("k", "feature", F.round("theta", 4).alias("theta"), F.when(F.col("theta") > 0, "up").otherwise("down").alias("direction"))
        edges = e.groupBy("unit").agg(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, edge))).alias("top_edges"), F.count(F.lit(1)).alias("n_edges"))
        near = self["neighbours"].groupBy(F.col("a").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("b").alias("neighbour"), "similarity"))).alias("neighbours"))
        df = self["ranking"].join(self["classes"], "unit", "left").join(self["breadth"], "unit", "left").join(contexts, "unit", "left").join(edges, "unit", "left").join(near, "unit", "left")
        if self.tables.get("audit") is not None:
            df = df.join(self["audit"].select("unit", "new_rank", "rank_shift"), "unit", "left")
        text = F.concat_ws(" ", F.format_string("Rank %d, %s.", F.col("rank"), F.col("regulator_class")), F.when(F.col("any_flag"), "Carries a penalty flag."), F.when(F.col("n_edges").isNull(), "No likely large edge."))
        return df.na.fill(0, ["n_edges"]).withColumn("n_edges_capped", F.least("n_edges", F.lit(10).cast("long"))).withColumn("interpretation", text)

    def profile(self, unit) -> DataFrame:
        """One profile; LookupError if there is none."""
        df = self.profiles().where(F.upper(F.col("unit").cast("string")) == str(unit).upper())
        if df.isEmpty():
            raise LookupError(f"no unit {unit}")
        return df

    def unit_edges(self, unit, limit: int = 50) -> DataFrame:
        """Edges of a unit by magnitude, with direction."""
        e = self["edges"].where(F.upper(F.col("unit").cast("string")) == str(unit).upper())
        return e.orderBy(F.abs("theta").desc(), "feature").limit(checked_limit(limit)).select("unit", "feature", F.round("theta", 6).alias("theta"), F.when(F.col("theta") > 0, "up").otherwise("down").alias("direction"))

    def reproducibility(self) -> DataFrame:
        """Q8: audit rows."""
        return self["audit"]

    def gate_audit(self, limit: int = 100) -> DataFrame:
        """Q9: baseline comparison by raw rank."""
        return self["baselines"].orderBy(F.col("raw_rank").asc_nulls_last(), "unit").limit(checked_limit(limit))

    def existing(self, name: str, *columns: str) -> DataFrame:
        """Q11: those of the columns that the table has."""
        return self[name].select(*[c for c in columns if c in self[name].columns])

    def neighbours_of(self, unit) -> dict:
        """Q12: whether a unit is in the panel, and its ordered neighbours."""
        rows = self["neighbours"].where(F.col("a").cast("string") == str(unit)).orderBy("rank").collect()
        return {"in_panel": bool(rows), "neighbours": [r.asDict() for r in rows]}

    def program_summary(self) -> DataFrame:
        """Q14: per program the members and nested marker lists."""
        m = self["markers"].groupBy("program").agg(F.array_sort(F.collect_list(F.struct("direction", "rank", "feature", "mean"))).alias("markers"))
        return self["programs"].groupBy("program").agg(F.count(F.lit(1)).alias("members")).join(m, "program", "left")

    def class_programs(self) -> DataFrame:
        """Q15: enrichment by fold, nulls last."""
        return self["enrichment"].orderBy(F.col("fold").desc_nulls_last(), "set_name")

    def class_targets(self, name: str) -> DataFrame:
        """Q15: members of a set; LookupError names the known ones."""
        df = self["sets"].where(F.col("set_name") == name).select("member")
        if df.isEmpty():
            known = [r[0] for r in self["sets"].select("set_name").distinct().orderBy("set_name").limit(100).collect()]
            raise LookupError(f"no set {name}; known are {known}")
        return df

    def edge_summaries(self, limit: int | None = None) -> DataFrame:
        """Q16: edge summaries per unit, most edges first."""
        df = self["edge_summary"].orderBy(F.col("n_edges").desc(), "unit")
        return df if limit is None else df.limit(checked_limit(limit, 5000))
