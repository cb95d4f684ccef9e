"""Reading and writing: tables, predictions, reference sets, metric rows, run records."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def load(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table of a folder; only ``columns`` are read if given."""
    if not NAME.fullmatch(table):
        raise ValueError(f"not a table name: {table!r}")
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def json_rows(spark: SparkSession, path: str, keys: tuple[str, str]) -> DataFrame:
    """The two text values of each line of a JSON lines file. A line that is no JSON object, a value that
    is missing or no text, and a file without rows fail; blank lines don't count."""
    line = F.try_parse_json(F.col("value"))
    lines = spark.read.text(path).filter(F.trim("value") != "").select(line.alias("v"))
    is_text = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING"
    fine = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")) & is_text(keys[0]) & is_text(keys[1]), F.lit(False))
    n, good = lines.agg(F.count(F.lit(1)), F.count_if(fine)).first()
    if not n:
        raise ValueError(f"{path} holds no rows")
    if n != good:
        raise ValueError(f"{n - good} lines of {path} are no objects with the texts {keys}")
    return lines.select(*[F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in keys])


def unique_texts(rows: DataFrame, value: str, what: str) -> DataFrame:
    """The rows themselves; an id that stands twice or a blank value fails."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.count_if(F.coalesce(F.trim(value), F.lit("")) == "").alias("blank")).first()
    if r.n != r.d or r.blank:
        raise ValueError(f"{what}: {r.n - r.d} repeated ids, {r.blank} blank values")
    return rows


def read_predictions(spark: SparkSession, path: str, value: str = "hyp") -> DataFrame:
    """(id, value) of a JSON lines file, as ``json_rows`` reads it; ``violations`` checks the ids."""
    return json_rows(spark, path, ("id", value))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(id, ref) of a JSON lines file; ids that repeat and references without a letter, mark or number
    fail."""
    rows = unique_texts(json_rows(spark, path, ("id", "ref")), "ref", path)
    if rows.filter(~F.col("ref").rlike(r"[\p{L}\p{M}\p{N}]")).limit(1).count():
        raise ValueError(f"{path} has a reference with nothing to count")
    return rows


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.orderBy("id").write.mode("overwrite").json(path)


def violations(predictions: DataFrame, units: DataFrame, id_col: str = "id", value: str = "hyp", unit_id: str = "id") -> DataFrame:
    """(kind, id) of repeated ids, blank values and ids that no unit has."""
    p = predictions.select(F.col(id_col).alias("id"), F.col(value).cast("string").alias("v"))
    known = units.select(F.col(unit_id).alias("id")).distinct()
    repeated = p.groupBy("id").count().filter("count > 1").select(F.lit("repeated").alias("kind"), "id")
    blank = p.filter(F.coalesce(F.trim("v"), F.lit("")) == "").select(F.lit("blank").alias("kind"), "id")
    unknown = p.join(known, "id", "left_anti").select(F.lit("unknown").alias("kind"), "id")
    return repeated.unionByName(blank).unionByName(unknown)


def fingerprint(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(name, n_rows, digest): order-insensitive, in one aggregate. Values are hashed with their lengths,
    so no value runs into the next one, and nulls differ from all text; 60 bits of each row count."""
    value = lambda c: F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    text = F.concat_ws("|", *[F.coalesce(value(F.col(c)), F.lit("null")) for c in columns])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def manifest(inputs: dict[str, DataFrame], ledger: DataFrame | None = None) -> DataFrame:
    """(kind, name, n_rows, detail): each input with its rows and columns, and the steps of a ledger
    (step, rule, grp, rows_before, rows_after) with what they left. A run writes it beside its outputs."""
    rows = [df.agg(F.lit("input").alias("kind"), F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.lit(",".join(df.columns)).alias("detail")) for n, df in sorted(inputs.items())]
    if ledger is not None:
        detail = F.concat_ws(" ", F.col("rule"), F.concat(F.lit("from "), F.col("rows_before").cast("string")))
        rows.append(ledger.select(F.lit("step").alias("kind"), F.concat_ws(":", F.col("step").cast("string"), F.coalesce(F.col("grp").cast("string"), F.lit("null"))).alias("name"), F.col("rows_after").alias("n_rows"), detail.alias("detail")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


PROVENANCE = ("script_commit", "model", "model_revision", "decoding", "device", "dirty")


def provenance(card: dict) -> dict:
    """The record of how predictions were made; fails unless it names commit and revision by full hashes,
    model and device, has decoding settings, and says that nothing was uncommitted."""
    lacking = [k for k in PROVENANCE if k not in card]
    full = [k for k in ("script_commit", "model_revision") if k in card and not (isinstance(card[k], str) and re.fullmatch(r"[0-9a-f]{40}", card[k]))]
    blank = [k for k in ("model", "device") if k in card and not (isinstance(card[k], str) and card[k].strip())]
    settings = [] if "decoding" not in card or (isinstance(card["decoding"], dict) and card["decoding"]) else ["decoding"]
    clean = [] if "dirty" not in card or card["dirty"] is False else ["dirty"]
    if wrong := lacking + full + blank + settings + clean:
        raise ValueError(f"the provenance record lacks or misstates {wrong}")
    return card


def with_provenance(predictions: DataFrame, card: dict) -> DataFrame:
    """Predictions, each row with its checked record as one column of JSON."""
    return predictions.withColumn("made_by", F.lit(json.dumps(provenance(card), sort_keys=True)))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_columns) of each table."""
    rows = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")) for name, df in sorted(tables.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def metric_rows(wide: DataFrame, metrics: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """(name, value, n, route) rows from one wide row; metrics: name to (value, n, route)."""
    each = [F.struct(F.lit(k).alias("name"), v.cast("double").alias("value"), n.cast("long").alias("n"), F.lit(r).alias("route")) for k, (v, n, r) in metrics.items()]
    return wide.select(F.explode(F.array(*each)).alias("m")).select("m.*")


class RunRecord:
    """A run's status, a table that is written after its outputs: readers refuse a run that isn't complete
    or an output that is no longer what was written.

    ``write`` is the whole protocol: the record says that the run is on, outputs are written to folders of
    their own, counted and fingerprinted as they were written, held against declared counts, and at last the record
    names them. A run that is killed anywhere before leaves a record that readers refuse.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, status: str, outputs: list[tuple[str, int, str]]) -> None:
        now = datetime.now(timezone.utc).isoformat()
        rows = [(status, now, *o) for o in outputs] or [(status, now, None, None, None)]
        self.spark.createDataFrame(rows, "status string, at string, name string, n_rows long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/record")

    def start(self) -> None:
        self._write("running", [])

    def complete(self, outputs: dict[str, DataFrame]) -> None:
        self._write("complete", [tuple(fingerprint(df, df.columns, n).first()) for n, df in outputs.items()])

    def write(self, outputs: dict[str, DataFrame], expected: dict[str, int] | None = None, within: dict[str, int] | None = None) -> None:
        """Writes all outputs and then the record; an output whose number of rows is further from the declared
        one than its tolerance (0 if none is given) fails the run, and so does a declared one that isn't there."""
        self.start()
        if lacking := sorted(set(expected or {}) - set(outputs)):
            raise ValueError(f"outputs are declared that aren't there: {lacking}")
        rows = []
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(self._at(name))
            rows.append(tuple(fingerprint(self.spark.read.parquet(self._at(name)), df.columns, name).first()))
        wrong = {n: (found, expected[n]) for n, found, _ in rows if expected and n in expected and abs(found - expected[n]) > (within or {}).get(n, 0)}
        if wrong:
            raise ValueError(f"counts differ (found, expected): {wrong}")
        self._write("complete", rows)

    def _at(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise ValueError(f"not a name of an output: {name!r}")
        return f"{self.path}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        """An output of a complete run, as it was written."""
        df = self.spark.read.parquet(self._at(name))
        self.check({name: df})
        return df

    def check(self, outputs: dict[str, DataFrame]) -> None:
        rows = self.spark.read.parquet(f"{self.path}/record").collect()
        if any(r.status != "complete" for r in rows):
            raise ValueError("the run isn't complete")
        said = {r.name: (r.n_rows, r.digest) for r in rows}
        for name, df in outputs.items():
            if tuple(fingerprint(df, df.columns, name).first())[1:] != said.get(name):
                raise ValueError(f"output {name} isn't what the run wrote")
