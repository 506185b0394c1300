"""Reading and writing the recording store: Parquet tables partitioned by study and
recording, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointproc import schema as S
from pointproc.functions.scalar import require_pair_number
from pointproc.params import DEFAULTS

STUDIES = ("doi", "ket")
PARTS = ("study", "recording_id")


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Write one store table, replacing exactly the recordings present in ``df``.

    So a run that is repeated after a failure does not add its rows a second time.
    """
    S.require_columns(df, *PARTS, what=name)
    # rebalancing gathers a small recording into one file and splits a large one
    (df.hint("rebalance", *PARTS).write.partitionBy(*PARTS)
     .mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .parquet(f"{root}/{name}"))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A store table with its declared schema (plus ``study``).

    The stored files must hold every declared column. A column that all of them lack is
    an error here; one that a single file lacks would be read as NULL there, so columns
    that are never NULL fail the query where they are. Each column is checked only
    where it is used, and scans stay pruned.
    """
    kind = S.TABLES[name]
    if "study" not in kind.names:
        kind = S.T.StructType([*kind.fields, S.T.StructField("study", S.STR)])
    stored = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")  # columns of all files, read by tasks
    S.require_columns(stored, *kind.names, what=f"stored table {name}")
    rows = spark.read.schema(kind).parquet(f"{root}/{name}")
    absent = {c: F.raise_error(F.lit(f"stored table {name} has a file without values of {c}")).cast(kind[c].dataType)
              for c in S.REQUIRED[name]}
    return rows.select([F.coalesce(F.col(c), absent[c]).alias(c) if c in absent else F.col(c) for c in rows.columns])


def read_recording(spark: SparkSession, root: str, name: str, recording_id: str) -> DataFrame:
    """One recording's rows of a table; only its partition is listed and read.

    Each of its files must hold every declared column.
    """
    meta = check_version(read_table(spark, root, "recordings").filter(F.col("recording_id") == recording_id))
    if meta.isEmpty():
        raise ValueError(f"no recording {recording_id!r}")
    rows = read_table(spark, root, name).filter(F.col("recording_id") == recording_id)
    own = spark.read.parquet(f"{root}/{name}").filter(F.col("recording_id") == recording_id).select("_metadata.file_path").distinct()
    for file in (r[0] for r in own.collect()):  # the files of one recording
        S.require_columns(spark.read.parquet(unquote(file)), *[c for c in S.TABLES[name].names if c not in PARTS], what=file)
    return rows


def check_version(recordings: DataFrame, version: str = DEFAULTS.schema_version) -> DataFrame:
    """Fail the query on a row whose schema version is missing or different."""
    S.require_columns(recordings, *S.RECORDINGS.names, what="recordings")
    found = F.coalesce("schema_version", F.lit("none"))
    bad = F.raise_error(F.concat(F.lit(f"schema version {version} needed, found "), found)).cast("boolean")
    return recordings.filter(F.when(found == version, F.lit(True)).otherwise(bad))


def recordings_for(recordings: DataFrame, study: str) -> DataFrame:
    """Recordings of ``doi``, ``ket`` or ``all``, with the condition label to show."""
    study = study.lower()
    if study not in (*STUDIES, "all"):
        raise ValueError(f"unknown study {study!r}")
    rows = recordings if study == "all" else recordings.filter(F.col("study") == study)
    treated = F.when(F.col("study") == "ket", "Ketanserin").otherwise("DOI")
    return rows.withColumn("label", F.when(F.col("condition") == "baseline", "Baseline").otherwise(treated))


def pair_up(baseline: DataFrame, treatment: DataFrame, name: str = "name") -> DataFrame:
    """Full outer match of two name lists on their ``#N`` suffix.

    ``status`` is ok, or says which side has no partner. A name without suffix is an error.
    """
    b = baseline.select(require_pair_number(F.col(name)).alias("pair_no"), F.col(name).alias("baseline"))
    t = treatment.select(require_pair_number(F.col(name)).alias("pair_no"), F.col(name).alias("treatment"))
    status = (F.when(F.col("treatment").isNull(), "no treatment")
              .when(F.col("baseline").isNull(), "no baseline").otherwise("ok"))
    return b.join(t, "pair_no", "full_outer").withColumn("status", status)


def require_paired(pairs: DataFrame) -> DataFrame:
    """Fail, naming every unmatched id, unless every name found its partner. The lists are names of a study."""
    lost = [f"#{r['pair_no']} ({r['status']})" for r in pairs.filter("status != 'ok'").orderBy("pair_no").collect()]
    if lost:
        raise ValueError(f"unmatched pair ids: {', '.join(lost)}")
    return pairs.drop("status")


def read_pairs(recordings: DataFrame) -> DataFrame:
    """study, pair_no, baseline_id, treatment_id of complete pairs."""
    at = F.col("condition") == "baseline"
    return recordings.groupBy("study", "pair_no").agg(
        F.max(F.when(at, F.col("recording_id"))).alias("baseline_id"),
        F.max(F.when(~at, F.col("recording_id"))).alias("treatment_id")).dropna()


def channel_trains(spikes: DataFrame, used: DataFrame, recordings: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Requested channels in requested order with their spikes; absent ones stay, flagged.

    recording_id, ord, channel, found, t_us (NULL where there is no spike).
    """
    asked = recordings.select("recording_id", F.posexplode(F.array(*[F.lit(int(c)) for c in wanted])).alias("ord", "channel"))
    asked = asked.withColumn("ord", F.col("ord") + 1)
    have = used.select("recording_id", "channel", F.lit(True).alias("found"))
    key = ["recording_id", "channel"]
    return (asked.join(have, key, "left").join(spikes.select(*key, "t_us"), key, "left")
            .select("recording_id", "ord", "channel", F.coalesce("found", F.lit(False)).alias("found"), "t_us"))


def pending(recordings: DataFrame, done: DataFrame, sources: DataFrame, overwrite: bool = False) -> DataFrame:
    """Recordings still to process: not done yet (unless overwriting) and with a source."""
    todo = recordings if overwrite else recordings.join(done.select("recording_id").distinct(), "recording_id", "left_anti")
    return todo.join(sources.select("recording_id").distinct(), "recording_id", "left_semi")


def missing_sources(recordings: DataFrame, sources: DataFrame) -> DataFrame:
    return recordings.join(sources.select("recording_id").distinct(), "recording_id", "left_anti")


def default_pair(pairs: DataFrame, wanted: int | None = None) -> DataFrame:
    """The pair shown when none is asked for: number max(1, round(n/2)) of its study."""
    order = Window.partitionBy("study").orderBy("pair_no")
    n = F.count(F.lit(1)).over(Window.partitionBy("study"))
    pick = F.greatest(F.lit(1), F.floor(n / 2 + 0.5)) if wanted is None else F.least(F.lit(wanted), n)
    return (pairs.withColumn("_k", F.row_number().over(order)).withColumn("_pick", pick)
            .filter("_k = _pick").drop("_k", "_pick"))
