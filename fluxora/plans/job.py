"""The monthly job: landing -> clean -> gold -> enrich -> catalog, for many months at once.

Every stage runs alone or with the others, over all months in one Spark job.  A gate stands
before each: a month whose stage before ended in error or was blocked is blocked, a warning
passes, a month not yet seen there passes.  The ledger holds every attempt with the digest of the month's
landing files, so a rerun skips what is done and unchanged and resumes the rest.  A month that
fails is found by halving and does not stop the others.

Layout below ``root``: ``landing``, ``clean``, ``quarantine``, ``gold/parquet``, ``gold/csv``,
``enriched``, ``catalog``, ``validation/<stage>`` (JSON, one document per month), ``ledger``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.operators import movement as mv
from fluxora.operators import quality
from fluxora.operators.clean import REQUIRED_INPUT
from fluxora.operators.territory import code_lookup, enrich_codes
from fluxora.plans.ledger import (
    Outcome,
    Period,
    file_digests,
    isolated,
    known_state,
    period_digests,
    record,
)
from fluxora.plans.monthly import PERIOD, with_folder_period
from fluxora.session import scratch_path, stage
from fluxora.sources import catalog as cat
from fluxora.sources.delimited import BAD_LINE, LINE_FILE, MARKS, REASON, parsed_headers, scan
from fluxora.sources.files import exists, listing, path_value, probe, remove_folders
from fluxora.sources.lake import write_delimited, write_table

STAGES = ("landing", "clean", "gold", "enrich", "catalog")
RESULT = "ano int, mes int, etapa string, situacao string, codigos string"


@dataclass(frozen=True)
class MonthlyJob:
    """Where the layers lie and what the stages need.  ``version`` marks changed rules."""

    root: str
    dictionary: DataFrame
    decoded: dict[str, str]
    scopes: Column
    places: DataFrame | None = None
    specs: Sequence[mv.TableSpec] = mv.TABLES
    required: Sequence[str] = ("tabela_resumo",)
    number_mode: str = "auto"
    min_bytes: int = 50_000
    pattern: str = "*.csv"
    version: str = "1"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def tables(self) -> list[str]:
        return [s.full_name(x) for s in self.specs for x in s.scopes]


def of_periods(periods: Sequence[Period]) -> Column:
    """Rows of these months; on folder columns it prunes before any file is opened."""
    return (F.col("ano") * 100 + F.col("mes")).isin([y * 100 + m for y, m in periods])


def with_path_period(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumns({c: path_value(c, path).try_cast("int") for c in PERIOD})


def landing_files(spark: SparkSession, job: MonthlyJob, periods: Sequence[Period]) -> DataFrame:
    return with_path_period(listing(spark, job.path("landing"), job.pattern)).filter(of_periods(periods))


def sidecar(validation: DataFrame, job: MonthlyJob, name: str) -> None:
    """One JSON document per month; other months keep theirs."""
    validation.coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*PERIOD).json(job.path(f"validation/{name}"))


def outcomes(validation: DataFrame, periods: Sequence[Period], absent: str) -> dict[Period, Outcome]:
    """Status and codes by month; a month without a row is in error."""
    rows = validation.select(*PERIOD, "status", "codigos").collect()
    found = {(r["ano"], r["mes"]): (r["status"], r["codigos"]) for r in rows}
    return {p: found.get(p, ("error", absent)) for p in periods}


def check_landing(spark: SparkSession, job: MonthlyJob, periods: list[Period]) -> dict[Period, Outcome]:
    parsed = parsed_headers(probe(landing_files(spark, job, periods)))
    found = stage(quality.validate_landing(parsed, job.min_bytes), "landing-checked")
    sidecar(found, job, "landing")
    return outcomes(found, periods, "no_files")


def remove_months(spark: SparkSession, root: str, periods: Sequence[Period]) -> None:
    if exists(spark, root):
        qualified = root if ":" in root else f"file:{root}"
        remove_folders(spark, [f"{qualified}/ano={y}/mes={m}" for y, m in periods])


def make_clean(spark: SparkSession, job: MonthlyJob, periods: list[Period]) -> dict[Period, Outcome]:
    """Clean rows and, apart from them, the lines that are none; both replace their months."""
    files = landing_files(spark, job, periods)
    found = scan(spark, job.path("landing"), REQUIRED_INPUT, pattern=job.pattern, only=files)
    # The text is parsed once: both kinds of lines are written and read back apart.
    bad = F.col(BAD_LINE).isNotNull().cast("int")
    path = scratch_path(spark, "lines")
    found.lines.withColumn("__bad", bad).write.partitionBy("__bad").parquet(path)
    lines = spark.read.parquet(path)
    rows = lines.filter("__bad = 0").drop(*MARKS, "__bad")
    cleaned = with_folder_period(rows, job.dictionary, job.decoded, job.number_mode)
    write_table(cleaned, job.path("clean"), PERIOD)
    rejected = with_path_period(
        lines.filter("__bad = 1").select(
            F.col(LINE_FILE).alias("arquivo"), F.col(BAD_LINE).alias("linha"), F.col(REASON).alias("motivo")
        ),
        "arquivo",
    )
    remove_months(spark, job.path("quarantine"), periods)
    write_table(rejected, job.path("quarantine"), PERIOD)
    clean = spark.read.parquet(job.path("clean")).filter(of_periods(periods))
    expected = F.format_string("%04d%02d", F.col("ano"), F.col("mes"))
    lost = rejected.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("rejeitadas"))
    checked = quality.validate_clean(clean, PERIOD, expected).join(lost, list(PERIOD), "left")
    some = F.col("rejeitadas") > 0
    noted = checked.withColumns(
        {
            "rejeitadas": F.coalesce("rejeitadas", F.lit(0).cast("long")),
            "codigos": F.when(
                some, F.concat_ws(",", F.nullif("codigos", F.lit("")), F.lit("rejected_lines"))
            ).otherwise(F.col("codigos")),
            "status": F.when(some & (F.col("status") == "ok"), "warning").otherwise(F.col("status")),
        }
    )
    checked = stage(noted, "clean-checked")
    sidecar(checked, job, "clean")
    done = outcomes(checked, periods, "no_rows")
    remove_months(spark, job.path("clean"), [p for p, o in done.items() if o == ("error", "no_rows")])
    return done


def make_gold(spark: SparkSession, job: MonthlyJob, periods: list[Period]) -> dict[Period, Outcome]:
    clean = spark.read.parquet(job.path("clean")).filter(of_periods(periods))
    matrix = stage(mv.table_matrix(clean, job.scopes, job.specs, PERIOD), "matrix")
    write_table(matrix, job.path("gold/parquet"), ("tabela", *PERIOD))
    write_delimited(matrix, job.path("gold/csv"), ["tabela", *PERIOD], sep=",", bom=True)
    return check_gold(spark, job, periods)


def check_gold(spark: SparkSession, job: MonthlyJob, periods: list[Period]) -> dict[Period, Outcome]:
    """Validation of what is published, without computing it anew."""
    written = spark.read.parquet(job.path("gold/parquet")).filter(of_periods(periods))
    copy = spark.read.option("header", True).csv(job.path("gold/csv")).filter(of_periods(periods))
    clean = spark.read.parquet(job.path("clean")).filter(of_periods(periods))
    found = stage(
        quality.validate_gold_months(written, copy, clean, job.required, PERIOD), "gold-checked"
    )
    sidecar(found, job, "gold")
    return outcomes(found, periods, "no_tables")


def make_enriched(spark: SparkSession, job: MonthlyJob, periods: list[Period]) -> dict[Period, Outcome]:
    """Tables by place get its code; a real name without one is an error of its month."""
    if job.places is None:
        return {p: ("ok", "no_places") for p in periods}
    gold = spark.read.parquet(job.path("gold/parquet")).filter(of_periods(periods))
    by_place = gold.filter(F.col("tabela").rlike("^tabela_municipio"))
    lookup = code_lookup(job.places, "municipio", "cod_municipio")
    done = stage(enrich_codes(by_place, lookup, "municipio", "cod_municipio"), "enriched")
    write_table(done, job.path("enriched"), ("tabela", *PERIOD))
    counted = done.groupBy(*PERIOD).agg(
        *[
            F.count_if(F.col("situacao") == s).alias(s)
            for s in ("existing", "filled", "ignored", "unmatched")
        ]
    )
    none = F.col("unmatched") == 0
    checked = stage(
        counted.withColumns(
            {
                "status": F.when(none, "ok").otherwise("error"),
                "codigos": F.when(none, "").otherwise("unmatched_names"),
            }
        ),
        "enrich-checked",
    )
    sidecar(checked, job, "enrich")
    return outcomes(checked, periods, "no_places_in_gold")


def make_catalog(spark: SparkSession, job: MonthlyJob, periods: list[Period]) -> dict[Period, Outcome]:
    """The catalogue of all published months; issues of the wanted ones decide."""
    found = stage(cat.catalog(spark, job.path("gold"), job.tables, PERIOD), "catalog")
    found.write.mode("overwrite").parquet(job.path("catalog"))
    issues = cat.catalog_issues(found, job.required, PERIOD).filter(of_periods(periods))
    worst = issues.groupBy(*PERIOD).agg(
        F.max(F.col("nivel") == "critical").alias("critical"),
        F.array_join(F.sort_array(F.collect_set("problema")), ",").alias("problemas"),
    )
    months = found.select(*PERIOD).distinct().filter(of_periods(periods))
    checked = months.join(worst, list(PERIOD), "left").select(
        *PERIOD,
        F.when(F.col("critical"), "error").when(~F.col("critical"), "warning").otherwise("ok").alias("status"),
        F.coalesce("problemas", F.lit("")).alias("codigos"),
    )
    checked = stage(checked, "catalog-checked")
    sidecar(checked, job, "catalog")
    return outcomes(checked, periods, "not_published")


Work = Callable[[SparkSession, MonthlyJob, list[Period]], dict[Period, Outcome]]
WORK: dict[str, Work] = {
    "landing": check_landing,
    "clean": make_clean,
    "gold": make_gold,
    "enrich": make_enriched,
    "catalog": make_catalog,
}


def landed_digests(spark: SparkSession, job: MonthlyJob) -> dict[Period, str]:
    """The months that have landing files, each with the digest of all of them."""
    listed = listing(spark, job.path("landing"), job.pattern)
    return period_digests(file_digests(spark, listed, job.path("digests")), job.version)


def run(
    spark: SparkSession, job: MonthlyJob, stages: Sequence[str] = STAGES,
    periods: Sequence[Period] | None = None, overwrite: bool = False, dry_run: bool = False,
    landed: dict[Period, str] | None = None,
) -> DataFrame:
    """Run the stages in order; one row per month and stage with what became of it.

    ``situacao`` is ok, warning or error (it ran), skipped (done before, input unchanged),
    blocked (the stage before is in error) or, in a dry run, run.
    """
    unknown = [s for s in stages if s not in STAGES]
    if unknown:
        raise ValueError(f"unknown stages: {unknown}")
    landed = landed_digests(spark, job) if landed is None else landed
    wanted = sorted(landed) if periods is None else sorted(set(periods))
    ledger = job.path("ledger")
    results: list[tuple[int, int, str, str, str]] = []
    planned: dict[str, set[Period]] = {}
    for name in (s for s in STAGES if s in stages):
        done = known_state(spark, ledger, name)
        at = STAGES.index(name)
        before = STAGES[at - 1] if at else None
        gate = known_state(spark, ledger, before) if before else {}
        settled: dict[Period, Outcome] = {}
        todo, stopped = [], {}
        for p in wanted:
            again = p in planned.get(before, ())
            _, digest, status = done.get(p, (0, None, None))
            same = digest == landed.get(p)
            if not (dry_run and again) and gate.get(p, (0, "", "ok"))[2] in ("error", "blocked"):
                settled[p] = ("blocked", f"{before} {gate[p][2]}")
                if not (status == "blocked" and same):
                    stopped[p] = settled[p]
            elif not (overwrite or again) and status in ("ok", "warning") and same:
                settled[p] = ("skipped", "unchanged")
            else:
                todo.append(p)
        planned[name] = set(todo)
        if dry_run:
            settled |= {p: ("run", "") for p in todo}
        else:
            ran = isolated(lambda some, w=WORK[name]: w(spark, job, some), todo)
            record(spark, ledger, name, ran | stopped, landed)
            settled |= ran
        results += [(*p, name, *settled[p]) for p in wanted]
    return spark.createDataFrame(results, RESULT)


def months_between(start: Period, end: Period) -> list[Period]:
    low, high = sorted((start, end))
    numbers = range(low[0] * 12 + low[1] - 1, high[0] * 12 + high[1])
    return [(n // 12, n % 12 + 1) for n in numbers]


def backfill(
    spark: SparkSession, job: MonthlyJob, start: Period, end: Period, overwrite: bool = False,
    dry_run: bool = False, stages: Sequence[str] = STAGES,
) -> DataFrame:
    """:func:`run` for a range of months, one row per month: ok, warning, skipped or error.

    A month of the range without landing files is named as missing; a range without any is an
    error.  ``codigos`` names the stage that decided and its codes.
    """
    landed = landed_digests(spark, job)
    asked = months_between(start, end)
    present = [p for p in asked if p in landed]
    if not present:
        raise ValueError(f"no landing files from {min(start, end)} to {max(start, end)}")
    ran = run(spark, job, stages, present, overwrite, dry_run, landed).collect()
    worst = ("error", "warning", "ok", "run", "skipped")
    out = []
    for p in asked:
        own = [r for r in ran if (r["ano"], r["mes"]) == p and r["situacao"] != "blocked"]
        if not own:
            out.append((*p, "missing", ""))
            continue
        status = min((r["situacao"] for r in own), key=worst.index)
        notes = [f"{r['etapa']}: {r['codigos']}" for r in own if r["situacao"] == status and r["codigos"]]
        out.append((*p, status, "; ".join(notes) if status in ("error", "warning") else ""))
    return spark.createDataFrame(out, "ano int, mes int, situacao string, codigos string")
