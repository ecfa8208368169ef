"""From delivered files to records, in batches and incrementally."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.functions import text as T
from casemesh.functions.plain import stripped
from casemesh.operators import extract, graph
from casemesh.operators.durable import cut

RAW = "JID string, JYEAR string, JCASE string, JNO string, JDATE string, JTITLE string, JFULL string, JPDF string, _corrupt string"


def scan(spark: SparkSession, *folders: str, word: str | None = None) -> DataFrame:
    """One row per JSON file of the folders, with folder_name and file_name; unreadable files have _corrupt.

    word keeps the folders whose name has it.
    """
    raw = spark.read.schema(RAW).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", recursiveFileLookup=True, pathGlobFilter="*.json").json(list(folders))
    path = F.expr("url_decode(_metadata.file_path)")
    named = raw.withColumns({"file_name": F.element_at(F.split(path, "/"), -1), "folder_name": F.element_at(F.split(path, "/"), -2)})
    return named.where(F.col("folder_name").contains(word)) if word else named


def prepared(raw: DataFrame) -> DataFrame:
    """Columns of raw records in their types; numbers and dates that can't be read are null. Without jfull no text."""
    low = raw.toDF(*[c.lower() if c.startswith("J") else c for c in raw.columns])
    number = lambda c: F.expr(f"try_cast(trim({c}) as int)")
    out = low.withColumns(
        {"jyear": number("jyear"), "jno": number("jno"), "jcase_norm": T.case_word(F.col("jcase")), "decision_date": T.date_of(F.col("jdate")), "title": F.col("jtitle"), "pdf_url": F.col("jpdf")}
    )
    if "jfull" in low.columns:
        out = out.withColumn("clean_text", extract.cleaned(F.col("jfull"))).withColumn("doc_type", T.doc_type(F.col("clean_text")))
    return out


def split_errors(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, errors (folder_name, file_name, kind, message)): unreadable files, and rows without id, year, number or with a bad date."""
    bad_file = F.col("_corrupt").isNotNull()
    bad_row = F.col("JID").isNull() | F.expr("try_cast(trim(JYEAR) as int)").isNull() | F.expr("try_cast(trim(JNO) as int)").isNull() | ((F.length("JDATE") == 8) & T.date_of(F.col("JDATE")).isNull())
    kind = F.when(bad_file, "json_read").when(bad_row, "source_decision")
    marked = scanned.withColumn("kind", kind)
    errors = marked.where("kind is not null").select("folder_name", "file_name", "kind", F.coalesce(F.substring("_corrupt", 1, 200), F.lit("a field can't be read")).alias("message"))
    return marked.where("kind is null").drop("kind", "_corrupt"), errors


def ledger(runs: DataFrame) -> DataFrame:
    """The last entry (folder_name, ingested_at, n_files, n_errors) of each folder."""
    last = F.max_by(F.struct("ingested_at", "n_files", "n_errors"), "ingested_at")
    return runs.groupBy("folder_name").agg(last.alias("x")).select("folder_name", "x.*")


def located(prepared_rows: DataFrame, courts: DataFrame) -> DataFrame:
    """Adds unit_norm, root_norm, case_type and court_unit_id by the folder's name and a small table of courts."""
    tail = "(民事|刑事|行政|憲法|家事)$"
    kind = F.regexp_extract("folder_name", tail, 1)
    named = prepared_rows.withColumns(
        {"unit_norm": stripped(F.regexp_replace("folder_name", tail, "")), "case_type": F.when(kind == "家事", "民事").when(kind != "", kind)}
    )
    u = F.broadcast(courts.select("unit_norm", F.col("id").alias("court_unit_id")))  # a fixed list
    return named.join(u, "unit_norm").withColumn("root_norm", T.court_root(F.col("unit_norm")))


def texts_of(rulings: DataFrame) -> DataFrame:
    """What extraction reads of rulings: text, court and own docket."""
    court = T.citation_court(F.col("unit_norm"))
    return rulings.select(
        "id", F.col("clean_text").alias("text"), court.alias("court"), court.alias("own_court"), F.col("jyear").cast("int").alias("own_jyear"), T.case_word(F.col("jcase_norm")).alias("own_jcase"), F.col("jno").cast("int").alias("own_jno")
    )


def processed(raw: DataFrame, courts: DataFrame, decisions: DataFrame, names: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Scanned files to errors, the rulings with their ids and states, their citations, their statutes and those of their snippets.

    Rulings are cleaned once: their rows are written before they are read for the other results. A citation that lacks an
    offset is an error of the kind 'citation'.
    """
    good, errors = split_errors(raw)
    rows = cut(located(prepared(good), courts).dropDuplicates(["jid"]))
    rulings = rows.join(graph.upserted(decisions, rows), "jid")
    texts = texts_of(rulings)
    cited = cut(extract.citations(texts).withColumnRenamed("id", "source_id"))
    key = F.xxhash64("source_id", "citation_type", "court", "jyear", "jcase_norm", "jno", "auth_key", "match_start")
    cited = cited.withColumn("id", key)
    bad = cited.where("match_start is null or match_end is null").join(rulings.select(F.col("id").alias("source_id"), "folder_name", "file_name"), "source_id")
    errors = errors.unionByName(bad.select("folder_name", "file_name", F.lit("citation").alias("kind"), F.coalesce("raw_match", F.lit("no text")).alias("message")))
    cited = cited.where("match_start is not null and match_end is not null")
    snippets = extract.statutes(cited.select("id", F.col("snippet").alias("text")), names).withColumnRenamed("id", "citation_id")
    return {"errors": errors, "rulings": rulings, "citations": cited, "statutes": extract.statutes(texts, names).withColumnRenamed("id", "decision_id"), "snippet_statutes": snippets}


def batch(spark: SparkSession, folder: str, courts: DataFrame, decisions: DataFrame, names: tuple[str, ...] = (), word: str | None = None) -> dict[str, DataFrame]:
    """A whole batch of a folder; word: only subfolders that have it in their name."""
    return processed(scan(spark, folder, word=word), courts, decisions, names)


def months(spark: SparkSession, folders: list[str], courts: DataFrame, decisions: DataFrame, out: str, names: tuple[str, ...] = (), word: str | None = None) -> DataFrame:
    """Ingests month folders one after another, each with the rulings of those before as known, then fills in statutes.

    Results are written under out by folder; a folder that is run again replaces its own. Returns the ledger.
    """
    known = decisions
    columns = ["id", "jid", "unit_norm", "jyear", "jcase_norm", "jno", "case_type", "doc_type"]
    entries = []
    for folder in folders:
        label = folder.rstrip("/").rsplit("/", 1)[-1]
        made = batch(spark, folder, courts, known.select(*columns), names, word)
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/folder={label}")
        done = lambda name: spark.read.parquet(f"{out}/{name}/folder={label}")  # noqa: B023, E731
        known = known.select(*columns).unionByName(done("rulings").select(*columns))
        entries.append((label, done("rulings").count(), done("errors").count()))
    texts = spark.read.parquet(f"{out}/rulings").select("id", F.col("clean_text").alias("text"))
    have = spark.read.parquet(f"{out}/statutes").select(F.col("decision_id").alias("id"))
    extract.missing_statutes(texts, have, names).withColumnRenamed("id", "decision_id").write.mode("overwrite").parquet(f"{out}/statutes/folder=backfill")
    return spark.createDataFrame(entries, "folder_name string, n_files long, n_errors long").withColumn("ingested_at", F.current_timestamp())


def write_windows(windows: DataFrame, path: str) -> None:
    """The pair table in ranges of sources, sorted inside its files, so that a search reads the row groups of its sources."""
    windows.repartitionByRange("source_id").sortWithinPartitions("source_id").write.mode("overwrite").parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """A report with one JSON object per line."""
    rows.write.mode("overwrite").json(path)


def month(rows: DataFrame, column: str, year: int, number: int) -> DataFrame:
    """The rows of a month: from its first day, before the next month's."""
    first = F.make_date(F.lit(year), F.lit(number), F.lit(1))
    return rows.where((F.col(column) >= first) & (F.col(column) < F.add_months(first, 1)))
