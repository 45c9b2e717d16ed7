"""Questions to a model that are asked once: a ledger of answers, and the whole text stage on top of it.

A prompt is known by its digest. What the ledger does not hold is asked in batches, each entered when it is complete, so a run that
is lost goes on where it stopped and asks nothing again but the batches it was in. A failing batch leaves its prompts unanswered: what depends
on them keeps its defaults, and the next run asks them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from colsight.functions.rows import constant_rows
from colsight.operators import answers, filters, prompts, sensitivity
from colsight.sources.staging import columnar, shared_folder

Model = Callable[[pd.Series], pd.Series]
_ANSWER = "digest string, response string"
BATCH_ROWS = 10_000
DIGESTS_SENT = 100_000  # so many questions at most are sent to every executor, to find their answers without a shuffle of all answers


def _keyed(questions: DataFrame) -> DataFrame:
    """With the digest of the prompt in 32 bytes; the ledger holds it as text."""
    return questions.withColumn("digest", F.unhex(F.sha2("prompt", 256)))


class AnswerLedger:
    """Answers by prompt digest, in a folder that outlives a run."""

    def __init__(self, spark: SparkSession, folder: str, model: Model, batch_rows: int = BATCH_ROWS) -> None:
        self.spark, self.folder, self.model, self.batch_rows = spark, folder.rstrip("/"), model, batch_rows

    def known(self) -> DataFrame:
        """``digest, response`` of all finished batches; one row for each digest."""
        # Two runs at the same time may both have asked a prompt: the larger answer counts in either.
        return self._held().groupBy("digest").agg(F.max("response").alias("response"))

    def _held(self) -> DataFrame:
        """``digest, response`` as the batches have entered them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return constant_rows(self.spark, [], _ANSWER)
        return self.spark.read.schema(_ANSWER).option("recursiveFileLookup", True).parquet(self.folder)

    def pending(self, questions: DataFrame) -> DataFrame:
        """``digest, prompt`` of the questions without an answer, each once."""
        return self._pending(_keyed(questions))

    def _pending(self, keyed: DataFrame) -> DataFrame:
        # Prompts are long, and most are new and asked once: numbers of 8 bytes tell which are not. Only these are compared by digest and
        # shuffled; two digests of one number are rare and told apart there.
        number = F.xxhash64("digest").alias("number")
        asked = keyed.where("prompt is not null").select("digest", "prompt", number)
        held = self._held().select(F.unhex("digest").alias("digest")).select("digest", number)
        counted = asked.select("number", F.lit(1).alias("asked"), F.lit(0).alias("held"))
        counted = counted.unionAll(held.select("number", F.lit(0), F.lit(1))).groupBy("number").agg(F.sum("asked").alias("asked"), F.max("held").alias("held"))
        others = columnar(counted.where("asked > 1 or asked = 1 and held = 1").select("number"))
        alone = asked.join(others, "number", "left_anti")
        answered = held.join(others, "number", "left_semi").select("digest")
        rest = asked.join(others, "number", "left_semi").join(answered, "digest", "left_anti").dropDuplicates(["digest"])
        return alone.unionByName(rest).select(F.lower(F.hex("digest")).alias("digest"), "prompt")

    def ask(self, questions: DataFrame) -> DataFrame:
        """``questions`` (any columns and ``prompt``) with ``response``: NULL where the model gave none.

        The prompts that wait are stored in files of at most ``batch_rows``, and a batch reads its own files and no others. Batches run side by
        side, as many as there are cores, each entered in a folder of its own.
        """
        questions = columnar(_keyed(questions))
        waiting = shared_folder(self.spark)
        self._pending(questions).write.option("maxRecordsPerFile", self.batch_rows).parquet(waiting)
        threads = self.spark.sparkContext.defaultParallelism
        pool = ThreadPoolExecutor(threads)
        try:
            running = [pool.submit(inheritable_thread_target(self.spark)(self._enter), files) for files in self._batches(waiting)]
            for done in running:
                done.result()
        finally:
            pool.shutdown(cancel_futures=True)
        held = self._held().select(F.unhex("digest").alias("digest"), "response")
        if questions.count() <= DIGESTS_SENT:
            held = held.join(F.broadcast(questions.select("digest")), "digest", "left_semi")
        known = held.groupBy("digest").agg(F.max("response").alias("response"))
        return questions.join(known, "digest", "left").drop("digest")

    def _batches(self, path: str) -> list[list[str]]:
        """The files of stored prompts, put together up to ``batch_rows`` rows; their number follows the number of batches."""
        stored = self.spark.read.schema("digest string, prompt string").parquet(path)
        counts = stored.groupBy(F.col("_metadata.file_path").alias("file")).count().orderBy("file").collect()
        batches: list[list[str]] = []
        free = 0
        for file, count in counts:
            if count > free:
                batches.append([])
                free = self.batch_rows
            batches[-1].append(file)
            free -= count
        return batches

    def _enter(self, files: list[str]) -> None:
        prompts = self.spark.read.schema("digest string, prompt string").parquet(*files)
        replies = sensitivity.ask(prompts, self.model).where("response is not null")
        # A folder for each batch: batches that end at the same time do not touch each other's files.
        replies.select("digest", "response").write.parquet(f"{self.folder}/{uuid.uuid4().hex}")


@dataclass(frozen=True)
class TextResult:
    """Everything the text stage gives, each frame written once."""

    tables: DataFrame  # the tables with description and glossary
    columns: DataFrame  # the columns with description, is_sensitive, sensitivity_type and sensitivity_level
    kpis: DataFrame  # domain, place, name, description, calculation, linked_columns
    filters: DataFrame | None  # chosen filter columns; None without candidates


def text_stage(
    ledger: AnswerLedger,
    tables: DataFrame,
    columns: DataFrame,
    candidates: DataFrame | None = None,
    roles: DataFrame | None = None,
    batch_size: int = 20,
    max_domains: int = 5,
    max_kpis: int = 5,
    domain_split: str = "schema_name",
) -> TextResult:
    """Descriptions, glossary, sensitivity, KPIs and judgments of a catalog, each question asked once.

    ``tables`` holds ``table_name, table_description, row_count`` and the column ``domain_split``, ``columns`` what the prompts need
    (:mod:`colsight.operators.prompts`), ``candidates`` the scored columns of :func:`colsight.plans.detect.candidates` and ``roles`` their
    ``table_name, table_role``. Steps that build on others use what those have answered so far. The columns, which are most of the questions, are
    described last, so that no other step searches their answers; the answers of the other steps are stored before they are read as JSON, as
    the optimizer would else read those of every step.
    """

    def said(questions: DataFrame) -> DataFrame:
        return columnar(ledger.ask(questions).drop("prompt"))
    tables, columns = columnar(tables), columnar(columns)
    described = ledger.ask(prompts.table_prompts(tables, columns))
    tables = columnar(answers.apply_descriptions(tables, described, ["table_name"], "table_description"))

    batched = sensitivity.batches(columns, batch_size)
    questions = sensitivity.prompts(batched.join(tables.select("table_name", "table_description"), "table_name"))
    verdicts = sensitivity.parse_responses(ledger.ask(questions), batched.select("table_name", "batch", "column_name"))

    terms = answers.glossaries(said(prompts.glossary_prompts(tables, columns)))
    tables_out = columnar(answers.apply_glossaries(tables, terms))

    named = answers.domains(said(prompts.domain_prompts(tables, max_domains, domain_split)))
    # Two parts may name a domain alike: the part keeps them apart.
    known = answers.known_domains(named, tables).withColumn("domain", F.concat_ws(" / ", F.col("part").cast("string"), "domain"))
    domains = columnar(known.select("domain", "place", "table_name"))
    found = answers.kpis(said(prompts.kpi_prompts(domains, tables, columns, max_kpis)), max_kpis)
    kpis = columnar(answers.keep_valid_links(found, answers.valid_columns(domains, columns)))

    chosen = None
    if candidates is not None:
        candidates = columnar(candidates)
        judged = said(prompts.judge_prompts(filters.judge_payloads(candidates), roles))
        chosen = columnar(filters.filter_columns(candidates, answers.last_judgments(answers.judgments(judged))))

    explained = ledger.ask(prompts.column_prompts(tables, columns))
    written = answers.apply_descriptions(columns, explained, ["table_name", "column_name"])
    return TextResult(tables_out, columnar(sensitivity.apply_verdicts(written, verdicts)), kpis, chosen)
