"""Product cards: retrieve, guard, pack, then rounds of generate and critique.

Every round is a few Spark stages over the jobs still open. A stage that asks a
model is checkpointed, so a restart or a lost executor never repeats an answer
that later stages have used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.json_repair import repaired_json
from loomdex.operators import contract
from loomdex.operators.card_json import read_card
from loomdex.operators.context import build_context
from loomdex.operators.guard import blocked_chunks, guard_context, guard_output, guard_report
from loomdex.plans import models
from loomdex.plans.embedding import QUERY_PREFIX, Embedder, embed_texts
from loomdex.plans.models import Agent, ModelClient
from loomdex.plans.retrieval import Corpus, search
from loomdex.schemas import CARD, CRITIQUE, EMPTY_LIST, FACTS, INJECTION_VERDICT
from loomdex.session import durable
from loomdex.settings import DEFAULTS, Settings

DEFAULT_QUERY = "карточка товара характеристики"
CONTEXT_RULES = (
    "Answer only from the context. What it does not say goes to missing_fields. Name the chunk_id "
    "of every fragment you rely on in sources. Rate your confidence honestly.\n\nCONTEXT:\n"
)
CRITIC_RULES = (
    "Rules: title of at most 60 characters; characteristics confirmed by the material; no filler. "
    "doc_id, page and score of sources are set by the system and are no defect; a chunk_id that is "
    "not in the material is one. A filled missing_fields is expected.\n\n"
)


@dataclass
class CardRun:
    """Outcome of a batch of jobs.

    ``results``: job_id, status, card, coverage, attempts, error, issues ...
    ``events``:  job_id, seq, status - every status a job went through, in order
    ``calls``, ``traces``: accounting rows of all stages
    ``blocked``: job_id, rank, chunk_id, reason of chunks kept from the models;
    ``state.mark_suspicious`` raises their stored flag
    ``contexts``: job_id, context and allowed chunk ids the models were given
    """

    results: DataFrame
    events: DataFrame
    calls: DataFrame | None
    traces: DataFrame | None
    blocked: DataFrame | None = None
    contexts: DataFrame | None = None


@dataclass
class CardFlow:
    make_client: Callable[[Agent], ModelClient]
    model_names: dict[bool, str] = field(default_factory=lambda: {False: "main", True: "cheap"})
    prices: dict = field(default_factory=lambda: {"default": {"input": 0.0, "output": 0.0}})
    parallel_calls: int | None = None
    settings: Settings = DEFAULTS
    _calls: list[DataFrame] = field(default_factory=list)
    _traces: list[DataFrame] = field(default_factory=list)
    _events: list[DataFrame] = field(default_factory=list)
    _clock: int = 0

    # -- stages ------------------------------------------------------------

    def _ask(self, prompts: DataFrame, agent: Agent) -> DataFrame:
        stage = models.ask(
            prompts,
            agent,
            self.make_client,
            parallel_calls=self.parallel_calls,
            settings=self.settings,
        )
        model = self.model_names[agent.cheap]
        self._clock += 1
        self._calls.append(models.call_rows(stage, agent, model, self.prices))
        self._traces.append(models.trace_rows(stage, prompts, agent, model, self._clock))
        return stage.select("job_id", "answer", "error")

    def _publish(self, jobs: DataFrame, status: str | Column) -> None:
        self._clock += 1
        value = F.lit(status) if isinstance(status, str) else status
        self._events.append(
            jobs.select("job_id", F.lit(self._clock).alias("seq"), value.alias("status")).filter(
                F.col("status").isNotNull()
            )
        )

    def detector(self, suspicious: DataFrame) -> DataFrame:
        """Second opinion on suspicious chunks; an unreadable verdict counts as none."""
        prompts = suspicious.select(
            F.col("fragment_id").alias("job_id"), F.concat(F.lit("FRAGMENT:\n"), "text").alias("prompt")
        )
        stage = models.ask(
            prompts,
            models.INJECTION_DETECTOR,
            self.make_client,
            parallel_calls=self.parallel_calls,
            settings=self.settings,
        )
        # The calls concern chunks, not jobs, so they stay unattributed.
        calls = models.call_rows(
            stage, models.INJECTION_DETECTOR, self.model_names[True], self.prices
        )
        self._calls.append(calls.withColumn("job_id", F.lit(None).cast("string")))
        verdict = F.from_json(repaired_json(F.col("answer")), INJECTION_VERDICT)
        return stage.select(F.col("job_id").alias("fragment_id"), verdict.alias("v")).select(
            "fragment_id", F.col("v.injection").alias("injection"), F.col("v.reason").alias("detail")
        )

    def _drafts(
        self, jobs: DataFrame, agent: Agent, chunks: DataFrame | None
    ) -> DataFrame:
        """``jobs`` (job_id, prompt, allowed_ids, scores) with draft, model_error and
        invalid: up to ``max_fix_attempts`` repairs, each only for the rows that
        still fail, with the reason put in front of the prompt."""
        open_jobs, finished = jobs, []
        for _ in range(self.settings.max_fix_attempts + 1):
            answers = self._ask(open_jobs, agent)
            tried = open_jobs.join(answers, "job_id").withColumn("parsed", repaired_json(F.col("answer")))
            tried = tried.withColumn("read", read_card(F.col("parsed")))
            tried = tried.withColumn("card", contract.with_defaults(F.col("read.card")))
            # Rules are asked of cards whose fields have their types.
            typed = F.size("read.type_errors") == 0
            rules = F.when(typed, contract.contract_violations(F.col("card"))).otherwise(F.col("read.type_errors"))
            broken = F.concat_ws("; ", rules)
            checked = tried.withColumn(
                "problem",
                F.when(F.col("error").isNotNull(), F.lit(None))
                .when(F.col("parsed").isNull(), "no JSON object in the answer")
                .when(broken != "", broken),
            )
            checked = durable(checked.drop("read"))
            if chunks is not None:
                cited = contract.cited_chunks(checked, chunks)
                checked = cited.withColumn(
                    "problem",
                    F.coalesce(
                        "problem",
                        contract.source_errors(
                            F.col("card"), F.col("allowed_ids"), F.col("cited.chunk_id")
                        ),
                    ),
                ).withColumn(
                    "card", contract.enrich_sources(F.col("card"), F.col("cited"), F.col("scores"))
                )
                checked = durable(checked)
            done = F.col("problem").isNull()
            finished.append(
                checked.filter(done).select(
                    "job_id",
                    F.when(F.col("error").isNull(), F.col("card")).alias("draft"),
                    F.col("error").alias("model_error"),
                    F.lit(False).alias("invalid"),
                )
            )
            retry = F.concat(
                F.lit("Your last answer was rejected: "),
                "problem",
                F.lit("\nReturn a corrected JSON card. Allowed chunk_id: "),
                F.array_join("allowed_ids", ", "),
                F.lit("\n\n"),
                "prompt",
            )
            open_jobs = checked.filter(~done).select(*jobs.columns[:1], retry.alias("prompt"), *jobs.columns[2:])
            if open_jobs.isEmpty():
                break
        finished.append(
            open_jobs.select(
                "job_id",
                F.lit(None).cast(CARD).alias("draft"),
                F.lit(None).cast("string").alias("model_error"),
                F.lit(True).alias("invalid"),
            )
        )
        out = finished[0]
        for part in finished[1:]:
            out = out.unionByName(part)
        return out

    def _rounds(
        self, jobs: DataFrame, material: str, generator: Agent, chunks: DataFrame | None
    ) -> DataFrame:
        """Rounds of generate and critique over ``jobs`` (job_id, <material>,
        allowed_ids, scores) -> job_id, draft, approved, attempts, error, invalid."""
        empty = F.expr(EMPTY_LIST)
        open_jobs = jobs.withColumn("feedback", empty)
        closed = []
        for number in range(1, self.settings.max_rounds + 1):
            remarks = F.when(
                F.size("feedback") > 0,
                F.concat(
                    F.lit("Remarks of the critic:\n"),
                    F.array_join(F.transform("feedback", lambda i: F.concat(F.lit("- "), i)), "\n"),
                    F.lit("\n\n"),
                ),
            ).otherwise(F.lit(""))
            prompts = open_jobs.select(
                "job_id", F.concat(remarks, F.col(material)).alias("prompt"), "allowed_ids", "scores"
            )
            self._publish(open_jobs, "generating")
            drafts = self._drafts(prompts, generator, chunks)
            drafted = durable(open_jobs.drop("draft").join(drafts, "job_id"))
            usable = drafted.filter(F.col("draft").isNotNull())
            self._publish(usable, "critiquing")
            review = usable.select(
                "job_id",
                F.concat(
                    F.lit(CRITIC_RULES), F.col(material), F.lit("\n\nDRAFT:\n"), F.to_json("draft")
                ).alias("prompt"),
            )
            critique = F.from_json(repaired_json(F.col("answer")), CRITIQUE)
            verdicts = self._ask(review, models.CRITIC).select(
                "job_id", F.col("error").alias("critic_error"), critique.alias("critique")
            )
            judged = drafted.join(verdicts, "job_id", "left")
            readable = F.col("critique.verdict").isin("approve", "regenerate")
            critic_failed = F.when(
                F.col("draft").isNotNull() & ~F.coalesce(readable, F.lit(False)),
                F.coalesce("critic_error", F.lit("unreadable verdict")),
            )
            judged = durable(
                judged.withColumn("approved", F.coalesce(F.col("critique.verdict") == "approve", F.lit(False)))
                .withColumn(
                    "error",
                    F.coalesce(
                        F.concat(F.lit("generate: "), "model_error"),
                        F.concat(F.lit("critique: "), critic_failed),
                    ),
                )
                .withColumn("attempts", F.lit(number))
            )
            ends = (
                F.col("approved")
                | F.col("error").isNotNull()
                | F.col("invalid")
                | F.lit(number == self.settings.max_rounds)
            )
            closed.append(
                judged.filter(ends).select("job_id", "draft", "approved", "attempts", "error", "invalid")
            )
            open_jobs = judged.filter(~ends).select(
                *[c for c in open_jobs.columns if c not in ("feedback", "draft")],
                F.coalesce("critique.issues", empty).alias("feedback"),
            )
            if open_jobs.isEmpty():
                break
        out = closed[0]
        for part in closed[1:]:
            out = out.unionByName(part)
        return out

    def _finish(self, results: DataFrame, decisions: DataFrame | None) -> CardRun:
        """Terminal states, human decisions and the collected logs."""
        waits = F.col("status") == "awaiting_human"
        self._publish(results, F.col("status"))
        if decisions is not None:
            decided = results.join(decisions.select("job_id", "decision"), "job_id", "left")
            final = F.when(waits & F.col("decision").isNotNull(), F.when(F.col("decision") == "approve", "approved").otherwise("rejected"))
            decided = decided.withColumn("final", final)
            self._publish(decided, F.col("final"))
            results = decided.withColumn("status", F.coalesce("final", "status")).drop("final", "decision")

        def merged(parts: list[DataFrame]) -> DataFrame | None:
            out = parts[0] if parts else None
            for part in parts[1:]:
                out = out.unionByName(part)
            return out

        return CardRun(results, merged(self._events), merged(self._calls), merged(self._traces))

    # -- flows -------------------------------------------------------------

    def retrieve(
        self, jobs: DataFrame, corpus: Corpus, make_embedder: Callable[[], Embedder] | None
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(contexts, guard reports, blocked chunks) of ``jobs``.

        A job that names documents gets all their chunks; any other job gets the
        hybrid top-k of its hint, and only then scores.
        """
        rank_type = "STRUCT<doc_id: STRING, ordinal: BIGINT>"
        columns = ["job_id", "rank", "chunk_id", "filename", "metadata", "text", "score"]
        named = jobs.filter(F.size("document_ids") > 0).select(
            "job_id", F.explode(F.array_distinct("document_ids")).alias("doc_id")
        )
        wanted = corpus.documents.select("doc_id", "filename").join(named, "doc_id")
        listed = (
            corpus.chunks.join(wanted, "doc_id")
            .withColumn("rank", F.struct("doc_id", "ordinal").cast(rank_type))
            .withColumn("score", F.lit(None).cast("double"))
            .select(*columns)
        )
        found = listed
        if make_embedder is not None:
            free = jobs.filter(F.coalesce(F.size("document_ids"), F.lit(0)) <= 0).select(
                F.col("job_id").alias("query_id"),
                F.coalesce(F.nullif("product_hint", F.lit("")), F.lit(DEFAULT_QUERY)).alias("query_text"),
            )
            vectors = embed_texts(
                free,
                make_embedder,
                id_column="query_id",
                text_column="query_text",
                prefix=QUERY_PREFIX,
                output="query_vec",
            ).drop("error")
            hits = search(durable(free.join(vectors, "query_id")), corpus, settings=self.settings)
            searched = hits.select(
                F.col("query_id").alias("job_id"),
                F.struct(F.lit("").alias("doc_id"), F.col("rank").alias("ordinal")).cast(rank_type).alias("rank"),
                "chunk_id",
                "filename",
                "metadata",
                "text",
                F.coalesce("score", "rrf_score").alias("score"),
            )
            found = listed.unionByName(searched)
        guarded = durable(guard_context(found, self.detector))
        safe = guarded.filter(~F.col("blocked"))
        scores = (
            safe.filter(F.col("score").isNotNull())
            .groupBy("job_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "score"))).alias("scores"))
        )
        contexts = jobs.select("job_id").join(build_context(safe, self.settings.context_char_limit), "job_id", "left")
        contexts = contexts.join(scores, "job_id", "left").select(
            "job_id",
            F.coalesce("context", F.lit("")).alias("context"),
            F.coalesce("allowed_ids", F.expr(EMPTY_LIST)).alias("allowed_ids"),
            F.coalesce("scores", F.expr("CAST(MAP() AS MAP<STRING, DOUBLE>)")).alias("scores"),
        )
        report = guard_report(guarded, self.settings.suspicious_chunk_limit)
        return durable(contexts), durable(report), blocked_chunks(guarded)

    def rag_cards(
        self,
        jobs: DataFrame,
        corpus: Corpus,
        make_embedder: Callable[[], Embedder] | None = None,
        decisions: DataFrame | None = None,
    ) -> CardRun:
        """Cards from documents. ``jobs``: job_id, document_ids, product_hint."""
        self._publish(jobs, "retrieving")
        contexts, reports, blocked = self.retrieve(jobs, corpus, make_embedder)
        self._clock += 1
        self._traces.append(
            contexts.select(
                "job_id",
                F.lit(self._clock).alias("position"),
                F.lit("rag_context").alias("step"),
                F.lit("retrieval").alias("agent"),
                F.lit(None).cast("string").alias("model"),
                F.lit(None).cast("string").alias("prompt_text"),
                F.col("context").alias("raw_completion"),
                F.lit(None).cast("string").alias("usage_json"),
            )
        )
        material = contexts.withColumn("material", F.concat(F.lit(CONTEXT_RULES), "context"))
        rounds = self._rounds(material, "material", models.CARD_GENERATOR, corpus.chunks)
        guarded = rounds.withColumn("g", guard_output(F.to_json("draft")))
        cleaned = F.when(F.col("draft").isNotNull(), F.from_json("g.cleaned", CARD))
        cards = guarded.withColumn("card", contract.with_defaults(cleaned))
        cards = cards.withColumn("card", F.when(F.col("draft").isNotNull(), F.col("card")))
        cited = contract.cited_chunks(cards, corpus.chunks).join(
            reports, "job_id", "left"
        )
        coverage = F.when(F.col("card").isNotNull(), contract.source_coverage(F.col("card"), F.col("cited")))
        review = F.coalesce("needs_review", F.lit(False))
        scored = cited.withColumn("coverage", F.round(coverage, 3))
        decided = contract.decide_status(F.col("card"), F.col("approved"), coverage, review, self.settings)
        status = (
            F.when(F.col("error").isNotNull(), "failed")
            .when(F.col("invalid"), "needs_review")
            .when(decided == "done", "awaiting_human")
            .otherwise(decided)
        )
        results = durable(
            scored.withColumn("status", status).select(
                "job_id",
                "status",
                "card",
                "coverage",
                "attempts",
                F.substring("error", 1, self.settings.error_char_limit).alias("error"),
                F.coalesce("g.issues", F.expr(EMPTY_LIST)).alias("issues"),
                F.coalesce("masked_pii", F.lit(0)).alias("masked_pii"),
                F.coalesce("suspicious", F.lit(0)).alias("suspicious"),
            )
        )
        run = self._finish(results, decisions)
        run.blocked, run.contexts = blocked, contexts
        return run

    def text_cards(self, jobs: DataFrame, decisions: DataFrame | None = None) -> CardRun:
        """Cards from a supplier text. ``jobs``: job_id, supplier_text.

        A draft goes to a person even if the critic never approved it;
        ``direct_status`` is the answer for callers that do not wait for one.
        """
        self._publish(jobs, "extracting")
        prompts = jobs.select("job_id", F.col("supplier_text").alias("prompt"))
        facts = F.from_json(repaired_json(F.col("answer")), FACTS)
        extracted = durable(
            self._ask(prompts, models.EXTRACTOR).select("job_id", "error", facts.alias("facts"))
        )
        readable = F.col("facts.product_name").isNotNull()
        material = extracted.filter(readable).select(
            "job_id",
            F.concat(F.lit("Facts of the product:\n"), F.to_json("facts")).alias("material"),
            F.expr(EMPTY_LIST).alias("allowed_ids"),
            F.expr("CAST(MAP() AS MAP<STRING, DOUBLE>)").alias("scores"),
        )
        rounds = self._rounds(material, "material", models.GENERATOR, None)
        failed = extracted.filter(~F.coalesce(readable, F.lit(False))).select(
            "job_id",
            F.concat(F.lit("extract: "), F.coalesce("error", F.lit("unreadable facts"))).alias("error"),
        )
        outcome = rounds.unionByName(failed, allowMissingColumns=True)
        invalid = F.coalesce("invalid", F.lit(False))
        error = F.coalesce("error", F.when(invalid, "generate: card failed validation"))
        approved = F.coalesce("approved", F.lit(False))
        results = durable(
            outcome.select(
                "job_id",
                F.when(error.isNotNull(), "failed").otherwise("awaiting_human").alias("status"),
                F.when(error.isNotNull(), "failed")
                .when(approved, contract.confidence_gate(F.col("draft.confidence"), self.settings))
                .otherwise("rejected")
                .alias("direct_status"),
                F.col("draft").alias("card"),
                "attempts",
                F.substring(error, 1, self.settings.error_char_limit).alias("error"),
            )
        )
        return self._finish(results, decisions)

    def fix_field(self, cards: DataFrame) -> DataFrame:
        """``(job_id, card)`` with one field written anew; ``cards`` has job_id, card,
        field and error. An unusable answer gives a NULL card."""
        prompts = cards.select(
            "job_id",
            F.concat(
                F.lit("Field "), "field", F.lit(" is invalid: "), "error", F.lit("\n\nCARD:\n"), F.to_json("card")
            ).alias("prompt"),
        )
        answers = self._ask(prompts, models.FIXER)
        # A column first: a Python function may not stand inside the expressions of a card.
        parsed = answers.select("job_id", repaired_json(F.col("answer")).alias("parsed"))
        read = parsed.select("job_id", read_card(F.col("parsed")).alias("read"))
        typed = read.select("job_id", "read.type_errors", contract.with_defaults(F.col("read.card")).alias("card"))
        valid = (F.size("type_errors") == 0) & (F.size(contract.contract_violations(F.col("card"))) == 0)
        return typed.select(
            "job_id", F.when(valid, F.col("card")).alias("card")
        )

    def judge(self, contexts: DataFrame, cards: DataFrame) -> DataFrame:
        """``(job_id, faithfulness)``; NULL where the judge failed."""
        prompts = contexts.select("job_id", "context").join(cards.select("job_id", "card"), "job_id")
        prompts = prompts.select(
            "job_id",
            F.concat(F.lit("CONTEXT:\n"), "context", F.lit("\n\nCARD:\n"), F.to_json("card")).alias("prompt"),
        )
        verdict = F.from_json(repaired_json(F.col("answer")), "faithfulness DOUBLE, reasons ARRAY<STRING>")
        return self._ask(prompts, models.JUDGE).select("job_id", verdict["faithfulness"].alias("faithfulness"))
