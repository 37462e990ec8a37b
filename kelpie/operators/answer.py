"""Prompts, answers and the agent's rounds, for batches of queries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.config import DEFAULT, Settings
from kelpie.functions.text import agent_step, casual_reply, is_casual, strip, triple_text
from kelpie.functions.udf import chat
from kelpie.operators.dense import embed_queries, vector_search
from kelpie.operators.durable import cut
from kelpie.operators.graph import triple_search

SYSTEM = "You answer technical questions from the context below. Cite each fact with [N], the number of its passage, or with [KG] if it comes from the graph. Say what is missing rather than guess. End with a list of sources."
AGENT_SYSTEM = (
    "You answer technical questions with two tools: vector_search(query) finds passages, graph_search(query) finds relations between entities. "
    "Write exactly:\nThought: what you need next\nAction: vector_search, graph_search or finish\nAction Input: the query, or the final answer with [N] and [KG] citations\n"
    "After an Observation go on in the same form. Never search for the same thing twice; four rounds at most."
)


def context_block(ranked: DataFrame, triples: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): numbered passages with score, file, page and text, then the triples if there are any.

    ranked(query_id, rank, score, source_file, page_number, text); triples(query_id, rank, source, relation, target).
    """
    piece = F.format_string("[%d] score=%.3f | %s | page %d\n%s\n", "rank", F.col("score").cast("double"), "source_file", "page_number", strip(F.col("text")))
    texts = ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x.p), "\n").alias("texts"))
    line = F.concat(F.lit("  • "), triple_text(F.col("source"), F.col("relation"), F.col("target")))
    facts = triples.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("p")))), lambda x: x.p), "\n").alias("facts"))
    out = queries.select("query_id").join(texts, "query_id", "left").join(facts, "query_id", "left")
    graph = F.concat(F.lit("\n## Knowledge graph relationships [KG]\n\n"), "facts")
    return out.select("query_id", F.array_join(F.filter(F.array(F.lit("## Retrieved document context\n"), F.col("texts"), graph), lambda x: x.isNotNull()), "\n").alias("context"))


def _message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def build_messages(queries: DataFrame, contexts: DataFrame, system: str = SYSTEM) -> DataFrame:
    """queries(query_id, query[, history array<struct<role, content>>]) with messages: system, history, context and question."""
    ask = F.concat("context", F.lit("\n\n---\n\n**Question:** "), "query", F.lit("\n\nCite every fact with [N] or [KG] and close with a ## Sources section."))
    history = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")) if "history" in queries.columns else F.array().cast("array<struct<role:string,content:string>>")
    return queries.join(contexts, "query_id").withColumn("messages", F.concat(F.array(_message("system", system)), history, F.array(_message("user", ask))))


def source_pages(ranked: DataFrame, number: str = "rank") -> DataFrame:
    """(query_id, sources, source_pages): every passage of the context, whether cited or not."""
    ref = F.format_string("[%d] %s — page %d", number, "source_file", "page_number")
    row = F.struct(F.col(number).cast("int").alias("n"), F.col("source_file").alias("file"), F.col("page_number").alias("page"), ref.alias("ref"))
    out = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("source_pages"))
    return out.select("query_id", F.transform("source_pages", lambda x: x.file).alias("sources"), "source_pages")


def generate(queries: DataFrame, ranked: DataFrame, triples: DataFrame, model: Callable[[list[dict]], str], system: str = SYSTEM) -> DataFrame:
    """answers(query_id, query, answer, sources, source_pages, triples)."""
    m = build_messages(queries, context_block(ranked, triples, queries), system)
    facts = triples.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", triple_text(F.col("source"), F.col("relation"), F.col("target")).alias("t")))), lambda x: x.t).alias("triples"))
    out = m.select("query_id", "query", chat(model)(F.col("messages")).alias("answer"))
    return out.join(source_pages(ranked), "query_id", "left").join(facts, "query_id", "left")


def casual(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, rest): small talk gets its reply, all other queries go on."""
    return queries.where(is_casual(F.col("query"))).withColumn("answer", casual_reply(F.col("query"))), queries.where(~is_casual(F.col("query")))


# ---------------------------------------------------------------- models


@dataclass
class Budgeted:
    """A model call with retries on rate limits (waiting as long as the error says) and a cap on tokens.

    `call(messages)` returns (answer, tokens in, tokens out) and raises RateLimited when it should be tried again. What was used is kept
    per worker process; a driver that wants a total sums the answers' counts instead.
    """

    call: Callable[[list[dict]], tuple[str, int, int]]
    tries: int = 3
    cap: int = DEFAULT.token_cap
    wait: float = 10.0
    used_in: int = 0
    used_out: int = 0

    def __call__(self, messages: list[dict]) -> str:
        for k in range(self.tries):
            if self.used_in >= self.cap:
                raise BudgetSpent(f"{self.used_in} input tokens used")
            try:
                text, a, b = self.call(messages)
            except RateLimited as e:
                if k + 1 == self.tries:
                    raise
                said = re.search(r"in (\d+(?:\.\d+)?)\s*s", str(e))
                time.sleep(float(said[1]) if said else self.wait)
                continue
            self.used_in += a
            self.used_out += b
            return text
        raise RateLimited("no try left")


class RateLimited(Exception):
    pass


class BudgetSpent(Exception):
    pass


EXTRACT = (
    "Find the technical entities and relations in the text. Answer with JSON alone: "
    '{"entities": [{"name": ..., "type": ...}], "relations": [{"source": ..., "relation": ..., "target": ...}]}.\n\nText:\n'
)
AGAIN = "\n\nYour last answer had no usable JSON. Give the JSON object and nothing else."


def extract(chunks: DataFrame, model: Callable[[list[dict]], str], s: Settings = DEFAULT) -> DataFrame:
    """raw(chunk_id, chunk_ord, source_file, raw, retried): the model's answer for each chunk, asked once more if nothing usable came.

    Chunks go by whole Arrow batches; a call that fails counts as an empty answer.
    """
    import json

    import pandas as pd

    cap = s.extract_cap

    def usable(answer: str) -> bool:
        clean = re.sub("```(?:json)?", "", answer or "").strip()
        for text in (clean, (re.search(r"\{.*\}", clean, re.DOTALL) or [""])[0]):
            try:
                found = json.loads(text)
            except ValueError:
                continue
            return not isinstance(found, dict) or bool(found.get("entities")) or bool(found.get("relations"))
        return False

    def ask(prompt: str) -> str:
        try:
            return model([{"role": "user", "content": prompt}]) or ""
        except Exception:  # noqa: BLE001
            return ""

    def run(frames):
        for pdf in frames:
            raw, again = [], []
            for t in pdf["text"]:
                first = ask(EXTRACT + (t or "")[:cap])
                ok = usable(first)
                raw.append(first if ok else ask(EXTRACT + (t or "")[:cap] + AGAIN))
                again.append(not ok)
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "chunk_ord": pdf["chunk_ord"], "source_file": pdf["source_file"], "raw": raw, "retried": again})

    return chunks.select("chunk_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "source_file", "text").mapInPandas(run, "chunk_id string, chunk_ord long, source_file string, raw string, retried boolean")


# ---------------------------------------------------------------- agent


def run_agent(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, model: Callable[[list[dict]], str], encode: Callable | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, query, answer, iterations, steps, source_pages, triples_used).

    Each round is one batch over the queries that are still open: model, parse, tools, observation. A round is written to the checkpoint folder,
    so the model is asked once for it and plans stay small; what is still open after the last is asked to finish with all that was found.
    Passages are numbered on across rounds.
    """
    empty_steps = F.array().cast("array<struct<thought:string,action:string,action_input:string,observation:string>>")
    found_type = "array<struct<n:int,file:string,page:int,text:string>>"
    state = queries.select(
        "query_id", "query", F.array(_message("system", AGENT_SYSTEM), _message("user", F.concat(F.lit("Question: "), "query", F.lit("\n\nBegin.")))).alias("messages"), empty_steps.alias("steps"),
        F.array().cast(found_type).alias("found"), F.array().cast("array<string>").alias("facts"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("iterations"),
    )
    ask = chat(model)
    for k in range(s.agent_rounds):
        state = state.withColumn("_open", F.coalesce(F.col("answer"), F.lit("")) == "" if k else F.lit(True))
        done, live = state.where(~F.col("_open")).drop("_open"), state.where("_open").drop("_open")
        live = cut(live.withColumn("_said", ask(F.col("messages"))))
        live = live.withColumn("_step", agent_step(F.col("_said"))).withColumn("_do", F.lower("_step.action")).withColumn("_in", F.col("_step.action_input"))
        want = live.where("_do = 'vector_search'").select("query_id", F.col("_in").alias("query"))
        hits = vector_search(vectors, embed_queries(want, encode), s.agent_chunks).join(chunks.select("chunk_id", "source_file", "page_number", "text"), "chunk_id")
        hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "source_file", "page_number", "text"))).alias("_hits"))
        facts = triple_search(nodes, edges, live.where("_do = 'graph_search'").select("query_id", F.col("_in").alias("query")), s.agent_triples, s)
        facts = facts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", triple_text(F.col("source"), F.col("relation"), F.col("target")).alias("t")))), lambda x: x.t).alias("_facts"))
        live = live.join(hits, "query_id", "left").join(facts, "query_id", "left")
        base = F.size("found")
        shown = F.transform("_hits", lambda x, i: F.format_string("[%d] %s page %d (score=%.3f):\n%s", base + i + 1, x.source_file, x.page_number, x.score, strip(F.substring(x.text, 1, s.observation_cap))))
        seen = (
            F.when(F.col("_do") == "vector_search", F.coalesce(F.array_join(shown, "\n\n"), F.lit("No relevant chunks found.")))
            .when(F.col("_do") == "graph_search", F.coalesce(F.array_join(F.transform("_facts", lambda t: F.concat(F.lit("[KG] "), t)), "\n"), F.lit("No graph relationships found.")))
            .when(F.col("_do") == "finish", F.lit(""))
            .otherwise(F.concat(F.lit("Unknown tool '"), "_step.action", F.lit("'. Use vector_search or graph_search.")))
        )
        live = live.withColumn("_seen", seen)
        over = F.col("_do") == "finish"
        new = F.transform(F.coalesce("_hits", F.array().cast("array<struct<rank:int,score:double,source_file:string,page_number:int,text:string>>")), lambda x, i: F.struct((base + i + 1).cast("int").alias("n"), x.source_file.alias("file"), x.page_number.alias("page"), x.text.alias("text")))
        live = live.select(
            "query_id", "query", F.when(over, F.col("messages")).otherwise(F.concat("messages", F.array(_message("assistant", F.col("_said")), _message("user", F.concat(F.lit("Observation: "), "_seen", F.lit("\n\nContinue.")))))).alias("messages"),
            F.concat("steps", F.array(F.struct("_step.thought", "_step.action", "_step.action_input", F.col("_seen").alias("observation")))).alias("steps"), F.concat("found", new.cast(found_type)).alias("found"),
            F.concat("facts", F.coalesce("_facts", F.array().cast("array<string>"))).alias("facts"), F.when(over, F.col("_in")).alias("answer"), F.lit(k + 1).alias("iterations"),
        )
        state = cut(done.unionByName(live))
    evidence = F.concat(
        F.lit("No rounds are left. Give your best answer now from what was found.\n\nRetrieved chunks:\n"),
        F.array_join(F.transform("found", lambda x: F.format_string("[%d] %s p%d: %s", x.n, x.file, x.page, F.substring(x.text, 1, s.finish_cap))), "\n\n"),
        F.lit("\n\nGraph relationships:\n"),
        F.array_join(F.transform("facts", lambda t: F.concat(F.lit("[KG] "), t)), "\n"),
    )
    still = F.coalesce("answer", F.lit("")) == ""
    forced = state.where(still).withColumn("answer", ask(F.concat("messages", F.array(_message("user", evidence)))))
    out = state.where(~still).unionByName(forced)
    pages = F.transform("found", lambda x: F.struct(x.n.alias("n"), x.file.alias("file"), x.page.alias("page"), F.format_string("[%d] %s — page %d", x.n, x.file, x.page).alias("ref")))
    return out.select("query_id", "query", "answer", "iterations", "steps", pages.alias("source_pages"), F.col("facts").alias("triples_used"))


def number_citations(hits: DataFrame) -> DataFrame:
    """hits(query_id, search, rank, ...) with n: numbers that go on from one search to the next."""
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("search", "rank")))
