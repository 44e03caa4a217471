"""Retrieval of sentences for questions, and the prompts made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdigest.functions.vectors import cosine_similarity

#: Questions that one pass over the vectors scores at once.
QUESTIONS = 2000
#: Questions whose scores with a batch of vectors are held at once.
TOGETHER = 250


def _ranked(scored: DataFrame, k: int, *tie) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve_topk(questions: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """``matches(question_id, doc_key, rank, sent_idx, sentence, score)``: the k best sentences of each question's document; of equals the first."""
    q = questions.where("trim(question) != ''").select("question_id", "doc_key", F.col("embedding").alias("q"))
    said = F.col("sentence") if "sentence" in vectors.columns else F.lit(None).cast("string")
    both = q.join(vectors.select("doc_key", "sent_idx", said.alias("sentence"), "embedding"), "doc_key")
    scored = both.select("question_id", "doc_key", "sent_idx", "sentence", cosine_similarity(F.col("q"), F.col("embedding")).alias("score"))
    return _ranked(scored, k, "sent_idx").select("question_id", "doc_key", "rank", "sent_idx", "sentence", "score")


def _sums(x: np.ndarray) -> np.ndarray:
    """Each row's sum, added in order: equal rows have equal sums, wherever they stand."""
    return np.cumsum(x, axis=1)[:, -1]


def retrieve_topk_corpus(questions: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """``(question_id, rank, doc_key, sent_idx, score)`` over all documents. Questions are scored in blocks of bounded size, each against every vector once; of equal scores, the first by document and sentence."""
    q = questions.where("trim(question) != ''").select("question_id", "embedding")
    n = q.count()
    blocks = -(-n // QUESTIONS) or 1
    out = None
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i).collect()
        ids = np.array([r.question_id for r in rows], np.int64)
        m = np.array([r.embedding for r in rows], float).reshape(len(rows), -1)
        sizes = _sums(m * m) ** 0.5 + 1e-8

        def score(batches, ids=ids, m=m, sizes=sizes):
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                pdf = pdf.sort_values(["doc_key", "sent_idx"], na_position="first", kind="stable")
                x = np.stack(pdf["embedding"].to_numpy()).astype(float)
                size = _sums(x * x) ** 0.5 + 1e-8
                unit, found = (x / size[:, None]).T, []
                for lo in range(0, len(ids), TOGETHER):
                    s = (m[lo : lo + TOGETHER] / sizes[lo : lo + TOGETHER, None]) @ unit
                    s[np.isnan(s)] = np.inf
                    last = min(k, len(x)) - 1
                    least = -np.partition(-s, last, axis=1)[:, last] - 1e-9
                    for i, row in enumerate(s, lo):  # all that may be among the k best; a product's rounding depends on its place, so these are summed anew
                        near = np.flatnonzero(row >= least[i - lo])
                        exact = _sums(x[near] * m[i]) / (sizes[i] * size[near])
                        best = np.argsort(-np.where(np.isnan(exact), np.inf, exact), kind="stable")[:k]
                        at = near[best]
                        found.append(pd.DataFrame({"question_id": ids[i], "doc_key": pdf["doc_key"].to_numpy()[at], "sent_idx": pdf["sent_idx"].to_numpy()[at], "score": exact[best]}))
                yield pd.concat(found)

        part = vectors.select("doc_key", "sent_idx", "embedding").mapInPandas(score, "question_id long, doc_key string, sent_idx int, score double")
        out = part if out is None else out.union(part)
    return _ranked(out, k, "doc_key", "sent_idx").select("question_id", "rank", "doc_key", "sent_idx", "score")


def numbered(sentences: Column) -> Column:
    return F.transform(sentences, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))


def build_polish_prompts(summaries: DataFrame, instructions: str) -> DataFrame:
    """``(doc_key, mode, prompt, fallback)``: numbered sentences under the instructions, and the sentences joined as prose."""
    return summaries.select("doc_key", "mode", F.concat(F.lit(instructions + "\n"), F.array_join(numbered(F.col("sentences")), "\n")).alias("prompt"), F.array_join("sentences", " ").alias("fallback"))


def build_answer_prompts(matches: DataFrame, questions: DataFrame, instructions: str, notice: str = "No answer service. Closest sentences:") -> DataFrame:
    """``(question_id, prompt, fallback)``: the matches as bullets in rank order, then the question."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "sentence")))
    blocks = matches.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("- "), x["sentence"])), "\n").alias("block"))
    both = questions.select("question_id", F.trim("question").alias("question")).join(blocks, "question_id")
    return both.select("question_id", F.concat_ws("\n", F.lit(instructions), "block", "question").alias("prompt"), F.concat_ws("\n", F.lit(notice), "block").alias("fallback"))


def chat_history(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """``chat_turns(doc_key, turn, role, text)``: each answered question and its answer, in order of the questions."""
    both = questions.select("question_id", "doc_key", F.trim("question").alias("question")).where("question != ''").join(answers.select("question_id", "answer"), "question_id")
    both = both.withColumn("r", F.row_number().over(Window.partitionBy("doc_key").orderBy("question_id")))
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return both.select("doc_key", "r", F.posexplode(turns).alias("p", "t")).select("doc_key", ((F.col("r") - 1) * 2 + F.col("p")).alias("turn"), "t.role", "t.text")
