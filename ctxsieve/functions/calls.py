"""Calls of a caller's model from a table of prompts, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship


class QuotaExhausted(RuntimeError):
    """No retry helps: the whole job ends."""


class CallFailed(RuntimeError):
    """A call failed with an HTTP ``status``."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(message or str(status))
        self.status = status

    def __reduce__(self):
        return CallFailed, (self.status, str(self))


def with_retries(call: Callable[[str, str], tuple[str, bool]], system: str, prompt: str, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> tuple[str, bool]:
    """``call(system, prompt)``, again after 5 s, 10 s, ... while it is limited (429), after 3 s, 6 s, ... on server errors."""
    for attempt in range(retries + 1):
        try:
            return call(system, prompt)
        except CallFailed as e:
            if attempt == retries or not (e.status == 429 or e.status >= 500):
                raise
            sleep(2**attempt * (5 if e.status == 429 else 3))
    raise AssertionError


def answered(prompts: DataFrame, system: str, call: Callable[[str, str], tuple[str, bool]], prompt: str = "prompt", name: str = "reply", retries: int = 4) -> DataFrame:
    """``prompts`` with the reply, and ``<name>_truncated``, of ``call``, which returns a text and whether it was cut off."""
    ship(prompts.sparkSession)

    @F.pandas_udf("struct<text: string, truncated: boolean>")
    def reply(asked: pd.Series) -> pd.DataFrame:
        out = [(None, None) if p is None else with_retries(call, system, p, retries) for p in asked]
        return pd.DataFrame([((t or "").strip() if t is not None else None, x) for t, x in out], columns=["text", "truncated"])

    done = prompts.withColumn("_reply", reply(F.col(prompt)))
    return done.withColumn(name, F.col("_reply.text")).withColumn(f"{name}_truncated", F.col("_reply.truncated")).drop("_reply")


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("CONTEXT:\n\n"), context, F.lit("\n\nQUESTION: "), question)


def grade_prompt(question: Column, reference: Column, answer: Column) -> Column:
    return F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nREFERENCE:\n"), reference, F.lit("\n\nANSWER:\n"), answer)


def judge_prompt(question: Column, reference: Column | None, answer_a: Column, answer_b: Column) -> Column:
    """Prompt of a blind comparison; without a reference the judge has the question alone."""
    known = [F.lit("\n\nREFERENCE:\n"), reference] if reference is not None else []
    return F.concat(F.lit("QUESTION:\n"), question, *known, F.lit("\n\nANSWER A:\n"), answer_a, F.lit("\n\nANSWER B:\n"), answer_b)


ANSWER_SYSTEM = "Use nothing but the CONTEXT to answer the QUESTION, in few words. Where the CONTEXT does not hold the answer, say that you lack the information."
_GRADES = 'A grade is "correct" if the answer says what the REFERENCE says in any wording, "partial" if it leaves out a key part of what was asked, else "incorrect", also where it declines.'
GRADE_SYSTEM = f'Grade the ANSWER by the REFERENCE, which is complete and true. {_GRADES} Reply with JSON only: {{"grade": "...", "reason": "..."}}'
JUDGE_SYSTEM = (
    f"Two answers to one question were written from contexts of different size; you do not know which is which. Grade each by the REFERENCE. {_GRADES} "
    'Say whether one is materially worse, and which. Reply with JSON only: {"a_grade": "...", "b_grade": "...", "materially_worse": true or false, "worse_answer": "A", "B" or null, "reason": "..."}'
)
